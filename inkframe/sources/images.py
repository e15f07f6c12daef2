"""Page images and run tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERN = "*.{png,jpg,jpeg,webp,tif,tiff,PNG,JPG,JPEG,WEBP,TIF,TIFF}"


def read_page_images(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Images of a folder (origin, height, width, channels, data) and rejects (origin): files that the
    decoder cannot read, webp among them, as an empty table of images would hide them."""
    img = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", PATTERN).load(folder).select("image.*")
    good = img.where(F.length("data") > 0).select("origin", "height", "width", F.col("nChannels").alias("channels"), "data")
    return good, img.where(F.coalesce(F.length("data"), F.lit(0)) == 0).select("origin")


def explode_pixels(images: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gray pixels (keys, y, x, gray): (299 R + 587 G + 114 B) / 1000, truncated.

    Image bytes are stored B, G, R[, A]. Rows are exploded first, so a pixel row is the largest
    value handled at once.
    """
    c = F.col("channels")
    rows = images.select(*keys, "channels", "width", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    text = F.hex(F.substring(F.col("data"), F.col("y") * F.col("width") * c + 1, F.col("width") * c))
    cells = F.when(c == 1, F.regexp_extract_all(text, F.lit("(.{2})"), F.lit(1))).when(c == 3, F.regexp_extract_all(text, F.lit("(.{6})"), F.lit(1))).otherwise(F.regexp_extract_all(text, F.lit("(.{8})"), F.lit(1)))
    px = rows.select(*keys, "channels", F.col("y").cast("long").alias("y"), F.posexplode(cells).alias("x", "v"))
    byte = lambda i: F.conv(F.substring("v", 1 + 2 * i, 2), 16, 10).cast("long")
    gray = F.when(F.col("channels") == 1, byte(0)).otherwise(F.floor((byte(2) * 299 + byte(1) * 587 + byte(0) * 114) / 1000))
    return px.select(*keys, "y", F.col("x").cast("long").alias("x"), gray.alias("gray"))


def write_runs(runs: DataFrame, path: str, project: str = "project_id", page: str = "page_id") -> None:
    """Run table as Parquet, one folder per project, pages clustered and rows sorted for pruning."""
    runs.repartition(project, page).sortWithinPartitions(project, page, "y", "x0").write.mode("overwrite").partitionBy(project).parquet(path)


def read_runs(spark: SparkSession, path: str, project=None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if project is None else df.where(F.col("project_id") == project)


def save_runs_table(runs: DataFrame, name: str, buckets: int, page: str = "page_id") -> None:
    """Run table bucketed by page: later joins and aggregates by page need no shuffle."""
    runs.write.mode("overwrite").bucketBy(buckets, page).sortBy(page, "y", "x0").saveAsTable(name)
