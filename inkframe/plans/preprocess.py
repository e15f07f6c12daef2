"""Gray pages to clean ink: scale, binarise, deskew, denoise; by source kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.operators import raster as R
from inkframe.session import cut


def preprocess(pixels: DataFrame, sizes: DataFrame, kind: str = "image", source_dpi: float | None = None, target_dpi: float = 254.0, keys: Sequence[str] = ("page_id",)) -> dict[str, DataFrame]:
    """One source kind per call (profiles differ per kind, see PROFILES).

    Returns 'runs' (for segmentation), 'layout' (before denoising), 'sizes' and 'skew'.
    """
    keys = list(keys)
    pdf = kind == "pdf"
    if source_dpi and abs(source_dpi - target_dpi) > 1:
        pixels, sizes = R.resize_gray(pixels, sizes, F.lit(target_dpi / source_dpi), keys)
        sizes = cut(sizes)
    if pdf:
        runs = R.dilate(R.binarize(pixels, R.otsu(R.histogram(pixels, keys), keys), keys), 4, sizes, keys)
    else:
        runs = R.points_to_runs(R.local_threshold(pixels, keys=keys).where("ink = 1"), keys)
    runs = cut(runs)
    skew = cut(R.estimate_skew(runs, sizes, keys))
    tilted = skew.where(F.abs("deskew_deg") > 0.05)
    turned = R.rotate(runs, tilted.select(*keys, (-F.col("deskew_deg")).alias("deg")), sizes, keys)
    layout = cut(runs.join(tilted.select(*keys), keys, "left_anti").unionByName(turned))
    clean = layout
    if pdf:
        clean = R.open_square(clean, 1, sizes, keys)
    else:
        clean = R.points_to_runs(R.majority_filter(R.dense(clean, sizes, keys), 1, keys).where("ink = 1"), keys)
    clean = R.drop_small(cut(clean), 22 if pdf else 8, keys)
    return {"runs": clean, "layout": layout, "sizes": sizes, "skew": skew}
