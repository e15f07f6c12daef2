"""Canonical tables derived from the shared test tables.

The test tables hold no scanned pages, so glyphs, rasters, votes and logs are derived from them by
plain arithmetic over every row. ``catalog/sql.py`` states the same derivations in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.operators.ordered import in_order

# characters that glyph texts are drawn from (fixed order)
ALPHABET = "倪氏宗譜公子孑三世祖長次周王趙為爲遷遞禮云國张張日曰人入土士己已巳一A7"
INK_LEVEL = 114


class Tables:
    """Reads a table of the test set on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def votes(t: Tables) -> DataFrame:
    """Every event is a vote: three consecutive events of a user and day vote on one item."""
    e = t.events.select("event_id", "ts", "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    e = in_order(e, ["user_id", "day"], ["ts", "event_id"], F.hour("ts"), number="rn")
    return e.select(
        "user_id",
        "day",
        F.expr("(rn - 1) div 3").alias("item"),
        F.expr("(rn - 1) % 3 + 1").alias("round"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("char"),
        (F.col("value") / 500).alias("confidence"),
    )


VOTE_KEYS = ["user_id", "day", "item"]


def passes(t: Tables) -> DataFrame:
    """Every event is one recogniser pass over an item (user, week of month)."""
    e = t.events.select("event_id", "ts", "user_id", "event_type", "value", F.expr("(day(ts) - 1) div 7").cast("long").alias("week"))
    e = in_order(e, ["user_id", "week"], ["ts", "event_id"], F.dayofmonth("ts"), number="pass")
    return e.select(
        "user_id",
        "week",
        "pass",
        F.when(F.col("event_id") % 2 == 0, "normal").otherwise("vertical").alias("engine"),
        F.when(F.col("user_id") % 2 == 0, "horizontal").otherwise("vertical").alias("orientation"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("char"),
        (F.col("value") / 500).alias("confidence"),
    )


PASS_KEYS = ["user_id", "week"]


def wide(df: DataFrame) -> DataFrame:
    """Spread a scan of few splits over all cores before an explode; a scan that is wide enough stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def words(t: Tables) -> DataFrame:
    lines = wide(t.documents.select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("l", "line"))
    return lines.select("doc_id", F.col("l").cast("long").alias("l"), F.posexplode(F.split("line", " ")).alias("w", "word")).select(
        "doc_id", "l", F.col("w").cast("long").alias("w"), "word", F.length("word").cast("long").alias("n")
    )


def glyphs(t: Tables) -> DataFrame:
    """Every word of every document is a glyph box on the page doc_id."""
    g = words(t).selectExpr(
        "doc_id AS page_id",
        "doc_id * 1000000000 + l * 100000 + w AS glyph_id",
        "l",
        "w",
        "n",
        "CAST(w * 24 + (doc_id * 7 + l * 3 + w * 5) % 9 AS DOUBLE) AS x0",
        "CAST(l * 26 + (doc_id * 5 + l * 11 + w * 7) % 11 AS DOUBLE) AS y0",
        "CAST(14 + n % 9 AS DOUBLE) AS bw",
        "CAST(14 + (n * 3) % 11 AS DOUBLE) AS bh",
        f"CASE WHEN n % 7 = 0 THEN NULL ELSE substring('{ALPHABET}', CAST(1 + (n * 17 + l * 5 + w * 3) % {len(ALPHABET)} AS INT), 1) END AS text",
        "(doc_id * 31 + l * 7 + w * 13) % 100 / 100D AS conf",
        "8 + n % 7 * 0.5D AS pt",
        "CASE (doc_id * 3 + l + w) % 29 WHEN 0 THEN 'split' WHEN 1 THEN 'merge' WHEN 2 THEN 'spacing' WHEN 3 THEN 'blurry' WHEN 4 THEN 'empty' ELSE 'ok' END AS note",
        "CASE (l + w) % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'llm' ELSE 'local' END AS source",
        "(doc_id + l + w) % 17 = 0 AS edited",
        "CASE WHEN l = 0 THEN 'title' WHEN l % 13 = 12 THEN 'pageno' WHEN w % 5 >= 3 THEN 'rank' ELSE 'body' END AS grp",
        "CASE WHEN w = 0 THEN 'side' ELSE 'text' END AS kind",
    )
    return g.selectExpr(
        "page_id", "glyph_id", "l", "w", "n", "text", "x0 + bw / 2 AS cx", "y0 + bh / 2 AS cy",
        "x0", "y0", "x0 + bw AS x1", "y0 + bh AS y1", "pt", "conf", "note", "source", "edited", "grp", "kind",
    )


def pixels(t: Tables) -> DataFrame:
    """Every embedding is a pixel row of the page named by its label."""
    v = t.embeddings.select(F.col("label").cast("long").alias("page_id"), "vec_id", "embedding")
    v = in_order(v, ["page_id"], ["vec_id"], F.expr("vec_id div 4096"), number="rn")
    p = v.select("page_id", (F.col("rn") - 1).alias("y"), F.posexplode("embedding").alias("x", "v"))
    gray = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("v").cast("double") + 1) * 128)))
    return p.select("page_id", "y", F.col("x").cast("long").alias("x"), gray.cast("long").alias("gray"))


def page_sizes(t: Tables) -> DataFrame:
    """Width and height of every raster page."""
    return t.embeddings.groupBy(F.col("label").cast("long").alias("page_id")).agg(
        F.max(F.size("embedding")).cast("long").alias("width"), F.count(F.lit(1)).alias("height")
    )


def runs(t: Tables) -> DataFrame:
    from inkframe.operators.raster import to_runs

    return to_runs(pixels(t), INK_LEVEL)


def rects(t: Tables) -> DataFrame:
    return t.part.selectExpr(
        "p_partkey div 40 AS page_id",
        "p_partkey AS rect_id",
        "CAST(p_partkey * 37 % 150 AS DOUBLE) AS x",
        "CAST(p_partkey * 91 % 150 AS DOUBLE) AS y",
        "CAST(20 + p_partkey % 30 AS DOUBLE) AS w",
        "CAST(20 + p_partkey % 17 AS DOUBLE) AS h",
        "CASE WHEN p_partkey % 2 = 0 THEN 'border' ELSE 'tag' END AS kind",
    )


def lines(t: Tables) -> DataFrame:
    base = t.customer.selectExpr(
        "c_custkey div 60 AS page_id",
        "c_custkey AS line_id",
        "CAST(c_custkey * 53 % 300 AS DOUBLE) AS x1",
        "CAST(c_custkey * 29 % 300 AS DOUBLE) AS y1",
        "CAST(40 + c_custkey % 100 AS DOUBLE) AS len",
        "CAST(1 + c_custkey % 4 AS DOUBLE) AS width_px",
        "CASE WHEN c_custkey % 2 = 0 THEN 'h' ELSE 'v' END AS orientation",
    )
    return base.selectExpr(
        "page_id", "line_id", "x1", "y1",
        "IF(orientation = 'h', x1 + len, x1) AS x2", "IF(orientation = 'v', y1 + len, y1) AS y2",
        "width_px", "orientation",
    )


def nodes(t: Tables) -> DataFrame:
    return t.supplier.selectExpr(
        "s_suppkey % 25 AS page_id",
        "s_suppkey AS node_id",
        "CAST(s_suppkey * 53 % 300 AS DOUBLE) AS cx",
        "CAST(s_suppkey * 29 % 300 AS DOUBLE) AS cy",
        "CAST(6 + s_suppkey % 8 AS DOUBLE) AS r",
    )


SIG_BITS = 64


def _bits(flip_count: str) -> str:
    # bit p of the signature, flipped where its place in a per-row order is below the count
    place = "((p - vec_id * 5 % 64 + 64) * 57 % 64)"
    return (
        "aggregate(sequence(0L, 63L), 0L, (acc, p) -> acc | shiftleft("
        f"CAST((embedding[CAST(p AS INT)] > 0) <> ({place} < {flip_count}) AS BIGINT), CAST(p AS INT)))"
    )


def memory(t: Tables) -> DataFrame:
    """Every embedding is a remembered glyph; its signature is the 64 sign bits."""
    return t.embeddings.selectExpr(
        "vec_id AS memory_id",
        "CASE vec_id % 4 WHEN 0 THEN NULL ELSE vec_id % 3 END AS project_id",
        f"{_bits('0')} AS sig",
        "CAST(label AS BIGINT) AS aspect",
        f"substring('{ALPHABET}', CAST(1 + label AS INT), 1) AS char",
        "vec_id % 5 AS manual",
        "vec_id % 3 AS model",
        "1L AS local",
        "vec_id % 5 + vec_id % 3 + 1 AS total",
        "(vec_id % 5 + vec_id % 3 + 1) * 0.95D AS confidence_sum",
    )


def queries_fp(t: Tables) -> DataFrame:
    """The same glyphs seen again with vec_id % 8 flipped bits."""
    return t.embeddings.selectExpr(
        "vec_id AS glyph_id", "vec_id % 3 AS project_id", f"{_bits('vec_id % 8')} AS sig", "CAST(label AS BIGINT) AS aspect"
    )


def project_pages(t: Tables) -> DataFrame:
    """Every order is a page of the project o_custkey."""
    o = t.orders.selectExpr("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice")
    o = in_order(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.year("o_orderdate"), number="rn")
    return o.selectExpr(
        "o_custkey AS project_id",
        "o_orderkey AS page_id",
        "rn - 1 AS idx",
        "element_at(array('imported','preprocessed','analyzed','recognized','proofread','exported'),"
        " CAST(CAST(substring(o_orderpriority, 1, 1) AS INT) + IF(o_orderstatus = 'P', 1, 0) AS INT)) AS status",
        "CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'O' THEN 'B' ELSE 'A' END AS rec_mode",
        "CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'O' THEN 'gemini' ELSE 'local' END AS rec_provider",
        "CASE o_orderstatus WHEN 'F' THEN NULL ELSE concat('m', o_orderkey % 3) END AS rec_model",
        "CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 0 THEN 'B:gemini:m1' END AS settings_key",
        "o_totalprice",
        "o_orderdate",
    )


def page_glyphs(t: Tables) -> DataFrame:
    """Every line item is a glyph of the page l_orderkey."""
    return t.lineitem.selectExpr(
        "l_orderkey AS page_id",
        "l_orderkey * 10 + l_linenumber AS glyph_id",
        "CASE WHEN l_returnflag = 'N' THEN '' WHEN l_linestatus = 'F' THEN l_returnflag END AS text",
        "l_quantity AS pt",
        "1 - l_discount * 5 AS conf",
        "CASE l_returnflag WHEN 'A' THEN 'rank' WHEN 'N' THEN 'body' ELSE 'title' END AS grp",
        "l_linenumber = 7 AS edited",
        "CASE l_linenumber % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'llm' ELSE 'local' END AS source",
    )


def audit(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        "event_id AS id",
        "ts",
        "event_type AS mode",
        "concat('provider', user_id % 5) AS provider",
        "concat('host', user_id, '.example.com') AS domain",
        "CAST(floor(value) AS BIGINT) AS char_count",
        "1 + event_id % 7 AS batches",
    )


def edits(t: Tables) -> DataFrame:
    """Every event is an edit of one of twenty boxes of the page user_id."""
    return t.events.selectExpr(
        "user_id AS page_id",
        "event_id AS seq",
        "ts",
        "CASE event_type WHEN 'view' THEN 'move' WHEN 'click' THEN 'update' WHEN 'signup' THEN 'add'"
        " WHEN 'purchase' THEN 'resize' ELSE 'remove' END AS op",
        "event_id % 20 AS target",
        "floor(value) AS amount",
    )


def dictionary(t: Tables) -> DataFrame:
    """Distinct lower-case words of length >= 4 of the benchmark texts."""
    w = t.benchmark.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    return w.where("length(word) >= 4").distinct()
