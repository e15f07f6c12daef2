"""K-d tree sharding: split at exact weighted medians along the widest metadata dimension.

DataFrame operations only. The texts are read once, for their sizes and checksums; all splitting
works on one narrow row per document. The median of every node of a level is found at the same
time by narrowing an interval of key values: one map-side-combined histogram per step, with at
most ``nodes x BINS`` rows for the driver. Rows are never sorted for it and no node is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.operators.ordered import in_order
from inkframe.session import cut

BINS = 1024
#: Rows that one task numbers inside a shard.
NUMBERED_ROWS = 100_000


def text_code(column: Column) -> Column:
    """The first seven bytes of a string as a number in the same order; null is -1."""
    head = F.rpad(F.substring(F.hex(column.cast("string")), 1, 14), 14, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("long"), F.lit(-1).cast("long"))


def document_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the dimensions d0.. of each document (size, source, lang, doc_id).

    Missing source or lang columns count as null.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = lambda c: text_code(F.col(c)) if c in docs.columns else F.lit(-1).cast("long")
    size = (F.octet_length(text) + 16).cast("long")
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"),
        size.alias("d0"), named("source").alias("d1"), named("lang").alias("d2"), own.alias("d3"),
    )


def kd_shards(rows: DataFrame, shards: int, dims: list[str], weight: str = "size", tie: str = "d3") -> DataFrame:
    """Add ``shard`` 0..shards-1 so that the shards' weights are near equal.

    A node that has to give m shards is split at the m//2 : m-m//2 weighted quantile of its widest
    dimension (range over the whole table's range; the earlier dimension on a tie). Rows of the same
    value are split by ``tie`` and then by an id of the row, so equal rows and a value that most rows
    share are no obstacle. dims, weight and tie are non-null longs, weight is positive. Fewer rows
    than shards leave shards empty; an empty table returns no rows.
    """
    rows = cut(rows.withColumns({"__row": F.monotonically_increasing_id(), "__at": F.lit(0), "__m": F.lit(shards)}))
    whole = rows.agg(*[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).first()
    while True:
        stats = rows.where("__m > 1").groupBy("__at", "__m").agg(
            F.sum(weight).alias("w"), *[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]
        ).collect()  # at most one row per shard
        if not stats:
            return rows.withColumnRenamed("__at", "shard").drop("__row", "__m")
        nodes = {}
        for s in stats:
            wide = [(s[f"hi_{d}"] - s[f"lo_{d}"]) / max(1, whole[f"hi_{d}"] - whole[f"lo_{d}"]) for d in dims]
            nodes[s["__at"]] = {"dim": wide.index(max(wide)), "left": s["__m"] // 2, "m": s["__m"], "goal": s["w"] * (s["__m"] // 2) / s["__m"]}
        rows = cut(_split(rows, nodes, dims, weight, tie, shards))


def _split(rows: DataFrame, nodes: dict, dims: list[str], weight: str, tie: str, shards: int) -> DataFrame:
    at = F.col("__at")
    by_node = lambda f, kind="long": F.element_at(F.array(*[F.lit(f(nodes[i]) if i in nodes else 0).cast(kind) for i in range(shards)]), at + 1)
    rows = rows.withColumn("__key", F.element_at(F.array(*dims), F.greatest(F.lit(1), by_node(lambda n: n["dim"] + 1, "int"))))
    left, right, still = F.lit(False), F.lit(False), F.col("__m") > 1
    for phase, key in enumerate(("__key", tie, "__row")):
        values = _crossing(rows.where(still), key, nodes, by_node, weight)
        if phase == 2:  # the row that holds the median goes to the side of its middle
            for i, n in nodes.items():
                n["cut"] = values[i][0] if 2 * values[i][1] + values[i][2] <= 2 * n["goal"] else values[i][0] - 1
            left = left | (still & (F.col(key) <= by_node(lambda n: n["cut"])))
        else:
            for i, n in nodes.items():
                n["cut"], before, _ = values[i]
                n["goal"] -= before
            left = left | (still & (F.col(key) < by_node(lambda n: n["cut"])))
            still = still & (F.col(key) == by_node(lambda n: n["cut"]))
    inner = F.col("__m") > 1
    half = by_node(lambda n: n["left"], "int")
    return rows.withColumns({
        "__at": F.when(inner & ~left, at + half).otherwise(at),
        "__m": F.when(~inner, F.col("__m")).when(left, half).otherwise(F.col("__m") - half),
    }).drop("__key")


def _crossing(rows: DataFrame, key: str, nodes: dict, by_node, weight: str) -> dict:
    """By node: the value of key at which the running weight reaches the goal, the weight before it, and its own."""
    found: dict = {}
    open_ = {r["__at"]: (r["lo"], r["hi"], 0) for r in rows.groupBy("__at").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
    while open_:
        for i, n in nodes.items():
            n["lo"], n["hi"] = open_[i][:2] if i in open_ else (1, 0)
            n["step"] = max(1, -(-(n["hi"] - n["lo"] + 1) // BINS))
        lo, hi = by_node(lambda n: n["lo"]), by_node(lambda n: n["hi"])
        inside = rows.where(F.col(key).between(lo, hi))
        bins = inside.groupBy("__at", F.floor((F.col(key) - lo) / by_node(lambda n: n["step"])).alias("b")).agg(
            F.sum(weight).alias("w"), F.min(key).alias("lo"), F.max(key).alias("hi")
        ).collect()  # at most BINS rows a node
        now, open_ = open_, {}
        for i, (_, _, before) in now.items():
            own = sorted((b for b in bins if b["__at"] == i), key=lambda b: b["lo"])
            for k, b in enumerate(own):
                if before + b["w"] >= nodes[i]["goal"] or k == len(own) - 1:
                    if b["lo"] == b["hi"]:
                        found[i] = (b["lo"], before, b["w"])
                    else:
                        open_[i] = (b["lo"], b["hi"], before)
                    break
                before += b["w"]
    return found


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Every document with its shard and its slot there (gapless from 0, by doc_id; null ids first).

    Null texts have size 16 and the checksum of an empty text. Repeated rows are rows of their own.
    """
    dims = ["d0", "d1", "d2", "d3"]
    rows = cut(kd_shards(document_rows(docs), shards, dims).withColumn("__row", F.monotonically_increasing_id()))
    n, lo, hi = rows.agg(F.count(F.lit(1)), F.min("d3"), F.max("d3")).first()
    chunks = max(1, -(-n // (shards * NUMBERED_ROWS)))
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // chunks))
    placed = in_order(rows, ["shard"], ["d3", "text_crc32", "__row"], F.floor((F.col("d3") - (lo or 0)) / width), number="slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("slot") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
