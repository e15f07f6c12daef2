"""Mixing sources to target weights with a low-discrepancy schedule over equal-token blocks.

DataFrame operations only. Each source's documents form a shuffled stream of words that is cut
into blocks of equal size. Slot t of the schedule is the point t * golden ratio (mod 1), as an
integer lattice; cumulative weights map it to a source, and its rank among the source's slots names
the block it takes, from the start again when all blocks are used. Slots beyond a source's target
stay unused and the few that the schedule lacks follow at its end, so targets are met to a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.operators.ordered import in_order
from inkframe.session import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 1024
#: The lattice: 2^31 points, a step near the golden ratio's share of them (odd, so all are met).
POINTS, STEP = 1 << 31, 1_327_217_885
#: Slots that one task ranks.
RANKED_SLOTS = 1 << 18


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stream_rows(docs: DataFrame) -> DataFrame:
    """One narrow row per document: doc_id, source, size and a checksum that orders repeated ids."""
    return docs.select(*[c.alias(k) for k, c in _key_columns(docs).items()])


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target: weights by rank of the source (code point order, null last) share
    ratio x all sizes; what exceeds most x a source's size goes to the others by weight.

    Filled like water: with the sources in order of how soon they are full, the level is the largest
    one that any prefix of full sources leaves. One row per source, ordered in one task.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (place % len(weights) + 1).cast("int"))
    full = F.col("source_size") * most
    sums = sums.withColumn("w", w).withColumn("fills", full / F.col("w"))
    before = Window.orderBy("fills", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) * F.lit(ratio) - F.coalesce(F.sum(full).over(before), F.lit(0))
    level = left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    sums = sums.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    return sums.select("source", "source_size", F.least(full.cast("double"), F.col("w") * F.col("level")).alias("target"))


def block_plan(targets: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Add goal (words to take), blocks (of the stream), needed (blocks to take) and the source's
    part lo..hi of the lattice."""
    size, goal = F.col("source_size"), F.round("target").cast("long")
    plan = targets.withColumn("goal", goal).withColumn("blocks", F.ceil(size / block))
    rest = F.when(size > 0, F.col("goal") % size).otherwise(F.lit(0))
    turns = F.when(size > 0, F.floor(F.col("goal") / size)).otherwise(F.lit(0))
    plan = plan.withColumn("needed", (turns * F.col("blocks") + F.ceil(rest / block)).cast("long"))
    order = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = F.sum("needed").over(order) / F.sum("needed").over(Window.partitionBy())
    plan = plan.withColumn("hi", F.coalesce(F.floor(part * POINTS), F.lit(0)))
    first = Window.orderBy(F.col("source").asc_nulls_last())
    return plan.withColumn("lo", F.coalesce(F.lag("hi").over(first), F.lit(0)))


def schedule(plan: DataFrame) -> DataFrame:
    """(slot, source, turn, block): slot order is the order of the mix."""
    spark = plan.sparkSession
    total = plan.agg(F.sum("needed")).first()[0] or 0
    grid = 4096  # points and parts meet by cell, as an equi-join
    cell = POINTS // grid
    point = (F.col("slot") % POINTS) * STEP % POINTS
    slots = spark.range(total).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("cell", F.floor(F.col("point") / cell))
    parts = plan.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))))
    met = slots.join(parts, "cell").where("point >= lo and point < hi").select("slot", "source")
    ranked = in_order(met, ["source"], ["slot"], F.floor(F.col("slot") / RANKED_SLOTS), number="rank")
    got = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("got"))
    own = plan.select(F.col("source").alias("s"), "needed", "blocks")
    used = ranked.join(own, F.col("source").eqNullSafe(F.col("s"))).where("rank <= needed").select("slot", "source", "rank", "blocks")
    late = own.join(got, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < needed")
    late = late.select((F.lit(total) + F.col("needed")).alias("slot"), F.col("s").alias("source"), F.explode(F.sequence(F.col("got") + 1, F.col("needed"))).alias("rank"), "blocks")
    turn = F.floor((F.col("rank") - 1) / F.col("blocks"))
    return used.union(late).select("slot", "source", turn.alias("turn"), (F.col("rank") - 1 - turn * F.col("blocks")).alias("block"))


def shares(rows: DataFrame, plan: DataFrame, seed: int = 7, block: int = BLOCK_WORDS) -> DataFrame:
    """Words that the mix takes of each row: rows(__row, doc_id, source, size, crc) -> (__row, turn, words).

    Joins the schedule with the documents' pieces by source and block. A turn takes whole documents,
    but for the one at which a source's target is reached: of that, its first words.
    """
    mixed = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    stream = rows.where("size > 0").withColumn("h", mixed)
    chunk = F.conv(F.substring("h", 1, 3), 16, 10).cast("int")
    stream = in_order(stream, ["source"], ["h", "crc", "size", "__row"], chunk, sums={"upto": F.col("size")})
    start = F.col("upto") - F.col("size")
    pieces = stream.select(
        "__row", "source", start.alias("start"), "upto",
        F.explode(F.sequence(F.floor(start / block), F.floor((F.col("upto") - 1) / block))).alias("block"),
    )
    goals = plan.select(F.col("source").alias("s"), "source_size", "goal")
    slots = schedule(plan).join(goals, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), F.col("block").alias("b"), "turn", (F.col("goal") - F.col("turn") * F.col("source_size")).alias("room")
    )
    held = F.least("upto", (F.col("block") + 1) * block, "room") - F.greatest("start", F.col("block") * block)
    met = pieces.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).withColumn("words", held)
    return met.where("words > 0").groupBy("__row", "turn").agg(F.sum("words").alias("words"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and the words taken, for every document.

    Null texts and texts without words have size 0 and nothing is taken of them. Null sources are one
    source. Repeated rows are rows of their own. An empty table gives no rows.
    """
    rows = cut(stream_rows(docs).withColumn("__row", F.monotonically_increasing_id()))
    plan = cut(block_plan(source_targets(rows)))
    taken = shares(rows, plan, **options).groupBy("__row").agg(F.sum("words").alias("taken"))
    own = plan.select(F.col("source").alias("s"), "source_size", "target")
    out = rows.join(taken, "__row", "left").join(own, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus, in the columns of docs: a document once for each turn that takes it.

    Where a source's target ends inside a document, that copy keeps its first words only. A column
    n_chars follows the text. Rows that nothing is taken of are left out.
    """
    key = ["doc_id", "source", "crc", "size"]
    rows = cut(stream_rows(docs).withColumn("__row", F.monotonically_increasing_id()))
    plan = cut(block_plan(source_targets(rows)))
    taken = shares(rows, plan, **options)
    same = lambda order: F.row_number().over(Window.partitionBy(*key).orderBy(order))
    taken = rows.join(taken, "__row").groupBy("__row", *key).agg(F.collect_list("words").alias("__takes"))  # at most one per turn
    rank = rows.withColumn("__n", same("__row"))
    taken = rank.join(taken.select("__row", "__takes"), "__row").select(*[F.col(k).alias(f"__{k}") for k in key], F.col("__n").alias("__m"), "__takes")
    full = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__doc"), *[column.alias(f"__k_{k}") for k, column in _key_columns(docs).items()])
    full = full.withColumn("__n", F.row_number().over(Window.partitionBy(*[f"__k_{k}" for k in key]).orderBy(F.lit(0))))
    on = F.col("__n") == F.col("__m")
    for k in key:
        on = on & F.col(f"__k_{k}").eqNullSafe(F.col(f"__{k}"))
    out = full.join(taken, on).select("__doc", "__k_size", F.explode("__takes").alias("__words"))
    pieces = F.regexp_extract_all(F.col("__doc.text").cast("string"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("__words") >= F.col("__k_size"), F.col("__doc.text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col("__words").cast("int")), ""))
    out = out.withColumn("__text", text)
    named = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return out.select(*[named.get(c, F.col("__doc")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def _key_columns(docs: DataFrame) -> dict[str, Column]:
    text = F.col("text").cast("string")
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return {"doc_id": F.col("doc_id").cast("long"), "source": source, "crc": F.crc32(F.coalesce(text, F.lit(""))), "size": word_count(text)}
