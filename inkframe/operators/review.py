"""Patches, review queues, cost, batching and caching around recognition results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.constants import BATCH_SIZE, CONFIDENCE_THRESHOLD, COST_PER_100
from inkframe.operators.ordered import in_order


def user_locked(edited="edited", source="source", text="text") -> Column:
    """Boxes a person has confirmed; nothing automatic may overwrite them."""
    return F.coalesce(F.col(edited) | ((F.col(source) == "manual") & (F.coalesce(F.length(F.col(text)), F.lit(0)) > 0)), F.lit(False))


def apply_patch(base: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join by key; a patched row takes every patch column, nulls included."""
    cols = [c for c in patch.columns if c not in keys]
    p = patch.select(*keys, F.struct(*cols).alias("__p"))
    j = base.join(p, list(keys), "left")
    hit = F.col("__p").isNotNull()
    return j.withColumns({c: F.when(hit, F.col(f"__p.{c}")).otherwise(F.col(c)) if c in base.columns else F.col(f"__p.{c}") for c in cols}).drop("__p")


def needs_review() -> Column:
    return (F.col("conf") < CONFIDENCE_THRESHOLD) | F.col("note").isin("split", "merge", "spacing")


def review_queue(glyphs: DataFrame, keys: Sequence[str], order: str = "glyph_id", limit: int | None = None) -> DataFrame:
    """Glyphs to look at; with ``limit`` the first ones per page (cut before the shuffle by rank)."""
    queue = glyphs.where(needs_review())
    if limit is None:
        return queue
    w = Window.partitionBy(*keys).orderBy(order)
    return queue.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def cap_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def check_conservation(expected: DataFrame, received: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: count equal and every id 0..n-1 seen. ``expected``: keys, n; ``received``: keys, id.

    Ids are counted as a distinct count inside the range, so no id list is built.
    """
    r = received.join(expected, list(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("received"), F.count_distinct(F.when((F.col("id") >= 0) & (F.col("id") < F.col("n")), F.col("id"))).alias("covered")
    )
    return expected.join(r, list(keys), "left").select(
        *keys, "n", F.coalesce("received", F.lit(0)).alias("received"), (F.col("n") - F.coalesce("covered", F.lit(0))).alias("missing"),
        ((F.coalesce("received", F.lit(0)) == F.col("n")) & (F.coalesce("covered", F.lit(0)) == F.col("n"))).alias("complete"),
    )


def provider_rate(provider: Column) -> Column:
    pairs = [F.lit(x) for kv in COST_PER_100.items() for x in kv]
    return F.element_at(F.create_map(*pairs), provider)


def usage_rollup(batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cost of batches by provider rate per started 100 characters."""
    cost = F.ceil(F.col("chars") / 100) * provider_rate(F.col("provider"))
    return batches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("batches"), F.sum("chars").alias("chars"), F.sum(F.ceil(F.col("chars") / 100)).alias("units"), F.sum(cost).alias("cost")
    )


def make_batches(df: DataFrame, keys: Sequence[str], order: Sequence[str], item: str, chunk: Column, size: int = BATCH_SIZE, seed: int = 7) -> DataFrame:
    """Cut the items of a key, in order, into batches and show each batch in a seeded, repeatable shuffle.

    Adds batch, slot (place in order) and display (place shown); display is a bijection on 0..size-1
    of its batch, so it can be turned back. A batch never exceeds ``size`` rows.
    """
    rows = in_order(df, keys, order, chunk, number="__n")
    rows = rows.withColumns({"batch": F.expr(f"(__n - 1) div {size}"), "slot": F.expr(f"(__n - 1) % {size}")}).drop("__n")
    mixed = scramble(F.col(item), seed)
    w = Window.partitionBy(*keys, "batch").orderBy(mixed, item)
    return rows.withColumn("display", F.row_number().over(w) - 1)


def scramble(c: Column, seed: int) -> Column:
    """Cheap repeatable mixing of an integer id (also expressible in plain SQL)."""
    return ((c + seed) * 7919 + 104729) % 1000003


def budget_admit(batches: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, estimate: str, budget: Column, rounds: int = 3) -> DataFrame:
    """Admit batches in order while spend so far plus ``rounds`` x estimate fits; the first refusal stops all later ones.

    Before the first refusal everything was admitted, so spend is a running sum over all earlier
    rows and the refusal is the first row where it no longer fits.
    """
    run = in_order(batches, keys, order, chunk, number="__n", sums={"__spent": F.col(estimate) * rounds})
    fits = F.col("__spent") <= budget
    first = F.min(F.when(~fits, F.col("__n")))
    if keys:
        out = run.join(run.groupBy(*keys).agg(first.alias("__stop")), list(keys), "left")
    else:
        out = run.withColumn("__stop", run.agg(first).scalar())
    admitted = F.col("__stop").isNull() | (F.col("__n") < F.col("__stop"))
    return out.withColumn("admitted", admitted).drop("__n", "__spent", "__stop")


def downgrade(items: DataFrame, failed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items of failed batches keep a local guess at confidence 0, for a person to check."""
    j = items.join(failed.select(*keys).distinct().withColumn("__f", F.lit(True)), list(keys), "left")
    f = F.col("__f").isNotNull()
    return j.withColumns(
        {
            "conf": F.when(f, 0.0).otherwise(F.col("conf")),
            "note": F.when(f, F.when(F.coalesce(F.length("text"), F.lit(0)) > 0, "blurry").otherwise("empty")).otherwise(F.col("note")),
            "source": F.when(f, "local").otherwise(F.col("source")),
        }
    ).drop("__f")


def cache_lookup(requests: DataFrame, cache: DataFrame, key: str = "key", created: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """(hits with the newest stored answer, misses)."""
    fields = [c for c in cache.columns if c != key]
    newest = cache.groupBy(key).agg(F.max_by(F.struct(*fields), created).alias("stored"))
    return requests.join(newest, key), requests.join(newest.select(key), key, "left_anti")


def cache_upsert(cache: DataFrame, fresh: DataFrame, key: str = "key", created: str = "created_at") -> DataFrame:
    fields = [c for c in cache.columns if c != key]
    both = cache.unionByName(fresh.select(*cache.columns))
    out = both.groupBy(key).agg(F.max_by(F.struct(*fields), created).alias("s"))
    return out.select(key, *[F.col(f"s.{c}").alias(c) for c in fields])


def bypass_known(glyphs: DataFrame, recalled: DataFrame, key: str = "glyph_id") -> tuple[DataFrame, DataFrame]:
    """(answers settled without recognition, glyphs still to recognise).

    Page numbers confirmed by a person are kept at >= .99; glyphs remembered from two or more manual
    confirmations take the remembered text.
    """
    protected = (F.col("grp") == "pageno") & F.col("edited") & (F.coalesce(F.length("text"), F.lit(0)) > 0)
    kept = glyphs.where(protected).select(key, "text", F.greatest("conf", F.lit(0.99)).alias("conf"), F.lit("manual").alias("source"))
    open_ = glyphs.where(~F.coalesce(protected, F.lit(False)))
    sure = recalled.where("manual >= 2").select(key, F.col("char").alias("text"), F.col("confidence").alias("conf"), F.lit("local").alias("source"))
    known = sure.join(open_.select(key), key, "left_semi")
    return kept.unionByName(known), open_.join(known.select(key), key, "left_anti")


def restore_notes(result: DataFrame, segmented: DataFrame, key: str = "glyph_id") -> DataFrame:
    """Put the segmentation note back and keep such glyphs below the review threshold."""
    n = segmented.where(F.col("note").isin("split", "merge", "spacing")).select(key, F.col("note").alias("__n"))
    j = result.join(n, key, "left")
    return j.withColumns(
        {
            "conf": F.when(F.col("__n").isNotNull(), F.least("conf", F.lit(CONFIDENCE_THRESHOLD - 0.01))).otherwise(F.col("conf")),
            "note": F.coalesce("__n", "note"),
        }
    ).drop("__n")
