"""One-permutation MinHash: each five-word shingle is hashed once, the hash's upper bits choose one of
BINS bins and every bin keeps its smallest hash. Empty bins borrow by optimal densification: bin j
tries the bins of a hash sequence of its own until one is not empty. Of each bin the low BITS bits are
stored; the share of equal bins less the share of chance hits estimates the Jaccard similarity.

DataFrame functions only, row by row: nothing is exploded and no shingle is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, BITS = 256, 8
#: Attempts of a bin's sequence tried one by one; then the non-empty bin of the smallest hash, which is the
#: next one of a random order of all bins.
ATTEMPTS = 8
_PRIME = 65_537
#: Rows of neighbouring ids that one task orders.
CHUNK_ROWS = 20_000

_SHIFT = 64 - 8
_EMPTY = (1 << _SHIFT) - 1  # a bin's largest hash stands for none
_NOT_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def _empty(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_EMPTY)) == F.lit(_EMPTY)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``, array<tinyint> of BINS values: the low bits of each bin, less 128.

    A word is a run of ASCII letters and digits or characters beyond ASCII, in lower case. A text of
    fewer than five words has one shingle; one without words has 127 in all bins.
    """
    t = lambda k: f"__{k}_{name}"
    keep = df.columns
    df = df.withColumn(t("h"), F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _NOT_WORD), ""), lambda w: F.xxhash64(w)))
    h, n = F.col(t("h")), F.size(t("h"))
    runs = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(5)]))
    df = df.withColumn(t("s"), F.when(n >= 5, runs).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>")))
    marks = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda b: F.shiftleft(b.cast("long"), _SHIFT) + F.lit(_EMPTY))
    df = df.withColumn(t("o"), F.sort_array(F.concat(t("s"), marks)))
    o = F.col(t("o"))
    df = df.withColumn(t("v"), F.filter(o, lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(o, i - 1), _SHIFT))))
    first = F.col(t("v"))
    now = first
    for a in range(ATTEMPTS):
        df = df.withColumn(t(f"d{a}"), F.when(F.exists(now, _empty), F.transform(now, _borrow(first, a))).otherwise(now))
        now = F.col(t(f"d{a}"))
    df = df.withColumn(t("e"), F.filter(first, lambda x: ~_empty(x)))
    df = df.withColumn(t("f"), F.when(F.exists(now, _empty) & (F.size(t("e")) > 0), F.transform(now, _nearest(F.col(t("e"))))).otherwise(now))
    return df.select(*keep, F.transform(t("f"), lambda x: (x.bitwiseAND(F.lit(255)) - 128).cast("tinyint")).alias(name))


def _borrow(first: Column, attempt: int):
    a, b = (7919 * (attempt + 1) * (attempt + 3)) % _PRIME, (104_729 * (attempt + 1)) % _PRIME
    return lambda x, j: F.when(_empty(x), F.get(first, ((j * F.lit(a) + F.lit(b)) % _PRIME) % BINS)).otherwise(x)


def _nearest(full: Column):
    def of(x: Column, j: Column) -> Column:
        placed = F.transform(full, lambda y: F.shiftleft(F.shiftright(F.xxhash64(j, F.shiftright(y, _SHIFT)), 16), 8) + y.bitwiseAND(F.lit(255)))
        return F.when(_empty(x), F.array_min(placed)).otherwise(x)

    return of


def likeness(a: Column, b: Column) -> Column:
    """Bias-corrected estimate of the shingles' Jaccard similarity, 0 to 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def packed(a: Column) -> Column:
    """The fingerprint as a string, two hex digits a bin."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x.cast("long") + 128), 2, "0")), ""))


def with_next(df: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """Add next_<column> of the row that follows by id (null ids first; the first row after the last one).

    Rows move once, to ranges of ids; the first row of each range then meets the range before it.
    Rows of the same id follow in the order of their columns.
    """
    spark = df.sparkSession
    key = F.coalesce(id_col, F.lit(None).cast("long"))
    lo, hi, n = df.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    lo, hi = lo or 0, hi or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(1, min(hi - lo + 1, max(4 * tasks, -(-n // CHUNK_ROWS))))
    width = -(-(hi - lo + 1) // chunks)
    rows = df.withColumn("__chunk", F.when(key.isNull(), F.lit(-1)).otherwise(F.floor((key - lo) / width)))
    order = [F.col(id_col).asc_nulls_first(), *[F.col(c) for c in columns]]
    local = Window.partitionBy("__chunk").orderBy(*order)
    after = F.struct(*columns)
    rows = rows.withColumns({"__next": F.lead(after).over(local), "__n": F.row_number().over(local)})
    heads = rows.where("__n = 1").select("__chunk", after.alias("__head"))  # reads the same shuffled rows
    ids = rows.select("__chunk").distinct()
    along = Window.orderBy("__chunk")  # one row a range
    follow = ids.select("__chunk", F.coalesce(F.lead("__chunk").over(along), F.min("__chunk").over(Window.partitionBy())).alias("__follow"))
    heads = follow.join(heads.withColumnRenamed("__chunk", "__follow"), "__follow").select("__chunk", "__head")
    joined = rows.join(heads, "__chunk").withColumn("__next", F.coalesce("__next", "__head"))
    return joined.select(*df.columns, *[F.col("__next")[c].alias(f"next_{c}") for c in columns])


def report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness.

    The edited text ends in the first code points of the next document instead of its own last half.
    A null text counts as empty; two texts without words are alike (1.0). Repeated rows are rows of
    their own. An empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = with_next(with_fingerprint(own, "text", "fp"), ["text", "fp"])
    half = F.floor(F.length("text") / 2).cast("int")
    own = own.withColumn("edited", F.concat(F.left("text", F.length("text") - half), F.left("next_text", half)))
    own = own.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fp", "next_fp", "edited")
    own = with_fingerprint(own, "edited", "fe")
    return own.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("fp")).alias("fingerprint"), packed(F.col("fe")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("fe")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
