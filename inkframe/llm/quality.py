"""Quality classifier by importance resampling: the ratio of two hashed n-gram generative models,
target over raw text, weights every document; Gumbel top-k draws the documents to keep.

Features of a text are its words, its runs of four bytes (case and signs count) and a mark at each
word for whether it repeats the one before. All are hashed to BITS bits. The raw model counts every
document; the target model counts the labelled clean ones of a bounded sample. Counts are summed in
the tasks and again by cell, so a table of 2^BITS rows at most reaches the driver at any corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from inkframe.llm import text as T
from inkframe.llm.names import fresh
from inkframe.llm.select import kth_largest
from inkframe.session import cut

BITS = 18
#: Labelled rows in use, those with the lowest hashes; a bound, so they can be broadcast. The target model is
#: fitted on half of them and the cut is chosen on the other half, which the model has not seen.
MAX_LABELLED = 40_000
#: Log ratios within this of zero are taken for sampling noise.
NOISE = 1.0
#: Features added to each text's count, so very short texts are not judged by a single one.
PRIOR = 50
#: How many lost clean documents outweigh one more rejected document in the cut.
CLEAN_WEIGHT = 4.0
#: Gumbel noise in units of the distance between clean and rejected labelled documents.
TEMPERATURE = 0.01


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row) of all features of the texts."""
    raw, at = T.bytes_of(column)
    hashes, rows, _, _ = T.words(column)
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    marks = np.where(again, np.uint64(0x5BD1E9955BD1E995), np.uint64(0x2545F4914F6CDD1D))
    grams, owner = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    if len(raw) >= 4:
        wide = raw.astype(np.uint64)
        grams = wide[:-3]
        for j in (1, 2, 3):
            grams = (grams << np.uint64(8)) | wide[j : len(raw) - 3 + j]
        place = np.arange(len(grams))
        owner = np.repeat(np.arange(len(column)), np.diff(at))[: len(grams)]
        inside = place + 4 <= at[owner + 1]
        grams, owner = T.mix(grams[inside] + np.uint64(1)), owner[inside]
    cells = np.concatenate([hashes, marks, grams]) >> np.uint64(64 - BITS)
    return cells.astype(np.int64), np.concatenate([rows, rows, owner])


def labelled_sample(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, clean (0/1) and fit (whether the model may see it) of at most ``most`` labelled documents; contradicting rows count as not clean."""
    one = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("clean")
    )
    half = F.xxhash64("doc_id", F.lit("half")).bitwiseAND(F.lit(1)) == 1
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("fit", half)


def log_ratios(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """Shrunk log(p_target / p_raw) of each cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64)
        for batch in batches:
            clean = np.asarray(batch.column(1).to_numpy(zero_copy_only=False)) == 1
            for lo, hi in T.steps(batch.column(0)):
                cells, rows = features(batch.column(0).slice(lo, hi - lo))
                raw += np.bincount(cells, minlength=len(raw))
                target += np.bincount(cells[clean[lo:hi][rows]], minlength=len(raw))
        met = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(raw[met]), pa.array(target[met])], names=["cell", "raw", "target"])

    marked = _texts(docs).join(F.broadcast(sample), "doc_id", "left").select("text", (F.coalesce("clean", F.lit(0)) * F.coalesce("fit", F.lit(False)).cast("int")).alias("clean"))
    sums = marked.mapInArrow(count, "cell int, raw long, target long").groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r in sums.toArrow().to_batches():  # 2^BITS rows at most
        raw[r.column(0).to_numpy()], target[r.column(0).to_numpy()] = r.column(1).to_numpy(), r.column(2).to_numpy()
    if not target.sum():
        return np.zeros(1 << BITS)
    ratio = np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    return np.sign(ratio) * np.maximum(0, np.abs(ratio) - NOISE)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def with_weight(docs: DataFrame, ratios: np.ndarray, text: str = "text", name: str = "log_weight") -> DataFrame:
    """Add each text's log importance weight per feature; a null or empty text has 0."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # 2^BITS numbers
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(place).cast(pa.large_string()), np.zeros(len(batch))
            for lo, hi in T.steps(texts):
                cells, rows = features(texts.slice(lo, hi - lo))
                n = np.bincount(rows, minlength=hi - lo)
                out[lo:hi] = np.bincount(rows, weights=shared.value[cells], minlength=hi - lo) / (n + PRIOR)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def gumbel(key: Column, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def best_cut(scores: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """(cut, distance of the medians): the cut rejects most of the unclean for the clean it loses."""
    good, bad = np.sort(scores[clean]), np.sort(scores[~clean])
    if not len(good) or not len(bad):
        return -np.inf, 0.0
    edges = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([edges[:1], (edges[1:] + edges[:-1]) / 2])
    gain = np.searchsorted(bad, cuts) / len(bad) - CLEAN_WEIGHT * np.searchsorted(good, cuts) / len(good)
    return float(cuts[int(gain.argmax())]), float(np.median(good) - np.median(bad))


class Classifier:
    """Fitted on docs (doc_id, text, ...) and labels (doc_id, quality, toxic).

    k, the number of documents to draw, is the number whose weight passes the cut that divides the
    labelled sample best. Without labels of both kinds all documents pass.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, seed: int = 11):
        sample = cut(labelled_sample(labels))
        self.seed, self.ratios = seed, log_ratios(docs, sample)
        scored = cut(with_weight(_texts(docs), self.ratios).select("doc_id", "log_weight"))
        seen = scored.join(F.broadcast(sample.where("not fit")), "doc_id").groupBy("doc_id").agg(F.min("log_weight").alias("log_weight"), F.min("clean").alias("clean")).toArrow()  # no more rows than the sample
        scores, clean = seen["log_weight"].to_numpy(), seen["clean"].to_numpy() == 1
        self.cut, self.distance = best_cut(scores, clean)
        self.scored = scored.select("doc_id", "log_weight", self._key())
        self.k = scored.where(F.col("log_weight") >= self.cut).count()
        self.limit = kth_largest(self.scored, "key", self.k)

    def _key(self) -> Column:
        return (F.col("log_weight") + gumbel(F.col("doc_id"), self.seed) * (TEMPERATURE * max(0.0, self.distance))).alias("key")

    def report(self) -> DataFrame:
        """doc_id, log_weight, key and whether the document is drawn (keys equal to the k-th are)."""
        return self.scored.select("doc_id", "log_weight", "key", (F.col("key") >= self.limit).alias("kept"))

    def keep(self, docs: DataFrame) -> DataFrame:
        """The drawn rows of docs. Weights are computed again, which costs less than moving the texts."""
        text, weight, own = (fresh(docs, c) for c in ("text_string", "log_weight", "id_long"))
        out = with_weight(docs.withColumn(text, F.col("text").cast("string")), self.ratios, text, weight).withColumn(own, F.col("doc_id").cast("long"))
        key = F.col(weight) + gumbel(F.col(own), self.seed) * (TEMPERATURE * max(0.0, self.distance))
        return out.where(key >= self.limit).select(*docs.columns)
