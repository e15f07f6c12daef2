"""Exact BM25 top-k by block-max WAND over a sharded inverted index.

Each task that reads documents builds the index of its own shards (SHARD_DOCS documents at most): a
row of the shard with its documents, lengths, postings and counts, and a row per term with the number
of its documents. The index is a table in the shared folder. Document frequencies, number and mean
length of documents come from all shards, so scores of different shards compare. All words of a query
count. Queries go in passes of QUERY_TERMS words, which bounds what is broadcast; a pass streams the
shards, and a task carries the k best of each query from shard to shard as the limit that a block's
bound has to reach.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkframe.llm import text as T
from inkframe.session import ensure_checkpoint_dir

K1, B = 1.2, 0.75
SHARD_DOCS = 8192
BLOCK = 64
#: Words of the queries of one pass over the index.
QUERY_TERMS = 2_000_000
#: Queries of more words are scored by whole blocks instead of document by document.
WAND_TERMS = 8
_NO_ID = -(1 << 63)
_PACKED = ["ids", "lengths", "terms", "ends", "docs", "counts"]


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    folder = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def build_index(docs: DataFrame) -> DataFrame:
    """(shard, term, n, words, ids, lengths, terms, ends, docs, counts). A row with a term has only its n
    documents. Row term null of a shard: ids (int64) and lengths (int32) of its n documents, how many words
    they have, its terms (int64) in order, where the postings of each end (int32), and of all postings the
    documents' places (uint16) and counts (uint32), each as bytes.

    Documents without words are listed and match nothing; a shard orders its documents by id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k, held, size = TaskContext.get().partitionId() << 24, 0, [], 0
        for batch in batches:
            for lo, hi in T.steps(batch.column(1)):
                for a in range(lo, hi, SHARD_DOCS):
                    part = slice(a, min(hi, a + SHARD_DOCS))
                    hashes, rows, _, _ = T.words(batch.column(1).slice(a, part.stop - a))
                    if size + part.stop - a > SHARD_DOCS:
                        yield from _shard(base + k, held)
                        k, held, size = k + 1, [], 0
                    ids = [_NO_ID if x is None else x for x in batch.column(0).slice(a, part.stop - a).to_pylist()]
                    held.append((np.array(ids, dtype=np.int64), np.bincount(rows, minlength=len(ids)), *T.counted(hashes, rows)))
                    size += part.stop - a
        if held:
            yield from _shard(base + k, held)

    return written(_own(docs).mapInArrow(run, f"shard long, term long, n long, words long, {', '.join(f'{c} binary' for c in _PACKED)}"))


def _shard(shard: int, held: list) -> Iterator[pa.RecordBatch]:
    ids, lengths = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    start = np.cumsum([0, *[len(h[0]) for h in held]])
    terms, rows, counts = np.concatenate([h[2] for h in held]), np.concatenate([h[3] + s for h, s in zip(held, start, strict=False)]), np.concatenate([h[4] for h in held])
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), dtype=np.uint16)
    place[order] = np.arange(len(ids))
    terms = terms.view(np.int64)
    by = np.lexsort((place[rows], terms))
    terms, docs, counts = terms[by], place[rows][by], counts[by].astype(np.uint32)
    edge = np.append(np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, dtype=np.int64), len(terms))
    known, m = terms[edge[:-1]], len(edge) - 1
    names = ["shard", "term", "n", "words", *_PACKED]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, shard)), pa.array(known), pa.array(np.diff(edge)), pa.nulls(m, pa.int64()), *[pa.nulls(m, pa.binary()) for _ in _PACKED]], names=names)
    packed = [ids[order], lengths[order].astype(np.int32), known, edge[1:].astype(np.int32), docs, counts]
    yield pa.RecordBatch.from_arrays(
        [pa.array([shard]), pa.array([None], type=pa.int64()), pa.array([len(ids)]), pa.array([int(lengths.sum())]), *[pa.array([x.tobytes()], type=pa.binary()) for x in packed]], names=names
    )


def query_terms(docs: DataFrame) -> DataFrame:
    """(query, term): the distinct words of each document that serves as a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in T.steps(batch.column(1)):
                hashes, rows, _ = T.counted(*T.words(batch.column(1).slice(lo, hi - lo))[:2])
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).slice(lo, hi - lo).to_numpy()[rows]), pa.array(hashes.view(np.int64))], names=["query", "term"])

    return _own(docs).where("doc_id is not null").mapInArrow(run, "query long, term long").distinct()


def rarest_terms(terms: DataFrame, frequencies: DataFrame, most: int) -> DataFrame:
    """Of each query the ``most`` terms that fewest documents have, but at least two (ties by hash)."""
    known = terms.join(frequencies.where("df > 1"), "term")
    order = Window.partitionBy("query").orderBy("df", "term")
    return known.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


class Postings:
    """One term in one shard, with a cursor."""

    def __init__(self, docs: np.ndarray, scores: np.ndarray, bounds: np.ndarray):
        self.docs, self.scores, self.bounds = docs.tolist(), scores.tolist(), bounds.tolist()
        self.bound, self.at, self.doc = max(self.bounds), 0, self.docs[0]

    def seek(self, doc: int) -> None:
        """To the first posting at or after doc, whole blocks at a time."""
        docs, at, n = self.docs, self.at, len(self.docs)
        while (end := at - at % BLOCK + BLOCK) < n and docs[end] <= doc:
            at = end
        while at < n and docs[at] < doc:
            at += 1
        self.at, self.doc = at, docs[at] if at < n else 1 << 30

    def shallow(self, doc: int) -> tuple[float, int]:
        """Bound of the block in which doc would stand, and the block's last document."""
        b, n = self.at // BLOCK, len(self.docs)
        while (b + 1) * BLOCK < n and self.docs[(b + 1) * BLOCK - 1] < doc:
            b += 1
        last = min(n, (b + 1) * BLOCK) - 1
        return (self.bounds[b], self.docs[last]) if self.docs[last] >= doc else (0.0, 1 << 30)


def block_max_wand(lists: list[Postings], k: int) -> list[tuple[float, int]]:
    """The k best (score, doc), equal scores by smaller doc. lists stand in the order in which scores are added."""
    best: list[tuple[float, int]] = []  # least first; of equal scores the larger doc is least
    limit, end = -1.0, 1 << 30
    slack = 1e-9  # bounds are added in another order than scores
    while True:
        live = sorted((p for p in lists if p.doc < end), key=lambda p: p.doc)
        total, pivot = 0.0, -1
        for i, p in enumerate(live):
            total += p.bound
            if total + slack > limit:
                pivot = i
                break
        if pivot < 0:
            return sorted(((s, -d) for s, d in best), key=lambda x: (-x[0], x[1]))
        doc = live[pivot].doc
        while pivot + 1 < len(live) and live[pivot + 1].doc == doc:
            pivot += 1
        blocks = [p.shallow(doc) for p in live[: pivot + 1]]
        if sum(b for b, _ in blocks) + slack <= limit:  # nothing before the nearest border can enter
            border = min(min(last for _, last in blocks) + 1, live[pivot + 1].doc if pivot + 1 < len(live) else end)
            for p in live[: pivot + 1]:
                p.seek(max(border, doc + 1))
        elif live[0].doc == doc:
            score = 0.0
            for p in lists:
                if p.doc == doc:
                    score += p.scores[p.at]
            entry = (score, -doc)
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
            limit = best[0][0] if len(best) == k else -1.0
            for p in live[: pivot + 1]:
                p.seek(doc + 1)
        else:
            for p in live[:pivot]:
                if p.doc < doc:
                    p.seek(doc)


class Shard:
    """Postings of a shard with their shares of a score (without idf), and the largest share in each block.

    Block b has the documents at the places from b * BLOCK on.
    """

    def __init__(self, row: dict, mean: float):
        self.ids, lengths = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["lengths"], dtype=np.int32)
        self.terms, counts = np.frombuffer(row["terms"], dtype=np.int64), np.frombuffer(row["counts"], dtype=np.uint32).astype(float)
        self.edge = np.append(0, np.frombuffer(row["ends"], dtype=np.int32)).astype(np.int64)
        self.docs = np.frombuffer(row["docs"], dtype=np.uint16).astype(np.int64)
        self.shares = counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths[self.docs] / mean))
        new = np.diff(self.docs // BLOCK, prepend=-1) != 0
        new[self.edge[:-1]] = True
        first = np.flatnonzero(new)
        self.blocks, self.highs = self.docs[first] // BLOCK, np.maximum.reduceat(self.shares, first) if len(first) else self.shares
        self.block_edge = np.searchsorted(first, self.edge)

    def best(self, at: np.ndarray, idf: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """(scores, places) of a query's documents that may be among the k best, given places of its terms; none
        that scores limit or more is left out, unless k of this shard stand before it."""
        if len(at) <= WAND_TERMS:
            found = block_max_wand([self.postings(t, w) for t, w in zip(at.tolist(), idf.tolist(), strict=True)], k)
            return np.array([s for s, _ in found]), np.array([d for _, d in found], dtype=np.int64)
        lo, hi = self.edge[at].tolist(), self.edge[at + 1].tolist()
        docs = np.concatenate([self.docs[a:b] for a, b in zip(lo, hi, strict=True)])
        keep = None
        if limit > 0:
            first, end = self.block_edge[at].tolist(), self.block_edge[at + 1].tolist()
            bounds = np.concatenate([self.highs[a:b] for a, b in zip(first, end, strict=True)]) * np.repeat(idf, np.subtract(end, first))
            bound = np.bincount(np.concatenate([self.blocks[a:b] for a, b in zip(first, end, strict=True)]), bounds)
            open_ = bound + 1e-9 >= limit  # bounds are added as scores are, of shares that are no smaller
            if not open_.any():
                return np.zeros(0), np.zeros(0, dtype=np.int64)
            if open_.mean() < 0.5:
                keep = open_[docs // BLOCK]
        parts = np.concatenate([self.shares[a:b] for a, b in zip(lo, hi, strict=True)]) * np.repeat(idf, np.subtract(hi, lo))
        scores = np.bincount(docs, parts) if keep is None else np.bincount(docs[keep], parts[keep])
        if limit <= 0 and len(scores) > k:
            limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero((scores >= limit) & (scores > 0))
        return scores[places], places

    def postings(self, t: int, idf: float) -> Postings:
        docs, scores = self.docs[self.edge[t] : self.edge[t + 1]], idf * self.shares[self.edge[t] : self.edge[t + 1]]
        return Postings(docs, scores, np.maximum.reduceat(scores, np.arange(0, len(docs), BLOCK)))


def _answer(k: int, mean: float, asked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, edge, terms, idf = asked.value
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for j in range(len(batch)):
                shard = Shard({c: batch.column(i)[j].as_buffer() for i, c in enumerate(_PACKED)}, mean)
                if not len(shard.terms):
                    continue
                place = np.minimum(np.searchsorted(shard.terms, terms), len(shard.terms) - 1)
                known = shard.terms[place] == terms
                for q in range(len(queries)):
                    own = slice(edge[q], edge[q + 1])
                    met = known[own]
                    if not met.any():
                        continue
                    scores, ids = held.get(q, (np.zeros(0), np.zeros(0, dtype=np.int64)))
                    more, places = shard.best(place[own][met], idf[own][met], k, scores[-1] if len(scores) == k else 0.0)
                    if len(more):
                        scores, ids = np.append(scores, more), np.append(ids, shard.ids[places])
                        order = np.lexsort((ids, -scores))[:k]
                        held[q] = scores[order], ids[order]
        for q, (scores, ids) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), queries[q])), pa.array(ids), pa.array(scores)], names=["query", "doc_id", "score"])

    return run


def search(index: DataFrame, terms: DataFrame, k: int, most_terms: int | None = None) -> DataFrame:
    """(query, rank, doc_id, score): the k best documents of each query by BM25, equal scores by smaller id.

    All terms(query, term) count, or of each query the rarest most_terms that two documents have, if the
    caller wants fewer. Queries none of whose terms stands in a document have no rows. Null ids come back as null.
    """
    spark = index.sparkSession
    tables = index.where("term is null")
    frequencies = index.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    n, words = tables.agg(F.sum("n"), F.sum("words")).first()
    n, mean = n or 0, max(1.0, (words or 0) / max(1, n or 0))
    chosen = terms.join(frequencies, "term") if most_terms is None else rarest_terms(terms, frequencies, most_terms)
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = written(chosen.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("term", idf.alias("idf")))).alias("t")).select("query", "t.term", "t.idf"))
    passes = max(1, -(-(asked.agg(F.sum(F.size("term"))).first()[0] or 0) // QUERY_TERMS))
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid4().hex}"
    parts = tables.select(*_PACKED).coalesce(2 * spark.sparkContext.defaultParallelism)  # bounds the rows that come out
    for p in range(passes):
        block = asked.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == p).toArrow()  # about QUERY_TERMS words
        term, weight = (block[c].combine_chunks() for c in ("term", "idf"))
        edge = np.append(0, np.cumsum(pc.list_value_length(term))).tolist()
        shared = spark.sparkContext.broadcast((block["query"].to_numpy(), edge, term.flatten().to_numpy(), weight.flatten().to_numpy()))
        parts.mapInArrow(_answer(k, mean, shared), "query long, doc_id long, score double").write.mode("append").parquet(folder)
        shared.unpersist()
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    best = spark.read.schema("query long, doc_id long, score double").parquet(folder).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query", "rank", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def more_like(docs: DataFrame, queries: DataFrame, k: int = 10, most_terms: int | None = None) -> DataFrame:
    """search() with documents as queries, over an index of all docs."""
    return search(build_index(docs), query_terms(queries), k, most_terms)
