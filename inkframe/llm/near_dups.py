"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words; its weight is its count in the text times a damped inverse document
frequency. BANDS x ROWS consistent samples of each text fall into bands; texts that agree in a band
are candidates, and a candidate pair is linked when its exact weighted Jaccard similarity reaches
the threshold. Classes are the components of the links.

Texts with equal words are one node from the start, so groups of exact copies cost nothing further.
Inside a bucket all members first meet one of them, its centre; links are verified, and buckets whose
members have become one class are done. The members of the others are dealt in blocks of bounded size, and each
block and then each two blocks of a bucket are compared in a task that keeps the sets of both and passes over
pairs that it has linked already. So the number of rounds is fixed, and the sets of a bucket move as often as it has
blocks, not once a pair. A pair that agrees in several bands is met in the first of
them only: an entry carries the keys of the bands before its own. Document frequencies are counted over all documents in
2^IDF_BITS cells (less the mean load of a cell), which bounds what is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.llm import text as T
from inkframe.operators.iterate import connected_components
from inkframe.session import cut, spread

THRESHOLD = 0.8
BANDS, ROWS = 14, 4
#: Further samples of candidates only, a byte of each, estimate a pair's similarity before its sets are fetched.
#: A pair at the threshold agrees in fewer than SKETCH_LEAST of them (four deviations) once in 20,000 cases.
SKETCH, SKETCH_LEAST = 192, 131
IDF_BITS = 18
#: Weights run from 1 (in every document) to 1 + IDF_SHARE (in one).
IDF_SHARE = 0.5
#: Entries of the tables of Gamma(2,1), log Gamma(2,1) and uniform draws that samples are looked up in.
DRAWS = 16
#: Members and bytes of sets in a block, about.
BLOCK_ROWS, BLOCK_BYTES = 4096, 16_000_000

_BASE = "node binary, doc_id long"
_SKETCH = [f"s{k}" for k in range(SKETCH // 8)]


def _tables(seed: int) -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(seed)
    n = 1 << DRAWS
    r, c, beta = rng.gamma(2, 1, n), np.log(rng.gamma(2, 1, n)), rng.random(n)
    odd = rng.integers(1, 1 << 31, BANDS * ROWS + SKETCH, dtype=np.uint32) | np.uint32(1)
    return *(x.astype(np.float32) for x in (r, 1 / r, c - r, beta)), odd


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def shingle_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Distinct (hash, row) shingles with counts, and a 128-bit digest of each text's words."""
    hashes, rows, _, _ = T.words(column)
    edge = np.searchsorted(rows, np.arange(len(column) + 1))
    digests = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return *T.counted(*T.shingles(hashes, rows, len(column))), digests


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Weight of a shingle by its cell, from the number of documents that have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = np.zeros(1 << IDF_BITS, dtype=np.int64), 0
        for batch in batches:
            n += len(batch)
            for lo, hi in T.steps(batch.column(0)):
                found = shingle_rows(batch.column(0).slice(lo, hi - lo))[0]
                cells += np.bincount((found >> np.uint64(64 - IDF_BITS)).astype(np.int64), minlength=len(cells))
        met = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1).astype(np.int32)), pa.array(np.append(cells[met], n))], names=["cell", "n"])

    sums = _own(docs).select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # 2^IDF_BITS + 1 rows at most
    cell, n = sums["cell"].to_numpy(), sums["n"].to_numpy().astype(float)
    total = max(1.0, float(n[cell == -1].sum()))
    df = np.zeros(1 << IDF_BITS)
    df[cell[cell >= 0]] = n[cell >= 0]
    df = np.clip(df - df.sum() / len(df), 1, total)
    return (1 + IDF_SHARE * np.log((1 + total) / (1 + df)) / np.log(1 + total)).astype(np.float64)


def signatures(docs: DataFrame, idf: np.ndarray, seed: int = 5) -> DataFrame:
    """node (digest of the words), doc_id, digest of the text and the keys of the bands; texts without words have no bands."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = _tables(seed)
        for batch in batches:
            for lo, hi in T.steps(batch.column(1)):
                hashes, rows, counts, digests = shingle_rows(batch.column(1).slice(lo, hi - lo))
                weights = counts * shared.value[(hashes >> np.uint64(64 - IDF_BITS)).astype(np.int64)]
                keys = band_keys(hashes, rows, weights, hi - lo, draws)
                mass = np.bincount(rows, weights=weights, minlength=hi - lo).astype(np.float64)  # integers if there are no words
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum((mass > 0) * BANDS)]).astype(np.int32), keys[mass > 0].reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, type=pa.binary()), batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), lists, pa.array(mass)],
                    names=["node", "doc_id", "digest", "bands", "mass"],
                )

    return _own(docs).withColumn("digest", text_digest(F.col("text"))).mapInArrow(run, f"{_BASE}, digest binary, bands array<long>, mass double")


def consistent_samples(hashes: np.ndarray, rows: np.ndarray, weights: np.ndarray, which: range, draws) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, row, sample) of the k-th sample of each text that has shingles, for k in ``which``.

    Two texts agree in a sample with the probability of their weighted Jaccard similarity.
    """
    r_, inverse_, c_, beta_, odd = draws
    if not len(hashes):
        return
    edge = np.flatnonzero(np.diff(rows, prepend=-1))
    owner, log_w = rows[edge], np.log(weights).astype(np.float32)
    short, place = (hashes >> np.uint64(32)).astype(np.uint32), np.arange(len(hashes), dtype=np.uint64)
    for k in which:
        at = (short * odd[k]) >> np.uint32(32 - DRAWS)
        beta = beta_[at]
        t = np.floor(log_w * inverse_[at] + beta)
        a = (c_[at] - r_[at] * (t - beta)).view(np.int32)
        ordered = (a ^ ((a >> 31) | np.int32(-(1 << 31)))).view(np.uint32)  # unsigned in the order of the floats
        # the smallest value, and of equal ones the smallest hash
        first = (np.minimum.reduceat((ordered.astype(np.uint64) << np.uint64(32)) | place, edge) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        yield k, owner, T.mix(hashes[first] + T.mix(t[first].astype(np.int64).astype(np.uint64) + np.uint64(k)))


def band_keys(hashes: np.ndarray, rows: np.ndarray, weights: np.ndarray, n: int, draws) -> np.ndarray:
    keys = np.zeros((n, BANDS), dtype=np.uint64)
    for k, owner, sample in consistent_samples(hashes, rows, weights, range(BANDS * ROWS), draws):
        keys[owner, k // ROWS] = T.mix(keys[owner, k // ROWS] * np.uint64(31) + sample)
    return keys


def sketches(hashes: np.ndarray, rows: np.ndarray, weights: np.ndarray, n: int, draws) -> np.ndarray:
    """A byte of each of SKETCH samples that no band uses, eight to a word."""
    out = np.zeros((n, SKETCH // 8), dtype=np.uint64)
    for k, owner, sample in consistent_samples(hashes, rows, weights, range(BANDS * ROWS, BANDS * ROWS + SKETCH), draws):
        k -= BANDS * ROWS
        out[owner, k // 8] |= (sample & np.uint64(255)) << np.uint64(8 * (k % 8))
    return out


def shingle_sets(docs: DataFrame, nodes: DataFrame, idf: np.ndarray, seed: int = 5) -> DataFrame:
    """node -> sorted shingle hashes, counts and sketch, for nodes(node, doc_id, digest) given by one of their documents.

    Rows without doc_id are first reduced to one row of each text, so that they meet no node but their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = _tables(seed)
        for batch in batches:
            for lo, hi in T.steps(batch.column(1)):
                hashes, rows, counts, digests = shingle_rows(batch.column(1).slice(lo, hi - lo))
                weights = counts * shared.value[(hashes >> np.uint64(64 - IDF_BITS)).astype(np.int64)]
                sketch = [pa.array(x) for x in sketches(hashes, rows, weights, hi - lo, draws).view(np.int64).T]
                ends = pa.array(np.searchsorted(rows, np.arange(hi - lo + 1)).astype(np.int32))
                sets = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (hashes.view(np.int64), counts.astype(np.int32))]
                wanted = [a == b for a, b in zip(digests, batch.column(0).slice(lo, hi - lo).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(digests, type=pa.binary()), *sets, *sketch], names=["node", "hashes", "counts", *_SKETCH]).filter(pa.array(wanted))

    own = _own(docs).withColumn("digest", text_digest(F.col("text")))
    named = own.where("doc_id is not null").join(nodes, ["doc_id", "digest"]).select("node", "text")
    nameless = own.where("doc_id is null").join(nodes.where("doc_id is null").select("node", "digest"), "digest")
    nameless = nameless.groupBy("node").agg(F.any_value("text").alias("text"))
    return named.union(nameless).mapInArrow(run, f"node binary, hashes array<long>, counts array<int>, {', '.join(f'{c} long' for c in _SKETCH)}").dropDuplicates(["node"])


def _similar(threshold: float, idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ha, ca, hb, cb = ((np.asarray(batch.column(k).values), np.asarray(batch.column(k).offsets)) for k in (2, 3, 4, 5))
            wa, wb = (c * idf.value[(h.view(np.uint64) >> np.uint64(64 - IDF_BITS)).astype(np.int64)] for (h, _), (c, _) in ((ha, ca), (hb, cb)))
            keep = []
            for i in range(len(batch)):
                (a0, a1), (b0, b1) = ha[1][i : i + 2], hb[1][i : i + 2]
                _, ia, ib = np.intersect1d(ha[0][a0:a1], hb[0][b0:b1], assume_unique=True, return_indices=True)
                both = np.minimum(wa[a0:a1][ia], wb[b0:b1][ib]).sum()
                keep.append(both >= threshold * (wa[a0:a1].sum() + wb[b0:b1].sum() - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(keep, type=pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, threshold: float, idf: np.ndarray) -> DataFrame:
    """The pairs(src, dst) whose weighted Jaccard similarity reaches the threshold."""
    a = sets.select(F.col("node").alias("src"), F.col("hashes").alias("ha"), F.col("counts").alias("ca"))
    b = sets.select(F.col("node").alias("dst"), F.col("hashes").alias("hb"), F.col("counts").alias("cb"))
    met = pairs.join(b, "dst").join(a, "src").select("src", "dst", "ha", "ca", "hb", "cb")
    return met.mapInArrow(_similar(threshold, pairs.sparkSession.sparkContext.broadcast(idf)), "src binary, dst binary")


def joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """label(node, component) after the classes at both ends of links(src, dst) became one."""
    ends = links.join(label.toDF("src", "a"), "src").join(label.toDF("dst", "b"), "dst").where("a <> b")
    ends = cut(ends.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    if ends.isEmpty():
        return label
    both = ends.select(F.col("src").alias("id")).union(ends.select("dst")).distinct()
    new = connected_components(both, ends).toDF("component", "whole")
    return cut(label.join(new, "component", "left").select("node", F.coalesce("whole", "component").alias("component")))


def block_links(members: DataFrame, sets: DataFrame, threshold: float, idf: np.ndarray, across: bool) -> DataFrame:
    """Links (src, dst) that join the classes of members(band, key, node, mass, bands, bytes, component) that share a
    bucket and a block of it, or with ``across`` a bucket only; pairs that the links join already have none."""
    share = F.greatest(F.count(F.lit(1)) / F.lit(BLOCK_ROWS), F.sum("bytes") / F.lit(BLOCK_BYTES))
    state = members.groupBy("band", "key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.ceil(share).cast("int").alias("parts"))
    open_ = state.where("a <> b" + (" and parts > 1" if across else "")).select("band", "key", "parts")
    rows = members.drop("bytes").join(open_, ["band", "key"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    if across:
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("other <> part")
    else:
        rows = rows.withColumn("other", F.col("part"))
    block = ["band", "key", "low", "high"]
    rows = rows.select("*", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")).drop("parts", "other")
    whole = spread(rows.join(sets, "node"), *block)
    return whole.groupBy(*block).applyInArrow(_linked(threshold, members.sparkSession.sparkContext.broadcast(idf), across), "src binary, dst binary")


def _linked(threshold: float, idf, across: bool):
    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("part", "ascending"), ("node", "ascending")]).combine_chunks()
        column = lambda c: rows[c].combine_chunks()
        n, node, part, mass = len(rows), rows["node"].to_pylist(), rows["part"].to_numpy(), rows["mass"].to_numpy()
        of = column("component").dictionary_encode().indices.to_numpy().copy()
        before = column("bands").flatten().to_numpy().reshape(n, -1)
        sketch = np.ascontiguousarray(np.stack([rows[c].to_numpy() for c in _SKETCH], axis=1)).view(np.uint8)
        hashes, counts = (column(c).flatten().to_numpy() for c in ("hashes", "counts"))
        size = pc.list_value_length(column("hashes")).to_numpy().astype(np.int64)
        start = np.cumsum(size) - size
        _, place = np.unique(hashes, return_inverse=True)
        weight = counts * idf.value[(hashes.view(np.uint64) >> np.uint64(64 - IDF_BITS)).astype(np.int64)]
        own, found = np.zeros(place.max(initial=-1) + 1), []
        for i in range(n):
            first = int(np.searchsorted(part, part[i], side="right")) if across else i + 1
            j = first + np.flatnonzero(of[first:] != of[i])
            j = j[np.minimum(mass[j], mass[i]) >= threshold * np.maximum(mass[j], mass[i]) - 1e-9]
            j = j[~(before[j] == before[i]).any(axis=1)]
            j = j[(sketch[j] == sketch[i]).sum(axis=1) >= SKETCH_LEAST]
            if not len(j):
                continue
            mine = slice(start[i], start[i] + size[i])
            own[place[mine]] = weight[mine]
            edge = np.cumsum(size[j]) - size[j]
            at = np.arange(size[j].sum()) + np.repeat(start[j] - edge, size[j])
            both = np.add.reduceat(np.minimum(own[place[at]], weight[at]), edge)
            own[place[mine]] = 0
            for k in j[both >= threshold * (mass[i] + mass[j] - both) - 1e-9].tolist():
                if of[k] != of[i]:
                    found.append((node[i], node[k]))
                    of[of == of[k]] = of[i]
        return pa.table([pa.array([f[k] for f in found], type=pa.binary()) for k in (0, 1)], names=["src", "dst"])

    return run


def _alike() -> Column:
    """How many bytes of the sketches ``a`` and ``b`` agree."""
    differ = F.lit(0)
    for c in _SKETCH:
        x = F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))
        for n in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, n))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return SKETCH - differ


def text_digest(text: Column) -> Column:
    """128 bits of a text; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id for every row: class_id is the smallest doc_id of the class.

    A null text counts as empty. Texts without words form one class with each other; texts of fewer
    than five words have one shingle. Rows without doc_id belong to the class of their text; a class
    of such rows only has class_id null. Repeated rows stay rows. An empty table gives no rows.
    """
    own = cut(labelled(docs, threshold))
    least = cut(own.groupBy("component").agg(F.min("doc_id").alias("class_id")))
    return own.join(least, "component").select("doc_id", "class_id")


def representatives(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, digest (of the text) of one row of each class: the smallest doc_id, null only if no row has one;
    of its texts the smallest digest."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest"))
    return labelled(docs, threshold).groupBy("component").agg(first.alias("r")).select("r.doc_id", "r.digest")


def labelled(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, digest (of the text), component (names the class) for every row."""
    idf = document_frequencies(docs)
    rows = cut(signatures(docs, idf))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest"))
    nodes = rows.groupBy("node").agg(first.alias("r"), F.any_value("bands").alias("bands"), F.any_value("mass").alias("mass"))
    entries = nodes.select("node", "r.doc_id", "r.digest", "mass", "bands", F.posexplode("bands").alias("band", "key"))
    entries = entries.withColumn("bands", F.slice("bands", F.lit(1), F.col("band")))  # those before the entry's own
    members = nodes.select(F.posexplode("bands").alias("band", "key")).groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = cut(entries.join(members.select("band", "key"), ["band", "key"]))
    wanted = cut(buckets.select("node", "doc_id", "digest").distinct())
    sets = cut(shingle_sets(docs, wanted, idf))
    centre = buckets.groupBy("band", "key").agg(F.min(F.struct("doc_id", "node", "mass", "bands")).alias("c"))
    centre = centre.select("band", "key", F.col("c.node").alias("centre"), F.col("c.mass").alias("c_mass"), F.col("c.bands").alias("c_bands"))
    others = buckets.join(centre, ["band", "key"]).where("node <> centre")
    # of equal mass at best, the smaller text over the larger bounds the similarity
    bound = F.least("mass", "c_mass") >= threshold * F.greatest("mass", "c_mass") - 1e-9
    met_before = F.exists(F.zip_with("bands", "c_bands", lambda x, y: x == y), lambda x: x)
    met = others.where(bound & ~met_before).select(F.least("node", "centre").alias("src"), F.greatest("node", "centre").alias("dst")).distinct()
    looks = sets.select("node", *_SKETCH)
    met = met.join(looks.withColumnRenamed("node", "src"), "src").alias("a").join(looks.withColumnRenamed("node", "dst").alias("b"), "dst")
    label = wanted.select("node", F.col("node").alias("component"))
    label = joined(label, cut(verified(met.where(_alike() >= SKETCH_LEAST).select("src", "dst"), sets, threshold, idf)))
    others = others.select("band", "key", "node", "mass", "bands").join(sets.select("node", (12 * F.size("hashes") + SKETCH).cast("long").alias("bytes")), "node")
    others = cut(others)
    for across in (False, True):
        label = joined(label, cut(block_links(others.join(label, "node"), sets, threshold, idf, across)))
    return rows.select("node", "doc_id", "digest").join(label, "node", "left").select("doc_id", "digest", F.coalesce("component", "node").alias("component"))
