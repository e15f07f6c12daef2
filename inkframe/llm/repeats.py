"""Repeated passages over all documents, exactly, from common-prefix intervals of a sparse suffix array.

A string of SPAN bytes holds SPAN - GRAM + 1 runs of GRAM bytes; the place of the one with the
smallest hash is an anchor, wherever the string stands. So two occurrences of a string have an anchor
at the same place, and suffixes are needed at anchors only (one in 35 bytes). Suffixes are dealt by
their first GRAM bytes, of which only those that occur again are kept; each deal is sorted into an
enhanced suffix array, and a stack scan of its common-prefix lengths gives the intervals. The members
of an interval are scanned the same way by what stands left of them: where left extensions differ a
maximal repeat group ends, with all its occurrences. All but a group's first occurrence are removed.

Copies of whole texts are settled by digest, equal surroundings inside the task that reads them. A deal
with more than DEAL different surroundings is dealt again by each whole string of SPAN bytes, of which
the least place stays - the same intervals at full depth, by map-side-combined minima instead of a sort.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm import text as T
from inkframe.session import cut

SPAN, GRAM = 100, 32
#: Bytes kept left of an anchor: no string of SPAN bytes that it stands for begins earlier.
LEFT = SPAN - GRAM
#: Different surroundings of one gram that one task compares.
DEAL = 512
#: Surroundings a task remembers to settle later equal ones at once.
REMEMBERED = 300_000

_KEYS = "doc_id long, dig long"
_OUT = f"{_KEYS}, start long, end long, h long, left binary, right binary"


def anchors(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash of the gram) of all anchors of texts that lie on end."""
    if len(raw) < SPAN:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * T._pow("p", T._P, len(raw)), out=total[1:])
    grams = T.mix((total[GRAM:] - total[:-GRAM]) * T._pow("i", T._P_INVERSE, len(raw))[: len(raw) - GRAM + 1])
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN - GRAM + 1:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    rest = SPAN - GRAM + 1 - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    starts = np.arange(len(least))
    ends = np.repeat(at[1:], np.diff(at))[: len(least)]
    found = (least[starts + SPAN <= ends] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    found = found[np.diff(found, prepend=-1) != 0]
    return found, grams[found]


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def intervals(strings: list[bytes], least: int) -> Iterator[tuple[int, list[int]]]:
    """(common prefix length, members) of every common-prefix interval of at least ``least``, inner ones first."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    stack = [(0, 0)]  # (length, first place)
    for k in range(1, len(order) + 1):
        now = _common(strings[order[k - 1]], strings[order[k]]) if k < len(order) else -1
        first = k - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            if length >= least and k - first > 1:
                yield length, order[first:k]
        if not stack or stack[-1][0] < now:
            stack.append((now, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes]) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes left of the anchor, bytes from it on, occurrences) of each repeat of SPAN bytes or more.

    lefts are read away from the anchor. An interval of right extensions is divided where its members'
    left extensions differ, so each group is maximal to both sides and lists all its occurrences.
    """
    for right, members in intervals(rights, SPAN - LEFT):
        for left, own in intervals([lefts[i] for i in members], SPAN - right):
            yield left, right, [members[i] for i in own]


def _grams(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in T.steps(batch.column(2)):
                raw, at = T.bytes_of(batch.column(2).slice(lo, hi - lo))
                place, gram = anchors(raw, at)
                row = np.searchsorted(at, place, side="right") - 1
                keys = [pa.array(batch.column(k).slice(lo, hi - lo).to_numpy()[row]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array((place - at[row]).astype(np.int32)), pa.array(gram.view(np.int64))], names=["doc_id", "dig", "place", "h"])

    return docs.select("doc_id", "dig", "text").mapInArrow(run, f"{_KEYS}, place int, h long")


def _surroundings(docs: DataFrame) -> DataFrame:
    """docs(doc_id, dig, text, places) -> what stands around each place; spans that are settled already have no h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}
        for batch in batches:
            ids, digs, places = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            out = []
            for i in range(len(batch)):
                raw = T.bytes_of(batch.column(2).slice(i, 1))[0].tobytes()
                for p in sorted(places[i].as_py()):
                    left, right = raw[max(0, p - LEFT) : p][::-1], raw[p : p + SPAN]
                    key, here = xxhash.xxh3_128_digest(left + b"|" + right + bytes([len(left)])), (ids[i], digs[i], p)
                    if (known := seen.get(key)) is not None and known < here:
                        out.append((ids[i], digs[i], p - len(left), p + len(right), None, None, None))
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[key] = here
                    out.append((ids[i], digs[i], p, 0, xxhash.xxh3_64_intdigest(right[:GRAM]) - (1 << 63), left, right))
                if len(out) >= 20_000:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    return docs.select("doc_id", "dig", "text", "places").mapInArrow(run, _OUT)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 5 + [pa.binary()] * 2
    columns = list(zip(*out, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "dig", "start", "end", "h", "left", "right"])


def _spans(rows: DataFrame) -> DataFrame:
    """Spans to remove, from surroundings dealt and sorted by h. Of a deal beyond DEAL its rows come back as they are."""

    def settle(group: list[tuple]) -> list[tuple]:
        group.sort(key=lambda r: r[:3])
        best: dict[tuple, int] = {}
        kept, out = [], []
        for r in group:  # of equal surroundings the first stays in play
            if (r[5], r[6]) in best:
                out.append((*r[:2], r[2] - len(r[5]), r[2] + len(r[6]), None, None, None))
            else:
                best[(r[5], r[6])] = 1
                kept.append(r)
        reach = [[0, 0] for _ in kept]
        if len(kept) > 1:
            for left, right, own in maximal_repeats([r[5] for r in kept], [r[6] for r in kept]):
                first = min(own)
                for i in own:
                    if i != first:
                        reach[i] = [max(reach[i][0], left), max(reach[i][1], right)]
        out += [(*r[:2], r[2] - a, r[2] + b, None, None, None) for r, (a, b) in zip(kept, reach, strict=True) if b]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, now, large, different = [], None, False, set()
        for batch in batches:
            out = []
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r[4] is None:
                    out.append(r)
                    continue
                if r[4] != now:
                    out += settle(group) if group and not large else group
                    group, now, large, different = [], r[4], False, set()
                group.append(r)
                if not large:
                    different.add((r[5], r[6]))
                    large = len(different) > DEAL
                if large:
                    out += group
                    group = []
            yield _rows(out)
        yield _rows(settle(group) if group and not large else group)

    return rows.mapInArrow(run, _OUT)


def _whole_strings(rows: DataFrame) -> DataFrame:
    """Every string of SPAN bytes around the places of large deals, by digest, with where it starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, dig, p, _, _, left, right in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                both = left[::-1] + right
                for s in range(len(both) - SPAN + 1):
                    out.append((doc, dig, p - len(left) + s, xxhash.xxh3_128_digest(both[s : s + SPAN])))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.binary()], strict=True)], names=["doc_id", "dig", "start", "key"])

    return rows.mapInArrow(run, f"{_KEYS}, start long, key binary")


def _places(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """doc_id, dig, places of the anchors whose gram occurs again, but for copies of whole texts."""
    again = _grams(docs).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    met = _grams(docs).join(again, "h").join(copies, ["doc_id", "dig"], "left_anti")
    return cut(met.groupBy("doc_id", "dig").agg(F.collect_list("place").alias("places")))


def _settled(docs: DataFrame, places: DataFrame) -> DataFrame:
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _surroundings(docs.join(places, ["doc_id", "dig"]))
    return cut(_spans(rows.repartition(n, F.coalesce("h", F.xxhash64("doc_id", "start"))).sortWithinPartitions("h")))


def _release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is cut off already, instead of at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_spans(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """docs(doc_id, dig, text) without copies(doc_id, dig) -> spans (doc_id, dig, start, end) in bytes whose
    every byte lies in a string of SPAN bytes that also starts earlier; they may overlap. The texts that
    are left are all different. Copies are taken out of the anchors, so no text moves for it."""
    places = _places(docs, copies)
    _release(docs.sparkSession)
    found = _settled(docs, places)
    _release(docs.sparkSession)
    large = _whole_strings(found.where("h is not null"))
    place = F.struct("doc_id", "dig", "start")
    first = large.groupBy("key").agg(F.min(place).alias("first"))
    later = large.join(first, "key").where(place > F.col("first")).select("doc_id", "dig", "start", (F.col("start") + SPAN).alias("end"))
    return found.where("h is null").select("doc_id", "dig", "start", "end").union(later)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A null text is empty. Rows without doc_id come first; rows of one doc_id follow in the order of a
    hash of their texts, and of equal rows one is the first. An empty table gives no rows.
    """
    lowest = -(1 << 63)
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    clash = not own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    own = own.withColumn("dig", F.xxhash64("text") if clash else F.lit(0).cast("long"))
    light = cut(own.select("doc_id", "dig", F.md5("text").alias("sum")))
    first = light.groupBy("sum").agg(F.min(F.struct("doc_id", "dig")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = light.join(first, "sum").where(F.struct("doc_id", "dig") > F.col("f")).select("doc_id", "dig").distinct()
    copies = cut(copies)
    distinct = own.select("doc_id", "dig", "text")
    if clash:
        distinct = distinct.dropDuplicates(["doc_id", "dig"])
    spans = repeated_spans(distinct, copies)
    lists = cut(spans.groupBy("doc_id", "dig").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    marked = own.join(lists, ["doc_id", "dig"], "left").join(copies.withColumn("copy", F.lit(True)), ["doc_id", "dig"], "left")
    if clash:
        from pyspark.sql import Window

        turn = F.row_number().over(Window.partitionBy("doc_id", "dig").orderBy(F.lit(0)))
        marked = marked.withColumn("copy", F.coalesce("copy", F.lit(False)) | (turn > 1))
    return marked.select("id", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy")).mapInArrow(
        _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        spans, copy, ids = batch.column(2), batch.column(3).to_pylist(), batch.column(0).to_pylist()
        for i in range(len(batch)):
            raw = T.bytes_of(batch.column(1).slice(i, 1))[0].tobytes()
            runs = [(0, len(raw))] if copy[i] and len(raw) >= SPAN else []
            if not copy[i]:
                for s in sorted((s["start"], s["end"]) for s in spans[i].as_py() or []):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1] = (runs[-1][0], max(runs[-1][1], s[1]))
                    else:
                        runs.append(s)
            edges = [0, *[x for r in runs for x in r], len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((ids[i], len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
