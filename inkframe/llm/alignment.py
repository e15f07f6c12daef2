"""Alignment of two tokenizers over the same bytes, and how often their ids stand for each other.

Both tokenizers cut wherever a blank or line feed follows a character that is no white space, so a text is a
run of pieces between such places, and each distinct piece is tokenized and aligned once per task.

A stretch of bytes is a Fragment: tokens up to the first byte at which tokens of both sides end (open
head), the groups between such bytes, and tokens behind the last one (open tail). Fragments compose
associatively: a tail and the head after it close a group. Documents longer than CHUNK bytes are cut into byte
ranges, without regard for tokens, which go to tasks of their own; trees of FAN ranges put them together.

Pairs are counted by batch of documents before they move, and only a batch's own pairs come back to it.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkframe.llm import text as T
from inkframe.llm.search import written

#: Bytes of a byte range of a long document.
CHUNK = 32_768
#: Ranges of one document that one step of the tree composes.
FAN = 8
#: Bytes of text whose documents form a batch.
BATCH_BYTES = 4_000_000
#: Bytes of distinct pieces that a task keeps.
KEPT_BYTES = 2_000_000
#: Distinct pieces that one call of a tokenizer takes.
PIECES = 500
#: An id pair is first id << PAIR_BITS | second id.
PAIR_BITS = 15
_WHITE, _BLACK = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
_ENDS_WHITE = re.compile(rf"{_WHITE}\Z")
PIECE = re.compile(rf"[ \n]?{_WHITE}*{_BLACK}+(?:(?![ \n]){_WHITE}+{_BLACK}+)*(?:{_WHITE}+\Z)?|{_WHITE}+\Z")


class Tokens(NamedTuple):
    """Tokens of both sides in order: ids, and the bytes at which they end."""

    a: tuple[int, ...] = ()
    a_ends: tuple[int, ...] = ()
    b: tuple[int, ...] = ()
    b_ends: tuple[int, ...] = ()

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*[x + y for x, y in zip(self, other, strict=True)])

    def slice(self, lo: int, hi: int) -> Tokens:
        """Tokens that end at lo < byte <= hi."""
        i, j = (tuple(np.searchsorted(ends, (lo, hi), side="right")) for ends in (self.a_ends, self.b_ends))
        return Tokens(self.a[i[0] : i[1]], self.a_ends[i[0] : i[1]], self.b[j[0] : j[1]], self.b_ends[j[0] : j[1]])

    def group(self) -> tuple[bytes, list[int]]:
        """The tokens as one group: its ids in text, and the pairs of tokens whose bytes overlap."""
        pairs, i, j = [], 0, 0
        while i < len(self.a) and j < len(self.b):
            pairs.append(self.a[i] << PAIR_BITS | self.b[j])
            end, other = self.a_ends[i], self.b_ends[j]
            i, j = i + (end <= other), j + (other <= end)
        return b",".join(b"%d" % x for x in self.a) + b"|" + b",".join(b"%d" % x for x in self.b), pairs


class Fragment(NamedTuple):
    """What is known of a stretch of bytes. closed: whether tokens of both sides end at one byte in it or at its start."""

    head: Tokens
    closed: bool
    groups: tuple[bytes, ...]
    pairs: tuple[int, ...]
    tail: Tokens

    def __add__(self, other: Fragment) -> Fragment:
        if not self.closed:
            return other._replace(head=self.head + other.head)
        if not other.closed:
            return self._replace(tail=self.tail + other.head)
        middle = self.tail + other.head
        text, pairs = middle.group() if middle.a else (b"", [])
        return Fragment(self.head, True, (*self.groups, *([text] if text else []), *other.groups), (*self.pairs, *pairs, *other.pairs), other.tail)


EMPTY = Fragment(Tokens(), False, (), (), Tokens())


def fragment(tokens: Tokens, begins: bool) -> Fragment:
    """The fragment of some tokens; begins: whether tokens of both sides begin at its start."""
    _, i, j = np.intersect1d(tokens.a_ends, tokens.b_ends, assume_unique=True, return_indices=True)
    edges = [*([(0, 0)] if begins else []), *zip((i + 1).tolist(), (j + 1).tolist(), strict=True)]
    if not edges:
        return EMPTY._replace(head=tokens)

    def part(lo: tuple[int, int], hi: tuple[int | None, int | None]) -> Tokens:
        return Tokens(tokens.a[lo[0] : hi[0]], tokens.a_ends[lo[0] : hi[0]], tokens.b[lo[1] : hi[1]], tokens.b_ends[lo[1] : hi[1]])

    groups = [part(lo, hi).group() for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    return Fragment(part((0, 0), edges[0]), True, tuple(g for g, _ in groups), tuple(p for _, own in groups for p in own), part(edges[-1], (None, None)))


_DIGITS = np.zeros((1 << 16, 6), dtype=np.uint8)
_DIGITS[:, :5] = np.array([list(b"%-5d" % i) for i in range(1 << 16)], dtype=np.uint8)
_WIDTH = np.array([len(str(i)) for i in range(1 << 16)])


def aligned_pieces(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(text of the groups, n_a n_b n_groups, pairs, first pair) of each piece, all pieces at once; ends are the bytes at
    which tokens and pieces end. Each stretch between neighbouring ends is where one pair of tokens overlaps."""
    joint = np.intersect1d(a_ends, b_ends, assume_unique=True)
    of_a, of_b = np.searchsorted(joint, a_ends), np.searchsorted(joint, b_ends)
    place_a = np.arange(len(a)) + np.searchsorted(of_b, of_a)
    place_b = np.arange(len(b)) + np.searchsorted(of_a, of_b, side="right")
    ids, marks = np.zeros(len(a) + len(b), dtype=np.int64), np.full(len(a) + len(b), ord(","), dtype=np.uint8)
    ids[place_a], ids[place_b] = a, b
    marks[place_a[np.diff(of_a, append=-1) != 0]], marks[place_b[np.diff(of_b, append=-1) != 0]] = ord("|"), ord(";")
    letters, width = _DIGITS[ids], _WIDTH[ids]
    letters[np.arange(len(ids)), width] = marks
    raw = letters[np.arange(6) <= width[:, None]].tobytes()
    n_a, n_b, n_groups = (np.searchsorted(x, ends, side="right") for x in (a_ends, b_ends, joint))
    at = np.append(0, np.cumsum(width + 1))[n_a + n_b].tolist()
    texts = [raw[lo : hi - 1] for lo, hi in zip([0, *at[:-1]], at, strict=True)]
    stretches = np.union1d(a_ends, b_ends)
    pairs = a[np.searchsorted(a_ends, stretches)] << PAIR_BITS | b[np.searchsorted(b_ends, stretches)]
    sizes = np.diff(np.array([n_a, n_b, n_groups]), axis=1, prepend=0)
    return texts, sizes, pairs, np.searchsorted(stretches, ends, side="right")


class Aligner:
    """Both tokenizers with the pieces that a task has met."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.first = Tokenizer.from_file(byte_bpe)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        vocabulary = self.first.get_vocab()
        self.a_size = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self.a_size[list(vocabulary.values())] = [len(t) for t in vocabulary]  # a character of a byte-level token is a byte
        names = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.second.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.blank = self.second.piece_to_id("▁")
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[bytes | None] = []
        self.kept, self.flat, self.edge, self.table = 0, np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros((3, 0), dtype=np.int64)

    def both(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of both sides for a text that begins with a blank or line feed; None where their bytes differ."""
        a, b = self.first.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.second.encode(text[text[0] == " " :])  # it puts a blank before
        if text[0] != " ":
            if b[:1] != [self.blank]:
                return None
            b = b[1:]
        return (a, b) if b"".join([self.b_bytes[x] for x in b]) == text.encode() else None

    def tokens(self, piece: str) -> Tokens | None:
        ids = self.both(piece)
        return ids and Tokens(tuple(ids[0]), tuple(np.cumsum(self.a_size[ids[0]]).tolist()), tuple(ids[1]), tuple(np.cumsum(self.b_size[ids[1]]).tolist()))

    def learn(self, pieces: set[str]) -> None:
        """Tokenizes new pieces, many in one text; those that end in white space, and those of a text whose bytes differ, alone."""
        new = [p for p in pieces if p not in self.place]
        if not new:
            return
        plain = [p for p in new if not _ENDS_WHITE.search(p)]
        jobs = [plain[lo : lo + PIECES] for lo in range(0, len(plain), PIECES)] + [[p] for p in new if _ENDS_WHITE.search(p)]
        good, bad, a, b = [], [], [], []
        while jobs:
            job = jobs.pop()
            ids = self.both("".join(job))
            if ids:
                good += job
                a.append(np.array(ids[0], dtype=np.int64))
                b.append(np.array(ids[1], dtype=np.int64))
            elif len(job) > 1:
                jobs += [[p] for p in job]
            else:
                bad += job
        start = len(self.groups)
        if good:
            a, b = np.concatenate(a), np.concatenate(b)
            ends = np.cumsum([len(p.encode()) for p in good])
            texts, sizes, pairs, last = aligned_pieces(a, np.cumsum(self.a_size[a]), b, np.cumsum(self.b_size[b]), ends)
            self.groups += texts
            self.table, self.edge, self.flat = np.hstack([self.table, sizes]), np.append(self.edge, self.edge[-1] + last), np.append(self.flat, pairs)
        self.groups += [None] * len(bad)
        self.table, self.edge = np.hstack([self.table, np.zeros((3, len(bad)), dtype=np.int64)]), np.append(self.edge, np.full(len(bad), self.edge[-1]))
        self.place.update(zip(good + bad, range(start, len(self.groups)), strict=True))
        self.kept += sum(map(len, new))

    def places(self, texts: list[str | None]) -> list[list[int]]:
        """The pieces of a blank and each text; a null or empty text has none."""
        split = [PIECE.findall(" " + t) if t else [] for t in texts]
        if self.kept > KEPT_BYTES:
            self.forget()
        self.learn(set().union(*split))
        return [list(map(self.place.__getitem__, s)) for s in split]


_ROW = "batch long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<int>, times array<int>"
_COLUMNS = [c.split()[0] for c in _ROW.split(", ")]


def _rows(batch: int, ids: pa.Array, sizes: np.ndarray, digests: list[str], rows: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
    """Rows of documents; rows and pairs hold every link."""
    key, times = np.unique(rows << np.int64(32) | pairs, return_counts=True)
    edge = pa.array(np.searchsorted(key >> np.int64(32), np.arange(len(ids) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(edge, pa.array(v.astype(np.int32))) for v in (key & np.int64(0xFFFFFFFF), times)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), batch)), ids, *[pa.array(c.astype(np.int64)) for c in sizes], pa.array(digests, type=pa.string()), *lists], names=_COLUMNS)


def _aligned_short(byte_bpe: str, piece_bpe: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number, size = Aligner(byte_bpe, piece_bpe), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for lo, hi in T.steps(batch.column(1)):
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                places = aligner.places(texts)
                at, row = np.array([p for own in places for p in own], dtype=np.int64), np.repeat(np.arange(len(texts)), [len(p) for p in places])
                bad = np.zeros(len(texts), dtype=bool)
                bad[row[aligner.table[0][at] == 0]] = True
                at, row = at[~bad[row]], row[~bad[row]]
                sizes = np.array([np.bincount(row, weights=c[at], minlength=len(texts)) for c in aligner.table])
                whole = [not b and bool(own) for b, own in zip(bad, places, strict=True)]
                digests = [hashlib.sha256(b";".join(map(aligner.groups.__getitem__, own))).hexdigest() if w else "" for w, own in zip(whole, places, strict=True)]
                held = aligner.edge[at + 1] - aligner.edge[at]
                take = np.repeat(aligner.edge[at] - np.cumsum(held) + held, held) + np.arange(int(held.sum()))
                yield _rows(number, batch.column(0).slice(lo, hi - lo), sizes, digests, np.repeat(row, held), aligner.flat[take])
                size += sum(len(t or "") for t in texts)
                if size > BATCH_BYTES:
                    number, size = number + 1, 0

    return run


_CUT = "row long, doc_id long, chunk long, begin long, lo long, hi long, part string"


def cut_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges lo..hi of a blank and each text, with the whole pieces around them, which start at byte begin.

    A border that has no end of a piece within CHUNK bytes on either side is left out.
    """
    for batch in batches:
        for row, doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            pieces = PIECE.findall(" " + text)
            ends = np.cumsum([len(p.encode()) for p in pieces])
            size = int(ends[-1])
            borders = np.arange(CHUNK, size, CHUNK)
            before, after = np.searchsorted(ends, borders, side="right") - 1, np.searchsorted(ends, borders)
            near = (borders - np.where(before >= 0, ends[before], 0) < CHUNK) & (ends[after] - borders < CHUNK)
            edges = [0, *borders[near].tolist(), size]
            out = []
            for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                i, j = int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(ends, hi)) + 1
                out.append((row, doc_id, k, int(ends[i - 1]) if i else 0, lo, hi, "".join(pieces[i:j])))
            types = [pa.int64()] * 6 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[c.split()[0] for c in _CUT.split(", ")])


_FRAGMENT = "row long, doc_id long, chunk long, sound boolean, closed boolean, n_a long, n_b long, head array<array<long>>, tail array<array<long>>, groups binary, n_groups long, pairs array<int>"


def range_fragment(aligner: Aligner, begin: int, lo: int, hi: int, part: str) -> tuple[Fragment, bool, int, int]:
    """(fragment, whether all bytes agree, tokens of each side) of the tokens that end at lo < byte <= hi."""
    pieces, sound, n = PIECE.findall(part), True, np.zeros(2, dtype=np.int64)
    if aligner.kept > KEPT_BYTES:
        aligner.forget()
    aligner.learn(set(pieces))
    before, inner, after = EMPTY, [], EMPTY
    at = begin
    for piece in pieces:
        k, end = aligner.place[piece], at + len(piece.encode())
        if aligner.groups[k] is None:
            sound = False
        elif end <= lo or at >= hi:
            pass
        elif at >= lo and end <= hi:
            inner.append(k)
            n += aligner.table[:2, k]
        else:  # a border inside a piece
            whole = aligner.tokens(piece)
            own = Tokens(whole.a, tuple(x + at for x in whole.a_ends), whole.b, tuple(x + at for x in whole.b_ends)).slice(lo, hi)
            n += len(own.a), len(own.b)
            if at < lo:
                before = fragment(own, False)
            else:
                after = fragment(own, True)
        at = end
    if inner:
        before += Fragment(Tokens(), True, tuple(aligner.groups[k] for k in inner), tuple(np.concatenate([aligner.flat[aligner.edge[k] : aligner.edge[k + 1]] for k in inner]).tolist()), Tokens())
    return before + after, sound, *n.tolist()


def _packed(row: int, doc_id: int | None, chunk: int, f: Fragment, sound: bool, n_a: int, n_b: int) -> dict:
    text = b";".join(f.groups)
    n = text.count(b"|")
    return {"row": row, "doc_id": doc_id, "chunk": chunk, "sound": sound, "closed": f.closed, "n_a": n_a, "n_b": n_b, "head": [list(x) for x in f.head], "tail": [list(x) for x in f.tail], "groups": text, "n_groups": n, "pairs": list(f.pairs)}


def _unpacked(r: dict) -> Fragment:
    head, tail = (Tokens(*[tuple(int(v) for v in x) for x in r[c]]) for c in ("head", "tail"))
    return Fragment(head, bool(r["closed"]), (r["groups"],) if r["groups"] else (), tuple(r["pairs"]), tail)


def _fragments(byte_bpe: str, piece_bpe: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_bpe, piece_bpe)
        for batch in batches:
            for r in batch.to_pylist():
                found = range_fragment(aligner, r["begin"], r["lo"], r["hi"], r["part"])
                yield pa.RecordBatch.from_pylist([_packed(r["row"], r["doc_id"], r["chunk"], *found)], schema=_arrow_fragment())

    return run


def _arrow_fragment() -> pa.Schema:
    types = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<array<long>>": pa.list_(pa.list_(pa.int64()))}
    return pa.schema([(f.split()[0], types[f.split()[1]]) for f in _FRAGMENT.split(", ")])


def _compose(rows: pa.Table) -> pa.Table:
    """The ranges of one document that stand in one step of the tree."""
    own = sorted(rows.to_pylist(), key=lambda r: r["chunk"])
    joined = reduce(Fragment.__add__, [_unpacked(r) for r in own])
    both = [sum(r[c] for r in own) for c in ("n_a", "n_b")]
    return pa.Table.from_pylist([_packed(own[0]["row"], own[0]["doc_id"], own[0]["chunk"] // FAN, joined, all(r["sound"] for r in own), *both)], schema=_arrow_fragment())


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for r in batch.to_pylist():
            number += 1
            sizes = np.array([[r[c] if r["sound"] else 0] for c in ("n_a", "n_b", "n_groups")])
            pairs = np.array(r["pairs"] if r["sound"] else [], dtype=np.int64)
            digest = hashlib.sha256(r["groups"]).hexdigest() if r["sound"] else ""
            yield _rows(-number, pa.array([r["doc_id"]], type=pa.int64()), sizes, [digest], np.zeros(len(pairs), dtype=np.int64), pairs)


def aligned(docs: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """batch, doc_id, n_a, n_b, n_groups, groups_sha256, pairs (distinct id pairs) and times (how often each is linked)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    short = own.where(size <= CHUNK).mapInArrow(_aligned_short(byte_bpe, piece_bpe), _ROW)
    long = own.where(size > CHUNK)
    most = long.agg(F.max(F.octet_length("text"))).first()[0]
    if most is None:
        return short
    ranges = long.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(cut_ranges, _CUT)
    tree = ranges.repartition("row", "chunk").mapInArrow(_fragments(byte_bpe, piece_bpe), _FRAGMENT)
    ranges_left = -(-(most + 1) // CHUNK)
    while ranges_left > 1:
        tree = tree.groupBy("row", F.floor(F.col("chunk") / FAN).alias("step")).applyInArrow(_compose, _FRAGMENT)
        ranges_left = -(-ranges_left // FAN)
    return short.unionByName(tree.mapInArrow(_finished, _ROW))


_REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(left: pa.Table, right: pa.Table) -> pa.Table:
    """A batch of documents with the counts of its pairs."""
    order = np.argsort(right["pair"].to_numpy())
    known, count, best = (right[c].to_numpy()[order] for c in ("pair", "docs", "best"))
    pairs, times = (left[c].combine_chunks() for c in ("pairs", "times"))
    row = np.repeat(np.arange(len(left)), pairs.value_lengths().to_numpy(zero_copy_only=False))
    at, times = np.searchsorted(known, pairs.flatten().to_numpy()), times.flatten().to_numpy().astype(np.int64)
    sums = [np.bincount(row, weights=w, minlength=len(left)).astype(np.int64) for w in (times, times * best[at], times * count[at])]
    columns = [*[left[c] for c in ("doc_id", "n_a", "n_b", "n_groups")], *[pa.array(s) for s in sums], left["groups_sha256"]]
    return pa.Table.from_arrays(columns, names=[c.split()[0] for c in _REPORT.split(", ")])


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, docs, best) of (batch, pair, n): documents that link the ids, and whether no other pair of its first id has more."""
    counts = links.groupBy("pair").agg(F.sum("n").alias("docs"))
    first = Window.partitionBy(F.shiftright("pair", PAIR_BITS))  # no more rows than the second tokenizer has ids
    return counts.withColumn("best", (F.col("docs") == F.max("docs").over(first)).cast("long"))


def align(docs: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs.

    A null or empty text, and one whose tokens of either side are not the bytes of a blank and the text, has
    zeros and the digest ''. Rows of one doc_id are documents of their own, equal texts count once per row, null
    ids come back as null, an empty table has no rows, and other columns of docs are not read.
    """
    own = written(aligned(docs, byte_bpe, piece_bpe))
    links = written(own.select("batch", F.explode("pairs").alias("pair")).groupBy("batch", "pair").agg(F.count(F.lit(1)).alias("n")))
    counted = links.select("batch", "pair").join(pair_counts(links), "pair")
    return own.groupBy("batch").cogroup(counted.groupBy("batch")).applyInArrow(_scored, _REPORT)
