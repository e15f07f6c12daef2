"""Sum-of-squares packing of tokenized documents into sequences of fixed length.

Tokenizing runs inside the scan and only piece lengths go on. Pieces that fill a sequence need no
packing. The others are dealt over groups of bounded size, and a group is packed in one task: each
piece, largest first, goes where the sum over all gaps of (open sequences with that gap)^2 becomes
smallest. Sequences that a group leaves short go through further rounds with others, so each round
leaves about one share of a group. Pieces that cannot fill sequences stay as a round has packed them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm import text as T
from inkframe.session import cut

LENGTH = 2048
#: Pieces that one task packs.
GROUP_PIECES = 20_000
#: A round that leaves more than this share of its pieces in short sequences is the last one.
STALLED = 0.9
#: Distinct words whose ids a worker keeps; the newer half goes when it is reached.
KEPT_WORDS = 600_000
#: Stands between words that are tokenized together; a character that is one id by itself.
MARK = "\x01"


class WordIds(dict):
    """Little-endian 32-bit ids of white-space separated words, for tokenizers that treat white space
    as a border (no id spans it); each distinct word is tokenized about once per worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__({b"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = int(self._ids(MARK)[0])

    def forget(self) -> None:
        self.clear()
        self[b""] = b""

    def learn(self, found: set[bytes]) -> None:
        new = [w for w in found if w not in self]
        if len(self) + len(new) > KEPT_WORDS:
            for w in list(self)[KEPT_WORDS // 2 :]:  # words met early are the frequent ones
                del self[w]
            new = [w for w in found if w not in self]
        parts = {w: _parts(w) for w in new}
        todo = list({p for both in parts.values() for p in both if p not in self})
        for lo in range(0, len(todo), 500):
            self._encode(todo[lo : lo + 500])
        for w, (stem, sign) in parts.items():
            self[w] = self[stem] + self[sign]

    def _encode(self, part: list[bytes]) -> None:
        """Many words in one call, with a mark between them; one by one if a word has the mark itself."""
        ids = self._ids(f" {MARK} ".join([w.decode() for w in part]))
        ends = np.flatnonzero(ids == self.mark)
        if len(ends) == len(part) - 1 and not any(MARK.encode() in w for w in part):
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            for w, lo, hi in zip(part, [0, *[e + 4 for e in ends]], [*ends, len(raw)], strict=True):
                self[w] = raw[lo:hi]
        else:
            for w in part:
                self[w] = self._ids(w.decode()).tobytes()

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def of(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.__getitem__, words))


def _parts(word: bytes) -> tuple[bytes, bytes]:
    """A word in ASCII lower case without the comma or full stop that follows a letter, and that sign:
    the tokenizer lowers case and divides there as well. Words that may hold special tokens stay whole."""
    if b"<|" in word:
        return word, b""
    low = word.lower()
    return (low[:-1], low[-1:]) if len(low) > 1 and low[-1] in b",." and 97 <= low[-2] <= 122 else (low, b"")


_tokenizers: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own tokenizer; a task empties the table when it ends, so other stages have the memory."""
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document: its ids, then id 0, cut after each
    ``length`` ids. A null or empty text is the id 0 alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = word_ids(tokenizer)
        try:
            for batch in batches:
                for lo, hi in T.steps(batch.column(1)):
                    raw, at = T.bytes_of(batch.column(1).slice(lo, hi - lo))
                    split = [raw[at[i] : at[i + 1]].tobytes().split() for i in range(hi - lo)]  # bytes split at ASCII white space only
                    ids.learn(set().union(*split))
                    out = []
                    for key, own_words in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), split, strict=True):
                        own = ids.of(own_words) + b"\0\0\0\0"
                        for k, start in enumerate(range(0, len(own), 4 * length)):
                            part = own[start : start + 4 * length]
                            out.append((key, k, start // 4, len(part) // 4, zlib.crc32(part)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                        names=["doc_id", "piece", "start", "length", "ids_crc32"],
                    )
        finally:
            ids.forget()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(sizes: np.ndarray, length: int) -> np.ndarray:
    """The bin of each item, items taken in the given order. Ties go to the fullest bin."""
    count = np.zeros(length + 1, dtype=np.int64)  # open bins by gap
    open_: list[list[int]] = [[] for _ in range(length + 1)]
    out, bins = np.zeros(len(sizes), dtype=np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        had, then = count[s:length], count[: length - s]
        change = 2 * (then - had) + 2
        change[:1] -= 1  # a full bin is not open any more
        change[had == 0] = np.iinfo(np.int64).max
        fresh = 2 * count[length - s] + 1 if s < length else 0
        best = int(change.argmin()) if len(change) else -1
        if best < 0 or change[best] > fresh:
            bin_, gap, bins = bins, length - s, bins + 1
        else:
            bin_, gap = open_[s + best].pop(), best
            count[s + best] -= 1
        if gap:
            open_[gap].append(bin_)
            count[gap] += 1
        out[i] = bin_
    return out


def pack(rows: DataFrame, length: int = LENGTH, group: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset (gapless from 0) to rows that have a ``length``.

    Rows longer than ``length`` are an error of the caller. Equal rows are rows of their own; an
    empty table gives no rows.
    """
    rows = cut(rows.withColumn("__row", F.monotonically_increasing_id()))
    full = rows.where(F.col("length") >= length)
    done = [full.select("__row", (-1 - F.col("__row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left = rows.where(F.col("length") < length).select("__row", "length")
    round_ = 0
    while True:
        n = left.count()
        groups = max(1, -(-n // group))
        key = F.pmod(F.xxhash64("__row", F.lit(round_)), F.lit(groups)).cast("int")
        packed = cut(left.withColumn("__g", key).groupBy("__g").applyInPandas(_packer(length, round_), "__row long, length long, sequence_id long, offset long, used long"))
        short = packed.where(F.col("used") < length)
        last = groups == 1 or short.count() > STALLED * n
        done.append(packed.where(F.lit(last) | (F.col("used") == length)).select("__row", "sequence_id", "offset"))
        left = short.select("__row", "length")
        round_ += 1
        if last:
            break
    placed = done[0]
    for d in done[1:]:
        placed = placed.union(d)
    return rows.join(placed, "__row").drop("__row")


def _packer(length: int, round_: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "__row"], ascending=[False, True], ignore_index=True)
        bins = sum_of_squares(rows["length"].to_numpy(), length)
        by = rows.groupby(bins)["length"]
        start = by.cumsum() - rows["length"]
        number = (np.int64(round_) << np.int64(56)) + (np.int64(key[0]) << np.int64(24)) + bins
        return pd.DataFrame({"__row": rows["__row"], "length": rows["length"], "sequence_id": number, "offset": start, "used": by.transform("sum")})

    return run


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    return pack(pieces(docs, tokenizer, length), length)
