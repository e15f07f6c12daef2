"""Alignment of two tokenizers against whole-text tokenizing, the laws of fragments, and on odd tables."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from conftest import SMALL
from tokenizers import Tokenizer

from inkframe.llm import alignment as A
from inkframe.llm import queries

PATHS = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, batch string, pairs string, row string, n_a string"
BYTES = {c: b for b, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]), strict=True)}
BYTES |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(BYTES.values()))}


def whole(first, second, text):
    """Tokens of the whole text at once: ((id, start, end) of each side), or None."""
    if not text:
        return None
    want, sides = (" " + text).encode(), []
    a = [(i, bytes(BYTES[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
    name = second.id_to_piece
    b = [(i, bytes([int(name(i)[3:5], 16)]) if second.is_byte(i) else name(i).replace("▁", " ").encode()) for i in second.encode(text)]
    for side in (a, b):
        if b"".join(x for _, x in side) != want:
            return None
        ends = np.cumsum([len(x) for _, x in side])
        sides.append([(i, int(e) - len(x), int(e)) for (i, x), e in zip(side, ends, strict=True)])
    return sides


def brute(table):
    first, second = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    first.encode_special_tokens = True
    seen, out = Counter(), []
    for doc_id, text, *_ in table:
        sides = whole(first, second, text)
        if sides is None:
            out.append((doc_id, 0, 0, 0, [], ""))
            continue
        a, b = sides
        joint = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, at = [], [0, 0]
        for end in joint:
            own = [[], []]
            for k, side in enumerate(sides):
                while at[k] < len(side) and side[at[k]][2] <= end:
                    own[k].append(str(side[at[k]][0]))
                    at[k] += 1
            groups.append("|".join(map(",".join, own)))
        links, j = [], 0
        for i, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        seen.update(set(links))
        out.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (i, _), n in seen.items():
        top[i] = max(top[i], n)
    return [(d, na, nb, ng, len(ls), sum(seen[x] == top[x[0]] for x in ls), sum(seen[x] for x in ls), h) for d, na, nb, ng, ls, h in out]


def key(r):
    return tuple((x is None, x) for x in r)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "\n"), (5, "  a  b \n\n c\t d  e　f  "), (6, "<|endoftext|> <s></s> <0x0A> <unk>"), (7, "▁ under"), (8, "naïve 日本語 \U0001f600\U0001f469‍\U0001f680 it's we'll"),
    (9, "a\x00b\x1c c\x1f\r\n\r\nd \x85e"), (10, "x" * 3000 + " y"), (10, "x"), (None, "no id here"), (None, None), (11, "the the the the"), (12, "the the the the"), (13, "fiﬁ Ａ é ﻿"), (14, " lead\n trail \n"),
]


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in ODD], SCHEMA)
    assert sorted([tuple(r) for r in A.align(df, *PATHS).collect()], key=key) == sorted(brute(ODD), key=key)


def test_empty_table(spark):
    assert A.align(spark.createDataFrame([], SCHEMA), *PATHS).count() == 0


def test_documents(spark):
    docs = [tuple(r) for r in queries.documents(spark, SMALL).select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.QUERIES["op11_fragment_alignment"](spark, SMALL).collect()) == sorted(brute(docs))


def test_long_documents_in_trees(spark):
    """Documents of many ranges whose borders fall inside words, one without blanks, and one whose bytes differ at its end."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(chr(c) for c in rng.choice([97, 101, 105, 115, 116, 228, 233, 26085], rng.integers(1, 30)))
    text = " ".join(word() for _ in range(30_000))
    table = [(1, text), (2, text[::-1]), (3, "abé" * 40_000), (4, text + " ▁"), (None, text), (5, "short"), (6, "y" * 32_767), (7, "z " * 16_384)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    assert sorted([tuple(r) for r in A.align(df, *PATHS).collect()], key=key) == sorted(brute(table), key=key)


@pytest.mark.parametrize("width", [1, 3, 7, 64])
def test_fragments_are_associative(width):
    """Any cut into ranges, composed in any order, is the whole, though ranges end inside tokens."""
    aligner = A.Aligner(*PATHS)
    text = "unbelievable internationalisation of 日本語 words, naïvely\n aligned: 12345678 times"
    size = len((" " + text).encode())
    whole_, *_ = A.range_fragment(aligner, 0, 0, size, " " + text)
    parts = [A.range_fragment(aligner, 0, lo, min(size, lo + width), " " + text)[0] for lo in range(0, size, width)]
    left = right = None
    for p in parts:
        left = p if left is None else left + p
    for p in parts[::-1]:
        right = p if right is None else p + right
    for f in (left, right):
        assert b";".join(f.groups) == b";".join(whole_.groups) and Counter(f.pairs) == Counter(whole_.pairs) and not f.tail.a and not f.head.a
    if width < 7:
        assert any(p.head.a or p.head.b or p.tail.a or p.tail.b for p in parts)
