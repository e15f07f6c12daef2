"""Cover-tree hard negatives against brute force, the SQL twin, and on odd tables."""

import math

import numpy as np
import pytest

from inkframe.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, row string, x string, search string"


def brute(table, every=100, positives=5, k=10):
    live = []
    for vec_id, vector, label, *_ in table:
        if vec_id is None or label is None or vector is None or any(v is None or not math.isfinite(v) for v in vector):
            continue
        live.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(v))) for v in vector]))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for i, (a, la, xa) in enumerate(live):
        if a % every:
            continue
        scored = sorted(((-dot(xa, x), b, j) for j, (b, lb, x) in enumerate(live) if j != i and lb == la))[:positives]
        others = sorted((-dot(xa, x), b) for b, lb, x in live if lb != la)
        for minus, b, _ in scored:
            near = [(-s, c) for s, c in others if 30 * -minus <= 100 * -s <= 90 * -minus][:k]
            out += [(a, b, r + 1, c, -minus, s) for r, (s, c) in enumerate(near)]
    return sorted(out)


def mined(spark, table, **options):
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in table], SCHEMA)
    return sorted(tuple(r) for r in H.hard_negatives(df, **options).collect())


def clustered(n, seed, width=8):
    """Copies, near copies and strays around few directions, some of them with other norms."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, width))
    rows = []
    for i in range(n):
        v = base[rng.integers(6)] * rng.choice([0.3, 1.0, 2.0]) + (rng.normal(size=width) * 0.1 if i % 3 else 0)
        rows.append((i, [float(np.float32(c)) for c in v], int(rng.integers(4))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    table = clustered(600, seed)
    assert mined(spark, table, every=20) == brute(table, every=20)


def test_several_trees_and_passes(spark, monkeypatch):
    monkeypatch.setattr(H, "PASS_BYTES", 200)  # read by the driver only
    table = clustered(400, 3)
    assert mined(spark, table, every=40) == brute(table, every=40)


def test_odd_rows(spark):
    odd = [
        (None, [1.0, 0.0], 1), (0, None, 1), (100, [1.0, None], 1), (200, [float("nan"), 1.0], 1), (300, [float("inf"), 1.0], 2), (400, [1.0, 1.0], None),
        (500, [1.0, 0.5], 1), (501, [1.0, 0.5], 1), (502, [0.5, 0.25], 2), (503, [0.5, 0.25], 2), (504, [], 3), (600, [], 1), (800, [0.0, 0.0], 1),
        (505, [0.7, 0.1, 0.0], 3), (506, [-1.0, -1.0], 1), (507, [0.9, 0.45], 5), (900, [0.3, 0.3], 9),
    ]
    assert mined(spark, odd) == brute(odd)
    assert mined(spark, []) == []
    assert mined(spark, odd[:1]) == []


def test_repeated_rows_count_each(spark):
    table = [(0, [1.0, 0.0], 1), (1, [0.9, 0.0], 1), (1, [0.9, 0.0], 1), (2, [0.5, 0.0], 2), (2, [0.5, 0.0], 2)]
    assert mined(spark, table) == brute(table)


def test_cover_tree_holds_its_promises():
    x = H.augmented(np.floor(256 * np.array([v for _, v, _ in clustered(3000, 5)])), 5000.0)
    t = H.cover_tree(x)
    y = x[t["order"]]
    assert sorted(t["order"]) == list(range(len(x)))
    for n in range(len(t["parent"])):
        own = np.sqrt(((y[t["lo"][n] : t["hi"][n]] - y[t["center"][n]]) ** 2).sum(axis=1))
        assert own.max() <= t["radius"][n] + 1e-9
        kids = np.flatnonzero(t["parent"] == n)
        if len(kids):
            assert t["lo"][kids[0]] == t["lo"][n] and t["hi"][kids[-1]] == t["hi"][n] and (t["lo"][kids[1:]] == t["hi"][kids[:-1]]).all()
    assert len(t["parent"]) < len(x) / 2  # copies and clusters share nodes


def test_search_reads_few_rows_of_clustered_data():
    """Nodes outside a window or below the best are left out: most of the tree is never looked at."""
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(40, 16)) * 200
    x = np.floor(np.repeat(centers, 100, axis=0) + rng.normal(size=(4000, 16)))
    norm = float(np.sqrt((x * x).sum(axis=1).max()))
    t = H.cover_tree(H.augmented(x, norm))
    row = {c: np.ascontiguousarray(v).tobytes() for c, v in {**{c: t[c] for c in ("parent", "center", "lo", "hi", "radius")}, "x": x[t["order"]], "row": t["order"], "vec_id": t["order"], "label": np.zeros(len(x), dtype=np.int64)}.items()}
    descent = H.Descent(H.Tree(row, 16, norm), x[0])
    score, vec_id, _ = descent.best(H.NONE, 10, -np.inf, np.inf, 0, True, 0)
    want = sorted((-float(x[i] @ x[0]), i) for i in range(1, len(x)))[:10]
    assert list(zip(-score, vec_id, strict=True)) == want
    assert sum(len(n) for n, _, _ in descent.bounds.values()) < len(x) / 2
