import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from inkframe.operators import anchors as A
from inkframe.operators import iterate as I
from inkframe.operators import layout as L
from inkframe.operators import memory as M
from inkframe.operators import segment as S
from inkframe.operators.ordered import in_order


@pytest.mark.parametrize("parts", [1, 7])
def test_connected_components_chain_and_hub(spark, parts):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(50)] + [(300, 300)]
    e = spark.createDataFrame(edges, "src long, dst long").repartition(parts)
    n = spark.createDataFrame([(i,) for i in [*range(61), *range(100, 151), 300, 400]], "id long")
    got = dict(rows(I.connected_components(n, e)))
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 151)) and got[300] == 300 and got[400] == 400


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_keep_and_match_are_sequential(spark, seed):
    rnd = random.Random(seed)
    prio = {i: rnd.randrange(5) for i in range(60)}
    edges = {tuple(sorted(rnd.sample(range(60), 2))) for _ in range(120)}
    nb = {i: set() for i in prio}
    for a, b in edges:
        nb[a].add(b)
        nb[b].add(a)
    kept = set()
    for i in sorted(prio, key=lambda k: (-prio[k], k)):
        if not nb[i] & kept:
            kept.add(i)
    items = spark.createDataFrame(list(prio.items()), "id long, prio long").repartition(5)
    e = spark.createDataFrame(list(edges), "a long, b long").repartition(3)
    assert {r[0] for r in rows(I.greedy_keep(items, e))} == kept

    cost = [(a, b, rnd.random()) for a in range(20) for b in rnd.sample(range(20), 4)]
    used_l, used_r, want = set(), set(), set()
    for a, b, c in sorted(cost, key=lambda t: (t[2], t[0], t[1])):
        if a not in used_l and b not in used_r:
            used_l.add(a)
            used_r.add(b)
            want.add((a, b))
    m = spark.createDataFrame(cost, "l long, r long, c double").select("l", "r", F.struct("c", "l", "r").alias("cost"))
    assert {(r["l"], r["r"]) for r in I.greedy_match(m).collect()} == want


def test_pile_of_copies_stays_linear(spark):
    """A third of all boxes are exact copies: they collapse before pairs are sought."""
    g = spark.range(3000).selectExpr("1L AS page_id", "id AS glyph_id", "IF(id < 1000, 50D, CAST(id AS DOUBLE) * 40) AS x0", "10D AS y0")
    g = g.selectExpr("*", "x0 + 20 AS x1", "y0 + 20 AS y1", "x0 + 10 AS cx", "y0 + 10 AS cy")
    sides = spark.createDataFrame([(1, 20.0)], "page_id long, mid_side double")
    assert L.dedupe_boxes(g, ["page_id"], "glyph_id", sides, 20.0).count() == 2001


def test_greedy_keep_settles_a_long_chain(spark):
    n = 10_000
    items = spark.range(n).select("id", (-F.col("id")).alias("prio"))
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    kept = {r["id"] for r in I.greedy_keep(items, edges).collect()}
    assert kept == set(range(0, n, 2))


def test_greedy_keep_equals_a_sequential_pass(spark):
    rnd = random.Random(8)
    prio = {i: rnd.randrange(20) for i in range(300)}
    pairs = {tuple(sorted(rnd.sample(range(300), 2))) for _ in range(500)}
    near = {i: {a + b - i for a, b in pairs if i in (a, b)} for i in prio}
    kept = set()
    for i in sorted(prio, key=lambda i: (-prio[i], i)):
        if not near[i] & kept:
            kept.add(i)
    got = I.greedy_keep(spark.createDataFrame(list(prio.items()), "id long, prio long"), spark.createDataFrame(list(pairs), "a long, b long"))
    assert {r["id"] for r in got.collect()} == kept


def test_near_signatures_find_exactly_the_close_ones(spark):
    rnd = random.Random(9)
    sigs = [[rnd.getrandbits(63) for _ in range(7)] for _ in range(40)]
    near = []
    for s in sigs:
        t = list(s)
        for p in rnd.sample(range(400), rnd.randrange(20, 36)):
            t[p // 63 % 7] ^= 1 << (p % 63)
        near.append(t)
    a = spark.createDataFrame([(3, s) for s in sigs], "aspect long, sig array<long>")
    b = spark.createDataFrame([(4, s) for s in near] + [(6, s) for s in sigs], "aspect long, sig array<long>")
    got = {(tuple(r["a_sig"]), tuple(r["b_sig"]), r["distance"]) for r in M.near_signatures(a, b, 448, 28).collect()}
    d = lambda x, y: sum((p ^ q).bit_count() for p, q in zip(x, y))
    want = {(tuple(x), tuple(y), d(x, y)) for x in sigs for y in near if d(x, y) <= 28}
    assert got == want and want


def test_signatures_at_real_sizes(spark):
    rnd = random.Random(11)
    for bits, reach in ((256, 56), (400, 28)):
        words = -(-bits // 64)
        spread = lambda v: [((v >> (64 * w)) & ((1 << 64) - 1)) - (1 << 64 if (v >> (64 * w + 63)) & 1 else 0) for w in range(words)]  # noqa: E731, B023
        base = [rnd.getrandbits(bits) for _ in range(12)]
        other = [b ^ sum(1 << p for p in rnd.sample(range(bits), rnd.choice([reach - 4, reach, reach + 1]))) for b in base]
        a = spark.createDataFrame([(0, spread(v)) for v in base], "aspect long, sig array<long>")
        b = spark.createDataFrame([(0, spread(v)) for v in other], "aspect long, sig array<long>")
        got = {(tuple(r["a_sig"]), tuple(r["b_sig"])) for r in M.near_signatures(a, b, bits, reach).collect()}
        assert got == {(tuple(spread(x)), tuple(spread(y))) for x in base for y in other if (x ^ y).bit_count() <= reach} and got
    with pytest.raises(ValueError):
        M.near_signatures(a, b, 20, 28)


def test_blank_borders_do_not_fill_a_piece(spark):
    rnd = random.Random(12)
    inner = [r * 20 + c for r in range(4, 16) for c in range(4, 16)]
    sigs = [sum(1 << p for p in inner if rnd.random() < 0.5) for _ in range(60)]
    rows_ = [([((v >> (64 * w)) & ((1 << 64) - 1)) - (1 << 64 if (v >> (64 * w + 63)) & 1 else 0) for w in range(7)],) for v in sigs]
    df = spark.createDataFrame(rows_, "sig array<long>")
    parts = df.select(M.F.posexplode(M._segments(M.F.col("sig"), 400, 28)).alias("seg", "val"))
    assert parts.groupBy("seg", "val").count().agg({"count": "max"}).first()[0] < 30


def test_learning_does_not_depend_on_row_order(spark):
    facts = [(1, 0, [5], "公", s, c, "k", t) for s, c, t in (("manual", 1.0, 3), ("local", 0.1, 2), ("model", 0.5, 2), ("local", 0.1, 9))] + [(1, 0, [5], "公", "model", 0.25, "m", 4)]
    none = spark.createDataFrame([], "project_id long, aspect long, sig array<long>, char string, total long, manual long, model long, local long, confidence_sum double, last_seen long, evidence_keys array<string>")
    seen = set()
    for k in range(6):
        random.Random(k).shuffle(facts)
        e = spark.createDataFrame(facts, "project_id long, aspect long, sig array<long>, char string, source string, confidence double, evidence_key string, seen_at long").repartition(3)
        r = M.learn(none, e).first()
        seen.add((r["total"], r["manual"], r["model"], r["local"], round(r["confidence_sum"], 9), r["last_seen"], tuple(r["evidence_keys"])))
    assert seen == {(2, 0, 1, 1, 0.35, 4, ("k", "m"))}


def test_memory_visibility(spark):
    cases = [("a", "a", 0, 0.5, True), ("a", "b", 9, 1.0, False), ("a", None, 2, 0.97, True), ("a", None, 2, 0.969, False), ("a", None, 1, 1.0, False), (None, None, 5, 1.0, False)]
    df = spark.createDataFrame(cases, "g_project string, project_id string, manual long, similarity double, want boolean")
    assert all(r["v"] == r["want"] for r in df.select(M.visible_memory().alias("v"), "want").collect())


def test_learn_is_idempotent_and_keeps_last_keys(spark):
    empty = spark.createDataFrame([], "project_id string, aspect long, sig array<long>, char string, total long, manual long, model long, local long, confidence_sum double, last_seen long, evidence_keys array<string>")
    ev = lambda ks: spark.createDataFrame([("a", 1, [5], "公", "model", 2.0, f"k{k}", k) for k in ks], "project_id string, aspect long, sig array<long>, char string, source string, confidence double, evidence_key string, seen_at long")
    once = M.learn(empty, ev(range(100)), kept=80)
    twice = M.learn(once, ev([*range(90, 103), 99]), kept=80)
    r = twice.first()
    assert (r["total"], r["model"], r["confidence_sum"], r["last_seen"]) == (103, 103, 103.0, 102)
    assert r["evidence_keys"] == [f"k{k}" for k in range(23, 103)]
    # without a limit the oldest evidence stays known
    assert M.learn(M.learn(empty, ev(range(100))), ev([0, 1, 100])).first()["total"] == 101
    assert M.learn(empty, ev([1]).withColumn("char", F.lit("A"))).count() == 0


def test_leader_cluster_matches_sequential_pass(spark):
    rnd = random.Random(4)
    base = [rnd.getrandbits(60) for _ in range(6)]
    sigs = []
    for i in range(150):
        s = base[rnd.randrange(6)]
        for _ in range(rnd.randrange(0, 8)):
            s ^= 1 << rnd.randrange(60)
        sigs.append(s)
    leaders, want = [], {}
    for i, s in enumerate(sigs):
        hit = next((k for k in leaders if (sigs[k] ^ s).bit_count() <= 6), None)
        if hit is None:
            leaders.append(i)
            hit = i
        want[i] = hit
    df = spark.createDataFrame([(1, i, [s]) for i, s in enumerate(sigs)] + [(1, 999, [0])], "page_id long, g long, sig array<long>")
    got = dict(rows(M.leader_cluster(df, ["page_id"], "g", 6, batch=8), "g", "leader"))
    assert got == want


def test_assign_nearest(spark):
    a = spark.createDataFrame([(1, 100 + i, i, 50.0 * i, 50.0) for i in range(4)], "page_id long, glyph_id long, id long, cx double, cy double")
    a = a.selectExpr("*", "cx - 12 AS x0", "cy - 12 AS y0", "cx + 12 AS x1", "cy + 12 AS y1")
    # 0 sits on its anchor; 1 and 2 both near anchor 1; 3 has no coordinates; 9 is far away
    it = [(1, 0, 0, 1.0, 50.0, 0.9, True), (1, 1, 7, 54.0, 50.0, 0.9, True), (1, 2, 8, 59.0, 50.0, 0.99, True), (1, 9, 3, 400.0, 400.0, 0.9, True)]
    i = spark.createDataFrame(it, "page_id long, item_id long, id long, px double, py double, confidence double, valid boolean")
    assert rows(A.assign_nearest(i, a, ["page_id"], 24.0), "item_id", "glyph_id") == [(0, 100), (1, 101)]


def test_spent_exact_items_do_not_compete(spark):
    a = spark.createDataFrame([(1, 100 + i, i, 20.0 * i, 50.0) for i in range(2)], "page_id long, glyph_id long, id long, cx double, cy double")
    a = a.selectExpr("*", "cx - 12 AS x0", "cy - 12 AS y0", "cx + 12 AS x1", "cy + 12 AS y1")
    # both items answer for anchor 0; the later one stays, the earlier one may not take anchor 1
    it = [(1, 0, 0, 7.0, 50.0, 0.99, True), (1, 1, 0, 2.0, 50.0, 0.9, True)]
    i = spark.createDataFrame(it, "page_id long, item_id long, id long, px double, py double, confidence double, valid boolean")
    assert rows(A.assign_nearest(i, a, ["page_id"], 24.0), "item_id", "glyph_id") == [(1, 100)]


def test_merge_boxes_joins_strokes(spark):
    b = [(1, 1, 10.0, 10.0, 20.0, 4.0, 50.0), (1, 2, 10.0, 17.0, 20.0, 4.0, 50.0), (1, 3, 10.0, 24.0, 20.0, 4.0, 50.0), (1, 4, 200.0, 10.0, 20.0, 20.0, 200.0)]
    df = spark.createDataFrame(b, "page_id long, box_id long, x double, y double, w double, h double, area double")
    t = spark.createDataFrame([(1, 400.0, 20.0)], "page_id long, typical_area double, typical_side double")
    got = rows(S.merge_boxes(df, ["page_id"], t), "box_id", "y", "h", "merged")
    assert got == [(1, 10.0, 18.0, True), (4, 10.0, 20.0, False)]


def test_hot_key_is_split_over_tasks(spark):
    """One key with most rows: no task may hold the whole key."""
    n = 40000
    df = spark.range(n).selectExpr("IF(id % 10 < 9, 0, id) AS k", "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = in_order(df, ["k"], ["id"], F.expr("id div 1000"), number="n")
        sizes = [r["c"] for r in out.where("k = 0").groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()]
        assert len(sizes) > 1 and max(sizes) < n * 0.6
        assert out.where("k = 0").agg(F.max("n")).first()[0] == n * 9 // 10
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_free_slots_moves_no_grid(spark):
    """Against brute force over boxes on, between and beyond the places; the grid is never exploded to rows."""
    boxes = [(p, float((p * 37 + i * 53) % 190 - 15), float((p * 91 + i * 29) % 190 - 15), float(8 + i % 60), float(8 + i % 45)) for p in range(4) for i in range(3 + p * 25)]
    boxes += [(4, -500.0, -500.0, 5000.0, 5000.0), (6, 30.0, 30.0, 4.0, 4.0)]  # a full page, and a page without size
    b = spark.createDataFrame([(p, x, y, x + w, y + h) for p, x, y, w, h in boxes], "page_id long, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(p, 170.0, 130.0) for p in range(6)], "page_id long, width double, height double")
    got = L.free_slots(pages, b, ["page_id"], 12.0)
    want = {}
    for p in range(6):
        free = [
            (math.dist((14 + ix * 8, 14 + iy * 8), (85, 65)), iy, ix) for iy in range(13) for ix in range(18)
            if not any(q == p and 8 + ix * 8 < x + w + 6 and x - 6 < 20 + ix * 8 and 8 + iy * 8 < y + h + 6 and y - 6 < 20 + iy * 8 for q, x, y, w, h in boxes)
        ]
        if free:
            want[p] = (14.0 + min(free)[2] * 8, 14.0 + min(free)[1] * 8)
    assert {r["page_id"]: (r["x"], r["y"]) for r in got.collect()} == want and 4 not in want
    assert "explode(sequence" not in got._jdf.queryExecution().optimizedPlan().toString()  # places do not become rows


def test_copies_of_rects_are_met_once(spark, monkeypatch):
    """Sixty copies of two bars and of a zone make one pair and a hit, not thousands; all copies of the bar go."""
    bars = spark.createDataFrame([(1, i, 10.0 * (i % 2) * 20, 10.0, 40.0, 30.0) for i in range(120)], "page_id long, rect_id long, x double, y double, w double, h double")
    zones = spark.createDataFrame([(1, 1000 + i, 2.0, 12.0, 40.0, 30.0) for i in range(60)], bars.schema)
    pairs = []
    whole = L.overlapping
    monkeypatch.setattr(L, "overlapping", lambda *a: pairs.append(whole(*a)) or pairs[-1])
    left = L.outside_zones(bars, zones, ["page_id"], "rect_id")
    assert left.columns == bars.columns and {r["rect_id"] for r in left.collect()} == set(range(1, 120, 2))
    merged = L.spatial_merge(zones, bars, ["page_id"], "rect_id")
    assert sorted(r["rect_id"] for r in merged.collect()) == [*range(1, 120, 2), *range(1000, 1060)]
    assert [p.count() for p in pairs] == [1, 1]
