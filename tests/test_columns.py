import random

import pandas as pd
from conftest import rows
from pyspark.sql import functions as F

from inkframe.operators import columns as C
from inkframe.operators import repair as R
from inkframe.operators.ordered import gap_groups, in_order

G = "page_id long, glyph_id long, text string, cx double, cy double, x0 double, y0 double, x1 double, y1 double, pt double, conf double, note string, source string, edited boolean, grp string, kind string"


def glyph(i, text, cx, cy, side=20.0, page=1, **kw):
    d = dict(pt=0.0, conf=0.3, note="ok", source="llm", edited=False, grp="body", kind="text") | kw
    h = side / 2
    return (page, i, text, float(cx), float(cy), cx - h, cy - h, cx + h, cy + h, d["pt"], d["conf"], d["note"], d["source"], d["edited"], d["grp"], d["kind"])


def frame(spark, data):
    return spark.createDataFrame(data, G)


def med(v):
    v = sorted(v)
    m = len(v) // 2
    return v[m] if len(v) % 2 else (v[m - 1] + v[m]) / 2


def next_fit(vals, tol, span):
    out = []
    for v in sorted(vals):
        if out and v - med(out[-1]) < tol and v - out[-1][0] <= span:
            out[-1].append(v)
        else:
            out.append([v])
    return out


def first_fit(vals, tol):
    out = []
    for v in sorted(vals):
        for c in out:
            if abs(med(c) - v) <= tol:
                c.append(v)
                break
        else:
            out.append([v])
    return out


def ratio(vals, tol, limit):
    out = []
    for v in sorted(vals):
        if out and not (v > med(out[-1]) * (1 + tol) and len(out) < limit):
            out[-1].append(v)
        else:
            out.append([v])
    return out


def test_clusters_match_sequential_pass(spark):
    rnd = random.Random(5)
    data = [(p, i, float(rnd.randrange(0, 400)) / 2) for p in range(3) for i in range(150)]
    df = spark.createDataFrame(data, "page_id long, id long, v double").repartition(7)
    for p in range(3):
        vals = [v for q, _, v in data if q == p]
        for got_df, want in (
            (C.cluster_1d(df, ["page_id"], "v", F.lit(3.0), F.lit(5.0), "c", 16.0), next_fit(vals, 3.0, 5.0)),
            (C.cluster_first_fit(df, ["page_id"], "v", F.lit(2.0), "c", 16.0), first_fit(vals, 2.0)),
            (C.cluster_ratio(df, ["page_id"], "v", 0.15, 4, "c"), ratio(vals, 0.15, 4)),
        ):
            got = {(r["v"], r["c"], r["c_center"]) for r in got_df.where(f"page_id = {p}").collect()}
            assert got == {(v, c[0], med(c)) for c in want for v in c}


def test_clusters_by_key_match_sequential_pass(spark):
    """Folded in the key's own partition, with null values and null keys, in one deal of the rows."""
    rnd = random.Random(6)
    data = [(p, i, None if i % 50 == 7 else float(rnd.randrange(0, 400)) / 2) for p in (0, 1, None) for i in range(150)]
    df = spark.createDataFrame(data, "page_id long, id long, v double").repartition(7)
    for got_df, fold in (
        (C.cluster_1d(df, ["page_id"], "v", F.lit(3.0), F.lit(5.0), "c", by_key=True), lambda vals: next_fit(vals, 3.0, 5.0)),
        (C.cluster_first_fit(df, ["page_id"], "v", F.lit(2.0), "c", by_key=True), lambda vals: first_fit(vals, 2.0)),
    ):
        assert got_df.columns == C.cluster_first_fit(df, ["page_id"], "v", F.lit(2.0), "c").columns
        want = {(None, None, None)}
        got = got_df.collect()
        assert sorted((str(r["page_id"]), r["id"]) for r in got) == sorted((str(p), i) for p, i, _ in data)
        for p in (0, 1, None):
            want = {(v, c[0], med(c)) for c in fold([v for q, _, v in data if q == p and v is not None]) for v in c} | {(None, None, None)}
            assert {(r["v"], r["c"], r["c_center"]) for r in got if r["page_id"] == p} == want


def test_pages_are_dealt_once_for_rows_and_pairs(spark):
    """Clusters, rows of labels and what is judged of them stay in the page's partition: no join, one deal."""
    g = spark.range(400).selectExpr(
        "id % 3 AS page_id", "id AS glyph_id", "CAST(id % 20 * 24 AS DOUBLE) AS cx", "CAST(id div 20 * 26 AS DOUBLE) AS cy", "CAST(id % 20 * 24 - 8 AS DOUBLE) AS x0", "CAST(id div 20 * 26 - 8 AS DOUBLE) AS y0",
        "CAST(id % 20 * 24 + 8 AS DOUBLE) AS x1", "CAST(id div 20 * 26 + 8 AS DOUBLE) AS y1", "'text' AS kind", "'rank' AS grp", "IF(id % 2 = 0, '一', '子') AS text", "0.5D AS conf", "'ok' AS note", "'llm' AS source", "false AS edited",
    )
    for df in (C.detect_pairs(g, ["page_id"]), R.repair_pairs(g, ["page_id"]), C.column_clusters(g, ["page_id"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_few_joins_in_the_structural_pass(spark):
    """Kinds, spacing and heights of pairs are told where a column stands (16 joins in the plan before)."""
    g = spark.range(60).selectExpr(
        "id % 3 AS page_id", "id AS glyph_id", "CAST(id % 20 * 24 AS DOUBLE) AS cx", "CAST(id div 20 * 26 AS DOUBLE) AS cy", "CAST(id % 20 * 24 - 8 AS DOUBLE) AS x0", "CAST(id div 20 * 26 - 8 AS DOUBLE) AS y0",
        "CAST(id % 20 * 24 + 8 AS DOUBLE) AS x1", "CAST(id div 20 * 26 + 8 AS DOUBLE) AS y1", "'text' AS kind", "'rank' AS grp", "0.5D AS conf", "'ok' AS note",
    )
    pages, sides = g.groupBy("page_id").agg(F.max("x1").alias("width")), C.with_side(g, ["page_id"]).select("page_id", "mid_side").distinct()
    out = C.apply_columns(g, pages, ["page_id"], sides, 24.0)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 8


def test_in_order_equals_plain_window(spark):
    rnd = random.Random(3)
    data = [(i % 3, rnd.randrange(0, 1000), i, rnd.randrange(0, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "k long, o long, id long, v long")
    got = in_order(df, ["k"], ["o", "id"], F.expr("o div 50"), number="n", sums={"s": F.col("v")}, previous={"p": "v"}, following={"f": "v"})
    pdf = pd.DataFrame(data, columns=["k", "o", "id", "v"]).sort_values(["k", "o", "id"])
    g = pdf.groupby("k")
    want = pdf.assign(n=g.cumcount() + 1, s=g["v"].cumsum(), p=g["v"].shift(), f=g["v"].shift(-1))
    a = {r["id"]: (r["n"], r["s"], r["p"], r["f"]) for r in got.collect()}
    b = {r.id: (r.n, r.s, None if pd.isna(r.p) else int(r.p), None if pd.isna(r.f) else int(r.f)) for r in want.itertuples()}
    assert a == b


def test_gap_groups_across_chunks(spark):
    df = spark.createDataFrame([(1, v) for v in (0, 1, 2, 9, 10, 11, 12, 30)], "k long, v long")
    got = dict(rows(gap_groups(df, ["k"], "v", F.lit(3), [], F.expr("v div 4")), "v", "band"))
    assert got == {0: 1, 1: 1, 2: 1, 9: 2, 10: 2, 11: 2, 12: 2, 30: 3}


def test_reading_order_and_kind(spark):
    g = frame(spark, [glyph(i, "公", 100 - 40 * c, 20 + 25 * r) for i, (c, r) in enumerate([(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)])])
    sides = spark.createDataFrame([(1, 20.0)], "page_id long, mid_side double")
    cols = C.column_clusters(g, ["page_id"], sides)
    assert [r[1] for r in sorted((r["position"], r["glyph_id"]) for r in C.reading_order(cols, ["page_id"]).collect())] == [0, 1, 2, 3, 4, 5]
    assert {r["col_kind"] for r in C.column_kind(cols, ["page_id"]).collect()} == {"vertical_name"}


def test_deviation_at_the_limit_is_not_even(spark):
    """Gaps that deviate by exactly 8 from their mean, which a merged variance rounds to less than 8."""
    ys = [0.0]
    for gap in (26, 24.5, 52, 26.5, 24.5, 28.5, 23, 26, 28.5, 25.5):
        ys.append(ys[-1] + gap)
    for shift, want in ((0, "mixed"), (0.5, "vertical_name")):  # a gap nearer to the mean lies below the limit
        g = frame(spark, [glyph(i, "公", 50, y - (shift if i >= 3 else 0), side=18.5) for i, y in enumerate(ys)])
        g = g.withColumns({"col": F.lit(0), "mid_side": F.lit(18.5)})
        assert [r["col_kind"] for r in C.column_kind(g, ["page_id"]).collect()] == [want]


def test_spacing_flags_ends_of_wide_gap(spark):
    ys = [0, 25, 50, 75, 125, 150]
    g = frame(spark, [glyph(i, "公", 50, y) for i, y in enumerate(ys)])
    sides = spark.createDataFrame([(1, 20.0)], "page_id long, mid_side double")
    cols = C.column_clusters(g, ["page_id"], sides)
    flagged = rows(C.spacing_anomalies(cols, ["page_id"]))
    # std around the median gap is above 3, so the whole column is flagged
    assert flagged == [(i,) for i in range(6)]


def test_detect_pairs(spark):
    xs = [20, 40, 100, 120]
    g = frame(spark, [glyph(i, "子", x, 50) for i, x in enumerate(xs)]).withColumn("mid_side", F.lit(20.0))
    assert rows(C.detect_pairs(g, ["page_id"]), "first_id", "second_id") == [(0, 1), (2, 3)]
    plain = frame(spark, [glyph(i, "子", 20 + 20 * i, 50) for i in range(6)]).withColumn("mid_side", F.lit(20.0))
    assert C.detect_pairs(plain, ["page_id"]).count() == 0


def test_infer_title(spark):
    def page(p, texts, conf=0.95, x=20, **kw):
        return [glyph(p * 100 + i, c, x, 20 + 30 * i, page=p, conf=conf, grp="title", kind="side", **kw) for i, c in enumerate(texts)]

    def run(data, n):
        pages = spark.createDataFrame([("a", p, p, 400.0) for p in range(1, n + 1)], "project_id string, page_id long, idx long, width double")
        return rows(C.infer_title(frame(spark, data), pages))

    t = "倪氏宗譜"
    assert run(page(1, t) + page(2, t), 2) == [("a", t, 2)]
    assert run(page(1, t), 1) == []
    assert run(page(1, t) + page(2, "王氏宗譜"), 2) == []
    assert run(page(1, t) + page(2, t) + page(3, "王氏宗譜"), 3) == [("a", t, 2)]
    assert run(page(1, t) + page(1, t, x=120) + page(2, "王"), 2) == []
    weak = page(1, t) + page(2, t)
    weak[-1] = glyph(203, "譜", 20, 110, page=2, conf=0.4, grp="title", kind="side")
    assert run(weak, 2) == []
    weak[-1] = glyph(203, "譜", 20, 110, page=2, conf=0.4, grp="title", kind="side", edited=True)
    assert run(weak, 2) == [("a", t, 2)]
    assert run(page(1, t, x=300) + page(2, t, x=300), 2) == []


def test_repair_pairs(spark):
    def pair(a, b, ca=0.3, cb=0.3, **kw):
        g = [glyph(0, a, 20, 50, conf=ca, grp="rank", **kw), glyph(1, b, 42, 50, conf=cb, grp="rank")]
        return [r[1] for r in rows(R.repair_pairs(frame(spark, g), ["page_id"]), "glyph_id", "text")]

    assert pair("次", None) == ["次", "子"]
    assert pair("一", "子", 0.9) == ["三", "子"]
    assert pair("长", "孑", 0.9, 0.9) == ["長", "子"]
    assert pair("次", "女", 0.9, 0.9) == ["次", "女"]
    assert pair("人", None, 0.9) == ["人", None]
    assert pair("一", "子", 0.9, edited=True) == ["一", "子"]


def test_fill_tails(spark):
    sur = spark.createDataFrame([("周",), ("金",), ("公",)], "dict_char string")

    def run(data):
        return dict(rows(R.fill_tails(frame(spark, data), ["page_id"], sur), "glyph_id", "text"))

    # two columns end in 公, the third tail is empty
    cols = [glyph(10 * c + r, t, 40 + 60 * c, 20 + 25 * r, conf=0.95) for c, texts in enumerate(["善公", "文公"]) for r, t in enumerate(texts)]
    third = [glyph(20, "德", 160, 20, conf=0.95), glyph(21, None, 160, 45, conf=0.0)]
    assert run(cols + third)[21] == "公"
    # with only one 公 nothing is written
    assert run(cols[:2] + third)[21] is None
    # a surname to the left makes it a 氏 place
    left = [glyph(30, "文", 136, 20, conf=0.95), glyph(31, "周", 136, 45, conf=0.95)]
    assert run(third + left)[21] == "氏"
    # a confident other glyph is never touched
    third2 = [glyph(20, "德", 160, 20, conf=0.95), glyph(21, "山", 160, 45, conf=0.9)]
    assert run(cols + third2)[21] == "山"


def test_repair_titles(spark):
    g = [glyph(i, c, 20, 20 + 25 * i, grp="title", kind="side", conf=0.9) for i, c in enumerate(["一", "世", "祖"])]
    assert rows(R.repair_titles(frame(spark, g), ["page_id"]), "glyph_id", "text")[0] == (0, "三")
    t = spark.createDataFrame([(1, "王氏宗譜")], "page_id long, title string")
    g = [glyph(i, c, 20, 20 + 25 * i, grp="title", kind="side", conf=0.3) for i, c in enumerate(["王", None, "宗", "X"])]
    assert [r[1] for r in rows(R.repair_titles(frame(spark, g), ["page_id"], t), "glyph_id", "text")] == list("王氏宗譜")
    g = [glyph(i, c, 20, 20 + 25 * i, grp="title", kind="side", conf=0.3) for i, c in enumerate(["王", None, "A", "B"])]
    assert rows(R.repair_titles(frame(spark, g), ["page_id"], t), "glyph_id", "text")[1] == (1, None)


def test_calibrate_groups_by_height(spark):
    g = [glyph(i, "公", 20 * i, 0, side=20) for i in range(6)] + [glyph(10 + i, "公", 20 * i, 60, side=30) for i in range(3)] + [glyph(20, "一", 0, 200, side=8, grp="pageno", kind="side")]
    p = spark.createDataFrame([(1, 10.0)], "page_id long, px_per_mm double")
    got = {r["glyph_id"]: (r["grp"], r["pt"]) for r in R.calibrate(frame(spark, g), p, ["page_id"]).collect()}
    body, title = int(20 / 10 / 0.352778 * 10 + 0.5) / 10, int(30 / 10 / 0.352778 * 10 + 0.5) / 10
    assert got[0] == ("body", body) and got[10] == ("title", title) and got[20] == ("pageno", body)
    over = {r["glyph_id"]: r["pt"] for r in R.calibrate(frame(spark, g), p, ["page_id"], overrides={"title": 33.0}).collect()}
    assert over[10] == 33.0
