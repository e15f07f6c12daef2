"""Steps on glyphs move a page once, and answer as brute force does."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_columns import frame, glyph, med

from inkframe.catalog import logs, matching, ordering
from inkframe.functions import dictionaries as D
from inkframe.llm import language_ratio
from inkframe.operators import columns as C
from inkframe.operators import memory as M
from inkframe.operators import repair as R
from inkframe.operators import structure as T
from inkframe.session import spread
from inkframe.sources import projects, scripts


def moves(df):
    """How often rows are dealt by a key in the plan of df."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_neighbours_in_rows(spark):
    rnd = random.Random(7)
    data = [glyph(page * 1000 + i, rnd.choice("氏公"), rnd.randrange(-60, 700) / 2, rnd.randrange(-60, 500) / 2, side=rnd.choice([0, 16, 20, 25]), page=page) for page in (1, 2) for i in range(250)]
    data += [glyph(9000 + i, "氏", 30.0 * i, 0, side=0, page=3) for i in range(5)]
    want = []
    for page in (1, 2, 3):
        own = [g for g in data if g[0] == page]
        w, h = med([g[7] - g[5] for g in own]) or 20.0, med([g[8] - g[6] for g in own]) or 20.0
        want += [(page, a[1], b[1], b[3] - a[3], b[2]) for a in own for b in own if a[1] != b[1] and abs(b[4] - a[4]) <= h * 0.45 and w * 0.35 < abs(b[3] - a[3]) <= w * 1.6]
    got = C.row_neighbours(frame(spark, data), ["page_id"], other=["text"])
    assert rows(got) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r)) and len(want) > 500
    odd = C.row_neighbours(frame(spark, data), ["page_id"], F.col("glyph_id") % 2 == 1)
    assert sorted(tuple(r)[:3] for r in odd.collect()) == sorted(r[:3] for r in want if r[1] % 2)


def test_neighbours_move_pages_once(tables):
    assert moves(ordering.j15(tables)) == 1


@pytest.mark.parametrize("query", [ordering.w5, ordering.w6, ordering.w7, ordering.w8])
def test_columns_move_pages_once(tables, query):
    """Pages are dealt once for the medians, the kinds and the targets of all columns."""
    assert moves(query(tables)) == 1


def test_given_kinds_snap_as_found_ones(tables):
    g = ordering.lane(tables)
    given = C.snap_columns(g, ["page_id"], C.column_kind(g, ["page_id"]))
    assert given.columns == g.columns
    assert rows(given, "glyph_id", "cx", "cy", "x0", "y1") == rows(ordering.w8(tables))


def test_characters_do_not_meet_by_key(tables):
    """A dictionary of characters goes to the items: items with one character, or none, do not meet in one task."""
    plan = ordering.q10(tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


@pytest.mark.parametrize("most", [0, 1000])
def test_trusted_rows_by_blocks_of_ids(spark, most):
    """Labelled ids go to the texts in blocks, also where tables are never broadcast by their size."""
    ids = [None, None, -1, -64, -65, 0, 1, 63, 64, 65, 127, 128, 10**12, 10**12 + 1, 2**62, 7, 7]
    docs = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    fit = [-1, -65, 0, 63, 64, 127, 10**12, 2**62, 7, 5]
    sample = spark.createDataFrame([(i, 1, True) for i in fit] + [(1, 0, True), (65, 1, False)], "doc_id long, clean int, fit boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = language_ratio.with_trusted(docs, sample, most)
        assert ("SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()) == (most == 0)
        assert rows(got) == rows(spark.createDataFrame([(i, f"t{k}", 1 if i in fit else None) for k, i in enumerate(ids)], "doc_id long, text string, trusted int"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_open_cells_ask_for_neighbours(spark, monkeypatch):
    """Of a page, only cells without text and unsure tails look for neighbours."""
    data = [glyph(10 * c + r, t, 40 + 60 * c, 20 + 25 * r, conf=0.95 if t else 0.0) for c, texts in enumerate([["善", "公"], ["文", "公"], ["德", None]]) for r, t in enumerate(texts)]
    asked = []

    def watch(g, keys, seek, other):
        asked.extend(r[0] for r in g.where(seek).select("glyph_id").collect())
        return C.row_neighbours(g, keys, seek, other)

    monkeypatch.setattr(R, "row_neighbours", watch)
    sur = spark.createDataFrame([("周",)], "dict_char string")
    assert dict(rows(R.fill_tails(frame(spark, data), ["page_id"], sur), "glyph_id", "text"))[21] == "公"
    assert asked == [21]


def test_copies_of_line_ends_are_looked_at_once(spark, monkeypatch):
    """Ends of one place are searched for one circle, and the least id of them names it."""
    runs = spark.createDataFrame([(1, y, x, x + 3) for y in range(30, 52) for x in (50, 67)], "page_id long, y long, x0 long, x1 long")
    runs = runs.union(spark.createDataFrame([(1, y, 50, 70) for y in (30, 31, 50, 51)], runs.schema))
    sizes = spark.createDataFrame([(1, 120, 160)], "page_id long, width long, height long")
    line = lambda i: (1, i, 60.0, 52.0, 60.0, 120.0, 3.0, "v")
    schema = "page_id long, line_id long, x1 double, y1 double, x2 double, y2 double, width_px double, orientation string"
    seen = []

    def watch(df, *cols):
        seen.append(df.count())
        return spread(df, *cols)

    monkeypatch.setattr(T, "spread", watch)
    alone = [T.detect_nodes(runs, spark.createDataFrame([line(i)], schema), sizes).collect() for i in range(5)]
    copies = T.detect_nodes(runs, spark.createDataFrame([line(i) for i in range(5)], schema), sizes).collect()
    assert set(seen) == {seen[0]} and seen[0] > 20
    assert copies == min(alone, key=lambda r: r[0]["node_id"]) and len(copies) == 1


def test_documents_are_read_and_dealt_once(tables):
    """All that stands on a page moves once to be written, and a document is parsed once for all its tables."""
    docs = projects.page_documents(logs.project_tables(tables), logs.APP)
    assert moves(docs) == 1
    plan = logs.s34(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    made = docs.union(docs.limit(1).selectExpr("project_id", "idx", "'{}' AS json")).union(docs.limit(1).selectExpr("project_id", "idx", "replace(json, '\"version\":\"2.0\"', '\"version\":\"3.0\"') AS json"))
    t, bad = projects.parse_projects(made, logs.APP)
    assert bad.count() == 2
    got = projects.project_numbers(made, logs.APP)
    want = t["glyph"].selectExpr("project_id", "idx", "ord", "array(x0, y0, x1, y1) AS v").where("idx = 0")
    assert rows(got.where("tbl = 'glyph'").select("project_id", "idx", "ord", "v").exceptAll(want)) == [] and got.where("tbl = 'glyph'").count() == want.count()
    for name, first in {"rect": "x", "line": "x1", "node": "cx", "artifact": "x1"}.items():
        assert got.where(f"tbl = '{name}'").selectExpr("count(1)", "sum(v[0])").first() == t[name].selectExpr("count(1)", f"sum({first})").first()


def test_candidates_of_a_glyph_are_ranked_in_place(spark, tables):
    """Candidates that stand with their glyph are not dealt, and rank as rows of candidates do."""
    assert moves(ordering.q8(tables)) == 0
    rnd = random.Random(3)
    data = [(i, rnd.choice("世祖公") + str(k), k, rnd.choice([None, 0.2, 0.5, 0.53, 0.9]), f"世{rnd.randrange(3)}", rnd.choice([None, 1, 3])) for i in range(200) for k in range(rnd.randrange(1, 6))]
    scored = spark.createDataFrame(data, "glyph_id long, char string, ord int, score double, primary string, route_votes long")
    held = scored.groupBy("glyph_id").agg(F.collect_list(F.struct("char", "ord", "score", "primary", "route_votes")).alias("scored"))
    got = R.rank_candidates(held)
    assert rows(got) == rows(R.verify_candidates(scored)) and got.count() == 200
    for r in got.collect():
        own = sorted((d for d in data if d[0] == r["glyph_id"]), key=lambda d: (d[3] is None, -(d[3] or 0), d[2]))
        assert r["candidates"] == ",".join(d[1] for d in own[:3]) and r["top_score"] == own[0][3]


def test_peers_are_listed_once(spark):
    """The peers of a character are looked up as a list; nothing is split for each row."""
    df = spark.createDataFrame([("干", ["子", "x"]), (None, ["人", "", "人"]), ("公", None), ("ab", ["于"])], "c string, more array<string>")
    got = D.expand_candidates(df, "c", "more")
    assert "split(" not in got._jdf.queryExecution().optimizedPlan().toString()
    peers = dict(D._peer_rows())
    want = [list(dict.fromkeys(first + [p for c in first for p in peers.get(c, "")]))[:8] for first in (["干", "子"], ["人"], ["公"], ["于"])]
    assert [r["expanded"] for r in got.collect()] == want


def test_side_and_text_glyphs_are_emitted_in_one_pass(spark, tables):
    """Both kinds of glyph are numbered together: once for the rows and once for the counts of their blocks."""
    assert logs.s6(tables)._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode(") == 4
    g = spark.createDataFrame([(1, 1, i, t, 1.0, 2.5, 10.0, k) for i, (t, k) in enumerate([("a\\\"", "side"), (None, "text"), ("公", "side"), ("b", None), ("\n", "text")])], "page_id long, page_no long, ord long, text string, cx double, cy double, pt double, kind string")
    got = rows(scripts.emit_rows({"glyph": g}), "section", "n", "line")
    assert got == [
        ("SIDE_CHARS", 0, '    ("a\\\\\\"", 1, 2.5, 10, "P1_S0000"),'), ("SIDE_CHARS", 1, '    ("公", 1, 2.5, 10, "P1_S0001"),'),
        ("TEXT_CHARS", 0, '    (None, 1, 2.5, 10, "P1_C0000"),'), ("TEXT_CHARS", 1, '    ("\\x0a", 1, 2.5, 10, "P1_C0001"),'),
    ]
    many = spark.range(998, 1003).select(F.lit(1).alias("page_id"), F.lit(1).alias("page_no"), F.col("id").alias("ord"), *[F.lit(-0.5).alias(c) for c in "xywh"])
    assert [r["line"][-13:] for r in scripts.emit_rows({"tag": many}).orderBy("n").collect()] == [f'5, "P1_T00{i}"),' [-13:] for i in range(5)]


def test_title_columns_read_pages_once(tables):
    """Of a page only the large glyphs at its edge go on; the steps after them do not read the page again."""
    assert "posexplode" not in ordering.w10(tables)._jdf.queryExecution().optimizedPlan().toString()


def test_look_alikes_move_once(spark, tables):
    """A cluster moves once; glyphs without a cluster are no cluster."""
    assert moves(matching.q5(tables)) == 1
    g = [(1, 1, "世", 0.9), (1, 2, None, 0.1), (1, 3, "祖", 0.4), (None, 4, "世", 0.9), (None, 5, None, 0.1), (2, 6, "世", 0.9), (2, 7, "公", 0.9), (2, 8, None, 0.1)]
    df = spark.createDataFrame([(*r, False, "llm", False, True) for r in g], "c long, glyph_id long, text string, conf double, edited boolean, source string, in_dict boolean, is_target boolean")
    got = {r["glyph_id"]: (r["text"], r["improved"]) for r in M.propagate(df, ["c"]).collect()}
    assert got == {1: ("世", False), 2: ("世", True), 3: ("世", True), 4: ("世", False), 5: (None, False), 6: ("世", False), 7: ("公", False), 8: (None, False)}
