"""Consensus, weighted votes, anchors, batching, budget and cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkframe import bindings as B
from inkframe.catalog import query
from inkframe.catalog.sql import with_
from inkframe.operators import anchors as N
from inkframe.operators import review as R
from inkframe.operators import votes as V

KEYS = B.VOTE_KEYS
LATIN = "a-zA-Z"
ANY = "a-z"  # event names take the place of single glyphs

_AL = """SELECT user_id, day, item, max(char) FILTER (WHERE round = 1) AS c1, max(char) FILTER (WHERE round = 2) AS c2, max(char) FILTER (WHERE round = 3) AS c3,
   coalesce(max(confidence) FILTER (WHERE round = 1), 0) AS f1, coalesce(max(confidence) FILTER (WHERE round = 2), 0) AS f2, coalesce(max(confidence) FILTER (WHERE round = 3), 0) AS f3
   FROM vote GROUP BY 1, 2, 3"""
_LONG = """SELECT user_id, day, item, 1 AS r, c1 AS c, f1 AS f FROM al UNION ALL SELECT user_id, day, item, 2, c2, f2 FROM al UNION ALL SELECT user_id, day, item, 3, c3, f3 FROM al"""
_LEAD = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day, item ORDER BY n DESC, fc DESC, fr) AS k
   FROM (SELECT user_id, day, item, c, count(*) AS n, arg_min(f, r) AS fc, min(r) AS fr, sum(f) AS sf FROM lng GROUP BY 1, 2, 3, 4)) WHERE k = 1"""
_CONS = """SELECT l.user_id, l.day, l.item, CASE WHEN n >= 2 THEN c END AS char,
   CASE WHEN n < 2 OR c IS NULL THEN CAST(0 AS DOUBLE) WHEN n = 3 THEN least(0.99, greatest(0.93, m)) ELSE least(0.94, greatest(0.85, m - 0.03)) END AS confidence,
   CASE WHEN c IS NULL THEN 'empty' WHEN n < 2 THEN 'blurry' ELSE 'ok' END AS note, n AS agree,
   array_to_string(list_filter([CASE WHEN c1 IS DISTINCT FROM c THEN c1 END, CASE WHEN c2 IS DISTINCT FROM c AND c2 IS DISTINCT FROM c1 THEN c2 END,
     CASE WHEN c3 IS DISTINCT FROM c AND c3 IS DISTINCT FROM c1 AND c3 IS DISTINCT FROM c2 THEN c3 END], lambda x: x IS NOT NULL), ',') AS candidates
   FROM (SELECT *, CASE n WHEN 3 THEN (f1 + f2 + f3) / 3 ELSE sf / n END AS m FROM lead_ JOIN al USING (user_id, day, item)) l"""


def rnd(c):
    return F.floor(F.col(c) * 1e9 + 0.5) / 1e9


def consensus_sql(body: str) -> str:
    return with_("vote", body, al=_AL, lng=_LONG, lead_=_LEAD, cons=_CONS)


@query(
    "a1_consensus",
    consensus_sql("SELECT user_id, day, item, char, floor(confidence * 1000000000 + 0.5) / 1000000000 AS confidence, note, agree, candidates FROM cons"),
)
def a1(t):
    c = V.consensus(B.votes(t), KEYS)
    return c.withColumns({"confidence": rnd("confidence"), "candidates": F.array_join("candidates", ",")})


@query(
    "j2_align_rounds",
    with_("vote", "SELECT user_id, day, item, c1 AS char_1, f1 AS conf_1, c2 AS char_2, f2 AS conf_2, c3 AS char_3, f3 AS conf_3 FROM al", al=_AL),
)
def j2(t):
    a = V.align_rounds(B.votes(t), KEYS)
    return a.select(*KEYS, *[c for r in (1, 2, 3) for c in (F.col(f"char_{r}"), F.coalesce(f"conf_{r}", F.lit(0.0)).alias(f"conf_{r}"))])


@query(
    "a2_vote_count",
    consensus_sql("SELECT user_id, day, item, c.char, count(v.round) AS votes FROM cons c LEFT JOIN vote v USING (user_id, day, item) WHERE v.char IS NOT DISTINCT FROM c.char OR v.round IS NULL GROUP BY 1, 2, 3, 4 UNION ALL SELECT user_id, day, item, c.char, 0 FROM cons c WHERE NOT EXISTS (SELECT 1 FROM vote v WHERE v.user_id = c.user_id AND v.day = c.day AND v.item = c.item AND v.char IS NOT DISTINCT FROM c.char)"),
)
def a2(t):
    v = B.votes(t)
    return V.vote_count(v, V.consensus(v, KEYS), KEYS)


@query(
    "a3_defer_incomplete",
    with_(
        "vote",
        """SELECT user_id, day, item, CAST(NULL AS VARCHAR) AS char, CAST(0 AS DOUBLE) AS confidence, CASE WHEN c1 IS NULL THEN 'empty' ELSE 'blurry' END AS note,
        coalesce(c1, '') AS candidates FROM al JOIN (SELECT user_id, day, item FROM vote GROUP BY 1, 2, 3 HAVING count(*) < 3) USING (user_id, day, item)""",
        al=_AL,
    ),
)
def a3(t):
    d = V.defer_incomplete(B.votes(t), KEYS)
    return d.withColumn("candidates", F.array_join("candidates", ","))


_W = "CASE WHEN orientation = 'horizontal' THEN CASE WHEN engine = 'normal' THEN 1.35 ELSE 0.9 END ELSE CASE WHEN engine = 'normal' THEN 1.0 ELSE 1.25 END END"


@query(
    "a4_weighted_vote",
    with_(
        "pass",
        """SELECT user_id, week, max(char) FILTER (WHERE k = 1) AS char, floor(least(0.98, greatest(0, 0.25 + max(n) FILTER (WHERE k = 1) / any_value(total) * 0.55
        + max(cs / n) FILTER (WHERE k = 1) * 0.2)) * 1000000000 + 0.5) / 1000000000 AS confidence, string_agg(char, ',' ORDER BY k) FILTER (WHERE k <= 3) AS candidates, max(n) FILTER (WHERE k = 1) AS agreeing, any_value(total) AS total
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, week ORDER BY score DESC, first) AS k FROM
          (SELECT user_id, week, char, sum(w + confidence) AS score, count(*) AS n, sum(confidence) AS cs, min(pass) AS first FROM p WHERE char IS NOT NULL GROUP BY 1, 2, 3)
          JOIN (SELECT user_id, week, count(*) AS total FROM p GROUP BY 1, 2) USING (user_id, week)) GROUP BY 1, 2
        UNION ALL SELECT user_id, week, NULL, CAST(0 AS DOUBLE), '', 0, count(*) FROM p GROUP BY 1, 2 HAVING count(char) = 0""",
        p=f"SELECT *, CAST({_W} AS DOUBLE) AS w FROM pass",
    ),
)
def a4(t):
    w = V.weighted_vote(_single(B.passes(t)), B.PASS_KEYS, "a-z")
    name = F.transform("candidates", lambda c: _full(c))
    return w.select("user_id", "week", _full(F.col("char")).alias("char"), rnd("confidence").alias("confidence"), F.array_join(name, ",").alias("candidates"), "agreeing", "total")


NAMES = {"v": "view", "c": "click", "s": "signup", "p": "purchase"}


def _single(p):
    return p.withColumn("char", F.substring("char", 1, 1))


def _full(c):
    out = F.lit(None).cast("string")
    for k, v in NAMES.items():
        out = F.when(c == k, v).otherwise(out)
    return out


@query(
    "a5_stable_prefix",
    with_(
        "pass",
        """SELECT user_id, week, count(*) AS kept, max(pass) AS last_pass, max(stop) AS stop FROM pass
        LEFT JOIN (SELECT user_id, week, min(pass) AS stop FROM g WHERE pass >= 6 AND n_top / pass >= 0.6 AND s1 - coalesce(s3, -1e9) >= 0.5 GROUP BY 1, 2) USING (user_id, week)
        WHERE stop IS NULL OR pass <= stop GROUP BY 1, 2""",
        p=f"SELECT *, CAST({_W} AS DOUBLE) + confidence AS w FROM pass",
        r="""SELECT a.user_id, a.week, a.pass, b.char, count(*) AS n, sum(b.w) AS s FROM p a JOIN p b ON a.user_id = b.user_id AND a.week = b.week AND b.pass <= a.pass AND b.char IS NOT NULL GROUP BY 1, 2, 3, 4""",
        k="SELECT *, row_number() OVER (PARTITION BY user_id, week, pass ORDER BY s DESC) AS k FROM r",
        g="SELECT user_id, week, pass, max(n) FILTER (WHERE k <= 2) AS n_top, max(s) FILTER (WHERE k = 1) AS s1, max(s) FILTER (WHERE k = 3) AS s3 FROM k GROUP BY 1, 2, 3",
    ),
)
def a5(t):
    p = _single(B.passes(t))
    kept = V.stable_prefix(p, B.PASS_KEYS, F.expr("pass div 1024"), "a-z")
    return kept.groupBy("user_id", "week").agg(F.count(F.lit(1)).alias("kept"), F.max("pass").alias("last_pass"), F.max("stop").alias("stop"))


@query(
    "k1_topk_margin",
    with_(
        "pass",
        """SELECT user_id, week, max(char) FILTER (WHERE k = 1) AS top, max(s) FILTER (WHERE k = 1) AS top_score, max(s) FILTER (WHERE k = 1) - coalesce(max(s) FILTER (WHERE k = 2), 0) AS margin,
        string_agg(char, ',' ORDER BY k) FILTER (WHERE k <= 3) AS best FROM (SELECT *, row_number() OVER (PARTITION BY user_id, week ORDER BY s DESC, char) AS k FROM
        (SELECT user_id, week, char, max(confidence) AS s FROM pass WHERE char IS NOT NULL GROUP BY 1, 2, 3)) GROUP BY 1, 2""",
    ),
)
def k1(t):
    s = B.passes(t).where("char is not null").groupBy("user_id", "week", "char").agg(F.max("confidence").alias("s"))
    return V.topk_margin(s, ["user_id", "week"], "char", "s", 3)


@query(
    "j3_cross_validate",
    """SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN d.t ELSE l.quality || '' END AS text,
       CASE WHEN l.doc_id IS NULL THEN d.c WHEN l.toxic <> l.quality THEN CAST(0 AS DOUBLE) ELSE least(0.9, 0.8) END AS conf,
       CASE WHEN l.doc_id IS NOT NULL AND l.toxic <> l.quality THEN 'blurry' ELSE 'ok' END AS note
       FROM (SELECT doc_id, '0' AS t, CAST(0.9 AS DOUBLE) AS c FROM documents) d LEFT JOIN labels l USING (doc_id)""",
)
def j3(t):
    q = t.labels.select("doc_id", F.col("quality").cast("string").alias("q"))
    a = t.documents.select("doc_id").join(q, "doc_id", "left").select("doc_id", F.coalesce("q", F.lit("0")).alias("text"), F.lit(0.9).alias("conf"), F.lit("ok").alias("note"))
    b = t.labels.select("doc_id", F.col("toxic").cast("string").alias("text"), F.lit(0.8).alias("conf"))
    return V.cross_validate(a, b, ["doc_id"]).select("doc_id", "text", "conf", "note")


@query(
    "j1_apply_patch",
    consensus_sql(
        """SELECT user_id, day, item, CASE WHEN c.note = 'ok' THEN c.char ELSE c1 END AS char, CASE WHEN c.note = 'ok' THEN floor(c.confidence * 1000000000 + 0.5) / 1000000000 ELSE floor(f1 * 1000000000 + 0.5) / 1000000000 END AS confidence,
        CASE WHEN c.note = 'ok' THEN c.agree END AS agree FROM al JOIN cons c USING (user_id, day, item)"""
    ),
)
def j1(t):
    v = B.votes(t)
    base = V.align_rounds(v, KEYS).select(*KEYS, F.col("char_1").alias("char"), F.coalesce("conf_1", F.lit(0.0)).alias("confidence"))
    patch = V.consensus(v, KEYS).where("note = 'ok'").select(*KEYS, "char", "confidence", "agree")
    return R.apply_patch(base, patch, KEYS).withColumn("confidence", rnd("confidence"))


@query(
    "f2_review_queue",
    with_(
        "glyph",
        """SELECT page_id, glyph_id, conf, note, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY glyph_id) AS rank FROM glyph
        WHERE conf < 0.85 OR note IN ('split', 'merge', 'spacing')) WHERE rank <= 50""",
    ),
)
def f2(t):
    """The report lists the first fifty glyphs of a page."""
    return R.review_queue(B.glyphs(t), ["page_id"], limit=50).select("page_id", "glyph_id", "conf", "note", "rank")


@query(
    "q9_guard_consensus",
    consensus_sql(
        """SELECT user_id, day, item, CASE WHEN clash THEN NULL ELSE coalesce(c2, c1) END AS text, CASE WHEN clash THEN CAST(0 AS DOUBLE) ELSE f2 END AS conf, CASE WHEN clash THEN 'blurry' ELSE 'ok' END AS note
        FROM (SELECT *, agree >= 2 AND c2 IS NOT NULL AND c2 IS DISTINCT FROM char AS clash FROM (SELECT a.*, c.char, c.agree FROM al a JOIN cons c USING (user_id, day, item)))"""
    ).replace("coalesce(c2, c1)", "coalesce(c2, char)"),
)
def q9(t):
    v = B.votes(t)
    a = V.align_rounds(v, KEYS)
    c = V.consensus(v, KEYS).select(*KEYS, F.col("char").alias("primary"), F.col("agree").alias("route_votes"))
    j = c.join(a, KEYS).withColumns({"verified": F.col("char_2"), "verified_conf": F.coalesce("conf_2", F.lit(0.0)), "verified_note": F.lit("ok")})
    return V.guard_consensus(j).select(*KEYS, "text", "conf", "note")


# --- anchors: the glyphs of a page and one recognised item per event of the same page id ---
_ANCHOR = """SELECT p_partkey // 40 AS page_id, p_partkey AS glyph_id, p_partkey % 40 AS id, CAST(p_partkey * 37 % 1500 AS DOUBLE) AS cx, CAST(p_partkey * 91 % 1500 AS DOUBLE) AS cy,
   CAST(20 + p_partkey % 30 AS DOUBLE) AS bw, CAST(20 + p_partkey % 17 AS DOUBLE) AS bh FROM part"""
_ITEM = """SELECT c.* FROM (SELECT event_id AS item_id, event_id % (SELECT count(*) FROM part) // 40 AS page_id, event_id % 40 AS id, CASE WHEN event_type <> 'error' THEN event_type END AS char, value / 500 AS confidence,
   CASE WHEN event_type = 'view' THEN 'ok' END AS note, (event_id % 40 + event_id % (SELECT count(*) FROM part) // 40 * 40) AS g, event_id FROM events) c"""


def anchors(t):
    a = t.part.selectExpr(
        "p_partkey div 40 AS page_id", "p_partkey AS glyph_id", "p_partkey % 40 AS id", "CAST(p_partkey * 37 % 1500 AS DOUBLE) AS cx",
        "CAST(p_partkey * 91 % 1500 AS DOUBLE) AS cy", "CAST(20 + p_partkey % 30 AS DOUBLE) AS bw", "CAST(20 + p_partkey % 17 AS DOUBLE) AS bh",
    )
    return a.selectExpr("page_id", "glyph_id", "id", "cx", "cy", "cx - bw / 2 AS x0", "cy - bh / 2 AS y0", "cx + bw / 2 AS x1", "cy + bh / 2 AS y1")


def items(t):
    """One recognised item per event, near the box of its id (every third far off)."""
    n = t.part.agg(F.count(F.lit(1))).scalar()
    return t.events.withColumn("np", n).selectExpr(
        "event_id AS item_id", "event_id % np div 40 AS page_id", "event_id % 40 AS id", "CASE WHEN event_type <> 'error' THEN event_type END AS char",
        "value / 500 AS confidence", "CASE WHEN event_type = 'view' THEN 'ok' END AS note",
        "((event_id % np div 40 * 40 + event_id % 40) * 37 % 1500 + IF(event_id % 3 = 0, 60, event_id % 13) * 1D) / 1500 AS rx",
        "((event_id % np div 40 * 40 + event_id % 40) * 91 % 1500 + event_id % 7 * 1D) / 1500 AS ry",
        "1500D AS width", "1500D AS height",
    )


_ITEMS = """SELECT *, ((page_id * 40 + id) * 37 % 1500 + CASE WHEN item_id % 3 = 0 THEN 60 ELSE item_id % 13 END) / CAST(1500 AS DOUBLE) AS rx,
   ((page_id * 40 + id) * 91 % 1500 + item_id % 7) / CAST(1500 AS DOUBLE) AS ry FROM (SELECT item_id, page_id, id, char, confidence, note FROM it0)"""
_BOX = "SELECT *, cx - bw / 2 AS x0, cy - bh / 2 AS y0, cx + bw / 2 AS x1, cy + bh / 2 AS y1 FROM an0"


def anchor_sql(body: str, **extra: str) -> str:
    return with_("", body, an0=_ANCHOR, an=_BOX, it0=_ITEM, it=_ITEMS, **extra)


@query(
    "j6_fix_drift",
    anchor_sql(
        """SELECT item_id, CASE WHEN far THEN floor(cx / 1500 * 10000 + 0.5) / 10000 ELSE rx END AS rx, CASE WHEN far THEN floor(cy / 1500 * 10000 + 0.5) / 10000 ELSE ry END AS ry, far AS moved
        FROM (SELECT *, coalesce(sqrt((rx * 1500 - cx) * (rx * 1500 - cx) + (ry * 1500 - cy) * (ry * 1500 - cy)) > greatest(mid * 1.6, 16), false) AS far
        FROM it LEFT JOIN an USING (page_id, id) LEFT JOIN (SELECT page_id, median((x1 - x0 + (y1 - y0)) / 2) AS mid FROM an GROUP BY 1) USING (page_id))"""
    ),
)
def j6(t):
    a = anchors(t)
    return N.fix_drift(items(t), a, ["page_id"], N.median_side(a, ["page_id"])).select("item_id", "rx", "ry", "moved")


_BEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, id ORDER BY confidence DESC, item_id) AS k FROM it) WHERE k = 1"


@query(
    "j4_match_by_id",
    anchor_sql(
        """SELECT glyph_id, a.id, item_id, char, confidence FROM an a JOIN best b USING (page_id, id) WHERE glyph_id NOT IN (SELECT ps_part FROM sk)""",
        best=_BEST,
        sk="SELECT DISTINCT l_partkey AS ps_part FROM lineitem WHERE l_quantity = 50",
    ),
)
def j4(t):
    skip = t.lineitem.where("l_quantity = 50").select(F.col("l_partkey").alias("glyph_id")).distinct()
    return N.match_by_id(items(t), anchors(t), skip, ["page_id"], "item_id").select("glyph_id", "id", "item_id", "char", "confidence")


@query(
    "j5_densify_ids",
    anchor_sql(
        """SELECT c.page_id, c.id, b.char, coalesce(b.confidence, 0) AS confidence, CASE WHEN b.item_id IS NULL THEN 'empty' ELSE b.note END AS note
        FROM (SELECT page_id, unnest(range(0, n)) AS id FROM (SELECT page_id, count(*) + 3 AS n FROM an GROUP BY 1)) c
        LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, id ORDER BY confidence DESC, item_id DESC) AS k FROM it) WHERE k = 1) b USING (page_id, id)"""
    ),
)
def j5(t):
    n = anchors(t).groupBy("page_id").agg((F.count(F.lit(1)) + 3).alias("n"))
    return N.densify_ids(items(t).drop("rx", "ry", "width", "height"), n, ["page_id"], "item_id")


_AC = """CASE WHEN d > side * 0.48 THEN least(c2, 0.55) ELSE c2 END"""
_MATCHED = """SELECT *, CASE WHEN d > side * 0.2 THEN least(c1, c1 * (1 - least(0.35, (d - side * 0.2) / side))) ELSE c1 END AS c2 FROM (
   SELECT *, CASE WHEN other THEN least(confidence, confidence * 0.9) ELSE confidence END AS c1 FROM (
   SELECT item_id, glyph_id, char, note, confidence, item_id % 5 = 0 AS other, sqrt((rx * 1500 - cx) * (rx * 1500 - cx) + (ry * 1500 - cy) * (ry * 1500 - cy)) AS d,
   greatest(x1 - x0, y1 - y0, 12) AS side FROM it JOIN an USING (page_id, id)))"""


@query("q13_anchor_confidence", anchor_sql(f"SELECT item_id, {_AC} AS conf FROM m", m=_MATCHED))
def q13(t):
    j = items(t).join(anchors(t), ["page_id", "id"])
    c = N.anchor_confidence(F.col("confidence"), N.item_distance(), N.box_side(), F.col("item_id") % 5 != 0)
    return j.select("item_id", c.alias("conf"))


@query(
    "q12_fill_from_anchors",
    anchor_sql(
        f"SELECT glyph_id, char, conf, coalesce(note, 'ok') AS note FROM (SELECT *, {_AC} AS conf FROM m) WHERE char IS NOT NULL AND confidence >= 0.5 AND conf >= 0.45",
        m=_MATCHED.replace("item_id % 5 = 0", "false").replace("FROM it JOIN", f"FROM ({_BEST}) JOIN"),
    ),
)
def q12(t):
    a, i = anchors(t), items(t)
    best = i.groupBy("page_id", "id").agg(F.max_by(F.struct("item_id", "char", "note", "confidence", "rx", "ry", "width", "height"), F.struct("confidence", -F.col("item_id"))).alias("i"))
    return N.fill_from_anchors(a.join(best.select("page_id", "id", "i.*"), ["page_id", "id"])).select("glyph_id", "char", "conf", "note")


@query("j7_assign_nearest")
def j7(t):
    """No SQL twin: greedy one-to-one assignment (checked against a sequential pass in the tests)."""
    i = items(t).where("char is not null").selectExpr("page_id", "item_id", "id", "rx * 1500 AS px", "ry * 1500 AS py", "confidence", "rx > 0.0005 OR ry > 0.0005 AS valid")
    return N.assign_nearest(i, anchors(t), ["page_id"], 40.0)


@query(
    "u4_check_conservation",
    anchor_sql(
        """SELECT page_id, n, coalesce(r.received, 0) AS received, n - coalesce(r.covered, 0) AS missing, coalesce(r.received, 0) = n AND coalesce(r.covered, 0) = n AS complete
        FROM (SELECT page_id, count(*) AS n FROM an GROUP BY 1) e LEFT JOIN (SELECT page_id, count(*) AS received, count(DISTINCT CASE WHEN id < n THEN id END) AS covered FROM it JOIN (SELECT page_id, count(*) AS n FROM an GROUP BY 1) USING (page_id) GROUP BY 1) r USING (page_id)"""
    ),
)
def u4(t):
    n = anchors(t).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    return R.check_conservation(n, items(t).select("page_id", "id"), ["page_id"])


# --- batches, cost, cache ---
@query(
    "a15_usage_rollup",
    """SELECT lang, provider, count(*) AS batches, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(u) AS BIGINT) AS units, floor(sum(u) * any_value(rate) * 1000000 + 0.5) / 1000000 AS cost FROM
       (SELECT lang, n_chars, CAST(ceil(n_chars / 100) AS BIGINT) AS u, ['gemini', 'openai', 'anthropic', 'custom'][doc_id % 4 + 1] AS provider,
               [0.01::DOUBLE, 0.012, 0.03, 0.008][doc_id % 4 + 1] AS rate FROM documents) GROUP BY 1, 2""",
)
def a15(t):
    b = t.documents.selectExpr("lang", "n_chars AS chars", "element_at(array('gemini','openai','anthropic','custom'), CAST(doc_id % 4 + 1 AS INT)) AS provider")
    return R.usage_rollup(b, ["lang", "provider"]).withColumn("cost", F.floor(F.col("cost") * 1e6 + 0.5) / 1e6)


@query(
    "q18_make_batches",
    """SELECT *, row_number() OVER (PARTITION BY lang, batch ORDER BY ((doc_id + 7) * 7919 + 104729) % 1000003, doc_id) - 1 AS display FROM
       (SELECT doc_id, lang, (rn - 1) // 64 AS batch, (rn - 1) % 64 AS slot FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents))""",
)
def q18(t):
    return R.make_batches(t.documents.select("doc_id", "lang"), ["lang"], ["doc_id"], "doc_id", F.expr("doc_id div 4096"))


@query(
    "q19_budget_admit",
    """SELECT source, doc_id, spent <= 3000 AS admitted FROM (SELECT source, doc_id, sum(CAST(ceil(n_chars / 100) AS BIGINT) * 3) OVER (PARTITION BY source ORDER BY doc_id) AS spent FROM documents)""",
)
def q19(t):
    """Costs in whole units, so both sides add up alike; 1,000 units per source and round."""
    d = t.documents.select("doc_id", "source", F.ceil(F.col("n_chars") / 100).cast("long").alias("estimate"))
    return R.budget_admit(d, ["source"], ["doc_id"], F.expr("doc_id div 4096"), "estimate", F.lit(3000)).select("source", "doc_id", "admitted")


@query(
    "q20_downgrade",
    with_(
        "glyph",
        """SELECT glyph_id, CASE WHEN f THEN CAST(0 AS DOUBLE) ELSE conf END AS conf, CASE WHEN f THEN CASE WHEN coalesce(text, '') <> '' THEN 'blurry' ELSE 'empty' END ELSE note END AS note,
        CASE WHEN f THEN 'local' ELSE source END AS source FROM (SELECT *, page_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS f FROM glyph)""",
    ),
)
def q20(t):
    failed = t.labels.where("toxic = 1").select(F.col("doc_id").alias("page_id"))
    return R.downgrade(B.glyphs(t), failed, ["page_id"]).select("glyph_id", "conf", "note", "source")


@query(
    "q21_result_cache",
    """WITH k AS (SELECT doc_id, md5(text) AS key, n_chars FROM documents),
       c AS (SELECT key, max(doc_id) AS stored FROM k WHERE doc_id % 2 = 0 GROUP BY 1)
       SELECT k.doc_id, c.key IS NOT NULL AS hit, stored, CAST((SELECT count(*) FROM (SELECT key FROM k GROUP BY 1)) AS BIGINT) AS entries FROM k LEFT JOIN c USING (key)""",
)
def q21(t):
    k = t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"))
    cache = k.where("doc_id % 2 = 0").select("key", F.col("doc_id").alias("answer"), F.col("doc_id").alias("created_at"))
    hits, misses = R.cache_lookup(k, cache)
    after = R.cache_upsert(cache, misses.select("key", F.col("doc_id").alias("answer"), F.col("doc_id").alias("created_at")))
    n = after.agg(F.count(F.lit(1))).scalar()
    out = hits.select("doc_id", F.lit(True).alias("hit"), F.col("stored.answer").alias("stored"))
    out = out.unionByName(misses.select("doc_id", F.lit(False).alias("hit"), F.lit(None).cast("long").alias("stored")))
    return out.withColumn("entries", n)


@query(
    "flagship_consensus_report",
    consensus_sql(
        """SELECT note, coalesce(char, '') AS char, count(*) AS items, count(*) FILTER (WHERE confidence < 0.85) AS review, floor(sum(confidence) / count(*) * 1000000 + 0.5) / 1000000 AS mean_conf
        FROM cons GROUP BY 1, 2"""
    ),
)
def flagship(t):
    """Votes -> consensus -> review queue -> summary per note and value."""
    c = V.consensus(B.votes(t), KEYS).withColumnRenamed("confidence", "conf")
    return c.groupBy("note", F.coalesce("char", F.lit("")).alias("char")).agg(
        F.count(F.lit(1)).alias("items"), F.count_if(R.needs_review()).alias("review"), (F.floor(F.avg("conf") * 1e6 + 0.5) / 1e6).alias("mean_conf")
    )
