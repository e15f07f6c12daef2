"""Iterative primitives, spatial joins, signatures, memory and propagation."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkframe import bindings as B
from inkframe.bindings import ALPHABET
from inkframe.catalog import query
from inkframe.catalog.sql import with_
from inkframe.constants import EVIDENCE_KEYS_KEPT
from inkframe.functions.geometry import iou
from inkframe.operators import iterate as I
from inkframe.operators import layout as L
from inkframe.operators import memory as M
from inkframe.operators.anchors import median_side

PK = ["page_id"]


def parts(t):
    r = B.rects(t)
    return r.where("kind = 'border'"), r.where("kind = 'tag'")


def boxed(r):
    return r.selectExpr("page_id", "rect_id AS glyph_id", "x AS x0", "y AS y0", "x + w AS x1", "y + h AS y1", "x + w / 2 AS cx", "y + h / 2 AS cy", "kind")


_INTER = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
_IOU = f"({_INTER}) / (a.w * a.h + b.w * b.h - {_INTER})"
_HIT = f"SELECT DISTINCT a.rect_id FROM rect a JOIN rect b ON a.page_id = b.page_id AND a.kind = 'tag' AND b.kind = 'border' WHERE {_IOU} > 0.1"


@query("j8_spatial_merge", with_("rect", "SELECT page_id, rect_id, kind FROM rect WHERE kind = 'border' OR rect_id NOT IN (SELECT rect_id FROM hit)", hit=_HIT))
def j8(t):
    a, b = parts(t)
    return L.spatial_merge(a, b, PK, "rect_id", 0.1).select("page_id", "rect_id", "kind")


@query("j8_overlap_pairs", with_("rect", f"SELECT a.page_id, a.rect_id AS a_id, b.rect_id AS b_id, {_IOU} AS iou FROM rect a JOIN rect b ON a.page_id = b.page_id AND a.rect_id < b.rect_id WHERE {_INTER} > 0"))
def j8_pairs(t):
    r = B.rects(t)
    p = L.overlapping(r, r, PK).where("a_rect_id < b_rect_id").withColumn("iou", iou(L.rect_box("a_"), L.rect_box("b_")))
    return p.where("iou > 0").select("page_id", F.col("a_rect_id").alias("a_id"), F.col("b_rect_id").alias("b_id"), "iou")


@query("j8_outside_zones", with_("rect", "SELECT rect_id FROM rect WHERE kind = 'tag' AND rect_id NOT IN (SELECT rect_id FROM hit)", hit=_HIT))
def j8_zones(t):
    a, b = parts(t)
    return L.outside_zones(b, a, PK, "rect_id", 0.1).select("rect_id")


@query("j9_boxes_with_points", with_("rect line", "SELECT rect_id, count(*) AS points FROM rect r JOIN line l ON r.page_id = l.page_id AND x1 BETWEEN x AND x + w AND y1 BETWEEN y AND y + h GROUP BY 1 HAVING count(*) >= 2"))
def j9(t):
    pts = B.lines(t).selectExpr("page_id", "x1 AS px", "y1 AS py")
    return L.boxes_with_points(B.rects(t), pts, PK, "rect_id").select("rect_id", "points")


_IN = "{px} BETWEEN x - 3 AND x + w + 3 AND {py} BETWEEN y - 3 AND y + h + 3"


@query(
    "j10_remove_inside",
    with_(
        "rect line node",
        f"""SELECT 'line' AS part, line_id AS id FROM line l WHERE NOT EXISTS (SELECT 1 FROM rect r WHERE r.kind = 'tag' AND r.page_id = l.page_id AND
        (({_IN.format(px='x1', py='y1')}) OR ({_IN.format(px='x2', py='y2')}) OR ({_IN.format(px='(x1 + x2) / 2', py='(y1 + y2) / 2')})))
        UNION ALL SELECT 'node', node_id FROM node n WHERE NOT EXISTS (SELECT 1 FROM rect g WHERE g.kind = 'tag' AND g.page_id = n.page_id AND n.cx BETWEEN x - n.r - 3 AND x + w + n.r + 3 AND n.cy BETWEEN y - n.r - 3 AND y + h + n.r + 3)
        UNION ALL SELECT 'glyph', a.rect_id FROM rect a WHERE a.kind = 'border' AND NOT EXISTS (SELECT 1 FROM rect b WHERE b.kind = 'tag' AND a.page_id = b.page_id AND {_INTER} / greatest(1, a.w * a.h) >= 0.35)""",
    ),
)
def j10(t):
    a, b = parts(t)
    out = L.remove_inside(b, PK, lines=B.lines(t), nodes=B.nodes(t), glyphs=boxed(a))
    ids = {"lines": ("line", "line_id"), "nodes": ("node", "node_id"), "glyphs": ("glyph", "glyph_id")}
    df = None
    for k, (name, col) in ids.items():
        p = out[k].select(F.lit(name).alias("part"), F.col(col).alias("id"))
        df = p if df is None else df.unionByName(p)
    return df


@query("j10_remove_left_of", with_("line node", "SELECT 'line' AS part, line_id AS id FROM line WHERE x2 >= 60 + page_id - 2 UNION ALL SELECT 'node', node_id FROM node WHERE cx + r >= 60 + page_id - 2"))
def j10_left(t):
    ln, nd = B.lines(t), B.nodes(t)
    frames = ln.select("page_id").union(nd.select("page_id")).distinct().withColumn("frame_x", 60.0 + F.col("page_id"))
    out = L.remove_left_of(frames, PK, lines=ln, nodes=nd)
    return out["lines"].select(F.lit("line").alias("part"), F.col("line_id").alias("id")).unionByName(out["nodes"].select(F.lit("node").alias("part"), F.col("node_id").alias("id")))


@query("j11_add_missing", with_("rect", """SELECT rect_id FROM rect a WHERE kind = 'tag' AND NOT EXISTS (SELECT 1 FROM rect b WHERE b.kind = 'border' AND a.page_id = b.page_id
   AND sqrt((a.x + a.w / 2 - b.x - b.w / 2) * (a.x + a.w / 2 - b.x - b.w / 2) + (a.y + a.h / 2 - b.y - b.h / 2) * (a.y + a.h / 2 - b.y - b.h / 2)) < 25)"""))
def j11(t):
    a, b = parts(t)
    return L.add_missing(boxed(a), boxed(b), PK, "glyph_id", 25.0).select(F.col("glyph_id").alias("rect_id"))


_LINK = """SELECT a.page_id, a.line_id, b.line_id AS other_id FROM (SELECT *, greatest(2, width_px + 1) AS tol FROM line) a JOIN line b ON a.page_id = b.page_id AND a.line_id <> b.line_id
   AND greatest(a.x1, b.x1) <= least(a.x2, b.x2) + tol AND greatest(a.y1, b.y1) <= least(a.y2, b.y2) + tol"""
_OCC = """SELECT l.page_id, l.line_id, r.rect_id AS glyph_id FROM (SELECT *, greatest(2, width_px + 1) AS tol FROM line) l JOIN rect r ON l.page_id = r.page_id WHERE
   CASE WHEN orientation = 'h' THEN y1 BETWEEN y - tol AND y + h + tol AND greatest(0, least(x2, x + w) - greatest(x1, x)) >= least(w, x2 - x1) * 0.45
        ELSE x1 BETWEEN x - tol AND x + w + tol AND greatest(0, least(y2, y + h) - greatest(y1, y)) >= least(h, y2 - y1) * 0.45 END"""


@query("j12_line_links", with_("line", "SELECT * FROM lk", lk=_LINK))
def j12(t):
    return L.line_links(B.lines(t), PK)


@query("j12_text_occlusion", with_("line rect", "SELECT * FROM oc", oc=_OCC))
def j12_text(t):
    return L.text_occlusion(B.lines(t), boxed(B.rects(t)), PK)


@query(
    "j13_partition_lines",
    with_(
        "line rect node",
        """SELECT line_id, coalesce(n, 0) AS links, NOT (x2 - x1 + (y2 - y1) >= coalesce(side, 20) * 3 OR coalesce(n, 0) >= 2 OR at_node) AND line_id IN (SELECT line_id FROM oc) AS occluding
        FROM (SELECT *, EXISTS (SELECT 1 FROM node d WHERE d.page_id = line.page_id AND least(sqrt((d.cx - x1) * (d.cx - x1) + (d.cy - y1) * (d.cy - y1)), sqrt((d.cx - x2) * (d.cx - x2) + (d.cy - y2) * (d.cy - y2))) <= d.r + greatest(2, width_px + 1)) AS at_node FROM line)
        LEFT JOIN (SELECT page_id, median(greatest(w, h)) AS side FROM rect GROUP BY 1) USING (page_id) LEFT JOIN (SELECT line_id, count(*) AS n FROM lk GROUP BY 1) USING (line_id)""",
        lk=_LINK,
        oc=_OCC,
    ),
)
def j13(t):
    g = boxed(B.rects(t)).withColumns({"kind": F.lit("text"), "grp": F.lit("body")})
    return L.partition_lines(B.lines(t), g, B.nodes(t), PK).select("line_id", "links", "occluding")


@query(
    "j16_free_endpoints",
    with_(
        "line",
        """SELECT line_id, e AS end_no, ex, ey FROM (SELECT page_id, line_id, width_px, 1 AS e, x1 AS ex, y1 AS ey FROM line WHERE orientation = 'v' UNION ALL SELECT page_id, line_id, width_px, 2, x2, y2 FROM line WHERE orientation = 'v') v
        WHERE NOT EXISTS (SELECT 1 FROM line h WHERE h.orientation = 'h' AND h.page_id = v.page_id AND ex BETWEEN h.x1 - greatest(4, ceil((v.width_px + h.width_px) / 2) + 2) AND h.x2 + greatest(4, ceil((v.width_px + h.width_px) / 2) + 2)
          AND abs(ey - h.y1) <= greatest(4, ceil((v.width_px + h.width_px) / 2) + 2))""".replace("e AS end_no", "CAST(e AS BIGINT) AS end_no"),
    ),
)
def j16(t):
    return L.free_endpoints(B.lines(t), PK).select("line_id", F.col("end").alias("end_no"), "ex", "ey")


# --- G1 - G3 ---
_EDGE = f"SELECT a.rect_id AS a, b.rect_id AS b FROM rect a JOIN rect b ON a.page_id = b.page_id AND a.rect_id < b.rect_id WHERE {_IOU} > 0.1"


def edges(t):
    r = B.rects(t)
    p = L.overlapping(r, r, PK).where("a_rect_id < b_rect_id").where(iou(L.rect_box("a_"), L.rect_box("b_")) > 0.1)
    return p.select(F.col("a_rect_id").alias("a"), F.col("b_rect_id").alias("b"))


@query(
    "g1_connected_components",
    """WITH RECURSIVE """ + with_("rect", """SELECT rect_id AS id, coalesce(min(r), rect_id) AS component FROM rect LEFT JOIN reach ON reach.id = rect_id GROUP BY rect_id""",
    e=_EDGE, s="SELECT a, b FROM e UNION ALL SELECT b, a FROM e", reach="SELECT a AS id, least(a, b) AS r FROM s UNION SELECT s.b, reach.r FROM reach JOIN s ON s.a = reach.id")[5:],
)
def g1(t):
    e = edges(t).withColumnsRenamed({"a": "src", "b": "dst"})
    return I.connected_components(B.rects(t).select(F.col("rect_id").alias("id")), e)


# a sequential pass per page: items in order, each kept unless an earlier kept one is its neighbour
_SEQ = """SELECT page_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT page_id FROM od) UNION ALL
   SELECT st.page_id, k + 1, CASE WHEN list_has_any(kept, nb) THEN kept ELSE list_append(kept, id) END FROM st JOIN od ON od.page_id = st.page_id AND od.rn = k + 1"""


def greedy_sql(edge: str, prio: str, names: str = "rect", ids: str = "rect_id", src: str = "rect") -> str:
    body = with_(
        names,
        f"""SELECT unnest(kept) AS {ids} FROM (SELECT page_id, arg_max(kept, k) AS kept FROM st GROUP BY 1)""",
        e=edge,
        s="SELECT a, b FROM e UNION ALL SELECT b, a FROM e",
        od=f"SELECT page_id, {ids} AS id, row_number() OVER (PARTITION BY page_id ORDER BY {prio}) AS rn, coalesce((SELECT list(b) FROM s WHERE a = {ids}), []) AS nb FROM {src}",
        st=_SEQ,
    )
    return "WITH RECURSIVE " + body[5:]


@query("g2_greedy_keep", greedy_sql(_EDGE, "w * h DESC, rect_id"))
def g2(t):
    r = B.rects(t).select(F.col("rect_id").alias("id"), (F.col("w") * F.col("h")).alias("prio"))
    return I.greedy_keep(r, edges(t)).select(F.col("id").alias("rect_id"))


_DUP = """SELECT a.rect_id AS a, b.rect_id AS b FROM (SELECT *, x + w / 2 AS cx, y + h / 2 AS cy FROM rect) a JOIN (SELECT *, x + w / 2 AS cx, y + h / 2 AS cy FROM rect) b ON a.page_id = b.page_id AND a.rect_id < b.rect_id
   JOIN (SELECT page_id, median((w + h) / 2) AS s FROM rect GROUP BY 1) m ON m.page_id = a.page_id
   WHERE sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) < s * 0.36
   AND greatest(greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w), greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h)) < s * 0.35
   AND (""" + _INTER + """ / least(greatest(1, a.w * a.h), greatest(1, b.w * b.h)) > 0.22 OR sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) < s * 0.3)"""


@query("g2_dedupe_boxes", greedy_sql(_DUP, "w * h DESC, rect_id"))
def g2_dedupe(t):
    b = boxed(B.rects(t))
    return L.dedupe_boxes(b, PK, "glyph_id", median_side(b, PK), 50.0).select(F.col("glyph_id").alias("rect_id"))


_TOL = "SELECT a.rect_id AS a, b.rect_id AS b FROM rect a JOIN rect b ON a.page_id = b.page_id AND a.rect_id < b.rect_id WHERE abs(a.x - b.x) < 8 AND abs(a.y - b.y) < 8 AND abs(a.w - b.w) < 16 AND abs(a.h - b.h) < 16"


@query("u2_union_distinct_tol", greedy_sql(_TOL, "rect_id"))
def u2(t):
    a, b = parts(t)
    return L.union_distinct_tol(a.unionByName(b), PK, "rect_id", "rect_id").select("rect_id")


@query(
    "g3_greedy_match",
    "WITH RECURSIVE " + with_(
        "rect",
        "SELECT unnest(ls) AS l, unnest(rs) AS r FROM (SELECT page_id, arg_max(ls, k) AS ls, arg_max(rs, k) AS rs FROM st GROUP BY 1)",
        od=f"""SELECT page_id, l, r, row_number() OVER (PARTITION BY page_id ORDER BY cost, l, r) AS rn FROM (SELECT a.page_id, a.rect_id AS l, b.rect_id AS r, -({_IOU}) AS cost FROM rect a JOIN rect b ON a.page_id = b.page_id AND a.kind = 'border' AND b.kind = 'tag' WHERE {_IOU} > 0.1)""",
        st="""SELECT page_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ls, CAST([] AS BIGINT[]) AS rs FROM (SELECT DISTINCT page_id FROM od) UNION ALL
        SELECT st.page_id, k + 1, CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN ls ELSE list_append(ls, l) END, CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN rs ELSE list_append(rs, r) END FROM st JOIN od ON od.page_id = st.page_id AND od.rn = k + 1""",
    )[5:],
)
def g3(t):
    a, b = parts(t)
    p = L.overlapping(a, b, PK).withColumn("iou", iou(L.rect_box("a_"), L.rect_box("b_"))).where("iou > 0.1")
    e = p.select(F.col("a_rect_id").alias("l"), F.col("b_rect_id").alias("r"), "iou").select("l", "r", F.struct((-F.col("iou")).alias("c"), F.col("l").alias("a"), F.col("r").alias("b")).alias("cost"))
    return I.greedy_match(e).select("l", "r")


@query(
    "k4_free_slots",
    with_(
        "rect",
        """SELECT page_id, arg_min(px, (d, iy, ix)) AS x, arg_min(py, (d, iy, ix)) AS y FROM (SELECT *, sqrt((px - 85) * (px - 85) + (py - 85) * (py - 85)) AS d FROM
        (SELECT page_id, ix, iy, 14 + ix * CAST(8 AS DOUBLE) AS px, 14 + iy * CAST(8 AS DOUBLE) AS py FROM (SELECT DISTINCT page_id FROM rect), range(0, 18) a(ix), range(0, 18) b(iy)) g
        WHERE NOT EXISTS (SELECT 1 FROM rect r WHERE r.page_id = g.page_id AND px - 6 < x + w + 6 AND x - 6 < px + 6 AND py - 6 < y + h + 6 AND y - 6 < py + 6)) GROUP BY 1""",
    ),
)
def k4(t):
    r = B.rects(t)
    pages = r.select("page_id").distinct().withColumns({"width": F.lit(170.0), "height": F.lit(170.0)})
    return L.free_slots(pages, boxed(r), PK, 12.0)


# --- signatures and memory ---
_PAIRS = """SELECT f.glyph_id, f.project_id AS g_project, m.*, bit_count(xor(f.sig, m.sig)) AS distance, f.sig = m.sig AND f.aspect = m.aspect AS exact FROM fp f JOIN memory m ON abs(f.aspect - m.aspect) <= 1 WHERE bit_count(xor(f.sig, m.sig)) <= 4"""
_CAND = """SELECT *, 1 - distance / CAST(64 AS DOUBLE) AS similarity FROM pr WHERE exact OR glyph_id NOT IN (SELECT glyph_id FROM pr WHERE exact)"""
_VISIBLE = "CASE WHEN project_id IS NULL THEN manual >= 2 AND similarity >= 0.97 ELSE project_id = g_project END"


def sig(df):
    return df.withColumn("sig", F.array("sig"))


def candidates(t):
    return M.memory_candidates(sig(B.queries_fp(t)), sig(B.memory(t)), 64, 4)


@query("q3_hamming", with_("memory fp", "SELECT glyph_id, CAST(bit_count(xor(f.sig, m.sig)) AS BIGINT) AS distance FROM fp f JOIN memory m ON glyph_id = memory_id"))
def q3(t):
    m = sig(B.memory(t)).select(F.col("memory_id").alias("glyph_id"), F.col("sig").alias("b"))
    return sig(B.queries_fp(t)).join(m, "glyph_id").select("glyph_id", M.hamming(F.col("sig"), F.col("b")).alias("distance"))


@query("q6_memory_candidates", with_("memory fp", "SELECT glyph_id, memory_id, CAST(distance AS BIGINT) AS distance, similarity FROM c", pr=_PAIRS, c=_CAND))
def q6(t):
    return candidates(t).select("glyph_id", "memory_id", "distance", "similarity")


@query("f15_visible_memory", with_("memory fp", f"SELECT glyph_id, memory_id FROM c WHERE {_VISIBLE}", pr=_PAIRS, c=_CAND))
def f15(t):
    return candidates(t).where(M.visible_memory()).select("glyph_id", "memory_id")


_RANK = f"""SELECT *, row_number() OVER (PARTITION BY glyph_id ORDER BY score DESC, char) AS k, lead(score) OVER (PARTITION BY glyph_id ORDER BY score DESC, char) AS second FROM
   (SELECT glyph_id, char, sum(similarity ** 4 * (manual * 4 + model * 2 + local * 0.5) * (confidence_sum / greatest(1, total))) AS score, max(similarity) AS similarity, CAST(sum(total) AS BIGINT) AS total, CAST(sum(manual) AS BIGINT) AS manual, sum(confidence_sum) AS cs
    FROM c WHERE {_VISIBLE} GROUP BY 1, 2)"""
_RECALL = """SELECT glyph_id, char, confidence, similarity, total, manual FROM (SELECT *, CASE WHEN manual >= 2 AND similarity >= 0.93 THEN CAST(0.97 AS DOUBLE) WHEN manual >= 1 AND total >= 3 AND similarity >= 0.95 AND cs / greatest(1, total) >= 0.9 THEN 0.94
   WHEN total >= 6 AND similarity >= 0.97 AND cs / greatest(1, total) >= 0.92 THEN 0.9 END AS confidence FROM rk WHERE k = 1 AND (second IS NULL OR score >= second * 1.6)) WHERE confidence IS NOT NULL"""


@query("a7_recall", with_("memory fp", "SELECT * FROM rc", pr=_PAIRS, c=_CAND, rk=_RANK, rc=_RECALL))
def a7(t):
    return M.recall(candidates(t))


@query(
    "q22_bypass_known",
    with_(
        "memory fp",
        """SELECT glyph_id, CASE WHEN prot THEN 'kept' WHEN glyph_id IN (SELECT glyph_id FROM rc WHERE manual >= 2) THEN 'known' ELSE 'open' END AS part,
        CASE WHEN prot THEN CAST(0.99 AS DOUBLE) WHEN glyph_id IN (SELECT glyph_id FROM rc WHERE manual >= 2) THEN (SELECT confidence FROM rc WHERE rc.glyph_id = g.glyph_id) END AS conf
        FROM (SELECT vec_id AS glyph_id, label = 3 AND vec_id % 4 = 0 AS prot FROM embeddings) g""",
        pr=_PAIRS, c=_CAND, rk=_RANK, rc=_RECALL,
    ),
)
def q22(t):
    from inkframe.operators.review import bypass_known

    g = t.embeddings.selectExpr("vec_id AS glyph_id", "IF(label = 3, 'pageno', 'body') AS grp", "vec_id % 4 = 0 AS edited", "'一' AS text", "0.5D AS conf", "'local' AS source")
    done, open_ = bypass_known(g, M.recall(candidates(t)))
    done = done.select("glyph_id", F.when(F.col("source") == "manual", "kept").otherwise("known").alias("part"), "conf")
    return done.unionByName(open_.select("glyph_id", F.lit("open").alias("part"), F.lit(None).cast("double").alias("conf")))


_EV = f"""SELECT user_id % 3 AS project_id, user_id % 7 AS aspect, user_id AS sig, substring('{ALPHABET}', CAST(list_position(['view','click','signup','purchase','error'], event_type) AS INTEGER), 1) AS char,
   CASE event_id % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'model' ELSE 'local' END AS source, least(1, value / 400) AS confidence, user_id || ':' || strftime(ts, '%Y-%m-%d') AS evidence_key, event_id AS seen_at FROM events"""


_LEARN = with_(
    "",
    """SELECT aspect, sig, char, CAST(sum(total) AS BIGINT) AS total, CAST(sum(manual) AS BIGINT) AS manual, CAST(sum(model) AS BIGINT) AS model, CAST(sum(local) AS BIGINT) AS local,
    round(sum(confidence_sum), 6) AS confidence_sum, CAST(max(last_seen) AS BIGINT) AS last_seen, CAST(least(80, sum(keys)) AS BIGINT) AS keys FROM (
    SELECT project_id, aspect, sig, char, count(*) AS total, count(*) FILTER (WHERE source = 'manual') AS manual, count(*) FILTER (WHERE source = 'model') AS model, count(*) FILTER (WHERE source = 'local') AS local,
      sum(confidence) AS confidence_sum, max(seen_at) AS last_seen, count(*) AS keys FROM once WHERE NOT (char = '倪' AND evidence_key IN (SELECT evidence_key FROM old)) GROUP BY ALL
    UNION ALL SELECT c_custkey % 3, c_custkey % 7, c_custkey, '倪', 2, 1, 1, 0, 1.5, 0, 1 FROM customer) GROUP BY project_id, aspect, sig, char""",
    ev=_EV,
    once="SELECT project_id, aspect, sig, char, evidence_key, min(seen_at) AS seen_at, arg_min(source, seen_at) AS source, arg_min(confidence, seen_at) AS confidence FROM ev GROUP BY ALL",
    old="SELECT c_custkey || ':2024-01-05' AS evidence_key FROM customer",
)


@query("a8_learn", _LEARN)
def a8(t):
    """Customers are records that already know the evidence of one day; every event brings evidence."""
    return learnt(M.learn(remembered(t), evidence(t), kept=EVIDENCE_KEYS_KEPT))


@query("m2_learn_in_batches", _LEARN)
def m2(t):
    """The first half of the month, then everything: what was seen before counts once."""
    first = M.learn(remembered(t), evidence(t).where("day(ts) <= 15").drop("ts"), kept=EVIDENCE_KEYS_KEPT)
    return learnt(M.learn(first, evidence(t).drop("ts"), kept=EVIDENCE_KEYS_KEPT))


def remembered(t):
    return t.customer.selectExpr(
        "c_custkey % 3 AS project_id", "c_custkey % 7 AS aspect", "array(c_custkey) AS sig", "'倪' AS char", "2L AS total", "1L AS manual", "1L AS model", "0L AS local",
        "1.5D AS confidence_sum", "0L AS last_seen", "array(concat(c_custkey, ':2024-01-05')) AS evidence_keys",
    )


def learnt(out):
    return out.select(
        "aspect", F.col("sig")[0].alias("sig"), "char", "total", "manual", "model", "local", F.round("confidence_sum", 6).alias("confidence_sum"), "last_seen",
        F.size("evidence_keys").alias("keys"),
    )


def evidence(t):
    return t.events.selectExpr(
        "user_id % 3 AS project_id", "user_id % 7 AS aspect", "array(user_id) AS sig",
        f"substring('{ALPHABET}', CAST(array_position(array('view','click','signup','purchase','error'), event_type) AS INT), 1) AS char",
        "CASE event_id % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'model' ELSE 'local' END AS source", "value / 400 AS confidence",
        "concat(user_id, ':', date_format(ts, 'yyyy-MM-dd')) AS evidence_key", "event_id AS seen_at", "ts",
    )


@query(
    "q4_leader_cluster",
    "WITH RECURSIVE " + with_(
        "memory",
        """SELECT page_id, id AS glyph_id, (SELECT min(z.id) FROM od z WHERE z.page_id = o.page_id AND list_contains(f.kept, z.id) AND bit_count(xor(z.sig, o.sig)) <= 24 AND z.id <= o.id) AS leader
        FROM od o JOIN (SELECT page_id, arg_max(kept, k) AS kept FROM st GROUP BY 1) f USING (page_id)""",
        od="""SELECT aspect AS page_id, memory_id AS id, sig, row_number() OVER (PARTITION BY aspect ORDER BY memory_id) AS rn,
           coalesce((SELECT list(b.memory_id) FROM memory b WHERE b.aspect = a.aspect AND b.memory_id < a.memory_id AND bit_count(xor(a.sig, b.sig)) <= 24), []) AS nb FROM memory a""",
        st=_SEQ,
    )[5:],
)
def q4(t):
    m = sig(B.memory(t)).select(F.col("aspect").alias("page_id"), F.col("memory_id").alias("glyph_id"), "sig")
    return M.leader_cluster(m, PK, "glyph_id", 24).select("page_id", "glyph_id", "leader")


DICT_CHARS = "公子世祖氏宗譜長次孫"
_LOCK = "(edited OR (source = 'manual' AND coalesce(text, '') <> ''))"


@query(
    "q5_propagate",
    with_(
        "glyph",
        f"""SELECT glyph_id, CASE WHEN fill OR swap THEN seed ELSE text END AS text, CASE WHEN fill THEN CASE tier WHEN 1 THEN 0.88 WHEN 2 THEN 0.86 ELSE 0.8 END WHEN same THEN least(0.95, greatest(0.88, conf + 0.35)) WHEN swap THEN 0.85 ELSE conf END AS conf, fill OR same OR swap AS improved
        FROM (SELECT *, coalesce(target AND text IS NULL, false) AS fill, coalesce(target AND text = seed, false) AS same, coalesce(target AND text <> seed AND conf < 0.5 AND tier <= 2 AND seed NOT IN ('氏', '公'), false) AS swap
          FROM (SELECT g.*, s.seed, s.tier, s.seed IS NOT NULL AND NOT {_LOCK} AND conf < 0.85 AS target FROM g LEFT JOIN sd s USING (page_id, w)))""",
        g="SELECT * FROM glyph",
        tx=f"""SELECT page_id, w, text, count(*) AS members, CASE WHEN count(*) FILTER (WHERE ({_LOCK} AND text IS NOT NULL AND NOT regexp_matches(text, '[A-Z0-9]')) OR (NOT {_LOCK} AND text IS NOT NULL AND conf >= 0.85)) > 0 THEN 1
            WHEN count(*) FILTER (WHERE NOT {_LOCK} AND text IS NOT NULL AND conf >= 0.5) >= 2 THEN 2
            WHEN count(*) FILTER (WHERE NOT {_LOCK} AND text IS NOT NULL AND conf >= 0.5 AND conf < 0.85 AND contains('{DICT_CHARS}', text)) > 0 THEN 3 END AS tier FROM glyph GROUP BY 1, 2, 3""",
        sd="""SELECT page_id, w, any_value(text) AS seed, any_value(tier) AS tier FROM tx JOIN (SELECT page_id, w, min(tier) AS tier, sum(members) AS m FROM tx GROUP BY 1, 2) USING (page_id, w, tier) WHERE m >= 2 GROUP BY page_id, w HAVING count(*) = 1""",
    ).replace("THEN 0.88 WHEN 2 THEN 0.86 ELSE 0.8 END", "THEN CAST(0.88 AS DOUBLE) WHEN 2 THEN 0.86 ELSE 0.8 END"),
)
def q5(t):
    """Look-alike clusters stand in for the words of one place across the lines of a page."""
    g = B.glyphs(t).withColumns({"in_dict": F.coalesce(F.lit(DICT_CHARS).contains(F.col("text")), F.lit(False)), "is_target": F.lit(True)})
    return M.propagate(g, ["page_id", "w"]).select("glyph_id", "text", "conf", "improved")
