"""Projections, geometry, text and dictionary functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkframe import bindings as B
from inkframe.catalog import query
from inkframe.catalog.sql import with_
from inkframe.functions import dictionaries as D
from inkframe.functions import geometry as G
from inkframe.functions import text as T

LATIN = "a-zA-Z"


def num(e: str) -> str:
    return f"CAST({e} AS DOUBLE)"


@query(
    "p1_unit_conversions",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice / (l_quantity - 1 + 0.5) AS mm,
       l_quantity * (l_tax * 100) AS px, CASE WHEN l_discount > 0 THEN l_quantity / l_discount / CAST(0.352778 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS height_pt,
       CASE WHEN l_discount > 0 THEN l_quantity / l_discount * CAST(2.834645669 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS width_pt,
       l_quantity * CAST(0.352778 AS DOUBLE) * l_tax AS pt_px FROM lineitem""",
)
def p1(t):
    q, d = F.col("l_quantity"), F.col("l_discount")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        G.px_to_mm(F.col("l_extendedprice"), q - 1 + 0.5).alias("mm"),
        G.mm_to_px(q, F.col("l_tax") * 100).alias("px"),
        G.height_to_pt(q, d).alias("height_pt"),
        G.line_width_to_pt(q, d).alias("width_pt"),
        G.pt_to_px(q, F.col("l_tax")).alias("pt_px"),
    )


@query(
    "p2_norm_to_px",
    with_(
        "rect",
        """SELECT rect_id, CAST(floor(x / 150 * 1240 + 0.5) AS BIGINT) AS px, CAST(floor(y / 150 * 1754 + 0.5) AS BIGINT) AS py,
        greatest(1, CAST(floor(w / 5000 * 1240 + 0.5) AS BIGINT)) AS pw, greatest(1, CAST(floor(h / 9000 * 1754 + 0.5) AS BIGINT)) AS ph,
        floor(x / 1240 * 10000 + 0.5) / 10000 AS rx, floor(y / 1754 * 10000 + 0.5) / 10000 AS ry FROM rect""",
    ),
)
def p2(t):
    W, H = F.lit(1240), F.lit(1754)
    px, py, pw, ph = G.norm_to_px(F.col("x") / 150, F.col("y") / 150, F.col("w") / 5000, F.col("h") / 9000, W, H)
    return B.rects(t).select(
        "rect_id", px.alias("px"), py.alias("py"), pw.alias("pw"), ph.alias("ph"),
        G.px_to_rel(F.col("x"), W).alias("rx"), G.px_to_rel(F.col("y"), H).alias("ry"),
    )


@query(
    "p3_box_metrics",
    with_(
        "glyph",
        """SELECT glyph_id, (x1 - x0) * (y1 - y0) AS area, greatest(x1 - x0, y1 - y0) AS side, (x1 - x0 + (y1 - y0)) / 2 AS mean_side,
        greatest(x1 - x0, y1 - y0) / greatest(1, least(x1 - x0, y1 - y0)) AS aspect, (x0 + x1) / 2 AS mid_x, (y0 + y1) / 2 AS mid_y FROM glyph""",
    ),
)
def p3(t):
    return G.with_box_metrics(B.glyphs(t)).select("glyph_id", "area", "side", "mean_side", "aspect", "mid_x", "mid_y")


_PAIR = (
    "rect",
    """SELECT a.rect_id AS a_id, b.rect_id AS b_id, a.x AS ax0, a.y AS ay0, a.x + a.w AS ax1, a.y + a.h AS ay1,
       b.x AS bx0, b.y AS by0, b.x + b.w AS bx1, b.y + b.h AS by1
       FROM rect a JOIN rect b ON a.page_id = b.page_id AND b.rect_id = a.rect_id + 1""",
)


def rect_pairs(t):
    """Each rect with the next one of its page."""
    r = B.rects(t).selectExpr("page_id", "rect_id AS a_id", "x AS ax0", "y AS ay0", "x + w AS ax1", "y + h AS ay1")
    nxt = r.selectExpr("page_id", "a_id AS b_id", "ax0 AS bx0", "ay0 AS by0", "ax1 AS bx1", "ay1 AS by1", "a_id - 1 AS a_id")
    return r.join(nxt, ["page_id", "a_id"])


def boxes():
    return tuple(F.col(f"a{c}") for c in ("x0", "y0", "x1", "y1")), tuple(F.col(f"b{c}") for c in ("x0", "y0", "x1", "y1"))


@query(
    "p4_overlap_measures",
    with_(
        _PAIR[0],
        """SELECT a_id, b_id, greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) / (greatest(ax1, bx1) - least(ax0, bx0)) AS overlap_x,
        CASE WHEN inter > 0 THEN inter / ((ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - inter) ELSE CAST(0 AS DOUBLE) END AS iou,
        inter / least(greatest(1, (ax1 - ax0) * (ay1 - ay0)), greatest(1, (bx1 - bx0) * (by1 - by0))) AS overlap_min FROM q""",
        p=_PAIR[1],
        q="""SELECT *, CASE WHEN least(ax1, bx1) > greatest(ax0, bx0) AND least(ay1, by1) > greatest(ay0, by0)
             THEN (least(ax1, bx1) - greatest(ax0, bx0)) * (least(ay1, by1) - greatest(ay0, by0)) ELSE CAST(0 AS DOUBLE) END AS inter FROM p""",
    ),
)
def p4(t):
    a, b = boxes()
    return rect_pairs(t).select(
        "a_id", "b_id",
        G.overlap_1d(a[0], a[2], b[0], b[2]).alias("overlap_x"), G.iou(a, b).alias("iou"), G.overlap_min(a, b).alias("overlap_min"),
    )


@query(
    "p5_distances",
    with_(
        "line rect",
        """SELECT line_id, rect_id, sqrt((cx - x1) * (cx - x1) + (cy - y1) * (cy - y1)) AS to_start,
        sqrt((cx - (x1 + u * (x2 - x1))) * (cx - (x1 + u * (x2 - x1))) + (cy - (y1 + u * (y2 - y1))) * (cy - (y1 + u * (y2 - y1)))) AS to_segment,
        sqrt(dx * dx + dy * dy) AS to_rect
        FROM (SELECT *, least(1, greatest(0, ((cx - x1) * (x2 - x1) + (cy - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS u,
              greatest(0, x - x2, x1 - (x + w)) AS dx, greatest(0, y - y2, y1 - (y + h)) AS dy FROM j)""",
        j="""SELECT l.*, r.rect_id, r.x, r.y, r.w, r.h, r.x + r.w / 2 AS cx, r.y + r.h / 2 AS cy FROM line l JOIN rect r ON r.rect_id = l.line_id""",
    ),
)
def p5(t):
    r = B.rects(t).selectExpr("rect_id", "rect_id AS line_id", "x", "y", "w", "h", "x + w / 2 AS cx", "y + h / 2 AS cy")
    j = B.lines(t).drop("page_id").join(r, "line_id")
    c = {n: F.col(n) for n in ("x1", "y1", "x2", "y2", "x", "y", "w", "h", "cx", "cy")}
    seg = (c["x1"], c["y1"], c["x2"], c["y2"])
    return j.select(
        "line_id", "rect_id",
        G.dist_points(c["cx"], c["cy"], c["x1"], c["y1"]).alias("to_start"),
        G.dist_point_segment(c["cx"], c["cy"], *seg).alias("to_segment"),
        G.dist_axis_segment_rect(F.col("orientation"), *seg, c["x"], c["y"], c["x"] + c["w"], c["y"] + c["h"]).alias("to_rect"),
    )


@query(
    "p6_union_boxes",
    with_(
        "rect",
        """SELECT page_id, kind, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1, CAST(0 AS BIGINT) AS pair FROM rect GROUP BY 1, 2
        UNION ALL SELECT a_id, 'pair', least(ax0, bx0), least(ay0, by0), greatest(ax1, bx1), greatest(ay1, by1), b_id FROM p""",
        p=_PAIR[1],
    ),
)
def p6(t):
    a, b = boxes()
    u = G.union_box(a, b)
    grouped = B.rects(t).groupBy("page_id", "kind").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.expr("x + w")).alias("x1"), F.max(F.expr("y + h")).alias("y1")
    )
    pairs = rect_pairs(t).select(
        F.col("a_id").alias("page_id"), F.lit("pair").alias("kind"), u[0].alias("x0"), u[1].alias("y0"), u[2].alias("x1"), u[3].alias("y1"),
        F.col("b_id").alias("pair"),
    )
    return grouped.withColumn("pair", F.lit(0).cast("long")).unionByName(pairs)


@query(
    "p7_clamp",
    """SELECT event_id, least(CAST(300 AS DOUBLE), greatest(CAST(50 AS DOUBLE), value)) AS clamped,
       coalesce(least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), TRY_CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) / 50)), CAST(0 AS DOUBLE)) AS share,
       CAST(0 AS DOUBLE) AS from_text FROM events""",
)
def p7(t):
    k = F.get_json_object("props", "$.k")
    return t.events.select(
        "event_id", G.clamp(F.col("value"), 50.0, 300.0).alias("clamped"),
        G.clamp01((k.cast("double") / 50).cast("string")).alias("share"), G.clamp01(F.col("event_type")).alias("from_text"),
    )


@query(
    "p8_source_profiles",
    """WITH s AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'script' END AS given, CASE WHEN page_id % 5 = 1 THEN page_id ELSE 0 END AS page_no,
          CASE WHEN page_id % 5 = 2 THEN url || '.PDF' ELSE url END AS name, CAST(page_id % 4 * 100 AS DOUBLE) AS dpi FROM pages),
       k AS (SELECT page_id, dpi, CASE WHEN given IS NOT NULL THEN given WHEN page_no > 0 THEN 'pdf' WHEN lower(name) LIKE '%.pdf%' AND dpi > 0 THEN 'pdf' ELSE 'image' END AS kind FROM s)
       SELECT page_id, kind, CASE WHEN kind = 'pdf' THEN CASE WHEN dpi > 0 THEN dpi ELSE 450 END ELSE CAST(254 AS DOUBLE) END AS target_dpi,
       CASE WHEN kind = 'pdf' THEN 'otsu' ELSE 'sauvola' END AS binarizer, CAST(CASE WHEN kind = 'pdf' THEN 0.16 ELSE 0.28 END AS DOUBLE) AS min_bar_fill FROM k""",
)
def p8(t):
    s = t.pages.selectExpr(
        "page_id", "CASE WHEN page_id % 5 = 0 THEN 'script' END AS given", "CASE WHEN page_id % 5 = 1 THEN page_id ELSE 0 END AS page_no",
        "CASE WHEN page_id % 5 = 2 THEN concat(url, '.PDF') ELSE url END AS name", "CAST(page_id % 4 * 100 AS DOUBLE) AS dpi",
    )
    s = s.withColumn("kind", G.resolve_kind(F.col("given"), F.col("page_no"), F.col("name"), F.col("dpi")))
    return G.profile_join(s).select("page_id", "kind", "target_dpi", "binarizer", "min_bar_fill")


@query(
    "p9_erase_boxes",
    with_(
        "line rect",
        """SELECT line_id AS id, greatest(0, CAST(floor(CASE WHEN orientation = 'h' THEN x1 ELSE x1 - pad END) AS BIGINT)) AS ex0,
        greatest(0, CAST(floor(CASE WHEN orientation = 'h' THEN y1 - pad ELSE y1 END) AS BIGINT)) AS ey0,
        CAST(ceil(CASE WHEN orientation = 'h' THEN x2 ELSE x1 + pad END) AS BIGINT) AS ex1,
        CAST(ceil(CASE WHEN orientation = 'h' THEN y1 + pad ELSE y2 END) AS BIGINT) AS ey1
        FROM (SELECT *, CASE WHEN width_px <= 4 THEN greatest(1, ceil(width_px / 2)) ELSE ceil(width_px / 2) + 2 END AS pad FROM line)
        UNION ALL SELECT -rect_id, greatest(0, CAST(floor(x - 2) AS BIGINT)), greatest(0, CAST(floor(y - 2) AS BIGINT)), CAST(ceil(x + w + 2) AS BIGINT), CAST(ceil(y + h + 2) AS BIGINT) FROM rect""",
    ),
)
def p9(t):
    cols = [F.col(c).cast("long").alias(c) for c in ("ex0", "ey0", "ex1", "ey1")]
    a = G.erase_boxes(B.lines(t)).select(F.col("line_id").alias("id"), *cols)
    b = G.erase_rect_boxes(B.rects(t)).select((-F.col("rect_id")).alias("id"), *cols)
    return a.unionByName(b)


@query(
    "p10_resize_boxes",
    with_(
        "glyph",
        """SELECT glyph_id, cx + 5 AS cx, cy - 3 AS cy, cx - mw / 2 + 5 AS x0, cy - mh / 2 - 3 AS y0, cx + mw / 2 + 5 AS x1, cy + mh / 2 - 3 AS y1, true AS edited
        FROM glyph JOIN (SELECT page_id, grp, floor(sum(x1 - x0) / count(*) * 10 + 0.5) / 10 AS mw, floor(sum(y1 - y0) / count(*) * 10 + 0.5) / 10 AS mh FROM glyph GROUP BY 1, 2) USING (page_id, grp)""",
    ),
)
def p10(t):
    u = G.unify_boxes(B.glyphs(t), ["page_id", "grp"])
    return G.shift_boxes(u, F.lit(5.0), F.lit(-3.0)).select("glyph_id", "cx", "cy", "x0", "y0", "x1", "y1", "edited")


_CJK = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{323AF}\\x{3007}\\x{3021}-\\x{3029}\\x{3038}-\\x{303B}]"


@query(
    "t1_is_cjk",
    with_("glyph", f"SELECT glyph_id, coalesce(regexp_full_match(text, '{_CJK}'), false) AS cjk, false AS word_cjk FROM glyph"),
)
def t1(t):
    g = B.glyphs(t)
    return g.select("glyph_id", T.is_cjk(F.col("text")).alias("cjk"), T.is_cjk(F.col("grp")).alias("word_cjk"))


@query(
    "t2_sanitize_char",
    with_(
        "word",
        """SELECT doc_id, l, w, CASE WHEN length(kept) = 0 THEN NULL WHEN length(kept) = 1 THEN kept ELSE substring(kept, 1, 2) END AS char,
        CASE WHEN length(kept) = 0 THEN 'empty' WHEN length(kept) = 1 THEN 'ok' ELSE 'multi' END AS note
        FROM (SELECT *, regexp_replace(word, '[^a-zA-Z]', '', 'g') AS kept FROM word)""",
    ),
)
def t2(t):
    c, n = T.sanitize_char(F.col("word"), F.lit("ok"), LATIN)
    return B.words(t).select("doc_id", "l", "w", c.alias("char"), n.alias("note"))


@query(
    "t3_valid_char",
    with_(
        "word",
        """SELECT doc_id, l, w, CASE WHEN n % 2 = 0 THEN regexp_full_match(word, '[a-zA-Z]{0,2}') ELSE regexp_full_match(word, '[a-zA-Z]') END AS valid FROM word""",
    ),
)
def t3(t):
    note = F.when(F.col("n") % 2 == 0, "multi")
    return B.words(t).select("doc_id", "l", "w", T.is_valid_char(F.col("word"), note, LATIN).alias("valid"))


@query(
    "t4_extract_json",
    """SELECT event_id, CAST(CASE WHEN event_id % 4 = 3 THEN NULL ELSE props ->> '$.k' END AS BIGINT) AS k,
       event_id % 4 = 3 AS rejected FROM events""",
)
def t4(t):
    """Objects wrapped in prose or a code fence, or broken, by event_id % 4."""
    wrapped = F.expr(
        "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('Here: ', props, ' done') WHEN 2 THEN concat('x\n```json\n', props, '\n```\ny')"
        " ELSE reverse(props) END"
    )
    e = t.events.select("event_id", F.from_json(T.extract_json(wrapped), "k long").alias("o"))
    return e.select("event_id", "o.k", F.col("o.k").isNull().alias("rejected"))


@query(
    "t5_parse_responses",
    """SELECT event_id, CAST(event_id AS BIGINT) AS id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS char,
       least(CAST(1 AS DOUBLE), value / 400) AS confidence, CASE WHEN event_type = 'view' THEN 'blurry' END AS note,
       event_type || ',a,b' AS candidates FROM events""",
)
def t5(t):
    """Model answers with one item per event, built as JSON text and parsed back to vote rows."""
    from inkframe.operators.votes import parse_responses

    body = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.col("event_id").alias("id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("char"),
                    (F.col("value") / 400).alias("confidence"), F.when(F.col("event_type") == "view", "blurry").alias("note"),
                    F.array(F.col("event_type"), F.lit("a"), F.lit("b"), F.lit("c")).alias("candidates"),
                )
            ).alias("items")
        )
    )
    answers = t.events.select("event_id", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("answer"))
    votes, _ = parse_responses(answers, "answer", ["event_id"])
    return votes.select("event_id", "id", "char", "confidence", "note", F.array_join("candidates", ",").alias("candidates"))


@query(
    "t6_parse_guides",
    with_(
        "rect",
        """SELECT page_id, 'bar' AS role, CASE WHEN kind = 'border' THEN 'frame' ELSE 'frame' END AS kind, CASE WHEN rect_id % 3 = 0 THEN 'left' END AS side,
        x / 150 AS x, y / 150 AS y, least(1, w / 30) AS w, h / 150 AS h, CAST(0.5 AS DOUBLE) AS confidence FROM rect WHERE kind = 'border'
        UNION ALL SELECT page_id, 'tag', NULL, NULL, x / 150, y / 150, least(1, w / 30), h / 150, CAST(0.5 AS DOUBLE) FROM rect WHERE kind = 'tag'""",
    ),
)
def t6(t):
    """Layout guides written as JSON per page (rects of a page), parsed to rows."""
    from inkframe.operators.layout import parse_guides

    item = F.struct(
        F.when(F.col("kind") == "border", "outline").alias("role"), F.when(F.col("rect_id") % 3 == 0, "left").otherwise("inner").alias("side"),
        (F.col("x") / 150).alias("x"), (F.col("y") / 150).alias("y"), (F.col("w") / 30).alias("w"), (F.col("h") / 150).alias("h"),
        F.lit("0.5").alias("confidence"),
    )
    one = B.rects(t).select(
        "page_id",
        F.to_json(
            F.struct(
                F.when(F.col("kind") == "border", F.array(item)).alias("borderBars"), F.when(F.col("kind") == "tag", F.array(item)).alias("tagBlocks")
            )
        ).alias("guide"),
    )
    return parse_guides(one, "guide", ["page_id"])[1].select("page_id", "role", "kind", "side", "x", "y", "w", "h", "confidence")


VARIANT_SAMPLE = [("爲", "為"), ("礼", "禮"), ("云", "雲"), ("国", "國"), ("于", "於")]


@query(
    "t7_normalize_variants",
    with_(
        "glyph",
        "SELECT glyph_id, text, CASE text WHEN '爲' THEN '為' WHEN '礼' THEN '禮' WHEN '云' THEN '雲' WHEN '国' THEN '國' WHEN '于' THEN '於' END AS normalized FROM glyph",
    ),
)
def t7(t):
    v = t.spark.createDataFrame(VARIANT_SAMPLE, "variant string, standard string")
    return D.normalize_variants(B.glyphs(t).select("glyph_id", "text"), "text", v)


@query(
    "t8_script_conversion",
    with_(
        "glyph",
        "SELECT glyph_id, translate(text, '譜趙孫張國遷爲為', '谱赵孙张国迁为为') AS simplified, translate(text, '国张', '國張') AS traditional FROM glyph",
    ),
)
def t8(t):
    return B.glyphs(t).select("glyph_id", D.to_simplified(F.col("text")).alias("simplified"), D.to_traditional(F.col("text")).alias("traditional"))


@query(
    "t9_dict_hits",
    with_(
        "word dict",
        """SELECT doc_id, count(*) AS words, count(*) FILTER (WHERE word IN (SELECT word FROM dict)) AS hits,
        count(*) FILTER (WHERE substring(word, 1, 1) IN (SELECT unnest(string_split(word, '')) FROM dict)) AS char_hits
        FROM (SELECT doc_id, lower(regexp_replace(word, '[^a-zA-Z]', '', 'g')) AS word FROM word) GROUP BY 1""",
    ),
)
def t9(t):
    d = B.dictionary(t)
    w = B.words(t).select("doc_id", F.lower(F.regexp_replace("word", "[^a-zA-Z]", "")).alias("word"))
    w = D.dict_hits(w.withColumn("first", F.substring("word", 1, 1)), "word", d)
    w = D.dict_hits(w, "first", D.term_chars(d).withColumnRenamed("dict_char", "word"), "char_hit")
    return w.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("words"), F.count_if("in_dict").alias("hits"), F.count_if("char_hit").alias("char_hits")
    )


def _peers_sql() -> str:
    rows = ", ".join(f"('{c}', '{p}')" for c, p in D._peer_rows())
    return f"SELECT * FROM (VALUES {rows}) v(c, p)"


@query(
    "t10_expand_candidates",
    with_(
        "glyph",
        """SELECT glyph_id, expanded FROM glyph JOIN (
          SELECT k, left(list_reduce(list_prepend('', string_split(a || e || coalesce(p1.p, '') || coalesce(p2.p, ''), '')),
                 lambda s, x: CASE WHEN contains(s, x) THEN s ELSE s || x END), 8) AS expanded
          FROM base LEFT JOIN peers p1 ON p1.c = a LEFT JOIN peers p2 ON p2.c = e) ON k = coalesce(text, '')""",
        base=f"""SELECT k, CASE WHEN regexp_full_match(k, '{_CJK}') THEN k ELSE '' END AS a, CASE WHEN k <> '子' THEN '子' ELSE '' END AS e
             FROM (SELECT DISTINCT coalesce(text, '') AS k FROM glyph)""",
        peers=_peers_sql(),
    ),
)
def t10(t):
    g = B.glyphs(t).select("glyph_id", "text", F.array(F.lit("子"), F.lit("x")).alias("extras"))
    return D.expand_candidates(g, "text", "extras").select("glyph_id", F.array_join("expanded", "").alias("expanded"))


_FNV = "lower(hex(list_reduce([unicode(c) for c in string_split({0}, '')], lambda h, u: (xor(h, u) * 16777619) & 4294967295, 2166136261)))"


@query("t11_fnv1a", f"SELECT doc_id, {_FNV.format('text')} AS hash FROM documents")
def t11(t):
    return t.documents.select("doc_id", T.fnv1a(F.col("text")).alias("hash"))


@query(
    "t12_batch_hash",
    with_(
        "rect",
        f"""SELECT page_id, n, {_FNV.format("(page_id || ':' || n || ':' || boxes)")} AS hash
        FROM (SELECT page_id, count(*) AS n, string_agg(CAST(x AS BIGINT) || ',' || CAST(y AS BIGINT) || ',' || CAST(x + w AS BIGINT) || ',' || CAST(y + h AS BIGINT), '|' ORDER BY rect_id) AS boxes FROM rect GROUP BY 1)""",
    ),
)
def t12(t):
    r = B.rects(t).selectExpr("page_id", "rect_id", "x AS x0", "y AS y0", "x + w AS x1", "y + h AS y1")
    return T.batch_hash(r, ["page_id"], ["rect_id"])


@query(
    "t13_cache_key",
    f"SELECT doc_id, 'v1:' || source || ':' || lang || ':' || {_FNV.format('text')} || ':' || {_FNV.format('CAST(doc_id AS VARCHAR)')} || ':' || {_FNV.format('lang')} AS key FROM documents",
)
def t13(t):
    return t.documents.select(
        "doc_id",
        T.cache_key(
            F.lit("v1"), F.col("source"), F.col("lang"), T.fnv1a(F.col("text")), T.fnv1a(F.col("doc_id").cast("string")), T.fnv1a(F.col("lang"))
        ).alias("key"),
    )


ANCHORS = ["<article>", "</html>", "og:title"]


def _lint_sql() -> str:
    tokens = T._TOKENS.replace("'", "''")
    anchors = " ".join(
        f"UNION ALL SELECT page_id, 'missing_anchor', NULL, '{a}' FROM pages WHERE NOT contains(html, '{a}')" for a in ANCHORS
    )
    return f"""WITH tok AS MATERIALIZED (SELECT page_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos
      FROM (SELECT page_id, regexp_extract_all(html, '{tokens}', 1) AS toks FROM pages)),
    s AS (SELECT *, CASE WHEN tok IN ('(', '[', '{{') THEN 1 WHEN tok IN (')', ']', '}}') THEN -1 ELSE 0 END AS sign,
      sum(length(tok) - length(replace(tok, chr(10), ''))) OVER p + 1 AS line FROM tok WINDOW p AS (PARTITION BY page_id ORDER BY pos)),
    b AS (SELECT *, sum(sign) OVER (PARTITION BY page_id ORDER BY pos) AS bal FROM s),
    d AS (SELECT *, bal - least(0, min(bal) OVER (PARTITION BY page_id ORDER BY pos)) AS depth FROM b),
    k AS (SELECT *, depth + CASE WHEN sign < 0 THEN 1 ELSE 0 END AS level, sign < 0 AND coalesce(lag(depth) OVER (PARTITION BY page_id ORDER BY pos), 0) = 0 AS orphan FROM d WHERE sign <> 0),
    q AS (SELECT *, lag(tok) OVER w AS bef, lead(pos) OVER w AS aft FROM k WHERE NOT orphan WINDOW w AS (PARTITION BY page_id, level ORDER BY pos)),
    i AS (SELECT page_id, 'open_string' AS rule, line, substring(tok, 1, 1) AS detail FROM d WHERE
      (substring(tok, 1, 3) IN ('\"\"\"', '''''''''') AND NOT (length(tok) >= 6 AND right(tok, 3) = left(tok, 3)))
      OR (substring(tok, 1, 1) = '"' AND substring(tok, 1, 3) <> '\"\"\"' AND NOT regexp_full_match(tok, '"[^"\\\\]*(?:\\\\[\\s\\S][^"\\\\]*)*"'))
      OR (substring(tok, 1, 1) = '''' AND substring(tok, 1, 3) <> '''''''''' AND NOT regexp_full_match(tok, '''[^''\\\\]*(?:\\\\[\\s\\S][^''\\\\]*)*'''))
    UNION ALL SELECT page_id, 'unmatched', line, tok FROM k WHERE orphan
    UNION ALL SELECT page_id, 'unmatched', line, tok FROM q WHERE sign < 0 AND bef <> translate(tok, ')]}}', '([{{')
    UNION ALL SELECT page_id, 'unclosed', line, tok FROM q WHERE sign > 0 AND aft IS NULL {anchors}
    UNION ALL SELECT page_id, 'bom', NULL, NULL FROM pages WHERE html LIKE chr(65279) || '%'
    UNION ALL SELECT page_id, 'carriage_return', NULL, NULL FROM pages WHERE contains(html, chr(13)))
    SELECT page_id, rule, CAST(line AS BIGINT) AS line, detail FROM i"""


@query("t14_lint_text", _lint_sql())
def t14(t):
    return T.lint_text(t.pages, "page_id", "html", ANCHORS)


@query(
    "t15_natural_key",
    """SELECT page_id, array_to_string([CASE WHEN regexp_matches(k, '^[0-9]') THEN lpad(length(regexp_replace(k, '^0+([0-9])', '\\1'))::VARCHAR, 5, '0') || regexp_replace(k, '^0+([0-9])', '\\1') ELSE k END for k in regexp_extract_all(lower(url), '([0-9]+|[^0-9]+)', 1)], '') AS key FROM pages""",
)
def t15(t):
    return t.pages.select("page_id", T.natural_key(F.col("url")).alias("key"))


@query(
    "t16_url_domain",
    """SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'unknown' ELSE lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) END AS domain FROM pages""",
)
def t16(t):
    """Every seventh address is blanked and every third loses its scheme."""
    u = F.expr("CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 3 = 0 THEN regexp_replace(url, '^[a-z]+://', '') ELSE url END")
    return t.pages.select("page_id", T.url_domain(u).alias("domain"))


@query(
    "t17_title_hint",
    with_(
        "word",
        """SELECT doc_id, l, w, CASE WHEN length(regexp_replace(word, '[^a-zA-Z]', '', 'g')) >= 2 THEN regexp_replace(word, '[^a-zA-Z]', '', 'g') END AS hint FROM word""",
    ),
)
def t17(t):
    return B.words(t).select("doc_id", "l", "w", T.title_hint(F.col("word"), LATIN).alias("hint"))


@query(
    "s13_safe_names",
    """SELECT page_id, trim(regexp_replace(url, '[\\\\/:*?"<>|]', '_', 'g')) AS name, 'page' AS fallback FROM pages""",
)
def s13(t):
    return t.pages.select("page_id", T.safe_name(F.col("url"), "page").alias("name"), T.safe_name(F.lit("  "), "page").alias("fallback"))
