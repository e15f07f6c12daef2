"""Raster tables: runs, morphology, components, thresholds, ink metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkframe import bindings as B
from inkframe.catalog import query
from inkframe.catalog.sql import with_
from inkframe.operators import raster as R

PK = ["page_id"]
BOX = """SELECT p_partkey % 10 AS page_id, p_partkey AS box_id, CAST(p_partkey * 37 % 48 AS DOUBLE) AS x0, CAST(p_partkey * 91 % 40 AS DOUBLE) AS y0,
   CAST(p_partkey * 37 % 48 + 6 + p_partkey % 11 AS DOUBLE) AS x1, CAST(p_partkey * 91 % 40 + 6 + p_partkey % 23 AS DOUBLE) AS y1 FROM part"""


def boxes(t):
    return t.part.selectExpr(
        "p_partkey % 10 AS page_id", "p_partkey AS box_id", "CAST(p_partkey * 37 % 48 AS DOUBLE) AS x0", "CAST(p_partkey * 91 % 40 AS DOUBLE) AS y0",
        "CAST(p_partkey * 37 % 48 + 6 + p_partkey % 11 AS DOUBLE) AS x1", "CAST(p_partkey * 91 % 40 + 6 + p_partkey % 23 AS DOUBLE) AS y1",
    )


def runs_sql(points: str) -> str:
    """Maximal runs of a point set given as a subquery (page_id, y, x)."""
    return f"SELECT page_id, y, min(x) AS x0, max(x) + 1 AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS g FROM ({points})) GROUP BY page_id, y, g"


@query("r1_to_runs", with_("run", "SELECT * FROM run"))
def r1(t):
    return B.runs(t)


@query("r2_open_h", with_("run", "SELECT * FROM run WHERE x1 - x0 >= 3"))
def r2(t):
    return R.open_runs(B.runs(t), "h", 3)


@query("r2_open_v", with_("ink", runs_sql("SELECT page_id, y, x FROM (SELECT *, count(*) OVER (PARTITION BY page_id, x, g) AS n FROM (SELECT *, y - row_number() OVER (PARTITION BY page_id, x ORDER BY y) AS g FROM ink)) WHERE n >= 3")))
def r2v(t):
    return R.open_runs(B.runs(t), "v", 3)


_NEAR = "range(-1, 2) a(dy), range(-1, 2) b(dx)"
_DIL = f"SELECT DISTINCT page_id, y + dy AS y, x + dx AS x FROM ink JOIN page_size USING (page_id), {_NEAR} WHERE y + dy BETWEEN 0 AND height - 1 AND x + dx BETWEEN 0 AND width - 1"
_ERO = f"SELECT page_id, y + dy AS y, x + dx AS x FROM {{src}}, {_NEAR} GROUP BY 1, 2, 3 HAVING count(*) = 9"


@query("r3_dilate", with_("ink page_size", runs_sql(_DIL)))
def r3(t):
    return R.dilate(B.runs(t), 1, B.page_sizes(t))


@query("r4_erode", with_("ink", runs_sql(_ERO.format(src="dark")), dark="SELECT page_id, y, x FROM pixel WHERE gray < 140"))
def r4(t):
    return R.erode(R.to_runs(B.pixels(t), 140), 1)


@query("r4_close", with_("ink page_size", runs_sql(_ERO.format(src="dl")), dl=_DIL))
def r4c(t):
    return R.close_square(B.runs(t), 1, B.page_sizes(t))


@query("r4_open", with_("ink page_size", runs_sql(_DIL.replace("FROM ink", "FROM er")), dark="SELECT page_id, y, x FROM pixel WHERE gray < 140", er=_ERO.format(src="dark")))
def r4o(t):
    return R.open_square(R.to_runs(B.pixels(t), 140), 1, B.page_sizes(t))


# components of the runs by transitive closure of touching runs
_COMP = {
    "e": "SELECT a.page_id, a.y * 1000 + a.x0 AS a, b.y * 1000 + b.x0 AS b FROM run a JOIN run b ON a.page_id = b.page_id AND b.y = a.y + 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1",
    "s": "SELECT page_id, a, b FROM e UNION ALL SELECT page_id, b, a FROM e",
    "reach": "SELECT page_id, a AS id, least(a, b) AS r FROM s UNION SELECT s.page_id, s.b, reach.r FROM reach JOIN s ON s.page_id = reach.page_id AND s.a = reach.id",
    "lab": "SELECT r.*, coalesce(m.c, r.y * 1000 + r.x0) AS comp FROM run r LEFT JOIN (SELECT page_id, id, min(r) AS c FROM reach GROUP BY 1, 2) m ON m.page_id = r.page_id AND m.id = r.y * 1000 + r.x0",
    "cc": "SELECT page_id, comp, min(x0) AS x, min(y) AS y, max(x1) - min(x0) AS w, max(y) + 1 - min(y) AS h, CAST(sum(x1 - x0) AS BIGINT) AS area FROM lab GROUP BY 1, 2",
}


def comp_sql(body: str, **extra: str) -> str:
    return "WITH RECURSIVE " + with_("run", body, **{**_COMP, **extra})[5:]


@query("r5_components", comp_sql("SELECT page_id, x, y, w, h, area FROM cc"))
def r5(t):
    return R.components(R.label_runs(B.runs(t), PK, 16)).drop("comp")


@query("r6_drop_small", comp_sql("SELECT page_id, y, x0, x1 FROM lab WHERE (page_id, comp) IN (SELECT page_id, comp FROM cc WHERE area >= 8)"))
def r6(t):
    return R.drop_small(B.runs(t), 8)


@query("f12_char_candidates", comp_sql("SELECT page_id, x, y, w, h, area FROM cc WHERE area >= 6 AND w >= 3 AND h >= 3 AND greatest(w, h) / greatest(1, least(w, h)) <= 4 AND area / greatest(1, w * h) >= 0.045"))
def f12(t):
    from inkframe.operators.segment import char_candidates

    c = R.components(R.label_runs(B.runs(t)))
    return char_candidates(c, min_area=6, min_side=3.0, max_side=400, max_aspect=4.0, min_fill=0.045).drop("comp")


_INK = """SELECT b.*, count(i.x) AS ink, min(i.x) AS tx0, min(i.y) AS ty0, max(i.x) + 1 AS tx1, max(i.y) + 1 AS ty1, sum(i.x) / count(i.x) AS icx, sum(i.y) / count(i.x) AS icy,
   count(i.x) / ((least(any_value(width), x1) - x0) * (least(any_value(height), y1) - y0)) AS fill, count(DISTINCT i.x) AS cols, count(DISTINCT i.y) AS rws, any_value(width) AS width, any_value(height) AS height
   FROM bx b JOIN page_size USING (page_id) LEFT JOIN ink i ON i.page_id = b.page_id AND i.x >= x0 AND i.x < x1 AND i.y >= y0 AND i.y < y1 GROUP BY b.page_id, box_id, x0, y0, x1, y1"""


def ink_sql(body: str, **extra: str) -> str:
    return with_("ink page_size", body, bx=BOX, im=_INK, **extra)


@query("j17_ink_join", ink_sql("SELECT box_id, y, CAST(sum(x1 - x0) AS BIGINT) AS n FROM (SELECT b.box_id, r.y, greatest(r.x0, b.x0)::BIGINT AS x0, least(r.x1, b.x1)::BIGINT AS x1 FROM bx b JOIN rn r ON r.page_id = b.page_id AND r.y >= b.y0 AND r.y < b.y1 AND r.x0 < b.x1 AND r.x1 > b.x0) GROUP BY 1, 2", rn=runs_sql("SELECT * FROM ink")))
def j17(t):
    j = R.ink_join(boxes(t), B.runs(t), sizes=B.page_sizes(t))
    return j.groupBy("box_id", "y").agg(F.sum(F.col("x1") - F.col("x0")).alias("n"))


@query("a13_ink_metrics", ink_sql("SELECT box_id, icx AS ink_cx, icy AS ink_cy, tx0, ty0, tx1, ty1, ink AS ink_area, fill FROM im WHERE ink > 0"))
def a13(t):
    return R.ink_metrics(boxes(t), B.runs(t), sizes=B.page_sizes(t)).drop("page_id")


@query("r7_fill_ratio", ink_sql("SELECT box_id, ink, CASE WHEN ink > 0 THEN fill ELSE CAST(0 AS DOUBLE) END AS fill FROM im"))
def r7(t):
    return R.fill_ratio(boxes(t), B.runs(t), sizes=B.page_sizes(t)).select("box_id", "ink", "fill")


_SPAN = "CASE WHEN x1 - x0 >= (y1 - y0) * 2 THEN cols / (least(width, x1) - x0) ELSE rws / (least(height, y1) - y0) END"


@query("r8_span_coverage", ink_sql(f"SELECT box_id, {_SPAN} AS span FROM im"))
def r8(t):
    return R.span_coverage(boxes(t), B.runs(t), sizes=B.page_sizes(t)).select("box_id", "span")


@query("r9_erase", ink_sql(runs_sql("SELECT page_id, y, x FROM ink i WHERE NOT EXISTS (SELECT 1 FROM bx b WHERE b.page_id = i.page_id AND i.x >= x0 AND i.x < x0 + 2 AND i.y = y0)")))
def r9(t):
    """The upper left corner of every box is blanked out (whole boxes would leave no ink)."""
    b = boxes(t).selectExpr("page_id", "CAST(x0 AS BIGINT) AS ex0", "CAST(y0 AS BIGINT) AS ey0", "CAST(x0 + 2 AS BIGINT) AS ex1", "CAST(y0 + 1 AS BIGINT) AS ey1")
    return R.erase(B.runs(t), b)


@query("r9_mask_runs", ink_sql(runs_sql("SELECT DISTINCT page_id, y, x FROM (SELECT page_id, unnest(range(y0::BIGINT, least(height, y1)::BIGINT)) AS y, x0, least(width, x1) AS x1 FROM im), range(0, 64) q(x) WHERE x >= x0 AND x < x1")))
def r9m(t):
    b = boxes(t).selectExpr("page_id", "x0 AS x", "y0 AS y", "x1 - x0 AS w", "y1 - y0 AS h")
    return R.mask_runs(b, B.page_sizes(t))


@query("r29_refine_boxes", ink_sql("""SELECT box_id, CASE WHEN ink >= 4 THEN icx ELSE (x0 + x1) / 2 END AS cx, CASE WHEN ink >= 4 THEN greatest(0, tx0 - pad)::DOUBLE ELSE x0 END AS x0, CASE WHEN ink >= 4 THEN least(height, ty1 + pad)::DOUBLE ELSE y1 END AS y1
   FROM (SELECT *, greatest(1, floor(greatest(tx1 - tx0, ty1 - ty0) * 0.08 + 0.5)) AS pad FROM im)"""))
def r29(t):
    g = boxes(t).withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})
    return R.refine_boxes(g, B.runs(t), B.page_sizes(t), box_id="box_id").select("box_id", "cx", "x0", "y1")


@query("r14_crop", ink_sql("SELECT box_id, y, x0, x1 FROM (" + runs_sql("SELECT b.box_id AS page_id, i.y - greatest(0, y0 - 2) AS y, i.x - greatest(0, x0 - 2) AS x FROM bx b JOIN ink i ON i.page_id = b.page_id AND i.x >= x0 - 2 AND i.x < x1 + 2 AND i.y >= y0 - 2 AND i.y < y1 + 2").replace("SELECT page_id, y, min(x) AS x0, max(x) + 1 AS x1", "SELECT page_id AS box_id, CAST(y AS BIGINT) AS y, CAST(min(x) AS BIGINT) AS x0, CAST(max(x) + 1 AS BIGINT) AS x1") + ")"))
def r14(t):
    return R.crop(boxes(t), B.runs(t), B.page_sizes(t), pad=F.lit(2.0))[0].select("box_id", "y", "x0", "x1")


@query("a16_histogram", with_("pixel", "SELECT page_id, gray, count(*) AS n FROM pixel GROUP BY 1, 2"))
def a16(t):
    return R.histogram(B.pixels(t))


@query("w16_otsu", with_("pixel", """SELECT page_id, arg_min(gray, (-b, gray)) AS threshold FROM (SELECT *, wb * (tot - wb) * (sb / wb - (s - sb) / (tot - wb)) * (sb / wb - (s - sb) / (tot - wb)) AS b FROM
   (SELECT page_id, gray, sum(n) OVER w AS wb, sum(gray * n) OVER w AS sb, sum(n) OVER (PARTITION BY page_id) AS tot, sum(gray * n) OVER (PARTITION BY page_id) AS s FROM (SELECT page_id, gray, count(*) AS n FROM pixel GROUP BY 1, 2) WINDOW w AS (PARTITION BY page_id ORDER BY gray)) WHERE wb < tot) GROUP BY 1"""))
def w16(t):
    return R.otsu(R.histogram(B.pixels(t)))


@query("w17_local_threshold", with_("pixel", """SELECT page_id, y, x, CASE WHEN gray < m * (1 + 0.2 * (sqrt(greatest(0, q / n - m * m)) / 128 - 1)) THEN 1 ELSE 0 END::BIGINT AS ink FROM (SELECT *, s / n AS m FROM
   (SELECT a.page_id, a.y, a.x, a.gray, sum(b.n) AS n, CAST(sum(b.s) AS DOUBLE) AS s, CAST(sum(b.q) AS DOUBLE) AS q FROM pixel a JOIN (SELECT page_id, y, x, count(*) OVER w AS n, sum(gray) OVER w AS s, sum(gray * gray) OVER w AS q FROM pixel
    WINDOW w AS (PARTITION BY page_id, y ORDER BY x RANGE BETWEEN 12 PRECEDING AND 12 FOLLOWING)) b ON a.page_id = b.page_id AND a.x = b.x AND b.y BETWEEN a.y - 12 AND a.y + 12 GROUP BY 1, 2, 3, 4))"""))
def w17(t):
    return R.local_threshold(B.pixels(t)).select("page_id", "y", "x", "ink")


@query("w18_majority_filter", with_("ink", runs_sql(f"SELECT p.page_id, p.y, p.x FROM pixel p JOIN (SELECT page_id, y + dy AS y, x + dx AS x, count(*) AS n, count(*) FILTER (WHERE gray < 128) AS k FROM pixel, {_NEAR} GROUP BY 1, 2, 3) USING (page_id, y, x) WHERE n - k <= n // 2")))
def w18(t):
    p = B.pixels(t).withColumn("ink", (F.col("gray") < 128).cast("int"))
    return R.points_to_runs(R.majority_filter(p).where("ink = 1"))


@query("w19_projection_bands", with_("ink page_size", """SELECT 'h' AS axis, page_id, min(i) AS start, max(i) + 1 AS stop FROM (SELECT *, i - row_number() OVER (PARTITION BY page_id ORDER BY i) AS g FROM (SELECT page_id, y AS i FROM ink JOIN page_size USING (page_id) GROUP BY page_id, y, width HAVING count(*) / width >= 0.2)) GROUP BY page_id, g
   UNION ALL SELECT 'v', page_id, min(i), max(i) + 1 FROM (SELECT *, i - row_number() OVER (PARTITION BY page_id ORDER BY i) AS g FROM (SELECT page_id, x AS i FROM ink JOIN page_size USING (page_id) GROUP BY page_id, x, height HAVING count(*) / height >= 0.2)) GROUP BY page_id, g"""))
def w19(t):
    out = [R.projection_bands(B.runs(t), B.page_sizes(t), a, 0.2).select(F.lit(a).alias("axis"), "page_id", "start", F.col("end").alias("stop")) for a in "hv"]
    return out[0].unionByName(out[1])


@query("f1_drop_blank", with_("pixel page_size", "SELECT page_id FROM page_size JOIN (SELECT page_id, avg(CASE WHEN gray < 240 THEN 1 ELSE 0 END) AS d FROM pixel GROUP BY 1) USING (page_id) WHERE d >= 0.0015"))
def f1(t):
    return R.drop_blank(B.page_sizes(t), B.pixels(t)).select("page_id")


@query("r13_raster_iou", with_("ink pixel", "SELECT page_id, count(*) FILTER (WHERE gray < 114 AND gray >= 100) AS inter, count(*) AS union_, count(*) FILTER (WHERE gray < 114 AND gray >= 100) / count(*) AS iou FROM pixel WHERE gray < 120 GROUP BY 1"))
def r13(t):
    p = B.pixels(t)
    a, b = R.points_to_runs(p.where("gray < 114")), R.points_to_runs(p.where("gray >= 100 and gray < 120"))
    return R.raster_iou(a, b).withColumnRenamed("union", "union_")


@query("u3_overlay", with_("pixel", "SELECT page_id, CASE WHEN gray < 100 THEN 'left' WHEN gray < 114 THEN 'both' ELSE 'right' END AS side, count(*) AS n FROM pixel WHERE gray < 120 GROUP BY 1, 2"))
def u3(t):
    p = B.pixels(t)
    o = R.overlay(R.points_to_runs(p.where("gray < 114")), R.points_to_runs(p.where("gray >= 100 and gray < 120")))
    return o.groupBy("page_id", "side").agg(F.sum(F.col("x1") - F.col("x0")).alias("n"))


_SK = """SELECT page_id, deg, q / height - (s / height) * (s / height) AS score FROM (SELECT page_id, deg, height, sum(c) AS s, sum(c * c) AS q FROM
   (SELECT page_id, deg, height, floor(y - x * tan(deg * pi() / 180) + 0.5) AS yy, count(*) AS c FROM {src} GROUP BY ALL) WHERE yy >= 0 AND yy < height GROUP BY 1, 2, 3)"""


@query(
    "r10_estimate_skew",
    with_(
        "ink page_size",
        """SELECT page_id, coalesce(floor(CASE WHEN fs > top THEN fd ELSE best END * 10 + 0.5) / 10, CAST(0 AS DOUBLE)) AS deskew_deg FROM page_size LEFT JOIN b1 USING (page_id) LEFT JOIN (SELECT page_id, arg_min(deg, (-score, deg)) AS fd, max(score) AS fs FROM s2 GROUP BY 1) USING (page_id)""",
        k="SELECT i.*, height FROM ink i JOIN page_size USING (page_id) WHERE page_id IN (SELECT page_id FROM ink GROUP BY 1 HAVING count(*) >= 100)",
        s1=_SK.format(src="(SELECT *, d / CAST(2 AS DOUBLE) AS deg FROM k, range(-10, 11) r(d))"),
        b1="SELECT page_id, arg_min(deg, (-score, deg)) AS best, max(score) AS top FROM s1 GROUP BY 1",
        s2=_SK.format(src="(SELECT k.*, greatest(-5, best - 0.5) + i * CAST(0.1 AS DOUBLE) AS deg FROM k JOIN b1 USING (page_id), range(0, 11) r(i) WHERE greatest(-5, best - 0.5) + i * CAST(0.1 AS DOUBLE) <= least(5, best + 0.5) + 1e-9)"),
    ),
)
def r10(t):
    return R.estimate_skew(B.runs(t), B.page_sizes(t))


@query(
    "r11_rotate",
    with_(
        "ink page_size",
        runs_sql("""SELECT g.page_id, g.y, g.x FROM (SELECT page_id, y, x, floor((x - width / 2) * cos(a) + (y - height / 2) * sin(a) + width / 2 + 0.5)::BIGINT AS sx, floor(-(x - width / 2) * sin(a) + (y - height / 2) * cos(a) + height / 2 + 0.5)::BIGINT AS sy
        FROM (SELECT *, (page_id - 4) * pi() / 180 AS a, unnest(range(0, height)) AS y FROM page_size), range(0, 64) q(x)) g JOIN ink i ON i.page_id = g.page_id AND i.x = sx AND i.y = sy"""),
    ),
)
def r11(t):
    sizes = B.page_sizes(t)
    return R.rotate(B.runs(t), sizes.select("page_id", (F.col("page_id") - 4).alias("deg")), sizes)


@query(
    "r12_resize_gray",
    with_(
        "pixel page_size",
        """SELECT page_id, y, x, CAST(floor(sum(w * gray) + 1e-9) AS BIGINT) AS gray FROM (SELECT page_id, y, x, unnest([x0, x1, x0, x1]) AS sx, unnest([y0, y0, y1, y1]) AS sy, unnest([(1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy]) AS w FROM
        (SELECT *, sx - x0 AS fx, sy - y0 AS fy, least(width - 1, x0 + 1) AS x1, least(height - 1, y0 + 1) AS y1 FROM (SELECT *, floor(sx)::BIGINT AS x0, floor(sy)::BIGINT AS y0 FROM (SELECT *, least(width - 1, x / CAST(0.6 AS DOUBLE)) AS sx, least(height - 1, y / CAST(0.6 AS DOUBLE)) AS sy
          FROM (SELECT *, unnest(range(0, greatest(1, floor(height * 0.6 + 0.5)::BIGINT))) AS y FROM page_size), range(0, 38) q(x))))) g
        JOIN (SELECT page_id, y AS sy, x AS sx, gray FROM pixel) USING (page_id, sx, sy) GROUP BY 1, 2, 3""",
    ),
)
def r12(t):
    return R.resize_gray(B.pixels(t), B.page_sizes(t), F.lit(0.6))[0]


@query(
    "r12_area_average",
    with_(
        "ink page_size",
        """SELECT page_id, tx AS x, ty AS y, floor(sum((least(x + 1, (tx + 1) * rx) - greatest(x, tx * rx)) * (least(y + 1, (ty + 1) * ry) - greatest(y, ty * ry))) / any_value(rx * ry) * 1000000 + 0.5) / 1000000 AS v
        FROM (SELECT i.*, width / CAST(16 AS DOUBLE) AS rx, height / CAST(16 AS DOUBLE) AS ry FROM ink i JOIN page_size USING (page_id)), range(0, 16) a(tx), range(0, 16) b(ty)
        WHERE least(x + 1, (tx + 1) * rx) - greatest(x, tx * rx) > 1e-12 AND least(y + 1, (ty + 1) * ry) - greatest(y, ty * ry) > 1e-12 GROUP BY 1, 2, 3""",
    ),
)
def r12a(t):
    v = R.resample(R.run_points(B.runs(t)), B.page_sizes(t), PK, F.lit(16), F.lit(16))
    return v.withColumn("v", F.floor(F.col("v") * 1e6 + 0.5) / 1e6)
