"""Page layout: guides, bars, lines, nodes and graphic blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.functions.geometry import clamp01, dist_points, intersection, iou, overlap_min
from inkframe.operators.iterate import greedy_keep
from inkframe.operators.spatial import box_join
from inkframe.session import spread

_BAR = "struct<role:string,side:string,x:string,y:string,w:string,h:string,confidence:string,reason:string>"
GUIDE_SCHEMA = (
    "confidence string, summary string, rules array<string>,"
    " frame struct<hasOuterFrame:string,inset:struct<top:string,right:string,bottom:string,left:string>,thicknessPx:string>,"
    f" borderBars array<{_BAR}>, tagBlocks array<{_BAR}>, excludeZones array<{_BAR}>"
)


def parse_guides(df: DataFrame, col: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Guide JSON -> (one frame row per guide, one row per bar, tag block or excluded zone).

    Numbers are clamped to [0, 1], unknown roles become 'frame', unknown sides null, at most eight rules stay.
    """
    g = df.select(*keys, F.from_json(F.col(col), GUIDE_SCHEMA).alias("g"))
    inset = F.col("g.frame.inset")
    frames = g.select(
        *keys,
        clamp01(F.col("g.confidence")).alias("confidence"),
        F.coalesce("g.summary", F.lit("")).alias("summary"),
        F.slice(F.coalesce("g.rules", F.array().cast("array<string>")), 1, 8).alias("rules"),
        (F.coalesce("g.frame.hasOuterFrame", F.lit("false")) == "true").alias("has_outer_frame"),
        *[F.when(inset.isNotNull(), clamp01(inset[s])).alias(f"inset_{s}") for s in ("top", "right", "bottom", "left")],
        F.when(
            F.coalesce(F.col("g.frame.thicknessPx").try_cast("double"), F.lit(0.0)) != 0,
            F.greatest(F.lit(1.0), F.col("g.frame.thicknessPx").try_cast("double")),
        ).alias("thickness_px"),
    )

    def part(field: str, role: str) -> DataFrame:
        b = F.col("b")
        bar = role == "bar"
        return g.select(*keys, F.explode(f"g.{field}").alias("b")).select(
            *keys,
            F.lit(role).alias("role"),
            (F.when(b["role"].isin("frame", "divider", "decoration"), b["role"]).otherwise("frame") if bar else F.lit(None).cast("string")).alias("kind"),
            (F.when(b["side"].isin("top", "bottom", "left", "right"), b["side"]) if bar else F.lit(None).cast("string")).alias("side"),
            *[clamp01(b[c]).alias(c) for c in ("x", "y", "w", "h", "confidence")],
            (F.coalesce(b["reason"], F.lit("")) if role == "exclude" else F.lit(None).cast("string")).alias("reason"),
        )

    rows = part("borderBars", "bar").unionByName(part("tagBlocks", "tag")).unionByName(part("excludeZones", "exclude"))
    return frames, rows


# ---------------------------------------------------------------------------------------------
# boxes, points and lines against each other: every pair search is a grid-cell equi-join
# ---------------------------------------------------------------------------------------------
def _as_box(df: DataFrame, p: str, x0, y0, x1, y1) -> DataFrame:
    return df.withColumns({f"{p}x0": x0, f"{p}y0": y0, f"{p}x1": x1, f"{p}y1": y1})


def _prefixed(df: DataFrame, p: str, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keep])


def rect_box(p: str = ""):
    x, y, w, h = (F.col(f"{p}{c}") for c in ("x", "y", "w", "h"))
    return x, y, x + w, y + h


def overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: float = 64.0) -> DataFrame:
    """Pairs of rects (x, y, w, h) of two tables that touch, as a_* and b_* columns."""
    left = _as_box(_prefixed(a, "a", keys), "l", *rect_box("a_"))
    right = _as_box(_prefixed(b, "b", keys), "r", *rect_box("b_"))
    pairs = box_join(left, right, keys, cell)
    return pairs.drop(*[f"{s}{c}" for s in "lr" for c in ("x0", "y0", "x1", "y1")])


def _clear_of(rects: DataFrame, others: DataFrame, keys: Sequence[str], threshold: float, cell: float) -> DataFrame:
    """Rects that overlap none of the others by IoU > threshold. Equal rects of a page are met once, and hits are
    listed once for each of them, so neither copies nor the number of their overlaps swell what is joined back."""
    places = [*keys, "x", "y", "w", "h"]
    hit = overlapping(rects.select(*places).distinct(), others.select(*places).distinct(), keys, cell).where(iou(rect_box("a_"), rect_box("b_")) > threshold)
    hit = hit.select(*keys, *[F.col(f"a_{c}").alias(c) for c in "xywh"]).distinct()
    return rects.join(hit.hint("merge"), places, "left_anti").select(*rects.columns)


def spatial_merge(primary: DataFrame, secondary: DataFrame, keys: Sequence[str], rect_id: str, threshold: float = 0.35, cell: float = 64.0) -> DataFrame:
    """All primary rects plus the secondary ones that overlap none of them by IoU > threshold."""
    return primary.unionByName(_clear_of(secondary, primary, keys, threshold, cell))


def outside_zones(rects: DataFrame, zones: DataFrame, keys: Sequence[str], rect_id: str, threshold: float = 0.35, cell: float = 64.0) -> DataFrame:
    """Rects that overlap no excluded zone by IoU > threshold."""
    return _clear_of(rects, zones, keys, threshold, cell)


def points_in_boxes(boxes: DataFrame, points: DataFrame, keys: Sequence[str], cell: float = 64.0) -> DataFrame:
    """(box, point) pairs, edges included. ``points``: keys, px, py and any id columns."""
    left = _as_box(boxes, "l", *rect_box())
    right = _as_box(points, "r", F.col("px"), F.col("py"), F.col("px"), F.col("py"))
    return box_join(left, right, keys, cell)


def boxes_with_points(boxes: DataFrame, points: DataFrame, keys: Sequence[str], rect_id: str, minimum: int = 2, cell: float = 64.0) -> DataFrame:
    """Boxes that hold at least ``minimum`` points, with the count."""
    n = points_in_boxes(boxes, points, keys, cell).groupBy(rect_id).agg(F.count(F.lit(1)).alias("points"))
    return boxes.join(n.where(F.col("points") >= minimum), rect_id)


def remove_inside(graphics: DataFrame, keys: Sequence[str], *, lines: DataFrame | None = None, nodes: DataFrame | None = None, glyphs: DataFrame | None = None, cell: float = 64.0) -> dict[str, DataFrame]:
    """Lines, nodes and glyphs without those inside a graphic.

    A line goes if an end or its midpoint lies within 3 px of a graphic, a node if its centre lies
    within r + 3 px, a glyph if a graphic covers at least 35 % of it.
    """
    keys = list(keys)
    g = graphics.select(*keys, "x", "y", "w", "h")
    out: dict[str, DataFrame] = {}
    if lines is not None:
        spots = F.array(
            F.struct(F.col("x1").alias("px"), F.col("y1").alias("py")),
            F.struct(F.col("x2").alias("px"), F.col("y2").alias("py")),
            F.struct(((F.col("x1") + F.col("x2")) / 2).alias("px"), ((F.col("y1") + F.col("y2")) / 2).alias("py")),
        )
        pts = lines.select(*keys, "line_id", F.explode(spots).alias("s")).select(*keys, "line_id", "s.px", "s.py")
        padded = g.withColumns({"x": F.col("x") - 3, "y": F.col("y") - 3, "w": F.col("w") + 6, "h": F.col("h") + 6})
        hit = points_in_boxes(padded, pts, keys, cell).select("line_id")
        out["lines"] = lines.join(hit, "line_id", "left_anti")
    if nodes is not None:
        pad = F.col("r") + 3
        left = _as_box(nodes.select(*keys, "node_id", "cx", "cy", "r"), "l", F.col("cx") - pad, F.col("cy") - pad, F.col("cx") + pad, F.col("cy") + pad)
        hit = box_join(left, _as_box(g, "r", *rect_box()), keys, cell).select("node_id")
        out["nodes"] = nodes.join(hit, "node_id", "left_anti")
    if glyphs is not None:
        own = glyphs.select(*keys, "glyph_id", "x0", "y0", "x1", "y1")
        left = _as_box(own, "l", F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
        pairs = box_join(left, _as_box(g, "r", *rect_box()), keys, cell)
        box = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))
        area = F.greatest(F.lit(1.0), (box[2] - box[0]) * (box[3] - box[1]))
        hit = pairs.where(intersection(box, rect_box()) / area >= 0.35).select("glyph_id")
        out["glyphs"] = glyphs.join(hit, "glyph_id", "left_anti")
    return out


def remove_left_of(frames: DataFrame, keys: Sequence[str], *, lines: DataFrame | None = None, nodes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Lines and nodes not wholly left of the page frame (2 px slack). ``frames``: keys, frame_x."""
    out: dict[str, DataFrame] = {}
    if lines is not None:
        out["lines"] = lines.join(frames, list(keys)).where(F.greatest("x1", "x2") >= F.col("frame_x") - 2).drop("frame_x")
    if nodes is not None:
        out["nodes"] = nodes.join(frames, list(keys)).where(F.col("cx") + F.col("r") >= F.col("frame_x") - 2).drop("frame_x")
    return out


def add_missing(existing: DataFrame, candidates: DataFrame, keys: Sequence[str], cand_id: str, radius: float) -> DataFrame:
    """Candidates (cx, cy) with no existing centre closer than ``radius``."""
    left = _as_box(candidates.select(*keys, cand_id, F.col("cx").alias("a_cx"), F.col("cy").alias("a_cy")), "l", F.col("a_cx") - radius, F.col("a_cy") - radius, F.col("a_cx") + radius, F.col("a_cy") + radius)
    right = _as_box(existing.select(*keys, "cx", "cy"), "r", F.col("cx"), F.col("cy"), F.col("cx"), F.col("cy"))
    near = box_join(left, right, keys, max(8.0, 2 * radius), dist_points(F.col("a_cx"), F.col("a_cy"), F.col("cx"), F.col("cy")) < radius)
    return candidates.join(near.select(cand_id), cand_id, "left_anti")


def _line_box(df: DataFrame, p: str, pad: Column) -> DataFrame:
    lo = lambda a, b: F.least(F.col(a), F.col(b)) - pad
    hi = lambda a, b: F.greatest(F.col(a), F.col(b)) + pad
    n = "" if f"{p}_x1" not in df.columns else f"{p}_"
    return _as_box(df, p, lo(f"{n}x1", f"{n}x2"), lo(f"{n}y1", f"{n}y2"), hi(f"{n}x1", f"{n}x2"), hi(f"{n}y1", f"{n}y2"))


def line_tolerance(width: str = "width_px") -> Column:
    return F.greatest(F.lit(2.0), F.col(width) + 1)


def line_links(lines: DataFrame, keys: Sequence[str], cell: float = 64.0) -> DataFrame:
    """(line_id, other_id) for lines that touch within the first one's tolerance: same axis end to end, or crossing."""
    keys = list(keys)
    cols = ["line_id", "x1", "y1", "x2", "y2", "width_px", "orientation"]
    a = _line_box(lines.select(*keys, *[F.col(c).alias(f"l_{c}") for c in cols]), "l", line_tolerance("l_width_px"))
    b = _line_box(lines.select(*keys, *[F.col(c).alias(f"r_{c}") for c in cols]), "r", F.lit(0.0))
    # boxes widened by the tolerance meet exactly when axis-parallel lines connect
    pairs = box_join(a, b, keys, cell, F.col("l_line_id") != F.col("r_line_id"))
    return pairs.select(*keys, F.col("l_line_id").alias("line_id"), F.col("r_line_id").alias("other_id"))


def text_occlusion(lines: DataFrame, glyphs: DataFrame, keys: Sequence[str], cell: float = 64.0) -> DataFrame:
    """(line_id, glyph_id) where a line runs through a glyph for at least 45 % of the shorter of both."""
    keys = list(keys)
    ln = _line_box(lines.select(*keys, "line_id", "x1", "y1", "x2", "y2", "width_px", "orientation"), "l", line_tolerance())
    g = glyphs.select(*keys, "glyph_id", *[F.col(c).alias(f"g_{c}") for c in ("x0", "y0", "x1", "y1")])
    g = _as_box(g, "r", *[F.col(f"g_{c}") for c in ("x0", "y0", "x1", "y1")])
    h = F.col("orientation") == "h"
    tol = line_tolerance()
    lx0, lx1, ly0, ly1 = F.least("x1", "x2"), F.greatest("x1", "x2"), F.least("y1", "y2"), F.greatest("y1", "y2")
    gx0, gy0, gx1, gy1 = (F.col(f"g_{c}") for c in ("x0", "y0", "x1", "y1"))
    length = F.sqrt(F.pow(lx1 - lx0, F.lit(2)) + F.pow(ly1 - ly0, F.lit(2)))
    on_axis = F.when(h, F.col("y1").between(gy0 - tol, gy1 + tol)).otherwise(F.col("x1").between(gx0 - tol, gx1 + tol))
    along = F.when(h, F.least(lx1, gx1) - F.greatest(lx0, gx0)).otherwise(F.least(ly1, gy1) - F.greatest(ly0, gy0))
    extent = F.when(h, gx1 - gx0).otherwise(gy1 - gy0)
    cond = on_axis & (F.greatest(F.lit(0.0), along) >= F.least(extent, length) * 0.45)
    return box_join(ln, g, keys, cell, cond).select(*keys, "line_id", "glyph_id")


def partition_lines(lines: DataFrame, glyphs: DataFrame, nodes: DataFrame, keys: Sequence[str], cell: float = 64.0) -> DataFrame:
    """Lines with ``occluding``: short, poorly connected lines that run through text.

    Structural lines always stay: three or more glyph sides long, two or more links, or ending at a node.
    """
    keys = list(keys)
    text = glyphs.where("kind = 'text' and grp <> 'pageno'")
    side = text.groupBy(*keys).agg(F.median(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("__side"))
    links = line_links(lines, keys, cell).groupBy("line_id").agg(F.count(F.lit(1)).alias("__links"))
    over = text_occlusion(lines, text, keys, cell).select("line_id").distinct().withColumn("__over", F.lit(True))
    ends = F.explode(F.array(F.struct(F.col("x1").alias("ex"), F.col("y1").alias("ey")), F.struct(F.col("x2").alias("ex"), F.col("y2").alias("ey"))))
    ep = lines.select(*keys, "line_id", line_tolerance().alias("tol"), ends.alias("e")).select(*keys, "line_id", "tol", "e.ex", "e.ey")
    ep = _as_box(ep, "l", F.col("ex") - F.col("tol"), F.col("ey") - F.col("tol"), F.col("ex") + F.col("tol"), F.col("ey") + F.col("tol"))
    nd = _as_box(nodes.select(*keys, "cx", "cy", "r"), "r", F.col("cx") - F.col("r"), F.col("cy") - F.col("r"), F.col("cx") + F.col("r"), F.col("cy") + F.col("r"))
    at_node = box_join(ep, nd, keys, cell, dist_points(F.col("cx"), F.col("cy"), F.col("ex"), F.col("ey")) <= F.col("r") + F.col("tol"))
    at_node = at_node.select("line_id").distinct().withColumn("__node", F.lit(True))
    j = lines.join(side, keys, "left").join(links, "line_id", "left").join(over, "line_id", "left").join(at_node, "line_id", "left")
    length = dist_points(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    side_or = F.when(F.coalesce("__side", F.lit(0.0)) == 0, 20.0).otherwise(F.col("__side"))
    structural = (length >= side_or * 3) | (F.coalesce("__links", F.lit(0)) >= 2) | F.col("__node").isNotNull()
    return j.withColumns({"links": F.coalesce("__links", F.lit(0)), "occluding": ~structural & F.col("__over").isNotNull()}).drop("__side", "__links", "__over", "__node")


def free_endpoints(lines: DataFrame, keys: Sequence[str], cell: float = 64.0) -> DataFrame:
    """Ends of vertical lines that meet no horizontal line: keys, line_id, end (1|2), ex, ey.

    Copies of ends and of lines meet once.
    """
    keys = list(keys)
    v = lines.where("orientation = 'v'")
    ends = F.explode(F.array(F.struct(F.lit(1).alias("end"), F.col("x1").alias("ex"), F.col("y1").alias("ey")), F.struct(F.lit(2).alias("end"), F.col("x2").alias("ex"), F.col("y2").alias("ey"))))
    ep = v.select(*keys, "line_id", F.col("width_px").alias("vw"), ends.alias("e")).select(*keys, "line_id", "vw", "e.end", "e.ex", "e.ey")
    h = lines.where("orientation = 'h'").select(*keys, F.least("x1", "x2").alias("hx0"), F.greatest("x1", "x2").alias("hx1"), F.col("y1").alias("hy"), F.col("width_px").alias("hw")).distinct()
    # the tolerance depends on both widths: half of each side's share goes to its own box
    part = lambda w: F.ceil(F.col(w) / 2) + 3
    at = [*keys, "ex", "ey", "vw"]
    left = _as_box(ep.select(*at).distinct(), "l", F.col("ex") - part("vw"), F.col("ey") - part("vw"), F.col("ex") + part("vw"), F.col("ey") + part("vw"))
    right = _as_box(h, "r", F.col("hx0") - part("hw"), F.col("hy") - part("hw"), F.col("hx1") + part("hw"), F.col("hy") + part("hw"))
    tol = F.greatest(F.lit(4), F.ceil((F.col("vw") + F.col("hw")) / 2) + 2)
    meet = (F.col("ex") >= F.col("hx0") - tol) & (F.col("ex") <= F.col("hx1") + tol) & (F.abs(F.col("ey") - F.col("hy")) <= tol)
    hit = box_join(left, right, keys, cell, meet).select(*at).distinct()
    return ep.join(hit, at, "left_anti").select(*keys, "line_id", "end", "ex", "ey", F.col("vw").alias("width_px"))


def dedupe_boxes(glyphs: DataFrame, keys: Sequence[str], box_id: str, sides: DataFrame, max_side: float) -> DataFrame:
    """Drop boxes that repeat a larger kept one (greedy, by area then id).

    Two boxes repeat each other when their centres are closer than .36 sides, they are not clearly
    apart on either axis (.35 sides), and they overlap by more than .22 of the smaller or are closer
    than .3 sides. ``sides``: keys, mid_side; ``max_side`` bounds it and sets the grid cell. Exact
    copies of a box are collapsed before pairs are sought, so a pile of copies stays linear.
    """
    keys = list(keys)
    box = ["x0", "y0", "x1", "y1", "cx", "cy"]
    first = glyphs.groupBy(*keys, *box).agg(F.min(box_id).alias(box_id)).join(sides, keys)
    reach = F.col("mid_side") * 0.36
    a = first.select(*keys, F.col(box_id).alias("a_id"), "mid_side", *[F.col(c).alias(f"a_{c}") for c in box])
    b = first.select(*keys, F.col(box_id).alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in box])
    a = _as_box(a, "l", F.col("a_cx") - reach, F.col("a_cy") - reach, F.col("a_cx") + reach, F.col("a_cy") + reach)
    b = _as_box(b, "r", F.col("b_cx"), F.col("b_cy"), F.col("b_cx"), F.col("b_cy"))
    d = dist_points(F.col("a_cx"), F.col("a_cy"), F.col("b_cx"), F.col("b_cy"))
    h_gap = F.greatest("a_x0", "b_x0") - F.least("a_x1", "b_x1")
    v_gap = F.greatest("a_y0", "b_y0") - F.least("a_y1", "b_y1")
    s = F.col("mid_side")
    over = overlap_min(tuple(F.col(f"a_{c}") for c in box[:4]), tuple(F.col(f"b_{c}") for c in box[:4]))
    same = (d < s * 0.36) & (F.greatest(h_gap, v_gap) < s * 0.35) & ((over > 0.22) | (d < s * 0.3))
    edges = box_join(a, b, keys, max(8.0, max_side * 0.72), (F.col("a_id") < F.col("b_id")) & same).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    items = first.select(F.col(box_id).alias("id"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("prio"))
    kept = greedy_keep(items, edges)
    return glyphs.join(kept.withColumnRenamed("id", box_id), box_id, "left_semi")


def union_distinct_tol(rects: DataFrame, keys: Sequence[str], rect_id: str, order: str, tol=(8.0, 8.0, 16.0, 16.0)) -> DataFrame:
    """Rects in order, each kept unless a kept one is within the tolerances in x, y, w and h."""
    keys = list(keys)
    first = rects.groupBy(*keys, "x", "y", "w", "h").agg(F.min(F.struct(F.col(order).alias("o"), F.col(rect_id).alias("i"))).alias("__f"))
    first = first.select(*keys, "x", "y", "w", "h", F.col("__f.i").alias(rect_id), F.col("__f.o").alias("__o"))
    a = first.select(*keys, F.col(rect_id).alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in "xywh"])
    b = first.select(*keys, F.col(rect_id).alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in "xywh"])
    a = _as_box(a, "l", F.col("a_x") - tol[0], F.col("a_y") - tol[1], F.col("a_x") + tol[0], F.col("a_y") + tol[1])
    b = _as_box(b, "r", F.col("b_x"), F.col("b_y"), F.col("b_x"), F.col("b_y"))
    near = F.lit(True)
    for c, t in zip("xywh", tol):
        near = near & (F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) < t)
    edges = box_join(a, b, keys, max(8.0, 2 * tol[0]), near & (F.col("a_id") < F.col("b_id"))).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    items = first.select(F.col(rect_id).alias("id"), (-F.col("__o")).alias("prio"))
    return rects.join(greedy_keep(items, edges).withColumnRenamed("id", rect_id), rect_id, "left_semi")


def free_slots(pages: DataFrame, boxes: DataFrame, keys: Sequence[str], box_size: float, glyph_count: int = 1, orientation: str = "v", step: float | None = None) -> DataFrame:
    """Nearest free place to the page centre for a run of glyphs, one row per page that has one.

    ``pages``: keys, width, height; ``boxes``: keys, x0..y1. Places are tried on a fixed grid, rows first;
    a page's grid is an array of numbers beside the numbers that boxes take, never rows.
    """
    keys = list(keys)
    step = box_size if step is None else step
    edge, pad = max(8.0, box_size * 0.4), max(6.0, box_size * 0.3)
    run = box_size + step * (glyph_count - 1)
    w, h = (run, box_size) if orientation == "h" else (box_size, run)
    scan = max(8.0, min(box_size / 2, 24.0))
    min_x, min_y = edge + w / 2, edge + h / 2
    max_x, max_y = F.col("width") - edge - w / 2, F.col("height") - edge - h / 2
    ny = F.floor((max_y + 0.01 - min_y) / scan).cast("int")
    nx = F.floor((max_x + 0.01 - min_x) / scan).cast("int")
    grid = pages.where((max_x >= min_x) & (max_y >= min_y)).withColumns({"__nx": nx, "__ny": ny})
    place_x, place_y = lambda i: F.lit(min_x) + i * scan, lambda i: F.lit(min_y) + i * scan

    def met(lo: Column, hi: Column, half: float, start: float, n: Column, place) -> Column:
        """Places whose box overlaps lo to hi: the nearby ones, tested exactly."""
        first = F.greatest(F.lit(0), F.floor((lo - half - start) / scan) - 1).cast("int")
        last = F.least(n, F.ceil((hi + half - start) / scan) + 1).cast("int")
        return F.when(first <= last, F.filter(F.sequence(first, last), lambda i: (place(i) - half < hi) & (lo < place(i) + half)))

    # boxes move once, to their pages; what they take is counted there
    occ = spread(boxes.select(*keys, *[(F.col(c) + (pad if c.endswith("1") else -pad)).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")]), *keys).join(grid, keys)
    xs = met(F.col("rx0"), F.col("rx1"), w / 2, min_x, F.col("__nx"), place_x)
    ys = met(F.col("ry0"), F.col("ry1"), h / 2, min_y, F.col("__ny"), place_y)
    taken = occ.select(*keys, "__nx", xs.alias("__xs"), F.explode(ys).alias("__iy")).withColumn("__ix", F.explode("__xs"))
    taken = taken.select(*keys, (F.col("__iy").cast("long") * (F.col("__nx") + 1) + F.col("__ix")).alias("__slot")).distinct().groupBy(*keys).agg(F.collect_list("__slot").alias("__taken"))
    # merge: rows that come out of an explode are many more than the planner thinks, so none may be broadcast
    free = grid.join(taken.hint("merge"), keys, "left")
    slots = F.sequence(F.lit(0).cast("long"), (F.col("__ny").cast("long") + 1) * (F.col("__nx") + 1) - 1)
    open_ = F.array_except(slots, F.coalesce("__taken", F.array().cast("array<long>")))

    def at(slot: Column) -> Column:
        iy = F.floor(slot / (F.col("__nx") + 1)).cast("int")
        ix = (slot - iy * (F.col("__nx") + 1)).cast("int")
        d = dist_points(place_x(ix), place_y(iy), F.col("width") / 2, F.col("height") / 2)
        return F.struct(d.alias("d"), iy.alias("iy"), ix.alias("ix"))

    best = free.select(*keys, F.array_min(F.transform(open_, at)).alias("s")).where("s is not null")
    best = best.select(*keys, F.struct(place_x(F.col("s.ix")).alias("px"), place_y(F.col("s.iy")).alias("py")).alias("b"))
    off = step * (glyph_count - 1) / 2
    return best.select(*keys, (F.col("b.px") - (off if orientation == "h" else 0.0)).alias("x"), (F.col("b.py") - (off if orientation == "v" else 0.0)).alias("y"))
