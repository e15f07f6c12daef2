"""Glyph boxes from ink: candidate filters, merging, splitting and the segmentation job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.constants import (
    CHAR_MAX_SIZE, CHAR_MIN_AREA, CHAR_MIN_REL_SIDE, CHAR_MIN_SIZE, MARGIN_EDGE_RATIO, MARGIN_INSET_RATIO, MERGE_GAP_FACTOR, MERGE_OVERLAP_MIN, MERGE_REL_AREA_MAX, SPLIT_REL_AREA,
)
from inkframe.functions.geometry import dist_axis_segment_rect, dist_point_segment, dist_points, erase_boxes, erase_rect_boxes, js_round, overlap_1d
from inkframe.operators import layout as L
from inkframe.operators import raster as R
from inkframe.operators.spatial import box_join
from inkframe.session import cut

# thresholds by source kind (fixed values): min area, min fill, fragment area, phantom fill, supplement fill, min side
THRESHOLDS = {"image": (20, 0.045, 6, 0.07, 0.06, 8), "pdf": (24, 0.07, 14, 0.1, 0.08, 10)}


def char_candidates(comps: DataFrame, min_area=20, min_side=9.0, max_side=400, max_aspect=4.0, min_fill=0.045) -> DataFrame:
    """Components of plausible glyph size, aspect and fill (defaults of the first pass)."""
    long_, short = F.greatest("w", "h"), F.least("w", "h")
    fill = F.col("area") / F.greatest(F.lit(1), F.col("w") * F.col("h"))
    return comps.where(
        (F.col("area") >= min_area) & (short >= min_side) & (long_ <= max_side) & (long_ / F.greatest(F.lit(1), short) <= max_aspect) & (fill >= min_fill)
    )


def is_noise(short: Column, ink: Column, side: Column, min_side) -> Column:
    """Too short a box with too little ink for a stroke."""
    return ((short < min_side) & (ink < side * 1.8)) | ((short < F.greatest(F.lit(5.0), side * 0.3)) & (ink < side * 2.4))


def drop_noise(boxes: DataFrame, side: Column, min_side=8) -> DataFrame:
    """Boxes (w, h, ink) that are no noise fragments."""
    return boxes.where(~is_noise(F.least("w", "h"), F.col("ink"), side, min_side))


def drop_phantoms(boxes: DataFrame, kind: Column | None = None) -> DataFrame:
    """Boxes (fill) with enough ink for their source kind."""
    limit = F.lit(THRESHOLDS["image"][3]) if kind is None else F.when(kind == "pdf", THRESHOLDS["pdf"][3]).otherwise(THRESHOLDS["image"][3])
    return boxes.where(F.col("fill") >= limit)


def content_bounds(pages: DataFrame, rects: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Text area of each page (left, right, top, bottom) from its frame bars; without bars the page less a 14 % strip."""
    keys = list(keys)
    r = rects.join(pages.select(*keys, "width", "height"), keys)
    v = (F.col("h") > F.col("w") * 1.8) & (F.col("h") > F.col("height") * 0.22)
    h = (F.col("w") > F.col("h") * 1.8) & (F.col("w") > F.col("width") * 0.22)
    box = F.struct("x", "y", "w", "h")
    bars = r.groupBy(*keys).agg(
        F.count_if(v).alias("nv"), F.min_by(F.when(v, box), F.when(v, F.col("x"))).alias("v0"), F.max_by(F.when(v, box), F.when(v, F.col("x"))).alias("v1"),
        F.count_if(h).alias("nh"), F.min_by(F.when(h, box), F.when(h, F.col("y"))).alias("h0"), F.max_by(F.when(h, box), F.when(h, F.col("y"))).alias("h1"),
    )
    j = pages.select(*keys, "width", "height").join(bars, keys, "left")
    small = F.least("width", "height")
    edge, inset = js_round(small * MARGIN_EDGE_RATIO), js_round(small * MARGIN_INSET_RATIO)

    def axis(size: str, n: str, first: str, last: str, pos: str, length: str):
        lo, hi = edge, F.col(size) - edge
        a, b = F.col(first), F.col(last)
        after = F.greatest(lo, a[pos] + a[length] + inset)
        before = F.least(hi, b[pos] - inset)
        near = a[pos] < F.col(size) * 0.45
        low = F.when((F.col(n) >= 2) | ((F.col(n) == 1) & near), after).otherwise(lo)
        high = F.when((F.col(n) >= 2) | ((F.col(n) == 1) & ~near), before).otherwise(hi)
        return F.greatest(F.lit(0.0), F.least(low, F.col(size) - 1)), F.greatest(F.lit(1.0), F.least(high, F.col(size)))

    left, right = axis("width", "nv", "v0", "v1", "x", "w")
    top, bottom = axis("height", "nh", "h0", "h1", "y", "h")
    return j.select(*keys, *[c.cast("double").alias(n) for c, n in ((left, "left"), (right, "right"), (top, "top"), (bottom, "bottom"))])


def in_margin(x: Column, y: Column) -> Column:
    return (x < F.col("left")) | (x > F.col("right")) | (y < F.col("top")) | (y > F.col("bottom"))


def margin_flag(points: DataFrame, bounds: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Points (cx, cy) with ``margin``: outside the page's text area."""
    j = points.join(bounds, list(keys))
    return j.withColumn("margin", in_margin(F.col("cx"), F.col("cy"))).drop("left", "right", "top", "bottom")


def split_at_valley(boxes: DataFrame, runs: DataFrame, axis: str, keys: Sequence[str] = ("page_id",), box_id: str = "box_id", band: tuple[float, float] = (0.3, 0.7), depth: float = 0.12) -> DataFrame:
    """Cut boxes (x, y, w, h) at the emptiest line of their middle, if it is nearly empty: axis 'x' for wide, 'y' for tall.

    Returns keys, box_id, part (0 whole, 1 and 2 halves), x, y, w, h. The first of equal minima wins.
    """
    keys = list(keys)
    b = boxes.select(*keys, box_id, *[F.col(c).cast("long").alias(c) for c in ("x", "y", "w", "h")])
    size, other = ("w", "h") if axis == "x" else ("h", "w")
    pos = "x" if axis == "x" else "y"
    lo, hi = F.floor(F.col(size) * band[0]), F.ceil(F.col(size) * band[1])
    cand = b.select(*keys, box_id, F.explode(F.sequence(lo, F.greatest(lo, hi - 1))).alias("__i"), pos).withColumn("__p", F.col(pos) + F.col("__i"))
    box = b.select(*keys, box_id, F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    ink = R.ink_join(box, runs, keys, box_id)
    if axis == "x":
        ink = ink.select(*keys, box_id, F.explode(F.sequence("x0", F.col("x1") - 1)).alias("__p"), F.lit(1).alias("n"))
    else:
        ink = ink.select(*keys, box_id, F.col("y").alias("__p"), (F.col("x1") - F.col("x0")).alias("n"))
    # candidates are lines without ink that the ink is added to; their column __i marks them
    each = cand.select(*keys, box_id, "__p", F.lit(0).cast("long").alias("n"), "__i").unionByName(ink.select(*keys, box_id, "__p", F.col("n").cast("long").alias("n"), F.lit(None).cast("long").alias("__i")))
    prof = each.groupBy(*keys, box_id, "__p").agg(F.sum("n").alias("n"), F.max("__i").alias("i")).where("i is not null")
    low = prof.groupBy(*keys, box_id).agg(F.min(F.struct("n", "i")).alias("m"))
    j = b.join(low.hint("merge"), [*keys, box_id])
    at = F.col("m.i")
    ok = (F.col("m.n") <= F.col(other) * depth) & (at >= CHAR_MIN_SIZE) & (F.col(size) - at >= CHAR_MIN_SIZE)
    whole = F.struct(F.lit(0).alias("part"), "x", "y", "w", "h")
    if axis == "x":
        halves = (F.struct(F.lit(1).alias("part"), "x", "y", at.alias("w"), "h"), F.struct(F.lit(2).alias("part"), (F.col("x") + at).alias("x"), "y", (F.col("w") - at).alias("w"), "h"))
    else:
        halves = (F.struct(F.lit(1).alias("part"), "x", "y", "w", at.alias("h")), F.struct(F.lit(2).alias("part"), "x", (F.col("y") + at).alias("y"), "w", (F.col("h") - at).alias("h")))
    return j.select(*keys, box_id, F.explode(F.when(ok, F.array(*halves)).otherwise(F.array(whole))).alias("s")).select(*keys, box_id, "s.*")


def merge_boxes(boxes: DataFrame, keys: Sequence[str], sizes: DataFrame, cell: float = 64.0) -> DataFrame:
    """Join broken strokes: keys, box_id, x, y, w, h, area, merged.

    Two boxes belong together when their union is no larger than 1.4 typical areas and, along the
    axis that separates their centres, they overlap sideways by .6 and are at most .25 sides apart.
    Each round merges the closest pairs first, every box once, and repeats until no pair is left.
    The strict order (gap, ids) replaces a first-index scan, so competing merges may group otherwise.
    ``sizes``: keys, typical_area, typical_side.
    """
    keys = list(keys)
    cols = ["x", "y", "w", "h", "area"]
    cur = cut(boxes.select(*keys, "box_id", *[F.col(c).cast("double").alias(c) for c in cols], F.lit(False).alias("merged")))
    while True:  # every round but the last merges a pair
        j = cur.join(sizes.select(*keys, "typical_area", "typical_side"), keys)
        reach = F.col("typical_side") * MERGE_GAP_FACTOR
        a = j.select(*keys, "typical_area", "typical_side", *[F.col(c).alias(f"a_{c}") for c in ("box_id", *cols)])
        ax0, ay0, ax1, ay1 = L.rect_box("a_")
        a = L._as_box(a, "l", ax0 - reach, ay0 - reach, ax1 + reach, ay1 + reach)
        b = cur.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("box_id", *cols)])
        bx0, by0, bx1, by1 = L.rect_box("b_")
        b = L._as_box(b, "r", bx0, by0, bx1, by1)
        uw, uh = F.greatest(ax1, bx1) - F.least(ax0, bx0), F.greatest(ay1, by1) - F.least(ay0, by0)
        small = uw * uh / F.greatest(F.lit(1.0), F.col("typical_area")) <= MERGE_REL_AREA_MAX
        vertical = F.abs((by0 + by1) - (ay0 + ay1)) >= F.abs((bx0 + bx1) - (ax0 + ax1))
        gap = F.when(vertical, F.greatest(F.lit(0.0), by0 - ay1, ay0 - by1)).otherwise(F.greatest(F.lit(0.0), bx0 - ax1, ax0 - bx1))
        side = F.when(vertical, overlap_1d(ax0, ax1, bx0, bx1)).otherwise(overlap_1d(ay0, ay1, by0, by1))
        cond = (F.col("a_box_id") < F.col("b_box_id")) & small & (side >= MERGE_OVERLAP_MIN) & (gap <= reach)
        pairs = box_join(a, b, keys, cell, cond)
        # a box may be first in one pair and second in another: both ends share one id space
        e = pairs.select(F.col("a_box_id").alias("l"), F.col("b_box_id").alias("r"), F.struct(gap.alias("g"), F.col("a_box_id").alias("a"), F.col("b_box_id").alias("b")).alias("cost"))
        ends = e.select(F.col("l").alias("n"), "cost").union(e.select(F.col("r").alias("n"), "cost")).groupBy("n").agg(F.min("cost").alias("best"))
        bl, br = ends.select(F.col("n").alias("l"), F.col("best").alias("bl")), ends.select(F.col("n").alias("r"), F.col("best").alias("br"))
        taken = cut(e.join(bl, "l").join(br, "r").where("cost = bl and cost = br").select("l", "r"))
        if taken.isEmpty():
            return cur
        part = cur.join(taken.select(F.col("r").alias("box_id"), F.col("l").alias("__to")), "box_id", "left").withColumn("box_id", F.coalesce("__to", "box_id"))
        g = part.groupBy(*keys, "box_id").agg(
            F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("__x1"), F.max(F.col("y") + F.col("h")).alias("__y1"),
            F.sum("area").alias("area"), (F.max("merged") | (F.count(F.lit(1)) > 1)).alias("merged"),
        )
        cur = cut(g.select(*keys, "box_id", "x", "y", (F.col("__x1") - F.col("x")).alias("w"), (F.col("__y1") - F.col("y")).alias("h"), "area", "merged"))


def drop_line_residue(glyphs: DataFrame, runs: DataFrame, lines: DataFrame, nodes: DataFrame, sizes: DataFrame, sides: DataFrame, keys: Sequence[str] = ("page_id",), cell: float = 64.0) -> DataFrame:
    """Drop boxes that hold the rest of a line or node circle instead of a glyph.

    Evidence: ink on a node's ring, small ink at a node, long thin ink, thin ink continuing or
    touching a line, two crossing bars on a line, a flat box along a line. ``sides``: keys, mid_side.
    Copies of boxes, lines and nodes give the same evidence, so one of each meets the others.
    """
    keys = list(keys)
    every = glyphs
    glyphs, members = R.per_place(every, keys, "glyph_id", ("x0", "y0", "x1", "y1", "cx", "cy"))
    lines = lines.groupBy(*keys, "x1", "y1", "x2", "y2", "width_px", "orientation").agg(F.min("line_id").alias("line_id"))
    nodes = nodes.groupBy(*keys, "cx", "cy", "r").agg(F.min("node_id").alias("node_id"))
    m = R.ink_metrics(glyphs, runs, keys, "glyph_id", sizes).select(*keys, "glyph_id", "tx0", "ty0", "tx1", "ty1", "ink_area")
    g = cut(glyphs.join(m, [*keys, "glyph_id"], "left").join(sides, keys))
    s = F.col("mid_side")
    iw, ih = F.col("tx1") - F.col("tx0"), F.col("ty1") - F.col("ty0")
    has_ink = F.col("ink_area").isNotNull()
    g = g.withColumns({"iw": iw, "ih": ih, "ishort": F.least(iw, ih), "ilong": F.greatest(iw, ih)})
    drop = []
    # 1. node rings: share of the box's ink within the ring band
    gb = L._as_box(g.where(has_ink).select(*keys, "glyph_id", "cx", "cy", "tx0", "ty0", "tx1", "ty1", "ishort", "ink_area", "mid_side"), "l", F.col("tx0"), F.col("ty0"), F.col("tx1"), F.col("ty1"))
    nd = nodes.select(*keys, "node_id", F.col("cx").alias("ncx"), F.col("cy").alias("ncy"), F.col("r").alias("nr"), F.greatest(F.lit(3.0), F.col("r") * 0.22).alias("ntol"))
    pad = F.col("nr") + F.col("ntol")
    meet = box_join(gb, L._as_box(nd, "r", F.col("ncx") - pad, F.col("ncy") - pad, F.col("ncx") + pad, F.col("ncy") + pad), keys, cell)
    ink = R.ink_join(g.where(has_ink), runs, keys, "glyph_id", sizes)
    pts = ink.select(*keys, "glyph_id", "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))
    ring = pts.join(meet.select(*keys, "glyph_id", "node_id", "ncx", "ncy", "nr", "ntol"), [*keys, "glyph_id"])
    on = F.abs(dist_points(F.col("x"), F.col("y"), F.col("ncx"), F.col("ncy")) - F.col("nr")) <= F.col("ntol")
    share = ring.groupBy("glyph_id", "node_id").agg((F.count_if(on) / F.count(F.lit(1))).alias("share"))
    drop.append(share.where("share >= 0.55").select("glyph_id"))
    reach = F.greatest(F.lit(3.0), s * 0.35)
    centre = L._as_box(g.where(has_ink).select(*keys, "glyph_id", "cx", "cy", "ishort", "mid_side"), "l", F.col("cx") - reach, F.col("cy") - reach, F.col("cx") + reach, F.col("cy") + reach)
    near = box_join(centre, L._as_box(nd, "r", F.col("ncx") - F.col("nr"), F.col("ncy") - F.col("nr"), F.col("ncx") + F.col("nr"), F.col("ncy") + F.col("nr")), keys, cell,
                    (dist_points(F.col("cx"), F.col("cy"), F.col("ncx"), F.col("ncy")) <= F.col("nr") + reach) & (F.col("ishort") < s * CHAR_MIN_REL_SIDE))
    drop.append(near.select("glyph_id"))
    # 2. long thin ink
    aspect = F.col("ilong") / F.greatest(F.lit(1), F.col("ishort"))
    drop.append(g.where(has_ink & (aspect >= 3) & (F.col("ilong") > s * 1.35)).select("glyph_id"))
    # 3. thin ink against lines
    ln = lines.select(*keys, "line_id", "x1", "y1", "x2", "y2", F.col("width_px").alias("lw"), "orientation")
    lb = L._line_box(ln, "r", F.col("lw"))
    touch = F.greatest(F.lit(3.0), s * 0.12)
    far = F.greatest(s * 0.6, touch) + F.lit(4.0)
    gl = g.where(has_ink).select(*keys, "glyph_id", "cx", "cy", "tx0", "ty0", "tx1", "ty1", "iw", "ih", "ishort", "ilong", "mid_side")
    gl = L._as_box(gl, "l", F.least(F.col("tx0"), F.col("cx")) - far, F.least(F.col("ty0"), F.col("cy")) - far, F.greatest(F.col("tx1"), F.col("cx")) + far, F.greatest(F.col("ty1"), F.col("cy")) + far)
    close = cut(box_join(gl, lb, keys, cell))
    mx0, my0, mx1, my1 = F.col("tx0"), F.col("ty0"), F.col("tx1") - 1, F.col("ty1") - 1
    hink = F.col("iw") >= F.col("ih")
    same = (hink & (F.col("orientation") == "h")) | (~hink & (F.col("orientation") == "v"))
    thin = (F.col("ishort") <= F.greatest(F.lit(4.0), s * 0.25)) & (F.col("ilong") >= s * 0.25) & (F.col("ilong") <= s * 1.35)
    axis_tol = F.greatest(F.lit(3.0), F.col("lw") + 2)
    on_axis = F.when(hink, F.abs(F.col("cy") - F.col("y1"))).otherwise(F.abs(F.col("cx") - F.col("x1"))) <= axis_tol
    lo = F.when(hink, F.least("x1", "x2")).otherwise(F.least("y1", "y2"))
    hi = F.when(hink, F.greatest("x1", "x2")).otherwise(F.greatest("y1", "y2"))
    i0, i1 = F.when(hink, mx0).otherwise(my0), F.when(hink, mx1).otherwise(my1)
    gap = F.greatest(F.lit(0.0), i0 - hi, lo - i1)
    tail = same & on_axis & (gap <= s * 0.6) & (F.col("ilong") >= F.when(hink, s * 1.05).otherwise(s * 0.6))
    d_rect = dist_axis_segment_rect(F.col("orientation"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), mx0 - touch, my0 - touch, mx1 + touch, my1 + touch)
    touches = d_rect <= F.col("lw") / 2 + 1
    drop.append(close.where(thin & (tail | (~same & touches))).select("glyph_id"))
    # 4. one horizontal and one vertical bar, touching a line
    cand = close.where(touches & (F.col("iw") >= s * 0.4) & (F.col("ih") >= s * 0.4)).select(*keys, "glyph_id", "tx0", "ty0", "iw", "ih", "mid_side").distinct()
    cp = pts.join(cand, [*keys, "glyph_id"])
    thick = F.greatest(F.lit(3), js_round(F.col("mid_side") * 0.28))

    def bar(p: str, span: str, name: str) -> DataFrame:
        prof = cp.groupBy("glyph_id", p, span, "mid_side").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.col(span) * 0.5)
        b = prof.groupBy("glyph_id", "mid_side").agg(F.min(p).alias(f"{name}0"), F.max(p).alias(f"{name}1"))
        return b.where(F.col(f"{name}1") - F.col(f"{name}0") + 1 <= thick).select("glyph_id", f"{name}0", f"{name}1")

    cross = cp.join(bar("y", "iw", "h"), "glyph_id").join(bar("x", "ih", "v"), "glyph_id")
    out = ~F.col("y").between(F.col("h0"), F.col("h1")) & ~F.col("x").between(F.col("v0"), F.col("v1"))
    cross = cross.groupBy("glyph_id").agg(F.count_if(out).alias("o"), F.count(F.lit(1)).alias("n"))
    drop.append(cross.where("o <= n * 0.1").select("glyph_id"))
    # 5. flat boxes along a line; lone thin uprights
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    flat_h = F.when(has_ink & (aspect >= 3), F.col("iw") >= F.col("ih")).otherwise((w >= h * 2.2) & (w >= s * 0.6))
    flat_v = F.when(has_ink & (aspect >= 3), F.col("ih") >= F.col("iw")).otherwise((h >= w * 2.2) & (h >= s * 0.6))
    lone = has_ink & (aspect >= 3) & (F.col("ih") >= F.col("iw")) & (F.col("iw") <= F.greatest(F.lit(3.0), s * 0.18)) & (F.col("ih") >= s * 0.85)
    drop.append(g.where(lone).select("glyph_id"))
    fb = g.withColumns({"flat_h": flat_h, "flat_v": flat_v, "bw": w, "bh": h}).where("flat_h or flat_v")
    fb = fb.select(*keys, "glyph_id", "cx", "cy", *[F.col(c).alias(f"g{c}") for c in ("x0", "y0", "x1", "y1")], "flat_h", "flat_v", "bw", "bh", "mid_side")
    wide = F.least("bw", "bh") + F.lit(40.0)
    fl = box_join(L._as_box(fb, "l", F.col("gx0") - wide, F.col("gy0") - wide, F.col("gx1") + wide, F.col("gy1") + wide), lb, keys, cell)
    tol = F.greatest(F.lit(4.0), F.col("lw") * 2 + F.least("bw", "bh"))
    dir_ok = ~(F.col("flat_h") & (F.col("orientation") != "h")) & ~(F.col("flat_v") & (F.col("orientation") != "v"))
    near_line = dist_point_segment(F.col("cx"), F.col("cy"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) <= tol
    over_h = F.greatest(F.lit(0.0), F.least("gx1", F.greatest("x1", "x2")) - F.greatest("gx0", F.least("x1", "x2")))
    over_v = F.greatest(F.lit(0.0), F.least("gy1", F.greatest("y1", "y2")) - F.greatest("gy0", F.least("y1", "y2")))
    along_h = (over_h >= F.least(F.col("bw"), s) * 0.35) | (F.least(F.abs(F.col("gx0") - F.col("x2")), F.abs(F.col("gx1") - F.col("x1"))) <= tol)
    along_v = (over_v >= F.least(F.col("bh"), s) * 0.35) | (F.least(F.abs(F.col("gy0") - F.col("y2")), F.abs(F.col("gy1") - F.col("y1"))) <= tol)
    drop.append(fl.where(dir_ok & near_line & F.when(F.col("flat_h"), along_h).otherwise(along_v)).select("glyph_id"))
    gone = drop[0]
    for d in drop[1:]:
        gone = gone.union(d)
    gone = members.join(gone.withColumnRenamed("glyph_id", "place"), "place", "left_semi")
    return every.join(gone, "glyph_id", "left_anti")


def _tighten(boxes: DataFrame, runs: DataFrame, sizes: DataFrame, keys, extra: Sequence[str] = ()) -> DataFrame:
    b = boxes.select(*keys, "box_id", *extra, F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    m = R.ink_metrics(b, runs, keys, "box_id", sizes)
    t = m.select(*keys, "box_id", F.col("tx0").alias("x"), F.col("ty0").alias("y"), (F.col("tx1") - F.col("tx0")).alias("w"), (F.col("ty1") - F.col("ty0")).alias("h"), F.col("ink_area").alias("area"), "ink_cx", "ink_cy")
    return t.join(boxes.select("box_id", *extra), "box_id") if extra else t


def _comp_id(c: str = "comp") -> Column:
    """Component id as a number, unique within a page: first row and column of its first run."""
    return (F.col(f"{c}.y") * 1048576 + F.col(f"{c}.x0")).cast("long")


def segment(runs: DataFrame, sizes: DataFrame, lines: DataFrame, rects: DataFrame, nodes: DataFrame | None = None, kind: str = "image", group_radius: int = 2, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Glyph boxes of pages: erase lines and graphics, group strokes, tighten, merge, split, filter, add what was missed.

    Returns page_id, glyph_id, cx, cy, x0..y1, note ('split' | 'merge' | 'empty').
    """
    keys = list(keys)
    min_area, min_fill, fragment, phantom, sup_fill, min_side = THRESHOLDS[kind]
    clean = R.erase(runs, erase_boxes(lines), keys)
    clean = cut(R.erase(clean, erase_rect_boxes(rects), keys))
    denoised = cut(R.drop_small(clean, fragment, keys))
    grouped = R.components(R.label_runs(R.dilate(denoised, group_radius, sizes, keys), keys), keys)
    boxes = grouped.select(*keys, F.xxhash64(*keys, _comp_id()).alias("box_id"), "x", "y", "w", "h")
    raw = cut(char_candidates(_tighten(boxes, denoised, sizes, keys), min_area, CHAR_MIN_SIZE * 1.5, CHAR_MAX_SIZE, 4.0, min_fill))
    typ = raw.groupBy(*keys).agg(F.median("h").alias("th"), F.median("w").alias("tw"))
    typ = cut(typ.select(*keys, "th", "tw", (F.col("tw") * F.col("th")).alias("typical_area"), ((F.col("tw") + F.col("th")) / 2).alias("typical_side")))
    merged = merge_boxes(raw.select(*keys, "box_id", "x", "y", "w", "h", "area"), keys, typ).join(typ, keys)
    rel = F.col("w") * F.col("h") / F.greatest(F.lit(1.0), F.col("typical_area"))
    wide = (rel > SPLIT_REL_AREA) | ((F.col("w") > F.col("tw") * 1.8) & (F.col("w") > F.col("h") * 1.3))
    tall = ~wide & (F.col("h") > F.col("th") * 1.45) & (F.col("h") > F.col("w") * 1.15)
    merged = cut(merged.withColumns({"wide": wide, "tall": tall}))
    halves = split_at_valley(merged.where("wide"), clean, "x", keys).unionByName(split_at_valley(merged.where("tall"), clean, "y", keys))
    flags = merged.select("box_id", "merged")
    pieces = halves.join(flags, "box_id").select(*keys, "box_id", "part", *[F.col(c).cast("double").alias(c) for c in "xywh"], "merged")
    pieces = pieces.unionByName(merged.where("not wide and not tall").select(*keys, "box_id", F.lit(0).alias("part"), "x", "y", "w", "h", "merged"))
    note = F.when(F.col("part") > 0, "split").when(F.col("merged"), "merge").otherwise("empty")
    pieces = pieces.select(*keys, F.xxhash64("box_id", "part").alias("box_id"), "x", "y", "w", "h", note.alias("note"))
    tight = _tighten(pieces, clean, sizes, keys, ["note"]).join(typ, keys)
    ok = (F.col("w") >= CHAR_MIN_SIZE) & (F.col("h") >= CHAR_MIN_SIZE) & (F.greatest("w", "h") / F.greatest(F.lit(1), F.least("w", "h")) <= 2.2)
    tight = tight.where(ok & ~is_noise(F.least("w", "h"), F.col("area"), F.col("typical_side"), min_side))
    as_glyph = lambda df, n: df.select(
        *keys, F.col("box_id").alias("glyph_id"), F.col("ink_cx").alias("cx"), F.col("ink_cy").alias("cy"), F.col("x").cast("double").alias("x0"), F.col("y").cast("double").alias("y0"),
        (F.col("x") + F.col("w")).cast("double").alias("x1"), (F.col("y") + F.col("h")).cast("double").alias("y1"), n.alias("note"),
    )
    glyphs = cut(as_glyph(tight, F.col("note")))
    # components the grouping missed
    comps = R.components(R.label_runs(denoised, keys), keys).join(typ, keys)
    lo, hi = F.greatest(F.lit(CHAR_MIN_SIZE), js_round(F.col("th") * 0.45)), F.least(F.lit(CHAR_MAX_SIZE), js_round(F.col("th") * 2.2))
    extra = comps.where(
        (F.col("area") >= min_area) & (F.least("w", "h") >= lo) & (F.greatest("w", "h") <= hi) & (F.greatest("w", "h") / F.greatest(F.lit(1), F.least("w", "h")) <= 2.4)
        & (F.col("area") / (F.col("w") * F.col("h")) >= sup_fill) & ~is_noise(F.least("w", "h"), F.col("area"), F.col("th"), F.greatest(F.lit(6), js_round(F.col("th") * 0.4)))
    )
    extra = extra.select(*keys, F.xxhash64(*keys, _comp_id(), F.lit("extra")).alias("box_id"), "x", "y", "w", "h", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"), F.greatest(lo.cast("double"), F.col("th") * 0.34).alias("radius"))
    e = L._as_box(extra, "l", F.col("cx") - F.col("radius"), F.col("cy") - F.col("radius"), F.col("cx") + F.col("radius"), F.col("cy") + F.col("radius"))
    have = L._as_box(glyphs.select(*keys, F.col("cx").alias("hx"), F.col("cy").alias("hy")), "r", F.col("hx"), F.col("hy"), F.col("hx"), F.col("hy"))
    near = box_join(e, have, keys, 64.0, dist_points(F.col("cx"), F.col("cy"), F.col("hx"), F.col("hy")) < F.col("radius")).select("box_id")
    extra = extra.join(near, "box_id", "left_anti").withColumns({"ink_cx": F.col("cx"), "ink_cy": F.col("cy")})
    glyphs = glyphs.unionByName(as_glyph(extra, F.lit("empty")))
    filled = R.fill_ratio(glyphs, clean, keys, "glyph_id", sizes).where(F.col("fill") >= phantom).drop("ink", "fill")
    glyphs = cut(filled)
    if nodes is None:
        nodes = lines.sparkSession.createDataFrame([], "page_id long, node_id long, cx double, cy double, r double")
    return drop_line_residue(glyphs, clean, lines, nodes, sizes, typ.select(*keys, F.col("typical_side").alias("mid_side")), keys)
