"""Column builders for measures, boxes and distances. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.constants import MM_PER_PT, PT_PER_MM


def js_round(c: Column) -> Column:
    """Half-up rounding towards +infinity (F.round rounds negative halves away from zero)."""
    return F.floor(c + 0.5)


def round_to(c: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


# px <-> mm <-> pt
def px_to_mm(px: Column, ppmm: Column) -> Column:
    return px / ppmm


def mm_to_px(mm: Column, ppmm: Column) -> Column:
    return mm * ppmm


def height_to_pt(px: Column, ppmm: Column) -> Column:
    return F.when(ppmm > 0, px / ppmm / MM_PER_PT).otherwise(0.0)


def line_width_to_pt(px: Column, ppmm: Column) -> Column:
    return F.when(ppmm > 0, px / ppmm * PT_PER_MM).otherwise(0.0)


def pt_to_px(pt: Column, ppmm: Column) -> Column:
    return pt * MM_PER_PT * ppmm


# normalised <-> pixel
def norm_to_px(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, ...]:
    one = F.lit(1)
    return (
        js_round(x * width),
        js_round(y * height),
        F.greatest(one, js_round(w * width)),
        F.greatest(one, js_round(h * height)),
    )


def px_to_rel(v: Column, size: Column) -> Column:
    return round_to(v / size, 4)


# boxes
def with_box_metrics(df: DataFrame, box=("x0", "y0", "x1", "y1")) -> DataFrame:
    """Add bw, bh, area, side (longer edge), mean_side, aspect and the box centre."""
    x0, y0, x1, y1 = (F.col(c) for c in box)
    w, h = x1 - x0, y1 - y0
    return df.withColumns(
        {
            "bw": w,
            "bh": h,
            "area": w * h,
            "side": F.greatest(w, h),
            "mean_side": (w + h) / 2,
            "aspect": F.greatest(w, h) / F.greatest(F.lit(1.0), F.least(w, h)),
            "mid_x": (x0 + x1) / 2,
            "mid_y": (y0 + y1) / 2,
        }
    )


def overlap_1d(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    inter = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    span = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(span > 0, inter / span).otherwise(0.0)


def intersection(a, b) -> Column:
    """Overlap area of two (x0, y0, x1, y1) boxes, 0 when they do not overlap."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a, b) -> Column:
    inter = intersection(a, b)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def overlap_min(a, b) -> Column:
    """Overlap over the smaller area (areas count as at least 1)."""
    one = F.lit(1.0)
    area_a = F.greatest(one, (a[2] - a[0]) * (a[3] - a[1]))
    area_b = F.greatest(one, (b[2] - b[0]) * (b[3] - b[1]))
    return intersection(a, b) / F.least(area_a, area_b)


def union_box(a, b) -> tuple[Column, ...]:
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def dist_points(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)


def dist_point_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    length_sq = dx * dx + dy * dy
    t = clamp(((px - x1) * dx + (py - y1) * dy) / length_sq, 0.0, 1.0)
    return F.when(length_sq <= 0, dist_points(px, py, x1, y1)).otherwise(
        dist_points(px, py, x1 + t * dx, y1 + t * dy)
    )


def dist_axis_segment_rect(orient: Column, x1, y1, x2, y2, rx0, ry0, rx1, ry1) -> Column:
    """Distance of a horizontal or vertical segment to a rectangle, 0 when they meet."""
    zero = F.lit(0.0)

    def gap(lo, hi, r0, r1):
        return F.greatest(zero, r0 - hi, lo - r1)

    h = orient == "h"
    lx0, lx1, ly0, ly1 = F.least(x1, x2), F.greatest(x1, x2), F.least(y1, y2), F.greatest(y1, y2)
    dx = F.when(h, gap(lx0, lx1, rx0, rx1)).otherwise(gap(x1, x1, rx0, rx1))
    dy = F.when(h, gap(y1, y1, ry0, ry1)).otherwise(gap(ly0, ly1, ry0, ry1))
    return F.sqrt(dx * dx + dy * dy)


def clamp(c: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.least(hi, F.greatest(lo, c))


def clamp01(c: Column) -> Column:
    """Any JSON scalar as a number in [0, 1]; not a number or not finite gives 0."""
    n = c.try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), 0.0).otherwise(clamp(n, 0.0, 1.0))


# source profiles
def resolve_kind(kind: Column, page_no: Column, name: Column, dpi: Column) -> Column:
    return (
        F.when(kind.isNotNull(), kind)
        .when(F.coalesce(page_no, F.lit(0)) > 0, "pdf")
        .when(F.lower(name).contains(".pdf") & (dpi > 0), "pdf")
        .otherwise("image")
    )


# preprocessing and detection parameters by source kind (fixed values; three rows)
PROFILE_COLUMNS = (
    "kind string, target_dpi double, binarizer string, stroke_dilate int, denoise_min_area int, median_radius int,"
    " dual_binary boolean, open_radius int, min_bar_fill double, min_bar_span double, projection_coverage double,"
    " frame_min_long double, min_border_fill double, min_thickness_scale double"
)
PROFILES = [
    ("image", 254.0, "sauvola", 0, 8, 1, False, 0, 0.28, 0.48, 0.72, 0.46, 0.55, 0.004),
    ("script", 254.0, "sauvola", 0, 8, 1, False, 0, 0.28, 0.48, 0.72, 0.46, 0.55, 0.004),
    ("pdf", 450.0, "otsu", 4, 22, 0, True, 1, 0.16, 0.36, 0.62, 0.34, 0.42, 0.0006),
]


def profile_join(df: DataFrame, kind: str = "kind") -> DataFrame:
    """Attach the parameter profile of each row's source kind (three-row broadcast).

    A pdf keeps its own dpi when it has one; other kinds go to the fixed target.
    """
    prof = df.sparkSession.createDataFrame(PROFILES, PROFILE_COLUMNS).withColumnRenamed("kind", "__kind")
    out = df.join(F.broadcast(prof), F.col(kind) == F.col("__kind"), "left").drop("__kind")
    if "dpi" in df.columns:
        own = (F.col(kind) == "pdf") & (F.col("dpi") > 0)
        out = out.withColumn("target_dpi", F.when(own, F.col("dpi")).otherwise(F.col("target_dpi")))
    return out


def erase_boxes(lines: DataFrame) -> DataFrame:
    """Boxes to blank out for lines: pad is the half width, plus 2 beyond 4 px."""
    half = F.ceil(F.col("width_px") / 2)
    pad = F.when(F.col("width_px") <= 4, F.greatest(F.lit(1), half)).otherwise(half + 2)
    h = F.col("orientation") == "h"
    lo_x, hi_x = F.least("x1", "x2"), F.greatest("x1", "x2")
    lo_y, hi_y = F.least("y1", "y2"), F.greatest("y1", "y2")
    return lines.withColumns(
        {
            "ex0": F.greatest(F.lit(0), F.floor(F.when(h, lo_x).otherwise(F.col("x1") - pad))),
            "ey0": F.greatest(F.lit(0), F.floor(F.when(h, F.col("y1") - pad).otherwise(lo_y))),
            "ex1": F.ceil(F.when(h, hi_x).otherwise(F.col("x1") + pad)),
            "ey1": F.ceil(F.when(h, F.col("y1") + pad).otherwise(hi_y)),
        }
    )


def erase_rect_boxes(rects: DataFrame, pad: float = 2.0) -> DataFrame:
    return rects.withColumns(
        {
            "ex0": F.greatest(F.lit(0), F.floor(F.col("x") - pad)),
            "ey0": F.greatest(F.lit(0), F.floor(F.col("y") - pad)),
            "ex1": F.ceil(F.col("x") + F.col("w") + pad),
            "ey1": F.ceil(F.col("y") + F.col("h") + pad),
        }
    )


def resize_boxes(df: DataFrame, w: Column, h: Column) -> DataFrame:
    """Give every box the size (w, h) around its centre."""
    return df.withColumns(
        {"x0": F.col("cx") - w / 2, "y0": F.col("cy") - h / 2, "x1": F.col("cx") + w / 2, "y1": F.col("cy") + h / 2}
    )


def shift_boxes(df: DataFrame, dx: Column, dy: Column) -> DataFrame:
    moved = {c: F.col(c) + dx for c in ("cx", "x0", "x1")} | {c: F.col(c) + dy for c in ("cy", "y0", "y1")}
    return df.withColumns({**moved, "edited": F.lit(True)})


def unify_boxes(df: DataFrame, keys) -> DataFrame:
    """Resize all boxes of a key to their mean size (one decimal)."""
    means = df.groupBy(*keys).agg(
        round_to(F.avg(F.col("x1") - F.col("x0")), 1).alias("__w"), round_to(F.avg(F.col("y1") - F.col("y0")), 1).alias("__h")
    )
    return resize_boxes(df.join(means, list(keys)), F.col("__w"), F.col("__h")).drop("__w", "__h")
