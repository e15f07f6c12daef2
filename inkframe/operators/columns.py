"""Columns, reading order and spacing of glyph boxes.

Clusters are functions of the value alone: equal values always fall together, so each fold runs
over the distinct values of a page (counted before the shuffle), cut first at gaps that no cluster
can cross. Where values are fractions, what is folded may reach the number of the island's glyphs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.constants import CONFIDENCE_THRESHOLD, TITLE_MIN_VOTES
from inkframe.operators.ordered import gap_groups, in_order
from inkframe.session import cut, spread


def _median(a: Column, first: Column, end: Column) -> Column:
    """Median of the rows under entries first to end - 1 of ``a``, an array of (v, upto); upto counts rows from the left.

    The entry that holds the middle row is found by halving.
    """
    before = F.coalesce(F.get(a, first - 1)["upto"], F.lit(0))
    total = F.get(a, end - 1)["upto"] - before
    middle, above = before + F.floor((total + 1) / 2), before + F.floor((total + 2) / 2)

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        left = F.get(a, mid)["upto"] >= middle
        return F.when(left, F.struct(at["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct((mid + 1).alias("lo"), at["hi"].alias("hi")))

    def value(at: Column) -> Column:
        here = F.get(a, at["lo"])
        return (here["v"] + F.when(here["upto"] >= above, here["v"]).otherwise(F.get(a, at["lo"] + 1)["v"])) / 2

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(end - first)).cast("int")))
    return F.aggregate(steps, F.struct(first.alias("lo"), (end - 1).alias("hi")), halve, value)


def _fold(df: DataFrame, keys: Sequence[str], value: str, opens, tol: Column | None, span: Column | None, chunk_len: float | None) -> DataFrame:
    """Clusters as (keys, __v, center, lo), one row per distinct value.

    Along ascending values a value either joins the last cluster or opens one: medians only grow while
    a cluster takes values, so one that a value has passed is passed by all later ones. ``opens(x,
    median, lowest, clusters so far)`` decides. With ``chunk_len`` values are first cut at gaps > tol.
    """
    keys = list(keys)
    params = {"tol": tol, "span": span}
    extra = {k: F.min(c).cast("double").alias(k) for k, c in params.items() if c is not None}
    vals = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"), *extra.values())
    group = keys
    if chunk_len is not None:
        vals = gap_groups(vals, keys, "v", F.col("tol"), [], F.floor(F.col("v") / chunk_len), "__island")
        group = [*keys, "__island"]
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy("v"))
    entries = F.array_sort(F.collect_list(F.struct("v", "upto"))).alias("__a")
    # few bytes, much work: not to be squeezed into a few tasks
    arrays = spread(vals, *group).withColumn("upto", upto).groupBy(*group).agg(entries, *[F.min(k).alias(k) for k in extra])
    a = F.col("__a")

    def step(state: Column, i: Column) -> Column:
        new = opens(F.get(a, i)["v"], _median(a, state["last"], i), F.get(a, state["last"])["v"], F.size(state["starts"]))
        opened = F.struct(F.concat(state["starts"], F.array(i)).alias("starts"), i.alias("last"))
        return F.when((i == 0) | new, opened).otherwise(state)

    none = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(-1).alias("last"))
    starts = F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), none, step, lambda state: state["starts"])

    def cluster(first: Column, k: Column) -> Column:
        end = F.coalesce(F.get("__starts", k + 1), F.size(a))
        members = F.transform(F.slice(a, first + 1, end - first), lambda x: x["v"])
        return F.struct(F.get(a, first)["v"].alias("lo"), _median(a, first, end).alias("center"), members.alias("members"))

    found = arrays.withColumn("__starts", starts).select(*keys, F.explode(F.transform("__starts", cluster)).alias("__c"))
    return found.select(*keys, F.explode("__c.members").alias("__v"), F.col("__c.center").alias("center"), F.col("__c.lo").alias("lo"))


def _attach(df: DataFrame, clusters: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Add ``name`` (lowest value of the cluster, unique per key) and ``name``_center to each row."""
    c = clusters.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col(value).cast("double") == F.col("__v")]
    j = df.join(c, on, "left")
    return j.withColumnsRenamed({"lo": name, "center": f"{name}_center"}).drop("__v", *[f"__{k}" for k in keys])


def _fold_rows(df: DataFrame, keys: Sequence[str], value: str, opens, tol: Column | None, span: Column | None, name: str) -> DataFrame:
    """As _attach(_fold()) for keys whose rows fit a task: rows are dealt once, by key, and go through the fold
    themselves, so nothing is joined back. Medians are read off their places."""
    keys, rest = list(keys), [c for c in df.columns if c not in keys]
    params = {k: c for k, c in {"tol": tol, "span": span}.items() if c is not None}
    g = df.withColumns({"__v": F.col(value).cast("double"), **{f"__{k}": c.cast("double") for k, c in params.items()}})
    order = Window.partitionBy(*keys).orderBy("__v")
    before = F.lag("__v").over(order)
    apart = F.col("__v").isNotNull() & before.isNull() if tol is None else (F.col("__v") - before > F.col("__tol")) | (F.col("__v").isNotNull() & before.isNull())
    g = g.withColumn("__apart", F.coalesce(apart, F.lit(False)).cast("int"))
    g = g.withColumn("__island", F.sum("__apart").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = F.sort_array(F.collect_list(F.struct("__v", *rest))).alias("__a")
    arrays = g.groupBy(*keys, "__island").agg(rows, *[F.min(f"__{k}").alias(k) for k in params])
    arrays = arrays.withColumn("__vs", F.transform("__a", lambda x: x["__v"]))
    at = lambda i: F.get("__vs", i.cast("int"))

    def median(first: Column, end: Column) -> Column:
        return (at(first + F.floor((end - first - 1) / 2)) + at(first + F.floor((end - first) / 2))) / 2

    def step(state: Column, i: Column) -> Column:
        new = opens(at(i), median(state["last"], i), at(state["last"]), F.size(state["starts"]))
        opened = F.struct(F.concat(state["starts"], F.array(i)).alias("starts"), i.alias("last"))
        return F.when((i == 0) | new, opened).otherwise(state)

    none = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(-1).alias("last"))
    starts = F.aggregate(F.sequence(F.lit(0), F.size("__vs") - 1), none, step, lambda state: state["starts"])

    def cluster(first: Column, k: Column) -> Column:
        end = F.coalesce(F.get("__starts", k + 1), F.size("__vs"))
        return F.struct(at(first).alias("lo"), median(first, end).alias("center"), F.slice("__a", first + 1, end - first).alias("rows"))

    found = arrays.withColumn("__starts", starts).select(*keys, F.explode(F.transform("__starts", cluster)).alias("__c"))
    found = found.select(*keys, F.col("__c.lo").alias("__lo"), F.col("__c.center").alias("__center"), F.inline("__c.rows"))
    return found.select(*df.columns, F.col("__center").alias(f"{name}_center"), F.col("__lo").alias(name))


def cluster_1d(df: DataFrame, keys: Sequence[str], value: str, tol: Column, span: Column | None = None, name: str = "col", group_len: float = 4096.0, by_key: bool = False) -> DataFrame:
    """Sorted clustering against the running median: next value joins while < tol above it and, if given, within ``span`` of the lowest.

    With ``by_key`` (for keys whose rows fit a task) rows are dealt by key once, and stay so.
    """

    def opens(x: Column, median: Column, lowest: Column, _: Column) -> Column:
        # the median is not below the lowest value, so most values are settled without it
        far = (x - lowest >= F.col("tol")) & (x - median >= F.col("tol"))
        return far if span is None else (x - lowest > F.col("span")) | far

    if by_key:
        return _fold_rows(df, keys, value, opens, tol, span, name)
    return _attach(df, _fold(df, keys, value, opens, tol, span, group_len), keys, value, name)


def cluster_first_fit(df: DataFrame, keys: Sequence[str], value: str, tol: Column, name: str = "col", group_len: float = 4096.0, by_key: bool = False) -> DataFrame:
    """Values in ascending order join the first cluster whose median is within tol. ``by_key`` as in cluster_1d."""

    def opens(x: Column, median: Column, lowest: Column, _: Column) -> Column:
        return (x - lowest > F.col("tol")) & (x - median > F.col("tol"))

    if by_key:
        return _fold_rows(df, keys, value, opens, tol, None, name)
    return _attach(df, _fold(df, keys, value, opens, tol, None, group_len), keys, value, name)


def cluster_ratio(df: DataFrame, keys: Sequence[str], value: str, ratio: float = 0.15, max_groups: int | None = 4, name: str = "size") -> DataFrame:
    """Sorted clustering by ratio: a value above median x (1 + ratio) opens a group while there are fewer than max_groups."""

    def opens(x: Column, median: Column, _: Column, groups: Column) -> Column:
        above = x > median * (1 + ratio)
        return above if max_groups is None else (groups < max_groups) & above

    return _attach(df, _fold(df, keys, value, opens, None, None, None), keys, value, name)


def with_side(glyphs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Glyphs with mid_side, the typical box side of their page, in the page's own partition."""
    side = ((F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0"))) / 2
    return glyphs.withColumn("mid_side", F.median(side).over(Window.partitionBy(*keys)))


def column_clusters(glyphs: DataFrame, keys: Sequence[str], sides: DataFrame | None = None) -> DataFrame:
    """Glyphs with ``col``, ``col_center`` and mid_side: x clusters within .4 sides, at most .48 wide.

    Without ``sides`` glyphs bring mid_side, or the page's own boxes give it.
    """
    if sides is not None:
        g = glyphs.join(sides, list(keys))
    else:
        g = glyphs if "mid_side" in glyphs.columns else with_side(glyphs, keys)
    return cluster_1d(g, keys, "cx", F.col("mid_side") * 0.4, F.col("mid_side") * 0.48, by_key=True)


def column_kind(glyphs: DataFrame, keys: Sequence[str], col: str = "col") -> DataFrame:
    """Per column: col_n and col_kind. Three or more evenly spaced (gap std < 8, mean > .5 sides) are vertical
    names; two side by side are a rank label; the rest is mixed."""
    keys = [*keys, col]
    c = _with_kind(glyphs, keys).groupBy(*keys).agg(*[F.min(x).alias(x) for x in ("col_n", "spread", "col_kind")])
    return c.select(*keys, "col_n", "spread", "col_kind")


def _std_below(df: DataFrame, value: str, limit: float, keys: Sequence[str], name: str) -> DataFrame:
    """Add whether the standard deviation of a column is below the limit; ``df`` has (cy, glyph_id) as its order.

    Sums decide, which are exact for whole and half pixels. A deviation that equals the limit falls to either
    side by rounding, so there the running update from the top down decides, as it does in SQL engines.
    """
    v, whole = F.col(value), Window.partitionBy(*keys)
    n, total, squares = F.count(v).over(whole), F.sum(v).over(whole), F.sum(v * v).over(whole)
    df = df.withColumns({"__over": n * squares - total * total - limit * limit * n * n, "__v": n})
    tie = F.abs(F.col("__over")) <= 1e-9 * limit * limit * F.col("__v") * F.col("__v")
    at_limit = F.sort_array(F.collect_list(F.when(tie & v.isNotNull(), F.struct("cy", "glyph_id", v.alias("v")))).over(whole))

    def update(s: Column, x: Column) -> Column:
        n, mean = s["n"] + 1, s["mean"] + (x["v"] - s["mean"]) / (s["n"] + 1)
        return F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + (x["v"] - mean) * (x["v"] - s["mean"])).alias("m2"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    df = df.withColumn("__tied", F.when(F.col("__v") > 0, at_limit))
    run = F.aggregate("__tied", start, update, lambda s: F.sqrt(s["m2"] / s["n"]) < limit)
    return df.withColumn(name, F.when(F.size("__tied") > 0, run).otherwise(F.col("__over") < 0) | (F.col("__v") == 0)).drop("__over", "__v", "__tied")


def _with_kind(glyphs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Glyphs with __up, __down (gaps to their neighbours), col_n, spread and col_kind, all in the column's partition."""
    w, whole = Window.partitionBy(*keys).orderBy("cy", "glyph_id"), Window.partitionBy(*keys)
    g = glyphs.withColumns({"__up": F.col("cy") - F.lag("cy").over(w), "__down": F.lead("cy").over(w) - F.col("cy")})
    n, spread_ = F.count(F.lit(1)).over(whole), F.max("cx").over(whole) - F.min("cx").over(whole)
    g = g.withColumns({
        "col_n": n, "spread": spread_, "__mean": F.avg("__up").over(whole),
        "__height": F.max("cy").over(whole) - F.min("cy").over(whole), "__side": F.min("mid_side").over(whole),
    })
    g = _std_below(g, "__up", 8.0, keys, "__even")
    kind = (
        F.when((F.col("col_n") >= 3) & F.col("__even") & (F.col("__mean") > F.col("__side") * 0.5), "vertical_name")
        .when((F.col("col_n") == 2) & (F.col("__height") < F.col("__side") * 0.35) & (F.abs(F.col("spread") - F.col("__side")) < 15), "rank_label")
        .otherwise("mixed")
    )
    return g.withColumn("col_kind", kind).drop("__mean", "__even", "__height", "__side")


def reading_order(glyphs: DataFrame, keys: Sequence[str], col: str = "col", center: str = "col_center") -> DataFrame:
    """Place of each glyph on its page: columns right to left, top to bottom inside. One sort of a page's glyphs."""
    middle = F.max(center).over(Window.partitionBy(*keys, col))
    order = Window.partitionBy(*keys).orderBy(F.desc("__c"), F.desc(col), "cy", "glyph_id")
    return glyphs.withColumn("__c", middle).withColumn("position", F.row_number().over(order).cast("long")).drop("__c")


def spacing_anomalies(glyphs: DataFrame, keys: Sequence[str], col: str = "col") -> DataFrame:
    """Glyph ids with suspicious spacing in columns of three or more: uneven (std around the median
    gap > 3: all of them) or next to a gap above 1.85 medians. Wide columns that are no names are skipped.

    Kind, median and deviation are windows over the column, so a column moves once.
    """
    keys = [*keys, col]
    return _with_odd(_with_kind(glyphs, keys).where(_judged()), keys).where("__odd").select("glyph_id")


def _judged() -> Column:
    return (F.col("col_n") >= 3) & ((F.col("col_kind") == "vertical_name") | (F.col("spread") <= F.col("mid_side") * 0.65))


def _with_odd(g: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Glyphs of _with_kind() with __odd: their spacing is suspicious if their column is judged."""
    whole = Window.partitionBy(*keys)
    g = g.withColumn("__med", F.median("__up").over(whole))
    g = g.withColumn("__dev", F.sqrt(F.avg(F.pow(F.col("__up") - F.col("__med"), F.lit(2))).over(whole)))
    limit = F.col("__med") * 1.85
    odd = (F.col("__dev") > 3) | F.coalesce(F.col("__up") > limit, F.lit(False)) | F.coalesce(F.col("__down") > limit, F.lit(False))
    return g.withColumn("__odd", odd).drop("__med", "__dev")


def snap_columns(glyphs: DataFrame, keys: Sequence[str], kinds: DataFrame | None = None, col: str = "col", center: str = "col_center") -> DataFrame:
    """Align columns: rank labels to their median height; other glyphs to the column centre (shift <= .5
    sides) and, where the pitch is stable, to an even pitch (shift <= .28 sides). Side glyphs stay.

    ``kinds`` as column_kind() returns them; without it they are found here. Pitch and target are windows
    over the column, so that a glyph moves once.
    """
    keys = [*keys, col]
    s = F.col("mid_side")
    if kinds is None:
        g = _with_kind(glyphs, keys).drop("__up", "__down", "spread")
    else:
        g = glyphs.join(kinds.select(*keys, "col_n", "col_kind"), keys, "left")
    many = F.col("col_n") >= 2
    rank = many & (F.col("col_kind") == "rank_label")
    g = g.withColumn("__mov", F.coalesce(many & ~rank & (F.col("kind") != "side"), F.lit(False)))
    dx = F.when(F.col("__mov") & (F.abs(F.col(center) - F.col("cx")) <= s * 0.5), F.col(center) - F.col("cx")).otherwise(0.0)
    g = g.withColumn("__dx", dx).withColumn("__nx", F.col("cx") + F.col("__dx"))
    g = g.withColumn("__mid", F.median("cy").over(Window.partitionBy(*keys)))
    # movable glyphs of a column are apart from its others
    whole = Window.partitionBy(*keys, "__mov")
    w = whole.orderBy("cy", "glyph_id")
    g = g.withColumns({"__gap": F.col("cy") - F.lag("cy").over(w), "__i": F.row_number().over(w) - 1})
    g = g.withColumns({
        "__m": F.count(F.lit(1)).over(whole), "__spread": F.max("__nx").over(whole) - F.min("__nx").over(whole), "__pitch": F.median("__gap").over(whole),
        "__top": F.min("cy").over(whole), "__s": F.min("mid_side").over(whole),
    })
    g = g.withColumn("__dev", F.sqrt(F.avg(F.pow(F.col("__gap") - F.col("__pitch"), F.lit(2))).over(whole)))
    t = F.col("__s")
    even = F.col("__mov") & (F.col("__m") >= 3) & (F.col("__spread") <= t * 0.22) & (F.col("__pitch") >= t * 0.45) & (F.col("__dev") <= t * 0.22)
    g = g.withColumn("__ty", F.when(even, F.col("__top") + F.col("__i") * F.col("__pitch")))
    dy = (
        F.when(rank, F.col("__mid") - F.col("cy"))
        .when(F.col("__ty").isNotNull() & (F.abs(F.col("__ty") - F.col("cy")) <= s * 0.28), F.col("__ty") - F.col("cy"))
        .otherwise(0.0)
    )
    g = g.withColumn("__dy", dy)
    moved = {c: F.col(c) + F.col("__dx") for c in ("cx", "x0", "x1")} | {c: F.col(c) + F.col("__dy") for c in ("cy", "y0", "y1")}
    return g.withColumns(moved).select(*glyphs.columns)


def detect_pairs(glyphs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two-glyph labels standing in rows: (keys, row, first_id, second_id, gap).

    Needs two pairs in a row and some neighbouring pairs clearly further apart than inside a pair.
    ``glyphs`` carries mid_side, or the page's own boxes give it.
    """
    return _pairs(glyphs, keys).select(*keys, "row", "first_id", "second_id", "gap")


def _pairs(glyphs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """detect_pairs() with the middle height of each pair."""
    keys = list(keys)
    s = F.col("mid_side")
    plain = (F.col("kind") != "side") & ~F.col("grp").isin("title", "pageno")
    sizes = [(F.col("x1") - F.col("x0")).alias("__w"), (F.col("y1") - F.col("y0")).alias("__h")]
    g = glyphs.select(*keys, "glyph_id", "cx", "cy", *sizes, plain.alias("__plain"), *[c for c in glyphs.columns if c == "mid_side"])
    if "mid_side" not in glyphs.columns:
        g = g.withColumn("mid_side", F.median((F.col("__w") + F.col("__h")) / 2).over(Window.partitionBy(*keys)))
    ok = F.col("__plain")
    for d in ("__w", "__h"):
        ok = ok & (F.col(d) >= s * 0.35) & (F.col(d) <= s * 1.9)
    narrow = g.where(ok).select(*keys, "glyph_id", "cx", "cy", "mid_side")
    rows = cluster_first_fit(narrow, keys, "cy", s * 0.42, "row", by_key=True)
    by_row = [*keys, "row"]
    left = Window.partitionBy(*by_row).orderBy("cx", "glyph_id")
    gap = F.lead("cx").over(left) - F.col("cx")
    valid = gap.between(s * 0.55, s * 1.65)
    rows = rows.withColumns({"__gap": gap, "__ok": F.coalesce(valid, F.lit(False)), "__n": F.count(F.lit(1)).over(Window.partitionBy(*by_row)), "__next": F.lead("glyph_id").over(left), "__next_x": F.lead("cx").over(left), "__mid": (F.col("cy") + F.lead("cy").over(left)) / 2})
    # runs of valid gaps: every second glyph of a run opens a pair
    breaks = F.sum(F.when(F.lag("__ok").over(left), 0).otherwise(1)).over(left)
    rows = rows.where("__n >= 4").withColumn("__run", breaks)
    place = F.row_number().over(Window.partitionBy(*by_row, "__run").orderBy("cx", "glyph_id"))
    pairs = rows.withColumn("__p", place).where("__ok and __p % 2 = 1")
    order = Window.partitionBy(*by_row).orderBy("cx", "glyph_id")
    pairs = pairs.withColumn("__sep", F.lead("cx").over(order) - F.col("__next_x"))
    # judged in the row's own partition: nothing is joined back
    row = Window.partitionBy(*by_row)
    pairs = pairs.withColumns({"__pairs": F.count(F.lit(1)).over(row), "__inner": F.median("__gap").over(row), "__far": F.max("__sep").over(row)})
    good = (F.col("__pairs") >= 2) & (F.col("__far") >= F.col("__inner") * 1.35)
    return pairs.where(good).na.drop(subset=by_row).select(*by_row, F.col("glyph_id").alias("first_id"), F.col("__next").alias("second_id"), F.col("__gap").alias("gap"), "__mid")


def title_column(glyphs: DataFrame, pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Glyph ids of the rightmost stable column of clearly larger glyphs at the right page edge.

    ``pages``: keys, width. Needs six body glyphs on the page and three in the column.
    """
    keys = list(keys)
    size = {"__h": F.col("y1") - F.col("y0"), "__w": F.col("x1") - F.col("x0")}
    body = glyphs.where("kind <> 'side' and grp <> 'pageno'").select(*keys, "glyph_id", "cx", "cy", *[c.alias(n) for n, c in size.items()])
    h, w = F.col("__h"), F.col("__w")
    stats = body.groupBy(*keys).agg(F.median(h).alias("__bh"), F.count(F.lit(1)).alias("__n")).where("__n >= 6")
    c = body.join(stats.join(pages.select(*keys, "width"), keys), keys)
    # written, as the steps below read them four times: only large glyphs at the edge, not the pages
    c = cut(c.where((F.col("cx") >= F.col("width") * 0.72) & (h >= F.col("__bh") * 1.2) & (w >= F.col("__bh") * 0.55)))
    c = cluster_first_fit(c.withColumn("__right", -F.col("cx")), keys, "__right", F.col("__bh") * 0.45, "tc")
    by = [*keys, "tc"]
    c = c.withColumn("__gap", F.col("cy") - F.lag("cy").over(Window.partitionBy(*by).orderBy("cy", "glyph_id")))
    cols = c.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.median(h).alias("mh"), (F.max("cx") - F.min("cx")).alias("spread"), F.min("__gap").alias("g0"),
        F.max("__gap").alias("g1"), F.max("tc_center").alias("right"), F.sum(F.lit(1)).alias("total"),
    )
    ok = (F.col("n") >= 3) & (F.col("spread") <= F.col("mh") * 0.45) & (F.col("g0") >= F.col("mh") * 0.6) & (F.col("g1") <= F.col("mh") * 2.4)
    best = cols.where(ok).groupBy(*keys).agg(F.min_by("tc", F.struct("right", "tc")).alias("tc"))
    return c.join(best, by, "left_semi").select(*keys, "glyph_id")


def apply_columns(glyphs: DataFrame, pages: DataFrame, keys: Sequence[str], sides: DataFrame, max_side: float) -> DataFrame:
    """Structural pass: drop repeats, find columns, flag spacing, regroup labels and the edge title, number in reading order."""
    from inkframe.operators.layout import dedupe_boxes

    keys = list(keys)
    kept = dedupe_boxes(glyphs, keys, "glyph_id", sides, max_side)
    g = cut(column_clusters(kept, keys, sides))
    mid = _pairs(g, keys).select(F.explode(F.array("first_id", "second_id")).alias("glyph_id"), "__mid")
    # kinds and spacing are told in the column's own partition; only pairs are joined back
    by = [*keys, "col"]
    g = _with_odd(_with_kind(g.na.drop(subset=by), by), by).withColumn("__flag", _judged() & F.col("__odd"))
    g = g.drop("__up", "__down", "col_n", "spread", "__odd").join(mid, "glyph_id", "left")
    side = F.col("kind") == "side"
    flagged = ~side & F.coalesce("__flag", F.lit(False))
    in_pair = F.col("__mid").isNotNull()
    dy = F.when(in_pair, F.col("__mid") - F.col("cy")).otherwise(0.0)
    grp = (
        F.when(in_pair, "rank").when(~side & (F.col("col_kind") == "rank_label"), "rank")
        .when(~side & (F.col("col_kind") == "vertical_name") & (F.col("grp") != "pageno"), "body").otherwise(F.col("grp"))
    )
    g = g.withColumns(
        {
            "note": F.when(flagged, "spacing").otherwise(F.col("note")),
            "conf": F.when(flagged & (F.col("conf") >= CONFIDENCE_THRESHOLD), CONFIDENCE_THRESHOLD - 0.02).otherwise(F.col("conf")),
            "grp": grp, "kind": F.when(in_pair, "text").otherwise(F.col("kind")), "cy": F.col("cy") + dy, "y0": F.col("y0") + dy, "y1": F.col("y1") + dy,
        }
    ).drop("__flag", "__mid", "col_kind")
    title = title_column(g, pages, keys).select("glyph_id").withColumn("__t", F.lit(True))
    g = g.join(title, "glyph_id", "left")
    g = g.withColumns({"grp": F.when(F.col("__t"), "title").otherwise(F.col("grp")), "kind": F.when(F.col("__t"), "text").otherwise(F.col("kind"))}).drop("__t")
    return reading_order(g, keys)


def row_neighbours(glyphs: DataFrame, keys: Sequence[str], seek: Column | None = None, other: Sequence[str] = ()) -> DataFrame:
    """(glyph_id, other_id, dx) for glyphs side by side in a row: |dy| <= .45 h, .35 w < |dx| <= 1.6 w (page medians).

    With ``seek`` only those glyphs look for neighbours; ``other`` are columns of the neighbour to report, renamed to
    __o_ and their name. A page moves once: its glyphs stand in bands of four heights, those near a border in both,
    and each looks along its band as far as a neighbour can be.
    """
    keys = list(keys)
    page = Window.partitionBy(*keys)
    typical = lambda size: F.median(size).over(page)
    g = glyphs.select(*keys, "glyph_id", "cx", "cy", (F.lit(True) if seek is None else seek).alias("__seek"), (F.col("x1") - F.col("x0")).alias("__dx"), (F.col("y1") - F.col("y0")).alias("__dy"), *other)
    g = g.withColumns({"__w": typical("__dx"), "__h": typical("__dy")}).drop("__dx", "__dy")
    g = g.withColumns({c: F.when(F.col(c) == 0, 20.0).otherwise(F.col(c)) for c in ("__w", "__h")})
    band = lambda y: F.floor(y / (F.col("__h") * 4))
    g = g.where("cx is not null and cy is not null").withColumns({
        "__home": band(F.col("cy")), "__at": F.col("cx") / F.col("__w") * 100,
        "__band": F.explode(F.sequence(band(F.col("cy") - F.col("__h") * 0.46), band(F.col("cy") + F.col("__h") * 0.46))),
    })
    # a little wider than the exact test, which follows
    beside = Window.partitionBy(*keys, "__band").orderBy("__at").rangeBetween(-161, 161)
    found = F.collect_list(F.struct(F.col("glyph_id").alias("other_id"), F.col("cx").alias("bx"), F.col("cy").alias("by"), *[F.col(c).alias(f"__o_{c}") for c in other])).over(beside)
    g = g.withColumn("__found", found).where("__seek and __band = __home")
    dx = F.abs(F.col("bx") - F.col("cx"))
    near = (F.col("glyph_id") != F.col("other_id")) & (F.abs(F.col("by") - F.col("cy")) <= F.col("__h") * 0.45) & (dx > F.col("__w") * 0.35) & (dx <= F.col("__w") * 1.6)
    pairs = g.select(*keys, "glyph_id", "cx", "cy", "__w", "__h", F.inline("__found")).where(near)
    return pairs.select(*keys, "glyph_id", "other_id", (F.col("bx") - F.col("cx")).alias("dx"), *[f"__o_{c}" for c in other])


def page_order(glyphs: DataFrame, keys: Sequence[str], height: float) -> DataFrame:
    """Line order: bands of half a glyph height, then right to left. The band is the key, so the order is total."""
    band = F.floor(F.col("cy") / (height / 2))
    g = glyphs.withColumns({"band": band, "__left": -F.col("cx")})
    return in_order(g, keys, ["band", "__left", "glyph_id"], F.floor(F.col("band") / 64), number="position").drop("__left")


def infer_title(glyphs: DataFrame, pages: DataFrame, project: str = "project_id", scan: int | None = None, min_votes: int = TITLE_MIN_VOTES, min_conf: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """Title of each project by a vote of its pages, or of its first ``scan`` ones: (project, title, votes).

    A page votes once per text of a left-half title column of 2 to 8 glyphs that are all certain.
    The title needs ``min_votes`` and strictly more votes than the runner-up.
    ``pages``: project, page_id, idx, width.
    """
    w = Window.partitionBy(project).orderBy("idx", "page_id")
    first = pages if scan is None else pages.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= scan)
    first = first.select(project, "page_id", "width")
    g = glyphs.where("kind = 'side' and grp = 'title'").join(first, "page_id").where(F.col("cx") <= F.col("width") * 0.5)
    wide = g.groupBy("page_id").agg(F.median(F.col("x1") - F.col("x0")).alias("__w"))
    g = g.join(wide, "page_id").withColumn("__tol", F.when(F.col("__w") == 0, 20.0).otherwise(F.col("__w")) * 0.75)
    g = cluster_first_fit(g, ["page_id"], "cx", F.col("__tol"), "tc")
    solid = (F.coalesce(F.length("text"), F.lit(0)) > 0) & (F.col("edited") | (F.col("conf") >= min_conf))
    # long columns are ruled out by their count before their texts are gathered
    sized = g.groupBy("page_id", "tc").agg(F.count(F.lit(1)).alias("n"), F.min(solid.cast("int")).alias("all_solid"))
    sized = sized.where("n between 2 and 8 and all_solid = 1").select("page_id", "tc")
    cols = g.join(sized, ["page_id", "tc"]).groupBy(project, "page_id", "tc").agg(F.array_sort(F.collect_list(F.struct("cy", "glyph_id", "text"))).alias("l"))
    texts = cols.select(project, "page_id", F.array_join(F.transform("l", lambda x: x["text"]), "").alias("title")).distinct()
    votes = texts.groupBy(project, "title").agg(F.count(F.lit(1)).alias("votes"))
    rank = votes.groupBy(project).agg(F.max(F.struct("votes", "title")).alias("b"))
    tied = votes.join(rank, project).where(F.col("votes") == F.col("b.votes")).groupBy(project).agg(F.count(F.lit(1)).alias("tops"), F.first("b").alias("b"))
    return tied.where((F.col("tops") == 1) & (F.col("b.votes") >= min_votes)).select(project, F.col("b.title").alias("title"), F.col("b.votes").alias("votes"))
