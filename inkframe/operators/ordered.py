"""Order-dependent building blocks that do not put a whole key into one task.

A plain window over ``keys`` sorts all rows of a key in one task, which fails when one key holds a
large share of the data. Here the caller names a ``chunk`` expression that grows with the order
(a row band, a day, a block of ids). Windows run per (keys, chunk); a summary with one row per
chunk carries counts, sums and border rows across chunks, and is joined back on (keys, chunk), the
partitioning the rows already have.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CH = "__chunk"


def in_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    number: str | None = None,
    sums: Mapping[str, Column] | None = None,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add row numbers, running sums (inclusive), previous-row and next-row values per key.

    ``order`` must be a strict order within a key and ``chunk`` must not decrease along it.
    """
    sums, previous, following = dict(sums or {}), dict(previous or {}), dict(following or {})
    keys, order = list(keys), list(order)
    rows = df.withColumn(_CH, chunk)
    group = [*keys, _CH]
    local = Window.partitionBy(*group).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    summary_aggs = [F.count(F.lit(1)).alias("__n")]
    summary_aggs += [F.sum(c).alias(f"__s_{name}") for name, c in sums.items()]
    position = F.struct(*order)
    if previous:
        summary_aggs.append(F.max_by(F.struct(*[F.col(c).alias(o) for o, c in previous.items()]), position).alias("__last"))
    if following:
        summary_aggs.append(F.min_by(F.struct(*[F.col(c).alias(o) for o, c in following.items()]), position).alias("__first"))
    across = Window.partitionBy(*keys).orderBy(_CH) if keys else Window.partitionBy(F.lit(0)).orderBy(_CH)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")]
    carried += [F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in sums]
    if previous:
        carried.append(F.lag("__last").over(across).alias("__prev_last"))
    if following:
        carried.append(F.lead("__first").over(across).alias("__next_first"))
    summary = rows.groupBy(*group).agg(*summary_aggs).select(*group, *carried)
    summary = summary.withColumnsRenamed({c: f"__g_{c}" for c in group})

    cols = {"__rn": F.row_number().over(local)}
    cols |= {f"__run_{n}": F.sum(c).over(upto) for n, c in sums.items()}
    cols |= {f"__prev_{o}": F.lag(c).over(local) for o, c in previous.items()}
    cols |= {f"__next_{o}": F.lead(c).over(local) for o, c in following.items()}
    cols["__size"] = F.count(F.lit(1)).over(Window.partitionBy(*group))
    rows = rows.withColumns(cols)

    on = [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in group]
    joined = rows.join(summary, on, "left").select(
        *df.columns,
        *([(F.col("__before") + F.col("__rn")).cast("long").alias(number)] if number else []),
        *[(F.col(f"__before_{n}") + F.col(f"__run_{n}")).alias(n) for n in sums],
        *[
            F.when(F.col("__rn") > 1, F.col(f"__prev_{o}")).otherwise(F.col(f"__prev_last.{o}")).alias(o)
            for o, c in previous.items()
        ],
        *[
            F.when(F.col("__rn") < F.col("__size"), F.col(f"__next_{o}")).otherwise(F.col(f"__next_first.{o}")).alias(o)
            for o, c in following.items()
        ],
    )
    return joined


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    starts_new: Column,
    previous: Mapping[str, str],
    name: str = "island",
) -> DataFrame:
    """Number runs of rows: a row opens a new run where ``starts_new`` (over the previous-row columns) holds.

    The first row of a key always opens run 1.
    """
    keys, group = list(keys), [*keys, _CH]
    local = Window.partitionBy(*group).orderBy(*order)
    rows = df.withColumn(_CH, chunk).withColumns({o: F.lag(c).over(local) for o, c in previous.items()} | {"__rn": F.row_number().over(local)})
    opens = F.coalesce(starts_new, F.lit(False)).cast("int")
    # the first row of a chunk is judged in the summary, where the last row before it is known
    rows = rows.withColumn("__opens", F.when(F.col("__rn") == 1, 0).otherwise(opens))
    rows = rows.withColumn("__run", F.sum("__opens").over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    position = F.struct(*order)
    summary = rows.groupBy(*group).agg(
        F.sum("__opens").alias("__local"),
        F.min_by(F.struct(*[c for c in df.columns if c not in keys]), position).alias("__f"),
        F.max_by(F.struct(*[F.col(c).alias(o) for o, c in previous.items()]), position).alias("__l"),
    )
    across = Window.partitionBy(*keys).orderBy(_CH)
    summary = summary.withColumn("__p", F.lag("__l").over(across)).select(*group, "__local", F.col("__p").isNull().alias("__lead"), "__f.*", "__p.*")
    summary = summary.withColumn("__first", F.when(F.col("__lead"), 1).otherwise(opens))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("__first") + F.col("__local")).over(before), F.lit(0)) + F.col("__first")
    summary = summary.select(*[F.col(c).alias(f"__g_{c}") for c in group], offset.alias("__off"))
    on = [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in group]
    return rows.join(summary, on, "left").select(*df.columns, (F.col("__off") + F.col("__run")).cast("long").alias(name))


def gap_groups(
    df: DataFrame, keys: Sequence[str], value: str, limit: Column, tie: Sequence[str], chunk: Column, name: str = "band"
) -> DataFrame:
    """Group sorted values: the next value stays in the band while next - previous <= limit."""
    return islands(
        df, keys, [value, *tie], chunk, F.col(value) - F.col("__pv") > limit, {"__pv": value}, name
    )
