"""Box joins through grid cells: an equi-join on (keys, cell) with the exact test applied after it.

Each side is exploded to the cells its box touches. A pair that shares several cells is reported
only in the cell of its joint lower corner, so no distinct is needed. Hot cells are left to AQE's
skew join, which splits them by map output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")


def _cells(df: DataFrame, box: Sequence[str], cell: float, prefix: str) -> DataFrame:
    x0, y0, x1, y1 = (F.floor(F.col(c) / F.lit(float(cell))) for c in box)
    return df.withColumn(f"{prefix}cx", F.explode(F.sequence(x0, F.greatest(x0, x1)))).withColumn(
        f"{prefix}cy", F.explode(F.sequence(y0, F.greatest(y0, y1)))
    )


def box_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    cell: float,
    condition: Column | None = None,
    left_box: Sequence[str] = ("lx0", "ly0", "lx1", "ly1"),
    right_box: Sequence[str] = ("rx0", "ry0", "rx1", "ry1"),
) -> DataFrame:
    """Pairs of closed boxes that touch or overlap, then ``condition``.

    Column names of the two sides must differ except for ``keys``; widen a box beforehand to get a
    distance join.
    """
    a = _cells(left, left_box, cell, "__l")
    b = _cells(right, right_box, cell, "__r").withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = [F.col(k) == F.col(f"__k_{k}") for k in keys]
    on += [F.col("__lcx") == F.col("__rcx"), F.col("__lcy") == F.col("__rcy")]
    lx0, ly0, lx1, ly1 = (F.col(c) for c in left_box)
    rx0, ry0, rx1, ry1 = (F.col(c) for c in right_box)
    c = F.lit(float(cell))
    touch = (lx0 <= rx1) & (rx0 <= lx1) & (ly0 <= ry1) & (ry0 <= ly1)
    home = (F.floor(F.greatest(lx0, rx0) / c) == F.col("__lcx")) & (F.floor(F.greatest(ly0, ry0) / c) == F.col("__lcy"))
    pairs = a.join(b, on).where(touch & home)
    if condition is not None:
        pairs = pairs.where(condition)
    return pairs.drop("__lcx", "__lcy", "__rcx", "__rcy", *[f"__k_{k}" for k in keys])
