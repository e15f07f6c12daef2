"""Edit logs: replay to entity state, undo and redo resolution."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.constants import UNDO_LIMIT
from inkframe.session import spread


def replay(edits: DataFrame, base: DataFrame, keys: Sequence[str] = ("page_id", "target"), fields: Sequence[str] = ("text", "pt"), shifts: Sequence[str] = ("x", "y")) -> DataFrame:
    """State of entities after an edit log.

    ``edits``: keys, seq, kind ('set' | 'shift' | 'add' | 'remove') with value columns named after the
    fields (set, add) and shifts (deltas for shift, values for set and add; null leaves as is). Only
    what follows the last 'add' of an entity counts; a last 'remove' deletes it. Fields take their
    last set value, positions the last absolute value plus the shifts after it. ``edited`` is true
    once a shift or set was applied. All steps are map-side-combined aggregates; nothing is ordered.
    """
    keys = list(keys)
    life = edits.where("kind in ('add', 'remove')").groupBy(*keys).agg(
        F.max_by("kind", "seq").alias("__last"), F.max(F.when(F.col("kind") == "add", F.col("seq"))).alias("__born")
    )
    e = edits.join(life.select(*keys, "__born"), keys, "left").where("kind <> 'remove' and (__born is null or seq >= __born)")
    absolute = F.col("kind").isin("set", "add")
    aggs = [F.max(F.when(absolute & F.col(c).isNotNull(), F.struct("seq", c))).alias(f"__v_{c}") for c in (*fields, *shifts)]
    last = e.groupBy(*keys).agg(*aggs, F.max((F.col("kind") != "add").cast("int")).alias("__touched"))
    s = e.where("kind = 'shift'").join(last.select(*keys, *[F.col(f"__v_{c}.seq").alias(f"__s_{c}") for c in shifts]), keys)
    s = s.groupBy(*keys).agg(*[F.sum(F.when(F.col(f"__s_{c}").isNull() | (F.col("seq") > F.col(f"__s_{c}")), F.col(c))).alias(f"__d_{c}") for c in shifts])
    b = base.withColumnsRenamed({c: f"__b_{c}" for c in (*fields, *shifts)}).withColumn("__in_base", F.lit(True))
    j = b.join(life, keys, "full_outer").join(last, keys, "left").join(s, keys, "left")
    j = j.where(F.when(F.col("__last").isNotNull(), F.col("__last") == "add").otherwise(F.col("__in_base").isNotNull()))
    # a re-added entity starts from its add, not from the base row
    base_of = lambda c: F.when(F.col("__born").isNull(), F.col(f"__b_{c}"))
    cols = [F.coalesce(F.col(f"__v_{c}.{c}"), base_of(c)).alias(c) for c in fields]
    cols += [(F.coalesce(F.col(f"__v_{c}.{c}"), base_of(c), F.lit(0)) + F.coalesce(f"__d_{c}", F.lit(0))).alias(c) for c in shifts]
    return j.select(*keys, *cols, (F.coalesce("__touched", F.lit(0)) == 1).alias("edited"))


class UndoFold:
    """Undo and redo stacks of one page; commands leave as settled once no undo can reach them."""

    def __init__(self, limit: int = UNDO_LIMIT):
        self.limit, self.undo, self.redo, self.out = limit, [], [], []

    def step(self, seq, op: str) -> None:
        if op == "undo":
            if self.undo:
                self.redo.append(self.undo.pop())
        elif op == "redo":
            if self.redo:
                self.undo.append(self.redo.pop())
                self._trim()
        else:
            self.out += [(s, False) for s in self.redo]
            self.redo = []
            self.undo.append(seq)
            self._trim()

    def _trim(self) -> None:
        while len(self.undo) > self.limit:
            self.out.append((self.undo.pop(0), True))

    def close(self) -> None:
        self.out += [(s, True) for s in self.undo] + [(s, False) for s in self.redo]
        self.undo, self.redo = [], []


def effective_edits(edits: DataFrame, key: str = "page_id", limit: int = UNDO_LIMIT) -> DataFrame:
    """Which commands count after all undos and redos: key, seq, effective.

    ``edits``: key, seq, op ('do' | 'undo' | 'redo'). A new command drops what could be redone; at
    most ``limit`` commands can be undone. The log is streamed in order through each task; only the
    stacks (at most ``limit`` entries) are held, never a page's log.
    """
    types = dict(edits.dtypes)
    ordered = spread(edits.select(key, "seq", "op"), key).sortWithinPartitions(key, "seq")

    def fold(batches):
        current, page = None, None

        def flush():
            rows = [(page, s, e) for s, e in current.out]
            current.out = []
            return rows

        for pdf in batches:
            rows = []
            for k, s, o in zip(pdf[key], pdf["seq"], pdf["op"]):
                if current is None or k != page:
                    if current is not None:
                        current.close()
                        rows += flush()
                    current, page = UndoFold(limit), k
                current.step(s, o)
                if len(current.out) > 10000:
                    rows += flush()
            rows += flush()
            yield pd.DataFrame(rows, columns=[key, "seq", "effective"])
        if current is not None:
            current.close()
            yield pd.DataFrame(flush(), columns=[key, "seq", "effective"])

    return ordered.mapInPandas(fold, f"{key} {types[key]}, seq {types['seq']}, effective boolean")
