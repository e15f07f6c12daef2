"""Hard negatives by maximum inner product search in cover trees.

Candidates get one more coordinate that brings all of them to the same norm, so that the distance to a
candidate tells its inner product with a query. The rows that a task reads become trees of TREE_ROWS rows
at most, each a row of a table in the shared folder. A node's covering radius bounds the inner products
below it from both sides. A search goes from the root to the nodes of the highest bounds first, leaves out
nodes outside its window and those that cannot reach the k-th best so far, and reads exact products at the
leaves. Anchors go in passes of PASS_BYTES, which bounds what is broadcast; each task carries the best of
every search from tree to tree, and the few rows that tasks return are ranked again over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkframe.llm.search import written

SCALE = 256
TREE_ROWS = 4096
#: Nodes of fewer rows are leaves.
LEAF_ROWS = 16
#: Vectors of anchors in one pass over the trees.
PASS_BYTES = 16_000_000
_NODES = ["parent", "center", "lo", "hi"]
_TREE = "row binary, vec_id binary, label binary, x binary, parent binary, center binary, lo binary, hi binary, radius binary"


def vectors(embeddings: DataFrame, labels: int = 10, moved: int = 7) -> DataFrame:
    """row (a number of its own), vec_id, label, x (whole components) of the rows that take part.

    Rows with a null vec_id, label or vector and those with a null or non-finite component do not. Repeated
    rows are rows of their own. Where vec_id is divisible by ``moved``, the label becomes the next one.
    """
    whole = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall("e", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("e"))
    label = F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    x = F.transform("e", lambda x: F.floor(x * SCALE).cast("double"))
    return own.where((F.col("vec_id") + F.col("label")).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), "vec_id", label.alias("label"), x.alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of one array, shorter ones filled with zeros."""
    flat, size = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def augmented(x: np.ndarray, norm: float) -> np.ndarray:
    """x with a last coordinate that gives every row the same norm."""
    return np.column_stack([x, np.sqrt(np.maximum(0.0, norm * norm - np.einsum("ij,ij->i", x, x)))])


def cover_tree(x: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes of a cover tree over the rows of x, and ``order``, in which each node's rows stand at lo..hi.

    The rows of a node lie within its radius of its center. Its children halve the scale: their centers are
    further than that from each other, and each takes the rows within it that no earlier one took.
    """
    order = np.arange(len(x))
    parent, center, lo, hi, radius, scales = [-1], [0], [0], [len(x)], [0.0], [0.0]
    away = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    radius[0] = scales[0] = float(away.max())
    node = 0
    while node < len(parent):
        a, b, scale = lo[node], hi[node], scales[node] / 2
        if b - a > LEAF_ROWS and radius[node] > 0:
            left, at, pick = order[a:b].copy(), a, center[node]
            while len(left):
                away = np.sqrt(((x[left] - x[pick]) ** 2).sum(axis=1))
                inside = away <= scale
                own = left[inside]
                order[at : at + len(own)] = own
                for values, v in ((parent, node), (center, pick), (lo, at), (hi, at + len(own)), (radius, float(away[inside].max())), (scales, scale)):
                    values.append(v)
                at, left, away = at + len(own), left[~inside], away[~inside]
                if len(left):
                    pick = left[away.argmax()]
        node += 1
    place = np.empty(len(x), dtype=np.int64)
    place[order] = np.arange(len(x))
    return {"order": order, "parent": np.array(parent), "center": place[np.array(center)], "lo": np.array(lo), "hi": np.array(hi), "radius": np.array(radius)}


def build_trees(own: DataFrame, width: int, norm: float) -> DataFrame:
    """The rows of vectors() as a table of cover trees."""

    def tree(rows: pa.Table) -> pa.RecordBatch:
        x = matrix(rows["x"].combine_chunks(), width)
        t = cover_tree(augmented(x, norm))
        by = t["order"]
        packed = [*[rows[c].to_numpy()[by] for c in ("row", "vec_id", "label")], x[by], *[t[c] for c in _NODES], t["radius"]]
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(p).tobytes()], type=pa.binary()) for p in packed], names=[f.split()[0] for f in _TREE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while len(batch):
                part = batch.slice(0, TREE_ROWS - sum(map(len, held)))
                held.append(part)
                batch = batch.slice(len(part))
                if sum(map(len, held)) == TREE_ROWS:
                    yield tree(pa.Table.from_batches(held))
                    held = []
        if held:
            yield tree(pa.Table.from_batches(held))

    return written(own.mapInArrow(run, _TREE))


class Tree:
    """A cover tree read back, with the children of a node at ``first``..``end``."""

    def __init__(self, row: dict, width: int, norm: float):
        self.row, self.vec_id, self.label = (np.frombuffer(row[c], dtype=np.int64) for c in ("row", "vec_id", "label"))
        self.x = np.frombuffer(row["x"], dtype=np.float64).reshape(len(self.row), width)
        self.center, self.lo, self.hi = (np.frombuffer(row[c], dtype=np.int64) for c in ("center", "lo", "hi"))
        self.radius, self.norm = np.frombuffer(row["radius"], dtype=np.float64), norm
        parent = np.frombuffer(row["parent"], dtype=np.int64)
        nodes = np.arange(len(parent))
        self.first, self.end = np.searchsorted(parent, nodes), np.searchsorted(parent, nodes, side="right")


class Descent:
    """Searches of one query in one tree; bounds of a node's children are worked out once."""

    def __init__(self, tree: Tree, query: np.ndarray):
        self.tree, self.query, self.bounds = tree, query, {}
        self.norm = float(np.sqrt(query @ query))

    def children(self, node: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, lowest, highest inner product) below node; node -1 stands above the root."""
        if node not in self.bounds:
            t = self.tree
            nodes = np.arange(t.first[node], t.end[node]) if node >= 0 else np.zeros(1, dtype=np.int64)
            at, r = t.x[t.center[nodes]] @ self.query, t.radius[nodes]
            both = self.norm**2 + t.norm**2  # squared distance in the augmented space: both - 2 * product
            far = np.sqrt(np.maximum(0.0, both - 2 * at))
            low = np.maximum(at - self.norm * r, (both - (far + r) ** 2) / 2)
            high = np.minimum(at + self.norm * r, (both - np.maximum(0.0, far - r) ** 2) / 2)
            slack = np.where(r > 0, 1e-6 * (1 + self.norm * t.norm), 0.5)  # products are whole numbers
            self.bounds[node] = nodes, low - slack, high + slack
        return self.bounds[node]

    def best(self, found: tuple[np.ndarray, ...], k: int, lowest: float, highest: float, label: int, same: bool, row: int) -> tuple[np.ndarray, ...]:
        """The k best (score, vec_id, row) of found and the tree's rows with lowest <= score <= highest and the label
        (or with same false another one), without ``row``; equal scores by smaller vec_id."""
        t = self.tree
        nodes, low, high = self.children(-1)
        batch = 8
        while len(nodes):
            limit = max(lowest, found[0][-1] if len(found[0]) == k else -np.inf)
            open_ = (high >= limit) & (low <= highest)
            nodes, low, high = nodes[open_], low[open_], high[open_]
            order = np.argsort(-high, kind="stable")
            now, later = order[:batch], order[batch:]
            leaf = t.first[nodes[now]] == t.end[nodes[now]]
            inner = [self.children(int(n)) for n in nodes[now[~leaf]]]
            ends = nodes[now[leaf]]
            places = np.concatenate([np.arange(a, b) for a, b in zip(t.lo[ends], t.hi[ends], strict=True)]) if len(ends) else ends
            places = places[((t.label[places] == label) == same) & (t.row[places] != row)]
            scores = t.x[places] @ self.query
            inside = (scores >= limit) & (scores <= highest)
            if inside.any():
                places = places[inside]
                score, vec_id, rows = (np.concatenate(c) for c in zip(found, (scores[inside], t.vec_id[places], t.row[places]), strict=True))
                by = np.lexsort((rows, vec_id, -score))[:k]
                found = score[by], vec_id[by], rows[by]
            nodes, low, high = (np.concatenate([old[later], *[new[c] for new in inner]]) for c, old in enumerate((nodes, low, high)))
            batch *= 2
        return found


NONE = (np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def _search(trees: DataFrame, asked: DataFrame, k: int, same: bool, width: int, norm: float) -> DataFrame:
    """(search, score, vec_id, row, rank) for the searches (search, row, label, x, lowest, highest) of ``asked``.

    searches of one anchor row stand together, so each pass reads the trees once.
    """
    spark = trees.sparkSession
    n = asked.count()
    passes = max(1, -(-n * 8 * max(1, width) // PASS_BYTES))
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid4().hex}"
    parts = trees.coalesce(2 * spark.sparkContext.defaultParallelism)  # bounds the rows that come out
    schema = "search long, score double, vec_id long, row long"

    def answer(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search, row, label, lowest, highest, x = shared.value
            edge = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
            held: dict[int, tuple[np.ndarray, ...]] = {}
            for batch in batches:
                for packed in batch.to_pylist():
                    tree = Tree(packed, width, norm)
                    for a, b in zip(edge[:-1], edge[1:], strict=True):
                        descent = Descent(tree, x[a])
                        for j in range(a, b):
                            held[j] = descent.best(held.get(j, NONE), k, lowest[j], highest[j], int(label[j]), same, int(row[j]))
            for j, (scores, ids, rows) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), search[j])), pa.array(scores), pa.array(ids), pa.array(rows)], names=["search", "score", "vec_id", "row"])

        return run

    for p in range(passes):
        block = asked.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == p).orderBy("row", "search").toArrow()  # about PASS_BYTES
        if not len(block):
            continue
        columns = [block[c].to_numpy() for c in ("search", "row", "label", "lowest", "highest")]
        shared = spark.sparkContext.broadcast((*columns, matrix(block["x"].combine_chunks(), width)))
        parts.mapInArrow(answer(shared), schema).write.mode("append").parquet(folder)
        shared.unpersist()
    if not n:
        return spark.createDataFrame([], f"{schema}, rank int")
    order = Window.partitionBy("search").orderBy(F.desc("score"), "vec_id", "row")
    return spark.read.schema(schema).parquet(folder).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (vec_id divisible by
    ``every``) and each of its best positives, the k best rows of other labels whose score is low to high percent of
    the positive's, by whole arithmetic.

    See vectors() for the rows that take part; vectors shorter than the longest count as filled with zeros. Scores
    are exact while products stay below 2^53. An anchor without positives, and a positive without a negative in its
    window, have no rows; an empty table has none. Other columns are not read. Anchor rows of one vec_id have
    results of their own each.
    """
    own = written(vectors(embeddings))
    width, square = own.agg(F.max(F.size("x")), F.max(F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x))).first()
    width, norm = max(1, width or 0), float(np.sqrt(square or 0.0))
    trees = build_trees(own, width, norm)
    anchors = own.where(F.col("vec_id") % every == 0)
    asked = anchors.select(F.col("row").alias("search"), "row", "label", "x", F.lit(float("-inf")).alias("lowest"), F.lit(float("inf")).alias("highest"))
    best = _search(trees, asked, positives, True, width, norm)
    found = best.select(F.col("search").alias("anchor"), (F.col("search") * positives + F.col("rank") - 1).alias("search"), F.col("vec_id").alias("positive_id"), F.col("score").cast("long").alias("positive_score"))
    found = written(found)
    windows = found.withColumns({"lowest": F.ceil(F.col("positive_score") * low / F.lit(100.0)).cast("double"), "highest": F.floor(F.col("positive_score") * high / F.lit(100.0)).cast("double")})
    asked = windows.join(anchors.withColumnRenamed("row", "anchor"), "anchor").withColumn("row", F.col("anchor")).where("lowest <= highest")
    near = _search(trees, asked.select("search", "row", "label", "x", "lowest", "highest"), k, False, width, norm)
    named = found.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return near.withColumnRenamed("vec_id", "negative_id").drop("row").join(named, "search").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").cast("long").alias("negative_score")
    )
