"""Exact top-k search with M-trees.

Largest inner products become smallest distances once every vector x is given one more component,
sqrt(M^2 - |x|^2), with M the greatest norm of its tree, and every query a zero there. Rows are dealt to
trees of bounded size by a hash. A tree's nodes are pages of entries, each with a pivot, a covering radius
and its distance to the parent's pivot. A query walks each tree best first: the stored distances rule
entries out by the triangle inequality before any distance is computed, the radii rule out pages.
Queries travel in blocks to every tree, which a task loads once for all the blocks that it is sent, and each
tree answers a query with k rows at most.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import for_python, written

K = 5
#: Entries of a page; vectors of a tree, in number and in bytes, whichever is less; queries of a block, likewise;
#: blocks that are sent to one copy of a tree.
PAGE = 512
IN_TREE = 16384
TREE_BYTES = 16 << 20
IN_BLOCK = 512
BLOCK_BYTES = 4 << 20
BLOCKS = 8
SCALE = 256
#: Integers below this are exact as doubles.
_EXACT = 2.0**53


@dataclass
class Node:
    """A page. ``far`` holds the entries' distances to the page's own pivot; leaves hold vectors, others pages."""

    far: np.ndarray
    points: np.ndarray
    squares: np.ndarray  # of the points' lengths
    rows: np.ndarray  # of a leaf's vectors, in the order of their ids
    radius: np.ndarray
    below: list[Node] | None


class MTree:
    """An M-tree over integer vectors, loaded at once: pages are split around far-apart pivots from the top down.

    ``ids`` are numbers to which vectors answer, in rising order, and may repeat; ``own`` tells rows apart.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE, own: np.ndarray | None = None):
        self.page, self.ids = page, ids
        self.place = {} if own is None else {int(r): i for i, r in enumerate(own)}
        norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
        self.m2 = float(norms.max())
        points = np.column_stack([vectors.astype(np.float64), np.sqrt(self.m2 - norms)])
        # Doubles hold the vectors and give the bounds; where they can't hold every score, the integers give these.
        self.whole = vectors.astype(np.int64) if self.m2 * len(vectors[0]) >= _EXACT else None
        self.slack = 1e-9 * (self.m2 + 1)
        self.root_pivot = points.mean(axis=0)
        self.root = self._load(points, np.arange(len(points)), self.root_pivot)

    def _load(self, points: np.ndarray, rows: np.ndarray, pivot: np.ndarray) -> Node:
        own = points[rows]
        if len(rows) <= self.page:
            return Node(np.sqrt(((own - pivot) ** 2).sum(axis=1)), own, (own**2).sum(axis=1), rows, np.zeros(len(rows)), None)
        # Pivots by farthest-first traversal, then every vector goes to its nearest pivot.
        n = min(self.page, max(2, len(rows) // (self.page // 2)))
        near, chosen, to = np.full(len(rows), np.inf), [0], np.zeros(len(rows), np.int64)
        for k in range(n):
            d = ((own - own[chosen[k]]) ** 2).sum(axis=1)
            closer = d < near
            near[closer], to[closer] = d[closer], k
            if k + 1 < n:
                far = int(near.argmax())
                if near[far] == 0:
                    break  # fewer different vectors than pivots
                chosen.append(far)
        parts = [np.flatnonzero(to == k) for k in range(len(chosen))]
        if len(parts) == 1 or max(map(len, parts)) == len(rows):
            parts = np.array_split(np.arange(len(rows)), -(-len(rows) // self.page))
            parts = parts if len(parts) <= self.page else np.array_split(np.arange(len(rows)), self.page)
        below, pivots, radius = [], [], []
        for part in parts:
            p = own[part[0]] if len(part) == 1 else own[part].mean(axis=0)
            below.append(self._load(points, rows[part], p))
            pivots.append(p)
            radius.append(np.sqrt(((own[part] - p) ** 2).sum(axis=1)).max())
        pivots = np.asarray(pivots)
        return Node(np.sqrt(((pivots - pivot) ** 2).sum(axis=1)), pivots, (pivots**2).sum(axis=1), rows[:0], np.asarray(radius), below)

    def search(self, query: np.ndarray, k: int, own: int | None = None) -> list[tuple[int, int]]:
        """The ``k`` best (score, id), ties to smaller ids, without the row ``own``. Scores are exact 64-bit integers."""
        skip = self.place.get(own) if self.place else own
        q = np.append(query.astype(np.float64), 0.0)
        q2 = float((q**2).sum())
        slack = self.slack + 1e-9 * q2
        base = q2 + self.m2
        exact = self.whole is None and self.m2 * q2 < _EXACT**2

        def most(distance: np.ndarray) -> np.ndarray:
            """No score can be above this at that distance or farther."""
            return (base - np.maximum(distance, 0.0) ** 2) / 2 + slack

        best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
        start = float(np.sqrt(((q - self.root_pivot) ** 2).sum()))
        todo: list[tuple[float, int, Node, float]] = [(-float("inf"), 0, self.root, start)]
        pushed = 0
        while todo:
            bound, _, node, to_pivot = heapq.heappop(todo)
            full = len(best) == k
            worst = best[0][0] if full else None
            if full and -bound < worst:
                break
            # Distances to the page's pivot, stored and known, bound the entries' without computing any.
            alive = np.arange(len(node.far))
            if full:
                alive = np.flatnonzero(most(np.abs(to_pivot - node.far) - node.radius) >= worst)
                if not len(alive):
                    continue
            if node.below is None:
                if exact:
                    dots = node.points[alive] @ q  # sums of integers below 2**53
                else:
                    whole = self.whole[node.rows[alive]] if self.whole is not None else node.points[alive, :-1].astype(np.int64)
                    dots = whole @ query.astype(np.int64)
                if full:
                    alive, dots = alive[dots >= worst], dots[dots >= worst]
                for i, s in zip(node.rows[alive].tolist(), dots.tolist(), strict=True):
                    if i != skip:
                        if len(best) < k:
                            heapq.heappush(best, (s, -i))
                        elif (s, -i) > best[0]:
                            heapq.heapreplace(best, (s, -i))
                continue
            dots = node.points[alive] @ q
            d = np.sqrt(np.maximum(node.squares[alive] + q2 - 2 * dots, 0.0))
            bounds = most(d - node.radius[alive])
            for i, b, x in zip(alive.tolist(), bounds.tolist(), d.tolist(), strict=True):
                if not full or b >= worst:
                    pushed += 1
                    heapq.heappush(todo, (-b, pushed, node.below[i], x))
        # Rows stand in the order of their ids, so ties of rows are ties of ids.
        return [(s, int(self.ids[i])) for s, i in sorted(((int(s), -i) for s, i in best), key=lambda x: (-x[0], x[1]))]


def quantised(vector: str = "embedding", scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null where the vector or a component is null or not finite."""
    v = F.col(vector)
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0), np.int64)


def top_k(rows: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", in_tree: int = IN_TREE, in_block: int = IN_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row, the ``k`` other rows of largest integer inner product.

    Rows with a null id, and vectors that are null, empty or hold a null or non-finite component, take no
    part. Vectors are held against those of their own length alone. A query with fewer candidates gets fewer
    rows. Rows that repeat an id are candidates, and queries, of their own. Extra columns are ignored. Scores
    are 64-bit integers.
    """
    spark = rows.sparkSession
    for_python(spark)
    sound = rows.select(F.col(id_col).cast("long").alias("id"), quantised(vector_col).alias("v"), is_query.alias("q")).filter("id is not null and v is not null and size(v) > 0")
    sound = written(sound.select(F.monotonically_increasing_id().alias("row"), "id", "v", "q", F.size("v").cast("long").alias("dim")))
    # One row per length of vectors: how many trees and blocks of queries there are, and to how many copies of a tree they go.
    held = lambda most, size: F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.lit(size) / (8 * (F.col("dim") + 1)))))
    counts = sound.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("queries"))
    counts = counts.select("dim", F.ceil(F.col("n") / held(in_tree, TREE_BYTES)).alias("trees"), F.ceil(F.col("queries") / held(in_block, BLOCK_BYTES)).alias("blocks"))
    counts = written(counts.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("blocks") / BLOCKS))))
    tasks = int(counts.agg(F.sum(F.col("trees") * F.col("parts"))).first()[0] or 0)
    sized = sound.join(F.broadcast(counts), "dim")

    def load(key: tuple, table: pa.Table) -> pa.Table:
        batch = table.sort_by([("id", "ascending"), ("row", "ascending")]).combine_chunks()
        tree = MTree(batch["id"].to_numpy(), _matrix(batch["v"].chunk(0)), own=batch["row"].to_numpy())
        return pa.table({"dim": [key[0].as_py()], "tree": [key[1].as_py()], "parts": pa.array([batch["parts"][0].as_py()], pa.int64()), "blob": pa.array([pickle.dumps(tree)], pa.binary())})

    def block(key: tuple, table: pa.Table) -> pa.Table:
        batch = table.combine_chunks()
        blob = pickle.dumps((batch["row"].to_numpy(), batch["id"].to_numpy(), _matrix(batch["v"].chunk(0))))
        return pa.table({"dim": [key[0].as_py()], "block": [key[1].as_py()], "trees": pa.array([batch["trees"][0].as_py()], pa.int64()), "parts": pa.array([batch["parts"][0].as_py()], pa.int64()), "blob": pa.array([blob], pa.binary())})

    hashed = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(n))
    trees = written(sized.withColumn("tree", hashed("trees", 1)).select("dim", "tree", "parts", "row", "id", "v").groupBy("dim", "tree").applyInArrow(load, "dim long, tree long, parts long, blob binary"))
    blocks = written(sized.filter("q").withColumn("block", hashed("blocks", 2)).select("dim", "block", "trees", "parts", "row", "id", "v").groupBy("dim", "block").applyInArrow(block, "dim long, block long, trees long, parts long, blob binary"))
    # Each copy of a tree is followed by its blocks, in one partition; so it is sent and opened once.
    copies = trees.select("dim", "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("nth"), "blob")
    sent = blocks.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1)).alias("tree"), (F.col("block") % F.col("parts")).alias("part"), F.lit(1).alias("nth"), "blob")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for i in range(batch.num_rows):
                content = pickle.loads(batch.column(1)[i].as_py())
                if batch.column(0)[i].as_py() == 0:
                    tree = content
                    continue
                found = [(r, q, n, s) for r, q, v in zip(*(x.tolist() for x in content[:2]), content[2], strict=True) for s, n in tree.search(v, k, r)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 4)], names=["row", "query_id", "vec_id", "score"])

    both = copies.unionByName(sent).repartition(max(1, tasks), "dim", "tree", "part").sortWithinPartitions("dim", "tree", "part", "nth")
    pairs = both.select("nth", "blob").mapInArrow(search, "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every fiftieth vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, F.col("vec_id") % 50 == 0)


OP2_SQL = """
with e as (
  select row_number() over () as row, vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
p as (
  select q.row, q.vec_id as query_id, c.vec_id, cast(list_sum([a[1] * a[2] for a in list_zip(q.v, c.v)]) as bigint) as score
  from e q join e c on q.vec_id % 50 = 0 and q.row <> c.row and len(q.v) = len(c.v))
select query_id, cast(row_number() over (partition by row order by score desc, vec_id) as integer) as rank, vec_id, score
from p qualify rank <= 5
"""
