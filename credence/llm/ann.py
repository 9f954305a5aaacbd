"""Nearest neighbours by inner product over vantage-point trees, one per shard.

Vectors get one more coordinate, so that within a shard the largest inner product is
the smallest distance (the longest vector of the shard sets the scale). A tree node
holds a vantage point and the distances that bound its inner and outer half; a half
is left out when ``factor`` times the bound that the triangle inequality gives
exceeds the distance of the k-th neighbour so far. With factor 1 the search is exact.

The queries are a stated set, held against all shards in blocks: a task sees one
shard and one block of queries, so its memory is bounded by both sizes.

Defined cases: null, zero or ragged vectors (another length than most have), vectors
with null or non-finite components and rows with a null id take no part; repeated
rows are candidates each; rows with a query's own id are not its neighbours; a query
given twice is answered twice; an empty table gives no rows; further columns are
ignored; ties go to the smaller id.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors per shard and queries per block, on average; vectors in a leaf.
SHARD, QUERIES, LEAF = 8192, 2048, 256
#: Far above rounding errors of a product of unit-sized vectors, relative to their lengths.
_SLACK = 1e-9


def takes_part(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed from the first component on."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * x[:, d]
    return total


class Tree:
    """A vantage-point tree over the rows of ``x``; nodes lie in ``nodes`` from the root on."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, nodes: np.ndarray | None = None, leaf: int = LEAF):
        self.ids, self.x = ids, x
        self.wide = x.astype(np.float64)
        norms = (self.wide**2).sum(1)
        self.scale = float(norms.max(initial=0.0))
        self.extra = np.sqrt(np.maximum(self.scale - norms, 0))
        self.nodes = self._grow(leaf) if nodes is None else nodes

    def _grow(self, leaf: int) -> np.ndarray:
        """Order the rows by tree and list nodes: low, mid, high, inner radius, outer radius, inner child, outer child."""
        order = np.random.default_rng(len(self.ids)).permutation(len(self.ids))
        nodes: list[list[float]] = []

        def split(low: int, high: int) -> int:
            n = len(nodes)
            nodes.append([low, high, high, 0.0, 0.0, -1, -1])
            if high - low <= leaf:
                return n
            at, rest = order[low], order[low + 1 : high]
            d = np.sqrt(((self.wide[rest] - self.wide[at]) ** 2).sum(1) + (self.extra[rest] - self.extra[at]) ** 2)
            by = np.argsort(d, kind="stable")
            order[low + 1 : high] = rest[by]
            mid = low + 1 + len(rest) // 2
            nodes[n][1:5] = [mid, high, d[by[mid - low - 2]], d[by[mid - low - 1]]]
            nodes[n][5] = split(low + 1, mid)
            nodes[n][6] = split(mid, high)
            return n

        split(0, len(order))
        self.ids, self.x, self.wide, self.extra = self.ids[order], self.x[order], self.wide[order], self.extra[order]
        return np.array(nodes, np.float64)

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, x=self.x, nodes=self.nodes)
        return out.getvalue()

    @staticmethod
    def unpack(blob: bytes) -> Tree:
        with np.load(io.BytesIO(blob)) as z:
            return Tree(z["ids"], z["x"], z["nodes"])

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores (rows of k, best first; -inf where there are fewer) of the best rows of each query."""
        best = np.full((len(q), k), -np.inf)
        best_ids = np.full((len(q), k), np.iinfo(np.int64).max)
        square = (q**2).sum(1) + self.scale
        slack = _SLACK * (np.abs(square) + 1)

        def offer(rows: np.ndarray, low: int, high: int, scores: np.ndarray) -> None:
            """Take the products that may reach the k-th best so far; they are summed again in order."""
            r, c = np.nonzero(scores >= best[rows, -1][:, None] - slack[rows][:, None])
            own = rows[r]
            other = self.ids[low + c] != query_ids[own]
            own, c = own[other], c[other] + low
            if not len(own):
                return
            exact = inner(q[own], self.wide[c])
            touched = np.unique(own)
            all_rows = np.concatenate([own, np.repeat(touched, k)])
            all_ids = np.concatenate([self.ids[c], best_ids[touched].ravel()])
            all_scores = np.concatenate([exact, best[touched].ravel()])
            order = np.lexsort((all_ids, -all_scores, all_rows))
            sorted_rows = all_rows[order]
            rank = np.arange(len(order)) - np.searchsorted(sorted_rows, sorted_rows)
            top = order[rank < k]
            best[touched] = all_scores[top].reshape(-1, k)
            best_ids[touched] = all_ids[top].reshape(-1, k)

        def visit(n: int, rows: np.ndarray) -> None:
            low, mid, high, inside, outside, a, b = self.nodes[n]
            low, high = int(low), int(high)
            if not len(rows) or high <= low:
                return
            if a < 0:
                offer(rows, low, high, q[rows] @ self.wide[low:high].T)
                return
            product = q[rows] @ self.wide[low]
            offer(rows, low, low + 1, product[:, None])
            d = np.sqrt(np.maximum(square[rows] - 2 * product, 0))
            near = d < (inside + outside) / 2
            bounds = ((int(a), d - inside), (int(b), outside - d))
            visit(int(a), rows[near])
            visit(int(b), rows[~near])
            for (child, bound), far in zip(bounds, (~near, near), strict=True):
                reach = np.sqrt(np.maximum(square[rows] - 2 * best[rows, -1], 0) + slack[rows])
                visit(child, rows[far & (factor * bound <= reach + np.sqrt(slack[rows]))])

        visit(0, np.arange(len(q)))
        return best_ids, best


def search(vectors: DataFrame, query_divisor: int = 20, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD, block_rows: int = QUERIES, dim: int | None = None) -> DataFrame:
    """The ``k`` nearest rows of every row whose id is divisible by ``query_divisor``.

    Columns: query_id, rank (from 1), vec_id, score.
    """
    if dim is None:
        top = vectors.filter(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        dim = top.n if top else 0
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = rows.filter(F.col("id").isNotNull() & (F.size("v") == dim) & takes_part(F.col("v")))
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("id") % query_divisor == 0).alias("q")).first()
    shards, blocks = max(1, -(-counts.n // shard_rows)), max(1, -(-counts.q // block_rows))

    def plant(g: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(g["id"].to_numpy(np.int64), np.stack(g["v"].to_numpy()))
        return pd.DataFrame({"shard": g["shard"].iloc[:1], "tree": [tree.pack()]})

    def bundle(g: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        np.savez(out, rows=g["row"].to_numpy(np.int64), ids=g["id"].to_numpy(np.int64), q=np.stack(g["v"].to_numpy()))
        return pd.DataFrame({"block": g["block"].iloc[:1], "queries": [out.getvalue()]})

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for blob, asked in zip(batch["tree"], batch["queries"], strict=True):
                with np.load(io.BytesIO(asked)) as z:
                    own, ids, q = z["rows"], z["ids"], z["q"]
                found, scores = Tree.unpack(blob).search(ids, q, k, factor)
                real = np.isfinite(scores)
                yield pd.DataFrame({"row": np.repeat(own, k)[real.ravel()], "query_id": np.repeat(ids, k)[real.ravel()], "vec_id": found[real], "score": scores[real]})

    trees = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).groupBy("shard").applyInPandas(plant, "shard long, tree binary")
    asked = rows.filter(F.col("id") % query_divisor == 0).withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks))).groupBy("block").applyInPandas(bundle, "block long, queries binary")
    tasks = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")))
    found = tasks.join(trees, "shard").mapInPandas(answer, "row long, query_id long, vec_id long, score double")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
