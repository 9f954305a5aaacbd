"""Similarity joins over vectors within groups: blocks of vectors against streams of vectors, in Arrow tasks.

Exact joins compare all rows of a group. A task holds one block of bounded size and
compares it with rows that pass by in small batches, so its memory does not grow with
the group; only pairs above the threshold (or the k best) leave it.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.session import checkpointed

#: Vectors in a block, on average.
BLOCK = 4096
#: Products computed at once.
CELLS = 1 << 20

#: Ids, vectors (float64) and marks of some rows.
Part = tuple[np.ndarray, np.ndarray, np.ndarray]


def _held(rows: DataFrame, group: str, mark: Column | None) -> DataFrame:
    """The rows that can take part: g, id, embedding, mark."""
    held = rows.select(F.col(group).alias("g"), F.col("id").cast("long").alias("id"), "embedding", (F.lit(0) if mark is None else mark).cast("long").alias("mark"))
    return held.filter(F.col("embedding").isNotNull() & F.col("id").isNotNull() & F.col("g").isNotNull() & F.col("mark").isNotNull())


def _counts(held: DataFrame, block: int) -> DataFrame:
    """Blocks of each group: g, n."""
    return held.groupBy("g").agg(F.ceil(F.count("*") / block).cast("long").alias("n"))


def _sent(rows: DataFrame, group: str, block: int, once: bool, mark: Column | None = None) -> DataFrame:
    """Rows of one table, sent to their own block, which holds them, and to others that they pass by.

    ``once``: of two blocks, only one meets the rows of the other (the owner alternates, so that
    all have the same share); else each block meets the rows of all others.
    """
    held = _held(rows, group, mark)
    dealt = held.join(_counts(held, block), "g").withColumn("b", F.pmod(F.xxhash64("id"), F.col("n")))
    own = lambda k: (k == F.col("b")) | (F.pmod(k + F.col("b"), F.lit(2)) == F.when(k > F.col("b"), 0).otherwise(1))
    to = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    return dealt.withColumn("to", F.explode(F.filter(to, own) if once else to)).select("g", "to", (F.col("to") == F.col("b")).alias("own"), "id", "embedding", "mark")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, Part]]:
    """Runs of rows of one block that are all held or all passing by."""
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("g").dictionary_encode()
        to, own = batch.column("to").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False)
        ids, marks = batch.column("id").to_numpy(), batch.column("mark").to_numpy()
        vectors = batch.column("embedding")
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        if len(flat) % len(ids) or (np.diff(vectors.offsets.to_numpy()) != len(flat) // len(ids)).any():
            raise ValueError("vectors of different lengths")
        x = flat.reshape(len(ids), -1)
        code = codes.indices.to_numpy()
        cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(to) != 0) | (own[1:] != own[:-1])) + 1
        for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(ids)]):
            yield (codes.dictionary[int(code[lo])].as_py(), int(to[lo])), bool(own[lo]), (ids[lo:hi], x[lo:hi].astype(np.float64), marks[lo:hi])


def _each_block(sent: DataFrame, work: Callable[[Part, Iterator[Part]], Iterator[list]], schema: str) -> DataFrame:
    """``work(block, passing)`` for each block, with the rows that pass by in parts of bounded size; it yields lists of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, segments in itertools.groupby(_segments(batches), key=lambda s: s[0]):
            held, after = [], []
            for segment in segments:
                if not segment[1]:
                    after = [segment]
                    break
                held.append(segment[2])
            if held:
                block = tuple(np.concatenate(c) for c in zip(*held))
                for columns in work(block, (s[2] for s in itertools.chain(after, segments))):
                    if len(columns[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    parts = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(parts, "g", "to").sortWithinPartitions("g", "to", F.desc("own")).mapInArrow(run, schema)


def _cut(parts: Iterator[Part], width: int) -> Iterator[Part]:
    step = max(1, CELLS // width)
    for ids, x, marks in parts:
        for at in range(0, len(ids), step):
            yield ids[at : at + step], x[at : at + step], marks[at : at + step]


def _above(x: np.ndarray, y: np.ndarray, least: float, equal: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and rounded products of the pairs whose rounded product exceeds ``least`` (or equals it)."""
    raw = x @ y.T
    i, j = np.nonzero(raw > least - 2e-6)
    cos = np.round(raw[i, j], 6)
    keep = cos >= least if equal else cos > least
    return i[keep], j[keep], cos[keep]


def theta_pairs(rows: DataFrame, group: str, threshold: float, block: int = BLOCK, mark: Column | None = None, floors: Callable[[int, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Pairs of a group whose product exceeds the threshold: a, b (a < b), cos.

    With ``mark``, a long of each row, and ``floors(mark, marks)``, symmetric, a pair must also reach
    the floor of its two marks; where it is infinite nothing is computed. Rows without a mark take no part.
    """

    def meet(part: Part, other: Part, within: bool) -> Iterator[list]:
        for m in [0] if floors is None else np.unique(part[2]).tolist():
            a, x, _ = part if floors is None else [c[part[2] == m] for c in part]
            b, y, _ = other
            if floors is not None:
                least = floors(m, other[2])
                at = np.flatnonzero(least < np.inf)
                b, y, least = b[at], y[at], least[at]
            if not len(b):
                continue
            i, j, cos = _above(x, y, threshold)
            lo, hi = np.minimum(a[i], b[j]), np.maximum(a[i], b[j])
            keep = (a[i] < b[j]) if within else lo != hi
            if floors is not None:
                keep &= cos >= least[j]
            yield [lo[keep], hi[keep], cos[keep]]

    def work(held: Part, passing: Iterator[Part]) -> Iterator[list]:
        for part in _cut([held], len(held[0])):
            yield from meet(part, held, True)
        for part in _cut(passing, len(held[0])):
            yield from meet(part, held, False)

    return _each_block(_sent(rows, group, block, True, mark), work, "a long, b long, cos double")


def theta_links(rows: DataFrame, group: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """Pairs a, b whose components are those of all pairs of ``theta_pairs``.

    A block sends at most one pair for each row it holds and each that passes by, however many are alike.
    """

    def work(held: Part, passing: Iterator[Part]) -> Iterator[list]:
        ids, y, _ = held
        root = np.arange(len(ids))

        def join(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Join the components of all j of one i; the component of each pair."""
            nonlocal root
            while len(i):
                near = root[j]
                least = np.full(i[-1] + 1, len(ids))
                np.minimum.at(least, i, near)
                if (least[i] == near).all():
                    break
                np.minimum.at(root, near, least[i])
                while (root[root] != root).any():
                    root = root[root]
            return root[j]

        at = 0
        for a, x, _ in _cut([held], len(ids)):
            i, j, _ = _above(x, y, threshold)
            keep = a[i] != ids[j]
            i, j = i[keep], j[keep]
            alike = np.unique(i)
            i, j = np.concatenate([i, alike]), np.concatenate([j, alike + at])
            order = np.argsort(i, kind="stable")
            join(i[order], j[order])
            at += len(a)
        for a, x, _ in _cut(passing, len(ids)):
            i, j, _ = _above(x, y, threshold)
            keep = a[i] != ids[j]
            i, j = i[keep], j[keep]
            near = join(i, j)
            one, first = np.unique(i, return_index=True)
            yield [a[one], ids[near[first]]]
        moved = np.flatnonzero(root != np.arange(len(ids)))
        yield [ids[moved], ids[root[moved]]]

    return _each_block(_sent(rows, group, block, True), work, "a long, b long").filter("a <> b")


def cross_pairs(left: DataFrame, right: DataFrame, group: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """Pairs of a left and a right row of a group whose product exceeds the threshold: a, b, cos."""

    def work(held: Part, passing: Iterator[Part]) -> Iterator[list]:
        for a, x, _ in _cut(passing, len(held[0])):
            i, j, cos = _above(x, held[1], threshold)
            yield [a[i], held[0][j], cos]

    two = _held(right, group, None)
    counts = _counts(two, block)
    columns = ["g", "to", "own", "id", "embedding", "mark"]
    kept = two.join(counts, "g").withColumns({"to": F.pmod(F.xxhash64("id"), F.col("n")), "own": F.lit(True)}).select(*columns)
    to = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    sent = _held(left, group, None).join(counts, "g").withColumns({"to": to, "own": F.lit(False)}).select(*columns)
    return _each_block(kept.unionByName(sent), work, "a long, b long, cos double")


def knn(rows: DataFrame, group: str, k: int, floor: float = -2.0, block: int = BLOCK) -> DataFrame:
    """The k nearest other rows of each row within its group: id, rank, other, cos."""

    def work(held: Part, passing: Iterator[Part]) -> Iterator[list]:
        b, y, _ = held
        for a, x, _ in _cut(itertools.chain([held], passing), len(b)):
            cos = np.round(x @ y.T, 6)
            cos[(a[:, None] == b[None, :]) | np.isnan(cos)] = -np.inf
            best = np.partition(cos, -k, axis=1)[:, -k, None] if k < len(b) else np.full((len(a), 1), -np.inf)
            i, j = np.nonzero((cos >= best) & (cos >= floor))
            order = np.lexsort((b[j], -cos[i, j], i))
            i, j = i[order], j[order]
            starts = np.searchsorted(i, np.arange(len(a)))
            keep = np.arange(len(i)) - starts[i] < k
            i, j = i[keep], j[keep]
            yield [a[i], b[j], cos[i, j]]

    near = _each_block(_sent(rows, group, block, False), work, "id long, other long, cos double")
    by = Window.partitionBy("id").orderBy(F.desc("cos"), "other")
    return near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("id", "rank", "other", "cos")


def with_later(rows: DataFrame, group: str, place: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """Ids of rows with a row at or above a threshold in their group whose (place, id) is larger; ``place`` is a long.

    A pair is computed once, and a block sends each id it holds or meets once at most, so a
    group of very many copies costs no more rows than others.
    """

    def work(held: Part, passing: Iterator[Part]) -> Iterator[list]:
        b, y, q = held
        found = np.zeros(len(b), bool)
        for (a, x, p), within in itertools.chain(((s, True) for s in _cut([held], len(b))), ((s, False) for s in _cut(passing, len(b)))):
            i, j, _ = _above(x, y, threshold, True)
            keep = a[i] != b[j]
            i, j = i[keep], j[keep]
            later = (q[j] > p[i]) | ((q[j] == p[i]) & (b[j] > a[i]))
            found[j[~later]] = True
            yield [np.unique(a[i[later]])] if not within else [a[:0]]
        yield [b[found]]

    return _each_block(_sent(rows, group, block, True, F.col(place)), work, "id long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """Smallest id reachable over edges (a, b): id, root.

    Minimum labels spread and jump until none changes; each round is checkpointed.
    """
    both = checkpointed(edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to"))).distinct())
    labels = checkpointed(both.groupBy("id").agg(F.least(F.first("id"), F.min("to")).alias("root")))
    state = _digest(labels)
    while True:
        spread = both.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("root").alias("near"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        labels = checkpointed(labels.join(spread, "id").join(jump, "root", "left").select("id", F.least("root", "near", F.coalesce("beyond", "root")).alias("root")))
        before, state = state, _digest(labels)
        if before == state:
            return labels


def _digest(labels: DataFrame) -> tuple:
    """Tells two label tables apart: how many rows, and the exclusive or of their hashes, which cannot overflow."""
    return tuple(labels.agg(F.count("*"), F.bit_xor(F.xxhash64("id", "root"))).first())


def nearest_anchor(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """The best anchor of each row: id, name, cos. ``anchors`` (name, emb) is a small table, checked to be broadcast."""
    from credence.functions import kernels

    small = anchors.select("name", F.col("emb"))
    if small.limit(10_001).count() > 10_000:
        raise ValueError("more anchors than a broadcast table may hold; join by blocks with knn instead")
    pairs = rows.filter(F.col("embedding").isNotNull()).select("id", "embedding").join(F.broadcast(small))
    scored = pairs.select("id", "name", F.round(kernels.dot(F.col("embedding"), F.col("emb")), 6).alias("cos"))
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("cos")).alias("c"), F.col("name").alias("n"))).alias("m"))
    return best.select("id", F.col("m.n").alias("name"), (-F.col("m.c")).alias("cos"))


def centroids(rows: DataFrame, label: str) -> DataFrame:
    """Sum and count of vectors per label, component by component: label, sum, cnt, emb (unit)."""
    from credence.functions import kernels

    part = rows.filter(F.col("embedding").isNotNull()).select(F.col(label).alias("label"), F.posexplode(kernels.wide(F.col("embedding"))).alias("d", "x"))
    sums = part.groupBy("label", "d").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    whole = sums.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "s"))).alias("v"), F.max("n").alias("cnt"))
    total = whole.select("label", F.transform("v", lambda p: p["s"]).alias("sum"), "cnt")
    return total.withColumn("emb", kernels.normalise(F.col("sum")))
