import numpy as np
import pytest

from credence.llm import ann, queries


def brute(ids, x, divisor, k):
    out = []
    for i in np.flatnonzero(ids % divisor == 0):
        scores = ann.inner(np.repeat(x[i : i + 1], len(x), 0), x)
        rows = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), float(scores[j])) for r, j in enumerate(rows)]
    return sorted(out)


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_query_over_the_smallest_tables(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    want = brute(t.vec_id.to_numpy(), np.stack(t.embedding).astype(float), 20, 20)
    assert rows_of(queries.op10_vantage_points(spark, "/root/testdata/sf0.001")) == want


@pytest.mark.parametrize("kind", ["clusters", "lengths", "equal"])
def test_factor_one_is_exact_in_many_small_shards_and_larger_factors_only_lose_rows(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 6))
    if kind == "clusters":
        x = np.repeat(rng.normal(size=(6, 6)) * 5, 100, 0) + x * 0.1
    if kind == "equal":
        x[:] = x[0]
    ids = np.arange(600)
    tree = ann.Tree(ids, x, leaf=8)
    q = ids % 7 == 0
    found, scores = ann.Tree.unpack(tree.pack()).search(ids[q], x[q], 5)
    want = brute(ids, x, 7, 5)
    assert [(int(i), r + 1, int(found[n, r]), scores[n, r]) for n, i in enumerate(ids[q]) for r in range(5)] == want
    recalls = [np.mean([len({*a} & {*b}) / 5 for a, b in zip(tree.search(ids[q], x[q], 5, factor=f)[0], found)]) for f in (1.0, 1.1, 3.0)]
    assert recalls[0] == 1 and recalls[0] >= recalls[1] >= recalls[2] - 0.05
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    assert rows_of(ann.search(df, 7, 5, shard_rows=90, block_rows=30)) == want


def test_rows_that_take_no_part_repeats_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [9.0, 9.0]), (8, []), (9, [-1.0, 3.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    assert rows_of(ann.search(df, 20, 20)) == [(0, 1, 1, 2.0), (0, 2, 1, 2.0), (0, 3, 9, -1.0)]
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(df.filter("vec_id = 0")).count() == 0
