import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.functions import text
from credence.operators import similarity

NOTES = ["the deploy script is still broken", "the deploy script works now", "we use the old queue", "we no longer use the old queue", None, "it works now but the other one is still broken"]


@pytest.fixture(scope="module")
def rows(spark):
    """Two groups; copies, vectors of floats, a null vector, a null group, a repeated row, a null text."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 4)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[40:60] = x[3]
    data = [(i, "ab"[i % 3 == 0], [*map(float, v)], NOTES[i % len(NOTES)], int(i * 7 % 11)) for i, v in enumerate(x)]
    data += [data[5], (200, "a", None, NOTES[0], 0), (201, None, data[4][2], NOTES[0], 0)]
    return spark.createDataFrame(data, "id long, g string, embedding array<float>, text string, place long").cache()


def brute(rows, meets):
    held = [r for r in rows.collect() if r.embedding is not None and r.g is not None]
    dot = lambda r, s: round(sum(x * y for x, y in zip(r.embedding, s.embedding)), 6)
    return [(r, s, dot(r, s)) for r in held for s in held if r.g == s.g and r.id != s.id and meets(r, s, dot(r, s))]


@pytest.mark.parametrize("block", [7, 4096])
def test_blocks_find_what_brute_force_finds(rows, block):
    every = brute(rows, lambda r, s, c: c > 0.6)
    assert sorted((r.a, r.b) for r in similarity.theta_pairs(rows, "g", 0.6, block).collect()) == sorted((r.id, s.id) for r, s, _ in every if r.id < s.id)
    assert sorted((r.a, r.b) for r in similarity.cross_pairs(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), "g", 0.6, block).collect()) == sorted((r.id, s.id) for r, s, _ in every if r.id % 2 == 0 and s.id % 2 == 1)
    later = {r.id for r, s, c in brute(rows, lambda r, s, c: c >= 0.9) if (s.place, s.id) > (r.place, r.id)}
    assert {r.id for r in similarity.with_later(rows, "g", "place", 0.9, block).collect()} == later
    once = rows.dropDuplicates(["id"])
    best = {}
    for r, s, c in sorted(brute(once, lambda r, s, c: True), key=lambda p: (p[0].id, -p[2], p[1].id)):
        best.setdefault(r.id, []).append(s.id)
    found = sorted((r.id, r["rank"], r.other) for r in similarity.knn(once, "g", 3, block=block).collect())
    assert found == [(i, n + 1, s) for i, o in sorted(best.items()) for n, s in enumerate(o[:3])]


@pytest.mark.parametrize("block", [7, 4096])
def test_links_have_the_components_of_all_pairs(rows, block):
    whole = {r.id: r.root for r in similarity.connected(similarity.theta_pairs(rows, "g", 0.93, block)).collect()}
    assert len(set(whole.values())) > 2
    assert {r.id: r.root for r in similarity.connected(similarity.theta_links(rows, "g", 0.93, block)).collect()} == whole


def test_copies_send_no_more_links_than_rows(spark):
    copies = spark.range(400).select("id", F.lit("g").alias("g"), F.array(F.lit(0.6), F.lit(0.8)).alias("embedding"))
    assert similarity.theta_links(copies, "g", 0.9).count() == 399


@pytest.mark.parametrize("block", [7, 4096])
def test_contradictions_are_found_while_pairs_are_made(rows, block):
    side = lambda c: rows.dropDuplicates(["id"]).select(F.col("id").alias(c), F.col("text").alias(f"t{c}"))
    both = similarity.theta_pairs(rows, "g", 0.1, block).join(side("a"), "a").join(side("b"), "b")
    expected = sorted((r.a, r.b) for r in both.filter(text.contradicts(F.col("ta"), F.col("tb"), F.col("cos"), 0.5, 0.3)).collect())
    found = similarity.theta_pairs(rows, "g", 0.1, block, text.stance(F.col("text")), text.stance_floors(0.5, 0.3))
    assert expected and sorted((r.a, r.b) for r in found.collect()) == expected


def test_contradiction_pairs_joins_no_texts_to_pairs(spark):
    """The pairs that are merely alike never leave the tasks that make them."""
    from credence.plans import catalogue

    assert ".join(" not in inspect.getsource(catalogue.contradiction_pairs)


def test_vectors_arrive_in_rows_of_their_own_size(spark):
    """No row that a Python task is sent holds a whole block, so a batch stays small however many blocks a group has."""
    rows = spark.range(3000).select("id", F.lit("g").alias("g"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda d: F.sin(F.col("id") * d)).alias("embedding"))
    plan = similarity.theta_pairs(rows, "g", 0.9, 512)._jdf.queryExecution().analyzed().toString()
    assert "binary" not in plan and "ids2" not in plan


def test_ragged_vectors_are_an_error(spark):
    rows = spark.createDataFrame([(1, "g", [1.0, 0.0]), (2, "g", [1.0])], "id long, g string, embedding array<double>")
    with pytest.raises(Exception, match="different lengths"):
        similarity.theta_pairs(rows, "g", 0.5).collect()
