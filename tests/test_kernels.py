import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.functions import kernels as k
from credence.functions import text as t
from credence.operators import clustering, tail


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_vectors_and_distances(spark):
    r = one(spark, k.dot(arr(1, 2, 3), arr(4, 5)), k.norm(arr(3, 4)), k.normalise(arr(0, 0)), k.bhattacharyya(arr(0), arr(0.2), arr(1), arr(0.8)), k.bhattacharyya(arr(1), arr(0.5), arr(1), arr(0.5)))
    assert r.c0 == 14 and r.c1 == 5 and r.c2 == [0, 0]
    assert r.c3 == pytest.approx(1 / 0.5 / 8 + 0.5 * math.log(0.5 / 0.4), abs=1e-5) and r.c4 == pytest.approx(0, abs=1e-9)


def test_sigma_rules(spark):
    L = F.lit
    r = one(spark, k.kalman_sigma(L(0.4), L(0.3)), k.sharpen(L(0.5)), k.sharpen(L(0.16), None, L(50)), k.sharpen(L(0.3), None, L(3)), k.sharpen(L(1.4), L(True)), k.initial_sigma(L(0.7)), k.initial_sigma(L(0.71)), k.initial_sigma(L(0.4)), k.decay(L(0.5)))
    assert [round(x, 4) for x in r] == [0.1714, 0.425, 0.15, 0.35, 1.5, 0.375, 0.25, 0.5, 0.52]
    mu, sig = k.kalman(arr(0, 2), arr(0.5, 0.5), arr(1, 2), arr(0.5, 0.5))
    r = one(spark, mu, sig, k.same_mean_distance(L(0.5), L(0.5), 768))
    assert r.c0 == [0.5, 2] and r.c1 == [0.25, 0.25] and r.c2 == pytest.approx(0)


def test_scores(spark):
    L = F.lit
    r = one(spark, k.distributional_score(L(1.0), L(0.4), L(0.4)), k.distributional_score(L(0.9), L(0.4), L(0.0)), k.distributional_score(L(-0.5), L(0.4), L(0.4)), k.distributional_score(L(0.0), L(0.4), L(0.4)), k.distributional_score(L(float("nan")), L(0.4), L(0.4)))
    assert r.c0 == 1 and r.c1 == 0.5 and r.c2 == r.c3 and r.c4 == 0.5
    assert k.query_sigma("", 0) == pytest.approx(0.35) and k.query_sigma("x" * 900, 0) == 0.8 and k.pool_size(8, 0.2) == 32
    assert k.unpack_sigma([k.pack_sigma([0.5, 0.25]), "???", None]) == [[0.5, 0.25], [1.0], [1.0]]


def test_texts(spark):
    L = F.lit
    secrets = ["Bearer abcdefghijkl", "AKIA" + "A" * 16, "https://me:pw@host/x", "MY_TOKEN = 'abc'", "ghp_" + "a" * 20, "--password hunter2", "X-Api-Key: 123456789", "sk-" + "a" * 20]
    r = one(spark, *[t.redact(L(x)) for x in secrets])
    assert all("[REDACTED]" in x for x in r)
    assert one(spark, t.redact(L("a plain sentence about tokens"))).c0 == "a plain sentence about tokens"
    says = {"it is fixed": True, "not yet fixed": False, "isn't really fixed": False, "never fixed but now works": True, "was resolved": True, "prefixed": False}
    r = one(spark, *[t.resolved(L(x)) for x in says])
    assert list(r) == list(says.values())
    c = lambda new, old, cos: t.contradicts(L(new), L(old), L(cos))
    r = one(spark, c("switched from x", "uses x", 0.88), c("switched from x", "uses x", 0.87), c("now works", "still broken", 0.75), c("now works", "still broken", 0.74), c("not fixed", "not fixed", 0.95))
    assert list(r) == [True, False, True, False, False]
    r = one(spark, t.low_signal(L("yeah ok then whatever it is")), t.low_signal(L("short")), t.low_signal(L("Prefers tabs over spaces in all code")), t.exact_key(L("Fixed,  Bug!")), t.slug(L("My App 2!")), t.slug(L("-")), t.keywords(L("The alphabet soup with letters: soup")))
    assert list(r) == [True, True, False, "fixed bug", "my-app-2", None, ["alphabet", "letters", "soup"]]
    assert t.temporal_cue("what did we do Last Week?") == 12 and t.temporal_cue("nothing") is None


def row(i, score, sigma=0.5, type_="episodic", cluster=None, vector=(), text="", contradiction=False):
    return {"id": i, "score": score, "sigma": sigma, "type": type_, "cluster_id": cluster, "vector": list(vector), "text": text, "contradiction": contradiction, "primary_score": score}


def test_tail_folds():
    rows = [row(1, 1, vector=[1, 0]), row(2, 0.9, vector=[0.99, 0.01]), row(3, 0.8, text="alpha beta gamma delta"), row(4, 0.7, text="alpha beta gamma delta")]
    assert [r["id"] for r in tail.dedup(rows)] == [1, 3]
    assert [r["id"] for r in tail.sigma_gate([row(i, 1, s) for i, s in enumerate([0.2, 0.3, 0.9, 1.0])], 0.1)] == [0, 1]
    assert [r["id"] for r in tail.sigma_gate([row(i, 1, s) for i, s in enumerate([0.9, 0.95, 1.0])], 0.1)] == [0, 1]
    capped = tail.diversity_cap([row(1, 1, cluster="a"), row(2, 1, cluster="a"), row(3, 1, cluster="a"), row(4, 1, cluster="a"), *[row(10 + i, 1, type_="session") for i in range(4)]], exempt={4})
    assert [r["id"] for r in capped] == [1, 2, 3, 4, 10, 11]
    assert [r["id"] for r in tail.in_bands([row(1, 1.0, 0.9), row(2, 0.97, 0.2), row(3, 0.9, 0.1)])] == [2, 1, 3]
    assert tail.sharp_exempt([row(1, 1, 0.3), row(2, 0.95, 0.2), row(3, 0.91, 0.1), row(4, 0.2, 0.1)]) == {1, 2}


def test_clustering_is_deterministic_and_monotone():
    rng = np.random.default_rng(42)
    base = np.eye(8)[:3]
    x = np.concatenate([b + rng.uniform(-0.075, 0.075, (20, 8)) for b in base])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own, sums, counts = clustering.leaders(x, 0.85)
    assert counts.sum() == 60 and len(counts) == 3
    trace = clustering.merge_trace(x, np.ones(60, np.int64), 0.0)
    n = [60 - sum(s >= t for *_, s in trace) for t in (0.95, 0.8, 0.5, 0.0)]
    assert n == sorted(n, reverse=True)
    assert len(set(clustering.labels_at(60, trace, 0.5))) == 3
    final = clustering.finalise(sums, counts, np.arange(3), most=2)
    assert set(final) <= {-1, 0, 1}
