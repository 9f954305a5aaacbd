import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from credence.llm import brown, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    docs = {i: (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1, [*WORD.findall((t or "").translate(LOW)), ""]) for i, t in rows}
    count = Counter(w for held, words in docs.values() if not held for w in words)
    n, v = sum(count.values()), len(count)
    return {i: (held, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for i, (held, w) in docs.items()}


def test_query_over_the_smallest_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    out = queries.op8_brown_classes(spark, "/root/testdata/sf0.001")
    got = {r.doc_id: r for r in out.collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for i, (held, n, known, total, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    for r in brown.perplexity(out).collect():
        assert 1 < r.perplexity < 0.7 * r.base_perplexity


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(0)
    groups = np.arange(40) % 4
    counts = np.zeros((42, 42))
    word = 2
    for _ in range(60_000):
        group = (groups[word - 2] + 1) % 4 if rng.random() < 0.95 else rng.integers(4)
        new = 2 + rng.choice(np.flatnonzero(groups == group))
        counts[word, new] += 1
        word = new
    found = brown.exchange(counts, 4, 20)[2:]
    assert all(len(set(found[groups == g])) == 1 for g in range(4)) and len(set(found)) == 4


def test_unknown_words_and_empty_texts_are_scored(spark):
    words = [f"w{i % 13}" for i in range(400)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 20])) for i in range(60)]
    probe = [(1000 + i, f"w{i}") for i in range(13)] + [(2000, "never"), (2001, "")]
    held = [i for i in range(3000, 90_000) if zlib.crc32(str(i).encode()) % 5 == 1]
    asked = [(held[k], t) for k, (_, t) in enumerate(probe)]
    df = spark.createDataFrame(rows + asked, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in brown.scores(df, core_words=5, n_classes=3).collect()}
    table = {t: got[i] for i, t in asked}
    assert table["never"].n_known == 1 and table[""].n_tokens == 1
    assert all(0 < 10**r.score < 1 for r in table.values())


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, None, 1), (3, "A a", 2), (3, "A a", 2), (4, "", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens) for r in brown.scores(df).collect())
    train = sum(n for i, n in ((None, 1), (3, 3), (3, 3), (4, 1)) if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1)
    assert [(g[0], g[1], g[3]) for g in got] == [(0, 1, train), (3, 3, train), (3, 3, train), (4, 1, train)]
    assert brown.scores(df.limit(0)).count() == 0


def brute_scores(rows, core_words, n_classes, rounds, weight=brown.WEIGHT):
    """The class model on dictionaries; only the exchange of the core is the operator's own."""
    docs = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1, [*WORD.findall((t or "").translate(LOW)), ""]) for i, t in rows]
    train = [w for _, held, w in docs if not held]
    count = Counter(w for words in train for w in words)
    n = sum(count.values())
    core = {"": 0} | {w: k + 2 for k, w in enumerate(sorted((w for w in count if w), key=lambda w: (-count[w], w))[:core_words])}
    size, width = len(core) + 1, n_classes + 2
    bigrams = np.zeros((size, size))
    for words in train:
        for x, y in zip(["", *words], words):
            bigrams[core.get(x, 1), core.get(y, 1)] += 1
    of_core = brown.exchange(bigrams, n_classes)
    cls = {w: of_core[k] for w, k in core.items()}
    for _ in range(rounds):
        table, left, right = np.zeros((width, width)), {}, {}
        for words in train:
            for x, y in zip(["", *words], words):
                a, b = cls.get(x, 1), cls.get(y, 1)
                table[a, b] += 1
                left.setdefault(y, np.zeros(width))[a] += 1
                right.setdefault(x, np.zeros(width))[b] += 1
        smooth = table + 0.1
        pull = np.log(smooth * smooth.sum() / np.outer(smooth.sum(1), smooth.sum(0)))
        new = {}
        for w in count:
            gain = left[w] @ pull + (right[w] @ pull.T if w else 0)
            gain[:2] = -np.inf
            new[w] = cls[w] if w in core else int(np.argmax(gain))
        cls = new
    follow = np.zeros((width + 1, width))
    for words in train:
        for x, y in zip(["", *words], words):
            follow[cls[x], cls[y]] += 1
    inside = follow.sum(0)
    transition = (follow + inside / max(inside.sum(), 1)) / (follow.sum(1, keepdims=True) + 1)
    unseen = (sum(c == 1 for c in count.values()) + 0.5) / (n + 1)
    out = []
    for i, _, words in docs:
        total = 0.0
        for x, y in zip(["", *words], words):
            if not count[y]:
                total += math.log10(unseen)
                continue
            p = weight * transition[cls[x] if count[x] else width, cls[y]] * count[y] / inside[cls[y]] + (1 - weight) * count[y] / n
            total += math.log10((1 - unseen) * p)
        out.append((i, total))
    return sorted(out)


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_scores_are_those_of_brute_force(spark, rounds):
    rng = np.random.default_rng(rounds)
    words = [f"{'abcdef'[k % 6]}{k}" for k in range(60)] + ["É", "é", "tie1", "tie2"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 40)).tolist())) for i in range(150)] + [(1000, None), (1001, ""), (1002, "A b\tA\x0bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted((r.doc_id, r.score) for r in brown.scores(df, core_words=12, n_classes=4, rounds=rounds).collect())
    want = brute_scores(rows, 12, 4, rounds)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-9)


def test_large_ids_next_to_null_ids_stay_whole(spark):
    rows = [(2**53 + 1, "a b"), (None, "a"), (2**62 + 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in brown.scores(df).collect()} == {2**53 + 1, None, 2**62 + 3}
