import random
import re

import numpy as np
from pyspark.sql import functions as F

from credence.llm import jaccard, queries
from credence.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(i, j) for h in holders.values() for i in h for j in h if i < j}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows))


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def corpus(seed, n, lengths):
    """Documents with edited copies on both sides of the threshold, chains and shared passages."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(5000)]
    passage = rng.choices(vocab, k=30)
    rows = [(0, None), (1, ""), (2, " \n "), (3, "A b"), (4, "a  B"), (5, "a b c"), (6, "éa É"), (7, "éa é")]
    while len(rows) < n:
        base = rng.choices(vocab, k=rng.choice(lengths))
        if rng.random() < 0.3:
            base[len(base) // 2 : len(base) // 2] = passage
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 18))):
                at = rng.randrange(len(copy))
                if rng.random() < 0.5:
                    copy[at] = rng.choice(vocab)
                elif len(copy) > 1:
                    del copy[at]
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
            if rng.random() < 0.4:
                base = copy
    return rows


def test_agrees_with_brute_force(spark):
    rows = corpus(1, 900, [5, 6, 7, 8, 9, 12, 15, 20, 30, 45, 60, 90, 130, 200, 400])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert len({c for _, _, c in want}) < 0.8 * len(rows)
    assert got(jaccard.similar_groups(df)) == want
    kept = sorted(r.doc_id for r in jaccard.keep_one(df).collect())
    assert kept == sorted({c for _, _, c in want})


def test_every_linked_pair_has_a_common_signature():
    rng = np.random.default_rng(3)
    for n in [*range(1, 60), 80, 150, 333, 900]:
        for _ in range(12):
            x = rng.integers(0, 1 << 63, n).astype(np.uint64)
            cut, add = rng.integers(0, n // 4 + 1), rng.integers(0, n // 3 + 1)
            y = np.concatenate([x[cut:], rng.integers(0, 1 << 63, add).astype(np.uint64)])
            both = n - cut
            if not len(y) or 100 * both < 75 * (n + add):
                continue
            sig, cls, role = jaccard.signatures([np.unique(x), np.unique(y)], np.array([1, 2]))
            looks = [{*sig[(cls == c) & (role & 2 > 0)].tolist()} for c in (1, 2)]
            found = [{*sig[(cls == c) & (role & 1 > 0)].tolist()} for c in (1, 2)]
            assert looks[0] & found[1] or looks[1] & found[0], (n, cut, add)


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    rows = [(None, None, 1), (None, "a b c", 2), (7, "a b c", 3), (7, "a b c", 3), (9, "x y", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.similar_groups(df).collect()) == [(0, 0, 0), (0, 1, 7), (7, 1, 7), (7, 1, 7), (9, 1, 9)]
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.row) for r in kept.collect()) == [(0, 1), (7, 3), (9, 4)]
    assert jaccard.similar_groups(df.limit(0)).count() == 0


def test_unlike_texts_under_null_or_repeated_ids_all_stay(spark):
    rows = [(None, "a b c", 1), (None, "d e f", 2), (None, "d e f", 3), (7, "g h i", 4), (7, "j k l", 5), (7, "g h i", 6), (8, "m n o", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at int").coalesce(1)
    assert sorted(r["at"] for r in jaccard.keep_one(df).collect()) == [1, 2, 4, 5, 7]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(50)] + [(300, 299), (299, 305), (305, 290)]
    df = spark.createDataFrame(edges, "a long, b long")
    roots = {r.node: r.root for r in components(df).collect()}
    assert roots == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 150), 100), **dict.fromkeys([290, 299, 300, 305], 290)}
    assert components(df.limit(0)).count() == 0


def test_query_over_the_smallest_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert got(queries.op6_jaccard_components(spark, "/root/testdata/sf0.001")) == brute(rows)


def test_word_hashes_tell_words_apart_wherever_they_stand():
    rng = random.Random(5)
    words = ["".join(rng.choices("abé\x00z", k=rng.randint(1, 6))) for _ in range(3000)] + ["x" * (jaccard._PIECE + 5), "a", "aa", "\x00", "\x00\x00"]
    blanks = [" ", "\t", "\n", "\r", "\x0b", "\x0c", "  "]
    text = "".join(w + rng.choice(blanks) for w in words)
    for raw in (text, " " + text, text * 40):
        got = jaccard.word_hashes(raw.encode())
        assert len(got) == len(raw.encode().split())
        named = {}
        for w, h in zip(raw.encode().split(), got.tolist()):
            assert named.setdefault(w, h) == h
        assert len(set(named.values())) == len(named)
    assert len(jaccard.word_hashes(b"")) == 0 and len(jaccard.word_hashes(b" \n ")) == 0


def test_sketches_rule_out_unlike_sets_and_no_linked_ones():
    rng = np.random.default_rng(8)
    passed = {}
    for n in (60, 130, 300, 330, 900, 5000):
        for like in (0.76, 0.64):
            sets = []
            for _ in range(150):
                x = rng.integers(0, 1 << 63, n).astype(np.uint64)
                both = int(np.ceil(2 * n * like / (1 + like)))
                sets.append((np.unique(x), np.unique(np.concatenate([x[:both], rng.integers(0, 1 << 63, n - both).astype(np.uint64)]))))
            sizes = np.full(len(sets), n)
            kept = jaccard.may_link(sizes, [jaccard.sketch_of(x) for x, _ in sets], sizes, [jaccard.sketch_of(y) for _, y in sets])
            passed[n, like] = kept.mean()
        small, large = np.unique(x[: n * 4 // 5]), np.unique(x)
        assert jaccard.may_link(np.array([len(small)]), [jaccard.sketch_of(small)], np.array([n]), [jaccard.sketch_of(large)]).all()
    assert all(v == 1 if like > 0.75 else n < 100 or v < 0.1 for (n, like), v in passed.items()), passed


def test_a_pair_of_many_buckets_is_handed_on_once_by_each_task(spark):
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64))] * 2
    classes = spark.createDataFrame([(c, len(s), bytearray(jaccard.sketch_of(s))) for c, s in enumerate(sets)], "class long, n long, sketch binary")
    rows = [(bucket, c, c, 2, False, True) for bucket in range(400) for c in (0, 1)]
    opened = spark.createDataFrame(rows, "bucket long, class long, root long, n long, was boolean, leads boolean")
    found = [(r.a, r.b) for r in jaccard.cross_pairs(opened, classes).collect()]
    assert set(found) == {(0, 1)} and len(found) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_pair_of_many_buckets_is_made_once_whatever_the_tasks(spark):
    rng = np.random.default_rng(10)
    base = np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64))
    sets = [base, base, base[:160], np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64))]
    classes = spark.createDataFrame([(c, len(s), bytearray(jaccard.sketch_of(s))) for c, s in enumerate(sets)], "class long, n long, sketch binary")
    before = [(bucket, 3, 3, 2, False, True) for bucket in range(-40, 0)]  # buckets that the pairs do not share fill the lists of one class
    rows = before + [(bucket, c, c, 4, False, True) for bucket in range(200) for c in range(4)]
    opened = spark.createDataFrame(rows, "bucket long, class long, root long, n long, was boolean, leads boolean")
    found = sorted((r.a, r.b) for r in jaccard.cross_pairs(opened, classes).collect())
    assert found == [(0, 1), (0, 2), (1, 2)]
    joined = opened.withColumn("root", F.least("class", F.lit(1)))  # 1, 2 and 3 are the commonest root
    assert sorted((r.a, r.b) for r in jaccard.cross_pairs(joined, classes).collect()) == [(0, 1), (0, 2)]


def test_a_pair_whose_first_buckets_are_not_shared_is_made(spark):
    sets = [np.arange(1, 201, dtype=np.uint64)] * 2
    classes = spark.createDataFrame([(c, len(s), bytearray(jaccard.sketch_of(s))) for c, s in enumerate(sets)], "class long, n long, sketch binary")
    alone = [(2 * bucket + c - 100, c, c, 2, False, True) for bucket in range(30) for c in (0, 1)]
    opened = spark.createDataFrame(alone + [(7, c, c, 2, False, True) for c in (0, 1)], "bucket long, class long, root long, n long, was boolean, leads boolean")
    assert [(r.a, r.b) for r in jaccard.cross_pairs(opened, classes).collect()] == [(0, 1)]


def test_rounds_make_the_sets_of_the_texts_once(spark, monkeypatch):
    from credence.llm import components

    rng = random.Random(21)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(40):
        text = list(base)
        for at in rng.sample(range(300), 11):  # too unlike the others, but not its own near copy
            text[at] = f"x{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text, "end"]))]
    made = []
    for module in (jaccard, components):
        monkeypatch.setattr(module, "materialise", lambda df, name, f=module.materialise: (made.append(name), f(df, name))[1])
    assert got(jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert made.count("pairs") > 1 and made.count("compared") == 1 and "close" not in made
