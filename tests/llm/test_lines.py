import random
import re

from pyspark.sql import functions as F

from credence.llm import lines, queries

WORD = re.compile(r"[^\x20\x09-\x0D]")


def brute(rows, threshold=lines.THRESHOLD):
    """Components of all lines with a word: {(doc, at): smallest place}."""
    places = [(doc, at, line) for doc, text in rows for at, line in enumerate((text or "").split("\n")) if text is not None and WORD.search(line)]
    sets = [{line[i : i + 9] for i in range(max(1, len(line) - 8))} for _, _, line in places]
    parent = list(range(len(places)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(places)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) < threshold * max(len(sets[i]), len(sets[j])):
                continue
            both = len(sets[i] & sets[j])
            if both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, at, _) in enumerate(places):
        least[root(i)] = min(least.get(root(i), (doc, at)), (doc, at))
    return {(doc, at): least[root(i)] for i, (doc, at, _) in enumerate(places)}


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéßo", k=rng.randint(2, 9))) for _ in range(900)]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 6, 10, 25, 60]))) for _ in range(120)]
    rows = []
    for doc in range(130):
        out = []
        for _ in range(rng.randint(1, 4)):
            line = rng.choice(base) if rng.random() < 0.5 else " ".join(rng.choices(words, k=rng.randint(1, 30)))
            if rng.random() < 0.4 and len(line) > 20:
                for _ in range(rng.randint(1, max(1, len(line) // 90))):
                    at = rng.randrange(len(line))
                    line = line[:at] + rng.choice(["x", "", "qq "]) + line[at + 1 :]
            out.append(line)
        rows.append((doc, "\n".join(out)))
    return rows


def test_finds_what_brute_force_finds(spark):
    rows = corpus() + [(900, None), (901, ""), (902, " \n\n \t"), (903, "a\nb\na"), (904, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    found = lines.line_classes(df).collect()
    assert {(r.doc_id, r.at) for r in found} == set(want)
    first = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.at)):
        first.setdefault(r.component, (r.doc_id, r.at))
    got = {(r.doc_id, r.at): first[r.component] for r in found}
    assert {(r.doc_id, r.at) for r in found if r.kept} == set(first.values())
    dropped, right = ({p for p, k in x.items() if p != k} for x in (got, want))
    assert dropped <= right and len(dropped) >= 0.97 * len(right) and len(right) > 60


def test_documents_keep_order_and_columns(spark):
    rows = [(1, "one two three\nfour five six\n\nseven", "x"), (2, "FOUR\nfour five six", "y"), (2, "four five six", "z"), (3, None, "n"), (4, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    out = lines.drop_lines(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[0], (2, "FOUR", "y"), rows[3], rows[4]], key=str)
    assert lines.drop_lines(df.limit(0)).count() == 0


def test_query_over_the_smallest_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    got = queries.op5_fuzzy_lines(spark, "/root/testdata/sf0.001")
    kept = {(r.doc_id, r.line_no) for r in got.filter(F.col("kept")).collect()}
    right = {k for k in want if want[k] == k}
    assert right <= kept and len(kept - right) <= 0.03 * (len(want) - len(right)) and got.count() == len(want)


def found_together(spark, pairs):
    """Which of the pairs of lines share a bucket."""
    df = spark.createDataFrame([(i, side, line) for i, pair in enumerate(pairs) for side, line in enumerate(pair)], "i long, side int, line string")
    x, y = (lines.signatures(df.filter(F.col("side") == k), ["i"]).withColumnRenamed("bands", f"b{k}") for k in (0, 1))
    return [r.found for r in x.join(y, "i").select("i", F.arrays_overlap("b0", "b1").alias("found")).orderBy("i").collect()]


def near_pairs(rng, make, n):
    """``n`` pairs of different lines that are duplicates: ``make`` gives a line, some of its last or first letters are replaced."""
    shingles = lambda x: {x[i : i + 9] for i in range(max(1, len(x) - 8))}
    out = []
    while len(out) < n:
        x = make()
        k = rng.randint(1, max(1, len(x) // 8))
        new = "".join(rng.choices("abcdefgh", k=k))
        y = x[:-k] + new if rng.random() < 0.5 else new + x[k:]
        a, b = shingles(x), shingles(y)
        if x != y and len(a & b) >= lines.THRESHOLD * len(a | b):
            out.append((x, y))
    return out


def test_lines_of_few_long_words_are_found(spark):
    rng = random.Random(2)
    for words in (1, 2, 3):
        pairs = near_pairs(rng, lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(40, 60))) for _ in range(words)), 150)
        assert sum(found_together(spark, pairs)) >= 0.97 * len(pairs)


def test_short_lines_are_found(spark):
    rng = random.Random(4)
    for n in (16, 17, 25, 40):
        pairs = near_pairs(rng, lambda: "".join(rng.choices("abcdefghij klmnop", k=n)), 200)
        assert sum(found_together(spark, pairs)) >= 0.97 * len(pairs)


def edited_pairs(rng, make, letters, n=200):
    """``n`` pairs of different lines at the threshold or above: some letters, at any place, are replaced."""
    shingles = lambda x: {x[i : i + 9] for i in range(max(1, len(x) - 8))}
    out = []
    for _ in range(100_000):
        x = make()
        y = list(x)
        for _ in range(rng.randint(1, max(1, len(x) // 60))):
            at = rng.choice([rng.randrange(len(y)), len(y) - 1, 0])
            y[at] = rng.choice(letters)
        y = "".join(y)
        a, b = shingles(x), shingles(y)
        if x != y and len(a & b) >= lines.THRESHOLD * len(a | b):
            out.append((x, y))
            if len(out) == n:
                break
    return out


def test_every_kind_of_line_is_found(spark):
    rng = random.Random(6)
    latin, thai, han = "abcdefghijklmnoprstuvwy", "".join(map(chr, range(0x0E01, 0x0E2F))), "".join(map(chr, range(0x4E00, 0x4F00)))
    word = lambda: "".join(rng.choices(latin, k=rng.randint(3, 8)))
    kinds = {f"{n} words": (lambda n=n: " ".join(word() for _ in range(n)), latin) for n in (2, 3, 7, 8, 10, 20, 100)}
    kinds |= {"address": (lambda: "https://" + "/".join(word() for _ in range(18)), latin), "Thai": (lambda: "".join(rng.choices(thai, k=100)), thai), "Han": (lambda: "".join(rng.choices(han, k=80)), han)}
    for kind, (make, letters) in kinds.items():
        pairs = edited_pairs(rng, make, letters)
        assert len(pairs) == 200 and sum(found_together(spark, pairs)) >= 0.95 * len(pairs), kind


def test_rows_keep_their_place_when_the_executors_change(spark, tmp_path, monkeypatch):
    rows = corpus(3)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    want = {(r.doc_id, r.at): r.kept for r in lines.line_classes(docs).collect()}
    step = iter(range(1000))
    materialise = lines.materialise

    def other_parallelism(df, name):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", 1 + next(step) % 5)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        return materialise(df, name)

    monkeypatch.setattr(lines, "materialise", other_parallelism)
    try:
        out = lines.line_classes(docs)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", 7)
        assert {(r.doc_id, r.at): r.kept for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_very_long_line_and_clashing_names(spark):
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefgh ", k=600_000))
    rows = [(1, long, "a", 1), (2, long[:300_000] + "Q" + long[300_001:], "b", 2), (3, "x", "c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line string, at int")
    assert sorted(r.doc_id for r in lines.drop_lines(df).collect()) == [1, 3]


def test_members_of_a_bucket_that_its_star_does_not_join_are_linked(spark):
    from credence.llm.components import bucket_links

    n = 300
    members = spark.createDataFrame([(7, i, 0, n) for i in range(n)] + [(8, i, 0, 3) for i in (0, 5, 6)], "bucket long, class long, star long, n long")
    seen = []

    def verify(pairs):
        seen.extend((r.a, r.b) for r in pairs.collect())
        return pairs.filter((F.col("a") % 10 == F.col("b") % 10) & (F.col("a") > 0))

    links = bucket_links(members, verify)
    joined = {(r.a, r.b) for r in links.collect()}
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in joined:
        parent[root(a)] = root(b)
    assert len({root(i) for i in range(1, n)}) == 10 and root(0) == 0
    assert len(seen) <= len(set(seen)) + 3 and not any(a == b for a, b in seen)  # the other bucket may repeat its three pairs


def test_unlike_copies_of_one_line_do_not_become_pairs(spark, monkeypatch):
    from credence.llm import components

    rng = random.Random(12)
    base = "".join(rng.choices("abcdefghij klmnop", k=450))
    rows = []
    for doc in range(160):
        line = list(base)
        for at in rng.sample(range(0, 441, 9), 7):  # about 60 shingles are lost
            line[at : at + 2] = rng.choices("qrstuvwxyz", k=2)
        rows.append((doc, "".join(line)))
    rows += [(1000 + doc, text[:-3] + "XYZ") for doc, text in rows[:40]]
    made, materialise = [], components.materialise

    def counted(df, name):
        out = materialise(df, name)
        made.append(out.count() if name == "pairs" else 0)
        return out

    monkeypatch.setattr(components, "materialise", counted)
    want, found = brute(rows), lines.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.at) for r in found if r.kept} == set(want.values()) and 100 < len(set(want.values())) <= 160
    assert sum(made) < 0.2 * len(rows) ** 2 / 2


def test_chunks_hold_every_shingle_and_no_other(spark):
    rng = random.Random(14)
    rows = [(n, "".join(rng.choices("abcdefghéß😀 ", k=n))) for n in (1, 8, 9, 10, 23, 24, 25, 40, 41, 135, 136, 137, 519, 520, 521, 522, 535, 536, 1032, 1033, 1100)]
    df = spark.createDataFrame(rows, "n long, line string")
    hashed = lines.chunks_of(df, ["n"], "line").select("n", F.explode(F.array(*[f"h{k}" for k in range(lines.CHUNK)])).alias("h"))
    got = {r.n: r.hs for r in hashed.groupBy("n").agg(F.array_sort(F.collect_set("h")).alias("hs")).collect()}
    parts = [(n, x) for n, line in rows for x in {line[i : i + 9] for i in range(max(1, n - 8))}]
    shingles = spark.createDataFrame(parts, "n long, x string").withColumn("h", F.xxhash64(F.encode("x", "UTF-32")))
    assert got == {r.n: r.hs for r in shingles.groupBy("n").agg(F.array_sort(F.collect_set("h")).alias("hs")).collect()}


def test_only_members_of_buckets_that_stars_leave_open_get_sketches(spark, monkeypatch):
    rng = random.Random(15)
    base = ["".join(rng.choices("abcdefghij klmnop", k=300)) for _ in range(20)]
    rows = [(2 * i + k, line[: len(line) - k] + "X" * k) for i, line in enumerate(base) for k in (0, 1)]
    made, materialise = [], lines.materialise
    monkeypatch.setattr(lines, "materialise", lambda df, name: made.append(name) or materialise(df, name))
    found = lines.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in found if r.kept) == list(range(0, 40, 2))
    assert "signatures" in made and "sketches" not in made


def test_equal_lines_are_signed_once_and_documents_are_cut_into_lines_twice(spark, monkeypatch):
    rng = random.Random(16)
    base = ["".join(rng.choices("abcdefghij klmnop", k=200)) for _ in range(10)]
    rows = [(doc, "\n".join(rng.sample(base, 4))) for doc in range(50)]
    signed, signatures, plans, materialise = [], lines.signatures, [], lines.materialise

    def counted(table, keys, line="line"):
        signed.append(table.count())
        return signatures(table, keys, line)

    def explained(df, name):
        plans.append("posexplode" in df._jdf.queryExecution().optimizedPlan().toString())
        return materialise(df, name)

    monkeypatch.setattr(lines, "signatures", counted)
    monkeypatch.setattr(lines, "materialise", explained)
    out = lines.line_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert signed == [10] and sum(plans) == 1  # and once in the result
    assert out.count() == 200 and out.filter("kept").count() == 10


def test_members_are_dealt_to_their_buckets_once(spark, monkeypatch):
    plans, materialise = [], lines.materialise

    def planned(df, name):
        if name == "shared":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df, name)

    monkeypatch.setattr(lines, "materialise", planned)
    rows = [(doc, f"line {doc % 3} of the documents") for doc in range(6)]
    found = lines.line_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(plans) == 1 and "partial_count" in plans[0] and "ENSURE_REQUIREMENTS" not in plans[0]
    assert found.count() == 6
