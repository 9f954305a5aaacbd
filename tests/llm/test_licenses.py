import re

from credence.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def base(text):
    words = WORD.findall((text or "").translate(UPPER))
    places = [(i, label) for p, label in licenses.PHRASES.items() for n in [len(p.split())] for i in range(len(words)) if words[i : i + n] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    None, "", "x", "Under the MIT License", "under the mit licence", "CC-BY-NC cc by nc CC_BY_NC by cc by nc nc", "Apache License, Version 2.0 apache license version 20",
    "under the mit under the mit license license", "UNDER\nTHE\tMIT--LICENSE; K cc bY nc", "écc by nc cc by ncé", "cc by cc by nc", "cc by nc " * 400,
    "This work is licensed under the GNU General Public License, version 3.",
    "This work is hereby licensed under the GNU General Public License, version 3",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation files",
]


def test_places_agree_with_brute_force_and_notices_add_labels(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumnRenamed("text", "text")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1
    assert got[12].labels == "gpl-3" and got[12].score == 1 and got[12].base_labels == ""
    assert got[13].labels == "gpl-3" and got[13].score < 1
    assert got[14].labels == "mit" and got[0].labels == "" and got[0].score == 0


def test_repeats_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "cc by nc", 1), (None, "cc by nc", 1), (5, "none", 2)], "doc_id long, text string, row int")
    assert sorted((r.doc_id or 0, r.n_base) for r in licenses.scan(df).collect()) == [(0, 1), (0, 1), (5, 0)]
    assert licenses.scan(df.limit(0)).count() == 0


def test_query_over_the_smallest_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op2_license_diagonals(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for d in rows:
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(d.text)
