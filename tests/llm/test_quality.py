import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from credence.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "a b c a b c", "x " * 60, "a\n a\na\n\n\na", "#*$ %&| <> ok", "é ü ü   z",
    "ab " * 3000, "line one is here\nline two\nline one is here\r\nline two", "w1 w2 w3 w4 w1 w2 w3 w9 w2 w3 w4",
]


def brute(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(lines), len(hit),
    )


@pytest.mark.parametrize("text", TEXTS)
def test_measures_agree_with_brute_force(text):
    assert quality.measure(text) == brute(text)


def test_query_over_the_smallest_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op9_quality_rules(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for d in docs:
        n, chars, symbols, dup, _, rep = brute(d.text)
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.base_failed and r.kept)


def test_nulls_repeats_clashing_names_and_ablation(spark):
    rows = [(None, None, 1), (1, "ok " * 2, 2), (1, "ok " * 2, 2), (2, " ".join(f"w{i}" for i in range(80)), 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    kept = quality.filter_documents(df)
    assert kept.columns == df.columns and [r.n_words for r in kept.collect()] == [3]
    entries = quality.ledger(df.select("doc_id", "text"))
    assert entries.count() == 4
    found = {r.rule: (r.n_failed, r.n_only_this) for r in quality.ablation(entries).collect()}
    assert found["few_words"] == (3, 1) and found["symbol_heavy"] == (0, 0)
    assert entries.filter(F.col("doc_id").isNull()).first().failures & quality.BITS["few_words"]
    assert quality.ledger(df.limit(0)).count() == 0
