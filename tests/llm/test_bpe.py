import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from credence.llm import bpe, queries

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "a\n\n\nb   c\t d", "it's we'll I'd 'S", "été ÉÈ naïve ǅ ß",
    "日本語のテキスト 中文", "🎉🎉 ok", "x<|endoftext|>y <|endoftext|><|endoftext|> z", "<|endoftext|>", "aaaaaaaaaaaaaaaa" * 9, "١٢٣ 45 6x7",
    "a b  c d", "foo.bar, (baz);", "...!!! ??", "é ́", "\x1c\x1d \x85", "0" * 999, "tab\tnewline\r\n  end  ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.BYTE_BPE)


def test_ids_and_texts_agree_with_the_library(library):
    rng = random.Random(5)
    letters = " \n\tabcdefghij.,'éß日🎉0123"
    texts = TEXTS + ["".join(rng.choices(letters, k=rng.randint(0, 300))) for _ in range(400)]
    coder = bpe.PairIndexBPE(queries.BYTE_BPE)
    for few in (bpe.FEW, 0, 10**9):  # array operations and single merges both
        coder.forget()
        saved, bpe.FEW = bpe.FEW, few
        try:
            got = coder.encode_batch(texts)
        finally:
            bpe.FEW = saved
        for text, ids in zip(texts, got):
            assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, text
            assert coder.decode(ids) == (text or "") == library.decode(ids.tolist(), skip_special_tokens=False)


def test_decoding_any_ids(library):
    coder = bpe.encoder(queries.BYTE_BPE)
    rng = np.random.default_rng(3)
    for _ in range(200):
        ids = rng.integers(0, 50257, 12)
        assert coder.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_pool_is_emptied_without_changing_results(library, monkeypatch):
    monkeypatch.setattr(bpe, "POOL", 50)
    monkeypatch.setattr(bpe, "BLOCK", 300)
    coder = bpe.PairIndexBPE(queries.BYTE_BPE)
    texts = [f"word{i} other{i * 7} the end." for i in range(100)] + [None]
    assert [x.tolist() for x in coder.encode_batch(texts)] == [library.encode(t or "").ids for t in texts]


def test_query_over_the_smallest_tables(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op1_bpe_round_trip(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        text = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, None, "x"), (1, "two words", "y"), (1, "two words", "z")], "doc_id long, text string, n_tokens string")
    out = bpe.encode_decode(df, queries.BYTE_BPE, with_ids=True)
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in out.collect()) == [(0, 0, ""), (1, 2, "two words"), (1, 2, "two words")]
    assert bpe.encode_decode(df.limit(0), queries.BYTE_BPE).count() == 0


def test_large_ids_next_to_null_ids_stay_whole(spark):
    rows = [(2**53 + 1, "a b"), (None, "a"), (2**62 + 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in bpe.encode_decode(df, queries.BYTE_BPE).collect()} == {2**53 + 1, None, 2**62 + 3}
