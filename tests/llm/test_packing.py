import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from credence.llm import packing, queries


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.WORD_BPE)


def test_ids_agree_with_the_library(library):
    rng = random.Random(1)
    texts = [
        None, "", " ", "It's WE'LL Éa É ́x  y", "a<|endoftext|>B <|startoftext|>", "x\x1cy \x1f z", "1234 5六 七", "ΑΣ Σ ΣΑΣ. İI", " a b\x85c　d",
        *["".join(rng.choices(" \n\tabcDEF.,'é́ß日0🎉\xa0", k=rng.randint(0, 200))) for _ in range(400)],
    ]
    for text, ids in zip(texts, packing.WordIds(queries.WORD_BPE).encode_batch(texts), strict=True):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_words_of_one_pre_token_are_encoded_by_the_model_alone(library):
    rng = random.Random(3)
    plain = ["The", "Ça", "STRAßE", "naïve.", "x***", "it's", "don'T!", "a1b22", "\x00q\x7f", "<a|>", "à·b"]
    odd = ["<|x", "a<|endoftext|>b", "é́", "µm", "日本", "İx", "ﬁn"]
    texts = [" ".join(plain), " ".join(odd)]
    texts += [" ".join("".join(rng.choices("abzAZ09'#*.,stremlvdÀÿßé\x01\x7f", k=rng.randint(1, 12))) for _ in range(50)) for _ in range(200)]
    coder = packing.WordIds(queries.WORD_BPE)
    for text, ids in zip(texts, coder.encode_batch(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    asked: list[str] = []

    class Library:
        def encode_batch_fast(self, words, **kw):
            asked.extend(words)
            return library.encode_batch_fast(words, **kw)

    coder.forget()
    coder.library = Library()
    list(coder.encode_batch([texts[0]]))
    assert asked == ["à·b"]


def test_workers_that_wait_hold_no_pool(spark):
    from credence.llm import bpe

    docs = spark.range(64).repartition(8).selectExpr("id AS doc_id", "concat_ws(' ', 'word', 'x' || id) AS text")
    assert packing.token_pieces(docs, queries.WORD_BPE).count() == 64
    assert bpe.encode_decode(docs, queries.BYTE_BPE).count() == 64

    def held(batches):
        for batch in batches:
            yield batch.assign(id=len(packing.word_ids(queries.WORD_BPE).number) + len(bpe.encoder(queries.BYTE_BPE).pool))

    assert spark.range(8).repartition(8).mapInPandas(held, "id long").agg({"id": "max"}).first()[0] == 0


def test_tree_places_as_plain_first_fit_does():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 300):
        sizes = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        free: list[int] = []
        for i in np.argsort(-sizes, kind="stable"):
            k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
            if k == len(free):
                free.append(100)
            assert (bins[i], offsets[i]) == (k, 100 - free[k])
            free[k] -= sizes[i]


def check(rows, texts, library, capacity=2048):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += capacity - at
    return padding / sum(r.length for r in rows)


def test_query_over_the_smallest_tables(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert check(queries.op7_first_fit_decreasing(spark, "/root/testdata/sf0.001").collect(), texts, library) < 0.02


def test_nulls_repeats_groups_and_sequences(spark, library):
    rows = [(None, None), (3, ""), (4, "a b"), *[(9, "word " * 50)] * 40]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    packed = packing.pack(packing.token_pieces(df, queries.WORD_BPE, 64, with_ids=True), 64, group=7)
    assert packed.count() == len(rows)
    made = packing.sequences(packed).collect()
    assert sum(s.length for s in made) == sum(len(library.encode(t or "").ids) + 1 for _, t in rows) and max(s.length for s in made) <= 64
    assert packing.pack_documents(df.limit(0), queries.WORD_BPE).count() == 0


def test_large_ids_next_to_null_ids_stay_whole(spark):
    rows = [(2**53 + 1, "a b"), (None, "a"), (2**62 + 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in packing.pack_documents(df, queries.WORD_BPE).collect()} == {2**53 + 1, None, 2**62 + 3}
