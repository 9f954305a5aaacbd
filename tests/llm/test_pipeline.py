import sys
from pathlib import Path

import pytest
from tokenizers import Tokenizer

from credence.llm import queries

sys.path.insert(0, str(Path(__file__).parent))
import test_jaccard  # noqa: E402
import test_lines  # noqa: E402
import test_packing  # noqa: E402
import test_quality  # noqa: E402

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def good(text):
    n, chars, symbols, _, _, rep = test_quality.brute(text)
    return n >= 50 and 100 * rep <= 50 * n and 10 * symbols <= n and 2 * chars >= 5 * n and chars <= 12 * n


def test_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if name == "packing":
            assert test_packing.check(out.collect(), rows, Tokenizer.from_file(queries.WORD_BPE)) < 0.05
            break
        assert sorted(out.columns) == sorted(columns)
        left = {r.doc_id: r for r in out.collect()}
        if name == "quality rules":
            assert set(left) == {i for i, t in rows.items() if good(t)}
        elif name == "line dedup":
            kept_of = test_lines.brute(list(rows.items()))
            want = {}
            for i, t in rows.items():
                kept = [x for at, x in enumerate(t.split("\n")) if kept_of.get((i, at), (i, at)) == (i, at)]
                if any(x.strip() for x in kept):
                    want[i] = "\n".join(kept)
            assert set(want) <= set(left)
            same = sum(left[i].text == want.get(i) for i in left)
            assert same >= 0.97 * len(left) and all(r.n_chars == len(r.text) for r in left.values())
        else:
            assert set(left) == {c for _, _, c in test_jaccard.brute(list(rows.items()))}
        docs = out


def test_run_returns_packed_pieces(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
