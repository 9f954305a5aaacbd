import hashlib

from credence.llm import queries, warc


def brute(rows, least=1000):
    last = {}
    for page, html in rows:
        raw = (html or "").encode()
        if len(raw) >= least:
            last[raw] = max(last.get(raw, -1), page)
    out = []
    for page, html in rows:
        raw = (html or "").encode()
        to = last.get(raw, page)
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to == page else "revisit", None if to == page else to))
    return sorted(out)


def rows_of(df):
    return sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_query_over_the_smallest_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    assert rows_of(queries.op4_warc_revisits(spark, "/root/testdata/sf0.001")) == brute([(p.page_id, p.html) for p in pages])


def test_copies_small_payloads_line_ends_and_nulls(spark):
    big, tricky = "é" * 600, "x\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n" * 40
    rows = [(i, big if i % 3 else None) for i in range(40)] + [(100, tricky), (101, tricky), (102, "small"), (103, "small"), (104, ""), (105, "y" * 999), (106, "y" * 999), (107, "z" * 1000), (108, "z" * 1000)]
    df = spark.createDataFrame([(i, None if i % 2 else f"http://a/{i} b\n", h, 0) for i, h in rows], "page_id long, url string, html string, row int")
    assert rows_of(warc.round_trip(df)) == brute(rows)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "u", "w" * 1500)] * 3 + [(None, None, "w" * 1500), (None, None, None)], "page_id long, url string, html string")
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.round_trip(df).collect())
    assert kinds == [(0, "response", 0), (0, "revisit", 1), (1, "response", 0), (1, "revisit", 1), (1, "revisit", 1)]
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archives_hold_each_large_payload_once(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "w" * 5000) for i in range(30)], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "a"))
    kinds = [r.type for r in warc.read_records(spark, str(tmp_path / "a"), with_payload=True).collect()]
    assert sorted(kinds) == ["response"] + ["revisit"] * 29
