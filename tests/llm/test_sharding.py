import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from credence.llm import queries, sharding


def test_curve_visits_each_cell_once_and_moves_to_a_neighbour(spark):
    for dims, bits in ((2, 3), (3, 2), (3, 3)):
        side = 1 << bits
        cells = spark.range(side**dims).select(F.array(*[(F.floor(F.col("id") / side**d) % side).cast("int") for d in range(dims)]).alias("c"))
        rows = {r.h: r.c for r in cells.select("c", sharding.hilbert_index(F.col("c"), dims, bits).alias("h")).collect()}
        assert sorted(rows) == list(range(side**dims))
        for h in range(1, side**dims):
            assert sum(abs(a - b) for a, b in zip(rows[h], rows[h - 1])) == 1


def check(rows, texts, n):
    slots, seen = defaultdict(list), []
    for r in rows:
        slots[r.shard].append(r.slot)
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        seen.append(r.doc_id)
    assert sorted(seen) == sorted(texts)
    counts = [len(slots[s]) for s in range(n)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(n))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query_over_the_smallest_tables(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    check(queries.op3_hilbert_shards(spark, "/root/testdata/sf0.001").collect(), texts, 24)


def test_nulls_ties_few_rows_and_clashing_names(spark):
    rows = [(i, None if i % 3 else "x" * i, None if i % 5 == 0 else "s", "de", i) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, shard int")
    check(sharding.assign(df, 7, ["source", "lang", "__size"]).collect(), {r[0]: r[1] for r in rows}, 7)
    check(sharding.assign(df.limit(3), 24, ["source", "lang"]).collect(), {r[0]: r[1] for r in rows[:3]}, 24)
    assert sharding.assign(df.limit(0), 24, ["source"]).count() == 0
    same = spark.range(1000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a").alias("text"), F.lit("s").alias("source"))
    counts = [r["count"] for r in sharding.assign(same, 6, ["source"]).groupBy("shard").count().collect()]
    assert sorted(counts) == [166, 166, 167, 167, 167, 167]


def test_shards_prune_every_dimension(spark):
    df = spark.range(4096).select((F.col("id") % 64).alias("a"), F.floor(F.col("id") / 64).alias("b"))
    stats = sharding.pruning_stats(sharding.curve_shards(df, 16, ["a", "b"]), ["a", "b"]).collect()
    assert len(stats) == 16 and all(r.max_a - r.min_a < 32 and r.max_b - r.min_b < 32 for r in stats)
