import math

from pyspark.sql import functions as F

from credence.operators import maintenance
from credence.plans import catalogue

SF = "/root/testdata/sf0.001"


def brute(rows, threshold, newest_first):
    """The scan row by row; rows: id, project, ts, embedding, scanned."""
    gone = set()
    for i, project, _, x, scanned in sorted(rows, key=lambda r: (-r[2].timestamp() if newest_first else r[2].timestamp(), r[0])):
        near = (o for o, p, _, y, _ in rows if o != i and p == project and o not in gone and round(math.fsum(a * b for a, b in zip(x, y)), 6) >= threshold)
        if scanned and next(near, None) is not None:
            gone.add(i)
    return gone


def test_scans_see_all_memories_and_all_rows(spark):
    m = catalogue.memories(spark, SF)
    for name, scanned, newest in (("recent_dedup", F.col("ts") >= F.lit("2024-01-25").cast("timestamp"), True), ("cold_dedup", F.col("access_count") == 0, False)):
        rows = [tuple(r) for r in m.filter("embedding IS NOT NULL").select("id", F.coalesce("project", F.lit("default")), "ts", "embedding", F.coalesce(scanned, F.lit(False))).collect()]
        want = brute(rows, 0.3, newest)
        assert {r.id for r in catalogue.queries()[name](spark, SF).collect()} == want


def test_copies_of_unscanned_rows_and_large_groups_go(spark):
    rows = [(i, "p", 100 + i, i == 0) for i in range(40)] + [(50, "q", 1, False), (51, "q", 1, False), (52, "r", 1, False)]
    df = spark.createDataFrame(rows, "id long, project string, at long, read boolean").select("id", "project", F.timestamp_seconds("at").alias("ts"), "read", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    drop = lambda **k: sorted(r.id for r in maintenance.near_duplicates_to_drop(df, ~F.col("read"), 0.9, False, **k).collect())
    assert drop() == [*range(1, 40), 50] and drop(limit=2) == [50]
