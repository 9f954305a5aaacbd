from pyspark.sql import functions as F

from credence.llm import common, components


def test_edges_that_hang_on_their_root_take_no_round(spark, monkeypatch):
    made, materialise = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: (made.append(name), materialise(df, name))[1])
    stars = spark.createDataFrame([(1, b) for b in range(2, 40)] + [(50, 51), (60, 51 + 20), (60, 90)], "a long, b long")
    roots = {r.node: r.root for r in components.components(stars).collect()}
    assert roots == {**dict.fromkeys(range(1, 40), 1), 50: 50, 51: 50, 60: 60, 71: 60, 90: 60}
    assert "stars" not in made
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    assert {r.root for r in components.components(chain).collect()} == {0} and "stars" in made


def test_links_of_buckets_name_the_root_of_each_class_and_end_without_a_round_for_nothing(spark, monkeypatch):
    made, materialise = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: (made.append(name), materialise(df, name))[1])
    members = spark.createDataFrame([(7, c, 1, 6) for c in range(1, 7)], "bucket long, class long, star long, n long")
    links = components.bucket_links(members, lambda pairs: pairs.filter((F.col("a") % 2 == F.col("b") % 2)))
    assert sorted((r.a, r.b) for r in links.collect()) == [(1, 3), (1, 5), (2, 4), (2, 6)]
    assert made.count("roots") == 2  # of the first links and of those found later, not once more for rounds that find none


def test_steps_send_no_side_of_a_join_through_the_driver(spark):
    small = spark.range(5).withColumn("x", F.col("id") + 1)
    with common._step(spark):
        plan = spark.range(1000).join(small, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def test_buckets_are_joined_in_three_comparisons(spark, monkeypatch):
    made, materialise = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: (made.append(name), materialise(df, name))[1])
    members = spark.createDataFrame([(7, c, 0, 100) for c in range(100)], "bucket long, class long, star long, n long")
    verify = lambda pairs: pairs.filter((F.col("a") % 30 == F.col("b") % 30) & (F.col("a") > 0))
    cross = lambda opened: components._star_pairs(opened.withColumn("star", F.lit(0)))
    links = components.bucket_links(members, verify, cross, lambda pairs: pairs.filter("b % 2 = 0"))
    assert sorted((r.a, r.b) for r in links.collect()) == sorted((c % 30 or 30, c) for c in range(31, 100))
    assert made.count("pairs") == 3 and "edges" not in made


def test_equal_and_turned_edges_are_hung_on_their_root(spark):
    edges = [(1, 2), (2, 1), (1, 2), (3, 2), (3, 3), (5, 4), (4, 6), (6, 5), (9, 8), (8, 7), (7, 9), (10, 7), (10, 9)] * 2
    hung = components.hang(spark.createDataFrame(edges, "a long, b long"))
    assert sorted((r.node, r.root) for r in hung.collect()) == [(2, 1), (3, 1), (5, 4), (6, 4), (8, 7), (9, 7), (10, 7)]
    assert components.hang(spark.createDataFrame([(3, 3)], "a long, b long").limit(0)).count() == 0


def test_members_linked_with_many_stars_keep_one_edge_after_a_round(spark, monkeypatch):
    made, materialise = [], components.materialise

    def counted(df, name):
        out = materialise(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(components, "materialise", counted)
    edges = [(star, b) for star in range(16) for b in range(16, 200)]
    hung = components.hang(spark.createDataFrame(edges, "a long, b long"))
    assert sorted((r.node, r.root) for r in hung.collect()) == [(n, 0) for n in range(1, 200)]
    assert made[-1] == ("roots", 199) and all(n <= 184 + 15 * 184 for _, n in made) and [n for name, n in made if name == "stars"][-1] <= 2 * 199
