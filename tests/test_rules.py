"""Rules of texts, clients, state tables and streams at their bounds."""

import pytest
from pyspark.sql import functions as F

from credence.functions import client, text
from credence.operators import domains, tail
from credence.sources import state_tables, text_sources
from credence.streaming import state


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("drop", "label"), [(0.31, "strongly"), (0.3, "sharpening"), (0.15, "slightly"), (0.05, "stable"), (-0.1, "stable"), (-0.11, "fading")])
def test_drift_verdicts(spark, drop, label):
    assert one(spark, text.drift_verdict(F.lit(drop))).startswith(label)


@pytest.mark.parametrize(("said", "good"), [
    ("https://example.org/a is what we read all day long", False), ("one-long-name-without-any-space-in-it.txt", False), ("four words are here in this line", True),
    ("three longerwordsthanthat herenowandthere", False), ("short but four words", False), ("\n see https://example.org for all the details \n", True),
])
def test_good_results(spark, said, good):
    assert one(spark, text.good_result(F.lit(said))) == good


def test_entity_tokens(spark):
    assert one(spark, text.entity_tokens(F.lit("ask GPT-4.1-mini and CW12A, not abc3 nor Al, about x@cf/some/model and Marlowe"))) == ["GPT-4.1-mini", "CW12A", "@cf/some/model"]


@pytest.mark.parametrize(("seconds", "age"), [(-5, "1m ago"), (30, "1m ago"), (3599, "59m ago"), (3600, "1h ago"), (86_400, "1d ago"), (30 * 86_400, "1mo ago"), (400 * 86_400, "1y ago")])
def test_relative_age(spark, seconds, age):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    assert one(spark, text.relative_age(now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(seconds))), now)) == age
    assert one(spark, text.relative_age(F.lit(None).cast("timestamp"), now)) == ""


@pytest.mark.parametrize(("head", "opens"), [("## Problems", False), ("## Problems solved", True), ("# KEY LEARNINGS:", True), ("### decisions made", True), ("#### Notes", False), ("## Plans", False)])
def test_sections(spark, head, opens):
    notes = spark.createDataFrame([(1, f"{head}\n- this is one item of the notes")], "id long, text string")
    assert text_sources.section_items(notes).count() == int(opens)


def test_redaction_is_not_skipped_by_its_guard(spark):
    said = ["password = hunter2222", "--token=abcdefgh", "GHP_x ghp_" + "a" * 20, "https://u:p@host/", "Basic abcdefgh1234", "plain words"]
    df = spark.createDataFrame([(x,) for x in said], "t string").select(text.redact(F.col("t")).alias("t"))
    assert [("[REDACTED]" in r.t) for r in df.collect()] == [True] * 5 + [False]


def test_transcripts(spark):
    lines = [(1, 0, '{"role":"user","message":{"role":"user","content":"please move the payroll job to the new cluster"}}'), (1, 1, '{"message":{"role":"assistant","content":"[{\\"type\\":\\"text\\",\\"text\\":\\"I moved the payroll job to the new cluster\\"},{\\"type\\":\\"tool\\"}]"}}'), (1, 2, '{"role":"user","message":{"content":"short"}}'), (2, 0, "no json")]
    got = {r.session: r.text for r in text_sources.transcript(spark.createDataFrame(lines, "session long, n long, line string")).collect()}
    assert got == {1: "[User]: please move the payroll job to the new cluster | [Assistant]: I moved the payroll job to the new cluster"}


def test_client_rules(spark):
    assert one(spark, client.skipped_command(F.lit("git status -s"))) and not one(spark, client.skipped_command(F.lit("make release")))
    assert one(spark, client.project_of(F.lit("/home/u/My Big_Repo/"))) == "my-big-repo" and one(spark, client.project_of(F.lit(""))) == "default"
    r = one(spark, client.listed(F.lit("[ab12] [2024-01-01T00:00] [σ=0.31] [4x] (ops/episodic) the text (of it)")))
    assert (r.id, r.sigma, r.reads, r.domain, r.type, r.text) == ("ab12", 0.31, 4, "ops", "episodic", "the text (of it)")
    assert one(spark, client.listed(F.lit("no line"))) is None
    assert one(spark, client.scrubbed(F.lit("[Notes (3)]\nold\n[End Notes]\n\nhello "), "Notes", "[End Notes]")) == "hello"
    lines = ["[0.90] (ops/x) a", "[0.69] (ops/x) b", "[1.2] (identity/x) c", "plain"]
    df = spark.createDataFrame([(x,) for x in lines], "l string")
    assert [r.s for r in df.select(client.shown_line(F.col("l")).alias("s")).collect()] == [True, False, False, False]
    assert one(spark, client.session_summary(F.array(F.lit("a")), F.lit("2024-01-01"))) is None


def test_state_tables(spark, tmp_path):
    t = spark.createDataFrame([(1, "a")], "id long, x string")
    state_tables.export({"one": t}, str(tmp_path))
    assert state_tables.restore(spark, str(tmp_path), ["one"])["one"].collect() == t.collect()
    receipts = spark.createDataFrame([(i, f"q{i}") for i in range(6)], "ts long, query_hash string")
    assert sorted(r.ts for r in state_tables.keep_receipts(receipts.filter("ts < 4"), receipts.filter("ts >= 4"), 3).collect()) == [3, 4, 5]
    rows = spark.createDataFrame([("a", "p", True), ("b", "p", False), ("c", "p", None)], "text string, project string, over boolean")
    on, wait = state_tables.divert(rows, F.col("over"), F.current_timestamp())
    assert sorted(r.text for r in on.collect()) == ["b", "c"] and [r.text for r in wait.collect()] == ["a"]
    anchors = spark.createDataFrame([("x", [1.0, 0.0], 3)], "name string, emb array<double>, memory_count long")
    seeds = spark.createDataFrame([("y", "t")], "name string, text string")
    embed = lambda c: F.array(F.lit(3.0), F.lit(4.0))
    assert {r.name: r.emb for r in state_tables.seeded(anchors, seeds, embed).collect()} == {"x": [1.0, 0.0], "y": [0.6, 0.8]}
    assert [r.name for r in state_tables.seeded(anchors, seeds, embed, clear=True).collect()] == ["y"]


def test_centroids_at_the_cap(spark):
    anchors = spark.createDataFrame([("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 1)], "name string, emb array<double>, memory_count long")
    hits = spark.createDataFrame([(1, "new", [0.0, 1.0]), (2, "later", [1.0, 0.0]), (3, "general", [1.0, 0.0])], "id long, name string, embedding array<double>")
    got = {r.name: r.memory_count for r in domains.update_centroids(anchors, hits, cap=3).collect()}
    assert got == {"a": 2, "b": 1, "new": 1}


def test_tail_keeps_what_the_cap_would_leave_alone():
    row = lambda i, **k: {"id": i, "score": 1.0 - i / 10, "text": f"words number{i} apart{i}", "type": "session", "sigma": 0.5, "cluster_id": "c", "contradiction": False, "primary_score": 0.5, "vector": []} | k
    rows = [row(1), row(2, cluster_id=None)]
    capped = tail.finish(rows, [], 8, 0.3)
    assert [r["id"] for r in capped] == [1, 2]
    assert [r["id"] for r in tail.finish([row(i) for i in range(1, 9)], [], 1, 0.8, temporal={8})][-1] == 8


def test_a_named_stream_goes_on_where_it_stopped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1,)], "x long").coalesce(1).write.parquet(folder + "/t.parquet")
    seen = []

    def build(t):
        return t

    first = state.drain(spark, folder, "t", build, run=f"named-{tmp_path.name}")
    seen.append(sorted(r.x for r in first.collect()))
    spark.createDataFrame([(2,)], "x long").coalesce(1).write.mode("append").parquet(folder + "/t.parquet")
    again = state.drain(spark, folder, "t", build, run=f"named-{tmp_path.name}")
    seen.append(sorted(r.x for r in again.collect()))
    assert seen == [[1], [1, 2]]
