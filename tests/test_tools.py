"""The tool surface on a small store."""

import pytest
from pyspark.sql import functions as F

from credence import ai, tools

ROWS = [
    (1, "The deploy script uses blue green switching on the cluster", "p", "ops", 5, 0.3),
    (2, "The deploy script uses blue green switching on the cluster", "p", "ops", 1, 0.5),
    (3, "Invoices are exported as csv every single monday", "p", "billing", 0, 1.99),
    (4, "Meeting notes about nothing in particular at all", "default", "lonely", 2, 0.4),
]


@pytest.fixture(scope="module")
def store(spark):
    vec = ai.hashing_embedder()([r[1] for r in ROWS]).tolist()
    rows = [(i, t, p, d, v, None, n, s) for (i, t, p, d, n, s), v in zip(ROWS, vec)]
    m = spark.createDataFrame(rows, "id long, text string, project string, domain string, embedding array<float>, cluster_id int, access_count long, sigma double")
    m = m.withColumns({"memory_type": F.lit("episodic"), "ts": F.lit("2024-01-01").cast("timestamp") + F.expr("make_interval(0, 0, 0, id)"), "last_accessed": F.lit("2024-01-01").cast("timestamp"), "contradiction": F.lit(False), "valid_to": F.lit(None).cast("timestamp")})
    make = spark.createDataFrame
    anchors = m.filter("id in (1, 3)").select(F.col("domain").alias("name"), F.col("embedding").alias("emb"))
    return tools.Store(
        {
            "memories": m, "relations": make([(9, 3, "pending_judge")], "from_id long, to_id long, relation_type string"), "history": make([(1, 0, 0.5), (1, 1, 0.3)], "id long, n long, sigma double"),
            "entities": make([], "memory_id long, entity_id string"), "anchors": anchors, "values": make([("identity", "old")], "key string, value string"),
        },
        clock=F.lit("2024-02-01").cast("timestamp"),
    )


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_registry_has_every_tool():
    assert len(tools.TOOLS) == 27


def test_retrieve_list_and_reports(store):
    top = tools.memory_retrieve(store, "how does the deploy script switch the cluster")
    assert top.orderBy("rank").first().id in (1, 2) and len(set(ids(top)) & {1, 2}) == 1  # one of two copies
    assert ids(tools.memory_retrieve(store, "invoices exported as csv", top_k=1, baseline=True)) == [3]
    assert tools.memory_list(store, domain="ops").count() == 2
    assert tools.memory_stats(store).filter("domain is null and memory_type is null").first().n == 4
    assert tools.memory_timeline(store).count() == 4
    assert tools.memory_belief_drift(store).first().verdict.startswith("sharpening")
    assert tools.memory_belief_drift_backfill(store).select("id").distinct().count() == 3
    assert tools.memory_find_duplicate_clusters(store).first().ids == [1, 2]
    assert tools.memory_orphan_check(store).count() == 0
    assert tools.identity_profile_get(tools.identity_profile_set(store, "new")).first().value == "new"


def test_writes(store, spark):
    new = spark.createDataFrame([("Invoices are exported as csv every single monday",), ("A wholly new remark on parsing of tokens",)], "text string")
    after = tools.memory_store(store, new, "p")
    assert sorted(r.action for r in after["actions"].collect()) == ["merged", "spawned"]
    assert after["memories"].count() == 5 and after["memories"].filter("id = 3").first().sigma == pytest.approx(1.99 / 2)
    assert tools.memory_auto_store(store, spark.createDataFrame([("yeah ok then whatever",)], "text string"))["memories"].count() == 4
    decided = tools.memory_store_decision(store, spark.createDataFrame([("Use arrow", "speed", None, "done")], "decision string, context string, alternatives string, outcome string"), "p")
    assert decided["memories"].filter("text = 'Decision: Use arrow | Context: speed | Outcome: done'").count() == 1
    notes = spark.createDataFrame([(1, "# Other\n- this bullet is not under a section\n## Key Learnings\n- always measure before you optimise it\n- short")], "id long, text string")
    assert tools.memory_capture_passive(store, notes)["memories"].filter("text = 'always measure before you optimise it'").count() == 1
    assert tools.reinforce(store, spark.createDataFrame([(1,)], "id long"))["memories"].filter("id = 1").first().access_count == 6


def test_deletes_and_maintenance(store):
    assert ids(tools.memory_dedupe(store)["memories"]) == [1, 3, 4] and ids(tools.memory_dedupe(store, dry_run=True)) == [2]
    gone = tools.memory_delete(store, 3)
    assert ids(gone["memories"]) == [1, 2, 4] and gone["relations"].count() == 0
    assert ids(tools.memory_bulk_delete(store, "deploy%cluster")["memories"]) == [3, 4]
    assert ids(tools.memory_decay(store)["memories"]) == [1, 2, 4]
    assert tools.memory_update(store, 4, "Fresh text")["memories"].filter("text = 'Fresh text'").count() == 1
    assert tools.memory_cleanup_singletons(store, 2)["memories"].filter("domain = 'lonely'").count() == 0
    assert tools.memory_rebuild_domains(store)["memories"].count() == 4 and tools.memory_rebuild_domains(store, dry_run=True).count() == 7
    judged = tools.memory_judge(store, 0.9)
    assert judged["relations"].filter("relation_type = 'compatible'").count() == 1
    assert tools.memory_build_entities(store)["entities"].count() > 0


def test_merge_moves_the_vector_with_the_text(spark, store):
    text = "the Deploy script uses blue green switching on the cluster!"
    after = tools.memory_store(store, spark.createDataFrame([(text,)], "text string"), "p", memory_type="session")
    row = after["memories"].filter("id = 1").first()
    assert row.text == text and row.memory_type == "session" and row.access_count == 6 and str(row.last_accessed) == "2024-02-01 00:00:00"
    assert row.embedding == pytest.approx(store.embedder([text])[0].tolist())
    assert after["memories"].count() == 4


def test_new_records_begin_a_history(spark, store):
    after = tools.memory_store(store, spark.createDataFrame([("an entirely new fact on the payroll export job",)], "text string"), "p")
    new = after["memories"].filter("text like 'an entirely%'").first()
    assert [(r.n, r.sigma) for r in after["history"].filter(F.col("id") == new.id).collect()] == [(0, new.sigma)]


def test_deletes_are_archived_and_take_id_prefixes(spark, store, tmp_path):
    path = str(tmp_path / "archive")
    assert ids(tools.memory_delete(store, 3, archive=path)["memories"]) == [1, 2, 4]
    assert [r.id for r in spark.read.json(path).collect()] == [3]
    long = store.with_(memories=store["memories"].withColumn("id", F.col("id") + 1234567890))
    assert ids(tools.memory_delete(long, "12345678")["memories"]) == []
    assert len(ids(tools.memory_delete(long, "1234567")["memories"])) == 4


def test_items_that_repeat_are_stored_once_and_logs_make_a_session(spark, store):
    notes = spark.createDataFrame([(1, "## Learnings\n- the payroll export job runs at four\n- The payroll export job runs at four\n## Problems\n- this header opens no section at all here")], "id long, text string")
    after = tools.memory_capture_passive(store, notes, "p")
    assert after["memories"].filter("text like '%payroll%'").count() == 1 and after["memories"].count() == 5
    log = spark.createDataFrame([(7, "we moved the payroll job to the new cluster | the invoices are now exported on fridays | Here are the facts you asked for today")], "id long, text string")
    after = tools.memory_extract_and_store(store, log, "p")
    session = after["memories"].filter("memory_type = 'session'").first()
    assert session.text == "Session 2024-02-01: we moved the payroll job to the new cluster | the invoices are now exported on fridays"


def test_queue_is_drained_oldest_first_and_stops_on_quota(spark, store):
    rows = [(1, "fact", "the oldest queued fact is about payroll", "p", "2024-01-01"), (2, "fact", "a newer queued fact on something else", "p", "2024-01-02")]
    pending = spark.createDataFrame(rows, "id long, kind string, text string, project string, created_at string")
    waiting = store.with_(pending=pending)
    after, report = tools.drain_pending(waiting, 1)
    assert report == {"processed": 1, "remaining": 1, "stopped": False} and after["memories"].filter("text like 'the oldest%'").count() == 1 and ids(after["pending"]) == [2]
    assert tools.drain_pending(waiting, 1, stopped=True)[1] == {"processed": 0, "remaining": 2, "stopped": True}


def test_duplicate_clusters_take_hash_ids(spark, store):
    big = store.with_(memories=store["memories"].withColumn("id", F.col("id") * 2**60 - 2**62))
    assert [r.n for r in tools.memory_find_duplicate_clusters(big).collect()] == [2]


def test_retag_by_a_classifier_and_entity_queue(spark, store):
    moved = tools.memory_retag_projects(store, lambda said, names: F.when(said.contains("Meeting"), F.get(names, 0)))
    assert moved["memories"].filter("id = 4").first().project == "p"
    queue = spark.createDataFrame([(4, "Notes by Marlowe on Tuesday", "2024-01-01"), (1, "Later by Chandler", "2024-01-02")], "id long, text string, created_at string")
    after = tools.memory_process_entity_queue(store.with_(entity_queue=queue), 1)
    assert {r.entity_id for r in after["entities"].collect()} == {"ent_term_notes", "ent_term_marlowe", "ent_term_tuesday"} and ids(after["entity_queue"]) == [1]


def test_retrieval_joins_its_sources(spark, store):
    entities = spark.createDataFrame([(3, "ent_term_marlowe"), (4, "ent_term_marlowe")], "memory_id long, entity_id string")
    hot = spark.createDataFrame([(2, "2024-01-31")], "id long, last_seen string")
    full = store.with_(entities=entities, hot=hot, relations=spark.createDataFrame([(2, 4, "supersedes")], "from_id long, to_id long, relation_type string"))
    out = tools.memory_retrieve(full, "what did Marlowe say on invoices exported as csv", project="p").collect()
    assert out[0].id == 4 and out[0].text.startswith("[SUPERSEDED] ") and out[0].rank == 1
    assert tools.memory_retrieve(full, "  ").count() == 0
