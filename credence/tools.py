"""The tool surface: one function per tool name, from tables to tables.

A store is a dict of tables (``memories``, ``history``, ``relations``, ``entities``,
``anchors``, ``pending``, ``values``). Reads return a table; writes return a new
store, since plain tables have no transactions: the caller writes the snapshot.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence import ai
from credence.functions import client, kernels, text
from credence.operators import analytics, candidates, clustering, maintenance, retrieval, scoring, similarity, writes
from credence.operators.binding import in_scope, is_valid
from credence.session import checkpointed
from credence.sources import state_tables, text_sources


@dataclass
class Store:
    tables: dict[str, DataFrame]
    clock: Column = field(default_factory=F.current_timestamp)
    embedder: ai.Embedder = field(default_factory=ai.hashing_embedder)
    default: str = "default"

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def with_(self, **tables: DataFrame) -> Store:
        return Store(self.tables | tables, self.clock, self.embedder, self.default)


def _records(store: Store, rows: DataFrame, project: str | None, intensity: Column | float | None = None, kind: Column | None = None) -> DataFrame:
    """Incoming texts (column text) as records with deterministic ids."""
    project = project or store.default
    t = F.col("text")
    strength = text.intensity_of(t) if intensity is None else F.lit(intensity) if isinstance(intensity, (int, float)) else intensity
    made = rows.select("text").withColumn("project", F.lit(project))
    made = made.withColumn("id", F.xxhash64("project", "text")).withColumn("embedding", ai.embedding_column(store.embedder, t))
    return made.withColumns({
        "memory_type": text.kind_of(t) if kind is None else kind, "domain": F.lit("general"), "cluster_id": F.lit(None).cast("int"), "sigma": kernels.initial_sigma(strength),
        "ts": store.clock, "last_accessed": store.clock, "access_count": F.lit(0).cast("long"), "contradiction": F.lit(False), "valid_to": F.lit(None).cast("timestamp"),
    })


def _store(store: Store, rows: DataFrame, project: str | None = None, **kw) -> Store:
    """Decide and apply.

    A merged record takes over the newest text with its vector and domain (a session
    also makes it a session) and gets a sharper sigma; a contradicted one is flagged;
    the rest is added, with the first row of its history and an edge to be judged to
    each record it nearly merged with.
    """
    new = checkpointed(_records(store, rows, project, **kw).dropDuplicates(["id"]))  # the batch and what becomes of it are read several times
    old = store["memories"]
    acts = checkpointed(writes.decide(new, old, dims=64))
    named = new.join(acts.withColumnRenamed("new_id", "id"), "id")
    last = F.max_by(F.struct("text", "embedding", "domain", F.when(F.col("memory_type") == "session", "session").alias("memory_type")), "id")
    merged = named.filter("action = 'merged'").groupBy(F.col("old_id").alias("id")).agg(last.alias("r")).select("id", "r.*").withColumn("last_accessed", store.clock)
    torn = named.filter("action = 'contradiction'").select(F.col("old_id").alias("id")).distinct().withColumn("contradiction", F.lit(True))
    kept = maintenance.merge_columns(maintenance.merge_columns(old, merged, ["text", "embedding", "domain", "memory_type", "last_accessed"]), torn, ["contradiction"])
    hit = merged.select("id", F.lit(True).alias("__m"))
    kept = kept.join(hit, "id", "left").withColumn("sigma", F.when(F.col("__m"), kernels.kalman_sigma(F.col("sigma"), F.col("sigma"))).otherwise(F.col("sigma"))).withColumn("access_count", F.col("access_count") + F.coalesce(F.col("__m").cast("int"), F.lit(0))).drop("__m")
    added = named.filter("action <> 'merged'").select(*[c for c in new.columns])
    more = {"memories": kept.unionByName(added, allowMissingColumns=True), "actions": acts}
    if "history" in store.tables:
        begun = added.select("id", F.lit(0).cast("long").alias("n"), F.col("sigma").cast("double").alias("sigma"))
        more["history"] = store["history"].unionByName(begun.join(store["history"].select("id"), "id", "left_anti"), allowMissingColumns=True)
    if "relations" in store.tables:
        near = checkpointed(writes.near_misses(writes.candidates(added, old, 0.85)).select("from_id", "to_id", "relation_type"))
        more["relations"] = store["relations"].unionByName(near.join(store["relations"].select("from_id", "to_id"), ["from_id", "to_id"], "left_anti"), allowMissingColumns=True)
    return store.with_(**more)


def _distinct_items(store: Store, items: DataFrame, above: float = 0.92) -> DataFrame:
    """Items (id, n, text) of which none resembles an earlier one of its source; a source has few items."""
    import numpy as np
    import pandas as pd

    embedder = store.embedder

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", ignore_index=True)
        vectors = np.asarray(embedder(pdf["text"].tolist()), np.float64)
        kept: list[int] = []
        for i in range(len(pdf)):
            if not kept or (vectors[kept] @ vectors[i]).max() <= above:
                kept.append(i)
        return pdf.iloc[kept][["id", "n", "text"]]

    kind = items.schema["id"].dataType.simpleString()
    return items.select("id", F.col("n").cast("long").alias("n"), "text").groupBy("id").applyInPandas(fold, f"id {kind}, n long, text string")


def _archived(store: Store, ids: DataFrame, path: str | None) -> DataFrame:
    """Ids that may be deleted: all, or those whose records were written to the archive first."""
    return ids if path is None else maintenance.archive(store["memories"].join(ids, "id", "left_semi"), path, store.clock)


def memory_store(store: Store, rows: DataFrame, project: str | None = None, emotional_intensity: float = 0.0, memory_type: str = "episodic") -> Store:
    return _store(store, rows, project, intensity=emotional_intensity, kind=F.lit(memory_type))


def memory_auto_store(store: Store, rows: DataFrame, project: str | None = None) -> Store:
    return _store(store, rows.filter(~text.low_signal(F.col("text"))), project)


def memory_store_decision(store: Store, rows: DataFrame, project: str | None = None) -> Store:
    """rows: decision, context, alternatives, outcome."""
    said = text.decision(F.col("decision"), context=F.col("context"), alternatives=F.col("alternatives"), outcome=F.col("outcome"))
    return _store(store, rows.select(said.alias("text")), project, intensity=0.6, kind=F.lit("decision"))


def memory_store_diff(store: Store, rows: DataFrame, project: str | None = None) -> Store:
    """rows: file_path, old_string, new_string; mechanical edits are skipped."""
    real = rows.filter(~text.mechanical(F.col("old_string"), F.col("new_string")))
    said = F.concat(F.lit("Edited: "), F.element_at(F.split("file_path", "/"), -1), F.lit(" | "), text.squash(F.col("new_string")))
    return _store(store, real.select(said.alias("text")), project, intensity=0.0)


def memory_retrieve(store: Store, query: str, top_k: int = 8, project: str | None = None, strict_project: bool = False, domain: str | None = None, baseline: bool = False) -> DataFrame:
    """Ranked rows for a query text from all sources; no side effects (see ``reinforce``)."""
    rows = store["memories"]
    vec = store.embedder([query])[0].tolist() if query.strip() else []
    if baseline:
        valid = rows.filter(in_scope(project or store.default, strict_project, store.default) & (F.col("valid_to").isNull() | (F.col("valid_to") > store.clock)))
        return candidates.cosine_topk(valid, vec, top_k)
    found = rows.sparkSession.createDataFrame([(query,)], "q string").select(text.entity_tokens(F.col("q"))).first()[0]
    names = [re.sub("[^a-z0-9]+", "_", f"ent_term_{n.strip().lower()}") for n in found]
    ask = retrieval.Ask(query, vec, top_k, project or store.default, strict_project, store.default, domain, names, [v.tolist() for v in store.embedder(list(found))] if found else [])
    entities = store["entities"].select("memory_id", F.col("entity_id").alias("name")) if "entities" in store.tables else None
    return retrieval.retrieve(rows, ask, store.clock, entities, store.tables.get("hot"), store.tables.get("relations"))


def reinforce(store: Store, hits: DataFrame) -> Store:
    sizes = store["memories"].groupBy("domain").agg(F.count("*").alias("domain_size"))
    return store.with_(memories=writes.reinforce(store["memories"], hits, sizes, store.clock))


def memory_list(store: Store, domain: str | None = None, limit: int = 50, sort: str = "ts", since: str | None = None) -> DataFrame:
    return analytics.listing(store["memories"], sort, limit, domain, since)


def memory_decay(store: Store, limit: int | None = None) -> Store:
    aged = maintenance.decay_pass(store["memories"], store.clock, limit)
    kept = maintenance.merge_columns(store["memories"], aged.select("id", F.col("new_sigma").alias("sigma")), ["sigma"])
    return _without(store.with_(memories=kept), aged.filter("pruned").select("id"))


def _without(store: Store, ids: DataFrame) -> Store:
    keys = {"memories": ["id"], "history": ["id"], "relations": ["from_id", "to_id"], "entities": ["memory_id"]}
    held = {n: t for n, t in store.tables.items() if n in keys}
    return store.with_(**maintenance.cascade_delete(held, ids, keys))


def memory_stats(store: Store) -> DataFrame:
    return analytics.stats(store["memories"])


def memory_orphan_check(store: Store, repair: bool = False) -> DataFrame | Store:
    rows = store["memories"]
    if not repair:
        return rows.filter(F.col("embedding").isNull()).select("id")
    return store.with_(memories=rows.withColumn("embedding", F.coalesce("embedding", ai.embedding_column(store.embedder, F.col("text")))))


def memory_judge(store: Store, floor: float = 0.70, memory_id: int | str | None = None, top_k: int = 5) -> Store:
    """Judge near pairs without a settled relation; the superseded side's validity ends.

    With ``memory_id`` (an id or its first eight characters) only the ``top_k`` nearest of that record are judged.
    """
    rows = store["memories"]
    settled = store["relations"].filter("relation_type <> 'pending_judge'").select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).distinct()
    if memory_id is None:
        pairs = similarity.theta_pairs(rows, "project", floor)
    else:
        asked = by_id(rows, memory_id)
        near = writes.candidates(asked, rows.join(asked.select("id"), "id", "left_anti"), floor, top_k)
        pairs = near.select(F.least("new_id", "old_id").alias("a"), F.greatest("new_id", "old_id").alias("b"), "cos")
    pairs = pairs.join(settled, ["a", "b"], "left_anti")
    side = lambda c: rows.select(F.col("id").alias(c), F.col("text").alias(f"t{c}"), F.col("ts").alias(f"ts_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    older_a = F.col("ts_a") <= F.col("ts_b")
    new, old = F.when(older_a, F.col("tb")).otherwise(F.col("ta")), F.when(older_a, F.col("ta")).otherwise(F.col("tb"))
    edges = both.select(F.when(older_a, F.col("b")).otherwise(F.col("a")).alias("from_id"), F.when(older_a, F.col("a")).otherwise(F.col("b")).alias("to_id"), ai.rule_verdict(new, old, F.col("cos")).alias("relation_type"))
    ended = edges.filter("relation_type = 'supersedes'").select(F.col("to_id").alias("id")).distinct().withColumn("valid_to", store.clock)
    kept = store["relations"].filter("relation_type <> 'pending_judge'").select("from_id", "to_id", "relation_type")
    return store.with_(relations=kept.unionByName(edges), memories=maintenance.merge_columns(rows, ended, ["valid_to"]))


def memory_capture_passive(store: Store, notes: DataFrame, project: str | None = None) -> Store:
    items = text_sources.section_items(notes, "id", "text").select("id", "n", F.col("item").alias("text"))
    return _store(store, _distinct_items(store, items), project)


def memory_timeline(store: Store, domain: str | None = None, limit: int = 20) -> DataFrame:
    rows = store["memories"] if domain is None else store["memories"].filter(F.col("domain") == domain)
    return analytics.timeline(rows, store["relations"], min(limit, 50))


def memory_belief_drift(store: Store, memory_id: int | None = None) -> DataFrame:
    past = store["history"] if memory_id is None else store["history"].filter(F.col("id") == memory_id)
    return analytics.drift(past)


def memory_belief_drift_backfill(store: Store, limit: int = 300) -> DataFrame:
    return analytics.backfill(store["memories"], store["history"], limit)


def memory_delete(store: Store, id: int | str, archive: str | None = None) -> Store:
    return _without(store, _archived(store, by_id(store["memories"], id).select("id"), archive))


def by_id(rows: DataFrame, id: int | str) -> DataFrame:
    """The row of an id, or the rows whose id begins with a string of eight characters or more."""
    if isinstance(id, int):
        return rows.filter(F.col("id") == id)
    if len(id) < 8:
        return rows.filter(F.col("id").cast("string") == id)
    return rows.filter(F.col("id").cast("string").startswith(id))


def memory_update(store: Store, id: int, new_text: str) -> Store:
    hit = F.col("id") == id
    vec = scoring.vector_literal(store.embedder([new_text])[0].tolist()).cast("array<float>")
    return store.with_(memories=store["memories"].withColumns({"text": F.when(hit, F.lit(new_text)).otherwise(F.col("text")), "embedding": F.when(hit, vec).otherwise(F.col("embedding"))}))


def memory_extract_and_store(store: Store, logs: DataFrame, project: str | None = None, most: int = 12) -> Store:
    """Facts of logs (id, text) by rule: clean parts, at most ``most`` per log, none that repeats another; two or more also make a session record."""
    parts = logs.select("id", F.posexplode(F.split(text_sources.extraction_filter(F.col("text")), r" \| ")).alias("n", "fact"))
    clean = parts.filter(F.col("n") < most).filter(text_sources.good_fact(F.col("fact")))
    facts = _distinct_items(store, clean.select("id", "n", text.redact(F.col("fact")).alias("text")))
    said = facts.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("facts"))
    summary = said.select(client.session_summary(F.col("facts"), F.to_date(store.clock)).alias("text")).filter(F.col("text").isNotNull())
    return _store(_store(store, facts, project), summary, project, intensity=0.9, kind=F.lit("session"))


def memory_bulk_delete(store: Store, pattern: str | None = None, project: str | None = None, archive: str | None = None) -> Store:
    return _without(store, _archived(store, maintenance.bulk_pattern(store["memories"], pattern, project).select("id"), archive))


def memory_dedupe(store: Store, dry_run: bool = False) -> DataFrame | Store:
    extra = maintenance.exact_keepers(store["memories"]).filter("id <> keeper").select("id")
    return extra if dry_run else _without(store, extra)


def memory_cleanup_singletons(store: Store, min_count: int = 3, floor: float = 0.3) -> Store:
    rows = store["memories"]
    small = maintenance.singleton_domains(rows, min_count)
    anchors = store["anchors"].join(small.select(F.col("domain").alias("name")), "name", "left_anti")
    to = maintenance.remap(similarity.nearest_anchor(rows.join(small, "domain", "left_semi"), anchors), floor)
    return store.with_(memories=maintenance.merge_columns(rows, to.select("id", F.col("target").alias("domain")), ["domain"]), anchors=anchors)


def memory_find_duplicate_clusters(store: Store, domain: str | None = None, threshold: float = 0.85, min_cluster_size: int = 2) -> DataFrame:
    rows = store["memories"] if domain is None else store["memories"].filter(F.col("domain") == domain)
    groups = similarity.connected(similarity.theta_links(rows, "domain", threshold))
    return groups.groupBy("root").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count("*").alias("n")).filter(F.col("n") >= min_cluster_size)


def memory_rebuild_domains(store: Store, targeted: bool = False, merge_threshold: float = 0.75, micro_threshold: float = 0.85, dry_run: bool = False) -> DataFrame | Store:
    rows = store["memories"]
    if targeted:
        to = maintenance.remap(similarity.nearest_anchor(rows.filter("domain = 'general'"), store["anchors"]))
        return store.with_(memories=maintenance.merge_columns(rows, to.select("id", F.col("target").alias("domain")), ["domain"]))
    if dry_run:
        return clustering.curve(rows, micro_threshold, 0.6, [0.65, 0.7, 0.725, 0.75, 0.775, 0.8, 0.85])
    new = clustering.rebuild(rows, micro_threshold, merge_threshold)
    name = F.when(F.col("cluster") < 0, "general").otherwise(F.concat(F.lit("cluster-"), F.col("cluster")))
    return store.with_(memories=maintenance.merge_columns(rows, new.select("id", name.alias("domain")), ["domain"]))


def memory_retag_projects(store: Store, classify: Callable[[Column, Column], Column] | None = None) -> Store:
    """Default-project rows move to a project whose name their text holds, or that ``classify`` (of the text and all names) gives."""
    rows = store["memories"]
    names = rows.filter(F.col("project") != store.default).select(F.col("project").alias("target")).distinct()
    own = rows.filter(F.col("project") == store.default)
    if classify is not None:
        listed = names.agg(F.array_sort(F.collect_set("target")).alias("names"))  # one row
        asked = own.join(F.broadcast(listed)).select("id", classify(F.col("text"), F.col("names")).alias("project"), "names")
        hits = asked.filter(F.array_contains("names", F.col("project"))).select("id", "project")
    else:
        hits = own.select("id", F.explode(text.tokens(F.col("text"))).alias("target")).join(names, "target").groupBy("id").agg(F.min("target").alias("project"))
    return store.with_(memories=maintenance.merge_columns(rows, hits, ["project"]))


def _with_entities(store: Store, rows: DataFrame) -> Store:
    found = rows.select(F.col("id").alias("memory_id"), F.explode(text.entity_tokens(F.substring("text", 1, 300))).alias("name"))
    links = found.select("memory_id", text.entity_id(F.lit("term"), F.col("name")).alias("entity_id")).distinct()
    return store.with_(entities=store["entities"].unionByName(links.join(store["entities"], ["memory_id", "entity_id"], "left_anti")))


def memory_build_entities(store: Store) -> Store:
    """Entities by rule from all records, inserted where absent."""
    return _with_entities(store, store["memories"])


def memory_process_entity_queue(store: Store, most: int = 50) -> Store:
    """Entities of the oldest ``most`` queued records (id, text, created_at), which leave the queue; of all records where there is no queue."""
    if "entity_queue" not in store.tables:
        return memory_build_entities(store)
    taken, rest = state_tables.drained(store["entity_queue"], most)
    return _with_entities(store, taken).with_(entity_queue=rest)


def drain_pending(store: Store, most: int = 50, stopped: bool = False) -> tuple[Store, dict]:
    """Queued facts and logs (id, kind, text, project, created_at), oldest first: stored and taken off the queue, unless the quota has stopped it."""
    queue = store["pending"]
    if stopped:
        return store, {"processed": 0, "remaining": queue.count(), "stopped": True}
    taken, rest = state_tables.drained(queue, most)
    for project in [r.project for r in taken.select("project").distinct().orderBy("project").collect()]:  # at most ``most``
        mine = taken.filter(F.col("project") == project)
        store = _store(store, mine.filter("kind = 'fact'").select("text"), project)
        store = memory_extract_and_store(store, mine.filter("kind = 'raw_log'").select("id", "text"), project)
    return store.with_(pending=rest), {"processed": taken.count(), "remaining": rest.count(), "stopped": False}


def identity_profile_get(store: Store) -> DataFrame:
    return store["values"].filter("key = 'identity'")


def identity_profile_set(store: Store, content: str) -> Store:
    row = store["values"].sparkSession.createDataFrame([("identity", content)], "key string, value string")
    return store.with_(values=store["values"].filter("key <> 'identity'").unionByName(row))


#: Every tool by name.
TOOLS = {name: f for name, f in list(globals().items()) if name.startswith(("memory_", "identity_")) and callable(f)}
