"""Hybrid retrieval: lists from six sources, one scored pool, spreading over neighbours, the ordered tail.

Every source gives a top-k list whose length is a parameter (at most 100 ids), whatever
the size of the store; the lists are fused on the driver and name a pool of at most
``POOL`` rows. Only their wide columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions import kernels, text
from credence.operators import candidates, scoring, tail
from credence.operators.binding import in_scope

#: Rows of the pool, and what the sources may add that neither vectors nor keywords found.
POOL, HOT, TEMPORAL, ENTITY_MATCHES = 120, 10, 15, 10
#: Similarity that rows without one stand in with, by source.
SYNTHETIC = {"temporal": 0.5, "access": 0.35}

RESULT = "rank int, id long, score double, domain string, type string, sigma double, activated boolean, text string, display_domain string"


@dataclass
class Ask:
    """A query: its text and vector, whose records it may see, and the names it mentions with their vectors."""

    text: str
    vector: Sequence[float]
    top_k: int = 8
    project: str = "default"
    strict: bool = False
    default: str = "default"
    domain: str | None = None
    names: Sequence[str] = ()
    name_vectors: Sequence[Sequence[float]] = ()
    keywords: Sequence[str] | None = None
    link_floor: float = 0.65

    @property
    def sigma(self) -> float:
        return kernels.query_sigma(self.text, len(self.names))

    @property
    def days(self) -> int | None:
        return text.temporal_cue(self.text)

    def scope(self) -> Column:
        return in_scope(self.project, self.strict, self.default)


@dataclass
class Lists:
    """What the sources found: scored lists, best first, and ids in the order of the pool."""

    near: dict[int, float]
    words: dict[int, float]
    rrf: dict[int, float]
    temporal: set[int]
    synthetic: dict[int, float]
    names: dict[int, float]
    ids: list[int]
    injected: set[int] = field(default_factory=set)


def scoped_topk(rows: DataFrame, vector: Sequence[float], k: int, ask: Ask) -> DataFrame:
    """Nearest rows: of all projects for the default one, of one if strict, else of both with budgets of their own."""
    if ask.project == ask.default:
        return candidates.cosine_topk(rows, vector, k)
    if ask.strict:
        return candidates.cosine_topk(rows, vector, k, F.col("project") == ask.project)
    return candidates.blended_topk(rows, vector, k, ask.project, ask.default)


def _ranked(found: DataFrame) -> dict[int, float]:
    rows = sorted(found.collect(), key=lambda r: (-r["score"], r["id"]))
    return {r["id"]: r["score"] for r in rows}


def gather(rows: DataFrame, ask: Ask, clock: Column, hot: DataFrame | None = None) -> Lists:
    """The lists of all sources for a query. ``hot`` holds recently read ids, newest first by ``last_seen``."""
    near = _ranked(scoped_topk(rows, ask.vector, kernels.pool_size(ask.top_k, ask.sigma), ask))
    wanted = list(text.query_terms(ask.text)) if ask.keywords is None else list(ask.keywords)
    words = _ranked(candidates.bm25(rows, wanted, 4 * ask.top_k, True, scope=ask.scope())) if wanted else {}
    rrf: dict[int, float] = {}
    for found in (near, words):
        for rank, i in enumerate(found, 1):
            rrf[i] = rrf.get(i, 0.0) + 1 / (60 + rank)
    fused = sorted(rrf, key=lambda i: (-round(rrf[i], 12), i))[: 4 * ask.top_k]

    own = rows.filter(ask.scope())
    temporal = [] if ask.days is None else [r.id for r in candidates.temporal_window(own, ask.days, clock).orderBy(F.desc("ts"), "id").collect()]
    access = [r.id for r in candidates.access_top(own).collect()] if ask.sigma > 0.35 or not ask.names else []
    hot_ids = [] if hot is None else [r.id for r in hot.orderBy(F.desc("last_seen"), "id").limit(100).collect()]
    merged = set(fused)
    only_temporal = [i for i in temporal if i not in merged]
    only_access = [i for i in access if i not in near]
    ids = dict.fromkeys([*[i for i in hot_ids if i not in merged][:HOT], *only_temporal[:TEMPORAL], *near, *[i for i in fused if i not in near], *only_access])
    synthetic = {i: SYNTHETIC["access"] for i in only_access} | {i: SYNTHETIC["temporal"] for i in only_temporal if i not in near}

    names: dict[int, float] = {}
    for vector in ask.name_vectors:
        found = _ranked(scoped_topk(rows, vector, ENTITY_MATCHES, ask))
        for i in found:
            names[i] = names.get(i, 0.0) + min(0.25, 0.5 / max(1, len(found)))
    return Lists(near, words, rrf, set(temporal), synthetic, names, list(ids)[:POOL], set(only_access) if not ask.names else set())


def pool(rows: DataFrame, ask: Ask, found: Lists, clock: Column, entities: DataFrame | None = None) -> DataFrame:
    """The rows of the lists that may be seen, are valid and worth showing, with the evidence for each; columns for ``scoring.primary``."""
    made = [(i, found.near.get(i, 0.0), i in found.near, found.words.get(i, 0.0), found.rrf.get(i, 0.0), found.synthetic.get(i), found.names.get(i, 0.0)) for i in found.ids]
    listed = rows.sparkSession.createDataFrame(made, "id long, cos double, is_near boolean, bm25 double, rrf double, synthetic double, named double")
    seen = rows.filter(ask.scope() & (F.col("valid_to").isNull() | (F.col("valid_to") > clock)) & text.good_result(F.col("text")))
    got = seen.join(F.broadcast(listed), "id").withColumn("embedding", F.when(F.col("is_near"), F.col("embedding")))  # at most POOL rows
    if entities is None:
        return got.withColumn("entity", F.col("named")).withColumn("cohesion", F.lit(0.0))
    edges = entities.join(F.broadcast(listed.select(F.col("id").alias("memory_id"))), "memory_id").select(F.col("memory_id").alias("id"), F.col("name").alias("entity"))
    shared = edges.filter(F.col("entity").isin(list(ask.names))).groupBy("id").agg(F.count("*").alias("shared"))
    ties = scoring.cohesion_bonus(edges.distinct()).withColumnRenamed("bonus", "cohesion")
    boost = F.col("named") + kernels.entity_boost(F.coalesce("shared", F.lit(0)))
    return got.join(shared, "id", "left").join(ties, "id", "left").withColumn("entity", boost).withColumn("cohesion", F.coalesce("cohesion", F.lit(0.0)))


def _as_dict(r) -> dict:
    return {
        "id": r["id"], "score": r["score"], "text": r["text"] or "", "domain": r["domain"], "type": r["memory_type"], "sigma": r["sigma"], "cluster_id": r["cluster_id"],
        "contradiction": r["contradiction"], "primary_score": r["primary_score"], "vector": r["embedding"] or [], "cohesion": r["cohesion"], "activated": False,
    }


def spread(rows: DataFrame, ask: Ask, scored: list[dict], clock: Column, hops: int = 2, k: int = 3, fade: float = 0.6) -> list[dict]:
    """Rows near the three best ones, and near those, that the pool lacks; file edits and fragments are passed over."""
    seen = {r["id"] for r in scored}
    frontier = [r["vector"] for r in scored[:3] if len(r["vector"])]
    extras: list[dict] = []
    for hop in range(1, hops + 1):
        new: dict[int, float] = {}
        for vector in frontier:
            for i, cos in _ranked(scoped_topk(rows, vector, k, ask)).items():
                if i not in seen and cos >= ask.link_floor:
                    new[i] = max(new.get(i, 0.0), cos * fade**hop)
        seen |= set(new)
        if not new:
            break
        shown = ask.scope() & (F.col("valid_to").isNull() | (F.col("valid_to") > clock)) & text.good_result(F.col("text")) & ~F.col("text").rlike(text.FILE_EDIT)
        fetched = rows.filter(F.col("id").isin(list(new)) & shown).withColumn("cohesion", F.lit(0.0)).collect()
        frontier = [r["embedding"] for r in fetched]
        for r in sorted(fetched, key=lambda r: (-new[r["id"]], r["id"])):
            extras.append(_as_dict(r.asDict() | {"score": new[r["id"]], "primary_score": new[r["id"]], "embedding": []}) | {"activated": True})
    return extras


def retrieve(rows: DataFrame, ask: Ask, clock: Column, entities: DataFrame | None = None, hot: DataFrame | None = None, relations: DataFrame | None = None) -> DataFrame:
    """Ranked answers to a query, without side effects; an empty query has none."""
    spark = rows.sparkSession
    if not ask.text.strip():
        return spark.createDataFrame([], RESULT)
    found = gather(rows, ask, clock, hot)
    if not found.ids:
        return spark.createDataFrame([], RESULT)
    scored = scoring.activate(scoring.primary(pool(rows, ask, found, clock, entities), clock, ask.sigma, ask.days), clock, ask.sigma, ask.days, ask.domain)
    held = tail.in_bands([_as_dict(r) for r in scored.collect()])  # at most POOL rows
    extras = spread(rows, ask, held, clock)
    out = tail.finish(held, extras, ask.top_k, ask.sigma, found.temporal if ask.days is not None else None, found.injected, tail.tokens(ask.text))
    gone = set()
    if relations is not None and out:
        gone = {r.to_id for r in relations.filter((F.col("relation_type") == "supersedes") & F.col("to_id").isin([r["id"] for r in out])).select("to_id").distinct().collect()}
    return spark.createDataFrame([_shown(n, r, r["id"] in gone) for n, r in enumerate(out, 1)], RESULT)


def _shown(rank: int, r: dict, superseded: bool) -> tuple:
    mark = "[SUPERSEDED] " if superseded else "[CONTRADICTED — re-evaluate] " if r["contradiction"] else ""
    arrow = "↑" if r["sigma"] < 0.35 else "↓" if r["sigma"] > 0.6 else "→"
    ties = " ◆" if r["cohesion"] > 0.08 else " ◇" if r["cohesion"] > 0.03 else ""
    return (rank, r["id"], round(float(r["score"]), 6), r["domain"], r["type"], round(float(r["sigma"]), 6), r["activated"], mark + r["text"], f"{r['domain']} {arrow}{ties}")
