"""Registered queries of the memory engine and their DuckDB statements.

Query vectors are the embedding of vector 0; thresholds are the data's own (the
defaults of the operators never fire on random vectors).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions import client, kernels, text
from credence.operators import analytics, candidates, clustering, domains, maintenance, retrieval, scoring, similarity, tail, writes
from credence.operators.binding import NOW, NOW_MAINT, in_scope, is_valid, memories, memories_cte, now, table
from credence.sources import state_tables, text_sources
from credence.streaming import state

#: The query that ``entry`` runs.
FLAGSHIP = "retrieve_full"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_TERMS = ["the", "of", "and"]
_DEFAULT, _PROJECT = "src0", "src3"
SIGMA_Q = 0.4


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first().embedding)


M = f"WITH {memories_cte()}"
DOT = "list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))".format
Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
COS0 = DOT(a="embedding", b=Q0)
T = "TIMESTAMP '{}'".format
AGE = "(date_diff('second', {ts}, " + T(NOW) + ") / 86400.0)"

# -- retrieval -------------------------------------------------------------------------------


@query(f"{M} SELECT id, round({COS0}, 6) AS score FROM memories WHERE embedding IS NOT NULL ORDER BY score DESC, id LIMIT 8")
def baseline_topk(spark, sf):
    return candidates.cosine_topk(memories(spark, sf), query_vector(spark, sf), 8)


@query(f"""{M}, s AS (SELECT id, project, round({COS0}, 6) AS score FROM memories WHERE embedding IS NOT NULL),
 u AS ((SELECT id, score FROM s WHERE project = '{_PROJECT}' ORDER BY score DESC, id LIMIT 20) UNION ALL (SELECT id, score FROM s WHERE project = '{_DEFAULT}' ORDER BY score DESC, id LIMIT 6))
 SELECT id, max(score) AS score FROM u GROUP BY id""")
def scoped_topk_blend(spark, sf):
    return candidates.blended_topk(memories(spark, sf), query_vector(spark, sf), 20, _PROJECT, _DEFAULT)


def _bm25_sql(having: str) -> str:
    return f"""WITH t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS terms FROM documents),
 c AS (SELECT count(*) AS n, avg(len(terms)) AS avg_len FROM t),
 p AS (SELECT id, len(terms) AS length, unnest(terms) AS term FROM t),
 h AS (SELECT id, length, term, count(*) AS tf FROM p WHERE term IN ('the', 'of', 'and') GROUP BY 1, 2, 3),
 d AS (SELECT term, count(*) AS df FROM h GROUP BY term)
 SELECT id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_len))), 6) AS score
 FROM h JOIN d USING (term), c GROUP BY id {having} ORDER BY score DESC, id LIMIT 50"""


@query(_bm25_sql("HAVING count(*) = 3"))
def keyword_bm25_and(spark, sf):
    return candidates.bm25(table(spark, sf, "documents"), _TERMS, 50, True, "doc_id")


@query(_bm25_sql(""))
def keyword_bm25_or(spark, sf):
    return candidates.bm25(table(spark, sf, "documents"), _TERMS, 50, False, "doc_id")


@query(f"""{M}, a AS (SELECT id, row_number() OVER (ORDER BY round({COS0}, 6) DESC, id) AS r FROM memories WHERE embedding IS NOT NULL QUALIFY r <= 40),
 b AS (SELECT id, row_number() OVER (ORDER BY access_count DESC, id) AS r FROM memories QUALIFY r <= 20)
 SELECT id, round(sum(1.0 / (60 + r)), 8) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id""")
def rrf_fusion(spark, sf):
    m = memories(spark, sf)
    near = candidates.cosine_topk(m, query_vector(spark, sf), 40)
    return candidates.rrf([near, candidates.access_top(m).select("id", F.col("access_count").cast("double").alias("score"))])


@query(f"""{M}, h AS (SELECT id, ts, memory_type FROM memories WHERE {AGE.format(ts='ts')} BETWEEN 4 AND 7)
 (SELECT * FROM h ORDER BY ts DESC, id LIMIT 20) UNION (SELECT * FROM h WHERE memory_type = 'session' ORDER BY ts DESC, id LIMIT 10)""")
def temporal_window_candidates(spark, sf):
    return candidates.temporal_window(memories(spark, sf), text.temporal_cue("what changed this week?"), now())


@query(f"{M} SELECT id, access_count FROM memories ORDER BY access_count DESC, id LIMIT 20")
def access_top20(spark, sf):
    return candidates.access_top(memories(spark, sf))


@query("SELECT user_id AS id, max(ts) AS last_seen FROM events GROUP BY user_id ORDER BY last_seen DESC, id LIMIT 100")
def hot_list_topn(spark, sf):
    return candidates.hot_list(table(spark, sf, "events"), "user_id", "ts")


_TRIMMED = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


_GOOD_SQL = rf"(length({_TRIMMED}) >= 30 AND NOT starts_with({_TRIMMED}, 'http://') AND NOT starts_with({_TRIMMED}, 'https://') AND NOT regexp_full_match({_TRIMMED}, '[a-zA-Z0-9_.-]+') AND len(regexp_extract_all({_TRIMMED}, '\s')) >= 3)"


@query(f"SELECT doc_id, {_GOOD_SQL} AS good FROM documents")
def quality_gate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.good_result(F.col("text")).alias("good"))


@query(r"""SELECT conv_id, turn, length(trim(coalesce(text, ''))) < 15 OR len(regexp_extract_all(trim(coalesce(text, '')), '\s')) < 2
 OR (regexp_matches(trim(text), '^[a-z]') AND regexp_matches(lower(trim(text)), '\b(u|ur|tryna|wanna|gonna|idk|imma|dunno|lemme)\b'))
 OR regexp_matches(trim(text), '(?i)^(hm+|yea+h?|nah|yo|lol|haha|hmm+|huh|ok so|so yea)\b') AS low FROM conversations""")
def low_signal_gate(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.low_signal(F.col("text")).alias("low"))


def _scope(strict: bool, project: str):
    def run(spark, sf):
        return memories(spark, sf).filter(in_scope(project, strict, _DEFAULT) & is_valid()).groupBy("project").agg(F.count("*").alias("n"))

    return run


for _name, _strict, _p, _where in (("default", False, _DEFAULT, "true"), ("strict", True, _PROJECT, f"project = '{_PROJECT}'"), ("blend", False, _PROJECT, f"project IN ('{_PROJECT}', '{_DEFAULT}')")):
    _QUERIES[f"project_scope_{_name}"] = _scope(_strict, _p)
    _SQL[f"project_scope_{_name}"] = f"{M} SELECT project, count(*) AS n FROM memories WHERE {_where} AND (valid_to IS NULL OR valid_to > {T(NOW)}) GROUP BY project"

POOL = 60
_POOL_SQL = f"pool AS (SELECT *, {COS0} AS cos FROM memories WHERE embedding IS NOT NULL ORDER BY cos DESC, id LIMIT {POOL})"
_MM = "CASE WHEN max({v}) OVER () = min({v}) OVER () THEN 1.0 ELSE ({v} - min({v}) OVER ()) / (max({v}) OVER () - min({v}) OVER ()) END".format
_NORM_SQL = f"""damped AS (SELECT *, cos * greatest(0.75, 1 - 0.25 * greatest(0.0, sigma - {SIGMA_Q})) AS dc, greatest(0.0, 1 - {AGE.format(ts='last_accessed')} / 90) AS rec,
  least(1.0, ln(1 + access_count) / ln(51)) AS acc FROM pool),
 normed AS (SELECT *, {_MM(v='dc')} AS nc, {_MM(v='rec')} AS nr, {_MM(v='acc')} AS na FROM damped)"""
_PRIMARY_SQL = f"""{_NORM_SQL}, scored AS (SELECT *, (0.50 * nc + 0.27 * nr + 0.08 * na + CASE WHEN abs({AGE.format(ts='ts')} - 5) <= 2 THEN 0.35 * (1 - abs({AGE.format(ts='ts')} - 5) / 2) ELSE 0 END)
  * (1 - CASE WHEN memory_type = 'session' AND length(text) > 500 THEN least(0.15, 0.04 * log2(length(text) / 500.0)) ELSE 0 END)
  * least(1.4, greatest(0.7, 0.7 + 0.7 * exp(-(2 * (1 - greatest(nc, 0.0)) / ((sigma + {SIGMA_Q}) / 2) / 8 + ln(((sigma + {SIGMA_Q}) / 2) / sqrt(sigma * {SIGMA_Q})) / 2)))) AS ps FROM normed)"""


def _primary(spark, sf) -> DataFrame:
    pool = scoring.candidate_pool(memories(spark, sf), query_vector(spark, sf), POOL)
    return scoring.primary(pool, now(), SIGMA_Q, 5)


@query(f"{M}, {_POOL_SQL}, {_NORM_SQL} SELECT id, round(nc, 6) AS norm_cos FROM normed")
def minmax_cosine_batch(spark, sf):
    return _primary(spark, sf).select("id", F.round("norm_cos", 6).alias("norm_cos"))


@query(f"{M}, {_POOL_SQL}, {_PRIMARY_SQL} SELECT id, round(ps, 6) AS primary_score FROM scored")
def primary_score(spark, sf):
    return _primary(spark, sf).select("id", F.round("primary_score", 6).alias("primary_score"))


_ACT_SQL = f"""{_PRIMARY_SQL}, anchors AS (SELECT id AS a_id, embedding AS a_emb FROM scored ORDER BY ps DESC, id LIMIT 3),
 near AS (SELECT id, avg({DOT(a='embedding', b='a_emb')}) AS nb FROM scored, anchors WHERE id <> a_id GROUP BY id),
 active AS (SELECT s.*, (ps + 0.4 * coalesce(nb, 0) * greatest(0.0, 1 - sigma) * CASE WHEN contradiction THEN 0.3 ELSE 1 END + CASE WHEN memory_type = 'session' THEN 0.10 * nc ELSE 0 END
   + least(0.10, greatest(0.0, 0.10 * (1 - {AGE.format(ts='ts')} / 2)))) * CASE WHEN regexp_matches(text, '(?i)^(Edited:|Worked on .+edited|Ran:)') THEN 0.55 ELSE 1 END AS score FROM scored s LEFT JOIN near USING (id))"""


@query(f"{M}, {_POOL_SQL}, {_ACT_SQL} SELECT id, round(score, 6) AS score FROM active")
def spreading_activation(spark, sf):
    return scoring.activate(_primary(spark, sf), now(), SIGMA_Q, 5).select("id", F.round("score", 6).alias("score"))


@query(f"""{M}, {_POOL_SQL}, {_ACT_SQL}, ordered AS (SELECT id, sigma, round(score, 6) AS score, count_if(sigma <= 0.72) OVER () AS passed, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS r, count(*) OVER () AS n FROM active)
 SELECT id, score FROM ordered WHERE CASE WHEN passed >= 2 THEN sigma <= 0.72 ELSE r <= greatest(2, ceil(n / 2.0)) END""")
def sigma_gate(spark, sf):
    scored = spreading_activation(spark, sf).join(memories(spark, sf).select("id", "sigma"), "id")
    gate = max(0.65, 1.8 * SIGMA_Q)
    counted = scored.crossJoin(F.broadcast(scored.agg(F.count_if(F.col("sigma") <= gate).alias("passed"), F.count("*").alias("n"))))  # one row
    from pyspark.sql.window import Window

    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.when(F.col("passed") >= 2, F.col("sigma") <= gate).otherwise(F.col("r") <= F.greatest(F.lit(2), F.ceil(F.col("n") / 2)))).select("id", "score")


_HOP = """h{n} AS (SELECT id, max(cos) AS cos FROM (SELECT e.vec_id AS id, f.id AS fid, round({dot}, 6) AS cos, row_number() OVER (PARTITION BY f.id ORDER BY round({dot}, 6) DESC, e.vec_id) AS r
 FROM embeddings e, {src} f JOIN embeddings fe ON fe.vec_id = f.id WHERE e.vec_id IN (SELECT doc_id FROM documents)) WHERE r <= 3 AND cos >= 0.3 AND id NOT IN ({seen}) GROUP BY id)"""
_HDOT = DOT(a="e.embedding", b="fe.embedding")


@query(f"""WITH f0 AS (SELECT unnest([0, 1, 2]) AS id), {_HOP.format(n=1, dot=_HDOT, src='f0', seen='0, 1, 2')}, {_HOP.format(n=2, dot=_HDOT, src='h1', seen='SELECT id FROM f0 UNION SELECT id FROM h1')}
 SELECT id, round(cos * 0.6, 6) AS score FROM h1 UNION ALL SELECT id, round(cos * 0.36, 6) FROM h2""")
def bfs_two_hop(spark, sf):
    return scoring.two_hops(memories(spark, sf), [0, 1, 2], floor=0.3)


_ENT = "SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(text, '[A-Z][a-z]{8,}')) AS entity FROM documents"


@query(f"""WITH e AS ({_ENT}), m AS (SELECT entity, count(*) AS m FROM e GROUP BY entity)
 SELECT id, round(least(0.10, 0.03 * sum((m - 1) / log2(greatest(2, m)))), 6) AS bonus FROM e JOIN m USING (entity) GROUP BY id""")
def entity_cohesion(spark, sf):
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{8,})"), F.lit(1)))
    return scoring.cohesion_bonus(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(found).alias("entity")))


#: A query with a time cue and a name, and a vague one with neither; vectors stand in for an embedder.
ASK = "what did Ofonrereer change this week?"
ASK_VAGUE = "that thing with the tables again"


def _ask(spark, sf, sentence: str, names: list[str], project: str) -> retrieval.Ask:
    return retrieval.Ask(sentence, query_vector(spark, sf), 8, project, default=_DEFAULT, names=names, name_vectors=[query_vector(spark, sf, 1 + n) for n in range(len(names))], keywords=_TERMS, link_floor=0.3)


def _entities(spark, sf) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{8,})"), F.lit(1)))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("memory_id"), F.explode(found).alias("name"))


def _hot(spark, sf) -> DataFrame:
    return candidates.hot_list(table(spark, sf, "events"), "user_id", "ts")


def _hybrid_sql(sentence: str, names: list[str], project: str) -> str:
    """All six sources, their fusion and the score of every row of the pool."""
    sigma_q, days = kernels.query_sigma(sentence, len(names)), text.temporal_cue(sentence)
    k = kernels.pool_size(8, sigma_q)
    scope = "true" if project == _DEFAULT else f"project IN ('{project}', '{_DEFAULT}')"

    def near(name: str, vec_id: int, k: int) -> str:
        vector = f"(SELECT embedding FROM embeddings WHERE vec_id = {vec_id})"
        top = lambda where, n: f"(SELECT id, round({DOT(a='embedding', b=vector)}, 6) AS score FROM memories WHERE embedding IS NOT NULL AND {where} ORDER BY score DESC, id LIMIT {n})"
        both = top("true", k) if project == _DEFAULT else top(f"project = '{project}'", k) + " UNION ALL " + top(f"project = '{_DEFAULT}'", max(3, int(0.3 * k + 0.5)))
        return f"{name} AS (SELECT id, max(score) AS score FROM ({both}) GROUP BY id)"

    named = [near(f"name{n}", 1 + n, retrieval.ENTITY_MATCHES) for n in range(len(names))]
    boosts = " UNION ALL ".join(f"SELECT id, least(0.25, 0.5 / greatest(1, (SELECT count(*) FROM name{n}))) AS b FROM name{n}" for n in range(len(names))) or "SELECT 0 AS id, 0.0 AS b WHERE false"
    window = f"{AGE.format(ts='ts')} BETWEEN {max(0, (days or 0) - 1)} AND {(days or 0) + 2}" if days is not None else "false"
    accessed = "true" if sigma_q > 0.35 or not names else "false"
    listed = ", ".join(f"'{n}'" for n in names) or "''"
    boost = f"CASE WHEN abs({AGE.format(ts='ts')} - {days}) <= 2 THEN 0.35 * (1 - abs({AGE.format(ts='ts')} - {days}) / 2) ELSE 0 END" if days is not None else "0.0"
    return f"""{M}, {near('near', 0, k)}{''.join(', ' + n for n in named)},
 bt AS (SELECT id, project, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS terms FROM memories),
 bc AS (SELECT count(*) AS n, avg(len(terms)) AS avg_len FROM bt), bp AS (SELECT id, project, len(terms) AS length, unnest(terms) AS term FROM bt),
 bh AS (SELECT id, project, length, term, count(*) AS tf FROM bp WHERE term IN ('the', 'of', 'and') GROUP BY 1, 2, 3, 4), bd AS (SELECT term, count(*) AS df FROM bh GROUP BY term),
 words AS (SELECT id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_len))), 6) AS score FROM bh JOIN bd USING (term), bc WHERE {scope} GROUP BY id HAVING count(*) = 3 ORDER BY score DESC, id LIMIT 32),
 rr AS (SELECT id, sum(1.0 / (60 + r)) AS rrf FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM near UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM words) GROUP BY id),
 fused AS (SELECT id, row_number() OVER (ORDER BY round(rrf, 12) DESC, id) AS r FROM rr QUALIFY r <= 32),
 th AS (SELECT id, ts, memory_type FROM memories WHERE {scope} AND {window}),
 tt AS (SELECT DISTINCT id, ts FROM ((SELECT * FROM th ORDER BY ts DESC, id LIMIT 20) UNION ALL (SELECT * FROM th WHERE memory_type = 'session' ORDER BY ts DESC, id LIMIT 10))),
 hot AS (SELECT user_id AS id, max(ts) AS seen FROM events GROUP BY user_id ORDER BY seen DESC, id LIMIT 100),
 only_hot AS (SELECT id, row_number() OVER (ORDER BY seen DESC, id) AS r FROM hot WHERE id NOT IN (SELECT id FROM fused) QUALIFY r <= 10),
 only_time AS (SELECT id, row_number() OVER (ORDER BY ts DESC, id) AS r FROM tt WHERE id NOT IN (SELECT id FROM fused)),
 only_access AS (SELECT id, row_number() OVER (ORDER BY access_count DESC, id) AS r FROM (SELECT id, access_count FROM memories WHERE {scope} AND {accessed} ORDER BY access_count DESC, id LIMIT 20) WHERE id NOT IN (SELECT id FROM near)),
 placed AS (SELECT id, min(p) AS p FROM (SELECT id, r AS p FROM only_hot UNION ALL SELECT id, 100 + r FROM only_time WHERE r <= 15 UNION ALL SELECT id, 200 + row_number() OVER (ORDER BY score DESC, id) FROM near
   UNION ALL SELECT id, 400 + r FROM fused WHERE id NOT IN (SELECT id FROM near) UNION ALL SELECT id, 600 + r FROM only_access) GROUP BY id ORDER BY p LIMIT 120),
 edges AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(text, '[A-Z][a-z]{{8,}}')) AS entity FROM documents WHERE doc_id IN (SELECT id FROM placed)),
 shared AS (SELECT id, least(0.2, 0.1 * count(*)) AS b FROM edges WHERE entity IN ({listed}) GROUP BY id),
 ties AS (SELECT id, round(least(0.10, 0.03 * sum((m - 1) / log2(greatest(2, m)))), 6) AS bonus FROM edges JOIN (SELECT entity, count(*) AS m FROM edges GROUP BY entity) USING (entity) GROUP BY id),
 boosts AS (SELECT id, sum(b) AS b FROM ({boosts} UNION ALL SELECT * FROM shared) GROUP BY id),
 raw AS (SELECT m.*, coalesce(near.score, 0.0) AS cos, near.id IS NOT NULL AS is_near, coalesce(words.score, 0.0) AS bm25, coalesce(rr.rrf, 0.0) AS rrf, CAST(coalesce(boosts.b, 0.0) AS DOUBLE) AS entity, CAST(coalesce(ties.bonus, 0.0) AS DOUBLE) AS cohesion,
   CASE WHEN near.id IS NULL AND m.id IN (SELECT id FROM only_time) THEN 0.5 WHEN m.id IN (SELECT id FROM only_access) THEN 0.35 END AS given
   FROM memories m JOIN placed USING (id) LEFT JOIN near ON near.id = m.id LEFT JOIN words ON words.id = m.id LEFT JOIN rr ON rr.id = m.id LEFT JOIN boosts ON boosts.id = m.id LEFT JOIN ties ON ties.id = m.id
   WHERE {scope.replace('project', 'm.project')} AND (valid_to IS NULL OR valid_to > {T(NOW)}) AND {_GOOD_SQL}),
 d AS (SELECT *, cos * greatest(0.75, 1 - 0.25 * greatest(0.0, sigma - {sigma_q!r})) AS dc, greatest(0.0, 1 - {AGE.format(ts='last_accessed')} / 90) AS rec, least(1.0, ln(1 + access_count) / ln(51)) AS acc FROM raw),
 real AS (SELECT min(dc) AS low, max(dc) AS high FROM d WHERE given IS NULL),
 n AS (SELECT d.*, CASE WHEN given IS NOT NULL THEN given WHEN high = low THEN 1.0 ELSE (dc - low) / (high - low) END AS nc, {_MM(v='rec')} AS nr, {_MM(v='acc')} AS na, CASE WHEN max(bm25) OVER () = 0 THEN 0.0 ELSE {_MM(v='bm25')} END AS nb FROM d, real)
 SELECT id, is_near, round(nc, 6) AS norm_cos, round(nb, 6) AS norm_bm25, round(rrf, 8) AS rrf, round(entity, 6) AS entity, cohesion,
  round((0.50 * nc + 0.15 * nb + 0.27 * nr + 0.08 * na + least(entity, 0.25) + least(6 * rrf, 0.1) + CASE WHEN nc >= 0.4 THEN cohesion ELSE 0 END + {boost})
  * (1 - CASE WHEN memory_type = 'session' AND length(text) > 500 THEN least(0.15, 0.04 * log2(length(text) / 500.0)) ELSE 0 END)
  * least(1.4, greatest(0.7, 0.7 + 0.7 * exp(-(2 * (1 - greatest(nc, 0.0)) / ((sigma + {sigma_q!r}) / 2) / 8 + ln(((sigma + {sigma_q!r}) / 2) / sqrt(sigma * {sigma_q!r})) / 2)))), 6) AS primary_score FROM n"""


def _hybrid(spark, sf, sentence: str, names: list[str], project: str) -> DataFrame:
    m, ask = memories(spark, sf), _ask(spark, sf, sentence, names, project)
    found = retrieval.gather(m, ask, now(), _hot(spark, sf))
    scored = scoring.primary(retrieval.pool(m, ask, found, now(), _entities(spark, sf)), now(), ask.sigma, ask.days)
    rounded = lambda c, n=6: F.round(c, n).alias(c)
    return scored.select("id", "is_near", rounded("norm_cos"), rounded("norm_bm25"), rounded("rrf", 8), rounded("entity"), "cohesion", rounded("primary_score"))


@query(_hybrid_sql(ASK, ["Ofonrereer"], _PROJECT))
def hybrid_pool(spark, sf):
    return _hybrid(spark, sf, ASK, ["Ofonrereer"], _PROJECT)


@query(_hybrid_sql(ASK_VAGUE, [], _DEFAULT))
def hybrid_pool_vague(spark, sf):
    return _hybrid(spark, sf, ASK_VAGUE, [], _DEFAULT)


@query()
def retrieve_full(spark, sf):
    return retrieval.retrieve(memories(spark, sf), _ask(spark, sf, ASK, ["Ofonrereer"], _PROJECT), now(), _entities(spark, sf), _hot(spark, sf))


@query(f"""{M}, u AS ((SELECT id, round({COS0}, 6) AS score FROM memories WHERE embedding IS NOT NULL ORDER BY score DESC, id LIMIT 10)
 UNION ALL (SELECT id, round({DOT(a='embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 1)')}, 6) AS score FROM memories WHERE embedding IS NOT NULL ORDER BY score DESC, id LIMIT 6)
 UNION ALL (SELECT id, round({DOT(a='embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 2)')}, 6) AS score FROM memories WHERE embedding IS NOT NULL ORDER BY score DESC, id LIMIT 6)),
 b AS (SELECT id, max(score) AS score FROM u WHERE score >= 0.2 GROUP BY id), k AS (SELECT b.*, substr(text, 1, 80) AS head, memory_type FROM b JOIN memories USING (id)),
 d AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY score DESC, id) AS first FROM k QUALIFY first = 1),
 s AS (SELECT *, row_number() OVER (PARTITION BY memory_type ORDER BY score DESC, id) AS nth FROM d)
 SELECT id, score FROM s WHERE memory_type <> 'session' OR nth <= 3 ORDER BY score DESC, id LIMIT 12""")
def multi_query_merge(spark, sf):
    from pyspark.sql.window import Window

    m = memories(spark, sf)
    three = [candidates.cosine_topk(m, query_vector(spark, sf, v), k) for v, k in ((0, 10), (1, 6), (2, 6))]
    best = three[0].unionByName(three[1]).unionByName(three[2]).filter("score >= 0.2").groupBy("id").agg(F.max("score").alias("score"))
    heads = best.join(m.select("id", F.substring("text", 1, 80).alias("head"), "memory_type"), "id")
    order = lambda c: Window.partitionBy(c).orderBy(F.desc("score"), "id")
    once = heads.withColumn("n", F.row_number().over(order("head"))).filter("n = 1").withColumn("n", F.row_number().over(order("memory_type")))
    return once.filter("memory_type <> 'session' OR n <= 3").select("id", "score").orderBy(F.desc("score"), "id").limit(12)


# -- maintenance -----------------------------------------------------------------------------

_MAGE = "(date_diff('second', {ts}, " + T(NOW_MAINT) + ") / 86400.0)"


@query(f"""{M}, d AS (SELECT id, round(sigma + 0.02 / (1 + ln(access_count + 1)) * CASE WHEN access_count = 0 AND {_MAGE.format(ts='last_accessed')} > 7 THEN 3 ELSE 1 END, 6) AS new_sigma FROM memories)
 SELECT id, new_sigma, new_sigma > 2.0 AS pruned FROM d""")
def decay_pass(spark, sf):
    return maintenance.decay_pass(memories(spark, sf), now(NOW_MAINT))


@query(f"{M} SELECT id FROM memories WHERE access_count = 0 AND memory_type = 'episodic' AND length(text) < 400 AND {_MAGE.format(ts='ts')} > 30")
def prune_junk(spark, sf):
    return maintenance.junk(memories(spark, sf), now(NOW_MAINT), 400).select("id")


@query(f"{M} SELECT id, ts FROM memories WHERE access_count = 0 AND memory_type NOT IN ('session', 'decision') AND {_MAGE.format(ts='ts')} > 30 AND sigma > 1.5 ORDER BY ts, id LIMIT 100")
def cold_archive(spark, sf):
    return maintenance.cold(memories(spark, sf), now(NOW_MAINT)).select("id", "ts")


@query(f"{M}, k AS (SELECT id, first_value(id) OVER (PARTITION BY text ORDER BY access_count DESC, round(sigma, 6), ts, id) AS keeper, count(*) OVER (PARTITION BY text) AS n FROM memories) SELECT id, keeper FROM k WHERE n > 1")
def exact_dedupe_keepers(spark, sf):
    return maintenance.exact_keepers(memories(spark, sf))


@query(rf"{M}, t AS (SELECT *, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS k FROM memories), k AS (SELECT id, first_value(id) OVER (PARTITION BY k ORDER BY access_count DESC, round(sigma, 6), ts, id) AS keeper, count(*) OVER (PARTITION BY k) AS n FROM t) SELECT id, keeper FROM k WHERE n > 1")
def normalized_dedupe(spark, sf):
    return maintenance.normalised_keepers(memories(spark, sf))


@query(f"{M} SELECT a.id AS a, b.id AS b, round({DOT(a='a.embedding', b='b.embedding')}, 6) AS cos FROM memories a JOIN memories b ON a.domain = b.domain AND a.id < b.id WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL AND round({DOT(a='a.embedding', b='b.embedding')}, 6) > 0.35")
def near_dup_pairs(spark, sf):
    return similarity.theta_pairs(memories(spark, sf), "domain", 0.35)


@query(f"""WITH RECURSIVE {memories_cte()}, p AS (SELECT a.id AS a, b.id AS b FROM memories a JOIN memories b ON a.domain = b.domain AND a.id <> b.id WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL AND round({DOT(a='a.embedding', b='b.embedding')}, 6) > 0.35),
 r AS (SELECT a AS id, a AS root FROM p UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id) SELECT id, min(root) AS root FROM r GROUP BY id""")
def near_dup_groups(spark, sf):
    return similarity.connected(similarity.theta_links(memories(spark, sf), "domain", 0.35))


@query(f"""{M}, n AS (SELECT a.id, b.id AS other, round({DOT(a='a.embedding', b='b.embedding')}, 6) AS cos FROM memories a JOIN memories b ON a.project = b.project AND a.id <> b.id WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL)
 SELECT id, row_number() OVER (PARTITION BY id ORDER BY cos DESC, other) AS rank, other, cos FROM n QUALIFY rank <= 3""")
def knn_same_project(spark, sf):
    return similarity.knn(memories(spark, sf), "project", 3)


def _dedup_sql(scanned: str, place: str) -> str:
    """Scanned rows with a neighbour that is not scanned or comes later in the scan."""
    return f"""{M}, p AS (SELECT id, project, embedding, {scanned} AS scanned, CASE WHEN {scanned} THEN {place} ELSE 9223372036854775807 END AS place FROM memories WHERE embedding IS NOT NULL)
 SELECT DISTINCT a.id FROM p a JOIN p b ON a.project = b.project AND a.id <> b.id AND a.scanned AND (b.place > a.place OR (b.place = a.place AND b.id > a.id)) WHERE round({DOT(a='a.embedding', b='b.embedding')}, 6) >= 0.3"""


@query(_dedup_sql("ts >= TIMESTAMP '2024-01-08'", "-epoch_us(ts)"))
def recent_dedup(spark, sf):
    recent = F.col("ts") >= F.lit("2024-01-08").cast("timestamp")
    return maintenance.near_duplicates_to_drop(memories(spark, sf), recent, 0.3, True)


@query(_dedup_sql("access_count = 0", "epoch_us(ts)"))
def cold_dedup(spark, sf):
    return maintenance.near_duplicates_to_drop(memories(spark, sf), F.col("access_count") == 0, 0.3, False)


_CENT = "c AS (SELECT label, d, sum(x) AS s, count(*) AS n FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY 1, 2), l AS (SELECT label, sqrt(sum(s * s)) AS norm FROM c GROUP BY label), a AS (SELECT 'c' || label AS name, list(s / norm ORDER BY d) AS emb FROM c JOIN l USING (label) GROUP BY label)"


def _anchors(spark, sf):
    c = similarity.centroids(table(spark, sf, "embeddings"), "label")
    return c.select(F.concat(F.lit("c"), F.col("label")).alias("name"), "emb")


@query(f"WITH {_CENT} SELECT label, d, round(s / norm, 6) AS x, n FROM c JOIN l USING (label)")
def anchor_centroids(spark, sf):
    c = similarity.centroids(table(spark, sf, "embeddings"), "label")
    return c.select("label", F.posexplode("emb").alias("d", "x"), F.col("cnt").alias("n")).select("label", (F.col("d") + 1).cast("long").alias("d"), F.round("x", 6).alias("x"), "n")


_NEAR = f"b AS (SELECT m.id, name, round({DOT(a='m.embedding', b='emb')}, 6) AS cos, row_number() OVER (PARTITION BY m.id ORDER BY round({DOT(a='m.embedding', b='emb')}, 6) DESC, name) AS r FROM memories m, a WHERE m.embedding IS NOT NULL QUALIFY r = 1)"


@query(f"{M}, {_CENT}, {_NEAR} SELECT id, name, cos FROM b")
def nearest_anchor(spark, sf):
    return similarity.nearest_anchor(memories(spark, sf), _anchors(spark, sf))


@query(f"{M}, {_CENT}, {_NEAR} SELECT id, cos, CASE WHEN cos >= 0.15 THEN name ELSE 'general' END AS target FROM b")
def targeted_reclass(spark, sf):
    return maintenance.remap(similarity.nearest_anchor(memories(spark, sf), _anchors(spark, sf)), 0.15)


@query(f"""{M}, {_CENT}, g AS (SELECT id, CASE WHEN id % 7 = 0 THEN project || '-new' ELSE project END AS g FROM memories), few AS (SELECT g FROM g GROUP BY g HAVING count(*) < (SELECT count(*) // 40 FROM memories)), {_NEAR}
 SELECT id, cos, CASE WHEN cos >= 0.15 THEN name ELSE 'general' END AS target FROM b WHERE id IN (SELECT id FROM g WHERE g IN (SELECT g FROM few))""")
def singleton_remap(spark, sf):
    m = memories(spark, sf).withColumn("domain", F.when(F.col("id") % 7 == 0, F.concat("project", F.lit("-new"))).otherwise(F.col("project")))
    few = m.join(maintenance.singleton_domains(m, m.count() // 40), "domain", "left_semi")
    return maintenance.remap(similarity.nearest_anchor(few, _anchors(spark, sf)), 0.15)


@query()
def leader_micros(spark, sf):
    return clustering.rebuild(memories(spark, sf), 0.3, 0.12, 0.10)


@query()
def upgma_curve(spark, sf):
    return clustering.curve(memories(spark, sf), 0.3, 0.10, [0.10, 0.12, 0.15, 0.18, 0.20])


# -- domains ---------------------------------------------------------------------------------

_SIMS = f"sims AS (SELECT m.id, m.project, name, round({DOT(a='m.embedding', b='emb')}, 6) AS sim FROM memories m, a WHERE m.embedding IS NOT NULL)"
#: Stands in for a classifier: every third record asks for a domain of its own, the others for the second nearest offered.
_CHOICE = lambda said, offered: F.when(F.char_length(said) % 3 == 0, "own-domain").otherwise(F.get(offered, 1))


def _counted_anchors(spark, sf):
    c = similarity.centroids(table(spark, sf, "embeddings"), "label")
    return c.select(F.concat(F.lit("c"), F.col("label")).alias("name"), "emb", F.col("cnt").alias("memory_count"))


@query(f"""{M}, {_CENT}, {_SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, name) AS r FROM sims),
 k AS (SELECT id, max(sim) FILTER (r = 1) AS best, max(name) FILTER (r = 1) AS first, max(name) FILTER (r = 2 AND sim >= 0.15) AS second FROM r GROUP BY id)
 SELECT k.id, CASE WHEN best >= 0.25 THEN first WHEN length(text) % 3 = 0 THEN 'own-domain' WHEN second IS NOT NULL THEN second WHEN best >= 0.15 THEN first ELSE 'general' END AS domain,
  best < 0.25 AND length(text) % 3 = 0 AS mint FROM k JOIN memories USING (id)""")
def domain_choice(spark, sf):
    return domains.classify(memories(spark, sf), _anchors(spark, sf), _CHOICE, 0.25, 0.15)


@query(f"""{M}, {_CENT}, {_SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, name) AS r FROM sims),
 k AS (SELECT id, max(sim) FILTER (r = 1) AS best, max(name) FILTER (r = 1) AS first, max(name) FILTER (r = 2) AS second FROM r GROUP BY id)
 SELECT k.id, CASE WHEN best < 0.15 THEN 'general' WHEN best >= 0.25 OR length(text) % 3 = 0 THEN first ELSE second END AS domain FROM k JOIN memories USING (id)""")
def domain_batch(spark, sf):
    return domains.classify_batch(memories(spark, sf), _anchors(spark, sf), _CHOICE, 0.25, 0.15)


@query(f"""{M}, {_CENT}, {_NEAR}, n AS (SELECT label, 'c' || label AS name, count(*) AS n FROM embeddings GROUP BY label),
 h AS (SELECT name, d, sum(x) AS s, count(*) AS k FROM (SELECT b.name, unnest(CAST(m.embedding AS DOUBLE[])) AS x, generate_subscripts(m.embedding, 1) AS d FROM b JOIN memories m USING (id) WHERE m.project = '{_PROJECT}') GROUP BY 1, 2),
 v AS (SELECT n.name, c.d, CASE WHEN h.k IS NULL THEN c.s / l.norm ELSE (c.s / l.norm * n.n + h.s) / (n.n + h.k) END AS x, n.n + coalesce(h.k, 0) AS m, h.k IS NOT NULL AS moved FROM c JOIN l USING (label) JOIN n USING (label) LEFT JOIN h ON h.name = n.name AND h.d = c.d),
 z AS (SELECT name, sqrt(sum(x * x)) AS norm FROM v GROUP BY name) SELECT name, d, round(CASE WHEN moved THEN x / norm ELSE x END, 6) AS x, m AS memory_count FROM v JOIN z USING (name)""")
def centroid_update(spark, sf):
    m, anchors = memories(spark, sf).filter(F.col("project") == _PROJECT), _counted_anchors(spark, sf)
    hits = similarity.nearest_anchor(m, anchors).join(m.select("id", "embedding"), "id").select("id", "name", "embedding")
    new = domains.update_centroids(anchors, hits)
    return new.select("name", "memory_count", F.posexplode("emb").alias("d", "x")).select("name", (F.col("d") + 1).cast("long").alias("d"), F.round("x", 6).alias("x"), "memory_count")


@query(f"""{M}, {_CENT}, {_NEAR} SELECT id, CASE WHEN cos >= 0.3 THEN name ELSE 'new-' || id END AS cluster_id, cos < 0.3 AS is_new, CASE WHEN cos >= 0.3 THEN cos ELSE -1.0 END AS sim FROM b""")
def micro_assign(spark, sf):
    micros = similarity.centroids(table(spark, sf, "embeddings"), "label").select(F.concat(F.lit("c"), F.col("label")).alias("cluster_id"), "sum", F.col("cnt").alias("count"))
    return domains.assign_micros(memories(spark, sf), micros, 0.3)


@query(f"""{M}, h AS (SELECT *, ts > {T(NOW)} - INTERVAL 20 DAY AS recent, max(ts > {T(NOW)} - INTERVAL 20 DAY) OVER (PARTITION BY project) AS has FROM memories),
 r AS (SELECT project AS domain, id, has, row_number() OVER (PARTITION BY project ORDER BY access_count DESC, CASE WHEN has THEN ts END DESC, id) AS rank FROM h WHERE recent OR NOT has) SELECT domain, CAST(rank AS INTEGER) AS rank, id FROM r WHERE rank <= CASE WHEN has THEN 15 ELSE 10 END""")
def summary_inputs(spark, sf):
    m = memories(spark, sf).drop("domain").withColumnRenamed("project", "domain")
    return domains.summary_inputs(m, now(), 20)


@query(f"""{M}, a AS (SELECT project AS name, count(*) AS n, CASE WHEN project < 'src15' THEN count(*) * 4 // 5 ELSE 0 END AS last FROM memories WHERE id % 10 <> 0 GROUP BY project),
 g AS (SELECT * FROM a WHERE n >= 5 ORDER BY n DESC, name LIMIT 10) SELECT name, count(*) AS actual FROM g JOIN memories ON project = name GROUP BY name, last HAVING last = 0 OR count(*) > last * 1.2""")
def stale_summaries(spark, sf):
    m = memories(spark, sf).drop("domain").withColumnRenamed("project", "domain")
    then = m.filter("id % 10 <> 0").groupBy(F.col("domain").alias("name")).agg(F.count("*").alias("memory_count"))
    last = F.when(F.col("name") < "src15", F.floor(F.col("memory_count") * 4 / 5)).otherwise(0)
    return domains.stale_summaries(m, then.withColumn("last_summarized_count", last), most=10)


@query(f"{M}, r AS (SELECT id, row_number() OVER (ORDER BY access_count DESC, last_accessed DESC, id) AS rank FROM memories WHERE memory_type = 'semantic') SELECT id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20")
def identity_inputs(spark, sf):
    return domains.identity_inputs(memories(spark, sf)).select("id", "rank")


@query(f"{M} SELECT id FROM memories WHERE domain = 'en' OR domain NOT IN ('fr', 'de')")
def unanchored(spark, sf):
    m = memories(spark, sf).withColumn("domain", F.when(F.col("domain") == "en", domains.GENERAL).otherwise(F.col("domain")))
    return domains.unanchored(m, spark.createDataFrame([("fr",), ("de",)], "name string")).select("id")


# -- clients ---------------------------------------------------------------------------------


@query(r"""SELECT conv_id, turn, coalesce(length(text) < 80 OR regexp_matches(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '(?i)^(call |run |check |show |list |get |what |how |why |do |can |is |ok|yea|nah|hm|sure|nice|done|yes|no|lol|wait|so |and |but )'), true) AS skipped FROM conversations""")
def chat_skip(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", client.skipped_turn(F.col("text")).alias("skipped"))


@query(r"""WITH w AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: length(x) > 3) AS w, CASE WHEN turn % 2 = 0 THEN 'default' ELSE 'src3' END AS p FROM conversations WHERE role = 'user'),
 l AS (SELECT *, array_to_string(w[greatest(1, len(w) - 5):], ' ') AS l FROM w)
 SELECT conv_id, turn, CASE WHEN length(text) >= 25 THEN text WHEN l <> '' THEN CASE WHEN p = 'default' THEN l ELSE p || ' ' || l END WHEN p = 'default' THEN 'recent context decisions' ELSE p || ' recent work decisions' END AS q1,
  CASE WHEN p = 'default' THEN trim(l || ' recent context decisions') ELSE p || ' recent decisions outcomes' END AS q2,
  CASE WHEN p = 'default' THEN trim(l || ' outcomes preferences') ELSE p || ' conventions preferences procedural how to work' END AS q3 FROM l""")
def routed_queries(spark, sf):
    asked = table(spark, sf, "conversations").filter("role = 'user'")
    q = client.routed_queries(F.col("text"), F.when(F.col("turn") % 2 == 0, "default").otherwise("src3"))
    return asked.select("conv_id", "turn", q.alias("q")).select("conv_id", "turn", *[F.get("q", n).alias(f"q{n + 1}") for n in range(3)])


@query(f"{M}, {_POOL_SQL}, {_ACT_SQL} SELECT count_if(score >= 1.10) AS high, count_if(score >= 0.95 AND score < 1.10) AS mid, count_if(score >= 0.70 AND score < 0.95) AS low FROM active")
def receipt_buckets(spark, sf):
    return scoring.activate(_primary(spark, sf), now(), SIGMA_Q, 5).agg(*client.score_buckets(F.col("score")))


@query(f"""WITH v AS (SELECT user_id % 97 AS key, event_id AS value, ts AS written, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 86400 * (event_id % 40) END AS ttl FROM events),
 l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY written DESC, value DESC) AS n FROM v) SELECT key, value FROM l WHERE n = 1 AND (ttl IS NULL OR {T(NOW)} < written + ttl * INTERVAL 1 SECOND)""")
def live_values(spark, sf):
    ttl = F.when(F.col("event_id") % 3 != 0, 86400 * (F.col("event_id") % 40))
    v = table(spark, sf, "events").select((F.col("user_id") % 97).alias("key"), F.col("event_id").alias("value"), F.col("ts").alias("written"), ttl.alias("ttl"))
    return state_tables.live_values(v, now()).select("key", "value")


# -- ordered folds ---------------------------------------------------------------------------

_FOLD_SQL = f"o AS (SELECT id, memory_type AS t, CAST(embedding AS DOUBLE[]) AS e, cluster_id AS c, row_number() OVER (ORDER BY round(cos, 6) DESC, id) AS r FROM pool)"


def _fold(spark, sf, keep) -> DataFrame:
    """Rows of the pool that an ordered fold keeps, in one task (the pool is bounded)."""
    import pandas as pd

    pool = scoring.candidate_pool(memories(spark, sf), query_vector(spark, sf), POOL).select("id", F.round("cos", 6).alias("score"), "text", F.col("memory_type").alias("type"), "sigma", F.col("cluster_id").cast("string").alias("cluster_id"), F.col("embedding").alias("vector"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf.to_dict("records"), key=lambda r: (-r["score"], r["id"]))
        return pd.DataFrame({"id": [r["id"] for r in keep(rows)]}, dtype="int64")

    return pool.groupBy(F.lit(0).alias("pool")).applyInPandas(run, "id long")


@query(f"""WITH RECURSIVE {memories_cte()}, {_POOL_SQL}, {_FOLD_SQL},
 f AS (SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS id, false AS kept, CAST([] AS VARCHAR[]) AS ts, CAST([] AS INTEGER[]) AS cs
  UNION ALL SELECT o.r, o.id, k, CASE WHEN k THEN list_append(ts, o.t) ELSE ts END, CASE WHEN k THEN list_append(cs, o.c) ELSE cs END
  FROM (SELECT f.ts, f.cs, o.*, len(list_filter(f.ts, lambda x: x = o.t)) < CASE WHEN o.t = 'session' THEN 2 ELSE 7 END AND (o.c IS NULL OR len(list_filter(f.cs, lambda x: x = o.c)) < 3) AS k FROM f JOIN o ON o.r = f.r + 1) o)
 SELECT id FROM f WHERE kept""")
def diversity_cap(spark, sf):
    return _fold(spark, sf, tail.diversity_cap)


@query(f"""WITH RECURSIVE {memories_cte()}, {_POOL_SQL}, {_FOLD_SQL},
 f AS (SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS id, false AS kept, CAST([] AS DOUBLE[][]) AS vs
  UNION ALL SELECT r, id, k, CASE WHEN k THEN list_append(vs, e) ELSE vs END
  FROM (SELECT f.vs, o.*, len(list_filter(f.vs, lambda v: list_inner_product(v, o.e) >= 0.35)) = 0 AS k FROM f JOIN o ON o.r = f.r + 1))
 SELECT id FROM f WHERE kept""")
def greedy_dedup(spark, sf):
    return _fold(spark, sf, lambda rows: tail.dedup(rows, 0.35))


# -- reports ---------------------------------------------------------------------------------


@query(f"{M} SELECT domain, memory_type, count(*) AS n, round(avg(sigma), 6) AS avg_sigma, count_if(contradiction) AS contradictions FROM memories GROUP BY GROUPING SETS ((domain), (memory_type), ())")
def stats_grouping_sets(spark, sf):
    return analytics.stats(memories(spark, sf))


@query(f"{M} SELECT domain, count(*) AS n FROM memories GROUP BY domain")
def stats_by_domain(spark, sf):
    return memories(spark, sf).groupBy("domain").agg(F.count("*").alias("n"))


@query(f"{M} SELECT count_if(sigma < 0.3) AS sharp, count_if(sigma >= 0.3 AND sigma < 0.8) AS clear, count_if(sigma >= 0.8 AND sigma < 1.8) AS vague, count_if(sigma >= 1.8) AS fading, count_if(access_count > 50) AS hot, count_if(access_count > 0 AND access_count <= 50) AS warm, count_if(access_count = 0) AS cold FROM memories")
def stats_sigma_buckets(spark, sf):
    return analytics.sigma_buckets(memories(spark, sf))


_LIST = f"{M} SELECT id, domain, memory_type, ts, access_count, last_accessed, round(sigma, 6) AS sigma, substr(text, 1, 80) AS head FROM memories"


@query(f"{_LIST} ORDER BY ts DESC, id LIMIT 50")
def list_recent(spark, sf):
    return analytics.listing(memories(spark, sf))


@query(f"{_LIST} ORDER BY round(sigma, 6), id LIMIT 50")
def list_sigma(spark, sf):
    return analytics.listing(memories(spark, sf), "sigma")


_EDGES = f"p AS (SELECT a.id AS a, b.id AS b, a.ts AS ta, b.ts AS tb, round({DOT(a='a.embedding', b='b.embedding')}, 6) AS cos FROM memories a JOIN memories b ON a.domain = b.domain AND a.id < b.id WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL AND round({DOT(a='a.embedding', b='b.embedding')}, 6) > 0.3), e AS (SELECT CASE WHEN ta <= tb THEN b ELSE a END AS from_id, CASE WHEN ta <= tb THEN a ELSE b END AS to_id, CASE WHEN cos >= 0.38 THEN 'supersedes' ELSE 'conflicts_with' END AS relation_type FROM p)"


@query(f"{M}, {_EDGES} SELECT * FROM e")
def supersede_direction(spark, sf):
    m = memories(spark, sf)
    return analytics.relations(similarity.theta_pairs(m, "domain", 0.3), m, 0.38)


@query(f"""{M}, {_EDGES}, n AS (SELECT * FROM memories ORDER BY ts DESC, id LIMIT 50)
 SELECT id, ts, strftime(ts, '%Y-%m') AS month, CASE WHEN id IN (SELECT to_id FROM e WHERE relation_type = 'supersedes') THEN '[SUPERSEDED]' WHEN id IN (SELECT from_id FROM e WHERE relation_type = 'conflicts_with' UNION SELECT to_id FROM e WHERE relation_type = 'conflicts_with') THEN '[CONFLICT]' WHEN contradiction THEN '[FLAGGED]' ELSE '' END AS mark FROM n""")
def timeline_marked(spark, sf):
    m = memories(spark, sf)
    newest = m.orderBy(F.desc("ts"), "id").limit(50)
    touching = similarity.cross_pairs(newest, m, "domain", 0.3).filter("a <> b")  # only pairs of the rows that are shown
    pairs = touching.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cos").distinct()
    return analytics.timeline(m, analytics.relations(pairs, m, 0.38), 50)


_HIST = "h AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, ts FROM events), s AS (SELECT id, n, greatest(0.5 * power(0.85, n), 0.15) AS sigma FROM h)"


@query(f"""WITH {_HIST}, g AS (SELECT id, round(arg_min(sigma, n), 6) AS first_sigma, round(arg_max(sigma, n), 6) AS last_sigma, count(*) AS steps FROM s GROUP BY id), d AS (SELECT *, round(first_sigma - last_sigma, 6) AS drop FROM g)
 SELECT *, CASE WHEN drop > 0.3 THEN 'strongly reinforced — confident belief' WHEN drop > 0.15 THEN 'sharpening — belief gaining confidence' WHEN drop > 0.05 THEN 'slightly reinforced'
 WHEN drop < -0.1 THEN 'fading — belief losing confidence' ELSE 'stable — unchanged since storage' END AS verdict FROM d""")
def belief_drift(spark, sf):
    return analytics.drift(analytics.history(table(spark, sf, "events")))


@query(f"""{M}, x AS (SELECT id, sigma, greatest(1, least(access_count, 5)) AS n FROM memories WHERE id NOT IN (SELECT user_id FROM events)), y AS (SELECT id, sigma, n, unnest(range(0, n + 1)) AS step FROM x)
 SELECT id, CAST(step AS INTEGER) AS step, round(0.5 - (0.5 - sigma) * step / n, 4) AS sigma FROM y""")
def drift_backfill(spark, sf):
    return analytics.backfill(memories(spark, sf), analytics.history(table(spark, sf, "events")))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def orphan_check(spark, sf):
    return analytics.orphans(table(spark, sf, "documents").withColumnRenamed("doc_id", "id"), table(spark, sf, "embeddings"))


@query(f"{M} SELECT cluster_id, memory_type, count(*) AS n, round(avg(access_count), 6) AS avg_access FROM memories WHERE cluster_id IS NOT NULL GROUP BY 1, 2")
def cluster_galaxy(spark, sf):
    return analytics.galaxy(memories(spark, sf))


# -- writes ----------------------------------------------------------------------------------


@query(f"""{M}, b AS (SELECT * FROM memories WHERE id % 7 = 0), s AS (SELECT * FROM memories WHERE id % 7 <> 0),
 c AS (SELECT b.id AS new_id, s.id AS old_id, round({DOT(a='b.embedding', b='s.embedding')}, 6) AS cos, b.sigma AS x, s.sigma AS y, b.memory_type, b.cluster_id = s.cluster_id AS together FROM b JOIN s ON b.project = s.project WHERE b.embedding IS NOT NULL AND s.embedding IS NOT NULL),
 k AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY cos DESC, old_id) AS r FROM c WHERE cos > 0.1 QUALIFY r <= 10)
 SELECT new_id, old_id, cos, (cos >= CASE WHEN coalesce(together, false) THEN -2.0 WHEN memory_type = 'session' THEN 0.40 ELSE 0.45 END) AND 64 / 2.0 * ln(((x + y) / 2 + 1e-7) / (sqrt(x * y) + 1e-7)) < CASE WHEN coalesce(together, false) THEN 0.20 ELSE 0.08 END AS merges FROM k""")
def merge_decision(spark, sf):
    m = memories(spark, sf)
    new, old = m.filter("id % 7 = 0"), m.filter("id % 7 <> 0")
    near = writes.candidates(new, old, 0.1)
    side = lambda d, n, p: d.select(F.col("id").alias(n), *[F.col(c).alias(f"{p}_{c}") for c in ("sigma", "cluster_id", "memory_type")])
    both = near.join(side(new, "new_id", "n"), "new_id").join(side(old, "old_id", "o"), "old_id")
    together = F.coalesce(F.col("n_cluster_id") == F.col("o_cluster_id"), F.lit(False))
    close = kernels.same_mean_distance(F.col("n_sigma"), F.col("o_sigma"), 64) < F.when(together, 0.20).otherwise(0.08)
    return both.select("new_id", "old_id", "cos", ((F.col("cos") >= writes.merge_ceiling(F.col("n_memory_type"), together, 0.40, 0.45)) & close).alias("merges"))


#: Notes that contradict each other, by id; every third record is one of them.
_NOTES = ["the deploy script is still broken", "the deploy script works now", "we use the old queue", "we no longer use the old queue", "a plain note on the deploy script"]
_NOTED = "CASE " + " ".join(f"WHEN id % 15 = {3 * n} THEN '{note} ' || id" for n, note in enumerate(_NOTES)) + " ELSE text END"
_NOTED_SQL = f"{M}, noted AS (SELECT * REPLACE ({_NOTED} AS text) FROM memories)"
_TORN = "((cos >= {n} AND regexp_matches(x, '\\bno longer\\b') <> regexp_matches(y, '\\bno longer\\b')) OR (cos >= {s} AND ((regexp_matches(x, 'works now') AND regexp_matches(y, 'still broken')) OR (regexp_matches(y, 'works now') AND regexp_matches(x, 'still broken')))))".format


def _noted(spark, sf) -> DataFrame:
    return memories(spark, sf).withColumn("text", F.expr(_NOTED))


_KEY_SQL = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))".format


@query(f"""{_NOTED_SQL}, b AS (SELECT * FROM noted WHERE id % 7 = 0), s AS (SELECT * FROM noted WHERE id % 7 <> 0),
 exact AS (SELECT b.id AS new_id, min(s.id) AS old_id FROM b JOIN s ON b.project = s.project AND b.text = s.text GROUP BY b.id),
 loose AS (SELECT b.id AS new_id, min(s.id) AS old_id FROM b JOIN s ON b.project = s.project AND {_KEY_SQL('b.text')} = {_KEY_SQL('s.text')} GROUP BY b.id),
 c AS (SELECT b.id AS new_id, s.id AS old_id, round({DOT(a='b.embedding', b='s.embedding')}, 6) AS cos, b.sigma AS sx, s.sigma AS sy, b.text AS x, s.text AS y, b.memory_type, b.cluster_id = s.cluster_id AS together FROM b JOIN s ON b.project = s.project WHERE b.embedding IS NOT NULL AND s.embedding IS NOT NULL),
 k AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY cos DESC, old_id) AS r FROM c WHERE cos > 0.1 QUALIFY r <= 10),
 j AS (SELECT new_id, arg_min(old_id, r) FILTER ({_TORN(n=0.2, s=0.15)}) AS torn, arg_min(old_id, r) FILTER ((cos >= CASE WHEN coalesce(together, false) THEN -2.0 WHEN memory_type = 'session' THEN 0.40 ELSE 0.45 END)
   AND 64 / 2.0 * ln(((sx + sy) / 2 + 1e-7) / (sqrt(sx * sy) + 1e-7)) < CASE WHEN coalesce(together, false) THEN 0.20 ELSE 0.08 END) AS fits FROM k GROUP BY new_id)
 SELECT b.id AS new_id, CASE WHEN coalesce(exact.old_id, loose.old_id) IS NOT NULL THEN 'merged' WHEN torn IS NOT NULL THEN 'contradiction' WHEN fits IS NOT NULL THEN 'merged' ELSE 'spawned' END AS action, coalesce(exact.old_id, loose.old_id, torn, fits) AS old_id
 FROM b LEFT JOIN exact ON exact.new_id = b.id LEFT JOIN loose ON loose.new_id = b.id LEFT JOIN j ON j.new_id = b.id""")
def write_decisions(spark, sf):
    m = _noted(spark, sf)
    return writes.decide(m.filter("id % 7 = 0"), m.filter("id % 7 <> 0"), 0.1, 0.40, 0.45, negation=0.2, status=0.15, dims=64)


@query(f"""{_NOTED_SQL}, p AS (SELECT a.id AS a, b.id AS b, a.text AS x, b.text AS y, round({DOT(a='a.embedding', b='b.embedding')}, 6) AS cos FROM noted a JOIN noted b ON a.domain = b.domain AND a.id < b.id WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL)
 SELECT a, b FROM p WHERE cos > 0.1 AND {_TORN(n=0.2, s=0.15)}""")
def contradiction_pairs(spark, sf):
    found = similarity.theta_pairs(_noted(spark, sf), "domain", 0.1, mark=text.stance(F.col("text")), floors=text.stance_floors(0.2, 0.15))
    return found.select("a", "b")


@query("SELECT doc_id FROM documents WHERE instr(lower(text), 'and') > 0 AND instr(lower(text), 'the') > 0 AND source = 'src3'")
def bulk_delete_pattern(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("project"))
    return maintenance.bulk_pattern(docs, "%and%the%", _PROJECT).select("doc_id")


# -- text ------------------------------------------------------------------------------------


def _redact_sql(column: str) -> str:
    import re

    for pattern, instead in text.SECRETS:
        column = "regexp_replace({}, '{}', '{}', 'g')".format(column, pattern.replace("'", "''"), re.sub(r"\$(\d)", r"\\\1", instead))
    return column


@query(f"SELECT doc_id, md5({_redact_sql('text')}) AS redacted, {_redact_sql('text')} <> text AS changed FROM documents")
def redact_documents(spark, sf):
    once = table(spark, sf, "documents").select("doc_id", "text", text.redact(F.col("text")).alias("red"))
    return once.select("doc_id", F.md5("red").alias("redacted"), (F.col("red") != F.col("text")).alias("changed"))


@query("""WITH s AS (SELECT conv_id, turn, upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || substr(text, 1, 500) AS s FROM conversations WHERE role IN ('user', 'assistant')),
 w AS (SELECT conv_id, string_agg(s, ' | ' ORDER BY turn, s) AS text, count(*) AS turns FROM s GROUP BY conv_id) SELECT conv_id, md5(text) AS text_md5, turns FROM w WHERE length(text) >= 100""")
def transcript_flatten(spark, sf):
    return text_sources.flatten_conversations(table(spark, sf, "conversations")).select("conv_id", F.md5("text").alias("text_md5"), "turns")


@query(r"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
 t AS (SELECT id, n, trim(line) AS line FROM l WHERE trim(line) <> ''), h AS (SELECT *, length(line) < 40 AS is_head, CASE WHEN length(line) < 40 THEN regexp_matches(line, '^[A-M]') END AS opens FROM t),
 s AS (SELECT *, last_value(opens IGNORE NULLS) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) AS open FROM h),
 i AS (SELECT id, n, line AS item, row_number() OVER (PARTITION BY id ORDER BY n) AS r FROM s WHERE NOT is_head AND open AND length(line) >= 20 AND len(string_split(line, ' ')) >= 4)
 SELECT id, CAST(n AS INTEGER) AS n, md5(item) AS item FROM i WHERE r <= 20""")
def capture_sections(spark, sf):
    found = text_sources.section_items(table(spark, sf, "documents"), "doc_id", "text", r"^[A-M].{0,38}$", r"^.{1,39}$")
    return found.select("id", "n", F.md5("item").alias("item"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n\f\x0b]+', ' ', 'g'))) AS text_md5 FROM pages""")
def pages_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text_sources.page_text(F.col("html"))).alias("text_md5"))


@query(r"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE instr(text, '```') = 0),
 t AS (SELECT *, CASE WHEN n % 3 = 1 THEN line ELSE trim(line) END AS v FROM l)
 SELECT id, CAST(n + 3 AS INTEGER) AS n, md5(CASE WHEN n % 3 = 1 THEN trim(line) ELSE 'Notes ' || id || ': ' || trim(line) END) AS item FROM t
 WHERE CASE WHEN n % 3 = 1 THEN length(trim(line)) > 40 AND NOT regexp_matches(line, '^([#|]|\s{2,}[-*]\s|[-*]\s|\d+\.\s)') AND NOT regexp_full_match(trim(line), '[-*_]{3,}') ELSE length(trim(line)) >= 20 END""")
def markdown_items(spark, sf):
    """Documents as notes: front matter, a header, and of three lines one as it is, one as a bullet, one as a task."""
    docs = table(spark, sf, "documents").filter(~F.col("text").contains("```"))
    mark = lambda x, i: F.when(i % 3 == 0, x).when(i % 3 == 1, F.concat(F.lit("- "), x)).otherwise(F.concat(F.lit("* [x] "), x))
    lines = F.array_join(F.transform(F.split("text", "\n", -1), mark), "\n")
    note = F.concat(F.lit("---\ntitle: x\n---\n## Notes "), F.col("doc_id").cast("string"), F.lit("\n| a | b |\n```\n- inside code, not an item of the notes\n```\n"), lines)
    return text_sources.markdown_items(docs.select(F.col("doc_id").alias("id"), note.alias("text"))).select("id", (F.col("n") - 1).cast("int").alias("n"), F.md5("item").alias("item"))


# -- streams ---------------------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2")
def hourly_events_stream(spark, sf):
    """Hours that the watermark has closed."""
    return state.drain(spark, sf, "events", state.hourly)


@query("SELECT DISTINCT user_id, event_type FROM events")
def dedup_stream(spark, sf):
    """State is kept for 60 days of event time, longer than the events last."""
    return state.drain(spark, sf, "events", lambda e: state.first_writes(e.select("user_id", "event_type", "ts"), ["user_id", "event_type"], keep="60 days")).select("user_id", "event_type")


_SESSIONS = """WITH g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) < 1800000000 THEN 0 ELSE 1 END AS opens FROM events),
 s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)"""


@query(f"{_SESSIONS} SELECT user_id, min(ts) AS started, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE")
def session_events_stream(spark, sf):
    """Sessions that the watermark has closed."""
    return state.drain(spark, sf, "events", state.user_sessions)


@query("""WITH g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) < 1800000000 THEN 0 ELSE 1 END AS opens FROM events),
 s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def user_sessions(spark, sf):
    return state.user_sessions(table(spark, sf, "events"))
