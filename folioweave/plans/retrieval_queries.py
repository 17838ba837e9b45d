"""Queries over both retrieval pipelines and the scores of their answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.config import Adaptive, Region
from folioweave.functions import text as X
from folioweave.functions import vectors as V
from folioweave.operators import adaptive, metrics, region, views
from folioweave.operators.questions import dense, entity_overlap, question_entities, token_overlap_sql, token_sets
from folioweave.plans.index_queries import BFS_SQL, NODE_ENTITY_SQL, load
from folioweave.plans.registry import query
from folioweave.session import stage, table

C1 = Adaptive()
C2 = Region()

# C1

PAIRS_SQL = BFS_SQL + """, q1 AS (SELECT * FROM qa WHERE pipeline = 'C1'), e1 AS (SELECT * FROM qe WHERE pipeline = 'C1'),
p1 AS (SELECT x.qid, x.book_id, x.entity AS a, y.entity AS b FROM e1 x JOIN e1 y ON x.qid = y.qid AND x.entity < y.entity),
np AS MATERIALIZED (SELECT p1.*, bd.d FROM p1 JOIN bd ON bd.book_id = p1.book_id AND bd.start = a AND bd.node = b WHERE bd.d <= 4)"""
LOCAL_SQL = PAIRS_SQL + """, pc AS (SELECT np.qid, a, b, d, x.chunk_id FROM np JOIN mn x ON x.book_id = np.book_id AND x.entity = a JOIN mn y ON y.book_id = np.book_id AND y.entity = b AND y.chunk_id = x.chunk_id),
sev AS (SELECT qid FROM e1 GROUP BY qid HAVING count(*) >= 2), sg AS (SELECT e1.qid, e1.entity, mn.chunk_id FROM e1 JOIN mn ON mn.book_id = e1.book_id AND mn.entity = e1.entity),
lc AS MATERIALIZED (SELECT qid, d, chunk_id, [a, b] AS names FROM pc UNION ALL SELECT sg.qid, 4, chunk_id, [entity] FROM sg WHERE qid IN (SELECT qid FROM sev) AND qid NOT IN (SELECT qid FROM np))"""
TIGHT_SQL = LOCAL_SQL + f""", bk AS (SELECT qid, k, count(DISTINCT chunk_id) AS c FROM (SELECT qid, chunk_id, unnest(range(d, 5)) AS k FROM lc) u GROUP BY qid, k),
sn AS (SELECT *, c <= {C1.max_chunks} OR k = 1 OR lead(c) OVER (PARTITION BY qid ORDER BY k DESC) IS NULL AS stop FROM bk), ce AS (SELECT qid, max(k) AS k_end FROM sn WHERE stop GROUP BY qid),
ti AS MATERIALIZED (SELECT sn.qid, min(k)::INT AS k, arg_min(c, k) AS n_chunks, count(*) - 1 AS loops, string_agg(k || ':' || c, ',' ORDER BY k DESC) AS history FROM sn JOIN ce USING (qid) WHERE k >= k_end GROUP BY sn.qid),
lr AS MATERIALIZED (SELECT lc.qid, chunk_id, list_sort(list_distinct(flatten(list(names)))) AS key FROM lc JOIN ti USING (qid) WHERE d <= ti.k GROUP BY lc.qid, chunk_id)"""
_NT = ", nt AS MATERIALIZED (SELECT nd.book_id, nd.node_id, coalesce(nd.text, ck.text) AS text FROM nd LEFT JOIN ck ON ck.book_id = nd.book_id AND ck.chunk_id = nd.node_id), nv AS MATERIALIZED (SELECT book_id, node_id, " + V.letter_vector_sql("text") + " AS v FROM nt WHERE text IS NOT NULL AND text <> '')"
_NE = NODE_ENTITY_SQL


def _dense_sql(name: str, questions: str, k: int) -> str:
    return f", {name}q AS (SELECT qid, book_id, {V.letter_vector_sql('dq')} AS qv FROM (SELECT qid, book_id, {X.Sql.dense_query('question', 'options')} AS dq FROM {questions}) u), {name}c AS (SELECT q.qid, q.book_id, nv.node_id, round({V.cosine_sql('qv', 'v')}, 6) AS cos FROM {name}q q JOIN nv ON nv.book_id = q.book_id), {name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, node_id)::INT AS place FROM {name}c) w WHERE place <= {k})"


ROUTE_SQL = TIGHT_SQL + _NE + _NT + """, gq AS (SELECT * FROM q1 WHERE qid NOT IN (SELECT qid FROM e1)), oq AS (SELECT * FROM q1 WHERE qid IN (SELECT qid FROM e1) AND qid NOT IN (SELECT qid FROM ti))""" + _dense_sql("gd", "gq", C1.max_chunks) + _dense_sql("od", "oq", C1.dense_pool)
OCC_SQL = ROUTE_SQL + f""", oo AS (SELECT od.qid, od.book_id, od.node_id, od.place, coalesce(list_sort(list(ne.entity) FILTER (ne.entity IS NOT NULL)), []) AS key FROM od LEFT JOIN e1 ON e1.qid = od.qid LEFT JOIN ne ON ne.book_id = od.book_id AND ne.node_id = od.node_id AND ne.entity = e1.entity GROUP BY ALL),
ob AS (SELECT *, len(key) AS overlap, max(len(key)) OVER (PARTITION BY qid) AS best FROM oo), oc AS MATERIALIZED (SELECT qid, node_id, key, overlap, rk::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, place) AS rk FROM ob WHERE overlap > 0 OR best = 0) w WHERE rk <= {C1.max_chunks})"""
EVIDENCE_SQL = OCC_SQL + """, ev AS MATERIALIZED (SELECT qid, 'Global' AS mode, node_id, []::VARCHAR[] AS key, place, '' AS history FROM gd UNION ALL SELECT qid, 'Occurrence Rerank', node_id, key, place, '' FROM oc
UNION ALL SELECT lr.qid, CASE WHEN loops > 0 THEN 'Local, Loop for ' || loops || ' times' ELSE 'Local' END, chunk_id, key, row_number() OVER (PARTITION BY lr.qid ORDER BY chunk_id)::INT, history FROM lr JOIN ti USING (qid))"""


def _c1(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The inputs of C1 over all its questions."""
    questions = stage(views.questions(table(spark, d, "predictions"), "C1"), "questions")
    mentions = stage(load(spark, d, "mentions"), "mentions")
    return {"questions": questions, "mentions": mentions, "entities": stage(question_entities(questions, mentions), "entities")}


def _c1_local(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    t = _c1(spark, d)
    near = stage(adaptive.near_pairs(adaptive.entity_pairs(t["entities"]), load(spark, d, "graph"), C1.shortest_path_k), "near")
    return t, near, stage(adaptive.local(t["entities"], near, t["mentions"], C1.shortest_path_k), "local")


def _c1_evidence(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    t = _c1(spark, d)
    t["texts"] = stage(load(spark, d, "node_texts"), "texts")
    evidence = adaptive.retrieve(t["questions"], t["entities"], t["mentions"], load(spark, d, "graph"), t["texts"], load(spark, d, "node_entities"), C1)
    return t, stage(evidence, "evidence")


def _joined(df: DataFrame, column: str = "key") -> DataFrame:
    return df.withColumn(column, F.array_join(column, "|"))


@query(PAIRS_SQL + " SELECT qid, book_id, a, b FROM p1", recursive=True)
def c1_entity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return adaptive.entity_pairs(_c1(spark, d)["entities"])


@query(PAIRS_SQL + " SELECT qid, a, b, d FROM np", recursive=True)
def c1_graph_filter(spark: SparkSession, d: str) -> DataFrame:
    return adaptive.near_pairs(adaptive.entity_pairs(_c1(spark, d)["entities"]), load(spark, d, "graph"), 4).select("qid", "a", "b", "d")


@query(LOCAL_SQL + " SELECT qid, entity, chunk_id FROM sg", recursive=True)
def c1_entity_chunks(spark: SparkSession, d: str) -> DataFrame:
    t = _c1(spark, d)
    return adaptive.single_chunks(t["entities"], t["mentions"])


@query(LOCAL_SQL + " SELECT qid, a, b, d, chunk_id FROM pc", recursive=True)
def c1_pair_intersection(spark: SparkSession, d: str) -> DataFrame:
    t, near, _ = _c1_local(spark, d)
    return adaptive.pair_chunks(near, t["mentions"])


@query(LOCAL_SQL + " SELECT qid, d, chunk_id, array_to_string(names, '|') AS names FROM lc", recursive=True)
def c1_local(spark: SparkSession, d: str) -> DataFrame:
    return _joined(_c1_local(spark, d)[2], "names")


@query(LOCAL_SQL + " SELECT qid, chunk_id, array_to_string(list_sort(list_distinct(flatten(list(names)))), '|') AS key FROM lc GROUP BY qid, chunk_id", recursive=True)
def c1_merge_keys(spark: SparkSession, d: str) -> DataFrame:
    return _joined(adaptive.merge_keys(_c1_local(spark, d)[2].select("qid", "chunk_id", "names")))


@query(TIGHT_SQL + " SELECT qid, k, n_chunks, loops, history FROM ti", recursive=True)
def c1_tighten(spark: SparkSession, d: str) -> DataFrame:
    return adaptive.tighten(_c1_local(spark, d)[2], C1)


@query(EVIDENCE_SQL + " SELECT qid, mode, count(*) AS n_chunks FROM ev GROUP BY qid, mode", recursive=True)
def c1_route(spark: SparkSession, d: str) -> DataFrame:
    return _c1_evidence(spark, d)[1].groupBy("qid", "mode").agg(F.count(F.lit(1)).alias("n_chunks"))


def _pool(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Dense candidates of all C1 questions with their shared entities."""
    t = _c1(spark, d)
    texts = stage(load(spark, d, "node_texts"), "texts")
    found = stage(dense(t["questions"], texts, C1.dense_pool).join(t["questions"].select("qid", "book_id"), "qid"), "found")  # read twice
    return t, entity_overlap(found, t["entities"], load(spark, d, "node_entities"))


_POOL_SQL = PAIRS_SQL + _NE + _NT + _dense_sql("ad", "q1", C1.dense_pool) + ", ap AS MATERIALIZED (SELECT ad.qid, ad.node_id, ad.place, coalesce(list_sort(list(ne.entity) FILTER (ne.entity IS NOT NULL)), []) AS key FROM ad LEFT JOIN e1 ON e1.qid = ad.qid LEFT JOIN ne ON ne.book_id = ad.book_id AND ne.node_id = ad.node_id AND ne.entity = e1.entity GROUP BY ALL)"


@query(_POOL_SQL + " SELECT qid, node_id, array_to_string(key, '|') AS key, len(key)::INT AS overlap FROM ap", recursive=True)
def c1_assign_keys(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d)[1].select("qid", "node_id", F.array_join("entity_list", "|").alias("key"), "overlap")


@query(_POOL_SQL + " SELECT qid, node_id, len(key)::INT AS overlap FROM ap WHERE len(key) > 0", recursive=True)
def rank_entity_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d)[1].where("overlap > 0").select("qid", "node_id", "overlap")


@query(_POOL_SQL + f", b AS (SELECT *, len(key) AS o, max(len(key)) OVER (PARTITION BY qid) AS best FROM ap) SELECT qid, node_id, array_to_string(key, '|') AS key, rk::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o DESC, place) AS rk FROM b WHERE o > 0 OR best = 0) w WHERE rk <= {C1.max_chunks}", recursive=True)
def c1_occurrence_rank(spark: SparkSession, d: str) -> DataFrame:
    return _joined(adaptive.occurrence(_pool(spark, d)[1], C1.max_chunks)).select("qid", "node_id", "key", "place")


@query(
    _POOL_SQL
    + f""", kx AS (SELECT qid, node_id, len(key) AS overlap, unnest(CASE WHEN len(key) > 0 THEN list_prepend(key, list_transform(key, lambda e: [e])) ELSE [key] END) AS key FROM ap),
kt AS (SELECT qid, node_id, key FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY len(key) DESC, overlap DESC, node_id, array_to_string(key, '_')) AS rk FROM (SELECT DISTINCT * FROM kx) u) w WHERE rk <= {C1.max_chunks})
SELECT qid, node_id, CASE WHEN len(flatten(list(key))) > 0 THEN array_to_string(list_sort(list_distinct(flatten(list(key)))), '_') ELSE 'unknown' END AS key FROM kt GROUP BY qid, node_id""",
    recursive=True,
)
def c1_entityaware(spark: SparkSession, d: str) -> DataFrame:
    """Each node under all of its entities and under each single one, so that keys of one node have to be merged."""
    pool = _pool(spark, d)[1]
    every = F.when(F.size("entity_list") > 0, F.array_prepend(F.transform("entity_list", lambda e: F.array(e)), F.col("entity_list"))).otherwise(F.array("entity_list"))
    return adaptive.entity_aware(pool.select("qid", "node_id", "overlap", F.explode(every).alias("key")).distinct(), C1.max_chunks)


@query(EVIDENCE_SQL + " SELECT qid, mode, history, count(*) AS n_chunks, string_agg(node_id, ',' ORDER BY place, node_id) AS chunk_ids FROM ev GROUP BY qid, mode, history", recursive=True)
def c1_result(spark: SparkSession, d: str) -> DataFrame:
    return adaptive.result(_c1_evidence(spark, d)[1])


@query(EVIDENCE_SQL + " SELECT ev.qid, md5(string_agg(CASE WHEN len(key) > 0 THEN array_to_string(key, '_') || ': ' || text ELSE text END, chr(10) || chr(10) ORDER BY place)) AS digest FROM ev JOIN q1 USING (qid) JOIN nt ON nt.book_id = q1.book_id AND nt.node_id = ev.node_id WHERE text IS NOT NULL AND text <> '' GROUP BY ev.qid", recursive=True)
def c1_format_context(spark: SparkSession, d: str) -> DataFrame:
    t, evidence = _c1_evidence(spark, d)
    return adaptive.context(evidence, t["questions"], t["texts"]).select("qid", F.md5("context").alias("digest"))


# C2

SELECTED_SQL = BFS_SQL + ", q2 AS (SELECT * FROM qa WHERE pipeline = 'C2'), e2 AS (SELECT * FROM qe WHERE pipeline = 'C2')" + _NE + _NT + _dense_sql("d2", "q2", C2.top_m * C2.search_factor) + f""", s2 AS (SELECT d2.qid, d2.book_id, d2.node_id, {token_overlap_sql('question', 'text')} AS score FROM d2 JOIN q2 USING (qid) JOIN nt ON nt.book_id = d2.book_id AND nt.node_id = d2.node_id WHERE NOT starts_with(d2.node_id, 'L0_')),
sl AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id)::INT AS place FROM s2) w WHERE place <= {C2.top_m}),
rc AS MATERIALIZED (SELECT DISTINCT sl.qid, sl.book_id, lv.chunk_id FROM sl JOIN lv ON lv.book_id = sl.book_id AND lv.node_id = sl.node_id),
re AS MATERIALIZED (SELECT DISTINCT sl.qid, sl.book_id, ne.entity FROM sl JOIN ne ON ne.book_id = sl.book_id AND ne.node_id = sl.node_id)"""
SEEDS_SQL = SELECTED_SQL + f""", sd AS MATERIALIZED (SELECT e2.qid, e2.book_id, e2.entity FROM e2 JOIN re ON re.qid = e2.qid AND re.entity = e2.entity),
sf AS MATERIALIZED (SELECT qid, book_id, entity, freq FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY freq DESC, entity) AS rn FROM (SELECT rc.qid, rc.book_id, mn.entity, count(DISTINCT rc.chunk_id) AS freq FROM rc JOIN mn ON mn.book_id = rc.book_id AND mn.chunk_id = rc.chunk_id JOIN re ON re.qid = rc.qid AND re.entity = mn.entity WHERE rc.qid NOT IN (SELECT qid FROM sd) GROUP BY ALL) u) w WHERE rn <= {C2.seed_fallback}),
se AS MATERIALIZED (SELECT qid, book_id, entity FROM sd UNION ALL SELECT qid, book_id, entity FROM sf)"""
WALK_SQL = SEEDS_SQL + """, be AS (SELECT book_id, source AS s, relation, target AS t, weight, chunk_ids FROM gr UNION ALL SELECT book_id, target, relation, source, weight, chunk_ids FROM gr WHERE source <> target),
tr AS MATERIALIZED (SELECT qid, book_id, s AS source, relation, t AS target, weight, list_sort(list(DISTINCT chunk_id)) AS evidence FROM (SELECT se.qid, se.book_id, be.s, be.relation, be.t, be.weight, unnest(be.chunk_ids) AS chunk_id FROM se JOIN be ON be.book_id = se.book_id AND be.s = se.entity JOIN re ON re.qid = se.qid AND re.entity = be.t) u WHERE (qid, chunk_id) IN (SELECT (qid, chunk_id) FROM rc) GROUP BY ALL),
vi AS MATERIALIZED (SELECT qid, book_id, entity FROM se UNION SELECT qid, book_id, source FROM tr UNION SELECT qid, book_id, target FROM tr)"""
CAND_SQL = WALK_SQL + f""", fe AS (SELECT DISTINCT qid, book_id, unnest(evidence) AS chunk_id, 'edge' AS origin FROM tr),
fn AS (SELECT DISTINCT qid, book_id, chunk_id, 'entity' AS origin FROM (SELECT vi.qid, vi.book_id, vi.entity, mn.chunk_id, row_number() OVER (PARTITION BY vi.qid, vi.entity ORDER BY ck.ord, mn.chunk_id) AS rn FROM vi JOIN mn ON mn.book_id = vi.book_id AND mn.entity = vi.entity JOIN rc ON rc.qid = vi.qid AND rc.chunk_id = mn.chunk_id JOIN ck ON ck.book_id = vi.book_id AND ck.chunk_id = mn.chunk_id) u WHERE rn <= {C2.mentions_per_entity}),
cm AS (SELECT qid, book_id, chunk_id, string_agg(DISTINCT origin, ',' ORDER BY origin) AS sources, bool_or(origin = 'edge') AS is_edge_evidence FROM (SELECT * FROM fe UNION ALL SELECT * FROM fn) u GROUP BY ALL),
ov AS (SELECT e2.qid, ne.book_id, ne.node_id, count(DISTINCT ne.entity)::INT AS overlap FROM e2 JOIN ne ON ne.book_id = e2.book_id AND ne.entity = e2.entity GROUP BY ALL),
ca AS MATERIALIZED (SELECT cm.qid, cm.book_id, cm.chunk_id AS node_id, sources, is_edge_evidence, coalesce(overlap, 0) AS overlap, text FROM cm JOIN ck ON ck.book_id = cm.book_id AND ck.chunk_id = cm.chunk_id LEFT JOIN ov ON ov.qid = cm.qid AND ov.node_id = cm.chunk_id WHERE text IS NOT NULL AND text <> '')"""
C2_SQL = CAND_SQL + f""", ro AS MATERIALIZED (SELECT q2.qid, q2.book_id, q2.question, coalesce(a.n, 0) AS n_seeds, coalesce(b.n, 0) AS n_candidates, coalesce(c.n, 0) AS n_region, coalesce(e.n, 0) AS n_relations, CASE WHEN coalesce(a.n, 0) < 1 THEN 'fallback_no_seeds' WHEN coalesce(b.n, 0) < 3 THEN 'fallback_no_candidates' ELSE 'graph_traversal' END AS mode FROM q2 LEFT JOIN (SELECT qid, count(*) AS n FROM se GROUP BY qid) a USING (qid) LEFT JOIN (SELECT qid, count(*) AS n FROM ca GROUP BY qid) b USING (qid) LEFT JOIN (SELECT qid, count(*) AS n FROM rc GROUP BY qid) c USING (qid) LEFT JOIN (SELECT qid, count(*) AS n FROM tr GROUP BY qid) e USING (qid)),
fb AS MATERIALIZED (SELECT rc.qid, rc.book_id, rc.chunk_id AS node_id, 'region' AS sources, FALSE AS is_edge_evidence, coalesce(overlap, 0) AS overlap, ck.text FROM rc JOIN ro USING (qid) JOIN ck ON ck.book_id = rc.book_id AND ck.chunk_id = rc.chunk_id LEFT JOIN ov ON ov.qid = rc.qid AND ov.node_id = rc.chunk_id WHERE mode <> 'graph_traversal' AND ck.text IS NOT NULL AND ck.text <> ''),
po AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY is_edge_evidence DESC, overlap DESC, node_id)::INT AS pre FROM (SELECT ca.* FROM ca JOIN ro USING (qid) WHERE mode = 'graph_traversal' UNION ALL SELECT * FROM fb) u) w WHERE pre <= {C2.candidate_pool}),
rr AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pre)::INT AS place FROM (SELECT po.*, {token_overlap_sql('ro.question', 'po.text')} AS score FROM po JOIN ro USING (qid)) u) w WHERE place <= {C2.final_k})"""


def _c2(spark: SparkSession, d: str) -> region.Stages:
    questions = stage(views.questions(table(spark, d, "predictions"), "C2"), "questions")
    mentions = stage(load(spark, d, "mentions"), "mentions")
    entities = stage(question_entities(questions, mentions), "entities")
    leaves = stage(load(spark, d, "leaves"), "leaves")
    bridge = stage(leaves.join(mentions, ["book_id", "chunk_id"]).select("book_id", "node_id", "entity").distinct(), "bridge")
    chunks = load(spark, d, "chunks")
    return region.Stages(questions, entities, mentions, load(spark, d, "graph"), stage(load(spark, d, "node_texts"), "node_texts"), chunks, leaves, bridge, C2)


@query(SELECTED_SQL + " SELECT qid, node_id, score, place FROM sl", recursive=True)
def c2_tree_prune(spark: SparkSession, d: str) -> DataFrame:
    texts = stage(load(spark, d, "node_texts"), "node_texts")
    return region.tree_prune(views.questions(table(spark, d, "predictions"), "C2"), texts, token_sets(texts), C2).select("qid", "node_id", "score", "place")


@query(SELECTED_SQL + " SELECT qid, chunk_id FROM rc", recursive=True)
def c2_region_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _c2(spark, d).chunks.select("qid", "chunk_id")


@query(SELECTED_SQL + " SELECT qid, entity FROM re", recursive=True)
def c2_region_entities(spark: SparkSession, d: str) -> DataFrame:
    return _c2(spark, d).entities.select("qid", "entity")


@query(SEEDS_SQL + " SELECT qid, entity FROM sd", recursive=True)
def c2_seeds_intersection(spark: SparkSession, d: str) -> DataFrame:
    return _c2(spark, d).seeds_direct.select("qid", "entity")


@query(SEEDS_SQL + " SELECT qid, entity, freq FROM sf", recursive=True)
def c2_seeds_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _c2(spark, d).seeds_frequent.select("qid", "entity", "freq")


@query(WALK_SQL + " SELECT qid, source, relation, target, weight, array_to_string(evidence, '|') AS evidence FROM tr", recursive=True)
def c2_traverse(spark: SparkSession, d: str) -> DataFrame:
    return _joined(_c2(spark, d).records, "evidence").select("qid", "source", "relation", "target", "weight", "evidence")


@query(WALK_SQL + " SELECT qid, entity FROM vi", recursive=True)
def c2_visited(spark: SparkSession, d: str) -> DataFrame:
    return _c2(spark, d).visited.select("qid", "entity")


@query(CAND_SQL + " SELECT qid, node_id, sources, is_edge_evidence, overlap FROM ca", recursive=True)
def c2_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _joined(_c2(spark, d).candidates, "sources").withColumn("sources", F.replace("sources", F.lit("|"), F.lit(","))).select("qid", "node_id", "sources", "is_edge_evidence", "overlap")


@query(C2_SQL + " SELECT qid, node_id, pre FROM po", recursive=True)
def c2_prerank(spark: SparkSession, d: str) -> DataFrame:
    return _c2(spark, d).pool.select("qid", "node_id", "pre")


@query(C2_SQL + " SELECT qid, node_id, score, place FROM rr", recursive=True)
def c2_rerank(spark: SparkSession, d: str) -> DataFrame:
    return _c2(spark, d).ranked.select("qid", "node_id", "score", "place")


@query(C2_SQL + " SELECT qid, node_id, overlap FROM fb", recursive=True)
def c2_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _c2(spark, d).fallback.select("qid", "node_id", "overlap")


@query(C2_SQL + " SELECT qid, mode, n_seeds, n_candidates, n_region, n_relations FROM ro", recursive=True)
def c2_route(spark: SparkSession, d: str) -> DataFrame:
    return _c2(spark, d).route.select("qid", "mode", "n_seeds", "n_candidates", "n_region", "n_relations")


@query(C2_SQL + " SELECT ro.qid, mode, coalesce(string_agg(node_id, ',' ORDER BY place), '') AS chunk_ids, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY place), '')) AS digest FROM ro LEFT JOIN rr USING (qid) GROUP BY ro.qid, mode", recursive=True)
def c2_result(spark: SparkSession, d: str) -> DataFrame:
    return region.result(_c2(spark, d)).select("qid", "mode", "chunk_ids", F.md5("context").alias("digest"))


# scores

_LCS = "coalesce(list_reduce(list_prepend(list_transform(b, lambda y: 0), list_transform(a, lambda w: list_transform(b, lambda y: (y = w)::INT))), lambda acc, m: list_transform(range(1, len(m) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: CASE WHEN m[i] = 1 THEN (CASE WHEN i > 1 THEN acc[i - 1] ELSE 0 END) + 1 ELSE acc[i] END))))[-1], 0)"
_SCORED = f""", s0 AS (SELECT qid, pipeline, split_part(book_id, '_', 1) AS dataset, {X.Sql.standardise("coalesce(prediction, 'Z')")} AS p, {X.Sql.standardise("coalesce(ground_truth, ground_truth_text, '')")} AS t FROM qa),
s1 AS (SELECT *, (p = t)::INT::DOUBLE AS em, {X.Sql.words("p")} AS a, {X.Sql.words("t")} AS b FROM s0),
s2 AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(2.0 * {_LCS} / (len(a) + len(b)), 4) END AS f FROM s1),
sc AS MATERIALIZED (SELECT qid, pipeline, dataset, em, CASE WHEN dataset = 'InfiniteChoice' THEN em ELSE f END AS rl FROM s2)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return metrics.scored(table(spark, d, "predictions").dropDuplicates(["pred_id"]))


@query(_SCORED + " SELECT qid, em FROM sc")
def met_em(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select(F.col("pred_id").alias("qid"), "em")


@query(_SCORED + " SELECT qid, rl FROM sc")
def met_rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select(F.col("pred_id").alias("qid"), "rl")


@query(_SCORED + " SELECT dataset, count(*) AS n, round(avg(em), 6) AS em, round(avg(rl), 6) AS rl FROM sc GROUP BY dataset")
def met_by_dataset(spark: SparkSession, d: str) -> DataFrame:
    return metrics.averages(_scored(spark, d), "dataset")


@query(_SCORED + " SELECT count(*) AS n, coalesce(round(avg(em), 6), 0.0) AS em, coalesce(round(avg(rl), 6), 0.0) AS rl FROM sc")
def met_overall(spark: SparkSession, d: str) -> DataFrame:
    return metrics.averages(_scored(spark, d))


@query(_SCORED + " SELECT coalesce(pipeline, 'all') AS pipeline, count(*) AS n, round(avg(em), 6) AS em, round(avg(rl), 6) AS rl FROM sc GROUP BY GROUPING SETS ((pipeline), ())")
def met_by_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return metrics.by_pipeline(_scored(spark, d))


@query(f", us AS (SELECT book_id, len({X.Sql.words('question')}) AS p, len({X.Sql.words("coalesce(raw_llm_output, '')")}) AS c FROM qa) SELECT book_id, count(*) AS calls, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens FROM us GROUP BY book_id")
def met_token_usage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "predictions").dropDuplicates(["pred_id"])
    usage = rows.select("book_id", F.size(X.words(F.col("question"))).cast("bigint").alias("prompt_tokens"), F.size(X.words(F.coalesce("raw_llm_output", F.lit("")))).cast("bigint").alias("completion_tokens"))
    return metrics.token_usage(usage)
