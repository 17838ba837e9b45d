"""Queries over the tree, posting lists, relations and the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.config import Indexing
from folioweave.functions import text as X
from folioweave.functions import vectors as V
from folioweave.operators import graph, postings, relations, search, tree, views
from folioweave.operators.questions import LONGEST, question_entities, words_sql
from folioweave.plans.registry import query
from folioweave.prompts import RELATION, fill_sql
from folioweave.session import table

ROLLUP_SQL = ", lv AS (SELECT book_id, node_id, node_id AS chunk_id FROM nd WHERE level = 0 UNION SELECT te.book_id, te.parent_id, lv.chunk_id FROM lv JOIN te ON te.book_id = lv.book_id AND te.child_id = lv.node_id)"
NODE_ENTITY_SQL = ROLLUP_SQL + ", ne AS MATERIALIZED (SELECT DISTINCT lv.book_id, lv.node_id, mn.entity FROM lv JOIN mn ON mn.book_id = lv.book_id AND mn.chunk_id = lv.chunk_id)"
ENTITY_SQL = f", qw AS (SELECT qid, pipeline, book_id, {words_sql()} AS w FROM qa), qs AS (SELECT qid, pipeline, book_id, w, unnest(range(len(w))) AS pos FROM qw WHERE len(w) > 0), qg AS (SELECT qid, pipeline, book_id, pos, w, unnest(range(1, least({LONGEST}, len(w) - pos) + 1)) AS n FROM qs), qe AS MATERIALIZED (SELECT g.qid, g.pipeline, g.book_id, m.entity, min(pos)::INT AS pos FROM (SELECT qid, pipeline, book_id, pos, array_to_string(w[(pos + 1):(pos + n)], ' ') AS entity FROM qg) g JOIN (SELECT DISTINCT book_id, entity FROM mn) m ON m.book_id = g.book_id AND m.entity = g.entity GROUP BY ALL)"
_ids = f"list_transform(list_filter(coalesce(chunk_ids, []), lambda x: x IS NOT NULL), lambda x: {X.Sql.chunk_key('x')})"
GRAPH_SQL = f""", en AS MATERIALIZED (SELECT book_id, source, relation, target, weight, chunk_ids, len(list_distinct(chunk_ids))::INT AS support_count, ingested_at FROM (SELECT book_id, {X.Sql.strip('source')} AS source, {X.Sql.strip('relation')} AS relation, {X.Sql.strip('target')} AS target, coalesce(nullif(weight, 0.0), 1.0) AS weight, {_ids} AS chunk_ids, ingested_at FROM edges) u WHERE source <> '' AND relation <> '' AND target <> ''),
gr AS MATERIALIZED (SELECT * EXCLUDE (rn, ingested_at) FROM (SELECT *, row_number() OVER (PARTITION BY book_id, source, relation, target ORDER BY ingested_at DESC NULLS LAST, support_count DESC, weight DESC, array_to_string(chunk_ids, ',')) AS rn FROM en) u WHERE rn = 1)"""


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A prepared table by name."""
    stored = lambda t: table(spark, d, t)
    if name == "chunks":
        return views.chunks(stored("chunks"))
    if name == "nodes":
        return views.nodes(stored("nodes"))
    if name == "mentions":
        return views.mentions(stored("i_c2e"))
    if name == "tree_edges":
        return views.tree_edges(load(spark, d, "nodes"))
    if name == "leaves":
        rows = load(spark, d, "nodes")
        return tree.leaf_rollup(views.tree_edges(rows), rows.where("level = 0"), max(1, rows.agg(F.max("level")).first()[0] or 1))
    if name == "node_entities":
        return postings.node_entities(load(spark, d, "leaves"), load(spark, d, "mentions"))
    if name == "graph":
        return graph.upsert(graph.normalise_arrivals(stored("edges"), "ingested_at"), "ingested_at").drop("ingested_at")
    if name == "node_texts":
        return tree.node_texts(load(spark, d, "nodes"), load(spark, d, "chunks"))
    raise ValueError(name)


# tree


@query("SELECT book_id, chunk_id AS node_id, 0 AS level, chunk_id AS leaves, md5(text) AS digest FROM ck")
def tree_level0(spark: SparkSession, d: str) -> DataFrame:
    return tree.leaf_nodes(load(spark, d, "chunks")).select("book_id", "node_id", "level", F.array_join("leaves", ",").alias("leaves"), F.md5("text").alias("digest"))


@query("SELECT book_id, parent_id AS node_id, count(DISTINCT child_id) AS n_children, string_agg(DISTINCT child_id, ',' ORDER BY child_id) AS children FROM te GROUP BY book_id, parent_id")
def tree_parents(spark: SparkSession, d: str) -> DataFrame:
    edges = load(spark, d, "tree_edges")
    return edges.groupBy("book_id", F.col("parent_id").alias("node_id")).agg(F.countDistinct("child_id").alias("n_children"), F.array_join(F.array_sort(F.collect_set("child_id")), ",").alias("children"))


@query(ROLLUP_SQL + " SELECT book_id, node_id, chunk_id FROM lv", recursive=True)
def tree_leaf_rollup(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "leaves").select("book_id", "node_id", "chunk_id")


@query("SELECT book_id, child_id AS node_id, count(*) AS n_parents, string_agg(DISTINCT parent_id, ',' ORDER BY parent_id) AS parents FROM te GROUP BY book_id, child_id")
def tree_parents_of(spark: SparkSession, d: str) -> DataFrame:
    return tree.parents_of(load(spark, d, "tree_edges"))


@query(", st AS (SELECT book_id, level, count(*) AS n_nodes FROM nd GROUP BY book_id, level), nx AS (SELECT *, coalesce(lead(n_nodes) OVER (PARTITION BY book_id ORDER BY level), 0) AS n_next FROM st) SELECT book_id, level, n_nodes, n_next, (n_nodes > 5 AND n_next > 0 AND n_next < n_nodes) AS grows FROM nx")
def tree_stop_rule(spark: SparkSession, d: str) -> DataFrame:
    return tree.stop_levels(tree.level_stats(load(spark, d, "nodes")))


@query("SELECT book_id, level, count(*) AS n_nodes FROM nd GROUP BY book_id, level")
def tree_level_stats(spark: SparkSession, d: str) -> DataFrame:
    return tree.level_stats(load(spark, d, "nodes"))


@query(", nt AS (SELECT nd.book_id, nd.node_id, coalesce(nd.text, ck.text) AS text FROM nd LEFT JOIN ck ON ck.book_id = nd.book_id AND ck.chunk_id = nd.node_id) SELECT te.book_id, te.parent_id AS node_id, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY child_id)) AS digest FROM te JOIN nt ON nt.book_id = te.book_id AND nt.node_id = te.child_id WHERE text IS NOT NULL AND text <> '' GROUP BY te.book_id, te.parent_id")
def tree_summary_input(spark: SparkSession, d: str) -> DataFrame:
    return tree.summary_input(load(spark, d, "tree_edges"), load(spark, d, "node_texts")).select("book_id", "node_id", F.md5("text").alias("digest"))


@query("WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS a FROM embeddings), p AS (SELECT vec_id, list_transform(a, lambda x: round(x / list_sum(a), 6)) AS p FROM a WHERE list_sum(a) > 0), u AS (SELECT vec_id, unnest(range(len(p)))::INT AS cluster, unnest(p) AS x, list_max(p) AS top, list_position(p, list_max(p))::INT - 1 AS best FROM p) SELECT vec_id AS id, cluster FROM u WHERE x > 0.1 OR (top <= 0.1 AND cluster = best)", views=False)
def tree_soft_assign(spark: SparkSession, d: str) -> DataFrame:
    sizes = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), sizes.alias("a")).withColumn("s", F.aggregate("a", F.lit(0.0), lambda s, x: s + x)).where("s > 0")
    return tree.soft_assign(rows.select("id", F.transform("a", lambda x: F.round(x / F.col("s"), 6)).alias("p")))


def _usable(spark: SparkSession, d: str) -> DataFrame:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return table(spark, d, "nodes").where(F.size("embedding") == Indexing().vector_dim).where(fine).select("node_key", "book_id", "node_id", "level", "embedding").dropDuplicates(["node_key"])


@query()
def tree_reduce(spark: SparkSession, d: str) -> DataFrame:
    return tree.reduce_dim(_usable(spark, d).where("level = 0"))


@query()
def tree_two_stage(spark: SparkSession, d: str) -> DataFrame:
    return tree.two_stage_clusters(tree.reduce_dim(_usable(spark, d).where("level = 0")))


@query()
def tree_bic(spark: SparkSession, d: str) -> DataFrame:
    """The number of clusters of least BIC for each label's vectors, on the main axes of all."""
    import numpy as np
    import pandas as pd

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        k, _, scores = tree.choose_clusters(np.stack(rows.sort_values("node_id")["z"].to_numpy()), Indexing().max_clusters)
        return pd.DataFrame({"label": [int(rows["book_id"].iloc[0])], "k": [k], "tried": [len(scores)]})

    rows = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("book_id"), F.col("vec_id").cast("string").alias("node_id"), "embedding")
    return tree.reduce_dim(rows, Indexing().reduced_dim).groupBy("book_id").applyInPandas(fit, "label int, k int, tried int")


# postings


@query("SELECT book_id, chunk_id, entity FROM mn")
def ent_mentions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "mentions")


@query("SELECT ck.book_id, ck.chunk_id, coalesce(string_agg(DISTINCT entity, '|' ORDER BY entity), '') AS entities, count(DISTINCT entity)::INT AS n FROM ck LEFT JOIN mn ON mn.book_id = ck.book_id AND mn.chunk_id = ck.chunk_id GROUP BY ck.book_id, ck.chunk_id")
def idx_c2e(spark: SparkSession, d: str) -> DataFrame:
    rows = postings.chunk_entities(load(spark, d, "chunks"), load(spark, d, "mentions"))
    return rows.select("book_id", "chunk_id", F.array_join("entities", "|").alias("entities"), F.size("entities").alias("n"))


@query("SELECT mn.book_id, entity, string_agg(mn.chunk_id, '|' ORDER BY ord, mn.chunk_id) AS chunk_ids, count(*)::INT AS n FROM mn JOIN ck ON ck.book_id = mn.book_id AND ck.chunk_id = mn.chunk_id GROUP BY mn.book_id, entity")
def idx_e2c(spark: SparkSession, d: str) -> DataFrame:
    rows = postings.entity_chunks(load(spark, d, "mentions"), load(spark, d, "chunks"))
    return rows.select("book_id", "entity", F.array_join("chunk_ids", "|").alias("chunk_ids"), F.size("chunk_ids").alias("n"))


@query(NODE_ENTITY_SQL + " SELECT nd.book_id, nd.node_id, coalesce(string_agg(DISTINCT entity, '|' ORDER BY entity), '') AS entities FROM nd LEFT JOIN ne ON ne.book_id = nd.book_id AND ne.node_id = nd.node_id GROUP BY nd.book_id, nd.node_id", recursive=True)
def idx_s2e(spark: SparkSession, d: str) -> DataFrame:
    rows = postings.node_entity_lists(load(spark, d, "nodes"), load(spark, d, "node_entities"))
    return rows.select("book_id", "node_id", F.array_join("entities", "|").alias("entities"))


@query(NODE_ENTITY_SQL + " SELECT book_id, entity, string_agg(node_id, '|' ORDER BY node_id) AS node_ids FROM ne GROUP BY book_id, entity", recursive=True)
def idx_e2s(spark: SparkSession, d: str) -> DataFrame:
    return postings.entity_nodes(load(spark, d, "node_entities")).select("book_id", "entity", F.array_join("node_ids", "|").alias("node_ids"))


@query(ENTITY_SQL + " SELECT qid, book_id, entity, pos FROM qe")
def qa_query_entities(spark: SparkSession, d: str) -> DataFrame:
    return question_entities(views.questions(table(spark, d, "predictions")), load(spark, d, "mentions"))


# relations

_EL = ", el AS (SELECT book_id, chunk_id, count(DISTINCT entity) AS n_entities FROM mn GROUP BY book_id, chunk_id HAVING count(DISTINCT entity) >= 2)"
_ADJ = ", aj AS MATERIALIZED (SELECT book_id, chunk_id, source, 'next' AS relation, target FROM (SELECT book_id, chunk_id, entity AS source, lead(entity) OVER (PARTITION BY book_id, chunk_id ORDER BY entity) AS target FROM mn) u WHERE target IS NOT NULL)"
_VALID = _ADJ + f", ck_e AS (SELECT DISTINCT book_id, chunk_id, {X.Sql.relation_entity_key('entity')} AS e FROM mn), vr AS MATERIALIZED (SELECT r.* FROM (SELECT book_id, chunk_id, {X.Sql.relation_entity_key('source')} AS source, {X.Sql.relation_key('relation')} AS relation, {X.Sql.relation_entity_key('target')} AS target FROM aj WHERE source <> '' AND target <> '') r WHERE source <> target AND EXISTS (SELECT 1 FROM ck_e WHERE ck_e.book_id = r.book_id AND ck_e.chunk_id = r.chunk_id AND e = source) AND EXISTS (SELECT 1 FROM ck_e WHERE ck_e.book_id = r.book_id AND ck_e.chunk_id = r.chunk_id AND e = target))"
_MERGED = _VALID + ", me AS (SELECT book_id, source, relation, target, count(*)::DOUBLE AS weight, string_agg(DISTINCT chunk_id, '|' ORDER BY chunk_id) AS chunk_ids FROM (SELECT DISTINCT * FROM vr) u GROUP BY ALL)"


def _valid(spark: SparkSession, d: str) -> DataFrame:
    mentions = load(spark, d, "mentions")
    return relations.validate(relations.adjacent_relations(mentions), mentions)


@query(_EL + " SELECT book_id, chunk_id, n_entities FROM el")
def rel_eligible_chunks(spark: SparkSession, d: str) -> DataFrame:
    return relations.eligible_chunks(load(spark, d, "mentions"))


@query(_EL + ", nm AS (SELECT book_id, chunk_id, string_agg(DISTINCT entity, ', ' ORDER BY entity) AS names FROM mn GROUP BY book_id, chunk_id) SELECT el.book_id, el.chunk_id, md5(" + fill_sql(RELATION, entities="names", text="substring(text, 1, 8000)") + ") AS digest FROM el JOIN nm ON nm.book_id = el.book_id AND nm.chunk_id = el.chunk_id JOIN ck ON ck.book_id = el.book_id AND ck.chunk_id = el.chunk_id")
def rel_prompt(spark: SparkSession, d: str) -> DataFrame:
    mentions = load(spark, d, "mentions")
    return relations.prompts(relations.eligible_chunks(mentions), load(spark, d, "chunks"), mentions).select("book_id", "chunk_id", F.md5("prompt").alias("digest"))


@query(_EL + f" SELECT book_id, chunk_id FROM el WHERE NOT EXISTS (SELECT 1 FROM (SELECT book_id AS b, {X.Sql.chunk_key('c')} AS c FROM (SELECT book_id, unnest(chunk_ids) AS c FROM edges) u) k WHERE k.b = el.book_id AND k.c = el.chunk_id)")
def rel_incremental(spark: SparkSession, d: str) -> DataFrame:
    cached = table(spark, d, "edges").select("book_id", F.explode("chunk_ids").alias("c")).where("c IS NOT NULL").select("book_id", X.chunk_key(F.col("c")).alias("chunk_id"))
    return relations.pending(relations.eligible_chunks(load(spark, d, "mentions")), cached).select("book_id", "chunk_id")


@query(_ADJ + """, sz AS (SELECT book_id, chunk_id, ('0x' || substring(md5(book_id || chunk_id), 1, 1))::INT % 4 AS kind FROM (SELECT DISTINCT book_id, chunk_id FROM aj) u)
SELECT book_id, chunk_id, kind = 3 AS failed, CASE WHEN kind = 3 THEN NULL ELSE replace(replace(source, '"', ''), '\\', '') END AS source, CASE WHEN kind = 3 THEN NULL ELSE replace(replace(target, '"', ''), '\\', '') END AS target FROM aj JOIN sz USING (book_id, chunk_id) WHERE kind < 3
UNION ALL SELECT book_id, chunk_id, TRUE, NULL, NULL FROM sz WHERE kind = 3""")
def rel_parse_json(spark: SparkSession, d: str) -> DataFrame:
    """Model output made from relations: plain, fenced, with text and a stray element around, and broken off."""
    plain = lambda c: F.translate(c, '"\\', "")
    item = F.concat(F.lit('{"source": "'), plain("source"), F.lit('", "relation": "next", "target": "'), plain("target"), F.lit('"}'))
    lists = relations.adjacent_relations(load(spark, d, "mentions")).groupBy("book_id", "chunk_id").agg(F.array_join(F.collect_list(item), ", ").alias("items"))
    kind = F.conv(F.substring(F.md5(F.concat("book_id", "chunk_id")), 1, 1), 16, 10).cast("int") % 4
    raw = (
        F.when(kind == 0, F.concat(F.lit("["), "items", F.lit("]")))
        .when(kind == 1, F.concat(F.lit("```json\n["), "items", F.lit("]\n```")))
        .when(kind == 2, F.concat(F.lit('Relations: ["stray", '), "items", F.lit("] as found.")))
        .otherwise(F.concat(F.lit("["), "items", F.lit(', {"source": "cut')))
    )
    parsed = relations.parse_output(lists.select("book_id", "chunk_id", raw.alias("raw")))
    rows = parsed.select("book_id", "chunk_id", "failed", F.explode_outer("items").alias("x")).select("book_id", "chunk_id", "failed", "x.source", "x.target")
    return rows.where("failed OR source IS NOT NULL")


@query(_VALID + " SELECT book_id, chunk_id, source, relation, target FROM vr")
def rel_validate(spark: SparkSession, d: str) -> DataFrame:
    return _valid(spark, d)


@query(_VALID + " SELECT DISTINCT book_id, chunk_id, source, relation, target FROM vr")
def rel_dedup(spark: SparkSession, d: str) -> DataFrame:
    return relations.dedup(_valid(spark, d))


@query(_MERGED + " SELECT book_id, source, relation, target, weight, chunk_ids FROM me")
def edge_merge(spark: SparkSession, d: str) -> DataFrame:
    return relations.merge_edges(relations.dedup(_valid(spark, d))).withColumn("chunk_ids", F.array_join("chunk_ids", "|"))


@query(_MERGED + " SELECT book_id, source, relation, target, weight, place FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY weight DESC, source, relation, target)::BIGINT AS place FROM me) u")
def edge_topk(spark: SparkSession, d: str) -> DataFrame:
    return relations.by_weight(relations.merge_edges(relations.dedup(_valid(spark, d)))).select("book_id", "source", "relation", "target", "weight", "place")


# graph

_edge_out = "book_id, source, relation, target, weight, support_count, array_to_string(chunk_ids, '|') AS chunk_ids"


def _edge_cols(df: DataFrame) -> DataFrame:
    return df.select("book_id", "source", "relation", "target", "weight", "support_count", F.array_join("chunk_ids", "|").alias("chunk_ids"))


@query("SELECT book_id, source, relation, target, count(*) AS times FROM edges GROUP BY ALL HAVING count(*) > 1", views=False)
def gra_unique_check(spark: SparkSession, d: str) -> DataFrame:
    return graph.repeated_keys(table(spark, d, "edges"), "book_id", "source", "relation", "target")


@query(GRAPH_SQL + f" SELECT {_edge_out} FROM en")
def gra_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _edge_cols(graph.normalise(table(spark, d, "edges")))


@query(GRAPH_SQL + " SELECT book_id, source AS name FROM gr UNION SELECT book_id, target FROM gr")
def gra_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.entities(load(spark, d, "graph"))


@query(GRAPH_SQL + f" SELECT {_edge_out} FROM gr")
def gra_upsert(spark: SparkSession, d: str) -> DataFrame:
    return _edge_cols(load(spark, d, "graph"))


@query(GRAPH_SQL + ", c AS (SELECT book_id, source, target, unnest(chunk_ids) AS chunk_id FROM gr) SELECT book_id, source AS name, chunk_id FROM c UNION SELECT book_id, target, chunk_id FROM c")
def gra_mentioned_in(spark: SparkSession, d: str) -> DataFrame:
    return graph.mentioned_in(load(spark, d, "graph"))


BFS_SQL = GRAPH_SQL + ENTITY_SQL + """, ud AS MATERIALIZED (SELECT book_id, source AS a, target AS b FROM gr WHERE source <> target UNION SELECT book_id, target, source FROM gr WHERE source <> target),
bw AS (SELECT DISTINCT book_id, entity AS start, entity AS node, 0 AS d FROM qe UNION SELECT bw.book_id, bw.start, ud.b, bw.d + 1 FROM bw JOIN ud ON ud.book_id = bw.book_id AND ud.a = bw.node WHERE bw.d < 4),
bd AS MATERIALIZED (SELECT book_id, start, node, min(d)::INT AS d FROM bw GROUP BY book_id, start, node)"""


def _starts(spark: SparkSession, d: str) -> DataFrame:
    return question_entities(views.questions(table(spark, d, "predictions")), load(spark, d, "mentions")).select("book_id", F.col("entity").alias("start")).distinct()


@query(BFS_SQL + " SELECT book_id, start, d, count(*) AS n_nodes FROM bd GROUP BY book_id, start, d", recursive=True)
def gra_bfs_distance(spark: SparkSession, d: str) -> DataFrame:
    reached = graph.distances(_starts(spark, d), load(spark, d, "graph"), 4)
    return reached.groupBy("book_id", "start", "d").agg(F.count(F.lit(1)).alias("n_nodes"))


@query(
    BFS_SQL
    + """, pr AS (SELECT DISTINCT x.book_id, x.entity AS a, y.entity AS b FROM qe x JOIN qe y ON x.qid = y.qid AND x.entity < y.entity),
pw AS (SELECT book_id, a, b, a AS node, a AS path, 0 AS d FROM pr UNION ALL SELECT pw.book_id, pw.a, pw.b, ud.b, pw.path || ' > ' || ud.b, pw.d + 1 FROM pw JOIN ud ON ud.book_id = pw.book_id AND ud.a = pw.node JOIN bd ON bd.book_id = pw.book_id AND bd.start = pw.a AND bd.node = ud.b AND bd.d = pw.d + 1 WHERE pw.d < 4)
SELECT book_id, a, b, d::INT AS d, min(path) AS path FROM pw WHERE node = b GROUP BY book_id, a, b, d""",
    recursive=True,
)
def gra_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    found = question_entities(views.questions(table(spark, d, "predictions")), load(spark, d, "mentions"))
    pairs = found.select("qid", "book_id", F.col("entity").alias("a")).join(found.select("qid", F.col("entity").alias("b")), "qid").where("a < b").select("book_id", "a", "b").distinct()
    return graph.shortest_paths(pairs, load(spark, d, "graph"), 4)


# vectors


@query("SELECT vec_id, unnest(range(len(embedding)))::INT AS pos, round(unnest(embedding)::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS value FROM embeddings", views=False)
def vec_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", F.posexplode(V.unit(F.col("embedding"))).alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("value"))


@query("WITH c AS (SELECT q.vec_id AS qid, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS cos FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id) SELECT qid, id, cos, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) AS place FROM c) u WHERE place <= 25", views=False)
def vec_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 25 nearest of every vector whose id is divisible by 20, among all others."""
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    return search.top_k(asked, rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 25, exclude_self=True)


_FINE = f"len(embedding) = {Indexing().vector_dim} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


@query(f"WITH n AS (SELECT DISTINCT ON (node_key) node_key, embedding::DOUBLE[] AS v FROM nodes WHERE {_FINE}), c AS (SELECT q.node_key AS qid, e.node_key AS id, round(list_cosine_similarity(q.v, e.v), 6) AS cos FROM n q JOIN n e ON q.node_key % 20 = 0 AND q.node_key <> e.node_key) SELECT qid, id, cos, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) AS place FROM c) u WHERE place <= 10", views=False)
def vec_topk_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest of every node whose key is divisible by 20, among all others with a usable vector."""
    rows = _usable(spark, d)
    asked = rows.where("node_key % 20 = 0").select(F.col("node_key").alias("qid"), F.col("embedding").alias("qv"))
    return search.top_k(asked, rows.select(F.col("node_key").alias("id"), F.col("embedding").alias("v")), 10, exclude_self=True)
