"""Queries over whole pipelines: tree building, indexing, relation extraction, evaluation of both retrievals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.config import Indexing
from folioweave.functions import text as X
from folioweave.operators import metrics, pipelines, postings, tree, views
from folioweave.operators.questions import token_overlap_sql
from folioweave.plans.index_queries import load
from folioweave.plans.registry import query
from folioweave.plans.retrieval_queries import C2_SQL, EVIDENCE_SQL
from folioweave.prompts import ANSWER, fill_sql
from folioweave.seams import StandIns
from folioweave.session import cut, stage, table

MODELS = StandIns()


@query(", n AS (SELECT book_id, count(*) AS n FROM ck GROUP BY book_id) SELECT book_id, n AS n_leaves, n > 5 AS grows, CASE WHEN n > 5 THEN n ELSE 0 END AS n_covered, TRUE AS shrinks, TRUE AS named FROM n")
def tree_build(spark: SparkSession, d: str) -> DataFrame:
    """Builds the summary trees of all books from their chunks, and tells of each: its leaves; whether it has parents; how
    many leaves have one; whether each level has fewer nodes than the one below; whether every parent has text of its
    children."""
    nodes, edges = tree.build_tree(tree.leaf_nodes(load(spark, d, "chunks")), MODELS.summarise, MODELS.embed)
    sizes = nodes.groupBy("book_id", "level").agg(F.count(F.lit(1)).alias("n"))
    levels = sizes.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("level", "n"))).alias("s"))
    shape = levels.select("book_id", F.col("s")[0]["n"].alias("n_leaves"), (F.size("s") > 1).alias("grows"), F.forall(F.sequence(F.lit(1), F.size("s")), lambda i: (i == 1) | (F.try_element_at("s", i)["n"] < F.try_element_at("s", F.greatest(i - 1, F.lit(1)))["n"])).alias("shrinks"))
    covered = edges.where(F.col("child_id").startswith("L0_")).groupBy("book_id").agg(F.countDistinct("child_id").alias("n_covered"))
    told = edges.join(nodes.select("book_id", F.col("node_id").alias("child_id"), (F.length("text") > 0).alias("has")), ["book_id", "child_id"]).groupBy("book_id", F.col("parent_id").alias("node_id")).agg(F.bool_or("has").alias("has"))
    named = nodes.where("level > 0").join(told, ["book_id", "node_id"], "left").groupBy("book_id").agg(F.bool_and((F.length("text") > 0) == F.coalesce("has", F.lit(False))).alias("named"))
    return shape.join(covered, "book_id", "left").join(named, "book_id", "left").select("book_id", "n_leaves", "grows", F.coalesce("n_covered", F.lit(0)).alias("n_covered"), "shrinks", F.coalesce("named", F.lit(True)).alias("named"))


_EDGE = "[.,;:!?()*#%\"''“”-]"
def _found_sql(rows: str) -> str:
    key = X.Sql.entity_key("name")
    names = f"SELECT book_id, chunk_id, regexp_replace(w, '^{_EDGE}+|{_EDGE}+$', '', 'g') AS name FROM (SELECT book_id, chunk_id, unnest({X.Sql.words('text')}) AS w FROM {rows}) u"
    return f"rn AS ({names}), rm AS MATERIALIZED (SELECT DISTINCT book_id, chunk_id, {key} AS entity FROM rn WHERE regexp_full_match(name, '[A-Z][a-z]{{2,}}') AND NOT ends_with(name, 'day') AND {X.Sql.is_entity(key)})"


@query(f", {_found_sql('ck')} SELECT book_id, chunk_id, entity FROM rm")
def ent_extract(spark: SparkSession, d: str) -> DataFrame:
    """Mentions by the recogniser of the texts, through the label filter."""
    return postings.extract_mentions(MODELS.recognised(load(spark, d, "chunks").select("book_id", "chunk_id", "text"), "text"))


_CACHED = f"kc AS (SELECT DISTINCT book_id, {X.Sql.chunk_key('c')} AS chunk_id FROM (SELECT book_id, unnest(chunk_ids) AS c FROM edges) u WHERE c IS NOT NULL)"
_CLEAN = lambda c: f"replace(replace({c}, chr(34), ''), chr(92), '')"
_KEY = X.Sql.relation_entity_key
_REL = f"""aj AS (SELECT book_id, chunk_id, source, target, ('0x' || substring(md5(book_id || chunk_id), 1, 1))::INT % 4 AS kind FROM (SELECT book_id, chunk_id, entity AS source, lead(entity) OVER (PARTITION BY book_id, chunk_id ORDER BY entity) AS target FROM mn) u WHERE target IS NOT NULL),
rw AS (SELECT book_id, chunk_id, {_CLEAN('source')} AS source, {_CLEAN('target')} AS target FROM aj WHERE kind < 3 AND (book_id, chunk_id) NOT IN (SELECT (book_id, chunk_id) FROM kc) AND (book_id, chunk_id) IN (SELECT (book_id, chunk_id) FROM ck) UNION ALL SELECT book_id, chunk_id, source, target FROM aj WHERE (book_id, chunk_id) IN (SELECT (book_id, chunk_id) FROM kc)),
en AS (SELECT DISTINCT book_id, chunk_id, {_KEY('entity')} AS e FROM mn),
rv AS (SELECT DISTINCT r.* FROM (SELECT book_id, chunk_id, {_KEY('source')} AS source, {_KEY('target')} AS target FROM rw WHERE source <> '' AND target <> '') r JOIN en a ON a.book_id = r.book_id AND a.chunk_id = r.chunk_id AND a.e = source JOIN en b ON b.book_id = r.book_id AND b.chunk_id = r.chunk_id AND b.e = target WHERE source <> target)"""


@query(f", {_CACHED}, {_REL} SELECT book_id, source, 'next' AS relation, target, count(*)::DOUBLE AS weight, string_agg(DISTINCT chunk_id, '|' ORDER BY chunk_id) AS chunk_ids FROM rv GROUP BY book_id, source, target")
def rel_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Relations of all chunks: cached for the chunks that stored edges name, asked anew for the others, merged to edges."""
    from folioweave.operators.relations import adjacent_relations

    mentions = cut(load(spark, d, "mentions"), "mentions")
    named = table(spark, d, "edges").select("book_id", F.explode("chunk_ids").alias("c")).where("c IS NOT NULL").select("book_id", X.chunk_key(F.col("c")).alias("chunk_id")).distinct()
    known = adjacent_relations(mentions).join(named, ["book_id", "chunk_id"], "left_semi")
    cached = known.groupBy("book_id", "chunk_id").agg(F.collect_list(F.struct("source", "relation", "target")).alias("items"))
    edges, _ = pipelines.extract_relations(load(spark, d, "chunks"), mentions, MODELS, cached)
    return edges.withColumn("chunk_ids", F.array_join("chunk_ids", "|"))


_W, _O = Indexing().window, Indexing().overlap
_BOOKS = f"""WITH bt AS (SELECT DISTINCT book_id, {X.Sql.strip("regexp_replace(regexp_replace(book_text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM book WHERE book_id IS NOT NULL),
bw AS (SELECT book_id, {X.Sql.words('text')} AS w FROM bt WHERE text IS NOT NULL), bc AS MATERIALIZED (SELECT book_id, 'L0_chunk_' || i AS chunk_id, array_to_string(w[(i * {_W - _O} + 1):(i * {_W - _O} + {_W})], ' ') AS text FROM (SELECT book_id, w, unnest(range((1 + ceil(greatest(0, len(w) - {_W}) / {_W - _O}.0))::BIGINT)) AS i FROM bw WHERE len(w) > 0) u),
{_found_sql('bc')}"""


@query(_BOOKS + " SELECT c.book_id, n_chunks, coalesce(n_mentions, 0) AS n_mentions, coalesce(n_entities, 0) AS n_entities FROM (SELECT book_id, count(*) AS n_chunks FROM bc GROUP BY book_id) c LEFT JOIN (SELECT book_id, count(*) AS n_mentions, count(DISTINCT entity) AS n_entities FROM rm GROUP BY book_id) m USING (book_id)", views=False)
def idx_books(spark: SparkSession, d: str) -> DataFrame:
    """Indexes all books from their texts with the default settings, and counts what each got. Compatibility
    normalisation is off, as DuckDB lacks it."""
    books = table(spark, d, "book").select("book_id", "book_text").dropDuplicates(["book_id"])
    index = pipelines.index_books(books, MODELS, normalise=False)
    chunks = index.leaves.where(F.col("node_id") == F.col("chunk_id")).groupBy("book_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    found = index.mentions.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_mentions"), F.countDistinct("entity").alias("n_entities"))
    return chunks.join(found, "book_id", "left").select("book_id", "n_chunks", F.coalesce("n_mentions", F.lit(0)).alias("n_mentions"), F.coalesce("n_entities", F.lit(0)).alias("n_entities"))


def _index(spark: SparkSession, d: str) -> pipelines.Index:
    """The stored artifacts as an index."""
    leaves, mentions = stage(load(spark, d, "leaves"), "leaves"), stage(load(spark, d, "mentions"), "mentions")
    bridge = stage(postings.node_entities(leaves, mentions), "bridge")
    return pipelines.Index(load(spark, d, "chunks"), stage(load(spark, d, "node_texts"), "texts"), load(spark, d, "tree_edges"), leaves, mentions, bridge, load(spark, d, "graph"))


_LISTED = f"CASE WHEN len(options) > 0 THEN question || chr(10) || 'Options:' || chr(10) || {X.Sql.format_options('options')} ELSE question END"


def _answers_sql(pipeline: str) -> str:
    overlap = token_overlap_sql("coalesce(o, '')", "evidence")
    return f""", wc AS (SELECT qa.*, coalesce(context, '') AS evidence FROM qa LEFT JOIN cx USING (qid) WHERE pipeline = '{pipeline}'),
ws AS (SELECT *, list_transform(options, lambda o: {overlap}) AS scores FROM wc),
wa AS (SELECT *, CASE WHEN len(options) > 0 THEN 'Answer: ' || chr(64 + list_position(scores, list_max(scores))) ELSE array_to_string({X.Sql.words('evidence')}[1:8], ' ') END AS raw FROM ws)
SELECT qid, md5({fill_sql(ANSWER, question=f'({_LISTED})', evidence='evidence')}) AS digest, CASE WHEN len(options) > 0 THEN {X.Sql.parse_answer('raw')} ELSE {X.Sql.strip('raw')} END AS prediction, ({X.Sql.standardise(f"CASE WHEN len(options) > 0 THEN {X.Sql.parse_answer('raw')} ELSE {X.Sql.strip('raw')} END")} = {X.Sql.standardise("coalesce(ground_truth, '')")})::INT::DOUBLE AS em FROM wa"""


def _told(answers: DataFrame) -> DataFrame:
    return answers.select("qid", F.md5("prompt").alias("digest"), "prediction", metrics.exact_match(F.col("prediction"), F.col("ground_truth")).alias("em"))


@query(EVIDENCE_SQL + ", cx AS MATERIALIZED (SELECT ev.qid, string_agg(CASE WHEN len(key) > 0 THEN array_to_string(key, '_') || ': ' || text ELSE text END, chr(10) || chr(10) ORDER BY place) AS context FROM ev JOIN q1 USING (qid) JOIN nt ON nt.book_id = q1.book_id AND nt.node_id = ev.node_id WHERE text IS NOT NULL AND text <> '' GROUP BY ev.qid)" + _answers_sql("C1"), recursive=True)
def eval_c1(spark: SparkSession, d: str) -> DataFrame:
    """C1 from questions to scored answers."""
    return _told(pipelines.evaluate_adaptive(views.questions(table(spark, d, "predictions"), "C1"), _index(spark, d), MODELS))


@query(C2_SQL + ", cx AS MATERIALIZED (SELECT qid, string_agg(text, chr(10) || chr(10) ORDER BY place) AS context FROM rr GROUP BY qid)" + _answers_sql("C2"), recursive=True)
def eval_c2(spark: SparkSession, d: str) -> DataFrame:
    """C2 from questions to scored answers."""
    return _told(pipelines.evaluate_region(views.questions(table(spark, d, "predictions"), "C2"), _index(spark, d), MODELS))
