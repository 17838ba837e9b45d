"""Queries over sources, text functions, questions and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.functions import text as X
from folioweave.functions import vectors as V
from folioweave.operators import chunking, views
from folioweave.plans.registry import query
from folioweave.session import table
from folioweave.sources import readers


@query("SELECT DISTINCT book_id, dataset, length(book_text)::BIGINT AS n_chars FROM book WHERE book_text IS NOT NULL", views=False)
def src_load_books(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "book").where("book_text IS NOT NULL").select("book_id", "dataset", F.length("book_text").cast("bigint").alias("n_chars")).distinct()


@query(", l AS (SELECT sha256(b.book_text) AS digest, min(qid) AS first FROM qa JOIN (SELECT DISTINCT book_id, book_text FROM book WHERE book_text IS NOT NULL) b USING (book_id) GROUP BY 1) SELECT digest, (row_number() OVER (ORDER BY first) - 1)::BIGINT AS book_no FROM l")
def src_group_books(spark: SparkSession, d: str) -> DataFrame:
    books = table(spark, d, "book").where("book_text IS NOT NULL").select("book_id", "book_text").distinct()
    lines = views.questions(table(spark, d, "predictions")).select("qid", "book_id").join(books, "book_id")
    return readers.number_books(lines, "book_text", "qid").select("digest", F.col("book_no").cast("bigint").alias("book_no"))


@query(", b AS (SELECT DISTINCT book_id FROM book) SELECT b.book_id, count(q.qid)::BIGINT AS n_questions, count(q.qid) > 0 AS kept FROM b LEFT JOIN qa q USING (book_id) GROUP BY b.book_id")
def src_books_join_qa(spark: SparkSession, d: str) -> DataFrame:
    books, qa = table(spark, d, "book").select("book_id").distinct(), views.questions(table(spark, d, "predictions"))
    counted = readers.with_questions(books, qa).join(qa, "book_id").groupBy("book_id").agg(F.count("qid").alias("n_questions"), F.lit(True).alias("kept"))
    return counted.unionByName(readers.without_questions(books, qa).select("book_id", F.lit(0).cast("bigint").alias("n_questions"), F.lit(False).alias("kept")))


@query("SELECT DISTINCT book_id, split_part(book_id, '_', 2)::INT AS book_no FROM book WHERE split_part(book_id, '_', 2)::INT BETWEEN 0 AND 9", views=False)
def src_run_range(spark: SparkSession, d: str) -> DataFrame:
    books = table(spark, d, "book").select("book_id", F.split("book_id", "_")[1].cast("int").alias("book_no")).distinct()
    return readers.run_range(books, "range", 0, 9)


@query(", b AS (SELECT DISTINCT book_id FROM book) SELECT book_id, row_number() OVER (ORDER BY try_cast(book_id AS INT) NULLS LAST, book_id)::BIGINT AS place FROM b")
def src_book_order(spark: SparkSession, d: str) -> DataFrame:
    return readers.in_order(table(spark, d, "book")).select("book_id", F.col("place").cast("bigint").alias("place"))


_TRUTH = "CASE WHEN regexp_matches(ground_truth, '^[A-D]$') THEN options[ascii(ground_truth) - 64] END"


@query(f", t AS (SELECT qid, options, {_TRUTH} AS answer FROM qa WHERE len(options) > 0) SELECT qid, CASE WHEN list_position(options, answer) BETWEEN 1 AND 4 THEN ['A', 'B', 'C', 'D'][list_position(options, answer)] END AS letter FROM t WHERE answer IS NOT NULL")
def qa_answer_letter(spark: SparkSession, d: str) -> DataFrame:
    qa = views.questions(table(spark, d, "predictions")).where("size(options) > 0")
    texts = qa.withColumn("answer", X.truth_text(F.col("ground_truth"), F.col("options"), F.lit(None).cast("string"))).where("answer IS NOT NULL")
    return texts.select("qid", readers.answer_letter(F.col("options"), F.col("answer")).alias("letter"))


@query("SELECT qid, array_to_string(list_transform([1, 2, 3, 4], lambda i: coalesce(options[i], '')), '|') AS options FROM qa")
def qa_options_array(spark: SparkSession, d: str) -> DataFrame:
    qa = views.questions(table(spark, d, "predictions"))
    named = F.struct(*[F.try_element_at("options", F.lit(i + 1)).alias(x) for i, x in enumerate(readers.LETTERS)])
    return qa.select("qid", named.alias("o")).select("qid", F.array_join(readers.options_array(F.col("o")), "|").alias("options"))


@query()
def txt_clean(spark: SparkSession, d: str) -> DataFrame:
    """With compatibility normalisation, which DuckDB lacks; `txt_whitespace` checks the rest."""
    return views.chunks(table(spark, d, "chunks")).select("book_id", "chunk_id", X.clean_text(F.col("text")).alias("text"))


@query(f"SELECT book_id, chunk_id, md5({X.Sql.strip("regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")}) AS digest FROM ck")
def txt_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return views.chunks(table(spark, d, "chunks")).select("book_id", "chunk_id", F.md5(X.clean_text(F.col("text"), normalise=False)).alias("digest"))


@query(f"SELECT DISTINCT e AS entity, {X.Sql.entity_key('e')} AS entity_key FROM (SELECT unnest(entities) AS e FROM i_c2e) u WHERE e IS NOT NULL", views=False)
def txt_entity_canon(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "i_c2e").select(F.explode("entities").alias("entity")).where("entity IS NOT NULL").distinct().select("entity", X.entity_key(F.col("entity")).alias("entity_key"))


@query(f"SELECT DISTINCT n AS name, {X.Sql.relation_entity_key('n')} AS name_key FROM (SELECT source AS n FROM edges UNION SELECT target FROM edges) u WHERE n IS NOT NULL", views=False)
def txt_title_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").select(F.explode(F.array("source", "target")).alias("name")).where("name IS NOT NULL").distinct().select("name", X.relation_entity_key(F.col("name")).alias("name_key"))


@query(f"SELECT DISTINCT relation, {X.Sql.relation_key('relation')} AS relation_key FROM edges WHERE relation IS NOT NULL", views=False)
def txt_relation_canon(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").where("relation IS NOT NULL").select("relation").distinct().select("relation", X.relation_key(F.col("relation")).alias("relation_key"))


@query("SELECT DISTINCT entity, regexp_replace(entity, '[^a-zA-Z0-9_-]', '_', 'g') AS safe_id FROM i_e2c WHERE entity IS NOT NULL", views=False)
def txt_safe_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "i_e2c").where("entity IS NOT NULL").select("entity").distinct().select("entity", X.safe_id(F.col("entity")).alias("safe_id"))


@query(f"SELECT qid, {X.Sql.format_options('options')} AS options FROM qa")
def qa_format_options(spark: SparkSession, d: str) -> DataFrame:
    return views.questions(table(spark, d, "predictions")).select("qid", X.format_options(F.col("options")).alias("options"))


@query(f"SELECT qid, {X.Sql.dense_query('question', 'options')} AS dense_query FROM qa")
def qa_dense_query(spark: SparkSession, d: str) -> DataFrame:
    return views.questions(table(spark, d, "predictions")).select("qid", X.dense_query(F.col("question"), F.col("options")).alias("dense_query"))


@query(f"SELECT qid, 'Question: ' || question || chr(10) || 'Options:' || chr(10) || {X.Sql.format_options('options')} || chr(10) || 'Answer:' AS prompt FROM qa")
def qa_prompt(spark: SparkSession, d: str) -> DataFrame:
    qa = views.questions(table(spark, d, "predictions"))
    return qa.select("qid", F.concat(F.lit("Question: "), "question", F.lit("\nOptions:\n"), X.format_options(F.col("options")), F.lit("\nAnswer:")).alias("prompt"))


@query(f"SELECT qid, {X.Sql.parse_answer('raw_llm_output')} AS letter FROM qa")
def qa_parse_answer(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "predictions").select(F.col("pred_id").alias("qid"), "raw_llm_output").distinct()
    return rows.select("qid", X.parse_answer(F.col("raw_llm_output")).alias("letter"))


@query("SELECT qid, coalesce(CASE WHEN regexp_matches(ground_truth, '^[A-Z]$') THEN options[ascii(ground_truth) - 64] END, CASE WHEN pipeline = 'C1' THEN ground_truth ELSE '' END) AS truth_text FROM qa")
def qa_ground_truth_text(spark: SparkSession, d: str) -> DataFrame:
    qa = views.questions(table(spark, d, "predictions"))
    fallback = F.when(F.col("pipeline") == "C1", F.col("ground_truth")).otherwise("")
    return qa.select("qid", X.truth_text(F.col("ground_truth"), F.col("options"), fallback).alias("truth_text"))


_WINDOW, _OVERLAP = 120, 20
_STEP = _WINDOW - _OVERLAP
_WINDOWS_SQL = f"""w AS (SELECT book_id AS id, {X.Sql.words('book_text')} AS w FROM (SELECT DISTINCT book_id, book_text FROM book WHERE book_text IS NOT NULL) b),
c AS (SELECT id, w, unnest(range((1 + ceil(greatest(0, len(w) - {_WINDOW}) / {_STEP}.0))::BIGINT)) AS ord FROM w WHERE len(w) > 0),
wins AS (SELECT id, ord, w[(ord * {_STEP} + 1):(ord * {_STEP} + {_WINDOW})] AS part FROM c)"""


@query(f"WITH {_WINDOWS_SQL} SELECT id AS book_id, ord::INT AS ord, len(part)::INT AS n_tokens, md5(array_to_string(part, ' ')) AS digest FROM wins", views=False)
def chk_token_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.token_windows(table(spark, d, "book").dropDuplicates(["book_id"]), "book_id", "book_text", _WINDOW, _OVERLAP)
    return rows.select(F.col("id").alias("book_id"), "ord", "n_tokens", F.md5("text").alias("digest"))


@query(f"WITH {_WINDOWS_SQL} SELECT id AS book_id, count(*) AS n_windows, sum(len(part))::BIGINT AS n_tokens, min(len(part))::INT AS least FROM wins GROUP BY id", views=False)
def chk_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.token_windows(table(spark, d, "book").dropDuplicates(["book_id"]), "book_id", "book_text", _WINDOW, _OVERLAP)
    return rows.groupBy(F.col("id").alias("book_id")).agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n_tokens").alias("n_tokens"), F.min("n_tokens").alias("least"))


_SENT_SQL = f", s0 AS (SELECT book_id || '/' || chunk_id AS id, {X.Sql.sentences('text')} AS s FROM ck WHERE text IS NOT NULL), s AS (SELECT id, unnest(range(len(s)))::INT AS pos, unnest(s) AS sentence FROM s0)"
_SIMS_SQL = _SENT_SQL + f", v AS (SELECT id, pos, {V.letter_vector_sql('sentence')} AS v FROM s), n AS (SELECT id, pos, v, lead(v) OVER (PARTITION BY id ORDER BY pos) AS nx FROM v), sims AS MATERIALIZED (SELECT id, pos, round({V.cosine_sql('v', 'nx')}, 9) AS sim FROM n WHERE nx IS NOT NULL)"
_BRK_SQL = _SIMS_SQL + ", f AS (SELECT id, round(quantile_cont(sim, 0.25) - 1.5 * (quantile_cont(sim, 0.75) - quantile_cont(sim, 0.25)), 9) AS fence FROM sims GROUP BY id), brk AS MATERIALIZED (SELECT sims.id, pos FROM sims JOIN f USING (id) WHERE sim < fence)"


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    keyed = views.chunks(table(spark, d, "chunks")).where("text IS NOT NULL").select(F.concat_ws("/", "book_id", "chunk_id").alias("key"), "text")
    return chunking.sentence_rows(keyed, "key", "text")


@query(_SENT_SQL + " SELECT id, count(*) AS n_sentences, sum(length(sentence))::BIGINT AS n_chars FROM s GROUP BY id")
def chk_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"))


@query(_SIMS_SQL + " SELECT id, pos, round(sim, 6) AS sim FROM sims")
def chk_adjacent_cosine(spark: SparkSession, d: str) -> DataFrame:
    return chunking.adjacent_cosines(_sentences(spark, d)).select("id", "pos", F.round("sim", 6).alias("sim"))


@query(_BRK_SQL + " SELECT id, pos FROM brk")
def chk_iqr_breakpoints(spark: SparkSession, d: str) -> DataFrame:
    return chunking.iqr_breakpoints(chunking.adjacent_cosines(_sentences(spark, d)))


@query(
    _BRK_SQL
    + """, z AS (SELECT s.id, s.pos, b.pos IS NOT NULL AS brk, max(s.pos) OVER (PARTITION BY s.id) + 1 AS n FROM s LEFT JOIN brk b ON b.id = s.id AND b.pos = s.pos),
scan AS (SELECT id, pos, n, 0 AS start, (n <= 3 AND pos = n - 1) OR (n > 3 AND ((brk AND 1 >= 3) OR pos = n - 1)) AS ends FROM z WHERE pos = 0
UNION ALL SELECT z.id, z.pos, z.n, CASE WHEN scan.ends THEN z.pos ELSE scan.start END, CASE WHEN z.n <= 3 THEN z.pos = z.n - 1 ELSE (z.brk AND z.pos + 1 - (CASE WHEN scan.ends THEN z.pos ELSE scan.start END) >= 3) OR z.pos + 1 - (CASE WHEN scan.ends THEN z.pos ELSE scan.start END) >= 20 OR z.pos = z.n - 1 END
FROM scan JOIN z ON z.id = scan.id AND z.pos = scan.pos + 1)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY start) - 1)::INT AS ord, start::INT AS first_pos, (pos + 1 - start)::INT AS n_sentences FROM scan WHERE ends""",
    recursive=True,
)
def chk_semantic(spark: SparkSession, d: str) -> DataFrame:
    rows = _sentences(spark, d)
    return chunking.semantic_chunks(rows, chunking.iqr_breakpoints(chunking.adjacent_cosines(rows))).select("id", "ord", "first_pos", "n_sentences")
