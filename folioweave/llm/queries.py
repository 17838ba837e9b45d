"""The queries of this subpackage, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.session import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# 3. Items that appear together

_PAIRS = """
WITH m AS (SELECT DISTINCT book_id, chunk_id, e FROM (SELECT book_id, chunk_id, unnest(entities) AS e FROM i_c2e) u WHERE e IS NOT NULL AND chunk_id IS NOT NULL AND book_id IS NOT NULL),
s AS (SELECT book_id, e, count(*) AS k FROM m GROUP BY book_id, e),
n AS (SELECT book_id, count(DISTINCT chunk_id) AS n FROM i_c2e GROUP BY book_id),
p AS (SELECT x.book_id, x.e AS a, y.e AS b, count(*) AS shared FROM m x JOIN m y ON x.book_id = y.book_id AND x.chunk_id = y.chunk_id AND x.e < y.e GROUP BY x.book_id, x.e, y.e HAVING count(*) >= 3),
r AS (SELECT p.book_id, a AS entity_a, b AS entity_b, shared, sa.k AS n_a, sb.k AS n_b, n.n FROM p JOIN s sa ON sa.book_id = p.book_id AND sa.e = a JOIN s sb ON sb.book_id = p.book_id AND sb.e = b JOIN n ON n.book_id = p.book_id)
"""


def _associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioweave.llm.cooccurrence import associations

    return associations(table(spark, sf_dir, "i_c2e"), "book_id", "chunk_id", "entities", 3)


@query(_PAIRS + "SELECT book_id, entity_a, entity_b FROM r WHERE shared * n >= 2 * n_a * n_b")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity pairs of a book that share at least 3 chunks and at least twice what chance gives."""
    from folioweave.llm.cooccurrence import exceeding

    return exceeding(_associations(spark, sf_dir)).select(F.col("grp").alias("book_id"), F.col("item_a").alias("entity_a"), F.col("item_b").alias("entity_b"))


@query(_PAIRS + "SELECT book_id, entity_a, entity_b, shared, n_a, n_b, n, round(shared * n::DOUBLE / (n_a * n_b), 6) AS lift, CASE WHEN shared < n_a THEN round((1 - n_b::DOUBLE / n) / (1 - shared::DOUBLE / n_a), 6) END AS conviction FROM r")
def p3_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entity pairs of a book that share at least 3 chunks, with lift and conviction."""
    pairs = _associations(spark, sf_dir)
    return pairs.select(F.col("grp").alias("book_id"), F.col("item_a").alias("entity_a"), F.col("item_b").alias("entity_b"), "shared", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"), F.round("conviction", 6).alias("conviction"))


# 5. Splitting oversized items at natural boundaries


def _limited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = table(spark, sf_dir, "size_limits").dropDuplicates(["field_name"])
    books = table(spark, sf_dir, "book").select(F.lit("book.book_text").alias("field_name"), "book_id", F.lit("").alias("chunk_id"), F.col("book_text").alias("text"))
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks.text").alias("field_name"), "book_id", "chunk_id", "text")
    return books.unionByName(chunks).join(F.broadcast(limits), "field_name")  # one row a field


@query("SELECT DISTINCT l.field_name, t.book_id, t.chunk_id FROM (SELECT 'book.book_text' AS field_name, book_id, '' AS chunk_id, book_text AS text FROM book UNION ALL SELECT 'chunks.text', book_id, chunk_id, text FROM chunks) t JOIN size_limits l ON l.field_name = t.field_name WHERE length(t.text) > l.max_chars")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that were split because they are over their limit."""
    from folioweave.llm.splitting import split_oversized

    return split_oversized(_limited_texts(spark, sf_dir), with_text=False).where("piece_no = 1").select("field_name", "book_id", "chunk_id").distinct()


@query()
def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of the texts over their limit, with their place and text."""
    from folioweave.llm.splitting import split_oversized

    return split_oversized(_limited_texts(spark, sf_dir))


@query("SELECT DISTINCT l.field_name, t.book_id, t.chunk_id, md5(t.text) AS digest, TRUE AS within, TRUE AS joined FROM (SELECT 'book.book_text' AS field_name, book_id, '' AS chunk_id, book_text AS text FROM book UNION ALL SELECT 'chunks.text', book_id, chunk_id, text FROM chunks) t JOIN size_limits l ON l.field_name = t.field_name WHERE length(t.text) > l.max_chars")
def p5_reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text put together again from its pieces, by digest; whether all pieces are within the limit, and each begins
    the stated overlap before the end of the one before."""
    from pyspark.sql import Window

    from folioweave.llm.splitting import split_oversized

    limits = table(spark, sf_dir, "size_limits").select("field_name", "max_chars").dropDuplicates(["field_name"])
    keys = ["field_name", "book_id", "chunk_id"]
    before = F.lag("end_at", 1, 0).over(Window.partitionBy(*keys).orderBy("piece_no"))
    pieces = split_oversized(_limited_texts(spark, sf_dir)).withColumn("before", before).join(F.broadcast(limits), "field_name")
    own = F.struct("piece_no", F.expr("substring(piece, before - start_at + 1)").alias("own"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["own"]), "")
    return pieces.groupBy(*keys).agg(F.md5(whole).alias("digest"), F.bool_and(F.length("piece") <= F.col("max_chars")).alias("within"), F.bool_and(F.col("start_at") == F.greatest(F.lit(0), F.col("before") - F.col("overlap"))).alias("joined"))


# 7. Encoding with a public tokenizer


@query()
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of each document by byte_bpe_50k."""
    from folioweave.llm.bpe import once, token_ids

    return token_ids(once(table(spark, sf_dir, "documents")))


# 1. Variant spellings of names


def _linked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioweave.llm.names import link_names

    edges = table(spark, sf_dir, "edges")
    spelled = edges.select("book_id", F.explode(F.array("source", "target")).alias("name")).unionByName(table(spark, sf_dir, "i_e2c").select("book_id", F.col("entity").alias("name")))
    return link_names(spelled)


@query()
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of one entity of a book."""
    from folioweave.llm.names import variant_pairs

    return variant_pairs(_linked_names(spark, sf_dir))


@query()
def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling of a book with its entity and the entity's number of spellings."""
    from pyspark.sql import Window

    return _linked_names(spark, sf_dir).select("book_id", "name", F.count(F.lit(1)).over(Window.partitionBy("book_id", "entity")).alias("n_spellings"), F.min("name").over(Window.partitionBy("book_id", "entity")).alias("entity"))


# 4. Broken prompt and response pairs


@query()
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each prediction with a defect and its type."""
    from folioweave.llm.answers import answer_defects

    return answer_defects(table(spark, sf_dir, "predictions"), table(spark, sf_dir, "common_words"))


# 9. Text quality statistics


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioweave.llm.quality import document_kinds

    return document_kinds(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


@query()
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that is a list, a table or junk."""
    return _kinds(spark, sf_dir).where("kind <> 'prose'").select("doc_id", "kind")


@query()
def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality statistics, outlier score and kind of each document with text."""
    return _kinds(spark, sf_dir)


# 6. Most similar vectors for every vector


@query()
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nodes of which at least one is among the 10 nearest of the other."""
    from folioweave.llm.neighbours import nearest

    near = nearest(table(spark, sf_dir, "nodes"), "node_key", "embedding", 96, 10).select("key", F.explode("near").alias("other"))
    return near.select(F.least("key", "other").alias("node_a"), F.greatest("key", "other").alias("node_b")).distinct()


@query()
def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of each node with rank and cosine."""
    from folioweave.llm.neighbours import nearest

    near = nearest(table(spark, sf_dir, "nodes"), "node_key", "embedding", 96, 10)
    return near.select(F.col("key").alias("node_key"), F.posexplode(F.arrays_zip("near", "cos")).alias("pos", "x")).select("node_key", (F.col("pos") + 1).alias("place"), F.col("x.near").alias("neighbour"), F.col("x.cos").alias("cosine"))


# 2. Grouping records into similarity clusters


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from folioweave.llm.clusters import similar_groups

    leaves = table(spark, sf_dir, "nodes").where("level = 0")
    return similar_groups(leaves, "node_key", "embedding", 96), leaves


@query()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of level-0 nodes of one group."""
    from folioweave.llm.clusters import group_pairs

    return group_pairs(_groups(spark, sf_dir)[0]).select(F.col("a").alias("node_a"), F.col("b").alias("node_b"))


@query()
def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group with its size, its three most typical members, and the share of its members that the summary tree put
    under the parent it used most for them."""
    from folioweave.llm.clusters import typical_members
    from folioweave.session import cut

    groups, leaves = _groups(spark, sf_dir)
    groups = cut(groups, "groups")
    described = typical_members(groups, leaves, "node_key", "embedding", 96)
    parents = table(spark, sf_dir, "nodes").where("level > 0").select("book_id", F.col("node_id").alias("parent"), F.explode(F.array_distinct("children")).alias("child"))
    parents = parents.select("book_id", "parent", F.when(F.col("child").startswith("L"), F.col("child")).otherwise(F.concat(F.lit("L0_"), "child")).alias("node_id")).distinct()
    ids = leaves.select("node_key", "book_id", "node_id").dropDuplicates(["node_key"])
    under = groups.join(ids, groups["key"] == ids["node_key"]).join(parents, ["book_id", "node_id"]).groupBy("label", "book_id", "parent").agg(F.countDistinct("key").alias("m"))
    most = under.groupBy("label").agg(F.max("m").alias("m"))
    return described.join(most, "label", "left").select(F.col("label").alias("group_key"), F.col("n").alias("n_nodes"), "typical", F.round(F.coalesce("m", F.lit(0)) / F.col("n"), 6).alias("tree_share"))


# 8. Mixing sources to target shares


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from folioweave.llm.bpe import add_token_counts
    from folioweave.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), add_token_counts, table(spark, sf_dir, "mix_targets"))


@query()
def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture with their tokens and copies."""
    return _mix(spark, sf_dir)[0]


@query()
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of tokens that each source with a target reached."""
    return _mix(spark, sf_dir)[1]
