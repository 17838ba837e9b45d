"""C2, region retrieval: the tree gives a region of chunks and entities, seeds walk the graph inside it, candidates are
ranked twice. All questions at once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioweave.config import Region
from folioweave.operators.questions import dense, distinct_tokens, entity_overlap, share_of, token_sets
from folioweave.session import by_shuffle, stage


def tree_prune(questions: DataFrame, node_texts: DataFrame, tokens: DataFrame, config: Region, rerank: bool = True) -> DataFrame:
    """(qid, node_id, score, place): summary nodes among the nearest `top_m * search_factor` nodes, reranked, the first
    `top_m`. Leaves are dropped after the search, as the index holds them too, so fewer than `top_m` may be left."""
    found = dense(questions, node_texts, config.top_m * config.search_factor).where(~F.col("node_id").startswith("L0_"))
    asked = questions.select("qid", "book_id", distinct_tokens(F.col("question")).alias("asked"))
    joined = found.join(by_shuffle(asked), "qid").join(by_shuffle(tokens), ["book_id", "node_id"])
    scored = joined.withColumn("score", share_of(F.col("asked"), F.col("tokens")) if rerank else F.col("cos"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "node_id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= config.top_m).select("qid", "book_id", "node_id", "score", "place")


def region_chunks(selected: DataFrame, leaves: DataFrame) -> DataFrame:
    return selected.select("qid", "book_id", "node_id").join(leaves, ["book_id", "node_id"]).select("qid", "book_id", "chunk_id").distinct()


def region_entities(selected: DataFrame, node_entities: DataFrame) -> DataFrame:
    return selected.select("qid", "book_id", "node_id").join(node_entities, ["book_id", "node_id"]).select("qid", "book_id", "entity").distinct()


def seeds_found(entities: DataFrame, in_region: DataFrame) -> DataFrame:
    """(qid, book_id, entity): the question's entities that the region has."""
    return entities.select("qid", "book_id", "entity").join(in_region, ["qid", "book_id", "entity"], "left_semi")


def seeds_frequent(chunks: DataFrame, in_region: DataFrame, mentions: DataFrame, taken: DataFrame, most: int) -> DataFrame:
    """(qid, book_id, entity, freq): for questions without seeds the region's entities of most chunks."""
    open_ = chunks.join(taken.select("qid").distinct(), "qid", "left_anti")
    counted = open_.join(mentions, ["book_id", "chunk_id"]).join(in_region, ["qid", "book_id", "entity"], "left_semi").groupBy("qid", "book_id", "entity").agg(F.countDistinct("chunk_id").alias("freq"))
    order = Window.partitionBy("qid").orderBy(F.desc("freq"), "entity")
    return counted.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).drop("rn")


def traverse(seeds: DataFrame, edges: DataFrame, in_region: DataFrame, chunks: DataFrame, hops: int = 1) -> DataFrame:
    """(qid, book_id, source, relation, target, weight, evidence): edges of either direction from a seed to an entity of
    the region, with those of their chunks that lie in the region; edges without such a chunk are dropped. With more hops
    the entities reached are seeds of the next one."""
    both = edges.select("book_id", F.col("source").alias("s"), "relation", F.col("target").alias("t"), "weight", "chunk_ids")
    both = both.unionByName(edges.where("source <> target").select("book_id", F.col("target").alias("s"), "relation", F.col("source").alias("t"), "weight", "chunk_ids"))
    found, frontier, known = None, seeds.select("qid", "book_id", F.col("entity").alias("s")).distinct(), None
    for _ in range(hops):
        near = frontier.join(both, ["book_id", "s"]).join(in_region.select("qid", "book_id", F.col("entity").alias("t")), ["qid", "book_id", "t"], "left_semi")
        kept = near.select("qid", "book_id", "s", "relation", "t", "weight", F.explode(F.array_distinct("chunk_ids")).alias("chunk_id")).join(chunks, ["qid", "book_id", "chunk_id"], "left_semi")
        step = kept.groupBy("qid", "book_id", F.col("s").alias("source"), "relation", F.col("t").alias("target"), "weight").agg(F.array_sort(F.collect_set("chunk_id")).alias("evidence"))
        found = step if found is None else found.unionByName(step).distinct()
        if hops > 1:
            known = frontier if known is None else known.unionByName(frontier)
            frontier = stage(step.select("qid", "book_id", F.col("target").alias("s")).distinct().join(known, ["qid", "book_id", "s"], "left_anti"), "frontier")
    return found


def visited(seeds: DataFrame, records: DataFrame) -> DataFrame:
    """(qid, book_id, entity): seeds and both ends of all records."""
    ends = records.select("qid", "book_id", F.explode(F.array("source", "target")).alias("entity"))
    return seeds.select("qid", "book_id", "entity").unionByName(ends).distinct()


def candidates(records: DataFrame, closed: DataFrame, mentions: DataFrame, chunks: DataFrame, texts: DataFrame, per_entity: int = 10) -> DataFrame:
    """(qid, book_id, node_id, sources, is_edge_evidence): chunks of edge evidence, and of each visited entity its
    first `per_entity` chunks in the region; those without text are dropped. texts: book_id, chunk_id, ord, text."""
    from_edges = records.select("qid", "book_id", F.explode("evidence").alias("chunk_id")).distinct().withColumn("origin", F.lit("edge"))
    placed = closed.join(mentions, ["book_id", "entity"]).join(chunks, ["qid", "book_id", "chunk_id"], "left_semi").join(by_shuffle(texts.select("book_id", "chunk_id", "ord")), ["book_id", "chunk_id"])
    order = Window.partitionBy("qid", "entity").orderBy("ord", "chunk_id")
    from_entities = placed.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_entity).select("qid", "book_id", "chunk_id").distinct().withColumn("origin", F.lit("entity"))
    merged = from_edges.unionByName(from_entities).groupBy("qid", "book_id", "chunk_id").agg(F.array_sort(F.collect_set("origin")).alias("sources"), F.bool_or(F.col("origin") == "edge").alias("is_edge_evidence"))
    with_text = texts.where("text IS NOT NULL AND text <> ''").select("book_id", "chunk_id")
    return merged.join(by_shuffle(with_text), ["book_id", "chunk_id"], "left_semi").withColumnRenamed("chunk_id", "node_id")


def prerank(rows: DataFrame, pool: int) -> DataFrame:
    """The first `pool` candidates: edge evidence first, then more shared entities, then by id."""
    order = Window.partitionBy("qid").orderBy(F.desc("is_edge_evidence"), F.desc("overlap"), "node_id")
    return rows.withColumn("pre", F.row_number().over(order)).where(F.col("pre") <= pool)


def rerank(rows: DataFrame, questions: DataFrame, tokens: DataFrame, k: int) -> DataFrame:
    """The k candidates of highest reranker score with their place; ties by the first ranking."""
    asked = questions.select("qid", distinct_tokens(F.col("question")).alias("asked"))
    scored = rows.join(by_shuffle(asked), "qid").join(by_shuffle(tokens), ["book_id", "node_id"]).withColumn("score", share_of(F.col("asked"), F.col("tokens"))).drop("asked", "tokens")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "pre")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def region_candidates(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """Tree-only candidates: all chunks of the region with text."""
    rows = chunks.join(by_shuffle(texts.where("text IS NOT NULL AND text <> ''").select("book_id", "chunk_id")), ["book_id", "chunk_id"], "left_semi")
    return rows.select("qid", "book_id", F.col("chunk_id").alias("node_id"), F.array(F.lit("region")).alias("sources"), F.lit(False).alias("is_edge_evidence"))


class Stages:
    """The intermediate results of one run over all questions, each made once, when it is first asked for."""

    def __init__(self, questions: DataFrame, entities: DataFrame, mentions: DataFrame, edges: DataFrame, node_texts: DataFrame, texts: DataFrame, leaves: DataFrame, node_entities: DataFrame, config: Region | None = None):
        self.questions, self.given, self.mentions, self.edges = questions, entities, mentions, edges
        self.node_texts, self.texts, self.leaves, self.node_entities = node_texts, texts, leaves, node_entities
        self.config = config or Region()

    @cached_property
    def tokens(self) -> DataFrame:
        return stage(token_sets(self.node_texts), "tokens")

    @cached_property
    def selected(self) -> DataFrame:
        return stage(tree_prune(self.questions, self.node_texts, self.tokens, self.config), "selected")

    @cached_property
    def chunks(self) -> DataFrame:
        rows = region_chunks(self.selected, self.leaves)
        if self.config.strict_reference_ids:  # region ids lose their prefix while all other tables keep it, as in the reference
            rows = rows.withColumn("chunk_id", F.regexp_replace("chunk_id", "^L0_", ""))
        return stage(rows, "chunks")

    @cached_property
    def entities(self) -> DataFrame:
        return stage(region_entities(self.selected, self.node_entities), "region_entities")

    @cached_property
    def seeds_direct(self) -> DataFrame:
        return stage(seeds_found(self.given, self.entities), "direct")

    @cached_property
    def seeds_frequent(self) -> DataFrame:
        return seeds_frequent(self.chunks, self.entities, self.mentions, self.seeds_direct, self.config.seed_fallback)

    @cached_property
    def seeds(self) -> DataFrame:
        return stage(self.seeds_direct.unionByName(self.seeds_frequent.drop("freq")), "seeds")

    @cached_property
    def records(self) -> DataFrame:
        return stage(traverse(self.seeds, self.edges, self.entities, self.chunks, self.config.max_hops), "records")

    @cached_property
    def visited(self) -> DataFrame:
        return visited(self.seeds, self.records)

    @cached_property
    def candidates(self) -> DataFrame:
        found = candidates(self.records, self.visited, self.mentions, self.chunks, self.texts, self.config.mentions_per_entity)
        return stage(entity_overlap(found, self.given, self.node_entities), "candidates")

    @cached_property
    def route(self) -> DataFrame:
        counted = lambda rows, name: rows.groupBy("qid").agg(F.count(F.lit(1)).alias(name))
        counts = self.questions.select("qid")
        for rows, name in ((self.seeds, "n_seeds"), (self.candidates, "n_candidates"), (self.chunks, "n_region"), (self.records, "n_relations")):
            counts = counts.join(counted(rows, name), "qid", "left")
        counts = counts.fillna(0, ["n_seeds", "n_candidates", "n_region", "n_relations"])
        mode = F.when(F.col("n_seeds") < self.config.min_seeds, "fallback_no_seeds").when(F.col("n_candidates") < self.config.min_candidates, "fallback_no_candidates").otherwise("graph_traversal")
        return stage(counts.withColumn("mode", mode), "route")

    @cached_property
    def fallback(self) -> DataFrame:
        whole = self.chunks.join(self.route.where("mode <> 'graph_traversal'").select("qid"), "qid", "left_semi")
        return entity_overlap(region_candidates(whole, self.texts), self.given, self.node_entities)

    @cached_property
    def pool(self) -> DataFrame:
        walked = self.candidates.join(self.route.where("mode = 'graph_traversal'").select("qid"), "qid", "left_semi")
        columns = ["qid", "book_id", "node_id", "sources", "is_edge_evidence", "overlap"]
        return stage(prerank(walked.select(*columns).unionByName(self.fallback.select(*columns)), self.config.candidate_pool), "pool")

    @cached_property
    def ranked(self) -> DataFrame:
        return rerank(self.pool, self.questions, self.tokens, self.config.final_k)


def result(stages: Stages) -> DataFrame:
    """One row a question: mode, counts, chunk ids and context in final order; questions without evidence have none."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "node_id", "text")))
    final = stages.ranked.join(by_shuffle(stages.texts.select("book_id", F.col("chunk_id").alias("node_id"), "text")), ["book_id", "node_id"])
    texts = final.groupBy("qid").agg(ordered.alias("o")).select("qid", F.array_join(F.transform("o", lambda x: x["node_id"]), ",").alias("chunk_ids"), F.array_join(F.transform("o", lambda x: x["text"]), "\n\n").alias("context"))
    return stages.route.join(texts, "qid", "left").select("qid", "mode", "n_seeds", "n_region", "n_relations", "n_candidates", F.coalesce("chunk_ids", F.lit("")).alias("chunk_ids"), F.coalesce("context", F.lit("")).alias("context"))
