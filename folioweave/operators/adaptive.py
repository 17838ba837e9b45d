"""C1, adaptive retrieval: local by entity pairs near each other in the graph, tightened by distance, else by occurrence
among dense candidates, else dense alone. All questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioweave.config import Adaptive
from folioweave.operators import graph
from folioweave.operators.questions import dense, entity_overlap
from folioweave.session import by_shuffle, stage


def entity_pairs(entities: DataFrame) -> DataFrame:
    """(qid, book_id, a, b): the unordered entity pairs of each question, a < b."""
    one = entities.select("qid", "book_id", F.col("entity").alias("a"))
    two = entities.select("qid", "book_id", F.col("entity").alias("b"))
    return one.join(two, ["qid", "book_id"]).where("a < b")


def near_pairs(pairs: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """pairs with d, kept if their shortest path has at most k hops."""
    found = graph.pair_distances(pairs.select("book_id", "a", "b").distinct(), edges, k)
    return pairs.join(by_shuffle(found.where(F.col("d") <= k)), ["book_id", "a", "b"])


def single_chunks(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(qid, entity, chunk_id): the chunks of each single entity; entities without any are left out."""
    return entities.join(mentions, ["book_id", "entity"]).select("qid", "entity", "chunk_id").distinct()


def pair_chunks(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """pairs' shared chunks: (qid, a, b, d, chunk_id). An end that no chunk mentions is skipped, so that the other's chunks
    count alone."""
    ends = pairs.select("qid", "book_id", "a", "b", "d", F.explode(F.array("a", "b")).alias("entity"))
    found = ends.join(mentions, ["book_id", "entity"])
    indexed = mentions.select("book_id", "entity").distinct()
    known = ends.join(indexed, ["book_id", "entity"], "left_semi").groupBy("qid", "a", "b").agg(F.countDistinct("entity").alias("n_known"))
    shared = found.groupBy("qid", "a", "b", "d", "chunk_id").agg(F.countDistinct("entity").alias("n"))
    return shared.join(by_shuffle(known), ["qid", "a", "b"]).where("n = n_known").select("qid", "a", "b", "d", "chunk_id")


def merge_keys(keyed: DataFrame) -> DataFrame:
    """(qid, chunk_id, key): each chunk once, under all names it was found by, sorted; keyed: qid, chunk_id, names."""
    return keyed.groupBy("qid", "chunk_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("key"))


def local(entities: DataFrame, pairs: DataFrame, mentions: DataFrame, k: int) -> DataFrame:
    """(qid, d, chunk_id, names) of the local candidates: shared chunks of near pairs with the pair's distance; where a
    question of several entities has no near pair, the chunks of its single entities at distance k."""
    shared = pair_chunks(pairs, mentions).select("qid", "d", "chunk_id", F.array("a", "b").alias("names"))
    several = entities.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("qid")
    alone = several.join(pairs.select("qid").distinct(), "qid", "left_anti")
    singles = single_chunks(entities.join(alone, "qid", "left_semi"), mentions).select("qid", F.lit(k).alias("d"), "chunk_id", F.array("entity").alias("names"))
    return shared.unionByName(singles)


def tighten(candidates: DataFrame, config: Adaptive) -> DataFrame:
    """(qid, k, n_chunks, loops, history): the distance each question ends at. From k down, a step is taken while more
    than `max_chunks` chunks are left and the next distance still has some; the counts of all distances come from one
    aggregation, so nothing loops."""
    top = config.shortest_path_k
    by_k = candidates.select("qid", "chunk_id", F.explode(F.sequence(F.col("d"), F.lit(top))).alias("k")).groupBy("qid", "k").agg(F.countDistinct("chunk_id").alias("c"))
    downward = Window.partitionBy("qid").orderBy(F.desc("k"))
    seen = by_k.withColumn("stop", (F.col("c") <= config.max_chunks) | (F.col("k") == 1) | F.lead("c").over(downward).isNull())
    chosen = seen.where("stop").groupBy("qid").agg(F.max("k").alias("k"))
    steps = seen.join(chosen.withColumnRenamed("k", "k_end"), "qid").where("k >= k_end")
    history = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "c")), False), lambda s: F.concat(s["k"].cast("string"), F.lit(":"), s["c"].cast("string"))), ",")
    ended = steps.groupBy("qid").agg(F.min("k").alias("k"), F.max(F.struct(-F.col("k"), "c"))["c"].alias("n_chunks"), (F.count(F.lit(1)) - 1).alias("loops"), history.alias("history"))
    return ended


def local_result(candidates: DataFrame, ended: DataFrame) -> DataFrame:
    """(qid, chunk_id, key) of each question at the distance it ended at."""
    kept = candidates.join(ended.select("qid", "k"), "qid").where("d <= k")
    return merge_keys(kept.select("qid", "chunk_id", "names"))


def occurrence(dense_rows: DataFrame, k: int) -> DataFrame:
    """(qid, node_id, key, place) from dense candidates with overlap: those that share entities with the question, most
    first, then by dense place; where none does, the dense order without keys."""
    best = F.max("overlap").over(Window.partitionBy("qid"))
    kept = dense_rows.withColumn("best", best).where("overlap > 0 OR best = 0")
    order = Window.partitionBy("qid").orderBy(F.desc("overlap"), "place")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "node_id", F.col("entity_list").alias("key"), F.col("rank").alias("place"), "overlap")


def entity_aware(keyed: DataFrame, k: int) -> DataFrame:
    """keyed (qid, node_id, key, overlap) by number of keys, then of shared entities; the first k; the keys under which a
    node is among them are merged; nodes without a key are 'unknown'."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.size("key")), F.desc("overlap"), "node_id", F.array_join("key", "_"))
    ranked = keyed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    merged = merge_keys(ranked.select("qid", F.col("node_id").alias("chunk_id"), F.col("key").alias("names")))
    return merged.select("qid", F.col("chunk_id").alias("node_id"), F.when(F.size("key") > 0, F.array_join("key", "_")).otherwise("unknown").alias("key"))


def retrieve(questions: DataFrame, entities: DataFrame, mentions: DataFrame, edges: DataFrame, node_texts: DataFrame, node_entities: DataFrame, config: Adaptive | None = None) -> DataFrame:
    """(qid, mode, node_id, key, place, history): the evidence of each question. Questions without entities take the dense
    order ('Global'); those with local candidates take these ('Local', with the number of tightening steps); the rest rank
    the dense pool by shared entities ('Occurrence Rerank')."""
    config = config or Adaptive()
    entities = stage(entities, "entities")
    candidates = stage(local(entities, near_pairs(entity_pairs(entities), edges, config.shortest_path_k), mentions, config.shortest_path_k), "local")
    ended = stage(tighten(candidates, config), "ended")
    named = entities.select("qid").distinct()
    global_q = questions.join(named, "qid", "left_anti")
    occurrence_q = questions.join(named, "qid", "left_semi").join(ended.select("qid"), "qid", "left_anti")
    empty = F.array().cast("array<string>")
    asked = global_q.withColumn("named", F.lit(False)).unionByName(occurrence_q.withColumn("named", F.lit(True)))
    found = stage(dense(asked, node_texts, max(config.max_chunks, config.dense_pool)).join(by_shuffle(asked.select("qid", "book_id", "named")), "qid"), "dense")  # one search for both
    all_dense = found.where(~F.col("named") & (F.col("place") <= config.max_chunks)).select("qid", F.lit("Global").alias("mode"), "node_id", empty.alias("key"), "place", F.lit("").alias("history"))
    pool = found.where(F.col("named") & (F.col("place") <= config.dense_pool))
    ranked = occurrence(entity_overlap(pool, entities, node_entities), config.max_chunks).select("qid", F.lit("Occurrence Rerank").alias("mode"), "node_id", "key", "place", F.lit("").alias("history"))
    label = F.when(F.col("loops") > 0, F.concat(F.lit("Local, Loop for "), F.col("loops").cast("string"), F.lit(" times"))).otherwise("Local")
    locals_ = local_result(candidates, ended).join(ended.select("qid", label.alias("mode"), "history"), "qid")
    placed = locals_.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("chunk_id"))).select("qid", "mode", F.col("chunk_id").alias("node_id"), "key", "place", "history")
    return all_dense.unionByName(ranked).unionByName(placed)


def result(evidence: DataFrame) -> DataFrame:
    """One row a question: qid, mode, n_chunks, chunk_ids joined in order, history."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "node_id"))), lambda s: s["node_id"]), ",")
    return evidence.groupBy("qid", "mode", "history").agg(F.count(F.lit(1)).alias("n_chunks"), ordered.alias("chunk_ids"))


def context(evidence: DataFrame, questions: DataFrame, node_texts: DataFrame) -> DataFrame:
    """(qid, context): each piece of evidence as 'key: text', or its text alone without a key, a blank line between them;
    nodes without text are skipped."""
    texts = evidence.join(questions.select("qid", "book_id"), "qid").join(node_texts.select("book_id", "node_id", "text"), ["book_id", "node_id"]).where("text IS NOT NULL AND text <> ''")
    line = F.when(F.size("key") > 0, F.concat(F.array_join("key", "_"), F.lit(": "), "text")).otherwise(F.col("text"))
    return texts.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda s: s["line"]), "\n\n").alias("context"))
