"""The property graph: triples as loaded, entities, upserts, mentions, and bounded shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioweave.functions import text as X
from folioweave.session import by_shuffle, cut, stage


def normalise(edges: DataFrame) -> DataFrame:
    """(book_id, source, relation, target, weight, support_count, chunk_ids): fields trimmed, a missing or zero weight 1,
    support the number of distinct chunks; triples with an empty part dropped. A scalar chunk id becomes a list."""
    ids = F.col("chunk_ids")
    if dict(edges.dtypes)["chunk_ids"] == "string":
        ids = F.when(ids.isNotNull(), F.array(ids))
    ids = F.coalesce(ids, F.array().cast("array<string>"))
    rows = edges.select("book_id", *[X.strip(F.col(c)).alias(c) for c in ("source", "relation", "target")], F.coalesce(F.nullif(F.col("weight").cast("double"), F.lit(0.0)), F.lit(1.0)).alias("weight"), F.transform(F.filter(ids, lambda x: x.isNotNull()), X.chunk_key).alias("chunk_ids"))
    kept = rows.where("source <> '' AND relation <> '' AND target <> ''")
    return kept.withColumn("support_count", F.size(F.array_distinct("chunk_ids"))).select("book_id", "source", "relation", "target", "weight", "support_count", "chunk_ids")


def normalise_arrivals(arrived: DataFrame, time: str) -> DataFrame:
    """`normalise` with the arrival time kept, by which upserts are ordered."""
    keyed = normalise(arrived.withColumn("book_id", F.struct("book_id", F.col(time).alias("at"))))
    return keyed.select(F.col("book_id.book_id").alias("book_id"), *[c for c in keyed.columns if c != "book_id"], F.col("book_id.at").alias(time))


def upsert(edges: DataFrame, order: str) -> DataFrame:
    """One row a triple of a book: the last by `order`, then the one of more support and weight, then by its chunks."""
    last = Window.partitionBy("book_id", "source", "relation", "target").orderBy(F.desc_nulls_last(order), F.desc("support_count"), F.desc("weight"), F.array_join("chunk_ids", ","))
    return edges.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")


def entities(edges: DataFrame) -> DataFrame:
    return edges.select("book_id", F.explode(F.array("source", "target")).alias("name")).distinct()


def mentioned_in(edges: DataFrame) -> DataFrame:
    """(book_id, name, chunk_id): both ends of an edge are mentioned in each chunk of its evidence."""
    return edges.select("book_id", F.explode(F.array("source", "target")).alias("name"), "chunk_ids").select("book_id", "name", F.explode("chunk_ids").alias("chunk_id")).distinct()


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that occur more than once, with their number: empty where a table keeps its uniqueness."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def undirected(edges: DataFrame) -> DataFrame:
    ends = edges.select("book_id", F.col("source").alias("a"), F.col("target").alias("b")).where("a <> b")
    return ends.unionByName(ends.select("book_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def distances(starts: DataFrame, edges: DataFrame, hops: int = 4) -> DataFrame:
    """(book_id, start, node, d): the nodes at each least number of hops 0 .. `hops` from each start (book_id, start),
    over edges without direction. All starts of all books go one hop at a time; a hop keeps nodes not seen before and is
    written, so the next one recomputes nothing. It stops early when a hop reaches nothing new."""
    links = stage(undirected(edges), "links")
    seen = stage(starts.select("book_id", "start").distinct().select("book_id", "start", F.col("start").alias("node"), F.lit(0).alias("d")), "hop0")
    frontier = seen
    for d in range(1, hops + 1):
        reached = frontier.select("book_id", "start", F.col("node").alias("a")).join(links, ["book_id", "a"]).select("book_id", "start", F.col("b").alias("node")).distinct()
        frontier = stage(reached.join(by_shuffle(seen.select("book_id", "start", "node")), ["book_id", "start", "node"], "left_anti").withColumn("d", F.lit(d)), f"hop{d}")
        seen = seen.unionByName(frontier)
        if frontier.limit(1).count() == 0:
            break
    return seen


def pair_distances(pairs: DataFrame, edges: DataFrame, hops: int = 4) -> DataFrame:
    """pairs (book_id, a, b) with d, their least number of hops if at most `hops`, else null.

    Both ends go half the way: a shortest path of `hops` steps has a node that the one end reaches in half of them and the
    other in the rest, so the neighbourhoods joined are those of half the depth."""
    half = (hops + 1) // 2
    ends = pairs.select("book_id", F.explode(F.array("a", "b")).alias("start"))
    reached = stage(distances(ends, edges, half), "half")
    one = reached.select("book_id", F.col("start").alias("a"), "node", F.col("d").alias("da"))
    two = reached.where(F.col("d") <= hops - half).select("book_id", F.col("start").alias("b"), "node", F.col("d").alias("db"))
    known = pairs.select("book_id", "a", "b").distinct()
    met = known.join(by_shuffle(one), ["book_id", "a"]).join(by_shuffle(two), ["book_id", "b", "node"]).groupBy("book_id", "a", "b").agg(F.min(F.col("da") + F.col("db")).alias("d"))
    return pairs.join(by_shuffle(met), ["book_id", "a", "b"], "left")


def shortest_paths(pairs: DataFrame, edges: DataFrame, hops: int = 4) -> DataFrame:
    """(book_id, a, b, d, path): for each pair within reach the first of its shortest paths by the names on it, joined by
    ' > '. Paths are rebuilt backwards along nodes whose distance falls by one."""
    reached = cut(distances(pairs.select("book_id", F.col("a").alias("start")), edges, hops), "reached")
    links = undirected(edges)
    ends = pairs.join(reached.select("book_id", F.col("start").alias("a"), F.col("node").alias("b"), "d"), ["book_id", "a", "b"])
    best = reached.where("d = 0").select("book_id", "start", "node", F.col("node").alias("path"))
    every = best
    for d in range(1, hops + 1):
        layer = reached.where(F.col("d") == d).select("book_id", "start", "node")
        steps = layer.join(links.select("book_id", F.col("a").alias("node"), F.col("b").alias("before")), ["book_id", "node"])
        joined = steps.join(best.select("book_id", "start", F.col("node").alias("before"), "path"), ["book_id", "start", "before"])
        best = joined.groupBy("book_id", "start", "node").agg(F.min(F.concat_ws(" > ", "path", "node")).alias("path"))
        every = every.unionByName(best)
    return ends.join(every.select("book_id", F.col("start").alias("a"), F.col("node").alias("b"), "path"), ["book_id", "a", "b"])
