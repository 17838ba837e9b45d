"""The summary tree: leaves, soft clusters, parents, leaf roll-up, levels."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioweave.config import Indexing
from folioweave.session import by_shuffle, cut


def leaf_nodes(chunks: DataFrame) -> DataFrame:
    """Level 0: one node a chunk, which is its own leaf."""
    return chunks.select("book_id", F.col("chunk_id").alias("node_id"), F.lit(0).alias("level"), "text", F.array("chunk_id").alias("leaves"))


def leaf_rollup(edges: DataFrame, leaves: DataFrame, levels: int) -> DataFrame:
    """(book_id, node_id, chunk_id): the leaves under each node, its own one for a leaf. One join a level; a level's
    result is written, so lineage stays short. `levels` is the tree's height, known from its nodes."""
    reached = leaves.select("book_id", "node_id", F.col("node_id").alias("chunk_id"))
    every = reached
    for _ in range(levels):
        up = edges.join(by_shuffle(reached.withColumnRenamed("node_id", "child_id")), ["book_id", "child_id"]).select("book_id", F.col("parent_id").alias("node_id"), "chunk_id").distinct()
        reached = cut(up.join(by_shuffle(every), ["book_id", "node_id", "chunk_id"], "left_anti"), "rollup")
        every = every.unionByName(reached)
    return every.distinct()


def parents_of(edges: DataFrame) -> DataFrame:
    """(book_id, node_id, n_parents, parents): the back-links of each child, sorted and joined by commas."""
    return edges.groupBy("book_id", F.col("child_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_parents"), F.array_join(F.array_sort(F.collect_set("parent_id")), ",").alias("parents"))


def group_parents(assigned: DataFrame, level: int) -> DataFrame:
    """(book_id, parent_id, child_id) from (book_id, node_id, cluster): a parent for each cluster, named by level and number."""
    return assigned.select("book_id", F.concat(F.lit(f"L{level}_C"), F.col("cluster").cast("string")).alias("parent_id"), F.col("node_id").alias("child_id")).distinct()


def level_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("book_id", "level").agg(F.count(F.lit(1)).alias("n_nodes"))


def stop_levels(stats: DataFrame, stop_nodes: int = 5) -> DataFrame:
    """(book_id, level, n_nodes, n_next, grows): whether a level is clustered further (more nodes than `stop_nodes`) and
    the next one kept (fewer nodes than this one)."""
    following = F.lead("n_nodes").over(Window.partitionBy("book_id").orderBy("level"))
    return stats.withColumn("n_next", F.coalesce(following, F.lit(0))).withColumn("grows", (F.col("n_nodes") > stop_nodes) & (F.col("n_next") > 0) & (F.col("n_next") < F.col("n_nodes")))


def soft_assign(probabilities: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(id, cluster) from (id, p array): all clusters above the threshold, else the likeliest, the first among equals."""
    over = F.filter(F.transform("p", lambda x, i: F.struct(x.alias("p"), i.alias("c"))), lambda s: s["p"] > threshold)
    best = F.array(F.struct(F.array_max("p").alias("p"), (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("c")))
    return probabilities.where("size(p) > 0").select("id", F.explode(F.when(F.size(over) > 0, over).otherwise(best)).alias("s")).select("id", F.col("s.c").alias("cluster"))


@dataclass(frozen=True)
class Mixture:
    """A Gaussian mixture with full covariances: weights (k), means (k, d), lower triangles of the covariances (k, d, d)."""

    weights: np.ndarray
    means: np.ndarray
    roots: np.ndarray

    def logs(self, x: np.ndarray) -> np.ndarray:
        d, out = x.shape[1], np.empty((len(x), len(self.weights)))
        for j, (w, m, root) in enumerate(zip(self.weights, self.means, self.roots)):
            z = np.linalg.solve(root, (x - m).T)
            out[:, j] = np.log(w) - 0.5 * (z**2).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * d * np.log(2 * np.pi)
        return out

    def responsibilities(self, x: np.ndarray) -> np.ndarray:
        return _shares(self.logs(x))[0]


def _shares(logs: np.ndarray) -> tuple[np.ndarray, float]:
    """(probabilities of the components, log likelihood of all rows)."""
    top = logs.max(axis=1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
    return np.exp(logs - total[:, None]), float(total.sum())


def _fit_mixture(x: np.ndarray, k: int, seed: int = 42, rounds: int = 40, floor: float = 1e-5) -> tuple[Mixture, float]:
    """A mixture of k components and its log likelihood, by expectation and maximisation."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    means = x[rng.choice(n, k, replace=False)].copy()
    spread = np.cov(x.T).reshape(d, d) + floor * np.eye(d)
    mix = Mixture(np.full(k, 1.0 / k), means, np.repeat(np.linalg.cholesky(spread)[None], k, axis=0))
    before = -np.inf
    for _ in range(rounds):
        p, like = _shares(mix.logs(x))
        if like - before < 1e-6 * max(1.0, abs(like)):
            break
        before = like
        mass = p.sum(axis=0) + 1e-12
        means = (p.T @ x) / mass[:, None]
        roots = np.empty((k, d, d))
        for j in range(k):
            c = x - means[j]
            roots[j] = np.linalg.cholesky((p[:, j][:, None] * c).T @ c / mass[j] + floor * np.eye(d))
        mix = Mixture(mass / n, means, roots)
    return mix, like


def choose_clusters(x: np.ndarray, most: int = 50) -> tuple[int, np.ndarray, list[float]]:
    """(k, responsibilities, criteria): the mixture of least BIC among 1 .. min(most, n // 2) - 1 components, stopping at
    the first that cannot be fitted."""
    mix, scores = choose_mixture(x, most)
    return (1, np.ones((len(x), 1)), scores) if mix is None else (len(mix.weights), mix.responsibilities(x), scores)


def choose_mixture(x: np.ndarray, most: int = 50) -> tuple[Mixture | None, list[float]]:
    """The mixture that `choose_clusters` chooses, none where all rows are one cluster."""
    n, d = x.shape
    top = min(most, max(1, n // 2))
    found, scores = None, []
    for k in range(1, top):
        try:
            mix, like = _fit_mixture(x, k)
        except np.linalg.LinAlgError:
            break
        free = k * d * (d + 1) / 2 + k * d + k - 1
        scores.append(-2 * like + free * math.log(n))
        if scores[-1] == min(scores):
            found = mix
    return found, scores


def reduce_dim(vectors: DataFrame, dim: int = 10, sample: int = 20_000) -> DataFrame:
    """(book_id, node_id, z): unit vectors on their main axes, fitted on a bounded sample (`sample` rows by hash). A linear
    stand-in for the reference's manifold reduction."""
    total = vectors.count()
    every = max(1, -(-total // sample))
    fit = vectors.where(F.pmod(F.xxhash64("book_id", "node_id"), F.lit(every)) == 0).select("book_id", "node_id", "embedding").limit(2 * sample).toPandas().sort_values(["book_id", "node_id"])
    rows = np.stack(fit["embedding"].to_numpy()).astype(np.float64) if len(fit) else np.zeros((0, 1))
    rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    mean = rows.mean(axis=0) if len(rows) else np.zeros(rows.shape[1])
    dim = min(dim, max(1, len(rows) - 2), rows.shape[1])
    axes = np.linalg.svd(rows - mean, full_matrices=False)[2][:dim] if len(rows) else np.zeros((dim, rows.shape[1]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"book_id": part["book_id"], "node_id": part["node_id"], "z": list((x - mean) @ axes.T)})

    return vectors.select("book_id", "node_id", "embedding").mapInPandas(run, "book_id string, node_id string, z array<double>")


def _chosen(p: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cluster) of all clusters above the threshold, else of the likeliest."""
    over = p > threshold
    none = ~over.any(axis=1)
    over[none, p[none].argmax(axis=1)] = True
    return np.nonzero(over)


def mixture_clusters(rows: DataFrame, keys: list[str], threshold: float, most: int, sample: int = 2000) -> DataFrame:
    """(keys, node_id, cluster, z): soft clusters of the rows (keys, node_id, z) of each group.

    A mixture is fitted to at most about `sample` rows of a group, chosen by a hash of the node, and every row gets its
    clusters from that: parts of a group of bounded size, each with the group's mixture, so that a group of any size is in
    no single task. A group of no more rows than coordinates and one is one cluster."""
    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    sized = cut(rows.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys).withColumn("h", F.pmod(F.xxhash64("node_id"), F.lit(1 << 30))), "sized")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node_id", kind="stable")  # the fit must not depend on the rows' order
        x = np.stack(part["z"].to_numpy())
        mix = choose_mixture(x, most)[0] if len(x) > x.shape[1] + 1 else None
        return pd.DataFrame({**{k: [part[k].iloc[0]] for k in keys}, "model": [None if mix is None else pickle.dumps(mix)]})

    models = sized.where(F.col("h") < (1 << 30) * (F.lit(float(sample)) / F.col("n"))).groupBy(*keys).applyInPandas(fit, f"{kinds}, model binary")
    salts = sized.groupBy(*keys).agg(F.max("n").alias("n")).select(*keys, F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / sample).cast("int"))).alias("salt"))
    models = cut(salts.join(models, keys, "left"), "models")  # one a part of a group
    parts = sized.withColumn("salt", F.pmod("h", F.floor((F.col("n") - 1) / sample).cast("int") + 1).cast("int")).select(*keys, "salt", "node_id", "z")

    def assign(part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame(columns=[*keys, "node_id", "cluster", "z"])
        stored = model["model"].iloc[0] if len(model) else None
        p = np.ones((len(part), 1)) if stored is None else pickle.loads(stored).responsibilities(np.stack(part["z"].to_numpy()))
        i, c = _chosen(p, threshold)
        chosen = part.iloc[i]
        return pd.DataFrame({**{k: chosen[k].to_numpy() for k in keys}, "node_id": chosen["node_id"].to_numpy(), "cluster": c.astype(np.int32), "z": chosen["z"].to_numpy()})

    by = [*keys, "salt"]
    return parts.groupBy(*by).cogroup(models.groupBy(*by)).applyInPandas(assign, f"{kinds}, node_id string, cluster int, z array<double>")


def two_stage_clusters(reduced: DataFrame, threshold: float = 0.1, most: int = 50, sample: int = 2000) -> DataFrame:
    """(book_id, node_id, cluster): soft clusters of each book's nodes, first over the book, then within each coarse group,
    both by mixtures of least BIC; a node may be in several groups of either stage. Cluster numbers are unique in a book:
    the group's number times `most` plus the cluster's."""
    coarse = mixture_clusters(reduced.select("book_id", "node_id", "z"), ["book_id"], threshold, most, sample)
    fine = mixture_clusters(coarse.select("book_id", F.col("cluster").alias("g"), "node_id", "z"), ["book_id", "g"], threshold, most, sample)
    return fine.select("book_id", "node_id", (F.col("g") * most + F.col("cluster")).cast("int").alias("cluster"))


def summary_input(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(book_id, node_id, text): what is summarised for a parent: its children's texts in the order of their ids."""
    texts = edges.join(nodes.select("book_id", F.col("node_id").alias("child_id"), "text"), ["book_id", "child_id"]).where("text IS NOT NULL AND text <> ''")
    return texts.groupBy("book_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("child_id", "text"))), lambda s: s["text"]), "\n\n---\n\n").alias("text"))


def node_texts(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Nodes with text: a leaf's is its chunk's."""
    joined = nodes.select("book_id", "node_id", "level", F.col("text").alias("own")).join(by_shuffle(chunks.select("book_id", F.col("chunk_id").alias("node_id"), F.col("text").alias("chunk_text"))), ["book_id", "node_id"], "left")
    return joined.select("book_id", "node_id", "level", F.coalesce("own", "chunk_text").alias("text"))


def build_tree(leaves: DataFrame, summarise: Callable[[DataFrame, int], DataFrame], embed: Callable[[DataFrame], DataFrame], config: Indexing | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the summary trees of all books: nodes (book_id, node_id, level, text, embedding), edges (book_id,
    parent_id, child_id). leaves: `leaf_nodes`. summarise adds `summary` to (book_id, node_id, text) at a level; embed adds
    `embedding` to rows with text.

    All books grow one level at a time. A book grows on while its level has more than `stop_nodes` nodes and the next one
    would have fewer. Each level is written before the next begins."""
    config = config or Indexing()
    nodes = [cut(embed(leaves.select("book_id", "node_id", "level", F.coalesce("text", F.lit("")).alias("text"))), "level")]
    edges: list[DataFrame] = []
    current, level = nodes[0], 0
    while True:
        level += 1
        growing = current.groupBy("book_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > config.stop_nodes)
        rows = cut(current.join(growing, "book_id"), "growing")
        if rows.limit(1).count() == 0:
            break
        reduced = cut(reduce_dim(rows, config.reduced_dim), "reduced")
        parents = cut(group_parents(two_stage_clusters(reduced, config.soft_threshold, config.max_clusters), level), "parents")
        fewer = parents.groupBy("book_id").agg(F.countDistinct("parent_id").alias("m")).join(growing, "book_id").where("m < n").select("book_id")
        found = cut(parents.join(fewer, "book_id", "left_semi"), "edges")
        if found.limit(1).count() == 0:
            break
        edges.append(found)
        texts = summary_input(found, rows)
        named = found.select("book_id", F.col("parent_id").alias("node_id")).distinct().join(texts, ["book_id", "node_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))
        told = summarise(named, level).select("book_id", "node_id", F.lit(level).alias("level"), F.coalesce("summary", F.lit("")).alias("text"))
        current = cut(embed(told), "level")
        nodes.append(current)
    empty = leaves.select("book_id", F.col("node_id").alias("parent_id"), F.col("node_id").alias("child_id")).limit(0)
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges) if edges else empty
