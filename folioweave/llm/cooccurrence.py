"""Items that appear together, by basket collapsing.

Identical deduplicated item arrays become one basket with a weight; each distinct basket's pairs are enumerated once and
the weights summed. Lift and conviction measure how far a pair exceeds chance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def membership(rows: DataFrame, group: str, basket: str, items: str) -> DataFrame:
    """Distinct (grp, basket, item). Null items, and rows without a basket id, give nothing; empty and null arrays too."""
    return (
        rows.where(F.col(group).isNotNull() & F.col(basket).isNotNull())
        .select(F.col(group).alias("grp"), F.col(basket).alias("basket"), F.explode(items).alias("item"))
        .where(F.col("item").isNotNull())
        .distinct()
    )


def pair_counts(members: DataFrame, min_shared: int = 1) -> DataFrame:
    """(grp, item_a, item_b, shared) of all pairs sharing at least `min_shared` baskets, item_a < item_b by bytes.

    Items of fewer than `min_shared` baskets cannot be in such a pair, so they leave before baskets are collapsed (exact).
    A basket's pairs are enumerated row by row from its item array: a basket of n items holds n strings in memory, never
    n * n pairs, and its n rows are spread again before they are expanded.
    """
    if min_shared > 1:
        frequent = members.groupBy("grp", "item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_shared)
        members = members.join(frequent.select("grp", "item"), ["grp", "item"], "left_semi")
    baskets = members.groupBy("grp", "basket").agg(F.array_sort(F.collect_list("item")).alias("items")).where(F.size("items") > 1)
    collapsed = baskets.groupBy("grp", "items").agg(F.count(F.lit(1)).alias("weight"))
    firsts = collapsed.select("grp", "weight", "items", F.posexplode("items").alias("pos", "item_a")).where(F.col("pos") < F.size("items") - 1)
    pairs = firsts.select("grp", "weight", "item_a", F.explode(F.slice("items", F.col("pos") + 2, F.size("items"))).alias("item_b"))
    counted = pairs.groupBy("grp", "item_a", "item_b").agg(F.sum("weight").alias("shared"))
    return counted.where(F.col("shared") >= min_shared)


def associations(rows: DataFrame, group: str, basket: str, items: str, min_shared: int = 3) -> DataFrame:
    """Pairs with their measures: (grp, item_a, item_b, shared, n_a, n_b, n, lift, conviction).

    n counts the different baskets of the group, those without items too; n_a and n_b the baskets of each item.
    lift = shared * n / (n_a * n_b); conviction of a => b = (1 - n_b / n) / (1 - shared / n_a), null where a never occurs
    without b. Nulls: null items never count, null group or basket ids leave their row out. Empty input: no rows.
    Repeated rows count once, as baskets are sets. Extra columns are ignored.
    """
    rows = rows.select(F.col(group).alias("g__"), F.col(basket).alias("b__"), F.col(items).alias("i__"))
    members = membership(rows, "g__", "b__", "i__")
    totals = rows.where(F.col("g__").isNotNull()).groupBy(F.col("g__").alias("grp")).agg(F.countDistinct("b__").alias("n"))
    sizes = members.groupBy("grp", "item").agg(F.count(F.lit(1)).alias("k"))
    pairs = pair_counts(members, min_shared)
    both = (
        pairs.join(sizes.select("grp", F.col("item").alias("item_a"), F.col("k").alias("n_a")), ["grp", "item_a"])
        .join(sizes.select("grp", F.col("item").alias("item_b"), F.col("k").alias("n_b")), ["grp", "item_b"])
        .join(totals, "grp")
    )
    n, a, b, s = (F.col(c).cast("double") for c in ("n", "n_a", "n_b", "shared"))
    return both.select(
        "grp", "item_a", "item_b", "shared", "n_a", "n_b", "n",
        (s * n / (a * b)).alias("lift"),
        F.when(s < a, (1 - b / n) / (1 - s / a)).alias("conviction"),
    )


def exceeding(pairs: DataFrame, factor: int = 2) -> DataFrame:
    """The pairs that share at least `factor` times what chance gives, compared in whole numbers."""
    return pairs.where(F.col("shared") * F.col("n") >= F.lit(factor) * F.col("n_a") * F.col("n_b"))
