"""Interactions -> sparse user x product matrix -> popularity.

The reference builds a dense, zero-filled pivot.  Here the matrix stays in
long form ``(user_id, product_id, score)``: an absent row means 0, so a
billion-user, million-product matrix never widens a schema or a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.ranking import global_rank


def interactions_distinct(inter: DataFrame) -> DataFrame:
    """Remove repeated rows on all three columns (map-side partial distinct)."""
    return inter.dropDuplicates(["user_id", "product_id", "interaction_type"])


def user_product_matrix(inter: DataFrame) -> DataFrame:
    """One cell per (user, product): the sum of the *distinct* interaction codes.

    Repeated identical events do not add up, NULL keys vanish and an all-NULL
    code gives 0.  ``sum(DISTINCT)`` plans as a partial aggregate on
    (user, product, code) before the shuffle, so a hot cell is collapsed
    map-side.
    """
    return (inter.where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
            .groupBy("user_id", "product_id")
            .agg(F.coalesce(F.sum_distinct("interaction_type"), F.lit(0)).cast("long").alias("score")))


def matrix_pivot(matrix: DataFrame, product_ids: list[str]) -> DataFrame:
    """Wide, zero-filled view for an explicit, bounded product list."""
    return (matrix.where(F.col("product_id").isin(product_ids))
            .groupBy("user_id").pivot("product_id", product_ids).agg(F.first("score"))
            .na.fill(0))


def popularity(matrix: DataFrame) -> DataFrame:
    """Column sums of the matrix (totals may be <= 0 and still rank)."""
    return matrix.groupBy("product_id").agg(F.sum("score").cast("long").alias("total"))


def popularity_order():
    return [F.col("total").desc(), F.col("product_id").asc()]


def popular_topk(pop: DataFrame, k: int = 8) -> DataFrame:
    """Top-k products: TakeOrderedAndProject, then rank the k rows."""
    top = pop.orderBy(*popularity_order()).limit(k)
    w = Window.orderBy(*popularity_order())
    return top.select(F.row_number().over(w).cast("long").alias("rank"), "product_id", "total")


def popularity_ranked(pop: DataFrame) -> DataFrame:
    """Full popularity order with a dense rank (distributed, no single task)."""
    return global_rank(pop, popularity_order())


def orphan_interactions(matrix: DataFrame, products: DataFrame) -> DataFrame:
    """Matrix cells whose product has no catalog row."""
    return matrix.join(products.select(F.col("id").alias("product_id")), "product_id", "left_anti")


def unread_candidates(matrix: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (user_id, product_id, ...) whose own cell is 0 or absent."""
    own = matrix.where(F.col("score") != 0).select("user_id", "product_id")
    return candidates.join(own, ["user_id", "product_id"], "left_anti")
