"""Frequent itemsets and association rules."""

from __future__ import annotations

import math

from framewise.ml.base import F, Frame, spark_df, x


class FPGrowth:
    """Itemsets in at least ``round(min_support n)`` baskets: (items, support as a count), most frequent first."""

    def __init__(self, min_support: float = 0.5) -> None:
        if not 0 <= min_support <= 1:
            raise ValueError("min_support is a share")
        self.min_support = min_support

    def fit_transform(self, data: Frame, input_col: str) -> Frame:
        from pyspark.ml.fpm import FPGrowth as Growth

        df = spark_df(data).where(x(input_col).isNotNull()).select(F.array_distinct(F.filter(x(input_col), lambda v: v.isNotNull())).alias("items"))
        n = df.count()
        least = max(1, math.floor(self.min_support * n + 0.5))
        model = Growth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n) if n else 1.0)
        if not n:
            return Frame(df.select("items", F.lit(0).cast("long").alias("support")))
        found = model.fit(df).freqItemsets
        return Frame(found.select(F.array_sort("items").alias("items"), F.col("freq").alias("support")).orderBy(F.desc("support"), F.size("items"), "items"))


class AssociationRules:
    """Rules with one consequent: (Pre-Rule, Post-Rule, confidence), most confident first; at most ``max_rules`` (-1: all)."""

    def __init__(self, confidence: float = 0.5, max_rules: int = -1) -> None:
        self.confidence, self.max_rules = confidence, max_rules

    def fit_transform(self, data: Frame, col_item: str = "items", col_freq: str = "support") -> Frame:
        sets = spark_df(data).select(F.array_sort(x(col_item)).alias("items"), x(col_freq).alias("freq"))
        whole = sets.where(F.size("items") > 1).select("items", "freq", F.explode("items").alias("post")).withColumn("pre", F.array_remove(F.col("items"), F.col("post")))
        base = sets.select(F.col("items").alias("pre"), F.col("freq").alias("base"))
        rules = whole.join(base, "pre").select(F.col("pre").alias("Pre-Rule"), F.array("post").alias("Post-Rule"), (F.col("freq") / F.col("base")).alias("confidence")).where(F.col("confidence") >= self.confidence)
        rules = rules.orderBy(F.desc("confidence"), F.size("`Pre-Rule`"), "`Pre-Rule`", "`Post-Rule`")
        return Frame(rules.limit(self.max_rules) if self.max_rules >= 0 else rules)
