"""Mixing sources to target weights: hash-threshold histograms instead of sorting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.plans.scale import cut, free_name, join_small

#: Bits of the record hash that one round resolves.
STEP = 12


@dataclass
class Mixture:
    """``plan``: one row per source with its budget and thresholds. ``records``: the chosen records with ``repeats``."""

    plan: DataFrame
    records: DataFrame
    repeats: str = "repeats"

    def shares(self) -> DataFrame:
        """Per source of the targets: target and actual tokens and shares, records, and whether it falls short."""
        used = self.records.groupBy("__fw_source").agg(F.sum(F.col("__fw_n") * F.col(self.repeats)).alias("actual_tokens"), F.sum(F.col(self.repeats)).alias("uses"))
        joined = self.plan.join(used, "__fw_source", "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
        total = joined.agg(F.sum("actual_tokens").alias("__fw_t"))
        return joined.join(F.broadcast(total)).select(F.col("__fw_source").alias("source"), "target_share", "budget_tokens", "source_tokens", "actual_tokens", (F.col("actual_tokens") / F.col("__fw_t")).alias("actual_share"), F.coalesce("uses", F.lit(0)).alias("uses"), "short")


def mix(records: DataFrame, record_id: str, source: str, size: str, targets: DataFrame, total: int | None = None) -> Mixture:
    """A mixture in which each source of ``targets`` (source, target_share, max_repeats) has its share of ``total`` tokens.

    ``total`` is the size of all records if not given, whatever their source. A source's budget is its
    share of that; every record is used ``floor(budget / size of the source)`` times and, of the rest, the
    records whose hash lies under the source's threshold once more, never more than ``max_repeats`` times.
    A source that can't reach its budget uses every record ``max_repeats`` times and is marked ``short``;
    so is one without records. Sources without a target, with a share of 0 or null, or with max_repeats
    under 1 give nothing. Null and negative sizes count 0; ids that repeat are records of their own.

    The threshold comes from histograms: tokens by source and ``STEP`` leading hash bits, then by the next
    bits inside the boundary bucket only, until all 60 bits are resolved or a bucket is empty. Histograms have at most
    sources x 2^STEP rows, are made by map-side aggregates and never see a sort of records. The hash is
    of the record's id, so larger budgets choose supersets (nested) and every run the same records.
    The budget is met from below to the size of one hash value's records.
    """
    n = F.greatest(F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)), F.lit(0))
    hashed = F.shiftrightunsigned(F.xxhash64(F.col(f"`{record_id}`").cast("string"), F.lit("mix")), 4)
    rows = records.withColumn("__fw_source", F.col(f"`{source}`")).withColumn("__fw_n", n).withColumn("__fw_h", hashed)
    wanted = targets.groupBy(F.col("source").alias("__fw_source")).agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).cast("long").alias("max_repeats"))
    # First histogram: by source and the leading bits; the sizes of the sources follow from it.
    lead = F.shiftright(F.col("__fw_h"), 60 - STEP)
    hist = cut(rows.groupBy("__fw_source", lead.alias("b")).agg(F.sum("__fw_n").alias("t")))
    sizes = hist.groupBy("__fw_source").agg(F.sum("t").alias("source_tokens"))
    everything = F.lit(int(total if total is not None else hist.agg(F.sum("t")).first()[0] or 0)).cast("long")
    plan = wanted.join(sizes, "__fw_source", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0).cast("long")))
    plan = plan.withColumn("budget_tokens", F.col("target_share") * everything)
    plan = plan.withColumn("short", F.col("budget_tokens") > F.col("source_tokens") * F.greatest("max_repeats", F.lit(0)))
    full = F.when(F.col("source_tokens") > 0, F.floor(F.col("budget_tokens") / F.col("source_tokens"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("full", F.least(full, F.greatest("max_repeats", F.lit(0).cast("long"))))
    plan = cut(plan.withColumn("left", F.when(F.col("full") < F.col("max_repeats"), F.floor(F.col("budget_tokens") - F.col("full") * F.col("source_tokens"))).otherwise(F.lit(0)).cast("long")))
    open_ = plan.where("left > 0 and source_tokens > 0").select("__fw_source", "left")
    state = cut(_boundary(join_small(hist, open_, ["__fw_source"], "inner"), STEP))  # one row per source of the targets
    bits = STEP
    while bits < 60:
        step = min(STEP, 60 - bits)
        inside = join_small(rows.select("__fw_source", "__fw_n", "__fw_h", F.shiftright("__fw_h", 60 - bits).alias("prefix")), state.select("__fw_source", "prefix", "left"), ["__fw_source", "prefix"], "inner")
        bits += step
        finer = inside.groupBy("__fw_source", "left", F.shiftright("__fw_h", 60 - bits).alias("b")).agg(F.sum("__fw_n").alias("t"))
        nxt = _boundary(finer, step)
        # A source whose boundary bucket is resolved keeps its threshold.
        state = cut(state.select("__fw_source", F.shiftleft("prefix", step).alias("p0")).join(nxt, "__fw_source", "left").select("__fw_source", F.coalesce("prefix", "p0").alias("prefix"), F.coalesce("left", F.lit(0).cast("long")).alias("left")))
    plan = cut(plan.join(state.select("__fw_source", F.col("prefix").alias("threshold")), "__fw_source", "left"))
    chosen = join_small(rows, plan.select("__fw_source", F.col("full").alias("__fw_full"), F.col("threshold").alias("__fw_threshold")), ["__fw_source"], "inner")
    repeats = (F.col("__fw_full") + F.when(F.col("__fw_h") < F.coalesce("__fw_threshold", F.lit(0).cast("long")), F.lit(1)).otherwise(F.lit(0))).cast("int")
    name = free_name("repeats", records.columns)
    chosen = chosen.withColumn(name, repeats).where(F.col(name) > 0).drop("__fw_full", "__fw_threshold", "__fw_h")
    return Mixture(plan.drop("full", "left", "threshold"), chosen, name)


def _boundary(hist: DataFrame, step: int) -> DataFrame:
    """Per source the bucket where the running sum passes ``left``, and what of it remains inside. Sums run over at most 2^STEP buckets a source."""
    from pyspark.sql import Window

    upto = Window.partitionBy("__fw_source").orderBy("b")
    run = hist.withColumn("u", F.sum("t").over(upto))
    return run.where("u > left and u - t <= left").groupBy("__fw_source").agg(F.min("b").alias("prefix"), F.min_by(F.col("left") - (F.col("u") - F.col("t")), "b").alias("left"))
