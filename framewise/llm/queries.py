"""Queries of the problems on language-model training data (2, 3, 8, 9, 10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm.clusters import similarity_clusters
from framewise.llm.mixing import mix
from framewise.llm.packing import fill_report, pack
from framewise.llm.quantiles import merge, percentiles, sketch
from framewise.llm.repetition import repeated_passages, repetition_statistics, repetitive_documents, robust_outliers
from framewise.llm.tokens import token_count
from framewise.operators.impute import known_code, known_number
from framewise.plans.scale import cut, table

QUANTILES = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
MEASURES = ["sepal_length", "sepal_width", "petal_length", "petal_width"]
#: Three-letter language codes and their two-letter forms.
LANGUAGES = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "por": "pt", "spa": "es"}


def _fares(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "titanic").select("load_id", known_code(F.col("Pclass"), [1, 2, 3]).alias("Pclass"), F.col("Fare"), known_number(F.col("Age")).alias("Age"))


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of every load and class, and (load_id null, scope "all") those of the loads' sketches added up by class."""
    loads = cut(sketch(_fares(spark, d), ["load_id", "Pclass"], ["Fare", "Age"]))
    every = percentiles(merge(loads, ["Pclass"]), ["Pclass"], QUANTILES).select(F.lit("all").alias("scope"), F.lit(None).cast("int").alias("load_id"), "*")
    return percentiles(loads, ["load_id", "Pclass"], QUANTILES).select(F.lit("load").alias("scope"), "*").unionByName(every)


def p2_checked(spark: SparkSession, d: str) -> DataFrame:
    """By field and class over all loads: values, and how many percentiles lie outside the stated error of exact ranks."""
    fares = _fares(spark, d)
    found = percentiles(merge(sketch(fares, ["load_id", "Pclass"], ["Fare", "Age"]), ["Pclass"]), ["Pclass"], QUANTILES)
    cells = fares.select("Pclass", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("x")) for c in ("Fare", "Age")])).alias("c"))
    counts = cells.where("c.x is not null and not isnan(c.x)").groupBy("Pclass", "c.field", F.col("c.x").cast("float").alias("x")).agg(F.count(F.lit(1)).alias("m"))
    near = counts.withColumnRenamed("Pclass", "k").withColumnRenamed("field", "f")
    joined = found.join(near, found["Pclass"].eqNullSafe(near["k"]) & (found["field"] == near["f"]))
    v = F.col("value").cast("float")
    ranks = joined.groupBy("Pclass", "field", "q", "n", "rank_error").agg(F.sum(F.when(F.col("x") < v, F.col("m")).otherwise(0)).alias("below"), F.sum(F.when(F.col("x") <= v, F.col("m")).otherwise(0)).alias("upto"))
    wanted = F.greatest(F.ceil(F.round(F.col("q") * F.col("n"), 9)), F.lit(1))
    off = F.greatest(F.col("below") + 1 - wanted, wanted - F.col("upto"), F.lit(0))
    return ranks.groupBy("Pclass", "field").agg(F.max("n").alias("n_values"), F.sum((off > F.col("rank_error") * F.col("n")).cast("long")).alias("outside"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return similarity_clusters(table(spark, d, "iris_dataset"), "specimen_id", MEASURES).members


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    return similarity_clusters(table(spark, d, "iris_dataset"), "specimen_id", MEASURES).summary


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return cut(docs.select("doc_id", "source", token_count()("text").alias("tokens")))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(_sized(spark, d), "doc_id", "tokens", table(spark, d, "container_kinds"), "container_kind", "capacity_tokens")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "container_kinds")
    return fill_report(p8_packed(spark, d), kinds, "container_kind", "capacity_tokens")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    m = mix(_sized(spark, d), "doc_id", "source", "tokens", table(spark, d, "mix_targets"))
    return m.shares().where("short").select("source")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sized(spark, d), "doc_id", "source", "tokens", table(spark, d, "mix_targets")).shares()


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sized(spark, d), "doc_id", "source", "tokens", table(spark, d, "mix_targets")).records.select("doc_id", "source", "tokens", "repeats")


def _language(c):
    base = F.regexp_extract(F.lower(F.trim(c)), r"\A([a-z]+)", 1)
    code = base
    for long, short in LANGUAGES.items():
        code = F.when(base == long, F.lit(short)).otherwise(code)
    return F.when(code != "", code)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", _language(F.col("lang")).alias("language"), "source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repetitive_documents(_documents(spark, d), "doc_id", "text", ["language", "source"], 0.4).select("doc_id")


def p10_repetition(spark: SparkSession, d: str) -> DataFrame:
    """The share of every text."""
    return repeated_passages(_documents(spark, d), "doc_id", "text")


def p10_outliers(spark: SparkSession, d: str) -> DataFrame:
    return robust_outliers(cut(repetition_statistics(_documents(spark, d), "doc_id", "text", ["language", "source"])), ["language", "source"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_percentiles, p2_checked, p3_found, p3_clusters, p8_packed, p8_report, p9_found, p9_shares, p9_mixture, p10_found, p10_repetition, p10_outliers)}


#: Words of every text with their places, passages of eight and the first place of an equal one; words of those that
#: stand again without touching the first are repeated.
_REPEATED = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\p{L}+') AS w FROM documents),
    g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM d)),
    f AS (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, p) AS first FROM g),
    r AS (SELECT doc_id, count(DISTINCT k) AS repeated FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM f WHERE first + 8 <= i) GROUP BY 1),
    s AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(repeated, 0)::BIGINT AS repeated_words FROM d LEFT JOIN r USING (doc_id))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_checked": """
            WITH t AS (SELECT CASE WHEN Pclass IN (1, 2, 3) THEN Pclass END AS Pclass, Fare, CASE WHEN Age >= 0 AND Age NOT IN (999, 9999, 99999) AND NOT isnan(Age) THEN Age END AS Age FROM titanic),
            v AS (SELECT Pclass, 'Fare' AS field, Fare AS x FROM t UNION ALL SELECT Pclass, 'Age', Age FROM t)
            SELECT Pclass, field, count(*) AS n_values, 0::BIGINT AS outside FROM v WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY ALL""",
        "p10_repetition": _REPEATED + " SELECT doc_id, n_words, repeated_words, repeated_words / greatest(n_words, 1) AS repeated_share FROM s",
        "p10_found": _REPEATED + " SELECT doc_id FROM s WHERE n_words > 0 AND 5 * repeated_words >= 2 * n_words",
    }
