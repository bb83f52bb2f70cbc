"""Queries of the table operations, statistics and models, each over whole tables, with the equivalent SQL where there is one."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewise.columns import col, udf, vector_udf
from framewise.frame import Frame
from framewise.ml.clustering import DBSCAN, Kmeans, st_dbscan
from framewise.ml.evaluation import BinaryClassificationMetrics, MultilabelMetrics, RegressionMetrics
from framewise.ml.feature import PCA, Binarizer, IndexToString, MaxAbsScaler, MinMaxScaler, OneHotEncoder, PolynomialExpansion, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer
from framewise.ml.fpm import AssociationRules, FPGrowth
from framewise.ml.supervised import SVM, GaussianNB, GDRegressor, KNearestNeighbors, LogisticRegression, OrdinaryLeastSquares
from framewise.ml.text import CountVectorizer, NGram, RegexTokenizer, RemoveStopWords, TfidfVectorizer, Tokenizer
from framewise.operators.graph import PageRank
from framewise.operators.stats import exact_freq_items
from framewise.plans.scale import cut, shared_folder, table
from framewise.session import Context
from framewise.types import DataType

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            out = f(lambda name: Frame(table(spark, d, name)), spark)
            return out.df if isinstance(out, Frame) else out

        _queries[f.__name__] = run
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def money(c: str):
    return F.col(c).cast("decimal(18,2)")


def rounded(f: Frame, places: int = 6) -> Frame:
    return Frame(f.df.withColumns({c: F.round(F.col(f"`{c}`"), places) for c, k in f.df.dtypes if k == "double"}))


# Rows and columns


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity >= 25 AND l_discount < 0.05")
def filter_basic(t, spark):
    return t("lineitem").filter("l_quantity >= 25 and l_discount < 0.05").select(["l_orderkey", "l_linenumber", "l_quantity", "l_discount"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 1000 AND o_totalprice <= 150000 AND NOT (o_orderstatus = 'F' OR o_custkey % 7 = 3)")
def filter_in_chain(t, spark):
    low = 1000
    assert low
    return t("orders").filter("o_orderpriority in ['1-URGENT', '2-HIGH'] & @low < o_totalprice <= 150000 & ~(o_orderstatus == 'F' | o_custkey % 7 == 3)").select(["o_orderkey", "o_totalprice"])


@query("SELECT event_id, kind FROM (SELECT event_id, nullif(event_type, 'click') AS kind FROM events) WHERE kind IS DISTINCT FROM 'view'")
def filter_neq(t, spark):
    return t("events").map(F.expr("nullif(event_type, 'click')"), "kind").select(["event_id", "kind"]).filter("kind != 'view'")


@query("SELECT o_orderkey, o_custkey FROM orders")
def select_columns(t, spark):
    return t("orders").select(["o_orderkey", "no_such_column", "o_custkey"])


@query("SELECT round(-p_retailprice, 6) AS neg, round(-p_retailprice * 2 + p_size, 6) AS twice, p_partkey, round(sqrt(p_size) + ln(p_retailprice) ** 2, 6) AS mixed, p_size % 7 AS rest, round(p_retailprice / nullif(p_size - 10, 0), 6) AS ratio FROM part")
def select_expr(t, spark):
    return rounded(t("part").select_expression("neg = p_retailprice * -1", "twice = neg * 2 + p_size", "p_partkey", "mixed = sqrt(p_size) + log(p_retailprice) ** 2", "rest = p_size % 7", "ratio = p_retailprice / (p_size - 10)"))


@query("SELECT p_partkey, p_brand, p_type, p_size FROM part")
def drop_cols(t, spark):
    return t("part").drop(["p_name", "p_retailprice", "no_such_column"])


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def rename_cols(t, spark):
    return t("customer").rename(["c_custkey", "c_name", "zzz"], ["id", "name", "yyy"])


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, trunc(o_totalprice)::BIGINT AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, CAST(o_custkey AS DOUBLE) AS o_custkey, TRY_CAST(o_orderstatus AS DOUBLE) AS o_orderstatus FROM orders")
def cast_types(t, spark):
    return t("orders").drop("o_orderpriority").cast(["o_orderkey", "o_totalprice", "o_orderdate", "o_custkey", "o_orderstatus"], [DataType.STRING, DataType.INT, DataType.DATE, DataType.DECIMAL, DataType.DECIMAL])


@query("SELECT event_id, user_id * 300 AS scaled, round(value * 2, 2) AS doubled FROM events")
def map_udf_const(t, spark):
    f = t("events").map(udf(lambda u, k: u * k, DataType.INT, col("user_id"), 300), "scaled")
    return rounded(f.map(vector_udf(lambda v, k: v * k, DataType.DECIMAL, col("value"), 2.0), "doubled").select(["event_id", "scaled", "doubled"]), 2)


@query("SELECT event_id, year(ts)::INT AS y, month(ts)::INT AS mo, day(ts)::INT AS d, hour(ts)::INT AS h, minute(ts)::INT AS mi, floor(second(ts))::INT AS s, CAST(ts AS DATE) AS dt, strftime(ts, '%H:%M:%S') AS tm, dayofyear(ts)::INT AS doy, weekofyear(ts)::INT AS w, (isodow(ts) - 1)::INT AS dow FROM events")
def map_datetime_parts(t, spark):
    f = t("events")
    for c, alias in ((col("ts").year(), "y"), (col("ts").mouth(), "mo"), (col("ts").day(), "d"), (col("ts").hour(), "h"), (col("ts").minute(), "mi"), (col("ts").second(), "s"), (col("ts").date(), "dt"), (col("ts").time(), "tm"), (col("ts").dayofyear(), "doy"), (col("ts").weekofyear(), "w"), (col("ts").dayofweek(), "dow")):
        f = f.map(c, alias)
    return f.select(["event_id", "y", "mo", "d", "h", "mi", "s", "dt", "tm", "doy", "w", "dow"])


@query("SELECT tap_id, make_date(CASE WHEN yy <= 24 THEN 2000 ELSE 1900 END + yy, mm, dd)::TIMESTAMP AS born FROM (SELECT tap_id, right(s, 2)::BIGINT AS yy, substr(s, 4, 2)::BIGINT AS mm, left(s, 2)::BIGINT AS dd FROM (SELECT tap_id, CASE WHEN regexp_full_match(DATANASCIMENTO, '[0-9]{2}/[0-9]{2}/[0-9]{2}') THEN DATANASCIMENTO END AS s FROM ticketing))")
def map_to_datetime(t, spark):
    """All dates of birth, their two-digit years within 1925 to 2024."""
    return t("ticketing").map(col("DATANASCIMENTO").to_datetime("dd/MM/yy", last_year=2024), "born").select(["tap_id", "born"]).map(F.col("born").cast("timestamp_ntz"), "born")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey = 0 THEN 'No' ELSE o_custkey::VARCHAR END AS o_custkey FROM orders")
def replace_values(t, spark):
    return t("orders").replace({"F": "done", "O": "open"}, subset="o_orderstatus").replace({0: "No"}, subset="o_custkey").select(["o_orderkey", "o_orderstatus", "o_custkey"])


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_name, '^[a-z]+ ', 'any ', 'g'), 'ing$', 'ong', 'g') AS p_name FROM part")
def replace_regex(t, spark):
    return t("part").replace({"^[a-z]+ ": "any ", "ing$": "ong"}, subset="p_name", regex=True).select(["p_partkey", "p_name"])


@query(r"SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]{2,}'), lambda t: length(t) > 2)) AS token FROM documents")
def explode_tokens(t, spark):
    return Tokenizer().transform(t("documents"), "text", "token").select(["doc_id", "token"]).explode("token")


@query("WITH a AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) r FROM nation), b AS (SELECT r_name AS n, r_name AS n_name, row_number() OVER (ORDER BY r_regionkey) r FROM region) SELECT a.n_name AS n_name_l, b.n_name AS n_name_r FROM a JOIN b USING (r)")
def add_column_zip(t, spark):
    return t("nation").sort("n_nationkey").select("n_name").add_column(t("region").sort("r_regionkey").rename("r_name", "n_name").select("n_name"))


# Missing values

_GAPS = "SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_quantity, 7) AS q, nullif(l_discount, 0.05) AS d, nullif(l_returnflag, 'R') AS f, CAST(NULL AS DOUBLE) AS e FROM lineitem"


def _gaps(t):
    f = t("lineitem").map(F.expr("nullif(l_quantity, 7D)"), "q").map(F.expr("nullif(l_discount, 0.05D)"), "d").map(F.expr("nullif(l_returnflag, 'R')"), "f").map(F.expr("CAST(NULL AS DOUBLE)"), "e")
    return f.select(["l_orderkey", "l_linenumber", "l_partkey", "q", "d", "f", "e"])


@query(f"SELECT * EXCLUDE (e) FROM ({_GAPS}) WHERE q IS NOT NULL AND d IS NOT NULL AND f IS NOT NULL")
def dropna_rows(t, spark):
    return _gaps(t).dropna(["q", "d", "f", "zzz"]).drop("e")


@query(f"SELECT * EXCLUDE (e) FROM ({_GAPS}) WHERE (q IS NOT NULL)::INT + (d IS NOT NULL)::INT + (f IS NOT NULL)::INT >= 2")
def dropna_thresh(t, spark):
    return _gaps(t).dropna(["q", "d", "f"], how="all", thresh=2).drop("e")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, q, d, f FROM ({_GAPS})")
def dropna_cols(t, spark):
    return _gaps(t).dropna(mode="REMOVE_COLUMN", how="all")


@query(f"SELECT l_orderkey, l_linenumber, coalesce(q, 0) AS q, coalesce(d, -1) AS d, coalesce(f, 'none') AS f FROM ({_GAPS})")
def fillna_value(t, spark):
    return _gaps(t).fillna(value={"q": 0.0, "d": -1.0, "f": "none"}).select(["l_orderkey", "l_linenumber", "q", "d", "f"])


@query(f"SELECT l_orderkey, l_linenumber, round(coalesce(q, (SELECT avg(q) FROM ({_GAPS}))), 6) AS q FROM ({_GAPS})")
def fillna_mean(t, spark):
    return rounded(_gaps(t).fillna("q", mode="MEAN").select(["l_orderkey", "l_linenumber", "q"]))


@query(f"SELECT l_orderkey, l_linenumber, coalesce(q, (SELECT median(q) FROM ({_GAPS}))) AS q, coalesce(d, (SELECT median(d) FROM ({_GAPS}))) AS d FROM ({_GAPS})")
def fillna_median(t, spark):
    return _gaps(t).fillna(["q", "d"], mode="MEDIAN").select(["l_orderkey", "l_linenumber", "q", "d"])


@query(f"WITH g AS ({_GAPS}), m AS (SELECT f FROM g WHERE f IS NOT NULL GROUP BY f ORDER BY count(*) DESC, f LIMIT 1) SELECT l_orderkey, l_linenumber, coalesce(g.f, m.f) AS f FROM g, m")
def fillna_mode(t, spark):
    return _gaps(t).fillna("f", mode="MODE").select(["l_orderkey", "l_linenumber", "f"])


# Joins


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t, spark):
    return t("orders").join(t("customer"), "o_custkey", "c_custkey").select(["o_orderkey", "o_custkey", "c_name", "c_mktsegment"])


@query("SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def join_left(t, spark):
    return t("orders").join(t("customer").filter("c_acctbal > 0"), "o_custkey", "c_custkey", mode="left").select(["o_orderkey", "o_custkey", "c_name"])


@query("SELECT r.c_nationkey AS k, n.n_name, r.c_custkey FROM (SELECT * FROM nation WHERE n_nationkey < 10) n RIGHT JOIN customer r ON n.n_nationkey = r.c_nationkey")
def join_right(t, spark):
    return t("nation").filter("n_nationkey < 10").rename("n_nationkey", "k").join(t("customer"), "k", "c_nationkey", mode="right").select(["k", "n_name", "c_custkey"])


@query("SELECT a.n_regionkey, a.n_name AS n_name_l, a.n_nationkey AS n_nationkey_l, b.n_name AS n_name_r, b.n_nationkey AS n_nationkey_r FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_suffix(t, spark):
    return t("nation").join(t("nation"), "n_regionkey")


@query("SELECT a.r_name, b.tag FROM region a JOIN (SELECT lower(r_name) AS name, r_regionkey * 2 AS tag FROM region) b ON lower(a.r_name) = lower(b.name)")
def join_case(t, spark):
    other = t("region").map(F.lower("r_name"), "name").select_expression("name", "tag = r_regionkey * 2")
    return t("region").join(other, "r_name", "name", case=False).select(["r_name", "tag"])


@query("SELECT a.l_orderkey, a.l_linenumber, a.l_partkey AS l_partkey_l, b.l_partkey AS l_partkey_r FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def join_multikey(t, spark):
    f = t("lineitem").select(["l_orderkey", "l_linenumber", "l_partkey"])
    return f.join(f, ["l_orderkey", "l_linenumber"])


@query("SELECT s_suppkey, r_name FROM supplier CROSS JOIN region")
def cross_join(t, spark):
    return t("supplier").select("s_suppkey").cross_join(t("region").select("r_name"))


# Groups


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem WHERE l_quantity >= 25 GROUP BY ALL")
def agg_sum_avg_min_max_count(t, spark):
    g = t("lineitem").filter("l_quantity >= 25").group_by(["l_returnflag", "l_linestatus"])
    return rounded(g.count("*", "n").sum("l_quantity", "sum_qty").avg("l_discount", "avg_disc").min("l_extendedprice", "low").max("l_extendedprice", "high"))


@query("SELECT event_type, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value FROM events GROUP BY ALL")
def agg_first_last(t, spark):
    return t("events").group_by("event_type").first("value", "first_value", order_by="event_id").last("value", "last_value", order_by="event_id")


@query("SELECT user_id, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY ALL")
def agg_list(t, spark):
    return Frame(t("events").group_by("user_id").list("event_id", "ids").df.withColumn("ids", F.sort_array("ids")))


@query("SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY ALL")
def agg_set(t, spark):
    return Frame(t("events").group_by("user_id").set("event_type", "kinds").df.withColumn("kinds", F.sort_array("kinds")))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS \"count(*)\" FROM orders GROUP BY ALL")
def agg_star(t, spark):
    return t("orders").group_by(["o_orderstatus", "o_orderpriority"]).count("*")


@query("SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS sd, median(c_acctbal) AS med, count(DISTINCT c_nationkey) AS nations, round(var_samp(c_acctbal), 2) AS var FROM customer GROUP BY ALL")
def agg_named(t, spark):
    f = t("customer").group_by("c_mktsegment").agg(sd=("c_acctbal", "std"), med=("c_acctbal", "median"), nations=("c_nationkey", "nunique"), var=("c_acctbal", "var"))
    return f.map(F.round("sd", 4), "sd").map(F.round("var", 2), "var").select(["c_mktsegment", "sd", "med", "nations", "var"])


@query("SELECT event_type, user_id FROM events GROUP BY ALL")
def group_keys(t, spark):
    return t("events").select(["event_type", "user_id"]).group_by("*")


# Order, samples, partitions


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey")
def sort_multi(t, spark):
    return t("orders").select(["o_orderkey", "o_orderstatus", "o_totalprice"]).sort(["o_orderstatus", "o_totalprice", "o_orderkey"], [True, False])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def take_n(t, spark):
    return t("orders").select(["o_orderkey", "o_totalprice"]).sort(["o_totalprice", "o_orderkey"], [False, True]).take(40)


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_all(t, spark):
    return t("lineitem").select(["l_returnflag", "l_linestatus", "l_linenumber"]).distinct()


@query("SELECT arg_min(event_id, event_id) AS event_id, user_id, event_type, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def distinct_subset(t, spark):
    return t("events").select(["event_id", "user_id", "event_type", "value"]).drop_duplicates(["user_id", "event_type"], order_by="event_id")


@query("SELECT 1000::BIGINT AS n, 1000::BIGINT AS known")
def sample_n(t, spark):
    s = t("orders").sample(1000, seed=5)
    return s.df.join(t("orders").df.select("o_orderkey"), "o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("known"))


@query("SELECT ceil(count(*) * 0.2)::BIGINT AS n FROM lineitem")
def sample_frac(t, spark):
    return t("lineitem").sample(0.2, seed=5).df.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT ceil(count(*) * 0.7)::BIGINT AS a, (count(*) - ceil(count(*) * 0.7))::BIGINT AS b, 0::BIGINT AS common FROM orders")
def split_counts(t, spark):
    a, b = t("orders").split(0.7, seed=3)
    both = a.df.join(b.df.select("o_orderkey"), "o_orderkey").agg(F.count(F.lit(1)).alias("common"))
    return a.df.agg(F.count(F.lit(1)).alias("a")).join(b.df.agg(F.count(F.lit(1)).alias("b"))).join(both)


def _placed(f: Frame) -> DataFrame:
    """The rows with the partition that each is in."""
    return f.df.withColumn("part", F.spark_partition_id())


@query("SELECT 6::BIGINT AS parts, count(*) AS n, count(DISTINCT o_custkey) AS keys, 0::BIGINT AS split_keys FROM orders")
def hash_partition(t, spark):
    """Rows in all six partitions, and no key in two."""
    by_key = _placed(t("orders").select(["o_orderkey", "o_custkey"]).hash_partition("o_custkey", 6)).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.collect_set("part").alias("parts"))
    return by_key.agg(F.size(F.array_distinct(F.flatten(F.collect_set("parts")))).cast("long").alias("parts"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys"), F.count(F.when(F.size("parts") > 1, 1)).alias("split_keys"))


@query("SELECT 6::BIGINT AS parts, count(*) AS n, 0::BIGINT AS overlapping FROM orders")
def range_partition(t, spark):
    """Rows in all six partitions, each with lower totals than the one before."""
    ends = _placed(t("orders").select(["o_orderkey", "o_totalprice"]).range_partition("o_totalprice", False, 6)).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    before = F.lag("low").over(Window.orderBy("part"))  # six rows
    return ends.withColumn("before", before).agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.count(F.when(F.col("high") > F.col("before"), 1)).alias("overlapping"))


@query("WITH c AS (SELECT count(*) AS n FROM customer), s(part, lo, hi) AS (VALUES (0, 0, 1000), (1, 1000, 1010), (2, 1010, 9000000000000)) SELECT part::INT AS part, greatest(least(n, hi) - lo, 0)::BIGINT AS n FROM c, s WHERE n > lo")
def repartition(t, spark):
    """Sizes of partitions as asked for; the last takes the rest."""
    return _placed(t("customer").select("c_custkey").repartition(distribution=[1000, 10, 300])).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT k::INT AS part, (n // 7 + (k < n % 7)::INT)::BIGINT AS n FROM (SELECT count(*) AS n FROM customer), range(7) r(k)")
def repartition_equal(t, spark):
    return _placed(t("customer").select("c_custkey").repartition(7)).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT k::INT AS part, (n // 3 + (k < n % 3)::INT)::BIGINT AS n FROM (SELECT count(*) AS n FROM orders), range(3) r(k)")
def balancer(t, spark):
    """Lopsided partitions evened out."""
    return _placed(t("orders").select("o_orderkey").repartition(distribution=[1000, 10, 300]).balancer()).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


# Sets


@query("SELECT c_nationkey AS k, c_name AS name FROM customer UNION ALL SELECT s_nationkey, s_name FROM supplier")
def union_pos(t, spark):
    return t("customer").select_expression("k = c_nationkey", "name = c_name").union(t("supplier").select(["s_nationkey", "s_name"]))


@query("SELECT c_nationkey AS k, c_custkey AS c, NULL::BIGINT AS s FROM customer UNION ALL SELECT s_nationkey, NULL, s_suppkey FROM supplier")
def union_by_name(t, spark):
    return t("customer").select_expression("k = c_nationkey", "c = c_custkey").union_by_name(t("supplier").select_expression("s = s_suppkey", "k = s_nationkey"))


def _users(t, a, b):
    f = t("events")
    return f.filter(f"event_type == '{a}'").select(["user_id"]), f.filter(f"event_type == '{b}'").select(["user_id"])


@query("SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup'")
def intersect(t, spark):
    a, b = _users(t, "error", "signup")
    return a.intersect(b)


@query("SELECT user_id FROM events WHERE event_type = 'error' INTERSECT ALL SELECT user_id FROM events WHERE event_type = 'signup'")
def intersect_all(t, spark):
    a, b = _users(t, "error", "signup")
    return a.intersect_all(b)


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def subtract(t, spark):
    return t("orders").select_expression("k = o_custkey").subtract(t("customer").filter("c_acctbal > 0").select_expression("k = c_custkey"))


@query("SELECT user_id FROM events WHERE event_type = 'view' EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'click'")
def except_all(t, spark):
    a, b = _users(t, "view", "click")
    return a.except_all(b)


# Statistics


@query("SELECT 'l_quantity' AS \"column\", count(*) AS \"count\", round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity)::VARCHAR AS \"min\", max(l_quantity)::VARCHAR AS \"max\", 0::BIGINT AS nan_count FROM lineitem UNION ALL SELECT 'l_returnflag', count(*), NULL, NULL, min(l_returnflag), max(l_returnflag), 0 FROM lineitem")
def describe(t, spark):
    from framewise.operators.stats import describe as table_of

    return rounded(Frame(table_of(t("lineitem").df, ["l_quantity", "l_returnflag"])))


@query("SELECT round(corr(l_quantity, l_extendedprice), 5) AS corr FROM lineitem")
def correlation(t, spark):
    return spark.createDataFrame([(t("lineitem").correlation("l_quantity", "l_extendedprice"),)], "corr double")


@query("SELECT round(covar_samp(l_quantity, l_discount), 5) AS cov FROM lineitem")
def covariance(t, spark):
    return spark.createDataFrame([(t("lineitem").covariance("l_quantity", "l_discount"),)], "cov double")


@query("SELECT o_orderstatus AS key, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders GROUP BY 1")
def crosstab(t, spark):
    return t("orders").cross_tab("o_orderstatus", "o_orderpriority")


@query("SELECT l_quantity AS item, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) >= 0.02 * (SELECT count(*) FROM lineitem)")
def freq_items_exact(t, spark):
    return exact_freq_items(t("lineitem").df, "l_quantity", 0.02)


@query("SELECT 1::BIGINT AS n, 0::BIGINT AS missing")
def freq_items(t, spark):
    """The candidates contain every truly frequent item."""
    found = t("lineitem").freq_items("l_linenumber", 0.1).df
    true = exact_freq_items(t("lineitem").df, "l_linenumber", 0.1).agg(F.collect_set("item").alias("items"))
    return found.join(true).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.array_except("items", "l_linenumber_freqItems"))).cast("long").alias("missing"))


@query("WITH r AS (SELECT c_acctbal AS x, row_number() OVER (ORDER BY c_acctbal) i, count(*) OVER () n FROM customer), f AS (SELECT i, n, least(greatest((x + 1000) / 11000, 0), 1) AS p FROM r) SELECT round(max(greatest(i / n - p, p - (i - 1) / n)), 8) AS d FROM f")
def ks_uniform(t, spark):
    d, _ = t("customer").kolmogorov_smirnov_one_sample("c_acctbal", "uniform", args=(-1000.0, 11000.0))
    return spark.createDataFrame([(round(d, 8),)], "d double")


@query()
def ks_norm(t, spark):
    return spark.createDataFrame([t("customer").kolmogorov_smirnov_one_sample("c_acctbal", "norm", args=(4500.0, 3000.0))], "d double, p double")


# Features


@query("SELECT l_orderkey, round(l_quantity / m, 6) AS l_quantity FROM lineitem, (SELECT max(abs(l_quantity)) AS m FROM lineitem)")
def scaler_maxabs(t, spark):
    f = t("lineitem").select(["l_orderkey", "l_quantity"])
    return rounded(MaxAbsScaler().fit_transform(f, "l_quantity"))


@query("SELECT p_partkey, p_size, round((p_size - lo) / (hi - lo) * 2 - 1, 6) AS p_size_mm FROM part, (SELECT min(p_size) lo, max(p_size) hi FROM part)")
def scaler_minmax(t, spark):
    return rounded(MinMaxScaler((-1, 1)).fit_transform(t("part").select(["p_partkey", "p_size"]), "p_size", output_col="_mm"))


@query("SELECT c_custkey, round((c_acctbal - m) / s, 6) AS z FROM customer, (SELECT avg(c_acctbal) m, stddev_pop(c_acctbal) s FROM customer)")
def scaler_standard(t, spark):
    return rounded(StandardScaler().fit_transform(t("customer").select(["c_custkey", "c_acctbal"]), "c_acctbal", output_col=["z"], remove=True))


@query("SELECT event_id, CASE WHEN value > 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value_binarized FROM events")
def binarizer(t, spark):
    return Binarizer(5.0).transform(t("events").select(["event_id", "value"]), "value", remove=True)


@query("SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{v}')::INT AS col{i}_onehot" for i, v in enumerate("FOP")) + " FROM orders")
def onehot(t, spark):
    return OneHotEncoder().fit_transform(t("orders").select(["o_orderkey", "o_orderstatus"]), "o_orderstatus", remove=True)


@query("SELECT p_partkey, 1.0::DOUBLE AS col0_poly, p_size::DOUBLE AS col1_poly, p_retailprice AS col2_poly, round(p_size::DOUBLE * p_size, 4) AS col3_poly, round(p_size * p_retailprice, 4) AS col4_poly, round(p_retailprice * p_retailprice, 4) AS col5_poly FROM part")
def poly(t, spark):
    return rounded(PolynomialExpansion(2).transform(t("part").select(["p_partkey", "p_size", "p_retailprice"]), ["p_size", "p_retailprice"], remove=True), 4)


@query("SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS k FROM orders")
def string_index(t, spark):
    return StringIndexer().fit_transform(t("orders").select(["o_orderkey", "o_orderpriority"]), "o_orderpriority", output_col="k").select(["o_orderkey", "k"])


@query("WITH v AS (SELECT DISTINCT p_type FROM part), k AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS i, count(*) OVER () AS n FROM v) SELECT p_partkey, b.p_type AS back FROM part JOIN k a USING (p_type) JOIN k b ON b.i = (a.i + 1) % a.n")
def index_to_string(t, spark):
    """The type that follows a part's own in the index."""
    f = t("part").select(["p_partkey", "p_type"])
    model = StringIndexer().fit(f, "p_type")
    placed = model.transform(f, output_col="k").map(F.pmod(F.col("k") + 1, F.lit(len(model.mapping))), "k")
    return IndexToString(model).transform(placed, "k", "back").select(["p_partkey", "back"])


@query("SELECT p_partkey, [p_retailprice] AS cut FROM part")
def vectors(t, spark):
    f = VectorAssembler().transform(t("part").select(["p_partkey", "p_size", "p_retailprice"]), ["p_size", "p_retailprice"], "v")
    return VectorSlicer([1]).transform(f, "v", "cut").select(["p_partkey", "cut"])


@query("WITH c AS (SELECT var_samp(l_quantity) a, covar_samp(l_quantity, l_extendedprice) b, var_samp(l_extendedprice) d FROM lineitem) SELECT 0::BIGINT AS component, round(((a + d) / 2 + sqrt((a - d) ** 2 / 4 + b * b)) / 1e6, 4) AS eigenvalue FROM c UNION ALL SELECT 1, round(((a + d) / 2 - sqrt((a - d) ** 2 / 4 + b * b)) / 1e6, 4) FROM c")
def pca_eigen(t, spark):
    m = PCA(2).fit(t("lineitem"), ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame([(i, round(v / 1e6, 4)) for i, v in enumerate(m.eig_values)], "component long, eigenvalue double")


@query()
def pca_scores(t, spark):
    return rounded(PCA(2).fit_transform(StandardScaler().fit_transform(t("lineitem").select(["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"]), ["l_quantity", "l_extendedprice", "l_discount"]), ["l_quantity", "l_extendedprice", "l_discount"]), 6)


# Text

_TOKENS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]{2,}'), lambda t: length(t) > 2)"


@query(f"SELECT doc_id, {_TOKENS} AS text_tokens FROM documents")
def tokenize(t, spark):
    return Tokenizer().transform(t("documents").select(["doc_id", "text"]), "text").select(["doc_id", "text_tokens"])


@query("SELECT doc_id, list_filter(regexp_extract_all(text, '[0-9]+'), lambda t: length(t) > 1) AS text_token FROM documents")
def regex_tokenize(t, spark):
    return RegexTokenizer("[0-9]+", 1, False).transform(t("documents").select(["doc_id", "text"]), "text").select(["doc_id", "text_token"])


@query(f"WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents) SELECT doc_id, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]) AS grams FROM t")
def ngram(t, spark):
    f = Tokenizer().transform(t("documents").select(["doc_id", "text"]), "text", "w")
    return NGram(2).transform(f, "w", "grams").select(["doc_id", "grams"])


@query(f"WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents) SELECT doc_id, list_sort(list_distinct(list_filter(w, lambda x: x NOT IN ('the', 'and', 'from', 'under')))) AS kept FROM t")
def stopwords(t, spark):
    f = Tokenizer().transform(t("documents").select(["doc_id", "text"]), "text", "w")
    return Frame(RemoveStopWords(stops_words_list=["the", "and", "from", "under"]).transform(f, "w", "kept").df.select("doc_id", F.sort_array("kept").alias("kept")))


@query(f"WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), x AS (SELECT doc_id, unnest(w) AS term FROM t), v AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM x GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3 ORDER BY tf DESC, term LIMIT 50) SELECT term, df, dense_rank() OVER (ORDER BY term) - 1 AS place FROM v")
def count_vec_vocabulary(t, spark):
    f = Tokenizer().transform(t("documents").select(["doc_id", "text"]), "text", "w")
    m = CountVectorizer(vocab_size=50, min_df=3).fit(f, "w")
    return spark.createDataFrame([(w, d, i) for i, (w, d) in enumerate(zip(m.vocabulary, m.doc_freq))], "term string, df long, place long")


_TERMS = f"t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), x AS (SELECT doc_id, unnest(w) AS term FROM t)"


@query(f"WITH {_TERMS}, v AS (SELECT term FROM x GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 40), o AS (SELECT term, row_number() OVER (ORDER BY term) AS r FROM v), c AS (SELECT doc_id, r FROM x JOIN o USING (term)) SELECT doc_id, " + ", ".join(f"coalesce(sum((r = {i + 1})::INT), 0)::INT AS n{i}" for i in range(40)) + " FROM documents LEFT JOIN c USING (doc_id) GROUP BY 1")
def count_vec(t, spark):
    f = Tokenizer().transform(t("documents").select(["doc_id", "text"]), "text", "w")
    return CountVectorizer(vocab_size=40, binary=False).fit_transform(f, "w", output_col="n", remove=True).drop("text")


@query(
    f"WITH {_TERMS}, n AS (SELECT count(*) AS n FROM documents), v AS (SELECT term, count(DISTINCT doc_id) AS df FROM x GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 12), o AS (SELECT term, ln((n + 1) / (df + 1)) + 1 AS idf, row_number() OVER (ORDER BY term) AS r FROM v, n), c AS (SELECT doc_id, "
    + ", ".join(f"sum(CASE WHEN r = {i + 1} THEN idf ELSE 0 END) AS a{i}" for i in range(12))
    + " FROM x JOIN o USING (term) GROUP BY 1), s AS (SELECT *, sqrt("
    + " + ".join(f"a{i} * a{i}" for i in range(12))
    + ") AS z FROM c) SELECT doc_id, "
    + ", ".join(f"round(coalesce(a{i} / z, 0), 6) AS n{i}" for i in range(12))
    + " FROM documents LEFT JOIN s USING (doc_id)"
)
def tfidf(t, spark):
    f = Tokenizer().transform(t("documents").select(["doc_id", "text"]), "text", "w")
    return rounded(TfidfVectorizer(vocab_size=12).fit_transform(f, "w", output_col="n", remove=True).drop("text"))


# Models


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS b1, round(regr_intercept(l_extendedprice, l_quantity), 4) AS b0 FROM lineitem")
def ols(t, spark):
    m = OrdinaryLeastSquares().fit(t("lineitem"), "l_quantity", "l_extendedprice")
    return spark.createDataFrame([(round(m.b1, 4), round(m.b0, 4))], "b1 double, b0 double")


_ALL = [f"e{i}" for i in range(64)]


def _vectors(t):
    """Embeddings as one feature a dimension with their label."""
    # The cut leaves plain columns: over 64 aliases of array cells Spark's optimizer infers constraints without end.
    return Frame(cut(t("embeddings").df.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_ALL)])))


@query(
    """WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label AS l, i, avg(x) AS m, var_pop(x) AS v FROM e GROUP BY ALL), z AS (SELECT max(v) * 1e-9 AS eps FROM m),
    s AS (SELECT vec_id, l, sum(-0.5 * ln(2 * pi() * (v + eps)) - (x - m) ** 2 / (2 * (v + eps))) AS score FROM e JOIN m USING (i), z GROUP BY ALL) SELECT vec_id, arg_max(l, score) AS p FROM s GROUP BY 1"""
)
def gaussian_nb(t, spark):
    return GaussianNB().fit_transform(_vectors(t), _ALL, "label", pred_col="p").select(["vec_id", "p"])


@query("SELECT a.vec_id, arg_min(b.label, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS p FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1")
def knn(t, spark):
    """All labelled rows train; each row itself is left out of its neighbours."""
    f = _vectors(t)
    return KNearestNeighbors(1).fit(f, _ALL, "label", id_col="vec_id").transform(f, pred_col="p").select(["vec_id", "p"])


_SCALED = "o AS (SELECT o_orderkey, o_totalprice > 250000 AS y, o_totalprice::DOUBLE AS p, o_custkey::DOUBLE AS c FROM orders), d AS (SELECT o_orderkey, y, (p - avg(p) OVER ()) / stddev_pop(p) OVER () AS a, (c - avg(c) OVER ()) / stddev_pop(c) OVER () AS b FROM o)"


def _logistic_sql(steps: int = 20, alpha: float = 0.5, penalty: float = 0.1) -> str:
    """Every gradient step as a table of its own."""
    parts, u = [f"WITH {_SCALED}", "t0 AS (SELECT 0::DOUBLE AS t, 0::DOUBLE AS u, 0::DOUBLE AS v)"], "1 / (1 + exp(-(t + u * a + v * b)))"
    for k in range(steps):
        rate = alpha / (1 + k / steps) ** 0.5
        parts.append(f"t{k + 1} AS (SELECT any_value(t) + {rate} * avg(y::INT - {u}) AS t, any_value(u) + {rate} * (avg((y::INT - {u}) * a) - {penalty} * any_value(u) / count(*)) AS u, any_value(v) + {rate} * (avg((y::INT - {u}) * b) - {penalty} * any_value(v) / count(*)) AS v FROM d, t{k})")
    return ", ".join(parts) + f" SELECT o_orderkey, y::INT AS y, round_even({u}, 0)::DOUBLE AS \"prediction_LogReg\" FROM d, t{steps}"


@query(_logistic_sql())
def logreg(t, spark):
    f = StandardScaler().fit_transform(Frame(t("orders").df.select("o_orderkey", "o_totalprice", "o_custkey", (F.col("o_totalprice") > 250000).cast("int").alias("y"))), ["o_totalprice", "o_custkey"])
    return LogisticRegression(alpha=0.5, max_iter=20, threshold=0.0).fit_transform(f, ["o_totalprice", "o_custkey"], "y").select(["o_orderkey", "y", "prediction_LogReg"])


def _svm_sql(steps: int = 20, rate: float = 0.5, weight: float = 0.1) -> str:
    parts, m = [f"WITH {_SCALED}, s AS (SELECT o_orderkey, a, b, CASE WHEN y THEN 1 ELSE -1 END AS y FROM d)", "t0 AS (SELECT 0::DOUBLE AS u, 0::DOUBLE AS v)"], "y * (u * a + v * b) < 1"
    for k in range(steps):
        parts.append(f"t{k + 1} AS (SELECT any_value(u) - {rate} * (avg(CASE WHEN {m} THEN -y * a ELSE 0 END) + 2 * {weight} * any_value(u)) AS u, any_value(v) - {rate} * (avg(CASE WHEN {m} THEN -y * b ELSE 0 END) + 2 * {weight} * any_value(v)) AS v FROM s, t{k})")
    return ", ".join(parts) + f" SELECT o_orderkey, y::INT AS y, CASE WHEN u * a + v * b >= 0 THEN 1.0::DOUBLE ELSE -1.0 END AS \"prediction_SVM\" FROM s, t{steps}"


@query(_svm_sql())
def svm(t, spark):
    f = StandardScaler().fit_transform(Frame(t("orders").df.select("o_orderkey", "o_totalprice", "o_custkey", F.when(F.col("o_totalprice") > 250000, 1).otherwise(-1).alias("y"))), ["o_totalprice", "o_custkey"])
    return SVM(coef_lr=0.5, max_iter=20, force=True).fit_transform(f, ["o_totalprice", "o_custkey"], "y").select(["o_orderkey", "y", "prediction_SVM"])


@query()
def gd_regression(t, spark):
    f = StandardScaler().fit_transform(t("lineitem").select(["l_orderkey", "l_quantity", "l_discount", "l_extendedprice"]), ["l_quantity", "l_discount"])
    return rounded(GDRegressor(alpha=0.5).fit_transform(f, ["l_quantity", "l_discount"], "l_extendedprice").select(["l_orderkey", "pred_LinearReg"]), 2)


@query(
    """WITH RECURSIVE c0(k, x, y) AS (VALUES (0, 10.0::DOUBLE, 0.02::DOUBLE), (1, 25.0, 0.05), (2, 40.0, 0.08)),
    c1 AS (SELECT k, avg(q) x, avg(d) y FROM (SELECT l_quantity q, l_discount d, arg_min(k, (l_quantity - x) ** 2 + (l_discount - y) ** 2) k FROM (SELECT row_number() OVER () r, l_quantity, l_discount FROM lineitem), c0 GROUP BY r, q, d) GROUP BY 1),
    c2 AS (SELECT k, avg(q) x, avg(d) y FROM (SELECT l_quantity q, l_discount d, arg_min(k, (l_quantity - x) ** 2 + (l_discount - y) ** 2) k FROM (SELECT row_number() OVER () r, l_quantity, l_discount FROM lineitem), c1 GROUP BY r, q, d) GROUP BY 1)
    SELECT k::BIGINT AS k, round(x, 6) AS x, round(y, 6) AS y FROM c2"""
)
def kmeans_two_steps(t, spark):
    m = Kmeans(3, max_iter=2, epsilon=0.0, centroids=[[10.0, 0.02], [25.0, 0.05], [40.0, 0.08]]).fit(t("lineitem"), ["l_quantity", "l_discount"])
    return spark.createDataFrame([(i, round(c[0], 6), round(c[1], 6)) for i, c in enumerate(m.centroids)], "k long, x double, y double")


@query()
def kmeans(t, spark):
    return Kmeans(5, max_iter=20).fit_transform(t("customer").select(["c_custkey", "c_acctbal"]), ["c_acctbal"])


@query(
    """WITH p AS (SELECT c_custkey, c_acctbal AS x, count(*) OVER (ORDER BY c_acctbal RANGE BETWEEN 3.0 PRECEDING AND 3.0 FOLLOWING) >= 4 AS core FROM customer),
    g AS (SELECT x, CASE WHEN x - lag(x) OVER (ORDER BY x) <= 3.0 THEN 0 ELSE 1 END AS starts FROM (SELECT DISTINCT x FROM p WHERE core)), k AS (SELECT x, sum(starts) OVER (ORDER BY x) - 1 AS k FROM g)
    SELECT c_custkey, x AS c_acctbal, coalesce((SELECT min(k) FROM k WHERE k.x = p.x), -1)::INT AS cluster FROM p WHERE core
    UNION ALL SELECT c_custkey, x, coalesce((SELECT min(k) FROM k WHERE k.x BETWEEN p.x - 3.0 AND p.x + 3.0), -1)::INT FROM p WHERE NOT core"""
)
def dbscan(t, spark):
    """In one dimension, where SQL can say it: customers by balance; clusters are numbered from the lowest."""
    return DBSCAN(["c_acctbal"], "cluster", eps=3.0, min_pts=4).fit_predict(t("customer").select(["c_custkey", "c_acctbal"]))


@query()
def st_dbscan_gps(t, spark):
    g = t("gps").df
    number = lambda c: F.replace(F.col(c), F.lit(","), F.lit(".")).try_cast("double")
    g = g.select("fix_id", number("LAT").alias("lat"), number("LON").alias("lon"), F.try_to_timestamp("DTHR", F.lit("dd/MM/yyyy HH:mm:ss")).alias("at"))
    return st_dbscan(Frame(g.where("lat <> 0")), {"lat_col": "lat", "lon_col": "lon", "datetime": "at", "spatial_threshold": 300, "temporal_threshold": 5, "minPts": 4})


_BASKETS = "SELECT l_orderkey, list_sort(list_distinct(list(p_type))) AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"


def _baskets(t):
    return t("lineitem").join(t("part"), "l_partkey", "p_partkey").group_by("l_orderkey").set("p_type", "b")


@query(
    f"""WITH b AS ({_BASKETS}), n AS (SELECT floor(0.2 * count(*) + 0.5) AS least FROM b), i AS (SELECT l_orderkey o, unnest(b) AS x FROM b),
    s AS (SELECT [x] AS items, count(*) AS support FROM i GROUP BY x UNION ALL SELECT [a.x, c.x], count(*) FROM i a JOIN i c ON a.o = c.o AND a.x < c.x GROUP BY a.x, c.x
    UNION ALL SELECT [a.x, c.x, e.x], count(*) FROM i a JOIN i c ON a.o = c.o AND a.x < c.x JOIN i e ON a.o = e.o AND c.x < e.x GROUP BY a.x, c.x, e.x
    UNION ALL SELECT [a.x, c.x, e.x, g.x], count(*) FROM i a JOIN i c ON a.o = c.o AND a.x < c.x JOIN i e ON a.o = e.o AND c.x < e.x JOIN i g ON a.o = g.o AND e.x < g.x GROUP BY a.x, c.x, e.x, g.x)
    SELECT items, support FROM s, n WHERE support >= least"""
)
def fpgrowth(t, spark):
    return FPGrowth(0.2).fit_transform(_baskets(t), "b")


@query(
    f"""WITH b AS ({_BASKETS}), n AS (SELECT floor(0.2 * count(*) + 0.5) AS least FROM b), i AS (SELECT l_orderkey o, unnest(b) AS x FROM b),
    one AS (SELECT x, count(*) AS c FROM i GROUP BY 1), two AS (SELECT a.x p, c.x q, count(*) AS c FROM i a JOIN i c ON a.o = c.o AND a.x <> c.x GROUP BY 1, 2)
    SELECT [p] AS "Pre-Rule", [q] AS "Post-Rule", round(two.c / one.c, 6) AS confidence FROM two JOIN one ON p = x, n WHERE two.c >= least AND two.c / one.c >= 0.3"""
)
def assoc_rules(t, spark):
    sets = Frame(FPGrowth(0.2).fit_transform(_baskets(t), "b").df.where(F.size("items") <= 2))
    return rounded(AssociationRules(0.3).fit_transform(sets))


def _predicted(t):
    return Frame(t("orders").df.select((F.col("o_totalprice") > 250000).cast("int").alias("y"), (F.col("o_custkey") % 3 == 0).cast("int").alias("p"), F.col("o_totalprice").alias("v"), (F.col("o_totalprice") + F.col("o_custkey") % 10).alias("w"), F.col("o_orderstatus").alias("s"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).otherwise(F.lit("O")).alias("r")))


@query(
    """WITH c AS (SELECT o_totalprice > 250000 AS y, o_custkey % 3 = 0 AS p FROM orders), k AS (SELECT sum((y AND p)::INT) tp, sum(p::INT) pp, sum(y::INT) ap, avg((y = p)::INT) acc FROM c)
    SELECT round(acc, 6) AS accuracy, round(tp / pp, 6) AS "precision", round(tp / ap, 6) AS recall, round(2 * tp / (pp + ap), 6) AS f1 FROM k"""
)
def metrics_binary(t, spark):
    m = BinaryClassificationMetrics("y", "p", _predicted(t))
    return rounded(Frame(spark.createDataFrame([(float(m.accuracy), float(m.precision), float(m.recall), float(m.f1))], "accuracy double, precision double, recall double, f1 double")))


_MULTI = """WITH c AS (SELECT o_orderstatus AS y, CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus ELSE 'O' END AS p FROM orders), l AS (SELECT DISTINCT y AS v FROM c),
    m AS (SELECT v AS label, sum((y = v AND p = v)::INT) / sum((p = v)::INT) AS "precision", sum((y = v AND p = v)::INT) / sum((y = v)::INT) AS recall FROM c, l GROUP BY 1)"""


@query(_MULTI + ' SELECT label, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(2 * "precision" * recall / ("precision" + recall), 6) AS f1 FROM m')
def metrics_multi(t, spark):
    m = MultilabelMetrics("s", "r", _predicted(t)).precision_recall
    return rounded(Frame(spark.createDataFrame([(r[0], *map(float, r[1:])) for r in m.itertuples(index=False)], "label string, precision double, recall double, f1 double")))


@query(_MULTI + ', a AS (SELECT avg("precision") AS p, avg(recall) AS r FROM m) SELECT round((SELECT avg((y = p)::INT) FROM c), 6) AS accuracy, round(p, 6) AS "precision", round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM a')
def metrics_multi_averages(t, spark):
    m = MultilabelMetrics("s", "r", _predicted(t))
    return rounded(Frame(spark.createDataFrame([tuple(map(float, (m.accuracy, m.precision, m.recall, m.f1)))], "accuracy double, precision double, recall double, f1 double")))


@query(
    """WITH c AS (SELECT o_totalprice AS y, o_totalprice + o_custkey % 10 AS p FROM orders), a AS (SELECT count(*) n, avg(y) m FROM c), s AS (SELECT sum((y - p) ** 2) AS sse, sum(abs(y - p)) AS sae, sum((y - m) ** 2) AS sst, any_value(n) - 2 AS k FROM c, a)
    SELECT round(1 - sse / sst, 6) AS r2, round(sse / k, 4) AS mse, round(sqrt(sse / k), 4) AS rmse, round(sae / k, 4) AS mae, round((sst - sse) / 1e12, 4) AS msr FROM s"""
)
def metrics_regression(t, spark):
    m = RegressionMetrics(["x"], "v", "w", _predicted(t))
    return spark.createDataFrame([(round(m.r2, 6), round(m.mse, 4), round(m.rmse, 4), round(m.mae, 4), round(m.msr / 1e12, 4))], "r2 double, mse double, rmse double, mae double, msr double")


_RANKS = "WITH e AS (SELECT l_partkey AS s, l_suppkey AS d FROM lineitem), g AS (SELECT s, count(*) AS o FROM e GROUP BY 1), v AS (SELECT s AS v FROM e UNION SELECT d FROM e), r0 AS (SELECT v, 1.0::DOUBLE AS r FROM v)" + "".join(
    f", r{k} AS (SELECT v.v, CASE WHEN q.t IS NULL THEN 1.0 ELSE 0.15 + 0.85 * q.t END AS r FROM v LEFT JOIN (SELECT d, sum(r.r / g.o) AS t FROM e JOIN r{k - 1} r ON e.s = r.v JOIN g ON g.s = e.s GROUP BY 1) q ON v.v = q.d)" for k in (1, 2, 3)
)


@query(_RANKS + ' SELECT v AS "Vertex", round(r, 6) AS "Rank" FROM r3')
def pagerank_k(t, spark):
    return rounded(PageRank(0.85, 3).transform(t("lineitem"), "l_partkey", "l_suppkey"))


# Geography


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 AND c_acctbal < 10000 AND c_custkey < 1500 THEN (floor(c_acctbal / 2000) * 10 + c_custkey // 500)::BIGINT END AS area FROM customer")
def geo_within(t, spark):
    """All customers as points over a grid of rectangles that share borders."""
    points = Frame(t("customer").df.select("c_custkey", F.col("c_acctbal").cast("double").alias("lat"), F.col("c_custkey").cast("double").alias("lon")))
    rows = []
    for i in range(5):
        for j in range(3):
            y0, y1, x0, x1 = 2000.0 * i, 2000.0 * i + 2000, 500.0 * j, 500.0 * j + 500
            rows.append((i * 10 + j, [[y0, x0], [y0, x1], [y1, x1], [y1, x0]]))
    shapes = Frame(spark.createDataFrame(rows, "area long, points array<array<double>>"))
    return points.geo_within(shapes, "lat", "lon", attributes=["area"]).select(["c_custkey", "area"])


@query("SELECT fix_id, round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS lat, round(6378137 * radians(lon), 3) AS lon FROM (SELECT fix_id, TRY_CAST(replace(LAT, ',', '.') AS DOUBLE) AS lat, TRY_CAST(replace(LON, ',', '.') AS DOUBLE) AS lon FROM gps) WHERE lat <> 0 AND lon <> 0")
def crst_mercator(t, spark):
    number = lambda c: F.replace(F.col(c), F.lit(","), F.lit(".")).try_cast("double")
    f = Frame(t("gps").df.select("fix_id", number("LAT").alias("lat"), number("LON").alias("lon")).where("lat <> 0 AND lon <> 0"))
    return rounded(f.crst_transform("lat", "lon", 4326, 3857), 3)


@query("SELECT fix_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM (SELECT fix_id, TRY_CAST(replace(LAT, ',', '.') AS DOUBLE) AS lat, TRY_CAST(replace(LON, ',', '.') AS DOUBLE) AS lon FROM gps) WHERE lat BETWEEN 1 AND 80 AND lon BETWEEN -36 AND -26")
def crst_utm_round_trip(t, spark):
    number = lambda c: F.replace(F.col(c), F.lit(","), F.lit(".")).try_cast("double")
    f = Frame(t("gps").df.select("fix_id", number("LAT").alias("lat"), number("LON").alias("lon")).where("lat BETWEEN 1 AND 80 AND lon BETWEEN -36 AND -26"))
    return rounded(f.crst_transform("lat", "lon", 4326, 32625).crst_transform("lat", "lon", 32625, 4326), 6)


# Sources and sinks: written to a folder and read back


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/io-{uuid.uuid4().hex}"


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def io_csv(t, spark):
    d = _folder(spark)
    t("supplier").save.csv(d, columns=["s_suppkey", "s_name", "s_acctbal"])
    return Context(spark).read.csv(d, schema={"s_suppkey": DataType.INT, "s_name": DataType.STRING, "s_acctbal": DataType.DECIMAL})


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def io_json(t, spark):
    d = _folder(spark)
    t("supplier").select(["s_suppkey", "s_name", "s_acctbal"]).save.json(d)
    return Context(spark).read.json(d, schema={"s_suppkey": DataType.INT, "s_acctbal": DataType.DECIMAL}).select(["s_suppkey", "s_name", "s_acctbal"])


@query("SELECT o_orderkey, o_orderdate FROM orders")
def io_parquet(t, spark):
    d = _folder(spark)
    t("orders").save.parquet(d)
    return Context(spark).read.parquet(d, columns=["o_orderkey", "o_orderdate"])


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def io_txt(t, spark):
    d = _folder(spark)
    t("supplier").save.csv(d, columns=["s_suppkey", "s_name", "s_acctbal"], sep="|", header=False)
    f = Context(spark).read.txt(d, sep="|", header=False, prefix="c", schema={"c0": DataType.INT, "c2": DataType.DECIMAL})
    return f.rename(["c0", "c1", "c2"], ["s_suppkey", "s_name", "s_acctbal"])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def io_pickle(t, spark):
    d = _folder(spark).removeprefix("file://").removeprefix("file:")
    t("customer").select(["c_custkey", "c_name", "c_acctbal"]).repartition(3).save.pickle(d)
    return Context(spark).read.pickle(d)


@query("SELECT 'overwrite' AS mode, (SELECT count(*) FROM region) AS n UNION ALL SELECT 'ignore', (SELECT count(*) FROM region) UNION ALL SELECT 'error', -1")
def io_modes(t, spark):
    """What lies in a folder after each mode has written regions over, or nations beside, what was there; -1 is a refusal."""
    d, rows = _folder(spark), []
    read = lambda: Context(spark).read.parquet(d).count_rows()
    t("nation").save.parquet(d)
    t("region").save.parquet(d, mode="overwrite")
    rows.append(("overwrite", read()))
    t("nation").save.parquet(d, mode="ignore")
    rows.append(("ignore", read()))
    try:
        t("nation").save.parquet(d, mode="error")
        rows.append(("error", read()))
    except Exception:  # Spark's own: the path exists
        rows.append(("error", -1))
    return spark.createDataFrame(rows, "mode string, n long")


def _shapefile(folder: str, records: list[tuple[str, list[tuple[float, float]]]]) -> None:
    """Polygons (x, y) with a name each, as ``a.shp`` and ``a.dbf``."""
    body = b""
    for k, (_, pts) in enumerate(records):
        content = struct.pack("<i4d2ii", 5, 0, 0, 9, 9, 1, len(pts), 0) + b"".join(struct.pack("<2d", *p) for p in pts)
        body += struct.pack(">2i", k + 1, len(content) // 2) + content
    os.makedirs(folder)
    with open(f"{folder}/a.shp", "wb") as f:
        f.write(b"\0" * 100 + body)
    field = b"name".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([30]) + b"\0" * 15
    with open(f"{folder}/a.dbf", "wb") as f:
        f.write(b"\x03" + b"\0" * 3 + struct.pack("<IHH", len(records), 32 + 32 + 1, 1 + 30) + b"\0" * 20 + field + b"\r" + b"".join(b" " + n.encode().ljust(30) for n, _ in records))


@query("SELECT n_name AS name, 4::INT AS corners, n_regionkey::DOUBLE AS lat, n_nationkey::DOUBLE AS lon FROM nation")
def io_shapefile(t, spark):
    """Nations (a fixed short list) as triangles at (region, nation), written and read."""
    d = _folder(spark).removeprefix("file://").removeprefix("file:")
    _shapefile(d, [(r["n_name"], [(r["n_nationkey"], r["n_regionkey"]), (r["n_nationkey"] + 1, r["n_regionkey"]), (r["n_nationkey"], r["n_regionkey"] + 1), (r["n_nationkey"], r["n_regionkey"])]) for r in t("nation").df.collect()])
    f = Context(spark).read.shapefile(f"{d}/a.shp", f"{d}/a.dbf")
    return f.df.select("name", F.size("points").alias("corners"), F.col("points")[0][0].cast("double").alias("lat"), F.col("points")[0][1].cast("double").alias("lon"))


@query("SELECT r_regionkey, r_name, 2::INT AS parts FROM region")
def parallelize(t, spark):
    """A pandas frame in two partitions (regions, a fixed short list)."""
    f = Context(spark).parallelize(t("region").select(["r_regionkey", "r_name"]).to_df(), 2)
    return f.map(F.lit(f.num_of_partitions()), "parts")


@query("SELECT n_nationkey, n_name FROM nation")
def import_fragments(t, spark):
    """Partitions handed out as pandas frames and taken in again."""
    parts = t("nation").select(["n_nationkey", "n_name"]).repartition(3).export_partitions()
    return Context(spark).import_data(parts, {"n_nationkey": DataType.INT})


@query("SELECT count(*) AS n, 4::BIGINT AS parts, count(*) AS by_part, 2::BIGINT AS n_columns, 'c_custkey,c_name' AS names, count(*) AS rows_out, 10::BIGINT AS shown, 'bigint' AS kind FROM customer")
def actions(t, spark):
    """Counts, partitions, names, kinds, rows as pandas, the cache and a look at the first rows."""
    f = t("customer").select(["c_custkey", "c_name"]).hash_partition("c_custkey", 4).cache()
    shown = f.take(10).show().to_df()
    row = (f.count_rows(), f.num_of_partitions(), sum(f.count_rows(total=False)), len(f.schema()), ",".join(f.columns()), len(f.to_df(["c_custkey"])), len(shown), f.dtypes()["c_custkey"])
    f.unpersist()
    return spark.createDataFrame([row], "n long, parts long, by_part long, n_columns long, names string, rows_out long, shown long, kind string")


@query("SELECT c_custkey, round((c_acctbal - m) / s, 6) AS z FROM customer, (SELECT avg(c_acctbal) m, stddev_pop(c_acctbal) s FROM customer)")
def model_saved(t, spark):
    """A fitted model saved, loaded by another object and applied."""
    d, f = _folder(spark), t("customer").select(["c_custkey", "c_acctbal"])
    StandardScaler().fit(f, "c_acctbal").save_model(d)
    return rounded(StandardScaler().load_model(d).transform(f, "c_acctbal", output_col=["z"], remove=True))


@query("SELECT event_id, CAST(value AS BIGINT)::VARCHAR AS whole, weekofyear(ts)::INT AS w FROM (SELECT event_id, trunc(value) AS value, ts FROM events)")
def map_cast_week(t, spark):
    return t("events").map(col("value").cast(DataType.INT), "whole").map(col("whole").cast(DataType.STRING), "whole").map(col("ts").week(), "w").select(["event_id", "whole", "w"])


@query(
    """SELECT p_partkey, round(sin(x), 6) AS a, round(cos(x), 6) AS b, round(tan(x), 6) AS c, round(exp(x / 100), 6) AS d, round(log10(x), 6) AS e, round(abs(-x), 6) AS f, floor(x / 3)::DOUBLE AS g, ceil(x / 3)::DOUBLE AS h, round(asin(x / 100), 6) AS i, round(acos(x / 100), 6) AS j, round(atan(x), 6) AS k,
    round(sinh(x / 100), 6) AS l, round(cosh(x / 100), 6) AS m, round(tanh(x / 100), 6) AS n, round(sqrt(x), 6) AS o, round(ln(x + 1), 6) AS p, round(exp(x / 100) - 1, 6) AS q, round(atan2(x, 7), 6) AS r FROM (SELECT p_partkey, p_size::DOUBLE AS x FROM part)"""
)
def expr_functions(t, spark):
    f = t("part").map(F.col("p_size").cast("double"), "odd name").select_expression("p_partkey", "x = `odd name` + 0")
    made = f.select_expression(
        "p_partkey", "a = sin(x)", "b = cos(x)", "c = tan(x)", "d = exp(x / 100)", "e = log10(x)", "f = abs(-x)", "g = floor(x / 3)", "h = ceil(x / 3)", "i = arcsin(x / 100)", "j = arccos(x / 100)", "k = arctan(x)", "l = sinh(x / 100)", "m = cosh(x / 100)", "n = tanh(x / 100)", "o = sqrt(x)", "p = log1p(x)", "q = expm1(x / 100)", "r = arctan2(x, 7)"
    )
    return rounded(Frame(made.df.withColumns({c: F.col(c).cast("double") for c in ("g", "h")})))


# Flows


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM lineitem WHERE l_quantity < 20 GROUP BY 1")
def narrow_flow(t, spark):
    f = t("lineitem").select(["l_returnflag", "l_quantity", "l_extendedprice", "l_discount"]).filter("l_quantity < 20").select_expression("l_returnflag", "r = l_extendedprice * (1 - l_discount)")
    return Frame(f.map(F.col("r").cast("decimal(18,4)"), "r").group_by("l_returnflag").count("*", "n").sum("r", "revenue").df.withColumn("revenue", F.col("revenue").cast("double")))


@query(
    """WITH p AS (SELECT * FROM titanic WHERE Age IS NOT NULL AND NOT isnan(Age) AND Age >= 0 AND Age <= 120 AND Survived IS NOT NULL AND Sex IN ('male', 'female')),
    k AS (SELECT CASE Survived WHEN 0 THEN 'No' ELSE 'Yes' END AS Survived, CASE WHEN Age < 18 THEN 'Kids' WHEN Sex = 'female' THEN 'Women' ELSE 'Men' END AS kind FROM p)
    SELECT Survived, count(*) FILTER (kind = 'Women') AS Women, count(*) FILTER (kind = 'Men') AS Men, count(*) FILTER (kind = 'Kids') AS Kids FROM k GROUP BY 1"""
)
def titanic_flow(t, spark):
    """One scan and one aggregate for the three kinds."""
    f = t("titanic").select(["Survived", "Sex", "Age"]).dropna(["Survived", "Age"]).filter("Age >= 0 and Age <= 120 and Sex in ['male', 'female']").replace({0: "No", 1: "Yes"}, subset="Survived")
    kind = F.when(F.col("Age") < 18, "Kids").when(F.col("Sex") == "female", "Women").otherwise("Men")
    for k in ("Women", "Men", "Kids"):
        f = f.map((kind == k).cast("int"), k)
    return f.group_by("Survived").sum("Women", "Women").sum("Men", "Men").sum("Kids", "Kids")


@query(
    """SELECT line, hour, count(*) AS taps FROM (SELECT CODLINHA AS line, hour(try_strptime(left(DATAUTILIZACAO, 17), '%d/%m/%y %H:%M:%S'))::INT AS hour FROM ticketing WHERE CODLINHA IS NOT NULL AND DATAUTILIZACAO IS NOT NULL) WHERE hour IS NOT NULL GROUP BY ALL"""
)
def people_paths_flow(t, spark):
    f = t("ticketing").dropna(["CODLINHA", "DATAUTILIZACAO"]).map(F.try_to_timestamp(F.substring("DATAUTILIZACAO", 1, 17), F.lit("dd/MM/yy HH:mm:ss")), "at").dropna("at")
    return f.map(col("at").hour(), "hour").rename("CODLINHA", "line").group_by(["line", "hour"]).count("*", "taps")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


__all__ = ["oracle_sql", "queries"]
