"""Table operations on small frames with known results."""

import pandas as pd
import pytest

from framewise.columns import col, udf
from framewise.types import DataType


def abc(ctx, n=10, parts=4):
    return ctx.parallelize(pd.DataFrame([[i, i + 5, 0] for i in range(n)], columns=["a", "b", "c"]), parts)


def values(frame):
    return sorted(tuple(None if v != v else v for v in r) for r in frame.to_df().itertuples(index=False))


def pairs(ctx, rows, names=("a", "b")):
    return ctx.parallelize(pd.DataFrame(rows, columns=list(names)), 2)


S1 = [("a", 1), ("a", 1), ("a", 1), ("a", 2), ("b", 3), ("c", 4)]


def test_select_drop_rename(ctx):
    f = abc(ctx)
    assert f.select(["a", "zzz"]).columns() == ["a"]
    assert f.drop(["a", "zzz"]).columns() == ["b", "c"]
    assert f.rename("a", "A").columns() == ["A", "b", "c"]
    with pytest.raises(ValueError):
        f.drop([])


def test_replace(ctx):
    assert values(abc(ctx).replace({0: 42}, subset="c")) == [(i, i + 5, 42) for i in range(10)]
    f = ctx.parallelize(pd.DataFrame({"a": [0, 1], "b": ["No", "a.b"]}), 1)
    assert values(f.replace({0: "No", 1: "Yes"}, subset="a")) == [("No", "No"), ("Yes", "a.b")]
    assert values(f.replace({r"\.": "-"}, subset="b", regex=True)) == [(0, "No"), (1, "a-b")]


def test_cast_and_map(ctx):
    f = ctx.parallelize(pd.DataFrame({"x": ["1", "2.7", "zz", None], "d": ["30/04/17 11:46:51.000000"] * 4}), 2)
    assert f.cast("x", DataType.INT).dtypes()["x"] == "bigint"
    assert sorted(v for v in f.cast("x", DataType.DECIMAL).to_df()["x"] if v == v) == [1.0, 2.7]
    g = f.map(col("d").to_datetime("dd/MM/yy HH:mm:ss.SSSSSS"), "d").map(col("d").year(), "y")
    assert set(g.to_df()["y"]) == {2017}
    assert sorted(abc(ctx).map(udf(lambda v: 7 if v > 5 else v, DataType.INT, col("a")), "a").to_df()["a"]) == [0, 1, 2, 3, 4, 5, 7, 7, 7, 7]


def test_explode_in_place(ctx, spark):
    from framewise.frame import Frame

    f = Frame(spark.createDataFrame([(1, [1, 2], "x"), (2, [], "y"), (3, None, "z")], "a int, l array<int>, s string"))
    assert values(f.explode("l")) == [(1, 1, "x"), (1, 2, "x")]


def test_add_column(ctx):
    left = ctx.parallelize(pd.DataFrame({"name": [f"N_{i}" for i in range(5)]}), 2)
    right = ctx.parallelize(pd.DataFrame({"name": [f"A_{i}" for i in range(10)], "b": range(10)}), 3)
    out = left.add_column(right)
    assert out.columns() == ["name_l", "name_r", "b"]
    assert values(out) == [(f"N_{i}", f"A_{i}", i) for i in range(5)]


def test_aggregation(ctx):
    f = ctx.parallelize(pd.DataFrame([[i, i + 5, "hello"] for i in range(10)], columns=["a", "b", "c"]), 4)
    assert values(f.group_by("c").count("a", "count_a").first("b", "first_b", order_by="a").last("b", "last_b", order_by="a")) == [("hello", 10, 5, 14)]
    g = f.group_by(["a", "c"]).count("*")
    assert g.columns() == ["a", "c", "count(*)"] and g.count_rows() == 10
    assert values(f.group_by("c").agg(m=("a", "mean"), n=("*", "count"))) == [("hello", 4.5, 10)]
    n = pairs(ctx, [("a", 1), (None, 2)])
    assert values(n.group_by("a").sum("b", "s")) == [("a", 1)]
    assert n.group_by("a", keep_null_keys=True).sum("b", "s").count_rows() == 2


def test_missing(ctx):
    f = ctx.parallelize(pd.DataFrame({"a": [1.0, None, 4.0, 7.0], "b": [None] * 4, "s": ["x", "x", None, "y"]}).astype({"b": "float"}), 2)
    assert f.dropna(["a", "s", "zzz"]).count_rows() == 2
    assert f.dropna(how="all").count_rows() == 4
    assert f.dropna(mode="REMOVE_COLUMN").columns() == []
    assert f.dropna(mode="REMOVE_COLUMN", how="all").columns() == ["a", "s"]
    assert f.dropna(mode="REMOVE_COLUMN", thresh=1).columns() == ["a", "s"]
    assert sorted(f.fillna("a", mode="MEAN").to_df()["a"]) == [1, 4, 4, 7]
    assert sorted(f.fillna("a", mode="MEDIAN").to_df()["a"]) == [1, 4, 4, 7]
    assert sorted(f.fillna("s", mode="MODE").to_df()["s"]) == ["x", "x", "x", "y"]
    assert sorted(f.fillna("a", value=0.0).to_df()["a"]) == [0, 1, 4, 7]
    assert f.fillna("b", mode="MEAN").to_df()["b"].isna().all()


def test_median_of_even_counts(ctx):
    f = ctx.parallelize(pd.DataFrame({"a": [9, 10, 1, 100], "i": [1, 2, None, None]}), 2)
    assert f.select("i").fillna("i", mode="MEDIAN").to_df()["i"].tolist() == [1, 2, 1.5, 1.5]


def test_joins(ctx):
    a = ctx.parallelize(pd.DataFrame({"k": ["x", "y", None], "v": [1, 2, 3]}), 2)
    b = ctx.parallelize(pd.DataFrame({"k": ["X", "y", None, "z"], "v": [10, 20, 30, 40]}), 2)
    out = a.join(b, "k")
    assert out.columns() == ["k", "v_l", "v_r"] and values(out) == [("y", 2, 20)]
    assert values(a.join(b, "k", case=False)) == [("x", 1, 10), ("y", 2, 20)]
    left = a.join(b, "k", mode="left")
    assert sorted(values(left), key=lambda r: r[0]) == [("x", 1, None), ("y", 2, 20)]
    right = a.join(b, "k", mode="right")
    assert right.columns() == ["v_l", "k", "v_r"] and right.count_rows() == 3
    assert a.join(b, "k", keep_keys=True).columns() == ["k_l", "v_l", "k_r", "v_r"]
    assert a.join(b, "k", mode="left", drop_null_keys=False).count_rows() == 3
    with pytest.raises(ValueError):
        a.join(b, "k", mode="outer")
    once = a.join(b, "k", suffixes=["_l", "_r"]).join(a, "k")
    assert once.columns() == ["k", "v_l", "v_r", "v"]


def test_cross_join(ctx):
    assert abc(ctx, 5).cross_join(abc(ctx, 4)).count_rows() == 20


def test_sets(ctx):
    s1, s2 = pairs(ctx, S1), pairs(ctx, [("a", 1), ("b", 3)] + [("e", 4)] * 5 + [("e", 6), ("e", 9), ("e", 10)])
    assert values(s1.except_all(s2)) == [("a", 1), ("a", 1), ("a", 2), ("c", 4)]
    assert values(s1.subtract(pairs(ctx, [("a", 1), ("b", 3)]))) == [("a", 2), ("c", 4)]
    assert values(s1.intersect(pairs(ctx, [("a", 1), ("a", 1), ("b", 3)]))) == [("a", 1), ("b", 3)]
    assert values(pairs(ctx, [("a", 1), ("a", 1), ("b", 3), ("c", 4)]).intersect_all(pairs(ctx, [("a", 1), ("a", 1), ("b", 3)]))) == [("a", 1), ("a", 1), ("b", 3)]
    assert abc(ctx).distinct("c", order_by="a").to_df().values.tolist() == [[0, 5, 0]]
    assert s1.union(s2).count_rows() == 16
    u = s1.union_by_name(ctx.parallelize(pd.DataFrame({"b": [1], "z": ["q"]}), 1))
    assert u.columns() == ["a", "b", "z"] and u.count_rows() == 7


def test_sort_take(ctx):
    f = ctx.parallelize(pd.DataFrame({"a": [2, 1, None, 2], "b": [1, 2, 3, 4]}), 3)
    assert f.sort(["a", "b"], [False]).to_df()["b"].tolist() == [1, 4, 2, 3]
    assert f.sort("a").to_df()["b"].tolist()[-1] == 3
    assert f.take(2, order_by="b").to_df()["b"].tolist() == [1, 2]


def test_samples_and_splits(ctx):
    f = abc(ctx, 100)
    assert f.sample(7, seed=1).count_rows() == 7
    assert f.sample(0).count_rows() == 0
    assert f.sample(0.255, seed=1).count_rows() == 26
    assert 0 <= f.sample(seed=3).count_rows() <= 100
    a, b = f.split(0.25, seed=9)
    assert (a.count_rows(), b.count_rows()) == (25, 75)
    assert a.intersect(b).count_rows() == 0
    assert values(f.split(0.25, seed=9)[0]) == values(a)
    same = ctx.parallelize(pd.DataFrame({"x": [1] * 50}), 3)
    a, b = same.split(0.3, seed=1)
    assert (a.count_rows(), b.count_rows()) == (15, 35)


def test_partitions(ctx):
    f = abc(ctx, 100, 4)
    assert f.count_rows(total=False) == [25] * 4
    g = f.repartition(7)
    assert g.num_of_partitions() == 7 and g.to_df()["a"].tolist() == list(range(100))
    h = f.repartition(distribution=[10, 0, 90])
    assert h.count_rows(total=False) == [10, 0, 90]
    assert h.balancer().count_rows(total=False) == [34, 33, 33]
    assert h.balancer().to_df()["a"].tolist() == list(range(100))
    assert f.hash_partition("a", 6).num_of_partitions() == 6
    r = f.range_partition("a", False, 3).to_df(split=True)
    assert len(r) == 3 and r[0]["a"].min() > r[1]["a"].max() > r[2]["a"].max()
    assert len(f.export_partitions()) == 4


def test_actions(ctx, capsys):
    f = abc(ctx, 3, 1)
    assert f.schema()["columns"].tolist() == ["a", "b", "c"]
    f.show(2)
    assert "a" in capsys.readouterr().out
    c = f.cache()
    assert c.count_rows() == 3
    c.unpersist()
    assert "Physical Plan" in ctx.context_status(f)
    assert ctx.import_data([pd.DataFrame({"a": [1]}), pd.DataFrame({"a": [2]})]).count_rows() == 2


def test_two_digit_years_of_all_rows(spark, ctx):
    import datetime

    from framewise.frame import Frame
    from framewise.queries.catalogue import queries

    f = Frame(spark.createDataFrame([("04/11/79",), ("01/02/24",), ("01/02/25",), ("29/02/00",), ("31/02/80",), (None,)], "d string"))
    read = lambda **k: [r["d"] for r in f.map(col("d").to_datetime("dd/MM/yy", **k), "d").df.collect()]
    date = datetime.date
    assert read(last_year=2024) == [date(1979, 11, 4), date(2024, 2, 1), date(1925, 2, 1), date(2000, 2, 29), None, None]
    assert read(last_year=1999)[3] is None and read()[0] == date(2079, 11, 4)
    d = "/root/testdata/sf0.001"
    rows = {r["tap_id"]: r["DATANASCIMENTO"] for r in spark.read.parquet(f"{d}/ticketing.parquet").collect()}
    got = {r["tap_id"]: r["born"] for r in queries()["map_to_datetime"](spark, d).collect()}
    assert got.keys() == rows.keys() and {k for k, v in got.items() if v} == {k for k, v in rows.items() if v}
    assert all(v.strftime("%d/%m/%y") == rows[k] and 1925 <= v.year <= 2024 for k, v in got.items() if v)
