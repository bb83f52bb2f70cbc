"""The general training-data operators: brute force on small fixtures, and the defined results of odd inputs."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewise.operators.hotkeys import key_profile
from framewise.operators.impute import KPrototypesImputer, filled_cells, known_code, known_number, known_text
from framewise.operators.ingest import Field, at_most, has_letter, is_clean, parse_lines, plain_number, split_valid
from framewise.operators.profile import count_chunks, departures, plain_files, profile, read_footers, table_profile, value_counts_by_load
from framewise.operators.segment import cover, known_values, pieces, split_packed

# Imputation


def imputer():
    values = {"age": known_number(F.col("age")), "sex": known_text(F.col("sex")), "port": known_text(F.col("port"), r"\A[A-Z]{1,3}\z"), "cls": known_code(F.col("cls"), [1, 2, 3])}
    return KPrototypesImputer(values, ["age", "sex", "port", "cls"], {"age": None}, {"sex": None, "port": None, "cls": None}, parent=["cls", "sex"], group_key=F.col("ticket"), group_targets=["port", "cls"], k=4, max_iter=3, support=1)


COLUMNS = "id long, age double, sex string, port string, cls long, ticket string, age_filled string"


def test_fill(spark):
    rows = [(i, 20.0 + i % 5, "m", "S", 3, f"t{i // 2}", "own") for i in range(20)] + [(100 + i, 60.0 + i % 5, "f", "C", 1, f"u{i // 2}", "own") for i in range(20)]
    rows += [(900, None, "m", "S", 3, None, None), (901, 61.0, "?", "C", 1, "u3", None), (902, float("nan"), "f", "unk", 9, "u0", None), (903, -1.0, " ", "", None, None, None), (904, 999.0, "m", "NA", 3, "t1", None)]
    df = spark.createDataFrame(rows, COLUMNS)
    out = imputer().transform(df)
    assert out.columns[:7] == df.columns and "age_filled_2" in out.columns
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    assert got[900]["age_method"] == "cluster" and 20 <= got[900]["age_filled_2"] <= 24
    assert got[901]["sex_method"] == "cluster" and got[901]["sex_filled"] == "f"
    assert (got[902]["port_filled"], got[902]["port_method"], got[902]["cls_filled"], got[902]["cls_method"]) == ("C", "group", 1, "group")
    assert got[904]["port_filled"] == "NA" and got[904]["port_method"] is None
    assert all(v is not None for v in (got[903]["age_filled_2"], got[903]["sex_filled"], got[903]["port_filled"], got[903]["cls_filled"]))
    cells = {(r["id"], r["field_name"]) for r in filled_cells(out, "id", ["age", "sex", "port", "cls"]).collect()}
    assert cells == {(900, "age"), (901, "sex"), (902, "age"), (902, "port"), (902, "cls"), *((903, c) for c in ("age", "sex", "port", "cls")), (904, "age")}


def test_levels_of_filling(spark):
    """Cluster from enough known records, then parent, then all; without clusters the result differs."""
    rows = [(i, 30.0 + i % 3, "m" if i % 2 else "f", "S", 3, None, None) for i in range(60)] + [(100 + i, 8.0, "m", "S", 1, None, None) for i in range(30)]
    rows += [(500, None, "m", "S", 1, None, None), (501, None, "f", "S", 3, None, None), (502, None, None, "S", None, None, None)]
    df = spark.createDataFrame(rows, COLUMNS)
    by_support = {}
    for support in (1, 10**9):
        i = imputer()
        i.support, i.parent = support, ["cls", "sex"]
        by_support[support] = {r["id"]: (r["age_filled_2"], r["age_method"]) for r in i.transform(df).where("id >= 500").collect()}
    assert by_support[1][500] == (8.0, "cluster") and by_support[1][501][1] == "cluster"
    assert by_support[10**9][500] == (8.0, "parent") and by_support[10**9][502] == (30.0, "global")


def test_fill_is_nearer_than_a_constant(spark):
    """Known cells hidden: the error of the clusters' medians against that of one median for all, with wild ages among the values."""
    rnd = random.Random(8)
    rows, truth = [], {}
    for i in range(600):
        cls = rnd.choice([1, 3])
        age = rnd.gauss(50 if cls == 1 else 20, 4) if i % 25 else 5000.0
        truth[i] = age
        rows.append((i, None if i % 10 == 1 else age, "m", "S", cls, None, None))
    out = imputer().transform(spark.createDataFrame(rows, COLUMNS)).where("age_method = 'cluster'").collect()
    middle = float(np.median([a for a in truth.values()]))
    hidden = [r["id"] for r in out if truth[r["id"]] < 200]
    assert len(hidden) > 40
    error = np.mean([abs(r["age_filled_2"] - truth[r["id"]]) for r in out if truth[r["id"]] < 200])
    assert error < 5 < np.mean([abs(middle - truth[i]) for i in hidden])


def test_fill_without_values(spark):
    empty = imputer().transform(spark.createDataFrame([], COLUMNS))
    assert empty.count() == 0
    r = imputer().transform(spark.createDataFrame([(1, None, None, None, None, None, None)] * 2, COLUMNS)).collect()
    assert len(r) == 2 and r[0]["age_method"] == "none" and r[0]["sex_filled"] is None


# Several values in one field


@pytest.mark.parametrize(
    ("cell", "want"),
    [
        ("A1, B2", ["A1", "B2"]),
        ("A1 B2  C", ["A1", "B2", "C"]),
        ("A1,, B2;", ["A1", "B2"]),
        ('"A1, aft" / B2', ["A1, aft", "B2"]),
        ("'A1 & x' and B2", ["A1 & x", "B2"]),
        ('"A1 ""aft""" B2', ['A1 "aft"', "B2"]),
        ('"A1"|"B2"|"C"', ["A1", "B2", "C"]),
        ('"open, B2', ['"open', "B2"]),
        ("A1 and B2", ["A1", "B2"]),
        ("A1\tB2\nC3+D4", ["A1", "B2", "C3", "D4"]),
        ('" A1 "', ["A1"]),
        ('"" , A1', ["A1"]),
        (" , ;", []),
        ("", []),
    ],
)
def test_segments(cell, want):
    assert cover(cell, [], [(a, b) for a, b, quoted in pieces(cell) if quoted is None and cell[a] != '"']) == want


def test_nothing_is_cut_that_nothing_vouches_for():
    assert cover("A1, B2", [], []) == ["A1, B2"]
    assert cover("xx yy A1 zz", [], [(6, 8)]) == ["xx yy", "A1", "zz"]
    assert cover('xx "B2" yy', [], []) == ["xx", "B2", "yy"]


def test_known_values_with_separators_stay_whole():
    assert cover("A1, aft, B2", [(0, 7)], [(0, 2), (9, 11)]) == ["A1, aft", "B2"]
    # All parts have the form of a value: they win over the whole.
    assert cover("A1 B2", [(0, 5)], [(0, 2), (3, 5)]) == ["A1", "B2"]


def test_the_dictionary_decides(spark):
    """Values whose separators only the dictionary protects; without it nothing is cut up."""
    cells = ["Smith & Sons, Bell", "Bell", "Cook / Hart and Bell", "Smith & Sons"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "id int, cell string")
    run = lambda words: {(r["id"], r["pos"], r["value"]) for r in split_packed(df, "cell", spark.createDataFrame([(w,) for w in words], "value string")).collect()}
    got = run(["Smith & Sons", "Cook / Hart", "Bell"])
    # "Bell" vouches for its form, which is that of Smith, Sons, Cook and Hart too: the parts win ...
    assert (0, 1, "Smith") in got and (2, 1, "Cook") in got
    # ... unless they have none of their own.
    df = df.withColumn("cell", F.replace(F.replace("cell", F.lit("Sons"), F.lit("sons")), F.lit("Hart"), F.lit("hart")))
    got = run(["Smith & sons", "Cook / hart", "Bell"])
    assert got == {(0, 1, "Smith & sons"), (0, 2, "Bell"), (1, 1, "Bell"), (2, 1, "Cook / hart"), (2, 2, "Bell"), (3, 1, "Smith & sons")}
    assert {x for x in run(["zzz9"]) if x[0] != 1} == {(0, 1, "Smith & sons, Bell"), (2, 1, "Cook / hart and Bell"), (3, 1, "Smith & sons")}


def test_split_packed(spark):
    cells = ["A1", "A1, B2", '"C3, aft"', "C3, aft; A1", None, "", " ", "A1, B2", "x" * 50_000 + ", A1"]
    df = spark.createDataFrame([(i, c, "own", 7) for i, c in enumerate(cells)], "id long, cabin string, value string, pos int")
    want = {(0, 1, "A1"), (1, 1, "A1"), (1, 2, "B2"), (2, 1, "C3, aft"), (3, 1, "C3, aft"), (3, 2, "A1"), (7, 1, "A1"), (7, 2, "B2"), (8, 1, "x" * 50_000), (8, 2, "A1")}
    for block in (100_000, 2):
        out = split_packed(df, "cabin", block=block)
        assert out.columns == ["id", "cabin", "value", "pos", "pos_2", "value_2"]
        assert {(r["id"], r["pos_2"], r["value_2"]) for r in out.collect()} == want
    assert {r[0] for r in known_values(df, "cabin").collect()} == {"A1", "C3, aft"}
    assert split_packed(df.limit(0), "cabin").count() == 0
    assert {r["id"] for r in split_packed(df, "cabin", at_least=2).collect()} == {1, 3, 7, 8}


# Hot keys


def test_exact_quantiles(spark):
    rnd = random.Random(5)
    rows = [("hot", rnd.choice([rnd.gauss(0, 1), rnd.lognormvariate(3, 4), -1e300, 1e300, 0.0, -0.0, 5e-324])) for _ in range(4000)]
    rows += [(k, float(v)) for k, v in [("tie", 3), ("tie", 3), ("tie", 3), ("one", 7), (None, 2), (None, 1)]] + [("none", None), ("none", float("nan"))]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "k string, v double, n_rows int").repartition(5)
    got = {r["k"]: r for r in key_profile(df, ["k"], "v", [0.0, 0.25, 0.5, 0.999, 1.0]).collect()}
    assert len(got) == 5
    for key in {k for k, _ in rows}:
        vs = sorted(v for k, v in rows if k == key and v is not None and v == v)
        r = got[key]
        assert r["n_rows"] == sum(k == key for k, _ in rows) and r["n_values"] == len(vs)
        for q, name in ((0.0, "q0"), (0.25, "q25"), (0.5, "q50"), (0.999, "q99_9"), (1.0, "q100")):
            assert r[name] == (vs[max(1, int(np.ceil(round(q * len(vs), 9)))) - 1] if vs else None)
    assert abs(sum(r["row_share"] for r in got.values()) - 1) < 1e-9
    assert key_profile(df.limit(0), ["k"], "v").count() == 0


# Profile


def loads(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = []
    for load in range(12):
        for i in range(150):
            age = float(rng.integers(1, 80)) if rng.random() > 0.2 else None
            rows.append((load, (age * 12 if load == 3 and age else age), None if load == 5 and rng.random() < 0.95 else rng.choice(["A1", "B2", "C33", "-", None]), round(float(rng.gamma(2, 10)), 2)))
    pdf = pd.DataFrame(rows, columns=["load", "age", "cabin", "fare"])
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(pdf).coalesce(2).write.parquet(path)
    return pdf, spark.read.parquet(path)


def test_profile_finds_departures(spark, tmp_path):
    pdf, df = loads(spark, tmp_path)
    p = profile(df, "load", ["age", "cabin", "fare", "zzz"])
    got = {(r["load"], r["column_name"]): r for r in p.collect()}
    assert len(got) == 36
    r = got[(4, "age")]
    known = pdf[(pdf.load == 4)].age.dropna()
    assert (r["n_rows"], r["n_missing"], r["n_distinct"], float(r["least"]), float(r["most"])) == (150, 150 - len(known), known.nunique(), known.min(), known.max())
    found = {(r["load"], r["column_name"]) for r in departures(p, "load").collect()}
    assert found == {(3, "age"), (5, "cabin")}
    assert profile(df.limit(0), "load", ["age"]).count() == 0


def test_profile_finds_written_digits_and_their_range(spark):
    """Zero-padded numbers, other endings, another range of numbers: each only shows past the first letters of a cell."""
    rng, rows = np.random.default_rng(3), []
    for load in range(14):
        for _ in range(40 if load == 12 else 300):
            letter, number = rng.choice(list("ABCD")), int(rng.integers(1, 140))
            cell = f"{letter}{number}" + (f" {letter}{number + 2}" if rng.random() < 0.2 else "")
            if load == 3:
                cell = " ".join(f"{x[0]}{int(x[1:]):05d}" for x in cell.split())
            elif load == 6:
                cell = f"{letter}{number}/x"
            elif load == 9:
                cell = f"{letter}{number % 40 + 60}"
            rows.append((load, cell))
    p = profile(spark.createDataFrame(rows, "load int, cabin string"), "load", ["cabin"])
    got = {r["load"]: r for r in p.collect()}
    assert (got[3]["top_form"], got[6]["form_shift"], got[9]["low"] >= 60, got[0]["low"] < 10) == ("A99999", 1.0, True, True)
    assert {r["load"] for r in departures(p, "load").collect()} == {3, 6, 9}


def test_footers_spare_scans(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, None, "x", float(i), f"t{i % 5}") for i in range(50)], "load int, gone string, same string, v double, t string").coalesce(1).write.parquet(str(tmp_path / f"p{k}.parquet"))
    df = spark.read.parquet(*[str(tmp_path / f"p{k}.parquet") for k in range(3)])
    foot = read_footers(spark, df.inputFiles(), ["gone", "same", "v"], "load").collect()
    assert {(r["column"], r["n_rows"], r["n_nulls"]) for r in foot} == {("gone", 50, 50), ("same", 50, 0), ("v", 50, 0)}
    counts = {(r["load"], r["column"], r["value"]): (r["n"], r["n_footer"]) for r in value_counts_by_load(df, "load", ["gone", "same"]).collect()}
    assert counts == {**{(k, "gone", None): (50, 50) for k in range(3)}, **{(k, "same", "x"): (50, 50) for k in range(3)}}
    p = {(r["load"], r["column_name"]): r for r in profile(df, "load", ["gone", "same", "v", "t"]).collect()}
    assert [(p[(1, c)]["n_footer"], p[(1, c)]["n_dictionary"]) for c in ("gone", "same", "v", "t")] == [(50, 0), (50, 0), (0, 0), (0, 50)]
    t = {r["column_name"]: r for r in table_profile(df, ["gone", "same", "v", "t", "load"]).collect()}
    assert (t["gone"]["n_nulls"], t["gone"]["n_distinct"], t["gone"]["from_footer"]) == (150, 0, 150)
    assert (t["same"]["least"], t["same"]["most"], t["same"]["n_distinct"], t["same"]["from_footer"]) == ("x", "x", 1, 150)
    assert (t["v"]["low"], t["v"]["high"], t["v"]["n_distinct"], t["v"]["from_scan"]) == (0.0, 49.0, 50, 150)
    assert (t["t"]["least"], t["t"]["most"], t["t"]["n_distinct"], t["t"]["from_dictionary"]) == ("t0", "t4", 5, 150)
    assert (t["load"]["low"], t["load"]["high"], t["load"]["n_distinct"], t["load"]["from_footer"]) == (0.0, 2.0, 3, 150)


def test_chunks_with_a_footer_are_not_read(spark, tmp_path):
    """The data pages of constant chunks can be gone."""
    import pyarrow.parquet as pq

    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "x", f"t{i % 5}") for i in range(50)], "load int, same string, t string").coalesce(1).write.option("compression", "none").parquet(path)
    df = spark.read.parquet(path)
    file = df.inputFiles()[0].removeprefix("file://")
    chunk = pq.ParquetFile(file).metadata.row_group(0).column(1)
    data = bytearray(open(file, "rb").read())
    start = min(x for x in (chunk.data_page_offset, chunk.dictionary_page_offset) if x)
    data[start : start + chunk.total_compressed_size] = bytes(chunk.total_compressed_size)
    open(file, "wb").write(data)
    foot = read_footers(spark, df.inputFiles(), ["same", "t"], "load").withColumn("enough", F.col("column") == "same")
    got = count_chunks(foot, "load", {"same": "string", "t": "string"}).groupBy("column", "route").agg(F.sum("n").alias("n")).collect()
    assert {(r["column"], r["route"], r["n"]) for r in got} == {("same", "footer", 50), ("t", "dictionary", 50)}


def test_frames_that_are_not_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(k, float(i), f"t{i % 5}") for k in range(2) for i in range(50)], "load int, v double, t string").write.parquet(path)
    df = spark.read.parquet(path)
    assert plain_files(df) and plain_files(df.select("load", "t"))
    for other in (df.where("load = 0"), df.limit(10), df.withColumn("v", F.lit(3.0)), df.withColumnRenamed("v", "w"), df.union(df)):
        assert plain_files(other) == []
    rows = lambda f: {(r["load"], r["column_name"]): (r["n_rows"], r["n_distinct"]) for r in profile(f, "load", ["v", "t"]).collect()}
    assert rows(df.where("load = 7")) == {}
    assert rows(df.where("load = 0")) == {(0, "v"): (50, 50), (0, "t"): (50, 5)}
    assert sum(n for n, _ in rows(df.limit(10)).values()) == 20
    assert rows(df.withColumn("v", F.lit(3.0)))[(0, "v")] == (50, 1)


# Lines that fail to parse

FIELDS = [Field("id", "long"), Field("name", "string", (("invalid", lambda c: has_letter(c) & is_clean(c)),)), Field("age", "double", (("invalid", plain_number), ("invalid", at_most(120))))]


LINES = [
    ("1\tBo\t3.5", (1, "Bo", 3.5)),
    ('1\t"B\to"\t3', (1, "B\to", 3.0)),
    (' 1 \t "B ""x"" o" \t ', (1, 'B "x" o', None)),
    ('"1"\t"""x"""\t""', (1, '"x"', None)),
    ("z\tBo\\b\\t\t1", (None, "Bo\\b\\t", 1.0)),
    ('1\tBo" \t3', "quoting"),
    ('1\t"Bo\t3', "quoting"),
    ('1\t"Bo"x\t3', "quoting"),
    ('1\t""Bo""\t3', "quoting"),
    ('1\tx"Bo"\t3\t4', "quoting"),
    ("1\tBo", "columns"),
    ("1\tBo\t3\t", "columns"),
    ("", "columns"),
    (None, "columns"),
    ("1\t12 3\t3", "invalid"),
    ("1\t\t3", "invalid"),
    ("1\tBo\x01\t3", "invalid"),
    ("1\tBo�\t3", "invalid"),
    ("1\tBo\t.5", "invalid"),
    ("1\tBo\t5.", "invalid"),
    ("1\tBo\t1e2", "invalid"),
    ("1\tBo\t121", "invalid"),
    ("1\tBo\t120.0", (1, "Bo", 120.0)),
    ("1\tÉ\t" + "0" * 9000, (1, "É", 0.0)),
    ('1\t"' + 'a""' * 20_000 + '"\t1', (1, 'a"' * 20_000, 1.0)),
]


def test_lines(spark):
    df = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(LINES)], "id int, line string")
    good, bad = split_valid(parse_lines(df, "line", FIELDS))
    got = {r["id"]: (r["id_2"], r["name"], r["age"]) for r in good.collect()} | {r["id"]: r["reason"] for r in bad.collect()}
    for i, (line, want) in enumerate(LINES):
        assert got[i] == want, line
    assert len(got) == len(LINES)


def test_lines_against_a_plain_parser(spark):
    rnd = random.Random(1)
    lines = ["".join(rnd.choice('ab"\t 1') for _ in range(rnd.randrange(12))) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "k int, line string")
    got = {r["k"]: r["errors"] for r in parse_lines(df, "line", [Field("x"), Field("y")]).collect()}
    field = re.compile(r' *"(?:[^"]|"")*" *(?=\t|\Z)|[^"\t]*(?=\t|\Z)')

    def plain(t):
        n, at = 0, 0
        while True:
            m = field.match(t, at)
            if not m:
                return ["quoting"]
            n, at = n + 1, m.end()
            if at == len(t):
                return [] if n == 2 else ["columns"]
            at += 1

    assert all(got[i] == plain(t) for i, t in enumerate(lines))
