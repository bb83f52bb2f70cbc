"""Readers, writers and the shapefile source."""

import struct

import pandas as pd
import pytest

from framewise.types import DataType


@pytest.fixture()
def f(ctx):
    return ctx.parallelize(pd.DataFrame({"k": [1, 2, 3], "s": ['a,"b"', "line", None], "x": [1.5, None, -2.25]}), 2)


def test_csv(ctx, f, tmp_path):
    f.save.csv(f"file://{tmp_path}/c")
    back = ctx.read.csv(f"file://{tmp_path}/c", schema={"k": DataType.INT, "s": DataType.STRING, "x": DataType.DECIMAL})
    assert back.sort("k").to_df().astype(object).where(lambda d: d.notna(), None).values.tolist() == [[1, 'a,"b"', 1.5], [2, "line", None], [3, None, -2.25]]
    assert set(ctx.read.csv(f"{tmp_path}/c").dtypes().values()) == {"string"}
    with pytest.raises(Exception):
        f.save.csv(f"{tmp_path}/c", mode="error")
    f.save.csv(f"{tmp_path}/c", mode="ignore")


def test_csv_options(ctx, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("1;2,5;x\n# no\n3;1.000,25;NA\n")
    df = ctx.read.csv(str(p), sep=";", header=False, decimal=",", thousands=".", comment="#", schema={"col_0": DataType.INT, "col_1": DataType.DECIMAL}).sort("col_0").to_df()
    assert df.columns.tolist() == ["col_0", "col_1", "col_2"]
    assert df["col_1"].tolist() == [2.5, 1000.25] and df["col_2"].tolist() == ["x", None]
    w = tmp_path / "w.txt"
    w.write_text("a  b\n1   2\n3\t4\n")
    assert ctx.read.txt(str(w), delim_whitespace=True).to_df().values.tolist() == [["1", "2"], ["3", "4"]]


def test_json_parquet_pickle(ctx, f, tmp_path):
    f.save.json(f"{tmp_path}/j")
    assert ctx.read.json(f"{tmp_path}/j", schema={"k": DataType.INT}).count_rows() == 3
    f.save.parquet(f"{tmp_path}/p")
    assert ctx.read.parquet(f"{tmp_path}/p", columns=["k"]).columns() == ["k"]
    f.save.pickle(f"{tmp_path}/q")
    assert sorted(ctx.read.pickle(f"{tmp_path}/q").to_df()["k"]) == [1, 2, 3]


def test_shapefile(ctx, tmp_path):
    shapes = [[(0.0, 0.0), (0.0, 2.0), (3.0, 2.0), (0.0, 0.0)], [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 5.0)]]
    body = b""
    for k, pts in enumerate(shapes):
        content = struct.pack("<i4d2ii", 5, 0, 0, 9, 9, 1, len(pts), 0) + b"".join(struct.pack("<2d", *p) for p in pts)
        body += struct.pack(">2i", k + 1, len(content) // 2) + content
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + body)
    field = lambda n, w: n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15
    head = b"\x03" + b"\0" * 3 + struct.pack("<IHH", 2, 32 + 64 + 1, 1 + 4 + 6) + b"\0" * 20
    (tmp_path / "a.dbf").write_bytes(head + field("id", 4) + field("name", 6) + b"\r" + b" 1   north " + b" 2   south ")
    f = ctx.read.shapefile(f"file://{tmp_path}/a.shp", f"{tmp_path}/a.dbf", schema={"id": DataType.INT})
    out = f.sort("id").to_df()
    assert out["name"].tolist() == ["north", "south"]
    assert [list(map(float, p)) for p in out["points"][0]] == [[0, 0], [2, 0], [2, 3], [0, 0]]
    pts = ctx.parallelize(pd.DataFrame({"lat": [1.5, 5.2, 9.0], "lon": [1.0, 5.9, 9.0]}), 1)
    got = pts.geo_within(f, "lat", "lon", attributes=["name"]).sort("lat").to_df()
    assert got["name"].tolist() == ["north", "south", None]
