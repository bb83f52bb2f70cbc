"""A Spark data source for ESRI shapefiles (.shp geometry with its .dbf attribute table)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Records of a file that one task reads.
RECORDS = 20_000


def _bytes(path: str, start: int = 0, size: int | None = None) -> bytes:
    from pyarrow import fs

    if path.startswith("file:"):
        path = path.removeprefix("file://").removeprefix("file:")
    system, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_file(where) as f:
        f.seek(start)
        return f.read(size) if size is not None else f.read()


def dbf_fields(head: bytes) -> tuple[int, int, int, list[tuple[str, int]]]:
    """(records, header size, record size, [(name, width)]) of an attribute table."""
    n, header, record = struct.unpack("<IHH", head[4:12])
    fields, at = [], 32
    while at < header - 1 and head[at] != 0x0D:
        fields.append((head[at : at + 11].split(b"\0")[0].decode("latin-1"), head[at + 16]))
        at += 32
    return n, header, record, fields


def shape_points(content: bytes) -> list[tuple[float, float]]:
    """(x, y) of a record: point, multipoint, polyline or polygon, with or without z and m; null shapes have none."""
    kind = struct.unpack("<i", content[:4])[0]
    if kind in (1, 11, 21):
        return [struct.unpack("<2d", content[4:20])]
    if kind in (8, 18, 28):
        n = struct.unpack("<i", content[36:40])[0]
        at = 40
    elif kind in (3, 5, 13, 15, 23, 25):
        parts, n = struct.unpack("<2i", content[36:44])
        at = 44 + 4 * parts
    else:
        return []
    flat = struct.unpack(f"<{2 * n}d", content[at : at + 16 * n])
    return list(zip(flat[::2], flat[1::2]))


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framewise_shapefile"

    def schema(self) -> T.StructType:
        head = _bytes(self.options["dbf"], 0, 32)
        header = struct.unpack("<H", head[8:10])[0]
        fields = dbf_fields(_bytes(self.options["dbf"], 0, header))[3]
        points = T.ArrayType(T.ArrayType(T.DoubleType()))
        return T.StructType([*[T.StructField(n, T.StringType()) for n, _ in fields], T.StructField(self.options.get("polygon", "points"), points)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ShapefileReader(dict(self.options))


class ShapefileReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """Runs of records, found by the record headers alone."""
        shp = _bytes(self.options["shp"])
        at, starts = 100, []
        while at + 8 <= len(shp):
            starts.append(at)
            at += 8 + 2 * struct.unpack(">i", shp[at + 4 : at + 8])[0]
        ends = [*starts[1:], len(shp)]
        return [InputPartition((k, min(k + RECORDS, len(starts)), starts[k], ends[min(k + RECORDS, len(starts)) - 1])) for k in range(0, len(starts), RECORDS)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        first, last, start, end = partition.value
        head = _bytes(self.options["dbf"], 0, 32)
        header, record = struct.unpack("<HH", head[8:12])
        fields = dbf_fields(_bytes(self.options["dbf"], 0, header))[3]
        shapes = _bytes(self.options["shp"], start, end - start)
        rows = _bytes(self.options["dbf"], header + first * record, (last - first) * record)
        lat_first = str(self.options.get("lat_first", "True")).lower() == "true"
        at = 0
        for k in range(last - first):
            size = 2 * struct.unpack(">i", shapes[at + 4 : at + 8])[0]
            points = [[y, x] if lat_first else [x, y] for x, y in shape_points(shapes[at + 8 : at + 8 + size])]
            at += 8 + size
            values, place = [], k * record + 1
            for _, width in fields:
                text = rows[place : place + width].decode("latin-1").strip(" \0")
                values.append(text or None)
                place += width
            yield (*values, points)
