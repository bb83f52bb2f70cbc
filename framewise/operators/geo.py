"""Geography: points in polygons and reprojection."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.plans.scale import cut, free_name, join_salted

#: Corners of polygons, over all cells, that are broadcast.
POINTS = 2_000_000
#: The WGS 84 ellipsoid and the UTM scale.
A, FLAT, K0 = 6378137.0, 1 / 298.257223563, 0.9996


def _inside(points: Column, lat: Column, lon: Column) -> Column:
    """Ray casting: whether the point lies in the ring of [lat, lon] pairs. A ray that passes a corner counts once."""
    n = F.size(points)

    def crosses(p: Column, i: Column) -> Column:
        q = F.element_at(points, F.when(i == 0, n).otherwise(i))
        y1, x1, y2, x2 = p[0], p[1], q[0], q[1]
        at = (x2 - x1) * F.try_divide(lat - y1, y2 - y1) + x1
        return F.when(((y1 > lat) != (y2 > lat)) & (lon < at), 1).otherwise(0)

    return F.aggregate(F.transform(points, crosses), F.lit(0), lambda a, v: a + v) % 2 == 1


def geo_within(df: DataFrame, shapes: DataFrame, lat_col: str, lon_col: str, polygon: str = "points", attributes: Sequence[str] | None = None, suffix: str = "_shp", cells: int = 64) -> DataFrame:
    """Points with the attributes of the first polygon that holds them; nulls where none does.

    Every polygon is spread over the cells of a grid that its bounding box touches, a point falls into
    one cell, and the two meet in an equi-join on the cell (broadcast up to ``POINTS`` corners in all, else salted), so
    a point is tested against the few polygons near it, and isn't shuffled where the polygons are few. "First" is by
    the shapes' order. Of a polygon's border, what lies to the lesser latitude and longitude belongs to it.
    """
    taken = set(df.columns)
    names = [c for c in (attributes if attributes is not None else shapes.columns) if c in shapes.columns and c != polygon]
    rid, lat, lon = free_name("__fw_rid", df.columns), F.col(f"`{lat_col}`").cast("double"), F.col(f"`{lon_col}`").cast("double")
    s = shapes.select(F.monotonically_increasing_id().alias("__fw_pid"), F.col(f"`{polygon}`").alias("__fw_pts"), *[F.col(f"`{c}`").alias(f"__fw_a{i}") for i, c in enumerate(names)])
    lats, lons = F.transform("__fw_pts", lambda p: p[0]), F.transform("__fw_pts", lambda p: p[1])
    s = cut(s.where(F.size("__fw_pts") > 2).withColumns({"__fw_y0": F.array_min(lats), "__fw_y1": F.array_max(lats), "__fw_x0": F.array_min(lons), "__fw_x1": F.array_max(lons)}))
    box = s.agg(F.min("__fw_y0"), F.max("__fw_y1"), F.min("__fw_x0"), F.max("__fw_x1")).first()
    outs = [(f"__fw_a{i}", free_name(c + suffix if c in taken else c, df.columns)) for i, c in enumerate(names)]
    if box[0] is None:
        return df.select("*", *[F.lit(None).cast(shapes.schema[c].dataType).alias(o) for c, (_, o) in zip(names, outs)])
    height, width = (box[1] - box[0]) / cells or 1.0, (box[3] - box[2]) / cells or 1.0
    row = lambda y: F.floor((y - F.lit(box[0])) / F.lit(height)).cast("int")
    column = lambda x: F.floor((x - F.lit(box[2])) / F.lit(width)).cast("int")
    spread = s.withColumn("__fw_r", F.explode(F.sequence(row(F.col("__fw_y0")), row(F.col("__fw_y1"))))).withColumn("__fw_c", F.explode(F.sequence(column(F.col("__fw_x0")), column(F.col("__fw_x1")))))
    # One row a cell with its polygons in order: a point meets one row, so it is neither repeated nor grouped again.
    inside = F.struct("__fw_pid", "__fw_y0", "__fw_y1", "__fw_x0", "__fw_x1", "__fw_pts", *[a for a, _ in outs])
    table = cut(spread.groupBy("__fw_r", "__fw_c").agg(F.sort_array(F.collect_list(inside)).alias("__fw_s")))  # as many as the polygons over a cell
    weight = table.agg(F.sum(F.aggregate("__fw_s", F.lit(0), lambda n, p: n + F.size(p["__fw_pts"])))).first()[0]
    points = df.withColumns({rid: lat, "__fw_lon": lon, "__fw_r": row(lat), "__fw_c": column(lon)})
    near = points.join(F.broadcast(table), ["__fw_r", "__fw_c"], "left") if weight <= POINTS else join_salted(points, table, ["__fw_r", "__fw_c"])

    def hit(p: Column) -> Column:
        y, x = F.col(rid), F.col("__fw_lon")
        return (y >= p["__fw_y0"]) & (y <= p["__fw_y1"]) & (x >= p["__fw_x0"]) & (x <= p["__fw_x1"]) & _inside(p["__fw_pts"], y, x)

    found = near.withColumn("__fw_f", F.get(F.filter("__fw_s", hit), F.lit(0)))
    return found.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col("__fw_f")[a].alias(o) for a, o in outs])


def _utm(zone_code: int) -> tuple[float, float]:
    """(central meridian in radians, false northing) of EPSG 326zz / 327zz."""
    return math.radians((zone_code % 100) * 6 - 183), 10_000_000.0 if zone_code // 100 == 327 else 0.0


def _series() -> tuple[float, list[float], list[float]]:
    """Krueger's series to the third power: rectifying radius, alphas, betas."""
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return radius, alpha, beta


def _to_geographic(y: Column, x: Column, epsg: int) -> tuple[Column, Column]:
    """(latitude, longitude) in degrees of (north, east) coordinates."""
    if epsg in (4326, 4674):
        return y, x
    if epsg in (3857, 900913):
        return F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2), F.degrees(x / A)
    if epsg // 100 in (326, 327) and 1 <= epsg % 100 <= 60:
        radius, _, beta = _series()
        lon0, north = _utm(epsg)
        xi, eta = (y - north) / (K0 * radius), (x - 500_000.0) / (K0 * radius)
        xi1, eta1 = xi, eta
        for j, b in enumerate(beta, 1):
            xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        chi = F.asin(F.sin(xi1) / F.cosh(eta1))
        e = math.sqrt(FLAT * (2 - FLAT))
        # Conformal to geodetic latitude: three fixed-point steps reach rounding error.
        lat, t = chi, F.atanh(F.sin(chi))
        for _ in range(4):
            lat = F.asin(F.tanh(t + e * F.atanh(e * F.sin(lat))))
        return F.degrees(lat), F.degrees(F.lit(lon0) + F.atan2(F.sinh(eta1), F.cos(xi1)))
    raise ValueError(f"EPSG:{epsg} isn't supported: 4326, 4674, 3857, and UTM 326zz/327zz are")


def _from_geographic(lat: Column, lon: Column, epsg: int) -> tuple[Column, Column]:
    if epsg in (4326, 4674):
        return lat, lon
    if epsg in (3857, 900913):
        return F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * A, F.radians(lon) * A
    if epsg // 100 in (326, 327) and 1 <= epsg % 100 <= 60:
        radius, alpha, _ = _series()
        lon0, north = _utm(epsg)
        e = math.sqrt(FLAT * (2 - FLAT))
        s = F.sin(F.radians(lat))
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
        dlon = F.radians(lon) - lon0
        xi, eta = F.atan2(t, F.cos(dlon)), F.atanh(F.sin(dlon) / F.sqrt(1 + t * t))
        x, y = eta, xi
        for j, a in enumerate(alpha, 1):
            x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return K0 * radius * y + north, 500_000.0 + K0 * radius * x
    raise ValueError(f"EPSG:{epsg} isn't supported: 4326, 4674, 3857, and UTM 326zz/327zz are")


def crst_transform(df: DataFrame, lat_col: str, lon_col: str, src_epsg: int, dst_epsg: int, lat_alias: str | None = None, lon_alias: str | None = None) -> DataFrame:
    """Coordinates from one reference system to another, in place unless aliases are given; closed-form columns.

    Latitude stands for the northing, longitude for the easting of projected systems. SIRGAS 2000 (4674)
    is taken as WGS 84. UTM is within a millimetre inside its zone.
    """
    lat, lon = _to_geographic(F.col(f"`{lat_col}`").cast("double"), F.col(f"`{lon_col}`").cast("double"), int(src_epsg))
    mid = df.withColumns({"__fw_lat": lat, "__fw_lon": lon})
    y, x = _from_geographic(F.col("__fw_lat"), F.col("__fw_lon"), int(dst_epsg))
    return mid.withColumns({lat_alias or lat_col: y, lon_alias or lon_col: x}).drop("__fw_lat", "__fw_lon")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere of 6,371 km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6_371_000.0 * F.asin(F.least(F.sqrt(a), F.lit(1.0)))
