"""Raster and vector files: round trips, polygons against a point test, coordinates against published values."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pedolith.grid import GridSpec
from pedolith.sources import geotiff, vector


@pytest.mark.parametrize("dtype", ["f4", "f8", "i2", "u1"])
@pytest.mark.parametrize("deflate", [True, False])
def test_geotiff_round_trip(dtype, deflate):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 200, (3, 7, 5)).astype(float)
    x[1, 2, 3] = np.nan
    grid = GridSpec(7, 5, 100.0, 900.0, 30.0)
    data = geotiff.encode(x, grid, dtype, nodata=255 if dtype == "u1" else -999, deflate=deflate)
    assert np.array_equal(geotiff.decode(data), x, equal_nan=True) and geotiff.grid_of(data) == grid


def test_geotiff_tables(spark, tmp_path):
    grid = GridSpec(50, 40, 10.0, 90.0, 2.0)
    cells = spark.range(2000).select(F.col("id").alias("cell_id"), F.floor(F.col("id") / 40).alias("row"), (F.col("id") % 40).alias("col"), (F.col("id") * 1.0).alias("v"), F.when(F.col("id") % 7 > 0, F.col("id") / 2.0).alias("w"))
    assert geotiff.write_geotiff(cells, f"file://{tmp_path}/one", grid, ["v", "w"], "f8") == 1
    back, g = geotiff.read_geotiff(spark, f"file://{tmp_path}/one", ["v", "w"])
    assert g == grid
    assert {(r.cell_id, r.row, r.col, r.v, r.w) for r in back.collect()} == {(r.cell_id, r.row, r.col, r.v, r.w) for r in cells.collect()}
    assert geotiff.write_geotiff(cells, f"file://{tmp_path}/tiles", grid, ["v"], side=16) == 12


def test_shapefile_round_trip_and_polygons(spark, tmp_path):
    points = spark.createDataFrame([(1.5, 2.5, "a", 3), (4.0, -1.0, None, 4)], "x double, y double, name string, n int")
    vector.write_points(points, f"file://{tmp_path}/pts", "sites")
    back = sorted(vector.read_shapefile(spark, f"file://{tmp_path}/pts/sites.shp").collect(), key=lambda r: r.id)
    assert [(r.parts[0][0].x, r.parts[0][0].y, r.attributes["name"], r.attributes["n"]) for r in back] == [(1.5, 2.5, "a", "3"), (4.0, -1.0, None, "4")]
    ring, hole = [(0.0, 0.0), (0.0, 9.0), (12.0, 9.0), (6.0, 4.0), (12.0, 0.0)], [(2.0, 2.0), (4.0, 2.0), (4.0, 6.0), (2.0, 6.0)]
    body = struct.pack("<i4d", 5, 0, 0, 12, 9) + struct.pack("<ii", 2, 9) + struct.pack("<ii", 0, 5) + b"".join(struct.pack("<dd", *p) for p in ring + hole)
    shp = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 0) + bytes(72) + struct.pack(">ii", 1, len(body) // 2) + body
    (tmp_path / "poly").mkdir()
    (tmp_path / "poly" / "p.shp").write_bytes(shp)
    grid = GridSpec(20, 30, -1.0, 10.0, 0.5)
    got = {r.cell_id for r in vector.polygon_cells(vector.read_shapefile(spark, f"file://{tmp_path}/poly"), grid).collect()}

    def inside(x, y):
        odd = False
        for poly in (ring, hole):
            for (x0, y0), (x1, y1) in zip(poly, poly[1:] + poly[:1], strict=True):
                odd ^= (y0 > y) != (y1 > y) and x < x0 + (y - y0) / (y1 - y0) * (x1 - x0)
        return odd

    want = {r * 30 + c for r in range(20) for c in range(30) if inside(-1 + (c + 0.5) * 0.5, 10 - (r + 0.5) * 0.5)}
    assert got == want and len(want) > 50


def test_utm_of_known_places_and_back(spark):
    rows = [(-75.0, 0.0, 500000.0, 0.0), (-73.5, 40.5, 627106.47, 4484335.51), (-77.25, -12.0, None, None)]
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "lon double, lat double")
    e, n = vector.to_utm(F.col("lon"), F.col("lat"), 18)
    df = df.withColumns({"e": e, "n": n})
    lon, lat = vector.from_utm(F.col("e"), F.col("n"), 18)
    out = df.withColumns({"lon2": lon, "lat2": lat}).collect()
    assert all(abs(r.lon - r.lon2) < 1e-8 and abs(r.lat - r.lat2) < 1e-8 for r in out)  # 1 mm
    assert out[0].e == pytest.approx(500000, abs=1e-3) and out[0].n == pytest.approx(0, abs=1e-3)
    # published worked example: 40.5 N, 73.5 W on the ellipsoid of 1866 is 627106.5 E, 4484124.4 N; on this one the northing is 200 m more
    assert out[1].e == pytest.approx(627106.5, abs=15) and out[1].n == pytest.approx(4484330, abs=30)
