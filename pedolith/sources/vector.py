"""Shapefiles as tables and back, polygons as cells of a grid, and coordinates in another system."""

from __future__ import annotations

import math
import struct

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pedolith.grid import GridSpec

POINT, LINE, POLYGON = 1, 3, 5


def parse_shapes(data: bytes) -> list[tuple[int, list[list[tuple[float, float]]]]]:
    """(type, parts) of each record of a .shp file; a point is one part of one vertex, a null shape none."""
    out, at = [], 100
    while at + 8 <= len(data):
        size = 2 * struct.unpack_from(">I", data, at + 4)[0]
        kind = struct.unpack_from("<i", data, at + 8)[0] % 10
        body = at + 12
        if kind == POINT:
            out.append((kind, [[struct.unpack_from("<dd", data, body)]]))
        elif kind in (LINE, POLYGON):
            n_parts, n = struct.unpack_from("<ii", data, body + 32)
            first = [*struct.unpack_from(f"<{n_parts}i", data, body + 40), n]
            xy = np.frombuffer(data, "<f8", 2 * n, body + 40 + 4 * n_parts).reshape(n, 2)
            out.append((kind, [[(float(x), float(y)) for x, y in xy[a:b]] for a, b in zip(first, first[1:])]))
        else:
            out.append((0, []))
        at += 8 + size
    return out


def parse_attributes(data: bytes) -> list[dict[str, str | None]]:
    """The records of a .dbf file as text, blank fields as none, deleted records left out."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    out = []
    for k in range(n):
        where = head + k * size + 1
        row = {}
        for name, width in fields:
            row[name] = data[where : where + width].decode("utf-8", "replace").strip() or None
            where += width
        if data[head + k * size : head + k * size + 1] != b"*":
            out.append(row)
    return out


SHAPES = "file string, id long, kind int, attributes map<string,string>, parts array<array<struct<x:double,y:double>>>"


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """The shapes of one file (path without suffix) or of a directory: SHAPES. A file is read by one task."""
    one = path.removesuffix(".shp")
    glob = f"{one}.*" if path.endswith(".shp") else f"{path.rstrip('/')}/*"
    files = spark.read.format("binaryFile").load(glob).where(F.lower("path").rlike(r"[.](shp|dbf)$"))
    files = files.select(F.regexp_replace("path", r"[.][^.]*$", "").alias("file"), F.lower(F.regexp_extract("path", r"[.]([^.]*)$", 1)).alias("suffix"), "content")

    def run(key, pdf):
        import pandas as pd

        of = dict(zip(pdf["suffix"], pdf["content"], strict=True))
        shapes, rows = parse_shapes(of["shp"]), parse_attributes(of["dbf"]) if "dbf" in of else []
        rows += [{}] * (len(shapes) - len(rows))
        return pd.DataFrame({"file": key[0], "id": np.arange(len(shapes)), "kind": [k for k, _ in shapes], "attributes": rows[: len(shapes)], "parts": [[[{"x": x, "y": y} for x, y in p] for p in parts] for _, parts in shapes]})

    return files.groupBy("file").applyInPandas(run, SHAPES)


def points_files(points: list[tuple[float, float]], rows: list[dict]) -> dict[str, bytes]:
    """The .shp, .shx and .dbf of points and their attributes, as text fields."""
    xs, ys = [p[0] for p in points] or [0.0], [p[1] for p in points] or [0.0]
    head = lambda size: struct.pack(">iiiiiii", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<ii8d", 1000, POINT, min(xs), min(ys), max(xs), max(ys), 0, 0, 0, 0)
    shp = b"".join(struct.pack(">ii", i + 1, 10) + struct.pack("<idd", POINT, x, y) for i, (x, y) in enumerate(points))
    shx = b"".join(struct.pack(">ii", 50 + 14 * i, 10) for i in range(len(points)))
    return {"shp": head(100 + len(shp)) + shp, "shx": head(100 + len(shx)) + shx, "dbf": attribute_table(rows)}


def attribute_table(rows: list[dict]) -> bytes:
    """A .dbf file of text fields, names cut to ten characters."""
    names = list(rows[0]) if rows else []
    text = [["" if r[n] is None else str(r[n]) for n in names] for r in rows]
    width = [min(254, max([1, *(len(t[k].encode()) for t in text)])) for k in range(len(names))]
    head = struct.pack("<BBBBIHH20x", 3, 100, 1, 1, len(rows), 33 + 32 * len(names), 1 + sum(width))
    fields = b"".join(struct.pack("<11sc4xBB14x", n.encode()[:10], b"C", w, 0) for n, w in zip(names, width, strict=True))
    body = b"".join(b" " + b"".join(t[k].encode()[:w].ljust(w) for k, w in enumerate(width)) for t in text)
    return head + fields + b"\x0d" + body + b"\x1a"


def write_points(points: DataFrame, path: str, name: str, most: int = 1_000_000) -> None:
    """points(x, y, ...) of a design as a shapefile; more than `most` of them are an error, not a cut."""
    from pedolith.sources.geotiff import save_files

    rows = [r.asDict() for r in points.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} points: write them as Parquet")
    files = points_files([(float(r["x"]), float(r["y"])) for r in rows], [{k: v for k, v in r.items() if k not in ("x", "y")} or {"id": i} for i, r in enumerate(rows)])
    save_files(points.sparkSession.createDataFrame([(f"{name}.{s}", b) for s, b in files.items()], "name string, content binary"), path)


def polygon_cells(shapes: DataFrame, grid: GridSpec, zone: str = "id") -> DataFrame:
    """(zone, cell_id) of the cells whose centre a polygon holds, holes left out (even-odd rule): a scan line a row
    of the grid, so rows come out as cells do."""

    def run(it):
        import pyarrow as pa

        for batch in it:
            for z, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                edges = [(a["x"], a["y"], b["x"], b["y"]) for p in parts for a, b in zip(p, [*p[1:], p[0]], strict=True)]
                if not edges:
                    continue
                x0, y0, x1, y1 = np.array(edges, float).T
                top, bottom = max(y0.max(), y1.max()), min(y0.min(), y1.min())
                first, last = max(0, math.floor((grid.ymax - top) / grid.res)), min(grid.nrow - 1, math.floor((grid.ymax - bottom) / grid.res))
                for r in range(first, last + 1):
                    y = grid.ymax - (r + 0.5) * grid.res
                    cut = (y0 > y) != (y1 > y)
                    xs = np.sort(x0[cut] + (y - y0[cut]) / (y1[cut] - y0[cut]) * (x1[cut] - x0[cut]))
                    cols = [np.arange(max(0, math.ceil((a - grid.xmin) / grid.res - 0.5)), min(grid.ncol, math.ceil((b - grid.xmin) / grid.res - 0.5))) for a, b in zip(xs[::2], xs[1::2], strict=False)]
                    if cols and sum(map(len, cols)):
                        ids = pa.array(r * grid.ncol + np.concatenate(cols), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array([z] * len(ids), batch.schema.field(0).type), ids], names=[zone, "cell_id"])

    return shapes.select(zone, "parts").mapInArrow(run, f"`{zone}` {dict(shapes.dtypes)[zone]}, cell_id long")


#: Fixed values of the WGS 84 ellipsoid and of UTM.
AXIS, FLATTENING, UTM_SCALE, UTM_EAST, UTM_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def to_utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing of degrees in a UTM zone, by Krueger's series: native expressions."""
    c = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    atanh = lambda x: F.ln((1 + x) / (1 - x)) / 2
    t = F.sinh(atanh(F.sin(phi)) - c * atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_FORWARD, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return UTM_EAST + UTM_SCALE * _RADIUS * east, (UTM_NORTH if south else 0.0) + UTM_SCALE * _RADIUS * north


def from_utm(east: Column, north: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a UTM zone's coordinates."""
    xi, eta = (north - (UTM_NORTH if south else 0.0)) / (UTM_SCALE * _RADIUS), (east - UTM_EAST) / (UTM_SCALE * _RADIUS)
    x, y = xi, eta
    for j, b in enumerate(_BACK, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for j, d in enumerate(_LATITUDE, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(y), F.cos(x))) + (6 * zone - 183), F.degrees(lat)
