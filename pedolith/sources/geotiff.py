"""GeoTIFF files as cell tables and back: baseline TIFF in strips or tiles, plain or deflated."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from pedolith.grid import GridSpec

#: TIFF field types: struct letter by number.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
#: Fixed tag numbers of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_COUNTS, FORMAT, SCALE, TIE, NODATA = 317, 322, 323, 324, 325, 339, 33550, 33922, 42113


def _tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    end = {b"II": "<", b"MM": ">"}[data[:2]]
    magic, at = struct.unpack_from(end + "HI", data, 2)
    if magic != 42:
        raise ValueError("not a classic TIFF file")
    tags = {}
    for k in range(struct.unpack_from(end + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(end + "HHI", data, at + 2 + 12 * k)
        letter = _TYPES.get(kind)
        if letter is None:
            continue
        size = n * struct.calcsize(end + letter)
        where = at + 2 + 12 * k + 8
        if size > 4:
            where = struct.unpack_from(end + "I", data, where)[0]
        tags[tag] = (data[where : where + n].rstrip(b"\0"),) if kind == 2 else struct.unpack_from(end + letter * n, data, where)
    return end, tags


def grid_of(data: bytes, crs: str = "") -> GridSpec:
    """The grid of a north-up file; one without a place stands at 0, 0 with cells of 1."""
    _, t = _tags(data)
    nrow, ncol = t[HEIGHT][0], t[WIDTH][0]
    scale, tie = t.get(SCALE, (1.0, 1.0, 0.0)), t.get(TIE, (0.0, 0.0, 0.0, 0.0, float(nrow), 0.0))
    return GridSpec(nrow, ncol, tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], crs)


def decode(data: bytes) -> np.ndarray:
    """(band, row, col) as floats, no-data values as NaN."""
    end, t = _tags(data)
    nrow, ncol, samples = t[HEIGHT][0], t[WIDTH][0], t.get(SAMPLES, (1,))[0]
    kind = {1: "u", 2: "i", 3: "f"}[t.get(FORMAT, (1,))[0]]
    dtype = np.dtype(f"{end}{kind}{t.get(BITS, (8,))[0] // 8}")
    packed, predictor, planar = t.get(COMPRESSION, (1,))[0], t.get(PREDICTOR, (1,))[0], t.get(PLANAR, (1,))[0]
    if packed not in (1, 8, 32946) or predictor not in (1, 2):
        raise ValueError(f"compression {packed} with predictor {predictor} is not read")
    if TILES in t:
        height, width, offsets, counts = t[TILE_HEIGHT][0], t[TILE_WIDTH][0], t[TILES], t[TILE_COUNTS]
    else:
        height, width, offsets, counts = min(t.get(ROWS, (nrow,))[0], nrow), ncol, t[STRIPS], t[COUNTS]
    down, across = -(-nrow // height), -(-ncol // width)
    inner, planes = (samples, 1) if planar == 1 else (1, samples)
    out = np.full((samples, down * height, across * width), np.nan)
    for k, (at, n) in enumerate(zip(offsets, counts, strict=True)):
        raw = data[at : at + n] if packed == 1 else zlib.decompress(data[at : at + n])
        plane, block = divmod(k, down * across)
        r, c = divmod(block, across)
        rows = len(raw) // (width * inner * dtype.itemsize)
        x = np.frombuffer(raw, dtype, rows * width * inner).reshape(rows, width, inner)
        if predictor == 2:
            x = np.cumsum(x, axis=1, dtype=dtype)
        bands = slice(None) if planar == 1 else slice(plane, plane + 1)
        out[bands, r * height : r * height + rows, c * width : (c + 1) * width] = x.transpose(2, 0, 1)
    out = out[:, :nrow, :ncol]
    if NODATA in t:
        out[out == float(t[NODATA][0])] = np.nan
    return out


def encode(bands: np.ndarray, grid: GridSpec, dtype: str = "f4", nodata: float = -9999.0, deflate: bool = True) -> bytes:
    """(band, row, col) as a little-endian file, a strip a band, NaN as `nodata`."""
    x = np.where(np.isnan(bands), nodata, bands).astype("<" + dtype)
    strips = [zlib.compress(b.tobytes()) if deflate else b.tobytes() for b in x]
    n = len(strips)
    mark = f"{nodata:g}".encode() + b"\0"
    fields = [
        (WIDTH, 4, [grid.ncol]), (HEIGHT, 4, [grid.nrow]), (BITS, 3, [x.dtype.itemsize * 8] * n), (COMPRESSION, 3, [8 if deflate else 1]), (PHOTOMETRIC, 3, [1]),
        (STRIPS, 4, [0] * n), (SAMPLES, 3, [n]), (ROWS, 4, [grid.nrow]), (COUNTS, 4, [len(s) for s in strips]), (PLANAR, 3, [2]),
        (FORMAT, 3, [{"u": 1, "i": 2, "f": 3}[x.dtype.kind]] * n), (SCALE, 12, [grid.res, grid.res, 0.0]), (TIE, 12, [0.0, 0.0, 0.0, grid.xmin, grid.ymax, 0.0]), (NODATA, 2, [mark]),
    ]
    start = 8 + 2 + 12 * len(fields) + 4
    pack = lambda kind, v: v[0] if kind == 2 else struct.pack("<" + _TYPES[kind] * len(v), *v)
    size = sum(len(pack(k, v)) for _, k, v in fields if len(pack(k, v)) > 4)
    at = start + size
    for f in fields:
        if f[0] == STRIPS:
            f[2][:] = [at + sum(len(s) for s in strips[:i]) for i in range(n)]
    head, more = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(fields)), b""
    for tag, kind, v in fields:
        body = pack(kind, v)
        count = len(body) if kind == 2 else len(v)
        head += struct.pack("<HHI", tag, kind, count)
        if len(body) > 4:
            head += struct.pack("<I", start + len(more))
            more += body
        else:
            head += body.ljust(4, b"\0")
    return head + struct.pack("<I", 0) + more + b"".join(strips)


def read_geotiff(spark: SparkSession, path: str, names: list[str] | None = None) -> tuple[DataFrame, GridSpec]:
    """The cells (cell_id, row, col, b1.. or `names`) of one file, or of a directory of aligned ones side by side
    in a column `file`, and the grid of the first. A file is read by one task: larger rasters come in tiles."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").load(path) if not path.lower().endswith((".tif", ".tiff")) else spark.read.format("binaryFile").load(path)
    first = files.orderBy("path").select("content").first()[0]
    n = decode(first).shape[0]
    names = names or [f"b{i + 1}" for i in range(n)]

    def run(it):
        import pandas as pd

        for pdf in it:
            for where, data in zip(pdf["path"], pdf["content"], strict=True):
                x = decode(data)
                nrow, ncol = x.shape[1:]
                for lo in range(0, nrow, 256):
                    rows = x[:, lo : lo + 256].reshape(n, -1)
                    cell = np.arange(rows.shape[1]) + lo * ncol
                    part = pd.DataFrame({"file": where, "cell_id": cell, "row": cell // ncol, "col": cell % ncol, **{c: rows[i] for i, c in enumerate(names)}})
                    yield part.astype(object).where(part.notna(), None)

    schema = "file string, cell_id long, row long, col long, " + ", ".join(f"`{c}` double" for c in names)
    return files.select("path", "content").mapInPandas(run, schema), grid_of(first)


def write_geotiff(cells: DataFrame, path: str, grid: GridSpec, bands: list[str], dtype: str = "f4", nodata: float = -9999.0, side: int = 2048) -> int:
    """cells(row, col, bands) as files tile_<row>_<col>.tif of at most `side` cells a side, one written for each tile
    that has cells; their number. Tiles are encoded by the tasks and saved through the driver one by one."""
    from pyspark.sql import functions as F

    down, across = F.floor(F.col("row") / side).cast("long").alias("tr"), F.floor(F.col("col") / side).cast("long").alias("tc")
    rows = cells.select(down, across, "row", "col", *[F.col(b).cast("double").alias(b) for b in bands])

    def one(key, pdf):
        import pandas as pd

        r0, c0 = int(key[0]) * side, int(key[1]) * side
        part = GridSpec(min(side, grid.nrow - r0), min(side, grid.ncol - c0), grid.xmin + c0 * grid.res, grid.ymax - r0 * grid.res, grid.res, grid.crs)
        x = np.full((len(bands), part.nrow, part.ncol), np.nan)
        for i, b in enumerate(bands):
            x[i, pdf["row"] - r0, pdf["col"] - c0] = pdf[b]
        return pd.DataFrame([(f"tile_{key[0]}_{key[1]}.tif", encode(x, part, dtype, nodata))], columns=["name", "content"])

    return save_files(rows.groupBy("tr", "tc").applyInPandas(one, "name string, content binary"), path)


def save_files(files: DataFrame, path: str) -> int:
    """files(name, content) into a directory, one in memory at a time, by the store's own file system."""
    spark = files.sparkSession
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, n = base.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for r in files.toLocalIterator():
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(path, r.name), True)
        out.write(r.content)
        out.close()
        n += 1
    return n
