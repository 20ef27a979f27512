"""Shared pieces of the training-data operators: durable intermediates, vectorised words, graph components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and \x09-\x0D.
WS = r"[\x20\x09-\x0D]+"
NOT_WS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- durable intermediates -------------------------------------------------------------------


_RUN = f"run-{uuid.uuid4().hex}"


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. A local master (tests) may leave it unset: then one in the
    warehouse; on a cluster that is an error, as a driver's own folder is not the executors'."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def run_dir(spark: SparkSession) -> str:
    """The folder of all that this process keeps, inside work_dir(); scratch() opens one inside it."""
    return "/".join([work_dir(spark).rstrip("/"), _RUN, *_SCRATCH])


_SCRATCH: list[str] = []


@contextmanager
def scratch(spark: SparkSession):
    """What operators keep inside this block lies in one folder, deleted at its end: for callers that write their
    result before it. Without it the files stay in run_dir(), as results are read lazily."""
    _SCRATCH.append(uuid.uuid4().hex)
    path = run_dir(spark)
    try:
        yield path
    finally:
        _SCRATCH.pop()
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: the lineage ends there, and a
    lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def forget(df: DataFrame | None) -> None:
    """Delete what keep() wrote, once nothing reads it any more."""
    path = getattr(df, "_kept_at", None)
    if path:
        _delete(df.sparkSession, path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value, body):
    """body(value) with value evaluated once per row: the lambda's variable binds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Least and most bits of the map that probably_in() sends to every executor: 2 to 32 MB of bits, as a hashed
#: relation of 64-bit words some six times that.
MAP_BITS, MOST_BITS = 1 << 24, 1 << 28


def probably_in(rows: DataFrame, key: str, keys: DataFrame, keys_col: str, negate: bool = False) -> DataFrame:
    """Rows whose key is perhaps among keys (negate: those whose key certainly is not), told where the rows are read.

    A bit map of 16 bits a key, as counted, fewer where that is more than MOST_BITS, is built and broadcast, so that a join that follows
    moves only the rows that may match. Keys for which the largest map would be half full get
    none: all rows may match."""
    bits = MAP_BITS
    while bits < 16 * (n := keys.count()) and bits < MOST_BITS:
        bits *= 2
    if 2 * n > bits:
        return rows.where(F.lit(False)) if negate else rows
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    s, word, map_ = fresh(rows, "slot"), fresh(rows, "_word"), fresh(rows, "_bits")
    bits_of = keys.select(slot(F.col(keys_col)).alias("s")).groupBy((F.col("s") / 64).cast("long").alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias(map_))
    out = rows.withColumn(s, slot(F.col(key)))
    out = out.join(F.broadcast(bits_of), (F.col(s) / 64).cast("long") == F.col(word), "left")
    hit = F.coalesce(F.expr(f"shiftrightunsigned({map_}, cast({s} % 64 as int)) & 1L"), F.lit(0).cast("long")) == 1
    return out.where(~hit if negate else hit).select(*[F.col(f"`{c}`") for c in rows.columns])


#: A key with more than this share of all rows is heavy: fewer than HEAVY keys are, whatever the input.
HEAVY = 1000


def join_few(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows left-joined with groups(*keys, size, ...), one row a key, size the rows that have it.

    Keys with more than a HEAVY-th of all rows, fewer than HEAVY by that, are broadcast, so their rows stay
    where they are; only rows of the others are shuffled, and none of those fills a task."""
    n = rows.count()
    heavy = groups.where(F.col(size) * HEAVY > n)
    light = groups.where(F.col(size) * HEAVY <= n)
    more = [c for c in groups.columns if c not in keys]
    mark = fresh(rows, "_heavy")
    marked = rows.join(F.broadcast(heavy.withColumn(mark, F.lit(True))), keys, "left")
    of_heavy = marked.where(mark).drop(mark)
    rest = marked.where(F.col(mark).isNull()).drop(mark, *more).join(light, keys, "left")
    return of_heavy.select(*rest.columns).unionByName(rest)


# --- words, vectorised over an Arrow string column ---------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FNV = np.uint64(0x100000001B3)
_LONG = 40


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64, bytes) of a string column, nulls as empty; no copy of the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunks(offsets: np.ndarray, most: int):
    """Row ranges of at most `most` bytes of text each, a longer row alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """The words of rows lo..hi: start, end (in buf), doc (row, from 0), per-row first[] positions."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, lo: int, hi: int, lower: bool = True):
        base, stop = int(offsets[lo]), int(offsets[hi])
        raw = data[base:stop]
        self.buf = _LOWER[raw] if lower else raw
        self.offsets = (offsets[lo : hi + 1] - base).astype(np.int64)
        inside = ~_SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[self.offsets] = True
        opens, closes = inside.copy(), inside.copy()
        if len(raw):
            opens[1:] &= ~inside[:-1] | edge[1:-1]
            closes[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(hi - lo), self.count)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.start, self.end)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; spans of any length, the bytes of equal rank hashed together."""
    size = end - start
    order = np.argsort(-np.minimum(size, _LONG + 1), kind="stable")
    at, left = start[order], size[order]
    h = np.full(len(order), 0xCBF29CE484222325, np.uint64)
    for k in range(min(int(left[0]) if len(left) else 0, _LONG)):
        n = int(np.searchsorted(-np.minimum(left, _LONG + 1), -k, "left"))
        h[:n] = (h[:n] ^ buf[at[:n] + k]) * _FNV
    for i in range(int(np.searchsorted(-np.minimum(left, _LONG + 1), -_LONG, "left"))):
        import xxhash

        h[i] = np.uint64(xxhash.xxh64_intdigest(buf[at[i] : at[i] + left[i]].tobytes(), seed=7))
    out = np.empty_like(h)
    out[order] = mix(h ^ left.astype(np.uint64))
    return out


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their rows, sorted by row then hash; a row with fewer words than
    `width` has its whole sequence as the one shingle, a row without words none."""
    w = words.hashes()
    mult = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(w)
    if n >= width:
        h = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            h += w[k : n - width + 1 + k] * mult[k]
        fits = words.doc[: n - width + 1] == words.doc[width - 1 :]
        h, doc = mix(h[fits]), words.doc[: n - width + 1][fits]
    else:
        h, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((words.count > 0) & (words.count < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = words.count[short] > k
            extra[has] += w[words.first[short[has]] + k] * mult[k]
        extra = mix(extra + words.count[short].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        h, doc = np.concatenate([h, extra]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


# --- connected components ---------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): comp is the smallest node reachable over edges (a, b); nodes without edges are absent.

    Alternating large-star and small-star rounds, each a shuffle of the edge list; stars of any size
    are reduced by partial minima, never gathered. Rounds grow with the logarithm of the diameter."""
    e = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        # large star: every larger neighbour of u points at the least of u's neighbourhood
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours point at the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        new = keep(small.select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), "edges")
        sums = [d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for d in (e, new)]
        forget(e)
        e = new
        if sums[0] == sums[1]:
            break
    out = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return out.unionByName(out.select(F.col("comp").alias("node"), "comp").distinct())
