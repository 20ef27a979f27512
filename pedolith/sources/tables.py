"""Sources and sinks: cell tables, tiles, pyramids, attribute tables, profiles, reports."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pedolith.functions.algebra import to_storage


def read_cells(spark: SparkSession, path: str, bands: list[str] | None = None, pattern: str = "*.parquet") -> DataFrame:
    """A cell table, or a directory of them; only the bands asked for are read. NaN becomes null."""
    df = spark.read.option("pathGlobFilter", pattern).parquet(path) if not path.endswith(".parquet") else spark.read.parquet(path)
    if bands is not None:
        df = df.select("cell_id", *bands)
    return df.withColumns({f.name: F.nanvl(F.col(f.name), F.lit(None)) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def read_points_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Points or laboratory rows from delimited text under a schema that is given, not inferred."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def read_profiles(spark: SparkSession, url: str, properties: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """site, horizon and diagnostic tables of a profile database over JDBC."""
    return {t: spark.read.jdbc(url, t, properties=properties or {}) for t in ("site", "horizon", "diagnostic")}


def list_layers(spark: SparkSession, path: str, suffix: str = "parquet") -> list[str]:
    """Files of a directory with the suffix, by the store's own listing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(where) if s.getPath().getName().endswith("." + suffix))


def matrix_cells(spark: SparkSession, values: list[list[float]], flip: bool = False, name: str = "value") -> DataFrame:
    """A small matrix as cells (cell_id, row, col, value); flip turns it upside down."""
    nrow, ncol = len(values), len(values[0])
    rows = [((nrow - 1 - r if flip else r) * ncol + c, nrow - 1 - r if flip else r, c, float(v)) for r, line in enumerate(values) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, f"cell_id long, row long, col long, `{name}` double")


@dataclass
class Rules:
    """Ordered (label, regex) rules as a table or as text lines `label<TAB>regex`."""

    rules: list[tuple[str, str]]

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Rules:
        rows = spark.read.schema("priority int, label string, pattern string").option("header", True).csv(path).orderBy("priority").collect()
        return cls([(r.label, r.pattern) for r in rows])


def fetch(get, tries: int = 3, wait: float = 4.0, sleep=time.sleep):
    """get() with a bounded number of tries; the last error is raised."""
    for i in range(tries):
        try:
            return get()
        except OSError:
            if i == tries - 1:
                raise
            sleep(wait)


# --- sinks -----------------------------------------------------------------------------------


def write_cells(df: DataFrame, path: str, kinds: dict[str, str] | None = None) -> None:
    """A cell table, bands cast into storage types first."""
    df.withColumns({c: to_storage(F.col(c), k) for c, k in (kinds or {}).items()}).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_tiles(df: DataFrame, path: str, tile: str = "tile_id") -> None:
    """One directory per tile; reading the directory is the mosaic, and a filter on the tile prunes."""
    df.repartition(tile).write.mode("overwrite").partitionBy(tile).option("compression", "zstd").parquet(path)


def write_bands(df: DataFrame, path: str, bands: list[str], key: str = "cell_id") -> None:
    """One directory per band."""
    df.unpivot([key], bands, "band", "value").write.mode("overwrite").partitionBy("band").parquet(path)


def write_text(df: DataFrame, path: str, sep: str = ",") -> None:
    """A small table as one delimited file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def named_bands(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Bands renamed, the old name kept as the column's comment."""
    return df.select(*[F.col(c).alias(names[c], metadata={"comment": c}) if c in names else F.col(c) for c in df.columns])


def write_manifest(spark: SparkSession, path: str, seed: int, seconds: float, **more) -> None:
    spark.createDataFrame([(seed, float(seconds), json.dumps(more, sort_keys=True))], "seed long, seconds double, details string").write.mode("overwrite").parquet(path)


def markdown(df: DataFrame, rows: int = 100) -> str:
    """A report table as text: at most `rows` rows."""
    text = lambda v: "" if v is None else f"{v:g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(text(v) for v in r) + " |" for r in df.limit(rows).collect()])
