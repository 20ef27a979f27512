"""Tables of profiles, horizons and classes: filters, reshaping, summaries, contingency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pedolith.functions.algebra import strict_sum


def complete_cases(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows without null in the columns (all by default); NaN counts as null."""
    return df.dropna(how="any", subset=cols)


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold any null."""
    n = null_counts(df).first()
    return df.select(*[c for c in df.columns if n[c] == 0])


def min_support(df: DataFrame, group: str, least: int) -> DataFrame:
    """Rows whose group has at least `least` rows: groups are counted, then semi-joined (no hot window)."""
    return df.join(df.groupBy(group).count().where(F.col("count") >= least).select(group), group, "left_semi")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One number: rows that have an equal."""
    return df.groupBy(*df.columns).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicates"))


def any_horizon(site: DataFrame, horizon: DataFrame, key: str, condition: Column) -> DataFrame:
    """Sites of which some horizon meets the condition."""
    return site.join(horizon.where(condition).select(key), key, "left_semi")


def numeric_variables(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns that hold some value other than 0 and null: one aggregate over all."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]
    found = df.agg(*[F.count_if(F.col(c) != 0).alias(c) for c in cols]).first()
    return [c for c in cols if found[c] > 0]


def melt(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(ids, values, "variable", "value")


def cast_wide(df: DataFrame, ids: list[str], variables: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*ids).pivot("variable", variables).agg(F.first(value))


def range_summary(df: DataFrame, groups: list[str], values: list[str], probs: tuple[float, ...] = (0.0, 0.5, 1.0), digits: int = 6) -> DataFrame:
    """Quantiles and n of each variable in each group, and the range as text: the melt is a map-side expand, one
    shuffle groups by (group, variable)."""
    long = melt(df.select(*groups, *[F.col(v).cast("double").alias(v) for v in values]), groups, values).where("value is not null")
    q = F.percentile("value", F.array(*[F.lit(p) for p in probs]))
    out = long.groupBy(*groups, "variable").agg(q.alias("q"), F.count("*").alias("n"))
    named = [F.round(F.col("q")[i], digits).alias(f"p{round(p * 100)}") for i, p in enumerate(probs)]
    return out.select(*groups, "variable", *named, "n")


def range_text(summary: DataFrame, cols: list[str]) -> DataFrame:
    """The summary with its numbers as one text, `min - median - max (n)`."""
    parts = [F.format_number(F.col(c), 1) for c in cols]
    return summary.withColumn("range", F.concat(F.concat_ws(" - ", *parts), F.lit(" ("), F.col("n").cast("string"), F.lit(")")))


def frequency(df: DataFrame, col: str) -> DataFrame:
    """Counts of the values that are not null."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))


def contingency_margins(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by (a, b) with the margins as 'Sum': the pairs are counted first, then cubed, so that the expansion
    is of groups and not of rows."""
    pairs = contingency(df, a, b).select(F.col(a).cast("string").alias(a), F.col(b).cast("string").alias(b), "n")
    c = pairs.cube(a, b).agg(F.sum("n").alias("n"), F.grouping(a).alias("ga"), F.grouping(b).alias("gb"))
    return c.select(F.when(F.col("ga") == 1, "Sum").otherwise(F.col(a)).alias(a), F.when(F.col("gb") == 1, "Sum").otherwise(F.col(b)).alias(b), "n")


def group_median_order(df: DataFrame, group: str, value: Column) -> DataFrame:
    """Groups by their median, with their place."""
    g = df.groupBy(group).agg(F.median(value).alias("median_value"))
    return g.withColumn("place", F.row_number().over(Window.orderBy("median_value", group)))


def thickness(horizon: DataFrame, keys: list[str], top: str, bottom: str) -> DataFrame:
    """Summed thickness by key; null if any depth is."""
    return horizon.groupBy(*keys).agg(strict_sum(F.col(bottom) - F.col(top)).alias("thickness"))


def midpoint(top: Column, bottom: Column) -> Column:
    return (top + bottom) / 2


def transitions(df: DataFrame, profile: str, order: list[str], label: str) -> DataFrame:
    """Shares of the labels directly below each label, within profiles; the window is within one profile."""
    below = F.lead(label).over(Window.partitionBy(profile).orderBy(*order))
    t = df.select(F.col(label).alias("upper"), below.alias("lower")).where("upper is not null and lower is not null")
    t = t.groupBy("upper", "lower").agg(F.count("*").alias("n"))
    return t.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("upper")))


def running_before(df: DataFrame, bucket: Column, order: list[str], value: Column, name: str, by: list[str] | None = None) -> DataFrame:
    """df with `name`: the sum of `value` over the rows before in `order`, within the groups `by`, 0 for the first.

    `bucket` must not fall as `order` rises. The window runs inside a bucket; what lies in the buckets
    before comes from one total a bucket, so no task holds a whole group. Rows equal in all of
    `order` are taken in any order."""
    by = list(by or [])
    b = df.withColumns({"_bucket": bucket, "_value": value})
    before = lambda *within: Window.partitionBy(*within).rowsBetween(Window.unboundedPreceding, -1)
    totals = b.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_sum"))
    totals = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(before(*by).orderBy("_bucket")), F.lit(0))).drop("_sum")
    totals = totals.withColumnsRenamed({c: f"_t_{i}" for i, c in enumerate([*by, "_bucket"])})
    inside = b.withColumn("_inside", F.coalesce(F.sum("_value").over(before(*by, "_bucket").orderBy(*order)), F.lit(0)))
    same = F.lit(True)
    for i, c in enumerate([*by, "_bucket"]):
        same = same & F.col(c).eqNullSafe(F.col(f"_t_{i}"))
    return inside.join(totals, same).withColumn(name, F.col("_before") + F.col("_inside")).select(*df.columns, name)


def quantile_bucket(df: DataFrame, column: str, parts: int = 64) -> Column:
    """The bucket, 0 to parts - 1, of a number or time between approximate quantiles of the column; null and the
    lowest in bucket 0. Any bounds give right results, good ones even buckets."""
    found = df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10_000).alias("q")).first().q
    if not found:
        return F.lit(0)
    bounds = F.array(*[F.lit(x) for x in sorted(set(found))])
    return F.coalesce(F.size(F.filter(bounds, lambda x: x < F.col(column))), F.lit(0))


def numbered(df: DataFrame, column: str, name: str = "number") -> DataFrame:
    """df with the place of each row, from 1, in order of a number or time; buckets between quantiles, so that no
    task sorts the whole table."""
    return running_before(df, quantile_bucket(df, column), [column], F.lit(1).cast("long"), name).withColumn(name, F.col(name) + 1)


def paged(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """A small report with its page numbers."""
    return df.withColumn("page", F.ceil(F.row_number().over(Window.orderBy(*order)) / size).cast("int"))


def share(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return df.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(*(by or []))))


def level_table(df: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(ID int, label) in order of ID."""
    return df.select(F.col(id_col).cast("int").alias("ID"), F.col(label_col).cast("string").alias("label")).orderBy("ID")


def match_levels(keys: list[str], names: list[str]) -> dict[str, str | None]:
    """Level tables to bands by name, else by the only name that contains the key, else none."""
    out: dict[str, str | None] = {}
    for k in keys:
        inside = [n for n in names if k in n]
        out[k] = k if k in names else inside[0] if len(inside) == 1 else None
    return out


def reversed_levels(df: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(label, place): the levels in the reverse of their order."""
    return df.select(label_col, F.row_number().over(Window.orderBy(F.desc(id_col))).alias("place"))


def depth_weighted(horizon: DataFrame, key: str, value: str, upper: float, lower: float, top: str = "top", bottom: str = "bottom") -> DataFrame:
    """The mean of a value between two depths, weighted by the thickness that lies between them."""
    inside = F.greatest(F.lit(0.0), F.least(F.col(bottom), F.lit(lower)) - F.greatest(F.col(top), F.lit(upper)))
    g = horizon.withColumn("_in", inside).groupBy(key).agg(F.sum(F.col(value) * F.col("_in")).alias("_v"), F.sum(F.when(F.col(value).isNotNull(), F.col("_in"))).alias("_t"))
    return g.where("_t > 0").select(key, (F.col("_v") / F.col("_t")).alias(value))


def with_lab(horizon: DataFrame, lab: DataFrame, key: str, measured: str) -> DataFrame:
    """Horizons with what the laboratory measured, all of them, and whether it did (`has_lab`)."""
    return horizon.join(lab, key, "left").withColumn("has_lab", F.col(measured).isNotNull())
