"""Band algebra and scalar functions: native column expressions throughout."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- indices ---------------------------------------------------------------------------------

#: Band pairs (a, b) of the normalised differences (a - b) / (a + b) * 100; fixed values.
ND_PAIRS = {
    "iron_oxide": (3, 1),
    "carbonate": (3, 2),
    "nd_3_7": (3, 7),
    "nd_4_5": (4, 5),
    "nd_5_1": (5, 1),
    "natric": (5, 4),
    "ferrous": (7, 3),
    "clay": (7, 5),
    "calcareous": (5, 2),
    "ndvi": (4, 3),
    "rock": (5, 3),
    "gypsic": (5, 7),
}

#: Tasseled cap of Landsat 7 ETM+ at-satellite reflectance, bands 1-5 and 7; published fixed values.
TASSELED_CAP = {
    "brightness": (0.3561, 0.3972, 0.3904, 0.6966, 0.2286, 0.1596),
    "greenness": (-0.3344, -0.3544, -0.4556, 0.6966, -0.0242, -0.2630),
    "wetness": (0.2626, 0.2141, 0.0926, 0.0656, -0.7629, -0.5388),
}


def nd(a: Column, b: Column, scale: float = 100.0) -> Column:
    """(a - b) / (a + b) * scale; null where a + b is 0 or a band is null."""
    return F.try_divide(a - b, a + b) * scale


def nd_indices(bands: dict[int, Column], pairs: dict[str, tuple[int, int]] = ND_PAIRS, offset: float = 1.0) -> list[Column]:
    """All named indices of one scene for one select; offset is added to each band first."""
    return [nd(bands[a] + offset, bands[b] + offset).alias(name) for name, (a, b) in pairs.items()]


def msavi2(nir: Column, red: Column) -> Column:
    """((2a + 1) - sqrt((2a + 1)^2 - 8(a - b))) / 2; null where the radicand is negative."""
    t = 2 * nir + 1
    radicand = t * t - 8 * (nir - red)
    return (t - F.sqrt(F.when(radicand >= 0, radicand))) / 2


def tasseled_cap(bands: list[Column]) -> list[Column]:
    out = []
    for name, weights in TASSELED_CAP.items():
        total = bands[0] * weights[0]
        for b, w in zip(bands[1:], weights[1:], strict=True):
            total = total + b * w
        out.append(total.alias(name))
    return out


def scene_difference(wet: Column, dry: Column) -> Column:
    return wet - dry


# --- numbers ---------------------------------------------------------------------------------


def logit(x: Column) -> Column:
    """ln(x / (1 - x)); null outside (0, 1)."""
    return F.when((x > 0) & (x < 1), F.ln(x / (1 - x)))


def inverse_logit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def to_null(v: Column) -> Column:
    """NaN as null: done where data enters, so that null is the only missing value."""
    return F.when(~F.isnan(v), v)


def clean_sentinel(v: Column, low: float = -1e20, high: float = 1e20) -> Column:
    """Null for values beyond what a band can hold."""
    return F.when(v.between(low, high), v)


STORAGE = {"INT1U": (0, 255, "smallint"), "INT2S": (-32768, 32767, "smallint"), "INT2U": (0, 65535, "int"), "FLT4S": (None, None, "float")}


def to_storage(v: Column, kind: str) -> Column:
    """Rounded half to even into a storage type; null outside its range."""
    low, high, name = STORAGE[kind]
    if low is None:
        return v.cast(name)
    r = F.bround(v, 0)
    return F.when(r.between(low, high), r).cast(name)


def percent(p: Column) -> Column:
    """A probability as a whole percent."""
    return F.round(p * 100).cast("int")


def arg_max(values: list[Column]) -> Column:
    """1-based place of the greatest value, the first of equal ones; null if all are null."""
    row = F.array(*values)
    return F.array_position(row, F.array_max(row)).cast("int")


def clip_similarity(d: Column, low: Column, high: Column) -> Column:
    """1 - (d - low) / (high - low), not below 0."""
    return 1 - F.least(F.lit(1.0), F.try_divide(d - low, high - low))


def circular_mean(degrees: Column) -> Column:
    """Aggregate: mean direction in [0, 360), null of no values."""
    r = F.radians(degrees)
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))) + 360, F.lit(360.0))


def strict_sum(x: Column) -> Column:
    """Aggregate: null if any value is null."""
    return F.when(F.count("*") == F.count(x), F.sum(x))


# --- classes ---------------------------------------------------------------------------------

#: Upper bounds (exclusive) and labels of the class ladders.
SALINITY = ((2, "nonsaline"), (4, "very slightly saline"), (8, "slightly saline"), (16, "moderately saline"), (None, "strongly saline"))
REACTION = ((6.0, "acid"), (6.5, "slightly acid"), (7.3, "neutral"), (7.9, "slightly alkaline"), (8.4, "moderately alkaline"), (9.0, "strongly alkaline", True), (None, "very strongly alkaline"))


def ladder(v: Column, steps: tuple) -> Column:
    """The label of the first bound above v, or at v where the step says that it is closed; null stays null."""
    out = F
    for bound, label, *closed in steps:
        if bound is None:
            return out.when(v.isNotNull(), F.lit(label))
        out = out.when(v <= bound if closed and closed[0] else v < bound, F.lit(label))
    return out


def salinity_class(ec: Column) -> Column:
    return ladder(ec, SALINITY)


def reaction_class(ph: Column) -> Column:
    return ladder(ph, REACTION)


def generalise(name: Column, rules: list[tuple[str, str]], other: str = "not-used") -> Column:
    """Labels by ordered (label, regex) rules: the last rule that matches wins, none gives `other`, null stays null."""
    out = F
    for label, pattern in reversed(rules):
        out = out.when(name.rlike(pattern), F.lit(label))
    return F.when(name.isNull(), F.lit(None)).otherwise(out.otherwise(F.lit(other)) if rules else F.lit(other))


def lookup(key: Column, values: dict[str, str]) -> Column:
    """The dictionary's value; null where it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def total_fragments(parts: list[Column]) -> Column:
    """Their sum; null if any is null."""
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


# --- names -----------------------------------------------------------------------------------


def make_name(x: Column) -> Column:
    """A syntactic name: other characters become dots, an X stands before a bad start."""
    y = F.regexp_replace(x, r"[^A-Za-z0-9._]", ".")
    return F.when(y.rlike(r"^([A-Za-z]|\.(?![0-9]))"), y).otherwise(F.concat(F.lit("X"), y))


def path_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def clean_names(paths: list[str]) -> list[str]:
    return [re.sub(r"\.[^./]*$", "", p.rsplit("/", 1)[-1]) for p in paths]


def standard_names(names: list[str], longest: int = 6) -> list[str]:
    """Lower case, words joined by _, shortened by dropping inner vowels and then letters from the end; repeats numbered."""
    out: list[str] = []
    for name in names:
        x = re.sub(r"_+", "_", re.sub(r"[^a-z0-9]+", "_", name.lower())).strip("_")
        while len(x) > longest and (m := list(re.finditer(r"(?<=[a-z0-9])[aeiou]", x))):
            x = x[: m[-1].start()] + x[m[-1].end() :]
        x = x[:longest].strip("_")
        n, y = 1, x
        while y in out:
            n += 1
            y = f"{x[: longest - len(str(n))]}{n}"
        out.append(y)
    return out


def renumbered(df: DataFrame, bands: dict[str, str], offset: float = 0.0) -> DataFrame:
    """df with bands (new name -> old) renumbered, all at once, and an offset added."""
    return df.withColumns({new: F.col(old) + offset for new, old in bands.items()})
