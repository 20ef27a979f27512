"""Quality rules: a threshold table compiled into one projection of native expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedolith.llm.common import WS, fresh, let

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for with was on as by this it are from be at an a or "
    "de la le et les des en un une du que est pour dans par sur au avec ce pas qui "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine "
    "el y los se del las por con su para es al lo una no"
).split()
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Rule:
    """A document fails if scale * top / per (measures; top alone without per) is below `low` or above `high`; a
    ratio over nothing fails no rule."""

    name: str
    top: str
    per: str | None = None
    scale: float | None = None
    low: float | None = None
    high: float | None = None

    def value(self, m: Column) -> Column:
        v = m[self.top] if self.scale is None else self.scale * m[self.top]
        return v if self.per is None else v / F.nullif(m[self.per], F.lit(0))

    def sql(self) -> str:
        v = self.top if self.scale is None else f"{self.scale} * {self.top}"
        return v if self.per is None else f"{v} / nullif({self.per}, 0)"


RULES = (
    Rule("word_count", "n_words", low=50),
    Rule("repeated_windows", "n_repeat_words", "n_words", 100.0, high=50),
    Rule("mean_word_length", "word_chars", "n_words", low=2, high=15),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.25),
    Rule("stop_word_share", "n_stop_words", "n_words", low=0.03),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
)


def _covered(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more.

    Windows are hashed (64 bits), sorted with their places, equal neighbours give the places of
    repeated windows, and each place covers three words or as many as stand before the next."""

    def hashed(ws):
        n = F.size(ws)
        places = F.when(n < 3, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), n - 2))
        return let(F.transform(places, lambda i: F.xxhash64(F.get(ws, i - 1), F.get(ws, i), F.get(ws, i + 1))), repeated)

    def repeated(h):  # most texts repeat no window: their hashes are distinct and nothing is sorted
        windows = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.sort_array(windows), twins))

    def twins(s):
        less = F.greatest(F.size(s) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(s, F.lit(1), less), F.slice(s, F.lit(2), less), lambda x, y: F.when(x["h"] == y["h"], F.array(x["p"], y["p"])))
        return let(F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))), cover)

    def cover(d):
        d_next = F.concat(F.slice(d, F.lit(2), F.greatest(F.size(d) - 1, F.lit(0))), F.array(F.lit(2147483647)))
        gaps = F.when(F.size(d) > 0, F.zip_with(d, d_next, lambda a, b: F.least(b - a, F.lit(3)))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    return let(words, hashed)


def measures(text: Column) -> Column:
    """A struct of all measures of a text: one row's own words and lines, nothing beyond the row.

    Words are runs of anything but space and \\x09-\\x0D; null text has none."""
    text = F.coalesce(text, F.lit(""))

    def of(t):
        split = F.filter(F.split(t, WS), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)

        def parts(x):
            ws, ls = x["w"], x["l"]
            return F.struct(
                F.size(ws).cast("long").alias("n_words"),
                F.length(F.translate(x["t"], SPACES, "")).cast("long").alias("word_chars"),
                (F.length(x["t"]) - F.length(F.translate(x["t"], SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                F.size(ls).cast("long").alias("n_lines"),
                _covered(ws).alias("n_repeat_words"),
                F.size(F.filter(ws, lambda w: w.isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
            )

        return let(F.struct(split.alias("w"), lines.alias("l"), t.alias("t")), parts)

    return let(text, of)


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that the measures in struct m fail."""
    failed = []
    for r in rules:
        value, bad = r.value(m), F.lit(False)
        if r.low is not None:
            bad = bad | F.coalesce(value < r.low, F.lit(False))
        if r.high is not None:
            bad = bad | F.coalesce(value > r.high, F.lit(False))
        failed.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*failed))


def quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with three more columns, named apart from those that docs has: measures (struct), failed
    rules (array of names) and kept (no rule failed), in that order at the end.

    A document without words fails the word count and no ratio. No row is added or lost; the
    projection has no shuffle, no Python and no state."""
    # one expression for measures and verdict: a filter on it that moves below the projection takes it along once
    both = let(measures(F.col(text_col)), lambda m: F.struct(m.alias("measures"), verdict(m, rules).alias("failed")))
    j = fresh(docs, "judged")
    out = docs.withColumn(j, both)
    names = fresh(out, "measures"), fresh(out, "failed"), fresh(out, "kept")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(j)["measures"].alias(names[0]), F.col(j)["failed"].alias(names[1]), (F.size(F.col(j)["failed"]) == 0).alias(names[2]))
