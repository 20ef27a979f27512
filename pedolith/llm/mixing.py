"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pedolith.llm.common import NOT_WS, keep

WEIGHTS = (3.0, 1.0, 2.0)
BLOCK_TOKENS = 32
#: Shards are dealt their quotas down a tree of this fan-out, so that no window holds more.
FANOUT = 1024
#: Copies of a row that one task writes out at a time.
COPIES = 1 << 16
#: Tokens of a shard: documents are laid end to end within a shard, so this bounds a task's group.
SHARD_TOKENS = 1 << 18
#: A prime above any shard's number of blocks: b -> (PRIME * b + c) mod M permutes the M blocks.
PRIME = 2147483629


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(NOT_WS)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources(source, source_size) -> also idx, weight, target.

    Weights are dealt in turn by code point order of the source, null last. `share` of all sizes is
    split by weight; a target stops at `most` times its source's size and the excess is split again
    by weight until no target is above. The stopped sources are those of the least cap / weight, so
    one sorted pass finds the level at which the others stand."""
    whole = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("idx", F.row_number().over(by_name).cast("long") - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("total", share * F.sum("source_size").over(whole))
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), "idx")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rest = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    s = s.withColumn("open_level", F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("level")))
    s = s.withColumn("level", F.first("open_level", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "source_size", "idx", "weight", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def sainte_lague(parties: DataFrame, group: str, key: str, votes: str, seats: str) -> DataFrame:
    """(group, key, quota): the group's seats dealt one by one to the highest votes / (2k + 1), ties to
    the smaller key.

    Seats that a party gets for certain are not dealt one by one: with q = votes * seats / all votes
    and K parties the result lies within 2qK/seats + 2 of q, and only quotients in that band (about
    six for each party) are compared. A party without votes gets no seat."""
    p = parties.where(F.col(votes) > 0).select(F.col(group).alias("_g"), F.col(key).alias("_key"), F.col(votes).cast("double").alias("v"), F.col(seats).alias("n"))
    g = Window.partitionBy("_g")
    p = p.withColumn("q", F.col("v") * F.col("n") / F.sum("v").over(g))
    p = p.withColumn("half", F.ceil(F.coalesce(2 * F.col("q") * F.count("*").over(g) / F.nullif("n", F.lit(0)), F.lit(0.0))) + 2)
    p = p.withColumn("base", F.greatest(F.lit(0).cast("long"), F.floor("q") - F.col("half"))).withColumn("top", F.floor("q") + F.col("half"))
    p = p.withColumn("left", F.col("n") - F.sum("base").over(g))
    c = p.select("_g", "_key", "base", "left", "v", F.explode(F.sequence("base", "top")).alias("k"))
    order = Window.partitionBy("_g").orderBy((F.col("v") / (2 * F.col("k") + 1)).desc(), "_key", "k")
    won = c.withColumn("place", F.row_number().over(order)).groupBy("_g", "_key")
    return won.agg((F.first("base") + F.count_if(F.col("place") <= F.col("left"))).alias("quota")).withColumnsRenamed({"_g": group, "_key": key})


def deal(shards: DataFrame, seats: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """shards(idx, shard, tokens), seats(idx, seats) -> (idx, shard, quota): each source's seats to its shards.

    By Sainte-Laguë down a tree: a source's seats go to runs of fanout ** k shards by their tokens, theirs to
    runs of fanout ** (k - 1), and so on to single shards. A source of up to `fanout` shards is one
    contest; no contest has more parties than that, however large the source."""
    depth, most = 1, shards.agg(F.max("shard")).first()[0] or 0
    while fanout**depth <= most:
        depth += 1
    won = seats.select("idx", F.lit(0).cast("long").alias("run"), "seats")
    for level in range(depth - 1, -1, -1):
        size = F.lit(fanout**level)
        runs = shards.groupBy("idx", F.floor(F.col("shard") / size).alias("key")).agg(F.sum("tokens").alias("tokens"))
        runs = runs.withColumn("run", F.floor(F.col("key") / fanout)).join(won, ["idx", "run"])
        quota = sainte_lague(runs.withColumn("contest", F.struct("idx", "run")), "contest", "key", "tokens", "seats")
        won = quota.select(F.col("contest.idx").alias("idx"), F.col("key").alias("run"), F.col("quota").alias("seats"))
    return won.select("idx", F.col("run").alias("shard"), F.col("seats").alias("quota"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 20, block: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, fanout: int = FANOUT) -> DataFrame:
    """One row per input row: id, source, print (xxhash64 of the text), size, source_size, target, taken.

    Sources get blocks of `block` tokens by Sainte-Laguë on their targets; a source's blocks are dealt
    the same way to its shards, on the shards' tokens. In a shard the documents stand end to end in
    seeded order and are cut into blocks; a quota of Q of M blocks takes every block Q div M times and
    Q mod M blocks once more, chosen by a seeded permutation. `taken` counts the words of the chosen
    blocks that are the document's.

    A shard holds about `shard_tokens` tokens of documents with at least one, so no group grows with
    the input; a hot source has many shards. Rows that share id, source and text are numbered and each
    number is dealt to a shard of its own, so a repeated or null id fills none. Sources themselves
    stand in one window: they are taken to be at most some hundred thousand. Null text has size 0 and
    takes nothing; null sources are one source, last in order. An empty table gives an empty result.
    Every choice is a hash of seed, id, text and number: reruns agree, on any number of machines.
    """
    text = F.col(text_col)
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text).alias("print"), n_tokens(text).alias("size"))
    d = keep(d.groupBy("id", "source", "print", "size").agg(F.count("*").alias("rows")), "sizes")
    s = targets(d.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), weights, share, float(most))
    s = keep(s.withColumn("shards", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / shard_tokens))), "targets")

    seats = s.withColumn("all", F.lit(0)).withColumn("seats", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
    seats = sainte_lague(seats, "all", "idx", "target", "seats").select("idx", F.col("quota").alias("seats"))
    # a row's copies, numbered: few in place, many in runs of COPIES that are dealt out first
    runs = d.where(F.col("rows") > COPIES).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(COPIES).cast("long")))).repartition("id", "print", "from")
    runs = runs.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + COPIES, "rows") - 1))).drop("from")
    d = d.where(F.col("rows") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).unionByName(runs).drop("rows")
    s_keyed = s.withColumnRenamed("source", "s_source")
    placed = d.join(s_keyed, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source", "weight")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "id", "print", "copy"), F.col("shards")))

    shards = keep(placed.where("size > 0").groupBy("idx", "shard").agg(F.sum("size").alias("tokens")), "shards")
    dealt = deal(shards, seats, fanout)
    m = F.ceil(F.col("tokens") / block)
    shards = shards.select("idx", "shard", m.alias("m")).join(dealt, ["idx", "shard"])
    shards = shards.withColumn("quota", F.least("quota", most * F.col("m")))
    shards = shards.select("idx", "shard", "m", F.floor(F.col("quota") / F.col("m")).alias("times"), (F.col("quota") % F.col("m")).alias("once_more"), F.pmod(F.xxhash64(F.lit(seed), "idx", "shard"), F.col("m")).alias("shift"))

    laid = placed.where("size > 0").join(shards, ["idx", "shard"], "left")
    order = Window.partitionBy("idx", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "id", "print", "copy"), "id", "print", "copy")
    laid = laid.withColumn("stop", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("stop") - F.col("size"))
    blocks = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))
    chosen = F.aggregate(
        blocks,
        F.lit(0).cast("long"),
        lambda acc, b: acc + F.when((b * PRIME + F.col("shift")) % F.col("m") < F.col("once_more"), F.least(F.col("stop"), (b + 1) * block) - F.greatest(F.col("start"), b * block)).otherwise(F.lit(0).cast("long")),
    )
    out = ["id", "source", "print", "size", "source_size", "target"]
    laid = laid.select(*out, F.coalesce(F.col("times") * F.col("size") + chosen, F.lit(0).cast("long")).alias("taken"))
    none = placed.where("size = 0").select(*out, F.lit(0).cast("long").alias("taken"))
    return laid.unionByName(none).withColumnsRenamed({"id": id_col, "source": source_col})
