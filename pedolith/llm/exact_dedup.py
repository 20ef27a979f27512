"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedolith.llm.common import WS, join_few, keep

#: Live (length, prefix) groups are broadcast only when their bytes, counted first, stay under this.
BROADCAST_BYTES = 8 << 20
ROW_BYTES = 32


def normalised(text):
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128, digest_all: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    1. Rows are counted by normalised length; a length that occurs once settles its row.
    2. Of the rest, rows are counted by (length, hash of the first `prefix_chars` characters).
    3. Only rows in a repeated (length, prefix) group have their full text hashed and enter the
       grouping by hash. `digest_all` also hashes settled rows, whose hash is then an output only.

    Rows are narrow in every shuffle; groups are reduced by partial counts and minima, so a group
    with a third of all rows is never gathered. Groups with more than a thousandth of the rows, of
    which there are fewer than a thousand, meet their rows by broadcast, the others by shuffle.

    Null text counts as empty. Of rows that share text and id one is kept. A null id sorts after all
    others. An empty table gives an empty result; columns other than the two named are ignored.
    """
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("t"))
    marks = [F.octet_length("t").alias("n"), F.xxhash64(F.substring("t", 1, prefix_chars)).alias("p")]

    counts = rows.groupBy(*marks).agg(F.count("*").alias("c"))
    lengths = counts.groupBy("n").agg(F.sum("c").alias("rows")).where("rows > 1").select("n")
    live = keep(counts.join(lengths, "n", "left_semi").where("c > 1").select("n", "p"), "live")

    content = rows.select("id", *marks, "t")
    if live.count() * ROW_BYTES <= broadcast_bytes:
        found = content.join(F.broadcast(live.withColumn("hit", F.lit(True))), ["n", "p"], "left")
        sha = F.sha2("t", 256) if digest_all else F.when(F.col("hit"), F.sha2("t", 256))
        found = found.select("id", F.coalesce("hit", F.lit(False)).alias("hit"), sha.alias("sha"))
    else:  # too many groups to send everywhere: hash where the text is, so that no text is shuffled
        found = content.select("id", "n", "p", F.sha2("t", 256).alias("sha")).join(live.withColumn("hit", F.lit(True)), ["n", "p"], "left")
        found = found.select("id", F.coalesce("hit", F.lit(False)).alias("hit"), "sha")
    found = keep(found.withColumn("uid", F.monotonically_increasing_id()), "hashed")

    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "uid"))
    groups = found.where("hit").groupBy("sha").agg(F.count("*").alias("size"), first.alias("first")).where("size > 1")
    groups = keep(groups.select("sha", "size", F.col("first.id").alias("keep_id"), F.col("first.uid").alias("keep_uid")), "groups")
    in_group = join_few(found.where("hit"), groups, ["sha"], "size")
    alone = F.col("size").isNull()
    in_group = in_group.select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    single = found.where("not hit").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return in_group.unionByName(single).withColumnRenamed("id", id_col)
