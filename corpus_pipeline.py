"""A corpus pipeline: quality rules, exact dedup, near dedup, source mix, tokens.

Each stage takes what the one before it kept, written as Parquet and read again, and returns the
columns of documents; the last returns the tokens of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedolith.llm.common import fresh, join_few, keep, probably_in, table
from pedolith.llm.exact_dedup import exact_dedup, normalised
from pedolith.llm.minhash import near_duplicates, with_prints
from pedolith.llm.mixing import mix
from pedolith.llm.quality import quality
from pedolith.llm.sentencepieces import encode


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule, row by row: ids, repeated rows and other columns do not matter; null text has no
    words and goes; an empty table stays empty."""
    judged = quality(docs)
    return judged.where(F.col(judged.columns[-1])).select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (white space apart), that of the smallest doc_id.

    Only rows of an id that some dropped row has are moved; of those, the row whose (doc_id, hash) is
    kept stays, one of several that share both. Null text counts as empty, a null id sorts last."""
    found = keep(exact_dedup(docs, digest_all=True), "decisions")
    dropped = found.where("not kept").select("doc_id")
    clear = probably_in(docs, "doc_id", dropped, "doc_id", negate=True)
    sha = fresh(docs, "sha")
    stay = found.where("kept").select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha"))
    maybe = probably_in(docs, "doc_id", dropped, "doc_id").withColumn(sha, F.sha2(normalised(F.col("text")), 256))
    maybe = maybe.join(stay, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col(sha) == F.col("k_sha")), "left_semi")
    return clear.unionByName(maybe.dropDuplicates(["doc_id", sha]).drop(sha))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more.

    Decided by (doc_id, fingerprint of the shingles): the group's smallest stays, null ids last, one
    of several rows that share both. Only rows of an id that some dropped row has are moved. Rows without
    words have no near copy and stay; an empty table stays empty; other columns may have any name."""
    found = near_duplicates(docs, groups=True).where("n_shingles > 0")
    found = keep(found.groupBy("doc_id", "f1", "comp").agg(F.count("*").alias("n")), "verdicts")
    me = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "f1")
    first = found.groupBy("comp").agg(F.min(me).alias("first"), F.count("*").alias("c"))
    marked = join_few(found, keep(first, "firsts"), ["comp"], "c").withColumn("stays", me.eqNullSafe(F.col("first"))).where("not stays or n > 1")
    marked = keep(marked.select(F.col("doc_id").alias("m_id"), F.col("f1").alias("m_f1"), F.col("stays").alias("m_stays")), "marked")
    clear = probably_in(docs, "doc_id", marked, "m_id", negate=True)
    f1 = fresh(docs, "f1")
    maybe = with_prints(probably_in(docs, "doc_id", marked, "m_id"), f1)
    maybe = maybe.join(marked, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col(f1) == F.col("m_f1")), "left")
    maybe = keep(maybe.where("m_stays is null or m_stays"), "maybe")
    one = maybe.where("m_stays").dropDuplicates(["doc_id", f1])
    return clear.unionByName(maybe.where("m_stays is null").select(*docs.columns)).unionByName(one.select(*docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: its blocks' words, rounded to whole copies by a hash of id and text so
    that a source keeps its share. A document that the mix takes in part once stays whole.

    A row is told by (id, source, text), null ids too; rows that share all three are taken alike, each
    by their mean. Rows without words take nothing and go; an empty table stays empty."""
    prints = fresh(docs, "print")
    me = ["doc_id", "source", "print"]
    taken = mix(docs).groupBy(*me).agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    share = F.col("taken") / F.nullif("size", F.lit(0))
    chance = F.pmod(F.xxhash64(F.lit(7), "doc_id", "print"), F.lit(1 << 30)) / float(1 << 30)
    copies = F.coalesce(F.floor(share) + (chance < share - F.floor(share)).cast("long"), F.lit(0).cast("long"))
    n = fresh(docs, "copies")
    taken = taken.select(F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("print").alias("t_print"), copies.alias(n)).where(F.col(n) > 0)
    out = docs.withColumn(prints, F.xxhash64("text"))
    out = out.join(taken, F.col("doc_id").eqNullSafe(F.col("t_id")) & F.col("source").eqNullSafe(F.col("t_source")) & (F.col(prints) == F.col("t_print")))
    return out.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, token_ids, merge_ids of each row, as it stands: token_ids are the best path's,
    merge_ids those of the model's own library. Null and empty texts have none; repeated rows repeat."""
    coded = encode(docs.select("doc_id", "text", "source"), merges=True, keep_cols=("source",))
    return coded.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "merge_ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicate_groups),
    ("source_mix", source_mix),
    ("sentence_pieces", sentence_pieces),
]

#: The mix and the tokens are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs, name)
    return docs
