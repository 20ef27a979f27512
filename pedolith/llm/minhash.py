"""Near-duplicate detection by b-bit MinHash with band candidates and exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pedolith.llm.common import Words, chunks, components, join_few, keep, mix, probably_in, shingles, signed, text_buffers

#: Bands and rows a band. At the least similarity linked, 0.85, a pair shares no band with
#: probability (1 - 0.85^6)^36 < 5e-8.
BANDS, ROWS = 36, 6
#: Bits retained of each minimum.
BITS = 2
#: Standard deviations that the estimate may fall below the threshold before a pair is dismissed.
MARGIN = 5.5
#: Text bytes hashed at a time: the arrays of one piece stay in the CPU's cache.
PIECE = 1 << 18
#: Members of a bucket up to which the pairs left after the stars are listed; larger buckets form families.
SMALL_BUCKET = 48
#: Nodes and text bytes of a block of a family: a task holds two blocks.
BLOCK_NODES, BLOCK_BYTES = 512, 8 << 20
#: Parts that a family's nodes are dealt over when they learn how many blocks it has.
SALTS = 256

_PRINT = np.uint64(0x1234567)
SIGNATURE = "id long, n_shingles long, f1 long, f2 long, bands array<long>, planes array<long>"


def _signatures(offsets: np.ndarray, data: np.ndarray, lo: int, hi: int, width: int, bands: int, rows: int):
    """Per row: distinct shingles, two fingerprints of the set, band keys, packed bit planes."""
    h, doc = shingles(Words(offsets, data, lo, hi), width)
    n = hi - lo
    size = np.bincount(doc, minlength=n)
    first = np.searchsorted(doc, np.arange(n))
    has = size > 0
    at = first[has]
    k = bands * rows
    prints = np.zeros((2, n), np.uint64)
    minima = np.zeros((k, n), np.uint64)
    if len(h):
        prints[0, has] = np.add.reduceat(mix(h ^ _PRINT), at)
        prints[1, has] = np.add.reduceat(mix(h ^ np.uint64(0x89ABCDEF01)), at)
        seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64))
        tmp = np.empty_like(h)
        for i in range(k):
            np.bitwise_xor(h, seeds[2 * i], out=tmp)
            np.multiply(tmp, seeds[2 * i + 1] | np.uint64(1), out=tmp)
            minima[i, has] = np.minimum.reduceat(tmp, at)
    keys = np.zeros((bands, n), np.uint64)
    for b in range(bands):
        key = np.full(n, b + 1, np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(0x100000001B3) ^ minima[b * rows + r])
        keys[b] = key
    # BITS low bits of the well-mixed minimum, bit by bit in planes of 64 hashes a word
    kept = mix(minima)
    words = -(-k // 64)
    planes = np.zeros((BITS * words, n), np.uint64)
    for i in range(k):
        for bit in range(BITS):
            planes[bit * words + i // 64] |= ((kept[i] >> np.uint64(bit)) & np.uint64(1)) << np.uint64(i % 64)
    return size, prints, keys, planes


def _nested(matrix: np.ndarray) -> pa.Array:
    """(items, rows) -> a list column with all items of each row."""
    items, n = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * items), pa.array(signed(matrix.T).ravel()))


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            offsets, data = text_buffers(batch.column(1))
            for lo, hi in chunks(offsets, PIECE):
                size, prints, keys, planes = _signatures(offsets, data, lo, hi, width, bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(size.astype(np.int64)), pa.array(signed(prints[0])), pa.array(signed(prints[1])), _nested(keys), _nested(planes)],
                    names=["id", "n_shingles", "f1", "f2", "bands", "planes"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SIGNATURE)


def _with_prints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = text_buffers(batch.column(1))
        for lo, hi in chunks(offsets, PIECE):
            h, doc = shingles(Words(offsets, data, lo, hi), width)
            n = hi - lo
            first, f = np.searchsorted(doc, np.arange(n)), np.zeros(n, np.uint64)
            has = np.bincount(doc, minlength=n) > 0
            if len(h):
                f[has] = np.add.reduceat(mix(h ^ _PRINT), first[has])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(signed(f))], names=["id", "text", "f1"])


def with_prints(docs: DataFrame, name: str, text_col: str = "text", width: int = 5) -> DataFrame:
    """docs with the fingerprint f1 of each row's set as column `name`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            two = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), text], names=["id", "text"])
            f = [x.column(2) for x in _with_prints(iter([two]), width)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays([pa.array([], pa.int64()), *f])], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def _confirm(threshold: int, width: int):
    """Rows (a, b, ta, tb) -> the pairs whose full sets reach the threshold; sets of recent nodes are remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[list[np.ndarray]] = []
            for nodes, column in ((batch.column(0), batch.column(2)), (batch.column(1), batch.column(3))):
                offsets, data = text_buffers(column)
                cache: dict[int, np.ndarray] = {}
                found = []
                for i, node in enumerate(nodes.to_pylist()):
                    if node not in cache:
                        if len(cache) > 64:
                            cache.clear()
                        cache[node] = shingles(Words(offsets, data, i, i + 1), width)[0]
                    found.append(cache[node])
                sets.append(found)
            good = []
            for i, (x, y) in enumerate(zip(*sets, strict=True)):
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if both and 100 * both >= threshold * (len(x) + len(y) - both):
                    good.append(i)
            take = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], names=["a", "b"])

    return run


def _likely(table: pa.Table, threshold: int, least: float, k: int):
    """Pairs (likelihood, left row, right row) of two blocks of a family, or of one: rows of different components whose
    sizes and bit counts allow the threshold, 64 left rows at a time."""
    words = -(-k // 64)
    chance = 2.0**-BITS
    comp, size, own = (table.column(c).to_numpy() for c in ("comp", "n_shingles", "own"))
    one_block = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    planes = table.column("planes").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(table.num_rows, BITS * words)
    left, right = (np.arange(len(own)), np.arange(len(own))) if one_block else (np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min()))
    for lo in range(0, len(left), 64):
        rows = left[lo : lo + 64]
        differ = np.zeros((len(rows), len(right)), np.int64)
        for w in range(words):
            d = np.zeros(differ.shape, np.uint64)
            for bit in range(BITS):
                x = planes[:, bit * words + w]
                d |= x[rows][:, None] ^ x[right][None, :]
            differ += np.bitwise_count(d)
        likely = ((k - differ) / k - chance) / (1 - chance)
        a, b = size[rows][:, None], size[right][None, :]
        ok = (likely >= least) & (100 * np.minimum(a, b) >= threshold * np.maximum(a, b)) & (comp[rows][:, None] != comp[right][None, :])
        if one_block:
            ok &= rows[:, None] < right[None, :]
        x, y = np.nonzero(ok)
        yield likely[x, y], rows[x], right[y]


def _survivors(threshold: int, least: float, k: int):
    """The rows of two blocks that some pair of them needs, without texts: (family, i, j, own, node)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        needed = np.zeros(table.num_rows, bool)
        for _, x, y in _likely(table, threshold, least, k):
            needed[x] = needed[y] = True
        return table.select(["family", "i", "j", "own", "node"]).filter(pa.array(needed))

    return run


def _between_blocks(threshold: int, width: int, least: float, k: int):
    """Nodes of two blocks of a family -> links that join components, at most one less than nodes.

    Components known so far stand as they are. Pairs across the blocks (within the block, where both
    are one) whose sizes and bit counts allow the threshold are confirmed on their full sets, the
    likeliest first, and passed over once their components have met."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
        offsets, data = text_buffers(table.column("text"))
        _, label = np.unique(comp, return_inverse=True)
        parent = np.arange(label.max() + 1 if len(label) else 0)

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        found = list(_likely(table, threshold, least, k))
        likely, x, y = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0), np.zeros(0, int), np.zeros(0, int))
        sets: dict[int, np.ndarray] = {}

        def of(r):
            if r not in sets:
                sets[r] = shingles(Words(offsets, data, r, r + 1), width)[0]
            return sets[r]

        out_a, out_b = [], []
        for at in np.argsort(-likely, kind="stable").tolist():
            p, q = int(x[at]), int(y[at])
            u, v = find(label[p]), find(label[q])
            if u == v:
                continue
            s, t = of(p), of(q)
            if len(s) > len(t):
                s, t = t, s
            both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
            if 100 * both >= threshold * (len(s) + len(t) - both):
                parent[max(u, v)] = min(u, v)
                out_a.append(int(node[p]))
                out_b.append(int(node[q]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def _estimate(bands: int, rows: int):
    """Similarity from equal retained bits, corrected for chance: (e - 2^-b) / (1 - 2^-b)."""
    k = bands * rows
    words = -(-k // 64)
    differ = F.lit(0)
    for w in range(words):
        d = F.lit(0).cast("long")
        for bit in range(BITS):
            i = bit * words + w
            d = d.bitwiseOR(F.get("pa", F.lit(i)).bitwiseXOR(F.get("pb", F.lit(i))))
        differ = differ + F.bit_count(d)
    chance = 2.0**-BITS
    return ((k - differ) / F.lit(float(k)) - chance) / (1 - chance)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 80, bands: int = BANDS, rows: int = ROWS, groups: bool = False) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept; with `groups` also f1, the fingerprint of its set,
    and comp, which tells components apart whatever their ids (null for an empty set).

    A row's set is its distinct `width`-word shingles (words split at space and \\x09-\\x0D, A-Z lower
    case), or its whole sequence if shorter; a row without words has an empty set and no link. Rows
    link where 100 * intersection >= threshold * union; component_id is the smallest id reachable.

    1. One pass gives each row a fingerprint of its set, band keys and b-bit minima packed in planes.
       Rows of equal sets are one node from here on, however many.
    2. Nodes that share a band key stand in a bucket. Each member is compared with one node of the
       bucket, the one that meets most others in all its buckets (an original among its copies), by
       size and by bit counts of the packed minima; pairs not clearly below the threshold are
       confirmed on the full sets, recomputed from the texts of the nodes that have a candidate.
    3. Components are formed. A bucket whose members all stand in one component is settled. In the
       others, members of different components are compared: pair by pair in buckets of at most
       SMALL_BUCKET; the nodes of larger ones form families, each node once, whose blocks of
       BLOCK_NODES meet two by two in numpy: by packed minima first, then only the nodes that some
       pair needs, with their texts. Only links that join components come out. No candidate is
       capped, no task holds more than two blocks, and rows made stay linear in a group's nodes
       but for its number of blocks, texts only for nodes still in doubt.

    Null text counts as empty. Rows that share an id are separate rows and share their component's
    smallest id; kept compares null-safe, so a row with a null id alone in its component stays. An
    empty table gives an empty result; columns other than the two named are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    s = keep(signatures(source, "id", "text", width, bands, rows).withColumn("uid", F.monotonically_increasing_id()), "signatures")

    classes = s.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("uid").alias("node"), F.min("id").alias("least_id"), F.count("*").alias("n_rows"))
    classes = keep(classes, "classes")
    nodes = s.join(classes.select(F.col("node").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("node"), "id", "f1", "n_shingles", "bands", "planes")

    members = nodes.select("node", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = keep(members.join(shared, "key").select("key", "node", "c"), "members")
    # what is known of each node that has a candidate; weight: how many nodes it meets in all its buckets
    weights = members.groupBy("node").agg(F.sum("c").alias("weight"))
    known = keep(nodes.select("node", "id", "f1", "n_shingles", "planes").join(weights, "node"), "nodes")
    f_id, f_print = F.col("id").alias("k_id"), F.col("f1").alias("k_f1")
    texts = probably_in(source, "id", known.select("id"), "id").mapInArrow(lambda it: _with_prints(it, width), "id long, text string, f1 long")
    texts = texts.join(known.select("node", f_id, f_print), F.col("id").eqNullSafe(F.col("k_id")) & (F.col("f1") == F.col("k_f1"))).select("node", "text")
    texts = keep(texts.dropDuplicates(["node"]), "texts")

    sure = threshold / 100.0
    k = bands * rows
    e = sure + (1 - sure) * 2.0**-BITS
    least = sure - MARGIN * (e * (1 - e) / k) ** 0.5 / (1 - 2.0**-BITS)
    sizes = (100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb")) & (_estimate(bands, rows) >= least)
    side = lambda df, n: df.select("key", F.col("node").alias(n), F.col("n_shingles").alias(f"n{n}"), F.col("planes").alias(f"p{n}"), *([F.col("comp").alias(f"c{n}")] if "comp" in df.columns else []))

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
        pairs = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        pairs = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        return keep(pairs.select("a", "b", "ta", "tb").mapInArrow(_confirm(threshold, width), "a long, b long"), "links")

    of_node = known.select("node", "n_shingles", "planes", "weight")
    active = members.join(of_node, "node")
    first = active.groupBy("key").agg(F.max(F.struct("weight", "node", "n_shingles", "planes")).alias("p")).select("key", F.col("p.node").alias("b"), F.col("p.n_shingles").alias("nb"), F.col("p.planes").alias("pb"))
    links = confirmed(side(active, "a").join(first, "key").where((F.col("a") != F.col("b")) & sizes).select("a", "b"))
    comp = components(links)
    placed = members.select("key", "node").join(comp, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    open_keys = placed.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "c", F.col("lo").alias("hub"))
    placed = keep(placed.join(open_keys, "key"), "open")
    apart = F.col("ca") != F.col("cb")
    small = placed.where(F.col("c") <= SMALL_BUCKET).join(of_node, "node")
    few = confirmed(side(small, "a").join(side(small, "b"), "key").where((F.col("a") < F.col("b")) & apart & sizes).select("a", "b"))

    # nodes of large open buckets, whole components with them: one row each in a family, dealt over its blocks
    large = placed.where(F.col("c") > SMALL_BUCKET)
    families = components(large.select(F.col("comp").alias("a"), F.col("hub").alias("b")).distinct())
    in_family = large.select("node", "comp").distinct().join(families.select(F.col("node").alias("comp"), F.col("comp").alias("family")), "comp")
    lengths = texts.select("node", F.octet_length("text").alias("bytes"))
    in_family = in_family.join(known.select("node", "n_shingles", "planes"), "node").join(lengths, "node")
    in_family = keep(in_family.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))), "families")
    blocks = in_family.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    dealt = in_family.join(blocks, ["family", "salt"]).withColumn("own", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "n_shingles", "planes")
    # first without texts: which nodes of two blocks some pair needs; then those with their texts
    needed = dealt.groupBy("family", "i", "j").applyInArrow(_survivors(threshold, least, k), "family long, i int, j int, own int, node long")
    needed = keep(needed, "needed").join(in_family.select("node", "comp", "n_shingles", "planes"), "node").join(texts, "node")
    many = needed.groupBy("family", "i", "j").applyInArrow(_between_blocks(threshold, width, least, k), "a long, b long")
    more = keep(few.unionByName(many), "links")
    if not more.isEmpty():
        comp = components(links.unionByName(more))

    least_of = comp.join(classes, "node").groupBy("comp").agg(F.min("least_id").alias("component_id"))
    of_class = classes.join(comp, "node", "left").join(least_of, "comp", "left")
    more = ["f1", "comp"] if groups else []
    of_class = keep(of_class.select("f1", "f2", "n_rows", F.coalesce("component_id", "least_id").alias("component_id"), F.coalesce("comp", "node").alias("comp")), "of_class")
    out = join_few(s.select("id", "n_shingles", "f1", "f2").where("n_shingles > 0"), of_class, ["f1", "f2"], "n_rows").select("id", "n_shingles", "component_id", *more)
    out = out.unionByName(s.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"), "f1", F.lit(None).cast("long").alias("comp")).select("id", "n_shingles", "component_id", *more))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)
