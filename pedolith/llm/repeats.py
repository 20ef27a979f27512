"""Substring deduplication: sliding sentence spans, and sparse suffix arrays at minimiser positions.

Both tell a document by (id, fingerprint of its text): rows that share an id but not a text are
different documents, rows that share both have the same result. Occurrences are ordered by (id, fingerprint, place),
null ids last; what is removed always equals an occurrence earlier in that order, so one copy stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedolith.llm.common import Words, chunks, keep, mix, probably_in, signed, text_buffers

PIECE = 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_POLY = np.uint64(0xD6E8FEB86659FD93)
_POLY_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def fingerprints(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Of each text, as Spark's xxhash64 gives it (seed 42)."""
    return np.array([xxhash.xxh64_intdigest(data[int(offsets[i]) : int(offsets[i + 1])].tobytes(), seed=42) for i in range(len(offsets) - 1)], np.uint64).view(np.int64)


def run_hashes(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the runs h[start:stop], by prefix sums of a polynomial modulo 2^64."""
    n = len(h)
    power, inverse = np.full(n + 1, _POLY), np.full(n + 1, _POLY_INV)
    power[0] = inverse[0] = 1
    power, inverse = np.cumprod(power), np.cumprod(inverse)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * power[:n], out=total[1:])
    return mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64) * _MUL)


# --- sentences ----------------------------------------------------------------------------------

_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True


def sentences(words: Words) -> np.ndarray:
    """First words of the sentences: a sentence ends at a word that ends with . ! or ?, at a line break
    or at the text's end."""
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int64)
    breaks = np.zeros(len(words.buf) + 1, np.int64)
    np.cumsum(words.buf == 10, out=breaks[1:])
    ends = _STOPS[words.buf[words.end - 1]]
    ends[:-1] |= (breaks[words.start[1:]] > breaks[words.end[:-1]]) | (words.doc[1:] != words.doc[:-1])
    return np.concatenate([[0], np.flatnonzero(ends[:-1]) + 1])


def sentence_runs(words: Words, least_sentences: int, least_words: int, lone_words: int):
    """(doc, first sentence of the doc's, sentences, hash) of the shortest runs from each sentence and to each
    sentence that have least_sentences and least_words, and of each sentence of lone_words;
    per-document sentence counts.

    Any longer run is made of these: a sentence before the shortest run to its end starts a shortest
    run that ends inside it. So what they cover is what all runs cover."""
    first = sentences(words)
    n = len(first)
    n_docs = len(words.count)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    w = words.hashes()
    edges = np.append(first, len(w))
    place = np.arange(len(w)) - np.repeat(first, np.diff(edges))
    h = mix(np.add.reduceat(mix(w + place.astype(np.uint64) * _MUL), first) + np.diff(edges).astype(np.uint64))
    doc = words.doc[first]
    of_doc = np.bincount(doc, minlength=n_docs)
    begin = np.cumsum(of_doc) - of_doc
    at = np.arange(n)
    to = np.maximum(np.searchsorted(edges, edges[:-1] + least_words, "left"), at + least_sentences)
    since = np.minimum(np.searchsorted(edges, edges[1:] - least_words, "right"), at + 2 - least_sentences) - 1
    starts, ends, lone = to <= (begin + of_doc)[doc], since >= begin[doc], np.diff(edges) >= lone_words
    i, j = np.concatenate([at[starts], since[ends], at[lone]]), np.concatenate([to[starts], at[ends] + 1, at[lone] + 1])
    i, j = np.divmod(np.unique(i * (n + 1) + j), n + 1)
    return doc[i], i - begin[doc[i]], j - i, run_hashes(h, i, j), of_doc


SPANS = "id long, f long, i int, n int, h long"


def _spans(least_sentences: int, least_words: int, lone_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            offsets, data = text_buffers(batch.column(1))
            for lo, hi in chunks(offsets, PIECE):
                words = Words(offsets, data, lo, hi)
                doc, i, n, h, _ = sentence_runs(words, least_sentences, least_words, lone_words)
                f = fingerprints(offsets[lo : hi + 1], data)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(pa.array(doc)), pa.array(f[doc]), pa.array(i.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(signed(h))], names=["id", "f", "i", "n", "h"])

    return run


def _order(*more: str):
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "f", *more)


def _without(offsets: np.ndarray, data: np.ndarray, row: int, words: Words, cut: np.ndarray) -> str:
    """The text of a row without the words that cut marks, each with the space after it."""
    base = int(offsets[row])
    raw = data[base : int(offsets[row + 1])]
    stay = np.ones(len(raw) + 1, np.int32)
    at = np.flatnonzero(cut)
    if len(at):
        follow = np.append(words.start[1:], len(raw))
        edge = np.zeros(len(raw) + 1, np.int32)
        np.add.at(edge, words.start[at], 1)
        np.add.at(edge, follow[at], -1)
        stay = 1 - np.cumsum(edge)
    return raw[stay[:-1] > 0].tobytes().decode("utf-8", "replace")


def _rebuilt(by: str):
    """Rows (id, text, spans) -> id, n_units, n_removed, n_words, words_removed, clean_text; units are sentences
    or words, spans [start, length] in units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffers(batch.column(1))
            spans = batch.column(2)
            rows = []
            for r in range(len(batch)):
                words = Words(offsets, data, r, r + 1)
                n = len(words.start)
                first = sentences(words) if by == "sentence" else np.arange(n)
                mark = np.zeros(len(first) + 1, np.int32)
                found = spans[r].values if spans[r].is_valid else None
                if found is not None and len(found):
                    start, size = (found.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    np.add.at(mark, start, 1)
                    np.add.at(mark, np.minimum(start + size, len(first)), -1)
                    gone = np.cumsum(mark)[:-1] > 0
                    cut = np.repeat(gone, np.diff(np.append(first, n))) if len(first) else np.zeros(0, bool)
                    clean = _without(offsets, data, r, words, cut)
                    rows.append((len(first), int(gone.sum()), n, int(cut.sum()), clean))
                else:
                    rows.append((len(first), 0, n, 0, data[int(offsets[r]) : int(offsets[r + 1])].tobytes().decode("utf-8", "replace")))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string())], names=["id", "n_units", "n_removed", "n_words", "words_removed", "clean_text"])

    return run


REBUILT = "id long, n_units long, n_removed long, n_words long, words_removed long, clean_text string"


def _fingerprinted(docs: DataFrame) -> DataFrame:
    """docs with f, the numpy functions' fingerprint; not by Python, so that no task runs two workers at once."""
    return docs.select("id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("f"))


def _apply(source: DataFrame, spans: DataFrame, by: str) -> DataFrame:
    """spans (id, f, start, size) cut from the texts of source; only texts that may have spans are shuffled."""
    of_doc = keep(spans.groupBy("id", "f").agg(F.collect_set(F.struct("start", "size")).alias("spans")), "cuts")
    marks = of_doc.select("id")
    touched = _fingerprinted(probably_in(source, "id", marks, "id"))
    c = of_doc.select(F.col("id").alias("cid"), F.col("f").alias("cf"), "spans")
    touched = touched.join(c, F.col("id").eqNullSafe(F.col("cid")) & (F.col("f") == F.col("cf")), "left").select("id", "text", "spans")
    untouched = probably_in(source, "id", marks, "id", negate=True).select("id", "text", F.lit(None).cast("array<struct<start:int,size:int>>").alias("spans"))
    return touched.unionByName(untouched).mapInArrow(_rebuilt(by), REBUILT)


def sentence_span_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_sentences: int = 2, least_words: int = 20, lone_words: int = 25) -> DataFrame:
    """One row per input row: id, n_sentences, n_removed, n_words, words_removed, clean_text.

    Every run of consecutive sentences with `least_sentences` and `least_words` words (or one sentence
    of `lone_words`) counts, its words in lower case (A-Z) and apart from white space. Hashed are those
    that all others are made of: the shortest from each start and to each end. Runs are counted over all documents; sentences that stand in
    any but the first occurrence of a repeated run are removed, in the same document too.

    Occurrences are reduced to (count, first) before they meet, and joined back after a bit map has
    dropped those that cannot be repeated. Null text counts as empty; texts with no repeated run are
    returned unchanged; an empty table gives an empty result; columns other than the two named are
    ignored. Copies of a document keep their first occurrence and lose the runs of the others.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spans = keep(source.mapInArrow(_spans(least_sentences, least_words, lone_words), SPANS), "spans")
    repeated = keep(spans.groupBy("h").agg(F.count("*").alias("c"), F.min(_order("i")).alias("first")).where("c > 1").select("h", "first"), "repeated")
    again = probably_in(spans, "h", repeated, "h").join(repeated, "h").where(~_order("i").eqNullSafe(F.col("first")))
    out = _apply(source, again.select("id", "f", F.col("i").alias("start"), F.col("n").alias("size")), "sentence")
    return out.withColumnsRenamed({"id": id_col, "n_units": "n_sentences"})


# --- suffixes -----------------------------------------------------------------------------------


def minimisers(words: Words, w: np.ndarray, k: int, window: int) -> np.ndarray:
    """Places whose k-word hash is the least of some window of consecutive places of their document."""
    n = len(w) - k - window + 2
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(len(w) - k + 1)
    h = run_hashes(w, at, at + k)
    whole = words.doc[:n] == words.doc[window + k - 2 : window + k - 2 + n]
    least = np.lib.stride_tricks.sliding_window_view(h, window).argmin(axis=1) + np.arange(n)
    return np.unique(least[whole])


SUFFIXES = "key long, id long, f long, p int"


def _suffixes(k: int, window: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            offsets, data = text_buffers(batch.column(1))
            for lo, hi in chunks(offsets, PIECE):
                words = Words(offsets, data, lo, hi)
                w = words.hashes()
                p = minimisers(words, w, k, window)
                p = p[p + length <= words.first[1:][words.doc[p]]] if len(p) else p
                doc = words.doc[p]
                f = fingerprints(offsets[lo : hi + 1], data)
                yield pa.RecordBatch.from_arrays([pa.array(signed(run_hashes(w, p, p + length))), ids.slice(lo, hi - lo).take(pa.array(doc)), pa.array(f[doc]), pa.array((p - words.first[doc]).astype(np.int32))], names=["key", "id", "f", "p"])

    return run


AROUND = "kind int, key long, id long, f long, p int, size int, ext binary, is_first boolean"
CHAIN, BEFORE, AFTER = 0, 1, 2


def _strips(words4: np.ndarray, at: np.ndarray, step: int, reach: int) -> pa.Array:
    """4 bytes for each of the up to `reach` words from each place on, forward or (step -1) backward."""
    k = at[:, None] + step * np.arange(reach)
    inside = (k >= 0) & (k < len(words4))
    offsets = np.concatenate([[0], np.cumsum(inside.sum(axis=1) * 4)]).astype(np.int32)
    data = words4[k[inside]].tobytes()
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def _around(reach: int, length: int):
    """Rows (id, f, text, places [key, p, is_first]) -> the text's chains, and what stands around their ends.

    Places that repeat an earlier one whose prefixes overlap or touch make a chain; kind CHAIN has its
    start and size. BEFORE and AFTER have the `reach` words before a prefix, nearest first, and after it:
    of a chain's first and last place, and of each key's first occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffers(batch.column(2))
            places = batch.column(3)
            for r in range(len(batch)):
                w = Words(offsets, data, r, r + 1).hashes().astype(">u4")
                key, p, first = (places[r].values.field(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
                order = np.argsort(p, kind="stable")
                key, p, first = key[order], p[order].astype(np.int64), first[order].astype(bool)
                again = np.flatnonzero(~first)
                apart = p[again[1:]] > p[again[:-1]] + length
                head, tail = np.append(True, apart) if len(again) else apart, np.append(apart, True) if len(again) else apart
                start, stop = p[again[head]], p[again[tail]] + length
                left, right = first.copy(), first.copy()
                left[again[head]] = right[again[tail]] = True
                left &= p > 0
                right &= p + length < len(w)
                n, b, a = len(start), int(left.sum()), int(right.sum())
                m = n + b + a
                ext = pa.concat_arrays([pa.nulls(n, pa.binary()), _strips(w, p[left] - 1, -1, reach), _strips(w, p[right] + length, 1, reach)])
                cols = [
                    np.repeat([CHAIN, BEFORE, AFTER], [n, b, a]).astype(np.int32),
                    np.concatenate([np.zeros(n, np.int64), key[left], key[right]]),
                    pa.array([batch.column(0)[r].as_py()] * m, pa.int64()),
                    pa.array([batch.column(1)[r].as_py()] * m, pa.int64()),
                    np.concatenate([start, p[left], p[right]]).astype(np.int32),
                    np.concatenate([stop - start, np.zeros(b + a, np.int64)]).astype(np.int32),
                    ext,
                    np.concatenate([np.zeros(n, bool), first[left], first[right]]),
                ]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=[x.split()[0] for x in AROUND.split(", ")])

    return run


def _common(a: bytes, b: bytes) -> int:
    """Equal 4-byte units at the start of both."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // 4
    x, y = np.frombuffer(a, ">u4", n // 4), np.frombuffer(b, ">u4", n // 4)
    return int(np.argmax(x != y))


MATCHED = "key long, kind int, level int, ext binary, no_id boolean, id long, f long, p int, settled boolean"


def _tournament(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, kind, ext, occurrence) -> (row, level) for rows that share the first `level` words of
    their strip with an earlier occurrence; the greatest level of a row is what it shares with any.

    Rows of a key that share the first j words stand together: a group of level j, a node of a trie.
    When a group ends, its earliest row meets that of the group above: the later one of the two shares
    no more than that level, which settles it. Groups that hold the partition's first or last row may
    go on beyond it: their earliest rows, one a level and end, also go out unsettled, to meet those of
    the other partitions. So it does not matter where the partitions are cut."""
    best: list = []  # by level, the earliest row of the open group
    key, ext, edge, start = None, b"", -1, True  # edge: deepest open level that the partition's first row shares
    out: list = []

    def end(down_to: int, unsettled: int) -> None:
        for level in range(len(best) - 1, down_to, -1):
            row = best.pop()
            if level <= unsettled:
                out.append((*key, level, ext[: 4 * level], *row, False))
            if level:
                up = best[-1]
                if up is not None:
                    out.append((*key, level - 1, None, *max(up, row), True))
                best[-1] = row if up is None else min(up, row)

    def flushed() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 9
        out.clear()
        fields = [f.split() for f in MATCHED.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])

    for batch in batches:
        for k, kind, x, no_id, i, f, p in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
            same = (_common(x, ext) if (k, kind) == key else -1) if not start else len(x) // 4
            if start:
                key, edge, start = (k, kind), same, False
            else:
                end(same, edge)
                edge = min(edge, same)
            key, ext, row = (k, kind), x, (no_id, i, f, p) if not no_id else (no_id, 0, f, p)
            best.extend([None] * (len(x) // 4 + 1 - len(best)))
            if best[-1] is not None:
                out.append((*key, len(best) - 1, None, *max(best[-1], row), True))
                row = min(best[-1], row)
            best[-1] = row
        yield flushed()
    end(-1, len(best))
    yield flushed()


def _matched(strips: DataFrame) -> DataFrame:
    """strips(key, kind, id, f, p, ext) -> (kind, id, f, p, level): what a strip shares with an earlier occurrence's.

    Sorted by range, so that a key with a third of all rows is many partitions; what crosses their
    bounds is at most two rows a level and partition."""
    keys = ["key", "kind", "ext", "no_id", "id", "f", "p"]
    e = strips.withColumn("no_id", F.col("id").isNull()).select(*keys)
    met = keep(e.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_tournament, MATCHED), "matched")
    ends = met.where("not settled").withColumn("row", F.struct("no_id", "id", "f", "p"))
    group = ["key", "kind", "level", "ext"]
    ends = ends.join(ends.groupBy(*group).agg(F.min("row").alias("least")), group).where("row > least")
    out = ["kind", "no_id", "id", "f", "p", "level"]
    both = met.where("settled").select(*out).unionByName(ends.select(*out))
    return both.where("level > 0").select("kind", F.when(~F.col("no_id"), F.col("id")).alias("id"), "f", "p", "level")


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, window: int = 16, length: int = 32) -> DataFrame:
    """One row per input row: id, n_words, words_removed, clean_text.

    Suffixes are retained at minimisers: places whose `k`-word hash is the least of `window`
    neighbouring places. A passage of window + length - 1 words (47 here) or more that stands in two
    places has a minimiser in common that `length` of its words follow.

    1. Retained suffixes are counted by the hash of their first `length` words; unrepeated ones go.
    2. Of each repeated one the first occurrence stays; the others go, their words are removed. Those
       that overlap or touch form chains, which only their ends can reach beyond.
    3. The suffixes at chain ends and the first occurrences are sorted by key and by the words that
       follow, and by key and the words before; neighbours are compared, and each end is extended by as
       many words, `window` at most, as it shares with any of these that stand earlier. Beyond that
       the next minimiser's own match reaches.

    The sort is by range over all columns and its result does not depend on the partitions: no key
    fills a task. Null text counts as empty; an empty table gives an empty result; columns other than the
    two named are ignored; rows that share id and text have one result, other rows of an id their own; ids
    are cast to long. Words are compared in lower case (A-Z), by 64-bit hashes of the first
    `length` and 32-bit hashes of the extensions.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    suffixes = keep(source.mapInArrow(_suffixes(k, window, length), SUFFIXES), "suffixes")
    repeated = keep(suffixes.groupBy("key").agg(F.count("*").alias("c"), F.min(_order("p")).alias("first")).where("c > 1").select("key", "first"), "repeated")
    live = probably_in(suffixes, "key", repeated, "key").join(repeated, "key")
    live = live.select("id", "f", F.struct("key", "p", _order("p").eqNullSafe(F.col("first")).alias("is_first")).alias("place"))
    places = keep(live.groupBy("id", "f").agg(F.collect_set("place").alias("places")), "places")
    texts = _fingerprinted(probably_in(source, "id", places.select("id"), "id")).dropDuplicates(["id", "f"])
    pl = places.select(F.col("id").alias("pid"), F.col("f").alias("pf"), "places")
    found = texts.join(pl, F.col("id").eqNullSafe(F.col("pid")) & (F.col("f") == F.col("pf"))).select("id", "f", "text", "places")
    around = keep(found.mapInArrow(_around(window, length), AROUND).withColumn("of", F.xxhash64("key", "kind")), "around")

    ends = around.where(f"kind > {CHAIN} and not is_first")
    firsts = probably_in(around.where("is_first"), "of", ends, "of")
    level = _matched(ends.unionByName(firsts).select("key", "kind", "id", "f", "p", "ext"))
    start = F.when(F.col("kind") == BEFORE, F.col("p") - F.col("level")).otherwise(F.col("p") + length)
    spans = around.where(f"kind = {CHAIN}").select("id", "f", F.col("p").alias("start"), "size")
    spans = spans.unionByName(level.select("id", "f", start.alias("start"), F.col("level").alias("size")))
    out = _apply(source, spans, "word")
    return out.select("id", "n_words", "words_removed", "clean_text").withColumnRenamed("id", id_col)
