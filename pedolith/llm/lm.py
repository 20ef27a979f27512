"""Language-model scoring: a log-bilinear neural model over words, trained by noise-contrastive estimation
on all training texts, with exact word counts.

log P(word | two words before) = log P(class of word | the two before) + log P(word | its class).
The most frequent words are classes of their own, so that for them the second factor is 1; the rest
share classes by their last two bytes and get it from the corpus counts; the end of a text is a class.
The first factor is the neural model: a vector for each class as target, as the word before and as the
one before that (there in fewer classes), normalised over all classes by matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedolith.llm.common import Words, chunks, keep, mix, signed, text_buffers

PIECE = 1 << 20
#: Classes: the end of a text, words of their own, shared ones; class CLASSES stands before a text's start.
OWN, SHARED = 1919, 128
CLASSES = 1 + OWN + SHARED
#: Of the word two before: its first COARSE words are told apart, all others by their shared class.
COARSE = 127
FAR = 1 + COARSE + SHARED
DIM = 32
#: Noise words of a batch, met by all its tokens.
NOISE = 128
BATCH = 1024
#: Rounds over the training texts, each on its share of them, with its rate; the models of a round are averaged.
RATES = (0.1, 0.07, 0.05)
#: Tokens that a small corpus is trained on, by repeated passes; a larger one is passed over once.
LEAST_TOKENS = 3_000_000
#: Counts of the FREQUENT most frequent words go to every task (16 bytes each); those of the others are joined.
FREQUENT = 200_000
#: Words that a task counts before it passes its counts on.
HELD = 1 << 20
SEED = 17
#: Parts in which a model travels, and parts of its sum; what a part is scaled by, to add up in whole numbers.
SLICES, SLOTS, SCALE = 16, 64, 1 << 10


def shared_class(words: Words) -> np.ndarray:
    last = words.buf[words.end - 1].astype(np.int64)
    before = np.where(words.end - words.start > 1, words.buf[np.maximum(words.end - 2, 0)], 0).astype(np.int64)
    return 1 + OWN + (last * 31 + before * 7) % SHARED


def held_out(ids: pa.Array) -> np.ndarray:
    """crc32 of the id as text, modulo 5, is 1; a null id is the empty text."""
    import zlib

    return np.array([zlib.crc32(str(x).encode() if x is not None else b"") % 5 == 1 for x in ids.to_pylist()], bool)


def _sums(keys: np.ndarray, *values: np.ndarray):
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], order[first], *[np.add.reduceat(v[order], first) if len(keys) else v for v in values]


def _training(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        train = ~held_out(batch.column(0))
        column = batch.column(1).filter(pa.array(train))
        offsets, data = text_buffers(column)
        for lo, hi in chunks(offsets, PIECE):
            yield hi - lo, Words(offsets, data, lo, hi)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, cls, n); the end of a text as h 0, class 0."""
    parts, rows, ends = [], 0, 0

    def flush():
        h, c, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        h, at, n = _sums(h, n)
        return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(c[at].astype(np.int32)), pa.array(n)], names=["h", "cls", "n"])

    for docs, words in _training(batches):
        ends += docs
        h, at, n = _sums(words.hashes(), np.ones(len(words.start), np.int64))
        parts.append((h, shared_class(words)[at], n))
        rows += len(h)
        if rows > HELD:
            yield flush()
            parts, rows = [], 0
    if parts:
        yield flush()
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int32()), pa.array([ends], pa.int64())], names=["h", "cls", "n"])


@dataclass
class Vocabulary:
    """Sorted hashes of the frequent words with their counts, the hashes that are classes of their own, coarser classes."""

    h: np.ndarray
    n: np.ndarray
    own: np.ndarray
    own_class: np.ndarray
    far: np.ndarray  # class -> class as the word two before

    def classes(self, words: Words, h: np.ndarray) -> np.ndarray:
        cls = shared_class(words)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, h), len(self.own) - 1)
            cls = np.where(self.own[at] == h, self.own_class[at], cls)
        return cls


def sequences(words: Words, cls: np.ndarray, docs: int, far: np.ndarray):
    """Classes of all texts with their ends: (doc, coarse class two before, class one before, class)."""
    place = np.arange(len(cls)) + words.doc
    ends = words.first[1:] + np.arange(docs)
    n = len(cls) + docs
    seq, doc = np.zeros(n, np.int64), np.zeros(n, np.int64)
    seq[place], doc[place] = cls, words.doc
    doc[ends] = np.arange(docs)
    first = np.concatenate([[0], ends[:-1] + 1]) if docs else np.zeros(0, np.int64)
    one, two = np.roll(seq, 1), np.roll(seq, 2)
    one[first] = two[first] = CLASSES
    second = first + 1
    two[second[second <= ends]] = CLASSES
    return doc, far[two], one, seq


def blank(class_n: np.ndarray) -> dict[str, np.ndarray]:
    """A model that knows the class counts only."""
    rng = np.random.default_rng(SEED)
    share = (class_n + 0.5) / (class_n + 0.5).sum()
    p = {"r": rng.normal(0, 0.1, (CLASSES, DIM)), "q2": rng.normal(0, 0.1, (FAR + 1, DIM)), "q1": rng.normal(0, 0.1, (CLASSES + 1, DIM)), "b": np.log(share)}
    return {k: x.astype(np.float32) for k, x in p.items()}


class Trainer:
    """Noise-contrastive estimation of s(c | u, v) = r_c . (q2_u + q1_v) + b_c, in steps of batched products.

    Noise is drawn by the class counts, NOISE words for each batch, and met by each of its tokens; the
    loss is the logistic one of telling a token from them. A weight's step is the rate by its gradient over
    the root of the sum of its squared gradients so far, as most rows are met seldom."""

    def __init__(self, p: dict[str, np.ndarray], class_n: np.ndarray, rate: float, seed: int):
        self.p = {k: x.copy() for k, x in p.items()}
        self.squares = {k: np.zeros_like(x) for k, x in p.items()}
        self.rate, self.tokens = rate, 0
        self.rng = np.random.default_rng(seed)
        share = (class_n + 0.5) / (class_n + 0.5).sum()
        self.cut, self.log_noise = np.cumsum(share), np.log(NOISE * share).astype(np.float32)

    def learn(self, u: np.ndarray, v: np.ndarray, c: np.ndarray) -> None:
        """One pass over tokens c with the classes before them, in random order."""
        order = self.rng.permutation(len(c))
        parts = max(1, round(len(c) / BATCH))
        for k in range(parts):
            at = order[k * len(c) // parts : (k + 1) * len(c) // parts]
            if len(at):
                self.step(u[at], v[at], c[at])
        self.tokens += len(c)

    def step(self, u: np.ndarray, v: np.ndarray, c: np.ndarray) -> None:
        p, n = self.p, len(c)
        noise = np.minimum(np.searchsorted(self.cut, self.rng.random(NOISE)), CLASSES - 1)
        h, r_c, r_n = p["q2"][u] + p["q1"][v], p["r"][c], p["r"][noise]
        true = np.einsum("nd,nd->n", h, r_c) + p["b"][c] - self.log_noise[c]
        false = h @ r_n.T + (p["b"][noise] - self.log_noise[noise])
        d_c = (1 / (1 + np.exp(-true)) - 1) / n
        d_n = 1 / (1 + np.exp(-false)) / n
        g_h = d_c[:, None] * r_c + d_n @ r_n
        r_rows, r_values = np.concatenate([c, noise]), np.concatenate([d_c[:, None] * h, d_n.T @ h])
        grads = {
            "r": _rows(r_rows, r_values, CLASSES),
            "q2": _rows(u, g_h, FAR + 1),
            "q1": _rows(v, g_h, CLASSES + 1),
            "b": np.bincount(r_rows, np.concatenate([d_c, d_n.sum(0)]), minlength=CLASSES),
        }
        for k, g in grads.items():
            g = g.astype(np.float32)
            self.squares[k] += g * g
            p[k] -= self.rate * g / (np.sqrt(self.squares[k]) + 1e-9)


def _rows(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values by `at`."""
    flat = (at[:, None] * DIM + np.arange(DIM)).ravel()
    return np.bincount(flat, values.ravel(), minlength=n * DIM).reshape(n, DIM)


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _shaped(x: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = x[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


MOVED = "slice int, slot int, tokens long, moved binary"


def _move(vocabulary: Vocabulary, params: dict[str, np.ndarray], class_n: np.ndarray, turn: int, passes: int):
    """A task's training texts of one round -> how far they move the model, weighted by its tokens, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, row = None, [], 0
        for batch in batches:
            mine = (row + np.arange(len(batch))) % len(RATES) == turn
            row += len(batch)
            for docs, words in _training(iter([batch.filter(pa.array(mine))])):
                h = words.hashes()
                if model is None:
                    model = Trainer(params, class_n, RATES[turn], int(h.sum() >> np.uint64(1)) if len(h) else SEED)
                _, u, v, c = sequences(words, vocabulary.classes(words, h), docs, vocabulary.far)
                model.learn(u, v, c)
                if passes > 1:  # a small corpus: its tokens are fewer than LEAST_TOKENS
                    held.append((u, v, c))
        if model is None:
            return
        if held:
            u, v, c = (np.concatenate(x) for x in zip(*held, strict=True))
            for _ in range(passes - 1):
                model.learn(u, v, c)
        moved = (_flat(model.p).astype(np.float64) - _flat(params)) * model.tokens
        slot = int(mix(np.array([model.tokens], np.uint64))[0] % np.uint64(SLOTS))
        whole = [np.rint(x * SCALE).astype(np.int64).tobytes() for x in np.array_split(moved, SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([slot] * SLICES, pa.int32()), pa.array([model.tokens] * SLICES, pa.int64()), pa.array(whole, pa.binary())], names=["slice", "slot", "tokens", "moved"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices added up as they come, one array a slice; whole numbers, so their order does not matter."""
    sums: dict[int, list] = {}
    for batch in batches:
        for i, tokens, moved in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x = np.frombuffer(moved, np.int64)
            n, y = sums.get(i, (0, np.zeros(len(x), np.int64)))
            sums[i] = [n + tokens, y + x]
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([y.tobytes() for _, y in sums.values()], pa.binary())], names=["slice", "slot", "tokens", "moved"])


def train(source: DataFrame, vocabulary: Vocabulary, class_n: np.ndarray, passes: int) -> dict[str, np.ndarray]:
    """The model after one round over the training texts for each of RATES, each on every len(RATES)-th text.

    In a round each task starts from the same model and trains on its own texts, all their tokens
    `passes` times; what it learnt is averaged over the tasks by their tokens. The driver sees one sum."""
    p = blank(class_n)
    for turn in range(len(RATES)):
        moved = source.mapInArrow(_move(vocabulary, p, class_n, turn, passes), MOVED)
        # in two steps, so that no task adds up the models of all others
        moved = moved.repartition("slice", "slot").mapInArrow(_added, MOVED).repartition("slice").mapInArrow(_added, MOVED)
        parts = sorted((r.slice, r.tokens, r.moved) for r in moved.collect())
        if parts:
            step = np.concatenate([np.frombuffer(x, np.int64) / (SCALE * n) for _, n, x in parts])
            p = _shaped(_flat(p) + step, p)
    return p


def log_norms(p: dict[str, np.ndarray]) -> np.ndarray:
    """ln of the sum over all classes for every pair of classes before, by one matrix product for each far class."""
    out = np.empty((FAR + 1, CLASSES + 1), np.float32)
    for u in range(FAR + 1):
        s = (p["q2"][u] + p["q1"]) @ p["r"].T + p["b"]
        top = s.max(axis=1)
        s -= top[:, None]
        out[u] = top + np.log(np.exp(s, out=s).sum(axis=1))
    return out


def log_probabilities(p: dict[str, np.ndarray], norms: np.ndarray, u: np.ndarray, v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """log10 P(class | the two before) of each token."""
    out = np.empty(len(c))
    for lo in range(0, len(c), 1 << 14):
        a, b, x = (y[lo : lo + (1 << 14)] for y in (u, v, c))
        out[lo : lo + (1 << 14)] = (np.einsum("nd,nd->n", p["q2"][a] + p["q1"][b], p["r"][x]) + p["b"][x] - norms[a, b]) / np.log(10)
    return out


PARTS = "id long, f long, h long, row boolean, times long, n_tokens long, n_known long, logs double, fixed double"


def _score(vocabulary: Vocabulary, params: dict[str, np.ndarray], norms: np.ndarray, ends: int, class_n: np.ndarray, class_v: np.ndarray):
    """Per text one row with what is known here, and one for each distinct word whose count is not.

    logs: the sum of log10(count + 0.5) over its tokens; fixed: the model's part that needs no count."""
    is_own = np.zeros(CLASSES, bool)
    is_own[0] = True
    is_own[vocabulary.own_class] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within = np.log10(class_n + 0.5 * (class_v + 1))
        for batch in batches:
            ids = batch.column(0)
            offsets, data = text_buffers(batch.column(1))
            for lo, hi in chunks(offsets, PIECE):
                words, n = Words(offsets, data, lo, hi), hi - lo
                h = words.hashes()
                cls = vocabulary.classes(words, h)
                doc, two, one, c = sequences(words, cls, n, vocabulary.far)
                fixed = np.bincount(doc, log_probabilities(params, norms, two, one, c), minlength=n)
                alone = is_own[cls]
                fixed -= np.bincount(words.doc[~alone], within[cls[~alone]], minlength=n)
                logs = np.zeros(n) + np.log10(ends + 0.5)
                known = np.full(n, int(ends > 0), np.int64)
                rare = np.ones(len(h), bool)
                if len(vocabulary.h):
                    at = np.minimum(np.searchsorted(vocabulary.h, h), len(vocabulary.h) - 1)
                    rare = vocabulary.h[at] != h
                    found = np.log10(vocabulary.n[at[~rare]] + 0.5)
                    logs += np.bincount(words.doc[~rare], found, minlength=n)
                    known += np.bincount(words.doc[~rare], minlength=n)
                    shared = ~rare & ~alone
                    fixed += np.bincount(words.doc[shared], np.log10(vocabulary.n[at[shared]] + 0.5), minlength=n)
                f = np.array([xxhash.xxh64_intdigest(data[int(offsets[r]) : int(offsets[r + 1])].tobytes(), seed=11) - (1 << 63) for r in range(lo, hi)], np.int64)
                order = np.lexsort((h[rare], words.doc[rare]))
                rh, rd = h[rare][order], words.doc[rare][order]
                new = np.flatnonzero(np.concatenate([[True], (rh[1:] != rh[:-1]) | (rd[1:] != rd[:-1])])) if len(rh) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(rh)))
                rh, rd = rh[new], rd[new]
                m = len(rd)
                nothing = np.zeros(m, np.int64)
                every = np.concatenate([np.arange(n), rd])
                spread = mix(np.arange(n, dtype=np.uint64) + f.view(np.uint64))  # rows without a word meet no count: spread them
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n).take(pa.array(every)), pa.array(f[every]), pa.array(signed(np.concatenate([spread, rh]))), pa.array(np.arange(n + m) < n), pa.array(np.concatenate([np.ones(n, np.int64), times])), pa.array(np.concatenate([words.count + 1, nothing])), pa.array(np.concatenate([known, nothing])), pa.array(np.concatenate([logs, np.zeros(m)])), pa.array(np.concatenate([fixed, np.zeros(m)]))],
                    names=[x.split()[0] for x in PARTS.split(", ")],
                )

    return run


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts(n, ...) with the greatest n, at most `most`: whole bins of a hundredth of ln n, from the top,
    so that no task sends its own `most` rows to be merged."""
    bins = counts.select(F.floor(F.ln("n") * 100).alias("bin")).groupBy("bin").agg(F.count("*").alias("c")).collect()
    least, total = None, 0
    for r in sorted(bins, key=lambda r: -r.bin):
        total += r.c
        if total > most:
            break
        least = r.bin
    return counts.where(F.lit(False)) if least is None else counts.where(F.floor(F.ln("n") * 100) >= least)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """One row per distinct (id, text): id, rows, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(id as text) mod 5 is not 1. Words are counted exactly over the
    training part (a table that grows with the input); then the neural model is trained on every
    token of it, in len(RATES) rounds, where the texts are, and averaged: with more texts, more tasks
    learn. Only a corpus below `least_tokens` is passed over more than once. Then all texts are scored.
    Counts of the up to `frequent` most frequent words are sent to the tasks, a bound of 16 bytes each; the
    others' counts are joined on the word's hash, once for each distinct (text, word). The model
    and its norms (3 MB) have a fixed size, the driver receives one sum of models a round.

    base_score: sum of log10((c + 0.5) / (N + 0.5 * (V + 1))) over words and the end; score: the sum of
    the model's log10 probabilities, normalised over classes and, within a class, over its words and
    one unknown. Null text counts as empty: its only token is the end. `rows` counts the rows that
    share both id and text; ids are cast to long. Without training rows N and V are 0 and the classes are
    equally likely, but for the model's first, random vectors. An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counts = keep(source.mapInArrow(_count_words, "h long, cls int, n long").groupBy("h", "cls").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("cls") == 0, F.col("n"))), F.lit(0)).alias("ends")).first()
    top = most_frequent(counts.where("cls > 0"), frequent).toPandas().sort_values(["n", "h"], ascending=[False, True])
    th = top["h"].to_numpy(np.int64).view(np.uint64)
    first = top.head(OWN)
    own, shared = th[:OWN], first["cls"].to_numpy(np.int64)
    order, own_order = np.argsort(th), np.argsort(own)
    far = np.zeros(CLASSES + 1, np.int64)
    far[1 + OWN : CLASSES] = 1 + COARSE + np.arange(SHARED)
    far[1 : 1 + len(own)] = np.where(np.arange(len(own)) < COARSE, 1 + np.arange(len(own)), shared - OWN + COARSE)
    far[CLASSES] = FAR
    vocabulary = Vocabulary(th[order], top["n"].to_numpy(np.int64)[order], own[own_order], own_order + 1, far)

    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.where("cls > 0").groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_n[r.cls], class_v[r.cls] = r.n, r.v
    np.subtract.at(class_n, shared, first["n"].to_numpy(np.int64))
    np.subtract.at(class_v, shared, 1)
    all_n = class_n.copy()
    all_n[0], all_n[1 : 1 + len(own)] = int(total.ends), first["n"].to_numpy(np.int64)

    params = train(source, vocabulary, all_n, max(1, -(-least_tokens // max(1, int(total.n)))))
    norms = log_norms(params)

    parts = source.mapInArrow(_score(vocabulary, params, norms, int(total.ends), class_n, class_v), PARTS)
    rare = counts.where("cls > 0").select(F.col("h").alias("ch"), F.col("n").alias("c"))
    c = F.coalesce("c", F.lit(0))
    parts = parts.join(rare, (F.col("h") == F.col("ch")) & ~F.col("row"), "left")
    log = F.when(F.col("row"), F.lit(0.0)).otherwise(F.col("times") * F.log10(c + 0.5))
    parts = parts.select("id", "f", F.col("row").cast("long").alias("rows"), "n_tokens", (F.col("n_known") + F.when(~F.col("row") & (c > 0), F.col("times")).otherwise(0)).alias("n_known"), (F.col("logs") + log).alias("logs"), (F.col("fixed") + log).alias("fixed"))
    names = ("rows", "n_tokens", "n_known", "logs", "fixed")
    out = parts.groupBy("id", "f").agg(*[F.sum(x).alias(x) for x in names])
    for x in names[1:]:  # rows that share id and text add up alike
        out = out.withColumn(x, F.col(x) / F.col("rows"))
    whole = F.log10(F.lit(total.n + 0.5 * (total.v + 1)))
    id_text = F.coalesce(F.col("id").cast("string"), F.lit(""))
    return out.select(
        F.col("id").alias(id_col),
        "rows",
        (F.crc32(id_text.cast("binary")) % 5 == 1).alias("held_out"),
        F.col("n_tokens").cast("long"),
        F.col("n_known").cast("long"),
        F.lit(total.n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * whole).alias("base_score"),
        F.col("fixed").alias("score"),
    )
