"""SentencePiece encoding and decoding: batched Viterbi over piece scores in numpy."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from pedolith.llm.common import chunks, mix, text_buffers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
PIECE = 1 << 19
MARK = 0x2581
#: Words, and tokens of theirs, that a process remembers before it starts anew.
REMEMBERED, REMEMBERED_TOKENS = 1 << 19, 1 << 23
#: Code points from which a word is encoded by itself, in windows and with a heap.
LONG = 256
#: Most bytes of a word that is hashed with the others, by blocks of eight.
LONG_BYTES = 64
#: Cells (words times their longest) that advance together.
CELLS = 1 << 15
WINDOW = 1 << 15
#: Tokens decoded at a time.
DECODED = 1 << 18
UNKNOWN_PENALTY = 10.0
_STEP = np.uint64(0x100000001B3)
_MASK = (1 << 22) - 1
_SPACE = 0x20
_MARK_UTF8 = chr(MARK).encode()
#: By bytes of a word in its last block of eight: what to keep of the block.
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


@dataclass
class Model:
    """Piece table in arrays: sorted hashes of the pieces with their ids and scores, and what ids decode to."""

    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    unk_id: int
    unk_score: float
    byte_ids: np.ndarray | None
    decoded: list[bytes]
    pieces: dict[str, tuple[float, int]]
    digest: str

    @classmethod
    def load(cls, path: str = MODEL) -> Model:
        """Reads the file where the driver runs; the arrays travel with the tasks."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        keys, ids, scores, decoded, longest, pieces = [], [], [], [], 1, {}
        bytes_ = np.full(256, -1, np.int32)
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                bytes_[int(piece[3:5], 16)] = i
                decoded.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_unknown(i):
                decoded.append(" ⁇ ".encode())
            elif sp.is_control(i) or sp.is_unused(i):
                decoded.append(b"")
            else:
                points = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
                keys.append(_hash(points))
                ids.append(i)
                scores.append(sp.get_score(i))
                pieces[piece] = sp.get_score(i), i
                longest = max(longest, len(points))
                decoded.append(piece.replace(chr(MARK), " ").encode())
        keys = np.array(keys, np.uint64)
        order = np.argsort(keys)
        assert len(np.unique(keys)) == len(keys)
        scores = np.array(scores, np.float64)
        digest = hashlib.sha256(repr((decoded, sorted(pieces.items()), bytes_.tolist(), sp.unk_id())).encode()).hexdigest()
        return cls(keys[order], np.array(ids, np.int32)[order], scores[order], longest, sp.unk_id(), float(scores.min()) - UNKNOWN_PENALTY, bytes_ if (bytes_ >= 0).all() else None, decoded, pieces, digest)


def _hash(points: np.ndarray) -> int:
    h = np.zeros(1, np.uint64)
    for x in points:
        h = h * _STEP + np.uint64(x) + np.uint64(1)
    return int(mix(h ^ np.uint64(len(points) << 56))[0])


def _word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes, none of them 0, of byte spans of `buf`, which goes on for eight bytes past the last: by blocks of
    eight bytes, spans of more than LONG_BYTES by themselves."""
    size = end - start
    blocks = np.lib.stride_tricks.as_strided(buf[:8].view(np.uint64), (max(1, len(buf) - 7),), (1,))
    h = mix(size.astype(np.uint64))
    h = mix(h ^ (blocks[start] & _KEEP[np.minimum(size, 8)])) if len(size) else h
    more = np.flatnonzero(size > 8)
    for k in range(8, LONG_BYTES, 8):
        more = more[size[more] > k]
        if not len(more):
            break
        h[more] = mix(h[more] * _STEP ^ (blocks[start[more] + k] & _KEEP[np.minimum(size[more] - k, 8)]))
    for i in np.flatnonzero(size > LONG_BYTES):
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]], digest_size=8).digest(), "little")
    h[h == 0] = 1
    return h


class Encoder:
    """method "viterbi": the path of the highest sum of scores. method "merges": the merge order of BPE
    model files, which the file's own library follows. Several methods share the words and their pieces."""

    def __init__(self, model: Model, *methods: str):
        self.m, self.methods = model, methods or ("viterbi",)
        self.present = np.zeros(_MASK + 1, bool)
        self.present[(model.keys & np.uint64(_MASK)).astype(np.int64)] = True
        # pairs of bytes that no piece holds: pieces end between them, if a character does
        self.apart = np.ones((256, 256), bool)
        for piece in model.pieces:
            b = np.frombuffer(piece.replace(chr(MARK), " ").encode(), np.uint8)
            self.apart[b[:-1], b[1:]] = False
        self.apart[:, 0x80:0xC0] = False
        self.apart = self.apart.ravel()
        self.clear()

    def clear(self) -> None:
        """Word 0 is none: its hash is 0, and empty slots lead to it."""
        self.known = np.zeros(1, np.uint64)
        self.slots = np.zeros(1 << 12, np.int32)
        self.begin, self.count = ([np.zeros(1, np.int64) for _ in self.methods] for _ in range(2))
        self.tokens = [np.zeros(0, np.int32) for _ in self.methods]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the words of these hashes, 0 for those not remembered: open addressing, all at once."""
        mask = np.uint64(len(self.slots) - 1)
        at = (h & mask).astype(np.int64)
        found = self.slots[at]
        todo = np.flatnonzero(self.known[found] != h)
        todo = todo[found[todo] > 0]
        while len(todo):
            at[todo] = (at[todo] + 1) & int(mask)
            found[todo] = self.slots[at[todo]]
            todo = todo[(found[todo] > 0) & (self.known[found[todo]] != h[todo])]
        return found

    def remember(self, h: np.ndarray) -> None:
        """Number words of new, distinct hashes; the slots are at least twice the words."""
        first = len(self.known)
        self.known = np.concatenate([self.known, h])
        if 2 * len(self.known) > len(self.slots):
            self.slots = np.zeros(1 << (4 * len(self.known)).bit_length(), np.int32)
            first = 1
        number = np.arange(first, len(self.known), dtype=np.int32)
        mask = len(self.slots) - 1
        at = (self.known[number] & np.uint64(mask)).astype(np.int64)
        while len(number):
            free = np.flatnonzero(self.slots[at] == 0)
            self.slots[at[free]] = number[free]
            left = self.slots[at] != number
            number, at = number[left], (at[left] + 1) & mask

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: no piece) and scores of substring hashes: a bit table first, then the sorted keys."""
        m = self.m
        ids, scores = np.full(h.shape, -1, np.int32), np.full(h.shape, -np.inf)
        maybe = np.nonzero(self.present[(h & np.uint64(_MASK)).astype(np.int64)])
        x = h[maybe]
        at = np.minimum(np.searchsorted(m.keys, x), len(m.keys) - 1)
        hit = m.keys[at] == x
        where = tuple(a[hit] for a in maybe)
        ids[where], scores[where] = m.ids[at[hit]], m.scores[at[hit]]
        return ids, scores

    def lattice(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of all pieces in words (rows of code points; what follows a shorter one has ends of its own): by
        piece length, row, end."""
        m = self.m
        n, size = words.shape
        top = min(m.longest, size)
        score = np.full((top, n, size + 1), -np.inf)
        ident = np.full((top, n, size + 1), -1, np.int32)
        h = np.zeros((n, size), np.uint64)
        for length in range(1, top + 1):
            h = h[:, : size - length + 1] * _STEP + words[:, length - 1 :] + np.uint64(1)
            ids, s = self.probe(mix(h ^ np.uint64(length << 56)))
            if length == 1:
                s[ids < 0] = m.unk_score
                ids[ids < 0] = m.unk_id
            score[length - 1, :, length:], ident[length - 1, :, length:] = s, ids
        return score, ident

    def merged(self, words: np.ndarray, sizes: np.ndarray | None = None, lattice: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As viterbi(), by merging in all rows at once the adjacent pair of the best score, the first of
        equal ones, until no pair makes a piece."""
        score, ident = lattice or self.lattice(words)
        top, n, size = score.shape[0], *words.shape
        count = np.full(n, size) if sizes is None else sizes.copy()
        edge = np.minimum(np.arange(size + 2), count[:, None])
        live = np.arange(n)
        while len(live):
            width = int(count[live].max())
            e = edge[live, : width + 2] if width + 2 <= size + 2 else edge[live]
            span = np.minimum(e[:, 2:] - e[:, :-2], top)
            s = score[span - 1, live[:, None], e[:, 2:]]
            s[(e[:, 2:] - e[:, :-2] > top) | (np.arange(e.shape[1] - 2) >= count[live][:, None] - 1)] = -np.inf
            pick = s.argmax(axis=1) if s.shape[1] else np.zeros(len(live), np.int64)
            can = s[np.arange(len(live)), pick] > -np.inf if s.shape[1] else np.zeros(len(live), bool)
            live, pick = live[can], pick[can]
            if len(live):
                e = edge[live]
                shifted = np.concatenate([e[:, 1:], e[:, -1:]], axis=1)
                edge[live] = np.where(np.arange(size + 2) > pick[:, None], shifted, e)
                count[live] -= 1
        row = np.repeat(np.arange(n), count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start, end = edge[row, k], edge[row, k + 1]
        return self._spelt(words, row, ident[end - start - 1, row, end], end)

    def viterbi(self, words: np.ndarray, sizes: np.ndarray | None = None, lattice: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Words as rows of code points (`sizes` of each; else all) -> flat tokens, tokens of each row.

        All rows advance together: at each end the best of all piece lengths is taken at once, the
        longest of equal ones, and its length and id kept as backpointer."""
        score, ident = lattice or self.lattice(words)
        top, n, size = score.shape[0], *words.shape
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, size + 1), np.int32)
        for end in range(1, size + 1):
            k = min(top, end)
            cand = score[:k, :, end][::-1] + best[:, end - k : end].T  # longest piece first
            pick = cand.argmax(axis=0)
            best[:, end] = cand[pick, np.arange(n)]
            back[:, end] = k - pick
        rows, ids, ends = [], [], []
        live, at = np.arange(n), np.full(n, size) if sizes is None else sizes
        while len(live):
            step = back[live, at]
            rows.append(live)
            ids.append(ident[step - 1, live, at])
            ends.append(at)
            at = at - step
            live, at = live[at > 0], at[at > 0]
        row, tok, end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, ids, ends))
        order = np.lexsort((end, row))
        return self._spelt(words, row[order], tok[order], end[order])

    def long_viterbi(self, word: np.ndarray) -> np.ndarray:
        """viterbi() of one word of any length: the lattice a window at a time, only its pieces walked."""
        n, top = len(word), self.m.longest
        best, back, tok = [0.0] + [-np.inf] * n, np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
        for lo in range(0, n, WINDOW):
            base, hi = max(0, lo - top + 1), min(n, lo + WINDOW)
            score, ident = (x[:, 0, lo - base + 1 :] for x in self.lattice(word[None, base:hi]))
            size, end = np.nonzero(score > -np.inf)
            order = np.lexsort((-size, end))  # by end, longest piece first
            size, end = size[order], end[order]
            found = zip((end + lo + 1).tolist(), (size + 1).tolist(), score[size, end].tolist(), ident[size, end].tolist(), strict=True)
            for e, k, s, t in found:
                s += best[e - k]
                if s > best[e]:
                    best[e], back[e], tok[e] = s, k, t
        ends, at = [], n
        while at:
            ends.append(at)
            at -= int(back[at])
        ends = np.array(ends[::-1], np.int64)
        return self._spelt(word[None], np.zeros(len(ends), np.int64), tok[ends], ends)[0]

    def long_merges(self, word: np.ndarray) -> np.ndarray:
        """merged() of one word of any length: pairs in a heap, n log n. A pair is a span of two adjacent pieces; one
        whose pieces have changed is passed over unless they still make that span."""
        pieces, top = self.m.pieces, self.m.longest
        text = word.astype(np.uint32).tobytes().decode("utf-32-le", "replace")
        n = len(text)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n
        heap = [(-pieces[text[i : i + 2]][0], i, i + 2) for i in range(n - 1) if text[i : i + 2] in pieces]
        heapq.heapify(heap)

        def offer(i: int, e: int) -> None:
            if e - i <= top and (p := pieces.get(text[i:e])) is not None:
                heapq.heappush(heap, (-p[0], i, e))

        while heap:
            _, i, e = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != e:
                continue
            alive[j], end[i] = 0, e
            if e < n:
                before[e] = i
                offer(i, end[e])
            if i:
                offer(before[i], e)
        start = np.flatnonzero(np.frombuffer(bytes(alive), np.uint8))
        stop = np.append(start[1:], n)
        unknown = (0.0, self.m.unk_id)
        tok = np.array([pieces.get(text[i:e], unknown)[1] for i, e in zip(start.tolist(), stop.tolist(), strict=True)], np.int32)
        return self._spelt(word[None], np.zeros(len(start), np.int64), tok, stop)[0]

    def _spelt(self, words: np.ndarray, row: np.ndarray, tok: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters as the pieces of their bytes."""
        m, n = self.m, len(words)
        if m.byte_ids is not None and (tok == m.unk_id).any():
            unknown = np.flatnonzero(tok == m.unk_id)
            spelt = [chr(words[row[u], end[u] - 1]).encode("utf-8", "replace") for u in unknown]
            width = np.ones(len(tok), np.int64)
            width[unknown] = [len(b) for b in spelt]
            row, out = np.repeat(row, width), np.repeat(tok, width)
            first = np.cumsum(width) - width
            for u, b in zip(unknown, spelt, strict=True):
                out[first[u] : first[u] + len(b)] = m.byte_ids[list(b)]
            tok = out
        return tok.astype(np.int32), np.bincount(row, minlength=n)

    def learn(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> None:
        """Encode the words at start..end and remember them by hash."""
        size = end - start
        total = np.cumsum(size)
        text = buf[np.repeat(start - (total - size), size) + np.arange(total[-1])]
        points = np.frombuffer(text.tobytes().decode().replace(" ", chr(MARK)).encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
        begin = chars[total - size]
        size = chars[total] - begin
        order = np.argsort(size, kind="stable")
        by_size = size[order]
        counts = [np.zeros(len(h), np.int64) for _ in self.methods]
        tokens: list[list[np.ndarray]] = [[] for _ in self.methods]
        short = int(np.searchsorted(by_size, LONG, "right"))
        i = 0
        while i < short:
            # as many words as fit, each with the cells of the batch's longest
            cells = by_size[i : min(short, i + CELLS)] * np.arange(1, min(short - i, CELLS) + 1)
            j = i + max(1, int(np.searchsorted(cells, CELLS, "right")))
            rows, sizes = order[i:j], by_size[i:j]
            at = begin[rows][:, None] + np.arange(int(sizes[-1]))
            block = points[np.minimum(at, len(points) - 1)].astype(np.uint64)
            lattice = self.lattice(block)
            for k, method in enumerate(self.methods):
                tok, counts[k][rows] = (self.viterbi if method == "viterbi" else self.merged)(block, sizes, lattice)
                tokens[k].append(tok)
            i = j
        for row in order[short:].tolist():
            word = points[begin[row] : begin[row] + size[row]].astype(np.uint64)
            for k, method in enumerate(self.methods):
                tok = (self.long_viterbi if method == "viterbi" else self.long_merges)(word)
                counts[k][row] = len(tok)
                tokens[k].append(tok)
        for k, count in enumerate(counts):
            first = np.zeros(len(h), np.int64)
            first[order] = len(self.tokens[k]) + np.cumsum(count[order]) - count[order]
            self.tokens[k] = np.concatenate([self.tokens[k], *tokens[k]])
            self.begin[k], self.count[k] = np.concatenate([self.begin[k], first]), np.concatenate([self.count[k], count])
        self.remember(h)

    def encode_rows(self, offsets: np.ndarray, data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each method the flat tokens of all rows of UTF-8 and where each row's begin (one more than rows).

        Words are spans of bytes, a space for each U+2581 as before each text, between which no piece lies: they begin
        where a pair of bytes is in no piece. What is no UTF-8 becomes U+FFFD first."""
        base, stop = int(offsets[0]), int(offsets[-1])
        raw = data[base:stop]
        offsets = offsets - base
        text = raw.tobytes()
        filled = np.diff(offsets) > 0
        if _MARK_UTF8 in text or not _is_text(text) or ((raw[offsets[:-1][filled]] & 0xC0) == 0x80).any():
            rows = [text[a:b].decode("utf-8", "replace").replace(chr(MARK), " ").encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            raw = np.frombuffer(b"".join(rows), np.uint8)
            offsets = np.cumsum([0, *map(len, rows)])
        if not filled.any():
            return [(np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)) for _ in self.methods]
        firsts = offsets[:-1][filled] + np.arange(int(filled.sum()))
        n = len(raw) + len(firsts)
        own = np.ones(n + 8, bool)
        own[firsts] = own[n:] = False
        buf = np.full(n + 8, _SPACE, np.uint8)
        buf[own] = raw
        opens = np.zeros(n, bool)
        opens[1:] = self.apart[(buf[: n - 1].astype(np.uint16) << 8) | buf[1:n]]
        opens[firsts] = True
        start = np.flatnonzero(opens)
        end = np.append(start[1:], n)
        h = _word_hashes(buf, start, end)
        if len(self.known) > REMEMBERED or max(map(len, self.tokens)) > REMEMBERED_TOKENS:
            self.clear()
        word = self.find(h)
        new = np.flatnonzero(word == 0)
        if len(new):
            distinct, sample = np.unique(h[new], return_index=True)
            self.learn(buf, start[new[sample]], end[new[sample]], distinct)
            word[new] = self.find(h[new])
        edge = np.concatenate([[0], np.cumsum(filled)])
        edge = np.append(np.searchsorted(start, firsts), len(start))[edge]
        out = []
        for begin, count, tokens in zip(self.begin, self.count, self.tokens, strict=True):
            many = count[word]
            total = np.concatenate([[0], np.cumsum(many)])
            flat = np.repeat(begin[word] - total[:-1], many) + np.arange(total[-1])
            out.append((tokens[flat], total[edge]))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat tokens of all texts, by the first method, and the number of each text's."""
        rows = [t.encode("utf-8", "replace") for t in texts]
        tokens, edge = self.encode_rows(np.cumsum([0, *map(len, rows)]), np.frombuffer(b"".join(rows), np.uint8))[0]
        return tokens, np.diff(edge)


_OWN: dict[tuple[str, tuple[str, ...]], Encoder] = {}


def _encoder(model: Model, methods: tuple[str, ...]) -> Encoder:
    """The process's encoder of a model: words stay remembered from task to task where Spark reuses its workers."""
    if (model.digest, methods) not in _OWN:
        _OWN.clear()
        _OWN[model.digest, methods] = Encoder(model, *methods)
    return _OWN[model.digest, methods]


def decode_ids(model: Model, ids: list[int] | np.ndarray) -> str:
    out = b"".join(map(model.decoded.__getitem__, ids))
    return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL, merges: bool = False, keep_cols: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, text, `keep_cols`, token_ids (array<int>); with `merges` also merge_ids.

    token_ids: the best path through the pieces of the model file by the sum of their scores; the text
    gets a space before it, spaces become U+2581, characters without a piece become their bytes'
    pieces (where the model has them, else the unknown id). merge_ids: what the merge order of a
    BPE file gives, equal to its own library's. Words, which end where two bytes follow each other that do so in
    no piece, are encoded once per process and remembered (REMEMBERED at most, then anew), both ways from one lattice. Those of up to
    LONG code points advance together, sorted by length; longer ones, as in text without spaces, by
    themselves, in time n log n and memory in proportion to their length.

    Null and empty texts have no tokens. Rows stand alone: repeated rows repeat; an empty table gives an
    empty result; columns other than those named are ignored; ids are cast to long.
    """
    model = Model.load(model_path)
    methods = ("viterbi", "merges") if merges else ("viterbi",)
    fields = ["token_ids", "merge_ids"][: len(methods)]
    names = ["id", "text", *(f"kept{i}" for i in range(len(keep_cols))), *fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model, methods)
        for batch in batches:
            offsets, data = text_buffers(batch.column(1))
            for lo, hi in chunks(offsets, PIECE):
                coded = encoder.encode_rows(offsets[lo : hi + 1], data)
                lists = [pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(tokens, pa.int32())) for tokens, edge in coded]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), *lists], names=names)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"kept{i}") for i, c in enumerate(keep_cols)])
    schema = StructType([*source.schema.fields, *[StructField(c, ArrayType(IntegerType())) for c in fields]])
    return source.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "text": text_col, **{f"kept{i}": c for i, c in enumerate(keep_cols)}})


def _texts(model: Model):
    """A list column of ids -> the texts, by takes of the pieces' bytes; rows with bytes that are no UTF-8 by themselves."""
    size = np.array([len(b) for b in model.decoded], np.int64)
    begin = np.cumsum(size) - size
    blob = np.frombuffer(b"".join(model.decoded), np.uint8)
    loose = np.array([not _is_text(b) for b in model.decoded])

    def some(ids: np.ndarray, n: np.ndarray, null: np.ndarray) -> pa.Array:
        take = size[ids]
        total = np.concatenate([[0], np.cumsum(take)])
        data = blob[np.repeat(begin[ids] - total[:-1], take) + np.arange(total[-1])]
        first = np.concatenate([[0], np.cumsum(n)])
        edge = total[first]
        space = np.flatnonzero(edge[1:] > edge[:-1])
        space = space[data[edge[space]] == 32]
        stay = np.ones(len(data), bool)
        stay[edge[space]] = False
        shift = np.zeros(len(n) + 1, np.int64)
        shift[space + 1] = 1
        odd = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(loose[ids])])[first]) > 0)
        if len(odd):
            texts = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((edge - np.cumsum(shift)).astype(np.int32).tobytes()), pa.py_buffer(data[stay].tobytes())]).to_pylist()
            return pa.array([None if z else t.decode("utf-8", "replace") for t, z in zip(texts, null, strict=True)], pa.string())
        valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
        return pa.Array.from_buffers(pa.string(), len(n), [valid, pa.py_buffer((edge - np.cumsum(shift)).astype(np.int32).tobytes()), pa.py_buffer(data[stay].tobytes())])

    def run(column: pa.Array) -> pa.Array:
        null = np.asarray(column.is_null())
        n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = column.flatten().to_numpy(zero_copy_only=False)
        edge = np.concatenate([[0], np.cumsum(n)])
        out = [some(ids[edge[lo] : edge[hi]], n[lo:hi], null[lo:hi]) for lo, hi in chunks(edge, DECODED)]
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return run


def _is_text(b: bytes) -> bool:
    try:
        b.decode()
    except UnicodeDecodeError:
        return False
    return True


def decode(encoded: DataFrame, ids_col: str = "token_ids", out_col: str = "decoded", model_path: str = MODEL) -> DataFrame:
    """encoded with the text that its token ids stand for in `out_col`, which replaces a column of that name.

    Null ids give null, no ids the empty text. Rows stand alone: repeated rows and ids repeat, an empty
    table stays empty, other columns pass through as they are. A space at the start, which encoding adds, goes; bytes
    that make no UTF-8 become U+FFFD."""
    run = _texts(Model.load(model_path))

    @F.arrow_udf("string")
    def text_of(ids: pa.Array) -> pa.Array:
        return run(ids)

    return encoded.withColumn(out_col, text_of(F.col(ids_col)))
