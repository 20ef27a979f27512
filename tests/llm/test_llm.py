"""The ten operators against brute force, and their defined results on odd rows."""

import hashlib
import itertools
import json
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pedolith.llm import chat, common, licenses, lm, minhash, mixing, quality, repeats
from pedolith.llm import exact_dedup as exact
from pedolith.llm import sentencepieces as sp

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, source string"


def prose(rng, n, letters="abcdefgh", stop=0.1):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) + ("." if rng.random() < stop else "") for _ in range(n))


def odd_rows():
    """Nulls, empty and white texts, repeated rows, ties, one long text."""
    rng = random.Random(5)
    long = prose(rng, 6000)
    a = prose(rng, 80)
    return [(1, a, "s"), (1, a, "s"), (2, a.replace(" ", "\n "), "s"), (3, None, None), (4, "", "t"), (5, " \t\n", "t"), (None, a, "s"), (None, None, None), (6, long, "u"), (7, long + " x", "u"), (8, "one", "t"), (9, "ONE", "t"), (10, "é ß\x85x \U0001f600", "t")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(spark, odd):
    """Extra columns under names that operators use inside or return."""
    return odd.withColumns({c: F.lit(1) for c in ("id", "uid", "n", "p", "sha", "kept", "size", "measures", "failed", "copies", "h", "f", "taken", "labels", "score", "token_ids", "node", "comp", "TARGET", "_bits", "_word", "slot")})


OPERATORS = {
    "exact": lambda d: exact.exact_dedup(d),
    "spans": lambda d: repeats.sentence_span_dedup(d),
    "licenses": lambda d: licenses.scan(d),
    "pieces": lambda d: sp.encode(d),
    "lm": lambda d: lm.score(d, least_tokens=0),
    "suffixes": lambda d: repeats.suffix_array_dedup(d),
    "quality": lambda d: quality.quality(d),
    "minhash": lambda d: minhash.near_duplicates(d),
    "mix": lambda d: mixing.mix(d),
    "decode": lambda d: sp.decode(sp.encode(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_empty_and_clashing_input(odd, none, clashing, name):
    op = OPERATORS[name]
    rows = op(odd).collect()
    n = sum(r.rows for r in rows) if name == "lm" else len(rows)
    assert n == len(odd_rows())
    assert op(none).count() == 0
    if name != "quality":
        plain, extra = op(odd), op(clashing)
        assert plain.columns == extra.columns
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, extra.collect()))
    else:
        out = op(clashing)
        assert len(set(c.lower() for c in out.columns)) == len(out.columns)
        assert [r[out.columns[-1]] for r in out.select(out.columns[-1]).collect()].count(True) == sum(r.kept for r in rows)


# --- 1 ----------------------------------------------------------------------------------------


def test_exact_dedup_against_brute_force(spark):
    rng = random.Random(1)
    texts = [prose(rng, 30) for _ in range(12)] + [None, "", "a b", "a  b", "a\tb"]
    rows = [(i, rng.choice(texts)) for i in range(300)]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (1 << 20, 0):  # the broadcast way and the other
        got = {r.doc_id: r for r in exact.exact_dedup(df, digest_all=True, broadcast_bytes=limit).collect()}
        for i, t in rows:
            g = groups[norm(t)]
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(g), len(g), i == min(g))
            assert got[i].text_sha256 == hashlib.sha256(norm(t).encode()).hexdigest()
    lazy = exact.exact_dedup(df).where("group_size > 1 and text_sha256 is null")
    assert lazy.count() == 0


def test_exact_dedup_keeps_one_of_repeated_rows(odd):
    got = exact.exact_dedup(odd).collect()
    by_text = defaultdict(list)
    for r in got:
        by_text[r.text_sha256 or r.doc_id].append(r)
    assert sum(r.kept for r in got) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in odd_rows()})
    assert sum(r.kept for r in got if r.doc_id == 1) == 1


# --- 2 ----------------------------------------------------------------------------------------

TOOLS = "select 'f' as name, array(named_struct('arg', 'x', 'type', 'string', 'required', true), named_struct('arg', 'n', 'type', 'integer', 'required', false)) as params"


def call(i, args, deps=None, name="f"):
    c = {"id": i, "name": name, "arguments": args}
    return c if deps is None else {**c, "depends_on": deps}


def chat_rows(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.link_tool_calls(df, spark.sql(TOOLS)).orderBy("conv_id", "order_turn", "order_depth", "turn", "idx").collect()
    for r in out:
        json.loads(r.json)
    return out


def test_calls_link_validate_and_order(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "early"})),
        (1, 2, "assistant", json.dumps({"content": "c", "tool_calls": [call("a", {"x": "s", "n": 1}), call("b", {"x": 3, "q": 1}, ["a"]), call("a", {}, name="g")]})),
        (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": "?"})),
        (2, 0, "assistant", json.dumps({"tool_calls": [call("a", "no object")]})),
        (3, 0, "user", "{not json"),
        (None, None, None, None),
    ]
    out = chat_rows(spark, rows)
    of = {(r.conv_id, r.turn, r.idx): r for r in out}
    assert of[1, 2, 1].status == of[1, 1, 0].status == "linked" and of[1, 2, 2].status == "unanswered"
    assert of[1, 2, 3].status == "duplicate" and of[1, 3, 0].status == "orphan"
    assert of[1, 2, 1].errors == [] and of[1, 2, 2].errors == ["q: unknown", "x: not string"] and of[1, 2, 3].errors == ["name: unknown tool"]
    assert of[2, 0, 1].errors == ["arguments: no object"]
    order = [(r.turn, r.idx) for r in out if r.conv_id == 1]
    assert order.index((2, 1)) < order.index((1, 0)) < order.index((2, 2))
    assert of[1, 2, 1].json == '{"arguments":{"n":1,"x":"s"},"call_id":"a","kind":"call","name":"f","role":"assistant"}'
    assert json.loads(of[3, 0, 0].json)["content"] == "{not json"


def test_order_is_topological_and_cycles_end(spark):
    rng = random.Random(3)
    rows = []
    for c in range(6):
        names = [f"k{i}" for i in range(8)]
        deps = {n: [m for m in names[:i] if rng.random() < 0.4] for i, n in enumerate(names)}
        turns = list(range(16))
        rng.shuffle(turns)
        for i, n in enumerate(names):
            rows.append((c, turns[2 * i], "assistant", json.dumps({"tool_calls": [call(n, {"x": "v"}, deps[n])]})))
            rows.append((c, turns[2 * i + 1], "tool", json.dumps({"tool_call_id": n, "content": n})))
        out = None
    rows.append((99, 0, "assistant", json.dumps({"tool_calls": [call("p", {"x": "v"}, ["q"]), call("q", {"x": "v"}, ["p"])]})))
    out = chat_rows(spark, rows)
    for c in range(6):
        seen_calls, seen_results = set(), set()
        for r in out:
            if r.conv_id != c or r.kind == "message":
                continue
            assert not r.on_cycle
            if r.kind == "result":
                assert r.call_id in seen_calls
                seen_results.add(r.call_id)
            else:
                text = next(t for cc, turn, _, t in rows if cc == c and turn == r.turn)
                assert set(json.loads(text)["tool_calls"][0]["depends_on"]) <= seen_results
                seen_calls.add(r.call_id)
    assert any(r.on_cycle for r in out if r.conv_id == 99)


def test_plain_conversations_become_calls_of_every_kind(spark, data):
    df = spark.read.parquet(f"{data}/sf0.01/conversations.parquet")
    out = chat.link_tool_calls(chat.turns_as_calls(df), spark.sql(chat.REPLY)).collect()
    rows = {(r.conv_id, r.turn): r for r in df.collect()}
    case = lambda c, t: (7 * c + 13 * t) % 16
    calls = {(r.conv_id, r.turn) for r in out if r.kind == "call" and r.idx == 1}
    assert calls == {k for k, r in rows.items() if r.role == "user"}
    wrong = {0: ["turn: missing"], 1: ["turn: not integer"], 2: ["loud: unknown"], 3: ["name: unknown tool"], 4: ["arguments: no object"]}
    assert all(r.errors == wrong.get(case(r.conv_id, r.turn), []) for r in out if r.kind == "call" and r.idx == 1)
    answered = Counter()
    for (c, t), r in sorted(rows.items()):
        if r.role == "assistant":
            answered[{7: (c, t, None), 8: (c, t - 3)}.get(case(c, t), (c, t - 1))] += 1
    linked = {(r.conv_id, int(r.call_id.split(":")[1])) for r in out if r.kind == "call" and r.status == "linked"}
    assert linked == {k for k in calls if answered[k]}
    kinds = Counter((r.kind, r.status) for r in out)
    assert all(kinds[k] for k in (("call", "linked"), ("call", "unanswered"), ("call", "duplicate"), ("result", "linked"), ("result", "orphan"), ("result", "duplicate")))
    assert not any(r.on_cycle for r in out) and sum(r.order_depth > 0 for r in out) > 20
    place = {(r.conv_id, r.call_id, r.kind): (r.order_turn, r.order_depth, r.turn, r.idx) for r in out if r.status in ("linked", "unanswered")}
    for (c, i, kind), at in place.items():
        if kind == "result":
            assert place[c, i, "call"] < at
    for c, t in calls:
        later = f"{c}:{t + 2}"
        if case(c, t) == 6 and (c, later, "call") in place:
            assert place[c, f"{c}:{t}", "call"] > place.get((c, later, "result"), place[c, later, "call"])
    assert chat.link_tool_calls(df.limit(0), spark.sql(TOOLS)).count() == 0


def test_chat_on_repeated_rows_ties_and_nulls(spark):
    ask, answer = json.dumps({"tool_calls": [call("a", {"x": "v"})]}), json.dumps({"tool_call_id": "a", "content": "r"})
    other = json.dumps({"tool_calls": [call("a", {"x": "w"})]})
    long = "y " * 50_000
    rows = [(1, 1, "assistant", ask), (1, 1, "assistant", ask), (1, 2, "tool", answer), (1, 2, "tool", answer), (1, 2, "tool", answer)]
    rows += [(2, 1, "assistant", ask), (2, 1, "assistant", other), (None, None, None, None), (None, 1, "user", ""), (3, 0, "user", long)]
    out = chat_rows(spark, rows)
    of = lambda c, kind: Counter(r.status for r in out if r.conv_id == c and r.kind == kind)
    assert of(1, "call") == {"linked": 1, "duplicate": 1} and of(1, "result") == {"linked": 1, "duplicate": 2}
    assert of(2, "call") == {"unanswered": 1, "duplicate": 1} and of(None, "message") == {"plain": 2}
    assert len(out) == 5 + 2 + 2 + 2 + 3
    assert any(r.conv_id == 3 and json.loads(r.json)["content"] == long for r in out)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    extra = df.withColumns({c: F.lit(1) for c in ("uid", "here", "status", "errors", "kind", "place", "tool", "json", "content")})
    plain, more = (chat.link_tool_calls(x, spark.sql(TOOLS)) for x in (df, extra))
    assert plain.columns == more.columns and Counter(map(repr, plain.collect())) == Counter(map(repr, more.collect()))
    cases = chat.link_tool_calls(chat.turns_as_calls(df.withColumn("role", F.lit("user"))), spark.sql(chat.REPLY))
    assert cases.where("kind = 'message'").count() == len(rows)


# --- 3, 7 -------------------------------------------------------------------------------------


def planted(seed):
    """Passages of 60 words in odd documents, first in 1, 3, 5, 7, 9; one passage twice in one document."""
    rng = random.Random(seed)
    passages = [prose(rng, 60) for _ in range(5)]
    docs = []
    for i in range(60):
        a, b = prose(rng, rng.randint(0, 120)), prose(rng, rng.randint(0, 120))
        docs.append((i, f"{a}. {passages[i % 5]}. {b}" if i % 2 else f"{a} {b}", "s"))
    docs.append((100, passages[0] + " " + prose(rng, 5) + ". " + passages[0], "s"))
    return docs, passages


def covered(text, passage):
    return sum(w in set(text.split()) for w in set(passage.split())) / len(set(passage.split()))


@pytest.mark.parametrize("op", [repeats.sentence_span_dedup, repeats.suffix_array_dedup])
def test_repeated_passages_go_and_first_ones_stay(spark, op):
    docs, passages = planted(3)
    out = {r.doc_id: r for r in op(spark.createDataFrame(docs, SCHEMA)).collect()}
    for i, text, _ in docs:
        words = text.split()
        if i < 100 and (i % 2 == 0 or i < 11):
            assert out[i].words_removed == 0 and out[i].clean_text == text
            continue
        assert out[i].words_removed > 0
        left = out[i].clean_text.split()
        assert len(left) == len(words) - out[i].words_removed
        if op is repeats.suffix_array_dedup and i < 100:  # exactly the passage, and a mark beside it at most
            assert 60 <= out[i].words_removed <= 60
            assert covered(out[i].clean_text, passages[i % 5]) < 0.6


def test_fingerprints_are_the_same_in_numpy_and_spark(spark):
    import pyarrow as pa

    texts = [None, "", "a", "é ß", "1234567", "12345678", "x" * 31, "x" * 32, "x" * 33, "\U0001f600 \x85 " * 4001, "abc " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = repeats.fingerprints(*common.text_buffers(pa.array(texts))).tolist()
    assert [r.f for r in repeats._fingerprinted(df).orderBy("id").collect()] == want


def test_sentence_runs_against_brute_force(spark):
    docs, _ = planted(8)
    text_of = {i: t for i, t, _ in docs}
    def parts(t):
        out, now = [], []
        for w in t.lower().split():
            now.append(w)
            if w[-1] in ".!?":
                out.append(now)
                now = []
        return out + ([now] if now else [])
    first, cut = {}, defaultdict(set)
    for i in sorted(text_of):
        s = parts(text_of[i])
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                n = sum(map(len, s[a:b]))
                if (b - a >= 2 and n >= 20) or (b - a == 1 and n >= 25):
                    key = tuple(itertools.chain(*s[a:b])), b - a
                    if first.setdefault(key, (i, a)) != (i, a):
                        cut[i] |= set(range(a, b))
    got = {r.doc_id: r for r in repeats.sentence_span_dedup(spark.createDataFrame(docs, SCHEMA)).collect()}
    for i in text_of:
        assert got[i].n_removed == len(cut[i]) and got[i].n_sentences == len(parts(text_of[i]))


def test_sentence_runs_of_every_length_and_end(spark):
    rng = random.Random(12)
    sentence = lambda n: prose(rng, n, stop=0) + "."
    pair, tail = f"{sentence(30)} {sentence(24)}", f"{sentence(12)} {sentence(12)} {sentence(3)}"
    docs = [(1, f"{sentence(9)} {pair} {sentence(9)}", "s"), (2, f"{sentence(8)} {pair} {sentence(8)}", "s"), (3, tail, "s"), (4, tail, "s")]
    bits = [sentence(n) for n in (2, 3, 5, 9, 12, 18, 24, 26, 30)]
    docs += [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(1, 12))), "s") for i in range(10, 60)]
    first, cut = {}, defaultdict(set)
    for i, text, _ in docs:
        s = re.findall(r"[^.]+[.]", text)
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                n = sum(len(x.split()) for x in s[a:b])
                if n >= (20 if b - a >= 2 else 25):
                    key = tuple(x.strip() for x in s[a:b])
                    if first.setdefault(key, (i, a)) != (i, a):
                        cut[i] |= set(range(a, b))
    assert len(cut[2]) == 2 and len(cut[4]) == 3
    got = {r.doc_id: r for r in repeats.sentence_span_dedup(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert {i: got[i].n_removed for i in got} == {i: len(cut[i]) for i in got}


def kept_suffixes(docs, k=3, window=16, length=32):
    """Places (id, p) of the retained suffixes by their first words, from the operator's own minimisers."""
    import pyarrow as pa

    by = defaultdict(list)
    for i, text, _ in docs:
        offsets, data = common.text_buffers(pa.array([text]))
        words = common.Words(offsets, data, 0, 1)
        w = text.lower().split()
        for p in repeats.minimisers(words, words.hashes(), k, window).tolist():
            if p + length <= len(w):
                by[tuple(w[p : p + length])].append((i, p))
    return by


def suffix_cuts(docs, window=16, length=32):
    """Words to remove by the docstring, all pairs of occurrences compared."""
    w = {i: t.lower().split() for i, t, _ in docs}
    by = {key: sorted(x) for key, x in kept_suffixes(docs).items() if len(x) > 1}
    again = defaultdict(list)
    for key, places in by.items():
        for i, p in places[1:]:
            again[i].append((p, key))
    cut, ends = defaultdict(set), {1: defaultdict(set), -1: defaultdict(set)}
    for i, x in again.items():
        x.sort()
        for n, (p, key) in enumerate(x):
            cut[i] |= set(range(p, p + length))
            if n == 0 or p > x[n - 1][0] + length:
                ends[-1][key].add((i, p))
            if n == len(x) - 1 or x[n + 1][0] > p + length:
                ends[1][key].add((i, p))

    def strip(i, p, step):
        return w[i][p + length : p + length + window] if step == 1 else w[i][max(0, p - window) : p][::-1]

    for step in (1, -1):
        for key, mine in ends[step].items():
            witnesses = mine | {by[key][0]}
            for i, p in mine:
                a = strip(i, p, step)
                most = max(sum(1 for _ in itertools.takewhile(lambda y: y[0] == y[1], zip(a, strip(*o, step)))) for o in witnesses if o < (i, p))
                cut[i] |= set(range(p + length, p + length + most)) if step == 1 else set(range(p - most, p))
    return {i: len(x) for i, x in cut.items() if x}


def stems(seed, n=240):
    """Documents that share 40 words, with tails and heads of a few kinds that part at every word."""
    rng = random.Random(seed)
    passage, tails, heads = prose(rng, 40), [prose(rng, 12).split() for _ in range(8)], [prose(rng, 20).split() for _ in range(6)]
    docs = []
    for i in range(n):
        tail, head = rng.choice(tails), rng.choice(heads)
        text = " ".join([prose(rng, rng.randint(0, 9)), *head[rng.randint(0, 20) :], passage, *tail[: rng.randint(0, 12)], prose(rng, rng.randint(0, 30))])
        docs.append((i, text, "s"))
    return docs


@pytest.mark.parametrize("seed", [4, 5])
def test_suffix_words_against_brute_force_whatever_the_partitions(spark, seed):
    docs = planted(seed)[0] + [(i + 1000, t, s) for i, t, s in stems(seed)]
    rng = random.Random(seed)
    docs += [(i + 5000, " ".join(rng.choice(docs)[1].split()[rng.randint(0, 30) :]), "s") for i in range(60)]
    want = suffix_cuts(docs)
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n, aqe in ((1, "true"), (23, "false")):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        try:
            out = repeats.suffix_array_dedup(df).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert {r.doc_id: r.words_removed for r in out if r.words_removed} == want
    # what stays holds no word twice that the passage had: each is found once at least somewhere
    assert sum(want.values()) > 5000


def test_suffix_key_of_many_occurrences(spark):
    """One passage in 6 000 documents with tails of 30 kinds: every one but the first of a kind goes whole."""
    rng = random.Random(9)
    passage, tails = prose(rng, 44), [prose(rng, 10) for _ in range(30)]
    docs = [(i, f"{prose(rng, 4)} {passage} {tails[i % 30]} {prose(rng, 3)}", "s") for i in range(6000)]
    out = {r.doc_id: r.words_removed for r in repeats.suffix_array_dedup(spark.createDataFrame(docs, SCHEMA).repartition(8)).collect()}
    assert out[0] == 0 and all(54 <= out[i] <= 56 for i in range(30, 6000)) and all(44 <= out[i] < 54 for i in range(1, 30))


def test_suffix_copies_of_rows(spark):
    docs, passages = planted(4)
    df = spark.createDataFrame(docs + [(200, docs[1][1], "s"), (200, docs[1][1], "s"), (None, docs[1][1], "s"), (7, docs[1][1], "s")], SCHEMA)
    got = defaultdict(list)
    for r in repeats.suffix_array_dedup(df).collect():
        got[r.doc_id].append(r.words_removed)
    n = len(docs[1][1].split())
    assert got[200] == [n, n] and got[None] == [n] and n in got[7] and len(got[7]) == 2 and got[1] == [0]


# --- 4 ----------------------------------------------------------------------------------------


def base_of(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def test_license_base_against_brute_force(spark):
    rng = random.Random(2)
    bits = ["under", "the", "mit", "license", "License,", "Apache", "version", "2", "2.0", "CC", "by-nc", "by", "nc", "é", "\n", "x;y", "UNDER THE MIT LICENSE", "Apache License, Version 2"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(1000, None), (1001, ""), (1002, "--")]
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        n, k, first, last, labels = base_of(dict(rows)[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, k, first, last, labels)
        assert set(labels) <= set(r.labels) and 0 <= r.score <= 1 and r.labels == sorted(set(r.labels))


def test_license_signatures(spark):
    cases = {
        "SPDX-License-Identifier: GPL-3.0-only": ["gpl-3"],
        "Licensed under the GNU General Public License, version 2": ["gpl-2"],
        "the GNU Lesser General Public License v2.1": ["lgpl-2.1"],
        "under CC BY-NC-SA 4.0 terms": ["cc-by-nc", "cc-by-nc-sa"],
        "Mozilla Public License 2.0": ["mpl-2"],
        "BSD 3-Clause License": ["bsd-3-clause"],
        "the limit of the license plate": [],
        "All rights reserved.": ["proprietary"],
    }
    cases |= {
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)": ["mit"],
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": ["bsd-2-clause"],
        "This is free and unencumbered software released into the public domain.": ["unlicense"],
        "See https://creativecommons.org/licenses/by-sa/4.0/ for terms": ["cc-by-sa"],
        "weights under OpenRAIL-M": ["openrail"],
        "weights under CreativeML Open RAIL-M": ["openrail"],
        "Unauthorized copying of this file is strictly prohibited": ["proprietary"],
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at the office": ["apache-2"],
        "anyone with permission to use the package": [],
    }
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    for i, want in enumerate(cases.values()):
        assert got[i].labels == want
    assert len(licenses.signature_rules()) >= 500


def test_license_texts_pass_their_own_gates(spark):
    """A sentence made from each hand-written pattern is found under its label, alone in a text."""
    def plain(body):
        body = re.sub(r"\(\?[=!][^)]*\)", "", body)
        body = re.sub(r"\(\?:\\w\+ \)\{\d+,\d+\}", "some ", body)
        while (new := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", body)) != body:
            body = new
        return re.sub(r"\[(.)[^]]*\]", r"\1", body).replace("?", "")

    rows = [(i, plain(body)) for i, (_, _, body) in enumerate(licenses.TEXTS)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = [(label, text, got[i].labels) for i, ((label, _, _), (_, text)) in enumerate(zip(licenses.TEXTS, rows, strict=True)) if label not in got[i].labels]
    assert not wrong


def test_license_priority_and_containment(spark):
    pairs = [(s, a, b) for s, a, b in [("x", 0, 9), ("y", 2, 5), ("z", 8, 12)]]
    hits = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(-b).alias("minus_stop"), F.lit(-p).alias("minus_priority"), F.lit(s).alias("label"), F.lit(0.5).alias("sure")) for (s, a, b), p in zip(pairs, (1, 9, 5), strict=True)])
    assert sorted(spark.range(1).select(licenses._resolved(hits).alias("r")).first().r.labels) == ["z"]


# --- 5 ----------------------------------------------------------------------------------------

needs_model = pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no tokenizer file here")
TEXTS = ["Hello  wörld\n\t日本", "", " ", "  a  b ", "\U0001f600 x\x00y", "a" * 300, "The quick brown fox. " * 30, "Größe naïve façade", "1234567890 3.14159"]


@needs_model
def test_viterbi_is_the_best_path_and_round_trips():
    m = sp.Model.load()
    e = sp.Encoder(m)
    tokens, n = e.encode(TEXTS)
    at = np.concatenate([[0], np.cumsum(n)])
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    score = {lib.id_to_piece(int(i)): float(s) for i, s in zip(m.ids, m.scores, strict=True)}
    by_id = {int(i): float(s) for i, s in zip(m.ids, m.scores, strict=True)}

    def best(t):
        t = "▁" + t.replace(" ", "▁")
        b = [0.0] + [-math.inf] * len(t)
        for j in range(1, len(t) + 1):
            for k in range(1, min(m.longest, j) + 1):
                s = score.get(t[j - k : j], m.unk_score if k == 1 else None)
                if s is not None:
                    b[j] = max(b[j], b[j - k] + s)
        return b[-1]

    for k, t in enumerate(TEXTS):
        ids = tokens[at[k] : at[k + 1]].tolist()
        assert sp.decode_ids(m, ids) == t
        if t and all(i in by_id for i in ids):
            assert sum(by_id[i] for i in ids) == pytest.approx(best(t))
    again, _ = e.encode(TEXTS)
    assert again.tolist() == tokens.tolist()


@needs_model
def test_merge_order_equals_the_library(data):
    import duckdb
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    texts = TEXTS + [r[0] for r in duckdb.sql(f"select text from '{data}/sf0.001/documents.parquet'").fetchall()]
    tokens, n = sp.Encoder(sp.Model.load(), "merges").encode(texts)
    at = np.concatenate([[0], np.cumsum(n)])
    assert all(tokens[at[k] : at[k + 1]].tolist() == lib.encode(t) for k, t in enumerate(texts))


@needs_model
def test_encode_and_decode_frames(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string")
    out = sp.decode(sp.encode(df, merges=True)).collect()
    assert all(r.decoded == (r.text or "") for r in out)
    assert all(sp.decode_ids(sp.Model.load(), r.merge_ids) == (r.text or "") for r in out)


# --- 6 ----------------------------------------------------------------------------------------


def test_lm_scores(spark):
    rng = random.Random(7)
    follow = {w: [rng.choice("abcdefghij") * 3 for _ in range(2)] for w in (c * 3 for c in "abcdefghij")}
    def text(n):
        w = ["aaa"]
        for _ in range(n):
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w)
    rows = [(i, text(rng.randint(0, 60))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "zzz AAA"), (1002, "zzz AAA")]
    for frequent in (4, 200_000):  # most counts joined, or none
        got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), frequent=frequent, least_tokens=400_000).collect()}
        held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
        tokens = {i: WORD.findall((t or "").translate(LOWER)) + [None] for i, t in rows}
        c = Counter()
        for i, t in rows:
            if not held[i]:
                c.update(WORD.findall((t or "").translate(LOWER)) + [None])
        total, v = sum(c.values()), len(c)
        for i, w in tokens.items():
            r = got[i]
            base = sum(math.log10((c[x] + 0.5) / (total + 0.5 * (v + 1))) for x in w)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), total)
            assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
        assert got[1002].rows == 2
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > 0.7 * sum(r.base_score for r in out)  # the order of words is learnt


def far_classes():
    far = np.zeros(lm.CLASSES + 1, np.int64)
    far[1 + lm.OWN : lm.CLASSES] = 1 + lm.COARSE + np.arange(lm.SHARED)
    far[lm.CLASSES] = lm.FAR
    return far


def test_lm_trains_on_every_token_and_averages(spark):
    """One task: the model is that of its own pass. More tasks: the mean by their tokens. Every text is in one round."""
    import pyarrow as pa

    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(90)]
    vocabulary = lm.Vocabulary(*(np.zeros(0, np.uint64), np.zeros(0, np.int64)) * 2, far_classes())
    class_n = np.ones(lm.CLASSES)
    p, tokens = lm.blank(class_n), 0
    halves = [rows[:45], rows[45:]]
    batch = lambda x: pa.RecordBatch.from_arrays([pa.array([i for i, _ in x]), pa.array([t for _, t in x])], names=["id", "text"])
    for turn in range(len(lm.RATES)):
        moved = [next(lm._move(vocabulary, p, class_n, turn, 1)(iter([batch(x)]))).to_pylist() for x in halves]
        n = [m[0]["tokens"] for m in moved]
        step = sum(np.concatenate([np.frombuffer(r["moved"], np.int64) for r in m]) for m in moved) / (lm.SCALE * sum(n))
        p, tokens = lm._shaped(lm._flat(p) + step, p), tokens + sum(n)
    assert tokens == sum(len(t.split()) + 1 for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1)
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "id long, text string")
    got = lm.train(df, vocabulary, class_n, 1)
    assert all(np.abs(got[k] - p[k]).mean() < 2e-3 for k in p)  # rounding differs with the threads
    assert not np.allclose(p["q1"], lm.blank(class_n)["q1"])


def test_lm_is_normalised():
    rng = np.random.default_rng(0)
    p = {"r": rng.normal(size=(lm.CLASSES, lm.DIM)), "q1": rng.normal(size=(lm.CLASSES + 1, lm.DIM)), "q2": rng.normal(size=(lm.FAR + 1, lm.DIM)), "b": rng.normal(size=lm.CLASSES)}
    p = {k: x.astype(np.float32) * 0.5 for k, x in p.items()}
    norms, c = lm.log_norms(p), np.arange(lm.CLASSES)
    for u, v in ((0, 0), (lm.FAR, lm.CLASSES), (17, 900), (lm.FAR - 1, 5)):
        log = lm.log_probabilities(p, norms, np.full(len(c), u), np.full(len(c), v), c)
        assert (10.0**log).sum() == pytest.approx(1, abs=1e-3)
    # within a class: its words' shares and that of one unknown word
    n = np.array([5, 1, 9])
    assert sum((n + 0.5) / (n.sum() + 0.5 * (len(n) + 1))) + 0.5 / (n.sum() + 0.5 * (len(n) + 1)) == pytest.approx(1)


# --- 8 ----------------------------------------------------------------------------------------


def measured(t):
    t = t or ""
    w = WORD.findall(t)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(win)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len({i + k for i, x in enumerate(win) if c[x] > 1 for k in range(3)})


def test_quality_measures_against_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", "\n\n", "a a a a", "a a", "x\nx\n x\nx", "# $ é é é é"] + ["".join(rng.choice(["a ", "b ", "c\n", "#", "d d ", "\t", "é "]) for _ in range(rng.randint(0, 80))) for _ in range(200)]
    rows = list(enumerate(texts))
    for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        m = r.measures
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == measured(texts[r.doc_id])
        base = m.n_words < 50 or 100 * m.n_repeat_words > 50 * m.n_words
        assert not (base and r.kept) and r.kept == (not r.failed)


def test_quality_keeps_what_people_call_good(spark, data):
    docs = quality.quality(spark.read.parquet(f"{data}/sf0.01/documents.parquet"))
    labelled = docs.join(spark.read.parquet(f"{data}/sf0.01/labels.parquet"), "doc_id")
    base = "(measures.n_words < 50 or 100 * measures.n_repeat_words > 50 * measures.n_words)"
    assert labelled.where(f"quality = 1 and not {base} and not kept").count() == 0
    assert labelled.where("quality = 0 and kept").count() == 0


def test_quality_plan_has_no_python_and_no_shuffle(odd):
    plan = quality.quality(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# --- 9 ----------------------------------------------------------------------------------------


def brute_components(rows, width, threshold):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        k = len(sets[i] & sets[j])
        if k and 100 * k >= threshold * (len(sets[i]) + len(sets[j]) - k):
            parent[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def near_rows(n_groups, size, seed=1):
    rng = random.Random(seed)
    rows, k = [], 0
    for _ in range(n_groups):
        w = prose(rng, rng.randint(3, 300)).split()
        for _ in range(size):
            x = list(w)
            for _ in range(int(len(x) * rng.choice([0, 0.01, 0.02, 0.03, 0.05, 0.1]))):
                x[rng.randrange(len(x))] = "q" + str(rng.randrange(10**6))
            rows.append((k, " ".join(x)))
            k += 1
    rng.shuffle(rows)
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows(12, 18) + [(1000, None), (1001, ""), (1002, "a"), (1003, "A"), (1004, "a b"), (1005, "b a")]
    want = brute_components(rows, 3, 85)
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, threshold=85).collect()}
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (d == want[d][1]) for d, r in got.items())


def test_large_buckets_are_settled_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 4)
    monkeypatch.setattr(minhash, "BLOCK_NODES", 7)
    rows = near_rows(3, 40, seed=2)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, threshold=85).collect()}
    assert got == {d: c for d, (_, c) in brute_components(rows, 3, 85).items()}


def test_band_candidates_miss_hardly_any_pair():
    assert (1 - 0.85**minhash.ROWS) ** minhash.BANDS < 1e-7


def test_components_of_random_graphs(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {n: find(n) for n in list(parent)}
    loops = {a for a, b in edges if a == b} - {n for e in edges if e[0] != e[1] for n in e}
    assert got == {n: c for n, c in want.items() if n not in loops}


# --- 10 ---------------------------------------------------------------------------------------


def test_mix_targets_and_limits(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(0, 400)), rng.choice(["a", "a", "a", "B", "é", None])) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in mixing.mix(df, shard_tokens=4000).collect()}
    sizes = defaultdict(int)
    for i, t, s in rows:
        assert got[i].size == len(WORD.findall(t)) and 0 <= got[i].taken <= 2 * got[i].size
        sizes[s] += got[i].size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in full} if full else {s: weight[s] * level for s in open_}
        open_ = open_ - full if full else set()
    for s in order:
        docs = [r for r in got.values() if r.source == s]
        assert docs[0].target == pytest.approx(target[s]) and docs[0].source_size == sizes[s]
        assert sum(r.taken for r in docs) == pytest.approx(target[s], rel=0.02)
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7), shard_tokens=4000).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_mix_deals_rows_of_one_id_over_shards(spark):
    rng = random.Random(10)
    same = prose(rng, 40)
    rows = [(None, same, "a")] * 400 + [(7, prose(rng, 40), "a") for _ in range(400)] + [(i, prose(rng, 40), "b") for i in range(100, 300)]
    df = spark.createDataFrame(rows, SCHEMA)
    for fanout in (3, 1024):
        got = [(r.doc_id, r.print, r.taken) for r in mixing.mix(df, shard_tokens=4000, fanout=fanout).collect()]
        assert len(got) == len(rows) and all(0 <= t <= 80 for _, _, t in got)
        again = mixing.mix(df.repartition(9), shard_tokens=4000, fanout=fanout).collect()
        assert Counter(got) == Counter((r.doc_id, r.print, r.taken) for r in again)
        out = mixing.mix(df, shard_tokens=4000, fanout=fanout)
        sums = {r.source: (r.t, r.target) for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()}
        assert all(t == pytest.approx(target, rel=0.02) for t, target in sums.values())


def test_mix_against_block_selection(spark):
    """taken from the laid-out words: each word of the mix is counted by its block."""
    rng = random.Random(14)
    rows = [(i, prose(rng, rng.randint(0, 90)), rng.choice("ab")) for i in range(120)]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, SCHEMA), shard_tokens=1 << 18).collect()}
    h = {r.doc_id: (r.h, r.print) for r in spark.createDataFrame(rows, SCHEMA).select("doc_id", F.xxhash64("text").alias("print")).select("doc_id", "print", F.xxhash64(F.lit(21), "doc_id", "print", F.lit(0).cast("long")).alias("h")).collect()}
    shift_of = {r.idx: r.h for r in spark.range(2).select(F.col("id").alias("idx"), F.xxhash64(F.lit(20), "id", F.lit(0).cast("long")).alias("h")).collect()}
    targets_ = {r.source: r.target for r in got.values()}
    seats, votes = round(sum(targets_.values()) / 32), targets_
    quota = dict.fromkeys("ab", 0)
    for _ in range(seats):
        quota[max("ab", key=lambda s: (votes[s] / (2 * quota[s] + 1), s == "a"))] += 1
    for idx, source in enumerate("ab"):
        mine = sorted((i for i, t, s in rows if s == source and t.split()), key=lambda i: h[i][0])
        words = [i for i in mine for _ in range(got[i].size)]
        m = -(-len(words) // 32)
        q = min(quota[source], 2 * m)
        times = [q // m + ((b * mixing.PRIME + shift_of[idx] % m) % m < q % m) for b in range(m)]
        want = Counter()
        for at, i in enumerate(words):
            want[i] += times[at // 32]
        assert {i: got[i].taken for i in mine} == {i: want[i] for i in mine}


def test_sainte_lague_deals_by_highest_quotients(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for g in range(6):
        votes = [rng.randint(1, 1000) for _ in range(rng.randint(1, 9))]
        seats = rng.randint(0, 60)
        rows += [(g, k, v, seats) for k, v in enumerate(votes)]
        won = [0] * len(votes)
        for _ in range(seats):
            won[max(range(len(votes)), key=lambda k: (votes[k] / (2 * won[k] + 1), -k))] += 1
        want |= {(g, k): w for k, w in enumerate(won)}
    got = mixing.sainte_lague(spark.createDataFrame(rows, "g int, k int, v long, n long"), "g", "k", "v", "n")
    assert {(r.g, r.k): r.quota for r in got.collect()} == want


# --- pieces of any length ------------------------------------------------------------------------


@needs_model
def test_long_words_equal_short_ones_and_take_seconds(monkeypatch):
    import time

    m, rng = sp.Model.load(), random.Random(1)
    letters = ["th", "e", "in", "g", "\u4e2d", "\u6587", "\U0001f600", "0", "=", "\u0391"]
    monkeypatch.setattr(sp, "WINDOW", 97)
    e = sp.Encoder(m)
    for n in (1, 2, 60, 700):
        for word in ("".join(rng.choice(letters) for _ in range(n)), "a" * n, "ab" * n):
            w = np.frombuffer((chr(sp.MARK) + word).encode("utf-32-le"), np.uint32).astype(np.uint64)
            assert list(e.viterbi(w[None])[0]) == list(e.long_viterbi(w)) and list(e.merged(w[None])[0]) == list(e.long_merges(w))
    monkeypatch.undo()
    big = "".join(rng.choice(letters) for _ in range(600_000))
    for method in ("viterbi", "merges"):
        began = time.time()
        ids, n = sp.Encoder(m, method).encode([big])
        assert sp.decode_ids(m, ids) == big and time.time() - began < 60


@needs_model
def test_words_end_where_no_piece_goes_on_and_stay_known():
    import pickle

    m = sp.Model.load()
    names = [f"{a}{b}" for a in ("the", "Gr\u00f6\u00dfe", "ing", "qu") for b in ("er", "ma", "\u65e5", "st")]
    texts = ["".join(f" {a}.\n{b}" for a in names for b in names), *TEXTS]
    e = sp.Encoder(m)
    e.encode(texts[:1])
    assert len(e.known) < 4 * len(names)  # not one word for each pair
    both = sp._encoder(m, ("viterbi", "merges"))
    assert sp._encoder(pickle.loads(pickle.dumps(m)), ("viterbi", "merges")) is both  # from task to task
    rows = [t.encode() for t in texts] + [b"", b"a\xe2\x96", b"\x81b", b"x\xff\xed\xa0\x80 y", "\u2581a\u2581\u2581b \ufffd".encode()]
    offsets, data = np.cumsum([0, *map(len, rows)]), np.frombuffer(b"".join(rows), np.uint8)
    for k, method in enumerate(both.methods):
        whole = sp.Encoder(m, method)
        whole.apart[:] = False  # a text is one word
        want, n = whole.encode([r.decode("utf-8", "replace") for r in rows])
        for _ in range(2):
            tokens, edge = both.encode_rows(offsets, data)[k]
            assert tokens.tolist() == want.tolist() and np.diff(edge).tolist() == n.tolist()


@needs_model
def test_decode_of_odd_ids(spark):
    m = sp.Model.load()
    byte = int(m.byte_ids[0xE6])
    rows = [(1, None), (2, []), (3, [byte]), (4, sp.Encoder(m).encode([" a b\u65e5\U0001f600"])[0].tolist()), (5, [byte, byte])]
    out = {r.i: r.decoded for r in sp.decode(spark.createDataFrame(rows, "i int, token_ids array<int>")).collect()}
    assert out == {i: None if x is None else sp.decode_ids(m, x) for i, x in rows}


# --- the pipeline -----------------------------------------------------------------------------


@needs_model
def test_pipeline_stages_against_brute_force(spark, data):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    kept = {}
    now = docs
    for name, stage in cp.STAGES:
        now = common.keep(stage(spark, now, f"{data}/sf0.001"), name)
        kept[name] = now
        if name != "sentence_pieces":
            assert now.columns == docs.columns
    ids = lambda n: sorted(r.doc_id for r in kept[n].collect())
    one = ids("quality_rules")
    good = quality.quality(docs).where("kept")
    assert one == sorted(r.doc_id for r in good.collect())
    texts = dict(rows)
    first = {}
    for i in one:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    assert ids("exact_dedup") == sorted(first.values())
    two = [(i, texts[i]) for i in sorted(first.values())]
    comp = brute_components(two, 5, 80)
    assert ids("near_dedup") == sorted(i for i, _ in two if comp[i][1] == i)
    assert Counter(ids("source_mix")) == Counter(r.doc_id for r in kept["sentence_pieces"].collect())
    assert set(ids("source_mix")) <= set(ids("near_dedup")) and max(Counter(ids("source_mix")).values()) <= 2
    m = sp.Model.load()
    assert all(sp.decode_ids(m, r.token_ids) == texts[r.doc_id] for r in kept["sentence_pieces"].collect())


STAGES = ["quality_rules", "exact_dedup", "near_dedup", "source_mix", "sentence_pieces"]


@needs_model
@pytest.mark.parametrize("name", STAGES)
def test_stages_on_odd_empty_and_clashing_rows(spark, odd, none, clashing, name):
    import corpus_pipeline as cp

    stage = dict(cp.STAGES)[name]
    rng = random.Random(31)
    good = "The cat and the dog ran to the house. " * 3 + prose(rng, 60)
    rows = odd_rows() + [(20, good, "s"), (20, good, "s"), (None, good, "t"), (20, prose(rng, 80), None)]
    df = spark.createDataFrame(rows, SCHEMA)
    texts = lambda out: Counter((r.doc_id, r.text) for r in out.collect())
    assert stage(spark, none, "").count() == 0
    extra = clashing.select(*[c for c in clashing.columns if c.lower() not in ("text", "doc_id", "source")], "doc_id", "text", "source")
    out, more = stage(spark, df, ""), stage(spark, extra, "")
    if name == "sentence_pieces":
        m = sp.Model.load()
        assert Counter((r.doc_id, r.source, sp.decode_ids(m, r.token_ids)) for r in out.collect()) == Counter((i, s, t or "") for i, t, s in rows)
        assert all(sp.decode_ids(m, r.token_ids) == sp.decode_ids(m, r.merge_ids) for r in out.collect()) and more.count() == len(odd_rows())
        return
    assert out.columns == df.columns and more.columns == extra.columns
    assert texts(more) == texts(stage(spark, odd, ""))
    got = texts(out)
    if name == "quality_rules":
        kept = texts(quality.quality(df).where("kept").select("doc_id", "text"))
        assert got == kept and got[20, good] == 2 and got[None, good] == 1 and not got[3, None]
    if name == "exact_dedup":
        norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        first = {}
        for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            first.setdefault(norm(t), i)
        assert Counter((i, norm(t)) for i, t in got.elements()) == Counter((i, t) for t, i in first.items())
    if name == "near_dedup":
        assert got[20, good] == 1 and got[None, good] == 0 and got[3, None] == got[4, ""] == 1 and got[8, "one"] + got[9, "ONE"] == 1
    if name == "source_mix":
        assert all(n <= 2 * Counter((i, t) for i, t, _ in rows)[key] for key, n in got.items()) and not got[3, None] and not got[4, ""]
        words = sum(len(WORD.findall(t or "")) * n for (_, t), n in got.items())
        assert words > 0


def test_near_duplicate_stage_on_null_and_repeated_ids(spark):
    import corpus_pipeline as cp

    rng = random.Random(21)
    a, b, c, d, e = (prose(rng, 100) for _ in range(5))
    rows = [
        (1, a, "s"), (2, a + " x", "s"), (2, b, "s"),  # a near copy shares its id with another text
        (None, a + " y", "s"), (None, c, "s"), (None, c + " z", "s"), (None, "", "s"), (None, None, "s"),  # null ids
        (3, d, "s"), (3, d + " w", "s"), (4, e, "s"), (4, e.replace(" ", "\n"), "s"),  # near copies under one id
    ]
    out = [(r.doc_id, r.text) for r in cp.near_duplicate_groups(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    assert (1, a) in out and (2, b) in out and (None, "") in out and (None, None) in out
    assert not {(2, a + " x"), (None, a + " y")} & set(out)
    assert sum(t in (c, c + " z") for _, t in out) == sum(t in (d, d + " w") for _, t in out) == sum(i == 4 for i, _ in out) == 1
    assert len(out) == 7
