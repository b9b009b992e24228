"""The mixing model against a plain version: one token, one bit at a time, over dictionaries."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftwork.llm import context_mixing as cm
from weftwork.llm import word_codes as codes

START, END = "start", codes.END


class Plain:
    """All counts in memory, by the bits of the words' paths."""

    def __init__(self, rows, p):
        self.p, self.texts = p, [(train, (text or "").encode().lower().split() + [END]) for train, text in rows]
        self.count = Counter(w for train, own in self.texts if train for w in own)
        every = sorted({w for _, own in self.texts for w in own}, key=xxhash.xxh64_intdigest)
        self.level = {w: int(math.log2(self.count[w])) if self.count[w] > 1 else 0 for w in every}
        by_level = defaultdict(list)
        for w in every:
            if self.level[w]:
                by_level[self.level[w]].append(w)
        self.words = {k: len(x) for k, x in by_level.items()}
        self.path = {}
        for w in every:
            path = f"{self.level[w]:05b}"
            if self.level[w]:
                own = by_level[self.level[w]]
                size = (len(own) - 1).bit_length()
                path += f"{own.index(w):0{size}b}" if size else ""
            self.path[w] = path
        self.nodes = Counter()
        for train, own in self.texts:
            if train:
                for w, contexts in zip(own, self.contexts(own), strict=True):
                    for c in contexts:
                        for j in range(len(self.path[w]) + 1):
                            self.nodes[c, self.path[w][:j]] += 1
        seen = np.zeros((2, 256))
        for train, own in self.texts:
            if train:
                for w, contexts in zip(own, self.contexts(own), strict=True):
                    for j in range(len(self.path[w])):
                        for kind, c in enumerate(contexts):
                            seen[kind, self.state(kind, c, w, j, 1)] += c is not None
        tables = np.zeros((len(cm.ORDERS), 2 << cm.BITS), np.int32)
        cm.spelling_counts([b"" if w == END else w for w in every if self.count[w] == 1], tables)
        words, tokens = np.zeros(32, np.int64), np.zeros(32, np.int64)
        self.once, self.twice = (sum(x == n for x in self.count.values()) for n in (1, 2))
        for w in every:
            words[self.level[w]] += self.level[w] > 0 or self.count[w] == 1
            tokens[self.level[w]] += self.count[w]
        self.model = cm.Model(cm.Dictionary(np.zeros((1, 32), np.int64), words, tokens, self.twice), np.stack([cm.learned_states(x) for x in seen]), cm.as_bytes(tables), p)
        self.mass = [words[0] + 0.5] + [tokens[k] + 0.5 if words[k] else 0 for k in range(1, 32)]

    def contexts(self, own):
        """(last common word, two words before or None) for each token."""
        for i in range(len(own)):
            last = next((own[k] for k in range(i - 1, -1, -1) if self.count[own[k]] >= self.p.common), START)
            pair = tuple(own[k] if k >= 0 else START for k in (i - 1, i - 2))
            yield ("last", last), ("pair", *pair) if all(w == START or self.level[w] for w in pair) else None

    def state(self, kind, c, w, j, less):
        if c is None:
            return 0
        total, came = self.nodes[c, self.path[w][:j]] - less, self.nodes[c, self.path[w][: j + 1]] - less
        if total < (self.p.least if kind == 0 else 1):
            return 0
        return int(codes.state(np.asarray([came]), np.asarray([total - came]))[0])

    def below(self, w, j):
        """Words of w's level whose ranks begin with the same j bits."""
        k, size = self.level[w], len(self.path[w]) - 5
        low = int(self.path[w][5 : 5 + j].ljust(size, "0") or "0", 2)
        return min(self.words[k], low + (1 << (size - j))) - low

    def prior(self, w, j):
        """Probability of the path's next bit without context."""
        if j < 5:
            share = lambda b: sum(m for k, m in enumerate(self.mass) if f"{k:05b}".startswith(b))
            return share(self.path[w][: j + 1]) / share(self.path[w][:j])
        return self.below(w, j - 4) / self.below(w, j - 5)

    def score(self, train, own):
        weights = cm.begin().astype(np.float64)
        seen, total, less = np.zeros(cm.GATES), 0.0, int(train)
        blocks = defaultdict(list)
        for i, (w, contexts) in enumerate(zip(own, self.contexts(own), strict=True)):
            bits, j = [], 0
            while j < len(self.path[w]):
                states = [self.state(kind, c, w, j, less) for kind, c in enumerate(contexts)]
                if not any(states):
                    break
                p = self.prior(w, j)
                if p < 1 - 1e-13:
                    x = [math.log(p / (1 - p)), self.model.states[0][states[0]], self.model.states[1][states[1]]]
                    bits.append((cm.KNOWN_LAST[states[0]] + cm.KNOWN_PAIR[states[1]], x))
                j += 1
            for k in range(j, len(self.path[w])):
                total += math.log(self.prior(w, k))
            if self.count[w] <= 1:
                again = (2 * self.twice + 0.5) / (self.once + 2 * self.twice + 1)
                total += math.log(again / self.once) if self.count[w] == 1 and not train else math.log(1 - again)
            if self.count[w] == train:
                for _, gate, x in self.model.spelled_bits([b"" if w == END else w], np.asarray([train])):
                    bits += zip(gate.tolist(), x.T.tolist(), strict=True)
            blocks[int(cm.block_of(np.asarray([i]))[0])] += bits
        for b in sorted(blocks):
            push = np.zeros_like(weights)
            for gate, x in blocks[b]:
                logit = min(max(float(weights[:, gate] @ x), -cm.REACH), cm.REACH)
                logit = math.floor(logit * cm.FINE + 0.5 + cm.REACH * cm.FINE) / cm.FINE - cm.REACH
                total -= math.log1p(math.exp(-logit))
                push[:, gate] += np.asarray(x) / (1 + math.exp(logit))
                seen[gate] += 1
            weights += self.p.rate * push / np.sqrt(1 + seen / 16)
        return total / math.log(10)


def texts():
    r = np.random.default_rng(5)
    words = ["the", "of", "and", *("".join(r.choice(list("abcdeé"), r.integers(2, 6))) for _ in range(120))]
    weight = 1 / np.arange(1, len(words) + 1)
    make = lambda n: " ".join(words[k] for k in r.choice(len(words), n, p=weight / weight.sum()))
    rows = [(k, make(int(r.integers(1, 160)))) for k in range(40)]
    return rows + [(50, rows[3][1]), (51, rows[3][1] + " tail"), (52, None), (53, ""), (54, "unseenword zz"), (None, "the of"), (None, "the of"), (56, make(900))]


def test_scores_are_those_of_the_plain_version(spark):
    rows = texts()
    p = cm.Params(common=8, least=4, hot=60, chunk_bytes=4000, bucket_bytes=2000, step_tokens=300)
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x")).repartition(3)
    got = cm.scored(table, F.col("doc_id") % 5 == 0, p).collect()
    plain = Plain([(k is None or k % 5 != 0, t) for k, t in rows], p)
    want = sorted(((k is not None and k % 5 == 0, plain.score(train, own)) for (k, _), (train, own) in zip(rows, plain.texts, strict=True)))
    mine = sorted((r.held_out, r.score) for r in got)
    assert [x[0] for x in mine] == [x[0] for x in want]
    assert [x[1] for x in mine] == pytest.approx([x[1] for x in want], rel=1e-4, abs=1e-3)
    for r in got:
        size = len((dict(rows).get(r.doc_id) or "").encode()) if r.doc_id is not None else 6
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / size) if size else r.bits_per_byte is None
    again = cm.scored(table.repartition(7), F.col("doc_id") % 5 == 0, cm.Params(common=8, least=4, hot=1 << 20, chunk_bytes=1 << 20)).collect()
    assert [x for _, x in sorted((r.held_out, r.score) for r in again)] == pytest.approx([x for _, x in mine], rel=1e-5)


def test_a_text_that_another_repeats_is_likely(spark):
    rows = texts()
    got = {r.doc_id: r.score / r.n_tokens for r in cm.scored(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False)).collect()}
    assert min(got[3], got[50]) > max(got[k] for k in range(40) if k != 3 and len(rows[k][1]) > 200) + 0.5


def test_long_words(spark):
    long = "ab" * 100_000
    rows = spark.createDataFrame([(1, long), (2, "x " + "ab" * 1000), (3, "ab ab")], "doc_id long, text string")
    whole, short = ({r.doc_id: r.score for r in cm.scored(rows, F.lit(False), cm.Params(long_word=n)).collect()} for n in (1 << 20, 100))
    assert all(np.isfinite(x) and x < 0 for x in short.values()) and short[3] == pytest.approx(whole[3])


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 10**6))
def test_states_of_exchanged_sides(a, b):
    x, y = (int(codes.state(np.asarray([p]), np.asarray([q]))[0]) for p, q in ((a, b), (b, a)))
    assert x >> 4 == y >> 4 and (a + b == 0 or (x & 15) + (y & 15) == 16)


def test_both_sides_add_to_one():
    seen = np.random.default_rng(0).integers(0, 50, 256)
    table = cm.learned_states(seen)
    for k in range(256):
        if k & 15:
            assert table[k] == pytest.approx(-table[k & 0xF0 | (16 - (k & 15))], abs=1e-5)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**20), st.integers(0, 2**26 - 1)), max_size=60))
def test_packed_keys_come_back(pairs):
    values = np.unique(np.asarray([a << 26 | b for a, b in pairs], np.uint64))
    assert np.array_equal(codes.unpack_keys(codes.pack_keys(values)), values)


def test_packed_states_come_back():
    r = np.random.default_rng(1)
    found = np.unique(r.integers(0, 1 << 12, 300).astype(np.uint64) << np.uint64(14) | r.integers(0, 4, 300).astype(np.uint64) << np.uint64(8))
    states, alone, _ = cm.states_of(found, r.integers(0, 40, len(found)), np.full(32, 20, np.uint8), 6)
    got = codes.unpack_states(codes.pack_states(states, alone), len(found))
    assert np.array_equal(got[:, : len(states)].T, states)


def test_pieces_hold_the_whole_path():
    r = np.random.default_rng(2)
    n, d = 500, 26
    level, rank = np.full(n, 9, np.uint8), r.integers(0, 1 << d, n)
    context = codes.mixed(r.integers(0, 5, n).astype(np.uint64))
    for hot in (np.zeros(n, bool), np.ones(n, bool)):
        found = codes.keys(context, 1, level, rank, np.full(n, d), hot)
        assert sum(int(size[0]) for _, _, _, size in found) == codes.LEVEL_BITS + d
        whole = [tuple(int(k[i]) for _, k, _, _ in found) for i in range(n)]
        assert len(set(whole)) == len(set(zip(context.tolist(), rank.tolist(), strict=True)))
