"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its words (lower case A-Z, between ASCII spaces) and an end. Each word is a row
of binary decisions, the bits of its path (word_codes.py); a word of fewer than two
training tokens takes the path of level 0 and is then spelled, byte by byte and closed by
a space, in eight decisions a byte; but a held-out text's word that training has once is
one of those, all alike.

Every bit of a path is predicted in three contexts: no context, the last common word
before it, and the two words before it. The latter two are hashed, and counted over all
training texts; what a pair of counts means as a probability is itself learned, from all
training decisions. The last common word says something of a bit from Params.least training
tokens on. Every bit of a spelling is predicted in three contexts, the last 2, 3 and 4
bytes, hashed, and counted over all words of one training token. A training token is
left out of the counts that predict it, so that training and held-out texts are scored alike.

The predictions are joined in the logistic domain by weights that a gate picks (how well
the contexts are known). The weights begin at fixed values for each text and are learned
online, block by block of its words. Both sides of a bit always add to one. A path's bits
that no context knows anything about are not mixed: their probability is the share of the
word's level, and an equal part of it.

So a score depends on the text itself and the training texts alone, not on how rows are
dealt. The work is in chunks of texts and buckets of keys. A chunk sends each bucket its
sorted distinct words, later its sorted distinct keys, once each with a count, and gets the
totals back in the same order: a frequent word or passage costs a bucket one row a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import word_codes as codes
from .common import give_back, remove, written
from .word_codes import bundle, pack, pack_sorted, parts_of, unpack, unpack_sorted

ORDERS = (2, 3, 4)
BITS = 19  # slots of an order's table of spellings: 2^BITS, each with a count of zeros and of ones
BLOCK = 1 << 16
DEPTH = codes.LEVEL_BITS + 64
PATHS = ("last", "pair")
LAST, PAIR = 0, 1  # kinds of contexts: the last common word; the two words before
STEPS_LAST, STEPS_PAIR = 4, 4
WORD_GATES = STEPS_LAST * STEPS_PAIR
GATES = WORD_GATES + len(ORDERS) + 1
INPUTS = 3
REACH, FINE = 12, 64
ROW = "chunk long, kind string, part int, n long, data binary"
SCHEMA = pa.schema([("chunk", pa.int64()), ("kind", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])


@dataclass(frozen=True)
class Params:
    """common: training tokens from which a word is a context of its own; least: training tokens
    from which such a context is asked. hot: training tokens from which contexts are cut into
    pieces. chunk_bytes: text of a chunk. bucket_bytes: text a bucket. most_buckets: of words,
    whose places are known to every task (32 numbers each). rate: of the weights learned in a
    text."""

    common: int = 64
    least: int = 32
    hot: int = 1 << 20
    chunk_bytes: int = 8 << 20
    bucket_bytes: int = 16 << 20
    most_buckets: int = 1 << 15
    step_tokens: int = 100_000
    long_word: int = 4096
    rate: float = 0.02


def row(chunk: int, kind: str, part: int, data: bytes, n: int | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((chunk, kind, part, n, data), SCHEMA.types, strict=True)], schema=SCHEMA)


# -- texts to chunks


def said(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """All words of the texts, one after the other, as numbers; how many each text has; and
    the words of the numbers."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    coded = lists.flatten().dictionary_encode()
    numbers = coded.indices.to_numpy()
    # white space at either end of a text leaves an empty string
    some = numbers != pc.index(coded.dictionary, "").as_py()
    tokens = np.diff(np.concatenate([[0], np.cumsum(some)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()])
    ends = np.frombuffer(coded.dictionary.buffers()[1], np.int64, len(coded.dictionary) + 1, 8 * coded.dictionary.offset).tolist()
    data = coded.dictionary.buffers()[2].to_pybytes()
    return numbers[some], tokens, [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def chunk_rows(number: int, rows: list[pa.RecordBatch], shift: int) -> Iterator[pa.RecordBatch]:
    """A chunk's texts as numbers of their distinct words, which are sorted by hash; and, for
    each bucket, its words with their training tokens."""
    ids, held, texts = (pa.chunked_array([r.column(k) for r in rows]).combine_chunks() for k in range(3))
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    held = held.to_numpy(zero_copy_only=False)
    numbers, tokens, words = said(texts)
    words.append(codes.END)
    stream = np.insert(numbers, np.cumsum(tokens), len(words) - 1)
    tokens = tokens + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    words[-1] = b""  # how an end is spelled
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(words), np.uint32)
    place[order] = np.arange(len(words), dtype=np.uint32)
    count = np.bincount(stream[np.repeat(~held, tokens)], minlength=len(words))[order]
    hashes, stream = hashes[order], place[stream]
    rare = [words[k] for k in order[count <= 1]]  # they may have to be spelled
    none = pc.is_null(ids).to_numpy(zero_copy_only=False)
    ids = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    yield row(number, "texts", -1, bundle(pack(ids), pack(none), pack(held), pack(tokens), pack(sizes), pack(stream)), int(sizes.sum()))
    yield row(number, "rare", -1, bundle(pack(count <= 1), codes.squeezed(b" ".join(rare))))
    edges = np.searchsorted(hashes >> np.uint64(shift), np.arange((1 << (64 - shift)) + 1, dtype=np.uint64)) if shift < 64 else np.asarray([0, len(words)])
    once = np.cumsum(np.concatenate([[0], count == 1]))
    single = [words[k] for k in order[count == 1]]
    for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if hi > lo:
            yield row(number, "words", b, bundle(pack_sorted(hashes[lo:hi]), pack(count[lo:hi]), codes.squeezed(b" ".join(single[once[lo] : once[hi]]))))


def _chunks(shift: int, p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, size, rows = (task.partitionId() if task else 0) << 32, 0, []
        for batch in batches:
            lengths = pc.binary_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False) + 64
            while batch.num_rows:  # cut where a chunk is full
                ends = size + np.cumsum(lengths)
                n = min(batch.num_rows, int(np.searchsorted(ends, p.chunk_bytes)) + 1)
                rows.append(batch.slice(0, n))
                batch, lengths, size = batch.slice(n), lengths[n:], int(ends[n - 1])
                if size >= p.chunk_bytes:
                    yield from chunk_rows(number, rows, shift)
                    number, size, rows = number + 1, 0, []
        if rows:
            yield from chunk_rows(number, rows, shift)

    return run


# -- spellings


class Spelled:
    """Words as one row of symbols, each word closed by a space."""

    def __init__(self, words: list[bytes]) -> None:
        self.symbols = np.frombuffer(b" ".join([*words, b""]), np.uint8)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.at = np.arange(len(self.symbols)) - np.repeat(self.starts, self.sizes)

    def back(self, k: int) -> np.ndarray:
        """The symbol k before each; the space before a word counts, 0 what lies before it."""
        out = np.zeros(len(self.symbols), np.uint32)
        out[k:] = self.symbols[:-k]
        out[self.at == k - 1] = 32
        out[self.at < k - 1] = 0
        return out

    def contexts(self) -> Iterator[np.ndarray]:
        """For each order the hash of its context, at every symbol."""
        value = np.zeros(len(self.symbols), np.uint32)
        for k in range(1, max(ORDERS) + 1):
            value = (value + self.back(k) + np.uint32(1)) * np.uint32(0x2545F491) ^ (value >> 15)
            if k in ORDERS:
                yield value * np.uint32(0x9E3779B1) + np.uint32(k)

    def nodes(self, bit: int) -> np.ndarray:
        """The bits of each symbol before `bit`, after a leading 1."""
        return (self.symbols.astype(np.uint32) | 256) >> (8 - bit)


def slot(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Twice the table's slot; the count of ones lies beside that of zeros."""
    h = (context ^ (node * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
    return ((h ^ (h >> 13)) >> (32 - BITS)).astype(np.int64) << 1


def spelling_counts(words: list[bytes], tables: np.ndarray) -> None:
    """Adds the bits of the words to tables (orders, slots of two)."""
    for lo in range(0, len(words), 50_000):
        text = Spelled(words[lo : lo + 50_000])
        for table, context in zip(tables, text.contexts(), strict=True):
            at = np.concatenate([slot(context, text.nodes(b)) + ((text.symbols >> (7 - b)) & 1) for b in range(8)])
            table += np.bincount(at, minlength=table.size).astype(table.dtype)


def as_bytes(tables: np.ndarray) -> np.ndarray:
    """Pairs of counts as pairs of bytes: larger pairs are scaled down together, and no count
    above 0 becomes 0."""
    pairs = tables.reshape(*tables.shape[:-1], -1, 2)
    share = 255 / np.maximum(pairs.max(axis=-1, keepdims=True), 255)
    return np.maximum(np.rint(pairs * share), pairs > 0).astype(np.uint8).reshape(tables.shape)


def _add_blocks(table: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.int64)
    for x in table.column("data"):
        total += np.frombuffer(codes.unsqueezed(x.as_py()), np.int32)
    return pa.table({"part": table.column("part")[:1], "data": pa.array([codes.squeezed(np.minimum(total, 2**31 - 1).astype(np.int32).tobytes())], pa.binary())})


# -- buckets of words


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: to each chunk its words' counts and ranks; the words and tokens of each
    level; the spellings of words of one training token."""
    table = pa.Table.from_batches(batches)
    part = table.column("part")[0].as_py()
    chunks = table.column("chunk").to_pylist()
    blobs = [parts_of(x) for x in table.column("data").to_pylist()]
    own = [unpack_sorted(b[0], np.uint64) for b in blobs]
    size = np.cumsum([0, *map(len, own)])
    found, at = np.unique(np.concatenate(own), return_inverse=True)
    came = [unpack(b[1], np.int64) for b in blobs]
    count = np.bincount(at, np.concatenate(came), len(found)).astype(np.int64)
    level = codes.levels(count)
    order = np.argsort(level, kind="stable")
    words = np.bincount(level, minlength=codes.LEVELS)
    rank = np.empty(len(found), np.uint32)
    rank[order] = np.arange(len(found)) - np.repeat(np.cumsum(words) - words, words)
    alone = []
    for k, (chunk, b) in enumerate(zip(chunks, blobs, strict=True)):
        mine = at[size[k] : size[k + 1]]
        yield row(chunk, "codes", part, bundle(pack(count[mine]), pack(rank[mine])))
        here = np.flatnonzero(count[mine][came[k] == 1] == 1)
        if len(here):
            spelled = codes.unsqueezed(b[2]).split(b" ")
            alone += [spelled[i] for i in here]
    tables = np.zeros((len(ORDERS), 2 << BITS), np.int32)
    spelling_counts(alone, tables)
    words[0] = np.count_nonzero(count == 1)  # of level 0 only those of a training token
    yield row(-1, "levels", part, bundle(words.astype(np.int64).tobytes(), np.bincount(level, count, codes.LEVELS).astype(np.int64).tobytes(), np.asarray([np.count_nonzero(count == 2)]).tobytes()))
    for k, block in enumerate(tables.reshape(-1, BLOCK)):
        if block.any():
            yield row(-1, "spellings", k, codes.squeezed(block.tobytes()))


# -- a chunk's keys


@dataclass
class Dictionary:
    """offsets: (buckets, levels), the ranks before each bucket's; words and tokens by level;
    twice: words of two training tokens."""

    offsets: np.ndarray
    words: np.ndarray
    tokens: np.ndarray
    twice: int

    def __post_init__(self) -> None:
        self.bits = codes.rank_bits(self.words)
        self.bits[0] = 0


class Tokens:
    """A chunk's tokens with the codes of their words."""

    def __init__(self, rows: list[tuple[str, int, bytes]], d: Dictionary) -> None:
        (texts,) = (parts_of(x) for kind, _, x in rows if kind == "texts")
        replies = sorted((part, parts_of(x)) for kind, part, x in rows if kind == "codes")
        self.ids, self.none, held = unpack(texts[0], np.int64), unpack(texts[1], bool), unpack(texts[2], bool)
        self.held, self.tokens, self.sizes = held, unpack(texts[3], np.int64), unpack(texts[4], np.int64)
        self.stream = unpack(texts[5], np.uint32)
        self.count = np.concatenate([unpack(b[0], np.int64) for _, b in replies])
        self.level = codes.levels(self.count)
        rank = np.concatenate([unpack(b[1], np.uint32) for _, b in replies]).astype(np.int64)
        bucket = np.repeat([part for part, _ in replies], [len(unpack(b[0], np.int64)) for _, b in replies])
        self.rank = np.where(self.level > 0, rank + d.offsets[bucket, self.level], 0)
        self.first = np.cumsum(self.tokens) - self.tokens
        self.text = np.repeat(np.arange(len(self.tokens)), self.tokens)
        self.own = np.repeat(~held, self.tokens)
        self.bits = d.bits

    def keys(self, kind: int, p: Params) -> list[tuple]:
        """The tokens' keys in contexts of a kind, as from word_codes.keys, places ascending."""
        s, n = self.stream, len(self.stream)
        uid = np.where(self.level > 0, self.level.astype(np.uint64) << np.uint64(40) | self.rank.astype(np.uint64), np.uint64(0))
        uid = np.append(uid, codes.START)  # the last stands for what lies before a text
        frequent, before = np.append(self.count >= p.hot, True), len(self.count)
        first, here = self.first[self.text], np.arange(n)
        level, rank = self.level.take(s), self.rank.take(s)
        d = self.bits.take(level)
        if kind == LAST:
            last = np.maximum.accumulate(np.where((self.count >= p.common).take(s), here, -1))
            last = np.concatenate([[-1], last[:-1]])
            word = np.where(last >= first, s.take(np.maximum(last, 0)), before)
            context = codes.mixed(uid * np.uint64(0x9E3779B97F4A7C15)).take(word)
            return codes.keys(context, LAST, level, rank, d, frequent.take(word))
        one, two = (np.where(here - k >= first, s.take(np.maximum(here - k, 0)), before) for k in (1, 2))
        in_path = np.append(self.level > 0, True)  # a word of level 0 has no other token to learn from
        at = np.flatnonzero(in_path.take(one) & in_path.take(two))
        one, two = one.take(at), two.take(at)
        context = codes.mixed(codes.mixed(uid * np.uint64(0xC2B2AE3D27D4EB4F)).take(one) ^ codes.mixed(uid * np.uint64(0x165667B19E3779F9)).take(two))
        return [(at[x[0]], *x[1:]) for x in codes.keys(context, PAIR, level[at], rank[at], d[at], frequent.take(one) & frequent.take(two))]


def _contexts(shift: int, d: Dictionary, kind: int, p: Params):
    """To each bucket the chunk's distinct keys in order, training and held-out tokens' apart
    (the last bit tells them), with their training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "part", "data")), strict=True))
        tokens = Tokens(rows, d)
        chunk = table.column("chunk")[0].as_py()
        every = np.sort(np.concatenate([x[1] << np.uint64(1) | tokens.own[x[0]] for x in tokens.keys(kind, p)]))
        if not len(every):
            return
        new = np.flatnonzero(np.diff(every, prepend=~every[:1]))
        count = (np.diff(new, append=len(every)) * (every[new] & np.uint64(1))).astype(np.uint32)
        every = every[new]
        buckets = every >> np.uint64(shift + 1)
        edges = np.flatnonzero(np.diff(buckets, prepend=buckets[0]))
        for lo, hi in zip([0, *edges], [*edges, len(every)], strict=True):
            yield row(chunk, "keys", int(buckets[lo]), bundle(codes.pack_keys(every[lo:hi]), pack(count[lo:hi])))

    return run


# -- buckets of keys


def _paths(bits: np.ndarray, kind: int, least: int):
    """One bucket: to each chunk the states of its keys' bits; and how often a training token's
    bit had which state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        part = table.column("part")[0].as_py()
        chunks = table.column("chunk").to_pylist()
        blobs = [parts_of(x) for x in table.column("data").to_pylist()]
        own = [codes.unpack_keys(b[0]) for b in blobs]
        every = np.concatenate(own)
        order = np.argsort(every)
        found = every[order]
        new = np.diff(found, prepend=~found[:1]) != 0
        found = found[new]
        at = np.empty(len(every), np.int32)
        at[order] = np.cumsum(new, dtype=np.int32) - 1
        n = np.bincount(at, np.concatenate([unpack(b[1], np.uint32) for b in blobs]), len(found)).astype(np.int64)
        at = np.split(at, np.cumsum([len(x) for x in own])[:-1])
        del every, order, new
        del own, blobs
        states, alone, seen = states_of(found, n, bits, least if kind == LAST else 0)
        cells = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), -1)), pa.array(["states"] * len(cells), pa.string()), pa.array(cells, pa.int32()), pa.array(seen[cells]), pa.nulls(len(cells), pa.binary())], schema=SCHEMA)
        for k, chunk in enumerate(chunks):
            yield row(chunk, PATHS[kind], part, codes.pack_states(states.take(at[k], axis=1), alone.take(at[k])))
        del states, alone, at
        give_back()

    return run


def states_of(found: np.ndarray, n: np.ndarray, bits: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted distinct keys, each with a last bit that tells training tokens, and counts:
    the state of every bit of their paths, by row, one training token of the key left out,
    and 0 where its context has fewer than least tokens; the row from which on a key is the
    only one of its beginning; and the training tokens whose bit had each state."""
    less, least = (found & np.uint64(1)).astype(np.int64), max(least, 1)
    size = codes.bits_of(found >> np.uint64(1), bits)
    seen = np.zeros(256)
    rows, act, alone = [], np.arange(len(found)), np.full(len(found), 255, np.uint8)
    path, mine, own, left = found, n, less, size
    total, single = sums(path, mine, codes.CODE_BITS + 1)
    for j in range(codes.CODE_BITS + 1):
        new = rows[-1].copy() if rows else np.zeros(len(found), np.uint8)
        none = total - own < least  # without its own token
        new[act[none]] = 0
        lone = single | (total < least)
        out, alive = act[lone], np.flatnonzero(lone & ~none)
        alone[out] = j
        some = act[alive]
        new[some] = codes.state(total[alive] - own[alive], np.zeros(len(some), np.int64))
        seen += np.bincount(new[some], mine[alive] * np.maximum(left[alive] - j, 0), 256)
        stay = np.flatnonzero(~lone)
        act, path, mine, own, left, total, none = (x.take(stay) for x in (act, path, mine, own, left, total, none))
        if len(act):
            after, single = sums(path, mine, codes.CODE_BITS - j)
            here = codes.state(after - own, total - after)
            here[none] = 0
            new[act] = here
            real = np.flatnonzero((left > j) & ~none)
            seen += np.bincount(here[real], mine[real], 256)
            total = after
        rows.append(new)
        if not len(act):
            break
    return np.stack(rows), alone, seen.astype(np.int64)


def sums(path: np.ndarray, n: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of sorted keys: the sum over those of the same beginning, and whether they
    are one key only."""
    prefix = path >> np.uint64(shift)
    edge = np.flatnonzero(np.diff(prefix, prepend=~prefix[:1]))
    end = np.append(edge[1:], len(path))
    one = path[edge] >> np.uint64(1) == path[end - 1] >> np.uint64(1)
    return np.repeat(np.add.reduceat(n, edge), end - edge), np.repeat(one, end - edge)


# -- predictions


def stretched(p):
    return np.log(p) - np.log1p(-p)


def learned_states(seen: np.ndarray) -> np.ndarray:
    """(256): for each state the stretched probability of the side that came, from how often
    training tokens' bits had it and had that of the sides exchanged."""
    k = np.arange(256)
    back = k & 0xF0 | (16 - (k & 15)) & 15
    middle = np.sign((k & 15) - 8.0) * np.asarray([0.0, 0.5, 1.0, 1.6, 2.5, 3.7, 5.5, 7.5, 7.5])[np.abs((k & 15) - 8)]
    prior = 1 / (1 + 2.0 ** -middle)
    p = (seen + 4 * prior) / (seen + seen[back] + 4)
    return np.where(k & 15, stretched(np.clip(p, 1e-6, 1 - 1e-6)), 0).astype(np.float32)


#: How well a context is known, by the state's grade; the two add to a gate.
KNOWN_LAST = STEPS_PAIR * np.searchsorted([1, 6, 9], np.arange(256) >> 4, side="right").astype(np.uint8)
KNOWN_PAIR = np.searchsorted([1, 2, 4], np.arange(256) >> 4, side="right").astype(np.uint8)
#: Weights at the beginning of a text: of a path's bits by how well the last common word is
#: known and, in each row, the two words before (no context, the last, the two); of a
#: spelling's by the longest known order.
START_PATH = (
    ((1.0, 0.0, 0.0), (0.35, 0.0, 1.4), (0.25, 0.0, 1.5), (0.1, 0.0, 1.5)),
    ((0.5, 0.5, 0.0), (0.2, 0.3, 0.9), (0.15, 0.35, 0.85), (0.05, 0.25, 1.0)),
    ((0.4, 0.6, 0.0), (0.15, 0.4, 0.9), (0.1, 0.4, 0.85), (0.05, 0.3, 1.0)),
    ((0.3, 0.7, 0.0), (0.1, 0.45, 0.7), (0.1, 0.5, 0.65), (0.0, 0.35, 0.8)),
)
START_SPELLED = ((0.0, 0.0, 0.0), (0.4, 0.0, 0.0), (0.3, 0.55, 0.0), (0.0, 0.55, 0.55))


def begin() -> np.ndarray:
    """(inputs, gates)"""
    return np.asarray([*(w for row in START_PATH for w in row), *START_SPELLED], np.float32).T.copy()


LOGIT = np.arange(-REACH * FINE, REACH * FINE + 1, dtype=np.float32) / FINE
GAP = 1 / (1 + np.exp(LOGIT))  # the probability of the side that did not come
LOG = -np.log1p(np.exp(-LOGIT))
SURE = np.float32(30)


@dataclass
class Model:
    dictionary: Dictionary
    states: np.ndarray
    spellings: np.ndarray
    p: Params
    begin: np.ndarray = field(default_factory=begin)

    def __post_init__(self) -> None:
        d = self.dictionary
        mass = np.where(d.words > 0, d.tokens + 0.5, 0)
        mass[0] = d.words[0] + 0.5  # tokens that would be new, were they left out
        node = lambda level, j: mass.reshape(1 << j, -1).sum(axis=1)[level >> (codes.LEVEL_BITS - j)]
        every = np.arange(codes.LEVELS)
        at = np.stack([node(every, j) for j in range(codes.LEVEL_BITS + 1)])
        with np.errstate(divide="ignore", invalid="ignore"):  # levels without words
            self.level_bit = np.minimum(np.log(at[1:] / (at[:-1] - at[1:])), SURE).astype(np.float32)
            self.level_rest = np.log(mass) - np.log(at) - np.log(np.maximum(d.words, 1)) * (every > 0)
        # of level 0, tokens whose word another token has: were they left out, words of two are of one
        again = (2 * d.twice + 0.5) / (d.words[0] + 2 * d.twice + 1)
        self.seen_once, self.new = np.log(again / max(1, d.words[0])), np.log(1 - again)
        k = np.arange(256, dtype=np.float32)
        self.logs = np.log(k + np.float32(0.4))
        self.pairs = self.spellings.view("<u2")

    def path_bits(self, t: Tokens, lo: int, hi: int, act: np.ndarray, last: np.ndarray, pair: np.ndarray, rest: np.ndarray) -> Iterator[tuple]:
        """(token, gate, inputs) of the bits to mix of tokens lo to hi, in the order act gives;
        last, pair: the states of their bits (depth, token). rest takes the log probability of
        the others."""
        d, first = self.dictionary, codes.LEVEL_BITS
        word = t.stream[lo:hi]
        level, rank = t.level[word].astype(np.intp), t.rank[word]
        bits, words = d.bits[level].astype(np.int32), d.words[level]
        for j in range(len(last)):
            a, c = last[j].take(act), pair[j].take(act)
            some = (a | c) > 0
            out = act[~some]
            if j <= first:
                rest[out] += self.level_rest[j].take(level.take(out))
            else:
                rest[out] -= np.log(self.below(rank[out], bits[out], words[out], j - first))
            stay = np.flatnonzero(some & (bits.take(act) > j - first) if j >= first else some)  # the path of the others is complete
            if not len(stay):
                return
            act, a, c = act.take(stay), a.take(stay).astype(np.intp), c.take(stay).astype(np.intp)
            x = np.zeros((INPUTS, len(act)), np.float32)
            if j < first:
                x[0] = self.level_bit[j].take(level.take(act))
            else:
                # both sides have as many words, but where the level's last words are
                left = bits.take(act) - (j - first)
                edge = np.flatnonzero((rank.take(act) >> left) + 1 << left > words.take(act))
                k = act.take(edge)
                size, after = (self.below(rank[k], bits[k], words[k], j + i - first) for i in (0, 1))
                with np.errstate(divide="ignore"):
                    x[0, edge] = np.minimum(np.log(after / (size - after)), SURE)
            x[1], x[2] = self.states[LAST].take(a), self.states[PAIR].take(c)
            gate = KNOWN_LAST.take(a) + KNOWN_PAIR.take(c)
            if (x[0] >= SURE).any():  # no word is on the other side
                keep = np.flatnonzero(x[0] < SURE)
                yield act.take(keep), gate.take(keep), x[:, keep]
            else:
                yield act, gate, x

    @staticmethod
    def below(rank: np.ndarray, bits: np.ndarray, words: np.ndarray, j: int) -> np.ndarray:
        """Words of the level whose ranks have the same first j bits."""
        left = np.maximum(bits - j, 0)
        low = rank >> left << left
        return np.minimum(words, low + (np.int64(1) << left)) - low

    def spelled_bits(self, words: list[bytes], own: np.ndarray) -> Iterator[tuple]:
        """(word, gate, inputs) of the bits of the words' spellings, bytes' first bits, second
        ones and so on; own: the words to leave out."""
        text = Spelled(words)
        word, m = np.repeat(np.arange(len(words)), text.sizes), len(text.symbols)
        less = own.astype(np.uint16).take(word)
        contexts = list(text.contexts())
        for b in range(8):
            node, high = text.nodes(b), (((text.symbols >> (7 - b)) & 1) << 3).astype(np.uint16)
            x, known = np.empty((INPUTS, m), np.float32), np.zeros(m, np.uint8)
            for k, context in enumerate(contexts):
                both = self.pairs[k].take(slot(context, node) >> 1)  # the counts of zeros and ones
                came, other = both >> high & 255, both >> (8 - high) & 255
                came -= np.minimum(came, less)
                x[k] = self.logs.take(came) - self.logs.take(other)
                np.copyto(known, k + 1, where=(came | other) > 0)
            yield word, known + np.uint8(WORD_GATES), x

    def mixed(self, decisions: list[tuple], text: np.ndarray, block: np.ndarray, texts: int) -> np.ndarray:
        """Log probabilities of the texts' bits. decisions: (token, gate, inputs), each with its
        tokens in the order of their blocks; weights are learned block after block."""
        blocks = np.arange(int(block.max()) + 2)
        edges = [np.searchsorted(block.take(token), blocks) for token, _, _ in decisions]
        first = text * GATES
        parts = [(first.take(token) + gate, x) for token, gate, x in decisions]
        weights, size = np.tile(self.begin, (1, texts)), texts * GATES
        seen, total = np.zeros(size, np.float32), np.zeros(size)
        for b in blocks[:-1]:
            cut = [(slice(e[b], e[b + 1]), *part) for e, part in zip(edges, parts, strict=True) if e[b] < e[b + 1]]
            if not cut:
                continue
            at = np.concatenate([where[mine] for mine, where, _ in cut])
            own = np.concatenate([x[:, mine] for mine, _, x in cut], axis=1)
            logit = own[0] * weights[0].take(at)
            for k in range(1, INPUTS):
                logit += own[k] * weights[k].take(at)
            np.minimum(np.maximum(logit, -REACH, out=logit), REACH, out=logit)
            logit *= FINE
            logit += REACH * FINE + 0.5
            step = logit.astype(np.intp)
            gap = GAP.take(step)
            total += np.bincount(at, LOG.take(step), size)
            seen += np.bincount(at, minlength=size)
            scale = (self.p.rate / np.sqrt(1 + seen / 16)).astype(np.float32)
            for k in range(INPUTS):
                weights[k] += scale * np.bincount(at, gap * own[k], size).astype(np.float32)
        return total.reshape(texts, GATES).sum(axis=1)

    def long_word(self, word: bytes, own: bool) -> float:
        """Log probability of one long word, with the weights that a text begins with."""
        total = 0.0
        for lo in range(0, len(word) + 1, 1 << 16):  # each piece after the bytes that its contexts reach back to
            part = word[max(0, lo - max(ORDERS)) : lo + (1 << 16)]
            use = slice(lo - max(0, lo - max(ORDERS)), len(part) + (lo + (1 << 16) > len(word)))
            for _, gate, x in self.spelled_bits([part], np.asarray([own])):
                logit = np.clip((self.begin[:, gate] * x).sum(axis=0), -REACH, REACH)
                total -= np.log1p(np.exp(-logit[use])).sum(dtype=np.float64)
        return float(total)


def block_of(place: np.ndarray) -> np.ndarray:
    """Blocks of 8, 8, 16, 32 words and so on, up to 512 and then always 512."""
    place = np.asarray(place, np.int64)
    early = np.floor(np.log2(np.maximum(place, 4) / 4)).astype(np.int64)
    return np.where(place < 1024, early, 7 + place // 512).astype(np.uint16)


class Paths:
    """The states that the buckets of keys sent for a chunk's keys of one kind."""

    def __init__(self, t: Tokens, rows: list[tuple[str, int, bytes]], kind: int, shift: int, p: Params) -> None:
        found = t.keys(kind, p)
        every, at = np.unique(np.concatenate([x[1] << np.uint64(1) | t.own[x[0]] for x in found]), return_inverse=True)
        ends = np.cumsum([0, *(len(x[1]) for x in found)])
        self.found = [(places, at[a:b], before, size) for (places, _, before, size), a, b in zip(found, ends[:-1], ends[1:], strict=True)]
        replies = {part: x for own, part, x in rows if own == PATHS[kind]}
        buckets, sizes = np.unique((every >> np.uint64(shift + 1)).astype(np.int64), return_counts=True)
        own = [codes.unpack_states(replies[b], n) for b, n in zip(buckets.tolist(), sizes.tolist(), strict=True)]
        self.states, done = np.empty((len(every), max((x.shape[1] for x in own), default=1)), np.uint8), 0  # by key
        for x in own:
            self.states[done : done + len(x), : x.shape[1]] = x
            self.states[done : done + len(x), x.shape[1] :] = x[:, -1:]
            done += len(x)

    def of(self, lo: int, hi: int, depth: int) -> np.ndarray:
        """(depth, tokens): the states of the bits of tokens lo to hi."""
        out = np.zeros((hi - lo, depth), np.uint8)
        for places, at, before, size in self.found:
            a, b = np.searchsorted(places, (lo, hi))
            for start in np.unique(before[a:b]):
                some = slice(a, b) if (before[a:b] == start).all() else np.flatnonzero(before[a:b] == start) + a
                wide = min(int(size[some].max()), self.states.shape[1], depth - start)
                if wide > 0:
                    mine = self.states.take(at[some], axis=0)[:, :wide]
                    out[places[some] - lo, start : start + wide] = mine
                    out[places[some] - lo, start + wide :] = mine[:, -1:]
        return np.ascontiguousarray(out.T)


def _score(model: Model, shift: int):
    """A chunk's texts with the counts of its words and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "part", "data")), strict=True))
        del table
        t = Tokens(rows, model.dictionary)
        (rare,) = (parts_of(x) for kind, _, x in rows if kind == "rare")
        paths = [Paths(t, rows, kind, shift, model.p) for kind in (LAST, PAIR)]
        del rows
        yield scores_of(t, paths, rare, model)
        del t, paths, rare
        give_back()

    return run


def scores_of(t: Tokens, paths: list[Paths], rare: list[bytes], model: Model) -> pa.RecordBatch:
    p, d = model.p, model.dictionary
    n = int(d.tokens.sum())
    distinct = int(d.words.sum())
    low = np.log10(t.count + 0.1) - np.log10(n + 0.1 * (distinct + 1))
    base = np.add.reduceat(low[t.stream], t.first)
    known = np.add.reduceat((t.count > 0)[t.stream].astype(np.int64), t.first)
    spelled = dict(zip(np.flatnonzero(unpack(rare[0], bool)).tolist(), codes.unsqueezed(rare[1]).split(b" "), strict=False))
    score, ends, lo = np.zeros(len(t.tokens)), np.cumsum(t.tokens), 0
    while lo < len(t.tokens):
        hi = max(lo + 1, int(np.searchsorted(ends, t.first[lo] + p.step_tokens, side="right")))
        score[lo:hi] = some_scores(t, paths, model, spelled, lo, hi)
        lo = hi
    score /= np.log(10)
    bits = np.where(t.sizes > 0, -score * np.log2(10) / np.maximum(t.sizes, 1), np.nan)
    return pa.RecordBatch.from_arrays(
        [pa.array(t.ids, mask=t.none), pa.array(t.held), pa.array(t.tokens), pa.array(known), pa.array(np.full(len(t.tokens), n)), pa.array(base), pa.array(score), pa.array(bits, from_pandas=True)],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
    )


def some_scores(t: Tokens, paths: list[Paths], model: Model, rare: dict[int, bytes], lo: int, hi: int) -> np.ndarray:
    """Natural logs of the probabilities of texts lo to hi."""
    a, b = int(t.first[lo]), int(t.first[hi - 1] + t.tokens[hi - 1])
    text, place = t.text[a:b] - lo, np.arange(a, b) - t.first[t.text[a:b]]
    block = block_of(place)
    order = np.argsort(block, kind="stable")
    depth = codes.LEVEL_BITS + int(model.dictionary.bits.max(initial=0))
    rest = np.zeros(b - a)
    decisions = list(model.path_bits(t, a, b, order, *(x.of(a, b, depth + 1) for x in paths), rest))
    count, own = t.count.take(t.stream[a:b]), t.own[a:b]
    known = (count == 1) & ~own
    rest[known] += model.seen_once
    new = (count <= 1) & ~known
    rest[new] += model.new
    spelled = order[new.take(order)]
    words = [rare[k] for k in t.stream[a:b][spelled].tolist()]
    long = [k for k, w in enumerate(words) if len(w) > model.p.long_word]
    for k in long:
        rest[spelled[k]] += model.long_word(words[k], bool(own[spelled[k]]))
        words[k] = None
    if long:
        words, spelled = [w for w in words if w is not None], np.delete(spelled, long)
    if words:
        decisions += [(spelled.take(word), gate, x) for word, gate, x in model.spelled_bits(words, own[spelled])]
    out = np.bincount(text, rest, hi - lo)
    return out + model.mixed(decisions, text, block, hi - lo) if decisions else out


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def power_above(x: float) -> int:
    """The smallest b for which 2^b is at least x."""
    return max(0, int(np.ceil(np.log2(max(1.0, x)))))


def about(rows: DataFrame) -> int:
    """Bytes of the texts, as the plan estimates them from its files, and counted where it cannot."""
    guess = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return guess if guess < 1 << 60 else rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def scored(docs: DataFrame, held_out: Column, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and
    bits_per_byte of every row of docs(doc_id, text).

    The model learns from the rows for which held_out is not true. Null and empty texts are
    an end token alone, and have no bits per byte. Rows that repeat count, and are scored, as
    often as they occur; doc_id is only carried along and may be null. Extra columns are
    ignored. Without training rows every count is 0 and each bit of a spelling costs one
    bit; an empty table gives no rows. A word of more than p.long_word bytes is spelled with
    the weights a text begins with.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    word_buckets = min(power_above(about(rows) / p.bucket_bytes), power_above(p.most_buckets))
    chunks = written(rows.mapInArrow(_chunks(64 - word_buckets, p), ROW), "chunks", "kind", "uncompressed")
    size = chunks.where("kind = 'texts'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = power_above(size / p.bucket_bytes)
    replies = written(chunks.where("kind = 'words'").groupBy("part").applyInArrow(_words, ROW), "codes", "kind", "uncompressed")
    remove(chunks, "kind=words")
    stats = replies.where("kind = 'levels'").select("part", "data").collect()  # 128 numbers for each of at most p.most_buckets
    words, tokens = np.zeros((1 << word_buckets, codes.LEVELS), np.int64), np.zeros(codes.LEVELS, np.int64)
    twice = 0
    for r in stats:
        own = [np.frombuffer(x, np.int64) for x in parts_of(r.data)]
        words[r.part] = own[0]
        tokens += own[1]
        twice += int(own[2][0])
    dictionary = Dictionary(np.cumsum(words, axis=0) - words, words.sum(axis=0), tokens, twice)
    tables = np.zeros((len(ORDERS), 2 << BITS), np.int32)
    for r in replies.where("kind = 'spellings'").groupBy("part").applyInArrow(_add_blocks, "part int, data binary").collect():  # tables of a fixed size
        tables.reshape(-1, BLOCK)[r.part] = np.frombuffer(codes.unsqueezed(r.data), np.int32)
    if stats:
        remove(replies, "kind=spellings")
    mine = chunks.where("kind = 'texts'").unionByName(replies.where("kind = 'codes'"))
    seen, paths = np.zeros((2, 256)), {}
    for kind in (PAIR, LAST):  # one after the other, the larger first, so that fewer keys are on disk at a time
        keys = mine.groupBy("chunk").applyInArrow(_contexts(codes.KEY_BITS - buckets, dictionary, kind, p), ROW)
        paths[kind] = written(keys.groupBy("part").applyInArrow(_paths(dictionary.bits, kind, p.least), ROW), "paths", compression="uncompressed")
        for r in paths[kind].where("kind = 'states'").groupBy("part").agg(F.sum("n").alias("n")).collect():  # at most 256
            seen[kind, r.part] = r.n
    model = Model(dictionary, np.stack([learned_states(x) for x in seen]), as_bytes(tables), p)
    mine = mine.unionByName(chunks.where("kind = 'rare'"))
    for kind in (LAST, PAIR):
        mine = mine.unionByName(paths[kind].where(F.col("kind") == PATHS[kind]))
    out = []
    for k in range(2):  # half the chunks at a time, for the same reason
        half = mine.where(F.pmod(F.xxhash64("chunk"), F.lit(2)) == k)
        out.append(written(half.groupBy("chunk").applyInArrow(_score(model, codes.KEY_BITS - buckets), SCORED), "scores"))
    for table in (chunks, replies, *paths.values()):
        remove(table)
    return out[0].unionByName(out[1])
