"""Words as binary codes, and contexts of words as hashed keys, for the mixing model.

A word of at least two training tokens has a level, the logarithm of its count, and a rank
within the level. Its path is five bits of the level and then the rank's bits, as many as
the level's words need. All other words are of level 0, whose path is the five bits alone.

A key is 36 bits of a context's hash, a bit for the kind of context, a bit that tells whole
paths from pieces, and 25 bits of path, left-aligned; the top bit is free. Contexts that
may be very frequent are cut into pieces of at most eight bits (five for the level), each a
context of its own together with the bits before it. So a key's context either occurs a
bounded number of times or has at most 256 successors.
"""

from __future__ import annotations

import numpy as np
import zstandard

LEVELS, LEVEL_BITS = 32, 5
CODE_BITS, CONTEXT_BITS = 25, 36
KEY_BITS = CONTEXT_BITS + 2 + CODE_BITS
WHOLE = CODE_BITS - LEVEL_BITS  # rank bits that a whole path's key can hold
PIECE = 8
START = np.uint64(1 << 60)  # stands for the words before a text
END = b" "  # no word holds a space; stands for the end of a text

U64 = np.uint64


# -- arrays as bytes


squeezed = zstandard.ZstdCompressor(1).compress
unsqueezed = zstandard.ZstdDecompressor().decompress


def pack(values: np.ndarray) -> bytes:
    """An array's bytes, all first bytes before all second ones, compressed."""
    values = np.ascontiguousarray(values)
    return squeezed(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T))


def unpack(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(unsqueezed(data), np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


def pack_keys(values: np.ndarray) -> bytes:
    """Sorted keys with a last bit: the differences of their contexts, and their paths as
    differences where the context is the same."""
    low = np.uint64(CODE_BITS + 1)
    context, path = values >> low, values & np.uint64((1 << CODE_BITS + 1) - 1)
    step = np.diff(context, prepend=np.uint64(0))
    less = np.concatenate([[np.uint64(0)], path[:-1]])
    return bundle(pack(step), pack((path - np.where(step, np.uint64(0), less)).astype(np.uint32)))


def unpack_keys(data: bytes) -> np.ndarray:
    step, path = (unpack(x, t) for x, t in zip(parts_of(data), (np.uint64, np.uint32), strict=True))
    context, path = np.cumsum(step, dtype=np.uint64), np.cumsum(path, dtype=np.uint64)
    start = np.flatnonzero(step)
    if not len(step) or step[0] == 0:
        start = np.concatenate([[0], start[start > 0]]) if len(step) else start
    before = np.concatenate([[np.uint64(0)], path])[start]
    path -= np.repeat(before, np.diff(start, append=len(step)))
    return context << np.uint64(CODE_BITS + 1) | path


def bundle(*parts: bytes) -> bytes:
    return np.asarray([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def parts_of(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data[:8], np.int64)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(data[8 : 8 * (n + 1)], np.int64))
    return [data[a:b] for a, b in zip([8 * (n + 1), *ends[:-1]], ends, strict=True)]


# -- pairs of counts as one byte


#: Steps of the logarithm of a ratio, on either side of none.
STEPS = np.asarray([0.25, 0.75, 1.25, 2.0, 3.0, 4.5])
ALL = 15  # the step where no token is on the other side


def grade(n: np.ndarray) -> np.ndarray:
    """Counts up to 4 as they are, others in one step for each doubling, 15 at most."""
    return np.where(n <= 4, n, np.minimum(2 + np.floor(np.log2(np.maximum(n, 4))), 15)).astype(np.uint8)


def _state(came: np.ndarray, other: np.ndarray) -> np.ndarray:
    ratio = np.log2((came + 0.5) / (other + 0.5))
    step = (8 + np.sign(ratio) * np.searchsorted(STEPS, np.abs(ratio))).astype(np.uint8)
    step = np.where(other == 0, ALL, np.where(came == 0, 16 - ALL, step)).astype(np.uint8)
    return np.where(came + other > 0, grade(came + other) << 4 | step, 0).astype(np.uint8)


FEW = 64
SMALL = _state(*np.divmod(np.arange(FEW * FEW), FEW))


def state(came: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The tokens on the side that came and on the other as one byte, 0 for none: the grade of
    their sum and the ratio's step, from 1 to 15. With the sides exchanged the step is 16 less it."""
    out = SMALL.take(np.minimum(came, FEW - 1) * FEW + np.minimum(other, FEW - 1))
    big = np.flatnonzero(np.maximum(came, other) >= FEW)
    out[big] = _state(came.take(big), other.take(big))
    return out


def pack_states(states: np.ndarray, alone: np.ndarray) -> bytes:
    """The states by row, a column for each key: 0 is followed by 0 only and, from the row on
    that alone gives, all are the same and of step ALL."""
    out, act, before = [], np.arange(states.shape[1]), np.zeros(states.shape[1], np.uint8)
    for k, row in enumerate(states):
        here, ends = row.take(act), alone.take(act) == k
        sent = np.where(ends | (here == 0), here & 0xF0, here - (before & 0xF0))  # the grade's difference and the step
        out.append(sent)
        stay = np.flatnonzero(~ends & (here > 0))
        act, before = act.take(stay), here.take(stay)
        if not len(act):
            break
    return len(states).to_bytes(4, "little") + squeezed(np.concatenate(out) if out else b"")


def unpack_states(data: bytes, keys: int) -> np.ndarray:
    """(keys, rows)"""
    out = np.zeros((keys, int.from_bytes(data[:4], "little")), np.uint8)
    rows, done = np.frombuffer(unsqueezed(data[4:]), np.uint8), 0
    act, before = np.arange(keys), np.zeros(keys, np.uint8)
    for k in range(out.shape[1]):
        sent = rows[done : done + len(act)]  # of those that have not ended
        done += len(act)
        ends = sent & 15 == 0
        out[act[ends], k:] = np.where(sent[ends], sent[ends] | ALL, 0)[:, None]
        stay = np.flatnonzero(~ends)
        act, before = act.take(stay), sent.take(stay) + (before.take(stay) & 0xF0)
        out[act, k] = before
        if not len(act):
            break
    return out


# -- levels and paths


def levels(count: np.ndarray) -> np.ndarray:
    """0 for words of fewer than two training tokens, else one for each doubling."""
    return np.minimum(np.log2(np.maximum(count, 1)), LEVELS - 1).astype(np.uint8)


def rank_bits(words: np.ndarray) -> np.ndarray:
    """For each level the bits that a rank takes."""
    return np.asarray([max(0, int(n) - 1).bit_length() for n in words], np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9FB21C651E98DF25)
    x = x ^ (x >> U64(28))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def key(context: np.ndarray, kind: int, piece: int, code: np.ndarray) -> np.ndarray:
    return (context >> U64(64 - CONTEXT_BITS) << U64(CODE_BITS + 2)) | U64(kind << (CODE_BITS + 1) | piece << CODE_BITS) | code


def keys(context: np.ndarray, kind: int, level: np.ndarray, rank: np.ndarray, d: np.ndarray, hot: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The keys of successors (level, rank, the rank's bits d) of contexts: tuples of the
    places they belong to, keys, the path's bits before them, and their own bits."""
    out = []
    level, rank, d = level.astype(U64), rank.astype(U64), d.astype(np.int64)
    cold = np.flatnonzero(~hot)
    if len(cold):
        own = d[cold]
        # left-aligned in WHOLE bits; what does not fit is left to the pieces
        code = np.where(own <= WHOLE, rank[cold] << (WHOLE - np.minimum(own, WHOLE)).astype(U64), rank[cold] >> np.maximum(own - WHOLE, 0).astype(U64))
        out.append((cold, key(context[cold], kind, 0, level[cold] << U64(WHOLE) | code), np.zeros(len(cold), np.uint8), (LEVEL_BITS + np.minimum(own, WHOLE)).astype(np.uint8)))
    warm = np.flatnonzero(hot)
    if len(warm):
        code = level[warm] << U64(WHOLE) | U64(LEVEL_BITS)
        out.append((warm, key(context[warm], kind, 1, code), np.zeros(len(warm), np.uint8), np.full(len(warm), LEVEL_BITS, np.uint8)))
    done = np.where(hot, 0, np.minimum(d, WHOLE))
    while len(at := np.flatnonzero(done < d)):
        size = np.minimum(PIECE, d[at] - done[at])
        before = rank[at] >> (d[at] - done[at]).astype(U64)
        here = rank[at] >> (d[at] - done[at] - size).astype(U64) & ((U64(1) << size.astype(U64)) - U64(1))
        inner = mixed(context[at] ^ (level[at] << U64(48) | done[at].astype(U64) << U64(40) | before) * U64(0xA24BAED4963EE407))
        code = here << (CODE_BITS - size).astype(U64) | size.astype(U64)
        out.append((at, key(inner, kind, 1, code), (LEVEL_BITS + done[at]).astype(np.uint8), size.astype(np.uint8)))
        done[at] += size
    return out


def bits_of(found: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How many bits of path each key stands for; d by level."""
    code = found & U64((1 << CODE_BITS) - 1)
    whole = LEVEL_BITS + np.minimum(d[(code >> U64(WHOLE)).astype(np.int64)], WHOLE)
    return np.where(found >> U64(CODE_BITS) & U64(1) == 1, code & U64(15), whole).astype(np.int64)
