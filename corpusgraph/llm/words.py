"""Vectorised word work on UTF-8 bytes: word bounds, word hashes, shingle hashes.

All separators are ASCII, so words can be found on bytes; a byte of 0x80 or more always
belongs to a character of U+0080 or more.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
#: Hash constants, drawn once from a fixed seed; they define the hashes of stored tables.
_RNG = np.random.default_rng(20240117)
SEED, ORDER_SEED, KEY = U(int(_RNG.integers(1 << 62, 1 << 63))), U(int(_RNG.integers(1 << 62, 1 << 63))), _RNG.bytes(32)
#: Byte spans longer than this are hashed one by one by a keyed cryptographic hash.
LONG_SPAN = 512


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def multipliers(n: int) -> np.ndarray:
    """n odd multipliers, one for each place of a window; the k-th doesn't depend on n."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * ORDER_SEED) | U(1)


#: Multipliers of single uses: set digests, band keys, row keys.
ORDER = multipliers(64)


def byte_table(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


#: Words of [^\x20\x09-\x0D]+ and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
SPACED = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

def bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows): byte bounds of all words; row r has the words rows[r] to rows[r+1]."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = table[data]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    first, end = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[full] = inside[full]
    end[:-1] &= ~inside[1:]
    end[last] = inside[last]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: its length and then its 8-byte lanes go through `mix` one by
    one, so what a lane does depends on all before it and no rule of the text cancels out, as it does
    in a polynomial modulo a power of two. Two different spans agree with probability 2 ** -64.
    """
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))
    with np.errstate(over="ignore"):
        h = mix(size.astype(np.uint64) * ORDER[60] + SEED)
    short = size <= LONG_SPAN
    every = short.all()
    live = np.arange(len(size)) if every else np.flatnonzero(short)
    at, left = (starts, size) if every else (starts[live], size[live])
    while len(live):
        tail = U(64) - U(8) * np.minimum(np.maximum(left, 1), 8).astype(np.uint64)
        lane = (lanes[at] << tail) >> tail
        h[live] = mix(h[live] ^ np.where(left > 0, lane, U(0)))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    if not every:
        raw = data.tobytes()
        for k in np.flatnonzero(~short).tolist():
            h[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]], digest_size=8, key=KEY).digest(), "little")
    return h


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words, by its first word; empty for fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    by = multipliers(size)
    with np.errstate(over="ignore"):
        out = words[:n] * by[0]
        for k in range(1, size):
            out += words[k : k + n] * by[k]
        return mix(out)


def sequence_hash(words: np.ndarray) -> np.uint64:
    """The hash of a whole sequence of words, apart from that of any window of as many."""
    with np.errstate(over="ignore"):
        return mix((words * multipliers(len(words))).sum(keepdims=True) + mix(np.full(1, len(words), np.uint64) + SEED))[0]


def counts(rows: np.ndarray) -> np.ndarray:
    return np.diff(rows)


def row_sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of the values of each row's range."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[rows[1:]] - total[rows[:-1]]
