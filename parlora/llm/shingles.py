"""Vectorized tokens, n-gram hashes and MinHash for batches of texts.

A token is a maximal run of ASCII letters and digits or non-ASCII characters, after ``str.lower``. Its hash is a
polynomial over the UTF-8 bytes modulo 2**64, read off a prefix sum, so a whole batch is hashed without a Python
loop over tokens. An n-gram hash combines n token hashes; a text with fewer than n tokens, but at least one, has
one n-gram made of all of them. Null and token-free texts have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_GRAM = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
_WORD = np.zeros(256, np.int8)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))

#: Bytes of text that are hashed at a time.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        up, down = np.full(size, _P, U64), np.full(size, _PINV, U64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def chunks(texts: list[str | None], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Slices (first, last, lowered UTF-8) of ``texts`` of about ``most`` bytes; a longer text is a slice alone."""
    at, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.lower().encode("utf-8", "replace") if text else b""
        if held and size + len(raw) > most:
            yield at, i, held
            at, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield at, len(texts), held


def token_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and the offsets at which each text's tokens begin (one more than texts)."""
    buf = np.frombuffer(b"\0".join(raws) + b"\0", np.uint8)
    ends_of_text = np.cumsum(np.fromiter((len(r) + 1 for r in raws), np.int64, len(raws)))
    step = np.diff(_WORD[buf], prepend=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _power_tables(len(buf) + 1)
    total = np.empty(len(buf) + 1, U64)
    total[0] = 0
    np.cumsum((buf.astype(U64) + U64(1)) * up[: len(buf)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    offsets = np.concatenate(([0], np.searchsorted(starts, ends_of_text)))
    return hashes, offsets


def gram_hashes(tokens: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all token n-grams in order, and the offsets at which each text's n-grams begin."""
    sizes = np.diff(offsets)
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    goff = np.concatenate(([0], np.cumsum(counts)))
    total = int(goff[-1])
    if not total:
        return np.empty(0, U64), goff
    at = np.arange(total) + np.repeat(offsets[:-1] - goff[:-1], counts)
    padded = np.concatenate((tokens, np.zeros(n, U64)))
    out = padded[at] * U64(_GRAM[0])
    for k in range(1, n):
        out += padded[at + k] * U64(_GRAM[k % 5] + 2 * (k // 5))
    for d in np.flatnonzero((sizes > 0) & (sizes < n)):
        own = tokens[offsets[d] : offsets[d + 1]]
        out[goff[d]] = sum(int(t) * (_GRAM[k % 5] + 2 * (k // 5)) for k, t in enumerate(own)) % (1 << 64)
    return mix(out), goff


def unique_sets(grams: np.ndarray, goff: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    out = []
    for a, b in zip(goff[:-1], goff[1:]):
        own = np.sort(grams[a:b])
        if len(own) > 1:
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        out.append(own)
    return out


def minhash_family(k: int, seed: int = 0x5EED) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of k permutations of 32-bit values."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def minhash(grams: np.ndarray, goff: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """MinHash signatures (texts x k) as uint32; a text without n-grams has the largest value throughout."""
    low = (grams >> U64(32)).astype(np.uint32)
    a, b = family
    out = np.full((len(goff) - 1, len(a)), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(np.diff(goff))
    if not len(filled):
        return out
    begin = goff[filled]
    work = np.empty(len(low), np.uint32)
    for k in range(len(a)):
        np.multiply(low, a[k], out=work)
        np.add(work, b[k], out=work)
        out[filled, k] = np.minimum.reduceat(work, begin)
    return out
