"""Sets of hashed word shingles, vectorised over a text's bytes.

Words are runs of anything but space and U+0009 to U+000D, with A-Z lower-cased. A shingle is ``size`` words in a row; a text with fewer
words, but at least one, has its whole word sequence as its only shingle. Shingles are 64-bit hashes.

A text is read in blocks of ``BLOCK`` bytes; of a word that a block cuts, the hash so far is carried on. So a long text needs room for its
distinct shingles, eight bytes each, beside the text and a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], "u1")
_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEPS = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]
BLOCK = 1 << 18


def _power_table(base: int) -> np.ndarray:
    p = np.full(BLOCK + 1, base, "u8")
    p[0] = 1
    return np.multiply.accumulate(p)


_POWERS, _INVERSES = _power_table(_BASE), _power_table(_INVERSE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_blocks(text: str) -> Iterator[np.ndarray]:
    """The hashes of the words in order, block by block. A word's hash is the sum of its bytes (plus one) times powers of the base, mixed with its length."""
    held, length = np.uint64(0), 0  # of a word that the block before cut
    for at in range(0, len(text), BLOCK // 4):
        a = _LOWER[np.frombuffer(text[at : at + BLOCK // 4].encode("utf-8", "replace"), "u1")]
        inside = np.concatenate(([False], ~_BREAK[a], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(a) + 1, "u8")
        np.cumsum((a.astype("u8") + np.uint64(1)) * _POWERS[: len(a)], out=sums[1:])
        hashes, sizes = (sums[ends] - sums[starts]) * _INVERSES[starts], (ends - starts).astype("u8")
        if length:
            if len(starts) and starts[0] == 0:
                hashes[0] = (int(held) + int(hashes[0]) * pow(_BASE, length, 1 << 64)) & ((1 << 64) - 1)
                sizes[0] += np.uint64(length)
            else:
                yield mix(np.array([held], "u8") + np.uint64(length))
            length = 0
        if len(ends) and ends[-1] == len(a) and at + BLOCK // 4 < len(text):
            held, length = hashes[-1], int(sizes[-1])
            hashes, sizes = hashes[:-1], sizes[:-1]
        if len(hashes):
            yield mix(hashes + sizes)


def word_hashes(text: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, "u8"), *word_blocks(text)])


def _runs(w: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of size words."""
    n = len(w) - size + 1
    h = np.zeros(n, "u8")
    for k in range(size):
        h += mix(w[k : k + n] + np.uint64(_STEPS[k % len(_STEPS)] ^ k))
        h *= np.uint64(_BASE)
    return mix(h)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct shingles, ascending."""
    held, found, waiting = np.zeros(0, "u8"), [], 0
    for w in word_blocks(text or ""):
        held = np.concatenate((held, w)) if len(held) else w
        if len(held) >= size:
            found.append(np.unique(_runs(held, size)))
            waiting += len(found[-1])
            held = held[len(held) - size + 1 :]
            if waiting > 2 * len(found[0]) + BLOCK:  # repeats are dropped as they come
                found, waiting = [np.unique(np.concatenate(found))], 0
    if found:
        return found[0] if len(found) == 1 else np.unique(np.concatenate(found))
    if not len(held):
        return held
    h = np.uint64(len(held))
    for x in held:
        h = mix(np.array([h ^ x], "u8"))[0] + np.uint64(1)
    return np.array([h], "u8")
