"""Entropy coders for small alphabets: range coding with fixed and adaptive frequencies, and asymmetric numeral systems.

All work on arrays of symbols and carry what decoding needs; they are sequential, so row groups that use them are kept small.
"""

from __future__ import annotations

import numpy as np

from colonnade.codecs.integers import bitmap_decode, bitmap_encode, unzigzag, varint_decode, varint_encode, zigzag


def normalised(counts: np.ndarray, scale: int) -> np.ndarray:
    """Frequencies that sum to scale, at least one for each symbol that occurs; by largest remainders."""
    used = np.flatnonzero(counts)
    if len(used) > scale:
        raise ValueError("more symbols than the scale has room for")
    out = np.zeros(len(counts), "i8")
    if not len(used):
        return out
    c, total = counts[used].astype(object), int(counts.sum())
    base = np.array([max(1, int(x) * scale // total) for x in c], "i8")
    rest = [int(x) * scale % total for x in c]
    need = scale - int(base.sum())
    up = sorted(range(len(used)), key=lambda i: (-rest[i], -int(c[i]), i))
    while need > 0:
        for i in up:
            if need:
                base[i] += 1
                need -= 1
    for i in reversed(up):
        take = min(int(base[i]) - 1, -need) if need < 0 else 0
        base[i] -= take
        need += take
    out[used] = base
    return out


def table_encode(freq: np.ndarray) -> bytes:
    """Which symbols occur as a bitmap, and their frequencies as varints."""
    present = freq > 0
    bits = bitmap_encode(present)
    return varint_encode(np.array([len(freq)])) + bits + varint_encode(freq[present])


def table_decode(data: bytes) -> tuple[np.ndarray, int]:
    """(frequencies, bytes read)"""
    end = next(i for i, b in enumerate(data) if b < 128) + 1
    n = int(varint_decode(data[:end])[0])
    bits = bitmap_decode(data[end : end + -(-n // 8)], n).astype(bool)
    at = end + -(-n // 8)
    freq, k = np.zeros(n, "i8"), int(bits.sum())
    stop = at
    for _ in range(k):
        while data[stop] >= 128:
            stop += 1
        stop += 1
    freq[bits] = varint_decode(data[at:stop], k).astype("i8")
    return freq, stop


class Ans:
    """A range variant of asymmetric numeral systems with byte renormalisation; symbols are coded last first."""

    def __init__(self, freq: np.ndarray, scale_bits: int, low_bits: int = 23):
        self.scale_bits, self.low = scale_bits, 1 << low_bits
        self.freq = freq.tolist()
        self.cum = np.concatenate(([0], np.cumsum(freq))).tolist()
        if self.cum[-1] not in (0, 1 << scale_bits):
            raise ValueError("frequencies do not add up to the scale")
        self.slot = np.repeat(np.arange(len(freq)), freq).tolist()

    def encode(self, symbols: np.ndarray) -> bytes:
        x, out = self.low, bytearray()
        step = (self.low >> self.scale_bits) << 8
        for s in reversed(symbols.tolist()):
            f = self.freq[s]
            if not f:
                raise ValueError("a symbol without a frequency")
            while x >= step * f:
                out.append(x & 255)
                x >>= 8
            q, r = divmod(x, f)
            x = (q << self.scale_bits) + r + self.cum[s]
        return x.to_bytes(8, "big") + bytes(out[::-1])

    def decode(self, data: bytes, n: int) -> np.ndarray:
        x, at, out = int.from_bytes(data[:8], "big"), 8, [0] * n
        mask = (1 << self.scale_bits) - 1
        for i in range(n):
            r = x & mask
            s = self.slot[r]
            x = self.freq[s] * (x >> self.scale_bits) + r - self.cum[s]
            while x < self.low:
                x = x << 8 | data[at]
                at += 1
            out[i] = s
        if at != len(data) or x != self.low:
            raise ValueError("the stream does not end where it should")
        return np.array(out, "i8")


def _framed(head: bytes, body: bytes) -> bytes:
    return len(head).to_bytes(4, "little") + head + body


def _unframed(data: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(data[:4], "little")
    return data[4 : 4 + n], data[4 + n :]


def ans_encode(v: np.ndarray, scale_bits: int = 12, low_bits: int = 16, alphabet: int | None = None) -> bytes:
    """Symbols under the alphabet's size (default: up to the largest), with their frequency table in front."""
    v = v.astype("i8")
    if not len(v):
        return b""
    freq = normalised(np.bincount(v, minlength=alphabet or 0), 1 << scale_bits)
    return _framed(table_encode(freq), Ans(freq, scale_bits, low_bits).encode(v))


def ans_decode(data: bytes, n: int, scale_bits: int = 12, low_bits: int = 16) -> np.ndarray:
    if not n:
        return np.zeros(0, "i8")
    head, body = _unframed(data)
    return Ans(table_decode(head)[0], scale_bits, low_bits).decode(body, n)


def ranked_ans_encode(v: np.ndarray, scale_bits: int = 12) -> bytes:
    """Any values: their sorted distinct values as deltas, and each value's rank by ANS; at most 65,536 distinct ones."""
    if not len(v):
        return b""
    values, rank = np.unique(v.astype("i8"), return_inverse=True)
    if len(values) > 1 << 16:
        raise ValueError("too many distinct values")
    bits = max(scale_bits, len(values).bit_length())
    head = bytes((bits,)) + varint_encode(zigzag(np.diff(values, prepend=np.int64(0))))
    return _framed(head, ans_encode(rank, bits, bits + 8))


def ranked_ans_decode(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, "i8")
    head, body = _unframed(data)
    bits = head[0]
    return np.cumsum(unzigzag(varint_decode(head[1:])))[ans_decode(body, n, bits, bits + 8)]


def escape_ans_encode(v: np.ndarray, limit: int = 256, scale_bits: int = 16) -> bytes:
    """Non-negative values: those under limit by ANS, larger ones as an escape and a varint."""
    if not len(v):
        return b""
    if v.min() < 0:
        raise ValueError("negative value")
    large = v >= limit
    head = varint_encode(v[large] - limit)
    return _framed(head, ans_encode(np.where(large, limit, v), scale_bits, 23, limit + 1))


def escape_ans_decode(data: bytes, n: int, limit: int = 256, scale_bits: int = 16) -> np.ndarray:
    if not n:
        return np.zeros(0, "i8")
    head, body = _unframed(data)
    v = ans_decode(body, n, scale_bits, 23)
    v[v == limit] = varint_decode(head).astype("i8") + limit
    return v


def small_delta_encode(v: np.ndarray, limit: int = 128, scale_bits: int = 16) -> bytes:
    """Signed non-zero values in interleaved slots 1, -1, 2, -2 ...; beyond limit an escape."""
    if len(v) and (v == 0).any():
        raise ValueError("zero has no slot")
    return escape_ans_encode(_slots(v), 2 * limit, scale_bits)


def _slots(v: np.ndarray) -> np.ndarray:
    return np.where(v > 0, 2 * (v - 1), 2 * (-v - 1) + 1)


def small_delta_decode(data: bytes, n: int, limit: int = 128, scale_bits: int = 16) -> np.ndarray:
    s = escape_ans_decode(data, n, 2 * limit, scale_bits)
    return np.where(s % 2 == 0, s // 2 + 1, -(s // 2) - 1)


def coded_bytes(counts: np.ndarray, scale_bits: int) -> float:
    """What ANS will need for symbols with these counts, its frequency table included."""
    freq = normalised(counts, 1 << scale_bits)
    used = counts > 0
    return float(-(counts[used] * np.log2(freq[used] / (1 << scale_bits))).sum() / 8) + len(table_encode(freq))


SMALL_LIMITS, SCALE_BITS = (4, 8, 16, 32, 64, 128), (10, 12, 14, 16)


def best_small_limit(v: np.ndarray) -> tuple[int, int]:
    """The (limit, scale bits) with which small_delta_encode is smallest, of all pairs of SMALL_LIMITS and SCALE_BITS; reckoned from counts."""
    slots, best = _slots(v), None
    for limit in SMALL_LIMITS:
        large = slots >= 2 * limit
        escapes = len(varint_encode(slots[large] - 2 * limit))
        counts = np.bincount(np.where(large, 2 * limit, slots), minlength=2 * limit + 1)
        for bits in SCALE_BITS:
            size = escapes + coded_bytes(counts, bits)
            if best is None or size < best[0]:
                best = size, limit, bits
    return best[1:] if best else (SMALL_LIMITS[0], SCALE_BITS[0])


def timestamps_encode(v: np.ndarray) -> bytes:
    """A base, runs of unchanged times, and the changes between them, with the best limit and scale."""
    if not len(v):
        return b""
    d = np.diff(v.astype("i8"))
    at = np.flatnonzero(d)
    zeros = np.diff(at, prepend=-1) - 1
    tail = len(d) - (at[-1] + 1 if len(at) else 0)
    limit, bits = best_small_limit(d[at])
    head = varint_encode(np.concatenate((zigzag(v[:1].astype("i8")), [len(at), tail, limit, bits])))
    return _framed(head, _framed(escape_ans_encode(zeros, scale_bits=12), small_delta_encode(d[at], limit, bits)))


def timestamps_decode(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, "i8")
    head, rest = _unframed(data)
    a = varint_decode(head)
    base, k, tail, limit, bits = unzigzag(a[:1])[0], *map(int, a[1:5])
    runs, body = _unframed(rest)
    zeros, changes = escape_ans_decode(runs, k, scale_bits=12), small_delta_decode(body, k, limit, bits)
    d = np.zeros(int(zeros.sum()) + k + tail, "i8")
    d[np.cumsum(zeros + 1) - 1] = changes
    return base + np.concatenate(([0], np.cumsum(d)))


def increasing_ids_encode(v: np.ndarray) -> bytes:
    """Ids by their deltas: a base, and zigzag deltas by ANS with escapes."""
    if not len(v):
        return b""
    return _framed(varint_encode(zigzag(v[:1].astype("i8"))), escape_ans_encode(zigzag(np.diff(v.astype("i8"))).astype("i8"), scale_bits=12))


def increasing_ids_decode(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, "i8")
    head, body = _unframed(data)
    d = unzigzag(escape_ans_decode(body, n - 1, scale_bits=12).astype("u8"))
    return unzigzag(varint_decode(head))[0] + np.concatenate(([0], np.cumsum(d)))


TOP_K = (16, 64, 256, 1024, 2047)


def _head_symbols(v: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Each value's place among the best ones, len(best) for all others."""
    order = np.argsort(best)
    at = np.searchsorted(best[order], v)
    hit = (at < len(best)) & (best[order][np.minimum(at, len(best) - 1)] == v)
    sym = np.full(len(v), len(best), "i8")
    sym[hit] = order[at[hit]]
    return sym


def best_top_k(v: np.ndarray) -> tuple[int, int]:
    """The (K, scale bits) with which top_k_ans_encode is smallest, of all pairs of TOP_K and SCALE_BITS; reckoned from counts."""
    values, counts = np.unique(v, return_counts=True)
    order = np.lexsort((values, -counts))
    values, counts = values[order], counts[order]
    sizes = np.maximum(1, -(-np.array([int(x).bit_length() for x in values.tolist()]) // 7))  # as varints
    best = None
    for k in TOP_K:
        rest = int(counts[k:].sum())
        table = int(sizes[:k].sum() + (sizes[k:] * counts[k:]).sum())
        for bits in SCALE_BITS:
            if min(k, len(values)) < 1 << bits:
                size = table + coded_bytes(np.append(counts[:k], rest), bits)
                if best is None or size < best[0]:
                    best = size, k, bits
    return best[1:]


def top_k_ans_encode(v: np.ndarray, k: int | None = None, scale_bits: int | None = None) -> bytes:
    """The k most frequent values by ANS, the others as an escape and a varint; without k, the best one."""
    if not len(v):
        return b""
    if k is None:
        k, scale_bits = best_top_k(v)
    scale_bits = scale_bits or 12
    values, counts = np.unique(v, return_counts=True)
    best = values[np.lexsort((values, -counts))[:k]]
    sym = _head_symbols(v, best)
    head = bytes((scale_bits,)) + varint_encode(np.concatenate(([len(best)], best, v[sym == len(best)])))
    return _framed(head, ans_encode(sym, scale_bits, 23, len(best) + 1))


def top_k_ans_decode(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, "i8")
    head, body = _unframed(data)
    a = varint_decode(head[1:]).astype("i8")
    k = int(a[0])
    sym = ans_decode(body, n, head[0], 23)
    out = np.concatenate((a[1 : k + 1], [0]))[sym]
    out[sym == k] = a[k + 1 :]
    return out


VIPS = 2047


def hybrid_encode(v: np.ndarray, vips: int = VIPS) -> bytes:
    """The most frequent values by ANS, an escape for the rest, which lie apart in byte planes of the width they need."""
    from colonnade.codecs.integers import planes_encode

    if not len(v):
        return b""
    values, counts = np.unique(v, return_counts=True)
    often = np.flatnonzero(counts > 1)  # a value that occurs once is cheaper in the planes
    best = values[often[np.lexsort((values[often], -counts[often]))[:vips]]]
    sym = _head_symbols(v, best) if len(best) else np.zeros(len(v), "i8")
    rest = v[sym == len(best)]
    width = -(-int(rest.max()).bit_length() // 8) if len(rest) else 0
    head = bytes((width,)) + varint_encode(np.concatenate(([len(best)], zigzag(np.diff(best, prepend=0)))))
    return _framed(head, _framed(ans_encode(sym, 14, 23, len(best) + 1), planes_encode(rest, width)))


def hybrid_decode(data: bytes, n: int) -> np.ndarray:
    from colonnade.codecs.integers import planes_decode

    if not n:
        return np.zeros(0, "i8")
    head, body = _unframed(data)
    coded, planes = _unframed(body)
    a = varint_decode(head[1:])
    best = np.cumsum(unzigzag(a[1:]))
    sym = ans_decode(coded, n, 14, 23)
    out = np.concatenate((best, [0]))[sym]
    rest = sym == len(best)
    out[rest] = planes_decode(planes, int(rest.sum()), head[0]).astype("i8")
    return out


def chosen_contexts(v: np.ndarray) -> list[tuple[int, int]]:
    """The pairs (symbol before the last, last symbol) whose own model saves more bits than its table takes, against the model of the last symbol."""
    if len(v) < 3:
        return []
    p2, p1, cur = v[:-2], v[1:-1], v[2:]
    size = int(v.max()) + 1
    one = np.zeros((size, size))
    np.add.at(one, (p1, cur), 1)
    out = []
    for key in np.unique(p2 * size + p1).tolist():
        a, b = divmod(key, size)
        c = np.bincount(cur[(p2 == a) & (p1 == b)], minlength=size)
        used = c > 0
        gain = (c[used] * (np.log2(c[used] / c.sum()) - np.log2(one[b][used] / one[b].sum()))).sum()
        if gain > 8 * (16 + 2 * used.sum()):
            out.append((a, b))
    return out


def context_ans_encode(v: np.ndarray, scale_bits: int = 12) -> bytes:
    """Symbols by the ANS model of the two before them where that pays, else of the one before, else of the start.

    The stream of each context is coded apart; decoding takes them up again symbol by symbol.
    """
    if not len(v):
        return b""
    v = v.astype("i8")
    size = int(v.max()) + 2
    prev = np.concatenate(([-1], v[:-1])) + 1  # 0: nothing before
    key = prev.copy()
    for a, b in (chosen := chosen_contexts(v)):
        key[2:][(v[:-2] == a) & (v[1:-1] == b)] = size * (a + 1) + b + 1
    parts = []
    for c in np.unique(key).tolist():
        s = v[key == c]
        body = ans_encode(s, scale_bits, 23)
        parts.append(varint_encode(np.array([c, len(s), len(body)])) + body)
    return varint_encode(np.array([size, len(chosen)])) + b"".join(parts)


def context_ans_decode(data: bytes, n: int, scale_bits: int = 12) -> np.ndarray:
    if not n:
        return np.zeros(0, "i8")
    at = 0

    def number() -> int:
        nonlocal at
        end = at
        while data[end] >= 128:
            end += 1
        x = int(varint_decode(data[at : end + 1])[0])
        at = end + 1
        return x

    size, _ = number(), number()
    streams = {}
    while at < len(data):
        c, k, length = number(), number(), number()
        streams[c] = iter(ans_decode(data[at : at + length], k, scale_bits, 23).tolist())
        at += length
    out, before, last = [], 0, 0
    for _ in range(n):
        pair = size * before + last
        x = next(streams[pair] if before and pair in streams else streams[last])
        out.append(x)
        before, last = last, x + 1
    return np.array(out, "i8")


def numeric_encode(v: np.ndarray) -> bytes:
    """A compressor for numbers: the best of no, one and two rounds of deltas, then each value as its bit length (by ANS) and the bits behind its first."""
    if not len(v):
        return b""
    best = None
    d = v.astype("i8")
    for order in range(3):
        u = zigzag(d)
        width = _bit_lengths(u)
        counts = np.bincount(width, minlength=65)
        size = coded_bytes(counts, 12) + np.maximum(width - 1, 0).sum() / 8
        if best is None or size < best[0]:
            best = size, order, u, width
        d = np.diff(d, prepend=np.int64(0))
    _, order, u, width = best
    kept = np.maximum(width - 1, 0)
    place = np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)
    bits = (np.repeat(u, kept) >> place.astype("u8")) & np.uint64(1)
    return bytes((order,)) + _framed(ans_encode(width, 12, 23, 65), np.packbits(bits.astype("u1"), bitorder="little").tobytes())


def numeric_decode(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, "i8")
    coded, packed = _unframed(data[1:])
    width = ans_decode(coded, n, 12, 23)
    kept = np.maximum(width - 1, 0)
    total = int(kept.sum())
    bits = np.unpackbits(np.frombuffer(packed, "u1"), bitorder="little")[:total].astype("u8")
    if len(bits) < total:
        raise ValueError("bits are missing")
    starts = np.cumsum(kept) - kept
    terms = bits << (np.arange(total) - np.repeat(starts, kept)).astype("u8")
    u = np.where(width > 0, np.uint64(1) << kept.astype("u8"), np.uint64(0))
    some = np.flatnonzero(kept)
    if len(some):
        u[some] += np.add.reduceat(terms, starts[some])
    v = unzigzag(u)
    for _ in range(data[0]):
        v = np.cumsum(v)
    return v


def _bit_lengths(u: np.ndarray) -> np.ndarray:
    """Bits of unsigned values, 0 for 0."""
    out, left = np.zeros(len(u), "i8"), u.astype("u8")
    for step in (32, 16, 8, 4, 2, 1):
        high = left >> np.uint64(step)
        more = high > 0
        out += more * step
        left = np.where(more, high, left)
    return out + (left > 0)


class _RangeCoder:
    """Arithmetic coding with 32-bit bounds and pending bits, high bit first; models give (start, size, total) of a symbol."""

    TOP, HALF, QUARTER = (1 << 32) - 1, 1 << 31, 1 << 30

    def __init__(self):
        self.low, self.high, self.pending, self.bits = 0, self.TOP, 0, []

    def _put(self, bit: int) -> None:
        self.bits.append(bit)
        self.bits += [1 - bit] * self.pending
        self.pending = 0

    def encode(self, start: int, size: int, total: int) -> None:
        span = self.high - self.low + 1
        self.high = self.low + span * (start + size) // total - 1
        self.low += span * start // total
        while True:
            if self.high < self.HALF:
                self._put(0)
            elif self.low >= self.HALF:
                self._put(1)
                self.low -= self.HALF
                self.high -= self.HALF
            elif self.low >= self.QUARTER and self.high < 3 * self.QUARTER:
                self.pending += 1
                self.low -= self.QUARTER
                self.high -= self.QUARTER
            else:
                return
            self.low, self.high = 2 * self.low, 2 * self.high + 1

    def finish(self) -> bytes:
        self.pending += 1
        self._put(0 if self.low < self.QUARTER else 1)
        return np.packbits(np.array(self.bits, "u1")).tobytes()


class _RangeReader(_RangeCoder):
    def __init__(self, data: bytes):
        super().__init__()
        self.stream = np.unpackbits(np.frombuffer(data, "u1")).tolist()
        self.at, self.code = 0, 0
        for _ in range(32):
            self._shift()

    def _shift(self) -> None:
        self.code = self.code << 1 | (self.stream[self.at] if self.at < len(self.stream) else 0)
        self.at += 1

    def point(self, total: int) -> int:
        return ((self.code - self.low + 1) * total - 1) // (self.high - self.low + 1)

    def take(self, start: int, size: int, total: int) -> None:
        span = self.high - self.low + 1
        self.high = self.low + span * (start + size) // total - 1
        self.low += span * start // total
        while True:
            if self.high < self.HALF:
                drop = 0
            elif self.low >= self.HALF:
                drop = self.HALF
            elif self.low >= self.QUARTER and self.high < 3 * self.QUARTER:
                drop = self.QUARTER
            else:
                return
            self.low, self.high, self.code = 2 * (self.low - drop), 2 * (self.high - drop) + 1, self.code - drop
            self._shift()


def arithmetic_encode(v: np.ndarray) -> bytes:
    """Fixed frequencies, stored in front."""
    v = v.astype("i8")
    if not len(v):
        return b""
    counts = np.bincount(v)
    while counts.sum() > 1 << 28:
        counts = np.where(counts, np.maximum(counts >> 1, 1), 0)
    cum = np.concatenate(([0], np.cumsum(counts))).tolist()
    coder = _RangeCoder()
    for s in v.tolist():
        coder.encode(cum[s], cum[s + 1] - cum[s], cum[-1])
    return _framed(table_encode(counts), coder.finish())


def arithmetic_decode(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, "i8")
    head, body = _unframed(data)
    counts = table_decode(head)[0]
    cum = np.concatenate(([0], np.cumsum(counts)))
    reader, out, total, bounds = _RangeReader(body), [], int(cum[-1]), cum.tolist()
    for _ in range(n):
        s = int(np.searchsorted(cum, reader.point(total), side="right")) - 1
        reader.take(bounds[s], bounds[s + 1] - bounds[s], total)
        out.append(s)
    return np.array(out, "i8")


class _Adaptive:
    """256 symbols that start with one count each; counts are halved, rounded up, when they sum past 2^14. Sums lie in a binary indexed tree."""

    def __init__(self):
        self.counts = [1] * 256
        self._build()

    def _build(self) -> None:
        self.total = sum(self.counts)
        self.tree = [0, *self.counts]
        for i in range(1, 257):
            if (up := i + (i & -i)) <= 256:
                self.tree[up] += self.tree[i]

    def bounds(self, s: int) -> tuple[int, int, int]:
        before, i = 0, s
        while i:
            before += self.tree[i]
            i &= i - 1
        return before, self.counts[s], self.total

    def find(self, point: int) -> int:
        at = 0
        for step in (256, 128, 64, 32, 16, 8, 4, 2, 1):
            if at + step <= 256 and self.tree[at + step] <= point:
                at += step
                point -= self.tree[at]
        return at

    def learn(self, s: int) -> None:
        self.counts[s] += 1
        self.total += 1
        if self.total > 1 << 14:
            self.counts = [(c + 1) >> 1 for c in self.counts]
            self._build()
            return
        i = s + 1
        while i <= 256:
            self.tree[i] += 1
            i += i & -i


def adaptive_encode(v: np.ndarray) -> bytes:
    """Bytes with frequencies learned on the way; larger values raise."""
    if len(v) and (v.min() < 0 or v.max() > 255):
        raise ValueError("a value is no byte")
    coder, model = _RangeCoder(), _Adaptive()
    for s in v.tolist():
        coder.encode(*model.bounds(s))
        model.learn(s)
    return coder.finish()


def adaptive_decode(data: bytes, n: int) -> np.ndarray:
    reader, model, out = _RangeReader(data), _Adaptive(), []
    for _ in range(n):
        s = model.find(reader.point(model.total))
        reader.take(*model.bounds(s))
        model.learn(s)
        out.append(s)
    return np.array(out, "i8")


def second_counts_encode(v: np.ndarray) -> bytes:
    """Sorted times as a base and how many there are in each second from the first to the last, these by ANS."""
    from colonnade.codecs.integers import MAX_RANGE

    if not len(v):
        return b""
    v = v.astype("i8")
    if (np.diff(v) < 0).any():
        raise ValueError("values must not fall")
    if int(v[-1]) - int(v[0]) > MAX_RANGE:
        raise ValueError("the range is too wide")
    at = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    gaps, counts = np.diff(v[at]) - 1, np.diff(np.append(at, len(v))) - 1  # empty seconds before each, further events in each
    return _framed(varint_encode(np.concatenate((zigzag(v[:1]), [len(at)]))), _framed(numeric_encode(gaps), escape_ans_encode(counts, scale_bits=12)))


def second_counts_decode(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, "i8")
    head, body = _unframed(data)
    a = varint_decode(head)
    k = int(a[1])
    gaps, counts = _unframed(body)
    seconds = unzigzag(a[:1])[0] + np.concatenate(([0], np.cumsum(numeric_decode(gaps, k - 1) + 1)))
    out = np.repeat(seconds, escape_ans_decode(counts, k, scale_bits=12) + 1)
    if len(out) != n:
        raise ValueError("counts do not add up")
    return out


def permuted_times_encode(v: np.ndarray) -> bytes:
    """Nearly sorted times: the sorted ones as counts for each second, and the log of insertions that undoes the sort, both compressed."""
    from colonnade.codecs.integers import insertion_log

    ordered, log = insertion_log(v)
    moves = varint_encode(np.array([len(log) // 2])) + _framed(numeric_encode(log[::2]), numeric_encode(log[1::2]))
    return _framed(moves, second_counts_encode(ordered))


def permuted_times_decode(data: bytes, n: int) -> np.ndarray:
    from colonnade.codecs.integers import insertion_undo

    moves, body = _unframed(data)
    end = next(i for i, b in enumerate(moves) if b < 128) + 1
    k = int(varint_decode(moves[:end])[0])
    advance, bubbles = _unframed(moves[end:])
    log = np.stack((numeric_decode(advance, k), numeric_decode(bubbles, k)), 1).reshape(-1)
    return insertion_undo(second_counts_decode(body, n), log)
