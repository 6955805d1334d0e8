"""Byte layouts for columns of integers: each codec is encode(values) -> bytes and decode(bytes, n) -> values.

Values are int64 arrays. Layouts that only hold non-negative values raise ValueError on others; nothing is cut silently.
"""

from __future__ import annotations

import numpy as np


def zigzag(v: np.ndarray) -> np.ndarray:
    v = v.astype("i8")
    return ((v << 1) ^ (v >> 63)).view("u8")


def unzigzag(u: np.ndarray) -> np.ndarray:
    u = u.astype("u8")
    return (u >> np.uint64(1)).view("i8") ^ -(u & np.uint64(1)).view("i8")


def _unsigned(v: np.ndarray) -> np.ndarray:
    if v.dtype.kind != "u" and len(v) and v.min() < 0:
        raise ValueError("negative value")
    return v.astype("u8")


def varint_encode(v: np.ndarray) -> bytes:
    """Seven bits a byte, low bits first, the top bit set on all but the last."""
    u = _unsigned(v)
    if not len(u):
        return b""
    parts = [(u >> np.uint64(7 * k)) & np.uint64(127) for k in range(10)]
    size = np.ones(len(u), "i8")
    for k in range(1, 10):
        size += (u >> np.uint64(7 * k)) > 0
    table = np.stack(parts, 1).astype("u1")
    at = np.arange(10)
    table |= ((at[None] < size[:, None] - 1) * 128).astype("u1")
    return table[at[None] < size[:, None]].tobytes()


def varint_decode(data: bytes, n: int | None = None) -> np.ndarray:
    a = np.frombuffer(data, "u1")
    ends = np.flatnonzero(a < 128)
    if n is not None and len(ends) != n:
        raise ValueError(f"{len(ends)} values, {n} expected")
    if len(a) and a[-1] >= 128:
        raise ValueError("the last value is cut off")
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    shift = np.arange(len(a)) - np.repeat(starts, ends - starts + 1)
    terms = (a & 127).astype("u8") << (7 * shift).astype("u8")
    return np.add.reduceat(terms, starts) if len(ends) else np.zeros(0, "u8")


def reverse_varints_encode(v: np.ndarray) -> bytes:
    """Varints laid out so that the last one is read first, each from its end: for payloads consumed backwards."""
    return varint_encode(v)[::-1]


def reverse_varints_decode(data: bytes, n: int | None = None) -> np.ndarray:
    return varint_decode(data[::-1], n)


def prefix_varint_encode(v: np.ndarray) -> bytes:
    """Big-endian; as many leading ones in the first byte as bytes follow it (up to eight)."""
    out = bytearray()
    for x in _unsigned(v).tolist():
        more = min(8, max(0, (x.bit_length() - 1) // 7))
        if more < 8:
            out += (((0xFF00 >> more) & 0xFF) << (8 * more) | x).to_bytes(more + 1, "big")
        else:
            out += b"\xff" + x.to_bytes(8, "big")
    return bytes(out)


def prefix_varint_decode(data: bytes, n: int) -> np.ndarray:
    out = prefix_varint_decode_all(data)
    if len(out) != n:
        raise ValueError(f"{len(out)} values, {n} expected")
    return out


def prefix_varint_decode_all(data: bytes) -> np.ndarray:
    out, at = [], 0
    while at < len(data):
        first = data[at]
        more = 8 - (first ^ 0xFF).bit_length()
        if at + more >= len(data):
            raise ValueError("the last value is cut off")
        x = int.from_bytes(data[at : at + more + 1], "big")
        keep = 7 * (more + 1) if more < 8 else 64
        out.append(x & ((1 << keep) - 1))
        at += more + 1
    return np.array(out, "u8")


def bit_width(v: np.ndarray) -> int:
    return max(1, int(v.max()).bit_length()) if len(v) else 1


def bitpack_encode(v: np.ndarray) -> bytes:
    """A width byte, then the values' bits, low first."""
    u = _unsigned(v)
    w = bit_width(u)
    bits = (u[:, None] >> np.arange(w, dtype="u8")) & np.uint64(1)
    return bytes((w,)) + np.packbits(bits.astype("u1").reshape(-1), bitorder="little").tobytes()


def bitpack_decode(data: bytes, n: int) -> np.ndarray:
    w = data[0]
    bits = np.unpackbits(np.frombuffer(data, "u1", offset=1), bitorder="little")
    if len(bits) < n * w:
        raise ValueError("bits are missing")
    return (bits[: n * w].reshape(n, w).astype("u8") << np.arange(w, dtype="u8")).sum(1, dtype="u8")


def blocks_encode(v: np.ndarray, block: int = 64) -> bytes:
    """Blocks of 64 values, each packed at its own width."""
    return b"".join(bitpack_encode(v[i : i + block]) for i in range(0, len(v), block))


def blocks_decode(data: bytes, n: int, block: int = 64) -> np.ndarray:
    out, at = [], 0
    for i in range(0, n, block):
        k = min(block, n - i)
        size = 1 + -(-k * data[at] // 8)
        out.append(bitpack_decode(data[at : at + size], k))
        at += size
    return np.concatenate(out) if out else np.zeros(0, "u8")


def u32_list_encode(v: np.ndarray) -> bytes:
    u = _unsigned(v)
    if len(u) and u.max() >> np.uint64(32):
        raise ValueError("a value needs more than 32 bits")
    return np.concatenate(([len(u)], u)).astype("<u4").tobytes()


def u32_list_decode(data: bytes, n: int | None = None) -> np.ndarray:
    a = np.frombuffer(data, "<u4")
    if len(a) != a[0] + 1:
        raise ValueError("the count does not match")
    return a[1:].astype("u8")


def nibbles_encode(v: np.ndarray) -> bytes:
    """Two values under 16 a byte, the first one low."""
    u = _unsigned(v)
    if len(u) and u.max() > 15:
        raise ValueError("a value needs more than four bits")
    u = np.concatenate((u, np.zeros(len(u) % 2, "u8"))).astype("u1")
    return (u[::2] | u[1::2] << 4).astype("u1").tobytes()


def nibbles_decode(data: bytes, n: int) -> np.ndarray:
    a = np.frombuffer(data, "u1")
    return np.stack((a & 15, a >> 4), 1).reshape(-1)[:n].astype("u8")


def planes_encode(v: np.ndarray, width: int) -> bytes:
    """All low bytes, then all second bytes and so on."""
    u = _unsigned(v)
    if len(u) and width < 8 and int(u.max()) >> (8 * width):
        raise ValueError(f"a value needs more than {width} bytes")
    return u.astype("<u8").view("u1").reshape(-1, 8)[:, :width].T.tobytes()


def planes_decode(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), "u1")
    out[:, :width] = np.frombuffer(data, "u1").reshape(width, n).T
    return out.reshape(-1).view("<u8").astype("u8")


def u24_encode(v: np.ndarray) -> bytes:
    u = _unsigned(v)
    if len(u) and int(u.max()) >> 24:
        raise ValueError("a value needs more than three bytes")
    return u.astype("<u8").view("u1").reshape(-1, 8)[:, :3].tobytes()


def u24_decode(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), "u1")
    out[:, :3] = np.frombuffer(data, "u1").reshape(n, 3)
    return out.reshape(-1).view("<u8").astype("u8")


def bitmap_encode(flags: np.ndarray) -> bytes:
    return np.packbits(flags.astype(bool), bitorder="little").tobytes()


def bitmap_decode(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, "u1"), bitorder="little")[:n].astype("u8")


def categories_encode(v: np.ndarray, inline=(0, 1, 2)) -> bytes:
    """Two bits a value: one of three common values, or 3 and a zigzag varint among the exceptions."""
    code = np.full(len(v), 3, "u8")
    for k, x in enumerate(inline):
        code[v == x] = k
    packed = np.zeros(-(-len(v) // 4) * 4, "u1")
    packed[: len(v)] = code
    packed = packed.reshape(-1, 4)
    head = (packed[:, 0] | packed[:, 1] << 2 | packed[:, 2] << 4 | packed[:, 3] << 6).astype("u1").tobytes()
    return head + varint_encode(zigzag(v[code == 3]))


def categories_decode(data: bytes, n: int, inline=(0, 1, 2)) -> np.ndarray:
    size = -(-n // 4)
    a = np.frombuffer(data, "u1", count=size)
    code = np.stack([a >> s & 3 for s in (0, 2, 4, 6)], 1).reshape(-1)[:n]
    out = np.array([*inline, 0], "i8")[code]
    out[code == 3] = unzigzag(varint_decode(data[size:], int((code == 3).sum())))
    return out


def interpolative_encode(v: np.ndarray) -> bytes:
    """Strictly increasing values: the middle one within the bounds its neighbours leave, then both halves."""
    u = _unsigned(v).tolist()
    if any(a >= b for a, b in zip(u, u[1:])):
        raise ValueError("values must increase")
    if not u:
        return (0).to_bytes(12, "little")
    acc, held = 0, 0
    stack = [(0, len(u) - 1, 0, u[-1])]
    while stack:
        i, j, lo, hi = stack.pop()
        if i > j:
            continue
        m = (i + j) // 2
        low, high = lo + (m - i), hi - (j - m)
        bits = (high - low).bit_length()
        acc |= (u[m] - low) << held
        held += bits
        stack += [(m + 1, j, u[m] + 1, hi), (i, m - 1, lo, u[m] - 1)]
    return len(u).to_bytes(4, "little") + u[-1].to_bytes(8, "little") + acc.to_bytes(-(-held // 8), "little")


def interpolative_decode(data: bytes, n: int | None = None) -> np.ndarray:
    count, top = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:12], "little")
    bits = np.unpackbits(np.frombuffer(data, "u1", offset=12), bitorder="little")
    out, at = [0] * count, 0
    stack = [(0, count - 1, 0, top)]
    while stack:
        i, j, lo, hi = stack.pop()
        if i > j:
            continue
        m = (i + j) // 2
        low, high = lo + (m - i), hi - (j - m)
        w = (high - low).bit_length()
        x = 0
        for k in range(w):
            x |= int(bits[at + k]) << k
        at += w
        out[m] = low + x
        stack += [(m + 1, j, out[m] + 1, hi), (i, m - 1, lo, out[m] - 1)]
    return np.array(out, "u8")


def delta(v: np.ndarray) -> np.ndarray:
    return np.diff(v.astype("i8"), prepend=np.int64(0))


def undelta(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d.astype("i8"))


#: The widest range of values that is counted one by one.
MAX_RANGE = 50_000_000


def per_unit_encode(v: np.ndarray) -> bytes:
    """Sorted values as a base, a count and how many there are of each value from least to largest."""
    v = v.astype("i8")
    if len(v) and (np.diff(v) < 0).any():
        raise ValueError("values must not fall")
    if not len(v):
        return b""
    if int(v[-1]) - int(v[0]) > MAX_RANGE:
        raise ValueError("the range is too wide")
    return varint_encode(np.concatenate((zigzag(v[:1]), np.bincount(v - v[0]).astype("u8"))))


def per_unit_decode(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, "i8")
    a = varint_decode(data)
    out = np.repeat(np.arange(len(a) - 1), a[1:].astype("i8")) + unzigzag(a[:1])[0]
    if len(out) != n:
        raise ValueError("counts do not add up")
    return out


def insertion_log(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted values, and for each value that is out of order how many larger ones come before it, as (advance, bubbles) pairs."""
    order, bubbles = [], np.zeros(len(v), "i8")
    import bisect

    for i, x in enumerate(v.tolist()):
        at = bisect.bisect_right(order, x)
        bubbles[i] = len(order) - at
        order.insert(at, x)
    moved = np.flatnonzero(bubbles)
    advance = np.diff(moved, prepend=-1) - 1
    return np.array(order, "i8"), np.stack((advance, bubbles[moved]), 1).reshape(-1)


def insertion_undo(ordered: np.ndarray, log: np.ndarray) -> np.ndarray:
    bubbles = np.zeros(len(ordered), "i8")
    pairs = log.reshape(-1, 2)
    if len(pairs):
        bubbles[np.cumsum(pairs[:, 0] + 1) - 1] = pairs[:, 1]
    left, out = ordered.tolist(), [0] * len(ordered)
    for i in range(len(left) - 1, -1, -1):
        out[i] = left.pop(i - int(bubbles[i]))
    return np.array(out, "i8")
