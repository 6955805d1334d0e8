"""Lists of strings as bytes: lengths and text, one joined stream, front coding, and transforms of repository names."""

from __future__ import annotations

from collections import Counter

import numpy as np

from colonnade.codecs import entropy as E
from colonnade.codecs.integers import bitpack_decode, bitpack_encode, varint_decode, varint_encode


def _ints(values) -> np.ndarray:
    return np.array(list(values), "i8")


def plain_encode(strings: list[str]) -> bytes:
    """Byte lengths, then all the text."""
    raw = [s.encode() for s in strings]
    return E._framed(varint_encode(_ints(map(len, raw))), b"".join(raw))


def plain_decode(data: bytes, n: int) -> list[str]:
    head, text = E._unframed(data)
    ends = np.cumsum(varint_decode(head, n).astype("i8")).tolist()
    return [text[a:b].decode() for a, b in zip([0, *ends][:n], ends, strict=True)]


def joined_encode(strings: list[str], separator: str = "\n") -> bytes:
    """One text with separators; lengths and text, if a string holds the separator."""
    if any(separator in s for s in strings):
        return b"\1" + plain_encode(strings)
    return b"\0" + separator.join(strings).encode()


def joined_decode(data: bytes, n: int, separator: str = "\n") -> list[str]:
    if data[:1] == b"\1":
        return plain_decode(data[1:], n)
    out = data[1:].decode().split(separator) if n else []
    if len(out) != n:
        raise ValueError("strings are missing")
    return out


def front_encode(strings: list[str]) -> bytes:
    """For each string the bytes shared with the one before, and what follows them."""
    shared, rest, last = [], [], b""
    for s in strings:
        raw = s.encode()
        k, most = 0, min(len(raw), len(last))
        while k < most and raw[k] == last[k]:
            k += 1
        shared.append(k)
        rest.append(raw[k:])
        last = raw
    return E._framed(varint_encode(_ints(shared)), E._framed(varint_encode(_ints(map(len, rest))), b"".join(rest)))


def front_decode(data: bytes, n: int) -> list[str]:
    a, more = E._unframed(data)
    b, text = E._unframed(more)
    out, last, at = [], b"", 0
    for k, m in zip(varint_decode(a, n).tolist(), varint_decode(b, n).tolist(), strict=True):
        last = last[:k] + text[at : at + m]
        at += m
        out.append(last.decode())
    return out


def ranked(strings: list[str]) -> tuple[list[str], np.ndarray]:
    """The distinct strings in order, and each one's rank."""
    distinct = sorted(set(strings))
    place = {s: i for i, s in enumerate(distinct)}
    return distinct, _ints(place[s] for s in strings)


def hybrid_encode(strings: list[str], vips: int = E.VIPS) -> bytes:
    """The most frequent strings by ANS over their ranks, an escape for the rest, which are joined in one stream."""
    count = Counter(strings)
    best = sorted((s for s, c in count.items() if c > 1), key=lambda s: (-count[s], s))[:vips]
    place = {s: i for i, s in enumerate(best)}
    sym = _ints(place.get(s, len(best)) for s in strings)
    rest = [s for s in strings if s not in place]
    head = varint_encode(_ints((len(best), len(rest))))
    return E._framed(head, E._framed(joined_encode(best), E._framed(E.ans_encode(sym, 14, 23, len(best) + 1), joined_encode(rest))))


def hybrid_decode(data: bytes, n: int) -> list[str]:
    head, a = E._unframed(data)
    best, b = E._unframed(a)
    coded, rest = E._unframed(b)
    k, m = varint_decode(head, 2).tolist()
    often, others = joined_decode(best, k), iter(joined_decode(rest, m))
    return [often[s] if s < k else next(others) for s in E.ans_decode(coded, n, 14, 23).tolist()]


# Transforms of names -------------------------------------------------------------------------------------------------


def split_names(names: list[str]) -> tuple[list[str], list[str], np.ndarray]:
    """Owners, what follows the first slash, and whether there is a slash (owner alone otherwise)."""
    parts = [n.partition("/") for n in names]
    return [p[0] for p in parts], [p[2] for p in parts], _ints(bool(p[1]) for p in parts)


def join_names(owners: list[str], rests: list[str], slash) -> list[str]:
    return [f"{o}/{r}" if s else o for o, r, s in zip(owners, rests, slash, strict=True)]


SEPARATORS = "-_."


def rest_code(owner: str, rest: str) -> int:
    """How a name follows its owner: 1 the same, 2 the owner and one of -_. and more, 0 anything else."""
    if rest == owner:
        return 1
    return 2 if owner and rest.startswith(owner) and rest[len(owner) : len(owner) + 1] in SEPARATORS and len(rest) > len(owner) else 0


def rest_kept(owner: str, rest: str, code: int) -> str:
    return rest if code == 0 else "" if code == 1 else rest[len(owner) :]


def rest_from(owner: str, kept: str, code: int) -> str:
    return kept if code == 0 else owner if code == 1 else owner + kept


PAGES = ".github.io"


def marked(owner: str, rest: str) -> str:
    """The owner's occurrences as @; a name that is nothing else is empty, owner.github.io is @ alone. A leading ~ keeps a name as it is."""
    if not owner or "@" in rest or "@" in owner or rest[:1] in ("", "~"):
        return "~" + rest
    out = rest.replace(owner, "@")
    return "" if out == "@" else "@" if out == "@" + PAGES else out


def unmarked(owner: str, text: str) -> str:
    if text[:1] == "~":
        return text[1:]
    full = {"": "@", "@": "@" + PAGES}.get(text, text)
    return full.replace("@", owner)


def folded(text: str) -> str:
    """ASCII upper case as marks before lower case: $ before a run of two or more that no lower-case letter follows, ^ before every other.

    A text with marks of its own is kept behind a leading backslash.
    """
    if any(c in "^$\\" for c in text):
        return "\\" + text
    out, i, n = [], 0, len(text)
    while i < n:
        if not "A" <= text[i] <= "Z":
            out.append(text[i])
            i += 1
            continue
        j = i
        while j < n and "A" <= text[j] <= "Z":
            j += 1
        run = text[i:j].lower()
        out.append("$" + run if j - i > 1 and not (j < n and "a" <= text[j] <= "z") else "".join("^" + c for c in run))
        i = j
    return "".join(out)


def unfolded(text: str) -> str:
    if text[:1] == "\\":
        return text[1:]
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        i += 1
        if c == "^":
            out.append(text[i].upper())
            i += 1
        elif c == "$":
            j = i
            while j < n and "a" <= text[j] <= "z":
                j += 1
            out.append(text[i:j].upper())
            i = j
        else:
            out.append(c)
    return "".join(out)


def packed_ranks(ranks: np.ndarray) -> bytes:
    return bitpack_encode(ranks) if len(ranks) else b""


def unpacked_ranks(data: bytes, n: int) -> np.ndarray:
    return bitpack_decode(data, n).astype("i8") if n else np.zeros(0, "i8")
