"""Forms of the repository dictionary: the entries (id, name) of a chunk as named sections of bytes, and back.

A form is (encode(ids, names) -> {section: bytes}, decode(sections, n) -> (ids, names)). All keep the order of the entries; forms that say
"sorted" need them in the order of id and name, and derive an entry's place from that.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from colonnade.codecs import entropy as E
from colonnade.codecs import integers as I
from colonnade.codecs import strings as T

Form = tuple[Callable[[np.ndarray, list[str]], dict[str, bytes]], Callable[[dict[str, bytes], int], tuple[np.ndarray, list[str]]]]


def _deltas(ids: np.ndarray) -> bytes:
    return I.varint_encode(I.zigzag(I.delta(ids)))


def _undeltas(data: bytes, n: int) -> np.ndarray:
    return I.undelta(I.unzigzag(I.varint_decode(data, n)))


def _runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of a sorted column and how often each occurs."""
    starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, "i8")
    return ids[starts], np.diff(np.append(starts, len(ids)))


def _counted(n: int, body: bytes) -> bytes:
    return n.to_bytes(4, "little") + body


def _count(data: bytes) -> tuple[int, bytes]:
    return int.from_bytes(data[:4], "little"), data[4:]


# Each pair below is one form.


def newline_encode(ids, names):
    """Ids as deltas, names as one stream of lines."""
    return {"ids": _deltas(ids), "names": T.joined_encode(names)}


def newline_decode(s, n):
    return _undeltas(s["ids"], n), T.joined_decode(s["names"], n)


def front_names_encode(ids, names):
    """A sorted, front-coded dictionary of names; entries are (id, rank of the name)."""
    distinct, ranks = T.ranked(names)
    return {"ids": _deltas(ids), "names": _counted(len(distinct), T.front_encode(distinct)), "ranks": T.packed_ranks(ranks)}


def front_names_decode(s, n):
    k, body = _count(s["names"])
    distinct = T.front_decode(body, k)
    return _undeltas(s["ids"], n), [distinct[r] for r in T.unpacked_ranks(s["ranks"], n)]


def front_parts_encode(ids, names):
    """Front-coded dictionaries of owners and of what follows them; entries are (owner, rest, id). Rest 0 is a name without a slash."""
    owners, rests, slash = T.split_names(names)
    users, u = T.ranked(owners)
    parts, r = T.ranked([x for x, has in zip(rests, slash, strict=True) if has])
    rest = np.zeros(len(names), "i8")
    rest[slash.astype(bool)] = r + 1
    return {"ids": _deltas(ids), "owners": _counted(len(users), T.front_encode(users)), "rests": _counted(len(parts), T.front_encode(parts)), "tuples": E._framed(T.packed_ranks(u), T.packed_ranks(rest))}


def front_parts_decode(s, n):
    (k, a), (m, b) = _count(s["owners"]), _count(s["rests"])
    users, parts = T.front_decode(a, k), T.front_decode(b, m)
    u, r = E._unframed(s["tuples"])
    u, r = T.unpacked_ranks(u, n).tolist(), T.unpacked_ranks(r, n).tolist()
    return _undeltas(s["ids"], n), [f"{users[i]}/{parts[j - 1]}" if j else users[i] for i, j in zip(u, r, strict=True)]


def front_entries_encode(ids, names):
    """Every name front-coded against the entry before, in the order of the entries."""
    return {"ids": _deltas(ids), "names": T.front_encode(names)}


def front_entries_decode(s, n):
    return _undeltas(s["ids"], n), T.front_decode(s["names"], n)


def sentinel_encode(ids, names):
    """Sorted: names joined by NUL, ids as deltas, and for each id its rank plus one, or 0, a count and the ranks."""
    distinct, ranks = T.ranked(names)
    own, counts = _runs(ids)
    out, at = [], 0
    for c in counts.tolist():
        mine = ranks[at : at + c].tolist()
        out += [mine[0] + 1] if c == 1 else [0, c, *mine]
        at += c
    return {"ids": _counted(len(own), _deltas(own)), "names": _counted(len(distinct), T.joined_encode(distinct, "\0")), "lists": I.varint_encode(np.array(out, "i8"))}


def sentinel_decode(s, n):
    (k, a), (m, b) = _count(s["ids"]), _count(s["names"])
    own, distinct = _undeltas(a, k).tolist(), T.joined_decode(b, m, "\0")
    lists, at = I.varint_decode(s["lists"]).tolist(), 0
    ids, names = [], []
    for i in own:
        mine = [lists[at] - 1]
        at += 1
        if mine[0] < 0:
            c = lists[at]
            mine = lists[at + 1 : at + 1 + c]
            at += 1 + c
        ids += [i] * len(mine)
        names += [distinct[r] for r in mine]
    return np.array(ids, "i8"), names


def variant_lists_encode(ids, names):
    """Sorted: names with their lengths, ids, counts of variants and ranks bit-packed."""
    distinct, ranks = T.ranked(names)
    own, counts = _runs(ids)
    return {"ids": _counted(len(own), I.bitpack_encode(I.zigzag(I.delta(own)))), "names": _counted(len(distinct), T.plain_encode(distinct)), "counts": T.packed_ranks(counts), "ranks": T.packed_ranks(ranks)}


def variant_lists_decode(s, n):
    (k, a), (m, b) = _count(s["ids"]), _count(s["names"])
    own = I.undelta(I.unzigzag(I.bitpack_decode(a, k)))
    distinct = T.plain_decode(b, m)
    return np.repeat(own, T.unpacked_ranks(s["counts"], k)), [distinct[r] for r in T.unpacked_ranks(s["ranks"], n)]


def side_table_encode(ids, names):
    """Sorted: ids as deltas in byte planes, one name for each; further names of an id stand in a side table (place of the id, name)."""
    own, counts = _runs(ids)
    first = np.cumsum(counts) - counts
    steps = I.zigzag(I.delta(own))
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    more = np.setdiff1d(np.arange(len(ids)), first)
    places = np.repeat(np.arange(len(own)), counts - 1)
    return {
        "ids": _counted(len(own), bytes((width,)) + I.planes_encode(steps, width)),
        "names": T.joined_encode([names[k] for k in first.tolist()]),
        "more": _counted(len(more), E._framed(I.varint_encode(np.diff(places, prepend=0)), T.joined_encode([names[k] for k in more.tolist()]))),
    }


def side_table_decode(s, n):
    k, a = _count(s["ids"])
    own = I.undelta(I.unzigzag(I.planes_decode(a[1:], k, a[0])))
    m, b = _count(s["more"])
    places, more = E._unframed(b)
    places = np.cumsum(I.varint_decode(places, m).astype("i8"))
    counts = 1 + np.bincount(places, minlength=k) if k else np.zeros(0, "i8")
    first = np.cumsum(counts) - counts
    names: list[str] = [""] * n
    for at, x in zip(first.tolist(), T.joined_decode(s["names"], k), strict=True):
        names[at] = x
    rest = np.setdiff1d(np.arange(n), first)
    for at, x in zip(rest.tolist(), T.joined_decode(more, m), strict=True):
        names[at] = x
    return np.repeat(own, counts), names


def _suffixes(owners, rests, slash) -> tuple[np.ndarray, list[str]]:
    """Two-bit codes of how a name follows its owner (3: it has no slash), and what is kept of it."""
    codes = [T.rest_code(o, r) if has else 3 for o, r, has in zip(owners, rests, slash, strict=True)]
    return np.array(codes, "i8"), [T.rest_kept(o, r, c) if c < 3 else "" for o, r, c in zip(owners, rests, codes, strict=True)]


def _names(owners, codes, kept) -> list[str]:
    return [o if c == 3 else f"{o}/{T.rest_from(o, k, c)}" for o, c, k in zip(owners, codes, kept, strict=True)]


def owner_codes_encode(ids, names):
    """A dictionary of owners by frequency, each entry's owner, its suffix code and what is kept of the name; numbers by the numeric compressor."""
    owners, rests, slash = T.split_names(names)
    count: dict[str, int] = {}
    for o in owners:
        count[o] = count.get(o, 0) + 1
    best = sorted(count, key=lambda o: (-count[o], o))
    place = {o: i for i, o in enumerate(best)}
    codes, kept = _suffixes(owners, rests, slash)
    return {"ids": E.numeric_encode(ids), "owners": _counted(len(best), T.joined_encode(best)), "owner": E.numeric_encode(np.array([place[o] for o in owners], "i8")), "codes": I.categories_encode(codes), "kept": T.joined_encode(kept)}


def owner_codes_decode(s, n):
    k, a = _count(s["owners"])
    best = T.joined_decode(a, k)
    owners = [best[i] for i in E.numeric_decode(s["owner"], n).tolist()]
    return E.numeric_decode(s["ids"], n), _names(owners, I.categories_decode(s["codes"], n).tolist(), T.joined_decode(s["kept"], n))


def gaps_encode(ids, names):
    """Sorted: distinct ids by interpolative coding, the places of repeated ids as gaps, owners and rests with the frequent ones coded apart."""
    own, counts = _runs(ids)
    repeats = np.flatnonzero(np.concatenate(([False], ids[1:] == ids[:-1]))) if len(ids) else np.zeros(0, "i8")
    owners, rests, slash = T.split_names(names)
    low = int(own[0]) if len(own) else 0
    return {
        "ids": _counted(len(own), E._framed(I.varint_encode(I.zigzag(np.array([low]))), I.interpolative_encode(own - low))),
        "repeats": _counted(len(repeats), I.varint_encode(np.diff(repeats, prepend=0))),
        "owners": T.hybrid_encode(owners),
        "rests": E._framed(I.bitmap_encode(slash), T.hybrid_encode(rests)),
    }


def gaps_decode(s, n):
    k, a = _count(s["ids"])
    low, body = E._unframed(a)
    own = I.interpolative_decode(body, k).astype("i8") + I.unzigzag(I.varint_decode(low))[0]
    m, gaps = _count(s["repeats"])
    again = np.zeros(n, bool)
    again[np.cumsum(I.varint_decode(gaps, m).astype("i8"))] = True
    ids = own[np.cumsum(~again) - 1] if n else own
    slash, rests = E._unframed(s["rests"])
    return ids, T.join_names(T.hybrid_decode(s["owners"], n), T.hybrid_decode(rests, n), I.bitmap_decode(slash, n).tolist())


def marks_encode(ids, names):
    """Owners by reference to the entry that first had them (0: a new one, case-folded), the owner within names marked and names case-folded.

    Ids in byte planes, but for those that their owner's entry before has too: a bitmap says which.
    """
    owners, rests, slash = T.split_names(names)
    seen: dict[str, int] = {}
    refs, fresh = [], []
    for o in owners:
        k = seen.setdefault(o, len(seen))
        refs.append(0 if k == len(fresh) else k + 1)
        if k == len(fresh):
            fresh.append(o)
    texts = [T.folded(T.marked(o, r)) if has else "/" for o, r, has in zip(owners, rests, slash, strict=True)]
    had: dict[str, int] = {}
    again = np.zeros(len(ids), bool)
    for k, (o, i) in enumerate(zip(owners, ids.tolist(), strict=True)):
        again[k] = had.get(o) == i
        had[o] = i
    steps = I.zigzag(ids[~again])
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return {"ids": E._framed(I.bitmap_encode(again), bytes((width,)) + I.planes_encode(steps, width)), "refs": I.varint_encode(np.array(refs, "i8")), "owners": _counted(len(fresh), T.joined_encode([T.folded(o) for o in fresh])), "names": T.joined_encode(texts)}


def marks_decode(s, n):
    k, a = _count(s["owners"])
    fresh = [T.unfolded(o) for o in T.joined_decode(a, k)]
    bits, planes = E._unframed(s["ids"])
    again = I.bitmap_decode(bits, n).astype(bool)
    fewer = iter(I.unzigzag(I.planes_decode(planes[1:], int((~again).sum()), planes[0])).tolist())
    ids, names, new, had = [], [], 0, {}
    for r, t, same in zip(I.varint_decode(s["refs"], n).tolist(), T.joined_decode(s["names"], n), again.tolist(), strict=True):
        if r:
            o = fresh[r - 1]
        else:
            o = fresh[new]
            new += 1
        ids.append(had[o] if same else next(fewer))
        had[o] = ids[-1]
        names.append(o if t == "/" else f"{o}/{T.unmarked(o, T.unfolded(t))}")
    return np.array(ids, "i8"), names


def streams_encode(ids, names):
    """Owners as one stream of lines, suffix codes and what is kept of the names as another; ids by the numeric compressor."""
    owners, rests, slash = T.split_names(names)
    codes, kept = _suffixes(owners, rests, slash)
    return {"ids": E.numeric_encode(ids), "owners": T.joined_encode(owners), "codes": I.categories_encode(codes), "kept": T.joined_encode(kept)}


def streams_decode(s, n):
    return E.numeric_decode(s["ids"], n), _names(T.joined_decode(s["owners"], n), I.categories_decode(s["codes"], n).tolist(), T.joined_decode(s["kept"], n))


def transformed_encode(ids, names):
    """Each name as owner, a suffix code and what is kept, in one stream of lines; ids by the numeric compressor."""
    owners, rests, slash = T.split_names(names)
    codes, kept = _suffixes(owners, rests, slash)
    return {"ids": E.numeric_encode(ids), "names": T.joined_encode([f"{o}{'/@~'[c]}{k}" if c < 3 else o for o, c, k in zip(owners, codes.tolist(), kept, strict=True)]) if not any(x in o for o in owners for x in "@~") else b"\2" + T.joined_encode(names)}


def transformed_decode(s, n):
    ids = E.numeric_decode(s["ids"], n)
    if s["names"][:1] == b"\2":
        return ids, T.joined_decode(s["names"][1:], n)
    names = []
    for line in T.joined_decode(s["names"], n):
        at = min((line.index(x) for x in "/@~" if x in line), default=-1)
        o, mark, k = (line, "", "") if at < 0 else (line[:at], line[at], line[at + 1 :])
        names.append(o if not mark else f"{o}/{T.rest_from(o, k, '/@~'.index(mark))}")
    return ids, names


NEWLINE: Form = (newline_encode, newline_decode)
FRONT_NAMES: Form = (front_names_encode, front_names_decode)
FRONT_PARTS: Form = (front_parts_encode, front_parts_decode)
FRONT_ENTRIES: Form = (front_entries_encode, front_entries_decode)
SENTINEL: Form = (sentinel_encode, sentinel_decode)
VARIANT_LISTS: Form = (variant_lists_encode, variant_lists_decode)
SIDE_TABLE: Form = (side_table_encode, side_table_decode)
OWNER_CODES: Form = (owner_codes_encode, owner_codes_decode)
GAPS: Form = (gaps_encode, gaps_decode)
MARKS: Form = (marks_encode, marks_decode)
STREAMS: Form = (streams_encode, streams_decode)
TRANSFORMED: Form = (transformed_encode, transformed_decode)
#: The forms that need their entries sorted by id and name.
SORTED = (SENTINEL, VARIANT_LISTS, SIDE_TABLE, GAPS)
