"""Event codecs: compositions of an order, dictionaries and column layouts that encode the event view into sections and back.

``encode`` gives a table of sections (part, grp, section, n, payload): the facts in row groups of bounded size, and the dictionaries in
chunks of entries. Every payload is a frame (``codecs.frames``) around compressed bytes, checked before it is decoded. ``decode`` is the exact
inverse, rows in any order; given the name of a column that the sections are partitioned by, it decodes all parts at once and
keeps the column. The relational part (dictionaries, positions, look-ups) is DataFrame work; payload bytes are made group by group with Arrow.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colonnade.codecs import entropy as E
from colonnade.codecs import integers as I
from colonnade.codecs import repos as R
from colonnade.codecs import strings as T
from colonnade.codecs.frames import Malformed, frame, unframe
from colonnade.codecs.mixing import mixing_decode, mixing_encode
from colonnade.functions.times import strict_epoch
from colonnade.operators import dictionaries as D
from colonnade.operators.order import numbered
from colonnade.sources.events import key_value

SECTIONS = "part string, grp long, section string, n long, payload binary"
Layout = tuple[Callable[[np.ndarray], bytes], Callable[[bytes, int], np.ndarray]]


class EventCodec(Protocol):
    name: str

    def encode(self, events: DataFrame) -> DataFrame: ...

    def decode(self, sections: DataFrame, by: str | None = None) -> DataFrame: ...


@dataclass(frozen=True)
class Transform:
    """A reversible step; steps compose with ``then``."""

    apply: Callable
    revert: Callable

    def then(self, other: Transform) -> Transform:
        return Transform(lambda x: other.apply(self.apply(x)), lambda y: self.revert(other.revert(y)))


#: Levels beyond those of zstd: stored as it is, lzma, context mixing.
STORED, LZMA, MIXED = 0, -1, -2


def compress(data: bytes, level: int) -> bytes:
    """zstd at a level; or STORED, LZMA or MIXED."""
    if level == STORED:
        return data
    if level == MIXED:
        return mixing_encode(data)
    if level == LZMA:
        import lzma

        return lzma.compress(data, preset=9)
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes, level: int) -> bytes:
    if level == STORED:
        return data
    if level == MIXED:
        return mixing_decode(data)
    if level == LZMA:
        import lzma

        return lzma.decompress(data)
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


# Column layouts ------------------------------------------------------------------------------------------------------


def _zig(encode, decode, step=True) -> Layout:
    """A layout for signed values or deltas by way of zigzag."""
    if step:
        return (lambda v: encode(I.zigzag(I.delta(v))), lambda b, n: I.undelta(I.unzigzag(decode(b, n))))
    return (lambda v: encode(I.zigzag(v)), lambda b, n: I.unzigzag(decode(b, n)))


def _offset(encode, decode) -> Layout:
    """Values less their least one, which is stored in front."""
    return (
        lambda v: (int(v.min()) if len(v) else 0).to_bytes(8, "little", signed=True) + encode(v - (v.min() if len(v) else 0)),
        lambda b, n: decode(b[8:], n).astype("i8") + int.from_bytes(b[:8], "little", signed=True),
    )


def two_lag(v: np.ndarray) -> np.ndarray:
    p1, p2 = np.concatenate(([0], v[:-1])), np.concatenate(([0, 0], v[:-2])) if len(v) > 1 else np.zeros(len(v), "i8")
    base = np.where(np.arange(len(v)) < 2, p1, np.maximum(p1, p2[: len(v)]))
    return v - base


def two_lag_undo(d: np.ndarray) -> np.ndarray:
    out: list[int] = []
    for i, x in enumerate(d.tolist()):
        out.append(x + (0 if not i else out[-1] if i == 1 else max(out[-1], out[-2])))
    return np.array(out, "i8")


def markers_encode(v: np.ndarray) -> bytes:
    """Positions where the value changes and what it changes to."""
    at = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, "i8")
    return I.varint_encode(np.concatenate(([len(at)], np.diff(at, prepend=0), v[at])).astype("i8"))


def markers_decode(data: bytes, n: int) -> np.ndarray:
    a = I.varint_decode(data).astype("i8")
    k = int(a[0])
    at = np.cumsum(a[1 : k + 1])
    return np.repeat(a[k + 1 :], np.diff(np.append(at, n)))


def back_refs_encode(v: np.ndarray) -> bytes:
    """0 for a value that is new to the stream, else the value plus one. New values come as t, t + 1 and so on; t is stored in front."""
    values, first = np.unique(v, return_index=True)
    t = int(values[-1]) + 1 if len(v) else 0
    at = {x: i for x, i in zip(values.tolist(), first.tolist(), strict=True)}
    while t - 1 in at and at[t - 1] < at.get(t, len(v)):
        t -= 1
    new = np.zeros(len(v), bool)
    new[[at[x] for x in range(t, int(values[-1]) + 1)] if len(v) else []] = True
    return I.varint_encode(np.concatenate(([t], np.where(new, 0, v + 1))).astype("i8"))


def back_refs_decode(data: bytes, n: int) -> np.ndarray:
    a = I.varint_decode(data, n + 1).astype("i8")
    refs = a[1:]
    fresh = refs == 0
    return np.where(fresh, a[0] + np.cumsum(fresh) - 1, refs - 1)


def limited_mtf_encode(v: np.ndarray, top: int = 4096) -> bytes:
    """The most frequent values by move-to-front, the others apart, a bitmap says which; numbers in byte planes."""
    values, counts = np.unique(v, return_counts=True)
    best = values[np.lexsort((values, -counts))[:top]].tolist()
    recent, head, rest, flags = list(best), [], [], []
    member = set(best)
    for x in v.tolist():
        flags.append(x in member)
        if flags[-1]:
            i = recent.index(x)
            head.append(i)
            recent.insert(0, recent.pop(i))
        else:
            rest.append(x)
    fixed = I.varint_encode(np.array([len(best), len(head), *best], "i8"))
    return E._framed(fixed, E._framed(I.bitmap_encode(np.array(flags, bool)), I.planes_encode(np.array(head, "i8"), 2) + I.planes_encode(np.array(rest, "i8"), 4)))


def limited_mtf_decode(data: bytes, n: int) -> np.ndarray:
    fixed, rest_of = E._unframed(data)
    bits, body = E._unframed(rest_of)
    a = I.varint_decode(fixed).astype("i8").tolist()
    recent, k = a[2:], a[1]
    head, rest = iter(I.planes_decode(body[: 2 * k], k, 2).tolist()), iter(I.planes_decode(body[2 * k :], n - k, 4).tolist())
    out = []
    for f in I.bitmap_decode(bits, n).tolist():
        if f:
            x = recent.pop(next(head))
            recent.insert(0, x)
            out.append(x)
        else:
            out.append(next(rest))
    return np.array(out, "i8")


def late_split_encode(v: np.ndarray) -> bytes:
    """Times below the running maximum apart, as distances to it; the others are sorted and become counts. Numbers by the numeric compressor."""
    top = np.maximum.accumulate(v) if len(v) else v
    late = v < top
    return E._framed(I.bitmap_encode(late), E._framed(E.numeric_encode((top - v)[late]), E.second_counts_encode(v[~late])))


def late_split_decode(data: bytes, n: int) -> np.ndarray:
    bits, rest = E._unframed(data)
    behind, body = E._unframed(rest)
    late = I.bitmap_decode(bits, n).astype(bool)
    out = np.zeros(n, "i8")
    out[~late] = E.second_counts_decode(body, int((~late).sum()))
    top = np.maximum.accumulate(np.where(late, np.iinfo("i8").min, out)) if n else out
    out[late] = top[late] - E.numeric_decode(behind, int(late.sum()))
    return out


def signal_encode(v: np.ndarray) -> bytes:
    """Deltas as varints with a length prefix: a positive one as it is, others behind a zero byte as their opposite."""
    d = I.delta(v)
    up = d > 0
    flat = np.zeros(len(v) + int((~up).sum()), "u8")
    at = np.arange(len(v)) + np.cumsum(~up)
    flat[at] = np.abs(d).view("u8")
    return I.prefix_varint_encode(flat)


def signal_decode(data: bytes, n: int) -> np.ndarray:
    a, out = iter(I.prefix_varint_decode_all(data).tolist()), []
    for x in a:
        out.append(x if x else -next(a))
    if len(out) != n:
        raise ValueError("values are missing")
    return I.undelta(np.array(out, "i8"))


def adaptive_ids_encode(v: np.ndarray) -> bytes:
    """The first value as a varint, the bytes of the zigzag deltas by the adaptive coder."""
    if not len(v):
        return b""
    raw = np.frombuffer(I.varint_encode(I.zigzag(np.diff(v))), "u1").astype("i8")
    return E._framed(I.varint_encode(np.concatenate((I.zigzag(v[:1]).astype("i8"), [len(raw)]))), E.adaptive_encode(raw))


def adaptive_ids_decode(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, "i8")
    head, body = E._unframed(data)
    base, size = I.varint_decode(head, 2)
    raw = E.adaptive_decode(body, int(size)).astype("u1").tobytes()
    return I.unzigzag(np.array([base]))[0] + np.concatenate(([0], np.cumsum(I.unzigzag(I.varint_decode(raw, n - 1)))))


def short_deltas_encode(v: np.ndarray) -> bytes:
    """Deltas that fit two bytes, as zigzag varints; others stand apart behind the escape -32,768."""
    d = I.delta(v)
    wide = (d <= -32768) | (d > 32767)
    return E._framed(I.varint_encode(I.zigzag(d[wide])), I.varint_encode(I.zigzag(np.where(wide, -32768, d))))


def short_deltas_decode(data: bytes, n: int) -> np.ndarray:
    wide, body = E._unframed(data)
    d = I.unzigzag(I.varint_decode(body, n))
    apart = d == -32768
    d[apart] = I.unzigzag(I.varint_decode(wide, int(apart.sum())))
    return I.undelta(d)


VARINT: Layout = (I.varint_encode, lambda b, n: I.varint_decode(b, n).astype("i8"))
DELTA_VARINT = _zig(I.varint_encode, I.varint_decode)
DELTA_BLOCKS = _zig(I.blocks_encode, I.blocks_decode)
DELTA_PACKED = _zig(I.bitpack_encode, I.bitpack_decode)
DELTA_PREFIX = _zig(I.prefix_varint_encode, I.prefix_varint_decode)
DELTA_CATEGORIES: Layout = (lambda v: I.categories_encode(I.delta(v)), lambda b, n: I.undelta(I.categories_decode(b, n)))
DELTA_ARITHMETIC: Layout = (lambda v: E.ranked_ans_encode(I.delta(v)), lambda b, n: I.undelta(E.ranked_ans_decode(b, n)))
PACKED = _offset(I.bitpack_encode, I.bitpack_decode)
NIBBLES: Layout = (I.nibbles_encode, lambda b, n: I.nibbles_decode(b, n).astype("i8"))
U24: Layout = (I.u24_encode, lambda b, n: I.u24_decode(b, n).astype("i8"))
U32: Layout = (I.u32_list_encode, lambda b, n: I.u32_list_decode(b, n).astype("i8"))
BYTES: Layout = (lambda v: I.planes_encode(v, 1), lambda b, n: I.planes_decode(b, n, 1).astype("i8"))
MARKERS: Layout = (markers_encode, markers_decode)
ARITHMETIC: Layout = (E.arithmetic_encode, E.arithmetic_decode)
ANS: Layout = (E.ans_encode, E.ans_decode)
CONTEXTS: Layout = (E.context_ans_encode, E.context_ans_decode)
NUMERIC: Layout = (E.numeric_encode, E.numeric_decode)
ADAPTIVE_IDS: Layout = (adaptive_ids_encode, adaptive_ids_decode)
SIGNALS: Layout = (signal_encode, signal_decode)
SHORT_DELTAS: Layout = (short_deltas_encode, short_deltas_decode)
BACK_REFS: Layout = (back_refs_encode, back_refs_decode)
LIMITED_MTF: Layout = (limited_mtf_encode, limited_mtf_decode)
LATE_SPLIT: Layout = (late_split_encode, late_split_decode)
PERMUTED: Layout = (E.permuted_times_encode, E.permuted_times_decode)
TIMES: Layout = (E.timestamps_encode, E.timestamps_decode)
IDS: Layout = (E.increasing_ids_encode, E.increasing_ids_decode)
HYBRID: Layout = (E.hybrid_encode, E.hybrid_decode)
TWO_LAG: Layout = (lambda v: I.prefix_varint_encode(I.zigzag(two_lag(v))), lambda b, n: two_lag_undo(I.unzigzag(I.prefix_varint_decode(b, n))))


# Layouts of several columns at once ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Joint:
    """A section made of several columns: encode(*columns) -> bytes, decode(bytes, n) -> columns."""

    columns: tuple[str, ...]
    encode: Callable
    decode: Callable


def _rows_encode(*columns: np.ndarray) -> bytes:
    """Row by row, a varint for each column."""
    return I.varint_encode(np.stack([c.astype("u8") for c in columns], 1).reshape(-1))


def _rows_decode(data: bytes, n: int, k: int) -> np.ndarray:
    return I.varint_decode(data, n * k).reshape(n, k)


def first_seen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in the order of their first appearance, and each row's place among them."""
    values, first, inverse = np.unique(v, return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")
    place = np.empty(len(values), "i8")
    place[order] = np.arange(len(values))
    return values[order], place[inverse]


def dated_rows_encode(ids, times, types, repo_ids, names) -> bytes:
    """A dictionary of the dates in order of appearance; rows of id delta, date delta, type, repository id and name."""
    dates, date = first_seen(times)
    rows = _rows_encode(I.zigzag(I.delta(ids)), I.zigzag(I.delta(date)), types, I.zigzag(repo_ids), names)
    return E._framed(I.varint_encode(np.concatenate(([len(dates)], I.zigzag(I.delta(dates)).astype("i8")))), rows)


def dated_rows_decode(data: bytes, n: int):
    head, rows = E._unframed(data)
    dates = I.undelta(I.unzigzag(I.varint_decode(head)[1:]))
    a = _rows_decode(rows, n, 5)
    return I.undelta(I.unzigzag(a[:, 0])), dates[I.undelta(I.unzigzag(a[:, 1]))], a[:, 2].astype("i8"), I.unzigzag(a[:, 3]), a[:, 4].astype("i8")


def delta_rows_encode(ids, times, types, repos) -> bytes:
    """Rows of id delta, time delta, type and repository delta."""
    return _rows_encode(I.zigzag(I.delta(ids)), I.zigzag(I.delta(times)), types, I.zigzag(I.delta(repos)))


def delta_rows_decode(data: bytes, n: int):
    a = _rows_decode(data, n, 4)
    ids, times, repos = (I.undelta(I.unzigzag(a[:, k])) for k in (0, 1, 3))
    return ids, times, a[:, 2].astype("i8"), repos


def type_and_time_encode(types, times) -> bytes:
    """A byte for each row: the type above, the low half of its time step (zigzag of the time less the larger of the two before) below.

    Types from 15 on and steps from 15 on stand apart, as varints behind a 15.
    """
    step = I.zigzag(two_lag(times)).astype("i8")
    late, wide = types >= 15, (step >= 15) | (step < 0)
    packed = (np.where(late, 15, types) << 4) | np.where(wide, 15, step)
    return E._framed(packed.astype("u1").tobytes(), E._framed(I.varint_encode(types[late]), I.prefix_varint_encode(step[wide].view("u8"))))


def type_and_time_decode(data: bytes, n: int):
    packed, rest = E._unframed(data)
    more, steps = E._unframed(rest)
    a = np.frombuffer(packed, "u1").astype("i8")
    if len(a) != n:
        raise ValueError("rows are missing")
    types, step = a >> 4, (a & 15).astype("u8")
    late, wide = types == 15, step == 15
    types[late] = I.varint_decode(more, int(late.sum())).astype("i8")
    step[wide] = I.prefix_varint_decode(steps, int(wide.sum()))
    return types, two_lag_undo(I.unzigzag(step))


DATED_ROWS = Joint(("id", "time", "type", "repo_id", "name"), dated_rows_encode, dated_rows_decode)
DELTA_ROWS = Joint(("id", "time", "type", "repo"), delta_rows_encode, delta_rows_decode)
TYPE_AND_TIME = Joint(("type", "time"), type_and_time_encode, type_and_time_decode)


# Compositions --------------------------------------------------------------------------------------------------------

ORDERS = {
    "type, id": ("event_type", "id"),
    "number": ("id_number", "pos"),
    "canonical": ("id", "event_type", "pos"),
    "input": ("pos",),
}


#: The event types of the source format, in their order.
STATIC_TYPES = (
    "CommitCommentEvent", "CreateEvent", "DeleteEvent", "DiscussionEvent", "ForkEvent", "GollumEvent", "IssueCommentEvent", "IssuesEvent",
    "MemberEvent", "PublicEvent", "PullRequestEvent", "PullRequestReviewCommentEvent", "PullRequestReviewEvent", "PushEvent", "ReleaseEvent", "WatchEvent",
)
CHUNK = 32_768


@dataclass
class Composition:
    """order: of the rows before they are cut into groups; sections: layouts of columns, by name, or Joint ones.

    types: numbered by frequency, sorted, or static (STATIC_TYPES first, all others after them by frequency).
    dimension: what a row says of its repository: "repo", the number of the pair (id, name), pairs being numbered by ``numbering`` (sorted,
    frequency, or first in the order of the rows); "variant", the number of the id in "repo" and which of its names it has in "variant"; or
    "name", its id as it is in "repo_id" and the number of its name. form: the bytes of the dictionary (``codecs.repos``), in chunks of CHUNK pairs, ids or names.
    time_sorted: each group is sorted by time once more. level and levels: the last compression, of all sections or of single ones.
    """

    name: str
    order: str
    sections: dict[str, Layout | Joint]
    form: R.Form
    types: str = "frequency"
    dimension: str = "repo"
    numbering: str = "sorted"
    group_rows: int = 16_384
    time_sorted: bool = False
    level: int = 22
    levels: tuple[tuple[str, int], ...] = ()

    def joints(self) -> dict[str, Joint]:
        return {k: v if isinstance(v, Joint) else Joint((k,), v[0], lambda b, n, dec=v[1]: (dec(b, n),)) for k, v in self.sections.items()}

    def level_of(self, section: str) -> int:
        return dict(self.levels).get(section, self.level)

    def type_numbers(self, events: DataFrame) -> DataFrame:
        """(event_type, type)"""
        if self.types == "sorted":
            found = D.sorted_dictionary(events, "event_type")
        else:
            found = D.frequency_dictionary(events if self.types == "frequency" else events.where(~F.col("event_type").isin(*STATIC_TYPES)), "event_type")
        base = len(STATIC_TYPES) if self.types == "static" else 0
        return found.select("event_type", (F.col("idx") + base).cast("long").alias("type"))

    def repo_numbers(self, rows: DataFrame) -> DataFrame:
        """(repo_id, repo_name, number, and what a row keeps); number is what the dictionary is cut into chunks by."""
        if self.dimension == "name":
            names = D.first_seen_dictionary(rows, "repo_name", at="rn")
            return names.select(F.lit(0).cast("long").alias("repo_id"), "repo_name", F.col("idx").alias("number"), F.col("idx").alias("name"))
        if self.dimension == "variant":
            ids = D.sorted_dictionary(rows, "repo_id")
            each = D.variants(rows, "repo_id", "repo_name").join(ids, "repo_id")
            return each.select("repo_id", "repo_name", F.col("idx").alias("number"), F.col("idx").alias("repo"), F.col("variant").cast("long").alias("variant"))
        if self.numbering == "first":
            pairs = D.first_seen_dictionary(rows, "repo_id", "repo_name", at="rn")
        else:
            pairs = (D.sorted_dictionary if self.numbering == "sorted" else D.frequency_dictionary)(rows, "repo_id", "repo_name")
        return pairs.select("repo_id", "repo_name", F.col("idx").alias("number"), F.col("idx").alias("repo"))

    def encode(self, events: DataFrame) -> DataFrame:
        rows = events.withColumn("id_number", F.col("id").cast("long"))
        rows = numbered(rows, *ORDERS[self.order]).withColumn("grp", F.floor(F.col("rn") / self.group_rows).cast("long"))
        types, repos = self.type_numbers(rows), self.repo_numbers(rows)
        if self.time_sorted:
            place = F.row_number().over(Window.partitionBy("grp").orderBy("epoch_s", "rn")) - 1
            rows = rows.withColumn("rn", F.col("grp") * self.group_rows + place)
        joints = self.joints()
        kept = [c for j in joints.values() for c in j.columns]
        keys = ["repo_name"] if self.dimension == "name" else ["repo_id", "repo_name"]
        facts = rows.join(self._with_static(types), "event_type").join(repos.drop("number", *({"repo_id"} - set(keys))), keys)
        facts = facts.withColumns({"id": F.col("id_number"), "time": F.col("epoch_s")}).select("grp", "rn", *[F.col(c).cast("long") for c in kept])

        def group(table):
            table = table.sort_by("rn")
            g, n = table["grp"][0].as_py(), table.num_rows
            bodies = {s: j.encode(*[table[c].to_numpy() for c in j.columns]) for s, j in joints.items()}
            return self._table("facts", g, n, bodies)

        def types_chunk(table):
            table = table.sort_by("type")
            return self._table("types", 0, table.num_rows, {"types": T.plain_encode(table["event_type"].to_pylist())})

        def repos_chunk(table):
            table = table.sort_by([(c, "ascending") for c in ("number", "repo_name")])
            return self._table("repos", table["g"][0].as_py(), table.num_rows, self.form[0](table["repo_id"].to_numpy(), table["repo_name"].to_pylist()))

        out = facts.groupBy("grp").applyInArrow(group, SECTIONS)
        out = out.unionByName(types.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(types_chunk, SECTIONS))
        chunks = repos.select(F.floor(F.col("number") / CHUNK).cast("long").alias("g"), "number", F.col("repo_id").cast("long"), "repo_name")
        return out.unionByName(chunks.groupBy("g").applyInArrow(repos_chunk, SECTIONS))

    def _with_static(self, types: DataFrame) -> DataFrame:
        if self.types != "static":
            return types
        return types.unionByName(types.sparkSession.createDataFrame(list(zip(STATIC_TYPES, range(len(STATIC_TYPES)), strict=True)), "event_type string, type long"))

    def _table(self, part: str, g: int, n: int, bodies: dict[str, bytes]) -> pa.Table:
        payloads = [frame(s, n, compress(b, self.level_of(s))) for s, b in bodies.items()]
        k = len(bodies)
        return pa.table({"part": [part] * k, "grp": [g] * k, "section": list(bodies), "n": [n] * k, "payload": payloads}, schema=_SECTION_SCHEMA)

    def _bodies(self, table: pa.Table, expected) -> tuple[dict[str, bytes], int]:
        """The bodies of one group's sections, each once and all there, and their number of values."""
        names, n = table["section"].to_pylist(), table["n"][0].as_py()
        if sorted(names) != sorted(expected):
            raise Malformed(f"sections {sorted(names)}")
        return {s: expand(unframe(s, n, p), self.level_of(s)) for s, p in zip(names, table["payload"].to_pylist(), strict=True)}, n

    def decode(self, sections: DataFrame, by: str | None = None) -> DataFrame:
        joints = self.joints()
        keys = [by] if by else []
        kept = [c for j in joints.values() for c in j.columns]
        lead = f"{by} long, " if by else ""
        sections = sections.select(*[F.col(k).cast("long") for k in keys], "part", "grp", "section", "n", "payload")

        def with_key(table: pa.Table, columns: dict) -> pa.Table:
            n = len(next(iter(columns.values())))
            return pa.table({k: pa.array([table[k][0].as_py()] * n, pa.int64()) for k in keys} | columns)

        def group(table):
            bodies, n = self._bodies(table, joints)
            out = {}
            for s, j in joints.items():
                for c, v in zip(j.columns, j.decode(bodies[s], n), strict=True):
                    if len(v) != n:
                        raise Malformed(f"{s}: {len(v)} values where {n} are expected")
                    out[c] = pa.array(np.asarray(v).astype("i8"))
            return with_key(table, out)

        base = len(STATIC_TYPES) if self.types == "static" else 0

        def types_chunk(table):
            bodies, n = self._bodies(table, ("types",))
            return with_key(table, {"type": pa.array(np.arange(n) + base), "event_type": pa.array(T.plain_decode(bodies["types"], n), pa.string())})

        names_of = sorted(self.form[0](np.zeros(0, "i8"), []))

        def repos_chunk(table):
            bodies, n = self._bodies(table, names_of)
            ids, names = self.form[1](bodies, n)
            first, out = table["grp"][0].as_py() * CHUNK, {}
            if self.dimension == "variant":
                new = np.concatenate(([True], ids[1:] != ids[:-1]))
                starts = np.flatnonzero(new)
                run = np.cumsum(new) - 1
                out = {"repo": pa.array(run + first), "variant": pa.array(np.arange(n) - starts[run])}
            else:
                out = {"name" if self.dimension == "name" else "repo": pa.array(np.arange(n) + first)}
            if self.dimension != "name":
                out["repo_id"] = pa.array(np.asarray(ids).astype("i8"))
            return with_key(table, out | {"repo_name": pa.array(names, pa.string())})

        parts = lambda name: sections.where(F.col("part") == name)
        facts = parts("facts").groupBy(*keys, "grp").applyInArrow(group, lead + ", ".join(f"{c} long" for c in kept))
        types = parts("types").groupBy(*keys, "grp").applyInArrow(types_chunk, lead + "type long, event_type string")
        if base:
            static = types.sparkSession.createDataFrame(list(enumerate(STATIC_TYPES)), "type long, event_type string")
            facts = facts.join(types, [*keys, "type"], "left").join(static.withColumnRenamed("event_type", "static_type"), "type", "left")
            facts = facts.withColumn("event_type", F.coalesce("event_type", "static_type"))
        else:
            facts = facts.join(types, [*keys, "type"])
        on = {"repo": ["repo"], "variant": ["repo", "variant"], "name": ["name"]}[self.dimension]
        dims = lead + ", ".join([f"{c} long" for c in on] + ([] if self.dimension == "name" else ["repo_id long"]) + ["repo_name string"])
        repos = parts("repos").groupBy(*keys, "grp").applyInArrow(repos_chunk, dims)
        return facts.join(repos, [*keys, *on]).select(*keys, F.col("id").cast("string").alias("id"), "event_type", "repo_id", "repo_name", F.col("time").alias("epoch_s"))


_SECTION_SCHEMA = pa.schema([("part", pa.string()), ("grp", pa.int64()), ("section", pa.string()), ("n", pa.int64()), ("payload", pa.binary())])


class JsonCodec:
    """Whole rows as JSON pairs of key and value, url and time in full, one array for each row group, compressed at a level."""

    def __init__(self, name: str, level: int, group_rows: int = 16_384):
        self.name, self.level, self.group_rows = name, level, group_rows

    def encode(self, events: DataFrame) -> DataFrame:
        level = self.level
        rows = numbered(key_value(events), "pos").select(F.floor(F.col("rn") / self.group_rows).cast("long").alias("grp"), "rn", F.to_json("key").alias("k"), F.to_json("value").alias("v"))

        def group(table):
            table = table.sort_by("rn")
            pairs = (f"[{k},{v}]" for k, v in zip(table["k"].to_pylist(), table["v"].to_pylist(), strict=True))
            body = ("[" + ",".join(pairs) + "]").encode()
            return pa.table([["facts"], [table["grp"][0].as_py()], ["json"], [table.num_rows], [frame("json", table.num_rows, compress(body, level))]], schema=_SECTION_SCHEMA)

        return rows.groupBy("grp").applyInArrow(group, SECTIONS)

    def decode(self, sections: DataFrame, by: str | None = None) -> DataFrame:
        level, keys = self.level, [by] if by else []

        def lines(batches):
            for b in batches:
                for k, n, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    pairs = json.loads(expand(unframe("json", n, p), level))
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(pairs), pa.int64()), pa.array([json.dumps(a | b) for a, b in pairs], pa.string())], ["k", "j"])

        kind = "id string, event_type string, repo struct<id: bigint, name: string, url: string>, created_at string"
        key = F.col(by) if by else F.lit(0)
        e = sections.select(key.cast("long"), "n", "payload").mapInArrow(lines, "k long, j string").select("k", F.from_json("j", kind).alias("e"))
        return e.select(*[F.col("k").alias(k) for k in keys], "e.id", "e.event_type", F.col("e.repo.id").alias("repo_id"), F.col("e.repo.name").alias("repo_name"), strict_epoch(F.col("e.created_at")).alias("epoch_s"))


#: Fifteen codecs, named by what they do.
CODECS: dict[str, EventCodec] = {
    c.name: c
    for c in (
        JsonCodec("json", 0),
        JsonCodec("json_zstd9", 9),
        Composition("type_markers_blocks", "type, id", {"id": DELTA_BLOCKS, "time": DELTA_BLOCKS, "type": MARKERS, "repo": DELTA_BLOCKS}, R.FRONT_PARTS),
        Composition("arithmetic_repos", "type, id", {"id": DELTA_VARINT, "time": DELTA_CATEGORIES, "type": MARKERS, "repo": ARITHMETIC}, R.FRONT_NAMES),
        Composition("row_varints", "input", {"rows": DATED_ROWS}, R.NEWLINE, types="static", dimension="name"),
        Composition("first_seen_deltas", "input", {"rows": DELTA_ROWS}, R.FRONT_ENTRIES, numbering="first"),
        Composition("packed_row_groups", "input", {"id": DELTA_PACKED, "time": PACKED, "type": PACKED, "repo": PACKED, "variant": PACKED}, R.VARIANT_LISTS, dimension="variant", group_rows=131_072, time_sorted=True),
        Composition("categories_row_groups", "input", {"id": DELTA_CATEGORIES, "time": DELTA_CATEGORIES, "type": PACKED, "repo": PACKED, "variant": PACKED}, R.SENTINEL, dimension="variant", group_rows=140_000, time_sorted=True),
        Composition("nibbles_and_u24", "number", {"id": DELTA_VARINT, "time": SHORT_DELTAS, "type": NIBBLES, "repo": U24}, R.NEWLINE, types="sorted"),
        Composition("limited_recency", "canonical", {"id": DELTA_VARINT, "time": DELTA_PACKED, "type": PACKED, "repo": LIMITED_MTF}, R.SIDE_TABLE),
        Composition("late_rows_apart", "input", {"id": NUMERIC, "time": LATE_SPLIT, "type": NUMERIC, "repo": NUMERIC}, R.OWNER_CODES, numbering="frequency"),
        Composition("permuted_times", "canonical", {"id": ADAPTIVE_IDS, "time": PERMUTED, "type": ANS, "repo": HYBRID}, R.GAPS, types="sorted"),
        Composition("back_references", "canonical", {"id": SIGNALS, "type_time": TYPE_AND_TIME, "repo": BACK_REFS}, R.MARKS, types="static", numbering="first"),
        Composition("packed_columns_mixed", "number", {"id": NUMERIC, "time": NUMERIC, "type": BYTES, "repo": U32}, R.TRANSFORMED, types="sorted", level=LZMA, levels=(("names", MIXED), ("type", MIXED))),
        Composition("ans_columns", "number", {"id": IDS, "time": TIMES, "type": CONTEXTS, "repo": U32}, R.STREAMS, types="sorted", levels=(("kept", MIXED),)),
    )
}


def sizes(sections: DataFrame) -> DataFrame:
    """Bytes of each section."""
    return sections.groupBy("part", "section").agg(F.sum(F.octet_length("payload")).alias("bytes"), F.sum("n").alias("n"))
