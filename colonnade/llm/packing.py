"""Hierarchical multi-length packing of tokenised documents.

Every document is tokenised and closed with an end id. Its full windows of the longest context are sequences of their
own; what is left over (shorter than one window) is routed to the smallest context tier that holds it. A pool of such
pieces is packed tier by tier, longest first, each tier into sequences of its own length: a piece of the tier opens a window, and the
gap behind it takes the largest piece that fits from the tier and the shorter ones, again and again. What no piece fits any more is
filled by cutting one; only in the longest tier a gap of less than ``min_fill`` tokens is left (and padded), the shorter tiers' windows
are full. So a short document stands in a short window unless it fills a gap of a longer one. Step groups hold sequences of one tier,
``group_size`` windows of the longest tier or as many tokens in shorter ones, dealt so that the groups' attention costs (sums of squared
piece lengths) stay level. The pool left at the end of a partition is closed with sequences whose lengths are powers of two,
so that it needs no padding.

The ids are those that the ``tokenizers`` library makes with ``vocabulary``. Most texts are encoded with ``ranks``, the same vocabulary
for the faster ``tiktoken``; that one overflows its stack on very long runs of white space, so texts with a run of ``LONG_RUN`` or more
characters are encoded by ``tokenizers`` itself.

Scale: one pass without a shuffle. A task holds one pool (``pool_tokens`` tokens of ids) and one Arrow batch; a lost
task is recomputed from its input split alone. Ids of sequences and step groups carry the partition's number in their upper bits.

Defined results: a null or empty text is the end id alone (one token); repeated rows are packed once each; an empty table
gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.batches import bounded_batches

TIERS = (128, 256, 512, 1024)
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, padded_length long, tier int, step_group long"
)


#: A text with so much white space in one place is not given to tiktoken, which overflows its stack at some ten times as much.
LONG_RUN = 30_000
_LONG_RUN = re.compile(rf"\s{{{LONG_RUN}}}")


class Encoder:
    """Token ids of texts; texts that spell special tokens are ordinary text."""

    def __init__(self, vocabulary: str, ranks: str | None):
        self.vocabulary, self.fast = vocabulary, None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @cached_property
    def exact(self):
        """The tokenizers library's own; loaded by workers that meet a text for it."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.vocabulary)
        found.encode_special_tokens = True
        return found

    def ids(self, text: str) -> list[int]:
        if self.fast is None or (len(text) >= LONG_RUN and _LONG_RUN.search(text)):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str | None = None) -> Encoder:
    return Encoder(vocabulary, ranks)


def default_vocabulary() -> tuple[str, str]:
    """byte_bpe_50k.json, and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@dataclass(order=True)
class Piece:
    length: int
    doc_id: int | None = field(compare=False)
    start: int = field(compare=False)
    doc_tokens: int = field(compare=False)
    ids: np.ndarray = field(compare=False)

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return (
            Piece(n, self.doc_id, self.start, self.doc_tokens, self.ids[:n]),
            Piece(self.length - n, self.doc_id, self.start + n, self.doc_tokens, self.ids[n:]),
        )


def split_document(doc_id, ids: np.ndarray, window: int) -> tuple[list[Piece], Piece | None]:
    """Full windows, and the rest if there is any."""
    n = len(ids)
    pieces = [Piece(min(window, n - s), doc_id, s, n, ids[s : s + window]) for s in range(0, n, window)]
    rest = pieces.pop() if pieces and pieces[-1].length < window else None
    return pieces, rest


def pack_pool(pool: Iterable[Piece], tiers=TIERS, min_fill: int = 8) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """(tier, window) for windows that are full, but for less than min_fill tokens in the longest tier, and the pieces of the last, unfilled one."""
    shelves: list[list[Piece]] = [[] for _ in tiers]
    for p in pool:
        shelves[_tier(p.length, tiers)].append(p)
    for s in shelves:
        s.sort()
    done: list[tuple[int, list[Piece]]] = []
    for k in range(len(tiers) - 1, -1, -1):
        least = min_fill if k == len(tiers) - 1 else 1
        while shelves[k]:
            opened = [shelves[k].pop()]
            gap = tiers[k] - opened[0].length
            while gap >= least:
                if p := _largest(shelves, k, gap):
                    opened.append(p)
                    gap -= p.length
                    continue
                donor = next((s for s in shelves if s), None)  # nothing fits: cut the shortest piece there is
                if donor is None:
                    return done, opened
                head, tail = donor.pop(0).cut(gap)
                insort(shelves[_tier(tail.length, tiers)], tail)
                opened.append(head)
                gap = 0
            done.append((tiers[k], opened))
    return done, []


def _tier(length: int, tiers) -> int:
    return next(i for i, t in enumerate(tiers) if length <= t)


def _largest(shelves: list[list[Piece]], top: int, gap: int) -> Piece | None:
    """Takes the longest piece that fits from this tier or a shorter one."""
    for s in reversed(shelves[: top + 1]):
        if s and s[0].length <= gap:
            probe = Piece(gap, None, 0, 0, s[0].ids)
            return s.pop(bisect_right(s, probe) - 1)
    return None


def close_remainder(pieces: list[Piece]) -> list[list[Piece]]:
    """Sequences whose lengths are powers of two, longest first, from the pieces of one unfilled window."""
    left, total, out = list(pieces), sum(p.length for p in pieces), []
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        seq = []
        while room:
            p = left.pop(0)
            if p.length > room:
                p, tail = p.cut(room)
                left.insert(0, tail)
            seq.append(p)
            room -= p.length
        out.append(seq)
    return out


def step_groups(costs: list[int], group_size: int) -> list[int]:
    """Group of each sequence: longest cost first into the group with the least cost that has room."""
    n = max(1, -(-len(costs) // group_size))
    heap, room, out = [(0, g) for g in range(n)], [group_size] * n, [0] * len(costs)
    for i in sorted(range(len(costs)), key=lambda i: -costs[i]):
        cost, g = heapq.heappop(heap)
        out[i] = g
        room[g] -= 1
        if room[g]:
            heapq.heappush(heap, (cost + costs[i], g))
    return out


class _Packer:
    def __init__(self, partition: int, tiers, pool_tokens: int, min_fill: int, group_size: int):
        self.tiers, self.pool_tokens, self.min_fill, self.group_size = tiers, pool_tokens, min_fill, group_size
        self.pool: list[Piece] = []
        self.full: list[tuple[int, list[Piece]]] = []
        self.held = 0
        self.next_sequence = self.next_group = partition << 40
        self.cols: list[list] = [[] for _ in SCHEMA.split(",")]

    def add(self, doc_id, ids: np.ndarray) -> None:
        full, rest = split_document(doc_id, ids, self.tiers[-1])
        self.full += [(self.tiers[-1], [p]) for p in full]
        if rest:
            self.pool.append(rest)
        self.held += len(ids)
        if self.held >= self.pool_tokens:
            self.flush()

    def flush(self, last: bool = False) -> None:
        done, open_ = pack_pool(self.pool, self.tiers, self.min_fill)
        self.pool = open_
        if last:
            done += [(self.tiers[_tier(sum(p.length for p in s), self.tiers)], s) for s in close_remainder(open_)]
            self.pool = []
        window = self.tiers[-1]
        for tier in self.tiers:
            seqs = [s for t, s in self.full + done if t == tier]
            groups = step_groups([sum(p.length**2 for p in s) for s in seqs], self.group_size * window // tier)
            for seq, g in zip(seqs, groups, strict=True):
                length = sum(p.length for p in seq)
                padded = length if length & (length - 1) == 0 else window
                at = 0
                for p in seq:
                    crc = zlib.crc32(p.ids.tobytes())
                    row = (p.doc_id, p.start, p.length, crc, p.doc_tokens, self.next_sequence, at, length, padded, tier, self.next_group + g)
                    for c, v in zip(self.cols, row, strict=True):
                        c.append(v)
                    at += p.length
                self.next_sequence += 1
            self.next_group += max(groups, default=-1) + 1
        self.full, self.held = [], sum(p.length for p in self.pool)

    def take(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int32() if x.endswith(" int") else pa.int64() for x in SCHEMA.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.cols, kinds, strict=True)], names)
        self.cols = [[] for _ in self.cols]
        return out


def pack(
    docs: DataFrame,
    *,
    vocabulary: str | None = None,
    ranks: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = 0,
    pool_tokens: int = 1 << 20,
    min_fill: int = 8,
    group_size: int = 64,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence (SCHEMA).

    ``length`` ids from ``start`` of the document lie at ``offset`` of sequence ``sequence_id``, which holds
    ``sequence_length`` ids and is padded to ``padded_length``; ``tier`` is the context length of its tier. ``vocabulary`` is a file of
    the tokenizers library and ``ranks`` the same vocabulary for tiktoken (optional).
    """
    files = (vocabulary, ranks) if vocabulary else default_vocabulary()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(*files), np.array([end_id], "<u4")
        packer = _Packer(TaskContext.get().partitionId(), tiers, pool_tokens, min_fill, group_size)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.asarray(enc.ids(text.as_py() or ""), "<u4")
                packer.add(doc_id, np.concatenate([ids, end]))
                if len(packer.cols[0]) >= 20_000:
                    yield packer.take()
        packer.flush(last=True)
        yield packer.take()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
