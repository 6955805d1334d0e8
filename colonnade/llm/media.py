"""TIFF media columns: image directories, strips and tiles, and one row per page.

The reader walks the chain of image directories (either byte order), decodes each page's strips or tiles (stored plainly, PackBits, LZW
or deflate), undoes the horizontal or the floating-point predictor and gives the page's samples as one binary, rows from the top, channels
interleaved, samples of less than 8 bits one a byte, of more than 8 bits little-endian. Samples of 1, 2, 4, 8, 16, 32 and 64 bits are read.
The writer stores byte payloads as 8-bit greyscale pages and is its exact inverse.

``digests`` and ``store_texts`` deal the payloads over FORMS (compression, predictor, strips or tiles) by their checksum, so that equal
texts have equal media and every decoder of the method takes its share of the table.

Scale: row-wise and without a shuffle; a task holds one Arrow batch of ``BATCH_BYTES`` at most plus the media value at hand. A page
is made only if the bytes present can hold it (no compression scheme here makes more than EXPANSION bytes of one) and its samples stay
under MAX_SAMPLES, the most that an Arrow value holds.

Defined results: a null media value gives one row with a null page and the reason in ``error``. Of a damaged value every page that can
be decoded is given, and a row with the page's number, null samples and the reason stands for each one that can't; where the chain of
directories itself breaks, one such row ends the value. An empty payload can't be stored (TIFF has no empty image), the caller pads it;
repeated rows give repeated pages; an empty table gives an empty result; other columns than the id and the media column do not matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.batches import bounded_batches

# Fixed values of the format: tags, types and compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS = 256, 257, 258, 259, 262, 273
CHANNELS, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
HORIZONTAL, FLOATING = 2, 3
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_SIZES = {1: ("B", 1), 2: ("B", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 16: ("Q", 8)}
LZW_CLEAR, LZW_END, LZW_FIRST, LZW_MAX_BITS = 256, 257, 258, 12

BATCH_BYTES = 8 << 20
ROW, PAGE_ROWS, STRIP_ROWS = 576, 4096, 64
#: Bytes that one stored byte can stand for at most; a code of LZW has 9 bits at least and an entry 3,838 bytes at most.
EXPANSION = {NONE: 1, PACKBITS: 64, LZW: 3838, DEFLATE: 1032, OLD_DEFLATE: 1032}
MAX_SAMPLES = (1 << 31) - 1
#: Compression, predictor and tile of the stored forms.
FORMS = ((DEFLATE, 1, None), (DEFLATE, HORIZONTAL, None), (PACKBITS, 1, None), (LZW, 1, None), (DEFLATE, HORIZONTAL, (288, 16)), (PACKBITS, 1, (192, 16)), (NONE, 1, None), (LZW, HORIZONTAL, (576, 16)))
PAGE_SCHEMA = "id long, page int, pages int, width int, height int, bits int, channels int, compression int, predictor int, samples binary, error string"


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size and at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more as repeats, the rest as literals of up to 128 bytes."""
    a = np.frombuffer(data, "u1")
    if not len(a):
        return b""
    starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    lengths = np.diff(np.append(starts, len(a)))
    out, plain = bytearray(), 0

    def literal(end: int) -> None:
        for s in range(plain, end, 128):
            part = data[s : min(end, s + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for s, n in zip(starts[lengths >= 3].tolist(), lengths[lengths >= 3].tolist(), strict=True):
        literal(s)
        plain = s + n
        while n:
            k = min(n, 128)
            if k == 1:
                out += bytes((0, data[s]))
            else:
                out += bytes((257 - k, data[s]))
            n -= k
    literal(len(data))
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bit first, widened one code early."""
    out, bits, held, at, width = bytearray(), 0, 0, 0, 9
    table: list[bytes] = []
    last = b""
    while len(out) < size:
        while held < width:
            if at >= len(data):
                return bytes(out)
            bits = (bits << 8 | data[at]) & 0xFFFFFF
            at += 1
            held += 8
        held -= width
        code = bits >> held & ((1 << width) - 1)
        if code == LZW_END:
            break
        if code == LZW_CLEAR:
            table, last, width = [bytes((i,)) for i in range(256)] + [b"", b""], b"", 9
            continue
        if not table:
            raise ValueError("LZW data without a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("bad LZW code")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = min(LZW_MAX_BITS, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    acc, held, out = 0, 0, bytearray()
    table: dict[int, int] = {}  # code of a word and the byte after it, as one number: the longer word's code
    width, following = 9, LZW_FIRST

    def put(code: int) -> None:
        nonlocal acc, held
        acc, held = acc << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(acc >> held & 255)
        acc &= (1 << held) - 1

    put(LZW_CLEAR)
    word = -1
    for x in data:
        if word < 0:
            word = x
            continue
        longer = table.get(word << 8 | x)
        if longer is not None:
            word = longer
            continue
        put(word)
        table[word << 8 | x] = following
        following += 1
        if following >> width:
            width += 1
        if following == (1 << LZW_MAX_BITS) - 2:
            put(LZW_CLEAR)
            table, width, following = {}, 9, LZW_FIRST
        word = x
    if word >= 0:
        put(word)
        following += 1
        width = min(LZW_MAX_BITS, max(width, following.bit_length()))
    put(LZW_END)
    if held:
        out.append(acc << (8 - held) & 255)
    return bytes(out)


def _unpack(data: bytes, scheme: int, size: int) -> bytes:
    if scheme == NONE:
        got = data
    elif scheme == PACKBITS:
        got = packbits_decode(data, size)
    elif scheme == LZW:
        got = lzw_decode(data, size)
    elif scheme in (DEFLATE, OLD_DEFLATE):
        got = zlib.decompressobj().decompress(data, size)
    else:
        raise ValueError(f"compression {scheme}")
    if len(got) < size:
        raise ValueError("a strip or tile is short")
    return got[:size]


def _pack(data: bytes, scheme: int) -> bytes:
    return {NONE: lambda d: d, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 6)}[scheme](data)


@dataclass
class Page:
    width: int
    height: int
    bits: int
    channels: int
    compression: int
    predictor: int
    samples: bytes


class Damaged(ValueError):
    """A value or page that can't be read."""


def directories(data: bytes) -> Iterator[tuple[dict, str]]:
    """Tags and byte order of each directory of the chain; raises Damaged where it breaks."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise Damaged("not a TIFF")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise Damaged("the directory chain has a loop")
        seen.add(at)
        if at + 2 > len(data):
            raise Damaged("a directory lies beyond the end")
        n = struct.unpack_from(order + "H", data, at)[0]
        if at + 6 + 12 * n > len(data):
            raise Damaged("a directory is cut off")
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in TYPE_SIZES and count:
                letter, width = TYPE_SIZES[kind]
                place = at + 10 + 12 * k
                if width * count > 4:
                    place = struct.unpack_from(order + "I", data, place)[0]
                # a tag whose values lie beyond the end is left out; a page that needs it will say so
                if place + width * count <= len(data):
                    tags[tag] = struct.unpack_from(f"{order}{count}{letter}", data, place)
        yield tags, order
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def read(data: bytes) -> Iterator[Page | str]:
    """The pages in the order of the directory chain; in place of what can't be read, the reason."""
    chain = directories(data)
    while True:
        try:
            tags, order = next(chain)
        except StopIteration:
            return
        except (Damaged, struct.error) as e:
            yield str(e)
            return
        try:
            yield _page(data, tags, order)
        except (ValueError, KeyError, IndexError, zlib.error, struct.error, MemoryError, OverflowError) as e:
            yield f"{type(e).__name__}: {e}"


def decode(data: bytes) -> list[Page]:
    """All pages; raises Damaged if any can't be read."""
    pages = []
    for p in read(data):
        if isinstance(p, str):
            raise Damaged(p)
        pages.append(p)
    return pages


def _integrated(block: np.ndarray, inner: int) -> np.ndarray:
    """Undoes the horizontal predictor: sums along each row, channel by channel."""
    rows, kind = len(block), block.dtype.newbyteorder("=")
    return np.cumsum(block.reshape(rows, -1, inner).astype(kind), axis=1, dtype=kind).reshape(rows, -1)


def _page(data: bytes, tags: dict, order: str) -> Page:
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, channels = one(WIDTH, 0), one(HEIGHT, 0), one(CHANNELS, 1)
    scheme, predictor, bits = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(BITS, 1)
    if min(width, height, channels) < 1:
        raise Damaged("a page without a size")
    if bits not in (1, 2, 4, 8, 16, 32, 64) or len(set(tags.get(BITS, (bits,)))) > 1:
        raise Damaged(f"{bits} bits a sample")
    if predictor not in (1, HORIZONTAL, FLOATING) or (predictor == HORIZONTAL and bits < 8) or (predictor == FLOATING and bits < 16):
        raise Damaged(f"predictor {predictor} with {bits} bits")
    if scheme not in EXPANSION:
        raise Damaged(f"compression {scheme}")
    planes = channels if one(PLANAR, 1) == 2 and channels > 1 else 1
    inner = channels // planes
    tiled = TILE_WIDTH in tags
    bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT, 0)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
    if min(bw, bh) < 1:
        raise Damaged("strips or tiles without a size")
    offsets, counts = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ()), tags.get(TILE_COUNTS if tiled else STRIP_COUNTS, ())
    across, down = -(-width // bw), -(-height // bh)
    if min(len(offsets), len(counts)) < across * down * planes:
        raise Damaged("strips or tiles are missing")
    size = max(1, bits // 8)
    line = -(-bw * inner * bits // 8)
    if height * width * channels * size > MAX_SAMPLES or bh * line > MAX_SAMPLES:
        raise Damaged("a page beyond the largest size")
    blocks = [data[o : o + c] for o, c in zip(offsets[: across * down * planes], counts, strict=False) if min(o, c) >= 0]
    lines = [bh if tiled else min(bh, height - i % (across * down) // across * bh) for i in range(across * down * planes)]
    if len(blocks) < len(lines) or any(n * line > len(b) * EXPANSION[scheme] for n, b in zip(lines, blocks, strict=True)):
        raise Damaged("a strip or tile is short")
    kind = np.dtype(f"{order}u{size}")
    picture = np.zeros((height, width * inner, planes), kind)
    for i, (rows, raw) in enumerate(zip(lines, blocks, strict=True)):
        plane, rest = divmod(i, across * down)
        y, x = rest // across * bh, rest % across * bw
        block = np.frombuffer(_unpack(raw, scheme, rows * line), "u1").reshape(rows, line)
        if bits < 8:
            apart = np.unpackbits(block, axis=1).reshape(rows, -1, bits)
            block = (apart << np.arange(bits - 1, -1, -1, dtype="u1")).sum(2, dtype="u1")[:, : bw * inner]
        elif predictor == FLOATING:  # bytes are summed along the row; then come all first bytes of its samples, all second ones and so on
            block = _integrated(block, inner).reshape(rows, size, -1).swapaxes(1, 2)
            block = np.ascontiguousarray(block).reshape(rows, -1).view(f">u{size}").astype(kind)
        else:
            block = block.view(kind)
            if predictor == HORIZONTAL:
                block = _integrated(block, inner)
        h, w = min(rows, height - y), min(bw, width - x)
        picture[y : y + h, x * inner : (x + w) * inner, plane] = block[:h, : w * inner]
    return Page(width, height, bits, channels, scheme, predictor, picture.astype(kind.newbyteorder("<")).tobytes())


def encode(pages: list[Page], tile: tuple[int, int] | None = None, strip_rows: int = STRIP_ROWS) -> bytes:
    """A little-endian TIFF of 8-bit pages, in strips or in tiles (width, height)."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for p in pages:
        if p.bits != 8 or len(p.samples) != p.width * p.height * p.channels or not p.samples:
            raise ValueError("8-bit samples for the whole page are needed")
        picture = np.frombuffer(p.samples, "u1").reshape(p.height, p.width, p.channels)
        bw, bh = tile or (p.width, min(p.height, strip_rows))
        offsets, counts = [], []
        for y in range(0, p.height, bh):
            for x in range(0, p.width, bw):
                block = picture[y : y + bh, x : x + bw]
                if tile:
                    block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1]), (0, 0)))
                if p.predictor == HORIZONTAL:
                    block = np.concatenate((block[:, :1], block[:, 1:] - block[:, :-1]), axis=1)
                packed = _pack(block.tobytes(), p.compression)
                offsets.append(len(out))
                counts.append(len(packed))
                out += packed
        out += b"\0" * (len(out) % 2)
        places = {}
        for name, values in (("offsets", offsets), ("counts", counts), ("bits", [8] * p.channels)):
            letter = "H" if name == "bits" else "I"
            if len(values) * (2 if letter == "H" else 4) > 4:
                places[name] = len(out)
                out += struct.pack(f"<{len(values)}{letter}", *values)
            else:
                places[name] = struct.unpack("<I", struct.pack(f"<{len(values)}{letter}", *values).ljust(4, b"\0"))[0]
        entries = [
            (WIDTH, 4, 1, p.width), (HEIGHT, 4, 1, p.height), (BITS, 3, p.channels, places["bits"]), (COMPRESSION, 3, 1, p.compression),
            (PHOTOMETRIC, 3, 1, 2 if p.channels == 3 else 1), (CHANNELS, 3, 1, p.channels), (PLANAR, 3, 1, 1), (PREDICTOR, 3, 1, p.predictor),
        ]
        if tile:
            entries += [(TILE_WIDTH, 4, 1, bw), (TILE_HEIGHT, 4, 1, bh), (TILE_OFFSETS, 4, len(offsets), places["offsets"]), (TILE_COUNTS, 4, len(counts), places["counts"])]
        else:
            entries += [(STRIP_OFFSETS, 4, len(offsets), places["offsets"]), (ROWS_PER_STRIP, 4, 1, bh), (STRIP_COUNTS, 4, len(counts), places["counts"])]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries))
        for e in sorted(entries):
            out += struct.pack("<HHII", *e)
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def payload_of(text: str | None, multiple: int = ROW) -> tuple[bytes, int]:
    """UTF-8 padded with 255 up to a positive multiple, and the unpadded length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    full = max(1, -(-len(raw) // multiple)) * multiple
    return raw.ljust(full, b"\xff"), len(raw)


def form_of(payload: bytes, forms=FORMS) -> tuple:
    """The stored form that the payload's checksum picks."""
    return forms[zlib.crc32(payload) % len(forms)]


def store(payload: bytes, compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None) -> bytes:
    """A payload of whole rows of ROW bytes as a TIFF of pages of at most PAGE_ROWS rows."""
    step = ROW * PAGE_ROWS
    parts = [payload[i : i + step] for i in range(0, len(payload), step)]
    return encode([Page(ROW, len(p) // ROW, 8, 1, compression, predictor, p) for p in parts], tile)


def store_texts(docs: DataFrame, *, forms: tuple = FORMS) -> DataFrame:
    """(id, n_bytes, media): the text of each row of docs (doc_id, text) as a TIFF in one of the forms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                payload, n = payload_of(text.as_py())
                held.append((doc_id, n, store(payload, *form_of(payload, forms))))
                size += len(payload)
                if size >= BATCH_BYTES:
                    yield _batch(held, STORED)
                    held, size = [], 0
            yield _batch(held, STORED)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "id long, n_bytes long, media binary")


STORED = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
PAGES = pa.schema(
    [("id", pa.int64()), *[(c, pa.int32()) for c in ("page", "pages", "width", "height", "bits", "channels", "compression", "predictor")], ("samples", pa.binary()), ("error", pa.string())]
)
DIGESTS = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pages", pa.int32())]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def page_rows(media_id, media: bytes | None) -> Iterator[tuple]:
    """Rows of PAGES for one value, page by page; ``pages`` is how many directories the value has."""
    if media is None:
        yield (media_id, *[None] * 8, None, "null")
        return
    total = 0
    try:
        for _ in directories(media):
            total += 1
    except (Damaged, struct.error):
        pass
    for i, p in enumerate(read(media)):
        if isinstance(p, str):
            yield (media_id, i, total, *[None] * 6, None, p)
        else:
            yield (media_id, i, total, p.width, p.height, p.bits, p.channels, p.compression, p.predictor, p.samples, None)


def read_pages(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """One row per page (PAGE_SCHEMA) of each TIFF in a binary column, pages of a value in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for media_id, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for row in page_rows(media_id, data.as_py()):
                    held.append(row)
                    size += len(row[9] or b"")
                    if size >= BATCH_BYTES:
                        yield _batch(held, PAGES)
                        held, size = [], 0
            yield _batch(held, PAGES)

    bounded_batches(media.sparkSession)
    return media.select(F.col(id_col).cast("long"), F.col(media_col).cast("binary")).mapInArrow(run, PAGE_SCHEMA)


def feature_of(parts: list[bytes], pages: int) -> str:
    """Pages, mean sample, mean absolute step along a row and the counts of 16 sample bands in thousandths."""
    a = np.frombuffer(b"".join(parts), "u1")
    bands = np.bincount(a >> 4, minlength=16) * 1000 // len(a)
    rows = a.reshape(-1, ROW) if len(a) % ROW == 0 else a.reshape(1, -1)
    step = int(np.abs(np.diff(rows.astype("i2"), axis=1)).sum(dtype="i8")) * 1000 // max(1, rows.shape[0] * (rows.shape[1] - 1))
    return f"{pages}:{int(a.sum(dtype='u8')) * 1000 // len(a)}:{step}:" + ",".join(map(str, bands.tolist()))


def digests(docs: DataFrame, *, forms: tuple = FORMS) -> DataFrame:
    """Stores the text of each document as a TIFF, reads its pages back and describes both forms, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for media_id, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                media = data.as_py()
                parts = []
                for row in page_rows(media_id, media):
                    if row[-1]:
                        raise ValueError(row[-1])
                    parts.append(row[9])
                payload = b"".join(parts)
                rows.append((media_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(parts, len(parts)), len(parts)))
            yield _batch(rows, DIGESTS)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int"
    return store_texts(docs, forms=forms).mapInArrow(run, schema)
