import struct

import numpy as np
import pytest

from colonnade.llm import media as M


def noise(n, seed=0, kinds=256):
    return np.random.default_rng(seed).integers(0, kinds, n, "u1").tobytes()


@pytest.mark.parametrize("data", [b"", b"a", b"aaa", b"abcabc", b"a" * 1000, noise(5000), noise(5000, 1, 2), noise(30000, 2, 4) + b"z" * 129])
def test_packbits_and_lzw_round_trip(data):
    assert M.packbits_decode(M.packbits_encode(data), len(data)) == data
    assert M.lzw_decode(M.lzw_encode(data), len(data)) == data


def test_packbits_known_bytes():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert M.packbits_decode(packed, len(plain)) == plain


def test_lzw_known_codes():
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]  # clear, 7, 7 7, 8, 8, 7 7, 6, 6, end, nine bits each
    bits = "".join(f"{c:09b}" for c in codes)
    want = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert M.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == want


@pytest.mark.parametrize("scheme", [M.NONE, M.PACKBITS, M.LZW, M.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("channels", [1, 3])
def test_pages_round_trip(scheme, predictor, tile, channels):
    pages = [M.Page(w, h, 8, channels, scheme, predictor, noise(w * h * channels, w)) for w, h in ((40, 70), (1, 1), (33, 9))]
    back = M.decode(M.encode(pages, tile, strip_rows=16))
    assert back == pages


def big_endian_16_bit():
    """A two-channel, planar, 16-bit, big-endian page with the horizontal predictor, made by hand."""
    a = np.arange(12, dtype=">u2").reshape(2, 2, 3) * 1000  # plane, row, column
    d = np.concatenate((a[..., :1], a[..., 1:] - a[..., :-1]), axis=2).astype(">u2")
    body = d.tobytes()
    entries = [(256, 3, 1, 3 << 16), (257, 3, 1, 2 << 16), (258, 3, 2, 16 << 16 | 16), (259, 3, 1, 1 << 16), (277, 3, 1, 2 << 16), (278, 3, 1, 2 << 16), (284, 3, 1, 2 << 16), (317, 3, 1, 2 << 16)]
    at = 8 + len(body) + 16
    offsets = struct.pack(">4I", 8, 20, 12, 12)
    entries += [(273, 4, 2, 8 + len(body)), (279, 4, 2, 16 + len(body))]
    ifd = struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHII", *e) for e in sorted(entries)) + struct.pack(">I", 0)
    return struct.pack(">2sHI", b"MM", 42, at) + body + offsets + ifd, np.moveaxis(a, 0, 2).astype("<u2").tobytes()


def test_big_endian_planar_16_bit():
    data, want = big_endian_16_bit()
    (page,) = M.decode(data)
    assert (page.width, page.height, page.bits, page.channels) == (3, 2, 16, 2)
    assert page.samples == want


def one_page(order, entries, body):
    """A page made by hand: body right behind the header, entries (tag, type, count, value)."""
    rows = sorted(entries)
    mark = b"MM" if order == ">" else b"II"
    head = struct.pack(order + "2sHI", mark, 42, 8 + len(body))
    pack = lambda k, n, v: struct.pack(order + "HH", v, 0) if k == 3 and n == 1 else struct.pack(order + "I", v)
    return head + body + struct.pack(order + "H", len(rows)) + b"".join(struct.pack(order + "HHI", t, k, n) + pack(k, n, v) for t, k, n, v in rows) + struct.pack(order + "I", 0)


@pytest.mark.parametrize("bits, row, want", [(1, b"\xb0", [1, 0, 1]), (2, b"\x1b", [0, 1, 2]), (4, b"\xab\xc0", [10, 11, 12])])
def test_samples_of_less_than_a_byte(bits, row, want):
    data = one_page("<", [(256, 3, 1, 3), (257, 3, 1, 2), (258, 3, 1, bits), (259, 3, 1, 1), (273, 4, 1, 8), (279, 4, 1, 2 * len(row))], row * 2)
    (page,) = M.decode(data)
    assert list(page.samples) == want * 2 and page.bits == bits


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("bits, kind", [(16, "f2"), (32, "f4"), (64, "f8")])
def test_floating_point_predictor(order, bits, kind):
    a = np.random.default_rng(bits).normal(size=(3, 5, 2)).astype(kind)
    body = b""
    for row in a:
        planes = row.astype(">" + kind).reshape(-1).view("u1").reshape(10, -1).T.reshape(-1, 2)
        body += np.concatenate((planes[:1], planes[1:] - planes[:-1])).tobytes()
    data = one_page(order, [(256, 3, 1, 5), (257, 3, 1, 3), (258, 3, 1, bits), (259, 3, 1, 1), (277, 3, 1, 2), (317, 3, 1, 3), (273, 4, 1, 8), (279, 4, 1, len(body))], body)
    (page,) = M.decode(data)
    assert page.samples == a.astype("<" + kind).tobytes()


def test_every_form_comes_back_and_is_used():
    payloads = [M.payload_of(f"text {i} " * (i % 90))[0] for i in range(200)]
    assert {M.form_of(p) for p in payloads} == set(M.FORMS)
    for p in payloads:
        assert b"".join(x.samples for x in M.decode(M.store(p, *M.form_of(p)))) == p


def rows(data):
    return list(M.page_rows(1, data))


def test_loop_and_damage_are_errors():
    good = M.store(M.payload_of("x" * 700)[0])
    loop = bytearray(good)
    first = struct.unpack_from("<I", loop, 4)[0]
    n = struct.unpack_from("<H", loop, first)[0]
    struct.pack_into("<I", loop, first + 2 + 12 * n, first)
    assert [(r[1], r[9] is None, r[-1]) for r in rows(bytes(loop))] == [(0, False, None), (1, True, "the directory chain has a loop")]
    for bad in (good[:40], b"", b"II*\0", good[:-20]):
        ((_, page, *_, samples, error),) = rows(bad)
        assert page == 0 and samples is None and error


def damaged(tag, value, data=None):
    """A stored value with one tag of its first directory overwritten."""
    data = bytearray(data or M.store(M.payload_of("some text " * 90)[0]))
    first = struct.unpack_from("<I", data, 4)[0]
    for k in range(struct.unpack_from("<H", data, first)[0]):
        at = first + 2 + 12 * k
        if struct.unpack_from("<H", data, at)[0] == tag:
            struct.pack_into("<HII", data, at + 2, *value)
    return bytes(data)


@pytest.mark.parametrize("tag, value", [(M.ROWS_PER_STRIP, (4, 1, 0)), (M.WIDTH, (4, 0, 5)), (M.HEIGHT, (4, 1, 4_000_000_000)), (M.WIDTH, (4, 1, 4_000_000_000)), (M.STRIP_OFFSETS, (4, 1, 0xFFFFFFF0)), (M.STRIP_COUNTS, (4, 1, 3)), (M.COMPRESSION, (3, 1, 7)), (M.BITS, (3, 1, 9)), (M.CHANNELS, (3, 1, 0)), (M.WIDTH, (9, 1, 0xFFFFFFFF))])
def test_damaged_directories_give_a_row(tag, value):
    ((_, page, _, *_, samples, error),) = rows(damaged(tag, value))
    assert page == 0 and samples is None and error


def test_a_bad_page_does_not_cost_the_good_ones():
    pages = [M.Page(16, 16, 8, 1, M.DEFLATE, 1, noise(256, k)) for k in range(3)]
    whole = bytearray(M.encode(pages))
    second = M.encode(pages[:1])
    whole[len(second) + 4] ^= 0xFF  # within the second page's strip
    got = rows(bytes(whole))
    assert [(r[1], r[2], r[-1] is None) for r in got] == [(0, 3, True), (1, 3, False), (2, 3, True)]
    assert got[0][9] == pages[0].samples and got[2][9] == pages[2].samples


def test_a_thousand_damaged_values():
    rng = np.random.default_rng(5)
    for k in range(1000):
        data = bytearray(M.store(noise(576 * (1 + k % 3), k, 5), *M.FORMS[k % len(M.FORMS)]))
        for _ in range(rng.integers(1, 8)):
            at = rng.integers(0, len(data)) if rng.random() < 0.4 else rng.integers(max(0, len(data) - 160), len(data))
            data[at] = rng.integers(0, 256)
        if rng.random() < 0.3:
            data = data[: rng.integers(0, len(data))]
        for r in rows(bytes(data)):
            assert (r[9] is None) == (r[-1] is not None)


def test_digests_against_plain_python(spark):
    import hashlib
    import zlib

    texts = {1: "hi", 2: None, 3: "é" * 3000, 4: "", 5: "some words " * 200}
    got = {r.doc_id: r for r in M.digests(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        a = np.frombuffer(payload, "u1").astype("i8")
        steps = np.abs(np.diff(a.reshape(-1, 576), axis=1))
        bands = ",".join(str(int((a // 16 == k).sum()) * 1000 // len(a)) for k in range(16))
        media = M.store(payload, *M.FORMS[zlib.crc32(payload) % len(M.FORMS)])
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature == f"{r.pages}:{int(a.sum()) * 1000 // len(a)}:{int(steps.sum()) * 1000 // steps.size}:{bands}"


def test_rows_per_page_and_nulls(spark):
    long = "é" * (M.ROW * M.PAGE_ROWS)
    docs = spark.createDataFrame([(1, "hi", 5), (2, None, 6), (3, long, 7), (3, long, 7), (4, "", 8)], "doc_id long, text string, samples int")
    out = {(r.doc_id, r.pages): r for r in M.digests(docs).collect()}
    assert set(out) == {(1, 1), (2, 1), (3, 2), (4, 1)}
    assert out[2, 1].n_bytes == 0 and out[2, 1].payload_bytes == M.ROW and out[2, 1].payload_sha256 == out[4, 1].payload_sha256
    pages = M.read_pages(M.store_texts(docs, forms=((M.PACKBITS, 1, None),))).collect()
    assert sorted((r.id, r.page) for r in pages) == [(1, 0), (2, 0), (3, 0), (3, 0), (3, 1), (3, 1), (4, 0)]
    assert b"".join(r.samples for r in sorted(pages, key=lambda r: (r.id, r.page)) if r.id == 1) == M.payload_of("hi")[0]
    media = spark.createDataFrame([(9, None), (8, bytearray(b"junk"))], "id long, media binary")
    assert sorted((r.id, r.page, r.error is None) for r in M.read_pages(media).collect()) == [(8, 0, False), (9, None, False)]
    assert M.digests(docs.limit(0)).count() == 0
