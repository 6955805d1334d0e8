import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colonnade.codecs import entropy as E
from colonnade.codecs import events as C
from colonnade.codecs import integers as I
from colonnade.codecs import repos
from colonnade.codecs import strings as T
from colonnade.codecs.frames import HEADER, Malformed, frame, unframe
from colonnade.codecs.mixing import mixing_decode, mixing_encode

RNG = np.random.default_rng(4)
SMALL = [np.zeros(0, "i8"), np.array([0]), np.array([5, 5, 5]), RNG.integers(0, 16, 1000), RNG.geometric(0.3, 3000) - 1, np.arange(200)]
WIDE = [np.array([0, 1, 127, 128, 16383, 16384, 1000000]), np.array([2**62, 2**63 - 1, 0, 1]), RNG.integers(0, 2**40, 500)]
SIGNED = [np.array([0, -1, 1, -(2**62), 2**62]), RNG.integers(-300, 300, 2000)]
INCREASING = [np.array([3]), np.array([0, 1, 2, 3]), np.unique(RNG.integers(0, 10**6, 700)), np.array([0, 2**40])]
SORTED = [np.sort(RNG.integers(1000, 1300, 900)), np.array([-5, -5, 7])]


def same(a, b):
    return np.array_equal(np.asarray(a).astype("i8"), np.asarray(b).astype("i8"))


@pytest.mark.parametrize("name", ["varint", "reverse_varints", "prefix_varint", "bitpack", "blocks"])
@pytest.mark.parametrize("v", SMALL + WIDE, ids=range(len(SMALL + WIDE)))
def test_unsigned_layouts(name, v):
    assert same(getattr(I, f"{name}_decode")(getattr(I, f"{name}_encode")(v), len(v)), v)


@pytest.mark.parametrize("v", SMALL, ids=range(len(SMALL)))
def test_narrow_layouts(v):
    assert same(I.u32_list_decode(I.u32_list_encode(v), len(v)), v)
    assert same(I.u24_decode(I.u24_encode(v), len(v)), v)
    assert same(I.planes_decode(I.planes_encode(v, 3), len(v), 3), v)
    assert same(I.nibbles_decode(I.nibbles_encode(v % 16), len(v)), v % 16)
    assert same(I.bitmap_decode(I.bitmap_encode(v % 2), len(v)), v % 2)


@pytest.mark.parametrize("name", ["ans", "ranked_ans", "escape_ans", "timestamps", "increasing_ids", "top_k_ans", "hybrid", "context_ans", "arithmetic", "adaptive", "numeric"])
@pytest.mark.parametrize("v", SMALL, ids=range(len(SMALL)))
def test_entropy_coders(name, v):
    assert same(getattr(E, f"{name}_decode")(getattr(E, f"{name}_encode")(v), len(v)), v)


@pytest.mark.parametrize("v", SIGNED, ids=range(len(SIGNED)))
def test_signed(v):
    assert same(I.unzigzag(I.zigzag(v)), v)
    assert same(I.undelta(I.delta(v)), v)
    assert same(I.categories_decode(I.categories_encode(v), len(v)), v)
    assert same(E.ranked_ans_decode(E.ranked_ans_encode(v), len(v)), v)
    assert same(E.numeric_decode(E.numeric_encode(v), len(v)), v)
    for layout in (C.SIGNALS, C.SHORT_DELTAS, C.ADAPTIVE_IDS):
        assert same(layout[1](layout[0](v), len(v)), v)
    nz = v[v != 0]
    assert same(E.small_delta_decode(E.small_delta_encode(nz[np.abs(nz) < 2**40]), int((np.abs(nz) < 2**40).sum())), nz[np.abs(nz) < 2**40])


@pytest.mark.parametrize("v", INCREASING, ids=range(len(INCREASING)))
def test_interpolative(v):
    assert same(I.interpolative_decode(I.interpolative_encode(v)), v)


@pytest.mark.parametrize("v", SORTED, ids=range(len(SORTED)))
def test_times(v):
    assert same(I.per_unit_decode(I.per_unit_encode(v), len(v)), v)
    shuffled = np.concatenate((v[3:], v[:3]))
    assert same(E.permuted_times_decode(E.permuted_times_encode(shuffled), len(v)), shuffled)
    assert same(E.timestamps_decode(E.timestamps_encode(shuffled), len(v)), shuffled)


def test_refusals():
    for f, v in ((I.varint_encode, [-1]), (I.nibbles_encode, [16]), (I.u24_encode, [1 << 24]), (I.u32_list_encode, [1 << 32]), (I.interpolative_encode, [1, 1]), (I.per_unit_encode, [2, 1]), (E.adaptive_encode, [256]), (E.small_delta_encode, [0]), (I.per_unit_encode, [0, 10**8])):
        with pytest.raises(ValueError):
            f(np.array(v))
    with pytest.raises(ValueError):
        I.varint_decode(b"\x80")
    with pytest.raises(ValueError):
        I.varint_decode(b"\x01", 2)


def test_frequencies_add_up():
    for _ in range(40):
        counts = RNG.integers(0, 1000, RNG.integers(1, 300)) * (RNG.random() < 0.9)
        f = E.normalised(counts, 4096)
        assert f.sum() == (4096 if counts.any() else 0) and ((f > 0) == (counts > 0)).all()
        back, size = E.table_decode(E.table_encode(f))
        assert same(back, f) and size == len(E.table_encode(f))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1), max_size=60))
def test_layouts_on_anything(values):
    v = np.array(values, "i8")
    for name in ("varint", "prefix_varint", "bitpack", "blocks"):
        assert same(getattr(I, f"{name}_decode")(getattr(I, f"{name}_encode")(v), len(v)), v)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=80))
def test_coders_on_anything(values):
    v = np.array(values, "i8")
    for name in ("ans", "escape_ans", "arithmetic", "adaptive", "context_ans", "top_k_ans", "hybrid", "numeric", "timestamps", "permuted_times"):
        assert same(getattr(E, f"{name}_decode")(getattr(E, f"{name}_encode")(v), len(v)), v)


def test_known_bytes():
    """Bytes worked out by hand from the layouts' definitions."""
    known = [
        (I.varint_encode, [0, 127, 128, 300, 16384], "007f8001ac02808001"),
        (I.prefix_varint_encode, [0, 1, 127, 128, 16383, 16384, 1000000], "00017f8080bfffc04000cf4240"),
        (I.prefix_varint_encode, [1 << 56], "ff0100000000000000"),
        (I.reverse_varints_encode, [1, 300], "02ac01"),
        (I.bitpack_encode, [1, 2, 3], "0239"),
        (I.bitpack_encode, [0, 0], "0100"),
        (I.u32_list_encode, [1, 258], "020000000100000002010000"),
        (I.nibbles_encode, [1, 2, 15], "210f"),
        (I.u24_encode, [1, 65536], "010000000001"),
        (lambda v: I.planes_encode(v, 2), [1, 258], "01020001"),
        (I.bitmap_encode, [1, 0, 0, 1, 0, 0, 0, 0, 1], "0901"),
        (I.categories_encode, [0, 1, 2, 7, -1], "e4030e01"),
        (I.interpolative_encode, [1, 2, 5], "03000000050000000000000015"),
        (I.per_unit_encode, [5, 5, 8], "0a02000001"),
        (E.table_encode, [3, 0, 300], "030503ac02"),
        (C.markers_encode, [4, 4, 9, 9, 9], "0200020409"),
        (C.signal_encode, [3, 2, 2, 5], "030001000003"),
        (C.back_refs_encode, [2, 3, 3, 1, 4], "020000040200"),
    ]
    for f, v, want in known:
        assert f(np.array(v, "i8")).hex() == want, (f, v)
    assert E.Ans(np.array([3, 1]), 2, 8).encode(np.array([0, 1])).hex() == "0000000000000559"
    assert T.plain_encode(["a", "", "bc"]).hex() == "03000000" + "010002" + b"abc".hex()
    assert T.front_encode(["ab", "abc", "b"]).hex() == "03000000" + "000200" + "03000000" + "020101" + b"abcb".hex()
    assert repos.sentinel_encode(np.array([5, 9, 9]), ["x", "x", "y"])["lists"].hex() == "0100020001"
    assert C.type_and_time_encode(np.array([2, 15]), np.array([3, 2])).hex() == "02000000" + "26f1" + "01000000" + "0f"
    assert C.delta_rows_encode(*[np.array([1, 3])] * 4).hex() == "02020102" + "04040304"


def test_frames_refuse_what_was_not_written():
    data = frame("id", 3, b"body")
    assert unframe("id", 3, data) == b"body" and len(data) == HEADER.size + 4
    for section, n, bad in [("id", 3, b""), ("id", 3, data[:-1]), ("id", 3, data + b"x"), ("id", 4, data), ("time", 3, data), ("id", 3, b"x" + data[1:]), ("id", 3, data[:-1] + b"x")]:
        with pytest.raises(Malformed):
            unframe(section, n, bad)


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 9, bytes(range(256)) * 3, b"one of the words of the text, " * 900, RNG.integers(0, 256, 5000, "u1").tobytes()], ids=range(6))
def test_context_mixing(data):
    assert mixing_decode(mixing_encode(data)) == data


def test_context_mixing_learns():
    data = "\n".join(f"u{a}/{b}" for a, b in RNG.integers(0, 150, (6000, 2)).tolist()).encode()
    import lzma

    assert len(mixing_encode(data)) < len(lzma.compress(data, preset=9))


FORMS = {k: v for k, v in vars(repos).items() if k.isupper() and isinstance(v, tuple) and callable(v[0])}


@pytest.mark.parametrize("form", sorted(FORMS))
def test_repository_forms(form):
    import random

    rng, f = random.Random(2), FORMS[form]
    owners = ["a", "Bob", "", "é", "x@y", "~q", "OpenAI", "a^b", "$", "n\nl", "z\0w", "back\\slash"]
    for n in (0, 1, 2, 60, 400):
        entries = set()
        for _ in range(n):
            o = rng.choice(owners)
            entries.add((rng.choice((rng.randrange(30), rng.randrange(2**40))), rng.choice([o, f"{o}/{o}", f"{o}/{o}-x", f"{o}/{o}.github.io", f"{o}/x/y", f"{o}/", "plain", "/", f"{o}/TensorFlow", f"{o}/@", f"{o}/~", f"{o}/API", f"{o}/aBC"])))
        entries = sorted(entries)
        if f not in repos.SORTED:
            rng.shuffle(entries)
        ids, names = f[1](f[0](np.array([i for i, _ in entries], "i8"), [x for _, x in entries]), len(entries))
        assert list(zip(np.asarray(ids).tolist(), names, strict=True)) == entries


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aBcZ^$@~\\/.-_é", max_size=12), st.text(alphabet="aBcZ^$@~\\.-_é", max_size=5))
def test_name_transforms_on_anything(rest, owner):
    assert T.unfolded(T.folded(rest)) == rest
    assert T.unmarked(owner, T.marked(owner, rest)) == rest
    code = T.rest_code(owner, rest)
    assert T.rest_from(owner, T.rest_kept(owner, rest, code), code) == rest


def test_searches_find_the_smallest():
    v = RNG.zipf(1.6, 4000) % 5000
    assert len(E.top_k_ans_encode(v)) <= 1.01 * min(len(E.top_k_ans_encode(v, k, b)) for k in E.TOP_K for b in E.SCALE_BITS if k < 1 << b)
    d = RNG.geometric(0.2, 4000) * RNG.choice((-1, 1), 4000)
    limit, bits = E.best_small_limit(d)
    assert len(E.small_delta_encode(d, limit, bits)) <= 1.01 * min(len(E.small_delta_encode(d, k, b)) for k in E.SMALL_LIMITS for b in E.SCALE_BITS)
    s = RNG.integers(0, 4, 6000)
    for i in range(2, 6000):
        if RNG.random() < 0.9:
            s[i] = (s[i - 1] + s[i - 2] * 3) % 4
    assert E.chosen_contexts(s) and len(E.context_ans_encode(s)) < 0.6 * len(E.ans_encode(s))
