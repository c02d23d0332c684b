"""Coders and containers: exact round trips over samples and edge cases, and their refusals."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigloom.operators import codecs as c
from sigloom.operators import containers as k
from sigloom.operators import linalg
from sigloom.operators.neighbours import block_predictions, haar
from sigloom.operators.ordered import PrefixModel
from sigloom.sources.images import even_scale, png_bytes, read_png

small = st.lists(st.integers(-300, 300), max_size=80)


@settings(max_examples=40, deadline=None)
@given(small)
def test_round_trips(xs):
    zz = [c.zigzag(x) for x in xs]
    assert [c.unzigzag(z) for z in zz] == xs
    assert c.huffman_decode(c.huffman_encode(zz)) == zz
    assert c.decode_residuals(c.encode_residuals(xs), len(xs)) == xs
    syms = [z % 7 for z in zz]
    assert c.arithmetic_decode(c.arithmetic_encode(syms, 7), len(syms), 7) == syms
    ctx = [i % 3 for i in range(len(syms))]
    assert c.decode_in_contexts(c.encode_in_contexts(syms, ctx, 7), ctx, 7) == syms
    assert c.unpack_indices(c.pack_indices(syms, 3), len(syms), 3) == syms


@settings(max_examples=40, deadline=None)
@given(small)
def test_shifted_and_bucket_codes(xs):
    assert c.decode_shifted(c.encode_shifted(xs, 300, 600), 300) == xs
    assert c.decode_shifted(c.encode_shifted(xs, 255, 510), 255) == [min(255, max(-255, x)) for x in xs]
    assert c.decode_buckets(c.encode_buckets(xs)) == xs


def test_a_million_symbols_take_linear_time():
    from time import process_time

    rng = random.Random(3)
    xs = [int(rng.gauss(0, 9)) for _ in range(1_000_000)]
    began = process_time()
    assert c.unpack_indices(c.pack_indices([x & 15 for x in xs], 4), len(xs), 4) == [x & 15 for x in xs]
    assert c.decode_shifted(c.encode_shifted(xs, 255, 510), 255) == xs
    assert c.decode_buckets(c.encode_buckets(xs)) == xs
    assert process_time() - began < 40


def _written(symbols, shift):
    """A payload written bit by bit, as the format says, with a flat code of its own."""
    symbols = [s + shift for s in symbols]
    size = max(1, (len(set(symbols)) - 1).bit_length())
    used = sorted(set(symbols))
    out, n = bytearray(), max(used) + 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    out += bytes(size if s in used else 0 for s in range(max(used) + 1))
    out += len(symbols).to_bytes(4, "little")
    byte = place = 0
    for s in symbols:
        for i in range(size - 1, -1, -1):
            byte |= (used.index(s) >> i & 1) << place
            place += 1
            if place == 8:
                out.append(byte)
                byte = place = 0
    return bytes(out) + (bytes([byte]) if place else b"")


def test_a_video_written_by_hand():
    """Header, a sound packet of kind 3, an intra frame of kind 1 and a difference of kind 2."""
    import struct

    first = np.full((2, 3), 128)
    blob = b"NXV1" + struct.pack("<IIIHHBBIBBB", 3, 2, 2, 25, 1, 1, 1, 16000, 1, 0, 0)
    packets = [(3, _written([5, -7, 0, 32767], 32768)), (1, _written([0] * 6, 255)), (2, _written([1, -1, 2, -2, 3, -3], 255))]
    blob += b"".join(struct.pack("<BI", kind, len(data)) + data for kind, data in packets) + b"NXVE"
    frames, sound = k.unpack_video(blob)
    assert sound == [5, -2, -2, 32765] and (frames[0] == first).all() and (frames[1] == first + [[1, -1, 2], [-2, 3, -3]]).all()
    assert (k.decode(blob) == first).all() and k.decode(blob, (4, 6)).shape == (4, 6)
    with pytest.raises(ValueError):
        k.unpack_video(blob.replace(b"\x03" + struct.pack("<I", len(packets[0][1])), b"\x09" + struct.pack("<I", len(packets[0][1])), 1))
    with pytest.raises(ValueError):
        k.decode(b"CHYB" + b"0" * 9)


def test_zigzag_order_and_varints():
    assert [c.zigzag(x) for x in (0, -1, 1, -2, 2)] == [0, 1, 2, 3, 4]
    for v in (0, 1, 127, 128, 16383, 16384, 2**40):
        assert c.read_varint(c.varint(v)) == (v, len(c.varint(v)))
    assert len(c.varint(127)) == 1 and len(c.varint(128)) == 2


def test_huffman_bounds():
    rng = random.Random(1)
    for n in (1, 2, 5, 40):
        freq = {s: rng.randint(1, 1000) for s in range(n)}
        total, lengths = sum(freq.values()), c.code_lengths(freq)
        bits = sum(freq[s] * lengths[s] for s in freq)
        entropy = -sum(f * np.log2(f / total) for f in freq.values())
        assert entropy - 1e-9 <= bits <= entropy + total
        assert n == 1 or sum(2.0**-v for v in lengths.values()) == 1
    assert c.code_lengths({5: 3}) == {5: 1}


def test_adaptive_counts_halve():
    m = c.Adaptive(2, limit=8)
    for _ in range(6):
        m.learn(0)
    assert m.counts == [3, 1] and m.total == 4


def test_byte_coders():
    for data in (b"", b"hello" * 20, bytes(range(256)) * 9):
        for encode, decode in {**c.CODERS, **c.EXTRA_CODERS}.values():
            assert decode(encode(data)) == data


def test_budget_container():
    assert k.unpack_small(k.pack_small(b"hello" * 20)) == b"hello" * 20
    noise = random.Random(0).randbytes(20_000)
    with pytest.raises(k.TooLarge):
        k.pack_small(noise)
    assert k.unpack_small(k.pack_small(noise, None)) == noise
    blob = k.pack_small(b"x" * 300)
    for bad in (b"XXXX" + blob[4:], blob[:4] + b"\x01" + blob[5:], blob[:-1], b"AMC1"):
        with pytest.raises(Exception):  # noqa: B017, PT011
            k.unpack_small(bad)
    assert k.kind_of(blob) == "small" and k.kind_of(b"\x89PNG") == "standard" and k.kind_of(b"") == "standard"


SHAPES = [(1, 1), (1, 9), (9, 1), (13, 9), (8, 8), (16, 24)]


def planes(shape, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.indices(shape)
    return [np.full(shape, 7), (3 * x + 5 * y) % 256, (x + y) % 2 * 255, rng.integers(0, 256, shape), np.where((x == 0) & (y == 0), 255, 0)]


@pytest.mark.parametrize("shape", SHAPES)
def test_plane_and_video_containers(shape):
    ps = planes(shape)
    for a, b in zip(ps, k.unpack_planes(k.pack_planes(ps)), strict=True):
        assert (a == b).all()
    audio = [-32768, 32767, -32768, 0, 5]
    frames, sound = k.unpack_video(k.pack_video(ps * 7, audio=audio, gop=6))
    assert all((a == b).all() for a, b in zip(ps * 7, frames, strict=True)) and sound == audio
    for f, blob in ((k.unpack_planes, k.pack_planes(ps)), (k.unpack_video, k.pack_video(ps))):
        with pytest.raises(ValueError, match="cut off"):
            f(blob[:-1])


def test_scalar_modes_equal_planes():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 256, (1, 8, 8))
    preds = block_predictions(v)
    for y in range(8):
        for x in range(8):
            at = lambda dy, dx: int(v[0, y - dy, x - dx]) if y >= dy and x >= dx else 128  # noqa: B023, E731
            for m, p in zip(k.MODES, preds, strict=True):
                assert k.predict(m, at(0, 1), at(1, 0), at(1, 1), at(0, 2), at(2, 0)) == p[0, y, x]


def test_other_containers():
    rng = np.random.default_rng(4)
    grey = rng.integers(0, 256, (12, 10))
    back = k.unpack_svd(k.pack_svd([grey], 10))[0]
    assert back.shape == grey.shape and np.abs(back - grey).mean() < 12
    palette = [(10, 20, 30), (40, 50, 60), (70, 80, 90)]
    idx = rng.integers(0, 3, (7, 5))
    assert (k.unpack_palette(k.pack_palette(idx, palette)) == np.array(palette)[idx]).all()
    out = k.unpack_parametric(k.pack_parametric(idx, palette, np.full(7, 100)))
    assert out.shape == (7, 5, 3) and out[0, 0, 0] == int(0.6 * palette[idx[0, 0]][0] + 40)


def test_png():
    rng = np.random.default_rng(5)
    for shape in ((1, 1, 3), (4, 9, 3)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (read_png(png_bytes(image)) == image).all()
    with pytest.raises(ValueError, match="PNG"):
        read_png(b"GIF89a")
    assert even_scale(541, 0.5) == 270


def test_linear_algebra():
    rng = np.random.default_rng(6)
    v = rng.integers(0, 256, (3, 8, 8))
    assert np.allclose(linalg.idct2(linalg.dct2(v)), v) and np.allclose((haar(v.astype(float)) ** 2).sum(), (v.astype(float) ** 2).sum())
    assert np.allclose(linalg.dct_atoms().T @ linalg.dct_atoms(), np.eye(64))
    near, rest = linalg.integer_rank(v, 3)
    assert (near + rest == v).all() and np.allclose(linalg.rank_energy(v)[:, -1], 1)
    chosen, coef, left = linalg.pursuit(linalg.dct_atoms(), 3.0 * linalg.dct_atoms()[:, 5] - linalg.dct_atoms()[:, 9], 4)
    assert set(chosen) == {5, 9} and np.abs(left).max() < 1e-9
    t = rng.normal(size=(3, 4, 5))
    assert np.allclose(linalg.untrain(linalg.tensor_train(t, 60)), t) and np.allclose(linalg.untucker(*linalg.tucker(t, (3, 4, 5))), t)
    y, x = linalg.plane_features(6, 7)
    assert (linalg.surface_fit(np.rint(50 * x + 20 * y * x).astype(int), 5)[1].shape) == (6, 7)
    best, score = linalg.evolve(lambda p: float(((p - 0.3) ** 2).sum()), 4)
    assert score < 0.2 and best.shape == (4,)
    assert linalg.siren_fit(v[0], steps=40)[1] < linalg.siren_fit(v[0], steps=40)[0]


def test_prefix_model():
    m, seq = PrefixModel(4), [1, 2, 3, 1, 2, 3, 1, 2, 4, 1, 2, 3]
    for i, s in enumerate(seq):
        m.learn(seq[max(0, i - 2) : i], s)
    p = m.predict([1, 2], 5)
    assert max(range(5), key=p.__getitem__) == 3 and sum(p) == pytest.approx(1)
