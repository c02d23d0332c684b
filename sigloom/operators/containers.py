"""Container formats: build, parse, and tell apart by their first bytes."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np

from sigloom.operators.codecs import CODERS, decode_residuals, decode_shifted, encode_residuals, encode_shifted, pack_indices, unpack_indices
from sigloom.operators.fields import resize
from sigloom.operators.neighbours import block_predictions
from sigloom.sources.images import read_png

BUDGET = 1024
#: First bytes -> kind.
MAGIC = {b"PRSM": "planes", b"NXV1": "video", b"AMC1": "small", b"SVD1": "svd", b"CPAL": "palette", b"CHYB": "hybrid", b"CPAR": "parametric"}
MODES = ("left", "above", "gradient", "paeth", "average", "edge_adaptive", "median3", "extrapolate", "weighted_grad")


class TooLarge(ValueError):
    """No coder brings the blob into the budget."""


def kind_of(blob: bytes) -> str:
    return MAGIC.get(bytes(blob[:4]), "standard")


def pack_small(payload: bytes, budget: int | None = BUDGET) -> bytes:
    """The smallest container over the general coders, the first of equals; raises TooLarge beyond the budget."""
    digest = hashlib.sha256(payload).hexdigest()
    made = []
    for rank, (name, (encode, _)) in enumerate(CODERS.items()):
        body = encode(payload)
        meta = json.dumps({"algo": name, "sha256": digest, "size": len(payload)}, separators=(",", ":")).encode()
        made.append((len(meta) + len(body), rank, b"AMC1\x00" + struct.pack(">H", len(meta)) + meta + body))
    best = min(made)[2]
    if budget is not None and len(best) > budget:
        raise TooLarge(f"{len(best)} bytes; the budget is {budget}")
    return best


def unpack_small(blob: bytes) -> bytes:
    if blob[:4] != b"AMC1" or len(blob) < 7:
        raise ValueError("not such a container")
    if blob[4] != 0:
        raise ValueError("only embedded payloads are read")
    (n,) = struct.unpack(">H", blob[5:7])
    meta = json.loads(blob[7 : 7 + n])
    payload = CODERS[meta["algo"]][1](blob[7 + n :])
    if len(payload) != meta["size"] or hashlib.sha256(payload).hexdigest() != meta["sha256"]:
        raise ValueError("the payload isn't the one that was packed")
    return payload


def pack_planes(planes: list[np.ndarray], block: int = 8) -> bytes:
    """Integer planes as chosen modes per block and coded residuals (F01). The modes are those of W02, named in the file."""
    h, w = planes[0].shape
    out = bytearray(b"PRSM" + struct.pack("<BIIBB", 1, w, h, block, len(planes)))
    for plane in planes:
        preds = [p[0] for p in block_predictions(plane[None].astype(np.int64))]
        grid = np.zeros((-(-h // block), -(-w // block)), np.uint8)
        residual = np.zeros_like(plane, dtype=np.int64)
        for by in range(grid.shape[0]):
            for bx in range(grid.shape[1]):
                at = np.s_[by * block : (by + 1) * block, bx * block : (bx + 1) * block]
                costs = [np.abs(plane[at] - p[at]).sum() for p in preds]
                grid[by, bx] = k = int(np.argmin(costs))
                residual[at] = plane[at] - preds[k][at]
        out += bytes([len(MODES)]) + b"".join(bytes([len(m)]) + m.encode() for m in MODES) + struct.pack("<HH", *grid.shape)
        modes, data = zlib.compress(grid.tobytes(), 9), encode_residuals(residual.ravel().tolist())
        out += struct.pack("<I", len(modes)) + modes + struct.pack("<II", plane.size, len(data)) + data
    return bytes(out + b"PRSE")


def unpack_planes(blob: bytes) -> list[np.ndarray]:
    if blob[:4] != b"PRSM" or blob[-4:] != b"PRSE":
        raise ValueError("not such a container, or cut off")
    version, w, h, block, n = struct.unpack("<BIIBB", blob[4:15])
    if version != 1:
        raise ValueError(f"version {version}")
    at, planes = 15, []
    for _ in range(n):
        k, at = blob[at], at + 1
        names = []
        for _ in range(k):
            names.append(blob[at + 1 : at + 1 + blob[at]].decode())
            at += 1 + blob[at]
        gh, gw, size = struct.unpack("<HHI", blob[at : at + 8])
        grid = np.frombuffer(zlib.decompress(blob[at + 8 : at + 8 + size]), np.uint8).reshape(gh, gw)
        at += 8 + size
        count, size = struct.unpack("<II", blob[at : at + 8])
        residual = np.array(decode_residuals(blob[at + 8 : at + 8 + size], count), np.int64).reshape(h, w)
        at += 8 + size
        planes.append(_rebuild(residual, grid, names, block))
    return planes


def _rebuild(residual: np.ndarray, grid: np.ndarray, names: list[str], block: int, border: int = 128) -> np.ndarray:
    """Block by block and pixel by pixel, from what is rebuilt already (W03, M03). Blocks run in raster order; a mode reaches left and up only."""
    h, w = residual.shape
    out = np.zeros((h, w), np.int64)
    for y in range(h):
        for x in range(w):
            get = lambda dy, dx: int(out[y - dy, x - dx]) if y >= dy and x >= dx else border  # noqa: B023, E731
            out[y, x] = residual[y, x] + predict(names[grid[y // block, x // block]], get(0, 1), get(1, 0), get(1, 1), get(0, 2), get(2, 0))
    return out


def predict(mode: str, left: int, above: int, ul: int, left2: int, above2: int) -> int:
    """One sample of a mode of W02."""
    gradient, across, down = left + above - ul, abs(above - ul), abs(left - ul)
    if mode == "left":
        return left
    if mode == "above":
        return above
    if mode == "gradient":
        return gradient
    if mode == "paeth":
        return min((across, 0, left), (down, 1, above), (abs(gradient - ul), 2, ul))[2]
    if mode == "average":
        return (left + above + 1) >> 1
    if mode == "edge_adaptive":
        return above if across > down + 4 else left if down > across + 4 else gradient
    if mode == "median3":
        return sorted((left, above, gradient))[1]
    if mode == "extrapolate":
        return 2 * left - left2 if abs(left - left2) < abs(above - above2) else 2 * above - above2
    wl, wa = 1.0 / (down + 1), 1.0 / (across + 1)
    return round((left * wl + above * wa) / (wl + wa))


def _to_bytes(a: np.ndarray) -> tuple[float, float, bytes]:
    low, high = float(a.min()), float(a.max())
    return low, high, ((a - low) / (high - low or 1.0) * 255).astype(np.uint8).tobytes()


def _from_bytes(data: bytes, low: float, high: float) -> np.ndarray:
    return np.frombuffer(data, np.uint8) / 255 * (high - low or 1.0) + low


def pack_svd(planes: list[np.ndarray], rank: int) -> bytes:
    """Planes as singular triples, vectors in bytes."""
    h, w = planes[0].shape
    body = bytearray()
    for p in planes:
        u, s, vt = np.linalg.svd(p.astype(float), full_matrices=False)
        k = min(rank, len(s))
        for part in (u[:, :k], vt[:k]):
            low, high, data = _to_bytes(part)
            body += struct.pack("<ff", low, high) + data
        body += s[:k].astype("<f4").tobytes()
    return struct.pack("<4sHHHBB", b"SVD1", w, h, min(rank, h, w), len(planes), 0) + zlib.compress(bytes(body), 9)


def unpack_svd(blob: bytes) -> list[np.ndarray]:
    _, w, h, k, n, _ = struct.unpack("<4sHHHBB", blob[:12])
    body, at, out = zlib.decompress(blob[12:]), 0, []
    for _ in range(n):
        parts = []
        for size in (h * k, k * w):
            low, high = struct.unpack("<ff", body[at : at + 8])
            parts.append(_from_bytes(body[at + 8 : at + 8 + size], low, high))
            at += 8 + size
        s = np.frombuffer(body[at : at + 4 * k], "<f4")
        at += 4 * k
        out.append(np.clip(np.rint(parts[0].reshape(h, k) * s @ parts[1].reshape(k, w)), 0, 255).astype(int))
    return out


def pack_palette(indices: np.ndarray, palette: list[tuple[int, int, int]]) -> bytes:
    """Colour indices of an image and its palette."""
    bits = max(1, (len(palette) - 1).bit_length())
    head = struct.pack("<4sHHBB", b"CPAL", indices.shape[1], indices.shape[0], len(palette) - 1, bits)
    return head + bytes(v for c in palette for v in c) + zlib.compress(pack_indices(indices.ravel().tolist(), bits), 9)


def unpack_palette(blob: bytes) -> np.ndarray:
    _, w, h, last, bits = struct.unpack("<4sHHBB", blob[:10])
    n = 3 * (last + 1)
    colours = np.frombuffer(blob[10 : 10 + n], np.uint8).reshape(-1, 3)
    return colours[np.array(unpack_indices(zlib.decompress(blob[10 + n :]), w * h, bits), int)].reshape(h, w, 3)


def pack_parametric(labels: np.ndarray, colours: list[tuple[int, int, int]], row_means: np.ndarray) -> bytes:
    """A coarse grid of colour labels and row means (F07); decoded as 60 parts colour and 40 parts row mean."""
    body = zlib.compress(bytes(labels.astype(np.uint8).ravel()), 9)
    return struct.pack("<4sBBH", b"CPAR", len(colours), labels.shape[1], labels.shape[0]) + bytes(v for c in colours for v in c) + row_means.astype(np.uint8).tobytes() + body


def unpack_parametric(blob: bytes) -> np.ndarray:
    _, k, w, h = struct.unpack("<4sBBH", blob[:8])
    colours = np.frombuffer(blob[8 : 8 + 3 * k], np.uint8).reshape(k, 3)
    means = np.frombuffer(blob[8 + 3 * k : 8 + 3 * k + h], np.uint8)
    labels = np.frombuffer(zlib.decompress(blob[8 + 3 * k + h :]), np.uint8).reshape(h, w)
    return np.clip(0.6 * colours[labels] + 0.4 * means[:, None, None], 0, 255).astype(np.uint8)


#: Kinds of a video's packets, and how far signed values of frames and of sound are shifted for coding.
INTRA, INTER, SOUND = 1, 2, 3
FRAME_SHIFT, SOUND_SHIFT = 255, 32768


def pack_video(frames: list[np.ndarray], fps: tuple[int, int] = (25, 1), audio: list[int] | None = None, gop: int = 30, rate: int = 16_000) -> bytes:
    """Grey frames, intra every `gop`, else differences, and 16-bit audio as wrapped differences, all in shifted Huffman code."""
    h, w = frames[0].shape if frames else (0, 0)
    audio = audio or []
    out = bytearray(b"NXV1" + struct.pack("<IIIHHBBIBBB", w, h, len(frames), *fps, 1, bool(audio), rate if audio else 0, bool(audio), 0, 0))
    steps = [((b - a + 32768) & 65535) - 32768 for a, b in zip([0, *audio], audio, strict=False)]
    packets = [(SOUND, encode_shifted(steps, SOUND_SHIFT, 65535))] if audio else []
    for i, f in enumerate(frames):
        kind, r = (INTRA, _causal(f.astype(np.int64), False)) if i % gop == 0 else (INTER, f.astype(int) - frames[i - 1])
        packets.append((kind, encode_shifted(r.ravel().tolist(), FRAME_SHIFT, 510)))
    for kind, data in packets:
        out += struct.pack("<BI", kind, len(data)) + data
    return bytes(out + b"NXVE")


def unpack_video(blob: bytes) -> tuple[list[np.ndarray], list[int]]:
    if blob[:4] != b"NXV1" or blob[-4:] != b"NXVE":
        raise ValueError("not such a container, or cut off")
    w, h, *_ = struct.unpack("<IIIHHBBIBBB", blob[4:29])
    at, frames, audio = 29, [], []
    while at < len(blob) - 4:
        kind, size = struct.unpack("<BI", blob[at : at + 5])
        data = blob[at + 5 : at + 5 + size]
        at += 5 + size
        if kind == SOUND:
            v = 0
            for d in decode_shifted(data, SOUND_SHIFT):
                v = ((v + d + 32768) & 65535) - 32768
                audio.append(v)
        elif kind in (INTRA, INTER):
            r = np.array(decode_shifted(data, FRAME_SHIFT), np.int64).reshape(h, w)
            frames.append(np.clip(_causal(r, True) if kind == INTRA else frames[-1] + r, 0, 255))
        else:
            raise ValueError(f"a packet of kind {kind}")
    return frames, audio


def decode(blob: bytes, shape: tuple[int, int] | None = None) -> np.ndarray:
    """The first plane of an artifact of any kind, told apart by its first bytes, brought to shape by its nearest samples.

    Small containers hold an artifact, which is decoded in turn; what isn't one of ours must be a PNG, of which the first channel counts.
    """
    kind = kind_of(blob)
    if kind == "small":
        return decode(unpack_small(blob), shape)
    if kind == "planes":
        plane = unpack_planes(blob)[0]
    elif kind == "video":
        plane = unpack_video(blob)[0][0]
    elif kind == "svd":
        plane = unpack_svd(blob)[0]
    elif kind == "palette":
        plane = unpack_palette(blob)[:, :, 0]
    elif kind == "parametric":
        plane = unpack_parametric(blob)[:, :, 0]
    elif kind == "standard":
        plane = read_png(blob)[:, :, 0]
    else:
        raise ValueError(f"{kind} containers aren't decoded")
    return plane.astype(np.int64) if shape is None or plane.shape == shape else resize(plane.astype(np.int64), *shape)


def _causal(plane: np.ndarray, back: bool, decay: float = 0.998) -> np.ndarray:
    """Residuals of a frame, or with `back` the frame of residuals (O01): each pixel by the mode of least decayed squared error so far."""
    h, w = plane.shape
    out, frame = np.zeros_like(plane), plane if not back else np.zeros_like(plane)
    errors = [1.0] * 6
    for y in range(h):
        for x in range(w):
            left = int(frame[y, x - 1]) if x else 128
            above = int(frame[y - 1, x]) if y else 128
            inner = x > 0 and y > 0
            diag = int(frame[y - 1, x - 1]) if inner else 0
            near = min((abs(above - diag), 0, left), (abs(left - diag), 1, above), (abs(left + above - 2 * diag), 2, diag))[2]
            steep = (above + left - diag) if abs(left - diag) > abs(above - diag) else (left + above - diag)
            modes = (left, above, diag if inner else left, near, max(0, min(255, steep)) if inner else near, (left + above + 1) >> 1)
            best = modes[min(range(6), key=lambda m: (errors[m], m))]
            if back:
                frame[y, x] = plane[y, x] + best
            else:
                out[y, x] = plane[y, x] - best
            v = int(frame[y, x])
            errors = [e * decay + (v - p) ** 2 for e, p in zip(errors, modes, strict=True)]
    return frame if back else out
