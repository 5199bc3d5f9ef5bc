"""Media columns: Netpbm and BMP images as numpy arrays, area-resized by integral images, with NPY tiles and difference hashes.

A media column holds a whole image file per row. `features` decodes it, resizes it by areas (each target pixel is the
mean of the source area under it, from an integral image), and gives the samples, an NPY tile and a difference hash.

Defined results: a null medium has null features; a medium that cannot be decoded has null features and its reason in
`error`; a null or empty text becomes one row of zeros; repeated rows give equal rows, as equal media give equal values; an
empty table gives an empty one. Further columns are ignored. Long media are resized by blocks of rows.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches, staged, text_bytes, worker_state

#: Samples in a row of an image that holds a payload.
WIDTH = 64
TILE = (8, 9)
#: Samples whose sums are held at once.
BLOCK = 1 << 18

_TOKEN = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\S+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """8-bit grey samples (rows, columns) as a binary PGM."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_ppm(samples: np.ndarray) -> bytes:
    """8-bit colour samples (rows, columns, 3) as a binary PPM."""
    return b"P6\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey (rows, columns) or colour samples (rows, columns, 3) as an uncompressed BMP."""
    colour = samples.ndim == 3
    h, w = samples.shape[:2]
    rows = np.zeros((h, -(-w * (3 if colour else 1) // 4) * 4), np.uint8)
    rows[:, : w * (3 if colour else 1)] = (samples[..., ::-1] if colour else samples).reshape(h, -1)
    palette = b"" if colour else np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    if not colour:
        palette[:, 3] = 0
        palette = palette.tobytes()
    at = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", at + rows.size, 0, 0, at)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24 if colour else 8, 0, rows.size, 2835, 2835, 0 if colour else 256, 0)
    return head + info + palette + rows[::-1].tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, fields = data[:2], 2, []
    while len(fields) < (2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("the header is cut short")
        fields.append(int(m[1]))
        at = m.end()
    w, h, most = (*fields, 1)[:3]
    if w <= 0 or h <= 0 or not 0 < most < 65536:
        raise ValueError("bad size or maximum")
    depth = 3 if kind in (b"P3", b"P6") else 1
    # The least bytes that so many samples take, before anything is made for them.
    if (h * -(-w // 8) if kind == b"P4" else w * h * depth * (2 if most > 255 and kind in (b"P5", b"P6") else 1)) > len(data) - at:
        raise ValueError("samples are missing")
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        flat = np.array(list(re.sub(rb"\s", b"", body)[: w * h]), np.int64) - 48 if kind == b"P1" else np.array(body.split()[: w * h * depth], np.int64)
    elif kind == b"P4":
        packed = np.frombuffer(data, np.uint8, h * -(-w // 8), at + 1).reshape(h, -1)
        flat = np.unpackbits(packed, axis=1)[:, :w].ravel()
    else:
        flat = np.frombuffer(data, np.uint8 if most < 256 else ">u2", w * h * depth, at + 1)
    if flat.size < w * h * depth:
        raise ValueError("samples are missing")
    if flat.size and (flat.max() > most or flat.min() < 0):
        raise ValueError("a sample is beyond the maximum")
    if kind in (b"P1", b"P4"):
        flat, most = 1 - flat, 1
    if most != 255:
        flat = (flat.astype(np.int64) * 255 + most // 2) // most
    flat = flat.astype(np.uint8)
    return flat.reshape(h, w, 3) if depth == 3 else flat.reshape(h, w)


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("the header is cut short")
    at, size, w, h, _, bits, packed = struct.unpack_from("<I", data, 10) + struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24, 32) or w <= 0 or h == 0:
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    stride = -(-w * bits // 32) * 4
    if stride * abs(h) > len(data):
        raise ValueError("samples are missing")
    rows = np.frombuffer(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)
    rows = rows[::-1] if h > 0 else rows
    if bits > 8:
        return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[..., 2::-1].copy()
    used = struct.unpack_from("<I", data, 46)[0] or 256
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(used, 4)[:, 2::-1]
    grey = (palette == palette[:, :1]).all()
    return palette[:, 0][rows[:, :w]] if grey else palette[rows[:, :w]]


def decode(data: bytes) -> np.ndarray:
    """Netpbm (P1 to P6) or BMP bytes as uint8 samples, (rows, columns) or (rows, columns, 3). ValueError where that fails."""
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(samples: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Means of the areas under each target pixel, by an integral image read at fractional corners.

    Only the integral image's rows at the areas' corners are kept; it is summed block by block of rows.
    """
    h, w = samples.shape[:2]
    rows_at, cols_at = np.linspace(0, h, shape[0] + 1), np.linspace(0, w, shape[1] + 1)
    r0, c0 = np.minimum(rows_at.astype(int), h - 1), np.minimum(cols_at.astype(int), w - 1)
    at_rows, above = np.zeros((shape[0] + 1, w)), np.zeros(w)
    step = max(1, BLOCK // w)
    for top in range(0, h, step):
        some = samples[top : top + step]
        grey = some if some.ndim == 2 else (some.astype(np.uint32) * np.array([299, 587, 114], np.uint32)).sum(2) / 1000.0
        sums = np.vstack([above, grey]).cumsum(axis=0)
        for k in np.flatnonzero((r0 >= top) & (r0 < top + len(grey))):
            r = r0[k] - top
            at_rows[k] = sums[r] + (sums[r + 1] - sums[r]) * (rows_at[k] - r0[k])
        above = sums[-1]
    across = np.concatenate([np.zeros((shape[0] + 1, 1)), np.cumsum(at_rows, axis=1)], axis=1)
    corner = across[:, c0] + (across[:, c0 + 1] - across[:, c0]) * (cols_at - c0)
    return np.diff(np.diff(corner, axis=0), axis=1) / ((h / shape[0]) * (w / shape[1]))


def difference_hash(tile: np.ndarray) -> str:
    """A bit per pair of neighbours in a row: 1 where the left is brighter. 16 hex digits for the 8 x 9 tile."""
    return np.packbits(np.round(tile[:, :-1], 6) > np.round(tile[:, 1:], 6)).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    """An array in the NPY format."""
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def payload_media(docs: DataFrame, fmt: str = "pgm", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8, with bytes 0 up to a positive multiple of width, as an image's samples."""
    bound_batches(docs.sparkSession)
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}[fmt]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("media")
        for b in batches:
            texts = text_bytes(b.column(1))
            media = []
            for t in texts:
                padded = t.ljust(max(1, -(-len(t) // width)) * width, b"\0")
                media.append(encode(np.frombuffer(padded, np.uint8).reshape(-1, width)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def store(media: DataFrame, name: str = "media") -> DataFrame:
    """media written as a table in the shared folder, and read back from there."""
    return staged(media, name)


def features(media: DataFrame, keep: list[str], tile: tuple[int, int] = TILE) -> DataFrame:
    """media: a binary column `media` and the columns to keep. Adds payload_bytes, payload_sha256, tail_crc32 (of the last 64
    samples), media_bytes, media_sha256, feature (difference hash), tile (NPY) and error."""
    bound_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("media")
        for b in batches:
            out = []
            for m in b.column(len(keep)).to_pylist():
                try:
                    samples = None if m is None else decode(m)
                    why = None
                except (ValueError, IndexError, OverflowError, MemoryError, struct.error) as e:
                    samples, why = None, str(e) or type(e).__name__
                stored = (None, None) if m is None else (len(m), hashlib.sha256(m).hexdigest())
                if samples is None:
                    out.append((None, None, None, *stored, None, None, why))
                    continue
                raw = memoryview(np.ascontiguousarray(samples)).cast("B")
                small = area_resize(samples, tile)
                out.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), *stored, difference_hash(small), npy(small.astype(np.float32)), why))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*keep, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile", "error"])

    kept = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep)
    return media.select(*keep, "media").mapInArrow(run, f"{kept}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary, error string")
