"""Media columns: WAV bytes, short-time spectra, and peak-pair fingerprints.

Each text's UTF-8 bytes, padded with spaces to a positive multiple of ``UNIT``,
are stored as 8-bit mono samples of a WAV file, read back with the ``wave``
module, and analysed from the bytes that were read. A fingerprint is an array
of 64-bit codes ``time << 20 | f1 << 13 | f2 << 6 | dt``: the frame of the first
peak, both peaks' frequency bins, and the frames between them.

Defined results
---------------
* null text: as the empty text, so 192 spaces;
* equal texts give equal rows; null or repeated ids are answered row by row;
* empty table: no rows; extra columns: ignored;
* very long text: spectra are made ``BLOCK`` frames at a time.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestql.llm.common import beside

UNIT = 192
RATE = 8000
HOP = 96
BLOCK = 4096
#: Bins of one peak each; bin 0 holds the mean and is left out.
BANDS = ((1, 10), (10, 24), (24, 48), (48, 97))
#: A peak is the strict maximum of its band over so many frames on both sides.
NEAR = 3
FAN_OUT = 3
MAX_DT = 63


def encode_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def decode_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def padded(raw: bytes) -> tuple[bytes, int]:
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return raw.ljust(size, b" "), len(raw)


WINDOW = np.hanning(UNIT + 1)[:UNIT].astype(np.float32)


def band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per frame and band: the strongest bin and its magnitude."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, UNIT)[::HOP]
    bins = np.empty((len(frames), len(BANDS)), np.int64)
    power = np.empty((len(frames), len(BANDS)), np.float32)
    for a in range(0, len(frames), BLOCK):
        part = (frames[a : a + BLOCK].astype(np.float32) - 128.0) * WINDOW
        spectrum = np.abs(np.fft.rfft(part, axis=1)).astype(np.float32)
        for b, (lo, hi) in enumerate(BANDS):
            band = spectrum[:, lo:hi]
            best = band.argmax(axis=1)
            bins[a : a + len(band), b] = best + lo
            power[a : a + len(band), b] = np.take_along_axis(band, best[:, None], 1)[:, 0]
    return bins, power


def fingerprint(samples: np.ndarray) -> np.ndarray:
    bins, power = band_peaks(samples)
    around = np.full((len(power) + 2 * NEAR, power.shape[1]), -1.0, np.float32)
    around[NEAR:-NEAR] = power
    keep = power > 0
    for s in range(2 * NEAR + 1):
        if s != NEAR:
            keep &= power > around[s : s + len(power)]
    t, b = np.nonzero(keep)
    f = bins[t, b]
    codes = []
    for k in range(1, FAN_OUT + 1):
        dt = t[k:] - t[:-k]
        ok = dt <= MAX_DT
        codes.append((t[:-k][ok] << 20) | (f[:-k][ok] << 13) | (f[k:][ok] << 6) | dt[ok])
    return np.sort(np.concatenate(codes)) if codes else np.empty(0, np.int64)


SCHEMA = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long,"
    " media_bytes long, media_sha256 string, fingerprint array<long>"
)


def media_columns(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True
) -> DataFrame:
    """Id, sizes and checksums of what was read back, fingerprint, and the WAV itself."""

    def row(raw: bytes | None) -> tuple:
        payload, n_bytes = padded(raw or b"")
        media = encode_wav(payload)
        back = decode_wav(media)
        out = (
            n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]),
            len(media), hashlib.sha256(media).hexdigest(), fingerprint(np.frombuffer(back, np.uint8)),
        )
        return (*out, media) if keep_media else out

    start = lambda: lambda texts: [list(c) for c in zip(*map(row, texts), strict=True)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = beside(rows, ["doc_id"], ["text"], SCHEMA + ", media binary" * keep_media, start, 512)
    return out.withColumnRenamed("doc_id", id_col)


def media_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; ``feature`` is the number of pairs and a hash of the array, which follows."""
    out = media_columns(docs, keep_media=False)
    feature = F.concat_ws(":", F.size("fingerprint").cast("string"), F.hex(F.xxhash64("fingerprint")))
    return out.select(*[c for c in out.columns if c != "fingerprint"], feature.alias("feature"), "fingerprint")
