"""Media columns: bytes kept as WAV samples, short-time spectra and spectral-peak pair fingerprints.

A payload is stored as 8-bit mono samples of a WAV file and read back by the wave module. Peaks of the short-time
spectrum are paired with the next peaks in time; a pair is stored under the time of its first peak.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from communa.llm.common import map_batches, table, whole_row

RATE = 8000
FRAME, HOP = 256, 128
#: A peak is the largest of its frame's band of this many bins and of its neighbour frames there.
BAND = 16
#: How many later peaks each peak is paired with, and how many frames later they may stand.
FAN, REACH = 3, 8
_WINDOW = np.hanning(FRAME).astype(np.float32)
_CHUNK = 2048


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("one channel of 8-bit samples is expected")
        return w.readframes(w.getnframes())


def padded(text: bytes) -> bytes:
    """Zero bytes are appended up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % 64 or 64 * (not text))


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (frame numbers) and frequencies (bins) of the spectral peaks, in order of time, then frequency.

    Frames are taken in chunks with a frame of overlap at both ends, so memory is bounded for any length."""
    x = np.frombuffer(samples, np.uint8)
    n = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    ts, fs = [], []
    for at in range(0, n, _CHUNK):
        lo, hi = max(0, at - 1), min(n, at + _CHUNK + 1)
        part = np.zeros((hi - lo - 1) * HOP + FRAME, np.float32)
        got = x[lo * HOP : lo * HOP + len(part)]
        part[: len(got)] = got
        part[: len(got)] -= 128
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * _WINDOW
        spectrum = np.fft.rfft(frames, axis=1)[:, : FRAME // 2]
        power = np.round(np.log2(1 + spectrum.real**2 + spectrum.imag**2) * 1024).astype(np.int32).reshape(hi - lo, -1, BAND)
        top = power.max(2)
        around = np.pad(top, ((1, 1), (0, 0)))
        t, band = np.nonzero((top > around[:-2]) & (top >= around[2:]))
        own = (t + lo >= at) & (t + lo < at + _CHUNK)
        t, band = t[own], band[own]
        ts.append(t + lo)
        fs.append(band * BAND + power[t, band].argmax(1))
    return np.concatenate(ts), np.concatenate(fs)


def pairs(t: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Time-coded pairs: time << 32 | first bin << 20 | second bin << 8 | frames between, for later peaks in reach, in order."""
    out = []
    first = np.searchsorted(t, t, "right")
    for k in range(FAN):
        j = first + k
        ok = j < len(t)
        i, j = np.flatnonzero(ok), j[ok]
        ok = t[j] - t[i] <= REACH
        i, j = i[ok], j[ok]
        out.append(t[i].astype(np.int64) << 32 | f[i].astype(np.int64) << 20 | f[j].astype(np.int64) << 8 | (t[j] - t[i]))
    return np.sort(np.concatenate(out))


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_bytes long, media binary): the text's padded UTF-8 bytes as a WAV file, and their number before padding.

    Null text counts as empty: 64 zero samples. A very long text is one file. Repeated rows stay, each with its file; an empty table
    gives no rows; other columns are left out."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or b"" for x in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array([to_wav(padded(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), run, "doc_id long, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """(media binary, ...) -> all columns of ``stored`` but those of these names, and payload binary, times array<int>, bins array<int>,
    pairs array<long>.

    The payload is what the wave module reads back; times and bins are of the spectral peaks, pairs the fingerprint. Null media give null in
    all four. Equal media have equal features; repeated rows stay, very long ones are taken in chunks, an empty table gives no rows."""
    made = ["payload", "times", "bins", "pairs"]
    kinds = (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for x in batch.column(1).to_pylist():
            if x is None:
                rows.append((None,) * 4)
                continue
            payload = from_wav(x)
            t, f = peaks(payload)
            rows.append((payload, t.astype(np.int32), f.astype(np.int32), pairs(t, f)))
        return pa.record_batch([batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], ["row", *made])

    rest = stored.select(*[c for c in stored.columns if c not in made])
    rows = rest.select(whole_row(rest), F.col("media").cast("binary").alias("media"))
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("payload binary, times array<int>, bins array<int>, pairs array<long>").fields])
    return map_batches(rows, run, schema).select("row.*", *made)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored, read back and reduced, and beside the digests the fingerprint: ``times`` of the peaks and their time-coded ``pairs``.
    ``feature`` is the number of peaks, that of pairs and a digest of the pairs. Media never cross a shuffle."""
    found = features(store(table(spark, sf_dir, "documents")))
    said = F.sha2(F.array_join(F.transform("pairs", lambda x: F.hex(x)), ","), 256)
    return found.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("times").cast("string"), F.size("pairs").cast("string"), said).alias("feature"), "times", "pairs",
    )
