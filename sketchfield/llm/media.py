"""Media columns: audio samples in WAV containers, read by the wave module, with fingerprints.

A text's UTF-8 bytes, with bytes 0 up to a positive multiple of 64, become 8-bit mono samples.
They are stored as WAV files in a table of the shared folder, whose bytes are read back; a
short-time Fourier transform gives a magnitude spectrogram, the strongest local maxima of each
frame are its peaks, and each peak is paired with the peaks of the next frames: a fingerprint is the pair of frequencies and their distance in time, with the time of
the first peak, packed in one 64-bit number, so the array is time-coded.  Frames overlap: each
starts a quarter of a frame after the one before, the first with its last quarter on the samples,
and what a frame has beyond either end is silence.  Every sample is in four frames, so the
shortest payload, of 64 bytes, has four frames and fingerprints like any other.

A null or empty text has 64 bytes 0: silence, which has no peaks.  Of neighbouring
bins of equal magnitude the lowest is the maximum, and ties between maxima go to the lower
frequency.  A frame may have fewer maxima than peaks are wanted.  Equal texts give equal values, so repeated rows give
repeated results.  Texts of any length are stored and transformed whole, in blocks of frames.
An empty table gives an empty table.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import map_arrow, record_batch, runs, stored, texts_of

UNIT = 64
RATE = 8000
FRAME = 256
HOP = FRAME // 4
PEAKS = 2  # in each frame
FAN = 2  # later frames that a peak is paired with
_BLOCK = 4096  # frames transformed at once
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload_of(text: str | None) -> bytes:
    data = ("" if text is None else text).encode("utf-8", "surrogatepass")
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """Frequencies of the strongest local maxima in each frame, rising; -1 where there is none."""
    x = np.frombuffer(samples, np.uint8)
    lead = FRAME - HOP  # silence before the samples
    n = max(1, -(-(lead + len(x)) // HOP))
    out = np.full((n, PEAKS), -1, np.int64)
    for start in range(0, n, _BLOCK):
        stop = min(n, start + _BLOCK)
        part = np.zeros((stop - start - 1) * HOP + FRAME, np.float32)
        at = start * HOP - lead  # of the first frame, in the samples
        own = x[max(0, at) : max(0, at + len(part))]
        part[max(0, -at) : max(0, -at) + len(own)] = own
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        first = at + HOP * np.arange(len(frames))
        a, z = np.clip(-first, 0, FRAME), np.clip(len(x) - first, 0, FRAME)
        mean = frames.sum(axis=1) / np.maximum(z - a, 1)
        frames = frames - mean[:, None].astype(np.float32)
        for i in np.flatnonzero((a > 0) | (z < FRAME)):  # at either end: silence is the mean of the samples
            frames[i, : a[i]] = 0
            frames[i, z[i] :] = 0
        frames *= _WINDOW
        size = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32)[:, 1:]
        top = np.ones(size.shape, bool)
        top[:, 1:] &= size[:, 1:] > size[:, :-1]
        top[:, :-1] &= size[:, :-1] >= size[:, 1:]
        size[~top | (size <= 1e-3)] = 0
        best = np.empty((stop - start, PEAKS), np.int64)
        for k in range(PEAKS):  # argmax takes the lowest of equals
            at = size.argmax(axis=1)
            best[:, k] = np.where(size[np.arange(len(size)), at] > 0, at + 1, -1)
            size[np.arange(len(size)), at] = 0
        best.sort(axis=1)
        out[start:stop] = best
    return out


def fingerprints(samples: bytes) -> np.ndarray:
    """time << 24 | first frequency << 16 | second frequency << 8 | distance in time."""
    p = peaks(samples)
    out = []
    for d in range(1, FAN + 1):
        if len(p) <= d:
            break
        a, b = np.repeat(p[:-d], PEAKS, axis=1), np.tile(p[d:], (1, PEAKS))
        t = np.arange(len(p) - d)[:, None]
        out.append(((t << 24) | (a << 16) | (b << 8) | d)[(a >= 0) & (b >= 0)])
    return np.sort(np.concatenate([*out, np.zeros(0, np.int64)]))


def with_media(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes and its payload as a WAV file."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch.column(1))
            n = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]
            return record_batch(
                {"doc_id": (batch.column(0), pa.int64()), "n_bytes": (n, pa.int64()), "media": ([to_wav(payload_of(t)) for t in texts], pa.binary())}
            )

        def sliced(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = [each(batch.slice(a, z - a)) for a, z in runs(texts_of(batch.column(1)), 16_000_000)]
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else each(batch)

        return sliced

    return map_arrow(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text"), make, "doc_id long, n_bytes long, media binary")


def with_fingerprints(media: DataFrame) -> DataFrame:
    """The stored files, their digests, and their fingerprints; ``feature`` is the fingerprint's size and digest."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, prints = [], []
            for x in batch.column(2):
                file = x.as_py()
                back = from_wav(file)
                found = fingerprints(back)
                prints.append(found)
                rows.append(
                    (
                        len(back),
                        hashlib.sha256(back).hexdigest(),
                        zlib.crc32(back[-UNIT:]),
                        len(file),
                        hashlib.sha256(file).hexdigest(),
                        f"{len(found)}:{hashlib.sha256(found.astype('<i8').tobytes()).hexdigest()[:32]}",
                    )
                )
            i64, s = pa.int64(), pa.string()
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            out = {"doc_id": (batch.column(0), i64), "n_bytes": (batch.column(1), i64)} | {c: ([r[k] for r in rows], t) for k, (c, t) in enumerate(zip(names, (i64, s, i64, i64, s, s)))}
            return record_batch(out | {"media": (batch.column(2), pa.binary()), "fingerprint": (prints, pa.list_(i64))})

        return each

    return map_arrow(
        media,
        make,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, fingerprint array<long>",
    )


def media_columns(docs: DataFrame) -> DataFrame:
    """Per document the stored form, its digests, and its fingerprints: the files are written first, and read again."""
    return with_fingerprints(stored(with_media(docs), "media"))
