"""Media columns: texts as 8-bit sound, short-time spectra, and fingerprints of pairs of peaks."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryproof.llm.common import map_batches, ship, with_fields

ship(__name__)

RATE = 8000


def to_wave(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file of one channel of 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wave(media: bytes) -> bytes:
    """The samples of a WAV file of one channel of 8-bit samples."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("one channel of 8-bit samples is expected")
        return w.readframes(w.getnframes())


def spectral_peaks(samples: bytes, frame: int, hop: int, at_once: int = 8192) -> np.ndarray:
    """The band of the strongest local maximum of each short-time spectrum, -1 where there is none.

    Frames of ``frame`` samples start every ``hop`` samples; only whole frames count. Spectra are made for
    ``at_once`` frames at a time, so a long sound needs no more memory than its samples.
    """
    data = np.frombuffer(samples, np.uint8)
    window = np.hanning(frame).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(data, frame)[::hop] if len(data) >= frame else np.zeros((0, frame), np.uint8)
    bands = np.full(len(frames), -1, np.int64)
    for i in range(0, len(frames), at_once):
        some = (frames[i : i + at_once].astype(np.float32) - 128) * window
        spectrum = np.fft.rfft(some, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        inner = power[:, 1:-1]
        inner = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        best = inner.argmax(1)
        bands[i : i + at_once] = np.where(inner[np.arange(len(best)), best] > 0, best + 1, -1)
    return bands


def fingerprint(samples: bytes, frame: int = 192, hop: int = 96, reach: int = 3) -> np.ndarray:
    """Pairs of peaks up to ``reach`` frames apart, in order: time << 32 | band << 20 | band << 8 | distance."""
    bands = spectral_peaks(samples, frame, hop)
    codes = []
    for distance in range(1, reach + 1):
        a, b = bands[:-distance], bands[distance:]
        time = np.flatnonzero((a >= 0) & (b >= 0))
        codes.append(time << 32 | a[time] << 20 | b[time] << 8 | distance)
    return np.sort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)


def store_as_wave(docs: DataFrame, text: str = "text", unit: int = 192) -> DataFrame:
    """Add ``n_bytes`` and ``media``: whole texts as UTF-8, blanks added up to a positive multiple of
    ``unit``, stored as a WAV file. A null text counts as the empty one. Columns of these names are
    replaced; ``text`` stays. Every row stands alone; nothing is shuffled."""
    names = [c for c in docs.columns if c not in ("n_bytes", "media")]
    kept = docs.select(*(F.col(f"`{c}`") for c in names))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, media = [], []
        for t in batch.column(names.index(text)).to_pylist():
            data = (t or "").encode("utf-8", "surrogatepass")
            sizes.append(len(data))
            media.append(to_wave(data.ljust(max(unit, -(-len(data) // unit) * unit), b" ")))
        columns = [batch.column(i) for i in range(len(names))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], [*names, "n_bytes", "media"])

    return map_batches(kept, run, with_fields(kept.schema, "n_bytes long, media binary"))


def media_features(rows: DataFrame, media: str = "media", **options) -> DataFrame:
    """Read the stored sound back and add its digests and ``fingerprint``, in place of ``media``.

    Adds ``payload_bytes, payload_sha256, tail_crc32`` (the last 16 bytes) of the samples, ``media_bytes,
    media_sha256`` of the stored form, ``fingerprint`` (array of long in order of time) and ``feature``, a
    digest of it. Equal sounds give equal values. A null sound gives nulls. Nothing is shuffled.
    """
    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fingerprint array<long>"
    new = [part.split()[0] for part in added.split(", ")]
    names = [c for c in rows.columns if c != media and c not in new]
    read = rows.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{media}`"))
    schema = with_fields(read.drop(media).schema, added)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in new]
        for sound in batch.column(len(names)):
            stored = sound.as_buffer()
            if stored is None:
                row = [None] * len(new)
            else:
                stored = stored.to_pybytes()
                payload = from_wave(stored)
                codes = fingerprint(payload, **options)
                row = [
                    len(payload),
                    hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-16:]),
                    len(stored),
                    hashlib.sha256(stored).hexdigest(),
                    hashlib.blake2b(codes.astype("<i8").tobytes(), digest_size=16).hexdigest(),
                    codes,
                ]
            for column, value in zip(out, row, strict=True):
                column.append(value)
        columns = [batch.column(i) for i in range(len(names))]
        columns += [pa.array(v, schema_type) for v, schema_type in zip(out, ARROW, strict=True)]
        return pa.RecordBatch.from_arrays(columns, [*names, *new])

    return map_batches(read, run, schema)


ARROW = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
