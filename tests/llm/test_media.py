import hashlib
import io
import wave
import zlib

import numpy as np

from queryproof.llm import media
from queryproof.llm.queries import QUERIES
from tests.conftest import SMALL


def check(text, row):
    data = (text or "").encode()
    payload = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
    assert (row.n_bytes, row.payload_bytes) == (len(data), len(payload))
    assert row.payload_sha256 == hashlib.sha256(payload).hexdigest()
    assert row.tail_crc32 == zlib.crc32(payload[-16:])
    stored = media.to_wave(payload)
    assert (row.media_bytes, row.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    with wave.open(io.BytesIO(stored)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, payload)


def test_query_round_trip_of_every_text(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op6_wave_media"](spark, SMALL).collect()
    assert len(got) == len(rows)
    features = {}
    for r in got:
        check(rows[r.doc_id], r)
        assert features.setdefault(rows[r.doc_id], r.feature) == r.feature
    assert len(set(features.values())) > 0.9 * len(features)


def brute_bands(samples, frame, hop):
    out = []
    for i in range(0, len(samples) - frame + 1, hop):
        x = (np.frombuffer(samples[i : i + frame], np.uint8).astype(float) - 128) * np.hanning(frame)
        power = np.abs([np.sum(x * np.exp(-2j * np.pi * k * np.arange(frame) / frame)) for k in range(frame // 2 + 1)])
        peaks = [k for k in range(1, frame // 2) if power[k] > power[k - 1] and power[k] >= power[k + 1]]
        out.append(max(peaks, key=lambda k: power[k], default=-1))
    return out


def test_peaks_and_pairs():
    t = np.arange(192 * 20)
    tone = (128 + 60 * np.sin(2 * np.pi * 12 * t / 192) + 20 * np.sin(2 * np.pi * 40 * t / 192)).astype(np.uint8).tobytes()
    assert (media.spectral_peaks(tone, 192, 96) == 12).all()
    text = ("The quick brown fox jumps over the lazy dog. " * 40).encode().ljust(1920, b" ")
    bands = media.spectral_peaks(text, 192, 96, at_once=7)
    assert bands.tolist() == brute_bands(text, 192, 96)
    want = sorted(i << 32 | int(bands[i]) << 20 | int(bands[i + d]) << 8 | d for d in (1, 2, 3) for i in range(len(bands) - d) if bands[i] >= 0 <= bands[i + d])
    assert media.fingerprint(text).tolist() == want
    later = media.fingerprint(b"\x80" * 960 + tone)
    assert {c & 0xFFFFFFFF for c in media.fingerprint(tone).tolist()} <= {c & 0xFFFFFFFF for c in later.tolist()}
    assert media.fingerprint(b"\x80" * 10).tolist() == [] == media.fingerprint(b"\x80" * 192 * 4).tolist()


def test_edges_of_the_input(spark, rows_of):
    texts = [None, "", "ä" * 96, "x" * 192, "x" * 193, "long " * 200_000, "", "\x00"]
    df = rows_of("doc_id long, text string, feature string", [(i, t, "old") for i, t in enumerate(texts)])
    out = media.media_features(media.store_as_wave(df))
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        check(t, got[i])
    assert got[0].feature == got[1].feature == got[6].feature and len(got) == len(texts)
    assert set(df.columns) - {"media"} <= set(out.columns)
    assert media.media_features(media.store_as_wave(df.limit(0))).collect() == []
    none = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert [(r.payload_bytes, r.feature) for r in media.media_features(none).collect()] == [(None, None)]
