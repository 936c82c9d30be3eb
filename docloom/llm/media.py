"""Audio features of texts kept as sound.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are
the 8-bit samples of a mono WAV file. The file is parsed again and features come
from what was read: polyphase resampling from 24 to 16 kHz, overlapped log-mel
filterbanks (25 ms frames each 10 ms), and segments of raised energy found with
two thresholds (hysteresis). Log-mel frames are stored as fixed-shape Arrow
tensors of PATCH frames by MELS bands, zero-filled at the end, with the time
span of each.

Null and empty texts become 64 zero bytes. Equal texts give equal values: each
text is computed alone. Long signals are framed in blocks of bounded size. Only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import groups, map_arrow, record_batch

UNIT = 64
RATE_IN, RATE, UP, DOWN, TAPS = 24_000, 16_000, 2, 3, 24
FRAME, HOP, FFT, MELS, PATCH = 400, 160, 512, 40, 32
BLOCK = 1 << 14
RAISE, FALL = 0.6, 0.2  # in deviations above the mean log energy


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode()
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def to_wav(payload: bytes) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE_IN, RATE_IN, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(media: bytes) -> bytes:
    """The samples of the first data chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@cache
def phases() -> np.ndarray:
    """TAPS x UP matrix: column p has the filter that makes output UP * k + p from the samples around DOWN * k."""
    at = np.arange(TAPS) - TAPS // 2 + 1
    cutoff = min(1.0, UP / DOWN)
    out = np.empty((TAPS, UP))
    for p in range(UP):
        x = at - p * DOWN / UP
        taper = np.cos(np.pi * np.clip(x / (TAPS + 2), -0.5, 0.5)) ** 2
        out[:, p] = cutoff * np.sinc(cutoff * x) * taper
    return (out / out.sum(0)).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    n = -(-len(x) // DOWN)
    padded = np.zeros(n * DOWN + TAPS, np.float32)
    padded[TAPS // 2 - 1 : TAPS // 2 - 1 + len(x)] = x
    windows = sliding_window_view(padded, TAPS)[::DOWN][:n]
    return np.concatenate([(windows[k : k + BLOCK] @ phases()).ravel() for k in range(0, n, BLOCK)])


@cache
def filterbank() -> np.ndarray:
    mel = lambda hz: 2595 * np.log10(1 + np.asarray(hz) / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(RATE / 2), MELS + 2) / 2595) - 1)
    hz = np.arange(FFT // 2 + 1) * RATE / FFT
    up = (hz[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - hz[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


@cache
def taper() -> np.ndarray:
    return np.hanning(FRAME + 1)[:FRAME].astype(np.float32)


def log_mel(y: np.ndarray) -> np.ndarray:
    n = max(1, 1 + -(-(len(y) - FRAME) // HOP))
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: len(y)] = y[: len(padded)]
    frames = sliding_window_view(padded, FRAME)[::HOP]
    parts = []
    for k in range(0, n, BLOCK // 8):
        power = np.abs(np.fft.rfft(frames[k : k + BLOCK // 8] * taper(), FFT)) ** 2
        parts.append(np.log10(power.astype(np.float32) @ filterbank() + np.float32(1e-6)))
    return np.concatenate(parts)


def spans(mel: np.ndarray) -> list[tuple[float, float]]:
    """(begin, end) in seconds of runs that rise over the upper threshold, each from and to the lower one."""
    energy = mel.mean(1, dtype=np.float64)
    level, spread = energy.mean(), energy.std()
    if spread < 1e-9:
        return []
    low, high = energy > level + FALL * spread, energy > level + RAISE * spread
    edges = np.flatnonzero(np.diff(np.concatenate([[0], low.astype(np.int8), [0]])))
    tops = np.concatenate([[0], np.cumsum(high)])
    return [(a * HOP / RATE, (b - 1) * HOP / RATE + FRAME / RATE) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if tops[b] > tops[a]]


def patches(mel: np.ndarray) -> np.ndarray:
    """Patches x PATCH x MELS."""
    n = -(-len(mel) // PATCH)
    out = np.zeros((n * PATCH, MELS), np.float32)
    out[: len(mel)] = mel
    return out.reshape(n, PATCH, MELS)


def analyse(samples: bytes) -> tuple[np.ndarray, list[tuple[float, float]], int]:
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - np.float32(128)) / np.float32(128)
    mel = log_mel(resample(x))
    return patches(mel), spans(mel), len(mel)


def tensors(blocks: np.ndarray) -> bytes:
    """An Arrow stream with the column `mel` of fixed-shape tensors and the time span of each."""
    begin = np.arange(len(blocks)) * PATCH * HOP / RATE
    mel = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(blocks))
    batch = pa.RecordBatch.from_arrays([mel, pa.array(begin), pa.array(begin + ((PATCH - 1) * HOP + FRAME) / RATE)], names=["mel", "begin_s", "end_s"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def audio_features(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text, media (the WAV file), its frames, tensors (an Arrow stream) and segments (time spans) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in groups(batches):
            payloads = [payload_of(t) for t in texts]
            media = [to_wav(p) for p, _ in payloads]
            got = [analyse(from_wav(m)) for m in media]
            segments = [[{"begin_s": a, "end_s": b} for a, b in g[1]] for g in got]
            span = pa.struct([("begin_s", pa.float64()), ("end_s", pa.float64())])
            yield record_batch({"doc_id": part.column(0), "n_bytes": [n for _, n in payloads], "media": media, "frames": [g[2] for g in got], "tensors": [tensors(g[0]) for g in got], "segments": segments}, {"doc_id": pa.int64(), "n_bytes": pa.int64(), "media": pa.binary(), "frames": pa.int64(), "tensors": pa.binary(), "segments": pa.list_(span)})

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, media binary, frames long, tensors binary, segments array<struct<begin_s double, end_s double>>")


def audio_digests(docs: DataFrame) -> DataFrame:
    """Sizes and digests of the rows of audio_features, read back; `feature` names frames, segments, the first of them, and a checksum of the quantised tensors."""
    types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def one(n: int, media: bytes, frames: int, stored: bytes, found: list[dict]) -> tuple:
        back = from_wav(media)
        blocks = pa.ipc.open_stream(stored).read_all().column("mel").combine_chunks().to_numpy_ndarray()
        quantised = np.rint(blocks * 16).astype(np.int16)
        first = "-".join(f"{found[0][k]:.3f}" for k in ("begin_s", "end_s")) if found else "none"
        feature = f"frames={frames};patches={len(blocks)};segments={len(found)};first={first};voiced={sum(s['end_s'] - s['begin_s'] for s in found):.3f};mel={zlib.crc32(quantised.tobytes()):08x}"
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (batch.slice(i, 1) for i in range(batch.num_rows))
            columns = zip(*(one(*(r.column(k)[0].as_py() for k in range(1, 6))) for r in rows), strict=True)
            yield record_batch(dict(zip(types, [batch.column(0), *columns], strict=True)), types)

    return map_arrow(audio_features(docs), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
