"""Audio features of byte payloads: polyphase resampling, overlapped log-mel filterbanks, hysteresis energy segmentation.

A text's bytes become the 8-bit samples of a mono WAV file, without loss. The file is read back and resampled from 8 to
6 kHz by a polyphase filter; frames of 24 ms, each half over the next, give log-mel bands. Loud stretches are found with
two thresholds, and the bands are stored as Arrow tensors of one fixed shape, each with its time span.
"""

from __future__ import annotations

import io
import struct
import wave
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_of
from .words import raw_texts

#: Payloads are a positive multiple of UNIT bytes, filled up with FILL.
UNIT, FILL = 576, b"\xff"
#: Samples a second of the file; the filter turns DOWN samples into UP; its taps for each output.
RATE, UP, DOWN, TAPS = 8000, 3, 4, 8
#: Samples between frames after resampling (a frame is two hops), mel bands, frames of a tensor.
HOP, BANDS, TENSOR = 72, 20, 16
#: Thresholds of loudness: a stretch begins above the mean by ON deviations and ends below it by OFF, and by LEVEL decibels
#: at least: a level payload has no loud stretch, however its energy is rounded.
ON, OFF, LEVEL = 0.5, 0.5, 1e-6
#: Zeros between the payloads that are worked on together, so that none reaches into the next.
_GAP = UNIT // 3


def _filters() -> np.ndarray:
    """Windowed-sinc low-pass at the lower rate, one row of taps for each phase."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hanning(n + 2)[1:-1]
    return (h / h.sum() * UP).reshape(TAPS, UP).T.copy()


def _mel() -> np.ndarray:
    """Triangles of BANDS mel bands over the bins of a frame's spectrum."""
    bins = np.fft.rfftfreq(2 * HOP, UP / (DOWN * RATE))
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(bins[-1]), BANDS + 2) / 2595) - 1)
    up = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(np.minimum(up, down), 0)


FILTERS, MEL, WINDOW = _filters(), _mel(), np.hanning(2 * HOP)


def encode_wav(payload: bytes) -> bytes:
    """An 8-bit mono WAV file of the payload's bytes."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def decode_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


def padded(raw: bytes) -> bytes:
    return raw + FILL * (max(-len(raw) % UNIT, 0) if raw else UNIT)


def _resampled(x: np.ndarray) -> np.ndarray:
    """UP/DOWN of the samples (a multiple of DOWN): output n is phase n * DOWN mod UP at input n * DOWN // UP."""
    y = np.empty(len(x) // DOWN * UP)
    x = np.concatenate((np.zeros(TAPS), x))
    m = len(y) // UP
    for r in range(UP):
        at, phase = divmod(r * DOWN, UP)
        y[r::UP] = sum(FILTERS[phase, k] * x[TAPS + at - k :][: DOWN * m : DOWN][:m] for k in range(TAPS))
    return y


#: Frames that are transformed at once; payloads of LONG bytes or more are resampled and framed in windows of so many hops.
FRAMES, LONG, HOPS = 2048, 1 << 20, 4096
#: Bins that each band has weight on.
_BINS = [np.flatnonzero(MEL[:, k]).tolist() for k in range(BANDS)]
#: Bytes of a hop, and bytes before a window that its first output still depends on.
_HOP_BYTES, _LEAD = HOP * DOWN // UP, TAPS


def _described(hops: np.ndarray, at: np.ndarray, bands: np.ndarray, energy: np.ndarray) -> None:
    """Fill bands and energy of the frames that begin at hops[at].

    Sums go bin by bin over many frames, never as a matrix product: a frame's values don't depend on what stands beside it.
    """
    for i in range(0, len(at), FRAMES):
        own = at[i : i + FRAMES]
        spectrum = np.fft.rfft(np.concatenate((hops[own], hops[own + 1]), axis=1) * WINDOW)
        power = np.ascontiguousarray((spectrum.real**2 + spectrum.imag**2).T)
        for k, bins in enumerate(_BINS):
            total = np.full(len(own), 1e-6)
            for j in bins:
                total += power[j] * MEL[j, k]
            bands[i : i + FRAMES, k] = np.log(total)
        total = np.full(len(own), 1e-6)
        for row in power:
            total += row
        energy[i : i + FRAMES] = 10 * np.log10(total)


def _samples(raw: bytes | memoryview) -> np.ndarray:
    return (np.frombuffer(raw, np.uint8) - 128.0) / 128.0


def log_mel(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bands and energy of every frame of the payloads, and each payload's first frame (one more at the end)."""
    n_hops = np.array([len(p) // _HOP_BYTES for p in payloads])
    first = np.r_[0, np.cumsum(n_hops - 1)]
    bands, energy = np.empty((first[-1], BANDS), np.float32), np.empty(first[-1])
    if len(payloads) == 1 and len(payloads[0]) >= LONG:
        whole = memoryview(payloads[0])
        for h in range(0, int(n_hops[0]) - 1, HOPS):
            last = min(h + HOPS + 1, int(n_hops[0]))
            lead = _LEAD if h else 0
            part = _resampled(_samples(whole[h * _HOP_BYTES - lead : last * _HOP_BYTES]))[lead * UP // DOWN :].reshape(-1, HOP)
            _described(part, np.arange(len(part) - 1), bands[h : last - 1], energy[h : last - 1])
        return bands, energy, first
    hops = _resampled(np.concatenate([part for p in payloads for part in (_samples(p), np.zeros(_GAP))])).reshape(-1, HOP)
    gap = _GAP // _HOP_BYTES
    start = np.cumsum(n_hops + gap) - n_hops - gap
    _described(hops, np.repeat(start - first[:-1], n_hops - 1) + np.arange(first[-1]), bands, energy)
    return bands, energy, first


def loud(energy: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a frame is in a loud stretch: on above the upper threshold, off below the lower, else as before."""
    size = np.diff(first)
    mean = np.repeat(np.add.reduceat(energy, first[:-1]) / size, size)
    dev = np.repeat(np.sqrt(np.add.reduceat((energy - mean) ** 2, first[:-1]) / size), size)
    up, down = energy > mean + ON * dev + LEVEL, energy < mean - OFF * dev - LEVEL
    event = up | down
    event[first[:-1]] = True
    last = np.maximum.accumulate(np.where(event, np.arange(len(energy)), 0))
    return up[last]


#: Milliseconds of a hop.
HOP_MS = 1000 * HOP * DOWN // (UP * RATE)


def _spans(on: np.ndarray) -> list[dict[str, int]]:
    """Runs of loud frames in milliseconds."""
    edge = np.flatnonzero(np.diff(on.astype(np.int8), prepend=0, append=0))
    return [{"start_ms": a * HOP_MS, "end_ms": (b + 1) * HOP_MS} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


_SHAPE = pa.fixed_shape_tensor(pa.float32(), (TENSOR, BANDS))
_STREAM = pa.schema([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("log_mel", _SHAPE)])
_HEAD, _END = _STREAM.serialize().to_pybytes(), b"\xff\xff\xff\xff\0\0\0\0"


def tensors(bands: np.ndarray) -> bytes:
    """Arrow stream of a payload's bands: start_ms, end_ms and a float32 tensor of TENSOR x BANDS, the last one filled with the floor."""
    n = -(-len(bands) // TENSOR)
    full = np.full((n * TENSOR, BANDS), np.log(1e-6), np.float32)
    full[: len(bands)] = bands
    start = np.arange(n, dtype=np.int64) * (TENSOR * HOP_MS)
    end = np.minimum(start + (TENSOR + 1) * HOP_MS, (len(bands) + 1) * HOP_MS)
    stored = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), TENSOR * BANDS)
    batch = pa.RecordBatch.from_arrays([pa.array(start), pa.array(end), pa.ExtensionArray.from_storage(_SHAPE, stored)], schema=_STREAM)
    return b"".join((_HEAD, batch.serialize(), _END))


def read_tensors(stream: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(stream).read_next_batch()


_MEDIA = "doc_id {id}, n_bytes long, media binary, segments array<struct<start_ms: long, end_ms: long>>, tensors binary"


def audio(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (a WAV file), segments (time spans of loud stretches) and tensors (an Arrow stream) of every row of docs.

    A null or empty text is one unit of fill. Whole texts are stored, equal texts give equal values to the last bit,
    whatever stands beside them; repeated rows are repeated, keys may be null, no rows give none, other columns are not
    read. A long text is worked on by itself, in windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
        for b in batches:
            sizes = pc.coalesce(pc.binary_length(b.column(1)), 0).to_pylist()
            i = 0
            while i < b.num_rows:
                j, size = i + 1, sizes[i]
                while j < b.num_rows and size + sizes[j] < LONG:
                    size += sizes[j]
                    j += 1
                media = [encode_wav(padded(x)) for x in raw_texts(b.column(1).slice(i, j - i))]
                bands, energy, first = log_mel([decode_wav(m) for m in media])
                on = loud(energy, first)
                cuts = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(sizes[i:j], pa.int64()), pa.array(media, pa.binary()), pa.array([_spans(on[a:e]) for a, e in cuts], spans), pa.array([tensors(bands[a:e]) for a, e in cuts], pa.binary())],
                    names=["doc_id", "n_bytes", "media", "segments", "tensors"],
                )
                i = j

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, _MEDIA.format(id=kind))


def _feature(stream: bytes, segments: list[dict[str, int]]) -> str:
    """Frames' span, number and length of loud stretches, and the mean of each band in tenths."""
    t = read_tensors(stream)
    end = t.column(1)[-1].as_py()
    frames = t.column(2).storage.flatten().to_numpy().reshape(-1, BANDS)[: end // HOP_MS - 1]
    mean = np.round(10 * frames.mean(axis=0, dtype=np.float64)).astype(int)
    return f"ms={end};loud={len(segments)}/{sum(s['end_ms'] - s['start_ms'] for s in segments)};mel={','.join(map(str, mean.tolist()))}"


def digests(media: DataFrame) -> DataFrame:
    """Digest columns of audio()'s rows, from the stored bytes: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column(2).to_pylist()
            read = [decode_wav(m) for m in files]
            features = [_feature(t, s) for t, s in zip(b.column(4).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(p) for p in read], pa.int64()), pa.array([sha256(p).hexdigest() for p in read]), pa.array([zlib.crc32(p[-32:]) for p in read], pa.int64()), pa.array([len(m) for m in files], pa.int64()), pa.array([sha256(m).hexdigest() for m in files]), pa.array(features)],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
