"""Audio columns: 8-bit PCM stored as WAV bytes, read back into log-mel tensors of a fixed shape with time spans.

Samples pass a polyphase resampler (windowed-sinc filter, one dot product per output sample), overlapped frames give
log-mel energies, and hysteresis on frame energy (a segment starts above the high threshold and lasts while above the low
one) gives the active spans. All work is per clip, so equal clips give equal values wherever they are computed.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, saved

RATE, UP, DOWN, TAPS = 8000, 3, 4, 16
FRAME, HOP, MELS, PATCH = 256, 128, 16, 32
UNIT = 192
_CHUNK = 1 << 12  # frames at a time


def payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length of the text, and its bytes padded by spaces to a positive multiple of 192."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit PCM WAV file."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(samples) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * (len(samples) % 2)


def samples_of(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of a WAV file, found by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", media[at + 8 : at + 24])
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM")
        if name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _filter() -> np.ndarray:
    """UP rows of TAPS coefficients: the phases of a Hann-windowed sinc that cuts at the lower Nyquist rate."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    taps = np.sinc(n / max(UP, DOWN)) * np.hanning(UP * TAPS + 2)[1:-1]
    return (taps / taps.sum() * UP).reshape(TAPS, UP).T[:, ::-1].astype(np.float32)


_PHASES = _filter()


def resampled(samples: np.ndarray) -> np.ndarray:
    """samples * UP / DOWN, by phase."""
    size = samples.size * UP // DOWN
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), samples, np.zeros(TAPS, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(size, np.float32)
    for first in range(UP):
        at = np.arange(first, size, UP) * DOWN
        out[first::UP] = frames[at // UP] @ _PHASES[(first * DOWN) % UP]
    return out


def _mel_bank(rate: float) -> np.ndarray:
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    hz = 700 * (10 ** (np.linspace(mel(50), mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, 1 / rate)
    up, down = (bins - hz[:-2, None]) / (hz[1:-1] - hz[:-2])[:, None], (hz[2:, None] - bins) / (hz[2:] - hz[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)).T.astype(np.float32)


_HANN = np.hanning(FRAME).astype(np.float32)
_BANK = _mel_bank(RATE * UP / DOWN)


def log_mel(signal: np.ndarray) -> np.ndarray:
    """Frames x MELS; at least one frame, the last padded by zeros."""
    count = max(1, -(-(signal.size - FRAME) // HOP) + 1)
    padded = np.zeros((count - 1) * HOP + FRAME, np.float32)
    padded[: signal.size] = signal
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    out = np.empty((count, MELS), np.float32)
    for at in range(0, count, _CHUNK):
        power = np.abs(np.fft.rfft(frames[at : at + _CHUNK] * _HANN, axis=1)) ** 2
        out[at : at + _CHUNK] = np.log10(power.astype(np.float32) @ _BANK + np.float32(1e-6))
    return out


def active_spans(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges by hysteresis: runs at or above the mean that somewhere exceed it by half a standard deviation."""
    low = energy.mean(dtype=np.float64)
    high = low + 0.5 * energy.std(dtype=np.float64)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], energy >= low, [False]]).view(np.int8)))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2) if (energy[a:b] > high).any()]


def analysed(media: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Log-mel frames and active frame spans of stored media."""
    _, raw = samples_of(media)
    mel = log_mel(resampled((np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128))
    return mel, active_spans(mel.mean(axis=1))


def seconds(frame: int) -> float:
    return frame * HOP * DOWN / (UP * RATE)


def described(mel: np.ndarray) -> str:
    """Frames, active spans, their seconds and the mean log-mel spectrum, rounded, as text."""
    spans = active_spans(mel.mean(axis=1))
    active = sum(b - a for a, b in spans)
    mean = ",".join(f"{x + 0.0:.2f}" for x in np.round(mel.mean(axis=0, dtype=np.float64), 2))
    return f"frames={mel.shape[0]};spans={len(spans)};active={seconds(active):.3f};mel={mean}"


def feature(media: bytes) -> str:
    return described(analysed(media)[0])


TENSOR = pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS), dim_names=["frame", "mel"])
_PATCH_COLUMNS = ["doc_id", "patch", "start_s", "end_s", "active_s", "mel"]


def _cut(mel: np.ndarray, spans: list[tuple[int, int]]) -> tuple[list[np.ndarray], np.ndarray]:
    """patch, start_s, end_s and active_s of a clip's patches, and their frames, the last patch padded by the log-mel floor."""
    count = -(-mel.shape[0] // PATCH)
    whole = np.full((count * PATCH, MELS), -6, np.float32)
    whole[: mel.shape[0]] = mel
    active = np.zeros(count * PATCH)
    for a, b in spans:
        active[a:b] = 1
    first = np.arange(count) * PATCH
    last = np.minimum(first + PATCH, mel.shape[0])
    return [np.arange(count), first * seconds(1), last * seconds(1), active.reshape(count, PATCH).sum(axis=1) * seconds(1)], whole


INDEX = "file string, batch long, rows long, bytes long"
_ROWS, _BYTES = 256, 4 << 20  # of one stored batch, at most but for a longer clip


def _store(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes two Arrow files: clips (media and the frame spans that are active) and the patches of these clips, batch by batch."""
    files: list = []
    for batch in batches:
        kind = batch.schema.field(0).type
        clip = pa.schema([("doc_id", kind), ("n_bytes", pa.int64()), ("n_frames", pa.int64()), ("media", pa.binary()), ("spans_s", pa.list_(pa.list_(pa.float64(), 2)))])
        patch = pa.schema([("doc_id", kind), ("clip", pa.int64()), ("patch", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("active_s", pa.float64()), ("mel", TENSOR)])
        if not files and batch.num_rows:
            store, path = fs.FileSystem.from_uri(folder)
            store.create_dir(path, recursive=True)
            name, at = uuid.uuid4().hex, 0
            for end, schema in (("clips", clip), ("patches", patch)):
                stream = store.open_output_stream(f"{path}/{name}.{end}.arrow", compression=None)
                files.append((stream, pa.ipc.new_file(stream, schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))))
        index: list[tuple] = []
        i = 0
        while i < batch.num_rows:
            clips, columns, wholes, size = [], [], [], 0
            while i < batch.num_rows and len(clips) < _ROWS and size < _BYTES:
                doc, (n, raw) = batch.column(0)[i].as_py(), payload(batch.column(1)[i].as_py())
                media = wav(raw)
                mel, spans = analysed(media)
                times, whole = _cut(mel, spans)
                columns.append(([doc] * len(times[0]), np.full(len(times[0]), len(clips)), *times))
                wholes.append(whole)
                clips.append((doc, n, mel.shape[0], media, [(seconds(a), seconds(b)) for a, b in spans]))
                size += len(media)
                i += 1
            files[0][1].write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*clips), clip)], schema=clip))
            docs, *rest = zip(*columns)
            storage = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(wholes).ravel()), PATCH * MELS)
            arrays = [pa.array([d for part in docs for d in part], kind), *(pa.array(np.concatenate(c)) for c in rest), pa.ExtensionArray.from_storage(TENSOR, storage)]
            files[1][1].write_batch(pa.RecordBatch.from_arrays(arrays, schema=patch))
            index.append((name, at, len(clips), size))
            at += 1
        if index:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*index)], names=["file", "batch", "rows", "bytes"])
    for stream, writer in files:
        writer.close()
        stream.close()


def stored(docs: DataFrame, folder: str) -> DataFrame:
    """Media and patches of each row's text (null: empty) in Arrow files in ``folder``, and the saved index of their batches.

    Only files that the index names count, so a task that runs twice leaves unread files and nothing else.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return saved(rows.mapInArrow(lambda batches: _store(batches, folder), INDEX), "index")


def read_batch(folder: str, file: str, batch: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """The clips of a stored batch and their patches, whose mel column has the type ``TENSOR``."""
    store, path = fs.FileSystem.from_uri(folder)
    out = []
    for end in ("clips", "patches"):
        with store.open_input_file(f"{path}/{file}.{end}.arrow") as source:
            out.append(pa.ipc.open_file(source).get_batch(batch))
    return out[0], out[1]


def digests(docs: DataFrame) -> DataFrame:
    """Stores each row's media and patches and tells what a second job reads back; see the columns. Other columns are not read."""
    folder = new_path(docs.sparkSession, "audio")
    index = stored(docs, folder)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for file, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            clips, patches_ = read_batch(folder, file, at)
            frames = patches_["mel"].to_numpy_ndarray().reshape(-1, MELS)
            rows, first = [], 0
            for size, count, media in zip(*(clips[c].to_pylist() for c in ("n_bytes", "n_frames", "media"))):
                _, back = samples_of(media)
                text = described(np.ascontiguousarray(frames[first : first + count]))
                first += -(-count // PATCH) * PATCH
                rows.append((size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), text))
            yield pa.RecordBatch.from_arrays([clips["doc_id"], *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", *names])

    total = index.agg(F.sum("bytes")).first()[0] or 0
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    # a fixed count: merging partitions by the size of index rows would leave few readers for many bytes
    wanted = index.repartition(int(total // (16 << 20)) + 1, "file", "batch").select("file", "batch")
    return wanted.mapInArrow(lambda batches: (out for batch in batches for out in each(batch)), schema)


def patches(docs: DataFrame) -> DataFrame:
    """doc_id, patch, start_s, end_s, active_s and mel, a float array of the fixed shape PATCH x MELS, for each patch of each row's audio.

    The last patch of a clip is padded by the log-mel floor. ``as_tensors`` gives the mel column its tensor type.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                columns, whole = _cut(*analysed(wav(payload(text.as_py())[1])))
                count = len(columns[0])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * PATCH * MELS, pa.int32()), pa.array(whole.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * count, batch.schema.field(0).type), *map(pa.array, columns), lists], names=_PATCH_COLUMNS)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(each, f"doc_id {kind}, patch long, start_s double, end_s double, active_s double, mel array<float>")


def as_tensors(batch: pa.Table) -> pa.Table:
    """An Arrow table of ``patches`` rows (``DataFrame.toArrow`` or a Parquet file) with mel as fixed-shape tensors."""
    at = batch.schema.get_field_index("mel")
    mel = batch.column(at).combine_chunks()
    values = mel.flatten().cast(pa.float32())
    storage = pa.FixedSizeListArray.from_arrays(values, PATCH * MELS)
    return batch.set_column(at, pa.field("mel", TENSOR), pa.ExtensionArray.from_storage(TENSOR, storage))
