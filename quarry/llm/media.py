"""Media columns: payload bytes as progressive JPEG files, and files as RGB tensors.

A payload byte b is the quantised coefficient b - 128, in zigzag order, block by
block, Y then Cb then Cr; that is the format's own unit and survives the file
losslessly. The comment segment holds the payload's length.

`tensors` reads a column of any progressive JPEG files.

Edge cases: a null text is empty, and an empty payload is one unit of 255s;
a null id stays null; repeated rows give equal files; an empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import bytes_of, docs_of, slices

UNIT = 576
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, height int, width int, tensor binary"


def to_files(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload."""
    shapes = [jpeg.shape_for(-(-len(p) // 64)) for p in payloads]
    planes: list[list[np.ndarray]] = [[], [], []]
    for p, s in zip(payloads, shapes):
        n = sum(s.blocks)
        v = np.zeros(n * 64, np.int16)
        v[: len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) - 128
        at = 0
        for c, k in enumerate(s.blocks):
            planes[c].append(v[at * 64 : (at + k) * 64].reshape(-1, 64))
            at += k
    return jpeg.encode(shapes, [np.concatenate(c) for c in planes], [str(len(p)).encode() for p in payloads]) if payloads else []


def from_files(files: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """Payloads and RGB tensors, from the files' bytes alone."""
    if not files:
        return [], []
    heads, coefs, bases = jpeg.decode(files)
    out = []
    for i, h in enumerate(heads):
        v = np.concatenate([coefs[c][bases[c][i] : bases[c][i + 1]].ravel() for c in range(3)])
        out.append((v[: int(h.comment)] + 128).astype(np.uint8).tobytes())
    return out, jpeg.pixels(heads, coefs, bases)


def payload_of(data: bytes) -> bytes:
    return data + b"\xff" * (UNIT - len(data) if not data else -len(data) % UNIT)


def feature_of(t: np.ndarray) -> str:
    """Size, channel sums and a checksum of the pixels."""
    sums = t.reshape(-1, 3).sum(0, dtype=np.int64)
    return f"{t.shape[1]}x{t.shape[0]}:{sums[0]}:{sums[1]}:{sums[2]}:{zlib.crc32(np.ascontiguousarray(t)):08x}"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Texts stored as files and read back; keep: with the files and tensors themselves."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, limit=2_000_000):
                yield _columns(b, keep)

    return docs_of(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def _columns(b: pa.RecordBatch, keep: bool) -> pa.RecordBatch:
    data, off = bytes_of(b.column(1))
    raw = data.tobytes()
    files = to_files([payload_of(raw[a:z]) for a, z in zip(off[:-1].tolist(), off[1:].tolist())])
    back, tensors = from_files(files)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    none = [None] * len(files)
    cols = {
        "n_bytes": pa.array(np.diff(off)),
        "payload_bytes": pa.array(list(map(len, back)), pa.int64()),
        "payload_sha256": pa.array(list(map(sha, back)), pa.string()),
        "tail_crc32": pa.array([zlib.crc32(p[-32:]) for p in back], pa.int64()),
        "media_bytes": pa.array(list(map(len, files)), pa.int64()),
        "media_sha256": pa.array(list(map(sha, files)), pa.string()),
        "feature": pa.array(list(map(feature_of, tensors)), pa.string()),
        "media": pa.array(files if keep else none, pa.binary()),
        "height": pa.array([t.shape[0] for t in tensors], pa.int32()),
        "width": pa.array([t.shape[1] for t in tensors], pa.int32()),
        "tensor": pa.array([t.tobytes() for t in tensors] if keep else none, pa.binary()),
    }
    return pa.RecordBatch.from_pydict({"doc_id": b.column(0), **cols})


TENSORS = "doc_id long, height int, width int, tensor binary, error string"
#: Pixels, filling ones included, that are decoded at once; a larger image stands alone.
MOST_PIXELS = 4_000_000


def tensors(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Full-resolution RGB tensors (height x width x 3 bytes) of a binary column of progressive JPEG files.

    One or three 8-bit components, any sampling that divides the largest, any size, with
    or without restart intervals. A null file gives nulls; a file that is broken or of
    another kind gives its reason as `error` and no tensor, and harms no other; an empty
    table gives no rows. Other columns are not read.
    """

    def run(batches):
        for b in batches:
            yield from _tensors(b)

    return files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, TENSORS)


def _pixels(data: bytes) -> int:
    """Of the blocks of a file; 0 where it cannot be read."""
    try:
        return 64 * sum(jpeg.parse(data).shape.blocks)
    except ValueError:
        return 0


def _decoded(files: list[bytes]) -> list[tuple[np.ndarray | None, str | None]]:
    """Tensor or reason for each; a batch with a broken file is read one by one."""
    try:
        return [(t, None) for t in jpeg.pixels(*jpeg.decode(files))]
    except (ValueError, IndexError) as e:
        if len(files) == 1:
            return [(None, str(e) if isinstance(e, ValueError) else "broken JPEG file")]
        return [x for f in files for x in _decoded([f])]


def _tensors(b: pa.RecordBatch):
    start = 0
    while start < b.num_rows:
        files, ready, total, end = [], [], 0, start
        while end < b.num_rows and (total < MOST_PIXELS or end == start):
            f = b.column(1)[end].as_py()
            n = _pixels(f) if f is not None else 0
            if files and total + n > MOST_PIXELS:
                break
            ready.append(f is not None)
            files += [f] if f is not None else []
            total, end = total + n, end + 1
        done = iter(_decoded(files) if files else [])
        rows = [next(done) if r else (None, None) for r in ready]
        of = lambda fn: [None if t is None else fn(t) for t, _ in rows]
        yield pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), pa.array(of(lambda t: t.shape[0]), pa.int32()), pa.array(of(lambda t: t.shape[1]), pa.int32()), pa.array(of(lambda t: t.tobytes()), pa.binary()), pa.array([e for _, e in rows], pa.string())], names=["doc_id", "height", "width", "tensor", "error"])
        start = end
