"""ISO base media containers in a column: writing text payloads as sample tables, and probing any container without decoding payloads.

A probe walks nested boxes (32-bit, 64-bit and to-the-end sizes), decodes stsd, stts, stss, stsc, stsz and stco/co64 of every track and
gives codec, duration and the byte ranges of keyframes. Payload bytes are never interpreted.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import fresh

#: Bytes of a payload unit; each is one sample of the track.
UNIT = 192
RATE = 8000
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = box(b"ftyp", b"qt  ", struct.pack(">I", 0x200), b"qt  ")
_SOUND = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))


def write_container(payload: bytes, unit: int = UNIT) -> bytes:
    """A container with one track of unsigned 8-bit sound; samples of ``unit`` bytes, every tenth a sync sample, ten to a chunk."""
    n = len(payload) // unit
    if n * unit != len(payload) or not n:
        raise ValueError("the payload must be a positive multiple of the unit")
    ticks = n * unit
    chunks = np.arange(0, n, 10)
    sizes = full(b"stsz", struct.pack(">II", unit, n))
    runs = [(1, 10, 1)] if n >= 10 else []
    if n % 10:
        runs.append((len(chunks), n % 10, 1))
    head = len(_FTYP) + 8  # the payload follows the header of mdat
    table = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), _SOUND),
        full(b"stts", struct.pack(">III", 1, n, unit)),
        full(b"stss", struct.pack(">I", len(chunks)), (chunks + 1).astype(">u4").tobytes()),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        sizes,
        full(b"stco", struct.pack(">I", len(chunks)), (head + chunks * unit).astype(">u4").tobytes()),
    )
    media = box(
        b"mdia",
        full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, ticks, 0x55C4, 0)),
        full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"sound\0"),
        box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
    )
    track = box(b"trak", full(b"tkhd", struct.pack(">IIIIIQHHHH", 0, 0, 1, 0, ticks, 0, 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=7), media)
    movie = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, ticks, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))
    return _FTYP + box(b"mdat", payload) + box(b"moov", movie, track)


def boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start of the body, end) of the boxes in a range; a size past the end or under its header ends the walk."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if at + 16 > end:
                return
            (size,) = struct.unpack_from(">Q", data, at + 8)
            body = at + 16
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            return
        yield kind, body, at + size
        at += size


def tree(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start of the body, end) of all boxes, parents first; 16 levels at most."""
    for kind, body, stop in boxes(data, at, end):
        yield (kind,), body, stop
        if kind in NESTED and depth < 16:
            for path, b, e in tree(data, body, stop, depth + 1):
                yield (kind, *path), b, e


def _numbers(data: bytes, at: int, end: int, width: int = 4, columns: int = 1) -> np.ndarray:
    """The entries of a counted table, as many as the box holds."""
    n = min(struct.unpack_from(">I", data, at)[0], (end - at - 4) // (width * columns)) if at + 4 <= end else 0
    return np.frombuffer(data, dtype=f">u{width}", count=n * columns, offset=at + 4).astype(np.int64).reshape(n, columns)


def _track(data: bytes, at: int, end: int) -> dict:
    found = {path[-1]: (b, e) for path, b, e in tree(data, at, end)}
    out: dict = {"codec": None, "handler": None, "timescale": 0, "duration": 0}
    if b"mdhd" in found:
        b, _ = found[b"mdhd"]
        out["timescale"], out["duration"] = struct.unpack_from(">IQ", data, b + 20) if data[b] == 1 else struct.unpack_from(">II", data, b + 12)
    if b"hdlr" in found:
        out["handler"] = data[found[b"hdlr"][0] + 8 : found[b"hdlr"][0] + 12].decode("latin-1")
    if b"stsd" in found:
        out["codec"] = next((k.decode("latin-1") for k, *_ in boxes(data, found[b"stsd"][0] + 8, found[b"stsd"][1])), None)
    sizes = np.zeros(0, np.int64)
    if b"stsz" in found:
        b, e = found[b"stsz"]
        each, n = struct.unpack_from(">II", data, b + 4)
        # no more samples than the file has bytes for
        sizes = np.full(min(n, len(data) // each), each, np.int64) if each else _numbers(data, b + 8, e).ravel()
    offsets = np.zeros(0, np.int64)
    for kind, width in ((b"stco", 4), (b"co64", 8)):
        if kind in found:
            offsets = _numbers(data, found[kind][0] + 4, found[kind][1], width).ravel()
    per_chunk = np.zeros(len(offsets), np.int64)
    if b"stsc" in found:
        for first, n, _ in _numbers(data, found[b"stsc"][0] + 4, found[b"stsc"][1], 4, 3):
            per_chunk[max(0, first - 1) :] = min(n, len(sizes))
    per_chunk = np.diff(np.minimum(np.cumsum(per_chunk), len(sizes)), prepend=0)
    n = int(per_chunk.sum())
    chunk = np.repeat(np.arange(len(offsets)), per_chunk)[:n]
    before = np.cumsum(sizes[:n]) - sizes[:n]
    first = np.concatenate([[0], np.cumsum(per_chunk)[:-1]]).astype(np.int64) if len(offsets) else np.zeros(0, np.int64)
    starts = offsets[chunk] + before - before[first[chunk]] if n else before
    sync = _numbers(data, found[b"stss"][0] + 4, found[b"stss"][1]).ravel() - 1 if b"stss" in found else np.arange(n)
    sync = sync[(sync >= 0) & (sync < n)]
    ticks = _numbers(data, found[b"stts"][0] + 4, found[b"stts"][1], 4, 2) if b"stts" in found else np.zeros((0, 2), np.int64)
    return out | {"samples": n, "starts": starts, "sizes": sizes[:n], "keyframes": np.stack([starts[sync], starts[sync] + sizes[sync]], 1) if n else np.zeros((0, 2), np.int64), "ticks": int((ticks[:, 0] * ticks[:, 1]).sum())}


def probe(data: bytes | None) -> list[dict]:
    """The tracks of a container; none for null, empty or foreign bytes. Truncated tables give what they hold."""
    if not data:
        return []
    try:
        return [_track(data, b, e) for path, b, e in tree(data) if path == (b"moov", b"trak")]
    except (struct.error, IndexError):
        return []


def read_payload(data: bytes, track: dict) -> bytes:
    """The samples of a track in order; neighbours in one piece are read at once."""
    starts, ends = track["starts"], track["starts"] + track["sizes"]
    if not len(starts):
        return b""
    breaks = np.flatnonzero(starts[1:] != ends[:-1]) + 1
    return b"".join(data[a:b] for a, b in zip(starts[np.concatenate([[0], breaks])], ends[np.concatenate([breaks - 1, [len(ends) - 1]])], strict=True))


def text_payload(text: str | None, unit: int = UNIT) -> tuple[int, bytes]:
    """(UTF-8 bytes, the bytes with spaces up to a positive multiple of the unit)."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % unit or (0 if raw else unit))


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``, the container of each whole text. Null and empty texts hold one unit of spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [text_payload(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([write_container(p) for _, p in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


PROBED = "codec string, duration_s double, samples long, keyframes array<struct<start:long,end:long>>"


def media_columns(df: DataFrame, column: str = "media") -> DataFrame:
    """``df`` without the container, with codec, duration, samples and keyframe byte ranges of its first track (nulls if it has none).

    Columns pass through; where the input has one of these names, the new one has underscores in front."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf(PROBED)
    def first_track(values):
        import pandas as pd

        rows = []
        for v in values:
            t = next(iter(probe(v)), None)
            rows.append((t["codec"], t["duration"] / t["timescale"] if t["timescale"] else None, t["samples"], [{"start": int(a), "end": int(b)} for a, b in t["keyframes"]]) if t else (None, None, None, None))
        return pd.DataFrame(rows, columns=["codec", "duration_s", "samples", "keyframes"])

    held, names = fresh(df, "_t"), ("codec", "duration_s", "samples", "keyframes")
    kept = [F.col(f"`{c}`") for c in df.columns if c != column]
    return df.withColumn(held, first_track(F.col(column))).select(*kept, *(F.col(held)[n].alias(fresh(df, n)) for n in names))


def media_digest(df: DataFrame) -> DataFrame:
    """Digests of stored containers: what is read back through the sample tables, and a JSON of the probed features.

    A null or foreign container has no payload: null digests, no bytes, and the feature ``null``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                track = next((t for t in probe(data) if t["samples"]), None)
                if track is None:
                    rows.append((doc_id, n, 0, None, None, len(data or b""), data and hashlib.sha256(data).hexdigest(), "null"))
                    continue
                payload = read_payload(data, track)
                keys = track["keyframes"]
                feature = {"codec": track["codec"], "handler": track["handler"], "duration_s": track["duration"] / track["timescale"] if track["timescale"] else None, "samples": track["samples"], "keyframes": len(keys), "first_key": keys[0].tolist() if len(keys) else None, "last_key": keys[-1].tolist() if len(keys) else None, "keyframe_crc32": zlib.crc32(keys.astype("<i8").tobytes())}
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), json.dumps(feature)))
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
