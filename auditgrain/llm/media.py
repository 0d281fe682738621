"""ISO base media containers: write payloads as raw 8-bit frames, and read containers' tables.

``store_media`` keeps bytes as a video track of uncompressed 8 x 8 grey frames (64 bytes each), every
twelfth a keyframe.  ``media_columns`` walks the nested boxes of any ISO container, decodes its sample
tables and gives codec, duration and the byte ranges of keyframes without touching the payload."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytekit import slices

FRAME = 64
GOP = 12
PER_CHUNK = 64
_CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pad(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of the frame size."""
    return data + bytes((-len(data)) % FRAME or (0 if data else FRAME))


def write_container(payload: bytes) -> bytes:
    """The payload (whole frames) as a container; equal payloads give equal bytes."""
    n = len(payload) // FRAME
    chunks = -(-n // PER_CHUNK)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", 8, 8), struct.pack(">II", 0x480000, 0x480000), bytes(4), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 8, -1))
    keys = np.arange(1, n + 1, GOP, dtype=">u4")
    runs = [(1, min(PER_CHUNK, n), 1)] + ([(chunks, n - (chunks - 1) * PER_CHUNK, 1)] if chunks > 1 and n % PER_CHUNK else [])

    def moov(base: int) -> bytes:
        offsets = (base + np.arange(chunks, dtype=np.int64) * PER_CHUNK * FRAME)
        wide = bool(chunks) and int(offsets[-1]) >= 1 << 32
        stbl = _box(
            b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", struct.pack(">III", 1, n, 40)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        hdlr = _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0")
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, n * 40, 0x55C4, 0)), hdlr, minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n * 40), bytes(8), struct.pack(">hhhH", 0, 0, 0, 0), _MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, 1000, n * 40, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", len(payload) + 16) if len(payload) + 8 >= 1 << 32 else struct.pack(">I", len(payload) + 8) + b"mdat"
    size = len(moov(0))
    return ftyp + moov(len(ftyp) + size + len(head)) + head + payload


class Track(NamedTuple):
    kind: str  # the handler: vide, soun, ...
    codec: str
    timescale: int
    duration: int  # as the header says
    decoded: int  # the sum of all samples' durations
    offsets: np.ndarray  # of every sample
    sizes: np.ndarray
    keys: np.ndarray  # numbers of the sync samples, from 0


def walk(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, body end) of the boxes at one level."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a long box is cut off")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} goes beyond its parent")
        yield kind, start + head, start + size
        start += size


def _flatten(data: bytes) -> Iterator[tuple[tuple, int, int]]:
    """Every box with the path to it, in the order of the file; nesting takes no stack."""
    open_ = [((), walk(data))]
    while open_:
        path, boxes = open_[-1]
        found = next(boxes, None)
        if found is None:
            open_.pop()
            continue
        kind, a, b = found
        yield (*path[-2:], kind), a, b
        if kind in _CONTAINERS:
            open_.append(((*path[-2:], kind), walk(data, a, b)))


def _table(data: bytes, at: int, end: int, dtype: str, width: int = 1) -> np.ndarray:
    n = struct.unpack_from(">I", data, at + 4)[0]
    if at + 8 + n * width * np.dtype(dtype).itemsize > end:
        raise ValueError("a table is cut off")
    return np.frombuffer(data, dtype=dtype, count=n * width, offset=at + 8).astype(np.int64).reshape(n, width)


def _sizes(data: bytes, t: dict) -> np.ndarray:
    """Sizes of all samples: one for all, 32 bits each, or packed in 4, 8 or 16 bits."""
    if b"stsz" in t:
        a, b = t[b"stsz"]
        fixed, n = struct.unpack_from(">II", data, a + 4)
        if not fixed:
            return _table(data, a + 4, b, ">u4")[:, 0]
        if n * fixed > len(data):  # checked before anything of this size is made
            raise ValueError("samples go beyond the file")
        return np.full(n, fixed, dtype=np.int64)
    a, b = t[b"stz2"]
    width, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
    if width not in (4, 8, 16) or a + 12 + -(-n * width // 8) > b:
        raise ValueError("a table is cut off")
    packed = np.frombuffer(data, dtype=np.uint8, count=-(-n * width // 8), offset=a + 12)
    if width == 4:
        return np.stack([packed >> 4, packed & 15], axis=1).ravel()[:n].astype(np.int64)
    return packed.astype(np.int64) if width == 8 else packed.view(">u2").astype(np.int64)


def read_tracks(data: bytes) -> list[Track]:
    """Tracks of a container, from its tables alone; ValueError where they contradict the file.

    Fragments are not read: a file that has them is an error, never a track that seems shorter than it is."""
    tracks, cur = [], None
    found: list[dict] = []
    for path, a, b in _flatten(data):
        kind = path[-1]
        if kind in (b"moof", b"mvex"):
            raise ValueError("fragments are not read")
        if kind == b"trak":
            cur = {}
            found.append(cur)
        elif cur is not None and len(path) > 2:
            cur[kind] = (a, b)
    for t in found:
        if not (b"stsz" in t or b"stz2" in t) or any(k not in t for k in (b"stsd", b"mdhd", b"stts", b"stsc")) or not (b"stco" in t or b"co64" in t):
            raise ValueError("a track has no sample tables")
        a, _ = t[b"mdhd"]
        long_ = data[a] == 1
        scale, duration = struct.unpack_from(">IQ" if long_ else ">II", data, a + (20 if long_ else 12))
        codec = data[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16].decode("latin-1")
        kind = data[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12].decode("latin-1") if b"hdlr" in t else ""
        sizes = _sizes(data, t)
        n = len(sizes)
        times = _table(data, *t[b"stts"], ">u4", 2)
        if int(times[:, 0].sum()) != n:
            raise ValueError("times and samples disagree")
        chunk = _table(data, *t[b"co64"], ">u8")[:, 0] if b"co64" in t else _table(data, *t[b"stco"], ">u4")[:, 0]
        runs = _table(data, *t[b"stsc"], ">u4", 3)
        spans = np.diff(np.append(runs[:, 0], len(chunk) + 1)) if len(runs) else np.zeros(0, dtype=np.int64)
        if len(runs) and (runs[0, 0] != 1 or (spans < 0).any()):
            raise ValueError("runs of chunks are out of order")
        per = np.repeat(runs[:, 1], spans)
        if len(per) != len(chunk) or int(per.sum()) != n:
            raise ValueError("chunks and samples disagree")
        which = np.repeat(np.arange(len(chunk)), per)
        before = np.cumsum(sizes) - sizes
        first = np.cumsum(per) - per
        offsets = chunk[which] + before - before[np.minimum(first, max(n - 1, 0))][which] if n else sizes
        if b"ctts" in t and int(_table(data, *t[b"ctts"], ">u4", 2)[:, 0].sum()) != n:
            raise ValueError("composition times and samples disagree")
        if n and (int(chunk.min()) < 0 or int((offsets + sizes).max()) > len(data)):  # a 64-bit offset beyond the signed ones is below 0 here
            raise ValueError("a sample goes beyond the file")
        keys = _table(data, *t[b"stss"], ">u4")[:, 0] - 1 if b"stss" in t else np.arange(n)
        if len(keys) and (keys.min() < 0 or keys.max() >= n):
            raise ValueError("a sync sample does not exist")
        tracks.append(Track(kind, codec, scale, duration, int((times[:, 0] * times[:, 1]).sum()), offsets, sizes, keys))
    return tracks


def read_samples(data: bytes, track: Track) -> bytes:
    """The stored bytes of a track, samples in order."""
    o, s = track.offsets, track.sizes
    if not len(o):
        return b""
    edge = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1] + s[:-1]]))
    last = np.append(edge[1:], len(o)) - 1
    return b"".join(data[int(o[i]) : int(o[j] + s[j])] for i, j in zip(edge, last, strict=True))


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary): each text's UTF-8 bytes in a container; null counts as empty."""

    def run(batches):
        for part in slices(batches):
            texts = [(x or "").encode() for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array([write_container(pad(x)) for x in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_columns(media: DataFrame, read_back: bool = False) -> DataFrame:
    """``media`` with its container's columns instead of ``media``: media_bytes, codec, duration_s,
    n_samples, keyframes array<struct<at, length>> of the main track (the first of pictures, else the first),
    tracks array<struct<kind, codec, duration_s, n_samples, n_keyframes>> of all, error; with ``read_back`` also media_sha256,
    payload_bytes, payload_sha256, tail_crc32 and payload_mean of the main track's stored bytes.

    Durations are sums over the samples.  A null or malformed container gives null columns and says why in error.  Other columns stay; those
    with one of these names are replaced."""
    fields = [("media_bytes", pa.int64()), ("codec", pa.string()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("at", pa.int64()), ("length", pa.int64())]))),
              ("tracks", pa.list_(pa.struct([("kind", pa.string()), ("codec", pa.string()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("n_keyframes", pa.int64())]))), ("error", pa.string())]
    ddl = "media_bytes long, codec string, duration_s double, n_samples long, keyframes array<struct<at: long, length: long>>, tracks array<struct<kind: string, codec: string, duration_s: double, n_samples: long, n_keyframes: long>>, error string"
    if read_back:
        fields += [("media_sha256", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("payload_mean", pa.float64())]
        ddl += ", media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, payload_mean double"
    names = [f[0] for f in fields]
    kept = [c for c in media.columns if c != "media" and c not in names]

    def one(data: bytes | None) -> dict:
        if data is None:
            return {"error": "no container"}
        try:
            tracks = read_tracks(data)
            if not tracks:
                return {"media_bytes": len(data), "error": "no track"}
        except (ValueError, struct.error, KeyError, IndexError, OverflowError) as e:  # what a file that contradicts itself can cause
            return {"media_bytes": len(data), "error": str(e) or type(e).__name__}
        t = next((x for x in tracks if x.kind == "vide"), tracks[0])
        seconds = lambda x: x.decoded / x.timescale if x.timescale else None
        out = {"media_bytes": len(data), "codec": t.codec, "duration_s": seconds(t), "n_samples": len(t.sizes),
               "tracks": [{"kind": x.kind, "codec": x.codec, "duration_s": seconds(x), "n_samples": len(x.sizes), "n_keyframes": len(x.keys)} for x in tracks],
               "keyframes": [{"at": a, "length": n} for a, n in zip(t.offsets[t.keys].tolist(), t.sizes[t.keys].tolist(), strict=True)]}
        if read_back:
            back = read_samples(data, t)
            out |= {"media_sha256": hashlib.sha256(data).hexdigest(), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-FRAME:]),
                    "payload_mean": float(np.frombuffer(back, dtype=np.uint8).mean()) if back else None}
        return out

    def run(batches):
        for part in slices(batches, "media"):
            rows = [one(x) for x in part.column("media").to_pylist()]
            cols = [pa.array([r.get(n) for r in rows], t) for n, t in fields]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *cols], names=[*kept, *names])

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name in kept)
    return media.select(*kept, "media").mapInArrow(run, f"{given}, {ddl}" if kept else ddl)
