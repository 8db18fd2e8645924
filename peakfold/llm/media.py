"""Media columns: texts as samples of an ISO media file, read back from its boxes and sample tables.

``write_container`` builds a file of nested boxes; ``walk`` and ``read_tracks`` read any such file:
codec, timescale, duration, and the byte ranges of samples and keyframes, from the tables alone.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from peakfold.llm.common import bytes_of, id_text, map_arrow, out_batch, slices

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
BLOCK, RATE, CHUNK = 64, 8000, 4096
#: Boxes that hold boxes, with the bytes that stand before the first one.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"stsd": 8, b"dref": 8}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 >> 32:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_container(payload: bytes, rate: int = RATE, chunk: int = CHUNK) -> bytes:
    """One sound track of 8-bit samples, ``chunk`` of them in a chunk; boxes first, then the samples."""
    n = len(payload)
    chunks = range(0, n, chunk)
    wide = n + (1 << 20) + 8 * len(chunks) >= 1 << 32
    v = int(n >= 1 << 32)  # version 1 has 64-bit durations
    times = (lambda scale, *mid: struct.pack(">QQI" if v else ">III", 0, 0, scale) + b"".join(mid) + struct.pack(">Q" if v else ">I", n))
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))
    runs = [(1, min(n, chunk))] + ([(len(chunks), n % chunk)] if n > chunk and n % chunk else [])

    def head(at: int) -> bytes:
        offsets = [at + c for c in chunks]
        stbl = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, per, 1) for first, per in runs)), full(b"stsz", struct.pack(">II", 1, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), np.array(offsets, ">u8" if wide else ">u4").tobytes()),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", times(rate), struct.pack(">HH", 0x55C4, 0), version=v), full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = full(b"tkhd", times(1, bytes(4)), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=v, flags=7)
        moov = box(b"moov", full(b"mvhd", times(rate), struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=v), box(b"trak", tkhd, mdia))
        return box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2") + moov

    size = len(head(0)) + (16 if n + 8 >> 32 else 8)
    return head(size) + box(b"mdat", payload)


def walk(data, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """(path, start of the body, end) of each box, parents before children. Raises ValueError where a size can't be."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                raise ValueError("box size is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has the size {size}")
        at = (*path, kind)
        yield at, body, start + size
        if kind in CONTAINERS:
            yield from walk(data, body + CONTAINERS[kind], start + size, at)
        start += size


def _table(data, body: int, end: int, kinds: str, count_at: int = 4) -> np.ndarray:
    """A counted table of a box, which must hold it whole."""
    (n,) = struct.unpack_from(">I", data, body + count_at)
    kind = np.dtype(kinds)
    if body + count_at + 4 + n * kind.itemsize > end:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(data, kind, n, body + count_at + 4)


def _compact_sizes(data, body: int, end: int) -> np.ndarray:
    """Sample sizes of 4, 8 or 16 bits."""
    bits, n = data[body + 7], struct.unpack_from(">I", data, body + 8)[0]
    if bits not in (4, 8, 16) or body + 12 + (n * bits + 7) // 8 > end:
        raise ValueError("compact sample sizes are wrong")
    if bits == 4:
        raw = np.frombuffer(data, np.uint8, (n + 1) // 2, body + 12)
        return np.stack([raw >> 4, raw & 15], 1).ravel()[:n].astype(np.int64)
    return np.frombuffer(data, ">u2" if bits == 16 else "u1", n, body + 12).astype(np.int64)


#: Flags of fragment headers and runs: which fields they have.
BASE, DESCRIPTION, LENGTH, SIZE, FLAGS = 1, 2, 8, 16, 32
RUN_OFFSET, RUN_FIRST, RUN_LENGTH, RUN_SIZE, RUN_FLAGS, RUN_TIME = 1, 4, 0x100, 0x200, 0x400, 0x800
NOT_SYNC = 0x10000


def _fragments(data, fragments: list[dict], defaults: dict[int, tuple]) -> dict[int, tuple[list, list, list, int]]:
    """Starts, sizes and sync marks of the samples of each track's fragments, and their whole length."""
    out: dict[int, tuple[list, list, list, int]] = {}
    for f in fragments:
        starts, sizes, sync, length = out.get(f["track"], ([], [], [], 0))
        size0, flags0, length0 = (x if x is not None else y for x, y in zip(f["own"], defaults.get(f["track"], (0, 0, 0)), strict=True))
        at = f["base"]
        for body, end in f["runs"]:
            flags = struct.unpack_from(">I", data, body)[0] & 0xFFFFFF
            (n,) = struct.unpack_from(">I", data, body + 4)
            k, first = body + 8, None
            if flags & RUN_OFFSET:
                at = f["base"] + struct.unpack_from(">i", data, k)[0]
                k += 4
            if flags & RUN_FIRST:
                (first,) = struct.unpack_from(">I", data, k)
                k += 4
            fields = [x for x in (RUN_LENGTH, RUN_SIZE, RUN_FLAGS, RUN_TIME) if flags & x]
            if k + 4 * n * len(fields) > end:
                raise ValueError("a run is longer than its box")
            table = np.frombuffer(data, ">u4", n * len(fields), k).reshape(n, len(fields)).astype(np.int64)
            column = lambda x, default: table[:, fields.index(x)] if x in fields else np.full(n, default, np.int64)  # noqa: E731, B023
            each, marks = column(RUN_SIZE, size0), column(RUN_FLAGS, flags0).copy()
            if first is not None and n:
                marks[0] = first
            begin = at + np.cumsum(each) - each
            starts += begin.tolist()
            sizes += each.tolist()
            sync += ((marks & NOT_SYNC) == 0).tolist()
            length += int(column(RUN_LENGTH, length0).sum())
            at += int(each.sum())
        out[f["track"]] = (starts, sizes, sync, length)
    return out


def read_tracks(data: bytes) -> list[dict]:
    """Each track's codec, timescale, duration, sample starts and sizes, and coalesced keyframe byte ranges.

    Samples of movie fragments follow those of the tables. ValueError where boxes or tables contradict each other.
    """
    tracks: list[dict] = []
    fragments: list[dict] = []
    defaults: dict[int, tuple] = {}
    moof = 0
    for path, body, end in walk(data):
        kind = path[-1]
        if kind == b"moof":
            moof = body - 8
        elif kind == b"trex":
            number, _, length, size, flags = struct.unpack_from(">5I", data, body + 4)
            defaults[number] = (size, flags, length)
        elif kind == b"tfhd":
            flags = struct.unpack_from(">I", data, body)[0] & 0xFFFFFF
            k, found = body + 8, {}
            for bit, width in ((BASE, 8), (DESCRIPTION, 4), (LENGTH, 4), (SIZE, 4), (FLAGS, 4)):
                if flags & bit:
                    found[bit] = int.from_bytes(data[k : k + width], "big")
                    k += width
            fragments.append({"track": struct.unpack_from(">I", data, body + 4)[0], "base": found.get(BASE, moof), "own": (found.get(SIZE), found.get(FLAGS), found.get(LENGTH)), "runs": []})
        elif kind == b"trun":
            if not fragments:
                raise ValueError("a run without a fragment")
            fragments[-1]["runs"].append((body, end))
        if kind == b"trak":
            tracks.append({"sync": None})
        if not tracks or b"trak" not in path:
            continue
        t = tracks[-1]
        if kind == b"tkhd":
            (t["number"],) = struct.unpack_from(">I", data, body + (20 if data[body] else 12))
        elif kind == b"mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ" if data[body] else ">II", data, body + (20 if data[body] else 12))
        elif kind == b"hdlr":
            t["handler"] = bytes(data[body + 8 : body + 12]).decode("latin-1")
        elif len(path) > 1 and path[-2] == b"stsd" and "codec" not in t:
            t["codec"] = kind.decode("latin-1")
            if t.get("handler") == "soun":
                t["channels"], t["bits"] = struct.unpack_from(">HH", data, body + 16)
        elif kind == b"stsc":
            t["stsc"] = _table(data, body, end, ">u4,>u4,>u4")
        elif kind == b"stsz":
            same, n = struct.unpack_from(">II", data, body + 4)
            t["sizes"] = np.full(n, same, np.int64) if same else _table(data, body, end, ">u4", 8).astype(np.int64)
        elif kind == b"stz2":
            t["sizes"] = _compact_sizes(data, body, end)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = _table(data, body, end, ">u4" if kind == b"stco" else ">u8").astype(np.int64)
        elif kind == b"stss":
            t["sync"] = _table(data, body, end, ">u4").astype(np.int64) - 1
    more = _fragments(data, fragments, defaults)
    for t in tracks:
        if missing := {"timescale", "codec", "sizes", "chunks", "stsc"} - set(t):
            raise ValueError(f"a track lacks {', '.join(sorted(missing))}")
        sizes, chunks, runs = t["sizes"], t["chunks"], t["stsc"]
        if len(chunks):
            first = runs["f0"].astype(np.int64) - 1
            if not len(first) or first[0] != 0 or (np.diff([*first, len(chunks)]) < 1).any():
                raise ValueError("the sample tables disagree")
            per = np.repeat(runs["f1"].astype(np.int64), np.diff([*first, len(chunks)]))
            if per.sum() != len(sizes):
                raise ValueError("the sample tables disagree")
            before = np.cumsum(sizes) - sizes
            heads = np.cumsum(per) - per
            t["starts"] = before + np.repeat(chunks - before[heads], per)
        else:
            t["starts"] = sizes[:0]
        keys = np.arange(len(sizes)) if t["sync"] is None else t["sync"]
        if len(keys) and not (0 <= keys.min() and keys.max() < len(sizes)):
            raise ValueError("a sync sample isn't there")
        if t.get("number") in more:
            starts, each, sync, length = more[t["number"]]
            keys = np.concatenate([keys, len(sizes) + np.flatnonzero(sync)])
            sizes = t["sizes"] = np.concatenate([sizes, np.array(each, np.int64)])
            t["starts"] = np.concatenate([t["starts"], np.array(starts, np.int64)])
            t["duration"] += length
        a, b = t["starts"][keys], t["starts"][keys] + sizes[keys]
        new = np.flatnonzero(np.concatenate([[True], a[1:] != b[:-1]])) if len(a) else keys[:0]
        t["keyframe_ranges"] = [[int(x), int(y)] for x, y in zip(a[new], b[np.concatenate([new[1:] - 1, [len(b) - 1]])] if len(a) else [], strict=True)]
    return tracks


def read_payload(data: bytes, track: dict) -> bytes:
    """The bytes of a track's samples in order, copied in the runs that lie end to end."""
    starts, ends = track["starts"], track["starts"] + track["sizes"]
    if not len(starts):
        return b""
    cut = np.flatnonzero(starts[1:] != ends[:-1]) + 1
    return b"".join(data[starts[a] : ends[b - 1]] for a, b in zip([0, *cut], [*cut, len(starts)], strict=True))


def feature(track: dict) -> str:
    """Codec, length and keyframes as canonical JSON."""
    return json.dumps({"codec": track["codec"], "timescale": track["timescale"], "duration": track["duration"], "samples": len(track["sizes"]), "keyframes": track["keyframe_ranges"]}, sort_keys=True, separators=(",", ":"))


def padded(raw: bytes, block: int = BLOCK) -> bytes:
    return raw + bytes(max(block, -(-len(raw) // block) * block) - len(raw))


def store_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the digests of its media file and of the payload that its sample tables lead to.

    A row without text counts as empty: 64 zero bytes are stored. A text of any length is stored whole, in
    a file of its own. Rows are independent: repeated rows, null keys and an empty table go through as they
    are; there are no ties; other columns are not looked at.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches):
        for batch in slices(batches):
            rows = []
            for key, raw in zip(batch.column("doc_id").to_pylist(), bytes_of(batch), strict=True):
                media = write_container(padded(raw))
                (track,) = read_tracks(media)
                back = read_payload(media, track)
                rows.append((key, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(track)))
            yield out_batch(schema, *map(list, zip(*rows, strict=True)))

    return map_arrow(id_text(docs, id_col, text_col), run, SCHEMA)
