"""Matroska media columns: EBML elements, clusters, lacing and cues parsed into packet tables.

``parse`` reads a file's bytes: variable-length element ids and sizes (unknown sizes included), SimpleBlocks
and BlockGroups with no, Xiph, fixed-size or EBML lacing, timestamps relative to their cluster
(laced frames follow at the track's default duration), and cues.
``store`` writes bytes losslessly as one track of unsigned 8-bit PCM samples: frames of ``FRAME`` samples,
``LACED`` of them laced in a block (fixed-size lacing where they are of one size, else EBML lacing),
``BLOCKS`` blocks in a cluster, and a cue for each cluster. One tick of the clock is one sample.

Defined results: a null or empty text is stored as 64 bytes of zero; equal texts give equal files; repeated
rows give a row each; an empty table gives no rows. Bytes that aren't Matroska raise ``EbmlError`` in
``parse``; ``packets`` reports them as a row with an error instead. Rows are worked on one at a time, so
memory follows the largest one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .tables import table

FRAME, LACED, BLOCKS, RATE = 1024, 8, 4, 8000
# The element ids of RFC 9559.
EBML, DOCTYPE, SEGMENT, INFO, SCALE, TRACKS, ENTRY = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
NUMBER, UID, KIND, CODEC, AUDIO, HERTZ, CHANNELS, DEPTH, DURATION = 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIME, SIMPLE, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that can end one of unknown size.
TOP = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}


class EbmlError(ValueError):
    """The bytes aren't what the format allows."""


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones is kept for the unknown size."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(eid: int, body: bytes, width: int = 0) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + vint(len(body), width) + body


def number(eid: int, n: int) -> bytes:
    return element(eid, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes]) -> tuple[int, bytes]:
    """The lacing bits of a block's flags, and its data."""
    if len(frames) == 1:
        return 0, frames[0]
    count = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return 0x04, count + b"".join(frames)
    heads = [vint(sizes[0])]
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
        heads.append(vint(b - a + (1 << 7 * width - 1) - 1, width))
    return 0x06, count + b"".join(heads) + b"".join(frames)


def store(payload: bytes) -> bytes:
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(DOCTYPE, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    info = element(INFO, number(SCALE, 10**9 // RATE) + element(0x4D80, b"docquery") + element(0x5741, b"docquery"))
    audio = element(AUDIO, element(HERTZ, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(TRACKS, element(ENTRY, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(0x9C, 1) + number(DURATION, FRAME * 10**9 // RATE) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    parts, at, points = [info, tracks], len(info) + len(tracks), []
    for c in range(0, len(payload), FRAME * LACED * BLOCKS):
        blocks = [number(TIME, c)]
        for b in range(c, min(len(payload), c + FRAME * LACED * BLOCKS), FRAME * LACED):
            part = payload[b : b + FRAME * LACED]
            flags, data = laced([part[i : i + FRAME] for i in range(0, len(part), FRAME)])
            blocks.append(element(SIMPLE, b"\x81" + struct.pack(">hB", b - c, 0x80 | flags) + data))
        points.append(element(POINT, number(CUE_TIME, c) + element(POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(blocks)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(points)))
    return head + element(SEGMENT, b"".join(parts), 8)


@dataclass
class Media:
    doctype: str = ""
    scale: int = 1_000_000
    tracks: list[dict] = field(default_factory=list)
    #: (track, timestamp, first byte, bytes, key frame, cluster, lacing) of each frame
    packets: list[tuple[int, int, int, int, bool, int, int]] = field(default_factory=list)
    #: (timestamp, track, first byte of the cluster)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def _vint(s: bytes, at: int, end: int, keep: bool = False) -> tuple[int, int]:
    """Value and the place after it; -1 for an unknown size. keep: with the length marker, as ids are written."""
    if at >= end or not s[at]:
        raise EbmlError(f"no variable-length integer at {at}")
    width = 9 - s[at].bit_length()
    if at + width > end:
        raise EbmlError(f"cut off at {at}")
    n = int.from_bytes(s[at : at + width], "big")
    if not keep:
        n ^= 1 << 7 * width
        n = -1 if n == (1 << 7 * width) - 1 else n
    return n, at + width


def elements(s: bytes, at: int, end: int, stop: frozenset[int] | set[int] = frozenset()):
    """(id, first byte of the element, first byte of its data, end) of each child; those of unknown size end before an id in TOP."""
    while at < end:
        begin = at
        eid, at = _vint(s, at, end, keep=True)
        if eid in stop:
            return
        n, at = _vint(s, at, end)
        if n < 0:
            n = _unknown(s, at, end, eid) - at
        if at + n > end:
            raise EbmlError(f"element {eid:x} at {begin} is cut off")
        yield eid, begin, at, at + n
        at += n


def _unknown(s: bytes, at: int, end: int, eid: int) -> int:
    if eid == SEGMENT:
        return end
    last = at
    for _, _, _, last in elements(s, at, end, TOP):
        pass
    return last


def _uint(s: bytes, a: int, b: int) -> int:
    return int.from_bytes(s[a:b], "big")


def _frames(s: bytes, a: int, b: int, lacing: int) -> list[tuple[int, int]]:
    """(first byte, bytes) of each frame of a block's data."""
    if lacing == 0:
        return [(a, b - a)]
    if a >= b:
        raise EbmlError("a laced block without frame count")
    count, a, sizes = s[a] + 1, a + 1, []
    if lacing == 2:
        if (b - a) % count:
            raise EbmlError("fixed-size lacing doesn't divide the block")
        sizes = [(b - a) // count] * count
    else:
        for i in range(count - 1):
            if lacing == 1:
                n = 0
                while True:
                    if a >= b:
                        raise EbmlError("lacing is cut off")
                    n, a = n + s[a], a + 1
                    if s[a - 1] != 255:
                        break
            else:
                begin = a
                n, a = _vint(s, a, b)
                if i:
                    n = sizes[-1] + n - ((1 << 7 * (a - begin) - 1) - 1)
            sizes.append(n)
        sizes.append(b - a - sum(sizes))
    if min(sizes) < 0 or a + sum(sizes) > b:
        raise EbmlError("lacing doesn't fit the block")
    out = []
    for n in sizes:
        out.append((a, n))
        a += n
    return out


def parse(s: bytes) -> Media:
    out = Media()
    top = list(elements(s, 0, len(s)))
    if not top or top[0][0] != EBML:
        raise EbmlError("no EBML header")
    out.doctype = next((s[a:b].decode("ascii", "replace") for e, _, a, b in elements(s, top[0][2], top[0][3]) if e == DOCTYPE), "matroska")
    for _, _, seg, seg_end in (x for x in top if x[0] == SEGMENT):
        for eid, begin, a, b in elements(s, seg, seg_end):
            if eid == INFO:
                out.scale = next((_uint(s, x, y) for e, _, x, y in elements(s, a, b) if e == SCALE), out.scale)
            elif eid == TRACKS:
                for e, _, x, y in elements(s, a, b):
                    if e == ENTRY:
                        t = {k: (i, j) for k, _, i, j in elements(s, x, y)}
                        out.tracks.append({"number": _uint(s, *t[NUMBER]) if NUMBER in t else 0, "kind": _uint(s, *t[KIND]) if KIND in t else 0, "duration": _uint(s, *t[DURATION]) if DURATION in t else 0, "codec": s[slice(*t[CODEC])].decode("ascii", "replace") if CODEC in t else ""})
            elif eid == CLUSTER:
                _cluster(s, begin - seg, a, b, out)
            elif eid == CUES:
                for e, _, x, y in elements(s, a, b):
                    when = 0
                    for k, _, i, j in elements(s, x, y) if e == POINT else ():
                        if k == CUE_TIME:
                            when = _uint(s, i, j)
                        elif k == POSITIONS:
                            p = {q: _uint(s, u, v) for q, _, u, v in elements(s, i, j)}
                            out.cues.append((when, p.get(CUE_TRACK, 0), p.get(CUE_CLUSTER, 0)))
    return out


def _cluster(s: bytes, offset: int, a: int, b: int, out: Media) -> None:
    base, index = 0, len(out.clusters)
    out.clusters.append(offset)
    for eid, _, x, y in elements(s, a, b):
        if eid == TIME:
            base = _uint(s, x, y)
        elif eid == SIMPLE:
            _block(s, x, y, base, index, out, None)
        elif eid == GROUP:
            kids = {k: (i, j) for k, _, i, j in elements(s, x, y)}
            if BLOCK in kids:
                _block(s, *kids[BLOCK], base, index, out, 0xFB not in kids)


def _block(s: bytes, a: int, b: int, base: int, index: int, out: Media, key: bool | None) -> None:
    track, a = _vint(s, a, b)
    if a + 3 > b:
        raise EbmlError("a block is cut off")
    when, flags = struct.unpack_from(">hB", s, a)
    lacing = flags >> 1 & 3
    at = base + when
    step = next((t["duration"] for t in out.tracks if t["number"] == track), 0) // max(1, out.scale)
    for k, (x, n) in enumerate(_frames(s, a + 3, b, lacing)):
        out.packets.append((track, at + k * step, x, n, bool(flags & 0x80) if key is None else key, index, lacing))


def packets(df: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """The packet table of a column of Matroska files: a row for each packet, or one with the error; `key` is carried along as bigint."""

    def run(batches):
        for b in batches:
            for k, s in zip(b[key], b[column], strict=True):
                try:
                    found, error = parse(s.as_py() or b"").packets, None
                except EbmlError as e:
                    found, error = [(None,) * 7], str(e)
                cols = list(zip(*found, strict=True)) or [()] * 7
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(found), pa.int64()), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], pa.array([error] * len(found), pa.string())], ["key", "track", "timestamp", "first_byte", "bytes", "keyframe", "cluster", "lacing", "error"])

    return df.select(key, column).mapInArrow(run, "key bigint, track bigint, timestamp bigint, first_byte bigint, bytes bigint, keyframe boolean, cluster bigint, lacing bigint, error string")


def features(samples: bytes, media: Media) -> str:
    """Packet counts, and mean, spread, entropy and crossings of the middle line of the 8-bit samples."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    p = counts[counts > 0] / len(samples)
    x = np.frombuffer(samples, np.uint8)
    mean = float((counts * np.arange(256)).sum() / len(samples))
    spread = float(np.sqrt((counts * (np.arange(256) - mean) ** 2).sum() / len(samples)))
    crossed = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};mean={mean:.3f};std={spread:.3f};entropy={-float((p * np.log2(p)).sum()):.4f};crossings={crossed}"


def text_media(docs: DataFrame) -> DataFrame:
    """Each whole text as a padded payload, stored as Matroska, read back through the packet table."""

    def run(batches):
        for b in batches:
            out = []
            for k, t in zip(b["doc_id"], b["text"], strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                media = store(raw + b"\0" * (64 - len(raw) if not raw else -len(raw) % 64))
                found = parse(media)
                back = b"".join([media[p[2] : p[2] + p[3]] for p in found.packets])
                out.append((k.as_py(), len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(back, found)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))


QUERIES = {"op8_matroska": op8_matroska}
ORACLES: dict[str, str] = {}
