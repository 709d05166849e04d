"""Exact removal of byte strings that an earlier document has, by deep-shallow suffix sorting.

A string is a window of WINDOW bytes. Whole texts are packed, as they are scanned, into blocks of about BLOCK bytes
(a longer text is a block of its own), and the blocks are a table: no text is shuffled on its own.

1. The key of a window is the least hash of the K-byte strings in it, so equal windows have equal keys, and windows
   that follow each other mostly share one. Each block sends its distinct keys, truncated and packed, by bucket; a
   bucket answers each block with one bit a key: whether another document may have it, and, if any is, with one whether
   more than HOT blocks have it.
2. Blocks send the runs of windows with such a key, packed by bucket of the key, and nothing else; the bytes of runs
   equal as a whole are sent once a block.
3. Runs of hot keys go to as many tasks a bucket as the root of the number of blocks. Each does as 4. does, and only the
   windows that it does not find to be removed go on, to one task a bucket: each string's least doc_id is among them.
4. A bucket sorts the suffixes of its runs. Runs equal as a whole are one class, of which the least doc_id stands
   for all; what is removed from its first run is removed from that run's repetitions in the document too. The others'
   suffixes are sorted with multikey quicksort on 8-byte characters to SHALLOW bytes; groups that still share a prefix
   are deep, and a blind trie orders each: members branch off the first member's path where they first differ from it,
   and each branch is a group again. Neighbours in this order that share WINDOW bytes are one string; all but those of
   its least doc_id are to be removed.
5. Blocks take back their removed windows, and what is left is hashed.

Buckets grow in number with the input; what a task holds of one is about BUCKET bytes of text times a small factor.
Truncated keys only cost time when they collide; strings are compared byte by byte.

Defined results: a null text is an empty one; a row without doc_id keeps all its bytes and takes none from others;
rows that share a doc_id take nothing from each other; an empty table gives no rows; columns other than doc_id and text
aren't read. Memory follows the longest text, at about a hundred bytes for each of its bytes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as bo
from .tables import Scratch, table

WINDOW, K, SHALLOW = 50, 16, 16
BLOCK, BUCKET, LEAST_BUCKETS, SLICE, HOT = 1 << 20, 1 << 23, 64, 1 << 17, 64
#: A run of windows; same: the row's run whose bytes stand for it, itself if no earlier one is equal.
RUN = np.dtype([("key", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("windows", "<u4"), ("same", "<u4")])
SENT = "bucket int, salt int, block bigint, runs binary, data binary"
SPAN = np.dtype([("start", "<u4"), ("windows", "<u4")])


def pack(docs: DataFrame) -> DataFrame:
    """The texts as blocks: (block, ids, offs, data); data is the texts' bytes one after the other, compressed."""

    def run(batches):
        z, part, n = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
        ids, parts, size = [], [], 0

        def row():
            nonlocal n
            offs = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            n += 1
            return pa.RecordBatch.from_pydict({"block": pa.array([part << 32 | n], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "offs": pa.array([offs], pa.list_(pa.int64())), "data": pa.array([z.compress(b"".join(parts))], pa.binary())})

        for b in batches:
            for i, t in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                if parts and size + len(raw) > BLOCK:
                    yield row()
                    ids, parts, size = [], [], 0
                ids.append(i)
                parts.append(raw)
                size += len(raw)
        if parts:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(run, "block bigint, ids array<bigint>, offs array<bigint>, data binary")


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, in linear time."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, bo.U64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


class Block:
    """A block's bytes, documents and runs of windows with one key."""

    def __init__(self, ids: list, offs: np.ndarray, data: bytes):
        self.ids, self.offs = ids, offs
        self.buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, int(offs[-1]))), np.uint8) if offs[-1] else np.zeros(0, np.uint8)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Key, first window, windows and document of each run, over the documents with an id."""
        buf, offs = self.buf, self.offs
        if len(buf) < WINDOW:
            return np.zeros(0, bo.U64), *(np.zeros(0, np.int64),) * 3
        sums = bo.prefix_sums(buf)
        _, down = bo.powers(len(sums))
        m = len(buf) - K + 1
        with np.errstate(over="ignore"):
            # mixed again: least hashes are small numbers, and buckets go by the first bits
            keys = bo.mix(sliding_min(bo.mix((sums[K:] - sums[:-K]) * down[:m]), WINDOW - K + 1))
        valid = np.ones(len(keys), bool)
        for end in offs[1:-1]:
            valid[max(0, end - WINDOW + 1) : min(end, len(valid))] = False
        for k in (k for k, i in enumerate(self.ids) if i is None):
            valid[offs[k] : min(offs[k + 1], len(valid))] = False
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | ~valid[:-1]
        new[offs[:-1][offs[:-1] < len(new)]] = True
        starts = np.flatnonzero(valid & new)
        stop = np.flatnonzero(new | ~valid)
        ends = np.append(stop, len(keys))[np.searchsorted(stop, starts, "right")]
        return keys[starts], starts, ends - starts, np.searchsorted(offs, starts, "right") - 1


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> bo.U64(64 - bits)).astype(np.int64)


def _short(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 40 bits after the bucket's."""
    return keys << bo.U64(bits) >> bo.U64(24)


def _distinct(keys: np.ndarray, docs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (bucket, 40 bits) of the keys, and whether two documents of the block have it."""
    cut = keys >> bo.U64(24 - bits) if bits < 24 else keys
    order = np.lexsort((docs, cut))
    cut, docs = cut[order], docs[order]
    first = np.concatenate(([True], cut[1:] != cut[:-1])) if len(cut) else np.zeros(0, bool)
    other = np.concatenate(([False], (cut[1:] == cut[:-1]) & (docs[1:] != docs[:-1]))) if len(cut) else first
    return cut[first], np.add.reduceat(other, np.flatnonzero(first)) > 0 if len(cut) else first


def _runs(sorted_: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, first, end) of each run of equal values."""
    if not len(sorted_):
        return []
    first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    return list(zip(sorted_[first].tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_)], strict=True))


def _blocks(b: pa.RecordBatch):
    for k in range(b.num_rows):
        yield k, Block(b["ids"][k].as_py(), np.array(b["offs"][k].values), b["data"][k].as_py())


def send_keys(blocks: DataFrame, bits: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for k, block in _blocks(b):
                keys, _, _, docs = block.runs()
                cut, multi = _distinct(keys, docs, bits)
                bucket = (cut >> bo.U64(40)).astype(np.int64)
                low = (cut & bo.U64((1 << 40) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                some = _runs(bucket)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([q for q, *_ in some], pa.int32()), "block": pa.array([b["block"][k].as_py()] * len(some), pa.int64()), "keys": pa.array([low[x:y].tobytes() for _, x, y in some], pa.binary()), "multi": pa.array([np.packbits(multi[x:y]).tobytes() for _, x, y in some], pa.binary())})

    return blocks.mapInArrow(run, "bucket int, block bigint, keys binary, multi binary")


def _by_bucket(batches):
    """The rows of each bucket (and salt, where there is one), from batches sorted by them."""
    now, held = None, []
    for b in batches:
        for k in range(b.num_rows):
            row = {c: b[c][k].as_py() for c in b.schema.names}
            if (row["bucket"], row.get("salt")) != now and held:
                yield *now, held
                held = []
            now = row["bucket"], row.get("salt")
            held.append(row)
    if held:
        yield *now, held


def answer_keys(sent: DataFrame) -> DataFrame:
    """(block, bucket, shared, hot): bits for each key that the block has sent to the bucket; no `hot` means none."""

    def run(batches):
        for bucket, _, rows in _by_bucket(batches):
            sizes = [len(r["keys"]) // 5 for r in rows]
            flat = np.zeros((sum(sizes), 8), np.uint8)
            flat[:, :5] = np.frombuffer(b"".join(r["keys"] for r in rows), np.uint8).reshape(-1, 5)
            keys = flat.view("<u8").ravel()
            shared = np.concatenate([np.unpackbits(np.frombuffer(r["multi"], np.uint8), count=n) for r, n in zip(rows, sizes, strict=True)]).astype(bool)
            order = np.argsort(keys, kind="stable")
            same = keys[order][1:] == keys[order][:-1]
            shared[order[1:][same]] = True
            shared[order[:-1][same]] = True
            # a block sends a key once
            run_of = np.cumsum(np.concatenate(([False], ~same)))
            hot = np.empty(len(keys), bool)
            hot[order] = np.bincount(run_of)[run_of] > HOT
            masks, hots = (np.split(x, np.cumsum(sizes)[:-1]) for x in (shared, hot))
            yield pa.RecordBatch.from_pydict({"block": pa.array([r["block"] for r in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "shared": pa.array([np.packbits(m).tobytes() for m in masks], pa.binary()), "hot": pa.array([np.packbits(m).tobytes() if m.any() else None for m in hots], pa.binary())})

    return sent.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, "block bigint, bucket int, shared binary, hot binary")


def _packed(runs: np.ndarray, at: np.ndarray, data: np.ndarray, z: zstandard.ZstdCompressor) -> tuple[bytes, bytes]:
    """The runs and the bytes that stand for them, once for those with one place and length in the data."""
    _, first, which = np.unique(at << 32 | runs["windows"], return_index=True, return_inverse=True)
    runs = runs.copy()
    runs["same"] = first[which]
    first.sort()
    return z.compress(runs.tobytes()), z.compress(data[_flat(at[first], runs["windows"][first] + (WINDOW - 1))].tobytes())


def _alike(keys: np.ndarray, data: np.ndarray, at: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The first run that equals each one as a whole, itself if there is none or two different ones have one hash."""
    order = np.lexsort((hashes, sizes, keys))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(keys[order]) != 0) | (np.diff(sizes[order]) != 0) | (np.diff(hashes[order]) != 0)
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.where(_equal(data, at[order], at[head], sizes[order]), head, order)
    return out


def send_runs(blocks: DataFrame, bits: int, salts: int) -> DataFrame:
    """SENT of the runs whose key may be another document's; blocks have a column `answers`. Salt is -1 for keys that aren't hot."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for k, block in _blocks(b):
                answers = {a["bucket"]: (a["shared"], a["hot"]) for a in b["answers"][k].as_py() or ()}
                keys, starts, windows, docs = block.runs()
                cut, _ = _distinct(keys, docs, bits)
                found = _runs((cut >> bo.U64(40)).astype(np.int64))
                flags = [np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=y1 - y0) if (x := answers[q][c]) else np.zeros(y1 - y0, np.uint8) for q, y0, y1 in found] or [np.zeros(0, np.uint8)]).astype(bool) for c in (0, 1)]
                of = np.searchsorted(cut, keys >> bo.U64(24 - bits) if bits < 24 else keys)
                wanted = flags[0][of] if len(cut) else np.zeros(0, bool)
                keys, starts, windows, docs, hot = keys[wanted], starts[wanted], windows[wanted], docs[wanted], flags[1][of[wanted]]
                sizes = windows + (WINDOW - 1)
                at = starts[_alike(keys, block.buf, starts, sizes, bo.word_hashes(block.buf, starts, starts + sizes))]
                share = _bucket(keys, bits) * 2 + hot
                order = np.argsort(share, kind="stable")
                out = np.zeros(len(keys), RUN)
                out["key"], out["start"], out["windows"] = keys[order], starts[order], windows[order]
                out["doc"] = np.array([0 if i is None else i for i in block.ids], np.int64)[docs[order]]
                found = _runs(share[order])
                packed = [_packed(out[x:y], at[order[x:y]], block.buf, z) for _, x, y in found]
                name = b["block"][k].as_py()
                salt = int(bo.mix(np.array([name], bo.U64))[0]) % salts
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([q >> 1 for q, *_ in found], pa.int32()), "salt": pa.array([salt if q & 1 else -1 for q, *_ in found], pa.int32()), "block": pa.array([name] * len(found), pa.int64()), "runs": pa.array([r for r, _ in packed], pa.binary()), "data": pa.array([d for _, d in packed], pa.binary())})

    return blocks.mapInArrow(run, SENT)


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i] ... starts[i] + sizes[i] - 1, for all i one after the other."""
    sizes = sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts.astype(np.int64) - (ends - sizes), sizes)


def _characters(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one big-endian number, without copying."""
    return np.ndarray((max(0, len(data) - 7),), ">u8", np.ascontiguousarray(data), strides=(1,))


def sorted_suffixes(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes' order by group and first WINDOW bytes, and the class of each suffix.

    A class holds those of one group whose first WINDOW bytes are equal, and is named by its first place in the order;
    -1 is the class of those alone. Members of a class may stand in any order.

    Shallow: multikey quicksort to SHALLOW bytes, the pieces of all groups being divided together. Deep: the blind trie
    of each group that is left, one path of each a round: the path is the first member's, members branch off where they
    first differ from it, lower branches before the path (nearest the root first), higher ones behind it (nearest the
    root last), and each branch is a group again.
    """
    chars = _characters(data)
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], group[order][1:] != group[order][:-1]))) if len(order) else order
    first, size = _multikey(chars, at, order, first, np.diff(np.append(first, len(order))))
    classes = np.full(len(at), -1, np.int64)
    while len(first):
        place = _flat(first, size)
        live, part, head = order[place], np.repeat(np.arange(len(first)), size), np.cumsum(size) - size
        path = np.repeat(live[head], size)
        common = _common(chars, at[live], at[path])
        equal = common >= WINDOW
        off = np.flatnonzero(~equal)
        # 256 slots for each place on the path: lower branches downwards, the path itself, higher ones upwards
        slot = np.full(len(live), WINDOW << 8)
        byte, own = (data[at[x[off]] + common[off]].astype(np.int64) for x in (live, path))
        slot[off] = np.where(byte < own, common[off], 2 * WINDOW - common[off]) << 8 | byte
        by = np.lexsort((slot, part))
        order[place] = live[by]
        slot, part, equal = slot[by], part[by], equal[by]
        cut = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (slot[1:] != slot[:-1]))))
        n = np.diff(np.append(cut, len(part)))
        first, size, done = place[cut][n > 1], n[n > 1], equal[cut][n > 1]
        classes[order[_flat(first[done], size[done])]] = np.repeat(first[done], size[done])
        first, size = first[~done], size[~done]
    return order, classes


def _multikey(chars: np.ndarray, at: np.ndarray, order: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of pieces of `order`, in place, to SHALLOW bytes; first place and size of each piece of several that are equal so far.

    A round divides every piece into lower than, equal to and higher than its pivot's 8-byte character; equal parts go on
    with the next character.
    """
    depth, deep = np.zeros(len(first), np.int64), []
    while len(first):
        several, done = size > 1, depth >= SHALLOW
        deep.append((first[several & done], size[several & done]))
        first, size, depth = (x[several & ~done] for x in (first, size, depth))
        if not len(first):
            break
        place, part = _flat(first, size), np.repeat(np.arange(len(first)), size)
        live, head = order[place], np.cumsum(size) - size
        char = chars[at[live] + depth[part]].astype(np.uint64)
        a, b, c = char[head], char[head + size // 2], char[head + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[part]
        side = (char >= pivot).astype(np.int64) + (char > pivot)
        # stable places: behind the lower sides, by rank within the own one
        n = np.bincount(part * 3 + side, minlength=3 * len(first)).reshape(-1, 3)
        start = first[:, None] + np.cumsum(n, axis=1) - n
        to = start.ravel()[part * 3 + side]
        for x in range(3):
            mine = side == x
            to[mine] += np.arange(np.count_nonzero(mine)) - np.repeat(np.cumsum(n[:, x]) - n[:, x], n[:, x])
        order[to] = live
        first, size, depth = start.ravel(), n.ravel(), np.repeat(depth, 3) + np.tile([0, 8, 0], len(first))
    return tuple(np.concatenate(x) for x in zip(*deep, strict=True)) if deep else (first, size)


def _common(chars: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, WINDOW at most; their first SHALLOW bytes are equal."""
    out = np.full(len(a), WINDOW, np.int64)
    open_ = a != b
    for depth in (*range(SHALLOW, WINDOW - 7, 8), WINDOW - 8):
        k = np.flatnonzero(open_)
        if not len(k):
            break
        x = chars[a[k] + depth].astype(np.uint64) ^ chars[b[k] + depth].astype(np.uint64)
        hit = x != 0
        if hit.any():
            x = x[hit]
            zeros = np.zeros(len(x), np.int64)
            for shift in (32, 16, 8):
                top = (x >> np.uint64(64 - shift)) == 0
                zeros[top] += shift // 8
                x = np.where(top, x << np.uint64(shift), x)
            out[k[hit]] = depth + zeros
            open_[k[hit]] = False
    return out


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n[i] bytes from a[i] are those from b[i], about a million bytes at a time."""
    out, cuts = np.ones(len(a), bool), np.cumsum(n) // (1 << 20)
    for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(cuts)) + 1):
        part = part[a[part] != b[part]]
        if len(part):
            out[part] = np.logical_and.reduceat(data[_flat(a[part], n[part])] == data[_flat(b[part], n[part])], np.cumsum(n[part]) - n[part])
    return out


def removed_windows(runs: np.ndarray, data: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first window in it, windows) of what is to be removed; at: where in the data a run's bytes are; hashes: of all its bytes."""
    # classes of runs equal as a whole
    sizes = runs["windows"].astype(np.int64) + WINDOW - 1
    order = np.lexsort((runs["doc"], hashes, runs["key"]))
    key, h, n = runs["key"][order], hashes[order], sizes[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (h[1:] != h[:-1]) | (n[1:] != n[:-1])))
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    same = _equal(data, at[order], at[head], n)
    lead = order[new | ~same]  # a collision of hashes stands for itself
    whole = order[same & (runs["doc"][order] > runs["doc"][head])]
    out = [(whole, np.zeros(len(whole), np.int64), runs["windows"][whole].astype(np.int64))]
    # the first members' repetitions in their own documents, by first member
    again = ~new & same & (runs["doc"][order] == runs["doc"][head])
    again, first_of = order[again], head[again]
    by_first = np.argsort(first_of, kind="stable")
    again, first_of = again[by_first], first_of[by_first]
    # suffixes of the classes' first members, where a key has several
    lead = lead[np.argsort(runs["key"][lead], kind="stable")]
    key = runs["key"][lead]
    differs = np.concatenate(([True], key[1:] != key[:-1]))
    ids = np.cumsum(differs)
    several = np.bincount(ids)[ids] > 1
    lead, ids = lead[several], ids[several]
    if len(lead):
        windows = runs["windows"][lead].astype(np.int64)
        place = _flat(at[lead], windows)
        owner = np.repeat(lead, windows)
        _, classes = sorted_suffixes(data, place, np.repeat(ids, windows))
        in_class = np.flatnonzero(classes >= 0)
        least = np.full(int(classes.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, classes[in_class], runs["doc"][owner[in_class]])
        gone = in_class[runs["doc"][owner[in_class]] > least[classes[in_class]]]
        if len(gone):
            cut = np.concatenate(([True], (gone[1:] != gone[:-1] + 1) | (owner[gone[1:]] != owner[gone[:-1]])))
            first = gone[cut]
            which, start, size = owner[first], place[first] - at[owner[first]], np.diff(np.append(np.flatnonzero(cut), len(gone)))
            out.append((which, start, size))
            lo = np.searchsorted(first_of, which, "left")
            times = np.searchsorted(first_of, which, "right") - lo
            out.append((again[_flat(lo, times)], np.repeat(start, times), np.repeat(size, times)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _in_slices(runs: np.ndarray, data: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """removed_windows() of the runs of some keys at a time, SLICE windows or so, and of a key at least."""
    order = np.argsort(runs["key"], kind="stable")
    key = runs["key"][order]
    step = np.cumsum(runs["windows"][order].astype(np.int64)) // SLICE
    first = np.searchsorted(key, key, "left")
    cuts = np.flatnonzero(np.diff(step[first])) + 1 if len(key) else []
    out = []
    for part in np.split(order, cuts):
        if len(part):
            which, start, windows = removed_windows(runs[part], data, at[part], hashes[part])
            out.append((part[which], start, windows))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _unpacked(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of all rows, the row of each, the bytes, where in them each run's are, and the hash of each run."""
    z = zstandard.ZstdDecompressor()
    parts = [np.frombuffer(z.decompress(r["runs"]), RUN) for r in rows]
    data = np.frombuffer(b"".join(z.decompress(r["data"]) for r in rows), np.uint8)
    runs = np.concatenate(parts)
    row = np.repeat(np.arange(len(rows)), [len(p) for p in parts])
    same = runs["same"] + np.cumsum([0, *map(len, parts[:-1])])[row]
    lead = np.flatnonzero(same == np.arange(len(runs)))
    sizes = runs["windows"][lead].astype(np.int64) + WINDOW - 1
    ends = np.cumsum(sizes)
    at, hashes = np.zeros(len(runs), np.int64), np.zeros(len(runs), bo.U64)
    at[lead], hashes[lead] = ends - sizes, bo.word_hashes(data, ends - sizes, ends)
    return runs, row, data, at[same], hashes[same]


def _rest(runs: np.ndarray, at: np.ndarray, which: np.ndarray, first: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of windows that are not to be removed: the run each is of, itself, and where its bytes are."""
    offs = np.concatenate(([0], np.cumsum(runs["windows"].astype(np.int64))))
    gone = np.zeros(offs[-1], bool)
    gone[_flat(offs[which] + first, windows)] = True
    begin, end, of = bo.spans(~gone, offs)
    rest = runs[of].copy()
    rest["start"] += (begin - offs[of]).astype("<u4")
    rest["windows"] = end - begin
    return of, rest, at[of] + begin - offs[of]


def sort_runs(sent: DataFrame) -> DataFrame:
    """(block, spans): the windows to be removed from each block; and SENT, without salt, of the runs of hot keys that go on."""

    def run(batches):
        for bucket, salt, rows in _by_bucket(batches):
            runs, block, data, at, hashes = _unpacked(rows)
            c = zstandard.ZstdCompressor(level=3)
            which, first, windows = _in_slices(runs, data, at, hashes)
            if salt >= 0:
                of, rest, at = _rest(runs, at, which, first, windows)
                on = [(rows[k]["block"], *_packed(rest[x:y], at[x:y], data, c)) for k, x, y in _runs(block[of])]
                yield pa.RecordBatch.from_pydict({"spans": pa.nulls(len(on), pa.binary()), "bucket": pa.array([bucket] * len(on), pa.int32()), "salt": pa.array([-1] * len(on), pa.int32()), "block": pa.array([x[0] for x in on], pa.int64()), "runs": pa.array([x[1] for x in on], pa.binary()), "data": pa.array([x[2] for x in on], pa.binary())})
            order = np.argsort(block[which], kind="stable")
            which, first, windows = which[order], first[order], windows[order]
            out = np.empty(len(which), SPAN)
            out["start"], out["windows"] = runs["start"][which] + first, windows
            some = _runs(block[which])
            nothing = {n: pa.nulls(len(some), t) for n, t in (("bucket", pa.int32()), ("salt", pa.int32()), ("runs", pa.binary()), ("data", pa.binary()))}
            yield pa.RecordBatch.from_pydict({"spans": pa.array([c.compress(out[x:y].tobytes()) for _, x, y in some], pa.binary()), "bucket": nothing["bucket"], "salt": nothing["salt"], "block": pa.array([rows[k]["block"] for k, *_ in some], pa.int64()), "runs": nothing["runs"], "data": nothing["data"]})

    return sent.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "block").mapInArrow(run, "spans binary, " + SENT)


def cut_blocks(blocks: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left, if wanted) of each document; blocks have a column `spans`."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * texts

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for k, block in _blocks(b):
                edge = np.zeros(len(block.buf) + 1, np.int32)
                for s in b["spans"][k].as_py() or ():
                    s = np.frombuffer(z.decompress(s), SPAN)
                    np.add.at(edge, s["start"], 1)
                    np.add.at(edge, s["start"].astype(np.int64) + s["windows"] + (WINDOW - 1), -1)
                gone = np.cumsum(edge[:-1]) > 0
                rows = []
                for i, a, e in zip(block.ids, block.offs[:-1], block.offs[1:], strict=True):
                    g = gone[a:e]
                    kept = block.buf[a:e][~g].tobytes()
                    rows.append((i, int(e - a), int(g.sum()), int(g[:1].sum() + np.count_nonzero(g[1:] & ~g[:-1])), hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names)

    return blocks.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * texts)


def dedup(docs: DataFrame, texts: bool = False) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "suffix")
    blocks = scratch.write(pack(docs), "blocks")
    total, n = blocks.select(F.sum(F.element_at("offs", -1)), F.count("*")).first()
    bits = max(LEAST_BUCKETS - 1, (total or 0) // BUCKET).bit_length()
    answers = answer_keys(send_keys(blocks, bits)).groupBy("block").agg(F.collect_list(F.struct("bucket", "shared", "hot")).alias("answers"))
    sent = send_runs(blocks.join(answers, "block", "left"), bits, math.isqrt(n) + 1)
    spans = scratch.write(sort_runs(sent), "spans")
    last = scratch.write(sort_runs(spans.where("bucket IS NOT NULL").drop("spans")).select("block", "spans"), "last")
    spans = spans.where("spans IS NOT NULL").select("block", "spans").union(last)
    spans = spans.groupBy("block").agg(F.collect_list("spans").alias("spans"))  # two rows for each bucket at most
    return cut_blocks(blocks.join(spans, "block", "left"), texts)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLES: dict[str, str] = {}
