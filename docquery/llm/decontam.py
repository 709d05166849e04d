"""Benchmark decontamination: rare n-gram seeds join training passages to test items, Smith-Waterman alignment scores them.

Words are runs of letters and digits, A-Z lower-cased. An item of m words has m - 1 seeds, its pairs of adjacent words; a document
holds a seed where the two words follow each other, or stand one word apart. An alignment whose score is at least THRESHOLD of a
perfect copy's holds at least need(m) seeds at different places of the item: with h of them, a matched words, and p places where the
item goes on by more than one word, its score is at most 2 + 2 h + p, and a + p <= m, p <= a - 1 - h. (Items so short that this
asks for none have their single words as seeds.) So a document without any of an item's (seeds - need + 1) rarest seeds holds no
such copy. A first scan counts the documents that hold each seed; a second one joins documents and items by the rare seeds, counts
all seeds of the joined items, and where need(m) of them are within the reach of one alignment, aligns. Nothing that
reaches the threshold is missed, however frequent its words are.

The test items are the stated query set: they are taken in blocks of at most BLOCK_WORDS words, each small enough
to be sent to every task; documents are never shuffled. Whole texts are scanned.

Defined results: null or empty texts and items match nothing; items equal in words each give a row; repeated
documents give rows each; ties between alignments go to the first; empty tables give no rows; other columns aren't read.
Memory follows the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as bo
from .tables import table

THRESHOLD, BLOCK_WORDS = 0.5, 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
WORD = bo.LETTERS.copy()
WORD[48:58] = True


def words_of(texts: pa.Array):
    """(first row, word hashes, row of each word within the slice, rows) of each slice of the texts."""
    for i, j, buf, offs in bo.slices(texts):
        low = bo.LOWER[buf]
        starts, ends, rows = bo.spans(WORD[low], offs)
        yield i, bo.word_hashes(low, starts, ends), rows, j - i


def need(m: int, threshold: float = THRESHOLD) -> int:
    """The least number of an item's seeds in an alignment that reaches the threshold; 0 if there may be none."""
    return max(0, int(np.ceil((threshold * MATCH * m - 2 - (m - 1) / 2) / 1.5 - 1e-9)))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return bo.mix(a * bo.PLACES[0] + b * bo.PLACES[1])


class Items:
    """A block of test items: ids, words and seeds (hash, item, place) in order of the hash; rare: those that join."""

    def __init__(self, ids: list, texts: list, threshold: float = THRESHOLD):
        self.threshold, self.ids, self.words = threshold, [], []
        for i, words, rows, n in words_of(pa.array(texts, pa.string())):
            cut = np.searchsorted(rows, np.arange(n + 1))
            for k in range(n):
                if cut[k + 1] > cut[k]:
                    self.ids.append(ids[i + k])
                    self.words.append(words[cut[k] : cut[k + 1]])
        pairs = [need(len(w), threshold) for w in self.words]
        self.need = np.array([n or max(1, int(np.ceil(threshold * len(w) - 1e-9))) for n, w in zip(pairs, self.words, strict=True)], np.int64)
        seeds = [_pair(w[:-1], w[1:]) if n else bo.mix(w) for n, w in zip(pairs, self.words, strict=True)]
        self.single = not all(pairs)
        sizes = np.array([len(x) for x in seeds], np.int64)
        self.hash = np.concatenate([*seeds, np.zeros(0, bo.U64)])
        self.item = np.repeat(np.arange(len(seeds)), sizes)
        self.place = np.arange(len(self.hash)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.place = self.hash[order], self.item[order], self.place[order]
        self.distinct = np.unique(self.hash)
        self.joining(np.zeros(len(self.distinct), np.int64))

    def joining(self, counts: np.ndarray) -> Items:
        """counts: documents that hold each of the distinct seeds; as many of an item's rarest seeds as no copy can do without join."""
        often = counts[np.searchsorted(self.distinct, self.hash)]
        order = np.lexsort((self.place, self.hash, often, self.item))
        seeds = np.bincount(self.item, minlength=len(self.ids))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(seeds) - seeds, seeds)
        chosen = np.sort(order[rank <= (seeds - self.need)[self.item[order]]])
        self.rare_hash, self.rare_item = self.hash[chosen], self.item[chosen]
        return self

    def grams(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each seed that the words could hold, and the index of its first word."""
        hashes, at = [], []
        for d in (1, 2):
            k = np.flatnonzero(rows[:-d] == rows[d:]) if len(rows) > d else np.zeros(0, np.int64)
            hashes.append(_pair(words[k], words[k + d]))
            at.append(k)
        if self.single:
            hashes.append(bo.mix(words))
            at.append(np.arange(len(words)))
        return np.concatenate(hashes), np.concatenate(at)


def _equal(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into hashes, index into the sorted table) of each pair of equal ones."""
    lo, hi = np.searchsorted(table, hashes, "left"), np.searchsorted(table, hashes, "right")
    at = np.flatnonzero(hi > lo)
    size = hi[at] - lo[at]
    ends = np.cumsum(size)
    return np.repeat(at, size), np.repeat(lo[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of words a with words b, and the place in a after its last word."""
    gaps = -GAP * np.arange(1, len(b) + 1)
    row, best, end = np.zeros(len(b) + 1, np.int64), 0, 0
    for i, w in enumerate(a):
        new = np.maximum(row[:-1] + np.where(b == w, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(new, 0, out=new)
        row[1:] = np.maximum.accumulate(new + gaps) - gaps
        top = int(row.max())
        if top > best:
            best, end = top, i + 1
    return best, end


def _best(words: np.ndarray, items: Items, k: int, hashes: np.ndarray, at: np.ndarray) -> tuple | None:
    """(item id, score, first word, word after the last) of item k's best alignment with a document's words, if it reaches the threshold."""
    target, mine = items.words[k], np.flatnonzero(items.item == k)
    m, least = len(target), int(items.need[k])
    found, seed = _equal(items.hash[mine], hashes)
    place = items.place[mine][seed]
    if len(np.unique(place)) < least:
        return None
    pad = int(np.ceil(MATCH * m * (1 - items.threshold) / -GAP))  # no more gaps than this leave a score of the threshold
    offset = np.sort(at[found] - place)
    # starts of runs of `least` seeds whose diagonals one alignment can reach
    close = np.flatnonzero(offset[least - 1 :] - offset[: len(offset) - least + 1] <= pad)
    best = (0.0, 0, 0)
    spans: list[list[int]] = []
    for lo, hi in zip(offset[close], offset[close + least - 1], strict=True):
        lo, hi = max(0, int(lo) - pad), min(len(words), int(hi) + m + pad)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(hi, spans[-1][1])
        else:
            spans.append([lo, hi])
    for lo, hi in spans:
        score, end = align(words[lo:hi], target)
        if score / (MATCH * m) > best[0]:
            _, back = align(words[lo : lo + end][::-1], target[::-1]) if score >= items.threshold * MATCH * m else (0, 0)
            best = (score / (MATCH * m), lo + end - back, lo + end)
    return (items.ids[k], round(best[0], 6), best[1], best[2]) if best[0] >= items.threshold else None


def matches(texts: pa.Array, items: Items):
    """(row, [(item id, score, first word, word after the last)]) of each text that holds copies of items."""
    for i, words, rows, n in words_of(texts):
        hashes, at = items.grams(words, rows)
        gram, seed = _equal(items.rare_hash, hashes)
        joined = np.unique(rows[at[gram]] * len(items.ids) + items.rare_item[seed])
        for r in np.unique(joined // len(items.ids)) if len(joined) else ():
            a, b = np.searchsorted(rows, (r, r + 1))
            hashes, at = items.grams(words[a:b], rows[a:b])
            found = [_best(words[a:b], items, k, hashes, at) for k in joined[joined // len(items.ids) == r] % len(items.ids)]
            if found := [x for x in found if x]:
                yield i + int(r), found


def blocks(benchmark: DataFrame) -> list[Items]:
    """The test items with their rare seeds still to be told, in blocks of bounded size."""
    out, ids, texts, held = [], [], [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        held += len(row["text"] or "") // 2
        if held >= BLOCK_WORDS:
            out.append(Items(ids, texts))
            ids, texts, held = [], [], 0
    return [*out, Items(ids, texts)] if ids else out


def count_seeds(docs: DataFrame, items: Items) -> np.ndarray:
    """How many rows of docs hold each of the block's distinct seeds."""

    def run(batches):
        n = np.zeros(len(items.distinct), np.int64)
        for b in batches:
            for _, words, rows, _ in words_of(b["text"]):
                hashes, at = items.grams(words, rows)
                gram, seed = _equal(items.distinct, hashes)
                n += np.bincount(np.unique(rows[at[gram]] * max(1, len(n)) + seed) % max(1, len(n)), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"seed": pa.array(at, pa.int64()), "n": pa.array(n[at], pa.int64())})

    counted = docs.select("text").mapInArrow(run, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n")).toPandas()  # at most a row for each seed of the block
    out = np.zeros(len(items.distinct), np.int64)
    out[counted["seed"].to_numpy()] = counted["n"].to_numpy()
    return out


def counted_blocks(docs: DataFrame, benchmark: DataFrame) -> list[Items]:
    return [items.joining(count_seeds(docs, items)) for items in blocks(benchmark)]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row (doc_id, item_id, score, first_word, end_word) for each document and test item of which it holds a copy."""
    out = None
    for items in counted_blocks(docs, benchmark):

        def run(batches, items=items):
            for b in batches:
                rows = [(b["doc_id"][r].as_py(), *m) for r, found in matches(b["text"], items) for m in found]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], ["doc_id", "item_id", "score", "first_word", "end_word"])

        found = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint, score double, first_word bigint, end_word bigint")
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, score double, first_word bigint, end_word bigint")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a copy of a test item; one scan a block, no shuffle."""
    kept = docs
    for items in counted_blocks(docs, benchmark):

        def run(batches, items=items):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[r for r, _ in matches(b["text"], items)]] = False
                yield b.filter(pa.array(keep))

        kept = kept.mapInArrow(run, T.StructType(list(docs.schema.fields)))
    return kept


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a copy of a benchmark item."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontamination": op10_decontamination}
ORACLES: dict[str, str] = {}
