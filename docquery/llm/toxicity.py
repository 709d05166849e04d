"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, lower-cased; a text's features are the distinct hashes of its words, of its
pairs of adjacent words and of its pairs of words one apart, each modulo ``2 ** BITS``. Training takes a
bounded sample of labelled documents (``SAMPLE`` of them, those with the smallest hashes of doc_id, and of these as many as hold
``FEATURES`` features), which one task gathers and learns from; it makes ``STEPS`` steps, in 2 to 20 rounds. The L1 penalty grows
with the root of the number of examples, as the summed gradients of words that tell nothing do, and leaves a few hundred weights that
aren't zero; the model that goes to the executors has at most ``2 ** BITS`` + 1 (index, weight) pairs.
Every row of the input is scored over its whole text, without a shuffle.

Defined results: null and empty texts have no features and get the bias' score. Repeated rows get equal
scores. Labels that are null, and labelled doc_ids with contradicting labels, teach nothing; of rows that share a doc_id the
one with the least text teaches. Without any
training row every score is 0. Columns of the input other than doc_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as bo
from .ftrl import Ftrl, probabilities
from .tables import Scratch, table

BITS, SAMPLE, STEPS, FEATURES = 18, 16384, 40_000, 1 << 25
PENALTIES = {"alpha": 1.0, "beta": 1.0, "l2": 0.01}


def features(texts: pa.Array, bits: int = BITS):
    """(row, sorted distinct feature indices) of each text."""
    for i, j, buf, offs in bo.slices(texts):
        low = bo.LOWER[buf]
        starts, ends, rows = bo.spans(bo.LETTERS[low], offs)
        words = bo.word_hashes(low, starts, ends)
        two, at2 = bo.grams(words, rows, 2)
        skip, at3 = bo.grams(words, rows, 2, (0, 2))
        ids = [(x >> bo.U64(64 - bits)).astype(np.int64) for x in (words, two, skip)]
        edge = np.arange(j - i + 1)
        cuts = [np.searchsorted(r, edge) for r in (rows, rows[at2], rows[at3])]
        for k in range(j - i):
            yield i + k, np.unique(np.concatenate([x[c[k] : c[k + 1]] for x, c in zip(ids, cuts, strict=True)]))


def _sampled(ids: DataFrame, n: int) -> DataFrame:
    """The n rows with the smallest hashes of doc_id; n bounds what the driver gathers and what is broadcast."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """(indices, weights, bias) learnt from the labelled rows whose doc_id is allowed: crc32(doc_id) mod 5 is not 0."""
    spark = docs.sparkSession
    taught = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("label"), F.max("toxic").alias("other"))
        .where("label = other")
        .select("doc_id", "label")
    )
    picked = Scratch(spark, "toxicity").write(_sampled(taught, sample), "sample")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # at most `sample` rows

    def featured(batches):
        for b in batches:
            for row, idx in features(b["text"]):
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([b["doc_id"][row].as_py()], pa.int64()), "label": pa.array([b["label"][row].as_py()], pa.int32()), "idx": pa.array([idx.astype(np.int32)], pa.list_(pa.int32()))})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        model = Ftrl((1 << BITS) + 1, l1=math.sqrt(len(pdf)) / 8, **PENALTIES)
        pdf = pdf.assign(order=bo.mix(pdf["doc_id"].to_numpy(np.int64).view(np.uint64))).sort_values(["order", "doc_id"])
        examples = [(np.append(x, 1 << BITS).astype(np.int64), int(y)) for x, y in zip(pdf["idx"], pdf["label"], strict=True)]
        for _ in range(min(20, max(2, -(-STEPS // len(examples))))):
            for idx, y in examples:
                model.step(idx, np.ones(len(idx)), y)
        w = model.weights(slice(None))[:, 0]
        at = np.flatnonzero(w)
        return pd.DataFrame({"idx": at.astype(np.int64), "w": w[at]})

    examples = rows.select("doc_id", "label", "text").mapInArrow(featured, "doc_id bigint, label int, idx array<int>")
    sizes = Scratch(spark, "toxicity").write(examples.withColumn("order", F.xxhash64("doc_id")), "examples")
    before = Window.orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # over at most `sample` rows of two numbers
    fits = sizes.select("doc_id", F.coalesce(F.sum(F.size("idx")).over(before), F.lit(0)).alias("before"), "order").where(F.col("before") < FEATURES).select("doc_id")
    examples = sizes.drop("order").join(fits, "doc_id", "left_semi")
    weights = examples.withColumn("one", F.lit("all")).groupBy("one").applyInPandas(fit, "idx bigint, w double").withColumn("w", F.round("w", 9))
    kept = weights.where("w != 0").toPandas().sort_values("idx")  # a row for each feature and the bias at most
    bias = kept.loc[kept["idx"] == 1 << BITS, "w"].sum()
    kept = kept[kept["idx"] != 1 << BITS]
    return kept["idx"].to_numpy(np.int64), kept["w"].to_numpy(), float(bias)


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def _probabilities(batches, model: tuple[np.ndarray, np.ndarray, float]):
    """Each batch with the score of its every text."""
    at, w, bias = model
    dense = np.zeros(1 << BITS)
    dense[at] = w
    for b in batches:
        logits = np.full(b.num_rows, bias)
        for row, idx in features(b["text"]):
            logits[row] += dense[idx].sum()
        p = np.round(probabilities(logits[:, None])[:, 0], 9)
        yield b, p if len(at) or bias else np.zeros_like(p)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """Adds `score` double and `predicted` int to docs' rows (columns of those names are replaced); one scan, no shuffle."""
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for b, p in _probabilities(batches, model):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the model rejects (score of 0.5 or more); all columns stay as they are."""
    model = train(docs, table(spark, sf_dir, "labels"))

    def run(batches):
        for b, p in _probabilities(batches, model):
            yield b.filter(pa.array(p < 0.5))

    return docs.mapInArrow(run, T.StructType(list(docs.schema.fields)))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
