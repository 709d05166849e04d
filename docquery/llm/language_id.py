"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, every run of characters that aren't letters is one space, and
n-grams of 1 to 3 characters are hashed to ``2 ** BITS`` features with value (1 + ln count) * idf, of unit length.
The idf comes from all rows that may be learnt from. The model is fitted by follow-the-regularised-leader
with elastic-net penalties on a bounded sample of them (``SAMPLE`` documents, those with the smallest hashes of
doc_id; it bounds the number of languages too); a fifth of the sample is set aside to calibrate the temperature of the softmax. Every row is then
predicted over its whole text in one scan.

Defined results: a null text, or one without letter, is `und` with score 0; so is every row if nothing could
be learnt. Repeated rows get equal results; of rows that share a doc_id the least (lang, text) teaches. Rows with null doc_id or lang teach nothing; an empty table
gives no rows. Columns other than doc_id, text and (for learning) lang aren't read.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as bo
from .ftrl import Ftrl, probabilities, temperature
from .tables import Scratch, table

BITS, SAMPLE, STEPS = 14, 4096, 16_000
PENALTIES = {"alpha": 0.5, "beta": 1.0, "l1": 0.02, "l2": 0.02}


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _counts(texts: pa.Array):
    """(row, feature indices, counts) of each text; no indices without letters."""
    letters = _letters()
    for row, t in enumerate(texts):
        x = np.frombuffer((t.as_py() or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[x]
        if not is_letter.any():
            yield row, np.zeros(0, np.int64), np.zeros(0)
            continue
        x = np.where(is_letter, x, np.uint32(32))
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
        x = np.concatenate(([32], x[keep], [32])).astype(np.uint32)
        one = x * np.uint32(0x9E3779B1)
        two = one[:-1] + x[1:] * np.uint32(0x85EBCA77) + np.uint32(1)
        three = two[:-1] + x[2:] * np.uint32(0xC2B2AE3D) + np.uint32(1)
        ids = np.concatenate((one, two, three))
        ids = (ids ^ ids >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        c = np.bincount((ids ^ ids >> np.uint32(12)) * np.uint32(0x297A2D39) >> np.uint32(32 - BITS), minlength=1 << BITS)
        at = np.flatnonzero(c)
        yield row, at, c[at]


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def _values(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf
    return v / max(1e-12, float(np.sqrt((v * v).sum())))


def train(docs: DataFrame) -> dict:
    """The model from the rows of (doc_id, text, lang) whose doc_id is allowed: crc32(doc_id) mod 4 is not 2."""
    spark = docs.sparkSession
    allowed = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")

    def df_counts(batches):
        df, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for _, at, _ in _counts(b["text"]):
                df[at] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"idx": pa.array([-1, *at], pa.int64()), "n": pa.array([n, *df[at]], pa.int64())})

    df = allowed.select("text").mapInArrow(df_counts, "idx bigint, n bigint").groupBy("idx").agg(F.sum("n").alias("n")).toPandas()  # 2 ** BITS + 1 rows at most
    total = int(df.loc[df["idx"] == -1, "n"].sum())
    idf = np.zeros(1 << BITS)
    df = df[df["idx"] >= 0]
    idf[df["idx"].to_numpy()] = np.log((1 + total) / (1 + df["n"].to_numpy())) + 0.1

    ids = allowed.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).distinct()
    ids = Scratch(spark, "language").write(ids, "sample")

    def featured(batches):
        for b in batches:
            for row, at, c in _counts(b["text"]):
                if len(at):
                    yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"].slice(row, 1), "lang": b["lang"].slice(row, 1), "idx": bo.lists([at], pa.int64()), "val": pa.array([_values(c, idf[at])], pa.list_(pa.float64()))})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        order = bo.mix(pdf["doc_id"].to_numpy(np.int64).view(np.uint64))
        pdf = pdf.assign(order=order).sort_values(["order", "doc_id", "lang"]).reset_index(drop=True)
        langs = sorted(set(pdf["lang"]))
        y = [langs.index(x) for x in pdf["lang"]]
        xs = [(i, v) for i, v in zip(pdf["idx"], pdf["val"], strict=True)]
        calibrate = [k for k in range(len(y)) if k % 5 == 4]
        learn = [k for k in range(len(y)) if k % 5 != 4]
        model = Ftrl(1 << BITS, max(2, len(langs)), **PENALTIES)
        for _ in range(min(20, max(2, -(-STEPS // max(1, len(learn)))))):
            for k in learn:
                model.step(*xs[k], y[k])
        w = model.weights(slice(None))
        logits = np.array([v @ w[i] for i, v in (xs[k] for k in calibrate)]).reshape(len(calibrate), -1)
        t = temperature(logits, np.array([y[k] for k in calibrate], np.int64))
        at, k = np.nonzero(w)
        rows = [(-1, "", t), *[(-2, lang, float(i)) for i, lang in enumerate(langs)]]
        return pd.concat([pd.DataFrame(rows, columns=["idx", "lang", "w"]), pd.DataFrame({"idx": at.astype(np.int64), "lang": [langs[c] if c < len(langs) else "" for c in k], "w": w[at, k]})])

    examples = allowed.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x")).select("doc_id", "x.*").mapInArrow(featured, "doc_id bigint, lang string, idx array<bigint>, val array<double>")
    fitted = examples.withColumn("one", F.lit("all")).groupBy("one").applyInPandas(fit, "idx bigint, lang string, w double").toPandas()
    langs = list(fitted[fitted["idx"] == -2].sort_values("w")["lang"])
    w = np.zeros((1 << BITS, max(1, len(langs))))
    own = fitted[(fitted["idx"] >= 0) & (fitted["lang"] != "")]
    w[own["idx"].to_numpy(), [langs.index(x) for x in own["lang"]]] = own["w"].to_numpy()
    return {"langs": langs, "idf": idf, "w": w.astype(np.float32), "t": float(fitted.loc[fitted["idx"] == -1, "w"].sum()) or 1.0}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score of each row of (doc_id, text)."""
    langs, idf, w, t = model["langs"], model["idf"], model["w"], model["t"]

    def run(batches):
        for b in batches:
            best, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            for row, at, c in _counts(b["text"]):
                if len(at) and langs:
                    logits = _values(c, idf[at]) @ w[at] / t
                    p = probabilities(logits) if len(langs) > 1 else np.ones(1)
                    k = int(p.argmax())
                    best[row], score[row] = langs[k], round(float(p[k]), 6)
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "lang_pred": pa.array(best), "score": pa.array(score)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
ORACLES: dict[str, str] = {}
