"""Mixing sources to target weights by entropy balancing, in DataFrame functions alone.

Document i of source s is taken at a rate r_i of CAP at most. Among all rates with sum(size_i * r_i) = target_s, the
relative entropy to taking each once, sum(r_i ln r_i - r_i + 1), is least at r_i = min(CAP, exp(lambda_s * size_i)): rates are
exponentially tilted by the document's own size. lambda_s is where the convex dual's gradient, target_s - sum(size_i * r_i), is zero.
Newton's iterations find it for all sources at once; gradient and Hessian of each are an aggregation of the (source, size,
documents) table, into which one scan of the corpus is aggregated. An iterate that leaves the bracket known so far is replaced by
the bracket's middle. States of the iterations are written tables, so lineage stays short.

Rates become copies by systematic rounding: with a source's documents in order of size, and c the sum of the rates so far
(exact decimals), a document gets floor(c + 1/2) - floor(c - r + 1/2) copies, at most CAP. Neighbours in that order are of about
equal size, so the words taken miss the target by little more than one document. Sums before a document come from counts
of cells (source, size, bucket of doc_id) plus a row number within a cell, so that a source with a third of all rows, or a
third of all rows of one size, is no single task.

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating, and share SHARE times all words;
a target stops at CAP times its source's size, and the excess is shared by weight among the others
until none is above (found in closed form: sources in order of cap over weight fill up first).

Defined results: null texts have size 0; documents of size 0 are taken 0 times; null doc_ids are ranked as
rows of their own; repeated rows count each; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Scratch, table

WEIGHTS, SHARE, CAP, BUCKETS, NEWTON, EXACT = (5, 2, 1), 1.5, 2.0, 256, 100, 1e-12
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame) -> DataFrame:
    """Adds `target` to (source, source_size). One row a source, so a window over all of them is small."""
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), ((F.col("nth") - 1) % len(WEIGHTS) + 1).cast("int"))
    fill = Window.orderBy("fill", "nth").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    out = sources.withColumn("nth", nth).withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(CAP)).withColumn("fill", F.col("cap") / F.col("w"))
    out = out.withColumn("filled", F.coalesce(F.sum("cap").over(fill), F.lit(0.0))).withColumn("rest_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(fill), F.lit(0.0)))
    out = out.withColumn("level", (F.lit(SHARE) * F.sum("source_size").over(every) - F.col("filled")) / F.col("rest_w"))
    # the first source, in filling order, that stays below its cap sets the level of all after it
    out = out.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("fill", "nth", "level"))).over(every)["level"])
    return out.select("source", "source_size", F.round(F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))), 6).alias("target"))


def tilted(size, lam):
    """The rate of a document; without lam, its source is taken whole to the cap."""
    return F.when(size <= 0, 0.0).otherwise(F.coalesce(F.least(F.lit(CAP), F.exp(lam * size)), F.lit(CAP)))


def solve(sizes: DataFrame, goals: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds `lam` to goals (source, source_size, target), from sizes (source, size, rows); null where the target is the cap.

    sum(size * exp(lam * size)) lies between the bracket's ends: at ln(target / source_size) below 0 each document of a word or more
    takes that share of its words at most, at ln CAP each is at its cap.
    """
    total = F.col("source_size").cast("double")
    state = goals.where((F.col("target") > 0) & (F.col("target") < CAP * total)).select("source", "target", F.lit(0.0).alias("lam"), F.least(F.lit(0.0), F.log(F.col("target") / total)).alias("lo"), F.log(F.lit(CAP)).alias("hi"), F.lit(True).alias("open"))
    size, lam = F.col("size").cast("double"), F.col("lam")
    for k in range(NEWTON):
        rate = F.least(F.lit(CAP), F.exp(lam * size))
        slope = F.when(lam * size < F.log(F.lit(CAP)), F.col("rows") * size * size * rate).otherwise(0.0)
        at = sizes.alias("c").join(state.alias("s"), F.expr("c.source <=> s.source")).groupBy("s.source", "target", "lam", "lo", "hi").agg(F.sum(F.col("rows") * size * rate).alias("f"), F.sum(slope).alias("d"))
        at = at.withColumn("lo", F.when(F.col("f") < F.col("target"), lam).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("f") < F.col("target"), F.col("hi")).otherwise(lam))
        step = lam + (F.col("target") - F.col("f")) / F.col("d")
        inside = (F.col("d") > 0) & (step > F.col("lo")) & (step < F.col("hi"))
        middle = (F.col("lo") + F.col("hi")) / 2
        done = (F.abs(F.col("target") - F.col("f")) <= EXACT * F.col("target")) | (middle <= F.col("lo")) | (middle >= F.col("hi"))
        state = scratch.write(at.select("source", "target", F.when(done, lam).when(inside, step).otherwise(middle).alias("lam"), "lo", "hi", (~done).alias("open")), f"newton-{k}")
        if k:
            scratch.drop(f"newton-{k - 1}")
        if state.where("open").isEmpty():
            break
    return goals.alias("g").join(state.alias("s"), F.expr("g.source <=> s.source"), "left").select("g.source", "source_size", "g.target", "lam")


def mix(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken of every row of (doc_id, text, source).

    whole: with all other columns of docs, but for those that have a result's name.
    """
    held = [F.struct(*docs.columns).alias("doc")] if whole else []
    scratch = Scratch(docs.sparkSession, "mixing")
    bucket = F.coalesce(F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 2), 16, 10).cast("int"), F.lit(0)) % BUCKETS
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), bucket.alias("bucket"), *held)
    sized = scratch.write(sized, "sized")
    cells = scratch.write(sized.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("rows")), "cells")
    sizes = scratch.write(cells.groupBy("source", "size").agg(F.sum("rows").alias("rows")), "sizes")
    goals = scratch.write(targets(sizes.groupBy("source").agg(F.sum(F.col("rows") * F.col("size")).alias("source_size"))), "goals")
    rates = solve(sizes, goals, scratch)
    rate = F.round(tilted(F.col("size"), F.col("lam")), 9).cast("decimal(12,9)")
    rates = sizes.alias("c").join(rates.alias("r"), F.expr("c.source <=> r.source")).select("c.source", "size", "rows", "source_size", "target", rate.alias("rate"))
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rates = rates.withColumn("before", F.coalesce(F.sum((F.col("rate") * F.col("rows")).cast("decimal(28,9)")).over(smaller), F.lit(0)).cast("decimal(28,9)")).drop("rows")
    former = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("first", F.coalesce(F.sum("rows").over(former), F.lit(0)))
    cells = cells.alias("c").join(rates.alias("r"), F.expr("c.source <=> r.source AND c.size = r.size")).select("c.source", "c.size", "bucket", "first", "before", "source_size", "target", "rate")
    out = sized.alias("d").join(cells.alias("c"), F.expr("d.source <=> c.source AND d.size = c.size AND d.bucket = c.bucket"))
    out = out.select("d.doc_id", "d.source", "d.bucket", "d.size", "first", "before", "source_size", "target", "rate", *["d.doc"] * whole)
    k = F.col("first") + F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("doc_id"))
    at = lambda n: F.floor(F.col("before") + F.col("rate") * n.cast("decimal(16,0)") + F.lit("0.5").cast("decimal(2,1)"))
    out = out.withColumn("k", k).withColumn("copies", (at(F.col("k")) - at(F.col("k") - 1)).cast("long"))
    results = ["doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken"]
    others = [F.col("doc")[c].alias(c) for c in docs.columns if c not in results] if whole else []
    return out.withColumn("rate", F.col("rate").cast("double")).withColumn("taken", F.col("copies") * F.col("size")).select(*results, *others)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: the documents that are taken, with all their columns, and how often each is."""
    return mix(docs, whole=True).where("copies > 0")


ORACLES = {
    "op3_mixing": r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 2))::INT, 0) % 256 AS bucket FROM documents
), sources AS (
  SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM sized GROUP BY source)
), filling AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS filled, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest_w
  FROM sources WINDOW before AS (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources) - filled) / rest_w AS own FROM filling
), targets AS (
  SELECT source, nth, source_size, round(least(cap, coalesce((SELECT own FROM levels WHERE own * w <= cap ORDER BY cap / w, nth LIMIT 1) * w, cap)), 6) AS target FROM levels
), sizes AS (
  SELECT nth, size::DOUBLE AS size, count(*)::DOUBLE AS n FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source GROUP BY ALL
), bracket AS (  -- the dual's gradient is monotone: its root by halving
  SELECT nth, target, least(0::DOUBLE, ln(target / source_size)) AS lo, ln(2::DOUBLE) AS hi, 0 AS k FROM targets WHERE target > 0 AND target < source_size * 2.0::DOUBLE
  UNION ALL
  SELECT nth, target, CASE WHEN f < target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN f < target THEN hi ELSE (lo + hi) / 2 END, k + 1
  FROM (SELECT b.nth, b.target, b.lo, b.hi, b.k, sum(s.n * s.size * least(2::DOUBLE, exp((b.lo + b.hi) / 2 * s.size))) AS f
        FROM bracket b JOIN sizes s ON s.nth = b.nth WHERE b.k < 90 GROUP BY ALL)
), ranked AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.nth, d.bucket,
         round(CASE WHEN d.size = 0 THEN 0::DOUBLE ELSE coalesce(least(2::DOUBLE, exp((b.lo + b.hi) / 2 * d.size)), 2::DOUBLE) END, 9)::DECIMAL(28, 9) AS rate
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN bracket b ON b.nth = t.nth AND b.k = 90
), summed AS (
  SELECT *, sum(rate) OVER (PARTITION BY nth ORDER BY size, bucket, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)::DECIMAL(28, 9) AS c FROM ranked
)
SELECT doc_id, size, source_size, target, ((floor(c + 0.5::DECIMAL(2, 1)) - floor(c - rate + 0.5::DECIMAL(2, 1))) * size)::BIGINT AS taken FROM summed
"""
}
QUERIES = {"op3_mixing": op3_mixing}
