"""What keeps queries in proportion to their input: results on rows where it could go wrong, and plans without the step that grew."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from docquery import queries
from docquery.functions import vectors
from docquery.operators import canonical, chunking, context, guard, lexical, sections, tables
from docquery.plans import topics


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# F2


def test_scorer_of_many_terms_is_set_up_at_once():
    n = 8000
    asked = pd.DataFrame({"query_id": np.repeat(np.arange(n), 4), "term": [f"t{i % 30011:06}" for i in range(4 * n)], "n_terms": 4, "idf": 1.0}).sort_values(["query_id", "term"])
    began = time.process_time()
    s = lexical._Scorer(asked, "doc_id", 3, 2.0, False, (pa.int64(), pa.int64()))
    assert time.process_time() - began < 5
    b = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([["t000000", "t000001"], ["t000000"]])], ["doc_id", "t"])
    got = [r for out in s([b]) for r in out.to_pylist()]
    assert {(r["query_id"], r["doc_id"]) for r in got} == {(q, d) for q, d in ((0, 7), (0, 8), (30011 // 4, 7), (30011 // 4, 8), (30012 // 4, 7))}


# F3, F4


def test_codes_of_more_than_five_digits(spark, tmp_path):
    spark.createDataFrame([(10000,), (7,)], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, "x", 3, 1.0) for k in (7, 10000, 70000, 100000, 100001)], "p_partkey bigint, p_name string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = queries.QUERIES["join_canonical_lookup"](spark, str(tmp_path)).collect()
    assert sorted((r["query_id"], r["row_index"]) for r in got) == [(7, 7), (10000, 10000)]
    assert sorted((r["pos"], r["row_index"]) for r in queries.QUERIES["join_rows_to_compare"](spark, str(tmp_path)).collect()) == [(7, 7), (10000, 10000)]


def test_codes_and_other_strings_in_cells(spark):
    store = spark.createDataFrame([(1, {"a": "see XEQL01D-7, then"}), (2, {"a": "Eql01D"}), (3, {"a": 'say "hi" now'})], "row_index int, cells map<string,string>").withColumn("row_id", F.col("row_index"))
    codes = spark.createDataFrame([(0, "EQL01D"), (1, '\\"hi'), (2, "QL01d-7"), (3, "EQL02")], "pos int, code string")
    found = canonical.for_comparison(codes, store)
    assert sorted((r["pos"], r["row_index"]) for r in found.collect()) == [(0, 1), (1, 3), (2, 1)]
    assert sorted((r["pos"], r["row_index"]) for r in canonical.rows_with(codes, store).select("pos", "row_index").distinct().collect()) == [(0, 1), (0, 2), (1, 3), (2, 1)]
    assert "run#" in plan(canonical.for_comparison(codes, store))


# F5


def test_cache_meets_by_text_then_by_distinct_vectors(spark):
    key = [F.lit("x").alias(c) for c in ("tenant_id", "user_id", "model", "corpus_version", "scope")]
    at = F.lit("2030-01-01 00:00:00").cast("timestamp")
    q = spark.createDataFrame([(1, "Size  of A1", [1.0, 0.0]), (2, "about a1", [1.0, 0.01]), (3, "about b2", [1.0, 0.0]), (4, None, [1.0, 0.0]), (5, "size of a1", [0.0, 1.0])], "query_id int, text string, embedding array<double>").select("*", *key)
    c = spark.createDataFrame([("size of a1 ", [0.0, 1.0], "exact", 2), ("size of a1", [0.0, 1.0], "newer", 1), ("what a1", [1.0, 0.0], "near", 3), ("what a1", [1.0, 0.0], "a near", 3), ("size of a1", [0.0, 1.0], "stale", 30)], "text string, embedding array<double>, response string, hours int")
    c = c.select("text", "embedding", "response", *key, (at - F.make_dt_interval(hours="hours")).alias("created_at"))
    found = guard.cached(q, c, at)
    assert sorted((r["query_id"], r["response"], r["similarity"] == 1.0) for r in found.collect()) == [(1, "newer", True), (2, "a near", False), (5, "newer", True)]
    joins = [line for line in plan(found).split("\n") if "Join [" in line]
    assert joins and all("norm" in line or "ids" in line for line in joins)


# F6


def test_image_chunks_of_blank_texts(spark, tmp_path, duck):
    rows = [(1, "a text", "src"), (2, " \n", "src"), (3, None, None), (4, "", " "), (5, "x", "")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["gen_image_chunks"](spark, str(tmp_path)).collect()
    want = duck.cursor().execute(queries.ORACLES["gen_image_chunks"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(got) == 8
    pages = spark.createDataFrame([(1, 1, ["a", " ", None])], "doc_id int, page_num int, image_texts array<string>")
    assert [r["text"] for r in chunking.image_chunks(pages).collect()] == ["a"]


# F7, F8, F10, F13


def test_nearest_vectors_are_exact(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((40, 6)).round(1)
    e = [*base.tolist(), *base[:30].tolist(), [0.0] * 6, [], None, [1.0, None, 2.0], *([base[0].tolist()] * 30), (base[1] * 3).tolist()]
    v = spark.createDataFrame([(k, f"t{k % 2}" if k % 7 else None, x) for k, x in enumerate(e)], "vec_id int, tenant_id string, embedding array<double>").repartition(3)
    q = v.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    both = v.select("vec_id", F.col("tenant_id").alias("own"), F.col("embedding").alias("v")).crossJoin(q.select("query_id", "tenant_id", "embedding"))
    score = F.round(vectors.cosine(F.col("embedding"), F.col("v")), 6).alias("score")
    for same in (False, True):
        want: dict = {}
        for x in (both.where("own = tenant_id") if same else both).select("query_id", "vec_id", score).collect():
            want.setdefault(x["query_id"], []).append((-x["score"], x["vec_id"]))
        if same:
            stored = v.select(F.col("vec_id").alias("section_id"), "tenant_id", F.lit("m").alias("embedding_model"), "embedding")
            found = topics.search_sections(q.withColumn("embedding_model", F.lit("m")), stored, 5).withColumnRenamed("section_id", "item_id")
        else:
            found = vectors.top_k(q, v, 5)
        got: dict = {}
        for x in found.orderBy("query_id", "rank").collect():
            got.setdefault(x["query_id"], []).append((-x["score"], x["item_id"]))
        assert got == {k: sorted(x)[:5] for k, x in want.items()}
        assert "MapInArrow" in plan(found) and "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert vectors.top_k(q.limit(0), v, 5).count() == 0


# F9


def test_subtitle_lines_are_parted_once():
    assert str(chunking.video_pages(F.col("c"))).count("split(") == str(chunking.text.subtitle_text(F.col("c"))).count("split(") + 1


# F11, F12


def test_lists_of_words_meet_titles_once(spark):
    q = spark.createDataFrame([(k, f"wiring {'drive' if k % 2 else 'motor'}") for k in range(50)], "query_id int, text string")
    s = spark.createDataFrame([("Wiring", 2, ""), ("Drive wiring", 1, ""), ("Wiring of the drive", 1, ""), ("Other", 1, "")], "title string, level int, heading_path string")
    lists = lexical.titles_of(q.select(lexical.title_words(F.col("text")).alias("words")), s)
    assert lists.select("words").distinct().count() == 2
    got = lexical.section_expansion(q, s).collect()
    assert sorted((r["rank"], r["title"]) for r in got if r["query_id"] == 1) == [(1, "Wiring of the drive")]
    assert sorted((r["rank"], r["title"]) for r in got if r["query_id"] == 2) == [(1, "Drive wiring"), (2, "Wiring of the drive"), (3, "Wiring")]


# F14, F15


def test_budgets_deal_out_lengths(spark, sf):
    df = spark.createDataFrame([("q", k, k, "x" * n) for k, n in enumerate((60, 50, 40, 1), 1)], "query_id string, chunk_id bigint, pos int, text string")
    for f, want in ((context.token_budget, [1]), (context.greedy_budget, [1, 3])):
        for d in (df, df.withColumn("chars", F.length("text")).drop("text")):
            assert sorted(r["chunk_id"] for r in f(d, 100).collect()) == want
    for name in ("win_token_budget", "win_greedy_budget"):
        p = plan(queries.QUERIES[name](spark, sf))
        assert all("length" not in line for line in p.split("\n") if "Window" in line) and "chars" in p


# F16


def test_embedder_gives_one_matrix_a_batch(spark):
    texts = ["a few words", None, "", "é ö", "a few words more"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", vectors.hashing_embedder(8)("t").alias("e")).orderBy("k")
    assert [r["e"] for r in got.collect()] == [vectors.hash_vector(t, 8) for t in texts]
    assert "ArrowEvalPython" in plan(got) and vectors.hashing_embedder().evalType == 250


# F17


def test_postings_are_scored_in_their_tasks(spark):
    q = spark.createDataFrame([(1, "valve torque"), (2, "torque of motor"), (3, "none")], "query_id int, text string")
    d = spark.createDataFrame([(k, " ".join(["valve"] * (k % 3) + ["torque"] * (k % 4) + ["word"] * k)) for k in range(40)] + [(1, "valve motor")], "doc_id int, text string")
    for match_all in (False, True):
        a = lexical.bm25(q, lexical.postings(d), lexical.corpus_stats(d), 5, match_all=match_all)
        assert "MapInArrow" in plan(a)
        b = lexical.bm25_scan(q, d.where("doc_id != 1 OR text != 'valve motor'"), 5, match_all=match_all)
        c = lexical.bm25(q, lexical.postings(d.where("doc_id != 1 OR text != 'valve motor'")), lexical.corpus_stats(d.where("doc_id != 1 OR text != 'valve motor'")), 5, match_all=match_all)
        assert sorted(map(tuple, b.collect())) == sorted(map(tuple, c.collect())) and a.count() > 0


# F18


def test_cells_are_sorted_once(spark):
    cells = spark.createDataFrame([("t", 0, r, x) for r, x in enumerate(("", "", "a", "", "b", ""))], "table_id string, col int, row int, text string")
    filled = tables.fill(cells)
    assert [r["text"] for r in filled.orderBy("row").collect()] == list("aaaabb") and plan(filled).count("Sort [") == 1


# F19


def test_chunks_by_heading_rank_titles(spark):
    c = spark.createDataFrame([(k, ["Wiring", "wiring of it", None, "Other"][k % 4], "src") for k in range(40)], "chunk_id int, section_title string, source string")
    w = spark.createDataFrame([(1, ["x", "WIRING"]), (2, ["wir"]), (3, ["nothing"])], "query_id int, heading_path array<string>")
    found = sections.by_heading(w, c, 5)
    assert sorted((r["query_id"], r["chunk_id"]) for r in found.collect()) == [(1, 0), (1, 4), (1, 8), (1, 12), (1, 16), (2, 0), (2, 1), (2, 4), (2, 5), (2, 8)]
    assert "WindowGroupLimit [title" in plan(found)
