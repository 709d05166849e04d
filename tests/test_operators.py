"""Operators on small fixtures, against plain restatements of their rules."""

from __future__ import annotations

import io
import math
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquery import models
from docquery.functions import content, query, text, vectors
from docquery.operators import canonical, chunking, context, guard, lexical, retrieval, sections
from docquery.plans import answer, ingest
from docquery.sources import files
from docquery.streaming import ingest as streaming

few = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize("n", [0, 1, 600, 601, 1050, 1051, 2400, 2401])
def test_windows_cover_the_text(spark, n):
    s = "".join(chr(97 + k % 26) for k in range(n))
    got = one(spark, s, chunking.windows)
    want, at = [], 0
    while True:
        want.append(s[at : at + 600])
        if at + 600 >= n:
            break
        at += 450
    assert got == [w for w in want if w]


def test_blocks_pack_sentences(spark):
    s = ". ".join(["x" * 700] * 8) + "."
    got = one(spark, s, chunking.blocks)
    assert [len(b) for b in got] == [2105, 2105, 1404]
    assert got[-1].endswith("..")
    assert one(spark, "short\n\nlong enough to stay", chunking.blocks) == ["long enough to stay"]


def test_text_pages_flush_before_overflow(spark):
    assert one(spark, "", chunking.text_pages) == ["(Empty file)"]
    got = one(spark, "\n".join(["y" * 1999] * 5), chunking.text_pages)
    assert [len(p) for p in got] == [3999, 3999, 1999]


@pytest.mark.parametrize(("cell", "want"), [("200A", {"c": 200.0, "amps": 200.0}), ("13-5/16", {"c": 13.3125}), ("4-2/0 MCM", {"c": 4.0}), ("36 (362)", {"c": 36.0, "c_mm": 362.0}), ("14 1/4 (362)", {"c": 14.0}), ("480V", {"c": 480.0, "volts": 480.0}), ("n/a", {}), ("5-1/0", {})])
def test_numbers(spark, cell, want):
    assert one(spark, {"c": cell}, canonical.numbers, "map<string,string>") == want


def test_notes_in_both_forms(spark):
    assert one(spark, {"a": "5 ①", "b": "6 [Note 2]"}, canonical.notes, "map<string,string>") == {"①": "", "②": ""}


@pytest.mark.parametrize(("q", "want"), [("DK10-1A and ECL2412SD", ["DK10-1A", "ECL2412SD"]), ("eql40200d", [])])
def test_catalogue_patterns(spark, q, want):
    assert one(spark, q, query.catalogue_patterns) == want


def test_filters(spark):
    f = one(spark, "pages 10 to 15 of the electrical guide", query.filters)
    assert (f["page_from"], f["page_to"], f["page"], f["target_file"]) == (10, 15, None, "electrical")
    assert one(spark, "wiring in section 3.2", query.filters)["section"] == "3.2"
    assert all(v is None for v in one(spark, "What is a DC sensor?", query.filters))


def test_decompose(spark):
    assert one(spark, "What is a contactor and how does it differ from a relay?", query.decompose) == ["What is a contactor and how does it differ from a relay?", "What is a contactor?", "how does it differ from a relay?"]
    assert len(one(spark, "difference between a relay and a contactor", query.decompose)) == 4


def test_cosine_and_quantisation(spark):
    e = spark.createDataFrame([(0, [1.0, 0.0, 0.5]), (1, [0.0, 0.0, 0.0]), (2, [-1.0, 2.0])], "vec_id int, embedding array<double>")
    got = [r[0] for r in e.select(vectors.cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.5)))).collect()]
    assert got[0] == pytest.approx(1) and got[1] == 0 and got[2] == pytest.approx(-1 / math.sqrt(5))
    c = vectors.calibrate(e).first()
    q = e.select(vectors.dequantize(vectors.quantize(F.col("embedding"), F.lit(c["scale"]), F.lit(c["zero_point"])), F.lit(c["scale"]), F.lit(c["zero_point"])).alias("x")).first()["x"]
    assert q == pytest.approx([1.0, 0.0, 0.5], abs=c["scale"])


def test_hashing_embedders(spark):
    v = vectors.hash_vector("Pump pump drive")
    assert sum(x * x for x in v) == pytest.approx(1) and v == vectors.hash_vector("pump PUMP drive")
    n = one(spark, "pump drive", lambda c: vectors.native_embedding(c, 16))
    assert sum(x * x for x in n) == pytest.approx(1)


def test_lsh_finds_itself(spark):
    e = spark.createDataFrame([(k, [float((k * 7 + j * 3) % 11 - 5) for j in range(8)]) for k in range(40)], "vec_id int, embedding array<double>")
    q = e.withColumnRenamed("vec_id", "query_id")
    got = vectors.top_k(q, e, 1, planes=4).where("query_id % 11 = item_id % 11").count()
    assert got == 40


def test_fusion_ignores_list_order_and_boosts_exact(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, doc_id int, rank int")
    x = spark.createDataFrame([(1, 12, 2.0)], "query_id int, doc_id int, score double")
    one_way = retrieval.fuse({"dense": a, "bm25": b}, exact=x).orderBy("rank").collect()
    other = retrieval.fuse({"bm25": b, "dense": a}, exact=x).orderBy("rank").collect()
    assert one_way == other and [r["doc_id"] for r in one_way] == [12, 11, 10] and one_way[0]["score"] == 2.0


def test_mmr_is_a_permutation_prefix(spark):
    c = spark.createDataFrame([(1, k, k, [1.0, 0.2], [1.0, k / 10]) for k in range(30)], "query_id int, doc_id int, rank int, q array<double>, embedding array<double>")
    got = [r["doc_id"] for r in retrieval.mmr(c).orderBy("pos").collect()]
    assert len(got) == len(set(got)) == 20 and got[0] == 2


def test_near_duplicates_replace_and_are_idempotent(spark):
    words = " ".join(f"w{k}" for k in range(50))
    c = spark.createDataFrame([(1, 0, 1, 0.5, words), (1, 1, 2, 0.9, words + " x"), (1, 2, 3, 0.1, "other text")], "query_id int, doc_id int, rank int, score double, text string")
    assert [r["doc_id"] for r in retrieval.near_duplicates(c).orderBy("pos").collect()] == [1, 2]
    kept = c.join(retrieval.near_duplicates(c).select("doc_id"), "doc_id")
    assert retrieval.near_duplicates(kept).count() == 2


def test_budgets(spark):
    c = spark.createDataFrame([(1, 1, 1, "a" * 60), (1, 2, 2, "b" * 60), (1, 3, 3, "c" * 30)], "query_id int, chunk_id bigint, pos int, text string")
    assert [r["chunk_id"] for r in context.token_budget(c, 100).collect()] == [1]
    assert sorted(r["chunk_id"] for r in context.greedy_budget(c, 100).collect()) == [1, 3]
    assert [r["chunk_id"] for r in context.token_budget(c, 10).collect()] == [1]


def test_optimize(spark):
    c = spark.createDataFrame([(1, 1, 1, 0.5, "same text", "s", 1), (1, 2, 2, 0.4, "same text", "s", 2), (1, 3, 3, 0.3, "more", "s", 0)], "query_id int, chunk_id bigint, rank int, score double, text string, source string, section int")
    got = context.optimize(c, "document_order").orderBy("pos").collect()
    assert [r["chunk_id"] for r in got] == [3, 1] and not got[0]["map_reduce"]


def test_grounding_without_candidates(spark):
    q = spark.createDataFrame([(1, "pump pressure limits today"), (2, "the of")], "query_id int, text string")
    c = spark.createDataFrame([(1, 1, "the pump has limits")], "query_id int, rank int, text string")
    got = {r["query_id"]: r for r in guard.grounding(q, c).collect()}
    assert got[1]["keyword_overlap"] == 0.5 and got[1]["is_grounded"] and not got[2]["is_grounded"]


def test_cache_needs_equal_identifiers(spark):
    import datetime as dt

    now = dt.datetime(2024, 1, 2)
    keys = "tenant_id string, user_id string, model string, corpus_version string, scope string, text string, embedding array<double>"
    row = ("t", "u", "m", "1", "all")
    cache = spark.createDataFrame([(*row, "rating of A10", [1.0, 0.0], "ten", now)], keys + ", response string, created_at timestamp")
    q = spark.createDataFrame([(1, *row, "Rating  of a10", [0.0, 1.0]), (2, *row, "ratings of A10", [1.0, 0.01]), (3, *row, "rating of A11", [1.0, 0.0])], "query_id int, " + keys)
    got = {r["query_id"]: r["similarity"] for r in guard.cached(q, cache, F.lit(now)).collect()}
    assert got[1] == 1.0 and got[2] > 0.95 and 3 not in got


def test_content_types_of_prose(spark):
    assert one(spark, "Water runs down the hill", lambda c: content.classify(c)["content_type"]) == "paragraph"
    assert one(spark, "It is true that water runs", lambda c: content.classify(c)["content_type"]) == "true_false"
    assert one(spark, "It is true that water runs", lambda c: content.classify(c, strict=True)["content_type"]) == "paragraph"


def test_section_retrieval(spark):
    s = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C")], "section_id string, parent_id string, title string")
    c = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "section_id string, chunk_id int")
    w = spark.createDataFrame([(1, "b")], "query_id int, section_id string")
    assert sorted(r["chunk_id"] for r in sections.section_chunks(w, s, c).collect()) == [2, 3]
    assert sections.paths(s).where("section_id = 'c'").first()["heading_path"] == ["A", "B", "C"]


def test_strip_table_lines(spark):
    df = spark.createDataFrame([("Model Amps A1 10\nPumps move water far\n\nkeep", ["| Model | Amps |\n|---|---|\n| A1 | 10 |"])], "t string, tables array<string>")
    assert df.select(text.strip_table_lines(F.col("t"), F.col("tables"))).first()[0] == "Pumps move water far\n\nkeep"


def test_ingest_and_answer(spark):
    pages = spark.createDataFrame([("/d/pump.md", 1, "# Pump\nThe pump delivers 40 litres a minute at full speed.", "text"), ("/d/pump.md", 2, "## Limits\nThe motor of the pump must stay below 70 degrees.", "text")], "doc_id string, page_num int, text string, file_type string")
    t = ingest.ingest(pages, native=True)
    chunks = t["chunks"].cache()
    assert chunks.count() == 2 and chunks.where("section_title = 'Limits'").count() == 1
    assert ingest.ingest(pages, stored=chunks, native=True)["chunks"].count() == 0
    q = spark.createDataFrame([(1, "what must the motor temperature of the pump be"), (2, "hello"), (3, "zebra quantum")], "query_id int, text string")
    got = {r["query_id"]: r for r in answer.answer(q, chunks.withColumn("section", F.lit(0))).collect()}
    assert "70 degrees" in got[1]["answer"] and got[2]["answer"] == answer.GREETING_ANSWER and got[3]["answer"] == guard.NOT_FOUND


def test_summaries_and_plans(spark):
    c = spark.createDataFrame([(1, k, f"Sentence number {k} of the text. More of it.") for k in range(1, 8)], "query_id int, rank int, text string")
    assert answer.summarize(c).first()["summary"].count("Sentence") == 7
    assert answer.hypothetical(c.select("query_id", "text")).count() == 0


def test_models_are_pluggable(spark):
    models.register_llm("echo", lambda p: F.lit("generated"))
    try:
        assert one(spark, "x", lambda c: models.generate(c, F.lit("default"))) == "generated"
    finally:
        models.reset()
    assert one(spark, "x", lambda c: models.generate(c, F.lit("default"))) == "default"
    with pytest.raises(ValueError):
        models.validate(production=True)


def test_parse_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.csv").write_text('k,v\n"x, y",1\n,2\n')
    (tmp_path / "c.html").write_text("<html><script>x</script><h1>T</h1><p>body</p></html>")
    (tmp_path / ".hidden.txt").write_text("no")
    (tmp_path / "m.eml").write_bytes(b"Subject: Hi\nFrom: a@b\n\nhello")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("in/d.py", "x = 1")
        f.writestr("../evil.txt", "no")
    (tmp_path / "z.zip").write_bytes(z.getvalue())
    got = {r["path"].rsplit("/", 1)[-1]: r for r in files.parse(files.unpacked(files.scan(spark, str(tmp_path)))).collect()}
    assert set(got) == {"a.txt", "b.csv", "c.html", "m.eml", "e.pdf", "d.py"}
    assert got["c.html"]["text"] == "T\nbody" and "Subject: Hi" in got["m.eml"]["text"] and not got["e.pdf"]["success"]
    assert got["b.csv"]["text"].split("\n") == ["[CSV DATA - Rows 1 to 2]", "| k | v |", "| x, y | 1 |", "| x, y | 2 |"]


def test_streaming_equals_batch_and_is_idempotent(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.txt").write_text("The first file has a line of text")
    run = lambda: streaming.start(spark, str(src), str(out), str(tmp_path / "cp"), available_now=True).awaitTermination()
    run()
    (src / "b.txt").write_text("The second file has another line")
    run()
    run()
    got = spark.read.parquet(str(out))
    assert got.count() == 2
    want = streaming.chunks_of(files.scan(spark, str(src)))
    assert sorted(r["chunk_hash"] for r in got.collect()) == sorted(r["chunk_hash"] for r in want.collect())


@few
@given(st.lists(st.text(alphabet="ab .\n", max_size=30), min_size=1, max_size=4))
def test_bm25_scores_only_documents_with_terms(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    q = spark.createDataFrame([(1, "ab b")], "query_id int, text string")
    got = {r["doc_id"] for r in lexical.bm25(q, lexical.postings(d), lexical.corpus_stats(d), 10).collect()}
    assert got == {k for k, t in enumerate(texts) if {"ab", "b"} & set(t.replace(".", " ").split())}


def test_office_files():
    import io
    import zipfile

    from docquery.sources import office

    def pack(parts: dict[str, str]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, xml in parts.items():
                z.writestr(name, xml)
        return out.getvalue()

    w = office.W[1:-1]
    doc = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert office.parse_docx("a.docx", pack({"word/document.xml": doc})) == ["One\ttwo\ncell"]
    ns = f'xmlns="{office.S[1:-1]}" xmlns:r="{office.R[1:-1]}"'
    book = {
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="B" r:id="r2"/><sheet name="A" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>Model</t></si><si><r><t>E</t></r><r><t>QL</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v> </v></c></row><row><c r="B3"><v>2.5</v></c><c r="C3" t="b"><v>1</v></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f'<worksheet {ns}><sheetData><row><c r="A1" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>',
    }
    assert office.parse_xlsx("a.xlsx", pack(book)) == ["[Sheet: B]\nx", "[Sheet: A]\nModel\t\tEQL\n\t2.5\tTRUE"]
    slide = lambda *t: f'<s xmlns:a="{office.A[1:-1]}">' + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in t) + "</s>"
    assert office.parse_pptx("a.pptx", pack({"ppt/slides/slide10.xml": slide("ten"), "ppt/slides/slide2.xml": slide("two", " ", "b")})) == ["two\nb", "ten"]


def test_generator_tiers(spark):
    from pyspark.sql import functions as F

    from docquery import models
    from docquery.plans import topics

    q = spark.createDataFrame([(1, "what does it do here then"), (2, "difference between a relay and a contactor")], "query_id long, text string")
    titles = spark.createDataFrame([("Zebra", 1, "")], "title string, level int, heading_path string")
    plain = {r["query_id"]: r for r in topics.classify(topics.filters(q)).join(topics.decompose(q), "query_id").collect()}
    models.register_llm("t", lambda p: F.when(p.startswith("Name the type"), "A procedure, I think").when(p.startswith("Split"), 'Yes: ["one thing?", "another?"]').when(p.startswith("File"), '{"target_file": "Drive Manual", "page": 4}').otherwise("- first one\n2. second one\nno"))
    try:
        told = {r["query_id"]: r for r in topics.classify(topics.filters(q)).join(topics.decompose(q), "query_id").collect()}
        lines = [r["text"] for r in topics.expansions(q.where("query_id = 1"), titles).orderBy("variant").collect()]
    finally:
        models.reset("llm")
    assert plain[1]["query_type"] == "fact" and plain[1]["parts"] == ["what does it do here then"] and plain[1]["filters"]["page"] is None
    assert told[1]["query_type"] == "procedure" and told[1]["parts"] == ["one thing?", "another?"] and (told[1]["filters"]["target_file"], told[1]["filters"]["page"]) == ("drive manual", 4)
    assert told[2]["query_type"] == plain[2]["query_type"] == "comparison" and told[2]["parts"] == plain[2]["parts"]
    assert lines == ["what does it do here then", "first one", "second one"]


def test_filters_before_the_top_k(spark):
    from docquery.plans import answer

    chunks = spark.createDataFrame([(k, f"valve torque {'valve ' * (k % 7)}", "a" if k % 2 else "b", f"/in/{'Welding' if k % 10 == 3 else 'Other'} Manual.pdf", k % 6) for k in range(300)], "chunk_id long, text string, tenant_id string, source string, page_num int")
    q = spark.createDataFrame([(1, "valve torque on page 3 of the welding manual", "a"), (2, "valve torque", "b")], "query_id long, text string, tenant_id string")
    from docquery.functions import query as fq
    from pyspark.sql import functions as F

    got = answer.retrieve(q.withColumn("filters", fq.filters(F.col("text"))), chunks, 5).collect()
    one, two = ({r["chunk_id"] for r in got if r["query_id"] == n} for n in (1, 2))
    assert one and all(k % 2 == 1 and k % 10 == 3 and k % 6 == 3 for k in one) and len(two) == 5 and all(k % 2 == 0 for k in two)


def test_scored_scan_of_nulls_and_empty_tables(spark):
    q = spark.createDataFrame([(1, "valve torque"), (2, "the of"), (3, None)], "query_id int, text string")
    d = spark.createDataFrame([("a", "valve valve"), ("b", None), ("c", "torque of valve"), ("d", "nothing")], "doc_id string, text string")
    assert [(r["query_id"], r["doc_id"]) for r in lexical.bm25_scan(q, d, 2).orderBy("rank").collect()] == [(1, "c"), (1, "a")]
    assert [r["doc_id"] for r in lexical.bm25_scan(q, d, 2, match_all=True).collect()] == ["c"]
    assert lexical.bm25_scan(q.limit(0), d, 2).count() == 0 and lexical.bm25_scan(q, d.limit(0), 2).count() == 0
