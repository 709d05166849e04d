"""Retrieval along sections: section search, the topic route, parent sections, the expansion ladder, and the assembled context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import models
from ..functions import query, text
from ..functions import vectors as vec
from ..operators import context, lexical, retrieval, sections

TOP_SECTIONS, SECTION_CHUNKS, MOST_QUERIES = 5, 40, 6


def search_sections(queries: DataFrame, stored: DataFrame, top_k: int = TOP_SECTIONS) -> DataFrame:
    """(query_id, section_id, score, rank): the nearest sections of the query's own tenant and embedding model.

    queries: (query_id, tenant_id, embedding_model, embedding), the stated set; stored: (section_id, tenant_id, embedding_model, embedding).
    """
    found = vec.nearest(queries, stored.withColumnRenamed("section_id", "item_id"), top_k, ("tenant_id", "embedding_model"))
    return retrieval.ranked(found.select("query_id", F.col("item_id").alias("section_id"), F.round("score", 6).alias("score")), "section_id", top_k)


def by_topic(found: DataFrame, tree: DataFrame, chunks: DataFrame, most: int = SECTION_CHUNKS) -> DataFrame:
    """Chunks of the found sections (query_id, section_id, score, rank) and of those under them, with the found section's score.

    A chunk under several found sections belongs to the first; pos orders them by source and ordinal. chunks: (chunk_id, section_id, source, section, ...).
    """
    below = sections.descendants(tree).select(F.col("root_id").alias("section_id"), F.col("section_id").alias("own"))
    wanted = found.join(below, "section_id").groupBy("query_id", "own").agg(F.min_by(F.struct("section_id", "score"), "rank").alias("x"))
    j = chunks.join(wanted.withColumnRenamed("own", "section_id"), "section_id")
    j = j.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "section_id").orderBy("section", "chunk_id"))).where(F.col("k") <= most)
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("source", "section", "chunk_id"))
    return j.select("query_id", *chunks.columns, F.col("x.section_id").alias("found_section"), F.col("x.score").alias("section_score")).withColumn("pos", pos)


def parent_sections(seeds: DataFrame, chunks: DataFrame, most: int = SECTION_CHUNKS) -> DataFrame:
    """(query_id, chunk_id, level): the other chunks of a seed's section, in order, by the first of three ways that finds any.

    1: its section_id; 2: its heading path in the same document; 3: chunks within SECTION_RANGE places of it.
    seeds: (query_id, doc_id, section, section_id, heading_path); chunks the same but for query_id, with chunk_id.
    """
    s = seeds.select("query_id", *[F.col(c).alias(f"s_{c}") for c in ("doc_id", "section", "section_id", "heading_path")])
    one = chunks.join(s, F.col("section_id") == F.col("s_section_id")).withColumn("level", F.lit(1))
    same_doc = F.col("doc_id") == F.col("s_doc_id")
    two = chunks.join(s.where(F.size("s_heading_path") > 0), same_doc & (F.col("heading_path") == F.col("s_heading_path"))).withColumn("level", F.lit(2))
    near = s.withColumn("at", F.explode(F.sequence(F.greatest(F.col("s_section") - context.SECTION_RANGE, F.lit(0)), F.col("s_section") + context.SECTION_RANGE)))
    three = chunks.join(near, same_doc & (F.col("section") == F.col("at"))).drop("at").withColumn("level", F.lit(3))
    every = one.unionByName(two).unionByName(three).withColumn("first", F.min("level").over(Window.partitionBy("query_id"))).where("level = first")
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy("section", "chunk_id"))
    return every.select("query_id", "chunk_id", "section", "level").distinct().withColumn("pos", rn).where(F.col("pos") <= most)


def expansions(queries: DataFrame, titles: DataFrame, most: int = MOST_QUERIES) -> DataFrame:
    """(query_id, variant, text): the query, and the section titles that it names, else a generator's rephrasings, else aspects of its keywords.

    Each tier serves the queries that the one before has left without anything; repeats go.
    """
    asked = queries.withColumn("words", lexical.title_words(F.col("text")))
    toc = lexical.titles_of(asked, titles).groupBy("words").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("toc"))
    m = models.llm()
    made = F.lit(None).cast("array<string>") if m is None else lines_of(m.call(F.concat(F.lit(f"Rephrase as up to {most} search queries, one a line: "), "text")))
    q = asked.join(toc, "words", "left").withColumn("made", made)
    every = F.when(F.size("toc") > 0, F.concat(F.array("text"), "toc")).when(F.size("made") > 0, F.concat(F.array("text"), "made")).otherwise(query.expand(F.col("text"), most))
    return q.select("query_id", F.posexplode(F.slice(query.distinct_queries(every), 1, most + 1)).alias("variant", "text"))


def lines_of(reply):
    """The lines of a generator's reply of 5 characters or more, without bullets and numbers; null without a reply."""
    lines = F.transform(F.split(reply, "\n"), lambda s: text.strip(F.regexp_replace(s, r"^\s*(?:[-*]|\d+[.)])\s*", "")))
    return F.filter(lines, lambda s: F.length(s) >= 5)


def classify(queries: DataFrame) -> DataFrame:
    """Adds query_type: the rules' type; where they find none but fact and there is a generator, the first type that its reply names."""
    rule, m = query.query_type(F.col("text")), models.llm()
    if m is None:
        return queries.withColumn("query_type", rule)
    named = F.lit(None).cast("string")
    kinds = [s[0] for s in query.STRATEGIES]
    for kind in reversed(kinds):
        named = F.when(F.contains(F.lower("reply"), F.lit(kind)), kind).otherwise(named)
    asked = queries.withColumn("rule", rule).withColumn("reply", F.when(F.col("rule") == "fact", m.call(F.concat(F.lit("Name the type of the query, one of " + ", ".join(kinds) + ": "), "text"))))
    return asked.withColumn("query_type", F.when(F.col("rule") == "fact", F.coalesce(named, F.lit("fact"))).otherwise(F.col("rule"))).drop("rule", "reply")


def decompose(queries: DataFrame) -> DataFrame:
    """(query_id, parts): the rules' parts; where they find one alone and there is a generator, the 2 or 3 questions of its JSON array."""
    rule, m = query.decompose(F.col("text")), models.llm()
    if m is None:
        return queries.select("query_id", rule.alias("parts"))
    reply = F.from_json(F.regexp_extract(m.call(F.concat(F.lit("Split into 2 or 3 questions, as a JSON array of strings: "), "text")), r"(?s)\[.*\]", 0), "array<string>")
    j = queries.withColumn("rule", rule).withColumn("reply", F.when(F.size(rule) == 1, reply))
    return j.select("query_id", F.when(F.size("reply") >= 2, F.slice("reply", 1, 3)).otherwise(F.col("rule")).alias("parts"))


def filters(queries: DataFrame) -> DataFrame:
    """Adds filters: the rules' ones; where they find none and there is a generator, file, page and section of its JSON object."""
    rule, m = query.filters(F.col("text")), models.llm()
    q = queries.withColumn("filters", rule)
    if m is None:
        return q
    f = F.col("filters")
    none = f["page"].isNull() & f["page_from"].isNull() & f["target_file"].isNull() & f["section"].isNull()
    reply = F.from_json(F.regexp_extract(m.call(F.concat(F.lit("File, page and section that the query names, as a JSON object with target_file, page, section: "), "text")), r"(?s)\{.*\}", 0), "target_file string, page int, section string")
    told = F.struct(F.lit(None).cast("int").alias("page_from"), F.lit(None).cast("int").alias("page_to"), reply["page"].alias("page"), F.nullif(F.lower(text.strip(reply["target_file"])), F.lit("")).alias("target_file"), F.nullif(text.strip(reply["section"]), F.lit("")).alias("section"))
    return q.withColumn("filters", F.when(none, told).otherwise(f))


def assemble(reranked: DataFrame, chunks: DataFrame, budget: int = context.BUDGET) -> DataFrame:
    """(query_id, chunk_id, pos, citation, text): the context of reranked candidates (query_id, chunk_id, rank, q, embedding).

    Diverse candidates first, then the neighbours of the first five in order of their seed; what is on the list already
    isn't added again. Texts are compressed, taken greedily to the budget, and labelled.
    chunks: (chunk_id, doc_id, section, page_num, source, section_title, text).
    """
    picked = retrieval.mmr(reranked, key="chunk_id").join(chunks, "chunk_id").withColumn("rank", F.col("pos"))
    near = context.neighbours(picked.select("query_id", "rank", "doc_id", "section"), chunks).withColumn("pos", F.col("seed_rank") + retrieval.MMR_MOST)
    more = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("seed_rank", "doc_id", "section", "chunk_id")) + retrieval.MMR_MOST)
    names = ["query_id", "rank", *chunks.columns]
    every = context.append_missing(picked.select(*names), more.select(*names)).withColumn("text", text.compress(F.col("text")))
    every = every.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return context.labelled(context.greedy_budget(every, budget)).select("query_id", "chunk_id", "pos", "citation", "text")
