"""Ingest: pages to sections, chunks with headers, hashes, types and sections, vectors, canonical rows. One lazy chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import models
from ..functions import content, text
from ..operators import canonical, chunking, sections, store, tables


def ingest(pages: DataFrame, stored: DataFrame | None = None, tenant: str = "default", force: bool = False, native: bool = False) -> dict[str, DataFrame]:
    """Tables chunks, sections and vectors of pages (doc_id, page_num, text, file_type[, tables ARRAY<STRING>]).

    Chunks that are stored already are left out by one anti-join, unless forced.
    """
    tree = sections.tree(pages.select("doc_id", "page_num", "text"))
    body = text.strip_table_lines(F.col("text"), F.coalesce("tables", F.array().cast("array<string>"))) if "tables" in pages.columns else F.col("text")
    parts = chunking.chunks(pages.select(F.struct("doc_id", "page_num", "file_type").alias("page"), body.alias("text")), "page")
    parts = parts.select("page.*", "parent_idx", "child_idx", "parent_text", "text", F.lit(None).cast("string").alias("table_id"), F.lit(None).cast("string").alias("nl_text"), F.lit(None).cast("map<string,string>").alias("cells"))
    if "tables" in pages.columns:
        t = pages.select("doc_id", "page_num", "file_type", F.posexplode("tables").alias("n", "markdown")).withColumn("table_id", F.concat(F.lit("p"), F.col("page_num").cast("string"), F.lit("_t"), F.col("n").cast("string")))
        t = t.withColumn("key", F.struct("doc_id", "page_num", "file_type", "table_id"))
        rows = tables.row_chunks(tables.fill(tables.markdown_cells(t, "key"), "key"), "key")
        rows = rows.select("key.doc_id", "key.page_num", "key.file_type", F.lit(-1).alias("parent_idx"), F.col("row").alias("child_idx"), F.concat(F.lit("[TABLE]\n"), "text").alias("parent_text"), F.concat(F.lit("[TABLE]\n"), "text").alias("text"), "key.table_id", F.col("nl").alias("nl_text"), "cells")
        parts = parts.unionByName(rows)
    c = parts.withColumn("source", F.col("doc_id")).withColumn("embedding_model", F.lit(models.embedder(native).id)).withColumn("tenant_id", F.lit(tenant))
    c = chunking.contextual(c)
    if stored is not None:
        c = store.new_only(c, stored, force=force)
    else:
        c = c.dropDuplicates(store.UNIQUE)
    c = sections.page_section(c, tree)
    found = content.classify(F.col("parent_text"), F.element_at("heading_path", -1))
    c = c.withColumn("found", found).withColumn("content_type", F.when(F.col("table_id").isNotNull(), "table").otherwise(F.col("found.content_type"))).withColumn("confidence", F.col("found.confidence")).withColumn("nl_text", F.coalesce("nl_text", "found.nl")).drop("found")
    c = c.withColumn("section_title", F.element_at("heading_path", -1)).withColumn("chunk_id", F.xxhash64(*store.UNIQUE, "parent_idx", "child_idx"))
    c = sections.with_counts(c)
    v = c.select("chunk_id", "tenant_id", "doc_id", "embedding_model", models.embedder(native).call(F.col("text")).alias("embedding"))
    return {"chunks": c, "sections": tree, "vectors": v}


def canonical_rows(pages: DataFrame, tenant: str = "default") -> DataFrame:
    """The canonical store's rows of the pages' tables."""
    t = pages.select("doc_id", "page_num", F.posexplode("tables").alias("n", "markdown")).withColumn("table_id", F.concat_ws("_", F.col("doc_id").cast("string"), F.concat(F.lit("p"), F.col("page_num").cast("string")), F.concat(F.lit("t"), F.col("n").cast("string"))))
    about = t.select("table_id", F.lit(tenant).alias("tenant_id"), F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("doc_title"), F.lit("").alias("section_title"), F.col("page_num").alias("page_start"), F.col("page_num").alias("page_end"))
    return canonical.rows(tables.fill(tables.markdown_cells(t)), about)


def section_vectors(tree: DataFrame, native: bool = False) -> DataFrame:
    m = models.embedder(native)
    return tree.select("section_id", "doc_id", "title", F.lit(m.id).alias("embedding_model"), m.call(sections.summary(F.col("heading_path"), F.col("content"))).alias("embedding"))
