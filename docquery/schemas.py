"""Schemas of the stored tables, as DDL."""

PAGES = "doc_id string, page_num int, text string, tables array<string>, image_texts array<string>, content_type string, section_title string"
PARSED = "path string, file_type string, success boolean, error string, page_num int, text string"
CHUNKS = (
    "chunk_id string, tenant_id string, doc_id string, chunk_hash string, text string, nl_text string, parent_text string, section int, page_num int, file_type string, content_type string, "
    "embedding_model string, table_id string, table_group string, section_id string, section_title string, heading_path array<string>, chunk_index_in_section int, total_chunks_in_section bigint, "
    "cells map<string,string>, confidence double, created_at timestamp"
)
SECTIONS = "section_id string, doc_id string, ord int, parent_id string, level int, title string, page_start int, page_end int, heading_path array<string>, content string"
CANONICAL = (
    "tenant_id string, doc_id string, table_id string, section_title string, page_start int, page_end int, row_id string, row_index int, header_path map<string,string>, cells map<string,string>, "
    "numeric_cells map<string,double>, nl_sentence string, note_refs map<string,string>"
)
VECTORS = "chunk_id string, tenant_id string, doc_id string, embedding_model string, embedding array<double>"
CACHE = "tenant_id string, user_id string, model string, corpus_version string, scope string, text string, embedding array<double>, response string, created_at timestamp"
SECTION_VECTORS, IMAGE_DIM = "section_id string, tenant_id string, embedding_model string, embedding array<double>", 768


def create(spark, root: str) -> None:
    """Empty tables of all kinds under root, where there are none yet."""
    for name, ddl in {"chunks": CHUNKS, "sections": SECTIONS, "canonical_rows": CANONICAL, "vectors": VECTORS, "section_vectors": SECTION_VECTORS, "cache": CACHE}.items():
        spark.createDataFrame([], ddl).write.mode("ignore").parquet(f"{root}/{name}")
