"""DataFrame operators: chunking, tables, sections, retrieval, context, guards, stores, jobs, statistics."""
