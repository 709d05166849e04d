"""docquery: document analytics and retrieval as Spark plans."""
