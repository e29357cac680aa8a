"""quillstone: a Spark-first engine for evidence-backed document facts."""
