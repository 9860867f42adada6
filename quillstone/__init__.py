"""quillstone: a Spark-first engine for versioned note stores and document corpora."""
