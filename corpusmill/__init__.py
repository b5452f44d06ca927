"""corpusmill: a Spark-first engine that turns corpora into scored, deduplicated, traceable training data."""
