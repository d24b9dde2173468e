"""tessera: a Spark-first engine for building and scoring training corpora."""
