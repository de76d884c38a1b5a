"""corpusloom: a Spark-first engine for normalising, auditing and preparing text corpora."""
