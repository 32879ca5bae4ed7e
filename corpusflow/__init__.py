"""Corpus preparation on Spark: catalogs, typed scans, tokenization, length buckets, vectors and tensor containers."""
