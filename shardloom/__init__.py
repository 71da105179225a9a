"""Shardloom: a Spark-first analytics library of lazy DataFrame operators."""
