"""Spark-first corpus analytics: text, corpus, Zipf, language models, validation, acquisition."""
