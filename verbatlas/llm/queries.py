"""The queries of the training-data operators: thin views of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.llm import additive, language, lattice, licenses, lines, mixing, packing, simhash, toxicity, urls
from verbatlas.llm.common import held_out, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.draw(mixing.mark(table(spark, sf_dir, "documents"), columns=["doc_id"]))
    return found.select(
        "doc_id", F.col("_source").alias("source"), F.col("_language").alias("language"), F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"),
        F.round("_weight", 9).alias("weight"), F.round("_prob", 9).alias("prob"), F.col("_kept").alias("kept"), F.round("_residual", 6).alias("residual"),
    )


def op2_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op3_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op10_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 9))


#: The ratio lies in the gap between lines that recur by chance and repeated lines: see the README.
LINES = {"ratio": 0.05}


def document_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, host): the sites of the documents that ``pages`` show; the number at the end of a url's path is a doc_id."""
    return urls.shown(table(spark, sf_dir, "pages")).where("name <> ''").select("doc_id", F.col("name").alias("host"))


def op4_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_boilerplate(table(spark, sf_dir, "documents"), hosts=document_hosts(spark, sf_dir), **LINES)
    return found.select("doc_id", "text", "n_lines", "n_dropped")


def op5_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is that of the document it shows."""
    pages = table(spark, sf_dir, "pages")
    found = urls.judge(pages, urls.outcomes(pages, table(spark, sf_dir, "labels")))
    return found.withColumn("bad_rate", F.round("bad_rate", 9)).withColumn("bound", F.round("bound", 9))


def byte_bpe() -> str:
    """Where this machine keeps the public tokenizer's file; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing_gga(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe(), size=2048, end_id=0)


def op7_language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs)).withColumn("held_out", held_out(F.col("doc_id")))


def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_additive_ann": op2_additive_ann,
    "op3_toxicity_nnpu": op3_toxicity_nnpu,
    "op4_site_lines": op4_site_lines,
    "op5_host_reputation": op5_host_reputation,
    "op6_packing_gga": op6_packing_gga,
    "op7_language_backoff": op7_language_backoff,
    "op8_simhash_trie": op8_simhash_trie,
    "op9_lattice_dedup": op9_lattice_dedup,
    "op10_license_diagonals": op10_license_diagonals,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.sql(),
    "op4_site_lines": lines.SQL.format(number=urls.NUMBER, name=urls.NAME_SQL, **LINES),
    "op5_host_reputation": urls.sql(),
    "op10_license_diagonals": licenses.sql(),
}
