"""Registered queries of the training-data operators: op<N>_<name>, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import audit, byte_bpe, hard_negatives, language, lines, packing, pseudo_likelihood, quality, rules, sharding, simhash, topk, warc
from tidemark.llm.common import read_table, scratch

QUERIES = {}
ORACLES = {}


def registered(f):
    QUERIES[f.__name__] = f
    return f


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@registered
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    encoded = byte_bpe.encode_column(docs, _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


@registered
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, _vocabulary("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@registered
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@registered
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read_table(spark, sf_dir, "documents"))


ORACLES["op9_quality_rules"] = rules.ORACLE


@registered
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(read_table(spark, sf_dir, "documents"), 24)
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@registered
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


ORACLES["op8_topk"] = topk.ORACLE


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@registered
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language.train(docs.filter(_fold(4) != 2), language.vocabulary(_vocabulary("piece_bpe_32k.model")))
    found = language.predict(docs, model).withColumn("held_out", _fold(4) == 2)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def quality_model(spark: SparkSession, sf_dir: str) -> quality.FactorisationMachine:
    """Fitted on labelled documents outside the held-out fold."""
    labels = read_table(spark, sf_dir, "labels").filter(_fold(3) != 1)
    return quality.train(read_table(spark, sf_dir, "documents"), labels, "quality", metadata=("n_chars",))


@registered
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(read_table(spark, sf_dir, "documents"), quality_model(spark, sf_dir), metadata=("n_chars",))
    return scored.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@registered
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.linked_documents(read_table(spark, sf_dir, "documents"))


ORACLES["op2_line_dedup"] = lines.ORACLE


@registered
def op2_line_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_line_dedup(spark, sf_dir).drop("n_removed")


ORACLES["op2_line_links"] = f"SELECT doc_id, n_lines, n_links, class_id FROM ({lines.ORACLE})"


@registered
def op3_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    counts = pseudo_likelihood.word_counts(docs)
    classes, share = pseudo_likelihood.corpus_classes(docs, counts=counts)
    reading = pseudo_likelihood.read(docs, classes, shares=pseudo_likelihood.word_shares(counts, classes))
    return pseudo_likelihood.scored(reading, pseudo_likelihood.fitted(reading, share))


@registered
def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


ORACLES["op13_filter_interactions"] = audit.ORACLE


@registered
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of keys divisible by 7 move on by one first: wrong ones, as a corpus has."""
    rows, key, label = read_table(spark, sf_dir, "embeddings"), F.col("vec_id"), F.col("label")
    return hard_negatives.hard_negatives(rows, key % 100 == 0, label=F.when(key % 7 == 0, (label + 1) % 10).otherwise(label))


ORACLES["op11_hard_negatives"] = hard_negatives.ORACLE


@registered
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A file and its row number tell rows apart, however often the table is read.
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html", F.concat_ws(":", "_metadata.file_path", "_metadata.row_index").alias("row"))
    folder = f"{scratch(spark)}/archives"
    warc.write_archives(pages, folder, key="page_id", payload="html", url="url", row="row")
    found = warc.capture_digests(spark, folder)
    return found.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLES["op12_warc"] = warc.ORACLE
