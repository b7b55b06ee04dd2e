"""The registered queries opN_<name>: each applies an operator to its whole table and digests the result."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advisoryspark.llm import (alignment, chat, decontaminate, jaccard, lm, packing, pii, quality, simhash, spelling,
                               suffix, toxicity, warc)
from advisoryspark.llm.common import load
from advisoryspark.session import fresh_path

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _remainder(modulus: int):
    """crc32 of the id as text, modulo; a null id counts as 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    weights = toxicity.fit(docs, load(spark, sf_dir, "labels"), use=_remainder(5) != 0)
    scored = toxicity.score(docs, weights).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = simhash.with_fingerprint(load(spark, sf_dir, "documents").select("doc_id", "text"))
    narrow = simhash.materialize(marked.select(F.col("row.doc_id").alias("id"), "fp"), "simhash")
    return simhash.assign(narrow).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0"))
                                         .alias("fingerprint"), "component_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write(warc.plan_records(load(spark, sf_dir, "pages")), path)
    records = warc.read(spark, path).where("last")
    return records.select(warc.page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          warc.page_id("refers_to").alias("refers_to"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], told.schema)
    turns = told.union(planted).withColumn("parts", F.array(chat.text_part(F.col("text"))))
    formatted = chat.render(chat.visit(turns)).withColumn("read", chat.parse(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    line = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(line.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(load(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept")


def op6_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(load(spark, sf_dir, "documents"), _remainder(10) == 0)
    return scored.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
                         "score")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(load(spark, sf_dir, "documents"))
    term = pii.KINDS.index("term")
    base = F.filter("spans", lambda s: s["rank"] < term)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", pii.kind_name(s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(rank):
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")

    counts = [count(rank).alias(f"n_{kind}") for rank, kind in enumerate(pii.KINDS[:term])]
    return found.select(F.col("id").alias("doc_id"), *counts,
                        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.measure(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(load(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
                                         "doc_tokens", "sequence_id", "offset")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (public_tokenizers.path(name) for name in (TOKENIZER, PIECES))
    aligned = alignment.align_documents(load(spark, sf_dir, "documents"), a, b, digest=True)
    return aligned.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                          F.col("groups").cast("string").alias("groups_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(load(spark, sf_dir, "documents"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.assign(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_warc, op4_chat, op5_quality, op6_maxent, op7_pii,
                                   op8_suffix, op9_packing, op10_decontaminate, op11_alignment, op12_spelling,
                                   op13_jaccard)}
