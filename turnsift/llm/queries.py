"""The registered queries of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnsift.llm import chat as ch
from turnsift.llm import decontaminate as dc
from turnsift.llm import jaccard as jc
from turnsift.llm import language_id as li
from turnsift.llm import language_model as lm
from turnsift.llm import licenses as lc
from turnsift.llm import pieces as sp
from turnsift.llm import prefix_trie as pt
from turnsift.llm import quality as ql
from turnsift.llm import simhash as sh
from turnsift.llm import sql
from turnsift.llm import suffixes as sx
from turnsift.llm import token_files as tf
from turnsift.llm import variants as vr
from turnsift.registry import query
from turnsift.session import cut_lineage, fresh_folder


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("op1_decontaminate", sql.DECONTAMINATE)
def op1_decontaminate(spark, sf_dir):
    found = dc.judged(dc.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op2_quality", sql.QUALITY)
def op2_quality(spark, sf_dir):
    facts = ql.text_facts(ql.with_stratum(read(spark, sf_dir, "documents").select("doc_id", "text", "lang")))
    facts = cut_lineage(facts.select("doc_id", "stratum", *ql.FACTS))
    cutoffs = cut_lineage(ql.certified_rule_sets(facts, read(spark, sf_dir, "labels")))
    return ql.judge(facts, cutoffs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op3_token_files")
def op3_token_files(spark, sf_dir):
    import public_tokenizers

    folder = fresh_folder(spark, "tokens")
    path = public_tokenizers.path("byte_bpe_50k.json")
    tf.write_tokens(read(spark, sf_dir, "documents"), folder, path, vocabulary=50_257)
    return tf.token_digests(tf.read_blocks(spark, folder))


@query("op4_chat_format", sql.CHAT)
def op4_chat_format(spark, sf_dir):
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string"
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return ch.conversation_digests(cut_lineage(ch.format_conversations(turns)))


@query("op6_licenses")
def op6_licenses(spark, sf_dir):
    found = lc.scan_licenses(read(spark, sf_dir, "documents"))
    base = F.filter("detections", lambda d: d.base)

    def labels(detections):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(detections, lambda d: d.label))), ",")

    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d.first_word)).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d.first_word)).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d.weight)), F.lit(0.0)).alias("score"),
    )


@query("op8_sentencepiece")
def op8_sentencepiece(spark, sf_dir):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sp.piece_digests(sp.encode_pieces(documents, model), model)


@query("op5_simhash")
def op5_simhash(spark, sf_dir):
    return sh.near_duplicates(read(spark, sf_dir, "documents"))


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark, sf_dir):
    return sx.repeat_digests(read(spark, sf_dir, "documents"))


@query("op7_language_model")
def op7_language_model(spark, sf_dir):
    return lm.score(read(spark, sf_dir, "documents"))


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    return li.identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


@query("op13_jaccard_join", sql.JACCARD)
def op13_jaccard_join(spark, sf_dir):
    return jc.jaccard_components(read(spark, sf_dir, "documents"))


@query("op11_spelling_variants", sql.VARIANTS)
def op11_spelling_variants(spark, sf_dir):
    return vr.variant_groups(read(spark, sf_dir, "documents"))


@query("op12_prefix_trie", sql.PREFIX_TRIE)
def op12_prefix_trie(spark, sf_dir):
    return pt.conversation_trie(read(spark, sf_dir, "conversations"))
