"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark contamination, tokens.

Every stage takes ``(spark, docs, sf_dir)``.  All but the last give the columns of ``docs`` again, whatever they are called;
columns other than ``doc_id`` and ``text`` travel along untouched, except that ``n_chars`` follows a text that was cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnsift.llm import decontaminate, pieces, quality, simhash, suffixes
from turnsift.registry import query
from turnsift.session import cut_lineage

#: SQL cannot state the automaton, the fingerprint classes or the Viterbi paths; tests compare with brute force.
ORACLE_SQL = None


def _packed(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text``, the columns ``more``, and all columns but the text in ``_row``, so that no name can clash.

    ``_was`` is a hash of the text, which tells later whether it was cut.
    """
    own = [c for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", *more, F.xxhash64("text").alias("_was"), F.struct(*own).alias("_row"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the texts that ``rows`` have now."""

    def column(name: str):
        if name == "text":
            return F.col("text")
        if name == "n_chars":
            return F.when(F.xxhash64("text") == F.col("_was"), F.col("_row.n_chars")).otherwise(F.length("text"))
        return F.col("_row").getField(name)

    return rows.select(*[column(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the certified rule set of their language."""
    facts = cut_lineage(quality.text_facts(quality.with_stratum(_packed(docs, "lang"))))
    cutoffs = cut_lineage(quality.certified_rule_sets(facts, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return _unpacked(quality.judge(facts, cutoffs).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return _unpacked(simhash.one_per_group(_packed(docs)), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of passages that stand elsewhere too."""
    return _unpacked(suffixes.cut_repeats(_packed(docs)), docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the contamination limit, without the spans of a window or more that test items share."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(_packed(docs), items, keep_text=True, carry=("_was", "_row"))
    clean = decontaminate.judged(found).where("not contaminated")
    return _unpacked(decontaminate.cut_spans(clean), docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the ids of their pieces; a text that decodes to anything else would end the run."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode_pieces(docs.select("doc_id", "text"), model, verify=True)
    return encoded.select("doc_id", "text", F.size("ids").cast("bigint").alias("n_pieces"), "ids", "score")


STAGES = [
    ("quality", quality_rules),
    ("simhash", near_duplicates),
    ("suffixes", repeated_passages),
    ("decontaminate", benchmark_passages),
    ("sentencepiece", token_ids),
]


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the table that the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
