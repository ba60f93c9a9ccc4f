"""From raw documents to token files: the stages in order, each written and read again by whoever runs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common
from tidemark.llm.decontaminate import drop_contaminated
from tidemark.llm.jaccard_join import deduplicate
from tidemark.llm.mixing import mix_documents
from tidemark.llm.quality import keep_good
from tidemark.llm.token_planes import read_tokens, write_tokens


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null, empty and repeated texts are judged like others, an empty table stays empty."""
    common.small_batches(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) one document stays; texts without words all stay, of repeated rows one."""
    return deduplicate(docs, k=5, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go; null and empty texts stay, repeated rows fare alike."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their target weights; a null source is one of its own."""
    return mix_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, null texts as empty ones; the rows tell what was read back from them."""
    import public_tokenizers

    path = common.new_path(spark, "tokens")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path)


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("decontamination", decontaminate_stage),
    ("mixing", mix_stage),
    ("token_output", token_stage),
]

#: Classifiers and tokens are beyond SQL: tests hold each stage against its operator on the stage's own input, and these against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. What a stage has left in the scratch folder goes once its result, and then the next one's, is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with common.tracked() as paths:
            written = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        common.discard_paths(spark, [*before, *(p for p in paths if p != written._scratch_path)])
        docs, before = written, [written._scratch_path]
    return STAGES[-1][1](spark, docs, sf_dir)
