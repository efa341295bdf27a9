"""From documents to token ids: five stages, each over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a frame with the columns of ``docs`` (the last one: the
coded documents). Names of extra columns do not matter. Rows with NULL or empty text, without id, or repeated
are dealt with as each stage's function says; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from souklens.llm import bpe, contamination, language, lines, neardup
from souklens.llm.common import fresh, quoted, row_id, store
from souklens.llm.queries import WORD_BPE

#: Least pooled probability of the most probable language.
LEAST_SCORE = 0.4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells. Those without a letter, and those of which no language
    has ``LEAST_SCORE`` of the bytes, go. Where no document is labelled there is no network, and all stay."""
    network = language.train(docs, pick=F.xxhash64("doc_id"))
    if network is None:
        return docs
    lang, score = fresh(docs.columns, "lang_pred", "score")
    found = language.predict(docs, network, lang=lang, score=score)
    return found.where((F.col(lang) != language.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).drop(lang, score)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without long lines that stay in a later one; ``n_chars`` follows the text."""
    cut = lines.dedupe(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates, once if its row is repeated.
    Rows without id all stay, as do rows with different texts under the id that stays."""
    doc, row = fresh(docs.columns, "doc_key", "row_key")
    found = neardup.near_duplicates(docs).where(F.col("doc") == F.col("class")).select(F.col("doc").alias(doc), F.col("row").alias(row)).distinct()
    keyed = docs.where("doc_id IS NOT NULL").withColumns({doc: F.col("doc_id").cast("long"), row: row_id("text")})
    stays = keyed.join(found, [doc, row], "left_semi").dropDuplicates([doc, row]).drop(doc, row)
    return stays.unionByName(docs.where("doc_id IS NULL"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    hits, = fresh(docs.columns, "hits")
    marked = contamination.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), hits=hits)
    return marked.where(F.size(hits) == 0).drop(hits)


def coded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``lang`` and ``source`` with token ids (little-endian, 32 bits each) and the digest of the decoded text."""
    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    found = bpe.round_trip(docs, WORD_BPE, keep=keep)
    return found.select(*[quoted(c) for c in keep], "n_tokens", "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("language", known_language),
    ("line_dedup", without_shared_lines),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("bpe", coded),
]

#: A trained network, near duplicates and merge rounds have no SQL; tests/llm states the result plainly.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
