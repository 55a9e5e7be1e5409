"""Corpus pipeline: from raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes it as Parquet in the shared folder and reads it again as the next
stage's documents.  All stages but the last return the columns of documents.

Defined cases are those of the operators.  In short: null and empty texts pass
as empty documents (one of them stays after near-dedup), null ids and sources
are kept, rows repeated in id and text leave near-dedup once, an empty table
gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.bagminhash import drop_near_copies
from stratum.llm.common import documents, staged, text_or_empty
from stratum.llm.line_dedup import line_dedup
from stratum.llm.mixing import sample_mix
from stratum.llm.quality_knn import KEEP, fit, score
from stratum.llm.sentencepiece_backend import encode_decode


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).where(F.col("score") >= KEEP).select("doc.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with an earlier copy go; a document goes if nothing else was in it."""
    done = line_dedup(docs)
    lost = F.size("dropped") > 0
    rest = done.where(~(lost & (F.trim(F.regexp_replace(text_or_empty(), r"[\x09-\x0D]", " ")) == "")))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return rest.select(*[F.when(lost, changed[c]).otherwise(F.col(f"doc.`{c}`")).alias(c) if c in changed
                         else F.col(f"doc.`{c}`") for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return sample_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text."""
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_decoded=False)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_copies),
    ("mixing", mix_sources),
    ("SentencePiece encoding", encode),
]

#: The classifier and the near-dedup search cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
    return docs
