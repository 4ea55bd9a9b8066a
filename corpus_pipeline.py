"""From raw documents to packed sequences: five stages, each over all that the one before kept.

``STAGES`` lists them; each takes ``(spark, docs, sf_dir)`` and all but the last return the
columns of ``documents``. ``run`` applies them, writing each result to the shared folder.

Every row is compared by its own text, whatever its id; rows without an id are mixed at rate 1. Tables may have more columns
than ``documents``, of any name; they are carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from socialspark.llm import language_id, mixing, ngram_join, packing, suffix_dedup
from socialspark.llm.queries import domain_labels, table, word_tokenizer
from socialspark.session import cut

#: Languages less likely than this reject a document.
LEAST_SCORE = 0.5
#: A passage is a repeated string of more than so many words, or of `suffix_dedup.LENGTH` bytes. Strings are matched
#: from so many bytes on, less than 51 words of prose take, by grams of so many bytes.
PASSAGE_WORDS, PASSAGE_BYTES, PASSAGE_GRAM = 50, 240, 48
#: Weights of the domains after mixing; no document is repeated for them.
TARGETS = {"good": 0.97, "poor": 0.025, "toxic": 0.005}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language."""
    found = language_id.predict(docs, language_id.fit(docs), keep=None)
    sure = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return found.where(sure).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group that n-gram similarity links; null ids come last."""
    numbered = cut(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("n")))
    classes = ngram_join.ngram_join(numbered.select("n", F.col("row.text").alias("text")), id_col="n")
    first = F.struct(F.col("row.doc_id").isNull(), "row.doc_id", "n")
    named = numbered.select("n", first.alias("first")).join(classes.select("n", "class_id"), "n")
    kept = cut(named.groupBy("class_id").agg(F.min_by("n", "first").alias("n")).select("n"))
    return numbered.join(kept, "n", "left_semi").select("row.*")


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out passages that occur more than once; documents of which nothing is left go."""
    found = suffix_dedup.remove_repeats(
        docs,
        keep=tuple(docs.columns),
        length=PASSAGE_BYTES,
        gram=PASSAGE_GRAM,
        as_text=True,
        in_struct=True,
        words=PASSAGE_WORDS,
        long=suffix_dedup.LENGTH,
    )
    changed = F.col("n_removed") > 0
    new = {
        "text": F.when(changed, F.col("kept")).otherwise(F.col("row.text")),
        "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row.n_chars")),
    }
    return found.where(~changed | (F.trim("kept") != "")).select(
        *[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns]
    )


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thin out domains until their expected tokens have the target weights."""
    labels = domain_labels(spark, sf_dir)
    known = {r[0] for r in labels.join(docs.select("doc_id"), "doc_id", "left_semi").select("domain").distinct().collect()}
    targets = {d: w for d, w in TARGETS.items() if d in known}
    rates = mixing.mix(docs, labels.where(F.col("domain").isin(*targets)), targets, budget=math.inf)
    dropped = rates.where("doc_id is not null and copies < 1").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document and their place in the sequences."""
    return packing.pack_documents(docs, word_tokenizer(), with_ids=False)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("mixing", mix_domains),
    ("packing", pack),
]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
