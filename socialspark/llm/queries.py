"""The registered queries of this subpackage, thin over its operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from socialspark.llm import (
    byte_bpe,
    context_tree,
    hamming_search,
    hard_negatives,
    kmeans_tree,
    language_id,
    mixing,
    ngram_join,
    packing,
    suffix_dedup,
    toxicity,
    warc,
    whitening,
)
from socialspark.llm.common import fold
from socialspark.session import ensure_checkpoint_dir, use_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.read_archive(spark, folder, with_payload=False).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return kmeans_tree.kmeans_tree_search(vectors, vectors.where("vec_id % 20 = 0"))


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.context_tree_scores(table(spark, sf_dir, "documents"), fold("doc_id", 5) == 1)


#: Domains by the columns of ``labels``.
DOMAIN = "case when toxic = 1 then 'toxic' when quality = 0 then 'poor' when quality = 1 then 'good' end"
TARGETS = {"good": 0.9, "poor": 0.08, "toxic": 0.02}


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr("doc_id", f"{DOMAIN} as domain")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, word_tokenizer(), with_ids=False)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold("doc_id", 5) == 0
    scored = toxicity.score(docs, toxicity.fit(docs, labels.where(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 3) == 1
    model = language_id.fit(docs.where(~held))
    found = language_id.predict(docs, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = hamming_search.sign_codes(table(spark, sf_dir, "embeddings"))
    return hamming_search.hamming_search(codes, codes.where("id % 20 = 0"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), domain_labels(spark, sf_dir)
    known = {r[0] for r in labels.select("domain").distinct().collect()}
    return mixing.mix(docs, labels, {d: w for d, w in TARGETS.items() if d in known})


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.encode_texts(docs, ranks, public_tokenizers.PATTERN, with_ids=False, digests=True)


#: Labels of the rows that take part in hard-negative mining.
MINED_LABEL = "case when vec_id % 7 = 0 then (label + 1) % 10 else label end"


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.expr(MINED_LABEL))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_warc,
        op2_kmeans_tree,
        op3_context_tree,
        op4_ngram_join,
        op5_packing,
        op6_toxicity,
        op7_language_id,
        op8_hamming_search,
        op9_suffix_dedup,
        op10_mixing,
        op11_byte_bpe,
        op12_hard_negatives,
        op13_whitening,
    ]
    return {query.__name__: query for query in found}


WARC_SQL = """with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select page_id, n as payload_bytes, d as payload_digest,
  case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to
from p left join f using (d)"""

HAMMING_SQL = f"""with e as (
  select vec_id, list_sum(list_transform(range(1, 65), lambda i:
    case when embedding[i] > 0 then cast(1 as hugeint) << (i - 1)::integer else 0 end))::hugeint::ubigint as code
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
r as (
  select q.vec_id as query_id, c.vec_id, bit_count(xor(q.code, c.code)) as distance,
    row_number() over (partition by q.vec_id order by bit_count(xor(q.code, c.code)), c.vec_id) as rank
  from e q join e c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(rank as int) as rank, vec_id, cast(distance as int) as distance from r where rank <= {hamming_search.K}"""


HARD_NEGATIVES_SQL = """with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) as x
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
    cast(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) as bigint) as score
  from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (
  select * from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (
  select p.anchor_id, p.id as positive_id, s.id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same
    and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": WARC_SQL, "op8_hamming_search": HAMMING_SQL, "op12_hard_negatives": HARD_NEGATIVES_SQL}
