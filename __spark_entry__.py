"""Registered queries and the SQL each of them is checked against."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from socialspark.constants import MERGE_COLUMNS, STOP_WORDS_ENGLISH
from socialspark.functions import text as tx
from socialspark.functions.predicates import is_url
from socialspark.operators import (
    align,
    clusters,
    density,
    embed,
    keywords,
    neighbours,
    schema_drift,
    volumes,
    word_counts,
)
from socialspark.operators.ranking import number_rows
from socialspark.plans import clean_posts as cleaning
from socialspark.plans import embed_months as embed_plan
from socialspark.plans import ingest, merging
from socialspark.session import set_shared_folder, use_utc
from socialspark.sources.readers import select_month

try:  # the training-data operators and their pipeline can be left out
    import corpus_pipeline
    from socialspark.llm import queries as llm
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "socialspark.llm"):
        raise
    corpus_pipeline = llm = None

ENTRY_TABLES = "/root/testdata/sf0.001"

# --- inputs derived from the given tables -------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


CREATED = (
    "date_format(timestampadd(DAY, cast({id} % 214 as int), timestamp_ntz'2024-05-01 00:00:00'),"
    " \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
)
CREATED_SQL = (
    "strftime(timestamp '2024-05-01' + to_days(cast({id} % 214 as int)), '%Y-%m-%dT%H:%M:%SZ')"
)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "cast(doc_id as string) as external_id",
        f"{CREATED.format(id='doc_id')} as created_at",
        "lang",
        "text as content",
        "concat('user', doc_id % 97) as author_username",
        "concat('https://example.org/', source, '/', doc_id) as url",
        "case doc_id % 3 when 0 then 'TS' when 1 then 'BS' else 'X' end as platform",
    )


POSTS_SQL = f"""posts as (
  select doc_id, cast(doc_id as varchar) as external_id,
         {CREATED_SQL.format(id='doc_id')} as created_at, lang, text as content,
         concat('user', doc_id % 97) as author_username,
         concat('https://example.org/', source, '/', doc_id) as url,
         case doc_id % 3 when 0 then 'TS' when 1 then 'BS' else 'X' end as platform
  from documents)"""


def reposted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post, plus an edited copy, one day later, of one in fifty."""
    first = posts(spark, sf_dir)
    later = first.where("doc_id % 50 = 0").withColumns(
        {
            "created_at": F.expr(CREATED.format(id="(doc_id + 1)")),
            "content": F.concat(F.lit("edited "), F.col("content")),
        }
    )
    return first.unionByName(later)


REPOSTED_SQL = f"""{POSTS_SQL}, reposted as (
  select * from posts union all
  select doc_id, external_id, {CREATED_SQL.format(id='(doc_id + 1)')}, lang,
         concat('edited ', content), author_username, url, platform
  from posts where doc_id % 50 = 0)"""


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reposted`` with unreadable times, foreign schemes and blank authors."""
    return reposted(spark, sf_dir).withColumns(
        {
            "created_at": F.expr("if(doc_id % 41 = 0, 'not a date', created_at)"),
            "url": F.expr("if(doc_id % 43 = 0, 'ftp://x', url)"),
            "author_username": F.expr("if(doc_id % 47 = 0, '\\t', author_username)"),
        }
    )


DAMAGED_SQL = f"""{REPOSTED_SQL}, damaged as (
  select doc_id, external_id, lang, content, platform,
         case when doc_id % 41 = 0 then 'not a date' else created_at end as created_at,
         case when doc_id % 43 = 0 then 'ftp://x' else url end as url,
         case when doc_id % 47 = 0 then chr(9) else author_username end as author_username
  from reposted)"""

SEARCHES = ["la", "the", "der"]


def lloyd_sql(passes: int, batch_rows: int | None) -> str:
    """k-means from the first ten rows, pass by pass; with ``batch_rows`` by batches and learning rates."""
    steps = ["""points as (
      select vec_id, unnest(generate_series(1, len(embedding))) as i, unnest(embedding)::double as x,
        ('0x' || substr(md5(vec_id || ':42'), 1, 8))::bigint as h from embeddings),
    size as (select count(*) as n from embeddings),
    c0 as (
      select dense_rank() over (order by vec_id) - 1 as c, i, x, 0.0::double as given from points
      where vec_id in (select vec_id from embeddings order by vec_id limit 10))"""]
    for t in range(passes + 1):
        steps.append(f"""far{t} as (select p.vec_id, c.c, sum((p.x - c.x) * (p.x - c.x)) as d from points p join c{t} c using (i) group by 1, 2),
    near{t} as (select vec_id, arg_min(c, (d, c)) as c, min(d) as d from far{t} group by 1)""")
        if t == passes:
            break
        if batch_rows is None:
            steps.append(f"""m{t} as (select n.c, p.i, avg(p.x) as x from near{t} n join points p using (vec_id) group by 1, 2),
    c{t + 1} as (select c.c, c.i, coalesce(m.x, c.x) as x, 0.0::double as given from c{t} c left join m{t} m using (c, i))""")
        else:
            batches = f"greatest(1, (select (n + {batch_rows - 1}) // {batch_rows} from size))"
            turn = f"{t} % least({batches}, {passes})"
            steps.append(f"""m{t} as (
      select n.c, p.i, sum(p.x) as s, count(*) as k from near{t} n join points p using (vec_id)
      where p.h % {batches} = {turn} group by 1, 2),
    c{t + 1} as (
      select c.c, c.i, c.x + (coalesce(m.s, 0) - coalesce(m.k, 0) * c.x) / greatest(c.given + coalesce(m.k, 0), 1) as x,
        c.given + coalesce(m.k, 0) as given from c{t} c left join m{t} m using (c, i))""")
    return f"""with {", ".join(steps)},
    k as (select c, count(*) as n from near{passes} group by 1),
    apart as (
      select a.vec_id, b.c, sum((p.x - q.x) * (p.x - q.x)) as s from near{passes} a join points p on p.vec_id = a.vec_id
      join points q on q.i = p.i join near{passes} b on b.vec_id = q.vec_id group by 1, 2),
    own as (select a.vec_id, s.s / greatest(k.n - 1, 1) as inside, k.n from near{passes} a join apart s on s.vec_id = a.vec_id and s.c = a.c join k on k.c = a.c),
    other as (select a.vec_id, min(s.s / k.n) as outside from near{passes} a join apart s on s.vec_id = a.vec_id and s.c <> a.c join k on k.c = s.c group by 1),
    score as (select avg(case when n = 1 or greatest(inside, outside) = 0 then 0 else (outside - inside) / greatest(inside, outside) end) as silhouette
      from own join other using (vec_id))
    select vec_id, cast(c as int) as cluster, round((select silhouette from score), 6) as silhouette,
      round((select sum(d) from near{passes}), 4) as inertia from near{passes}"""


def raw_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as nested search hits, once per matching search."""
    turns = table(spark, sf_dir, "conversations")
    searches = F.array(*[F.struct(F.lit(i).alias("kw_pos"), F.lit(k).alias("keyword")) for i, k in enumerate(SEARCHES)])
    hits = turns.select("*", F.inline(searches)).where(F.lower("text").contains(F.col("keyword")))
    at = CREATED.format(id="conv_id")
    return hits.selectExpr(
        "keyword",
        "kw_pos",
        "cast(conv_id div 100 as int) as page",
        "cast(conv_id % 100 * 1000 + turn as int) as pos",
        "if(conv_id % 37 = 0 and turn = 0, '', concat('at://', conv_id, '/', turn)) as uri",
        "concat('cid', conv_id, '-', turn) as cid",
        f"if(conv_id % 2 = 0, {at}, null) as indexed_at",
        f"if(conv_id % 2 = 1, {at}, null) as indexedAt",
        """named_struct(
            'did', if(conv_id % 13 = 0, null, concat('did:', role, conv_id % 20)),
            'handle', concat(role, '.', conv_id % 20),
            'display_name', if(turn % 2 = 0, concat('Name ', conv_id), null),
            'displayName', concat('Other ', conv_id),
            'created_at', cast(null as string), 'createdAt', '2023-01-01T00:00:00Z',
            'avatar', cast(null as string), 'pronouns', cast(null as string),
            'verification', cast(null as string),
            'associated', named_struct('activity_subscription',
                named_struct('allow_subscriptions', if(turn % 3 = 0, 'followers', null)))) as author""",
        f"""named_struct(
            'text', text, 'created_at', {at}, 'createdAt', cast(null as string),
            'langs', array('en', role),
            'reply', if(turn = 0, null, named_struct(
                'parent', named_struct('uri', concat('at://', conv_id, '/', turn - 1),
                                       'cid', concat('cid', conv_id, '-', turn - 1)),
                'root', named_struct('uri', concat('at://', conv_id, '/0'),
                                     'cid', concat('cid', conv_id, '-0'))))) as record""",
        "cast(null as bigint) as reply_count",
        "turn as replyCount",
        "conv_id as repost_count",
        "cast(null as bigint) as repostCount",
        "length(text) as like_count",
        "cast(null as bigint) as likeCount",
        "cast(null as bigint) as quote_count",
        "cast(null as bigint) as quoteCount",
        "cast(null as bigint) as bookmark_count",
        "conv_id + turn as bookmarkCount",
    )


SINCE, UNTIL = "2024-05-10T00:00:00Z", "2024-11-20T00:00:00Z"

HITS_SQL = f"""searches(kw_pos, keyword) as (
  values {", ".join(f"({i}, '{k}')" for i, k in enumerate(SEARCHES))}),
hits as (
  select keyword, kw_pos, conv_id // 100 as page, conv_id % 100 * 1000 + turn as pos,
         case when conv_id % 37 = 0 and turn = 0 then '' else concat('at://', conv_id, '/', turn) end as uri,
         {CREATED_SQL.format(id='conv_id')} as created, conv_id, turn, role, text
  from conversations join searches on contains(lower(text), keyword)),
seen as (
  select * from hits where uri <> '' and created >= '{SINCE}' and created < '{UNTIL}'
  qualify row_number() over (partition by uri order by kw_pos, page, pos) = 1)"""

TAGS = ["the", "then", "that", "and", "est", "les", "a.b"]
GROUPS = {
    "articles": ["the", "der", "la"],
    "prefixes": ["th*", "ein*"],
    "phrases": ["of the", "in the", ("and", "with")],
}
SHAPES = {
    "all": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "no_urgent": ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "no_low": ["4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"],
}


# --- queries ------------------------------------------------------------------------


def texts_to_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("concat('d', doc_id) as id", "text")
    pages = table(spark, sf_dir, "pages").selectExpr("concat('p', page_id) as id", "html as text")
    return docs.unionByName(pages)


def q_month_share(spark, d):
    return volumes.month_share(volumes.month_counts(posts(spark, d), by=["platform"]))


def q_keyword_sets(spark, d):
    def tokens(name):
        return table(spark, d, name).select(F.explode(tx.words(F.col("text"))).alias("keyword"))

    return keywords.compare_keyword_lists(tokens("benchmark"), tokens("documents"))


def q_harmonize(spark, d):
    columns = ["id", "name", "status", "total", "location.1"]
    orders = table(spark, d, "orders").withColumn("location.1", F.col("o_orderpriority"))
    customers = table(spark, d, "customer")
    left = schema_drift.harmonize(
        orders, columns, {"o_orderkey": "id", "o_orderstatus": "status", "o_totalprice": "total"}
    )
    right = schema_drift.harmonize(customers, columns, {"c_custkey": "id", "c_name": "name", "c_acctbal": "total"})
    return left.unionByName(right)


def q_schema_groups(spark, d):
    headers = (
        table(spark, d, "orders")
        .groupBy("o_custkey")
        .agg(F.collect_set("o_orderpriority").alias("columns"))
        .select(
            F.concat(F.lit("f"), "o_custkey").alias("file_name"),
            F.when(F.col("o_custkey") % 11 != 0, F.col("columns")).alias("columns"),
            F.when(F.col("o_custkey") % 11 == 0, F.lit("unreadable")).alias("error"),
        )
    )
    matched = schema_drift.match_schemas(headers, schema_drift.schema_table(spark, SHAPES))
    return schema_drift.schema_group_counts(matched).withColumn("files", F.array_join("files", ","))


def q_schema_diff(spark, d):
    part = table(spark, d, "part")
    pairs = part.select(F.col("p_brand").alias("schema"), F.concat_ws(" ", "p_name", "p_size").alias("column"))
    common = part.where("p_type = 'ECONOMY'").select(F.concat_ws(" ", "p_name", "p_size").alias("column"))
    found = schema_drift.schema_diff(pairs, common)
    return found.select("column", F.array_join("schemas", ",").alias("schemas"))


def q_merge_sources(spark, d):
    base = table(spark, d, "documents").selectExpr(
        "concat('https://example.org/', source, '/', doc_id) as url",
        "if(doc_id % 29 = 0, null, cast(doc_id div 2 as string)) as external_id",
        "concat('user', doc_id % 97) as author_username",
        "text as content",
        "lang as associated_tags",
        "n_chars as like_count",
        "doc_id % 2 = 0 as is_reply",
        "doc_id % 7 as reply_count",
        "source as `Scraping Date`",
        "cast(null as string) as tagged_accounts",
        f"if(doc_id % 31 = 0, 'unknown', {CREATED.format(id='doc_id')}) as created_at",
        "source as keyword",
        "doc_id",
    )
    return merging.merge_sources([base.where("doc_id % 3 = 1"), base.where("doc_id % 3 <> 1")])


def author_rows(spark, d):
    return table(spark, d, "conversations").selectExpr(
        "concat('did:', conv_id % 50) as did",
        "concat(role, '.', conv_id) as handle",
        "concat('users_', turn % 3, '.parquet') as file_name",
    )


def windowed_hits(spark, d):
    return ingest.search_window(raw_hits(spark, d), SINCE, UNTIL)


def q_embed_hashed(spark, d):
    vectors = embed.embed_texts(
        posts(spark, d), text_col="content", prompt="", dimensions=64, key="external_id"
    )
    return vectors.select("external_id", F.posexplode("embedding").alias("dim", "weight")).where("weight <> 0").select(
        "external_id", "dim", F.round(F.col("weight").cast("double"), 5).alias("weight")
    )


def q_embed_months(spark, d):
    """The greatest weight of each vector of two platforms in three months."""
    vectors = embed_plan.embed_months(
        posts(spark, d), ["2024-06", "2024-07", "2024-11"], ["TS", "BS"], text_col="content", prompt="", dimensions=64
    )
    return vectors.select(
        "platform", "month", "external_id", F.round(F.array_max("embedding").cast("double"), 5).alias("weight")
    )


def labelled_vectors(spark, d):
    return table(spark, d, "embeddings").withColumnRenamed("label", "cluster")


def labelled_texts(spark, d):
    return table(spark, d, "documents").selectExpr(
        "doc_id as external_id", "lang as cluster", "text as clean_content"
    )


def q_align_embeddings(spark, d):
    vectors = labelled_vectors(spark, d)
    joined = align.align(vectors.select("vec_id", "cluster"), vectors.select("vec_id", "embedding"), "vec_id")
    return joined.select(
        "vec_id", "cluster", F.size("embedding").alias("dims"),
        F.element_at("embedding", 1).cast("double").alias("first_value"),
    )


def q_verify_embeddings(spark, d):
    stored = table(spark, d, "embeddings")
    again = stored.withColumn(
        "embedding",
        F.expr("transform(embedding, x -> cast(x as double) * (1 + if(vec_id % 7 = 0, 1e-3, 1e-7)))"),
    )
    return align.compare_embeddings(stored, again, "vec_id")


def q_silhouette(spark, d):
    scored = clusters.silhouette(labelled_vectors(spark, d), ["cluster"], key="vec_id")
    return scored.select("labelling", "n", F.round("silhouette", 6).alias("silhouette"))


def q_kmeans_clusters(spark, d):
    """Every row, and whether it is at least as near to the mean of its cluster as to any other mean."""
    labelled = clusters.kmeans_clusters(table(spark, d, "embeddings"), 10, key="vec_id")
    part = labelled.select("vec_id", "cluster", F.posexplode("embedding").alias("dim", "x"))
    sums = part.groupBy("cluster", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean")).orderBy("cluster", "dim")
    means: dict[int, list[float]] = {}
    for row in sums.collect():  # ten clusters
        means.setdefault(row["cluster"], []).append(row["mean"])
    far = F.array(
        *[
            F.struct(
                F.aggregate(
                    F.zip_with("embedding", F.array(*[F.lit(x) for x in mean]), lambda x, m: (x - m) * (x - m)),
                    F.lit(0.0),
                    lambda a, b: a + b,
                ).alias("far"),
                F.lit(c).alias("cluster"),
            )
            for c, mean in means.items()
        ]
    )
    measured = labelled.select("vec_id", "cluster", far.alias("far"))
    own = F.array_min(F.transform(F.filter("far", lambda c: c["cluster"] == F.col("cluster")), lambda c: c["far"]))
    least = F.array_min(F.transform("far", lambda c: c["far"]))
    return measured.select(
        "vec_id", (own <= least + 1e-6).alias("at_nearest_mean"), F.col("cluster").between(0, 9).alias("in_range")
    )


def fitted(spark, d, **how):
    """Labels of a k-means fit that begins with the first ten rows, the inertia of their means and the mean silhouette."""
    vectors = table(spark, d, "embeddings")
    initial = [r["embedding"] for r in vectors.orderBy("vec_id").limit(10).collect()]
    fits = clusters.fit_kmeans(vectors, [10], key="vec_id", initial=initial, **how)
    labelled = clusters.kmeans_clusters(vectors, 10, key="vec_id", initial=fits[10][0], max_iter=0)
    scored = clusters.silhouette(labelled, ["cluster"], "vec_id", "embedding")
    return labelled.select("vec_id", "cluster").crossJoin(  # one row
        F.broadcast(scored.select(F.round("silhouette", 6).alias("silhouette")))
    ).withColumn("inertia", F.round(F.lit(fits[10][1]), 4))


FULL_PASSES, BATCH_PASSES, BATCH_ROWS = 12, 8, 64


def q_k_sweep(spark, d):
    """Each k, whether inertia falls from k to k, and whether the silhouette is in its range."""
    sweep = clusters.k_sweep(table(spark, d, "embeddings"), key="vec_id")
    before = F.lag("inertia").over(Window.orderBy("k"))  # 29 rows
    return sweep.select(
        "k",
        F.coalesce(F.col("inertia") <= before * 1.02, F.lit(True)).alias("falls"),
        F.col("silhouette").between(-1, 1).alias("in_range"),
    )


def q_mst(spark, d):
    """The weights of the tree in ascending order."""
    tree = density.mutual_reachability_tree(table(spark, d, "embeddings"), key="vec_id")
    ranked = number_rows(tree, ["weight", "source", "target"], "rank")
    return ranked.select((F.col("rank") + 1).alias("rank"), F.round("weight", 6).alias("weight"))


def q_cluster_prompts(spark, d):
    texts = labelled_texts(spark, d)
    return clusters.cluster_prompts(
        word_counts.cluster_top_words(texts, stop_words=STOP_WORDS_ENGLISH),
        clusters.cluster_samples(texts),
        instructions="Name this group.\n",
    )


def q_monthly_word_freq(spark, d):
    freq = word_counts.monthly_word_freq(posts(spark, d), ["platform"], "content", stop_words=STOP_WORDS_ENGLISH)
    return freq.withColumn("freq", F.round("freq", 9))


def q_top_words_overall(spark, d):
    freq = word_counts.monthly_word_freq(posts(spark, d), ["platform"], "content", stop_words=STOP_WORDS_ENGLISH)
    top = word_counts.top_words_overall(freq, ["TS", "BS"])
    return top.select(
        "word", "platform", "month", *[F.round(c, 9).alias(c) for c in ("total", "freq", "log_freq")]
    )


def q_knn_cosine(spark, d):
    found = neighbours.knn_cosine(table(spark, d, "embeddings"), 3, key="vec_id")
    return found.withColumn("distance", F.round("distance", 6))


def q_density_clusters(spark, d):
    vectors = table(spark, d, "embeddings").withColumn("source_TS", F.col("label") < 5)
    labels = density.density_clusters(vectors, min_cluster_size=10, key="vec_id")
    return density.label_platforms(labels, vectors, "source_TS", "vec_id")


def with_folder(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Give a session that names no shared folder one of its own: a local session only."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        set_shared_folder(spark, lambda: tempfile.mkdtemp(prefix="socialspark-"))
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = library_queries()
    if llm is not None:
        found |= llm.queries() | {"pipeline": corpus_pipeline.run}
    return {name: with_folder(query) for name, query in found.items()}


def library_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "load_month": lambda s, d: select_month(
            damaged(s, d).withColumnRenamed("content", "clean_content"), "2024-07"
        ),
        "month_counts": lambda s, d: volumes.month_counts(posts(s, d)),
        "month_share": q_month_share,
        "repair_text": lambda s, d: table(s, d, "documents").select(
            "doc_id", tx.repair_text(F.col("text")).alias("text")
        ),
        "html_to_text": lambda s, d: table(s, d, "pages").select(
            "page_id", tx.html_to_text(F.col("html")).alias("text")
        ),
        "clean_text": lambda s, d: texts_to_clean(s, d).select(
            "id", tx.clean_text(F.col("text")).alias("text")
        ),
        "valid_urls": lambda s, d: table(s, d, "pages").where(is_url(F.col("url"))).select("page_id", "url"),
        "clean_posts": lambda s, d: cleaning.clean_posts(damaged(s, d)),
        "keep_latest": lambda s, d: cleaning.keep_latest(reposted(s, d)),
        "tag_keywords": lambda s, d: keywords.tag_keywords(
            table(s, d, "documents").select("doc_id", "text"), TAGS
        ).select("doc_id", "keyword"),
        "keyword_groups": lambda s, d: keywords.keyword_groups(
            table(s, d, "documents").select("doc_id", "text"), GROUPS
        ).select("doc_id", *GROUPS),
        "keyword_sets": q_keyword_sets,
        "harmonize": q_harmonize,
        "schema_groups": q_schema_groups,
        "schema_diff": q_schema_diff,
        "merge_sources": q_merge_sources,
        "merge_authors": lambda s, d: merging.merge_authors(author_rows(s, d), ["file_name", "handle"]),
        "new_posts_only": lambda s, d: align.new_rows_only(
            posts(s, d).select("doc_id", "url"), table(s, d, "labels"), ["doc_id"]
        ),
        "flatten_posts": lambda s, d: ingest.flatten_posts(windowed_hits(s, d)),
        "flatten_authors": lambda s, d: ingest.flatten_authors(windowed_hits(s, d)),
        "ingest_totals": lambda s, d: ingest.ingest_totals(windowed_hits(s, d)),
        "monthly_word_freq": q_monthly_word_freq,
        "top_words_overall": q_top_words_overall,
        "embed_hashed": q_embed_hashed,
        "embed_months": q_embed_months,
        "align_embeddings": q_align_embeddings,
        "verify_embeddings": q_verify_embeddings,
        "kmeans_clusters": q_kmeans_clusters,
        "k_sweep": q_k_sweep,
        "kmeans_full_batch": lambda s, d: fitted(s, d, max_iter=FULL_PASSES),
        "kmeans_mini_batch": lambda s, d: fitted(
            s, d, method="mini-batch", max_iter=BATCH_PASSES, batch_size=BATCH_ROWS, patience=None
        ),
        "silhouette": q_silhouette,
        "cluster_members": lambda s, d: clusters.cluster_members(labelled_texts(s, d)),
        "cluster_member_table": lambda s, d: clusters.cluster_member_table(
            labelled_vectors(s, d), 10, key="vec_id"
        ),
        "cluster_top_words": lambda s, d: word_counts.cluster_top_words(
            labelled_texts(s, d), stop_words=STOP_WORDS_ENGLISH
        ),
        "cluster_samples": lambda s, d: clusters.cluster_samples(labelled_texts(s, d)),
        "cluster_prompts": q_cluster_prompts,
        "knn_cosine": q_knn_cosine,
        "core_distance": lambda s, d: neighbours.core_distance(
            table(s, d, "embeddings"), key="vec_id"
        ).select("vec_id", F.round("core", 6).alias("core")),
        "mst": q_mst,
        "density_clusters": q_density_clusters,
    }


def entry(spark: SparkSession) -> DataFrame:
    """Share of each platform's posts per month."""
    return q_month_share(spark, ENTRY_TABLES)


# --- the same results in SQL ----------------------------------------------------------

SPACE = tx.SPACE_CLASS


def sql_repair(c: str) -> str:
    valid = (
        f"array_to_string(regexp_extract_all(regexp_replace({c}, '[^\\x00-\\x{{FF}}]', '', 'g'),"
        f" '(?:{tx.UTF8_SEQUENCE})+'), '')"
    )
    as_hex = (
        f"array_to_string(list_transform(regexp_extract_all({valid}, '(?s).'),"
        " lambda ch: printf('%02x', unicode(ch))), '')"
    )
    return f"case when regexp_matches({c}, '[^\\x00-\\x7F]') then decode(unhex({as_hex})) else {c} end"


def sql_collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{SPACE}]+', ' ', 'g'))"


def sql_html(c: str) -> str:
    """Tags without quoted ``>`` and the four entities the pages contain."""
    out = f"regexp_replace({c}, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g')"
    out = f"regexp_replace({out}, '</?[a-zA-Z][^>]*>|<![^>]*>', ' ', 'g')"
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("nbsp", " "), ("#39", "''"), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{char}')"
    return sql_collapse(out)


def sql_clean(c: str) -> str:
    plain = sql_collapse(f"regexp_replace({sql_html(sql_repair(c))}, '<emoji:[{SPACE}]*[^>]+>', '', 'g')")
    return f"case when regexp_matches({plain}, '[\\p{{L}}\\p{{N}}]') then {plain} else '' end"


def sql_words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_term(term: str) -> str:
    return f"regexp_matches(lower(text), '{keywords.term_pattern(term)}')"


def sql_group(terms) -> str:
    return " or ".join(
        sql_term(t) if isinstance(t, str) else "(" + " and ".join(sql_term(x) for x in t) + ")" for t in terms
    )


def sql_calendar() -> str:
    months = [f"2024-{m:02d}" for m in range(5, 12)]
    return "calendar(month) as (values " + ", ".join(f"('{m}')" for m in months) + ")"


def sql_word_freq() -> str:
    return f"""{POSTS_SQL}, {sql_calendar()},
tokens as (
  select platform, substr(created_at, 1, 7) as month, doc_id, unnest({sql_words('content')}) as word
  from posts),
kept as (select * from tokens where word not in ({sql_list(STOP_WORDS_ENGLISH)}) and month in (select month from calendar)),
vocab as (
  select platform, word from kept group by platform, word having count(distinct doc_id) >= 20),
counts as (select platform, month, word, count(*) as n from kept semi join vocab using (platform, word) group by all),
totals as (select platform, month, sum(n) as total from counts group by all),
freq as (
  select v.platform, v.word, m.month, coalesce(c.n, 0) as n, coalesce(c.n, 0) / nullif(t.total, 0) as freq
  from vocab v cross join calendar m
  left join counts c on c.platform = v.platform and c.word = v.word and c.month = m.month
  left join totals t on t.platform = v.platform and t.month = m.month)"""


TOP_WORDS_SQL = f"""texts as (select doc_id as external_id, lang as cluster, text from documents),
lw as (
  select cluster, external_id, unnest(list_filter(
           regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{2,}}'))) as word
  from texts),
sizes as (select cluster, count(*) as docs from texts group by cluster),
wc as (
  select cluster, word, count(*) as n, count(distinct external_id) as df
  from lw where word not in (STOPS) group by cluster, word),
ranked as (
  select cluster, word, n, row_number() over (partition by cluster order by n desc, word) as rank
  from wc join sizes using (cluster) where df >= 3 and df <= 0.9::double * docs),
top_words as (select cluster, rank, word, n from ranked where rank <= 30),
samples as (
  select cluster, row_number() over (partition by cluster order by md5(concat(external_id, ':42')), external_id) as rank,
         external_id, text as clean_content
  from texts qualify rank <= 10)"""


DISTANCES_SQL = """e as (select vec_id, cast(embedding as double[]) as v from embeddings),
pairs as (
  select a.vec_id, b.vec_id as neighbour, 1 - list_cosine_similarity(a.v, b.v) as distance,
         row_number() over (partition by a.vec_id order by 1 - list_cosine_similarity(a.v, b.v), b.vec_id) as rank
  from e a join e b on a.vec_id <> b.vec_id)"""


def oracle_sql() -> dict[str, str]:
    found = library_sql()
    if llm is not None:
        found |= llm.oracle_sql()
        if corpus_pipeline.ORACLE_SQL is not None:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found


def library_sql() -> dict[str, str]:
    top_words = TOP_WORDS_SQL.replace("STOPS", sql_list(STOP_WORDS_ENGLISH))
    in_study = "created_at >= '2024-05-01T00:00:00Z' and created_at < '2024-12-01T00:00:00Z'"
    merge_columns = ", ".join(f'"{c}"' for c in MERGE_COLUMNS)
    return {
        "load_month": f"""with {DAMAGED_SQL}
            select external_id, content as clean_content, created_at from damaged
            where regexp_matches(content, '[^{SPACE}]') and created_at like '2024-07-%'""",
        "month_counts": f"""with {POSTS_SQL}, {sql_calendar()}
            select month, count(doc_id) as n from calendar left join posts on substr(created_at, 1, 7) = month
            group by month""",
        "month_share": f"""with {POSTS_SQL}, {sql_calendar()},
            grid as (select platform, month from (select distinct platform from posts) cross join calendar),
            counted as (
              select g.platform, g.month, count(doc_id) as n from grid g
              left join posts p on p.platform = g.platform and substr(p.created_at, 1, 7) = g.month
              group by all)
            select platform, month, n, n * 100.0::double / sum(n) over (partition by platform) as share,
                   format('{{:,}}', n) as label from counted""",
        "repair_text": f"select doc_id, {sql_repair('text')} as text from documents",
        "html_to_text": f"select page_id, {sql_html('html')} as text from pages",
        "clean_text": f"""with t as (
              select concat('d', doc_id) as id, text from documents union all
              select concat('p', page_id), html from pages)
            select id, {sql_clean('text')} as text from t""",
        "valid_urls": "select page_id, url from pages where regexp_matches(url, '(?i)^https?:')",
        "clean_posts": f"""with {DAMAGED_SQL}, latest as (
              select * from damaged
              where url like 'http%' and author_username <> chr(9) and {in_study}
                and regexp_matches(content, '[^{SPACE}]') and (coalesce(lang, '') = '' or lower(lang) like '%en%')
              qualify row_number() over (partition by external_id order by created_at desc, url, content) = 1),
            cleaned as (select *, {sql_clean('content')} as clean_content from latest)
            select * from cleaned where clean_content <> ''""",
        "keep_latest": f"""with {REPOSTED_SQL}
            select * from reposted
            qualify row_number() over (partition by external_id order by created_at desc, url, content) = 1""",
        "tag_keywords": f"""select doc_id, array_to_string(regexp_extract_all(
              replace(lower(text), ' ', ''), 'the|then|that|and|est|les|a\\.b'), ',') as keyword from documents""",
        "keyword_groups": "select doc_id, "
        + ", ".join(f"({sql_group(terms)}) as {name}" for name, terms in GROUPS.items())
        + " from documents",
        "keyword_sets": f"""with l as (select distinct unnest({sql_words('text')}) as keyword from benchmark),
            r as (select distinct unnest({sql_words('text')}) as keyword from documents)
            select coalesce(l.keyword, r.keyword) as keyword,
                   case when r.keyword is null then 'left' when l.keyword is null then 'right' else 'both' end as side
            from l full join r on l.keyword = r.keyword""",
        "harmonize": """select o_orderkey as id, null::varchar as name, o_orderstatus as status,
                   o_totalprice as total, o_orderpriority as "location.1" from orders
            union all select c_custkey, c_name, null, c_acctbal, null from customer""",
        "schema_groups": f"""with h as (select o_custkey, list_sort(list(distinct o_orderpriority)) as k from orders group by 1),
            known(schema, k) as (values {", ".join(f"('{n}', [{sql_list(sorted(c))}])" for n, c in SHAPES.items())})
            select coalesce(case when o_custkey % 11 <> 0 then schema end, 'unknown') as schema, count(*) as n_files,
              count(case when o_custkey % 11 = 0 then 1 end) as n_errors,
              string_agg('f' || o_custkey, ',' order by 'f' || o_custkey) as files
            from h left join known using (k) group by 1""",
        "schema_diff": """with p as (select p_brand, p_type, concat_ws(' ', p_name, p_size) as c from part)
            select c as "column", string_agg(distinct p_brand, ',' order by p_brand) as schemas
            from p where c not in (select c from p where p_type = 'ECONOMY') group by c""",
        "merge_sources": f"""with b as (
              select concat('https://example.org/', source, '/', doc_id) as url,
                case when doc_id % 29 = 0 then null else cast(doc_id // 2 as varchar) end as external_id,
                concat('user', doc_id % 97) as author_username, text as content, lang as associated_tags,
                cast(n_chars as varchar) as like_count, cast(doc_id % 2 = 0 as varchar) as is_reply,
                cast(doc_id % 7 as varchar) as reply_count, source as "Scraping Date",
                null::varchar as tagged_accounts,
                case when doc_id % 31 = 0 then null else {CREATED_SQL.format(id='doc_id')} end as created_at,
                source as keyword, case when doc_id % 3 = 1 then 0 else 1 end as src
              from documents)
            select {merge_columns} from b qualify row_number() over (
              partition by external_id order by src, created_at nulls last, url) = 1""",
        "merge_authors": """with a as (
              select concat('did:', conv_id % 50) as did, concat(role, '.', conv_id) as handle,
                     concat('users_', turn % 3, '.parquet') as file_name from conversations)
            select * from a qualify row_number() over (partition by did order by file_name, handle) = 1""",
        "new_posts_only": f"""with {POSTS_SQL}
            select doc_id, url from posts where doc_id not in (select doc_id from labels)""",
        "flatten_posts": f"""with {HITS_SQL}
            select keyword, uri, concat('cid', conv_id, '-', turn) as cid, created as "indexedAt", created as "createdAt",
              regexp_replace(translate(text, chr(13) || chr(10), '  '), '^[{SPACE}]+|[{SPACE}]+$', '', 'g') as text,
              concat('en,', role) as langs,
              case when conv_id % 13 = 0 then '' else concat('did:', role, conv_id % 20) end as author_did,
              turn as "replyCount", conv_id as "repostCount", length(text) as "likeCount",
              null::bigint as "quoteCount", conv_id + turn as "bookmarkCount",
              case when turn = 0 then '' else concat('at://', conv_id, '/', turn - 1) end as reply_parent_uri,
              case when turn = 0 then '' else concat('cid', conv_id, '-', turn - 1) end as reply_parent_cid,
              case when turn = 0 then '' else concat('at://', conv_id, '/0') end as reply_root_uri,
              case when turn = 0 then '' else concat('cid', conv_id, '-0') end as reply_root_cid
            from seen""",
        "flatten_authors": f"""with {HITS_SQL}
            select concat('did:', role, conv_id % 20) as did, concat(role, '.', conv_id % 20) as handle,
              case when turn % 2 = 0 then concat('Name ', conv_id) else concat('Other ', conv_id) end as display_name,
              '2023-01-01T00:00:00Z' as created_at, '' as avatar,
              case when turn % 3 = 0 then 'followers' else '' end as allow_subscriptions,
              '' as pronouns, '' as verification
            from seen where conv_id % 13 <> 0
            qualify row_number() over (partition by did order by kw_pos, page, pos) = 1""",
        "ingest_totals": f"""with {HITS_SQL}
            select count(*) as total_posts,
              count(distinct case when conv_id % 13 <> 0 then concat('did:', role, conv_id % 20) end) as total_authors
            from seen""",
        "monthly_word_freq": f"""with {sql_word_freq()}
            select platform, word, month, n, round(freq, 9) as freq from freq""",
        "top_words_overall": f"""with {sql_word_freq()}, two as (select * from freq where platform in ('TS', 'BS')),
            top as (select word, sum(freq) as total from two group by word order by total desc, word limit 10),
            grid as (select * from top cross join (values ('TS'), ('BS')) p(platform) cross join calendar)
            select word, platform, month, round(total, 9) as total, round(coalesce(freq, 0), 9) as freq,
              round(ln(1 + coalesce(freq, 0)), 9) as log_freq
            from grid left join two using (word, platform, month)""",
        "embed_hashed": f"""with {POSTS_SQL}, tokens as (
              select external_id, unnest({sql_words('content')}) as word from posts),
            counts as (
              select external_id, cast('0x' || substr(md5(word), 1, 8) as bigint) % 64 as dim, count(*) as c
              from tokens group by all)
            select external_id, cast(dim as int) as dim,
              round(cast(cast(c / sqrt(sum(c * c) over (partition by external_id)) as float) as double), 5) as weight
            from counts""",
        "embed_months": f"""with {POSTS_SQL}, tokens as (
              select platform, substr(created_at, 1, 7) as month, external_id, unnest({sql_words('content')}) as word
              from posts
              where platform in ('TS', 'BS') and substr(created_at, 1, 7) in ('2024-06', '2024-07', '2024-11')),
            counts as (
              select platform, month, external_id, cast('0x' || substr(md5(word), 1, 8) as bigint) % 64 as dim, count(*) as c
              from tokens group by all)
            select platform, month, external_id,
              round(cast(cast(max(c) / sqrt(sum(c * c)) as float) as double), 5) as weight
            from counts group by all""",
        "align_embeddings": """select vec_id, label as cluster, len(embedding) as dims,
              cast(embedding[1] as double) as first_value from embeddings""",
        "verify_embeddings": """with e as (
              select vec_id, embedding, list_transform(embedding, lambda x: cast(x as double)
                * (1 + case when vec_id % 7 = 0 then 1e-3 else 1e-7 end)) as again from embeddings)
            select vec_id, len(list_filter(list_zip(embedding, again), lambda p:
                abs(cast(p[1] as double) - p[2]) > 1e-8 + 1e-5 * abs(p[2]))) = 0 as matches from e""",
        "silhouette": """with e as (select vec_id, label, cast(embedding as double[]) as v from embeddings),
            d as (select a.vec_id, a.label as own, b.label as other, sum(list_distance(a.v, b.v) ** 2) as total, count(*) as n
                  from e a cross join e b group by all),
            s as (select vec_id,
                    max(case when own = other then total / greatest(n - 1, 1) end) as a,
                    min(case when own <> other then total / n end) as b,
                    max(case when own = other then n end) as n
                  from d group by vec_id)
            select 'cluster' as labelling, count(*) as n,
              round(avg(case when n = 1 then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from s""",
        "cluster_members": """select lang as cluster, doc_id as external_id,
              row_number() over (partition by lang order by doc_id) - 1 as position from documents""",
        "cluster_member_table": "with m as (select label, cast(vec_id as varchar) as id,"
        " row_number() over (partition by label order by vec_id) - 1 as position from embeddings) select position, "
        + ", ".join(f"coalesce(max(case when label = {c} then id end), '') as cluster_{c}" for c in range(10))
        + " from m group by position",
        "cluster_top_words": f"with {top_words} select * from top_words",
        "cluster_samples": f"with {top_words} select * from samples",
        "cluster_prompts": f"""with {top_words},
            w as (select cluster, string_agg(concat(word, '(', n, ')'), ', ' order by rank) as words from top_words group by 1),
            p as (select cluster, string_agg('- ' || replace(substr(clean_content, 1, 280), '\\n', ' '), chr(10) order by rank) as texts
                  from samples group by 1)
            select cluster, concat('Name this group.', chr(10), chr(10), 'Cluster: ', cluster, chr(10), chr(10),
              'Top words (count): ', words, chr(10), chr(10), 'Sample posts:', chr(10), texts, chr(10), chr(10),
              'Output format:', chr(10), 'Label: <2-6 words>', chr(10), 'Description: <1-2 sentences>', chr(10)) as prompt
            from p left join w using (cluster)""",
        "knn_cosine": f"""with {DISTANCES_SQL}
            select vec_id, rank, neighbour, round(distance, 6) as distance from pairs where rank <= 3""",
        "kmeans_clusters": "select vec_id, true as at_nearest_mean, true as in_range from embeddings",
        "k_sweep": "select cast(k as int) as k, true as falls, true as in_range from range(2, 31) r(k)",
        "kmeans_full_batch": lloyd_sql(FULL_PASSES, None),
        "kmeans_mini_batch": lloyd_sql(BATCH_PASSES, BATCH_ROWS),
        # Prim: the distances of all rows to the tree, and the nearest joins it
        "mst": f"""with recursive {DISTANCES_SQL},
            core as (select vec_id, distance as core from pairs where rank = 3),
            n as (select vec_id, core, row_number() over (order by vec_id) as i from core join e using (vec_id)),
            reach as (
              select a.i, list(greatest(p.distance, a.core, b.core) order by b.i) as far
              from n a join n b on a.i <> b.i join pairs p on p.vec_id = a.vec_id and p.neighbour = b.vec_id group by a.i),
            w as (select i, list_concat(far[:i - 1], [0.0], far[i:]) as far from reach),
            prim as (
              select 0 as step, far, list_transform(far, lambda x, k: k = 1) as done, null::double as weight from w where i = 1
              union all
              select step + 1,
                list_transform(list_zip(prim.far, w.far), lambda x: least(x[1], x[2])),
                list_transform(done, lambda x, k: x or k = w.i),
                prim.far[w.i]
              from prim join w on w.i = list_position(
                list_transform(list_zip(prim.far, done), lambda x: case when x[2] then 9 else x[1] end),
                list_min(list_transform(list_zip(prim.far, done), lambda x: case when x[2] then 9 else x[1] end)))
              where not list_aggregate(done, 'bool_and'))
            select row_number() over (order by weight) as rank, round(weight, 6) as weight from prim where step > 0""",
        "core_distance": f"""with {DISTANCES_SQL}
            select vec_id, round(distance, 6) as core from pairs where rank = 3""",
    }
