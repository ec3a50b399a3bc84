"""Queries of retrieval, ranking, evaluation and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions.vectors import cosine, unit
from loomwork.operators import evaluation as ev
from loomwork.operators import matching as m
from loomwork.operators.joins import lookup_filter
from loomwork.queries import Registry
from loomwork.session import materialize, table

registry = Registry()

_WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_INDEX = f"""d as (select doc_id as doc, {_WORDS} as w from documents where doc_id is not null),
ix as (select word, doc, length, count(*) as tf from (select doc, len(w) as length, unnest(w) as word from d) group by 1, 2, 3),
qw as (select item_id as query, unnest(list_distinct({_WORDS})) as word from eval_items)"""
_BM25 = f"""{_INDEX}, st as (select count(*) as n, avg(len(w)) as avgl from d where len(w) > 0),
dfs as (select word, count(*) as df from ix group by 1),
bm as (select query, doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgl))) as score
from ix join qw using (word) join dfs using (word), st group by 1, 2),
br as (select query, doc, round(score, 4) as score from bm), bk as (select *, row_number() over (partition by query order by score desc, doc) as rank from br)"""


def _postings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents' occurrences of the evaluation items' words, and these words by item."""
    wanted = m.query_words(table(spark, sf_dir, "eval_items"), "item_id", "text")
    return m.query_postings(table(spark, sf_dir, "documents"), wanted, "doc_id", "text"), wanted


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    postings, wanted = _postings(spark, sf_dir)
    df, n, mean = m.document_frequencies(table(spark, sf_dir, "documents").filter("doc_id is not null"), wanted, "text")
    scored = m.bm25(postings, wanted, df, n, mean).withColumn("score", F.round("score", 4))
    return m.top_k(scored, "query", "score", "doc", k)


@registry.query(sql=f"with {_BM25} select query, doc, rank from bk where rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each evaluation item by BM25."""
    return _bm25(spark, sf_dir, 10).select("query", "doc", "rank")


@registry.query(sql=f"""with {_INDEX}, need as (select query, count(*) as need from qw group by 1)
select query, doc, cast(sum(tf) as bigint) as hits from ix join qw using (word) join need using (query) group by query, doc, need having count(*) = need""")
def lexical_all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents holding every word of an evaluation item."""
    return m.all_words_match(*_postings(spark, sf_dir))


_VECTORS = """qs as (select vec_id as query, embedding::double[] as qv from embeddings where vec_id % 100 = 0),
vs as (select query, vec_id as neighbour, list_cosine_similarity(qv, embedding::double[]) as s from qs, embeddings where vec_id <> query)"""


@registry.query(sql=f"""with {_VECTORS} select query, neighbour, rank, round(s, 6) as similarity from
(select *, row_number() over (partition by query order by s desc, neighbour) as rank from vs) where rank <= 10""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100, exactly."""
    vectors = table(spark, sf_dir, "embeddings")
    near = m.nearest_vectors(vectors, vectors.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10)
    return near.select("query", "neighbour", "rank", F.round("similarity", 6).alias("similarity"))


@registry.query(sql="""with p as (select label, i, avg(embedding[i]::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as c
from embeddings, range(1, 65) t(i) group by 1, 2), c as (select label, list(c order by i) as v from p group by 1)
select a.label, round(list_cosine_similarity(a.v, b.v), 6) as similarity, b.label as other from c a join c b on a.label < b.label""")
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of the mean unit vectors of each two labels: how far classes lie apart."""
    spread = table(spark, sf_dir, "embeddings").select("label", F.posexplode(unit(F.transform("embedding", lambda x: x.cast("double")))).alias("i", "x"))
    mean = spread.groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    pairs = mean.alias("a").join(mean.alias("b"), F.col("a.label") < F.col("b.label"))  # labels are a handful
    return pairs.select(F.col("a.label").alias("label"), F.col("b.label").alias("other"), F.round(cosine(F.col("a.v"), F.col("b.v")), 6).alias("similarity"))


_OVERLAP = f"""qs as (select item_id as query, list_distinct({_WORDS}) as q from eval_items), ds as (select doc_id as doc, list_distinct({_WORDS}) as w from documents),
ov as (select query, doc, case when len(q) = 0 then 0 else round(0.7 * len(list_intersect(q, w)) / len(q) + 0.3 * len(list_intersect(q, w)) / greatest(len(list_distinct(q || w)), 1), 6) end as score
from bk join qs using (query) join ds using (doc) where rank <= 50),
ok as (select *, row_number() over (partition by query order by score desc, doc) as rank from ov)"""


def _reranked(spark: SparkSession, sf_dir: str, found: DataFrame, k: int) -> DataFrame:
    docs = lookup_filter(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), found.select("doc").distinct(), "doc")
    words = docs.select("doc", m.words(F.col("text")).alias("w"))
    asked = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query"), m.words(F.col("text")).alias("q"))
    scored = words.join(found.select("query", "doc"), "doc").join(asked, "query").select("query", "doc", m.overlap_score(F.col("q"), F.col("w")).alias("score"))
    return m.top_k(scored, "query", "score", "doc", k)


@registry.query(sql=f"with {_BM25}, {_OVERLAP} select query, doc, rank from ok where rank <= 25")
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents by BM25 reranked by word overlap, 25 kept."""
    return _reranked(spark, sf_dir, materialize(_bm25(spark, sf_dir, 50), "bm25"), 25).select("query", "doc", "rank")


@registry.query(sql=f"""with {_BM25}, {_OVERLAP}, u as (select query, doc, 'bm25' as name, rank from bk where rank <= 50 union all select query, doc, 'overlap', rank from ok where rank <= 50),
f as (select query, doc, round(sum(1.0 / (60 + rank)), 6) as score, string_agg(name, ',' order by name) as retrievers from u group by 1, 2)
select * from (select *, row_number() over (partition by query order by score desc, doc) as rank from f) where rank <= 25""")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and overlap rankings fused by reciprocal rank, 25 kept."""
    lexical = materialize(_bm25(spark, sf_dir, 50), "bm25")
    return m.reciprocal_rank_fusion({"bm25": lexical, "overlap": _reranked(spark, sf_dir, lexical, 50)}, limit=25)


@registry.query(sql="""with p as (select o_orderkey, o_orderpriority, count(*) over w as pool_size, round(100.0 * (rank() over (w order by o_totalprice) - 1) / count(*) over w, 2) as percentile,
rank() over (w order by o_totalprice desc) as rank from orders window w as (partition by o_orderpriority))
select o_orderkey, percentile, rank, pool_size, case when percentile >= 99 then 'top 1%' when percentile >= 95 then 'top 5%' when percentile >= 90 then 'top 10%' when percentile >= 75 then 'top quarter' when percentile >= 50 then 'top half' else 'lower half' end as band from p""")
def pool_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's place in the pool of its customer's market: here, of its priority."""
    ranked = m.pool_percentile(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
    return ranked.select("o_orderkey", "percentile", "rank", "pool_size", "band")


@registry.query(sql="""select l_orderkey, l_linenumber, case when max(l_extendedprice) over w = min(l_extendedprice) over w then 0.5
else round((l_extendedprice - min(l_extendedprice) over w) / (max(l_extendedprice) over w - min(l_extendedprice) over w), 4) end as scaled from lineitem window w as (partition by l_orderkey)""")
def pool_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's price scaled within its order."""
    return m.pool_minmax(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice", "scaled").select("l_orderkey", "l_linenumber", "scaled")


@registry.query(sql="select event_id, round(pow(0.5, greatest(date_diff('second', ts, timestamp '2024-02-01'), 0) / 86400.0 / 7), 6) as fresh from events")
def event_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's freshness at a fixed instant, halved every week."""
    age = (F.unix_timestamp(F.to_timestamp(F.lit("2024-02-01"))) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 86400.0
    return table(spark, sf_dir, "events").select("event_id", F.round(m.freshness(age), 6).alias("fresh"))


_RANKED = """r as (select suite as query, grade, row_number() over (partition by suite order by md5(text), item_id) as rank from eval_items where suite is not null)"""


@registry.query(sql=f"""with {_RANKED}, b as (select *, row_number() over (partition by query order by coalesce(grade, 0) desc, rank) as best, coalesce(grade, 0) as g from r),
a as (select query, sum(case when rank <= 10 then (pow(2, g) - 1) / log2(rank + 1) else 0 end) as dcg, sum(case when best <= 10 then (pow(2, g) - 1) / log2(best + 1) else 0 end) as ideal,
min(case when g >= 2 then rank end) as first, avg(case when rank <= 5 then (g >= 2)::int end) as p5, sum((g >= 3)::int) as t, sum((g >= 3 and rank <= 10)::int) as h from b group by 1)
select query, round(case when ideal = 0 then 0 else dcg / ideal end, 4) as ndcg, round(coalesce(1.0 / first, 0), 4) as mrr, round(coalesce(p5, 0), 4) as p_at_5, round(case when t = 0 then 1 else h / t end, 4) as recall_grade3 from a""")
def ranking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of a fixed ranking of each suite's items against their grades."""
    w = Window.partitionBy("suite").orderBy(F.md5("text"), "item_id")
    ranked = table(spark, sf_dir, "eval_items").filter("suite is not null").select(F.col("suite").alias("query"), "grade", F.row_number().over(w).alias("rank"))
    return ev.ranking_metrics(ranked)


@registry.query(sql="""with c as (select substr((l_shipdate::date)::varchar, 1, 4) as grp, l_returnflag = 'N' as a, l_linestatus = 'O' as b from lineitem),
t as (select grp, count(*) as n, avg((a = b)::int) as po, avg(a::int) as pa, avg(b::int) as pb from c group by 1)
select grp, n, round(case when pa * pb + (1 - pa) * (1 - pb) = 1 then 1 else (po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) end, 4) as kappa from t""")
def rater_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two flags as two raters, by year."""
    pairs = table(spark, sf_dir, "lineitem").select(F.substring(F.col("l_shipdate").cast("string"), 1, 4).alias("grp"), (F.col("l_returnflag") == "N").alias("a"), (F.col("l_linestatus") == "O").alias("b"))
    return ev.cohens_kappa(pairs, "grp")


@registry.query(sql="""with r as (select l_linenumber as grp, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_extendedprice::bigint) as item, unnest([l_returnflag = 'N', l_linestatus = 'O', l_tax > 0.04]) as label from lineitem),
c as (select grp, item, sum(label::int) as k from r group by 1, 2), m as (select grp, count(*) as items, avg((k * (k - 1) + (3 - k) * (2 - k)) / 6.0) as po, sum(k) / (3.0 * count(*)) as p from c group by 1)
select grp, items, round(case when p * p + (1 - p) * (1 - p) = 1 then 1 else (po - (p * p + (1 - p) * (1 - p))) / (1 - (p * p + (1 - p) * (1 - p))) end, 4) as kappa from m""")
def many_rater_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of three flags as three raters, by line number."""
    flags = F.array(F.col("l_returnflag") == "N", F.col("l_linestatus") == "O", F.col("l_tax") > 0.04)
    ratings = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("grp"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", F.floor(F.col("l_extendedprice") + 0.5)).alias("item"), F.explode(flags).alias("label"))
    return ev.fleiss_kappa(ratings, "grp", "item", "label")


@registry.query(sql="""with c as (select o_orderkey, o_orderpriority, ntile(10) over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as stratum from orders)
select o_orderkey, stratum from (select *, row_number() over (partition by o_orderpriority, stratum order by md5(o_orderkey::varchar), o_orderkey) as n from c) where n <= 6""")
def label_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six orders of every decile of every priority, as a sample for labelling."""
    return ev.stratified_sample(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey").select("o_orderkey", "stratum")


@registry.query(sql="select l_partkey, quantile_disc(l_linenumber, 0.5) as grade, count(l_linenumber) as n_labels from lineitem group by 1")
def consensus_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median grade of each part, its line numbers standing for grades."""
    return ev.consensus(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_linenumber")


@registry.query()
def preference_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of three features fitted to each supplier's returned and kept lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_discount") * 10).alias("discount"), (F.col("l_tax") * 10).alias("tax"), (F.col("l_quantity") / 50).alias("quantity"),
        F.when(F.col("l_returnflag") == "R", 1.0).when(F.col("l_returnflag") == "A", 0.0).alias("label"))
    fitted = ev.fit_preferences(lines, "l_suppkey", ["discount", "tax", "quantity"], "label", [0.5, 0.3, 0.2])
    return fitted.withColumn("weights", F.array_join(F.transform("weights", lambda w: F.format_number(w, 4)), ","))
