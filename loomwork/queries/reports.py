"""Queries of selections, reports, pages, joins of other kinds, and evaluation runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import extraction as ex
from loomwork.functions import pages
from loomwork.functions import postings as po
from loomwork.functions import script
from loomwork.functions import vocabulary as vo
from loomwork.functions.vectors import cosine, parse_vector, unit, vector_literal
from loomwork.operators import evaluation as ev
from loomwork.operators import matching as m
from loomwork.operators import reports as rp
from loomwork.operators import skills as sk
from loomwork.operators import snapshots as sn
from loomwork.operators.joins import lookup_join
from loomwork.queries import Registry
from loomwork.queries.matching import _RANKED, _WORDS, _postings
from loomwork.queries.snapshots import _COMPOUND, _HOST, _SHARED, _taxonomy
from loomwork.session import materialize, table
from loomwork.sources import feeds

registry = Registry()

#: The instant at which reports are made, as the test tables have no today.
NOW = "2024-06-01 00:00:00"
_NOW = f"timestamp '{NOW}'"


def _now() -> F.Column:
    return F.to_timestamp_ntz(F.lit(NOW), F.lit("yyyy-MM-dd HH:mm:ss"))


_WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}]+"
_PAGE = rf"""pg as (select ingest_id, title, lower(trim(regexp_replace(regexp_replace(regexp_replace(description, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '{_WS}', ' ', 'g'))) as page from workable_jobs)"""
_NAMED = r"""tk as (select ingest_id, page, regexp_extract_all(lower(title), '[\p{L}\p{M}\p{N}_]{4,}') as w from pg),
rk as (select ingest_id, page, w[i] as word, row_number() over (partition by ingest_id order by -length(w[i]), i) as n from tk, unnest(range(1, len(w) + 1)) as r(i)),
nm as (select ingest_id, bool_or(contains(page, word)) as named from rk where n <= 3 group by 1)"""


@registry.query(sql=f"with {_PAGE} select ingest_id, length(page) as n_chars, md5(page) as page_md5 from pg")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of each workable description, as its length and digest."""
    page = pages.visible_text(F.col("description"))
    return table(spark, sf_dir, "workable_jobs").select("ingest_id", F.length(page).alias("n_chars"), F.md5(page).alias("page_md5"))


@registry.query(sql=f"with {_PAGE}, {_NAMED} select pg.ingest_id, coalesce(named, true) as named from pg left join nm using (ingest_id)")
def titles_on_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each workable description names its title."""
    t = table(spark, sf_dir, "workable_jobs")
    return t.select("ingest_id", pages.names_on_page(F.col("title"), pages.visible_text(F.col("description"))).alias("named"))


_CLOSED = " or ".join(f"contains(page, '{p}')" for p in pages.CLOSURE_PHRASES)
_EMPLOYED = _NAMED.replace("title", "company").replace("tk as", "ct as").replace("from tk", "from ct").replace("rk as", "cr as").replace("from rk", "from cr").replace("nm as", "cm as").replace("from pg)", "from pg join workable_jobs using (ingest_id) join job_sources on board = name)").replace("lower(company)", "lower(company_name)")


@registry.query(sql=f"""with {_PAGE}, {_NAMED}, {_EMPLOYED}, x as (select pg.*, coalesce(nm.named, true) or company_name is null or coalesce(cm.named, true) as named
from pg join workable_jobs w using (ingest_id) left join job_sources on w.board = name left join nm using (ingest_id) left join cm using (ingest_id))
select ingest_id, case when page is not null and ({_CLOSED}) then 'gone' when not named then 'redirected' else 'live' end as state from x""")
def page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each workable description, taken as the answer to a request, says about its posting."""
    sources = table(spark, sf_dir, "job_sources").select(F.col("name").alias("board"), "company_name")
    t = lookup_join(table(spark, sf_dir, "workable_jobs"), sources, "board")
    return t.select("ingest_id", pages.page_state(F.lit(200), F.col("description"), F.col("title"), F.col("company_name"), F.lit(True)).alias("state"))


_PHRASES = ", ".join(f"'{p}'" for p in pages.FORBIDDEN_PHRASES)


@registry.query(sql=f"select doc_id, array_to_string(list_filter([{_PHRASES}], lambda p: contains(lower(coalesce(text, '')), p)), ';') as phrases from documents")
def promises_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases in each document that generated copy must not hold."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(pages.phrases_in(F.col("text"), pages.FORBIDDEN_PHRASES), ";").alias("phrases"))


@registry.query(sql=f"select ingest_id, {'''case when regexp_matches(descriptionPlain, '%s') then false when regexp_matches(descriptionPlain, '%s') then true end''' % (ex.SPONSORSHIP_REFUSED, ex.SPONSORSHIP_OFFERED)} as offered from lever_postings")
def sponsorship_stance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each lever posting offers sponsorship, refuses it or says nothing."""
    return table(spark, sf_dir, "lever_postings").select("ingest_id", ex.sponsorship(F.col("descriptionPlain")).alias("offered"))


@registry.query(sql="select vec_id, len(embedding) as n, round(list_sum(list_transform(embedding, lambda x: round(x::double, 6))), 4) as total from embeddings")
def vectors_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector written as a literal and read back."""
    back = parse_vector(vector_literal(F.col("embedding")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(back).alias("n"), F.round(F.aggregate(back, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@registry.query(sql="select doc_id from documents d where text is not null and not exists (select 1 from embeddings e where e.vec_id = d.doc_id)")
def pending_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a text that have no vector yet."""
    have = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id").join(have, "doc_id", "left_anti")


@registry.query(sql="select ingest_id from greenhouse_jobs where language is distinct from 'en'")
def outdated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose label differs from the one wanted, null counting as different."""
    return table(spark, sf_dir, "greenhouse_jobs").filter(~F.col("language").eqNullSafe("en")).select("ingest_id")


@registry.query(sql=f"""with d as (select doc_id as doc, {_WORDS} as w from documents where doc_id is not null), ix as (select word, doc, count(*) as tf from (select doc, unnest(w) as word from d) group by 1, 2),
qw as (select item_id as query, unnest(list_distinct({_WORDS})) as word from eval_items), need as (select query, count(*) as need from qw group by 1),
hit as (select query, doc, sum(tf) as hits from ix join qw using (word) join need using (query) group by query, doc, need having count(*) = need),
h as (select query, doc, row_number() over (partition by query order by hits desc, doc) as rank from hit),
late as (select doc_id as doc, row_number() over (order by fetched_at desc nulls last, doc_id) as rank from documents where text is not null qualify rank <= 5)
select query, doc, rank, false as fallback from h where rank <= 5 union all select item_id, doc, rank, true from eval_items, late where item_id not in (select query from hit)""")
def retrieval_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents holding all of an item's words, or the five latest where there are none."""
    found = m.top_k(m.all_words_match(*_postings(spark, sf_dir)), "query", "hits", "doc", 5).select("query", "doc", "rank", F.lit(False).alias("fallback"))
    found = materialize(found, "found")
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    late = rp.batches(docs.select(F.col("doc_id").alias("doc"), "fetched_at"), [F.col("fetched_at").desc_nulls_last(), F.col("doc")], 5, 5)
    late = late.agg(F.collect_list(F.struct("doc", F.col("place").alias("rank"))).alias("late"))  # five rows
    none = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query")).join(found.select("query"), "query", "left_anti")
    spread = none.withColumn("__one", F.lit(1)).join(F.broadcast(late.withColumn("__one", F.lit(1))), "__one").select("query", F.explode("late").alias("x"))
    return found.unionByName(spread.select("query", "x.doc", "x.rank", F.lit(True).alias("fallback")))


_METRICS = f"""{_RANKED}, b as (select *, row_number() over (partition by query order by coalesce(grade, 0) desc, rank) as best, coalesce(grade, 0) as g from r),
a as (select query, sum(case when rank <= 10 then (pow(2, g) - 1) / log2(rank + 1) else 0 end) as dcg, sum(case when best <= 10 then (pow(2, g) - 1) / log2(best + 1) else 0 end) as ideal, min(case when g >= 2 then rank end) as first from b group by 1),
mt as (select query, round(case when ideal = 0 then 0 else dcg / ideal end, 4) as ndcg, round(coalesce(1.0 / first, 0), 4) as mrr from a)"""


def _ranked_items(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    w = Window.partitionBy("suite").orderBy(F.md5("text"), "item_id")
    return table(spark, sf_dir, "eval_items").filter("suite is not null").select(F.col("suite").alias("query"), "grade", *extra, F.row_number().over(w).alias("rank"))


@registry.query(sql=f"with {_METRICS} select round(avg(ndcg), 4) as ndcg, round(avg(mrr), 4) as mrr, count(*) as queries from mt")
def ranking_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rankings' quality, each suite counting once."""
    return ev.macro_average(ev.ranking_metrics(_ranked_items(spark, sf_dir)), ["ndcg", "mrr"])


@registry.query(sql=f"""with {_RANKED.replace('grade,', 'grade, lang,')}, c as (select query, coalesce(lang, '?') as lang, coalesce(grade, 0) as g, row_number() over (partition by query, lang order by rank) as rank from r),
b as (select *, row_number() over (partition by query, lang order by g desc, rank) as best from c),
a as (select query, lang, count(*) as pairs, sum(case when rank <= 10 then (pow(2, g) - 1) / log2(rank + 1) else 0 end) as dcg, sum(case when best <= 10 then (pow(2, g) - 1) / log2(best + 1) else 0 end) as ideal from b group by 1, 2),
n as (select query, lang, pairs, round(case when ideal = 0 then 0 else dcg / ideal end, 4) as ndcg from a)
select lang, count(*) as queries, sum(pairs)::bigint as pairs, case when sum(pairs) >= 20 then round(avg(ndcg), 4) end as ndcg from n group by 1""")
def quality_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rankings' quality over the items of each language alone; null where they are too few."""
    ranked = _ranked_items(spark, sf_dir, F.coalesce("lang", F.lit("?")).alias("lang"))
    return ev.metrics_by_cell(ranked, ["lang"])


@registry.query(sql="""with u as (select vec_id, label, i, embedding[i]::double / sqrt(list_dot_product(embedding::double[], embedding::double[])) as x from embeddings, range(1, 65) t(i)),
c as (select label, list(x order by i) as v from (select label, i, avg(x) as x from u group by 1, 2) group by 1),
s as (select c.label, e.label = c.label as own, list_cosine_similarity(c.v, e.embedding::double[]) as s from c, embeddings e)
select label, round(avg(s) filter (where own), 4) as mean_in, round(avg(s) filter (where not own), 4) as mean_out, round(avg(s) filter (where own) - avg(s) filter (where not own), 6) >= 0.15 as passed from s group by 1""")
def label_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether vectors of a label are nearer to its mean than other vectors are."""
    vectors = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    spread = vectors.select("label", F.posexplode(unit(F.col("v"))).alias("i", "x"))
    means = spread.groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))
    # Labels are classes, few by their nature: all their means are one row.
    every = means.agg(F.collect_list(F.struct("label", "c")).alias("every")).withColumn("__one", F.lit(1))
    pairs = vectors.withColumn("__one", F.lit(1)).join(F.broadcast(every), "__one").select("label", "v", F.explode("every").alias("e"))
    scored = pairs.select(F.col("e.label").alias("of"), F.col("label"), cosine(F.col("e.c"), F.col("v")).alias("s"))
    return ev.separation(scored, "of", F.col("label") == F.col("of"), "s", 0.15).withColumnRenamed("of", "label")


@registry.query(sql="""with n as (select o_custkey, o_orderkey, o_totalprice, lead(o_totalprice) over w as a, first_value(o_totalprice) over w as f from orders window w as (partition by o_orderpriority order by md5(o_orderkey::varchar), o_orderkey rows between unbounded preceding and unbounded following)),
m as (select o_orderkey, lead(o_totalprice) over (partition by o_orderpriority order by md5(o_orderkey::varchar), o_orderkey) as a, first_value(o_totalprice) over (partition by o_orderpriority order by md5(o_orderkey::varchar), o_orderkey) as f from orders)
select o_orderkey, coalesce(a, f) as other from m""")
def shuffled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the price of another of its priority: a fixed reassignment."""
    return ev.derangement(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", "o_totalprice").select("o_orderkey", "other")


@registry.query(sql="""with s as (select l_shipmode, l_extendedprice as v, row_number() over (partition by l_shipmode order by l_extendedprice) as r, count(*) over (partition by l_shipmode) as n from lineitem)
select l_shipmode as mode, v as p95, n from s where r = least((n * 95) // 100, n - 1) + 1""".replace("l_shipmode", "l_linenumber"))
def price_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact 95th percentile price of each line number."""
    found = rp.exact_order_statistic(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_extendedprice", 95)
    return found.select(F.col("l_linenumber").alias("mode"), F.col("l_extendedprice").alias("p95"), "n")


@registry.query(sql="""with d as (select (ts::date)::varchar as day, round(avg((event_type = 'purchase')::int), 6) as score from events where ts is not null group by 1), l as (select *, lag(score) over (order by day) as before from d)
select day, score, before, case when before is null then 'first' when (before - score) * 100 > 2.0 + 1e-9 then 'fell' else 'held' end as verdict from l""")
def daily_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's share of purchases against the day before: whether it fell by more than two points."""
    days = table(spark, sf_dir, "events").filter("ts is not null").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.round(F.avg((F.col("event_type") == "purchase").cast("int")), 6).alias("score"))
    before = F.lag("score").over(Window.orderBy("day"))  # one row a day
    return days.withColumn("before", before).withColumn("verdict", rp.regression(F.col("score"), F.col("before")))


@registry.query(sql="select user_id, event_id, epoch_us(ts) as ts_us from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 2")
def previous_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event but one of every user."""
    latest = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    second = m.top_k(latest, "user_id", "at", "event_id", 2, "n").filter("n = 2")
    return second.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


@registry.query(sql=r"select ingest_id, place from (select ingest_id, row_number() over (order by fetched_at desc nulls last, ingest_id) as place from smartrecruiters_postings where regexp_matches(lower(name), '\b(?:engineer|analyst|nurse)\b')) where place > 10 and place <= 60")
def keyword_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page, of 50 after 10, of the latest postings whose title names a keyword."""
    t = table(spark, sf_dir, "smartrecruiters_postings").filter(F.lower("name").rlike(r"\b(?:engineer|analyst|nurse)\b"))
    return rp.batches(t, [F.col("fetched_at").desc_nulls_last(), F.col("ingest_id")], 60, 50).filter("place > 10").select("ingest_id", "place")


@registry.query(sql=f"""with d as (select board, (fetched_at::date) as day, count(*) as n from lever_postings where board is not null group by 1, 2),
recent as (select board, median(n) as median_n, count(*) as runs from d where day > (select max(day) from d) - 7 group by 1), last as (select board, max(fetched_at) as seen from lever_postings group by 1),
open as (select board, count(distinct id) as postings from lever_postings group by 1)
select s.source_id, s.enabled, epoch_us(last.seen) as last_us, recent.median_n, recent.runs, coalesce(open.postings, 0) as postings from job_sources s
left join last on last.board = s.name left join recent on recent.board = s.name left join open on open.board = s.name""")
def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source with its last fetch, the median of its daily rows over the last seven days, and its postings."""
    rows = table(spark, sf_dir, "lever_postings").filter("board is not null")
    days = rows.groupBy("board", F.to_date("fetched_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    end = rows.agg(F.max(F.to_date("fetched_at"))).first()[0]
    recent = days.filter(F.col("day") > F.date_sub(F.lit(end).cast("date"), 7)).groupBy("board").agg(F.percentile("n", F.lit(0.5)).alias("median_n"), F.count(F.lit(1)).alias("runs"))
    totals = rows.groupBy("board").agg(F.unix_micros(F.max("fetched_at").cast("timestamp")).alias("last_us"), F.count_distinct("id").alias("postings"))
    sources = table(spark, sf_dir, "job_sources").select("source_id", "enabled", F.col("name").alias("board"))
    return sources.join(totals, "board", "left").join(recent, "board", "left").select("source_id", "enabled", "last_us", "median_n", "runs", F.coalesce("postings", F.lit(0)).alias("postings"))


@registry.query(sql=f"""select (select count(*) from lever_postings) as n_rows, (select count(*) from (select distinct board, id from lever_postings)) as postings,
(select count(*) from lever_postings where applyUrl is null or applyUrl = '') as missing_link, (select count(distinct company_name) from job_sources) as companies,
(select count(*) from job_sources where enabled) as enabled_sources, (select count(*) from job_sources where not enabled) as disabled_sources,
(select count(*) from (select board, id from lever_postings group by 1, 2 having count(*) > 1)) as delivered_again,
(select round((epoch({_NOW}) - epoch(max(fetched_at))) / 3600.0, 3) from lever_postings) as newest_age_hours,
(select count(*) from (select lower(trim(regexp_replace(company.identifier, '{_WS}', ' ', 'g'))) as k from smartrecruiters_postings where company.identifier is not null group by 1 having count(distinct company.identifier) > 3)) as many_spellings,
(select count(*) from (select hostedUrl from lever_postings where hostedUrl <> '' group by 1 having count(*) > 8)) as shared_links""")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of figures about the corpus: sizes, gaps, sources, repeated deliveries, age, and signs of wrong merges."""
    lever, sources, smart = (table(spark, sf_dir, t) for t in ("lever_postings", "job_sources", "smartrecruiters_postings"))
    per = lever.groupBy("board", "id").agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)).alias("postings"), F.count(F.when(F.col("k") > 1, 1)).alias("delivered_again"))
    flat = lever.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.coalesce("applyUrl", F.lit("")) == "", 1)).alias("missing_link"),
        F.round((F.unix_micros(_now().cast("timestamp")) - F.unix_micros(F.max("fetched_at").cast("timestamp"))) / 3.6e9, 3).alias("newest_age_hours"))
    names = sources.agg(F.count_distinct("company_name").alias("companies"), F.count(F.when(F.col("enabled"), 1)).alias("enabled_sources"), F.count(F.when(~F.col("enabled"), 1)).alias("disabled_sources"))
    raw = F.col("company.identifier")
    spelt = smart.filter(raw.isNotNull()).groupBy(F.lower(F.trim(F.regexp_replace(raw, r"(?U)\s+", " "))).alias("k")).agg(F.count_distinct(raw).alias("n")).agg(F.count(F.when(F.col("n") > 3, 1)).alias("many_spellings"))
    shared = sn.ambiguous_values(lever.select(F.col("hostedUrl").alias("value")).filter("value <> ''"), "value").agg(F.count(F.lit(1)).alias("shared_links"))
    one = lambda df: df.withColumn("__one", F.lit(1))  # noqa: E731 - each side is a single row
    return reduce(lambda a, b: a.join(b, "__one"), map(one, (flat, per, names, spelt, shared))).drop("__one")


@registry.query(sql=r"""with l as (select board, id, arg_max(struct_pack(descriptionPlain, ingest_id, fetched_at), (fetched_at, ingest_id)) as r from lever_postings group by 1, 2),
p as (select r.ingest_id as ingest_id, row_number() over (order by r.fetched_at desc nulls last, r.ingest_id) as place from l where trim(coalesce(r.descriptionPlain, '')) = '')
select ingest_id, place, (place - 1) // 25 as batch from p where place <= 500""")
def detail_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 500 postings whose body is still missing, in batches of 25."""
    latest = sn.latest_per_key(table(spark, sf_dir, "lever_postings").select("board", "id", "descriptionPlain", "ingest_id", "fetched_at"), ["board", "id"], ["fetched_at", "ingest_id"])
    empty = latest.filter(F.trim(F.coalesce("descriptionPlain", F.lit(""))) == "")
    return rp.batches(empty, [F.col("fetched_at").desc_nulls_last(), F.col("ingest_id")], 500, 25).select("ingest_id", "place", "batch")


@registry.query(sql=f"""with l as (select board, max(fetched_at) as seen from lever_postings group by 1)
select source_id, cast(floor(epoch({_NOW}) / 3600) as bigint) as hour_bucket from job_sources left join l on board = name where enabled and (seen is null or seen < {_NOW} - interval 24 hours)""")
def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enabled sources not fetched for a day, or never, with the hour bucket that names the run."""
    last = table(spark, sf_dir, "lever_postings").groupBy(F.col("board").alias("name")).agg(F.max("fetched_at").alias("at"))
    sources = table(spark, sf_dir, "job_sources").filter("enabled").join(last, "name", "left")
    return rp.due_since(sources, "at", _now(), 24).select("source_id", "hour_bucket")


@registry.query(sql=f"""with e as (select user_id, max(ts) filter (where event_type = 'view') as seen from events group by 1)
select user_id, place from (select user_id, row_number() over (order by seen asc nulls first, user_id) as place from e where seen is null or seen < {_NOW} - interval 7 days) where place <= 100""")
def longest_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred users whose last view is longest ago, those without one first."""
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("seen"))
    late = rp.due_since(seen, "seen", _now(), 7 * 24)
    return rp.batches(late, [F.col("seen").asc_nulls_first(), F.col("user_id")], 100, 100).select("user_id", "place")


@registry.query(sql=f"""select strftime(fetched_at, '%Y%m') as month, count(*) as n_rows, date_trunc('month', fetched_at) + interval 1 month <= (select max(fetched_at) from raw_payloads) - interval 90 days as dropped
from raw_payloads where fetched_at is not null group by 1, date_trunc('month', fetched_at)""")
def payload_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of raw payloads, and which of them lie wholly before the last 90 days and can go."""
    t = table(spark, sf_dir, "raw_payloads").filter("fetched_at is not null")
    newest = t.agg(F.max("fetched_at")).first()[0]
    months = t.groupBy(F.date_trunc("month", "fetched_at").alias("begin")).agg(F.count(F.lit(1)).alias("n_rows"))
    over = F.add_months("begin", 1).cast("timestamp_ntz") <= F.lit(newest).cast("timestamp_ntz") - F.expr("interval 90 days")
    return months.select(F.date_format("begin", "yyyyMM").alias("month"), "n_rows", over.alias("dropped"))


@registry.query(sql="select user_id from events where event_type in ('signup', 'error') group by 1 having arg_max(event_type, (ts, event_id)) = 'signup'")
def currently_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose last event of two kinds that undo each other is the first kind."""
    two = table(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "error"))
    return sn.latest_per_key(two, ["user_id"], ["ts", "event_id"]).filter("event_type = 'signup'").select("user_id")


@registry.query(sql="select count(*) filter (where event_type = 'click') as clicks, count(distinct user_id) filter (where event_type = 'purchase') as buyers, round(coalesce(sum(value) filter (where event_type = 'purchase'), 0), 2) as spent from events")
def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three totals over different events, in one pass."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").agg(
        F.count(F.when(kind == "click", 1)).alias("clicks"), F.count_distinct(F.when(kind == "purchase", F.col("user_id"))).alias("buyers"), F.round(F.coalesce(F.sum(F.when(kind == "purchase", F.col("value"))), F.lit(0.0)), 2).alias("spent")
    )


@registry.query(sql="""with e as (select user_id, event_type = 'error' as bad, sum((event_type <> 'error')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from events),
s as (select user_id, arg_max(n, run)::bigint as n from (select user_id, run, sum(bad::int) as n from e group by 1, 2) group by 1) select user_id, n as failures, [1, 5, 25][n] as wait_minutes from s where n > 0""")
def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose last events are errors, with the wait before the next attempt; null where attempts are used up."""
    streaks = sn.longest_streak(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").filter("current > 0")
    return streaks.select("user_id", F.col("current").alias("failures"), rp.retry_after(F.col("current"), [1, 5, 25]).alias("wait_minutes"))


@registry.query(sql="select kind, count(*) as entries, array_to_string(array_agg(canonical_name order by canonical_name) filter (where country is not null), ';') as with_country from canon_values group by 1")
def names_with_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each kind, and the names of those with a country."""
    listed = F.array_sort(F.collect_list(F.when(F.col("country").isNotNull(), F.col("canonical_name"))))
    return table(spark, sf_dir, "canon_values").groupBy("kind").agg(F.count(F.lit(1)).alias("entries"), F.when(F.size(listed) > 0, F.array_join(listed, ";")).alias("with_country"))


@registry.query(sql="select ingest_id, canon_id from lever_postings join canon_values on categories.location = any(list_append(aliases, canonical_name)) where kind = 'place'")
def named_exactly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lever postings whose place is written exactly as a name or alias of an entry."""
    names = table(spark, sf_dir, "canon_values").filter("kind = 'place'").select("canon_id", F.explode(F.array_distinct(F.array_append("aliases", F.col("canonical_name")))).alias("place"))
    return table(spark, sf_dir, "lever_postings").select("ingest_id", F.col("categories.location").alias("place")).join(names, "place").select("ingest_id", "canon_id")


@registry.query(sql="select ingest_id, canon_id from smartrecruiters_postings join canon_values on location.fullLocation like canonical_name || '%' where kind = 'place'")
def names_beginning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings whose place begins with an entry's name."""
    places = table(spark, sf_dir, "smartrecruiters_postings").select("ingest_id", F.col("location.fullLocation").alias("place")).filter("place is not null")
    return rp.prefix_join(places, "place", table(spark, sf_dir, "canon_values").filter("kind = 'place'").select("canon_id", "canonical_name"), "canonical_name").select("ingest_id", "canon_id")


@registry.query(sql="select l_orderkey, l_linenumber from lineitem where l_partkey in (select p_partkey from part where p_size > 45) or l_suppkey in (select s_suppkey from supplier where s_acctbal < 0)")
def either_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a large part or of a supplier in debt."""
    parts, debtors = table(spark, sf_dir, "part").filter("p_size > 45").select("p_partkey"), table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select("s_suppkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rp.matching_either(lines, ("l_partkey", parts), ("l_suppkey", debtors)).select("l_orderkey", "l_linenumber")


@registry.query(sql="select o_orderkey from orders o where o_totalprice > 1.5 * (select avg(o_totalprice) from orders i where i.o_custkey = o.o_custkey)")
def above_own_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders well above their customer's average."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    mean = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean"))
    return o.join(mean, "o_custkey").filter(F.col("o_totalprice") > 1.5 * F.col("mean")).select("o_orderkey")


@registry.query(sql="select event_id, cast(json_extract(props, '$.k') as bigint) as k, json_extract_string(props, '$.k') as k_text from events")
def json_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member of each event's properties, as number and as text."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.cast("bigint").alias("k"), k.alias("k_text"))


@registry.query(sql="select l_orderkey, min(l_linenumber)::bigint as lower, (max(l_linenumber) + 1)::bigint as upper from lineitem group by 1")
def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line numbers of each order written as a half-open range, and its bounds read back."""
    spans = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.format_string("[%d,%d)", F.min("l_linenumber"), F.max("l_linenumber") + 1).alias("span"))
    bounds = rp.range_bounds(F.col("span"))
    return spans.select("l_orderkey", bounds["lower"].alias("lower"), bounds["upper"].alias("upper"))


@registry.query(sql="select event_id from events where ts >= (select max(ts) from events) - interval 36 hours and ts < (select max(ts) from events) - interval 12 hours")
def recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events between 36 and 12 hours before the last one."""
    t = table(spark, sf_dir, "events")
    end = F.lit(t.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    ts = F.col("ts").cast("timestamp_ntz")
    return t.filter((ts >= end - F.expr("interval 36 hours")) & (ts < end - F.expr("interval 12 hours"))).select("event_id")


@registry.query(sql="""with o as (select lower(trim(typeOfEmployment.label)) as token, count(*) as n from smartrecruiters_postings where typeOfEmployment.label is not null group by 1),
w as (select lower(trim(employment_type)) as token, count(*) as n from workable_jobs where employment_type is not null group by 1), c as (select distinct lower(x) as token from (select canonical_name as x from canon_values union all select unnest(aliases) from canon_values))
select token, sum(n)::bigint as n from (select * from o union all select * from w) where token <> '' and token not in (select token from c where token is not null) group by 1""")
def unmapped_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed kinds of employment that no entry names as they stand, counted over two feeds, one added to the other."""
    def counted(name: str, col: str) -> DataFrame:
        return table(spark, sf_dir, name).groupBy(F.lower(F.trim(F.col(col))).alias("token")).agg(F.count(F.lit(1)).alias("n")).filter("token <> ''")

    canon = table(spark, sf_dir, "canon_values")
    names = canon.select("canonical_name").union(canon.select(F.explode("aliases"))).select(F.lower("canonical_name").alias("token")).distinct()
    both = rp.add_counts(counted("smartrecruiters_postings", "typeOfEmployment.label"), counted("workable_jobs", "employment_type"), ["token"], "n")
    return both.join(names, "token", "left_anti")


@registry.query(sql=r"""with u as (select ingest_id, applyUrl as a, hostedUrl as h from lever_postings), d as (select ingest_id, a, h from u)
select ingest_id, case when a is null then null else regexp_replace(trim(a), '\?$', '') end as link from d where not regexp_matches(coalesce(a, ''), '(?i)[?&](utm_|fbclid|gclid|msclkid|mc_)')""")
def links_to_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application links that carry nothing for analytics, unchanged by its removal."""
    t = table(spark, sf_dir, "lever_postings").filter(~F.coalesce("applyUrl", F.lit("")).rlike(r"(?i)[?&](utm_|fbclid|gclid|msclkid|mc_)"))
    return t.select("ingest_id", po.without_parameters(F.col("applyUrl"), po.ANALYTICS).alias("link"))


_DOMAIN = f"""case when len(l) >= 2 then case when len(l) >= 3 and array_to_string(l[-2:], '.') in ({_COMPOUND}) then array_to_string(l[-3:], '.') else array_to_string(l[-2:], '.') end end"""
_OWN = f"case when {_DOMAIN} not in ({_SHARED}) then {_DOMAIN} end"


@registry.query(sql=f"""with u as (select ingest_id, applyUrl as a, hostedUrl as h, string_split({_HOST.format(u='applyUrl')}, '.') as la, string_split({_HOST.format(u='hostedUrl')}, '.') as lh from lever_postings)
select ingest_id, coalesce({_OWN.replace('l[', 'la[').replace('len(l)', 'len(la)')}, {_OWN.replace('l[', 'lh[').replace('len(l)', 'len(lh)')}) as domain,
case when trim(a, ' ') <> '' then trim(a, ' ') when trim(h, ' ') <> '' then trim(h, ' ') end as link, case when trim(a, ' ') <> '' then 'ats_native' when trim(h, ' ') <> '' then 'canonical' end as method from u""")
def employer_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The employer's own domain among the addresses of a posting, and the link to apply by with where it comes from."""
    t = table(spark, sf_dir, "lever_postings")
    link = vo.apply_link(F.col("applyUrl"), F.col("hostedUrl"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("hostedUrl"))
    return t.select("ingest_id", po.company_domain(F.col("applyUrl"), F.col("hostedUrl")).alias("domain"), link["url"].alias("link"), link["method"].alias("method"))


_AR, _LAT = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]", "[A-Za-z]"


@registry.query(sql=f"""with n as (select doc_id, length(text) - length(regexp_replace(text, '{_AR}', '', 'g')) as a, length(text) - length(regexp_replace(text, '{_LAT}', '', 'g')) as l from documents)
select doc_id, a + l > 0 and a >= 0.10 * (a + l) and l >= 0.10 * (a + l) as mixed from n""")
def mixed_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether both scripts have a tenth of the letters of each whole document."""
    return table(spark, sf_dir, "documents").select("doc_id", script.is_mixed_script(F.col("text")).alias("mixed"))


@registry.query(sql=f"""with s as (select doc_id, text, split_part(trim(text, ' '), chr(10), 1) as q from documents where text is not null)
select doc_id, case when regexp_replace(q, '{_WS}', '', 'g') <> '' then instr(text, q) - 1 end as start from s""")
def grounded_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first line of each document stands in it: a quote found again in its source."""
    t = table(spark, sf_dir, "documents").filter("text is not null").withColumn("q", F.substring_index(F.trim("text"), "\n", 1))
    return t.select("doc_id", ex.find_span("text", "q")["start"].alias("start"))


@registry.query()
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without personal data and the name at their head: how many values went, what is left, and whether they can be restored."""
    t = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", ex.redact_names("text", F.lit(None).cast("string")).alias("r"))
    return t.select("doc_id", F.size(F.map_keys("r.values")).alias("n_values"), F.array_join("r.left", ",").alias("left_over"), F.md5("r.text").alias("text_md5"))


@registry.query()
def places_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place entries that each typed place of the largest feed names, by any of their names: a taxonomy with aliases."""
    canon = table(spark, sf_dir, "canon_values").filter("kind = 'place'").select("canonical_name", "aliases")
    return sk.skills_in(table(spark, sf_dir, "smartrecruiters_postings").select("ingest_id", "location.fullLocation"), canon, "ingest_id", "fullLocation")


_PLACES = """with p as (select 'greenhouse' as source, ingest_id, unnest(list_concat([location.name], coalesce(list_transform(offices, lambda x: x.name), []))) as place from greenhouse_jobs
union all select 'lever', ingest_id, categories.location from lever_postings
union all select 'ashby', ingest_id, unnest(list_concat([location], coalesce(list_transform(secondaryLocations, lambda x: x.location), []))) from ashby_jobs
union all select 'workable', ingest_id, unnest(case when len(list_filter(l, lambda x: x <> '')) > 0 then l else [concat_ws(', ', nullif(trim(city, ' '), ''), nullif(trim(country, ' '), ''))] end) from (
  select ingest_id, city, country, list_transform(list_filter(locations, lambda x: not coalesce(x.hidden, false)), lambda x: concat_ws(', ', nullif(trim(x.city, ' '), ''), nullif(trim(x.region, ' '), ''), nullif(trim(x.country, ' '), ''))) as l from workable_jobs)
union all select 'smartrecruiters', ingest_id, coalesce(nullif(trim(location.fullLocation, ' '), ''), concat_ws(', ', nullif(trim(location.city, ' '), ''), nullif(trim(location.country, ' '), ''))) from smartrecruiters_postings)
select distinct source, ingest_id, trim(place, ' ') as place from p where trim(place, ' ') <> ''"""


@registry.query(sql=_PLACES)
def posting_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place that a posting of any feed names."""
    return feeds.posting_places(spark, sf_dir)


@registry.query()
def skills_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills that each lever posting's requirements ask for, with what may stand in for them."""
    t = table(spark, sf_dir, "lever_postings").select("ingest_id", F.explode(ex.requirements("descriptionPlain")).alias("r"))
    asked = t.filter(F.col("r.kind").isin("skill", "experience")).select(F.col("ingest_id").alias("query"), F.col("r.must_have").alias("must"), F.col("r.text").alias("text"))
    out = sk.expand_requirements(asked, _taxonomy(spark))
    return out.select("query", "must", "skill", F.array_join("alternatives", ",").alias("alternatives"))
