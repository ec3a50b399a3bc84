"""Queries of the general data problems: skewed keys, nested records, mixed timestamps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.instants import notation, utc_micros, wall_micros
from loomwork.functions.text import folded_key
from loomwork.operators.heavy_keys import keys_above_share, skew_safe_aggregate, skew_safe_join
from loomwork.operators.joins import lookup_join
from loomwork.operators.nested_json import child_rows
from loomwork.queries import Registry
from loomwork.session import table

registry = Registry()

#: Share of a feed's rows above which an employer is reported.
EMPLOYER_SHARE = 0.05


def employers(spark: SparkSession, sf_dir: str, feed: str) -> DataFrame:
    """Rows of a feed with the employer's key, null where there is none."""
    name, key = {"smartrecruiters": ("smartrecruiters_postings", "company.identifier"), "greenhouse": ("greenhouse_jobs", "company_name")}[feed]
    return table(spark, sf_dir, name).select(folded_key(F.col(key)).alias("company_key"), "ingest_id", "board", "fetched_at", F.col("id").cast("string").alias("posting_id"))


_KEY = r"nullif(trim(regexp_replace(lower({}), '[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+', ' ', 'g')), '')"
_KEYED = f"""select 'smartrecruiters' as feed, {_KEY.format('company.identifier')} as company_key, ingest_id, board, fetched_at, cast(id as varchar) as posting_id from smartrecruiters_postings
union all select 'greenhouse', {_KEY.format('company_name')}, ingest_id, board, fetched_at, cast(id as varchar) from greenhouse_jobs"""


@registry.query(sql=f"""with k as ({_KEYED}), n as (select feed, count(*) as total from k group by feed)
select k.feed, company_key from k join n using (feed) where company_key is not null group by k.feed, company_key, total having count(*) > 0.05 * total""")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employers holding more than 5 % of all rows of their feed table."""
    parts = [
        keys_above_share(employers(spark, sf_dir, feed), "company_key", EMPLOYER_SHARE).select(F.lit(feed).alias("feed"), "company_key")
        for feed in ("smartrecruiters", "greenhouse")
    ]
    return reduce(DataFrame.unionByName, parts)


@registry.query(sql=f"""with k as ({_KEYED}) select feed, company_key, count(*) as n_rows, min(ingest_id) as first_ingest,
epoch_us(max(fetched_at)) as last_fetched_us, arg_max(ingest_id, (fetched_at, ingest_id)) as last_ingest from k where company_key is not null group by 1, 2""")
def p1_employer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an employer and feed: rows, first ingest, last fetch and its row; heavy employers go the broadcast way."""
    parts = []
    for feed in ("smartrecruiters", "greenhouse"):
        stats = skew_safe_aggregate(
            employers(spark, sf_dir, feed).withColumn("at", F.struct("fetched_at", "ingest_id")),
            "company_key",
            {"n": F.count(F.lit(1)), "lo": F.min("ingest_id"), "hi": F.max("at")},
            {"n_rows": F.sum("n"), "first_ingest": F.min("lo"), "last": F.max("hi")},
        )
        parts.append(stats.select(F.lit(feed).alias("feed"), "company_key", "n_rows", "first_ingest",
            wall_micros(F.col("last.fetched_at")).alias("last_fetched_us"), F.col("last.ingest_id").alias("last_ingest")))
    return reduce(DataFrame.unionByName, parts)


@registry.query(sql=f"""with k as ({_KEYED}), s as (select feed, company_key, count(*) as n, max(fetched_at) as last from k where company_key is not null group by 1, 2)
select k.feed, k.ingest_id, k.company_key, s.n as employer_rows, (k.fetched_at = s.last)::int as is_latest from k left join s on k.feed = s.feed and k.company_key = s.company_key""")
def p1_posting_employer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its employer's size and whether it is of the employer's latest fetch: a join on the skewed key."""
    parts = []
    for feed in ("smartrecruiters", "greenhouse"):
        rows = employers(spark, sf_dir, feed)
        stats = skew_safe_aggregate(rows, "company_key", {"n": F.count(F.lit(1)), "hi": F.max("fetched_at")}, {"employer_rows": F.sum("n"), "last_fetched": F.max("hi")})
        joined = skew_safe_join(rows, stats, "company_key", "left")
        parts.append(joined.select(F.lit(feed).alias("feed"), "ingest_id", "company_key", "employer_rows", (F.col("fetched_at") == F.col("last_fetched")).cast("int").alias("is_latest")))
    return reduce(DataFrame.unionByName, parts)


@registry.query()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per child of a job in a raw payload that holds a value, with its place."""
    return child_rows(table(spark, sf_dir, "raw_payloads")).select("payload_id", "job_id", "child", "pos1", "pos2").distinct()


@registry.query()
def p2_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat child table with each child's JSON text, linked to payload, job and position."""
    return child_rows(table(spark, sf_dir, "raw_payloads"))


#: Fields that hold a written timestamp, by feed.
WRITTEN = {"lever_postings": "createdAt", "greenhouse_jobs": "updated_at", "workable_jobs": "published_on", "smartrecruiters_postings": "releasedDate"}


def written_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ingest_id, feed, written value, and the board's zone and date order."""
    feeds = [table(spark, sf_dir, t).select("ingest_id", "board", F.lit(t).alias("feed"), F.col(f).alias("written")) for t, f in WRITTEN.items()]
    sources = table(spark, sf_dir, "job_sources").select(F.col("name").alias("board"), "tz_name", "date_order")
    return lookup_join(reduce(DataFrame.unionByName, feeds), sources, "board")


@registry.query()
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the four feeds whose field holds a readable instant, as microseconds UTC."""
    rows = written_timestamps(spark, sf_dir)
    return rows.select("ingest_id", utc_micros(F.col("written"), F.col("tz_name"), F.col("date_order")).alias("utc_us")).filter(F.col("utc_us").isNotNull())


@registry.query()
def p4_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by feed and notation, and how many of them were unreadable or without a zone."""
    rows = written_timestamps(spark, sf_dir).select("feed", notation(F.col("written")).alias("notation"), utc_micros(F.col("written"), F.col("tz_name"), F.col("date_order")).alias("u"))
    return rows.groupBy("feed", "notation").agg(F.count(F.lit(1)).alias("n_rows"), F.count("u").alias("n_read"))
