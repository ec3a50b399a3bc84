"""Queries of feeds, snapshots, addresses, scripts, copies and extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import extraction as ex
from loomwork.functions import postings as po
from loomwork.functions import script
from loomwork.functions import vocabulary as vo
from loomwork.functions.instants import utc_micros, wall_micros
from loomwork.functions.text import blank_to_null
from loomwork.functions.vectors import simhash
from loomwork.functions.vocabulary import platform_of
from loomwork.operators import snapshots as sn
from loomwork.operators.clusters import cluster_postings
from loomwork.operators.entities import company_key, resolve_names
from loomwork.operators.joins import lookup_join
from loomwork.operators.skills import alignment, coverage, hash_embedding, skills_in, unsupported_claims
from loomwork.queries import Registry
from loomwork.session import materialize, table
from loomwork.sources import feeds
from loomwork.sources.feeds import ADAPTERS, normalized_postings, pay_range
from loomwork.streaming.ingest import drain, windowed_counts

registry = Registry()

#: A small taxonomy and requests for the queries on skills.
_SKILLS = ["Python", "SQL", "Kotlin", "Rust", "Terraform", "TypeScript"]
_REQUESTS = {"data": [("Python", True), ("SQL", True), ("Terraform", False)], "apps": [("Kotlin", True), ("TypeScript", False)]}


def _taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, None) for s in _SKILLS], "canonical_name string, aliases array<string>")


def _country_hints(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Names of the countries of canon_values and their codes."""
    return {r["country"].lower(): r["country_code"] for r in table(spark, sf_dir, "canon_values").filter("country is not null").select("country", "country_code").distinct().orderBy("country").collect()}


@registry.query(sql="""select board, id, arg_max(ingest_id, (fetched_at, ingest_id)) as ingest_id from lever_postings group by 1, 2""")
def latest_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest delivery of every lever posting."""
    return sn.latest_per_key(table(spark, sf_dir, "lever_postings").select("board", "id", "fetched_at", "ingest_id"), ["board", "id"], ["fetched_at", "ingest_id"]).drop("fetched_at")


_HALVES = """d as (select board, id, text as title, descriptionPlain as body, ingest_id, fetched_at, ingest_id % 2 as half from lever_postings),
l as (select half, board, id, arg_max(struct_pack(title, body, ingest_id), (fetched_at, ingest_id)) as r from d group by 1, 2, 3),
o as (select board, id, r.title as title, r.body as body, r.ingest_id as first_ingest from l where half = 0), n as (select board, id, r.title as title, r.body as body, r.ingest_id as first_ingest from l where half = 1)"""


@registry.query(sql=f"""with {_HALVES} select coalesce(o.board, n.board) as board, coalesce(o.id, n.id) as id, case when n.id is not null then n.title else o.title end as title,
md5(coalesce(case when trim(coalesce(n.body, '')) <> '' then n.body else coalesce(o.body, n.body) end, '')) as body_md5, coalesce(o.first_ingest, n.first_ingest) as first_ingest,
case when o.id is null then 'inserted' when n.id is not null then 'updated' else 'kept' end as op from o full join n on o.board = n.board and o.id = n.id""")
def posting_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot of even ingests after the upsert of odd ones: bodies never blanked, the first ingest kept."""
    rows = table(spark, sf_dir, "lever_postings").select("board", "id", F.col("text").alias("title"), F.col("descriptionPlain").alias("body"), F.col("ingest_id").alias("first_ingest"), "fetched_at")
    half = lambda h: sn.latest_per_key(rows.filter(F.col("first_ingest") % 2 == h), ["board", "id"], ["fetched_at", "first_ingest"]).drop("fetched_at")
    merged = sn.merge_snapshot(half(0), half(1), ["board", "id"], keep_old=["first_ingest"], never_blank=["body"])
    return merged.select("board", "id", "title", F.md5(F.coalesce("body", F.lit(""))).alias("body_md5"), "first_ingest", "op")


_BOARDS = "w as (" + " union ".join(f"select board from {t}" for t in ("lever_postings", "ashby_jobs", "workable_jobs")) + ")"


@registry.query(sql=f"""with {_BOARDS}, a as (select name, enabled from job_sources where name is not null), b as (select board as name from w where board is not null)
select coalesce(a.name, b.name) as name, case when b.name is not null then coalesce(enabled, true) else false end as enabled,
case when a.name is null then 'added' when b.name is null and enabled then 'disabled' else 'unchanged' end as op from a full join b on a.name = b.name""")
def registry_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source registry against the boards of three feeds."""
    boards = reduce(DataFrame.unionByName, [table(spark, sf_dir, t).select(F.col("board").alias("name")) for t in ("lever_postings", "ashby_jobs", "workable_jobs")])
    return sn.sync_registry(table(spark, sf_dir, "job_sources"), boards, "name")


@registry.query(sql="""with c as (select board, (fetched_at::date)::varchar as day, count(*) as n from lever_postings where board is not null group by 1, 2),
h as (select *, list(n) over (partition by board order by day rows between 7 preceding and 1 preceding) as b from c)
select board, day, n, case when len(b) >= 3 then list_median(b) end as median_before, case when coalesce(len(b), 0) < 3 then 'unknown' when n < 0.2 * list_median(b) then 'suspect' else 'ok' end as status from h""".replace("list_median(b)", "list_aggregate(b, 'median')"))
def feed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each board's daily rows against the median of its seven days with rows before."""
    counts = table(spark, sf_dir, "lever_postings").filter("board is not null").groupBy("board", F.to_date("fetched_at").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return sn.count_health(counts, "board", "day", "n")


@registry.query(sql="""with e as (select user_id, event_type = 'error' as bad, row_number() over w as n, sum((event_type <> 'error')::int) over w as run from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)),
r as (select user_id, run, sum(bad::int) as len from e group by 1, 2) select user_id, max(len)::bigint as longest, arg_max(len, run)::bigint as current from r group by 1""")
def error_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest and current run of errors of every user."""
    return sn.longest_streak(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@registry.query(sql="""select count(*) as n_rows, count(distinct board) as boards, count(distinct (board, id)) as postings, epoch_us(max(fetched_at)) as last_us,
sum((trim(coalesce(descriptionPlain, '')) = '')::int)::bigint as blank_bodies from lever_postings""")
def feed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of totals of the lever feed."""
    t = table(spark, sf_dir, "lever_postings")
    return t.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("board").alias("boards"), F.count_distinct(F.struct("board", "id")).alias("postings"),
        F.max(wall_micros(F.col("fetched_at"))).alias("last_us"), F.sum((F.trim(F.coalesce("descriptionPlain", F.lit(""))) == "").cast("bigint")).alias("blank_bodies"))


@registry.query(sql="select text as value, count(*) as n from documents where text is not null group by 1 having count(*) > 8")
def shared_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that more than eight documents share and that identify none of them."""
    return sn.ambiguous_values(table(spark, sf_dir, "documents").select(F.col("text").alias("value")), "value")


@registry.query(sql="""with d as (select doc_id, md5(text) as h, length(text) as len from documents where text is not null)
select h as text_md5, count(*) as n, arg_min(doc_id, (-len, doc_id)) as canonical_id from d group by 1 having count(*) > 1""")
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of identical documents with their canonical member."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.md5("text").alias("text_md5"))
    return d.groupBy("text_md5").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("canonical_id")).filter("n > 1")


@registry.query()
def posting_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lever and ashby posting with its cluster of the same job, the cluster's size and canonical member, and the rule that brought it there; re-deliveries share a cluster."""
    posts = normalized_postings(spark, sf_dir, ["lever", "ashby"], keep=["board"])
    sources = table(spark, sf_dir, "job_sources").select(F.col("name").alias("board"), company_key("company_name").alias("company"), "tier", "tz_name", "date_order")
    p, address = vo.place_parts(F.col("location"), _country_hints(spark, sf_dir)), F.coalesce(blank_to_null(F.col("apply_url")), F.col("url"))
    rows = lookup_join(posts, sources, "board").select(
        "ingest_id", F.concat_ws("/", "source", "board").alias("source"), "external_id", F.nullif(po.canonical_url(address), F.lit("")).alias("url_key"),
        F.coalesce(F.nullif("company", F.lit("")), F.lit("?")).alias("company"), F.col("title_normalized").alias("title"), po.title_head(F.col("title_normalized"), 3).alias("head"),
        F.coalesce(F.lower(F.coalesce(p["city"], p["country"])), F.lit("")).alias("location"), F.coalesce(F.length("description"), F.lit(0)).alias("len"), simhash("description").alias("print"),
        F.coalesce(F.col("tier") == 1, F.lit(False)).alias("native"), F.coalesce(utc_micros(F.col("written_at"), F.col("tz_name"), F.col("date_order")), F.lit(2**63 - 1)).alias("posted_us"),
    )
    return cluster_postings(materialize(rows, "candidates"))


_HOST = r"nullif(regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', ''), '')"


@registry.query(sql=f"""with u as (select ingest_id, {_HOST.format(u='applyUrl')} as host from lever_postings union all select ingest_id, {_HOST.format(u='url')} from workable_jobs),
l as (select *, string_split(host, '.') as p from u) select ingest_id, host, case when len(p) >= 2 then case when len(p) >= 3 and array_to_string(p[-2:], '.') in ('co.uk', 'com.au', 'com.br') then array_to_string(p[-3:], '.') else array_to_string(p[-2:], '.') end end as domain from l""")
def url_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and registrable domain of the addresses of two feeds."""
    urls = table(spark, sf_dir, "lever_postings").select("ingest_id", F.col("applyUrl").alias("u")).unionByName(table(spark, sf_dir, "workable_jobs").select("ingest_id", F.col("url").alias("u")))
    return urls.select("ingest_id", po.url_host(F.col("u")).alias("host"), po.registrable_domain(F.col("u")).alias("domain"))


_TRACKING = ", ".join(f"'{x}'" for x in po.TRACKING)
_COMPOUND = ", ".join(f"'{x}'" for x in po.COMPOUND)
_SHARED = ", ".join(f"'{x}'" for x in po.SHARED_HOSTS)


@registry.query(sql=rf"""with u as (select trim(applyUrl, ' ') as u, regexp_replace(trim(applyUrl, ' '), '#.*$', '') as b, {_HOST.format(u='applyUrl')} as host from lever_postings),
p as (select *, lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme, regexp_extract(b, '^[^/]+//[^/?#]*?:([0-9]+)(?:[/?#]|$)', 1) as port,
regexp_replace(regexp_extract(b, '^[^/]+//[^/?#]*([^?#]*)', 1), '/+$', '') as path, string_split(host, '.') as l,
list_sort(list_filter(string_split(regexp_extract(b, '[?](.*)$', 1), '&'), lambda x: x <> '' and lower(regexp_extract(x, '^([^=]*)', 1)) not in ({_TRACKING}))) as q from u),
k as (select case when host is null then u else scheme || '://' || host || case when port <> '' and not (scheme = 'http' and port = '80') and not (scheme = 'https' and port = '443') then ':' || port else '' end
|| path || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end end as url_key,
coalesce(case when len(l) >= 2 then case when len(l) >= 3 and array_to_string(l[-2:], '.') in ({_COMPOUND}) then array_to_string(l[-3:], '.') else array_to_string(l[-2:], '.') end end in ({_SHARED}), false) as shared_host from p)
select url_key, shared_host, count(*) as n from k group by 1, 2""")
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison keys of application addresses, with the number of rows that share each."""
    urls = table(spark, sf_dir, "lever_postings").select(po.canonical_url(F.col("applyUrl")).alias("url_key"), po.is_shared_host(F.col("applyUrl")).alias("shared_host"))
    return urls.groupBy("url_key", "shared_host").agg(F.count(F.lit(1)).alias("n"))


_AR = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"


@registry.query(sql=f"""with c as (select doc_id, text as t from documents), n as (select doc_id, t, length(t) - length(regexp_replace(t, '{_AR}', '', 'g')) as a, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) as l from c)
select doc_id, a::bigint as n_arabic, l::bigint as n_latin, case when t is null then null when a > 0.20 * (a + l) then 'ar' else 'en' end as script_lang from n""")
def script_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arabic and Latin letters of every document, and the language they suggest."""
    arabic, latin = script.script_counts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", arabic.cast("bigint").alias("n_arabic"), latin.cast("bigint").alias("n_latin"), script.script_language(F.col("text")).alias("script_lang"))


@registry.query()
def folded_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the largest feed by comparable form, with level and number of rows."""
    t = table(spark, sf_dir, "smartrecruiters_postings").select(po.normalize_title(F.col("name")).alias("title"), po.seniority(F.col("name")).alias("level"), script.segment_scripts(script.fold_arabic(F.col("name"))).alias("seg"))
    return t.groupBy("title", "level").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("seg").alias("n_forms"))


@registry.query()
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All feeds in one posting schema, bodies as their length and digest."""
    return normalized_postings(spark, sf_dir).withColumn("n_chars", F.length("description")).withColumn("body_md5", F.md5("description")).drop("description")


@registry.query()
def payload_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of all raw answers in the one schema, bodies as their length and digest."""
    made = feeds.payload_postings(table(spark, sf_dir, "raw_payloads"))
    return made.withColumn("n_chars", F.length("description")).withColumn("body_md5", F.md5("description")).drop("description")


@registry.query(sql=" union all ".join(f"select '{n}' as source, count(*) as n_rows, count(distinct board) as boards, max(ingest_id) as last_ingest from {t}" for n, (t, _) in ADAPTERS.items()))
def source_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, boards and the last ingest of every feed."""
    parts = [table(spark, sf_dir, t).agg(F.lit(n).alias("source"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("board").alias("boards"), F.max("ingest_id").alias("last_ingest")) for n, (t, _) in ADAPTERS.items()]
    return reduce(DataFrame.unionByName, parts)


@registry.query(sql="""with t as (select ingest_id, compensation.compensationTiers as ts, unnest(range(1, len(compensation.compensationTiers) + 1)) as i from ashby_jobs),
c as (select ingest_id, i, ts[i].components as cs, unnest(range(1, len(ts[i].components) + 1)) as j from t),
k as (select ingest_id, cs[j] as c, row_number() over (partition by ingest_id order by i, j) as n from c where lower(cs[j].compensationType) = 'salary' and (cs[j].minValue is not null or cs[j].maxValue is not null))
select ingest_id, c.minValue as min_value, c.maxValue as max_value, upper(c.currencyCode) as currency from k where n = 1""")
def pay_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first salary with a bound of each ashby row that names one."""
    return pay_range(table(spark, sf_dir, "ashby_jobs"))


@registry.query()
def company_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employer names of the greenhouse feed against the source registry."""
    known = table(spark, sf_dir, "job_sources").select(F.col("source_id").alias("company_id"), F.col("company_name").alias("name"))
    return resolve_names(table(spark, sf_dir, "greenhouse_jobs").select(F.col("company_name").alias("name")), known)


@registry.query()
def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bullets, requirements, years asked for and personal data of every document."""
    d = table(spark, sf_dir, "documents").select("doc_id", ex.bullets("text").alias("b"), ex.requirements("text").alias("r"), ex.min_years("text").alias("min_years"), ex.redact("text").alias("p"))
    return d.select("doc_id", F.size("b").alias("n_bullets"), F.size("r").alias("n_requirements"), "min_years", F.coalesce(F.aggregate(F.map_values("p.counts"), F.lit(0), lambda s, x: s + x), F.lit(0)).alias("n_personal"))


@registry.query(sql="select user_id, arg_max(event_type, (ts, event_id)) as last_event, max(event_id) filter (where true) as _x from events group by 1".replace(", max(event_id) filter (where true) as _x", ""))
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user, ingested as a stream until drained."""
    return drain(spark, f"{sf_dir}/events.parquet*", ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("last_event"))


@registry.query(sql="select epoch_us(date_trunc('day', ts)) as day_us, event_type, count(*) as n from events where ts is not null group by 1, 2")
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type, counted as a watermarked stream."""
    counts = windowed_counts(spark, f"{sf_dir}/events.parquet*", "ts", "event_type")
    return counts.select(F.unix_micros("window_start").alias("day_us"), "event_type", "n")


@registry.query(sql="""with d as (select doc_id as doc, text as t from documents where text is not null), s as (select unnest(['Python', 'SQL', 'Kotlin', 'Rust', 'Terraform', 'TypeScript']) as canonical_name)
select doc, canonical_name from d, s where regexp_matches(lower(t), '(^|[^\\p{L}\\p{N}_+#.])' || lower(canonical_name) || '\\.*($|[^\\p{L}\\p{N}_+#.])')""")
def skills_mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills of a small taxonomy named in each document."""
    return skills_in(table(spark, sf_dir, "documents"), _taxonomy(spark), "doc_id", "text")


_WANTED = ", ".join(f"('{q}', '{x}', {must})" for q, xs in _REQUESTS.items() for x, must in xs)


@registry.query(sql=rf"""with w(query, skill, must) as (values {_WANTED}), n as (select *, case when must then 3.0 else 1.0 end as wt from w),
h as (select doc_id as doc, skill from (select distinct skill from w) s, documents where kind = 'cv' and regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_+#.])' || lower(skill) || '\.*($|[^\p{{L}}\p{{N}}_+#.])')),
hit as (select query, doc, sum(wt) as got, array_agg(skill) as have from h join n using (skill) group by 1, 2), t as (select query, sum(wt) as total, array_agg(skill) as want from n group by 1)
select query, doc, round(got / total, 4)::double as coverage, array_to_string(list_sort(have), ',') as matched, array_to_string(list_sort(list_filter(want, lambda x: not list_contains(have, x))), ',') as missing from hit join t using (query)""")
def skill_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far CVs cover the skills that fixed requests ask for."""
    wanted = spark.createDataFrame([(q, s, m) for q, ss in _REQUESTS.items() for s, m in ss], "query string, skill string, must boolean")
    held = skills_in(table(spark, sf_dir, "documents").filter("kind = 'cv'"), _taxonomy(spark), "doc_id", "text").withColumnRenamed("canonical_name", "skill")
    return coverage(wanted, held)


@registry.query()
def hashed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each evaluation item's closest other item of its suite by hashed embedding."""
    e = table(spark, sf_dir, "eval_items").filter("suite is not null").select(F.col("suite").alias("query"), "item_id", hash_embedding("text").alias("vec"))
    return alignment(e.withColumnRenamed("item_id", "item"), e.withColumnRenamed("item_id", "part"), others_only=True)


@registry.query()
def claims_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures, years and credentials that a posting's additional text names and its description doesn't hold."""
    t = table(spark, sf_dir, "lever_postings").select("ingest_id", unsupported_claims("additionalPlain", "descriptionPlain").alias("c"))
    return t.select("ingest_id", F.size("c").alias("n_unsupported"), F.array_join("c", ";").alias("claims"))


_PLATFORM = " ".join(f"when host = '{h}' or ends_with(host, '.{h}') then '{p}'" for h, p in sorted(vo.PLATFORM_HOSTS.items(), key=lambda x: -len(x[0])))
_PATHS = {name: " or ".join(f"starts_with(path, '{x}')" for x in begins) for name, begins in vo.PATH_REQUIRED.items()}
_BY_PATTERN = " ".join(f"when regexp_matches(host, '{pattern}') and ({_PATHS.get(name, 'true')}) then '{name}'" for pattern, name in vo.HOST_PATTERNS)


@registry.query(sql=f"""with a as (select ingest_id, applyUrl as u from lever_postings union all select ingest_id, application_url from workable_jobs union all select ingest_id, applyUrl from ashby_jobs union all select ingest_id, absolute_url from greenhouse_jobs),
u as (select ingest_id, {_HOST.format(u='u')} as host, regexp_extract(lower(u), '^[^/]+//[^/?#]*([^?#]*)', 1) as path from a) select ingest_id, case {_PLATFORM} {_BY_PATTERN} else 'unknown' end as platform from u""")
def platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The platform behind each application address of four feeds."""
    columns = {"lever_postings": "applyUrl", "workable_jobs": "application_url", "ashby_jobs": "applyUrl", "greenhouse_jobs": "absolute_url"}
    urls = reduce(DataFrame.unionByName, [table(spark, sf_dir, t).select("ingest_id", F.col(c).alias("u")) for t, c in columns.items()])
    return urls.select("ingest_id", platform_of(F.col("u"))["platform"].alias("platform"))


@registry.query()
def arabic_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, level, workplace, employment and years that Arabic documents name: those with over a fifth of their letters Arabic, whatever their label says."""
    text, t = F.col("text"), F.col("folded")
    # Texts without any such letter are passed over without counting, and the others folded once, not once a phrase.
    arabic = table(spark, sf_dir, "documents").filter(text.rlike(script.ARABIC) & (script.script_language(text) == "ar")).select("doc_id", script.fold_arabic(text).alias("folded"))
    return arabic.select("doc_id", F.array_join(vo.sections_named(t, folded=True), ",").alias("sections"), vo.label_by_phrase(t, vo.LEVELS, folded=True).alias("level"),
        vo.label_by_phrase(t, vo.WORKPLACES, folded=True).alias("workplace"), vo.label_by_phrase(t, vo.EMPLOYMENTS, folded=True).alias("employment"), vo.arabic_years(t, folded=True).alias("years"))


@registry.query()
def places_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City, region, country and remote flag of the places of the greenhouse feed."""
    p = vo.place_parts(F.col("location.name"), _country_hints(spark, sf_dir))
    return table(spark, sf_dir, "greenhouse_jobs").select("ingest_id", p["city"].alias("city"), p["region"].alias("region"), p["country"].alias("country"), p["is_remote"].alias("is_remote"))


@registry.query()
def parse_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each CV's text came out: yield, sections, layout and contact."""
    return table(spark, sf_dir, "documents").filter("kind = 'cv'").select("doc_id", ex.parse_quality(F.col("text")).alias("quality"))
