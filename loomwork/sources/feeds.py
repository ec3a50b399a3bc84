"""Job-board feeds to one posting schema, raw answers to rows, and file sources and sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.postings import employment, html_to_text, normalize_title, seniority, workplace
from loomwork.functions.script import script_language
from loomwork.operators.nested_json import job_rows
from loomwork.session import table

#: Columns of a normalized posting.
POSTING = ["source", "external_id", "ingest_id", "title", "title_normalized", "description", "location", "remote_type", "employment_type", "seniority", "language", "url", "apply_url", "written_at"]

#: Columns that an adapter gives as the feed has them.
GIVEN = ["external_id", "title", "location", "remote_type", "employment_type", "url", "apply_url", "written_at"]


def _posting(df: DataFrame, source: str, body: Column, **cols: Column) -> DataFrame:
    null = F.lit(None).cast("string")
    # The feed's own columns are read first, as names of theirs may be those of POSTING.
    known = df.select("ingest_id", *[cols.get(k, null).cast("string").alias(f"__{k}") for k in GIVEN], body.alias("__body"))
    col = {k: F.col(f"__{k}") for k in (*GIVEN, "body")}
    return known.select(
        F.lit(source).alias("source"), col["external_id"], "ingest_id", col["title"], normalize_title(col["title"]).alias("title_normalized"), col["body"].alias("description"), col["location"],
        F.coalesce(col["remote_type"], workplace(col["title"], col["location"])).alias("remote_type"), employment(col["employment_type"]).alias("employment_type"),
        seniority(col["title"], col["body"]).alias("seniority"), script_language(F.concat_ws(" ", col["title"], col["body"])).alias("language"), col["url"], col["apply_url"], col["written_at"],
    ).toDF(*POSTING)


def greenhouse(df: DataFrame) -> DataFrame:
    """Entity-encoded HTML body; the location's name, else the first office; first publication, else the update."""
    place = F.coalesce(F.col("location.name"), F.get("offices", 0)["name"])
    return _posting(df, "greenhouse", html_to_text("content"), external_id=F.col("id"), title=F.col("title"), location=place, url=F.col("absolute_url"), apply_url=F.col("absolute_url"), written_at=F.coalesce("first_published", "updated_at"))


def lever(df: DataFrame) -> DataFrame:
    """Plain body, the lists under their headings, and the additional text."""
    lists = F.array_join(F.transform("lists", lambda x: F.concat_ws("\n", x["text"], x["content"])), "\n")
    body = F.concat_ws("\n\n", "descriptionPlain", F.when(F.size("lists") > 0, html_to_text(lists)), "additionalPlain")
    return _posting(df, "lever", body, external_id=F.col("id"), title=F.col("text"), location=F.col("categories.location"), remote_type=workplace(F.col("workplaceType")),
        employment_type=F.col("categories.commitment"), url=F.col("hostedUrl"), apply_url=F.col("applyUrl"), written_at=F.col("createdAt"))


def ashby(df: DataFrame) -> DataFrame:
    """Plain body; a remote flag of its own."""
    return _posting(df, "ashby", F.coalesce("descriptionPlain", F.lit("")), external_id=F.col("id"), title=F.col("title"), location=F.col("location"),
        remote_type=F.when(F.col("isRemote"), "remote"), employment_type=F.col("employmentType"), url=F.col("jobUrl"), apply_url=F.col("applyUrl"), written_at=F.col("publishedAt"))


def workable(df: DataFrame) -> DataFrame:
    """HTML body; city and country as the place; telecommuting is remote."""
    place = F.nullif(F.concat_ws(", ", "city", "country"), F.lit(""))
    return _posting(df, "workable", html_to_text("description"), external_id=F.col("shortcode"), title=F.col("title"), location=place,
        remote_type=F.when(F.col("telecommuting"), "remote"), employment_type=F.col("employment_type"), url=F.col("url"), apply_url=F.col("application_url"), written_at=F.col("published_on"))


def smartrecruiters(df: DataFrame) -> DataFrame:
    """A listing without body; structured location and type of employment."""
    return _posting(df, "smartrecruiters", F.lit(""), external_id=F.col("id"), title=F.col("name"), location=F.col("location.fullLocation"),
        remote_type=F.when(F.col("location.remote"), "remote"), employment_type=F.col("typeOfEmployment.label"), written_at=F.col("releasedDate"))


def recruitee(df: DataFrame) -> DataFrame:
    """Description and requirements as one HTML body; city and country code as the place unless one is given."""
    place = F.coalesce(F.nullif(F.trim("location"), F.lit("")), F.nullif(F.concat_ws(", ", "city", "country_code"), F.lit("")))
    return _posting(df, "recruitee", html_to_text(F.concat_ws("\n", "description", "requirements")), external_id=F.col("id"), title=F.col("title"), location=place,
        remote_type=F.when(F.col("remote"), "remote"), employment_type=F.col("employment_type_code"), url=F.col("careers_url"),
        apply_url=F.coalesce("careers_apply_url", "careers_url"), written_at=F.coalesce("published_at", "created_at"))


def with_details(postings: DataFrame, details: DataFrame) -> DataFrame:
    """Postings with empty bodies filled from (external_id, sections array<struct<title, text>>) fetched later; a body that is there is never blanked."""
    body = F.array_join(F.transform(F.filter("sections", lambda s: F.trim(F.coalesce(s["text"], F.lit(""))) != ""), lambda s: F.concat_ws("\n", s["title"], s["text"])), "\n\n")
    late = details.select("external_id", body.alias("__late")).dropDuplicates(["external_id"])
    joined = postings.join(late, "external_id", "left")
    filled = F.when(F.trim(F.coalesce("description", F.lit(""))) == "", F.coalesce(F.nullif("__late", F.lit("")), "description")).otherwise(F.col("description"))
    return joined.withColumn("description", filled).select(*postings.columns)


#: Adapters by feed, with the table each reads.
ADAPTERS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "greenhouse": ("greenhouse_jobs", greenhouse), "lever": ("lever_postings", lever), "ashby": ("ashby_jobs", ashby),
    "workable": ("workable_jobs", workable), "smartrecruiters": ("smartrecruiters_postings", smartrecruiters),
}


#: Adapters by the name that raw answers carry.
JOB_ADAPTERS = {name: adapter for name, (_, adapter) in ADAPTERS.items()} | {"recruitee": recruitee}


def normalized_postings(spark: SparkSession, sf_dir: str, feeds: list[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The postings of some or all feeds in one schema, with columns that the feeds' tables share and `keep` names. An unknown feed raises."""
    names = feeds or list(ADAPTERS)
    if unknown := set(names) - ADAPTERS.keys():
        raise ValueError(f"unknown feeds: {sorted(unknown)}")

    def made(name: str) -> DataFrame:
        source, adapter = ADAPTERS[name]
        rows = table(spark, sf_dir, source)
        if not keep:
            return adapter(rows)
        carried = adapter(rows.withColumn("ingest_id", F.struct("ingest_id", *keep)))  # what identifies a row passes an adapter as it is
        return carried.withColumns({c: F.col("ingest_id")[c] for c in keep} | {"ingest_id": F.col("ingest_id.ingest_id")})

    return reduce(DataFrame.unionByName, [made(n) for n in names])


# The members of a job that the adapters read, as feeds write them.
JOB_SCHEMAS = {
    "greenhouse": "id string, title string, absolute_url string, content string, location struct<name string>, offices array<struct<name string>>, first_published string, updated_at string",
    "lever": "id string, text string, descriptionPlain string, lists array<struct<text string, content string>>, additionalPlain string, categories struct<location string, commitment string>, workplaceType string, createdAt string, hostedUrl string, applyUrl string",
    "ashby": "id string, title string, location string, isRemote boolean, employmentType string, publishedAt string, jobUrl string, applyUrl string, descriptionPlain string",
    "workable": "shortcode string, title string, url string, application_url string, employment_type string, telecommuting boolean, published_on string, description string, city string, country string",
    "smartrecruiters": "id string, name string, location struct<fullLocation string, remote boolean>, typeOfEmployment struct<label string>, releasedDate string",
    "recruitee": "id string, title string, description string, requirements string, location string, city string, country_code string, remote boolean, employment_type_code string, careers_url string, careers_apply_url string, published_at string, created_at string",
}


def payload_postings(payloads: DataFrame) -> DataFrame:
    """The postings of raw answers (payload_id, adapter, payload) in the one schema, with payload_id as ingest_id and their place `pos` in the answer.

    Stored answers can be replayed by this at any time. Members that are absent or of another type are null; adapters that are unknown give no rows.
    """
    jobs = job_rows(payloads)

    def made(name: str, adapter: Callable[[DataFrame], DataFrame]) -> DataFrame:
        read = jobs.filter(F.col("adapter") == name).select(F.struct("payload_id", "pos").alias("ingest_id"), F.from_json("job", JOB_SCHEMAS[name], {"allowNumericLeadingZeros": "false"}).alias("j"))
        rows = adapter(read.select("ingest_id", "j.*"))
        return rows.withColumns({"pos": F.col("ingest_id.pos"), "ingest_id": F.col("ingest_id.payload_id")})

    return reduce(DataFrame.unionByName, [made(name, adapter) for name, adapter in JOB_ADAPTERS.items()])


def posting_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, ingest_id, place): every distinct place that a row of any feed names, main and further ones. Blank places are left out; a row may have none.

    Greenhouse names a location and offices, ashby further locations, workable a list of places (hidden ones aside), else city
    and country; a place in parts is put together with commas.
    """

    def parts(*cols: Column) -> Column:
        return F.concat_ws(", ", *[F.nullif(F.trim(c), F.lit("")) for c in cols])

    no_places = F.array().cast("array<string>")
    listed = F.transform(F.filter("locations", lambda x: ~F.coalesce(x["hidden"], F.lit(False))), lambda x: parts(x["city"], x["region"], x["country"]))
    named = {
        "greenhouse": F.concat(F.array("location.name"), F.coalesce(F.col("offices.name"), no_places)),
        "lever": F.array("categories.location"),
        "ashby": F.concat(F.array("location"), F.coalesce(F.col("secondaryLocations.location"), no_places)),
        "workable": F.when(F.size(F.filter(F.coalesce(listed, no_places), lambda x: x != "")) > 0, listed).otherwise(F.array(parts(F.col("city"), F.col("country")))),
        "smartrecruiters": F.array(F.coalesce(F.nullif(F.trim("location.fullLocation"), F.lit("")), parts(F.col("location.city"), F.col("location.country")))),
    }
    rows = [table(spark, sf_dir, ADAPTERS[n][0]).select(F.lit(n).alias("source"), "ingest_id", F.explode(F.array_distinct(F.transform(c, lambda x: F.trim(x)))).alias("place")) for n, c in named.items()]
    return reduce(DataFrame.unionByName, rows).filter("place <> ''")


def pay_range(df: DataFrame) -> DataFrame:
    """(ingest_id, min_value, max_value, currency): the first salary component with a bound of an ashby row; rows without one are left out."""
    parts = F.flatten(F.transform("compensation.compensationTiers", lambda t: F.coalesce(t["components"], F.array().cast("array<struct<compensationType:string,minValue:double,maxValue:double,currencyCode:string>>"))))
    pay = F.filter(parts, lambda c: (F.lower(c["compensationType"]) == "salary") & (c["minValue"].isNotNull() | c["maxValue"].isNotNull()))
    return df.select("ingest_id", F.get(pay, 0).alias("p")).filter("p is not null").select("ingest_id", F.col("p.minValue").alias("min_value"), F.col("p.maxValue").alias("max_value"), F.upper("p.currencyCode").alias("currency"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (path, payload) rows, for answers stored one a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("payload"))


def append_payloads(payloads: DataFrame, path: str) -> None:
    """Append raw payloads as they came, in folders by month of fetch, so that old months can be dropped whole."""
    payloads.withColumn("fetch_month", F.date_format("fetched_at", "yyyy-MM")).write.mode("append").partitionBy("fetch_month").parquet(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """Labels as CSV with a header."""
    labels.write.mode("overwrite").option("header", True).csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(query, doc, grade) from CSV; rows with a blank grade are left out, a grade outside 0-3 raises."""
    raw = spark.read.option("header", True).csv(path).filter(F.trim(F.coalesce("grade", F.lit(""))) != "")
    grade = F.col("grade").try_cast("int")
    checked = F.when(grade.between(0, 3), grade).otherwise(F.raise_error(F.concat(F.lit("bad grade: "), F.col("grade"))))
    return raw.select("query", "doc", checked.cast("int").alias("grade"))
