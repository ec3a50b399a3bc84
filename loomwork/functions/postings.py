"""Titles, kinds of work, web addresses and markup of postings."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from loomwork.functions.arabic import EMPLOYMENTS, LEVELS, WORKPLACES, label_by_phrase
from loomwork.functions.script import ARABIC, fold_arabic
from loomwork.functions.text import squeeze

# Patterns of words that are no part of a title.
TITLE_NOISE = [
    r"(?i)\((?:[fmdwx]\s*/\s*)+[fmdwx]\)",
    r"(?i)\b(?:[fmdwx]\s*/\s*){1,2}[fmdwx]\b",
    r"(?i)\b(?:job\s*)?(?:req(?:uisition)?|jr|id)[-#\s:]*\d{3,}\b",
    r"#\s*\d{3,}",
    r"(?i)\b(?:full[-\s]?time|part[-\s]?time|permanent|contract|temporary)\b",
    r"(?i)\b(?:remote|hybrid|on[-\s]?site|onsite|wfh)\b",
    r"(?i)[\[\(][^\[\]\(\)]{0,40}(?:remote|hybrid|onsite|contract|intern(?:ship)?)[^\[\]\(\)]{0,40}[\]\)]",
]
# Levels in the order in which they are looked for.
SENIORITY = [
    (r"(?i)\b(?:intern(?:ship)?|trainee|placement|co[-\s]?op|working student)\b", "intern"),
    (r"(?i)\b(?:principal|distinguished|fellow|head of|vp|director)\b", "principal"),
    (r"(?i)\b(?:staff|lead|team lead|tech lead|architect)\b", "staff"),
    (r"(?i)\b(?:senior|sr\.?|snr|iii|3)\b", "senior"),
    (r"(?i)\b(?:junior|jr\.?|entry[-\s]?level|graduate|grad|associate|i{1,2}\b|1)\b", "junior"),
    (r"(?i)\b(?:mid[-\s]?level|intermediate|ii)\b", "mid"),
]
# Kinds of workplace and of employment in the order in which they are looked for.
WORKPLACE = [
    (r"(?i)\bhybrid\b", "hybrid"),
    (r"(?i)\b(?:fully[-\s]?remote|remote[-\s]?first|100%\s*remote|remote)\b", "remote"),
    (r"(?i)\b(?:on[-\s]?site|onsite|in[-\s]?office)\b", "onsite"),
]
EMPLOYMENT = [
    (r"(?i)intern", "internship"),
    (r"(?i)part[-\s_]?time", "part_time"),
    (r"(?i)contract|freelance|b2b", "contract"),
    (r"(?i)tempor", "temporary"),
    (r"(?i)full[-\s_]?time|permanent|regular", "full_time"),
]
# Parameters that only track, and the part of them that a link can always lose.
ANALYTICS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid"]
TRACKING = [*ANALYTICS, "gh_src", "ref", "referer", "referrer", "source", "src"]
# Public suffixes of two labels, and hosts that many employers share.
COMPOUND = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "com.br", "com.eg", "com.sa", "com.tr", "co.jp", "co.in", "co.za", "com.mx", "com.sg"]
SHARED_HOSTS = [
    "greenhouse.io", "lever.co", "ashbyhq.com", "workable.com", "smartrecruiters.com", "recruitee.com", "myworkdayjobs.com", "myworkdaysite.com",
    "icims.com", "taleo.net", "breezy.hr", "jobvite.com", "teamtailor.com", "bamboohr.com", "personio.de", "personio.com", "successfactors.com",
    "oraclecloud.com", "applytojob.com", "jazz.co", "jobs.eu", "join.com", "hire.lever.co",
]


def _first_match(col: Column, rules: list[tuple[str, str]]) -> Column:
    found = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        found = F.when(col.rlike(pattern), name).otherwise(found)
    return found


@pandas_udf(StringType())
def nfkc(col: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for."""
    return col.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normalize_title(col: Column) -> Column:
    """Comparable form of a title: folded, without noise and punctuation but + and #. Null gives the empty string."""
    text = F.lower(fold_arabic(F.coalesce(col, F.lit(""))))
    for pattern in TITLE_NOISE:
        text = F.regexp_replace(text, pattern, " ")
    return squeeze(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}\s+#]", " "))


def title_head(normalized: Column, n: int) -> Column:
    """The first n words of a normalized title, as one string."""
    return F.array_join(F.slice(F.split(normalized, " "), 1, n), " ")


def _arabic(col: Column, vocabulary: dict[str, list[str]]) -> Column:
    """The label of an Arabic phrase, looked for only in texts with such letters."""
    return F.when(col.rlike(ARABIC), label_by_phrase(col, vocabulary))


def seniority(title: Column, description: Column | None = None, head_chars: int | None = 600) -> Column:
    """The level a title names, else one named in the first `head_chars` characters of the description, or in all of it; in English, else in Arabic. Null if none is."""
    found = F.coalesce(_first_match(title, SENIORITY), _arabic(title, LEVELS))
    if description is None:
        return found
    head = description if head_chars is None else F.substring(description, 1, head_chars)
    return F.coalesce(found, _first_match(head, SENIORITY), _arabic(head, LEVELS))


def workplace(*cols: Column) -> Column:
    """hybrid, remote or onsite, hybrid first, from several fields, else by an Arabic phrase; null if none is named."""
    together = F.concat_ws(" ", *cols)
    return F.coalesce(_first_match(together, WORKPLACE), _arabic(together, WORKPLACES))


def employment(col: Column) -> Column:
    """The kind of employment a value names, in English or else in Arabic; `other` if it names none, null for null and empty."""
    return F.when(F.coalesce(F.length(col), F.lit(0)) > 0, F.coalesce(_first_match(col, EMPLOYMENT), _arabic(col, EMPLOYMENTS), F.lit("other")))


def url_host(url: Column) -> Column:
    """The host in lower case, without www. and port; null for what is no absolute address."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", ""), F.lit(""))


def registrable_domain(url: Column) -> Column:
    """The last two labels of the host, three under a compound suffix; null without a dot."""
    labels = F.split(url_host(url), r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    return F.when(F.size(labels) >= 2, F.when((F.size(labels) >= 3) & last(2).isin(COMPOUND), last(3)).otherwise(last(2)))


def is_shared_host(url: Column) -> Column:
    """Whether the address stands on a host shared by many employers; false for null."""
    return F.coalesce(registrable_domain(url).isin(SHARED_HOSTS), F.lit(False))


def canonical_url(url: Column) -> Column:
    """Comparison key of an address: scheme and host folded, default port, fragment and tracking dropped, parameters sorted, no slash at the end."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    port = F.regexp_extract(bare, r"^[^/]+//[^/?#]*?:(\d+)(?:[/?#]|$)", 1)
    keep_port = (port != "") & ~((scheme == "http") & (port == "80")) & ~((scheme == "https") & (port == "443"))
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/]+//[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(TRACKING))
    joined = F.array_join(F.array_sort(query), "&")
    return F.when(url_host(url).isNull(), F.trim(url)).otherwise(
        F.concat(scheme, F.lit("://"), url_host(url), F.when(keep_port, F.concat(F.lit(":"), port)).otherwise(""), path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))
    )


def without_parameters(url: Column, dropped: list[str]) -> Column:
    """An address without the query parameters named, all else as written; with ANALYTICS, for a link that a person opens."""
    bare = F.trim(url)
    kept = F.filter(F.split(F.regexp_extract(bare, r"\?([^#]*)", 1), "&"), lambda p: ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(dropped))
    query = F.array_join(kept, "&")
    without = F.concat(F.regexp_extract(bare, r"^([^?#]*)", 1), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.regexp_extract(bare, "(#.*)$", 1))
    return F.when(F.contains(bare, F.lit("?")), without).otherwise(bare)


def company_domain(*candidates: Column) -> Column:
    """The first candidate's registrable domain that isn't a host shared by many employers; null if none is."""
    return F.coalesce(*[F.when(~is_shared_host(c), registrable_domain(c)) for c in candidates])


_BLOCK_BREAK = re.compile(r"<br\s*/?>|</(?:p|div|li|tr|h[1-6]|section|article|ul|ol|table)\s*>", re.IGNORECASE)
_HIDDEN = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)", re.IGNORECASE | re.DOTALL)
_ITEM = re.compile(r"<li\b[^>]*>", re.IGNORECASE)
_ANY_TAG = re.compile(r"<[^>]+>")


def plain_text(markup: str | None) -> str:
    """Readable text of HTML, also of entity-encoded HTML: blocks on lines of their own, items marked, space collapsed."""
    if not markup:
        return ""
    for _ in range(2):
        if "<" in markup or "&lt;" not in markup:
            break
        markup = html.unescape(markup)
    for pattern, to in ((_HIDDEN, " "), (_ITEM, "• "), (_BLOCK_BREAK, "\n"), (_ANY_TAG, "")):
        markup = pattern.sub(to, markup)
    lines = (re.sub(r"[^\S\n]+", " ", line).strip() for line in html.unescape(markup).replace("\xa0", " ").split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


@pandas_udf(StringType())
def html_to_text(col: pd.Series) -> pd.Series:
    """plain_text of a column, in Arrow batches; null gives the empty string."""
    return col.map(plain_text)
