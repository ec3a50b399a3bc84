"""What a fetched page shows: its text, whether it names what it should, and what that says about its posting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.text import squeeze

# Phrases of closed postings, and phrases that generated copy must not hold.
CLOSURE_PHRASES = [
    "no longer accepting applications",
    "this position has been filled",
    "this job is no longer available",
    "position closed",
    "job posting has expired",
    "this posting is closed",
    "applications are closed",
    "we are no longer accepting",
    "هذه الوظيفة لم تعد متاحة",
    "تم إغلاق التقديم",
]
FORBIDDEN_PHRASES = ["chance of getting", "chance of being hired", "probability of", "likelihood of an offer", "you will get", "guaranteed", "% chance"]


def visible_text(markup: Column) -> Column:
    """Text of a page in lower case: without scripts, styles and tags, white space squeezed. Null stays null."""
    shown = F.regexp_replace(markup, r"(?is)<script\b.*?</script>|<style\b.*?</style>", " ")
    return F.lower(squeeze(F.regexp_replace(shown, r"<[^>]+>", " ")))


def names_on_page(value: Column, page: Column) -> Column:
    """Whether the page holds any of the three longest words of a value, of four characters or more, earlier words first; true for a value without such words."""
    words = F.regexp_extract_all(F.lower(value), F.lit(r"[\p{L}\p{M}\p{N}_]{4,}"), 0)
    placed = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    longest = F.slice(F.array_sort(placed), 1, 3)
    return F.coalesce((F.size(words) <= 0) | F.exists(longest, lambda x: F.contains(page, x["w"])), F.lit(True))


def phrases_in(text: Column, phrases: list[str]) -> Column:
    """The phrases that a text holds in any case, in their order; an empty array for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))


def page_state(code: Column, markup: Column, title: Column, company: Column, same_address: Column) -> Column:
    """gone, blocked, unknown, redirected or live, from a page's status code and text: closed by a phrase, or naming neither title nor company, it isn't the posting."""
    page = visible_text(markup)
    named = names_on_page(title, page) | company.isNull() | names_on_page(company, page)
    return (
        F.when(code.isin(404, 410), "gone").when(code.isin(401, 403), "blocked").when(code >= 400, "unknown")
        .when(F.size(phrases_in(page, CLOSURE_PHRASES)) > 0, "gone").when(~named, "redirected").when(same_address, "live").otherwise("redirected")
    )
