"""Spans, bullets, requirements, personal data and layout of long texts.

Line-by-line rules with memory have no built-in form, so these are Arrow-batched functions over whole columns.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Limits and markers of bullets and requirements.
BULLET = re.compile(r"^[\s]*[•▪◦●·*\-–—]\s+")
CV_HEADING = re.compile(
    r"^\s*(experience|employment|work history|education|skills|projects|certifications|summary|profile|about|languages|الخبرة|الخبرات|التعليم|المهارات|المشاريع|اللغات)\s*:?\s*$",
    re.I,
)
LEAST_BULLET = 25
MUST = re.compile(r"\b(?:must[- ]have|required|requirement|essential|minimum|at least|proven|strong (?:experience|background)|you (?:have|will need)|we require|مطلوب|يشترط)\b", re.I)
NICE = re.compile(r"\b(?:nice[- ]to[- ]have|preferred|plus|bonus|desirable|advantage|ideally|would be great|يفضل)\b", re.I)
YEARS = re.compile(r"\b(\d{1,2})\s*\+?\s*(?:-\s*\d{1,2}\s*)?(?:years?|yrs?|سنوات|سنة)\b", re.I)
KINDS = [
    ("auth", re.compile(r"\b(?:work (?:permit|authorization|authorisation)|visa|eligible to work|right to work|sponsorship|تصريح عمل)\b", re.I)),
    ("language", re.compile(r"\b(?:fluent|fluency|native|proficient|proficiency)\b.{0,30}\b(english|arabic|french|german|spanish|الإنجليزية|العربية)\b", re.I)),
    ("education", re.compile(r"\b(?:bachelor|master|phd|degree|bsc|msc|b\.s\.|m\.s\.|university|بكالوريوس|ماجستير)\b", re.I)),
    ("experience", YEARS),
]
JOB_HEADING = re.compile(
    r"^\s*(requirements?|qualifications?|what you.{0,12}(?:bring|need|have)|who you are|about you|skills?|must have|nice to have|responsibilities|المؤهلات|المتطلبات)\s*:?\s*$",
    re.I,
)
REQUIREMENT_CHARS = (15, 400)
# Forms of personal data, in the order in which they are replaced.
PERSONAL = [
    ("EMAIL", re.compile(r"[\w.+-]+@[\w-]+\.[\w.]{2,}")),
    ("PROFILE_URL", re.compile(r"\b(?:https?://)?(?:www\.)?(?:linkedin\.com|github\.com|gitlab\.com|x\.com|twitter\.com)/[\w\-./]+", re.I)),
    (
        "ADDRESS",
        re.compile(
            r"\b\d{1,5}\s+(?:[A-Z][\w'.-]*\s+){0,4}(?:street|st\.?|road|rd\.?|avenue|ave\.?|boulevard|blvd\.?|lane|ln\.?|drive|dr\.?|court|ct\.?|square|sq\.?|شارع|طريق|ميدان)\b[^\n,]{0,30}",
            re.I,
        ),
    ),
    ("NATIONAL_ID", re.compile(r"\b\d{14}\b")),
    ("PHONE", re.compile(r"(?<![\w.])(?:\+\d{1,3}[\s.\-]?)?(?:\(\d{1,4}\)[\s.\-]?)?\d[\d\s.()\-]{5,16}\d(?![\w.])")),
]
PHONE_DIGITS, BARE_PHONE_DIGITS = 7, 9

_TEXT, _INT = T.StringType(), T.IntegerType()
SPANS = T.ArrayType(T.StructType().add("text", _TEXT).add("start", _INT).add("end", _INT).add("section", _TEXT))
REQUIREMENTS = T.ArrayType(T.StructType().add("text", _TEXT).add("kind", _TEXT).add("must_have", T.BooleanType()).add("start", _INT).add("end", _INT))


def _lines(text: str) -> list[tuple[int, str]]:
    """(offset, line) of every line."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, line))
        at += len(line) + 1
    return out


def bullets_of(text: str | None) -> list[tuple[str, int, int, str | None]]:
    """(text, start, end, section): marked lines with their unmarked continuations, offsets into the text."""
    found: list[tuple[str, int, int, str | None]] = []
    section, begin, end = None, None, 0

    def close() -> None:
        nonlocal begin
        if begin is not None:
            body = (text or "")[begin:end].strip()
            if len(body) >= LEAST_BULLET:
                found.append((body, begin, end, section))
        begin = None

    for at, line in _lines(text or ""):
        mark = BULLET.match(line)
        if CV_HEADING.match(line):
            close()
            section = line.strip().rstrip(":").strip().lower()
        elif mark:
            close()
            begin, end = at + mark.end(), at + len(line.rstrip())
        elif begin is not None and line.strip() and not re.search(r"[.!?؟]\s*$", (text or "")[begin:end]):
            end = at + len(line.rstrip())  # the sentence goes on
        else:
            close()
    close()
    return found


@pandas_udf(SPANS)
def bullets(col: pd.Series) -> pd.Series:
    """bullets_of each text; an empty array for null."""
    return col.map(lambda t: [dict(zip(("text", "start", "end", "section"), b, strict=True)) for b in bullets_of(t)])


def requirement_kind(text: str) -> str:
    """auth, language, education or experience by the first that fits, else skill."""
    return next((name for name, pattern in KINDS if pattern.search(text)), "skill")


def requirements_of(text: str | None) -> list[tuple[str, str, bool, int, int]]:
    """(text, kind, must have, start, end): lines under requirement headings or that say so themselves."""
    found: list[tuple[str, str, bool, int, int]] = []
    must: bool | None = None  # what the last heading says; None outside requirements
    for at, line in _lines(text or ""):
        bare = BULLET.sub("", line).strip()
        if heading := JOB_HEADING.match(line):
            name = heading[1].lower()
            must = False if name == "nice to have" else None if name.startswith("responsib") else True
            continue
        if not REQUIREMENT_CHARS[0] <= len(bare) <= REQUIREMENT_CHARS[1]:
            continue
        says_must, says_nice = bool(MUST.search(bare)), bool(NICE.search(bare))
        if must is None and not (says_must or says_nice):
            continue
        start = at + line.index(bare)
        found.append((bare, requirement_kind(bare), says_must or (bool(must) and not says_nice), start, start + len(bare)))
    return found


@pandas_udf(REQUIREMENTS)
def requirements(col: pd.Series) -> pd.Series:
    """requirements_of each text; an empty array for null."""
    return col.map(lambda t: [dict(zip(("text", "kind", "must_have", "start", "end"), r, strict=True)) for r in requirements_of(t)])


def years_stated(text: str | None) -> float | None:
    """The smallest number of years asked for, from 1 to 25; None if none is."""
    years = [int(y) for y in YEARS.findall(text or "") if 0 < int(y) <= 25]
    return float(min(years)) if years else None


@pandas_udf(T.DoubleType())
def min_years(col: pd.Series) -> pd.Series:
    """years_stated of each text."""
    return col.map(years_stated).astype("float64")


# Wordings of sponsorship, a line that is a name, headings that are none, and what must not be left after redaction.
SPONSORSHIP_OFFERED = r"(?i)\b(?:visa sponsorship (?:is )?(?:available|provided|offered)|we sponsor|sponsorship (?:is )?available|relocation (?:package|support) (?:is )?(?:available|provided))\b"
SPONSORSHIP_REFUSED = r"(?i)\b(?:no (?:visa )?sponsorship|unable to sponsor|cannot sponsor|sponsorship is not (?:available|provided)|must be authoriz?sed to work)\b"
NAME_LINE = re.compile(r"^[^\W\d_][\w'؀-ۿ.-]*(?:\s+[^\W\d_][\w'؀-ۿ.-]*){1,3}$")
NO_NAMES = ["curriculum vitae", "cv", "resume", "résumé"]
RESIDUAL = ["EMAIL", "PHONE", "NATIONAL_ID"]


def sponsorship(text: Column) -> Column:
    """Whether sponsorship is offered: false where it is refused, true where it is offered, null where neither is said."""
    return F.when(text.rlike(SPONSORSHIP_REFUSED), False).when(text.rlike(SPONSORSHIP_OFFERED), True)


def header_name(text: str | None) -> str | None:
    """The first of the first six lines that looks like a name of two to four words, by itself on its line; None if none does."""
    for line in (text or "").splitlines()[:6]:
        bare = line.strip().strip("|·—-").strip()
        if 0 < len(bare) <= 60 and bare.lower() not in NO_NAMES and NAME_LINE.match(bare) and not any(c.isdigit() for c in bare):
            return bare
    return None


def redacted_with_names(text: str | None, name: str | None = None) -> tuple[str, dict[str, str]]:
    """redacted, and the name (as known, else of the header) as [[NAME_1]]; with the value of each placeholder."""
    out, values = text or "", {}
    for label, pattern in PERSONAL:
        out = _placeholders(out, label, pattern, values)
    person = (name or header_name(text) or "").strip()
    if person and (whole := re.compile(rf"\b{re.escape(person)}\b", re.I)).search(out):
        out, values["[[NAME_1]]"] = whole.sub("[[NAME_1]]", out), person
    return out, values


def restored(text: str, values: dict[str, str]) -> str:
    """A redacted text with the values of its placeholders put back."""
    return re.sub(r"\[\[[A-Z_]+_\d+\]\]", lambda m: values.get(m.group(), m.group()), text)


@pandas_udf(T.StructType().add("text", _TEXT).add("values", T.MapType(_TEXT, _TEXT)).add("left", T.ArrayType(_TEXT)))
def redact_names(text: pd.Series, name: pd.Series) -> pd.DataFrame:
    """redacted_with_names of each pair, and the kinds of personal data that still match; the empty text for null."""
    rows = []
    for t, n in zip(text, name, strict=True):
        out, values = redacted_with_names(t, n)
        rows.append((out, values, [label for label, pattern in PERSONAL if label in RESIDUAL and any(_is_personal(label, m.group()) for m in pattern.finditer(out))]))
    return pd.DataFrame(rows, columns=["text", "values", "left"])


def _is_personal(label: str, value: str) -> bool:
    """Whether what a pattern found counts: a phone has enough digits, more if nothing separates them."""
    return label != "PHONE" or sum(c.isdigit() for c in value) >= (BARE_PHONE_DIGITS if value.isdigit() else PHONE_DIGITS)


def _placeholders(text: str, label: str, pattern: re.Pattern[str], values: dict[str, str]) -> str:
    """The text with a pattern's values as placeholders, numbered by distinct value, which are noted in `values`."""
    seen: dict[str, str] = {}

    def place(m: re.Match) -> str:
        value = m.group()
        if not _is_personal(label, value):
            return value
        if value not in seen:
            seen[value] = f"[[{label}_{len(seen) + 1}]]"
            values[seen[value]] = value
        return seen[value]

    return pattern.sub(place, text)


def redacted(text: str | None) -> tuple[str, dict[str, int]]:
    """The text with personal data as numbered placeholders, one number a distinct value and kind, and the distinct values of each kind."""
    out, counts = text or "", {}
    for label, pattern in PERSONAL:
        values: dict[str, str] = {}
        out = _placeholders(out, label, pattern, values)
        if values:
            counts[label] = len(values)
    return out, counts


@pandas_udf(T.StructType().add("text", _TEXT).add("counts", T.MapType(_TEXT, _INT)))
def redact(col: pd.Series) -> pd.DataFrame:
    """redacted of each text; the empty text and no counts for null."""
    return pd.DataFrame([redacted(t) for t in col], columns=["text", "counts"])


def span_of(text: str | None, quote: str | None) -> tuple[int, int, str] | None:
    """(start, end, how) of a quote in a text: exact, or relocated where only case and white space differ; None if it isn't there."""
    if not text or not quote or not quote.strip():
        return None
    at = text.find(quote)
    if at >= 0:
        return at, at + len(quote), "exact"
    loose = re.compile(r"\s+".join(map(re.escape, quote.split())), re.I)
    m = loose.search(text)
    return (m.start(), m.end(), "relocated") if m else None


@pandas_udf(T.StructType().add("start", _INT).add("end", _INT).add("how", _TEXT))
def find_span(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    """span_of each pair; all fields null where the quote isn't there."""
    found = [span_of(t, q) or (None, None, None) for t, q in zip(text, quote, strict=True)]
    return pd.DataFrame(found, columns=["start", "end", "how"]).astype({"start": "Int32", "end": "Int32"})


def parse_quality(text: Column, pages: Column | None = None) -> Column:
    """Quality of an extracted CV from 0 to 1, rounded to 2: 0.40 yield of characters a page, 0.30 share of experience, education and skills
    sections, 0.20 lines without column gaps, 0.10 a mail address or phone. Null and blank texts have 0."""
    body = F.coalesce(text, F.lit(""))
    size = F.coalesce(pages, F.greatest(F.lit(1), F.ceil(F.length(body) / 3000))) if pages is not None else F.greatest(F.lit(1), F.ceil(F.length(body) / 3000))
    per_page = F.length(F.trim(body)) / size
    gain = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (per_page - 400) / (1500 - 400)))
    wanted = [r"(?i)\b(?:work\s+)?experience\b|\bemployment\b|\bcareer\s+history\b", r"(?i)\beducation\b|\bacademic\b|\bqualifications\b", r"(?i)\bskills\b|\bcompetenc"]
    sections = sum((body.rlike(p).cast("double") for p in wanted[1:]), body.rlike(wanted[0]).cast("double")) / len(wanted)
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
    damaged = F.filter(lines, lambda x: x.rlike(r"\S {3,}\S") | x.rlike("\t[^\t]*\t"))
    whole = 1 - F.when(F.size(lines) > 0, F.size(damaged) / F.size(lines)).otherwise(0.0)
    contact = body.rlike(r"[\w.+-]+@[\w-]+\.[\w.]+|\+?\d[\d\s()-]{7,}\d").cast("double")
    return F.when(F.trim(body) == "", 0.0).otherwise(F.bround(0.40 * gain + 0.30 * sections + 0.20 * whole + 0.10 * contact, 2))
