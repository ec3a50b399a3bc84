"""Skill names against a taxonomy, what a text demands against what is held, and claims against evidence."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Container, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType, StringType

from loomwork.functions.vectors import cosine
from loomwork.operators.entities import ratio

#: Length from which a name may match by similarity, and the similarity it takes.
FUZZY_LENGTH, FUZZY_RATIO = 5, 0.82
#: Taxonomy names that are sent to every task at a time.
MOST_NAMES = 200_000
DIMENSIONS = 384

# Numbers, units and credentials in claims.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "fifteen": 15, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "hundred": 100}
MAGNITUDES = {"k": 1e3, "thousand": 1e3, "million": 1e6, "billion": 1e9}
DURATIONS = "year years yr yrs month months mo week weeks day days hour hours hr hrs minute minutes min mins second seconds".split()
CREDENTIAL = re.compile(
    r"\b(?:PhD|MSc|BSc|MBA|BEng|MEng|B\.?A\.?|M\.?A\.?|AWS Certified[\w\s]*|Azure(?:\s+\w+)?\s+Certified|CKA|CKAD|CISSP|PMP|CFA|Google Cloud Certified|Professional Cloud[\w\s]*|Scrum Master|Six Sigma)\b", re.I
)
_FIGURE = re.compile(rf"(\d[\d,]*(?:\.\d+)?|\b(?:{'|'.join(NUMBER_WORDS)})\b)\s*(k\b|thousand|million|billion)?\s*(%|percent\b|x\b|times\b|[A-Za-z][\w-]*)?", re.I)


def skill_key(name: str | None) -> str:
    """Folded name: letters, digits and + # . only, words by single spaces."""
    text = unicodedata.normalize("NFKC", name or "").casefold()
    return " ".join(re.sub(r"[^\w+#.\s]", " ", text).replace("_", " ").split())


def spellings(key: str) -> list[str]:
    """Other ways to write a key: without dots, without spaces, without a final js or s."""
    base = {key, key.replace(".", ""), key.replace(" ", ""), key.replace(" ", "").replace(".", "")}
    more = {re.sub(r"(?<=\w\w)\.?js$", "", k).strip() for k in base} | {re.sub(r"(?<=\w\w\w)s$", "", k) for k in base}
    return sorted((base | more) - {""})


_key = pandas_udf(lambda col: col.map(skill_key), StringType())
_spellings = pandas_udf(lambda col: col.map(spellings), ArrayType(StringType()))


def taxonomy_names(taxonomy: DataFrame) -> DataFrame:
    """(alias, canonical_name) of every name and alias of (canonical_name, aliases); an alias of two skills goes to the first by name."""
    names = taxonomy.select("canonical_name", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("a"))
    return names.select(_key("a").alias("alias"), "canonical_name").filter("alias != ''").groupBy("alias").agg(F.min("canonical_name").alias("canonical_name"))


def resolve_skills(tokens: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(token, canonical_name, method, confidence) of distinct tokens: alias 1.0, orthographic 0.95, fuzzy by ratio, else unmapped 0. Null and blank tokens are left out."""
    names = taxonomy_names(taxonomy)
    t = tokens.select("token").distinct().select("token", _key("token").alias("alias")).filter("alias != ''")
    exact = t.join(names, "alias").select("token", "canonical_name", F.lit("alias").alias("method"), F.lit(1.0).alias("confidence"))
    rest = t.join(names.select("alias"), "alias", "left_anti")
    forms = names.select(F.explode(_spellings("alias")).alias("form"), "canonical_name")
    spelt = rest.select("token", F.explode(_spellings("alias")).alias("form")).join(forms, "form").groupBy("token").agg(F.min("canonical_name").alias("canonical_name"))
    spelt = spelt.select("token", "canonical_name", F.lit("orthographic").alias("method"), F.lit(0.95).alias("confidence"))
    rest = rest.join(spelt.select("token"), "token", "left_anti")
    blocks = max(1, -(-names.count() // MOST_NAMES))
    tried = [_most_alike(rest, names.filter(F.pmod(F.xxhash64("alias"), F.lit(blocks)) == i)) for i in range(blocks)]
    best = reduce(DataFrame.unionByName, tried).groupBy("token").agg(F.max(F.struct("score", "name")).alias("b"))
    sure = F.col("b.score") >= FUZZY_RATIO
    fuzzy = best.select("token", F.when(sure, F.col("b.name")).alias("canonical_name"), F.when(sure, "fuzzy").otherwise("unmapped").alias("method"), F.when(sure, F.round("b.score", 4)).otherwise(0.0).alias("confidence"))
    return exact.unionByName(spelt).unionByName(fuzzy)


def _most_alike(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """(token, name, score): the most alike name of a block for each (token, alias), 0.0 and no name where lengths rule all out."""
    shared = tokens.sparkSession.sparkContext.broadcast([tuple(r) for r in names.select("alias", "canonical_name").collect()])

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for token, alias in zip(b["token"], b["alias"], strict=True):
                close = [(ratio(alias, a), c) for a, c in shared.value if min(len(a), len(alias)) >= FUZZY_LENGTH and abs(len(a) - len(alias)) <= 0.25 * len(alias) + 2]
                score, name = max(close, default=(0.0, None))
                out.append((token, name, score))
            yield pd.DataFrame(out, columns=["token", "name", "score"])

    return tokens.select("token", "alias").mapInPandas(near, "token string, name string, score double")


def _words(text: str, names: Container[str]) -> list[str]:
    """Words of a text as they are looked for: without dots around them unless a name has them."""
    return [w.strip(".") if w.strip(".") in names or w not in names else w for w in skill_key(text).split()]


def _longest_first(hits: list[tuple[int, int, str]]) -> list[str]:
    """Names of (words, place, name) hits: longer ones first, then earlier ones, each place used once; sorted."""
    used: set[int] = set()
    found = set()
    for n, at, name in sorted(hits, key=lambda h: (-h[0], h[1])):
        if used.isdisjoint(span := range(at, at + n)):
            used.update(span)
            found.add(name)
    return sorted(found)


def skills_in(docs: DataFrame, taxonomy: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, canonical_name): skills whose name or alias stands in the text as whole words, longer names first, each place used once. Null texts have none.

    Up to MOST_NAMES names go to every task and no text is shuffled; of more, the runs of words of each text meet the names by a join.
    """
    names = taxonomy_names(taxonomy)
    given = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("t"))
    kind = docs.schema[doc_id].dataType.simpleString()
    if names.limit(MOST_NAMES + 1).count() > MOST_NAMES:
        return _skills_by_join(given, names, kind)
    shared = docs.sparkSession.sparkContext.broadcast({r["alias"]: r["canonical_name"] for r in names.collect()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        longest = max((len(a.split()) for a in known), default=0)
        for b in batches:
            out = []
            for key, t in zip(b["doc"], b["t"], strict=True):
                words = _words(t, known)
                runs = ((n, i, known.get(" ".join(words[i : i + n]))) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
                out += [(key, name) for name in _longest_first([h for h in runs if h[2]])]
            yield pd.DataFrame(out, columns=["doc", "canonical_name"])

    return given.mapInPandas(run, f"doc {kind}, canonical_name string")


def _skills_by_join(given: DataFrame, names: DataFrame, kind: str) -> DataFrame:
    """skills_in for any number of names. A run of words is looked for with and without the dots around its words."""
    longest = int(names.agg(F.max(F.size(F.split("alias", " ")))).first()[0])

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, t in zip(b["doc"], b["t"], strict=True):
                words = skill_key(t).split()
                for n in range(1, longest + 1):
                    for i in range(len(words) - n + 1):
                        ways = {" ".join(words[i : i + n]), " ".join(w.strip(".") for w in words[i : i + n])}
                        out += [(key, n, i, a) for a in ways]
            yield pd.DataFrame(out, columns=["doc", "n", "at", "alias"])

    hits = given.mapInPandas(runs, f"doc {kind}, n int, at int, alias string").join(names, "alias")
    grouped = hits.groupBy("doc").agg(F.collect_set(F.struct("n", "at", "canonical_name")).alias("hits"))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [_longest_first([(h["n"], h["at"], h["canonical_name"]) for h in hits]) for hits in b["hits"]]
            yield pd.DataFrame([(key, name) for key, names in zip(b["doc"], found, strict=True) for name in names], columns=["doc", "canonical_name"])

    return grouped.mapInPandas(pick, f"doc {kind}, canonical_name string")


# Words that join what must each be held, and what may replace each other.
CONJUNCTION = r"(?i)\b(?:and|as well as|plus)\b|;"
ALTERNATION = r"(?i)\b(?:or|either)\b|/"


def expand_requirements(requirements: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(query, must, skill, alternatives) of requirements (query, must, text): one row a skill that must be held, with those that may stand in for it.

    A text is split at conjunctions; the skills that a part names are one requirement if the part offers a choice, else one each. Of a choice
    the first by name is the skill. Texts that name no known skill are left out; a skill asked for twice comes once, with all its alternatives.
    """
    parts = requirements.select("query", "must", F.posexplode(F.split("text", CONJUNCTION)).alias("part", "said"), F.xxhash64("text").alias("no"))
    keyed = parts.withColumn("key", F.struct("query", "must", "no", "part")).select("key", "said").distinct().withColumn("key_text", F.to_json("key"))
    named = skills_in(keyed, taxonomy, "key_text", "said")
    found = keyed.join(named, keyed["key_text"] == named["doc"]).select("key", F.col("said").rlike(ALTERNATION).alias("choice"), "canonical_name")
    groups = found.groupBy("key", "choice").agg(F.array_sort(F.collect_set("canonical_name")).alias("names"))
    one = F.struct(F.get("names", 0).alias("skill"), F.array_remove("names", F.get("names", 0)).alias("others"))
    each = F.transform("names", lambda n: F.struct(n.alias("skill"), F.array().cast("array<string>").alias("others")))
    rows = groups.select("key.query", "key.must", F.explode(F.when(F.col("choice"), F.array(one)).otherwise(each)).alias("r"))
    return rows.groupBy("query", "must", F.col("r.skill").alias("skill")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("r.others")))).alias("alternatives"))


def coverage(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """(query, doc, coverage, matched, missing): weighted share of (query, skill, must) that (doc, skill) holds, must-haves counting three times; 1 without wants.

    Only documents holding at least one wanted skill come out.
    """
    want = wanted.groupBy("query", "skill").agg(F.max("must").alias("must")).withColumn("w", F.when(F.col("must"), 3.0).otherwise(1.0))
    total = want.groupBy("query").agg(F.sum("w").alias("total"), F.collect_set("skill").alias("all"))
    hit = held.distinct().join(want, "skill").groupBy("query", "doc").agg(F.sum("w").alias("hit"), F.collect_set("skill").alias("have"))
    both = hit.join(total, "query")
    names = lambda c: F.array_join(F.array_sort(c), ",")
    return both.select("query", "doc", F.round(F.col("hit") / F.col("total"), 4).alias("coverage"), names(F.col("have")).alias("matched"), names(F.array_except("all", "have")).alias("missing"))


def alignment(asked: DataFrame, offered: DataFrame, met: float = 0.72, partial: float = 0.55, others_only: bool = False) -> DataFrame:
    """(query, item, best, similarity, status): for each wanted (query, item, vec) the closest (query, part, vec) of the same query by cosine, at least 0, ties to the first part.

    With `others_only` both sides are the same items and none is its own part; an item that is alone in its query has no best, similarity 0.0 and is unmet.
    """
    pairs = asked.select("query", "item", F.col("vec").alias("u")).join(offered.select("query", "part", F.col("vec").alias("v")), "query")
    scored = pairs.select("query", "item", "part", F.greatest(F.lit(0.0), cosine(F.col("u"), F.col("v"))).alias("s"))
    counts = F.col("item") != F.col("part") if others_only else F.lit(True)
    best = scored.groupBy("query", "item").agg(F.coalesce(F.max(F.when(counts, F.col("s"))), F.lit(0.0)).alias("similarity"), F.min_by("part", F.when(counts, F.struct((-F.col("s")).alias("n"), "part"))).alias("best"))
    status = F.when(F.col("similarity") >= met, "met").when(F.col("similarity") >= partial, "partial").otherwise("unmet")
    return best.select("query", "item", "best", F.round("similarity", 4).alias("similarity"), status.alias("status"))


def hashed_vector(text: str | None) -> list[float]:
    """Unit vector of signed hashes: words 1.0, letter trigrams of ^word$ 0.35, word pairs 0.6; zeros for no words."""
    v = np.zeros(DIMENSIONS)
    words = re.sub(r"[^\w\s]", " ", (text or "").casefold()).split()
    parts = [(w, 1.0) for w in words] + [(f"^{w}$"[i : i + 3], 0.35) for w in words for i in range(len(w))] + [(f"{a} {b}", 0.6) for a, b in zip(words, words[1:], strict=False)]
    for feature, weight in parts:
        h = int.from_bytes(hashlib.blake2b(feature.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
        v[h % DIMENSIONS] += weight if (h >> 63) & 1 else -weight
    size = np.linalg.norm(v)
    return (v / size if size else v).tolist()


hash_embedding = pandas_udf(lambda col: col.map(hashed_vector), ArrayType(FloatType()))


def figures(text: str | None) -> set[tuple[float, str]]:
    """(value, category) of the numbers of a text: percent, multiple, duration or count; bare years are none."""
    found = set()
    for m in _FIGURE.finditer(text or ""):
        number, magnitude, unit = m[1].lower(), (m[2] or "").lower(), (m[3] or "").lower()
        if re.fullmatch(r"(?:19|20)\d\d", number) and not magnitude and unit not in ("%", "percent"):
            continue
        value = NUMBER_WORDS.get(number) or float(number.replace(",", ""))
        category = "percent" if unit in ("%", "percent") else "multiple" if unit in ("x", "times") else "duration" if unit in DURATIONS else "count"
        found.add((float(value) * MAGNITUDES.get(magnitude, 1.0), category))
    return found


def unsupported(claim: str | None, evidence: str | None) -> list[str]:
    """Figures, years and credentials of a text that its evidence doesn't hold, sorted."""
    years = lambda t: set(re.findall(r"\b(?:19|20)\d{2}\b", t or ""))
    papers = lambda t: {m.group().strip().casefold() for m in CREDENTIAL.finditer(t or "")}
    out = [f"figure:{v:g}:{c}" for v, c in figures(claim) - figures(evidence)]
    return sorted(out + [f"year:{y}" for y in years(claim) - years(evidence)] + [f"credential:{p}" for p in papers(claim) - papers(evidence)])


@pandas_udf(ArrayType(StringType()))
def unsupported_claims(claim: pd.Series, evidence: pd.Series) -> pd.Series:
    """unsupported of each pair; an empty array for a null claim."""
    return pd.Series([unsupported(c, e) for c, e in zip(claim, evidence, strict=True)])


def best_mention(mentions: DataFrame, keys: list[str], informative: list[str], order: str) -> DataFrame:
    """One mention a key: the one with most of `informative` filled in, earlier columns counting more, ties to the smallest `order`."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).isNotNull().desc() for c in informative], order)
    return mentions.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
