"""Free-entered values to the closest entry of a reference list.

Values and entries are folded to the same compact form; a BK-tree over the entries under the unrestricted
Damerau-Levenshtein distance, a true metric, returns every entry within the threshold, pruned by the triangle
inequality. A short list goes to every task as one tree; of a longer one each task searches a shard, and the
shards' winners merge.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import blank_to_null
from loomwork.llm.words import hash64
from loomwork.session import materialize

#: Entries up to which the list is sent to every task; a longer one is split into shards of about so many.
SHARD_ENTRIES = 5_000
#: Distinct values (about) that meet a shard in one task.
SHARD_VALUES = 50_000
#: Distinct values remembered by a worker.
REMEMBERED = 200_000

#: Letters that Unicode doesn't decompose.
_LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"})
#: What stands around a typed place.
PLACE_EXTRAS = re.compile(r"\b(?:remote|hybrid|on-?site|hq|office)\b|\b\d+ days? a week\b|^\s*greater\b|\barea\s*$")
#: What stands around a typed kind of employment.
EMPLOYMENT_EXTRAS = re.compile(r"\(\d+ ?h\)|,\s*on site\s*$|/\s*m-f\s*$|\bposition\s*$")
_PARTS = re.compile(r"[,;/|()\[\]]|\s-\s")


def compact(text: str) -> str:
    """Folded letters and digits of a text: no case, marks, spaces or punctuation."""
    plain = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold().translate(_LETTERS))
    return "".join(c for c in plain if c.isalnum())


def distance(a: str, b: str, at_most: int | None = None) -> int:
    """Unrestricted Damerau-Levenshtein distance: insert, delete, replace, and swap neighbours, edits between swapped letters allowed."""
    if a == b:
        return 0
    big = len(a) + len(b)
    last: dict[str, int] = {}
    prior = [[big] * (len(b) + 2), [big, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, match = [big, i], 0
        above = prior[i]
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            if x == y:
                cost, match = 0, j
            else:
                cost = 1
            row.append(min(above[j] + cost, row[j] + 1, above[j + 1] + 1, prior[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        prior.append(row)
        last[x] = i
    return prior[-1][-1]


@dataclass
class Node:
    key: str
    below: dict[int, Node] = field(default_factory=dict)


class BKTree:
    """Distinct keys under the edit metric."""

    def __init__(self, keys: Iterable[str]) -> None:
        self.root: Node | None = None
        self.longest = 0
        for key in dict.fromkeys(keys):
            self.add(key)

    def add(self, key: str) -> None:
        self.longest = max(self.longest, len(key))
        if self.root is None:
            self.root = Node(key)
            return
        node = self.root
        while True:
            d = distance(key, node.key)
            if d == 0:
                return
            if d not in node.below:
                node.below[d] = Node(key)
                return
            node = node.below[d]

    def within(self, text: str, threshold: int) -> list[tuple[int, str]]:
        """Every (distance, key) within the threshold."""
        if len(text) > self.longest + threshold:
            return []
        found, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if not node.below and abs(len(text) - len(node.key)) > threshold:
                continue  # a leaf prunes nothing, so a bound will do
            d = distance(text, node.key)
            if d <= threshold:
                found.append((d, node.key))
            todo.extend(n for gap, n in node.below.items() if abs(gap - d) <= threshold)
        return found


def threshold(text: str) -> int:
    """Edits allowed by length: none up to 4 letters, one up to 7, two beyond."""
    return 0 if len(text) <= 4 else 1 if len(text) <= 7 else 2


class Reference:
    """A reference list by kind: names and aliases to entries, sharded trees, and the countries that tell equal names apart."""

    def __init__(self, entries: list[tuple[int, str, str, str | None, str | None, list[str]]], countries: Iterable[str] = ()) -> None:
        self.memo: dict[tuple, tuple[int, int, int] | None] = {}
        self.keys: dict[str, dict[str, list[int]]] = {}
        self.country: dict[int, set[str]] = {}
        self.countries = set(countries)  # those of other shards count too
        for cid, kind, name, country, code, aliases in entries:
            names = {compact(country or ""), compact(code or "")} - {""}
            self.country[cid] = names
            self.countries |= names
            for n in [name, *(aliases or [])]:
                if n and (k := compact(n)) and cid not in (ids := self.keys.setdefault(kind, {}).setdefault(k, [])):
                    ids.append(cid)
        self.trees = {kind: BKTree(keys) for kind, keys in self.keys.items()}

    def nearest(self, kind: str, texts: list[str], places: set[str]) -> tuple[int, int, int] | None:
        """(distance, 1 if not of a named country, entry) of the closest entry for any of the texts; the least such triple wins, here and among shards."""
        key = (kind, tuple(texts), frozenset(places))
        if key in self.memo:
            return self.memo[key]
        if len(self.memo) > REMEMBERED:
            self.memo.clear()
        self.memo[key] = found = self._nearest(kind, texts, places)
        return found

    def _nearest(self, kind: str, texts: list[str], places: set[str]) -> tuple[int, int, int] | None:
        best = None
        for text in texts:
            exact = self.keys.get(kind, {}).get(text)
            hits = [(0, text)] if exact else self.trees[kind].within(text, threshold(text)) if kind in self.trees else []
            for d, key in hits:
                for cid in self.keys[kind][key]:
                    rank = (d, 0 if not places or places & self.country[cid] else 1, cid)
                    best = rank if best is None else min(best, rank)
        return best

    def find(self, kind: str, raw: str | None) -> tuple[int, int, int] | None:
        """The closest entry of a typed value of a kind, as nearest; null for blank values and other kinds."""
        if raw is None or not raw.strip() or kind not in ("place", "employment"):
            return None
        return self.place(raw) if kind == "place" else self.employment(raw)

    def place(self, raw: str) -> tuple[int, int, int] | None:
        parts = [c for p in _PARTS.split(raw.lower()) if (c := compact(PLACE_EXTRAS.sub(" ", p.strip())))]
        named = {p for p in parts if p in self.countries}
        rest = [p for p in parts if p not in named]
        return self.nearest("place", rest, named)

    def employment(self, raw: str) -> tuple[int, int, int] | None:
        text = compact(EMPLOYMENT_EXTRAS.sub(" ", raw.strip().lower()))
        return self.nearest("employment", [text], set()) if text else None


#: References of this worker by content, kept from task to task.
_references: dict[int, Reference] = {}


def _reference(entries: list) -> Reference:
    key = hash64(repr(entries))
    if key not in _references:
        _references.clear()
        _references[key] = Reference(entries)
    return _references[key]


def map_values(values: DataFrame, canon: DataFrame, id_col: str = "ingest_id", field_col: str = "field", kind_col: str = "kind", value_col: str = "value") -> DataFrame:
    """(id, field, value, canon_id, edits) of every non-blank value; canon_id 0 and edits null where no entry is within the threshold.

    `kind` is place or employment; values of another kind have no entry. Null and blank values give no rows, repeated rows are mapped
    each. Equal distances go to the entry of a country named beside the place, then to the smaller id. With a list of up to
    SHARD_ENTRIES entries rows aren't shuffled and workers remember values already mapped; of a longer list the distinct
    values meet every shard, and rows are joined to the winners.
    """
    named = canon.filter(F.col("canon_id").isNotNull()).select("canon_id", "kind", "canonical_name", "country", "country_code", "aliases")
    given = values.select(id_col, field_col, kind_col, value_col).filter(blank_to_null(F.col(value_col)).isNotNull())
    n = named.count()
    if n > SHARD_ENTRIES:
        return _map_sharded(given, named, n, id_col, field_col, kind_col, value_col)
    shared = values.sparkSession.sparkContext.broadcast([tuple(r) for r in named.collect()])
    out = f"`{id_col}` {values.schema[id_col].dataType.simpleString()}, `{field_col}` string, `{value_col}` string, canon_id int, edits int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ref = _reference(shared.value)
        memo: dict[tuple[str, str], tuple[int, int | None]] = {}
        for b in batches:
            if len(memo) > REMEMBERED:
                memo.clear()
            ids, edits = [], []
            for key in zip(b[kind_col], b[value_col], strict=True):
                if key not in memo:
                    hit = ref.find(*key)
                    memo[key] = (hit[2], hit[0]) if hit else (0, None)
                ids.append(memo[key][0])
                edits.append(memo[key][1])
            yield b[[id_col, field_col, value_col]].assign(canon_id=pd.array(ids, "Int32"), edits=pd.array(edits, "Int32"))

    return given.mapInPandas(run, out)


def _map_sharded(given: DataFrame, named: DataFrame, n: int, id_col: str, field_col: str, kind_col: str, value_col: str) -> DataFrame:
    """map_values with a list of any length. The names of countries, which are few, go to every task."""
    countries = sorted({c for r in named.select("country", "country_code").distinct().collect() for x in r if (c := compact(x or ""))})
    distinct = materialize(given.select(F.col(kind_col).alias("kind"), F.col(value_col).alias("value")).distinct(), "typed-values")
    shards, parts = -(-n // SHARD_ENTRIES), max(1, -(-distinct.count() // SHARD_VALUES))
    meet, columns = ["shard", "part"], named.columns

    def each(m: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    asked = distinct.withColumn("part", F.pmod(F.xxhash64("kind", "value"), F.lit(parts)).cast("int")).withColumn("shard", each(shards))
    sharded = named.withColumn("shard", F.pmod(F.xxhash64("canon_id"), F.lit(shards)).cast("int")).withColumn("part", each(parts))

    def search(asked: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        rows = entries[columns].itertuples(index=False, name=None)
        ref = Reference([(*r[:5], [] if r[5] is None else list(r[5])) for r in rows], countries)
        hits = [(kind, value, *hit) for kind, value in zip(asked["kind"], asked["value"], strict=True) if (hit := ref.find(kind, value))]
        return pd.DataFrame(hits, columns=["kind", "value", "edits", "elsewhere", "canon_id"])

    found = asked.groupBy(*meet).cogroup(sharded.groupBy(*meet)).applyInPandas(search, "kind string, value string, edits int, elsewhere int, canon_id int")
    best = found.groupBy("kind", "value").agg(F.min(F.struct("edits", "elsewhere", "canon_id")).alias("best")).select(F.col("kind").alias(kind_col), F.col("value").alias(value_col), "best")
    mapped = given.join(best, [kind_col, value_col], "left")
    return mapped.select(id_col, field_col, value_col, F.coalesce("best.canon_id", F.lit(0)).alias("canon_id"), F.col("best.edits").alias("edits"))
