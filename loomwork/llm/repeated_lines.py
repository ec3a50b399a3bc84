"""Lines repeated across one source's documents: found by log-likelihood ratio, removed, texts reassembled.

Lines are counted by two hashes of 64 bits, so that only fixed-size numbers are shuffled; the text of a line is fetched
once it is known to matter, and occurrences never meet by their line: the found lines go to them, or a few texts a
task to the found lines. A line's share of a source's documents is held against its share of all other documents, and the
excess is significant where the false-discovery rate over all (source, line) tests allows.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import squeeze
from loomwork.operators.joins import BROADCAST_ROWS, lookup_join
from loomwork.session import materialize

#: Breadth of the bins in which ratios are counted for the false-discovery threshold.
BIN = 0.05
#: Ratios beyond this fall in one bin; their chance is under 1e-200.
TOP_RATIO = 1000.0
#: Parts over which the occurrences of a line are spread where the found lines are too many to be sent to every task.
SALTS = 32
_HASHES = ["line_hash", "line_check"]

_BLOCK = re.compile(r"</?(?:p|div|ul|li|h3|br)\b[^>]*>", re.IGNORECASE)
_TAG = re.compile(r"<[^>]*>")


def html_lines(text: str | None) -> list[str]:
    """Texts between block tags, inline tags dropped and entities decoded."""
    if text is None:
        return []
    return [html.unescape(_TAG.sub("", part)) for part in _BLOCK.split(text)]


def plain_lines(col: Column) -> Column:
    """Lines of a plain text."""
    return F.split(col, r"\r\n|\r|\n")


def with_html_lines(df: DataFrame, html_col: str) -> DataFrame:
    """`df` with `html_col` replaced by an array of its lines, in Arrow batches."""
    kinds = [f"`{f.name}` {'array<string>' if f.name == html_col else f.dataType.simpleString()}" for f in df.schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{html_col: b[html_col].map(html_lines)})

    return df.mapInPandas(run, ", ".join(kinds))


def folded_line(col: Column) -> Column:
    """The form in which lines are compared: lower case, each run of 0-9 one 0, white space squeezed; null if nothing is left."""
    return F.nullif(squeeze(F.regexp_replace(F.lower(col), r"[0-9]+", "0")), F.lit(""))


def explode_lines(docs: DataFrame, keys: list[str], lines: str = "lines") -> DataFrame:
    """keys, pos (from 0), line as written, its folded form. Blank lines are kept with a null `folded`, so that texts can be reassembled."""
    spread = docs.select(*keys, F.posexplode(lines).alias("pos", "line"))
    return spread.withColumn("folded", folded_line(F.col("line")))


def _ratio(a: Column, b: Column, n: Column, m: Column) -> Column:
    """Log-likelihood ratio (G2) of a among n against b among m."""
    n, m = n.cast("double"), m.cast("double")
    share = (a + b) / (n + m)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(F.lit(0.0))

    return 2 * (part(a, n * share) + part(b, m * share) + part(n - a, n * (1 - share)) + part(m - b, m * (1 - share)))


def _hashed(folded: Column) -> list[Column]:
    """The two hashes that stand for a line."""
    return [F.xxhash64(folded).alias("line_hash"), F.xxhash64(F.lit("check"), folded).alias("line_check")]


def count_lines(lines: DataFrame, documents: DataFrame, source: str, document: str) -> DataFrame:
    """Per (source, line): in how many distinct documents of the source and of all others it stands, with the log-likelihood ratio of an excess (0 if it is no excess).

    `documents` holds (source, document) of every document, repeats allowed; `lines` comes from explode_lines.
    Null sources and documents are left out. Where all documents are of one source there is nothing to compare with,
    and every ratio is 0. The counts are written to the shared folder, since several steps read them.
    """
    known = F.col(source).isNotNull() & F.col(document).isNotNull()
    once = lines.filter(F.col("folded").isNotNull() & known).select(F.col(source).alias("source"), F.xxhash64(source, document).alias("doc"), *_hashed(F.col("folded"))).distinct()
    counted = materialize(once.groupBy("source", *_HASHES).agg(F.count(F.lit(1)).alias("n_in")), "line-counts")
    everywhere = counted.groupBy(*_HASHES).agg(F.sum("n_in").alias("n_all"))
    sizes = documents.filter(known).select(F.col(source).alias("source"), document).distinct().groupBy("source").agg(F.count(F.lit(1)).alias("docs_in"))
    sizes = materialize(sizes, "source-sizes")
    total = int(sizes.agg(F.coalesce(F.sum("docs_in"), F.lit(0))).first()[0])
    joined = lookup_join(counted.join(everywhere, _HASHES), sizes, "source").withColumn("docs_all", F.lit(total).cast("bigint"))
    out_in, out_all = F.col("n_all") - F.col("n_in"), F.col("docs_all") - F.col("docs_in")
    excess = (out_all > 0) & (F.col("n_in") * out_all > out_in * F.col("docs_in"))
    llr = F.when(excess, _ratio(F.col("n_in"), out_in, F.col("docs_in"), out_all)).otherwise(0.0)
    return joined.select("source", *_HASHES, "n_in", out_in.alias("n_out"), "docs_in", out_all.alias("docs_out"), llr.alias("llr"))


def discovery_threshold(counts: DataFrame, rate: float) -> float:
    """The smallest ratio that is significant by Benjamini-Hochberg at a false-discovery rate over all rows of `counts`.

    A ratio's chance is taken as exp(-ratio / 2), an upper bound of the chi-square tail. Ratios are counted in bins of fixed breadth, at most TOP_RATIO / BIN of them, so neither a global sort nor an
    unbounded collect is needed; a bin counts as its lower edge, which errs on the strict side.
    """
    binned = counts.groupBy(F.least(F.floor(F.col("llr") / BIN), F.lit(int(TOP_RATIO / BIN))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = sorted(((int(r["bin"]), int(r["n"])) for r in binned.collect()), reverse=True)
    tests, seen, threshold = sum(n for _, n in bins), 0, math.inf
    for at, n in bins:
        seen += n
        if math.exp(-at * BIN / 2) <= rate * seen / max(1, tests) and at > 0:
            threshold = at * BIN
    return threshold


def excess_lines(counts: DataFrame, rate: float = 0.01, min_documents: int = 8, also_common: bool = False) -> DataFrame:
    """Rows of `counts` repeated in at least `min_documents` documents of the source, with `significant`.

    Only significant excess is kept, unless `also_common`: then a line that is as usual elsewhere is kept too,
    marked not significant. An empty table gives no rows.
    """
    often = counts.filter(F.col("n_in") >= min_documents)
    marked = often.withColumn("significant", F.col("llr") >= F.lit(discovery_threshold(counts, rate)))
    return marked if also_common else marked.filter("significant")


def _small(table: DataFrame) -> bool:
    return table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def name_lines(excess: DataFrame, lines: DataFrame, source: str) -> DataFrame:
    """The text of excess lines: (source, line, n_in, n_out, llr, significant), one row each.

    Excess lines that are counted as few are sent to the occurrences; otherwise each task reduces its occurrences to one
    text a line before these are joined.
    """
    excess = materialize(excess, "excess-lines")
    texts = lines.filter(F.col("folded").isNotNull() & F.col(source).isNotNull()).select(F.col(source).alias("source"), *_hashed(F.col("folded")), "folded")
    if _small(excess):
        texts = texts.join(F.broadcast(excess.select("source", *_HASHES)), ["source", *_HASHES], "left_semi")
    named = texts.groupBy("source", *_HASHES).agg(F.min("folded").alias("line"))
    return named.join(excess, ["source", *_HASHES]).select("source", "line", "n_in", "n_out", "llr", "significant")


def remove_lines(lines: DataFrame, excess: DataFrame, source: str, keys: list[str]) -> DataFrame:
    """Texts without excess lines: keys, text (lines in their order, joined by line feeds) and n_removed.

    A text of which no line is left is the empty string; blank lines stay. One text is one group, so no group
    outgrows its document. Excess lines that are counted as few are sent to every task; otherwise the occurrences of a
    line are spread over SALTS parts, and its mark goes to each.
    """
    marks = materialize(excess.select(F.col("source").alias("__source"), *[F.col(h).alias(f"__{h}") for h in _HASHES]), "excess-marks").withColumn("__excess", F.lit(True))
    found = lines.withColumns({f"__{h}": c for h, c in zip(_HASHES, _hashed(F.col("folded")), strict=True)} | {"__source": F.when(F.col("folded").isNotNull(), F.col(source))})
    on = ["__source", *[f"__{h}" for h in _HASHES]]
    if _small(marks):
        marks = F.broadcast(marks)
    else:
        found = found.withColumn("__salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))
        marks, on = marks.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "__salt"]
    marked = found.join(marks, on, "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("__excess").isNull(), F.struct("pos", "line"))))
    return marked.groupBy(*keys).agg(F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("text"), F.count("__excess").alias("n_removed"))
