"""Queries of the problems on text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.canonical import EMPLOYMENT_EXTRAS, PLACE_EXTRAS, map_values
from loomwork.llm.language import fit_network, identify, label_language
from loomwork.llm.leakage import find_leaks
from loomwork.llm.near_copies import near_copy_classes, near_copy_groups, near_copy_pairs
from loomwork.llm.repeated_lines import count_lines, excess_lines, explode_lines, name_lines, plain_lines, remove_lines, with_html_lines
from loomwork.llm.residue import fit_residue, score_records
from loomwork.llm.tokenizer import encode_corpus
from loomwork.queries import Registry
from loomwork.session import materialize, table

registry = Registry()


def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ingest_id, field, kind, value) of every typed value."""
    fields = [
        ("lever_postings", "categories.location", "place"),
        ("lever_postings", "categories.commitment", "employment"),
        ("workable_jobs", "employment_type", "employment"),
        ("smartrecruiters_postings", "location.fullLocation", "place"),
    ]
    parts = [table(spark, sf_dir, t).select("ingest_id", F.lit(f).alias("field"), F.lit(k).alias("kind"), F.col(f).alias("value")) for t, f, k in fields]
    return reduce(DataFrame.unionByName, parts)


_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}]"


def _compact_sql(x: str) -> str:
    for letter, plain in (("ł", "l"), ("ø", "o"), ("đ", "d"), ("ð", "d"), ("þ", "th"), ("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ı", "i")):
        x = f"replace({x}, '{letter}', '{plain}')"
    return rf"regexp_replace(strip_accents({x}), '[^\p{{L}}\p{{N}}]', '', 'g')"


_P5 = rf"""with v as (select ingest_id, 'categories.location' as field, 'place' as kind, categories.location as value from lever_postings union all select ingest_id, 'categories.commitment', 'employment', categories.commitment from lever_postings
union all select ingest_id, 'employment_type', 'employment', employment_type from workable_jobs union all select ingest_id, 'location.fullLocation', 'place', location.fullLocation from smartrecruiters_postings),
t as (select * from v where regexp_replace(value, '{_SPACE}+', '', 'g') <> ''), d as (select distinct kind, value from t),
c as (select canon_id, kind, [{_compact_sql("lower(coalesce(country, ''))")}, {_compact_sql("lower(coalesce(country_code, ''))")}] as lands, unnest(list_append(coalesce(aliases, []), canonical_name)) as name from canon_values),
k as (select distinct canon_id, kind, lands, {_compact_sql("lower(name)")} as key from c where name <> ''), lands as (select distinct unnest(lands) as land from c),
raw as (select kind, value, unnest(regexp_split_to_array(lower(value), '[,;/|()\[\]]|\s-\s')) as part from d where kind = 'place'),
bare as (select kind, value, {_compact_sql(rf"regexp_replace(regexp_replace(part, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{PLACE_EXTRAS.pattern}', ' ', 'g')")} as part from raw
union all select kind, value, {_compact_sql(rf"regexp_replace(regexp_replace(lower(value), '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{EMPLOYMENT_EXTRAS.pattern}', ' ', 'g')")} from d where kind = 'employment'),
w as (select kind, value, part, kind = 'place' and part in (select land from lands where land <> '') as is_land from bare where part <> ''),
named as (select kind, value, list(part) as spots from w where is_land group by 1, 2),
ask as (select distinct kind, value, part, case when length(part) <= 4 then 0 when length(part) <= 7 then 1 else 2 end as most from w where not is_land),
near as (select ask.kind, ask.value, ask.part, k.canon_id, k.lands, damerau_levenshtein(ask.part, k.key) as e from ask join k on ask.kind = k.kind and abs(length(ask.part) - length(k.key)) <= most where damerau_levenshtein(ask.part, k.key) <= most),
best as (select kind, value, min((e, case when spots is null or list_has_any(spots, lands) then 0 else 1 end, canon_id)) as b from near left join named using (kind, value) group by 1, 2),
m as (select t.*, coalesce(b[3], 0)::int as canon_id from t left join best using (kind, value))"""


@registry.query(sql=f"{_P5} select ingest_id, field, canon_id from m")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each typed value with the entry of the reference list it means, 0 if none."""
    return map_values(typed_values(spark, sf_dir), table(spark, sf_dir, "canon_values")).select("ingest_id", "field", "canon_id")


@registry.query(sql=f"{_P5} select field, trim(value, ' ') as value, count(*) as n_rows from m where canon_id = 0 group by 1, 2")
def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values without an entry, by field, with their number of rows."""
    mapped = map_values(typed_values(spark, sf_dir), table(spark, sf_dir, "canon_values"))
    return mapped.filter("canon_id = 0").groupBy("field", F.trim("value").alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))


@registry.query()
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"))


_P9 = r"""with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items where text is not null),
dg as (select doc_id, array_to_string(w[k:k + 11], ' ') as g from d, unnest(range(1, len(w) - 10)) as t(k)),
ig as (select item_id, array_to_string(w[k:k + 11], ' ') as g from i, unnest(range(1, len(w) - 10)) as t(k))
select distinct doc_id, item_id from dg join ig using (g)"""


@registry.query(sql=_P9)
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents holding at least 12 consecutive words of an evaluation item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


@registry.query()
def p9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which tiles of 5 words or more cover at least half of the item, reordered or not."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), seed=5, min_longest=5, min_coverage=0.5)


def board_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feed, board, ingest_id, posting, part, pos, line, folded) of lever's plain texts and workable's description."""
    lever = table(spark, sf_dir, "lever_postings").select(F.lit("lever").alias("feed"), "board", "ingest_id", F.col("id").alias("posting"), "descriptionPlain", "additionalPlain")
    keys = ["feed", "board", "ingest_id", "posting", "part"]
    plain = [
        explode_lines(lever.select("feed", "board", "ingest_id", "posting", F.lit(c).alias("part"), plain_lines(F.col(c)).alias("lines")), keys)
        for c in ("descriptionPlain", "additionalPlain")
    ]
    workable = table(spark, sf_dir, "workable_jobs").select(
        F.lit("workable").alias("feed"), "board", "ingest_id", F.col("shortcode").alias("posting"), F.lit("description").alias("part"), F.col("description").alias("lines")
    )
    return reduce(DataFrame.unionByName, [*plain, explode_lines(with_html_lines(workable, "lines"), keys)])


def board_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(board, posting) of the tables of board_lines."""
    pairs = (("lever_postings", "id"), ("workable_jobs", "shortcode"))
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, t).select("board", F.col(c).alias("posting")) for t, c in pairs])


_LINES = r"""lv as (select ingest_id, board, id as posting, regexp_split_to_array(descriptionPlain, '\r\n|\r|\n') as d, regexp_split_to_array(additionalPlain, '\r\n|\r|\n') as a from lever_postings),
wk as (select ingest_id, board, shortcode as posting, regexp_split_to_array(description, '(?i)</?(?:p|div|ul|li|h3|br)\b[^>]*>') as d from workable_jobs),
l as (select 'lever' as feed, ingest_id, board, posting, 'descriptionPlain' as part, unnest(range(len(d))) as pos, unnest(d) as line from lv
union all select 'lever', ingest_id, board, posting, 'additionalPlain', unnest(range(len(a))), unnest(a) from lv
union all select 'workable', ingest_id, board, posting, 'description', pos,
replace(replace(replace(replace(replace(replace(replace(regexp_replace(line, '<[^>]*>', '', 'g'), '&nbsp;', chr(160)), '&#x27;', chr(39)), '&#39;', chr(39)), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')
from (select ingest_id, board, posting, unnest(range(len(d))) as pos, unnest(d) as line from wk)),
f as (select *, nullif(trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}]+', ' ', 'g')), '') as folded from l)"""
_SCORES = f"""{_LINES}, c as (select board, folded, count(distinct posting) as n_in from f where folded is not null and board is not null and posting is not null group by 1, 2),
sz as (select board, count(*) as docs_in from (select board, id as p from lever_postings union select board, shortcode from workable_jobs) where board is not null and p is not null group by 1),
x as (select board, folded, n_in, sum(n_in) over (partition by folded) - n_in as n_out, docs_in, (select sum(docs_in) from sz) - docs_in as docs_out from c join sz using (board)),
e as (select *, (n_in + n_out) / (docs_in + docs_out)::double as share from x),
r as (select *, case when docs_out > 0 and n_in::hugeint * docs_out > n_out::hugeint * docs_in then 2 * (
n_in * ln(n_in / (docs_in * share)) + case when n_out > 0 then n_out * ln(n_out / (docs_out * share)) else 0 end
+ case when docs_in > n_in then (docs_in - n_in) * ln((docs_in - n_in) / (docs_in * (1 - share))) else 0 end
+ case when docs_out > n_out then (docs_out - n_out) * ln((docs_out - n_out) / (docs_out * (1 - share))) else 0 end) else 0 end as llr from e),
bins as (select cast(floor(least(llr / 0.05, 20000)) as int) as b, count(*) as n from r group by 1),
cum as (select b, sum(n) over (order by b desc) as seen, sum(n) over () as tests from bins),
th as (select coalesce(min(b) * 0.05, 1e300) as t from cum where b > 0 and exp(-b * 0.05 / 2) <= 0.01 * seen / tests),
s as (select board, folded, n_in, n_out, llr, llr >= t as significant from r, th where n_in >= 8)"""
_CLEAN = """select feed, f.ingest_id, part, coalesce(string_agg(line, chr(10) order by pos) filter (where s.folded is null), '') as text, count(s.folded) as n_removed
from f left join s on f.board = s.board and f.folded = s.folded group by 1, 2, 3"""


def _repeated(spark: SparkSession, sf_dir: str, also_common: bool) -> tuple[DataFrame, DataFrame]:
    """Lines of all boards, and the repeated ones among them."""
    lines = board_lines(spark, sf_dir)
    counts = count_lines(lines, board_postings(spark, sf_dir), "board", "posting")
    return lines, excess_lines(counts, also_common=also_common)


@registry.query(sql=f"with {_LINES} select board, folded as line from f where folded is not null and board is not null group by 1, 2 having count(distinct posting) >= 8")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand in at least 8 distinct postings of one board, whether or not they are as usual elsewhere."""
    lines, excess = _repeated(spark, sf_dir, also_common=True)
    return name_lines(excess, lines, "board").select(F.col("source").alias("board"), "line")


@registry.query(sql=f"with {_SCORES} select board, folded as line, n_in, n_out, round(llr, 3) as llr, significant::int as significant from s")
def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated lines with their counts inside and outside the board and the significance of the excess."""
    lines, excess = _repeated(spark, sf_dir, also_common=True)
    named = name_lines(excess, lines, "board")
    return named.select(F.col("source").alias("board"), "line", "n_in", "n_out", F.round("llr", 3).alias("llr"), F.col("significant").cast("int").alias("significant"))


@registry.query(sql=f"with {_SCORES.replace('where n_in >= 8', 'where n_in >= 8 and llr >= t')} {_CLEAN}")
def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text without the lines that stand in its board significantly more often than elsewhere."""
    lines, excess = _repeated(spark, sf_dir, also_common=False)
    return remove_lines(lines, excess, "board", ["feed", "ingest_id", "part"])


@registry.query(sql=f"with {_SCORES} {_CLEAN}")
def p7_clean_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text without any line of p7_found."""
    lines, excess = _repeated(spark, sf_dir, also_common=True)
    return remove_lines(lines, excess, "board", ["feed", "ingest_id", "part"])


@registry.query()
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of postings without a right label, and of the lines of mixed ones."""
    return p3_languages(spark, sf_dir).filter("not right_label and (whole or seg > 0)").select("ingest_id", "seg", "lang")


@registry.query()
def p3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting (segment 0) and every line of a mixed one with language, confidence and share of the text, and whether its label was right."""
    greenhouse = table(spark, sf_dir, "greenhouse_jobs").select("ingest_id", "content", "language")
    net = fit_network(greenhouse, "ingest_id", "content", "language")
    labelled = greenhouse.select("ingest_id", "content", F.lit(True).alias("is_html"), F.coalesce(label_language(F.col("language")), F.lit("?")).alias("label"))
    plain = [
        table(spark, sf_dir, t).select("ingest_id", F.col("descriptionPlain").alias("content"), F.lit(False).alias("is_html"), F.lit(None).cast("string").alias("label"))
        for t in ("lever_postings", "ashby_jobs")
    ]
    found = identify(reduce(DataFrame.unionByName, [labelled, *plain]), net)
    # A labelled feed is judged as a whole, the others line by line where lines differ.
    whole = F.col("label").isNotNull() | (F.col("share") == 1.0)
    return found.select("ingest_id", "seg", "lang", "confidence", "share", whole.alias("whole"), F.coalesce(F.col("label") == F.col("lang"), F.lit(False)).alias("right_label")).filter(
        F.col("label").isNull() | (F.col("seg") == 0)
    )


def _alike_postings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lever = table(spark, sf_dir, "lever_postings").select("ingest_id", F.col("text").alias("title"), "descriptionPlain")
    ashby = table(spark, sf_dir, "ashby_jobs").select("ingest_id", "title", "descriptionPlain")
    return near_copy_classes(lever.unionByName(ashby), "ingest_id", "title", "descriptionPlain", width=3, threshold=0.6, min_words=20)


_P6 = r"""with t as (select ingest_id, text as title, descriptionPlain as body from lever_postings union all select ingest_id, title, descriptionPlain from ashby_jobs),
p as (select ingest_id, regexp_extract_all(lower(coalesce(title, '') || chr(10) || body), '[\p{L}\p{N}]+') as w from t where len(regexp_extract_all(lower(body), '[\p{L}\p{N}]+')) >= 20),
s as (select distinct ingest_id, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] as g from p, unnest(range(1, len(w) - 1)) as r(k)), c as (select ingest_id, count(*) as n from s group by 1),
m as (select a.ingest_id as id_a, b.ingest_id as id_b, count(*) as k from s a join s b using (g) where a.ingest_id < b.ingest_id group by 1, 2)
select id_a, id_b from m join c x on x.ingest_id = id_a join c y on y.ingest_id = id_b where k >= 0.6 * (x.n + y.n - k)"""


@registry.query(sql=_P6)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of alike postings, within or across the two feeds."""
    return near_copy_pairs(*_alike_postings(spark, sf_dir))


_GROUPS = _P6.replace("with t as", "with recursive t as").replace("select id_a, id_b from m join", ", pr as (select id_a, id_b from m join") + """),
e as (select id_a as a, id_b as b from pr union all select id_b, id_a from pr), r(id, root) as (select ingest_id, ingest_id from p union select e.b, r.root from r join e on e.a = r.id),
g as (select id, min(root) as group_id from r group by 1), n as (select a as id, count(*) as n_links from e group by 1)
select g.id, group_id, coalesce(n_links, 0) as n_links from g left join n on g.id = n.id"""


@registry.query(sql=_GROUPS)
def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each posting with its group and its number of alike postings."""
    members, links = _alike_postings(spark, sf_dir)
    return near_copy_groups(members, materialize(links, "links"))


@registry.query()
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents wholly or partly made of template residue, filler, error messages or script notices."""
    docs = table(spark, sf_dir, "documents")
    return score_records(docs, fit_residue(docs)).filter("is_residue").select("doc_id").distinct()


@registry.query()
def p10_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other documents, with their scores."""
    docs = table(spark, sf_dir, "documents")
    return score_records(docs, fit_residue(docs)).filter("not is_residue").select("doc_id", "score")
