import pytest
from pyspark.sql import functions as F

from loomwork.functions import extraction as ex
from loomwork.functions import postings as po
from loomwork.functions import vocabulary as vo
from loomwork.operators import skills as sk
from loomwork.queries import snapshots
from loomwork.sources import feeds
from tests.conftest import rows

TAX = [("Python", ["py", "python3"]), ("Node.js", None), ("Machine learning", ["تعلم الآلة"]), ("C#", ["csharp"])]


@pytest.fixture
def tax(spark):
    return spark.createDataFrame(TAX, "canonical_name string, aliases array<string>")


def test_resolution(spark, tax):
    df = spark.createDataFrame([(t,) for t in ("PY", "nodejs", "Machine lerning", "c#", "basket weaving", " ", None, "PY")], "token string")
    got = {t: (n, m) for t, n, m, _ in rows(sk.resolve_skills(df, tax))}
    assert got == {"PY": ("Python", "alias"), "nodejs": ("Node.js", "orthographic"), "Machine lerning": ("Machine learning", "fuzzy"), "c#": ("C#", "alias"), "basket weaving": (None, "unmapped")}
    assert {m for _, _, m, _ in rows(sk.resolve_skills(df, tax.limit(0)))} == {"unmapped"}


def test_mentions_coverage_and_alignment(spark, tax):
    docs = spark.createDataFrame([(1, "Uses Python3, node.js. And machine  learning"), (2, None), (3, "pythonic only")], "id int, text string")
    held = sk.skills_in(docs, tax, "id", "text")
    assert rows(held) == [(1, "Machine learning"), (1, "Node.js"), (1, "Python")]
    want = spark.createDataFrame([("q", "Python", True), ("q", "C#", False), ("q", "C#", False)], "query string, skill string, must boolean")
    assert rows(sk.coverage(want, held.withColumnRenamed("canonical_name", "skill"))) == [("q", 1, 0.75, "Python", "C#")]
    e = spark.createDataFrame([("q", 1, [1.0, 0.0]), ("q", 2, [0.0, 1.0])], "query string, item int, vec array<double>")
    o = spark.createDataFrame([("q", 7, [2.0, 0.0]), ("q", 8, [3.0, 0.0]), ("q", 9, [0.0, -1.0])], "query string, part int, vec array<double>")
    assert rows(sk.alignment(e, o)) == [("q", 1, 7, 1.0, "met"), ("q", 2, 7, 0.0, "unmet")]


def test_more_names_than_go_to_a_task(spark, tax, monkeypatch):
    docs = spark.createDataFrame([(1, "Uses Python3, node.js. And machine  learning"), (2, None), (3, "pythonic only. Node.js."), (4, "C#, c#"), (5, "")], "id int, text string")
    tokens = spark.createDataFrame([(t,) for t in ("Machine lerning", "Pithon3", "basket weaving", "c#")], "token string")
    held, resolved = rows(sk.skills_in(docs, tax, "id", "text")), rows(sk.resolve_skills(tokens, tax))
    monkeypatch.setattr(sk, "MOST_NAMES", 2)
    assert rows(sk.skills_in(docs, tax, "id", "text")) == held and rows(sk.resolve_skills(tokens, tax)) == resolved and len(held) == 5


def test_requirements_by_skill(spark, tax):
    asked = [("a", True, "Python and C# ; Node.js or machine learning"), ("a", True, "Python, C#"), ("a", False, "Either Python/C#"), ("b", True, "basket weaving"), ("b", None, "py"), ("c", True, None), ("c", True, "")]
    df = spark.createDataFrame(asked, "query string, must boolean, text string")
    assert rows(sk.expand_requirements(df, tax)) == sorted([("a", True, "Python", []), ("a", True, "C#", []), ("a", True, "Machine learning", ["Node.js"]), ("a", False, "C#", ["Python"]), ("b", None, "Python", [])], key=repr)
    assert rows(sk.expand_requirements(df.limit(0), tax)) == []


def test_redaction_of_names():
    cv = "Curriculum Vitae\nSam O'Neil | \nsam@mail.example, 0100 123 4567\nSAM O'NEIL led sam@mail.example"
    out, values = ex.redacted_with_names(cv)
    assert out == "Curriculum Vitae\n[[NAME_1]] | \n[[EMAIL_1]], [[PHONE_1]]\n[[NAME_1]] led [[EMAIL_1]]"
    assert ex.restored(out, values).lower() == cv.lower() and ex.restored("[[NAME_9]]", values) == "[[NAME_9]]"
    assert ex.header_name("12 Main\nx@y.zz\nAna Maria\n") == "Ana Maria" and ex.header_name("one") is None and ex.header_name(None) is None
    assert ex.redacted_with_names("met Ana Li", "Ana Li") == ("met [[NAME_1]]", {"[[NAME_1]]": "Ana Li"}) and ex.redacted_with_names(None) == ("", {})


def test_vectors_and_claims(spark):
    a, b = sk.hashed_vector("Data engineer"), sk.hashed_vector("data ENGINEER!")
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-9 and set(sk.hashed_vector(None)) == {0.0}
    assert sk.figures("four million events, 40% and 3 years in 2021") == {(4e6, "count"), (40.0, "percent"), (3.0, "duration")}
    assert sk.unsupported("Led 12 people, 40% faster, CISSP since 2019", "40 percent; 12 engineers") == ["credential:cissp", "year:2019"]
    df = spark.createDataFrame([("9 x", None), (None, "x")], "a string, b string")
    assert [list(r[0]) for r in df.select(sk.unsupported_claims("a", "b")).collect()] == [["figure:9:multiple"], []]
    m = spark.createDataFrame([("k", None, 1), ("k", "s", 2), ("k", "t", 3)], "k string, span string, n int")
    assert rows(sk.best_mention(m, ["k"], ["span"], "n")) == [("k", "s", 2)]


def test_arabic_fallbacks(spark):
    def each(f, *given):
        return [spark.createDataFrame([(v,)], "v string").select(f(F.col("v"))).first()[0] for v in given]

    assert each(po.seniority, "مهندس حديث التخرج", "Senior مهندس حديث التخرج", "مهندس") == ["junior", "senior", None]
    assert each(lambda c: po.seniority(F.lit("مهندس"), c), "نبحث عن خبير في المجال", "x" * 600 + " خبير", None) == ["senior", None, None]
    assert each(lambda c: po.seniority(F.lit("مهندس"), c, head_chars=None), "x" * 600 + " خبير") == ["senior"]
    assert each(po.workplace, "عمل عن بعد", "hybrid عن بعد", "القاهرة", None) == ["remote", "hybrid", None, None]
    assert each(po.employment, "دوام كامل", "Full-time دوام جزئي", "شيء", "", None) == ["full_time", "full_time", "other", None, None]


def test_vocabulary(spark):
    one = lambda v, f: spark.createDataFrame([(v,)], "v string").select(f(F.col("v"))).first()[0]
    assert one("مهندس حديث التخرج", lambda c: vo.label_by_phrase(c, vo.LEVELS)) == "junior" and one(None, lambda c: vo.label_by_phrase(c, vo.LEVELS)) is None
    assert one("المهارات والتعليم", vo.sections_named) == ["education", "skills"]
    assert [one(t, vo.arabic_years) for t in ("خبرة ٥ سنوات", "خمس سنوات ثم سنتين", "سنتين", "بلا", None)] == [5.0, 5.0, 2.0, None, None]
    assert [one(u, lambda c: vo.platform_of(c))["platform"] for u in ("https://jobs.lever.co/x", "https://x.bamboohr.com/careers/1", "https://x.bamboohr.com/home", None)] == ["lever", "bamboohr", "unknown", "unknown"]
    assert spark.range(1).select(vo.platform_of(F.lit("https://a.b"), F.lit('<div id="grnhse_app">'))).first()[0]["method"] == "html"
    assert tuple(spark.range(1).select(vo.apply_link(F.lit(" "), F.lit(None), F.lit("j"), F.lit("r"), F.lit("s"))).first()[0]) == ("j", "json_ld")
    hints = {"canada": "CA", "egypt": "EG"}
    got = [one(p, lambda c: vo.place_parts(c, hints)) for p in ("Cairo, Egypt (Remote)", "Foster City, CA", "Remote - CA", "Egyptian Lake", "  ", None)]
    assert [(g and (g["city"], g["country"], g["is_remote"])) for g in got] == [("Cairo", "EG", True), ("Foster City", "US", False), (None, None, True), ("Egyptian Lake", None, False), None, None]


def test_parse_quality(spark):
    good = "Experience\n" + "Built many things for people. " * 60 + "\nEducation\nSkills\na@b.com"
    df = spark.createDataFrame([(good,), ("left     right\nx     y",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(ex.parse_quality(F.col("t"))).collect()]
    assert got[0] == 1.0 and got[1] == 0.0 and got[2:] == [0.0, 0.0]


def test_late_details_and_offers(spark):
    p = spark.createDataFrame([("1", ""), ("2", "there"), ("3", None)], "external_id string, description string")
    d = spark.createDataFrame([("1", [("T", "body"), ("U", " ")]), ("2", [("T", "new")]), ("3", [])], "external_id string, sections array<struct<title:string,text:string>>")
    assert rows(feeds.with_details(p, d)) == [("1", "T\nbody"), ("2", "there"), ("3", None)]
    schema = "ingest_id int, id int, title string, description string, requirements string, careers_url string, careers_apply_url string, city string, country_code string, location string, remote boolean, employment_type_code string, published_at string, created_at string"
    row = feeds.recruitee(spark.createDataFrame([(1, 5, "Chef", "<p>a</p>", "b", "u", None, "Rome", "IT", None, True, "fulltime", None, "2025")], schema)).first()
    assert (row["external_id"], row["description"], row["location"], row["remote_type"], row["employment_type"], row["apply_url"], row["written_at"]) == ("5", "a\n\nb", "Rome, IT", "remote", "full_time", "u", "2025")


def test_every_item_against_every_other_of_its_suite(spark):
    vecs = [("q", 2, [1.0, 0.0]), ("q", 4, [1.0, 0.1]), ("q", 5, [0.0, 1.0]), ("lone", 8, [1.0, 0.0])]
    items = spark.createDataFrame(vecs, "query string, item int, vec array<double>")
    got = [tuple(r) for r in sk.alignment(items, items.withColumnRenamed("item", "part"), others_only=True).orderBy("item").collect()]
    assert got == [("q", 2, 4, 0.995, "met"), ("q", 4, 2, 0.995, "met"), ("q", 5, 4, 0.0995, "unmet"), ("lone", 8, None, 0.0, "unmet")]
    e = spark.read.parquet("/root/testdata/sf0.001/eval_items.parquet").filter("suite is not null")
    found = snapshots.hashed_alignment(spark, "/root/testdata/sf0.001")
    assert rows(found.select("item")) == rows(e.select("item_id")) and found.filter("item = best").count() == 0


def test_arabic_documents_by_content(spark, tmp_path):
    arabic = "المسمى الوظيفي مدير مشاريع"
    docs = [(1, arabic, "ar"), (2, arabic, None), (3, arabic, "en"), (4, "We look for a cook", "ar"), (5, "Free lunch. " * 400 + arabic * 200, "en"), (6, None, "ar")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(snapshots.arabic_fields(spark, str(tmp_path)).select("doc_id")) == [(1,), (2,), (3,), (5,)]
