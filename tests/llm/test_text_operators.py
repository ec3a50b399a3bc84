import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomwork.llm import canonical, leakage
from loomwork.llm import near_copies as nc
from loomwork.llm import repeated_lines as rl
from loomwork.llm import residue
from loomwork.llm.canonical import BKTree, Reference, compact, distance, map_values
from loomwork.llm.leakage import find_leaks, tile
from loomwork.llm.near_copies import near_copy_classes, near_copy_groups, near_copy_pairs
from loomwork.llm.residue import Residue, mark, passages, score_records, trusted
from loomwork.llm.words import WordHasher, bounded_sample, hash64, sampled, windows
from tests.conftest import rows

WORD = re.compile(r"[^\W_]+")


def prose(seed, n=60, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


# Words


def test_word_hasher_and_windows():
    texts = ["One, two_three!", "", "ÄB 12", "one"]
    flat, offsets = WordHasher()(texts)
    assert [flat[a:b].tolist() for a, b in itertools.pairwise(offsets)] == [[hash64(w) for w in WORD.findall(t.lower())] for t in texts]
    h = windows(np.array([5, 6, 7, 5, 6], np.uint64), 2)
    assert h[0] == h[3] and len(set(h.tolist())) == 3 and len(windows(flat[:1], 2)) == 0


# Canonical values

ENTRIES = [(1, "place", "Port Alder", "Canada", "CA", []), (2, "place", "Port Alder", "Australia", "AU", []), (3, "place", "São Tibério", "Brazil", "BR", None), (10, "employment", "Full-time", None, None, ["FT", "temps plein"])]


def test_distance_is_a_metric_and_the_tree_complete():
    r = random.Random(3)
    keys = ["".join(r.choice("abcd") for _ in range(r.randrange(1, 7))) for _ in range(80)]
    d = {(a, b): distance(a, b) for a in keys for b in keys}
    assert all(d[a, b] == d[b, a] and (d[a, b] == 0) == (a == b) for a, b in d)
    assert all(d[a, c] <= d[a, b] + d[b, c] for a, b, c in itertools.product(keys[:30], repeat=3))
    assert distance("ca", "abc") == 2 and distance("", "abc") == 3 and distance("ab", "ba") == 1
    tree = BKTree(keys)
    for q in ("abca", "d", "bbbbbb"):
        for t in (0, 1, 2):
            assert sorted(tree.within(q, t)) == sorted({(distance(q, k), k) for k in keys if distance(q, k) <= t})


@pytest.mark.parametrize(
    ("raw", "want"),
    [("port aldre, AU", 2), ("Canada - Port Alder", 1), ("Remote, Sao Tiberio", 3), ("  SÃO TIBÉRIO (on-site) ", 3), ("Greater PortAlder Area", 1), ("Brazil", None), ("Elsewhere", None), ("x" * 50_000, None)],
)
def test_places(raw, want):
    found = (hit := Reference(ENTRIES).place(raw)) and (hit[0], hit[2])
    assert (found and found[1]) == want


def test_map_values(spark):
    canon = spark.createDataFrame(ENTRIES, "canon_id int, kind string, canonical_name string, country string, country_code string, aliases array<string>")
    data = [(1, "f", "employment", "Full_tmie (40h)"), (1, "f", "employment", "Full_tmie (40h)"), (2, "f", "employment", "ft"), (3, "f", "employment", "40"), (4, "f", "place", "  "), (5, "f", "place", None), (6, "f", "place", "Nowhere")]
    df = spark.createDataFrame(data, "ingest_id int, field string, kind string, value string").withColumn("canon_id", F.lit("clash"))
    assert [(r[0], r[3], r[4]) for r in rows(map_values(df, canon))] == [(1, 10, 1), (1, 10, 1), (2, 10, 0), (3, 0, None), (6, 0, None)]
    assert {r[3] for r in rows(map_values(df, canon.limit(0)))} == {0}
    assert rows(map_values(df.limit(0), canon)) == []


def test_a_list_in_shards_gives_the_same(spark, monkeypatch):
    canon = spark.read.parquet("/root/testdata/sf0.001/canon_values.parquet")
    places = spark.read.parquet("/root/testdata/sf0.001/lever_postings.parquet").select("ingest_id", F.lit("f").alias("field"), F.lit("place").alias("kind"), F.col("categories.location").alias("value"))
    work = spark.read.parquet("/root/testdata/sf0.001/workable_jobs.parquet").select("ingest_id", F.lit("g").alias("field"), F.lit("employment").alias("kind"), F.col("employment_type").alias("value"))
    values = places.unionByName(work).unionByName(work.limit(3).withColumn("kind", F.lit("other"))).unionByName(work.limit(3))
    want = rows(map_values(values, canon))
    monkeypatch.setattr(canonical, "SHARD_ENTRIES", 7)
    monkeypatch.setattr(canonical, "SHARD_VALUES", 20)
    assert rows(map_values(values, canon)) == want and len(want) > 100
    assert rows(map_values(values.limit(0), canon)) == []
    assert compact("Łagodzin-Straße") == "lagodzinstrasse"


# Leaks


def test_leaks_against_brute_force(spark, monkeypatch):
    items = [(i, prose(1000 + i, 40)) for i in range(6)] + [(6, "too short"), (7, None)]
    split = {i: t.split() for i, t in items if t}
    docs = [(1, prose(1) + " " + " ".join(split[0][5:17]).upper().replace(" ", "; ")), (2, " ".join(split[1][3:14])), (3, " ".join(split[2][20:] + split[2][:20])), (4, None), (5, ""), (3, " ".join(split[2][20:] + split[2][:20])), (6, items[0][1])]
    d = spark.createDataFrame(docs, "doc_id int, text string").withColumn("suite", F.lit(1))
    it = spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", F.lit(9))
    want = {(k, i) for k, t in docs if t for i, w in split.items() for s in range(len(w) - 11) if " " + " ".join(w[s : s + 12]) + " " in " " + " ".join(WORD.findall(t.lower())) + " "}
    got = rows(find_leaks(d, it))
    assert {r[:2] for r in got} == want == {(1, 0), (3, 2), (6, 0)}
    assert {r[:2]: r[3] for r in got}[3, 2] == 40  # reordered, yet covered whole
    monkeypatch.setattr(leakage, "BROADCAST_ROWS", 0)  # items too many to be sent meet the texts by hash
    monkeypatch.setattr(leakage, "MOST_BITS", leakage.LEAST_BITS)
    assert rows(find_leaks(d, it)) == got
    assert rows(find_leaks(d.limit(0), it)) == rows(find_leaks(d, it.limit(0))) == []


def brute_tiles(a, b, least):
    """Greedy string tiling as it is defined: the longest common unmarked run, again and again."""
    used_a, used_b, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return tiles
        tiles.append(n)
        used_a.update(range(i, i + n))
        used_b.update(range(j, j + n))


def test_coverage_against_brute_force(spark):
    r = random.Random(12)
    items = [(i, " ".join(f"i{i}w{k}" if k % 7 else f"common{k % 5}" for k in range(30))) for i in range(6)]
    docs = []
    for d in range(60):
        words = [f"d{r.randrange(300)}" for _ in range(20)]
        for _ in range(r.randrange(4)):
            w = r.choice(items)[1].split()
            at = r.randrange(20)
            words[(c := r.randrange(len(words))) : c] = w[at : at + r.randrange(4, 30)]
        docs.append((d, " ".join(words)))
    want = {}
    for d, t in docs:
        for i, x in items:
            tiles = brute_tiles(t.split(), x.split(), 5)
            if tiles and sum(tiles) >= 15:
                want[d, i] = (tiles[0], sum(tiles))
    got = find_leaks(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), seed=5, min_longest=5, min_coverage=0.5)
    assert {(x["doc_id"], x["item_id"]): (x["longest"], x["covered"]) for x in got.collect()} == want and len(want) > 10


def test_tiles_do_not_overlap():
    p, q = np.array([0, 1, 2, 10, 11]), np.array([0, 1, 2, 1, 2])  # the second match uses item words already taken
    tiles = tile(p, q, 3)
    assert tiles[0] == (0, 0, 5) and len(tiles) == 1
    assert sum(n for _, _, n in tile(np.arange(50), np.zeros(50, int), 3)) == 3


# Near copies


def brute_pairs(docs, width, threshold, least):
    sets = []
    for i, t, b in docs:
        if b is not None and len(WORD.findall(b)) >= least:
            w = WORD.findall(f"{t or ''}\n{b}".lower())
            sets.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}))
    return {(min(i, j), max(i, j)) for (i, a), (j, b) in itertools.combinations(sets, 2) if len(a & b) >= threshold * len(a | b)}


def test_near_copies_against_brute_force(spark):
    docs = []
    for g in range(60):
        base = prose(g, 120, 5000).split()
        for c in range(1 + g % 4):
            w = list(base)
            for k in random.Random(g * 10 + c).sample(range(120), 3 * (c > 1)):
                w[k] = f"edit{g}{c}{k}"
            docs.append((g * 10 + c, "Title", " ".join(w)))
    docs += [(9000, None, "short text"), (9001, "t", None), (9002, "t", ""), (9003, "T", prose(0, 120, 5000).upper())]
    df = spark.createDataFrame(docs, "id int, t string, b string").withColumn("n", F.lit("clash")).repartition(5)
    members, links = near_copy_classes(df, "id", "t", "b", width=3, threshold=0.6, min_words=20)
    want = brute_pairs(docs, 3, 0.6, 20)
    assert {tuple(r) for r in near_copy_pairs(members, links).collect()} == want
    groups = {r[0]: (r[1], r[2]) for r in near_copy_groups(members, links).collect()}
    degree = defaultdict(int)
    for a, b in want:
        degree[a] += 1
        degree[b] += 1
    assert {i: n for i, (_, n) in groups.items()} == {i: degree[i] for i in groups}
    assert groups[9003][0] == groups[0][0] == 0


def test_hot_class_of_copies_is_linear(spark):
    df = spark.range(3000).select(F.col("id"), F.lit("t").alias("t"), F.when(F.col("id") % 3 == 0, F.lit(prose(5, 100))).otherwise(F.concat(F.lit("doc "), F.col("id").cast("string"), F.lit(" has few words"))).alias("b"))
    members, links = near_copy_classes(df, "id", "t", "b", min_words=20)
    assert near_copy_pairs(members, links).distinct().count() == near_copy_pairs(members, links).count() == 1000 * 999 // 2
    assert members.count() == 1000 and links.count() == 0
    assert {tuple(r)[1:] for r in near_copy_groups(members, links).collect()} == {(0, 999)}
    empty, none = near_copy_classes(df.limit(0), "id", "t", "b")
    assert rows(near_copy_groups(empty, none)) == []


def edited(base, share, seed):
    """A copy of a list of words of which about `share` are replaced one by one."""
    r = random.Random(seed)
    return [f"e{seed}x{i}" if r.random() < share else w for i, w in enumerate(base)]


def test_segment_counts_bound_the_difference():
    r = np.random.default_rng(5)
    for n in (1, 20, 400, 60_000):
        base = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        other = np.unique(np.r_[base[: n // 2], r.integers(0, 1 << 63, n // 3 + 1, dtype=np.uint64)])
        sets = [np.unique(base), other]
        sizes = np.array([len(x) for x in sets])
        counts, parities = nc.segment_counts(np.concatenate(sets), np.r_[0, sizes[:1]], sizes)
        differ = sum(int(a ^ b).bit_count() for a, b in zip(*parities.view(np.uint64).tolist(), strict=True))
        assert max(differ, np.abs(counts[0].astype(int) - counts[1]).sum()) <= len(np.setxor1d(*sets))


def test_steps_discard_unlike_pairs_and_no_alike_ones(spark):
    """Of the pairs in a common cell the bound discards most that aren't alike, and none that is; near the limit few are missed by the cells."""
    docs, alike = [], {}
    for g in range(600):
        base = [f"g{g}w{i}" for i in range(120)]
        for k in range(3):
            docs.append((g * 10 + k, "t", " ".join(edited(base, (0.0, 0.08, 0.03, 0.04, 0.05, 0.12)[(g + k) % 6], g * 10 + k))))
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, _, b in docs for w in [["t", *b.split()]]}
    for g in range(600):
        for x, y in itertools.combinations(range(g * 10, g * 10 + 3), 2):
            alike[x, y] = len(sets[x] & sets[y]) / len(sets[x] | sets[y])
    df = spark.createDataFrame(docs, "id bigint, t string, b string")
    found = {tuple(r) for r in near_copy_pairs(*near_copy_classes(df, "id", "t", "b", width=3, threshold=0.6, min_words=20)).collect()}
    assert all(alike[p] >= 0.6 for p in found)
    edge, clear = ({p for p, s in alike.items() if lo <= s < hi} for lo, hi in ((0.6, 0.68), (0.68, 1.1)))
    print(len(edge), len(edge & found), len(clear), len(clear & found))
    assert len(edge) >= 60 and len(edge & found) >= 0.97 * len(edge) and len(clear & found) >= 0.99 * len(clear)
    sig = nc._signature_table(df, "id", "t", "b", 3, 20)
    every = spark.createDataFrame(list(itertools.combinations([i for i, _, _ in docs][:450], 2)), "id_a bigint, id_b bigint")
    kept = {tuple(r) for r in nc.bounded_pairs(every, sig.select("id", "n", "counts"), 0.6).collect()}
    near = {p for p, s in alike.items() if s >= 0.6 and p[1] < docs[450][0]}
    unlike = every.count() - len(near)
    print(len(kept), len(near), unlike)
    assert near <= kept and len(kept - near) <= 0.02 * unlike


def test_cells_meet_whole_however_big(spark, monkeypatch):
    monkeypatch.setattr(nc, "HOT_CELL", 7)
    df = spark.range(60).selectExpr("id", "cast(10 as int) as n", "array(id % 2, 5L + id % 3) as bands", *[f"0L as {p}" for p in nc.PARITIES])
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if a % 2 == b % 2 or a % 3 == b % 3}
    assert {tuple(r) for r in nc.cell_pairs(df, 0.6).collect()} == want


# Repeated lines


def test_lines_against_brute_force(spark, monkeypatch):
    r = random.Random(9)
    docs = []
    for s, n in (("big", 60), ("small", 12), (None, 5)):
        for i in range(n):
            lines = [f"unique {s} {i} {k}".replace(str(i), chr(97 + i % 26) * (i // 26 + 1)) for k in "xyz"]
            lines.insert(r.randrange(3), f"Notice {i}  of {s}")
            if i < 7:
                lines.append("seven only")
            docs.append((s, f"{s}{i}", "\r\n".join([*lines, " ", "common to all"])))
    docs += docs[:10] + [("big", None, "Notice 1 of big"), ("big", "e", ""), ("big", "n", None)]
    df = spark.createDataFrame(docs, "source string, doc string, text string").withColumn("line", F.lit(1))
    lines = rl.explode_lines(df.select("source", "doc", rl.plain_lines(F.col("text")).alias("lines")), ["source", "doc"])
    counts = rl.count_lines(lines, df, "source", "doc")
    named = rl.name_lines(rl.excess_lines(counts, also_common=True), lines, "source")
    want = defaultdict(set)
    for s, d, t in docs:
        if s and d and t:
            for x in t.split("\r\n"):
                if n := re.sub(r"\s+", " ", re.sub(r"[0-9]+", "0", x.lower())).strip():
                    want[s, n].add(d)
    got = {(x["source"], x["line"]): (x["n_in"], x["significant"]) for x in named.collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: len(v) for k, v in want.items() if len(v) >= 8}
    assert got["big", "notice 0 of big"][1] and not got["big", "common to all"][1]
    only = rl.excess_lines(counts)
    clean = {(x["source"], x["doc"]): x["text"] for x in rl.remove_lines(lines.filter("doc = 'small3'"), only, "source", ["source", "doc"]).collect()}
    assert "Notice" not in clean["small", "small3"] and "common to all" in clean["small", "small3"]
    monkeypatch.setattr(rl, "BROADCAST_ROWS", 0)  # the ways for many found lines give the same
    assert rows(rl.name_lines(rl.excess_lines(counts, also_common=True), lines, "source")) == rows(named)
    assert {(x["source"], x["doc"]): x["text"] for x in rl.remove_lines(lines.filter("doc = 'small3'"), only, "source", ["source", "doc"]).collect()} == clean
    alone = rl.count_lines(lines.filter("source = 'big'"), df.filter("source = 'big'"), "source", "doc")
    assert alone.filter("llr <> 0").isEmpty() and rows(rl.excess_lines(alone)) == []
    none = rl.count_lines(lines.limit(0), df.limit(0), "source", "doc")
    assert rows(rl.excess_lines(none)) == []


def test_one_line_in_every_text_of_a_board_goes_to_no_single_task(spark):
    df = spark.range(20_000, numPartitions=8).select(F.lit("b").alias("source"), F.col("id").cast("string").alias("doc"), F.lit("The same notice").alias("line"), F.lit(0).alias("pos"), F.lit("the same notice").alias("folded"))
    other = df.limit(100).withColumns({"source": F.lit("c"), "line": F.col("doc"), "folded": F.concat(F.lit("w"), "doc")})
    both = df.unionByName(other)
    found = rl.excess_lines(rl.count_lines(both, both.select("source", "doc"), "source", "doc"))
    named = rl.name_lines(found, both, "source")
    assert [(r["line"], r["n_in"]) for r in named.collect()] == [("the same notice", 20_000)]
    cleaned = rl.remove_lines(both, found, "source", ["source", "doc"]).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in cleaned.filter("source = 'b'").groupBy("task").count().collect()]
    assert sum(sizes) == 20_000 and (len(sizes) == 1 or max(sizes) < 10_000)
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__source" not in plan


def test_html_lines():
    assert rl.html_lines("<p>A&nbsp;<b>b</b></p>c<br/>d &amp;amp; e<LI class='x'>f") == ["", "A b", "c", "d &amp; e", "f"]
    assert rl.html_lines(None) == [] and rl.html_lines("") == [""]


# Residue


@pytest.mark.parametrize("text", ["About us: {{ team }}", "Ihr Gehalt: [GEHALT TBC].", "Dear __FIRST_NAME__, thank you for ${x_y}.", "Lorem ipsum dolor velit magna.", "HTTP Error 502", "xxx xxx xxx xxx", "404 Not Found", "Please enable JavaScript to view this job.", "TODO: write the text"])
def test_trusted_forms(text):
    assert any(map(trusted, passages(mark(text))))


@pytest.mark.parametrize("text", ["", "Our mail tool fills [FIRST NAME] and similar tags; you keep its rule book in order.", "You replace lorem ipsum in our design drafts with real copy.", "You track down 404 and 503 answers before shoppers notice them.", "for (i=0;i<n;++i) { x[i] = a->b; } // ok", "Solid JavaScript is required, and you know it.", "In return you get free lunch, free lunch and free lunch on Fridays."])
def test_untrusted_forms(text):
    assert not any(map(trusted, passages(mark(text))))


def test_model_learns_what_goes_with_trusted_passages(spark):
    plain = [f"{prose(i, 30)}. {prose(i + 5000, 20)}." for i in range(400)]
    bad = [f"The wages for this role are [PAY TBC]. {p}" if i % 2 else f"{p} Please enable JavaScript to view this job." for i, p in enumerate(plain[:60])]
    model = Residue.fit([*plain, *bad])
    cases = [(1, "Some Studio Please enable JavaScript to view this job."), (2, "The wages for this role are {{ pay }}."), (3, plain[7]), (4, None), (5, ""), (6, " \n"), (3, plain[7]), (7, " ".join(plain) + "\nPlease enable JavaScript to view this job.")]
    df = spark.createDataFrame(cases, "doc_id int, text string").withColumn("score", F.lit("clash"))
    got = score_records(df, model).collect()
    assert [(r["doc_id"], r["is_residue"]) for r in got] == [(1, True), (2, True), (3, False), (4, False), (5, False), (6, False), (3, False), (7, True)]
    assert got[3]["score"] is None and rows(score_records(df.limit(0), model)) == []
    for none in (Residue.fit([]), Residue.fit(["", " "]), Residue.fit(plain)):
        assert not any(r["is_residue"] for r in score_records(df, none).collect())


FAMILIES = {
    "scripts": r"javascript|cookies|browser|scripts",
    "filler": r"text goes|sample text|your content|todo|blindtext|texte à",
    "errors": r"error|fehler|erreur|fout|erro|خطأ|\b[45]\d\d\b|denied|wrong|requests|not found",
    "German and Dutch": r"fehler|bitte|aktivieren|diese|fout|schakel|deze|blindtext",
}


@pytest.mark.parametrize("family", FAMILIES)
def test_wordings_left_out_of_the_forms_are_found(monkeypatch, family):
    """Forms without a whole family of wordings, or two languages: the model finds much of it by its company."""
    texts = [t for t in pd.read_parquet("/root/testdata/sf0.1/documents.parquet")["text"] if isinstance(t, str)]
    held = re.compile(FAMILIES[family], re.I)
    found_forms = [[p for p in passages(mark(t)) if trusted(p)] for t in texts]
    surely = np.array([bool(f) for f in found_forms])
    unseen = np.array([bool(f) and all(held.search(p) for p in f) for f in found_forms])
    monkeypatch.setattr(residue, "trusted", lambda p: trusted(p) and not held.search(p))
    model = Residue.fit(texts)
    found = model.best(*residue.Featurizer()(texts)) >= model.limit
    print(family, surely.sum(), unseen.sum(), found[surely].mean(), found[unseen].mean(), found.sum())
    assert unseen.sum() > 40 and found[surely].mean() >= 0.88 and found[unseen].mean() >= 0.25 and found.sum() <= 1.25 * surely.sum()


def test_samples_hold_rows_at_any_size(spark):
    df = spark.range(200_000).select(F.col("id"), F.lit("t").alias("text"))
    few = sampled(df, "id", 20_000, total=2_000_000).count()
    assert 1_700 < few < 2_300 and sampled(df.limit(0), "id", 5).count() == 0
    # Among 1e11 rows, about 8,000 have a hash in this share; the filter itself must not be empty.
    plan = sampled(df, "id", 8_000, total=10**11)._jdf.queryExecution().optimizedPlan().toString()
    assert f"< {(1 << 62) * 8_000 // 10**11}" in plan
    assert bounded_sample(df.limit(3), "id", "text", 5, 10) == [("t",)] * 3
    with pytest.raises(ValueError, match="no text"):
        bounded_sample(df.limit(3), "id", "text", 5, 0)
