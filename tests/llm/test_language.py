import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm.language import LANGUAGES, WINDOW, ByteConv, decide, encode_windows, fit_network, html_content_lines, identify, label_language
from tests.conftest import rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{SF}/greenhouse_jobs.parquet").select("ingest_id", "content", "language")


@pytest.fixture(scope="module")
def net(labelled):
    return fit_network(labelled, "ingest_id", "content", "language")


def test_windows_cover_every_byte():
    for n in (0, 1, WINDOW, WINDOW + 1, 1000):
        raw = bytes(97 + i % 26 for i in range(n)).decode()
        x, owner = encode_windows([raw, "z"])
        mine = x[owner == 0]
        assert len(mine) == max(1, -(-n // WINDOW)) and (owner == 1).sum() == 1
        assert bytes(mine[-1]).rstrip(b"\0").decode() == (raw[-WINDOW:] or " ")


def test_tables_give_the_network_s_answers():
    net = ByteConv.fresh()
    x = np.random.default_rng(0).integers(0, 256, (5, WINDOW), dtype=np.uint8)
    feats = []
    for w, bank in net.banks.items():
        e = net.emb[x]
        full = sum(e[:, j : j + WINDOW - w + 1] @ bank[j] for j in range(w))
        feats.append(np.maximum(full.max(1) + net.bias[w], 0))
    assert np.allclose(net.tables().logits(x), np.concatenate(feats, 1) @ net.out + net.out_bias, atol=1e-4)


def test_training_is_repeatable_and_lowers_the_loss():
    x, owner = encode_windows(["the cat and the dog"] * 20 + ["der hund und die katze"] * 20)
    y = np.array([0] * 20 + [1] * 20)[owner]
    a, b = ByteConv.fresh(), ByteConv.fresh()
    a.fit(x, y, steps=60)
    b.fit(x, y, steps=60)
    assert np.array_equal(a.out, b.out) and (a.tables().logits(x).argmax(1) == y).all()


def test_held_out_accuracy(spark, labelled, net):
    other = spark.read.parquet("/root/testdata/sf0.001/greenhouse_jobs.parquet").select("content", label_language(F.col("language")).alias("l")).filter("l is not null and content is not null").collect()
    tables = net.tables()
    hit = sum(LANGUAGES[decide(*tables.line_scores(html_content_lines(r["content"])))[0][1]] == r["l"] for r in other if html_content_lines(r["content"]))
    assert hit >= 0.85 * len(other)  # about a tenth of the labels are wrong


def test_segments(spark, net):
    en = "You will work with the team and plan the schedules for all of our customers in the region."
    de = "Sie arbeiten mit dem Team zusammen und planen die Termine für alle unsere Kunden in der Region."
    data = [(1, en + "\n" + en, False, None), (2, f"{en}\r\n \n{de}\n{en}", False, None), (3, None, False, None), (4, " \n", False, "x"), (5, f"&lt;p&gt;{de}&lt;/p&gt;", True, "de"), (6, (en + " ") * 3000, False, None), (1, en, False, None)]
    df = spark.createDataFrame(data, "ingest_id int, content string, is_html boolean, label string").withColumn("lang", F.lit("clash"))
    got = [(r["ingest_id"], r["seg"], r["lang"]) for r in identify(df, net).collect()]
    assert got == [(1, 0, "en"), (2, 0, "en"), (2, 1, "en"), (2, 2, "de"), (2, 3, "en"), (5, 0, "de"), (6, 0, "en"), (1, 0, "en")]
    assert all(0 < r["confidence"] <= 1 for r in identify(df, net).collect())
    assert rows(identify(df.limit(0), net)) == []


def test_labels(spark):
    data = [("en-GB", "en"), ("Français", "fr"), ("العربية", "ar"), ("pt_BR", "pt"), (" DEU ", "de"), ("und", None), ("--", None), ("", None), (None, None)]
    df = spark.createDataFrame(data, "l string, want string")
    assert [r[0] for r in df.select(label_language(F.col("l"))).collect()] == [w for _, w in data]


def test_no_labelled_rows(labelled):
    assert fit_network(labelled.limit(0), "ingest_id", "content", "language").emb.shape == (256, 8)
