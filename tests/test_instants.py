import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from loomwork.functions.instants import local_to_utc, notation, utc_micros, wall_micros

UTC = dt.timezone.utc


def us(*a):
    d = dt.datetime(*a, tzinfo=UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)
    return (d.days * 86400 + d.seconds) * 10**6 + d.microseconds


NY = ZoneInfo("America/New_York")
CASES = [
    ("1766365193", "dmy", us(2025, 12, 22, 0, 59, 53)),
    ("1766365193367", "dmy", us(2025, 12, 22, 0, 59, 53, 367000)),
    (" ١٧٦٦٣٦٥١٩٣٣٦٧١٢٣ ", "dmy", us(2025, 12, 22, 0, 59, 53, 367123)),
    ("2025-07-01T10:00:00.123456+0530", "dmy", us(2025, 7, 1, 4, 30, 0, 123456)),
    ("2025-07-01T10:00:00+02:00[Europe/Berlin]", "dmy", us(2025, 7, 1, 8)),
    ("2025-07-01 10:00:00 America/New_York", "dmy", us(2025, 7, 1, 14)),
    ("2025-07-01 10:00:00-08", "dmy", us(2025, 7, 1, 18)),
    ("20250701T100000Z", "dmy", us(2025, 7, 1, 10)),
    ("01.07.2025 10:00", "mdy", us(2025, 7, 1, 8)),
    ("02/07/2025 1:05 PM", "dmy", us(2025, 7, 2, 11, 5)),
    ("02/07/2025 12:05 AM", "mdy", us(2025, 2, 6, 23, 5)),
    ("Wed, 02 Jul 2025 10:00:00 -0300", "dmy", us(2025, 7, 2, 13)),
    ("Jul 2, 2025 10:00 AM CEST", "dmy", us(2025, 7, 2, 8)),
    ("2025-07-01", "dmy", us(2025, 6, 30, 22)),
    ("2025-10-26 02:30", "dmy", us(2025, 10, 26, 0, 30)),  # twice: the earlier
    ("2025-03-30 02:30", "dmy", us(2025, 3, 30, 1, 30)),  # skipped: the offset before
]
UNREADABLE = [None, "", " ", "soon", "-", "0000-00-00", "2025-02-30", "2025-13-01", "31/31/2025", "25/12/2025 x", "2025-07-01 25:00", "Jul 2, 2025 10:00 AM XYZ", "Foo 2, 2025 10:00 AM UTC",
              "2025-07-01 10:00:00 Mars/Base", "123", "12345678901234567890", "02/07/2025 13:05 PM", "x" * 100_000]


def test_cascade(spark):
    data = [(v, o, w) for v, o, w in CASES] + [(v, "dmy", None) for v in UNREADABLE]
    df = spark.createDataFrame(data, "v string, o string, want bigint").withColumn("z", F.lit("Europe/Berlin"))
    got = df.select("v", "want", utc_micros(F.col("v"), F.col("z"), F.col("o")).alias("got")).collect()
    assert [(r.v and r.v[:40], r.got) for r in got] == [(r.v and r.v[:40], r.want) for r in got]


def test_source_without_zone_or_order(spark):
    df = spark.createDataFrame([("2025-07-01 10:00", None, "dmy"), ("02/07/2025", "Europe/Berlin", None), ("2025-07-01T10:00:00Z", None, None), ("2025-07-01 10:00", "Nowhere/X", "dmy")], "v string, z string, o string")
    assert [r[0] for r in df.select(utc_micros(F.col("v"), F.col("z"), F.col("o"))).collect()] == [None, None, us(2025, 7, 1, 10), None]


@pytest.mark.parametrize(("policy", "want"), [("earlier", us(2025, 11, 2, 5, 30)), ("later", us(2025, 11, 2, 6, 30)), ("null", None)])
def test_ambiguous_policy(spark, policy, want):
    local = us(2025, 11, 2, 1, 30)
    assert spark.range(1).select(local_to_utc(F.lit(local), F.lit("America/New_York"), ambiguous=policy)).first()[0] == want


@pytest.mark.parametrize(("policy", "want"), [("before", us(2025, 3, 9, 7, 30)), ("after", us(2025, 3, 9, 6, 30)), ("null", None)])
def test_nonexistent_policy(spark, policy, want):
    local = us(2025, 3, 9, 2, 30)
    assert spark.range(1).select(local_to_utc(F.lit(local), F.lit("America/New_York"), nonexistent=policy)).first()[0] == want


def test_local_times_agree_with_the_zone_database(spark):
    hours = [dt.datetime(2025, 1, 1) + dt.timedelta(hours=7 * i, minutes=i % 60) for i in range(1300)]
    df = spark.createDataFrame([(us(*h.timetuple()[:6]),) for h in hours], "t bigint")
    got = [r[0] for r in df.select(local_to_utc(F.col("t"), F.lit("America/New_York"))).collect()]
    assert got == [int(h.replace(tzinfo=NY).timestamp()) * 10**6 for h in hours]


def test_session_zone_does_not_matter(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        test_cascade(spark)
        ntz = spark.sql("select timestamp_ntz'2025-07-01 10:00:00.000001' t")
        assert ntz.select(wall_micros(F.col("t"))).first()[0] == us(2025, 7, 1, 10, 0, 0, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_notation_names(spark):
    df = spark.createDataFrame([("2025-07-01",), ("1/2/2025",), ("1766365193",), ("soon",), (" ",), (None,)], "v string")
    assert [r[0] for r in df.select(notation(F.col("v"))).collect()] == ["iso", "slashed", "epoch", "unreadable", None, None]
