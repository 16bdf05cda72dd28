from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quillmesh.functions.timestamps import parse_instant
from quillmesh.operators.timestamps import RAW, extend_dictionary, normalise_published, stored_dictionary

CASES = [
    ("2025-01-01T13:13:25Z", None, None, "2025-01-01T13:13:25+00:00"),
    ("2025-01-13t12:00:02z", "Europe/Paris", "feed_iso", "2025-01-13T12:00:02+00:00"),
    ("2025-01-10T18:34:58+0900", "UTC", "feed_iso", "2025-01-10T09:34:58+00:00"),
    ("2025-01-04T23:42:06.874067Z", None, "feed_iso", "2025-01-04T23:42:06.874067+00:00"),
    ("2025-02-09T23:28:18.9Z", None, None, "2025-02-09T23:28:18.900000+00:00"),
    ("20250107T233539+0000", None, None, "2025-01-07T23:35:39+00:00"),
    ("20250103060817", None, "gdelt_seendate", "2025-01-03T06:08:17+00:00"),
    ("20250103060817", None, None, None),
    ("1735906168", None, "api_epoch", "2025-01-03T12:09:28+00:00"),
    ("1735906168162", None, "api_epoch", "2025-01-03T12:09:28.162000+00:00"),
    ("1735890951900000", None, "api_epoch", "2025-01-03T07:55:51.900000+00:00"),
    ("1735906168", None, "feed_iso", None),
    ("Fri, 01 Aug 2025 17:33:56 +0200", None, "rss_pubdate", "2025-08-01T15:33:56+00:00"),
    ("Fri, 2 Jan 2026 13:34:36 CET", "America/New_York", "rss_pubdate", "2026-01-02T12:34:36+00:00"),
    ("April 18, 2026 at 8:33 PM PT", None, "page_text", "2026-04-19T03:33:00+00:00"),
    ("Apr 10, 2026 12:05 a.m. ET", "unknown", "page_text", "2026-04-10T04:05:00+00:00"),
    ("2025年3月12日 5時42分", "Asia/Tokyo", "page_text", "2025-03-11T20:42:00+00:00"),
    ("01/02/2025 05:08 AM", "Europe/London", "page_text_us", "2025-01-02T05:08:00+00:00"),
    ("01-06-2026 08:09", "America/New_York", "page_text_eu", "2026-06-01T12:09:00+00:00"),
    ("01/02/2025 05:08", "Europe/London", "page_meta", None),
    ("2025-01-06T14:32", "local", "page_meta", None),
    ("2025-01-06T14:32", " gmt+5:30 ", "page_meta", "2025-01-06T09:02:00+00:00"),
    ("2025-01-08", "Europe/Paris", "page_date", None),
    ("2025-03-09 02:30:00", "America/New_York", "page_meta", None),
    ("2025-11-02 01:30:00", "America/New_York", "page_meta", None),
    ("2025-11-02 01:30:00", "EST", "page_meta", "2025-11-02T06:30:00+00:00"),
    ("2025-13-40T99:00:00Z", None, None, None),
    ("", "UTC", None, None),
    (None, "UTC", None, None),
]


@pytest.mark.parametrize("raw, zone, source, expected", CASES)
def test_parse(raw, zone, source, expected):
    want = None
    if expected:
        gap = datetime.fromisoformat(expected) - datetime(1970, 1, 1, tzinfo=timezone.utc)
        want = (gap.days * 86400 + gap.seconds) * 1_000_000 + gap.microseconds
    assert parse_instant(raw, zone, source) == want


def _rows(spark, rows):
    return spark.createDataFrame(rows, "article_id string, published_at string, published_timezone string, published_at_source string, rows int")


def test_one_row_per_article(spark):
    rows = [("a", "2025-01-01T00:00:00Z", None, None, 1), ("a", "2025-01-01T01:00:00+01:00", "UTC", "feed_iso", 1), ("b", "2025-01-01", None, None, 1),
            (None, "2025-01-01T00:00:00Z", None, None, 1), ("c", None, None, None, 1), ("d", " ", "UTC", "", 1)]
    got = {tuple(r) for r in normalise_published(_rows(spark, rows)).collect()}
    assert got == {("a", 1735689600000000)}


def test_hot_value_and_empty_table(spark):
    rows = [(f"a{i}", "2025-01-01T00:00:00Z", "", None, 1) for i in range(300)] + [("z", "2025-01-01T00:00:01Z", None, "x", 1)]
    got = normalise_published(_rows(spark, rows)).collect()
    assert len(got) == 301 and {r["published_us"] for r in got} == {1735689600000000, 1735689601000000}
    assert normalise_published(_rows(spark, [])).count() == 0


def test_incremental_dictionary(spark, tmp_path, monkeypatch):
    """A second batch adds its own values, a rerun adds none, and what is stored is not parsed again."""
    folder = str(tmp_path / "d")
    first = _rows(spark, [("a", "2025-01-01T00:00:00Z", None, None, 1), ("c", "2025-01-05", None, None, 1)])
    second = _rows(spark, [("b", "2025-01-02T00:00:00Z", None, None, 1), ("b2", "2025-01-02T00:00:00Z", None, None, 1), ("a2", "2025-01-01T00:00:00Z", "", None, 1)])
    instants = lambda rows: {tuple(r) for r in normalise_published(rows, store=folder).collect()}
    assert instants(first) == {("a", 1735689600000000)}
    for _ in range(2):
        assert instants(second) == {("b", 1735776000000000), ("b2", 1735776000000000), ("a2", 1735689600000000)}
    held = [(r["published_at"], r["published_us"]) for r in spark.read.parquet(folder).collect()]
    assert sorted(held, key=str) == [("2025-01-01T00:00:00Z", 1735689600000000), ("2025-01-02T00:00:00Z", 1735776000000000), ("2025-01-05", None)]
    known = stored_dictionary(spark, folder).withColumn("published_us", F.lit(7).cast("long"))
    assert {r["published_us"] for r in extend_dictionary(first.select("article_id", *RAW), known).collect()} == {7}
