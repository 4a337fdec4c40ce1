import datetime as dt
import random
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.operators.timestamps import normal_forms, timestamp_cases
from orderloom.operators.zones import zone_table

ZONES = ["America/New_York", "Europe/Berlin", "Australia/Sydney", "Asia/Kolkata", "Europe/London"]
TABLE = zone_table(ZONES)


def read(spark, rows, instants):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, time_zone string, date_order string")
    return [r[0] for r in normal_forms(df, "v", TABLE, instants).orderBy("i").select("normal_form").collect()]


@pytest.mark.parametrize("zone", ZONES)
def test_local_times_against_zoneinfo(zone):
    rng = random.Random(zone)
    local = [int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()) + rng.randrange(3 * 366 * 86400) for _ in range(3000)]
    for year in (2024, 2025, 2026):  # every five minutes of the days around the changes
        for month, day in ((3, 10), (3, 31), (3, 30), (3, 29), (10, 27), (10, 26), (10, 25), (11, 3), (11, 2), (11, 1), (4, 7), (4, 6), (4, 5), (10, 6), (10, 5), (10, 4), (3, 9), (3, 8)):
            start = int(dt.datetime(year, month, day, tzinfo=dt.timezone.utc).timestamp())
            local += range(start, start + 86400, 300)
    found = TABLE.to_utc(np.array(local), zone)
    for x, y in zip(local, found, strict=True):
        naive = dt.datetime.fromtimestamp(x, dt.timezone.utc).replace(tzinfo=ZoneInfo(zone), fold=0)
        assert int(naive.timestamp()) == y


def test_instants(spark):
    b, n, s = ("Europe/Berlin", "DMY"), ("America/New_York", "MDY"), ("Australia/Sydney", "DMY")
    cases = [
        (("2025-12-06T18:55:59Z", *b), "2025-12-06T18:55:59Z"), (("1776619509", *b), "2026-04-19T17:25:09Z"), (("1785429844194", *b), "2026-07-30T16:44:04Z"),
        (("Sun, 14 Sep 2025 20:49:53 +0200", *n), "2025-09-14T18:49:53Z"), (("2026-03-20T01:37:49+05:30", *b), "2026-03-19T20:07:49Z"), (("2024-04-02 22:21", *b), "2024-04-02T20:21:00Z"),
        (("19/04/2026 21:48", *b), "2026-04-19T19:48:00Z"), (("01/02/2026 02:36", *n), "2026-01-02T07:36:00Z"), (("01/02/2026 02:36", *b), "2026-02-01T01:36:00Z"),
        (("20241115T043554Z", *b), "2024-11-15T04:35:54Z"), (("2025-11-10T10:52:15.077979+01:00", *n), "2025-11-10T09:52:15Z"), (("Wed, 14 Aug 2024 20:56:40 IST", *b), "2024-08-14T15:26:40Z"),
        (("2024-10-22 17:46:27 +05:45", *b), "2024-10-22T12:01:27Z"), (("2025-06-28T19:51:57+02:00[Europe/Berlin]", *n), "2025-06-28T17:51:57Z"), (("Tue Dec 30 23:50:39 CET 2025", *n), "2025-12-30T22:50:39Z"),
        (("9/10/2024 1:37 PM", *n), "2024-09-10T17:37:00Z"), (("6/9/2026 12:01 AM", *n), "2026-06-09T04:01:00Z"), (("04-Jan-2026 03:22:09.816 GMT+1", *n), "2026-01-04T02:22:09Z"),
        (("07-Jul-2025 23:39:15.650 GMT+5:30", *n), "2025-07-07T18:09:15Z"), (("17.10.2025, 07:17 Uhr", *b), "2025-10-17T05:17:00Z"), (("November 10, 2025 1:16 pm", *n), "2025-11-10T18:16:00Z"),
        (("19 October 2024 at 3:02 AM", *s), "2024-10-18T16:02:00Z"), (("17. März 2024 14:59 Uhr", *b), "2024-03-17T13:59:00Z"), (("26 de julio de 2026, 06:27", *b), "2026-07-26T04:27:00Z"),
        (("26 lipca 2024 07:52", *b), "2024-07-26T05:52:00Z"), (("2025-10-26 02:30", *b), "2025-10-26T00:30:00Z"), (("2025-03-30 02:30", *b), "2025-03-30T01:30:00Z"),
        (("unknown", *b), None), (("", *b), None), (("0000-00-00 00:00:00", *b), None), (("2025-02-30 10:00", *b), None), (("2025-01-01 25:00", *b), None), ((None, *b), None),
        (("2025-01-01 10:00", None, "DMY"), None), (("2025-01-01 10:00", "No/Where", "DMY"), None), (("01/02/2025 10:00", "Europe/Berlin", None), None), (("9" * 500_000, *b), None),
    ]
    assert read(spark, [c[0] for c in cases], True) == [c[1] for c in cases]


def test_days(spark):
    d, m = (None, "DMY"), (None, "MDY")
    cases = [
        (("2024-07-07", *d), "2024-07-07"), (("10/28/2026", *d), "2026-10-28"), (("02-05-2026", *d), "2026-05-02"), (("02-05-2026", *m), "2026-02-05"), (("28 Jul 2026", *d), "2026-07-28"),
        (("27-Aug-25", *d), "2025-08-27"), (("20240309", *d), "2024-03-09"), (("17/12/25", *m), "2025-12-17"), (("2025-W32-4", *d), "2025-08-07"), (("46290", *d), "2026-09-25"), (("24.5.26", *d), "2026-05-24"),
        (("2024/03/29", *d), "2024-03-29"), (("2025.12.21", *d), "2025-12-21"), (("2026-05-01T23:30:00", *d), "2026-05-01"), (("2025-01-01T23:30:00+11:00", *d), "2025-01-01"), (("Sun, 17 Nov 2024", *d), "2024-11-17"),
        (("11th January 2024", *d), "2024-01-11"), (("February 24th, 2026", *d), "2026-02-24"), (("10 sierpnia 2025 r.", *d), "2025-08-10"), (("15 de julio de 2025", *d), "2025-07-15"), (("31. März 2026", *d), "2026-03-31"),
        (("31/02/2025", *d), None), (("TBD", *d), None), (("2025-W54-1", *d), None), (("29.02.2023", *d), None), (("-", *d), None), (("12345", *d), None),
    ]
    assert read(spark, [c[0] for c in cases], False) == [c[1] for c in cases]


def test_weeks_against_calendar(spark):
    days = [dt.date(2019, 12, 25) + dt.timedelta(days=k) for k in range(0, 3000, 13)]
    texts = ["{}-W{:02}-{}".format(*x.isocalendar()) for x in days]
    assert read(spark, [(t, None, None) for t in texts], False) == [x.isoformat() for x in days]


def test_cases_with_missing_and_clashing_columns(spark):
    mails = spark.createDataFrame([("m", "p", "2025-01-01 10:00"), ("n", None, "2025-01-01 10:00"), ("o", "p", None)], "id string, provider string, received_at string")
    orders = spark.createDataFrame([("a", "m", "01/02/2025", None), ("b", None, "1 Mar 2025", "2025-01-01"), ("c", "x", "03/04/2025", "nope")], "id string, email_id string, order_date string, requested_delivery_date string")
    sources = spark.createDataFrame([("p", "Europe/Berlin", "DMY"), ("p", "Europe/Berlin", "DMY"), (None, "x", "y")], "provider string, time_zone string, date_order string")
    extra = {c: F.lit(1) for c in ("normal_form", "value", "field", "time_zone", "date_order")}
    found = sorted(tuple(r) for r in timestamp_cases(mails.withColumns(extra), orders.withColumns(extra), sources).collect())
    assert found == [("a", "order_date", "2025-02-01"), ("b", "order_date", "2025-03-01"), ("m", "received_at", "2025-01-01T09:00:00Z")]
    assert timestamp_cases(mails.limit(0), orders.limit(0), sources.limit(0)).count() == 0


def test_weekdays_of_all_languages(spark):
    days = ["lun. 3 mars 2025", "Montag, 3. März 2025", "mar. 4 mars 2025", "poniedziałek, 3 marca 2025", "lunedì 3 marzo 2025", "lunes, 3 de marzo de 2025", "segunda-feira, 3 de março de 2025", "maandag 3 maart 2025", "Mo., 03. Mär 2025"]
    assert read(spark, [(d, None, "DMY") for d in days], False) == ["2025-03-04" if d.startswith("mar") else "2025-03-03" for d in days]


def test_long_values(spark):
    wide = f"2025-03-03{' ' * 500}10:00:00 +0100"
    cases = [(wide, None, None), ("9" * 200_000, None, None), ("1 a " * 50_000, None, None), ("Wednesday, 12 September 2025 10:00:00.123456789 +02:00 [" + "America/Argentina/ComodRivadavia" * 2 + "]", None, None)]
    assert read(spark, cases, True)[:3] == ["2025-03-03T09:00:00Z", None, None]
