"""Calendar windows and slicing with known results."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from twinledger.operators import windows as W

COLUMNS = ("id string, relativeWindowTypeEnumId string, relativeWindowCount int, customWindowStartDate timestamp, "
           "customWindowEndDate timestamp, windowTimeZone string, fireTime timestamp")


def resolve(spark, kind, fire, zone=None, count=None, start=None, end=None):
    df = spark.createDataFrame([("a", kind, count, start, end, zone, fire)], COLUMNS)
    return W.resolve_windows(df)


def ends(df):
    row = df.first()
    return row["windowStart"], row["windowEnd"]


def test_previous_day_in_los_angeles(spark):
    df = resolve(spark, "AUT_WIN_PREV_DAY", datetime(2026, 5, 1, 10), "America/Los_Angeles")
    assert ends(df) == (datetime(2026, 4, 30, 7), datetime(2026, 5, 1, 7))


@pytest.mark.parametrize("kind, count, expected", [
    ("AUT_WIN_PREV_WEEK", None, (datetime(2026, 4, 20), datetime(2026, 4, 27))),
    ("AUT_WIN_PREV_MONTH", None, (datetime(2026, 4, 1), datetime(2026, 5, 1))),
    ("AUT_WIN_LAST_DAYS", 3, (datetime(2026, 4, 28), datetime(2026, 5, 1))),
    ("AUT_WIN_LAST_WEEKS", 2, (datetime(2026, 4, 13), datetime(2026, 4, 27))),
    ("AUT_WIN_LAST_MONTHS", 0, (datetime(2026, 4, 1), datetime(2026, 5, 1))),
    (None, None, (datetime(2026, 4, 30), datetime(2026, 5, 1))),
])
def test_relative_windows(spark, kind, count, expected):
    assert ends(resolve(spark, kind, datetime(2026, 5, 1, 10), "Nowhere/Land", count)) == expected


def test_custom_window_splits_by_month(spark):
    df = resolve(spark, "AUT_WIN_CUSTOM", datetime(2026, 5, 1), "UTC", start=datetime(2026, 1, 15), end=datetime(2026, 4, 10))
    rows = W.split_month_windows(df).orderBy("sequenceNum").collect()
    assert [(r["sequenceNum"], r["childWindowStart"], r["childWindowEnd"]) for r in rows] == [
        (1, datetime(2026, 1, 15), datetime(2026, 2, 1)), (2, datetime(2026, 2, 1), datetime(2026, 3, 1)),
        (3, datetime(2026, 3, 1), datetime(2026, 4, 1)), (4, datetime(2026, 4, 1), datetime(2026, 4, 10))]


def test_invalid_windows_carry_their_error(spark):
    same = resolve(spark, "AUT_WIN_CUSTOM", datetime(2026, 5, 1), start=datetime(2026, 1, 1), end=datetime(2026, 1, 1))
    assert same.first()["windowError"] == W.ORDER_ERROR
    assert resolve(spark, "AUT_WIN_CUSTOM", datetime(2026, 5, 1)).first()["windowError"] == W.START_ERROR
    assert W.split_month_windows(same).count() == 0


def test_local_dates_cross_daylight_saving(spark):
    df = spark.sql("SELECT timestamp'2026-03-01 03:04:05' windowStart, timestamp'2026-03-05 01:00:00' windowEnd, "
                   "'America/Chicago' windowTimeZone, '2026-03-01' s, '2026-04-01' e")
    row = W.calendar_window(df, start_date_col="s", end_date_col="e").first()
    assert (row["windowStart"], row["windowEnd"]) == (datetime(2026, 3, 1, 6), datetime(2026, 4, 1, 5))
    kept = W.calendar_window(df).first()
    assert (kept["windowStart"], kept["calendarDateNormalized"]) == (datetime(2026, 3, 1, 3, 4, 5), False)


def events(spark, moments):
    return spark.createDataFrame([(m,) for m in moments], "ts timestamp")


def test_slices_halve_once(spark):
    day = datetime(2026, 1, 1)
    df = events(spark, [day + timedelta(hours=h) for h in (1, 2, 13, 14)])
    found = W.adaptive_slices(df, "ts", day, day + timedelta(days=1), page_size=1, max_pages=2)
    assert (sum(n for *_, n in found.windows), found.page_count, found.window_count, found.split_count) == (4, 6, 3, 1)
    assert found.windows[0][:2] == (day, day + timedelta(hours=12))


def test_slices_fail_at_their_limits(spark):
    day = datetime(2026, 1, 1)
    df = events(spark, [day] * 50)
    narrow = W.adaptive_slices(df, "ts", day, day + timedelta(milliseconds=4), 1, 2)
    assert "minimum split window" in narrow.error
    few = W.adaptive_slices(df, "ts", day, day + timedelta(days=1), 1, 2, max_windows=5)
    assert "split limit (5)" in few.error


def test_deep_slices_keep_every_record(spark):
    day = datetime(2026, 1, 1)
    moments = [day + timedelta(milliseconds=i) for i in range(200)] + [day + timedelta(days=20, hours=i) for i in range(40)]
    found = W.adaptive_slices(events(spark, moments), "ts", day, day + timedelta(days=31), 10, 2)
    assert found.error is None and sum(n for *_, n in found.windows) == 240
    assert all(n <= 20 for *_, n in found.windows)
    assert all(a[1] == b[0] for a, b in zip(found.windows, found.windows[1:]))


def test_window_tagging_of_any_width(spark):
    df = spark.range(300).select(F.col("id").alias("compare_id"), F.timestamp_seconds(1767225600 + F.col("id") * 7200).alias("ts"))
    windows = spark.sql("""SELECT 1 window_id, timestamp'2026-01-02 05:00:00' start, timestamp'2026-01-09 00:00:00' end
        UNION ALL SELECT 2, timestamp'2026-01-05 00:00:00', timestamp'2026-01-05 00:30:00'
        UNION ALL SELECT 3, timestamp'2026-01-05 00:00:00', timestamp'2026-01-20 23:00:00'""")
    tagged = sorted(W.tag_windows(df, "ts", windows).select("window_id", "compare_id").collect())
    plain = windows.join(df, (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")))
    assert tagged == sorted(plain.select("window_id", "compare_id").collect()) and len(tagged) > 200
    assert W.tag_windows(df, "ts", windows.limit(0)).count() == 0


def test_slices_have_no_limit_of_their_own(spark):
    day = datetime(2026, 1, 1)
    moments = [day + timedelta(minutes=i) for i in range(1500)]
    found = W.adaptive_slices(events(spark, moments), "ts", day, day + timedelta(days=2), 1, 1)
    assert found.frame(spark).agg({"recordCount": "sum"}).first()[0] == 1500 and found.window_count > W.MAX_WINDOWS
    ended = W.adaptive_slices(events(spark, moments), "ts", day, day + timedelta(days=2), 1, 1, max_windows=W.MAX_WINDOWS)
    with pytest.raises(ValueError, match="split limit"):
        ended.frame(spark)


def test_zones_of_every_kind(spark):
    names = ["America/Chicago", "+05:30", "GMT+2", "", None, "Mars/Base", "UTC"]
    df = spark.createDataFrame([(n,) for n in names], "z string")
    assert [r[0] for r in df.select(W.zone_or_utc(F.col("z"))).collect()] == [
        "America/Chicago", "+05:30", "GMT+2", "UTC", "UTC", "UTC", "UTC"]


def plain_slices(moments, start, end, capacity):
    """Halving one range after the other."""
    out, waiting = [], [(start, end)]
    while waiting:
        a, b = waiting.pop()
        n = sum(a <= m < b for m in moments)
        if n <= capacity:
            out.append((a, b, n))
        else:
            middle = (a + b) // 2
            waiting += [(a, middle), (middle, b)]
    return sorted(out)


def test_slices_are_those_of_halving(spark, monkeypatch):
    import random

    rng = random.Random(4)
    day, epoch = datetime(1969, 12, 31, 23, 59, 57), datetime(1970, 1, 1)
    at = sorted({rng.randrange(-3000, 9000) // rng.choice([1, 1, 50]) for _ in range(500)})
    df = events(spark, [epoch + timedelta(milliseconds=m, microseconds=rng.randrange(1000)) for m in at])
    millis = lambda t: (t - epoch) // timedelta(milliseconds=1)
    for levels, capacity in ((2, 3), (12, 1)):
        monkeypatch.setattr(W, "LEVELS_PER_PASS", levels)
        found = W.adaptive_slices(df, "ts", day, epoch + timedelta(milliseconds=8777), capacity, 1)
        got = [(millis(a), millis(b), n) for a, b, n in found.windows]
        assert got == plain_slices(at, millis(day), 8777, capacity)
        assert (found.window_count, found.split_count) == (2 * len(got) - 1, len(got) - 1)
        assert found.page_count == found.split_count + sum(max(1, -(-n // capacity)) for *_, n in got)
        assert [r[0] for r in found.rows.orderBy("start").select("sequenceNum").collect()] == list(range(1, len(got) + 1))


def test_a_hundred_thousand_slices(spark):
    day = datetime(2026, 1, 1)
    df = spark.range(100_000).select(F.timestamp_millis(F.lit(1767225600000) + F.col("id") * 25011 + F.pmod(F.xxhash64("id"), F.lit(25000))).alias("ts"))
    found = W.adaptive_slices(df, "ts", day, day + timedelta(days=31), 1, 1)
    told = found.frame(spark).agg(F.count("*"), F.sum("recordCount"), F.max("recordCount"), F.max("sequenceNum"), F.countDistinct("start")).first()
    assert told[0] > 100_000 and tuple(told) == (told[0], 100_000, 1, told[0], told[0])


def test_slices_of_nothing(spark):
    day = datetime(2026, 1, 1)
    found = W.adaptive_slices(events(spark, [day]).limit(0), "ts", day, day + timedelta(days=1), 5)
    assert found.windows == [(day, day + timedelta(days=1), 0)] and found.page_count == 1
    assert W.adaptive_slices(events(spark, [day]), "ts", day, day, 5).error


def test_windows_of_one_side_have_no_data(spark):
    from twinledger.plans.windowed import window_presence, windowed_diffs, windowed_reconcile

    rows = lambda days: spark.createDataFrame([(f"o{d}", datetime(2026, m, d)) for m, d in days], "compare_id string, placed timestamp")
    a, b = rows([(6, 1), (6, 2), (7, 3), (8, 4)]), rows([(6, 2), (8, 4), (8, 5)])  # the second side was down in July
    windows = spark.createDataFrame([(m, datetime(2026, m, 1), datetime(2026, m + 1, 1)) for m in (5, 6, 7, 8)], "window_id int, start timestamp, end timestamp")
    told = {r.window_id: (r.statusEnumId, r.only_in_file1, r.only_in_file2, r.matched) for r in windowed_reconcile(a, b, windows, "placed", "placed").collect()}
    assert told == {5: ("AUT_STAT_NO_DATA", 0, 0, 0), 6: ("AUT_STAT_SUCCESS", 1, 0, 1), 7: ("AUT_STAT_NO_DATA", 0, 0, 0), 8: ("AUT_STAT_SUCCESS", 0, 1, 1)}
    diffs = windowed_diffs(window_presence(a, b, windows, "placed", "placed"))
    assert sorted((r.window_id, r.compare_id) for r in diffs.collect()) == [(6, "o1"), (8, "o5")]


def test_expected_keys_without_records(spark):
    from twinledger.operators.compare import classify_counts

    side = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k string")
    found = classify_counts(side("a", "b", "b"), side("a", "b", "c"), ["k"], expected=side("a", "d", "d"))
    assert {r.k: (r.left_count, r.right_count, r.compare_status) for r in found.collect()} == {
        "a": (1, 1, "MATCHED_COUNT"), "b": (2, 1, "COUNT_MISMATCH"), "c": (0, 1, "MISSING_IN_NS"), "d": (0, 0, "NO_RECORDS")}
