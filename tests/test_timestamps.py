import datetime as dt
from zoneinfo import ZoneInfo

from hypothesis import given, settings
from hypothesis import strategies as st

from laserloom.functions.timezones import canonical, zone_table
from laserloom.operators.timestamps import flight_log_instants, normalise_timestamps

UTC = dt.timezone.utc


def us(*a, micro=0):
    return int(dt.datetime(*a, tzinfo=UTC).timestamp()) * 10**6 + micro


def gps(instant, leap):
    return instant // 10**6 - 315964800 + leap


CASES = [
    # value, week, zone, order, instant (None: none or several), number of instants
    ("2020-05-25 02:34:00.653", None, "Europe/Zurich", None, us(2020, 5, 25, 0, 34, micro=653000), 1),
    ("2020-05-25 02:34:00,6", None, " europe/zurich ", None, us(2020, 5, 25, 0, 34, micro=600000), 1),
    ("2017-01-07T18:45+00:00", None, None, None, us(2017, 1, 7, 18, 45), 1),
    ("20180415T205228,605+1000", None, None, None, us(2018, 4, 15, 10, 52, 28, micro=605000), 1),
    ("2021-303T23:53:56.715Z", None, None, None, us(2021, 10, 30, 23, 53, 56, micro=715000), 1),
    ("2021-366T00:00:00Z", None, None, None, None, 0),
    ("2020-366T00:00:00Z", None, None, None, us(2020, 12, 31), 1),
    ("Tue, 14 May 2019 20:05:48 +1000", None, None, None, us(2019, 5, 14, 10, 5, 48), 1),
    ("May 3, 2016 6:55:39.7 AM CEST", None, None, None, us(2016, 5, 3, 4, 55, 39, micro=700000), 1),
    ("Oct 9, 2015 12:59:09 AM UTC+05:30", None, None, None, us(2015, 10, 8, 19, 29, 9), 1),
    ("14 Sep 2019 06:30:59.9 JST", None, None, None, us(2019, 9, 13, 21, 30, 59, micro=900000), 1),
    ("2021-03-28T03:44:25+02:00[Europe/Zurich]", None, None, None, us(2021, 3, 28, 1, 44, 25), 1),
    ("2017-11-05T01:23:16.358 −06:00", None, None, None, us(2017, 11, 5, 7, 23, 16, micro=358000), 1),
    ("5.4.2015, 01:54:59.9", None, "UTC", None, us(2015, 4, 5, 1, 54, 59, micro=900000), 1),
    ("\t16.04.2016 05:44:41\xa0", None, "Asia/Tokyo", None, us(2016, 4, 15, 20, 44, 41), 1),
    ("31/03/2019 02:16:59", None, "Asia/Tokyo", None, us(2019, 3, 30, 17, 16, 59), 1),  # only one order is possible
    ("05/06/2020 10:00:00", None, "UTC", None, None, 2),
    ("05/05/2020 10:00:00", None, "UTC", None, us(2020, 5, 5, 10), 1),
    ("05/06/2020 10:00:00", None, "UTC", "dmy", us(2020, 6, 5, 10), 1),
    ("05/06/2020 4:11:14 PM", None, "UTC", "mdy", us(2020, 5, 6, 16, 11, 14), 1),
    ("05/06/2020 13:11:14 PM", None, "UTC", "mdy", None, 0),
    ("2021-03-28 02:30:00", None, "Europe/Zurich", None, None, 0),  # skipped
    ("2021-10-31 02:30:00", None, "Europe/Zurich", None, None, 2),  # twice
    ("2021-10-31 02:30:00+02:00", None, "Europe/Zurich", None, us(2021, 10, 31, 0, 30), 1),
    ("2021-06-01 12:00:00", None, None, None, None, 0),
    ("2021-06-01 12:00:00", None, "Mars/Base", None, None, 0),
    ("2015-02-30 21:48:08", None, "UTC", None, None, 0),
    ("2023-03-01 25:01:61Z", None, None, None, None, 0),
    ("2023-03-01", None, "UTC", None, None, 0),
    ("19:59:47", None, "UTC", None, None, 0),
    ("#REF!", None, "UTC", None, None, 0),
    ("", None, "UTC", None, None, 0),
    (None, None, "UTC", None, None, 0),
    ("9" * 400, None, "UTC", None, None, 0),
    (str(gps(us(2019, 7, 1), 18)), None, None, None, us(2019, 7, 1), 1),
    (str(gps(us(2016, 7, 1), 17)), None, None, None, us(2016, 7, 1), 1),
    (f"{gps(us(2015, 3, 1), 16) - 10**9}.250000", None, None, None, us(2015, 3, 1, micro=250000), 1),
    ("1253164394", None, None, None, (1253164394 + 315964800 - 18) * 10**6, 1),
    ("1600000000", None, None, None, 1600000000 * 10**6, 1),
    ("1489298570034", None, None, None, 1489298570034000, 1),
    ("1614648119253549", None, None, None, 1614648119253549, 1),
    ("267992.5", 2100, None, None, (315964800 + 2100 * 604800 + 267992 - 18) * 10**6 + 500000, 1),
    ("267992.5", None, None, None, None, 0),
    ("12345678901234567890", None, None, None, None, 0),
]


def test_cases(spark):
    rows = [(i, *c[:4], "kept") for i, c in enumerate(CASES)]
    d = spark.createDataFrame(rows, "id int, v string, w int, z string, o string, utc_us string")  # the last name clashes
    got = {r.id: r for r in normalise_timestamps(d, "v", week="w", zone="z", order="o").collect()}
    bad = [(CASES[i], got[i].utc_us, got[i].utc_us_instants) for i in got if (got[i].utc_us, got[i].utc_us_instants) != CASES[i][4:]]
    assert not bad


def test_result_does_not_hang_on_batches(spark):
    rows = [(i, *CASES[i % len(CASES)][:4]) for i in range(3 * len(CASES))]
    d = spark.createDataFrame(rows, "id int, v string, w int, z string, o string").repartition(7)
    got = normalise_timestamps(d, "v", week="w", zone="z", order="o").collect()
    assert all(r.utc_us == CASES[r.id % len(CASES)][4] for r in got)


def test_empty_and_duplicates(spark):
    log = spark.createDataFrame([(1, 1, "2020-01-01T00:00:00Z", None), (1, 1, "2020-01-01T00:00:00Z", None), (2, 9, "2020-01-01 00:00:00", None), (None, 1, "2020-01-01T00:00:00Z", None)], "log_id long, recorder_id int, gps_time string, gps_week int")
    rec = spark.createDataFrame([(1, "UTC", None), (1, "UTC", None)], "recorder_id int, zone string, date_order string")
    assert [tuple(r) for r in flight_log_instants(log, rec).collect()] == [(1, us(2020, 1, 1))]
    assert flight_log_instants(log.limit(0), rec).count() == 0
    assert flight_log_instants(log, rec.limit(0)).count() == 1


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["Europe/Zurich", "America/New_York", "Australia/Hobart", "Asia/Kathmandu", "Europe/Lisbon"]), st.integers(us(2015, 1, 1), us(2023, 12, 31)))
def test_zone_tables_agree_with_the_zone_database(zone, instant):
    import numpy as np

    t = zone_table(zone)
    want = dt.datetime.fromtimestamp(instant / 1e6, ZoneInfo(zone)).utcoffset().total_seconds()
    assert t.offset_at(np.array([instant]))[0] == want
    first, second, n = t.to_utc(np.array([instant + int(want) * 10**6]))
    assert n[0] in (1, 2) and instant in ([first[0]] if n[0] == 1 else [first[0], second[0]])


def test_zone_names():
    assert canonical("america/new york") == "America/New_York" and canonical("nowhere") is None and canonical(None) is None
    assert zone_table("UTC").version


def test_found_on_data(spark, small):
    from laserloom.plans.queries import QUERIES

    got = QUERIES["p4_found"](spark, small)
    assert got.columns == ["log_id", "utc_us"] and got.count() == got.select("log_id").distinct().count() > 0
