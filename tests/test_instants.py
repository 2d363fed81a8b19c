from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.functions.instants import parse_instants, parser_of, shape_mask, zone_table
from logweave.operators import instants


def one(text, zone="Europe/Madrid", order="dmy", observed=None):
    seen = None if observed is None else (np.array([observed]), np.array([True]))
    us, ok = parse_instants(pd.Series([text]), pd.Series([zone]), pd.Series([order]), seen)
    return int(us[0]) if ok[0] else None


def utc(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2025-09-29T03:01:24Z", utc(2025, 9, 29, 3, 1, 24)),
        ("2025-09-29 02:44:14,651", utc(2025, 9, 29, 0, 44, 14) + 651_000),
        ("2025-09-29T08:25:48+05:30", utc(2025, 9, 29, 2, 55, 48)),
        ("2025/09/29:03:21:51", utc(2025, 9, 29, 1, 21, 51)),
        ("1759125749882", 1759125749882000),
        ("1759125561", 1759125561000000),
        ("1759119187.077661", 1759119187077661),
        ("29/09/2025 05:44:10", utc(2025, 9, 29, 3, 44, 10)),
        ("20250929T032958.103089Z", utc(2025, 9, 29, 3, 29, 58) + 103089),
        ("Mon, 29 Sep 2025 04:11:39 GMT", utc(2025, 9, 29, 4, 11, 39)),
        ("2025-09-29 01:45:09 EDT", utc(2025, 9, 29, 5, 45, 9)),
        ("29/Sep/2025:09:22:32 +0530", utc(2025, 9, 29, 3, 52, 32)),
        ("2025-09-29T09:17:09.583075218+0000", utc(2025, 9, 29, 9, 17, 9) + 583075),
        ("2025-10-02 12:40:09 +05:30", utc(2025, 10, 2, 7, 10, 9)),
        *[(x, None) for x in (None, "", "-", "1970", "not-a-time", "0000-00-00 00:00:00", "2025-02-29T00:00:00Z", "2025-13-01T00:00:00Z", "2025-09-29T24:00:00Z", "x" * 5000, "31/11/2025 00:00:00", "١٢٣٤-09-29T03:01:24Z")],
    ],
)
def test_forms(text, want):
    assert one(text) == want


def test_order_of_digits_and_halves_of_the_day():
    assert one("09/10/2025 02:32:33 PM", order="mdy") == utc(2025, 9, 10, 12, 32, 33)
    assert one("09/10/2025 12:00:00 AM", order="dmy") == utc(2025, 10, 8, 22, 0, 0)
    assert one("09/10/2025 13:00:00 AM") is None
    assert one("09/10/2025 02:32:33", order=None) is None


def test_missing_year_is_that_of_the_other_timestamp():
    assert one("Oct  1 03:33:57", observed=utc(2024, 10, 1)) == utc(2024, 10, 1, 1, 33, 57)
    assert one("Feb 29 03:33:57", observed=utc(2025, 3, 1)) is None
    assert one("Oct  1 03:33:57") is None


def test_local_time_with_two_instants_and_with_none():
    early, late = utc(2025, 10, 26, 0, 30), utc(2025, 10, 26, 1, 30)
    assert one("2025-10-26T02:30:00", observed=late) == late
    assert one("2025-10-26T02:30:00", observed=late - 1) == early
    assert one("2025-10-26T02:30:00") == late
    assert one("2025-03-30T02:30:00") is None  # skipped by the clock
    assert one("2025-10-26T02:30:00", zone=None) is None
    assert one("2025-10-26T02:30:00", zone="No/Where") is None


ZONES = ("Europe/Madrid", "America/New_York", "UTC", "Asia/Kolkata", "America/Sao_Paulo", "Australia/Sydney", "Asia/Tehran", "Africa/Casablanca")


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 4_000_000_000), st.sampled_from(ZONES))
def test_local_times_against_the_zone_database(second, zone):
    at = datetime.fromtimestamp(second, timezone.utc).astimezone(ZoneInfo(zone))
    got = one(at.strftime("%Y-%m-%d %H:%M:%S"), zone=zone, observed=(second + 1) * 1_000_000)
    if got != second * 1_000_000:  # the other instant of an ambiguous time, not after the observation
        other = datetime.fromtimestamp(got // 1_000_000, timezone.utc).astimezone(ZoneInfo(zone))
        assert other.replace(tzinfo=None) == at.replace(tzinfo=None) and got < second * 1_000_000 + 1
        assert abs(other - at) <= timedelta(hours=3)


def test_masks_are_resolved_once_and_zones_have_tables():
    assert shape_mask("Oct  1 03:33:57") == "aaa  9 99:99:99"
    assert parser_of("aaa  9 99:99:99") is parser_of("aaa  9 99:99:99")
    assert parser_of("9999-99/99a99:99:99") is None
    starts, offsets, names = zone_table("America/New_York")
    assert len(starts) == len(offsets) > 100 and names["EDT"] == -4 * 3600


def test_operator_on_dirty_rows(spark):
    schema = "event_id string, timestamp string, observed_timestamp string, service_name string, ts_us string"
    rows = [
        ("a", "2025-09-29 02:44:14,651", "2025-09-29T00:45:00Z", " GATEWAY ", "clash"),
        ("a", "2025-09-29 02:44:14,651", "2025-09-29T00:45:00Z", "gateway", "clash"),
        ("b", "2025-09-29T02:44:14Z", "1759125561", None, None),
        ("c", None, "", "gateway", None),
        (None, "1759125561", None, "gateway", None),
        ("d", "2025-09-29 02:44:14", "2025-09-29T00:45:00Z", "unknown", None),
    ]
    services = spark.createDataFrame([("gateway", "Europe/Madrid", "dmy"), ("Gateway ", "Europe/Madrid", "dmy"), (None, None, None)], "service_name string, time_zone string, date_order string")
    got = {tuple(r) for r in instants.normalised_event_times(spark.createDataFrame(rows, schema), services).collect()}
    assert got == {("a", "timestamp", utc(2025, 9, 29, 0, 44, 14) + 651_000), ("b", "observed_timestamp", 1759125561000000)}
    assert instants.normalised_event_times(spark.createDataFrame([], schema), services).count() == 0


def test_record_times(spark):
    rows = [("raw/gateway/f", 1, "json", "2025-09-29 02:44:14,651"), ("raw/gateway/f", 3, "json", "2025-09-29T02:44:14Z"), ("raw/gateway/f", 5, "text", "2025-09-29 02:44:14"), ("raw/gateway/f", 7, "json", ""), ("gateway", 9, "json", "2025-09-29 02:44:14"), ("raw/gateway/f", 11, "json", "Oct  1 03:33:57"), ("raw/nobody/f", 13, "json", "1759125561")]
    services = spark.createDataFrame([("gateway", "Europe/Madrid", "dmy")], "service_name string, time_zone string, date_order string")
    df = spark.createDataFrame(rows + rows[:1], "source string, record_pos long, parse_format string, ts_text string")
    assert {tuple(r) for r in instants.normalised_record_times(df, services).collect()} == {("raw/gateway/f#1", "time", utc(2025, 9, 29, 0, 44, 14) + 651_000), ("raw/nobody/f#13", "time", 1759125561000000)}
