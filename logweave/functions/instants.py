"""Timestamps of any form to one instant.

A text is tokenised into its *shape mask* (digits become ``9``, letters ``a``,
the rest stays).  Each distinct mask is mapped to a parser once per worker;
the parser converts all texts of that mask together with numpy, since equal
masks mean equal positions.  Local times go through a transition table of the
zone, built once per worker from the zone database whose version
:func:`zone_version` names.
"""

from __future__ import annotations

import datetime as _dt
import re
from functools import lru_cache
from zoneinfo import TZPATH, ZoneInfo

import numpy as np
import pandas as pd

# Zone abbreviations and their offsets in minutes, used only where the zone of the
# service does not have that abbreviation itself.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660,
    "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480,
    "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "BRT": -180, "BRST": -120, "ART": -180,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

#: No timestamp form is longer; longer texts are unreadable.
MAX_CHARS = 48
#: Instants outside these years are unreadable (also the range of the transition tables).
YEARS = (1900, 2100)

#: The one form that needs no normalisation.
CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z$"

_TABLE = {i: "9" if chr(i).isdigit() else "a" if chr(i).isalpha() else chr(i) for i in range(128)}


def shape_mask(text: str) -> str:
    """Character classes of a text: ``2025-10-03T1Z`` is ``9999-99-99a9a``."""
    return text.translate(_TABLE)


_CLOCK = r"(?P<h>99):(?P<mi>99)(?::(?P<s>99))?(?:[.,](?P<f>9{1,12}))?"
_ZONE = r"(?:(?P<sp> ?)(?P<z>[+-]99:?99|[+-]99|a{1,5}))?"
_FORMS = [re.compile(f"^{p}$") for p in (
    rf"(?P<y>9999)(?P<d1>[-/.])(?P<mo>99)(?P<d2>[-/.])(?P<d>99)(?P<sep>[a :]){_CLOCK}{_ZONE}",
    rf"(?P<y>9999)(?P<mo>99)(?P<d>99)(?P<sep>a)(?P<h>99)(?P<mi>99)(?P<s>99)(?:[.,](?P<f>9{{1,12}}))?{_ZONE}",
    rf"(?P<n1>99)(?P<d1>[-/.])(?P<n2>99)(?P<d2>[-/.])(?P<y>9999)[ :]{_CLOCK}(?: (?P<ap>aa)(?![a]))?{_ZONE}",
    rf"(?P<d>99?)(?P<d1>[-/ ])(?P<mon>aaa)(?P<d2>[-/ ])(?P<y>9999)[ :]{_CLOCK}{_ZONE}",
    rf"aaa, (?P<d>99?) (?P<mon>aaa) (?P<y>9999) {_CLOCK}{_ZONE}",
    rf"(?:aaa )?(?P<mon>aaa) (?P<d>99| 9|9) {_CLOCK}(?: (?P<y>9999))?",
    r"(?P<epoch>9{10})(?:[.](?P<f>9{1,12}))?",
    r"(?P<epoch3>9{13})",
    r"(?P<epoch6>9{16})",
    r"(?P<epoch9>9{19})",
)]


@lru_cache(maxsize=65536)
def parser_of(mask: str):
    """The field positions of a mask, or None if no timestamp form has it."""
    if not mask or len(mask) > MAX_CHARS:
        return None
    for form in _FORMS:
        m = form.match(mask)
        if m:
            g = {k: m.span(k) for k, v in m.groupdict().items() if v}
            if "d1" in g and mask[g["d1"][0]] != mask[g["d2"][0]]:
                return None
            return g
    return None


@lru_cache(maxsize=1)
def zone_version() -> str:
    """Version of the zone database that the transition tables come from."""
    for folder in TZPATH:
        try:
            with open(f"{folder}/tzdata.zi") as f:
                return f.readline().split()[-1]
        except OSError:
            continue
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@lru_cache(maxsize=1024)
def zone_table(name: str):
    """(transition instants, offset from each on, abbreviation -> offset) of a zone in seconds, or None for an unknown zone."""
    try:
        zone = ZoneInfo(name)
    except Exception:  # unknown or malformed name
        return None
    utc = _dt.timezone.utc
    at = lambda s: _dt.datetime.fromtimestamp(s, utc).astimezone(zone)
    first = int(_dt.datetime(YEARS[0], 1, 1, tzinfo=utc).timestamp())
    last = int(_dt.datetime(YEARS[1], 1, 1, tzinfo=utc).timestamp())
    offset = lambda s: int(at(s).utcoffset().total_seconds())
    starts, offsets, names, step = [first - 10**9], [offset(first)], {}, 7 * 86400
    now, have = first, offset(first)
    while now < last:
        then = min(now + step, last)
        got = offset(then)
        if got != have:
            lo, hi = now, then
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if offset(mid) == have else (lo, mid)
            starts.append(hi)
            offsets.append(offset(hi))
            have = offset(hi)
            now = hi
            continue
        now = then
    for s in starts[1:] or [first]:
        for x in (s, s - 1):
            names[at(x).tzname().upper()] = offset(x)
    names.setdefault(at(last).tzname().upper(), have)
    return np.array(starts, dtype=np.int64), np.array(offsets, dtype=np.int64), names


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of proleptic Gregorian dates."""
    a = y - (m <= 2)
    era = a // 400
    yoe = a - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


_MONTH_DAYS = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
_MONTH_CODES = {int.from_bytes(m.encode(), "big"): i + 1 for i, m in enumerate(MONTHS)}


def _number(block: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    v = np.zeros(len(block), dtype=np.int64)
    for i in range(*span):
        c = block[:, i].astype(np.int64) - 48
        v = v * 10 + np.where(c < 0, 0, c)  # a blank in front of a one-digit day
    return v


def _letters(block: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    """Upper-case texts of a column span."""
    return np.char.upper(np.ascontiguousarray(block[:, span[0] : span[1]]).view(f"S{span[1] - span[0]}").ravel())


def _lookup(table, seconds: np.ndarray) -> np.ndarray:
    return table[1][np.searchsorted(table[0], seconds, side="right") - 1]


def _from_local(wall: np.ndarray, ok: np.ndarray, zones: np.ndarray, before: np.ndarray, has_before: np.ndarray, us: np.ndarray):
    """UTC seconds of local times. Of two instants the later one not after ``before``; a time skipped by the clock is none."""
    out = np.zeros(len(wall), dtype=np.int64)
    good = np.zeros(len(wall), dtype=bool)
    codes, names = pd.factorize(zones, use_na_sentinel=True)
    for k, name in enumerate(names):
        table = zone_table(name) if name else None
        if table is None:
            continue
        at = np.flatnonzero((codes == k) & ok)
        w = wall[at]
        a, b = w - _lookup(table, w - 86400), w - _lookup(table, w + 86400)
        a_ok, b_ok = a + _lookup(table, a) == w, b + _lookup(table, b) == w
        early, late = np.minimum(np.where(a_ok, a, b), np.where(b_ok, b, a)), np.maximum(np.where(a_ok, a, b), np.where(b_ok, b, a))
        late_ok = ~has_before[at] | (late * 1_000_000 + us[at] <= before[at])
        out[at], good[at] = np.where(late_ok, late, early), a_ok | b_ok
    return out, good


def parse_instants(
    texts: pd.Series,
    zones: pd.Series | None = None,
    orders: pd.Series | None = None,
    observed: tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """(microseconds since 1970 UTC, readable) of timestamp texts.

    zones: IANA zone of texts without zone (none: such texts are unreadable);
    orders: ``dmy`` or ``mdy`` for all-digit dates that do not begin with the
    year; observed: the result for another timestamp of the same row, which
    gives a missing year and decides between two instants of one local time.
    Null, empty and unreadable texts, dates that do not exist and local times
    skipped by the clock are not readable.
    """
    n = len(texts)
    out, good = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    zones_a = zones.to_numpy(dtype=object) if zones is not None else np.full(n, None, dtype=object)
    orders_a = orders.to_numpy(dtype=object) if orders is not None else np.full(n, None, dtype=object)
    obs, obs_ok = observed if observed is not None else (np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool))
    clean = [t.strip() if isinstance(t, str) else "" for t in texts.tolist()]
    masks = [shape_mask(t) if len(t) <= MAX_CHARS and t.isascii() else "" for t in clean]
    codes, names = pd.factorize(np.array(masks, dtype=object))
    order = np.argsort(codes, kind="stable")
    cuts = np.searchsorted(codes[order], np.arange(len(names) + 1))
    for k, mask in enumerate(names):
        g = parser_of(mask)
        if g is None:
            continue
        at = order[cuts[k] : cuts[k + 1]]
        block = np.array([clean[i] for i in at], dtype=f"S{len(mask)}").view(np.uint8).reshape(len(at), len(mask))
        us = np.zeros(len(at), dtype=np.int64)
        if "f" in g:
            a, b = g["f"]
            us = _number(block, (a, min(b, a + 6))) * 10 ** max(0, 6 - (b - a))
        epoch = next((x for x in ("epoch", "epoch3", "epoch6", "epoch9") if x in g), None)
        if epoch:
            v = _number(block, g[epoch])
            v = {"epoch": v * 1_000_000 + us, "epoch3": v * 1000, "epoch6": v, "epoch9": v // 1000}[epoch]
            out[at], good[at] = v, v // 1_000_000 < 4_102_444_800
            continue
        ok = np.ones(len(at), dtype=bool)
        if "y" in g:
            y = _number(block, g["y"])
        else:  # the year of the other timestamp
            ok &= obs_ok[at]
            y = np.where(ok, obs[at], 0).astype("datetime64[us]").astype("datetime64[Y]").astype(np.int64) + 1970
        if "n1" in g:
            n1, n2 = _number(block, g["n1"]), _number(block, g["n2"])
            how = orders_a[at]
            mdy = how == "mdy"
            ok &= mdy | (how == "dmy")
            d, mo = np.where(mdy, n2, n1), np.where(mdy, n1, n2)
        else:
            d = _number(block, g["d"])
            if "mon" in g:
                a = g["mon"][0]
                c = block[:, a : a + 3].astype(np.int64) | 32
                code = (c[:, 0] << 16) | (c[:, 1] << 8) | c[:, 2]
                mo = np.zeros(len(at), dtype=np.int64)
                for key, num in _MONTH_CODES.items():
                    mo[code == key] = num
            else:
                mo = _number(block, g["mo"])
        h, mi = _number(block, g["h"]), _number(block, g["mi"])
        s = _number(block, g["s"]) if "s" in g else np.zeros(len(at), dtype=np.int64)
        if "ap" in g:
            ap = _letters(block, g["ap"])
            ok &= ((ap == b"AM") | (ap == b"PM")) & (h >= 1) & (h <= 12)
            h = h % 12 + np.where(ap == b"PM", 12, 0)
        if "sep" in g and mask[g["sep"][0]] == "a":
            ok &= (block[:, g["sep"][0]] | 32) == ord("t")
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        ok &= (mo >= 1) & (mo <= 12) & (y >= YEARS[0]) & (y < YEARS[1]) & (h < 24) & (mi < 60) & (s < 60)
        mo_ = np.where(ok, mo, 1)
        ok &= (d >= 1) & (d <= _MONTH_DAYS[mo_] + (leap & (mo_ == 2)))
        wall = _days(np.where(ok, y, 1970), mo_, np.where(ok, d, 1)) * 86400 + h * 3600 + mi * 60 + s
        if "z" not in g:
            secs, found = _from_local(wall, ok, zones_a[at], obs[at], obs_ok[at], us)
            ok &= found
        elif mask[g["z"][0]] == "a":
            names_here = _letters(block, g["z"])
            shift = np.zeros(len(at), dtype=np.int64)
            own = zones_a[at]
            for pair in set(zip(names_here.tolist(), own.tolist())):
                abbr, zone = pair[0].decode(), pair[1]
                table = zone_table(zone) if zone else None
                got = table[2].get(abbr) if table is not None and abbr not in ("Z", "UTC", "GMT") else None
                if got is None and abbr in ABBREVIATIONS:
                    got = ABBREVIATIONS[abbr] * 60
                rows = (names_here == pair[0]) & np.array([z == zone for z in own], dtype=bool)
                if got is None:
                    ok[rows] = False
                else:
                    shift[rows] = got
            secs = wall - shift
        else:
            a, b = g["z"]
            zh = _number(block, (a + 1, a + 3))
            zm = _number(block, (b - 2, b)) if b - a > 3 else np.zeros(len(at), dtype=np.int64)
            ok &= (zh <= 18) & (zm < 60)
            secs = wall - np.where(block[:, a] == ord("-"), -1, 1) * (zh * 3600 + zm * 60)
        out[at], good[at] = secs * 1_000_000 + us, ok
    return out, good


def as_nullable(values: np.ndarray, ok: np.ndarray) -> pd.Series:
    """Int64 with null where not ok."""
    return pd.Series(pd.arrays.IntegerArray(np.where(ok, values, 0).astype(np.int64), ~ok))
