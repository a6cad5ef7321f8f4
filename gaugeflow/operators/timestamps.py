"""Timestamps in any of many forms to the one UTC instant they name.

Each text is reduced to a shape mask of character classes (d digit, a letter, else the character). A distinct mask is
turned into a parser once; the parser is a set of column slices, since all texts of one mask have their fields at the
same places. Fields are read and checked as whole arrays, and local times are converted through versioned tables of zone
transitions (zones.py) that are built once, on the driver.

The grammar; blanks may be of any kind and number, [] may be left out, | stands between choices:

    text    = date sep clock [zone] | count
    date    = yyyy-m-d | yyyy-ddd | yyyy-Www-d | yyyymmdd | n/n/n | n.n.n | n-n-n
            | [weekday[,]] d month yyyy|yy (parted by blanks or '-') | [weekday[,]] month d[,] yyyy
    sep     = blank | 'T' | ', ' (after n/n/n and its like) | nothing (after yyyymmdd)
    clock   = h:mm[:ss[fraction]] [AM|PM] | hhmm[ss[fraction]] (after yyyymmdd);  24:00 is the end of the day
    fraction= '.' or ',' and 1 to 9 digits
    zone    = Z | UTC | GMT | UT | an abbreviation of the row's zone | [UTC|GMT] ±hh[[:]mm]
    also      weekday month d clock [abbreviation] yyyy
    count   = 10 digits[fraction] | 13 | 16 digits: s, ms, µs since 1970
    month, weekday: English, three letters or whole ('Sept' too), any case, with or without a point

A date without clock names a day, not an instant. A leap second (ss = 60) has no instant of its own in this count.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.columns import need
from gaugeflow.operators.joins import lookup_join
from gaugeflow.operators.zones import ZoneTables, zone_tables
from gaugeflow.session import materialize

#: Zone names that may be asked for at once; the tables of all IANA zones are a few MB.
MOST_ZONES = 1000
#: No text of the grammar is longer than this, once its blanks are single ones.
LONGEST_TEXT = 80

#: English months, weekdays from Monday, halves of the day, and names of UTC.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
HALVES = {"am": 0, "pm": 12}
UTC_NAMES = ("Z", "UTC", "GMT", "UT")
_MONTH_OF = {x[:k]: i + 1 for i, x in enumerate(MONTHS) for k in (3, len(x))} | {"sept": 9}
_WEEKDAY_OF = {x[:k]: i for i, x in enumerate(WEEKDAYS) for k in (3, len(x))}
#: Separators that are written in several ways.
ALIKE = {0x2212: "-", 0x2010: "-", 0x2011: "-", 0x2013: "-", 0xA0: " ", 0x202F: " ", 0x2009: " ", 0x3000: " ", 0x09: " ", 0x0A: " ", 0x0D: " "}

_CLOCK = r"(?P<h>d{1,2}):(?P<mi>dd)(?::(?P<s>dd)(?:[.,](?P<f>d{1,9}))?)?"
_TAIL = r"(?: ?(?P<w1>a{1,5}))?(?: (?P<w2>a{1,5}))?(?: ?(?P<sign>[+-])(?P<oh>dd)(?::?(?P<om>dd))?)?"
_WEEKDAY = r"(?:(?P<wd>a{3,9})\.?,? )?"
_SEP = r"(?: |(?P<t>a))"
_DATES = [
    (r"(?P<y>dddd)-(?P<mo>d{1,2})-(?P<d>d{1,2})", _SEP),
    (r"(?P<y>dddd)-(?P<doy>ddd)", _SEP),
    (r"(?P<y>dddd)-(?P<week>add)-(?P<wday>d)", _SEP),
    (r"(?P<p1>d{1,2}|dddd)([/.-])(?P<p2>d{1,2})\2(?P<p3>d{1,2}|dddd)", ",? "),
    (rf"{_WEEKDAY}(?P<d>d{{1,2}})[- ](?P<mon>a{{3,9}})\.?[- ](?P<y>dddd|dd)", ",? "),
    (rf"{_WEEKDAY}(?P<mon>a{{3,9}})\.? (?P<d>d{{1,2}}),? (?P<y>dddd)", ",? "),
]
_FORMS = [re.compile(date + sep + _CLOCK + _TAIL) for date, sep in _DATES] + [
    re.compile(rf"(?P<y>dddd)(?P<mo>dd)(?P<d>dd)(?:(?P<t>a)| )?(?P<h>dd)(?P<mi>dd)(?:(?P<s>dd)(?:[.,](?P<f>d{{1,9}}))?)?{_TAIL}"),
    re.compile(rf"(?P<wd>a{{3,9}}) (?P<mon>a{{3,9}}) (?P<d>d{{1,2}}) {_CLOCK}(?: (?P<w1>a{{1,5}}))? (?P<y>dddd)"),
    re.compile(r"(?P<n10>d{10})(?:[.,](?P<f>d{1,9}))?"),
    re.compile(r"(?P<n13>d{13})"),
    re.compile(r"(?P<n16>d{16})"),
]
_ONLY_DATE = [re.compile(date) for date, _ in _DATES]
#: Class of an ASCII code; anything else is '?', which no form has.
_CLASSES = np.array([ord("d" if chr(c) in "0123456789" else "a" if chr(c).isascii() and chr(c).isalpha() else chr(c) if 0 < c < 128 else "?") for c in range(129)], "u1")
_CLASSES[0] = 0
_PLAIN = re.compile("[!-~]+(?: [!-~]+)*")
_BLANKS = re.compile(" {2,}")
_SOME_DAY = "some day"


@lru_cache(maxsize=4096)
def parser_of(mask: str) -> dict[str, tuple[int, int]] | str | None:
    """Where a mask has its fields; 'some day' for a date without clock; None if it is no known shape."""
    found = next((m for f in _FORMS if (m := f.fullmatch(mask))), None)
    if found:
        return {k: found.span(k) for k, v in found.groupdict().items() if v is not None}
    return _SOME_DAY if any(f.fullmatch(mask) for f in _ONLY_DATE) else None


def _cleaned(t: object) -> str:
    """A text with single plain blanks; '' if it isn't one, '?' if it is longer than any that names an instant."""
    if not isinstance(t, str):
        return ""
    if not _PLAIN.fullmatch(t):
        t = _BLANKS.sub(" ", t.translate(ALIKE)).strip()
    return t if len(t) <= LONGEST_TEXT else "?"


def _days_of_month(year: np.ndarray, month: np.ndarray) -> np.ndarray:
    """First day of the month, in days since 1970."""
    return ((year - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (month - 1).astype("timedelta64[M]")).astype("datetime64[D]").astype("int64")


def parse_times(texts: pd.Series, zones: pd.Series, orders: pd.Series, tables: ZoneTables) -> pd.DataFrame:
    """us and state of each text; see normalise_times."""
    n = len(texts)
    clean = [_cleaned(t) for t in texts]
    width = max(map(len, clean), default=0) or 1
    codes = np.array(clean, f"U{width}").view("uint32").reshape(n, width)
    codes_, masks = pd.factorize(_CLASSES[np.minimum(codes, 128)].view(f"S{width}").ravel().astype(object))
    order = orders.to_numpy(object)
    f = {k: np.zeros(n, "int64") for k in ("y", "mo", "d", "doy", "h", "mi", "s", "us", "off", "count", "week", "wday")}
    name = np.full(n, "", object)
    half, weekday = np.full(n, -1), np.full(n, -1)
    ok, is_count, is_doy, is_week, has_off, is_day = (np.zeros(n, bool) for _ in range(6))
    by_mask = np.argsort(codes_, kind="stable")
    cuts = np.searchsorted(codes_[by_mask], np.arange(len(masks) + 1))
    for m, mask in enumerate(masks):
        p = parser_of(mask.decode())
        if p is None:
            continue
        rows = by_mask[cuts[m] : cuts[m + 1]]
        if p is _SOME_DAY:
            is_day[rows] = True
            continue
        chars = codes[rows, : len(mask)]
        digits = chars.astype("int64") - 48
        num = lambda k: digits[:, p[k][0] : p[k][1]] @ 10 ** np.arange(p[k][1] - p[k][0] - 1, -1, -1)  # noqa: E731, B023
        words = lambda k: [clean[i][p[k][0] : p[k][1]] for i in rows.tolist()]  # noqa: E731, B023
        good = np.ones(len(rows), bool)
        for k in ("y", "mo", "d", "doy", "h", "mi", "s", "wday"):
            if k in p:
                f[k][rows] = num(k)
        if "f" in p:
            places = p["f"][1] - p["f"][0]
            f["us"][rows] = num("f") * 10 ** (6 - places) if places <= 6 else num("f") // 10 ** (places - 6)
        for k, unit in (("n10", 1_000_000), ("n13", 1000), ("n16", 1)):
            if k in p:
                f["count"][rows], is_count[rows] = num(k) * unit + f["us"][rows], True
        if "t" in p:
            good &= np.isin(chars[:, p["t"][0]], (84, 116))
        if "doy" in p:
            is_doy[rows] = True
        if "week" in p:
            good &= np.isin(chars[:, p["week"][0]], (87, 119))
            is_week[rows], f["week"][rows] = True, digits[:, p["week"][0] + 1] * 10 + digits[:, p["week"][0] + 2]
        if "p1" in p:
            a, b, c = (num(k) for k in ("p1", "p2", "p3"))
            o = order[rows]
            first_long, last_long = (p[k][1] - p[k][0] == 4 for k in ("p1", "p3"))
            ymd = (o == "ymd") & (not last_long) | first_long
            mdy = ~ymd & ((o == "mdy") | (o == "ymd"))
            good &= (o == "ymd") | (o == "mdy") | (o == "dmy") | first_long
            good &= not (first_long and last_long)
            f["y"][rows] = np.where(ymd, a, c)
            f["mo"][rows] = np.where(ymd, b, np.where(mdy, a, b))
            f["d"][rows] = np.where(ymd, c, np.where(mdy, b, a))
            if not (first_long or last_long):
                f["y"][rows] += 2000
        elif "y" in p and p["y"][1] - p["y"][0] == 2:
            f["y"][rows] += 2000
        if "mon" in p:
            f["mo"][rows] = [_MONTH_OF.get(w.lower(), 0) for w in words("mon")]
        if "wd" in p:
            weekday[rows] = [_WEEKDAY_OF.get(w.lower(), 99) for w in words("wd")]
        if "sign" in p:
            om = num("om") if "om" in p else 0
            minutes = num("oh") * 60 + om
            good &= (om < 60) & (minutes <= 18 * 60)
            f["off"][rows] = minutes * np.where(chars[:, p["sign"][0]] == 45, -60_000_000, 60_000_000)
            has_off[rows] = True
        for k in ("w1", "w2"):
            if k in p:
                w = words(k)
                h = np.array([HALVES.get(x.lower(), -1) for x in w])
                word, zulu = h < 0, np.array([x.upper() in UTC_NAMES for x in w])
                good &= ~((~word & (half[rows] >= 0)) | (word & (name[rows] != "")) | (word & ~zulu & has_off[rows]))
                half[rows] = np.where(word, half[rows], h)
                name[rows] = np.where(word & ~zulu, np.array(w, object), name[rows])
                has_off[rows] |= zulu
        ok[rows] = good
    h12 = half >= 0
    ok &= ~h12 | ((f["h"] >= 1) & (f["h"] <= 12))
    hour = np.where(h12, f["h"] % 12 + np.maximum(half, 0), f["h"])
    midnight = ~h12 & (hour == 24) & (f["mi"] + f["s"] + f["us"] == 0)  # the end of the day
    ok &= ((hour <= 23) | midnight) & (f["mi"] <= 59) & (f["s"] <= 59)
    year = np.where((f["y"] >= 1) & (f["y"] <= 9999), f["y"], 1970)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    month = np.clip(f["mo"], 1, 12)
    longest = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[month - 1] + (leap & (month == 2))
    first = _days_of_month(year, np.where(is_doy | is_week, 1, month))
    # the week of 4 January is the first; a year has 53 if it begins or ends on a Thursday
    starts = (first + 3) % 7
    week_one = first - starts + np.where(starts <= 3, 0, 7)
    weeks = 52 + ((starts == 3) | (leap & (starts == 2)))
    in_month = (f["mo"] >= 1) & (f["mo"] <= 12) & (f["d"] >= 1) & (f["d"] <= longest)
    in_weeks = (f["week"] >= 1) & (f["week"] <= weeks) & (f["wday"] >= 1) & (f["wday"] <= 7)
    ok &= is_count | ((f["y"] >= 1) & np.where(is_doy, (f["doy"] >= 1) & (f["doy"] <= 365 + leap), np.where(is_week, in_weeks, in_month)))
    day = np.where(is_week, week_one + (f["week"] - 1) * 7 + f["wday"], first + np.where(is_doy, f["doy"], f["d"])) - 1
    ok &= (weekday < 0) | ((day + 3) % 7 == weekday)
    local = ((day * 24 + hour) * 60 + f["mi"]) * 60_000_000 + f["s"] * 1_000_000 + f["us"]
    us = np.where(is_count, f["count"], local - f["off"])
    state = np.where(ok, "ok", np.where(is_day, "no clock time", "unreadable")).astype(object)
    rest = np.flatnonzero(ok & ~is_count & ~has_off)
    zone_codes, zone_names = pd.factorize(zones.iloc[rest])
    for i, z in enumerate(zone_names):
        r = rest[zone_codes == i]
        table = tables.zones.get(z)
        if table is None:
            state[r] = "no zone"
            continue
        t, fits = table.local_to_utc(local[r], name[r])
        us[r] = t
        state[r] = np.where(fits == 1, "ok", np.where(fits == 0, "no such time", "ambiguous"))
    state[rest[zone_codes < 0]] = "no zone"
    state[np.array([t == "" for t in clean], bool)] = "no text"
    out = pd.DataFrame({"us": pd.array(np.where(state == "ok", us, 0), "Int64"), "state": state})
    return out.assign(us=out["us"].mask(out["state"] != "ok"))


def normalise_times(rows: DataFrame, tables: ZoneTables, text: str = "time_text", zone: str = "zone_name", order: str = "date_order") -> DataFrame:
    """rows with instant_us BIGINT, time_state and zone_version STRING.

    time_state: 'ok'; 'no text' (null or blank); 'no clock time' (a date alone); 'unreadable' (not of the grammar above,
    or no such date or clock time); 'no zone' (local time of an unknown zone); 'no such time' (skipped by a change of
    the clocks, or a zone name the zone doesn't use then); 'ambiguous' (a repeated hour). instant_us is null unless
    'ok'. Nothing is rounded; digits beyond the microsecond are cut off. Years 1 to 9999, each by the zone's offsets then.

    A text without zone or offset is local time of the row's zone; a pair of numbers for day and month follows the row's
    order (dmy, mdy, ymd; null: unreadable), unless a four-digit year comes first; two-digit years are 20xx; bare counts
    of 10, 13 and 16 digits are s, ms and µs since 1970. Row by row, no shuffle. Columns of these names in rows raise.
    """
    clash = {"instant_us", "time_state", "zone_version"} & set(rows.columns)
    if clash:
        raise ValueError(f"rows already has {', '.join(sorted(clash))}")

    @F.pandas_udf("us bigint, state string")
    def parse(t: pd.Series, z: pd.Series, o: pd.Series) -> pd.DataFrame:
        return parse_times(t, z, o, tables)

    out = rows.withColumn("_parsed", parse(F.col(text), F.col(zone), F.col(order)))
    return out.withColumns({"instant_us": F.col("_parsed.us"), "time_state": F.col("_parsed.state"), "zone_version": F.lit(tables.version)}).drop("_parsed")


def feed_zone_tables(feeds: DataFrame) -> ZoneTables:
    """Tables of all zones the feeds name; more than MOST_ZONES distinct names raise."""
    names = [r[0] for r in need(feeds, "zone_name").filter("zone_name IS NOT NULL").distinct().limit(MOST_ZONES + 1).collect()]
    if len(names) > MOST_ZONES:
        raise ValueError(f"more than {MOST_ZONES} zones")
    return zone_tables(names)


def delivered_times(raw: DataFrame, feeds: DataFrame) -> DataFrame:
    """raw (raw_id, feed_id, station_ref, time_text, ...) through normalise_times, by the zone and order of its feed.

    A null or unlisted feed has neither; of a feed listed twice one row stands (the highest).
    """
    one = need(feeds, "feed_id", "zone_name", "date_order").filter("feed_id IS NOT NULL").groupBy("feed_id").agg(F.max(F.struct("zone_name", "date_order")).alias("_f"))
    one = one.select("feed_id", F.col("_f.zone_name").alias("zone_name"), F.col("_f.date_order").alias("date_order"))
    return normalise_times(lookup_join(need(raw, "raw_id", "feed_id", "station_ref", "time_text"), one, ["feed_id"], "left"), feed_zone_tables(feeds))


_KEY = ["station_ref", "instant_us"]


def _placed(times: DataFrame) -> DataFrame:
    t = need(times, "raw_id", *_KEY)
    return t.filter("raw_id IS NOT NULL AND station_ref IS NOT NULL AND instant_us IS NOT NULL")


def instant_classes(times: DataFrame) -> DataFrame:
    """(raw_id, class_id, n_links): of each record that shares its instant with another of its station, the smallest id
    among them and how many others there are. times as for same_instants, ids unique. Grows with the records, not the pairs."""
    t = materialize(_placed(times), "instants")
    classes = t.groupBy(*_KEY).agg(F.min("raw_id").alias("class_id"), (F.count("*") - 1).alias("n_links")).filter("n_links > 0")
    return t.join(classes, _KEY).select("raw_id", "class_id", "n_links")


def same_instants(times: DataFrame) -> DataFrame:
    """(raw_id_a, raw_id_b): records of one station that name the same instant, the smaller id first.

    times: (raw_id, station_ref, instant_us), ids unique; a repeated row counts once, a record with a null is in no pair.
    A key with very many records is spread over tasks by AQE's skew join; the pairs are the result asked for, so none is
    left out (instant_classes has them in a row each).
    """
    t = materialize(_placed(times), "instants")  # texts are parsed once, not once a side
    # ids of keys that occur once don't take part in the join
    many = t.groupBy(*_KEY).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    a = t.join(many, _KEY, "left_semi").dropDuplicates([*_KEY, "raw_id"])  # placed by the key already: no further shuffle
    b = a.select(*_KEY, F.col("raw_id").alias("raw_id_b"))
    return a.withColumnRenamed("raw_id", "raw_id_a").join(b, _KEY).filter("raw_id_a < raw_id_b").select("raw_id_a", "raw_id_b")
