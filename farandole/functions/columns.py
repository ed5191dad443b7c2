"""Scalar rules as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
#: Earth's radius in metres, and radians of a degree.
EARTH_RADIUS, RADIAN = 6_372_797.560856, 0.01745329238


def time_to_int(text: Column) -> Column:
    """Seconds of HH:MM:SS (hours may exceed 24); -1 if not three parts, null if not numeric."""
    part = F.split(text, ":")
    number = lambda k: F.try_element_at(part, F.lit(k)).try_cast("int")
    return F.when(F.size(part) != 3, -1).otherwise(number(1) * 3600 + number(2) * 60 + number(3))


def flat(day: Column, seconds: Column) -> Column:
    """Seconds since the production start."""
    return day.cast("long") * DAY + seconds


def hour_in_day(seconds: Column) -> Column:
    return F.pmod(seconds, F.lit(DAY))


def shifted(now: Column, time_of_day: Column, forward: bool = True) -> Column:
    """The next (or previous) instant at that time of day."""
    here = F.floor(now / DAY) * DAY + time_of_day
    return F.when(here >= now, here).otherwise(here + DAY) if forward else F.when(here <= now, here).otherwise(here - DAY)


def overlaps(begin: Column, end: Column, other_begin: Column, other_end: Column) -> Column:
    """Whether two half-open intervals share an instant."""
    return (begin < other_end) & (end > other_begin)


def open_at(time_of_day: Column, opening: Column, closing: Column) -> Column:
    """Between opening and closing, around midnight if closing comes first."""
    return F.when(opening <= closing, time_of_day.between(opening, closing)).otherwise((time_of_day >= opening) | (time_of_day <= closing))


def status_at(now: Column, begin: Column, end: Column) -> Column:
    """active, future or past."""
    return F.when((begin <= now) & (now < end), "active").when(begin >= now, "future").otherwise("past")


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points."""
    turn = F.abs(lon2 - lon1)
    turn = F.when(turn > 180, 360 - turn).otherwise(turn)  # a whole turn is no distance, however sin(pi) is rounded
    a = F.pow(F.sin((lat2 - lat1) * RADIAN / 2), 2) + F.cos(lat1 * RADIAN) * F.cos(lat2 * RADIAN) * F.pow(F.sin(turn * RADIAN / 2), 2)
    return F.asin(F.least(F.lit(1.0), F.sqrt(a))) * 2 * EARTH_RADIUS


def approximate_square(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Square of the equirectangular distance."""
    scale = RADIAN * EARTH_RADIUS
    return F.pow((lat2 - lat1) * scale, 2) + F.pow((lon2 - lon1) * scale * F.cos(lat1 * RADIAN), 2)


def along_segment(lon: Column, lat: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    """Where the point projects on the segment: 0 at a to 1 at b; 0 on a segment without length."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    length = dx * dx + dy * dy
    if length < 1e-11:
        return F.lit(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - a[0]) * dx + (lat - a[1]) * dy) / length))


def inside(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd test against a ring of a few corners."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            crossings = crossings + F.when(((lat < y1) != (lat < y2)) & (lon < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1), 1).otherwise(0)
    return crossings % 2 == 1


def accessible(required: int, properties: Column) -> Column:
    """Whether all required property bits are set."""
    return F.lit(required).bitwiseAND(F.bitwise_not(properties)) == 0


def any_near_day(days: Column, day: Column) -> Column:
    """Whether a set of days holds the day, the day before or the day after."""
    return F.arrays_overlap(days, F.sequence(day - 1, day + 1))


def manhattan_duration(metres: Column, speed: float) -> Column:
    return F.floor(metres * F.sqrt(F.lit(2.0)) / speed).cast("long")


def frequency_next(now: Column, lower: Column, upper: Column, headway: Column) -> Column:
    """First departure from lower on, every headway, not before now; null past upper."""
    steps = F.greatest(F.lit(0), F.ceil((now - lower) / headway))
    at = lower + steps * headway
    return F.when(at <= upper, at)


def frequency_previous(now: Column, lower: Column, upper: Column, headway: Column) -> Column:
    """Last departure not after now; null before lower."""
    steps = F.floor((F.least(now, upper) - lower) / headway)
    return F.when(now >= lower, lower + steps * headway)


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks, and the letters without them."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii()]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


#: Latin letters that aren't a letter with a mark, and what they are searched as.
LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ħ": "h", "ı": "i"}


def words(text: Column) -> Column:
    """Distinct lower-case words of letters and digits of any script, Latin ones without accents."""
    plain = F.translate(F.lower(text), *_plain_letters())
    for letter, told in LIGATURES.items():
        plain = F.replace(plain, F.lit(letter), F.lit(told))
    plain = F.regexp_replace(plain, r"\p{Mn}+", "")
    return F.array_distinct(F.filter(F.split(plain, r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != ""))


def bigrams(word: Column) -> Column:
    """Its substrings of two letters; a shorter word is kept whole."""
    return F.when(F.length(word) < 2, F.array(word)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda k: F.substring(word, k, 2)))


def postal_range(codes: Column) -> Column:
    """min-max of numeric codes, one code alone, or all joined by ; if some isn't numeric."""
    numeric = F.forall(codes, lambda c: c.rlike("^[0-9]+$"))
    low, high = F.array_min(codes), F.array_max(codes)
    return F.when(~numeric, F.array_join(F.sort_array(codes), ";")).when(low == high, low).otherwise(F.concat_ws("-", low, high))


def to_timestamp_of(day0: Column, seconds: Column) -> Column:
    """The time that a flat number of seconds since day0 stands for."""
    return day0.cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def to_flat(day0: Column, at: Column) -> Column:
    """Seconds from day0 to a time."""
    return F.unix_seconds(at.cast("timestamp")) - F.unix_seconds(day0.cast("timestamp"))


def same_place(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Whether two points are less than a tenth of a metre apart."""
    return haversine(lon1, lat1, lon2, lat2) < 0.1


def house_number(query: Column) -> Column:
    """The number that a text search starts with, null without one."""
    return F.when(query.rlike(r"^\s*[0-9]{1,9}\b"), F.regexp_extract(query, r"^\s*([0-9]{1,9})", 1).cast("int"))


def without_house_number(query: Column) -> Column:
    return F.trim(F.regexp_replace(query, r"^\s*[0-9]{1,9}\b", ""))


def base_time(at: Column, shift_days: Column) -> Column:
    """Flat time of an amended stop on the day of its base trip."""
    return at - shift_days * DAY


def earliest_time(stops: Column) -> Column:
    """The earliest boarding or arrival of a trip's stops (boarding, arrival)."""
    return F.array_min(F.transform(stops, lambda s: F.least(s["boarding"], s["arrival"])))
