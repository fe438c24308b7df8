"""Scalar functions over columns: times, text, numbers and JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The time formats that inputs come in, besides epoch seconds and milliseconds.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy.MM.dd HH:mm:ss", "yyyy.MM.dd HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyyMMdd")
MILLIS_FROM = 1e11


def div(a: Column, b: Column, default=None) -> Column:
    """a / b; `default` where b is zero."""
    return F.when(b != 0, a / b).otherwise(F.lit(default).cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def parse_time(text: Column) -> Column:
    """A timestamp from text: the first format that fits, or epoch seconds or milliseconds; null if none does."""
    plain = F.trim(text)
    number = F.when(plain.rlike(r"^\d{9,13}(\.\d+)?$"), plain.cast("double"))
    epoch = F.timestamp_seconds(F.when(number >= MILLIS_FROM, number / 1000).otherwise(number))
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in TIME_FORMATS], epoch)


def round_price(x: Column, digits: int) -> Column:
    """Half up to `digits`; negative digits leave it as it is."""
    return F.round(x, digits) if digits >= 0 else x


def truncated(text: Column, length: int = 100, suffix: str = "...") -> Column:
    keep = length - len(suffix)
    short = F.substring(text, 1, length) if keep <= 0 else F.concat(F.substring(text, 1, keep), F.lit(suffix))
    return F.when(F.length(text) <= length, text).otherwise(short)


def snake_case(text: Column) -> Column:
    joined = F.regexp_replace(text, r"[\s-]+", "_")
    parted = F.regexp_replace(F.regexp_replace(joined, "(?<=[a-z])(?=[A-Z])", "_"), "(?<=[A-Z])(?=[A-Z][a-z])", "_")
    return F.lower(parted)


def duration(seconds: Column) -> Column:
    """`1d 2h 3m 4s` without zero parts; `0s` for nothing, milliseconds under a second, a sign in front."""
    size = F.abs(seconds)
    whole = F.floor(size).cast("long")
    parts = [(F.floor(whole / 86400), "d"), (F.floor(whole / 3600) % 24, "h"), (F.floor(whole / 60) % 60, "m"), (whole % 60, "s")]
    text = F.concat_ws(" ", *[F.when(n > 0, F.concat(n.cast("long").cast("string"), F.lit(unit))) for n, unit in parts])
    text = F.when(size < 1, F.concat(F.bround(size * 1000).cast("long").cast("string"), F.lit("ms"))).otherwise(text)
    return F.when(seconds.isNotNull(), F.concat(F.when(seconds < 0, "-").otherwise(""), text))


def byte_size(n: Column) -> Column:
    """`512 B`, `1.43 MB`: units of 1024, up to PB."""
    size = F.abs(n)
    step = F.least(F.lit(5), F.floor(F.log(1024.0, F.greatest(size, F.lit(1)).cast("double")) + 1e-12)).cast("int")
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB", "PB"))), step + 1)
    number = F.when(step == 0, size.cast("string")).otherwise(F.regexp_replace(F.format_number(size / F.pow(F.lit(1024.0), step), 2), ",", ""))
    return F.concat(F.when(n < 0, "-").otherwise(""), number, F.lit(" "), unit)


def json_path(text: Column, path: str, default: str | None = None) -> Column:
    """The value at a dotted path of a JSON text."""
    return F.coalesce(F.get_json_object(text, "$." + path), F.lit(default))


def merged_maps(a: Column, b: Column) -> Column:
    """Both maps; where both have a key, the second one's value."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def content_hash(*columns: Column) -> Column:
    """SHA-256 over the JSON of the columns, which tells null, empty and boundaries apart."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def softmax(x: Column) -> Column:
    """Of an array; shifted by its largest element."""
    # A column named within a lambda is worked out again for each element, so largest element and sum go along with the elements instead.
    known = F.array(F.struct(x.alias("x"), F.array_max(x).alias("top")))
    shifted = F.transform(known, lambda s: F.transform(s["x"], lambda v: F.exp(v - s["top"])))
    summed = F.transform(shifted, lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda s, w: s + w).alias("total")))
    return F.get(F.transform(summed, lambda s: F.transform(s["e"], lambda v: v / s["total"])), F.lit(0))


def percentage(value: Column, total: Column) -> Column:
    return div(value * 100.0, total, 0.0)


def intervals(start: Column, end: Column, seconds: int) -> Column:
    """Timestamps from start to end, both included, in equal steps."""
    return F.sequence(start, end, F.make_interval(secs=F.lit(seconds)))


def all_finite(*columns: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)) for c in columns])


def session_of(hour: Column) -> Column:
    """asia from 0, london from 7, london_ny_overlap from 12, new_york from 17, off_hours from 22."""
    return F.when(hour < 7, "asia").when(hour < 12, "london").when(hour < 17, "london_ny_overlap").when(hour < 22, "new_york").otherwise("off_hours")


def profile_session_of(hour: Column) -> Column:
    """The clock of session profiles: asian from 0, european from 7, us from 13, pacific from 22."""
    return F.when(hour < 7, "asian").when(hour < 13, "european").when(hour < 22, "us").otherwise("pacific")
