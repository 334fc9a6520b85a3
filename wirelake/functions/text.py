"""Text forms of JSON as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bytes_to_base64(c) -> Column:
    return F.base64(_col(c).cast("binary"))


def base64_to_bytes(c) -> Column:
    """Standard or URL-safe, padded or not."""
    text = F.rtrim(F.translate(_col(c), "-_", "+/"), F.lit("="))
    return F.unbase64(F.rpad(text, (F.ceil(F.length(text) / 4) * 4).cast("int"), F.lit("=")))


def _fraction(nanos: Column) -> Column:
    nine = F.lpad(nanos.cast("string"), 9, "0")
    return (
        F.when(nanos == 0, F.lit(""))
        .when(nanos % 1_000_000 == 0, F.concat(F.lit("."), F.substring(nine, 1, 3)))
        .when(nanos % 1_000 == 0, F.concat(F.lit("."), F.substring(nine, 1, 6)))
        .otherwise(F.concat(F.lit("."), nine))
    )


def days_of(seconds) -> Column:
    """The day number from 1970-01-01 on, also before it."""
    s = _col(seconds).cast("long")
    return ((s - F.pmod(s, F.lit(86_400))) / 86_400).cast("int")


def timestamp_struct(c) -> Column:
    """struct<seconds, nanos> of a Spark time stamp; nanos are never negative."""
    micros = F.unix_micros(_col(c))
    rest = F.pmod(micros, F.lit(1_000_000))
    return F.struct(((micros - rest) / 1_000_000).cast("long").alias("seconds"), (rest * 1000).cast("int").alias("nanos"))


def struct_to_timestamp(c) -> Column:
    """A Spark time stamp: what is below a microsecond is lost."""
    s = _col(c)
    return F.timestamp_micros(s["seconds"] * 1_000_000 + F.floor(s["nanos"] / 1000).cast("long"))


_UNITS = {"seconds": 1, "millis": 1_000, "micros": 1_000_000, "nanos": 1_000_000_000}


def duration_struct(c, unit: str = "seconds") -> Column:
    """struct<seconds, nanos> of a whole number of units, both of one sign."""
    v, per = _col(c).cast("long"), _UNITS[unit]
    rest = v % per  # of the sign of v
    return F.struct(((v - rest) / per).cast("long").alias("seconds"), (rest * (1_000_000_000 // per)).cast("int").alias("nanos"))


def mask_contains(paths, path: str) -> Column:
    """Whether a field mask has just this path."""
    return F.array_contains(_col(paths), path)


def timestamp_to_text(seconds, nanos) -> Column:
    """RFC 3339 with 0, 3, 6 or 9 digits of fraction; null outside the years 1 to 9999. Never by way of a timestamp, which has microseconds."""
    s, n = _col(seconds).cast("long"), _col(nanos).cast("int")
    rest = F.pmod(s, F.lit(86_400))
    date = F.date_format(F.date_from_unix_date(days_of(s)), "yyyy-MM-dd")
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    text = F.concat(date, F.lit("T"), two(rest / 3600), F.lit(":"), two(rest / 60 % 60), F.lit(":"), two(rest % 60), _fraction(n), F.lit("Z"))
    return F.when(s.between(-62_135_596_800, 253_402_300_799) & n.between(0, 999_999_999), text)


def duration_to_text(seconds, nanos) -> Column:
    """Null where the signs differ or a part is out of range."""
    s, n = _col(seconds).cast("long"), _col(nanos).cast("int")
    ok = (F.abs(s) <= 315_576_000_000) & (F.abs(n) <= 999_999_999) & ~((s > 0) & (n < 0)) & ~((s < 0) & (n > 0))
    return F.when(ok, F.concat(F.when((s < 0) | (n < 0), "-").otherwise(""), F.abs(s).cast("string"), _fraction(F.abs(n)), F.lit("s")))


def text_to_duration(c) -> Column:
    """struct<seconds, nanos>; null for text that is no duration."""
    text = _col(c)
    pattern = r"^(-?)([0-9]{1,12})(?:\.([0-9]{1,9}))?s$"
    sign = F.when(F.regexp_extract(text, pattern, 1) == "-", -1).otherwise(1)
    seconds = F.regexp_extract(text, pattern, 2).try_cast("long") * sign
    nanos = F.rpad(F.regexp_extract(text, pattern, 3), 9, "0").cast("int") * sign
    return F.when(text.rlike(pattern) & (F.abs(seconds) <= 315_576_000_000), F.struct(seconds.alias("seconds"), nanos.alias("nanos")))


def snake_to_camel(c) -> Column:
    """Each letter after underscores becomes a capital."""
    parts = F.split(_col(c), "_")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000)))
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def camel_to_snake(c) -> Column:
    return F.lower(F.regexp_replace(_col(c), "([A-Z])", "_$1"))


def mask_to_text(paths) -> Column:
    """A field mask's JSON; null where a path doesn't survive the way there and back."""
    p = _col(paths)
    return F.when(F.forall(p, lambda x: camel_to_snake(snake_to_camel(x)) == x), F.array_join(F.transform(p, snake_to_camel), ","))


def text_to_mask(c) -> Column:
    text = _col(c)
    return F.when(text == "", F.array().cast("array<string>")).when(~text.contains("_"), F.transform(F.split(text, ","), camel_to_snake))


def enum_name(c, values: dict[int, str], otherwise=None) -> Column:
    """The name of a number; ``otherwise``, or the number as text, where it has none."""
    v = _col(c)
    out = None
    for number, name in values.items():
        out = F.when(v == number, name) if out is None else out.when(v == number, name)
    rest = v.cast("string") if otherwise is None else F.lit(otherwise)
    return rest if out is None else out.otherwise(rest)


def enum_number(c, values: dict[str, int]) -> Column:
    v = _col(c)
    out = None
    for name, number in values.items():
        out = F.when(v == name, number) if out is None else out.when(v == name, number)
    return F.lit(None).cast("int") if out is None else out.cast("int")


def json_number(c) -> Column:
    """A float or double as JSON has it: NaN and the infinities in quotes."""
    v = _col(c)
    return F.when(F.isnan(v), '"NaN"').when(v == float("inf"), '"Infinity"').when(v == float("-inf"), '"-Infinity"').otherwise(v.cast("string"))
