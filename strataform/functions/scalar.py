"""Column expressions that Spark has no function for; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds from 0001-01-01 to 1970-01-01: windows are aligned to year 1.
EPOCH_MICROS = 62_135_596_800_000_000
UNKNOWN = "unknown"
#: Unicode's white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Glyphs of a sparkline, from low to high.
SPARK = " .:-=+*#@"


def normalize(key: Column) -> Column:
    """Trimmed of any Unicode white space and lower-cased; null and blank become "unknown"."""
    text = F.lower(F.trim(key.cast("string"), F.lit(WHITE_SPACE)))
    return F.when(text.isNull() | (text == ""), F.lit(UNKNOWN)).otherwise(text)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where that isn't a number."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def trim_payload(text: Column, size: int = 512) -> Column:
    return F.coalesce(F.substring(text, 1, size), F.lit(""))


def json_key(payload: Column, name: str = "groupName") -> Column:
    """The normalised value of a field of a JSON object; "unknown" where there is none or the text isn't JSON."""
    return normalize(F.get_json_object(payload, f"$.{name}"))


def cell_id(dimension: Column | str = "dimension", key: Column | str = "key") -> Column:
    return F.concat_ws(":", dimension, key)


def strip_window(key: Column) -> Column:
    """A key without its "@window" part."""
    return F.when(F.instr(key, "@") > 1, F.substring_index(key, "@", 1)).otherwise(key)


def cell_dimension(cell: Column) -> Column:
    return F.when(F.instr(cell, ":") > 1, F.substring_index(cell, ":", 1)).otherwise(F.lit(""))


def cell_key(cell: Column) -> Column:
    at = F.instr(cell, ":")
    return F.when(at > 1, cell.substr(at + 1, F.length(cell))).otherwise(cell)


def friendly(name: Column) -> Column:
    """words_like-this as Words Like This."""
    return F.initcap(F.regexp_replace(name, "[_-]+", " "))


def window_start(ts: Column, size_micros: int) -> Column:
    """Start of the bucket of that size, counted from 0001-01-01 UTC; a size of 0 or less leaves the time as it is."""
    ts = ts.cast("timestamp")
    if size_micros <= 0:
        return ts
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros + F.lit(EPOCH_MICROS), F.lit(size_micros)))


def windowed_key(key: Column, start: Column) -> Column:
    """key@yyyyMMddHHmmss; untimed rows keep the plain key."""
    return F.when(start.isNull(), key).otherwise(F.concat(key, F.lit("@"), F.date_format(start, "yyyyMMddHHmmss")))


def day_bucket(ts: Column) -> Column:
    return F.when(F.dayofweek(ts).isin(1, 7), "weekend").otherwise("weekday")


def hour_bucket(ts: Column) -> Column:
    return F.lpad(F.hour(ts).cast("string"), 2, "0")


def ewma(series: Column, alpha: float) -> Column:
    """e0 = x0, e = alpha * x + (1 - alpha) * e before, over an array."""
    rest = F.slice(series, 2, F.greatest(F.size(series) - 1, F.lit(0)))
    step = lambda acc, x: F.concat(acc, F.array(F.lit(alpha) * x + F.lit(1 - alpha) * F.element_at(acc, -1)))
    return F.when(F.size(series) == 0, series).otherwise(F.aggregate(rest, F.slice(series, 1, 1), step))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def bound(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pearson(x: Column, y: Column, floor: float = 1e-12) -> Column:
    """Correlation of two arrays of one length; 0 for fewer than two points or where either hardly varies."""

    def centred(m: Column) -> Column:
        square = lambda a, c: _sum(F.transform(a, lambda v: (v - c) * (v - c)))
        sums = F.struct(square(x, m["x"]).alias("x"), square(y, m["y"]).alias("y"), _sum(F.zip_with(x, y, lambda a, b: (a - m["x"]) * (b - m["y"]))).alias("xy"))
        return bound(sums, lambda s: F.when((F.size(x) < 2) | (s["x"] <= floor) | (s["y"] <= floor), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(s["xy"], F.sqrt(s["x"] * s["y"])), F.lit(0.0))))

    n = F.size(x).cast("double")
    return bound(F.struct(F.try_divide(_sum(x), n).alias("x"), F.try_divide(_sum(y), n).alias("y")), centred)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    dot = _sum(F.zip_with(a, b, lambda x, y: (x * y).cast("double")))
    na, nb = (_sum(F.transform(v, lambda x: (x * x).cast("double"))) for v in (a, b))
    return F.when((na <= 1e-12) | (nb <= 1e-12), F.lit(0.0)).otherwise(dot / F.sqrt(na * nb))


def sparkline(series: Column) -> Column:
    """One glyph a value, nine levels between least and greatest; a flat series is level 4."""
    low, high = F.array_min(series), F.array_max(series)
    level = lambda v: F.when(high - low <= 0, F.lit(4)).otherwise(F.floor(F.try_divide(v - low, high - low) * 8)).cast("int")
    return F.array_join(F.transform(series, lambda v: F.substring(F.lit(SPARK), level(v) + 1, F.lit(1))), "")


def histogram_bars(counts: Column, width: int = 20) -> Column:
    """Bars of # scaled to the greatest count, one to a line."""
    top = F.array_max(counts)
    return F.array_join(F.transform(counts, lambda v: F.repeat(F.lit("#"), F.ceil(ratio(v, top) * width).cast("int"))), "\n")


def p75_between(p50: Column, p95: Column) -> Column:
    """The 75th percentile on the straight line from the 50th to the 95th."""
    return p50 + (p95 - p50) * F.lit(25.0) / F.lit(45.0)


def grounded(text: Column, allowed: Column) -> Column:
    """Whether each number in the text is within 1 % (of at least 1) of an allowed value or of 100 times one."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda s: s.cast("double"))
    near = lambda n, a: F.abs(n - a) <= F.lit(0.01) * F.greatest(F.lit(1.0), F.abs(a))
    return F.forall(numbers, lambda n: F.exists(allowed, lambda a: near(n, a) | near(n, a * 100)))
