"""Column functions. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def argmax(a) -> Column:
    """Place of the largest element, from 0; the first of equal ones."""
    return (F.array_position(_c(a), F.array_max(_c(a))) - 1).cast("int")


def one_hot(cls, n=None) -> Column:
    """n doubles, 1 at the class; a class outside is an error. n: a number or a column; not given, one more than the class."""
    c = _c(cls)
    size = c + 1 if n is None else F.lit(n) if isinstance(n, int) else _c(n)
    hot = F.transform(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1), lambda i: (i == c).cast("double"))
    return F.when((c >= size) | (c < 0), F.raise_error(F.concat(F.lit("class out of range: "), c.cast("string")))).otherwise(hot)


from_one_hot = argmax


def clock_seconds(x, *more) -> Column:
    """Seconds of 'hh:mm:ss[.,]fff', 'mm:ss' or plain seconds, or of two or three columns (h, m, s) or (m, s)."""
    if more:
        x = F.array(*(_c(c).cast("double") for c in (x, *more)))
    parts = F.split(F.replace(_c(x).cast("string"), F.lit(","), F.lit(".")), ":") if not more else x
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p.cast("double"))


def time_point(x) -> Column:
    """(ticks, rate) of an MPEG-7 time point ...Thh:mm:ss:nFN."""
    g = lambda k: F.regexp_extract(_c(x), r"T(\d+):(\d+):(\d+):(\d+)F(\d+)", k).cast("long")
    return F.struct(((g(1) * 3600 + g(2) * 60 + g(3)) * g(5) + g(4)).alias("ticks"), g(5).alias("rate"))


def duration(x) -> Column:
    """(ticks, rate) of an MPEG-7 duration PT[h]H[m]M[s]S[n]N[f]F; missing parts are 0, a missing rate is 1."""
    g = lambda unit: F.coalesce(F.nullif(F.regexp_extract(_c(x), rf"(\d+){unit}", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    rate = F.greatest(g("F"), F.lit(1).cast("long"))
    return F.struct(((g("H") * 3600 + g("M") * 60 + g("S")) * rate + g("N")).alias("ticks"), rate.alias("rate"))


def gcd(x, y) -> Column:
    """Euclid's algorithm in as many steps as 64-bit numbers can need."""
    start = F.struct(F.abs(_c(x)).cast("long").alias("a"), F.abs(_c(y)).cast("long").alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % F.greatest(s["b"], F.lit(1))).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["a"])


def lcm(x, y) -> Column:
    """Least common multiple, 0 if either is 0. Of equal numbers, and of 1 and another, no divisor is looked for."""
    g = gcd(x, y)
    return F.when(_c(x) == _c(y), F.abs(_c(x)).cast("long")).when(_c(x) == 1, F.abs(_c(y)).cast("long")).when(g == 0, F.lit(0).cast("long")).otherwise((F.abs(_c(x)) / F.greatest(g, F.lit(1))).cast("long") * F.abs(_c(y)))


def combine_time(point, length) -> Column:
    """(start, end, rate) of a time point and a duration, at the least common multiple of their rates."""
    p, d = _c(point), _c(length)
    rate = lcm(p["rate"], d["rate"])
    start = (p["ticks"] * (rate / p["rate"])).cast("long")
    return F.struct(start.alias("start"), (start + d["ticks"] * (rate / d["rate"])).cast("long").alias("end"), rate.alias("rate"))


def recording_id(path) -> Column:
    """What stands after the last underscore, up to the next dot."""
    return F.split_part(F.element_at(F.split(_c(path), "_"), -1), F.lit("."), F.lit(1))


def group_id(rec_id) -> Column:
    return F.substring(_c(rec_id), 1, 3)


def file_stem(path) -> Column:
    return F.regexp_extract(_c(path), r"([^/.]+)\.[^/]*$", 1)


def gender_dialect(x) -> Column:
    parts = F.split(_c(x), r"\.")
    return F.struct(parts[0].alias("gender"), F.get(parts, F.lit(1)).alias("dialect"))


def hms(seconds) -> Column:
    s = _c(seconds)
    return F.struct(F.floor(s / 3600).alias("h"), F.floor(F.pmod(s, F.lit(3600)) / 60).alias("m"), F.bround(F.pmod(s, F.lit(60)), 2).alias("s"))


def log_floor(x, amin: float, base10: bool = True) -> Column:
    y = F.greatest(F.lit(amin), _c(x))
    return F.log10(y) if base10 else F.ln(y)


def clip(x, lo, hi) -> Column:
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


def round_even(x, digits: int = 0) -> Column:
    """Half to even."""
    return F.bround(_c(x), digits)


def floor_div(a, b) -> Column:
    return F.floor(_c(a) / _c(b))


def normalize(p) -> Column:
    """The vector divided by its sum; null elements if the sum is 0."""
    v = _c(p)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return F.transform(v, lambda x: F.try_divide(x, total))


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def subtract(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def mix(a, b, wa: float, wb: float) -> Column:
    """Weighted sum of two vectors."""
    return F.zip_with(_c(a), _c(b), lambda x, y: x * wa + y * wb)


def segment_line(start, end, label) -> Column:
    return F.format_string("%s - %s : %s", _c(start).cast("string"), _c(end).cast("string"), _c(label).cast("string"))


def precision_recall_line(p, r) -> Column:
    return F.format_string("%.2f (%.2f)", _c(p) * 100, _c(r) * 100)


def bin_key(x, lo: float, hi: float, bins: int) -> Column:
    """1 to bins, the right edge in the last; null outside."""
    k = F.when(_c(x) == hi, F.lit(bins)).otherwise(F.width_bucket(_c(x), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)))
    return F.when((k >= 1) & (k <= bins), k)


def tier_name(cls) -> Column:
    return F.when(_c(cls) == 0, "none").when(_c(cls) == 1, "single").otherwise("multiple")
