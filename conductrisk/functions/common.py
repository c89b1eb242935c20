"""Small column builders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from conductrisk.config import WORK_END, WORK_START


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or `default` where b is 0 or either side is null."""
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def no_nan(c: Column, default: float = 0.0) -> Column:
    """Null and NaN become `default`."""
    return F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(default))


def parse_time(c) -> Column:
    """Timestamp from text; unparsable text gives null."""
    return F.try_to_timestamp(col(c))


def to_bool(c, yes: bool = False) -> Column:
    """'true' or '1' (and 'yes' on request) in any case; null counts as false."""
    words = ["true", "1"] + (["yes"] if yes else [])
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin(words), F.lit(False))


def to_number(c, digits: int | None = 4, default: float | None = 0.0) -> Column:
    """Number from text; bad text gives `default`."""
    out = col(c).try_cast("double")
    if default is not None:
        out = no_nan(out, default)
    return out if digits is None else F.round(out, digits)


def blank_to_null(c) -> Column:
    return F.nullif(F.trim(col(c).cast("string")), F.lit(""))


def iso_weekday(c) -> Column:
    """Monday is 0."""
    return F.weekday(col(c))


def after_hours(hour, start: int = WORK_START, end: int = WORK_END, closed: bool = False) -> Column:
    """Before `start`, or from `end` on; with `closed` the hour `end` itself still is work time."""
    h = col(hour)
    return (h < start) | ((h > end) if closed else (h >= end))


def contains_any(text: Column, words: list[str]) -> Column:
    """Does the lower-case text contain one of the words?"""
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def lookup(key: Column, mapping: dict, default) -> Column:
    """A fixed lookup table as a literal map."""
    if not mapping:
        return F.lit(default)
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def band(score, cuts=(80.0, 60.0, 40.0), names=("Critical", "High", "Medium", "Low"),
         strict: bool = False) -> Column:
    """Name of the band a score falls into; `strict` compares with > instead of >=."""
    c = col(score)
    out = F.lit(names[-1])
    for cut, name in list(zip(cuts, names))[::-1]:
        out = F.when((c > cut) if strict else (c >= cut), name).otherwise(out)
    return out


def with_defaults(df, defaults: dict):
    """Add the columns that are missing, with a default each."""
    missing = {n: F.lit(v) for n, v in defaults.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def half_even(c: Column, digits: int = 0) -> Column:
    """Half-even rounding as text."""
    rounded = F.bround(c, digits)
    return rounded.cast("bigint").cast("string") if digits == 0 else F.format_string(f"%.{digits}f", rounded)


def percent_text(c: Column) -> Column:
    return F.concat(half_even(c * 100), F.lit("%"))


def session_state(last_seen, as_of) -> Column:
    """active below 2 minutes, idle below 15, else offline."""
    minutes = (F.unix_micros(col(as_of)) - F.unix_micros(col(last_seen))) / 60e6
    return F.coalesce(
        F.when(minutes < 2, "active").when(minutes < 15, "idle").otherwise("offline"),
        F.lit("offline"),
    )


def relative_time(then, as_of) -> Column:
    """'just now', '5m ago', '3h ago', else month and day."""
    minutes = F.floor((F.unix_micros(col(as_of)) - F.unix_micros(col(then))) / 60e6)
    return (
        F.when(col(then).isNull(), "—")
        .when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes, F.lit("m ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60), F.lit("h ago")))
        .otherwise(F.date_format(col(then), "MMM d"))
    )


def clean_app(c) -> Column:
    """Application name without '.exe' and a leading dot; unknown becomes null."""
    app = col(c)
    cleaned = F.regexp_replace(F.regexp_replace(app, r"(?i)\.exe$", ""), r"^\.", "")
    return F.when((F.coalesce(app, F.lit("")) == "") | app.isin("—", "unknown"), None).otherwise(cleaned)


def session_id(user, ts) -> Column:
    return F.concat(F.lit("session_"), col(user), F.lit("_"), F.date_format(col(ts), "yyyyMMdd"))


def feature_id(name, version) -> Column:
    """First eight hex digits of md5("name:version")."""
    return F.substring(F.md5(F.concat_ws(":", col(name), col(version))), 1, 8)


def cyclical(c: Column, period: int) -> tuple[Column, Column]:
    angle = c * F.lit(2 * 3.141592653589793) / period
    return F.sin(angle), F.cos(angle)
