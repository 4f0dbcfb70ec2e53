"""Numbers: rounding half up on doubles, grades, verdicts, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10**digits + 0.5) / 10**digits in doubles; an integer without digits."""
    if not digits:
        return F.floor(x + F.lit(0.5))
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def ladder(x: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The name of the first step that x reaches; null for null."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for least, name in steps:
        out = out.when(x >= least, name)
    return out.otherwise(last)


def grade(score: Column) -> Column:
    return ladder(score, [(90, "A"), (80, "B"), (70, "C"), (60, "D")], "F")


def verdict(score: Column) -> Column:
    return ladder(score, [(90, "Very good"), (80, "Good"), (60, "Warning"), (40, "Poor")], "Critical")


def score_band(score: Column) -> Column:
    return ladder(score, [(80, "good"), (60, "fair")], "poor")


def percent(share: Column) -> Column:
    """A share of 1 as a percentage with one digit."""
    return F.floor(share * 1000.0 + 0.5) / 10.0


def kilobytes(n: Column) -> Column:
    return n / F.lit(1024.0)


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps, rounded half up."""
    return round_half_up((F.unix_millis(later) - F.unix_millis(earlier)) / F.lit(86_400_000.0))


def clock_drift_ok(as_of: Column, date_header: Column, seconds: int = 90) -> Column:
    """Whether a server's Date header (RFC 1123 text) is within ``seconds`` of ``as_of``; null if it can't be read."""
    at = F.try_to_timestamp(F.regexp_replace(date_header, r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.abs(F.unix_millis(as_of) - F.unix_millis(at)) < seconds * 1000


def status_band(status: Column) -> Column:
    """How a page's status code is marked: ok, warn (redirects and what has no code of its own) or fail."""
    return F.when((status >= 200) & (status < 300), "ok").when(status >= 400, "fail").otherwise("warn")
