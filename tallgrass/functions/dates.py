"""Date and time functions on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codes of strftime and Spark's patterns (fixed values).
PATTERNS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%p": "a", "%I": "hh"}


def is_weekend(c: Column) -> Column:
    return F.weekday(c) >= 5


def is_business_day(c: Column) -> Column:
    return F.weekday(c) < 5


def floor(c: Column, unit: str) -> Column:
    return F.date_trunc(unit, c).cast("timestamp_ntz")


def round_hour(c: Column) -> Column:
    return floor(c + F.expr("INTERVAL 30 MINUTES"), "hour")


def add_days(c: Column, n: int) -> Column:
    return c + F.expr(f"INTERVAL {n} DAYS")


def add_hours(c: Column, n: int) -> Column:
    return c + F.expr(f"INTERVAL {n} HOURS")


def add_months(c: Column, n: int) -> Column:
    """The day is clamped to the month's last; the time of day stays."""
    return c + F.make_ym_interval(F.lit(0), F.lit(n))


def days_in_month(c: Column) -> Column:
    return F.dayofmonth(F.last_day(c))


def is_leap_year(c: Column) -> Column:
    y = F.year(c)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def business_days(start: Column, end: Column) -> Column:
    """Weekdays from start to end, both included; 0 if end is before start. Closed form, no rows per day."""
    # days since Monday 1970-01-05; whole weeks have five
    index = lambda d: F.datediff(d, F.lit("1970-01-05").cast("date"))
    upto = lambda n: F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))
    return F.when(end < start, F.lit(0)).otherwise(upto(index(end) + 1) - upto(index(start))).cast("long")


def date_range(spark: SparkSession, start: str, end: str, step: str) -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(TIMESTAMP_NTZ '{start}', TIMESTAMP_NTZ '{end}', INTERVAL {step})) AS value")


def strftime(c: Column, form: str) -> Column:
    out, literal, k = "", "", 0
    while k < len(form):
        code = PATTERNS.get(form[k : k + 2])
        if code:
            out, literal, k = out + (f"'{literal}'" if literal else "") + code, "", k + 2
        else:
            literal, k = literal + form[k].replace("'", "''"), k + 1
    return F.date_format(c, out + (f"'{literal}'" if literal else ""))


def to_zone(c: Column, zone: str) -> Column:
    """The wall clock of a zone for a UTC time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), c)
