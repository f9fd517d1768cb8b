"""Time columns: mail dates, look-back windows, durations and retry times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_rfc822(c: Column) -> Column:
    """Mail date as a timestamp; null where it isn't one."""
    bare = F.regexp_replace(c, r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")))


def format_rfc822(c: Column) -> Column:
    """A timestamp of a UTC session as a mail date."""
    return F.concat(F.date_format(c, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))


def local_date(c: Column, tz: str = "America/New_York") -> Column:
    return F.to_date(F.from_utc_timestamp(c, tz))


def in_lookback(date: Column, as_of: Column, days: int, tz: str = "America/New_York") -> Column:
    """True for dates of the last `days` calendar days in tz, the day of as_of included."""
    today = local_date(as_of, tz)
    return date.between(F.date_sub(today, days - 1), today)


def adaptive_days(days_since: Column, least: int = 2, most: int = 14) -> Column:
    """Days to look back: those since the last episode and one more, within bounds; the least without one."""
    return F.coalesce(F.least(F.greatest(F.lit(least), days_since + 1), F.lit(most)), F.lit(least)).cast("long")


def fmt_hms(seconds: Column) -> Column:
    """mm:ss, or hh:mm:ss from an hour on; null is 00:00."""
    s = F.coalesce(seconds.cast("long"), F.lit(0).cast("long"))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.concat_ws(":", F.lpad(h.cast("string"), F.greatest(F.lit(2), F.length(h.cast("string"))), F.lit("0")), two(m), two(r))).otherwise(F.concat_ws(":", two(m), two(r)))


def fmt_min_sec(seconds: Column) -> Column:
    """XmYYs; null stays null."""
    s = seconds.cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit("m"), F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"), F.lit("s"))


def backoff_minutes(failures: Column, most: int = 15) -> Column:
    """Minutes to wait after so many failures in a row: 1, 2, 4, 8, then most."""
    return F.least(F.lit(most), F.pow(F.lit(2), F.least(F.greatest(F.lit(0), failures - 1), F.lit(30))).cast("long")).cast("long")


def next_retry(failures: Column, failed_at: Column, limit: int = 51) -> Column:
    """(status, process_after) after a failure: errored with no next time from limit on, else pending."""
    spent = failures >= limit
    at = F.timestamp_seconds(F.unix_timestamp(failed_at) + backoff_minutes(failures) * 60)
    return F.struct(F.when(spent, "errored").otherwise("pending").alias("status"), F.when(~spent, at).alias("process_after"))
