"""Column functions on time.  Times are UTC without a zone; ages need an as_of."""

from pyspark.sql import functions as F

from recollect.functions.text import col

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
WEEK_US = 7 * DAY_US


def micros(ts):
    """Microseconds since the epoch of a zone-less UTC time."""
    return F.unix_micros(col(ts).cast("timestamp"))


def from_micros(us):
    return F.timestamp_micros(us).cast("timestamp_ntz")


def div(a, b):
    """Integer division that truncates towards zero."""
    return F.call_function("div", a, b if hasattr(b, "alias") else F.lit(b))


def fmt_ts(ts):
    """Date and clock time."""
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss")


def fmt_hm(ts, zone="UTC"):
    """Clock time in the reader's zone."""
    return F.date_format(to_local(ts, zone), "HH:mm")


def to_local(ts, zone):
    if zone == "UTC":
        return col(ts)
    return F.from_utc_timestamp(col(ts).cast("timestamp"), zone).cast("timestamp_ntz")


def to_utc(ts, zone):
    if zone == "UTC":
        return col(ts)
    return F.to_utc_timestamp(col(ts).cast("timestamp"), zone).cast("timestamp_ntz")


def age_seconds(ts, as_of):
    return div(micros(as_of) - micros(ts), F.lit(1_000_000).cast("long"))


def rel_age(ts, as_of):
    """Readable age."""
    s = age_seconds(ts, as_of)

    def count(unit):
        return div(s, F.lit(unit).cast("long")).cast("string")

    return (F.when(s < 90, F.lit("just now"))
            .when(s < 3600, F.concat(count(60), F.lit(" min ago")))
            .when(s < 86400, F.concat(count(3600), F.lit(" h ago")))
            .when(s < 172800, F.lit("yesterday"))
            .otherwise(F.concat(count(86400), F.lit(" d ago"))))


def when_word(ts, as_of):
    """Relative day as a sentence opener."""
    s = age_seconds(ts, as_of)
    return (F.when(s < 86400, F.lit("Today")).when(s < 172800, F.lit("Yesterday"))
            .otherwise(F.lit("Recently")))


def hour_bucket(ts):
    """C4: hours since the epoch, truncated towards zero."""
    return div(micros(ts), F.lit(HOUR_US).cast("long"))


def week_bucket(ts):
    """C4: epoch weeks (they begin on Thursday), truncated towards zero."""
    return div(micros(ts), F.lit(WEEK_US).cast("long"))


def local_midnight_cutoff(as_of, days, zone="UTC"):
    """Start of the local day, moved back by (days - 1) times 24 hours."""
    midnight = to_utc(F.date_trunc("day", to_local(as_of, zone)).cast("timestamp_ntz"), zone)
    return from_micros(micros(midnight) - F.greatest(F.lit(days) - 1, F.lit(0)).cast("long") * DAY_US)
