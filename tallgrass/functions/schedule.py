"""Calendar functions in a user's time zone; instants are epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a zone-less timestamp read as UTC, whatever the
    session's zone is."""
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    minutes = F.hour(ts) * 60 + F.minute(ts)
    return day * DAY_MS + minutes.cast("long") * 60_000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")


def local_wall(at_ms: Column, zone: Column) -> Column:
    """Zone-less wall clock of an instant in a zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.convert_timezone(F.lit("UTC"), zone, F.timestamp_add("MILLISECOND", at_ms, start))


def wall_to_ms(day: Column, wall: Column, zone: Column) -> Column:
    """Instant of ``wall``'s time of day on ``day`` in a zone. A skipped hour
    moves past the gap, a repeated hour takes its first instant."""
    made = F.make_timestamp(
        F.year(day), F.month(day), F.day(day), F.hour(wall), F.minute(wall),
        F.extract(F.lit("SECOND"), wall), zone,
    )
    return F.unix_millis(made)


def next_occurrence(at: Column, recurrence: Column, zone: Column, now: Column) -> Column:
    """First occurrence after ``now`` of a schedule begun at ``at``.

    Recurrences: once (never again), daily, weekly, weekdays. Candidates are
    calendar days at the first wall-clock time; eight are enough, since a
    weekend skips at most two days.
    """
    wall, today = local_wall(at, zone), local_wall(now, zone)
    step = F.when(recurrence == "weekly", 7).otherwise(1)
    gap = F.datediff(today.cast("date"), wall.cast("date"))
    weeks = F.greatest(F.lit(7), (F.ceil(F.greatest(F.lit(0), gap) / 7) * 7).cast("int"))
    days = F.when(at > now, 0).when(recurrence == "weekly", weeks).otherwise(F.greatest(F.lit(1), gap))
    tries = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.date_add(wall.cast("date"), (days + i * step).cast("int")),
    )
    usable = F.filter(tries, lambda d: (recurrence != "weekdays") | ~F.dayofweek(d).isin(1, 7))
    instants = F.transform(usable, lambda d: wall_to_ms(d, wall, zone))
    return F.when(
        recurrence.isin("daily", "weekly", "weekdays"), F.get(F.filter(instants, lambda t: t > now), F.lit(0))
    )


def days_ago(at: Column, now: Column, zone: Column) -> Column:
    """Calendar days between two instants in the user's zone."""
    return F.datediff(local_wall(now, zone).cast("date"), local_wall(at, zone).cast("date"))


def relative_day(days: Column) -> Column:
    """Spoken phrase for a number of days ago."""
    text = lambda c: c.cast("long").cast("string")
    return (
        F.when(days <= 0, "今天")
        .when(days == 1, "昨天")
        .when(days < 7, F.concat(text(days), F.lit(" 天前")))
        .when(days < 14, "上周")
        .when(days < 30, F.concat(text(F.floor(days / 7)), F.lit(" 周前")))
        .otherwise(F.concat(text(F.floor(days / 30)), F.lit(" 个月前")))
    )
