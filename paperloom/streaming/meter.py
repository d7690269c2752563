"""Token meter: hour, day and total counters of a user, in batch and as a stream.

Events are (user_id, ts, field, tokens). `as_of` stands for the clock everywhere, so results repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

PRICES = {"embedding": 0.0007, "context": 0.0008, "generation": 0.002}  # for a thousand tokens
HOURS_KEPT, DAYS_KEPT, TOTAL_AFTER = 8, 31, 30  # days


def hourly(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "field", F.date_trunc("hour", "ts").alias("hour")).agg(F.sum("tokens").cast("long").alias("tokens"))


def daily(hours: DataFrame) -> DataFrame:
    """Hour counters to day counters of all fields together."""
    return hours.groupBy("user_id", F.date_trunc("day", "hour").alias("day")).agg(F.sum("tokens").cast("long").alias("tokens"))


def archived(days: DataFrame, as_of: Column) -> DataFrame:
    """(user_id, total) of the days that are TOTAL_AFTER days old or more."""
    old = F.col("day") <= F.date_trunc("day", as_of) - F.make_dt_interval(F.lit(TOTAL_AFTER))
    return days.filter(old).groupBy("user_id").agg(F.sum("tokens").cast("long").alias("total"))


def retained(rows: DataFrame, at: str, as_of: Column, days: int) -> DataFrame:
    return rows.filter(F.col(at) >= as_of - F.make_dt_interval(F.lit(days)))


def stats(events: DataFrame, as_of: Column, fields: tuple[str, ...] = tuple(PRICES), compat: bool = False) -> DataFrame:
    """One row for each user: tokens by field of the last 7 days, of days 7 to 30 together, and of all before.

    The three ranges meet without overlap. compat=True counts the whole day that holds `as_of - 7 days` in the middle
    range too, although its later hours are in the first.
    """
    week = as_of - F.make_dt_interval(F.lit(7))
    day = F.date_trunc("day", "ts")
    recent = (F.col("ts") >= week) & (F.col("ts") <= as_of)
    month = F.date_trunc("day", as_of) - F.make_dt_interval(F.lit(TOTAL_AFTER))
    middle = (day > month) & ((day <= F.date_trunc("day", week)) if compat else (F.col("ts") < week))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("tokens"))), F.lit(0)).cast("long")
    return events.groupBy("user_id").agg(
        *[total(recent & (F.col("field") == f)).alias(f"{f}_7d") for f in fields], total(middle).alias("days_7_to_30"), total(day <= month).alias("archived")
    )


def cost(embedding: Column, context: Column, generation: Column) -> Column:
    """Estimated cost, rounded half up at four decimals."""
    raw = (embedding * PRICES["embedding"] + context * PRICES["context"] + generation * PRICES["generation"]) / 1000.0
    return F.floor(raw * 10000 + 0.5) / 10000.0


def active_users(events: DataFrame) -> DataFrame:
    return events.select("user_id").distinct()


def hourly_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Hour counters of a stream: a window closes, once, when the watermark passes it."""
    watched = events.withWatermark("ts", late)
    return watched.groupBy("user_id", "field", F.window("ts", "1 hour").alias("w")).agg(F.sum("tokens").cast("long").alias("tokens")).select(
        "user_id", "field", F.col("w.start").alias("hour"), "tokens"
    )


def compacted(hours: DataFrame, days: DataFrame, done: DataFrame, hour: Column) -> tuple[DataFrame, DataFrame]:
    """(day counters with an hour's tokens added, hours done with it): nothing is added for an hour that is done already.

    hours: user_id, field, hour, tokens; days: user_id, day, tokens; done: user_id, hour.
    """
    due = hours.filter(F.col("hour") == F.date_trunc("hour", hour)).join(done, ["user_id", "hour"], "left_anti")
    sums = due.groupBy("user_id", F.date_trunc("day", "hour").alias("day")).agg(F.sum("tokens").cast("long").alias("tokens"))
    both = days.select("user_id", "day", "tokens").unionByName(sums)
    return both.groupBy("user_id", "day").agg(F.sum("tokens").cast("long").alias("tokens")), done.unionByName(due.select("user_id", "hour").dropDuplicates())


def counted(rows: DataFrame, observation: Observation, **tokens: Column) -> DataFrame:
    """rows unchanged, with running totals of token columns in an Observation: they are there once an action has run."""
    return rows.observe(observation, F.count("*").alias("rows"), *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(name) for name, c in tokens.items()])
