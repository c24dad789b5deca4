"""Requests as rows: when each may start, how long a refused one waits, and what a domain's time still allows.

Times are seconds on one clock, as doubles. Nothing here sleeps or asks: a wait is a later start in the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Less time than LEAST is none; the first wait, the longest one, and how much chance adds to it.
LEAST, FIRST_WAIT, LONGEST_WAIT, SPREAD = 0.05, 0.5, 8.0, 0.2


def asked_wait(retry_after: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks for, as a number or a date; null where it says neither."""
    day = F.regexp_extract(retry_after, r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    at = F.unix_timestamp(F.try_to_timestamp(F.when(day != "", F.lpad(day, 20, "0")), F.lit("dd MMM yyyy HH:mm:ss")))
    number = retry_after.try_cast("double")
    seconds = F.coalesce(F.when(~F.isnan(number), number), at - now)
    return F.when((retry_after != "") & seconds.isNotNull(), F.greatest(F.lit(0.0), seconds))


def wait(attempt: Column, retry_after: Column, now: Column, key: Column) -> Column:
    """Seconds before another attempt: what was asked for, else twice as long each time. What chance adds depends on key and attempt only."""
    chance = F.pmod(F.xxhash64(key, attempt), F.lit(1000)) / 1000.0 * SPREAD
    return F.coalesce(asked_wait(retry_after, now), F.least(F.lit(LONGEST_WAIT), FIRST_WAIT * F.pow(F.lit(2.0), attempt)) + chance)


def left(budget: float, spent: Column) -> Column:
    """What a domain's time still has."""
    return F.greatest(F.lit(0.0), F.lit(float(budget)) - spent)


def paced(requests: DataFrame, now: float, by: str = "origin", order: str = "id") -> DataFrame:
    """requests with start: those of an origin begin at least its delay apart, the first one delay after now, none before not_before.

    requests: by, order, delay and not_before. A start is the largest, over the requests up to it, of when one might have begun plus the
    delays since, which running sums and a running maximum give. One origin's requests are one task's, as they are when they are made.
    """
    w = Window.partitionBy(by).orderBy("not_before", order)
    run = requests.withColumn("__sum", F.sum("delay").over(w))
    base = F.greatest(F.col("not_before"), F.lit(float(now)) + F.col("delay"))
    return run.withColumn("start", F.col("__sum") + F.max(base - F.col("__sum")).over(w)).drop("__sum")
