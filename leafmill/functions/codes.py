"""Codes of failures, delays before a new attempt, and clamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes by HTTP status, by kind of exception, and what a caller does about them.
STATUS_CODES = {401: "auth", 402: "audio_payment", 403: "auth", 429: "quota"}
RETRIED = ("APITimeoutError", "TimeoutError", "InternalServerError", "APIStatusError", "UnprocessableEntityError")
OFFLINE = ("APIConnectionError", "ConnectionError")


def status_code(status: Column) -> Column:
    """The code of a speech service's HTTP status."""
    out = F.lit("unknown")
    for k, v in STATUS_CODES.items():
        out = F.when(status == k, F.lit(v)).otherwise(out)
    return out


def exception_action(kind: Column, text: Column) -> Column:
    """retry, offline, auth, quota or unknown, by an exception's kind and text."""
    limited = F.when(text.contains("insufficient_quota"), F.lit("quota")).otherwise(F.lit("retry"))
    return (
        F.when(kind.isin(*OFFLINE), F.lit("offline"))
        .when(kind == "AuthenticationError", F.lit("auth"))
        .when(kind == "RateLimitError", limited)
        .when(kind == "BadRequestError", F.lit("unknown"))
        .otherwise(F.lit("retry"))
    )


def failure_category(kind: Column, text: Column, no_space: Column) -> Column:
    """The category that a user's message goes by."""
    return (
        F.when(kind == "AuthenticationError", F.lit("auth"))
        .when((kind == "RateLimitError") & text.contains("insufficient_quota"), F.lit("quota"))
        .when((kind == "PdfiumError") | kind.contains("PDF"), F.lit("bad_pdf"))
        .when(no_space, F.lit("disk_full"))
        .when(kind == "PermissionError", F.lit("output_locked"))
        .otherwise(F.lit("unknown"))
    )


def http_date(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(text, r"^\w+, (.*) GMT$", "$1"), F.lit("dd MMM yyyy HH:mm:ss"))


def retry_delay(header: Column, attempt: Column, now: Column) -> Column:
    """Seconds before a speech request is tried again, without the random part.

    A Retry-After header counts, as seconds or as a date, from 0 to 60; else it is
    2 to the power of attempt, 30 at most.
    """
    until = (F.unix_timestamp(http_date(header)) - F.unix_timestamp(now)).cast("double")
    given = F.coalesce(header.try_cast("double"), until)
    own = F.least(F.lit(30.0), F.pow(F.lit(2.0), attempt))
    return F.when(given.isNotNull(), F.least(F.lit(60.0), F.greatest(F.lit(0.0), given))).otherwise(own)


def backoff(attempts: Column, retry_after: Column) -> Column:
    """Seconds before a model is asked again, without the random part; attempts: failed so far, from 1."""
    own = F.least(F.lit(60.0), 2 * F.pow(F.lit(2.0), attempts - 1))
    return F.greatest(own, F.least(F.lit(120.0), F.coalesce(retry_after.try_cast("double"), F.lit(0.0))))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def frames_to_ms(frames: Column, rate: Column) -> Column:
    """Milliseconds, halves to even."""
    return F.bround(1000 * frames / rate).cast("long")


def with_messages(failures: DataFrame, messages: DataFrame) -> DataFrame:
    """failures (code) with message and action from messages (code, message, action); other codes get those of `unknown`."""
    known = F.broadcast(messages.select("code", "message", "action"))  # a row for each code
    rest = F.broadcast(messages.where("code = 'unknown'").select(F.col("code").alias("_rest"), F.col("message").alias("_m"), F.col("action").alias("_a")))
    out = failures.drop("message", "action").join(known, "code", "left").withColumn("_rest", F.lit("unknown")).join(rest, "_rest", "left")
    return out.withColumns({"message": F.coalesce("message", "_m"), "action": F.coalesce("action", "_a")}).drop("_m", "_a", "_rest")
