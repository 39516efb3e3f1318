"""Error codes and what is reported of failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Error codes with HTTP status and message.
CODES = (
    ("APP_ERROR", 500, "An error occurred"),
    ("NOT_FOUND", 404, "Resource not found"),
    ("ALREADY_EXISTS", 409, "Resource already exists"),
    ("VALIDATION_ERROR", 422, "Validation error"),
    ("AUTHENTICATION_ERROR", 401, "Authentication failed"),
    ("AUTHORIZATION_ERROR", 403, "Insufficient permissions"),
    ("RATE_LIMIT_EXCEEDED", 429, "Rate limit exceeded"),
    ("BAD_REQUEST", 400, "Bad request"),
    ("PAYMENT_REQUIRED", 402, "Payment required"),
    ("EXTERNAL_SERVICE_ERROR", 503, "External service unavailable"),
    ("DATABASE_ERROR", 500, "Database error"),
    ("INTERNAL_ERROR", 500, "Internal server error"),
)
# Status texts of these statuses.
STATUS_TEXTS = {
    400: "Bad Request",
    401: "Unauthorized",
    402: "Payment Required",
    403: "Forbidden",
    404: "Not Found",
    409: "Conflict",
    422: "Unprocessable Content",
    429: "Too Many Requests",
    500: "Internal Server Error",
    503: "Service Unavailable",
}


def error_dimension(spark: SparkSession, texts: dict[int, str] | None = None) -> DataFrame:
    """``status, code, message, status_text`` for each code; ``texts`` overrides status texts."""
    named = STATUS_TEXTS | (texts or {})
    rows = [(status, code, message, named[status]) for code, status, message in CODES]
    return spark.createDataFrame(rows, "status int, code string, message string, status_text string")


def failure_counts(failures: DataFrame) -> DataFrame:
    """Failures per code and severity; details of server errors are dropped, the others' are counted."""
    severity = F.when(F.col("status") >= 500, "error").otherwise("warning")
    shown = F.when(F.col("status") < 500, F.col("details"))
    return failures.groupBy("code", severity.alias("severity")).agg(F.count("*").alias("n"), F.count(shown).alias("with_details"))
