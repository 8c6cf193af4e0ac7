"""What can go wrong, as codes that error rows carry and one exception that carries a code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Status by code.
STATUS = {
    "CONFIG_ERROR": 500,
    "DATABASE_ERROR": 500,
    "IDEMPOTENCY_CONFLICT": 409,
    "QUEUE_ERROR": 500,
    "TASK_NOT_FOUND": 404,
    "TASK_ALREADY_PROCESSING": 409,
    "RATE_LIMIT_EXCEEDED": 429,
    "CIRCUIT_BREAKER_OPEN": 503,
    "PDF_PARSING_ERROR": 400,
    "EMBEDDING_ERROR": 400,
    "VECTOR_INSERTION_ERROR": 400,
    "VALIDATION_ERROR": 422,
    "EXTERNAL_SERVICE_ERROR": 502,
    "TASK_TIMEOUT": 503,
    "INTEGRITY_ERROR": 409,
    "DUPLICATE_RESOURCE": 409,
}
#: Codes whose cause may pass by itself.
RETRYABLE = ("TASK_TIMEOUT",)


class EngineError(Exception):
    def __init__(self, code: str, message: str, **details):
        super().__init__(message)
        self.code, self.status, self.details = code, STATUS[code], details

    def as_row(self) -> dict:
        return {"code": self.code, "status": self.status, "message": str(self), "details": {k: str(v) for k, v in self.details.items()}}


def status_of(code: Column) -> Column:
    """500 for codes that aren't known."""
    out = F.lit(500)
    for known, status in STATUS.items():
        out = F.when(code == known, status).otherwise(out)
    return out
