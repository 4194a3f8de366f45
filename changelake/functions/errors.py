"""Error classes, retry schedules and credential masking."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error codes and labels after which a stream may reconnect.
RETRYABLE_CODES = (6, 7, 43, 89, 91, 10107, 11600, 11602, 13435, 13436)
RETRYABLE_LABELS = ("RetryableWriteError", "TransientTransactionError", "NetworkError")
FATAL_CODE = 286
# Words that name an error's category, in order of precedence.
CATEGORIES = (
    ("timeout_error", ("timeout",)),
    ("connection_error", ("connection", "network")),
    ("serialization_error", ("serialization", "encode")),
    ("permission_error", ("permission", "auth")),
    ("validation_error", ("validation",)),
    ("not_found_error", ("not found", "404")),
    ("rate_limit_error", ("rate limit", "throttle")),
)


def category(message: Column) -> Column:
    """The first category that one of its words names; without regard to case."""
    low, out = F.lower(message), F.lit("unknown_error")
    for name, words in reversed(CATEGORIES):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def category_of(message: str) -> str:
    """As ``category``, of one text."""
    low = message.lower()
    return next((name for name, words in CATEGORIES if any(w in low for w in words)), "unknown_error")


@dataclass(frozen=True)
class StreamError:
    """What a source's error says of itself."""

    kind: str
    code: int | None = None
    labels: tuple[str, ...] = ()

    @property
    def retryable(self) -> bool:
        return self.kind == "connection" and self.code != FATAL_CODE and (self.code in RETRYABLE_CODES or any(x in RETRYABLE_LABELS for x in self.labels))

    @property
    def category(self) -> str:
        return "invalid_token" if self.kind == "connection" and self.code == FATAL_CODE else self.kind


_SOURCE_ERROR = re.compile(r"\[source error kind=(\w+) code=(\d*) labels=([\w,]*)\]")


def stream_error(message: str) -> StreamError | None:
    """The source error that a failed query's message carries, if it does."""
    found = _SOURCE_ERROR.search(message)
    return StreamError(found[1], int(found[2]) if found[2] else None, tuple(filter(None, found[3].split(",")))) if found else None


def stream_category(kind: Column, code: Column) -> Column:
    """The metric label of a source error: its kind, or ``invalid_token`` for the fatal code."""
    return F.when((kind == "connection") & (code == FATAL_CODE), "invalid_token").otherwise(kind)


def retryable(kind: Column, code: Column, labels: Column) -> Column:
    """Whether a source error allows a reconnect."""
    label = F.coalesce(F.arrays_overlap(labels, F.array(*[F.lit(x) for x in RETRYABLE_LABELS])), F.lit(False))
    return (kind == "connection") & F.coalesce(code != FATAL_CODE, F.lit(True)) & (label | F.coalesce(code.isin(*RETRYABLE_CODES), F.lit(False)))


def backoff_ms(attempt: Column, initial: int = 100, most: int = 30_000) -> Column:
    """Delay before reconnect ``attempt`` (from 1), without jitter."""
    return F.least(F.lit(float(most)), F.lit(float(initial)) * F.pow(F.lit(2.0), attempt - 1)).cast("long")


def backoff_schedule(attempts: int, initial: float, most: float, jitter: float = 0.0, rng=None) -> list[float]:
    """The delays of a run of attempts; jitter is the whole width as a share of a delay."""
    out = []
    for n in range(attempts):
        delay = min(most, initial * 2.0**n)
        out.append(max(0.0, delay + (rng.random() - 0.5) * jitter * delay) if rng else delay)
    return out


def mask_credentials(url: str) -> str:
    """A URL without its user and password."""
    try:
        parts = urlsplit(url)
        if not parts.scheme or not parts.netloc:
            raise ValueError(url)
        _ = parts.port
    except ValueError:
        scheme, found, rest = url.partition("://")
        return f"{scheme}://***.***" if found and "://" not in rest else "***.***"
    login, at, host = parts.netloc.rpartition("@")
    user, colon, _ = login.partition(":")
    shown = ("***" if user else "") + (":***" if colon else "")
    return urlunsplit(parts._replace(netloc=shown + at + host))
