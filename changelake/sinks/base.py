"""What a destination is, and its errors."""

from __future__ import annotations

import logging
import re
from abc import ABC, abstractmethod
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

log = logging.getLogger("changelake")


class DestinationError(Exception):
    """An error with a typed retry flag, and a pause the destination asks for."""

    retryable = False
    retry_after: float | None = None


class ConnectionFailed(DestinationError):
    retryable = True


class CapacityError(DestinationError):
    retryable = True

    def __init__(self, message: str, retry_after: float | None = None):
        super().__init__(message)
        self.retry_after = retry_after


class SerializationError(DestinationError):
    pass


class ConfigurationError(DestinationError):
    pass


class WriteError(DestinationError):
    def __init__(self, message: str, retryable: bool):
        super().__init__(message)
        self.retryable = retryable


class UnknownError(DestinationError):
    pass


def classify(error: Exception) -> DestinationError:
    """A file system's error as a typed one."""
    if isinstance(error, DestinationError):
        return error
    text = str(error)
    low = text.lower()
    if any(w in low for w in ("slowdown", "throttl", "503", "too many requests")):
        return CapacityError(text)
    if any(w in low for w in ("timeout", "timed out", "connection", "unreachable", "socket")):
        return ConnectionFailed(text)
    if any(w in low for w in ("access denied", "accessdenied", "forbidden", "no such bucket", "permission")):
        return WriteError(text, retryable=False)
    return WriteError(text, retryable=any(w in low for w in ("internal error", "500", "502", "504")))


@dataclass(frozen=True)
class Metadata:
    name: str
    kind: str
    supports_transactions: bool = False
    max_batch_size: int | None = None
    supports_concurrent_writes: bool = False
    properties: dict[str, str] = field(default_factory=dict)


class Destination(ABC):
    """write_batch, flush, close.  Writing after close is an error; flush and close are not.

    ``limit`` is the most events a file or object holds; a pipeline sets it to its
    batch size where the destination has none of its own.
    """

    limit: int | None = None

    def __init__(self) -> None:
        self.closed = False

    @abstractmethod
    def _write(self, batch: DataFrame, epoch: int) -> None: ...

    @abstractmethod
    def metadata(self) -> Metadata: ...

    def write_batch(self, batch: DataFrame, epoch: int) -> None:
        if self.closed:
            raise WriteError("destination is closed", retryable=False)
        try:
            self._write(batch, epoch)
        except DestinationError:
            raise
        except Exception as e:
            raise classify(e) from e

    def flush(self) -> None:
        if self.closed:
            log.warning("flush after close")

    def close(self) -> None:
        if not self.closed:
            self.flush()
        self.closed = True

    def supports_transactions(self) -> bool:
        return False


@dataclass(frozen=True)
class BucketConfig:
    """An object store bucket, for ``s3a://`` paths."""

    bucket: str
    region: str
    prefix: str | None = None
    format: str = "json"
    compression: str = "none"
    key_strategy: str = "date_hour"
    max_retries: int = 3
    endpoint_url: str | None = None
    force_path_style: bool = False

    def __post_init__(self) -> None:
        if not 3 <= len(self.bucket) <= 63:
            raise ConfigurationError("bucket names have 3 to 63 characters")
        if not re.fullmatch(r"[a-z0-9.-]+", self.bucket):
            raise ConfigurationError("bucket names have lower-case letters, digits, hyphens and periods only")
        if not self.region:
            raise ConfigurationError("a region is needed")
        if self.prefix and (".." in self.prefix or self.prefix.startswith("/")):
            raise ConfigurationError("a prefix has no '..' and no leading '/'")

    def client(self) -> dict:
        """The options of pyarrow's S3 client."""
        out = {"region": self.region, "force_virtual_addressing": not self.force_path_style and self.endpoint_url is not None, "max_attempts": self.max_retries + 1}
        if self.endpoint_url:
            scheme, found, host = self.endpoint_url.partition("://")
            out |= {"endpoint_override": host if found else scheme, "scheme": scheme if found else "https"}
        return out

    def hadoop(self) -> dict[str, str]:
        """The options of Hadoop's S3A client, for destinations that Spark writes."""
        out = {"fs.s3a.endpoint.region": self.region, "fs.s3a.path.style.access": str(self.force_path_style).lower(), "fs.s3a.attempts.maximum": str(self.max_retries)}
        return out | ({"fs.s3a.endpoint": self.endpoint_url} if self.endpoint_url else {})

    @property
    def path(self) -> str:
        return f"s3a://{self.bucket}/{self.prefix or ''}".rstrip("/")
