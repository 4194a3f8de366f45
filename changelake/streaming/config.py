"""Validated settings; durations are seconds."""

from __future__ import annotations

from dataclasses import dataclass, field


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class WatchLevel:
    """Some collections, a database (the default), or a whole deployment."""

    kind: str = "database"
    collections: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in ("collection", "database", "deployment"):
            raise ConfigError(f"unknown watch level {self.kind}")

    def description(self) -> str:
        from changelake.sources.replay import describe_level

        return describe_level(self.kind, list(self.collections))

    def resume_token_key(self, database: str, collection: str | None = None) -> str:
        if self.kind == "collection":
            return ":".join(["resume_token", database, *([collection] if collection else [])])
        return f"resume_token:database:{database}" if self.kind == "database" else "resume_token:deployment"

    def lock_key(self, database: str, collection: str | None = None, prefix: str = "changelake:lock") -> str:
        return f"{prefix}:{database}:{collection if self.kind == 'collection' else f'__{self.kind}__'}"


@dataclass(frozen=True)
class StreamConfig:
    """How a source reconnects, and what it does to events; 0 attempts means without end.

    full_document_on_update fills updates with the last version of the document,
    and full_document_before_change adds the version before each event.  Where
    ``images`` is "source", the source has done so already; where it is "state",
    the stream keeps the last version of every document as its own state.
    stop_on_invalidate ends a watched collection at its first invalidate.
    """

    initial_backoff: float = 0.1
    max_backoff: float = 30.0
    max_reconnect_attempts: int = 5
    jitter: float = 0.1
    full_document_on_update: bool = True
    full_document_before_change: bool = False
    batch_size: int | None = None
    pipeline: tuple[dict, ...] = ()
    images: str = "source"
    stop_on_invalidate: bool = True

    def __post_init__(self) -> None:
        if self.images not in ("source", "state"):
            raise ConfigError("images must be source or state")
        if self.batch_size is not None and self.batch_size < 1:
            raise ConfigError("batch_size must be above 0")
        if self.initial_backoff <= 0:
            raise ConfigError("initial_backoff must be above 0")
        if self.initial_backoff > self.max_backoff:
            raise ConfigError("initial_backoff must not exceed max_backoff")
        if not 0 <= self.jitter <= 1:
            raise ConfigError("jitter must be from 0 to 1")


@dataclass(frozen=True)
class LockConfig:
    enabled: bool = True
    ttl: float = 30.0
    refresh_interval: float = 10.0
    retry_interval: float = 5.0

    def __post_init__(self) -> None:
        if self.ttl < 1:
            raise ConfigError("ttl must be at least a second")
        if self.refresh_interval >= self.ttl:
            raise ConfigError("refresh_interval must be less than ttl")


@dataclass(frozen=True)
class PipelineConfig:
    """Zeros take the defaults; no retries unless asked for.

    batch_size is the most events of a collection that a batch, and so an object,
    holds; batch_timeout is the longest that an event waits for its batch.
    """

    database: str
    watch_level: WatchLevel = WatchLevel()
    batch_size: int = 0
    batch_timeout: float = 0.0
    max_retries: int = 0
    retry_delay: float = 0.0
    max_retry_delay: float = 0.0
    stream: StreamConfig = field(default_factory=StreamConfig)
    lock: LockConfig = field(default_factory=LockConfig)

    def __post_init__(self) -> None:
        if not self.database:
            raise ConfigError("a database is needed")
        if self.batch_size > 10_000:
            raise ConfigError("batch_size exceeds 10,000")
        for name, default in (("batch_size", 100), ("batch_timeout", 5.0), ("retry_delay", 0.1), ("max_retry_delay", 30.0)):
            if not getattr(self, name):
                object.__setattr__(self, name, default)
        if self.retry_delay > self.max_retry_delay:
            raise ConfigError("retry_delay must not exceed max_retry_delay")
        if self.watch_level.kind == "collection" and not self.watch_level.collections:
            raise ConfigError("watching collections needs their names")
