"""The states of a stream that loses its source: active, reconnecting, closed."""

from __future__ import annotations

import random
from collections.abc import Callable

from changelake.functions.errors import StreamError, backoff_schedule, stream_error
from changelake.streaming.config import StreamConfig


class ReconnectsExceeded(RuntimeError):
    pass


class Reconnector:
    """Decides after each failure whether and when a stream is opened again.

    Failed openings in a row count as attempts; the first event after one sets
    them back.  Only errors of a source that allow it lead to an attempt.
    """

    def __init__(self, config: StreamConfig, rng: random.Random | None = None):
        self.config, self.rng = config, rng or random.Random()
        self.state, self.attempts = "active", 0

    def active(self) -> None:
        """The stream delivers."""
        if self.state != "closed":
            self.state, self.attempts = "active", 0

    def close(self) -> None:
        self.state = "closed"

    def failed(self, error: Exception | StreamError) -> float:
        """The seconds to wait before the next opening; raises where there is none."""
        known = error if isinstance(error, StreamError) else stream_error(str(error))
        if self.state == "closed" or known is None or not known.retryable:
            self.state = "closed"
            raise error if isinstance(error, Exception) else RuntimeError(known.category)
        self.attempts += 1
        most = self.config.max_reconnect_attempts
        if most and self.attempts > most:
            self.state = "closed"
            raise ReconnectsExceeded(f"no connection after {most} attempts") from (error if isinstance(error, Exception) else None)
        self.state = "reconnecting"
        n = min(self.attempts, 63)  # beyond, the longest delay holds anyway
        return backoff_schedule(n, self.config.initial_backoff, self.config.max_backoff, self.config.jitter, self.rng)[-1]


def keep_open(open_: Callable[[], None], wait: Callable[[], None], reconnector: Reconnector, sleep: Callable[[float], bool]) -> None:
    """Open and wait until the stream ends by itself; after errors open again by the reconnector's word.

    ``sleep`` pauses, and tells whether the stream was told to stop meanwhile.
    """
    while True:
        try:
            open_()
            return wait()
        except Exception as e:
            if sleep(reconnector.failed(e)):
                return
