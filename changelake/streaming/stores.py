"""Resume token stores and leases, kept by the driver."""

from __future__ import annotations

import json
import os
import threading
import time
from abc import ABC, abstractmethod
from collections.abc import Callable
from pathlib import Path


class StateStore(ABC):
    """Tokens by key, and leases with a time to live."""

    @abstractmethod
    def save(self, key: str, token: str) -> None: ...

    @abstractmethod
    def get(self, key: str) -> str | None: ...

    @abstractmethod
    def delete(self, key: str) -> None: ...

    @abstractmethod
    def keys(self) -> list[str]: ...

    @abstractmethod
    def acquire(self, key: str, owner: str, ttl: float) -> bool: ...

    @abstractmethod
    def refresh(self, key: str, owner: str, ttl: float) -> bool: ...

    @abstractmethod
    def release(self, key: str, owner: str) -> bool: ...

    @abstractmethod
    def holder(self, key: str) -> str | None: ...

    def is_locked(self, key: str) -> bool:
        return self.holder(key) is not None

    def close(self) -> None:
        """Nothing to close unless a store says so."""


class MemoryStore(StateStore):
    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.tokens: dict[str, str] = {}
        self.leases: dict[str, tuple[str, float]] = {}
        self.clock, self.guard = clock, threading.RLock()

    def save(self, key, token):
        with self.guard:
            self.tokens[key] = token

    def get(self, key):
        return self.tokens.get(key)

    def delete(self, key):
        with self.guard:
            self.tokens.pop(key, None)

    def keys(self):
        return sorted(self.tokens)

    def holder(self, key):
        with self.guard:
            owner, until = self.leases.get(key, (None, 0))
            return owner if owner is not None and self.clock() < until else None

    def acquire(self, key, owner, ttl):
        with self.guard:
            if self.holder(key) is not None:
                return False
            self.leases[key] = owner, self.clock() + ttl
            return True

    def refresh(self, key, owner, ttl):
        with self.guard:
            if self.holder(key) != owner:
                return False
            self.leases[key] = owner, self.clock() + ttl
            return True

    def release(self, key, owner):
        with self.guard:
            if self.holder(key) != owner:
                return False
            del self.leases[key]
            return True


class FileStore(StateStore):
    """A folder of small files; changes go through a lock file and a rename."""

    def __init__(self, folder: str, clock: Callable[[], float] = time.time):
        self.folder, self.clock = Path(folder), clock
        for d in ("tokens", "leases"):
            (self.folder / d).mkdir(parents=True, exist_ok=True)

    def _path(self, kind: str, key: str) -> Path:
        return self.folder / kind / key.encode().hex()

    def _put(self, path: Path, text: str) -> None:
        part = path.with_suffix(f".{os.getpid()}.{threading.get_ident()}")
        part.write_text(text)
        os.replace(part, path)

    def save(self, key, token):
        self._put(self._path("tokens", key), token)

    def get(self, key):
        try:
            return self._path("tokens", key).read_text()
        except FileNotFoundError:
            return None

    def delete(self, key):
        self._path("tokens", key).unlink(missing_ok=True)

    def keys(self):
        return sorted(bytes.fromhex(p.name).decode() for p in (self.folder / "tokens").iterdir() if not p.suffix)

    def _guarded(self, key: str, change: Callable[[], bool]) -> bool:
        guard = self._path("leases", key).with_suffix(".guard")
        for _ in range(200):
            try:
                os.close(os.open(guard, os.O_CREAT | os.O_EXCL))
                break
            except FileExistsError:
                try:  # left by a process that died
                    if time.time() - guard.stat().st_mtime > 10:
                        guard.unlink(missing_ok=True)
                except FileNotFoundError:
                    pass
                time.sleep(0.01)
        else:
            return False
        try:
            return change()
        finally:
            guard.unlink(missing_ok=True)

    def holder(self, key):
        try:
            lease = json.loads(self._path("leases", key).read_text())
        except FileNotFoundError:
            return None
        return lease["owner"] if self.clock() < lease["until"] else None

    def _lease(self, key, owner, ttl):
        self._put(self._path("leases", key), json.dumps({"owner": owner, "until": self.clock() + ttl}))
        return True

    def acquire(self, key, owner, ttl):
        return self._guarded(key, lambda: self.holder(key) is None and self._lease(key, owner, ttl))

    def refresh(self, key, owner, ttl):
        return self._guarded(key, lambda: self.holder(key) == owner and self._lease(key, owner, ttl))

    def release(self, key, owner):
        return self._guarded(key, lambda: self.holder(key) == owner and (self._path("leases", key).unlink(missing_ok=True) or True))


class KeyValueStore(StateStore):
    """Over a client with Redis-like ``get set delete scan_iter eval``; none is bundled.

    Owner checks run in the server by script, so they are atomic.
    """

    REFRESH = "if redis.call('get', KEYS[1]) == ARGV[1] then return redis.call('expire', KEYS[1], ARGV[2]) else return 0 end"
    RELEASE = "if redis.call('get', KEYS[1]) == ARGV[1] then return redis.call('del', KEYS[1]) else return 0 end"

    def __init__(self, client, prefix: str = "changelake", token_ttl: int | None = None):
        self.client, self.prefix, self.token_ttl = client, prefix, token_ttl

    def _text(self, v):
        return v.decode() if isinstance(v, bytes) else v

    def save(self, key, token):
        self.client.set(f"{self.prefix}:{key}", token, ex=self.token_ttl)

    def get(self, key):
        return self._text(self.client.get(f"{self.prefix}:{key}"))

    def delete(self, key):
        self.client.delete(f"{self.prefix}:{key}")

    def keys(self):
        return sorted(self._text(k).removeprefix(f"{self.prefix}:") for k in self.client.scan_iter(match=f"{self.prefix}:resume_token*"))

    def acquire(self, key, owner, ttl):
        return bool(self.client.set(key, owner, nx=True, ex=max(1, int(ttl))))

    def refresh(self, key, owner, ttl):
        return bool(self.client.eval(self.REFRESH, 1, key, owner, max(1, int(ttl))))

    def release(self, key, owner):
        return bool(self.client.eval(self.RELEASE, 1, key, owner))

    def holder(self, key):
        return self._text(self.client.get(key))


class LeaseKeeper:
    """Refreshes a lease from a thread; calls ``lost`` once when it is gone, and ``refreshed_one`` after each refresh."""

    def __init__(self, store: StateStore, key: str, owner: str, ttl: float, interval: float, lost: Callable[[], None], refreshed_one: Callable[[], None] = lambda: None):
        self.store, self.key, self.owner, self.ttl, self.interval, self.lost, self.refreshed_one = store, key, owner, ttl, interval, lost, refreshed_one
        self.done = threading.Event()
        self.refreshed = 0
        self.thread = threading.Thread(target=self._run, daemon=True)

    def start(self) -> LeaseKeeper:
        self.thread.start()
        return self

    def _run(self) -> None:
        until = time.monotonic() + self.ttl
        while not self.done.wait(self.interval):
            try:
                kept = self.store.refresh(self.key, self.owner, self.ttl)
            except Exception:  # the store is out of reach: the lease stands until its time is up
                if time.monotonic() < until:
                    continue
                kept = False
            if not kept:
                self.lost()
                return
            until = time.monotonic() + self.ttl
            self.refreshed += 1
            self.refreshed_one()

    def stop(self) -> bool:
        """Stop refreshing and give the lease back; whether it was still held."""
        self.done.set()
        if self.thread is not threading.current_thread():
            self.thread.join(timeout=5)
        return self.store.release(self.key, self.owner)
