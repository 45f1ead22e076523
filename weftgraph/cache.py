"""A bounded cache with expiry, for small results on the driver."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Iterable, Mapping
from typing import Any


class ResultCache:
    """Least recently used entries leave when it is full; entries older than ttl seconds are gone when next seen.

    encode and decode may turn values into what is held and back.
    """

    def __init__(self, capacity: int = 1000, ttl: float = 3600, encode: Callable[[Any], Any] | None = None, decode: Callable[[Any], Any] | None = None):
        if capacity < 1:
            raise ValueError("capacity must be positive")
        self.capacity, self.ttl = capacity, ttl
        self._encode, self._decode = encode or (lambda v: v), decode or (lambda v: v)
        self._held: OrderedDict[str, tuple[float, Any]] = OrderedDict()
        self._lock = threading.RLock()
        self.hits = self.misses = 0

    def _live(self, key: str) -> bool:
        at, _ = self._held[key]
        if time.monotonic() - at > self.ttl:
            del self._held[key]
            return False
        return True

    def get(self, key: str, default: Any = None) -> Any:
        with self._lock:
            if key not in self._held or not self._live(key):
                self.misses += 1
                return default
            self.hits += 1
            self._held.move_to_end(key)
            return self._decode(self._held[key][1])

    def put(self, key: str, value: Any) -> None:
        with self._lock:
            self._held.pop(key, None)
            while len(self._held) >= self.capacity:
                self._held.popitem(last=False)
            self._held[key] = (time.monotonic(), self._encode(value))

    def delete(self, key: str) -> bool:
        with self._lock:
            return self._held.pop(key, None) is not None

    def clear(self) -> None:
        with self._lock:
            self._held.clear()

    def get_many(self, keys: Iterable[str]) -> dict[str, Any]:
        gone = object()
        return {k: v for k in keys if (v := self.get(k, gone)) is not gone}

    def put_many(self, items: Mapping[str, Any]) -> None:
        for k, v in items.items():
            self.put(k, v)

    def size(self) -> int:
        with self._lock:
            return len(self._held)

    def cleanup_expired(self) -> int:
        with self._lock:
            return sum(not self._live(k) for k in list(self._held))

    def stats(self) -> dict[str, int]:
        return {"size": self.size(), "capacity": self.capacity, "hits": self.hits, "misses": self.misses}
