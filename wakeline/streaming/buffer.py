"""A bounded buffer between a connector and its reader, with dedup and backpressure."""

from __future__ import annotations

import threading
from collections import deque

from wakeline.streaming.dedup import KEY, RollingKeys
from wakeline.streaming.stats import Health, StreamConfig, StreamStats


class MessageBuffer:
    """Connectors put, readers take; repeats go at once, a full buffer blocks or drops its oldest."""

    def __init__(self, config: StreamConfig | None = None):
        self.config = config or StreamConfig()
        if errors := self.config.validate():
            raise ValueError("; ".join(errors))
        self.health = Health(self.config)
        self.stats: StreamStats = self.health.stats
        self._keys, self._held, self._wake = RollingKeys(self.config.dedup_window), deque(), threading.Condition()
        self._open = True

    def put(self, message: dict, timeout: float | None = None) -> bool:
        """Whether the message is in the buffer now."""
        with self._wake:
            self.stats.received += 1
            self.health.message()
            if self._keys.seen(tuple(message.get(k) for k in KEY)):
                self.stats.deduplicated += 1
                return False
            if len(self._held) >= self.config.max_queue:
                self.stats.backpressure_events += 1
                if self.config.backpressure == "drop_oldest":
                    self._held.popleft()
                    self.stats.dropped += 1
                elif not self._wake.wait_for(lambda: len(self._held) < self.config.max_queue or not self._open, timeout):
                    self.stats.dropped += 1
                    return False
            self._held.append(message)
            self._wake.notify_all()
            return True

    def take(self, most: int | None = None, timeout: float | None = 0) -> list[dict]:
        with self._wake:
            if timeout:
                self._wake.wait_for(lambda: self._held or not self._open, timeout)
            out = [self._held.popleft() for _ in range(min(most or self.config.batch_size, len(self._held)))]
            self.stats.delivered += len(out)
            self._wake.notify_all()
            return out

    def close(self) -> None:
        with self._wake:
            self._open = self.health.running = False
            self._wake.notify_all()

    def __iter__(self):
        """Messages until the buffer is closed and empty."""
        while self._open or self._held:
            yield from self.take(timeout=0.05)
