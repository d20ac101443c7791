"""M-18, W-10: a bounded queue of maintenance tasks, and bounded admission of ingest jobs."""

from __future__ import annotations

import threading
from collections import Counter, OrderedDict
from collections.abc import Callable, Hashable

#: Tasks waiting at most, and ingest jobs waiting at most (fixed values).
TASKS, INGESTS = 512, 64


class TaskQueue:
    """Tasks in order of arrival, each key at most once, at most ``cap`` waiting; a task that fails is counted and stops nothing.

    A key says what is to be done to what: (kind, partition, extra). What is refused is counted, by reason.
    """

    def __init__(self, cap: int = TASKS):
        self.cap, self.waiting, self.counts = cap, OrderedDict(), Counter()
        self._room = threading.Condition()

    def enqueue(self, key: Hashable, task: Callable[[], object]) -> bool:
        """Add a task unless its key waits already or the queue is full."""
        with self._room:
            if key in self.waiting:
                self.counts["repeated"] += 1
                return False
            if len(self.waiting) >= self.cap:
                self.counts["refused"] += 1
                return False
            self.waiting[key] = task
            self.counts["accepted"] += 1
            self._room.notify_all()
            return True

    def submit(self, key: Hashable, task: Callable[[], object], timeout_s: float | None = None) -> bool:
        """As :meth:`enqueue`, but wait for room."""
        with self._room:
            self._room.wait_for(lambda: len(self.waiting) < self.cap or key in self.waiting, timeout_s)
            return self.enqueue(key, task)

    def run(self, most: int | None = None) -> dict[str, int]:
        """Run what waits, or ``most`` of it, one by one; how many ended well and how many failed."""
        done = Counter()
        while most is None or sum(done.values()) < most:
            with self._room:
                if not self.waiting:
                    break
                key, task = self.waiting.popitem(last=False)
                self._room.notify_all()
            try:
                task()
                done["done"] += 1
            except Exception as e:  # noqa: BLE001 - isolation is the point
                done["failed"] += 1
                self.last_error = (key, repr(e))
        self.counts.update(done)
        return {"done": done["done"], "failed": done["failed"]}


    last_error: tuple | None = None
