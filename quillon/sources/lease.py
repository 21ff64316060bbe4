"""A request budget that many processes share: send slots in a folder, each taken by whoever first creates its file.

Slot files are numbered; file n holds the time (milliseconds) of the n-th reservation. To reserve is to read the last one, to claim
max(last + interval, now) and to create the next file, which fails where it exists: then another process was first, and the claim is
made again behind it. So slots are distinct and in order of arrival, whatever the processes. A last slot of more than an hour ago counts
no more. Where the folder can't be reached, a limiter of this process alone takes over.

The folder has to be one that all processes reach by a path (a mounted one); creating a file there is exclusive. Clocks of the hosts are
taken as equal to within the guard time.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from quillon.operators.ratebudget import GUARD_MS, Limiter

TTL_S, KEPT = 3600, 8


class SharedLimiter:
    """reserve() takes the next slot and returns the seconds to wait for it; wait() sleeps them. clock gives seconds since the epoch."""

    def __init__(self, folder: str, interval_s: float, guard_s: float = GUARD_MS / 1000, ttl_s: float = TTL_S, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.folder, self.step, self.ttl, self.clock, self.sleep = folder, round(1000 * (interval_s + guard_s)), 1000 * ttl_s, clock, sleep
        self.local = Limiter(interval_s, guard_s, clock, sleep)
        self.fell_back = 0

    def _last(self) -> tuple[int, int | None]:
        """(number, time) of the last slot."""
        numbers = [int(x) for x in os.listdir(self.folder) if x.isdigit()]
        if not numbers:
            return -1, None
        with open(f"{self.folder}/{max(numbers):020d}") as f:
            return max(numbers), int(f.read())

    def _take(self, number: int, slot: int) -> bool:
        """Creates a slot's file, whole, unless it is there."""
        aside = f"{self.folder}/.{os.getpid()}-{time.monotonic_ns()}"
        with open(aside, "x") as f:
            f.write(str(slot))
        try:
            os.link(aside, f"{self.folder}/{number:020d}")  # fails where the name is taken
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(aside)

    def reserve(self) -> float:
        try:
            os.makedirs(self.folder, exist_ok=True)
            while True:
                number, last = self._last()
                now = round(1000 * self.clock())
                slot = now if last is None or last < now - self.ttl else max(last + self.step, now)
                if self._take(number + 1, slot):
                    self._forget(number + 1 - KEPT)
                    return max(0, slot - now) / 1000
        except OSError:
            self.fell_back += 1
            return self.local.reserve()

    def _forget(self, before: int) -> None:
        for x in os.listdir(self.folder):
            if x.isdigit() and int(x) <= before:
                try:
                    os.unlink(f"{self.folder}/{x}")
                except FileNotFoundError:  # another process was first
                    pass

    def wait(self) -> float:
        pause = self.reserve()
        if pause > 0:
            self.sleep(pause)
        return pause
