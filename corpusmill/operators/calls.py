"""Calls of outside generators: retries with growing waits, and limits of a rate. Both wrap any generator, a function
from a prompt and a text to a reply, and run in Python workers; clock and sleep are parameters, so that tests don't wait."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable

#: What tells errors of a rate and of the network from others; seconds of the first wait after each.
RATE_SIGNS, NETWORK_SIGNS = ("429", "quota", "rate limit"), ("SSL", "EOF", "connection", "timeout", "network")
RATE_WAIT, NETWORK_WAIT, TRIES = 10.0, 5.0, 3
DAY, MINUTE = 86_400.0, 60.0


class DailyLimit(RuntimeError):
    """No more calls today."""


class Limiter:
    """Keeps calls of one process apart by `gap` seconds and within limits a minute and a day (of UTC)."""

    def __init__(self, gap: float = 12.0, a_minute: int = 5, a_day: int = 20, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.a_minute, self.a_day, self.clock, self.sleep = gap, a_minute, a_day, clock, sleep
        self.last, self.recent, self.today = float("-inf"), deque(), (None, 0)

    def wait(self) -> None:
        now = self.clock()
        day, used = self.today
        used = used if day == now // DAY else 0
        if used >= self.a_day:
            raise DailyLimit(f"{self.a_day} calls have been made today")
        while self.recent and now - self.recent[0] >= MINUTE:
            self.recent.popleft()
        if len(self.recent) >= self.a_minute:
            self.sleep(MINUTE - (now - self.recent[0]) + 1)
            now = self.clock()
        if now - self.last < self.gap:
            self.sleep(self.gap - (now - self.last))
            now = self.clock()
        self.last, self.today = now, (now // DAY, used + 1)
        self.recent.append(now)


def first_wait(error: Exception) -> float | None:
    """Seconds before the second try, or None for an error that another try doesn't help."""
    said = str(error)
    if any(s in said or s in said.lower() for s in RATE_SIGNS):
        return RATE_WAIT
    return NETWORK_WAIT if any(s in said for s in NETWORK_SIGNS) else None


def retrying(generator: Callable[[str, str], str], tries: int = TRIES, limiter: Limiter | None = None, sleep: Callable[[float], None] = time.sleep) -> Callable[[str, str], str]:
    """A generator that waits for the limiter and calls again after errors of the rate or the network, twice as late each
    time. The last error is raised, others at once."""

    def call(prompt: str, text: str) -> str:
        if limiter is not None:
            limiter.wait()
        for k in range(tries):
            try:
                return generator(prompt, text) or ""
            except Exception as error:
                wait = first_wait(error)
                if wait is None or k == tries - 1:
                    raise
                sleep(wait * 2**k)
        raise RuntimeError("no tries")

    return call
