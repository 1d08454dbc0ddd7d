"""Around external services: retries with growing pauses, a rate per process, and answers in code fences."""

from __future__ import annotations

import json
import random
import re
import threading
import time
from collections.abc import Callable


class Throttled(Exception):
    """A service asked to slow down; raised on when all attempts are used up."""


# Attempts, first pauses in seconds of chat and embedding calls, the longest pause, and the range of the jitter.
ATTEMPTS, CHAT_PAUSE, EMBED_PAUSE, LONGEST, JITTER = 6, 0.8, 0.4, 10.0, (0.05, 0.2)
# Calls a second in all, of annotation and of embedding.
RATES = {"all": 10.0, "annotate": 0.5, "embed": 8.0}


def pause(attempt: int, base: float = CHAT_PAUSE, jitter: float = 0.0) -> float:
    """Seconds before the attempt after number `attempt` (from 1)."""
    return min(LONGEST, base * 2 ** (attempt - 1) + jitter)


def retried(call: Callable, base: float = CHAT_PAUSE, sleep: Callable[[float], None] = time.sleep, attempts: int = ATTEMPTS) -> Callable:
    """`call`, tried again while it raises `Throttled`; other errors pass at once."""

    def run(*args, **kwargs):
        for attempt in range(1, attempts + 1):
            try:
                return call(*args, **kwargs)
            except Throttled:
                if attempt == attempts:
                    raise
                sleep(pause(attempt, base, random.uniform(*JITTER)))

    return run


class Rate:
    """Permits at an even rate in one process. With n tasks at once each process gets its share: `per_second / n`."""

    def __init__(self, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.step, self.clock, self.sleep = 1.0 / per_second, clock, sleep
        self.next, self.lock = clock(), threading.Lock()

    def take(self) -> None:
        with self.lock:
            now = self.clock()
            wait, self.next = max(0.0, self.next - now), max(self.next, now) + self.step
        if wait > 0:
            self.sleep(wait)

    def __getstate__(self) -> dict:
        return {"step": self.step}

    def __setstate__(self, state: dict) -> None:
        self.__init__(1.0 / state["step"])


def limited(call: Callable, *rates: Rate) -> Callable:
    """`call` after a permit of each rate."""

    def run(*args, **kwargs):
        for rate in rates:
            rate.take()
        return call(*args, **kwargs)

    return run


def parsed(call: Callable[..., str | None]) -> Callable:
    """`call`, whose answers are JSON, perhaps in a code fence, as values; an answer that isn't JSON is an error of its call."""

    def run(*args, **kwargs):
        text = unfenced(call(*args, **kwargs))
        return None if text is None else json.loads(text)

    return run


def unfenced(text: str | None) -> str | None:
    """An answer without the code fence, and its language's name, around it."""
    if text is None:
        return None
    text = text.strip()
    if len(text) >= 6 and text.startswith("```") and text.endswith("```"):
        text = text[3:-3].strip()
        first, _, rest = text.partition("\n")
        if rest and re.fullmatch(r"[A-Za-z0-9_-]+", first):
            text = rest.strip()
    return text
