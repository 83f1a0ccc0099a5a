"""Around an answer-writing service: pacing, bounded retries, choice of a backend, its contract.

A backend is any object with ``name``, ``available()`` and ``generate(question, evidence)`` that returns
a reply in the shape of ``answer.parse_answer``. Calls that cost money are made on the driver, one after
the other and once each (see ``answer.write_answers``), so one pace holds for a whole run.
"""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from gneiss.operators.answer import Generator

# What a service says when a call may be tried again, when it is busy, when its day is used up, and
# when it wants to be asked again; words that switch writing off.
TRANSIENT = ("429", "RESOURCE_EXHAUSTED", "503", "UNAVAILABLE", "overloaded", "504", "DEADLINE_EXCEEDED")
BUSY = ("503", "UNAVAILABLE")
DAILY = re.compile(r"PerDay|per day", re.IGNORECASE)
HINT = re.compile(r"retry in ([0-9.]+)s", re.IGNORECASE)
OFF = ("none", "off", "extractive")


class Backend(Protocol):
    name: str

    def available(self) -> bool: ...

    def generate(self, question: str, evidence: list[dict]) -> dict: ...


@dataclass(frozen=True)
class Policy:
    """What follows from failures, as numbers: nothing here waits or calls.

    A service that names a time is given that and a second more, at most ``longest``; one that is
    busy or limited without naming a time, a time of our own. Each wait is that times the number of
    failures so far. ``retries`` more tries are made, and none that would begin after ``budget`` seconds.
    """

    retries: int = 4
    budget: float = 90.0
    busy: float = 8.0
    limited: float = 30.0
    longest: float = 120.0

    def rest(self, said: str) -> float | None:
        """Seconds of rest that a failure calls for the first time; None if it is final."""
        if DAILY.search(said) or not any(mark in said for mark in TRANSIENT):
            return None
        if named := HINT.search(said):
            return min(float(named[1]) + 1, self.longest)
        return self.busy if any(mark in said for mark in BUSY) else self.limited

    def wait(self, failures: Sequence[str], spent: float) -> float | None:
        """Seconds until the next try after these failures and so many seconds; None to give up."""
        rest = self.rest(failures[-1])
        if rest is None or len(failures) > self.retries:
            return None
        wait = rest * len(failures)
        return wait if spent + wait <= self.budget else None


@dataclass
class Pace:
    """Carries a policy out, with the beginnings of calls at least ``interval`` seconds apart.

    Every call books the next free time and waits for it on its own, so that callers of several
    threads come one after the other.
    """

    interval: float = 13.0
    policy: Policy = Policy()
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _free: float = float("-inf")
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def _await_turn(self) -> None:
        with self._lock:
            now = self.clock()
            turn = max(now, self._free)
            self._free = turn + self.interval
        if turn > now:
            self.sleep(turn - now)

    def call(self, request: Callable[[], dict]) -> dict:
        failures: list[Exception] = []
        begun = self.clock()
        while True:
            self._await_turn()
            try:
                return request()
            except Exception as failure:  # noqa: BLE001 - the policy tells which are final
                failures.append(failure)
            wait = self.policy.wait([str(f) for f in failures], self.clock() - begun)
            if wait is None:
                raise failures[-1]
            self.sleep(wait)


def choose(backends: Sequence[Backend], wanted: str | None = None) -> Backend | None:
    """The first backend that is available, the one of a name, or none where it is switched off."""
    name = (wanted or "").strip().lower()
    if name in OFF:
        return None
    return next((b for b in backends if name in ("", b.name) and b.available()), None)


def available(backends: Sequence[Backend]) -> list[str]:
    return [b.name for b in backends if b.available()]


def from_environment(environment: Mapping[str, str], backends: Sequence[Backend] | None = None) -> Backend | None:
    """The backend that ``GNEISS_BACKEND`` names, or the first that has what it needs."""
    if backends is None:
        from gneiss.operators.backends import known

        backends = known(environment)
    return choose(backends, environment.get("GNEISS_BACKEND"))


def as_generator(backend: Backend | None, pace: Pace | None = None) -> Generator | None:
    """What ``api.answer`` takes: at the backend's own pace, or another, or as it is where it has none."""
    pace = pace or getattr(backend, "pace", None)
    if backend is None or pace is None:
        return backend and backend.generate
    return lambda question, evidence: pace.call(lambda: backend.generate(question, evidence))


def describe(backend: Backend | None) -> str:
    """What is configured, not what will have answered: that is told with each answer."""
    return f"generation enabled ({backend.name})" if backend else "generation off - answers excerpted from filings"
