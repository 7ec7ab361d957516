"""The part of a server's health that depends on the order of all its requests.

Failures, batch size and poll multiplier follow from each other step by step, so a plain
aggregate cannot give them. A server may own a large share of all requests, so its history
must not meet in one task either. The history is range-partitioned by (server, time); each
piece is reduced to a *summary*, a description of what the piece does to any state, and the
few summaries of a server (one per partition it spans) are applied in order.

What makes a summary small:
* a failure count matters only up to the exclusion threshold, so there are few start values;
* batch size takes few values (those reachable from the default), so a piece is a step map;
* the multiplier is only scaled and clamped, and such maps compose to `clamp(m * k)`;
* successes before the first limit of a piece depend on the previous limit's time only in
  how many of them come late enough, and more than `steps` recoveries change nothing.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from fractions import Fraction

from certlake.functions.health import (
    EXCLUDE_FROM,
    LIFTED_MULTIPLIER,
    MAX_MULTIPLIER,
    MIN_BATCH_SIZE,
    QUIET_MICROS,
    SHRINK_FROM,
    SLOW_FROM,
)


def shrink(batch: int) -> int:
    return max(MIN_BATCH_SIZE, batch // 2) if batch > MIN_BATCH_SIZE else batch


def grow(batch: int, default: int) -> int:
    return min(default, batch * 5 // 4) if batch < default else batch


def slow(multiplier: float) -> float:
    return min(MAX_MULTIPLIER, multiplier * 2)


def quicken(multiplier: float) -> float:
    return max(1.0, multiplier * 0.75)


def lifted_batch(default: int) -> int:
    return max(MIN_BATCH_SIZE, default // 4)


def reachable_batches(default: int) -> list[int]:
    seen, todo = set(), [default, lifted_batch(default)]
    while todo:
        batch = todo.pop()
        if batch not in seen:
            seen.add(batch)
            todo += [shrink(batch), grow(batch, default)]
    return sorted(seen)


def recovery_steps(default: int) -> int:
    """Recoveries after which any state is back at the defaults."""
    batch, multiplier, steps = min(MIN_BATCH_SIZE, default), MAX_MULTIPLIER, 0
    while grow(batch, default) != batch or multiplier > 1.0:
        batch, multiplier, steps = grow(batch, default), quicken(multiplier), steps + 1
    return steps


class Effect:
    """What a run of requests does to (batch, multiplier), for any start."""

    __slots__ = ("starts", "batches", "twos", "threes", "low", "high")

    def __init__(self, batches):
        self.starts, self.batches = list(batches), list(batches)
        self.twos, self.threes, self.low, self.high = 0, 0, 1.0, MAX_MULTIPLIER

    def set_to(self, batch, multiplier):
        self.starts, self.batches = [0], [batch]
        self.twos, self.threes, self.low, self.high = 0, 0, multiplier, multiplier

    def _map_batch(self, step):
        if len(self.batches) == 1:
            self.batches[0] = step(self.batches[0])
            return
        starts, out = [], []
        for start, batch in zip(self.starts, self.batches):
            batch = step(batch)
            if not out or out[-1] != batch:
                starts.append(start)
                out.append(batch)
        self.starts, self.batches = starts, out

    def _settle(self):
        if self.low == self.high:
            self.twos = self.threes = 0

    def limited(self, failures):
        if failures >= SHRINK_FROM:
            self._map_batch(shrink)
        if failures >= SLOW_FROM:
            self.low, self.high, self.twos = slow(self.low), slow(self.high), self.twos + 1
            self._settle()

    def recovered(self, default):
        if self.batches[0] != default or len(self.batches) > 1:
            self._map_batch(lambda b: grow(b, default))
        if self.high > 1.0:
            self.low, self.high = quicken(self.low), quicken(self.high)
            self.threes += 1
            self.twos -= 2
            self._settle()

    def pack(self):
        return [self.starts, self.batches, self.twos, self.threes, self.low, self.high]


def apply_effect(packed, batch: int, multiplier: float):
    starts, batches, twos, threes, low, high = packed
    batch = batches[max(0, bisect_right(starts, batch) - 1)]
    if low == high:
        return batch, low
    # Exact in binary floating point for up to 33 recoveries since the last clamp.
    scaled = float(Fraction(multiplier) * Fraction(3) ** threes * Fraction(2) ** twos)
    return batch, min(high, max(low, scaled))


class Lane:
    """The piece as seen from one start value of the failure count."""

    __slots__ = ("failures", "added", "reset", "effect")

    def __init__(self, failures, batches):
        self.failures, self.added, self.reset = failures, 0, False
        self.effect = Effect(batches)

    def limited(self):
        self.added += 1
        if self.failures < EXCLUDE_FROM:
            self.failures += 1
        self.effect.limited(self.failures)

    def succeeded(self, late, default):
        if self.failures >= EXCLUDE_FROM:
            self.failures, self.added, self.reset = 0, 0, True
            self.effect.set_to(lifted_batch(default), LIFTED_MULTIPLIER)
            return
        if late:
            self.failures, self.added, self.reset = 0, 0, True
        if self.failures == 0:
            self.effect.recovered(default)


class Piece:
    """Reduces consecutive requests of one server to a summary."""

    def __init__(self, key, micros, seq, default, batches, steps):
        self.key, self.first, self.default = key, (micros, seq), default
        self.batches, self.steps = batches, steps
        self.early_successes, self.early_times = 0, []
        self.last_limit, self.lanes, self.tail = None, None, None

    def limited(self, micros):
        self.last_limit = micros
        if self.lanes is None:
            self.lanes = [Lane(n, self.batches) for n in range(EXCLUDE_FROM + 1)]
        if self.tail is not None:
            self.tail.limited()
        else:
            for lane in self.lanes:
                lane.limited()

    def succeeded(self, micros):
        if self.lanes is None:
            self.early_successes += 1
            self.early_times.append(micros)
            if len(self.early_times) > 2 * self.steps + 2:
                del self.early_times[: -self.steps - 1]
            return
        late = micros - self.last_limit > QUIET_MICROS
        if self.tail is not None:
            self.tail.succeeded(late, self.default)
            return
        for lane in self.lanes:
            lane.succeeded(late, self.default)
        if all(lane.reset and lane.failures == 0 for lane in self.lanes):
            # From here on every start value takes the same course.
            self.tail = Lane(0, self.batches)

    def summary(self):
        lanes = [[n.added, n.reset, n.effect.pack()] for n in self.lanes or ()]
        tail = self.tail and [self.tail.added, self.tail.effect.pack()]
        return json.dumps(
            [self.early_successes, self.early_times[-self.steps - 1 :], self.last_limit, lanes, tail]
        )


def initial_state(default: int):
    """(failures, batch, multiplier, last limit)"""
    return 0, default, 1.0, None


def apply_requests(state, requests, default: int):
    """The state after a few requests (micros, limited) in their order, without a summary."""
    failures, batch, multiplier, last_limit = state
    for micros, limited in requests:
        if limited:
            failures, last_limit = failures + 1, micros
            batch = shrink(batch) if failures >= SHRINK_FROM else batch
            multiplier = slow(multiplier) if failures >= SLOW_FROM else multiplier
        elif failures >= EXCLUDE_FROM:
            failures, batch, multiplier = 0, lifted_batch(default), LIFTED_MULTIPLIER
        elif failures == 0 or last_limit is None or micros - last_limit > QUIET_MICROS:
            failures, batch, multiplier = 0, grow(batch, default), quicken(multiplier)
    return failures, batch, multiplier, last_limit


def apply_summary(state, summary: str, default: int):
    failures, batch, multiplier, last_limit = state
    early, times, piece_limit, lanes, tail = json.loads(summary)
    if early:
        recoveries = 0
        if failures >= EXCLUDE_FROM:
            failures, batch, multiplier = 0, lifted_batch(default), LIFTED_MULTIPLIER
            recoveries = early - 1
        elif failures == 0 or last_limit is None:
            failures, recoveries = 0, early
        else:
            late = sum(t - last_limit > QUIET_MICROS for t in times)
            if late:
                failures, recoveries = 0, late
        for _ in range(min(recoveries, recovery_steps(default))):
            batch, multiplier = grow(batch, default), quicken(multiplier)
    if lanes:
        added, reset, effect = lanes[min(failures, EXCLUDE_FROM)]
        batch, multiplier = apply_effect(effect, batch, multiplier)
        failures = added if reset else failures + added
        last_limit = piece_limit
        if tail:
            batch, multiplier = apply_effect(tail[1], batch, multiplier)
            failures = tail[0]
    return failures, batch, multiplier, last_limit
