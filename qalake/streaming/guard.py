"""Live request flags: one state machine for each address, over a stream of requests (id, ip, ts, prompt).

Requests wait in the state until the watermark has passed their time, since until then an earlier one may still come; then
they are handled in the order of time and id, so that ties and requests that came late, but in time, are judged as the batch
form in `flags` judges them. Event-time timers drive this: one at the earliest request that waits, one when the last
request is an hour old, so that its times are dropped, and one after FORGET, when nothing more is known of the address.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .flags import BURST, EXEMPT_LIMIT, HOUR, MINUTE, NORMAL_LIMIT, REPEATS, SHORT, SHORT_CHARS, TIERS

OUT = "ip string, id long, reason string, in_hour long, limit int"
#: Hours after its last request that an address' short prompts and last prompt are kept.
FORGET = 30 * 24


@dataclass
class Seen:
    """What is known of an address: times of its last hour's requests, short prompts, the last prompt, times of its repetitions."""

    times: deque = field(default_factory=deque)
    shorts: int = 0
    prompt: str | None = None
    repeats: list = field(default_factory=list)

    def judge(self, t: int, prompt: str | None) -> tuple[str | None, int]:
        """The reason to refuse a request, if any, and the requests of the last hour; a refused one goes no further."""
        while self.times and t - self.times[0] >= HOUR:
            self.times.popleft()
        self.times.append(t)
        n = len(self.times)
        if n > BURST and t - self.times[n - 1 - BURST] < MINUTE:
            return "burst", n
        if len((prompt or "").strip(" ")) < SHORT_CHARS:
            self.shorts += 1
            if self.shorts > SHORT:
                return "short", n
        if prompt is not None and prompt == self.prompt:
            self.repeats = [x for x in self.repeats if t - x < 10 * MINUTE] + [t]
            if len(self.repeats) > REPEATS:
                return "repeat", n
        self.prompt = prompt
        return None, n


class Guard(StatefulProcessor):
    """Keeps Seen and the requests that wait for the watermark."""

    def __init__(self, exempt: Sequence[str], forget: int):
        self.exempt, self.forget = frozenset(exempt), forget * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, id long, prompt string")
        self.times = handle.getListState("times", "t long")
        self.known = handle.getValueState("known", "shorts int, prompt string, repeats array<long>, last long")

    def _empty(self) -> pd.DataFrame:
        kinds = {"ip": "str", "id": "int64", "reason": "object", "in_hour": "int64", "limit": "int32"}
        return pd.DataFrame({c: pd.Series([], dtype=k) for c, k in kinds.items()})

    def _call_at(self, micros: int) -> None:
        """A timer at the first whole millisecond from then on."""
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for frame in rows:
            new = list(zip(frame["t"].tolist(), frame["id"].tolist(), [None if pd.isna(p) else p for p in frame["prompt"]], strict=True))
            self.waiting.appendList(new)
            first = min([x[0] for x in new] + ([] if first is None else [first]))
        self._call_at(first)
        yield self._empty()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get(), key=lambda x: x[:2]) if self.waiting.exists() else []
        due = [x for x in waiting if x[0] <= now]
        if due:
            yield self._judged(key[0], due)
            later = waiting[len(due) :]
            if later:
                self.waiting.put(later)
                self._call_at(later[0][0])
            else:
                self.waiting.clear()
        elif not waiting and self.known.exists():
            last = self.known.get()[3]
            if last + HOUR <= now:
                self.times.clear()
            if last + self.forget * 1000 <= now:
                self.known.clear()
        if not due:
            yield self._empty()

    def _judged(self, ip: str, due: list) -> pd.DataFrame:
        times = deque(x[0] for x in self.times.get()) if self.times.exists() else deque()
        shorts, prompt, repeats, _ = self.known.get() if self.known.exists() else (0, None, [], 0)
        seen = Seen(times, shorts, prompt, list(repeats))
        verdicts = [seen.judge(t, p) for t, _, p in due]
        last = due[-1][0]
        self.times.put([(t,) for t in seen.times])
        self.known.update((seen.shorts, seen.prompt, seen.repeats, last))
        self._call_at(last + HOUR)
        self._call_at(last + self.forget * 1000)
        free = ip in self.exempt
        limits = [EXEMPT_LIMIT if free else next((limit for above, limit in TIERS if n > above), NORMAL_LIMIT) for _, n in verdicts]
        out = pd.DataFrame({"ip": ip, "id": [x[1] for x in due], "reason": [None if free else r for r, _ in verdicts], "in_hour": [n for _, n in verdicts], "limit": limits})
        return out.astype({"limit": "int32"})

    def close(self) -> None:
        pass


def request_guard(requests: DataFrame, exempt: Sequence[str] = (), delay: str = "10 minutes", forget: int = FORGET) -> DataFrame:
    """ip, id, reason, in_hour, limit of a stream of requests (id, ip, ts, prompt), as flags.abuse_reason and flags.rate_tier say.

    A request is given out once the watermark has passed it; those that come later than `delay` are left out, and counted
    by the query's progress (`live.drained`). Requests without an address are one key.
    """
    rows = requests.withWatermark("ts", delay).selectExpr("id", "ip", "ts", "prompt", "unix_micros(ts) as t")
    return rows.groupBy("ip").transformWithStateInPandas(Guard(exempt, forget), OUT, "append", "EventTime")
