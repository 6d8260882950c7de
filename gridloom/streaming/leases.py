"""A work queue for many workers: a stateful stream that grants entries for a time.

Messages are rows of a stream: entries to add, and what workers say (ask, beat, done, error). The state of a run holds its
entries; each message is answered in order of its time. A granted entry is leased: without a beat or an end by then it is
queued again, so an entry whose worker is lost is not, and no two workers hold one entry at a time. Leases lapse by the time
of later messages, and by a timer where no message comes. Entries are granted in the run's daily hours only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MESSAGES = "run_name STRING, ts TIMESTAMP, kind STRING, id BIGINT, priority INT, worker STRING"
ANSWERS = "run_name string, ts timestamp, kind string, id bigint, worker string"
STATE = "entries string"


class Queue:
    """Entries of a run: id to [priority, worker or null, lease's end in seconds, tries]. Times are seconds."""

    def __init__(self, entries: dict[str, list] | None = None, *, lease: float = 600.0, hours: tuple[int, int] | None = None):
        self.entries, self.lease, self.hours = entries or {}, lease, hours

    def open(self, now: float) -> bool:
        """Whether the daily window [start, end) holds the time (UTC); it may pass midnight."""
        if self.hours is None:
            return True
        hour, (a, b) = int(now // 3600 % 24), self.hours
        return a <= hour < b if a < b else hour >= a or hour < b

    def lapse(self, now: float) -> list[tuple[str, int, str]]:
        """Entries whose lease ended by now are queued again."""
        out = []
        for key, e in sorted(self.entries.items(), key=lambda x: (x[1][2] or 0, int(x[0]))):
            if e[1] is not None and e[2] <= now:
                out.append(("lapsed", int(key), e[1]))
                e[1], e[2] = None, None
        return out

    def answer(self, now: float, kind: str, entry: int | None, priority: int | None, worker: str | None) -> list[tuple[str, int | None, str | None]]:
        """Messages back: (kind, id, worker). An end or a beat of an entry that the worker no longer holds is refused."""
        out: list = self.lapse(now)
        key = str(entry)
        if kind == "add":
            if entry is not None and key not in self.entries:
                self.entries[key] = [priority or 0, None, None, 0]
            return out
        if kind == "ask":
            free = [(-e[0], int(k)) for k, e in self.entries.items() if e[1] is None]
            if not free or not self.open(now):
                return [*out, ("none", None, worker)]
            first = min(free)[1]
            e = self.entries[str(first)]
            e[1], e[2], e[3] = worker, now + self.lease, e[3] + 1
            return [*out, ("granted", first, worker)]
        held = self.entries.get(key)
        if kind not in ("beat", "done", "error") or held is None or held[1] != worker:
            return [*out, ("refused", entry, worker)]
        if kind == "beat":
            held[2] = now + self.lease
            return [*out, ("extended", entry, worker)]
        del self.entries[key]
        return [*out, ("completed" if kind == "done" else "error", entry, worker)]

    def next_lapse(self) -> float | None:
        return min((e[2] for e in self.entries.values() if e[2] is not None), default=None)


def grants(messages: DataFrame, *, lease: float = 600.0, hours: tuple[int, int] | None = None, late: str = "1 minute") -> DataFrame:
    """The stream of answers (run_name, ts, kind, id, worker) to a stream of MESSAGES: granted, none, extended, completed,
    error, refused, and lapsed for each lease that ended. Within a micro-batch messages are taken in order of time, then id and
    worker; a lease lapses at the latest when the watermark (late behind the newest message) passes its end."""

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        queue = Queue(json.loads(state.get[0]) if state.exists else None, lease=lease, hours=hours)
        out: list[tuple] = []
        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs() / 1000
            out += [(now, *a) for a in queue.lapse(now)]
        else:
            rows = pd.concat(frames)
            for r in rows.sort_values(["ts", "id", "worker"], kind="stable", na_position="first").itertuples():
                now = r.ts.timestamp()
                entry, priority = (None if pd.isna(v) else int(v) for v in (r.id, r.priority))
                out += [(now, *a) for a in queue.answer(now, r.kind, entry, priority, r.worker)]
        state.update((json.dumps(queue.entries),))
        due, mark = queue.next_lapse(), state.getCurrentWatermarkMs()
        if due is not None:
            state.setTimeoutTimestamp(max(int(due * 1000), mark + 1))
        yield pd.DataFrame({"run_name": [key[0]] * len(out), "ts": pd.to_datetime([o[0] for o in out], unit="s"), "kind": [o[1] for o in out], "id": pd.array([o[2] for o in out], "Int64"), "worker": [o[3] for o in out]})

    asked = messages.where("ts is not null").withWatermark("ts", late)
    return asked.groupBy("run_name").applyInPandasWithState(step, ANSWERS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
