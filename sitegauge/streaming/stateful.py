"""Stateful processors: typed state of a key, changed entry by entry, with timers in event time that let it go.

Times in states are microseconds since 1970 (UTC).
"""

from __future__ import annotations

import bisect
import datetime as dt
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.outreach import MAIL_ORDER

DAY_MS = 86_400_000
KINDS = ["send", "delivery", "open", "click", "bounce", "complaint"]
#: The times that an event of each kind sets.
_SETS = [(0,), (1,), (2,), (2, 3), (4,), (4,)]
_STRENGTH = {None: 0, "soft": 1, "hard": 2, "complaint": 3}

MAIL_OUTPUT = "message_id string, sent_at long, delivered_at long, opened_at long, clicked_at long, bounced_at long, bounce_type string, status string, last_event_at long"
CHANGE_OUTPUT = "domain string, snapshot_type string, taken_at long, snapshot_id long, content_hash string, previous_hash string, has_changes boolean"
MAIL_ROW, CHANGE_ROW = (Row(*(c.split()[0] for c in output.split(", "))) for output in (MAIL_OUTPUT, CHANGE_OUTPUT))


def rocksdb(spark: SparkSession) -> None:
    """Let the session's streams keep their states in RocksDB, which typed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class MailStates(StatefulProcessor):
    """A message's first time of each kind, its strongest bounce and its furthest place, as one value; a timer forgets it so many
    days after its last event.  Events from before the watermark are left out, so none brings back a part of what is forgotten."""

    SCHEMA = "sent long, delivered long, opened long, clicked long, bounced long, bounce_type string, place int, last long, timer long"

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.mail = handle, handle.getValueState("mail", self.SCHEMA)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        before = self.mail.get()
        *times, bounced, place, last, timer = before if before is not None else (None,) * 9
        watermark = timerValues.getCurrentWatermarkInMs()
        for event in rows:
            at, kind = event.at, event.type
            if kind not in KINDS or at is None or at < watermark * 1000:
                continue
            k = KINDS.index(kind)
            for i in _SETS[k]:
                times[i] = at if times[i] is None else min(times[i], at)
            place, last = max(place if place is not None else k, k), max(last if last is not None else at, at)
            found = "complaint" if kind == "complaint" else ("hard" if event.bounce_type == "Permanent" else "soft") if kind == "bounce" else None
            bounced = max(bounced, found, key=_STRENGTH.__getitem__)
        if place is None:
            return
        ends = max(last // 1000, watermark) + self.days * DAY_MS
        if timer != ends:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ends)
        self.mail.update((*times, bounced, place, last, ends))
        yield MAIL_ROW(key[0], *times, bounced, MAIL_ORDER[place], last)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        self.mail.clear()
        return iter(())

    def close(self) -> None:
        pass


class SnapshotChain(StatefulProcessor):
    """A site's snapshots, each an entry (time, id) -> hash of a map: those of the last ``late`` and the one before them.

    A batch writes the entries that it brings and removes those that have become too old.  A timer, ``late`` after the newest,
    leaves the newest alone; with ``forget`` another one lets go of the site.
    """

    def __init__(self, late: dt.timedelta, forget: dt.timedelta | None):
        self.late, self.forget = int(late.total_seconds() * 1e6), None if forget is None else int(forget.total_seconds() * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "at long, id long", "hash string")
        self.begun = handle.getValueState("begun", "cut boolean, newest long")

    def _timers(self, newest: int) -> list[int]:
        return [(newest + span) // 1000 + 1 for span in (self.late, self.forget) if span is not None]

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        was = self.begun.get()
        cut, old = was if was is not None else (False, None)
        known = {tuple(k): v[0] for k, v in self.seen.iterator()}
        order, stored, fresh, touched = sorted(known), set(known), set(), set()
        for row in rows:
            if row.at is None:
                continue
            item, value = (row.at, row.snapshot_id), row.content_hash
            i = bisect.bisect_left(order, item)
            if cut and i == 0:
                continue  # its place is among those that are gone
            if item not in known:
                order.insert(i, item)
            elif known[item] == value:
                continue  # the same snapshot again
            known[item] = value
            fresh.add(item)
            touched |= {item, *order[i + 1 : i + 2]}  # the next one has another before it now
        if not order:
            return
        for item in sorted(touched):
            i = bisect.bisect_left(order, item)
            before = known[order[i - 1]] if i else None
            yield CHANGE_ROW(*key, *item, known[item], before, before is not None and known[item] != before)
        first = max(0, bisect.bisect_left(order, (order[-1][0] - self.late,)) - 1)
        for item in stored.intersection(order[:first]):
            self.seen.removeKey(item)
        for item in fresh.intersection(order[first:]):
            self.seen.updateValue(item, (known[item],))
        if order[-1][0] != old:
            for at in self._timers(old) if old is not None else []:
                self.handle.deleteTimer(at)
            for at in self._timers(order[-1][0]):
                self.handle.registerTimer(at)
        self.begun.update((cut or first > 0, order[-1][0]))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        was = self.begun.get()
        if was is not None:
            newest = was[1]
            if self.forget is not None and timerValues.getCurrentWatermarkInMs() * 1000 >= newest + self.forget:
                self.seen.clear()
                self.begun.clear()
            else:
                order = sorted(tuple(k) for k in self.seen.keys())
                for item in order[:-1]:
                    self.seen.removeKey(item)
                self.begun.update((was[0] or len(order) > 1, newest))
        return iter(())

    def close(self) -> None:
        pass
