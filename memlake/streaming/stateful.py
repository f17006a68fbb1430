"""Operators with keyed state and timers: versions that late rows reopen, and a ledger of monitored files.

Both write changes, not states: a sink keeps the last revision of each key. Their state lies in the RocksDB store, so
it is bounded by disk and not by memory, and it is part of the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with timers needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Versions(StatefulProcessor):
    """Validity intervals of one key's states from rows in any order.

    The state holds every row that a late one may still come before, since a row that changed nothing does when another
    state is put in front of it, and of all older rows one summary: the last version and its state. A timer moves
    rows into the summary as soon as the watermark has passed them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "at long, nth long, state string")
        self.summary = handle.getValueState("summary", "version int, state string, since long, revision int")

    @staticmethod
    def _versions(summary: tuple, rows: list[tuple]) -> list[tuple]:
        """version, state, valid_from, valid_until of rows in order, after the summary's last version."""
        version, state, since, _ = summary
        out = [(version, state, since)] if version else []
        for at, _, now in rows:
            if not out or out[-1][1] != now:
                out.append((out[-1][0] + 1 if out else 1, now, at))
        return [(*v, after[2] if after else None) for v, after in zip(out, [*out[1:], None], strict=False)]

    def _kept(self) -> list[tuple]:
        return [tuple(r) for r in self.rows.get()] if self.rows.exists() else []

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  (names of the interface)
        # each call of the state goes to the store and back, so a key that is new makes as few as can be
        known = self.summary.get()
        summary, kept = known or (0, None, None, 0), self._kept() if known else []
        before = set(self._versions(summary, kept))
        every = sorted([*kept, *((r["at"], r["nth"], r["state"]) for r in rows)], key=lambda r: r[:2])
        self.rows.put(every)
        version, state, since, revision = summary
        self.summary.update((version, state, since, revision + 1))
        timer = every[0][0] // 1000 + 1
        timers = set(self.handle.listTimers()) if known else set()
        for old in timers - {timer}:
            self.handle.deleteTimer(old)
        if timer not in timers:
            self.handle.registerTimer(timer)
        for v in self._versions(summary, every):
            if v not in before:
                yield Row(key=key[0], version=v[0], state=v[1], valid_from=v[2], valid_until=v[3], revision=revision + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        kept, passed = self._kept(), timerValues.getCurrentWatermarkInMs() * 1000
        summary = self.summary.get() or (0, None, None, 0)
        # the last version that has begun before the watermark stays open in the summary
        found = self._versions(summary, [r for r in kept if r[0] < passed])
        if found:
            self.summary.update((*found[-1][:3], summary[3]))
        rest = [r for r in kept if r[0] >= passed]
        if rest:
            self.rows.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.rows.clear()
        return iter(())

    def close(self) -> None:
        pass


def status_versions(stream: DataFrame, key: str, state: str, ts: str, order: str, late: str) -> DataFrame:
    """key, version, state, valid_from, valid_until, revision: every version that a batch adds or changes.

    Rows may come in any order within ``late`` of the newest; one that comes between others splits or moves versions,
    which are then sent again with a higher revision (``latest_versions`` keeps the last). Rows older than the
    watermark never arrive here: take them from ``streams.split_late``.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    at = F.col(ts).cast("timestamp")
    rows = stream.select(F.col(key).alias("key"), F.unix_micros(at).alias("at"), F.col(order).cast("long").alias("nth"), F.col(state).alias("state"), at.alias("moment")).withWatermark("moment", late)
    kind = rows.schema["key"].dataType.simpleString()
    out = f"key {kind}, version int, state string, valid_from long, valid_until long, revision int"
    found = rows.groupBy("key").transformWithState(Versions(), out, "Update", "EventTime")
    return found.select("key", "version", "state", F.timestamp_micros("valid_from").alias("valid_from"), F.timestamp_micros("valid_until").alias("valid_until"), "revision")


def latest_versions(changes: DataFrame) -> DataFrame:
    """The last revision of each version."""
    newest = F.row_number().over(Window.partitionBy("key", "version").orderBy(F.desc("revision")))
    return changes.withColumn("newest", newest).filter("newest = 1").drop("newest", "revision")


class FileLedger(StatefulProcessor):
    """What became of one monitored path from scan to scan. A path that the next scan does not show is deleted: the
    timer that its last sighting set runs out when the watermark, which the scans move, reaches that scan."""

    def __init__(self, period_ms: int):
        self.period = period_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seen long, checksum string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = self.last.get()
        seen, checksum = known or (None, None)
        # a path's scans in one batch, few; several rows of one scan count as its last by checksum
        scans: dict = {}
        for r in rows:
            scans.setdefault(r["at"], []).append(r["checksum"])
        out = []
        for at in sorted(scans):
            # a null checksum comes last
            now = None if None in scans[at] else max(scans[at])
            if seen is not None and at <= seen:
                continue  # a scan that was read before
            if seen is not None and at - seen > self.period:
                out.append((seen + self.period, "deleted", checksum))
                seen = None
            if seen is None or now != checksum:
                out.append((at, "new" if seen is None else "changed", now))
            seen, checksum = at, now
        self.last.update((seen, checksum))
        for old in self.handle.listTimers() if known else ():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(seen + self.period)
        return self._out(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        seen, checksum = self.last.get()
        self.last.clear()
        return self._out(key, [(seen + self.period, "deleted", checksum)])

    @staticmethod
    def _out(key, rows: list[tuple]) -> Iterator[Row]:
        return iter([Row(path=key[0], change=change, checksum=checksum, scanned_at=at) for at, change, checksum in rows])

    def close(self) -> None:
        pass


def file_changes(scans: DataFrame, path: str, checksum: str, ts: str, period_seconds: int) -> DataFrame:
    """path, change (new, changed, deleted), checksum and scanned_at from a stream of scans, each a row for every file there is.

    Scans follow each other by ``period_seconds``; the deletions of the last scan are told when the next one is read.
    """
    scans.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    moment = F.col(ts).cast("timestamp")
    rows = scans.select(F.col(path).alias("path"), F.col(checksum).alias("checksum"), F.unix_millis(moment).alias("at"), moment.alias("moment")).withWatermark("moment", "0 seconds")
    found = rows.groupBy("path").transformWithState(FileLedger(period_seconds * 1000), "path string, change string, checksum string, scanned_at long", "Update", "EventTime")
    return found.withColumn("scanned_at", F.timestamp_millis("scanned_at"))
