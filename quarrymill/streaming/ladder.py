"""Finding websites over time: a ladder of sources with a ban after refusals and a cache that forgets.

Requests come as a stream, each with what the sources would answer at its time (captured). A searcher is an address that asks: its state is the
time until which the first source refuses it and what it found, or didn't find, for its vendors. A vendor always goes to the same searcher, so
searchers run in parallel and their state grows with their own vendors alone; entries leave by timers of event time when they expire.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

REQUEST = "vendor_key string, at timestamp, website string, first_status int, first_website string, first_confidence double, second_website string"
FOUND = "searcher int, vendor_key string, at timestamp, level string, website string, confidence double, skipped boolean"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ladder:
    """One searcher. Times are seconds; the cache maps a vendor to (time of expiry, website or None, confidence)."""

    def __init__(self, ban: float = 300.0, keep: float = 7 * 86400.0, least: float = 0.5):
        self.ban, self.keep, self.least, self.banned = ban, keep, least, float("-inf")

    def answer(self, request: dict, now: float, known: tuple | None) -> tuple[str, str | None, float | None, bool, tuple | None]:
        """Level, website, confidence, whether the first source was skipped, and the entry to remember."""
        if request["website"]:
            return "given", request["website"], None, False, None
        if known and known[0] > now:
            return ("cache" if known[1] else "negative"), known[1], known[2], False, None
        skipped = now < self.banned
        level, website, confidence = "none", None, None
        if not skipped:
            if request["first_status"] == 202:
                self.banned = now + self.ban
            elif request["first_status"] == 200 and request["first_website"] and (request["first_confidence"] or 0.0) >= self.least:
                level, website, confidence = "first", request["first_website"], request["first_confidence"]
        if level == "none" and request["second_website"]:
            level, website, confidence = "second", request["second_website"], 0.9
        return level, website, confidence, skipped, (now + self.keep, website, confidence)


class Searcher(StatefulProcessor):
    def __init__(self, ban: float, keep: float, least: float):
        self.ladder = Ladder(ban, keep, least)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.banned = handle.getValueState("banned", "until double")
        self.known = handle.getMapState("known", "vendor_key string", "until double, website string, confidence double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["at", "vendor_key"], kind="stable")
        held = self.banned.get()
        self.ladder.banned = held[0] if held is not None else float("-inf")
        out, entries, new = [], {}, set()  # a call to the state per vendor and batch, not per request
        for r in batch.itertuples(index=False):
            request = {k: None if pd.isna(v) else v for k, v in r._asdict().items()}
            now, vendor = r.at.timestamp(), r.vendor_key
            if vendor not in entries:
                entries[vendor] = self.known.getValue((vendor,)) if self.known.containsKey((vendor,)) else None
            level, website, confidence, skipped, keep = self.ladder.answer(request, now, entries[vendor])
            if keep:
                entries[vendor] = keep
                new.add(vendor)
            out.append((key[0], vendor, r.at, level, website, confidence, skipped))
        for vendor in sorted(new):
            self.known.updateValue((vendor,), entries[vendor])
        if new and not any(True for _ in self.handle.listTimers()):
            self._wake(min(entries[v][0] for v in new))
        self.banned.update((self.ladder.banned,))
        yield pd.DataFrame(out, columns=["searcher", "vendor_key", "at", "level", "website", "confidence", "skipped"])

    def _wake(self, until: float) -> None:
        """One timer per searcher: entries that expire on a day leave after its end."""
        self.handle.registerTimer((int(until) // 86400 + 1) * 86400 * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() / 1000
        held = [(v, entry[0]) for v, entry in self.known.iterator()]
        for vendor in [v for v, until in held if until <= now]:
            self.known.removeKey(vendor)
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        stay = [until for _, until in held if until > now]
        if stay:
            self._wake(min(stay))
        return iter([])

    def close(self) -> None:
        pass


def website_ladder(requests: DataFrame, searchers: int = 16, searcher: Column | None = None, ban: float = 300.0, keep: float = 7 * 86400.0, least: float = 0.5, delay: str = "1 hour") -> DataFrame:
    """requests: a stream with the columns of REQUEST, in about the order of `at` (rows later than `delay` are left out). One row of FOUND per request: level
    given, cache, negative (it is remembered that nothing was found), first, second or none. searcher: who asks for a vendor, a hash of its key
    by default. The session's state store has to be RocksDB."""
    spark = requests.sparkSession
    if spark.conf.get(STATE_STORE, "") != ROCKS:
        raise RuntimeError(f"{STATE_STORE} has to be {ROCKS}")
    who = F.pmod(F.xxhash64("vendor_key"), F.lit(searchers)) if searcher is None else searcher
    names = [c.strip().split(" ")[0] for c in REQUEST.split(",")]
    keyed = requests.select(who.cast("int").alias("searcher"), *names).withWatermark("at", delay)
    return keyed.groupBy("searcher").transformWithStateInPandas(Searcher(ban, keep, least), FOUND, "Append", "EventTime")


