"""Follow-up items from signals: created, reinforced, expired, closed and opened anew; the same for streams and tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ordered import carried

# Fixed values.
RANK = {"medium": 1, "high": 2}
DECISIONS = {"pursue": "open", "wait": "waiting", "pause": "paused", "ignore": "ignored", "won": "won", "lost": "lost"}
CLOSED = ("won", "lost")
CONFIRMING = ("pursue", "wait", "won")
EXPIRY_SECONDS = 14 * 86_400
TIERS = {"permanent": None, "periodic": 7 * 86_400, "once": 86_400}
EVIDENCE = 5

#: One row for each item a key has had; round counts from 1.
ITEM = "key string, round int, chat_id string, kind string, status string, confidence string, priority int, reinforcement int, first_seen long, last_signal long, expires long, evidence string"
_STATE = "chat_id string, kind string, round int, status string, confidence string, priority int, reinforcement int, first_seen long, last_signal long, expires long, evidence array<string>"
_FIELDS = [x.split()[0] for x in _STATE.split(", ")]


def events(signals: DataFrame, decisions: DataFrame | None = None, head: int = 80) -> DataFrame:
    """Signals (chat_id, kind, text, ts in seconds, hints) and decisions (key, ts, decision) as one table of events.

    A key is a chat, a kind and a hash of the first `head` characters of the text.
    """
    key = F.concat_ws("|", "chat_id", "kind", F.substring(F.md5(F.substring(F.trim("text"), 1, head).cast("binary")), 1, 8))
    s = signals.select(key.alias("key"), "chat_id", "kind", "ts", "hints", F.substring("text", 1, 200).alias("text"), F.lit(None).cast("string").alias("decision"))
    if decisions is None:
        return s
    return s.unionByName(
        decisions.select(
            "key", F.split_part("key", F.lit("|"), F.lit(1)).alias("chat_id"),
            F.split_part("key", F.lit("|"), F.lit(2)).alias("kind"), "ts", F.lit(0).alias("hints"), F.lit("").alias("text"),
            "decision",
        ),
    )


def _effective(rows: DataFrame, bucket: int) -> DataFrame:
    """Events that bear on an item, each once, with what came before: `prior` (the event before, "" for a signal) and
    `decided` (the last decision). Decisions before a key's first signal and unknown ones bear on nothing."""
    valid = F.col("decision").isNull() | F.col("decision").isin(*DECISIONS)
    e = rows.where(valid).dropDuplicates(["key", "ts", "text", "decision"])
    e = e.withColumn("bucket", F.floor(F.col("ts") / bucket)).withColumn("later", F.col("decision").isNotNull().cast("int"))
    order = ["ts", "later", "text", "decision"]
    e = carried(e, ["key"], "bucket", order, {"signals": 1 - F.col("later")}, {}).where("signals > 0").drop("signals")
    return carried(e, ["key"], "bucket", order, {}, {"prior": F.coalesce("decision", F.lit("")), "decided": F.col("decision")})


def follow_up(rows: DataFrame, at: int | None = None, bucket: int = 86_400) -> DataFrame:
    """Items of all events, as of `at` (seconds): new ones past their expiry are stale.

    Events of a key stand in the order of their times, signals before decisions. A signal begins a round if it is the
    key's first or comes right after a closing decision; it is accepted then, and later if it is the first at its time and
    the item is not ignored. Rounds are running counts of beginnings, all else sums and extremes over a round. Windows go
    over a bucket of seconds of a key, so a key of very many signals is no single task.
    """
    e = _effective(rows, bucket)
    signal = F.col("later") == 0
    begins = signal & (F.col("prior").isNull() | F.col("prior").isin(*CLOSED))
    e = carried(e.withColumn("begins", begins.cast("int")), ["key"], "bucket", ["ts", "later", "text", "decision"], {"round": F.col("begins")}, {})
    same_time = Window.partitionBy("key", "bucket", "ts").orderBy("later", "text")
    e = e.withColumn("nth", F.row_number().over(same_time))
    accepted = signal & ((F.col("begins") == 1) | ((F.col("nth") == 1) & ~F.coalesce(F.col("decided") == "ignore", F.lit(False))))
    # a decision that does not close belongs to the round that goes on
    untouched = F.col("decided").isNull() | F.col("decided").isin(*CLOSED)
    e = e.withColumn("accepted", accepted).withColumn("text", F.when(F.col("accepted"), F.col("text")))
    last = Window.partitionBy("key", "bucket", "round").orderBy(F.col("accepted").desc(), F.desc("ts"), F.desc("text"))
    e = e.withColumn("recent", F.row_number().over(last))
    of = lambda value: F.when(F.col("accepted"), value)
    items = e.groupBy("key", "round").agg(
        F.max("chat_id").alias("chat_id"), F.max("kind").alias("kind"), F.max_by("decision", F.when(~signal, F.struct("ts", "text", "decision"))).alias("decision"),
        F.max(of(F.when(F.col("hints") >= 2, 2).otherwise(1))).alias("rank"), F.max(of(F.least(F.lit(5), F.lit(2) + F.greatest(F.lit(0), F.col("hints") - 1)))).cast("int").alias("priority"),
        F.count_if("accepted").cast("int").alias("reinforcement"), F.min(of(F.col("ts"))).alias("first_seen"), F.max(of(F.col("ts"))).alias("last_signal"),
        (F.max(F.when(F.col("accepted") & untouched, F.col("ts"))) + EXPIRY_SECONDS).alias("expires"),
        F.collect_list(F.when(F.col("accepted") & (F.col("recent") <= EVIDENCE), F.struct("ts", "text"))).alias("texts"),
    )
    texts = F.array_sort("texts")
    evidence = F.array_join(F.slice(texts["text"], F.greatest(F.size(texts) - EVIDENCE + 1, F.lit(1)), EVIDENCE), "\n")
    stale = F.lit(False) if at is None else F.col("expires") <= at
    status = F.coalesce(_lookup(DECISIONS, F.col("decision")), F.when(stale, "stale").otherwise("new"))
    confidence = F.when(F.col("rank") == 2, "high").otherwise("medium")
    return items.select(
        "key", F.col("round").cast("int").alias("round"), "chat_id", "kind", status.alias("status"),
        confidence.alias("confidence"), "priority", "reinforcement", "first_seen", "last_signal", "expires",
        evidence.alias("evidence"),
    )


def _lookup(values: dict[str, str], key: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def feedback(rows: DataFrame, bucket: int = 86_400) -> DataFrame:
    """target, verdict, note and ts of the feedback that decisions on existing items give: pursuing, waiting for and winning
    confirm the item, ignoring tells against it and its chat."""
    d = _effective(rows, bucket).where("decision IS NOT NULL")
    note = F.concat(F.lit("triage:"), "decision")
    own = lambda target, verdict: F.struct(target.alias("target"), F.lit(verdict).alias("verdict"))
    item, chat = F.concat(F.lit("item:"), "key"), F.concat(F.lit("chat:"), "chat_id")
    given = F.when(F.col("decision").isin(*CONFIRMING), F.array(own(item, "confirmed"))).when(F.col("decision") == "ignore", F.array(own(item, "ignore"), own(chat, "ignore")))
    return d.select(F.explode(given).alias("f"), note.alias("note"), "ts").select("f.*", "note", "ts")


def purge(items: DataFrame, excluded: DataFrame, dry_run: bool = True) -> DataFrame:
    """items without those of excluded(chat_id); with dry_run those that would go, and nothing else."""
    return items.join(excluded.select("chat_id").distinct(), "chat_id", "left_semi" if dry_run else "left_anti")


def alive(rows: DataFrame, now: int, tier: str = "tier", at: str = "ts") -> DataFrame:
    """rows (at: whole seconds) that their tier still keeps at `now`: permanent ones always, periodic ones 7 days, once-only
    ones 24 hours, also for the last second; unknown and missing tiers are permanent."""
    limit = F.lit(None).cast("long")
    for name, seconds in TIERS.items():
        if seconds is not None:
            limit = F.when(F.col(tier) == name, F.lit(seconds)).otherwise(limit)
    return rows.where(limit.isNull() | (F.lit(now) - F.col(at) <= limit))


class _Items(StatefulProcessor):
    """The item of one key, its expiry as a timer, and its end when the key has been silent for twice as long."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.item = handle, handle.getValueState("item", _STATE)

    def _timers(self, *at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        for t in sorted(set(at)):
            self.handle.registerTimer(t * 1000)

    def _row(self, key: str, item: dict) -> Row:
        names = [x.split()[0] for x in ITEM.split(", ")]
        told = item | {"key": key, "evidence": "\n".join(item["evidence"])}
        return Row(**{n: told[n] for n in names})

    def _held(self) -> dict | None:
        if not self.item.exists():
            return None
        item = dict(zip(_FIELDS, self.item.get()))
        return item | {"evidence": list(item["evidence"])}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        item, changed = self._held(), False
        order = sorted(rows, key=lambda r: (r.at, r.decision is not None, r.text, r.decision or ""))
        for r in order:
            if r.decision is not None:
                if item and r.decision in DECISIONS:
                    item["status"], changed = DECISIONS[r.decision], True
                continue
            rank, priority = "high" if r.hints >= 2 else "medium", min(5, 2 + max(0, r.hints - 1))
            if item is None or item["status"] in CLOSED:
                if item and changed:
                    yield self._row(key[0], item)
                item = {"chat_id": r.chat_id, "kind": r.kind, "round": item["round"] + 1 if item else 1, "status": "new", "confidence": rank, "priority": priority, "reinforcement": 1, "first_seen": r.at, "last_signal": r.at, "expires": r.at + EXPIRY_SECONDS, "evidence": [r.text]}
                changed = True
            elif r.at > item["last_signal"] and item["status"] != "ignored":
                item |= {"last_signal": r.at, "reinforcement": item["reinforcement"] + 1, "priority": max(priority, item["priority"]), "evidence": [*item["evidence"], r.text][-EVIDENCE:]}
                if RANK[rank] > RANK[item["confidence"]]:
                    item["confidence"] = rank
                if item["status"] in ("new", "stale"):
                    item |= {"status": "new", "expires": r.at + EXPIRY_SECONDS}
                changed = True
        if item and changed:
            self.item.update(tuple(item[n] for n in _FIELDS))
            end = item["last_signal"] + 2 * EXPIRY_SECONDS
            self._timers(*[item["expires"]] * (item["status"] == "new"), end)
            yield self._row(key[0], item)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        item = self._held()
        if item is None:
            return
        if item["status"] == "new":
            item["status"] = "stale"
            self.item.update(tuple(item[n] for n in _FIELDS))
            yield self._row(key[0], item)
        elif expiredTimerInfo.getExpiryTimeInMs() >= (item["last_signal"] + 2 * EXPIRY_SECONDS) * 1000:
            self.item.clear()

    def close(self) -> None:
        pass


def follow_up_stream(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """Items over a stream of events (update mode): each batch gives the items it changed, and those that its watermark,
    `late` behind the newest event, makes stale.

    Events of a key that come late by less count at their time only within their batch. A state is one item with at most
    EVIDENCE texts; it goes when its key has had no signal for twice the expiry, so a later one begins with round 1. The
    session's state store must be RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    timed = rows.withColumn("at", F.col("ts")).withColumn("ts", F.timestamp_seconds("ts")).withWatermark("ts", late)
    return timed.groupBy("key").transformWithState(_Items(), ITEM, "Update", "EventTime")


class _Kept(StatefulProcessor):
    """The newest row of a key until its tier's time is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.row = handle, handle.getValueState("row", "at long, tier string, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        r = max(rows, key=lambda x: (x.at, x.value or ""))
        if self.row.exists() and self.row.get()[0] > r.at:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.row.update((r.at, r.tier, r.value))
        seconds = TIERS.get(r.tier)
        if seconds is not None:
            self.handle.registerTimer((r.at + seconds + 1) * 1000)
        yield Row(key=key[0], at=r.at, tier=r.tier, value=r.value, alive=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.row.exists():
            at, tier, value = self.row.get()
            self.row.clear()
            yield Row(key=key[0], at=at, tier=tier, value=value, alive=False)

    def close(self) -> None:
        pass


def alive_stream(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """The newest row (key, ts in seconds, tier, value) of each key of a stream as it comes, with alive = true, and again with
    alive = false when its tier's time is over by the watermark; its state goes then. See `alive` for the times."""
    timed = rows.withColumn("at", F.col("ts")).withColumn("ts", F.timestamp_seconds("ts")).withWatermark("ts", late)
    return timed.groupBy("key").transformWithState(_Kept(), "key string, at long, tier string, value string, alive boolean", "Update", "EventTime")
