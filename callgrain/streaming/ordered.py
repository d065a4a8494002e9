"""Streams whose rows are taken in the order of their event times: smoothing, and challenge sessions.

Rows of a key wait in its state until the watermark has passed them, and are then taken by time. So files may
come in any order within the watermark's delay; a later row is dropped by Spark, and counted in the query's
progress. What a batch brings a key is one element of its state, since each element costs a state operation. A timer at the end of a key's life clears its state. These queries keep their state in RocksDB, which
run() asks for.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from callgrain.operators.biometrics import THRESHOLDS, judged

MICROS = 1_000_000
#: Stands for a null key. One null among whole numbers would make them floats on their way to a task, which states take for nulls.
NOBODY = -(1 << 63)


class Ordered(StatefulProcessor):
    """Rows (at, tie, ...) of a key in the order of ``at``, in microseconds, then ``tie``; NOBODY's rows only move the watermark.

    A subclass says what the columns after ``tie`` are (``shape``), what its rows give (``out``), and has take(),
    which gets what the watermark has passed and returns rows of ``out`` and when it wants to be asked again, or None.
    """

    shape: str
    out: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")  # a batch's rows of the key, as JSON

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if key[0] == NOBODY:
            return iter(())
        names, first = ["at", "tie", *[c.split()[0] for c in self.shape.split(", ")]], None
        for batch in rows:
            new = list(zip(*[[None if v is None or v != v else v for v in batch[c].tolist()] for c in names], strict=True))
            if new:
                self.waiting.appendValue((json.dumps(new),))
                first = min(r[0] for r in new) if first is None else min(first, *[r[0] for r in new])
        if first is not None:
            self._ask(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted([r for part, in self.waiting.get() for r in json.loads(part)], key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        due = [r for r in rows if r[0] <= now]
        if later := rows[len(due) :]:
            if due:
                self.waiting.put([(json.dumps(later),)])
            self._ask(later[0][0])
        elif rows:
            self.waiting.clear()
        made, again = self.take(due, now)
        if again is not None:
            self._ask(again)
        if made:
            yield pd.DataFrame([(key[0], *r) for r in made], columns=self.out)

    def _ask(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def take(self, due: list[list], now: int) -> tuple[list[tuple], int | None]:
        raise NotImplementedError

    def close(self) -> None:
        return


class Smoothing(Ordered):
    """The smoothed score after each row; forgotten when nothing has come for ``idle_s``."""

    shape, out = "score double", ["call_id", "event_id", "n", "smoothed"]

    def __init__(self, alpha: float, idle_s: float) -> None:
        self.alpha, self.idle = alpha, int(idle_s * MICROS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "smoothed double, n long, at long")

    def take(self, due: list[list], now: int) -> tuple[list[tuple], int | None]:
        e, n, at = self.last.get() or (None, 0, None)
        made = []
        for t, event, score in due:
            if at is not None and t - at > self.idle:  # another call under the same id
                e, n = None, 0
            at = t
            if score is not None:
                e, n = score if e is None else self.alpha * score + (1 - self.alpha) * e, n + 1
                made.append((event, n, e))
        if at is None:
            return made, None
        if now - at > self.idle:
            self.last.clear()
            return made, None
        if due:
            self.last.update((e, n, at))
        return made, at + self.idle + 1000


def _states(stream: DataFrame, processor: Ordered, key: str, out: str, initial: DataFrame | None = None) -> DataFrame:
    whole = {c: F.coalesce(F.col(c), F.lit(NOBODY)) for c in (key, "at", "tie")}
    return stream.withColumns(whole).groupBy(key).transformWithStateInPandas(processor, out, "append", "eventTime", initial.groupBy(key) if initial is not None else None)


def smoothed(stream: DataFrame, late: str = "1 hour", alpha: float = 0.4, idle_s: float = 3600.0) -> DataFrame:
    """(call_id, event_id, n, smoothed) of (call_id, event_id, t, score): the smoothed score of a call after each of its rows, by time.

    Rows that come more than ``late`` after their successors are dropped. A row without a score leaves none. A call in which nothing has come for ``idle_s`` of
    event time has ended: its state goes, and a later row under its id begins another. Equal times go by event_id.
    """
    rows = stream.withWatermark("t", late).select("call_id", "t", F.unix_micros("t").alias("at"), F.col("event_id").alias("tie"), "score")
    return _states(rows, Smoothing(alpha, idle_s), "call_id", "call_id long, event_id long, n long, smoothed double")


class Session(NamedTuple):
    """An open challenge. ``retries`` are those that are left; ``done`` the last verdict, once there is one that ends it."""

    digits: str
    channel: str
    expires: int
    retries: int
    done: str


class Challenges(Ordered):
    """Starts and responses of sessions, in their order."""

    shape = "kind string, digits string, channel string, said string, speech_s double, identity double"
    out = ["session_id", "response_id", "at", "verdict", "content_match", "retries", "reason"]

    def __init__(self, ttl_s: float, retries: int, keep_s: float, least_s: float) -> None:
        self.ttl, self.retries, self.keep, self.least = int(ttl_s * MICROS), retries, int(keep_s * MICROS), least_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.session = handle.getValueState("session", "digits string, channel string, expires long, retries int, done string")
        self.answered = handle.getValueState("answered", "ties string")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        for r in initialState.itertuples():
            self.session.update((r.digits, r.channel, int(r.expires_at * MICROS), int(r.retries), ""))
            self._ask(int(r.expires_at * MICROS) + 1000)

    def take(self, due: list[list], now: int) -> tuple[list[tuple], int | None]:
        held, ties = self.session.get(), self.answered.get()
        session, known = Session(*held) if held else None, set(json.loads(ties[0])) if ties else set()
        before, made = len(known), []

        def passed(to: int) -> None:
            nonlocal session
            if session and session.expires < to and not session.done:
                made.append((None, session.expires, "EXPIRED", None, session.retries, "no answer in time"))
                session = session._replace(done="EXPIRED")
            if session and session.expires + self.keep < to:
                session = None
                known.clear()

        for at, tie, kind, digits, channel, said, speech_s, identity in due:
            passed(at)
            if kind == "start":
                session = Session(digits, channel or "", at + self.ttl, self.retries, "")
                known.clear()
                continue
            if tie in known:  # delivered twice
                continue
            known.add(tie)
            if session is None or session.done in ("PASS", "FAIL"):
                made.append((tie, at, "UNKNOWN", None, 0, "no open session"))
                continue
            verdict, match, reason = judged(session.done == "EXPIRED", speech_s, said, session.digits, identity, session.channel, session.retries, self.least)
            session = session._replace(retries=session.retries - (verdict == "RETRY"), done=session.done if verdict == "RETRY" else verdict)
            made.append((tie, at, verdict, match, session.retries, reason))
        passed(now + 1)
        if session is None:
            self.session.clear()
            # an unknown session's responses are remembered until the next one begins or a time to live is over
            if due and known:
                self._remember(known)
                return made, due[-1][0] + self.ttl + self.keep
            self.answered.clear()
            return made, None
        self.session.update(tuple(session))
        if len(known) != before:
            self._remember(known)
        return made, session.expires + (0 if not session.done else self.keep) + 1000

    def _remember(self, known: set[int]) -> None:
        self.answered.update((json.dumps(sorted(known)),))


def digits_of(session_id: Column, at: Column) -> Column:
    """Five digits that a session's id and its start fix."""
    drawn = F.conv(F.substring(F.sha2(F.concat_ws(":", session_id.cast("string"), at.cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("long")
    return F.lpad((drawn % 100_000).cast("string"), 5, "0")


def challenges(stream: DataFrame, late: str = "10 seconds", ttl_s: float = 30.0, retries: int = 2, keep_s: float = 300.0, least_s: float = 3.0, open_sessions: DataFrame | None = None) -> DataFrame:
    """(session_id, response_id, t, verdict, content_match, retries, reason) of sessions, a row for each response and for each session that expires unanswered.

    stream: (session_id, response_id, t, kind, channel, said, speech_s, identity), where kind is ``start`` or ``response``. A
    start draws five digits and opens a session for ``ttl_s``; ``said`` are the digits heard (null: not checked) and
    ``identity`` the cosine to the voiceprint (null: not checked), which is held to its channel's threshold. Responses are taken in the
    order of their times: too little speech costs a retry (RETRY) or, with none left, the session (FAIL); PASS and FAIL end it. A session that
    has expired answers EXPIRED for ``keep_s`` more; then, and where there is none or it has ended, it is UNKNOWN. A response that comes
    twice counts once. ``open_sessions`` (session_id, digits, channel, expires_at in seconds, retries) are there from the start.
    """
    at = F.unix_micros("t")
    digits = F.when(F.col("kind") == "start", digits_of(F.col("session_id"), at))
    rows = stream.withWatermark("t", late).select("session_id", "t", at.alias("at"), F.col("response_id").alias("tie"), "kind", digits.alias("digits"), "channel", "said", "speech_s", "identity")
    out = "session_id long, response_id long, at long, verdict string, content_match boolean, retries int, reason string"
    found = _states(rows, Challenges(ttl_s, retries, keep_s, least_s), "session_id", out, open_sessions)
    return found.withColumn("t", F.timestamp_micros("at")).select("session_id", "response_id", "t", "verdict", "content_match", "retries", "reason")
