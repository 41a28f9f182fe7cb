"""Keyed state machines on streams: dialogues, exact denial alerts, held-back answers.

Operators: O-CLS-7, O-STM-1 to O-STM-4, O-STM-7. Each is a ``transformWithStateInPandas`` with several state variables, kept in RocksDB, so
that a key's state is read and written by itself and survives a stop: a query that is started again from its checkpoint goes on where
it stood. Turns and pieces may come in any order and in any division into batches. They carry numbers from 0 without gaps; what comes early
waits in a map state, and what never comes is waited for until the key has been idle for ``IDLE``: then a timer takes what waits in order and
ends the key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import answers
from .jobs import HOLD_BACK, SENTINEL

IDLE = 30 * 60 * 1000  # milliseconds
HOUR = 3_600_000_000  # microseconds


def stateful(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str = "Append", time: str = "ProcessingTime") -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, mode, time)


class InOrder(StatefulProcessor):
    """Rows of a key in the order of their numbers. A subclass names its columns and state and handles one row at a time."""

    number, fields = "turn", "text string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [f.split()[0] for f in self.fields.split(", ")]
        self.next = handle.getValueState("next", "n long, timer long")
        self.waiting = handle.getMapState("waiting", "n long", self.fields)
        self.start(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        at, timer = self.next.get() if self.next.exists() else (0, 0)
        out: list[tuple] = []
        for frame in rows:
            frame = frame.sort_values(self.number)
            for n, *values in frame[[self.number, *self.names]].itertuples(index=False, name=None):
                values = tuple(None if v is None or v is pd.NA or v != v else v for v in values)
                if n == at:
                    out += self.handle_row(key, n, dict(zip(self.names, values)))
                    at = self._drain(key, at + 1, out)
                elif n > at:  # an earlier number again is a repeat and counts once
                    self.waiting.updateValue((int(n),), values)
            if len(out) >= 4096:
                yield self._frame(key, out)
                out = []
        if timer:
            self.handle.deleteTimer(timer)
        timer = timers.getCurrentProcessingTimeInMs() + IDLE
        self.handle.registerTimer(timer)
        self.next.update((int(at), timer))
        yield self._frame(key, out)

    def _drain(self, key, at: int, out: list[tuple]) -> int:
        while self.waiting.containsKey((at,)):
            out += self.handle_row(key, at, dict(zip(self.names, self.waiting.getValue((at,)))))
            self.waiting.removeKey((at,))
            at += 1
        return at

    def handleExpiredTimer(self, key, timers, info) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for (n,) in sorted(self.waiting.keys()):
            out += self.handle_row(key, n, dict(zip(self.names, self.waiting.getValue((n,)))))
        out += self.ended(key)
        self.waiting.clear()
        self.next.clear()
        yield self._frame(key, out)

    def ended(self, key) -> list[tuple]:
        return []

    def _frame(self, key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *row) for row in out], columns=self.columns)


# ---- dialogues ----

# Phrases that decide a turn's kind.
AFFIRMATIVE = r"^(y|ye|yes|yeah|yep|yup|ok|okay|sure|please|pls|do it|go ahead|escalate|raise it)\b"
NEGATIVE = r"^(n|no|nope|nah|not now|its ok|it's ok|no thanks|cancel)\b"
THANKS = r"^(thanks|thank you|thanku|ty|great|perfect|awesome|got it|cool)\b"
ACKNOWLEDGEMENT = r"^(ok|okay|okey|oke|k|kk|alright|all right|sure|fine|noted|understood|makes sense)\b"
TICKET = r"\b(raise|create|open|file|log|submit)\s+(a\s+|an\s+|the\s+)?(ticket|case|complaint|grievance|issue)\b"
HUMAN = r"\b(escalate\s+(this|it)|speak\s+(to|with)|talk\s+(to|with)|connect\s+me|put\s+me\s+through|need\s+a\s+human|real\s+person)\b"
PROCESS = r"\b(how\s+(do|can|would|should)\s+i|how\s+to|what.s?\s+the\s+process|where\s+do\s+i|can\s+i\s+see)\b"
GREETING = r"^(hi|hii|hello|hey|good morning|good afternoon|good evening|namaste)\b"
FOLLOW_UP = r"\b(what about|how about|and|also|mine|that|it|instead|too)\b"
REJECTED = r"none|neither|other"
HUMAN_ROUTES = ("hrbp", "hr_head", "hr_ops")
LEAST_OVERLAP, SHORT_REPLY = 0.4, 24


def says(pattern: str, message: str) -> bool:
    return re.search(pattern, message, re.IGNORECASE) is not None


def chosen(message: str, options: list[str]) -> str | None:
    """The option that a reply means: by number, by ordinal, or by the share of its words that the reply holds."""
    low = message.lower().strip()
    number = re.search(r"(?:option\s*)?([1-9])\b", low)
    if number and int(number[1]) <= len(options):
        return options[int(number[1]) - 1]
    for word, option in zip(("first", "second", "third"), options):
        if word in low:
            return option
    overlaps = []
    for option in options:
        words = [w for w in re.split("[^a-z]+", option.lower()) if len(w) > 2]
        overlaps.append(sum(w in low for w in words) / len(words) if words else 0.0)
    best = max(overlaps, default=0.0)
    return options[overlaps.index(best)] if best >= LEAST_OVERLAP else None


class Dialogue(InOrder):
    """What each user turn does, given what was offered, asked and said before.

    Columns: ``role, text``, and what is known of the message: ``decision`` (answer, escalate, clarify, sensitive), ``intent``, ``confidence``, ``route``,
    ``soft`` (a sensitive subject, only asked about), ``record`` (asks for an own record), ``covered`` (the documents answer it), ``options``
    (of a clarifying question, joined by |). Consent, choices and courtesies are settled from the state; the rest by these columns.
    """

    fields = "role string, text string, decision string, intent string, confidence double, route string, soft boolean, record boolean, covered boolean, options string"
    schema = "conv_id long, turn long, action string, intent string, route string, confidential boolean, about_turn long, offered boolean"
    columns = [f.split()[0] for f in schema.split(", ")]

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.offer = handle.getValueState("offer", "open boolean")
        self.pending = handle.getValueState("pending", "turn long, route string, confidential boolean, confidence double")
        self.topic = handle.getValueState("topic", "intent string")
        self.asked = handle.getListState("asked", "option string")

    def handle_row(self, key, n: int, row: dict) -> list[tuple]:
        if row["role"] != "user":
            return []
        raw = (row["text"] or "").strip()
        words = len(raw.split())
        offered = self.offer.exists() and self.offer.get()[0]
        before = self.pending.get() if self.pending.exists() else None
        options = [o[0] for o in self.asked.get()] if self.asked.exists() else []
        self.asked.clear()

        def done(action: str, intent: str | None = None, route: str | None = None, confidential: bool = False, about: int | None = None, offer: bool | None = None) -> list[tuple]:
            now = offered if offer is None else offer
            self.offer.update((now,))
            if intent:
                self.topic.update((intent,))
            return [(n, action, intent, route, confidential, n if about is None else about, now)]

        about = before[0] if before else n
        human = before[1] if before and before[1] in HUMAN_ROUTES else "hr_ops"
        private = bool(before and before[2])
        if options:
            option = chosen(raw, options)
            if option:
                return done("chosen", option, about=about, offer=False)
            if says(NEGATIVE, raw) or says(REJECTED, raw):
                return done("ticket_none_fits", route=human, about=about)
        if offered and says(AFFIRMATIVE, raw) and len(raw) <= SHORT_REPLY:
            return done("ticket_accepted", route=human, confidential=private, about=about, offer=False)
        if offered and says(NEGATIVE, raw):
            return done("offer_declined", about=about, offer=False)
        if says(GREETING, raw) and words <= 3:
            return done("greeting")
        if says(THANKS, raw) and words <= 4:
            return done("thanks")
        if says(ACKNOWLEDGEMENT, raw) and words <= 2 and not raw.endswith("?"):
            return done("acknowledged")
        decision, intent, soft = row["decision"], row["intent"], bool(row["soft"])
        if decision == "escalate" and self.topic.exists() and says(FOLLOW_UP, raw) and words <= 6:
            decision, intent = "answer", self.topic.get()[0]
        self.pending.update((n, "hr_head" if soft else row["route"], soft or decision == "sensitive", row["confidence"]))
        if decision == "sensitive":
            return done("ticket_sensitive", intent, row["route"] or "hr_head", True, offer=False)
        if (says(TICKET, raw) or says(HUMAN, raw)) and not says(PROCESS, raw):
            return done("ticket_requested", None, human, private, about, False)
        if row["record"] and intent:
            return done("record", intent, offer=False)
        if row["options"] and decision == "clarify" and not options:
            for option in row["options"].split("|"):
                self.asked.appendValue((option,))
            return done("clarify", offer=False)
        if row["covered"]:
            return done("answer", intent, offer=soft)
        return done("not_covered", intent if soft else None, "hr_head" if soft else "hr_ops", soft, offer=True)

    def ended(self, key) -> list[tuple]:
        for state in (self.offer, self.pending, self.topic, self.asked):
            state.clear()
        return []


def dialogue(turns: DataFrame) -> DataFrame:
    """O-CLS-7 over a stream of all turns (conv_id, turn and the columns of ``Dialogue``)."""
    return stateful(turns, "conv_id", Dialogue(), Dialogue.schema)


# ---- held-back answers ----


class HeldBack(InOrder):
    """Pieces of an answer; nothing is shown before ``HOLD_BACK`` characters or the end, and nothing at all of a refusal.

    Each piece gives a row with what it releases. The last one, or one that cancels, gives one more row: the final record of the
    answer. What comes after it is ignored.
    """

    number, fields = "seq", "piece string, last boolean, cancel boolean"
    schema = "answer_id long, seq long, kind string, released string, shown_chars long"
    columns = [f.split()[0] for f in schema.split(", ")]

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "piece string")
        self.shown = handle.getValueState("shown", "mode string, chars long")

    def handle_row(self, key, n: int, row: dict) -> list[tuple]:
        mode, chars = self.shown.get() if self.shown.exists() else ("hold", 0)
        if mode == "ended":
            return []
        if row["cancel"]:
            self.held.clear()
            self.shown.update(("ended", chars))
            return [(n, "cancelled", "", chars)]
        piece, released = row["piece"] or "", ""
        if mode == "hold":
            self.held.appendValue((piece,))
            opening = "".join(p for (p,) in self.held.get())
            if len(opening) >= HOLD_BACK or row["last"]:
                mode = "refused" if refused(opening[:HOLD_BACK]) else "open"
                released = opening if mode == "open" else ""
                self.held.clear()
        elif mode == "open":
            released = piece
        chars += len(released)
        out = [(n, "piece", released, chars)]
        if row["last"]:
            out.append((n, "refused" if mode == "refused" else "final", "", chars))
            mode = "ended"
        self.shown.update((mode, chars))
        return out

    def ended(self, key) -> list[tuple]:
        mode, chars = self.shown.get() if self.shown.exists() else ("hold", 0)
        self.held.clear()
        self.shown.clear()
        return [] if mode == "ended" else [(-1, "abandoned", "", chars)]


def refused(opening: str) -> bool:
    return SENTINEL in opening or re.search(answers.REFUSALS, opening, re.IGNORECASE) is not None


def held_back_stream(pieces: DataFrame) -> DataFrame:
    """O-STM-1 to O-STM-3 over a stream of (answer_id, seq, piece, last, cancel)."""
    return stateful(pieces, "answer_id", HeldBack(), HeldBack.schema)


# ---- denial alerts ----


class Denials(StatefulProcessor):
    """Denials of a subject that are at least the ``threshold``-th within the hour up to them, each with its exact count.

    A denial that comes late, but within the watermark, raises the counts of later ones: those are given out again, the greatest
    count of an event is the one that holds. Times more than an hour behind the watermark can count no more and are dropped.
    """

    schema = "user_id long, event_id long, recent long"

    def __init__(self, threshold: int) -> None:
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "at long, event_id long, recent long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        known = np.array(list(self.seen.get()) if self.seen.exists() else [], np.int64).reshape(-1, 3)
        fresh = [np.column_stack([f["at"].to_numpy(np.int64), f["event_id"].to_numpy(np.int64), np.zeros(len(f), np.int64)]) for f in rows]
        every = np.concatenate([known, *fresh])
        every = every[np.argsort(every[:, 0], kind="stable")]
        recent = np.searchsorted(every[:, 0], every[:, 0], "right") - np.searchsorted(every[:, 0], every[:, 0] - HOUR, "right")
        changed = (recent != every[:, 2]) & (recent >= self.threshold)
        every[:, 2] = recent
        keep = every[:, 0] > timers.getCurrentWatermarkInMs() * 1000 - HOUR
        self.seen.put([tuple(map(int, r)) for r in every[keep]])
        yield pd.DataFrame({"user_id": key[0], "event_id": every[changed, 1], "recent": recent[changed]})

    def close(self) -> None:
        pass


def denial_alerts(denials: DataFrame, threshold: int = 3, late: str = "2 hours") -> DataFrame:
    """O-STM-4 over a stream of denials (user_id, event_id, ts)."""
    from pyspark.sql import functions as F

    timed = denials.where("user_id is not null").withWatermark("ts", late).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("at"))
    return stateful(timed, "user_id", Denials(threshold), Denials.schema, "Update", "EventTime")
