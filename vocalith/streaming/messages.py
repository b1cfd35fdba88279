"""Providers' messages as trace events, over stored messages or a stream of them.

Three steps: ``parsed`` reads a message natively; a session's state adds flags (what ended before, whose commit it is);
``events`` maps message and flags to events natively. Only the flags differ between the two forms: windows over stored
messages (``flags``), a state per session on a stream (``stream_flags``), which puts messages in order by ``seq`` first.

Input: (session, seq, t_ns, provider, message, sent): ``seq`` counts from 0 in a session; ``sent`` is null for what came in,
else ``finalize`` or ``close``. Providers: nova, flux, assemblyai, elevenlabs. Messages that aren't JSON count as unknown.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from vocalith.sources.schemas import WORDS

INPUT = "session STRING, seq BIGINT, t_ns BIGINT, provider STRING, message STRING, sent STRING"
_WORD = "STRUCT<text: STRING, word: STRING, punctuated_word: STRING, start: DOUBLE, end: DOUBLE, type: STRING>"
_ALTERNATIVE = f"STRUCT<transcript: STRING, words: ARRAY<{_WORD}>>"
MESSAGE = (
    f"type STRING, message_type STRING, is_final BOOLEAN, speech_final BOOLEAN, last_word_end DOUBLE, event STRING, trigger STRING, transcript STRING, text STRING, "
    f"turn_order INT, end_of_turn BOOLEAN, turn_is_formatted BOOLEAN, words ARRAY<{_WORD}>, channel STRUCT<alternatives: ARRAY<{_ALTERNATIVE}>>"
)
#: Message types with which one provider reports errors.
ERRORS = (
    "error", "auth_error", "quota_exceeded", "commit_throttled", "unaccepted_terms", "rate_limited", "queue_overflow", "resource_exhausted",
    "session_time_limit_exceeded", "input_error", "invalid_request", "chunk_size_exceeded", "insufficient_audio_activity", "transcriber_error",
)
FLAGS = "first_end BOOLEAN, first_final BOOLEAN, final_before BOOLEAN, own BOOLEAN, over BOOLEAN"


def _true(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def parsed(messages: DataFrame, expect_formatted: bool = True) -> DataFrame:
    """The input with the message's fields ``m`` and what a session's state needs of it."""
    m = messages.withColumn("m", F.when(F.col("sent").isNull(), F.from_json("message", MESSAGE)))
    aai, eleven = F.col("provider") == "assemblyai", F.col("provider") == "elevenlabs"
    end = aai & (F.col("m.type") == "Turn") & _true("m.end_of_turn")
    with_times = F.col("m.message_type") == "committed_transcript_with_timestamps"
    stop = (
        (F.col("provider") == "nova") & (F.col("m.type") == "Metadata") | aai & F.col("m.type").isin("Termination", "Error") | eleven & F.col("m.message_type").isin(*ERRORS)
    )
    return m.select(
        *messages.columns, "m", F.coalesce("m.turn_order", F.lit(-1)).alias("turn"), _true(end).alias("ends"),
        _true(end & (F.lit(not expect_formatted) | _true("m.turn_is_formatted"))).alias("finishes"),
        (eleven & F.col("sent").isNotNull()).alias("commits"), _true(eleven & (F.col("m.message_type") == "committed_transcript")).alias("committed"),
        (F.col("sent") == "close").alias("closes"), _true(stop).alias("stops"), _true(eleven & with_times).alias("stops_if_closing"),
    ).withColumn("closes", _true("closes"))


def flags(p: DataFrame) -> DataFrame:
    """``parsed`` with flags, by windows.

    Commits of ours that await an answer are a counter that answers lower but never below 0: its value is the running sum
    less the least running sum so far, if that is negative.
    """
    turn = Window.partitionBy("session", "turn").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    session = Window.partitionBy("session").orderBy("seq")
    before, so_far = session.rowsBetween(Window.unboundedPreceding, -1), session.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("commits"), 1).when(F.col("committed"), -1).otherwise(0)
    t = p.withColumns({"ended": _true(F.max("ends").over(turn)), "final_before": _true(F.max("finishes").over(turn)), "total": F.sum(step).over(so_far)})
    t = t.withColumns({"closing": _true(F.max("closes").over(before)), "sum": F.coalesce(F.lag("total").over(session), F.lit(0)), "least": F.least(F.lit(0), F.coalesce(F.min("total").over(before), F.lit(0)))})
    t = t.withColumns({"first_end": F.col("ends") & ~F.col("ended"), "first_final": F.col("finishes") & ~F.col("final_before"), "own": F.col("committed") & (F.col("sum") > F.col("least"))})
    t = t.withColumn("last", F.col("stops") | (F.col("stops_if_closing") & F.col("closing")))
    return t.withColumn("over", _true(F.max("last").over(before))).drop("ended", "total", "sum", "least", "closing", "last")


#: What a session's state needs of a message, and what it finds out, as bits. Through the state a message goes as one text: ``seq turn bits rest`` in,
#: ``seq flags rest`` out, with its fields in ``rest``; pandas' price is by column and session, and a session has few rows.
_ASKED = ("ends", "finishes", "commits", "committed", "closes", "stops", "stops_if_closing")
_FOUND = tuple(f.split()[0] for f in FLAGS.split(", "))
ENDS, FINISHES, COMMITS, COMMITTED, CLOSES, STOPS, STOPS_IF_CLOSING = (1 << i for i in range(len(_ASKED)))
FIRST_END, FIRST_FINAL, FINAL_BEFORE, OWN, OVER = (1 << i for i in range(len(_FOUND)))
_REST = "session STRING, t_ns BIGINT, provider STRING, message STRING, sent STRING"
#: Turns whose marks share a value of the state.
_TURNS = 32
#: What a stream's session must set: state that is kept message by message needs it.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Flags(StatefulProcessor):
    """``flags`` of a session's messages in order of ``seq``, in state that lies message by message and turn by turn.

    A message that comes in order is never stored: only those that wait for an earlier one are, each under its own key. The session's counters are
    one small value, what is known of 32 turns another. With a timeout, a session without news for that long of processing time is
    closed by a timer: what waits goes out in order, the missing messages left out, and all its state is deleted.

    Each look at the state is a call to the JVM. So nothing is looked for where the counters say that nothing waits or that the session is new, and turns are written once a batch.
    """

    def __init__(self, timeout_ms: int | None):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next BIGINT, own BIGINT, closing BOOLEAN, over BOOLEAN, due BIGINT, held BIGINT")
        self.waiting = handle.getMapState("waiting", "seq BIGINT", "turn INT, bits INT, rest STRING")
        self.turns = handle.getMapState("turns", "block INT", "ended BIGINT, final BIGINT")

    def _begin(self) -> None:
        self.new = not self.at.exists()
        self.next, self.own, self.closing, self.over, self.due, self.held = (0, 0, False, False, None, 0) if self.new else tuple(self.at.get())
        self.known: dict[int, tuple[int, int]] = {}  # a block's turns that ended, and that are final, as bits
        self.changed: set[int] = set()

    def _flag(self, seq: int, turn: int, bits: int, rest: str) -> str:
        """The session's next message with its flags, and what is known after it."""
        block, mark = turn // _TURNS, 1 << turn % _TURNS
        if block not in self.known:
            self.known[block] = tuple(self.turns.getValue((block,))) if not self.new and self.turns.containsKey((block,)) else (0, 0)
        ended, final = self.known[block]
        own = bool(bits & COMMITTED) and self.own > 0
        out = FIRST_END * bool(bits & ENDS and not ended & mark) | FIRST_FINAL * bool(bits & FINISHES and not final & mark) | FINAL_BEFORE * bool(final & mark) | OWN * own | OVER * self.over
        if out & (FIRST_END | FIRST_FINAL):
            self.known[block] = (ended | mark * bool(bits & ENDS), final | mark * bool(bits & FINISHES))
            self.changed.add(block)
        self.over = self.over or bool(bits & STOPS) or bool(bits & STOPS_IF_CLOSING) and self.closing
        self.own += bool(bits & COMMITS) - own
        self.closing = self.closing or bool(bits & CLOSES)
        self.next = seq + 1
        return f"{seq} {out} {rest}"

    def _stored(self, seq: int) -> tuple[int, int, int, str] | None:
        """The message that waits under ``seq``, which waits no longer."""
        if not self.held or not self.waiting.containsKey((seq,)):
            return None
        row = self.waiting.getValue((seq,))
        self.waiting.removeKey((seq,))
        self.held -= 1
        return (seq, *row)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        self._begin()
        came: dict[int, tuple] = {}
        for b in rows:
            for item in b["item"].tolist():
                if item is None:
                    raise ValueError(f"a message of session {key[0]} has no seq")
                seq, turn, bits, rest = item.split(" ", 3)
                if (at := int(seq)) >= self.next:
                    came.setdefault(at, (at, int(turn), int(bits), rest))
            ready = []
            while True:
                row, stored = came.pop(self.next, None), self._stored(self.next)  # repeated: the first that came counts
                if not (row := stored or row):
                    break
                ready.append(self._flag(*row))
            if ready:
                yield pd.DataFrame({"item": ready})
        for seq, row in came.items():
            if seq > self.next and not (self.held and self.waiting.containsKey((seq,))):
                self.waiting.updateValue((seq,), row[1:])
                self.held += 1
        for block in self.changed:
            self.turns.updateValue((block,), self.known[block])
        if self.timeout_ms is not None:
            if self.due is not None:
                self.handle.deleteTimer(self.due)
            self.due = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
            self.handle.registerTimer(self.due)
        self.at.update((self.next, self.own, self.closing, self.over, self.due, self.held))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._begin()
        late = [self._flag(*self._stored(seq)) for seq in sorted(k[0] for k in self.waiting.keys())]
        for state in (self.at, self.waiting, self.turns):
            state.clear()
        if late:
            yield pd.DataFrame({"item": late})

    def close(self) -> None:
        pass


def stream_flags(p: DataFrame, timeout_ms: int | None = 600_000) -> DataFrame:
    """``flags`` for a stream: messages wait in the session's state until those before them have come; see ``Flags``.

    Without a timeout nothing is given up and states stay, which suits replays that end (``availableNow``). The stream's session must have ``STORE`` set.
    """
    conf = p.sparkSession.conf
    if odd := {k: v for k, v in STORE.items() if conf.get(k, None) != v}:
        raise ValueError(f"set {odd} before the stream starts")
    bits = sum((F.when(_true(c), 1 << i).otherwise(0) for i, c in enumerate(_ASKED)), F.lit(0))
    item = F.concat("seq", F.lit(" "), "turn", F.lit(" "), bits, F.lit(" "), F.to_json(F.struct("session", "t_ns", "provider", "message", "sent")))
    flat = p.select("session", item.alias("item"))
    done = flat.groupBy("session").transformWithStateInPandas(Flags(timeout_ms), "item STRING", "append", "None" if timeout_ms is None else "processingTime")
    part = F.split("item", " ", 3)
    done = done.select(part[0].cast("bigint").alias("seq"), part[1].cast("int").alias("flags"), F.from_json(part[2], _REST).alias("rest"))
    found = [(F.col("flags").bitwiseAND(1 << i) != 0).alias(f) for i, f in enumerate(_FOUND)]
    done = done.select("rest.session", "seq", "rest.t_ns", "rest.provider", "rest.message", "rest.sent", *found)
    return done.withColumn("m", F.when(F.col("sent").isNull(), F.from_json("message", MESSAGE)))


def _seconds(words: Column) -> Column:
    """Words with times in ms; null if there are none or any lacks a time."""
    whole = (F.size(words) > 0) & F.forall(words, lambda w: w.start.isNotNull() & w.end.isNotNull())
    ms = F.transform(words, lambda w: F.struct(F.coalesce(F.nullif(w.punctuated_word, F.lit("")), w.word, F.lit("")).alias("text"), (w.start * 1000).alias("start_ms"), (w.end * 1000).alias("end_ms")))
    return F.when(whole, ms)


def _some(words: Column, scale: int, whole: Column) -> Column:
    """Words that have times, in ms; null if there are none."""
    kept = F.filter(words, lambda w: w.start.isNotNull() & (w.end.isNotNull() if scale == 1 else F.coalesce(w.type, F.lit("word")) == "word"))
    return F.when(whole & (F.size(kept) > 0), F.transform(kept, lambda w: F.struct(w.text.alias("text"), (w.start * scale).alias("start_ms"), (w.end * scale).alias("end_ms"))))


def _event(kind: str, when: Column, text: Column | None = None, words: Column | None = None) -> Column:
    return F.when(
        F.coalesce(when, F.lit(False)),
        F.struct(F.lit(kind).alias("kind"), (text if text is not None else F.lit(None).cast("string")).alias("text"), (words if words is not None else F.lit(None)).cast(WORDS).alias("words")),
    )


def events(flagged: DataFrame) -> DataFrame:
    """(session, seq, part, t_ns, kind, text, words, raw): each received message's events up to the one that ends its session; unknown ones are ``info``."""
    m, provider = (lambda f: F.col(f"m.{f}")), F.col("provider")
    nova, flux, aai, eleven = (provider == p for p in ("nova", "flux", "assemblyai", "elevenlabs"))
    kind, other = m("type"), m("message_type")
    first = F.get(m("channel.alternatives"), F.lit(0))
    results, turn, info = nova & (kind == "Results"), aai & (kind == "Turn"), flux & (kind == "TurnInfo")
    said, heard, text = F.coalesce(first.transcript, F.lit("")), F.coalesce(m("transcript"), F.lit("")), F.coalesce(m("text"), F.lit(""))
    over, with_times = info & (m("event") == "EndOfTurn"), eleven & (other == "committed_transcript_with_timestamps")
    ends = _true("m.end_of_turn")
    out = F.array_compact(
        F.array(
            _event("final", results & _true("m.is_final"), said, _seconds(first.words)),
            _event("partial", results & ~_true("m.is_final") & (said != ""), said),
            _event("endpoint", results & _true("m.speech_final") | nova & (kind == "UtteranceEnd") & (F.coalesce(m("last_word_end"), F.lit(0.0)) != -1)),
            _event("vad_event", (nova | aai) & (kind == "SpeechStarted") | info & (m("event") == "StartOfTurn")),
            _event("final", over, heard, _seconds(m("words"))),
            _event("endpoint", over & (F.coalesce(m("trigger"), F.lit("")) != "manual")),
            _event("partial", info & (F.coalesce(m("event"), F.lit("")) != "EndOfTurn") & (heard != ""), heard),
            _event("final", turn & F.col("first_final"), heard, _some(m("words"), 1, turn)),
            _event("endpoint", turn & F.col("first_end")),
            _event("partial", turn & (heard != "") & (~ends | ~F.col("first_final") & ~F.col("final_before")), heard),
            _event("partial", eleven & (other == "partial_transcript") & (text != ""), text),
            _event("info", F.col("own")),
            _event("endpoint", eleven & (other == "committed_transcript") & ~F.col("own")),
            _event("final", with_times, text, _some(m("words"), 1000, with_times)),
            _event("error", (nova | flux | aai) & (kind == "Error") | eleven & other.isin(*ERRORS)),
        )
    )
    mapped = F.when(F.size(out) > 0, out).otherwise(F.array(_event("info", F.lit(True))))
    seen = flagged.filter(F.col("sent").isNull() & ~F.col("over"))
    return seen.select("session", "seq", "t_ns", F.posexplode(mapped).alias("part", "e"), F.col("message").alias("raw")).select("session", "seq", "part", "t_ns", "e.kind", "e.text", "e.words", "raw")


def batch_events(messages: DataFrame, expect_formatted: bool = True) -> DataFrame:
    return events(flags(parsed(messages, expect_formatted)))


def stream_events(messages: DataFrame, expect_formatted: bool = True, timeout_ms: int | None = 600_000) -> DataFrame:
    """Events of a stream of messages as they arrive, be they of ``readStream.json`` or of ``providers.stream_messages``."""
    return events(stream_flags(parsed(messages, expect_formatted), timeout_ms))
