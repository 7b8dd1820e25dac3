"""Live conversations: the constraint ledger over a stream of messages, equal to the batch ledger turn by turn.

Each session is a keyed state: a map from its turns to what they stated, the slots
that an override named among it. A message that comes late, or again,
is put in its turn, and that turn and all after it are told anew under a higher
``revision``; the last revision of a turn is what the batch ledger says of the
turns heard. The vocabulary is a static table of bounded size; tokens and slots
are column expressions, so only the fold over a session's own turns is Python.
A session that says nothing for ``idle`` milliseconds is dropped by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as X
from ..operators.catalogs import ngrams, term_sizes
from ..operators.state import DURABLE, TERM_LIMIT

#: A session that says nothing for a day is dropped.
TIMEOUT_MS = 86_400_000
#: Terms of a vocabulary that goes to every task as one row.
MOST_TERMS = 200_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ACTIVE = "array<struct<token:string,slot:string,first_turn:bigint,place:int>>"
OUT = f"session string, turn long, revision long, gained int, stuck_for int, active {ACTIVE}"


def heard(messages: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(session, turn, override, named, stated) of (session, turn, message): the slots named, and each token with its place and the first slot that claims it."""
    if vocabulary.count() > MOST_TERMS:
        raise ValueError(f"a live vocabulary has at most {MOST_TERMS} terms")
    per = vocabulary.groupBy("term").agg(F.array_sort(F.collect_set("slot")).alias("slots"))
    material = F.collect_set(F.when(F.array_contains("slots", "material"), F.col("term")))
    known = per.agg(F.map_from_entries(F.collect_list(F.struct("term", "slots"))).alias("_known"), material.alias("_m"), term_sizes(F.col("term")).alias("_n"))  # one row, at most MOST_TERMS terms
    hay = F.when(X.is_no_preference(F.col("message")), F.lit(" ")).otherwise(F.concat(F.lit(" "), X.normalize_term(F.col("message")), F.lit(" ")))
    rows = messages.join(F.broadcast(known)).withColumn("_runs", F.array_distinct(ngrams(X.apply_aliases(hay, F.col("_m")), F.col("_n"))))
    pairs = F.flatten(F.transform("_runs", lambda r: F.transform(F.coalesce(F.try_element_at("_known", r), F.expr("cast(array() as array<string>)")), lambda s: F.struct(s.alias("slot"), r.alias("term")))))
    rows = rows.withColumn("_pairs", pairs)
    spaced = lambda t: F.concat(F.lit(" "), t, F.lit(" "))
    longer = lambda p, g: (g["slot"] == p["slot"]) & (g["term"] != p["term"]) & F.contains(spaced(g["term"]), spaced(p["term"]))
    rows = rows.withColumn("_slots", F.filter("_pairs", lambda p: ~F.exists("_pairs", lambda g: longer(p, g))))

    def slot_of(token: Column) -> Column:
        return F.array_min(F.transform(F.filter("_slots", lambda p: F.array_contains(F.split(p["term"], " "), X.normalize_term(token))), lambda p: p["slot"]))

    stated = F.transform(X.constraint_tokens(F.col("message")), lambda t, i: F.struct(t.alias("token"), i.cast("long").alias("pos"), slot_of(t).alias("slot")))
    return rows.select(
        F.col("session").cast("string").alias("session"), F.col("turn").cast("long").alias("turn"), X.is_override(F.col("message")).alias("override"),
        F.array_distinct(F.transform("_slots", lambda p: p["slot"])).alias("named"), stated.alias("stated"),
    )


def told(turns: dict[int, tuple], limit: int | None) -> Iterator[tuple[int, int, int, list[dict]]]:
    """(turn, gained, stuck_for, active) of each of a session's turns (override, named, stated): the ledger as a fold over them."""
    opening, stuck = min(turns), 0
    entries: dict[str, dict] = {}
    for turn in sorted(turns):
        override, named, stated = turns[turn]
        for e in entries.values() if override else ():  # it comes before what the same message states
            if e["slot"] in named or (e["slot"] not in DURABLE and e["first"][0] <= opening):
                e["active"] = False
        gained = 0
        for token, pos, slot in sorted(stated, key=lambda m: m[1]):
            e = entries.setdefault(token, {"first": (turn, pos), "slot": None, "active": False})
            gained += not e["active"]
            e["active"], e["slot"] = True, e["slot"] or slot
        stuck = 0 if gained else stuck + 1
        active = sorted((e["first"], token, e["slot"]) for token, e in entries.items() if e["active"])[:limit]
        yield turn, gained, stuck, [{"token": t, "slot": s, "first_turn": f[0], "place": i} for i, (f, t, s) in enumerate(active, 1)]


class Ledger(StatefulProcessor):
    """A session's ledger: what each of its turns stated, in a map by turn, so that a message costs one update."""

    def __init__(self, idle: int = TIMEOUT_MS, limit: int | None = TERM_LIMIT):
        self.idle, self.limit = idle, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getMapState("turns", "turn bigint", "override boolean, named array<string>, stated array<struct<token:string,pos:bigint,slot:string>>")
        self.seen = handle.getValueState("seen", "revision bigint, last bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mention = lambda m: (m["token"], int(m["pos"]), m["slot"])
        turns = {k[0]: (v[0], {*v[1]}, {mention(m) for m in v[2]}) for k, v in self.turns.iterator()}
        before, changed = self.seen.get(), set()
        for frame in rows:
            for turn, override, named, stated in frame[["turn", "override", "named", "stated"]].itertuples(index=False):
                old = turns.get(int(turn), (False, set(), set()))
                now = (bool(override) or old[0], old[1] | {*(named if override else ())}, old[2] | {mention(m) for m in stated})
                if now != old or int(turn) not in turns:  # else it was heard before
                    turns[int(turn)] = now
                    changed.add(int(turn))
        for t in changed:
            override, named, stated = turns[t]
            self.turns.updateValue((t,), (override, sorted(named), [{"token": a, "pos": b, "slot": c} for a, b, c in sorted(stated, key=lambda m: m[1])]))
        now = timerValues.getCurrentProcessingTimeInMs()
        if before is None:
            self.handle.registerTimer(now + self.idle)
        revision = (before[0] if before else 0) + bool(changed)
        self.seen.update((revision, now))
        if changed:
            since = min(changed) if min(changed) > min(turns) else min(turns)  # a new first turn changes what opens the session
            out = [(key[0], t, revision, g, s, a) for t, g, s, a in told(turns, self.limit) if t >= since]
            yield pd.DataFrame(out, columns=["session", "turn", "revision", "gained", "stuck_for", "active"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Drop the session, or wait on if it has said something since."""
        due = self.seen.get()[1] + self.idle
        if due > timerValues.getCurrentProcessingTimeInMs():
            self.handle.registerTimer(due)
        else:
            self.turns.clear()
            self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def live_ledger(messages: DataFrame, vocabulary: DataFrame, idle: int = TIMEOUT_MS, limit: int | None = TERM_LIMIT) -> DataFrame:
    """(session, turn, revision, gained, stuck_for, active) of a stream of (session, turn, message); update mode."""
    conf = messages.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # what this kind of state needs
    return heard(messages, vocabulary).groupBy("session").transformWithStateInPandas(Ledger(idle, limit), OUT, "update", "processingTime")


def latest(told_rows: DataFrame) -> DataFrame:
    """(sample_id, turn, token, slot, first_turn, place): the last revision of each turn, a row for each active token."""
    last = told_rows.groupBy("session", "turn").agg(F.max_by("active", "revision").alias("active"))
    return last.select(F.col("session").alias("sample_id"), "turn", F.explode("active").alias("a")).select("sample_id", "turn", "a.token", "a.slot", "a.first_turn", "a.place")
