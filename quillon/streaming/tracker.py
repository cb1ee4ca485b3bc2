"""Live task costs: usage records come in, each is accepted, a duplicate or rejected, and every engine's snapshot follows.

A task is a key of the stream. Its engines (one for each harness and contract) share the ids they have
seen, so a record that comes again counts once whatever engine sends it. State is kept so that a
record costs the same whenever it comes: tallies are sums that can be taken back, a session remembers
its last counters, and only a late or a superseded record makes its session be reckoned anew.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, StructType

from ..functions import exprs as X
from ..operators import cost

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
AMOUNTS = ("actual_micros", "estimated_micros")
# Contracts of the harnesses that have one of their own, what a contract looks like, and cost bases.
CONTRACTS = {"claude-code": "claude-code/1", "codex": "codex/2"}
CONTRACT, BASES = r"^[a-z][a-z0-9-]{0,31}/[0-9]{1,4}$", ("per_token_api", "subscription", "unknown")

RESULT = "kind string, harness string, contract string, event_id string, status string, reason string, sequence long, version long"
SNAPSHOT = (
    ", ".join(f"{t} long" for t in TOKENS) + ", total_micros long, lower_bound_micros long, cost_source string, coverage string, cost_basis string, sessions long, turns long, models long, observations long"
)


def with_defaults(records: DataFrame, harness: str = "unknown", contract: str | None = None, basis: str = "per_token_api") -> DataFrame:
    """Records with what a tracker fills in: harness, contract, session (the task), basis and kind of usage; ``reason`` says why one is rejected.

    Columns that aren't there are taken as null. The turn defaults to the event, sequence and id of a
    record that has none are given as it comes in.
    """
    have = set(records.columns)

    def given(name: str, kind: str) -> Column:
        return (F.col(name) if name in have else F.lit(None)).cast(kind)

    own = given("harness", "string")
    filled = F.coalesce(own, F.lit(harness))
    usual = F.coalesce(*[F.when(filled == h, c) for h, c in CONTRACTS.items()], F.concat(filled, F.lit("/1")))
    made = F.coalesce(given("contract", "string"), F.when(own.isNull() | (own == harness), F.lit(contract)), usual)
    rows = records.select(
        given("task_id", "string").alias("task_id"), given("event_id", "string").alias("event_id"), given("ordinal", "long").alias("ordinal"), filled.alias("harness"), made.alias("contract"),
        F.coalesce(given("session_id", "string"), given("task_id", "string")).alias("session_id"), given("turn_id", "string").alias("turn_id"), given("sequence", "long").alias("sequence"), given("model", "string").alias("model"),
        F.coalesce(given("usage_kind", "string"), F.lit("delta")).alias("usage_kind"), given("replay_of", "string").alias("replay_of"), *[given(c, "long").alias(c) for c in (*TOKENS, *AMOUNTS)],
        given("coverage", "string").alias("coverage"), F.coalesce(given("cost_basis", "string"), F.lit(basis)).alias("cost_basis"), given("ts", "timestamp").alias("ts"),
    )
    usage = [F.col(t) for t in TOKENS]
    negative = F.greatest(*[F.coalesce(x < 0, F.lit(False)) for x in (*usage, *[F.col(a) for a in AMOUNTS])])
    reason = (
        F.when(F.col("event_id") == "", "eventId must be a non-empty string")
        .when(~F.col("harness").isin(*cost.HARNESSES), "harness must be a known one")
        .when(~F.col("contract").rlike(CONTRACT), "providerContractVersion must match the contract pattern")
        .when(F.col("usage_kind").isin("delta", "cumulative") == F.lit(False), "usage kind must be delta or cumulative")
        .when(negative, "invalid_token_usage: counts start at zero")
        .when((F.col("cost_basis") == "subscription") & F.col("actual_micros").isNotNull(), "a subscription has no charge")
        .when(F.col("replay_of") == F.col("event_id"), "an event can't replay itself")
    )
    return rows.withColumns({"coverage": F.coalesce("coverage", F.when(X.usage_availability(usage) == "available", "complete").otherwise(X.usage_availability(usage))), "reason": reason})


def snapshot(tally: Counter) -> dict:
    """What an engine's tally says, as the batch aggregate says it."""
    n = tally["n"]

    def seen(kind: str) -> set[str]:
        return {k.split(":", 1)[1] for k, v in tally.items() if v and k.startswith(f"{kind}:")}

    source, coverage, basis = seen("source"), seen("coverage"), seen("basis")
    promoted = "none"
    if source - {"none"}:
        promoted = "mixed" if len(source - {"none"}) > 1 else (source - {"none"}).pop()
    covered = "partial"
    for whole, name in (({"unavailable"}, "unavailable"), ({"known_zero"}, "known_zero"), ({"complete", "known_zero"}, "complete")):
        if coverage <= whole:
            covered = name
            break
    return {
        **{t: tally[f"sum:{t}"] if tally[f"known:{t}"] else None for t in TOKENS}, "total_micros": tally["cost"] if n and tally["priced"] == n else None, "lower_bound_micros": tally["cost"] if tally["priced"] else None,
        "cost_source": promoted, "coverage": covered, "cost_basis": basis.pop() if len(basis) == 1 else "unknown", "sessions": tally["sessions"], "turns": tally["turns"], "models": len(seen("model")), "observations": n,
    }


class Session:
    """A session of an engine: its tally, the last counters, the place of the last record and its turns."""

    def __init__(self, text: str | None = None):
        kept = json.loads(text) if text else {"tally": {}, "last": {}, "end": None}
        self.tally, self.last, self.end = Counter(kept["tally"]), kept["last"], kept["end"]

    def dumps(self) -> str:
        return json.dumps({"tally": {k: v for k, v in self.tally.items() if v}, "last": self.last, "end": self.end})

    def add(self, row: dict, new_turn: bool) -> None:
        """The next record in order; of counters that run on only the step counts."""
        x = dict(row)
        if row["usage_kind"] == "cumulative":
            for f in (*TOKENS, *AMOUNTS):
                value = row.get(f)
                if value is not None:
                    x[f] = max(value - self.last[f], 0) if f in self.last else value
                    self.last[f] = value
        self.end = place(row)
        amount = x.get("actual_micros") if x.get("actual_micros") is not None else x.get("estimated_micros")
        source = "provider_reported" if x.get("actual_micros") is not None else "local_estimate" if x.get("estimated_micros") is not None else "none"
        t = self.tally
        t["sessions"] = 1
        t["n"] += 1
        t["turns"] += new_turn
        for f in TOKENS:
            if x.get(f) is not None:
                t[f"sum:{f}"] += x[f]
                t[f"known:{f}"] += 1
        if amount is not None:
            t["cost"] += amount
            t["priced"] += 1
        for kind, value in (("source", source), ("coverage", x["coverage"]), ("basis", x["cost_basis"]), ("model", x.get("model"))):
            if value is not None:
                t[f"{kind}:{value}"] += 1


def place(row: dict) -> list:
    return [row["sequence"], row["event_id"]]


#: Fields of an accepted record that its session is reckoned from.
KEPT = ("turn_id", "sequence", "usage_kind", "replay_of", *TOKENS, *AMOUNTS, "coverage", "cost_basis", "model")
#: A task's state is cut in two once a part of it has so many entries on average.
PART = 256


class Kept:
    """A task's state while a batch of it is taken up: parts are read when something in them is asked for and written once, if they changed.

    A call to the state store costs as much as a hundred entries that are read with one, so entries lie in
    parts by the hash of their event, session or turn. A part has a bounded number of entries: what
    a record costs doesn't grow with its task.
    """

    def __init__(self, state):
        self.state, self.loaded, self.changed = state, {}, {0}
        first = self.part(0)
        self.head = first.setdefault("", {"parts": 1, "entries": 0, "engines": {}, "counters": {}})

    def part(self, n: int, keep: bool = True) -> dict:
        if n in self.loaded:
            return self.loaded[n]
        found = self.state.getValue((n,))
        part = json.loads(found[0]) if found else {}
        if keep:
            self.loaded[n] = part
        return part

    def _of(self, place: str) -> int:
        return zlib.crc32(place.encode()) & (self.head["parts"] - 1)

    def get(self, key: str, place: str):
        return self.part(self._of(place)).get(key, (None,))[0]

    def put(self, key: str, place: str, value) -> None:
        part = self.part(n := self._of(place))
        self.head["entries"] += key not in part
        part[key] = (value, place)
        self.changed.add(n)

    def drop(self, key: str, place: str) -> None:
        part = self.part(n := self._of(place))
        if part.pop(key, None) is not None:
            self.head["entries"] -= 1
            self.changed.add(n)

    def events(self) -> Iterator[tuple[str, list]]:
        """All accepted records; a part that nothing else asked for is let go again."""
        for n in range(self.head["parts"]):
            yield from ((key[1:], entry[0]) for key, entry in self.part(n, keep=False).items() if key.startswith("e"))

    def write(self) -> None:
        if (wanted := self.head["entries"] / PART) > self.head["parts"]:
            every = [self.part(n) for n in range(self.head["parts"])]
            while wanted > self.head["parts"]:
                self.head["parts"] *= 2
            self.loaded = {n: {} for n in range(self.head["parts"])}
            self.loaded[0][""] = self.head
            for key, entry in (x for part in every for x in part.items() if x[0]):
                self.loaded[self._of(entry[1])][key] = entry
            self.changed = set(self.loaded)
        for n in sorted(self.changed):
            self.state.updateValue((n,), (json.dumps(self.loaded[n], separators=(",", ":")),))


class TaskTracker(StatefulProcessor):
    """The engines of one task; see the module. ``idle_ms``: a task without records for so long (event time) is closed and forgotten."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: e, an event: its engine, session, if it counts, and its record as it was accepted; s, an engine and event: by what it is superseded;
        #: h, an engine and session: its Session; t, a turn of it: its records; n: a counter of sequences. Part 0 also has the engines' tallies and the task's counters
        self.parts = handle.getMapState("parts", "part int", "entries string")

    def close(self) -> None:
        pass

    def _next(self, name: str) -> int:
        counters = self.kept.head["counters"]
        counters[name] = counters.get(name, 0) + 1
        return counters[name]

    def _next_sequence(self, engine: str, session: str) -> int:
        n = (self.kept.get(key := f"n{engine} {session}", session) or 0) + 1
        self.kept.put(key, session, n)
        return n

    def _is_superseded(self, engine: str, event: str) -> bool:
        return self.kept.get(f"s{engine} {event}", event) is not None

    def _accept(self, task: str, row: dict, stale: set, fresh: dict) -> dict:
        """The record's fate; ``stale``: sessions to be reckoned anew, ``fresh``: records that follow on their session's last."""
        engine = f"{row['harness']} {row['contract']}"
        out = {"kind": "result", "harness": row["harness"], "contract": row["contract"], "event_id": row.get("event_id"), "status": "rejected", "reason": row.get("reason")}
        if row.get("event_id") is None:
            while True:
                row["event_id"] = f"{task}.e{self._next('id')}"
                if self.kept.get(f"e{row['event_id']}", row["event_id"]) is None:
                    break
        event = row["event_id"]
        if row.get("sequence") is None:
            row["sequence"] = self._next_sequence(engine, row["session_id"])
        out |= {"event_id": event, "sequence": row["sequence"]}
        if row.get("reason") is not None:
            return out
        if self.kept.get(f"e{event}", event) is not None:
            return out | {"status": "duplicate"}
        row["turn_id"] = row.get("turn_id") or event
        counts = not self._is_superseded(engine, event)
        home = (engine, row["session_id"])
        self.kept.put(f"e{event}", event, [*home, counts, [row.get(f) for f in KEPT]])
        if (target := row.get("replay_of")) is not None:
            self.kept.put(f"s{engine} {target}", target, event)
            self._take_back(engine, target, stale)
            if self._runs_in_a_circle(engine, event, target):
                self.kept.head["counters"][f"broken {engine}"] = 1
        if counts:
            fresh.setdefault(home, []).append(row)
        fresh.setdefault(home, [])
        return out | {"status": "accepted"}

    def _take_back(self, engine: str, target: str, stale: set) -> None:
        old = self.kept.get(f"e{target}", target)
        if old is not None and old[0] == engine and old[2]:
            self.kept.put(f"e{target}", target, [*old[:2], False, old[3]])
            stale.add((engine, old[1]))

    def _runs_in_a_circle(self, engine: str, start: str, at: str) -> bool:
        while at is not None and at != start:
            found = self.kept.get(f"e{at}", at)
            at = found[3][KEPT.index("replay_of")] if found and found[0] == engine else None
        return at == start

    def _turn(self, home: tuple, turn: str) -> str:
        return f"t{home[0]} {len(home[1])} {home[1]} {turn}"

    def _new_turn(self, home: tuple, turn: str) -> bool:
        n = self.kept.get(key := self._turn(home, turn), turn) or 0
        self.kept.put(key, turn, n + 1)
        return n == 0

    def _settle(self, stale: set, fresh: dict) -> set[str]:
        """Sessions and engines brought up to date; gives the engines that changed."""
        kept = {home: Session(self.kept.get(f"h{home[0]} {home[1]}", home[1])) for home in {*fresh, *stale}}
        for home, rows in fresh.items():
            if rows and kept[home].end is not None and min(map(place, rows)) < kept[home].end:
                stale.add(home)  # a late one
        again: dict[tuple, list[tuple[bool, dict]]] = {home: [] for home in stale}
        if stale:
            for event, (engine, session, counts, values) in self.kept.events():
                if (home := (engine, session)) in again:
                    again[home].append((counts, {"event_id": event, **dict(zip(KEPT, values, strict=True))}))
        for home, session in kept.items():
            before = Counter(session.tally)
            if home in stale:
                for turn in {r["turn_id"] for _, r in again[home]}:
                    self.kept.drop(self._turn(home, turn), turn)
                session = Session()
                rows = [r for counts, r in again[home] if counts]
            else:
                rows = fresh[home]
            for row in sorted(rows, key=place):
                session.add(row, self._new_turn(home, row["turn_id"]))
            self.kept.put(f"h{home[0]} {home[1]}", home[1], session.dumps())
            engines = self.kept.head["engines"]
            tally = Counter(engines.get(home[0], {}))
            tally.update(session.tally)
            tally.subtract(before)
            engines[home[0]] = {k: v for k, v in tally.items() if v}
        return {home[0] for home in kept}

    def _snapshots(self, engines: Iterable[str], kind: str) -> list[dict]:
        version, out = self._next("version"), []
        for engine in sorted(engines):
            harness, contract = engine.split(" ", 1)
            row = {"kind": kind, "harness": harness, "contract": contract, "version": version}
            if f"broken {engine}" in self.kept.head["counters"]:
                out.append(row | {"status": "aggregation_failed"})
            else:
                out.append(row | {"status": "ok"} | snapshot(Counter(self.kept.head["engines"][engine])))
        return out

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self.kept, came, latest = Kept(self.parts), [], 0
        for given in rows:
            came.append(json.loads(given["row"]))
            if self.idle_ms is not None:
                latest = max(latest, given["at"])
        # of one batch in the order of the source; what came in earlier batches is before
        came.sort(key=lambda r: (r.get("ordinal") is None, r.get("ordinal") or 0))
        stale: set = set()
        fresh: dict[tuple, list[dict]] = {}
        out = [self._accept(key[0], row, stale, fresh) for row in came]
        # superseded within the batch
        for home, new in fresh.items():
            fresh[home] = [r for r in new if not self._is_superseded(home[0], r["event_id"])]
        out += self._snapshots(self._settle(stale, fresh), "snapshot") if fresh or stale else []
        if self.idle_ms is not None:
            at, had = latest + self.idle_ms, self.kept.head["counters"].get("close at")
            if had is None or at > had:
                if had is not None:
                    self.handle.deleteTimer(had)
                self.handle.registerTimer(at)
                self.kept.head["counters"]["close at"] = at
        self.kept.write()
        yield from told(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.kept = Kept(self.parts)
        out = self._snapshots(self.kept.head["engines"], "closed")
        self.parts.clear()
        yield from told(key[0], out)


def told(task: str, out: list[dict]) -> Iterator[Row]:
    """Results and snapshots in rows of so many."""
    for i in range(0, len(out), PART):
        yield Row(task_id=task, out=json.dumps(out[i : i + PART]))


def track(records: DataFrame, idle: str | None = None, late: str = "0 seconds") -> DataFrame:
    """A stream of records (as ``with_defaults`` gives them) as results and snapshots.

    ``kind`` is ``result`` (one a record: accepted, duplicate or rejected, with its id and sequence),
    ``snapshot`` (each engine that changed, after each batch; ``version`` counts on within a task;
    status ``aggregation_failed`` once records replay one another in a circle) or, with ``idle``, ``closed``: a last
    snapshot of a task without records for so long, whose state is dropped. Of one batch records count in
    the order of ``ordinal``. Rows without a task are left out.
    """
    spark = records.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    if idle is not None:
        records = records.withWatermark("ts", late)
    own = [c for c in records.columns if c not in ("task_id", "ts")]
    rows = records.where(F.col("task_id").isNotNull()).select("task_id", F.to_json(F.struct(*own)).alias("row"), *([F.unix_millis("ts").alias("at"), "ts"] if idle is not None else []))
    idle_ms = None if idle is None else int(spark.range(1).select(F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {idle}"))).first()[0])
    out = rows.groupBy("task_id").transformWithState(TaskTracker(idle_ms), "task_id string, out string", "Update", "None" if idle is None else "EventTime")
    return out.select("task_id", F.inline(F.from_json("out", ArrayType(StructType.fromDDL(f"{RESULT}, {SNAPSHOT}")))))


def run_tracker(records: DataFrame, path: str, checkpoint: str, idle: str | None = None, late: str = "0 seconds") -> StreamingQuery:
    """What there is, tracked into Parquet files at ``path``; a run with the same checkpoint goes on where the last stopped."""
    return track(records, idle, late).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest_snapshots(tracked: DataFrame) -> DataFrame:
    """Of each engine of each task its last snapshot."""
    columns = [c.split()[0] for c in SNAPSHOT.split(", ")]
    last = tracked.where("kind in ('snapshot', 'closed')").groupBy("task_id", "harness", "contract").agg(F.max_by(F.struct("status", *columns), "version").alias("x"))
    return last.select("task_id", "harness", "contract", "x.*")


def record_results(tracked: DataFrame) -> DataFrame:
    """How many records of each task were accepted, duplicates or rejected."""
    return tracked.where("kind = 'result'").groupBy("task_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "duplicate", "rejected")])


def task_cost_at_rest(records: DataFrame) -> DataFrame:
    """The same from a table, for records that have an id, a sequence and a turn: replays resolved, counters as steps, totals of each engine."""
    engine = ["task_id", "harness", "contract"]
    valid = cost.first_wins(records.where("reason is null"), ["task_id", "event_id"], ["ordinal"])
    gone = valid.where("replay_of is not null").select(*engine, F.col("replay_of").alias("event_id")).distinct()
    steps = cost.cumulative_to_delta(valid.join(gone, [*engine, "event_id"], "left_anti"), [*TOKENS, *AMOUNTS], [*engine, "session_id"], ["sequence", "event_id"])
    return cost.cost_totals(steps, engine, list(TOKENS))
