"""What a task's state costs: calls to the state store a batch, and that parts say the same as one."""

from __future__ import annotations

import json
import random

from quillon.streaming import tracker as T


class Store(dict):
    """A map state that counts what is asked of it."""

    calls = 0

    def __getattr__(self, name):
        def call(*args):
            Store.calls += 1
            return {"getValue": self.get, "containsKey": self.__contains__, "updateValue": self.__setitem__, "removeKey": self.pop, "iterator": lambda: iter(list(self.items()))}[name](*args)

        return call


class Handle:
    def getMapState(self, *_):
        return Store()


def _told(batches):
    """All results and snapshots of one task, and the calls of each batch."""
    task, out, calls = T.TaskTracker(), [], []
    task.init(Handle())
    for rows in batches:
        before = Store.calls
        for told in task.handleInputRows(("t",), iter([{"row": json.dumps(r)} for r in rows]), None):
            out += json.loads(told["out"])
        calls.append(Store.calls - before)
    return out, calls


def _record(i, **more):
    return {"event_id": f"e{i}", "ordinal": i, "harness": "pi", "contract": "pi/1", "session_id": f"s{i % 3}", "sequence": i, "model": "m", "usage_kind": "cumulative", "input_tokens": i, "coverage": "complete", "cost_basis": "unknown"} | more


def test_a_batch_costs_few_calls():
    batches = [[_record(i, turn_id=f"t{i % 7}") for i in range(b * 50, b * 50 + 50)] for b in range(3)]
    out, calls = _told(batches)
    assert max(calls) <= 4
    assert [x["observations"] for x in out if x["kind"] == "snapshot"] == [50, 100, 150]


def test_parts_say_what_one_says(monkeypatch):
    rng = random.Random(1)
    rows = [_record(i, sequence=rng.randrange(400), **({"replay_of": f"e{rng.randrange(i)}"} if i and rng.random() < 0.1 else {})) for i in range(300)] + [_record(rng.randrange(300), ordinal=300 + i) for i in range(30)]
    rng.shuffle(rows)
    batches = [rows[i : i + 11] for i in range(0, len(rows), 11)]
    one, _ = _told(batches)
    monkeypatch.setattr(T, "PART", 8)
    many, calls = _told(batches)
    assert many == one and len(one) > len(rows)
    # a single record of a task with many parts touches few of them
    _, calls = _told([*batches, [_record(1000, sequence=1000)]])
    assert calls[-1] <= 12
