import random
from datetime import datetime, timedelta

from codeloom.operators import folds
from codeloom.operators.memory import ADJUST_DELTAS, FEEDBACK_DELTAS

EVENTS = "event_id long, ts timestamp, belief_id string, outcome string"


def events(n, seed, hot):
    rng = random.Random(seed)
    start = datetime(2024, 1, 31, 23, 59, 57)
    rows = []
    for i in range(n):
        belief = "b0" if rng.random() < hot else f"b{rng.randrange(1, 5)}"
        rows.append((i, start + timedelta(seconds=rng.choice([0, 1, 2, 3600, 86400 * 20, 86400 * 400])), belief, rng.choice(list(FEEDBACK_DELTAS) + ["other"])))
    return rows


def brute(start, rows):
    state, seen = dict(start), {}
    for event_id, _, belief, outcome in sorted(rows, key=lambda r: (r[1], r[0])):
        if belief in state:
            before = state[belief]
            state[belief] = max(0, min(100, before + FEEDBACK_DELTAS.get(outcome, 0)))
            seen[event_id] = (before, state[belief])
    return state, seen


def test_fold_equals_event_loop_with_hot_belief(spark):
    start = {f"b{i}": 20 * i for i in range(5)}
    rows = events(600, 1, 0.5)
    beliefs = spark.createDataFrame([(k, v, 0) for k, v in start.items()], "id string, conv_pct int, usage_count int")
    log = spark.createDataFrame(rows, EVENTS)
    state, seen = brute(start, rows)
    assert {r.id: r.conv_pct for r in folds.feedback_fold(beliefs, log).collect()} == state
    assert {r.event_id: (r.before_pct, r.after_pct) for r in folds.feedback_states(beliefs, log).collect()} == seen
    assert all(0 <= v <= 100 for v in state.values())


def test_no_block_is_longer_than_its_bound(spark, monkeypatch):
    """One hot belief, few instants, ids in no order."""
    monkeypatch.setattr(folds, "BLOCK", 16)
    start = {f"b{i}": 50 for i in range(5)}
    rows = [(r[0] * 7919 % 100_003, *r[1:]) for r in events(300, 2, 0.6)]
    beliefs = spark.createDataFrame([(k, v, 0) for k, v in start.items()], "id string, conv_pct int, usage_count int")
    log = spark.createDataFrame(rows, EVENTS)
    for level in folds._runs(folds._events(log, FEEDBACK_DELTAS, "outcome"), "belief_id")[:-2]:
        assert max(len(r.children) for r in level.collect()) <= 16
    state, seen = brute(start, rows)
    assert {r.id: r.conv_pct for r in folds.feedback_fold(beliefs, log).collect()} == state
    assert {r.event_id: (r.before_pct, r.after_pct) for r in folds.feedback_states(beliefs, log).collect()} == seen


def test_commands_after_delete_are_errors(spark):
    beliefs = spark.createDataFrame([("b1", 95, "t"), ("b2", 50, "t")], "id string, conv_pct int, content string")
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    commands = spark.createDataFrame([
        (1, at(1), "b1", "reinforce", None), (2, at(2), "b1", "weaken", None), (3, at(3), "b1", "modify", "new"), (4, at(4), "b1", "modify", None),
        (5, at(1), "b2", "delete", None), (6, at(2), "b2", "reinforce", None), (7, at(1), "b9", "weaken", None), (8, at(9), "b1", "nonsense", None),
    ], "event_id long, ts timestamp, belief_id string, action string, new_content string")
    status = {r.event_id: r.status for r in folds.adjustment_status(beliefs, commands).collect()}
    assert status == {1: "updated", 2: "updated", 3: "updated", 4: "error", 5: "deleted", 6: "error", 7: "error", 8: "error"}
    (left,) = folds.adjust_beliefs(beliefs, commands).collect()
    assert (left.id, left.conv_pct, left.content) == ("b1", 100 + ADJUST_DELTAS["weaken"], "new")
