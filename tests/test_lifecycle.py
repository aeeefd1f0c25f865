"""Batches of merges and splits against a sequential program."""

import datetime
import random

import pytest

from feedloom.operators import lifecycle

EVENTS = "event_id long, at timestamp, operation string, source_id long, target_id long, is_new boolean, source_system string, source_hash string"
WALK = "source_system string, source_hash string, master_id long, valid_from timestamp, valid_to timestamp, match_type string, note long"
TOKENS = "master_id long, ssn_hash string, is_current boolean, effective_from timestamp, effective_to timestamp"


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def sequential(walk, persons, tokens, events):
    status, walk, tokens, outcomes = dict(persons), [list(r) for r in walk], [list(t) for t in tokens], {}
    known, into = set(status), {}
    for e in sorted(set(events), key=lambda e: (e[1], e[0])):
        number, at, kind, source, target, is_new, system, source_hash = e
        if kind == "MERGE":
            if source not in known or target not in known:
                outcomes[number] = "NOT_FOUND"
            elif status[source] != "ACTIVE":
                outcomes[number] = "SOURCE_NOT_ACTIVE"
            elif status[target] != "ACTIVE" or source == target:
                outcomes[number] = "TARGET_NOT_ACTIVE"
            else:
                outcomes[number], status[source], into[source] = "EXECUTED", "MERGED", target
                for t in tokens:
                    if t[0] == source and t[2]:
                        t[2], t[4] = False, at
                for r in [r for r in walk if r[2] == source and r[4] is None]:
                    r[4] = at
                    walk.append([r[0], r[1], target, at, None, "MERGE_OVERRIDE", r[6]])
            continue
        rows = [r for r in walk if r[:3] == [system, source_hash, source] and r[4] is None]
        ssn = {t[0]: t[1] for t in tokens if t[2]}
        if status.get(source) != "ACTIVE":
            outcomes[number] = "SOURCE_NOT_ACTIVE"
        elif len(rows) != 1:
            outcomes[number] = "IDENTIFIER_AMBIGUOUS" if rows else "IDENTIFIER_NOT_FOUND"
        elif not is_new and status.get(target) != "ACTIVE":
            outcomes[number] = "TARGET_NOT_ACTIVE"
        elif ssn.get(source) and ssn.get(target) and ssn[source] != ssn[target]:
            outcomes[number] = "SSN_CONFLICT"
        else:
            outcomes[number] = "EXECUTED"
            status.setdefault(target, "ACTIVE")
            if target not in ssn and source in ssn:
                tokens.append([target, ssn[source], True, at, None])
            rows[0][4] = at
            walk.append([system, source_hash, target, at, None, "SPLIT_OVERRIDE", rows[0][6]])
    walk = [r for r in walk if r[3] != r[4] or r[5] not in ("MERGE_OVERRIDE", "SPLIT_OVERRIDE")]
    return walk, [(p, s, into.get(p)) for p, s in status.items()], tokens, list(outcomes.items())


def as_set(rows):
    return sorted(repr(tuple(r)) for r in rows)


def check(spark, walk, persons, tokens, events):
    frames = [spark.createDataFrame(r, s) for r, s in ((walk, WALK), (persons, "master_id long, status string"), (tokens, TOKENS), (events, EVENTS))]
    got, want = lifecycle.apply_events(*frames), sequential(walk, persons, tokens, events)
    for found, rows in zip(got, want, strict=True):
        assert as_set(found.collect()) == as_set(rows)
    return dict(want[3])


def merge(n, at, source, target):
    return (n, day(at), "MERGE", source, target, None, None, None)


def split(n, at, source, target, h, is_new=False):
    return (n, day(at), "SPLIT", source, target, is_new, "s", h)


PERSONS = [(k, "ACTIVE") for k in range(1, 13)] + [(13, "MERGED")]
ROWS = [("s", f"h{k}", k, day(-9), None, "EXACT", k) for k in range(1, 14)] + [("s", "h1", 1, day(-20), day(-9), "EXACT", 0)]
OWN = [(k, f"x{k % 4}" if k % 3 else None, True, day(-9), None) for k in range(1, 10)]


def test_a_chain_of_five_and_a_cycle(spark):
    chain = [merge(k, k, k, k + 1) for k in range(1, 6)]
    cycle = [merge(10, 1, 8, 9), merge(11, 2, 9, 8), merge(12, 2, 8, 7), merge(12, 2, 8, 7), merge(13, 3, 10, 10), merge(14, 3, 13, 1), merge(15, 3, 77, 1)]
    said = check(spark, ROWS, PERSONS, OWN, chain + cycle)
    assert [said[k] for k in (1, 5, 10, 11, 12, 13, 14, 15)] == ["EXECUTED"] * 3 + ["TARGET_NOT_ACTIVE", "SOURCE_NOT_ACTIVE", "TARGET_NOT_ACTIVE", "SOURCE_NOT_ACTIVE", "NOT_FOUND"]


def test_events_of_one_time_leave_one_row(spark):
    check(spark, ROWS, PERSONS, OWN, [merge(k, 1, k, k + 1) for k in range(1, 6)] + [split(9, 1, 6, 50, "h2", True)])


def test_merge_then_split_and_split_again(spark):
    events = [merge(1, 1, 1, 2), split(2, 2, 2, 60, "h1", True), split(3, 3, 60, 7, "h1"), split(4, 3, 2, 7, "h1"), split(5, 4, 1, 3, "h1"), merge(6, 5, 7, 8), split(7, 6, 8, 11, "h1"), split(8, 7, 11, 12, "h1"), split(9, 8, 12, 4, "none")]
    said = check(spark, ROWS, PERSONS, OWN, events)
    assert said[2] == "EXECUTED" and said[4] == "IDENTIFIER_NOT_FOUND" and said[5] == "SOURCE_NOT_ACTIVE"


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches(spark, seed):
    rng = random.Random(seed)
    rows = ROWS + [("s", f"h{rng.randrange(1, 6)}", rng.randrange(1, 13), day(-9), None, "EXACT", 100 + k) for k in range(6)]
    events = []
    for n in range(40):
        a, b, at = rng.randrange(1, 15), rng.randrange(1, 15), rng.randrange(0, 9)
        events.append(merge(n, at, a, b) if rng.random() < 0.35 else split(n, at, a, 200 + n if rng.random() < 0.3 else b, f"h{a if rng.random() < 0.7 else rng.randrange(1, 8)}", False))
        if events[-1][2] == "SPLIT" and events[-1][4] >= 200:
            events[-1] = (*events[-1][:5], True, *events[-1][6:])
    assert len(set(check(spark, rows, PERSONS, OWN, events).values())) >= 4


def test_nothing_to_do(spark):
    check(spark, ROWS, PERSONS, OWN, [])
    check(spark, [], PERSONS, [], [merge(1, 1, 1, 2), split(2, 2, 2, 3, "h1")])
