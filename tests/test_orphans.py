import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import orphans

T0 = dt.datetime(2024, 1, 1)
PARENTS = "chunk_id string, evidence_id string, loaded_at timestamp, deleted_at timestamp, note string"
FACTS = "fact_id string, evidence_id string, loaded_at timestamp, k1 string"


def hours(n):
    return None if n is None else T0 + dt.timedelta(hours=n)


def make(seed, keys=6, n=60):
    r = random.Random(seed)
    parents = []
    for i in range(n // 3):
        a = r.randint(0, 100)
        parents.append((f"K{r.randrange(keys)}", r.choice([None, "-", f"E{i % keys}"]), hours(a), hours(r.choice([None, a + r.randint(-5, 40)])), "x"))
    facts = [(f"F{i}", r.choice(["k%d " % r.randrange(keys + 2), "Ｋ%d" % r.randrange(keys), "e%d" % r.randrange(keys), None, "", " - "]), hours(r.randint(0, 100)), "clash") for i in range(n)]
    return parents, facts + facts[:5]


def brute(parents, facts):
    from factloom.functions.form import to_form

    norm = lambda s: to_form(s).strip().lower()
    alive = lambda k, t: any((norm(p[0]) == k or (p[1] and norm(p[1]) == k)) and p[2] <= t and (p[3] is None or p[3] > t) for p in parents)
    born = {}
    for f, e, t, _ in facts:
        if e and any(c.isalnum() for c in e):
            born[f, e] = min(born.get((f, e), t), t)
    return {(f, e): (not alive(norm(e), t), not alive(norm(e), hours(10_000))) for (f, e), t in born.items()}


def frames(spark, parents, facts):
    p, f = spark.createDataFrame(parents, PARENTS), spark.createDataFrame(facts, FACTS)
    return orphans.references(f, "facts", "fact_id", "evidence_id", "evidence"), orphans.parent_events(p, {"chunk_id": ("evidence",), "evidence_id": ("evidence",)})


def state_of(state):
    rows = state.refs.collect()
    assert len(rows) == len({(r.src_key, r.ref_key) for r in rows})
    return {(r.src_key, r.ref_key): (r.dead_at_birth, r.open) for r in rows}


@pytest.mark.parametrize(("seed", "hot"), [(1, 10**6), (2, 10**6), (1, 0), (2, 12), (3, 12)])
def test_against_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(orphans, "HOT", hot)  # keys beyond it are split by hour
    parents, facts = make(seed)
    refs, events = frames(spark, parents, facts)
    state, moved = orphans.advance(orphans.OrphanState.empty(spark), refs, events)
    assert state_of(state) == brute(parents, facts)
    assert moved.count() == 0


def test_batches_agree_with_one_load(spark):
    parents, facts = make(7)
    refs, events = frames(spark, parents, facts)
    state, seen = orphans.OrphanState.empty(spark), set()
    for a, b in ((-10, 30), (30, 60), (60, 20_000)):
        cut = f"timestamp'{hours(a)}' <= {{0}} and {{0}} < timestamp'{hours(b)}'"
        state, moved = orphans.advance(state, refs.where(cut.format("born")), events.where(cut.format("ts")))
        seen |= {r.transition for r in moved.collect()}
        state = state.save("test")
    assert state_of(state) == brute(parents, facts)
    assert seen <= {"resolved", "reopened"} and seen
    counts = orphans.snapshot(state).collect()
    assert sum(r.n_refs for r in counts) == len(brute(parents, facts))


def test_redelivered_and_late_rows(spark):
    """A reference that comes again in a later batch stays one; parents and references that come late re-judge their key."""
    refs, events = frames(spark, [("c1", None, hours(4), None, "")], [("f1", "c1", hours(1), ""), ("f1", "c1", hours(5), "")])
    state, _ = orphans.advance(orphans.OrphanState.empty(spark), refs.where(f"born < timestamp'{hours(3)}'"), events.limit(0))
    state, moved = orphans.advance(state.save("a"), refs.where(f"born > timestamp'{hours(3)}'"), events)
    assert state_of(state) == {("f1", "c1"): (True, False)} and orphans.snapshot(state).first().n_refs == 1
    assert [r.transition for r in moved.collect()] == ["resolved"]
    for seed in (4, 5):
        parents, facts = make(seed)
        refs, events = frames(spark, parents, facts)
        refs, events = refs.withColumn("b", F.pmod(F.hash("src_key", "born"), F.lit(3))), events.withColumn("b", F.pmod(F.hash("k1", "ts", "delta"), F.lit(3)))
        state = orphans.OrphanState.empty(spark)
        for i in range(3):  # in no order of time at all
            part = refs.where((F.col("b") == i) | (F.col("b") == 0)).drop("b")
            state, _ = orphans.advance(state, part, events.where(F.col("b") == i).drop("b"))
            state = state.save("late")
        assert state_of(state) == brute(parents, facts)


def test_empty_and_hot_key(spark):
    refs, events = frames(spark, [], [])
    state, _ = orphans.advance(orphans.OrphanState.empty(spark), refs, events)
    assert state.refs.count() == 0
    parents = [("K", None, hours(i), hours(i + 1), "") for i in range(0, 400, 2)]
    facts = [(f"F{i}", "k", hours(i), "") for i in range(400)]
    refs, events = frames(spark, parents, facts)
    state, _ = orphans.advance(orphans.OrphanState.empty(spark), refs, events)
    assert {r.src_key for r in state.refs.where("dead_at_birth").collect()} == {f"F{i}" for i in range(1, 400, 2)}


def test_arrays_and_nulls(spark):
    c = spark.createDataFrame([("C1", ["K0", None, "", "K9", "K9"], hours(5)), ("C2", None, hours(5)), ("C3", [], hours(1)), ("C4", ["K0"], None)], "claim_id string, evidence_ids array<string>, loaded_at timestamp")
    refs = orphans.references(c, "claims", "claim_id", "evidence_ids", "evidence")
    assert {(r.src_key, r.ref_key) for r in refs.collect()} == {("C1", "K0"), ("C1", "K9")}
