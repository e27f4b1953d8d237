import random

import pytest

from factloom.llm import mixing, packing, tokens
from factloom.session import materialize

SPECS = "spec_id string, capacity_tokens int, separator_tokens int"


def sized(spark, n=3000, seed=5):
    r = random.Random(seed)
    rows = [(i, r.choice([0, 1, 5, 100, 100, 300, 511, 512, 513, 2000]) + r.randint(0, 30)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, tokens bigint")


def test_packing_holds_its_rules(spark):
    rows, df = sized(spark)
    specs = spark.createDataFrame([("a", 512, 0), ("b", 700, 1), ("bad", 0, 1), ("none", None, 1)], SPECS)
    out = packing.pack(df, specs, materialize).collect()
    for spec, capacity, sep in (("a", 512, 0), ("b", 700, 1)):
        mine = [r for r in out if r.spec_id == spec]
        by_doc, boxes = {}, {}
        for r in mine:
            by_doc.setdefault(r.doc_id, []).append(r)
            boxes.setdefault(r.container_id, []).append(r)
        assert set(by_doc) == {i for i, _ in rows}
        for i, n in rows:
            pieces = sorted(by_doc[i], key=lambda r: r.piece)
            assert sum(p.tokens for p in pieces) == n
            assert len(pieces) == max(1, -(-n // capacity))
            assert [p.first_token for p in pieces] == [k * capacity for k in range(len(pieces))]
        used = [sum(r.tokens for r in b) + sep * (len(b) - 1) for b in boxes.values()]
        assert max(used) <= capacity
        assert sum(used) / (len(used) * capacity) > 0.9
        assert all(sorted(r.position for r in b) == list(range(len(b))) for b in boxes.values())
    assert {r.spec_id for r in out} == {"a", "b"}


def test_packing_of_slices_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ITEMS", 200)
    rows, df = sized(spark, 1500)
    specs = spark.createDataFrame([("a", 1024, 1)], SPECS)
    out = packing.pack(df, specs, materialize)
    u = packing.utilisation(out, specs).first()
    assert u.fullest <= 1024 and u.filled > 0.8 and out.select("doc_id").distinct().count() == 1500
    assert packing.pack(df.limit(0), specs, materialize).count() == 0


def test_best_fit_closes_the_fullest():
    fit = packing.BestFit(100, 0, bins=2)
    for i, s in enumerate((60, 50, 90, 40)):
        fit.add(i, s)
    assert fit.closed[0] == [0]  # the fullest of the two open ones left when a third was needed
    assert [3 in b for b in fit.closed + fit.still_open()].count(True) == 1


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "光" * 30_000)], "doc_id bigint, text string")
    got = {r.doc_id: r.tokens for r in tokens.sizes(df, "doc_id").collect()}
    enc = tokens.encoding(tokens.VOCABULARY)
    assert got == {1: len(enc.encode_ordinary("hello world")), 2: 0, 4: len(enc.encode_ordinary("光" * 30_000))}


def target(mix, shares, repeats=2):
    return [{"mix_id": mix, "source": s, "target_share": x, "max_repeats": repeats} for s, x in shares.items()]


def test_exponent_meets_the_entropy():
    natural = {"a": 0.7, "b": 0.2, "c": 0.1}
    for want in (-1.3, -0.4, 0.0, 0.3, 1.0, 2.5):
        aim = mixing._shares(natural, want)
        assert mixing.exponent_for(natural, aim) == pytest.approx(want, abs=1e-3)


def test_plan_meets_targets_within_limits():
    have = {"a": (1000, 10), "b": (1000, 10), "c": (50, 2)}
    rows = {r[1]: r for r in mixing.plan(target("m", {"a": 0.5, "b": 0.3, "c": 0.2, "gone": 0.1}), have)}
    assert rows["gone"][7] == 0 and rows["gone"][-1]
    assert rows["c"][7] <= 100 + 1e-6  # twice what it has
    assert rows["a"][7] / rows["b"][7] == pytest.approx(5 / 3, rel=0.03)  # but for what they stand in for
    free = {r[1]: r for r in mixing.plan(target("m", {"a": 0.5, "b": 0.5}, 3), have, budget=2000)}
    assert free["a"][7] == pytest.approx(1000) and not free["a"][-1]
    assert mixing.plan(target("m", {"a": 1.0}), {}) and mixing.plan([], have) == []


def test_exponent_decides_who_stands_in(monkeypatch):
    have = {"small": (100, 2), "a": (40_000, 400), "b": (4_000, 40), "c": (900, 9)}
    wanted = target("m", {"small": 0.3, "a": 0.4, "b": 0.2, "c": 0.1}, 3)
    rows = {r[1]: r for r in mixing.plan(wanted, have, budget=10_000)}
    assert rows["small"][7] == pytest.approx(300) and sum(r[7] for r in rows.values()) == pytest.approx(10_000)  # the size is kept
    assert rows["c"][7] <= 2_700 and rows["a"][7] > 4_000 and rows["b"][7] > 2_000
    free = {s: have[s][0] / 44_900 for s in "abc"}
    aim = {"a": 4 / 7, "b": 2 / 7, "c": 1 / 7}
    shares = mixing._shares(free, mixing.exponent_for(free, aim))
    assert mixing._entropy(shares.values()) == pytest.approx(mixing._entropy(aim.values()), abs=1e-4)
    assert rows["a"][5] == pytest.approx(mixing.exponent_for(free, aim))
    assert rows["a"][7] == pytest.approx(4_000 + 2_700 * shares["a"])
    monkeypatch.setattr(mixing, "exponent_for", lambda natural, aim: 0.0)
    even = {r[1]: r for r in mixing.plan(wanted, have, budget=10_000)}
    assert even["a"][7] == pytest.approx(4_900) and even["a"][7] != pytest.approx(rows["a"][7], rel=0.01)
    assert sum(r[7] for r in mixing.plan(wanted, {"small": (100, 2)}, budget=10_000)) == 300  # all at their limit


def test_draw_reaches_shares_and_never_repeats_too_often(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["big", "big", "big", " BIG", "mid", "small", None]), r.randint(0, 400)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame(target("m", {"big": 0.4, "Mid": 0.35, "small": 0.25}, 2) + target("x", {"small": 0.9, "big": 0.1}, 1), "mix_id string, source string, target_share double, max_repeats int")
    drawn, plans = mixing.draw(df, targets, materialize)
    got = {(x.mix_id, x.source): x for x in mixing.report(drawn, plans).collect()}
    for s, share in (("big", 0.4), ("mid", 0.35), ("small", 0.25)):
        assert got["m", s].reached_share == pytest.approx(share, abs=0.02)
        assert got["m", s].most_times <= 2
    assert got["x", "small"].most_times == 1
    assert drawn.groupBy("mix_id", "doc_id").count().where("count > 1").count() == 0
    assert mixing.draw(df.limit(0), targets, materialize)[0].count() == 0
