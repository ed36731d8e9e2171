"""Draws in blocks against Python's own generator."""

import random

import pytest

from evidora.functions import twister
from evidora.operators import draws
from evidora.sources import views as vw


@pytest.mark.parametrize("seed", [0, 42, 2**70 + 5, -3])
def test_blocks_continue_one_sequence(seed):
    r = random.Random(seed)
    want = [r.getrandbits(32) for _ in range(24_000)]
    strides = twister.doublings(701, 6)
    state = twister.seeded(seed)
    for block in (0, 1, 2, 5, 17, 33):
        assert twister.outputs(twister.block_state(state, block, strides), 701).tolist() == want[block * 701 : block * 701 + 701]


@pytest.mark.parametrize("n", [1, 2, 6, 64, 1000, 65_537])
def test_rejected_outputs_give_no_draw(n):
    r = random.Random(9)
    want = [r.randrange(n) for _ in range(500)]
    assert twister.below(n, twister.outputs(twister.seeded(9), 3000))[:500].tolist() == want


def test_a_far_jump_is_the_sum_of_near_ones():
    state = twister.seeded(5)
    near, twice = twister.doublings(10_007, 2)
    a, b = twister.jump(twister.jump(state, near), near), twister.jump(state, twice)
    assert (twister.outputs(a, 2000) == twister.outputs(b, 2000)).all()
    far = twister.doublings(1 << 40, 1)[0]
    half = twister.doublings(1 << 39, 1)[0]
    assert (twister.outputs(twister.jump(state, far), 50) == twister.outputs(twister.jump(twister.jump(state, half), half), 50)).all()


def sequential(v, resamples, seed=42):
    if len(v) < 2:
        return 0.0, 0.0
    r, n = random.Random(seed), len(v)
    m = sorted(sum(v[r.randrange(n)] for _ in range(n)) / n for _ in range(resamples))
    return m[max(0, int((1 - 0.95) / 2 * resamples))], m[min(resamples - 1, int((1 - (1 - 0.95) / 2) * resamples))]


def test_every_domain_as_a_sequential_program(spark):
    """All records, in blocks much smaller than a resample and than a domain's draws."""
    rec = vw.records(spark, "/root/testdata/sf0.001")
    order = ["example_id", "line", "part", "supp"]
    got = {r.domain: (r.n, r.lo, r.hi) for r in draws.sequential_bootstrap(rec, ["domain"], order, "answer_correct", resamples=200, block=50_021).collect()}
    rows = rec.orderBy("domain", *order, "answer_correct").collect()  # repeated keys by value, as the operator takes them
    by = {}
    for r in rows:
        by.setdefault(r.domain, []).append(r.answer_correct or 0.0)
    assert got == {d: (len(v), *sequential(v, 200)) for d, v in by.items()} and len(got) > 1


def test_small_and_odd_groups(spark):
    rows = [("a", i, float(i % 2)) for i in range(6)] + [("one", 0, 1.0), (None, 1, None), (None, 2, 1.0), (None, 3, 0.25)]
    df = spark.createDataFrame(rows, "g string, o int, v double")
    got = {r.g: (r.lo, r.hi) for r in draws.sequential_bootstrap(df, ["g"], ["o"], "v", block=997).collect()}
    assert got["a"] == sequential([0.0, 1.0] * 3, 1000) and got["one"] == (0.0, 0.0)
    assert got[None] == pytest.approx(sequential([0.0, 1.0, 0.25], 1000), abs=1e-12)
    assert draws.sequential_bootstrap(df.where("false"), ["g"], ["o"], "v").collect() == []


def test_too_many_values_are_refused(spark, monkeypatch):
    monkeypatch.setattr(draws, "MOST_VALUES", 5)
    with pytest.raises(ValueError):
        draws.sequential_bootstrap(spark.range(6).selectExpr("id", "1.0 AS v"), [], ["id"], "v")


@pytest.mark.parametrize("codes", [256, 0])
def test_values_beyond_one_chunk(spark, monkeypatch, codes):
    """Chunks of a few values, as bytes and as doubles, and runs of few blocks give the draws of one sequence."""
    monkeypatch.setattr(draws, "CODES", codes)
    monkeypatch.setattr(draws, "CHUNK_BYTES", 56)
    monkeypatch.setattr(draws, "LEAST_OUTPUTS", 2000)
    rows = [(g, i, float((i * i + len(g)) % 5)) for g, n in (("a", 150), ("bb", 61), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, o int, v double").repartition(3)
    got = {r.g: (r.n, r.lo, r.hi) for r in draws.sequential_bootstrap(df, ["g"], ["o"], "v", resamples=100, block=997).collect()}
    assert got == {g: (len(v), *sequential(v, 100)) for g in ("a", "bb", "c") if (v := [x for k, _, x in rows if k == g])}


def test_more_values_than_the_driver_took_before():
    assert draws.MOST_VALUES >= 36_000_000
