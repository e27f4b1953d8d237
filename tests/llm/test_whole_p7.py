"""The report says how much of what is allowed a mix leaves out."""

from factloom.llm import mixing
from factloom.session import materialize


def test_report_shows_what_a_small_source_costs(spark):
    docs = spark.createDataFrame([(0, "tiny", 500)] + [(i, "big", 100) for i in range(1, 3001)], "doc_id bigint, source string, tokens bigint")
    rows = [("m", "tiny", 0.03, 1), ("m", "big", 0.97, 2), ("free", "big", 1.0, 2), ("free", "tiny", 0.0, 9), ("free", "gone", 0.0, 1)]
    targets = spark.createDataFrame(rows, "mix_id string, source string, target_share double, max_repeats int")
    out = {(r.mix_id, r.source): r for r in mixing.report(*mixing.draw(docs, targets, materialize)).collect()}
    small, big, free = out["m", "tiny"], out["m", "big"], out["free", "big"]
    assert (small.allowed_tokens, big.allowed_tokens, small.mix_allowed_tokens) == (500, 600_000, 600_500)
    assert small.mix_tokens == small.reached_tokens + big.reached_tokens < 0.1 * small.mix_allowed_tokens
    assert free.mix_tokens == free.mix_allowed_tokens == 600_000
