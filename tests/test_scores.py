"""Halves of a hundredth in scores."""

from lodestream.operators import scoring


def test_a_score_that_is_half_a_hundredth_goes_up(spark):
    # 0.20 * 0 + 0.15 * 0 + 0.10 * 0 + 0.25 * 0 + 0.15 * 0 + 0.15 * 3.1 = 0.465, as binary fractions 0.46499...
    rows = [("low", 1, 1, 1.0, 1, 0.0, 3.1), ("high", 9, 3, 4.0, 5, 0.0, 100.0), ("mid", 5, 2, 2.5, 3, 0.0, 76.5)]
    df = spark.createDataFrame(rows, "u string, actions long, features long, minutes double, ai_requests long, ai_cost double, success_rate double")
    out = {r["u"]: (r["score"], r["place"]) for r in scoring.champion_scores(df, "u").select("u", "score", "place").collect()}
    assert out == {"low": (0.47, 3), "high": (100.0, 1), "mid": (53.98, 2)}
