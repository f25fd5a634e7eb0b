"""The verdict sees blanked notes that lift the score, and asks for the usual replicates."""

import pytest

from remitlens.catalog import evaluation, models


@pytest.mark.parametrize("gain", [0.0, 0.05])
def test_blank_lift_is_flagged(spark, sf, monkeypatch, gain):
    asked = []

    def lift(spark, sf):
        asked.append(2000)
        return spark.createDataFrame([(0.1, 0.8, 0.7, 0.05)], "lift_point double, auroc_better double, auroc_base double, lift_low double")

    ladder = [("structured", 0.0), ("structured+blank", gain)]
    monkeypatch.setattr(evaluation, "bootstrap_lift_full", lift)
    monkeypatch.setattr(models, "note_lifts", lambda spark, sf, rungs: spark.createDataFrame(ladder, "model string, lift double"))
    flags = {r.model: r.flags for r in evaluation.health_verdict(spark, sf).collect()}
    assert asked == [2000] and set(flags) == {"rule", "blurred"}
    assert all(("empty-note lift" in f) == (gain > 0) for f in flags.values())
