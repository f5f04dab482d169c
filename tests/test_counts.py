"""Measurements are counted in tasks of a bounded number of them."""

from assayspark.operators import extract


def test_most_rows_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(extract, "COUNTED_AT_ONCE", 10)
    rows = [(m, s, a, x) for m in range(5) for s in range(3) for a in range(2) for x in range(m + 1)]
    found = spark.createDataFrame([(*r,) for r in rows * 2], "metabolite long, study_id long, analysis_id long, sample_id long")
    got = extract.metabolite_counts(found, most=found.count())
    assert {tuple(r) for r in got.collect()} == {(m, 3, 6, 6 * (m + 1)) for m in range(5)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") <= 4  # the initial and the final plan have two each
    assert f", {len(rows) * 2 // 10 + 1})" in plan
