import random

import pytest

from urlspark.operators import explain


def brute(rows, bars):
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (-abs(r[3]), r[1]))
        single = own if len(own) <= bars else own[:bars - 1]
        out |= {(key, i + 1): (r[1], r[2], r[3], 1) for i, r in enumerate(single)}
        if len(own) > bars:
            out[key, bars] = ("other", None, sum(r[3] for r in own[bars - 1:]), len(own) - bars + 1)
    return out


@pytest.mark.parametrize("bars", [1, 2, 4])
def test_waterfall_from_one_sort(spark, bars):
    rng = random.Random(3)
    rows = [(key, f"f{i}", float(i), rng.choice([-2.0, -0.5, 0.0, 0.5, 1.5]), 0.25) for key in range(40) for i in range(key % 9 + 1)]
    contribs = spark.createDataFrame(rows, "row_id long, feature string, value double, contribution double, base double")
    labelled = spark.createDataFrame([(k, k % 2, 1) for k in range(50)], "row_id long, prediction int, label int")
    found = explain.waterfall(contribs, labelled, bars=bars)
    got = {(r.row_id, r.bar): (r.feature, r.value, r.contribution, r.features) for r in found.collect()}
    assert got == brute(rows, bars)  # sums of halves are exact
    assert {(r.base, r.label) for r in found.collect()} == {(0.25, 1)}
    # no groups are held in memory beside the sorted rows
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
