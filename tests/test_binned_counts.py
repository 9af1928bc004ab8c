import math
from bisect import bisect_right
from collections import Counter

import pytest

from urlspark.operators.select import binned_mutual_information


def test_bins_of_many_columns_are_counted_without_a_row_a_column(spark):
    names = [f"c{i}" for i in range(90)]
    rows = [(n % 2 if n % 5 else None, *[float((n * (i + 3)) % 17) if (n + i) % 7 else None for i in range(90)]) for n in range(60)]
    df = spark.createDataFrame(rows, "label int, " + ", ".join(f"{c} double" for c in names))
    edges = {c: [float(e) for e in range(i % 16)] for i, c in enumerate(names)}
    found = binned_mutual_information(df, edges)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.feature: r.mi for r in found.collect()}
    for i, c in enumerate(names):
        # a null lies in the last bin
        cells = Counter((len(edges[c]) if r[i + 1] is None else bisect_right(edges[c], r[i + 1]), r[0]) for r in rows)
        bins, labels = Counter(), Counter()
        for (b, y), n in cells.items():
            bins[b] += n
            labels[y] += n
        mi = sum(n / 60 * math.log(n * 60 / (bins[b] * labels[y])) for (b, y), n in cells.items())
        assert got[c] == pytest.approx(max(mi, 0.0), abs=1e-9)
