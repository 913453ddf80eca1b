import math

import pytest

from provenir.operators import density


def rows(spark, values, stat="s"):
    return spark.createDataFrame([("n", stat, float(v)) for v in values], "name string, stat string, value double")


#: Recorded densities at a bandwidth of 0.5: samples, value, density.
RECORDED = [
    ([0] * 5, 0, 0.797884560803),
    ([0] * 5, 1, 0.107981933026),
    ([0] * 5, 3, 1.21517656996e-08),
    ([0, 1] * 4, 0, 0.452933246915),
    ([0] * 77 + [1] * 13 + [2] * 64, 0, 0.408168873897),
    ([0] * 77 + [1] * 13 + [2] * 64, 1, 0.16622046654),
    ([0] * 77 + [1] * 13 + [2] * 64, 2, 0.340837577114),
]


def test_recorded_densities(spark):
    own, asked = None, None
    for k, (values, x, _) in enumerate(RECORDED):
        a, b = rows(spark, values, f"s{k}"), rows(spark, [x], f"s{k}")
        own, asked = (a, b) if own is None else (own.union(a), asked.union(b))
    got = {r.stat: r.density for r in density.kde_score(asked, own).collect()}
    for k, (_, _, want) in enumerate(RECORDED):
        assert got[f"s{k}"] == pytest.approx(want, rel=1e-9)


def test_no_samples_give_null(spark):
    asked = spark.createDataFrame([("other", "s", 1.0)], "name string, stat string, value double")
    assert density.kde_score(asked, rows(spark, [1])).first().density is None


def test_parzen_ranks(spark):
    values = spark.createDataFrame([("a", "m", v) for v in (1.0, 1.0, 2.0, 5.0)] + [("b", "m", 3.0)] * 3, "name string, metric string, value double")
    table = density.parzen_pred(density.parzen(values)).collect()
    got = {(r["name"], r["value"]): r.pred for r in table}
    own = [1.0, 1.0, 2.0, 5.0]
    mean = sum(own) / 4
    s = math.sqrt(sum((v - mean) ** 2 for v in own) / 4)
    ll = {x: math.log(sum(math.exp(-((x - v) ** 2) / (2 * s * s)) / (math.sqrt(2 * math.pi) * s) for v in own) / 4) for x in own}
    for x in own:
        assert got["a", x] == pytest.approx(sum(ll[v] < ll[x] for v in own) / 4)
    assert got["b", 3.0] == 0.0
    cume = {(r["name"], r["value"]): r.pred for r in density.parzen_pred(density.parzen(values), "cume").collect()}
    assert max(v for k, v in cume.items() if k[0] == "a") == 1.0


def test_histogram_closes_the_last_bin(spark):
    got = {r.bin: r.cnt for r in density.histogram(rows(spark, [0, 1, 2, 10])).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1}
    assert [(r.bin, r.cnt) for r in density.histogram(rows(spark, [4, 4])).collect()] == [(2, 2)]
