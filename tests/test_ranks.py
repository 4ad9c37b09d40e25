import math

import numpy as np
import pandas as pd
import pytest

from grainmill.operators import correlation
from grainmill.plans import lookup, ranks
from grainmill.plans.ranks import kendall_matrix, kendall_tau, spearman_matrix


def _data(n=300):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 40, n).astype(float)
    y = np.round(x + rng.normal(0, 15, n), 1)
    z = np.where(rng.random(n) < 0.35, 5.0, rng.normal(0, 3, n))
    return pd.DataFrame({"x": x, "y": y, "z": z})


def _tau(a, b):
    s = n0 = tx = ty = 0
    for i in range(len(a)):
        for j in range(i):
            dx, dy = np.sign(a[i] - a[j]), np.sign(b[i] - b[j])
            s, n0 = s + dx * dy, n0 + 1
            tx, ty = tx + (dx == 0), ty + (dy == 0)
    return s / math.sqrt((n0 - tx) * (n0 - ty))


@pytest.mark.parametrize("rows_per_block", [11, 10_000])
@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_kendall(spark, monkeypatch, rows_per_block, broadcast):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", broadcast)
    pdf = _data()
    df = spark.createDataFrame(pdf)
    for a, b in [("x", "y"), ("y", "z")]:
        found = kendall_tau(df, a, b, rows_per_block)
        assert found == pytest.approx(_tau(list(pdf[a]), list(pdf[b])), abs=1e-12)


@pytest.mark.parametrize("rows_per_block", [11, 10_000])
def test_kendall_of_all_pairs(spark, rows_per_block):
    pdf = _data()
    pdf["w"] = np.random.default_rng(2).normal(0, 1e6, len(pdf))
    pdf["v"] = -pdf["x"] - 0.25 * (pdf["w"] > 0)
    names = list(pdf.columns)
    found = kendall_matrix(spark.createDataFrame(pdf).repartition(3), names, rows_per_block)
    assert list(found) == [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    for (a, b), tau in found.items():
        assert tau == pytest.approx(_tau(list(pdf[a]), list(pdf[b])), abs=1e-12)


@pytest.mark.parametrize("matrix", [kendall_matrix, spearman_matrix])
def test_jobs_do_not_grow_with_the_pairs(spark, matrix):
    context = spark.sparkContext
    pdf = _data(60)
    for c in "uvw":
        pdf[c] = np.random.default_rng(ord(c)).normal(size=len(pdf))
    df = spark.createDataFrame(pdf).cache()
    df.count()
    jobs = []
    for k, columns in enumerate((list(pdf.columns)[:2], list(pdf.columns))):
        context.setJobGroup(f"ranks {matrix.__name__} {k}", "pairs of columns")
        matrix(df, columns)
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"ranks {matrix.__name__} {k}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    df.unpersist()
    assert jobs[1] <= jobs[0] + 1  # a join with a larger table may broadcast in a job of its own


@pytest.mark.parametrize("rows_per_block", [11, 10_000])
@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_spearman(spark, monkeypatch, rows_per_block, broadcast):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", broadcast)
    pdf = _data()
    found = spearman_matrix(spark.createDataFrame(pdf), ["x", "y", "z"], rows_per_block)
    ranks = pdf.rank()
    for (a, b), r in found.items():
        assert r == pytest.approx(ranks[a].corr(ranks[b]), abs=1e-12)


def test_constant_columns(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "a double, b double")
    for method in correlation.METHODS:
        assert correlation.fit_correlations(df, ["a", "b"], method) == {("a", "b"): None}


def test_missing_rows_are_left_out(spark):
    rows = [(1.0, 2.0), (2.0, 1.0), (3.0, None), (4.0, 7.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    kept = pd.DataFrame([r for r in rows if None not in r], columns=["a", "b"])
    assert correlation.fit_correlations(df, ["a", "b"])["a", "b"] == pytest.approx(
        kept["a"].corr(kept["b"])
    )
    assert kendall_tau(df, "a", "b") == pytest.approx(_tau(list(kept["a"]), list(kept["b"])))


def test_vif_against_least_squares(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=200), rng.normal(size=200)
    pdf = pd.DataFrame({"a": a, "b": b, "c": a + 0.5 * b + rng.normal(0, 0.3, 200),
                        "flag": (a > 0).astype(int)})
    found = correlation.fit_vif(spark.createDataFrame(pdf))
    assert "flag" not in found
    for c in "abc":
        others = np.column_stack([np.ones(200)] + [pdf[o] for o in "abc" if o != c])
        rest = pdf[c] - others @ np.linalg.lstsq(others, pdf[c], rcond=None)[0]
        expected = ((pdf[c] - pdf[c].mean()) ** 2).sum() / (rest**2).sum()
        assert found[c] == pytest.approx(expected, rel=1e-9)


def test_vif_of_a_copy_is_infinite(spark):
    df = spark.range(50).selectExpr("id AS a", "id * 2 + 10 AS b", "id * id % 17 AS c")
    found = correlation.fit_vif(df)
    assert math.isinf(found["a"]) and math.isinf(found["b"]) and found["c"] < 5
    grades = {r["column"]: r["status"] for r in correlation.calculate_vif(df).collect()}
    assert grades["a"] == "very_high"


def test_vif_errors_and_single_column(spark):
    df = spark.range(50).selectExpr("id AS a", "id % 2 AS b")
    assert correlation.fit_vif(df) == {"a": 1.0}
    with pytest.raises(ValueError):
        correlation.fit_vif(df, ["a"])
    with pytest.raises(ValueError):
        correlation.fit_vif(df.limit(0), ["a", "b"], include_binary=True)


def test_recommendations_skip_settled_columns(spark):
    df = spark.range(100).selectExpr(
        "id AS a", "id + pmod(id * 7, 5) AS b", "id + pmod(id * 11, 3) AS c"
    )
    found = correlation.detect_multicollinearity(df)
    assert len(found.pairs) == 3
    # One drop settles two pairs, the third one gets its own.
    assert len(found.recommendations) == 2
    assert found.summary_frame(spark).first()["columns_recommended_for_removal"] == 2


def test_formula_error_is_reported(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    out, stats = correlation.resolve_multicollinearity(
        df, {"zzz": "drop"}, {"r": "try_divide(a, b)", "bad": "a / nope"}
    )
    assert out.columns == ["a", "b", "r"] and out.first()["r"] is None
    assert [bool(r["error"]) for r in stats.collect()] == [False, True]


def _wide(spark, n, k, missing=0.0):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(n, 6))
    data = base @ rng.normal(size=(6, k)) + rng.normal(size=(n, k)) * 10.0 ** rng.integers(-3, 6, k) + 10.0 ** rng.integers(0, 8, k)
    pdf = pd.DataFrame(data, columns=[f"c{i}" for i in range(k)])
    if missing:
        pdf = pdf.mask(rng.random(pdf.shape) < missing)
    schema = ", ".join(f"c{i} double" for i in range(k))
    rows = [tuple(None if v != v else float(v) for v in row) for row in pdf.to_numpy()]
    return pdf, spark.createDataFrame(rows, schema)


def test_wide_tables_take_as_many_jobs_as_narrow_ones(spark):
    """300 columns: two passes, one for the moments and one for all products, and one solution."""
    context = spark.sparkContext
    jobs = []
    for k in (3, 300):
        pdf, df = _wide(spark, 700, k)
        context.setJobGroup(f"gram {k}", "columns")
        found = correlation.fit_correlations(df, list(pdf.columns))
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"gram {k}")))
        wanted = np.corrcoef(pdf.to_numpy().T)
        for (a, b), r in found.items():
            assert r == pytest.approx(wanted[int(a[1:]), int(b[1:])], abs=1e-9)
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] <= 3
    vif = correlation.fit_vif(df, list(pdf.columns))
    inverse = np.diag(np.linalg.inv(wanted))
    assert [vif[c] for c in pdf.columns] == pytest.approx(list(inverse), rel=1e-6)


def test_pairwise_correlations_with_missing_cells(spark):
    pdf, df = _wide(spark, 300, 9, missing=0.3)
    df = df.selectExpr("*", "CASE WHEN c0 IS NOT NULL THEN 5.0D ELSE c1 END AS odd", "1.0D AS same", "CAST(NULL AS DOUBLE) AS none")
    found = {(r["column1"], r["column2"]): r["r"] for r in correlation.pairwise_correlations(df).collect()}
    pdf["odd"] = np.where(pdf["c0"].notna(), 5.0, pdf["c1"])
    wanted = pdf.corr()
    for a in pdf.columns:
        for b in pdf.columns:
            if (a, b) in (("odd", "c0"), ("c0", "odd")):
                assert found[a, b] is None  # constant where both are present
            else:
                assert found[a, b] == pytest.approx(wanted.loc[a, b], abs=1e-9)
    assert {found[c, "same"] for c in pdf.columns} == {found["none", "none"], found["same", "same"]} == {None}


def test_pairs_far_from_an_outlier_keep_their_digits(spark):
    """The outlier is in a row that the other column lacks."""
    rows = [(float(k % 7), float(k % 5)) for k in range(60)] + [(1e12, None)]
    found = correlation.pairwise_correlations(spark.createDataFrame(rows, "a double, b double")).where("column1 < column2").first()
    pdf = pd.DataFrame(rows[:-1])
    assert found["r"] == pytest.approx(pdf[0].corr(pdf[1]), abs=1e-9)


def test_signed_pairs_of_weighted_places():
    rng = np.random.default_rng(1)
    for values in (1, 3, 40):
        x, y, n = (rng.integers(0, values, 70) for _ in range(3))
        slow = sum(
            int(n[i] * n[j] * np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])) for i in range(70) for j in range(i)
        )
        assert ranks.signed_pairs(x, y, n) == slow
    huge = np.array([3 << 32, 3 << 32])
    assert ranks.signed_pairs(np.arange(2), np.arange(2), huge) == 9 << 64


def test_kendall_moves_no_rows_of_frequent_values(spark, monkeypatch):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"few": rng.integers(0, 3, 400).astype(float), "many": rng.normal(size=400)})
    pdf.loc[:150, "many"] = 7.5
    points = ranks._split_values(spark.createDataFrame(pdf), 400, 25)
    moved = [ranks._blocks(pdf[c].to_numpy(), p) % 2 == 0 for c, p in zip(pdf.columns, points)]
    assert not moved[0].any() and not moved[1][:151].any() and moved[1].any()
    found = kendall_tau(spark.createDataFrame(pdf), "few", "many", 25)
    assert found == pytest.approx(_tau(list(pdf["few"]), list(pdf["many"])), abs=1e-12)


def test_kendall_with_nan_as_the_largest(spark):
    pdf = _data(80)
    pdf["w"] = pdf["y"]
    pdf.loc[::9, "w"] = 1e9
    df = spark.createDataFrame(pdf).selectExpr("x", "CASE WHEN w = 1e9 THEN double('NaN') ELSE w END AS w")
    assert kendall_tau(df, "x", "w", 10) == pytest.approx(_tau(list(pdf["x"]), list(pdf["w"])), abs=1e-12)


@pytest.mark.parametrize("sent", [0, 45, 1 << 20])
def test_spearman_by_sent_ranks_and_by_joins(spark, monkeypatch, sent):
    monkeypatch.setattr(ranks, "SENT_VALUES", sent)
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    pdf = _data(200)
    pdf.loc[20:, "z"] = 5.0
    made, join = [], ranks.balanced_lookup
    monkeypatch.setattr(ranks, "balanced_lookup", lambda *a: made.append(a[3]) or join(*a))
    found = spearman_matrix(spark.createDataFrame(pdf), ["x", "y", "z"], 30)
    assert sorted(made) == {0: ["v0", "v1", "v2"], 45: ["v0", "v1"], 1 << 20: []}[sent]
    ranked = pdf.rank()
    for (a, b), r in found.items():
        assert r == pytest.approx(ranked[a].corr(ranked[b]), abs=1e-12)
