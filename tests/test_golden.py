"""Small literal tables for the rules on missing values, ties and edges."""

import json
import math

import numpy as np
import pandas as pd

import pytest
from pyspark.sql import functions as F

from grainmill.functions.columns import missing_as_null, numeric_columns, type_family
from grainmill.functions.moments import collect_moments, safe_corr
from grainmill.functions.similarity import similar_numbers, similar_strings
from grainmill.operators import (
    correlation,
    distribution,
    duplicates,
    encoding,
    missing,
    outliers,
    profile,
    rules,
    scaling,
    schema,
    scope,
)
from grainmill.operators.rules import Rule
from grainmill.plans.preparation import Preparation


def _column(spark, values, dtype="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {dtype}")


def _values(df, column="x"):
    return [r[column] for r in df.collect()]


def test_sample_moments(spark):
    df = _column(spark, [1.0, 2.0, 2.0, 3.0, 9.0])
    m = collect_moments(df, {"x": F.col("x")})["x"]
    assert m["skewness"] == pytest.approx(1.9693601762)
    assert m["kurtosis"] == pytest.approx(4.0691865397)
    assert m["std"] == pytest.approx(3.2093613072)
    s = pd.Series([1.0, 2.0, 2.0, 3.0, 9.0])
    assert m["skewness"] == pytest.approx(s.skew()) and m["kurtosis"] == pytest.approx(s.kurt())


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_moments_of_few_values(spark, n):
    m = collect_moments(_column(spark, [1.0, 2.0, 4.0][:n]), {"x": F.col("x")})["x"]
    assert m["count"] == n
    assert (m["std"] is None) == (n < 2)
    assert (m["skewness"] is None) == (n < 3)
    assert m["kurtosis"] is None


def test_nan_becomes_null(spark):
    df = missing_as_null(_column(spark, [1.0, float("nan"), None]))
    assert _values(df) == [1.0, None, None]


def test_constant_column(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(3)], "x double, y double")
    assert df.agg(safe_corr(F.col("x"), F.col("y"))).first()[0] is None
    assert scaling.fit_scaling(df).params.keys() == {"y"}
    _, stats = scope.apply_scope_selection(df)
    assert {r["column"]: r["reason"] for r in stats.collect()} == {"x": "zero_variance", "y": None}
    assert outliers.fit_outlier_bounds(df, ["x"], "zscore")["x"].active is False
    assert outliers.fit_outlier_bounds(df, ["x"], "modified_zscore")["x"].active is False
    counts = _values(distribution.histogram(df, "x", 4), "n")
    assert sum(counts) == 3


def test_type_families(spark):
    df = spark.sql(
        "SELECT 1 AS a, 1.5D AS b, 'x' AS c, true AS d, current_date() AS e, array(1) AS f, 1.5BD AS g"
    )
    assert [type_family(f) for f in df.schema.fields] == [
        "Integer", "Float", "String/Object", "Boolean", "DateTime", "array<int>", "decimal(2,1)",
    ]
    assert numeric_columns(df) == ["a", "b", "g"]
    found = {r["family"]: r["n_columns"] for r in profile.type_distribution(df).collect()}
    assert found["Integer"] == 1


def test_nested_columns_pass_through(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [3])], "a int, b array<int>")
    detected = {r["column"]: r for r in schema.detect_schema(df).collect()}
    assert detected["b"]["original_type"] == "nested" and detected["b"]["unique_count"] is None
    advice = {r["column"]: r["recommendation"] for r in scope.column_recommendations(df).collect()}
    assert advice == {"a": "review", "b": "keep"}
    assert {r["column"] for r in scope.column_summary(df).collect()} == {"a", "b"}


def test_booleans(spark):
    df = _column(spark, ["TRUE", "no", "Y", "0", "t", "1.0", "maybe", None], "string")
    cast = schema.apply_schema_overrides(df, {"x": "boolean"})
    assert _values(cast) == [True, False, True, False, True, None, None, None]


def test_integers(spark):
    df = _column(spark, ["1", "2.0", "2.5", "x", None, "9007199254740993"], "string")
    cast = schema.apply_schema_overrides(df, {"x": "int64"})
    assert _values(cast) == [1, 2, None, None, None, 9007199254740993]
    assert schema.cast_errors(df, {"x": "int64"}).first()["failed_count"] == 2


def test_numbers_are_plain(spark):
    df = _column(spark, ["1", " 2.5 ", "1e3", "-.5", "3.", "1f", "0x10", "NaN", ""], "string")
    cast = schema.apply_schema_overrides(df, {"x": "float64"})
    assert _values(cast) == [1.0, 2.5, 1000.0, -0.5, 3.0, None, None, None, None]


def test_datetimes(spark):
    texts = ["2024-02-03", "2024-02-03 04:05:06", "2024-02-03T04:05:06.5", "1999", "2/3/2024",
             "2024/2/3", "12.5", "1", "2024-13-01", "12345", "13/40/2024"]
    cast = schema.apply_schema_overrides(_column(spark, texts, "string"), {"x": "datetime64[ns]"})
    assert [None if v is None else v.isoformat() for v in _values(cast)] == [
        "2024-02-03T00:00:00", "2024-02-03T04:05:06", "2024-02-03T04:05:06.500000",
        "1999-01-01T00:00:00", "2024-02-03T00:00:00", "2024-02-03T00:00:00", None, None, None,
        None, None,
    ]
    assert cast.dtypes == [("x", "timestamp_ntz")]


def test_override_errors_leave_the_table(spark):
    df = _column(spark, ["a"], "string")
    overrides = {"nope": "int64", "x": "no such type"}
    assert schema.apply_schema_overrides(df, overrides).dtypes == [("x", "string")]
    found = {r["column"]: r["error"] for r in schema.cast_errors(df, overrides).collect()}
    assert found["nope"] == "column not found" and found["x"]


def test_category_is_marked(spark):
    df = schema.apply_schema_overrides(_column(spark, ["a"], "string"), {"x": "category"})
    assert type_family(df.schema["x"]) == "Category"


@pytest.mark.parametrize(
    ("values", "inferred"),
    [
        (["yes", "NO", None], "boolean"),
        (["yes", "true"], "string"),
        (["1", "0"], "float64"),
        (["2020", "2021"], "datetime"),
        ([None, None], "unknown"),
        (["a"] * 60 + ["b"] * 60, "category"),
        (["a", "b"], "string"),
    ],
)
def test_inferred_types(spark, values, inferred):
    row = schema.detect_schema(_column(spark, values, "string")).first()
    assert row["inferred_type"] == inferred


def test_duplicate_keys_with_null(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    row = duplicates.duplicate_stats(df).first()
    assert (row["total_duplicates"], row["unique_groups"], row["rows_to_remove"]) == (2, 1, 1)
    assert duplicates.sample_duplicate_groups(df).count() == 2
    assert duplicates.resolve_duplicates(df).count() == 2
    assert _values(duplicates.resolve_duplicates(df, "drop_all"), "a") == [2]


def test_keep_first_and_last_follow_the_order(spark):
    rows = [("k", 3, "c", None), ("k", 1, "a", [1]), ("k", 2, "b", None), ("m", 5, "z", [2])]
    df = spark.createDataFrame(rows, "key string, t int, v string, extra array<int>")
    first = duplicates.resolve_duplicates(df, "keep_first", ["key"], ["t"]).collect()
    last = duplicates.resolve_duplicates(df, "keep_last", ["key"], ["t"]).collect()
    assert sorted(r["v"] for r in first) == ["a", "z"] and sorted(r["v"] for r in last) == ["c", "z"]
    assert first[0].asDict().keys() == {"key", "t", "v", "extra"}
    with pytest.raises(ValueError):
        duplicates.resolve_duplicates(df, "keep_some")
    with pytest.raises(ValueError):
        duplicates.duplicate_stats(df, ["nope"])
    with pytest.raises(ValueError):
        duplicates.duplicate_stats(df, [])


def test_similar_numbers(spark):
    rows = [(100.0, 95.5), (100.0, 94.0), (0.0, 0.04), (0.0, 0.0), (-1.0, 1.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    found = df.select(similar_numbers(F.col("a"), F.col("b"), 0.05).alias("x"))
    assert _values(found) == [True, False, True, True, False, False]


def test_similar_strings(spark):
    rows = [("abc", "CBA"), ("abc", "abd"), ("", ""), ("", "a"), (None, None), (None, "a")]
    df = spark.createDataFrame(rows, "a string, b string")
    found = df.select(similar_strings(F.col("a"), F.col("b"), 0.9).alias("x"))
    assert _values(found) == [True, False, True, False, True, False]


def test_rules_and_missing_values(spark):
    df = spark.createDataFrame([(1, 1), (None, 1), (7, None), (5, 9)], "a int, b int")
    checks = [
        (Rule("a", ">", 0), [False, True, False, False]),
        (Rule("a", ">=", other="b"), [False, True, True, True]),
        (Rule("a", "in", [1, "5"]), [False, True, True, False]),
        (Rule("a", "!=", 5), [False, False, False, True]),
        (Rule("a", "!=", other="b"), [True, False, False, False]),
        (Rule("a", predicate="a < 6 OR b IS NULL"), [False, True, False, False]),
    ]
    for rule, expected in checks:
        assert _values(df.select(rules.violation(df, rule).alias("x"))) == expected, rule
    for bad in [Rule("a", "=>", 3), Rule("nope", ">", 0), Rule("a", ">", "x"), Rule("a", "in", 3),
                Rule("a", predicate="a +"), Rule("a", predicate="a + 1")]:
        with pytest.raises(rules.RuleError):
            rules.violation(df, bad)


def test_rules_run_in_order(spark):
    df = spark.createDataFrame([(1, 1), (-1, -2)], "a int, b int")
    chosen = [Rule("a", ">", 0), Rule("b", "<=", other="a")]
    blanked = rules.apply_constraint_resolution(
        df, chosen, {"a": "convert_nan", "b": "drop_row"}
    )
    assert [tuple(r) for r in blanked.collect()] == [(1, 1)]
    flagged = rules.apply_constraint_resolution(df, [Rule("a", "<", 100)], {})
    assert _values(flagged, "a_constraint_violation") == [False, False]
    two = rules.apply_constraint_resolution(df, [Rule("a", ">", 0), Rule("a", "<", 1)], {})
    assert _values(two, "a_constraint_violation") == [True, True]


def test_missing_values(spark):
    df = spark.createDataFrame(
        [("b", 1, 1.0), ("a", None, None), ("b", 2, None), ("a", 4, 9.0), (None, None, 3.0)],
        "s string, i int, d double",
    )
    filled, stats = missing.impute_missing_values(
        df,
        {"s": {"method": "mode"}, "i": {"method": "mean"}, "d": {"method": "median"}},
    )
    rows = filled.collect()
    assert rows[4]["s"] == "a"
    assert rows[1]["i"] == pytest.approx(7 / 3) and rows[0]["i"] == 1
    assert rows[2]["d"] == 3.0
    assert {r["column"]: r["values_imputed"] for r in stats.collect()} == {"s": 1, "i": 2, "d": 2}


def test_drop_changes_later_fills(spark):
    df = spark.createDataFrame([(1, 10.0), (None, 1000.0), (3, None), (4, 20.0)], "a int, b double")
    filled, stats = missing.impute_missing_values(
        df, {"a": {"method": "drop"}, "b": {"method": "mean"}}
    )
    assert _values(filled, "b") == [10.0, 15.0, 20.0]
    assert stats.first()["rows_after_imputation"] == 3


def test_imputation_errors(spark):
    df = spark.createDataFrame([(None, None), (1, "a")], "a int, s string")
    filled, stats = missing.impute_missing_values(
        df,
        {"a": {"method": "constant", "value": "x"}, "s": {"method": "mean"}, "zz": {"method": "mode"}},
    )
    assert filled.first()["a"] is None and all(r["error"] for r in stats.collect())
    again, stats = missing.impute_missing_values(
        df, {"a": {"method": "constant", "value": "5"}, "s": {"method": "unknown_tag", "value": "?"}}
    )
    assert tuple(again.first()) == (5, "?")
    with pytest.raises(ValueError):
        missing.fit_imputation(df, {"a": {"method": "guess"}})


def test_all_missing_column(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b")], "x double, s string")
    summary = missing.missing_summary(df).collect()
    assert [(r["column"], r["missing_pct"], r["suggested_strategy"]) for r in summary] == [
        ("x", 100.0, "mean")
    ]
    filled, stats = missing.impute_missing_values(df, {"x": {"method": "median"}})
    assert _values(filled) == [None, None] and stats.first()["values_imputed"] == 0
    advice = {r["column"]: r for r in scope.column_recommendations(df).collect()}
    # Constant and mostly missing: ends as review.
    assert advice["x"]["flags"] == "zero_variance,high_missing"
    assert advice["x"]["recommendation"] == "review"
    assert outliers.fit_outlier_bounds(df) == {}


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, s string")
    assert missing.missing_totals(df).first()["overall_missing_pct"] == 0.0
    assert schema.detect_schema(df).count() == 2
    assert scope.column_recommendations(df).count() == 2
    assert duplicates.duplicate_stats(df).first()["total_duplicates"] == 0
    assert duplicates.resolution_stats(df).first()["removed_rows"] == 0
    assert missing.missing_cooccurrence(df).count() == 0


def test_winsorize_keeps_missing(spark):
    df = _column(spark, [float(i) for i in range(101)] + [None])
    clipped, stats = outliers.resolve_outliers(
        df, {"x": {"action": "winsorize", "lower_pct": 10, "upper_pct": 90}}
    )
    values = _values(clipped)
    assert min(v for v in values if v is not None) == 10.0 and values[-1] is None
    row = stats.first()
    assert (row["cells_clipped"], row["outliers_found"]) == (20, 0)


def test_zscore_uses_population_deviation(spark):
    x = [1.0] * 10 + [2.0] * 10 + [9.0]
    bounds = outliers.fit_outlier_bounds(_column(spark, x), method="zscore", threshold=3.0)["x"]
    s = pd.Series(x)
    assert bounds.upper == pytest.approx(s.mean() + 3 * s.std())
    assert bounds.reach == pytest.approx(3 * s.std(ddof=0))
    with pytest.raises(ValueError):
        outliers.detect_outliers(_column(spark, x), method="guess")


def test_ordinal_labels(spark):
    df = _column(spark, ["low", "High", "MEDIUM", None], "string")
    assert _values(encoding.fit_labels(df, "x").apply(df)) == [1, 3, 2, None]


def test_labels_follow_text_order(spark):
    df = _column(spark, [2, 10, 1, None], "int")
    assert _values(encoding.fit_labels(df, "x").apply(df)) == [2, 1, 0, None]
    table = encoding.fit_labels(df, "x", rows_per_block=1)
    found = {r["x"] for r in table.apply(df).collect()}
    assert found == {2, 1, 0, None} and table.table is not None


def test_words_that_contain_low(spark):
    df = _column(spark, ["yellow", "red"], "string")
    row = encoding.detect_categorical(df).first()
    assert (row["category_type"], row["suggested_encoding"]) == ("ordinal", "label")


def test_one_hot_matches_pandas(spark):
    pdf = pd.DataFrame({"k": [1, 2, 3, 4], "x#": ["b", "a", None, "b"]})
    df = spark.createDataFrame([tuple(r) for r in pdf.itertuples(index=False)], "k int, `x#` string")
    for drop_first in (False, True):
        ours = encoding.fit_one_hot(df, "x#", drop_first).apply(df).toPandas()
        theirs = pd.get_dummies(pdf, columns=["x#"], drop_first=drop_first)
        assert list(ours.columns) == list(theirs.columns)
        assert (ours.values == theirs.values).all()
    with pytest.raises(ValueError):
        encoding.fit_one_hot(df, "x#", max_values=1)


def test_encoding_records_failures(spark):
    df = _column(spark, ["a"], "string")
    fitted = encoding.fit_encoding(df, {"x": {"method": "magic"}, "nope": {"method": "label"}})
    assert fitted.errors == {"x": "no such method: magic"} and not fitted.steps


def test_histogram_matches_numpy(spark):
    x = np.random.default_rng(0).normal(size=500)
    df = _column(spark, [float(v) for v in x])
    found = distribution.histogram(df, "x", 20).orderBy("bin").toPandas()
    counts, edges = np.histogram(x, bins=20)
    assert list(found["n"]) == list(counts)
    assert found["bin_start"].to_numpy() == pytest.approx(edges[:-1])


def test_density(spark):
    x = np.random.default_rng(1).normal(size=80)
    found = distribution.kernel_density(_column(spark, [float(v) for v in x]), "x").toPandas()
    h = 80 ** (-1 / 5) * x.std(ddof=1)
    grid = np.linspace(x.min(), x.max(), 100)
    expected = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (80 * h * np.sqrt(2 * np.pi))
    assert found["density"].to_numpy() == pytest.approx(expected)
    assert found["scaled"].max() == pytest.approx(np.histogram(x, bins=30)[0].max())
    assert distribution.kernel_density(_column(spark, [1.0] * 10), "x").count() == 0


def test_category_bars_and_points(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 99.0), ("b", 1.5)], "s string, x double")
    assert [r["value"] for r in distribution.category_bars(df, ["s", "x"]).collect()] == ["a", "b"]
    assert _values(distribution.boxplot_points(df, "x")) == [99.0]


def test_rule_constants_keep_their_digits(spark):
    df = spark.createDataFrame([(9007199254740992,), (9007199254740993,)], "id bigint")
    exact = rules.Rule("id", "==", "9007199254740993")
    assert [r["id"] for r in df.where(rules.violation(df, exact)).collect()] == [9007199254740992]
    words = spark.createDataFrame([("None",), ("a",)], "x string")
    with pytest.raises(rules.RuleError):
        rules.violation(words, rules.Rule("x", "in", ["a", None]))


def test_one_hot_has_no_silent_limit(spark):
    df = spark.range(1100).selectExpr("id", "concat('v', id) AS x")
    fitted = encoding.fit_one_hot(df, "x")
    assert len(fitted.new_columns) == 1100
    with pytest.raises(ValueError):
        encoding.fit_one_hot(df, "x", max_values=1000)


def test_given_labels_of_any_type(spark):
    df = _column(spark, ["a", "b", "c", None], "string")
    assert _values(encoding.fit_labels(df, "x", {"a": 0.5, "b": 2.75}).apply(df)) == [0.5, 2.75, None, None]
    assert _values(encoding.fit_labels(df, "x", {"a": "low", "b": "high"}).apply(df)) == ["low", "high", None, None]


def test_text_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, s string")
    with pytest.raises(ValueError, match="not numeric"):
        correlation.correlation_matrix(df, ["x", "s"])


@pytest.mark.parametrize("values", [
    [math.sin(k) * 5 + k % 7 for k in range(400)],
    [0.0] * 300 + [1e6],
    [float(k % 2) for k in range(50)],
    [1e9 + k for k in range(40)],
    [math.exp(k / 30) for k in range(500)],
])
def test_density_equals_a_sum_over_all_values(spark, values):
    v = np.array(values)
    found = distribution.kernel_density(_column(spark, [*values, None]), "x").toPandas()
    h = len(v) ** -0.2 * v.std(ddof=1)
    x = np.linspace(0, v.max() - v.min(), 100)
    wanted = np.exp(-0.5 * ((x[:, None] - (v - v.min())) / h) ** 2).mean(axis=1) / (h * math.sqrt(2 * math.pi))
    assert np.abs(found["density"].to_numpy() - wanted).max() < 1e-11 / h
    tallest = np.histogram(v, 30)[0].max()
    assert found["scaled"].max() == pytest.approx(tallest)


def test_constants_of_other_types(spark):
    """Booleans and dates are filled with a value of their type or a text that writes one."""
    df = spark.createDataFrame([(None, None, None), (True, None, 1)], "b boolean, d date, i int")
    good = {"b": {"method": "constant", "value": False}, "d": {"method": "constant", "value": "2024-02-29"}}
    out, _ = missing.impute_missing_values(df, good)
    assert [(r["b"], str(r["d"])) for r in out.collect()] == [(False, "2024-02-29"), (True, "2024-02-29")]
    bad = {"b": {"method": "constant", "value": "maybe"}, "d": {"method": "constant", "value": "2023-02-29"}}
    out, stats = missing.impute_missing_values(df, bad)
    assert [r["error"] is not None for r in stats.collect()] == [True, True]
    assert out.where("d IS NOT NULL").count() == 0


def test_samples_of_categorical_columns(spark):
    df = spark.createDataFrame([(k, f"v{k % 7}", k % 3, None) for k in range(40)], "id long, t string, few int, none string")
    found = {r["column"]: r["sample_values"] for r in encoding.detect_categorical(df, samples=5).collect()}
    assert found == {"t": ["v0", "v1", "v2", "v3", "v4"], "few": ["0", "1", "2"], "none": []}


def test_one_hot_has_a_limit_unless_lifted(spark, monkeypatch):
    df = spark.range(60).selectExpr("CAST(id AS STRING) AS t")
    with pytest.raises(ValueError):
        encoding.fit_one_hot(df, "t", max_values=59)
    assert len(encoding.fit_one_hot(df, "t", max_values=None).values) == 60
    assert encoding.MAX_CATEGORIES == 10_000


def test_a_preparation_reports_each_phase(spark):
    """A phase that fails says why and passes its table on."""
    rows = [(k, "a" if k % 2 else "b", float(k % 5) if k % 7 else None, 1) for k in range(40)] + [(0, "b", None, 1)]
    df = spark.createDataFrame(rows, "id long, t string, v double, same int")
    chosen = Preparation(
        imputation={"v": {"method": "median"}}, encoding={"t": {"method": "no such"}}, scaling_method="standard",
        outliers={"v": {"action": "winsorize"}},
    )
    table, report = chosen.run_with_report(df)
    told = {r["phase"]: r for r in report.collect()}
    assert [r["place"] for r in report.orderBy("place").collect()] == list(range(8))
    assert (told["df_raw"]["row_count"], told["df_deduplicated"]["row_count"]) == (41, 40)
    assert told["df_scoped"]["col_count"] == 3 and "same" in told["df_scoped"]["details"]
    imputed = json.loads(told["df_clean"]["details"])["imputed"]
    assert imputed[0]["column"] == "v" and imputed[0]["values_imputed"] == 6
    assert "cannot encode" in told["df_final"]["error"]
    assert [p for p, r in told.items() if r["error"]] == ["df_final"]
    assert table.columns == ["id", "t", "v"] and table.count() == 40
    with pytest.raises(ValueError):
        chosen.run(df)
