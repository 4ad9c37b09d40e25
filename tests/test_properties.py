"""Properties that hold for any table."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainmill.operators import duplicates, encoding, missing, outliers, scaling
from grainmill.sources.snapshots import fingerprint, row_diff

SETTINGS = settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
ROWS = st.lists(
    st.tuples(
        st.one_of(st.none(), st.integers(0, 4)),
        st.one_of(st.none(), st.sampled_from(["a", "b", "c"])),
        st.one_of(st.none(), st.floats(-1000, 1000, allow_subnormal=False)),
    ),
    min_size=1,
    max_size=40,
)
SCHEMA = "k int, s string, x double"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@SETTINGS
@given(ROWS)
def test_resolution(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    keys = {(k, s) for k, s, _ in rows}
    for strategy in ("keep_first", "keep_last"):
        kept = _rows(duplicates.resolve_duplicates(df, strategy, ["k", "s"], ["x"]))
        assert set(kept) <= set(rows) and len(kept) == len(keys)
    alone = _rows(duplicates.resolve_duplicates(df, "drop_all", ["k", "s"]))
    stats = duplicates.duplicate_stats(df, ["k", "s"]).first()
    assert len(alone) + stats["total_duplicates"] == len(rows)


@SETTINGS
@given(ROWS)
def test_imputing_twice_changes_nothing(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    plan = {"k": {"method": "mode"}, "s": {"method": "unknown_tag"}, "x": {"method": "median"}}
    once, _ = missing.impute_missing_values(df, plan)
    twice, _ = missing.impute_missing_values(once, plan)
    assert _rows(once) == _rows(twice)


@SETTINGS
@given(ROWS)
def test_clipped_values_stay_inside(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    fitted = outliers.fit_outlier_treatment(df, {"x": {"action": "winsorize", "lower_pct": 20, "upper_pct": 80}})
    values = [r["x"] for r in fitted.apply(df).collect()]
    assert [v is None for v in values] == [x is None for _, _, x in rows]
    for low, high in fitted.clips.values():
        assert all(low <= v <= high for v in values if v is not None)


@SETTINGS
@given(ROWS)
def test_scaling_keeps_the_order(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for method in scaling.METHODS:
        scaled, _ = scaling.apply_scaling(df, method, ["x"])
        pairs = sorted((x, r["x"]) for (_, _, x), r in zip(rows, scaled.collect()) if x is not None)
        assert all(a[1] <= b[1] for a, b in zip(pairs, pairs[1:]))


@SETTINGS
@given(ROWS)
def test_one_hot_rows_have_one_mark(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    fitted = encoding.fit_one_hot(df, "s")
    for (_, s, _), r in zip(rows, fitted.apply(df).collect()):
        assert sum(r[c] for c in fitted.new_columns) == (s is not None)


@SETTINGS
@given(ROWS)
def test_fingerprint_ignores_the_order(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    mixed = df.repartition(3).orderBy(F.rand(1))
    assert fingerprint(df).first() == fingerprint(mixed).first()
    assert fingerprint(df).first() != fingerprint(df.union(df)).first()
    assert row_diff(df, mixed).count() == 0
