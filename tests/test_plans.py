"""Physical plans: no Python rows, no cross products, pruned scans."""

import pytest
from pyspark.sql import functions as F

import catalogue
from grainmill.operators import encoding, missing, outliers, rules, scaling
from grainmill.operators.rules import Rule

QUERIES = catalogue.QUERIES
FORBIDDEN = ["BatchEvalPython", "ArrowEvalPython", "InPandas", "CartesianProduct",
             "BroadcastNestedLoopJoin"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_product(name, spark, sf_dir):
    plan = _plan(QUERIES[name](spark, sf_dir))
    assert [w for w in FORBIDDEN if w in plan] == []


def test_filter_reaches_the_scan(spark, sf_dir):
    plan = _plan(QUERIES["outliers_iqr"](spark, sf_dir))
    assert "PushedFilters: [Or(LessThan(value" in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in plan


def test_chosen_columns_reach_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    fitted = encoding.fit_labels(orders, "o_orderstatus")
    plan = _plan(fitted.apply(orders).select("o_orderkey", "o_orderstatus"))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_group_samples_are_cut_before_the_shuffle(spark, sf_dir):
    plan = _plan(QUERIES["dup_sample_groups"](spark, sf_dir))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "WindowGroupLimit" in _plan(QUERIES["column_top_values"](spark, sf_dir))


def test_resolution_starts_before_the_shuffle(spark, sf_dir):
    plan = _plan(QUERIES["dedup_keep_first"](spark, sf_dir))
    assert "partial_min" in plan and "Window" not in plan


def test_fitted_steps_run_on_a_stream(spark, sf_dir, tmp_path):
    """What is fitted on a table is applied to a stream of the same rows."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "event_type", F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("value")
    )
    chosen = [Rule("value", "<=", 100)]
    blank = {"value": "convert_nan"}
    ruled = rules.apply_constraint_resolution(events, chosen, blank)
    fills = missing.fit_imputation(ruled, {"value": {"method": "median"}})
    filled = fills.apply(ruled)
    clips = outliers.fit_outlier_treatment(filled, {"value": {"action": "winsorize"}})
    clipped = clips.apply(filled)
    codes = encoding.fit_encoding(clipped, {"event_type": {"method": "one_hot"}})
    sizes = scaling.fit_scaling(clipped, "standard", ["value"])

    def prepare(df):
        df = fills.apply(rules.apply_constraint_resolution(df, chosen, blank))
        return sizes.apply(codes.apply(clips.apply(df)))

    source = str(tmp_path / "in")
    events.write.parquet(source)
    stream = prepare(spark.readStream.schema(events.schema).parquet(source))
    run = (
        stream.writeStream.format("memory").queryName("prepared")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    run.awaitTermination(120)
    streamed = spark.table("prepared")
    batch = prepare(events)
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch).count() == 0
