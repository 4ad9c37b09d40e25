"""The whole preparation of a table, end to end."""

from catalogue.registry import cte, derived, query, rounded, table
from grainmill.operators import outliers
from grainmill.operators.rules import Rule
from grainmill.plans.preparation import Preparation
from grainmill.session import new_folder
from grainmill.sources.snapshots import SnapshotStore

CHOICES = Preparation(
    columns=["event_id", "user_id", "event_type", "value", "mostly_missing", "const_col"],
    rules=[Rule("value", "<=", 400)],
    imputation={
        "value": {"method": "median"},
        "mostly_missing": {"method": "mean"},
        "event_type": {"method": "unknown_tag"},
    },
    outliers={"value": {"action": "winsorize", "lower_pct": 1, "upper_pct": 99}},
    collinear_columns=["value", "mostly_missing"],
    collinear_threshold=0.4,
    encoding={"event_type": {"method": "label"}},
    scaling_method="standard",
    scaling_columns=["value", "user_id"],
)

# Constant columns go, values above 400 become missing and are filled, values are
# clipped, the second of two related columns is dropped, labels are numbered in
# text order, two columns are scaled.
_SQL = (
    cte("dirty_events")
    + """,
d AS (SELECT DISTINCT event_id, user_id, event_type, value, mostly_missing FROM dirty_events),
r AS (SELECT event_id, user_id, event_type, CASE WHEN value <= 400 THEN value END AS value, mostly_missing FROM d),
i AS (SELECT event_id, user_id, coalesce(event_type, 'Unknown') AS event_type,
             coalesce(value, (SELECT median(value) FROM r)) AS value,
             coalesce(mostly_missing, (SELECT avg(mostly_missing) FROM r)) AS mostly_missing FROM r),
o AS (SELECT event_id, user_id, event_type, mostly_missing, least(greatest(value,
             (SELECT quantile_cont(value, 0.01) FROM i)), (SELECT quantile_cont(value, 0.99) FROM i)) AS value FROM i),
c AS (SELECT abs(round(corr(value, mostly_missing), 4)) > 0.4 AS related FROM o),
l AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS label FROM o GROUP BY event_type),
m AS (SELECT avg(value) AS vm, stddev_samp(value) AS vs, avg(user_id) AS um, stddev_samp(user_id) AS us FROM o)
SELECT event_id, round((user_id - um) / us, 5) AS user_id, CAST(label AS BIGINT) AS event_type,
       round((value - vm) / vs, 5) AS value FROM o JOIN l USING (event_type), m, c WHERE related"""
)


@query("full_preparation", _SQL)
def full_preparation(spark, sf_dir):
    prepared = CHOICES.run(derived(spark, sf_dir, "dirty_events"))
    return rounded(prepared, 5, ["value", "user_id"])


@query("full_preparation_snapshots", _SQL)
def full_preparation_snapshots(spark, sf_dir):
    store = SnapshotStore(spark, new_folder(spark, "snapshots"))
    prepared = CHOICES.run(derived(spark, sf_dir, "dirty_events"), store)
    return rounded(prepared, 5, ["value", "user_id"])


_PHASES = [
    ("df_raw", 9), ("df_schema", 9), ("df_deduplicated", 9), ("df_scoped", 5), ("df_clean", 5), ("df_outlier_handled", 5),
    ("df_collinear_resolved", 4), ("df_final", 4),
]


@query(
    "full_preparation_report",
    cte("dirty_events")
    + ", p AS ("
    + " UNION ALL ".join(
        f"""SELECT '{phase}' AS phase, {columns} AS cols, {"count(*)" if k < 2 else "count(DISTINCT dirty_events)"} AS rows
        FROM dirty_events"""
        for k, (phase, columns) in enumerate(_PHASES)
    )
    + """)
SELECT phase, CAST(rows AS BIGINT) AS row_count, CAST(cols AS INTEGER) AS col_count, CAST(NULL AS VARCHAR) AS error FROM p""",
)
def full_preparation_report(spark, sf_dir):
    _, report = CHOICES.run_with_report(derived(spark, sf_dir, "dirty_events"))
    return report.select("phase", "row_count", "col_count", "error")


def flagship(spark, sf_dir):
    """Outlier report of the event values over the whole table."""
    return outliers.detect_outliers(table(spark, sf_dir, "events"), ["value"])
