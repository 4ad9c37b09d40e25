"""The whole preparation of a table, phase by phase."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from grainmill.functions.columns import existing, missing_as_null, numeric_columns
from grainmill.operators.correlation import (
    PAIR_THRESHOLD,
    detect_multicollinearity,
    resolve_multicollinearity,
)
from grainmill.operators.duplicates import resolve_duplicates
from grainmill.operators.encoding import fit_encoding
from grainmill.operators.missing import fit_imputation
from grainmill.operators.outliers import fit_outlier_treatment
from grainmill.operators.rules import Rule, apply_constraint_resolution
from grainmill.operators.scaling import fit_scaling
from grainmill.operators.schema import apply_schema_overrides
from grainmill.operators.scope import apply_scope_selection
from grainmill.session import settle
from grainmill.sources.snapshots import SnapshotStore


@dataclass
class Preparation:
    """Choices for each phase; a phase without choices passes the table on."""

    overrides: dict[str, str] = field(default_factory=dict)
    drop_exact_duplicates: bool = True
    duplicate_strategy: str = "keep_first"
    duplicate_keys: list[str] | None = None
    duplicate_order: list[str] | None = None
    columns: list[str] | None = None
    drop_zero_variance: bool = True
    rules: list[Rule] = field(default_factory=list)
    rule_actions: dict[str, str] = field(default_factory=dict)
    imputation: dict[str, dict[str, Any]] = field(default_factory=dict)
    outliers: dict[str, dict[str, Any]] = field(default_factory=dict)
    outlier_method: str = "iqr"
    outlier_threshold: float | None = None
    collinear_actions: dict[str, str] | None = None
    collinear_columns: list[str] | None = None
    collinear_threshold: float = PAIR_THRESHOLD
    combine_formulas: dict[str, str] | None = None
    encoding: dict[str, dict[str, Any]] = field(default_factory=dict)
    scaling_method: str | None = None
    scaling_columns: list[str] | None = None

    def run(self, df: DataFrame, store: SnapshotStore | None = None) -> DataFrame:
        """Prepare a table; with a store, each phase is kept as a snapshot.

        Rule violations become missing before missing values are filled.
        Encoding comes before scaling, so labels are scaled, one-hot columns
        are not.
        """
        config = asdict(self)
        table = df
        for phase, summary, step in self._phases():
            table, _ = step(table)
            if store:
                # The stored table is read back, so no phase is computed twice.
                table = store.commit(phase, table, config, summary)
            elif phase == "df_deduplicated" and (self.drop_exact_duplicates or self.duplicate_keys):
                # Several fits follow; they should not repeat the shuffle.
                table = settle(table)
        return table

    def run_with_report(self, df: DataFrame, store: SnapshotStore | None = None) -> tuple[DataFrame, DataFrame]:
        """The prepared table, and a row per phase: rows, columns, details as JSON and an error.

        A phase that cannot be done says why and passes its table on, as does
        one whose choices name what is not there. Each phase is written once.
        """
        spark, config, table, told = df.sparkSession, asdict(self), df, []
        for place, (phase, summary, step) in enumerate(self._phases()):
            details, error, before = {}, None, table
            try:
                table, details = step(table)
                table = store.commit(phase, table, config, summary) if store else settle(table)
            except (ValueError, PySparkException) as problem:
                error = f"{type(problem).__name__}: {problem}".splitlines()[0]
                table = store.commit(phase, before, config, f"{summary}: failed") if store else settle(before)
            told.append((place, phase, summary, table.count(), len(table.columns), json.dumps(details, default=str), error))
        schema = "place int, phase string, summary string, row_count bigint, col_count int, details string, error string"
        return table, spark.createDataFrame(told, schema)

    def _phases(self) -> list[tuple[str, str, Callable[[DataFrame], tuple[DataFrame, dict[str, Any]]]]]:
        """Name, summary and step of each phase; a step gives the table and what it did."""
        return [
            ("df_raw", "raw table", lambda table: (missing_as_null(table), {})),
            ("df_schema", "types applied", lambda table: (apply_schema_overrides(table, self.overrides), {"types": self.overrides})),
            ("df_deduplicated", "duplicates resolved", self._without_duplicates),
            ("df_scoped", "columns chosen", self._scoped),
            ("df_clean", "rules and missing values handled", self._cleaned),
            ("df_outlier_handled", "outliers handled", self._without_outliers),
            ("df_collinear_resolved", "related columns resolved", self._uncorrelated),
            ("df_final", "encoded and scaled", self._encoded),
        ]

    def _without_duplicates(self, table: DataFrame) -> tuple[DataFrame, dict[str, Any]]:
        if self.drop_exact_duplicates:
            table = resolve_duplicates(table, self.duplicate_strategy)
        if self.duplicate_keys:
            table = resolve_duplicates(
                table, self.duplicate_strategy, self.duplicate_keys, self.duplicate_order
            )
        return table, {"strategy": self.duplicate_strategy, "keys": self.duplicate_keys}

    def _scoped(self, table: DataFrame) -> tuple[DataFrame, dict[str, Any]]:
        scoped, _ = apply_scope_selection(table, self.columns, self.drop_zero_variance)
        return scoped, {"dropped": [c for c in table.columns if c not in scoped.columns]}

    def _cleaned(self, table: DataFrame) -> tuple[DataFrame, dict[str, Any]]:
        actions = {r.column: "convert_nan" for r in self.rules} | self.rule_actions
        table = apply_constraint_resolution(table, self.rules, actions)
        fitted = fit_imputation(table, self.imputation)
        names = ("column", "method", "fill_value", "values_imputed", "error")
        return fitted.apply(table), {"imputed": [dict(zip(names, row, strict=True)) for row in fitted.stats]}

    def _without_outliers(self, table: DataFrame) -> tuple[DataFrame, dict[str, Any]]:
        fitted = fit_outlier_treatment(
            table, self.outliers, self.outlier_method, self.outlier_threshold
        )
        return fitted.apply(table), {"actions": {c: o.get("action") for c, o in self.outliers.items()}}

    def _uncorrelated(self, table: DataFrame) -> tuple[DataFrame, dict[str, Any]]:
        choices = self._collinear_choices(table)
        resolved, _ = resolve_multicollinearity(table, choices, self.combine_formulas)
        return resolved, {"actions": choices}

    def _encoded(self, table: DataFrame) -> tuple[DataFrame, dict[str, Any]]:
        encoding = fit_encoding(table, self.encoding)
        if encoding.errors:
            raise ValueError(f"cannot encode: {encoding.errors}")
        table = encoding.apply(table)
        columns = []
        if self.scaling_method:
            columns = existing(table, self.scaling_columns or numeric_columns(table))
            table = fit_scaling(table, self.scaling_method, columns).apply(table)
        return table, {"encoded": list(self.encoding), "scaled": columns}

    def _collinear_choices(self, table: DataFrame) -> dict[str, str]:
        """The given actions, else the recommended drops among given columns."""
        if self.collinear_actions is not None:
            return self.collinear_actions
        if not self.collinear_columns or len(existing(table, self.collinear_columns)) < 2:
            return {}
        found = detect_multicollinearity(
            table, self.collinear_threshold, columns=self.collinear_columns
        )
        return {column: action for action, column, _ in found.recommendations}
