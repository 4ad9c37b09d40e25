"""Data rules: structured conditions, their violations and what to do about them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions.columns import DATETIME_TYPES, col, plain_columns, tidy

COMPARISONS = {
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}
ACTIONS = ("drop_row", "convert_nan", "flag_retain")
FLAG_SUFFIX = "_constraint_violation"
SAMPLES = 10


@dataclass(frozen=True)
class Rule:
    """A condition that the values of ``column`` should meet.

    ``op`` is a comparison with ``value`` or with column ``other``, or ``in``
    with a list as ``value``. Instead, ``predicate`` may hold a SQL condition.
    """

    column: str
    op: str | None = None
    value: Any = None
    other: str | None = None
    predicate: str | None = None

    @property
    def label(self) -> str:
        if self.predicate:
            return self.predicate
        return f"{self.column} {self.op} {self.other if self.other else self.value}"


class RuleError(ValueError):
    """The rule cannot be applied to this table."""


def _constant(value: Any, dtype: T.DataType) -> Column:
    """The constant in the type of the column it is compared with."""
    if isinstance(dtype, T.NumericType):
        if isinstance(value, (int, float)):
            return F.lit(value)
        text = str(value).strip()
        try:
            float(text)
        except ValueError:
            raise RuleError(f"not a number: {value!r}") from None
        # Whole numbers and plain decimals keep all their digits.
        if re.fullmatch(r"[+-]?\d{1,18}", text):
            return F.lit(int(text))
        if re.fullmatch(r"[+-]?\d+(\.\d*)?", text) and len(text) <= 38:
            return F.lit(Decimal(text))
        return F.lit(float(text))
    if isinstance(dtype, T.StringType):
        return F.lit(str(value))
    if isinstance(dtype, DATETIME_TYPES):
        return F.lit(str(value)).cast(dtype)
    if isinstance(dtype, T.BooleanType) and isinstance(value, bool):
        return F.lit(value)
    raise RuleError(f"cannot compare {dtype.simpleString()} with {value!r}")


def violation(df: DataFrame, rule: Rule) -> Column:
    """True where the rule is broken, never NULL.

    A missing value breaks every comparison and every list test except
    ``!=``, and it breaks a free predicate.
    """
    if rule.column not in df.columns:
        raise RuleError(f"no such column: {rule.column}")
    c = col(rule.column)
    dtype = df.schema[rule.column].dataType
    if rule.predicate:
        met, if_missing = F.expr(rule.predicate), False
    elif rule.op == "in":
        if not isinstance(rule.value, (list, tuple, set)):
            raise RuleError("'in' needs a list of values")
        if any(v is None for v in rule.value):
            raise RuleError("a missing value cannot be in the list of 'in'")
        met, if_missing = c.isin(*[_constant(v, dtype) for v in rule.value]), False
    elif rule.op in COMPARISONS:
        if rule.other is not None:
            if rule.other not in df.columns:
                raise RuleError(f"no such column: {rule.other}")
            operand = col(rule.other)
        else:
            operand = _constant(rule.value, dtype)
        met, if_missing = COMPARISONS[rule.op](c, operand), rule.op == "!="
    else:
        raise RuleError(f"no such operator: {rule.op}")
    broken = ~F.coalesce(met, F.lit(if_missing))
    try:
        if not isinstance(df.select(broken.alias("b")).schema["b"].dataType, T.BooleanType):
            raise RuleError("not a condition")
    except AnalysisException as error:
        raise RuleError(f"cannot apply rule: {error.getCondition()}") from None
    return broken


def _split(df: DataFrame, rules: list[Rule]):
    """Violation column or error text per rule, in the given order."""
    checked = []
    for rule in rules:
        try:
            checked.append((rule, violation(df, rule), None))
        except RuleError as error:
            checked.append((rule, None, str(error)))
    return checked


def validate_constraints(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Number of violations per rule, or why the rule could not be applied."""
    checked = _split(df, rules)
    aggs = [F.count("*").alias("rows")]
    aggs += [F.count_if(v).alias(f"v{i}") for i, (_, v, _) in enumerate(checked) if v is not None]
    return tidy(
        df.agg(*aggs),
        [
            {
                "rule_no": F.lit(i + 1).cast("bigint"),
                "column": F.lit(rule.column),
                "rule": F.lit(rule.label),
                "violation_count": F.lit(None).cast("bigint") if v is None else F.col(f"v{i}"),
                "error": F.lit(error).cast("string"),
            }
            for i, (rule, v, error) in enumerate(checked)
        ],
    )


def constraint_totals(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row: violations of all rules, columns that break a rule, bad rules."""
    checked = validate_constraints(df, rules)
    broken = F.when(F.col("violation_count") > 0, F.col("column"))
    return checked.agg(
        F.coalesce(F.sum("violation_count"), F.lit(0)).cast("bigint").alias("total_violations"),
        F.count_distinct(broken).alias("columns_with_violations"),
        F.count("error").alias("rule_errors"),
    )


def constraint_samples(
    df: DataFrame, rule: Rule, order_by: list[str], n: int = SAMPLES
) -> DataFrame:
    """The first ``n`` rows that break a rule."""
    broken = df.where(violation(df, rule))
    rest = [c for c in plain_columns(df) if c not in order_by]
    return broken.orderBy(*[col(c).asc_nulls_first() for c in [*order_by, *rest]]).limit(n)


def _with_violations(df: DataFrame, rules: list[Rule], actions: dict[str, str]):
    """Add one ``_broken_i`` column per rule, evaluated on the table as it is then."""
    flagged: dict[str, str] = {}
    marks, dropping, actions_used, errors = [], [], [], []
    for i, rule in enumerate(rules):
        action = actions.get(rule.column, "flag_retain")
        if action not in ACTIONS:
            raise ValueError(f"action must be one of {ACTIONS}, not {action!r}")
        try:
            broken = violation(df, rule)
        except RuleError as error:
            errors.append((i, rule, str(error)))
            continue
        mark = f"_broken_{i}"
        df = df.withColumn(mark, broken)
        marks.append((i, rule, action, mark))
        actions_used.append(action)
        if action == "drop_row":
            dropping.append(mark)
        elif action == "convert_nan":
            df = df.withColumn(rule.column, F.when(~F.col(mark), col(rule.column)))
        else:
            name = rule.column + FLAG_SUFFIX
            value = F.col(mark)
            if name in flagged:
                value = value | col(name)
            df = df.withColumn(name, value)
            flagged[name] = mark
    return df, marks, dropping, errors


def _any_mark(marks: list[str]) -> Column:
    result = F.lit(False)
    for m in marks:
        result = result | F.col(m)
    return result


def apply_constraint_resolution(
    df: DataFrame, rules: list[Rule], actions: dict[str, str]
) -> DataFrame:
    """Drop, blank or flag what breaks the rules, taken in order.

    A later rule sees the blanked values of an earlier one; rows are dropped at
    the end. A flag column is added even if nothing breaks the rule.
    """
    marked, marks, dropping, _ = _with_violations(df, rules, actions)
    if dropping:
        marked = marked.where(~_any_mark(dropping))
    return marked.drop(*[m for *_, m in marks])


def constraint_resolution_stats(
    df: DataFrame, rules: list[Rule], actions: dict[str, str]
) -> DataFrame:
    """Cells or rows affected per rule and rows dropped in total."""
    marked, marks, dropping, errors = _with_violations(df, rules, actions)
    aggs = [F.count_if(_any_mark(dropping)).alias("dropped")]
    aggs += [F.count_if(F.col(m)).alias(m) for *_, m in marks]
    rows = [
        (i, {
            "rule_no": F.lit(i + 1).cast("bigint"),
            "column": F.lit(rule.column),
            "action": F.lit(action),
            "affected": F.col(m),
            "total_rows_dropped": F.col("dropped"),
            "error": F.lit(None).cast("string"),
        })
        for i, rule, action, m in marks
    ]
    rows += [
        (i, {
            "rule_no": F.lit(i + 1).cast("bigint"),
            "column": F.lit(rule.column),
            "action": F.lit(None).cast("string"),
            "affected": F.lit(None).cast("bigint"),
            "total_rows_dropped": F.col("dropped"),
            "error": F.lit(text),
        })
        for i, rule, text in errors
    ]
    return tidy(marked.agg(*aggs), [r for _, r in sorted(rows, key=lambda x: x[0])])
