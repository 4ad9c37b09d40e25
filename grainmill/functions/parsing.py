"""Text parsing tests and null-on-failure casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The pairs of words that make a text column boolean.
BOOLEAN_PAIRS = [
    ("true", "false"),
    ("yes", "no"),
    ("y", "n"),
    ("1", "0"),
    ("t", "f"),
]
TRUE_WORDS = [pair[0] for pair in BOOLEAN_PAIRS]
FALSE_WORDS = [pair[1] for pair in BOOLEAN_PAIRS]

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
ISO_DATE_PATTERN = r"^\s*\d{4}(-\d{1,2}(-\d{1,2}([ T]\d{1,2}:\d{2}.*)?)?)?\s*$"
# Layouts tried after ISO 8601: dates, each alone or with one of the times.
DATE_LAYOUTS = {
    r"\d{4}/\d{1,2}/\d{1,2}": "y/M/d",
    r"\d{1,2}/\d{1,2}/\d{4}": "M/d/y",
    r"\d{1,2}\.\d{1,2}\.\d{4}": "d.M.y",
    r"\d{1,2}-\d{1,2}-\d{4}": "M-d-y",
    r"(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])": "yyyyMMdd",
    r"[A-Z][a-z]{2} \d{1,2}, \d{4}": "MMM d, y",
    r"[A-Z][a-z]{3,} \d{1,2}, \d{4}": "MMMM d, y",
    r"\d{1,2} [A-Z][a-z]{2} \d{4}": "d MMM y",
    r"\d{1,2} [A-Z][a-z]{3,} \d{4}": "d MMMM y",
    r"\d{1,2}-[A-Z][a-z]{2}-\d{4}": "d-MMM-y",
}
TIME_LAYOUTS = {
    "": "",
    r" \d{1,2}:\d{2}": " H:m",
    r" \d{1,2}:\d{2}:\d{2}": " H:m:s",
    r" \d{1,2}:\d{2} [AP]M": " h:m a",
    r" \d{1,2}:\d{2}:\d{2} [AP]M": " h:m:s a",
}
# No date with a time is longer, white space around it not counted.
LONGEST_DATE = 128
# Month first and day first look alike above; day first where the month would be above 12.
DAY_FIRST = {"M/d/y": "d/M/y", "M-d-y": "d-M-y"}


def to_number(c: Column) -> Column:
    """Text as a double, NULL where it is not a plain number."""
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def _separator(layout: str) -> str:
    """The mark that every text of a date layout holds, '' if there is none."""
    return next((mark for mark in "/.-, " if mark in layout), "")


def to_datetime(c: Column) -> Column:
    """Text as a timestamp without zone, NULL where no known layout fits.

    Cheap tests come first: the length, the first character and the separator
    rule most texts out before any pattern is tried.
    """
    text = F.trim(c)
    parsed = F.when(c.rlike(ISO_DATE_PATTERN), text.try_cast("timestamp_ntz"))
    for date_pattern, date in DATE_LAYOUTS.items():
        found = None
        for time_pattern, time in TIME_LAYOUTS.items():
            layouts = [date + time] + ([DAY_FIRST[date] + time] if date in DAY_FIRST else [])
            value = F.coalesce(*[F.try_to_timestamp(text, F.lit(x)) for x in layouts])
            fits = c.rlike(rf"^\s*{date_pattern}{time_pattern}\s*$")
            found = F.when(fits, value) if found is None else found.when(fits, value)
        # One test by the date before those with each time.
        begins = c.rlike(rf"^\s*{date_pattern}")
        mark = _separator(date)
        parsed = parsed.when(F.contains(c, F.lit(mark)) & begins if mark else begins, found.cast("timestamp_ntz"))
    first = F.ascii(F.ltrim(c))
    possible = first.between(48, 57) | first.between(65, 90) | first.between(9, 13)
    # White space around a date may be of any length.
    short = F.char_length(c) <= LONGEST_DATE
    return F.when(possible & (short | (F.char_length(text) <= LONGEST_DATE) | c.rlike(r"^\s|\s$")), parsed)


def to_boolean(c: Column) -> Column:
    """Any of the boolean words as a boolean, NULL for everything else."""
    word = F.lower(c.cast("string"))
    return F.when(word.isin(TRUE_WORDS), F.lit(True)).when(
        word.isin(FALSE_WORDS), F.lit(False)
    )


def cast_expression(c: Column, source: T.DataType, target: str) -> Column:
    """Cast to the target type, NULL where a value does not convert."""
    text = isinstance(source, T.StringType)
    number = to_number(c) if text else c.try_cast("double")
    if target in ("datetime", "datetime64[ns]", "timestamp_ntz"):
        if text:
            return to_datetime(c)
        return c.try_cast("timestamp_ntz")
    if target in ("string", "category"):
        return c.cast("string")
    if target in ("boolean", "bool"):
        return to_boolean(c)
    if target in ("int64", "int32", "bigint", "int"):
        spark_type = "int" if target in ("int32", "int") else "bigint"
        if isinstance(source, T.IntegralType):
            return c.try_cast(spark_type)
        if text:
            # Whole numbers written without a fraction keep all 19 digits.
            plain = F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).try_cast(spark_type))
            return F.coalesce(
                plain, F.when(number == F.floor(number), number.try_cast(spark_type))
            )
        return F.when(number == F.floor(number), number.try_cast(spark_type))
    if target == "float64":
        return number
    if target == "float32":
        return number.try_cast("float")
    return c.try_cast(target)
