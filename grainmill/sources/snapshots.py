"""Versioned, branchable snapshots of tables on shared storage.

Each commit is a Parquet folder that never changes. A manifest folder beside
it holds one row per commit. A commit claims its number on the branch by a new
file below ``claims``, so of two at the same time one is refused.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions.columns import col, quoted

MAIN = "main"
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("branch", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("data_hash", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("col_count", T.IntegerType()),
        T.StructField("config_snapshot", T.StringType()),
        T.StructField("delta_summary", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField(
            "forked_from",
            T.StructType(
                [
                    T.StructField("branch", T.StringType()),
                    T.StructField("state_id", T.StringType()),
                ]
            ),
        ),
    ]
)


class StateNotFoundError(LookupError):
    """There is no such snapshot."""


class ConcurrentCommitError(RuntimeError):
    """Another commit has taken the place of this one on its branch."""


def fingerprint(df: DataFrame, portable: bool = False) -> DataFrame:
    """One row: number of rows and a hash that does not depend on their order.

    Row hashes are added up, so repeated rows count. They tell apart any two
    values of a column, a missing one included, and the columns they are in.
    With ``portable`` a row is hashed as a text that other engines can make: of
    each value its length in bytes, a colon and the value (fractions in their
    shortest exact form, times with six digits), ``~`` for a missing one.
    """
    return df.agg(*_fingerprint_aggregates(df, portable))


def canonical_text(df: DataFrame, name: str) -> Column:
    """A value as a text that no other value of its type has."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col(name), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(dtype, T.BinaryType):
        return F.hex(col(name))
    if isinstance(dtype, (T.ArrayType, T.StructType)):
        return F.to_json(F.struct(col(name)))
    return col(name).cast("string")


def _fingerprint_aggregates(df: DataFrame, portable: bool = False) -> list[Column]:
    names = [c for c, t in df.dtypes if "map<" not in t]
    if portable:
        texts = [canonical_text(df, c) for c in names]
        parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("~")) for t in texts]
        # The first 15 hex digits of the md5.
        number = F.conv(F.substring(F.md5(F.concat(F.lit(""), *parts)), 1, 15), 16, 10)
    else:
        # A missing value does not change a running hash, so which are missing is hashed too.
        missing = [F.when(col(c).isNull(), F.lit(i)) for i, c in enumerate(names)]
        number = F.xxhash64(F.array_compact(F.array(F.lit(-1), *missing)), *[col(c) for c in names])
    total = F.sum(number.cast("decimal(38,0)"))
    return [
        F.count("*").alias("row_count"),
        F.coalesce(total, F.lit(0)).cast("string").alias("row_hash_sum"),
    ]


class SnapshotStore:
    """Snapshots below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    @property
    def manifest_path(self) -> str:
        return f"{self.root}/manifest"

    def _manifest_exists(self) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.manifest_path)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return system.exists(path)

    def manifest(self) -> DataFrame:
        if not self._manifest_exists():
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(self.manifest_path)

    def _add(self, record: tuple) -> None:
        # Constants over one generated row: one small file, no Python worker.
        values = []
        for value, field in zip(record, MANIFEST_SCHEMA.fields):
            if isinstance(value, tuple):
                branch, state_id = map(F.lit, value)
                value = F.struct(branch.alias("branch"), state_id.alias("state_id"))
            values.append(F.lit(value).cast(field.dataType).alias(field.name))
        row = self.spark.range(0, 1, 1, 1).select(*values)
        row.write.mode("append").parquet(self.manifest_path)

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _claim(self, branch: str, seq: int) -> str:
        """A new file that only one commit can make; it stays once the commit is in the manifest."""
        path = f"{self.root}/claims/{branch}/{seq:06d}"
        files, place = self._files(path)
        files.mkdirs(place.getParent())
        if not files.createNewFile(place):
            raise ConcurrentCommitError(
                f"commit {seq} of branch {branch!r} is taken; if its writer has died, remove {path}"
            )
        return path

    def _give_up(self, claim: str) -> None:
        files, place = self._files(claim)
        files.delete(place, False)

    def _last(self, branch: str):
        rows = self.manifest().where(F.col("branch") == branch)
        return rows.orderBy(F.col("seq").desc()).first()

    def _record(self, branch: str, state_id: str):
        """The latest commit of a state; an earlier one stays readable by path."""
        rows = self.manifest().where((F.col("branch") == branch) & (F.col("id") == state_id))
        found = rows.orderBy(F.col("seq").desc()).first()
        if found is None:
            raise StateNotFoundError(f"no state {state_id!r} on branch {branch!r}")
        return found

    def commit(
        self,
        state_id: str,
        df: DataFrame,
        config: dict[str, Any] | None = None,
        summary: str = "",
        branch: str = MAIN,
    ) -> DataFrame:
        """Write a snapshot, add it to the branch and return the stored table."""
        last = self._last(branch)
        if last is None and branch != MAIN:
            raise StateNotFoundError(f"no branch {branch!r}")
        seq = last["seq"] + 1 if last else 0
        claim = self._claim(branch, seq)
        try:
            return self._write(state_id, df, config, summary, branch, seq, last["id"] if last else None)
        except BaseException:
            self._give_up(claim)
            raise

    def _write(
        self, state_id: str, df: DataFrame, config: dict[str, Any] | None, summary: str, branch: str, seq: int, parent: str | None
    ) -> DataFrame:
        # A folder of a commit that failed is in no manifest row and is never met again.
        path = f"{self.root}/data/{branch}/{seq:06d}_{state_id}_{uuid.uuid4().hex[:12]}"
        # Counted and hashed while it is written: the table is computed once.
        seen = Observation()
        df.observe(seen, *_fingerprint_aggregates(df)).write.parquet(path)
        mark = seen.get
        stored = self.spark.read.schema(df.schema).parquet(path)
        self._add(
            (
                branch,
                seq,
                state_id,
                parent,
                datetime.now(timezone.utc),
                mark["row_hash_sum"],
                mark["row_count"],
                len(stored.columns),
                json.dumps(config or {}, default=str),
                summary,
                path,
                None,
            )
        )
        return stored

    def load(self, state_id: str, branch: str = MAIN) -> DataFrame:
        return self.spark.read.parquet(self._record(branch, state_id)["path"])

    def current_id(self, branch: str = MAIN) -> str | None:
        last = self._last(branch)
        return last["id"] if last else None

    def current(self, branch: str = MAIN) -> DataFrame | None:
        last = self._last(branch)
        return self.spark.read.parquet(last["path"]) if last else None

    def create_branch(self, name: str, fork_from: str, source: str = MAIN) -> None:
        """Start a branch at a state of another one; no data is copied."""
        if self._last(name) is not None:
            raise ValueError(f"there is a branch {name!r} already")
        origin = self._record(source, fork_from)
        self._claim(name, 0)
        self._add(
            (
                name,
                0,
                fork_from,
                None,
                datetime.now(timezone.utc),
                origin["data_hash"],
                origin["row_count"],
                origin["col_count"],
                origin["config_snapshot"],
                f"branched off {fork_from} of {source}",
                origin["path"],
                (source, fork_from),
            )
        )

    def history(self, branch: str = MAIN) -> DataFrame:
        return self.manifest().where(F.col("branch") == branch).orderBy("seq")

    def branch_summary(self) -> DataFrame:
        """Per branch: number of states and the last one's size and time."""
        last = F.max_by(F.struct("id", "row_count", "col_count", "timestamp"), "seq")
        return (
            self.manifest()
            .groupBy("branch")
            .agg(F.count("*").alias("states"), last.alias("last"))
            .select(
                "branch",
                "states",
                F.col("last.id").alias("terminal_state"),
                F.col("last.row_count").alias("row_count"),
                F.col("last.col_count").alias("col_count"),
                F.col("last.timestamp").alias("last_modified"),
            )
        )

    def compare_branches(self, a: str, b: str, state_id: str) -> DataFrame:
        return compare_tables(self.load(state_id, a), self.load(state_id, b))

    def export(self, folder: str, branch: str = MAIN, raw_state: str = "df_raw") -> None:
        """Raw table as Parquet, manifest and last configuration as JSON."""
        target = folder.rstrip("/")
        try:
            self.load(raw_state).write.parquet(f"{target}/{raw_state}")
        except StateNotFoundError:
            pass
        manifest = self.manifest().coalesce(1)
        manifest.write.option("ignoreNullFields", False).json(f"{target}/manifest")
        last = self.history(branch).select(F.max_by("config_snapshot", "seq").alias("value"))
        last.coalesce(1).write.text(f"{target}/config")


def compare_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: sizes of two tables and the columns they share or not."""
    left, right = set(a.columns), set(b.columns)
    counted = a.select(F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(
        b.select(F.lit(0).alias("x"), F.lit(1).alias("y"))
    )
    names = {
        "columns_only_in_a": left - right,
        "columns_only_in_b": right - left,
        "common_columns": left & right,
    }
    return counted.agg(
        F.coalesce(F.sum("x"), F.lit(0)).cast("bigint").alias("rows_a"),
        F.coalesce(F.sum("y"), F.lit(0)).cast("bigint").alias("rows_b"),
    ).select(
        "rows_a",
        "rows_b",
        F.lit(len(left)).cast("bigint").alias("cols_a"),
        F.lit(len(right)).cast("bigint").alias("cols_b"),
        *[F.lit(",".join(sorted(v))).alias(k) for k, v in names.items()],
    )


def row_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has more often, with the side and how many more.

    One shuffle for both directions; equal rows are counted before it.
    """
    columns = list(a.columns)
    tagged = a.select(*[col(c) for c in columns], F.lit(1).alias("_side")).unionByName(
        b.select(*[col(c) for c in columns], F.lit(-1).alias("_side"))
    )
    surplus = tagged.groupBy(*map(quoted, columns)).agg(F.sum("_side").alias("_surplus"))
    return surplus.where("_surplus != 0").select(
        *[col(c) for c in columns],
        F.when(F.col("_surplus") > 0, "only_in_a").otherwise("only_in_b").alias("side"),
        F.abs("_surplus").alias("n"),
    )
