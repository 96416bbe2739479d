"""Run registry kept as parquet tables: runs, files, gaps, attempts, confidence baselines, metadata."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.errors import ContractError
from tapewright.operators.features import Market
from tapewright.session import cut_lineage

# Columns and key of each registry table.
SCHEMAS = {
    "runs": "run_id string, started_at_ms bigint, ended_at_ms bigint, config_hash string, app_version string, git_sha string, raw_enabled boolean, normalized_enabled boolean, clean_shutdown boolean, gap_count bigint",
    "files": "path string, event_type string, symbol string, start_ts_ms bigint, end_ts_ms bigint, rows bigint, bytes bigint, created_at_ms bigint, run_id string",
    "symbols": "symbol string, display_name string, first_seen_ms bigint, last_seen_ms bigint",
    "data_gaps": "gap_id string, run_id string, conn_id bigint, started_at_ns bigint, ended_at_ns bigint, reason string, affected_symbols array<string>, recovered boolean",
    "backfill_attempts": "attempt_id string, run_id string, gap_id string, source string, interval string, requested_start_ns bigint, requested_end_ns bigint, attempted_at_ms bigint, status string, rows_written bigint, confidence_impact string",
    "confidence_snapshots": "run_id string, snapshot_ts_ms bigint, symbol string, score int, level string, confidence_json string",
}
KEYS = {
    "runs": ["run_id"],
    "files": ["path"],
    "symbols": ["symbol"],
    "data_gaps": ["gap_id"],
    "backfill_attempts": ["attempt_id"],
    "confidence_snapshots": ["run_id", "snapshot_ts_ms", "symbol"],
}


class Registry:
    """Append-only tables under one folder; a key that exists already refuses the whole insert.

    Every insert is one commit: rows are written aside, the writer claims the next number of the table by creating a file that must
    not exist, and moves its rows to the folder of that number. Of two writers that saw the same table one gets the number and the other is
    refused; while a claim has no rows yet, inserts are refused too. Readers see whole commits only.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def read(self, table: str) -> DataFrame:
        """The table, empty where nothing was written yet; any other failure to read it is an error."""
        return self._read(table, self._numbers(table, "c="))

    def _read(self, table: str, commits: list[int]) -> DataFrame:
        if not commits:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*[f"{self.root}/{table}/c={n}" for n in commits])

    def _place(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _numbers(self, table: str, prefix: str) -> list[int]:
        fs, path = self._place(table)
        if not fs.exists(path):
            return []
        names = [n for n in (f.getPath().getName() for f in fs.listStatus(path)) if n[0] not in "._"]
        if strange := [n for n in names if not n.startswith(("c=", "claim="))]:
            raise ContractError(f"registry table {table} holds {strange[0]}, which is no commit")
        return sorted(int(name[len(prefix) :]) for name in names if name.startswith(prefix))

    def insert(self, table: str, rows: DataFrame) -> None:
        """All rows or none; refused where a key is known, or another writer committed or is about to."""
        commits, claims = self._numbers(table, "c="), self._numbers(table, "claim=")
        if set(claims) - set(commits):
            raise ContractError(f"registry table {table}: a commit is under way; nothing was written")
        key = KEYS[table]
        batch = rows.select(*[c.split()[0] for c in SCHEMAS[table].split(", ")])
        staged = f"_staged/{uuid.uuid4().hex}"
        batch.write.parquet(f"{self.root}/{staged}")
        written = self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{staged}")
        repeated = written.groupBy(*key).count().filter("count > 1").limit(1).count()
        known = written.join(self._read(table, commits).select(*key), key, "left_semi").limit(1).count()
        if repeated or known:
            self._drop(staged)
            raise ContractError(f"registry table {table}: a key is already registered; nothing was written")
        number = max(commits, default=0) + 1
        if not self._claim(table, number):
            self._drop(staged)
            raise ContractError(f"registry table {table}: another writer was first; nothing was written")
        fs, source = self._place(staged)
        _, target = self._place(f"{table}/c={number}")
        if not fs.rename(source, target):
            raise ContractError(f"registry table {table}: rows could not be moved into place; claim {number} is left")

    def _claim(self, table: str, number: int) -> bool:
        fs, path = self._place(f"{table}/claim={number}")
        try:
            fs.create(path, False).close()
        except Py4JJavaError:
            if fs.exists(path):
                return False
            raise
        return True

    def _drop(self, name: str) -> None:
        fs, path = self._place(name)
        fs.delete(path, True)

    def abandon(self, table: str) -> None:
        """Remove claims without rows, left by a writer that died."""
        for number in set(self._numbers(table, "claim=")) - set(self._numbers(table, "c=")):
            self._drop(f"{table}/claim={number}")

    def gaps(self, run_id: str) -> DataFrame:
        return self.read("data_gaps").filter(F.col("run_id") == run_id).orderBy("started_at_ns", "gap_id")

    def attempts(self, run_id: str, gap_id: str | None = None) -> DataFrame:
        rows = self.read("backfill_attempts").filter(F.col("run_id") == run_id)
        rows = rows if gap_id is None else rows.filter(F.col("gap_id") == gap_id)
        return rows.orderBy("attempted_at_ms", "attempt_id")

    def files(self, run_id: str) -> DataFrame:
        return self.read("files").filter(F.col("run_id") == run_id).orderBy("path")

    def confidence_at(self, run_id: str, at_ms: int) -> DataFrame:
        rows = self.read("confidence_snapshots")
        return rows.filter((F.col("run_id") == run_id) & (F.col("snapshot_ts_ms") == at_ms))

    def insert_confidence(self, run_id: str, at_ms: int, snapshots: DataFrame) -> None:
        rows = snapshots.select(
            F.lit(run_id).alias("run_id"),
            F.lit(at_ms).cast("long").alias("snapshot_ts_ms"),
            "symbol",
            F.col("confidence.score").alias("score"),
            F.col("confidence.level").alias("level"),
            F.to_json("confidence").alias("confidence_json"),
        )
        self.insert("confidence_snapshots", rows)


CONFIDENCE_TYPE = "struct<score:int,level:string,reasons:array<string>,incomplete_windows:array<string>>"


def stored_confidence(rows: DataFrame) -> DataFrame:
    return rows.select("symbol", F.from_json("confidence_json", CONFIDENCE_TYPE).alias("confidence"))


def verify_parity(registry: Registry, run_id: str, at_ms: int, snapshots: DataFrame) -> DataFrame:
    """First replay writes the baseline; later ones are compared with it."""
    from tapewright.operators import replay

    baseline = registry.confidence_at(run_id, at_ms)
    first = not baseline.limit(1).count()
    if first:
        registry.insert_confidence(run_id, at_ms, snapshots)
        baseline = registry.confidence_at(run_id, at_ms)
    report = replay.parity_report(stored_confidence(baseline), replay.confidence_of(snapshots))
    return report.withColumn("baseline_written", F.lit(first))


def registered_market(registry: Registry, run_id: str, retention_ms: int) -> Market:
    """The event tables of a run that was registered and ended cleanly, from its files, with the symbols of its open gaps."""
    from tapewright.operators import gaps, state
    from tapewright.operators.replay import check_run

    check_run(registry.read("runs"), run_id)
    paths: dict[str, list[str]] = {}
    for row in registry.files(run_id).select("path", "event_type").collect():  # a row per file of one run
        paths.setdefault(row["event_type"], []).append(row["path"])
    if not paths:
        raise ContractError(f"recording run '{run_id}' has no registered files")
    tables = {kind: registry.spark.read.parquet(*names) for kind, names in paths.items()}
    if "trades" not in tables or "quotes" not in tables:
        raise ContractError(f"recording run '{run_id}' lacks its trades or quotes")
    accepted = cut_lineage(state.dedup_trades(state.arrived_in_time(tables["trades"], retention_ms)))
    open_gaps = gaps.gap_symbols(registry.gaps(run_id), registry.attempts(run_id))
    others = {kind: tables.get(kind) for kind in ("quotes", "contexts", "mids", "books", "candles")}
    return Market(trades=state.keep_newest(accepted, retention_ms), duplicates=state.duplicate_counts(accepted), gap_symbols=open_gaps, **others)
