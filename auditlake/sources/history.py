"""Run history and audit log on Parquet.

The transforms (``latest_saves``, ``list_runs``, ``split_by_age`` ...) work on any DataFrame. ``RunHistory`` keeps
the tables in a folder all executors reach, each under a log of its files (see ``sources.tablelog``): a save adds
files, a read keeps the last save of each run_id, and files that saves of the same runs have filled are merged. A purge
rewrites the files that hold purged runs and no other. A change counts only when its version is in the log, so a job
lost half-way leaves the former state; any number of writers may save and purge at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.pii import DETECTORS
from auditlake.functions.redact import json_sensitive_values, redact_json
from auditlake.operators.reports import rounded_metrics
from auditlake.schemas import AUDIT_EVENTS, RECORDED_ATTEMPT, RUNS
from auditlake.session import checkpointed
from auditlake.sources.tablelog import Conflict, TableLog
from auditlake.sources.transcripts import redacted_artifacts

SUMMARY = ["run_id", "created_at", "agent_model", "judge_model", "pass_rate", "total_runs", "violations"]
RUN_COLUMNS = [*SUMMARY, "payload"]


# --- transforms ----------------------------------------------------------------------------


def latest_saves(saves: DataFrame, order: str = "saved_at", key: str = "run_id") -> DataFrame:
    """The last save of each run. Merged before the shuffle, so many saves of one run cost one row per task."""
    rest = [c for c in saves.columns if c != key]
    # Saves of the same instant are told apart by a hash of their content, whatever the partitioning.
    ranked = F.struct(order, F.xxhash64(*[c for c in rest if c != order]))
    return saves.groupBy(key).agg(F.max_by(F.struct(*rest), ranked).alias("r")).select(key, "r.*").select(*saves.columns)


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "run_id") -> DataFrame:
    """Stored rows with the incoming ones in place of those of the same key."""
    ranked = stored.withColumn("_save", F.lit(0)).unionByName(incoming.withColumn("_save", F.lit(1)))
    return latest_saves(ranked, "_save", key).drop("_save")


def list_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    """Summaries, newest first; runs of the same instant by run_id."""
    return runs.select(*[c for c in SUMMARY if c in runs.columns]).orderBy(F.desc("created_at"), "run_id").limit(limit)


def get_run(runs: DataFrame, run_id: str) -> DataFrame:
    """The stored run, or no row."""
    return runs.filter(F.col("run_id") == run_id)


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run, or no row."""
    return runs.orderBy(F.desc("created_at"), "run_id").limit(1)


def cutoff_literal(before: datetime) -> Column:
    """A cutoff as a column; one without a time zone is refused."""
    if before.tzinfo is None:
        raise ValueError("the retention cutoff must be timezone-aware")
    return F.lit(before.astimezone(UTC).isoformat()).cast("timestamp")


def split_by_age(runs: DataFrame, before: datetime) -> tuple[DataFrame, DataFrame]:
    """(kept, purged): purged runs were created before the cutoff; a run without a date is kept."""
    old = F.coalesce(F.col("created_at") < cutoff_literal(before), F.lit(False))
    return runs.filter(~old), runs.filter(old)


def retention_cutoff(days: int, now: datetime) -> datetime:
    """Cutoff of a retention of whole days, at least one."""
    if isinstance(days, bool) or not isinstance(days, int) or days < 1:
        raise ValueError("retention must be a whole number of days, at least 1")
    return now - timedelta(days=days)


def runs_with_tag(
    runs: DataFrame, run_scenarios: DataFrame, scenarios: DataFrame, tag: str, limit: int = 50, filter_first: bool = False
) -> DataFrame:
    """Listed runs with a scenario that now carries the tag.

    As in the listing it follows, the limit applies before the tag, unless ``filter_first``.
    ``run_scenarios``: distinct (run_id, scenario_id).
    """
    tagged = scenarios.filter(F.array_contains("tags", tag)).select("scenario_id")
    having = run_scenarios.join(tagged, "scenario_id", "left_semi").select("run_id")
    if filter_first:
        return list_runs(runs.join(having, "run_id", "left_semi"), limit)
    return list_runs(runs, limit).join(having, "run_id", "left_semi").orderBy(F.desc("created_at"), "run_id")


def redacted_payloads(runs: DataFrame, detectors: Iterable = DETECTORS) -> DataFrame:
    """Runs whose payload, JSON of any depth, is redacted by its own sensitive values and by the detectors."""
    own = runs.withColumn("_own", json_sensitive_values(F.col("payload")))
    return redact_json(own, "payload", "_own", detectors).select(*runs.columns)


def summarize_runs(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Rows for the history: summary columns taken from the run metrics, and all metrics as JSON payload.

    ``runs``: run_id, created_at, agent_model, judge_model. The attempts of a run are no part of its row, which
    would grow with the run; they are stored by ``transcripts.write_artifacts``.
    """
    shown = rounded_metrics(metrics)
    rows = shown.select(
        "run_id",
        "pass_rate",
        "total_runs",
        F.col("total_violations").alias("violations"),
        F.to_json(F.struct(*[c for c in shown.columns if c != "run_id"])).alias("payload"),
    )
    return runs.join(rows, "run_id", "left")


# --- audit events --------------------------------------------------------------------------


def sorted_json(details: Column) -> Column:
    """A map as a JSON object with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(details))))


def audit_rows(events: DataFrame, detectors=DETECTORS) -> DataFrame:
    """Audit rows ready to append: details redacted. ``events``: event_id, created_at, event_type, details (JSON)."""
    return redact_json(events.select("event_id", "created_at", "event_type", "details"), "details", None, detectors)


def list_audit_events(events: DataFrame, limit: int = 100) -> DataFrame:
    """Newest first, details parsed into a map."""
    return (
        events.orderBy(F.desc("created_at"), F.desc("event_id"))
        .limit(limit)
        .withColumn("details", F.from_json("details", "map<string,string>"))
    )


# --- storage -------------------------------------------------------------------------------


ATTEMPTS = f"{RECORDED_ATTEMPT}, saved_at timestamp"
SAVES = f"{RUNS}, saved_at timestamp"


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """The attempts of the last save of each run."""
    last = attempts.groupBy("run_id").agg(F.max("saved_at").alias("saved_at"))
    return attempts.join(last, ["run_id", "saved_at"], "left_semi")


class RunHistory:
    """Runs, their attempts and audit events under one folder."""

    def __init__(self, spark: SparkSession, root: str, detectors: Iterable = DETECTORS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.detectors = tuple(detectors)
        self.run_log = TableLog(spark, f"{self.root}/runs", SAVES, "run_id", "created_at")
        self.attempt_log = TableLog(spark, f"{self.root}/attempts", ATTEMPTS, "run_id", "saved_at", ["scenario_id", "attempt"])

    def runs(self) -> DataFrame:
        """The current runs, payload included."""
        return self._current(RUN_COLUMNS)

    def summaries(self) -> DataFrame:
        """The current runs without their payload, which is not read."""
        return self._current(SUMMARY)

    def _current(self, columns: list[str]) -> DataFrame:
        return latest_saves(self.run_log.read().select(*columns, "saved_at")).drop("saved_at")

    def get_run(self, run_id: str) -> DataFrame:
        """The stored run, or no row; read from the files of its bucket that may hold it."""
        return latest_saves(self.run_log.of_key(run_id)).select(*RUN_COLUMNS)

    def get_attempts(self, run_id: str) -> DataFrame:
        """The stored attempts of a run with turns, check results and usage, as they were last saved."""
        return latest_attempts(self.attempt_log.of_key(run_id)).drop("saved_at")

    def attempts(self) -> DataFrame:
        """The attempts of all runs."""
        return latest_attempts(self.attempt_log.read()).drop("saved_at")

    def save(
        self, runs: DataFrame, saved_at: datetime, retention_days: int | None = None, redact: bool = True, save_id: str | None = None
    ) -> int:
        """Add runs (schema RUNS). Returns how many runs the retention removed.

        Payloads are redacted, each by the sensitive values in it, unless ``redact`` is off. ``save_id`` names the save:
        when one of that name comes again, for instance a batch that is delivered twice, it adds no audit event.
        """
        if redact:
            runs = redacted_payloads(runs, self.detectors)
        stamp = cutoff_literal(saved_at)
        added = self.run_log.append(runs.select(*RUN_COLUMNS).withColumn("saved_at", stamp))
        # Read back, so that the runs are computed once.
        saved = self.run_log.open([f["path"] for f in added]).select(
            F.concat(F.lit("run_saved:"), "run_id", F.lit(":"), F.lit(save_id) if save_id else stamp.cast("string")).alias("event_id"),
            stamp.alias("created_at"),
            F.lit("run_saved").alias("event_type"),
            F.to_json(F.struct("agent_model", "run_id")).alias("details"),
        )
        if save_id:
            saved = saved.join(self.audit_events().filter("event_type = 'run_saved'").select("event_id"), "event_id", "left_anti")
        self.append_audit(saved)
        self.run_log.compact(sorted({f["bucket"] for f in added}), latest_saves)
        if retention_days is None:
            return 0
        return self._purge(retention_cutoff(retention_days, saved_at), saved_at, "runs_retention_purged", {})

    def save_attempts(self, recorded: DataFrame, saved_at: datetime, redact: bool = True) -> None:
        """Store the attempts of runs (as ``transcripts.read_recorded`` gives them), redacted each run by its own values.

        Attempts stored before for the same runs are replaced.
        """
        rows = redacted_artifacts(recorded, self.detectors) if redact else recorded
        columns = self.attempt_log.open([]).drop("saved_at").columns
        added = self.attempt_log.append(rows.select(*columns).withColumn("saved_at", cutoff_literal(saved_at)))
        self.attempt_log.compact(sorted({f["bucket"] for f in added}), latest_attempts)

    def purge(self, before: datetime, now: datetime) -> int:
        """Remove runs created before the cutoff, with their attempts, and return their number."""
        cutoff_literal(before)
        return self._purge(before, now, "runs_purged", {"before": before.isoformat()})

    def _purge(self, before: datetime, now: datetime, event_type: str, details: dict) -> int:
        count = self._retried(lambda: self._purge_runs(before))
        if not count:
            return 0
        stamp = now.astimezone(UTC).isoformat()
        row = self.spark.range(1).select(
            F.lit(f"{event_type}:{stamp}").alias("event_id"),
            cutoff_literal(now).alias("created_at"),
            F.lit(event_type).alias("event_type"),
            F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted({**details, "count": count}.items())])).alias("details"),
        )
        self.append_audit(row)
        return count

    def _retried(self, change: Callable[[], int], tries: int = 10) -> int:
        """A change of files, begun anew when another writer replaced one of them first."""
        for _ in range(tries - 1):
            try:
                return change()
            except Conflict:
                pass
        return change()

    def _purge_runs(self, before: datetime) -> int:
        """Runs whose last save is older go, with all their saves; only files that hold one are rewritten or dropped."""
        files = self.run_log.live()
        old = files.filter(F.col("least_time") < cutoff_literal(before))
        paths = [r.path for r in old.select("path").collect()]
        if not paths:
            return 0
        everything = [r.path for r in files.select("path").collect()]
        # Only ids and times are read, and of files without an old save only the runs that have one.
        narrow = self.run_log.open(everything, place=True).select("run_id", "created_at", "saved_at", "at")
        suspects = self.run_log.open(paths).filter(F.col("created_at") < cutoff_literal(before)).select("run_id").distinct()
        saves = narrow.join(suspects, "run_id", "left_semi")
        purged = checkpointed(split_by_age(latest_saves(saves.drop("at")), before)[1].select("run_id"))
        count = purged.count()
        if not count:
            return 0
        self._without(self.run_log, saves, purged, latest_saves)
        attempts = [r.path for r in self.attempt_log.live().select("path").collect()]
        self._without(self.attempt_log, self.attempt_log.open(attempts, place=True).select("run_id", "at"), purged, latest_attempts)
        return count

    def _without(self, log: TableLog, rows: DataFrame, purged: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the files that hold a purged run by files without them. ``rows`` has run_id and the file, ``at``."""
        touched = [r.at for r in rows.join(purged, "run_id", "left_semi").select("at").distinct().collect()]
        if touched:
            log.replace(touched, keep(log.open(touched).join(purged, "run_id", "left_anti")))

    def append_audit(self, events: DataFrame) -> None:
        """Append audit events; details are redacted here."""
        audit_rows(events, self.detectors).write.mode("append").parquet(f"{self.root}/audit_events")

    def audit_events(self) -> DataFrame:
        if not self.run_log._fs().exists(self.run_log._path(f"{self.root}/audit_events")):
            return self.spark.createDataFrame([], AUDIT_EVENTS)
        return self.spark.read.schema(AUDIT_EVENTS).parquet(f"{self.root}/audit_events")
