"""The training loop as jobs: ingest → validate → preprocess → train → evaluate → register → promote.

Each step reads what the former one landed and writes its own output, so a lost executor
costs a task and a failed driver costs a step. Registry, runs and step results are
append-only tables; a run folder is written once.
"""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelkeel.functions.ids import data_hash
from modelkeel.operators import gate, quality, registry, split
from modelkeel.schema import columns
from modelkeel.session import small_table
from modelkeel.sources import layout as names
from modelkeel.sources.datasets import append_step_result, read_dataset, write_dataset
from modelkeel.sources.layout import Layout
from modelkeel.spec import ModelSpec, UseCase

_TEXT_MAP = T.MapType(T.StringType(), T.StringType())
RUNS = columns(
    run_id="string", use_case="string", model="string", ts="timestamp", params=_TEXT_MAP,
    metrics=T.MapType(T.StringType(), T.DoubleType()), tags=_TEXT_MAP,
)


class NothingToRollBack(LookupError):
    """The registry names no previous champion."""


@dataclass
class Run:
    """One run of one model; ``key`` names the columns that identify a raw row, if any."""

    spark: SparkSession
    use_case: UseCase
    model: str
    run_id: str
    root: str
    seed: int = 42
    key: tuple[str, ...] = ()
    git_commit: str = "unknown"

    @property
    def spec(self) -> ModelSpec:
        if self.model not in self.use_case.models:
            raise KeyError(f"unknown model {self.model!r}; {self.use_case.name} has {sorted(self.use_case.models)}")
        return self.use_case.models[self.model]

    @property
    def layout(self) -> Layout:
        return Layout(self.root, self.use_case.name)

    @property
    def registered(self) -> str:
        return f"{self.use_case.name}-{self.model}"

    def path(self, name: str) -> str:
        return self.layout.dataset(self.model, self.run_id, name)

    def read(self, name: str) -> DataFrame:
        return read_dataset(self.spark, self.path(name))

    def table(self, name: str, schema: T.StructType) -> DataFrame:
        """An append-only table; empty while nothing was appended."""
        try:
            return self.spark.read.schema(schema).parquet(self.layout.table(name))
        except AnalysisException as failure:
            if failure.getCondition() != "PATH_NOT_FOUND":
                raise
            return small_table(self.spark, [], schema)

    def append(self, name: str, rows: list[tuple], schema: T.StructType) -> None:
        frame = self.spark.createDataFrame(rows, schema)
        frame.coalesce(1).write.mode("append").parquet(self.layout.table(name))

    def done(self, step: str, **result) -> dict:
        append_step_result(self.spark, self.layout.table("step_results"), self.run_id, step, result)
        return result


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def ingest(run: Run, *, profile: str | None = None, rows: int | None = None) -> dict:
    """Land the raw frame; count and content hash are taken from what was landed."""
    frame = run.use_case.ingest(run.spark, run.model, profile=profile, seed=run.seed, rows=rows)
    uri = write_dataset(frame, run.path(names.RAW))
    summary = data_hash(run.read(names.RAW)).first()
    return run.done(
        "ingest", raw_uri=uri, rows=summary["rows"], columns=frame.columns, data_hash=summary["data_hash"],
        profile=profile or "default",
    )


def validate(run: Run) -> dict:
    """The quality gate: records its result, then raises when anything is wrong."""
    raw = run.read(names.RAW)
    found = quality.check_frame(raw, run.use_case.schema(run.model))
    result = run.done("validate", ok=not found, violations=found, rows=raw.count())
    if found:
        raise quality.QualityGateFailed(found)
    return result


_ROW = "_row"
#: The id of the writing job inside a part file's name.
JOB_ID = "-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"


def _with_row_key(run: Run, raw: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows of a landed data set are identified by file and position, unless columns do it.

    Landed files never change, so the key is stable; equal rows still get different keys. The
    job id inside a file name is left out, so landing the same rows again gives the same keys.
    """
    if run.key:
        return raw, list(run.key)
    part = F.regexp_replace(F.col("_metadata.file_name"), JOB_ID, "")
    position = F.concat_ws("#", part, F.col("_metadata.row_index").cast("string"))
    return raw.withColumn(_ROW, position), [_ROW]


def preprocess(
    run: Run, *, holdout_ratio: float = split.HOLDOUT_RATIO, reference_rows: int = split.REFERENCE_ROWS
) -> dict:
    """Split into train and holdout, and freeze the reference next to them."""
    keyed, key = _with_row_key(run, run.read(names.RAW))
    train, holdout = split.train_holdout(keyed, run.spec.target, key, seed=run.seed, ratio=holdout_ratio)
    reference = split.frozen_sample(train, key, reference_rows, seed=run.seed)
    uris = {
        f"{name}_uri": write_dataset(frame.drop(_ROW), run.path(name))
        for name, frame in ((names.TRAIN, train), (names.HOLDOUT, holdout), (names.REFERENCE, reference))
    }
    return run.done(
        "preprocess", **uris, train_rows=run.read(names.TRAIN).count(), holdout_rows=run.read(names.HOLDOUT).count()
    )


def train(run: Run, *, trigger: str = "manual") -> dict:
    """Fit, measure on the training rows, save the model, record the run with its lineage."""
    spec, frame = run.spec, run.read(names.TRAIN)
    inputs = frame.select(*spec.features, spec.target).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = inputs.count()
        started = time.time()
        fitted = run.use_case.build_model(run.model, rows).fit(inputs)
        seconds = time.time() - started
        measured = run.use_case.evaluate(run.model, fitted, inputs)
    finally:
        inputs.unpersist()
    uri = run.path(names.MODEL)
    fitted.write().overwrite().save(uri)
    params = {
        "use_case": run.use_case.name, "model": run.model, "pipeline_run": run.run_id, "trigger": trigger,
        "train_rows": str(rows), "features": ",".join(spec.features),
    }
    tags = {
        "data_hash": data_hash(frame).first()["data_hash"], "git_commit": run.git_commit,
        **{f"{n}_uri": run.path(n) for n in (names.REFERENCE, names.HOLDOUT, names.TRAIN)}, **spec.tags,
    }
    metrics = {**{f"train_{k}": float(v) for k, v in measured.items()}, "fit_seconds": seconds}
    run.append("runs", [(run.run_id, run.use_case.name, run.model, _now(), params, metrics, tags)], RUNS)
    return run.done(
        "train", candidate_uri=uri, fit_seconds=round(seconds, 2),
        **{f"train_{k}": round(v, 4) for k, v in measured.items()},
    )


def champion(run: Run) -> dict | None:
    """Version and tags of the model's current champion."""
    events = run.table("alias_events", registry.ALIAS_EVENTS).filter(F.col("name") == run.registered)
    current = registry.champions(events).first()
    if current is None:
        return None
    versions = run.table("model_versions", registry.MODEL_VERSIONS)
    row = versions.filter((F.col("name") == run.registered) & (F.col("version") == current["version"])).first()
    return {"version": current["version"], "tags": dict(row["tags"]) if row else {}}


def evaluate(run: Run) -> dict:
    """Champion and candidate on the same holdout; promote on strict improvement only."""
    spec = run.spec
    holdout = run.read(names.HOLDOUT).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        candidate = run.use_case.evaluate(run.model, PipelineModel.load(run.path(names.MODEL)), holdout)
        known, old = champion(run), None
        if known is not None:
            old = run.use_case.evaluate(run.model, PipelineModel.load(known["tags"]["serving_uri"]), holdout)
    finally:
        holdout.unpersist()
    metric = spec.primary_metric
    promote, reason = gate.decide(run.spark, spec, candidate[metric], old[metric] if old else None)
    logged = {f"holdout_{k}": float(v) for k, v in candidate.items()}
    logged |= {f"champion_holdout_{k}": float(v) for k, v in (old or {}).items()}
    tags = {
        "gate.promote": str(promote).lower(), "gate.reason": reason,
        "gate.champion_version": str(known["version"]) if known else "none",
    }
    run.append("runs", [(run.run_id, run.use_case.name, run.model, _now(), {}, logged, tags)], RUNS)
    return run.done(
        "evaluate", promote=promote, reason=reason, primary_metric=metric, candidate=round(candidate[metric], 4),
        champion=round(old[metric], 4) if old else None, champion_version=known["version"] if known else None,
        candidate_metrics=candidate, champion_metrics=old,
    )


def register(run: Run) -> dict:
    """Next version number, a copy of the model in the serving layout, lineage tags, ``challenger``."""
    versions = run.table("model_versions", registry.MODEL_VERSIONS).filter(F.col("name") == run.registered)
    version = (versions.agg(F.max("version")).first()[0] or 0) + 1
    uri = run.layout.serving(run.model, version)
    PipelineModel.load(run.path(names.MODEL)).write().overwrite().save(uri)
    trained = run.table("runs", RUNS).filter((F.col("run_id") == run.run_id) & (F.col("model") == run.model))
    merged: dict[str, str] = {}
    for row in trained.orderBy("ts").select("tags").collect():  # the few rows of one run
        merged |= row["tags"]
    tags = {"serving_uri": uri, "pipeline_run": run.run_id, **{t: merged.get(t, "") for t in registry.LINEAGE_TAGS}}
    now = _now()
    run.append("model_versions", [(run.registered, version, run.run_id, tags, now)], registry.MODEL_VERSIONS)
    run.append("alias_events", [(run.registered, registry.CHALLENGER, version, now, 0, "register")], registry.ALIAS_EVENTS)
    return run.done("register", registered_name=run.registered, version=version, serving_uri=uri)


def promote(run: Run, *, version: int, trigger: str = "manual") -> dict:
    """Make a version the champion; the outgoing one becomes ``previous`` if it is another."""
    known, now = champion(run), _now()
    events = []
    if known is not None and known["version"] != version:
        events.append((run.registered, registry.PREVIOUS, known["version"], now, 0, trigger))
    events.append((run.registered, registry.CHAMPION, version, now, 1, trigger))
    run.append("alias_events", events, registry.ALIAS_EVENTS)
    return run.done("promote", version=version, previous_version=known["version"] if known else None, trigger=trigger)


def rollback(run: Run) -> dict:
    """Promote the version under ``previous``."""
    events = run.table("alias_events", registry.ALIAS_EVENTS).filter(F.col("name") == run.registered)
    target = registry.rollback_targets(events).first()
    if target is None or target["version"] is None:
        raise NothingToRollBack(f"no previous champion of {run.registered}")
    return promote(run, version=target["version"], trigger="rollback")


def run_pipeline(
    run: Run, *, profile: str | None = None, rows: int | None = None, trigger: str = "manual",
    holdout_ratio: float = split.HOLDOUT_RATIO, reference_rows: int = split.REFERENCE_ROWS,
) -> dict[str, Mapping]:
    """All steps in order. A failed quality gate raises; a refused model is not registered."""
    results = {"ingest": ingest(run, profile=profile, rows=rows), "validate": validate(run)}
    results["preprocess"] = preprocess(run, holdout_ratio=holdout_ratio, reference_rows=reference_rows)
    results["train"] = train(run, trigger=trigger)
    results["evaluate"] = evaluate(run)
    if results["evaluate"]["promote"]:
        results["register"] = register(run)
        results["promote"] = promote(run, version=results["register"]["version"], trigger=trigger)
    return results


def run_all_models(spark: SparkSession, use_case: UseCase, run_id: str, root: str, **options) -> dict[str, dict]:
    """The loop for every model of a use case; their data differ, so each has its own run."""
    return {m: run_pipeline(Run(spark, use_case, m, f"{run_id}-{m}", root), **options) for m in use_case.models}
