"""Command line: one step of the loop, the whole loop, the monitor, or a printed sample.

``python -m modelkeel run --use-case module:attr --model m --run-id r1 --root hdfs:///ct``
"""

from __future__ import annotations

import argparse
import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from modelkeel.operators import drift, split
from modelkeel.plans import monitor, pipeline
from modelkeel.session import prepare
from modelkeel.sources import topic
from modelkeel.sources.records import read_log, record_schema
from modelkeel.spec import load_use_case


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--use-case", help="module:attribute of the use case")
    shared.add_argument("--model", required=True)
    shared.add_argument("--run-id", default="manual")
    shared.add_argument("--root", required=True, help="folder every executor can reach")
    shared.add_argument("--seed", type=int, default=42)
    shared.add_argument("--key", default="", help="comma-separated columns that identify a row")
    top = argparse.ArgumentParser(prog="modelkeel")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, **arguments) -> None:
        sub = commands.add_parser(name, parents=[shared])
        for flag, options in arguments.items():
            sub.add_argument(f"--{flag.replace('_', '-')}", **options)

    source = {"profile": {"default": None}, "rows": {"type": int, "default": None, "help": "ingest so many rows; default: all"}}
    parts = {
        "holdout_ratio": {"type": float, "default": split.HOLDOUT_RATIO},
        "reference_rows": {"type": int, "default": split.REFERENCE_ROWS},
    }
    trigger = {"trigger": {"default": "manual"}}
    command("ingest", **source)
    command("validate")
    command("preprocess", **parts)
    command("train", **trigger)
    command("evaluate")
    command("register")
    command("promote", version={"type": int, "required": True}, **trigger)
    command("rollback")
    command("run", **source, **parts, **trigger)
    command("sample", profile={"default": None}, rows={"type": int, "default": 10})
    command(
        "drift", window_minutes={"type": int, "default": drift.WINDOW_MINUTES}, warn={"type": float, "default": drift.WARN},
        retrain={"type": float, "default": drift.RETRAIN}, min_rows={"type": int, "default": drift.MIN_ROWS},
        source={"choices": ("log", "topic"), "default": "log", "help": "where the live records are read"},
        log={"default": None, "help": "root of the prediction log"},
        bootstrap={"default": None, "help": "servers of the topic"}, topic={"default": topic.DEFAULT_TOPIC},
        features={"required": True, "help": "logged features as name:type, comma-separated"},
        prediction_type={"default": "string"}, now={"default": None, "help": "ISO time in UTC; default: the clock"},
        dry_run={"action": "store_true"},
    )
    return top


def _sample(run: pipeline.Run, arguments) -> list[dict]:
    """Feature records of any profile, printed one per line."""
    frame = run.use_case.ingest(run.spark, run.model, profile=arguments.profile, seed=run.seed, rows=None)
    records = split.sample_records(frame, run.spec.features, run.key or frame.columns, arguments.rows, seed=run.seed)
    return [json.loads(r["record"]) for r in records.collect()]


def _live_records(run: pipeline.Run, a, schema, now: datetime):
    """The records to be judged: the log, or the window of the topic, decoded and of this model only."""
    if a.source == "log":
        if not a.log:
            raise SystemExit("--source log needs --log")
        return read_log(run.spark, a.log, schema)
    if not a.bootstrap:
        raise SystemExit("--source topic needs --bootstrap")
    since = now - timedelta(minutes=a.window_minutes)
    millis = int(since.replace(tzinfo=timezone.utc).timestamp() * 1000)
    rows = topic.read_topic_window(run.spark, a.bootstrap, a.topic, millis)
    return topic.decode_window(rows, schema, F.timestamp_millis(F.lit(millis)), model=run.model)


def _drift(run: pipeline.Run, a) -> dict:
    features = dict(item.split(":", 1) for item in a.features.split(","))
    now = datetime.fromisoformat(a.now) if a.now else datetime.now(timezone.utc).replace(tzinfo=None)
    records = _live_records(run, a, record_schema(features, a.prediction_type), now)
    return monitor.check_model(
        run, records, now, window_minutes=a.window_minutes, warn=a.warn, retrain=a.retrain, min_rows=a.min_rows, dry_run=a.dry_run
    )


def execute(spark: SparkSession, argv: list[str] | None = None):
    """Run one command on the given session and return its result."""
    a = parser().parse_args(argv)
    key = tuple(c for c in a.key.split(",") if c)
    run = pipeline.Run(prepare(spark), load_use_case(a.use_case), a.model, a.run_id, a.root, seed=a.seed, key=key)
    actions = {
        "ingest": lambda: pipeline.ingest(run, profile=a.profile, rows=a.rows),
        "validate": lambda: pipeline.validate(run),
        "preprocess": lambda: pipeline.preprocess(run, holdout_ratio=a.holdout_ratio, reference_rows=a.reference_rows),
        "train": lambda: pipeline.train(run, trigger=a.trigger),
        "evaluate": lambda: pipeline.evaluate(run),
        "register": lambda: pipeline.register(run),
        "promote": lambda: pipeline.promote(run, version=a.version, trigger=a.trigger),
        "rollback": lambda: pipeline.rollback(run),
        "run": lambda: pipeline.run_pipeline(
            run, profile=a.profile, rows=a.rows, trigger=a.trigger, holdout_ratio=a.holdout_ratio,
            reference_rows=a.reference_rows,
        ),
        "sample": lambda: _sample(run, a),
        "drift": lambda: _drift(run, a),
    }
    return actions[a.command]()


def main() -> None:
    result = execute(SparkSession.builder.appName("modelkeel").getOrCreate())
    for line in result if isinstance(result, list) else [result]:
        print(json.dumps(line, default=str))


if __name__ == "__main__":
    main()
