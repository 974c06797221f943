"""Command line: ``python -m sievecraft.cli --root DIR COMMAND``."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, SparkSession

from .config import EngineConfig
from .engine import Engine
from .operators.reports import as_table

#: command -> (arguments, what it does)
COMMANDS = {
    "init": ([], "create empty tables"),
    "status": ([], "how many items sit at each stage, and the next step"),
    "device": ([], "what the session runs on"),
    "census-import": (["path"], "upsert a catalogue file"),
    "census-report": ([], "counts of the catalogue"),
    "embed": (["encoder", "limit"], "embed pending photos, or the oldest of them; the encoder is a factory, module:name"),
    "fetch": (["kind", "fetcher"], "fetch missing thumbs, previews or full images; the fetcher is a factory, module:name"),
    "fetch-zips": (["folder"], "import thumbs from zips"),
    "fetch-scan": ([], "mark thumbs that are there"),
    "fetch-repair": ([], "clear the flag of thumbs that aren't"),
    "safety": ([], "apply the exclusion rules"),
    "group": ([], "build groups"),
    "score": ([], "score members and propose keepers"),
    "pipeline": ([], "safety, group and score"),
    "dry-run": ([], "what applying the decisions would do"),
    "corrupt-scan": (["folder"], "verdicts on the images of a folder"),
    "corrupt-thumbs": ([], "flag corrupt thumbs"),
    "text-scan": (["folder"], "verdicts on text images of a folder"),
    "text-thumbs": ([], "flag text images"),
    "text-export": (["path"], "write accepted text images"),
    "review": (["group_id", "action", "keep"], "decide on a group: accept, keep_all, delete_all, skip, or override with comma-joined keys"),
    "review-next": ([], "the next pending group"),
    "apply-export": (["run_id"], "write the trash payload"),
    "apply-import-undo": (["path"], "import an undo file"),
    "apply-export-restore": (["run_id"], "write a restore payload"),
    "apply-mark-restored": (["run_id"], "mark a run restored"),
}


OPTIONAL = {("embed", "limit"), ("apply-export-restore", "run_id"), ("review", "keep")}


def factory(name: str):
    """``module:name`` as the object it names."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _show(value) -> None:
    """A JSON value; a frame as one object a line, row by row, however many there are."""
    if isinstance(value, DataFrame):
        for r in value.toLocalIterator():
            print(json.dumps(r.asDict(recursive=True), default=str))
    else:
        print(json.dumps(value, default=str))


def run(engine: Engine, command: str, *args: str):
    """The command's result: a frame, a dict, a number or a path."""
    actions = {
        "init": lambda: [engine.store.commit(**{t: engine.table(t) for t in ("photos", "groups", "group_members", "decisions", "embeddings", "undo_log", "meta", "corrupt_flags", "text_flags") if engine.store.current(t) is None}), "ok"][1],
        "status": lambda: as_table(engine.status()),
        "device": lambda: {"master": engine.spark.sparkContext.master, "cores": engine.spark.sparkContext.defaultParallelism, "accelerators": dict(engine.spark.sparkContext.resources)},
        "census-import": engine.import_census,
        "census-report": lambda: as_table(engine.census_report()),
        "embed": lambda encoder, limit=None: engine.embed(factory(encoder), int(limit) if limit else None),
        "fetch": lambda kind, fetcher: engine.fetch(factory(fetcher), kind, only_group_members=kind != "thumbs"),
        "fetch-zips": engine.import_zips,
        "fetch-scan": engine.scan_thumbs,
        "fetch-repair": lambda: engine.scan_thumbs(repair=True),
        "safety": engine.safety,
        "group": engine.group,
        "score": engine.score,
        "pipeline": engine.pipeline,
        "dry-run": lambda: as_table(engine.dry_run()),
        "corrupt-scan": lambda folder: engine.scan_tree(folder),
        "corrupt-thumbs": engine.scan_corrupt,
        "text-scan": lambda folder: engine.scan_tree(folder, "text"),
        "text-thumbs": engine.scan_text,
        "text-export": engine.export_accepted_text,
        "review": lambda group_id, action, keep="": engine.decide(engine.spark.createDataFrame([(group_id, action, [k for k in keep.split(",") if k])], "group_id string, action string, keep_keys array<string>")),
        "review-next": engine.next_group,
        "apply-export": engine.export_trash,
        "apply-import-undo": engine.import_undo,
        "apply-export-restore": engine.export_restore,
        "apply-mark-restored": engine.mark_restored,
    }
    return actions[command](*args)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Near-duplicate grouping and selection on Spark")
    parser.add_argument("--root", required=True)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (args, text) in COMMANDS.items():
        p = sub.add_parser(name, help=text)
        for a in args:
            p.add_argument(a, nargs="?" if (name, a) in OPTIONAL else None)
    given = vars(parser.parse_args(argv))
    spark = SparkSession.builder.appName("sievecraft").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, given["root"], EngineConfig.from_env())
    _show(run(engine, given["command"], *[given[a] for a in COMMANDS[given["command"]][0] if given[a] is not None]))


if __name__ == "__main__":
    main()
