"""Command line: translate, batch, cache, audit, config and query, over Parquet or JSON tables.

Exit codes: 0 done, 1 some documents or units failed, 2 wrong usage, 3 wrong configuration.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.rules import load_rules
from quire.operators import batch as A
from quire.operators import cache as C
from quire.operators import entities as E
from quire.operators import glossary as G
from quire.operators import report as P
from quire.operators import resolve as R
from quire.operators.backends import Backend, Context, make_backend
from quire.plans.staging import staged
from quire.plans.translate import new_cache_entries, translate_documents, units_of
from quire.sources.config import load_config, load_roster

DEFAULTS = {"glossary": {"files": []}, "postrules": {"sets": ["dates"], "files": []}, "entities": {}}
#: Folder of files that are never committed.
PRIVATE = "private"
NO_CACHE = "namespace string, source string, en string, status string, seq long"


def _settings(spark: SparkSession, path: str | None) -> tuple[Context, DataFrame, list[tuple[str, str]]]:
    found = load_config(path, DEFAULTS) if path else DEFAULTS
    glossary = G.load_glossary(spark, found["glossary"]["files"])
    rules = load_rules(found["postrules"]["sets"], found["postrules"]["files"])
    roster = found["entities"].get("file")
    # A roster is a list that people keep by hand; it becomes part of the expressions.
    names = tuple(r.entity for r in load_roster(spark, roster).collect()) if roster else ()
    return Context(entities=names), glossary, rules


def _namespace(backend: Backend, context: Context, glossary: DataFrame, rules: list[tuple[str, str]]) -> str:
    # Glossary files are read on the driver to begin with.
    terms = {r.term: r.translation for r in G.merge_glossary(glossary).collect()}
    return C.namespace(backend.name, "", context.source_lang, context.target_lang, terms, context.entities, rules)


def _cache(spark: SparkSession, path: str | None) -> DataFrame:
    if not path:
        return spark.createDataFrame([], NO_CACHE)
    try:
        return C.upsert_latest(spark.read.parquet(path).select("namespace", "source", "en", "status", "seq"))
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return spark.createDataFrame([], NO_CACHE)
        raise


def translate(spark: SparkSession, args: argparse.Namespace) -> int:
    """Translates documents; with --dry-run only estimates."""
    context, glossary, rules = _settings(spark, args.config)
    backend = make_backend(args.backend)
    key = _namespace(backend, context, glossary, rules)
    known = _cache(spark, args.cache).where(F.col("namespace") == key)
    documents = spark.read.parquet(args.documents)
    if args.dry_run:
        P.document_estimate(units_of(documents), C.usable(known), ["doc_id"], 0.0, 0.0).show(truncate=False)
        return 0
    units, done = translate_documents(documents, backend, context, glossary, known, rules)
    units.write.mode("overwrite").parquet(args.output)
    if args.cache:
        last = known.agg(F.max("seq")).first()[0] or 0
        C.append(new_cache_entries(done, key).withColumn("seq", F.lit(last + 1).cast("long")), args.cache)
    written = spark.read.parquet(args.output)
    P.document_report(written, ["doc_id"]).drop("failures").show(truncate=False)
    return int(not written.where("status <> 'ok'").isEmpty())


def batch(spark: SparkSession, args: argparse.Namespace) -> int:
    """Translates the documents (src, kind, mtime, doc_id, text) that an earlier run into OUTPUT has not, and adds this run's report.

    Each run has folders of its own number, so a run that is repeated after a failure starts anew.
    """
    context, glossary, rules = _settings(spark, args.config)
    backend = make_backend(args.backend)
    reports = _read(spark, f"{args.output}/report", "kind string, src string, status string, error string, mtime long, run int")
    number = (reports.agg(F.max("run")).first()[0] or 0) + 1
    planned = A.plan(spark.read.parquet(args.documents), reports.where("status <> 'ERROR'").select("src", "mtime"), args.only, args.force)
    due = planned.where("due")
    units, _ = translate_documents(due.where("kind <> 'copy'").select("doc_id", "text"), backend, context, glossary, spark.createDataFrame([], NO_CACHE), rules)
    units.write.mode("overwrite").parquet(f"{args.output}/units/run={number}")
    due.where("kind = 'copy'").write.mode("overwrite").parquet(f"{args.output}/copies/run={number}")
    results = due.select("src", F.lit(None).cast("string").alias("error"), F.lit(None).cast("array<string>").alias("lost_parts"))
    report = A.corpus_report(planned, results).join(planned.select("src", F.col("mtime").cast("long")).distinct(), "src")
    report.select("kind", "src", "status", "error", "mtime").write.mode("overwrite").parquet(f"{args.output}/report/run={number}")
    written = spark.read.parquet(f"{args.output}/report/run={number}")
    written.groupBy("kind", "status").count().orderBy("kind", "status").show()
    failed = not spark.read.parquet(f"{args.output}/units/run={number}").where("status <> 'ok'").isEmpty()
    return int(failed or not A.errors(written).isEmpty())


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at a path, an empty one if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def cache(spark: SparkSession, args: argparse.Namespace) -> int:
    """Shows or rewrites a cache."""
    table = _cache(spark, args.cache)
    if args.action == "stats":
        C.statistics(table).show()
    elif args.action == "pending":
        C.pending(table).show(truncate=70)
        return int(not C.pending(table).isEmpty())
    elif args.action == "retry":
        return retry(spark, args, table)
    elif args.action == "compact":
        C.compact(spark, args.cache, args.output)
    elif args.action == "purge":
        C.purge(table, args.namespace).write.parquet(args.output)
    return 0


def retry(spark: SparkSession, args: argparse.Namespace, table: DataFrame) -> int:
    """Sends what is pending in the configuration's namespace to the backend again and adds the answers to the cache."""
    context, glossary, rules = _settings(spark, args.config)
    backend = make_backend(args.backend)
    known = table.where(F.col("namespace") == _namespace(backend, context, glossary, rules))
    asked = C.pending(known).select(F.col("source").alias("unit"), "en", "status")
    again = staged(R.second_pass(asked, backend, context, rules), "cache-retry")
    counts = R.retry_counts(known, again).first()
    last = known.agg(F.max("seq")).first()[0] or 0
    good = again.where("status = 'ok'").select(F.lit(_namespace(backend, context, glossary, rules)).alias("namespace"), F.col("unit").alias("source"), "en", "status", F.lit(last + 1).cast("long").alias("seq"))
    if counts.recovered:
        C.append(good, args.cache)
    print(f"recovered {counts.recovered}/{counts.total}")
    return 0


def config(spark: SparkSession, args: argparse.Namespace) -> int:
    """Makes a folder for private files that git ignores, or shows or validates a configuration."""
    if args.action == "init":
        folder = Path(args.path)
        (folder / PRIVATE).mkdir(parents=True, exist_ok=True)
        (folder / PRIVATE / ".gitignore").write_text("*\n", "utf-8")
        ignored = folder / ".gitignore"
        lines = ignored.read_text("utf-8").splitlines() if ignored.is_file() else []
        if f"{PRIVATE}/" not in lines:
            ignored.write_text("\n".join([*lines, f"{PRIVATE}/"]) + "\n", "utf-8")
        return 0
    if args.action == "show":
        print(json.dumps(load_config(args.path, DEFAULTS), indent=2, ensure_ascii=False))
        return 0
    if not Path(args.path).is_file():
        raise ValueError(f"invalid: there is no {args.path}")
    try:
        _settings(spark, args.path)
    except (ValueError, OSError) as error:
        raise ValueError(f"invalid: {error}") from error
    print("ok")
    return 0


def audit(spark: SparkSession, args: argparse.Namespace) -> int:
    """Lists cache entries that translate a lone fragment of a protected name."""
    context, *_ = _settings(spark, args.config)
    found = E.poisoned_entries(_cache(spark, args.cache), context.entities)
    found.show(truncate=70)
    return int(not found.isEmpty())


def query(spark: SparkSession, args: argparse.Namespace) -> int:
    """Runs a registered query over a folder of tables."""
    from quire import queries

    queries.load()
    if args.name not in queries.QUERIES:
        print("\n".join(sorted(queries.QUERIES)))
        return 2
    queries.QUERIES[args.name](spark, args.tables).show(args.rows, truncate=70)
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quire", description=__doc__)
    commands = out.add_subparsers(required=True)
    one = commands.add_parser("translate", help=translate.__doc__)
    for name in ("documents", "output"):
        one.add_argument(name)
    one.add_argument("--backend", default="upper")
    one.add_argument("--cache")
    one.add_argument("--config")
    one.add_argument("--dry-run", action="store_true")
    one.set_defaults(run=translate)
    one = commands.add_parser("batch", help=batch.__doc__)
    for name in ("documents", "output"):
        one.add_argument(name)
    one.add_argument("--backend", default="upper")
    one.add_argument("--config")
    one.add_argument("--only")
    one.add_argument("--force", action="store_true")
    one.set_defaults(run=batch)
    one = commands.add_parser("cache", help=cache.__doc__)
    one.add_argument("action", choices=["stats", "pending", "retry", "compact", "purge"])
    one.add_argument("cache")
    one.add_argument("--output")
    one.add_argument("--namespace", nargs="*", default=[])
    one.add_argument("--backend", default="upper")
    one.add_argument("--config")
    one.set_defaults(run=cache)
    one = commands.add_parser("audit", help=audit.__doc__)
    one.add_argument("cache")
    one.add_argument("--config")
    one.set_defaults(run=audit)
    one = commands.add_parser("config", help=config.__doc__)
    one.add_argument("action", choices=["init", "show", "validate"])
    one.add_argument("path")
    one.set_defaults(run=config)
    one = commands.add_parser("query", help=query.__doc__)
    one.add_argument("name")
    one.add_argument("tables")
    one.add_argument("--rows", type=int, default=20)
    one.set_defaults(run=query)
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as stop:
        return int(stop.code or 0) and 2
    try:
        return args.run(spark or SparkSession.builder.appName("quire").getOrCreate(), args)
    except ValueError as error:
        print(error, file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
