"""Command line: generate, check, describe, export and serve.

    python -m loomwork.cli generate FILE --out DIR [--seed N] [--format json|csv|ndjson|parquet] [--pretty] [--strict] ...
    python -m loomwork.cli check FILE --data DIR|FILE [--map collection=Schema ...] [--dataset NAME]
    python -m loomwork.cli describe DATA [--collection-name NAME] [--typescript] ...
    python -m loomwork.cli export FILE
    python -m loomwork.cli serve FILE [--port N]

``--help`` after a command lists its flags. Settings of ``loomwork.toml`` (see ``config``) hold where a flag isn't given.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config, server
from .operators.check import Checker, check_json_schema
from .operators.describe import Style, describe, pascal, singular, typescript
from .operators.generate import Generator, Options
from .operators.profile import MOST_OPTIONS, profile
from .plans import syntax as S
from .plugins import Registry
from .sources import csv, ndjson, openapi

LOG = logging.getLogger("loomwork.cli")


def frames_of(spark: SparkSession, path: str, name: str | None = None, delimiter: str = ",") -> dict[str, DataFrame]:
    """Collections of a path: a JSON object of arrays, a CSV or NDJSON file, Parquet, or a folder of such files."""
    p = Path(path)
    if p.is_dir() and p.suffix != ".parquet":
        return {k: v for f in sorted(p.iterdir()) if f.suffix in (".json", ".csv", ".ndjson", ".parquet") for k, v in frames_of(spark, str(f), None, delimiter).items()}
    name = name or p.stem
    if p.suffix == ".csv":
        return {name: csv.read_csv(spark, path, csv.Reading(delimiter=delimiter))}
    if p.suffix == ".ndjson":
        return ndjson.read_collections(spark, path)
    if p.suffix == ".parquet":
        return {name: spark.read.parquet(path)}
    return ndjson.read_json(spark, path)


def write(frames: dict[str, DataFrame], out: str, kind: str, pretty: bool = False, how: csv.Writing | None = None, single: bool = False) -> None:
    """Collections as folders below ``out``; as CSV with ``single``, one file of sections."""
    if kind == "csv" and single:
        csv.write_sections(frames, out, how)
    elif kind == "csv":
        csv.write_csvs(frames, out, how)
    elif kind == "parquet":
        for name, df in frames.items():
            df.write.parquet(os.path.join(out, name))
    else:
        ndjson.write_json(frames, out, pretty and kind == "json")


def watch(path: str, run: Callable[[], object], wait: float = 0.1, rounds: int | None = None) -> None:
    """Calls ``run`` now and whenever the file has changed and then stayed the same for ``wait`` seconds."""
    seen = None
    while rounds is None or rounds > 0:
        now = os.stat(path).st_mtime_ns
        if now != seen:
            time.sleep(wait)
            if os.stat(path).st_mtime_ns == now:
                seen = now
                run()
                rounds = None if rounds is None else rounds - 1
        else:
            time.sleep(wait)


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomwork")
    commands = top.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-c", "--config", help="settings; by default the nearest loomwork.toml or loomwork.json")
    common.add_argument("--no-config", action="store_true")
    common.add_argument("--plugins", action="append", default=[], help="a plugin's file or a folder of them")
    common.add_argument("--no-auto-plugins", action="store_true", help="leaves out the folder plugins beside the description")
    common.add_argument("-d", "--debug", action="store_true")
    common.add_argument("--verbose", action="store_true", help="logs as info")
    common.add_argument("--log-level", choices=list(config.LEVELS))
    common.add_argument("--log", action="append", default=[], help="a part of the engine to log: generate, check, describe, cli")
    g = commands.add_parser("generate", parents=[common])
    g.add_argument("file")
    g.add_argument("-o", "--out")
    g.add_argument("-s", "--seed", type=int)
    g.add_argument("-f", "--format", choices=["json", "csv", "ndjson", "parquet"])
    g.add_argument("-p", "--pretty", action="store_true", default=None)
    g.add_argument("--strict", action="store_true")
    g.add_argument("-w", "--watch", action="store_true", help="generates anew, over what is there, when the file changes")
    g.add_argument("--csv-delimiter", default=",")
    g.add_argument("--csv-no-header", action="store_true")
    g.add_argument("--csv-arrays", choices=["json", "first", "count"], default="json")
    g.add_argument("--csv-nested", choices=["flatten", "json"], default="flatten")
    g.add_argument("--csv-single", action="store_true", help="one file of sections")
    g.add_argument("-v", "--validate", metavar="SPEC", help="an OpenAPI document whose schemas the rows are checked against")
    g.add_argument("-m", "--mapping", type=json.loads, help="JSON object: the SPEC's schema for a collection")
    g.add_argument("--validate-only", action="store_true")
    g.add_argument("--oas-source", metavar="SPEC", help="an OpenAPI document to put examples into")
    g.add_argument("--oas-output", metavar="FILE")
    g.add_argument("--oas-external", metavar="ADDRESS", help="examples are named under this address")
    g.add_argument("--oas-example-count", type=int, default=1)
    k = commands.add_parser("check", parents=[common])
    k.add_argument("file")
    k.add_argument("--data", required=True)
    k.add_argument("--map", nargs="*", default=[])
    k.add_argument("--dataset", help="only this dataset's rules")
    d = commands.add_parser("describe", parents=[common])
    d.add_argument("data")
    d.add_argument("--name", "--collection-name", dest="name")
    d.add_argument("--dataset-name", default="Generated")
    d.add_argument("--delimiter", default=",")
    d.add_argument("--no-formats", action="store_true")
    d.add_argument("--no-weights", action="store_true")
    d.add_argument("--max-enum", type=int, default=MOST_OPTIONS)
    d.add_argument("--typescript", action="store_true", help="interfaces after the description")
    d.add_argument("--ts-only", action="store_true", help="interfaces alone")
    e = commands.add_parser("export", parents=[common])
    e.add_argument("file")
    s = commands.add_parser("serve", parents=[common])
    s.add_argument("file")
    s.add_argument("--port", type=int, default=3000)
    s.add_argument("-s", "--seed", type=int)
    return top


def _plugins(a: argparse.Namespace, settings: config.Config) -> Registry:
    plugins = Registry()
    folder = Path(a.file).parent / "plugins"
    automatic = [folder] if not a.no_auto_plugins and folder.is_dir() else []
    for path in [*(Path(settings.folder, p) for p in settings.plugins), *a.plugins, *automatic]:
        LOG.info("plugins of %s: %s", path, ", ".join(plugins.load(path)))
    return plugins


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    settings = config.load(None if a.no_config else a.config or config.find(Path(a.file).parent if hasattr(a, "file") else "."))
    level = a.log_level or ("debug" if a.debug else "info" if a.verbose else settings.log_level)
    config.start_logging(level, a.log or settings.log_components)
    if a.command == "describe":
        return _describe(_session(), a)
    plugins = _plugins(a, settings)
    program = S.parse(Path(a.file).read_text(), plugins.statements())
    if a.command == "export":
        print(json.dumps(openapi.export(program), indent=2))
        return 0
    if a.command == "check":
        return _check(_session(), a, program)
    if a.command == "serve":
        with server.serve(_session(), Path(a.file).read_text(), a.port) as http:
            http.serve_forever()
        return 0
    if a.watch:
        watch(a.file, lambda: _generate(_session(), a, settings, plugins))
        return 0
    return _generate(_session(), a, settings, plugins)


def _session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _generate(spark: SparkSession, a: argparse.Namespace, settings: config.Config, plugins: Registry) -> int:
    program = S.parse(Path(a.file).read_text(), plugins.statements())
    seed = settings.seed if a.seed is None else a.seed
    options = Options(seed, a.strict, imports=openapi.imports_of(program, str(Path(a.file).parent)), functions=plugins.functions(), attempts=settings.attempts, dataset_attempts=settings.dataset_attempts)
    made = Generator(spark, program, options)
    frames = made.run()
    valid = True
    if a.validate:
        valid = _matches(frames, openapi.load(a.validate), a.mapping or {})
    if a.oas_source:
        text = json.dumps(openapi.with_examples(openapi.load(a.oas_source), frames, a.oas_example_count, a.oas_external), indent=2)
        Path(a.oas_output).write_text(text) if a.oas_output else print(text)
    if a.out and not a.validate_only:
        pretty = settings.pretty if a.pretty is None else a.pretty
        how = csv.Writing(a.csv_delimiter, not a.csv_no_header, a.csv_arrays, a.csv_nested)
        write(frames, a.out, a.format or settings.format, pretty, how, a.csv_single)
    for w in made.warnings:  # last, as the rows that break rules are counted while they are written
        print(f"warning: {w}", file=sys.stderr)
    return 0 if valid else 1


def _matches(frames: dict[str, DataFrame], document: dict, mapping: dict[str, str]) -> bool:
    """Whether all rows match their schemas of an OpenAPI document; says what they break."""
    schemas, valid = document.get("components", {}).get("schemas", {}), True
    for name, df in frames.items():
        schema = mapping.get(name) or openapi.schema_for(name, list(schemas))
        if schema not in schemas:
            print(f"{name}: no schema")
            continue
        broken = check_json_schema(df, schemas[schema], document, "__errors").select(F.inline("__errors")).groupBy("path", "keyword").count().collect()
        print(f"{name}: {'ok' if not broken else 'broken'}")
        for r in broken:
            print(f"  {r['path']} {r['keyword']}: {r['count']}")
        valid = valid and not broken
    return valid


def _describe(spark: SparkSession, a: argparse.Namespace) -> int:
    frames = frames_of(spark, a.data, a.name, a.delimiter)
    parts = []
    if not a.ts_only:
        parts.append(describe(frames, a.dataset_name, style=Style(not a.no_formats, not a.no_weights, a.max_enum)))
    if a.typescript or a.ts_only:
        parts += [typescript(pascal(singular(n)), profile(df)) for n, df in frames.items()]
    print("\n\n".join(parts))
    return 0


def _check(spark: SparkSession, a: argparse.Namespace, program: S.Program) -> int:
    checker, frames = Checker(program), frames_of(spark, a.data)
    mapping = dict(x.split("=", 1) for x in a.map) or checker.mapping(list(frames))
    valid = True
    for name, report in checker.dataset(frames, mapping).items():
        valid = valid and report.valid
        print(f"{name}: {'ok' if report.valid else 'missing' if report.missing else f'{report.failed} of {report.rows} rows break a rule'}")
        for rule, n in report.by_rule.items():
            if n:
                print(f"  {rule}: {n}")
    for dataset in checker.datasets:
        if checker.datasets[dataset].rules and a.dataset in (None, dataset):
            for r in checker.whole(frames, dataset).collect():
                valid = valid and r["ok"]
                print(f"  {'ok' if r['ok'] else 'error' if r['failed'] else 'broken'}: {r['rule']}")
    return 0 if valid else 1


if __name__ == "__main__":
    sys.exit(main())
