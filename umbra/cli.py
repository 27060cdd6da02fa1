"""Command line: python -m umbra mask | unmask | version."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from umbra import __version__
from umbra.engine import Engine
from umbra.errors import UmbraError
from umbra.operators import cloakmap, policy, validate
from umbra.sources import documents as sources


def _session() -> SparkSession:
    return SparkSession.builder.appName("umbra").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _one_text(rows, path: Path) -> None:
    """The text of a single document as a file; a document is bounded by validate.MAX_BYTES."""
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(rows.head()[0], encoding="utf-8")


def mask(args: argparse.Namespace) -> int:
    source = validate.input_file(args.input, (".json",))
    spark = _session()
    chosen = policy.load(args.policy) if args.policy else policy.preset(args.preset)
    docs = sources.read_json(spark, str(source.resolve()))
    if docs.filter("_corrupt_record is not null").count():
        raise validate.ValidationError(f"{source} is not a document")
    done, maps = Engine(chosen).mask_documents(docs)
    out = Path(args.output or source.with_name(f"{source.stem}.masked{sources.FORMATS[args.format]}"))
    _one_text(sources.render(done, args.format).select("text"), out)
    where = Path(args.cloakmap or source.with_name(f"{source.stem}.cloakmap.json"))
    _one_text(cloakmap.to_json(maps).select("value"), where)
    print(f"{out}\n{where}")
    return 0


def unmask(args: argparse.Namespace) -> int:
    source, where = validate.input_file(args.input, (".json",)), validate.input_file(args.cloakmap, (".json",))
    spark = _session()
    docs = sources.read_json(spark, str(source.resolve()))
    maps = cloakmap.load(spark, str(where.resolve()), strict=True)
    # the map names the document that was masked; here it is the file given
    own = docs.head()["doc_id"]
    restored, found = Engine().unmask_documents(docs, maps.withColumn("doc_id", F.lit(own)))
    out = Path(args.output or source.with_name(f"{source.stem.removesuffix('.masked')}.restored.json"))
    _one_text(sources.to_json(restored).select("text"), out)
    failed = found.filter("found is null").count()
    print(f"{out}\n{failed} not restored")
    return 1 if failed else 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="umbra", description="Masks personal data in structured documents, and restores it.")
    parser.add_argument("--version", action="version", version=__version__)
    commands = parser.add_subparsers(dest="command", required=True)
    m = commands.add_parser("mask", help="mask a document")
    m.add_argument("input")
    m.add_argument("-o", "--output")
    m.add_argument("--cloakmap")
    m.add_argument("--policy", help="a YAML file")
    m.add_argument("--preset", default="default", choices=sorted(policy.PRESETS))
    m.add_argument("--format", default="json", choices=sorted(sources.FORMATS))
    m.set_defaults(run=mask)
    u = commands.add_parser("unmask", help="restore a masked document")
    u.add_argument("input")
    u.add_argument("cloakmap")
    u.add_argument("-o", "--output")
    u.set_defaults(run=unmask)
    commands.add_parser("version", help="the version").set_defaults(run=lambda args: print(__version__) or 0)
    args = parser.parse_args(argv)
    try:
        return args.run(args)
    except (UmbraError, ValueError, OSError) as e:
        print(f"umbra: {e}", file=sys.stderr)
        return 2
