"""Command line: scan, pack, verify, restore, upload."""

from __future__ import annotations

import argparse
import logging
import re
import sys

from . import __version__

#: fixed values: exit codes
OK, WARNINGS, FATAL, USAGE = 0, 1, 2, 64


class _Usage(Exception):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise _Usage(message)


def size_literal(text: str) -> int:
    """Bytes of a size literal, as functions.scalars.parse_size reads it."""
    m = re.fullmatch(r"([0-9]+)([KMG]?)", text, re.IGNORECASE | re.ASCII)
    value = int(m[1]) << {"": 0, "K": 10, "M": 20, "G": 30}[m[2].upper()] if m else -1
    if not 0 < value < 1 << 63:
        raise _Usage(f"bad size {text!r}")
    return value


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="snapcat")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", parser_class=_Parser, required=True)
    for name, root in (("scan", True), ("pack", False), ("verify", False), ("restore", False), ("upload", False)):
        c = sub.add_parser(name)
        if root:
            c.add_argument("root")
        c.add_argument("--repo", required=True)
        if name != "verify":
            c.add_argument("-v", "--verbose", action="store_true")
    c = sub.choices
    c["scan"].add_argument("--label")
    c["scan"].add_argument("--hash", action="store_true")
    c["pack"].add_argument("--snapshot")
    c["pack"].add_argument("--target-size", default="50G")
    c["pack"].add_argument("--pack-algo", choices=("next-fit", "ffd"), default="next-fit")
    c["verify"].add_argument("--objects", action="store_true")
    c["restore"].add_argument("--dest", required=True)
    c["restore"].add_argument("--snapshot")
    c["upload"].add_argument("--remote", required=True)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    """Run a command; returns the exit code."""
    try:
        a = parser().parse_args(argv)
        target = size_literal(a.target_size) if a.command == "pack" else None
    except _Usage as e:
        print(f"snapcat: {e}", file=sys.stderr)
        return USAGE
    from pyspark.sql import SparkSession

    from . import repository
    from .plans import publish

    logging.getLogger("snapcat").setLevel(logging.INFO if getattr(a, "verbose", False) else logging.WARNING)
    spark = spark or SparkSession.builder.appName("snapcat").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if a.command == "scan":
            r = repository.scan(spark, a.root, a.repo, a.label, a.hash)
            print("{label}: {entries} entries, {new} new objects, {known} known".format(**r.value))
        elif a.command == "pack":
            r = repository.pack(spark, a.repo, a.snapshot, target, a.pack_algo)
            print("\n".join(r.value) if r.value else "nothing to pack")
        elif a.command == "verify":
            r = repository.verify(spark, a.repo, a.objects)
            print("OK" if r.value else "FAILED")
        elif a.command == "restore":
            r = repository.restore(spark, a.repo, a.dest, a.snapshot)
            print(f"{r.value} files restored")
        else:
            r = repository.Result(publish.upload(spark, a.repo, a.remote), [])
    except repository.Fatal as e:
        print(f"snapcat: {e}", file=sys.stderr)
        return FATAL
    except (OSError, ValueError) as e:
        print(f"snapcat: {e}", file=sys.stderr)
        return FATAL
    for w in r.warnings:
        print(f"snapcat: {w}", file=sys.stderr)
    return WARNINGS if r.warnings else OK


if __name__ == "__main__":
    sys.exit(main())
