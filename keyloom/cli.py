"""Command line: ``python -m keyloom.cli DATASET -fields "..." [-select "..."] ...``.

    DATASET             directory with a list file, or the list file
    -files F1 F2 ...    a table of single files instead
    -fields "..."       what to show
    -select "..."       field low high ...
    -B[f|d][m][u] FILE  binary with frames of 4 (f) or 8 (d) bytes, with a type mask (m),
                        unscaled (u); FILE - is the standard output; without f or d, text
    -index "..."        build indexes, at .keyloom_index in the dataset's directory
    -count              rough count of the selections, by indexes
    -idxstats           statistics of the indexes
    -v                  version
"""

from __future__ import annotations

import getpass
import os
import socket
import sys
import time
import uuid
from contextlib import nullcontext

from pyspark.sql import SparkSession

from . import __version__
from .operators.engine import Engine
from .operators.index import Indexes
from .operators.sinks import write_binary, write_tsv
from .plans.catalog import Catalog
from .sources import files


class UsageError(ValueError):
    pass


def parse(args: list[str]) -> dict:
    out: dict = {"dataset": None, "files": [], "fields": None, "select": "", "index": None, "count": False, "idxstats": False, "binary": None, "version": False}
    at = 0

    def value(name: str) -> str:
        nonlocal at
        at += 1
        if at >= len(args):
            raise UsageError(f"{name} needs a value")
        return args[at]

    while at < len(args):
        a = args[at]
        if a in ("-fields", "-select", "-index"):
            out[a[1:]] = value(a)
        elif a.lower() in ("-count", "-idxstats"):
            out[a[1:].lower()] = True
        elif a.lower() == "-v":
            out["version"] = True
        elif a == "-files":
            while at + 1 < len(args) and not args[at + 1].startswith("-"):
                at += 1
                out["files"].append(args[at])
        elif a.startswith("-B"):
            flags = a[2:]
            if set(flags) - set("fdmu"):
                raise UsageError(f"{a}: the letters after -B are f, d, m and u")
            out["binary"] = {"size": 4 if "f" in flags else 8 if "d" in flags else 0, "mask": "m" in flags, "unscaled": "u" in flags, "file": value(a)}
        elif not a.startswith("-"):
            out["dataset"] = a
        at += 1
    if (out["count"] or out["idxstats"]) and (out["fields"] or out["index"] or out["binary"]):
        raise UsageError("-count and -idxstats stand without -fields, -index and -B")
    return out


def _log(args: list[str], began: float, code: int) -> None:
    """A line about each run, in a file of its own in the folder that KEYLOOM_LOG names."""
    if folder := os.environ.get("KEYLOOM_LOG"):
        line = f"{time.strftime('%Y-%m-%dT%H:%M:%S')}\t{getpass.getuser()}\t{socket.gethostname()}\t{time.time() - began:.2f}\t{code}\t{' '.join(args)}\n"
        files.write(files.join(folder, f"{time.time_ns()}-{uuid.uuid4().hex[:8]}.log"), line.encode())


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    args = list(sys.argv[1:] if args is None else args)
    began, out = time.time(), out or sys.stdout
    code = 1
    try:
        code = _run(args, spark, out)
    except ValueError as error:
        print(f"keyloom: {error}", file=sys.stderr)
    _log(args, began, code)
    return code


def _run(args: list[str], spark: SparkSession | None, out) -> int:
    o = parse(args)
    if o["version"]:
        print(__version__, file=out)
        return 0
    if not (o["dataset"] or o["files"]):
        print(__doc__, file=sys.stderr)
        return 1
    catalog = Catalog.from_files(o["files"]) if o["files"] else Catalog.load(o["dataset"])
    spark = spark or SparkSession.builder.appName("keyloom").getOrCreate()
    place = files.absolute(o["files"][0] if o["files"] else o["dataset"])
    indexes = Indexes(spark, catalog, files.join(place if files.is_folder(place) else files.folder_of(place), ".keyloom_index"))
    if o["index"] is not None:
        indexes.build(o["index"])
        return 0
    if o["count"]:
        for r in indexes.rough_count(o["select"]).collect():
            print(f"{r['table']}\t{r['records']}\t{r['indexed_percent']:.0f}%", file=out)
        return 0
    if o["idxstats"]:
        for r in indexes.statistics().orderBy("table", "field", "element").collect():
            print(f"{r['table']}\t{r['field']}\t{r['element']}\t{r['records']}\t{r['indexed_percent']:.0f}%", file=out)
        return 0
    if not o["fields"]:
        return 1
    binary = o["binary"]
    query = Engine(spark, catalog, indexes).plan(o["fields"], o["select"], bool(binary and binary["unscaled"]))
    if not binary or not binary["size"]:
        write_tsv(query, out)
        return 0
    target = nullcontext(getattr(out, "buffer", out)) if binary["file"] == "-" else files.open_output(binary["file"])
    with target as f:
        write_binary(query, f, binary["size"], binary["mask"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
