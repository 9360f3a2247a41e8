"""python -m palimpsest COMMAND [-e ENCODING] [-o FOLDER] PATH... (or with spark-submit)

Runs a command - decompile, bytecode, text, tree, disasm - on files and folders. Prints each output under its
path, or writes all into a folder. `encodings` lists those that -e takes. Exit status: 0, or 1 if
a file could not be read, or 2 for a wrong call.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession, functions as F

from palimpsest.functions.encodings import ENCODINGS, by_name
from palimpsest.operators import decode
from palimpsest.sources import folders

COMMANDS = ("decompile", "bytecode", "text", "tree", "disasm")


def arguments(args: list[str]) -> tuple[str, str | None, str | None, list[str]]:
    """Command, encoding, folder for outputs, paths; options stand anywhere before --. ValueError if wrong."""
    plain, options, rest = [], {"-e": None, "-o": None}, iter(args)
    for a in rest:
        if a == "--":
            plain += rest
        elif a in options:
            options[a] = next(rest, None)
            if options[a] is None:
                raise ValueError(f"{a} needs a value")
        elif a.startswith("-") and a != "-":
            raise ValueError(f"unknown option {a}")
        else:
            plain.append(a)
    if not plain or plain[0] not in (*COMMANDS, "encodings") or plain[0] != "encodings" and len(plain) < 2:
        raise ValueError("a command and a path are needed")
    encoding = by_name(options["-e"]) if options["-e"] else None
    if options["-e"] and not encoding:
        raise ValueError(f"no encoding is called {options['-e']}")
    return plain[0], encoding, options["-o"], plain[1:]


def run(spark: SparkSession, args: list[str], out=sys.stdout, err=sys.stderr) -> int:
    try:
        command, encoding, folder, paths = arguments(args)
    except ValueError as e:
        print(f"{e}\n\n{__doc__}", file=err)
        return 2
    if command == "encodings":
        print("\n".join(f"{short:20} {name}" for name, (short, *_) in ENCODINGS.items()), file=out)
        return 0
    several, status = len(paths) > 1 or os.path.isdir(folders.bundle(paths[0])), 0
    for n, path in enumerate(paths):
        if not os.path.exists(path):
            print(f"{path}: no such file", file=err)
            status = 1
            continue
        done = decode.results(folders.files(spark, path), command, encoding=encoding).persist()
        explicit = not os.path.isdir(folders.bundle(path))
        wrong = done.where("error is not null" + (" or skipped" if explicit else "")).select("rel", F.coalesce("error", F.lit(f"{command} is not for such a file")).alias("error"))
        for r in wrong.orderBy("rel").toLocalIterator():
            print(f"{r['rel']}: {r['error']}", file=err)
            status = 1
        if folder:
            decode.write_results(done, os.path.join(folder, str(n)) if len(paths) > 1 else folder)
        else:  # row by row: outputs never gather in the driver
            for r in done.where("out is not null").orderBy("rel").toLocalIterator():
                out.write(f"==> {r['rel']} <==\n{r['out']}\n" if several else r["out"])
        done.unpersist()
    return status


if __name__ == "__main__":
    session = SparkSession.builder.appName("palimpsest").config("spark.ui.enabled", "false").getOrCreate()
    code = run(session, sys.argv[1:])
    session.stop()
    sys.exit(code)
