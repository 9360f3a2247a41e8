"""Tables from decoded files: resources, object records, edges, handlers, instructions, layers, parts, texts, results.

Every operator maps rows of files to rows, without a shuffle; a file that can't be read is a row with
its error in `results` and has none elsewhere. Only the columns that an operator needs are read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from palimpsest.functions import forks, projects, rebuild, records, source, stacks
from palimpsest.plans import shapes


def _flat(files: DataFrame, rows: Callable[[bytes, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    names = ["file_id", *(c.split()[0] for c in schema.split(", "))]

    def go(batches):
        for pdf in batches:
            for ident, data, rsrc in zip(pdf["file_id"], pdf["data"], pdf["rsrc"]):
                try:
                    made = [(ident, *r) for r in rows(bytes(data or b""), bytes(rsrc or b""))]
                except (ValueError, IndexError, RecursionError, struct.error):
                    continue
                if made:
                    yield pd.DataFrame(made, columns=names)

    return files.select("file_id", "data", "rsrc").mapInPandas(go, f"file_id string, {schema}")


def script_bytes(data: bytes, rsrc: bytes) -> bytes:
    """The compiled script of a file: in its data, else in its resource fork."""
    if forks.fasd_header(data) or not rsrc:
        return data
    return forks.script_resource(rsrc) or data


def resources(files: DataFrame) -> DataFrame:
    return _flat(files, lambda d, r: ((k, *x) for k, x in enumerate(forks.resources(r))), "ord int, type string, id int, name string, data binary")


def objects(files: DataFrame) -> DataFrame:
    def rows(d, r):
        for o in records.records(records.body(script_bytes(d, r))[1]):
            yield o.pos, o.typ, o.ref, o.size, o.kind, o.flags, o.start, o.end, list(o.refs), o.data

    return _flat(files.where("kind = 'script'"), rows, "pos long, typ int, ref int, size int, kind int, flags int, code_start int, code_end int, refs array<int>, data binary")


def nodes(objs: DataFrame) -> DataFrame:
    """Syntax nodes: objects of type 13, the last of a reference."""
    last = objs.where("typ = 13").groupBy("file_id", "ref").agg(F.max_by(F.struct("kind", "flags", "code_start", "code_end", "refs"), "pos").alias("n"))
    return last.select("file_id", "ref", F.chr(F.col("n.kind").cast("long")).alias("letter"), "n.flags", "n.code_start", "n.code_end", "n.refs")


def edges(objs: DataFrame) -> DataFrame:
    return objs.select("file_id", F.col("ref").alias("src"), F.posexplode("refs").alias("ord", "dst"))


def roots(objs: DataFrame) -> DataFrame:
    """Nodes to which nothing refers."""
    return nodes(objs).join(edges(objs).select("file_id", F.col("dst").alias("ref")).distinct(), ["file_id", "ref"], "left_anti")


def run_only(objs: DataFrame) -> DataFrame:
    """Scripts whose root's second reference is a symbol: they were saved without their tree."""
    second = objs.where("ref = 0 and size(refs) > 1").select("file_id", F.col("refs")[1].alias("ref"))
    return second.join(objs.where("typ = 1").select("file_id", "ref").distinct(), ["file_id", "ref"], "left_semi").select("file_id").distinct()


def _handlers(d: bytes, r: bytes, encoding: str | None = None) -> list[records.Handler]:
    rows = records.records(records.body(script_bytes(d, r))[1])
    with records.reading(rows, encoding):
        return records.Graph(rows).handlers()


def handlers(files: DataFrame) -> DataFrame:
    def rows(d, r):
        for k, h in enumerate(_handlers(d, r)):
            yield k, records.shown(h.name), [records.shown(p) for p in h.params], h.vars, [records.shown(x) for x in h.literals], h.code

    return _flat(files.where("kind = 'script'"), rows, "h_ord int, name string, params array<string>, vars array<string>, literals array<string>, code binary")


def instructions(files: DataFrame) -> DataFrame:
    def rows(d, r):
        for k, h in enumerate(_handlers(d, r)):
            for i in records.instructions(h.code)[0]:
                yield k, i.off, i.op, i.name, i.args, i.size, i.target, records.operands(h, i)

    return _flat(files.where("kind = 'script'"), rows, "h_ord int, off int, op int, name string, args array<int>, size int, target int, note string")


def invalid_branches(code: DataFrame) -> DataFrame:
    """Branches that lead to no instruction of their handler, nor to its end."""
    key = ["file_id", "h_ord", "target"]
    ends = code.groupBy("file_id", "h_ord").agg(F.max(F.col("off") + F.col("size")).alias("target"))
    starts = code.select("file_id", "h_ord", F.col("off").alias("target")).unionByName(ends)
    return code.where("target is not null").join(starts.distinct(), key, "left_anti")


def layers(files: DataFrame) -> DataFrame:
    def rows(d, r):
        s = stacks.parse(d, r)
        for k, x in enumerate([*s.backgrounds, *s.cards]):
            yield k, x.kind, x.ident, x.name, x.script.text, x.script.language, x.script.compiled, x.background

    return _flat(files.where("kind = 'stack'"), rows, "ord int, kind string, id int, name string, script string, language string, compiled binary, background_id int")


def parts(files: DataFrame) -> DataFrame:
    def rows(d, r):
        s = stacks.parse(d, r)
        for x in [*s.backgrounds, *s.cards]:
            for k, p in enumerate(x.parts):
                yield x.kind, x.ident, k, p.ident, p.kind, p.name, p.script.text, p.script.language, p.script.compiled, p.font

    return _flat(files.where("kind = 'stack'"), rows, "layer_kind string, layer_id int, ord int, id int, kind string, name string, script string, language string, compiled binary, font int")


def texts(files: DataFrame) -> DataFrame:
    def rows(d, r):
        s = stacks.parse(d, r)
        for x in [*s.backgrounds, *s.cards]:
            for k, (p, t, shared) in enumerate(x.texts):
                yield x.kind, x.ident, k, p.ident if p else None, shared, t

    return _flat(files.where("kind = 'stack'"), rows, "layer_kind string, layer_id int, ord int, part_id int, shared boolean, text string")


def project_layers(files: DataFrame) -> DataFrame:
    def rows(d, r):
        p = projects.parse(d)
        at = {id(w): k for k, w in enumerate(p.windows)}
        for name, w, x in projects.layers(p):
            if x is not None:
                yield at.get(id(w)), x.kind, x.ident, name, x.script, x.background.ident if x.background else None

    return _flat(files.where("kind = 'project'"), rows, "window_ord int, kind string, id int, name string, script string, background_id int")


def project_objects(files: DataFrame) -> DataFrame:
    def rows(d, r):
        for name, _, x in projects.layers(projects.parse(d)):
            for k, (t, own) in enumerate(zip(x.things, projects.labels(x)) if x else ()):
                yield name, x.kind, k, t.ident, t.kind, own, t.script, t.text

    return _flat(files.where("kind = 'project'"), rows, "layer string, layer_kind string, ord int, id int, kind string, name string, script string, text string")


EXTENSIONS = {("script", "decompile"): ".applescript", ("script", "bytecode"): ".applescript", ("stack", "decompile"): ".hypertalk", ("script", "disasm"): ".disasm.txt", ("stack", "text"): ".text.txt", ("project", "decompile"): ".supertalk", ("project", "text"): ".text.txt", ("text", "decompile"): ".applescript", ("jxa", "decompile"): ".js", ("script", "tree"): ".tree.txt"}


def compiled_source(b: bytes, dictionaries: dict | None = None, encoding: str | None = None) -> str:
    """A compiled script inside another file as text, or a comment that says what was wrong."""
    try:
        return source.decompile(b, dictionaries, encoding)
    except (ValueError, IndexError) as e:
        return f"-- (a compiled script that can't be read: {e})"


def output(kind: str, command: str, data: bytes, rsrc: bytes, dictionaries: dict | None = None, encoding: str | None = None) -> tuple[str | None, str | None]:
    """A file's output and error for a command; neither if the command isn't for its kind."""
    try:
        if kind == "stack" and command == "decompile":
            return stacks.scripts_listing(stacks.parse(data, rsrc, encoding), lambda b: compiled_source(b, dictionaries, encoding)), None
        if kind == "script" and command == "decompile":
            return source.decompile(script_bytes(data, rsrc), dictionaries, encoding), None
        if kind == "stack" and command == "text":
            return stacks.text_listing(stacks.parse(data, rsrc, encoding)), None
        if kind == "project" and command == "decompile":
            return projects.scripts_listing(projects.parse(data, encoding)), None
        if kind == "project" and command == "text":
            return projects.text_listing(projects.parse(data, encoding)), None
        if kind == "script" and command == "disasm":
            return records.disassembly(_handlers(data, rsrc, encoding)), None
        if kind == "text" and command == "decompile":
            return data.decode("utf-8"), None
        if kind == "jxa" and command == "decompile":
            return forks.jxa(data), None
        if kind == "script" and command == "bytecode":
            return rebuild.from_bytecode(script_bytes(data, rsrc), dictionaries, encoding), None
        if kind == "script" and command == "tree":
            return records.tree(records.records(records.body(script_bytes(data, rsrc))[1])), None
    except (ValueError, IndexError, RecursionError, struct.error) as e:
        return None, str(e) or type(e).__name__
    return None, None


def results(files: DataFrame, command: str, dictionaries: dict | None = None, encoding: str | None = None) -> DataFrame:
    """file_id, rel, cmd, out, ext, error, skipped: one row per file. dictionaries: as
    terms.dictionaries makes them; encoding: of all old text, instead of the one that a file shows."""

    def go(batches):
        for pdf in batches:
            made = [(None, e) if e is not None else output(k, command, bytes(d or b""), bytes(r or b""), dictionaries, encoding) for k, d, r, e in zip(pdf["kind"], pdf["data"], pdf["rsrc"], pdf["error"])]
            yield pd.DataFrame({
                "file_id": pdf["file_id"], "rel": pdf["rel"], "cmd": command, "out": [o for o, _ in made],
                "ext": [EXTENSIONS.get((k, command)) if o is not None else None for k, (o, _) in zip(pdf["kind"], made)],
                "error": [e for _, e in made], "skipped": [o is None and e is None for o, e in made],
            })

    return files.select("file_id", "rel", "kind", "data", "rsrc", "error").mapInPandas(go, "file_id string, rel string, cmd string, out string, ext string, error string, skipped boolean")


def status(done: DataFrame) -> DataFrame:
    """0 if no file has an error, else 1."""
    return shapes.statuses(done, None, F.col("error").isNotNull())


def outcomes(done: DataFrame) -> DataFrame:
    """outcome, n: how many results failed, were skipped, are plain text, or passed. done: of results, with kind."""
    return shapes.outcomes(done.withColumn("plain", F.col("kind") == "text") if "kind" in done.columns else done.withColumn("plain", F.lit(False)))


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """rel, cmd, diff: a unified diff of each output that changed between two runs of results, or is in one
    alone. Outputs meet by name; the lines of a file are compared in order, within its row."""
    from difflib import unified_diff

    def compare(pdf_batches):
        for pdf in pdf_batches:
            made = ["\n".join(unified_diff((a or "").splitlines(), (b or "").splitlines(), "before", "after", lineterm="")) for a, b in zip(pdf["a"], pdf["b"])]
            yield pdf[["rel", "cmd"]].assign(diff=made)

    side = lambda df, n: df.where("out is not null").select("rel", "cmd", F.col("out").alias(n))
    both = side(before, "a").join(side(after, "b"), ["rel", "cmd"], "full").where("not a <=> b")
    return both.mapInPandas(compare, "rel string, cmd string, diff string")


def cards_told(files: DataFrame) -> DataFrame:
    """n_cards, the number of cards that each stack's header tells."""

    def rows(d, r):
        told = stacks.parse(d, r).told_cards
        if told is not None:
            yield (told,)

    return _flat(files.where("kind = 'stack'"), rows, "n_cards int")


def cards_missing(files: DataFrame) -> DataFrame:
    """file_id, told, found: stacks whose header tells another number of cards than are found."""
    return shapes.disagreeing(cards_told(files), layers(files).where("kind = 'card'"), "file_id", "n_cards")


def _safe(part):
    """Unsafe signs and trailing dots and spaces become underscores."""
    name = F.regexp_replace(part, r'[\x00-\x1F\x7F/\\:*?"<>|]', "_")
    tail = F.regexp_extract(name, r"[. ]*$", 0)
    name = F.concat(F.regexp_replace(name, r"[. ]+$", ""), F.repeat(F.lit("_"), F.length(tail)))
    return F.when(name == "", "_").otherwise(name)


def safe_name(rel):
    """A file's path for its output: every part made safe, a script's ending taken off the last."""
    plain = F.regexp_replace(rel, r"\.(scpt|scptd|app)$", "")
    return F.array_join(F.transform(F.split(plain, "/"), _safe), "/")


def write_results(done: DataFrame, folder: str) -> None:
    """Outputs as Parquet under their paths, which keep the input's folders; of equal paths the last in
    the walk's order stays."""
    named = done.where("out is not null").withColumn("file", F.concat(safe_name(F.col("rel")), "ext"))
    named.groupBy("cmd", "file").agg(F.max_by("out", "rel").alias("out")).write.mode("overwrite").partitionBy("cmd").parquet(folder)


def write_files(done: DataFrame, folder: str) -> DataFrame:
    """The same as files below a folder that all executors see: each output at its own path. Returns
    cmd, file, bytes written. A task that is run again writes the same files again."""
    named = done.where("out is not null").withColumn("file", F.concat(safe_name(F.col("rel")), "ext"))
    last = named.groupBy("cmd", "file").agg(F.max_by("out", "rel").alias("out"))

    def put(batches):
        import os

        for pdf in batches:
            sizes = []
            for file, out in zip(pdf["file"], pdf["out"]):
                path = os.path.join(folder, *(x if x not in (".", "..") else "_" for x in file.split("/")))
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(f"{path}.part", "wb") as f:
                    sizes.append(f.write(out.encode("utf-8", "surrogatepass")))
                os.replace(f"{path}.part", path)
            yield pdf[["cmd", "file"]].assign(bytes=sizes)

    return last.mapInPandas(put, "cmd string, file string, bytes long")


def deduped(files: DataFrame) -> DataFrame:
    return shapes.dedupe(files.where("error is null"), "data", "rel")
