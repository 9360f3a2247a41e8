"""Folders of files as a DataFrame: every file with both forks, files on disk images included.

Spark's own binaryFile passes over all names that begin with a dot or underscore, and with them the
sidecars that carry resource forks, so folders are listed here: the folders of one level are
parted over tasks, each of which lists its own, level by level; no listing of files meets the
driver. The files are then read by their tasks, images by seeking in them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.functions import forks, images

MOST = 64 << 20
DEEPEST = 3
FILES = "file_id string, path string, rel string, walk_ord string, depth int, parent_file_id string, volume string, name string, type string, creator string, data binary, rsrc binary, kind string, error string"


def sidecars(path: str) -> list[str]:
    """Where a file's resource fork may be kept beside it: ._name, then in __MACOSX of each folder above."""
    folder, name = os.path.split(os.path.abspath(path))
    out, rel = [os.path.join(folder, "._" + name)], ""
    while True:
        out.append(os.path.join(folder, "__MACOSX", rel, "._" + name))
        up, last = os.path.split(folder)
        if up == folder:
            return out
        folder, rel = up, os.path.join(last, rel)


def _bytes(path: str) -> bytes | None:
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


def read_file(path: str) -> forks.Forked:
    """A file with its name, and the resource fork, type and creator of its own or of a sidecar."""
    with open(path, "rb") as f:
        out = forks.Forked(os.path.basename(path), data=f.read())
    if own := _bytes(path + "/..namedfork/rsrc"):
        out.rsrc = own
        return out
    for p in sidecars(path):
        if (b := _bytes(p)) and (double := forks.apple_single(b)):
            out.rsrc, out.type, out.creator = double.rsrc, double.type, double.creator
            break
    return out


def bundle(path: str) -> str:
    """The script in a bundle that is named itself."""
    if path.rstrip("/").endswith((".scptd", ".app")) and os.path.isdir(path):
        return os.path.join(path, *"Contents/Resources/Scripts/main.scpt".split("/"))
    return path


def _open_image(part: images.Part, rsrc: bytes = b"") -> list[images.Volume] | None:
    """The volumes, or None if this is no image. A script or stack is none, whatever its bytes say by chance."""
    if forks.kind(part.read(0, 16)) in ("script", "jxa", "stack"):
        return None
    try:
        return images.volumes(part, rsrc)
    except images.NotAnImage:
        return None


def _row(ident: str, path: str, rel: str, order: str, depth: int, parent: str | None, volume: str | None, f: forks.Forked | None, error: str | None = None) -> tuple:
    if f is None:
        return (ident, path, rel, order, depth, parent, volume, os.path.basename(rel), "", "", b"", b"", "error", error)
    inner = forks.unwrap(f.data) if not f.rsrc else None
    use = inner if inner and (inner.data or inner.rsrc) else f
    return (ident, path, rel, order, depth, parent, volume, f.name, use.type or f.type, use.creator or f.creator, use.data, use.rsrc, forks.kind(use.data, use.rsrc), error)


def _on_volumes(vols: list[images.Volume], path: str, rel: str, order: str, depth: int, parent: str) -> Iterator[tuple]:
    n = 0
    for v in vols:
        for f in v.files:
            inside = f"{rel}/{v.name}/" + "/".join(f.path)
            ident, own, n = f"{parent}!{n}", f"{order}!{n:08d}", n + 1
            try:
                if max(f.data.size, f.rsrc.size) > MOST:
                    continue
                got = forks.Forked(f.path[-1], f.type, f.creator, v.read_data(f, MOST), v.read_rsrc(f, MOST))
            except (ValueError, IndexError) as e:
                yield _row(ident, path, inside, own, depth, parent, v.name, None, str(e))
                continue
            nested = None
            if depth < DEEPEST:
                try:
                    nested = _open_image(images.Part.of(got.data), got.rsrc)
                except ValueError as e:
                    yield _row(ident, path, inside, own, depth, parent, v.name, None, str(e))
                    continue
            if nested is not None:
                yield from _on_volumes(nested, path, inside, own, depth + 1, ident)
            else:
                yield _row(ident, path, inside, own, depth, parent, v.name, got)


def read_path(path: str, rel: str) -> Iterator[tuple]:
    """The rows of one file: itself, or all files on the volumes of an image."""
    try:
        with open(path, "rb") as handle:
            try:
                vols = _open_image(images.Part(handle))
            except ValueError as e:
                yield _row(rel, path, rel, rel, 0, None, None, None, str(e))
                return
            if vols is not None:
                yield from _on_volumes(vols, path, rel, rel, 1, rel)
                return
            if os.fstat(handle.fileno()).st_size > MOST:
                return
        f = read_file(path)
        nested = _open_image(images.Part.of(f.data), f.rsrc) if f.rsrc else None
        if nested is not None:
            yield from _on_volumes(nested, path, rel, rel, 1, rel)
        else:
            yield _row(rel, path, rel, rel, 0, None, None, f)
    except (OSError, ValueError) as e:
        yield _row(rel, path, rel, rel, 0, None, None, None, str(e))


def _list(folder: str) -> tuple[list[str], list[str]]:
    """Folders and files in a folder; not dot folders, __MACOSX, sidecars, .DS_Store, or what is no regular file."""
    folders, files = [], []
    try:
        with os.scandir(folder) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    if not e.name.startswith(".") and e.name != "__MACOSX":
                        folders.append(e.path)
                elif e.is_file(follow_symlinks=False) and not e.name.startswith("._") and e.name != ".DS_Store":
                    files.append(e.path)
    except OSError:
        pass
    return folders, files


def paths(spark: SparkSession, root: str, cut=None) -> DataFrame:
    """path, rel of all files below root. cut: writes a level and reads it back, to keep plans short."""
    top = os.path.abspath(root)
    if not os.path.isdir(top):
        return spark.createDataFrame([(bundle(top), os.path.basename(top))], "path string, rel string")
    base = os.path.dirname(top)

    def step(batches):
        for pdf in batches:
            rows = []
            for folder in pdf["path"]:
                down, files = _list(folder)
                rows += [(p, True) for p in down] + [(p, False) for p in files]
            yield type(pdf)(rows, columns=["path", "is_dir"])

    level = spark.createDataFrame([(top,)], "path string")
    found = None
    while True:
        here = level.mapInPandas(step, "path string, is_dir boolean")
        here = cut(here) if cut else here.persist()
        files = here.where("not is_dir").select("path")
        found = files if found is None else found.unionByName(files)
        level = here.where("is_dir").select("path").repartition("path")
        if not level.limit(1).count():
            break
    return found.select("path", F.expr(f"substring(path, {len(base.rstrip('/')) + 2})").alias("rel"))


def files(spark: SparkSession, root: str, cut=None) -> DataFrame:
    """One row per file below root, in FILES' columns; what can't be read is a row with its error."""

    def read(batches):
        import pandas as pd

        columns = [c.split()[0] for c in FILES.split(", ")]
        for pdf in batches:
            for path, rel in zip(pdf["path"], pdf["rel"]):  # one file's rows at a time bound the memory
                for row in read_path(path, rel):
                    yield pd.DataFrame([row], columns=columns)

    return paths(spark, root, cut).repartition("path").mapInPandas(read, FILES)
