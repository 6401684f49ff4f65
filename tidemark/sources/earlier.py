"""Earlier versions of files, from a git repository or from a table.

A revision is pinned to a commit first; an unknown one is an error, never an empty answer. Paths
are read by ``git cat-file --batch`` children, ``AT_ONCE`` paths each, so that few contents are
held at a time; a path the commit does not have gives a null content. The repository has to be
readable where the tasks run; paths are relative to the folder given, inside the repository.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Paths that one child is asked for.
AT_ONCE = 200


class UnknownRevision(ValueError):
    pass


def pin(repository: str, revision: str) -> str:
    done = subprocess.run(["git", "-C", repository, "rev-parse", "--verify", "--quiet", "--end-of-options", revision + "^{commit}"], capture_output=True, text=True)
    if done.returncode or not done.stdout.strip():
        raise UnknownRevision(f"{revision} names no commit of {repository}")
    return done.stdout.strip()


def prefix(folder: str) -> str:
    """Where a folder lies in its repository, with a slash at the end; empty for the top."""
    done = subprocess.run(["git", "-C", folder, "rev-parse", "--show-prefix"], capture_output=True, text=True, check=True)
    return done.stdout.rstrip("\n")


def _blobs(repository: str, commit: str, paths: list[str]) -> list[bytes | None]:
    """Contents in the order of the paths, over one child. Names that hold a line end are asked
    for one by one."""
    out: list[bytes | None] = []
    plain = [p for p in paths if "\n" not in p]
    asked = "".join(f"{commit}:{p}\n" for p in plain).encode()
    got = subprocess.run(["git", "-C", repository, "cat-file", "--batch"], input=asked, capture_output=True, check=True).stdout
    at, found = 0, {}
    for p in plain:
        end = got.index(b"\n", at)
        head = got[at:end].split(b" ")
        at = end + 1
        if len(head) >= 3 and head[-2] in (b"blob", b"tree", b"commit", b"tag") and head[-1].isdigit():
            size = int(head[-1])
            found[p] = got[at : at + size] if head[-2] == b"blob" else None
            at += size + 1
    for p in paths:
        if "\n" in p:
            one = subprocess.run(["git", "-C", repository, "show", f"{commit}:{p}"], capture_output=True)
            found[p] = one.stdout if not one.returncode else None
        out.append(found.get(p))
    return out


def git_files(paths: DataFrame, repository: str, revision: str) -> DataFrame:
    """(path) to (path, content) as the revision has them."""
    commit = pin(repository, revision)
    below = prefix(repository)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                names = part.column("path").to_pylist()
                contents = iter(_blobs(repository, commit, [below + n for n in names if n]))
                yield pa.RecordBatch.from_arrays([part.column("path"), pa.array([next(contents) if n else None for n in names], pa.binary())], ["path", "content"])

    return paths.select("path").mapInArrow(run, "path string, content binary")


def table_files(paths: DataFrame, versions: DataFrame) -> DataFrame:
    """The same from a table (path, content)."""
    return paths.select("path").join(versions.select("path", "content"), "path", "left")


def config_texts(earlier: DataFrame) -> dict[str, str]:
    """Texts of the JSON files among earlier versions, as the analysis takes them."""
    rows = earlier.where(F.col("path").endswith(".json") & F.col("content").isNotNull()).collect()
    out = {}
    for r in rows:
        try:
            out[r["path"]] = bytes(r["content"]).decode()
        except UnicodeDecodeError:
            continue
    return out
