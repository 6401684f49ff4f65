"""Unified diffs as rows: changed files with the line runs they have after the change.

Runs come from the bodies of hunks, so that context lines are no change. A deletion is a run of
no lines at the place where the lines were. A file without any run (a mode change, a rename
alone, binary content) is ``opaque``: all of it counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.functions.text import SOURCES

HUNK = re.compile(r"@@+ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? ")
PRAGMA = re.compile(r"@jsx(?:Frag|ImportSource|Runtime)?(?:\s|$)")
SCHEMA = "diff_id string, path string, change string, start long, length long, added boolean, renamed_from string"


@dataclass
class Entry:
    path: str
    change: str = "modified"
    runs: list[tuple[int, int]] = field(default_factory=list)
    added: bool = False
    renamed_from: str | None = None
    pragma: bool = False

    def touch(self, start: int, length: int) -> None:
        if self.runs:
            at, n = self.runs[-1]
            if (at, n) == (start, length):
                return
            if n and length and at + n == start:
                self.runs[-1] = (at, n + length)
                return
        self.runs.append((start, length))

    def settled(self) -> Entry:
        if self.change == "modified" and (not self.runs or self.pragma and self.path.rpartition(".")[2] in SOURCES):
            self.change, self.runs = "opaque", []
        if self.change != "modified":
            self.runs = []
        return self


def plain_path(field_: str) -> str:
    """A path as a header gives it: quotes and escapes undone, timestamp and a/ or b/ gone."""
    text = field_.split("\t")[0].strip()
    if len(text) > 1 and text[0] == text[-1] == '"':
        text = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.S)
    return text[2:] if text[:2] in ("a/", "b/") else text


def _header_path(rest: str) -> str:
    quoted = re.search(r' ("(?:\\.|[^"\\])*")\s*$', rest)
    if quoted:
        return plain_path(quoted[1])
    at = rest.rfind(" b/")
    return plain_path(rest[at + 1 :] if at >= 0 else rest.split()[-1] if rest.split() else "")


def parse_diff(text: str) -> list[Entry]:
    """The files of a diff in its order."""
    out: list[Entry] = []
    now: Entry | None = None
    old_left = new_left = line_no = 0
    creating = False

    def close() -> None:
        if now is not None and now.path:
            now.added = creating
            out.append(now.settled())

    for line in text.splitlines():
        sign = line[:1] or " "
        if (old_left > 0 or new_left > 0) and sign in " +-\\":
            if sign == "\\":
                continue
            old_left -= sign in " -"
            new_left -= sign in " +"
            if now is not None and sign != " ":
                now.touch(line_no, int(sign == "+"))
                now.pragma |= bool(PRAGMA.search(line, 1))
            line_no += sign in " +"
            continue
        old_left = new_left = 0
        word, _, rest = line.partition(" ")
        if line.startswith("diff --git "):
            close()
            now, creating = Entry(_header_path(line[len("diff --git ") :])), False
        elif word == "+++":
            target = plain_path(rest)
            if target == "/dev/null":
                if now is not None:
                    now.change = "deleted"
            elif target:
                now = now or Entry(target)
                now.path = target
        elif line.startswith("new file mode") or word == "---" and plain_path(rest) == "/dev/null":
            creating = True
        elif line.startswith("rename from ") and now is not None:
            now.renamed_from = plain_path(line[len("rename from ") :]) if line.endswith('"') else line[len("rename from ") :].strip()
        elif line.startswith("rename to ") and now is not None:
            target = line[len("rename to ") :].strip()
            now.path = plain_path(target) if target.startswith('"') else target
        elif line.startswith(("Binary files ", "GIT binary patch")):
            if now is not None and now.change != "deleted":
                now.change = "opaque"
        elif hunk := HUNK.match(line + " "):
            old_left, new_left = (int(hunk[i] if hunk[i] is not None else 1) for i in (1, 3))
            line_no = max(1, int(hunk[2]))
    close()
    return out


def diff_files(diffs: DataFrame) -> DataFrame:
    """(diff_id, text) to one row for each run, or one for a file without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("diff_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for e in parse_diff(text or ""):
                    rows += [(key, e.path, e.change, a, n, e.added, e.renamed_from) for a, n in e.runs or [(None, None)]]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(7)], names)

    return diffs.select("diff_id", "text").mapInArrow(run, SCHEMA)
