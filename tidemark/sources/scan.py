"""What source files ask for: specifiers of scripts and stylesheets, in order, each once.

This is a scanner, not a parser: comments go, strings stay, and the forms that name another
file are looked for. Whatever it cannot read it over-reports rather than leaves out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.functions.text import SOURCES, STYLES

TOKENS = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/", re.S)
STRING = r"(?:\"([^\"\n]*)\"|'([^'\n]*)'|`([^`$\n]*)`)"
RELATIVE = r"(?:\"(\.[^\"\n]*)\"|'(\.[^'\n]*)'|`(\.[^`$\n]*)`)"
FORMS = (
    re.compile(r"\bimport\b(?!\s*[.(])([^'\"`;]*?\bfrom\b)?\s*" + STRING),
    re.compile(r"\bexport\b([^'\"`;=()]*?\bfrom\b)\s*" + STRING),
    re.compile(r"\bimport()\s*\(\s*" + STRING + r"\s*[,)]"),
    re.compile(r"\brequire()\s*\(\s*" + STRING + r"\s*,?\s*\)"),
    re.compile(r"\brequire\.(?:resolve|context)()\s*\(\s*" + STRING),
    re.compile(r"\bnew\s+URL()\s*\(\s*" + RELATIVE + r"\s*,"),
)
STYLE_RULE = re.compile(r"@(?:use|forward|import)\b([^;{}\n]*)")


def _without_comments(text: str) -> str:
    return TOKENS.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][:2] in ("//", "/*") else m[0], text)


def _only_types(clause: str) -> bool:
    """``type X from``, or braces in which every name is a type."""
    clause = clause.strip()
    if re.match(r"type\b(?!\s*(?:,|from\b))", clause):
        return True
    named = re.fullmatch(r"\{(.*)\}\s*from", clause, re.S)
    names = [n.strip() for n in named[1].split(",") if n.strip()] if named else []
    return bool(names) and all(re.match(r"type\s+[\w$]", n) for n in names)


def script_sources(text: str, include_types: bool = False) -> list[str]:
    text = _without_comments(text)
    found = []
    for form in FORMS:
        for m in form.finditer(text):
            clause, spec = m[1] or "", next((g for g in m.groups()[1:] if g is not None), "")
            if spec and (include_types or not _only_types(clause)):
                found.append((m.start(), spec))
    return list(dict.fromkeys(s for _, s in sorted(found)))


def style_sources(text: str) -> list[str]:
    text = TOKENS.sub(lambda m: " " if m[0][:2] in ("//", "/*") else m[0], text)
    found = []
    for rule in STYLE_RULE.finditer(text):
        for m in re.finditer(r"url\(\s*['\"]?([^'\")]+)['\"]?\s*\)|\"([^\"]+)\"|'([^']+)'", rule[1]):
            found.append((rule.start() + m.start(), next(g for g in m.groups() if g)))
    return list(dict.fromkeys(s for _, s in sorted(found)))


def sources(path: str, content: bytes | None, include_types: bool = False) -> list[str]:
    """What a file asks for; leaves and files that are no text ask for nothing."""
    kind = path.rpartition(".")[2]
    if content is None or kind not in SOURCES + STYLES:
        return []
    try:
        text = content.decode()
    except UnicodeDecodeError:
        return []
    return style_sources(text) if kind in STYLES else script_sources(text, include_types)


def scan_files(files: DataFrame, include_types: bool = False) -> DataFrame:
    """(path, content) to (path, specifier, ord)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, s, i) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) for i, s in enumerate(sources(p, c, include_types))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], ["path", "specifier", "ord"])

    return files.select("path", "content").mapInArrow(run, "path string, specifier string, ord long")
