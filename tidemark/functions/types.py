"""Lines of TypeScript that leave nothing behind: declarations of types, imports of types."""

from __future__ import annotations

import re

from tidemark.sources.scan import TOKENS

START = re.compile(r"^[ \t]*(?:export[ \t]+)?(?:declare[ \t]+)?(?:interface[ \t]+[\w$]|type[ \t]+[\w$]+[ \t]*(?:<[^=;{]*>)?[ \t]*=|declare[ \t]|(?:import|export)[ \t]+type[ \t]+[\w$*{])", re.M)


def _end(text: str, at: int) -> int:
    """Where a statement ends: a semicolon or line end outside of brackets, or the closing brace
    of a block; a line that goes on with an operator does not end."""
    depth, i, block = 0, at, text.startswith("interface", at) or re.match(r"(?:export\s+)?(?:declare\s+)?(?:interface|namespace|module|global|class|enum)\b", text[at:].lstrip())
    while i < len(text):
        c = text[i]
        if c in "{([":
            depth += 1
        elif c in "})]":
            depth -= 1
            if not depth and c == "}" and block:
                return i + 1
        elif depth <= 0 and c == ";":
            return i + 1
        elif depth <= 0 and c == "\n" and not re.match(r"\s*[|&?:=.]|\s*extends\b", text[i:]) and not re.search(r"[=|&,:?]\s*$", text[at:i]):
            return i
        i += 1
    return len(text)


def erased(text: str) -> str:
    """The text with type-only statements blanked, line ends kept."""
    hidden = TOKENS.sub(lambda m: re.sub(r"[^\n]", "x", m[0]), text)
    out, at = [], 0
    for m in START.finditer(hidden):
        if m.start() < at:
            continue
        end = _end(hidden, m.start())
        out += [text[at : m.start()], re.sub(r"[^\n]", " ", text[m.start() : end])]
        at = end
    return "".join(out) + text[at:]


def runs_nothing(text: str, start: int, length: int, lines: list[str] | None = None) -> bool:
    """Whether none of these lines (1-based) leaves anything; a deletion is never nothing."""
    lines = erased(text).split("\n") if lines is None else lines
    return length > 0 and all(not x.strip() for x in lines[start - 1 : start - 1 + length])
