"""Scalar functions on paths and specifiers, as Columns. Patterns avoid what engines differ in."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that are parsed, and those of files that may be missing.
SOURCES = ("js", "jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts")
STYLES = ("css", "scss", "sass")


def is_source(path: Column) -> Column:
    return path.rlike(r"\.(" + "|".join(SOURCES) + ")$")


def is_style(path: Column) -> Column:
    return path.rlike(r"\.(" + "|".join(STYLES) + ")$")


def is_installed(path: Column) -> Column:
    return F.array_contains(F.split(path, "/"), "node_modules")


def package_name(specifier: Column) -> Column:
    """The scoped or plain package of a specifier; empty if it names none."""
    return F.regexp_extract(specifier, r"^(@[^/]+/[^/]+|[^@./#][^/]*)", 1)


def alias_matches(name: Column, specifier: Column) -> Column:
    """``x$`` is exact, ``x*`` a beginning, ``x`` itself or a directory."""
    return (
        F.when(F.endswith(name, F.lit("$")), F.concat(specifier, F.lit("$")) == name)
        .when(F.endswith(name, F.lit("*")), F.startswith(specifier, F.substring(name, F.lit(1), F.length(name) - 1)))
        .otherwise((specifier == name) | F.startswith(specifier, F.concat(name, F.lit("/"))))
    )


def is_pragma(text: Column) -> Column:
    return text.rlike(r"@jsx(Frag|ImportSource|Runtime)?(\s|$)")


def is_annotation(text: Column) -> Column:
    return text.rlike(r"[#@]__(PURE|NO_SIDE_EFFECTS|INLINE|NOINLINE|KEY)__|@vite-ignore|(webpack|turbopack)[A-Z]")


def normalized(path: Column) -> Column:
    """Without ``.`` and ``..`` where they can be resolved."""
    step = lambda done, part: (
        F.when((part == "") | (part == "."), done)
        .when((part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part)))
    )
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda done, part: F.when(F.size(done) > 0, step(done, part)).otherwise(F.when((part == "") | (part == "."), done).otherwise(F.array(part))))
    return F.array_join(parts, "/")


def glob_to_regex(glob: str) -> str | None:
    """A glob as an anchored pattern; None if it is malformed. Without a slash it matches at any
    depth. ``**`` crosses directories, ``*`` and ``?`` do not; braces and sets are known."""
    if "/" not in glob:
        glob = "**/" + glob
    out, i, braces = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out += "(?:[^/]+/)*"
            i += 3
            continue
        if glob.startswith("**", i):
            out += ".*"
            i += 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            braces += 1
            out += "(?:"
        elif c == "}":
            if not braces:
                return None
            braces -= 1
            out += ")"
        elif c == "," and braces:
            out += "|"
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                return None
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return None if braces else f"^{out}$"
