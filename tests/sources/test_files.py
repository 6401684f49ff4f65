import pytest

from tidemark.functions.types import erased, runs_nothing
from tidemark.sources import config, lockfile, scan

PNPM = """lockfileVersion: '9.0'

packages:

  '@scope/a@1.0.0':
    resolution: {integrity: x}

  plain@2.0.0(peer@1.0.0):
    resolution: {integrity: y}
  short@1.0.0: {}

snapshots:

  plain@2.0.0:
    dependencies:
      other: 1.0.0
---
patchedDependencies:
  fixed@3.1.0:
    hash: z
"""
NPM = """{
  "name": "app",
  "packages": {
    "": {
      "dependencies": { "react": "^1.0.0" }
    },
    "node_modules/react": {
      "version": "1.0.0",
      "dependencies": {
        "x": "1"
      }
    },
    "node_modules/react/node_modules/@s/deep": {
      "version": "2.0.0"
    }
  }
}
"""


def test_lock_entries(spark):
    files = spark.createDataFrame([("pnpm-lock.yaml", PNPM), ("a/package-lock.json", NPM), ("other.json", NPM)], "path string, text string")
    got = sorted((r["path"], r["start"], r["end"], r["package"]) for r in lockfile.lock_entries(files).collect())
    assert got == [
        ("a/package-lock.json", 7, 11, "react"),
        ("a/package-lock.json", 13, 14, "@s/deep"),
        ("pnpm-lock.yaml", 5, 7, "@scope/a"),
        ("pnpm-lock.yaml", 8, 9, "plain"),
        ("pnpm-lock.yaml", 10, 11, "short"),
        ("pnpm-lock.yaml", 19, 20, "fixed"),
    ]


def test_changed_packages(spark):
    files = spark.createDataFrame([("pnpm-lock.yaml", PNPM), ("b/pnpm-lock.yaml", "junk\n")], "path string, text string")
    change = lambda *rows: {r["package"] for r in lockfile.changed_packages(files, spark.createDataFrame(rows, "path string, change string, start long, length long")).collect()}
    assert change(("pnpm-lock.yaml", "modified", 9, 1)) == {"plain"}
    assert change(("pnpm-lock.yaml", "modified", 7, 0), ("pnpm-lock.yaml", "modified", 15, 2)) == {"@scope/a"}
    assert change(("pnpm-lock.yaml", "opaque", None, None)) == {"@scope/a", "plain", "short", "fixed"}
    assert change(("b/pnpm-lock.yaml", "modified", 1, 1)) == {None}
    assert change(("pnpm-lock.yaml", "deleted", None, None), ("x.ts", "modified", 1, 1)) == set()


def test_script_sources():
    text = """
    import a, { b } from "./a"; import "./bare.css"; import * as ns from './ns'
    import type { T } from "./types"; import { type U, type V } from "./types2"; import { type W, x } from "./mixed"
    export * from "./star"; export { y } from "./y"; export type { Z } from "./z"; export const from = "./not"
    const c = require("./c"), d = await import(/* chunk */ "./d"), u = new URL("./e.png", import.meta.url), p = new URL("http://x", base)
    // import "./comment"
    /* require("./block") */
    const s = `import "./a"`; const t = <p>Don't import</p>
    import a2 from "./a"
    """
    assert scan.script_sources(text) == ["./a", "./bare.css", "./ns", "./mixed", "./star", "./y", "./c", "./d", "./e.png"]
    assert scan.script_sources(text, include_types=True)[3:6] == ["./types", "./types2", "./mixed"]


def test_style_sources():
    assert scan.style_sources('@use "a" as b;\n// @use "no"\n@import url(c.css), "d";\n@forward \'e\';\n.x { background: url(f.png) }') == ["a", "c.css", "d", "e"]


def test_scan_files(spark):
    rows = [("a.ts", b"import './b'; import './c'"), ("b.png", b"import './x'"), ("bad.js", b"\xff\xfe import './x'"), ("s.scss", b"@use 'q';"), ("n.ts", None), ("e.ts", b"")]
    df = spark.createDataFrame([(p, c and bytearray(c)) for p, c in rows], "path string, content binary")
    assert sorted(map(tuple, scan.scan_files(df).collect())) == [("a.ts", "./b", 0), ("a.ts", "./c", 1), ("s.scss", "q", 0)]


def test_types_leave_nothing():
    text = "import type { A } from './a'\nexport interface B<T> {\n  a: T\n}\ntype C =\n  | 'x'\n  | { y: 1 }\nconst d = 1\n\ndeclare const e: number\n"
    left = erased(text)
    assert left.split() == "const d = 1".split() and len(left) == len(text) and left.count("\n") == text.count("\n")
    assert runs_nothing(text, 1, 7) and not runs_nothing(text, 7, 2) and not runs_nothing(text, 2, 0) and runs_nothing(text, 10, 1)


def test_config():
    text = '[aliases]\n"@/*" = "src/*"\n[style.aliases]\ns = ["a", "b"]\n[resolve]\nconditions = ["x"]\n'
    c = config.read_config("app", text)
    assert c.aliases == {"@/*": ["src/*"]} and c.style_aliases == {"s": ["a", "b"]} and c.conditions == ["x"] and c.inline_requires is None
    assert config.above("a/b") == ["a/b", "a", ""] and config.nearest([c], "main_fields", ["main"]) == ["main"]
    for bad in ("[resolve]\nother = 1", "aliases = 3", "x =", "inline-requires = 1"):
        with pytest.raises(config.ConfigError):
            config.read_config("", bad)


def test_a_project_that_extends_nothing():
    """It cannot be read, so it maps nothing; projects of any name are asked for by those that name them."""
    from tidemark.functions.resolution import Layout, named_projects

    own = '{"extends": "./base.json", "compilerOptions": {"paths": {"@/*": ["./src/*"]}}}'
    layout = Layout({"tsconfig.json": own}, {})
    assert layout.project_for("src/a.ts") is None and layout.consulted("src/a.ts") >= {"tsconfig.json", "base.json"}
    assert "base.json" in named_projects({"tsconfig.json": own})
    both = Layout({"tsconfig.json": own, "base.json": '{"compilerOptions": {"baseUrl": "."}}'}, {})
    assert both.project_for("src/a.ts").paths and both.project_for("src/a.ts").base == ""
    assert named_projects({"a/tsconfig.json": '{"references": [{"path": "../b"}], "extends": ["@x/y"]}'}) >= {"b", "b/tsconfig.json", "a/node_modules/@x/y.json", "node_modules/@x/y/tsconfig.json"}
