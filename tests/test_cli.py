"""The command line over a tree on disk, with a revision to compare with."""

import io
import json
import subprocess

import pytest

from tests.plans.test_analyse import diff_of
from tidemark import cli

BEFORE = {
    "web/src/Page.tsx": 'import { used } from "./lib";\nimport "../dist/theme.js";\nexport const Page = () => used();\n',
    "web/src/Other.tsx": 'import { other } from "./lib";\nexport const Other = () => other;\n',
    "web/src/Third.tsx": 'import { gone } from "./lib";\nexport const Third = () => gone;\n',
    "web/src/lib.ts": "// helper\nconst helper = () => 1;\nexport const used = () => helper();\nexport const other = 2;\nexport const gone = 3;\n",
    "web/src/main.ts": 'import { Page } from "./Page";\nPage();\n',
    "web/theme/a.css.ts": "export const a = 1;\n",
    "web/theme/a.test.ts": "export const t = 1;\n",
    "web/src/state.ts": "let n = 0;\nexport const get = () => n;\nexport const set = (x) => { n = x; };\n",
    "web/src/Inc.tsx": 'import { get } from "./state";\nexport const Inc = () => get();\n',
    "web/tidemark.toml": '[outputs]\n"dist/*.js" = ["theme/**/*.ts", "!theme/*.test.ts"]\n',
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    at = tmp_path_factory.mktemp("app (one), 100%")
    git = lambda *a: subprocess.run(["git", "-C", str(at), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    for p, t in BEFORE.items():
        (at / p).parent.mkdir(parents=True, exist_ok=True)
        (at / p).write_text(t)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "before")
    return at


def ask(spark, tree, edits, *more, anchors=("src/Page.tsx", "src/Other.tsx", "src/Third.tsx", "src/Inc.tsx")):
    """The answers to edits of the tree by path (verdict, direction, what changed) and the code."""
    after = BEFORE | {f"web/{p}": t for p, t in edits.items()}
    for p, t in after.items():
        (tree / p).write_text(t)
    strip = lambda x: {p.removeprefix("web/"): t for p, t in x.items()}
    said = []
    code = cli.run(["--root", f"{tree}/web", "--diff", "-", "--anchor", *anchors, *more], spark, said.append, io.StringIO(diff_of(strip(BEFORE), strip(after))))
    return code, said


def verdicts(said):
    return {a["anchor"]: a["path"][-1] if a["affected"] else None for a in json.loads(said[0])["anchors"]}


def test_base_at_symbols(spark, tree):
    """Comments and layout count for nothing, a changed helper for its users, a lost name for who asks for it."""
    lib = BEFORE["web/src/lib.ts"]
    edit = lib.replace("// helper\n", "/* a helper */\n\n").replace("() => 1", "() =>\n  4").replace("export const gone = 3;\n", "")
    code, said = ask(spark, tree, {"src/lib.ts": edit}, "--base", "HEAD", "--granularity", "symbol", "--json")
    assert code == 0
    assert verdicts(said) == {"src/Page.tsx": "Decl(src/lib.ts, helper)", "src/Other.tsx": None, "src/Third.tsx": "Export(src/lib.ts, gone)", "src/Inc.tsx": None}


def test_base_at_files(spark, tree):
    lib = BEFORE["web/src/lib.ts"]
    code, said = ask(spark, tree, {"src/lib.ts": lib.replace("// helper\n", "\n\n").replace("= 2;", "=\n 2 ;")}, "--base", "HEAD")
    assert code == 1 and said == ["No reachability impact detected"]
    code, said = ask(spark, tree, {"src/lib.ts": lib.replace("= 2", "= 5")}, "--base", "HEAD", "--explain")
    assert code == 0 and said[1:] == ["Path (downstream, file granularity):", "  File(src/Other.tsx)", "  File(src/lib.ts)"]
    assert ask(spark, tree, {}, "--base", "nowhere")[0] == 2


def test_outputs_and_directions(spark, tree):
    """An import of what a build makes reaches what it is made from."""
    edit = {"theme/a.css.ts": "export const a = 2;\n", "theme/a.test.ts": "export const t = 2;\n"}
    code, said = ask(spark, tree, edit, "--json")
    assert verdicts(said) == {"src/Page.tsx": "File(theme/a.css.ts)", "src/Other.tsx": None, "src/Third.tsx": None, "src/Inc.tsx": None}
    assert [u for a in json.loads(said[0])["anchors"] for u in a["unresolved"]] == []
    code, said = ask(spark, tree, {"src/main.ts": BEFORE["web/src/main.ts"] + "Page(1);\n"}, "--only", "downstream", "--unresolved", anchors=("src/lib.ts",))
    assert code == 1 and said == ["No reachability impact detected", "Every specifier this run reached resolved to a file."]
    code, said = ask(spark, tree, {"src/main.ts": BEFORE["web/src/main.ts"] + "Page(1);\n"}, "--only", "upstream", "--explain", anchors=("src/lib.ts",))
    assert code == 0 and said[2:] == ["  File(src/main.ts)", "  File(src/Page.tsx)", "  File(src/lib.ts)"]


def test_entries(spark, tree):
    """A writer counts only where an entry can run it."""
    edit = {"src/state.ts": BEFORE["web/src/state.ts"].replace("n = x", "n = x + 1")}
    symbol = ("--granularity", "symbol", "--json")
    assert verdicts(ask(spark, tree, edit, *symbol, anchors=("src/Inc.tsx",))[1]) == {"src/Inc.tsx": "Decl(src/state.ts, set)"}
    assert verdicts(ask(spark, tree, edit, *symbol, "--entry", "src/main.ts", anchors=("src/Inc.tsx",))[1]) == {"src/Inc.tsx": None}
    runs = edit | {"src/main.ts": 'import { set } from "./state";\nset(1);\n'}
    assert verdicts(ask(spark, tree, runs, *symbol, "--entry", "src/main.ts", anchors=("src/Inc.tsx",))[1]) == {"src/Inc.tsx": "Decl(src/state.ts, set)"}


def test_nothing_and_errors(spark, tree):
    assert ask(spark, tree, {}) == (1, ["No reachability impact detected"])
    code, said = ask(spark, tree, {}, anchors=("src/None.tsx",))
    assert code == 2 and "src/None.tsx" in said[0]
    with pytest.raises(SystemExit):
        cli.run(["--json"], spark)
