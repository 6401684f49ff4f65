import os

import pytest

from tests.plans import test_analyse as base
from tidemark.plans.analyse import Change
from tidemark.plans.symbols import analyse_symbols

TREE = {
    "src/Page.tsx": 'import { used } from "./lib";\nexport const Page = () => used();\n',
    "src/Other.tsx": 'import { other } from "./lib";\nexport const Other = () => other;\n',
    "src/Inc.tsx": 'import { get } from "./state";\nexport const Inc = () => get();\n',
    "src/lib/index.ts": 'export * from "./a";\nexport { b as other } from "./b";\n',
    "src/lib/a.ts": "const helper = () => 1;\n\nexport const used = () => helper();\nexport const unused = 3;\n",
    "src/lib/b.ts": "export const b = 2;\n",
    "src/state.ts": "let n = 0;\nexport const inc = () => { n += 1; };\nexport const get = () => n;\n",
    "src/boot.ts": "export const VERSION = 1;\nconst client = connect();\n",
    "src/Version.tsx": 'import { VERSION } from "./boot";\nexport const Version = () => VERSION;\n',
}
ANCHORS = ["src/Page.tsx", "src/Other.tsx", "src/Inc.tsx", "src/Version.tsx"]


API = """export const api = {
  a: () => 1,
  b() {
    return 2;
  },
  self() { return this.b; },
};
"""
MEMBERS = {
    "src/api.ts": API,
    "src/Page.tsx": 'import { api } from "./api";\nexport const Page = () => api.a();\n',
    "src/Other.tsx": 'import { api } from "./api";\nexport const Other = () => api.b();\n',
    "src/Inc.tsx": 'import { api } from "./api";\nexport const Inc = () => show(api);\n',
    "src/Version.tsx": 'import { api } from "./api";\nexport const Version = () => api.self();\n',
}
CASES = {
    # name: (files besides TREE, edited file, old, new)
    "helper": ({}, "src/lib/a.ts", "=> 1", "=> 2"),
    "unused": ({}, "src/lib/a.ts", "unused = 3", "unused = 4"),
    "renamed": ({}, "src/lib/b.ts", "= 2", "= 4"),
    "shared": ({}, "src/state.ts", "+= 1", "+= 2"),
    "boot": ({}, "src/boot.ts", "connect()", "connect(1)"),
    "lazy": ({"tidemark.toml": "inline-requires = true\n", "src/Version.tsx": 'import { VERSION } from "./boot";\nexport const Version = 1;\n'}, "src/boot.ts", "connect()", "connect(1)"),
    "quiet": ({"package.json": '{"name": "x", "sideEffects": false}'}, "src/boot.ts", "connect()", "connect(1)"),
    "some": ({"package.json": '{"name": "x", "sideEffects": ["boot.ts"]}'}, "src/boot.ts", "connect()", "connect(1)"),
    "removed": ({}, "src/lib/a.ts", "export const used = () => helper();\n", ""),
    "opaque": ({"src/lib/b.ts": "const z = 1;\nmodule.exports = { b: z };\n"}, "src/lib/b.ts", "z = 1", "z = 2"),
    "nothing": ({}, "src/lib/a.ts", "= 3", "= 3"),
    "member": (MEMBERS, "src/api.ts", "() => 1", "() => 5"),
    "gone member": (MEMBERS, "src/api.ts", "  a: () => 1,\n", ""),
    "mutated": (MEMBERS | {"src/api.ts": API + "api.a = other;\n"}, "src/api.ts", "return 2", "return 3"),
    "repointed": (MEMBERS | {"src/api.ts": "const one = { a: () => 1 };\nconst two = { a: () => 2 };\nexport { one as api };\n"}, "src/api.ts", "one as api", "two as api"),
    "asked": ({"src/Page.tsx": 'export const Page = () => require("./lib").used();\nexport const more = require("./lib").unused;\n', "src/Other.tsx": 'export const Other = async () => (await import("./lib/b")).b;\n'}, "src/lib/b.ts", "= 2", "= 4"),
}


def test_symbols(spark):
    """All cases as folders of one tree, answered at once."""
    before, after = {}, {}
    for case, (more, path, old, new) in CASES.items():
        tree = TREE | more
        before |= {f"{case}/{p}": t for p, t in tree.items()}
        after |= {f"{case}/{p}": t for p, t in (tree | {path: tree[path].replace(old, new)}).items()}
    df = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in after.items()], "path string, content binary").repartition(4)
    rows = analyse_symbols(df, Change.read(base.diff_of(before, after)), [f"{c}/{a}" for c in CASES for a in ANCHORS]).collect()
    got = {c: {} for c in CASES}
    for r in rows:
        case, _, anchor = r["anchor"].partition("/")
        if r["affected"]:
            got[case][anchor] = [x.replace(f"({case}/", "(") for x in r["path"]]
    assert len(rows) == len(CASES) * len(ANCHORS)
    assert got["helper"] == {"src/Page.tsx": ["File(src/Page.tsx)", "Decl(src/Page.tsx, Page)", "Export(src/lib/index.ts, used)", "Export(src/lib/a.ts, used)", "Decl(src/lib/a.ts, used)", "Decl(src/lib/a.ts, helper)"]}
    assert got["unused"] == got["lazy"] == got["quiet"] == got["nothing"] == {}
    assert list(got["renamed"]) == ["src/Other.tsx"] and list(got["shared"]) == ["src/Inc.tsx"] and list(got["some"]) == ["src/Version.tsx"]
    assert got["boot"] == {"src/Version.tsx": ["File(src/Version.tsx)", "ModuleInit(src/Version.tsx)", "ModuleInit(src/boot.ts)", "Decl(src/boot.ts, client)"]}
    assert "src/Page.tsx" in got["removed"] and "src/Other.tsx" in got["opaque"]
    # one member's users, who hands on the object, and whoever a member that reads its object serves
    assert set(got["member"]) == {"src/Page.tsx", "src/Inc.tsx", "src/Version.tsx"}
    assert got["member"]["src/Page.tsx"] == ["File(src/Page.tsx)", "Decl(src/Page.tsx, Page)", "Member(src/api.ts, api.a)"]
    assert {"src/Page.tsx", "src/Inc.tsx"} <= set(got["gone member"]) and set(got["mutated"]) == set(ANCHORS)
    assert set(got["repointed"]) == set(ANCHORS)
    # a call gets the module as its object, so that all of it counts; a name that is read is one export
    assert set(got["asked"]) == {"src/Page.tsx", "src/Other.tsx"}
    assert got["asked"]["src/Other.tsx"][-2:] == ["Export(src/lib/b.ts, b)", "Decl(src/lib/b.ts, b)"] or got["asked"]["src/Other.tsx"][-1] == "Export(src/lib/b.ts, b)"


@pytest.mark.skipif(not os.path.isdir(base.GOLDEN), reason="no golden cases")
def test_golden_cases_are_never_missed(spark, monkeypatch):
    """Over symbols the verdict may be wider than the golden one, never narrower."""
    after, want, change, config = base.golden("symbol")
    df = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in after.items()], "path string, content binary").repartition(4)
    got = {r["anchor"]: r for r in analyse_symbols(df, change, list(want), config).collect()}
    missed = [k for k, w in want.items() if w[0] and not got[k]["affected"]]
    same = [k for k, w in want.items() if (got[k]["affected"], got[k]["direction"], got[k]["path"]) == w]
    assert len(missed) <= 1 and len(same) >= 175, (missed, len(same))


def test_paths_of_any_signs(spark):
    """A changed file marks what it declares, however its path is written."""
    folders = ["app/shop", "app/(shop)", "app/a, b", "app/x) (y, z"]
    tree = {f"{d}/lib.ts": "const n = 1;\nexport const used = () => n;\n" for d in folders} | {f"{d}/Page.tsx": 'import { used } from "./lib";\nexport const Page = () => used();\n' for d in folders}
    df = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in tree.items()], "path string, content binary")
    got = {r["anchor"]: r for r in analyse_symbols(df, Change.read(named=[f"{d}/lib.ts" for d in folders]), [f"{d}/Page.tsx" for d in folders]).collect()}
    for d in folders:
        r = got[f"{d}/Page.tsx"]
        assert r["affected"] and r["changed"] == f"{d}/lib.ts"
        assert r["path"] == [f"File({d}/Page.tsx)", f"Decl({d}/Page.tsx, Page)", f"Export({d}/lib.ts, used)"]
