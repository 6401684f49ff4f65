"""Small repositories, end to end; a folder of golden cases is used where $TIDEMARK_GOLDEN names one."""

import difflib
import json
import os
import re

import pytest

from tidemark.plans import report
from tidemark.plans.analyse import Change, analyse
from tidemark.sources.config import ConfigError

TREE = {
    "src/pages/Shop.tsx": 'import { Cart } from "../parts/Cart";\nimport logo from "@/logo.svg";\nimport "../style/main.scss";\nexport const Shop = () => Cart(logo);\n',
    "src/pages/About.tsx": 'import React from "react";\nexport const About = () => null;\n',
    "src/parts/Cart.ts": 'import { sum } from "#lib/sum";\nimport type { Item } from "./types";\nexport const Cart = (x) => sum(x);\n',
    "src/parts/types.ts": "export interface Item {\n  id: number\n}\nexport const zero = 0;\n",
    "src/lib/sum.ts": "export const sum = (x) => x;\n",
    "src/style/main.scss": '@use "tokens/colors";\n',
    "src/style/tokens/_colors.scss": "$a: red;\n",
    "static/logo.svg": "<svg/>\n",
    "package.json": '{"name": "app", "imports": {"#lib/*": "./src/lib/*.js"}}',
    "tidemark.toml": '[aliases]\n"@/*" = "static/*"\n',
    "pnpm-lock.yaml": "packages:\n\n  react@1.0.0:\n    resolution: {integrity: x}\n",
    "tsconfig.json": '{"compilerOptions": {"paths": {"~/*": ["./src/*"]}}}',
}
ANCHORS = ["src/pages/Shop.tsx", "src/pages/About.tsx"]


def diff_of(before, after):
    out = ""
    for p in sorted(set(before) | set(after)):
        if before.get(p) != after.get(p):
            x, y = (t.get(p, "").splitlines(True) for t in (before, after))
            out += f"diff --git a/{p} b/{p}\n" + ("new file mode 100644\n" if p not in before else "")
            out += "".join(difflib.unified_diff(x, y, f"a/{p}" if p in before else "/dev/null", f"b/{p}" if p in after else "/dev/null"))
    return out


def run(spark, after, change, anchors=ANCHORS, **more):
    df = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in after.items()], "path string, content binary")
    return {r["anchor"]: r for r in analyse(df, change, anchors, **more).collect()}


def edited(spark, edits, **more):
    after = {p: t for p, t in (TREE | edits).items() if t is not None}
    return run(spark, after, Change.read(diff_of(TREE, after)), **more)


def test_downstream(spark):
    got = edited(spark, {"src/lib/sum.ts": "export const sum = (x) => x + 1;\n"})
    assert got[ANCHORS[0]]["path"] == ["File(src/pages/Shop.tsx)", "File(src/parts/Cart.ts)", "File(src/lib/sum.ts)"]
    assert got[ANCHORS[0]]["direction"] == "downstream" and not got[ANCHORS[1]]["affected"] and got[ANCHORS[1]]["path"] is None


@pytest.mark.parametrize("path", ["static/logo.svg", "src/style/tokens/_colors.scss"])
def test_leaves_and_styles(spark, path):
    got = edited(spark, {path: "changed\n"})
    assert got[ANCHORS[0]]["changed"] == path and not got[ANCHORS[1]]["affected"]


def test_types_alone_change_nothing(spark):
    edit = {"src/parts/types.ts": TREE["src/parts/types.ts"].replace("id: number", "id: string")}
    assert not any(r["affected"] for r in edited(spark, edit).values())
    assert edited(spark, edit, include_types=True)[ANCHORS[0]]["affected"]


def test_package(spark):
    got = edited(spark, {"pnpm-lock.yaml": TREE["pnpm-lock.yaml"].replace("x}", "y}")})
    assert got[ANCHORS[1]]["path"] == ["File(src/pages/About.tsx)", "File(node_modules/react)"] and not got[ANCHORS[0]]["affected"]


def test_moved_imports(spark):
    got = edited(spark, {"src/parts/Cart.tsx": "export const Cart = 1;\n", "src/parts/Cart.ts": None})
    assert got[ANCHORS[0]]["affected"] and not got[ANCHORS[1]]["affected"]
    got = edited(spark, {"src/lib/sum.ts": None})
    assert got[ANCHORS[0]]["changed"] == "src/parts/Cart.ts"
    got = edited(spark, {"tsconfig.json": '{"compilerOptions": {"paths": {}}}'})
    assert all(r["affected"] for r in got.values())
    got = edited(spark, {"tsconfig.json": '{"compilerOptions": {"paths": {}}}'}, earlier={"tsconfig.json": TREE["tsconfig.json"]})
    assert not any(r["affected"] for r in got.values())


def test_upstream(spark):
    after = TREE | {"src/pages/Shop.tsx": TREE["src/pages/Shop.tsx"] + "// x\n"}
    got = run(spark, after, Change.read(diff_of(TREE, after)), ["src/lib/sum.ts", "src/pages/About.tsx"])
    assert got["src/lib/sum.ts"]["direction"] == "upstream" and got["src/lib/sum.ts"]["path"] == ["File(src/pages/Shop.tsx)", "File(src/parts/Cart.ts)", "File(src/lib/sum.ts)"]
    assert not got["src/pages/About.tsx"]["affected"]


def test_no_change_and_errors(spark):
    assert not any(r["affected"] for r in run(spark, TREE, Change()).values())
    assert run(spark, TREE, Change.read("", ["src/lib/sum.ts"]))[ANCHORS[0]]["affected"]
    with pytest.raises(ValueError):
        run(spark, TREE, Change(), ["nowhere.ts"])
    with pytest.raises(ConfigError):
        run(spark, TREE | {"src/tidemark.toml": "[resolve]\nx = 1"}, Change())
    run(spark, TREE | {"other/tidemark.toml": "[resolve]\nx = 1"}, Change())


def test_unresolved_and_reports(spark):
    extra = {"src/pages/Odd.ts": 'import "./gone"; import "./gone.png"; import "node:fs"; import "fs"; import "left-pad"; import "@/none"; import "#lib/none"; import "react";\n', "node_modules/react/package.json": '{"exports": {"./x": "./x.js"}}'}
    df = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in (TREE | extra).items()], "path string, content binary")
    anchors = ["src/pages/Odd.ts", "src/lib/sum.ts"]
    found = analyse(df, Change.read("", ["src/lib/sum.ts"]), anchors).cache()
    odd = {u["specifier"]: (u["kind"], u["in_repo"]) for u in {r["anchor"]: r for r in found.collect()}["src/pages/Odd.ts"]["unresolved"]}
    assert odd == {"./gone": ("path", True), "left-pad": ("missing-package", False), "@/none": ("alias", True), "#lib/none": ("alias", True), "react": ("package", True)}
    told = json.loads(report.render_json(found, anchors, "file"))["anchors"]
    assert [a["anchor"] for a in told] == anchors and told[1] == {"anchor": "src/lib/sum.ts", "affected": True, "direction": "downstream", "changed": "src/lib/sum.ts", "path": ["File(src/lib/sum.ts)"], "granularity": "file", "unresolved": []}
    lines = [r["line"] for r in report.verdict_lines(found, "file", explain=True).orderBy("anchor", "n").collect()]
    assert lines == ['Impact detected on target anchor via: "src/lib/sum.ts"', "Path (downstream, file granularity):", "  File(src/lib/sum.ts)", "No reachability impact detected"]
    assert report.unresolved_lines(found)[:3] == ["Resolved to nothing: 5 specifier(s), written in 5 file(s).", "  #lib/none", "    src/pages/Odd.ts"]
    assert report.verdict_of_set(found) == (True, "src/lib/sum.ts") and report.exit_code(found) == 0 and report.exit_code(None) == 2


GOLDEN = os.environ.get("TIDEMARK_GOLDEN", "")


def tree(at):
    out = {}
    for folder, _, names in os.walk(at):
        for n in names:
            with open(f"{folder}/{n}", encoding="utf-8") as f:
                out[os.path.relpath(f"{folder}/{n}", at)] = f.read()
    return out


def golden(level):
    """Every case as a folder of one tree; (files after, answers, change, config's name)."""
    before, after, want, config = {}, {}, {}, "tidemark.toml"
    for case in sorted(os.listdir(GOLDEN)):
        b, a = (tree(f"{GOLDEN}/{case}/{v}") for v in ("before", "after"))
        config = next((os.path.basename(p) for p in a if p.endswith(".toml")), config)
        before |= {f"{case}/{p}": t for p, t in b.items()}
        after |= {f"{case}/{p}": t for p, t in a.items()}
        if a == b or not os.path.exists(f"{GOLDEN}/{case}/answers.txt"):
            continue  # what the case is about is not there
        with open(f"{GOLDEN}/{case}/answers.txt", encoding="utf-8") as f:
            for m in re.finditer(rf"^== (\S+) \[{level}\]\n(?:(?!^== ).)*?-- --json: exit 0\n(\{{.*?)\n", f.read(), re.S | re.M):
                answer = json.loads(m[2])["anchors"][0]
                want[f"{case}/{m[1]}"] = (answer["affected"], answer.get("direction"), [x.replace("(", f"({case}/") for x in answer.get("path", [])] or None)
    return after, want, Change.read(diff_of(before, after)), config


@pytest.mark.skipif(not os.path.isdir(GOLDEN), reason="no golden cases")
def test_golden_cases(spark):
    """Verdict, direction and witness over files."""
    after, want, change, config = golden("file")
    got = run(spark, after, change, list(want), config_name=config)
    wrong = [k for k, w in want.items() if (got[k]["affected"], got[k]["direction"], got[k]["path"]) != w]
    assert len(want) > 200 and len(wrong) <= 1, wrong
