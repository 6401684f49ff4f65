import pytest

from tidemark.sources.modules import read_module


def facts(text):
    m, writers = read_module(text)
    name = lambda i: m.decls[i].names[0]
    return {
        "decls": [d.names for d in m.decls],
        "runs": [name(i) for i, d in enumerate(m.decls) if d.runs],
        "refs": {name(i): [name(r) for r in d.refs] for i, d in enumerate(m.decls) if d.refs},
        "written_by": {name(i): [name(r) for r in d.written_by] for i, d in enumerate(m.decls) if d.written_by},
        "imports": {name(i): [(m.sources[u.source], u.name) for u in d.imports] for i, d in enumerate(m.decls) if d.imports},
        "exports": [(n, k, m.decls[t].names[0] if k == "local" else m.sources[t], o) for n, k, t, o, _, _ in m.exports],
        "stars": [m.sources[s] for s in m.stars],
        "init": [name(i) for i in sorted(m.init_decls)],
        "writers": {name(o): [name(w) for w in ws] for o, ws in writers.items() if ws},
        "bare": [m.sources[s] for s in sorted(m.bare)],
    }


def test_declarations_and_uses():
    f = facts(
        "import { a as b, type T } from './a'\nimport d, * as ns from './n'\nimport './bare.css'\n"
        "const one = 1, two = () => b(one)\nexport function three(x: T) { return ns.four(two) }\n"
        "export default class Five extends d {}\nexport { one as uno, b }\nexport * from './star'\nexport { y as z } from './y'\nexport * as all from './all'\n"
    )
    assert f["decls"] == [["one"], ["two"], ["three"], ["default", "Five"]]
    assert f["refs"] == {"two": ["one"], "three": ["two"]}
    assert f["imports"] == {"two": [("./a", "a")], "three": [("./n", "four")], "default": [("./n", "default")]}
    assert sorted(f["exports"]) == [("all", "all", "./all", None), ("b", "reexport", "./a", "a"), ("default", "local", "default", None), ("three", "local", "three", None), ("uno", "local", "one", None), ("z", "reexport", "./y", "y")]
    assert f["stars"] == ["./star"] and f["bare"] == ["./bare.css"] and f["init"] == []


def test_what_runs():
    f = facts(
        "import { memo } from 'react'\nconst a = make()\nconst b = [1, { c: 2 }]\nconst d = memo(() => a())\nconst e = /*#__PURE__*/ make()\n"
        "const g = `x${a}`\nclass H { static i = 1 }\nclass J { k() { return a() } }\nfunction make() { return b }\nconst l = { m() { return make() }, n: () => make() }\nstart(d)\n"
    )
    assert f["runs"] == ["a", "g", "H"]
    assert set(f["init"]) == {"a", "g", "H", "make", "b", "d"}


def test_writers():
    f = facts("let n = 0\nconst o = { v: 1 }\nconst k = 'fixed'\nexport const inc = () => { n++ }\nexport const get = () => n\nexport const set = (x) => { o.v = x }\nexport const show = () => `${k}`\n")
    assert f["writers"]["n"] == ["inc"] and "set" in f["writers"]["o"] and "k" not in f["writers"]
    assert f["refs"]["get"] == ["n"] and f["written_by"]["get"] == ["inc"]


@pytest.mark.parametrize("text", ["const a = require(x)", "module.exports = make()", "exports.a = 1; use(exports)", "exports.a = 1; exports.a = 2", "import x from 'y'; exports.a = x", "eval('1')", "const a = (1", "namespace N { }", "@dec class A {}", "export = a", "import(x)", "export { missing }"])
def test_what_stays_one_unit(text):
    assert read_module(text) is None


def test_commonjs_tables():
    f = facts("'use strict'\nObject.defineProperty(exports, '__esModule', { value: true })\nexports.a = exports.b = void 0\nconst h = () => 1\nexports.a = () => h()\nmodule.exports.b = make(h)\n")
    assert f["exports"] == [("a", "local", "exports.a", None), ("b", "local", "exports.b", None)] and f["runs"] == ["exports.b"]
    assert f["refs"] == {"exports.a": ["h"], "exports.b": ["h"]}
    f = facts("const x = 1\nfunction y() { return x }\nmodule.exports = { x, y, z: () => y(), w() { return x } }\n")
    assert [e[0] for e in f["exports"]] == ["x", "y", "z", "w"] and f["refs"]["exports.z"] == ["y"] and f["refs"]["exports.x"] == ["x"] and f["runs"] == []


def test_jsx_text_hides_nothing():
    f = facts("const a = 1\nconst b = () => 2\nexport const P = () => <p>Don't {a} isn't</p>;\nexport const Q = () => <B x={b} /> || </B>;\n")
    assert "a" in f["refs"]["P"] and "b" in f["refs"]["Q"]


API = """import { x } from "./x";
const k = 1;
export const api = {
  a: () => k,
  b() { return x.go; },
  c: { deep: 1 },
  d,
  e: () => api.a(),
  async f() { return this.a; },
};
function d() { return 2; }
export const use = () => api.a() + api.c.deep;
"""


def members(text):
    m, _ = read_module(text)
    return m, {x.name: x for x in m.decls[1].members}


def test_object_members():
    m, parts = members(API)
    assert {n: x.receiver for n, x in parts.items()} == {"a": False, "b": False, "c": False, "d": False, "e": False, "f": True}
    assert members(API.replace("return 2", "return this"))[1]["d"].receiver and members(API.replace("  d,", "  d: x,"))[1]["d"].receiver
    assert parts["a"].refs == [0] and parts["d"].refs == [2] and parts["e"].member_refs == [(1, "a")]
    assert [(u.name, u.member) for u in parts["b"].imports] == [("x", "go")]
    assert m.decls[3].member_refs == [(1, "a"), (1, "c")] and m.decls[3].refs == []
    assert "".join(API[x.start : x.end] for x in m.decls[1].members) == API[API.index("  a:") : API.index("};")]


@pytest.mark.parametrize("use", ["api.z", "api", "api.a = 1", "f(api)", "api['a']", "`${api.a}`", "({ ...api })", "delete api.a", "api.a++"])
def test_objects_used_whole(use):
    assert not members(API.replace("api.a() + api.c.deep", use))[1]


@pytest.mark.parametrize("part", ["...k", "[k]: 1", "get g() { return 1; }", "a: 2", "__proto__: k", "g: start()"])
def test_objects_that_stay_whole(part):
    assert not members(API.replace("  d,\n", f"  d,\n  {part},\n"))[1]


def test_names_asked_of_calls():
    m, _ = read_module('const a = require("./x").go;\nconst b = async () => (await import("./y")).go;\nconst c = require("./z");\nconst e = require("./w").f();\nconst g = import("./v");\n')
    assert [[(m.sources[u.source], u.name) for u in d.imports] for d in m.decls] == [[("./x", "go")], [("./y", "go")], [("./z", None)], [("./w", None)], [("./v", None)]]


@pytest.mark.parametrize(
    "text, runs",
    [
        ("const one = () => 1;\nconst a = one();", []),
        ("function one(x: number) { const y = x; return { y }; }\nconst a = one(2);", []),
        ("const one = () => two();\nconst two = () => 2;\nconst a = one();", []),
        ("import { memo } from 'react';\nconst one = (x) => memo(x);\nconst a = one(1);", []),
        ("const a = one();\nfunction one() { return 1; }", []),
        ("const a = one();\nfunction one() { return k; }\nconst k = 1;", ["a"]),
        ("const a = one();\nconst one = () => 1;", ["a"]),
        ("const one = () => start();\nconst a = one();", ["a"]),
        ("const one = () => one();\nconst a = one();", ["a"]),
        ("const one = (f) => f();\nconst a = one(start);", ["a"]),
        ("const two = () => 1;\nconst one = (two) => two();\nconst a = one(start);", ["a"]),
        ("let n = 0;\nconst one = () => { n = 1; return n; };\nconst a = one();", ["a"]),
        ("const one = () => { if (x) { start(); } return 1; };\nconst a = one();", ["a"]),
        ("const one = () => 1;\nconst a = one(start());", ["a"]),
        ("const one = async () => 1;\nconst a = one();", ["a"]),
        ("function one() { return this.x; }\nconst a = one();", ["a"]),
        ("const one = ({ x }) => x;\nconst a = one();", ["a"]),
        ("const one = (x = start()) => x;\nconst a = one();", ["a"]),
        ("let one = () => 1;\nconst a = one();", ["a"]),
        ("const one = () => 1;\nconst a = new one();", ["a"]),
        ("const k = { v: 1 };\nfunction one() { return k.v; }\nconst a = one();", ["a"]),
        ("function one(x) { return { x }; }\nconst a = one(globalThis.b.c);", ["a"]),
        ("const one = (x) => x[0];\nconst a = one(1);", ["a"]),
        ("const one = () => elsewhere;\nconst a = one();", ["a"]),
        ("const one = () => () => start();\nconst a = one();", []),
        ("const o = { one: start };\nconst one = () => 1;\nconst a = o.one();", ["a"]),
    ],
)
def test_local_helpers(text, runs):
    assert facts(text + "\n")["runs"] == runs
