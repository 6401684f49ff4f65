"""Change impact over symbols: declarations, exports and module initialisation as nodes.

Module facts are exploded into flat tables; every rule of the graph is a join or a union over
them, and gives (src, dst, ord), ``ord`` being the order in which a node's edges are followed:

* File -> its declarations, exports, initialisation; an opaque File -> the files it asks for
* Decl -> declarations it uses, then what it imports
* Export -> its declaration, or where it comes from, or what a star may provide; then writers
* ModuleInit -> declarations that run on load, imports that statements read, initialisation of
  what it imports

A name that cannot be placed leads to the whole file. Changed runs of lines meet the spans of
declarations, exports and imports in interval joins; what meets none marks its neighbours and
the initialisation.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import glob_to_regex, is_source
from tidemark.functions.types import erased
from tidemark.operators import closure, intervals
from tidemark.plans import analyse as files_plan
from tidemark.shared import cut
from tidemark.sources.compare import compare
from tidemark.sources.config import CONFIG, nearest
from tidemark.sources.modules import PURE, read_module

USE = "struct<source: int, name: string, member: string>"
PART = "array<struct<o: int, name: string>>"
MEMBERS = f"array<struct<name: string, start: int, end: int, receiver: boolean, refs: array<int>, imports: array<{USE}>, member_refs: {PART}, written_by: array<int>>>"
FACTS = (
    "path string, fine boolean, sources array<string>, bare array<int>, stars array<int>, "
    f"decls array<struct<id: int, name: string, start: int, end: int, refs: array<int>, imports: array<{USE}>, writers: array<int>, written_by: array<int>, member_refs: {PART}, members: {MEMBERS}>>, "
    "exports array<struct<name: string, kind: string, target: int, other: string, start: int, end: int>>, "
    f"init_decls array<int>, init_imports array<{USE}>, reads_on_load array<int>, import_spans array<struct<start: int, end: int, users: array<int>>>, "
    "runs array<struct<low: int, high: int, quiet: boolean>>, "
    "base struct<decls: array<int>, exports: array<string>, init: boolean, whole: boolean, lost: array<string>, "
    f"members: {PART}>"
)


def pure_calls(layout, path: str) -> frozenset[tuple[str, str]]:
    """What the configuration above a file says only makes a value: ``source#name`` entries, whose
    relative sources are matched by the name that the file itself writes for them."""
    chain = layout.chain(posixpath.dirname(path))
    known = PURE if nearest(chain, "builtin_pure", True) else frozenset()
    return known | {(s, n) for d in chain for e in d.pure for s, _, n in [e.rpartition("#")] if s and n}


def module_facts(files: DataFrame, runs: DataFrame, include_types: bool, layout, before: DataFrame | None = None) -> DataFrame:
    """(path, content) and changed runs (path, runs: lines) to one row for each source file; runs
    come back as ranges of characters. ``base`` says what differs from an earlier version, where
    ``before`` (path, content) has one and both can be taken apart."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(FACTS))
    sent = files.sparkSession.sparkContext.broadcast(layout)

    def compared(was: bytes | None, text: str, path: str) -> dict | None:
        try:
            found = compare(was.decode(), text, include_types, pure_calls(sent.value, path)) if was is not None else None
        except UnicodeDecodeError:
            return None
        return found and {"decls": sorted(found.decls), "exports": sorted(found.exports), "init": found.init, "whole": found.whole, "lost": found.lost, "members": [{"o": o, "name": n} for o, n in sorted(found.members)]}

    def one(path: str, content: bytes | None, lines: list | None, was: bytes | None) -> dict:
        empty = {f.name: [] for f in schema} | {"path": path, "fine": False, "runs": None if lines is None else [], "base": None}
        try:
            text = (content or b"").decode()
        except UnicodeDecodeError:
            return empty
        read = read_module(text, include_types, pure_calls(sent.value, path))
        starts = [0]
        for line in text.split("\n"):
            starts.append(starts[-1] + len(line) + 1)
        typed = (erased(text) if path.rpartition(".")[2] in ("ts", "tsx", "mts", "cts") and not include_types else text).split("\n")
        ranges = []
        for r in lines or []:
            a, n = r["start"], r["length"]
            low = starts[min(a - 1, len(starts) - 1)]
            blank = n > 0 and not include_types and path.rpartition(".")[2] in ("ts", "tsx", "mts", "cts") and all(not x.strip() for x in typed[a - 1 : a - 1 + n])
            ranges.append({"low": low, "high": starts[min(a - 1 + n, len(starts) - 1)] if n else low, "quiet": blank})
        if read is None:
            return empty | {"runs": ranges if lines is not None else None}
        m, writers = read
        use = lambda u: {"source": u.source, "name": u.name, "member": u.member}
        part = lambda ps: [{"o": o, "name": n} for o, n in ps]
        member = lambda x: {"name": x.name, "start": x.start, "end": x.end, "receiver": x.receiver, "refs": x.refs, "imports": list(map(use, x.imports)), "member_refs": part(x.member_refs), "written_by": x.written_by}
        return {
            "path": path, "fine": True, "sources": m.sources, "bare": sorted(m.bare), "stars": m.stars,
            "decls": [{"id": i, "name": d.names[0], "start": d.start, "end": d.end, "refs": d.refs, "imports": [use(u) for u in d.imports], "writers": writers.get(i, []), "written_by": d.written_by, "member_refs": part(d.member_refs), "members": list(map(member, d.members))} for i, d in enumerate(m.decls)],
            "exports": [{"name": n, "kind": k, "target": t, "other": o, "start": a, "end": b} for n, k, t, o, a, b in m.exports],
            "init_decls": sorted(m.init_decls), "init_imports": [use(u) for u in m.init_imports],
            "reads_on_load": m.reads_on_load, "import_spans": [{"start": a, "end": b, "users": u} for a, b, u in m.import_spans],
            "runs": ranges if lines is not None else None, "base": compared(was, text, path),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(r["path"], r["content"], r["runs"], r["was"]) for r in batch.to_pylist()], schema)

    source = files.where(is_source(F.col("path"))).select("path", "content")
    told = source.join(runs, "path", "left")
    told = told.withColumn("was", F.lit(None).cast("binary")) if before is None else told.join(before.select("path", F.col("content").alias("was")), "path", "left")
    return told.select("path", "content", "runs", "was").mapInArrow(run, FACTS)


def node(kind: str, path: Column | str, name: Column | str | None = None) -> Column:
    """``Kind(path)`` or ``Kind(path, name)``. A path may hold anything; a name never holds a
    comma and a blank, so that the last of these ends the path."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    parts = [column(path)] if name is None else [column(path), F.lit(", "), F.replace(column(name), F.lit(", "), F.lit(","))]
    return F.concat(F.lit(kind + "("), *parts, F.lit(")"))


def path_of(node_: Column | str) -> Column:
    """The path of a node, whatever signs it is written with."""
    n = F.col(node_) if isinstance(node_, str) else node_
    alone = F.regexp_extract(n, r"(?s)^(?:File|ModuleInit)\((.*)\)$", 1)
    return F.when(n.rlike(r"(?s)^(?:File|ModuleInit)\("), alone).otherwise(F.regexp_extract(n, r"(?s)^\w+\((.*), .*?\)$", 1))


def quiet_packages(layout) -> list[tuple[str, list[str] | None]]:
    """(directory, globs of files that do run something) of packages that claim to run nothing."""
    out = []
    for directory, data in layout.packages.items():
        claim = data.get("sideEffects")
        if claim is False:
            out.append((directory, []))
        elif isinstance(claim, list) and all(isinstance(x, str) for x in claim):
            rx = [glob_to_regex(g.removeprefix("./")) for g in claim]
            if None not in rx:
                out.append((directory, rx))
        elif "name" in data or claim is not None:
            out.append((directory, None))
    return out


class SymbolGraph:
    """Edges between symbols of the files, for one bundler."""

    def __init__(self, facts: DataFrame, targets: DataFrame, layout, leaf_edges: DataFrame, inline: bool = False):
        """targets: (path, specifier, target) first targets; leaf_edges: File edges by specifier;
        inline: the bundler loads a module where one of its names is first used."""
        self.facts, self.inline = facts, inline
        fine = facts.where("fine")
        self.fine = fine.select("path")
        src = fine.select("path", F.posexplode("sources").alias("source", "specifier"))
        self.placed = cut(src.join(targets, ["path", "specifier"], "left").select("path", "source", "target"))
        self.decls = cut(fine.select("path", F.explode("decls").alias("d")).select("path", "d.*"))
        exports = fine.select("path", F.posexplode("exports").alias("pos", "e")).select("path", "pos", "e.*")
        # a name that is exported no more stays a node, so that who asks for it meets the change
        lost = fine.where("base is not null").select("path", F.posexplode("base.lost").alias("pos", "name")).withColumn("pos", F.col("pos") + 50_000)
        lost = lost.select("path", "pos", "name", F.lit("lost").alias("kind"), F.lit(-1).alias("target"), F.lit(None).cast("string").alias("other"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))
        self.exports = cut(exports.unionByName(lost))
        members = self.decls.select("path", F.col("id").alias("o"), F.col("name").alias("object"), F.posexplode("members").alias("pos", "m")).select("path", "o", "object", "pos", F.col("m.name").alias("member"), *[f"m.{c}" for c in ("start", "end", "receiver", "refs", "imports", "member_refs", "written_by")])
        self.members = cut(members.withColumn("node", node("Member", "path", F.concat("object", F.lit("."), "member"))))
        self.is_fine = self.fine.select(F.col("path").alias("g"), F.lit(True).alias("g_fine"))
        self.leaf_edges, self.layout = leaf_edges, layout
        stars = fine.select("path", F.explode("stars").alias("source")).join(self.placed, ["path", "source"], "left").select("path", "target")
        self.stars = cut(stars)
        self.reached = cut(self._behind_stars())

    def _behind_stars(self) -> DataFrame:
        """(file, behind): files behind a file's stars, itself not counted unless by a cycle."""
        edges = self.stars.where("target is not null").select(F.col("path").alias("src"), F.col("target").alias("dst"))
        seeds = self.stars.select(F.col("path").alias("file"), F.col("path").alias("node")).distinct()
        return closure.reach(edges, seeds).where("hops > 0").select("file", F.col("node").alias("behind"))

    def _named(self, uses: DataFrame) -> DataFrame:
        """Uses (.., g, name, ord) of a name of file g to (.., dst, ord): the export, or the file."""
        exact = self.exports.select(F.col("path").alias("g"), "name").distinct().withColumn("own", F.lit(True))
        behind = self.reached.select(F.col("file").alias("g"), F.col("behind").alias("b"))
        opaque = behind.join(self.fine.select(F.col("path").alias("b")), "b", "left_anti").select("g")
        unplaced = self.stars.where("target is null").select(F.col("path").alias("g"))
        deep = behind.join(unplaced.select(F.col("g").alias("b")), "b", "left_semi").select("g")
        wild = opaque.unionByName(unplaced).unionByName(deep).distinct().withColumn("wild", F.lit(True))
        through = behind.join(self.exports.select(F.col("path").alias("b"), "name"), "b").where("name <> 'default'").select("g", "name").distinct().withColumn("via", F.lit(True))
        uses = uses.join(self.is_fine, "g", "left").join(exact, ["g", "name"], "left").join(wild, "g", "left").join(through, ["g", "name"], "left")
        known = F.col("g_fine") & (F.col("own").isNotNull() | F.col("via").isNotNull() | F.col("wild").isNotNull())
        uses = uses.withColumn("known", F.coalesce(known, F.lit(False)))
        out = uses.withColumn("dst", F.when(F.col("known"), node("Export", "g", "name")).otherwise(node("File", "g")))
        # a name that nothing provides may have come from any file behind the stars
        behind = uses.where(~F.col("known")).join(self.reached.withColumnRenamed("file", "g"), "g").withColumn("dst", node("File", "behind")).drop("behind")
        return out.unionByName(behind).drop("g_fine", "own", "wild", "via", "known", "g", "name")

    def _all(self, uses: DataFrame) -> DataFrame:
        """Uses (.., g, ord) of a whole module to its exports and those behind its stars."""
        own = uses.join(self.is_fine, "g", "left")
        whole = own.where("g_fine is null").withColumn("dst", node("File", "g")).withColumn("sub", F.lit(0).cast("long"))
        names = self.exports.select(F.col("path").alias("b"), "pos", "name")
        files = self.fine.select(F.col("path").alias("g"), F.col("path").alias("b"), F.lit(0).alias("far")).unionByName(self.reached.select(F.col("file").alias("g"), F.col("behind").alias("b"), F.lit(1).alias("far"))).groupBy("g", "b").agg(F.min("far").alias("far"))
        inner = own.where("g_fine is not null").join(files, "g").join(self.fine.select(F.col("path").alias("b"), F.lit(True).alias("b_fine")), "b", "left")
        opened = inner.where("b_fine").join(names, "b").withColumn("dst", node("Export", "b", "name")).withColumn("sub", F.col("far") * 100_000 + F.col("pos") + 1)
        closed = inner.where("b_fine is null").withColumn("dst", node("File", "b")).withColumn("sub", F.lit(10_000_000).cast("long"))
        keep = [c for c in uses.columns if c != "g"] + ["dst", "sub"]
        if self.inline:
            loads = own.where("g_fine is not null").withColumn("dst", node("ModuleInit", "g")).withColumn("sub", F.lit(20_000_000).cast("long"))
            closed = closed.select(*keep).unionByName(loads.select(*keep))
        return whole.select(*keep).unionByName(opened.withColumn("sub", F.col("sub").cast("long")).select(*keep)).unionByName(closed.select(*keep))

    def _used(self, uses: DataFrame) -> DataFrame:
        """Import uses (path, from, ord, source, name) to edges."""
        placed = uses.join(self.placed.where("target is not null"), ["path", "source"]).withColumnRenamed("target", "g")
        # a member of an exported object, if the export is such an object and has it
        objects = self.exports.where("kind = 'local'").select(F.col("path").alias("g"), "name", F.col("target").alias("o"))
        known = objects.join(self.members.select(F.col("path").alias("g"), "o", "member", F.col("node").alias("dst")), ["g", "o"]).select("g", "name", "member", "dst")
        told = placed.where("name is not null").join(known, ["g", "name", "member"], "left")
        members = told.where("dst is not null").select("src", "dst", "ord", F.lit(0).cast("long").alias("sub"))
        named = self._named(told.where("dst is null").select("src", "ord", "g", "name")).withColumn("sub", F.lit(0).cast("long"))
        every = self._all(placed.where("name is null").select("src", "ord", "g"))
        return members.unionByName(named.select("src", "dst", "ord", "sub")).unionByName(every.select("src", "dst", "ord", "sub"))

    def runs_on_import(self, paths: DataFrame) -> DataFrame:
        """(path, may_run) by the nearest package's claim."""
        claims, layout = quiet_packages(self.layout), self.layout
        sent = paths.sparkSession.sparkContext.broadcast(dict(claims))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import re

            from tidemark.sources.config import above

            for batch in batches:
                out = []
                for p in batch.column("path").to_pylist():
                    home = next((d for d in above(posixpath.dirname(p)) if d in sent.value), None)
                    globs = sent.value[home] if home is not None else None
                    inside = p[len(home) + 1 :] if home else p
                    out.append(globs is None or any(re.search(g, inside) for g in globs))
                yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.bool_())], ["path", "may_run"])

        return paths.mapInArrow(run, "path string, may_run boolean")

    def edges(self) -> DataFrame:
        name_of = self.decls.select("path", F.col("id").alias("t"), F.col("name").alias("t_name"))
        decl = node("Decl", "path", "name")
        zero = F.lit(0).cast("long")

        def to_decls(rows: DataFrame) -> DataFrame:
            """(path, src, ord, t) to edges to declarations."""
            return rows.join(name_of, ["path", "t"]).select("src", node("Decl", "path", "t_name").alias("dst"), F.col("ord").cast("long").alias("ord"), zero.alias("sub"))

        parts = []
        # files
        parts.append(self.decls.select(node("File", "path").alias("src"), decl.alias("dst"), F.col("id").cast("long").alias("ord"), zero.alias("sub")))
        parts.append(self.exports.select(node("File", "path").alias("src"), node("Export", "path", "name").alias("dst"), (100_000 + F.col("pos")).cast("long").alias("ord"), zero.alias("sub")))
        parts.append(self.fine.select(node("File", "path").alias("src"), node("ModuleInit", "path").alias("dst"), F.lit(10_000_000).cast("long").alias("ord"), zero.alias("sub")))
        # an opaque file asks for files; so does every node of it
        parts.append(self.leaf_edges.join(self.fine, "path", "left_anti").select(node("File", "path").alias("src"), node("File", "target").alias("dst"), F.col("ord").cast("long").alias("ord"), zero.alias("sub")))
        opaque = self.facts.where("not fine").select("path")
        parts.append(opaque.select(node("ModuleInit", "path").alias("src"), node("File", "path").alias("dst"), zero.alias("ord"), zero.alias("sub")))
        # declarations
        parts.append(to_decls(self.decls.select("path", decl.alias("src"), F.posexplode("refs").alias("ord", "t"))))
        uses = self.decls.select("path", decl.alias("src"), F.posexplode("imports").alias("ord", "u")).select("path", "src", (100_000 + F.col("ord")).cast("long").alias("ord"), "u.*")
        parts.append(self._used(uses))
        parts += self._member_edges(to_decls)
        # exports
        local = self.exports.where("kind = 'local'").select("path", node("Export", "path", "name").alias("src"), F.col("target").alias("t"))
        parts.append(to_decls(local.withColumn("ord", F.lit(0))))
        writers = local.join(self.decls.select("path", F.col("id").alias("t"), "writers"), ["path", "t"]).select("path", "src", F.posexplode("writers").alias("ord", "t"))
        written = [to_decls(writers.withColumn("ord", F.col("ord") + 10_000_000))]
        unnamed = self.decls.select("path", decl.alias("src"), F.posexplode("written_by").alias("ord", "t"))
        written.append(to_decls(unnamed.withColumn("ord", F.col("ord") + 10_000_000)))
        unnamed = self.members.select("path", F.col("node").alias("src"), F.posexplode("written_by").alias("ord", "t"))
        written.append(to_decls(unnamed.withColumn("ord", F.col("ord") + 10_000_000)))
        again = self.exports.where("kind in ('reexport', 'all')").select("path", node("Export", "path", "name").alias("src"), zero.alias("ord"), F.col("target").alias("source"), F.expr("if(kind = 'all', null, other)").alias("name"), F.lit(None).cast("string").alias("member"))
        parts.append(self._used(again))
        parts.append(self._star_exports())
        if self.inline:
            parts.append(self.exports.select(node("Export", "path", "name").alias("src"), node("ModuleInit", "path").alias("dst"), F.lit(5_000_000).cast("long").alias("ord"), zero.alias("sub")))
        # initialisation
        may = self.runs_on_import(self.facts.select("path").unionByName(self.placed.where("target is not null").select(F.col("target").alias("path"))).distinct())
        may = cut(may)
        fine = self.facts.where("fine").join(may, "path").where("may_run")
        init = node("ModuleInit", "path")
        parts.append(to_decls(fine.select("path", init.alias("src"), F.posexplode("init_decls").alias("ord", "t"))))
        every = self.facts.where("fine") if self.inline else fine
        if self.inline:
            parts.append(to_decls(every.select("path", init.alias("src"), F.posexplode("reads_on_load").alias("ord", "t")).withColumn("ord", F.col("ord") + 1_000_000)))
        reads = every.select("path", init.alias("src"), F.posexplode("init_imports").alias("ord", "u")).select("path", "src", (100_000 + F.col("ord")).cast("long").alias("ord"), "u.*")
        parts.append(self._used(reads))
        bare = self.facts.where("fine").select("path", F.explode("bare").alias("source"), F.lit(True).alias("bare"))
        asked = self.placed.where("target is not null").join(bare, ["path", "source"], "left").join(may.select(F.col("path").alias("target"), F.col("may_run").alias("target_runs")), "target", "left")
        order = (20_000_000 + F.col("source")).cast("long")
        if self.inline:
            asked = asked.where("bare")
        parts.append(asked.where(is_source(F.col("target"))).select(init.alias("src"), node("ModuleInit", "target").alias("dst"), order.alias("ord"), zero.alias("sub")))
        parts.append(asked.where(~is_source(F.col("target")) & F.col("bare") & F.coalesce("target_runs", F.lit(True))).select(init.alias("src"), node("File", "target").alias("dst"), order.alias("ord"), zero.alias("sub")))
        union = lambda dfs: reduce(DataFrame.unionByName, dfs)
        out = union(parts).withColumn("writer", F.lit(False)).unionByName(union(written).withColumn("writer", F.lit(True)))
        rank = F.row_number().over(Window.partitionBy("src").orderBy("ord", "sub", "dst"))
        out = out.where("src <> dst").groupBy("src", "dst").agg(F.min(F.struct("ord", "sub")).alias("o"), F.min("writer").alias("writer"))
        return out.select("src", "dst", "o.*", "writer").withColumn("ord", rank.cast("long")).select("src", "dst", "ord", "writer")

    def _member_edges(self, to_decls: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
        """Edges of objects to their members, and of members to what they use themselves."""
        zero, own = F.lit(0).cast("long"), self.members.select("path", "o", F.col("member").alias("name"), F.col("node").alias("dst"))
        src = F.col("node").alias("src")

        def to_members(rows: DataFrame) -> DataFrame:
            return rows.join(own, ["path", "o", "name"]).select("src", "dst", F.col("ord").cast("long").alias("ord"), zero.alias("sub"))

        whole = self.members.select(node("Decl", "path", "object").alias("src"), F.col("node").alias("dst"), (50_000 + F.col("pos")).cast("long").alias("ord"), zero.alias("sub"))
        reads = self.decls.select("path", node("Decl", "path", "name").alias("src"), F.posexplode("member_refs").alias("ord", "r")).select("path", "src", (20_000 + F.col("ord")).alias("ord"), "r.*")
        among = self.members.select("path", src, F.posexplode("member_refs").alias("ord", "r")).select("path", "src", (20_000 + F.col("ord")).alias("ord"), "r.*")
        refs = to_decls(self.members.select("path", src, F.posexplode("refs").alias("ord", "t")))
        uses = self.members.select("path", src, F.posexplode("imports").alias("ord", "u")).select("path", "src", (100_000 + F.col("ord")).cast("long").alias("ord"), "u.*")
        back = self.members.where("receiver").select(src, node("Decl", "path", "object").alias("dst"), F.lit(5_000_000).cast("long").alias("ord"), zero.alias("sub"))
        return [whole, to_members(reads), refs, to_members(among), self._used(uses), back]

    def running(self, edges: DataFrame, entries: list[str], gaps: DataFrame) -> DataFrame | None:
        """(node) of the declarations that a build from ``entries`` can run: a writer changes what
        others read only where something that is no such edge leads to it. None, and every writer
        counts, if an entry cannot be read or what is reached asks for a file of the repository
        that could not be placed. gaps: (path, specifier, kind)."""
        spark = edges.sparkSession
        asked = spark.createDataFrame([(e,) for e in entries], "path string")
        if asked.join(self.facts, "path", "left_semi").count() < len(set(entries)):
            return None
        # an entry's own statements run, whatever its package claims
        own = asked.select("path", node("File", "path").alias("node"))
        uses = self.facts.where("fine").join(asked, "path", "left_semi").select(node("File", "path").alias("src"), "path", F.posexplode("init_imports").alias("ord", "u")).select("path", "src", F.col("ord").cast("long").alias("ord"), "u.*")
        seeds = own.select("node").unionByName(self._used(uses).select(F.col("dst").alias("node")))
        seen = cut(closure.reach(edges.where("not writer"), seeds.distinct()).select("node"))
        paths = seen.select(path_of("node").alias("path")).distinct()
        if not gaps.where(F.col("kind") < files_plan.IN_REPO).join(paths, "path", "left_semi").isEmpty():
            return None
        # a member is code that its object holds
        held = seen.join(self.members, "node").select(node("Decl", "path", "object").alias("node"))
        return seen.where(F.col("node").startswith("Decl(")).unionByName(held).distinct()

    def _star_exports(self) -> DataFrame:
        """Names that only stars can provide: to the same name in every star target that could."""
        asked = self.exports.select(F.col("path").alias("b"), "name").join(self.reached.withColumnRenamed("behind", "b"), "b").select(F.col("file").alias("path"), "name")
        wanted = self.decls.select("path", F.explode("imports").alias("u")).select("path", "u.source", "u.name").unionByName(self.exports.where("kind = 'reexport'").select("path", F.col("target").alias("source"), F.col("other").alias("name"))).where("name is not null")
        wanted = wanted.join(self.placed.where("target is not null"), ["path", "source"]).select(F.col("target").alias("path"), "name")
        tops = self.stars.select("path").distinct()
        rows = asked.unionByName(wanted).join(tops, "path", "left_semi").distinct()
        # what is wanted of a barrel is wanted of the barrels behind it too
        rows = rows.unionByName(rows.withColumnRenamed("path", "file").join(self.reached, "file").select(F.col("behind").alias("path"), "name").join(tops, "path", "left_semi")).distinct()
        rows = rows.join(self.exports.select("path", "name"), ["path", "name"], "left_anti")
        step = rows.join(self.stars.where("target is not null").select("path", F.col("target").alias("g")), "path").where("name <> 'default'").select(node("Export", "path", "name").alias("src"), "path", "g", "name", F.lit(0).cast("long").alias("ord"))
        here = self._could(step)
        none = rows.select(node("Export", "path", "name").alias("src"), "path").join(here.select("src"), "src", "left_anti")
        if self.inline:
            loads = rows.select(node("Export", "path", "name").alias("src"), node("ModuleInit", "path").alias("dst"), F.lit(5_000_000).cast("long").alias("ord")).distinct()
            here = here.select("src", "dst", "ord").unionByName(loads)
        return here.select("src", "dst", "ord", F.lit(0).cast("long").alias("sub")).unionByName(none.select("src", node("File", "path").alias("dst"), F.lit(0).cast("long").alias("ord"), F.lit(0).cast("long").alias("sub")).distinct())

    def _could(self, step: DataFrame) -> DataFrame:
        """Star targets that could provide the name; opaque ones could provide any."""
        out = self._named(step.select("src", "g", "name", "ord"))
        named = out.where(F.col("dst").startswith("Export("))
        files = out.where(F.col("dst").startswith("File(")).join(self.fine.select(node("File", "path").alias("dst")), "dst", "left_anti")
        return named.unionByName(files)


def symbol_marks(facts: DataFrame, changed: DataFrame, moved: DataFrame, graph: SymbolGraph) -> DataFrame:
    """Marked nodes: whole files, spans that changed runs meet, neighbours of gaps, moved imports."""
    fine = facts.where("fine")
    known = changed.join(fine, "path").where("base is not null").select("path", "base.*")
    whole = changed.join(fine.where("runs is not null or base is not null").select("path"), "path", "left_anti").select(node("File", "path").alias("node"))
    whole = whole.unionByName(known.where("whole").select(node("File", "path").alias("node")))
    # a declaration stands for its members too, but for edits that lie in a member alone
    of_decl = graph.decls.select("path", F.col("id").alias("d"), node("Decl", "path", "name").alias("node")).unionByName(graph.members.select("path", F.col("o").alias("d"), "node"))
    told = known.select("path", F.explode("decls").alias("d")).join(of_decl, ["path", "d"]).select("node")
    parts = known.select("path", F.explode("members").alias("m")).select("path", "m.*")
    told = told.unionByName(parts.join(graph.members.select("path", "o", F.col("member").alias("name"), "node"), ["path", "o", "name"]).select("node"))
    # an export statement that is touched may name another object than it did: its members count too
    forwards = graph.exports.where("kind = 'local'").select("path", F.col("name").alias("export"), "start", "end", F.col("target").alias("o")).join(graph.members.select("path", "o", "node"), ["path", "o"])
    names = known.select("path", F.explode(F.concat("exports", "lost")).alias("export"))
    told = told.unionByName(names.join(forwards, ["path", "export"]).select("node"))
    told = told.unionByName(names.select(node("Export", "path", "export").alias("node"))).unionByName(known.where("init").select(node("ModuleInit", "path").alias("node")))
    ranges = fine.where("runs is not null and base is null").select("path", F.explode("runs").alias("r")).select("path", "r.low", "r.high", "r.quiet").where("not quiet").drop("quiet").distinct()
    empty = changed.join(fine.where("runs is not null and size(runs) = 0 and base is null").select("path"), "path", "left_semi").select(node("File", "path").alias("node"))
    every = of_decl.groupBy("path", "d").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    spans = graph.decls.select("path", F.col("id").alias("d"), "start", "end", "members").join(every, ["path", "d"])
    decls = spans.select("path", "start", "end", "nodes")
    # what frames the members: before the first and behind the last
    frame = F.when(F.size("members") == 0, F.array(F.struct("start", "end"))).otherwise(F.array(F.struct("start", F.element_at("members", 1)["start"].alias("end")), F.struct(F.element_at("members", -1)["end"].alias("start"), "end")))
    framed = spans.select("path", F.explode(frame).alias("s"), "nodes").select("path", "s.*", "nodes").unionByName(graph.members.select("path", "start", "end", F.array("node").alias("nodes")))
    exports = graph.exports.select("path", "start", "end", F.array(node("Export", "path", "name")).alias("nodes"))
    # one that stands apart from its declaration
    apart = forwards.join(graph.decls.select("path", F.col("id").alias("o"), F.col("start").alias("own")), ["path", "o"]).where("start <> own")
    exports = exports.unionByName(apart.select("path", "start", "end", F.array("node").alias("nodes")))
    names = of_decl.select("path", F.col("d").alias("u"), F.col("node").alias("n"))
    imports = fine.select("path", F.explode("import_spans").alias("s")).select("path", "s.start", "s.end", F.explode("s.users").alias("u")).join(names, ["path", "u"])
    imports = imports.groupBy("path", "start", "end").agg(F.collect_set("n").alias("nodes")).withColumn("nodes", F.concat("nodes", F.array(node("ModuleInit", "path"))))
    met = cut(intervals.interval_join(framed.unionByName(exports).unionByName(imports), ranges, ["path"]))
    gaps = ranges.join(met.select("path", "low", "high").distinct(), ["path", "low", "high"], "left_anti")
    beside = gaps.join(decls, "path", "left").groupBy("path", "low", "high").agg(F.max_by("nodes", F.when(F.col("end") <= F.col("low"), F.col("end"))).alias("before"), F.min_by("nodes", F.when(F.col("start") >= F.col("high"), F.col("start"))).alias("after"))
    beside = beside.select(F.explode(F.concat(F.coalesce("before", F.array().cast("array<string>")), F.coalesce("after", F.array().cast("array<string>")), F.array(node("ModuleInit", "path")))).alias("node"))
    out = whole.unionByName(empty).unionByName(told).unionByName(met.select(F.explode("nodes").alias("node"))).unionByName(beside)
    # what reads a moved import, and the initialisation; a moved star makes the whole file new
    src = fine.select("path", F.posexplode("sources").alias("source", "specifier")).join(moved, ["path", "specifier"], "left_semi")
    readers = graph.decls.select("path", "name", F.explode("imports").alias("u")).select("path", "name", "u.source").join(src.select("path", "source"), ["path", "source"], "left_semi").select(node("Decl", "path", "name").alias("node"))
    parts = graph.members.select("path", "node", F.explode("imports").alias("u")).select("path", "node", "u.source").join(src.select("path", "source"), ["path", "source"], "left_semi").select("node")
    readers = readers.unionByName(parts)
    again = graph.exports.where("kind in ('reexport', 'all')").select("path", "name", F.col("target").alias("source")).join(src.select("path", "source"), ["path", "source"], "left_semi").select(node("Export", "path", "name").alias("node"))
    stars = fine.select("path", F.explode("stars").alias("source")).join(src.select("path", "source"), ["path", "source"], "left_semi").select(node("File", "path").alias("node"))
    rest = moved.join(fine.select("path"), "path", "left_anti").select(node("File", "path").alias("node"))
    return out.unionByName(readers).unionByName(again).unionByName(stars).unionByName(rest).unionByName(src.select(node("ModuleInit", "path").alias("node"))).distinct()


def analyse_symbols(files: DataFrame, change: files_plan.Change, anchors: list[str], config_name: str = CONFIG, include_types: bool = False, earlier: dict[str, str] | None = None, before: DataFrame | None = None, only: str | None = None, entries: list[str] | None = None) -> DataFrame:
    """As files_plan.analyse, over symbols; upstream stays over files.

    ``before`` (path, content) has changed files as they were: they are compared statement by
    statement, which says more than lines do. ``entries`` are modules that the build starts from:
    who writes to a module's state then counts only where such an entry can run it.
    """
    spark = files.sparkSession
    files = files.select("path", "content")
    earlier = earlier or {}
    p = files_plan.prepared(files, change, anchors, config_name, include_types, earlier, before)
    if p.nothing:
        return files_plan.nothing_reached(spark, anchors)
    lines = change.rows(spark).where("start is not null").join(p.changed, "path", "left_semi").groupBy("path").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length"))).alias("runs"))
    opaque = change.rows(spark).where("change = 'opaque'").select("path").distinct()
    facts = cut(module_facts(files, lines.join(opaque, "path", "left_anti"), include_types, p.layout, before))
    out = None
    for bundler, own in p.groups.items():
        now, moved, edges, marked_files = p.for_bundler(bundler)
        first = edges.join(edges.groupBy("path", "specifier").agg(F.min("target").alias("target")), ["path", "specifier", "target"], "left_semi")
        graph = SymbolGraph(facts, first.select("path", "specifier", "target").distinct(), p.layout, edges.select("path", "ord", "target"), bundler[2])
        symbol_edges = cut(graph.edges())
        gaps = files_plan.unresolved(p, edges)
        from_here = [e for e in entries or [] if files_plan.bundler_key(p.layout, e) == bundler]
        if from_here and (running := graph.running(symbol_edges, from_here, gaps)) is not None:
            idle = symbol_edges.where("writer").join(running.withColumnRenamed("node", "dst"), "dst", "left_anti")
            symbol_edges = cut(symbol_edges.join(idle.select("src", "dst"), ["src", "dst"], "left_anti"))
        marks = symbol_marks(facts, p.changed, moved, graph).unionByName(marked_files.select(node("File", "path").alias("node")))
        marks = cut(marks.distinct())
        # a marked file marks its nodes
        nodes = symbol_edges.select(F.col("src").alias("node")).unionByName(symbol_edges.select(F.col("dst").alias("node"))).distinct()
        umbrella = nodes.withColumn("home", node("File", path_of("node"))).join(marks.select(F.col("node").alias("home")), "home", "left_semi").select("node")
        marks = cut(marks.unionByName(umbrella).distinct())
        starts = spark.createDataFrame([(a, f"File({a})", 0) for a in own], "anchor string, node string, pos long")
        visited, hits = closure.search(symbol_edges, starts if only != "upstream" else starts.limit(0), marks)
        down = cut(closure.witness(visited, hits).select("anchor", F.lit(True).alias("affected"), F.lit("downstream").alias("direction"), path_of(F.element_at("path", -1)).alias("changed"), "path"))
        left = [r["anchor"] for r in starts.select("anchor").join(down, "anchor", "left_anti").collect()]
        rank = F.dense_rank().over(Window.partitionBy("path").orderBy("ord", "target"))
        file_edges = cut(edges.select(F.col("path").alias("src"), F.col("target").alias("dst"), rank.cast("long").alias("ord")))
        seen = visited.select("anchor", path_of("node").alias("path")).distinct()
        found = down
        if left and only != "downstream":
            others, more = files_plan.answers(file_edges, left, spark.createDataFrame([], "node string"), p.changed, "upstream")
            found, seen = found.unionByName(others), seen.unionByName(more).distinct()
        elif left:
            none = spark.createDataFrame([(a, False) for a in left], "anchor string, affected boolean")
            found = found.unionByName(none, allowMissingColumns=True)
        found = files_plan.with_unresolved(found, seen, gaps)
        out = found if out is None else out.unionByName(found)
    return out

