"""Which anchors can a change reach? Answered over files: imports are edges, changes are marks.

Files become requests (scan), requests candidates (resolution), candidates meet the files and
the first step that has any wins: that is the edge table. Marks are changed files, files whose
imports now mean something else than before the change, and changed packages. Each anchor is
searched first in, first out; the first marked node is the witness.

What is not understood counts as changed, never as unchanged.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.resolution import Bundler, Layout, Resolver, alias_targets, joined, named_projects
from tidemark.functions.text import STYLES, is_source, is_style, package_name
from tidemark.functions.types import erased, runs_nothing
from tidemark.operators import closure, folds, matching
from tidemark.shared import cut
from tidemark.sources.compare import same_module
from tidemark.sources.config import CONFIG, ConfigError, above, nearest, read_config
from tidemark.sources.diff import Entry, parse_diff
from tidemark.sources.lockfile import changed_packages
from tidemark.sources.scan import scan_files

#: Configuration is gathered on the driver and sent to executors up to so many files.
MAX_CONFIG_FILES = 100_000


@dataclass
class Change:
    """Files a change names, as rows and as what became of them."""

    entries: list[Entry] = field(default_factory=list)
    named: list[str] = field(default_factory=list)

    @classmethod
    def read(cls, diff: str = "", named: list[str] | None = None) -> Change:
        return cls(parse_diff(diff), [posixpath.normpath(p) for p in named or []])

    @property
    def gone(self) -> set[str]:
        return {e.path for e in self.entries if e.change == "deleted"} | {e.renamed_from for e in self.entries if e.renamed_from}

    @property
    def added(self) -> set[str]:
        return {e.path for e in self.entries if e.added or e.renamed_from}

    def rows(self, spark: SparkSession) -> DataFrame:
        """(path, change, start, length); a path that is only named is opaque."""
        rows = [(e.path, e.change, a, n) for e in self.entries for a, n in e.runs or [(None, None)]]
        return spark.createDataFrame(rows + [(p, "opaque", None, None) for p in self.named], "path string, change string, start long, length long")


def read_layout(files: DataFrame, config_name: str = CONFIG) -> tuple[Layout, dict[str, str]]:
    """The tree's configuration and, by file, what is wrong with it."""
    name = F.element_at(F.split("path", "/"), -1)
    small = files.where((name == config_name) | (name == "package.json") | name.rlike(r"^[tj]sconfig.*\.json$")).select("path", "content")
    if small.count() > MAX_CONFIG_FILES:
        raise ValueError(f"more than {MAX_CONFIG_FILES} configuration files")
    texts, declared, errors, asked = {}, {}, {}, set()
    while not small.isEmpty():
        for r in small.collect():
            try:
                text = bytes(r["content"]).decode()
            except UnicodeDecodeError:
                continue
            if posixpath.basename(r["path"]) == config_name:
                try:
                    declared[posixpath.dirname(r["path"])] = read_config(posixpath.dirname(r["path"]), text)
                except ConfigError as e:
                    errors[r["path"]] = str(e)
            else:
                texts[r["path"]] = text
        # projects may go on in files of any name
        more = named_projects(texts) - texts.keys() - asked
        asked |= more
        small = files.join(F.broadcast(files.sparkSession.createDataFrame([(p,) for p in sorted(more)], "path string")), "path", "left_semi").select("path", "content")
    return Layout(texts, declared), errors


def bundler_of(layout: Layout, anchor: str) -> Bundler:
    chain = layout.chain(posixpath.dirname(anchor))
    return Bundler(tuple(nearest(chain, "conditions", ["import", "require"])), tuple(nearest(chain, "main_fields", ["main"])))


def bundler_key(layout: Layout, path: str) -> tuple:
    """What files must have in common to be searched on one edge table."""
    b = bundler_of(layout, path)
    return b.conditions, b.main_fields, bool(nearest(layout.chain(posixpath.dirname(path)), "inline_requires", False))


def resolve(requests: DataFrame, files: DataFrame, resolver: Resolver) -> DataFrame:
    """(path, specifier, ord) to (path, specifier, ord, target): ranked join with the files."""
    sent = requests.sparkSession.sparkContext.broadcast(resolver)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, s, o, step, t) for p, s, o in zip(*(batch.column(c).to_pylist() for c in ("path", "specifier", "ord")), strict=True) for step, t in sent.value.candidates(p, s)]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "specifier", "ord", "step", "target"])

    tried = requests.select("path", "specifier", "ord").mapInArrow(run, "path string, specifier string, ord long, step long, target string")
    present = tried.join(files.select(F.col("path").alias("target")), "target")
    found = matching.first_step(present, ["path", "specifier", "ord"], "step").select("path", "specifier", "ord", "target").distinct()
    if not any(d.outputs for d in resolver.layout.declared.values()):
        return found
    found = cut(found)
    return found.unionByName(built(requests.select("path", "specifier", "ord").join(found, ["path", "specifier"], "left_anti"), files, resolver))


def listed(files: DataFrame) -> DataFrame:
    """The files that globs of the configuration are about: none installed, none hidden."""
    return files.where(~F.col("path").rlike(r"(^|/)(node_modules|\.[^/]*)/")).select("path")


def built(missing: DataFrame, files: DataFrame, resolver: Resolver) -> DataFrame:
    """Relative requests without a file that name a declared build output, to the files that it is
    built from. What a request asks for is a pair of patterns; there are as many different ones as
    sets of declared outputs, and each meets the tree's files once."""
    sent = missing.sparkSession.sparkContext.broadcast(resolver)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, s, o, *x) for p, s, o in zip(*(batch.column(c).to_pylist() for c in ("path", "specifier", "ord")), strict=True) if (x := sent.value.output(p, s))]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "specifier", "ord", "takes", "leaves"])

    asked = cut(missing.mapInArrow(run, "path string, specifier string, ord long, takes string, leaves string"))
    sets = F.broadcast(asked.select("takes", "leaves").distinct())
    takes, leaves = F.rlike("target", "takes"), (F.col("leaves") != "") & F.rlike("target", "leaves")
    made = listed(files).withColumnRenamed("path", "target").join(sets, takes & ~leaves)
    return asked.join(made, ["takes", "leaves"]).select("path", "specifier", "ord", "target").distinct()


def layout_before(layout: Layout, change: Change, earlier: dict[str, str]) -> Layout:
    """Configuration as it was: without what the change adds, with the earlier texts known."""
    texts = {p: t for p, t in layout.texts.items() if p not in change.added}
    return Layout(texts | {p: t for p, t in earlier.items() if p.endswith(".json")}, layout.declared)


def moved_imports(now: DataFrame, requests: DataFrame, files: DataFrame, change: Change, resolver: Resolver) -> DataFrame:
    """(path, specifier) of imports that resolved to something else in the tree before the change;
    ``resolver`` knows the configuration of then."""
    spark = files.sparkSession
    gone = spark.createDataFrame([(p,) for p in sorted(change.gone)], "path string")
    added = spark.createDataFrame([(p,) for p in sorted(change.added - change.gone)], "path string")
    before = resolve(requests, files.select("path").join(added, "path", "left_anti").unionByName(gone).distinct(), resolver)
    as_set = lambda df, n: df.groupBy("path", "specifier").agg(F.sort_array(F.collect_set("target")).alias(n))
    both = as_set(now, "now").join(as_set(before, "before"), ["path", "specifier"], "full")
    return both.where(~F.col("now").eqNullSafe(F.col("before"))).select("path", "specifier").distinct()


def _unread_configs(change: Change, earlier: dict[str, str]) -> set[str]:
    """JSON whose earlier text nobody has: package manifests and lockfiles have rules of their own."""
    paths = {e.path for e in change.entries if not e.added} | set(change.named) | change.gone
    return {p for p in paths - earlier.keys() if p.endswith(".json") and posixpath.basename(p) not in ("package.json", "package-lock.json")}


def changed_files(files: DataFrame, change: Change, include_types: bool = False) -> DataFrame:
    """Paths of present files that the change may alter: runs of type-only lines alter nothing."""
    rows = change.rows(files.sparkSession).where("change <> 'deleted'").join(files.select("path"), "path", "left_semi")
    whole = rows.where("start is null").select("path")
    typed = F.col("path").rlike(r"\.[cm]?tsx?$") & F.lit(not include_types)
    runs = rows.where("start is not null")
    plain = runs.where(~typed).select("path")
    parts = runs.where(typed).groupBy("path").agg(F.collect_list(F.struct("start", "length")).alias("runs")).join(files.select("path", "content"), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, runs_, content in zip(*(batch.column(c).to_pylist() for c in ("path", "runs", "content")), strict=True):
                try:
                    text = content.decode()
                    lines = erased(text).split("\n")
                    if all(runs_nothing(text, r["start"], r["length"], lines) for r in runs_):
                        continue
                except UnicodeDecodeError:
                    pass
                out.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["path"])

    return whole.unionByName(plain).unionByName(parts.mapInArrow(run, "path string")).distinct()


def unchanged(files: DataFrame, before: DataFrame, include_types: bool = False) -> DataFrame:
    """(path) of the sources that differ from their earlier versions in nothing that counts."""
    both = files.where(is_source(F.col("path"))).join(before.select("path", F.col("content").alias("was")), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("path", "content", "was")), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, now, was in rows if same_module(was, now, p, include_types)], pa.string())], ["path"])

    return both.select("path", "content", "was").mapInArrow(run, "path string")


@dataclass
class Prepared:
    """What both granularities need: configuration, requests, changed files and packages."""

    files: DataFrame
    change: Change
    layout: Layout
    earlier: dict[str, str]
    requests: DataFrame
    changed: DataFrame
    packages: DataFrame
    every: bool
    groups: dict[tuple, list[str]]
    before: DataFrame | None = None

    @property
    def nothing(self) -> bool:
        """Whether the change alters no file, package or import."""
        moving = self.change.gone or self.change.added or self.earlier or _unread_configs(self.change, self.earlier)
        return not moving and not self.every and self.changed.isEmpty() and self.packages.isEmpty()

    def for_bundler(self, bundler: tuple) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(resolved, moved (path, specifier), edges (path, specifier, ord, target), marked files and packages)."""
        resolver = Resolver(self.layout, Bundler(*bundler[:2]))
        now = cut(resolve(self.requests, self.files, resolver))
        moved = self.requests.select("path", "specifier").limit(0)
        if self.change.gone or self.change.added or self.earlier:
            then = Resolver(layout_before(self.layout, self.change, self.earlier), resolver.bundler)
            moved = moved_imports(now, self.requests, self.files, self.change, then)
        unread = _unread_configs(self.change, self.earlier)
        if unread:
            moved = moved.unionByName(_governed(self.requests, self.layout, unread).join(self.requests.select("path", "specifier"), "path"))
        moved = cut(moved.distinct())
        named = self.requests.where(~F.col("path").rlike(r"\.(" + "|".join(STYLES) + ")$")).withColumn("package", package_name(F.col("specifier"))).where("package <> ''")
        redirected = named if self.every else named.join(self.packages, "package", "left_semi")
        redirected = redirected.select("path", "specifier", "ord", F.concat(F.lit("node_modules/"), "package").alias("target"))
        edges = cut(now.join(redirected.select("path", "specifier"), ["path", "specifier"], "left_anti").unionByName(redirected))
        return now, moved, edges, redirected.select(F.col("target").alias("path")).distinct()


def prepared(files: DataFrame, change: Change, anchors: list[str], config_name: str, include_types: bool, earlier: dict[str, str], before: DataFrame | None = None) -> Prepared:
    spark = files.sparkSession
    layout, errors = read_layout(files, config_name)
    for anchor in anchors:
        broken = [e for e in errors if posixpath.dirname(e) == "" or anchor.startswith(posixpath.dirname(e) + "/")]
        if broken:
            raise ConfigError(f"{broken[0]}: {errors[broken[0]]}")
    known = {r["path"] for r in files.select("path").join(spark.createDataFrame([(a,) for a in anchors], "path string"), "path", "left_semi").collect()}
    if missing := [a for a in anchors if a not in known]:
        raise ValueError(f"no such anchor: {', '.join(missing)}")
    requests = cut(scan_files(files.where(is_source(F.col("path")) | is_style(F.col("path"))), include_types))
    changed = changed_files(files, change, include_types)
    if before is not None:
        changed = changed.join(unchanged(files, before, include_types), "path", "left_anti")
    changed = cut(changed)
    texts = files.where(F.element_at(F.split("path", "/"), -1).isin("pnpm-lock.yaml", "package-lock.json")).select("path", F.decode("content", "UTF-8").alias("text"))
    packages = cut(changed_packages(texts, change.rows(spark)))
    groups: dict[tuple, list[str]] = {}
    for a in anchors:
        groups.setdefault(bundler_key(layout, a), []).append(a)
    return Prepared(files, change, layout, earlier, requests, changed, packages, packages.where("package is null").count() > 0, groups, before)


def analyse(files: DataFrame, change: Change, anchors: list[str], config_name: str = CONFIG, include_types: bool = False, earlier: dict[str, str] | None = None, before: DataFrame | None = None, only: str | None = None) -> DataFrame:
    """(anchor, affected, direction, changed, path, unresolved) for each anchor; files: (path, content).

    ``earlier`` has texts of configuration files before the change, as far as they are known;
    ``before`` (path, content) has changed files as they were: those that differ in nothing that
    counts are left out. ``only`` is one of the directions. Anchors whose bundlers differ are
    searched on edge tables of their own.
    """
    p = prepared(files.select("path", "content"), change, anchors, config_name, include_types, earlier or {}, before)
    if p.nothing:
        return nothing_reached(files.sparkSession, anchors)
    out = None
    for bundler, own in p.groups.items():
        _, moved, edges, packages = p.for_bundler(bundler)
        resolved = edges
        marks = p.changed.select("path").unionByName(moved.select("path")).unionByName(packages).distinct()
        rank = F.dense_rank().over(matching.Window.partitionBy("path").orderBy("ord", "target"))
        edges = cut(edges.select(F.col("path").alias("src"), F.col("target").alias("dst"), rank.cast("long").alias("ord")))
        found, seen = answers(edges, own, cut(marks.select(F.col("path").alias("node"))), p.changed, only)
        found = with_unresolved(found, seen, unresolved(p, resolved))
        out = found if out is None else out.unionByName(found)
    return out


def nothing_reached(spark: SparkSession, anchors: list[str]) -> DataFrame:
    """The answers to a change of nothing: nothing was searched, nothing asked for."""
    kind = "anchor string, affected boolean, direction string, changed string, path array<string>, unresolved array<struct<specifier:string,kind:string,in_repo:boolean,from:array<string>>>"
    return spark.createDataFrame([(a, False, None, None, None, []) for a in anchors], kind)


def _governed(requests: DataFrame, layout: Layout, unread: set[str]) -> DataFrame:
    """Files whose imports a changed configuration of unknown earlier text decides about, or may
    have decided about: everything below it, since what it excluded then is not known."""
    below = [posixpath.join(posixpath.dirname(u), "") for u in unread if posixpath.basename(u).startswith(("tsconfig", "jsconfig"))]
    sent = requests.sparkSession.sparkContext.broadcast(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [p for p in batch.column("path").to_pylist() if any(p.startswith(b) for b in below) or sent.value.consulted(p) & unread]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return requests.where(is_source(F.col("path"))).select("path").distinct().mapInArrow(run, "path string")


def opened(visited: DataFrame, hits: DataFrame) -> DataFrame:
    """Visited nodes that were taken from the queue before the hit, so that their edges were read."""
    return visited.join(hits.select("anchor", F.col("at").alias("hit")), "anchor", "left").where("hit is null or at < hit")


def _upstream(edges: DataFrame, left: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(anchor, direction, path) of the anchors that changed files reach, and (anchor, path) of what
    was asked for them. Changed files are tried in order; the first that arrives answers.

    The first for all anchors at once is the least label that arrives, and files that an earlier
    try has opened are those of a lesser label. Only the files that do answer an anchor, at most
    as many as there are anchors, are searched in order of the queue.
    """
    labels = closure.least_sources(edges, changed.select(F.col("path").alias("node")))
    first = cut(left.join(labels, F.col("anchor") == F.col("node")).select("anchor", F.col("source").alias("root")))
    roots = first.select(F.col("root").alias("anchor"), F.col("root").alias("node"), F.lit(0).cast("long").alias("pos")).distinct()
    reached, _ = closure.search(edges, roots, edges.select(F.col("src").alias("node")).limit(0), complete=True)
    reached = cut(reached.withColumnRenamed("anchor", "root"))
    met = cut(first.join(reached.select("root", F.col("node").alias("anchor"), "at"), ["root", "anchor"]))
    before = F.broadcast(left.join(first, "anchor", "left")).join(labels, F.expr("root is null or source < root")).select("anchor", F.col("node").alias("path"))
    own = F.broadcast(met.select("anchor", "root", F.col("at").alias("end"))).join(reached, "root").where("at < end").select("anchor", F.col("node").alias("path"))
    seen = before.unionByName(own).distinct()
    if met.isEmpty():
        return left.select("anchor", F.lit("upstream").alias("direction"), F.array("anchor").alias("path")).limit(0), seen
    walks = closure.witness(reached.withColumnRenamed("root", "anchor"), met.select(F.col("root").alias("anchor"), F.col("anchor").alias("node"), "at").distinct())
    return walks.select(F.element_at("path", -1).alias("anchor"), F.lit("upstream").alias("direction"), "path").distinct().join(left, "anchor"), seen


def answers(edges: DataFrame, anchors: list[str], marks: DataFrame, changed: DataFrame, direction: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Downstream for every anchor; upstream from changed files for those that nothing reached;
    or one of these directions only.

    Also (anchor, path) of the files whose imports each anchor's searches have asked for.
    """
    spark = edges.sparkSession
    starts = spark.createDataFrame([(a, a, 0) for a in anchors], "anchor string, node string, pos long")
    if direction == "upstream":
        down = spark.createDataFrame([], "anchor string, direction string, path array<string>")
        seen, left = spark.createDataFrame([], "anchor string, path string"), starts.select("anchor")
    else:
        visited, hits = closure.search(edges, starts, marks)
        down = closure.witness(visited, hits).select("anchor", F.lit("downstream").alias("direction"), "path")
        seen = opened(visited, hits).select("anchor", F.col("node").alias("path"))
        left = cut(starts.select("anchor").join(hits, "anchor", "left_anti"))
    if direction != "downstream" and not left.isEmpty() and not changed.isEmpty():
        walks, tried = _upstream(edges, left, changed)
        down, seen = down.unionByName(walks), seen.unionByName(tried)
    found = cut(down)
    shown = F.transform("path", lambda p: F.concat(F.lit("File("), p, F.lit(")")))
    end = F.when(F.col("direction") == "downstream", F.element_at("path", -1)).otherwise(F.element_at("path", 1))
    told = starts.select("anchor").join(found, "anchor", "left").select("anchor", F.col("direction").isNotNull().alias("affected"), "direction", end.alias("changed"), shown.alias("path"))
    return told, cut(seen.distinct())


# Modules of Node and of Sass, which name no file; kinds from the nearest to the least.
BUILTINS = frozenset(
    "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path "
    "perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls trace_events tty url util v8 vm wasi worker_threads zlib".split()
)
KINDS = ("path", "alias", "package", "missing-package", "installed")
IN_REPO = 3
LEAVES = "json|png|jpg|jpeg|gif|webp|avif|ico|bmp|svg|woff|woff2|ttf|otf|eot|mp3|mp4|webm|wav|ogg|txt"


def unresolved(p: Prepared, resolved: DataFrame) -> DataFrame:
    """(path, specifier, kind number) of what names nothing and should.

    The name of a package, of a stylesheet's neighbour, of an alias: the first rule that holds
    decides. Modules of Node and Sass, packages of types alone and missing leaves are no gaps.
    """
    layout = p.layout
    sent = p.files.sparkSession.sparkContext.broadcast(layout)
    missing = p.requests.select("path", "specifier").join(resolved.select("path", "specifier").distinct(), ["path", "specifier"], "left_anti")
    bare = F.element_at(F.split("specifier", "!"), -1)
    missing = missing.where(~bare.rlike(rf"^\.\.?/.*\.({LEAVES})$") & ~bare.rlike("^(node|sass|https?|data):") & ~bare.startswith("//"))
    missing = missing.withColumn("name", F.regexp_extract(F.ltrim(bare, F.lit("~")), r"^(@[^/]+/[^/]+|[^@./#][^/]*)", 1))
    # is the package there, in a directory above?
    dirs = p.files.select(F.regexp_extract("path", r"^((?:.*/)?node_modules/(?:@[^/]+/[^/]+|[^@/][^/]*))/", 1).alias("home")).where("home <> ''").distinct()
    up = missing.where("name <> ''").select("path", "specifier", F.explode(folds.ancestors(F.col("path"))).alias("dir"), "name")
    home = F.concat(F.col("dir"), F.when(F.col("dir") == "", "").otherwise("/"), F.lit("node_modules/"), F.col("name"))
    there = up.withColumn("home", home).join(dirs, "home", "left_semi").select("path", "specifier", F.lit(True).alias("there")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resolver = Resolver(sent.value)
        own = {d.get("name") for d in sent.value.packages.values()}
        for batch in batches:
            out = []
            for path, specifier, name, there_ in zip(*(batch.column(c).to_pylist() for c in ("path", "specifier", "name", "there")), strict=True):
                kind = _kind(resolver, path, specifier.rpartition("!")[2], name, bool(there_), own)
                if kind is not None:
                    out.append((path, specifier, kind))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.string(), pa.int32()))], ["path", "specifier", "kind"])

    return missing.join(there, ["path", "specifier"], "left").mapInArrow(run, "path string, specifier string, kind int")


def _kind(resolver: Resolver, path: str, specifier: str, name: str, there: bool, own: set) -> int | None:
    layout, here = resolver.layout, posixpath.dirname(path)
    style = path.rpartition(".")[2] in STYLES
    if not style and (name in BUILTINS or resolver.output(path, specifier)):
        return None
    homes = [layout.packages.get(joined(d, "node_modules/" + name)) for d in above(here)] if name else []
    if not style and any(h and (h.get("types") or h.get("typings")) and not any(h.get(k) for k in ("main", "module", "exports")) for h in homes):
        return None
    if "node_modules" in path.split("/"):
        return 4
    if specifier[:1] in (".", "/"):
        return 0
    if specifier[:1] == "#":
        return 1
    chain = layout.chain(here)
    if style and not specifier.startswith("~") and not any(next(alias_targets(chain, specifier, t), None) for t in ("aliases", "style_aliases")):
        return 0
    specifier = specifier.removeprefix("~") if style else specifier
    if any(next(alias_targets(chain, specifier, t), None) for t in ("aliases", "style_aliases")):
        return 1
    if there or name in own:
        return 2
    project = layout.project_for(path)
    if project and next(resolver.project_paths(project, specifier), None):
        return 1
    return 3


def with_unresolved(found: DataFrame, seen: DataFrame, gaps: DataFrame) -> DataFrame:
    """Answers with what the files that each anchor visited could not place, by specifier; a
    specifier's kind is the nearest of its writers'."""
    rows = seen.join(gaps, "path").groupBy("anchor", "specifier").agg(F.min("kind").alias("k"), F.sort_array(F.collect_set("path")).alias("from"))
    label = F.element_at(F.array(*map(F.lit, KINDS)), F.col("k") + 1)
    rows = rows.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("specifier", label.alias("kind"), (F.col("k") < IN_REPO).alias("in_repo"), "from"))).alias("unresolved"))
    none = F.array().cast("array<struct<specifier:string,kind:string,in_repo:boolean,from:array<string>>>")
    return found.join(rows, "anchor", "left").withColumn("unresolved", F.coalesce("unresolved", none))
