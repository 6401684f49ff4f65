"""The general operators over ordinary analytic tables, and the same questions in DuckDB's SQL.

Every query reads its whole tables. Counts are 64 bit, lists are joined to strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import closure, folds, intervals, matching
from tidemark.shared import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c: str) -> F.Column:
    return F.col(c).cast("long")


# --- graphs -----------------------------------------------------------------------------------

FK_SQL = """
  SELECT DISTINCT 'o:' || o_orderkey AS src, 'c:' || o_custkey AS dst, 'customer' AS rule FROM orders
  UNION SELECT 'o:' || l_orderkey, 'p:' || l_partkey, 'part' FROM lineitem UNION SELECT 'o:' || l_orderkey, 's:' || l_suppkey, 'supplier' FROM lineitem
  UNION SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'nation' FROM customer UNION SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'nation' FROM supplier
  UNION SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'region' FROM nation"""


def fk_edges(spark: SparkSession, d: str) -> DataFrame:
    def edges(table: str, kind: str, key: str, to: str, other: str, rule: str) -> DataFrame:
        return t(spark, d, table).select(F.concat(F.lit(kind + ":"), key).alias("src"), F.concat(F.lit(to + ":"), other).alias("dst"), F.lit(rule).alias("rule"))

    out = edges("orders", "o", "o_orderkey", "c", "o_custkey", "customer")
    for x in (("lineitem", "o", "l_orderkey", "p", "l_partkey", "part"), ("lineitem", "o", "l_orderkey", "s", "l_suppkey", "supplier"), ("customer", "c", "c_custkey", "n", "c_nationkey", "nation"), ("supplier", "s", "s_suppkey", "n", "s_nationkey", "nation"), ("nation", "n", "n_nationkey", "r", "n_regionkey", "region")):
        out = out.unionByName(edges(*x))
    return out.distinct()


PART_SQL = "SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL"


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return t(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst is not null").distinct()


NATION_SQL = "SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey"


def nation_edges(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return lines.join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).distinct()


@query(f"WITH RECURSIVE e AS MATERIALIZED ({FK_SQL}), r(node, hops) AS (SELECT 'o:' || o_orderkey, 0 FROM orders UNION SELECT e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node) SELECT node, CAST(min(hops) AS BIGINT) AS hops FROM r GROUP BY node")
def q01_reach_fk(spark, d):
    return closure.reach(fk_edges(spark, d), t(spark, d, "orders").select(F.concat(F.lit("o:"), "o_orderkey").alias("node")))


@query(f"WITH RECURSIVE e AS MATERIALIZED ({FK_SQL}), r(node, hops) AS (SELECT 'o:' || o_orderkey, 0 FROM orders UNION SELECT e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node) SELECT split_part(node, ':', 1) AS kind, CAST(hops AS BIGINT) AS hops, count(DISTINCT node) AS n FROM r GROUP BY ALL")
def q02_reach_fk_cte(spark, d):
    """The same as one plan, for a graph of known depth: four levels, each of different nodes only.
    Spark's own recursion has no such step between levels and stops at a million rows."""
    level = t(spark, d, "orders").select(F.concat(F.lit("o:"), "o_orderkey").alias("node"))
    edges, out = cut(fk_edges(spark, d)), None
    for hops in range(4):
        told = level.select("node", F.lit(hops).cast("long").alias("hops"))
        out = told if out is None else out.unionByName(told)
        level = level.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
    return out.groupBy(F.substring_index("node", ":", 1).alias("kind"), "hops").agg(F.countDistinct("node").alias("n"))


@query(f"WITH RECURSIVE e AS MATERIALIZED ({PART_SQL}), r(node, hops) AS (SELECT p_partkey, 0 FROM part WHERE p_size = 1 UNION SELECT e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node WHERE r.hops < 3) SELECT node, CAST(min(hops) AS BIGINT) AS hops FROM r GROUP BY node")
def q03_reach_parts(spark, d):
    return closure.reach(part_edges(spark, d), t(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("node")), max_hops=3)


@query(f"WITH RECURSIVE e AS MATERIALIZED ({FK_SQL}), r(node, hops) AS (SELECT 'r:' || r_regionkey, 0 FROM region WHERE r_name = 'ASIA' UNION SELECT e.src, r.hops + 1 FROM r JOIN e ON e.dst = r.node) SELECT node, CAST(min(hops) AS BIGINT) AS hops FROM r WHERE node LIKE 'o:%' GROUP BY node")
def q04_upstream_orders(spark, d):
    back = fk_edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = t(spark, d, "region").where("r_name = 'ASIA'").select(F.concat(F.lit("r:"), "r_regionkey").alias("node"))
    return closure.reach(back, seeds).where("node like 'o:%'")


@query("SELECT o_orderkey, coalesce(bool_or(s_acctbal < 0), false) AS affected FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY o_orderkey")
def q05_affected_anchor(spark, d):
    """Each order: does its closure hold a supplier with debts? Marks are followed back once."""
    back = fk_edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    marks = t(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s:"), "s_suppkey").alias("node"))
    hit = closure.reach(back, marks).where("node like 'o:%'").select("node", F.lit(True).alias("hit"))
    return t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("o:"), "o_orderkey").alias("node")).distinct().join(hit, "node", "left").select("o_orderkey", F.coalesce("hit", F.lit(False)).alias("affected"))


@query(f"WITH RECURSIVE e AS MATERIALIZED ({NATION_SQL}), r(anchor, node, hops) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION SELECT r.anchor, e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node WHERE r.hops < 25), m AS (SELECT anchor, node, min(hops) AS hops FROM r JOIN nation ON n_nationkey = node WHERE n_regionkey = 3 GROUP BY ALL) SELECT anchor, arg_min(node, hops * 100 + node) AS node, CAST(min(hops) AS BIGINT) AS hops FROM m GROUP BY anchor")
def q06_first_hit(spark, d):
    nation = t(spark, d, "nation")
    reached = closure.reach(nation_edges(spark, d), nation.select(F.col("n_nationkey").alias("anchor"), F.col("n_nationkey").alias("node")))
    marked = reached.join(nation.where("n_regionkey = 3").select(F.col("n_nationkey").alias("node")), "node", "left_semi")
    return marked.groupBy("anchor").agg(F.min_by("node", F.struct("hops", "node")).alias("node"), F.min("hops").alias("hops"))


@query("SELECT 'c:' || c_custkey AS anchor, CAST(2 AS BIGINT) AS hops, 'c:' || c_custkey || '>n:' || c_nationkey || '>r:' || n_regionkey AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey")
def q07_witness_path(spark, d):
    edges = cut(fk_edges(spark, d).withColumn("ord", F.lit(0)))
    anchors = t(spark, d, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("anchor"), F.concat(F.lit("c:"), "c_custkey").alias("node"), F.lit(0).alias("pos"))
    visited, hits = closure.search(edges, anchors, t(spark, d, "region").select(F.concat(F.lit("r:"), "r_regionkey").alias("node")))
    return closure.witness(visited, hits).select("anchor", (F.size("path") - 1).cast("long").alias("hops"), F.array_join("path", ">").alias("path"))


@query(f"WITH RECURSIVE e AS MATERIALIZED ({FK_SQL}), quiet(node) AS (SELECT 'c:' || c_custkey FROM customer WHERE c_acctbal < 0 UNION SELECT e.dst FROM quiet q JOIN e ON e.src = q.node AND rule <> 'region'), gate AS (SELECT node FROM quiet WHERE node LIKE 'n:%'), r(node) AS (SELECT 'o:' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node WHERE rule <> 'region' OR e.src IN (SELECT node FROM gate)) SELECT DISTINCT node FROM r")
def q08_running_gate(spark, d):
    """Edges of one rule are followed only from nodes that a closure without that rule reaches."""
    edges = cut(fk_edges(spark, d))
    debtors = t(spark, d, "customer").where("c_acctbal < 0")
    gate = closure.reach(edges.where("rule <> 'region'"), debtors.select(F.concat(F.lit("c:"), "c_custkey").alias("node"))).select(F.col("node").alias("src"))
    followed = edges.where("rule <> 'region'").unionByName(edges.where("rule = 'region'").join(gate, "src", "left_semi"))
    seeds = t(spark, d, "orders").join(debtors, F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("o:"), "o_orderkey").alias("node"))
    return closure.reach(followed, seeds).select("node")


@query(f"WITH RECURSIVE e AS MATERIALIZED ({NATION_SQL}), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT src, dst FROM r")
def q09_star_closure(spark, d):
    edges = nation_edges(spark, d)
    return closure.reach(edges, edges.select("src", F.col("dst").alias("node"))).select("src", F.col("node").alias("dst")).distinct()


@query()
def q10_pure_fixpoint(spark, d):
    """Parts that are proven by the dearer parts next to them; no plain SQL: negation in recursion."""
    dear = t(spark, d, "part").select("p_partkey", "p_size")
    edges = part_edges(spark, d).join(dear.select(F.col("p_partkey").alias("src"), F.col("p_size").alias("a")), "src").join(dear.select(F.col("p_partkey").alias("dst"), F.col("p_size").alias("b")), "dst").where("b >= a + 8")
    return closure.least_fixpoint(dear.select(F.col("p_partkey").alias("node")), edges)


@query(f"WITH RECURSIVE e AS MATERIALIZED ({FK_SQL}), r(node, source) AS (SELECT 'o:' || o_orderkey, 'o:' || o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT e.dst, r.source FROM r JOIN e ON e.src = r.node) SELECT node, min(source) AS source FROM r GROUP BY node")
def q45_least_sources(spark, d):
    """Of the pending orders that lead to a node, the least."""
    seeds = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("o:"), "o_orderkey").alias("node"))
    return closure.least_sources(fk_edges(spark, d), seeds)


# --- intervals, matching, windows over documents ------------------------------------------------

LINES_SQL = "lines AS (SELECT doc_id, unnest(string_split(text, E'\\n')) AS line, unnest(range(len(string_split(text, E'\\n')))) AS idx FROM documents WHERE text IS NOT NULL)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("idx", "line")).withColumn("idx", long("idx"))


def spans(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    out = lines(spark, d).withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).cast("long"))
    return out.withColumn("end", F.col("start") + F.length("line"))


SPANS_SQL = f"{LINES_SQL}, spans AS (SELECT *, start + length(line) AS \"end\" FROM (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM lines))"


@query(f"WITH {SPANS_SQL}, hunks AS (SELECT doc_id, n_chars // 4 AS low, n_chars // 4 + n_chars // 10 AS high FROM documents UNION ALL SELECT doc_id, n_chars // 2, n_chars // 2 FROM documents) SELECT doc_id, low, high, idx FROM spans JOIN hunks USING (doc_id) WHERE CASE WHEN low = high THEN low >= start AND low < \"end\" ELSE low < \"end\" AND high > start END")
def q11_hunk_spans(spark, d):
    docs = t(spark, d, "documents")
    hunks = docs.selectExpr("doc_id", "n_chars div 4 as low", "n_chars div 4 + n_chars div 10 as high").unionAll(docs.selectExpr("doc_id", "n_chars div 2", "n_chars div 2"))
    return intervals.interval_join(spans(spark, d), hunks, ["doc_id"]).select("doc_id", "low", "high", "idx")


@query("SELECT event_id, user_id, coalesce(before, -1) AS before, coalesce(after, -1) AS after FROM (SELECT *, last_value(CASE WHEN event_type <> 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(CASE WHEN event_type <> 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM events) WHERE event_type = 'error'")
def q12_gap_neighbours(spark, d):
    return intervals.neighbours(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", "event_id").select("event_id", "user_id", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("before", "after")])


@query(f"WITH {SPANS_SQL} SELECT doc_id, idx, CAST(start AS BIGINT) AS start, CAST(\"end\" AS BIGINT) AS \"end\" FROM spans")
def q13_line_bytes(spark, d):
    return spans(spark, d).select("doc_id", "idx", "start", "end")


@query(f"WITH {LINES_SQL}, marked AS (SELECT doc_id, idx, CASE WHEN regexp_matches(line, '^[A-Z][a-z]+[.,]?$') THEN line END AS header FROM lines), filled AS (SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM marked) SELECT doc_id, idx, section, coalesce(lead(idx) OVER (PARTITION BY doc_id ORDER BY idx) - 1, idx) AS last FROM filled WHERE header IS NOT NULL")
def q14_lock_entries(spark, d):
    header = F.when(F.col("line").rlike("^[A-Z][a-z]+[.,]?$"), F.col("line"))
    filled = matching.fill_sections(lines(spark, d).withColumn("header", header), ["doc_id"], "idx", F.col("header"))
    w = Window.partitionBy("doc_id").orderBy("idx")
    return filled.where("header is not null").select("doc_id", "idx", "section", F.coalesce(F.lead("idx").over(w) - 1, F.col("idx")).alias("last"))


PAIRS_SQL = f"{LINES_SQL}, docs AS (SELECT doc_id, lead(doc_id) OVER (PARTITION BY lang ORDER BY text, doc_id) AS next_id FROM documents), before AS (SELECT doc_id AS pair, line, idx, row_number() OVER (PARTITION BY doc_id, line ORDER BY idx) AS n FROM lines JOIN docs USING (doc_id) WHERE next_id IS NOT NULL), after AS (SELECT d.doc_id AS pair, line, idx, row_number() OVER (PARTITION BY d.doc_id, line ORDER BY idx) AS n FROM lines l JOIN docs d ON l.doc_id = d.next_id), matched AS (SELECT coalesce(b.pair, a.pair) AS pair, b.idx AS before_idx, a.idx AS after_idx FROM before b FULL JOIN after a ON a.pair = b.pair AND a.line = b.line AND a.n = b.n)"


def matched_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", F.lead("doc_id").over(Window.partitionBy("lang").orderBy("text", "doc_id")).alias("next_id")).where("next_id is not null")
    own = lines(spark, d)
    before = own.join(docs, "doc_id").select(F.col("doc_id").alias("pair"), "line", "idx")
    after = own.withColumnRenamed("doc_id", "next_id").join(docs, "next_id").select(F.col("doc_id").alias("pair"), "line", "idx")
    return matching.fifo_match(before, after, ["pair", "line"])


@query(f"WITH {PAIRS_SQL} SELECT pair, count(*) FILTER (WHERE before_idx IS NOT NULL AND after_idx IS NOT NULL) AS same, count(*) FILTER (WHERE before_idx IS NULL) AS added, count(*) FILTER (WHERE after_idx IS NULL) AS removed FROM matched GROUP BY pair")
def q15_fifo_match(spark, d):
    return matched_lines(spark, d).groupBy("pair").agg(F.count_if(F.expr("before_idx is not null and after_idx is not null")).alias("same"), F.count_if(F.expr("before_idx is null")).alias("added"), F.count_if(F.expr("after_idx is null")).alias("removed"))


@query(f"WITH {LINES_SQL}, sorted AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line, idx) AS idx FROM lines), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY idx) AS n FROM lines), a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY idx) AS n FROM sorted), matched AS (SELECT doc_id, b.idx AS before_idx, a.idx AS after_idx FROM b JOIN a USING (doc_id, line, n)) SELECT doc_id, count(*) AS moved FROM (SELECT *, max(before_idx) OVER (PARTITION BY doc_id ORDER BY after_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM matched) WHERE before_idx < top GROUP BY doc_id")
def q16_moved_lines(spark, d):
    """Lines that sorting a document would move, found by matching it with its sorted self."""
    before = lines(spark, d)
    after = before.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "idx")).cast("long"))
    return matching.moved(matching.fifo_match(before, after, ["doc_id", "line"]), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("moved"))


@query("WITH docs AS (SELECT doc_id, text, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS next_id FROM documents WHERE text IS NOT NULL), words AS (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS w FROM docs) SELECT d.doc_id, count(*) AS lost FROM docs d JOIN words x ON x.doc_id = d.doc_id WHERE next_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM words y WHERE y.doc_id = d.next_id AND y.w = x.w) GROUP BY d.doc_id")
def q17_lost_names(spark, d):
    docs = t(spark, d, "documents").where("text is not null").withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id"))).select("doc_id", "next_id", F.array_distinct(F.split("text", " ", -1)).alias("words"))
    other = docs.select(F.col("doc_id").alias("next_id"), F.col("words").alias("kept"))
    gone = docs.join(other, "next_id").select("doc_id", F.size(F.array_except("words", "kept")).cast("long").alias("lost"))
    return gone.where("lost > 0")


@query("WITH b AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-16'), a AS (SELECT DISTINCT user_id, nullif(event_type, 'signup') AS event_type FROM events WHERE ts >= TIMESTAMP '2024-01-29') SELECT user_id, event_type FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = b.user_id AND (a.event_type IS NULL OR a.event_type = b.event_type))")
def q18_lost_writes(spark, d):
    """What is gone: (user, type) before without the same after; a signup after covers any type."""
    events = t(spark, d, "events")
    before = events.where("ts < timestamp_ntz'2024-01-16'").select("user_id", "event_type").distinct()
    after = events.where("ts >= timestamp_ntz'2024-01-29'").select(F.col("user_id").alias("u"), F.nullif("event_type", F.lit("signup")).alias("any")).distinct()
    return before.join(after, F.expr("user_id = u and (any is null or any = event_type)"), "left_anti")


@query("SELECT c_custkey, c_nationkey, coalesce(s_nationkey, -1) AS s_nationkey FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey WHERE c_nationkey IS DISTINCT FROM s_nationkey")
def q19_moved_now_before(spark, d):
    both = t(spark, d, "customer").join(t(spark, d, "supplier"), F.col("s_suppkey") == F.col("c_custkey"), "left")
    return both.where(~F.col("c_nationkey").eqNullSafe(F.col("s_nationkey"))).select("c_custkey", "c_nationkey", F.coalesce("s_nationkey", F.lit(-1)).alias("s_nationkey"))


@query("SELECT l_partkey, arg_min(l_suppkey, row(-s_acctbal, l_suppkey)) AS l_suppkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey")
def q20_ranked_resolution(spark, d):
    candidates = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return matching.first_match(candidates, ["l_partkey"], [(-F.col("s_acctbal")).alias("worth"), F.col("l_suppkey").alias("key")], "l_suppkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem) WHERE r = 1")
def q21_ambiguous_keep_all(spark, d):
    return matching.first_step(t(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


CHAIN_SQL = "chain AS (SELECT c_custkey, 0 AS depth, CASE WHEN c_acctbal < 0 THEN c_mktsegment END AS v FROM customer UNION ALL SELECT c_custkey, 1, CASE WHEN n_regionkey < 3 THEN n_name END FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT c_custkey, 2, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"


def chain(spark: SparkSession, d: str) -> DataFrame:
    all_ = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return all_.select("c_custkey", F.posexplode(F.array(F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")), F.when(F.col("n_regionkey") < 3, F.col("n_name")), F.col("r_name"))).alias("depth", "v"))


@query(f"WITH {CHAIN_SQL} SELECT c_custkey, arg_min(v, depth) FILTER (WHERE v IS NOT NULL) AS v FROM chain GROUP BY c_custkey")
def q22_nearest_wins(spark, d):
    return folds.nearest(chain(spark, d), ["c_custkey"], "depth", "v")


@query(f"WITH {CHAIN_SQL} SELECT c_custkey, string_agg(v, ',' ORDER BY depth) AS v FROM chain GROUP BY c_custkey")
def q23_accumulate(spark, d):
    return folds.accumulated(chain(spark, d), ["c_custkey"], "depth", "v")


@query("WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), y AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM x) SELECT l_orderkey, CAST(min(l_linenumber) AS BIGINT) AS start, count(*) AS length FROM y GROUP BY l_orderkey, g")
def q24_merge_ranges(spark, d):
    return matching.runs(t(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("SELECT l_orderkey, arg_max(l_returnflag, row(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END, l_linenumber, l_returnflag)) AS extent FROM lineitem GROUP BY l_orderkey")
def q25_extent_lattice(spark, d):
    priority = F.expr("case l_returnflag when 'R' then 2 when 'A' then 1 else 0 end")
    return folds.loudest(t(spark, d, "lineitem"), ["l_orderkey"], priority.alias("p"), F.struct("l_linenumber", "l_returnflag").alias("o"), "l_returnflag").withColumnRenamed("l_returnflag", "extent")


@query("SELECT c_mktsegment, min(c_custkey) AS first_position, count(*) AS n FROM customer GROUP BY c_mktsegment")
def q26_bundler_groups(spark, d):
    return t(spark, d, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("first_position"), F.count("*").alias("n"))


# --- links of pages -----------------------------------------------------------------------------

HREFS_SQL = "hrefs AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href, unnest(range(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)))) AS pos FROM pages)"
PATH_SQL = "regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)"
KIND_SQL = "CASE WHEN href LIKE '%node_modules%' THEN 5 WHEN href LIKE '.%' OR href LIKE '/%' THEN 1 WHEN href LIKE '#%' THEN 2 WHEN regexp_matches(href, '^[a-z]+:') THEN 4 ELSE 3 END"


def hrefs(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))


def url_path() -> F.Column:
    return F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1)


@query(f"WITH {HREFS_SQL} SELECT href, CAST(min({KIND_SQL}) AS BIGINT) AS kind FROM hrefs GROUP BY href")
def q27_min_kind(spark, d):
    return hrefs(spark, d).groupBy("href").agg(F.min(F.expr(KIND_SQL.replace("regexp_matches(href, '^[a-z]+:')", "href rlike '^[a-z]+:'"))).cast("long").alias("kind"))


@query(f"WITH {HREFS_SQL}, paths AS (SELECT {PATH_SQL} AS p FROM pages) SELECT href, count(DISTINCT page_id) AS n_pages, string_agg(DISTINCT CAST(page_id AS VARCHAR), ',' ORDER BY CAST(page_id AS VARCHAR)) AS pages FROM hrefs WHERE href NOT IN (SELECT p FROM paths) GROUP BY href")
def q28_unresolved_report(spark, d):
    paths = t(spark, d, "pages").select(url_path().alias("href"))
    left = hrefs(spark, d).join(paths, "href", "left_anti")
    return left.groupBy("href").agg(F.countDistinct("page_id").alias("n_pages"), F.array_join(F.sort_array(F.collect_set(F.col("page_id").cast("string"))), ",").alias("pages"))


ACCESS_SQL = "acc AS (SELECT user_id, event_type, CASE WHEN NOT ends_with(json_extract_string(props, '$.k'), '0') THEN json_extract_string(props, '$.k') END AS prop, event_type IN ('purchase', 'signup') AS writes FROM events)"


@query(f"WITH {ACCESS_SQL} SELECT r.user_id, r.event_type AS reader, w.event_type AS writer, count(*) AS pairs FROM acc r JOIN acc w ON r.user_id = w.user_id AND w.writes AND NOT r.writes AND (r.prop IS NULL OR w.prop IS NULL OR r.prop = w.prop) GROUP BY ALL")
def q29_shared_state(spark, d):
    """Readers see writers of the same property, of no certain property, or when they read any.

    Equal accesses are counted before the self join, so that it grows with different ones only."""
    prop = F.get_json_object("props", "$.k")
    acc = t(spark, d, "events").select("user_id", "event_type", F.when(~prop.endswith("0"), prop).alias("prop"), F.col("event_type").isin("purchase", "signup").alias("writes"))
    acc = acc.groupBy("user_id", "event_type", "prop", "writes").agg(F.count("*").alias("n"))
    w = acc.where("writes").select("user_id", F.col("event_type").alias("writer"), F.col("prop").alias("written"), F.col("n").alias("m"))
    r = acc.where("not writes").select("user_id", F.col("event_type").alias("reader"), "prop", "n")
    return r.join(w, "user_id").where("prop is null or written is null or prop = written").groupBy("user_id", "reader", "writer").agg(F.sum(F.col("n") * F.col("m")).alias("pairs"))


@query("SELECT user_id, bool_and(value < 200) AS only_reads, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (WHERE value >= 200) AS writers FROM events GROUP BY user_id")
def q30_read_only_drop(spark, d):
    kinds = F.array_join(F.sort_array(F.collect_set(F.when(F.col("value") >= 200, F.col("event_type")))), ",")
    return t(spark, d, "events").groupBy("user_id").agg(F.bool_and(F.col("value") < 200).alias("only_reads"), F.nullif(kinds, F.lit("")).alias("writers"))


@query(f"WITH p AS (SELECT page_id, string_split({PATH_SQL}, '/') AS parts FROM pages) SELECT page_id, CAST(len(parts) - 1 - n AS BIGINT) AS depth, array_to_string(list_slice(parts, 1, n), '/') AS dir FROM (SELECT page_id, parts, unnest(range(len(parts))) AS n FROM p)")
def q31_chain_ancestors(spark, d):
    return t(spark, d, "pages").select("page_id", F.posexplode(folds.ancestors(url_path())).alias("depth", "dir")).withColumn("depth", long("depth"))


GLOBS = ("en/*", "**/fr/**", "{de,es}/?*", "[0-9]*", "bad[")


@query(f"SELECT page_id, regexp_matches(p, '^en/[^/]*$') AS g0, regexp_matches(p, '^([^/]+/)*fr/.*$') AS g1, regexp_matches(p, '^(de|es)/[^/][^/]*$') AS g2, regexp_matches(p, '^([^/]+/)*[0-9][^/]*$') AS g3, true AS g4 FROM (SELECT page_id, ltrim({PATH_SQL}, '/') AS p FROM pages)")
def q32_glob_match(spark, d):
    """A malformed glob matches: unknown counts as possible."""
    path = F.ltrim(url_path(), F.lit("/"))
    tests = [(F.lit(True) if (rx := T.glob_to_regex(g)) is None else path.rlike(rx)).alias(f"g{i}") for i, g in enumerate(GLOBS)]
    return t(spark, d, "pages").select("page_id", *tests)


@query(f"SELECT page_id, alias, CASE WHEN alias LIKE '%$' THEN p || '$' = alias WHEN alias LIKE '%*' THEN starts_with(p, left(alias, length(alias) - 1)) ELSE p = alias OR starts_with(p, alias || '/') END AS hit FROM (SELECT page_id, {PATH_SQL} AS p FROM pages), (SELECT unnest(['/en', '/fr/8*', '/de/1$', '/es/']) AS alias)")
def q33_alias_match(spark, d):
    pages = t(spark, d, "pages").select("page_id", url_path().alias("p"), F.explode(F.array(*map(F.lit, ("/en", "/fr/8*", "/de/1$", "/es/")))).alias("alias"))
    return pages.select("page_id", "alias", T.alias_matches(F.col("alias"), F.col("p")).alias("hit"))


@query(f"WITH {HREFS_SQL} SELECT page_id, CAST(pos AS BIGINT) AS pos, regexp_extract(ltrim(href, '/'), '^(@[^/]+/[^/]+|[^@./#][^/]*)', 1) AS package, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM hrefs")
def q34_package_of(spark, d):
    return hrefs(spark, d).select("page_id", long("pos").alias("pos"), T.package_name(F.ltrim("href", F.lit("/"))).alias("package"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


@query(r"SELECT doc_id, regexp_matches(text, '@jsx(Frag|ImportSource|Runtime)?(\s|$)') AS pragma, regexp_matches(text, '[#@]__(PURE|NO_SIDE_EFFECTS|INLINE|NOINLINE|KEY)__|@vite-ignore|(webpack|turbopack)[A-Z]') AS annotation, regexp_matches(text, 'License(, [Vv]ersion [0-9.]+)?(\s|$)') AS licensed FROM documents")
def q35_pragma_scan(spark, d):
    text = F.col("text")
    return t(spark, d, "documents").select("doc_id", T.is_pragma(text).alias("pragma"), T.is_annotation(text).alias("annotation"), text.rlike(r"License(, [Vv]ersion [0-9.]+)?(\s|$)").alias("licensed"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def q36_json_key(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(f"WITH {HREFS_SQL}, f AS (SELECT page_id, href, min(pos) AS pos FROM hrefs GROUP BY ALL) SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS nth FROM f")
def q37_import_scan(spark, d):
    seen = t(spark, d, "pages").select("page_id", F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("h"))
    return seen.select("page_id", F.posexplode("h").alias("p", "href")).select("page_id", "href", (long("p") + 1).alias("nth"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS found FROM pages UNION SELECT page_id, unnest(regexp_extract_all(html, '\"(/[^\"<>]*)\"', 1)) FROM pages")
def q38_style_union(spark, d):
    pages = t(spark, d, "pages")
    found = [pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(p), F.lit(1))).alias("found")) for p in ('href="([^"]*)"', '"(/[^"<>]*)"')]
    return found[0].union(found[1]).distinct()


@query("WITH overlay AS (SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN NULL ELSE 'before' END AS status FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT -1 - c_custkey, 'added' FROM customer WHERE c_acctbal < 0) SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM overlay) UNION ALL SELECT o_orderkey, status FROM overlay WHERE status IS NOT NULL")
def q39_overlay_tree(spark, d):
    """A tree and what a change says of it: deleted rows go, changed and added ones win."""
    orders = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = orders.where("o_orderstatus = 'F'").select("o_orderkey", F.expr("if(o_totalprice < 50000, null, 'before')").alias("o_orderstatus"))
    overlay = changed.unionByName(t(spark, d, "customer").where("c_acctbal < 0").select((-1 - F.col("c_custkey")).alias("o_orderkey"), F.lit("added").alias("o_orderstatus")))
    return orders.drop("o_totalprice").join(overlay, "o_orderkey", "left_anti").unionByName(overlay.where("o_orderstatus is not null"))


@query("SELECT event_type, round(median(value), 6) AS median_value, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def q40_median_bench(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median_value"), F.countDistinct("user_id").alias("users"))


@query(f"WITH p AS (SELECT page_id, ltrim({PATH_SQL}, '/') AS p FROM pages), g AS (SELECT * FROM (VALUES ('^en/.*$', true), ('^([^/]+/)*[0-9]+$', true), ('^(fr|de)/[^/]*5$', false)) v(rx, inside)) SELECT page_id, p FROM p WHERE EXISTS (SELECT 1 FROM g WHERE inside AND regexp_matches(p, rx)) AND NOT EXISTS (SELECT 1 FROM g WHERE NOT inside AND regexp_matches(p, rx))")
def q41_outputs_glob(spark, d):
    globs = spark.createDataFrame([("^en/.*$", True), ("^([^/]+/)*[0-9]+$", True), (T.glob_to_regex("{fr,de}/*5"), False)], "rx string, inside boolean")
    paths = t(spark, d, "pages").select("page_id", F.ltrim(url_path(), F.lit("/")).alias("p"))
    hit = F.expr("p rlike rx")
    return paths.join(F.broadcast(globs.where("inside")), hit, "left_semi").join(F.broadcast(globs.where("not inside")), hit, "left_anti")


@query("(SELECT c_custkey FROM customer WHERE c_acctbal < 0 EXCEPT SELECT o_custkey FROM orders) UNION ALL (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def q42_symmetric_diff(spark, d):
    a = t(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")
    b = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return a.subtract(b).unionAll(b.subtract(a))


@query(f"WITH {LINES_SQL}, x AS (SELECT doc_id, bool_and(NOT regexp_matches(line, '[a-z]')) AS blank FROM lines GROUP BY doc_id) SELECT doc_id, blank FROM x")
def q43_types_blank(spark, d):
    return lines(spark, d).groupBy("doc_id").agg(F.bool_and(~F.col("line").rlike("[a-z]")).alias("blank"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'File(' || p_name || ')' WHEN p_size < 20 THEN 'Decl(' || p_name || ', ' || p_brand || ')' WHEN p_size < 30 THEN 'Export(' || p_name || ', ' || p_brand || ')' WHEN p_size < 40 THEN 'Member(' || p_name || ', ' || p_type || '.' || p_brand || ')' ELSE 'ModuleInit(' || p_name || ')' END AS node FROM part")
def q44_display_node(spark, d):
    name, brand = F.col("p_name"), F.col("p_brand")
    node = F.when(F.col("p_size") < 10, F.format_string("File(%s)", name)).when(F.col("p_size") < 20, F.format_string("Decl(%s, %s)", name, brand)).when(F.col("p_size") < 30, F.format_string("Export(%s, %s)", name, brand))
    return t(spark, d, "part").select("p_partkey", node.when(F.col("p_size") < 40, F.format_string("Member(%s, %s.%s)", name, F.col("p_type"), brand)).otherwise(F.format_string("ModuleInit(%s)", name)).alias("node"))
