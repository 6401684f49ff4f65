"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws the key -ln(u)/w, u a hash of its id and w its quality weight; ascending
keys are a weighted sample without replacement. Within a source documents are sorted by key and
prefix-summed to the source's token budget. Whole epochs come first: a source whose target is
``e`` times its size and something gives every document ``e`` times, and only the rest of the
budget is chosen by keys; the document at the edge gives the words that still fit.

No source is ever sorted as a whole. Keys fall into buckets (the binary logarithm of the key,
``BUCKETS`` to the octave); sizes are summed by bucket with map-side partial sums, the bucket
at the edge is found among the sums, and only that bucket's rows are sorted.

Nulls: a null text has size 0, a null source is a source of its own and comes last, a row
of a null id draws by its text. Rows that repeat draw the same key and are taken one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import add_columns, cut, table

#: Key buckets to the octave; one bucket holds at most about a 1/1,000 of a source's rows,
#: and a source has some 10,000 sums of buckets at most, however many documents.
BUCKETS = 512
#: Targets are broadcast for up to so many sources; beyond, rows and targets are dealt out.
BROADCAST_SOURCES = 10_000
#: Source weights, repeating in code-point order of the sources; the share of all sizes; the cap.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target).

    Targets share ``share`` of all sizes by weight and stop at ``cap`` times the source's size;
    what is over goes to the others by weight until none is above. That fixed point is found in
    one go: in the order of cap/weight, the capped sources are a prefix.
    """
    everything = Window.partitionBy()
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
    before = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("capped", F.col("most") / F.col("weight") <= left)
    of_capped = F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0.0)).over(everything)
    free = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0.0)).over(everything)
    target = F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * (F.col("budget") - of_capped) / free)
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def draw_name(doc_id: Column, text: Column) -> Column:
    """What a row draws by: its id; without one its text, so that such rows do not all draw alike."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))


def draw_key(name: Column, weight: Column, seed: str = "") -> Column:
    """-ln(u)/w with u in (0, 1) from 48 bits of a hash of the name; the same on every run."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), name)), 1, 12), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(2**48))) / weight


def mix(sized: DataFrame, targets: DataFrame, seed: str = "", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, name, source, size, quality) and targets to the words taken of each row.

    Rows draw by ``name``; ``quality`` > 0 is the sampling weight. Whole result: one row for each row of ``sized``.
    """
    keyed = sized.withColumn("draw", draw_key(F.col("name"), F.col("quality"), seed))
    keyed = keyed.withColumn("bucket", F.floor(F.log2(F.col("draw")) * buckets))
    goal = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    goal = goal.select(F.col("source").alias("goal_source"), "source_size", "target", "epochs", "rest")
    same = F.col("source").eqNullSafe(F.col("goal_source"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    so_far = Window.partitionBy("source").orderBy("bucket")
    edge = sums.withColumn("upto", F.sum("words").over(so_far)).join(goal, same).where("upto - words < rest and rest <= upto")
    edge = edge.groupBy(F.col("source").alias("edge_source")).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("edge"))
    goal = cut(goal.join(edge, F.col("goal_source").eqNullSafe(F.col("edge_source")), "left").drop("edge_source"))
    # one row a source: with few sources no document needs to be dealt out by its source
    rows = keyed.join(F.broadcast(goal) if goal.count() <= BROADCAST_SOURCES else goal, same).drop("goal_source")
    inner = rows.where("bucket = edge.bucket")
    before = Window.partitionBy("source").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inner = inner.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("edge.before") - F.coalesce(F.sum("size").over(before), F.lit(0)))))
    outer = rows.where("edge is null or bucket <> edge.bucket").withColumn("part", F.when(F.col("bucket") < F.col("edge.bucket"), F.col("size")).otherwise(0))
    return outer.unionByName(inner).withColumn("taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long"))


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """With the words of each text and its quality weight, (distinct words + 1) / (words + 1)."""

    def work(texts: list) -> dict[str, list]:
        words = [(t or "").encode().split() for t in texts]
        return {"size": [len(w) for w in words], "quality": [(len(set(w)) + 1) / (len(w) + 1) for w in words]}

    return add_columns(docs, text_col, work, "size long, quality double")


def _mixed(weighed: DataFrame, seed: str) -> DataFrame:
    targets = source_targets(weighed.groupBy("source").agg(F.sum("size").alias("source_size")))
    return mix(weighed, cut(targets), seed)


def mix_documents(docs: DataFrame, seed: str = "") -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken) of documents(doc_id, source, text)."""
    weighed = sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), draw_name(F.col("doc_id"), F.col("text")).alias("name"), "source", "text")).drop("text")
    return _mixed(cut(weighed), seed).select("doc_id", "source", "size", "source_size", "target", "epochs", "taken")


MADE = ("size", "source_size", "target", "epochs", "taken")


def mixture(docs: DataFrame, seed: str = "") -> DataFrame:
    """The documents that the mix takes words of, with their columns and ``MADE``.

    A column of the documents that has one of these names becomes ``documents_<name>``. Only
    rows of the buckets at the edge are dealt out with their texts.
    """
    row = F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row")
    weighed = sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), draw_name(F.col("doc_id"), F.col("text")).alias("name"), "source", "text", row)).drop("text")
    own = [F.col(f"row.`{n}`").alias(f"documents_{n}" if n in MADE else n) for n in docs.columns]
    return _mixed(cut(weighed), seed).where("taken > 0").select(*own, *MADE)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, name, source, CAST(len(w) AS BIGINT) AS size, (len(list_distinct(w)) + 1)::DOUBLE / (len(w) + 1) AS quality
  FROM (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, ''))) AS name, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)),
 src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
         FROM sized GROUP BY source),
 a AS (SELECT *, 2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM src),
 b AS (SELECT *, most / weight <= (budget - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS capped
       FROM a WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT source, source_size, CASE WHEN capped THEN most ELSE weight * (budget - sum(CASE WHEN capped THEN most ELSE 0 END) OVER ())
              / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target FROM b),
 g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
 k AS (SELECT s.doc_id, s.size, g.source_size, g.target, g.epochs, CAST(floor(g.target - g.epochs * g.source_size) AS BIGINT) AS rest, s.source,
              -ln((CAST('0x' || substr(md5(s.name), 1, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE) / s.quality AS draw
       FROM sized s JOIN g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM k
"""
