"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search.

Texts become lower-case words (runs of letters and digits); shingles are five words. The weight
of a shingle is 1 over the number of benchmark items that hold it, and a window is like an item
if the item's shingles that it holds, counted as often as both hold them, have at least
``MIN_SIMILARITY`` of the item's weight.

1. Windows: a window as long as some item starts at a shingle that items of that length have
   (another start only loses), and the shares of all such shingles in it, each the largest that
   any of those items gives it, must come to ``MIN_SIMILARITY``: what has less is like none of
   them. No window that can count is lost.
2. Each different window gets a 128-bit SimHash of its weighted shingles. Fingerprints are cut
   into ``BLOCKS`` blocks of 16 bits; an item is filed under every value within ``PROBE`` bits
   of each of its blocks. Fingerprints that differ in at most ``RADIUS`` bits differ in at most
   ``PROBE`` of one block at least, so the window, which asks with its own blocks, meets all
   items of its length within the radius; an unlike pair meets by chance with probability 0.017.
3. At a similarity of just 0.8 some fingerprints differ in more than ``RADIUS`` bits. So that none
   of these is lost, a window also meets the items of its length that it holds an anchor of:
   of each item the heaviest shingles, as many as leave less than 0.8 of the weight.
4. All these pairs are verified exactly on the weighted shingles.

Windows of equal content are fingerprinted and verified once, however many documents share
them. All of it is SQL functions: no Python runs on executors. Only shingles that items have
leave a document's row. The benchmark's shingles are broadcast if they are few; otherwise they
are copied to parts among which documents' shingles are dealt out.

An item of fewer than five words is one shingle and only matches documents that consist of it.
Null texts and items without words match nothing; a null document id is kept.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, id_back, known_id, table
from tidemark.operators.skew import join_frequent

SHINGLE, MIN_SIMILARITY = 5, 0.8
#: Blocks of 16 bits; bits of a block that a probe may differ in; the distance that they guarantee.
BLOCKS, PROBE = 8, 2
RADIUS = BLOCKS * (PROBE + 1) - 1
#: The benchmark's shingles are broadcast up to so many rows (some 40 bytes each); parts beyond.
BROADCAST_SHINGLES, PARTS = 500_000, 32
NOT_WORD = r"[^\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), ""), lambda w: F.xxhash64(w))


def _shingles(hashes: str, k: int) -> Column:
    """Hashes of k words each; of all words, if there are fewer."""
    parts = ", ".join(f"{hashes}[i + {j}]" for j in range(k))
    return F.expr(f"CASE WHEN size({hashes}) >= {k} THEN transform(sequence(0, size({hashes}) - {k}), i -> xxhash64({parts})) WHEN size({hashes}) > 0 THEN array(xxhash64({hashes}, size({hashes}))) ELSE cast(array() AS array<bigint>) END")


def simhash(held: str) -> tuple[Column, Column]:
    """128 bits of an array of (shingle, weight): bit by bit, whether those that have it weigh more."""
    bit = "aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft(if(aggregate({0}, 0D, (s, x) -> s + if(getbit(x.h, b) = 1, x.weight, -x.weight)) > 0, 1L, 0L), b))"
    hashed = "transform({0}, x -> struct({1} AS h, x.weight AS weight))"
    return F.expr(bit.format(hashed.format(held, "x.shingle"))), F.expr(bit.format(hashed.format(held, "xxhash64(x.shingle, 7)")))


def blocks(low: str, high: str) -> Column:
    """(block, value) of each 16 bits of a fingerprint."""
    half = BLOCKS // 2
    return F.array(*[F.struct(F.lit(i).alias("block"), F.expr(f"cast(shiftrightunsigned({high if i >= half else low}, {16 * (i % half)}) & 65535L AS int)").alias("value")) for i in range(BLOCKS)])


def probes(block: str = "b") -> Column:
    """(block, value) of all values within ``PROBE`` bits of a block's."""
    masks = [sum(1 << x for x in bits) for n in range(PROBE + 1) for bits in combinations(range(16), n)]
    return F.transform(F.array(*map(F.lit, masks)), lambda m: F.struct(F.col(block)["block"].alias("block"), F.col(block)["value"].bitwiseXOR(m).alias("value")))


def _items(benchmark: DataFrame, item_col: str, shingle: int) -> DataFrame:
    """(item, item_id, length, at, shingle, weight, whole): one row for each place of each item."""
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), word_hashes(F.col("text")).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("length", F.size("words")).withColumn("shingles", _shingles("words", shingle))
    parts = cut(items.select("item", "item_id", "length", F.posexplode("shingles").alias("at", "shingle")))
    weights = parts.groupBy("shingle").agg((1 / F.countDistinct("item")).alias("weight"))
    return cut(parts.join(weights, "shingle").withColumn("whole", F.sum("weight").over(Window.partitionBy("item"))))


def _anchors(parts: DataFrame, min_similarity: float) -> DataFrame:
    """(shingle, length, item): of each item the heaviest shingles, so many that the others weigh
    less than a window needs."""
    before = Window.partitionBy("item").orderBy(F.desc("weight"), "shingle", "at").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("whole") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # the rest, with this one, still has at least the share that a window needs: so this one is an anchor
    return parts.withColumn("rest", rest).where(F.col("rest") >= min_similarity * F.col("whole") - 1e-9).select("shingle", "length", "item").distinct()


def _hits(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(row, doc, length, place, shingle, share, weight): documents' shingles that items of a length have."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), known_id(id_col).alias("doc"), word_hashes(F.col(text_col)).alias("words")).withColumn("shingles", _shingles("words", shingle))
    # the outer form: for the inner one the optimizer adds a filter that computes the shingles anew
    places = texts.select("row", "doc", F.posexplode_outer("shingles").alias("place", "shingle"))
    if known.count() <= BROADCAST_SHINGLES:
        return places.join(F.broadcast(known), "shingle")
    part = F.pmod(F.xxhash64("row", "place"), F.lit(PARTS))
    copies = known.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return places.withColumn("part", part).join(copies, ["shingle", "part"]).drop("part")


def _windows(hits: DataFrame, shingle: int, min_similarity: float) -> DataFrame:
    """(row, doc, length, start, held): item-sized windows that may be like an item, with the
    shingles in them that items of that length have, in order."""
    inside = Window.partitionBy("row", "length")
    upto = inside.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    span = F.greatest(F.col("length") - shingle + 1, F.lit(1))
    own = hits.withColumn("before", F.sum("share").over(upto) - F.col("share")).withColumn("nth", F.count("*").over(upto))
    # each hit comes twice: where it stands, and where the window that starts there ends
    begin = F.struct(F.col("place").alias("at"), F.lit(0).alias("ends"), F.col("share").alias("adds"), F.lit(1).alias("one"))
    end = F.struct((F.col("place") + span - 1).alias("at"), F.lit(1).alias("ends"), F.lit(0.0).alias("adds"), F.lit(0).alias("one"))
    events = own.select("row", "doc", "length", "place", "before", "nth", F.explode(F.array(begin, end)).alias("e")).select("row", "doc", "length", "place", "before", "nth", "e.*")
    so_far = inside.orderBy("at", "ends", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = events.withColumn("sum", F.sum("adds").over(so_far)).withColumn("last", F.sum("one").over(so_far))
    good = events.where((F.col("ends") == 1) & (F.col("sum") - F.col("before") >= min_similarity - 1e-6)).select("row", "doc", "length", F.col("place").alias("start"), "nth", (F.col("last") - F.col("nth") + 1).alias("n"))
    good = cut(good)
    rows = hits.join(good.select("row", "length").distinct(), ["row", "length"], "left_semi").groupBy("row", "length").agg(F.array_sort(F.collect_list(F.struct("place", "shingle", "weight"))).alias("all"))
    held = F.expr("transform(slice(all, cast(nth AS int), cast(n AS int)), x -> struct(x.shingle AS shingle, x.weight AS weight))")
    return good.join(rows, ["row", "length"]).select("row", "doc", "length", "start", held.alias("held"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", shingle: int = SHINGLE, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, hamming, window_start, n_windows) of every document and item
    that the document has a window like; the best window's figures, the first of the best."""
    parts = _items(benchmark, item_col, shingle)
    anchors = _anchors(parts, min_similarity)
    known = cut(parts.groupBy("shingle", "length").agg(F.max(F.col("weight") / F.col("whole")).alias("share"), F.first("weight").alias("weight")))
    hits = cut(_hits(docs, known, id_col, text_col, shingle))
    windows = _windows(hits, shingle, min_similarity)
    windows = cut(windows.withColumn("k1", F.xxhash64("length", "held.shingle")).withColumn("k2", F.xxhash64(F.lit(1), "held.shingle", "length")))

    low, high = simhash("held")
    alike = windows.groupBy("length", "k1", "k2").agg(F.first("held").alias("held"), F.count("*").alias("n"))
    alike = cut(alike.withColumn("low", low).withColumn("high", high))
    of_item = parts.groupBy("item", "length").agg(F.array_sort(F.collect_list(F.struct("at", "shingle", "weight"))).alias("held"))
    prints = cut(of_item.select("item", "length", low.alias("item_low"), high.alias("item_high")))
    hamming = F.expr("bit_count(low ^ item_low) + bit_count(high ^ item_high)").alias("hamming")
    asked = alike.select("length", "k1", "k2", "low", "high", F.explode(blocks("low", "high")).alias("b")).select("length", "k1", "k2", "low", "high", "b.*")
    filed = prints.select("item", "length", "item_low", "item_high", F.explode(blocks("item_low", "item_high")).alias("b"))
    filed = filed.select("item", "length", "item_low", "item_high", F.explode(probes()).alias("p")).select("item", "length", "item_low", "item_high", "p.*")
    near = asked.join(filed, ["length", "block", "value"]).where(hamming <= RADIUS).select("k1", "k2", "item", hamming)
    # the same shingle at several places of a window is one reason to meet
    holds = alike.select("length", "k1", "k2", "low", "high", F.explode(F.array_distinct("held.shingle")).alias("shingle"))
    sharing = holds.join(anchors, ["shingle", "length"]).join(prints.drop("length"), "item")
    pairs = near.unionByName(sharing.select("k1", "k2", "item", hamming)).distinct()

    told = parts.groupBy("item", "shingle").agg(F.count("*").alias("times"), F.first("weight").alias("weight"), F.first("whole").alias("whole"), F.first("item_id").alias("item_id"))
    here = alike.select("k1", "k2", F.explode("held.shingle").alias("shingle")).groupBy("k1", "k2", "shingle").agg(F.count("*").alias("here"))
    shared = pairs.join(here, ["k1", "k2"]).join(told, ["item", "shingle"]).groupBy("k1", "k2", "item").agg(F.first("hamming").alias("hamming"), F.first("item_id").alias("item_id"), F.round(F.sum(F.least("here", "times") * F.col("weight")) / F.first("whole"), 9).alias("similarity"))
    like = F.collect_list(F.struct("item", "item_id", "similarity", "hamming")).alias("items")
    verified = cut(shared.where(F.col("similarity") >= min_similarity).groupBy("k1", "k2").agg(like).join(alike.select("k1", "k2", "n"), ["k1", "k2"]))

    found = join_frequent(windows.select("doc", "k1", "k2", "start"), verified, ["k1", "k2"], windows.count()).select("doc", "start", F.explode("items").alias("x")).select("doc", "start", "x.*")
    best = F.min(F.struct((-F.col("similarity")).alias("less"), "hamming", "start")).alias("best")
    out = found.groupBy("doc", "item", "item_id").agg(best, F.count("*").alias("n_windows"))
    return out.select(id_back(F.col("doc")).alias("doc_id"), F.col("item_id"), (-F.col("best.less")).alias("similarity"), F.col("best.hamming").cast("long").alias("hamming"), F.col("best.start").cast("long").alias("window_start"), "n_windows")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
