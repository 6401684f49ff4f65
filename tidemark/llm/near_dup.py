"""MinHash near-duplicates: banding, signature check, exact check, components by stars.

A document's set is its distinct k-word shingles (64-bit hashes; A-Z lower-cased, words between
blanks); fewer words are one shingle, no words are the empty set, which links with nothing.
Documents link at a Jaccard similarity of 0.8 and more, confirmed on whole sets.

1. Exact copies (equal word sequences) fall together first: one node for each different text.
2. ``BANDS`` bands of ``ROWS`` universal-hash minima: a linked pair misses every band with
   probability (1 - 0.8^4)^32 < 5e-8. Nodes that share a bucket get their sets and a signature
   of ``SIGNATURE`` minima more.
3. Buckets are not expanded into pairs. Each member is checked against the bucket's leader:
   sizes, then signatures (five standard deviations of slack), then whole sets. Components of
   the links follow. Members of one bucket that are then in different components are the only
   pairs still open: while there are very many, further rounds with other leaders; at last all
   of them, in blocks of bounded size, so that no link between different texts is lost. Blocks
   compare signatures in memory and only tell the pairs that the whole sets must decide.

Frequent copies, buckets and centres of stars are spread (``join_frequent``). Null ids are one node after all others, rows that repeat an id are one node; null texts are
empty. The component's name is its smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, id_back, known_id, map_slices, table
from tidemark.operators.components import connected_components
from tidemark.operators.skew import join_frequent

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, SIGNATURE = 32, 4, 1024
#: Signatures may agree in so much less than the similarity: five standard deviations at 0.8.
SLACK = 5 * (SIMILARITY * (1 - SIMILARITY) / SIGNATURE) ** 0.5
#: Members of one block of a bucket; star rounds go on while open pairs are over so many a member.
BLOCK, OPEN_PAIRS, STAR_ROUNDS = 512, 2000, 6
_RANDOM = np.random.RandomState(20240601)
FACTORS = (_RANDOM.randint(0, 2**62, BANDS * ROWS + SIGNATURE, dtype=np.uint64) * np.uint64(4) + np.uint64(1))[:, None]
SHIFTS = _RANDOM.randint(0, 2**63 - 1, BANDS * ROWS + SIGNATURE, dtype=np.uint64)[:, None]
#: The first hash functions are for the bands, the others for the signature.
FOR_BANDS, FOR_SIGNATURE = slice(0, BANDS * ROWS), slice(BANDS * ROWS, None)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Products of shingles and hash functions at a time; words whose hashes a task remembers.
CHUNK, REMEMBERED = 1 << 17, 150_000


class Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(words: list[bytes], k: int, known: Words) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), n)], np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    x = h[: n - k + 1].copy()
    for j in range(1, k):
        x = x * MIX + h[j : n - k + 1 + j]
    return np.unique(mixed(x))


def minima(shingles: np.ndarray, functions: slice) -> np.ndarray:
    factors, shifts = FACTORS[functions], SHIFTS[functions]
    best, step = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64), CHUNK // len(factors)
    for at in range(0, len(shingles), step):
        np.minimum(best, (factors * shingles[at : at + step] + shifts).min(axis=1), out=best)
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    x = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for j in range(ROWS):
        x = mixed(x * MIX + best[j::ROWS])
    return x.view(np.int64)


def banded(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc, copy, n, bands) of each row: name of the word sequence, size of the set, band keys."""
    known = Words()

    def work(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc": c["doc"], "copy": [], "n": [], "bands": []}
        for text in c["text"]:
            words = (text or "").encode().lower().split()
            s = shingle_set(words, shingle, known)
            out["copy"].append(xxhash.xxh3_128_digest(b" ".join(words)))
            out["n"].append(len(s))
            out["bands"].append(band_keys(minima(s, FOR_BANDS)) if len(s) else None)
        return out

    return map_slices(docs.select(known_id(id_col).alias("doc"), F.col(text_col).alias("text")), work, "doc long, copy binary, n long, bands array<long>")


def shingle_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, n, shingles, signature) of the documents among ``nodes`` (one column, node); the
    signature has the low byte of each minimum's middle."""
    known = Words()

    def work(c: dict[str, list]) -> dict[str, list]:
        sets = [shingle_set((t or "").encode().lower().split(), shingle, known) for t in c["text"]]
        signs = [(minima(s, FOR_SIGNATURE) >> np.uint64(20)).astype(np.uint8).view(np.int8) for s in sets]
        return {"node": c["node"], "n": [len(s) for s in sets], "shingles": [s.view(np.int64) for s in sets], "signature": signs}

    texts = docs.select(known_id(id_col).alias("node"), F.col(text_col).alias("text"))
    return map_slices(texts.join(nodes.hint("shuffle_hash"), "node", "left_semi"), work, "node long, n long, shingles array<long>, signature array<tinyint>")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those (a, b) whose sizes, signatures and, at last, whole sets are similar enough.

    pairs: (a, b, of), b being in at most ``of`` pairs or few. What a very frequent b brings
    together is dealt out by the hash of a, over copies of b's set.
    """
    percent = round(100 * similarity)
    names = ("n", "shingles", "signature")
    parts = F.ceil(F.col("of") / BLOCK).cast("int")
    left = sets.select(F.col("node").alias("a"), *[F.col(c).alias(f"a_{c}") for c in names])
    copies = pairs.groupBy(F.col("b").alias("node")).agg(F.max(parts).alias("parts"))
    right = sets.join(copies, "node").select(F.col("node").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"b_{c}") for c in names])
    both = pairs.select("a", "b", F.pmod(F.xxhash64("a"), parts).cast("int").alias("part")).join(left, "a").join(right, ["b", "part"])
    both = both.where(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    both = both.where(F.expr(f"aggregate(zip_with(a_signature, b_signature, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x) >= {(similarity - SLACK) * SIGNATURE}"))
    both = both.select("a", "b", F.size(F.array_intersect("a_shingles", "b_shingles")).cast("long").alias("shared"), (F.col("a_n") + F.col("b_n")).alias("sizes"))
    return both.where(100 * F.col("shared") >= percent * (F.col("sizes") - F.col("shared"))).select("a", "b").distinct()


def _block_pairs(g: dict[str, np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of one group, rows in order of their sizes. A pair that an earlier band also brings
    together is left to that band, so that no pair is told twice."""
    n, comp, node, block, sig, bands, band = (g[c] for c in ("n", "component", "node", "block", "signature", "bands", "band"))
    apart = g["i"][0] != g["j"][0]
    ends = np.searchsorted(n, n / similarity + 1e-9, side="right")
    out = []
    for k in range(len(n) - 1):
        rest = slice(k + 1, ends[k])
        may = comp[rest] != comp[k]
        if apart:
            may &= block[rest] != block[k]
        at = np.flatnonzero(may) + k + 1
        if len(at) and band[0]:
            at = at[~(bands[at, : band[0]] == bands[k, : band[0]]).any(axis=1)]
        if len(at):
            at = at[(sig[at] == sig[k]).mean(axis=1) >= similarity - SLACK]
            out += [(max(node[k], node[x]), min(node[k], node[x])) for x in at]
    return out


def _open_pairs(members: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """All pairs of one bucket and different components that sizes and signatures allow.

    members: (bucket, band, node, component, of), ``of`` being the bucket's size. A bucket is cut
    into blocks by the nodes' hashes; each pair of blocks is one group. Groups are dealt out
    and sorted, then read one after the other.
    """
    parts = F.ceil(F.col("of") / BLOCK).cast("int")
    rows = members.join(nodes.join(sets.select("node", "signature"), "node"), "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with")).drop("with", "of")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "n", "node")

    def arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        got = {c: batch.column(c).to_numpy() for c in ("bucket", "band", "node", "component", "n", "block", "i", "j")}
        for c in ("signature", "bands"):
            got[c] = batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1)
        return got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []  # the last group, which may go on

        def told(groups: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
            found = [p for g in groups for p in _block_pairs(g, similarity)]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        def whole() -> dict[str, np.ndarray]:
            return {c: np.concatenate([h[c] for h in held]) for c in held[0]}

        for batch in batches:
            if not batch.num_rows:
                continue
            g = arrays(batch)
            key = np.stack([g["bucket"], g["i"].astype(np.int64), g["j"].astype(np.int64)])
            starts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            pieces = [{c: x[a:b] for c, x in g.items()} for a, b in zip(starts, starts[1:], strict=False)]
            if held and all(held[-1][c][-1] == pieces[0][c][0] for c in ("bucket", "i", "j")):
                held.append(pieces.pop(0))
            if pieces:
                done = [whole()] if held else []
                held = [pieces.pop()]
                yield told([x for x in [*done, *pieces] if len(x["n"]) > 1])
        if held:
            yield told([whole()])

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc, n_shingles, component): one row for each row of ``docs``, ids made known."""
    signed = cut(banded(docs, id_col, text_col, shingle))
    rows = signed.select("doc", "copy", "n")
    classes = cut(rows.where("n > 0").groupBy("copy").agg(F.min("doc").alias("node"), F.count("*").alias("copies")))
    nodes = cut(signed.join(classes.select("copy", F.col("node").alias("doc")), ["copy", "doc"], "left_semi").select(F.col("doc").alias("node"), "n", "bands"))

    spread = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    leaders = spread.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last"), F.count("*").alias("of")).where("leader < last").drop("last")
    in_buckets = BANDS * nodes.count()
    members = cut(join_frequent(spread, leaders, ["bucket"], in_buckets, "of"))
    sets = cut(shingle_sets(docs, members.select("node").distinct(), id_col, text_col, shingle))
    pairs = members.where("node <> leader").groupBy(F.col("node").alias("a"), F.col("leader").alias("b")).agg(F.max("of").alias("of"))
    labels = connected_components(cut(_confirmed(pairs, sets, similarity)), cut)

    members = members.drop("leader")
    for round_ in range(1, STAR_ROUNDS + 2):
        named = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed_buckets = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min(F.struct(F.xxhash64("node", F.lit(round_)).alias("h"), "node", "component")).alias("lead"), F.max("of").alias("n")).where("x < y").select("bucket", "lead", "n")
        open_ = cut(join_frequent(named, mixed_buckets, ["bucket"], in_buckets).drop("n"))
        sizes = open_.groupBy("bucket", "component").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
        pairs_left, rows_left = sizes.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), F.sum("s")).first()
        if not pairs_left:
            break
        last = pairs_left <= OPEN_PAIRS * rows_left or round_ > STAR_ROUNDS
        if last:
            new = cut(_open_pairs(open_.drop("lead"), nodes, sets, similarity).withColumn("of", F.lit(1)))
        else:
            new = open_.where("component <> lead.component").groupBy(F.col("node").alias("a"), F.col("lead.node").alias("b")).agg(F.max("of").alias("of"))
        found = cut(_confirmed(new, sets, similarity))
        if not found.isEmpty():
            # the components so far are stars already: their edges stand for all links behind them
            labels = connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found), cut)
        if last:
            break
        members = open_.drop("component", "lead")

    named = cut(classes.join(labels, "node", "left").select("copy", "copies", F.coalesce("component", "node").alias("component")))
    found = join_frequent(rows.where("n > 0"), named, ["copy"], rows.count(), "copies")
    return found.select("doc", "n", "component").unionByName(rows.where("n = 0").select("doc", "n", F.col("doc").alias("component"))).select("doc", F.col("n").alias("n_shingles"), "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    found = near_components(docs, id_col, text_col, shingle, similarity)
    return found.select(id_back(F.col("doc")).alias("doc_id"), "n_shingles", id_back(F.col("component")).alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 parts AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s
           FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)),
 sizes AS (SELECT doc_id, count(*) AS n FROM parts GROUP BY doc_id),
 shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM parts x JOIN parts y ON x.s = y.s AND x.doc_id > y.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
 ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach(node, other) AS (SELECT a, a FROM ways UNION SELECT r.node, w.b FROM reach r JOIN ways w ON w.a = r.other),
 least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON node = d.doc_id
"""
