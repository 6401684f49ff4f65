"""Reversible line deduplication: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line stripped of blanks with A-Z lower-cased; keys of fewer than
``min_key`` code points are never touched. A key that at least two documents hold stays in the
smallest of them and loses its lines everywhere else.

* ``LineIndex`` holds, for a corpus, the exact table (key, refs, first document), the holders
  behind it and one cuckoo filter for each shard of keys. ``insert`` and ``delete`` take
  documents; a deleted document's references are counted down exactly, a key whose count falls
  under two leaves the filter, and lines that only it had suppressed come back.
* ``decide`` rewrites documents. Every line probes the filter of its shard first; what passes
  meets the exact table, so that a filter's false positives change nothing. While all filters
  together are small they are broadcast and lines that are certainly not repeated never travel;
  beyond, lines travel to their shard's filter, ``DEALS`` copies of which share a shard's
  lines, and are probed as they stream by: a task holds one filter at a time.

Keys that very many documents hold are broadcast with their first documents, the others are
joined. Null ids: a null text is one empty line, a null id is one document after all others. Rows
that repeat an id belong to one document; what they lose is found row by row, by id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, NULL_ID, cut, known_id, map_slices, table
from tidemark.operators.skew import join_frequent

MIN_KEY = 10
#: Keys of one shard's filter, about; a shard is one task's work.
SHARD_KEYS = 200_000
#: Filters are broadcast up to this many bytes in all; beyond, lines are dealt out to their shards.
BROADCAST_BYTES = 32 << 20
#: Copies of each shard's filter among which the shard's lines are dealt out.
DEALS = 8


class CuckooFilter:
    """Four 16-bit fingerprints a bucket, partial-key cuckoo hashing, insertion and deletion.

    A key is 16 bytes of a good hash. What finds no place after ``KICKS`` moves goes to an
    exact overflow set, so that insertion never fails and no key is ever denied.
    """

    KICKS = 200

    def __init__(self, capacity: int, table: bytes | None = None, overflow: list[bytes] | None = None):
        need = max(1, int(capacity / (4 * 0.85)))
        self.buckets = 1 << max(0, (need - 1).bit_length())
        self.slots = np.zeros((self.buckets, 4), np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(-1, 4).copy()
        self.buckets = len(self.slots)
        self.overflow = set(overflow or ())

    def _place(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:8], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & 0xFFFFFFFF) & (self.buckets - 1)

    def __contains__(self, key: bytes) -> bool:
        mark, a, b = self._place(key)
        return mark in self.slots[a] or mark in self.slots[b] or key in self.overflow

    def insert(self, key: bytes) -> None:
        mark, a, b = self._place(key)
        for bucket in (a, b):
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = mark
                return
        moved, path = a, []
        for turn in range(self.KICKS):
            slot = turn % 4
            path.append((moved, slot, self.slots[moved, slot]))
            mark, self.slots[moved, slot] = int(self.slots[moved, slot]), mark
            moved = self._other(moved, mark)
            free = np.flatnonzero(self.slots[moved] == 0)
            if len(free):
                self.slots[moved, free[0]] = mark
                return
        for bucket, slot, was in reversed(path):
            self.slots[bucket, slot] = was
        self.overflow.add(key)

    def delete(self, key: bytes) -> bool:
        """Only for keys that were inserted."""
        if key in self.overflow:
            self.overflow.remove(key)
            return True
        mark, a, b = self._place(key)
        for bucket in (a, b):
            at = np.flatnonzero(self.slots[bucket] == mark)
            if len(at):
                self.slots[bucket, at[0]] = 0
                return True
        return False

    def contains_many(self, keys: np.ndarray) -> np.ndarray:
        """keys: (n, 16) bytes."""
        marks = keys[:, :2].copy().view("<u2").ravel()
        marks[marks == 0] = 1
        padded = np.zeros((len(keys), 8), np.uint8)
        padded[:, :6] = keys[:, 2:8]
        first = padded.view("<u8").ravel() & np.uint64(self.buckets - 1)
        other = first ^ ((marks.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(0xFFFFFFFF)) & np.uint64(self.buckets - 1)
        found = (self.slots[first] == marks[:, None]).any(1) | (self.slots[other] == marks[:, None]).any(1)
        if self.overflow:
            found |= np.fromiter((k.tobytes() in self.overflow for k in keys), bool, len(keys))
        return found


def line_key(line: bytes, min_key: int) -> bytes | None:
    """The 128-bit name of a stripped, lower-cased line; None if it is too short to count."""
    if len(line) < min_key or len(line) < 4 * min_key and len(line.decode()) < min_key:
        return None
    return xxhash.xxh3_128_digest(line)


def keys_of(text: str | None, min_key: int) -> list[bytes | None]:
    return [line_key(x.strip(BLANKS), min_key) for x in (text or "").encode().lower().split(b"\n")]


def holders(docs: DataFrame, id_col: str, text_col: str, min_key: int) -> DataFrame:
    """One row for each key and row that holds it."""

    def work(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"line_key": [], "doc": []}
        for doc, text in zip(c["doc"], c["text"], strict=True):
            keys = set(keys_of(text, min_key))
            keys.discard(None)
            out["line_key"] += keys
            out["doc"] += [doc] * len(keys)
        return out

    return map_slices(docs.select(known_id(id_col).alias("doc"), F.col(text_col).alias("text")), work, "line_key binary, doc long")


class LineIndex:
    """The state of incremental line dedup; every table is a DataFrame in the shared folder.

    ``counts``: (line_key, refs, first_doc) of every key, refs being the number of documents;
    ``held``: (line_key, doc); ``filters``: (shard, slots, overflow) over keys of two documents
    and more.
    """

    def __init__(self, held: DataFrame, counts: DataFrame, filters: DataFrame, shards: int, min_key: int):
        self.held, self.counts, self.filters, self.shards, self.min_key = held, counts, filters, shards, min_key

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY, shard_keys: int = SHARD_KEYS, keep_held: bool = True) -> LineIndex:
        """keep_held=False leaves out what only insert() and delete() need."""
        held = holders(docs, id_col, text_col, min_key)
        if keep_held:
            held = cut(held.distinct())
            counts = cut(_counted(held))
        else:
            # only keys of two documents matter here: min < max says it without a distinct count
            counts = cut(held.groupBy("line_key").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), F.count("*").alias("refs")).where("first_doc < last_doc").select("line_key", "refs", "first_doc"))
        shards = max(1, -(-counts.where("refs > 1").count() // shard_keys))
        return cls(held, counts, cut(_filters(counts, shards, shard_keys)), shards, min_key)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        new = holders(docs, id_col, text_col, self.min_key).distinct().join(self.held, ["line_key", "doc"], "left_anti")
        return self._with(cut(self.held.unionByName(new)), new)

    def delete(self, doc_ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        gone = doc_ids.select(known_id(id_col).alias("doc")).distinct()
        kept = cut(self.held.join(gone, "doc", "left_anti").select("line_key", "doc"))
        return self._with(kept, self.held.join(gone, "doc", "left_semi").select("line_key", "doc"))

    def _with(self, held: DataFrame, touched: DataFrame) -> LineIndex:
        """Count the touched keys anew; each shard's filter takes in and lets go what crossed two."""
        keys = touched.select("line_key").distinct()
        now = _counted(held.join(keys, "line_key", "left_semi"))
        counts = cut(self.counts.join(keys, "line_key", "left_anti").unionByName(now))
        was = self.counts.where("refs > 1").select("line_key", F.lit(1).alias("was"))
        change = now.where("refs > 1").select("line_key", F.lit(1).alias("is")).join(keys, "line_key", "right").join(was, "line_key", "left").where("(is is null) <> (was is null)")
        shards = self.shards
        change = change.select(_shard_of(shards).alias("shard"), "line_key", F.col("is").isNotNull().alias("added"))

        def apply(key, left, right):
            old = left.iloc[0] if len(left) else None
            f = CuckooFilter(2 * len(right) + 64) if old is None else CuckooFilter(0, bytes(old["slots"]), [bytes(x) for x in old["overflow"]])
            for k, added in zip(right["line_key"], right["added"], strict=True):
                f.insert(bytes(k)) if added else f.delete(bytes(k))
            return pd.DataFrame({"shard": [key[0]], "slots": [f.slots.tobytes()], "overflow": [sorted(f.overflow)]})

        filters = self.filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(apply, self.filters.schema)
        return LineIndex(held, counts, cut(filters), shards, self.min_key)

    def probe(self) -> dict[int, tuple[bytes, list[bytes]]] | None:
        """The filters, if all of them together are small enough to broadcast."""
        total = self.filters.agg(F.sum(F.octet_length("slots") + 16 * F.size("overflow"))).first()[0] or 0
        if total > BROADCAST_BYTES:
            return None
        return {r["shard"]: (bytes(r["slots"]), [bytes(x) for x in r["overflow"]]) for r in self.filters.collect()}

    def probed(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(doc, words, line_key): the different lines of each row that their shards' filters know."""
        shards, min_key, small = self.shards, self.min_key, self.probe()
        texts = docs.select(known_id(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("words"), F.col(text_col).alias("text"))

        def lines(c: dict[str, list]) -> tuple[list, np.ndarray, np.ndarray]:
            rows = [(doc, w, k) for doc, w, text in zip(c["doc"], c["words"], c["text"], strict=True) for k in set(keys_of(text, min_key)) if k]
            keys = np.frombuffer(b"".join(k for _, _, k in rows), np.uint8).reshape(-1, 16)
            return rows, keys, keys[:, 8:12].copy().view("<u4").ravel() % np.uint32(shards)

        if small is None:
            return self._probed_in_shards(map_slices(texts, lambda c: _with_shards(*lines(c)), "doc long, words long, line_key binary, shard int"))
        sent = docs.sparkSession.sparkContext.broadcast(small)
        ready: dict[int, CuckooFilter] = {}

        def work(c: dict[str, list]) -> dict[str, list]:
            if not ready:
                ready.update({s: CuckooFilter(0, *x) for s, x in sent.value.items()})
            rows, keys, shard = lines(c)
            passed = np.zeros(len(rows), bool)
            for s, f in ready.items():
                mine = shard == s
                passed[mine] = f.contains_many(keys[mine])
            rows = [r for r, ok in zip(rows, passed, strict=True) if ok]
            return {"doc": [r[0] for r in rows], "words": [r[1] for r in rows], "line_key": [r[2] for r in rows]}

        return map_slices(texts, work, "doc long, words long, line_key binary")

    def _probed_in_shards(self, lines: DataFrame) -> DataFrame:
        """Lines and copies of the filters meet by (shard, deal); the filter comes first."""
        own = lines.withColumn("deal", F.pmod(F.xxhash64("doc", "words"), F.lit(DEALS)).cast("int")).select("shard", "deal", F.lit(1).alias("kind"), "doc", "words", "line_key", F.lit(None).cast("binary").alias("slots"), F.lit(None).cast("array<binary>").alias("overflow"))
        copies = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("words"), F.lit(None).cast("binary").alias("line_key"), "slots", "overflow")
        dealt = own.unionByName(copies).repartition("shard", "deal").sortWithinPartitions("shard", "deal", "kind")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, known = None, None
            for batch in batches:
                kind, where = batch.column("kind").to_numpy(), np.stack([batch.column(n).to_numpy() for n in ("shard", "deal")], axis=1)
                cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1), batch.num_rows]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    if at != tuple(where[a]):
                        at, known = tuple(where[a]), None
                    if kind[a] == 0:
                        known = CuckooFilter(0, batch.column("slots")[a].as_py(), batch.column("overflow")[a].as_py())
                        a += 1
                    part = batch.slice(a, b - a).select(["doc", "words", "line_key"])
                    if known is not None and part.num_rows:
                        keys = np.frombuffer(b"".join(part.column("line_key").to_pylist()), np.uint8).reshape(-1, 16)
                        yield part.filter(pa.array(known.contains_many(keys)))

        return dealt.mapInArrow(run, "doc long, words long, line_key binary")

    def dropped(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc, words, dropped keys) of the rows that lose lines; ``words`` is a hash of the text.
        Rows of one document whose texts hash alike would lose the same keys anyway."""
        repeated = self.counts.where("refs > 1").select("line_key", "first_doc", "refs")
        total = repeated.agg(F.sum("refs")).first()[0] or 0
        met = join_frequent(self.probed(docs, id_col, text_col), repeated, ["line_key"], total, "refs")
        return met.where("doc <> first_doc").groupBy("doc", "words").agg(F.collect_set("line_key").alias("drop_keys"))

    def decide(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc, text, drop_keys): each row of the documents with the keys that it loses.

        The small side is built in memory for each partition, so that texts are dealt out once
        and never sorted. Rows are dealt out by id and text: null ids are no single task's.
        """
        lost = self.dropped(docs, id_col, text_col)
        lost = lost.select(F.col("doc").alias("__tidemark_doc"), F.col("words").alias("__tidemark_words"), F.col("drop_keys").alias("__tidemark_drop")).hint("shuffle_hash")
        named = docs.withColumn("__tidemark_doc", known_id(id_col)).withColumn("__tidemark_words", F.xxhash64(F.col(text_col)))
        return named.join(lost, ["__tidemark_doc", "__tidemark_words"], "left")


def _with_shards(rows: list, keys: np.ndarray, shard: np.ndarray) -> dict[str, list]:
    return {"doc": [r[0] for r in rows], "words": [r[1] for r in rows], "line_key": [r[2] for r in rows], "shard": shard.astype(np.int32)}


def _shard_of(shards: int):
    """The shard of a key: its bytes 8 to 11, little end first."""
    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: int.from_bytes(k[8:12], "little") % shards).astype("int32")

    return shard(F.col("line_key"))


def _counted(held: DataFrame) -> DataFrame:
    return held.groupBy("line_key").agg(F.count("*").alias("refs"), F.min("doc").alias("first_doc"))


def _filters(counts: DataFrame, shards: int, shard_keys: int) -> DataFrame:
    def build(key, rows):
        f = CuckooFilter(2 * len(rows) + 64)  # room for as many again
        for k in rows["line_key"]:
            f.insert(bytes(k))
        return pd.DataFrame({"shard": [key[0]], "slots": [f.slots.tobytes()], "overflow": [sorted(f.overflow)]})

    keys = counts.where("refs > 1").select(_shard_of(shards).alias("shard"), "line_key")
    return keys.groupBy("shard").applyInPandas(build, "shard int, slots binary, overflow array<binary>")


def kept_lines(text: str | None, drop: set[bytes], min_key: int) -> tuple[int, int, str]:
    """Lines before, lines dropped, the text that stays."""
    text = text or ""
    lines = text.split("\n")
    if not drop:
        return len(lines), 0, text
    kept = [x for x, k in zip(lines, keys_of(text, min_key), strict=True) if k not in drop]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """The documents, all columns, with repeated lines gone from their texts."""
    index = LineIndex.build(docs, id_col, text_col, min_key, keep_held=False)
    joined = index.decide(docs, id_col, text_col)

    def work(c: dict[str, list]) -> dict[str, list]:
        c[text_col] = [t if not d else kept_lines(t, set(d), min_key)[2] for t, d in zip(c[text_col], c["__tidemark_drop"], strict=True)]
        return c

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_slices(joined.select(*[F.col(f"`{n}`") for n in docs.columns], "__tidemark_drop"), work, schema)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = LineIndex.build(docs, keep_held=False)

    def work(c: dict[str, list]) -> dict[str, list]:
        done = [kept_lines(t, set(d or ()), MIN_KEY) for t, d in zip(c["text"], c["__tidemark_drop"], strict=True)]
        return {"doc_id": [None if d == NULL_ID else d for d in c["__tidemark_doc"]], "n_lines": [x[0] for x in done], "n_dropped": [x[1] for x in done], "kept_sha256": [hashlib.sha256(x[2].encode()).hexdigest() for x in done]}

    return map_slices(index.decide(docs).select("__tidemark_doc", "text", "__tidemark_drop"), work, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\n')) AS line,
               unnest(range(len(string_split(coalesce(text, ''), E'\n')))) AS i FROM documents)),
 held AS (SELECT k, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS refs FROM lines WHERE length(k) >= 10 GROUP BY k),
 judged AS (SELECT l.doc_id, l.i, l.line, (h.refs >= 2 AND h.first_doc <> l.doc_id) IS TRUE AS gone
            FROM lines l LEFT JOIN held h ON l.k = h.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
