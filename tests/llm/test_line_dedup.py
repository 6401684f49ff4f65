import hashlib
import random
from collections import defaultdict

import numpy as np

from tidemark.llm import line_dedup as L

STRIP = " \t\n\x0b\x0c\r"


def plain(docs, min_key=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(STRIP))
    holds = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            holds[key(x)].add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_key or len(holds[key(x)]) < 2 or min(holds[key(x)]) == d]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_op2_as_brute_force(spark, docs_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{docs_dir}/documents.parquet").collect()]
    want = plain(docs)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in L.op2_line_dedup(spark, docs_dir).collect()}
    assert got == {d: (n, m, hashlib.sha256(t.encode()).hexdigest()) for d, (n, m, t) in want.items()}
    assert sum(m for _, m, _ in want.values()) > 20


def test_keys(spark):
    docs = [(1, "\x0bAbcdefghiJ \nééééééééé\nÀbcdefghijk"), (2, "abcdefghij\nééééééééé\nàbcdefghijk"), (3, "abcdefghij\r"), (4, "x\nabcdefghi"), (5, "abcdefghi")]
    df = spark.createDataFrame([(*r, "q", "w") for r in docs], "doc_id long, text string, doc string, line_key string")
    out = L.dedup_lines(df)
    assert out.columns == df.columns and {r["doc_id"]: r["text"] for r in out.collect()} == {d: t for d, (_, _, t) in plain(docs).items()}
    assert L.dedup_lines(df.limit(0)).count() == 0
    # null ids are one document, after the others; repeated rows are one document too
    odd = spark.createDataFrame([(None, "shared line one\nmine"), (None, "shared line one"), (7, "shared line one"), (8, "twice in one doc\ntwice in one doc"), (8, "twice in one doc")], "doc_id long, text string")
    assert sorted(r["text"] for r in L.dedup_lines(odd).collect()) == ["", "mine", "shared line one", "twice in one doc", "twice in one doc\ntwice in one doc"]


def test_state_is_reversible(spark):
    r = random.Random(2)
    lines = [f"line number {i} of the pool" for i in range(40)]
    docs = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(1, 6)))) for i in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    state = lambda ix: (sorted((bytes(x["line_key"]), x["refs"], x["first_doc"]) for x in ix.counts.collect()), sorted((bytes(x["line_key"]), x["doc"]) for x in ix.held.collect()))
    decided = lambda ix, rows: {x["doc_id"]: L.kept_lines(x["text"], set(map(bytes, x["__tidemark_drop"] or ())), 10)[2] for x in ix.decide(frame(rows)).collect()}
    half = L.LineIndex.build(frame(docs[30:]), shard_keys=8)
    full = half.insert(frame(docs[:30])).insert(frame(docs[:5]))
    assert state(full) == state(L.LineIndex.build(frame(docs), shard_keys=8))
    assert decided(full, docs) == {d: t for d, (_, _, t) in plain(docs).items()}
    back = full.delete(frame(docs[:30]).select("doc_id"))
    assert state(back) == state(half)
    assert decided(back, docs[30:]) == {d: t for d, (_, _, t) in plain(docs[30:]).items()}
    sizes = lambda ix: sum((np.frombuffer(bytes(x["slots"]), np.uint16) != 0).sum() + len(x["overflow"]) for x in ix.filters.collect())
    assert sizes(back) == sizes(half) == half.counts.where("refs > 1").count()


def test_cuckoo_filter():
    r = random.Random(4)
    keys = [r.randbytes(16) for _ in range(5000)]
    f = L.CuckooFilter(4000)  # too small on purpose: the rest overflows
    for k in keys:
        f.insert(k)
    every = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
    assert all(k in f for k in keys) and f.contains_many(every).all()
    other = np.frombuffer(r.randbytes(16 * 20000), np.uint8).reshape(-1, 16)
    assert f.contains_many(other).mean() < 0.01
    assert [k.tobytes() in f for k in other[:500]] == list(f.contains_many(other[:500]))
    for k in keys[:2500]:
        assert f.delete(k)
    assert all(k in f for k in keys[2500:])
    for k in keys[2500:]:
        assert f.delete(k)
    assert not f.slots.any() and not f.overflow


def test_filters_beyond_broadcast(spark, monkeypatch):
    """Filters too large to broadcast are met shard by shard, with the same decisions; only what
    the filters know passes. Keys that very many documents hold are spread."""
    r = random.Random(9)
    lines = [f"line number {i} of the pool" for i in range(300)]
    docs = [(i if i % 9 else None, "a license line that most of them hold\n" * (i % 3 > 0) + "\n".join(r.choice(lines) for _ in range(r.randint(0, 6)))) for i in range(400)] + [(None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = L.LineIndex.build(frame, shard_keys=40, keep_held=False)
    assert index.shards > 3
    told = lambda: sorted((str(x["doc_id"]), str(x["text"]), sorted(map(bytes, x["__tidemark_drop"] or ()))) for x in index.decide(frame).collect())
    small, passed = told(), index.probed(frame, "doc_id", "text").count()
    monkeypatch.setattr(L, "BROADCAST_BYTES", -1)
    monkeypatch.setattr("tidemark.operators.skew.LEAST", 3)
    assert index.probe() is None and told() == small and any(x[2] for x in small)
    assert index.probed(frame, "doc_id", "text").count() == passed
