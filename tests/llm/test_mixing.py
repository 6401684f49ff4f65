import hashlib
import math
from collections import defaultdict

from tidemark.llm import mixing


def targets(sizes):
    """Water filling by rounds, as it is stated: caps stop, the excess goes on by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    got, left, free = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        share, spent, of = left, 0.0, sum(weight[s] for s in free)
        for s in list(free):
            give = share * weight[s] / of
            if got[s] + give >= 2 * sizes[s]:
                give = 2 * sizes[s] - got[s]
                free.discard(s)
            got[s] += give
            spent += give
        left -= spent
    return got


def plain(rows):
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len((t or "").encode().split())
    goal, out = targets(sizes), []
    for source, size in sizes.items():
        epochs = int(goal[source] // size) if size else 0
        rest = math.floor(goal[source] - epochs * size + 1e-9)
        mine = []
        for d, s, t in rows:
            if s == source:
                w = (t or "").encode().split()
                u = (int(hashlib.md5(("null:" + hashlib.md5((t or "").encode()).hexdigest() if d is None else str(d)).encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                mine.append((-math.log(u) / ((len(set(w)) + 1) / (len(w) + 1)), -1 if d is None else d, len(w)))
        for _, d, n in sorted(mine):
            part = max(0, min(n, rest))
            rest -= n
            out.append((None if d == -1 else d, n, size, round(goal[source], 6), epochs * n + part))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, text string, size int, target string").repartition(3)
    got = [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mix_documents(df).collect()]
    assert sorted(got, key=str) == plain(rows)
    assert all(t <= 2 * n for _, n, _, _, t in got)
    return got


def test_as_brute_force(spark, docs_dir):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet(f"{docs_dir}/documents.parquet").collect()]
    got = check(spark, rows)
    taken = defaultdict(int)
    for _, _, size, target, t in got:
        taken[size, target] += t
    assert all(abs(t - target) <= 1 for (_, target), t in taken.items())


def test_edges(spark):
    words = "a b c d e f g h i j"
    check(spark, [(1, "a", words)])
    check(spark, [(1, "a", None), (2, "b", ""), (None, None, words), (4, "é", words * 3)])
    check(spark, [(5, "a", words)] * 4 + [(6, "z", "one")])
    check(spark, [(1, "a", None)])
    assert mixing.mix_documents(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_targets_with_many_sources(spark):
    sizes = {f"s{i:03d}": (i * 7919) % 5000 for i in range(200)} | {None: 12}
    df = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    want = targets(sizes)
    assert all(abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) for r in df.collect())


def test_partition_count_does_not_matter(spark, docs_dir):
    docs = spark.read.parquet(f"{docs_dir}/documents.parquet")
    seen = {tuple(sorted((r["doc_id"], r["taken"]) for r in mixing.mix_documents(docs.repartition(n)).collect())) for n in (1, 7)}
    assert len(seen) == 1
