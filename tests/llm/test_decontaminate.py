import random
import re
from collections import Counter

import pytest

from tidemark.llm import decontaminate as D

R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdeé") for _ in range(R.randint(2, 6))) for _ in range(400)]


def prose(n):
    return [R.choice(VOCABULARY) for _ in range(n)]


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(ws):
    return [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)] if len(ws) >= 5 else [tuple(ws)] if ws else []


def brute(docs, items):
    """Every window as long as the item, against every item."""
    bags = {i: Counter(shingles(words(t))) for i, t in items}
    df = Counter(s for b in bags.values() for s in b)
    found = {}
    for d, t in docs:
        ws = words(t)
        for i, it in items:
            n = len(words(it))
            whole = sum(c / df[s] for s, c in bags[i].items())
            if not n:
                continue
            for at in range(-n + 1, len(ws)):
                window = ws[max(at, 0) : at + n]
                if n < 5 and len(ws) != n:
                    continue
                here = Counter(shingles(window))
                sim = sum(min(c, here[s]) / df[s] for s, c in bags[i].items()) / whole
                if sim >= 0.8 - 1e-9:
                    found[d, i] = max(found.get((d, i), 0), sim)
    return found


@pytest.fixture(scope="module")
def data():
    items = [(i, prose(R.randint(14, 60))) for i in range(12)]
    items += [(12, items[0][1][:20] + prose(20)), (13, ["only", "two"]), (14, [])]
    docs = []
    for k in range(60):
        body = prose(R.randint(0, 150))
        if k % 2:
            leak = list(items[k % 14][1])
            for _ in range(k // 10 % 3):
                leak[R.randrange(len(leak))] = "zzz"
            if k % 7 == 0:
                leak = leak[2:]
            at = R.randint(0, len(body))
            body = body[:at] + leak + body[at:]
        docs.append((k, ", ".join(body).title() if k % 3 else "\n".join(body)))
    docs += [(100, " ".join(items[3][1])), (101, "Only: two!"), (102, ""), (103, None), (104, " ".join(items[5][1] * 3))]
    return docs, [(i, " ".join(t)) for i, t in items] + [(15, None)]


def test_as_brute_force(spark, data):
    docs, items = data
    got = D.contaminated(spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item string, length int").repartition(3), spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc int")).collect()
    want = brute(docs, items)
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    seen = {(r["doc_id"], r["item_id"]): r["similarity"] for r in got}
    assert set(seen) == set(want) and all(abs(seen[k] - want[k]) < 1e-6 for k in seen), set(want) ^ set(seen)
    assert (101, 13) in seen and (104, 5) in seen


def test_shared_template(spark):
    """Words that many items share count little: a document with an item's own words alone is like it."""
    template = prose(20)
    items = [(i, " ".join(prose(30) + template)) for i in range(12)]
    docs = [(i, " ".join(prose(25) + t.split()[:30] + prose(40))) for i, t in items]
    want = brute(docs, items)
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) == 12 and {(r["doc_id"], r["item_id"]) for r in got} == set(want)
    assert all(abs(r["similarity"] - want[r["doc_id"], r["item_id"]]) < 1e-6 for r in got)


def test_blocks_meet_within_radius(spark):
    """Whatever bits differ, up to the radius: a probe of one is a block of the other."""
    as_long = lambda x: x - (1 << 64) * (x >> 63)
    rows = []
    for n in [D.RADIUS] * 60 + list(range(D.RADIUS)):
        a, bits = R.getrandbits(128), R.sample(range(128), n)
        b = a ^ sum(1 << x for x in bits)
        rows.append([as_long(x) for x in (a & (1 << 64) - 1, a >> 64, b & (1 << 64) - 1, b >> 64)])
    df = spark.createDataFrame(rows, "a long, b long, c long, d long").withColumn("asked", D.blocks("a", "b")).withColumn("id", D.F.monotonically_increasing_id())
    filed = df.select("id", "asked", D.F.explode(D.blocks("c", "d")).alias("b")).select("id", "asked", D.F.explode(D.probes()).alias("p"))
    met = filed.where("array_contains(asked, p)").select("id").distinct()
    assert met.count() == len(rows)


def test_recall_of_the_index(spark):
    """Of all pairs that brute force finds, the Hamming index alone must find nine tenths; the whole
    operator finds all. Edits are chosen so that similarities lie all over 0.8 to 1."""
    items = [(i, prose(R.randint(20, 90))) for i in range(25)]
    docs = []
    for k in range(120):
        own = list(items[k % 25][1])
        for _ in range(R.randint(0, max(1, len(own) // 22))):
            at = R.randrange(len(own))
            own[at : at + 1] = R.choice(([], ["zzz"], ["yyy", own[at]]))
        docs.append((k, " ".join(prose(R.randint(0, 30)) + own + prose(R.randint(0, 30)))))
    bench = [(i, " ".join(t)) for i, t in items]
    want = brute(docs, bench)
    got = {(r["doc_id"], r["item_id"]): r for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert set(got) == set(want) and len(want) > 60 and min(want.values()) < 0.85
    assert sum(r["hamming"] <= D.RADIUS for r in got.values()) >= 0.9 * len(want)


def test_many_shingles(spark, data, monkeypatch):
    """Beyond what is broadcast, the benchmark's shingles meet the documents' in parts."""
    docs, items = data
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plain = sorted(D.contaminated(*frames).collect(), key=str)
    monkeypatch.setattr(D, "BROADCAST_SHINGLES", 0)
    assert plain == sorted(D.contaminated(*frames).collect(), key=str)


def test_empty(spark, data):
    docs, items = data
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.contaminated(none, bench).count() == 0
    assert D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, items[2][1]), (7, items[2][1]), (7, items[2][1])], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in D.contaminated(twice, bench).collect() if r["doc_id"]) == [(7, 2)]
