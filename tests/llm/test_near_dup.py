import random

import pytest

from tidemark.llm import near_dup as N
from tests.operators.test_components import plain as components


def sets(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs, k):
    s = {d: sets(t, k) for d, t in docs}
    ids = sorted(s)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    comp = components(links)
    return {d: (len(s[d]), comp.get(d, d)) for d in ids}


def run(spark, docs, k):
    df = spark.createDataFrame([(*d, 5, "z") for d in docs], "doc_id long, text string, n long, node string").repartition(4)
    rows = N.near_duplicates(df, shingle=k).collect()
    assert len(rows) == len(docs) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def corpus(seed, groups, size):
    """Groups of copies, each with some words changed, of prose of different lengths."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(500)]
    texts = []
    for _ in range(groups):
        base = [r.choice(words) for _ in range(r.randint(3, 120))]
        for _ in range(r.randint(1, size)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 40))):
                t[r.randrange(len(t))] = r.choice(words)
            texts.append(" ".join(t).title() if r.random() < 0.3 else "\n ".join(t))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("k", [4, 5])
def test_as_brute_force(spark, k):
    docs = list(enumerate(corpus(k, 40, 8)))
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A  b"), (1005, "b a"), (1006, "x " * 30000), (1007, "x " * 9)]
    assert run(spark, docs, k) == brute(docs, k)


def test_large_group_and_open_pairs(spark, monkeypatch):
    """One group of many copies at about the threshold: stars alone do not join it; blocks are small."""
    monkeypatch.setattr(N, "BLOCK", 16)
    r = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(150):
        t = list(base)
        for _ in range(r.choice((1, 2, 3))):
            t[r.randrange(100)] = f"q{r.randrange(50)}"
        docs.append((i, " ".join(t)))
    want = brute(docs, 5)
    assert len({c for _, c in want.values()}) < 60
    assert run(spark, docs, 5) == want
    monkeypatch.setattr(N, "OPEN_PAIRS", 0)  # star rounds first
    monkeypatch.setattr(N, "STAR_ROUNDS", 2)
    assert run(spark, docs, 5) == want


def test_odd_rows(spark):
    assert run(spark, [], 5) == {}
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (9, text), (9, text), (9, "another text of its own that is alone"), (None, "and one more without any id here"), (3, None)], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in N.near_duplicates(df).collect()), key=str)
    assert rows.count((9, 9, True)) == 3 and (3, 3, True) in rows and len(rows) == 6
