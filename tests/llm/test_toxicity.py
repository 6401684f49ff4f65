import random
import zlib

import pytest

from tidemark.llm import toxicity as T

TERMS = ["idiot", "moron", "worthless", "disgusting", "scum", "idle", "loser"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_as_brute_force():
    trie, r = T.FuzzyTrie(TERMS), random.Random(1)
    tokens = list(TERMS)
    for _ in range(4000):
        w = list(r.choice(TERMS))
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(w) + 1)
            op = r.randrange(3)
            if op == 0:
                w.insert(at, r.choice("abdeiorst"))
            elif w and at < len(w):
                w[at : at + 1] = [] if op == 1 else [r.choice("abdeiorst")]
        tokens.append("".join(w))
    for w in tokens:
        near = [(distance(w, t), t) for t in TERMS if distance(w, t) <= T.edits_allowed(t)]
        assert trie.find(w) == ((min(near)[1], min(near)[0]) if near else None), w


def test_automaton_starts_anew(monkeypatch):
    monkeypatch.setattr(T, "MAX_STATES", 3)
    trie = T.FuzzyTrie(TERMS)
    assert [trie.find(w) for w in ("idiott", "mor0n", "xyz", "worthles")] == [("idiot", 1), ("moron", 1), None, ("worthless", 1)]


def test_context():
    reader = T.Lexicon({"idiot": 5.0}, {"lowe": 4.0}, {"idiot"}, {"idol", "idiom"}).reader()
    abuse, quote, report = (T.features(x, reader) for x in ("you are an idiot man", 'he heard the "idiot" there', "she called the word idiot rude"))
    assert abuse[0] > 0 and abuse[4] > 0 and abuse[1] == 0
    assert quote[0] == report[0] == 0 and quote[1] > 0 and report[1] > 0
    assert T.features("an idi0t here", reader)[3] > 0 and T.features("lowetum", reader)[2] > 0
    assert T.features("an idol and idiom", reader) == T.features("", reader) == T.features(None, reader) == [0.0] * T.FEATURES


def labelled(n=700):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        t = [r.choice(words) for _ in range(r.randint(5, 60))]
        toxic = int(i % 6 == 0)
        for _ in range(toxic * 3):
            t.insert(r.randrange(len(t)), r.choice(TERMS[:5]))
        docs.append((i, " ".join(t), "xx", "src"))
        if i % 3 != 1:
            labels.append((i, 1, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("toxic")
    docs, labels = labelled()
    docs += [(2000, None, None, None), (2001, "", "x", None), (None, "an idiott and scum and moron", "x", "y"), (2002, "idiot moron scum", "x", "y"), (2002, "idiot moron scum", "x", "y")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), docs


def test_op6(spark, folder):
    at, docs = folder
    rows = T.op6_toxicity(spark, at).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 2000]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held) and len(held) > 80
    assert sum(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in held) >= 0.97 * len(held)
    by = {r["doc_id"]: r["predicted"] for r in rows}
    assert by[2000] == by[2001] == 0 and by[2002] == by[None] == 1


def test_scores_do_not_use_held_out_labels_or_ids(spark, folder):
    at, _ = folder
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    a, b = T.train(docs, labels), T.train(docs, flipped)
    assert a.lexicon == b.lexicon and (a.weights == b.weights).all()


def test_without_labels(spark, folder):
    at, _ = folder
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1")):
        model = T.train(docs, some)
        assert T.scored(docs, model, ["doc_id"]).where("toxicity between 0 and 1").count() == docs.count()
    assert T.scored(docs.limit(0), model, ["doc_id"]).count() == 0
    # the last model saw toxic labels only; texts without a hit still stay
    assert T.without_toxic(docs.where("doc_id in (2000, 2001)"), model).count() == 2
