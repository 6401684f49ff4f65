import random
import zlib

import numpy as np
import pytest

from tidemark.llm import quality as Q


def text(r, words, good):
    t = [r.choice(words) for _ in range(r.randint(20, 90))]
    if good:
        return ". ".join(" ".join(t[i : i + 9]).capitalize() for i in range(0, len(t), 9)) + "."
    kind = r.randrange(3)
    return " | ".join(t) if kind == 0 else " ".join(x for x in t[:6] for _ in range(12)) if kind == 1 else "!! ".join(t).upper()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows = [(i, text(r, words, i % 5 != 3), "xx", "s") for i in range(900)] + [(2000, None, None, None), (2001, "", "x", None), (2002, "\n", "x", None), (None, "a", "x", None), (2003, "x" * 200000, "", "")]
    at = tmp_path_factory.mktemp("quality")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 3), 0) for i in range(0, 900, 2)] + [(None, 1, 0), (7777, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows


def test_op10(spark, folder):
    at, docs = folder
    rows = Q.op10_quality(spark, at).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 2000]
    assert sum(r["predicted"] == int(r["doc_id"] % 5 != 3) for r in held) >= 0.97 * len(held) and len(held) > 100


def test_no_negative_label_is_used(spark, folder):
    at, _ = folder
    docs, labels = Q.featured(spark.read.parquet(f"{at}/documents.parquet")), spark.read.parquet(f"{at}/labels.parquet")
    model = Q.train(docs, labels)
    assert (model.weights == Q.train(docs, labels.where("quality = 1")).weights).all()
    assert 0.6 < model.prior < 0.95  # 0.8 in truth


def test_without_positives(spark, folder):
    at, _ = folder
    docs, labels = Q.featured(spark.read.parquet(f"{at}/documents.parquet")), spark.read.parquet(f"{at}/labels.parquet")
    model = Q.train(docs, labels.where("quality = 0"))
    assert {r["quality_score"] for r in Q.scored(docs, model).collect()} == {0.5}
    assert Q.scored(docs.limit(0), model).count() == 0


def test_prior_and_risk():
    r = np.random.RandomState(0)
    p, n = r.normal(2, 1, (2000, 1)), r.normal(-2, 1, (600, 1))
    u = np.vstack([r.normal(2, 1, (1400, 1)), n])
    assert abs(Q.estimate_prior(p[:, 0], Q.above(u[:, 0], Q.prior_cuts(p[:, 0])), len(u)) - 0.7) < 0.08
    w = Q.minimise_risk(p, u, 0.7, np.zeros(2))
    assert ((u @ w[:1] + w[1] > 0)[:1400].mean(), (u @ w[:1] + w[1] < 0)[1400:].mean()) > (0.95, 0.95)


def test_statistics_cover_all_rows(spark, folder):
    """Mean, spread and prior are those of all rows that are not held out, however few are sampled."""
    at, rows = folder
    docs, labels = Q.featured(spark.read.parquet(f"{at}/documents.parquet")), spark.read.parquet(f"{at}/labels.parquet")
    known = [t for d, t, _, _ in rows if d is not None and zlib.crc32(str(d).encode()) % 5]
    x = np.array([Q.features(t) for t in known])
    model, few = Q.train(docs, labels), Q.train(docs, labels, 200, 150)
    for m in (model, few):
        assert np.allclose(m.scale.mean, x.mean(axis=0)) and np.allclose(m.scale.spread, np.maximum(x.std(axis=0), 1e-3))
    assert 0.6 < few.prior < 0.95 and few.prior != model.prior
