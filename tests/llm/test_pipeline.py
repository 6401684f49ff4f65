"""The pipeline against plain Python, stage by stage."""

import random

import pytest

import corpus_pipeline
from tests.llm import test_decontaminate, test_line_dedup, test_mixing, test_near_dup, test_toxicity
from tidemark.llm import mixing, stages, toxicity
from tidemark.llm.common import cut


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pipeline"))
    r = random.Random(11)
    docs, labels = test_toxicity.labelled(300)
    bench = [(i, " ".join(test_decontaminate.prose(40))) for i in range(4)]
    shared = ["a line that many documents share", "and another shared line of words"]
    rows = []
    for i, t, lang, _ in docs:
        if i % 4 == 0:
            t += "\n" + r.choice(shared)
        if i % 25 == 7:
            t += "\nintro " + bench[i % 4][1] + " outro"
        rows.append((i, t, lang, f"src{i % 5}" if i % 11 else None, len(t)))
    rows += [(1000 + i, rows[i][1].upper(), "en", "src1", 0) for i in range(1, 40, 3)]
    rows += [(1100 + i, (rows[i][1] + " more").replace("\n", " end\n"), "en", "src1", 0) for i in range(2, 90, 5)]
    rows += [(2000, None, None, None, None), (2001, "", "x", "src0", 0), (2002, " ".join(r.choice("abcdefg") for _ in range(20000)), "x", "src0", 0)]
    spark.createDataFrame([(*x, "extra", 5) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, taken string, component int").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, bench


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages(spark, folder):
    at, bench = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    names = docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{at}/labels.parquet"))
    reader = model.lexicon.reader()
    one = cut(stages.drop_toxic(spark, docs, at))
    want = [(d, t) for d, t in pairs(docs) if model.score([toxicity.features(t, reader)])[0] < 0.5]
    assert pairs(one) == want and one.columns == names and 0 < len(want) < docs.count()
    assert all(d % 6 for d, _ in want if d < 1000)

    two = cut(stages.drop_repeated_lines(spark, one, at))
    lines = test_line_dedup.plain(want)
    assert pairs(two) == sorted((d, None if t is None else lines[d][2]) for d, t in want) and two.columns == names
    assert all(r["n_chars"] == len(r["text"]) for r in two.where("text is not null").collect())

    three = cut(stages.drop_near_duplicates(spark, two, at))
    groups = test_near_dup.brute(pairs(two), 5)
    kept = [(d, t) for d, t in pairs(two) if groups[d][1] == d]
    assert pairs(three) == kept and three.columns == names and len(kept) < two.count()

    four = cut(stages.drop_contaminated(spark, three, at))
    bad = {d for d, _ in test_decontaminate.brute([x for x in kept if len(x[1] or "") < 5000], bench)}
    clean = [x for x in kept if x[0] not in bad]
    assert pairs(four) == clean and four.columns == names and bad

    five = stages.mix_sources(spark, four, at)
    sources = {r["doc_id"]: r["source"] for r in four.collect()}
    mixed = {x[0]: x for x in test_mixing.plain([(d, sources[d], t) for d, t in clean]) if x[4]}
    got = {r["doc_id"]: (r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in five.collect()}
    assert got == mixed
    assert five.columns == [f"documents_{n}" if n in mixing.MADE else n for n in names] + list(mixing.MADE)

    run = corpus_pipeline.run(spark, at)
    assert sorted(r["doc_id"] for r in run.collect()) == sorted(got)


def test_null_and_repeated_ids(spark, folder, tmp_path):
    _, bench = folder
    prose = lambda n: " ".join(test_decontaminate.prose(n))
    copy, other, leak, twice = prose(40), prose(40), "intro " + bench[0][1] + " outro", prose(40)
    rows = [(1, copy), (None, copy), (None, prose(40)), (None, prose(30)), (2, other), (2, copy), (2, prose(40)), (None, None), (None, "")]
    rows += [(None, twice), (None, twice), (None, leak), (3, leak + " more"), (3, prose(50)), (9, other), (8, twice + " z")]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, row int").repartition(3)
    near = stages.drop_near_duplicates(spark, docs, folder[0])
    left = [r["row"] for r in near.collect()]
    assert near.columns == docs.columns and sorted(left) == [0, 2, 3, 4, 6, 7, 8, 12, 13, 15]
    exact = stages.drop_near_duplicates(spark, docs.where("row in (9, 10, 7, 8)"), folder[0])
    assert sorted(r["row"] in (9, 10) for r in exact.collect()) == [False, False, True]
    clean = stages.drop_contaminated(spark, docs, folder[0])
    assert clean.columns == docs.columns and sorted(r["row"] for r in clean.collect()) == [i for i in range(len(rows)) if i not in (11, 12)]


def test_empty(spark, folder, tmp_path):
    at, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_shape():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near duplicates", "decontamination", "source mixing"]
