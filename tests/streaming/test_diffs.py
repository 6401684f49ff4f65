from tests.plans.test_analyse import ANCHORS, TREE, diff_of
from tidemark.plans.analyse import Change, analyse
from tidemark.streaming.diffs import answer_diffs


def test_as_batch(spark, tmp_path):
    edits = [("one", {"src/lib/sum.ts": "export const sum = 2;\n"}), ("two", {"static/logo.svg": "x\n"}), ("none", {})]
    texts = {k: diff_of(TREE, TREE | e) for k, e in edits}
    spark.createDataFrame(list(texts.items()), "diff_id string, text string").repartition(2).write.parquet(f"{tmp_path}/in")
    tree = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in TREE.items()], "path string, content binary")
    got = []
    stream = spark.readStream.schema("diff_id string, text string").parquet(f"{tmp_path}/in")
    query = answer_diffs(stream, lambda: tree, ANCHORS, lambda df, n: got.extend(df.collect()), checkpoint=f"{tmp_path}/state")
    query.awaitTermination(120)
    want = {(k, r["anchor"], r["affected"], r["changed"]) for k, t in texts.items() for r in analyse(tree, Change.read(t), ANCHORS).collect()}
    assert {(r["diff_id"], r["anchor"], r["affected"], r["changed"]) for r in got} == want
