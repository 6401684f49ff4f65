import random

import pytest

#: Texts that every operator must take: null, empty, blank, ties and copies, one very long.
ODD = [None, "", " \n\t ", "one", "same words here and there again", "same words here and there again", "Same  words here\nand there again", "é" * 40, "a\n\nb\n" * 3]


def corpus(n=60, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(300)]
    lines = [" ".join(r.choice(words) for _ in range(r.randint(3, 15))) for _ in range(80)]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randint(1, 12))) for _ in range(n)]
    texts += [t.upper() for t in texts[:5]] + texts[5:10] + [" ".join(r.choice(words) for _ in range(20000))]
    return ODD + texts


@pytest.fixture(scope="session")
def docs_dir(spark, tmp_path_factory):
    """A folder like the test data's: documents with odd rows, labels, benchmark."""
    at = tmp_path_factory.mktemp("data")
    texts = corpus()
    rows = [(i * 3 + 1, t, "en", None if i % 17 == 5 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], r[0] % 5 and 1, int(r[0] % 7 == 0)) for r in rows if r[0] % 2], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)
