import subprocess

import pytest

from tidemark.sources import earlier


def test_git_and_table_agree(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    texts = {"a.ts": b"one\n", "sub/b c.json": b'{"x": 1}', "empty.ts": b"", "bin.dat": b"\x00\xff\n\n"}
    for p, t in texts.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(t)
    git("add", "-A")
    git("commit", "-qm", "first")
    (tmp_path / "a.ts").write_bytes(b"two\n")
    git("commit", "-qam", "second")
    paths = spark.createDataFrame([(p,) for p in [*texts, "gone.ts", "sub"]] + [(None,)], "path string").repartition(3)
    got = {r["path"]: r["content"] and bytes(r["content"]) for r in earlier.git_files(paths, str(tmp_path), "HEAD~1").collect()}
    assert {p: c for p, c in got.items() if c} == {p: c for p, c in texts.items() if c} and got["gone.ts"] is None and got["sub"] is None
    versions = spark.createDataFrame([(p, bytearray(t)) for p, t in texts.items()], "path string, content binary")
    assert {r["path"]: r["content"] and bytes(r["content"]) for r in earlier.table_files(paths, versions).collect()} == got
    assert earlier.config_texts(earlier.git_files(paths, str(tmp_path), "HEAD")) == {"sub/b c.json": '{"x": 1}'}
    with pytest.raises(earlier.UnknownRevision):
        earlier.git_files(paths, str(tmp_path), "nowhere")
