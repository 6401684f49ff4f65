import hashlib
import random
import re

from tidemark.llm import pii

RULES = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d)),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    found = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(RULES) for m in re.finditer(p, text or "") if ok(m[0])]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def texts():
    r = random.Random(3)
    yield from (None, "", "é 4111 1111 1111 1111 x", "a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.0255", "+1 (555) 010-9999 +12 +1234567890123456", "x@y.z.", "4111-1111-1111-11114111 1111")
    yield "9" * 3000 + " " + "a" * 5000 + "@" + "b." * 2000
    signs = "0123456789.-+ @ab()é\n4111111111111111"
    for _ in range(300):
        yield "".join(r.choice(signs) for _ in range(r.randint(1, 80)))


def test_base_spans(spark, tmp_path):
    rows = list(enumerate(texts()))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.op1_pii(spark, str(tmp_path)).collect()}
    for k, t in rows:
        want = plain(t)
        base = ",".join(s for s in got[k]["spans"].split(",") if not s.startswith("context"))
        assert base == want, (t, got[k]["spans"])
        assert got[k]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert got[k]["n_email"] == want.count("email:") and got[k]["n_phone"] == want.count("phone:")


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(RULES) for m in re.finditer(p, text) if ok(m[0]))


def tokens(text):
    """(start, end, value, context, seed) of the candidates, one after the other."""
    base = base_spans(text)
    for m in re.finditer(r"(?a)(?<!\S)(\S+)(?=(\s+)(\S*?[0-9@]\S*))", text):
        value = m[3].strip(pii.EDGES)
        start = m.start(3) + len(m[3]) - len(m[3].lstrip(pii.EDGES))
        end = start + len(value)
        met = [b for b in base if b[0] < end and b[2] > start]
        if own := [text[b[0] : b[2]] for b in met if b[0] >= start]:
            yield start, end, own[0], m[1].lower(), True
        elif not met and (len(re.findall("[0-9]", value)) >= 5 or re.search("[^@]@[^@]", value)):
            yield start, end, value, m[1].lower(), False


def patterns(value, context):
    shape = re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]", "9", value))
    return (context, "shape", shape), (context, "class", "@" in value)


def discovered(rows):
    """Plain Python over the whole graph: (row, start, end) of what good patterns introduce."""
    found = [list(tokens(t or "")) for t in rows]
    every = [x for f in found for x in f]
    seeds = {v for _, _, v, _, s in every if s}
    edges = {(v, c) for _, _, v, c, _ in every}
    hears, good = {}, {}
    while True:
        told = {}
        for v, c in edges:
            for p in patterns(v, c):
                told.setdefault(p, []).append(1.0 if v in seeds else hears.get((v, c), 0.0))
        now = {p: sum(x) / (len(x) + 1) for p, x in told.items()}
        now = {p: c for p, c in now.items() if c >= pii.MIN_CONFIDENCE and sum(x >= pii.MIN_CONFIDENCE for x in told[p]) >= pii.MIN_SEEDS}
        if len(now) == len(good):
            return {(r, a, b) for r, f in enumerate(found) for a, b, v, c, s in f if not s and any(p in now for p in patterns(v, c))}, len(good)
        good, hears = now, {}
        for v, c in edges:
            no = 1.0
            for other in {d for w, d in edges if w == v} - {c}:
                no *= 1 - max([good[p] for p in patterns(v, other) if p in good], default=0.0)
            hears[v, c] = 1 - no


def chain():
    """Contexts that only values which other contexts discover can make good: three generations."""
    rows = [f"please mail: user{i}@host.example now" for i in range(30)]
    rows += [f"please mail: nick{i}@localhost now" for i in range(6)]
    rows += [f"text handle nick{i}@localhost here" for i in range(6)] + ["text handle other@place here"]
    rows += ["see alias other@place and", *[f"see alias nick{i}@localhost and" for i in range(6)], "see alias last@one and"]
    rows += [f"é Phone:\n+1 555 010 {i}{i}{i}{i}, or" for i in range(5)] + ["Phone:\n555-123-4567 or", "the 2021 99999 12345 the 12345", None, "", "1234567"]
    return rows


def noise(r):
    words = ["id:", "ssn", "call", "mail", "the", "ref", "at"]
    values = [f"{r.randint(100, 999)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}" for _ in range(12)] + [f"u{i}@h{i % 3}.org" for i in range(8)] + [f"x{i}@local" for i in range(6)] + ["10.0.0.1", "+44 20 7946 0000", "4111111111111111", "(98765)", "no"]
    return " ".join(r.choice([r.choice(words), r.choice(values), "\n"]) for _ in range(r.randint(0, 25)))


def test_discovered_spans(spark):
    r = random.Random(8)
    for rows in (chain(), [noise(r) for _ in range(150)], [t for t in texts()]):
        df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "key long, body string, text string").repartition(3)
        got = {(x["id"], s["start"], s["end"]) for x in pii.find_pii(df, "key", "body").collect() for s in x["extra"] or ()}
        assert got == discovered(rows)[0]


def test_generations():
    """The chain is found link by link, and a context that supports itself alone is not good."""
    rows = chain()
    said = {rows[r][a:b] for r, a, b in discovered(rows)[0]}
    assert said == {*[f"nick{i}@localhost" for i in range(6)], "other@place", "last@one", "555-123-4567"}
    same = [f"the {i}{i}{i}{i}{i}{i}" for i in range(8)] + [f"the +1 555 010 {i}000" for i in range(4)]
    assert discovered(same)[0] == set()


def test_very_many_candidates(spark):
    """A text dense in numbers, addresses and long tokens is read in reasonable time, as is an empty table."""
    text = " ".join(f"n{i}@h.org 12345{i}" for i in range(8000)) + " token " + "7" * 30000 + "x"
    (got,) = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(got["base"]) == 8000 and all(text[s["start"] : s["end"]] == s["value"] for s in got["base"])
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
