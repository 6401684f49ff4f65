"""Secrets in texts: three plain patterns, and guess costs of values in credential contexts.

The guess cost of a value is the least number of bits over all ways to cut it into words,
dates, repeats, keyboard or alphabet walks and brute-force spans. A value that stands where a
credential stands (after ``password is``, ``token:``, ``Bearer`` ...) and costs at least
``MIN_BITS`` is told as a span of kind ``credential``; nothing but the cost decides.

Words cost by their rank. Besides a short list of usual parts of passwords, the words are those
of the corpus itself: all words that make up at least ``WORD_SHARE`` of the words of all
documents (so there are at most ``1 / WORD_SHARE``, whatever the corpus), counted over whole
texts but for the values in credential contexts, so that no secret becomes a word by being
copied.

Repeats, walks and words are spans of at most ``MAX_SPAN`` characters; what goes on is a further
span. A value is read only until it is certain to cost ``MIN_BITS``, so that very long values
take little time; whole values are told.

Nulls: a null text is empty. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, map_slices, table

KINDS = ("assign", "access", "hex", "credential")
#: A value has at least so many characters and costs at least so many bits.
MIN_VALUE, MIN_BITS = 8, 40.0
#: The longest word, repeat or walk that is one span.
MAX_SPAN = 64
#: A word of the corpus has at least such a share of all its words, and so many uses.
WORD_SHARE, MIN_USES = 5e-6, 3
WORD = re.compile(rb"[a-z]{3,24}")

# Fixed values of the base patterns.
ASSIGN = re.compile(rb"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

CONTEXT = re.compile(
    rb"(?i)(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|bearer|credentials?|(?:api|access|private|auth|secret)[ _-]?key|authorization)[\"']?"
    rb"(?:[ \t]{0,3}(?::=|=>|[:=])|[ \t]{1,3}(?:is|was)(?=[ \t])|(?<=[rR])(?=[ \t]))[ \t]{0,3}[\"']?([^\s\"'<>,;()]{8,})"
)
CONTEXT_WORDS = (b"pass", b"pwd", b"secret", b"token", b"bearer", b"credential", b"key", b"authorization")

#: Common parts of passwords, most usual first; a word's rank is its cost.
WORDS = (
    "password pass admin welcome login letmein qwerty monkey dragon master secret love hello test user root guest "
    "changeme default summer winter spring autumn sunshine princess football baseball shadow hunter killer super "
    "server system service public private account access computer internet company office manager mother father "
    "january february march april may june july august september october november december monday tuesday wednesday "
    "thursday friday saturday sunday red blue green black white orange purple yellow silver gold happy lucky magic "
    "power star angel tiger lion eagle michael jordan robert thomas andrew daniel jessica ashley charlie george "
    "example sample demo string value key token dev prod staging local the and for you this that "
    "everything something nothing anything required expired invalid missing unknown"
).split()
RANKS = {w: i + 1 for i, w in enumerate(WORDS)}
LEET = str.maketrans("@4301!57$", "aaeoiists")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d(?:([-/.]?)(?:0[1-9]|1[0-2])(?:\1(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])([-/.]?)(?:0?[1-9]|1[0-2])\2(?:(?:19|20)\d\d|\d\d)")
#: Bits that each further span costs: the guesser tries orders and kinds too.
JOINT = 1.5


def _neighbours() -> set[tuple[str, str]]:
    near = set()
    for i, row in enumerate(ROWS):
        for j, a in enumerate(row):
            near.update((a, b) for b in row[max(0, j - 1) : j + 2] if b != a)
            if i + 1 < len(ROWS):
                for b in ROWS[i + 1][max(0, j - 1) : j + 1]:
                    near |= {(a, b), (b, a)}
    return near


NEAR = _neighbours()


def _walks(a: str, b: str) -> bool:
    return (a, b) in NEAR or abs(ord(a) - ord(b)) == 1 and a.isalnum() and b.isalnum()


def _alphabet_bits(c: str) -> float:
    if c.isdigit():
        return math.log2(10)
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return math.log2(26)
    return math.log2(33) if ord(c) < 128 else math.log2(100)


class Guesser:
    """Guess costs over a list of words, each with its rank."""

    def __init__(self, ranks: dict[str, int] | None = None):
        self.ranks = RANKS | {w: min(r, RANKS.get(w, r)) for w, r in (ranks or {}).items()}
        self.longest = min(MAX_SPAN, max(map(len, self.ranks)))

    def bits(self, value: str, enough: float = math.inf) -> float:
        """Bits of the cheapest segmentation, by dynamic programming over prefixes.

        Reading ends when ``MAX_SPAN`` prefixes in a row cost ``enough``: no span jumps over them
        and no cost is negative, so the whole costs as much; the least of them is given.
        """
        n, low, best, ranks = len(value), value.lower(), [0.0], self.ranks
        if len(low) != n:  # a sign whose small form is longer
            low = "".join(x if len(x) == 1 else c for c, x in zip(value, map(str.lower, value), strict=True))
        plain = low.translate(LEET)
        kinds = {("d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s") for c in value}
        mixed = math.log2(max(2, 10 * ("d" in kinds) + 26 * ("u" in kinds) + 26 * ("l" in kinds) + 33 * ("s" in kinds)))
        best += [math.inf] * n
        dear = walk = 0  # prefixes in a row that cost enough; where the walk ends that holds i
        same = [0] * 5  # for each unit, where its repeat ends that holds i
        for i in range(n):
            dear = dear + 1 if best[i] >= enough else 0
            if dear >= MAX_SPAN:
                return min(best[i - MAX_SPAN + 1 : i + 1])
            base, end = best[i] + (JOINT if i else 0.0), min(n, i + MAX_SPAN)

            def reach(j: int, bits: float, base: float = base) -> None:
                if base + bits < best[j]:
                    best[j] = base + bits

            # brute force goes on without a joint: one more character of the whole alphabet
            best[i + 1] = min(best[i + 1], best[i] + min(mixed, _alphabet_bits(value[i]) + (JOINT if i else 0.0)))
            for j in range(i + 3, min(n, i + self.longest) + 1):
                rank = ranks.get(low[i:j])
                changed = 0
                if rank is None:
                    rank, changed = ranks.get(plain[i:j]), 1
                if rank is not None:
                    word = value[i:j]
                    case = 0.0 if word.islower() or not any(c.isupper() for c in word) else 1.0 if word.isupper() or word[0].isupper() and not any(c.isupper() for c in word[1:]) else float(sum(c.isupper() for c in word) + 1)
                    reach(j, math.log2(rank + 1) + case + changed * 2.0)
            if (m := DATE.match(value, i)) and m.end() - i >= 4:
                reach(m.end(), math.log2(120 if m.end() - i == 4 else 366 * 120) + 1.0)
            if walk <= i:
                walk = i + 1
            while walk < end and _walks(low[walk - 1], low[walk]):
                walk += 1
            for j in range(i + 3, min(walk, end) + 1):
                reach(j, math.log2(47 * 4) + math.log2(j - i))
            for unit in (1, 2, 3, 4):
                # as far as each character is the one a unit before
                same[unit] = max(same[unit], min(n, i + unit))
                while same[unit] < end and value[same[unit]] == value[same[unit] - unit]:
                    same[unit] += 1
                for times in range(2, (min(same[unit], end) - i) // unit + 1):
                    reach(i + times * unit, unit * mixed + math.log2(times))
        return best[n]


def guess_bits(value: str) -> float:
    """Bits of the cheapest segmentation over the fixed words alone."""
    return Guesser().bits(value)


def contexts(data: bytes, low: bytes) -> list[tuple[int, int]]:
    """Where values stand in credential contexts, in bytes."""
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    found = []
    for m in CONTEXT.finditer(data):
        a, b = m.span(1)
        while b > a and data[b - 1 : b] in (b".", b"!", b"?", b":"):
            b -= 1
        found.append((a, b))
    return found


def corpus_words(docs: DataFrame, text_col: str = "text", share: float = WORD_SHARE, least: int = MIN_USES) -> dict[str, int]:
    """The words of the corpus and their ranks, the most usual first; see the module's docstring
    for their bound."""

    def work(c: dict[str, list]) -> dict[str, list]:
        counts: Counter = Counter()
        for text in c["text"]:
            data = (text or "").encode()
            low, at = data.lower(), 0
            for a, b in contexts(data, low):
                counts.update(WORD.findall(low, at, a))
                at = b
            counts.update(WORD.findall(low, at))
        return {"word": [w.decode() for w in counts], "n": list(counts.values())}

    counted = map_slices(docs.select(F.col(text_col).alias("text")), work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = cut(counted)
    floor = max(least, share * (counted.agg(F.sum("n")).first()[0] or 0))
    usual = counted.where(F.col("n") >= floor).orderBy(F.desc("n"), "word").collect()
    return {r["word"]: i + 1 for i, r in enumerate(usual)}


def secret_spans(text: str | None, guesser: Guesser | None = None) -> list[tuple[str, int, int]]:
    """All spans in code points, base ones and credentials, by start and kind."""
    if not text:
        return []
    data = text.encode()
    low = data.lower()
    found: list[tuple[int, int, int]] = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(data)]
    found.sort()
    if values := contexts(data, low):
        guesser = guesser or Guesser()
        starts, furthest = [s for s, _, _ in found], list(accumulate((e for _, _, e in found), max))
        for a, b in values:
            before = bisect_right(starts, a)
            value = data[a:b].decode()
            if len(value) >= MIN_VALUE and not (before and furthest[before - 1] >= b) and guesser.bits(value, MIN_BITS) >= MIN_BITS:
                found.append((a, 3, b))
        found.sort()
    if len(data) == len(text):
        return [(KINDS[k], a, b) for a, k, b in found]
    at, chars, place = 0, 0, {}
    for p in sorted({p for a, _, b in found for p in (a, b)}):
        chars += len(data[at:p].decode())
        at, place[p] = p, chars
    return [(KINDS[k], place[a], place[b]) for a, k, b in found]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _reader(docs: DataFrame, text_col: str):
    """secret_spans with the corpus's words; the guesser is made once in each Python worker."""
    sent, ready = docs.sparkSession.sparkContext.broadcast(corpus_words(docs, text_col)), []

    def spans(text: str | None) -> list[tuple[str, int, int]]:
        if not ready:
            ready.append(Guesser(sent.value))
        return secret_spans(text, ready[0])

    return spans


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, start, end, value): one row for each span, values as they stand in the text."""
    spans = _reader(docs, text_col)

    def work(c: dict[str, list]) -> dict[str, list]:
        rows = [(d, k, a, b, t[a:b]) for d, t in zip(c["id"], c["text"], strict=True) for k, a, b in spans(t)]
        return {n: [r[i] for r in rows] for i, n in enumerate(("id", "kind", "start", "end", "value"))}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_slices(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), work, f"id {kind}, kind string, start long, end long, value string")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans_of = _reader(docs, "text")

    def work(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_assign", "n_access", "n_hex", "n_credential", "base_sha256", "spans")}
        for doc, text in zip(c["doc_id"], c["text"], strict=True):
            spans = spans_of(text)
            kinds = [k for k, _, _ in spans]
            base = joined([s for s in spans if s[0] != "credential"])
            for name, value in zip(out, (doc, *(kinds.count(k) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), joined(spans)), strict=True):
                out[name].append(value)
        return out

    return map_slices(docs, work, "doc_id long, n_assign long, n_access long, n_hex long, n_credential long, base_sha256 string, spans string")
