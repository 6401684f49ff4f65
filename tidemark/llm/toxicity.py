"""Toxicity: a lexicon trie met by Levenshtein automata, hits scored in their context.

The lexicon is learnt from labelled rows: words and word beginnings (stems, ``lowe*``) whose
odds in toxic texts are high and that stand in many different places (the word before them
counts, so that copies of one text do not make all its words look toxic).

The trie and the automaton for 1 edit (2 from 8 letters on) are run as one product automaton,
whose states are made as texts need them; a misspelled term is found in one walk over the word.
A word near a term is no misspelling of it if clean training rows use it relatively as often as
that term's odds forbid, and a term has no misspellings at all if the words near it are usual in
clean rows (``MAX_CLEAN_SHARE`` of them have one): both are shares, whatever the sample's size.

A hit counts less where its window quotes or reports it and more where it addresses someone.
The features of a document go through a logistic regression.

Nulls and empty texts have no hits and get the score of a text without any, which is learnt as
all others are. At most ``MAX_LABELLED`` labelled rows are used; all terms that pass are kept.
Without labelled rows of both kinds nothing can be told apart: every text scores 0.25.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, held_out, keep_rows, map_slices, table
from tidemark.llm.learning import Scale, logistic, sigmoid, training_rows

MAX_LABELLED = 30_000
#: A term stands in so many different places and has such odds; a stem starts so many words.
MIN_PLACES, MIN_LOG_ODDS, MIN_WORDS = 8, 2.5, 3
STEMS = (4, 5, 6)
#: Misspellings of a term count unless such a share of the clean training rows has words near it.
MAX_CLEAN_SHARE = 0.005
WORD = re.compile(r"[^\W_]+")
#: Tokens on either side of a hit; what quoting and addressing windows hold.
WINDOW = 6
QUOTES = "\"'`“”„«»‘’‹›"
REPORTS = frozenset("said says say wrote writes quote quoted quotes called term word words phrase reported reportedly alleged dit dits cite mot sagte sagt schrieb zitat wort dijo dice escribió cita palabra".split())
ADDRESS = frozenset("you your yours you're u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted vos".split())
#: Words that one task remembers; states of the automaton before it starts anew.
REMEMBERED, MAX_STATES = 150_000, 20_000


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class FuzzyTrie:
    """Words of a trie within their allowed edits of a token, by a lazily made automaton.

    A state is the set of (trie node, edits so far, least edits only); reading a letter moves,
    substitutes or inserts, and skipped trie letters (deletions) are closed over at once.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.bound: list[int] = [0]
        for term in terms:
            node, d = 0, edits_allowed(term)
            self.bound[0] = max(self.bound[0], d)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.bound.append(0)
                node = self.children[node][c]
                self.bound[node] = max(self.bound[node], d)
            self.ends[node] = term
        self._start()

    def _start(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[str, int] | None] = []
        self._state(self._closed({0: 0}))

    def _closed(self, at: dict[int, int]) -> frozenset:
        queue = list(at.items())
        while queue:
            node, e = queue.pop()
            if at.get(node) != e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.bound[child] and at.get(child, 99) > e + 1:
                    at[child] = e + 1
                    queue.append((child, e + 1))
        return frozenset(at.items())

    def _state(self, members: frozenset) -> int:
        known = self.states.get(members)
        if known is None:
            known = self.states[members] = len(self.sets)
            self.sets.append(members)
            self.moves.append({})
            hits = [(e, self.ends[n]) for n, e in members if self.ends[n] is not None and e <= edits_allowed(self.ends[n])]
            self.found.append((min(hits)[1], min(hits)[0]) if hits else None)
        return known

    def _move(self, state: int, letter: str) -> int:
        at: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.bound[node] and at.get(node, 99) > e:
                at[node] = e

        for node, e in self.sets[state]:
            put(node, e + 1)
            for c, child in self.children[node].items():
                put(child, e + (c != letter))
        nxt = self.moves[state][letter] = self._state(self._closed(at))
        return nxt

    def find(self, token: str) -> tuple[str, int] | None:
        """The nearest term and its edits, the first in order among equals."""
        if len(self.sets) > MAX_STATES:
            self._start()
        state = 0
        for letter in token:
            nxt = self.moves[state].get(letter)
            state = self._move(state, letter) if nxt is None else nxt
            if not self.sets[state]:
                return None
        return self.found[state]


@dataclass
class Lexicon:
    """Weights (log odds) of words and stems; terms whose misspellings count; words of clean
    texts that are near to one of these."""

    words: dict[str, float]
    stems: dict[str, float]
    fuzzy: set[str] = field(default_factory=set)
    clean: set[str] = field(default_factory=set)

    def reader(self) -> Reader:
        return Reader(self)


class Reader(dict):
    """token -> (weight, kind) or None; kinds: 0 exact, 1 stem, 2 misspelled."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon, self.trie = lexicon, FuzzyTrie(sorted(lexicon.fuzzy))
        self.lengths = sorted({len(s) for s in lexicon.stems}, reverse=True)

    def __missing__(self, token: str) -> tuple[float, int] | None:
        if len(self) >= REMEMBERED:
            self.clear()
        x = self[token] = self._read(token)
        return x

    def _read(self, token: str) -> tuple[float, int] | None:
        if (w := self.lexicon.words.get(token)) is not None:
            return w, 0
        for n in self.lengths:
            if len(token) > n and (w := self.lexicon.stems.get(token[:n])) is not None:
                return w, 1
        if len(token) >= 4 and token not in self.lexicon.clean and (near := self.trie.find(token)):
            return self.lexicon.words[near[0]] / (1 + near[1]), 2
        return None


FEATURES = 8


def features(text: str | None, reader: Reader) -> list[float]:
    """Hits by kind and context; without hits all zero."""
    low = (text or "").lower()
    tokens = WORD.findall(low)
    if not any(reader[t] for t in set(tokens)):
        return [0.0] * FEATURES
    abuse = quoted = stems = near = direct = best = 0.0
    different, spans = set(), [(m.start(), m.end()) for m in WORD.finditer(low)]
    for i, t in enumerate(tokens):
        if not (hit := reader[t]):
            continue
        weight, kind = hit
        a, b = spans[i]
        window = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
        report = low[a - 1 : a] in QUOTES and a > 0 or low[b : b + 1] in QUOTES and b < len(low) or not REPORTS.isdisjoint(window)
        address = not ADDRESS.isdisjoint(window)
        different.add(t)
        best = max(best, weight)
        if report:
            quoted += 1
        elif kind == 2:
            near += 1
        else:
            abuse += weight
            stems += kind == 1
        direct += address and not report
    return [math.log1p(abuse), math.log1p(quoted), math.log1p(stems), math.log1p(near), math.log1p(direct), best if abuse else 0.0, math.log1p(len(different)), min(1.0, 20 * (abuse + near) / (len(tokens) + 20))]


@dataclass
class Model:
    lexicon: Lexicon
    scale: Scale
    weights: np.ndarray

    def score(self, rows: list[list[float]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        x = np.array(rows)
        return sigmoid(self.scale(x) @ self.weights[:-1] + self.weights[-1])


def _terms(tokens: list[str]) -> set[tuple[str, str, str]]:
    """(term, word before, word); a stem's term ends with a star."""
    out = set()
    for before, t in zip(["", *tokens], tokens, strict=False):
        out.add((t, before, t))
        out.update((t[:n] + "*", before, t) for n in STEMS if len(t) > n)
    return out


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """From (label, text): terms first from toxic rows, then their use in clean ones."""

    def places(c: dict[str, list]) -> dict[str, list]:
        found = [x for t in c["text"] for x in _terms(WORD.findall(t.lower()))]
        return {"term": [x[0] for x in found], "before": [x[1] for x in found], "word": [x[2] for x in found]}

    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    seen = map_slices(rows.where("label = 1").select("text"), places, "term string, before string, word string")
    seen = seen.groupBy("term").agg(F.countDistinct("before").alias("places"), F.countDistinct("word").alias("words"))
    seen = seen.where((F.col("places") >= MIN_PLACES) & (~F.col("term").endswith("*") | (F.col("words") >= MIN_WORDS)))
    candidates = {r["term"]: r["words"] for r in seen.collect()}

    def uses(c: dict[str, list]) -> dict[str, list]:
        counts: Counter = Counter()
        for label, t in zip(c["label"], c["text"], strict=True):
            counts.update((x, label) for x in {x for x, _, _ in _terms(WORD.findall(t.lower()))} & candidates.keys())
        return {"term": [t for t, _ in counts], "label": [x for _, x in counts], "n": list(counts.values())}

    used = map_slices(rows, uses, "term string, label int, n long").groupBy("term").agg(F.sum(F.expr("if(label = 1, n, 0)")).alias("toxic"), F.sum(F.expr("if(label = 0, n, 0)")).alias("clean"))
    odds = {r["term"]: math.log((r["toxic"] + 0.5) / (n_toxic + 1)) - math.log((r["clean"] + 0.5) / (n_clean + 1)) for r in used.collect()}
    good = sorted((t for t, w in odds.items() if w >= MIN_LOG_ODDS), key=lambda t: (-odds[t], t))
    stems: dict[str, float] = {}
    for t in sorted((t for t in good if t.endswith("*")), key=len):
        if not any(t[:n] in stems for n in STEMS):
            stems[t[:-1]] = odds[t]
    words = {t: odds[t] for t in good if not t.endswith("*")}
    lexicon = Lexicon(words, stems)

    terms = sorted(w for w in words if edits_allowed(w))

    def near(c: dict[str, list]) -> dict[str, list]:
        trie, out = FuzzyTrie(terms), []
        for label, x in zip(c["label"], c["text"], strict=True):
            out += [(label, t, hit[0]) for t in set(WORD.findall(x.lower())) if len(t) >= 4 and t not in words and (hit := trie.find(t))]
        return {"label": [x[0] for x in out], "word": [x[1] for x in out], "near": [x[2] for x in out]}

    if terms and n_clean:
        # one row for each row and word near a term
        used = cut(map_slices(rows, near, "label int, word string, near string").groupBy("near", "word").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean")))
        # a term that clean texts often have words near of is part of a family of usual words
        usual = {r["near"] for r in used.groupBy("near").agg(F.sum("clean").alias("clean")).where(F.col("clean") > MAX_CLEAN_SHARE * n_clean).collect()}
        lexicon.fuzzy = set(terms) - usual
        odds_of = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
        veto = used.where((F.col("clean") > 0) & (odds_of < MIN_LOG_ODDS)).select("word", "near").collect()
        lexicon.clean = {r["word"] for r in veto if r["near"] in lexicon.fuzzy}
    return lexicon


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    rows = training_rows(docs, labels, "toxic", most)
    lexicon = learn_lexicon(rows)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    readers: list[Reader] = []

    def work(c: dict[str, list]) -> dict[str, list]:
        if not readers:
            readers.append(sent.value.reader())
        return {"label": c["label"], "x": [features(t, readers[0]) for t in c["text"]]}

    got = map_slices(rows, work, "label int, x array<double>").collect()
    x = np.array([r["x"] for r in got]).reshape(-1, FEATURES)
    y = np.array([float(r["label"] == 1) for r in got])
    scale = Scale(x)
    if len(set(y)) < 2:
        return Model(lexicon, scale, np.append(np.zeros(FEATURES), -math.log(3)))
    return Model(lexicon, scale, logistic(scale(x), y))


def scored(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of the documents with ``toxicity``, the score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    readers: list[Reader] = []

    def work(c: dict[str, list]) -> dict[str, list]:
        if not readers:
            readers.append(sent.value.lexicon.reader())
        texts = c.pop("__tidemark_text")
        return c | {"toxicity": sent.value.score([features(t, readers[0]) for t in texts])}

    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "toxicity double"])
    return map_slices(docs.select(*[F.col(f"`{f.name}`") for f in fields], F.col(text_col).alias("__tidemark_text")), work, schema)


def without_toxic(docs: DataFrame, model: Model, most: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score under ``most``, all columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    readers: list[Reader] = []

    def keep(texts: list) -> list[bool]:
        if not readers:
            readers.append(sent.value.lexicon.reader())
        return (sent.value.score([features(t, readers[0]) for t in texts]) < most).tolist()

    return keep_rows(docs, text_col, keep)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
