"""Personal data: plain patterns as seeds, contextual patterns found by bootstrapping.

1. Base spans: e-mail, ip, card and phone, each leftmost without overlaps, checked after.
2. Candidates: blank-separated tokens that hold the start of a base span (these are seeds, and
   the span is their value), or meet no base span and have ``MIN_DIGITS`` digits or an ``@`` between other signs. The word before
   is the context, also at the start of a line; the first token of a text has none.
3. Patterns: a context with a token shape (letters run together, digits counted), and a context
   with a class (with ``@`` or without). A value is in a context's two patterns.
4. The graph of patterns and values (each different value once) is scored in rounds. A value
   tells a pattern 1 if it is a seed, else the noisy-or of the confidences of the good patterns
   of its *other* contexts: no pattern supports itself. A pattern's confidence is the mean of
   what its values tell, with one unknown more; it is good from ``MIN_CONFIDENCE`` on, if
   ``MIN_SEEDS`` of its values tell as much. Values of good patterns so become support for further
   ones; rounds go on until no pattern becomes good.
5. Good patterns discover the candidates that they introduce and that are no seeds: kind ``context``.

All of it is SQL functions: no Python runs on executors. Texts are read once, in full; what
they give goes to a table of spans in the shared folder. Nulls: a null text is empty. Rows are
told apart by position, so that repeated ids or rows keep results of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table
from tidemark.operators.skew import join_frequent

KINDS = ("email", "ip", "card", "phone", "context")
# Fixed values of the base patterns, written so that they match the same and never go back:
# possessive repeats; no start inside of a run, unless the last match ended there.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?+[0-9]){11,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: The word before (1), the blanks (2) and the candidate (3); only the word is consumed.
CANDIDATE = r"(?<!\S)(\S++)(?=(\s++)(\S*?[0-9@]\S*))"
EDGES = "\"'()[]{}<>.,;:!?|"

#: What a pattern needs to discover; digits that make an identifier.
MIN_CONFIDENCE, MIN_SEEDS, MIN_DIGITS = 0.6, 3, 5
#: Good patterns are broadcast up to so many (some 60 bytes each).
BROADCAST_PATTERNS = 200_000


def _matches(text: Column, pattern: str, groups: tuple[int, ...] = (0,)) -> tuple[Column, ...]:
    """The texts between the matches, then what each group matched."""
    return F.split(text, pattern, -1), *[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _starts(gaps: str, hits: str) -> str:
    """SQL: where the matches start. Lengths are summed over runs as long as the root of their
    number first, so that n matches cost n times that root."""
    total = "aggregate(slice({}, {}, {}), 0, (a, y) -> a + y)"
    run = "cast(i div x.step AS int)"
    at = f"transform(w.h, (h, i) -> heads[{run}] + {total.format('x.b', run + ' * x.step + 1', 'i % x.step')} + length(w.g[i]))"
    sums = f"transform(sequence(0, cast((size(x.b) - 1) div x.step AS int)), k -> {total.format('x.b', 'k * x.step + 1', 'x.step')})"
    both = "named_struct('b', transform(w.h, (h, i) -> length(w.g[i]) + length(h)), 'step', cast(ceil(sqrt(size(w.h))) AS int))"
    found = _let(both, "x", _let(sums, "s", _let(f"transform(s, (y, k) -> {total.format('s', '1', 'k')})", "heads", at)))
    return f"if(size({hits}) = 0, cast(array() AS array<int>), {_let(f"named_struct('g', {gaps}, 'h', {hits})", 'w', found)})"


def _located(gaps: str, hits: str, kind: int) -> str:
    spans = f"transform({hits}, (h, i) -> struct(at[i] AS start, {kind} AS kind, at[i] + length(h) AS end, h AS value))"
    return _let(_starts(gaps, hits), "at", spans)


_DIGITS = r"regexp_replace(x.value, '[^0-9]', '')"
_VALID = (
    "true",
    f"x.value rlike '^{BYTE}[.]{BYTE}[.]{BYTE}[.]{BYTE}$'",
    f"length({_DIGITS}) between 12 and 19 and luhn_check({_DIGITS})",
    f"length({_DIGITS}) between 9 and 15",
)
_POSSIBLE = ("contains(text, '@')", r"text rlike '[0-9][.][0-9]+[.][0-9]'", "text rlike '[0-9](?:[ -]?+[0-9]){11}'", "contains(text, '+')")


def spans_and_candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, base, candidates) of each row; spans are (start, kind number, end, value)."""
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    for k, (pattern, possible) in enumerate(zip((EMAIL, IP, CARD, PHONE), _POSSIBLE, strict=True)):
        gaps, hits = _matches(F.col("text"), pattern)
        df = df.withColumn(f"hits{k}", F.when(F.expr(possible), hits).otherwise(none)).withColumn(f"gaps{k}", F.when(F.size(f"hits{k}") > 0, gaps).otherwise(none))
    base = F.concat(*[F.expr(f"filter({_located(f'gaps{k}', f'hits{k}', k)}, x -> {_VALID[k]})") for k in range(4)])
    gaps, words, blanks, values = _matches(F.col("text"), CANDIDATE, (1, 2, 3))
    may = F.expr(r"text rlike '\\s[^\\s]*?[0-9@]'")
    df = df.withColumn("base", F.array_sort(base))
    for name, column in (("words", words), ("blanks", blanks), ("values", values), ("between", gaps)):
        df = df.withColumn(name, F.when(may, column).otherwise(none))
    trim = "'" + EDGES.replace("'", "\\'") + "'"
    raw = f"""
        transform(values, (v, i) -> struct(
            at[i] + length(words[i]) + length(blanks[i]) + length(v) - length(ltrim({trim}, v)) AS start,
            trim(BOTH {trim} FROM v) AS value, lower(words[i]) AS before))"""
    df = df.withColumn("raw", F.expr(_let(_starts("between", "words"), "at", raw)))
    # base spans in runs as long as the root of their number: only runs that a token meets are looked through
    runs = """transform(sequence(0, cast((size(b) - 1) div step AS int)), k -> struct(
        k * step + 1 AS at, b[k * step].start AS low, array_max(transform(slice(b, k * step + 1, step), y -> y.end)) AS high))"""
    of_run = "filter(slice(b, r.at, step), y -> y.start < x.start + length(x.value) and y.end > x.start)"
    met = f"flatten(transform(filter(runs, r -> r.low < x.start + length(x.value) and r.high > x.start), r -> {of_run}))"
    token = "struct(x.start AS start, x.start + length(x.value) AS end, x.value AS value, x.before AS before, {0} AS met)"
    with_runs = _let("base", "b", _let("cast(ceil(sqrt(size(b))) AS int)", "step", _let(runs, "runs", f"transform(raw, x -> {token.format(met)})")))
    without = f"transform(raw, x -> {token.format('slice(base, 1, 0)')})"
    df = df.withColumn("tokens", F.expr(f"if(size(base) = 0, {without}, {with_runs})"))
    # a seed is known by the span that starts in the token, which may go on behind it
    named = "transform(tokens, x -> struct(x.start AS start, x.end AS end, x.before AS before, size(x.met) AS met, exists(x.met, y -> y.start >= x.start) AS seed, if(exists(x.met, y -> y.start >= x.start), element_at(filter(x.met, y -> y.start >= x.start), 1).value, x.value) AS value))"
    df = df.withColumn("named", F.expr(named))
    df = df.withColumn("candidates", F.expr(rf"""
        transform(filter(named, x -> x.seed or x.met = 0 and (x.value rlike '(?:[0-9][^0-9]*+){{{MIN_DIGITS}}}' or x.value rlike '[^@]@[^@]')), x -> struct(
            x.start AS start, x.end AS end, x.value AS value, md5(x.value) AS name, x.seed AS seed, md5(x.before) AS context,
            md5(concat_ws(' ', x.before, 'shape', regexp_replace(regexp_replace(x.value, '[0-9]', '9'), '\\p{{L}}+', 'a'))) AS shape,
            md5(concat_ws(' ', x.before, 'class', if(contains(x.value, '@'), '@', '#'))) AS class))"""))
    return df.select("row", "id", "base", "candidates")


def good_patterns(found: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(pattern, confidence, n): the good patterns over the graph of ``found``'s candidates."""
    edges = found.select(F.explode("candidates").alias("c")).groupBy("c.name", "c.context").agg(F.first("c.shape").alias("shape"), F.first("c.class").alias("class"))
    seeds = found.select(F.explode("candidates").alias("c")).where("c.seed").groupBy("c.name").agg(F.lit(True).alias("seed"))
    # a value that is a seed anywhere is one everywhere
    edges = cut(edges.join(seeds, "name", "left").withColumn("seed", F.col("seed").isNotNull()))
    total, told, known = edges.count(), edges.withColumn("tells", F.col("seed").cast("double")), 0
    while True:
        each = told.select(F.explode(F.array("shape", "class")).alias("pattern"), "tells")
        sums = each.groupBy("pattern").agg((F.sum("tells") / (F.count("*") + 1)).alias("confidence"), F.count_if(F.col("tells") >= min_confidence).alias("support"), F.count("*").alias("n"))
        good = cut(sums.where((F.col("confidence") >= min_confidence) & (F.col("support") >= min_seeds)).select("pattern", "confidence", "n"))
        count = good.count()
        if count == known:
            return good
        known = count
        both = edges.select("name", "context", "seed", F.explode(F.array("shape", "class")).alias("pattern"))
        lit = F.broadcast(good) if count <= BROADCAST_PATTERNS else None
        both = both.join(lit, "pattern") if lit is not None else join_frequent(both, good, ["pattern"], 2 * total)
        # of one context's two patterns, the surer
        rated = cut(both.where("not seed").groupBy("name", "context").agg(F.max("confidence").alias("rate")))
        values = cut(rated.groupBy("name").agg(F.sum(F.log1p(-F.col("rate"))).alias("all"), F.count("*").alias("n")))
        unseen = edges.where("not seed").select("name", "context", "shape", "class")
        # the number of a value's rated contexts says how often it is met among the rated, not all
        uses = unseen.join(values.select("name"), "name", "left_semi").groupBy("name").agg(F.count("*").alias("uses"))
        heard = join_frequent(unseen, cut(values.drop("n").join(uses, "name")), ["name"], total, "uses").join(rated, ["name", "context"], "left")
        heard = cut(heard.select("name", "context", (1 - F.exp(F.col("all") - F.coalesce(F.log1p(-F.col("rate")), F.lit(0.0)))).alias("hears")))
        told = edges.join(heard, ["name", "context"], "left").withColumn("tells", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("hears", F.lit(0.0))))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(row, id, base, extra): spans of each row; ``extra`` are those that contexts discovered."""
    found = cut(spans_and_candidates(docs, id_col, text_col))
    good = good_patterns(found, min_confidence, min_seeds)
    new = found.select("row", F.explode(F.filter("candidates", lambda c: ~c["seed"])).alias("c"))
    new = new.select("row", "c.start", "c.end", "c.value", F.explode(F.array("c.shape", "c.class")).alias("pattern"))
    if good.count() <= BROADCAST_PATTERNS:
        new = new.join(F.broadcast(good.select("pattern")), "pattern")
    else:
        uses = cut(new.groupBy("pattern").agg(F.count("*").alias("uses")))
        total = uses.agg(F.sum("uses")).first()[0] or 0
        new = join_frequent(new, good.select("pattern").join(uses, "pattern"), ["pattern"], total, "uses")
    extra = new.groupBy("row").agg(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end", "value")).alias("extra"))
    return found.drop("candidates").join(extra, "row", "left")


def _told(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"concat_ws(',', transform(array_sort({spans}), s -> concat({names}[s.kind], ':', s.start, ':', s.end)))")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)").alias(f"n_{KINDS[k]}") for k in range(4)]
    found = found.withColumn("spans", F.expr("concat(base, coalesce(extra, array()))"))
    return found.select(
        F.col("id").cast("long").alias("doc_id"), *counts, F.coalesce(F.size("extra"), F.lit(0)).cast("long").alias("n_context"), F.sha2(_told("base"), 256).alias("base_sha256"), _told("spans").alias("spans")
    )
