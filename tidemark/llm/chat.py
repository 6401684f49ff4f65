"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, its reply
the only part under the loss mask. A conversation that does not end with an assistant turn
gives one more example without a target, so that the output holds every turn.

The template writes a turn as ``<|turn|>role<|text|>text<|end|>`` and a line end. Control
strings inside texts (its own and those of common chat templates) get a backslash after their
first character, and each backslash of the text is doubled; that is undone without loss.

Turns go in order of (turn, role, text), nulls first; a null role or text is empty. A row whose
conversation is null belongs to no other row: it is a conversation of its own.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_slices, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Control strings of public chat templates.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>")
CONTROL = re.compile("|".join(map(re.escape, (TURN, TEXT, END, *FOREIGN))))
WRITTEN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END) + "\n", re.S)
TARGET = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def examples(turns: list[tuple[str, str]]):
    """(number of turns, text, loss start, loss end) of each example; the mask is empty without a target."""
    text = ""
    for n, (role, said) in enumerate(turns, 1):
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(said)
        start = len(text) + len(head)
        text += f"{head}{body}{END}\n"
        if role == TARGET:
            yield n, text, start, start + len(body)
        elif n == len(turns):
            yield n, text, start, start


def read_turns(text: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in WRITTEN.finditer(text)]


def conversations(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id()).alias("__tidemark_alone")
    return turns.select(F.col(conv_col).alias("conv_id"), alone, row.alias("row")).groupBy("conv_id", "__tidemark_alone").agg(F.array_sort(F.collect_list("row")).alias("turns")).drop("__tidemark_alone")


def chat_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text, loss_start, loss_end): one row for each example."""

    def work(c: dict[str, list]) -> dict[str, list]:
        rows = [(k, *e) for k, ts in zip(c["conv_id"], c["turns"], strict=True) for e in examples([(t["role"], t["text"]) for t in ts])]
        return {n: [r[i] for r in rows] for i, n in enumerate(("conv_id", "n_turns", "text", "loss_start", "loss_end"))}

    kind = turns.schema["conv_id"].dataType.simpleString()
    return map_slices(conversations(turns), work, f"conv_id {kind}, n_turns long, text string, loss_start long, loss_end long")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from the examples of each conversation."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, TARGET, said)], "conv_id long, turn long, role string, text string")
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")

    def work(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples")}
        for conv, rows in zip(c["conv_id"], c["turns"], strict=True):
            loss, chars, formatted, n, last = hashlib.sha256(), 0, 0, 0, ""
            for _, text, start, end in examples([(t["role"], t["text"]) for t in rows]):
                target = unescape(text[start:end])
                loss.update(target.encode())
                chars += len(target)
                formatted += len(text)
                n, last = n + 1, text
            turns = read_turns(last)
            whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            for name, value in zip(out, (conv, len(turns), whole, chars, loss.hexdigest(), formatted, n), strict=True):
                out[name].append(value)
        return out

    return map_slices(conversations(own.unionByName(extra)), work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")


_ESCAPED = r"regexp_replace(replace({0}, '\', '\\'), '(<)(\|turn\|>|\|text\|>|\|end\|>|s>|/s>|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|eot_id\|>)|(\[)(INST\]|/INST\])', '\1\3\\\2\4', 'g')"
OP7_SQL = rf"""
WITH t AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'),
 s AS (SELECT *, length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + 24 AS chars,
              row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text) AS n, count(*) OVER (PARTITION BY conv_id, alone) AS of FROM t),
 p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id, alone ORDER BY n) AS upto FROM s)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || E'\n' || text || E'\n', '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR n = of THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars,
       CAST(sum(CASE WHEN role = 'assistant' OR n = of THEN 1 ELSE 0 END) AS BIGINT) AS n_examples
FROM p GROUP BY conv_id, alone
"""
