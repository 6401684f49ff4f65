"""The queries of this subpackage and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from tidemark.llm.chat import OP7_SQL, op7_chat
from tidemark.llm.decontaminate import op4_decontaminate
from tidemark.llm.line_dedup import OP2_SQL, op2_line_dedup
from tidemark.llm.mixing import OP5_SQL, op5_mixing
from tidemark.llm.near_dup import OP8_SQL, op8_near_dup
from tidemark.llm.pii import op1_pii
from tidemark.llm.quality import op10_quality
from tidemark.llm.secrets import op9_secrets
from tidemark.llm.tiff import op3_tiff
from tidemark.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_pii": op1_pii,
    "op2_line_dedup": op2_line_dedup,
    "op3_tiff": op3_tiff,
    "op4_decontaminate": op4_decontaminate,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_chat": op7_chat,
    "op8_near_dup": op8_near_dup,
    "op9_secrets": op9_secrets,
    "op10_quality": op10_quality,
}
ORACLE_SQL = {
    "op2_line_dedup": OP2_SQL,
    "op5_mixing": OP5_SQL,
    "op7_chat": OP7_SQL,
    "op8_near_dup": OP8_SQL,
}
