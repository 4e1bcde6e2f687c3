"""Queries of this subpackage and their SQL, for __spark_entry__."""

from __future__ import annotations

from . import bm25, chat, decontaminate, line_dedup, neardup, packing, quality, rans, secrets, suffix
from .common import table


def queries() -> dict:
    return {
        "op1_suffix_dedup": lambda s, d: suffix.repeated_passages(table(s, d, "documents")),
        "op2_near_dedup": lambda s, d: neardup.near_copies(table(s, d, "documents")),
        "op3_quality": lambda s, d: quality.scores(table(s, d, "documents"), table(s, d, "labels")),
        "op4_decontaminate": lambda s, d: decontaminate.contaminated(table(s, d, "documents"), table(s, d, "benchmark")),
        "op5_packing": lambda s, d: packing.pack(table(s, d, "documents")),
        "op6_chat_format": lambda s, d: chat.format_chats(table(s, d, "conversations")),
        "chat_events_folded": lambda s, d: chat.format_chats(chat.streamed(table(s, d, "conversations"))),
        "op7_top_k": lambda s, d: bm25.top_k(table(s, d, "documents"), table(s, d, "benchmark")),
        "op8_secret_scan": lambda s, d: secrets.secret_scan(table(s, d, "documents")),
        "op9_token_blocks": lambda s, d: rans.token_blocks(table(s, d, "documents")),
        "op10_line_dedup": lambda s, d: line_dedup.line_dedup(table(s, d, "documents")),
    }


LINE_SQL = """
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
kept AS (SELECT *, CASE WHEN regexp_full_match(line, '[ \\t\\n\\r\\f\\v]*') THEN 1 ELSE row_number() OVER (PARTITION BY line ORDER BY doc_id, k) END AS rn FROM lines),
texts AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (rn = 1), '') AS cut, CAST(count(*) FILTER (rn > 1) AS INTEGER) AS n_removed FROM kept GROUP BY doc_id)
SELECT d.doc_id, t.cut AS text, d.lang, d.source, d.n_chars, t.n_removed FROM documents d JOIN texts t USING (doc_id)
"""


def oracle_sql() -> dict:
    return {"op7_top_k": bm25.SQL, "op6_chat_format": chat.SQL, "chat_events_folded": chat.EVENTS_SQL, "op8_secret_scan": secrets.SQL, "op10_line_dedup": LINE_SQL}
