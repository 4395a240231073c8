"""The queries of this subpackage, with production parameters over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, fingerprint, html_text, language, pieces, pii, simhash, token_counts, token_files
from .common import table

BYTE_BPE, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file on this machine; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": lambda s, d: pii.op1(table(s, d, "documents")),
    "op2_fingerprint": lambda s, d: fingerprint.op2(table(s, d, "documents")),
    "op3_token_files": lambda s, d: token_files.op3(table(s, d, "documents"), tokenizer_path(BYTE_BPE)),
    "op4_html_text": lambda s, d: html_text.op4(table(s, d, "pages")),
    "op5_language": lambda s, d: language.op5(table(s, d, "documents")),
    "op6_simhash": lambda s, d: simhash.op6(table(s, d, "documents")),
    "op7_token_counts": lambda s, d: token_counts.op7(table(s, d, "documents"), tokenizer_path(BYTE_BPE)),
    "op8_pieces": lambda s, d: pieces.op8(table(s, d, "documents"), tokenizer_path(PIECE_MODEL)),
    "op9_chat": lambda s, d: chat.op9(table(s, d, "conversations")),
    "op10_decontaminate": lambda s, d: decontaminate.op10(table(s, d, "documents"), table(s, d, "benchmark")),
}

_FINGERPRINT = """
    sha256(array_to_string(list_transform(string_split({t}, '#'), lambda s: sha256(array_to_string(list_transform(string_split(s, ';'), lambda p: sha256(p)), ''))), '')) || '#' || {t}"""
_TREE = """regexp_replace(array_to_string(list_transform(
        list_transform(string_split(regexp_replace({x}, '([.!?;:,][ \\t]+)', '\\1' || chr(1), 'g'), chr(10)),
            lambda line: array_to_string(list_transform(string_split(line, chr(1)), lambda clause: left(base64(unhex(left(sha256(clause), 32))), 22)), ',')),
        lambda leaf: leaf || CASE WHEN left(sha256(leaf), 1) IN ('0', '1', '2', '3') THEN '#' ELSE ';' END), ''), '[;#]$', '')"""


def _opened(branches: str, mark: str) -> str:
    return f"flatten(list_transform({branches}, lambda x: string_split(x, '{mark}')))"


def _without(x: str, y: str) -> str:
    return f"list_filter(list_distinct({x}), lambda e: NOT list_contains({y}, e))"


def _within(x: str, y: str) -> str:
    return f"list_filter(list_distinct({x}), lambda e: list_contains({y}, e))"


def _clauses(branches: str) -> str:
    return f"coalesce(list_sum(list_transform({branches}, lambda x: (length(x) + 1) // 23)), 0)"


def _common(x: str, y: str) -> str:
    return f"coalesce(list_position(list_transform(list_zip({x}, {y}), lambda z: coalesce(z[1] = z[2], false)), false) - 1, greatest(len({x}), len({y})))"


def _compared(source: str, step: str, a: str, b: str) -> str:
    """DuckDB CTEs that descend the trees a and b of source, as compared() does: {step}4 has its rows with shared and only_one."""
    return f"""{step}1 AS (SELECT *, string_split({a}, '#') AS sa, string_split({b}, '#') AS sb FROM {source}),
{step}2 AS (SELECT *, {_within("sa", "sb")} AS same, list_distinct({_opened(_without("sa", "sb"), ";")}) AS pa, list_distinct({_opened(_without("sb", "sa"), ";")}) AS pb FROM {step}1),
{step}3 AS (SELECT *, {_within("pa", "pb")} AS alike, list_distinct({_opened(_without("pa", "pb"), ",")}) AS la, list_distinct({_opened(_without("pb", "pa"), ",")}) AS lb FROM {step}2),
{step}4 AS (SELECT *, len({_within("la", "lb")}) AS both_n FROM {step}3),
{step}5 AS (SELECT *, {_clauses("same")} + {_clauses("alike")} + both_n AS shared, len(la) + len(lb) - 2 * both_n AS only_one FROM {step}4)"""


def _escape(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for control in chat.CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


ORACLE_SQL: dict[str, str] = {
    "op2_fingerprint": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next FROM d),
e AS (SELECT *, left(text, length(text) - length(text) // 2) || left(next, length(text) // 2) AS edited FROM n),
t AS (SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, {_TREE.format(x="text")} AS a, {_TREE.format(x="edited")} AS b, {_TREE.format(x="next")} AS c FROM e),
{_compared("t", "e", "a", "b")},
g1 AS (SELECT *, {_common("sa", "sb")} AS front FROM e5),
g2 AS (SELECT *, least({_common("list_reverse(sa)", "list_reverse(sb)")}, least(len(sa), len(sb)) - front) AS back FROM g1),
g3 AS (SELECT *, {_opened("sa[front + 1:len(sa) - back]", ";")} AS ma, {_opened("sb[front + 1:len(sb) - back]", ";")} AS mb, coalesce(len({_opened("sa[1:front]", ";")}), 0) AS base FROM g2),
g4 AS (SELECT *, {_common("ma", "mb")} AS first FROM g3),
g5 AS (SELECT *, least({_common("list_reverse(ma)", "list_reverse(mb)")}, least(len(ma), len(mb)) - first) AS last FROM g4),
h AS (SELECT doc_id, n_chars, edited_sha256, {_FINGERPRINT.format(t="a")} AS fingerprint, {_FINGERPRINT.format(t="b")} AS edited_fingerprint, CASE WHEN a = b THEN 1.0::DOUBLE ELSE shared::DOUBLE / (shared + only_one) END AS near_edited,
    CASE WHEN a <> b THEN (base + first)::BIGINT END AS edit_first, (len(ma) - first - last)::BIGINT AS edit_removed, (len(mb) - first - last)::BIGINT AS edit_added, a, c FROM g5),
{_compared("h", "n", "a", "c")}
SELECT doc_id, n_chars::BIGINT AS n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, CASE WHEN a = c THEN 1.0::DOUBLE ELSE shared::DOUBLE / (shared + only_one) END AS near_next, edit_first, edit_removed, edit_added
FROM n5""",
    "op9_chat": f"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]', NULL), (-1, 1, 'assistant', '</s>[INST] ok [/INST]', NULL)
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length('<|im_start|>' || {_escape("role")} || chr(10) || {_escape("text")} || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars,
    false AS rewrites_history
FROM c GROUP BY conv_id, own""",
}
