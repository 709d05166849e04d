r"""Chat formatting with a grammar round trip.

A conversation is rendered as turns without anything between them:

    user       [INST] text [/INST]
    assistant  <s>text</s>
    system     <<SYS>>text<</SYS>>
    others     [ROLE:name]text[/ROLE]

``parse`` is a deterministic parser of that grammar: a backslash makes the next character literal, and a
body ends at its own closing mark; any other control string inside it is an error. A turn is rendered as it
is, parsed again and compared; while the parser fails or finds another turn, its text is escaped further
(1: a backslash before control strings and backslashes; 2: before every ``[``, ``<`` and backslash).
At last the whole conversation is parsed and must be the source's turns.

The loss mask is a list of (start, end) code-point spans of the formatted text, one for each assistant text.

Rows are dealt out by conv_id and sorted by turn; a task reads them as a stream and holds the turns of one
conversation at a time. Defined results: a null text or role is an empty one; rows without conv_id are one
conversation; turns that tie are ordered by role and text, null turns come first; repeated rows are turns of
their own; an empty table gives no rows; columns other than conv_id, turn, role and text aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE:", "[/ROLE]")
CONTROL = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE:", "[/ROLE]")
_CONTROL = "|".join(map(re.escape, CONTROL))
_ESCAPES = (re.compile(rf"\\|{_CONTROL}"), re.compile(r"[\\\[<]"))
_TOKEN = re.compile(rf"\\(.)|( \[/INST\]|{_CONTROL})|(\\)", re.S)
_NAME = re.compile(r"\\(.)|(\])", re.S)


class Conflict(ValueError):
    """The text isn't what the grammar renders."""


def _body(s: str, at: int, close: str) -> tuple[str, int, int]:
    """Unescaped body from `at`, where it ends, and where its closing mark ends."""
    out, begin = [], at
    while m := _TOKEN.search(s, at):
        out.append(s[begin : m.start()])
        if m[1] is not None:
            out.append(m[1])
        elif m[2] == close:
            return "".join(out), m.start(), m.end()
        else:
            raise Conflict(f"{m[0]!r} at {m.start()}")
        begin = at = m.end()
    raise Conflict(f"{close} is missing")


def parse(s: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of each turn."""
    turns, at = [], 0
    while at < len(s):
        role = next((r for r, (open_, _) in MARKS.items() if s.startswith(open_, at)), None)
        if role is not None:
            at, close = at + len(MARKS[role][0]), MARKS[role][1]
        elif s.startswith(OTHER[0], at):
            name, at, close = [], at + len(OTHER[0]), OTHER[1]
            while True:
                if not (m := _NAME.search(s, at)):
                    raise Conflict("a role without end")
                name.append(s[at : m.start()] + (m[1] or ""))
                at = m.end()
                if m[2]:
                    break
            role = "".join(name)
        else:
            raise Conflict(f"no turn begins at {at}")
        text, end, after = _body(s, at, close)
        turns.append((role, text, at, end))
        at = after
    return turns


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn, escaped as little as the parser needs, and the span of its text within it."""
    open_, close = MARKS.get(role) or (OTHER[0] + re.sub(r"([\\\]])", r"\\\1", role) + "]", OTHER[1])
    for level in range(3):
        body = _ESCAPES[level - 1].sub(lambda m: "\\" + m[0], text) if level else text
        out = open_ + body + close
        try:
            if [t[:2] for t in parse(out)] == [(role, text)]:
                return out, len(open_), len(open_) + len(body)
        except Conflict:
            pass
    raise Conflict(f"no escape recovers {text[:50]!r}")


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        out, a, b = render_turn(role, text)
        parts.append(out)
        if role == "assistant":
            mask.append((at + a, at + b))
        at += len(out)
    whole = "".join(parts)
    if [t[:2] for t in parse(whole)] != turns:
        raise Conflict("the conversation isn't recovered")
    return whole, mask


def masked(formatted: str, mask: list[tuple[int, int]]) -> list[str]:
    """The unescaped texts under a loss mask."""
    return [re.sub(r"\\(.)", r"\1", formatted[a:b], flags=re.S) for a, b in mask]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    now: int | None = None
    turns: list[tuple[str, str]] = []
    for b in batches:
        for c, r, t in zip(b["conv_id"].to_pylist(), b["role"].to_pylist(), b["text"].to_pylist(), strict=True):
            if turns and c != now:
                yield now, turns
                turns = []
            now = c
            turns.append((r or "", t or ""))
    if turns:
        yield now, turns


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted and loss_mask of each conversation of (conv_id, turn, role, text)."""
    dealt = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        for conv, turns in _conversations(batches):
            whole, mask = render(turns)
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "n_turns": [len(turns)], "formatted": [whole], "loss_mask": pa.array([[{"start": a, "end": b} for a, b in mask]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    return dealt.mapInArrow(run, "conv_id bigint, n_turns bigint, formatted string, loss_mask array<struct<start:bigint,end:bigint>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text and its loss mask hold, read back with the parser."""

    def run(batches):
        for b in batches:
            out = []
            for conv, s, mask in zip(b["conv_id"].to_pylist(), b["formatted"].to_pylist(), b["loss_mask"].to_pylist(), strict=True):
                turns = parse(s)
                loss = "".join(masked(s, [(m["start"], m["end"]) for m in mask]))
                said = "".join(f"{r}\n{t}\n" for r, t, *_ in turns)
                out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(s)))
            names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    both = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return digests(format_conversations(rows.unionByName(both)))


ORACLES = {
    "op1_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT *, length(regexp_replace(text, '(\\|\[INST\]|\[/INST\]|<s>|</s>|<<SYS>>|<</SYS>>|\[ROLE:|\[/ROLE\])', '\\\1', 'g'))
         + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 14 + length(regexp_replace(role, '([\\\]])', '\\\1', 'g')) END AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
}
QUERIES = {"op1_chat_format": op1_chat_format}
