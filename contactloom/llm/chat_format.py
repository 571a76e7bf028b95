r"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string.  It is
rendered on successive prefixes of a conversation; where an output extends the one
before it, the extension is the new turn's span.  An output that does not extend the
one before it shows a template that rewrites history.  A text's place inside its span
is found by rendering the turn with another text and comparing the outputs, for the
turns whose texts are wanted.  The cost is the sum of a conversation's prefixes.

The template here writes ``### role:`` and a line feed, the text, ``</turn>`` and a
line feed.  Inside texts a backslash becomes ``\\``, ``###`` becomes ``\h`` and
``</turn>`` becomes ``\e``; roles also escape the colon (``\c``) and the line feed
(``\n``).  So control strings occur only where the template writes them.

Conversations are gathered per id and ordered by turn, then role, then text; a
conversation is one output string and must fit a task.  Null texts and roles are
empty; rows that repeat are turns of their own; ids may have any type, and a null id is a
conversation of its own; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.shipping import ship

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]
_ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\e", ":": "\\c", "\n": "\\n"}
_BACK = {v[1]: k for k, v in _ESCAPES.items()}
_IN_TEXT = re.compile(r"\\|###|</turn>")
_IN_ROLE = re.compile(r"\\|###|</turn>|:|\n")
_TURN = re.compile(r"### ([^:\n]*):\n(.*?)</turn>\n", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    return (_IN_ROLE if role else _IN_TEXT).sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.DOTALL)


def template(turns: Turns) -> str:
    return "".join(f"### {escape(role, True)}:\n{escape(text)}</turn>\n" for role, text in turns)


def parse(formatted: str) -> Turns:
    """The turns that a formatted conversation shows."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _common(a: str, b: str, start: int = 0) -> int:
    """Length of the common prefix of two strings, known to agree up to ``start``."""
    low, high = start, min(len(a), len(b))
    step = 64
    while low < high and a[low : low + step] == b[low : low + step] and low + step <= high:
        low, step = low + step, step * 2
    high = min(high, low + step)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _place(turns: Turns, k: int, output: str, following: str, template: Template) -> tuple[int, int]:
    """Where the text of turn ``k`` stands in the output after it, by rendering the turn with other texts.

    A character that the output has nowhere is rendered in the text's place: the outputs
    part where the text starts, and what follows the character follows the text.  A
    template that does not treat it as a text of one character is asked with two plain texts.
    """
    head_of = [*turns[:k]]
    role = turns[k][0]
    known = len(output) if following.startswith(output) else 0
    mark = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in following)
    probe = template([*head_of, (role, mark)])
    head = _common(following, probe, known if probe.startswith(output) else 0)
    if probe[head : head + 1] == mark and following.endswith(probe[head + 1 :]) and len(following) >= len(probe) - 1:
        return head, len(following) - (len(probe) - head - 1)
    a, b = (template([*head_of, (role, text)]) for text in ("a", "b"))
    head = _common(a, b)
    tail = _common(a[: head : -1], b[: head : -1])
    return head, len(following) - tail


def render(turns: Turns, template: Template = template, wanted=lambda role: True) -> tuple[str, list[tuple[int, int]], list[tuple[int, int] | None], int | None]:
    """(output, turn spans, text spans, first turn at which history was rewritten or None); only texts of wanted roles are located."""
    output, spans, texts, rewritten = template([]), [], [], None
    for k, (role, _) in enumerate(turns):
        following = template(turns[: k + 1])
        if not following.startswith(output):
            rewritten = k if rewritten is None else rewritten
            start = _common(output, following)
        else:
            start = len(output)
        spans.append((start, len(following)))
        texts.append(_place(turns, k, output, following, template) if wanted(role) else None)
        output = following
    return output, spans, texts, rewritten


def formatted_row(turns: Turns, template: Template = template) -> dict:
    output, spans, texts, rewritten = render(turns, template, lambda role: role == "assistant")
    return {"formatted": output, "turn_spans": spans, "loss_spans": [t for t in texts if t is not None], "rewritten_at": rewritten}


_SCHEMA = (
    "formatted string, turn_spans array<struct<start: long, end: long>>, "
    "loss_spans array<struct<start: long, end: long>>, rewritten_at int"
)


def _format_batches(template: Template):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            rows = [
                formatted_row([(t["role"], t["text"]) for t in turns], template) for turns in batch.column("turns").to_pylist()
            ]
            pairs = lambda key: pa.array([[{"start": a, "end": b} for a, b in r[key]] for r in rows], spans)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    pa.array([r["formatted"] for r in rows], pa.string()),
                    pairs("turn_spans"),
                    pairs("loss_spans"),
                    pa.array([r["rewritten_at"] for r in rows], pa.int32()),
                ],
                ["conv_id", "formatted", "turn_spans", "loss_spans", "rewritten_at"],
            )

    return run


def format_conversations(conversations: DataFrame, template: Template = template) -> DataFrame:
    """One row per conversation: the formatted text, the spans of its turns and of the texts under the loss mask."""
    turns = conversations.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
        ).alias("turns")
    )
    return ship(turns).mapInArrow(_format_batches(template), f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {_SCHEMA}")


def _digest_batches(batches):
    for batch in batches:
        rows = []
        for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
            turns = parse(text)
            loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
            every = "".join(f"{role}\n{said}\n" for role, said in turns)
            rows.append((len(turns), _sha(every), len(loss), _sha(loss), len(text)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from formatted conversations and their loss spans."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(
        _digest_batches,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def query(spark, sf_dir):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    told = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(told).alias("text"),
    )
    return digests(format_conversations(conversations.unionByName(extra)))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e')) AS n,
         length(replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c'), chr(10), '\n')) AS m
  FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS l,
         sum(4 + m + 2 + n + 8)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256, formatted_chars FROM g
"""
