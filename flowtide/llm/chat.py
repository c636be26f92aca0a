"""Chat formatting: conversations through a compiled template, with a loss mask and an exact way back.

Turns are rows. A conversation is dealt to one task, sorted by turn, and streamed through the template as one rendering, so
a conversation of any length needs the memory of two turns. Ties in ``turn`` are ordered by role, then text (nulls first). Null
role or text is empty, rows with a null conv_id form one conversation with a null id, an empty table gives no rows, and
columns other than the four are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_template import Piece, Stream, compile_template
from .common import arrow_map, table

#: Turn marks of the default template; texts can't hold them unescaped.
OPEN, SEP, CLOSE = "<s>", "[INST]", "</s>"
#: Default template: <s>role[INST]text</s> for each turn; what an assistant says is marked for training.
TEMPLATE = (
    "{% for turn in turns %}" + OPEN + "{{ turn.role | escape }}" + SEP
    + "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}"
    + CLOSE + "{% endfor %}"
)
_SPECIAL = re.compile(r"[\\<\[]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_MARK = re.compile(r"\\.|<s>|\[INST\]|</s>", re.S)


def escape(text: str) -> str:
    """A backslash before each backslash and each character that could open a control string."""
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    """The inverse of :func:`escape`."""
    return _ESCAPED.sub(r"\1", text)


FILTERS = {"escape": escape}


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text written by the default template."""
    turns, start, role = [], 0, None
    for m in _MARK.finditer(formatted):
        if m[0] == OPEN:
            start, role = m.end(), None
        elif m[0] == SEP:
            role, start = formatted[start : m.start()], m.end()
        elif m[0] == CLOSE:
            if role is None:
                raise ValueError("a turn has no separator")
            turns.append((unescape(role), unescape(formatted[start : m.start()])))
    return turns


FIELDS = ("role", "text")
#: Turns and characters that a task gives out at once.
FLUSH_TURNS, FLUSH_CHARS = 1000, 1 << 22


def renderer(template: str, values: dict[str, str] | None = None) -> Callable[[dict], Iterator[Piece]]:
    """The compiled template; it may read the turns, in one loop, and the named values."""
    return compile_template(template, FILTERS, {"turns": None, **dict.fromkeys(values or {}, ())}, {"turns": FIELDS}, "turns")


def format_turns(turns: list[dict], template: str = TEMPLATE, values: dict[str, str] | None = None) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (code points) under the loss mask."""
    out, spans, at = [], [], 0
    for text, inside in renderer(template, values)({**(values or {}), "turns": turns}):
        if inside and text:
            spans.append((at, at + len(text)))
        out.append(text)
        at += len(text)
    return "".join(out), spans


_TURN = "conv_id long, turn_no long, role string, formatted string, spans array<struct<start:long,end:long>>"


def rendered_turns(rows: Iterator[tuple], render: Callable[[dict], Iterator[Piece]], values: dict[str, str]) -> Iterator[tuple]:
    """(conv, number, role, formatted, spans) of each row (conv, role, text); a conversation's rows stand together, in order.

    A conversation is one rendering, so loop state, and text before and after the loop, come out as the template says: what stands
    before the first turn goes to it, what stands after the last one to that. A turn and the next one are held.
    """
    head = next(rows, None)
    while head is not None:
        conv, roles = head[0], deque()

        def turns(conv: int | None = conv, roles: deque = roles) -> Iterator[dict]:
            nonlocal head
            while head is not None and head[0] == conv:
                now, head = head, next(rows, None)
                roles.append(now[1])
                yield {"role": now[1] or "", "text": now[2] or ""}

        number, pieces, spans, at = -1, [], [], 0
        for piece, inside in render({**values, "turns": Stream(turns())}):
            if inside is None:
                if number >= 0:
                    yield conv, number, roles.popleft(), "".join(pieces), spans
                    pieces, spans, at = [], [], 0
                number += 1
                continue
            if inside and piece:
                spans.append({"start": at, "end": at + len(piece)})
            pieces.append(piece)
            at += len(piece)
        if number >= 0:
            yield conv, number, roles.popleft(), "".join(pieces), spans
        while head is not None and head[0] == conv:  # a template whose loop lies in a branch that wasn't taken
            head = next(rows, None)


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, values: dict[str, str] | None = None) -> DataFrame:
    """Each turn as the template writes it: conv_id, turn_no (0-based), role, formatted, spans.

    The formatted conversation is the concatenation over turn_no; ``spans`` are the turn's loss-mask spans, in code points of
    ``formatted``. The template loops over ``turns`` once and may read ``values`` by name; other names are refused.
    """
    values = values or {}
    renderer(template, values)  # refuses here what it would refuse in the tasks
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    ).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))

    def flushed(made: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*made, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, kinds, strict=True)], ["conv_id", "turn_no", "role", "formatted", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True))
        made: list[tuple] = []
        chars = 0
        for turn in rendered_turns(given, renderer(template, values), values):
            made.append(turn)
            chars += len(turn[3])
            if len(made) >= FLUSH_TURNS or chars >= FLUSH_CHARS:
                yield flushed(made)
                made, chars = [], 0
        yield flushed(made)

    return arrow_map(rows, run, _TURN)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """Read formatted turns back and digest each conversation; keeps hash states only, however long a conversation is.

    Expects the partitioning and order that :func:`format_conversations` leaves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        done: list[tuple] = []

        def close() -> None:
            if state:
                conv, n, turns, chars, loss, size = state
                done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def flush() -> pa.RecordBatch:
            c = list(zip(*done, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            rows = zip(batch["conv_id"].to_pylist(), batch["turn_no"].to_pylist(), batch["formatted"].to_pylist(), batch["spans"].to_pylist(), strict=True)
            for conv, part in groupby(rows, key=lambda r: r[0]):
                for _, number, text, spans in part:
                    if number == 0:
                        close()
                        state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for role, said in read_turns(text):
                        state[1] += 1
                        state[2].update(f"{role}\n{said}\n".encode())
                    for s in spans:
                        learned = unescape(text[s["start"] : s["end"]])
                        state[3] += len(learned)
                        state[4].update(learned.encode())
                    state[5] += len(text)
            yield flush()
            done.clear()
        close()
        yield flush()

    return arrow_map(formatted, run, _DIGEST)


#: Rows that op1 adds: texts made of control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op1_chat_format: digests of all conversations and of the probe, read back from the formatted text."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return digest_formatted(format_conversations(rows.unionByName(probe)))


_SIZE = lambda c: f"2 * length({c}) - length(regexp_replace({c}, '[\\\\<\\[]', '', 'g'))"  # noqa: E731  length after escape
_ORDER = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"
#: DuckDB SQL of op1: what must come back from the formatted text, and how long that is.
ORACLE = f"""WITH given AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations
  UNION ALL SELECT * FROM (VALUES {", ".join(map(str, PROBE))}) AS p(conv_id, turn, role, text)),
said AS (SELECT conv_id, turn, role, text, coalesce(role, '') AS who, coalesce(text, '') AS words FROM given)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(who || chr(10) || words || chr(10), '' {_ORDER})) AS turns_sha256,
  CAST(coalesce(sum(length(words)) FILTER (WHERE who = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(words, '' {_ORDER}) FILTER (WHERE who = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN + SEP + CLOSE)} + {_SIZE("who")} + {_SIZE("words")}) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id"""
