"""Chat formatting by prefix-target expansion.

Method: every assistant turn becomes an example of its own. All turns before it are context; only that reply is trainable. Turns
after the last reply (or a conversation without one) form a closing example with nothing trainable, so no turn is lost.

Template: <|im_start|>role, a line feed, the text, <|im_end|>, a line feed. In texts and roles the marks cannot occur: in every
"<", backslashes, "|" one backslash is added, which unescaping takes away. In roles, line feeds are written as backslash n.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barwright.llm.common import batch_of, map_arrow

START, END = "<|im_start|>", "<|im_end|>\n"
_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
# Characters of examples sent on together.
BLOCK = 4_000_000
EXAMPLE = "conv_id bigint, example int, formatted string, loss_start bigint, loss_end bigint, is_last boolean"


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted example."""
    turns = []
    for block in formatted.split(END)[:-1]:
        role, _, text = block[len(START):].partition("\n")
        turns.append((unescape_role(role), unescape(text)))
    return turns


def expand(df: DataFrame) -> DataFrame:
    """Examples (conv_id, example from 0, formatted, loss_start, loss_end in code points, is_last) of conversations.

    Input columns conv_id, turn, role, text; others are not read. Turns are ordered by turn, then role, then text; null turns come
    first, repeated rows stay. Null texts and roles are empty. Rows without conv_id are one conversation. The rows of a
    conversation stream through one task in order; what is held is the context of the present example, itself one value of the output.
    A closing example has loss_start = loss_end = its length.
    """
    rows = df.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    names = [part.split()[0] for part in EXAMPLE.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        waiting = None                      # the newest example, until it is known whether it is the last
        started, conv, context, number, closed = False, None, "", 0, True

        def finished() -> list[tuple]:
            """What ends a conversation: its last example, or a closing one where turns follow it."""
            last = [] if waiting is None else [waiting + (closed,)]
            return last if closed else last + [(conv, number, context, len(context), len(context), True)]

        for batch in batches:
            for key, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if started and key != conv:
                    out += finished()
                    waiting, context, number = None, "", 0
                started, conv = True, key
                head = context + START + escape_role(role) + "\n"
                body = escape(text)
                context = head + body + END
                closed = role == "assistant"
                if closed:
                    if waiting is not None:
                        out.append(waiting + (False,))
                    waiting = (conv, number, context, len(head), len(head) + len(body))
                    number += 1
                    held += len(context)
                if held >= BLOCK:
                    yield from packed(out)
                    out, held = [], 0
        if started:
            out += finished()
        yield from packed(out)

    def packed(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            yield batch_of(names, [pa.array(column, type=kind) for column, kind in zip(zip(*out), kinds)])

    return map_arrow(rows, run, EXAMPLE)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples hold, parsed from the formatted strings; the input is as `expand` leaves it.

    The turns come from the last example, which contains them all; the trained text comes from the masked span of each.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint"
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        loss, chars, size, count = hashlib.sha256(), 0, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                conv, _, formatted, start, end, is_last = (batch.column(c)[i].as_py() for c in range(6))
                trained = unescape(formatted[start:end])
                loss.update(trained.encode("utf-8", "surrogatepass"))
                chars, size, count = chars + len(trained), size + len(formatted), count + 1
                if is_last:
                    turns, digest = parse(formatted), hashlib.sha256()
                    for role, text in turns:
                        digest.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    out.append((conv, len(turns), digest.hexdigest(), chars, loss.hexdigest(), size, count))
                    loss, chars, size, count = hashlib.sha256(), 0, 0, 0
            if len(out) >= 256:
                yield batch_of(names, [pa.array(column, type=kind) for column, kind in zip(zip(*out), kinds)])
                out = []
        if out:
            yield batch_of(names, [pa.array(column, type=kind) for column, kind in zip(zip(*out), kinds)])

    df = examples.select(*[part.split()[0] for part in EXAMPLE.split(", ")])
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "32")
    return df.mapInArrow(run, schema)
