r"""Chat formatting by prefix-target expansion.

Turns are marked <|im_start|>role\n ... <|im_end|>\n. Inside texts a backslash is doubled and "<|" becomes "<\|", so no text can
hold a control string, and the escape is undone exactly; in roles a line feed becomes "\n" as well.

Every assistant turn is an example of its own: all turns before it are its context, and only its text is trainable. The turns are
laid out end to end; an example's text is the prefix of that layout up to the end of its turn, with the loss on [loss_start,
loss_end) of that text. `expanded` makes the examples whole, each with its own copy of the context, so its text grows with the
square of a conversation's length. `read_back` writes them and takes its digests from the files.

Nulls, ties and the like: a null text or role is empty; a null conv_id is a conversation; a null turn comes first; equal turn
numbers stand by role, then text; a conversation without assistant turns has no example and an empty loss; repeated rows are turns said twice; a long turn is copied into
every example after it, and a task holds one example at a time; an empty table gives an empty layout. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlane.llm.common import materialize

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
EXAMPLE = "conv_id long, example long, context string, reply string, loss_start long, loss_end long"
_READ = "conv_id long, example long, n long, chars long, said string, loss string, before string, after string"
BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, example_chars long"
#: A batch that a task gives out has so many rows or characters at most.
ROWS, HELD = 5000, 4 << 20


def escape(text: Column, line: bool = False) -> Column:
    out = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if line else out


def unescape(text: str, line: bool = False) -> str:
    return _ESCAPED.sub(lambda m: "\n" if line and m[1] == "n" else m[1], text)


def layout(turns: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, place (from 1), segment, begin, end (code points in the layout), example (its number, for assistant turns), loss_start, loss_end."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.concat(F.lit(START), escape(F.col("role"), line=True), F.lit("\n"))
    trained = F.coalesce(F.col("role") == TRAINED, F.lit(False))
    rows = turns.select("conv_id", "turn", "role", "text", F.concat(head, escape(F.col("text")), F.lit(END)).alias("segment"), F.length(head).alias("before"), trained.alias("trained"))
    rows = rows.withColumns({"place": F.row_number().over(by), "end": F.sum(F.length("segment")).over(by), "nth": F.sum(F.col("trained").cast("int")).over(by)})
    begin = F.col("end") - F.length("segment")
    only = lambda x: F.when(F.col("trained"), x)
    return rows.select("conv_id", "place", "segment", begin.alias("begin"), "end", only(F.col("nth")).alias("example"), only(begin + F.col("before")).alias("loss_start"), only(F.col("end") - len(END)).alias("loss_end"))


def examples(laid: DataFrame) -> DataFrame:
    """One row for each assistant turn: the context is [0, context_end) of its conversation's layout, the loss [loss_start, loss_end)."""
    return laid.where("example is not null").select("conv_id", "example", F.col("begin").alias("context_end"), "end", "loss_start", "loss_end")


def expanded(laid: DataFrame) -> DataFrame:
    """Whole examples: conv_id, example, context, reply, loss_start, loss_end (in context and reply as one text).

    Where turns follow the last reply, a row without example and reply has the whole conversation as its context.
    """
    rows = laid.select("conv_id", "place", "segment", "example", "loss_start", "loss_end")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_expand, EXAMPLE)


def rendered(laid: DataFrame) -> DataFrame:
    """The examples alone: conv_id, example, context, reply."""
    return expanded(laid).where("example is not null").select("conv_id", "example", "context", "reply")


def _columns(ddl: str) -> tuple[list[str], pa.Schema]:
    fields = [x.split() for x in ddl.split(", ")]
    return [n for n, _ in fields], pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in fields])


def _batched(rows: Iterator[tuple[tuple, int]], ddl: str) -> Iterator[pa.RecordBatch]:
    """Rows come with their size in characters; a batch has ROWS rows or about HELD characters."""
    names, schema = _columns(ddl)
    done, held = [], 0
    pack = lambda: pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done, strict=True)), strict=True)), schema)
    for row, size in rows:
        done.append(row)
        held += size
        if len(done) >= ROWS or held >= HELD:
            yield pack()
            done, held = [], 0
    if done:
        yield pack()


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """A row at a time: whole contexts are not made Python strings by the batch."""
    for batch in batches:
        columns = [batch.column(n) for n in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns of a conversation come one after the other, in order; its text so far is held."""

    def run() -> Iterator[tuple[tuple, int]]:
        for conv_id, turns in groupby(_rows(batches, "conv_id", "segment", "example", "loss_start", "loss_end"), itemgetter(0)):
            text, open_ = "", []
            for _, segment, example, start, end in turns:
                if example is None:
                    open_.append(segment)
                    continue
                text += "".join(open_)
                open_ = []
                yield (conv_id, example, text, segment, start, end), len(text) + len(segment)
                text += segment
            if open_:
                text += "".join(open_)
                yield (conv_id, None, text, None, None, None), len(text)

    yield from _batched(run(), EXAMPLE)


def _turns(text: str) -> Iterator[tuple[str, str, int]]:
    """(role, text, end) of each turn; no text holds a control string, so each END ends a turn."""
    *parts, rest = text.split(END)
    if rest:
        raise ValueError(f"not a turn: {rest[:80]!r}")
    end = 0
    for part in parts:
        m = _TURN.fullmatch(part)
        if m is None or "<|" in m[1] or "<|" in m[2]:
            raise ValueError(f"not a turn: {part[:80]!r}")
        end += len(part) + len(END)
        yield unescape(m[1], line=True), unescape(m[2]), end


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's whole text, by itself: its turns, its loss, and digests by which the next row's context must go on."""

    def run() -> Iterator[tuple[tuple, int]]:
        for conv_id, example, context, reply, start, end in _rows(batches, "conv_id", "example", "context", "reply", "loss_start", "loss_end"):
            said, n, upto, loss = hashlib.sha256(), 0, 0, None
            for role, text, at in _turns(context):
                said.update(f"{role}\n{text}\n".encode())
                n, upto = n + 1, at if role == TRAINED else upto
            if reply is not None:
                ((role, text, _),) = _turns(reply)
                loss = unescape(reply[start - len(context) : end - len(context)])
                if role != TRAINED or loss != text:
                    raise ValueError(f"the loss is not the reply: {reply[:80]!r}")
                said.update(f"{role}\n{text}\n".encode())
                n += 1
            whole = context + (reply or "")
            yield (conv_id, example, n, len(whole), said.hexdigest(), loss, _sha(whole[:upto]), _sha(whole)), 300 + len(loss or "")

    yield from _batched(run(), _READ)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's examples come in order; each must go on where the one before it ended, and the last has all turns."""

    def run() -> Iterator[tuple[tuple, int]]:
        for conv_id, rows in groupby(_rows(batches, *_columns(_READ)[0]), itemgetter(0)):
            loss, loss_chars, n_examples, example_chars, last = hashlib.sha256(), 0, 0, 0, _sha("")
            for _, example, n, chars, said, text, before, after in rows:
                if before != last or example not in (None, n_examples + 1):
                    raise ValueError(f"example {example} of conversation {conv_id} does not go on from the one before it")
                last = after
                if example is not None:
                    loss.update(text.encode())
                    loss_chars, n_examples, example_chars = loss_chars + len(text), n_examples + 1, example_chars + chars
            yield (conv_id, n, said, loss_chars, loss.hexdigest(), chars, n_examples, example_chars), 300

    yield from _batched(run(), BACK)


def read_back(laid: DataFrame) -> DataFrame:
    """Writes the whole examples of a layout, reads them back, and gives a row for each conversation: what their turns and loss spans say, unescaped, in digests.

    formatted_chars is the length of a conversation's longest text, example_chars that of all its examples.
    """
    each = materialize(expanded(laid), "chat", compression="zstd").mapInArrow(_read, _READ)
    return each.repartition("conv_id").sortWithinPartitions("conv_id", F.col("example").asc_nulls_last()).mapInArrow(_combine, BACK)
