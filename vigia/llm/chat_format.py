"""Chat formatting by incremental rendering of a template that is a black box.

A template is any function from a list of (role, text) to a string. Turn prefixes are rendered one
after the other; where a prefix's output begins with the one before, what was added is the span of
the new turn. Inside a span the text is found by rendering the turn twice more with one-letter
texts: the outputs part where the text begins, and what follows it is known too. What is found must be
the turn's text once it is unescaped; where it is not, as behind a length that the template prints,
letters of the text's own length are rendered, and if that does not help, because the template alters
the text, the span is reported as not exact and is never under the loss mask. A template that
writes earlier turns anew once more turns come shows in outputs that do not begin with their
predecessors, or in an output of the whole conversation that is not the sum of its spans.

A prefix longer than ``CONTEXT`` turns is rendered with its last turns only, so that long
conversations cost time in proportion to their length; the sum of the spans is always compared with
one rendering of the whole conversation, and where they differ all whole prefixes are rendered.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, importable, sliced

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
START, END = "<|im_start|>", "<|im_end|>"
CONTEXT = 8
TURNS = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    """Every ``<|``, however many backslashes stand within, gets one backslash more."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    plain = unescape(role)
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], plain)


def marked(turns: list[Turn]) -> str:
    """Turns between start and end marks, the role on a line of its own."""
    return "".join(f"{START}{escape_role(role)}\n{escape(text)}{END}\n" for role, text in turns)


def read_back(formatted: str) -> list[Turn]:
    """The turns that ``marked`` has written."""
    return [(unescape_role(role), unescape(text)) for role, text in TURNS.findall(formatted)]


@dataclass(frozen=True)
class Span:
    """Code points of a turn in the output, and of its text within; whether that is the turn's text."""

    start: int
    end: int
    text_start: int
    text_end: int
    exact: bool = True


def _inside(render: Template, context: list[Turn], role: str, before: str, length: int) -> tuple[int, int]:
    """Where a text of that length lies in what a turn adds: characters before it and behind it."""
    a, b = (render([*context, (role, letter * length)]) for letter in "AB")
    if not (a.startswith(before) and b.startswith(before)):
        return 0, 0
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), 0)
    return head - len(before), tail


def spans(
    render: Template, turns: list[Turn], context: int = CONTEXT, plain: Callable[[str], str] = unescape
) -> tuple[str, list[Span], bool]:
    """Output, span of each turn, and whether the template rewrites history.

    Of a template that does, the spans are those of the turns when they were last, and only the
    ones that the final output still holds at their place are meaningful: the others are not exact.
    ``plain`` takes back what the template does to control strings inside texts.
    """
    whole = render(turns)
    insides: dict = {}
    for most in (context, len(turns)):
        out: list[Span] = []
        at, rewritten, pieces = 0, False, []
        for k, turn in enumerate(turns):
            known = turns[max(0, k - most) : k]
            before, after = render(known) if known else "", render([*known, turn])
            if not known or after.startswith(before):
                added = len(after) - len(before)
            else:
                rewritten = True
                added = max(0, len(after) - len(before))
            piece = after[len(after) - added :]
            key = (turn[0], len(known) == 0, tuple(r for r, _ in known))
            if key not in insides:
                if len(insides) > 1_000:
                    insides.clear()
                insides[key] = _inside(render, known, turn[0], before, 1)
            head, tail = insides[key]
            end = max(head, added - tail)
            if plain(piece[head:end]) != turn[1]:
                # of an empty text there is nothing to find: it lies where one letter would
                head, tail = _inside(render, known, turn[0], before, max(1, len(turn[1])))
                end = max(head, added - tail)
            exact = plain(piece[head:end]) == turn[1]
            out.append(Span(at, at + added, at + head, at + end, exact))
            at += added
            pieces.append(piece)
        rewritten = rewritten or "".join(pieces) != whole
        if not rewritten or len(turns) <= context:
            break
    if rewritten:
        out = [
            Span(s.start, s.end, s.text_start, s.text_end, s.exact and plain(whole[s.text_start : s.text_end]) == text)
            for s, (_, text) in zip(out, turns, strict=True)
        ]
    return whole, out, rewritten


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): a row per conversation, its turns in order.

    Turns of one number are ordered by role and text; null roles and texts are empty; turns of
    equal number, role and text each count. A null conv_id is a conversation of its own.
    """
    text, role = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "role"))
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_chats(
    rows: DataFrame,
    render: Template = marked,
    trained: tuple[str, ...] = ("assistant",),
    plain: Callable[[str], str] = unescape,
) -> DataFrame:
    """Formatted conversations of (conv_id, turn, role, text).

    Returns conv_id, n_turns, ``formatted``, ``spans`` (start, end, text_start, text_end, role,
    ``exact``: whether the text found there is the turn's, by ``plain`` where the template escapes, and
    ``loss``: whether it is and the role is one of ``trained``) and ``rewritten``: true if the template
    changed earlier turns. Positions are code points. The whole conversation becomes one string,
    so that one conversation has to fit a task. Other columns are ignored; an empty table gives an
    empty result.
    """
    importable(rows.sparkSession)

    def run(batches: Batches) -> Batches:
        for batch in sliced(batches):
            n, formatted, found, rewritten = [], [], [], []
            for turns in batch.column("turns").to_pylist():
                pairs = [(t["role"], t["text"]) for t in turns]
                out, each, changed = spans(render, pairs, plain=plain)
                n.append(len(pairs))
                formatted.append(out)
                rewritten.append(changed)
                found.append([
                    {"start": s.start, "end": s.end, "text_start": s.text_start, "text_end": s.text_end,
                     "role": role, "exact": s.exact, "loss": s.exact and role in trained}
                    for s, (role, _) in zip(each, pairs, strict=True)
                ])
            kind = pa.list_(pa.struct([
                *((c, pa.int64()) for c in ("start", "end", "text_start", "text_end")),
                ("role", pa.string()), ("exact", pa.bool_()), ("loss", pa.bool_()),
            ]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(formatted, pa.string()),
                 pa.array(found, kind), pa.array(rewritten, pa.bool_())],
                names=["conv_id", "n_turns", "formatted", "spans", "rewritten"],
            )

    span = "struct<start: bigint, end: bigint, text_start: bigint, text_end: bigint, role: string, exact: boolean, loss: boolean>"
    kind = dict(rows.dtypes)["conv_id"]
    return conversations(rows).mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, formatted string, spans array<{span}>, rewritten boolean"
    )


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted text says when it is read back: turns, and the text under the loss mask."""
    importable(chats.sparkSession)

    def run(batches: Batches) -> Batches:
        for batch in sliced(batches):
            turns, loss = [], []
            for text, spans_ in zip(batch.column("formatted").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                turns.append("".join(f"{role}\n{said}\n" for role, said in read_back(text)))
                loss.append("".join(unescape(text[s["text_start"] : s["text_end"]]) for s in spans_ if s["loss"]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "n_turns", "formatted")), pa.array(turns, pa.string()), pa.array(loss, pa.string())],
                names=["conv_id", "n_turns", "formatted", "turns", "loss"],
            )

    kind = dict(chats.dtypes)["conv_id"]
    read = chats.select("conv_id", "n_turns", "formatted", "spans").mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, formatted string, turns string, loss string"
    )
    return read.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
