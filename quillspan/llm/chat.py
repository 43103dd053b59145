"""Chat formatting by incremental rendering of a template that is known only by its output.

A template is a function from a list of (role, text) turns to a string. For each turn the turns
before it are rendered without and with it; if the second output starts with the first, what is new
is the turn's span, else the template rewrites history there and the span is what follows the common
beginning. Rendering the turn with a marker for its text shows what the template puts around a text.

All turns before a turn are rendered with it, and each output is kept as the next turn's first half, so
whether the template rewrites history is settled over the whole conversation, in time by the square of its
turns. For a template that is known to look back no further, ``context=CONTEXT`` renders the first turn and
the ``CONTEXT`` before instead: bounded memory and time in proportion to the turns, whatever the length.

Cases: a null role or text is an empty one; turns of one number follow each other by role, then
text, nulls first; a null turn number comes first; rows without a conversation form one; repeated
rows are repeated turns; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A bound, if asked for, on the turns before a turn that are rendered with it, besides the first.
CONTEXT = 6
#: Stands for a text when the template is asked what it puts around one.
MARK = "\ue000\ue001"
Turn = tuple[str, str]


def escape(text: str) -> str:
    """``<|`` can't begin a control string any more: a backslash more stands between the two."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def im_template(turns: list[Turn]) -> str:
    """Marks each turn with <|im_start|>role, newline, text, <|im_end|>, newline; roles and texts are escaped."""
    role = lambda r: escape(r.replace("\\", "\\\\").replace("\n", "\\n"))
    return "".join(f"<|im_start|>{role(r)}\n{escape(t)}<|im_end|>\n" for r, t in turns)


def parse_im(piece: str) -> Turn:
    """The role and text of one turn that ``im_template`` has rendered."""
    head, text = piece.removeprefix("<|im_start|>").split("\n", 1)
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(head))
    return role, unescape(text.removesuffix("<|im_end|>\n"))


def locate(window: list[Turn], turn: Turn, template: Callable[[list[Turn]], str], before: str) -> tuple[str, int, int, bool, int, str]:
    """What the template adds for ``turn`` after ``window``, which gives ``before``; where the text is in it; whether it
    rewrote what came before; where in the output it begins, and that output.
    """
    after = template([*window, turn])
    rewrites = not after.startswith(before)
    start = len(commonprefix([before, after])) if rewrites else len(before)
    piece, marked = after[start:], template([*window, (turn[0], MARK)])
    at = marked.rfind(MARK)
    head = at - start
    tail = len(marked) - at - len(MARK)
    if at < start or head + tail > len(piece) or after[:at] != marked[:at] or not after.endswith(marked[at + len(MARK) :]):
        return piece, 0, len(piece), True, start, after  # the template changes around the text itself
    return piece, head, len(piece) - tail, rewrites, start, after


def format_turns(conversations: DataFrame, template: Callable[[list[Turn]], str] = im_template, loss_roles: tuple[str, ...] = ("assistant",), context: int | None = None) -> DataFrame:
    """A row per turn, in order within its partition, which holds whole conversations.

    ``conv_id``, ``n`` (from 0), ``role``, ``piece`` (what the template adds for the turn), ``start`` and ``end``
    (the piece in the output as of that turn, in characters), ``loss_start`` and ``loss_end`` (the text of a turn
    to learn from, in the same output; null for others), ``rewrites`` (whether the template changed what came before).
    """
    rows = conversations.select(conversations["conv_id"], conversations["turn"], conversations["role"], conversations["text"])
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", "n", "role", "piece", "start", "end", "loss_start", "loss_end", "rewrites"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, at, window, before = object(), 0, 0, [], ""
        for batch in batches:
            out = {name: [] for name in names}
            for conv, role, text in zip(*(batch.column(i) for i in (0, 2, 3)), strict=True):
                conv, turn = conv.as_py(), (role.as_py() or "", text.as_py() or "")
                if conv != own:
                    own, n, at, window, before = conv, 0, 0, [], ""
                piece, a, b, rewrites, start, after = locate(window, turn, template, before)
                if context is None:
                    at = start
                learn = turn[0] in loss_roles
                for name, x in zip(names, (conv, n, turn[0], piece, at, at + len(piece), at + a if learn else None, at + b if learn else None, rewrites), strict=True):
                    out[name].append(x)
                window.append(turn)
                if context is not None and len(window) > context + 1:
                    del window[1]
                    after = template(window)
                before = after
                n, at = n + 1, at + len(piece)
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in zip(names, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, f"conv_id {kind}, n long, role string, piece string, start long, end long, loss_start long, loss_end long, rewrites boolean")


def read_back(pieces: DataFrame, parse: Callable[[str], Turn] = parse_im, undo: Callable[[str], str] = unescape) -> DataFrame:
    """Digests of what formatted conversations say, a row per conversation, from the rows of ``format_turns`` as they are dealt and ordered.

    ``turns_sha256`` is over role, newline, text, newline of each turn; ``loss_chars`` and ``loss_sha256`` are over
    the texts under the loss mask, unescaped; ``formatted_chars`` is the length of the whole output.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, kinds = object(), None, None

        def row(h: dict) -> tuple:
            return own, h["n"], h["turns"].hexdigest(), h["chars"], h["loss"].hexdigest(), h["length"], h["rewrites"]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            done = []
            for conv, piece, start, a, b, rewrites in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "start", "loss_start", "loss_end", "rewrites")), strict=True):
                if conv != own:
                    if held:
                        done.append(row(held))
                    own, held = conv, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "length": 0, "rewrites": False}
                role, text = parse(piece)
                held["turns"].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    learnt = undo(piece[a - start : b - start])
                    held["loss"].update(learnt.encode())
                    held["chars"] += len(learnt)
                held["n"] += 1
                held["length"] += len(piece)
                held["rewrites"] |= rewrites
            yield out(done)
        if held:
            yield out([row(held)])

    return pieces.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")
