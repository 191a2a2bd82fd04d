"""Chat formatting in budgeted windows of whole turns.

Windows follow each other through a conversation. Prefix sums of the turns' tokens say how far a window reaches; it
opens with the system turn and some turns of the previous window as context, whose assistant texts
are masked because they were targets before. A window is a plain string with marks for its turns and a list of
(start, stop) spans under the loss mask; the string alone says everything, as control strings inside texts are escaped.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadspark.llm.common import batches, rows_of

#: The control strings of the template. A window is BOS, turns, EOS; a turn is OPEN role RS text CLOSE.
BOS, EOS = "<s>", "</s>"
OPEN, AGAIN, TARGET, CLOSE = "[INST]", "[HIST]", "[LOSS]", "[/INST]"
CONTROLS = (BOS, EOS, OPEN, AGAIN, TARGET, CLOSE)
ESCAPE = "\\"

BUDGET = 512
HISTORY = 2

_WINDOW = "conv_id long, window int, n_turns int, n_tokens long, formatted string, loss array<struct<start:int,stop:int>>"
_SPECIAL = re.compile("[" + re.escape("<[" + ESCAPE) + "]")
_IN_ROLE = re.compile("[" + re.escape("<[" + ESCAPE) + "\n]")
_ESCAPED = re.compile(re.escape(ESCAPE) + "(.)", re.S)


def escape(text: str, special: re.Pattern = _SPECIAL) -> str:
    """No control string can appear in the result: their first characters and the escape itself get an escape in front."""
    return special.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def n_tokens(text: str) -> int:
    """A turn's size: its characters over four, rounded up, and its marks."""
    return (len(text) + 3) // 4 + 4


def _format(turns: list[tuple[str, str, str]]) -> tuple[str, list[dict]]:
    """Turns (mark, role, text) as a window's string and the spans of its targets."""
    parts, at, loss = [BOS], len(BOS), []
    for mark, role, text in turns:
        head, body = f"{mark}{escape(role, _IN_ROLE)}\n", escape(text)
        if mark == TARGET:
            loss.append({"start": at + len(head), "stop": at + len(head) + len(body)})
        parts += head, body, CLOSE
        at += len(head) + len(body) + len(CLOSE)
    return "".join([*parts, EOS]), loss


_TURN = re.compile(
    "(" + "|".join(map(re.escape, (OPEN, AGAIN, TARGET))) + r")((?:[^<\[\n\\]|\\.)*)\n((?:[^<\[\\]|\\.)*)" + re.escape(CLOSE), re.S
)


def parse(formatted: str) -> list[tuple[str, str, str]]:
    """(mark, role, text) of each turn of a window's string."""
    return [(m[1], unescape(m[2]), unescape(m[3])) for m in _TURN.finditer(formatted)]


def windows_of(turns: Iterable[tuple[str, str]], budget: int = BUDGET, history: int = HISTORY) -> Iterator[tuple[int, int, str, list]]:
    """(turns, tokens, string, loss spans) of each window of a conversation, holding one window's turns at a time.

    The system turn is the first turn if its role is system; it opens every window and is new in the first only.
    A turn that exceeds the budget by itself still comes whole, alone with the system turn.
    """
    stream = iter(turns)
    held = [t for t in [next(stream, None)] if t]
    system = held[0] if held and held[0][0] == "system" else None
    before: list[tuple[str, str]] = []  # turns already given, for the next window's context
    first = True
    while held:
        fixed = 0 if system is None or first else n_tokens(system[1])
        room = budget - fixed
        while sum(n_tokens(t) for _, t in held) <= room and (t := next(stream, None)):
            held.append(t)
        # leave out the oldest context until the context and the next turn fit
        context = before[-history:] if history else []
        while context and sum(n_tokens(t) for _, t in context) + n_tokens(held[0][1]) > room:
            context = context[1:]
        sums = list(accumulate(n_tokens(t) for _, t in held))
        fits = bisect_right(sums, room - sum(n_tokens(t) for _, t in context))
        new, held = held[: max(1, fits)], held[max(1, fits) :]
        out = [(AGAIN, *system)] if system is not None and not first else []
        out += [(AGAIN, *t) for t in context]
        out += [(TARGET if role == "assistant" else OPEN, role, text) for role, text in new]
        formatted, loss = _format(out)
        yield len(out), sum(n_tokens(t) for *_, t in out), formatted, loss
        before = (before + [t for i, t in enumerate(new) if not (first and i == 0 and system is not None)])[-history:] if history else []
        first = False
        if not held:
            held = [t for t in [next(stream, None)] if t]


def format_chats(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per window: conv_id, window, n_turns, n_tokens, formatted, loss; a conversation's windows come in order, together.

    Rows go by turn, then role, then text, so repeated turns stay and ties have one order; null turns come first. Null role or text
    counts as empty. Rows without a conversation id form one conversation with a null id. Other columns are ignored. A conversation is
    read as a stream of sorted rows and only one window of it is held, however long it is.
    """
    def run(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for conv, turns in groupby(rows_of(incoming), key=lambda r: r[0]):
                texts = ((r[2] or "", r[3] or "") for r in turns)
                for k, (n, tokens, formatted, loss) in enumerate(windows_of(texts, budget, history)):
                    yield conv, k, n, tokens, formatted, loss

        yield from batches(rows(), _WINDOW, 512)

    picked = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
    )
    keys = ("conv_id", "turn", "role", "text")
    return picked.repartition("conv_id").sortWithinPartitions(*keys).mapInArrow(run, _WINDOW)


def chat_digests(windows: DataFrame) -> DataFrame:
    """Read the windows of ``format_chats`` back: conv_id, n_turns, n_windows, the digests and character counts.

    ``windows`` must come straight from ``format_chats``, whose rows are grouped and in order.
    """
    out = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, n_windows long"
    )

    def run(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for conv, some in groupby(rows_of(incoming), key=lambda r: r[0]):
                turns, loss, n, chars, size, k = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
                for _, _, _, _, formatted, spans in some:
                    k, size = k + 1, size + len(formatted)
                    for mark, role, text in parse(formatted):
                        if mark != AGAIN:
                            n += 1
                            turns.update(f"{role}\n{text}\n".encode())
                    for span in spans:
                        text = unescape(formatted[span["start"] : span["stop"]])
                        chars += len(text)
                        loss.update(text.encode())
                yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, k

        yield from batches(rows(), out)

    return windows.mapInArrow(run, out)
