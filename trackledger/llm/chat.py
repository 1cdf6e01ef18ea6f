"""Chat formatting in budgeted windows.

A turn is written ``<s>[INST] role [/INST] text </s>``.  These control strings are escaped
inside roles and texts by a backslash after their first character (and backslashes are
doubled), so what a text says can never end its turn, and reading back is exact.

A conversation is cut into windows of ``budget`` tokens by the running sums of its turns'
tokens: a window takes whole turns while the sum since its first turn fits.  A leading
system turn is repeated at the head of every window, followed by the turns just before
the window, at most ``history`` of them and a quarter of the budget.  Only the texts of
assistant turns count for the loss, and only in the window where they are new, so each is
learned once.  A turn longer than the budget has a window of its own.

Turns are counted and escaped row by row; then the rows of a conversation stream through
one task in order, which holds one window and the possible history, never the
conversation.  A conversation with a third of all rows therefore needs time, not memory.

Null roles and texts are empty, a null conversation id is an id of its own, rows are
ordered by turn (nulls first), then role and text, and repeated rows are turns like any.
An empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BUDGET = 1024
HISTORY = 2
_FIND = re.compile("|".join(re.escape(c) for c in ("\\", *sorted(CONTROL, key=len, reverse=True))))
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\] (.*?) </s>", re.DOTALL)
WINDOWS = "conv_id {kind}, window int, formatted string, n_repeated int, n_turns int, n_tokens long, loss array<struct<start:int, end:int>>"


def escaped(text: str) -> str:
    return _FIND.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def formatted_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where in it the text starts and ends."""
    head = f"<s>[INST] {escaped(role)} [/INST] "
    body = escaped(text)
    return f"{head}{body} </s>", len(head), len(head) + len(body)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window."""
    return [(unescaped(role), unescaped(text)) for role, text in _TURN.findall(formatted)]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def turn_column(role: Column, text: Column, tokenizer_file: str) -> Column:
    """struct(formatted, start, end, n_tokens) of each turn."""

    def write(roles: pa.Array, texts: pa.Array) -> pa.Array:
        turns = [formatted_turn(r or "", t or "") for r, t in zip(roles.to_pylist(), texts.to_pylist(), strict=True)]
        tokens = [len(e.ids) for e in _tokenizer(tokenizer_file).encode_batch_fast([t for t, _, _ in turns], add_special_tokens=False)]
        columns = [pa.array([t[0] for t in turns], pa.string()), *(pa.array([t[k] for t in turns], pa.int32()) for k in (1, 2)), pa.array(tokens, pa.int64())]
        return pa.StructArray.from_arrays(columns, ["formatted", "start", "end", "n_tokens"])

    return F.arrow_udf(write, "formatted string, start int, end int, n_tokens long")(role, text)


class Windows:
    """The windows of one conversation, turn by turn."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: list[tuple] = []
        self.seen = self.window = 0
        self.sums = [0]  # running tokens of the turns in hand
        self.turns: list[tuple] = []  # history, then new turns
        self.old = 0  # how many of them are history

    def _tokens(self, first: int, last: int) -> int:
        return self.sums[last] - self.sums[first]

    def _head(self) -> int:
        return sum(t[3] for t in self.system) if self.window else 0

    def _restart(self) -> None:
        """Keeps as history what may be repeated of the turns in hand."""
        n = len(self.turns)
        first = n
        leading = len(self.system) if not self.window else 0  # the system turn stands at the head already
        while first > leading and n - first < self.history and self._tokens(first - 1, n) <= self.budget // 4:
            first -= 1
        base = self.sums[first]
        self.turns, self.sums = self.turns[first:], [s - base for s in self.sums[first:]]
        self.old = len(self.turns)
        self.window += 1

    def _row(self) -> dict:
        head = self.system if self.window else []
        text, loss = "", []
        for k, (formatted, start, end, _, role) in enumerate([*head, *self.turns]):
            if role == "assistant" and k >= len(head) + self.old:
                loss.append({"start": len(text) + start, "end": len(text) + end})
            text += formatted
        return {
            "window": self.window, "formatted": text, "n_repeated": len(head) + self.old, "n_turns": len(head) + len(self.turns),
            "n_tokens": self._head() + self.sums[-1], "loss": loss,
        }

    def add(self, formatted: str, start: int, end: int, tokens: int, role: str) -> Iterator[dict]:
        """Takes one turn; gives the window that it no longer fits into."""
        if len(self.turns) > self.old and self._head() + self.sums[-1] + tokens > self.budget:
            yield self._row()
            self._restart()
            while self.old and self._head() + self.sums[-1] + tokens > self.budget:  # no room for history
                base = self.sums[1]
                self.turns, self.sums = self.turns[1:], [s - base for s in self.sums[1:]]
                self.old -= 1
        turn = (formatted, start, end, tokens, role)
        if not self.seen and role == "system":
            self.system = [turn]
        self.seen += 1
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + tokens)

    def close(self) -> Iterator[dict]:
        if len(self.turns) > self.old:
            yield self._row()


def _windowed(budget: int, history: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Turns come sorted by conversation and turn."""
        now, held = None, None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            rows: list[dict] = []
            loss = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            kinds = dict(zip(names, (kind, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), loss), strict=True))
            schema = pa.schema(list(kinds.items()))
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "start", "end", "n_tokens", "role")]
            for conv, *turn in zip(*columns, strict=True):
                if held is None or conv != now:
                    if held is not None:
                        rows += [{"conv_id": now, **w} for w in held.close()]
                    now, held = conv, Windows(budget, history)
                rows += [{"conv_id": conv, **w} for w in held.add(*turn)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": now, **w} for w in held.close()], schema=schema)

    return run


def format_windows(turns: DataFrame, tokenizer_file: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, formatted, n_repeated, n_turns, n_tokens, loss) from (conv_id, turn, role, text)."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = WINDOWS.format(kind=kind)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), turn_column(F.col("role"), F.col("text"), tokenizer_file).alias("_t"))
    rows = rows.select("conv_id", "turn", "role", "_t.*").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    names = ["conv_id", "window", "formatted", "n_repeated", "n_turns", "n_tokens", "loss"]
    return rows.drop("turn").mapInArrow(_windowed(budget, history, names), schema)


DIGESTS = "conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows come sorted by conversation and window."""
    now, state = None, None

    def closed(kind: pa.DataType) -> pa.RecordBatch:
        turns, whole, loss_chars, loss, chars, windows = state
        values = [now, turns, whole.hexdigest(), loss_chars, loss.hexdigest(), chars, windows]
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, formatted, repeated, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "n_repeated", "loss")), strict=True):
            if state is None or conv != now:
                if state is not None:
                    yield closed(kind)
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, text in turns_of(formatted)[repeated:]:
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for span in loss:
                text = unescaped(formatted[span["start"] : span["end"]])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
            state[5] += 1
    if state is not None:
        yield closed(kind)


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, digests of its turns and of the text under the loss, parsed from its windows."""
    kind = windows.schema["conv_id"].dataType.simpleString()
    rows = windows.select("conv_id", "window", "formatted", "n_repeated", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return rows.mapInArrow(_digested, DIGESTS.format(kind=kind))
