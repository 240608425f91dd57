"""Chat formatting on tokens.

Every segment of a conversation, its texts and the marks of its template, is encoded by itself; marks
are reserved ids that no text gives.  Control strings inside a text are escaped first, which reading
back undoes.  The positions where the loss counts follow from a prefix sum over +1 and -1 at the
segments' borders.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Strings with a meaning to chat templates, and the escape itself (fixed values).
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
#: Stands before the second character of a control string in a text, and before itself.
ESCAPE = "\\"
#: The template: a turn is <s> role, newline, text </s>.  The marks are ids behind the vocabulary.
MARKS = {"<s>": 0, "</s>": 1, "\n": 2}
#: The words that split a text before merging (fixed value, of the vocabulary's description).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def escape(text: str) -> str:
    """No control string is left in the result, and ``unescape`` gives the text again."""
    text = text.replace(ESCAPE, ESCAPE * 2)
    for c in CONTROL:
        text = text.replace(c, c[0] + ESCAPE + c[1:])
    return text


def unescape(text: str) -> str:
    # An escape is before itself or inside a control string: either way it goes and what follows stays.
    parts, at = [], 0
    while (i := text.find(ESCAPE, at)) >= 0:
        parts.append(text[at:i] + text[i + 1 : i + 2])
        at = i + 2
    return "".join([*parts, text[at:]])


class Codec:
    """Byte-level ids of a rank file; three ids behind them mark begin of turn, end of turn, and end of role."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first_mark = max(ranks.values()) + 2
        self._roles: dict[str, list[int]] = {}

    def mark(self, name: str) -> int:
        return self.first_mark + MARKS[name]

    def segments(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A turn's ids, and +1 where its loss begins and -1 where it ends."""
        role_ids, text_ids = self._role(role), self.encoding.encode_ordinary(escape(text))
        ids = np.array([self.mark("<s>"), *role_ids, self.mark("\n"), *text_ids, self.mark("</s>")], np.uint32)
        border = np.zeros(len(ids), np.int8)
        if role == "assistant" and text_ids:
            border[len(role_ids) + 2] += 1
            border[-1] -= 1
        return ids, border

    def _role(self, role: str) -> list[int]:
        """A role's ids; there are few roles, so they are remembered, up to a bound."""
        known = self._roles.get(role)
        if known is None:
            known = self.encoding.encode_ordinary(escape(role))
            if len(self._roles) < 1024:
                self._roles[role] = known
        return known

    def read(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8")

    def turns(self, ids: np.ndarray) -> Iterator[tuple[str, str]]:
        """The roles and texts of a token sequence."""
        starts, ends = (np.flatnonzero(ids == self.mark(m)) for m in ("<s>", "</s>"))
        cuts = np.flatnonzero(ids == self.mark("\n"))
        for s, c, e in zip(starts, cuts, ends):
            yield unescape(self.read(ids[s + 1 : c])), unescape(self.read(ids[c + 1 : e]))

    def text(self, ids: np.ndarray) -> str:
        """The formatted conversation as text, marks included."""
        names = {self.mark(m): m for m in MARKS}
        at = np.flatnonzero(ids >= self.first_mark)
        out, last = [], 0
        for i in at.tolist():
            out += [self.read(ids[last:i]), names[int(ids[i])]]
            last = i + 1
        return "".join([*out, self.read(ids[last:])])


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def formatted(turns: DataFrame, path: str) -> DataFrame:
    """``conv_id, turn, ids, border``: the tokens of every turn (unsigned 32-bit integers) and its loss borders (signed bytes).

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``; a null role or text is an empty one.  A
    conversation is its turns' tokens in order of ``turn``; its loss mask is where the running sum
    of its borders is above 0.  Any one task holds the turns of a batch only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for piece in slices(batch, "text"):
                made = [own.segments(r or "", t or "") for r, t in zip(piece.column("role").to_pylist(), piece.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([piece.column("conv_id"), piece.column("turn"), pa.array([a.tobytes() for a, _ in made], pa.binary()), pa.array([b.tobytes() for _, b in made], pa.binary())], ["conv_id", "turn", "ids", "border"])

    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("text").cast("string")).mapInArrow(run, "conv_id long, turn long, ids binary, border binary")


def assembled(parts: DataFrame, path: str) -> DataFrame:
    """What each conversation of ``formatted`` turns reads back as.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, n_loss_tokens``.
    Turns come sorted to a task, which keeps no more than one turn and a conversation's running sums,
    so a conversation may have any number of turns.  Turns with equal numbers go by their tokens.
    Turns without ``conv_id`` make one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, current, state, done = codec(path), object(), None, []
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_loss_tokens", pa.int64())])

        def close():
            if state is not None:
                done.append({"conv_id": current, "n_turns": state["n"], "turns_sha256": state["turns"].hexdigest(), "loss_chars": state["chars"], "loss_sha256": state["loss"].hexdigest(), "formatted_chars": state["all"], "n_tokens": state["tokens"], "n_loss_tokens": state["counted"]})

        for batch in batches:
            for conv, ids, border in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "border"))):
                if state is None or conv != current:
                    close()
                    current, state = conv, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "all": 0, "tokens": 0, "counted": 0, "open": 0}
                ids = np.frombuffer(ids, np.uint32)
                sums = state["open"] + np.cumsum(np.frombuffer(border, np.int8).astype(np.int64))
                mask = sums > 0
                state["open"] = int(sums[-1]) if len(sums) else state["open"]
                for role, text in own.turns(ids):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode("utf-8"))
                lost = unescape(own.read(ids[mask]))
                state["loss"].update(lost.encode("utf-8"))
                state["chars"] += len(lost)
                state["all"] += len(own.text(ids))
                state["tokens"] += len(ids)
                state["counted"] += int(mask.sum())
            if len(done) >= 1024:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    spark = parts.sparkSession
    dealt = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id").sortWithinPartitions("conv_id", "turn", "ids")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long")


def digests(turns: DataFrame, path: str) -> DataFrame:
    return assembled(formatted(turns, path), path)
