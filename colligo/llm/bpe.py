"""Byte-pair encoding as a bounded-lookahead transducer, and decoding as a state machine.

For every prefix of a word there is one token that ends its encoding.  It can be found from the last
tokens of shorter prefixes alone: of the tokens that end there, it is the one that may follow its
predecessor, which holds if that pair of tokens is its own encoding.  So the transducer reads a word
once and keeps, for each place, the last token.  A token is emitted as soon as the merge list's
sufficient lookahead lies behind its end: nothing that follows can change it then.  Memory depends on
the merge list, not on the length of a word or of a text, which is read a piece at a time.

A short word needs no emission before its end, so the transducer looks only at the places where its
last tokens can begin, and remembers them for all words that begin alike, as it does whole words.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import itertools
import json
import struct
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

_V = TypeVar("_V")

#: Unicode's white space, as the normaliser's pattern has it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Most keys in each of a process's memories (short texts between white space, words, words' beginnings), and the letters of the longest.
REMEMBERED, SHORT = 600_000, 128
#: Most bytes of a word that is looked at from its end; longer ones are read from their beginning.
BACKWARD = 64
#: Letters of a key up to which as many are remembered; longer ones take the room of several.
USUAL = 16
#: Tokens of a long word that are handed on together.
PIECE = 1 << 14
#: Letters of a text that are normalised at once.
READ = 1 << 16
#: Letters that decide which part of the pattern a pre-token matches: more than its longest part of fixed length has.
HEAD = 16


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary: itself if it is visible, else the next from U+0100."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class Remembered(dict[str, _V]):
    """Values by key, made when first asked for; of ``most`` keys at most (fewer if they are longer than ``USUAL``), those asked for lately are kept.

    Keys are in two halves: when the newer one is full, it takes the place of the older one, whose keys come back when asked for.
    """

    def __init__(self, make: Callable[[str], _V], most: int):
        super().__init__()
        self.make, self.half, self.older = make, most // 2 * USUAL, {}
        self.room = self.half

    def __missing__(self, key: str) -> _V:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if self.room <= 0:
            self.older, self.room = dict(self), self.half
            self.clear()
        self.room -= len(key) if len(key) > USUAL else USUAL
        self[key] = value
        return value


class Bpe:
    """The tokenizer of a file of the kind ``word_bpe_49k.json``: word ends are marked, white space is dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.surface = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for text, i in (self.vocab | self.special).items():
            self.surface[i] = text
        self.raw = [t.encode("utf-8") for t in self.surface]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}"))
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        # A token's letters: those of its text, where the last may carry the word's end.
        self.length = {t: len(self._symbols(t)) for t in self.vocab}
        self.longest = max(self.length.values())
        self.made = {a + b: (i, a, b) for (a, b), i in self.rank.items()}
        if len(self.made) < len(self.rank) or any(self.made.get(part, (-1,))[0] >= i for pair, i in self.rank.items() for part in pair):
            raise ValueError("a merge comes before one that makes its parts, or makes what another makes")
        self.lookahead = self._sufficient_lookahead()
        self._letter = (-1, "", "")
        self._whole: dict[str, bool] = {}
        self._follows: dict[tuple[str, str], bool] = {}
        # Ends of tokens, with the letters of those that are tokens and their own encoding, else 0.
        self.tails = {"".join(symbols[i:]): 0 for symbols in map(self._symbols, self.vocab) for i in range(len(symbols))}
        self.tails |= {t: n for t, n in self.length.items() if self._alone(t)}
        # Words' beginnings with their last token and their ids; ids of short words, and of short texts between white space.
        self.packed = {t: struct.pack("<I", i) for t, i in self.vocab.items()}
        self._states = Remembered(lambda text: self._ending(text, len(text)), REMEMBERED)
        self._words = Remembered(self._short, REMEMBERED)
        self._known = Remembered(self._short_text, REMEMBERED)

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _sufficient_lookahead(self) -> int:
        """Letters read behind a token's end after which the token is final.

        Compare the merges of a word with those of a beginning of it, rank by rank.  Both have the same
        tokens up to some place, at first the beginning's end.  Only a merge across that place can move it,
        to the left by its left part, after which the token right of the place starts with that part.  So the
        merges that move it have rising ranks, each one's right part starting with the left part before,
        and the weightiest such chain of left parts is as far as the place can ever move.
        """
        moved: dict[str, int] = {}
        most = 0
        for left, right in self.rank:
            before, part = 0, right
            while part is not None:
                before = max(before, moved.get(part, 0))
                made = self.made.get(part)
                part = made[1] if made else None
            far = self.length[left] + before
            moved[left] = max(moved.get(left, 0), far)
            most = max(most, far)
        return most

    def follows(self, left: str, right: str) -> bool:
        """Whether two tokens are the encoding of their letters: no merge ever joins across their border."""
        known = self._follows.get((left, right))
        if known is None:
            if len(self._follows) >= 1 << 20:
                self._follows.clear()
            known = self._follows[left, right] = self._apart(left, right)
        return known

    def _apart(self, a: str, b: str) -> bool:
        # Back in time: what stands at the border's sides now was there until the later of the two
        # was made.  A merge across the border is due if it comes before that; of equal merges the
        # leftmost is first.
        until, right_made = 1 << 60, False
        while True:
            due = self.rank.get((a, b))
            if due is not None and (due < until or due == until and right_made):
                return False
            made_a, made_b = self.made.get(a, self._letter), self.made.get(b, self._letter)
            if made_a[0] < 0 and made_b[0] < 0:
                return True
            if made_a[0] > made_b[0]:
                (until, _, a), right_made = made_a, False
            else:
                (until, b, _), right_made = made_b, True

    def _alone(self, token: str) -> bool:
        """Whether a token is the encoding of its own letters: its two parts are, and come together first."""
        known = self._whole.get(token)
        if known is None:
            made = self.made.get(token)
            if made is None:
                known = self.length[token] == 1
            else:
                # Until this merge, the parts stand side by side as they would without it.
                rank, left, right = made
                del self.rank[left, right]
                known = self._alone(left) and self._alone(right) and self._apart(left, right)
                self.rank[left, right] = rank
            self._whole[token] = known
        return known

    def _last(self, text: str, most: int, n: int, last: list[str | None], before_all: str | None, ended: bool) -> str | None:
        """The token that ends the encoding of ``n`` symbols.

        ``text`` ends with ``most`` of them at least, and with the word's end if ``ended``; ``last`` has
        the shorter ends.
        """
        for token in self._tokens_at_end(text, most, len(text) - (len(self.end) if ended else 0)):
            size = self.length[token]
            before = last[n - size] if n > size else before_all
            if before is None and n > size:
                continue
            if before is None or self.follows(before, token):
                return token
        return None

    def _tokens_at_end(self, text: str, most: int, letters: int) -> list[str]:
        """The tokens of ``most`` symbols at most that end a text, long ones first: of them one fits at most, mostly a long one.

        ``letters`` is the text's length without a word's end.
        """
        tails, ending = self.tails, []
        for size in range(1, most + 1):
            token = text[letters - size :]
            known = tails.get(token)
            if known is None:
                break
            if known == size:
                ending.append(token)
        ending.reverse()
        return ending

    def transduce(self, symbols: Iterable[str], step: int | None = None) -> Iterator[int]:
        """The ids of one word's symbols, each as soon as no further symbol can change it.

        ``last[k]`` is the token that ends the encoding of the first ``k`` symbols of the window.  Every
        ``step`` symbols the tokens that end the lookahead or more before the last symbol are emitted and
        leave the window, which so never holds more than the lookahead, a token and a step.
        """
        longest, lookahead, step = self.longest, self.lookahead, step or self.longest
        window, n = "", 0
        last: list[str | None] = [None]
        base_text: str | None = None
        for read, symbol in enumerate(symbols, 1):
            window, n, ended = window + symbol, n + 1, len(symbol) > 1
            last.append(self._last(window, min(n, longest), n, last, base_text, ended))
            if n > lookahead and read % step == 0 and not ended and (emitted := self._path(last, n, n - lookahead)):
                for t in emitted:
                    yield self.vocab[t]
                gone = sum([self.length[t] for t in emitted])
                window, last = window[gone:], [None, *last[gone + 1 :]]
                base_text, n = emitted[-1], n - gone
        for t in self._path(last, n, n):
            yield self.vocab[t]

    def _path(self, last: list[str | None], at: int, until: int) -> list[str]:
        """Of the tokens that encode the window's first ``at`` symbols, those that end at ``until`` or before."""
        out = []
        while at:
            token = last[at]
            if token is None:
                raise ValueError("the vocabulary lacks a letter")
            if at <= until:
                out.append(token)
            at -= self.length[token]
        return out[::-1]

    def _ending(self, text: str, n: int) -> tuple[str, bytes]:
        """The last token and the ids of a short word's beginning, or of a short word: ``n`` symbols.

        Of the places in it only those before a token that may be the last are looked at in turn.
        """
        for token in self._tokens_at_end(text, n, n):
            start = n - self.length[token]
            if not start:
                return token, self.packed[token]
            before, ids = self._states[text[:start]]
            if self.follows(before, token):
                return token, ids + self.packed[token]
        raise ValueError("the vocabulary lacks a letter")

    def _short(self, word: str) -> bytes:
        """A short pre-token's ids."""
        raw = word.encode("utf-8")
        if len(raw) > BACKWARD:
            return b"".join([struct.pack("<I", i) for i in self.word(word)])
        return self._ending(raw.decode("latin-1").translate(self.letters) + self.end, len(raw))[1]

    def _short_text(self, chunk: str) -> bytes:
        """The ids of a short text without white space; one that is a word is the same object in both memories."""
        words = self.pattern.findall(chunk)
        return self._words[chunk] if words == [chunk] else b"".join([self._words[w] for w in words])

    def word(self, word: str) -> Iterator[int]:
        """A pre-token's ids."""
        letters, raw = self.letters, word.encode("utf-8")
        return self.transduce(itertools.chain((letters[b] for b in raw[:-1]), (letters[raw[-1]] + self.end,)))

    def chunk(self, chunk: str) -> Iterator[bytes]:
        """The ids of a normalised text without white space, as little-endian unsigned 32-bit integers, piece by piece."""
        if len(chunk) <= SHORT:
            yield self._known[chunk]
        else:
            for m in self.pattern.finditer(chunk):
                if len(m[0]) <= SHORT:
                    yield self._words[m[0]]
                    continue
                ids = self.word(m[0])
                while piece := list(itertools.islice(ids, PIECE)):
                    yield struct.pack(f"<{len(piece)}I", *piece)

    def normalised(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text) if not text.isascii() else text
        # One letter at a time, for a final sigma has no form of its own here.
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text, piece by piece; special tokens in it keep their own ids.  '' has none."""
        at = 0
        if any(t in text for t in self.special):
            for m in self.split_special.finditer(text):
                yield from self._plain(text, at, m.start())
                yield struct.pack("<I", self.special[m[0]])
                at = m.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """The ids of a part of a text, cut behind white space, across which neither normalisation nor pre-tokens reach."""
        while at < end:
            stop = end
            if end - at > READ:
                space = _LAST_WHITE.search(text, at, at + READ)
                if space is None:
                    space = _WHITE.search(text, at + READ, end)
                    stop = space.start() if space else end
                    yield from self._stretch(text, at, stop)
                    at = stop
                    continue
                stop = space.end()
            yield from self._piece(text[at:stop])
            at = stop

    def _piece(self, text: str) -> Iterator[bytes]:
        chunks = split_space(self.normalised(text))
        all_short = max(map(len, chunks), default=0) <= SHORT
        for short, some in [(True, chunks)] if all_short else itertools.groupby(chunks, lambda c: len(c) <= SHORT):
            if short:
                yield b"".join(map(self._known.__getitem__, some))
            else:
                yield from itertools.chain.from_iterable(map(self.chunk, some))

    def _stretch(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """The ids of a long part without white space, normalised in pieces that begin where letters cannot compose."""

        def pieces() -> Iterator[str]:
            begin = at
            while begin < end:
                stop = min(begin + READ, end)
                while stop < end and not stands_alone(text[stop]):
                    stop += 1
                yield self.normalised(text[begin:stop])
                begin = stop

        def symbols(parts: Iterator[tuple[str, bool]]) -> Iterator[str]:
            held = None
            for part, ends in parts:
                for b in part.encode("utf-8"):
                    if held is not None:
                        yield self.letters[held]
                    held = b
                if ends:
                    yield self.letters[held] + self.end
                    return

        parts = self._parts(pieces())
        for first in parts:
            if first[1] and len(first[0]) <= SHORT:
                yield self._words[first[0]]
                continue
            ids = self.transduce(symbols(itertools.chain([first], parts)))
            while piece := list(itertools.islice(ids, PIECE)):
                yield struct.pack(f"<{len(piece)}I", *piece)

    def _parts(self, pieces: Iterator[str]) -> Iterator[tuple[str, bool]]:
        """The pre-tokens of a text that comes in pieces, long ones in parts; with each part whether its pre-token ends there.

        A match is sure if ``HEAD`` letters from its start are there and it ends before the last one.  One that
        reaches the last letter is a run: its first letters, before the next piece, match on as the whole would.
        """
        run = held = ""
        for piece in itertools.chain(pieces, [None]):
            text, begun, at = run + held + (piece or ""), len(run), 0
            run = held = ""
            while (m := self.pattern.search(text, at)) is not None:
                start, at = m.span()
                if piece is not None and len(text) - start < HEAD:
                    held = text[start:]
                    break
                going_on = piece is not None and at == len(text)
                yield text[max(start, begun) : at], not going_on
                if going_on:
                    run = text[start : start + HEAD]
                    break

    def decode(self, ids: Iterable[bytes]) -> Iterator[str]:
        """The text of ids piece by piece: their tokens' bytes with a space between, read into letters.

        The state is an incomplete letter's bytes and whether a token came before.
        """
        state, raw, first = codecs.getincrementaldecoder("utf-8")("strict"), self.raw, True
        for piece in ids:
            if piece:
                tokens = b" ".join([raw[i] for i in np.frombuffer(piece, "<u4").tolist()])
                yield state.decode(tokens if first else b" " + tokens)
                first = False
        yield state.decode(b"", True)

    def words_of(self, ids: Iterable[bytes]) -> Iterator[str]:
        """The words of ids as text, byte letters turned back: what the encoder was given, normalised, with a space after each word.

        Bytes that are no UTF-8 become the replacement character.
        """
        state, back = codecs.getincrementaldecoder("utf-8")("replace"), {c: bytes([b]) for b, c in enumerate(self.letters)}
        for k in (k for piece in ids for k in np.frombuffer(piece, "<u4").tolist()):
            token = self.surface[k]
            ends = token.endswith(self.end) and len(token) > len(self.end)
            body = token[: -len(self.end)] if ends else token
            yield state.decode(b"".join(back[c] for c in body) if k not in self.special.values() else body.encode()) + (" " if ends else "")
        yield state.decode(b"", True)


_WHITE, _LAST_WHITE = regex.compile(f"[{_SPACE}]+"), regex.compile(f"(?r)[{_SPACE}]")


@functools.cache
def _composing() -> frozenset[str]:
    """Letters that may compose with one before them: second ones of Unicode's pairs, and those of Hangul's syllables."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(sys.maxunicode + 1))
    return frozenset({chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"} | {chr(c) for c in range(0x1161, 0x11C3)})


def stands_alone(letter: str) -> bool:
    """Whether a text can be cut before a letter and normalised in two parts."""
    first = unicodedata.normalize("NFD", letter)[0]
    return letter.isascii() or unicodedata.combining(first) == 0 and first not in _composing()


def split_space(text: str) -> list[str]:
    """The parts of a text between white space.  Python's own split takes four control characters as space too."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [c for c in _WHITE.split(text) if c]
    return text.split()


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """The tokenizer of a file, read once in a process."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit integers), its tokens; a null text has none.

    Every executor reads the tokenizer's file from ``path``.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for piece in slices(batch, column):
                ids = [b"".join(bpe.encode(t)) for t in pc.fill_null(piece.column(column), "").to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(ids, pa.binary())], [*names, "ids"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("ids", T.BinaryType())]))


def digest(bpe: Bpe, text: str) -> tuple[int, str, str]:
    """The number of a text's tokens, the digest of its ids, and that of what they decode to.

    Ids are decoded as they come, so neither they nor the decoded text are ever held whole.
    """
    n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()

    def watched() -> Iterator[bytes]:
        nonlocal n
        for piece in bpe.encode(text):
            n += len(piece) // 4
            of_ids.update(piece)
            yield piece

    for part in bpe.decode(watched()):
        of_text.update(part.encode("utf-8"))
    return n, of_ids.hexdigest(), of_text.hexdigest()


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each text; null and empty texts have no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for piece in slices(batch, "text"):
                rows = []
                for t in pc.fill_null(piece.column("text"), "").to_pylist():
                    rows.append(digest(bpe, t))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(run, out)
