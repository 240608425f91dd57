"""Secrets in text: base patterns, and novelty against what is around and what is known.

A string in a sensitive context is novel if it costs many bytes to add to its surroundings: the
surroundings are compressed with and without it, both times with a dictionary of identifiers.  What
repeats known names or the code around it costs little; random strings cost nearly their length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

KINDS = ["assign", "access", "hex", "novel"]
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of hex digits that are long enough; a shorter run fails as a whole.
_HEX = re.compile(r"[0-9a-f]{24,}")
#: One of these among the last CONTEXT words before a string makes its context sensitive (fixed values).
SENSITIVE = set(
    """api apikey auth authentication authorization authtoken bearer cert certificate client cookie cookies cred creds credential credentials
    hmac jwt key keys login nonce oauth pass passcode passphrase passwd password passwords private pwd salt secret secrets session sign signature
    signing token tokens webhook""".split()
)
#: Words of code and prose: runs of letters, cut where a capital begins a word.
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
CONTEXT = 24
_IN_STRING = re.compile(r"[A-Za-z0-9+/_=-]+")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Names and parts of words that prime the compressor (fixed values).
IDENTIFIERS = """
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 xxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXX example placeholder
changeme your_key_here your-api-key-here YOUR_ACCESS_TOKEN insert_here undefined null none true false default value string number object function return
public static private final class import export from const async await self this args kwargs config settings environment variable getenv process
username password client_id client_secret access_token refresh_token authorization authentication credential certificate signature session cookie
request response header content application json http https localhost database connection host port user index length result error message
created_at updated_at timestamp identifier uuid version release module package service manager controller handler factory provider
getElementById addEventListener querySelector innerHTML toString valueOf hasOwnProperty prototype constructor
the and that with have this will your from they know want been good much some time very when come here just like long make many more only over
ability able ance another around ation back before between brown character circum consider counter could development different electro ement
ence environment every first found government great ically ification ility important ing inter ious ishment ization jumps large less little
lution ment micro might multi ness never nothing ology ously other people place point present quick right should sion small something state
still super tele their there these thing think those thought three through tion trans under water where which while whole without work world
""".split()
#: Characters of the surroundings on either side, the least marginal bytes, and the least for each
#: character of a string with digits and of one of letters alone, which may be a rare word.
AROUND, LEAST, SHARE, OF_LETTERS = 256, 14, 0.7, 0.95


@cache
def _compressor(words: tuple[str, ...]) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=19)  # digested once, not for each string
    return zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_dict_id=False)


@lru_cache(1 << 14)
def _packed_size(text: str, words: tuple[str, ...]) -> int:
    return len(_compressor(words).compress(text.encode("utf-8", "replace")))


def marginal_bytes(value: str, before: str, after: str, words: tuple[str, ...] = tuple(IDENTIFIERS)) -> int:
    """What ``value`` adds to its compressed surroundings, from which its own copies are left out.

    Sizes are remembered, a bounded number of them: strings that repeat in like surroundings are measured once.
    """
    # With the names in front, a short text too is compressed rather than stored as it is.
    around = " ".join(words) + "\n" + before.replace(value, "") + "\n" + after.replace(value, "") + "\n"
    return _packed_size(around + value, words) - _packed_size(around, words)


def around(text: str, start: int, end: int) -> tuple[str, str]:
    """What is on either side of a string: AROUND characters without other strings with digits, and without what is left of one at their ends.

    Copies of a secret, and other secrets in a list of them, would make it cheap.
    """
    low, high = max(0, start - AROUND), min(len(text), end + AROUND)
    if low and _IN_STRING.match(text[low - 1]) and (cut := _IN_STRING.match(text, low, start)):
        low = cut.end()
    while end < high < len(text) and _IN_STRING.match(text[high]) and _IN_STRING.match(text[high - 1]):
        high -= 1
    with_digits = lambda m: "" if any(map(str.isdigit, m[0])) else m[0]
    return _CANDIDATE.sub(with_digits, text[low:start]), _CANDIDATE.sub(with_digits, text[end:high])


def _words(text: str) -> Iterator[tuple[int, bool]]:
    """Where each word of a text ends, and whether it is a sensitive one."""
    at = 0
    for m in _CANDIDATE.finditer(text):
        if any(map(str.isdigit, m[0])):
            yield from ((w.end(), w[0].lower() in SENSITIVE) for w in _WORD.finditer(text, at, m.start()))
            yield m.end(), any(part.lower() in SENSITIVE for part in re.split("[^A-Za-z]+", m[0]))
            at = m.end()
    yield from ((w.end(), w[0].lower() in SENSITIVE) for w in _WORD.finditer(text, at))


class Contexts:
    """Where the sensitive words of a text are, whole words or parts of names in code, counted in words; a long string with digits is one word."""

    def __init__(self, text: str):
        self.ends, self.said, last = [], [], -(1 << 30)
        for i, (end, said) in enumerate(_words(text)):
            last = i if said else last
            self.ends.append(end)
            self.said.append(last)

    def sensitive(self, at: int) -> bool:
        """Whether one is among the last CONTEXT words that end at ``at`` or before."""
        n = bisect_right(self.ends, at)
        return n > 0 and self.said[n - 1] >= n - CONTEXT


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the base patterns' matches, leftmost and not overlapping within a kind; none for an empty text."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def novel_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Strings of 16 characters or more, with a letter, that are novel where they stand and no base span covers.

    Bare numbers are none: in prose they are amounts, dates and the like.
    """
    out, borders, at, contexts = [], sorted((s, e) for _, s, e in base), 0, None
    for m in _CANDIDATE.finditer(text):
        while at < len(borders) and borders[at][1] <= m.start():
            at += 1
        value = m[0]
        if at < len(borders) and borders[at][0] < m.end() or not any(map(str.isalpha, value)):
            continue
        share = SHARE if any(map(str.isdigit, value)) else OF_LETTERS
        contexts = contexts or Contexts(text)
        if contexts.sensitive(m.start()) and marginal_bytes(value, *around(text, m.start(), m.end())) >= max(LEAST, share * len(value)):
            out.append(("novel", m.start(), m.end()))
    return out


def rendered(spans: list[tuple[str, int, int]]) -> str:
    """The spans as ``kind:start:end``, by start, then kind as listed, joined by commas; '' for none."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel, found`` of each text.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind; ``found`` has
    their strings in that order.  A null or empty text has none.
    """
    # What a text must have for its patterns to be tried one by one.
    hint = r"[:=]|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_=-]{16}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                texts = pc.fill_null(piece.column("text"), "")
                rows = []
                for t, worth in zip(texts.to_pylist(), pc.match_substring_regex(texts, hint).to_pylist()):
                    base = base_spans(t) if worth else []
                    more = novel_spans(t, base) if worth else []
                    n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                    every = sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
                    rows.append((*n, hashlib.sha256(rendered(base).encode()).hexdigest(), rendered(every), len(more), [t[s:e] for _, s, e in every]))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel", "found"])

    fields = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType()), ("n_novel", T.LongType()), ("found", T.ArrayType(T.StringType()))]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *[T.StructField(n, t) for n, t in fields]]))
