"""Byte-level BPE as a monoid: halves are encoded apart and joined at their border.

``encode`` of a text longer than a leaf encodes both halves recursively. Joining two
neighbours re-encodes a window around the border and keeps the ids outside it. The
window grows until both its ends are stable, places where a match of the pattern begins
whatever stands further left or right: white space behind another character, and a
letter, digit or sign behind a character of another of these classes (but for a letter
behind an apostrophe), since no alternative of the pattern holds such a pair. So the
ids outside such a window are those of the whole text. A range without such a place is
encoded at once. Decoding concatenates the bytes up the same kind of tree.

Null texts count as empty and have no ids. Texts may be of any length: a run of white
space longer than LONG_RUN, on which the library's matching gives out, is one piece by
the pattern and is handed over as such. Rows that repeat get equal results, there are
no ties, and other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

LEAF_CHARS = 2048
LEAF_IDS = 2048
WINDOW_CHARS = 32
LONG_RUN = 10_000
#: What the pattern's library takes for white space.
RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


@lru_cache(maxsize=4)
def load(path: str, pattern: str):
    """The encoder of a rank file and the bytes of each id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    table = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        table[rank] = piece
    encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def whole(text: str) -> list[int]:
        if len(text) <= LONG_RUN:
            return encoder.encode_ordinary(text)
        ids, at = [], 0
        for m in RUN.finditer(text):
            end = m.end() - (m.end() < len(text))  # the last one may begin the next match
            ids += encoder.encode_ordinary(text[at : m.start()]) + encoder._encode_single_piece(text[m.start() : end].encode())
            at = end
        return ids + encoder.encode_ordinary(text[at:])

    return whole, table


@lru_cache(maxsize=1 << 16)
def kind(c: str) -> str:
    """L, N, S (a sign) or nothing for white space and for what is not assigned."""
    major = unicodedata.category(c)[0]
    return "" if c.isspace() or major == "C" or major == "Z" else major if major in "LN" else "S"


def stable(text: str, i: int) -> bool:
    """Whether a match of the pattern begins at i in any context."""
    c, before = text[i], text[i - 1]
    if c in " \n":
        return not before.isspace()
    a, b = kind(before), kind(c)
    return bool(a and b) and a != b and not (before == "'" and b == "L")


def left_end(text: str, first: int, border: int, width: int) -> int:
    for i in range(border, max(first, border - width), -1):
        if i < len(text) and stable(text, i):
            return i
    return first if border - width <= first else -1


def right_end(text: str, border: int, last: int, width: int) -> int:
    for i in range(border, min(last, border + width)):
        if stable(text, i):
            return i
    return last if border + width >= last else -1


def count_back(ids: list[int], table: list[bytes], size: int) -> int:
    n = 0
    while size > 0:
        n += 1
        size -= len(table[ids[-n]])
    if size < 0:
        raise AssertionError("a token crosses a stable place")
    return n


def count_on(ids: list[int], table: list[bytes], size: int) -> int:
    n = 0
    while size > 0:
        size -= len(table[ids[n]])
        n += 1
    if size < 0:
        raise AssertionError("a token crosses a stable place")
    return n


def window(text: str, first: int, border: int, last: int) -> tuple[int, int]:
    """Stable ends around the border, or the ends of the range."""
    width, s = WINDOW_CHARS, -1
    while (s := left_end(text, first, border, width)) < 0:
        width *= 2
    if s == border:
        return s, s
    width, e = WINDOW_CHARS, -1
    while (e := right_end(text, border, last, width)) < 0:
        width *= 2
    return s, e


def join(text: str, s: int, border: int, e: int, left: list[int], right: list[int], encode_text, table) -> list[int]:
    """Ids of a range from those of its parts at both sides of the border, encoding text[s:e] again."""
    if s == e:
        return left + right
    drop = count_back(left, table, len(text[s:border].encode()))
    skip = count_on(right, table, len(text[border:e].encode()))
    return left[: len(left) - drop] + encode_text(text[s:e]) + right[skip:]


def encode(text: str, encode_text, table, leaf: int = LEAF_CHARS) -> list[int]:
    def over(first: int, last: int) -> list[int]:
        if last - first <= leaf:
            return encode_text(text[first:last])
        border = (first + last) // 2
        s, e = window(text, first, border, last)
        if (s, e) == (first, last):
            return encode_text(text[first:last])
        return join(text, s, border, e, over(first, border), over(border, last), encode_text, table)

    return over(0, len(text))


def decode(ids: list[int], table: list[bytes], leaf: int = LEAF_IDS) -> bytes:
    def over(first: int, last: int) -> bytes:
        if last - first <= leaf:
            return b"".join([table[i] for i in ids[first:last]])
        middle = (first + last) // 2
        return over(first, middle) + over(middle, last)

    return over(0, len(ids))


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of every whole text."""

    def make():
        encode_text, table = load(path, pattern)
        return lambda text: (encode(text, encode_text, table),)

    return map_texts(docs, make, "ids array<int>")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, number of ids, and the hashes of the ids and of the bytes decoded from them."""

    def make():
        encode_text, table = load(path, pattern)

        def kernel(text: str) -> tuple:
            ids = encode(text, encode_text, table)
            back = decode(ids, table)
            return len(ids), hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()

        return kernel

    return map_texts(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string")
