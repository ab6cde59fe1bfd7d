"""License scans: Aho-Corasick over words, shunting-yard over licence expressions.

``scan`` gives one row per document. All phrases (the base ones, notices and the
tags that introduce an expression) are found in one pass of an Aho-Corasick
automaton over the lower-cased words of the whole text. Behind a tag's place a colon or
equals sign must follow, perhaps a quote, and then the longest valid expression up to
the next tag or the end of the line is parsed with a shunting-yard parser and evaluated
with ``or`` as the best, ``and`` as the worst of its parts and ``with`` as an exception
that lifts a copyleft licence. A version's ``.0`` is left out of an expression's labels,
so they agree with those of phrases.

Nulls and empty texts have no words, no places, no labels and score 0. Texts may be of
any length: time grows with the text and its places. Labels are sets, so ties and
repeated places add nothing. Rows that repeat get equal results. Other columns of the
input are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from .common import map_texts

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices that the scan adds: phrase to label.
NOTICES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "released into the public domain": "public-domain",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4 0": "cc-by",
    "all rights reserved": "proprietary",
}

#: Words that introduce a licence expression, and what stands between them and it.
TAGS = ("spdx license identifier", "license expression")
BEHIND_TAG = re.compile(rb"[\"'`]?[ \t]*[:=][ \t]*[\"'`]?")

#: How freely a text under the licence can be used again, by the start of its label; 0.5 if unknown.
FREEDOM = {
    "public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0, "0bsd": 1.0,
    "mit": 0.95, "isc": 0.95, "bsd": 0.9, "apache": 0.9, "cc-by-sa": 0.6, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "cc-by": 0.85,
    "mpl": 0.7, "epl": 0.65, "lgpl": 0.6, "agpl": 0.3, "gpl": 0.4, "proprietary": 0.0,
}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+|\S")
LINE_END = re.compile(rb"[\r\n]|\Z")
WORD = re.compile(rb"[^ ]+")
ZERO = re.compile(r"(?<=-)([0-9]+)\.0(?=[+-]|$)")

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def freedom(label: str) -> float:
    return max(((len(k), v) for k, v in FREEDOM.items() if label.startswith(k)), default=(0, 0.5))[1]


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the expression in postfix order, None if it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in TOKEN.findall(expression):
        word = token.lower()
        if token == "(":
            if not operand_next:
                return None
            stack.append(token)
        elif token == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif word in PRECEDENCE:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_next = True
        else:
            if not operand_next or not re.match(r"[a-z0-9]", word):
                return None
            out.append(word)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def leading(text: str, start: int = 0, stop: int | None = None) -> str:
    """The longest valid expression that text begins with; a stop, colon or dash at the end of an operand ends it."""
    end, depth, operand_next = start, 0, True
    for m in TOKEN.finditer(text, start, len(text) if stop is None else stop):
        token = m[0]
        word = token.lower()
        if token == "(":
            if not operand_next:
                break
            depth += 1
            continue
        if token == ")":
            if operand_next or not depth:
                break
            depth -= 1
            last, ends = m.end(), False
        elif word in PRECEDENCE:
            if operand_next:
                break
            operand_next = True
            continue
        else:
            bare = word.rstrip(".:-")
            if not operand_next or not re.match(r"[a-z0-9]", bare):
                break
            operand_next = False
            last, ends = m.start() + len(bare), bare != word
        if not depth:
            end = last
        if ends:
            break
    return text[start:end]


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels of a parsed expression and how freely it allows use again."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            stack.append(({ZERO.sub(r"\1", token)}, freedom(token)))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        if token == "with":
            stack.append(({f"{x}-with-{y}" for x in left for y in right}, max(a, 0.6) if a > 0 else a))
        else:
            stack.append((left | right, max(a, b) if token == "or" else min(a, b)))
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, phrases in (("notice", NOTICES), ("base", BASE), ("tag", dict.fromkeys(TAGS))):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, phrase.count(" ") + 1))
    found.make_automaton()
    return found


def kernel(found: ahocorasick.Automaton):
    def scan_text(text: str) -> tuple:
        data = text.encode("utf-8", "surrogatepass")
        spaced = data.translate(_WORDS)
        words = spaced.split()
        line = b" " + b" ".join(words) + b" "
        places: list[int] = []
        base: set[str] = set()
        labels: set[str] = set()
        worst: list[float] = []
        tags: list[tuple[int, int]] = []
        at = spaces = 0
        for end, (kind, label, size) in found.iter(line.decode("latin-1")):
            spaces += line.count(b" ", at, end + 1)
            at = end + 1
            first = spaces - size - 1  # the word before which as many spaces stand as words, and one
            if kind == "tag":
                tags.append((first, first + size - 1))
                continue
            labels.add(label)
            worst.append(freedom(label))
            if kind == "base":
                base.add(label)
                places.append(first)
        expressions = 0
        if tags:
            asked = {w for tag in tags for w in tag}
            at_word = {i: m.span() for i, m in enumerate(WORD.finditer(spaced)) if i in asked}
            for k, (_, last) in enumerate(tags):
                after = at_word[tags[k + 1][0]][0] if k + 1 < len(tags) else len(data)
                if (sign := BEHIND_TAG.match(data, at_word[last][1], after)) is None:
                    continue
                behind = data[sign.end() : LINE_END.search(data, sign.end(), after).start()]
                postfix = to_postfix(leading(behind.decode("utf-8", "replace")))
                if postfix:
                    own, score = evaluate(postfix)
                    labels |= own
                    worst.append(score)
                    expressions += 1
        return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(worst, default=0.0), expressions)

    return scan_text


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_expressions long"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and places of base phrases, all labels and the score of every document."""
    return map_texts(docs, lambda: kernel(automaton()), FIELDS)
