"""Token counts under a unigram model, computed once per distinct pre-token.

Distinct pre-tokens go into a trie. The best score of a prefix (the sum of the log
probabilities of its pieces) is computed when its node is made and shared by all
pre-tokens that begin with it; the node of a whole pre-token stores its number of
pieces. A document's count is the sum over its pre-tokens.

The pieces come from the vocabulary of a public tokenizer file; their probabilities
follow Zipf's law in the order of the vocabulary, so nothing is trained. A character
that no piece covers costs one byte piece for each of its UTF-8 bytes. Ties of score
go to fewer pieces.

The file's own scores are no log probabilities (the pieces were merged, and a score is
the negative rank of the merge), hence the rule in their place.

Pre-tokens are what stands between white space, each with the vocabulary's mark of a
word's begin in front. Those longer than LONG_WORD share no prefixes: the same scores run
over them in a window of the longest piece's length, so a text may be one word of any
length. Null and empty texts have no pre-tokens and no tokens; rows
that repeat get equal results; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_texts

MARK = "▁"
#: A task's trie begins anew beyond this many nodes, so memory stays bounded.
MAX_NODES = 1_000_000
#: Longer pre-tokens stay out of the trie.
LONG_WORD = 4096
#: Log probability of a byte piece.
BYTE_SCORE = -16.0
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, float]:
    """Pieces and their log probabilities by Zipf's law over the ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    norm = math.log(sum(1 / (r + 2) for r in range(len(pieces))))
    return {p: -math.log(r + 2) - norm for r, p in enumerate(pieces)}


class Window:
    """Numbers of the last `size` prefixes of one word."""

    def __init__(self, size: int):
        self.size = size

    def __getitem__(self, end: int) -> int:
        return end % self.size


class Trie:
    """Nodes by number, edges in one table by node and character; node 0 is the empty prefix."""

    def __init__(self, scores: dict[str, float], max_nodes: int = MAX_NODES, mark: str = ""):
        self.scores, self.max_nodes, self.mark = scores, max_nodes, mark
        lengths: dict[str, set[int]] = {}
        for piece in scores:
            lengths.setdefault(piece[-2:], set()).add(len(piece))
        #: Lengths of pieces by their last two characters (one, for pieces of one).
        self.lengths = {tail: sorted(n) for tail, n in lengths.items()}
        self.longest = max(map(len, scores), default=1)
        self.counts: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.edges: dict[int, int] = {}
        self.best = array("d", [0.0])
        self.pieces = array("l", [0])
        self.counts.clear()

    def count(self, word: str) -> int:
        """Number of pieces of the best segmentation of the word behind the mark; stored for its terminal node."""
        if (known := self.counts.get(word)) is not None:
            return known
        if len(word) > LONG_WORD:
            return self._long(self.mark + word)
        if len(self.best) > self.max_nodes:
            self.reset()
        edges, path, node, text = self.edges, [0], 0, self.mark + word
        best, pieces = self.best, self.pieces
        for i, c in enumerate(text):
            edge = node << 21 | ord(c)
            child = edges.get(edge)
            if child is None:
                top, fewest = self._score(text, i + 1, path, best, pieces)
                child = edges[edge] = len(best)
                best.append(top)
                pieces.append(fewest)
            node = child
            path.append(node)
        self.counts[word] = n = self.pieces[node]
        return n

    def _long(self, text: str) -> int:
        path = Window(self.longest + 1)
        best, pieces = [0.0] * path.size, [0] * path.size
        for end in range(1, len(text) + 1):
            best[path[end]], pieces[path[end]] = self._score(text, end, path, best, pieces)
        return pieces[path[len(text)]]

    def _score(self, word: str, end: int, path, best, pieces) -> tuple[float, int]:
        """Best score of the prefix, and its number of pieces, from those of shorter prefixes at path."""
        scores = self.scores
        before, c = path[end - 1], word[end - 1]
        s = scores.get(c)
        n_bytes = len(c.encode("utf-8", "surrogatepass"))
        top, fewest = best[before] + n_bytes * BYTE_SCORE, pieces[before] + n_bytes
        if s is not None and best[before] + s >= top:
            fewest = pieces[before] + 1 if best[before] + s > top else min(fewest, pieces[before] + 1)
            top = best[before] + s
        if end > 1:
            for length in self.lengths.get(word[end - 2 : end], ()):
                if length > end:
                    break
                s = scores.get(word[end - length : end])
                if s is not None:
                    at = path[end - length]
                    total = best[at] + s
                    if total > top or total == top and pieces[at] + 1 < fewest:
                        top, fewest = total, pieces[at] + 1
        return top, fewest


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, number of pre-tokens and of tokens of every whole text."""

    def make():
        trie = Trie(vocabulary(path), mark=MARK)
        known, count = trie.counts, trie.count

        def kernel(text: str) -> tuple:
            words = SPACE.findall(text)
            total = 0
            for w in words:
                n = known.get(w)
                total += count(w) if n is None else n
            return len(words), total

        return kernel

    return map_texts(docs, make, "n_pretokens long, n_tokens long")
