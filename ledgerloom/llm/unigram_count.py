"""Token counts of a unigram vocabulary without building the tokens.

Text is cut at blanks (U+0020, each made the marker U+2581 that begins a piece).  Within such a word the
best-scoring segmentation is found by dynamic programming over the matches that an Aho-Corasick automaton
lists; each position carries only the best score and the pieces so far.  The rules are those of the public
``tokenizers`` library's Unigram model, so counts equal the lengths of its encodings:

* a candidate replaces the best so far only if its score is strictly greater; candidates arrive by
  ascending start, so of equal scores the one with the longest last piece stays;
* where no single-character piece starts, that character may be unknown at the lowest score less 10;
* adjacent unknown characters fuse: one unknown token, or with ``byte_fallback`` a token for each byte.

Defined results: null and empty texts have 0 tokens, words and unknowns and score 0; texts are taken
whole; equal texts have equal counts, repeated rows each have theirs; ties follow the rules above; bytes that
aren't UTF-8 become U+FFFD; an empty table gives no rows; of the input's columns only the id is returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, as_bytes, text_bytes

MARKER = "▁"
MAX_PIECES = 1_000_000
_PENALTY = 10.0


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if len(model) > MAX_PIECES:
        raise ValueError(f"{path} has more than {MAX_PIECES} pieces")
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(len(model))]


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0, byte_fallback: bool = True):
        scores = dict(pieces)
        self.unknown_score = min(s for _, s in pieces) - _PENALTY
        self.known = frozenset(scores)
        self.longest = max(map(len, scores))
        self.bytes_known = byte_fallback and all(f"<0x{b:02X}>" in scores for b in range(256))
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score, piece == pieces[unknown][0]))
        self.automaton.make_automaton()
        self.memo = Memo(lambda word: self.word(MARKER + word))

    def word(self, word: str) -> tuple[int, int, float]:
        """Tokens, unknown tokens (or bytes of fallback) and best score of one word with its marker.

        The automaton lists matches by end and, of equal ends, by ascending start, which is the order in
        which candidates must be tried.
        """
        n, unknown_score = len(word), self.unknown_score
        best, tokens = [0.0] * (n + 1), [0] * (n + 1)
        unknowns: list[int] = []  # filled from the first unknown character on
        run: list[int] = []  # where the unknown characters that end here begin
        place, top, at, single, unknown = 1, None, 0, False, False
        matches = self.automaton.iter(word)
        end, (length, score, is_unknown) = next(matches, (n, (0, 0.0, False)))
        while place <= n:
            while end + 1 == place:
                found = best[place - length] + score
                if top is None or found > top:
                    top, at, unknown = found, place - length, is_unknown
                if length == 1:
                    single = True
                end, (length, score, is_unknown) = next(matches, (n, (0, 0.0, False)))
            if not single:
                found = best[place - 1] + unknown_score
                if top is None or found > top:
                    top, at, unknown = found, place - 1, True
            best[place] = top
            if unknown and not run:
                unknowns, run, size = [0] * (n + 1), [-1] * (n + 1), [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in word)]
            if unknown:
                begin = run[place] = run[at] if run[at] >= 0 else at
                one = not self.bytes_known or (place - begin <= self.longest and word[begin:place] in self.known)
                cost = 1 if one else size[place] - size[begin]
                tokens[place], unknowns[place] = tokens[begin] + cost, unknowns[begin] + cost
            else:
                tokens[place] = tokens[at] + 1
                if run:
                    unknowns[place] = unknowns[at]
            place, top, single, unknown = place + 1, None, False, False
        return tokens[n], unknowns[n] if run else 0, best[n]

    def count(self, text: str) -> tuple[int, int, int, float]:
        """Tokens, words, unknown tokens and the score of a whole text."""
        if not text:
            return 0, 0, 0, 0.0
        words = text.replace(MARKER, " ").split(" ")
        if not words[0] and len(words) > 1:
            words = words[1:]  # a text that begins with a marker gets no other
        young, of = self.memo.young.get, self.memo.of
        got = [young(w) or of(w) for w in words]
        tokens, unknowns, scores = zip(*got, strict=True)
        return sum(tokens), len(words), sum(unknowns), float(sum(scores))


_built: dict[str, UnigramCounter] = {}


def _counter(key: str, pieces: list, byte_fallback: bool) -> UnigramCounter:
    if key not in _built:
        _built.clear()
        _built[key] = UnigramCounter(pieces, byte_fallback=byte_fallback)
    return _built[key]


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", byte_fallback: bool = True) -> DataFrame:
    """Per document: id, ``n_tokens``, ``n_pieces_words``, ``n_unknown`` and ``score`` of the best segmentation."""
    pieces = read_pieces(path)
    key = hashlib.sha256(repr((pieces, byte_fallback)).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((key, pieces, byte_fallback))  # at most MAX_PIECES pieces
    kind = pa.struct([("n_tokens", pa.int64()), ("n_words", pa.int64()), ("n_unknown", pa.int64()), ("score", pa.float64())])

    @F.arrow_udf("struct<n_tokens:bigint,n_words:bigint,n_unknown:bigint,score:double>")
    def counted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(*shared.value)
        for batch in texts:
            rows = [counter.count(as_bytes(x.as_py()).decode("utf-8", "replace")) for x in batch]
            yield pa.array([dict(zip(kind.names, r, strict=True)) for r in rows], kind)

    return docs.select(id_column, counted.asNondeterministic()(text_bytes(text_column)).alias("__n")).select(id_column, "__n.*")
