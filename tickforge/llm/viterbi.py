"""Token counts of a unigram vocabulary by a Viterbi pass that keeps scores and counts only."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import inf, log
from pathlib import Path

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: The mark that stands for a space, and how far an unknown character scores below the worst piece.
SPACE, UNKNOWN_PENALTY = "▁", 10.0
#: How many times as low as the worst piece a piece scores that is no text.
NO_TEXT = 8


def piece_scores(path: str) -> tuple[list[tuple[str, float]], int]:
    """The (piece, log-probability) list of a vocabulary file, in order of ids, and the unknown piece's id.

    A .model file made by merging holds ranks, not probabilities. Its pieces get those of Zipf's law
    instead: the piece of rank r has the share (1 / r) / (1 + 1/2 + ... + 1/n), so nothing is trained
    and shares sum to 1. Of a file made for unigrams the stored scores are taken. Control, byte,
    unknown and unused pieces are no text: they score NO_TEXT times as low as the worst piece, so that
    the characters of their names, six at most, always win.
    """
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=Path(path).read_bytes())
    ids = range(own.get_piece_size())
    text = [i for i in ids if not (own.is_control(i) or own.is_byte(i) or own.is_unknown(i) or own.is_unused(i))]
    score = {i: own.get_score(i) for i in text}
    if all(x == int(x) for x in score.values()):  # ranks
        total = log(sum(1 / r for r in range(1, len(text) + 1)))
        score = {i: -log(r) - total for r, i in enumerate(sorted(text, key=lambda i: (-score[i], i)), 1)}
    outside = NO_TEXT * min(score.values(), default=-1.0)
    return [(own.id_to_piece(i), score.get(i, outside)) for i in ids], own.unk_id()


class CountingViterbi:
    """Best segmentation of a text by a unigram vocabulary: its score and number of pieces.

    A space becomes SPACE and opens a chunk; one is put before the text unless it begins with one.
    Within a chunk an Aho-Corasick automaton lists every vocabulary match; an array over end places
    keeps the best score and the pieces on that path. Ties: candidates reach an end place in order of
    their starts, and a later one replaces an earlier one only with a higher score. A character that
    is no piece by itself may stand as unknown, at the lowest score less UNKNOWN_PENALTY; unknown
    characters in a row are one unknown piece, or with byte_fallback one piece for each byte.
    """

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, keep: int = 400_000):
        self.scores: dict[str, float] = {}
        for piece, score in vocabulary:
            if piece:
                self.scores[piece] = score
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{i:02X}>" in self.scores for i in range(256))
        self.matches, self.known, self.keep = ahocorasick.Automaton(), {}, keep
        for piece, score in self.scores.items():
            self.matches.add_word(piece, (len(piece), score))
        self.single = {p for p in self.scores if len(p) == 1}
        if self.scores:
            self.matches.make_automaton()

    def _chunk(self, text: str) -> tuple[int, float]:
        if not self.single.issuperset(text):
            return self._with_unknown(text)
        # Matches come by end place, the longest, which start earliest, first.
        n = len(text)
        best, count = [0.0] + [-inf] * n, [0] * (n + 1)
        for end, (length, score) in self.matches.iter(text):
            start = end + 1 - length
            total = best[start] + score
            if total > best[end + 1]:
                best[end + 1], count[end + 1] = total, count[start] + 1
        return count[n], best[n]

    def _with_unknown(self, text: str) -> tuple[int, float]:
        n, ends = len(text), {}
        if self.scores:
            for end, (length, score) in self.matches.iter(text):
                ends.setdefault(end + 1, []).append((length, score))
        best, count = [0.0] + [None] * n, [0] * (n + 1)
        was_unknown = [False] * (n + 1)
        for e in range(1, n + 1):
            # Longer matches start earlier; the single character, known or unknown, comes last.
            found = sorted(ends.get(e, ()), reverse=True)
            if not found or found[-1][0] != 1:
                found.append((1, None))
            for length, score in found:
                s = e - length
                total = best[s] + (self.unknown if score is None else score)
                if best[e] is None or total > best[e]:
                    best[e] = total
                    if score is not None:
                        count[e], was_unknown[e] = count[s] + 1, False
                    elif self.bytes:
                        count[e], was_unknown[e] = count[s] + len(text[s].encode("utf-8", "surrogatepass")), True
                    else:
                        count[e], was_unknown[e] = count[s] + (not was_unknown[s]), True
        return count[n], best[n]

    def _look_up(self, chunks: list[str]) -> list[tuple[int, float]]:
        """Count and score of SPACE + each chunk; short ones are kept, at most `keep` of them."""
        known = self.known
        try:
            return [known[c] for c in chunks]
        except KeyError:
            if len(known) > self.keep:
                known.clear()
            long = {}
            for c in chunks:
                if c not in known and c not in long:
                    (known if len(c) < 64 else long)[c] = self._chunk(SPACE + c)
            return [known[c] if c in known else long[c] for c in chunks]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        # Chunks begin at spaces and at SPACE itself; the first one does so without a space too.
        chunks = text.replace(SPACE, " ").split(" ")
        got = self._look_up(chunks if chunks[0] else chunks[1:])
        return sum([n for n, _ in got]), sum([x for _, x in got], 0.0)


@lru_cache(maxsize=2)
def counting_viterbi(path: str, byte_fallback: bool) -> CountingViterbi:
    """One automaton to a worker process, whatever the number of its tasks."""
    return CountingViterbi(piece_scores(path)[0], byte_fallback)


def count_tokens(docs: DataFrame, vocabulary: str, *, byte_fallback: bool = True) -> DataFrame:
    """Rows (doc_id, n_chars, n_tokens, score): pieces in each whole text's best segmentation, and its score.

    `vocabulary` is a vocabulary file, read where the tasks run. Null and empty texts have no tokens
    and score 0. Repeated rows and null ids stay; an empty table gives none; other columns, whatever
    their names, are ignored. A text is taken whole; memory is that of its longest stretch without a
    space. Ties go to the segmentation whose last piece is longest, at every end place.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        count = counting_viterbi(vocabulary, byte_fallback).count
        for b in batches:
            got = [count(t or "") for t in b["text"]]
            yield {"doc_id": b["doc_id"], "n_chars": [len(t or "") for t in b["text"]], "n_tokens": [n for n, _ in got], "score": [s for _, s in got]}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_chars long, n_tokens long, score double")
