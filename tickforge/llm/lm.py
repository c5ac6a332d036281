"""Language-model scores by a weighted backoff automaton over smoothed word bigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cuts, delta, lower_words, map_parts, map_rows, materialise, pack, reducers, undelta, unpack

#: Hashes of the two marks; neither is a word, since words are not empty and hold no line feed.
END, START = xxhash.xxh64_intdigest(b""), xxhash.xxh64_intdigest(b"\n")
#: Tokens to a chunk of documents, which bounds a task's memory.
CHUNK = 500_000
#: Tokens whose arcs are held at once, whatever a text's length.
SEGMENT = 100_000


class Bigrams:
    """A chunk's tokens as places in its sorted list of word hashes, and its distinct bigrams.

    contexts[i] and tokens[i] are places of the word before token i and of the token; each document
    begins after START and ends with END. codes are distinct context * size + token; which[i] is the
    place of bigram i among them.
    """

    def __init__(self, vocabulary: np.ndarray, tokens: np.ndarray, lengths: np.ndarray):
        self.vocabulary, self.tokens = vocabulary, tokens.astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        self.contexts = np.empty_like(self.tokens)
        self.contexts[1:] = self.tokens[:-1]
        self.contexts[self.starts] = np.searchsorted(vocabulary, np.uint64(START))
        self.codes, self.which = np.unique(self.contexts * len(vocabulary) + self.tokens, return_inverse=True)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct bigram."""
        a, b = self.vocabulary[self.codes // len(self.vocabulary)], self.vocabulary[self.codes % len(self.vocabulary)]
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31)))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint8 if not len(a) or a.max() < 256 else np.uint16 if a.max() < 65536 else np.uint32 if a.max() < 1 << 32 else np.uint64)


class BackoffAutomaton:
    """States are one-word histories and a root; arcs carry log10 probabilities, failure arcs log10 backoff weights.

    Of words, p(w) = (c(w) - discount) / N, and an unknown word, one class, has discount * V / N. A
    state v with C(v) training occurrences as history gives its bigrams weight share(v) = top * C(v) /
    (C(v) + slack): an arc v -> w for each bigram seen, of share * c(vw) / C(v) + (1 - share) * p(w),
    and a failure arc to the root of 1 - share (of 1 where v is unknown). Each state's
    probabilities sum to 1. The root has an arc for every word, so at most one failure arc is taken.
    """

    def __init__(self, total: int, distinct: int, discount: float, top: float, slack: float):
        self.total, self.distinct, self.discount, self.top, self.slack = total, distinct, discount, top, slack

    def root(self, counts: np.ndarray) -> np.ndarray:
        n = max(self.total, 1)
        known = (counts - self.discount) / n
        unknown = self.discount * self.distinct / n if self.distinct else 1.0
        return np.where(counts > 0, known, unknown)

    def build(self, b: Bigrams, counts: np.ndarray, histories: np.ndarray, pairs: np.ndarray) -> None:
        """The part of the automaton that a chunk's tokens can reach; state i is the history of word i.

        Arcs are keyed by state * size + word; an arc leads to the state of its word.
        """
        p, self.tokens, self.size = self.root(counts), b, len(b.vocabulary)
        share = self.top * histories / (histories + self.slack)
        v, w = b.codes // self.size, b.codes % self.size
        self.seen = pairs > 0
        self.weights = np.log10(np.where(self.seen, share[v] * pairs / np.maximum(histories[v], 1) + (1 - share[v]) * p[w], 1.0))
        self.from_root, self.failure = np.log10(p).tolist(), np.log10(1 - share).tolist()

    def arcs(self, begin: int, end: int) -> dict[int, float]:
        """The arcs that tokens begin .. end - 1 may take."""
        own = np.unique(self.tokens.which[begin:end])
        own = own[self.seen[own]]
        return dict(zip(self.tokens.codes[own].tolist(), self.weights[own].tolist(), strict=True))

    def traverse(self, arcs: dict[int, float], state: int, words: list[int], total: float = 0.0) -> tuple[int, float]:
        """State and log10 probability after words are read from left to right, the state carried from word to word."""
        from_root, failure, size = self.from_root, self.failure, self.size
        for word in words:
            arc = arcs.get(state * size + word)
            if arc is None:  # the failure arc, then the root's own arc
                total += failure[state]
                arc = from_root[word]
            total += arc
            state = word
        return state, total

    def scores(self, first: int, lengths: list[int]) -> list[float]:
        """Log10 probability of each of the chunk's texts, from state `first`; SEGMENT tokens' arcs are held at once."""
        out, doc, state, left = [0.0] * len(lengths), 0, first, lengths[0]
        for begin in range(0, len(self.tokens.tokens), SEGMENT):
            arcs = self.arcs(begin, begin + SEGMENT)
            words, at = self.tokens.tokens[begin : begin + SEGMENT].tolist(), 0
            while at < len(words):
                many = min(left, len(words) - at)
                state, out[doc] = self.traverse(arcs, state, words[at : at + many], out[doc])
                at, left = at + many, left - many
                if not left:
                    doc, state = doc + 1, first
                    left = lengths[doc] if doc < len(lengths) else 0
        return out


def score_texts(docs: DataFrame, held_out, *, discount: float = 0.5, top: float = 0.5, slack: float = 1.0) -> DataFrame:
    """Scores of all whole texts by a bigram model of the training documents, those where held_out is false.

    docs has doc_id and text; held_out is a boolean Column. Tokens are words, A-Z lower-cased, then
    one end. Documents form chunks, written once to the shared folder. Each chunk asks for the counts
    of its own distinct words and bigrams; tasks that each own a range of hashes add up the counts of
    all training documents and answer every chunk, which then builds its part of the automaton and
    runs each of its texts through it. No count is dropped and nothing that grows with the corpus is
    broadcast or collected; a frequent bigram is one number to each chunk. The number of ranges
    follows the number of tokens without a bound, so that each stays the same size, and a chunk sends
    at most one message a range and none without a value. Words and bigrams are known by 64-bit
    hashes. Null text has the end token alone; null and repeated ids stay; an empty table gives none;
    with no training documents every token is unknown. Texts are taken whole, a very long one as a
    chunk of its own; other columns, whatever their names, are ignored.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))

    def chunks(batches: Iterator[dict]) -> Iterator[dict]:
        part, made = TaskContext.get().partitionId(), 0
        places: dict[bytes, int] = {}
        tokens, lengths, ids, held, size = [], [], [], [], 0

        def flush() -> dict:
            nonlocal made
            # The two marks come after the words, then all are dealt places by hash.
            hashes = np.array([*map(xxhash.xxh64_intdigest, places), START, END], np.uint64)
            order = np.argsort(hashes)
            vocabulary, to = hashes[order], np.empty(len(hashes), np.uint32)
            to[order] = np.arange(len(hashes), dtype=np.uint32)
            flat = np.concatenate([x for own in tokens for x in (to[own], to[-1:])])
            null = np.array([x is None for x in ids], np.uint8)
            body = pack(delta(vocabulary), flat, np.array(lengths, np.int64), np.array([x or 0 for x in ids], np.int64), null, np.array(held, np.uint8))
            made += 1
            return {"chunk": [f"{part}-{made}"], "tokens": [size], "train": [sum(k for k, h in zip(lengths, held, strict=True) if not h)], "payload": [body]}

        for b in batches:
            for doc_id, text, out in zip(b["doc_id"], b["text"], b["held"], strict=True):
                found = lower_words(text)
                for w in found:
                    if w not in places:
                        places[w] = len(places)
                tokens.append(np.fromiter(map(places.__getitem__, found), np.int64, len(found)))
                lengths.append(len(found) + 1)
                ids.append(doc_id)
                held.append(out)
                size += len(found) + 1
                if size > CHUNK:
                    yield flush()
                    places.clear()
                    tokens, lengths, ids, held, size = [], [], [], [], 0
        if ids:
            yield flush()

    def opened(payload: bytes) -> tuple[Bigrams, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        vocabulary, tokens, lengths, ids, null, held = unpack(payload)
        return Bigrams(undelta(vocabulary), tokens, lengths), lengths, ids, null, held

    told = materialise(map_rows(own, chunks, "chunk string, tokens long, train long, payload binary"), "chunks")
    n_tokens, n_train = told.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("train"), F.lit(0))).first()
    n = reducers(told, n_tokens, 2 << 20)

    def ask(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for chunk, payload in zip(b["chunk"], b["payload"], strict=True):
                own, lengths, _, _, held = opened(payload)
                train = np.repeat(held == 0, lengths)
                words = np.bincount(own.tokens[train], minlength=len(own.vocabulary))
                # Of START only how often it is a history counts; other histories are tokens too.
                at = np.searchsorted(own.vocabulary, np.uint64(START))
                words[at] = int((held == 0).sum())
                pairs = np.bincount(own.which[train], minlength=len(own.codes))
                hashes = own.hashes()
                order = np.argsort(hashes)
                hashes, pairs = hashes[order], pairs[order]
                sides = [np.split(x, cuts(h, n)) for h in (own.vocabulary, hashes) for x in (h, words if h is own.vocabulary else pairs)]
                out = [(i, pack(delta(a), _narrow(c), delta(d), _narrow(e))) for i, (a, c, d, e) in enumerate(zip(*sides, strict=True)) if len(a) or len(d)]
                yield {"chunk": [chunk] * len(out), "part": [i for i, _ in out], "payload": [x for _, x in out]}

    def totals(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        found, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, inverse, np.concatenate(counts).astype(np.int64))
        ends = np.cumsum([len(h) for h in hashes])[:-1]
        return np.split(total[inverse], ends), found, total

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [unpack(x) for x in pdf["payload"]]
        words, found, total = totals([undelta(x[0]) for x in asked], [x[1] for x in asked])
        pairs, _, _ = totals([undelta(x[2]) for x in asked], [x[3] for x in asked])
        distinct = int(((total > 0) & (found != np.uint64(START))).sum())
        return pd.DataFrame({"chunk": pdf["chunk"], "part": pdf["part"], "payload": [pack(_narrow(a), _narrow(b)) for a, b in zip(words, pairs, strict=True)], "distinct": [distinct] + [0] * (len(pdf) - 1)})

    asked = map_rows(told.select("chunk", "payload"), ask, "chunk string, part int, payload binary")
    answers = materialise(map_parts(asked, n, answer, "chunk string, part int, payload binary, distinct long"), "answers")
    n_distinct = int(answers.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0])
    model = BackoffAutomaton(n_train, n_distinct, discount, top, slack)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        text = pdf[pdf["part"] < 0]
        replies = [unpack(x) for x in pdf[pdf["part"] >= 0].sort_values("part")["payload"]]
        own, lengths, ids, null, held = opened(text["payload"].iloc[0])
        words = np.concatenate([x[0].astype(np.int64) for x in replies])
        at, order = np.searchsorted(own.vocabulary, np.uint64(START)), np.argsort(own.hashes())
        pairs = np.empty(len(own.codes), np.int64)
        pairs[order] = np.concatenate([x[1].astype(np.int64) for x in replies])
        counts, histories = words.copy(), words.copy()
        counts[at], histories[np.searchsorted(own.vocabulary, np.uint64(END))] = 0, 0
        model.build(own, counts, histories, pairs)
        score = model.scores(at, lengths.tolist())
        base = np.log10((counts + 1) / (n_train + n_distinct + 1))[own.tokens]
        add = lambda x: np.add.reduceat(x, own.starts)
        return pd.DataFrame({"doc_id": pd.array(np.where(null == 1, None, ids.astype(object)), dtype="Int64"), "held_out": held.astype(bool), "n_tokens": lengths, "n_known": add((counts > 0)[own.tokens].astype(np.int64)), "train_tokens": n_train, "base_score": add(base), "score": score})

    rows = told.select("chunk", F.lit(-1).alias("part"), "payload").unionByName(answers.select("chunk", "part", "payload"))
    return rows.repartition(n, "chunk").groupBy("chunk").applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
