"""Removal of word sequences that repeat anywhere in a corpus, by Rabin-Karp hashes of every window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cuts, delta, map_parts, map_rows, materialise, pack, reducers, undelta, unpack

#: Base of the rolling hash and its inverse modulo 2**64; any odd number has one.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class RollingHash:
    """Rabin-Karp hashes modulo 2**64 of all windows of `width` words; a word's value is its XXH64."""

    def __init__(self, width: int):
        self.width = width
        self.up, self.down = _powers(BASE, 1 << 12), _powers(INVERSE, 1 << 12)

    def windows(self, found: list[bytes]) -> np.ndarray:
        """Sum over j of value[i + j] * BASE**-j for each start i, from one running sum of value[k] * BASE**-k."""
        n = len(found)
        if n < self.width:
            return np.empty(0, np.uint64)
        if n > len(self.up):
            self.up, self.down = _powers(BASE, 2 * n), _powers(INVERSE, 2 * n)
        values = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.down[:n], dtype=np.uint64)])
        return (total[self.width :] - total[: n - self.width + 1]) * self.up[: n - self.width + 1]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of `starts`: overlapping windows merge into intervals."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + width, n), -1)
    return np.cumsum(marks[:n]) > 0


def intervals(mask: np.ndarray) -> list[list[int]]:
    """Maximal runs of True as [start, stop) pairs."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges.reshape(-1, 2).tolist()


def _among(h: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    """Which of h are among sorted values."""
    if not len(sorted_values):
        return np.zeros(len(h), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, h), len(sorted_values) - 1)] == h


#: Words to a chunk of documents, which bounds a task's memory.
CHUNK = 500_000


def _chunks(docs: DataFrame) -> DataFrame:
    """Rows (chunk, words, payload): documents packed together until they have CHUNK words, counted by their spaces."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        part, made = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def flush() -> dict:
            nonlocal made
            made += 1
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            body = pack(np.array([len(t) for t in raw], np.int64), np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), np.frombuffer(b"".join(raw), np.uint8), level=3)
            return {"chunk": [f"{part}-{made}"], "words": [size], "payload": [body]}

        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                ids.append(doc_id)
                texts.append(text or "")
                size += texts[-1].count(" ") + 1
                if size > CHUNK:
                    yield flush()
                    ids, texts, size = [], [], 0
        if ids:
            yield flush()

    return map_rows(docs.select("doc_id", "text"), run, "chunk string, words long, payload binary")


def _opened(payload: bytes) -> tuple[list[int | None], list[list[bytes]]]:
    """Ids and words of a chunk's documents."""
    lengths, ids, null, raw = unpack(payload)
    raw, ends = raw.tobytes(), np.cumsum(lengths).tolist()
    texts = [raw[e - n : e] for e, n in zip(ends, lengths.tolist(), strict=True)]
    return [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)], [t.split() for t in texts]


def _checks(found: list[bytes], places: np.ndarray, width: int) -> np.ndarray:
    """XXH3 of the words themselves of the windows that start at `places`."""
    flat, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found])
    starts = np.where(places > 0, ends[places - 1], 0).tolist()
    stops = (ends[places + width - 1] - 1).tolist()
    return np.fromiter((xxhash.xxh3_64_intdigest(flat[a:b]) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def _twice(*values: np.ndarray) -> np.ndarray:
    """Which rows of parallel arrays occur more than once."""
    order = np.lexsort(values[::-1])
    same = np.ones(max(0, len(order) - 1), bool)
    for v in values:
        same &= v[order][1:] == v[order][:-1]
    out = np.zeros(len(order), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _answered(*columns: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Answers each frame of a range by a bit for each of its values: whether it occurs more than once in the range.

    A value that a chunk holds more often stands twice in its own frame.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [unpack(x) for x in pdf["payload"]]
        sizes = [len(x[0]) for x in asked]
        values = [np.concatenate([undelta(x[i]) if i == 0 else x[i] for x in asked]) for i in range(len(columns))]
        bits = np.split(_twice(*values), np.cumsum(sizes)[:-1])
        return pd.DataFrame({"chunk": pdf["chunk"], "part": pdf["part"], "payload": [np.packbits(x).tobytes() for x in bits]})

    return run


class _Chunk:
    """A chunk's documents with the hashes of all their windows; what it asks, and how it reads the answers."""

    def __init__(self, payload: bytes, width: int, bits: int):
        self.ids, self.found = _opened(payload)
        rolling = RollingHash(width)
        self.width, self.each = width, [rolling.windows(w) for w in self.found]
        self.hashes = np.concatenate([*self.each, np.empty(0, np.uint64)])
        short = self.hashes >> np.uint64(64 - bits)
        self.short, self.bits, self.order = short, bits, np.argsort(short, kind="stable")

    def first(self) -> tuple[np.ndarray]:
        """Sorted short hashes, those that occur more often twice."""
        once, times = np.unique(self.short, return_counts=True)
        return (np.repeat(once, np.minimum(times, 2)),)

    def likely(self, n: int, answers: dict[int, bytes]) -> np.ndarray:
        """Which windows have a short hash that occurs again."""
        return _among(self.short, np.unique(_read(self.first(), n, self.bits, answers)[0]))

    @staticmethod
    def second(h: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and checks of likely windows, sorted, equal pairs twice at most."""
        order = np.lexsort((z, h))
        h, z = h[order], z[order]
        third = np.zeros(len(h), bool)
        third[2:] = (h[2:] == h[:-2]) & (z[2:] == z[:-2])
        return h[~third], z[~third]

    def check(self, likely: np.ndarray) -> np.ndarray:
        out, at = [np.empty(0, np.uint64)], 0
        for w, h in zip(self.found, self.each, strict=True):
            places = np.flatnonzero(likely[at : at + len(h)])
            if len(places):
                out.append(_checks(w, places, self.width))
            at += len(h)
        return np.concatenate(out)


def _frames(values: tuple[np.ndarray, ...], n: int, bits: int) -> list[tuple[int, bytes]]:
    """(part, frame) of the ranges that hold values, which are sorted by the first array."""
    sides = zip(*[np.split(v, cuts(values[0], n, bits)) for v in values], strict=True)
    return [(i, pack(delta(x[0]), *x[1:])) for i, x in enumerate(sides) if len(x[0])]


def _read(values: tuple[np.ndarray, ...], n: int, bits: int, answers: dict[int, bytes]) -> tuple[np.ndarray, ...]:
    """Those of the asked values whose bits are set."""
    sides = zip(*[np.split(v, cuts(values[0], n, bits)) for v in values], strict=True)
    mask = [np.unpackbits(np.frombuffer(answers[i], np.uint8), count=len(x[0])).astype(bool) for i, x in enumerate(sides) if len(x[0])]
    mask = np.concatenate([np.empty(0, bool), *mask])
    return tuple(v[mask] for v in values)


def remove_repeats(docs: DataFrame, *, width: int = 35) -> DataFrame:
    """Rows (doc_id, n_words, kept, removed): words outside every window of `width` words that occurs again.

    A window that starts at two places of the corpus, of the same document or of two, is repeated,
    and each of its words goes; windows are judged on the input. kept holds the words that stay,
    joined by one space; removed lists maximal [start, stop) intervals of word places.

    Documents form chunks, written once to the shared folder. The Rabin-Karp hash of every window
    goes, cut to as many bits as tell all windows apart but about one in a thousand, in sorted and
    packed frames to tasks that each own a range of hashes; these count them and answer each frame by
    a bit for each value. What then occurs more than once is counted again in the same way by its
    whole 64-bit hash and 64 bits of XXH3 over its words, so different windows are taken for one with
    probability 2**-128 a pair, whatever their structure. The number of ranges follows the number of
    windows without a bound; a frequent window is one value among many in each chunk's frame, so
    tasks stay even; a chunk sends at most one message a range and none without a value.

    Null and empty texts have no words; documents of fewer words than `width` stay whole; repeated
    rows repeat each other's windows; rows with a null doc_id are treated like others; texts are taken
    whole, a very long one as a chunk of its own; an empty table gives no rows; other columns,
    whatever their names, are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = materialise(_chunks(own), "chunks")
    total = told.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    n, bits = reducers(told, total), min(64, max(1, total).bit_length() + 10)
    asks, told = "chunk string, part int, payload binary", told.drop("words")

    def scatter(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for chunk, payload in zip(b["chunk"], b["payload"], strict=True):
                out = _frames(_Chunk(payload, width, bits).first(), n, bits)
                yield {"chunk": [chunk] * len(out), "part": [i for i, _ in out], "payload": [x for _, x in out]}

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        told = _told(pdf)
        own = _Chunk(told[-1], width, bits)
        likely = own.likely(n, told)
        out = _frames(own.second(own.hashes[likely], own.check(likely)), n, 64)
        # The chunk keeps its marks, so that it need not ask a second time.
        rows = [(-2, np.packbits(likely).tobytes()), *out]
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[0], "part": [i for i, _ in rows], "payload": [x for _, x in rows]})

    def remove(pdf: pd.DataFrame) -> pd.DataFrame:
        told = _told(pdf)
        own = _Chunk(told[-1], width, bits)
        likely = np.unpackbits(np.frombuffer(told[-2], np.uint8), count=len(own.hashes)).astype(bool)
        h, z = own.hashes[likely], own.check(likely)
        mix = lambda h, z: h * np.uint64(BASE) ^ z  # noqa: E731  (h and z of one chunk's windows are told apart)
        repeated = np.zeros(len(own.hashes), bool)
        repeated[likely] = _among(mix(h, z), np.unique(mix(*_read(own.second(h, z), n, 64, told))))
        out, at = {"n_words": [], "kept": [], "removed": []}, 0
        for w, x in zip(own.found, own.each, strict=True):
            out["n_words"].append(len(w))
            starts = np.flatnonzero(repeated[at : at + len(x)])
            at += len(x)
            if len(starts):
                mask = covered(starts, width, len(w))
                out["removed"].append(intervals(mask))
                w = [word for word, gone in zip(w, mask.tolist(), strict=True) if not gone]
            else:
                out["removed"].append([])
            out["kept"].append(b" ".join(w).decode("utf-8", "surrogatepass"))
        return pd.DataFrame({"doc_id": pd.array(own.ids, dtype="Int64"), **out})

    documents = told.select("chunk", F.lit(-1).alias("part"), "payload")
    replies = map_parts(map_rows(told, scatter, asks), n, _answered("h"), asks)
    asked = materialise(documents.unionByName(replies).repartition(n, "chunk").groupBy("chunk").applyInPandas(again, asks), "asked")
    replies = map_parts(asked.filter("part >= 0"), n, _answered("h", "z"), asks)
    rows = documents.unionByName(asked.filter("part = -2")).unionByName(replies)
    return rows.repartition(n, "chunk").groupBy("chunk").applyInPandas(remove, "doc_id long, n_words long, kept string, removed array<array<int>>")


def _told(pdf: pd.DataFrame) -> dict[int, bytes]:
    return dict(zip(pdf["part"], pdf["payload"], strict=True))
