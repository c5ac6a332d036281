"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialise

#: Fixed value: how byte-level vocabularies of this kind split a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Text for which both engines must agree before the faster one is used.
PROBE = "It's 3.5  caf\u00e9s\n\n\t\u00a0 \u3000\u65e5\u672c \U0001f600 don't<|endoftext|> x_y--z \u0661\u00b2 "
#: Sequences' worth of tokens that one task of the second pass packs.
GATHERED = 1024
_LONG_RUN = re.compile(r"\S{4000}|\s{4000}")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable ones for themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokenizer:
    """Ids of a byte-level BPE file of the `tokenizers` library, as little-endian uint32 bytes.

    If the file is of the common shape (ids in order of merges, no normaliser, the usual split), its
    merges are run by tiktoken, which gives the same ids several times faster; PROBE is encoded by
    both first. Otherwise, and for texts with very long runs, `tokenizers` itself encodes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.fast = self._fast(path)
        if self.fast and self.fast.encode_ordinary(PROBE) != self._slow(PROBE):
            self.fast = None

    def _slow(self, text: str) -> list[int]:
        return self.slow.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _fast(path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, split = file["model"], file["pre_tokenizer"] or {}
        if file["normalizer"] or (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) != ("ByteLevel", False, True):
            return None
        vocabulary, letters = model["vocab"], byte_letters()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        special = {t["content"] for t in file["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        return tiktoken.Encoding("from-file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        long = len(text) >= 4000 and _LONG_RUN.search(text)
        ids = self._slow(text) if long or not self.fast else self.fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def byte_tokenizer(path: str) -> ByteTokenizer:
    """One tokenizer to a worker process, whatever the number of its tasks."""
    return ByteTokenizer(path)


class BestFit:
    """Bounded-space online best fit: open bins by free space, marked in a bitset held in an integer.

    place(length) takes the open bin with the least free space that is enough. If none fits, a new
    bin opens; if `most` are open then, the fullest closes first. Returns (bin, offset). Bins that
    have closed since stand in `closed`, which the caller empties.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.bins, self.n_open, self.made, self.closed = 0, [[] for _ in range(capacity + 1)], 0, 0, []

    def _take(self, free: int) -> int:
        own = self.bins[free]
        got = own.pop()
        if not own:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return got

    def place(self, length: int) -> tuple[int, int]:
        if fitting := self.bits >> length:
            free = length + (fitting & -fitting).bit_length() - 1
            got = self._take(free)
        else:
            free, got = self.capacity, self.made
            self.made += 1
            if self.n_open >= self.most and length < self.capacity:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
        if left := free - length:
            self.bins[left].append(got)
            self.bits |= 1 << left
            self.n_open += 1
        else:
            self.closed.append(got)
        return got, self.capacity - free

    def still_open(self) -> list[tuple[int, int]]:
        """(bin, free space) of all open bins."""
        return [(b, free) for free, own in enumerate(self.bins) for b in own]


_PIECE = "doc_id long, piece int, start long, length long, ids binary"
_NAMES = ("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset", "task", "row")


def _packed(pieces: Iterator[tuple], capacity: int, open_bins: int, first: int, reopen: int | None) -> Iterator[dict]:
    """Rows of _NAMES for pieces (doc_id, piece, start, length, ids), each as its sequence closes.

    Memory is that of the open sequences. With `reopen`, those that have that much free space or more
    at the end come out without a place, for another pass.
    """
    fit, held, task, row = BestFit(capacity, open_bins), {}, TaskContext.get().partitionId(), 0
    rows, size = [], 0

    def told() -> dict:
        return dict(zip(_NAMES, map(list, zip(*rows, strict=True)), strict=True))

    def close(b: int, placed: bool = True) -> None:
        nonlocal size
        for own, at, n in held.pop(b):
            rows.append((*own, first + b if placed else None, at if placed else None, task, n))
            size += len(own[4])

    for own in pieces:
        b, at = fit.place(own[3])
        held.setdefault(b, []).append((own, at, row))
        row += 1
        for c in fit.closed:
            close(c)
        fit.closed.clear()
        if size > 16 << 20:
            yield told()
            rows, size = [], 0
    for b, free in fit.still_open():
        close(b, reopen is None or free < reopen)
    if rows:
        yield told()


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, open_bins: int = 1024, end_id: int | None = 0) -> DataFrame:
    """Documents (doc_id, text) as token pieces placed in sequences of at most `capacity` tokens.

    A document is its ids and then end_id. Only longer ones are cut: into pieces of `capacity`, the
    first taking the rest. Each task packs its own partition online, in one pass, with at most
    `open_bins` open sequences. Sequences that a task leaves with a 64th or more of their space free
    are opened again: their pieces are gathered, some millions of tokens to a task, and packed the
    same way once more, so many small partitions cost little. The first pass is written to the shared
    folder, so a task that is run again does not pack otherwise.

    Null text counts as empty (one token). Rows with a null or repeated doc_id are packed like
    others. An empty table gives no rows; other columns, whatever their names, are ignored. Texts are
    taken whole: memory is that of the open sequences, some MB of texts and the longest text.

    Returns doc_id, piece, start, length, ids (binary, little-endian uint32), sequence_id, offset.
    """
    schema = f"{_PIECE}, sequence_id long, offset long, task int, row long"

    def cut(batches: Iterator[dict]) -> Iterator[tuple]:
        encode = byte_tokenizer(tokenizer).encode
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                start, stop, piece = 0, n % capacity or min(n, capacity), 0
                while start < n:
                    yield doc_id, piece, start, stop - start, ids[4 * start : 4 * stop]
                    start, stop, piece = stop, stop + capacity, piece + 1

    def once(batches: Iterator[dict]) -> Iterator[dict]:
        return _packed(cut(batches), capacity, open_bins, TaskContext.get().partitionId() << 40, max(1, capacity // 64))

    def again(batches: Iterator[dict]) -> Iterator[dict]:
        pieces = (x for b in batches for x in zip(*(b[c] for c in _NAMES[:5]), strict=True))
        return _packed(pieces, capacity, open_bins, ((1 << 22) + TaskContext.get().partitionId()) << 40, None)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = materialise(map_rows(own, once, schema), "packed")
    left = first.filter("sequence_id is null")
    tokens = left.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, -(-tokens // (capacity * GATHERED)))
    gathered = left.repartitionById(groups, F.pmod("task", F.lit(groups))).sortWithinPartitions("task", "row")
    second = map_rows(gathered.select(*_NAMES[:5]), again, schema)
    return first.filter("sequence_id is not null").unionByName(second).drop("task", "row")
