"""Near duplicates: SimHash fingerprints within a Hamming radius, or exact shingle similarity of those within a wide one; their components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_words, map_rows, materialise, shielded

BITS = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles (XXH64, seed 42), repeats included; no words: 0."""
    found = lower_words(text)
    if not found:
        return 0
    flat = b" ".join(found)
    n = max(1, len(found) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(shingle, len(found)) - 1 :] - 1).tolist()
    ints, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([ints(flat[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


class BitPlanes:
    """Fingerprints stored by bit: plane j is an integer whose bit i is bit j of fingerprint i."""

    def __init__(self, values: list[int], places: list[int]):
        n = len(values)
        bits = np.unpackbits(np.array(values, "<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        self.places, self.every = places, (1 << n) - 1
        self.planes = [int.from_bytes(np.packbits(bits[:, j], bitorder="little").tobytes(), "little") for j in places]

    def within(self, value: int, radius: int) -> int:
        """Marks fingerprints at `radius` or fewer differing bits from value.

        Distances are binary counters held as planes too: two planes of differences and the lowest
        counter plane go through a full adder, whose sum stays and whose carry moves up. `over` keeps
        those whose counter passed the radius; once these are all, the block is abandoned.
        """
        counter, over = [0] * max(1, radius.bit_length()), 0
        differ = [plane ^ self.every if value >> j & 1 else plane for j, plane in zip(self.places, self.planes, strict=True)]
        for x, y in zip(differ[::2], [*differ[1::2], 0], strict=False):
            low, part = counter[0], x ^ y
            counter[0], carry = part ^ low, x & y | part & low
            for k in range(1, len(counter)):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            more, same = 0, self.every  # counters above the radius, and those alike in all bits seen
            for k in range(len(counter) - 1, -1, -1):
                if radius >> k & 1:
                    same &= counter[k]
                else:
                    more |= same & counter[k]
                    same &= ~counter[k]
            over |= carry | more
            if over == self.every:
                return 0
        return self.every & ~over


#: Fingerprints compared at once; larger groups are compared block by block.
BLOCK = 8192


def linked(values: list[int], places: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints that agree outside `places`."""
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for low in range(0, len(values), BLOCK):
        planes = BitPlanes(values[low : low + BLOCK], places)
        for i in range(low + 1, len(values)):
            near = planes.within(values[i], radius)
            if i - low < BLOCK:
                near &= (1 << (i - low)) - 1
            while near:
                j = low + (near & -near).bit_length() - 1
                near &= near - 1
                if (a := root(i)) != (b := root(j)):
                    parent[a] = b
                    yield values[i], values[j]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in `keep`, and fp (a signed long). Null text has fingerprint zero."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {**{c: b[c] for c in ("doc_id", *keep)}, "fp": [_signed(fingerprint(t, shingle)) for t in b["text"]]}

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    return map_rows(own, run, "doc_id long, " + "".join(f"{c} {own.schema[c].dataType.simpleString()}, " for c in keep) + "fp long")


def _pair_masks(places: list[int], n: int) -> list[int]:
    """Masks of every two of n bands of some bit places."""
    cuts = [len(places) * i // n for i in range(n + 1)]
    bands = [sum(1 << j for j in places[cuts[i] : cuts[i + 1]]) for i in range(n)]
    return [x | y for x, y in combinations(bands, 2)]


#: Fingerprints of one key that are compared in one task; keys of more are divided by further bands.
GROUP = 4096


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) that join all fingerprints of a table (fp, distinct) within the radius.

    Of radius + 2 bands of bits, two fingerprints within the radius agree in two at least, so each
    goes to every pair of bands and is compared with those that agree there. Keys that one
    fingerprint has alone drop out by a count first. A key that more than GROUP share is divided the
    same way again: its fingerprints go to every pair of bands of the bits left. Only a spanning
    forest of each group comes out; links that it leaves out connect nothing more.
    """
    n, every = radius + 2, (1 << BITS) - 1
    masks = _pair_masks(list(range(BITS)), n)
    rest = [[j for j in range(BITS) if not m >> j & 1] for m in masks]
    further = [_pair_masks(r, n) for r in rest]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("band", "key"))
    shared = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = keyed.join(shared, ["band", "key"])
    small = met.filter(F.col("n") <= GROUP).groupBy("band", "key").agg(F.collect_list("fp").alias("fps")).select("band", F.lit(-1).alias("sub"), "fps")
    again = F.element_at(F.array(*[F.array(*[F.lit(_signed(m)) for m in own]) for own in further]), F.col("band") + 1)
    divided = met.filter(F.col("n") > GROUP).select("fp", "band", "key", F.posexplode(again).alias("sub", "mask"))
    large = divided.groupBy("band", "key", "sub", F.col("fp").bitwiseAND(F.col("mask")).alias("k")).agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("band", "sub", "fps")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            found = []
            for band, sub, fps in zip(b["band"], b["sub"], b["fps"], strict=True):
                places = rest[band] if sub < 0 else [j for j in rest[band] if not further[band][sub] >> j & 1]
                found += linked([v & every for v in fps], places, radius)
            yield {"a": [_signed(x) for x, _ in found], "b": [_signed(y) for _, y in found]}

    return map_rows(small.unionByName(large), run, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v) over orderable nodes: rows (node, root), root the least node.

    Alternates large-star and small-star steps until every edge points to its root; each round is
    written to the shared folder. Nothing but an edge count comes to the driver.
    """
    cut = lambda df: materialise(df, "edges")
    now, before = cut(edges.filter(F.col("u") != F.col("v"))), None
    for _ in range(rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = cut(small.distinct())
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _classes(nodes: DataFrame, met: DataFrame) -> DataFrame:
    """(fp, component_id, component_fp) of nodes (fp, least) that links (a, b) of their fp join."""
    # A node's order is its least doc_id, nulls last; the fingerprint keeps nodes apart.
    node = F.struct(F.col("least").isNull().alias("no_id"), F.col("least").alias("least"), F.col("fp").alias("fp"))
    named = nodes.select(node.alias("node"), "fp")
    edges = met.join(named.select(F.col("fp").alias("a"), F.col("node").alias("u")), "a").join(named.select(F.col("fp").alias("b"), F.col("node").alias("v")), "b").select("u", "v")
    roots = components(edges).select(F.col("node.fp").alias("fp"), F.col("root.least").alias("component_id"), F.col("root.fp").alias("component_fp"))
    return nodes.join(roots, "fp", "left").select("fp", F.when(F.col("component_fp").isNotNull(), F.col("component_id")).otherwise(F.col("least")).alias("component_id"), F.coalesce("component_fp", "fp").alias("component_fp"))


def near_duplicates(docs: DataFrame, *, shingle: int = 3, radius: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, keep..., fp, component_id, component_fp): documents whose fingerprints link, directly or in steps.

    component_id is the least doc_id of the component (null if all its ids are), component_fp the
    fingerprint of that document, which no other component has. Every row is
    fingerprinted; equal fingerprints count as one node, so copies make no pairs. Null and empty
    texts have fingerprint zero and link like any other; texts are taken whole, 65,536 shingles at a
    time; repeated rows and null ids stay; an empty table gives none; columns not in `keep` are
    ignored, whatever their names.
    """
    marked = materialise(fingerprints(docs, shingle, keep), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    met = links(nodes.select("fp"), radius)
    classes = materialise(_classes(nodes, met), "classes")
    return marked.join(classes, "fp").select("doc_id", *keep, "fp", "component_id", "component_fp")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _first_of_each(docs: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of docs that are first of their component; find gives (doc_id, text_hash, component_fp) of (doc_id, text, text_hash).

    docs may have columns of any names.
    """
    own, back = shielded(docs, ("doc_id", "text"))
    own = own.withColumn("text_hash", F.xxhash64(F.col("text").cast("string")))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    first = find(own.select("doc_id", "text", "text_hash")).groupBy("component_fp").agg(F.min_by(F.struct("doc_id", "text_hash"), order).alias("k")).select("k.*")
    first = first.select(F.col("doc_id").alias("first_id"), F.col("text_hash").alias("first_hash"))
    kept = own.join(first, own["doc_id"].cast("long").eqNullSafe(first["first_id"]) & (own["text_hash"] == first["first_hash"]), "left_semi")
    return back(kept.dropDuplicates(["doc_id", "text_hash"]))


def drop_near_duplicates(docs: DataFrame, *, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One document of each component, with its own columns: the least doc_id, nulls last, then the least text hash.

    Rows equal in doc_id and text count as one document, of which one row stays. Null and empty texts
    are alike, so one of them stays; texts of any length are taken whole; an empty table gives an
    empty one; columns of any names pass through.
    """
    return _first_of_each(docs, lambda own: near_duplicates(own, shingle=shingle, radius=radius, keep=("text_hash",)))


#: SimHash of sets of shingles: PRINT words of 64 bits, each cut into bands of WIDTH bits; distances are between the first NEAR words.
#: Texts of similarity 0.8 differ in 15 % of bits at most (the angle whose cosine is 0.8 / 0.9), so a band's bits are alike
#: with probability 0.85^12 = 0.139, those of one of 55 bands with 0.9997, and 36 or fewer of 128 bits differ with 0.9999.
PRINT, WIDTH, NEAR, RADIUS = 11, 12, 2, 36
_STEPS = np.array([xxhash.xxh64_intdigest(b"step", i) for i in range(PRINT)], "<u8")


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a text of fewer words is one shingle, no words give zero."""
    found = lower_words(text)
    if not found:
        return np.zeros(1, "<u8")
    ids = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in found), "<u8", len(found))
    n, h = max(1, len(found) - shingle + 1), np.uint64(0)
    for k in range(min(shingle, len(found))):
        h = (h + ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def set_print(found: np.ndarray) -> np.ndarray:
    """SimHash of a sorted set of 64-bit hashes, PRINT words: a bit is 1 if set in over half of them, at a tie as in the least."""
    total = np.zeros(PRINT * BITS, np.int64)
    for at in range(0, len(found), 255):
        z = found[at : at + 255, None] + _STEPS
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((z ^ z >> np.uint64(31)).view(np.uint8), axis=1, bitorder="little")
        least = bits[0] if not at else least
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * total + least > len(found), bitorder="little").view("<u8")


def _add(x: int, y: int, z: int) -> tuple[int, int]:
    """A full adder of three planes: planes of sums and of carries."""
    part = x ^ y
    return part ^ z, x & y | part & z


def within_shift(planes: list[int], d: int, wanted: int, radius: int) -> int:
    """Marks those of the wanted fingerprints i that differ from fingerprint i + d in `radius` or fewer bits, all at once.

    Planes are those of BitPlanes; a plane differs from itself moved by d where bit j of the two
    differs. Eight such planes at a time run through a tree of full adders, each of which saves its
    carries for the next counter plane; the last carry ripples up. Once all are over the radius, the
    rest is abandoned.
    """
    counter, near = [0] * max(4, len(planes).bit_length()), wanted
    for at in range(0, len(planes), 8):
        x = [p ^ p >> d for p in planes[at : at + 8]]
        x += [0] * (8 - len(x))
        ones, twos, fours = counter[:3]
        ones, a = _add(ones, x[0], x[1])
        ones, b = _add(ones, x[2], x[3])
        twos, e = _add(twos, a, b)
        ones, a = _add(ones, x[4], x[5])
        ones, b = _add(ones, x[6], x[7])
        twos, f = _add(twos, a, b)
        fours, carry = _add(fours, e, f)
        counter[:3] = ones, twos, fours
        for k in range(3, len(counter)):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        if at + 8 >= len(planes) or at + 8 > radius and at % 32 == 24:
            more, same = 0, wanted
            for k in range(len(counter) - 1, -1, -1):
                if radius >> k & 1:
                    same &= counter[k]
                else:
                    more |= same & counter[k]
                    same &= ~counter[k]
            near = wanted & ~more
            if not near:
                return 0
    return near


def _planes(bits: np.ndarray) -> list[int]:
    """Columns of a matrix of bits as integers."""
    return [int.from_bytes(c.tobytes(), "little") for c in np.packbits(bits, axis=0, bitorder="little").T]


def near_parts(group: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """For each row a row of its part: rows of a group (numbers in order) whose prints (a row of words each) link within the radius, in steps.

    All groups are compared at once, each row with the one d places on; larger groups come first, so
    that rows which still have one stand at the front. Rows that are of one part already are not compared.
    """
    n = len(group)
    size = np.bincount(group)[group]
    order = np.argsort(-size, kind="stable")
    group, size = group[order], size[order]
    planes = _planes(np.unpackbits(np.ascontiguousarray(prints[order]).view(np.uint8).reshape(n, -1), axis=1, bitorder="little"))
    part, held = np.arange(n), n
    for d in range(1, int(size[0]) if n else 0):
        m = int(np.searchsorted(-size, -d))
        if m < held // 2:
            planes, held = [p & (1 << m) - 1 for p in planes], m
        wanted = _planes(((group[d:m] == group[: m - d]) & (part[d:m] != part[: m - d]))[:, None])[0]
        near = within_shift(planes, d, wanted, radius) if wanted else 0
        at = np.flatnonzero(np.unpackbits(np.frombuffer(near.to_bytes(-(-m // 8), "little"), np.uint8), bitorder="little"))
        while len(at := at[part[at] != part[at + d]]):
            x, y = part[at], part[at + d]
            np.minimum.at(part, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := part[part[:m]], part[:m]):
                part[:m] = up
    out = np.empty(n, np.int64)
    out[order] = order[part]
    return out


#: Fingerprints of a band's value that are compared in one task; of more, every two blocks meet. Rows taken up at once.
PRINTS, ROWS = 8192, 1 << 16


def _meetings(nodes: DataFrame, radius: int) -> DataFrame:
    """Groups (key, fp) of nodes (fp, print) whose prints agree in the bits of a band and link within the radius there, in steps.

    key is the least fp of those; groups of one key are one group, whatever their bands. A value of a
    band that more than PRINTS share is cut into blocks, every two of which are a task's.
    """
    words = [F.col("print")[i] for i in range(PRINT)]
    each = BITS // WIDTH
    values = [F.shiftrightunsigned(words[i // each], i % each * WIDTH).bitwiseAND((1 << WIDTH) - 1).cast("int") + (i << WIDTH) for i in range(PRINT * each)]
    keyed = nodes.select("fp", *[words[i].alias(f"w{i}") for i in range(NEAR)], F.explode(F.array(*values)).alias("band"))
    # One row at most for each value of each band, so of fixed size.
    large = keyed.groupBy("band").agg(F.ceil(F.count("*") / PRINTS).cast("int").alias("blocks")).filter("blocks > 1")
    x = keyed.join(F.broadcast(large), "band", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    x = x.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select("band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp", *[f"w{i}" for i in range(NEAR)])

    def parts(t: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        fp, part = t["fp"].to_numpy(), near_parts(group, np.stack([t[f"w{i}"].to_numpy() for i in range(NEAR)], axis=1), radius)
        least = np.full(len(fp), np.iinfo(np.int64).max)
        np.minimum.at(least, part, fp)
        met = np.bincount(part, minlength=len(fp))[part] > 1
        return pa.RecordBatch.from_pydict({"key": least[part][met], "fp": fp[met]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            held = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches([b])])
            if len(held) >= ROWS:
                group = numbered(held)
                at = int(np.searchsorted(group, group[-1]))
                if at:
                    yield parts(held.slice(0, at), group[:at])
                    held = held.slice(at)
        if held is not None and len(held):
            yield parts(held, numbered(held))

    def numbered(t: pa.Table) -> np.ndarray:
        keys = np.stack([t[c].to_numpy() for c in ("band", "p", "q")])
        return np.cumsum(np.r_[False, (keys[:, 1:] != keys[:, :-1]).any(axis=0)][: len(t)])

    return x.repartition("band", "p", "q").sortWithinPartitions("band", "p", "q").mapInArrow(run, "key long, fp long").distinct()


def _merged(met: DataFrame) -> DataFrame:
    """Groups (key, fp) in fewer rows: a group whose key is in groups of lesser keys joins that of the least, so none is divided."""
    met = materialise(met, "groups")
    up = met.filter("key != fp").groupBy(F.col("fp").alias("key")).agg(F.min("key").alias("up"))
    return met.join(up, "key", "left").select(F.coalesce("up", "key").alias("key"), "fp").distinct()


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets have the Jaccard similarity at least."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            good = []
            for x, y in zip(b["x"], b["y"], strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    good.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both))
            yield {c: [v for v, g in zip(b[c], good, strict=True) if g] for c in "ab"}

    own = lambda fp, name: sets.select(F.col("fp").alias(fp), F.col("found").alias(name))
    return materialise(map_rows(pairs.join(own("b", "y"), "b").join(own("a", "x"), "a").select("a", "b", "x", "y"), run, "a long, b long", batch=50), "similar")


def joining(sets: list[np.ndarray], roots: list[int], similarity: float, cross: int = 0) -> Iterator[tuple[int, int]]:
    """Places of similar sets that join sets of different roots into components: a spanning forest of these links, none left out.

    With `cross`, only sets before that place meet those from it on. A set's shares with all others
    come at once, from marks over the block's own numbering of hashes.
    """
    size = np.array([len(x) for x in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    starts = np.cumsum(size) - size
    marks, label = np.zeros(int(flat.max()) + 1, bool), np.unique(np.array(roots), return_inverse=True)[1].reshape(-1)
    for i in range(cross or len(sets)):
        other = label != label[i]
        other[: cross or i] = False
        if not other.any():
            continue
        own = flat[starts[i] : starts[i] + size[i]]
        marks[own] = True
        both = np.add.reduceat(marks[flat], starts, dtype=np.int64)
        marks[own] = False
        for j in np.flatnonzero(other & (both >= similarity * (size[i] + size - both))).tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                yield i, j


#: Texts of a band's group that meet in one task as a block; of larger groups every two blocks meet.
TEXTS = 512


def _apart(left: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join members (fp, root) of a group (key) that are similar and not yet of one root; no pair is a row."""
    n = left.groupBy("key").agg(F.ceil(F.count("*") / TEXTS).cast("int").alias("blocks"))
    x = left.join(n, "key").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select("key", "fp", "root", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("own", "ascending"), ("fp", "ascending")])
        fps, own = t["fp"].to_pylist(), t["own"].to_pylist()
        cross = own.count(own[0]) if t["p"][0] != t["q"][0] else 0
        found = list(joining([np.frombuffer(v, "<u8") for v in t["found"].to_pylist()], t["root"].to_pylist(), similarity, cross)) if cross < len(own) else []
        return pa.table({"a": pa.array([fps[i] for i, _ in found], pa.int64()), "b": pa.array([fps[j] for _, j in found], pa.int64())})

    return x.join(sets, "fp").groupBy("key", "p", "q").applyInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """Rows (doc_id, fp, component_id, component_fp) as near_duplicates(), fp the hash of the text.

    Texts link where the Jaccard similarity of their word shingles is `similarity` at least, as the
    sets themselves tell. Candidates are texts whose SimHash fingerprints agree in a band and link
    within `radius` of 128 bits among those that do, told by bit planes; a similarity other than 0.8
    needs a radius of its own. In each such group all are first compared with one, the text that meets
    most others in all its groups, then with a second such of another component; members that this
    left in different components meet each other in blocks of TEXTS, of which only the links that
    join components come out.

    Null and empty texts have one and the same set; texts of fewer words than a shingle are one
    shingle; copies of a text are one node; repeated rows and null ids stay; texts are taken whole;
    an empty table gives none; other columns, whatever their names, are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("fp", F.xxhash64("text"))

    def sketch(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "fp": b["fp"], "print": [set_print(shingles(t, shingle)).view("<i8") for t in b["text"]]}

    def found(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"fp": b["fp"], "found": [shingles(t, shingle).tobytes() for t in b["text"]]}

    marked = materialise(map_rows(own, sketch, "doc_id long, fp long, print array<long>"), "sketches")
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("print").alias("print")), "nodes")
    met = materialise(_merged(_meetings(nodes.select("fp", "print"), radius)), "meetings")
    pairs = materialise(met.join(met.groupBy("key").agg(F.count("*").alias("n")), "key"), "pairs")
    known = materialise(pairs.join(pairs.groupBy("fp").agg(F.sum("n").alias("met")), "fp").select("key", "fp", "met"), "met")
    # The text of a node is that of its rows with the least id, so copies do not meet in one task.
    wanted = nodes.join(known.select("fp").distinct(), "fp").select(F.col("fp").alias("__fp"), "least")
    texts = own.join(wanted, (own["fp"] == wanted["__fp"]) & own["doc_id"].eqNullSafe(wanted["least"]), "left_semi").select("fp", "text").dropDuplicates(["fp"])
    sets = materialise(map_rows(texts, found, "fp long, found binary", batch=50), "sets")

    most = lambda where: F.max_by("fp", F.when(where, F.struct("met", -F.col("fp"))))

    def star(heads: DataFrame) -> DataFrame:
        """Links between each group's head and its members that are not yet in the head's component."""
        apart = rooted.join(heads, "key").filter("fp != head and root != head_root")
        return _similar(apart.select(F.col("head").alias("a"), F.col("fp").alias("b")).distinct(), sets, similarity)

    def with_roots(found: DataFrame) -> DataFrame:
        roots = components(found.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnsRenamed({"node": "fp"})
        return materialise(known.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")

    rooted = known.withColumn("root", F.col("fp"))
    heads = known.groupBy("key").agg(most(F.lit(True)).alias("head")).withColumn("head_root", F.col("head"))
    links_ = star(heads)
    rooted = with_roots(links_)
    first = heads.select("key", F.col("head").alias("fp")).join(rooted, ["key", "fp"]).select("key", F.col("root").alias("first"))
    others = rooted.join(first, "key").groupBy("key").agg(most(F.col("root") != F.col("first")).alias("fp")).filter("fp is not null")
    seconds = others.join(rooted, ["key", "fp"]).select("key", F.col("fp").alias("head"), F.col("root").alias("head_root"))
    links_ = links_.unionByName(star(seconds))
    rooted = with_roots(links_)
    parted = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key")
    left = rooted.join(parted, "key", "left_semi").select("key", "fp", "root")
    links_ = links_.unionByName(materialise(_apart(left, sets, similarity), "rest"))
    classes = materialise(_classes(nodes.select("fp", "least"), links_), "classes")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id", "component_fp")


def drop_near_copies(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """As drop_near_duplicates(), over the components of near_copies()."""
    return _first_of_each(docs, lambda own: near_copies(own, shingle=shingle, similarity=similarity).withColumn("text_hash", F.col("fp")))
