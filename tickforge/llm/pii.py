"""Personal data by pattern, and terms that disclose it by their co-occurrence in the corpus."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialise, shielded

#: The kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A text without a match of this (Java or Python) holds no base span.
HINT = "[0-9@]"

# The same matches in time linear in the text: a mail address has its local part up to an @ and its
# domain after it; an address of numbers begins where a run of digits does.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
_RUN_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mails(text: str) -> list[tuple[int, int]]:
    """Places of EMAIL."""
    out, begin, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > begin and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        begin = m.end() if m else at + 1
        at = text.find("@", begin)
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind; leftmost, non-overlapping within a kind."""
    if not text:
        return []
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in mails(text)]
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _RUN_IP.finditer(text) if all(len(p) < 4 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def entity(kind: str, found: str) -> str:
    """One name for all ways to write a protected value."""
    return f"{kind}:{found.lower() if kind in ('email', 'ip') else _NOT_DIGIT.sub('', found)}"


def nearby(text: str, start: int, end: int, reach: int) -> list[str]:
    """Lower-cased terms (letters, three at least) among `reach` on either side within the line."""
    return Terms(text).near(start, end, reach)


class Terms:
    """A text's terms with their places, found once however many entities ask; whole terms, whatever their length."""

    def __init__(self, text: str):
        self.text, self.found = text, [(m.start(), m.end()) for m in _TERM.finditer(text)]
        self.starts = [s for s, _ in self.found]

    def near(self, start: int, end: int, reach: int) -> list[str]:
        low, high = self.text.rfind("\n", 0, start) + 1, self.text.find("\n", end)
        high = high if high >= 0 else len(self.text)
        # A term that the span cuts counts by what stands outside, if that is a term.
        a, b = bisect_left(self.starts, start), bisect_left(self.starts, end)
        left = [(s, e) for s, e in self.found[max(0, a - reach - 1) : a] if s >= low]
        if left and left[-1][1] > start:
            left[-1] = (left[-1][0], start)
        right = self.found[b : b + reach + 1]
        if b and self.found[b - 1][1] > end:
            right = [(end, self.found[b - 1][1]), *right]
        near = [self.text[s:e] for s, e in left if e - s >= 3][-reach:] + [self.text[s:e] for s, e in right if s < high and e - s >= 3][:reach]
        return [t.lower() for t in near]


def term_spans(text: str, terms: set[str], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places of whole terms, outside spans already taken."""
    found = [(m.start(), m.end()) for m in _TERM.finditer(text) if m[0].lower() in terms]
    return [(s, e) for s, e in found if not any(s < b and a < e for a, b in taken)]


#: Buckets of the filter of candidate terms: a fixed size, whatever the corpus.
BUCKETS = 1 << 20


def _bucket(term: str) -> int:
    """As xxhash64() of Spark, its last bits."""
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), 42) % BUCKETS


def _term_bits(candidates: DataFrame) -> bytes:
    """A bitmap of BUCKETS bits of the terms' hashes."""
    bucket = F.xxhash64("term").bitwiseAND(F.lit(BUCKETS - 1))
    own = candidates.select((bucket % 32768).alias("bit"), F.shiftright(bucket, 15).alias("page")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = bytearray(BUCKETS // 8)
    for row in own.collect():  # BUCKETS / 32768 rows of 4096 bytes at most
        bits[4096 * row["page"] : 4096 * (row["page"] + 1)] = row["bits"]
    return bytes(bits)


def _marked_in(bits: bytes) -> Callable[[str], bool]:
    """Whether a term's bit is set; terms asked for lately are remembered."""
    known = {}

    def wanted(t: str) -> bool:
        got = known.get(t)
        if got is None:
            if len(known) > 500_000:
                known.clear()
            b = _bucket(t)
            got = known[t] = bool(bits[b >> 3] >> (b & 7) & 1)
        return got

    return wanted


def document_frequencies(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(term, n): how many documents hold each term of `candidates`, counted over all documents.

    A bitmap of BUCKETS bits of the candidates' hashes goes to the tasks, which count terms whose bit
    is set and emit partial sums; terms that only share a bit drop out in the join.
    """
    bits = _term_bits(candidates)
    some = any(bits)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        counts, wanted = Counter(), _marked_in(bits)
        if not some:
            return
        for b in batches:
            for text in b["text"]:
                if text:
                    counts.update(filter(wanted, set(_TERM.findall(text.lower()))))
            if len(counts) > 200_000:
                yield {"term": list(counts), "n": list(counts.values())}
                counts.clear()
        yield {"term": list(counts), "n": list(counts.values())}

    parts = map_rows(docs.select(F.col("text").cast("string").alias("text")), run, "term string, n long")
    return parts.groupBy("term").agg(F.sum("n").alias("n")).join(candidates, "term", "left_semi")


def _terms_held(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(k1, k2, term): which of the candidates, and of terms that share their bits, each text (k1, k2, text) holds."""
    bits = _term_bits(candidates)
    some = any(bits)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        wanted = _marked_in(bits)
        if not some:
            return
        for b in batches:
            yield {"k1": b["k1"], "k2": b["k2"], "terms": [list(filter(wanted, {x.lower() for x in _TERM.findall(t)})) for t in b["text"]]}

    return map_rows(texts, run, "k1 long, k2 long, terms array<string>").select("k1", "k2", F.explode("terms").alias("term"))


def find_spans(docs: DataFrame, *, reach: int = 8, threshold: float = 0.9, documents: int = 2) -> DataFrame:
    """Rows (doc_id, k1, k2, spans): personal data of every whole text, with terms that disclose it.

    Protected entities are the values of base spans. A term within `reach` terms of one in its line
    discloses it if it stands near it in at least `documents` documents, copies of one passage among
    them, and the share of the entity's information that it gives, log(N n(t,e) / (n(t) n(e))) /
    log(N / n(e)) over the documents of the corpus, is at least `threshold`. In documents that hold
    the entity, the term's occurrences are spans of kind "term". Documents without personal data get
    no spans. What stands together in one document only is no evidence: every rare word would do.

    k1, k2 key the row's content. Null and empty texts have no spans; null and repeated ids and rows
    stay, equal rows getting equal spans; an empty table gives none; other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", F.lit(1), "doc_id")})

    def scan(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out = {c: b[c] for c in ("doc_id", "k1", "k2")} | {"spans": [], "near": []}
            for text in b["text"]:
                spans, near = base_spans(text), defaultdict(set)
                terms = Terms(text) if spans else None
                for kind, s, e in spans:
                    near[entity(kind, text[s:e])].update(terms.near(s, e, reach))
                out["spans"].append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                out["near"].append([{"entity": k, "terms": sorted(t)} for k, t in near.items()])
            yield out

    marked = materialise(map_rows(own, scan, "doc_id long, k1 long, k2 long, spans array<struct<kind:string,start:int,end:int>>, near array<struct<entity:string,terms:array<string>>>"), "marked")
    holds = marked.filter(F.size("near") > 0).select("k1", "k2", F.explode("near").alias("x")).select("k1", "k2", "x.entity", "x.terms")
    # A row names an entity once, with every term near any of its places, so rows are counted on all sides.
    together = holds.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    likely = materialise(together.filter(F.col("n_both") >= documents), "likely")
    with_entity = holds.groupBy("entity").agg(F.count("*").alias("n_entity"))
    with_term = document_frequencies(docs, likely.select("term").distinct()).withColumnRenamed("n", "n_term")
    n_docs = marked.count()
    given = F.log2(F.lit(float(n_docs)) * F.col("n_both") / (F.col("n_term") * F.col("n_entity"))) / F.log2(F.lit(float(n_docs)) / F.col("n_entity"))
    disclosing = likely.join(with_entity, "entity").join(with_term, "term").filter((F.col("n_entity") < n_docs) & (given >= threshold)).select("entity", "term")
    disclosing = materialise(disclosing, "disclosing")
    # Only texts that can hold an entity travel. A text meets the terms that it holds, not all of its entities' terms.
    texts = own.filter(F.col("text").rlike(HINT)).select("k1", "k2", "text")
    held = _terms_held(texts, disclosing.select("term").distinct()).distinct()
    met = held.join(holds.select("k1", "k2", "entity").distinct(), ["k1", "k2"]).join(disclosing, ["entity", "term"], "left_semi")
    terms = met.groupBy("k1", "k2").agg(F.collect_set("term").alias("terms"))

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def place(text: pd.Series, terms: pd.Series) -> pd.Series:  # noqa: ANN202
        return pd.Series([[{"kind": "term", "start": s, "end": e} for s, e in term_spans(t, set(x), [(a, b) for _, a, b in base_spans(t)])] for t, x in zip(text, terms, strict=True)])

    extra = texts.join(terms, ["k1", "k2"]).select("k1", "k2", place("text", "terms").alias("extra")).dropDuplicates(["k1", "k2"])
    joined = marked.select("doc_id", "k1", "k2", "spans").join(extra, ["k1", "k2"], "left")
    every = F.concat("spans", F.coalesce("extra", F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")))
    kinds = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    ranked = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("rank"), s["end"].alias("end"))))
    return joined.select("doc_id", "k1", "k2", F.transform(ranked, lambda s: F.struct(F.element_at(kinds, s["rank"].cast("int")).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """docs with every span of find_spans() generalised to its kind in angle brackets; overlapping spans become one.

    All rows and columns stay, whatever their names; texts without spans, null and empty ones are as
    they were; texts of any length are taken whole; an empty table gives an empty one.
    """

    @F.pandas_udf("string")
    def generalise(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(text, spans, strict=True):
            parts, at = [], 0
            for s in [] if own is None else own:
                if s["start"] >= at:
                    parts += [t[at : s["start"]], f"<{s['kind']}>"]
                at = max(at, s["end"])
            out.append("".join([*parts, t[at:]]) if t is not None else None)
        return pd.Series(out)

    found = find_spans(docs, **options).filter(F.size("spans") > 0).dropDuplicates(["k1", "k2"]).select("k1", "k2", "spans")
    own, back = shielded(docs, ("doc_id", "text"))
    hint = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    keyed = own.filter(hint).withColumns({"k1": F.xxhash64(doc_id, text), "k2": F.xxhash64(text, F.lit(1), doc_id)})
    changed = keyed.join(found, ["k1", "k2"], "left").withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(generalise("text", "spans")))
    return back(own.filter(~hint).unionByName(changed.select(*own.columns)))
