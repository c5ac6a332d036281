"""Each operator against a brute-force version, on the small tables and on rows made to break it."""

import bisect
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("tickforge.llm")
from tickforge.llm import chat, common, lm, mixing, neardup, ogg, packing, pii, quality, queries, substrings, viterbi  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
ODD_TEXTS = [None, "", "   ", "one", "a b c", "é  ü\n\n\tx\u00a0y", LONG, "same text here again", "same text here again", "😀 " * 70, "a\r\nb\x0bc\x0cd", "x" * 5000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, part int, size long, spans string, quality string, words string"


def odd_docs(spark):
    rows = [(i, t, "en", ["s1", None, "s2"][i % 3], 1, 5, 6, 7, "x", "y", "z") for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "no id", None, None, None, None, None, None, None, None, None), rows[4], (3, "another text", "en", "s1", 0, 0, 0, 0, "", "", "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def table(sf, name):
    return duckdb.sql(f"select * from '{sf}/{name}.parquet'").fetchall()


def ws(text):
    return WORD.findall(text or "")


def own(df):
    return [tuple(r) for r in df.collect()]


def key(row):
    return tuple((x is None, str(type(x)), x) for x in row)


# ---- 1: mixing


def test_mix_meets_targets(spark, sf):
    rows = [r.asDict() for r in queries.op1_mix_sources(spark, sf).collect()]
    docs = table(sf, "documents")
    assert len(rows) == len(docs)
    sizes = {d[0]: len(ws(d[1])) for d in docs}
    source = {d[0]: d[3] for d in docs}
    total = defaultdict(int)
    for i, n in sizes.items():
        total[source[i]] += n
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, open_, left = {}, set(names), 1.5 * sum(total.values())
    while open_:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 2 * total[s]]
        if not over:
            goal |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            goal[s] = 2 * total[s]
        left -= sum(goal[s] for s in over)
        open_ -= set(over)
    taken = defaultdict(int)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == total[s]
        assert r["target"] == pytest.approx(goal[s], rel=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - goal[s]) <= 0.02 * goal[s] + 30, (s, taken[s], goal[s])
    again = own(queries.op1_mix_sources(spark, sf))
    assert sorted(again) == sorted(tuple(r.values()) for r in rows)


def test_mix_solves_the_dual(spark):
    """Rates are min(2, exp(lam x)) of one lam a source, and make the targets, as a scalar search finds."""
    sizes = spark.createDataFrame([("a", i, 1 + i % 4) for i in range(1, 60)] + [("b", 7, 5)], "source string, size long, n long")
    goals = spark.createDataFrame([("a", 4418, 3000.0), ("b", 35, 70.0)], "source string, source_size long, target double")
    got = {r["source"]: r for r in mixing.balance(sizes, goals, 2.0).collect()}
    assert got["b"]["full"] and not got["a"]["full"]
    cells = [(i, 1 + i % 4) for i in range(1, 60)]
    made = lambda lam: sum(n * s * min(2, math.exp(lam * s / got["a"]["scale"])) for s, n in cells)
    assert made(got["a"]["lam"]) == pytest.approx(3000, rel=1e-6)


def test_mix_odd_rows(spark):
    assert mixing.mix(empty_docs(spark)).count() == 0
    docs = odd_docs(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    assert all(0 <= r["copies"] <= 2 for r in got)
    assert {r["source"] for r in got} == {"s1", "s2", None}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    many = Counter(key(r) for r in own(out))
    assert max(many.values()) <= 4


def test_mix_of_alike_rows(spark):
    """The mix of a table in which many rows are alike takes the same words as mix() says, from any split; columns may have any names."""
    rows = [(i, "s1" if i % 2 else "s2", " ".join(["w"] * (1 + i % 9)), i) for i in range(60)] + [(900, "s1", "one two three", i) for i in range(7)] + [(None, "s2", "four five", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, __n int").withColumnsRenamed({}).withColumns({"copies": F.lit(1), "rows": F.lit("x"), "times": F.lit(2)})
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["source"]] += r["copies"] * r["size"]
    for n in (1, 5):
        out = mixing.mixed(docs.repartition(n))
        assert out.columns == docs.columns
        got = Counter()
        for r in out.collect():
            got[r["source"]] += len(ws(r["text"]))
        assert got == want
    assert mixing.mixed(docs.limit(0)).count() == 0
    again = Counter(own(mixing.mix(docs.repartition(7))))
    assert again == Counter(own(mixing.mix(docs)))


def test_mix_splits_large_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 8)
    docs = spark.range(1000).selectExpr("id doc_id", "'one two three' text", "if(id % 3 = 0, 'a', 'b') source")
    got = mixing.mix(docs).groupBy("source").sum("copies").collect()
    # 4500 words; a weighs 3 and stops at 2 * 1002, b gets the rest.
    assert sorted(tuple(r) for r in got) == [("a", 668), ("b", 832)]


# ---- 2: packing


def check_packing(pieces, docs, tokenizer, capacity=2048):
    want = {}
    for d in docs:
        ids = tokenizer.encode(d[1] or "", add_special_tokens=False).ids + [0]
        want.setdefault((d[0], tuple(ids)), 0)
        want[(d[0], tuple(ids))] += 1
    fill = defaultdict(list)
    by = defaultdict(list)
    for r in pieces:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
        by[r["doc_id"]].append(r)
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return want, by, fill


def test_pack(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = table(sf, "documents")
    pieces = [r.asDict() for r in queries.op2_pack_sequences(spark, sf).collect()]
    want, by, fill = check_packing(pieces, docs, t)
    total = 0
    for (doc_id, ids), _ in want.items():
        mine = sorted(by[doc_id], key=lambda r: r["piece"])
        assert [r["start"] for r in mine] == [0, *itertools.accumulate(r["length"] for r in mine)][:-1]
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        assert all(r["length"] == 2048 for r in mine[1:]) and sum(r["length"] for r in mine) == len(ids)
        for r in mine:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) == r["ids_crc32"]
        total += len(ids)
    assert len(fill) <= 1.1 * -(-total // 2048) + 2


def test_fast_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    t, fast = Tokenizer.from_file(path), packing.ByteTokenizer(path)
    t.encode_special_tokens = True
    assert fast.fast is not None
    texts = [x for x in ODD_TEXTS if x] + ["".join(x) for x in itertools.product(" \n\u00a0a.'", repeat=5)] + ["<|endoftext|> it's 3.5  — ok", "a  ", "  a", "\u3000 \u3000b", "\x85\x1c a\u180e \u200b", "ǅ ª² ١٢ Ⅷ ẞ", "y" * 9000]
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        assert fast.encode(x) == b"".join(i.to_bytes(4, "little") for i in ids), repr(x)


def test_best_fit_is_best_fit():
    import random

    rng = random.Random(3)
    fit, bins, made = packing.BestFit(50, 6), [], 0  # bins: free space of each open one
    for _ in range(3000):
        n = rng.randint(1, 50)
        fitting = [b for b in bins if b >= n]
        if fitting:
            free = min(fitting)
            bins.remove(free)
        else:
            free, made = 50, made + 1
            if len(bins) >= 6 and n < 50:
                bins.remove(min(bins))
        assert fit.place(n)[1] == 50 - free
        if free > n:
            bins.append(free - n)
        assert (fit.n_open, fit.made) == (len(bins), made)


def test_pack_odd_rows(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    docs = odd_docs(spark)
    pieces = [r.asDict() for r in packing.pack_documents(docs, path).collect()]
    want, by, _ = check_packing(pieces, [(r["doc_id"], r["text"]) for r in docs.collect()], Tokenizer.from_file(path))
    assert sum(r["length"] for r in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    assert packing.pack_documents(empty_docs(spark), path).count() == 0


# ---- 3: quality


def base_counts(text):
    text = text or ""
    w = ws(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    n = len(w)
    return (n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n)


def buckets(text, size):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    w = [x.encode() for x in ws(text)]
    h = lambda x, seed=42: xxhash.xxh64_intdigest(x, seed)
    return [signed(h(x)) % size for x in w] + [signed(h(b, h(a))) % size for a, b in itertools.pairwise(w)]


def check_quality(rows, docs, labels, size, threshold):
    trusted = {i for i, q, t in labels if q == 1 and not t}
    n, t = Counter(), Counter()
    for i, text in docs:
        f = buckets(text, size)
        n.update(f)
        if i in trusted:
            t.update(f)
    ratio = [math.log((t[b] + 1) / (t.total() + size)) - math.log((n[b] + 1) / (n.total() + size)) if t.total() else 0.0 for b in range(size)]
    want, threshold = [], threshold - size / max(t.total(), 1)
    for i, text in docs:
        f = buckets(text, size)
        score = sum(ratio[b] for b in f) / len(f) if f else None
        c = base_counts(text)
        want.append((i, *c, score, not c[5] and score is not None and score >= threshold))
    for a, b in zip(sorted(rows, key=key), sorted(want, key=key), strict=True):
        assert a[:7] == b[:7] and a[8] == b[8]
        assert a[7] == (None if b[7] is None else pytest.approx(b[7], abs=1e-9))


def test_quality(spark, sf):
    docs = [(d[0], d[1]) for d in table(sf, "documents")]
    check_quality(own(queries.op3_quality_rules(spark, sf)), docs, table(sf, "labels"), 10_000, -0.03)


def test_quality_keeps_good_and_drops_bad(spark):
    """At sf0.01: nearly all documents labelled good stay, nearly all labelled bad go."""
    sf = "/root/testdata/sf0.01"
    kept = {r["doc_id"]: r["kept"] for r in queries.op3_quality_rules(spark, sf).filter("n_words >= 50").collect()}
    mark = {i: q for i, q, _ in table(sf, "labels") if i in kept}
    good = [kept[i] for i, q in mark.items() if q == 1]
    bad = [kept[i] for i, q in mark.items() if q == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.25 * len(bad)


def test_quality_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, 0), (4, 1, 0), (None, 1, 0), (7, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    got = own(quality.judge(docs, labels, buckets=97).select("doc_id", "quality.*"))
    check_quality(got, [(r["doc_id"], r["text"]) for r in docs.collect()], [(4, 1, 0), (6, 1, 0)], 97, -0.03)
    assert quality.judge(empty_docs(spark), labels).count() == 0
    none = own(quality.judge(docs, labels.limit(0)).select("quality.score"))
    assert {x for x, in none} == {0.0, None}
    assert quality.keep_good(docs, labels).columns == docs.columns


# ---- 4: token counts


def test_token_counts_equal_the_tokenizer(spark, sf):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = queries.vocabulary("piece_bpe_32k.model")
    pieces, unknown = viterbi.piece_scores(path)
    extra = ["日本語テキスト 中文 😀😀 x", "a  b\n\n c   ", " ", "▁x", "<s>hi</s> <unk>", " 一二三 ꙮꙮ ꙮ"]
    for fallback in (True, False):
        t = Tokenizer(models.Unigram(pieces, unknown, fallback))
        t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        counter = viterbi.CountingViterbi(pieces, fallback, keep=100)
        for text in extra + [x for x in ODD_TEXTS if x]:
            assert counter.count(text)[0] == len(t.encode(text, add_special_tokens=False).ids)
    t = Tokenizer(models.Unigram(pieces, unknown, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op4_token_counts(spark, sf).collect()}
    assert got == {d[0]: len(t.encode(d[1] or "", add_special_tokens=False).ids) for d in table(sf, "documents")}


def test_control_strings_are_text():
    """Names of control and byte pieces in a text are characters, and pieces' shares are probabilities."""
    path = queries.vocabulary("piece_bpe_32k.model")
    pieces, _ = viterbi.piece_scores(path)
    counter = viterbi.CountingViterbi(pieces)
    assert [counter.count(x)[0] for x in ("x</s>", "x<0x41>")] == [4, 7]
    text = [s for p, s in pieces if p not in ("<s>", "</s>", "<unk>") and not re.fullmatch("<0x[0-9A-F]{2}>", p)]
    assert sum(map(math.exp, text)) == pytest.approx(1)


def test_viterbi_ties():
    """Against all segmentations of short strings, with the library's rule for ties."""
    from tokenizers import Tokenizer, models

    vocab = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aa", -2.0), ("ba", -2.0), ("aab", -3.0), ("▁", -1.0), ("▁a", -2.0)]
    t = Tokenizer(models.Unigram(vocab, 0, False))
    counter = viterbi.CountingViterbi(vocab, False)
    for n in range(1, 8):
        for x in itertools.product("abc", repeat=n):
            text = "".join(x)
            assert counter.count(text)[0] == len(t.encode("▁" + text).ids)


def test_token_counts_odd_rows(spark):
    path = queries.vocabulary("piece_bpe_32k.model")
    got = viterbi.count_tokens(odd_docs(spark), path).collect()
    assert len(got) == 15 and {r["n_tokens"] for r in got if r["n_chars"] == 0} == {0}
    assert viterbi.count_tokens(empty_docs(spark), path).count() == 0


# ---- 5: language model


def check_lm(rows, docs, held, discount=0.5, top=0.5, slack=1.0):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    said = [[w.translate(low) for w in ws(t)] + [""] for _, t in docs]
    c, pairs, history = Counter(), Counter(), Counter()
    for (i, _), w in zip(docs, said, strict=True):
        if not held(i):
            c.update(w)
            pairs.update(itertools.pairwise(["\n", *w]))
            history.update(["\n", *w][:-1])
    n, v = c.total(), len(c)
    want = []
    for (i, _), w in zip(docs, said, strict=True):
        score, before = 0.0, "\n"
        for x in w:
            p = (c[x] - discount) / n if c[x] else discount * v / n if n else 1.0
            h = history[before]
            share = top * h / (h + slack)
            score += math.log10(share * pairs[before, x] / h + (1 - share) * p if h else p)
            before = x
        want.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), score))
    for a, b in zip(sorted(rows, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], abs=2e-6, rel=1e-9)


def test_lm(spark, sf, monkeypatch):
    docs = [(d[0], d[1]) for d in table(sf, "documents")]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    check_lm(own(queries.op5_lm_scores(spark, sf)), docs, held)


def test_lm_sums_to_one():
    import numpy as np

    # Words a (3 times), b (once); a is a history 3 times, followed twice by a and once by b.
    m = lm.BackoffAutomaton(4, 2, 0.5, 0.5, 1.0)
    p = m.root(np.array([3, 1, 0]))
    assert p.sum() == pytest.approx(1)
    share = 0.5 * 3 / 4
    assert sum(share * x / 3 + (1 - share) * q for x, q in zip((2, 1, 0), p, strict=True)) == pytest.approx(1)


def test_lm_beats_the_base_on_held_out(spark):
    rows = queries.op5_lm_scores(spark, "/root/testdata/sf0.01").filter("held_out").selectExpr("sum(score) / sum(n_tokens)", "sum(base_score) / sum(n_tokens)").first()
    assert rows[0] > rows[1] + 0.3


def test_lm_segments():
    """Segments of any size give the scores of one traversal, texts and states carried across their edges."""
    import numpy as np

    rng = np.random.default_rng(3)
    vocabulary = np.sort(np.array([lm.START, lm.END, 5, 77, 1 << 40, 1 << 50], np.uint64))
    lengths = np.array([1, 7, 30, 2, 60])
    tokens = rng.integers(0, 6, lengths.sum())
    b = lm.Bigrams(vocabulary, tokens, lengths)
    m = lm.BackoffAutomaton(100, 5, 0.5, 0.5, 1.0)
    m.build(b, rng.integers(0, 30, 6), rng.integers(0, 30, 6), rng.integers(0, 3, len(b.codes)))
    first = int(np.searchsorted(vocabulary, np.uint64(lm.START)))
    whole = [m.traverse(m.arcs(0, 100), first, tokens[s : s + n].tolist())[1] for s, n in zip(b.starts, lengths, strict=True)]
    for size in (1, 3, 10, 1000):
        lm.SEGMENT, before = size, lm.SEGMENT
        assert m.scores(first, lengths.tolist()) == pytest.approx(whole, rel=1e-12)
        lm.SEGMENT = before


def test_lm_odd_rows(spark):
    docs = odd_docs(spark)
    held = F.col("doc_id") % 4 == 2
    rows = own(lm.score_texts(docs, held))
    check_lm(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], lambda i: i is not None and i % 4 == 2)
    assert lm.score_texts(empty_docs(spark), held).count() == 0
    alone = lm.score_texts(docs, F.lit(True)).collect()
    assert {r["train_tokens"] for r in alone} == {0} and {r["n_known"] for r in alone} == {0}


# ---- 6: near duplicates


def brute_fingerprint(text):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    w = [x.translate(low) for x in ws(text)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check_components(rows, docs, radius=2):
    fps = [(i, brute_fingerprint(t)) for i, t in docs]
    nodes = sorted({f for _, f in fps})
    parent = {f: f for f in nodes}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in itertools.combinations(nodes, 2):
        if (a ^ b).bit_count() <= radius:
            parent[root(a)] = root(b)
    least = defaultdict(list)
    for i, f in fps:
        if i is not None:
            least[root(f)].append(i)
    want = [(i, f"{f:016x}", min(least[root(f)], default=None)) for i, f in fps]
    assert sorted(rows, key=key) == sorted(want, key=key)


def test_near_duplicates(spark, sf):
    check_components(own(queries.op6_near_duplicates(spark, sf)), [(d[0], d[1]) for d in table(sf, "documents")])


def test_near_duplicates_odd_rows(spark):
    docs = odd_docs(spark)
    got = neardup.near_duplicates(docs).select("doc_id", neardup.hex_fingerprint(F.col("fp")), "component_id")
    check_components(own(got), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert neardup.near_duplicates(empty_docs(spark)).count() == 0
    one = neardup.drop_near_duplicates(docs)
    assert one.columns == docs.columns
    assert sorted(r["doc_id"] for r in one.collect() if r["doc_id"] is not None) == [0, 3, 3, 4, 5, 6, 7, 9, 10, 11]


def test_near_copies(spark):
    """Planted copies with edited words: links are exactly the pairs of five-word shingle similarity 0.8 at least, in steps."""
    import random

    rng = random.Random(5)
    rows = []
    for base in range(40):
        text = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))]
        rows.append(text)
        for _ in range(4):
            rows.append([x if rng.random() > 0.002 * (base % 12) else f"e{rng.randrange(3000)}" for x in text])
    chain = [f"c{i}" for i in range(300)]
    rows += [chain, chain[:-20] + ["x"] * 20, chain[40:-20] + ["x"] * 20, ["Short", "text"], ["short", "text"], []]
    docs = [(i, " ".join(r)) for i, r in enumerate(rows)] + [(900, None), (None, "short text"), (901, docs_copy := " ".join(rows[0])), (901, docs_copy)]

    def grams(t):
        w = [x.lower() for x in ws(t)]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, parent = [grams(t) for _, t in docs], list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = [(i, j) for i, j in itertools.combinations(range(len(docs)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    far = sum((brute_fingerprint(docs[i][1]) ^ brute_fingerprint(docs[j][1])).bit_count() > 2 for i, j in pairs)
    assert far > 50
    for i, j in pairs:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)].append(d)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = own(neardup.near_copies(df).select("doc_id", "component_id"))
    assert sorted(got, key=key) == sorted(((d, min(least[root(i)])) for i, (d, _) in enumerate(docs)), key=key)
    kept = neardup.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(min(v) for v in least.values())
    assert neardup.drop_near_copies(empty_docs(spark)).count() == 0
    assert neardup.drop_near_copies(odd_docs(spark)).columns == odd_docs(spark).columns


def test_near_copies_meet_by_fingerprints(spark, monkeypatch):
    """Candidates are fingerprints that share a band's value and link there within the radius: as brute force says, blocks or not; radius 0 finds no edited copy."""
    import numpy as np

    def parts(n, pairs):
        label = list(range(n))
        for i, j in pairs:
            label = [label[i] if v == label[j] else v for v in label]
        return {frozenset(k for k in range(n) if label[k] == v) for v in label}

    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, (240, neardup.PRINT)).astype("<u8")
    for i in range(240):
        if i % 6:  # differs from one before in a sixth of bits
            flips = np.packbits(rng.random(neardup.PRINT * 64) < 0.17, bitorder="little").view("<u8")
            prints[i] = prints[i - 1 - i % 2] ^ flips
    apart = lambda i, j: int(np.bitwise_count(prints[i, : neardup.NEAR] ^ prints[j, : neardup.NEAR]).sum())
    group = np.sort(rng.integers(0, 9, 240))
    for radius in (0, 17, 24, 36, 50, 64):
        got = neardup.near_parts(group, prints[:, : neardup.NEAR], radius).tolist()
        want = parts(240, [(i, j) for i in range(240) for j in range(i) if group[i] == group[j] and apart(i, j) <= radius])
        assert parts(240, enumerate(got)) == want
    values = [{(w, b, int(x[w]) >> 12 * b & 4095) for w in range(neardup.PRINT) for b in range(5)} for x in prints]
    want = parts(240, [(i, j) for i in range(240) for j in range(i) if values[i] & values[j] and apart(i, j) <= neardup.RADIUS])
    assert 20 < len(want) < 200
    nodes = spark.createDataFrame([(i, x.view("<i8").tolist()) for i, x in enumerate(prints)], "fp long, print array<long>")
    for most in (neardup.PRINTS, 2):
        monkeypatch.setattr(neardup, "PRINTS", most)
        assert parts(240, [(r["key"], r["fp"]) for r in neardup._meetings(nodes, neardup.RADIUS).collect()]) == want
    text = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join(text[: 50 * i] + ["x"] * (i > 0) + text[50 * i :])) for i in range(4)], "doc_id long, text string")
    assert {r["component_id"] for r in neardup.near_copies(docs).collect()} == {0}
    assert {r["component_id"] for r in neardup.near_copies(docs, radius=0).collect()} == {0, 1, 2, 3}


CLASHES = ["__text_hash", "text_hash", "__hash", "__id", "fp", "root", "__k1", "k1", "k2", "spans", "__spans", "component_fp", "first_id", "column 0", "quality", "__trusted", "words", "rows", "copies", "__n", "times"]


def test_stages_keep_clashing_columns(spark):
    """Every stage that returns documents keeps columns of any names, long texts and empty tables."""
    long = " ".join(f"word{i % 5000}of{i // 7}" for i in range(60_000)) + " mail a@b.cd"
    docs = spark.createDataFrame([(1, long, "s1"), (2, long, "s1"), (3, "call me at jo@ex.org", "s2"), (None, None, None)], "doc_id long, text string, source string").withColumns({c: F.lit(c) for c in CLASHES})
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for stage, n in ((lambda d: quality.keep_good(d, labels, threshold=-99.0), 2), (neardup.drop_near_duplicates, 3), (neardup.drop_near_copies, 3), (pii.sanitise, 4)):
        out = stage(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert len(rows) == n and all(r[c] == c for r in rows for c in CLASHES)
        assert stage(docs.limit(0)).count() == 0
    assert mixing.mixed(docs).columns == docs.columns and all(r[c] == c for r in mixing.mixed(docs).collect() for c in CLASHES)


@pytest.mark.parametrize("radius", [0, 1, 3, 7, 20])
def test_bit_planes_of_any_radius(radius):
    import random

    rng = random.Random(radius)
    values = [0] + [sum(1 << j for j in rng.sample(range(64), k)) for k in range(1, 40)]
    places = [j for j in range(64) if j % 3]
    planes = neardup.BitPlanes(values, places)
    mask = sum(1 << j for j in places)
    for v in values:
        assert planes.within(v, radius) == sum(1 << i for i, x in enumerate(values) if ((x ^ v) & mask).bit_count() <= radius)


def test_bit_planes():
    import random

    rng = random.Random(1)
    values = [rng.getrandbits(64) for _ in range(50)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.randrange(2) << rng.randrange(64)) for v in values]
    planes = neardup.BitPlanes(values, list(range(64)))
    for v in values:
        assert planes.within(v, 2) == sum(1 << i for i, x in enumerate(values) if (x ^ v).bit_count() <= 2)


def test_links_follow_chains(spark):
    """A path of fingerprints, each two bits from the next, is one component; blocks of comparison split it."""
    fps = [0]
    for i in range(0, 40, 2):
        fps.append(fps[-1] ^ (3 << i))
    nodes = spark.createDataFrame([(neardup._signed(f),) for f in fps], "fp long")
    edges = neardup.links(nodes).withColumnsRenamed({"a": "u", "b": "v"})
    assert {r["root"] for r in neardup.components(edges).collect()} == {min(fps)}


def test_links_of_divided_groups(spark, monkeypatch):
    """Many fingerprints that agree in half their bits, keys divided again: the same components as all pairs."""
    import random

    monkeypatch.setattr(neardup, "GROUP", 10)
    rng = random.Random(8)
    fps = {(0xABCD1234 << 32) | (rng.getrandbits(32) & 0x0F0F0F0F) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)}
    nodes = spark.createDataFrame([(neardup._signed(f),) for f in fps], "fp long")
    got = {(r["a"], r["b"]) for r in neardup.links(nodes).collect()}
    parent = {neardup._signed(f): neardup._signed(f) for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def parts(edges):
        parent.update({x: x for x in parent})
        for a, b in edges:
            parent[root(a)] = root(b)
        return {frozenset(y for y in parent if root(y) == root(x)) for x in parent}

    want = [(neardup._signed(a), neardup._signed(b)) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2]
    assert parts(got) == parts(want)
    assert all((a ^ b).bit_count() <= 2 for a, b in got)


def test_components_of_random_graphs(spark):
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    got = dict(own(neardup.components(spark.createDataFrame(edges, "u long, v long"))))
    parent = list(range(300))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    touched = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {x: root(x) for x in touched if root(x) != x} or got == {x: root(x) for x in touched}


# ---- 7: Ogg


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


def test_ogg_checksum():
    for data in (b"", b"OggS", bytes(range(256)) * 3):
        assert ogg.page_checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("n", [64, 128, 4032, 64_000, 65_024, 255 * 255 * 2, 300_032])
@pytest.mark.parametrize("packet", [255, 510, 4000, 70_000])
def test_ogg_round_trip(n, packet):
    payload = (hashlib.sha256(str(n).encode()).digest() * (n // 32 + 1))[:n]
    data = ogg.encode_ogg(payload, b"17", packet=packet)
    got = ogg.decode_ogg(data)
    assert got["payload"] == payload and got["note"] == b"17" and got["seconds"] == n / 8000 and got["streams"] == 2
    for at in (5, 22, len(data) // 2, len(data) - 1):
        with pytest.raises(ogg.Damaged):
            ogg.decode_ogg(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ogg.Damaged):
        ogg.decode_ogg(data[:-10])


def test_ogg_lost_page():
    pages = [p for p in ogg.mux_stream(7, [(b"h" * 20, 0), (b"x" * 200_000, 5), (b"y", 6)])]
    assert len(pages) > 3
    assert [len(p) for p in ogg.demux(b"".join(pages))[7]["packets"]] == [20, 200_000, 1]
    with pytest.raises(ogg.Damaged):
        ogg.demux(b"".join(pages[:2] + pages[3:]))


def check_media(rows, docs):
    seen, want = {}, Counter()
    for i, t in docs:
        raw = (t or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        want[(i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))] += 1
    assert Counter(r[:5] for r in rows) == want
    for r in rows:
        assert seen.setdefault(r[3], r[5:]) == r[5:]


def test_media(spark, sf):
    rows = own(queries.op7_ogg_media(spark, sf).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"))
    check_media(rows, [(d[0], d[1]) for d in table(sf, "documents")])


def test_media_odd_rows(spark):
    docs = odd_docs(spark)
    got = ogg.read_ogg(ogg.write_ogg(docs)).collect()
    assert len(got) == docs.count() and all(r["error"] is None for r in got)
    broken = ogg.read_ogg(spark.createDataFrame([(1, bytearray(b"OggS junk")), (2, None)], "doc_id long, media binary")).collect()
    assert all(r["error"] and r["payload"] is None for r in broken)
    assert ogg.read_ogg(ogg.write_ogg(empty_docs(spark))).count() == 0


# ---- 8: personal data


def brute_spans(text):
    text, out = text or "", []
    out += [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


MAIL = ["a@b.c", "@x.y a..b@c-d.e.f@g.h", "x@y z@w.v.", "é.a@b.co 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (415) 555-2671, +44 20 7946 0958 +1 2", "++1 234 567 8901 +12@a.b", "1" * 40, "a@" * 50 + "b.c"]


MAIL += ["1.2.3.4.5 11.22.33.44a@b.c.d..e@f", "x@a-.b_.c 0.0.0.0 00000000256.1.1.1 300.1.2.3.4", "a@b@c.d @e.f g@.h i@j.k@l.m"]


@pytest.mark.parametrize("text", MAIL)
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_of_random_texts():
    import random

    rng = random.Random(12)
    for _ in range(20_000):
        text = "".join(rng.choices("a1.@-+ _%(", k=rng.randint(1, 24)))
        assert pii.base_spans(text) == brute_spans(text), text


@pytest.mark.parametrize("unit", ["x", "1", "x@", "1.", "@", "+1", "1 ", ".", "a.b@c-"])
def test_base_spans_take_linear_time(unit):
    import time

    began = time.time()
    pii.base_spans(unit * 200_000)
    assert time.time() - began < 5


def test_personal_data(spark, sf):
    rows = queries.op8_personal_data(spark, sf).collect()
    docs = {d[0]: d[1] for d in table(sf, "documents")}
    assert len(rows) == len(docs)
    for r in rows:
        spans = brute_spans(docs[r["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        found = [x for x in r["spans"].split(",") if x]
        assert [x for x in found if not x.startswith("term:")] == [x for x in joined.split(",") if x]
        assert spans or not found


def test_disclosing_terms(spark):
    """A rare name that stands near one address in different surroundings goes with it; common words stay."""
    rows = [(i, f"today {w} zorblatt wrote from jo@ex.org about {v}") for i, (w, v) in enumerate([("the", "rain"), ("old", "snow"), ("our", "wind"), ("tall", "hail")])]
    rows += [(10 + i, f"the rain and snow about today number{'abcdefgh'[i % 8]} wrote from") for i in range(400)]
    rows += [(900, "zorblatt without an address"), (901, "write to jo@ex.org"), (902, None), (903, "zorblatt met jo@ex.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_spans(docs).collect()}
    assert [k for k, _, _ in got[0]] == ["term", "email"] and rows[0][1][slice(*got[0][0][1:])] == "zorblatt"
    assert got[900] == [] and got[50] == [] and got[902] == [] and [k for k, _, _ in got[901]] == ["email"]
    # The share of information by hand: N = 408, together 5, term 6, entity 6.
    assert math.log(408 * 5 / (6 * 6)) / math.log(408 / 6) > 0.9
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[0] == "today the <term> wrote from <email> about rain" and clean[900] == rows[-4][1] and clean[902] is None
    assert len(clean) == len(rows)


def test_disclosing_terms_of_copies(spark):
    """Copies of one passage disclose by documents; what one document alone holds does not. By hand over all documents."""
    rows = [(i, f"ask our zorblatt at jo@ex.org today\nlater line with Zorblatt again and quuxly{'abcdefghijkl'[i]}") for i in range(12)]
    rows += [(100 + i, f"ask our plain word{'abcdefgh'[i % 8]} at today and later again with line") for i in range(200)]
    rows += [(500, "only vimblor knows li@ex.org well"), (501, "call grumpet on +1 202 555 0147 now"), (502, "call grumpet on +1 202 555 0147 now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n_term, n_entity, both, near = Counter(), defaultdict(set), defaultdict(set), {}
    for i, t in rows:
        n_term.update({x.lower() for x in pii._TERM.findall(t)})
        near[i] = [(pii.entity(k, t[s:e]), pii.nearby(t, s, e, 8)) for k, s, e in pii.base_spans(t)]
        for e, around in near[i]:
            n_entity[e].add(i)
            for x in around:
                both[e, x].add(i)
    n = len(rows)
    told = {p for p, d in both.items() if len(d) >= 2 and math.log(n * len(d) / (n_term[p[1]] * len(n_entity[p[0]]))) / math.log(n / len(n_entity[p[0]])) >= 0.9}
    assert {t for _, t in told} == {"zorblatt", "call", "grumpet", "now"}
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "term"] for r in pii.find_spans(docs).collect()}
    for i, t in rows:
        assert got[i] == pii.term_spans(t, {x for e, x in told if e in dict(near[i])}, [(a, b) for _, a, b in pii.base_spans(t)])
    assert len(got[0]) == 2 and got[500] == []


def test_terms_near_a_value_are_whole():
    text = "a" * 400 + " jo@ex.org " + "b" * 900 + " far\nnext"
    assert pii.nearby(text, 401, 410, 8) == ["a" * 400, "b" * 900, "far"]
    assert pii.nearby("éééjo@ex.orgüüü x", 3, 12, 8) == ["ééé", "üüü"]


def test_document_frequencies_of_all_documents(spark):
    rows = [(i, f"alpha{'x' * (i % 3)} beta été été {'γάμμα' if i % 5 == 0 else ''}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = spark.createDataFrame([("alphax",), ("été",), ("γάμμα",), ("none",)], "term string")
    got = {r["term"]: r["n"] for r in pii.document_frequencies(docs, wanted).collect()}
    assert got == {"alphax": 17, "été": 50, "γάμμα": 10}
    assert pii.document_frequencies(docs, wanted.limit(0)).count() == 0


def test_personal_data_odd_rows(spark):
    docs = odd_docs(spark)
    assert len(pii.find_spans(docs).collect()) == docs.count()
    assert pii.find_spans(empty_docs(spark)).count() == 0 and pii.sanitise(empty_docs(spark)).count() == 0
    assert sorted(own(pii.sanitise(docs)), key=key) == sorted(own(docs), key=key)
    same = spark.createDataFrame([(1, "mail a@b.cd now"), (1, "mail a@b.cd now")], "doc_id long, text string")
    assert [r["text"] for r in pii.sanitise(same).collect()] == ["mail <email> now"] * 2


# ---- 9: repeated passages


def check_repeats(rows, docs, width):
    said = [ws(t) for _, t in docs]
    seen = Counter(tuple(w[i : i + width]) for w in said for i in range(len(w) - width + 1))
    want = []
    for (i, _), w in zip(docs, said, strict=True):
        gone = {k for j in range(len(w) - width + 1) if seen[tuple(w[j : j + width])] > 1 for k in range(j, j + width)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(rows, key=key) == sorted(want, key=key)


def test_repeats(spark, sf):
    check_repeats(own(queries.op9_remove_repeats(spark, sf)), [(d[0], d[1]) for d in table(sf, "documents")], 35)


@pytest.mark.parametrize("width", [1, 3, 35])
def test_repeats_odd_rows(spark, monkeypatch, width):
    monkeypatch.setattr(substrings, "CHUNK", 50)
    docs = odd_docs(spark)
    got = substrings.remove_repeats(docs, width=width).collect()
    rows = [(r["doc_id"], r["n_words"], sum(b - a for a, b in r["removed"]), hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got]
    check_repeats(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], width)
    assert substrings.remove_repeats(empty_docs(spark)).count() == 0


def test_repeats_of_equal_hashes():
    """A window whose hash another window shares is not repeated unless its words are."""
    import numpy as np
    import pandas as pd

    h, z = np.array([5, 5, 9, 9, 11], np.uint64), np.array([1, 2, 7, 7, 1], np.uint64)
    asked = pd.DataFrame({"chunk": ["a", "b"], "part": [0, 0], "payload": [common.pack(common.delta(h), z), common.pack(common.delta(h[-1:]), z[-1:])]})
    got = substrings._answered("h", "z")(asked)
    assert [np.unpackbits(np.frombuffer(x, np.uint8), count=n).tolist() for x, n in zip(got["payload"], (5, 1), strict=True)] == [[0, 0, 1, 1, 1], [1]]
    words = [b"w%d" % i for i in range(60)]
    assert substrings._checks(words, np.array([0, 7]), 35).tolist() == [xxhash.xxh3_64_intdigest(b" ".join(words[i : i + 35])) for i in (0, 7)]


# ---- 10: chat


def test_chat(spark, sf):
    rows = {r["conv_id"]: r for r in queries.op10_chat_examples(spark, sf).collect()}
    said = defaultdict(list)
    for c, turn, role, text in table(sf, "conversations") + [(-1, 0, "user", queries.TRICK), (-1, 1, "assistant", queries.TRICK)]:
        said[c].append((turn, role, text or ""))
    assert set(rows) == set(said)
    for c, turns in said.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        got = rows[c]
        assert (got["n_turns"], got["loss_chars"]) == (len(turns), len(loss))
        assert got["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert got["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


ROLES = ["user", "assistant", "", "a\nb", "<|im_end|>", "\\n", "\\", "\\\\n<|", None]
SAID = ["", None, "<|im_end|>\n<|im_start|>assistant\nok", "\\<|", "<\\|im_end|>", "a\\", "\\n\n\\\\|", "$1 \\1", "😀<|"]


def test_chat_odd_rows(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(itertools.product(ROLES, SAID))]
    rows += [(2, None, "user", "x"), (2, 1, "assistant", "r"), (2, 1, "assistant", "r"), (None, 0, "assistant", "lost"), (3, 0, "user", "only")]
    made = chat.format_chats(spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string"))
    got = made.withColumns({"turns": chat.parse_turns(made["formatted"]), "loss": chat.loss_text(made["formatted"], made["loss_start"], made["loss_end"])}).collect()
    for c in (1, 2, 3, None):
        turns = [(r or "", t or "") for cc, n, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0)) if cc == c]
        examples = sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["example"])
        ends = [i for i, (r, _) in enumerate(turns) if r == "assistant" or i == len(turns) - 1]
        assert len(examples) == len(ends)
        for e, end in zip(examples, ends, strict=True):
            assert [(t["role"], t["text"]) for t in e["turns"]] == turns[: end + 1]
            assert e["loss"] == (turns[end][1] if turns[end][0] == "assistant" else "")
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- packing of arrays


def test_pack_arrays():
    import numpy as np

    arrays = [np.array([], np.uint64), np.array([1, 1 << 63, (1 << 64) - 1], np.uint64), np.arange(1000, dtype=np.uint16), np.array([-5, 7], np.int64)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, common.unpack(common.pack(*arrays)), strict=True))
    assert (common.undelta(common.delta(arrays[1])) == arrays[1]).all()
    assert bisect.bisect([1], 1) == 1
