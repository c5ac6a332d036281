"""Each stage of the pipeline against a brute-force version on what the one before kept."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tickforge.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm import test_operators as brute  # noqa: E402
from tickforge.llm import pii, queries  # noqa: E402


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """The rows before and after each stage, written and read again as the driver does."""
    docs = queries.read(spark, sf, "documents")
    out = {"documents": rows(docs)}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = rows(docs)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    return out


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "pii", "mix", "pack"]


def test_quality_stage(spark, sf, steps):
    kept = {r["doc_id"] for r in rows(queries.op3_quality_rules(spark, sf)) if r["kept"]}
    assert sorted(map(str, steps["quality"])) == sorted(str(r) for r in steps["documents"] if r["doc_id"] in kept)


def test_near_dedup_stage(steps):
    docs = steps["quality"]
    prints = {r["doc_id"]: brute.brute_fingerprint(r["text"]) for r in docs}
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = [r for r in docs if root(r["doc_id"]) == r["doc_id"]]
    assert sorted(map(str, steps["near_dedup"])) == sorted(map(str, want))
    assert len(want) < len(docs)


def test_near_dedup_similarity(steps):
    """The first of each component of texts whose five-word shingles have the similarity 0.8 at least stays."""

    def grams(text):
        w = [x.lower() for x in brute.ws(text)]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    docs = steps["quality"]
    sets = {r["doc_id"]: grams(r["text"]) for r in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = [r for r in docs if root(r["doc_id"]) == r["doc_id"]]
    assert sorted(map(str, steps["near_dedup"])) == sorted(map(str, want))
    assert len(want) < len({r["text"] for r in docs})


def test_pii_stage(steps):
    before, after = ({r["doc_id"]: r for r in steps[n]} for n in ("near_dedup", "pii"))
    assert set(before) == set(after)
    changed = 0
    for i, r in before.items():
        spans = brute.brute_spans(r["text"])
        if not spans:
            assert after[i] == r
            continue
        changed += 1
        assert not brute.brute_spans(after[i]["text"]) or "<" in after[i]["text"]
        for kind, s, e in spans:
            assert f"<{kind}>" in after[i]["text"] or any(a <= s and e <= b for k, a, b in spans if (k, a, b) != (kind, s, e))
        assert {k: v for k, v in after[i].items() if k != "text"} == {k: v for k, v in r.items() if k != "text"}
    assert changed and all(pii.base_spans(r["text"]) == brute.brute_spans(r["text"]) for r in after.values())


def test_mix_stage(steps):
    before, after = steps["pii"], steps["mix"]
    known, times = {str(r) for r in before}, Counter(str(r) for r in after)
    assert set(times) <= known and max(times.values()) <= 2
    size = lambda r: len(brute.ws(r["text"]))
    have, taken = defaultdict(int), defaultdict(int)
    for r in before:
        have[r["source"]] += size(r)
    for r in after:
        taken[r["source"]] += size(r)
    names = sorted(have, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(2 * have[s], level * weight[s]) for s in names) < 1.5 * sum(have.values()):
            low = level
        else:
            high = level
    for s in names:
        goal = min(2 * have[s], low * weight[s])
        least = min((size(r) for r in before if r["source"] == s and size(r)), default=0)
        assert abs(taken[s] - goal) <= max(0.02 * goal, least)


def test_pack_stage(steps):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = [(r["doc_id"], r["text"]) for r in steps["mix"]]
    want, by, _ = brute.check_packing(steps["pack"], docs, t)
    for (doc_id, ids), n in want.items():
        mine = [r for r in by[doc_id]]
        assert sum(r["length"] for r in mine) == n * len(ids)
        assert Counter(r["ids_crc32"] for r in mine if r["piece"] == 0)[zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[: len(ids) % 2048 or min(len(ids), 2048)]))] == n


def test_run_is_the_stages(spark, sf, steps):
    got = Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows(corpus_pipeline.run(spark, sf)))
    assert got == Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in steps["pack"])
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_of_odd_tables(spark, sf):
    """Each stage alone: an empty table, nulls in every column, empty and very long texts, rows alike, ties and clashing columns."""
    long = " ".join(f"word{i % 3000}of{i // 11}" for i in range(40_000)) + " write to a@b.cd"
    rows = [(1, long, "en", "s1", 9), (1, long, "en", "s1", 9), (2, "", "de", None, 0), (3, None, None, "s2", None), (None, "mail jo@ex.org or mail", None, "s2", 1), (None, None, None, None, None), (4, "   ", "en", "s1", 3)]
    extra = ["text_hash", "k1", "spans", "copies", "quality", "column 0"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(c) for c in extra})
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, docs, sf), stage(spark, docs.limit(0), sf)
        assert none.count() == 0
        if name == "pack":
            assert sum(r["piece"] == 0 for r in got.collect()) == len(rows)
            continue
        assert got.columns == docs.columns
        out = got.collect()
        assert all(r[c] == c for r in out for c in extra)
        if name == "near_dedup":
            assert sorted(str(r["doc_id"]) for r in out) == ["1", "2", "None"]
        elif name == "pii":
            assert len(out) == len(rows) and sum("<email>" in (r["text"] or "") for r in out) == 3
        elif name == "mix":
            assert max(Counter(r["doc_id"] for r in out).values(), default=0) <= 4


def test_texts_apart_meet_without_pair_rows(spark, monkeypatch):
    """A group of 60 sets in blocks of 7: the links found join what brute force joins, though no pair is a row."""
    import numpy as np

    from tickforge.llm import neardup

    monkeypatch.setattr(neardup, "TEXTS", 7)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.choice(40 + 40 * (i % 3), 30 + i % 9).astype("<u8") + 1000 * (i % 3)) for i in range(20)]
    sets += [np.unique(np.concatenate([s[k:], s[:1] + 7000 + k])) for s in sets for k in (1, 3)]
    roots = [i % 50 for i in range(60)]
    alike = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))

    def parts(links):
        label = list(range(60))
        for i, j in [*links, *[(i, i - 50) for i in range(50, 60)]]:
            label = [label[i] if v == label[j] else v for v in label]
        return {frozenset(k for k in range(60) if label[k] == v) for v in label}

    left = spark.createDataFrame([(0, 9, i, r) for i, r in enumerate(roots)], "band int, key long, fp long, root long")
    table = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "fp long, found binary")
    out = neardup._apart(left, table, 0.8)
    want = parts([(i, j) for i in range(60) for j in range(i) if alike(sets[i], sets[j])])
    got = [(r["a"], r["b"]) for r in out.collect()]
    assert parts(got) == want and 3 < len(want) < 50 and all(alike(sets[i], sets[j]) for i, j in got)
    assert parts(neardup.joining(sets, roots, 0.8)) == want
