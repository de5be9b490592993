"""Near-duplicates, phrases, fingerprints, repeats, toxicity and the pipeline against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, omh, phrases, repair, setsketch, suffixes, toxicity

from .conftest import LOW, frame


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def linked(sets, percent=85):
    ids = sorted(sets)
    root = {i: i for i in ids}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids}


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (11, 12), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in common.components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 12: 10, 7: 7}
    assert common.components(e.limit(0)).count() == 0


def test_near_duplicates(spark, rows):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(5000)]
    base = list(rng.choice(words, 150))
    more = []
    for i in range(60):  # a group of near copies at all distances
        w = list(base)
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(150))] = f"new{rng.integers(10**6)}"
        more.append((1000 + i, " ".join(w)))
    every = rows + more
    want = linked({i: shingle_set(t) for i, t in every})
    for block in (setsketch.BLOCK, 4_000):  # in one block, and over pairs of blocks, with components of several
        got = {r.doc_id: r for r in setsketch.near_duplicates(frame(spark, every), block=block).collect()}
        for i, t in every:
            assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(shingle_set(t)), want[i], want[i] == i), i


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    for j in (0.5, 0.85, 0.95):
        n = 2000
        both = int(round(2 * n * j / (1 + j)))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[:both], rng.integers(0, 1 << 63, n - both, dtype=np.uint64)])
        st = np.array([0, n, 2 * n])
        r = setsketch.registers(np.concatenate([np.sort(a), np.sort(b)]), st, 1024)
        got = setsketch.likely_jaccard(np.array([(r[0] > r[1]).sum()]), np.array([(r[0] < r[1]).sum()]), 1024, np.array([float(n)]), np.array([float(n)]))[0]
        assert got == pytest.approx(j, abs=0.05)
        merged = setsketch.registers(np.sort(np.concatenate([a, b])), np.array([0, 2 * n]), 1024)
        assert (merged[0] == np.maximum(r[0], r[1])).all()


def test_near_duplicates_odd_and_empty(odd, none):
    got = setsketch.near_duplicates(odd).collect()
    assert sorted((r.doc_id for r in got if r.doc_id is not None)) == [0, 1, 2, 3, 4, 5]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert setsketch.near_duplicates(none).count() == 0
    kept = setsketch.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 3, 4, 5]


def windows_of(items, size):
    found = collections.defaultdict(set)
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        for k in range(len(w) - min(size, len(w)) + 1) if w else ():
            found[tuple(w[k : k + min(size, len(w))])].add(str(i))
    return found


@pytest.mark.parametrize("block_words", [phrases.BLOCK_WORDS, 60])
def test_phrases(spark, docs, rows, block_words):
    texts = dict(rows)
    items = [(1, " ".join(texts[4].split()[100:130])), (2, "one"), (3, None), (4, "ab ab ab ab"), (5, "not there at all in any text of this table, ever"), (1, " ".join(texts[18].split()[5000:5012])), (12, "...")]
    b = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    got = {r.doc_id: r for r in phrases.contamination(docs, b, block_words=block_words).collect()}
    wins = windows_of(items, 10)
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        assert (got[i].n_words, got[i].n_hit, got[i].item_ids) == (len(w), len(hit), sorted(found)), i
    clean = phrases.clean(docs, b)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if not r.n_hit}


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a b x c d"), (2, "a b c d"), (3, "d c b a q q q q")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    hits = lambda slop: sorted(r.doc_id for r in phrases.contamination(d, b, slop=slop).where("n_hit > 0").collect())
    assert hits(0) == [2] and hits(1) == [1, 2] and hits(6) == [1, 2, 3]


def test_phrases_odd_and_empty(spark, odd, none):
    b = spark.createDataFrame([(1, "another text of number four")], "item_id long, text string")
    assert phrases.contamination(none, b).count() == 0
    assert phrases.contamination(odd, b.limit(0)).where("n_hit > 0").count() == 0
    assert phrases.contamination(odd, b).where("doc_id is null").count() == 2


@pytest.mark.parametrize("block_words", [phrases.BLOCK_WORDS, 4])
def test_phrases_search_every_row(spark, block_words):
    """Rows without a doc_id and rows that share one: each comes back once with all its hits, and none passes clean()."""
    b = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "one two")], "item_id long, text string")
    d = frame(spark, [(None, "x alpha beta gamma delta y"), (None, "x y"), (None, None), (7, "alpha beta z"), (7, "zz top"), (8, "q"), (8, "q"), (None, "x y")])
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.item_ids) for r in phrases.contamination(d, b, block_words=block_words, window=2).collect())
    assert got == sorted([("None", 6, 4, ["1", "2"]), ("None", 2, 0, []), ("None", 2, 0, []), ("None", 0, 0, []), ("7", 3, 2, ["1"]), ("7", 2, 0, []), ("8", 1, 0, []), ("8", 1, 0, [])])
    kept = sorted((str(r.doc_id), str(r.text)) for r in phrases.clean(d, b, window=2).collect())
    assert kept == sorted([("None", "x y"), ("None", "x y"), ("None", "None"), ("7", "zz top"), ("8", "q"), ("8", "q")])


def test_order_minhash(spark, docs, rows):
    got = {r.doc_id: r for r in omh.compare(docs, parts=5).collect()}
    order = sorted(rows)
    same = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edit = t[: len(t) - half] + nxt[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest()), i
        assert same.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[0].near_next == 1 and got[18].near_edited > 0.1 > got[18].near_next


def sketch_by_hand(text, hash_of):
    """Tuples of one text, from occurrence-numbered k-mers; hash_of stands for Spark's hash."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, low = collections.Counter(), {}
    for pos in range(len(w)):
        k = tuple(w[pos : pos + omh.K]) + (None,) * (omh.K - len(w[pos : pos + omh.K]))
        seen[k] += 1
        h = hash_of[k, seen[k]]
        s, v = h % (omh.TUPLES * omh.LENGTH), ((h & ((1 << 64) - 1)) >> 26 << 26) | pos
        v = v - (1 << 64) if v >> 63 else v
        low[s] = min(low.get(s, v), v)
    return low


def test_order_minhash_by_hand(spark):
    text = "a b a b a b c a b " * 5 + "d e f"
    w = text.split()
    kmers = sorted({(a, b) for a, b in zip(w, [*w[1:], None])}, key=str)
    h = spark.createDataFrame([(a, b, n) for a, b in kmers for n in range(1, len(w) + 1)], "a string, b string, n int").select("a", "b", "n", F.xxhash64(F.xxhash64("a", "b"), F.col("n")).alias("h")).collect()
    low = sketch_by_hand(text, {((r.a, r.b), r.n): r.h for r in h})
    d = spark.createDataFrame([(0, text)], "id long, t string")
    got = omh.sketches(d, ["id"], "t").first().fingerprint
    assert {s // omh.LENGTH for s in low} == {k for k, v in enumerate(got) if v != 0}
    swapped = spark.createDataFrame([(0, "d e f " + "a b a b a b c a b " * 5)], "id long, t string")
    assert omh.sketches(swapped, ["id"], "t").first().fingerprint != got


def test_order_minhash_odd_and_empty(odd, none, spark):
    assert omh.compare(odd, parts=3).count() == odd.count() and omh.compare(none).count() == 0
    one = omh.compare(frame(spark, [(1, "alone here")])).first()
    assert one.near_next == 1.0


def repeats(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        flag = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                flag[i : i + length] = True
        out.append(flag)
    return out


@pytest.mark.parametrize("group", [4096, 1])
def test_repeats(spark, docs, rows, group):
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs, length=60, gram=16, group=group, with_text=True).collect()}
    raw = [(t or "").encode() for _, t in rows]
    for (i, _), b, flag in zip(rows, raw, repeats(raw, 60)):
        kept = np.frombuffer(b, np.uint8)[~flag].tobytes()
        edge = np.diff(np.concatenate([[0], flag.astype(int), [0]]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(b), int(flag.sum()), int((edge == 1).sum()), kept), i
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_repeats_in_short_periodic_runs(spark):
    """Repeats inside one otherwise unique document, by runs of all periods that one chunk's grams can hide."""
    rng = np.random.default_rng(3)
    unique = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    runs = [unique(100) * 5 for _ in range(40)] + [(unique(d) * 30)[: 400 + d + more] for _ in range(8) for d in (50, 150, 272) for more in (1, d // 2, d - 1)] + [unique(900)]
    rows = [(i, unique(700) + r + unique(700)) for i, r in enumerate(runs)]
    want = repeats([t.encode() for _, t in rows], 400)
    assert sum(bool(f.any()) for f in want) == len(rows) - 1
    got = {r.doc_id: r for r in suffixes.remove_repeats(frame(spark, rows)).collect()}
    assert [got[i].n_removed for i, _ in rows] == [int(f.sum()) for f in want]


@pytest.mark.parametrize("alphabet", [2, 3, 26])
def test_two_stage_order(alphabet):
    rng = np.random.default_rng(alphabet)
    parts = [rng.integers(97, 97 + alphabet, int(n), dtype=np.uint8).tobytes() for n in rng.integers(40, 300, 12)] + [b"z" * 120, b"a" * 120, b"ab" * 70]
    starts = [len(p) - 39 for p in parts]
    text, wanted, begin = suffixes.lay(parts, starts, 40)
    order = suffixes.two_stage(text, wanted, 40)
    assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
    whole = [(text[i : i + 40].tobytes()) for i in order.tolist() if any(b <= i < b + s for b, s in zip(begin, starts))]
    assert whole == sorted(whole)


def test_repeats_odd_and_empty(odd, none):
    got = suffixes.remove_repeats(odd, length=60, gram=16).collect()
    assert len(got) == 8 and sum(r.doc_id is None for r in got) == 2
    assert suffixes.remove_repeats(none).count() == 0


def toxic_corpus(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 6))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = list(rng.choice(words, 40))
        bad = i % 6 == 0
        if bad:
            for k in range(3):
                w[int(rng.integers(40))] = "zqx" + "".join(rng.choice(list("uvw"), 3))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad), "x"))
    return frame(spark, rows), spark.createDataFrame([*labels, (None, 1, 1, "x"), (3, 1, None, "x")], "doc_id long, quality int, toxic int, text string")


def test_toxicity_held_out(spark):
    docs, labels = toxic_corpus(spark)
    s = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    out = [r for r in s if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(s) == 900 and all(r.predicted == (r.doc_id % 6 == 0) for r in out)
    kept = toxicity.ordinary(docs, toxicity.train(docs, labels))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in s if not r.predicted}


def test_toxicity_continuation_counts(spark):
    """Orders four and three by hand: how many different grams of order six or four end with each gram."""
    docs, labels = toxic_corpus(spark)
    model, _ = toxicity.train(docs, labels)
    text = {r.doc_id: b"".join(b"\1" + w.encode() + b"\1" for w in sorted(set(r.text.split()))) for r in docs.collect()}
    bad = {r.doc_id: r.toxic for r in labels.where("doc_id is not null and toxic is not null").collect()}
    seen = {i for i in text if zlib.crc32(str(i).encode()) % 4 in (0, 1)}

    def counts(ids, order, lower):
        freq, left = collections.Counter(), collections.defaultdict(set)
        for i in ids:
            for w in re.findall(b"\1[^\1]+\1", text[i]):
                for at in range(1, len(w)):
                    low = w[max(0, at - lower + 1) : at + 1]
                    freq[low] += 1
                    left[low].add(w[max(0, at - order + 1) : at + 1])
        return {g: freq[g] if g[:1] == b"\1" else len(left[g]) for g in freq}

    def check(level, k, want):
        total = collections.Counter()
        for g, n in want.items():
            total[g[:-1]] += n
        d = toxicity._discount(sum(n == 1 for n in want.values()), sum(n == 2 for n in want.values()))
        kinds = collections.Counter(g[:-1] for g in want)
        as_number = lambda g: np.uint64(int.from_bytes(g, "little"))
        assert len(level.gram) >= len(want)
        for g, n in want.items():
            assert level.part[k][np.searchsorted(level.gram, as_number(g))] == pytest.approx(max(n - d, 0) / total[g[:-1]], abs=1e-6), g
        for c, n in kinds.items():
            assert level.lam[k][np.searchsorted(level.ctx, as_number(c))] == pytest.approx(d * n / total[c], abs=1e-6), c

    check(model.shared, 0, counts(text, 4, 3))
    for k in (0, 1):
        own = [i for i in seen if bad[i] == k]
        check(model.levels[1], k, counts(own, 6, 4))
        freq = collections.Counter(w[max(0, at - 5) : at + 1] for i in own for w in re.findall(b"\1[^\1]+\1", text[i]) for at in range(1, len(w)))
        check(model.levels[0], k, freq)
    # beyond ``kept`` grams only the frequent ones are sent, and each context still sums to one
    few, _ = toxicity.train(docs, labels, kept=300)
    level = few.levels[0]
    assert len(level.gram) <= 600 and len(level.gram) < len(model.levels[0].gram)
    for k in (0, 1):
        mass = collections.Counter()
        for g, p in zip(level.gram.tolist(), level.part[k][:-1].tolist()):
            size = (g.bit_length() + 7) // 8
            mass[g & ((1 << (8 * (size - 1))) - 1)] += p
        for c, p in mass.items():
            assert level.lam[k][np.searchsorted(level.ctx, np.uint64(c))] == pytest.approx(1 - p, abs=1e-5)


def test_toxicity_scores_need_no_cut(spark):
    """How many grams are broadcast changes no score, and ``ordinary`` drops what ``score`` predicts."""
    docs, labels = toxic_corpus(spark)
    docs = docs.unionByName(frame(spark, [(5000, "zqxuvw twice zqxuvw unseenword 12345678 ąžuolas"), (None, None)]))
    trained = toxicity.train(docs.limit(900), labels)
    whole = {r.doc_id: r.score for r in toxicity.score(docs, trained).collect()}
    for kept in (300, 1):
        few = toxicity.train(docs.limit(900), labels, kept=kept)
        got = {r.doc_id: r.score for r in toxicity.score(docs, few).collect()}
        assert got == pytest.approx(whole, abs=1e-9)
    left = {r.doc_id for r in toxicity.ordinary(docs, few).collect()}
    assert left == {i for i, s in whole.items() if s < 0.3}


def test_toxicity_ignores_held_out_labels(spark):
    docs, labels = toxic_corpus(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    run = lambda l: {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, l)).collect()}  # noqa: E731, E741
    a, b = run(labels), run(flipped)
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_toxicity_odd_and_empty(spark, odd, none):
    docs, labels = toxic_corpus(spark)
    trained = toxicity.train(docs, labels)
    assert toxicity.score(odd, trained).count() == odd.count() and toxicity.score(none, trained).count() == 0
    assert {r.score for r in toxicity.score(odd, toxicity.train(odd, labels.limit(0))).collect()} == {0.0}


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = common.stored(stage(spark, before, small), name, scratch=False)
        if k < 4:
            assert after.columns == docs.columns and after.count() <= before.count()
        if name == "near_duplicates":
            own = {r.doc_id: shingle_set(r.text) for r in before.collect()}
            want = linked(own, 80)
            assert {r.doc_id for r in after.collect()} == {i for i, c in want.items() if i == c}
        if name == "decontamination":
            wins = windows_of([(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()], 10)
            clean = lambda t: not any(tuple(w[i : i + 10]) in wins for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))] for i in range(len(w)))
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if clean(r.text)}
        if name == "secrets":
            assert all("[SECRET]" in r.text or r.text == (texts[r.doc_id] or "") for r in after.collect())
        if name == "encoding":
            kept = {r.doc_id: r.text for r in before.collect()}
            assert {r.doc_id: r.decoded_sha256 for r in after.collect()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in kept.items()}
        before = after


def twins():
    """Two words of 2,048 letters that a polynomial hash modulo 2^64 cannot tell apart, whatever its base."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_toxicity_stage_needs_no_cut(spark, tmp_path, monkeypatch):
    """The pipeline's stage drops the same rows however few grams are broadcast."""
    import functools

    import corpus_pipeline

    docs, labels = toxic_corpus(spark)
    labels.coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    train = toxicity.train
    left = []
    for kept in (1 << 21, 1):
        monkeypatch.setattr(toxicity, "train", functools.partial(train, kept=kept))
        left.append({tuple(r) for r in corpus_pipeline.toxicity_stage(spark, docs, str(tmp_path)).collect()})
    assert left[0] == left[1] and 0 < len(left[0]) < 900


def test_twin_words(spark):
    from tokenizers import Tokenizer

    x, y = twins()
    docs = frame(spark, [(1, x), (2, y), (3, f"{x} {y}"), (4, f"{y} one two three four five")])
    got = {r.doc_id: r for r in setsketch.near_duplicates(docs).collect()}
    assert [got[i].component_id for i in (1, 2, 3, 4)] == [1, 2, 3, 4]
    items = spark.createDataFrame([(1, x)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in phrases.contamination(docs, items).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}
    out = {r.doc_id: r.n_removed for r in suffixes.remove_repeats(frame(spark, [(1, x), (2, y)])).collect()}
    assert out == {i: int(f.sum()) for i, f in zip((1, 2), repeats([x.encode(), y.encode()], 400))}
    h = common.digests(np.frombuffer(f"{x}{y}{x}".encode(), np.uint8), np.array([0, 2048, 4096]), np.array([2048, 4096, 6144]), both=True)
    assert h[0][0] == h[0][2] != h[0][1] and h[1][0] == h[1][2] != h[1][1]
    row, index, text, begin = toxicity.spellings(np.frombuffer(f"{x} {y}".encode(), np.uint8), np.array([0, 4097]))
    assert len(set(index.tolist())) == 2
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = {r.doc_id: r.ids_crc32 for r in repair.read_shards(repair.write_shards(docs, path)).collect()}
    tok = Tokenizer.from_file(path)
    assert ids[3] == zlib.crc32(np.array([*tok.encode(f"{x} {y}", add_special_tokens=False).ids, 1], "<u4").tobytes())


CLASH = "doc_id long, text string, lang string, source string, n_chars long, `__base` string, `__markov` string, `__rank` string, `__gone` string, `__hit` string, base string, gone string, rank string, hit string, markov string"


def test_clashing_columns_and_odd_rows(spark):
    """The filtering stages on every name they might add, null ids and texts, repeats and an empty table."""
    from tidemark.llm import secrets

    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "key one two"), (None, None), (3, "password = hunter2hunter2 x"), (4, "alpha beta gamma")]
    d = spark.createDataFrame([(i, t, "en", "s", 1, *["z"] * 10) for i, t in rows], CLASH)
    items = spark.createDataFrame([(1, "beta gamma")], "item_id long, text string")
    model = [0.0] * 128 * 128
    for f in (lambda x: setsketch.one_of_each(x, 80), lambda x: phrases.clean(x, items), lambda x: secrets.redact(x, model), lambda x: toxicity.ordinary(x, 0.0)):
        assert f(d).columns == d.columns and f(d.limit(0)).count() == 0
        assert all(r["__base"] == r["hit"] == r["__rank"] == "z" for r in f(d).collect())
    assert sorted(str(r.doc_id) for r in setsketch.one_of_each(d, 80).collect()) == ["1", "3", "4", "None", "None"]
    assert sorted(str(r.doc_id) for r in phrases.clean(d, items).collect()) == ["1", "1", "2", "3", "None", "None"]
    assert [r.text for r in secrets.redact(d, model).collect() if r.doc_id == 3] == ["[SECRET] x"]


def test_different_texts_of_one_doc_id_stay(spark):
    """The near-duplicate stage drops a row only for a copy: texts that share a doc_id are compared like any others."""
    import corpus_pipeline

    words = [f"w{k}" for k in range(60)]
    a, b, c = " ".join(words[:20]), " ".join(words[20:40]), " ".join(words[40:])
    for rows, want in (
        ([(1, a), (1, b), (1, c), (2, "x y z")], {(1, a), (1, b), (1, c), (2, "x y z")}),
        ([(1, a), (1, b), (1, b), (2, a), (None, a)], {(1, b), (2, a), (None, a)}),  # the copy under another text's doc_id goes
        ([(1, a), (1, a + " w0"), (2, b), (2, None), (3, "")], {(1, a + " w0"), (2, b), (2, None), (3, "")}),
    ):
        d = frame(spark, rows).repartition(3)
        got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, d, "").collect()]
        assert len(got) == len(want) and set(got) == want
