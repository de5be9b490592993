"""Personal data and secrets against plain regular expressions."""

import math
import random
import re
import time

from pyspark.sql import functions as F

from tidemark.llm import pii, secrets
from tidemark.llm import spans as S


def digits(v):
    return re.sub("[^0-9]", "", v)


def luhn(x):
    s = 0
    for i, c in enumerate(reversed(x)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


KEEP = {
    "email": lambda v: True,
    "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
    "card": lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v)),
    "phone": lambda v: 9 <= len(digits(v)) <= 15,
}


def base_of(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in pii.BASE.items() for m in re.finditer(p, text) if KEEP[k](m[0])]


def secrets_of(text):
    keep = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    plain = {k: p.replace("++", "+") for k, p in secrets.BASE.items()}
    found = [(m.start(), j, f"{k}:{m.start()}:{m.end()}") for j, (k, p) in enumerate(plain.items()) for m in re.finditer(p, text) if keep[k](m)]
    return [x[2] for x in sorted(found)]


def test_pii_base(docs, rows):
    rows_ = [r for r in rows if r[0] not in (10, 19, 21)]  # Python's own matcher is quadratic on those
    got = {r.doc_id: r.s for r in pii.all_spans(docs).select("doc_id", S.joined(F.col("base")).alias("s")).collect()}
    for i, t in rows_:
        assert got[i] == ",".join(base_of(t or "")), i
    assert got[14].count("email") == 2 and "ip:" in got[14] and "card:" in got[14] and "phone:" in got[14]
    assert got[10] == got[21] == "" and len(got) == len(rows)


def test_pii_chains(spark):
    texts = ["x@a.b_c@d.e", "1.2.3.4.5.6.7.8", "1.2.3.4.", "0000255.1.1.1", "256.1.1.1.1", "+1 2 3 4 5 6 7 8 9+12345678901", "4111-1111 1111 1111  4111111111111111", "é@é x@é.com a@b.c.", "a@b..c d@e.f-g"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r.s for r in pii.all_spans(d).orderBy("doc_id").select(S.joined(F.col("base")).alias("s")).collect()]
    assert got == [",".join(base_of(t)) for t in texts]


def test_pii_terms(spark):
    rows = [(i, f"filler{i % 7} words here Zebrafish wrote jane@corp.example about it common{i}") for i in range(6)]
    rows += [(100 + i, f"wrote about it filler{i % 7} words here other text number{i}") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    f = pii.all_spans(d).withColumn("text", F.lit("")).drop("text")
    got = {r.doc_id: r for r in f.collect()}
    assert [t.word for t in got[0].terms] == ["Zebrafish"] and not got[100].terms
    j = d.join(f, "doc_id").select("doc_id", pii.sanitise(F.col("text"), F.col("base"), F.col("terms")).alias("s"))
    s = {r.doc_id: r.s for r in j.collect()}
    assert "Zebrafish" not in s[0] and "[email]" in s[0] and s[100] == rows[6][1]


def test_pii_terms_by_hand(spark):
    """Shares by hand from whole documents: far from the address, in documents without it, in copies, ties and repeats."""
    rng = random.Random(3)
    common = [f"word{i}" for i in range(30)]
    rows = []
    for i in range(120):
        w = rng.sample(common, 12)
        if i % 10 == 0:
            w += ["Zeta", f"near{i % 20}"] + rng.sample(common, 15) + [f"p{i % 3}@corp.example", "and 10.0.0.%d" % (i % 4)]
        if i % 17 == 0:
            w += ["Zeta"]
        rows.append((i, " ".join(w)))
    rows += [(500 + i, "copied quxx words " + rows[10][1]) for i in range(3)] + [(None, rows[20][1]), (20, rows[20][1]), (600, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    terms, entities = [], []
    for _, t in rows:
        spans = [tuple(map(int, x.split(":")[1:])) for x in base_of(t or "")]
        entities.append({(x.split(":")[0], (t or "")[int(x.split(":")[1]) : int(x.split(":")[2])]) for x in base_of(t or "")})
        terms.append({m[0].lower() for m in re.finditer(r"[^\W\d_][\w'-]{2,}", t or "") if all(m.end() <= a or m.start() >= z for a, z in spans)})
    n = len(rows)
    docs_of = lambda x, sets: {i for i, s in enumerate(sets) if x in s}
    want = {}
    for t in set().union(*terms):
        for c in set().union(*entities):
            dt, dc = docs_of(t, terms), docs_of(c, entities)
            if len(dt & dc) >= 2 and len(dc) < n:
                share = math.log(n * len(dt & dc) / (len(dt) * len(dc))) / math.log(n / len(dc))
                if share >= 0.8:
                    want[t] = max(want.get(t, 0), share)
    found, words = pii.find(d)
    got = {r.term: r.share for r in pii.disclosures(found, words).collect()}
    assert set(got) == set(want) and all(abs(got[t] - want[t]) < 1e-9 for t in want) and "quxx" in want and len(want) < 60
    for r in pii.all_spans(d).join(found.select("row", "text"), "row").collect():
        spans = [(b.start, b.end) for b in r.base]
        at = [(m.start(), m.end(), m[0], "remove" if want[m[0].lower()] >= 0.95 else "generalise") for m in re.finditer(r"[^\W\d_][\w'-]{2,}", r.text) if m[0].lower() in want and all(m.end() <= a or m.start() >= z for a, z in spans)]
        assert [tuple(t) for t in r.terms] == at


def test_long_texts(spark):
    """Tens of thousands of matches in one text, overlaps and replacements included, in seconds."""
    text = ", ".join(f"10.0.{i % 250}.{i % 99} and AKIA{'Q' * 16}" for i in range(30_000))
    d = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in d.select("doc_id", S.joined(pii.base_spans(F.col("text"))).alias("s"), F.size(secrets.base_spans(F.col("text"))).alias("n")).collect()}
    assert got[1].s == ",".join(base_of(text)) and got[1].n == 30_000
    out = {r.doc_id: r.text for r in secrets.redact(d, [0.0] * 128 * 128).collect()}
    assert out[1] == text.replace("AKIA" + "Q" * 16, "[SECRET]") and out[2] == "x"
    assert time.time() - began < 60


def test_span_sums_and_cuts(spark):
    rng = random.Random(1)
    rows = []
    for n in (0, 1, 31, 32, 33, 300, 5_000):
        x = [rng.randrange(9) for _ in range(n)]
        spans, at = [], 0
        for _ in range(n):
            a = max(0, at + rng.randrange(-2, 4))
            spans.append((a, a + rng.randrange(1, 5), rng.choice(["", "#", "é"])))
            at = spans[-1][1]
        rng.shuffle(spans)
        rows.append((n, x, spans, "".join(rng.choice("abé🙂") for _ in range(at + 20))))
    d = spark.createDataFrame(rows, "n int, x array<int>, spans array<struct<start:int,end:int,put:string>>, text string")
    other = F.filter("spans", lambda s: s["put"] == "#")
    got = {r.n: r for r in d.select("n", S.sums_before(F.col("x")).alias("s"), S.most_before(F.col("x")).alias("m"), S.replaced(F.col("text"), F.col("spans")).alias("t"), S.apart(F.filter("spans", lambda s: s["put"] == ""), other).alias("a")).collect()}
    for n, x, spans, text in rows:
        assert got[n].s == [sum(x[:i]) for i in range(n)] and got[n].m == [max(x[:i], default=0) for i in range(n)]
        out, at = "", 0
        for k, (a, z, put) in enumerate(sorted(spans)):
            if k and a < at:
                at = max(at, z)
                continue
            out, at = out + text[at:a] + put, z
        assert got[n].t == out + text[at:]
        hash_ = [s for s in spans if s[2] == "#"]
        assert [tuple(s) for s in got[n].a] == [s for s in spans if s[2] == "" and not any(s[0] < o[1] and o[0] < s[1] for o in hash_)]


def test_pii_odd_and_empty(odd, none):
    assert pii.all_spans(odd).count() == odd.count() and pii.all_spans(none).count() == 0


def test_secrets(docs, rows):
    model = secrets.train(secrets.samples(docs))
    got = {r.doc_id: (r.b, r.markov) for r in secrets.scan(docs, model).select("doc_id", S.joined(F.col("base")).alias("b"), "markov").collect()}
    for i, t in rows:
        assert got[i][0] == ",".join(secrets_of(t or "")), i
    assert [m.value for m in got[13][1]] == ["q9Xv+7Zt/2Lk8Rm4Wp1Ys6Hd3Jf5"]
    assert not any(m for i, (_, m) in got.items() if i != 13)


def test_secret_words_in_either_case(spark):
    texts = ["PassWord: 'abcdef'", "secret_token=abcdefg", "TOKEN = \"a.b-c=\" x", "passwd:abc apikey=123456", "tokensecret = token = zzzzzz", "AKIAAKIA" + "A" * 20, "f" * 23 + "g" + "f" * 24, "deadbeef" * 4 + "Z"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r.s for r in d.select("doc_id", S.joined(secrets.base_spans(F.col("text"))).alias("s")).orderBy("doc_id").collect()]
    assert got == [",".join(secrets_of(t)) for t in texts]


def test_redact_keeps_columns(docs, none):
    model = secrets.train(secrets.samples(docs))
    out = secrets.redact(docs, model)
    assert out.columns == docs.columns and secrets.redact(none, model).count() == 0
    got = {r.doc_id: r for r in out.collect()}
    assert "AKIA" not in got[13].text and got[13].text.count("[SECRET]") == 4 and got[13].base == "b"
    assert got[0].text == {r.doc_id: r for r in docs.collect()}[0].text


def test_uniform_model(spark):
    m = secrets.train(spark.createDataFrame([], "value string, random boolean"))
    assert len(m) == 128 * 128 and not any(m)
