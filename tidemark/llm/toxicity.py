"""Toxicity by class-conditional Kneser-Ney models of the spelling of words.

Two interpolated models, one of toxic and one of ordinary texts, give the probability of each byte of a word after its
last five bytes, discounted absolutely at orders six and four, and back off to one shared model of order three whose
counts are gathered from all documents, labelled or not. Below order six a gram counts by how many different grams of
the order above end with it (of order four for the shared model), not by its frequency; only grams that begin with
their word, which nothing extends to the left, keep their frequency. Whatever either class has seldom seen thus gets nearly the
same probability from both; families of rare spellings still tell. A word counts once per document. A text is
compared by length-normalised log-likelihood ratios: of the whole text (per byte) and of its most toxic words (the means
of the first ones, TOP), by how many words reach each ratio of OUT, and by its length, as a long text holds a few such
words by chance; a logistic curve over these gives the score.

A gram is its own bytes, packed into one number, so none is mistaken for another. The class models are counted on all
labelled documents outside the held-out fold and the curve's fold, the shared one on all documents; counts and
continuations are distributed aggregations, and no gram is left out. The ratio of a byte is a function of the six bytes
that end with it, so it is found once for each different gram, by joins with the counts. What is broadcast is bounded:
the ratios of the most frequent grams, ``kept`` at most. A word with a gram that is not among them is open: it is written
with its document, the ratios of its other grams come from the same joins, and the document's evidence is completed
before it is scored; so ``kept`` decides how a word is scored, not what it gets. Only the curve, of a dozen numbers, is fitted on a
bounded sample: at most ``sample`` labelled documents of its own fold (those with the smallest hashes of their doc_id).
Words are runs of ASCII letters, digits, apostrophes and anything beyond ASCII, A-Z lower-cased.

Null and empty texts have no evidence: all their ratios are 0. Rows that repeat are scored each. Labels that are null
or without a doc_id are not used; of several labels of a document the largest counts. Without labels of both classes
every score is the share of toxic labels (0 if there are none). Extra columns are not read; an empty table gives an
empty table.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ship, slices, stored, texts, words
from .repair import expand

#: Documents that the curve is fitted on, and grams whose ratios are broadcast, at most.
SAMPLE, KEPT = 4_000, 1 << 21
ORDERS, SHARED_ORDER = (6, 4), 3
#: How many of the most toxic words are averaged, and the log-likelihood ratios from which on words are counted.
TOP, OUT = (1, 2, 3, 5), (1.0, 2.0, 3.0, 4.0, 6.0)
#: Different words whose ratios a worker keeps.
CACHE_WORDS = 400_000
_IN = np.zeros(256, bool)
_IN[48:58] = _IN[97:123] = _IN[128:] = True
_IN[39] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)], np.uint64)


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 4."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def spelled(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, begin): the given byte ranges one after the other, with a mark before and after each."""
    size = end - start + 2
    begin = np.cumsum(size) - size
    text = np.full(int(size.sum()), 1, np.uint8)
    inner = expand(size - 2)
    text[np.repeat(begin + 1, size - 2) + inner] = low[np.repeat(start, size - 2) + inner]
    return text, begin


def spellings(data: np.ndarray, offsets: np.ndarray):
    """(row, word) of every word, and the different words as (text, begin)."""
    row, h, start, end = words(data, offsets, LOWER, _IN, spans=True)
    _, where, index = np.unique(h, return_index=True, return_inverse=True)
    return row, index, *spelled(LOWER[data], start[where], end[where])


def grams(text: np.ndarray, begin: np.ndarray, order: int):
    """(word, context, gram): one entry for each byte but the first mark of each word; grams stop at word begins.

    A gram is the number that its bytes make, the first the lowest; its context lacks the last, which is the highest.
    """
    owner = np.zeros(len(text), np.int64)
    owner[begin[1:]] = 1
    owner = np.cumsum(owner)
    at = np.ones(len(text), bool)
    at[begin] = False
    at = np.flatnonzero(at)
    owner = owner[at]
    first = np.maximum(begin[owner], at - (order - 1))
    held = np.concatenate([text, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(text) + 1,), "<u8", buffer=held.data, strides=(1,))
    gram = lanes[first] & _MASK[at + 1 - first]
    return owner, gram & _MASK[at - first], gram


def _weights(row: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """In how many texts each different word occurs."""
    return np.bincount(np.unique(row.astype(np.int64) << 32 | index) & 0xFFFFFFFF, minlength=n)


def _sums(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, i = np.unique(x, return_inverse=True)
    return u, np.bincount(i, w, minlength=len(u))


def count(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of the texts, ascending, and in how many texts their words are, added up."""
    row, index, text, begin = spellings(data, offsets)
    owner, _, gram = grams(text, begin, order)
    return _sums(gram, _weights(row, index, len(begin))[owner])


def _discount(n1: float, n2: float) -> float:
    return min(0.95, max(0.3, n1 / (n1 + 2 * n2))) if n1 else 0.5


class Level:
    """One order of both classes' models, as arrays by gram and by context, to look at; see ``Model``."""

    def __init__(self, by_class: list[dict[str, np.ndarray]]):
        """Of each class: gram, ctx and n of the kept grams; ctxs, total and mass (of the kept grams, discounted) of
        their contexts; the discount d."""
        self.gram = np.unique(np.concatenate([c["gram"] for c in by_class]))
        self.ctx = np.unique(np.concatenate([c["ctxs"] for c in by_class]))
        self.part = np.zeros((len(by_class), len(self.gram) + 1), np.float32)
        self.lam = np.ones((len(by_class), len(self.ctx) + 1), np.float32)
        for k, c in enumerate(by_class):
            total = c["total"].astype(float)
            order = np.argsort(c["ctxs"])
            of = order[np.searchsorted(c["ctxs"], c["ctx"], sorter=order)]
            self.part[k, np.searchsorted(self.gram, c["gram"])] = np.maximum(c["n"] - c["d"], 0) / total[of]
            self.lam[k, np.searchsorted(self.ctx, c["ctxs"])] = 1 - c["mass"] / total


class Ratios:
    """Ratios of grams, the part of a model that is broadcast; those of words while they stay in a bounded cache."""

    def __init__(self, gram: np.ndarray, ratio: np.ndarray):
        order = np.argsort(gram)
        self.gram, self.ratio = gram[order], ratio[order]
        self.forget()

    def forget(self) -> None:
        self.known, self.known_ratio = np.empty(0, np.uint64), np.empty(0)

    def word_ratios(self, low: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of different words, by ascending hashes h; nan where a word is open."""
        if len(self.known) + len(h) > CACHE_WORDS:
            self.forget()
        new = np.ones(len(h), bool)
        if len(self.known):
            new = ~_find(self.known, h)[1]
        if new.any():
            at = np.searchsorted(self.known, h[new])
            owner, _, r = self.by_gram(low, start[new], end[new])
            got = np.bincount(owner, r, minlength=int(new.sum()))
            self.known, self.known_ratio = np.insert(self.known, at, h[new]), np.insert(self.known_ratio, at, got)
        return self.known_ratio[np.searchsorted(self.known, h)]

    def by_gram(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, gram, ratio) of all grams of the words, nan for the ratios that are not here."""
        owner, _, gram = grams(*spelled(low, start, end), ORDERS[0])
        if not len(self.gram):
            return owner, gram, np.full(len(gram), np.nan)
        at, have = _find(self.gram, gram)
        return owner, gram, np.where(have, self.ratio[at], np.nan)


def _find(known: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return i, known[i] == x


#: Evidence of a text: sum of its ratios, bytes with marks, most toxic words, words above each ratio of OUT, words.
_BEST = slice(2, 2 + max(TOP))
_ABOVE = slice(_BEST.stop, _BEST.stop + len(OUT))


def evidence(ratios: Ratios, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
    """One row per text, of its words that are not open; and of each text its open words: the sum of the ratios that are
    here, the number of times, the grams whose ratios are not."""
    n = len(offsets) - 1
    out = np.zeros((n, _ABOVE.stop + 1))
    late: list[list[dict]] = [[] for _ in range(n)]
    row, h, start, end = words(data, offsets, LOWER, _IN, spans=True)
    if not len(row):
        return out, late
    low = LOWER[data]
    u, where, index = np.unique(h, return_index=True, return_inverse=True)
    by_word = ratios.word_ratios(low, u, start[where], end[where])
    out[:, 1] = np.bincount(row, end - start + 2, minlength=n)
    out[:, -1] = np.bincount(row, minlength=n)
    open_ = np.isnan(by_word)
    if open_.any():
        which = np.flatnonzero(open_)
        owner, gram, r = ratios.by_gram(low, start[where[which]], end[where[which]])
        here = ~np.isnan(r)
        base = np.bincount(owner[here], r[here], minlength=len(which))
        cuts = np.searchsorted(owner[~here], np.arange(len(which) + 1))
        rest = gram[~here].view(np.int64)
        at = np.flatnonzero(open_[index])
        pair, times = np.unique(row[at] * len(u) + index[at], return_counts=True)
        place = np.searchsorted(which, pair % len(u))
        for i, k, c in zip((pair // len(u)).tolist(), place.tolist(), times.tolist()):
            late[i].append({"base": base[k], "n": c, "grams": rest[cuts[k] : cuts[k + 1]]})
        row, index = row[~open_[index]], index[~open_[index]]
    add(out, row, by_word[index])
    return out, late


def add(out: np.ndarray, row: np.ndarray, r: np.ndarray, times: np.ndarray | None = None) -> None:
    """Add the ratios of words to the evidence of their texts."""
    n = len(out)
    times = np.ones(len(r), np.int64) if times is None else times
    out[:, 0] += np.bincount(row, r * times, minlength=n)
    for k, least in enumerate(OUT):
        out[:, _ABOVE.start + k] += np.bincount(row[r > least], times[r > least], minlength=n)
    high = np.flatnonzero(r > 0)
    most = max(TOP)
    high = np.repeat(high, np.minimum(times[high], most))
    rows = np.concatenate([row[high], np.repeat(np.arange(n), most)])
    r = np.concatenate([r[high], out[:, _BEST].ravel()])
    order = np.lexsort((-r, rows))
    place = np.arange(len(rows)) - np.searchsorted(rows[order], rows[order])
    out[:, _BEST] = r[order[place < most]].reshape(n, most)


def features(e: np.ndarray) -> np.ndarray:
    """Of evidence: ratio per byte; means of the TOP most toxic words; log of 1 + the number of words above each ratio of
    OUT; log of 1 + the number of words."""
    best = np.cumsum(e[:, _BEST], axis=1)
    return np.column_stack([e[:, 0] / np.maximum(e[:, 1], 1), *(best[:, t - 1] / t for t in TOP), np.log1p(e[:, _ABOVE]), np.log1p(e[:, -1])])


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights) of a logistic curve, by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    pen = np.full(len(w), ridge * len(x) ** 0.5)
    pen[0] = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = z.T @ (z * (p * (1 - p))[:, None]) + np.diag(pen + 1e-6)
        w += np.clip(np.linalg.solve(hess, z.T @ (y - p) - pen * w), -2, 2)
    return mean, scale, w


def apply_curve(curve, x: np.ndarray) -> np.ndarray:
    mean, scale, w = curve
    return 1 / (1 + np.exp(-np.clip(w[0] + ((x - mean) / scale) @ w[1:], -30, 30)))


# ---------------------------------------------------------------- Spark


def _pick(labels: DataFrame, most: int, *classes: int) -> DataFrame:
    return labels.where(F.col("toxic").isin(*classes)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _sampled(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """Texts of a bounded number of documents, by a broadcast of their ids."""
    p = picked.select(F.col("doc_id").alias("id"), "toxic")
    return docs.join(F.broadcast(p), docs["doc_id"] == p["id"]).select("toxic", "text")


def _counter(order: int):
    """Counts grams of the texts (cls, text) of a partition, adding up as it goes; a row per class and gram at the end of
    each 64 MB."""

    def run(batches):
        import pyarrow as pa

        def out():
            for cls, parts in held.items():
                u, n = _add(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), cls, np.int32)), pa.array(u.view(np.int64)), pa.array(n)], names=["cls", "gram", "n"])

        held, size = {}, 0
        for b in batches:
            of = b.column(0).to_numpy(zero_copy_only=False)
            for cls in np.unique(of).tolist():
                own = held.setdefault(cls, [])
                for _, _, data, off in slices(b.column(1).filter(pa.array(of == cls))):
                    own.append(count(data, off, order))
                    if len(own) > 8:
                        own[:] = [_add(own)]
                    size += len(data)
            if size > 64 << 20:
                yield from out()
                held, size = {}, 0
        yield from out()

    return run


def _add(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    u, n = _sums(np.concatenate([c[0] for c in counts]), np.concatenate([c[1] for c in counts]))
    return u, n.astype(np.int64)


def _merged(texts_: DataFrame, order: int) -> DataFrame:
    """One row per class and gram of all texts (cls, text)."""
    return texts_.select("cls", "text").mapInArrow(_counter(order), "cls int, gram long, n long").groupBy("cls", "gram").agg(F.sum("n").alias("n"))


def _by_size(gram: Column, sizes: range, f) -> Column:
    """f(size) for the number of bytes of a gram, which is the last of ``sizes`` if none before it is enough."""
    out = f(sizes[-1])
    for k in reversed(sizes[:-1]):
        out = F.when(gram < F.lit(1 << (8 * k)), f(k)).otherwise(out)
    return out


def _low(g: Column, order: int, lower: int) -> Column:
    """The gram of order ``lower`` that ends a gram of ``order``."""
    return F.when(g < F.lit(1 << (8 * lower)), g).otherwise(_by_size(g, range(lower + 1, order + 1), lambda k: F.shiftright(g, 8 * (k - lower))))


def _context(g: Column, order: int) -> Column:
    """A gram of ``order`` without its last byte."""
    return _by_size(g, range(2, order + 1), lambda j: g.bitwiseAND(F.lit((1 << (8 * (j - 1))) - 1)))


def _continued(rows: DataFrame, order: int, lower: int) -> DataFrame:
    """The grams of order ``lower``, each with the number of different grams of ``order`` that end with it; with its
    weight where it begins with its word."""
    g = F.col("gram")
    n = F.when(g < F.lit(1 << (8 * lower)), F.col("n")).otherwise(F.lit(1))
    return rows.select("cls", _low(g, order, lower).alias("gram"), n.alias("n")).groupBy("cls", "gram").agg(F.sum("n").alias("n"))


def _stats(rows: DataFrame) -> dict:
    """By class: all counts, how many grams have count 1 and 2."""
    one = lambda k: F.sum((F.col("n") == k).cast("long"))
    return {r["cls"]: r for r in rows.groupBy("cls").agg(F.sum("n").alias("all"), one(1).alias("n1"), one(2).alias("n2")).collect()}


def _mixed(grams_: DataFrame, rows: DataFrame, order: int, classes: int, stats: dict) -> DataFrame:
    """``grams_`` (gram, l0, .. : the probabilities of the order below) with their probabilities p0, .. by class, from all of
    ``rows`` (cls, gram, n)."""
    ks = range(classes)
    own = rows.groupBy("gram").agg(*(F.sum(F.when(F.col("cls") == k, F.col("n"))).alias(f"n{k}") for k in ks))
    of = own.groupBy(_context(F.col("gram"), order).alias("ctx")).agg(*(F.sum(f"n{k}").alias(f"total{k}") for k in ks), *(F.count(f"n{k}").alias(f"kinds{k}") for k in ks))

    def p(k):
        d, total = F.lit(_discount(stats[k]["n1"], stats[k]["n2"])), F.col(f"total{k}")
        return (F.coalesce((F.col(f"n{k}") - d) / total, F.lit(0.0)) + F.coalesce(d * F.col(f"kinds{k}") / total, F.lit(1.0)) * F.col(f"l{k}")).alias(f"p{k}")

    return grams_.withColumn("ctx", _context(F.col("gram"), order)).join(own, "gram", "left").join(of, "ctx", "left").select("gram", *map(p, ks))


class Model:
    """Counts of all grams, as written tables (cls, gram, n): of each of ORDERS by class, and of the shared order."""

    def __init__(self, by_class: list[DataFrame], shared: DataFrame, every: DataFrame, kept: int):
        """every: the grams of all documents with their numbers."""
        self._by_class, self._shared, self._kept = by_class, shared, kept
        self._stats = [_stats(x) for x in (*by_class, shared)]
        # from the smallest count on that not more than ``kept`` grams have; counts beyond the last are not told apart
        last = 1 << 12
        have = {r["n"]: r["grams"] for r in every.groupBy(F.least("n", F.lit(last)).alias("n")).agg(F.count("*").alias("grams")).collect()}
        least, held = last + 1, 0
        while least > 1 and held + have.get(least - 1, 0) <= kept:
            least -= 1
            held += have.get(least, 0)
        if least > last:  # more than ``kept`` grams have the last count: their share of all counts tells them apart
            least = max(last, -(-every.agg(F.sum("n")).first()[0] // kept))
        top = self.ratios(every.where(F.col("n") >= least).select("gram")).toArrow()
        self.sent = Ratios(top.column("gram").to_numpy().view(np.uint64), top.column("ratio").to_numpy())

    def ratios(self, grams_: DataFrame) -> DataFrame:
        """gram, ratio of different grams of the highest order: log P(last byte | toxic) - log P(last byte | ordinary)."""
        high, low = ORDERS
        g = F.col("gram")
        fours = grams_.select(_low(g, high, low).alias("gram")).distinct()
        threes = fours.select(_low(g, low, SHARED_ORDER).alias("gram")).distinct().withColumn("l0", F.lit(1 / 256))
        base = _mixed(threes, self._shared, SHARED_ORDER, 1, self._stats[2]).select(g.alias("low"), F.col("p0").alias("l0"), F.col("p0").alias("l1"))
        fours = fours.withColumn("low", _low(g, low, SHARED_ORDER)).join(base, "low").drop("low")
        base = _mixed(fours, self._by_class[1], low, 2, self._stats[1]).select(g.alias("low"), F.col("p0").alias("l0"), F.col("p1").alias("l1"))
        sixes = grams_.withColumn("low", _low(g, high, low)).join(base, "low").drop("low")
        return _mixed(sixes, self._by_class[0], high, 2, self._stats[0]).select("gram", (F.log("p1") - F.log("p0")).alias("ratio"))

    @property
    def levels(self) -> list[Level]:
        """The frequent grams of each order, highest first, to look at; no score is made of them."""
        return [Level(_frequent(x, o, range(2), self._kept)) for x, o in zip(self._by_class, ORDERS)]

    @property
    def shared(self) -> Level:
        return Level(_frequent(self._shared, SHARED_ORDER, range(1), self._kept))


def _frequent(rows: DataFrame, order: int, classes: range, kept: int) -> list[dict]:
    """What ``Level`` needs of each class of ``rows`` (cls, gram, n), a written table: the grams with at least 1 / ``kept``
    of all counts, the probability of the others going to the order below."""
    stats = _stats(rows)
    out = []
    for k in classes:
        d, least = _discount(stats[k]["n1"], stats[k]["n2"]), -(-stats[k]["all"] // kept)
        own = rows.where(F.col("cls") == k).select("gram", _context(F.col("gram"), order).alias("ctx"), "n")
        held = F.col("n") >= F.lit(least)
        top = own.where(held).toArrow()
        ctx = own.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum(F.when(held, F.greatest(F.col("n") - F.lit(d), F.lit(0.0))).otherwise(F.lit(0.0))).alias("mass"), F.max(held).alias("held")).where("held").select("ctx", "total", "mass").toArrow()
        col = lambda t, c: t.column(c).to_numpy()
        out.append({"gram": col(top, "gram").view(np.uint64), "ctx": col(top, "ctx").view(np.uint64), "n": col(top, "n"), "ctxs": col(ctx, "ctx").view(np.uint64), "total": col(ctx, "total"), "mass": col(ctx, "mass"), "d": d})
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: int = 2, kept: int = KEPT):
    """(model, curve) from the labelled rows outside the held-out fold; a share instead of both without two classes."""
    spark = docs.sparkSession
    ship(spark)
    t = texts(docs)
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold(F.col("doc_id"))).where(F.col("fold") != held_out)
    last = (held_out + 1) % 4  # the curve is fitted on texts that the models have not seen
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    own = known.where((F.col("fold") != last) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").alias("cls")).hint("merge")  # labels grow with the input
    # the fold is known before the join: only texts that can have a label are dealt
    labelled = t.where(~fold(F.col("doc_id")).isin(held_out, last)).join(own, "doc_id").select("cls", "text")
    top = stored(_merged(labelled, ORDERS[0]), "grams")
    if len(_stats(top)) < 2:
        return share
    lower = stored(_continued(top, *ORDERS), "grams")
    every = stored(_merged(t.select(F.lit(0).alias("cls"), "text"), ORDERS[0]), "grams")
    # the counts of the order above the shared one are sums of these
    above = every.groupBy("cls", _low(F.col("gram"), ORDERS[0], SHARED_ORDER + 1).alias("gram")).agg(F.sum("n").alias("n"))
    model = Model([top, lower], stored(_continued(above, SHARED_ORDER + 1, SHARED_ORDER), "grams"), every, kept)
    seen = _evidence(_sampled(t, _pick(known.where(F.col("fold") == last), sample, 0, 1)), model).toArrow()
    y = np.array(seen.column("toxic").to_pylist(), float)
    if not len(y) or y.min() == y.max():
        return share
    curve = fit_curve(features(np.array(seen.column("e").to_pylist())), np.minimum(y, 1))
    return model, curve


def _evidence(t: DataFrame, model: Model) -> DataFrame:
    """The first column of ``t`` and the evidence e of its second, the text; a row for each row."""
    spark = t.sparkSession
    key = t.columns[0]
    kind = t.schema[key].dataType.simpleString()
    sent = spark.sparkContext.broadcast(pickle.dumps(model.sent))

    def measure(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        ratios = pickle.loads(sent.value)
        open_ = pa.list_(pa.struct([("base", pa.float64()), ("n", pa.int64()), ("grams", pa.list_(pa.int64()))]))
        done = TaskContext.get().partitionId() << 40
        for b in batches:
            for first, last, data, off in slices(b.column(1)):
                e, late = evidence(ratios, data, off)
                ids = np.arange(done, done + len(e))
                done += len(e)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), pa.array(ids), pa.array(list(e), pa.list_(pa.float64())), pa.array(late, open_)], names=[key, "id", "e", "late"])

    # written once, so the ids stay what they are
    found = stored(t.mapInArrow(measure, f"`{key}` {kind}, id long, e array<double>, late array<struct<base:double,n:long,grams:array<long>>>"), "evidence")
    late = found.where(F.size("late") > 0)
    if late.limit(1).count() == 0:
        return found.select(key, "e")
    late = late.select("id", F.posexplode("late").alias("word", "w")).select("id", "word", "w.base", "w.n", F.explode("w.grams").alias("gram"))
    late = late.join(model.ratios(late.select("gram").distinct()), "gram")
    late = late.groupBy("id", "word").agg((F.first("base") + F.sum("ratio")).alias("r"), F.first("n").alias("n"))
    late = late.groupBy("id").agg(F.collect_list("r").alias("r"), F.collect_list("n").alias("n"))

    def complete(batches):
        import pyarrow as pa

        for b in batches:
            e = np.array(b.column(1).to_pylist()).reshape(b.num_rows, -1)
            r, n = b.column(2).fill_null([]), b.column(3).fill_null([])
            if b.num_rows and len(r.flatten()):
                each = np.diff(r.offsets.to_numpy())
                add(e, np.repeat(np.arange(len(e)), each), r.flatten().to_numpy(), n.flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(e), pa.list_(pa.float64()))], names=[key, "e"])

    return found.join(late, "id", "left").select(key, "e", "r", "n").mapInArrow(complete, f"`{key}` {kind}, e array<double>")


def _scored(t: DataFrame, trained) -> DataFrame:
    """The first column of ``t`` and the score of its second, the text."""
    model, curve = trained
    e = _evidence(t, model)
    key = e.columns[0]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = features(np.array(b.column(1).to_pylist()).reshape(b.num_rows, _ABOVE.stop + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(apply_curve(curve, x))], names=[key, "score"])

    return e.mapInArrow(run, f"`{key}` {e.schema[key].dataType.simpleString()}, score double")


def score(docs: DataFrame, trained, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every document."""
    t = texts(docs)
    t = t.select(t["doc_id"].cast("long").alias("doc_id"), "text")
    s = t.select("doc_id", F.lit(trained).alias("score")) if isinstance(trained, float) else _scored(t, trained)
    return s.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def ordinary(docs: DataFrame, trained, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted to be toxic, with all their columns. Texts are told apart by their
    SHA-256; only those that go are written."""
    if isinstance(trained, float):
        return docs if trained < threshold else docs.limit(0)
    ship(docs.sparkSession)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    s = _scored(docs.select(F.sha2(text.cast("binary"), 256).alias("sha"), text.alias("text")), trained)
    gone = stored(s.where(F.col("score") >= threshold).select("sha").distinct(), "toxic")
    return docs.join(gone, F.sha2(text.cast("binary"), 256) == gone["sha"], "left_anti")
