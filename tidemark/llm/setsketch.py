"""Near-duplicate links by SetSketch registers, verified on full shingle sets.

Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set holds its distinct shingles of
``width`` words (the whole sequence if it has fewer words, nothing if it has none), each as a 64-bit hash. Documents
with equal sets form a class and are linked; the smallest doc_id stands for the class. Then, over classes:

1. SetSketch: register i holds the truncated minimum ``K = clip(floor(1 - log_b x), 0, q + 1)`` of exponential
   variables, one per shingle; sketches of parts merge by maximum. Equal registers have nearly the probability J.
2. Bands of ``rows`` register values are hashed; classes that share a band are candidates. Each class is first held
   against the smallest class of each of its buckets: estimated jointly by maximum likelihood over the three register
   comparisons and the known set sizes, and verified on full sets where the estimate is not far below the threshold. A
   bucket of n gives n - 1 such pairs, never all pairs. The components of the verified links are contracted.
3. What is left are buckets with classes of several components, which form families (components linked by such buckets).
   A family's classes are dealt into blocks of bounded bytes, large components into blocks of their own, and each pair
   of blocks that holds two components is one unit of work; within a unit only pairs of different components that share
   a band are estimated and verified. A unit returns a forest of its links, not the links, so no group is emitted or
   gathered as all its pairs, and no link between components is lost. A large group of near copies of one text is done
   in step 2; a family costs its classes times its blocks.
4. Components of the links between components.

With 40 bands of 7 rows, a pair at exactly J = 0.85 shares a band but for a chance of 3e-7. The estimate only skips a
pair ``slack`` = 5 standard deviations below the threshold.

Null or empty texts have the empty set: linked with nothing. Rows that repeat a doc_id are one document whose set is
that of the text that sorts last; a null doc_id is a document of its own (component null). Extra columns are not read.
An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, components, drop, free_name, mix, one_text_each, slices, stored, texts, words

WIDTH, BANDS, ROWS = 5, 40, 7
BASE, RATE, Q = 1.001, 20.0, (1 << 16) - 2
#: Bytes of registers and sets in a block.
BLOCK = 8 << 20
SLACK = 5.0
_C = np.random.default_rng(20260607).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_A = np.random.default_rng(97).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IN = np.ones(256, bool)
_IN[[32, 9, 10, 11, 12, 13]] = False


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): the distinct shingles of each text, ascending; starts has one more entry than texts."""
    n = len(offsets) - 1
    row, h = words(data, offsets, LOWER, _IN)
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    s = np.zeros(len(h), np.uint64)
    for k in range(width):
        if k < len(h):
            s[: len(h) - k] += h[k:] * _C[k]
    left = count[row] - (np.arange(len(h)) - first[row])  # words from here to the end of the text
    full = left >= width
    hs, rows = mix(s[full]), row[full]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = np.array([np.sum(h[first[r] : first[r] + count[r]] * _C[: count[r]]) + np.uint64(count[r]) for r in short], np.uint64)
        hs, rows = np.concatenate([hs, mix(extra)]), np.concatenate([rows, short])
    order = np.lexsort((hs, rows))
    hs, rows = hs[order], rows[order]
    keep = np.ones(len(hs), bool)
    keep[1:] = (hs[1:] != hs[:-1]) | (rows[1:] != rows[:-1])
    hs, rows = hs[keep], rows[keep]
    return hs, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])


def registers(hs: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """SetSketch registers (uint16) of each set, one row per set. Empty sets have zeros."""
    out = np.zeros((len(starts) - 1, m), np.uint16)
    full = np.flatnonzero(np.diff(starts) > 0)
    if not len(full):
        return out
    at = starts[full]
    for i in range(m):
        low = np.minimum.reduceat(hs * _A[i], at)  # exponential variables rise with the uniform ones
        u = (low >> np.uint64(11)).astype(np.float64) * 2.0**-53
        x = -np.log1p(-np.maximum(u, 2.0**-54)) / RATE
        out[full, i] = np.clip(np.floor(1.0 - np.log(x) / np.log(BASE)), 0, Q + 1)
    return out


def band_hashes(regs: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit hash per band and set."""
    r = regs.astype(np.uint64).reshape(len(regs), bands, rows) + np.uint64(1)
    h = np.zeros((len(regs), bands), np.uint64)
    for k in range(rows):
        h = mix(h * np.uint64(31) + r[:, :, k] * _C[k])
    return mix(h + np.arange(bands, dtype=np.uint64) * _C[15])


def likely_jaccard(above: np.ndarray, below: np.ndarray, m: int, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimate of J from how many registers of u are above, below and equal to those of v."""
    u, v = nu / (nu + nv), nv / (nu + nv)
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1.0) * (BASE - 1) / BASE) / np.log(BASE)
    equal = m - above - below

    def ll(j):
        a, b = p(u - v * j), p(v - u * j)
        return above * np.log(a) + below * np.log(b) + equal * np.log(np.maximum(1 - a - b, 1e-12))

    g = 0.6180339887498949
    for _ in range(24):  # the likelihood has one peak
        x1, x2 = hi - g * (hi - lo), lo + g * (hi - lo)
        left = ll(x1) > ll(x2)
        hi, lo = np.where(left, x2, hi), np.where(left, lo, x1)
    return (lo + hi) / 2


def _overlaps(a: int, others: np.ndarray, hs: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of set a with other sets."""
    mine = hs[a]
    lens = np.array([len(hs[k]) for k in others])
    flat = np.concatenate([hs[k] for k in others])
    at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
    return np.add.reduceat((mine[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(lens)[:-1]]))


def block_links(left: list, right: list | None, percent: int, bands: int, rows: int) -> list[tuple[int, int]]:
    """A forest of the links between components, within a block (right None) or between two. A member is (id of its
    component, regs, set); members of one component need no link."""
    both = left + (right or [])
    ids = [x[0] for x in both]
    regs = np.stack([x[1] for x in both])
    hs = [x[2] for x in both]
    n = np.array([len(x) for x in hs])
    keys = band_hashes(regs, bands, rows)
    m, t = bands * rows, percent / 100
    _, top = np.unique(ids, return_inverse=True)  # component of each member, merged as links are found
    out = []
    for a in range(len(left)):
        rest = np.arange(a + 1, len(both)) if right is None else np.arange(len(left), len(both))
        rest = rest[(top[rest] != top[a]) & (100 * np.minimum(n[rest], n[a]) >= percent * np.maximum(n[rest], n[a]))]
        rest = rest[(keys[rest] == keys[a]).any(axis=1)]
        if not len(rest):
            continue
        rest = rest[_likely(np.broadcast_to(regs[a], (len(rest), m)), regs[rest], np.full(len(rest), float(n[a])), n[rest].astype(float), t)]
        if not len(rest):
            continue
        both_in = _overlaps(a, rest, hs)
        for b in rest[100 * both_in >= percent * (n[a] + n[rest] - both_in)].tolist():
            if top[b] != top[a]:
                out.append((ids[a], ids[b]))
                top[top == top[b]] = top[a]
    return out


def _likely(u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray, t: float) -> np.ndarray:
    """Which pairs of register rows are estimated at SLACK standard deviations below t or more."""
    m = u.shape[1]
    return likely_jaccard((u > v).sum(axis=1), (u < v).sum(axis=1), m, nu, nv) >= t - SLACK * np.sqrt(t * (1 - t) / m)


def pair_links(percent: int, m: int):
    """Of rows (a, b, registers and set of a, registers and set of b), the pairs (a, b) that are links."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                b = whole.slice(first, 1024)
                u, v = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(-1, m) for k in (2, 4))
                x, y = ([np.frombuffer(z, "<u8") for z in b.column(k).to_pylist()] for k in (3, 5))
                nu, nv = np.array([len(z) for z in x]), np.array([len(z) for z in y])
                keep = 100 * np.minimum(nu, nv) >= percent * np.maximum(nu, nv)
                keep[keep] = _likely(u[keep], v[keep], nu[keep].astype(float), nv[keep].astype(float), percent / 100)
                for k in np.flatnonzero(keep).tolist():
                    same = int(_overlaps(0, [1], [x[k], y[k]])[0])
                    keep[k] = 100 * same >= percent * (nu[k] + nv[k] - same)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    m = bands * rows
    t = one_text_each(texts(docs))

    def sketch(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            for first, last, data, off in slices(b.column(1)):
                hs, st = shingles(data, off, width)
                regs = registers(hs, st, m)
                n = np.diff(st)
                sig = [hashlib.blake2b(hs[i:j], digest_size=16).digest() for i, j in zip(st[:-1].tolist(), st[1:].tolist())]
                keys = band_hashes(regs, bands, rows).view(np.int64) if len(n) else np.empty((0, bands), np.int64)
                keys = [k if c > 5 else None for k, c in zip(keys.tolist(), n.tolist())] if percent > 83 else keys.tolist()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "sig", "keys"])

    # Small tables are written before they are joined: then both sides are dealt for the join alone, and adaptive
    # execution can split a key that many rows have.
    feats = stored(t.mapInArrow(sketch, "doc_id long, n long, sig binary, keys array<long>"), "setsketch")
    one = feats.where("doc_id is not null").select("doc_id", "n", "sig")
    # classes of equal sets; empty sets are linked with nothing
    classes = one.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").select("sig", "rep")
    classes = stored(classes, "classes")
    member = stored(one.join(classes, "sig", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "members")
    drop(docs.sparkSession, classes._tidemark_path)
    reps = member.where("doc_id = rep and n > 0").select("rep")
    banded = feats.where("keys is not null").select(F.col("doc_id").alias("rep"), "n", "keys").join(reps, "rep", "left_semi").select("rep", "n", F.explode("keys").alias("key"))
    pivots = stored(banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("other")).where("pivot < other").select("key", "pivot"), "pivots")
    shared = stored(banded.join(pivots, "key"), "shared")
    drop(docs.sparkSession, pivots._tidemark_path)

    def sets(batches):
        import pyarrow as pa

        for b in batches:
            for first, last, data, off in slices(b.column(1)):
                hs, st = shingles(data, off, width)
                regs = [x.tobytes() for x in registers(hs, st, m).astype("<u2")]
                blobs = [hs[i:j].tobytes() for i, j in zip(st[:-1].tolist(), st[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), pa.array(regs, pa.binary()), pa.array(blobs, pa.binary())], names=["rep", "regs", "set"])

    # texts are dealt, not the ids broadcast: their number grows with the input
    named = t.join(shared.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    full = stored(named.mapInArrow(sets, "rep long, regs binary, set binary"), "sets")
    stars = shared.where("rep > pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = stars.join(full.toDF("a", "regs_a", "set_a"), "a").join(full.toDF("b", "regs_b", "set_b"), "b").select("a", "b", "regs_a", "set_a", "regs_b", "set_b")
    comp = stored(components(pairs.mapInArrow(pair_links(percent, m), "a long, b long")).select(F.col("node").alias("rep"), "component"), "near")
    # buckets that hold several components
    labelled = shared.join(comp, "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("own"))
    mixed = stored(labelled.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select("key", "low"), "mixed")
    rest = stored(labelled.join(mixed, "key"), "rest")
    families = components(rest.where("own > low").select(F.col("own").alias("a"), F.col("low").alias("b")).distinct()).select(F.col("node").alias("own"), F.col("component").alias("family"))
    rest = stored(rest.select("rep", "n", "own").distinct().join(stored(families, "families"), "own"), "rest")
    work = _units(rest, m, block).join(full, "rep").select("family", "low", "high", "at", "own", "regs", "set")
    dealt = work.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high", "at", "own")

    def link(batches):
        import pyarrow as pa

        def solve(key, held):
            parts = [[x[1:] for x in held if x[0] == at] for at in sorted({key[1], key[2]})]
            return block_links(parts[0], parts[1] if len(parts) > 1 else None, percent, bands, rows) if all(parts) else []

        def out(pairs_):
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs_], pa.int64()), pa.array([p[1] for p in pairs_], pa.int64())], names=["a", "b"])

        key, held = None, []
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(5)]
            for f, low, high, at, own, regs, blob in zip(*cols, b.column(5), b.column(6)):
                if (f, low, high) != key:
                    if held:
                        yield out(solve(key, held))
                    key, held = (f, low, high), []
                held.append((at, own, np.frombuffer(regs.as_py(), "<u2"), np.frombuffer(blob.as_py(), "<u8")))
        if held:
            yield out(solve(key, held))

    last = components(dealt.mapInArrow(link, "a long, b long")).select(F.col("node").alias("own"), F.col("component").alias("all"))
    to = comp.withColumnRenamed("component", "own")
    done = member.join(to, "rep", "left").select("doc_id", "n", F.coalesce("own", "rep").alias("own"))
    done = done.join(stored(last, "links"), "own", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("all", "own").alias("component_id"))
    done = done.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nulls = feats.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return done.unionByName(nulls)


def _units(rest: DataFrame, m: int, block: int) -> DataFrame:
    """(family, low, high, at, own, rep): the units that each class takes part in; at: its own block of the two.

    Components of more than half a block have blocks of their own, which need not meet each other; all others of a family
    share blocks. Blocks are numbered from the shared ones on.
    """
    w = rest.withColumn("bytes", F.col("n") * 8 + 2 * m)
    sizes = w.groupBy("family", "own").agg(F.sum("bytes").alias("bytes"))
    half = F.lit(block // 2)
    sizes = stored(sizes.withColumn("blocks", F.when(F.col("bytes") > half, F.ceil(F.col("bytes") / F.lit(block))).otherwise(0).cast("int")), "sizes")
    small = F.sum(F.when(F.col("blocks") == 0, F.col("bytes")).otherwise(0))
    fams = stored(sizes.groupBy("family").agg(F.ceil(small / F.lit(block)).cast("int").alias("shared"), F.sum("blocks").cast("int").alias("large")), "fams")
    upto = F.sum("blocks").over(W.partitionBy("family").orderBy("own").rowsBetween(W.unboundedPreceding, -1))
    large = stored(sizes.where("blocks > 0").select("family", "own", "blocks", F.coalesce(upto, F.lit(0)).cast("int").alias("first")), "large")
    x = w.join(fams, "family").join(large, ["family", "own"], "left").withColumn("first", F.col("first") + F.col("shared"))
    x = x.withColumn("at", F.when(F.col("blocks") > 0, F.col("first") + F.pmod(F.xxhash64("rep"), F.col("blocks"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("shared"))).cast("int"))
    every = F.sequence(F.lit(0), F.col("shared") + F.col("large") - 1)
    others = F.filter(every, lambda o: F.col("blocks").isNull() | (o < F.col("first")) | (o >= F.col("first") + F.col("blocks")))
    return x.select("family", "own", "rep", "at", F.explode(others).alias("other")).select("family", F.least("at", "other").alias("low"), F.greatest("at", "other").alias("high"), "at", "own", "rep")


def one_of_each(docs: DataFrame, percent: int = 85, every_text: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group of near-duplicates is kept, with all their
    columns. Of rows that share a doc_id, the one with the text that sorts last stays; with ``every_text`` different texts
    that share a doc_id are documents of their own, and one row of each stays."""
    name = free_name("own", docs)
    own = _own_ids(docs, name) if every_text else docs.withColumn(name, F.col("doc_id").cast("long"))
    gone = near_duplicates(own.select(F.col(name).alias("doc_id"), "text"), percent, rows=rows_for(percent)).where("not kept")
    other = free_name("gone", own)
    left = own.join(gone.select(F.col("doc_id").alias(other)).hint("merge"), F.col(name) == F.col(other), "left_anti").select(*docs.columns)
    if every_text or docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() == 0:
        return left
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("text").desc_nulls_last()))
    name = free_name("rank", docs)
    return left.withColumn(name, rank).where((F.col(name) == 1) | F.col("doc_id").isNull()).drop(name)


def _own_ids(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column ``name``: an id for each different text of a doc_id, on one row. It is the doc_id for the text that
    sorts last, and for the others one from 2^62 on that no row has, so that they never stand for a group with other rows."""
    many = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if many.limit(1).count() == 0:
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sha = F.sha2(text.cast("binary"), 256)
    last = free_name("last", docs)
    tops = docs.join(many.hint("merge"), "doc_id", "left_semi").groupBy(F.col("doc_id").alias(name)).agg(F.max(text).alias(last))
    tops = stored(tops.select(name, F.sha2(F.col(last).cast("binary"), 256).alias(last)), "tops")
    d = docs.join(tops.hint("merge"), docs["doc_id"] == tops[name], "left").drop(name)
    shared = F.col(last).isNotNull()
    for salt in range(16):
        fresh = F.xxhash64("doc_id", text, F.lit(salt)).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
        own = d.withColumn(name, F.when(shared & (sha != F.col(last)), fresh).otherwise(F.col("doc_id").cast("long")))
        new = stored(own.where(shared & (sha != F.col(last))).select(name, "doc_id", sha.alias(last)).distinct(), "own")
        taken = new.select(name).join(docs.select(F.col("doc_id").cast("long").alias(name)), name, "left_semi")
        if new.groupBy(name).count().where("count > 1").limit(1).count() == 0 and taken.limit(1).count() == 0:
            return own.where(~shared).unionByName(own.where(shared).dropDuplicates([name])).drop(last)
    raise RuntimeError("no free doc_ids")


def rows_for(percent: int) -> int:
    """Register values a band: the most with which a pair at the threshold misses all BANDS bands with a chance below 1e-5."""
    return max((r for r in range(1, ROWS + 1) if (1 - (percent / 100) ** r) ** BANDS < 1e-5), default=1)
