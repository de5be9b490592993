"""Benchmark decontamination over a distributed positional inverted index.

The index: token postings of all training documents, in segments. A segment covers a run of documents of one input
partition and holds its terms (64-bit hashes, ascending), the number of postings of each, and all postings, term by
term, ascending. A posting is a token's place in the segment; documents are set apart by a gap so that no phrase can
span two. Segments are rows of a table in the shared folder; nothing is shuffled to build them.

A query is a window of terms. In each segment its terms are taken from the rarest on: the rarest term's postings give
candidate starts, and every next term's list, shifted by the term's offset, is intersected with them (a lookup in the
segment's (term, place) order). ``slop`` = 0 gives exact phrases; a larger slop keeps windows whose every term stands
within ``slop`` places of its own (proximity matches). Windows are sent to the segments in blocks of a bounded number
of words, one pass over the index per block, so the benchmark may be of any size.

Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased. An item of fewer than
``window`` words, but not none, is one window. Null texts have no words. Every row is a document of its own,
also if doc_ids are shared or null; items that share an item_id are one item with several texts; null ids are kept as null.
Extra columns are not read. Empty tables give empty or clean results.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, free_name, slices, stored, texts, words
from .repair import expand

WINDOW = 10
GAP = 1 << 10
#: Words of benchmark windows in one block (about 50 MB on an executor).
BLOCK_WORDS = 2_000_000
#: Candidates tested at once in a segment.
CHUNK = 1 << 20
_IN = np.zeros(256, bool)
_IN[48:58] = _IN[97:123] = _IN[128:] = True


def build_index(t: DataFrame) -> DataFrame:
    """The written index of the texts of ``t`` (key, text): docs (their keys), sizes (words of each), terms, counts,
    postings of every segment, as packed arrays."""

    def segment(batches):
        import pyarrow as pa

        for b in batches:
            for first, last, data, off in slices(b.column(1)):
                row, h = words(data, off, LOWER, _IN)
                n = np.bincount(row, minlength=last - first)
                place = (np.arange(len(h)) + row * GAP).astype(np.uint32)
                order = np.argsort(h, kind="stable")
                hs = h[order]
                new = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]])) if len(hs) else np.empty(0, np.int64)
                counts = np.diff(np.append(new, len(hs))).astype("<u4")
                own = b.column(0).slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own.to_pylist()], pa.list_(pa.string())), *(pa.array([x.tobytes()], pa.binary()) for x in (n.astype("<u4"), hs[new].astype("<u8"), counts, place[order].astype("<u4")))],
                    names=["docs", "sizes", "terms", "counts", "postings"],
                )

    return stored(t.mapInArrow(segment, "docs array<string>, sizes binary, terms binary, counts binary, postings binary"), "postings")


class Segment:
    """One segment, ready for lookups."""

    def __init__(self, docs: list, sizes: bytes, terms: bytes, counts: bytes, postings: bytes):
        self.docs = docs
        self.sizes = np.frombuffer(sizes, "<u4").astype(np.int64)
        self.terms = np.frombuffer(terms, "<u8")
        counts_ = np.frombuffer(counts, "<u4").astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(counts_)])
        self.postings = np.frombuffer(postings, "<u4").astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes + np.arange(len(self.sizes)) * GAP
        self._keys: np.ndarray | None = None

    def keys(self) -> np.ndarray:
        """(term number, place) of every posting as one ascending number."""
        if self._keys is None:
            self._keys = (np.repeat(np.arange(len(self.terms)), np.diff(self.at)) << 34) | self.postings
        return self._keys

    def phrases(self, terms: np.ndarray, lengths: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every match. terms: windows x width hashes, padded on the right; lengths: of the windows."""
        none = np.empty(0, np.int64)
        if not len(self.terms) or not len(terms):
            return none, none
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        inside = np.arange(terms.shape[1]) < lengths[:, None]
        alive = np.flatnonzero(((self.terms[at] == terms) | ~inside).all(axis=1))
        if not len(alive):
            return none, none
        no, inside = at[alive], inside[alive]
        count = np.where(inside, np.diff(self.at)[no], np.iinfo(np.int64).max)
        rank = np.argsort(count, axis=1, kind="stable")  # rarest first
        rare = rank[:, 0]
        each = count[np.arange(len(alive)), rare]
        got_w, got_s = [], []
        ends = np.cumsum(each)
        first = 0
        while first < len(alive):
            base = ends[first] - each[first]
            last = max(first + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
            w = np.repeat(np.arange(first, last), each[first:last])
            s = self.postings[np.repeat(self.at[no[np.arange(first, last), rare[first:last]]], each[first:last]) + expand(each[first:last])] - rare[w]
            for k in range(1, terms.shape[1]):
                live = lengths[alive[w]] > k
                off = rank[w, k]
                ok = self._near((no[w, off] << 34) | np.maximum(s + off, 0), slop) | ~live
                w, s = w[ok], s[ok]
                if not len(w):
                    break
            got_w.append(alive[w])
            got_s.append(s)
            first = last
        return np.concatenate(got_w), np.concatenate(got_s)

    def _near(self, want: np.ndarray, slop: int) -> np.ndarray:
        keys = self.keys()
        k = np.searchsorted(keys, want - slop)
        return keys[np.minimum(k, len(keys) - 1)] <= want + slop if slop else (keys[np.minimum(k, len(keys) - 1)] == want)

    def documents(self, start: np.ndarray, slop: int = 0) -> np.ndarray:
        """Row of the document that each match is in; with a slop a match may seem to start in the gap before it."""
        return np.searchsorted(self.starts, start + slop, "right") - 1

    def covered(self, start: np.ndarray, lengths: np.ndarray, slop: int = 0) -> np.ndarray:
        """Which words of the segment are inside a match, as one flag per word in document order."""
        total = int(self.sizes.sum())
        doc = self.documents(start, slop)
        flat = start - doc * GAP
        limit = np.cumsum(self.sizes)[doc]
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, np.maximum(flat, limit - self.sizes[doc]), 1)
        np.add.at(edge, np.minimum(flat + lengths, limit), -1)
        return np.cumsum(edge)[:total] > 0


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, length, terms (packed hashes) of every distinct window of the items."""
    t = items.select(items["item_id"].cast("string").alias("doc_id"), F.coalesce(items["text"].cast("string"), F.lit("")).alias("text"))

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            for first, last, data, off in slices(b.column(1)):
                row, h = words(data, off, LOWER, _IN)
                n = np.bincount(row, minlength=last - first)
                at = np.cumsum(n) - n
                ids, lens, blobs = [], [], []
                for name, c, a in zip(b.column(0).slice(first, last - first).to_pylist(), n.tolist(), at.tolist()):
                    size = min(c, window)
                    for k in range(c - size + 1 if c else 0):
                        ids.append(name)
                        lens.append(size)
                        blobs.append(h[a + k : a + k + size].astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lens, pa.int32()), pa.array(blobs, pa.binary())], names=["item_id", "length", "terms"])

    return t.mapInArrow(cut, "item_id string, length int, terms binary").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted strings), hit_spans (word start, end) of every row of ``docs``."""
    # a key of each row's own, settled when the index is written; the doc_id goes along in it
    own = F.concat_ws(":", F.monotonically_increasing_id(), F.col("doc_id").cast("long"))
    found = _found(texts(docs).select(own.alias("key"), "text"), items, window, slop, block_words)
    return found.withColumn("key", F.get(F.split("key", ":"), F.lit(1)).cast("long")).withColumnRenamed("key", "doc_id")


def _found(t: DataFrame, items: DataFrame, window: int, slop: int, block_words: int) -> DataFrame:
    """key, n_words, item_ids, hit_spans, n_hit of the texts of ``t`` (key, text); rows of one key have equal texts."""
    spark = t.sparkSession
    index = build_index(t)
    wins = stored(item_windows(items, window), "windows")
    per = max(1, block_words // window)
    blocks = max(1, -(-wins.count() // per))
    wins = wins.withColumn("block", F.pmod(F.xxhash64("terms"), F.lit(blocks)))
    schema = "key string, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
    found = None
    for k in range(blocks):  # each holds a bounded number of windows
        own = wins.where(F.col("block") == k).select("item_id", "length", "terms").toArrow()
        lens = np.array(own.column("length").to_pylist(), np.int64)
        terms = np.zeros((len(lens), window), np.uint64)
        for i, x in enumerate(own.column("terms").to_pylist()):
            terms[i, : len(x) // 8] = np.frombuffer(x, "<u8")
        sent = spark.sparkContext.broadcast(pickle.dumps((own.column("item_id").to_pylist(), lens, terms)))
        part = index.mapInArrow(_matcher(sent, slop), schema)
        if blocks > 1:  # a block is done before the next one comes to the driver
            part = stored(part.where(F.size("spans") > 0) if k else part, "hits")
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy("key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    merged = _union_spans(F.col("spans")) if blocks > 1 else F.col("spans")
    return found.select("key", "n_words", F.array_sort("items").alias("item_ids"), merged.alias("hit_spans")).withColumn(
        "n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long"))
    )


def _matcher(sent, slop: int):
    def run(batches):
        import pyarrow as pa

        ids, lens, terms = pickle.loads(sent.value)
        ids = np.array(ids, object)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            for row in zip(*(b.column(k) for k in range(5))):
                s = Segment(*(x.as_py() for x in row))
                w, start = s.phrases(terms, lens, slop)
                n = len(s.docs)
                spans, items = [[] for _ in range(n)], [[] for _ in range(n)]
                if len(w):
                    hit = s.covered(start, lens[w], slop)
                    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
                    a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    cuts = np.cumsum(s.sizes)
                    first = cuts - s.sizes
                    for x, y in zip(a.tolist(), z.tolist()):
                        d = int(np.searchsorted(cuts, x, "right"))
                        while x < y:  # a run may go on into the next document
                            stop = min(y, int(cuts[d]))
                            if stop > x:
                                spans[d].append({"start": x - int(first[d]), "end": stop - int(first[d])})
                            x, d = stop, d + 1
                    doc = s.documents(start, slop)
                    for d, i in set(zip(doc.tolist(), w.tolist())):
                        items[d].append(ids[i])
                    items = [sorted({x for x in xs if x is not None}) for xs in items]
                yield pa.RecordBatch.from_arrays([pa.array(s.docs, pa.string()), pa.array(s.sizes, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], names=["key", "n_words", "spans", "items"])

    return run


def _union_spans(spans):
    """Overlapping or touching spans joined, ascending."""
    kind = "array<struct<start:int,end:int>>"
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast(kind),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with all their columns."""
    # what a row holds is known by its text, whatever its doc_id
    key = F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"), 256)
    name = free_name("hit", docs)
    hit = _found(texts(docs).select(F.sha2(F.col("text").cast("binary"), 256).alias("key"), "text"), items, window, 0, block_words).where("n_hit > 0").select(F.col("key").alias(name)).distinct()
    return docs.join(stored(hit, "hit").hint("merge"), key == F.col(name), "left_anti")
