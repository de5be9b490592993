"""Long repeated strings by suffix arrays: two-stage sorting, adjacent common prefixes, removal of covered bytes.

A string of ``length`` bytes counts as repeated if it also starts anywhere else, in the same document or another one;
every byte under a repeated string goes. Strings never cross documents.

Distribution. Each string holds length - GRAM + 1 grams of GRAM bytes; the smallest hash among them is its key, so
equal strings have equal keys and meet. The strings of a document that start next to each other and have the same key
form a chunk, which is described by its key, its range of starts and a 64-bit digest of its bytes (equal chunks are those
of one key with one digest). Equal chunks are counted
before anything is dealt by key, and only chunks of keys that occur more than once go on, one text for each different
chunk with the number of its copies. A key with more than GROUP different chunks is cut up by keys of the same kind
with longer grams (GRAMS); the last are whole strings, of which a key has one each, so no group grows with the input.

Within a task, the chunks' texts are laid one after the other and sorted as one suffix array in two stages (Itoh and
Tanaka): only suffixes smaller than their successors are sorted directly, by eight bytes at a time until they differ or
are known to be equal over ``length`` bytes; the others are induced by one scan over the buckets of their first bytes.
Adjacent common prefixes of at least ``length`` bytes, compared byte by byte, mark repeated strings.

Null texts are empty. Rows that share a doc_id are one document with the text that sorts last; a null doc_id is kept
as null, is compared like any other document, and needs no id for it. Extra columns are not read. An empty table gives
an empty table.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import _powers, mix, one_text_each, prefix_hash, slices, stored, texts
from .repair import expand

LENGTH = 400
GRAM = 128
#: Grams of further keys as parts of ``length``, for keys with more than GROUP different chunks.
GRAMS = (0.5, 1.0)
GROUP = 4096
#: Bytes of text in one suffix array.
ARRAY_BYTES = 2 << 20
_PAD = 64


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1])
    return out


def window_hash(h: np.ndarray, n: int, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive bytes, from the prefix hash h."""
    return mix((h[size : n + 1] - h[: n + 1 - size]) * _powers(n + 1)[1][: n + 1 - size])


def chunks(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(row, first start, number of starts, key, hash, several) of every chunk; starts count from the text's begin.

    several: two strings of the chunk are equal (by their hashes), so it repeats a string by itself.
    """
    n = len(data)
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    if n < length:
        return none
    h = prefix_hash(data)
    g = window_hash(h, n, gram)
    w = length - gram + 1
    key = sliding_min(g, w)  # one for every start of a string in the concatenation
    sizes = np.diff(offsets)
    starts_of = np.maximum(sizes - length + 1, 0)
    row = np.repeat(np.arange(len(sizes)), starts_of)
    if not len(row):
        return none
    local = expand(starts_of)
    at = offsets[row] + local
    k = key[at]
    new = np.ones(len(at), bool)
    new[1:] = (k[1:] != k[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    begin = at[first]
    k = k[first]
    end = begin + count - 1 + length
    raw = data.tobytes()
    own = np.frombuffer(b"".join([blake2b(raw[a:z], digest_size=8).digest() for a, z in zip(begin.tolist(), end.tolist())]), np.uint64)
    # equal strings of a chunk hold its key's gram at two places: only such chunks are looked into
    several = _gram_places(g, key, w, k, begin, end - gram) > 1
    maybe = np.flatnonzero(several)
    if len(maybe):
        of = np.repeat(maybe, count[maybe])
        whole = window_hash(h, n, length)[begin[of] + expand(count[maybe])]
        order = np.lexsort((whole, of))
        of, whole = of[order], whole[order]
        several[maybe] = False
        several[of[1:][(of[1:] == of[:-1]) & (whole[1:] == whole[:-1])]] = True
    return row[first], local[first], count, k, own, several


def _gram_places(g: np.ndarray, key: np.ndarray, w: int, k: np.ndarray, begin: np.ndarray, last: np.ndarray) -> np.ndarray:
    """At how many places of [begin, last] the gram hash is k, for every chunk (chunks overlap).

    key: the smallest of every w consecutive values of g. Only places whose gram is the key of a string that holds it
    can count, which are few.
    """
    wide = np.full(len(key) + 2 * (w - 1), np.iinfo(np.uint64).max, np.uint64)
    wide[w - 1 : w - 1 + len(key)] = ~key
    hit = np.flatnonzero(g == ~sliding_min(wide, w))  # the largest key of the strings that hold the place
    kinds, rank = np.unique(g[hit], return_inverse=True)
    at = np.sort(rank * len(g) + hit)
    of = np.searchsorted(kinds, k) * len(g)  # every k is the gram of a hit
    return np.searchsorted(at, of + last, "right") - np.searchsorted(at, of + begin)


# ---------------------------------------------------------------- suffix array


def two_stage(text: np.ndarray, wanted: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Order of the suffixes of ``text`` at the places flagged in ``wanted``, by their first ``length`` bytes.

    Each run of flagged places must end at a suffix smaller than its successor (see ``lay``). Suffixes smaller than
    their successors (type B) are sorted directly; the rest (type A) are induced.
    """
    n = len(wanted)
    t = text[: n + 1].astype(np.int16)
    less, more = t[:-1] < t[1:], t[:-1] > t[1:]
    # equal bytes take the type of what follows
    step = np.where(less, 1, np.where(more, 2, 0)).astype(np.int8)
    nxt = np.where(step > 0, np.arange(n), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    kind_b = np.where(nxt < n, step[np.minimum(nxt, n - 1)] == 1, True)
    b = np.flatnonzero(wanted & kind_b)
    b = _direct(text, b, length)
    a_total = np.bincount(text[np.flatnonzero(wanted & ~kind_b)], minlength=256)
    b_by = np.searchsorted(text[b], np.arange(257))
    out = []
    ready: list[list[np.ndarray]] = [[] for _ in range(256)]  # induced suffixes of each bucket, in order
    is_a = wanted & ~kind_b
    for c in range(256):
        if not a_total[c] and b_by[c] == b_by[c + 1]:
            continue
        front = ready[c]
        k = 0
        while k < len(front):  # suffixes induced within this bucket are appended while it is scanned
            _induce(text, is_a, front[k], ready, c)
            k += 1
        own = b[b_by[c] : b_by[c + 1]]
        _induce(text, is_a, own, ready, c)
        out += [*front, own]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _induce(text, is_a, entries, ready, c) -> None:
    """Append the type A predecessors of ``entries`` to their buckets, in the order of the scan."""
    p = entries[entries > 0] - 1
    p = p[is_a[p]]
    if not len(p):
        return
    first = text[p]
    order = np.argsort(first, kind="stable")
    p, first = p[order], first[order]
    cuts = np.flatnonzero(np.diff(first)) + 1
    for part in np.split(p, cuts):
        ready[text[part[0]]].append(part)


def _direct(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Sort suffixes by eight bytes at a time; groups that are equal over ``length`` bytes are done."""
    if len(at) < 2:
        return at
    words = np.lib.stride_tricks.as_strided(np.frombuffer(text.data, np.uint8).view(), (len(text) - 7, 8), (1, 1))
    h = prefix_hash(text)
    whole = window_hash(h, len(text), length)
    read = lambda i: np.ascontiguousarray(words[i]).view(">u8").ravel().astype(np.uint64)
    leap = window_hash(h, len(text), _PAD)
    v = read(at)
    order = np.argsort(v, kind="stable")
    out, v = at[order], v[order]
    new = np.ones(len(out), bool)
    new[1:] = v[1:] != v[:-1]
    lo = np.arange(len(out))  # places of ``out`` that are not settled, their groups and how many bytes agree
    group, depth = np.cumsum(new) - 1, np.full(len(out), 8)
    while True:
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(first, len(group)))
        gid = np.repeat(np.arange(len(first)), size)
        s = out[lo]
        alike = lambda x: np.logical_and.reduceat(x == x[first][gid], first)  # noqa: E731,B023
        stay = ((size > 1) & ~alike(whole[s]) & (depth[first] < length))[gid]
        lo, group, depth, s = lo[stay], group[stay], depth[stay], s[stay]
        if not len(lo):
            return out
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        gid = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(group))))
        far = alike(leap[s + depth])[gid]  # the whole group agrees that far
        i = np.flatnonzero(~far)
        depth[far] += _PAD
        group = gid * 2
        if len(i):
            v = read(s[i] + depth[i])
            order = np.lexsort((v, gid[i]))
            v, g = v[order], gid[i][order]
            out[lo[i]] = s[i][order]  # groups keep their own places, which ascend
            new = np.ones(len(i), bool)
            new[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
            part = np.cumsum(new)
            group = gid * (len(i) + 1)
            group[i] += part  # parts ascend within a group
            depth[i] += 8


def lay(parts: list[bytes], starts: list[int], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, wanted, begin): chunk texts one after the other, zero-padded; the starts to sort and a few after them.

    After a chunk's last start, places are added up to one whose suffix is smaller than its successor, so that every
    induced suffix has its successor in the array.
    """
    room = length + _PAD
    sizes = np.array([len(p) for p in parts])
    begin = np.cumsum(sizes + room) - sizes - room
    text = np.zeros(int((sizes + room).sum()) + room, np.uint8)
    wanted = np.zeros(len(text) - room, bool)
    for p, n, b in zip(parts, starts, begin.tolist()):
        raw = np.frombuffer(p, np.uint8)
        text[b : b + len(raw)] = raw
        i = n  # one past the last start
        while i < len(raw) and not _rises(raw, i):
            i += 1
        wanted[b : b + i + 1] = True
        if i >= len(raw):  # no such place: the chunk's end, below every other suffix, is one
            wanted[b : b + len(raw) + 1] = True
    return text, wanted, begin


def _rises(raw: np.ndarray, i: int) -> bool:
    j = i + 1
    while j < len(raw) and raw[j] == raw[i]:
        j += 1
    return j < len(raw) and raw[j] > raw[i]


def repeated_starts(parts: list[bytes], starts: list[int], copies: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each chunk, a flag for each of its starts: is the string there repeated?"""
    text, wanted, begin = lay(parts, starts, length)
    order = two_stage(text, wanted, length)
    owner = np.searchsorted(begin, order, "right") - 1
    n = np.array(starts)
    ok = order - begin[owner] < n[owner]  # only real starts count from here on
    order, owner = order[ok], owner[ok]
    rows = np.lib.stride_tricks.as_strided(text, (len(text) - length + 1, length), (1, 1))
    flag = np.zeros(len(text), bool)
    flag[order] = np.array(copies)[owner] > 1
    h = window_hash(prefix_hash(text), len(text), length)[order]
    near = np.flatnonzero(h[1:] == h[:-1])  # then byte by byte
    for k in range(0, len(near), 1 << 15):
        i = near[k : k + (1 << 15)]
        x, y = order[i], order[i + 1]
        same = (rows[x] == rows[y]).all(axis=1)
        flag[x[same]] = True
        flag[y[same]] = True
    return [flag[b : b + c] for b, c in zip(begin.tolist(), starts)]


# ---------------------------------------------------------------- Spark


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every document."""
    spark = docs.sparkSession
    t = _numbered(one_text_each(texts(docs)))

    def describe(batches):
        import pyarrow as pa

        for b in batches:
            for first, last, data, off in slices(b.column(b.schema.get_field_index("text"))):
                row, start, count, key, own, several = chunks(data, off, length, gram)
                ids = b.column(0).slice(first, last - first).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(own.view(np.int64)), pa.array(several)], names=["doc_id", "start", "count", "key", "own", "several"])

    found = stored(t.mapInArrow(describe, "doc_id long, start int, count int, key long, own long, several boolean"), "chunks")
    for part in (*GRAMS, None):
        # one row per different chunk: its copies and one place to read it from
        kinds = stored(found.groupBy("key", "own").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "start")).alias("at"), F.min("count").alias("count"), F.max("several").alias("several")).select("key", "own", "copies", "at.*", "count", "several"), "kinds")
        # estimated from a share of the kinds: it only decides how keys are dealt, not what is found
        share = 16 if group >= 1024 else 1
        hot = kinds.where(F.pmod("own", F.lit(share)) == 0).groupBy("key").count().where(F.col("count") > group / share).select("key")
        if part is None or hot.limit(1).count() == 0:
            break
        hot = stored(hot, "hot")
        again = found.join(hot, "key", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("start", "count", "key")).alias("wanted"))
        finer = t.dropDuplicates(["doc_id"]) if "anon" in t.columns else t
        finer = finer.join(again, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_refine(length, int(length * part)), found.schema)
        found = stored(found.join(hot, "key", "left_anti").select(found.columns).unionByName(finer), "chunks")
    # a key has a bounded number of different chunks now
    own_key = W.partitionBy("key")
    kinds = kinds.withColumn("n", F.sum("copies").over(own_key)).withColumn("s", F.max("several").over(own_key)).where("n > 1 or s")
    kinds = kinds.select("key", "own", "copies", "doc_id", "start", "count")
    need = kinds.groupBy("doc_id").agg(F.collect_list(F.struct("start", "count", "key", "own", "copies")).alias("wanted"))

    def cut(batches):
        """The chunks' texts, packed: they are the bulk of what is dealt."""
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            text, wanted = b.column(0), b.column(1)
            for x, ws in zip(text, wanted):
                raw = x.as_py().encode()
                ws = ws.as_py()
                for k in range(0, len(ws), 4096):
                    part = ws[k : k + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([w[c] for w in part], kind) for c, kind in (("key", pa.int64()), ("own", pa.int64()), ("count", pa.int32()), ("copies", pa.int64()))]
                        + [pa.array([pack(raw[w["start"] : w["start"] + w["count"] - 1 + length]) for w in part], pa.binary())],
                        names=["key", "own", "count", "copies", "chunk"],
                    )

    # null-safe both times: the same exchange of the texts serves this join and the last one
    pieces = t.join(need, t["doc_id"].eqNullSafe(need["doc_id"])).select("text", "wanted").mapInArrow(cut, "key long, own long, count int, copies long, chunk binary")
    dealt = pieces.repartition("key").sortWithinPartitions("key")

    def mark(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress

        def solve(held):
            flags = repeated_starts([h[4] for h in held], [h[2] for h in held], [h[3] for h in held], length)
            rows_ = [(h[0], h[1], list(zip(*(x.tolist() for x in runs(f))))) for h, f in zip(held, flags)]
            rows_ = [r for r in rows_ if r[2]]
            kind = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows_], pa.int64()), pa.array([r[1] for r in rows_], pa.int64()), pa.array([[{"a": a, "z": z} for a, z in r[2]] for r in rows_], kind)], names=["key", "own", "runs"])

        held, size = [], 0
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(5))):
                if held and size >= ARRAY_BYTES and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append((*row[:4], unpack(row[4])))
                size += len(held[-1][4]) + length + _PAD
        if held:
            yield solve(held)

    marked = dealt.mapInArrow(mark, "key long, own long, runs array<struct<a:int,z:int>>")
    hit = found.select("doc_id", "start", "key", "own").join(marked, ["key", "own"])
    per = hit.groupBy("doc_id").agg(F.collect_list(F.struct("start", "runs")).alias("hits"))

    def drop(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            n, gone, spans, sha, kept = [], [], [], [], []
            for x, hits in zip(b.column(1), b.column(2)):
                raw = np.frombuffer(x.as_py().encode(), np.uint8)
                hits = hits.as_py()
                out = raw
                cuts = 0
                if hits:
                    edge = np.zeros(len(raw) + 1, np.int32)
                    lo = np.array([h["start"] + r["a"] for h in hits for r in h["runs"]])
                    hi = np.array([h["start"] + r["z"] - 1 + length for h in hits for r in h["runs"]])
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, hi, -1)
                    covered = np.cumsum(edge)[:-1] > 0
                    cuts = len(runs(covered)[0])
                    out = raw[~covered]
                n.append(len(raw))
                gone.append(len(raw) - len(out))
                spans.append(cuts)
                body = out.tobytes()
                sha.append(hashlib.sha256(body).hexdigest())
                kept.append(body)
            cols = [b.column(0), *(pa.array(v, pa.int64()) for v in (n, gone, spans)), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    own_id = F.when(~t["anon"], t["doc_id"]) if "anon" in t.columns else t["doc_id"]
    per = per.select(F.col("doc_id").alias("id"), "hits")
    done = t.join(per, t["doc_id"].eqNullSafe(per["id"]), "left").select(own_id.alias("doc_id"), "text", "hits")
    return done.mapInArrow(drop, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def _numbered(t: DataFrame) -> DataFrame:
    """Documents without a doc_id get one that no other has, by a hash of their text, and are marked (anon); equal
    texts share it, and have equal results. Without such documents, ``t`` itself."""
    none = t.where("doc_id is null")
    if none.limit(1).count() == 0:
        return t
    for salt in range(16):
        own = none.select(F.xxhash64("text", F.lit(salt)).alias("doc_id"), "text", F.lit(True).alias("anon"))
        if t.select("doc_id").join(own.select("doc_id"), "doc_id", "left_semi").limit(1).count() == 0:
            return t.where("doc_id is not null").withColumn("anon", F.lit(False)).unionByName(own)
    raise RuntimeError("no free doc_ids")


def _refine(length: int, gram: int):
    """Cut the given chunks of each text into chunks by keys of longer grams."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for d, x, ws in zip(b.column(0), b.column(1), b.column(2).to_pylist()):
                raw = np.frombuffer(x.as_py().encode(), np.uint8)
                for k in range(0, len(ws), 1024):
                    own = ws[k : k + 1024]
                    pieces = [raw[w["start"] : w["start"] + w["count"] - 1 + length] for w in own]
                    off = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
                    row, start, count, key, what, several = chunks(np.concatenate(pieces), off, length, gram)
                    first = np.array([w["start"] for w in own])[row] + start
                    key = mix(np.array([w["key"] for w in own], np.int64).view(np.uint64)[row] + mix(key))
                    n = len(row)
                    yield pa.RecordBatch.from_arrays([pa.array([d.as_py()] * n, pa.int64()), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(what.view(np.int64)), pa.array(several)], names=["doc_id", "start", "count", "key", "own", "several"])

    return run
