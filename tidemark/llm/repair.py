"""Token ids in grammar-compressed shards: Re-Pair per shard, with expansion lengths for random-access decoding.

A shard is one binary value: a header, the rules (left, right, expansion length of every nonterminal), the start of
each document in the compressed sequence and in the ids, the doc_ids and the compressed sequence. Rules never cross
documents, so one document is decoded from its own slice. Shards are rows of a table that Spark writes and reads in
the shared folder; its files, and the shards in them, follow each other by (bucket, seq), and ids run in ascending
doc_id order, null doc_ids first. Rows without a doc_id, or of one doc_id that fills several ranges, follow each other
in no set order.

Each round counts adjacent pairs, takes of the frequent ones, the most frequent first, those of which no id is the left
part of one and the right part of another (see ``_compatible``), and replaces all their occurrences from left to right (every second one in
a run of equal ids). Rounds go on until no pair inside a document occurs ``min_count`` times. Null texts are empty and
hold the end id only. Rows that repeat are written each. Extra columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import struct
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, digests, slices, stored, texts

MAGIC = b"TMRP2\0"
SHARD_TOKENS = 1_500_000
#: Pieces a worker keeps, and the places of their table.
CACHE_WORDS, _PLACES = 1_000_000, 1 << 22
#: A pair is frequent from this count in a shard on.
MIN_COUNT = 8
#: How often a round looks at the pairs that wait.
PASSES = 8
_BITS = 20
_loaded: dict[str, tuple] = {}


# ---------------------------------------------------------------- ids


class WordCoder:
    """Encodes by the tokenizers library, each distinct piece once while it stays in a bounded cache.

    Texts are cut at ASCII white space, which the tokenizer drops, and between letters (ASCII and U+00C0 to U+00FF), ASCII
    digits and ASCII punctuation other than the apostrophe, where its splitting pattern always ends a match; A-Z are
    lower-cased as its normaliser would. A text's ids are those of its pieces in order. The strings of special tokens, which the library looks for in
    the text as written, are pieces of their own. Pieces are told apart by 128 bits (see ``digests``).
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.of.encode_special_tokens = True  # their strings never reach it as such
        added = {t.content.encode(): i for i, t in self.of.get_added_tokens_decoder().items()}
        self.special = sorted(added, key=len, reverse=True)
        self.special_id = [added[x] for x in self.special]
        self.pattern = re.compile(b"|".join(map(re.escape, self.special))) if added else None
        self.tokenize = self.of.model.tokenize  # looked up once: each look-up makes a new model object
        self.digit = {c: [t.id for t in self.tokenize(chr(c))] for c in range(48, 58)}
        self.clear()

    def clear(self) -> None:
        self.place = np.full(_PLACES, -1, np.int32)
        self.n, self.n_pool = 0, 0
        self.h, self.g = np.empty(1 << 16, np.uint64), np.empty(1 << 16, np.uint64)
        self.first, self.size, self.begin = np.empty(1 << 16, np.uint32), np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.pool = np.empty(1 << 16, np.uint32)

    def _ids(self, w: bytes) -> list[int]:
        if w.isascii():
            if w.isalpha() or _PUNCT.issuperset(w):
                return [t.id for t in self.tokenize(w.decode())]
            if w.isdigit():
                return [i for c in w for i in self.digit[c]]
        elif w[0] >= _SPECIAL:
            return [self.special_id[w[0] - _SPECIAL]]
        elif (x := w.decode()).isalpha() and max(x) <= "\xff":
            return [t.id for t in self.tokenize(x.lower().encode().decode("latin-1").translate(_SHOWN))]
        return self.of.encode(w.decode(), add_special_tokens=False).ids

    def learn(self, h: np.ndarray, g: np.ndarray, new: list[bytes]) -> None:
        ids = list(map(self._ids, new))
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        begin = np.cumsum(size) - size
        entry = np.arange(self.n, self.n + len(ids))
        first = np.zeros(len(ids), np.uint32)
        first[size > 0] = flat[begin[size > 0]]
        for name, x in (("h", h), ("g", g), ("first", first), ("size", size), ("begin", begin + self.n_pool)):
            setattr(self, name, _put(getattr(self, name), self.n, x))
        self.pool = _put(self.pool, self.n_pool, flat)
        self.n, self.n_pool = self.n + len(ids), self.n_pool + len(flat)
        at = (h >> np.uint64(40)).astype(np.int64) & (_PLACES - 1)
        while len(entry):  # the first of those that want a free place gets it, the rest go on to the next one
            free = np.flatnonzero(self.place[at] < 0)
            self.place[at[free[::-1]]] = entry[free[::-1]]
            left = self.place[at] != entry
            entry, at = entry[left], (at[left] + 1) & (_PLACES - 1)

    def look_up(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Entry of each piece, -1 where it is not known."""
        at = (h >> np.uint64(40)).astype(np.int64) & (_PLACES - 1)
        out = self.place[at]
        todo = np.flatnonzero((out >= 0) & ((self.h[out] != h) | (self.g[out] != g)))
        while len(todo):
            at[todo] = (at[todo] + 1) & (_PLACES - 1)
            e = out[todo] = self.place[at[todo]]
            todo = todo[(e >= 0) & ((self.h[e] != h[todo]) | (self.g[e] != g[todo]))]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids with the end id after each text, number of ids of each text) of concatenated texts."""
        low = LOWER[data]
        kind = _KIND[low]
        at = np.flatnonzero(low == 0xC3)  # the letters from U+00C0 to U+00FF are letters like the ASCII ones
        at = at[(low[at + 1] != 0x97) & (low[at + 1] != 0xB7)]
        kind[at] = kind[at + 1] = 1
        self._mark_special(data, offsets, low, kind)
        n = len(offsets) - 1
        if len(data):
            cut = np.empty(len(data) + 1, bool)
            cut[0] = cut[-1] = True
            cut[1:-1] = _TURN[(kind[:-1] << 3) | kind[1:]]
            cut[offsets] = True
            first = np.flatnonzero(cut)
            end = first[1:]
            first = first[:-1]
            full = kind[first] > 0
            first, end = first[full], end[full]
        else:
            first = end = np.empty(0, np.int64)
        h, g = digests(low, first, end, both=True)
        entry = self.look_up(h, g)
        while len(new := np.flatnonzero(entry < 0)):
            _, where = np.unique(h[new], return_index=True)
            if self.n and self.n + len(where) > CACHE_WORDS:
                self.clear()
                entry[:] = -1
                continue
            w = new[where]
            raw = low.tobytes()
            self.learn(h[w], g[w], [raw[i:j] for i, j in zip(first[w].tolist(), end[w].tolist())])
            entry[new] = self.look_up(h[new], g[new])
        size = self.size[entry]
        total = np.concatenate([[0], np.cumsum(size)])
        count = np.searchsorted(first, offsets)  # pieces before each text
        per = np.diff(total[count]) + 1
        out = np.full(int(per.sum()), end_id, np.uint32)
        pos = total[:-1] + np.repeat(np.arange(n), np.diff(count))
        one = size == 1
        out[pos[one]] = self.first[entry[one]]
        many = np.flatnonzero(size > 1)
        where = expand(size[many])
        out[np.repeat(pos[many], size[many]) + where] = self.pool[np.repeat(self.begin[entry[many]], size[many]) + where]
        return out, per

    def _mark_special(self, data: np.ndarray, offsets: np.ndarray, low: np.ndarray, kind: np.ndarray) -> None:
        """Write the strings of special tokens over with bytes that no text has, in turn of two kinds."""
        raw = data.tobytes()
        if self.pattern is None or not any(x in raw for x in self.special):
            return
        for k, m in enumerate(self.pattern.finditer(raw)):
            a, z = m.span()
            if np.searchsorted(offsets, a, "right") == np.searchsorted(offsets, z, "left"):  # inside one text
                low[a:z] = _SPECIAL + self.special.index(m[0])
                kind[a:z] = 4 + k % 2


def _put(x: np.ndarray, n: int, new: np.ndarray) -> np.ndarray:
    """``x`` with ``new`` from place n on, grown by doubling."""
    if n + len(new) > len(x):
        x = np.concatenate([x[:n], np.empty(max(n, len(new)) + len(new), x.dtype)])
    x[n : n + len(new)] = new
    return x


#: The first byte value that UTF-8 never has.
_SPECIAL = 0xF8
#: How byte-level tokens write the bytes that are not printable in Latin-1.
_SHOWN = {c: chr(256 + k) for k, c in enumerate(c for c in range(256) if not (33 <= c < 127 or 161 <= c < 173 or c >= 174))}
#: 0 white space, 1 letters, 2 ASCII digits, 3 ASCII punctuation but the apostrophe, 4 and 5 special tokens, 7 anything else.
_KIND = np.full(256, 7, np.uint8)
_KIND[[32, 9, 10, 13]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_PUNCT = frozenset(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_KIND[list(_PUNCT)] = 3
_TURN = np.array([[a != b and (7 not in (a, b) or not {a, b}.isdisjoint({0, 4, 5})) for b in range(8)] for a in range(8)]).ravel()


def expand(lens: np.ndarray) -> np.ndarray:
    """0, 1, .., n-1 for each n of lens, one after the other."""
    total = int(lens.sum())
    if not total:
        return np.empty(0, np.int64)
    return np.arange(total) - np.repeat(np.cumsum(lens) - lens, lens)


# ---------------------------------------------------------------- grammar


def compress(ids: np.ndarray, doc_starts: np.ndarray, base: int, min_count: int = MIN_COUNT):
    """(sequence, starts of documents in it, left, right): the grammar of a shard. Nonterminals are base, base + 1, ...
    No pair inside a document is left that occurs ``min_count`` times."""
    x = ids.astype(np.uint32)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    nxt = base
    # ids that went stay where they are: each of the others knows the next one and the one before
    after, before = np.arange(1, len(x) + 1), np.arange(-1, len(x) - 1)
    live, look = np.ones(len(x), bool), np.zeros(len(x), bool)
    last = np.zeros(len(x), bool)  # no pair begins here: the last ids of documents
    last[doc_starts[doc_starts > 0] - 1] = True
    last[-1:] = True
    # where a frequent pair can begin: a pair's occurrences never get more, so what was rare once is not looked at again
    sel = np.flatnonzero(~last)
    while len(sel):
        a, b = x[sel], x[after[sel]]
        bits = min(_BITS, max(8, len(sel).bit_length()))
        slot = _slots(a, b, bits)
        heavy = np.bincount(slot, minlength=1 << bits) >= min_count
        stay = np.flatnonzero(heavy[slot])
        sel, slot = sel[stay], slot[stay]
        if not len(sel):
            break
        pair = (a[stay].astype(np.uint64) << np.uint64(32)) | b[stay]
        # exact counts of the pairs that share a heavy slot, from the most frequent slots' keys
        ks = np.sort(pair)
        first = np.flatnonzero(np.concatenate([[True], ks[1:] != ks[:-1]]))
        n = np.diff(np.append(first, len(ks)))
        keep = n >= min_count
        uniq, n = ks[first[keep]], n[keep]
        if not len(uniq):
            break
        order = np.argsort(-n, kind="stable")
        uniq = uniq[order]
        lhs, rhs = (uniq >> np.uint64(32)).astype(np.int64), (uniq & np.uint64(0xFFFFFFFF)).astype(np.int64)
        slots = _slots(lhs.astype(np.uint32), rhs.astype(np.uint32), bits)
        picked = _compatible(lhs, rhs)
        picked = picked[np.sort(np.unique(slots[picked], return_index=True)[1])]  # one of a slot
        rule_of = np.full(1 << bits, -1, np.int64)
        rule_of[slots[picked]] = np.arange(len(picked))
        rule_key = uniq[picked]
        r = rule_of[slot]
        hit = np.flatnonzero((r >= 0) & (rule_key[r] == pair))
        at, r = sel[hit], r[hit]
        if len(at):  # in a run of equal ids, only every second pair
            new = np.concatenate([[True], after[at[:-1]] != at[1:]])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            even = np.flatnonzero((np.arange(len(at)) - begin) % 2 == 0)
            at, r = at[even], r[even]
        gone = after[at]
        x[at] = (nxt + r).astype(np.uint32)
        last[at] = last[gone]
        behind = after[gone]
        after[at] = behind
        inner = behind < len(x)
        before[behind[inner]] = at[inner]
        live[gone] = False
        # the pairs that were frequent, and those around a new id
        ahead = before[at]
        look[sel] = True
        look[ahead[ahead >= 0]] = True
        look[gone] = False
        sel = np.flatnonzero(look)
        look[sel] = False
        sel = sel[~last[sel]]
        left.append(lhs[picked])
        right.append(rhs[picked])
        nxt += len(picked)
    cat = lambda y: np.concatenate(y) if y else np.empty(0, np.int64)
    return x[live], np.concatenate([[0], np.cumsum(live)])[doc_starts], cat(left), cat(right)


def _compatible(lhs: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Places, ascending, of pairs that can be replaced together: no id is the left part of one and the right
    part of another, and the id of a pair of equals is in no other pair. The first pair is always among them.

    An id takes the side that it has in its first pair; pairs whose ids have other sides wait, and are looked at again as
    long as nothing that was taken speaks against them, PASSES times at most (the next round has the rest).
    """
    kinds, ids = np.unique(np.concatenate([lhs, rhs]), return_inverse=True)
    n = len(kinds)
    lhs, rhs = ids[: len(lhs)], ids[len(lhs) :]
    side = np.zeros(n, np.int8)  # 1 left, 2 right, 3 both, 0 open
    todo, out = np.arange(len(lhs)), []
    for _ in range(PASSES):
        a, b = lhs[todo], rhs[todo]
        at = np.arange(len(todo))[::-1]
        first = np.full((2, n), len(todo))
        first[0, a[::-1]] = at  # of an id's pairs the first is written last
        first[1, b[::-1]] = at
        own = np.where(side > 0, side, np.where(first[0] < first[1], 1, np.where(first[0] > first[1], 2, 3)))
        ok = np.where(a == b, own[a] == 3, (own[a] == 1) & (own[b] == 2))
        side[a[ok]], side[b[ok]] = own[a[ok]], own[b[ok]]
        out.append(todo[ok])
        todo = todo[~ok & ((side[a] | 1) == 1) & ((side[b] | 2) == 2) & ((a != b) | (side[a] == 0))]
        if not len(todo):
            break
    return np.sort(np.concatenate(out))


def _slots(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """A slot of 2^bits for each pair."""
    return (((a * np.uint32(0x9E3779B1) ^ b) * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)).astype(np.int64)


def _layers(left: np.ndarray, right: np.ndarray, base: int):
    """(first, end) of runs of rules, in order, whose parts all come before the run."""
    part = np.maximum(left, right).astype(np.int64) - base
    first = 0
    while first < len(part):
        own = np.flatnonzero(part[first:] >= first)
        end = first + int(own[0]) if len(own) else len(part)
        yield first, end
        first = end


def lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Expansion length of every rule; parts come before the rules that use them."""
    out = np.ones(len(left) + 1, np.int64)  # the last one: of an id
    for a, z in _layers(left, right, base):
        x, y = (np.where(p[a:z] < base, len(left), p[a:z].astype(np.int64) - base) for p in (left, right))
        out[a:z] = out[x] + out[y]
    return out[:-1].astype(np.uint32)


def pack(doc_ids: list, ids: np.ndarray, per: np.ndarray, base: int) -> bytes:
    """One shard: header and zlib-packed arrays."""
    starts = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
    seq, at, left, right = compress(ids, starts, base)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    nums = np.array([x if x is not None else 0 for x in doc_ids], np.int64)
    parts = [left.astype("<u4"), right.astype("<u4"), lengths(left, right, base).astype("<u4"), at.astype("<i8"), starts.astype("<i8"), known, nums.astype("<i8")]
    # the sequence: sixteen bits a symbol, and a plane for each further bit that the symbols need
    planes = max(0, (base + len(left) - 1).bit_length() - 16)
    blobs = [zlib.compress(p.tobytes(), 1) for p in parts]
    blobs += [seq.astype("<u2").tobytes(), b"".join(np.packbits((seq >> (16 + k)).astype(np.uint8) & 1).tobytes() for k in range(planes))]
    return MAGIC + struct.pack("<IBII9Q", base, planes, len(per), len(left), *map(len, blobs)) + b"".join(blobs)


class Shard:
    """Reads a shard; ``ids(k)`` decodes one document, ``all_ids()`` the whole shard."""

    def __init__(self, blob: bytes):
        if blob[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard")
        head = struct.calcsize("<IBII9Q")
        self.base, planes, self.n, _, *sizes = struct.unpack_from("<IBII9Q", blob, len(MAGIC))
        pos, parts = len(MAGIC) + head, []
        for k, s in enumerate(sizes):
            raw = blob[pos : pos + s]
            parts.append(zlib.decompress(raw) if k < 7 else raw)
            pos += s
        kinds = ["<u4", "<u4", "<u4", "<i8", "<i8", "u1", "<i8", "<u2", "u1"]
        self.left, self.right, self.lens, self.at, self.starts, known, nums, low, high = (np.frombuffer(p, k) for p, k in zip(parts, kinds))
        self.seq = low.astype(np.uint32)
        for k in range(planes):
            width = len(high) // planes
            self.seq |= np.unpackbits(high[k * width : (k + 1) * width], count=len(low)).astype(np.uint32) << np.uint32(16 + k)
        self.doc_ids = [int(x) if k else None for x, k in zip(nums, known)]
        self._pool: np.ndarray | None = None

    def pool(self) -> np.ndarray:
        """Expansions of all terminals that stand alone are implicit; those of the rules, one after the other."""
        if self._pool is None:
            lens = self.lens.astype(np.int64)
            self._from = np.concatenate([[0], np.cumsum(lens)])
            flat = np.empty(int(lens.sum()), np.uint32)
            for first, end in _layers(self.left, self.right, self.base):
                at = self._from[first:end]
                for part in (self.left[first:end].astype(np.int64), self.right[first:end].astype(np.int64)):
                    rule = part >= self.base
                    flat[at[~rule]] = part[~rule]
                    k = part[rule] - self.base
                    inner = expand(lens[k])
                    flat[np.repeat(at[rule], lens[k]) + inner] = flat[np.repeat(self._from[k], lens[k]) + inner]
                    size = np.ones(len(part), np.int64)
                    size[rule] = lens[k]
                    at = at + size
            self._pool = flat
        return self._pool

    def _expanded(self, seq: np.ndarray) -> np.ndarray:
        pool = self.pool()
        s = seq.astype(np.int64)
        rule = s >= self.base
        k = np.where(rule, s - self.base, 0)
        if not len(pool):
            return s.astype(np.uint32)
        lens = np.where(rule, self.lens[k].astype(np.int64), 1)
        begin = np.where(rule, self._from[k], 0)
        where = expand(lens)
        out = pool[np.repeat(begin, lens) + where]
        at = np.cumsum(lens) - lens
        out[at[~rule]] = s[~rule]
        return out

    def ids(self, k: int) -> np.ndarray:
        return self._expanded(self.seq[self.at[k] : self.at[k + 1]])

    def all_ids(self) -> np.ndarray:
        return self._expanded(self.seq)


# ---------------------------------------------------------------- Spark


def write_shards(docs: DataFrame, path: str, end_id: int = 1, vocab: int = 49_408, shard_tokens: int = SHARD_TOKENS, parts: int | None = None) -> DataFrame:
    """Encode, order by doc_id and write the shards; returns the written table (bucket, seq, n_docs, n_tokens, payload).

    Ids are dealt by doc_id into ranges found from the doc_ids alone, so the texts are encoded once and only ids, not
    texts, are shuffled. Rows without a doc_id are dealt over as many ranges as their share; a doc_id that fills several
    ranges is dealt over these.
    """
    spark = docs.sparkSession
    t = texts(docs)
    t = t.select(t["doc_id"].cast("long").alias("doc_id"), "text")
    n = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows, known = t.agg(F.count("*"), F.count("doc_id")).first()
    blank = -(-n * (rows - known) // rows) if rows > known else 0
    ranges = max(1, n - blank)
    cuts = t.where("doc_id is not null").select("doc_id").approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.2 / ranges) if ranges > 1 and known else []
    cuts = sorted(int(c) for c in cuts)
    wide = vocab > 1 << 16

    def ids_of(batches):
        import pyarrow as pa

        if path not in _loaded:
            _loaded[path] = WordCoder(path)
        coder = _loaded[path]
        at, done = np.array(cuts, np.int64), 0
        for b in batches:
            for first, last, data, off in slices(b.column(1), 2 << 20):
                own = b.column(0).slice(first, last - first)
                flat, per = coder.encode(data, off, end_id)
                raw = flat.astype("<u4" if wide else "<u2")
                ends = np.concatenate([[0], np.cumsum(per)]) * raw.itemsize
                blobs = pa.Array.from_buffers(pa.binary(), len(per), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
                ids = own.fill_null(0).to_numpy(zero_copy_only=False)
                turn = np.arange(done, done + len(per))
                done += len(per)
                low, high = np.searchsorted(at, ids, "left"), np.searchsorted(at, ids, "right")
                bucket = blank + np.where(high - low > 1, low + 1 + turn % np.maximum(high - low, 1), high)
                if own.null_count:
                    bucket = np.where(own.is_null().to_numpy(zero_copy_only=False), turn % max(blank, 1), bucket)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), own, blobs], names=["bucket", "doc_id", "ids"])

    coded = t.mapInArrow(ids_of, "bucket int, doc_id long, ids binary")
    # by the bucket itself, so the files follow each other in its order
    dealt = coded.repartitionById(blank + ranges, "bucket").sortWithinPartitions("bucket", "doc_id", "ids")

    def shards_of(batches):
        import pyarrow as pa

        bucket, seq, docs_, ids, held = None, 0, [], [], 0

        def out():
            flat = np.concatenate([np.frombuffer(x, "<u4" if wide else "<u2") for x in ids]).astype(np.uint32)
            per = np.array([len(x) // (4 if wide else 2) for x in ids], np.int64)
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([pack(docs_, flat, per, vocab)], pa.binary())], names=["bucket", "seq", "n_docs", "n_tokens", "payload"])

        for b in batches:
            for k, d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if ids and (k != bucket or held >= shard_tokens):
                    yield out()
                    seq, docs_, ids, held = (seq + 1 if k == bucket else 0), [], [], 0
                bucket = k
                x = x.as_py()
                docs_.append(d)
                ids.append(x)
                held += len(x) // (4 if wide else 2)
        if ids:
            yield out()

    return stored(dealt.mapInArrow(shards_of, "bucket int, seq long, n_docs long, n_tokens long, payload binary"), "repair")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the written shards."""
    from pyspark.sql import Window as W

    per = shards.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
    # one row per range, whose number is the number of partitions
    base = per.select("bucket", (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("bucket_start"))
    inner = shards.select("bucket", "seq", (F.sum("n_tokens").over(W.partitionBy("bucket").orderBy("seq")) - F.col("n_tokens")).alias("seq_start"))

    def decoded(batches):
        import pyarrow as pa

        for b in batches:
            for bucket, seq, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                s = Shard(blob.as_py())
                ids = s.all_ids().astype("<u4")
                n = s.n
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(s.starts[:-1].tolist(), s.starts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * n, pa.int32()), pa.array([seq] * n, pa.int64()), pa.array(s.doc_ids, pa.int64()), pa.array(s.starts[:-1]), pa.array(np.diff(s.starts)), pa.array(crc, pa.int64())], names=["bucket", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    rows = shards.select("bucket", "seq", "payload").mapInArrow(decoded, "bucket int, seq long, doc_id long, local long, n_tokens long, ids_crc32 long")
    starts = inner.join(base, "bucket").select("bucket", "seq", (F.col("seq_start") + F.col("bucket_start")).alias("shard_start"))
    return rows.join(starts, ["bucket", "seq"]).select("doc_id", (F.col("local") + F.col("shard_start")).cast("long").alias("start"), "n_tokens", "ids_crc32")
