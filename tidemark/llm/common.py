"""What the corpus operators share: shared scratch tables, component labels, vectorised text splitting."""

from __future__ import annotations

import gc
import uuid
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship

#: Text handled at once inside a Python worker; bounds the numpy temporaries, not the texts (one text may exceed it).
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset one of our own, on a local master only."""
    return shared_folder(spark)


_scratch: dict[str, str] = {}
_written = 0
#: Bytes written between two collections of the driver's garbage.
COLLECT = 16 << 20


def _collect(spark: SparkSession, path: str) -> None:
    """The shuffle files of what is now written go with the driver's garbage: not later than after COLLECT bytes."""
    global _written
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _written += p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    if _written >= COLLECT:
        _written = 0
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str, scratch: bool = True) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and survives lost executors.

    Scratch tables are only needed until the results that read them are written; see ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _collect(spark, path)
    if scratch:
        _scratch[path] = spark.sparkContext.applicationId
    back = spark.read.schema(df.schema).parquet(path)
    back._tidemark_path = path
    return back


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        if _scratch.pop(path, None):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of this application. Only call it when every result made so far has been written."""
    own = spark.sparkContext.applicationId
    drop(spark, *[p for p, app in _scratch.items() if app == own])


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, or the first longer one that is no column of the frames (in any case)."""
    have = {c.lower() for f in frames for c in f.columns}
    while name.lower() in have:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only, with null texts empty."""
    ship(docs.sparkSession)
    return docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def one_text_each(t: DataFrame) -> DataFrame:
    """One row per doc_id (as long): of rows that share one, the text that sorts last; rows without a doc_id stay."""
    t = t.select(t["doc_id"].cast("long").alias("doc_id"), "text")
    ids = t.where("doc_id is not null").select("doc_id")
    if ids.groupBy("doc_id").count().where("count > 1").limit(1).count() == 0:
        return t
    return t.where("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text")).unionByName(t.where("doc_id is null"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, component), component the smallest node reachable.

    Alternating large-star and small-star steps: each is one shuffle of at most the edge count, and no node
    gathers its component. The joins are on a key that the minima are not dealt by, so both sides are dealt for the join
    alone and adaptive execution can split a hub. Every step is a table in the shared folder. Self-loops keep single nodes.
    """
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = stored(both, "cc")
    for _ in range(rounds):
        # large star: every neighbour above u goes to the smallest node around u
        sym = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("w"), F.least("u", "m").alias("m"))
        large = sym.withColumn("w", F.bitwise_not("u")).join(low, "w").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(now.where("u = v")).distinct()
        # small star: u and its lower neighbours go to the lowest of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("w"), "m")
        small = large.withColumn("w", F.bitwise_not("u")).join(low, "w").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").distinct()
        new = stored(small, "cc")
        same = not _differ(now, new)
        drop(edges.sparkSession, now._tidemark_path)
        now = new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _differ(x: DataFrame, y: DataFrame) -> bool:
    sig = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(sig(x)) != tuple(sig(y))


# ---------------------------------------------------------------- vectorised words

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n (n rounded up, kept)."""
    have = _powers.__dict__.setdefault("kept", [np.empty(0, np.uint64), np.empty(0, np.uint64)])
    if len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        for k, base in enumerate((_P, inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            have[k] = np.multiply.accumulate(x)
    return have[0][:n], have[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of (byte + 1) * P^position over [i, j), modulo 2^64; length len(data) + 1.

    For windows of a fixed length that meet in sorting and are compared byte by byte afterwards; see ``digests`` for
    hashes that stand for the bytes."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data))[0], out=out[1:])
    return out


#: Spans beyond this many bytes are hashed one by one.
LONG = 256
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, both: bool = False):
    """64-bit hashes of the bytes of each [start, end), not empty; with ``both`` a pair of them, 128 bits together.

    Eight bytes at a time are folded in and mixed, so no string has an algebraic twin. The pair is exact for spans of
    up to eight bytes: the bytes themselves, and a hash that holds the length.
    """
    size = end - start
    held = np.zeros(len(data) + 8, np.uint8)
    held[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer=held.data, strides=(1,))
    x = lanes[start] & _KEEP[np.minimum(size, 8)]
    h = mix(x ^ (size.astype(np.uint64) * _M1))
    g = x.copy() if both else None
    left = np.flatnonzero(size > 8)
    if len(left):
        big = left[size[left] > LONG]
        left = left[size[left] <= LONG]
        k = 8
        while len(left):
            x = lanes[start[left] + k] & _KEEP[np.minimum(size[left] - k, 8)]
            h[left] = mix((h[left] * _P) ^ x)
            if both:
                g[left] = mix((g[left] + x) * _M2)
            k += 8
            left = left[size[left] > k]
        for i, a, z in zip(big.tolist(), start[big].tolist(), end[big].tolist()):
            own = np.frombuffer(blake2b(data[a:z].tobytes(), digest_size=16).digest(), "<u8")
            h[i] = own[0]
            if both:
                g[i] = own[1]
    return (h, g) if both else h


def slices(column, size: int = 0) -> "list[tuple[int, int, np.ndarray, np.ndarray]]":
    """Cut an Arrow string column into runs of rows of about ``size`` (SLICE_BYTES) bytes: (first row, last row, bytes, offsets from 0)."""
    import pyarrow as pa

    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + (size or SLICE_BYTES), "right")) - 1)
        last = min(last, n)
        yield first, last, data[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, lower: np.ndarray, inside: np.ndarray, spans: bool = False):
    """Words of concatenated texts. lower: byte map; inside: which mapped bytes are word bytes.

    Returns (row, hash) of every word in order, with ``spans`` also its byte range; words never cross texts.
    """
    data = lower[data]
    isin = inside[data]
    edge = np.zeros(len(data) + 1, bool)  # a text starts here
    edge[offsets[:-1]] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = isin[:-1]
    start = np.flatnonzero(isin & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    if len(data):
        after[:-1] = isin[1:]
    end = np.flatnonzero(isin & (~after | edge[1:])) + 1
    h = digests(data, start, end)
    row = np.searchsorted(offsets, start, "right") - 1
    return (row, h, start, end) if spans else (row, h)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
