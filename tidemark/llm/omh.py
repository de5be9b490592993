"""Order MinHash fingerprints, in DataFrame expressions only.

A text is a sequence of words (runs of anything but ASCII white space); its k-mers are the k words from each word on,
padded at the end, numbered by occurrence. Each numbered k-mer is hashed; the hash deals it to one of ``tuples`` tuples
and to one of the ``LENGTH`` places of its class in it, where the minimal hash is selected. The selected k-mers of a
tuple are put in the order they have in the text, and the tuple is hashed in that order. The likeness of two
fingerprints is the share of equal tuples among those that are not empty in both, to the power 1 / LENGTH: it falls
with edits and with changes of order alike. Equal texts have equal fingerprints; two without words are alike.

Documents follow each other by doc_id (null first), then a hash of the text, then the text. They are dealt into ranges
of that order, one task each, so that a text meets the next one with a single shuffle; the first text of each range also
goes to the range before it. Documents without a doc_id, and those of a doc_id that fills several ranges, are dealt over
as many ranges as their share; equal texts among these stay together. Occurrences are numbered, minima taken and
fingerprints gathered within those ranges. Places are kept in 26 bits: of words beyond 67 million in one text the order
among equal minima is lost.

Null texts are empty. Rows that repeat or share a doc_id are documents of their own, one after the other. Extra columns
are not read. An empty table gives an empty table; a single document is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

K, TUPLES, LENGTH = 2, 32, 2
_GAP, _WHITE = r"[\x20\x09-\x0D]++", " \t\n\x0b\x0c\r"


def _below(x: Column, cuts: list[int], upto: bool) -> Column:
    """How many of the ascending cuts are below x, with ``upto`` at most x; looked up in runs, not one by one."""
    if not cuts:
        return F.lit(0)
    held = lambda v: F.split(F.lit(",".join(map(str, v))), ",").cast("array<bigint>")
    n = lambda v: F.size(F.filter(v, lambda c: c <= x if upto else c < x))
    run = max(1, int(len(cuts) ** 0.5))
    top = n(held(cuts[::run]))
    return F.when(top == 0, 0).otherwise((top - 1) * run + n(F.slice(held(cuts), (top - 1) * run + 1, F.lit(run))))


def follow(docs: DataFrame, parts: int) -> DataFrame:
    """(bucket, no, doc_id, text, next): each document with the text that follows it."""
    t = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    rows, known = t.agg(F.count("*"), F.count("doc_id")).first()
    blank = -(-parts * (rows - known) // rows) if rows > known else 0
    ranges = max(1, parts - blank)
    cuts = t.where("doc_id is not null").approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.2 / ranges) if ranges > 1 and known else []
    cuts = sorted(int(c) for c in cuts)
    t = t.withColumn("tie", F.pmod(F.xxhash64("text"), F.lit(1 << 30)))
    share = lambda n: F.shiftright(F.col("tie") * n, 30).cast("int")
    t = t.withColumn("low", _below(F.col("doc_id"), cuts, False)).withColumn("high", _below(F.col("doc_id"), cuts, True))
    several = F.col("high") - F.col("low")
    bucket = F.when(F.col("doc_id").isNull(), share(F.lit(blank))).when(several > 1, F.col("low") + 1 + share(several) + blank).otherwise(F.col("high") + blank).cast("int")
    # never null, and typed so: else the joins below filter one side before it is dealt, and the texts are dealt twice
    t = t.withColumn("bucket", F.coalesce(bucket, F.lit(0))).select("bucket", "doc_id", "tie", "text")
    # the first text of each range, one row per range, also goes to the end of the range before it
    first = t.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("f"))
    ring = W.orderBy("bucket")
    first = first.select(F.col("bucket").alias("own"), F.coalesce(F.lag("bucket").over(ring), F.last("bucket").over(ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit(0)).alias("to"), "f")
    heads = t.join(F.broadcast(first), (F.col("bucket") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("tie") == F.col("f.tie"))).groupBy("to").agg(F.min("text").alias("text"))
    null = F.lit(None).cast("long")
    both = t.withColumn("extra", F.lit(0)).unionByName(heads.select(F.col("to").alias("bucket"), null.alias("doc_id"), null.alias("tie"), "text", F.lit(1).alias("extra")))
    order = W.partitionBy("bucket").orderBy("extra", F.col("doc_id").asc_nulls_first(), "tie", "text")
    dealt = both.repartitionById(blank + ranges, "bucket").withColumn("no", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
    return dealt.where("extra = 0").select("bucket", "no", "doc_id", "text", "next")


def edited(text: Column, nxt: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(nxt, half))


def sketches(rows: DataFrame, keys: list[str], text: str, k: int = K, tuples: int = TUPLES) -> DataFrame:
    """(keys, fingerprint as array<bigint>) of every row with words, where rows are already dealt by the first of ``keys``."""
    bare = F.btrim(F.col(text), F.lit(_WHITE))
    w = rows.select(*keys, F.when(bare != "", F.split(bare, _GAP)).alias("w")).where("w is not null")
    shifted = [F.col("w").alias("w0"), *(F.slice("w", F.lit(i + 1), F.greatest(F.size("w") - i, F.lit(0))).alias(f"w{i}") for i in range(1, k))]
    e = w.select(*keys, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "m")).select(*keys, "pos", F.xxhash64(*(F.col(f"m.w{i}") for i in range(k))).alias("kmer"))
    # one window per text, not one per k-mer: places among equal k-mers are row numbers less ranks
    every = W.partitionBy(*keys)
    occurrence = F.row_number().over(every.orderBy("kmer", "pos")) - F.rank().over(every.orderBy("kmer")) + 1
    h = e.select(*keys, "pos", F.xxhash64("kmer", occurrence).alias("h"))
    stratum = F.pmod("h", F.lit(tuples * LENGTH)).cast("int")
    # 38 bits of the hash above 26 bits of the place: one number, so the minimum is a plain aggregate
    packed = F.shiftleft(F.shiftrightunsigned("h", 26), 26).bitwiseOR(F.col("pos").cast("long"))
    low = h.groupBy(*keys, stratum.alias("stratum")).agg(F.min(packed).alias("low"))
    mask = F.lit((1 << 26) - 1).cast("long")
    one = F.struct(F.floor(F.col("stratum") / LENGTH).cast("int").alias("tuple"), F.col("low").bitwiseAND(mask).alias("pos"), F.shiftrightunsigned("low", 26).alias("h"), "stratum")
    got = low.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("s"))
    fold = lambda x, j: F.aggregate(F.filter(x, lambda y: y["tuple"] == j), F.lit(0).cast("long"), lambda a, y: F.xxhash64(a, y["h"], y["stratum"]))
    return got.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(tuples - 1)), lambda j: fold(F.col("s"), j)).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    used = F.filter(both, lambda x: (x["a"] != 0) | (x["b"] != 0))
    same = F.size(F.filter(used, lambda x: x["a"] == x["b"]))
    return F.when(F.size(used) == 0, F.lit(1.0)).otherwise(F.pow(same / F.size(used), F.lit(1.0 / LENGTH)))


def compare(docs: DataFrame, k: int = K, tuples: int = TUPLES, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    spark = docs.sparkSession
    parts = parts or 8 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    f = follow(docs, parts).withColumn("edited", edited(F.col("text"), F.col("next")))
    info = f.select("bucket", "no", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    both = f.select("bucket", "no", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("x")).select("bucket", "no", "x.which", "x.t")
    s = sketches(both, ["bucket", "no", "which"], "t", k, tuples)
    empty = F.array_repeat(F.lit(0).cast("long"), tuples)
    pair = s.groupBy("bucket", "no").agg(F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    d = info.join(pair, ["bucket", "no"], "left").withColumn("fingerprint", F.coalesce("fingerprint", empty)).withColumn("edited_fingerprint", F.coalesce("edited_fingerprint", empty))
    d = stored(d, "omh")
    order = W.partitionBy("bucket").orderBy("no")
    ring = W.orderBy("bucket")
    heads = d.where("no = 1").select("bucket", F.col("fingerprint").alias("head"))
    heads = heads.select("bucket", F.coalesce(F.lead("head").over(ring), F.first("head").over(ring)).alias("after"))
    d = d.withColumn("next", F.lead("fingerprint").over(order)).join(heads, "bucket").withColumn("next", F.coalesce("next", "after"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")
    return d.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text("fingerprint").alias("fingerprint"),
        text("edited_fingerprint").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )
