"""Secret scans: fixed patterns, and character Markov models for what they miss; DataFrame expressions only.

Base spans are the leftmost non-overlapping matches of each kind (see ``BASE``). The models are two first-order chains
over the characters of random strings and of ordinary identifiers, counted on labelled samples and smoothed by single
characters. A candidate (a run of at least ``least`` characters of ``[A-Za-z0-9+/_=-]`` with a letter and a digit) whose log-likelihood ratio per
step exceeds ``threshold`` is one more span, of kind ``markov``, unless it overlaps a base span.

Null texts are empty and have no spans. Rows that repeat, tie or have null doc_ids are scanned each for itself. Extra
columns pass through ``scan`` and ``redact``; a column named like a result of ``scan`` is replaced. An empty table gives an empty
table, and without samples of a label its chain is uniform.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import free_name

#: Kinds and patterns.
BASE = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"[0-9a-f]++",
}
CANDIDATE = r"[A-Za-z0-9+/_=-]++"
LEAST, THRESHOLD = 20, 0.6
#: Weight of the single-character distribution in each step's.
PRIOR = 8.0
_SIZE = 128


def base_spans(text: Column) -> Column:
    """All base spans, by start, then kind as listed."""
    order = {k: i for i, k in enumerate(BASE)}
    # a hex run of 24 or more is what counts, so shorter ones need not be listed: they cannot overlap it
    kinds = [
        S.matches(text, "assign", BASE["assign"], text.rlike("[:=]"), lambda s: F.length(s["part"]) >= 6, group=2),
        S.matches(text, "access", BASE["access"], F.contains(text, F.lit("AKIA")), lambda s: s["end"] - s["start"] >= 20),
        S.matches(text, "hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", F.lit(True), lambda s: s["end"] - s["start"] >= 24),
    ]
    ranked = F.transform(F.concat(*kinds), lambda s: F.struct(s["start"].alias("start"), F.when(s["kind"] == "assign", order["assign"]).when(s["kind"] == "access", order["access"]).otherwise(order["hex"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"), s["part"].alias("part")))
    return F.transform(F.array_sort(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["part"].alias("part")))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of steps (previous * 128 + next) from rows (value, random). At most 128 * 128 counts per label
    come to the driver."""
    chars = F.filter(F.split("value", ""), lambda c: (F.length(c) > 0) & (F.ascii(c) < _SIZE))
    s = samples.where("value is not null and random is not null").select(F.col("random").cast("boolean").alias("random"), chars.alias("c"))
    s = s.where(F.size("c") > 1).select("random", F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("x"), F.slice("c", F.lit(2), F.size("c") - 1).alias("y"))).alias("s"))
    counts = s.groupBy("random", F.ascii("s.x").alias("x"), F.ascii("s.y").alias("y")).count().collect()
    n = {True: [0.0] * _SIZE * _SIZE, False: [0.0] * _SIZE * _SIZE}
    for r in counts:
        n[r["random"]][r["x"] * _SIZE + r["y"]] += r["count"]
    import math

    # unseen steps get what the next character has on its own, so a chain is not uniform where it has seen nothing
    alone = {k: [sum(v[y::_SIZE]) + 0.5 for y in range(_SIZE)] for k, v in n.items()}
    alone = {k: [x / sum(v) for x in v] for k, v in alone.items()}
    out = []
    for x in range(_SIZE):
        row = {k: v[x * _SIZE : (x + 1) * _SIZE] for k, v in n.items()}
        p = {k: [(c + PRIOR * u) / (sum(v) + PRIOR) for c, u in zip(v, alone[k])] for k, v in row.items()}
        out += [math.log(a) - math.log(b) for a, b in zip(p[True], p[False])]
    return out


def samples(docs: DataFrame, most: int = 2_000, strings: int = 20_000) -> DataFrame:
    """Labelled samples: random strings (digests written in hexadecimal and base 64), and as ordinary identifiers those
    that stand in at least two texts of a bounded number of documents (those with the smallest hashes of their ids; rows
    without a doc_id are not sampled)."""
    spark = docs.sparkSession
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    odd = spark.range(0, strings, 1, 4).select(F.when(F.col("id") % 4 == 0, F.lower(F.hex(digest))).otherwise(F.base64(digest)).alias("value"), F.lit(True).alias("random"))
    # the ids first, a bounded number of them, then the texts where they are
    ids = docs.where("doc_id is not null").select(F.col("doc_id").alias("id")).orderBy(F.xxhash64("id"), "id").limit(most)
    few = docs.join(F.broadcast(ids), docs["doc_id"] == F.col("id"), "left_semi").select(docs["text"].cast("string").alias("text"))
    # what stands in two different texts is not random
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_-]{2,}+"), F.lit(0)))
    plain = few.where("text is not null").select("text").distinct().select(F.explode(found).alias("value")).groupBy("value").count().where("count > 1")
    plain = plain.where(~F.col("value").rlike("^(?:[0-9a-f]{24,}|AKIA.*)$")).select("value", F.lit(False).alias("random"))
    return odd.unionByName(plain)


def ratio(value: Column, model: Column) -> Column:
    """Log-likelihood ratio per step of a string of ASCII characters."""
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    return S.let(codes, lambda c: F.aggregate(F.sequence(F.lit(2), F.size(c)), F.lit(0.0), lambda a, i: a + F.get(model, F.element_at(c, i - 1) * _SIZE + F.element_at(c, i))) / (F.size(c) - 1))


def scan(docs: DataFrame, model: list[float], least: int = LEAST, threshold: float = THRESHOLD, names: tuple[str, str] = ("base", "markov")) -> DataFrame:
    """``docs`` with two columns of spans, named by ``names``. One pass, no shuffle."""
    base, markov = names
    held = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    d = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    more = S.matches(F.col("text"), "markov", rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{least},}}+", F.lit(True), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & (ratio(s["value"], held) > threshold))
    return d.withColumn(base, base_spans(F.col("text"))).withColumn(markov, S.apart(more, F.col(base)))


def redact(docs: DataFrame, model: list[float], mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; overlapping spans become one."""
    names = free_name("base", docs), free_name("markov", docs)
    every = F.transform(F.concat(*names), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(mark).alias("put")))
    return scan(docs, model, names=names).withColumn("text", S.replaced(F.col("text"), every)).select(*docs.columns)
