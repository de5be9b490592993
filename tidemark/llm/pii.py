"""Personal data: fixed patterns, and terms that reveal what the patterns find; DataFrame expressions only.

Base spans are the leftmost non-overlapping matches of four kinds (see ``BASE``): email, ip (parts at most 255), card
(13 to 19 digits that pass Luhn), phone (9 to 15 digits).

Information-theoretic sanitisation adds spans of kind ``term``. The entities to protect are the base values; the terms are
the words that overlap no base span. From document counts over the whole corpus, entity c has the information
IC(c) = -log p(c) and term t discloses PMI(c, t) = log p(c, t) / (p(c) p(t)) of it, p(c, t) being the share of documents
that hold both, anywhere. A term with PMI / IC of at least ``generalise`` for any entity is replaced by its category
wherever it stands, in all documents; with at least ``remove`` it is removed. A pair counts once it is seen in ``support``
documents.

Entities that stand in the same documents have the same counts with every term, and so have such terms, so both are
counted as classes of equal document sets (told apart by 128 bits over their documents): copies of a long text with
many entities and words give one pair, not their product. Only pairs whose frequencies alone allow the threshold are
counted. Counts are plain aggregations with partial sums, held in written tables, so a very frequent entity or term is
one row of them and the joins with them can be split.

Null texts are empty. Every row is a document of its own, also if rows repeat or doc_ids are shared or null. Extra
columns are not read. An empty table gives an empty table; without entities there are no terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import drop, stored

#: Kinds and patterns, in the order they are listed.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches without backtracking: a run starts where none is under way, or where the last match ended.
_FAST = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": BASE["phone"],
}
SUPPORT, GENERALISE, REMOVE = 2, 0.8, 0.95
#: Hash slots by which the terms of all documents are filtered before they are dealt.
SLOTS = 1 << 19
_WORD = r"[\p{L}][\p{L}\p{N}'-]{2,}+"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does a string of digits pass Luhn's test?"""
    d = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    twice = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    values = F.transform(d, lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int")))
    return S.total(values) % 10 == 0


def _small(part: Column) -> Column:
    """At most 255, for a string of digits of any length."""
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def base_spans(text: Column) -> Column:
    """All base spans, by kind as listed, then start."""

    def card(s: Column) -> Column:
        d = _digits(s["value"])
        return F.length(d).between(13, 19) & luhn(d)

    return F.concat(
        S.matches(text, "email", _FAST["email"], F.contains(text, F.lit("@")), lambda s: F.lit(True)),
        S.matches(text, "ip", _FAST["ip"], text.rlike(r"[0-9]\.[0-9]"), lambda s: F.forall(F.split(s["value"], r"\."), _small)),
        S.matches(text, "card", _FAST["card"], text.rlike("[0-9](?:[ -]?[0-9]){12}"), card),
        S.matches(text, "phone", _FAST["phone"], text.rlike(r"\+[0-9]"), lambda s: F.length(_digits(s["value"])).between(9, 15)),
    )


def _words(text: Column, base: Column) -> Column:
    """The words of a text that overlap no base span, as spans."""
    return S.apart(S.matches(text, "term", _WORD, F.lit(True), lambda s: F.lit(True)), base)


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (row, doc_id, text, base) of all documents, and their different terms (row, holds, term), where
    ``holds`` says that the document has a base span."""
    t = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    found = stored(t.withColumn("base", base_spans(F.col("text"))), "pii")
    plain = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    own = F.when(F.size("base") > 0, F.transform(_words(F.col("text"), F.col("base")), lambda s: s["value"])).otherwise(plain)
    return found, stored(found.select("row", (F.size("base") > 0).alias("holds"), F.explode(F.array_distinct(F.transform(own, lambda w: F.lower(w)))).alias("term")), "terms")


def _among(words: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows of ``words`` whose term may be one of ``terms``: by its slot out of SLOTS, so the broadcast side has SLOTS
    numbers at most, and what is dealt afterwards is little more than what is needed."""
    slot = F.pmod(F.xxhash64("term"), F.lit(SLOTS)).cast("int")
    return words.join(F.broadcast(terms.select(slot.alias("slot")).distinct()), slot == F.col("slot"), "left_semi")


def disclosures(found: DataFrame, words: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """(term, share): the terms whose disclosure PMI / IC is at least ``least`` for an entity, and the largest share."""
    n = float(max(found.count(), 1))
    # the documents of an entity or term, as 128 bits
    set_of = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"set{k}") for k in (0, 1)]
    each = found.select("row", F.explode(F.array_distinct(F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["value"].alias("value"))))).alias("e"))
    entity = stored(each.groupBy("e").agg(F.count("*").alias("n_entity"), *set_of).where(F.col("n_entity") >= support), "entities")
    held = stored(each.join(entity, "e").select("row", F.struct("set0", "set1").alias("c"), "n_entity").distinct(), "held")
    near = stored(words.where("holds").join(held.select("row").distinct(), "row", "left_semi").select("row", "term"), "near")
    # only terms that stand in a document with such an entity are counted, over all documents
    count = _among(words, near).groupBy("term").agg(F.count("*").alias("n_term"), *set_of).where(F.col("n_term") >= support)
    term = stored(count.join(near.select("term").distinct(), "term", "left_semi"), "counts")
    may = near.join(term, "term").select("row", F.struct("set0", "set1").alias("t"), "n_term").distinct()
    # n_pair is n_entity at most, so only these can reach the threshold
    can = F.log(F.col("n_term")) <= F.log(F.col("n_entity")) + (1 - least) * (F.log(F.lit(n)) - F.log(F.col("n_entity"))) + 1e-9
    pair = may.join(held, "row").where(can).groupBy("c", "t").agg(F.count("*").alias("n_pair"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term")).where(F.col("n_pair") >= support)
    pmi = F.log(F.lit(n) * F.col("n_pair") / (F.col("n_entity") * F.col("n_term")))
    ic = F.log(F.lit(n) / F.col("n_entity"))
    share = F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0))
    best = stored(pair.groupBy("t").agg(F.max(share).alias("share")).where(F.col("share") >= least), "best")
    out = stored(term.join(best, (F.col("set0") == F.col("t.set0")) & (F.col("set1") == F.col("t.set1"))).select("term", "share"), "disclosures")
    drop(found.sparkSession, *(x._tidemark_path for x in (entity, term, held, near, best)))
    return out


def all_spans(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(row, doc_id, base, terms): terms as (start, end, word, action), by start; none overlaps a base span."""
    found, words = find(docs)
    d = disclosures(found, words, support, generalise)
    action = F.when(F.col("share") >= remove, "remove").otherwise("generalise")
    hit = _among(words, d).join(d, "term").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", action.alias("action")))).alias("told"))
    at = F.filter(_words(F.col("text"), F.col("base")), lambda s: F.map_contains_key("told", F.lower(s["value"])))
    terms = F.transform(at, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("word"), F.element_at("told", F.lower(s["value"])).alias("action")))
    none = F.array().cast("array<struct<start:int,end:int,word:string,action:string>>")
    return found.join(hit, "row", "left").select("row", "doc_id", "base", F.when(F.col("told").isNotNull(), terms).otherwise(none).alias("terms"))


def category(word: Column) -> Column:
    """What a term is generalised to."""
    return F.when(word.rlike("[0-9]"), "[code]").when(word.rlike(r"^\p{Lu}"), "[name]").otherwise("[term]")


def sanitise(text: Column, base: Column, terms: Column) -> Column:
    """``text`` with base spans replaced by their kinds and terms generalised or removed; of overlapping base spans
    the first counts and the rest up to the last end goes with it."""
    put = F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.concat(F.lit("["), b["kind"], F.lit("]")).alias("put"))),
        F.transform(terms, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["action"] == "remove", "").otherwise(category(t["word"])).alias("put"))),
    )
    return S.replaced(text, put)
