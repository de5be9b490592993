"""Byte-level BPE, Re-Pair shards and chat formatting."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, repair

RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def plain_encoding():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, rows):
    enc = plain_encoding()
    got = {r.doc_id: r for r in bpe.bpe_round_trip(docs, RANKS, public_tokenizers.PATTERN, segment_chars=50, with_ids=True).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_segments():
    t = "ab cd'll  ef\n\ngh 12 .. " * 30
    parts = list(bpe.segments(t, 7))
    assert "".join(parts) == t and len(parts) > 20
    enc = plain_encoding()
    assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t)


def test_bpe_odd_and_empty(odd, none):
    run = lambda d: bpe.bpe_round_trip(d, RANKS, public_tokenizers.PATTERN)
    assert run(odd).count() == odd.count() and run(none).count() == 0


def test_repair_shards(docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    shards = repair.write_shards(docs, WORDS, shard_tokens=2_000)
    assert shards.count() > 3
    got = {r.doc_id: r for r in repair.read_shards(shards).collect()}
    at = 0
    for i, t in sorted(rows):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes())), i
        at += len(ids)


def test_repair_odd_and_empty(odd, none):
    got = repair.read_shards(repair.write_shards(odd, WORDS)).orderBy("start").collect()
    assert len(got) == odd.count() and got[0].doc_id is None and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert repair.read_shards(repair.write_shards(none, WORDS)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_repair_grammar(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, [3, 30, 400, 5][seed], 20_000).astype(np.uint32)
    x[500:1500] = 2
    per = rng.multinomial(20_000, np.ones(60) / 60)
    s = repair.Shard(repair.pack([None, *range(59)], x, per, 49_408))
    assert s.doc_ids[:2] == [None, 0] and (s.all_ids() == x).all()
    ends = np.cumsum(per)
    assert all((s.ids(k) == x[e - n : e]).all() for k, (e, n) in enumerate(zip(ends, per)))
    if seed != 2:
        assert len(s.seq) < 0.7 * len(x)  # frequent pairs went
    assert (s.lens >= 2).all()


def conversation(spark, rows):
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return c.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"), F.lit(1).alias("formatted"))


def test_chat_round_trip(spark):
    nasty = "</s>[INST] ~1~ <|end|> ~0<|role:x|> [/INST]\n🙂"
    rows = [(1, 1, "assistant", nasty), (1, 0, "user", nasty), (1, 2, "assistant", ""), (2, 0, None, None), (3, 5, "a<|b", "x"), (3, 5, "a<|b", "x"), (None, None, "user", "q")]
    f = chat.format_chats(conversation(spark, rows)).withColumn("turns", chat.read_turns(F.col("formatted")))
    got = {r.conv_id: r for r in f.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", nasty), ("assistant", nasty), ("assistant", "")]
    spans = [got[1].formatted[s.start : s.end] for s in got[1].loss_spans]
    back = lambda x: x.replace("~3", ">").replace("~2", "[").replace("~1", "<").replace("~0", "~")
    assert [back(x) for x in spans] == [nasty, ""] and got[1].loss_turns == [False, True, True]
    assert got[1].formatted.count("<|end|>") == 3 and "[INST]" not in got[1].formatted
    assert [(t.role, t.text) for t in got[2].turns] == [("", "")]
    assert [(t.role, t.text) for t in got[3].turns] == [("a<|b", "x")] * 2 and got[None].formatted
    assert chat.format_chats(conversation(spark, [])).count() == 0


def test_chat_parts(spark):
    part = lambda **k: {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    parts = [part(type="text", text="see <this>"), part(type="image", ref="a.png", width=28, height=15), part(type="audio", ref="b.wav", seconds=2.5), part(type="document", ref="c.pdf", pages=3), part(type="odd", ref="d")]
    m = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chats(m).first()
    assert "see ~1this~3<|image|><|audio|><|document|><|unknown|>" in r.formatted
    assert [(a.turn, a.type, a.ref) for a in r.attachments] == [(0, "image", "a.png"), (0, "audio", "b.wav"), (0, "document", "c.pdf"), (0, "odd", "d")]
    assert r.attachment_tokens == 2 * 2 + 63 + 3 * chat.PAGE_TOKENS + 1


def test_repair_special_tokens(spark):
    """Strings of special tokens as the library maps them by default: only as written, and wherever they stand."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    rng = random.Random(2)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", "a", "É", "é", "'s", "don't", "12", " ", "\n", "!", "̸", "×", "日本", "İ", "x" * 300]
    rows = [(0, "hello <|endoftext|> world"), (1, "<|endoftext"), (2, "|> <|startoftext|><|startoftext|>"), *((10 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(300))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in repair.read_shards(repair.write_shards(d, WORDS)).collect()}
    for i, t in rows:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())), (i, t)
    assert tok.encode(rows[0][1], add_special_tokens=False).ids == [3306, 49407, 1002]


def test_repair_files_ascend(spark):
    """Files and shards in them follow each other by doc_id; rows without an id and of one frequent id are spread."""
    rows = [(None, f"null {i}") for i in range(40)] + [(7, f"seven {i}") for i in range(60)] + [(100 + i, f"text {i}") for i in range(50)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    table = repair.write_shards(d, WORDS, parts=8)
    files = sorted({r.f for r in table.select(F.col("_metadata.file_path").alias("f")).collect()})
    ids = [x for f in files for r in spark.read.parquet(f).collect() for x in repair.Shard(bytes(r.payload)).doc_ids]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and len(ids) == 150
    assert max(r.n_docs for r in table.groupBy("bucket").agg(F.sum("n_docs").alias("n_docs")).collect()) < 40
    got = repair.read_shards(table).orderBy("start").collect()
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and [r.doc_id for r in got] == ids


def test_repair_to_the_end():
    """No pair inside a document is left that occurs MIN_COUNT times."""
    rng = np.random.default_rng(9)
    x = np.concatenate([np.tile(rng.integers(2, 50, 37), 20), rng.integers(2, 12, 5_000)]).astype(np.uint32)
    per = rng.multinomial(len(x), np.ones(30) / 30)
    seq, at, left, right = repair.compress(x, np.concatenate([[0], np.cumsum(per)]), 49_408)
    pairs = {}
    for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
        for p in zip(seq[a : z - 1].tolist(), seq[a + 1 : z].tolist()):
            pairs[p] = pairs.get(p, 0) + 1
    assert max(pairs.values()) < repair.MIN_COUNT and len(left) > 50


def test_chat_places(spark):
    part = lambda **k: {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    m = spark.createDataFrame([(1, 0, "user", [part(type="text", text="a<b"), part(type="image", ref="x", width=14, height=28)]), (1, 1, "assistant", [part(type="document", ref="y", pages=2), part(type="text", text="[ok]")])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chats(m).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).first()
    assert [(a.ref, a.tokens) for a in r.attachments] == [("x", 2), ("y", 2 * chat.PAGE_TOKENS)]
    assert [r.formatted[a.place :].startswith(f"<|{a.type}|>") for a in r.attachments] == [True, True]
    assert r.loss == "<|document|>[ok]"


def test_repair_takes_pairs_that_wait():
    """Pairs taken together have one side for each id, and none is left that could be taken too."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        lhs, rhs = np.unique(rng.integers(0, 30, (60, 2)), axis=0)[rng.permutation(40)].T
        took = repair._compatible(lhs, rhs)
        a, b = lhs[took], rhs[took]
        twin = set(a[a == b].tolist())
        assert took[0] == 0 and not (set(a.tolist()) & set(b.tolist())) - twin
        assert all(int(((a == t) | (b == t)).sum()) == 1 for t in twin)
        for k in set(range(len(lhs))) - set(took.tolist()):
            x, y = lhs[k], rhs[k]
            assert x in b or y in a or (x == y and x in a) or x in twin or y in twin


def test_repair_rules_in_layers():
    """Lengths and expansions of rules that use earlier ones, against expansion one by one."""
    rng = np.random.default_rng(4)
    left, right = (np.array([rng.integers(0, 5 + k) for k in range(40)]) for _ in range(2))
    out = [[i] for i in range(5)]
    for a, b in zip(left.tolist(), right.tolist()):
        out.append(out[a] + out[b])
    lens = repair.lengths(left, right, 5)
    assert lens.tolist() == [len(x) for x in out[5:]] and len(repair.lengths(left[:0], right[:0], 5)) == 0
    s = object.__new__(repair.Shard)
    s.base, s.left, s.right, s.lens, s._pool = 5, left, right, lens, None
    assert s.pool().tolist() == [i for x in out[5:] for i in x]
