"""Byte-level BPE with the tiktoken library: encoding and raw-byte decoding of whole texts.

Texts beyond ``segment_chars`` are cut only where the splitting pattern always ends a match: between a letter or
digit and a space or line break. The run of white space then belongs to the next segment as a whole, so the matches,
and with them the ids, are those of the uncut text. A text without such a place is encoded in one piece.

Null texts count as empty (no ids). Rows that repeat, tie or have null doc_ids are encoded each for itself; extra
columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import texts

#: Longer texts are cut.
SEGMENT_CHARS = 20_000
#: Texts encoded before their results are passed on.
BATCH = 256
_SAFE = re.compile(r"[^\W_](?=[ \n])")
_loaded: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file; read once per worker."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path, pattern] = tiktoken.Encoding("tidemark", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def segments(text: str, limit: int = SEGMENT_CHARS) -> Iterator[str]:
    """Cut a text at safe places, into pieces of at least ``limit`` characters (the last may be shorter)."""
    at = 0
    while len(text) - at > limit and (m := _SAFE.search(text, at + limit - 1)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def encode(enc, text: str, limit: int = SEGMENT_CHARS) -> list[int]:
    if len(text) <= limit:
        return enc.encode_ordinary(text)
    return [i for part in segments(text, limit) for i in enc.encode_ordinary(part)]


def decode(enc, ids: list[int]) -> bytes:
    """The bytes of the ids; they need not be valid UTF-8."""
    return enc.decode_bytes(ids)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, segment_chars: int = SEGMENT_CHARS, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids): encode each text, decode its ids. Map-only, no shuffle."""

    def run(batches):
        import pyarrow as pa

        enc = encoding(path, pattern)
        for whole in batches:
            for first in range(0, whole.num_rows, BATCH):
                b = whole.slice(first, BATCH)
                n, a, d, kept = [], [], [], []
                for x in b.column(1):
                    ids = encode(enc, x.as_py() or "", segment_chars)
                    n.append(len(ids))
                    a.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    d.append(hashlib.sha256(decode(enc, ids)).hexdigest())
                    if with_ids:
                        kept.append(pa.array(ids, pa.int32()))
                cols = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = pa.array([0, *itertools.accumulate(n)], pa.int32())
                    cols.append(pa.ListArray.from_arrays(ends, pa.concat_arrays(kept)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    t = texts(docs)
    kind = t.schema["doc_id"].dataType.simpleString()
    return t.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
