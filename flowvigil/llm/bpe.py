"""Byte-level BPE with the tiktoken library and a local rank file.

Each match of the split pattern is encoded separately. A long text is first cut where the
pattern always starts a new match - before a single blank between two letters - so that no
call sees more than about ``CUT`` characters; a run without such a place is not cut.
A run of ``RUN`` or more white-space characters is a match by itself (without its last one, where more text follows) and is
encoded as one piece, since the splitter's backtracking is bounded. This holds for patterns that treat white space
as ``\\s+(?!\\S)|\\s+``. Decoding joins the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from flowvigil.llm.tasks import map_blocks

CUT = 100_000
RUN = 10_000
SAFE = regex.compile(r"(?<=\p{L}) (?=\p{L})")
BLANKS = regex.compile(rf"\p{{White_Space}}{{{RUN},}}+")


@functools.lru_cache(4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (lines of a base64 token and its rank), once a process."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cuts(text: str, size: int = CUT) -> list[str]:
    """The text in pieces that end at safe boundaries."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while (found := SAFE.search(text, start + size)) is not None:
        out.append(text[start:found.start()])
        start = found.start()
    return [*out, text[start:]]


def encode_text(enc: tiktoken.Encoding, text: str, size: int = CUT) -> np.ndarray:
    parts, start = [], 0
    for run in BLANKS.finditer(text):
        end = run.end() - (run.end() < len(text))
        parts += [enc.encode_to_numpy(part, disallowed_special=()) for part in cuts(text[start:run.start()], size)]
        parts.append(np.array(enc._encode_single_piece(text[run.start():end]), np.uint32))
        start = end
    parts += [enc.encode_to_numpy(part, disallowed_special=()) for part in cuts(text[start:], size)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def encode(docs: DataFrame, rank_file: str, pattern: str, cut: int = CUT) -> DataFrame:
    """doc_id and the token ids of each row's whole text, special tokens unknown.

    A null or empty text has no ids; rows with the same doc_id are encoded each on its own;
    other columns are not looked at; a very long text is a block of its own; an empty table gives no rows.
    """
    def run(block):
        enc = encoding(rank_file, pattern)
        rows = [encode_text(enc, t or "", cut) for t in block["text"].to_pylist()]
        off = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
        return pa.table({"doc_id": block["doc_id"], "ids": pa.ListArray.from_arrays(pa.array(off), pa.array(flat))})
    return map_blocks(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def _lists(column) -> list[np.ndarray]:
    flat, off = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(off[:-1], off[1:])]


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, ids and ``data``, the bytes that the ids stand for (a null list: none)."""
    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            data = [enc.decode_bytes(ids.tolist()) for ids in _lists(batch["ids"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], pa.array(data, pa.binary())],
                                             ["doc_id", "ids", "data"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, data binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, cut: int = CUT) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by blanks) and decoded_sha256 (bytes that the ids stand for), in one pass.

    Rows are treated as by ``encode``; a text's ids never leave the task.
    """
    def sha(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def run(block):
        enc = encoding(rank_file, pattern)
        out = []
        for doc_id, text in zip(block["doc_id"].to_pylist(), block["text"]):
            ids = encode_text(enc, text.as_py() or "", cut).tolist()
            out.append((doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha(enc.decode_bytes(ids))))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return map_blocks(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
