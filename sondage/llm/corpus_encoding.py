"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Long texts are cut at safe boundaries first, where the split pattern ends a token whatever the script: before a blank that
follows a sign, and between letters or digits and other signs. So the ids of the parts put together are those of the text. Decoding joins the raw bytes of the
tokens and only then reads them as UTF-8.

Cases: an empty text has no ids (an empty list), and so has a null text; special tokens' strings are ordinary text;
repeated rows each get their row; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame


#: Where the vocabulary files lie; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Fixed value: the public split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts above this many characters are cut.
LONG = 100_000
#: Where no token of the pattern runs on: before a blank that follows a sign, and between a letter and a sign that is
#: neither letter, digit, blank nor apostrophe, whatever the script. Each part is split as it would be inside the text.
_SAFE = regex.compile(r"(?<=\S)(?=[ \n])|(?<=\p{L})(?=[^\s\p{L}\p{N}'])|(?<=\p{N})(?=[^\s\p{N}])")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tiktoken encoding of a local rank file; loaded once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, long: int = LONG) -> Iterator[str]:
    """Parts of about ``long`` characters, cut at safe places; a run of letters without one, in any script, stays whole."""
    at = 0
    while len(text) - at > long:
        cut = _SAFE.search(text, at + long)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode_text(text: str | None, path: str) -> np.ndarray:
    """The ids of one text, as uint32."""
    if not text:
        return np.empty(0, np.uint32)
    enc = tokenizer(path)
    if len(text) <= LONG:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([enc.encode_to_numpy(part, disallowed_special=()) for part in safe_parts(text)])


def decode_ids(ids, path: str) -> str:
    """The text of ids: raw bytes first, so that a character split over tokens comes back whole."""
    return b"".join(tokenizer(path).decode_tokens_bytes([int(i) for i in ids])).decode("utf-8", errors="replace")


def encode_corpus(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizers: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(id, ids): one narrow pass over Arrow batches, no shuffle; only the two columns are read."""
    path = f"{tokenizers}/{name}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encode_text(t, path) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    source = documents.select(documents[id_column].cast("bigint").alias("doc_id"), documents[text_column].alias("text"))
    return source.mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], text_column: str = "text", tokenizers: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """The ``keep`` columns and ``n_tokens`` (0 for an empty or null text): sizes without moving the ids."""
    path = f"{tokenizers}/{name}.tiktoken"
    source = documents.select(*keep, documents[text_column].alias("_text"))
    out = source.drop("_text").schema.add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([len(encode_text(t, path)) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], names=[*keep, "n_tokens"])

    return source.mapInArrow(run, out)
