"""Pluggable embedders."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.errors import EmbedderError

BATCH_SIZE, DIMENSION = 32, 384


class Embedder(Protocol):
    """Turns texts into vectors of one dimension. Must be picklable: every Python worker holds one."""

    dimension: int

    def embed_batch(self, texts: list[str]) -> np.ndarray: ...


class DummyEmbedder:
    """Deterministic vectors from a running hash of the text's bytes; unit length. For tests and trials."""

    # Start, factor and step of the hash, and of the generator it seeds.
    START, FACTOR, MULTIPLIER, INCREMENT = 5381, 33, 6364136223846793005, 1442695040888963407
    name = "dummy"

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension

    def _hash(self, texts: list[str]) -> np.ndarray:
        """The running hash of every text, one byte of all texts at a time; modulo 2^64."""
        data = [t.encode() for t in texts]
        lengths = np.array([len(d) for d in data], np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(data), np.uint8)
        starts = (np.cumsum(lengths) - lengths)[order]
        state = np.full(len(texts), self.START, np.uint64)
        alive = len(texts)
        with np.errstate(over="ignore"):
            for at in range(int(lengths.max(initial=0))):
                while alive and lengths[order[alive - 1]] <= at:
                    alive -= 1
                state[:alive] = state[:alive] * np.uint64(self.FACTOR) + flat[starts[:alive] + at]
        out = np.empty_like(state)
        out[order] = state
        return out

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        state = self._hash(texts)
        out = np.empty((len(texts), self.dimension), np.float32)
        with np.errstate(over="ignore"):
            for d in range(self.dimension):
                state = state * np.uint64(self.MULTIPLIER) + np.uint64(self.INCREMENT)
                out[:, d] = (state >> np.uint64(33)).astype(np.float32) / np.float32(4294967295) * np.float32(2) - np.float32(1)
        wide = out.astype(np.float64)
        length = np.sqrt((wide * wide).sum(axis=1, keepdims=True))
        return np.divide(wide, length, out=wide, where=length > 0).astype(np.float32)


class OnnxEmbedder:
    """A sentence encoder from local ONNX and tokenizer files: mean pooling over the active tokens, unit length.

    Longer inputs are cut to ``longest`` tokens, the last one kept as the end mark. Nothing is downloaded.
    """

    def __init__(self, model: str, tokenizer: str, dimension: int = DIMENSION, longest: int = 256, threads: int = 4):
        self.model, self.tokenizer, self.dimension, self.longest, self.threads = model, tokenizer, dimension, longest, threads
        self.name = os.path.dirname(model)
        self._session = self._tokens = None

    def __getstate__(self):
        return self.__dict__ | {"_session": None, "_tokens": None}

    def _load(self) -> None:
        try:
            import onnxruntime
            from tokenizers import Tokenizer

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = self.threads
            options.graph_optimization_level = onnxruntime.GraphOptimizationLevel.ORT_ENABLE_ALL
            self._session = onnxruntime.InferenceSession(self.model, options)
            self._tokens = Tokenizer.from_file(self.tokenizer)
        except Exception as e:
            raise EmbedderError(f"no embedder from {self.model}") from e

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        if self._session is None:
            self._load()
        encoded = [t.ids if len(t.ids) <= self.longest else [*t.ids[: self.longest - 1], t.ids[-1]] for t in self._tokens.encode_batch(texts)]
        width = max(map(len, encoded), default=1)
        ids = np.array([e + [0] * (width - len(e)) for e in encoded], np.int64).reshape(len(texts), width)
        mask = np.array([[1] * len(e) + [0] * (width - len(e)) for e in encoded], np.int64).reshape(len(texts), width)
        feeds = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        names = {i.name for i in self._session.get_inputs()}
        hidden = self._session.run(None, {k: v for k, v in feeds.items() if k in names})[0]
        summed = (hidden * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1)
        return (summed / np.maximum(np.linalg.norm(summed, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def embedder_of(model: str) -> Embedder:
    """The embedder of a configured model: a directory with model.onnx and tokenizer.json, or ``dummy`` for trials.

    There is no silent stand-in: without a model, or with files missing, this is an error.
    """
    if model == DummyEmbedder.name:
        return DummyEmbedder()
    if not model:
        raise EmbedderError("no model: give a directory with model.onnx and tokenizer.json, or 'dummy' for trials")
    files = [os.path.join(model, f) for f in ("model.onnx", "tokenizer.json")]
    if missing := [f for f in files if not os.path.isfile(f)]:
        raise EmbedderError(f"no embedder from {model}: {', '.join(missing)} missing")
    return OnnxEmbedder(*files)


def embed(rows: DataFrame, embedder: Embedder, text_column: str = "summary", batch_size: int = BATCH_SIZE) -> DataFrame:
    """(chunk_id, embedding) of the rows' texts; a null text is embedded as an empty one. One narrow pass."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            filled = texts.fillna("").tolist()
            parts = [embedder.embed_batch(filled[i : i + batch_size]) for i in range(0, len(filled), batch_size)]
            yield pd.Series([list(map(float, v)) for part in parts for v in part])

    return rows.select("chunk_id", vectors(F.col(text_column)).alias("embedding"))


def embed_all(texts: list[str], embedder: Embedder, batch_size: int = BATCH_SIZE, progress: Callable[[int, int], None] | None = None) -> list[list[float]]:
    """Vectors of a driver-side list, with ``progress(done, all)`` after every batch; at least one text a batch."""
    size, out = max(batch_size, 1), []
    for i in range(0, len(texts), size):
        out += [list(map(float, v)) for v in embedder.embed_batch(texts[i : i + size])]
        if progress:
            progress(len(out), len(texts))
    return out
