"""Search over an index: one plan for all sources."""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.errors import EmbedderError, IndexNotFound, InvalidMode, InvalidPattern
from sondage.operators.embedding import Embedder, embedder_of
from sondage.operators.fusion import RRF_K, fuse_only, rrf_fuse
from sondage.operators.pattern import search_pattern
from sondage.operators.text_search import regex_search
from sondage.operators.vector_search import search_cells, search_vector
from sondage.sources.index_store import IndexStore


class Mode(str, Enum):
    """How to search."""

    TEXT = "text"
    SEMANTIC = "semantic"
    AST = "ast"
    HYBRID = "hybrid"

    @classmethod
    def parse(cls, text: str) -> Mode:
        """A mode by its name, whatever the case."""
        try:
            return cls(text.strip().lower())
        except ValueError:
            raise InvalidMode(text) from None


def fused_hits(chunks: DataFrame, vectors: DataFrame, query: str, mode: Mode | str = Mode.HYBRID, top_k: int = 20, query_vector: Sequence[float] | None = None, embedder: Embedder | None = None, rrf_k: int = RRF_K, threshold: float = 0.0, least_ast: float = 0.0, repeated: bool = False, semantic: DataFrame | None = None) -> DataFrame:
    """The fused hits of a query. Every source is cut to ``top_k`` before fusion; a query that is no signature pattern
    adds no ast hits to a hybrid search, but a bad regular expression fails it. ``repeated``: vectors may have an id twice.
    ``semantic`` are the hits of a vector search made elsewhere."""
    mode = Mode.parse(mode) if isinstance(mode, str) and not isinstance(mode, Mode) else mode

    def by_vector() -> DataFrame:
        if semantic is not None:
            return semantic
        asked = query_vector if query_vector is not None else embedder.embed_batch([query])[0]
        return search_vector(vectors, [float(x) for x in asked], top_k, threshold, repeated=repeated)

    if mode in (Mode.SEMANTIC, Mode.HYBRID) and semantic is None and query_vector is None and embedder is None:
        raise EmbedderError("a semantic search needs an embedder or a query vector")
    if mode is Mode.TEXT:
        return fuse_only(regex_search(chunks, query, top_k), "text", top_k)
    if mode is Mode.SEMANTIC:
        return fuse_only(by_vector(), "semantic", top_k)
    if mode is Mode.AST:
        return fuse_only(search_pattern(chunks, query, top_k, least_ast), "ast", top_k)
    text = regex_search(chunks, query, top_k)
    try:
        ast = search_pattern(chunks, query, top_k, least_ast)
    except InvalidPattern:
        ast = None
    return rrf_fuse(text, by_vector(), ast, rrf_k, top_k)


def with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunks, each once, in the order of the fused score; hits without a chunk fall away."""
    return hits.join(chunks.withColumnRenamed("id", "chunk_id"), "chunk_id").dropDuplicates(["chunk_id"]).orderBy(F.desc("fused_score"), "chunk_id")


def search(spark: SparkSession, index: str, query: str, mode: Mode | str = Mode.HYBRID, top_k: int = 20, embedder: Embedder | None = None, rrf_k: int = RRF_K, threshold: float = 0.0, approximate: bool = False) -> DataFrame:
    """Hits of a query in an index, with their chunks.

    The query is embedded by the model the index was made with, unless ``embedder`` is given. ``approximate`` looks into
    the nearest stored cells of vectors only.
    """
    store = IndexStore(spark, index)
    if not store.exists():
        raise IndexNotFound(index)
    mode = Mode.parse(mode) if isinstance(mode, str) and not isinstance(mode, Mode) else mode
    asked = semantic = None
    if mode in (Mode.SEMANTIC, Mode.HYBRID):
        asked = [float(x) for x in (embedder or embedder_of(store.manifest()["model"])).embed_batch([query])[0]]
        if approximate:
            semantic = search_cells(store.read("cells"), store.centroids(), asked, top_k, threshold)
    chunks = store.read("chunks")
    hits = fused_hits(chunks, store.read("vectors"), query, mode, top_k, query_vector=asked, rrf_k=rrf_k, threshold=threshold, semantic=semantic)
    return with_chunks(hits, chunks)
