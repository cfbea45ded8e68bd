"""Explicit schemas of the tables."""

from pyspark.sql import types as T

KINDS = ("function", "method", "class", "struct", "enum", "interface", "module", "block")

CHUNKS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("doc_comment", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("byte_start", T.LongType()),
        T.StructField("byte_end", T.LongType()),
        T.StructField("line_start", T.IntegerType()),
        T.StructField("line_end", T.IntegerType()),
    ]
)
VECTORS = T.StructType([T.StructField("chunk_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
CELLS = T.StructType([T.StructField("cell", T.IntegerType()), *VECTORS.fields])
CENTROIDS = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("centroid", T.ArrayType(T.FloatType()))])
POSTINGS = T.StructType([T.StructField("token", T.StringType()), T.StructField("chunk_id", T.LongType()), T.StructField("freq", T.LongType())])
FILE_STATE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("chunk_ids", T.ArrayType(T.LongType())),
    ]
)
META = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("embedding_dim", T.IntegerType()), T.StructField("chunk_count", T.LongType()), T.StructField("files", T.LongType())])
