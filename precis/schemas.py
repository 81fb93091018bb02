"""Table schemas. ``(doc_id, sentence_id)`` is the key of every sentence table."""

from pyspark.sql import types as T

TRANSCRIPTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("transcript", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("playlist_name", T.StringType()),
])
HAND_LABELS = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("sentence", T.StringType()),
])
NOTES = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("document", T.StringType()),
])
REPLY_BODY = T.StructType([
    T.StructField("choices", T.ArrayType(T.StructType([
        T.StructField("message", T.StructType([T.StructField("content", T.StringType())])),
    ]))),
])
