"""Schemas of the entities that move between operators."""

from pyspark.sql import types as T

HEADER = "struct<name:string,value:string>"
EMAIL = (
    "path string, sender string, subject string, date_raw string, body string, recipients string, cc string, message_id string, in_reply_to string, "
    f"refs string, headers array<{HEADER}>, is_calendar boolean, n_attachments int, error string"
)
ATTACHMENT = "path string, message_id string, part_no int, filename string, mime string, inline boolean, size bigint, sha256 string, data binary, error string"
CHUNK = T.StructType(
    [
        T.StructField("doc_key", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("point_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("content_hash", T.StringType()),
    ]
)
