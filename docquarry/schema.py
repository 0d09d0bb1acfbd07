"""Schemas of the stored tables, as DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HEADING = "struct<text:string,level:int,position:int,page:int,font_size:double,path:string>"
HEADINGS = f"array<{HEADING}>"

SOURCES = (
    "source_id string, location string, content_type string, content_hash string, "
    "size_bytes bigint, last_modified double, indexed_at double, metadata map<string,string>"
)
CHUNKS = (
    "doc_id string, source_id string, chunk_order int, content string, "
    "chunk_start_char int, chunk_end_char int, token_count int, chunk_hash string, title string, "
    "heading_path string, closest_heading string, metadata map<string,string>"
)
VECTORS = "doc_id string, source_id string, ordinal bigint, embedding array<float>, model string"
# chunks that have no vector yet because the model failed
UNFINISHED = "doc_id string, source_id string, model string, attempts int, error string"
SETTINGS = "key string, value string"
ERRORS = "stage string, error_type string, error_message string, source_id string"


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Cast and order *df* to *ddl*, adding missing columns as nulls."""
    from pyspark.sql import functions as F

    fields = empty(df.sparkSession, ddl).schema.fields
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )
