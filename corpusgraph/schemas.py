"""Schemas of nodes, edges and state tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


FILES = "path string, name string, extension string, mime_type string, language string, ingest_kind string, ingest_mode string, ingest_reason string, size long, mod_time timestamp, content_hash string, metadata_hash string, summary string, complexity int, analyzed_at timestamp, analysis_version int, created_at timestamp, updated_at timestamp"
#: A chunk's metadata: one nullable struct per variant; several may be set.
METADATA = {
    "code": "language string, function_name string, class_name string, signature string, return_type string, parameters array<string>, visibility string, is_async boolean, is_static boolean, is_exported boolean, is_generator boolean, is_getter boolean, is_setter boolean, is_constructor boolean, decorators array<string>, docstring string, namespace string, parent_class string, implements array<string>, line_start int, line_end int",
    "document": "heading string, heading_level int, section_path string, section_number string, author string, created_date string, modified_date string, page_number int, page_count int, word_count int, has_code_block boolean, code_language string, list_depth int, is_table boolean, is_footnote boolean, extraction_quality string",
    "notebook": "cell_type string, cell_index int, execution_count int, has_output boolean, output_types array<string>, kernel string",
    "build": "target_name string, dependencies array<string>, stage_name string, base_image string",
    "infra": "resource_type string, resource_name string, block_type string",
    "schema": "message_name string, service_name string, rpc_name string, type_name string, type_kind string",
    "structured": "schema_path string, element_name string, element_path string, table_path string, record_index int, record_count int, key_names array<string>",
    "sql": "statement_type string, object_type string, table_name string, procedure_name string, sql_dialect string",
    "log": "time_start string, time_end string, log_level string, log_format string, error_count int, source_app string",
}
CHUNK_FIELDS = "index int, content string, start_offset int, end_offset int, chunk_type string, token_estimate int, " + ", ".join(f"{k} struct<{', '.join(':'.join(f.split(' ')) for f in v.split(', '))}>" for k, v in METADATA.items())
CHUNKS = "id string, file_path string, " + CHUNK_FIELDS + ", content_hash string, summary string, created_at timestamp, updated_at timestamp"
CHUNK_EMBEDDINGS = "chunk_id string, provider string, model string, dimensions int, embedding array<float>, created_at timestamp"
DIRECTORIES = "path string, name string, is_remembered boolean, file_count long"
TAGS = "normalized_name string, name string, usage_count long, created_at timestamp"
TOPICS = "normalized_name string, name string, description string, usage_count long"
ENTITIES = "normalized_name string, type string, name string, usage_count long"
EDGES = "src_label string, src_key string, rel string, dst_label string, dst_key string, confidence double, type string"
REMEMBERED_PATHS = "path string, config_json string, last_walk_at timestamp, created_at timestamp, updated_at timestamp"
FILE_STATE = "path string, content_hash string, metadata_hash string, size long, mod_time timestamp, last_analyzed_at timestamp, analysis_version string, metadata_analyzed_at timestamp, semantic_analyzed_at timestamp, semantic_error string, semantic_retry_count int, embeddings_analyzed_at timestamp, embeddings_error string, embeddings_retry_count int"
FILE_DISCOVERY = "path string, content_hash string, size long, mod_time timestamp"
CRITICAL_EVENTS = "id long, event_type string, payload string, created_at timestamp"
PERSISTENCE_QUEUE = "id long, file_path string, content_hash string, result_json string, status string, retry_count int, error_message string, enqueued_at timestamp, updated_at timestamp"

#: Edge types, in the order of the data model.
RELATIONS = (
    "CONTAINS", "HAS_CHUNK", "HAS_TAG", "COVERS_TOPIC", "MENTIONS", "REFERENCES", "SIMILAR_TO", "DEPENDS_ON", "HAS_CODE_META", "HAS_DOC_META",
    "HAS_NOTEBOOK_META", "HAS_BUILD_META", "HAS_INFRA_META", "HAS_SCHEMA_META", "HAS_STRUCT_META", "HAS_SQL_META", "HAS_LOG_META", "HAS_EMBEDDING",
)


def schema(name: str) -> T.StructType:
    """The StructType of a table by its constant's name, such as 'FILES'."""
    return _struct(globals()[name])
