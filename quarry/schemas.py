"""Schemas of the engine's tables and records, as DDL."""

SOURCE = "is_url boolean, content string, source string"
SOURCE_SPEC = "type string, path string, recursive boolean, extensions array<string>, exclude array<string>, url string, headers map<string,string>, url_timeout_ms int"
CHUNK = "doc_uri string, chunk_id string, text string, metadata struct<token_count:bigint, start:bigint, end:bigint, unit:string, type:string>"
CHUNKS = "id bigint, content string, source_id string, unit string, type string, start_pos bigint, end_pos bigint, token_count bigint, created_at timestamp"
FILES = "path string, last_modified bigint, file_size bigint, nof_lines bigint, indexed_at timestamp"
VECTORS = "id bigint, embedding array<float>"
SEARCH_RESULT = "content string, source_id string, chunk_unit string, chunk_type string, chunk_id bigint, start bigint, end bigint, similarity_score float, distance float"
CHANGE = "path string, change_type string"
INSTANCES = ("id string, pid int, port int, host string, project_id string, name string, started_at bigint, started_at_str string, "
    "last_heartbeat bigint, last_heartbeat_str string, cwd string, config_path string, status string, created_at bigint, params string")
AUDIT = "id bigint, ts bigint, ts_str string, instance_id string, event string, message string, extra string"
API = ("id string, name string, url string, key string, model string, enabled boolean, context_length bigint, "
    "pricing struct<input:double, output:double, cached_input:double>")
EMBEDDING_RESPONSE = "array<struct<embedding:array<array<float>>>>"


def names(ddl: str) -> list[str]:
    """Column names of a flat schema."""
    return [field.split()[0] for field in ddl.split(", ")]
