"""The memory store's tables. Times are epoch seconds."""

SCHEMA_VERSION = 1
TABLES = {
    "wings": "id long, name string, description string, wing_type string, created_at long, updated_at long",
    "rooms": "id long, wing_id long, name string, description string, created_at long",
    "drawers": "id long, room_id long, content string, source_path string, source_type string, chunk_index int, content_hash string, created_at long",
    "vec_drawers": "id long, embedding array<float>",
    "entities": "id long, name string, entity_type string, first_seen long, last_seen long",
    "relationships": "id long, subject_id long, predicate string, object_id long, confidence double, valid_from long, valid_until long, source_drawer_id long, created_at long",
    "agent_diaries": "id long, agent_name string, entry string, session_id string, created_at long",
    "config": "key string, value string",
    "mined_files": "id long, path string, length long, modified timestamp",
    "mining_sessions": "id long, source_path string, file_count long, drawer_count long, started_at long, completed_at long",
}
