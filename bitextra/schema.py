"""Schemas of memories, glossaries, rules and settings."""

MEMORY = (
    "id bigint, source string, target string, context string, source_cmp string, source_len int, target_cmp string, reliability int, "
    "validated boolean, refcount int, created timestamp_ntz, modified timestamp_ntz, created_by string, modified_by string"
)
GLOSSARY = (
    "id bigint, term string, translation string, notes string, cmp string, translation_cmp string, reliability int, validated boolean, "
    "created timestamp_ntz, modified timestamp_ntz, created_by string, modified_by string"
)
RULES = "rule_id int, source_pattern string, target_template string, enabled boolean"
META = "key string, value string"
#: fixed values: settings of a new store
DEFAULTS = {"source_col": "A", "target_col": "B", "min_score": "0.7", "lang": "en"}
