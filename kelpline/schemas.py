"""Schemas of the base tables. Flags are booleans inside and 0/1 at the boundary; money is
double; times are UTC. Columns that later versions of a table added have defaults, which
``with_columns_of`` fills in for older files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


TABLES: dict[str, str] = {
    "users": "user_id long, chat_id long, username string, first_name string, last_name string, display_name string, updated_at timestamp",
    "messages": "id long, chat_id long, message_id long, user_id long, username string, message_text string, message_type string, reply_to_message_id long, created_at timestamp",
    "user_aliases": "chat_id long, alias string, canonical_name string, created_by long, created_at timestamp",
    "expense_sessions": "chat_id long, session_id string, status string, created_at timestamp, closed_at timestamp, participants string",
    "expenses": "id long, chat_id long, session_id string, paid_by_user_id long, paid_by_name string, amount double, currency string, description string, merchant string, receipt_date string, split_among string, created_at timestamp, photo_file_id string",
    "face_registry": "id long, chat_id long, person_name string, user_id long, photo_file_id string, face_description string, registered_by_user_id long, created_at timestamp",
    "catches": "id long, chat_id long, user_id long, person_name string, fish_species string, fish_count int, estimated_weight_kg double, estimated_length_cm double, confidence string, photo_file_id string, analysis_text string, created_at timestamp, object_type string, species_confidence double, is_valid_catch int, rejection_reason string, fish_vision_version int",
    "locations": "chat_id long, user_id long, username string, latitude double, longitude double, updated_at timestamp",
    "weather_subs": "chat_id long, latitude double, longitude double, enabled int, last_sent string",
    "photo_schedules": "id long, chat_id long, target_user string, target_user_id long, send_time string, photo_count int, search_query string, enabled int, last_sent_date string, created_by long, created_at timestamp",
    "schema_version": "version int",
    "manifest": "filename string, msg_id long, timestamp long, timestamp_iso string, sender_name string, caption string, source string, license string, parse_error boolean",
    "audit": "filename string, sha256 string, width int, height int, max_side int, file_size long, low_res boolean, corrupt boolean",
    "clusters": "cluster_id int, cluster_type string, keep_filename string, duplicate_filenames array<string>, hamming_distance int, reason string",
    "provenance": "filename string, photo_id long, observation_id long, source string, license string, url string, observer string, observed_on string, taxon_identified string, quality_grade string, attribution string",
}

#: Defaults of columns.
DEFAULTS: dict[str, dict[str, object]] = {
    "messages": {"message_type": "text"},
    "expense_sessions": {"status": "active"},
    "expenses": {"currency": "RUB"},
    "catches": {"fish_count": 1, "object_type": "whole_fish", "species_confidence": 0.7, "is_valid_catch": 1, "fish_vision_version": 1},
    "weather_subs": {"enabled": 1},
    "photo_schedules": {"photo_count": 5, "enabled": 1},
}


def with_columns_of(df: DataFrame, table: str) -> DataFrame:
    """The columns of a base table in order and type: absent ones get their default, or null."""
    defaults = DEFAULTS.get(table, {})
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(TABLES[table])])
