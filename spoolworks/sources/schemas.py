"""The eight catalog tables: columns, keys, references and row checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    """checks: SQL conditions a row must not fail (null passes); references: column -> (table, column, on delete); unique_where:
    columns that are unique among the rows a condition holds for."""

    schema: T.StructType
    key: tuple[str, ...]
    unique: tuple[str, ...] = ()
    unique_where: tuple[tuple[str, ...], str] | None = None
    checks: dict[str, str] = field(default_factory=dict)
    references: dict[str, tuple[str, str, str]] = field(default_factory=dict)


TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _schema(text: str) -> T.StructType:
    """Columns as `name type [NOT NULL]`, without a session."""
    columns = [c.split() for c in text.split(", ")]
    return T.StructType([T.StructField(c[0], TYPES[c[1]], nullable=len(c) == 2) for c in columns])


# Tables, columns, keys, checks and references of the catalog.
CATALOG = {
    "projects": Table(_schema("id string NOT NULL, name string NOT NULL, created_at timestamp, updated_at timestamp"), ("id",)),
    "media_blobs": Table(
        _schema(
            "sha256 string NOT NULL, size_bytes bigint NOT NULL, stored_path string NOT NULL, container_format string, duration_seconds double, "
            "display_width int, display_height int, rotation_degrees int, fps_source double, fps_normalized double, is_variable_frame_rate boolean, "
            "video_codec string, audio_codec string, audio_sample_rate int, created_at timestamp"
        ),
        ("sha256",),
        checks={"size_not_negative": "size_bytes >= 0", "digest_length": "length(sha256) = 64"},
    ),
    "media_files": Table(
        _schema("id string NOT NULL, project_id string NOT NULL, sha256 string NOT NULL, display_name string NOT NULL, position int NOT NULL, added_at timestamp"),
        ("id",),
        unique=("project_id", "sha256"),
        references={"project_id": ("projects", "id", "cascade"), "sha256": ("media_blobs", "sha256", "restrict")},
    ),
    "derived_artifacts": Table(
        _schema("id string NOT NULL, sha256 string NOT NULL, artifact_kind string NOT NULL, params_version int NOT NULL, stored_path string NOT NULL, size_bytes bigint, created_at timestamp"),
        ("id",),
        unique=("sha256", "artifact_kind", "params_version"),
        checks={"version_positive": "params_version >= 1"},
        references={"sha256": ("media_blobs", "sha256", "cascade")},
    ),
    "scenes": Table(
        _schema(
            "id string NOT NULL, sha256 string NOT NULL, detector_params_version int NOT NULL, sequence_index int NOT NULL, start_seconds double NOT NULL, end_seconds double NOT NULL, "
            "start_frame_source int, end_frame_source int, sampled_frame_path string, motion_energy double, audio_energy double, energy_score double, created_at timestamp"
        ),
        ("id",),
        unique=("sha256", "detector_params_version", "sequence_index"),
        checks={"ends_after_start": "end_seconds > start_seconds", "index_not_negative": "sequence_index >= 0", "version_positive": "detector_params_version >= 1", "score_in_range": "energy_score BETWEEN 0 AND 100"},
        references={"sha256": ("media_blobs", "sha256", "cascade")},
    ),
    "scene_tag_cache": Table(
        _schema(
            "id string NOT NULL, scene_id string NOT NULL, prompt_version int NOT NULL, content_type string, exercise_guess string, environment string, lighting_quality string, "
            "lighting_temperature string, lighting_direction string, energy_level string, aesthetic_notes string, raw_response_json string, retrieved_at timestamp"
        ),
        ("id",),
        unique=("scene_id", "prompt_version"),
        checks={"version_positive": "prompt_version >= 1"},
        references={"scene_id": ("scenes", "id", "cascade")},
    ),
    "upload_sessions": Table(
        _schema(
            "id string NOT NULL, project_id string NOT NULL, display_name string NOT NULL, declared_size_bytes bigint NOT NULL, chunk_size_bytes int NOT NULL, bytes_received bigint NOT NULL, "
            "declared_sha256 string, part_path string, status string NOT NULL, created_at timestamp, updated_at timestamp"
        ),
        ("id",),
        unique_where=(("project_id", "declared_sha256"), "status = 'in_progress'"),
        checks={"declared_not_negative": "declared_size_bytes >= 0", "received_not_negative": "bytes_received >= 0", "chunk_positive": "chunk_size_bytes > 0", "known_status": "status IN ('in_progress', 'completed', 'aborted')"},
        references={"project_id": ("projects", "id", "cascade")},
    ),
    "jobs": Table(
        _schema(
            "id string NOT NULL, job_type string NOT NULL, status string NOT NULL, progress double NOT NULL, step string, error string, project_id string, sha256 string, "
            "created_at timestamp, updated_at timestamp, started_at timestamp, finished_at timestamp"
        ),
        ("id",),
        checks={"progress_in_range": "progress BETWEEN 0 AND 1", "known_status": "status IN ('queued', 'running', 'succeeded', 'failed', 'cancelled')"},
        references={"project_id": ("projects", "id", "cascade"), "sha256": ("media_blobs", "sha256", "cascade")},
    ),
}


def create_all(spark: SparkSession, database: str = "default", up: bool = True) -> None:
    """Creates the catalog's tables in a database of the warehouse, or drops them."""
    for name, spec in CATALOG.items():
        if up:
            spark.createDataFrame([], spec.schema).write.mode("ignore").format("parquet").saveAsTable(f"{database}.{name}")
        else:
            spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def missing_tables(spark: SparkSession, database: str = "default") -> set[str]:
    """Catalog tables that a database lacks."""
    return set(CATALOG) - {t.name for t in spark.catalog.listTables(database)}
