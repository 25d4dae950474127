"""Constraints of the catalog on planted violations, evidence of files, and the schema before and after."""

from spoolworks.operators import catalog, constraints
from spoolworks.sources import files, schemas


def row(spec, **values):
    """A row of a table that breaks nothing, but for what is given."""
    sample = {"string": "x", "bigint": 1, "int": 1, "double": 0.5, "boolean": True}
    made = {f.name: sample.get(f.dataType.simpleString()) for f in spec.schema.fields}
    return {**made, **values}


def counts(spark, **tables):
    frames = {}
    for name, rows in tables.items():
        schema = schemas.T.StructType([schemas.T.StructField(f.name, f.dataType, True) for f in schemas.CATALOG[name].schema.fields])
        frames[name] = spark.createDataFrame([tuple(row(schemas.CATALOG[name], **r)[f.name] for f in schema.fields) for r in rows], schema)
    return {(r.table_name, r.kind, r.rule): r.rows for r in constraints.broken_constraints(frames).collect()}


def test_every_kind_of_violation_is_counted(spark):
    a, b = "a" * 64, "b" * 64
    found = counts(
        spark,
        projects=[{"id": "p"}, {"id": "p"}, {"id": "p"}, {"id": "q", "name": None}, {"id": None}, {"id": None}],
        media_blobs=[{"sha256": a}, {"sha256": b, "size_bytes": -1}, {"sha256": "short", "size_bytes": None}],
        media_files=[{"id": "1", "project_id": "p", "sha256": a}, {"id": "2", "project_id": "p", "sha256": a}, {"id": "3", "project_id": "nobody", "sha256": b}, {"id": "4", "project_id": "nobody", "sha256": "gone"}, {"id": "5", "project_id": None, "sha256": None}],
    )
    broken = {k: v for k, v in found.items() if v}
    assert broken == {
        ("projects", "not_null", "id"): 2,
        ("projects", "not_null", "name"): 1,
        ("projects", "unique", "id"): 2,  # rows beyond the first; nulls are distinct
        ("media_blobs", "not_null", "size_bytes"): 1,
        ("media_blobs", "check", "size_not_negative"): 1,  # null passes
        ("media_blobs", "check", "digest_length"): 1,
        ("media_files", "not_null", "project_id"): 1,
        ("media_files", "not_null", "sha256"): 1,
        ("media_files", "unique", "project_id, sha256"): 1,
        ("media_files", "reference", "project_id -> projects.id"): 2,
        ("media_files", "reference", "sha256 -> media_blobs.sha256"): 1,
    }


def test_a_partial_unique_and_empty_tables(spark):
    open_, done = {"project_id": "p", "declared_sha256": "d", "status": "in_progress"}, {"project_id": "p", "declared_sha256": "d", "status": "completed"}
    rows = [open_, open_, done, done, {**open_, "declared_sha256": None}, {**open_, "declared_sha256": None}]
    found = counts(spark, projects=[{"id": "p"}], upload_sessions=[{"id": str(i), **r} for i, r in enumerate(rows)])
    assert {k: v for k, v in found.items() if v} == {("upload_sessions", "unique", "project_id, declared_sha256"): 1}
    empty = counts(spark, projects=[], jobs=[])
    assert set(empty.values()) == {0} and ("jobs", "reference", "sha256 -> media_blobs.sha256") not in empty and ("jobs", "reference", "project_id -> projects.id") in empty


def test_every_constraint_of_the_catalog_is_there(spark):
    found = counts(spark, **{name: [] for name in schemas.CATALOG})
    for name, spec in schemas.CATALOG.items():
        assert {r for t, k, r in found if t == name and k == "check"} == set(spec.checks)
        assert {r for t, k, r in found if t == name and k == "not_null"} == {f.name for f in spec.schema.fields if not f.nullable}
        assert len([r for t, k, r in found if t == name and k == "reference"]) == len(spec.references)


def test_evidence_of_files(spark):
    plan = spark.createDataFrame([(1, "r1", "g1"), (2, "r1", "no"), (3, None, "g1"), (4, "no", None), (4, "no", None)], "id int, report string, gate string")
    listing = spark.createDataFrame([("r1",), ("r1",), ("g1",), (None,)], "name string")
    found = sorted((r.id, r.report_exists, r.gate_exists, r.status) for r in catalog.evidence(plan, listing).collect())
    assert found == [(1, True, True, "PASSED"), (2, True, False, "IN_PROGRESS"), (3, False, True, "IN_PROGRESS"), (4, False, False, "PENDING"), (4, False, False, "PENDING")]


def test_a_listing_reads_no_contents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.bin": b"xyz", "sub/b.bin": b"1"}.items():
        (tmp_path / name).write_bytes(data)
    found = files.listing(spark, f"file://{tmp_path}")
    assert sorted((r.name, r.length) for r in found.collect()) == [("a.bin", 3), ("b.bin", 1)]
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1].split("\n")[0]
