import hashlib

import pytest

from trackledger.operators import imports
from trackledger.sources import files


def test_a_completed_file_is_not_imported_again(spark):
    none = spark.createDataFrame([], imports.IMPORTS)
    one, needed = imports.start_import(none, "corpus", "abc", spark)
    assert needed and one.first().status == "running"
    failed = imports.end_import(one, "corpus", "abc", "x" * 3000)
    assert failed.first().status == "failed" and len(failed.first().summary) == 2000
    again, needed = imports.start_import(failed, "corpus", "abc", spark)
    assert needed and again.count() == 1
    done = imports.end_import(again, "corpus", "abc")
    assert imports.start_import(done, "corpus", "abc", spark)[1] is False and imports.start_import(done, "smart", "abc", spark)[1]


def test_drafts_are_saved_on_the_last_revision_only(spark):
    drafts = spark.createDataFrame([], "slug string, revision int, document string")
    one = imports.save_draft(drafts, "m", 0, "{}", spark)
    two = imports.save_draft(one, "m", 1, "[]", spark)
    assert sorted(r.revision for r in two.collect()) == [1, 2]
    with pytest.raises(imports.Conflict):
        imports.save_draft(two, "m", 1, "late", spark)


def test_archive_is_read_back_by_key(spark, tmp_path):
    body = b"\x00\x01 content"
    digest = hashlib.sha256(body).hexdigest()
    folder = tmp_path / "raw/td/2026/01/05"
    folder.mkdir(parents=True)
    (folder / f"{digest}.bin").write_bytes(body)
    row = files.archived(spark, str(tmp_path)).first()
    assert (row.object_key, row["size"], row.sha256) == (f"raw/td/2026/01/05/{digest}.bin", len(body), digest)


def test_objects_are_archived_and_listed_by_tasks(spark, tmp_path):
    objects = [(f"raw/{n % 3}/{n % 2}/{n}.bin", bytes([n]) * n) for n in range(20)]
    files.archive(spark.createDataFrame(objects, "object_key string, content binary").repartition(3), str(tmp_path))
    (tmp_path / "raw/0/_made").write_text("no object")
    (tmp_path / "raw/5").mkdir()
    found = files.archived(spark, str(tmp_path))
    assert {(r.object_key, r["size"], r.sha256) for r in found.collect()} == {(k, len(b), hashlib.sha256(b).hexdigest()) for k, b in objects}
    assert found.inputFiles() == []  # the driver holds no list of the objects
    assert files.archived(spark, str(tmp_path), digests=False).columns == ["object_key", "size"]
