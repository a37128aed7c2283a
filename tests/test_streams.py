"""The log of runs: what wins, replays, late batches, merges, and how much a batch writes."""

import random

import pytest

from plumbline.streaming import ingest


def batch(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, macro_id int, child_id int, chunk_id string, text string, page_number int").repartition(2)


@pytest.mark.parametrize("last", [True, False])
def test_log_equals_a_dictionary(spark, tmp_path, last):
    """Eighteen batches with repeated keys in and across batches; replays of single batches and of a merging one change nothing."""
    keyed = ingest.Keyed(("doc_id", "macro_id"), last, "chunk_id", falling=last)
    rng, path, want, batches = random.Random(0), str(tmp_path / "t"), {}, []
    for number in range(18):
        rows = [(rng.choice("ab"), rng.randrange(6), 0, f"{number:02d}-{k}", "x", 1) for k in range(5)]
        batches.append(rows)
        ingest.append(batch(spark, rows), number, path, keyed)
        if number in (2, 7, 15):
            ingest.append(batch(spark, rows), number, path, keyed)
        for r in sorted(rows, key=lambda r: r[3]):
            if last or r[:2] not in want:
                want[r[:2]] = r[3]
    assert {(r.doc_id, r.macro_id): r.chunk_id for r in ingest.read_table(spark, path, keyed).collect()} == want
    counted, inside = ingest.runs(spark, path)
    assert counted == [(0, 15), (16, 16), (17, 17)] and not inside
    for number in (0, 3, 15, 17):
        ingest.append(batch(spark, batches[number]), number, path, keyed)
    assert {(r.doc_id, r.macro_id): r.chunk_id for r in ingest.read_table(spark, path, keyed).collect()} == want


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    """A late batch of one row after a large one: the large run stays as it is, and the late row doesn't win where the first does."""
    path = str(tmp_path / "t")
    ingest.append(batch(spark, [("d", i, 0, f"c{i}", "x" * 200, 1) for i in range(2000)]), 0, path, ingest.CHUNKS)
    before = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    ingest.append(batch(spark, [("d", 7, 0, "late", "y", 1), ("d", 5000, 0, "new", "y", 1)]), 1, path, ingest.CHUNKS)
    after = {f: f.stat() for f in tmp_path.rglob("*.parquet")}
    assert all(after[f].st_mtime_ns == t for f, t in before.items())
    assert sum(s.st_size for f, s in after.items() if f not in before) < 0.5 * sum(f.stat().st_size for f in before)
    got = {r.macro_id: r.chunk_id for r in ingest.read_table(spark, path, ingest.CHUNKS).collect()}
    assert got[7] == "c7" and got[5000] == "new" and len(got) == 2001


def test_an_unfinished_run_counts_for_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    ingest.append(batch(spark, [("d", 1, 0, "a", "x", 1)]), 0, path, ingest.CHUNKS)
    (tmp_path / "t" / "run=000000000001-000000000001").mkdir()
    assert ingest.read_table(spark, path, ingest.CHUNKS).count() == 1
