"""The database as a whole: fixtures, a model-based test, recovery, maintenance, ingest, command line."""

import random

import pytest
from pyspark.sql import functions as F
from seqlake.__main__ import main
from seqlake.db import Database, Options, Snapshot
from seqlake.errors import Corruption, InvalidArgument, IoError, NotFound
from seqlake.functions.encoding import WriteBatch
from seqlake.operators import compaction, cursor, visibility
from seqlake.sources.manifest import Edit, Manifest, RunFile, Version
from seqlake.sources.mappings import SCHEMA

NEW = Options(create_if_missing=True)


def log_of(spark, rows):
    return spark.createDataFrame([(k.encode(), s, 0 if v is None else 1, (v or "").encode()) for k, s, v in rows], SCHEMA)


def pairs(frame):
    return [(bytes(r["k"]).decode(), bytes(r["v"]).decode()) for r in frame.collect()]


VERSIONS = [("a", 1, "a1"), ("a", 2, "a2"), ("a", 3, None), ("b", 1, "b1"), ("c", 1, "c1"), ("c", 2, None), ("d", 1, "d1")]


@pytest.mark.parametrize("sequence,keys", [(100, "bd"), (1, "abcd"), (2, "abd")])
def test_visibility(spark, sequence, keys):
    state = visibility.visible(log_of(spark, VERSIONS), sequence)
    assert "".join(k for k, _ in pairs(cursor.scan(state))) == keys
    assert "".join(k for k, _ in pairs(cursor.scan(state, reverse=True))) == keys[::-1]


def test_newest_wins(spark):
    log = log_of(spark, [("k", 1, "old"), ("k", 5, "new"), ("k", 20, None)])
    assert pairs(visibility.get(log, b"k", 3)) == [("k", "old")]
    assert pairs(visibility.get(log, b"k", 10)) == [("k", "new")]
    assert pairs(visibility.get(log, b"k", 100)) == []
    assert visibility.lookup(log, log.select("k"), 100).first()["state"] == "deleted"


def test_seek_and_steps(spark):
    state = log_of(spark, [(k, i, k) for i, k in enumerate(["10", "20", "30", "40"])]).select("k", "v")
    assert pairs(cursor.seek(state, b"25")) == [("30", "30")] and pairs(cursor.seek(state, b"41")) == []
    assert pairs(cursor.seek_for_prev(state, b"25")) == [("20", "20")]
    assert pairs(cursor.first(state)) == [("10", "10")] and pairs(cursor.last(state)) == [("40", "40")]
    steps = {bytes(r["k"]): (r["prev_key"] and bytes(r["prev_key"]), r["next_key"] and bytes(r["next_key"])) for r in cursor.stepped(state).collect()}
    assert steps == {b"10": (None, b"20"), b"20": (b"10", b"30"), b"30": (b"20", b"40"), b"40": (b"30", None)}
    assert cursor.empty(state).count() == 0


def test_merge_is_internal_order(spark):
    out = cursor.merged(log_of(spark, [("k", 3, "x"), ("z", 100, "z")]), log_of(spark, [("k", 5, "y")])).collect()
    assert [(bytes(r["k"]), r["seq"]) for r in out] == [(b"k", 5), (b"k", 3), (b"z", 100)]


def test_binary_keys_sort_as_unsigned_bytes(spark):
    keys = [b"", b"a", b"ab", b"\x7f", b"\x80", b"\xff"]
    state = spark.createDataFrame([(k, b"") for k in reversed(keys)], "k binary, v binary")
    assert [bytes(r["k"]) for r in cursor.scan(state).collect()] == keys


def test_compaction_keeps_what_snapshots_see(spark):
    """visible(S', compact(log, S)) == visible(S', log) for every S' >= S, below an older level that covers some keys."""
    rng = random.Random(11)
    for _ in range(3):
        rows = [(rng.choice("abcdefgh"), s, None if rng.random() < 0.4 else str(s)) for s in range(1, 60)]
        old, new = [r for r in rows if r[1] <= 20], [r for r in rows if r[1] > 20]
        lo, hi = min(r[0] for r in old), max(r[0] for r in old)
        deeper = spark.createDataFrame([(lo.encode(), hi.encode())], "lo binary, hi binary")
        for snapshot in (25, 59):
            kept = compaction.compacted(log_of(spark, new), snapshot, deeper).unionByName(log_of(spark, old)).cache()
            for s in (snapshot, 45, 59):
                if s >= snapshot:
                    assert pairs(cursor.scan(visibility.visible(kept, s))) == pairs(cursor.scan(visibility.visible(log_of(spark, rows), s)))


def test_model(spark, tmp_path):
    """Random batches, snapshots, flushes, compactions and reopenings against a dictionary."""
    rng = random.Random(3)
    options = Options(create_if_missing=True, max_file_size=2000)
    db, state, held = Database.open(spark, f"file://{tmp_path}/db", options), {}, []
    for step in range(14):
        batch = WriteBatch()
        for _ in range(rng.randint(1, 12)):
            key = b"k%02d" % rng.randint(0, 20)
            if rng.random() < 0.3:
                batch.delete(key)
                state.pop(key, None)
            else:
                value = b"v%d" % rng.randint(0, 999)
                batch.put(key, value)
                state[key] = value
        db.write(batch)
        if step in (3, 8):
            held.append((db.snapshot(), dict(state)))
        if step in (2, 5, 7, 11):
            db.flush()
        if step in (6, 12):
            db.compact_range()
        if step == 9:
            db.close()
            db, held = Database.open(spark, f"file://{tmp_path}/db", options), []
        if step in (4, 6, 9, 12, 13):
            assert [(bytes(r["k"]), bytes(r["v"])) for r in db.scan().collect()] == sorted(state.items())
            for snap, then in held:
                assert [(bytes(r["k"]), bytes(r["v"])) for r in db.scan(snap).collect()] == sorted(then.items())
    key = next(iter(state))
    assert db.get(key) == state[key]
    with pytest.raises(NotFound):
        db.get(b"absent")
    db.close()


def test_scan_across_a_flush_and_snapshot(spark, tmp_path):
    with Database.open(spark, f"file://{tmp_path}/db", NEW) as db:
        rows = spark.range(4000).select(F.format_string("key-%06d", "id").cast("binary").alias("k"), F.lit(1).alias("op"), F.concat(F.lit("value-"), F.col("id")).cast("binary").alias("v"), "id")
        db.write_table(rows, [F.col("id")])
        db.flush()
        snap = db.snapshot()
        db.delete(b"key-000042")
        assert db.version.last_sequence == 4001
        with pytest.raises(NotFound):
            db.get(b"key-000042")
        assert db.get(b"key-000042", snap) == b"value-42"
        assert db.scan().count() == 3999 and db.scan(snap, reverse=True).first()["k"] == b"key-003999"
        assert db.scan(low=b"key-000010", high=b"key-000020").count() == 10
        db.release(snap)
        with pytest.raises(InvalidArgument):
            db.release(snap)
        db.compact_range()
        assert db.log().count() == 3999


def test_unflushed_batches_survive(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    with Database.open(spark, path, NEW) as db:
        db.put(b"a", b"1")
        db.put(b"b", b"2")
        db.delete(b"a")
        db.delete(b"never there")
    with Database.open(spark, path) as db:
        assert pairs(db.scan()) == [("b", "2")]
        assert db.get(b"b") == b"2"
        db.put(b"b", b"")
        assert db.get(b"b") == b""


def test_torn_commit_is_ignored(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    with Database.open(spark, path, NEW) as db:
        db.put(b"a", b"1")
        db.files.write(db.manifest.name(db.version.id + 1), '{"last_sequence": 99, "log_add": ["log/none"]}')
    with Database.open(spark, path) as db:
        assert db.version.last_sequence == 1 and pairs(db.scan()) == [("a", "1")]


def test_locks_and_options(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    with pytest.raises(InvalidArgument):
        Database.open(spark, path)
    with Database.open(spark, path, NEW):
        with pytest.raises(IoError):
            Database.open(spark, path)
    with pytest.raises(InvalidArgument):
        Database.open(spark, path, Options(error_if_exists=True))
    with pytest.raises(InvalidArgument):
        Database.open(spark, path, Options(comparator="reverse"))
    Database.open(spark, path).close()
    assert Options(write_buffer_size=1).write_buffer_size == 64 << 10


def test_missing_files_are_corruption(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    with Database.open(spark, path, NEW) as db:
        db.put(b"a", b"1")
        db.flush()
        db.files.remove(db.version.files[0].path)
    with pytest.raises(Corruption):
        Database.open(spark, path)


def test_writes_stop_for_a_full_level_0(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(compaction, "L0_SLOWDOWN", 1)
    monkeypatch.setattr(compaction, "L0_STOP", 2)
    with Database.open(spark, f"file://{tmp_path}/db", NEW) as db:
        said = []
        for i in range(6):
            db.write(WriteBatch().put(b"a", b"%d" % i).put(b"z", b"%d" % i))
            db.flush()
            said.append(db.pressure())
        assert {"none", "slow", "stop"} >= set(said) > {"stop"}
        db.put(b"m", b"m")
        assert db.pressure() == "none"
        assert pairs(db.scan()) == [("a", "5"), ("m", "m"), ("z", "5")]
        assert db.approximate_size(b"b", b"c") <= db.approximate_size() == sum(f.file_size for f in db.version.files) > 0
        assert db.approximate_size() < 1 << 20  # all filters together are smaller than one of the fixed default size
        assert db.approximate_size(b"zz") == 0


def test_maintenance(spark, tmp_path):
    """Overlapping flushes pile up in level 0; maintenance moves them; pinned files outlive it, obsolete ones do not."""
    with Database.open(spark, f"file://{tmp_path}/db", Options(create_if_missing=True, retain_seconds=0)) as db:
        for i in range(4):
            db.write(WriteBatch().put(b"a", b"%d" % i).put(b"z", b"%d" % i))
            db.flush()
        assert len(db.version.level(0)) >= 2
        before = db.pin()
        for i in range(4, 7):
            db.write(WriteBatch().put(b"a", b"%d" % i).put(b"z", b"%d" % i))
            db.flush()
        assert db.pick() is not None
        db.maintain()
        assert not db.version.level(0) and db.pick() is None
        assert db.log(version=before).count() == 8 and db.log().count() <= 4
        db.unpin(before)
        assert db.vacuum() and not db.vacuum()
        assert pairs(db.scan()) == [("a", "6"), ("z", "6")]
        assert compaction.level_scores(db.file_table()).count() >= 1


def test_level_functions(spark):
    assert compaction.trivial(1, 0, 20 << 20) and not compaction.trivial(1, 0, (20 << 20) + 1) and not compaction.trivial(2, 0, 0)
    files = spark.createDataFrame([(0, i, 1 << 20, b"a", b"b") for i in range(3)] + [(1, 9, 30 << 20, b"a", b"z")], "level int, number long, file_size long, smallest binary, largest binary")
    assert {r["level"]: round(r["score"], 3) for r in compaction.level_scores(files).collect()} == {0: 0.75, 1: 3.0}
    assert compaction.due(files).first()["level"] == 1
    assert {r["allowed_seeks"] for r in compaction.seek_budgets(files).collect()} == {100, 1920}
    snaps = spark.createDataFrame([(10,), (5,), (20,)], "sequence long")
    assert compaction.smallest_snapshot(snaps, 99) == 5 and compaction.smallest_snapshot(snaps.where("false"), 99) == 99


def test_islands_and_overlaps_are_brute_force(spark):
    rng = random.Random(4)
    for _ in range(3):
        spans = []
        for i in range(25):
            a = rng.randint(0, 300)
            spans.append((0, i, 1, b"%03d" % a, b"%03d" % (a + rng.randint(0, 12))))
        files = spark.createDataFrame(spans, "level int, number long, file_size long, smallest binary, largest binary")
        want = {(x[1], y[1]) for x in spans for y in spans if x[1] < y[1] and x[3] <= y[4] and y[3] <= x[4]}
        assert {(r["a"], r["b"]) for r in compaction.overlaps(files).collect()} == want
        low, high = b"100", b"110"
        chosen = {s[1] for s in spans if s[4] >= low and s[3] <= high}
        while True:
            more = {b for a, b in want | {(y, x) for x, y in want} if a in chosen} | chosen
            if more == chosen:
                break
            chosen = more
        assert {r["number"] for r in compaction.inputs(files, 0, low, high).collect()} == chosen


def test_manifest_replay():
    f = RunFile(1, 8, "runs/8", 4096, 3, "61", "62", 1, 3)
    version = Version().after(Edit(add=[f], last_sequence=5), 1).after(Edit(remove=[(1, 8)]), 2)
    assert not version.files and version.last_sequence == 5
    assert version.after(Edit(add=[f], remove=[(1, 8)]), 3).files == (f,)
    assert Edit.decoded(Edit(add=[f], log_remove=["x"], pointers={"1": "61"}).encoded()) == Edit(add=[f], log_remove=["x"], pointers={"1": "61"})
    assert Version().after(version.whole(), 9).last_sequence == 5
    for bad in ('{"what": 1}', "{", '{"add": [{"level": 7, "number": 1, "path": "", "file_size": 0, "rows": 0, "smallest": "", "largest": "", "smallest_seq": 0, "largest_seq": 0}]}'):
        with pytest.raises(Corruption):
            Edit.decoded(bad)
    with pytest.raises(Corruption):
        version.after(Edit(last_sequence=4), 3)


def test_current_needs_its_new_line(spark, tmp_path):
    with Database.open(spark, f"file://{tmp_path}/db", NEW) as db:
        db.files.write("CURRENT", "1", overwrite=True)
        with pytest.raises(Corruption):
            Manifest(db.files).load()


def test_streaming_ingest(spark, small, tmp_path):
    from seqlake.sources.mappings import events_log
    from seqlake.streaming.ingest import ingest

    log = events_log(spark, small)
    log.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with Database.open(spark, f"file://{tmp_path}/db", NEW) as db:
        records = stream.withColumnRenamed("seq", "at")
        ingest(records, db, [F.col("at")], "events", f"{tmp_path}/check").awaitTermination()
        assert db.version.last_sequence == log.count() and dict(db.version.stream)["events"] == 2
        db.write_table(log.withColumnRenamed("seq", "at"), [F.col("at")], ("events", 2))  # repeated: left out
        assert db.version.last_sequence == log.count()
        assert db.state().select("k").distinct().count() > 0


def test_command_line(spark, tmp_path, capsys):
    db = f"file://{tmp_path}/db"
    for args in (["put", db, "alpha", "one"], ["put", db, "beta", "two"], ["get", db, "beta"], ["del", db, "alpha"], ["scan", db], ["compact", db], ["get", db, "alpha"], ["scan", db]):
        assert main(args, spark) == 0
    got = capsys.readouterr()
    assert got.out.split("\n") == ["two", "beta => two", "beta => two", ""]
    assert "not found" in got.err and "compaction complete" in got.err


def test_a_failed_write_is_sticky(spark, tmp_path, monkeypatch):
    with Database.open(spark, f"file://{tmp_path}/db", NEW) as db:
        db.put(b"a", b"1")
        monkeypatch.setattr(db.manifest, "commit", lambda *a: (_ for _ in ()).throw(IoError("full")))
        with pytest.raises(IoError):
            db.put(b"b", b"2")
        with pytest.raises(IoError):
            db.put(b"c", b"3")
        assert pairs(db.scan()) == [("a", "1")]
        assert isinstance(db.snapshot(), Snapshot)


KILLED = """
import os, signal, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from seqlake.db import Database, Options
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
db = Database.open(spark, {path!r}, Options(create_if_missing=True))
db.put(b"a", b"1")
db.put(b"b", b"2")
db.files.write("log/000099/part-0.parquet", "torn")
os.kill(os.getpid(), signal.SIGKILL)
"""


def test_a_killed_writer_locks_no_one_out(spark, tmp_path):
    import os
    import subprocess
    import sys

    path = f"file://{tmp_path}/db"
    code = KILLED.format(root=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), path=path)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=120)
    assert done.returncode == -9
    with Database.open(spark, path, Options(retain_seconds=0)) as db:
        assert pairs(db.scan()) == [("a", "1"), ("b", "2")]
        assert not db.files.exists("log/000099")
        db.put(b"c", b"3")
    assert not db.files.exists("LOCK")


def test_a_lease_runs_out_and_is_fenced(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    first = Database.open(spark, path, Options(create_if_missing=True, lease_seconds=0.5))
    first.put(b"a", b"1")
    first.lock._gone.set()  # as if its machine had stopped
    import time

    time.sleep(1.2)
    with Database.open(spark, path) as second:
        with pytest.raises(IoError):
            first.put(b"a", b"lost")
        assert pairs(second.scan()) == [("a", "1")]
    first.close()


def test_a_lease_is_held_while_it_is_renewed(spark, tmp_path):
    import threading

    from seqlake.sources.files import Files
    from seqlake.sources.leases import Lease

    files = Files(spark, f"file://{tmp_path}")
    lease, over, failed = Lease(files, "LOCK", 30), threading.Event(), []

    def renew():
        while not over.is_set():
            try:
                lease.renew()
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    renewers = [threading.Thread(target=renew) for _ in range(2)]
    for renewer in renewers:
        renewer.start()
    try:
        for _ in range(40):
            assert lease.held()
            with pytest.raises(IoError):
                Lease(files, "LOCK", 60)
    finally:
        over.set()
        for renewer in renewers:
            renewer.join(30)
    assert not failed
    lease.release()
    lease.renew()
    assert not lease.held() and files.list() == []


def test_one_of_many_takes_an_ended_lease(spark, tmp_path):
    import threading
    import time

    from seqlake.sources import leases
    from seqlake.sources.files import Files

    files = Files(spark, f"file://{tmp_path}")
    for turn in range(5):
        name, won, start = f"LOCK{turn}", [], threading.Barrier(6)
        first = leases.Lease(files, name, 0.2)
        first._gone.set()  # as if its machine had stopped
        time.sleep(0.3)

        def take():
            start.wait()
            try:
                won.append(leases.Lease(files, name, 30))
            except IoError:
                pass

        takers = [threading.Thread(target=take) for _ in range(6)]
        for taker in takers:
            taker.start()
        for taker in takers:
            taker.join(30)
        assert [lease.held() for lease in won] == [True] and not first.held()
        first._gone.clear()
        first.renew()  # it has run out, so it must not come back
        assert won[0].held()
        won[0].release()


def test_an_unreadable_lease_is_held_until_it_is_old(spark, tmp_path):
    import os
    import time

    from seqlake.sources import leases
    from seqlake.sources.files import Files

    files = Files(spark, f"file://{tmp_path}")
    os.makedirs(tmp_path / "pins")
    for name in ("LOCK", "pins/torn.json"):
        (tmp_path / name).write_text('{"owner": "')
    with pytest.raises(IoError):
        leases.Lease(files, "LOCK", 30)
    with pytest.raises(IoError):
        leases.payloads(files, "pins")
    for name in ("LOCK", "pins/torn.json"):
        os.utime(tmp_path / name, (time.time() - 100,) * 2)
    assert leases.payloads(files, "pins") == [] and not (tmp_path / "pins/torn.json").exists()
    assert leases.Lease(files, "LOCK", 30).held()


def test_readers_outlive_maintenance(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    with Database.open(spark, path, NEW) as db:
        db.put(b"a", b"1")
        planned = db.scan()
        db.flush()
        db.compact_range()
        assert pairs(planned) == [("a", "1")]  # planned before, run after
    with Database.open(spark, path, Options(retain_seconds=0)) as db:
        other = Database.reader(spark, path)
        db.put(b"a", b"2")
        db.flush()
        db.compact_range()
        assert pairs(other.scan()) == [("a", "1")] and other.get(b"a", verify=True) == b"1"
        with pytest.raises(IoError):
            other.put(b"x", b"y")
        other.close()
        assert db.vacuum() and pairs(db.scan()) == [("a", "2")]
        db.manifest.WHOLE_EVERY = 1
        db.put(b"b", b"3")
        db.vacuum()
        assert db.files.list("manifest") == [f"{db.version.id:06d}.json"]
    with Database.open(spark, path) as db:
        assert pairs(db.scan()) == [("a", "2"), ("b", "3")]


def test_waiting_writers_join_a_group(spark, tmp_path):
    import threading

    with Database.open(spark, f"file://{tmp_path}/db", NEW) as db:
        commits, plain = [], db._append
        started, go = threading.Event(), threading.Event()

        def slow(rows, n, stream=None, sync=False):
            commits.append((n, sync))
            if len(commits) == 1:
                started.set()
                go.wait(30)
            plain(rows, n, stream, sync)

        db._append = slow
        threads = [threading.Thread(target=db.write, args=(WriteBatch().put(b"k%d" % i, b"v"),), kwargs={"sync": i == 5}) for i in range(6)]
        threads[0].start()
        started.wait(30)
        for i, t in enumerate(threads[1:], 1):
            t.start()
            while len(db._queue) <= i:
                pass
        go.set()
        for t in threads:
            t.join(60)
        assert commits == [(1, False), (4, False), (1, True)]  # the synced one joins no group that is not
        assert db.version.last_sequence == 6 and db.scan().count() == 6


def test_spent_seeks_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(compaction, "LEAST_SEEKS", 3)
    monkeypatch.setattr(compaction, "SEEK_BYTES", 1 << 30)
    with Database.open(spark, f"file://{tmp_path}/db", NEW) as db:
        for i in range(2):
            db.write(WriteBatch().put(b"a", b"%d" % i).put(b"z", b"%d" % i))
            db.flush()
        files = len(db.version.files)
        assert files == 2 and db.pick() is None
        for _ in range(3):
            assert db.get(b"a") == b"1"
        level, chosen = db.pick()
        assert db.seek_file in chosen and level == db.seek_file.level
        db.maintain()
        assert db.pick() is None and len(db.version.files) < files and db.get(b"z") == b"1"


def test_a_full_log_is_flushed(spark, tmp_path):
    with Database.open(spark, f"file://{tmp_path}/db", Options(create_if_missing=True, write_buffer_size=1)) as db:
        db.put(b"a", bytes(random.Random(1).randbytes(100_000)))
        assert not db.version.logs and db.version.files and db.newest() == db.oldest() == 1
