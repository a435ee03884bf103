import random

import pytest

from keelstone import errors
from keelstone.config import TableConfig, TableConfigOverride
from keelstone.functions.codecs import INT64, UTF8
from keelstone.functions.resolvers import FIRST, SUM, concat
from keelstone.operators import simple, snapshot, union
from keelstone.operators.cursor import Cursor
from keelstone.operators.session import Session
from keelstone.operators.table import BlobRef, Delete, Insert, Range, Table, Upsert
from keelstone.sources.scratch import session_root
from tests.model import Model


@pytest.fixture()
def session(spark):
    with Session.open(spark, session_root(spark)) as s:
        yield s


def text_table(session, **k):
    return Table(session, INT64, "string", concat(" "), **k)


def shown(t):
    return sorted((r["k"], r["v"]) for r in t.state().collect())


def test_worked_examples(session):
    t = text_table(session)
    assert not t.lookup(0).found and not t.member(0)
    t.inserts([(0, "Hello", b"World"), (1, "World")])
    r = t.lookup(0)
    assert (r.found, r.value) == (True, "Hello") and t.retrieve_blobs([r.blob]) == [b"World"]
    assert t.members([1, 5, 0, 1]) == [True, False, True, True]
    t.upsert(0, "Goodbye")
    assert t.lookup(0).value == "Goodbye Hello" and t.lookup(0).blob is None
    t.insert(0, "Goodbye")
    t.delete(1)
    t.delete(9)
    assert shown(t) == [(0, "Goodbye")]
    t.updates([(4, Insert("a")), (4, Delete()), (4, Upsert("b")), (4, Upsert("c"))])
    assert t.lookup(4).value == "c b"
    with pytest.raises(errors.BlobRefInvalidError) as e:
        t.retrieve_blobs([r.blob, BlobRef(r.blob.run, 77)])
    assert e.value.index == 1


def test_duplicates_unions_and_debt(session):
    a, b = text_table(session), text_table(session)
    a.insert(0, "Hello", b"left")
    b.inserts([(0, "World", b"right"), (1, "Goodbye", b"one")])
    d = a.duplicate()
    d.insert(5, "x")
    assert shown(a) == [(0, "Hello")] and shown(d) == [(0, "Hello"), (5, "x")]
    u = union.union(a, b)
    want = [(0, "Hello World"), (1, "Goodbye")]
    assert shown(u) == want and union.remaining_union_debt(u) == 0
    assert u.retrieve_blobs([r.blob for r in u.lookups([0, 1])]) == [b"left", b"one"]
    lazy = union.incremental_union(a, b)
    debt = union.remaining_union_debt(lazy)
    assert debt == 4 and union.supply_union_credits(lazy, 0) == 0 and union.supply_union_credits(lazy, -3) == 0
    while union.remaining_union_debt(lazy):
        before = union.remaining_union_debt(lazy)
        left = union.supply_union_credits(lazy, 1)
        assert union.remaining_union_debt(lazy) <= before - 1 and (not left or not union.remaining_union_debt(lazy))
        assert shown(lazy) == want
    assert union.supply_union_credits(lazy, 4) == 4
    assert union.remaining_union_debt(a) == 0 and union.supply_union_credits(a, 42) == 42
    lazy.upsert(0, "Oh")
    lazy.delete(1)
    assert shown(lazy) == [(0, "Oh Hello World")]
    lazy.compact()
    assert shown(lazy) == [(0, "Oh Hello World")]
    one = union.unions([a])
    a.insert(7, "later")
    assert shown(one) == [(0, "Hello")] and shown(union.unions([a, a])) == [(0, "Hello Hello"), (7, "later later")]
    with pytest.raises(errors.TableUnionNotCompatibleError) as e:
        union.unions([a, a, Table(session, INT64, "bigint", SUM)])
    assert (e.value.first, e.value.other) == (0, 2)


def test_cursors(session):
    t = Table(session, INT64, "string", FIRST)
    t.inserts([(k, f"v{k}", b"b") for k in [3, -1, 0, 8, 5, -7]])
    t.delete(5)
    order = [0, 3, 8, -7, -1]
    c = Cursor(t)
    assert [e.key for e in c.take(2)] == order[:2]
    t.insert(4, "new")
    assert c.next().key == 8 and [e.key for e in c.take(10)] == [-7, -1] and c.next() is None and c.take(3) == []
    at = Cursor(t, 4)
    assert [e.key for e in at.take_while(9, lambda k: k != -7)] == [4, 8]
    assert [e.key for e in at.take(1)] == [-7]
    assert [e.key for e in Cursor(t).take_while(32, lambda k: k < 4)] == [0, 3]
    assert [e.key for e in Cursor(t).take_while(2, lambda k: k < 9)] == [0, 3]
    assert [e.key for e in t.range_lookup(Range(0, 4))] == [0, 3] and [e.key for e in t.range_lookup(Range(0, 4, True))] == [0, 3, 4]
    assert t.range_lookup(Range(-5, 5)) == [] and t.range_lookup(Range(4, 4)) == [] and [e.key for e in t.range_lookup(Range(8, -7, True))] == [8, -7]
    stable = Cursor(t)
    t.close()
    assert stable.next().key == 0
    stable.close()
    stable.close()
    with pytest.raises(errors.CursorClosedError):
        stable.next()


def test_snapshots(spark, session):
    a, b = text_table(session), text_table(session)
    a.insert(0, "Hello", b"blob")
    b.insert(0, "World")
    u = union.incremental_union(a, b)
    u.upsert(2, "two")
    u.insert(3, "three", b"3")
    snapshot.save_snapshot(u, "one", "words")
    u.insert(9, "after")
    t = snapshot.open_table_from_snapshot(session, "one", "words")
    again = snapshot.open_table_from_snapshot(session, "one", "words", override=TableConfigOverride(merge_batch=7))
    assert shown(t) == shown(again) == [(0, "Hello World"), (2, "two"), (3, "three")] and again.config.merge_batch == 7
    assert t.retrieve_blobs([r.blob for r in t.lookups([0, 3])]) == [b"blob", b"3"]
    t.insert(2, "changed")
    assert shown(again)[1] == (2, "two")
    for bad, error in [("Upper", errors.InvalidSnapshotNameError), ("con", errors.InvalidSnapshotNameError), ("a" * 65, errors.InvalidSnapshotNameError)]:
        with pytest.raises(error):
            snapshot.save_snapshot(u, bad, "words")
    with pytest.raises(errors.SnapshotExistsError):
        snapshot.save_snapshot(u, "one", "words")
    with pytest.raises(errors.SnapshotNotCompatibleError):
        snapshot.open_table_from_snapshot(session, "one", "numbers")
    with pytest.raises(errors.SnapshotDoesNotExistError):
        snapshot.open_table_from_snapshot(session, "none", "words")
    out = session.root + "-out"
    snapshot.export_snapshot(session, "one", out)
    with pytest.raises(errors.SnapshotExportDirExistsError):
        snapshot.export_snapshot(session, "one", out)
    snapshot.import_snapshot(session, "two", out)
    with pytest.raises(errors.SnapshotImportDirDoesNotExistError):
        snapshot.import_snapshot(session, "three", out + "-none")
    assert snapshot.list_snapshots(session) == ["one", "two"] and snapshot.does_snapshot_exist(session, "two")
    # One flipped bit anywhere is found.
    part = session.run_path(t.content.runs[0].name)
    name = next(n for n in session.files.names(part) if n.startswith("part-"))
    whole = session.files.read(f"{part}/{name}")
    data = bytearray(whole)
    data[len(data) // 2] ^= 4
    session.files.write(f"{part}/{name}", bytes(data), overwrite=True)
    with pytest.raises(errors.SnapshotCorruptedError):
        snapshot.open_table_from_snapshot(session, "two", "words")
    session.files.write(f"{part}/{name}", whole, overwrite=True)
    snapshot.delete_snapshot(session, "two")
    with pytest.raises(errors.SnapshotDoesNotExistError):
        snapshot.delete_snapshot(session, "two")
    root = session.root
    session.close()
    with Session.restore(spark, root) as s:
        assert shown(snapshot.open_table_from_snapshot(s, "one", "words")) == [(0, "Hello World"), (2, "two"), (3, "three")]


def test_sessions_and_closed_handles(spark):
    events = []
    root = session_root(spark)
    with pytest.raises(errors.SessionDirDoesNotExistError):
        Session.open(spark, root + "/none")
    s = Session.new(spark, root, salt=17)
    with pytest.raises(errors.SessionDirLockedError):
        Session.open(spark, root)
    t = Table(s)
    t.insert(1, 2)
    c = Cursor(t)
    other = t.duplicate()
    other.close()
    other.close()
    with pytest.raises(errors.TableClosedError):
        other.lookup(1)
    s.close()
    s.close()
    for call in (lambda: t.lookup(1), lambda: Table(s), lambda: snapshot.list_snapshots(s)):
        with pytest.raises((errors.SessionClosedError, errors.TableClosedError)):
            call()
    with pytest.raises(errors.CursorClosedError):
        c.next()
    with pytest.raises(errors.SessionDirCorruptedError):
        Session.new(spark, root)
    from keelstone.trace import Tracer

    again = Session.restore(spark, root, salt=5, tracer=Tracer(lambda *e: events.append(e[2])))
    assert again.salt == 17
    again.close()
    assert events == ["restore_session", "opened_session", "close_session", "closed_session"]
    empty = session_root(spark)
    with pytest.raises(errors.SessionDirCorruptedError):
        Session.restore(spark, empty)


def test_a_cut_run_is_an_error(session):
    t = text_table(session)
    t.insert(1, "one")
    t.flush()
    run = session.run_path(t.content.runs[0].name)
    for name in session.files.names(run):
        if name.startswith("part-"):
            session.files.write(f"{run}/{name}", b"cut", overwrite=True)
    with pytest.raises(errors.TableCorruptedError):
        t.lookup(1)


def test_simple_tables(session):
    a, b = simple.SimpleTable(session, UTF8, "bigint"), simple.SimpleTable(session, UTF8, "bigint")
    a.inserts([("x", 1), ("y", 2)])
    a.update("y", None)
    b.updates([("x", 9), ("z", 3), ("w", None)])
    u = simple.incremental_union(a, b)
    assert u.lookups(["x", "y", "z"]) == [1, None, 3] and u.members(["w", "z"]) == [False, True]
    assert u.remaining_union_debt() > 0 and u.supply_union_credits(100) > 0
    with u.cursor("xx") as c:
        assert c.take(5) == [("z", 3)] and c.next() is None
    assert u.range_lookup(Range("x", "z")) == [("x", 1)]
    u.save_snapshot("s", "l")
    assert simple.open_table_from_snapshot(session, "s", "l").lookup("z") == 3
    assert simple.union(a, b).duplicate().lookup("x") == 1


def test_settings(session):
    for bad in ({"size_ratio": 5}, {"write_buffer": 0}, {"merge_batch": 9, "write_buffer": 8}, {"bloom": 2.0}, {"merge_schedule": "never"}):
        with pytest.raises(ValueError):
            TableConfig(**bad)
    t = Table(session, config=TableConfig(write_buffer=10, merge_batch=10, merge_schedule="one_shot"))
    for i in range(6):
        t.insert(i % 4, i)
    assert len(t.content.runs) < 4 and shown(t) == [(0, 4), (1, 5), (2, 2), (3, 3)]


def test_bloom_settings():
    assert TableConfig(bloom="bits:10").false_positives() == pytest.approx(0.0085, abs=2e-4)
    assert TableConfig(bloom="bits:16").write_options()["parquet.bloom.filter.fpp#k"] < TableConfig(bloom="bits:8").write_options()["parquet.bloom.filter.fpp#k"]
    for bad in ("bits:", "bits:-3", "bits:0", "10", "rate:9", "bits:x"):
        with pytest.raises(ValueError):
            TableConfig(bloom=bad)


@pytest.mark.parametrize("schedule", ["one_shot", "incremental"])
def test_levels_keep_runs_few_and_the_state(session, schedule):
    """Forty runs of three entries: level one holds fewer than twice four, and so does each above it."""
    t = text_table(session, config=TableConfig(write_buffer=3, merge_batch=3, merge_schedule=schedule))
    m = Model(lambda new, old: f"{new} {old}")
    most = 0
    for i in range(40):
        batch = [((5 * i + j) % 23, "IUD"[(i + j) % 3], f"{i}.{j}" if (i + j) % 3 < 2 else None, None) for j in range(3)]
        t.updates([(k, Insert(v) if op == "I" else Upsert(v) if op == "U" else Delete()) for k, op, v, _ in batch])
        m.apply(batch)
        most = max(most, len(t.content.runs))
        levels = [t.level(r) for r in t.content.runs]
        assert all(levels.count(x) < (4 if schedule == "one_shot" else 8) for x in levels)
    assert most <= (9 if schedule == "one_shot" else 16) and not t.content.buffer
    assert shown(t) == [(k, v) for k, v, _ in m.sorted()]
    t.supply_merge_credits(10**6)
    assert not t.due() and shown(t) == [(k, v) for k, v, _ in m.sorted()]
    # The last level has dropped deletes.
    t.compact()
    assert len(t.content.runs) == 1 and t.read_runs(t.content.runs).where("op <> 'I'").isEmpty()


def test_the_buffer_is_part_of_every_copy(session):
    t = text_table(session)
    t.inserts([(1, "a", b"one"), (2, "b")])
    assert not t.content.runs and len(t.content.buffer) == 2
    d, c = t.duplicate(), Cursor(t)
    u = union.incremental_union(t, d)
    t.upsert(1, "c")
    t.flush()
    t.flush()
    assert len(t.content.runs) == 1 and not t.content.buffer
    assert shown(t) == [(1, "c a"), (2, "b")] and shown(d) == [(1, "a"), (2, "b")] == [(e.key, e.value) for e in c.take(9)]
    assert shown(u) == [(1, "a a"), (2, "b b")] and u.retrieve_blobs([u.lookup(1).blob]) == [b"one"]
    with pytest.raises(Exception):
        t.insert("no number", "x")
    assert shown(t) == [(1, "c a"), (2, "b")]


def test_a_lookup_opens_only_the_runs_that_may_hold_the_key(session):
    t = text_table(session)
    for at in (0, 100, 200):
        t.inserts([(at + i, f"v{at + i}") for i in range(5)])
        t.flush()
    assert [len(t.log(keys=[k]).inputFiles()) for k in (2, 101, 50)] == [1, 1, 0]
    assert [r.value for r in t.lookups([2, 101, 50, 204, 2])] == ["v2", "v101", None, "v204", "v2"]


def test_blobs_are_never_null(session):
    a = text_table(session)
    a.inserts([(i, f"v{i}", b"%d" % i if i % 2 else None) for i in range(6)])
    a.flush()
    a.insert(9, "v9", b"nine")
    b = text_table(session)
    b.inserts([(1, "w", b"other"), (20, "w", b"twenty")])
    u = union.unions([a, b])
    want = [(1, b"1"), (3, b"3"), (5, b"5"), (9, b"nine")]
    seen = lambda t: sorted((r["k"], bytes(r["bytes"])) for r in t.with_blobs().where("blob IS NOT NULL").collect())
    assert seen(a) == want and seen(u) == [*want, (20, b"twenty")]
    a.compact()
    assert seen(a) == want
    snapshot.save_snapshot(u, "u", "words")
    assert seen(snapshot.open_table_from_snapshot(session, "u", "words")) == [*want, (20, b"twenty")]
    assert {r["bytes"] for r in a.with_blobs().where("blob IS NULL").collect()} == {None}
    lost = a.state()
    from keelstone.operators.table import blob_frame

    with pytest.raises(Exception, match="no blob"):
        blob_frame(session, lost, []).collect()


def test_runs_are_shared_and_swept(spark):
    root = session_root(spark)
    with Session.open(spark, root) as s:
        t = text_table(s)
        t.inserts([(i, f"v{i}", b"x") for i in range(4)])
        snapshot.save_snapshot(t, "one", "words")
        snapshot.save_snapshot(t, "two", "words")
        kept = {t.content.runs[0].name, *(f"{b}.blobs" for b in t.content.blobs)}
        t.insert(9, "later")
        t.flush()
        assert len(s.files.names(f"{root}/runs")) == len(kept) + 1
    assert set(s.files.names(f"{root}/runs")) == kept
    with Session.restore(spark, root) as s:
        snapshot.delete_snapshot(s, "one")
        other = snapshot.open_table_from_snapshot(s, "two", "words")
        assert shown(other) == [(i, f"v{i}") for i in range(4)]
        snapshot.delete_snapshot(s, "two")
        assert shown(other) == [(i, f"v{i}") for i in range(4)]
    assert s.files.names(f"{root}/runs") == []


def test_checksums_by_executors_and_in_blocks_agree(session, monkeypatch):
    from keelstone.sources import files

    t = text_table(session)
    t.inserts([(i, f"v{i}" * 50) for i in range(500)])
    t.flush()
    path = session.run_path(t.content.runs[0].name)
    whole = session.files.sums([path])
    assert sum(map(len, whole.values())) == 1
    monkeypatch.setattr(files, "LARGE", 10)
    assert session.files.sums([path]) == whole


def test_a_lock_of_a_dead_process_is_taken_over(spark):
    import json
    import socket

    root = session_root(spark)
    Session.open(spark, root).close()
    files = Session.open(spark, root).files
    files.write(f"{root}/lock", json.dumps({"host": socket.gethostname(), "pid": 2**31 - 7, "key": "old"}).encode(), overwrite=True)
    with Session.open(spark, root):
        with pytest.raises(errors.SessionDirLockedError):
            Session.open(spark, root)
    files.write(f"{root}/lock", json.dumps({"host": "elsewhere", "pid": 1, "key": "old"}).encode(), overwrite=True)
    with pytest.raises(errors.SessionDirLockedError):
        Session.open(spark, root)


def test_cursor_pages_read_few_files(session):
    t = Table(session, INT64, "bigint", SUM)
    t.updates(session.spark.range(4000).selectExpr("id ordinal", "id - 2000 k", "'I' op", "id v", "CAST(NULL AS binary) blob"))
    c = Cursor(t)
    keys = [*range(2000), *range(-2000, 0)]
    got = [e.key for e in c.take(1500)]
    left = len(c._files)
    while rows := c.take(900):
        got += [e.key for e in rows]
        assert len(c._files) <= left
    assert got == keys and c.frame().count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_actions_against_the_model(session, seed):
    """Batches, duplicates, unions, merges and payments in random order, all tables compared at the end."""
    rnd = random.Random(seed)
    tables = [(text_table(session), Model(lambda new, old: f"{new} {old}"))]
    for step in range(14):
        t, m = rnd.choice(tables)
        action = rnd.choices(["updates", "duplicate", "union", "lazy", "compact", "pay"], [6, 1, 1, 2, 1, 2])[0]
        if action == "updates":
            batch = []
            for i in range(rnd.randrange(1, 12)):
                op = rnd.choices("IUD", [10, 5, 1])[0]
                batch.append((rnd.randrange(-4, 8), op, None if op == "D" else f"s{step}.{i}", b"%d" % i if op == "I" and rnd.random() < 0.5 else None))
            t.updates([(k, Insert(v, b) if op == "I" else Upsert(v) if op == "U" else Delete()) for k, op, v, b in batch])
            m.apply(batch)
        elif action == "duplicate":
            tables.append((t.duplicate(), m.copy()))
        elif action in ("union", "lazy"):
            parts = [rnd.choice(tables) for _ in range(rnd.randrange(1, 4))]
            made = (union.unions if action == "union" else union.incremental_unions)([p[0] for p in parts])
            tables.append((made, Model.union([p[1] for p in parts])))
        elif action == "compact":
            t.compact(rnd.choice([None, 2]))
        else:
            union.supply_union_credits(t, rnd.randrange(1, 9))
        tables = tables[-5:]
    for t, m in tables:
        entries = Cursor(t).take(100)
        blobs = iter(t.retrieve_blobs([e.blob for e in entries if e.blob]))
        assert [(e.key, e.value, next(blobs) if e.blob else None) for e in entries] == m.sorted(lambda k: k % 2**64)
