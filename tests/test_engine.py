import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import Engine, TableExists, TableMissing, ddl_type
from quarry.errors import ConstraintViolation, EngineError, SyntaxProblem, WriteConflict
from quarry.operators import access, joins
from quarry.streaming import tumbling


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "wh"))
    yield e
    e.close()


def test_ten_types_round_trip(engine):
    kinds = "SMALLINT INT BIGINT REAL DOUBLE TEXT BOOLEAN BYTEA TIMESTAMP DATE".split()
    engine.create_table("all_types", T.StructType([T.StructField(k.lower() + "_c", ddl_type(k)) for k in kinds]))
    row = (1, 2, 2**63 - 1, 1.5, 2.5, "x", True, bytearray(b"\x00\xff"), dt.datetime(2024, 1, 2, 3, 4, 5, 678), dt.date(2024, 1, 2))
    engine.insert("all_types", [row, tuple([None] * 10)])
    got = engine.table("all_types").collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[0] is None) == [row, tuple([None] * 10)]


def test_constraints_versions_and_reopen(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "wh"))
    e.sql("CREATE TABLE k (id INT PRIMARY KEY, v TEXT)")
    e.sql("INSERT INTO k (id) VALUES (1), (2)")
    with pytest.raises(ConstraintViolation):
        e.insert("k", [(1, "again")])
    with pytest.raises(ConstraintViolation):
        e.insert("k", [(None, "x")])
    with pytest.raises(TableExists):
        e.sql("CREATE TABLE K (id INT)")
    with pytest.raises(SyntaxProblem):
        e.sql("CREATE TABLE z (id NOSUCHTYPE)")
    with pytest.raises(TableMissing):
        e.drop_table("nothing")
    point = e.savepoint("k")
    e.delete("k")
    assert e.table("k").count() == 0
    e.rollback_to("k", point)
    assert e.table("k").count() == 2
    e.close()
    again = Engine(spark, str(tmp_path / "wh"))
    assert again.list_tables() == ["k"] and again.table("k").count() == 2
    assert again.vacuum("k") >= 1 and again.table("k").count() == 2
    again.close()


def test_insert_adds_a_folder_and_keeps_the_others(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "wh"))
    e.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, v TEXT NOT NULL)")
    assert e.table("t").count() == 0 and e.insert("t", [(1, "a")]) == 1
    first = {p: p.stat().st_mtime_ns for p in (tmp_path / "wh/t").rglob("part-*")}
    narrow = spark.createDataFrame([("b", 2), ("c", 3)], "V string, id int")
    assert e.insert("t", narrow) == 2
    assert len(first) == 1 and all(p.stat().st_mtime_ns == t for p, t in first.items())
    folders = lambda: {p.name for p in (tmp_path / "wh/t").glob("d*")}
    before = folders()
    for bad in ([(3, "again")], [(4, "x"), (4, "y")], [(5, None)]):
        with pytest.raises(ConstraintViolation):
            e.insert("t", bad)
    with pytest.raises(SyntaxProblem):
        e.insert("t", spark.createDataFrame([(1,)], "id long"))
    with pytest.raises(ConstraintViolation):
        e.update("t", {"id": 7})
    assert folders() == before and sorted(tuple(r) for r in e.table("t").collect()) == [(1, "a"), (2, "b"), (3, "c")]
    e.cluster("t", "id", partitions=1)
    e.vacuum("t")
    assert len(folders()) == 1 and [r.v for r in e.find("t", ID=2).collect()] == ["b"]
    e.close()


def test_two_writers_and_transactions(spark, tmp_path):
    one = Engine(spark, str(tmp_path / "wh"))
    one.sql("CREATE TABLE t (id INT)")
    two = Engine(spark, str(tmp_path / "wh"))
    one.insert("t", [(1,)])
    with pytest.raises(WriteConflict):
        two.insert("t", [(2,)])
    assert [r.id for r in two.table("t").collect()] == [1]
    two.insert("t", [(5,)])
    two.delete("t", "id = 5")
    with pytest.raises(WriteConflict):
        one.insert("t", [(2,)])
    with pytest.raises(ZeroDivisionError), one.transaction("t"):
        one.insert("t", [(3,)])
        one.delete("t", "id = 1")
        1 / 0
    with one.transaction("t"):
        one.insert("t", [(4,)])
    assert sorted(r.id for r in one.table("t").collect()) == [1, 4]
    for i in range(15):
        one.insert("t", [(10 + i,)])
    one.close()
    again = Engine(spark, str(tmp_path / "wh"))
    assert again.table("t").count() == 17 and len(list((tmp_path / "wh/t/_log").glob("*.json"))) <= 12
    again.drop_table("t")
    assert not (tmp_path / "wh/t").exists()
    again.close()


def test_rollback_keeps_what_another_writer_committed(spark, tmp_path):
    one = Engine(spark, str(tmp_path / "wh"))
    one.sql("CREATE TABLE t (id INT)")
    one.sql("CREATE TABLE u (id INT)")
    one.insert("t", [(0,)])
    two = Engine(spark, str(tmp_path / "wh"))
    ids = lambda e, t="t": sorted(r.id for r in e.table(t).collect())
    with pytest.raises(WriteConflict), one.transaction("t"):
        one.insert("t", [(1,)])
        assert ids(one) == [0, 1] and ids(Engine(spark, str(tmp_path / "wh"))) == [0]
        two.insert("t", [(2,)])
    assert ids(one) == ids(Engine(spark, str(tmp_path / "wh"))) == [0, 2]
    with pytest.raises(WriteConflict), one.transaction("t", "u"):  # a table that is only read
        one.insert("u", [(len(ids(one)),)])
        two.insert("t", [(3,)])
    assert ids(one) == [0, 2, 3] and ids(one, "u") == []
    with pytest.raises(ZeroDivisionError), one.transaction():
        one.delete("t")
        two.insert("t", [(4,)])
        1 / 0
    assert ids(Engine(spark, str(tmp_path / "wh"))) == [0, 2, 3, 4]
    again = Engine(spark, str(tmp_path / "wh"))
    with again.transaction("t", "u"):
        again.delete("t", "id > 2")
        point = again.savepoint("u")
        again.insert("u", [(9,)])
        again.rollback_to("u", point)
        again.insert("u", [(7,)])
        with pytest.raises(EngineError), again.transaction("t"):
            pass
        with pytest.raises(EngineError):
            again.vacuum("t")
    last = Engine(spark, str(tmp_path / "wh"))
    assert ids(last) == [0, 2] and ids(last, "u") == [7]
    folders = {p.name for p in (tmp_path / "wh/t").glob("d*")}
    assert folders == {x for v in last.catalog.meta("t").versions.values() for x in v}


def test_ddl_spellings_and_rules(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "wh"))
    e.sql("CREATE TABLE p (a VARCHAR(10), b DECIMAL(10, 2), c CHAR(3) NOT NULL, d DOUBLE PRECISION, PRIMARY KEY (a, b))")
    assert [f.dataType.simpleString() for f in e.schema("p")] == ["string", "decimal(10,2)", "string", "double"] and [f.nullable for f in e.schema("p")] == [False, False, False, True]
    e.sql("INSERT INTO p VALUES ('x', 1.50, 'abc', 1), ('x', 2.5, 'abc', 1)")
    for bad in ("('x', 1.5, 'z', 1)", "(NULL, 1, 'z', 1)", "('y', 1, NULL, 1)"):
        with pytest.raises(ConstraintViolation):
            e.sql(f"INSERT INTO p VALUES {bad}")
    e.sql("CREATE TABLE q (id INT PRIMARY KEY, n INT CHECK (n > 0 AND n < 10), w TEXT DEFAULT 'none', up INT, FOREIGN KEY (up) REFERENCES q (id), CHECK (w <> 'bad'))")
    e.sql("INSERT INTO q (id, n) VALUES (1, 2)")
    e.sql("INSERT INTO q (id, n, up) VALUES (2, NULL, 1), (3, 3, 2)")
    for bad in ("(4, 10, 'x', NULL)", "(4, 1, 'bad', NULL)", "(4, 1, 'x', 99)"):
        with pytest.raises(ConstraintViolation):
            e.sql(f"INSERT INTO q VALUES {bad}")
    e.sql("CREATE TABLE r (id INT REFERENCES q(id))")
    e.sql("INSERT INTO r VALUES (3), (NULL)")
    with pytest.raises(ConstraintViolation):
        e.sql("DELETE FROM q WHERE id = 3")
    with pytest.raises(ConstraintViolation):
        e.sql("DROP TABLE q")
    assert sorted((x.id, x.w) for x in e.table("q").collect()) == [(1, "none"), (2, "none"), (3, "none")]
    for bad in ("z (a INT, a INT)", "z (a DECIMAL(50, 2))", "z (a INT(3))", "z (a INT, PRIMARY KEY (b))", "z (PRIMARY KEY (a))"):
        with pytest.raises(SyntaxProblem):
            e.sql(f"CREATE TABLE {bad}")
    e.close()
    again = Engine(spark, str(tmp_path / "wh"))
    with pytest.raises(ConstraintViolation):
        again.sql("INSERT INTO q VALUES (9, 11, 'x', NULL)")
    again.close()


def test_views_indexes_alter_copy_and_spaces(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "wh"))
    e.sql(f"CREATE TABLESPACE far LOCATION '{tmp_path}/far'")
    e.sql("CREATE TABLE t (id INT, v TEXT) TABLESPACE far")
    e.sql("INSERT INTO t VALUES (1, 'a'), (2, 'b'), (2, NULL)")
    assert (tmp_path / "far/t").exists() and not (tmp_path / "wh/t").exists()
    e.sql("CREATE VIEW big AS SELECT id, POWER(id, 2) AS sq FROM t WHERE id > 1")
    assert [tuple(r) for r in e.sql("SELECT DISTINCT sq FROM big").collect()] == [(4,)]
    with pytest.raises(ConstraintViolation):
        e.sql("CREATE UNIQUE INDEX ON t (id)")
    e.sql("CREATE INDEX by_id ON t (id, v)")
    e.sql("ALTER TABLE t ADD COLUMN w BIGINT")
    e.sql("UPDATE t SET w = id * 10")
    e.sql("ALTER TABLE t RENAME COLUMN w TO tens")
    e.sql("ALTER TABLE t DROP COLUMN v")
    assert sorted(tuple(r) for r in e.table("t").collect()) == [(1, 10), (2, 20), (2, 20)]
    for kind in ("csv", "json", "orc", "parquet"):
        e.sql(f"COPY t TO '{tmp_path}/{kind}' (FORMAT {kind})")
        e.sql("TRUNCATE TABLE t")
        assert e.table("t").count() == 0
        e.sql(f"COPY t FROM '{tmp_path}/{kind}' (FORMAT {kind})")
        assert sorted(tuple(r) for r in e.table("t").collect()) == [(1, 10), (2, 20), (2, 20)]
    e.sql("CREATE TABLE s AS SELECT id, tens FROM t WHERE id = 1")
    e.sql("ALTER TABLE s RENAME TO s2")
    e.sql("VACUUM t")
    e.close()
    again = Engine(spark, str(tmp_path / "wh"))
    assert again.list_tables() == ["s2", "t"] and again.sql("SELECT * FROM s2").count() == 1
    assert again.sql("SELECT * FROM big").count() == 2
    again.sql("DROP VIEW big")
    with pytest.raises(TableMissing):
        again.sql("DROP VIEW big")
    again.sql("DROP VIEW IF EXISTS big")
    again.close()


def test_power_and_arrow_cast_go_by_types(engine):
    r = engine.sql("SELECT POWER(id + 1, 2) AS a, POWER(id, 0.5) AS b, POWER(POWER(id + 2, 2), CAST(1 AS DOUBLE)) AS c, arrow_cast(id * 1000, 'Timestamp(Millisecond, None)') AS t, arrow_cast('7', 'Int64') AS n, 'POWER(' AS s FROM range(2)")
    assert [f.dataType.simpleString() for f in r.schema] == ["bigint", "double", "double", "timestamp_ntz", "bigint", "string"]
    assert sorted(tuple(x) for x in r.collect()) == [(1, 0.0, 4.0, dt.datetime(1970, 1, 1), 7, "POWER("), (4, 1.0, 9.0, dt.datetime(1970, 1, 1, 0, 0, 1), 7, "POWER(")]
    with pytest.raises(SyntaxProblem):
        engine.sql("SELECT POWER(1, 2")


def test_sources_round_trip(spark, tmp_path):
    from quarry import sources

    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "id int, s string, d double")
    for kind in ("parquet", "orc", "json", "csv"):
        sources.write(df, str(tmp_path / kind), kind, partition_by=["id"] if kind == "parquet" else None)
        got = sources.read(spark, str(tmp_path / kind), kind, df.schema)
        assert {tuple(r) for r in got.select("id", "s", "d").collect()} == {(1, "a", 1.5), (2, None, None)}
    many = str(tmp_path / "many")
    df.repartition(8).unionByName(df.repartition(8)).write.parquet(many)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    sources.compact(spark, many, str(tmp_path / "few"))
    assert spark.read.parquet(str(tmp_path / "few")).count() == 4 and spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_temp_table_and_insert_select(engine):
    engine.sql("CREATE TEMP TABLE s (a INT, b TEXT)")
    engine.sql("INSERT INTO s VALUES (1, 'p'), (2, 'q')")
    engine.sql("CREATE TABLE d (a INT, b TEXT)")
    engine.sql("INSERT INTO d SELECT a + 1, b FROM s WHERE a = 1")
    assert [tuple(r) for r in engine.table("d").collect()] == [(2, "p")]
    engine.sql("BEGIN"), engine.sql("COMMIT")


def test_access_paths(spark):
    df = spark.createDataFrame([("ab", 1), ("abc", 2), ("b", 3), (None, 4)], "k string, v int")
    assert [r.k for r in access.prefix(df, "k", "ab", reverse=True).collect()] == ["abc", "ab"]
    assert access.min_with_prefix(df, "k", "zz").collect()[0].k is None
    assert access.in_range(df, "v", 2, 4).count() == 2
    assert access.clustered(df, "k", partitions=2).count() == 4


def test_as_of_ties_and_gaps(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "e"), (1, 3, "c")], "k int, rt int, v string")
    got = {tuple(r) for r in joins.as_of(left, right, ["k"], "t", "rt", ["v"]).collect()}
    assert got == {(1, 5, "e"), (1, 1, None), (2, 9, None)}


def test_as_of_in_buckets_equals_one_window(spark):
    r = random.Random(9)
    some = lambda n: r.choice([None, *range(n)])
    left = [(i, some(3), some(60)) for i in range(400)]
    right = [(k, t, r.choice([None, f"{k}-{t}"])) for k in (None, 0, 1) for t in (None, *r.sample(range(60), 9))]
    a, b = spark.createDataFrame(left, "i int, k int, t int"), spark.createDataFrame(right, "k int, rt int, v string")
    want = set()
    for i, k, t in left:
        before = [x for x in right if None not in (k, t, x[1]) and x[0] == k and x[1] <= t]
        want.add((i, k, t, max(before, key=lambda x: x[1])[2] if before else None))
    for bucket in (None, lambda ts: F.floor(ts / 7), lambda ts: ts):
        assert {tuple(x) for x in joins.as_of(a, b, ["k"], "t", "rt", ["v"], bucket).collect()} == want


def test_stream_matches_batch(spark, sf, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in")
    batch = spark.read.parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in tumbling(batch, "ts", "1 day", ["event_type"]).collect()}
    # watermarks need a zoned timestamp
    src = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = tumbling(src, "ts", "1 day", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("tumbling_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("tumbling_out").collect()}
    assert {(a, b, c) for a, b, c, _ in got} == {(a, b, c) for a, b, c, _ in want}


def test_cursor(spark):
    import random

    from quarry.operators.access import Cursor

    keys = [(a, f"k{b}") for a in (-3, 0, 7, None) for b in range(12)] + [(1, None)]
    random.Random(2).shuffle(keys)
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(keys)], "a int, b string, i int").repartition(3)
    order = sorted(k for k in keys if None not in k)
    for reverse in (False, True):
        want = order[::-1] if reverse else order
        c = Cursor(df, "a", "b", reverse=reverse)
        got = []
        while rows := c.next(7):
            got += [(r.a, r.b) for r in rows]
        assert got == want
        c.seek_to_first()
        assert tuple(c.next()[0])[:2] == want[0]
        c.seek(0, "k30")
        assert [(r.a, r.b) for r in c.next(3)] == [k for k in want if (k <= (0, "k30") if reverse else k >= (0, "k30"))][:3]
        c.seek(0)
        assert [(r.a, r.b) for r in c.next(2)] == [k for k in want if (k[0] <= 0 if reverse else k[0] >= 0)][:2]
    c = Cursor(df.limit(0), "a")
    c.seek(1)
    assert c.next(3) == []


def test_changes_rewrite_only_the_files_concerned(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "files"))
    e.sql("CREATE TABLE parts_of (id INT PRIMARY KEY, up INT REFERENCES parts_of(id), v INT)")
    m = e.catalog.meta("parts_of")
    for k in range(3):
        e.insert("parts_of", spark.range(100 * k, 100 * k + 100, 1, 10).selectExpr("CAST(id AS INT) AS id", "CAST(NULL AS INT) AS up", "0 AS v"))
    first = list(m.versions[m.version])
    point = e.savepoint("parts_of")
    ids = lambda: sorted(r.id for r in e.table("parts_of").collect())
    # one file of ten in one folder
    e.delete("parts_of", "id BETWEEN 13 AND 15")
    now = m.versions[m.version]
    assert now[1:3] == first[1:] and now[0].startswith(first[0] + ":") and now[0].count(":") == 1 and len(now) == 4
    assert ids() == [i for i in range(300) if not 13 <= i <= 15]
    # nothing concerned: nothing written
    e.update("parts_of", {"v": 9}, "id = 14")
    assert m.versions[m.version] == now
    # another file of the same folder and the file written above; a null condition changes nothing
    e.update("parts_of", {"v": 5, "up": 250}, "id IN (12, 77) OR (v > 0 AND up > 3)")
    assert sorted((r.id, r.up) for r in e.table("parts_of").filter("v = 5").collect()) == [(12, 250), (77, 250)] and len(ids()) == 297
    assert m.versions[m.version][0].count(":") == 2
    # keys and references hold against rows in files that stay
    with pytest.raises(ConstraintViolation):
        e.update("parts_of", {"id": 299}, "id = 200")
    with pytest.raises(ConstraintViolation):
        e.update("parts_of", {"up": 1000}, "id = 200")
    with pytest.raises(ConstraintViolation):
        e.update("parts_of", {"id": 301}, "id = 250")
    e.update("parts_of", {"id": 300}, "id = 299")
    e.sql("CREATE TABLE alone (id INT PRIMARY KEY)")
    e.insert("alone", spark.range(0, 40, 1, 8).selectExpr("CAST(id AS INT) AS id"))
    with pytest.raises(ConstraintViolation):
        e.update("alone", {"id": 39}, "id = 2")
    e.update("alone", {"id": 40}, "id = 2")
    assert len(e.catalog.meta("alone").versions[2]) == 2 and e.table("alone").count() == 40
    # half of a folder's files or more: the folder goes
    e.delete("parts_of", "id BETWEEN 100 AND 160")
    assert not any(x.startswith(first[1]) for x in m.versions[m.version])
    want = ids()
    assert want == [i for i in range(301) if not 13 <= i <= 15 and not 100 <= i <= 160 and i != 299]
    assert Engine(spark, str(tmp_path / "files")).table("parts_of").count() == len(want)
    e.rollback_to("parts_of", point)
    assert len(ids()) == 300
    e.delete("parts_of", "id = 5")
    before = ids()
    with pytest.raises(ZeroDivisionError), e.transaction("parts_of"):
        e.delete("parts_of", "id = 6")
        1 / 0
    assert ids() == before
    e.vacuum("parts_of")
    assert ids() == before and len(e.catalog._names(f"{m.root}/{first[0]}")) < 12
    e.vacuum("parts_of")
    assert ids() == before and not any(":" in x for x in m.versions[m.version])
    e.delete("parts_of")
    assert ids() == []
    e.delete("parts_of", "id = 1")
    e.sql("DROP TABLE parts_of")
