"""Key-value tables against a sorted model, the store, streams, the ordinal, the registered queries."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tideline import flow
from tideline.flow import in_ranges, number_rows
from tideline.plans import kv
from tideline.plans.kv import KeyValues
from tideline.plans.store import ClosedTransaction, ConcurrentChange, Isolation, Store, StoreError, with_retries
from tideline.shared import written
from tideline.streaming import Log, Queue, run_once, upsert_into


def table(spark, keys):
    return KeyValues(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, v int"))


def keys_of(df):
    return [r.k for r in df.orderBy("k").select("k").collect()]


def test_tree_queries(spark):
    t = table(spark, ["ab.c", "abc", "abc.1", "abc.2", "abc.3", "abc.333", "abc.444", "abcdef"])
    assert keys_of(t.children("abc").df) == ["abc.1", "abc.2", "abc.3", "abc.444", "abcdef"]
    assert keys_of(t.children("ab").df) == [] and keys_of(t.with_prefix("").df) == []
    assert keys_of(t.first_child("abc")) == ["abc.1"] and keys_of(t.last_child("abc")) == ["abcdef"]
    assert t.exists("abc").first()[0] and not t.exists("ab").first()[0] and t.prefix_exists("ab").first()[0]
    assert keys_of(t.erase_prefix("abc").df) == ["ab.c"]
    with pytest.raises(Exception, match="no such key"):
        t.value_of("zzz").collect()
    with pytest.raises(Exception, match="not empty"):
        t.insert(spark.createDataFrame([("", 1)], "k string, v int")).df.collect()


def test_tree_queries_by_short_keys(spark, monkeypatch):
    """What is below the shortest keys meets no other key: the rows that do are few; with and without them the children are the same."""
    keys = [f"a{n}" for n in range(100)] + [f"a{n}.{k}" for n in range(100) for k in range(5)] + ["a", "b12", "b123", "b1234", "c"]
    t = table(spark, keys)
    sizes = []
    monkeypatch.setattr(kv, "written", lambda df, name: sizes.append((name, df.count())) or written(df, name))
    for most in (1 << 16, 20, 0):
        monkeypatch.setattr(kv, "_SHORT", most)
        assert keys_of(t.children("a").df) == [f"a{n}" for n in range(10)]
        assert keys_of(t.siblings("a").df) == ["a", "b12", "c"]
        sizes.clear()
        assert keys_of(t.first_child("a")) == ["a0"] and keys_of(t.first_child("b12")) == ["b123"] and keys_of(t.first_child("x")) == keys_of(t.first_child("c")) == []
        assert sizes == []  # a top-1
        assert keys_of(t.range().starting_at_child_of("a").by_sibling().going_on(prefix="a").flow().df) == [f"a{n}" for n in range(10)]
        assert most == 0 or sizes[-1] == ("kv-left", 12 if most > 20 else 14)  # of 604


def test_bounds(spark):
    t = table(spark, ["abc", "abcx", "bcd", "bcdx", "def", "fgh", "fghy"])
    assert keys_of(t.lower_bound("abcy")) == ["bcd"] and keys_of(t.lower_bound("fghx")) == ["fghy"]
    assert keys_of(t.lower_bound("fghz")) == [] and keys_of(t.lower_bound("")) == []
    assert keys_of(t.next_lower_bound("abc", "b")) == ["bcd"] and keys_of(t.next_lower_bound("def", "a")) == ["fgh"]


def test_against_model(spark):
    rng = random.Random(3)
    keys = sorted({"".join(rng.choice("ab.") for _ in range(rng.randint(1, 6))) for _ in range(120)})
    t = table(spark, keys)
    for p in rng.sample(keys, 6):
        below = [k for k in keys if k.startswith(p) and k != p]
        minimal = [k for k in below if not any(k.startswith(a) and a != k for a in below)]
        assert keys_of(t.children(p).df) == minimal
        after = [k for k in keys if k >= p]
        assert keys_of(t.siblings(p).df) == [k for k in after if not any(k.startswith(a) and a != k for a in after)]
        assert keys_of(t.next_sibling(p)) == [k for k in keys if k > p and not k.startswith(p)][:1]
    parent = {k: max((a for a in keys if k.startswith(a) and a != k), key=len, default=None) for k in keys}
    assert {r.k: r.parent for r in t.parents().collect()} == parent


def test_store(spark, tmp_path):
    rows = lambda **kv: spark.createDataFrame(list(kv.items()), "k string, v string")
    store, told = Store(spark, f"file://{tmp_path}/s"), []
    store.listeners.append(lambda event, t: told.append(event))
    with store.begin() as t:
        t.insert(rows(a="1", b="2"))
        t.savepoint()
        t.upsert(rows(a="9", c="3"))
        t.rollback()
        t.update(rows(b="5", z="0"))
    content = lambda: {r.k: r.v for r in store.table().df.collect()}
    assert content() == {"a": "1", "b": "5"}
    assert told == ["started", "before_commit", "committed"]
    with pytest.raises(ClosedTransaction):
        t.insert(rows(q="1"))
    t = store.begin()
    t.erase(rows(a="").select("k"))
    assert store.read().df.count() == 2 and store.read(Isolation.READ_UNCOMMITTED).df.count() == 1
    with pytest.raises(ConcurrentChange):
        store.read(Isolation.PREVENT)
    with store.begin() as other:  # the same range of keys
        other.upsert(rows(a="7"))
    with pytest.raises(ConcurrentChange):
        t.commit()
    one, two = store.begin(), store.begin()
    one.upsert(rows(m="1"))
    two.upsert(rows(x="2"))  # another range: both hold
    one.commit()
    two.commit()
    assert content() == {"a": "7", "b": "5", "m": "1", "x": "2"}
    with pytest.raises(RuntimeError, match="stop"), store.begin() as t:
        t.insert(rows(n="1"))
        raise RuntimeError("stop")
    assert "n" not in content()
    tries = []

    def work():
        tries.append(1)
        if len(tries) < 3:
            raise ConcurrentChange("again")
        return "done"

    assert with_retries(5, work) == "done" and len(tries) == 3
    assert {r.k for r in store.table(1).df.collect()} == {"a", "b"}  # an old version is still there


def test_savepoints_end_with_their_transaction(spark, tmp_path):
    rows = lambda **kv: spark.createDataFrame(list(kv.items()), "k string, v string")
    store = Store(spark, f"file://{tmp_path}/s")
    content = lambda: {r.k: r.v for r in store.table().df.collect()}
    with store.begin() as t:
        t.insert(rows(a="1"))
        t.savepoint()
        t.upsert(rows(b="2"))
    assert content() == {"a": "1", "b": "2"} and not store.open
    with pytest.raises(RuntimeError, match="stop"), store.begin() as t:
        t.savepoint()
        t.upsert(rows(c="3"))
        raise RuntimeError("stop")
    assert content() == {"a": "1", "b": "2"} and not store.open
    assert store.read(Isolation.PREVENT).df.count() == 2
    with store.begin() as t:
        with pytest.raises(RuntimeError, match="inner"), t.savepoint():
            t.upsert(rows(d="4"))
            raise RuntimeError("inner")
        with t.savepoint() as outer:
            t.upsert(rows(e="5"))
            inner = t.savepoint()
            t.erase(rows(a="").select("k"))
            inner.rollback()
            with pytest.raises(ClosedTransaction):
                inner.commit()
        with pytest.raises(ClosedTransaction):
            outer.rollback()
        with t.shared() as table, pytest.raises(StoreError, match="share"):
            assert table.df.count() == 3
            t.commit()
    assert content() == {"a": "1", "b": "2", "e": "5"}


def test_commits_write_their_changes(spark, tmp_path):
    """A micro-batch on a large table writes a small delta; reads lay the deltas over the base."""
    store = Store(spark, f"file://{tmp_path}/s", max_deltas=3)
    many = spark.range(50_000).select(F.format_string("k%06d", "id").alias("k"), F.uuid().alias("v"))
    with store.begin() as t:
        t.insert(many)
    store.compact()
    base = store.manifest(store.versions()[-1])["base"]
    want = {r.k: r.v for r in store.table().df.collect()}
    for n in range(6):
        batch = [(f"k{n:06d}", "new"), (f"x{n}", "more")]
        upsert_into(store)(spark.createDataFrame(batch, "k string, v string"), n)
        with store.begin() as t:
            t.erase(spark.createDataFrame([(f"k{n + 100:06d}",)], "k string"))
        want |= dict(batch)
        del want[f"k{n + 100:06d}"]
        found = store.manifest(store.versions()[-1])
        assert found["base"] == base and len(found["deltas"]) <= 3
        assert sum(store.files.size(d) for d in found["deltas"]) < store.files.size(base) / 20
    assert {r.k: r.v for r in store.table().df.collect()} == want
    with store.begin() as t:
        t.erase_prefix("k00")
        t.insert(spark.createDataFrame([("k000001", "again"), ("y", "1")], "k string, v string"))
        t.update(spark.createDataFrame([("y", "2"), ("zz", "none")], "k string, v string"))
    want = {k: v for k, v in want.items() if not k.startswith("k00")} | {"k000001": "again", "y": "2"}
    assert {r.k: r.v for r in store.table().df.collect()} == want
    (tmp_path / "s" / "data-left-by-a-crash").mkdir()
    assert "data-left-by-a-crash" in store.clean(keep=2)
    assert {r.k: r.v for r in store.table().df.collect()} == want and len(store.versions()) == 2


def test_one_of_racing_writers_wins(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    for n in range(5):
        with ThreadPoolExecutor(8) as pool:
            won = list(pool.map(lambda k, n=n: store.files.create(f"race-{n}.json", str(k)), range(8)))
        assert sum(won) == 1 and store.files.read(f"race-{n}.json") == str(won.index(True))
    assert [f for f in store.files.names() if f.startswith("_race")] == []


def test_streams(spark, tmp_path):
    log = Log(spark, f"{tmp_path}/log", "k string, v string, n int", sort="n", bloom=["k"])
    log.append(spark.createDataFrame([("a", "1", 1), ("b", "1", 2)], log.schema))
    log.append(spark.createDataFrame([("a", "2", 3)], log.schema))
    assert log.size().first()[0] == 3 and log.last("n").first().k == "a"
    assert [r.n for r in log.indexed(F.col("k") == "b").collect()] == [2]
    store = Store(spark, f"file://{tmp_path}/s")
    run_once(log.tail(10), f"{tmp_path}/p", upsert_into(store, by="n"))
    assert {r.k: r.v for r in store.table().df.collect()} == {"a": "2", "b": "1"}
    queue = Queue(spark, f"file://{tmp_path}/q", "x int")
    queue.push({"x": 1}, {"x": 2})
    queue.stop()
    with pytest.raises(RuntimeError):
        queue.push({"x": 3})
    got = []
    run_once(queue.stream(), f"{tmp_path}/p2", lambda batch, n: got.extend(r.x for r in batch.collect()))
    assert sorted(got) == [1, 2]


def test_ordinal(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["", "a", "é", "zz", None]), rng.randint(0, 50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "s string, n int, i int")
    for by in (["s", "n", "i"], ["n", "i"]):
        place = {"s": 0, "n": 1, "i": 2}
        key = lambda r: tuple((r[place[c]] is not None, r[place[c]].encode() if isinstance(r[place[c]], str) else r[place[c]] or 0) for c in by)  # noqa: E731, B023
        want = {r[2]: k for k, r in enumerate(sorted(rows, key=key))}
        assert {r.i: r.pos for r in number_rows(df, by).collect()} == want
    assert number_rows(df.where("false"), ["n"]).count() == 0


@pytest.mark.parametrize("by", [["url"], ["level", "url"]])
def test_ordinal_spreads_common_leads(spark, by):
    """Keys that begin alike, and a first column of three values, go to more than half of the tasks."""
    rows = spark.range(20_000).select(F.format_string("https://example.org/%06d", "id").alias("url"), (F.col("id") % 3).alias("level"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged, place = in_ranges(rows, by)
        tasks = ranged.select(F.shiftright(place, 33)).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    numbered = number_rows(rows, by)
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) / 2
    assert numbered.agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first() == (0, 19_999, 20_000)


def test_queries_against_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    from tideline.plans import catalog

    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    for name, run in catalog.QUERIES.items():
        found = run(spark, sf_dir)
        want = con.execute(catalog.SQL[name]).fetchall()
        columns = [c[0] for c in con.description]
        assert sorted(found.columns) == sorted(columns), name
        got = [tuple(r) for r in found.select(*columns).collect()]
        assert sorted(map(repr, map(plain, got))) == sorted(map(repr, map(plain, want))), name


def plain(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "flagship" in e.queries()


def test_flow_is_lazy(spark):
    f = flow(spark.range(3), "id", "id")
    assert f.columns() == ["id"] and f.ordered
