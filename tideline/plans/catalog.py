"""The registered queries of the engine, each with a SQL twin for DuckDB.

Every query reads its whole tables.  Where the order of rows is the point, the position is
a column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..flow import Flow, flow
from ..functions import aggregates as agg
from ..functions import bits, intervals, strings
from ..operators import (
    auto_diff, auto_join, cartesian, descendants, diff, distinct_adjacent, distinct_auto, distinct_first, distinct_last_kept, flat_mapping, maf, mapping, minibatch, on_error, or_default, ordered_join,
    ordering_flat_mapping, overlap_join, prefix_join, reachable, repeater, sort, take, take_while, union_all, union_merge, unordered_join, where, where_stateful, zip_longest, zip_short,
)
from ..shared import new_path
from .kv import KeyValues
from .store import ConcurrentChange, Isolation, Store, with_retries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(spark: SparkSession, sf_dir: str, name: str, key: str, order: bool = True) -> Flow:
    return flow(read(spark, sf_dir, name), key, key if order else None)


orders = lambda s, d: keyed(s, d, "orders", "o_orderkey")
events = lambda s, d: keyed(s, d, "events", "event_id")
parts = lambda s, d: keyed(s, d, "part", "p_partkey")


@query("SELECT count(*) AS n, CAST(sum(CAST(o_totalprice * 100 AS BIGINT)) AS BIGINT) AS cents FROM orders WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def flagship(spark, sf_dir):
    customers = keyed(spark, sf_dir, "customer", "c_custkey") >> where(F.col("c_acctbal") > 0)
    kept = orders(spark, sf_dir) >> where(F.col("o_orderstatus") == "O") >> ordered_join(customers, [("o_custkey", "c_custkey")])
    return kept.df.agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


# ---- sources


@query("SELECT i * 3 AS v FROM range(3) t(i)")
def src_iota_step(spark, sf_dir):
    return sources.of_iota(spark, 0, 10, 3, "v").element()


@query("SELECT r_regionkey AS key, r_name AS name FROM region")
def src_container(spark, sf_dir):
    rows = {r[0]: r[1] for r in read(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()}  # a table of five rows
    return sources.of_container(spark, rows, "int,string").element().toDF("key", "name")


@query("SELECT p_partkey, u.token FROM (SELECT p_partkey, list_filter(string_split_regex(p_name, '[ ]'), lambda x: x <> '') AS l FROM part) t, unnest(l) u(token)")
def src_split(spark, sf_dir):
    f = parts(spark, sf_dir) >> flat_mapping(sources.split_column(F.col("p_name"), " "), "token")
    return f.df.select("p_partkey", "token")


@query("SELECT i AS step, i * i AS v FROM range(1000) t(i)")
def src_lazy_value(spark, sf_dir):
    f = sources.of_lazy_value(spark, lambda step: step * step, 1000, "v")
    return f.df.select(F.col("_pos").alias("step"), "v")


@query("SELECT 'x' AS v FROM range(3)")
def src_value(spark, sf_dir):
    return sources.of_value(spark, "x", 3, "v").element()


@query("SELECT 7 AS v")
def src_optional(spark, sf_dir):
    some, none = sources.of_optional(spark, 7, "int", "v"), sources.of_optional(spark, None, "int", "v")
    return (some >> union_all(none)).element()


@query("SELECT CAST(NULL AS BIGINT) AS v WHERE false")
def src_null(spark, sf_dir):
    return sources.null(spark, "v long").element()


@query("WITH RECURSIVE f(pos, a, b) AS (SELECT 0, 0, 1 UNION ALL SELECT pos + 1, b, a + b FROM f WHERE pos < 29) SELECT CAST(pos AS BIGINT) AS pos, CAST(a AS BIGINT) AS v FROM f")
def src_generator(spark, sf_dir):
    def fibonacci(step, state=[0, 1]):  # noqa: B006  # the generator's own state
        if step == 30:
            return None
        if step == 0:
            state[:] = [0, 1]
        out = state[0]
        state[:] = [state[1], state[0] + state[1]]
        return out

    f = sources.generator(spark, fibonacci, "long", "v", keep_order=True)
    return f.df.select(F.col("_pos").alias("pos"), "v")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p >= 10 AND p < 100")
def src_iterators(spark, sf_dir):
    return sources.of_iterators(orders(spark, sf_dir), 10, 100).df.select("o_orderkey")


@query("SELECT n_name AS name FROM nation")
def src_conditional(spark, sf_dir):
    f = sources.conditional(lambda: True, lambda: keyed(spark, sf_dir, "nation", "n_nationkey"), lambda: keyed(spark, sf_dir, "region", "r_regionkey"))
    return f.df.select(F.col("n_name").alias("name"))


# ---- one sequence


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS step, o_orderkey, CAST(o_orderkey * (row_number() OVER (ORDER BY o_orderkey) - 1) AS BIGINT) AS v FROM orders")
def map_state(spark, sf_dir):
    return orders(spark, sf_dir).ordinal("step").select("step", "o_orderkey", (F.col("o_orderkey") * F.col("step")).alias("v"))


@query("SELECT o_orderkey AS k, o_custkey % 7 AS bucket FROM orders")
def map_keep_order(spark, sf_dir):
    f = orders(spark, sf_dir) >> mapping(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 7).alias("bucket"), order=["k"])
    return f.element()


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def filter_pred(spark, sf_dir):
    return (orders(spark, sf_dir) >> where(F.col("o_orderstatus") == "F")).df.select("o_orderkey", "o_orderstatus")


@query("SELECT n_nationkey FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation WHERE n_regionkey <> 0) WHERE r <= 7")
def filter_stateful(spark, sf_dir):
    keep = lambda row, emitted: None if emitted == 7 else row["n_regionkey"] != 0
    return (keyed(spark, sf_dir, "nation", "n_nationkey") >> where_stateful(keep)).df.select("n_nationkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 20")
def take_first(spark, sf_dir):
    return (orders(spark, sf_dir) >> where(F.col("o_orderstatus") == "P") >> take(20)).df.select("o_orderkey")


@query("SELECT o_orderkey AS k, CAST(o_custkey * 2 AS BIGINT) AS v FROM orders WHERE o_totalprice > 100000")
def maf_keep(spark, sf_dir):
    return (orders(spark, sf_dir) >> maf(F.col("o_totalprice") > 100000, F.col("o_orderkey").alias("k"), (F.col("o_custkey") * 2).alias("v"))).element()


@query("SELECT l_orderkey, CAST(i AS INTEGER) AS i FROM lineitem, unnest(range(1, l_linenumber + 1)) t(i)")
def flat_map(spark, sf_dir):
    f = flow(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]) >> flat_mapping(F.sequence(F.lit(1), F.col("l_linenumber")), "i")
    return f.df.select("l_orderkey", "i")


@query("SELECT CAST(row_number() OVER (ORDER BY v, p_partkey) - 1 AS BIGINT) AS pos, v, p_partkey FROM (SELECT p_partkey, CAST(p_size + i * 10 AS INTEGER) AS v FROM part, range(3) t(i))")
def ordering_flat_map(spark, sf_dir):
    children = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.col("p_size") + i * 10)
    return (parts(spark, sf_dir) >> ordering_flat_mapping(children, "v")).ordinal().select("pos", "v", "p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < coalesce((SELECT min(o_orderkey) FROM orders WHERE NOT o_totalprice < 400000), 9223372036854775807)")
def take_awhile(spark, sf_dir):
    return (orders(spark, sf_dir) >> take_while(F.col("o_totalprice") < 400000)).df.select("o_orderkey")


@query("SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1")
def or_default_hit(spark, sf_dir):
    some = keyed(spark, sf_dir, "nation", "n_nationkey") >> where(F.col("n_regionkey") == 1) >> mapping(F.col("n_nationkey").alias("k"))
    return (some >> or_default(sources.of_value(spark, -1, name="k"))).element()


@query("SELECT r_regionkey AS k FROM region")
def or_default_miss(spark, sf_dir):
    none = keyed(spark, sf_dir, "nation", "n_nationkey") >> where(F.col("n_regionkey") == 99) >> mapping(F.col("n_nationkey").alias("k"))
    other = keyed(spark, sf_dir, "region", "r_regionkey") >> mapping(F.col("r_regionkey").alias("k"))
    return (none >> or_default(other)).element()


@query("""WITH t AS (SELECT event_id, 1000.0 / nullif(event_id % 50 - 49, 0) AS v FROM events), s AS (SELECT min(event_id) AS stop FROM t WHERE v IS NULL)
SELECT 0 AS src, v FROM t, s WHERE stop IS NULL OR event_id < stop UNION ALL SELECT 1, -1.0 FROM s WHERE stop IS NOT NULL""")
def on_exception(spark, sf_dir):
    value = F.try_divide(F.lit(1000.0), F.col("event_id") % 50 - 49)
    alternative = spark.range(1).select(F.lit(-1.0).alias("v"))
    return (events(spark, sf_dir) >> on_error(value, "v", alternative)).df.select(F.col("_src").alias("src"), "v")


@query("SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS s FROM events WHERE event_type <> 'view' UNION ALL SELECT count(*), CAST(sum(event_id) AS BIGINT) FROM events WHERE event_type <> 'view'")
def repeat_twice(spark, sf_dir):
    f = events(spark, sf_dir) >> where(F.col("event_type") != "view") >> repeater() >> minibatch(64)
    once = f.df.agg(F.count("*").alias("n"), F.sum("event_id").alias("s"))
    return once.unionAll(once)


@query("SELECT CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS BIGINT) AS pos, o_orderkey FROM orders")
def sort_parallel(spark, sf_dir):
    # numbering deals the rows to ranges of the same order, and Catalyst takes out the sort before it
    return (orders(spark, sf_dir) >> sort("o_totalprice")).ordinal().select("pos", "o_orderkey")


# ---- sets


@query("SELECT 0 AS src, event_type FROM events WHERE value > 50 UNION ALL SELECT 1, event_type FROM events WHERE value <= 50")
def union_all_types(spark, sf_dir):
    part = lambda c: events(spark, sf_dir) >> where(c) >> mapping(F.col("event_type"))
    return (part(F.col("value") > 50) >> union_all(part(F.col("value") <= 50))).df.select(F.col("_src").alias("src"), "event_type")


@query("SELECT CAST(row_number() OVER (ORDER BY k, src) - 1 AS BIGINT) AS pos, k FROM (SELECT o_custkey AS k, 0 AS src FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT c_custkey, 1 FROM customer)")
def union_merge_keys(spark, sf_dir):
    a = flow(read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")), "k", "k")
    b = flow(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k", "k")
    return (a >> union_merge(b)).ordinal().select("pos", "k")


@query("SELECT event_type FROM events WHERE value > 20 EXCEPT ALL SELECT event_type FROM events WHERE value > 60")
def diff_multiset(spark, sf_dir):
    part = lambda c: flow(read(spark, sf_dir, "events").where(c).select("event_type"))
    return (part(F.col("value") > 20) >> diff(part(F.col("value") > 60))).element()


@query("""WITH a AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY lower(event_type) ORDER BY event_id) AS r FROM events WHERE value > 20),
b AS (SELECT lower(event_type) AS t, count(*) AS n FROM events WHERE value > 60 GROUP BY 1)
SELECT event_id, event_type FROM a LEFT JOIN b ON lower(a.event_type) = b.t WHERE r > coalesce(n, 0)""")
def diff_custom_cmp(spark, sf_dir):
    a = events(spark, sf_dir) >> where(F.col("value") > 20)
    b = events(spark, sf_dir) >> where(F.col("value") > 60)
    return (a >> diff(b, [F.lower("event_type")])).df.select("event_id", "event_type")


@query("SELECT event_id, event_type, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) = 1")
def distinct_first_kept(spark, sf_dir):
    f = flow(read(spark, sf_dir, "events"), "event_id") >> distinct_first([F.col("event_type"), F.col("user_id")])
    return f.df.select("event_id", "event_type", "user_id")


@query("SELECT DISTINCT o_custkey FROM orders")
def distinct_auto_sorted(spark, sf_dir):
    return (flow(read(spark, sf_dir, "orders").select("o_custkey"), "o_custkey", "o_custkey") >> distinct_auto()).df


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY event_id) AS p, row_number() OVER (ORDER BY event_id) AS r FROM events) WHERE r = 1 OR p IS DISTINCT FROM event_type")
def distinct_neighbours(spark, sf_dir):
    return (events(spark, sf_dir) >> distinct_adjacent(F.col("event_type"))).df.select("event_id", "event_type")


# ---- joins


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def join_ordered(spark, sf_dir):
    customers = keyed(spark, sf_dir, "customer", "c_custkey") >> where(F.col("c_mktsegment") == "BUILDING")
    by_customer = flow(read(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"], "o_custkey")
    return (by_customer >> ordered_join(customers, [("o_custkey", "c_custkey")])).df.select("o_orderkey")


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25)")
def join_unordered(spark, sf_dir):
    large = parts(spark, sf_dir) >> where(F.col("p_size") > 25)
    return (flow(read(spark, sf_dir, "lineitem")) >> unordered_join(large, [("l_partkey", "p_partkey")])).df.select("l_orderkey", "l_partkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_auto_uo(spark, sf_dir):
    unsorted = flow(read(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), "o_orderkey")
    return (unsorted >> auto_join(keyed(spark, sf_dir, "customer", "c_custkey"), [("o_custkey", "c_custkey")])).df.select("c_custkey")


@query("SELECT r_name, n_name, CAST(x AS BIGINT) AS x, CAST(row_number() OVER (ORDER BY x, n_nationkey, r_regionkey) - 1 AS BIGINT) AS pos FROM region, nation, range(3) t(x)")
def cartesian3(spark, sf_dir):
    f = keyed(spark, sf_dir, "region", "r_regionkey") >> cartesian(keyed(spark, sf_dir, "nation", "n_nationkey"), sources.of_iota(spark, 0, 3, name="x"))
    return f.ordinal().select("r_name", "n_name", "x", "pos")


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey FROM orders), b AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_name FROM part)
SELECT CAST(pos AS BIGINT) AS pos, o_orderkey, p_name FROM a JOIN b USING (pos)""")
def zip_short_rows(spark, sf_dir):
    names = parts(spark, sf_dir) >> mapping(F.col("p_name"))
    return (orders(spark, sf_dir) >> zip_short(names)).df.select("pos", "o_orderkey", "p_name")


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_name FROM nation), b AS (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS pos, r_name FROM region)
SELECT CAST(pos AS BIGINT) AS pos, n_name, r_name, r_name IS NOT NULL AS has_region FROM a FULL JOIN b USING (pos)""")
def zip_longest_rows(spark, sf_dir):
    f = keyed(spark, sf_dir, "nation", "n_nationkey") >> zip_longest(keyed(spark, sf_dir, "region", "r_regionkey"))
    return f.df.select("pos", "n_name", "r_name", F.col("_has1").alias("has_region"))


# ---- collectors


@query("SELECT CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS s, CAST(0 AS BIGINT) AS nothing FROM lineitem")
def agg_sum(spark, sf_dir):
    lines = flow(read(spark, sf_dir, "lineitem"))
    none = lines >> where(F.lit(False))
    return (lines >> agg.total(F.col("l_linenumber"), "s")).crossJoin(none >> agg.total(F.col("l_linenumber"), "nothing"))


@query("SELECT count(*) + 5 AS n FROM lineitem")
def agg_count(spark, sf_dir):
    return flow(read(spark, sf_dir, "lineitem")) >> agg.count("n", 5)


@query("SELECT arg_min(o_orderpriority, o_orderkey) AS first, arg_max(o_orderpriority, o_orderkey) AS last FROM orders")
def agg_first_last(spark, sf_dir):
    f = orders(spark, sf_dir)
    return (f >> agg.first(of=F.col("o_orderpriority"))).crossJoin(f >> agg.last(of=F.col("o_orderpriority")))


@query("SELECT CAST(round(2 * product(1 + n_nationkey / 100.0), 6) AS DOUBLE) AS p FROM nation")
def agg_product(spark, sf_dir):
    f = keyed(spark, sf_dir, "nation", "n_nationkey") >> agg.product(1 + F.col("n_nationkey") / 100.0, 2.0, "p")
    return f.select(F.round("p", 6).alias("p"))


@query("WITH RECURSIVE n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation), f(i, v) AS (SELECT 0, CAST(1 AS BIGINT) UNION ALL SELECT i + 1, (v * 3 + r) % 1000003 FROM f, n WHERE n.k = f.i) SELECT arg_max(v, i) AS v FROM f")
def agg_fold(spark, sf_dir):
    f = keyed(spark, sf_dir, "nation", "n_nationkey")
    return f >> agg.fold(F.lit(1).cast("long"), lambda a, x: (a * 3 + x) % 1000003, F.col("n_regionkey"), "v")


@query("SELECT round(fsum(l_extendedprice), 2) AS s FROM lineitem")
def agg_kahan(spark, sf_dir):
    return (flow(read(spark, sf_dir, "lineitem")) >> agg.compensated(F.col("l_extendedprice"), "kahan", "s")).select(F.round("s", 2).alias("s"))


@query("SELECT round(fsum(o_totalprice), 2) AS s FROM orders")
def agg_neumaier(spark, sf_dir):
    return (orders(spark, sf_dir) >> agg.compensated(F.col("o_totalprice"), "neumaier", "s")).select(F.round("s", 2).alias("s"))


@query("SELECT round(fsum(value), 2) AS s FROM events")
def agg_pairwise(spark, sf_dir):
    return (events(spark, sf_dir) >> agg.pairwise(F.col("value"), "s")).select(F.round("s", 2).alias("s"))


# ---- hierarchies


def _places(spark, sf_dir):
    region, nation, customer = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    name = lambda prefix, c: F.concat(F.lit(prefix), F.lpad(F.col(c).cast("string"), 8, "0"))
    edges = nation.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"))
    edges = edges.unionAll(customer.select(name("n", "c_nationkey").alias("parent"), name("u", "c_custkey").alias("child")))
    return region.select(name("r", "r_regionkey").alias("node")), edges


_PLACES_SQL = """WITH RECURSIVE e AS (
  SELECT 'r' || lpad(n_regionkey::VARCHAR, 8, '0') AS parent, 'n' || lpad(n_nationkey::VARCHAR, 8, '0') AS child FROM nation
  UNION ALL SELECT 'n' || lpad(c_nationkey::VARCHAR, 8, '0'), 'u' || lpad(c_custkey::VARCHAR, 8, '0') FROM customer),
t AS (SELECT 'r' || lpad(r_regionkey::VARCHAR, 8, '0') AS node, 0 AS level, ['r' || lpad(r_regionkey::VARCHAR, 8, '0')] AS path FROM region
  UNION ALL SELECT child, level + 1, list_append(path, child) FROM t JOIN e ON e.parent = t.node)
"""


@query(_PLACES_SQL + "SELECT node, level, CAST(row_number() OVER (ORDER BY array_to_string(path, '/')) - 1 AS BIGINT) AS pos FROM t WHERE level > 0")
def hier_dfs(spark, sf_dir):
    found = descendants(*_places(spark, sf_dir)).withColumn("by", F.array_join("path", "/"))
    return flow(found, "by").ordinal().select("node", "level", "pos")


@query(_PLACES_SQL + "SELECT node, level, CAST(row_number() OVER (ORDER BY level, array_to_string(path, '/')) - 1 AS BIGINT) AS pos FROM t WHERE level > 0")
def hier_bfs(spark, sf_dir):
    found = descendants(*_places(spark, sf_dir)).withColumn("by", F.array_join("path", "/"))
    return flow(found, ["level", "by"]).ordinal().select("node", "level", "pos")


@query(_PLACES_SQL.split("\nt AS")[0].rstrip(",") + """, s AS (SELECT parent AS a, child AS b FROM e UNION ALL SELECT child, parent FROM e),
t(node) AS (SELECT 'n00000007' UNION SELECT s.b FROM t JOIN s ON s.a = t.node) SELECT node FROM t WHERE node <> 'n00000007'""")
def graph_reach(spark, sf_dir):
    _, edges = _places(spark, sf_dir)
    return reachable(spark.range(1).select(F.lit("n00000007").alias("node")), edges, a="parent", b="child")


# ---- key-value tables


def _table(spark, sf_dir) -> KeyValues:
    top = read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_orderkey")).alias("k"), F.col("o_custkey").alias("v"))
    lines = read(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("c"), F.col("l_orderkey"), F.lit("."), F.col("l_linenumber")).alias("k")).agg(F.min("l_partkey").alias("v"))
    return KeyValues(top.unionByName(lines))


_KV = """WITH kv AS (SELECT 'c' || o_orderkey AS k, o_custkey AS v FROM orders
  UNION ALL SELECT 'c' || l_orderkey || '.' || l_linenumber, min(l_partkey) FROM lineitem GROUP BY 1)
"""
_CHILDREN = "starts_with(t.k, '{p}') AND t.k <> '{p}' AND EXISTS (SELECT 1 FROM kv x WHERE x.k = '{p}') AND NOT EXISTS (SELECT 1 FROM kv a WHERE starts_with(a.k, '{p}') AND a.k <> '{p}' AND starts_with(t.k, a.k) AND a.k <> t.k)"


@query(_KV + "SELECT k, v FROM kv WHERE k = 'c7'")
def kv_find(spark, sf_dir):
    return _table(spark, sf_dir).find("c", "7")


@query(_KV + "SELECT EXISTS (SELECT 1 FROM kv WHERE k = 'c1') AS a, EXISTS (SELECT 1 FROM kv WHERE k = 'c1.') AS b, EXISTS (SELECT 1 FROM kv WHERE starts_with(k, 'c1.')) AS p, false AS e")
def kv_exists(spark, sf_dir):
    t = _table(spark, sf_dir)
    a, b, p, e = t.exists("c1"), t.exists("c1."), t.prefix_exists("c1."), t.prefix_exists("")
    return a.toDF("a").crossJoin(b.toDF("b")).crossJoin(p.toDF("p")).crossJoin(e.toDF("e"))


@query(_KV + "SELECT count(*) AS size FROM kv")
def kv_size(spark, sf_dir):
    return _table(spark, sf_dir).size()


@query(_KV + "SELECT v FROM kv WHERE k = 'c5'")
def kv_value(spark, sf_dir):
    return _table(spark, sf_dir).value_of("c5")


@query(_KV + "SELECT k, v FROM kv WHERE k >= 'c12/' ORDER BY k LIMIT 1")
def kv_lower_bound(spark, sf_dir):
    return _table(spark, sf_dir).lower_bound("c12/")


@query(_KV + "SELECT k, v FROM kv WHERE k > 'c2' AND k >= 'c150' ORDER BY k LIMIT 1")
def kv_next_lower_bound(spark, sf_dir):
    return _table(spark, sf_dir).next_lower_bound("c2", "c150")


@query(_KV + "SELECT k, v FROM kv WHERE starts_with(k, 'c10')")
def kv_prefix_range(spark, sf_dir):
    return _table(spark, sf_dir).with_prefix("c10").df


@query(_KV + "SELECT k, v FROM kv WHERE k > 'c1' AND NOT starts_with(k, 'c1') ORDER BY k LIMIT 1")
def kv_next_sibling(spark, sf_dir):
    return _table(spark, sf_dir).next_sibling("c1")


@query(_KV + "SELECT t.k, t.v FROM kv t WHERE " + _CHILDREN.format(p="c1"))
def kv_children(spark, sf_dir):
    return _table(spark, sf_dir).children("c1").df


@query(_KV + f"SELECT min(t.k) AS first, max(t.k) AS last FROM kv t WHERE {_CHILDREN.format(p='c2')}")
def kv_first_last_child(spark, sf_dir):
    t = _table(spark, sf_dir)
    return t.first_child("c2").select(F.col("k").alias("first")).crossJoin(t.last_child("c2").select(F.col("k").alias("last")))


@query(_KV + "SELECT t.k, t.v FROM kv t WHERE t.k >= 'c99' AND EXISTS (SELECT 1 FROM kv x WHERE x.k = 'c99') AND NOT EXISTS (SELECT 1 FROM kv a WHERE a.k >= 'c99' AND starts_with(t.k, a.k) AND a.k <> t.k)")
def kv_siblings(spark, sf_dir):
    return _table(spark, sf_dir).siblings("c99").df


@query("""WITH p AS (SELECT page_id, url FROM pages), u AS (SELECT DISTINCT url FROM p),
k AS (SELECT p.page_id, p.url, max(length(u.url)) AS n FROM p LEFT JOIN u ON starts_with(p.url, u.url) AND u.url <> p.url GROUP BY 1, 2)
SELECT page_id, CASE WHEN n IS NOT NULL THEN url[1:n] END AS parent FROM k""")
def kv_parents(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.col("url").alias("k"), "page_id")
    return KeyValues(pages).parents().select("page_id", "parent")


@query(_KV + "SELECT DISTINCT k FROM kv JOIN (SELECT 'c' || c_custkey AS p FROM customer) ON starts_with(k, p)")
def kv_prefix_join_semi(spark, sf_dir):
    prefixes = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("p"))
    return (flow(prefixes, "p", "p") >> prefix_join(_table(spark, sf_dir).df, "k", "p")).df.select("k")


@query(_KV + "SELECT p, k FROM kv JOIN (SELECT 'c' || c_custkey AS p FROM customer) ON starts_with(k, p)")
def kv_prefix_join_inner(spark, sf_dir):
    prefixes = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("p"))
    return (flow(prefixes, "p") >> prefix_join(_table(spark, sf_dir).df, "k", "p")).df.select("p", "k")


_CHANGES = "SELECT 'c' || (o_orderkey + 3) AS k, o_custkey + 1000000 AS v FROM orders WHERE o_orderstatus = 'P'"


def _changes(spark, sf_dir):
    return read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("c"), F.col("o_orderkey") + 3).alias("k"), (F.col("o_custkey") + 1000000).alias("v"))


@query(_KV + f", n AS ({_CHANGES}) SELECT k, v FROM kv UNION ALL SELECT k, v FROM n WHERE k NOT IN (SELECT k FROM kv)")
def kv_insert(spark, sf_dir):
    return _table(spark, sf_dir).insert(_changes(spark, sf_dir)).df


@query(_KV + f", n AS ({_CHANGES}) SELECT kv.k, coalesce(n.v, kv.v) AS v FROM kv LEFT JOIN n USING (k)")
def kv_update(spark, sf_dir):
    return _table(spark, sf_dir).update(_changes(spark, sf_dir)).df


@query(_KV + f", n AS ({_CHANGES}) SELECT k, coalesce(n.v, kv.v) AS v FROM kv FULL JOIN n USING (k)")
def kv_upsert(spark, sf_dir):
    return _table(spark, sf_dir).upsert(_changes(spark, sf_dir)).df


@query(_KV + f", n AS ({_CHANGES}) SELECT k, v FROM kv WHERE k NOT IN (SELECT k FROM n)")
def kv_erase(spark, sf_dir):
    return _table(spark, sf_dir).erase(_changes(spark, sf_dir)).df


@query(_KV + "SELECT k, v FROM kv WHERE NOT starts_with(k, 'c1') OR k = 'c1'")
def kv_erase_prefix(spark, sf_dir):
    return _table(spark, sf_dir).erase_prefix("c1", erase_prefix=False).df


# ---- intervals, bits, strings


@query("SELECT p_partkey AS a, c_custkey AS b FROM part JOIN customer ON p_partkey < c_custkey + c_nationkey AND c_custkey < p_partkey + p_size AND p_size > 0 AND c_nationkey > 0")
def interval_overlap(spark, sf_dir):
    a, b = read(spark, sf_dir, "part").select("p_partkey", "p_size"), read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    found = overlap_join(a, b, F.col("p_partkey"), F.col("p_size"), F.col("c_custkey"), F.col("c_nationkey"), 64)
    return found.select(F.col("p_partkey").alias("a"), F.col("c_custkey").alias("b"))


_SPANS = "WITH s AS (SELECT event_id, event_id % 100 AS p, event_id % 7 AS n, user_id % 100 AS q, user_id % 5 AS m FROM events)\n"


def _spans(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    one = intervals.interval(F.col("event_id") % 100, F.col("event_id") % 7)
    two = intervals.interval(F.col("user_id") % 100, F.col("user_id") % 5)
    return e.select("event_id", one.alias("a"), two.alias("b")), F.col("a"), F.col("b")


@query(_SPANS + "SELECT event_id, CASE WHEN n = 0 THEN q WHEN m = 0 THEN p ELSE least(p, q) END AS p, CASE WHEN n = 0 THEN m WHEN m = 0 THEN n ELSE greatest(p + n, q + m) - least(p, q) END AS n FROM s")
def interval_hull(spark, sf_dir):
    df, a, b = _spans(spark, sf_dir)
    return df.select("event_id", intervals.hull(a, b).alias("h")).select("event_id", F.col("h.pos").alias("p"), F.col("h.count").alias("n"))


@query(_SPANS + "SELECT event_id, greatest(p, q) AS p, greatest(0, least(p + n, q + m) - greatest(p, q)) AS n FROM s")
def interval_intersection(spark, sf_dir):
    df, a, b = _spans(spark, sf_dir)
    return df.select("event_id", intervals.intersection(a, b).alias("h")).select("event_id", F.col("h.pos").alias("p"), F.col("h.count").alias("n"))


@query(_SPANS + "SELECT event_id, n > 0 AND m > 0 AND p < q + m AND q < p + n AS overlaps, q >= p AND q + m <= p + n AS included, p = q + m OR p + n = q AS adjacent, p + n <= q AS less, p = q AND n = m AS equal, 50 >= p AND 50 < p + n AS holds FROM s")
def interval_relations(spark, sf_dir):
    df, a, b = _spans(spark, sf_dir)
    named = {"overlaps": intervals.overlaps(a, b), "included": intervals.is_included(a, b), "adjacent": intervals.adjacent(a, b), "less": intervals.less(a, b), "equal": intervals.equal(a, b), "holds": intervals.contains(a, F.lit(50))}
    return df.select("event_id", *[c.alias(n) for n, c in named.items()])


@query("SELECT event_id, bit_count(event_id) AS ones, CASE WHEN event_id = 0 THEN -1 ELSE CAST(floor(log2(event_id)) AS INTEGER) END AS high, CASE WHEN event_id = 0 THEN -1 ELSE bit_count(xor(event_id, event_id - 1)) - 1 END AS low, CASE WHEN event_id <= 1 THEN 1 ELSE CAST(1 AS BIGINT) << CAST(ceil(log2(event_id)) AS INTEGER) END AS power FROM events")
def bit_places(spark, sf_dir):
    x = F.col("event_id")
    return read(spark, sf_dir, "events").select("event_id", bits.count_bits(x).cast("int").alias("ones"), bits.last_set(x).cast("int").alias("high"), bits.first_set(x).cast("int").alias("low"), bits.ceil_power(x).alias("power"))


@query("SELECT n_nationkey, CASE WHEN n_name < 'INDIA' THEN -1 WHEN n_name = 'INDIA' THEN 0 ELSE 1 END AS c, n_name[1:5] AS head FROM nation")
def string_compare(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    return n.select("n_nationkey", strings.compare(F.col("n_name"), F.lit("INDIA")).alias("c"), strings.bounded(F.col("n_name"), 5, strict=False).alias("head"))


# ---- storage and streams: written under a fresh folder of the session's shared one


def _folder(spark) -> str:
    return new_path(spark, "store")


@query("SELECT n_name AS k, CASE WHEN n_regionkey = 1 THEN 'new' ELSE 'old' END AS v FROM nation WHERE n_regionkey <> 2")
def tx_savepoint(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    store = Store(spark, _folder(spark))
    with store.begin() as t:
        t.insert(nation.select(F.col("n_name").alias("k"), F.lit("old").alias("v")))
    with store.begin() as t:
        t.upsert(nation.where("n_regionkey = 1").select(F.col("n_name").alias("k"), F.lit("new").alias("v")))
        within = t.savepoint()
        t.erase(nation.where("n_regionkey = 3").select(F.col("n_name").alias("k")))
        within.rollback()
        t.erase(nation.where("n_regionkey = 2").select(F.col("n_name").alias("k")))
    return store.table().df


@query("SELECT 'inside' AS who, count(*) * 2 AS n FROM region UNION ALL SELECT 'committed', count(*) FROM region UNION ALL SELECT 'uncommitted', count(*) * 2 FROM region")
def tx_isolation(spark, sf_dir):
    region = read(spark, sf_dir, "region")
    store = Store(spark, _folder(spark))
    with store.begin() as t:
        t.insert(region.select(F.col("r_name").alias("k"), F.lit("a").alias("v")))
    t = store.begin()
    t.insert(region.select(F.concat("r_name", F.lit("2")).alias("k"), F.lit("b").alias("v")))
    seen = {"inside": t.table(), "committed": store.read(), "uncommitted": store.read(Isolation.READ_UNCOMMITTED)}
    counts = [kv.df.agg(F.lit(who).alias("who"), F.count("*").alias("n")) for who, kv in seen.items()]
    t.rollback()
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


@query("SELECT event_type AS k, CAST(max(event_id) AS VARCHAR) AS v FROM events GROUP BY 1")
def stream_upsert(spark, sf_dir):
    from ..streaming import Log, run_once, upsert_into

    folder = _folder(spark)
    log = Log(spark, f"{folder}/log", "k string, v string, n long", sort="n", bloom=["k"])
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("k"), F.col("event_id").cast("string").alias("v"), F.col("event_id").alias("n"))
    for part in (rows.where("n % 2 = 0"), rows.where("n % 2 = 1")):  # two appends
        log.append(part)
    store = Store(spark, f"{folder}/store")
    whole = F.struct("k", "v", "n")

    def each(batch, number):
        # what the store holds takes part, so that batches may come in any order
        held = store.table().df.select("k", "v", F.col("v").cast("long").alias("n"))
        latest = batch.unionByName(held).groupBy("k").agg(F.max_by(whole, "n").alias("r")).select("r.*")
        upsert_into(store)(latest.select("k", "v"), number)

    run_once(log.tail(1000), f"{folder}/progress", each)
    return store.table().df


@query("SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS s FROM events WHERE event_id BETWEEN 100 AND 300")
def log_indexed(spark, sf_dir):
    from ..streaming import Log

    log = Log(spark, f"{_folder(spark)}/log", "event_id long, user_id long", sort="event_id")
    log.append(read(spark, sf_dir, "events").select("event_id", "user_id"))
    return log.indexed(F.col("event_id").between(100, 300)).agg(F.count("*").alias("n"), F.sum("event_id").alias("s"))


@query("SELECT r_regionkey AS k, r_name AS name FROM region")
def stream_queue(spark, sf_dir):
    from ..streaming import Queue, run_once

    folder = _folder(spark)
    queue = Queue(spark, f"{folder}/queue", "k int, name string")
    for row in read(spark, sf_dir, "region").select("r_regionkey", "r_name").collect():  # five rows
        queue.push({"k": row[0], "name": row[1]})
    queue.stop()
    run_once(queue.stream(), f"{folder}/progress", lambda batch, n: batch.write.mode("append").parquet(f"{folder}/out"))
    return spark.read.schema("k int, name string").parquet(f"{folder}/out")


# ---- sources, steps and collectors of the user's own


@query("SELECT n_nationkey FROM nation WHERE n_regionkey > 1")
def src_outer(spark, sf_dir):
    return (sources.outer(read(spark, sf_dir, "nation"), "n_nationkey") >> where(F.col("n_regionkey") > 1)).df.select("n_nationkey")


@query("SELECT CAST(a * 10 + b AS BIGINT) AS v FROM range(4) x(a), range(5) y(b)")
def src_data_source(spark, sf_dir):
    return sources.of_source(spark, [0, 1, 2, 3], lambda a: ((10 * a + b,) for b in range(5)), "v long", "v", "v").df


@query("SELECT n_name AS name FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_name = 'ASIA') UNION ALL SELECT r_name FROM region WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_name = 'ASIA')")
def src_chosen_late(spark, sf_dir):
    there = read(spark, sf_dir, "region").where("r_name = 'ASIA'").agg(F.count("*") > 0)
    names = lambda t, c: flow(read(spark, sf_dir, t).select(F.col(c).alias("name")), "name", "name")
    return sources.chosen_late(there, names("nation", "n_name"), names("region", "r_name")).df


@query("SELECT o_orderkey AS k, CAST(o_custkey * 2 AS BIGINT) AS v FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 1")
def compose_steps(spark, sf_dir):
    final = where(F.col("o_orderstatus") == "F")
    third = final >> where(F.col("o_custkey") % 3 == 1)  # no source yet
    return (orders(spark, sf_dir) >> (third, mapping(F.col("o_orderkey").alias("k"), (F.col("o_custkey") * 2).alias("v")))).element()


@query("SELECT event_type FROM events WHERE value > 20 EXCEPT ALL SELECT event_type FROM events WHERE value > 60")
def diff_auto(spark, sf_dir):
    part = lambda c: flow(read(spark, sf_dir, "events").where(c).select("event_type"), (), "event_type")
    return (part(F.col("value") > 20) >> auto_diff(part(F.col("value") > 60))).element()


@query("SELECT c_custkey FROM customer WHERE c_custkey // 10 IN (SELECT o_custkey // 10 FROM orders WHERE o_orderstatus = 'P')")
def join_custom_cmp(spark, sf_dir):
    tens = lambda c: F.floor(F.col(c) / 10)
    others = flow(read(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), ["o_custkey", "o_orderkey"], "o_custkey")
    return (keyed(spark, sf_dir, "customer", "c_custkey") >> ordered_join(others, [(tens("c_custkey"), tens("o_custkey"))])).df.select("c_custkey")


@query("SELECT CAST(row_number() OVER (ORDER BY lower(k), src, k) - 1 AS BIGINT) AS pos, k FROM (SELECT n_name AS k, 0 AS src FROM nation UNION ALL SELECT lower(r_name), 1 FROM region)")
def union_merge_cmp(spark, sf_dir):
    a = flow(read(spark, sf_dir, "nation").select(F.col("n_name").alias("k")), "k", "k")
    b = flow(read(spark, sf_dir, "region").select(F.lower("r_name").alias("k")), "k", "k")
    merged = a >> union_merge(b, [F.lower("k")])
    return flow(merged.df, (*merged.pos, "k")).ordinal().select("pos", "k")


@query("SELECT CAST(row_number() OVER (ORDER BY v DESC, p_partkey) - 1 AS BIGINT) AS pos, v, p_partkey FROM (SELECT p_partkey, CAST(p_size + 20 - i * 10 AS INTEGER) AS v FROM part, range(3) t(i))")
def ordering_flat_map_cmp(spark, sf_dir):
    children = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.col("p_size") + 20 - i * 10)
    return (parts(spark, sf_dir) >> ordering_flat_mapping(children, "v", lambda x: -x)).ordinal().select("pos", "v", "p_partkey")


@query("WITH RECURSIVE t AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation), w(k, kept, last) AS (SELECT 0, true, (SELECT r FROM t WHERE k = 0) UNION ALL SELECT w.k + 1, abs(t.r - w.last) > 1, CASE WHEN abs(t.r - w.last) > 1 THEN t.r ELSE w.last END FROM w JOIN t ON t.k = w.k + 1) SELECT CAST(k AS INTEGER) AS n_nationkey FROM w WHERE kept")
def distinct_last(spark, sf_dir):
    near = lambda a, b: abs(a["n_regionkey"] - b["n_regionkey"]) <= 1
    return (keyed(spark, sf_dir, "nation", "n_nationkey") >> distinct_last_kept(near)).df.select("n_nationkey")


@query("SELECT CAST(sum(l_linenumber * l_linenumber) AS BIGINT) AS squares, CAST(max(l_linenumber) AS BIGINT) AS largest FROM lineitem")
def agg_custom(spark, sf_dir):
    def consume(state, batch):
        x = batch.column(0).to_numpy().astype("int64")
        return (state[0] + int((x * x).sum()), max(state[1], int(x.max()))) if len(x) else state

    merge = lambda a, b: (a[0] + b[0], max(a[1], b[1]))
    finish = lambda s: {"squares": s[0], "largest": s[1]}
    return flow(read(spark, sf_dir, "lineitem")) >> agg.collected(lambda: (0, 0), consume, merge, finish, "squares long, largest long", F.col("l_linenumber"))


@query("SELECT string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS s FROM orders")
def agg_fold_merge(spark, sf_dir):
    return orders(spark, sf_dir) >> agg.fold(F.lit(""), lambda a, x: F.concat(a, x), F.col("o_orderstatus"), "s", merge=lambda a, b: F.concat(a, b))


@query("SELECT 0 AS empty_before, count(*) AS drained, CAST(1 AS INTEGER) AS empty_none FROM nation")
def collect_effects(spark, sf_dir):
    """drain, for_each and is_empty: what is drained, by a look at each element, is read back."""
    path = _folder(spark)
    nations = keyed(spark, sf_dir, "nation", "n_nationkey")
    nations >> agg.drain(path)
    nations >> agg.for_each(lambda row: None)
    none = nations >> where(F.lit(False))
    return spark.read.parquet(path).agg(F.lit(int(agg.is_empty(nations))).alias("empty_before"), F.count("*").alias("drained"), F.lit(int(agg.is_empty(none))).alias("empty_none"))


@query("SELECT n_nationkey AS k FROM nation")
def iterated(spark, sf_dir):
    rows = [(r["n_nationkey"],) for r in sources.iterate(keyed(spark, sf_dir, "nation", "n_nationkey"))]  # 25 rows, pulled
    return spark.createDataFrame(rows, "k int")


@query("SELECT p_partkey, CAST(p_partkey - p_size AS BIGINT) AS d FROM part")
def unsigned_difference(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", bits.unsigned_difference(F.col("p_partkey"), F.col("p_size").cast("long")).alias("d"))


@query("SELECT n_nationkey, CASE WHEN length(n_name) + 3 > 12 THEN (n_name || '...')[1:12] ELSE n_name || '...' END AS more, n_name[2:4] AS part, '**' || n_name[3:] AS by FROM nation")
def string_edits(spark, sf_dir):
    n = F.col("n_name")
    return read(spark, sf_dir, "nation").select("n_nationkey", strings.append(n, F.lit("..."), 12, strict=False).alias("more"), strings.substr(n, F.lit(1), F.lit(3)).alias("part"), strings.replace(n, 0, 2, F.lit("**"), 40).alias("by"))


# ---- more of key-value tables


@query(_KV + "SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS BIGINT) AS pos, k, v FROM kv")
def kv_scan(spark, sf_dir):
    return _table(spark, sf_dir).scan().ordinal().select("pos", "k", "v")


@query(_KV + "SELECT k, v FROM kv WHERE starts_with(k, 'c13') ORDER BY k LIMIT 1")
def kv_prefixed_begin(spark, sf_dir):
    return _table(spark, sf_dir).prefixed_begin("c13")


@query(_KV + "SELECT EXISTS (SELECT 1 FROM kv WHERE starts_with(k, 'c1') AND k <> 'c1') AS a, EXISTS (SELECT 1 FROM kv WHERE starts_with(k, 'c1.1') AND k <> 'c1.1') AS b")
def kv_has_child(spark, sf_dir):
    t = _table(spark, sf_dir)
    return t.has_child("c1").toDF("a").crossJoin(t.has_child("c1.1").toDF("b"))


@query(_KV + "SELECT k, v FROM kv WHERE starts_with(k, 'c1') AND k >= 'c12/' ORDER BY k LIMIT 1")
def kv_prefixed_lower_bound(spark, sf_dir):
    return _table(spark, sf_dir).lower_bound("2/", prefix="c1")


@query("""WITH u AS (SELECT DISTINCT url FROM pages) SELECT count(*) + 1 AS nodes FROM u a WHERE EXISTS (SELECT 1 FROM u b WHERE starts_with(b.url, a.url) AND b.url <> a.url)""")
def kv_nodes(spark, sf_dir):
    return KeyValues(read(spark, sf_dir, "pages").select(F.col("url").alias("k")).distinct()).nodes_count()


@query(_KV + """, t AS (SELECT * FROM kv WHERE k >= 'c2'), stop AS (SELECT min(k) AS s FROM t WHERE NOT starts_with(k, 'c2'))
SELECT k, v FROM t, stop WHERE s IS NULL OR k < s""")
def kv_range_builder(spark, sf_dir):
    return _table(spark, sf_dir).range().starting(prefix="c2").going_on(prefix="c2").flow().df


@query(_KV + f"SELECT t.k, t.v FROM kv t WHERE {_CHILDREN.format(p='c3')}")
def kv_range_of_children(spark, sf_dir):
    return _table(spark, sf_dir).range().starting_at_child_of("c3").by_sibling().going_on(prefix="c3").flow().df


@query(_KV + "SELECT k, v FROM kv WHERE starts_with(k, 'c4') AND k >= 'c42' ORDER BY k LIMIT 1")
def kv_range_lower_bound(spark, sf_dir):
    return _table(spark, sf_dir).range().starting(prefix="c4").going_on(prefix="c4").lower_bound("c42")


@query(_KV + ", n AS (SELECT 'c9' || r_name AS k, CAST(r_regionkey AS BIGINT) AS v FROM region UNION ALL SELECT 'c9', -1) SELECT k, v FROM kv UNION ALL SELECT k, v FROM n WHERE k NOT IN (SELECT k FROM kv)")
def kv_prefixed_insert(spark, sf_dir):
    return _table(spark, sf_dir).prefixed_insert("c9", _below_nine(spark, sf_dir)).df


@query(_KV + ", n AS (SELECT 'c9' || r_name AS k, CAST(r_regionkey AS BIGINT) AS v FROM region UNION ALL SELECT 'c9', -1) SELECT k, coalesce(n.v, kv.v) AS v FROM kv FULL JOIN n USING (k)")
def kv_prefixed_upsert(spark, sf_dir):
    return _table(spark, sf_dir).prefixed_upsert("c9", _below_nine(spark, sf_dir)).df


def _below_nine(spark, sf_dir):
    region = read(spark, sf_dir, "region").select(F.col("r_name").alias("k"), F.col("r_regionkey").cast("long").alias("v"))
    return region.unionByName(spark.createDataFrame([("", -1)], "k string, v long"))


# ---- more of transactions


@query("SELECT n_name AS k, CASE WHEN n_regionkey = 0 THEN 'x' ELSE 'y' END AS v FROM nation WHERE n_regionkey < 4")
def tx_deltas(spark, sf_dir):
    """Commits write what they change; more of them than are kept apart become one, and a compaction changes no row."""
    nation = read(spark, sf_dir, "nation")
    rows = lambda c, v: nation.where(c).select(F.col("n_name").alias("k"), F.lit(v).alias("v"))
    store = Store(spark, _folder(spark), max_deltas=2)
    for c, v in (("n_regionkey < 3", "y"), ("n_regionkey = 3", "z"), ("n_regionkey = 0", "x"), ("n_regionkey = 3", "y"), ("n_regionkey = 4", "y")):
        with store.begin() as t:
            t.upsert(rows(c, v))
    store.compact()
    with store.begin() as t:
        t.erase(rows("n_regionkey = 4", "").select("k"))
    return store.table().df


@query("SELECT r_name AS k, 'kept' AS v FROM region UNION ALL SELECT lower(r_name), 'inner' FROM region")
def tx_open_savepoint(spark, sf_dir):
    """Leaving a transaction ends it as a whole, whatever is open within."""
    region = read(spark, sf_dir, "region")
    store = Store(spark, _folder(spark))
    with store.begin() as t:
        t.insert(region.select(F.col("r_name").alias("k"), F.lit("kept").alias("v")))
        t.savepoint()
        t.upsert(region.select(F.lower("r_name").alias("k"), F.lit("inner").alias("v")))
    return store.table().df


@query("SELECT 'conflict' AS what, 1 AS n UNION ALL SELECT 'apart', 2 UNION ALL SELECT 'tries', 2")
def tx_conflicts(spark, sf_dir):
    region = read(spark, sf_dir, "region")
    store = Store(spark, _folder(spark))
    row = lambda k, v: region.limit(1).select(F.lit(k).alias("k"), F.lit(v).alias("v"))
    one, two, apart = store.begin(), store.begin(), store.begin()
    one.upsert(row("m", "1"))
    two.upsert(row("m", "2"))
    apart.upsert(row("x", "3"))
    one.commit()
    conflicts = 0
    try:
        two.commit()
    except ConcurrentChange:
        conflicts += 1
    apart.commit()
    tries = []

    def work():
        t = store.begin()
        t.upsert(row("m", str(len(tries))))
        tries.append(t)
        if len(tries) == 1:
            with store.begin() as other:
                other.upsert(row("m", "other"))
        t.commit()

    with_retries(3, work)
    n = store.table().df.count()
    return spark.createDataFrame([("conflict", conflicts), ("apart", n), ("tries", len(tries))], "what string, n int")


@query("SELECT 'shared' AS what, count(*) AS n FROM region UNION ALL SELECT 'applied', count(*) FROM region WHERE r_name > 'B'")
def tx_apply(spark, sf_dir):
    """Readers share a transaction; a change may be any function of the table."""
    region = read(spark, sf_dir, "region").select(F.col("r_name").alias("k"), F.lit("v").alias("v"))
    store = Store(spark, _folder(spark))
    with store.begin() as t:
        t.insert(region)
        with t.shared() as table:
            seen = table.df.count()
    with store.begin() as t:
        t.change(lambda kv: KeyValues(kv.df.where("k > 'B'")))
    return spark.createDataFrame([("shared", seen), ("applied", store.table().df.count())], "what string, n long")


@query("SELECT count(*) AS n, true AS skipped FROM events WHERE event_id BETWEEN 100 AND 120")
def log_skipping(spark, sf_dir):
    """Buckets whose statistics exclude the condition are not read: the scan's own count of rows tells."""
    from ..streaming import Log

    log = Log(spark, f"{_folder(spark)}/log", "event_id long, user_id long", sort="event_id", bucket=100)
    log.append(read(spark, sf_dir, "events").select("event_id", "user_id"))
    condition = F.col("event_id").between(100, 120)
    skipped = log.rows_read(condition) < log.size().first()[0]
    return log.indexed(condition).agg(F.count("*").alias("n"), F.lit(skipped).alias("skipped"))
