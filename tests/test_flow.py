"""Literal sequences in, literal sequences out."""

import random

import pytest
from pyspark.sql import functions as F

from tideline import UnorderedInput, flow, sources
from tideline import operators as op
from tideline.functions import aggregates as agg
from tideline.functions import bits, intervals, strings


def seq(spark, items, kind="string", order=False, name="value"):
    f = sources.of_container(spark, items, kind, name)
    return flow(f.df, "_pos", name if order else None)


def values(f, name="value"):
    return [r[0] for r in f.df.orderBy(*f.pos).select(name).collect()]


def test_sources(spark):
    assert values(sources.of_iota(spark, 0, 10, 3)) == [0, 3, 6]
    assert values(sources.of_iota(spark, 0, -3, -1)) == [0, -1, -2]
    with pytest.raises(ValueError):
        sources.of_iota(spark, 3, 0)
    assert values(sources.of_string_split(spark, "aa:;bbb:cccc;ddd dd:", ";:")) == ["aa", "bbb", "cccc", "ddd dd"]
    assert values(sources.of_string_split(spark, "abc", "")) == ["abc"]
    assert values(sources.of_string_split(spark, "", " ")) == []
    assert values(sources.of_string_split(spark, "a]b^c-d\\e", "]^-\\")) == list("abcde")
    assert values(sources.of_value(spark, 5, 2)) == [5, 5]
    assert values(sources.of_lazy_value(spark, lambda i: i * 2, 0)) == []
    assert values(sources.null(spark, "value int")) == []
    assert sources.of_container(spark, {3, 1, 2}, "int").ordered
    assert not sources.of_container(spark, [1, 2], "int").ordered
    assert values(sources.generator(spark, lambda i: i * i if i < 4 else None, "int")) == [0, 1, 4, 9]
    assert [r.value for r in sources.iterate(seq(spark, ["b", "a"]))] == ["b", "a"]


def test_map_and_filter(spark):
    f = seq(spark, ["11", "12", "13"])
    stepped = f.ordinal("step").select((F.col("value").cast("int") * F.col("step")).alias("v"), "step")
    assert [r.v for r in stepped.orderBy("step").collect()] == [0, 12, 26]
    composite = F.col("value").isin(4, 6, 8, 9)
    found = sources.of_iota(spark, 1, 10) >> op.where(F.col("value") > 1) >> op.maf(~composite, F.pow(F.lit(2), "value").cast("int").alias("value"))
    assert values(found)[:2] == [4, 8]
    assert values(seq(spark, [1, 2, 9, 3], "int") >> op.take_while(F.col("value") < 5)) == [1, 2]
    assert not (seq(spark, [1], "int", True) >> op.take_while(F.col("value") < 5)).ordered
    assert values(seq(spark, list(range(10)), "int") >> op.where_stateful(lambda r, n: None if n == 3 else r["value"] % 2 == 1)) == [1, 3, 5]


def test_flatten(spark):
    f = seq(spark, [2, 0, 3], "int") >> op.flat_mapping(F.when(F.col("value") > 0, F.sequence(F.lit(1), F.col("value"))).otherwise(F.array().cast("array<int>")), "x")
    assert values(f, "x") == [1, 2, 1, 2, 3]
    merged = seq(spark, [2, 1], "int") >> op.ordering_flat_mapping(F.array(F.col("value"), F.col("value") + 10), "x")
    assert values(merged, "x") == [1, 2, 11, 12]
    with pytest.raises(Exception, match="children must be ordered"):
        (seq(spark, [2], "int") >> op.ordering_flat_mapping(F.array(F.lit(3), F.col("value")), "x")).df.collect()


def test_defaults_and_errors(spark):
    none = seq(spark, [], "int")
    assert [r.value for r in (none >> op.or_default(sources.of_value(spark, 7))).element().collect()] == [7]
    assert [r.value for r in (seq(spark, [1], "int") >> op.or_default(sources.of_value(spark, 7))).element().collect()] == [1]
    alternative = spark.createDataFrame([(57,)], "v int")
    f = seq(spark, ["1", "x", "3"]) >> op.on_error(F.expr("try_cast(value AS int)"), "v", alternative)
    assert [r.v for r in f.df.orderBy("_src").collect()] == [1, 57]
    other = seq(spark, ["1", "x"]) >> op.on_error(F.expr("try_cast(value AS int)"), "v", alternative, is_error=F.col("value") == "y")
    with pytest.raises(Exception, match="another class"):
        other.df.collect()


def test_joins(spark):
    left = spark.createDataFrame([("a", 1.0), ("ab", 1.0), ("ab", 1.1), ("b", 1.0), ("ba", 1.0), ("ba", 1.1), ("mmxxx", 1.1), ("xyz", 1.0)], "k string, v double")
    right = seq(spark, ["a", "a", "ab", "ba", "ba", "mz", "xyz", "xyz"], name="r", order=True)
    want = [("a", 1.0), ("ab", 1.0), ("ab", 1.1), ("ba", 1.0), ("ba", 1.1), ("xyz", 1.0)]
    for join in (op.ordered_join, op.unordered_join, op.auto_join):
        found = flow(left, ["k", "v"], "k") >> join(right, [("k", "r")])
        assert [tuple(r) for r in found.df.orderBy("k", "v").collect()] == want
    turned = flow(left, ["k", "v"]) >> op.auto_join(right, [("k", "r")])
    assert values(turned, "r") == ["a", "a", "ab", "ba", "ba", "xyz", "xyz"]
    with pytest.raises(UnorderedInput):
        flow(left, "k") >> op.ordered_join(right, [("k", "r")])
    pairs = seq(spark, [1, 2], "int", name="a") >> op.cartesian(seq(spark, [10, 20], "int", name="b"))
    assert [tuple(r) for r in pairs.df.orderBy(*pairs.pos).select("a", "b").collect()] == [(1, 10), (2, 10), (1, 20), (2, 20)]


def test_join_forms(spark):
    """Sizes choose the form of a join; keys may be normal forms."""
    left = flow(spark.range(100_000).select(F.col("id").alias("k")), "k", "k")
    few = flow(spark.createDataFrame([(3,), (4,)], "r long"), "r", "r")
    for join in (op.ordered_join, op.unordered_join):
        found = left >> join(few, [("k", "r")])
        assert len(found.df.collect()) == 2
        assert "BroadcastHashJoin" in found.df._jdf.queryExecution().executedPlan().toString()
    mixed = seq(spark, ["AA", "b", "cC"], order=True)
    assert values(mixed >> op.ordered_join(seq(spark, ["aa", "CC"], name="r", order=True), [(F.lower("value"), F.lower("r"))])) == ["AA", "cC"]
    assert values(seq(spark, ["b", "AA"]) >> op.auto_join(seq(spark, ["aa"], name="r"), [(F.lower("value"), F.lower("r"))])) == ["AA"]


def test_comparators_of_merge_and_flatten(spark):
    a, b = (flow(spark.createDataFrame([(x,) for x in items], "value string"), "value", "value") for items in (["a", "C"], ["B", "c", "D"]))
    merged = a >> op.union_merge(b, [F.lower("value")])
    assert values(merged) == ["a", "B", "C", "c", "D"] and merged.ordered
    down = seq(spark, [2, 1], "int") >> op.ordering_flat_mapping(F.array(F.col("value") + 10, F.col("value")), "x", lambda x: -x)
    assert values(down, "x") == [12, 11, 2, 1]
    assert values(seq(spark, ["a", "b"], order=True) >> op.auto_diff(seq(spark, ["a"], order=True))) == ["b"]
    with pytest.raises(UnorderedInput):
        seq(spark, ["a"]) >> op.ordered_diff(seq(spark, ["a"]))


def test_steps_compose_without_a_source(spark):
    odd = op.where(F.col("value") % 2 == 1)
    squares = op.mapping((F.col("value") * F.col("value")).alias("value"))
    both = odd >> squares
    f = sources.of_iota(spark, 0, 6)
    assert values(f >> both) == values(f >> (odd, squares)) == [1, 9, 25]
    assert (f >> (both >> agg.total(F.col("value")))).first()[0] == 35
    assert values(f >> (odd >> (squares, op.where(F.col("value") > 1)))) == [9, 25]


def test_zip(spark):
    a, b, c = seq(spark, [1, 2, 3], "int", name="a"), seq(spark, list("abcd"), name="b"), seq(spark, [1.1, 2.2], "double", name="c")
    assert [tuple(r)[1:] for r in (a >> op.zip_short(b, c)).df.orderBy("pos").collect()] == [(1, "a", 1.1), (2, "b", 2.2)]
    longest = (a >> op.zip_longest(b, c)).df.orderBy("pos").select("a", "b", "c", "_has0", "_has2").collect()
    assert [tuple(r) for r in longest][2:] == [(3, "c", None, True, False), (None, "d", None, False, False)]


def test_sets(spark):
    left, sub = ["aa", "aa", "bb", "bb", "bb", "c", "xx", "xx"], ["aaa", "a", "bb", "bb", "d", "x", "z"]
    assert values(seq(spark, left, order=True) >> op.diff(seq(spark, sub))) == ["aa", "aa", "bb", "c", "xx", "xx"]
    mixed = ["aa", "aa", "BB", "bb", "BB", "C", "xx", "XX"]
    assert values(seq(spark, mixed) >> op.diff(seq(spark, sub), [F.lower("value")])) == ["aa", "aa", "BB", "C", "xx", "XX"]
    assert values(seq(spark, [1, 2, 2, 5, 3, 3, 2], "int") >> op.distinct_auto()) == [1, 2, 5, 3]
    assert values(seq(spark, left, order=True) >> op.distinct_sorted()) == ["aa", "bb", "c", "xx"]
    with pytest.raises(UnorderedInput):
        seq(spark, left) >> op.distinct_sorted()
    rng = random.Random(1)
    many, less = ([rng.choice(["hot", "hot", "b", None, "c"]) for _ in range(n)] for n in (300, 120))
    budget, want = {k: less.count(k) for k in set(less)}, []
    for v in many:
        if budget.get(v, 0):
            budget[v] -= 1
        else:
            want.append(v)
    assert values(seq(spark, many) >> op.diff(seq(spark, less))) == want
    walk = [rng.randint(0, 30) for _ in range(400)]
    kept = [walk[0]]
    for v in walk[1:]:
        if abs(v - kept[-1]) > 9:
            kept.append(v)
    assert values(flow(seq(spark, walk, "int", True).df.repartition(5), "_pos", "value") >> op.distinct_last_kept(lambda x, y: abs(x["value"] - y["value"]) <= 9)) == kept
    half = sources.of_iota(spark, 1, 7) >> op.distinct_last_kept(lambda a, b: a["value"] // 2 == b["value"] // 2)
    assert values(half) == [1, 2, 4, 6]
    assert values(sources.of_iota(spark, 1, 7) >> op.distinct_adjacent(F.floor(F.col("value") / 2))) == [1, 2, 4, 6]
    f = seq(spark, [1, 2, 3], "int") >> op.union_all(seq(spark, [10], "int"), seq(spark, [100, 101], "int"))
    assert values(f) == [1, 2, 3, 10, 100, 101]
    m = flow(spark.createDataFrame([(1,), (3,)], "value int"), "value", "value") >> op.union_merge(flow(spark.createDataFrame([(2,), (3,)], "value int"), "value", "value"))
    assert values(m) == [1, 2, 3, 3]


def test_hierarchy(spark):
    edges = spark.createDataFrame([("a", "a.0"), ("a", "a.1"), ("a.0", "a.0.0"), ("b", "b.0")], "parent string, child string")
    roots = spark.createDataFrame([("a",), ("b",), ("1",)], "node string")
    found = op.descendants(roots, edges)
    assert [r.node for r in found.orderBy(*op.deep_first(found)).collect()] == ["a.0", "a.0.0", "a.1", "b.0"]
    assert [r.node for r in found.orderBy(*op.breadth_first(found)).collect()] == ["a.0", "a.1", "b.0", "a.0.0"]
    assert op.descendants(roots.where("node = '1'"), edges).count() == 0
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string")
    with pytest.raises(Exception, match="cycle"):
        op.descendants(roots, loop)
    assert op.descendants(roots.where("node = 'a'"), loop, max_levels=3).count() == 3
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "a int, b int")
    start = spark.createDataFrame([(1,)], "node int")
    assert sorted(r.node for r in op.reachable(start, ring).collect()) == [2, 3]


def test_prefix_join(spark):
    keys = spark.createDataFrame([(k,) for k in ["12", "123", "1231", "ab", "abc", "abc1", "xy"]], "k string")
    prefixes = ["123", "789", "abc", "abc1", "xyz"]
    once = seq(spark, prefixes, order=True, name="p") >> op.prefix_join(keys, "k", "p")
    assert [r.k for r in once.df.orderBy("k").collect()] == ["123", "1231", "abc", "abc1"]
    every = seq(spark, ["abc", "abc1", "abc"], name="p") >> op.prefix_join(keys, "k", "p")
    assert values(every, "k") == ["abc", "abc1", "abc1", "abc", "abc1"]


def test_collectors(spark):
    f, none = sources.of_iota(spark, 1, 5), sources.of_iota(spark, 0, 0)
    one = lambda df: df.first()[0]
    assert one(f >> agg.product(F.col("value"), 1)) == 24 and one(f >> agg.product(F.col("value"), 0)) == 0
    assert one(sources.of_iota(spark, 1, 4) >> agg.total(F.col("value"), initial=F.lit(1))) == 7
    assert one(none >> agg.total(F.col("value"))) == 0 and one(none >> agg.count()) == 0
    assert one(f >> agg.first(of=F.col("value"))) == 1 and one(f >> agg.last(of=F.col("value"))) == 4
    with pytest.raises(Exception, match="empty"):
        (none >> agg.first(of=F.col("value"))).collect()
    with pytest.raises(agg.EmptySequence):
        none >> agg.require_first
    assert one(f >> agg.fold(F.lit(0).cast("long"), lambda a, x: a * 10 + x, F.col("value"))) == 1234


def test_fold_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(agg, "BLOCK", 3)
    f = flow(spark.createDataFrame([(k, chr(97 + k)) for k in range(26)], "p int, c string").repartition(3), "p")
    word = f >> agg.fold(F.lit(""), lambda a, x: F.concat(a, x), F.col("c"), merge=lambda a, b: F.concat(a, b))
    assert word.first()[0] == "abcdefghijklmnopqrstuvwxyz"
    none = (f >> op.where(F.lit(False))) >> agg.fold(F.lit("x"), lambda a, x: F.concat(a, x), F.col("c"), merge=lambda a, b: F.concat(a, b))
    assert none.first()[0] == "x"


def test_pairwise_is_two_strands_of_pairs(spark):
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 7, 500):
        x = [rng.uniform(-1, 1) * 10 ** rng.randint(-3, 12) for _ in range(n)]
        strands = [0.0, 0.0]
        for k in range(0, n - 1, 2):
            strands[k // 2 % 2] += x[k] + x[k + 1]
        want = strands[0] + strands[1] + (x[-1] if n % 2 else 0.0)
        f = flow(spark.createDataFrame(list(enumerate(x)), "p int, x double").repartition(3), "p")
        assert (f >> agg.pairwise(F.col("x"))).first()[0] == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_own_collectors_and_sources(spark):
    f = sources.of_source(spark, [1, 2, 3], lambda p: [(p, k) for k in range(p)], "part int, k int", ["part", "k"])
    assert sorted(tuple(r) for r in f.df.collect()) == [(1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]
    names = f >> agg.collected(set, lambda s, b: s | set(b.column(0).to_pylist()), lambda a, b: a | b, lambda s: {"parts": sorted(s)}, "parts array<int>", F.col("part"))
    assert names.first().parts == [1, 2, 3]
    none = (f >> op.where(F.lit(False))) >> agg.collected(int, lambda s, b: s + b.num_rows, lambda a, b: a + b, lambda s: {"n": s}, "n long")
    assert none.first().n == 0
    yes = sources.chosen_late(spark.createDataFrame([(True,)], "b boolean"), sources.of_iota(spark, 0, 2), sources.of_iota(spark, 5, 9))
    assert values(yes) == [0, 1]


@pytest.mark.parametrize("kind", ["kahan", "neumaier"])
def test_compensated_sums(spark, kind):
    tenths = sources.of_lazy_value(spark, lambda i: F.lit(0.1) + i, 1021)
    assert abs((tenths >> agg.compensated(F.col("value"), kind)).first()[0] - (102.1 + 1020 * 1021 / 2)) < 1e-9
    big = flow(spark.createDataFrame([(1.0,), (1e100,), (1.0,), (-1e100,)], "value double"))
    total = (big >> agg.compensated(F.col("value"), kind)).first()[0]
    if kind == "neumaier":
        assert total == 2.0
    else:  # Kahan's correction is lost beside so large a number: the error stays within its size
        assert abs(total - 2.0) <= 2.0
    assert (flow(spark.createDataFrame([], "value double")) >> agg.compensated(F.col("value"), kind)).first()[0] == 0.0


def test_intervals(spark):
    cases = [((9, 5), True), ((14, 1), True), ((0, 11), True), ((9, 6), True), ((0, 10), False), ((1, 1), False), ((15, 2), False), ((20, 2), False), ((12, 0), False)]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, p int, n int")
    a, b = intervals.interval(F.lit(10), F.lit(5)), intervals.interval(F.col("p"), F.col("n"))
    assert [r[0] for r in df.orderBy("i").select(intervals.overlaps(a, b)).collect()] == [w for _, w in cases]
    rng = random.Random(4)
    spans = [(rng.randint(-300, 300), rng.choice((0, 1, 5, 40, 900, 10**12))) for _ in range(120)]
    left, right = (spark.createDataFrame([(k, *s) for k, s in enumerate(part)], f"{n} int, {n}p long, {n}n long") for n, part in (("a", spans[:60]), ("b", spans[60:])))
    met = op.overlap_join(left, right, F.col("ap"), F.col("an"), F.col("bp"), F.col("bn"), 3).select("a", "b").collect()
    want = [(i, j) for i, (p, n) in enumerate(spans[:60]) for j, (q, m) in enumerate(spans[60:]) if n and m and p < q + m and q < p + n]
    assert sorted(map(tuple, met)) == want
    joined = op.overlap_join(df, spark.createDataFrame([(10, 5)], "q int, m int"), F.col("p"), F.col("n"), F.col("q"), F.col("m"), 3)
    assert sorted(r.i for r in joined.collect()) == [0, 1, 2, 3]


def test_bits_and_strings(spark):
    numbers = [0, 1, 2, 12, 255, 2**40, -1, -(2**63)]
    df = spark.createDataFrame([(x,) for x in numbers], "x long")
    x = F.col("x")
    rows = df.select("x", bits.count_bits(x), bits.first_set(x), bits.last_set(x), bits.get(x, F.lit(2)), bits.next_set(x, F.lit(2)), bits.previous_set(x, F.lit(3))).collect()
    for n, ones, low, high, third, above, below in rows:
        places = [k for k in range(64) if n >> k & 1]
        assert (ones, low, high, third) == (len(places), min(places, default=-1), max(places, default=-1), 2 in places)
        assert above == min((k for k in places if k > 2), default=-1) and below == max((k for k in places if k < 3), default=-1)
    powers = spark.createDataFrame([(k,) for k in (1, 2, 3, 5, 8, 9)], "x long").select(bits.ceil_power(x)).collect()
    assert [r[0] for r in powers] == [1, 2, 4, 8, 8, 16]
    changed = spark.createDataFrame([(5,)], "x long").select(bits.put(x, F.lit(1)), bits.clear(x, F.lit(0)), bits.toggle(x, F.lit(2)), bits.invert(x)).first()
    assert tuple(changed) == (7, 4, 1, ~5)
    far = spark.createDataFrame([(-1, 1), (5, 7)], "a long, b long").where("a = 5")
    assert far.select(bits.unsigned_difference(F.col("a"), F.col("b"))).first()[0] == -2
    with pytest.raises(Exception, match="(?i)overflow"):  # 2**64 - 1 and 1
        spark.createDataFrame([(-1, 1)], "a long, b long").select(bits.unsigned_difference(F.col("a"), F.col("b"))).collect()
    text = spark.createDataFrame([("abc",)], "t string")
    assert text.select(strings.bounded(F.col("t"), 2, strict=False)).first()[0] == "ab"
    assert tuple(text.select(strings.at(F.col("t"), F.lit(1)), strings.compare(F.col("t"), F.lit("ab"))).first()) == ("b", 1)
    with pytest.raises(Exception, match="longer than 2"):
        text.select(strings.bounded(F.col("t"), 2)).collect()
