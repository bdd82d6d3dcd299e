import random

from fieldglass.llm.components import group_extents, hash_to_min, match_groups


def brute(pairs):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {a: find(a) for a in parent}


def groups(spark, pairs):
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in pairs], "a int, b int, node int, member int")
    return {r.node: r.group_id for r in hash_to_min(df, left="a", right="b").collect()}


def test_random_chains_and_stars(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 540)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    pairs += [(7, 7), (None, 3), (3, None), (101, 100), (101, 100)]
    rng.shuffle(pairs)
    assert groups(spark, pairs) == brute(pairs)


def test_empty(spark):
    assert groups(spark, []) == {} and groups(spark, [(1, 1), (None, 2)]) == {}


def test_match_groups(spark):
    spans = spark.createDataFrame(
        [("j", 1, 0, 9), ("j", 2, 30, 20), ("j", 2, 30, 20), ("j", 3, 5, None), ("j", 9, 1, 1), ("k", 1, 0, 1), ("k", 2, 0, 1), (None, 1, 0, 1), ("j", None, 0, 1)],
        "job_id string, track_id int, first_frame int, last_frame int",
    )
    pairs = spark.createDataFrame(
        [("j", 2, 1, True), ("j", 1, 2, True), ("j", 2, 3, True), ("j", 3, 99, True), ("j", 99, 9, True), ("j", 9, 1, False), ("j", 9, 2, None), ("j", 9, 9, True), ("k", 1, 2, None), (None, 1, 2, True), ("j", None, 9, True)],
        "job_id string, track_a int, track_b int, is_match boolean",
    )
    got = match_groups(spans, pairs)
    assert sorted(map(tuple, got.collect())) == [("j", 1, 1), ("j", 2, 1), ("j", 3, 1)]
    assert [tuple(r) for r in group_extents(got, spans).collect()] == [("j", 1, 3, 0, 30)]


def test_long_chain_of_rising_ids(spark):
    pairs = [(i, i + 1) for i in range(1500)]
    assert set(groups(spark, pairs).values()) == {0}


def test_keys_keep_groups_apart_and_ids_may_be_text(spark):
    df = spark.createDataFrame([("x", "b", "a"), ("y", "b", "c"), (None, "b", "d")], "k string, l string, r string")
    got = {(r.k, r.node): r.group_id for r in hash_to_min(df, keys=["k"], left="l", right="r").collect()}
    assert got == {("x", "a"): "a", ("x", "b"): "a", ("y", "b"): "b", ("y", "c"): "b"}
