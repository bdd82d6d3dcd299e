from datetime import datetime, timezone

from fieldglass.operators.references import Parent, Reference, orphan_references, orphan_report

t = lambda d, h=0: datetime(2031, 5, d, h, tzinfo=timezone.utc)
U = "0d9f3c1e-aaaa-4bbb-8ccc-0123456789ab"


def run(spark, refs, parents, **kw):
    r = spark.createDataFrame(refs, "job_id string, k string, at timestamp, ref_key string, kind string, _key string") if refs is not None else None
    p = spark.createDataFrame(parents, "k string, created_at timestamp, deleted_at timestamp, at timestamp")
    return orphan_references([Reference("t", "k", r, "k", "at", "p")], [Parent("p", p, "k")], **kw)


def kinds(df):
    return sorted((x.job_id or "", x.ref_key, x.ref_month, x.kind) for x in df.collect())


def ref(job, key, at):
    return (job, key, at, "clash", "clash", "clash")


def test_kinds_and_spellings(spark):
    refs = [
        ref("a", U, t(5)), ref("b", "  " + U.upper().replace("-", "") + " ", t(1)), ref("c", U.replace("-", ""), t(25)), ref("d", "nobody", t(5)),
        ref("d", "NOBODY ", t(6)), ref("e", None, t(5)), ref("f", "nobody", None), ref(None, "nobody", t(5)), ref("g", U, None), ref("h", "", t(5)),
    ]
    got = kinds(run(spark, refs, [(U, t(2), t(20), None)]))
    assert got == sorted([
        ("b", U, "2031-05", "late"), ("c", U, "2031-05", "deleted"), ("d", "nobody", "2031-05", "missing"), ("f", "nobody", None, "missing"),
        ("", "nobody", "2031-05", "missing"), ("h", "", "2031-05", "missing"),
    ])


def test_bounds_and_both_kinds_in_a_month(spark):
    refs = [ref("a", U, t(2)), ref("b", U, t(20)), ref("c", U, t(1)), ref("c", U, t(21))]
    assert kinds(run(spark, refs, [(U, t(2), t(20), None)])) == [("b", U, "2031-05", "deleted"), ("c", U, "2031-05", "deleted"), ("c", U, "2031-05", "late")]


def test_null_times_of_parents_and_repeated_parents(spark):
    refs = [ref("a", "x", t(5)), ref("a", "y", t(5))]
    assert kinds(run(spark, refs, [("x", None, None, None), ("y", t(9), None, None), ("y", t(1), t(3), None)])) == []


def test_many_ranges_and_batches_agree(spark):
    parents = [(f"k{i:04d}", t(2), None, None) for i in range(300)]
    refs = [ref("a", f"k{i % 400:04d}", t(5)) for i in range(1600)] + [ref(f"j{i}", "k0001", t(1)) for i in range(200)]
    whole, cut = run(spark, refs, parents), run(spark, refs, parents, keys_per_range=16, batch_rows=10)
    assert kinds(whole) == kinds(cut) and len(kinds(cut)) == 100 + 200


def test_empty(spark):
    assert kinds(run(spark, [], [(U, t(2), None, None)])) == []
    some = run(spark, [ref("a", U, t(5))], [])
    assert kinds(some) == [("a", U, "2031-05", "missing")]
    assert [tuple(r) for r in orphan_report(some).collect()] == [("t", "k", "2031-05", "missing", 1, 1)]
