"""Warnings: all kinds, unmet rows counted in the job that writes them, and counted anew where that job saw only a part."""

import uuid

from loomwork.operators import generate as G

NEVER = "schema R { a: int in 1..9, ok: int in 0..1 assume a > 9 } dataset D { rs: 500 of R }"


def jobs(spark, act) -> int:
    """How many jobs ``act`` runs."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    act()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_written_rows_are_counted_as_they_are_written(spark, tmp_path):
    g = G.Generator(spark, NEVER, G.Options(1, attempts=3))
    assert jobs(spark, lambda: g.run()["rs"].write.parquet(str(tmp_path / "out"))) == 1
    said = []
    assert jobs(spark, lambda: said.extend(g.warnings)) == 0
    assert [str(w) for w in said] == ["R: 500 of 500 rows satisfy no attempt of 3 (satisfying)"] and said[0].kind == G.RETRIES
    assert g.warnings == said


def test_parts_of_rows_do_not_count(spark):
    g = G.Generator(spark, NEVER, G.Options(1, attempts=3))
    assert len(g.run()["rs"].limit(3).collect()) == 3
    assert "500 of 500" in g.warnings[0]
    g = G.Generator(spark, NEVER, G.Options(1, attempts=3))
    frames = g.run()
    assert "500 of 500" in g.warnings[0]  # nothing was run at all
    assert frames["rs"].select("a").where("a > 9").count() == 0 and len(g.warnings) == 1


def test_changed_rows_are_counted(spark):
    text = "schema R { a: int in 1..9, n: int in 0..0 assume a > 9 } schema P { r: any of rs, by: int in 1..3 } then { r.n += by } dataset D { rs: 50 of R, ps: 90 of P }"
    g = G.Generator(spark, text, G.Options(2, attempts=2))
    frames = g.run()
    assert frames["rs"].selectExpr("sum(n) AS n").first().n == frames["ps"].selectExpr("sum(by) AS n").first().n
    assert [w.kind for w in g.warnings] == [G.RETRIES] and "50 of 50" in g.warnings[0]


def test_all_kinds(spark):
    base = [f for f in G.Generator(spark, "schema B { a: int in 1..2 }").schemas["B"].fields]
    text = """
    schema R from api.B { more: unique int in 1..3 assume a > 2 }
    schema P { r: int in 1..2 } then { r.missing += 1 }
    dataset D { rs: 9 of R, ps: 3 of P, validate { nothing(rs) > 1 } }
    """
    g = G.Generator(spark, text, G.Options(1, attempts=2, dataset_attempts=1, imports={"api": {"B": base}}))
    for df in g.run().values():
        df.collect()
    assert {w.kind for w in g.warnings} == {G.UNIQUE, G.RETRIES, G.EVALUATION, G.TARGET, G.UNKNOWN}
    assert any("nothing(rs)" in w for w in g.warnings if w.kind == G.EVALUATION)
    assert len(g.warnings) == len(set(g.warnings))


def test_rows_of_dropped_datasets_are_not_warned_of(spark):
    g = G.Generator(spark, "schema R { a: int in 1..2, b: int in 1..2 assume a < b } dataset D { rs: 2 of R, validate { sum(rs.a) > 0 } }", G.Options(1))
    g.run()
    assert len(g.pending) == 1 and not g.warnings
