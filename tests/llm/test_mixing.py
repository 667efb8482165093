"""Raking against its targets, and the defined results of odd rows."""

from collections import defaultdict

from voxtally.llm import mixing


def test_weights_meet_all_targets(spark):
    rows = [(i, f"w{i} " * (1 + i % 7) + ("###" * 9 if i % 11 == 0 else ""), "ab"[i % 3 > 0], ["x", "y", None][i % 5 % 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").repartition(4)
    cells = mixing.fitted_cells(mixing.described(df)).collect()
    total = sum(c.tokens for c in cells)
    for dim in ("_source", "_lang", "_topic"):
        have, want = defaultdict(float), defaultdict(float)
        for c in cells:
            have[c[dim]] += c.w
            want[c[dim]] += c.tokens
        scale = sum(v**0.5 for v in want.values())
        assert all(abs(have[v] - want[v] ** 0.5 / scale) < 1e-6 for v in want)
    spent = sum(c.tokens * c.probability for c in cells)
    assert abs(spent - mixing.BUDGET * total) < 1e-4 * total
    assert any(c.probability < 1 for c in cells)
    assert cells[0].gap <= mixing.TOLERANCE


def test_odd_rows(spark):
    rows = [(None, None, None, None, 1), (1, "", "a", "en", 2), (1, "", "a", "en", 2), (2, "x y\nz", None, "en", 3), (3, "b " * 90_000, "a", "fr", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, weight int")
    got = mixing.mix(df).collect()
    assert sorted((r.n_tokens, r.source, r.lang) for r in got) == [
        (1, "(null)", "(null)"), (1, "a", "en"), (1, "a", "en"), (3, "(null)", "en"), (90_001, "a", "fr")]
    assert len({r.sampled for r in got if r.doc_id == 1}) == 1
    kept = mixing.mixed(df)
    assert kept.columns == df.columns and kept.count() == sum(r.sampled for r in got)
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.mixed(df.limit(0)).collect() == []


def shares(cells, dim):
    out = defaultdict(float)
    for c in cells:
        out[c[dim]] += c.w
    return out


def test_target_weights_of_dependent_dimensions(spark):
    # language nearly decides the source
    rows = [(i, "w " * (5 + i % 9), "ab"[i % 10 == 0 if i % 2 else i % 10 != 0], ["x", "y"][i % 2]) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").repartition(4)
    table = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("x", 1.0), ("z", 9.0)], "lang string, share double")
    cells = mixing.fitted_cells(mixing.described(df), {"source": {"a": 3, "b": 1}, "lang": table}, tolerance=1e-9).collect()
    assert cells[0].gap <= 1e-9 and cells[0].sweeps > mixing.SWEEPS_A_TABLE
    got = shares(cells, "_source")
    assert abs(got["a"] - 0.75) < 1e-6 and abs(got["b"] - 0.25) < 1e-6
    got = shares(cells, "_lang")
    assert abs(got["x"] - 0.5) < 1e-6 and abs(got["y"] - 0.5) < 1e-6


def test_values_without_a_target_are_not_sampled_and_excluding_targets_leave_a_gap(spark):
    rows = [(i, "w w", "ab"[i % 2], ["x", "y"][i % 2]) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    got = mixing.mix(df, targets={"source": {"a": 1}}).collect()
    assert {r.source for r in got if r.sampled} == {"a"} and {r.probability for r in got if r.source == "b"} == {0.0}
    cells = mixing.fitted_cells(mixing.described(df), {"source": {"a": 3, "b": 1}, "lang": {"x": 1, "y": 1}}, most_sweeps=9).collect()
    assert abs(cells[0].gap - 0.25) < 1e-9 and cells[0].sweeps == 9


def test_many_cells_are_raked_by_shuffles_alike(spark, monkeypatch):
    rows = [(i, f"w{i} " * (1 + i % 7), "abc"[i % 3], "xy"[i % 5 % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").repartition(4)
    one = {(r.doc_id, r.sampled, r.probability) for r in mixing.mix(df).collect()}
    monkeypatch.setattr(mixing, "CELLS_IN_A_TASK", 0)
    assert {(r.doc_id, r.sampled, r.probability) for r in mixing.mix(df).collect()} == one


def test_clashing_names(spark):
    names = ["_tokens", "_source", "_lang", "_topic", "_weight", "_probability", "_sampled", "tokens", "w"]
    df = spark.createDataFrame([(i, "a b", "s", "l", *range(9)) for i in range(50)], ["doc_id", "text", "source", "lang", *names])
    got = mixing.mixed(df)
    assert got.columns == df.columns
    rows = {r.doc_id: r for r in df.collect()}
    kept = got.collect()
    assert kept and all(rows[r.doc_id] == r for r in kept)


def test_no_plan_of_raking_has_more_than_a_few_sweeps(spark, monkeypatch):
    plans, write = [], mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, tag: (plans.append(df._jdf.queryExecution().analyzed().toString()), write(df, tag))[1])
    df = spark.createDataFrame([("a", "x", 1.0, 0.5, 0.4), ("a", "y", 2.0, 0.5, 0.6), ("b", "x", 3.0, 0.5, 0.4), ("b", "y", 4.0, 0.5, 0.6)],
                               "s string, l string, w double, s_share double, l_share double")
    mixing.rake(df, ["s", "l"], most=4)
    assert plans and max(p.count("Window [") for p in plans) <= 2 * (mixing.SWEEPS_A_PLAN + 1)
