import numpy as np
import pytest
from pyspark.sql import functions as F

from splitlab.functions.odds import CLAMPS
from splitlab.functions.outcomes import OUTCOMES
from splitlab.operators import blocks, design, estimates, ranking, rates, regress, solvers, spread
from splitlab.plans import catalog
from tests.fixtures import plate_frame, plate_rows

SPLITS = ["batter", "pitcher"]
ROWS = plate_rows()


@pytest.fixture(scope="module")
def events(spark):
    return plate_frame(spark, ROWS).cache()


def dense(space="share", clamp_pair=CLAMPS["narrow"], tau=(1.0, 1.0)):
    labels = sorted({("batter", r[1]) for r in ROWS}) + sorted({("pitcher", r[2]) for r in ROWS})
    at = {label: i for i, label in enumerate(labels)}
    x = np.zeros((len(ROWS), len(labels)))
    y = np.zeros((len(ROWS), len(OUTCOMES)))
    for i, (_, b, p, e) in enumerate(ROWS):
        x[i, at["batter", b]], x[i, at["pitcher", p]] = tau
        y[i, OUTCOMES.index(e)] = 1
    mean = y.mean(axis=0)
    if space == "logit":
        y = np.where(y == 1, clamp_pair[0], clamp_pair[1])
        y, mean = np.log(y / (1 - y)), np.log(mean / (1 - mean))
    return labels, x, y - mean


def matrix(df, labels, columns=OUTCOMES):
    found = {(r.split, r.level): [r[c] for c in columns] for r in df.collect()}
    assert sorted(found) == sorted(labels)
    return np.array([found[label] for label in labels])


def test_gram_and_xty(events):
    labels, x, y = dense()
    at = {label: i for i, label in enumerate(labels)}
    made = np.zeros((len(labels), len(labels)))
    for r in design.gram(events, SPLITS).collect():
        made[at[r.split, r.level], at[r.split2, r.level2]] = r.n
    assert np.array_equal(made, x.T @ x)
    assert matrix(design.xty(events, SPLITS), labels) == pytest.approx(x.T @ y, abs=1e-9)
    _, x, y = dense("logit", CLAMPS["wide"])
    made = design.xty(events, SPLITS, "logit", CLAMPS["wide"])
    assert matrix(made, labels) == pytest.approx(x.T @ y, abs=1e-7)


def test_residual_outcomes(events):
    _, _, y = dense("logit")
    made = design.residual_outcomes(events, design.event_means(events), "logit")
    found = np.array([[r[e] for e in OUTCOMES] for r in made.orderBy("event_seq").collect()])
    assert found == pytest.approx(y, abs=1e-9)


def test_long_design(events):
    made = design.long_design(events, ["event_seq"], SPLITS)
    assert made.count() == 2 * len(ROWS)


@pytest.mark.parametrize("alpha", [1.0, 100.0])
def test_ridge(events, alpha):
    labels, x, y = dense()
    best = np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y)
    assert matrix(regress.ridge(events, alpha, SPLITS), labels) == pytest.approx(best, abs=1e-8)


def test_min_norm(events):
    labels, x, y = dense("logit")
    best = np.linalg.lstsq(x, y, rcond=None)[0]
    found = matrix(regress.min_norm(events, SPLITS, "logit"), labels)
    assert found == pytest.approx(best, abs=1e-6)
    null = np.array([1.0 if split == "batter" else -1.0 for split, _ in labels])
    assert null @ found == pytest.approx(np.zeros(len(OUTCOMES)), abs=1e-6)


def test_tau(events):
    labels, x, y = dense("logit", tau=(3.0, 2.0))
    best = np.linalg.lstsq(x, y, rcond=None)[0]
    found = regress.min_norm(events, SPLITS, "logit", tau={"batter": 3.0, "pitcher": 2.0})
    assert matrix(found, labels) == pytest.approx(best, abs=1e-6)


def test_least_squares_fit(events):
    labels, x, y = dense("logit")
    best = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    found = x @ matrix(regress.least_squares(events, SPLITS), labels)
    assert found == pytest.approx(best, abs=1e-6)


@pytest.mark.parametrize("cells", [solvers.ACTIVE_CELLS, 0])
def test_lasso_conditions(events, monkeypatch, cells):
    # with no cells allowed in a task, the active levels are solved by distributed steps
    monkeypatch.setattr(solvers, "ACTIVE_CELLS", cells)
    alpha = 0.2
    labels, x, y = dense("logit")
    b = matrix(regress.lasso(events, alpha, SPLITS), labels)
    pull = x.T @ (y - x @ b) / len(ROWS)
    assert (np.abs(pull) <= alpha + 1e-5).all()
    assert (b != 0).any()
    assert pull[b != 0] == pytest.approx(alpha * np.sign(b[b != 0]), abs=1e-5)


@pytest.mark.parametrize("broadcast", [solvers.BROADCAST_LEVELS, 0])
def test_products_of_halves(spark, monkeypatch, broadcast):
    monkeypatch.setattr(solvers, "BROADCAST_LEVELS", broadcast)
    rows = [*ROWS, (9001, None, "p1", "K"), (9002, "b1", None, "K"), (9003, "b1", None, "K")]
    rows = [(*r, f"s{i % 3}") for i, r in enumerate(rows)]
    plate = spark.createDataFrame(rows, "event_seq bigint, batter string, pitcher string, event string, gamesite string")
    table = design.gram(plate, [*SPLITS, "gamesite"])
    vectors = table.select("split", "level").distinct().filter("level != 'p2'")
    vectors = vectors.withColumn("v", F.expr("array(hash(split, level) % 100 + 0.5D, 1D)"))
    gram = solvers.prepared(table)

    def found(left):
        return {tuple(r[:2]): r[2] for r in solvers.product(left, vectors, "v", 2).collect()}

    whole, halves = found(table), found(gram)
    assert gram.largest == "batter" and gram.half.count() < table.count()
    assert halves.keys() == whole.keys()
    assert all(halves[k] == pytest.approx(whole[k]) for k in whole)
    solvers.released(gram)


def test_checks_count_the_events_once(spark, events, monkeypatch):
    calls = []
    for name in ("gram", "level_counts"):
        whole = getattr(design, name)
        monkeypatch.setattr(design, name, lambda *a, whole=whole, name=name, **k: calls.append(name) or whole(*a, **k))
    monkeypatch.setattr(catalog.plate, "MODEL_SPLITS", tuple(SPLITS))
    monkeypatch.setattr(catalog, "batting", lambda *a, **k: events)
    system = regress.system
    monkeypatch.setattr(regress, "system", lambda plate, *a, **k: system(plate, SPLITS, *a, **k))
    rows = catalog.ridge_check(spark, None).collect()
    assert sorted(calls) == ["gram", "level_counts"]
    assert len(rows) == 10 and all(r.ok for r in rows)


def test_rank(spark, events):
    made = solvers.gram_rank(design.gram(events, SPLITS)).first()
    _, x, _ = dense()
    assert (made.p, made.rank) == (x.shape[1], np.linalg.matrix_rank(x))


def test_rank_with_more_null_directions_than_probes(spark):
    # twelve separate batter-pitcher blocks: one null direction each
    rows = [(i, f"b{i % 24}", f"p{i % 12}", "K") for i in range(96)]
    gram = solvers.prepared(design.gram(plate_frame(spark, rows), SPLITS))
    levels = gram.select("split", "level").distinct()
    assert levels.count() == 36
    assert solvers.least_norm(gram, levels, [], probes=4)[1] == 12


@pytest.mark.parametrize("weighted", [False, True])
def test_multinomial_gradient(events, weighted):
    weights = design.class_weights(events) if weighted else None
    effects, intercepts = regress.multinomial(events, SPLITS, weights)
    labels, x, _ = dense()
    names = sorted(OUTCOMES)
    b = matrix(effects, labels, names)
    base = {r.event: r.b for r in intercepts.collect()}
    w = {r.event: r.w for r in weights.collect()} if weighted else dict.fromkeys(names, 1.0)
    score = np.exp(x @ b + np.array([base[e] for e in names]))
    p = score / score.sum(axis=1, keepdims=True)
    y = np.array([[float(r[3] == e) for e in names] for r in ROWS])
    each = np.array([w[r[3]] for r in ROWS])[:, None]
    assert x.T @ (each * (y - p)) - b == pytest.approx(np.zeros_like(b), abs=1e-3)
    gap = regress.multinomial_gap(events, effects, intercepts, SPLITS, weights)
    assert np.abs(matrix(gap, labels, names)).max() < 1e-3


@pytest.mark.parametrize("weighted, limit", [(False, "10MB"), (True, "-1")])
def test_multinomial_off_the_driver(spark, monkeypatch, weighted, limit):
    # with no coefficients allowed in the driver; a limit of -1 leaves no lookup small
    def learner(**_):
        raise AssertionError("coefficients went through the driver")

    rows = [*ROWS, (9001, None, "p1", "K"), (9002, "b1", None, "K"), (9003, None, None, "HR"), (9004, "b1", "p1", None)]
    plate = plate_frame(spark, rows).cache()
    weights = design.class_weights(plate) if weighted else None
    made = design.equal_events(plate, SPLITS)
    assert made.agg(F.sum("n")).first()[0] == len(ROWS) + 3
    known, base = regress.multinomial(plate, SPLITS, weights, made=made)
    labels, _, _ = dense()
    names = sorted(OUTCOMES)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(regress, "DRIVER_COEFFICIENTS", 0)
    monkeypatch.setattr(regress, "LogisticRegression", learner)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        effects, intercepts = regress.multinomial(plate, SPLITS, weights, made=made)
        gap = regress.multinomial_gap(plate, effects, intercepts, SPLITS, weights, made=made).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert matrix(effects, labels, names) == pytest.approx(matrix(known, labels, names), abs=1e-3)
    base = {r.event: r.b for r in base.collect()}
    found = {r.event: r.b for r in intercepts.collect()}
    # scores are known up to one number for all classes
    shift = sum(found.values()) - sum(base.values())
    assert found == pytest.approx({e: b + shift / len(base) for e, b in base.items()}, abs=1e-3)
    counts = {label: 0 for label in labels}
    for _, batter, pitcher, event in rows:
        for label in [("batter", batter), ("pitcher", pitcher)]:
            if event and label[1]:
                counts[label] += 1
    assert {(r.split, r.level): r.n for r in gap} == counts
    assert max(abs(r[e]) for r in gap for e in names) < 1e-3
    if not weighted:
        shares = regress.fitted_shares(plate, effects, intercepts, SPLITS, made=made)
        seen = {e: sum(r[3] == e for r in rows) / (len(ROWS) + 3) for e in names}
        assert {r.event: r.share for r in shares.collect()} == pytest.approx(seen, abs=1e-6)


FIVE = ["batter", "pitcher", "gamesite", "timesthrough", "pitbathand"]


def five_splits(spark):
    """Events of five splits, some levels missing, one pitcher and no pitcher at all with many."""
    rng = np.random.default_rng(11)
    names = [*OUTCOMES, "UNKNOWN"]
    rows = []
    for i in range(3000):
        pitcher = "p0" if i % 4 == 0 else None if i % 7 == 0 else f"p{rng.integers(60)}"
        row = [f"b{rng.integers(4)}", pitcher, f"s{rng.integers(3)}", str(rng.integers(3)), ["LL", "RL", None][rng.integers(3)]]
        if i % 31 == 0:
            row[int(rng.integers(3)) * 2] = None
        rows.append((*row, names[int(rng.choice(7, p=np.arange(1, 8) / 28))] if i % 50 else None))
    rows += [rows[5]] * 40 + [(*[None] * 5, "K"), ("b9", "once", "s0", "0", "LL", "HR")]
    return spark.createDataFrame(rows, ", ".join(f"{s} string" for s in FIVE) + ", event string").cache(), rows


@pytest.mark.parametrize("weighted", [False, True])
def test_multinomial_of_blocks(spark, monkeypatch, weighted):
    def learner(**_):
        raise AssertionError("coefficients went through the driver")

    plate, rows = five_splits(spark)
    made = design.equal_events(plate, FIVE)
    weights = design.class_weights(plate, made=made) if weighted else None
    if weighted:
        assert sorted(weights.collect()) == sorted(design.class_weights(plate).collect())
    assert regress.in_blocks(made, FIVE) is None
    known, known_base = regress.multinomial(plate, FIVE, weights, made=made)
    monkeypatch.setattr(regress, "DRIVER_COEFFICIENTS", 0)
    monkeypatch.setattr(regress, "LogisticRegression", learner)
    monkeypatch.setattr(blocks, "SLICE", 50)
    packed = regress.in_blocks(made, FIVE)
    assert packed.large == "pitcher"
    effects, base = regress.multinomial(plate, FIVE, weights, made=made, packed=packed)
    kept = [r for r in rows if r[5]]
    labels = sorted({(s, r[i]) for i, s in enumerate(FIVE) for r in kept if r[i]})
    names = sorted({r[5] for r in kept})
    b = matrix(effects, labels, names)
    assert b == pytest.approx(matrix(known, labels, names), abs=5e-3)
    base = {r.event: r.b for r in base.collect()}
    assert base == pytest.approx({r.event: r.b for r in known_base.collect()}, abs=5e-3)
    # the slope, against a dense design
    x = np.array([[float(r[FIVE.index(s)] == level) for s, level in labels] for r in kept])
    w = {r.event: r.w for r in weights.collect()} if weighted else dict.fromkeys(names, 1.0)
    score = np.exp(x @ b + np.array([base[e] for e in names]))
    y = np.array([[float(r[5] == e) for e in names] for r in kept])
    rest = np.array([w[r[5]] for r in kept])[:, None] * (y - score / score.sum(axis=1, keepdims=True))
    assert x.T @ rest - b == pytest.approx(np.zeros_like(b), abs=1e-4)
    assert rest.sum(axis=0) == pytest.approx(np.zeros(len(names)), abs=1e-4)
    # the gap of worse effects is the same either way
    rough = effects.withColumn("K", F.col("K") + F.length("level"))
    base = spark.createDataFrame([(e, 1.5 * v) for e, v in base.items()], "event string, b double")
    found = regress.multinomial_gap(plate, rough, base, FIVE, weights, made=made, packed=packed)
    expected = regress.multinomial_gap(plate, rough, base, FIVE, weights, made=made)
    assert matrix(found, labels, ["n", *names]) == pytest.approx(matrix(expected, labels, ["n", *names]), abs=1e-6)


def test_blocks_are_for_one_large_split(spark, monkeypatch):
    plate, _ = five_splits(spark)
    made = design.equal_events(plate, FIVE)
    for name in ("DENSE", "COMBINATIONS"):
        with monkeypatch.context() as m:
            m.setattr(blocks, name, 20)
            assert blocks.packed(made, FIVE, 0) is None
    assert blocks.packed(made.filter("false"), FIVE, 0) is None
    packed = blocks.packed(made, FIVE, 0)
    assert packed.totals.sum() == made.agg(F.sum("n")).first()[0]
    assert packed.rows.count() == made.select("pitcher").distinct().count()


def test_a_levels_effects_where_a_whole_step_overshoots(spark):
    # a level with one class only, far from the others' shares
    rows = [(f"b{i % 2}", "p0" if i < 900 else f"p{i % 5}", "s", "0", "L", "K" if i < 900 else ["HR", "BB", "K"][i % 3]) for i in range(1000)]
    plate = spark.createDataFrame(rows, ", ".join(f"{s} string" for s in FIVE) + ", event string")
    made = design.equal_events(plate, FIVE)
    packed = blocks.packed(made, FIVE, 0)
    effects, base = blocks.fit(packed, c=100.0)
    gap = blocks.residuals(packed, effects, base).join(effects.select("split", "level", *[F.col(e).alias(f"b_{e}") for e in ("BB", "HR", "K")]), ["split", "level"])
    worst = max(abs(r[e] - r[f"b_{e}"] / 100) for r in gap.collect() for e in ("BB", "HR", "K"))
    assert worst < 1e-3


def test_inner_products(spark):
    rng = np.random.default_rng(3)
    cells = rng.normal(size=(50, 4, 3))
    table = spark.createDataFrame([(row.tolist(),) for row in cells], "v array<array<double>>")
    flat = cells.transpose(1, 0, 2).reshape(4, -1)
    assert solvers.inner_products(table, "v") == pytest.approx(flat @ flat.T)
    assert solvers.inner_products(table.filter("false"), "v").shape == (0, 0)


def test_class_weights(events):
    made = {r.event: r for r in design.class_weights(events, "balanced").collect()}
    n = {e: sum(r[3] == e for r in ROWS) for e in OUTCOMES}
    for e in OUTCOMES:
        assert made[e].w == pytest.approx(len(ROWS) / (6 * n[e]))
    with pytest.raises(ValueError):
        design.class_weights(events, "none")


def test_estimates(events):
    counts = design.level_counts(events, SPLITS)
    means = design.means_of_counts(counts)
    effects = regress.ridge(events, 1.0, SPLITS)
    made = estimates.with_total(estimates.to_probabilities(effects, means))
    # the outcomes' residuals sum to zero, so estimates sum to one
    assert {round(r.SUM, 8) for r in made.collect()} == {1.0}
    logit = estimates.to_probabilities(regress.min_norm(events, SPLITS, "logit"), means, "logit")
    total = estimates.with_total(estimates.normalise(estimates.with_total(logit)))
    assert {round(r.SUM, 9) for r in total.collect()} == {1.0}


def test_mean_fitted_is_mean_observed(events):
    effects = regress.min_norm(events, SPLITS)
    fit = estimates.fitted(events, effects, SPLITS)
    row = fit.agg(*[F.avg(e).alias(e) for e in OUTCOMES]).first()
    assert list(row) == pytest.approx([0.0] * 6, abs=1e-9)


def test_comparison(events):
    observed = rates.split_rates(events, SPLITS)
    effects = regress.ridge(events, 1.0, SPLITS)
    made = estimates.to_probabilities(effects, design.event_means(events))
    both = estimates.observed_and_estimated(observed, made)
    assert both.count() == 10
    assert both.agg(F.corr("SNGL_obs", "SNGL_est")).first()[0] > 0.5
    assert estimates.long_comparison(observed, made).count() == 60
    ratio = spread.shrinkage(made, events, SPLITS).collect()
    assert all(0 < r.ratio < 1.5 for r in ratio)


def test_missing_level_has_no_column(spark):
    rows = [(0, "b0", None, "K"), (1, "b0", "p0", "HR"), (2, None, "p0", "K"), (3, "b1", "p1", None)]
    events = plate_frame(spark, rows)
    found = {(r.split, r.level): r.n for r in design.xty(events, SPLITS).collect()}
    assert found == {("batter", "b0"): 2, ("batter", "b1"): 1, ("pitcher", "p0"): 2, ("pitcher", "p1"): 1}
    _, labels = design.vector_design(events, SPLITS, ["event"])
    assert labels == [("batter", "b0"), ("batter", "b1"), ("pitcher", "p0"), ("pitcher", "p1")]
    vectors, _ = design.vector_design(events, SPLITS, ["event"])
    assert sorted(tuple(r.features.toArray()) for r in vectors.collect()) == [
        (0, 0, 1, 0), (0, 1, 0, 1), (1, 0, 0, 0), (1, 0, 1, 0),
    ]


def test_system_without_a_solution_raises(spark):
    cells = [(s, "1", t, "1", 4) for s in "ab" for t in "ab"]
    gram = spark.createDataFrame(cells, "split string, level string, split2 string, level2 string, n long")
    rhs = spark.createDataFrame([("a", "1", 1.0), ("b", "1", -1.0)], "split string, level string, y double")
    with pytest.raises(solvers.NotConverged):
        solvers.conjugate_gradient(gram, rhs, ["y"]).collect()


def test_rows_with_a_missing_key_have_no_number(spark):
    rows = [("g", i, None if i % 3 == 0 else "k") for i in range(30)]
    table = spark.createDataFrame(rows, "game string, at long, key string")
    found = {r.at: r.n for r in ranking.ordinal_in_group(table, ["game", "key"], ["at"], "n").collect()}
    kept = [i for i in range(30) if i % 3]
    assert found == {i: kept.index(i) if i in kept else None for i in range(30)}


@pytest.mark.parametrize("query", [catalog.fitted_values, catalog.star_rates])
def test_events_are_derived_once(spark, tmp_path, query):
    lines = [(o, n, o % 3, o % 4, float(n), "AR"[o % 2], "F", 0.0, 0.0, f"1996-0{1 + o % 6}-01") for o in range(40) for n in (1, 3, 6)]
    lines += [lines[0], (None, 1, 1, 1, 5.0, "A", "F", 0.0, 0.0, "1996-01-01")]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string"
    made = spark.createDataFrame(lines, names + ", l_tax double, l_discount double, l_shipdate string")
    made.withColumn("l_shipdate", F.to_date("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = spark.createDataFrame([(i, f"B{i}", i) for i in range(3)], "p_partkey long, p_brand string, p_size int")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    found = query(spark, str(tmp_path))
    assert not [f for f in found.inputFiles() if "lineitem" in f]
    assert found.count() == catalog.kept(spark, str(tmp_path)).count() > 40
