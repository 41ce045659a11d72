import numpy as np
import pytest

from quernel.llm import features, quality, toxicity
from quernel.llm.common import held_out
from quernel.llm.queries import op4_quality, op5_toxicity

BIG = "/root/testdata/sf0.01"


def accuracy(rows, labels):
    known = [(r, labels[r.doc_id]) for r in rows if r.doc_id in labels and r.held_out]
    return sum(r.predicted == y for r, y in known) / len(known), known


def test_quality_on_labels_it_has_not_seen(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = op4_quality(spark, BIG).collect()
    assert len(rows) == spark.read.parquet(f"{BIG}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == held_out(r.doc_id) for r in rows)
    right, known = accuracy(rows, labels)
    assert right >= 0.93
    assert sum(r.predicted for r, y in known if y) / sum(y for _, y in known) >= 0.95


def test_toxicity_on_labels_it_has_not_seen(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = op5_toxicity(spark, BIG).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == held_out(r.doc_id) for r in rows)
    assert accuracy(rows, labels)[0] >= 0.93


@pytest.mark.parametrize("module", [quality, toxicity])
def test_defined_cases(spark, module):
    texts = [None, "", " ", "fine words here and there " * 4, "fine words here and there " * 4, "BAD!! ### $$$ idiot " * 5, "x" * 300_000, "é日本 \0 ퟿"]
    df = spark.createDataFrame([(k, t, 0.5, 1, "x") for k, t in enumerate(texts)] + [(None, "no id", 0.1, 0, "y")], "doc_id long, text string, score double, y long, x string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(8)] + [(0, None, None), (None, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        rows = module.score(df, known).collect()
        assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
        same = {r.doc_id: r.score for r in rows}
        assert same[3] == same[4]
    assert module.keep(df, labels).columns == df.columns
    assert module.score(df.limit(0), labels).count() == 0


@pytest.mark.parametrize(("module", "target", "kept"), [(quality, "quality", 1), (toxicity, "toxic", 0)])
def test_rows_of_one_id_are_kept_or_dropped_by_their_own_text(spark, module, target, kept):
    fine = [f"The {w} walks along the quiet river and looks at number {k} of the boats." for k in range(150) for w in ("man", "dog")]
    bad = [f"BAD!! ### $$$ idiot idiot {k} !!! idiot" for k in range(300)]
    rows = [(k, t) for k, t in enumerate(x for pair in zip(fine, bad, strict=True) for x in pair)]
    labels = spark.createDataFrame([(k, int(k % 2 == (0 if target == "quality" else 1))) for k, _ in rows], f"doc_id long, {target} int")
    mixed = [(i, t) for i in (None, 5000) for t in (fine[0], bad[0], bad[1], fine[1])]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows + mixed)], "doc_id long, text string, n long").repartition(3)
    got = module.keep(df, labels)
    assert got.schema == df.schema
    texts = [r.text for r in got.where("n >= 600").collect()]
    assert sorted(texts) == sorted([fine[0], fine[1]] * 2)
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in module.score(df, labels).where(f"predicted = {kept}").collect()}


@pytest.mark.parametrize(("module", "target"), [(quality, "quality"), (toxicity, "toxic")])
def test_labels_of_other_documents_neither_fill_the_sample_nor_count(spark, module, target):
    rows = [(k, f"The man walks along the quiet river to boat {k} of many." if k % 2 else f"BAD!! ### $$$ idiot idiot {k} !!! idiot") for k in range(600)]
    known = [(k, k % 2 if target == "quality" else 1 - k % 2) for k, _ in rows] + [(k, 1) for k in range(1000, 61_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(known, f"doc_id long, {target} int")
    for most in (700, features.MAX_LABELLED):
        got = {r.doc_id: r.predicted for r in module.score(df, labels, most=most).collect()}
        assert all(got[k] == y for k, y in known if k < 1000)
        assert module.keep(df, labels, most=most).count() == 300


@pytest.mark.parametrize(("module", "target"), [(quality, "quality"), (toxicity, "toxic")])
def test_repeated_and_shared_ids_in_the_sample(spark, module, target):
    good = "The man walks along the quiet river to boat {} of many."
    bad = "BAD!! ### $$$ idiot idiot {} !!! idiot"
    rows = [(k, (good if k % 2 else bad).format(k)) for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2 if target == "quality" else 1 - k % 2) for k, _ in rows], f"doc_id long, {target} int")
    # Id 1 is repeated, and id 3 is shared by texts of both kinds.
    df = spark.createDataFrame(rows + [rows[1]] * 300 + [(3, bad.format(3))], "doc_id long, text string")
    usable = {r.id for r in features.training_labels(df, labels, target).collect()}
    assert 1 in usable and 3 not in usable
    assert len(usable) == sum(not held_out(k) for k in range(400) if k != 3)
    assert module.keep(df, labels).count() == 500


def test_isotonic_is_the_best_rising_fit():
    random = np.random.default_rng(1)
    x = random.normal(size=200)
    y = (random.random(200) < 1 / (1 + np.exp(-2 * x))).astype(float)
    knots = features.isotonic(x, y)
    assert np.all(np.diff(knots[0]) > 0) and np.all(np.diff(knots[1]) > 0)
    order = np.argsort(x)
    ys = y[order]
    # The classic min-max formula gives the same step values.
    brute = [max(min(ys[a : b + 1].mean() for b in range(k, 200)) for a in range(k + 1)) for k in range(200)]
    assert sorted(set(np.round(brute, 9))) == sorted(np.round(knots[1], 9))
    scores = features.calibrated(np.sort(x), knots)
    assert np.all(np.diff(scores) >= 0) and scores.min() >= 0 and scores.max() <= 1


def test_fourier_features_approximate_the_kernel():
    random = np.random.default_rng(2)
    x = random.normal(size=(40, 6))
    waves = random.normal(size=(6, 4000)) / np.sqrt(6)
    z = np.sqrt(2 / 4000) * np.cos(x @ waves + random.uniform(0, 2 * np.pi, 4000))
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 12)
    assert np.abs(z @ z.T - exact).max() < 0.12


def test_statistics_are_finite():
    for t in ["", "\n", " ", "a", "\ud800", "🙂" * 10, "A.b|c!?"]:
        assert np.isfinite(features.statistics(t)).all() and len(features.statistics(t)) == len(features.STATISTICS)


def test_a_tree_splits_where_it_should():
    x = np.stack([np.linspace(0, 1, 200), np.zeros(200)], axis=1)
    y = (x[:, 0] > 0.5).astype(float)
    model = toxicity.fit(x, y, np.arange(200) % 4 == 0)
    assert ((features.calibrated(model.raw(x), model.knots) >= 0.5) == (y == 1)).mean() > 0.98


def test_weights_equal_a_direct_solve(spark):
    random = np.random.default_rng(3)
    x = random.normal(size=(300, 4))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    rows = spark.createDataFrame([(k, v.tolist(), float(t)) for k, (v, t) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y double")
    model = quality.fit(rows, fourier=16)
    flags = {r.id: r.c for r in rows.selectExpr("id", f"pmod(xxhash64(id, 'calibrate'), {quality.CALIBRATE_EACH}) = 0 AS c").collect()}
    use = np.array([not flags[k] for k in range(300)])
    assert np.allclose(model.mean, x[use].mean(axis=0)) and np.allclose(model.scale, x[use].std(axis=0) + 1e-6)
    z = model.fourier(x[use])
    penalty = quality.RIDGE * use.sum() * np.array([1.0] * 16 + [0.01] * 4 + [0.0]) + 1e-9
    # Ridge as least squares with a row for each penalty.
    direct = np.linalg.lstsq(np.vstack([z, np.diag(np.sqrt(penalty))]), np.concatenate([y[use], np.zeros(21)]), rcond=None)[0]
    assert np.allclose(model.weights, direct, atol=1e-6)


def test_the_first_split_is_the_best_of_all():
    random = np.random.default_rng(4)
    x = random.integers(0, 12, (400, 3)).astype(float)
    g = random.normal(size=400) + 2 * (x[:, 1] > 6)
    h = random.uniform(0.1, 0.25, 400)
    edges = [toxicity._edges(x[:, f]) for f in range(3)]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    tree = toxicity.grow(codes, edges, g, h)
    worth = lambda use: g[use].sum() ** 2 / (h[use].sum() + toxicity.SHRINK)
    every = [(worth(x[:, f] <= c) + worth(x[:, f] > c), f, c) for f in range(3) for c in edges[f] if min((x[:, f] <= c).sum(), (x[:, f] > c).sum()) >= toxicity.LEAF_ROWS]
    assert (int(tree.feature[0]), float(tree.cut[0])) == max(every)[1:]


def test_toxic_features_are_densities():
    lexicon = toxicity.Lexicon({0: {"idiot": 5.0}, 4: {"idio": 4.5}, 5: {}, 6: {}})
    once, often = (np.array(lexicon.vector("you idiot, 1d1ot i d i o t and so on. " * n)) for n in (1, 7))
    counted = [toxicity.NAMES.index(n) for n in ("hits_word", "hits_4", "odds_sum", "rate_hits", "masked_hits", "second_person", "near_second", "spelled")]
    assert np.all(once[counted] > 0) and np.allclose(once[counted], often[counted], rtol=0.2)
