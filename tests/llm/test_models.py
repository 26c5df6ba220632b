import numpy as np
import pytest

from lodegrid.llm import learners, quality_classifier, toxicity
from lodegrid.llm.common import crc32_of_id

SF, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def auc(score, y):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(len(score))
    return (rank[y == 1].mean() - rank[y == 0].mean()) / len(score) + 0.5


def held_out(spark, query, label):
    """Scores and labels of the held-out rows, at a size where either label has dozens of them."""
    rows = query(spark, LARGE).join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id").where("held_out").collect()
    return np.array([r.score for r in rows]), np.array([r[label] for r in rows])


def precision_recall(score, y):
    said = score >= 0.5
    return (y[said] == 1).mean(), said[y == 1].mean()


def test_quality_held_out(spark):
    s, y = held_out(spark, quality_classifier.query, "quality")
    precision, recall = precision_recall(s, y)
    assert min((y == 0).sum(), (y == 1).sum()) > 100 and auc(s, y) > 0.99 and precision > 0.97 and recall > 0.95


def test_toxicity_held_out(spark):
    s, y = held_out(spark, toxicity.query, "toxic")
    precision, recall = precision_recall(s, y)
    assert (y == 1).sum() > 60 and auc(s, y) > 0.97 and precision > 0.95 and recall > 0.85


def test_null_ids_have_a_side(spark):
    for query_side, null in ((crc32_of_id() % 3 == 1, False), (crc32_of_id() % 5 == 0, True)):
        rows = spark.createDataFrame([(None,), (7,)], "doc_id long").select("doc_id", query_side.alias("held")).collect()
        assert rows[0].held is null and rows[1].held is not None


@pytest.mark.parametrize(("ids", "label_ids", "label"), [("int", "long", "int"), ("int", "int", "long"), ("decimal(20,0)", "decimal(20,0)", "int"), ("string", "string", "int"), ("long", "long", "boolean"), ("long", "long", "double")])
def test_toxicity_takes_ids_and_labels_of_other_types(spark, ids, label_ids, label):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    other = docs.withColumn("doc_id", docs.doc_id.cast(ids))
    model = toxicity.fit(other, labels.withColumns({"doc_id": labels.doc_id.cast(label_ids), "toxic": labels.toxic.cast(label)}), crc32_of_id() % 5 != 0)
    kept = toxicity.keep_clean(other, model)
    assert kept.schema == other.schema
    want = toxicity.keep_clean(docs, toxicity.train(spark, "/root/testdata/sf0.001"))
    assert model.trees is not None and sorted(int(r.doc_id) for r in kept.collect()) == sorted(r.doc_id for r in want.collect())


def test_edges(spark, edge_docs, no_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tox = toxicity.fit(docs, labels, crc32_of_id() % 5 != 0)
    good = quality_classifier.fit(docs, labels, crc32_of_id() % 3 != 1)
    for score, model in ((toxicity.score, tox), (quality_classifier.score, good)):
        got = score(edge_docs, model, out_col="kept")
        assert sorted(got.columns) == sorted(edge_docs.columns)
        assert all(0 <= r.kept <= 1 for r in got.collect()) and got.count() == 13
        assert score(no_docs, model).count() == 0
    none = labels.limit(0)
    assert {r.score for r in toxicity.score(edge_docs, toxicity.fit(docs, none, crc32_of_id() >= 0)).collect()} == {0.0}
    assert {r.score for r in quality_classifier.score(edge_docs, quality_classifier.fit(docs, none, crc32_of_id() >= 0)).collect()} == {0.5}
    assert toxicity.keep_clean(edge_docs, tox).columns == edge_docs.columns


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees, iso = learners.calibrated_trees(x, y)
    p = iso.apply(trees.margin(x))
    assert auc(p, y) > 0.97 and abs(p.mean() - y.mean()) < 0.05
    m = np.linspace(-5, 5, 50)
    assert (np.diff(iso.apply(m)) >= 0).all()


def test_prior_and_positives():
    rng = np.random.default_rng(1)
    pos, neg = rng.normal(1.5, 1, (1500, 3)), rng.normal(-1.5, 1, (1500, 3))
    unlabelled = np.concatenate([pos[:700], neg[:300]])
    prior = learners.class_prior(pos[700:], unlabelled)
    assert 0.6 < prior < 0.82
    net = learners.Positives().fit(pos[700:], unlabelled, prior)
    assert (net.margin(pos) > 0).mean() > 0.9 and (net.margin(neg) > 0).mean() < 0.1


def test_capitals_are_a_share_of_letters_at_any_length():
    lexicon = toxicity.Lexicon({}, 1, 1)
    assert [toxicity.features("ABC def 12 -- " * n, lexicon)[15] for n in (5, 500)] == [0.5, 0.5]
