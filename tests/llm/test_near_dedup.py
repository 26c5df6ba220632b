import itertools
import random

import pytest

from lodegrid.llm import near_dedup
from lodegrid.llm.common import components, written


def shingles(text, width):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return frozenset(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()


def brute(rows, width, top, bottom):
    """(id, shingles, component) of each row, by all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and bottom * len(a & b) >= top * len(a | b):
            up[root(i)] = root(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        r = root(i)
        low[r] = min(low.get(r, k), k)
    return sorted((k, len(sets[i]), low[root(i)]) for i, (k, _) in enumerate(rows))


def family(rng, words, copies, edits):
    base = [rng.choice(words) for _ in range(120)]
    for _ in range(copies):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(len(t))] = rng.choice(words)
        yield " ".join(t)


@pytest.mark.parametrize("tile", [512, 6])
def test_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    monkeypatch.setattr(near_dedup, "WIDE", 4 * tile)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    texts = [*family(rng, words, 60, 14), *family(rng, words, 20, 30), *(" ".join(rng.choice(words) for _ in range(80)) for _ in range(30))]
    texts += [texts[0]] * 5 + ["", "one", "one", "one two", "ONE  two"]
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dedup.near_duplicates(docs, width=3, threshold=(85, 100)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 85, 100)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edges(spark, edge_docs, no_docs):
    got = near_dedup.near_duplicates(edge_docs, width=3).collect()
    assert len(got) == 13
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].n_shingles == by_id[1].n_shingles == by_id[2].n_shingles == 0 and by_id[1].kept
    assert by_id[None].kept and by_id[None].component_id is None
    assert by_id[8].component_id == 7 and not by_id[8].kept
    assert near_dedup.near_duplicates(no_docs).count() == 0
    kept = near_dedup.deduplicate(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == [0, 1, 2, 4, 5, 6, 7, 9, 10]
    assert near_dedup.deduplicate(no_docs).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_one_id_with_several_texts(spark, parts):
    rng = random.Random(4)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(100)]
    a, b = text(), text()
    near = lambda t: " ".join([*t[:-2], "x", "y"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (1, " ".join(a)), (7, "other words"), (7, near(b))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, width=3, threshold=(85, 100)).collect())
    assert got == sorted([*[(1, 98, 1)] * 3, (2, 98, 1), (3, 98, 1), (7, 1, 7), (7, 98, 1)])


def test_large_group_shrinks_round_by_round(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 8)
    monkeypatch.setattr(near_dedup, "WIDE", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:-3], *(f"v{rng.randrange(10**6)}" for _ in range(3))])) for i in range(300)]
    rows += [(1000 + i, " ".join([*base[: 200 - 4 * i], *(f"u{i}.{k}" for k in range(4 * i))])) for i in range(14)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, threshold=(85, 100)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 85, 100)


def test_prune_bounds():
    for n, least in near_dedup.least_matches(0.85, 1e-7):
        assert 0 < least < 0.85 * n


@pytest.mark.parametrize("rows", [10**6, 200])
def test_components(spark, rows):
    rng = random.Random(2)
    edges = [(rng.randint(0, 900), rng.randint(1000, 1900)) for _ in range(500)] + [(i, i + 1) for i in range(3000, 3300)]
    rng.shuffle(edges)
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    table = written(spark.createDataFrame(edges, "a long, b long").repartition(5), "test_edges")
    assert {r.id: r.component for r in components(table, rows).collect()} == {x: root(x) for x in up}
