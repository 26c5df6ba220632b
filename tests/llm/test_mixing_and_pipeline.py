import hashlib
import math

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodegrid.llm import bpe, mixing, sql, toxicity
from tests.llm.conftest import SF
from tests.llm.test_near_dedup import brute


def brute_tokens(text):
    return len((text or "").encode().split())


def plain_exponent(tokens, repeats=2.0):
    """By plain halving over all sources."""
    def most(a):
        w = mixing.tempered(tokens, a)
        rate = [w[s] * sum(tokens.values()) / n for s, n in tokens.items()]
        return max(rate) / min(rate)

    low, high = 0.0, 1.0
    if most(0.0) <= repeats:
        return 0.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if most(middle) <= repeats else (middle, high)
    return high


def test_exponent(spark):
    tokens = {"a": 1000, "b": 100, "c": 10}
    table = lambda t: spark.createDataFrame(list(t.items()), "source string, n long")
    a = mixing.exponent(table(tokens), repeats=3.0)
    assert 0 < a < 1 and math.isclose(a, plain_exponent(tokens, 3.0), rel_tol=1e-9)
    h = mixing.exponent(table(tokens), target_entropy=0.8)
    assert math.isclose(mixing.entropy(list(mixing.tempered(tokens, h).values())), 0.8, rel_tol=1e-6)
    assert mixing.exponent(table({"a": 5, "b": 5}), repeats=1.0) == 0.0
    assert mixing.exponent(table(tokens).limit(0)) == 1.0


def plain_mix(rows, hashes):
    """{(doc_id, pass)} of rows (doc_id, source, tokens), by plain loops: whole passes, then the documents of the
    next one in the order of their hashes until the tokens left are met."""
    own = {}
    for _, s, n in rows:
        own[s] = own.get(s, 0) + n
    real = {s: n for s, n in own.items() if n}
    weights = mixing.tempered(real, plain_exponent(real))
    total = max(n / weights[s] for s, n in real.items())
    taken = set()
    for s, n in own.items():
        full, left = divmod(round(total * weights[s]), n) if n else (1, 0)
        mine = [(k, m) for k, t, m in rows if t == s]
        taken |= {(k, i) for k, _ in mine for i in range(full)}
        for k, m in sorted(mine, key=lambda x: hashes[x[0], full]):
            if left <= 0:
                break
            taken.add((k, full))
            left -= m
    return taken


def test_selected_passes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.source, brute_tokens(r.text)) for r in docs.collect()]
    key = F.xxhash64(F.lit(17), F.col("doc_id").cast("string"), F.col("text"))
    hashes = {(r.doc_id, i): r[f"h{i}"] for r in docs.select("doc_id", *(F.xxhash64(key, F.lit(i)).bitwiseAND(F.lit((1 << 63) - 1)).alias(f"h{i}") for i in range(4))).collect() for i in range(4)}
    got = mixing.mix(docs).collect()
    assert {(r.doc_id, r.mix_pass) for r in got} == plain_mix(rows, hashes) and len(got) == len({(r.doc_id, r.mix_pass) for r in got})
    assert all(r.mix_tokens == brute_tokens(r.text) and 0 <= r.mix_place <= 1 for r in got)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.mix_pass, r.mix_place) for r in got) == sorted((r.doc_id, r.mix_pass, r.mix_place) for r in again)
    places = [r.mix_place for r in mixing.in_order(mixing.mix(docs)).collect()]
    assert places == sorted(places)


def test_budget(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "s") for i in range(500)], "doc_id long, text string, source string")
    assert abs(mixing.mix(docs, budget=1234).count() - 124) <= 1
    assert abs(mixing.mix(docs, budget=12_340).count() - 1234) <= 1


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", i, "x") for i in range(5)], "doc_id long, text string, source string, mix_place long, _mix_of string")
    got = mixing.mix(docs)
    assert got.columns == ["doc_id", "text", "source", "_mix_of", *mixing.ADDED] and got.count() == 5
    with pytest.raises(ValueError):
        mixing.mix(docs, source_col="mix_place")


def test_edges(edge_docs, no_docs):
    got = mixing.mix(edge_docs)
    assert got.columns[: len(edge_docs.columns)] == edge_docs.columns
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in edge_docs.collect()}
    assert mixing.mix(no_docs).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        rows = out.collect()
        assert rows and {r.doc_id for r in rows} <= ids, name
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns, name
            now = spark.createDataFrame(rows, docs.schema)
            ids = {r.doc_id for r in rows}
    assert corpus_pipeline.run(spark, SF).count() == len(rows)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_against_plain_python(spark):
    """The rows of run() by SQL, all pairs, plain loops and the library."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({sql.QUALITY_RULES}) WHERE kept").fetchall()}
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.doc_id in good]
    model = toxicity.train(spark, SF)
    docs = [r for r, s in zip(docs, model.score([r.text for r in docs]), strict=True) if s < 0.5]
    first = {k for k, _, c in brute([(r.doc_id, r.text) for r in docs], 5, 80, 100) if k == c}
    docs = [r for r in docs if r.doc_id in first]
    own: dict[str, int] = {}
    for r in docs:
        own[r.source] = own.get(r.source, 0) + brute_tokens(r.text)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == first
    weights = mixing.tempered(own, plain_exponent(own))
    total, longest = max(own[s] / w for s, w in weights.items()), max(brute_tokens(r.text) for r in docs)
    text = {r.doc_id: r.text for r in docs}
    for s, w in weights.items():
        mixed = sum(brute_tokens(text[r.doc_id]) for r in got if r.source == s)
        assert abs(mixed - total * w) <= longest + 1
    library = Tokenizer.from_file(bpe.word_bpe())
    for r in got:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
