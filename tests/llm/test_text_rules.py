import re
from collections import Counter

import duckdb
import pandas as pd

from lodegrid.llm import license_scan, quality_rules, sql
from tests.llm.conftest import SF


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i in range(len(words) - 2) for k in range(3) if windows[words[i], words[i + 1], words[i + 2]] > 1}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_base_statistics(spark, edge_docs):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + [r.text for r in edge_docs.collect()]
    for t in texts:
        assert quality_rules.base_statistics(t)[:5] == brute_base(t)


def test_verdicts(spark, edge_docs, no_docs):
    got = quality_rules.quality_verdicts(edge_docs).collect()
    assert len(got) == 13 and all(r.base_failed and not r.kept for r in got)
    assert quality_rules.quality_verdicts(no_docs).count() == 0
    assert quality_rules.keep_good(no_docs).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.quality_verdicts(docs).collect() if r.kept}
    filtered = quality_rules.keep_good(docs)
    assert filtered.columns == docs.columns and {r.doc_id for r in filtered.collect()} == kept


def test_keep_good_on_odd_rows(spark, edge_docs):
    assert quality_rules.keep_good(edge_docs).count() == 0
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, None, None, 5, "a"), (1, text, None, None, 5, "a"), (None, text, "en", "s", None, None), (2, None, "en", "s", 1, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _n_words long, fence_symbols string")
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.where("text is not null").collect())


def test_fences_move_smoothly_with_the_number_of_documents(spark):
    """A source of its own style: its fence leaves the language's step by step, not at once."""
    def fence(n):
        cells = [("en", "wide", m, 0, 1000) for m in quality_rules.SLACK] + [("en", "own", "symbols", 400, n)] + [("en", "own", m, 0, n) for m in ("lines", "repeats", "length")]
        rows = quality_rules.fences(spark.createDataFrame(cells, "lang string, source string, measure string, cell long, n long")).collect()
        return next(r.fence_symbols for r in rows if r.source == "own")

    got = [fence(n) for n in (1, 49, 50, 51, 5000)]
    assert got == sorted(got) and got[3] - got[1] < 10 and got[4] > 440 and got[0] < 70


def test_thresholds_follow_the_source(spark):
    plain = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    text = lambda i, mark: " ".join(f"{w}{i}{j}{mark if j % 3 == 0 else ''}" for j in range(8) for w in plain.split())
    rows = [(i, text(i, "#"), "en", "forum") for i in range(80)] + [(1000 + i, text(i, ""), "en", "news") for i in range(80)] + [(5000, text(1, "#####"), "en", "news")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.quality_verdicts(docs).collect() if r.kept}
    assert kept == {*range(80), *range(1000, 1080)}, "a source of uniform texts keeps them, an outlier goes"


def test_sketch_cells(spark):
    from pyspark.sql import functions as F

    got = spark.range(2000).select("id", quality_rules.cell(F.col("id")).alias("c")).collect()
    assert all(r.c <= r.id < r.c + max(1, r.c / 15) for r in got)


def brute_places(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_license_places(spark, edge_docs, no_docs):
    extra = ["CC-BY cc by, CC; By all rights. Reserved", "General public LICENSE general public license", "by cc by", "licensed under CC BY-NC 4.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as printed by the Free Software Foundation"]
    rows = [(100 + i, t) for i, t in enumerate(extra)] + [(1, "cc by"), (1, "cc by"), (1, "no")]
    docs = edge_docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    results, spans = license_scan.license_scan(docs)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in results.collect())
    key = lambda t: tuple((x is None, x) for x in t[1:])
    want = [((r.doc_id is None, r.doc_id or 0), *brute_places(r.text)) for r in docs.collect()]
    assert sorted(got, key=lambda t: (t[0], key(t))) == sorted(want, key=lambda t: (t[0], key(t)))
    labels = {r.doc_id: (r.labels, r.score) for r in results.collect()}
    assert labels[103][0] == "cc-by,cc-by-nc" and labels[104] == ("gpl", 1.0) and labels[4] == ("", 0.0)
    assert {s.doc_id for s in spans.collect()} == {103, 104}
    assert license_scan.license_scan(no_docs)[0].count() == 0


def test_license_name_after_its_notice(spark):
    texts = [
        ("mit", "Released under the MIT License. See the MIT License for details.", [(0, 5)]),
        ("mit", "Released under the MIT License. The MIT License permits much.", [(0, 5)]),
        ("cc0", "x CC0 1.0 Universal Public Domain Dedication. This Public Domain Dedication", [(1, 8)]),
        ("mit", "See the MIT License. Released under the MIT License", [(4, 9)]),
        ("mit", "Released under the MIT License. x the MIT License x Released under the MIT License", [(0, 5), (10, 15)]),
        ("", "under the MIT License, the MIT License, under the MIT License", []),
    ]
    docs = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(texts)], "doc_id long, text string")
    results, spans = license_scan.license_scan(docs)
    got = {r.doc_id: (r.labels, r.score) for r in results.collect()}
    assert got == {i: (label, 1.0 if label else 0.0) for i, (label, _, _) in enumerate(texts)}
    found = sorted((s.doc_id, s.start, s.end) for s in spans.collect())
    assert found == [(i, a, b) for i, (_, _, where) in enumerate(texts) for a, b in where]


def test_sql_of_stuttered_and_interrupted_notices(spark):
    texts = [
        "licensed under the licensed under the mit license",
        "Released under the MIT License. See the MIT License for details.",
        "Released under, well, the MIT License; released under the MIT License. Released under the MIT License the MIT License",
        "CC0 1.0 Universal Public Domain Dedication. This Public Domain Dedication of CC0 1.0 Universal Public Domain Dedication",
        "under the MIT License, the MIT License, under the MIT License",
        "licensed under CC BY-NC 4.0 licensed under CC BY NC licensed under cc by sa 4 0",
        "this is free and unencumbered free and unencumbered software software released into the public domain",
        None,
        "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in license_scan.license_scan(docs)[0].collect())
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    columns = "doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score"
    assert got == sorted(con.execute(f"SELECT {columns} FROM ({sql.license_scan()})").fetchall())
    labels = {g[0]: g[6] for g in got}
    assert [labels[i] for i in range(9)] == ["mit", "mit", "mit", "cc0", "", "cc-by,cc-by-nc,cc-by-sa", "unlicense", "", ""]
