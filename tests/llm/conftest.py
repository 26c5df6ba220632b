from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"

#: Texts that every operator must take: nothing, spaces, one word, odd characters, repeats, a very long one.
EDGES = [None, "", " \n\t ", "word", "a b", "x\x00y     z", "日本語 текст ünï İ 👍🏽", "same words here again", "same words here again", "Don't STOP! <|endoftext|> 12½", "long " * 60_000]


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i if i != 3 else None, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", i, "clash") for i, t in enumerate(EDGES)]
    rows += [rows[7], rows[8]]  # repeated rows
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, kept string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
