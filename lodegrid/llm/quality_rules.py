"""Quality rules with adaptive thresholds.

Fixed rules (the base) come first. What passes them feeds quantile sketches of four measures for each
language and source: a sketch is a histogram over values rounded down to five significant bits, so it
has at most 16 cells for each power of two, is exact to merge (cells add up, in any order), and says a
quantile within 1/16 of its value. A fence stands well beyond the upper quartile,

    fence = q75 + reach * (q75 - q25) + slack,

so a source with unusual but uniform texts keeps them. A source's fence is its own weighed by its number
of documents, with the fence of its language (from the merged sketch) at the weight of ``PRIOR`` documents;
a language's is blended with that of all in the same way, so thresholds move smoothly from the language's
to the source's own as it grows. Documents beyond a fence are rejected by a join of their measures with the
fences of their language and source.

The measures are whole numbers, in thousandths of: symbols over word characters, repeated lines over
lines with a word, words in repeated windows over words, and word characters over words.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrid.llm.common import free_name, table, with_text, written

#: Quartile range multiplier, documents that the wider sketch counts for, and slack in thousandths for each measure.
REACH, PRIOR = 3, 50
SLACK = {"symbols": 50, "lines": 400, "repeats": 250, "length": 1500}
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def base_statistics(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated 3-word windows, lines
    with a word). Words are runs of anything but the ASCII white space."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    lines = [line for line in text.split("\n") if line.strip(" \t\n\r\x0b\x0c")]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, upto = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    white = sum(map(text.count, " \t\n\r\x0b\x0c"))
    return n, len(text) - white, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def with_statistics(df: DataFrame, text_col: str, names: list[str]) -> DataFrame:
    def run(texts: list[str | None]) -> list[pa.Array]:
        rows = [base_statistics(t) for t in texts]
        return [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(BASE))]

    return with_text(df, text_col, run, *(f"{n} long" for n in names))


def base_failed(n_words: F.Column, n_repeat_words: F.Column) -> F.Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def measures(c: dict[str, F.Column]) -> dict[str, F.Column]:
    """The four measures from base columns; a text without words has zeros."""
    ratio = lambda a, b: F.when(b > 0, F.call_function("div", 1000 * a, b)).otherwise(0)
    return {
        "symbols": ratio(c["n_symbols"], c["word_chars"]),
        "lines": ratio(c["n_dup_lines"], c["n_lines"]),
        "repeats": ratio(c["n_repeat_words"], c["n_words"]),
        "length": ratio(c["word_chars"], c["n_words"]),
    }


def cell(value: F.Column) -> F.Column:
    """The sketch cell of a whole number: its five leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, cell, n) from rows (lang, source, and the measures): cells are counted on
    the map side first, so a hot source costs as many rows as it has cells."""
    return (
        measured.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), cell(F.col(m)).alias("cell")) for m in SLACK))).alias("x"))
        .groupBy("lang", "source", "x.measure", "x.cell")
        .agg(F.count("*").alias("n"))
    )


def fences(cells: DataFrame) -> DataFrame:
    """(lang, source, and a fence for each measure) from a sketch."""
    levels = [("lang", "source"), ("lang",), ()]
    tables = []
    for keys in levels:
        merged = cells.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))
        # running counts by a self-join over cells of one key, whose number is bounded by the sketch
        rows = merged.groupBy(*keys, "measure").agg(F.sort_array(F.collect_list(F.struct("cell", "n"))).alias("cells"), F.sum("n").alias("total"))
        running = F.expr("transform(sequence(1, size(cells)), i -> struct(cells[i - 1].cell as cell, aggregate(slice(cells, 1, i), 0L, (s, x) -> s + x.n) as upto))")
        at = lambda q: F.expr(f"filter(running, x -> 4 * x.upto >= {q} * total)[0].cell")
        low, high = at(1), at(3)
        slack = F.create_map(*(F.lit(x) for m in SLACK.items() for x in m))[F.col("measure")]
        fence = rows.withColumn("running", running).select(*keys, "measure", "total", (high + REACH * (high - low) + slack).cast("long").alias("fence"))
        tables.append(fence.groupBy(*keys).agg(F.max("total").alias("total"), *(F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(m) for m in SLACK)))
    own, lang, every = tables
    rest = every.head()  # one row: the fences over all languages
    blend = lambda total, fence, wider: F.call_function("div", F.col(total) * F.col(fence) + PRIOR * wider, F.col(total) + PRIOR)
    lang = lang.select("lang", *(blend("total", m, F.lit(rest[m])).alias(f"l_{m}") for m in SLACK))
    return own.join(lang, "lang").select("lang", "source", *(blend("total", m, F.col(f"l_{m}")).alias(f"fence_{m}") for m in SLACK))


def judged(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """``stats`` (with lang, source, the measures and base_failed) and its verdict ``kept``.

    The fences come from a written table, so the planner sends them to all tasks if they are small and
    otherwise joins by (lang, source), where Spark splits a hot source.
    """
    beyond = F.lit(False)
    for m in SLACK:
        beyond = beyond | F.coalesce(F.col(m) > F.col(f"fence_{m}"), F.lit(False))
    return stats.join(limits, ["lang", "source"], "left").withColumn("kept", ~F.col("base_failed") & ~beyond)


def _measured(docs: DataFrame, id_cols: list[F.Column], text_col: str, lang_col: str, source_col: str) -> DataFrame:
    rows = docs.select(*id_cols, F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    stats = with_statistics(rows, "text", list(BASE)).drop("text")
    return stats.withColumns(measures({c: F.col(c) for c in BASE})).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept.

    Null texts have no words and so fail the base. Null languages and sources count as the empty
    string. Null ids and repeated rows are judged as any other. An empty table gives no rows. Other
    columns are not read, so their names cannot clash.
    """
    stats = written(_measured(docs, [F.col(id_col).alias("doc_id")], text_col, lang_col, source_col), "statistics")
    limits = written(fences(written(sketch(stats.where(~F.col("base_failed"))), "sketch")), "fences")
    return judged(stats, limits).select("doc_id", *BASE[:-1], "base_failed", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they are.

    Null texts go, as they have no words; null languages and sources count as the empty string; repeated
    rows come and go together; an empty table stays empty. Columns may have any names. The texts are read twice, once for the sketches and once to filter, and never shuffled.
    """
    stats = _measured(docs, [], text_col, lang_col, source_col).where(~F.col("base_failed")).select("lang", "source", *SLACK)
    limits = written(fences(written(sketch(stats), "sketch")), "fences")
    names = {c: free_name(docs, f"_{c}") for c in (*BASE, "lang", "source")}
    full = with_statistics(docs, text_col, [names[c] for c in BASE])
    full = full.withColumns({names["lang"]: F.coalesce(F.col(lang_col), F.lit("")), names["source"]: F.coalesce(F.col(source_col), F.lit(""))})
    fence = limits.withColumnsRenamed({"lang": "fence_lang", "source": "fence_source"})
    private = {c: free_name(docs, c) for c in fence.columns}
    fence = fence.withColumnsRenamed(private)
    keys = [F.col(names[c]) == F.col(private[f"fence_{c}"]) for c in ("lang", "source")]
    got = measures({c: F.col(names[c]) for c in BASE})
    fine = ~base_failed(F.col(names["n_words"]), F.col(names["n_repeat_words"]))
    for m in SLACK:
        fine = fine & ~F.coalesce(got[m] > F.col(private[f"fence_{m}"]), F.lit(False))
    return full.where(~base_failed(F.col(names["n_words"]), F.col(names["n_repeat_words"]))).join(fence, keys[0] & keys[1], "left").where(fine).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts on ``documents``."""
    return quality_verdicts(table(spark, sf_dir, "documents"))
