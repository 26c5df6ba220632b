"""Mixing sources to target weights: temperature, and budgeted block permutations.

Source s has a share q_s of all tokens. Its weight is q_s^a, normalised. The exponent a lies between 0
(all sources alike) and 1 (as they are), and is bisected: to the least one whose most repeated source
stays within a repetition limit, or to the one whose weights have a target entropy. Sources are rows of a
table throughout, so there may be any number of them: a repetition limit needs the least and the greatest
share only, an entropy is asked for many exponents in one aggregate.

The weights are realised without sampling. A pass over a source orders its documents by a keyed hash
of their content and of the pass: its leading bits name one of 256 blocks, the next ones one of 1024
parts of a block. A source with a budget of 1.4 passes takes every document once, and of the second
pass those up to a bound on the hash: whole blocks, then whole parts of the block in which the budget
ends, then documents of the part in which it ends. The bound comes from token counts of blocks and
parts, so no more than a 262144th of a source is ever ordered in one task. A document's place in the
mixture is its pass and hash over its source's passes, so any cut of the whole at a fraction of it has
the weights.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegrid.llm.common import free_name, table, written

#: The limit on passes over a source; the hash has 63 bits, 8 for the block and 10 for its part.
REPEATS = 2.0
BITS, BLOCK, PART = 63, 8, 10


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Normalised weights q^exponent of sources with tokens."""
    total = sum(tokens.values())
    raw = {s: (n / total) ** exponent for s, n in tokens.items() if n > 0}
    all_ = sum(raw.values())
    return {s: r / all_ for s, r in raw.items()}


def passes(tokens: dict[str, int], weights: dict[str, float]) -> dict[str, float]:
    """How often each source is read if the least read is read once: weight over share, levelled."""
    total = sum(tokens.values())
    rate = {s: w * total / tokens[s] for s, w in weights.items()}
    least = min(rate.values(), default=1.0)
    return {s: r / least for s, r in rate.items()}


def least_exponent(held: Callable[[list[float]], list[bool]], cuts: int = 31, turns: int = 10) -> float:
    """The least exponent in [0, 1] from which on ``held`` is true, by sections: each turn asks for ``cuts``
    exponents at once, so ten turns give 50 bits."""
    low, high = 0.0, 1.0
    if held([0.0])[0]:
        return 0.0
    for _ in range(turns):
        inner = [low + (high - low) * (i + 1) / (cuts + 1) for i in range(cuts)]
        first = next((i for i, h in enumerate(held(inner)) if h), cuts)
        low, high = (inner[first - 1] if first else low), (inner[first] if first < cuts else high)
    return high


def exponent(totals: DataFrame, repeats: float | None = REPEATS, target_entropy: float | None = None) -> float:
    """The exponent for sources (source, n) with tokens: entropy rises and the most passes rise as it falls."""
    ends = totals.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("all")).head()
    if ends.least is None:
        return 1.0
    if target_entropy is None:
        # the passes of the most repeated source, where the least repeated one is read once
        return least_exponent(lambda tries: [(ends.most / ends.least) ** (1 - a) <= repeats for a in tries])

    def held(tries: list[float]) -> list[bool]:
        q = F.col("n") / F.lit(float(ends.all))
        powers = totals.agg(*(f(F.pow(q, F.lit(a))).alias(f"{k}{i}") for i, a in enumerate(tries) for k, f in (("z", F.sum), ("e", lambda r, a=a: F.sum(r * F.lit(a) * F.log(q)))))).head()
        # entropy of r / z: log z - sum(r log r) / z
        return [math.log(powers[f"z{i}"]) - powers[f"e{i}"] / powers[f"z{i}"] <= target_entropy for i in range(len(tries))]

    return least_exponent(held)


def token_count(text: F.Column) -> F.Column:
    """Words of a text (runs of anything but ASCII white space), the stand-in for its tokens."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _hash(key: F.Column, turn: F.Column) -> F.Column:
    return F.xxhash64(key, turn.cast("int")).bitwiseAND(F.lit((1 << BITS) - 1))


def _ends(rows: DataFrame, level: str) -> DataFrame:
    """Of rows (source, ``level``, n, left), the value of ``level`` in which ``left`` tokens run out, and
    the tokens still wanted there: (source, level, left)."""
    order = Window.partitionBy("source").orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.groupBy("source", level).agg(F.sum("n").alias("n"), F.max("left").alias("left"))
    before = counted.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    return before.where("before < left and before + n >= left").select("source", level, (F.col("left") - F.col("before")).alias("left"))


def source_plan(totals: DataFrame, power: float, budget: int | None = None) -> DataFrame:
    """(source, weight, full, left, passes) of sources (source, n): how many whole passes a source is read, how many
    tokens of one more, and both as a number. Weights are added up as decimals, so that no order of adding shows."""
    whole = totals.agg(F.sum("n")).head()[0] or 0
    raw = F.pow(F.col("n") / F.lit(float(max(1, whole))), F.lit(power))
    real = totals.where("n > 0").withColumn("raw", raw)
    all_ = real.agg(F.sum(F.col("raw").cast("decimal(38,18)"))).head()[0]
    weighed = totals.join(real.select("source", (F.col("raw") / F.lit(float(all_ or 1))).alias("weight")), "source", "left")
    if budget is None:
        budget = real.agg(F.max(F.col("n") / F.col("raw"))).head()[0]
        budget = 0.0 if budget is None else float(budget) * float(all_)
    wanted = F.rint(F.lit(float(budget)) * F.col("weight")).cast("long")
    full = F.when(F.col("n") > 0, F.call_function("div", wanted, F.col("n"))).otherwise(F.lit(1).cast("long"))
    left = F.when(F.col("n") > 0, wanted % F.col("n")).otherwise(F.lit(0).cast("long"))
    plan = weighed.select("source", F.coalesce("weight", F.lit(0.0)).alias("weight"), full.alias("full"), left.alias("left"), "n")
    return plan.select("source", "weight", "full", "left", (F.col("full") + F.coalesce(F.try_divide("left", "n"), F.lit(0.0))).alias("passes"))


#: The columns that ``mix`` adds.
ADDED = ("mix_pass", "mix_place", "mix_weight", "mix_tokens")


def mix(
    docs: DataFrame,
    source_col: str = "source",
    text_col: str = "text",
    id_col: str = "doc_id",
    repeats: float | None = REPEATS,
    target_entropy: float | None = None,
    budget: int | None = None,
    seed: int = 17,
    tokens_col: str | None = None,
) -> DataFrame:
    """``docs`` in the mixture's multiplicity, with the columns mix_pass (from 0), mix_place (0 to 1; the
    mixture's order is by it, ``in_order`` sorts), mix_weight and mix_tokens; columns of those names are
    replaced, unless the operator is told to read them.

    ``budget`` is the number of tokens to emit. Without one it is the least that reads every source once
    in full, so no document is lost and the least weighted source is read exactly once. Either a
    repetition limit or a target entropy sets the exponent. Null sources count as one source of their
    own. Repeated rows share their hash and so come and go together. Sources without a single token are read once. An empty table gives no rows.
    """
    if {source_col.lower(), text_col.lower(), id_col.lower(), (tokens_col or "").lower()} & {c.lower() for c in ADDED}:
        raise ValueError(f"the columns {ADDED} are made here; rename the input's")
    docs = docs.drop(*ADDED)
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col))
    n = F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)) if tokens_col else token_count(F.col(text_col))

    rows = written(docs.select(source.alias("source"), key.alias("key"), n.alias("n")), "tokens")
    totals = written(rows.groupBy("source").agg(F.sum("n").alias("n")), "totals")
    plan_df = written(source_plan(totals, exponent(totals.where("n > 0"), repeats, target_entropy), budget), "plan")

    # the hash up to which the last pass of each source goes
    last = rows.join(plan_df.where("left > 0"), "source").select("source", "n", "left", _hash(F.col("key"), F.col("full")).alias("h"))
    last = last.withColumns({"block": F.shiftright("h", BITS - BLOCK), "part": F.shiftright("h", BITS - BLOCK - PART).bitwiseAND(F.lit((1 << PART) - 1))})
    block = written(_ends(last, "block"), "last_block")
    inside = last.drop("left").join(block, ["source", "block"])
    part = written(_ends(inside, "part"), "last_part")
    inside = last.drop("left").join(block.drop("left"), ["source", "block"]).join(part, ["source", "part"])
    bound = written(_ends(inside, "h").select("source", F.col("h").alias("bound")), "bound")

    limits = plan_df.join(bound, "source", "left").select("source", "weight", "full", "passes", F.coalesce("bound", F.lit(-1)).alias("bound"))
    limits = written(limits, "limits")
    private = {c: free_name(docs, f"_mix_{c}") for c in ("source", "key", "tokens", "weight", "full", "passes", "bound", "pass", "of")}
    c = {k: F.col(v) for k, v in private.items()}
    keyed = docs.withColumns({private["source"]: source, private["key"]: key, private["tokens"]: n})
    here = limits.withColumnsRenamed({k: private[k] for k in ("weight", "full", "passes", "bound")}).withColumnRenamed("source", private["of"])
    joined = keyed.join(here, c["source"] == c["of"])
    times = c["full"].cast("int") + (_hash(c["key"], c["full"]) <= c["bound"]).cast("int")
    taken = joined.where(times > 0).withColumn(private["pass"], F.explode(F.sequence(F.lit(0), times - 1)))
    place = (c["pass"] + _hash(c["key"], c["pass"]) / F.lit(float(1 << BITS))) / F.greatest(c["passes"], c["pass"] + 1e-9)
    return taken.select(
        *(F.col(f"`{x}`") for x in docs.columns),
        c["pass"].alias("mix_pass"),
        F.least(place, F.lit(1.0)).alias("mix_place"),
        c["weight"].alias("mix_weight"),
        c["tokens"].alias("mix_tokens"),
    )


def in_order(mixed: DataFrame) -> DataFrame:
    """Rows of ``mix`` in the mixture's order, over files as within them (a range exchange on places, which hashes
    spread evenly)."""
    return mixed.orderBy("mix_place", "mix_pass")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, mix_pass, mix_place, mix_weight, mix_tokens of every row of the mixture."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).drop("text")
