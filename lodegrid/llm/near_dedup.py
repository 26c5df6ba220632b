"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Every text becomes its set of shingles (64-bit hashes of word n-grams, whole text). Equal sets
   collapse to one numbered set before anything else, pre-aggregated, so thousands of copies cost
   one row.
2. Sets get a signature of 160 minima, cut into 32 bands of 5; a bucket is one band value.
3. Candidates of a bucket are never expanded into all pairs. Each member is first held against the
   bucket's smallest member only. The comparison reads the signatures in batches of 32 minima and
   drops a pair as soon as the posterior probability that its similarity reaches the threshold is
   under ``miss`` (a Beta posterior with a uniform prior; its tail is a binomial sum). Buckets whose
   members are not one plausible block after that are compared in square tiles of bounded size, and a
   tile passes on a spanning forest of what survives, not the pairs.
4. Blocks of plausibly similar texts are verified exactly on full sets, again in tiles of bounded
   size, skipping pairs that are already connected: first each chunk of a block in itself, then one
   text of each component found so far against those of other chunks, round by round, so that a large
   group of copies shrinks to one component without any square of it. What stays outside a block's
   main component is compared with the block by signatures alone, and texts move only to the tiles in
   which a signature found them a partner. Only what exact verification confirms links.

A true pair at the threshold shares a band with probability 1 - 7e-9 at 0.85 and 1 - 3e-6 at 0.80.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegrid.llm.common import by_group, components, cut, fields, free_name, table, tidied, written

MINIMA, BANDS, BATCH = 160, 32, 32
ROWS = MINIMA // BANDS
#: Sets in one side of a tile that holds texts, and of one that holds signatures; bounds what a task holds.
TILE, WIDE = 256, 512
#: Multipliers are drawn once from fixed seeds, so every run and every executor has the same.
_A = np.random.default_rng(11).integers(1, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
_B = np.random.default_rng(12).integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_BAND = np.random.default_rng(13).integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_PLACE = np.random.default_rng(14).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, width: int, words: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word ``width``-grams; A-Z lower-cased, words are
    runs of anything but the ASCII white space. Fewer words: the whole sequence as one."""
    if not text:
        return np.empty(0, np.uint64)
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.array([words[w] for w in found], np.uint64)
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out += h[i : len(h) - n + 1 + i] * _PLACE[i]
    return np.unique(_mixed(out))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least of each of 160 hash functions over a set of shingles."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        v = x[None, i : i + 1024] * _A[:, None]
        v += _B[:, None]
        v ^= v >> np.uint32(15)
        np.minimum(least, v.min(axis=1), out=least)
    return least


def least_matches(threshold: float, miss: float, minima: int = MINIMA, batch: int = BATCH) -> list[tuple[int, int]]:
    """After n minima a pair goes on only with so many matches: (n, matches). Below that, the posterior
    probability of a similarity of ``threshold`` or more is under ``miss``."""
    out = []
    for n in range(batch, minima + 1, batch):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                out.append((n, m))
                break
    return out


def _survive(one: np.ndarray, many: np.ndarray, tests: list[tuple[int, int]]) -> np.ndarray:
    """Indexes of the rows of ``many`` that stay plausible beside ``one``, batch by batch."""
    left = np.arange(len(many))
    matches = np.zeros(len(many), np.int32)
    done = 0
    for n, least in tests:
        matches += (many[left, done:n] == one[..., done:n]).sum(axis=1, dtype=np.int32) if one.ndim == 1 else (many[left, done:n] == one[left, done:n]).sum(axis=1, dtype=np.int32)
        stay = matches >= least
        left, matches, done = left[stay], matches[stay], n
    return left


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))], np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, digest, n_shingles, k1, k2, sig, bands): digest is a hash of the text, k1 and k2 name the set;
    sig has a byte for each minimum."""
    schema = fields("doc_id long", "digest long", "n_shingles long", "k1 long", "k2 long", "sig binary", "bands array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, 2):
                words = _Words()
                n, keys, sigs = [], [], []
                for text in batch.column(2).to_pylist():
                    s = shingle_set(text, width, words)
                    n.append(len(s))
                    with np.errstate(over="ignore"):
                        keys.append((int(_mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)), int(_mixed(s * np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64))))
                    sigs.append(signature(s))
                full = np.stack(sigs)
                bands = (full.reshape(-1, BANDS, ROWS).astype(np.uint64) * _BAND[None]).sum(axis=2, dtype=np.uint64) + _BAND[None, :, 0]
                bands = _mixed(bands).view(np.int64)
                short = full.astype(np.uint8)
                key = np.array(keys, np.uint64).view(np.int64)
                none = np.array(n) == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(n, pa.int64()),
                        pa.array(key[:, 0], mask=none),
                        pa.array(key[:, 1], mask=none),
                        pa.array([None if e else r.tobytes() for r, e in zip(short, none, strict=True)], pa.binary()),
                        pa.array([None if e else r for r, e in zip(bands, none, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=schema.names,
                )

    return _texts(docs, id_col, text_col).mapInArrow(tidied(run), schema)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, text): the digest tells texts of one id apart."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, MINIMA)


def _plausible_pairs(pairs: DataFrame, sets: DataFrame, tests: list[tuple[int, int]]) -> DataFrame:
    """The pairs (a, b) that the sequential test leaves."""
    schema = fields("a long", "b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                stay = _survive(_matrix(batch.column(2)), _matrix(batch.column(3)), tests)
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(stay)) for i in (0, 1)], names=schema.names)

    side = lambda c: sets.select(F.col("sid").alias(c), F.col("sig").alias(f"sig_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(tidied(run), schema)


def _chunk(count: str, size: int, seed: int = 42) -> F.Column:
    """One of so many chunks that each has about ``size`` of ``count`` sets."""
    return F.pmod(F.xxhash64("sid", F.lit(seed)), F.ceil(F.col(count) / F.lit(size)).cast("int")).cast("int")


def _tiles(members: DataFrame, size: str) -> DataFrame:
    """Deal the members of each group into chunks of about WIDE rows, and a row to each tile (i, j), i <= j,
    of two chunks that holds its chunk; ``own`` is its chunk. Groups of up to WIDE rows are one tile."""
    n = F.ceil(F.col(size) / F.lit(WIDE)).cast("int")
    return (
        members.withColumn("own", _chunk(size, WIDE))
        .withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .drop("other", size)
    )


def _pairs(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(len(names))], names=names)


def _tile_edges(members: DataFrame, tests: list[tuple[int, int]]) -> DataFrame:
    """Members (bucket, sid, block, sig, own, i, j): a spanning forest of plausible pairs across blocks."""
    schema = fields("a long", "b long")

    def tile(rows: pa.Table) -> pa.RecordBatch | None:
        ids, own = rows["sid"].to_numpy(), rows["own"].to_numpy()
        blocks = np.unique(rows["block"].to_numpy(), return_inverse=True)[1]
        sig = _matrix(rows["sig"])
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        left = np.flatnonzero(own == i)
        right = left if i == j else np.flatnonzero(own == j)
        union, label, out = _Union(int(blocks.max()) + 1), blocks.copy(), []
        for x in left:
            apart = right[label[right] != label[x]]
            if i == j:
                apart = apart[apart > x]
            joined = False
            for y in apart[_survive(sig[x], sig[apart], tests)]:
                if union.join(int(blocks[x]), int(blocks[y])):
                    out.append((ids[x], ids[y]))
                    joined = True
            if joined:
                label = union.roots()[blocks]
        return _pairs(out, schema.names)

    return by_group(members, ["bucket", "i", "j"], tile, schema)


def _partners(members: DataFrame, tests: list[tuple[int, int]]) -> DataFrame:
    """Members (block, wi, wj, sid, label, left, chunk, sig) of signature tiles: (block, sid, left, other), the
    chunks of the other side in which a set of another label is plausible beside it."""
    schema = fields("block long", "sid long", "left boolean", "other int")

    def tile(rows: pa.Table) -> pa.RecordBatch | None:
        ids, label, chunk = (rows[c].to_numpy() for c in ("sid", "label", "chunk"))
        lefts = rows["left"].to_numpy(zero_copy_only=False)
        sig, rights, out = _matrix(rows["sig"]), np.flatnonzero(~lefts), set()
        for x in np.flatnonzero(lefts):
            apart = rights[label[rights] != label[x]]
            found = apart[_survive(sig[x], sig[apart], tests)]
            out.update((int(ids[x]), True, int(c)) for c in np.unique(chunk[found]))
            out.update((int(ids[y]), False, int(chunk[x])) for y in found)
        got = list(out)
        columns = [pa.array([rows["block"][0].as_py()] * len(got), pa.int64())]
        columns += [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return by_group(members, ["block", "wi", "wj"], tile, schema)


def _verified(members: DataFrame, keys: list[str], threshold: tuple[int, int], width: int, tests: list[tuple[int, int]]) -> DataFrame:
    """Members (keys, sid, label, left, right, sig, text): exactly confirmed links between texts of
    different labels, one marked ``left`` and one ``right``, as a spanning forest over the labels."""
    schema = fields("a long", "b long")
    top, bottom = threshold

    def tile(rows: pa.Table) -> pa.RecordBatch | None:
        ids = rows["sid"].to_numpy()
        start = np.unique(rows["label"].to_numpy(), return_inverse=True)[1]
        if start.max() == 0:
            return None
        sig, words = _matrix(rows["sig"]), _Words()
        sets = [shingle_set(t, width, words) for t in rows["text"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        names, codes = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        sets = [codes[e - n : e] for e, n in zip(ends, sizes, strict=True)]
        mark = np.zeros(len(names), bool)
        union, label, out = _Union(int(start.max()) + 1), start.copy(), []
        lefts, rights = rows["left"].to_numpy(zero_copy_only=False), np.flatnonzero(rows["right"].to_numpy(zero_copy_only=False))
        for x in np.flatnonzero(lefts):
            apart = rights[label[rights] != label[x]]
            # a size ratio under the threshold rules a pair out: the smaller set bounds the intersection
            n = sizes[apart]
            apart = apart[bottom * np.minimum(n, sizes[x]) >= top * np.maximum(n, sizes[x])]
            found = apart[_survive(sig[x], sig[apart], tests)]
            if not len(found):
                continue
            mark[sets[x]] = True
            joined = False
            for y in found:
                common = int(np.count_nonzero(mark[sets[y]]))
                if bottom * common >= top * (sizes[x] + sizes[y] - common) and union.join(int(start[x]), int(start[y])):
                    out.append((ids[x], ids[y]))
                    joined = True
            mark[sets[x]] = False
            if joined:
                label = union.roots()[start]
        return _pairs(out, schema.names)

    return by_group(members, keys, tile, schema)


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with the smallest set that links reach from each as its label."""
    got = components(links).select(F.col("id").alias("sid"), F.col("component").alias("label"))
    return members.join(got, "sid", "left").withColumn("label", F.coalesce("label", "sid"))


def _sides(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every row on both sides of its tile."""
    return rows.select(*keys, "sid", "label", F.lit(True).alias("left"), F.lit(True).alias("right"), "sig", "text")


def _links(whole: DataFrame, threshold: tuple[int, int], width: int, tests: list[tuple[int, int]]) -> DataFrame:
    """Members (block, size, sid, sig, text) of blocks: a spanning forest of their exact links, (a, b)."""
    first = whole.withColumns({"i": _chunk("size", TILE), "label": F.col("sid")})
    links = written(_verified(_sides(first, ["block", "i"]), ["block", "i"], threshold, width, tests), "links")

    # blocks of several chunks: one text of each component, dealt anew each round, while that halves their number
    large = whole.where(F.col("size") > TILE)
    before = large.count()
    for seed in range(1, 64 if before else 1):
        labels = written(_labelled(large.select("block", "size", "sid"), links), "labels")
        heads = labels.where("sid = label").select("block", "sid", "label")
        counts = heads.groupBy("block").agg(F.count("*").alias("heads")).where("heads > 1")
        heads = written(heads.join(counts, "block").withColumn("i", _chunk("heads", TILE, seed)), "heads")
        now = heads.count()
        if not now or 2 * now > before:
            break
        before = now
        tile = heads.join(large.select("sid", "sig", "text"), "sid")
        links = links.unionByName(written(_verified(_sides(tile, ["block", "i"]), ["block", "i"], threshold, width, tests), "links"))
    if not before:
        return links

    # what is not in a block's main component, against all of the block
    counts = labels.groupBy("block", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("block").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("rest"), F.count("*").alias("labels")).where("labels > 1")
    main = written(main.select("block", "main", "rest"), "main")
    open_ = labels.join(main, "block").join(large.select("sid", "sig"), "sid")
    side = {}
    for left, count, wide in ((True, "rest", ("wj", "wi", "size")), (False, "size", ("wi", "wj", "rest"))):
        own, other, many = wide
        rows = open_.where("label != main") if left else open_
        seed = 7 if left else 8
        rows = rows.withColumns({"chunk": _chunk(count, TILE, seed), own: _chunk(count, WIDE, seed + 2), other: F.explode(F.sequence(F.lit(0), F.ceil(F.col(many) / F.lit(WIDE)).cast("int") - 1))})
        side[left] = rows.select("block", "wi", "wj", "sid", "label", F.lit(left).alias("left"), "chunk", "sig")
    met = written(_partners(side[True].unionByName(side[False]), tests).distinct(), "partners")
    placed = met.join(open_.select("sid", "label", "rest", "size"), "sid")
    own = F.when(F.col("left"), _chunk("rest", TILE, 7)).otherwise(_chunk("size", TILE, 8))
    placed = placed.withColumns({"i": F.when(F.col("left"), F.col("other")).otherwise(own), "j": F.when(F.col("left"), own).otherwise(F.col("other"))})
    tile = placed.select("block", "i", "j", "sid", "label", "left", (~F.col("left")).alias("right")).join(large.select("sid", "sig", "text"), "sid")
    return links.unionByName(written(_verified(tile, ["block", "i", "j"], threshold, width, tests), "links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: tuple[int, int] = (80, 100), miss: float = 1e-7) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, n_shingles, component_id, kept).

    Two texts are linked if intersection / union of their sets of word ``width``-grams is at least
    ``threshold`` (a fraction, numerator and denominator). component_id is the smallest id reachable
    over links, kept whether it is the row's own.

    Null or wordless texts have no shingles and link with nothing. A null id is its own component
    (null) and kept. Rows are documents: repeated ids with one text are copies, with different texts
    they are separate documents that happen to share a number. An empty table gives no rows. Columns
    but the two named are not read, so their names cannot clash.
    """
    tests = least_matches(threshold[0] / threshold[1], miss)
    sigs = written(signatures(docs, id_col, text_col, width), "signatures")
    real = sigs.where("doc_id is not null and n_shingles > 0")
    sets = real.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "digest")).alias("least"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    sets = written(sets.select("k1", "k2", "least.doc_id", "least.digest", "sig", "bands", F.monotonically_increasing_id().alias("sid")), "sets")

    placed = sets.select("sid", F.explode("bands").alias("bucket"))
    shared = written(placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("sid").alias("first")).where("size > 1"), "buckets")
    members = written(placed.join(shared, "bucket"), "members")
    stars = members.where("sid != first").select(F.col("sid").alias("a"), F.col("first").alias("b")).distinct()
    plausible = written(_plausible_pairs(stars, sets, tests), "plausible")
    block = components(plausible).select(F.col("id").alias("sid"), F.col("component").alias("block"))

    # buckets of three and more that are not one block yet: compare across blocks, in tiles
    known = members.where("size > 2").join(block, "sid", "left").withColumn("block", F.coalesce("block", "sid"))
    known = written(known.select("bucket", "size", "sid", "block"), "known")
    split = written(known.groupBy("bucket").agg(F.min("block").alias("least"), F.max("block").alias("most")).where("least != most").select("bucket"), "split")
    apart = known.join(split, "bucket").join(sets.select("sid", "sig"), "sid")
    more = written(_tile_edges(_tiles(apart, "size"), tests), "more")
    block = components(plausible.unionByName(more)).select(F.col("id").alias("sid"), F.col("component").alias("block"))

    # exact verification within blocks; the digest finds the very text that a set was made of
    sizes = written(block.groupBy("block").agg(F.count("*").alias("size")), "sizes")
    block = written(block.join(sizes, "block").join(sets.select("sid", "doc_id", "digest", "sig"), "sid"), "block_members")
    whole = written(block.join(_texts(docs, id_col, text_col), ["doc_id", "digest"]).drop("doc_id", "digest").dropDuplicates(["sid"]), "block_texts")
    links = _links(whole, threshold, width, tests)

    found = written(components(links).select(F.col("id").alias("sid"), "component"), "found")
    least = found.join(sets.select("sid", "doc_id"), "sid").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    least = written(found.join(least, "component").select("sid", "component_id"), "least")
    of_set = sets.select("sid", "k1", "k2", "doc_id").join(least, "sid", "left")
    of_set = written(of_set.select("k1", "k2", F.coalesce("component_id", "doc_id").alias("component_id")), "set_components")
    linked = real.select("doc_id", "n_shingles", "k1", "k2").join(of_set, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    alone = sigs.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: tuple[int, int] = (80, 100), miss: float = 1e-7) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one of the smallest id.

    All columns stay as they are. Rows with a null id stay. Rows that repeat an id are one document: the
    one whose text sorts first stays. Texts move only if the dropped ids are too many to broadcast.
    """
    gone, key = free_name(docs, "dropped_id"), F.col(id_col).cast("long")
    found = near_duplicates(docs, id_col, text_col, width, threshold, miss)
    drop = written(found.where("not kept").select(F.col("doc_id").alias(gone)).distinct(), "dropped")
    kept = docs.join(drop, key == F.col(gone), "left_anti")
    again = written(docs.where(F.col(id_col).isNotNull()).groupBy(key.alias(gone)).agg(F.count("*").alias("n")).where("n > 1").select(gone), "repeated")
    if again.isEmpty():
        return kept
    rank = free_name(docs, "rank")
    order = Window.partitionBy(id_col).orderBy(F.col(text_col), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    first = kept.join(again, key == F.col(gone), "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)
    return kept.join(again, key == F.col(gone), "left_anti").unionByName(first)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near duplicates of ``documents`` by three words and 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, threshold=(85, 100))
