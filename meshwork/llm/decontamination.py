"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

Words are runs of letters and digits in lower case; shingles are five words
(an item of fewer words is one shingle). A window has as many words as an item,
or fewer where the text is shorter or ends.

1. Windows. A window whose weighted shingle similarity with an item reaches
   ``similarity`` = j has at least j of the item's shingle occurrences. So of the
   item's rarest distinct shingles, one more than it may miss, its anchors, the
   window has one; and j of the item's occurrences lie within its places. The
   documents' shingles are compared with the anchors; the documents that have one
   are read once more, and every start is taken from which enough places with the
   item's shingles are in reach. No other window can reach j.
2. Fingerprints. Each window's and each item's shingles, weighted by their number
   of occurrences, make a 64-bit SimHash.
3. Candidates. Eight blocks of eight bits: of two fingerprints within RADIUS = 23
   bits some block differs in at most two, so each window visits, per block, the
   37 values within two bits. That gives every pair of a window and an item of its
   size within the radius, whichever item the window was taken for. Two sets with
   j = 0.8 have an angle of 0.476, hence 9.7 differing bits on average with
   deviation 2.9; the radius is 4.6 deviations up.
4. Verification. sum of least over sum of greatest occurrences, over all
   shingles of window and item, at least j.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, files_for, materialize
from .text import free_name

SHINGLE, SIMILARITY, RADIUS, BLOCK = 5, 0.8, 23, 8
_FLIPS = [0] + [1 << i for i in range(BLOCK)] + [1 << i | 1 << k for i in range(BLOCK) for k in range(i)]


def word_array(text: Column) -> Column:
    """Runs of letters and digits of a lower-cased text; null: none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingle_array(words: Column, size: Column) -> Column:
    """Hashes of all runs of ``size`` words (SHINGLE at most), by position. ``words`` must be a plain column: it is read once per word of a run."""
    word = lambda i, j: F.get(words, i + j) if j == 0 else F.when(size > j, F.get(words, i + j))
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[word(i, j) for j in range(SHINGLE)]))
    return F.when(F.size(words) >= size, runs).otherwise(F.array().cast("array<long>"))


def _simhash(shingles: DataFrame, keys: list[str]) -> DataFrame:
    """keys and simhash of rows (keys, h, n): bit i is set where over half the weight has it."""
    sums = [F.sum(F.col("n") * F.shiftright("h", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
    got = shingles.groupBy(*keys).agg(F.sum("n").alias("m"), *sums)
    out = F.lit(0).cast("long")
    for i in range(64):
        out = out.bitwiseOR(F.when(2 * F.col(f"b{i}") > F.col("m"), F.lit(-(1 << 63) if i == 63 else 1 << i)).otherwise(F.lit(0)).cast("long"))
    return got.select(*keys, "m", out.alias("simhash"))


def prepare_items(benchmark: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(items, shingles, anchors, ids) of a benchmark table (item_id, text).

    items: rep, words, m, simhash; one row per distinct word sequence. shingles: rep,
    words, h, n. anchors: h, words, rep. ids: item_id, rep. rep is the word
    sequence's hash; items without words are left out.
    """
    files = files_for(benchmark.count())
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_array(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    items = materialize(items.select("item_id", F.size("ws").alias("words"), F.concat_ws(" ", "ws").alias("key"), "ws"), "items", files)
    reps = items.groupBy("key").agg(F.min(F.struct("words", "ws")).alias("x")).select("key", F.xxhash64("key").alias("rep"), "x.*")
    reps = materialize(reps, "reps", files)
    hashes = shingle_array(F.col("ws"), F.least("words", F.lit(SHINGLE)))
    shingles = materialize(reps.select("rep", "words", F.explode(hashes).alias("h")).groupBy("rep", "words", "h").agg(F.count("*").alias("n")), "shingles", files)
    common = shingles.groupBy("h").agg(F.count("*").alias("items"))
    ranked = shingles.join(common, "h").withColumn("rank", F.row_number().over(Window.partitionBy("rep").orderBy("items", "h")))
    missing = F.floor(_places("words") * F.lit(1 - similarity) + F.lit(1e-9))
    anchors = ranked.where(F.col("rank") <= missing + 1).select("h", "words", "rep")
    ids = items.join(reps.select("key", "rep"), "key").select("item_id", "rep")
    return materialize(_simhash(shingles, ["rep", "words"]), "item-prints", files), shingles, materialize(anchors, "anchors", files), materialize(ids, "item-ids", files)


def _places(words: str) -> Column:
    """Shingles of a full window of so many words."""
    return F.greatest(F.col(words), F.lit(SHINGLE)) - SHINGLE + 1


def _blocks(x: Column) -> Column:
    return F.array(*[F.shiftright(x, BLOCK * i).bitwiseAND(F.lit(2**BLOCK - 1)).cast("int") for i in range(64 // BLOCK)])


def _spread(docs: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, pos and h of every shingle of k words."""
    read = docs.select(*keys, word_array(F.col("text")).alias("ws"))
    return read.select(*keys, F.posexplode(shingle_array(F.col("ws"), F.lit(k))).alias("pos", "h"))


def _windows(texts: DataFrame, shingles: DataFrame, sizes: list[int], similarity: float) -> DataFrame:
    """(row, first, words): every window with as many of an item's shingles as ``similarity`` takes; texts: row, text, reps."""
    parts = None
    for k in sizes:
        mine = shingles.where(F.least("words", F.lit(SHINGLE)) == k).select("rep", "words", "h")
        met = _spread(texts, ["row", "reps"], k).join(broadcast_if_small(mine), "h").where(F.array_contains("reps", F.col("rep"))).select("row", "rep", "words", "pos")
        parts = met if parts is None else parts.unionByName(met)
    need = F.greatest(F.ceil(_places("words") * F.lit(similarity) - F.lit(1e-9)), F.lit(1)).cast("int")
    # of a document's places with an item's shingles, ascending: each and the one with which there are enough
    placed = parts.groupBy("row", "rep", "words").agg(F.sort_array(F.collect_list("pos")).alias("ps")).withColumn("need", need).where(F.size("ps") >= F.col("need"))
    runs = F.transform(F.sequence(F.lit(0), F.size("ps") - F.col("need")), lambda i: F.struct(F.get("ps", i).alias("first"), F.get("ps", i + F.col("need") - 1).alias("last")))
    near = placed.select("row", "words", F.explode(runs).alias("r")).where(F.col("r.last") - F.col("r.first") < _places("words"))
    low = F.greatest(F.col("r.last") - _places("words") + 1, F.lit(0))
    return near.select("row", "words", F.explode(F.sequence(low, F.col("r.first"))).alias("first")).distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, first_word, n_words and similarity of every pair of a document and an item that it has.

    One row per pair, of its best window (then the first). Rows that share a
    doc_id count as one document with several texts. Null and empty texts and
    items without words match nothing; items of equal words are all reported;
    a null doc_id or item_id is an id like any other; either table may be empty;
    other columns are ignored. ``similarity`` is 0.8 at least, for which RADIUS is made.
    """
    items, item_shingles, anchors, ids = prepare_items(benchmark, similarity)
    files = files_for(docs.count())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5("text")).alias("row"))  # copies of a text are one row
    sizes = sorted(r.k for r in anchors.select(F.least("words", F.lit(SHINGLE)).alias("k")).distinct().collect()) or [SHINGLE]
    hits = None
    for k in sizes:
        mine = anchors.where(F.least("words", F.lit(SHINGLE)) == k).select("h").distinct()
        got = _spread(docs, ["doc_id", "row"], k).join(broadcast_if_small(mine), "h").select("doc_id", "row", "h", F.lit(k).alias("k"))
        hits = got if hits is None else hits.unionByName(got)
    hits = materialize(hits.distinct(), "hits", files)
    mine = anchors.select("h", "rep", F.least("words", F.lit(SHINGLE)).alias("k"))
    met = hits.select("row", "h", "k").distinct().join(broadcast_if_small(mine), ["h", "k"])
    # the texts with an anchor are read once more
    asked = materialize(met.groupBy("row").agg(F.collect_set("rep").alias("reps")), "asked", files)
    texts = docs.join(broadcast_if_small(asked.select("row")), "row", "left_semi").groupBy("row").agg(F.first("text").alias("text"))
    texts = materialize(texts.join(asked, "row"), "texts", files)
    places = _windows(texts, item_shingles, sizes, similarity)
    cut = texts.select("row", word_array(F.col("text")).alias("ws")).join(places, "row").select("row", "first", "words", F.slice("ws", F.col("first") + 1, F.col("words")).alias("ws"))
    hashes = shingle_array(F.col("ws"), F.least("words", F.lit(SHINGLE)))
    window = ["row", "first", "words"]
    shingles = materialize(cut.select(*window, F.explode(hashes).alias("h")).groupBy(*window, "h").agg(F.count("*").alias("n")), "window-shingles", 4 * files)
    prints = _simhash(shingles, window)
    probe = prints.select(*window, "simhash", "m", F.posexplode(_blocks(F.col("simhash"))).alias("block", "v"))
    probe = probe.select(*window, "simhash", "m", "block", F.explode(F.array(*[F.col("v").bitwiseXOR(F.lit(x)) for x in _FLIPS])).alias("v"))
    index = items.select("rep", "words", F.col("m").alias("item_m"), F.col("simhash").alias("item_hash"), F.posexplode(_blocks(F.col("simhash"))).alias("block", "v"))
    near = probe.join(broadcast_if_small(index), ["words", "block", "v"]).where(F.bit_count(F.col("simhash").bitwiseXOR(F.col("item_hash"))) <= RADIUS)
    pairs = near.select(*window, "m", "rep", "item_m").distinct()
    other = item_shingles.select("rep", "h", F.col("n").alias("item_n"))
    both = pairs.join(shingles, window).join(broadcast_if_small(other), ["rep", "h"]).groupBy(*window, "rep", "m", "item_m").agg(F.sum(F.least("n", "item_n")).alias("both"))
    scored = both.withColumn("similarity", F.col("both") / (F.col("m") + F.col("item_m") - F.col("both"))).where(F.col("similarity") >= similarity - 1e-12)
    best = scored.groupBy("row", "rep").agg(F.max(F.struct("similarity", (-F.col("first")).alias("back"), "words")).alias("x"))
    best = best.join(ids, "rep").join(hits.select("doc_id", "row").distinct(), "row")  # an item, and a document, may have several texts
    best = best.groupBy("doc_id", "item_id").agg(F.max("x").alias("x"))
    return best.select("doc_id", "item_id", (-F.col("x.back")).cast("long").alias("first_word"), F.col("x.words").cast("long").alias("n_words"), F.col("x.similarity").alias("similarity"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose document has no benchmark item, as they are; repeated rows stay repeated.

    A null doc_id is an id like any other; an empty table gives an empty result.
    """
    leaked = free_name(docs, "leaked")
    bad = find_leaks(docs, benchmark, similarity).select(F.col("doc_id").alias(leaked)).distinct()
    return docs.join(broadcast_if_small(materialize(bad, "leaked", files_for(docs.count()))), F.col("doc_id").eqNullSafe(F.col(leaked)), "left_anti")
