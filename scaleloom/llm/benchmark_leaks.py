"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

DataFrame functions only. Words are runs of letters and digits, lower-cased; shingles have five words
(an item with fewer is one shingle). A window is as long as an item; windows stand at every word. A window
of similarity 0.8 with an item of m shingles has at least 8/9 m (a text shorter than the item: 0.8 m)
places with shingles of the benchmark, so those with fewer are passed over before their fingerprints are
made: no window that could reach the similarity is lost. Fingerprints meet those of items of the same
length in an index of eight blocks of eight bits, each item filed under every value within two bits of
its block: any pair within 23 bits shares an entry, so all within RADIUS are found. They are verified by
weighted Jaccard similarity, the weight of a shingle being how often it occurs.

Edge cases: null or wordless texts and items match nothing; items with a null id match nothing; documents
are told apart by their whole texts, so rows with a null doc_id, or with one that other texts have too,
are judged by their own text (of several findings of a doc_id and an item the best is reported); an
empty table gives no rows; other columns are ignored. Shingles are compared by 64 bits of hash, texts by 128.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 20
BLOCKS, BLOCK_BITS, NEAR = 8, 8, 2
#: Distinct benchmark shingles and ids of documents that are broadcast at most; more are joined.
BROADCAST_SHINGLES, BROADCAST_IDS = 1_000_000, 2_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column, k: int) -> Column:
    """Hashes of the k-word shingles of an array of words, by position; none if it is shorter."""
    at = lambda i: F.xxhash64(F.lit(k), *[F.get(w, i + j) for j in range(k)])
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), at)).otherwise(F.array().cast("array<bigint>"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def simhash(hashes: Column) -> Column:
    """64-bit fingerprint of an array of hashes; a repeated shingle weighs as often as it occurs."""
    ones = lambda b: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.shiftright(h, b).bitwiseAND(F.lit(1).cast("long")).cast("int"))
    parts = [F.when(ones(b) * 2 > F.size(hashes), F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(64)]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two multisets of hashes."""
    count = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    both = F.array_intersect(a, b)
    plain = F.size(F.array_distinct(a)) == F.size(a)
    shared = F.when(plain, F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda n, v: n + F.least(count(a, v), count(b, v))))
    return let(shared, lambda s: s / (F.size(a) + F.size(b) - s))


def _block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long")).cast("int")


def text_key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _starts(n: Column, k: Column) -> Column:
    """The first words of all windows of ``n`` words that hold enough of the places ``p`` (sorted); ``size`` is the text's number of shingles."""
    m, last = n - k + 1, F.col("size") + k - 1 - n
    need = F.greatest(F.lit(1), F.ceil(F.lit(2 * SIMILARITY / (1 + SIMILARITY)) * m - 1e-9)).cast("int")
    short = F.ceil(F.lit(SIMILARITY) * m - 1e-9).cast("int")
    at = lambda j: F.get("p", j)
    reach = lambda j: F.struct(F.greatest(F.lit(0), at(j + need - 1) - m + 1).alias("lo"), F.least(at(j), last).alias("hi"))
    spans = F.filter(F.transform(F.sequence(F.lit(0), F.size("p") - need), reach), lambda x: x["lo"] <= x["hi"])
    whole = F.when(F.size("p") >= short, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    inside = F.when(F.size("p") >= need, F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["lo"], x["hi"]))))).otherwise(F.array().cast("array<int>"))
    return F.when(last < 0, whole).otherwise(inside)


def leaking_texts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """text (its key), item_id, similarity, start_word, n_words: the best window of each pair that reaches SIMILARITY."""
    item = benchmark.where("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("w"))
    item = stash(item.select("item_id", "w", F.size("w").alias("n")).where("n > 0"), "items")
    sizes = sorted(r.k for r in item.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect())  # five values at most
    if not sizes:
        return docs.select(text_key().alias("text"), F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start_word"), F.lit(0).alias("n_words")).limit(0)
    by_size = F.array().cast("array<bigint>")
    for k in sizes:
        by_size = F.when(F.least("n", F.lit(SHINGLE)) == k, shingles(F.col("w"), k)).otherwise(by_size)
    item = stash(item.select("item_id", "n", F.least("n", F.lit(SHINGLE)).alias("k"), by_size.alias("ih")).withColumn("ifp", simhash(F.col("ih"))), "items")
    lengths = stash(item.select("n", "k", F.explode("ih").alias("h")).distinct(), "lengths")
    known = lengths.select("h").distinct()
    small = known.count() <= BROADCAST_SHINGLES
    shared = lambda df: F.broadcast(df) if small else df

    src = docs.where("text IS NOT NULL").select("text")
    hashed = let(words(F.col("text")), lambda w: F.array(*[F.struct(F.lit(k).alias("k"), shingles(w, k).alias("h")) for k in sizes])).alias("s")
    each = src.select(text_key().alias("text"), F.explode(hashed).alias("s")).select("text", "s.k", F.size("s.h").alias("size"), F.posexplode("s.h").alias("pos", "h"))
    hits = stash(each.join(shared(known), "h", "left_semi"), "hits")

    # places of one text with shingles of items of one length; windows that hold enough of them
    places = hits.join(F.broadcast(lengths) if lengths.count() <= BROADCAST_SHINGLES else lengths, ["h", "k"]).groupBy("text", "k", "n", "size").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    starts = stash(places.select("text", "k", "n", _starts(F.col("n"), F.col("k")).alias("starts")).where(F.size("starts") > 0), "starts")
    ids = starts.select("text").distinct()
    few = ids.count() <= BROADCAST_IDS
    texts = src.withColumn("key", text_key()).join((F.broadcast(ids) if few else ids).withColumnRenamed("text", "key"), "key", "left_semi").dropDuplicates(["key"])
    texts = texts.select(F.col("key"), F.explode(hashed).alias("s")).select(F.col("key").alias("text"), "s.k", "s.h")
    windows = starts.join(texts, ["text", "k"]).select("text", "k", "n", "h", F.explode("starts").alias("start"))
    windows = windows.select("text", "n", "start", F.slice("h", F.col("start") + 1, F.col("n") - F.col("k") + 1).alias("wh"))
    windows = stash(windows.withColumn("wfp", simhash(F.col("wh"))), "leak_windows")

    near = [0, *(1 << i for i in range(BLOCK_BITS)), *((1 << i) + (1 << j) for i, j in combinations(range(BLOCK_BITS), NEAR))]
    blocks = lambda fp: F.posexplode(F.array(*[_block(F.col(fp), i) for i in range(BLOCKS)])).alias("slot", "value")
    index = item.select("item_id", "n", "ih", "ifp", blocks("ifp")).withColumn("flip", F.explode(F.array(*map(F.lit, near))))
    index = index.select("item_id", "n", "ifp", "slot", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    probes = windows.select("text", "n", "start", "wfp", blocks("wfp"))
    pairs = probes.join(index, ["n", "slot", "value"]).where(F.bit_count(F.col("wfp").bitwiseXOR(F.col("ifp"))) <= RADIUS).select("text", "n", "start", "item_id").distinct()
    checked = pairs.join(windows.select("text", "n", "start", "wh"), ["text", "n", "start"]).join(item.select("item_id", "ih"), "item_id")
    found = checked.select("text", "item_id", F.round(weighted_similarity(F.col("wh"), F.col("ih")), 6).alias("similarity"), F.col("start").alias("start_word"), F.col("n").alias("n_words")).where(F.col("similarity") >= SIMILARITY)
    best = F.max_by(F.struct("similarity", "start_word", "n_words"), F.struct("similarity", -F.col("start_word")))
    return found.groupBy("text", "item_id").agg(best.alias("b")).select("text", "item_id", "b.similarity", "b.start_word", "b.n_words")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: the best window of each pair that reaches SIMILARITY."""
    found = stash(leaking_texts(docs, benchmark), "leaks")
    owners = docs.where("doc_id IS NOT NULL").select("doc_id", text_key().alias("text"))
    each = owners.join(F.broadcast(found) if found.count() <= BROADCAST_IDS else found, "text")
    best = F.max_by(F.struct("similarity", "start_word", "n_words"), F.struct("similarity", -F.col("start_word")))
    return each.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.similarity", "b.start_word", "b.n_words")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark passage."""
    gone = stash(leaking_texts(docs, benchmark).select(F.col("text").alias("_leak")).distinct(), "leaks")
    gone = (F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone).alias("leak_texts")
    return docs.join(gone, text_key().eqNullSafe(F.col("leak_texts._leak")), "left_anti").select(*docs.columns)
