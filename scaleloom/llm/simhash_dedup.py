"""SimHash near-duplicates by an inverted index of positional bytes with count filtering.

Two fingerprints of 64 bits that differ in at most two bits share at least six of their eight bytes
in place. A posting list for each position and byte would hold a 256th of all fingerprints, and tallying
its pairs would grow with the square of the table. The lists are therefore intersected six at a time before
pairs are made: a posting for each choice of six positions (28 of them) and their bytes. A pair that shares
c positional bytes meets in C(c, 6) of these lists: in none below six, in 1, 7 and 28 at six, seven and
eight. So the pairs that meet are exactly those whose tally over the single-byte lists reaches the
guaranteed minimum of six, and in how many they meet tells the tally. The members of one list
differ in 16 bits only, so a list never holds more than 65,536 distinct fingerprints, however large
the table. Lists up to DIRECT are joined with themselves, longer ones with the 136 changes of two bits that
stay in the list, which is exact at any length. The tally and the distance are verified on each pair.

Edge cases: null or wordless texts have fingerprint zero, linked like any other; equal fingerprints
are one node, so thousands of copies cost one row; a null doc_id never names a component; repeated
rows each get their row, and rows that share a doc_id but not the text each their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, stash

SHINGLE, RADIUS, SEED, BITS = 3, 2, 42, 64
#: Lists up to this length are paired directly; longer ones are probed with the 136 ways to change two bytes by two bits.
DIRECT = 64
_CHUNK = 1 << 15

#: Similarity of texts: words of a shingle and the least Jaccard similarity; bytes of the wide fingerprint; positions of
#: a key, keys, and least bytes shared; members of a list that are compared at once and blocks that a longer list is cut
#: into at most, so that a member stands in so many cells at most; rows of a bucket; lists that are broadcast at most. Two texts of similarity s share a byte in place with probability s + (1 - s) / 256, whatever kind
#: of edit parts them, so the chance to miss a pair of 0.8 follows: about 1e-7 to share no key, 2e-8 to share too few bytes.
VERIFY, SIMILARITY = 5, 0.8
WIDE, KEY, KEYS, LEAST_SHARED = 64, 4, 48, 32
BLOCK, BLOCKS, BUCKET, BROADCAST_LISTS = 1000, 8, 5000, 1_000_000
_SPREAD = np.random.default_rng(5).integers(0, 1 << 63, (WIDE, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Every WIDE / KEY keys use each position once.
_POSITIONS = np.concatenate([np.random.default_rng(i).permutation(WIDE).reshape(-1, KEY) for i in range(KEYS * KEY // WIDE)])


def fingerprint(data: bytes | None) -> int:
    """``data`` is UTF-8; bytes.split() splits at exactly the white space that the contract names."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [h(b" ".join(words), SEED)]
    else:
        hashes = [h(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:], strict=False)]
    values = np.array(hashes, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(values), _CHUNK):
        part = np.ascontiguousarray(values[i : i + _CHUNK], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values)).tobytes(), "big")


def _fingerprints(batches):
    for b in batches:
        fps = np.array([fingerprint(t) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps.view(np.int64))], ["doc_id", "row_text", "fp"])


def row_text() -> Column:
    """Tells the texts of rows with one doc_id apart."""
    return F.xxhash64("text").alias("row_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_text and the fingerprint as a signed long; a narrow pass."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", row_text()).mapInArrow(_fingerprints, f"doc_id {kind}, row_text bigint, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame) -> DataFrame:
    """(u, v): the pairs of ``nodes`` (fp distinct, node) whose fingerprints differ in at most RADIUS bits."""
    pairs_of = list(combinations(range(8), 2))  # the two positions that may differ
    masks = [_signed((1 << 64) - 1 & ~(255 << 8 * a) & ~(255 << 8 * b)) for a, b in pairs_of]
    posting = F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("slot"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    lists = nodes.select("fp", "node", posting.alias("p")).select("fp", "node", "p.slot", "p.key")
    n = F.count("*").over(Window.partitionBy("slot", "key"))
    shared = stash(lists.withColumn("n", n).where("n > 1"), "postings")
    short, long = shared.where(F.col("n") <= DIRECT), shared.where(F.col("n") > DIRECT)
    b = lambda df: df.select("slot", "key", F.col("fp").alias("fp2"), F.col("node").alias("node2"))
    direct = short.join(b(short), ["slot", "key"]).where("fp < fp2")
    flips = []
    for x, y in pairs_of:
        bits = [1 << 8 * p + i for p in (x, y) for i in range(8)]
        flips.append([_signed(f) for f in [*bits, *(p | q for p, q in combinations(bits, 2))]])
    flip = F.explode(F.element_at(F.array(*[F.array(*map(F.lit, f)) for f in flips]), F.col("slot").cast("int") + 1))
    probe = long.select("slot", "key", "fp", "node", flip.alias("flip")).select("slot", "key", "fp", "node", F.col("fp").bitwiseXOR(F.col("flip")).alias("fp2"))
    probed = probe.where("fp < fp2").join(b(long), ["slot", "key", "fp2"])
    found = direct.select("fp", "node", "fp2", "node2").unionByName(probed.select("fp", "node", "fp2", "node2"))
    x = F.col("fp").bitwiseXOR(F.col("fp2"))
    tally = sum((x.bitwiseAND(F.lit(_signed(255 << 8 * p))) == 0).cast("int") for p in range(8))
    return found.where((tally >= 8 - RADIUS) & (F.bit_count(x) <= RADIUS)).select(F.col("node").alias("u"), F.col("node2").alias("v")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, row_text, fp and component_id (least doc_id reachable over links, itself included) for every row of ``docs``."""
    fps = stash(fingerprints(docs), "fp")
    nodes = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    comp = connected_components(links(nodes.where("node IS NOT NULL")))
    named = nodes.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "row_text", "fp", "component_id")


# --- similarity of texts -----------------------------------------------------------------------


def _shingles(words: list[bytes]) -> np.ndarray:
    """64 bits of hash of each shingle of VERIFY words; fewer words are one shingle."""
    if len(words) <= VERIFY:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED) for w in zip(*(words[i:] for i in range(VERIFY)), strict=False)], np.uint64)


def wide_fingerprint(words: list[bytes]) -> bytes:
    """WIDE bytes, each of the least of the shingles' hashes in an order of its own."""
    hashes = _shingles(words)
    least = np.full(WIDE, ~np.uint64(0))
    for i in range(0, len(hashes), 512):
        part = hashes[i : i + 512] * _SPREAD
        part ^= part >> np.uint64(31)
        part *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, part.min(axis=1))
    return (least & np.uint64(255)).astype(np.uint8).tobytes()


def _words(data: bytes | None) -> list[bytes]:
    return (data or b"").lower().split()


def _sequences(batches):
    """128 bits of hash of the words of each text and, from VERIFY words on, its wide fingerprint."""
    for b in batches:
        whole, fps = [], []
        for t in b.column(1).cast(pa.binary()).to_pylist():
            words = _words(t)
            whole.append(np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), np.int64))
            fps.append(wide_fingerprint(words) if len(words) >= VERIFY else None)
        whole = np.array(whole, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(fps, pa.binary())], ["doc_id", "row_text", "h1", "h2", "fp"])


def _bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDE)


def _postings(batches):
    """KEYS postings for each node: the place of the key and its KEY positional bytes."""
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            keys = np.ascontiguousarray(_bytes(part.column(1))[:, _POSITIONS]).view(np.uint32)[..., 0].astype(np.int64)
            keys |= np.arange(KEYS, dtype=np.int64) << 32
            node = part.column(0)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), node.take(pa.array(np.repeat(np.arange(len(node)), KEYS)))], ["key", "node"])


def _partners(fps: np.ndarray, slot: int, side: np.ndarray, own: int, other: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, those after i): the pairs of a list that share enough bytes in place and no earlier key; across two blocks if they differ."""
    for i in range(len(fps) - 1):
        same = fps[i + 1 :] == fps[i]
        found = np.flatnonzero((same.sum(axis=1) >= LEAST_SHARED) & ((side[i + 1 :] != side[i]) | (own == other)))
        if len(found):
            first = same[found][:, _POSITIONS].all(axis=2).argmax(axis=1)
            yield i, found[first == slot] + i + 1


def _lists(t: pa.Table) -> Iterator[tuple[np.ndarray, int, np.ndarray, int, int]]:
    """Rows of each cell of a bucket, with what _partners asks for."""
    key, own, other = (t[c].to_numpy() for c in ("key", "own", "other"))
    order = np.lexsort((other, own, key))
    new = np.flatnonzero(np.concatenate(([True], np.any([np.diff(x[order]) != 0 for x in (key, own, other)], axis=0))))
    for a, b in zip(new, [*new[1:], len(order)], strict=True):
        if b - a > 1:
            rows = order[a:b]
            yield rows, int(key[rows[0]] >> 32), t["side"].to_numpy()[rows], own[rows[0]], other[rows[0]]


def _tally(t: pa.Table) -> pa.Table:
    """Those members of the lists that have a partner."""
    fps, kept = _bytes(t["fp"]), []
    for rows, *cell in _lists(t):
        hit = np.zeros(len(rows), bool)
        for i, found in _partners(fps[rows], *cell):
            hit[i] |= len(found) > 0
            hit[found] = True
        kept.append(rows[hit])
    return t.take(pa.array(np.concatenate(kept) if kept else [], pa.int64()))


def _verify(t: pa.Table) -> pa.Table:
    """The pairs of a list whose sets of shingles reach SIMILARITY; pairs that others connect already are passed over."""
    fps, shingles = _bytes(t["fp"]), t["shingles"].combine_chunks()
    sets = lambda i: shingles[int(i)].values.to_numpy()
    us, vs = [], []
    for rows, *cell in _lists(t):
        group = np.arange(len(rows))
        held: dict = {}
        for i, found in _partners(fps[rows], *cell):
            a = held.setdefault(i, sets(rows[i]))
            for j in found:
                if group[i] == group[j]:
                    continue
                b = held.setdefault(int(j), sets(rows[j]))
                if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
                    continue
                n = len(np.intersect1d(a, b, assume_unique=True))
                if n >= SIMILARITY * (len(a) + len(b) - n):
                    us.append(rows[i])
                    vs.append(rows[j])
                    group[group == group[j]] = group[i]
    return pa.table({"u": t["node"].take(pa.array(us, pa.int64())), "v": t["node"].take(pa.array(vs, pa.int64()))})


def _shingle_sets(batches):
    for b in batches:
        out = []
        for t in b.column(1).cast(pa.binary()).to_pylist():
            out.append(np.unique(_shingles(_words(t))).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["node", "shingles"])


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, row_text and component_id for every row of ``docs``: components of texts whose sets of VERIFY-word shingles have a Jaccard similarity of SIMILARITY or more.

    Two differing bits are far too few for that similarity, and any SimHash of it shares too few whole
    bytes where a block of words is added, cut or replaced. The positional bytes are therefore those of
    least hashes of the same shingles that are verified. The index has a posting for each of KEYS choices
    of KEY positions; members of a list tally their shared bytes, and pairs with LEAST_SHARED are verified on their texts. No
    list is cut: one that is longer than BLOCK is compared block by block, its pairs never being rows; with at
    most BLOCKS blocks the rows grow with the list, only the comparisons inside tasks with its square. Equal sequences of words are one node. A null doc_id never names a component.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    seq = stash(docs.select("doc_id", "text", row_text()).mapInArrow(_sequences, f"doc_id {kind}, row_text bigint, h1 bigint, h2 bigint, fp binary"), "sequences")
    nodes = stash(seq.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.min("fp").alias("fp")), "nodes")
    near = nodes.where("node IS NOT NULL AND fp IS NOT NULL").select("node", "fp")
    postings = near.mapInArrow(_postings, f"key bigint, node {kind}")
    lists = stash(postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    members = postings.join(F.broadcast(lists) if lists.count() <= BROADCAST_LISTS else lists, "key").withColumn("n", F.least(F.ceil(F.col("n") / BLOCK), F.lit(BLOCKS)))
    members = members.withColumn("side", F.pmod(F.xxhash64("node"), F.col("n"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    cells = members.select("key", "node", "side", F.least("side", "o").alias("own"), F.greatest("side", "o").alias("other")).join(near, "node")
    cells = stash(cells, "cells")
    fields = f"key bigint, node {kind}, side bigint, own bigint, other bigint, fp binary"
    columns = ["key", "node", "side", "own", "other", "fp"]
    bucket = F.pmod(F.xxhash64("key", "own", "other"), F.lit(max(1, -(-cells.count() // BUCKET)))).alias("bucket")
    tallied = stash(cells.select(*columns, bucket).groupBy("bucket").applyInArrow(lambda t: _tally(t.select(columns)), fields), "tallied")
    wanted = nodes.join(tallied.select("node").distinct(), "node", "left_semi").join(seq.select("h1", "h2", F.col("doc_id").alias("node"), "row_text"), ["h1", "h2", "node"])
    wanted = stash(wanted.select(F.col("node").alias("doc_id"), "row_text").distinct(), "wanted")
    texts = docs.where("text IS NOT NULL").select("doc_id", "text", row_text()).join(wanted, ["doc_id", "row_text"], "left_semi").dropDuplicates(["doc_id", "row_text"])
    sets = texts.select("doc_id", "text").mapInArrow(_shingle_sets, f"node {kind}, shingles array<bigint>")
    asked = tallied.join(sets, "node").select(*columns, "shingles", bucket)
    links = asked.groupBy("bucket").applyInArrow(_verify, f"u {kind}, v {kind}")
    comp = connected_components(links)
    named = nodes.join(comp, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component_id"))
    return seq.select("doc_id", "row_text", "h1", "h2").join(named, ["h1", "h2"], "left").select("doc_id", "row_text", "component_id")


def _least_of_each(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """Rows with a null doc_id stay. Of rows that repeat a doc_id with the same text all stay or all go; with another text each row goes by its own."""
    gone = grouped.where("doc_id <> component_id").select("doc_id", "row_text").distinct().alias("gone_texts")
    same = (docs["doc_id"] == F.col("gone_texts.doc_id")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("gone_texts.row_text"))
    return docs.join(gone, same, "left_anti")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component of ``near_duplicates``, the row of its least doc_id."""
    return _least_of_each(docs, near_duplicates(docs))


def keep_one_similar(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component of ``similar``, the row of its least doc_id."""
    return _least_of_each(docs, similar(docs))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
