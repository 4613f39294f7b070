"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

0. Texts that are equal are one text; from LENGTH bytes on the later ones go whole.
1. Anchors: the k-grams with the least hash in some string of LENGTH bytes. Equal strings choose equal
   anchors, so what repeats lies in the windows around anchors that occur twice or more. Of equal anchors
   in a row (runs, short periods) only so many are taken that every string holds one. Counting anchors
   needs only (hash, count), combined before the shuffle; the anchors that repeat are then joined.
2. Windows with the same content are represented by the first of them; in the others every byte is covered.
3. Windows that share an anchor but differ are cut into buckets. Where more than VARIANTS share one, they
   are told apart by more context: a window is halved into the strings that begin nearer to the anchor and
   those that begin farther, each with all the bytes that its strings have in common as its new anchor;
   halves with the same bytes are one again. After six halvings a window is one string, so no bucket is
   larger than VARIANTS allows, whatever the data.
4. In a bucket each shard of windows gets its own transform; the transforms are merged by refining their
   interleave, a few symbols of context a round. After LENGTH symbols the blocks of the interleave are the
   intervals of suffixes with a common prefix of LENGTH; no suffixes are compared or sorted across shards.
5. Intervals are united for each document by window functions before they are gathered.

Edge cases: null texts are empty; texts below LENGTH bytes have nothing to remove; rows with a null
doc_id come back whole and match nothing; rows that repeat a doc_id and its text count as one document; of
different texts with one doc_id that with the least hash is its document, and the others come back whole
and match nothing; an empty table gives no rows; other columns are ignored. Very long texts go by in chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, stash

LENGTH, GRAM = 100, 40
#: Windows for a bucket on average and shards in it; different windows of one anchor that go to one bucket at most.
BUCKET, SHARDS, VARIANTS = 2_000, 4, 2_000
#: Document ids up to this number are broadcast to pick the texts that are needed; more are joined.
BROADCAST_IDS = 2_000_000
_SPAN = LENGTH - GRAM + 1
_CHUNK, _MARGIN = 1 << 21, 2 * LENGTH
_SEEDS = np.random.default_rng(20240611)
_TABLES = _SEEDS.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for b in (_BASE, _BASE_INV):
            factors = np.full(size, b, np.uint64)
            factors[0] = 1
            _powers.append(np.cumprod(factors, dtype=np.uint64))
        del _powers[:-2]
    return _powers


def _prefix(b: np.ndarray, table: int = 0) -> np.ndarray:
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_TABLES[table][b] * _power_tables(len(b) + 1)[0][: len(b)], out=out[1:])
    return out


def _hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _mix((prefix[end] - prefix[start]) * _powers[1][start])


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width] for each i."""
    step = 1
    while 2 * step <= width:
        x = op(x[:-step], x[step:])
        step *= 2
    return op(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def _anchors_of(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of a piece, their hashes, and prefix hashes of the piece."""
    prefix = _prefix(b)
    n = len(b) - GRAM + 1
    pos = np.arange(n)
    gram = _mix((prefix[GRAM:] - prefix[:n]) * _powers[1][:n])
    least = _slide(gram, _SPAN, np.minimum)
    pad = np.zeros(_SPAN - 1, np.uint64)
    chosen = _slide(np.concatenate((pad, least, pad)), _SPAN, np.maximum) == gram
    pos = pos[chosen]
    return pos, gram[chosen], prefix


def _enough(pos: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of candidates those to take, and whether each lies within _SPAN of an equal one.

    Among equal ones at most _SPAN - 1 apart the first, the last and so many between them are taken that two in a row
    are never more than _SPAN apart: a string that holds one of them then holds one that is taken.
    """
    order = np.lexsort((pos, gram))
    p, g = pos[order], gram[order]
    joined = (g[1:] == g[:-1]) & (np.diff(p) < _SPAN)
    group = np.concatenate(([0], np.cumsum(~joined)))
    size = np.bincount(group)
    take = np.ones(len(p), bool)
    ends = np.cumsum(size)
    for i in np.flatnonzero(size > 2):
        a, b = ends[i] - size[i], ends[i]
        take[a:b] = False
        at = a
        while at < b:
            take[at] = True
            at = max(at + 1, a + int(np.searchsorted(p[a:b], p[at] + _SPAN, side="right")) - 1)
        take[b - 1] = True
    near = np.concatenate((joined, [False])) | np.concatenate(([False], joined))
    order, near = order[take], near[take]
    back = np.argsort(order)
    return order[back], near[back]


def anchors(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, window hash, window start, place of the anchor in it, its size, whether the anchor repeats in it) of a document, chunk by chunk."""
    n = len(data)
    if n < LENGTH:
        return
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, n, _CHUNK):
        lo, hi = max(0, at - _MARGIN), min(n, at + _CHUNK + _MARGIN)
        if hi - lo < LENGTH:
            continue
        pos, gram, prefix = _anchors_of(whole[lo:hi])
        own = (pos + lo >= at) & (pos + lo < at + _CHUNK)
        pos, gram = pos[own], gram[own]
        if not len(pos):
            continue
        taken, near = _enough(pos, gram)
        pos, gram = pos[taken], gram[taken]
        start, end = np.maximum(pos - (LENGTH - GRAM), 0), np.minimum(pos + LENGTH, hi - lo)
        yield gram.view(np.int64), _hashes(prefix, start, end).view(np.int64), start + lo, (pos - start).astype(np.int16), (end - start).astype(np.int16), near


def _binary(col) -> list[bytes | None]:
    return col.cast(pa.binary()).to_pylist()


def _merged(parts: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in parts]) if parts else [], t) for i, t in enumerate(types)], names)


_WINDOWS = "anchor bigint, content bigint, doc_id bigint, start bigint, left smallint, size smallint, self boolean"


def _window_rows(batches):
    names, types = [x.split()[0] for x in _WINDOWS.split(", ")], [pa.int64()] * 4 + [pa.int16()] * 2 + [pa.bool_()]
    for b in batches:
        parts, held = [], 0
        for doc, data in zip(b.column(0).to_pylist(), _binary(b.column(1)), strict=True):
            for gram, content, *rest in anchors(data or b""):
                parts.append((gram, content, np.full(len(gram), doc, np.int64), *rest))
                held += len(gram)
                if held > 100_000:
                    yield _merged(parts, names, types)
                    parts, held = [], 0
        if parts:
            yield _merged(parts, names, types)


def _batched_counts(batches):
    """Anchors and how often they occur, combined within some documents already."""

    def out(parts):
        gram, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], ["anchor", "n"])

    for b in batches:
        parts, held = [], 0
        for data in _binary(b.column(0)):
            for gram, *_ in anchors(data or b""):
                parts.append(gram)
                held += len(gram)
                if held > 200_000:
                    yield out(parts)
                    parts, held = [], 0
        if parts:
            yield out(parts)


# --- transforms ---------------------------------------------------------------------------------


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, Burrows-Wheeler transform, last-to-first mapping) of a shard, by growing prefixes.

    Symbols are bytes plus one, 0 ends a string; the ends are distinct and in the order of the strings.
    """
    text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8) + np.uint8(1)  # UTF-8 has no byte 255: ends become 0
    n = len(text)
    ends = text == 0
    rank = text.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(ends.sum())
    step = 1
    while True:
        size = int(rank.max()) + 1
        parts = max(2, min(4, 63 // size.bit_length()))  # as many ranks as a key of 63 bits holds
        key = rank.copy()
        for i in range(1, parts):
            key *= size
            if i * step < n:
                key[: n - i * step] += rank[i * step :]  # past an end of string nothing counts: its rank is its own
        order = np.argsort(key)
        sorted_ = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([0], sorted_[1:] != sorted_[:-1])))
        if new[order[-1]] == n - 1:
            break
        rank, step = new, step * parts
    before = np.concatenate((text[-1:], text[:-1]))
    bwt = before[order]
    return order, bwt, new[order - 1]


def _stride(symbols: np.ndarray, grow: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray] | None:
    """For each row the rank of the ``width`` symbols before it, the farthest counting most, and the row they lead to.

    0 where an end of string is among them; None if the ranks do not fit 16 bits, which a counting sort takes.
    """
    code, at = symbols.astype(np.uint32), grow
    inside = symbols > 0
    for i in range(1, width):
        c = symbols[at]
        inside &= c > 0
        code |= c.astype(np.uint32) << np.uint32(8 * i)
        at = grow[at]
    code[~inside] = 0
    if width > 2:
        found, code = np.unique(code, return_inverse=True)
        if len(found) > 1 << 16:
            return None
        if found[0] != 0:
            if len(found) == 1 << 16:
                return None
            code += 1
    return code.astype(np.uint8 if width == 1 else np.uint16), at


def merge(transforms: list[np.ndarray], steps: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the merged transform that share ``length`` symbols with another row, in merged order, and their blocks.

    A row is numbered through the shards' transforms one after the other; the sequence of rows is the
    interleave. A round moves each row by the last-to-first mapping of its shard to the suffix that is a
    few symbols longer and places it by those symbols, keeping the order among equal ones: so the interleave
    of suffixes by ``h`` symbols becomes that by ``h + width``, and a block splits by its symbols. A row
    alone in its block stays alone when it grows, so it leaves; a suffix never grows over the end of its string.
    """
    offset = np.cumsum([0, *(len(t) for t in transforms[:-1])])
    symbols = np.concatenate(transforms)
    grow = np.concatenate([s + o for s, o in zip(steps, offset, strict=True)]).astype(np.int32)
    width = next(w for w in (4, 2, 1) if w <= max(1, length) and (stride := _stride(symbols, grow, w)) is not None)
    rounds = [stride] * (length // width) + [_stride(symbols, grow, 1)] * (length % width)
    rows = np.arange(len(symbols), dtype=np.int32)
    block = np.zeros(len(rows), np.int32)
    for code, to in rounds:
        c = code[rows]
        order = np.argsort(c, kind="stable")
        order = order[np.searchsorted(c, 1, sorter=order) :]
        c, rows, block = c[order], to[rows[order]], block[order]
        if not len(rows):
            break
        new = np.empty(len(rows), bool)
        new[0] = True
        np.not_equal(c[1:], c[:-1], out=new[1:])
        new[1:] |= block[1:] != block[:-1]
        keep = np.ones(len(new), bool)
        keep[-1] = ~new[-1]
        keep[:-1] = ~(new[:-1] & new[1:])
        block = np.cumsum(new, dtype=np.int32)[keep]
        rows = rows[keep]
    return rows, block


def repeats(strings: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int = LENGTH, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of every string of ``length`` bytes within ``strings`` that also starts earlier."""
    shards = max(1, min(shards, len(strings)))
    cuts = [len(strings) * i // shards for i in range(shards + 1)]
    transforms, steps, owner, place = [], [], [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = strings[a:b]
        order, bwt, step = transform(part)
        size = np.array([len(s) + 1 for s in part])
        first = np.cumsum(size) - size
        transforms.append(bwt)
        steps.append(step)
        owner.append(np.repeat(docs[a:b], size)[order])
        place.append((np.repeat(starts[a:b] - first, size) + np.arange(size.sum()))[order])
    rows, block = merge(transforms, steps, length)
    owner, place = np.concatenate(owner)[rows], np.concatenate(place)[rows]
    if not len(rows):
        return owner, place
    order = np.lexsort((place, owner, block))
    block, owner, place = block[order], owner[order], place[order]
    head = np.concatenate(([True], block[1:] != block[:-1]))
    at = np.maximum.accumulate(np.where(head, np.arange(len(block)), 0))
    later = (owner != owner[at]) | (place != place[at])
    return owner[later], place[later]


def _cover(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of intervals per document."""
    if not len(docs):
        return docs, starts, ends
    order = np.lexsort((starts, docs))
    docs, starts, ends = docs[order], starts[order], ends[order]
    new_doc = np.concatenate(([True], docs[1:] != docs[:-1]))
    group = np.cumsum(new_doc)
    shift = group.astype(np.int64) * (int(ends.max()) + 2)  # keeps documents apart
    reach = np.maximum.accumulate(ends + shift)
    new = np.concatenate(([True], (starts + shift)[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(docs) - 1]))
    return docs[first], starts[first], reach[last] - shift[last]


_REMOVED = "doc_id bigint, start bigint, end bigint"


def _merge_bucket(t: pa.Table) -> pa.Table:
    docs, starts = t["doc_id"].to_numpy(), t["start"].to_numpy()
    order = np.lexsort((starts, docs))
    strings = t["bytes"].to_pylist()
    docs, starts = repeats([strings[i] for i in order], docs[order], starts[order])
    docs, starts, ends = _cover(docs, starts, starts + LENGTH)
    return pa.table({"doc_id": pa.array(docs, pa.int64()), "start": pa.array(starts, pa.int64()), "end": pa.array(ends, pa.int64())})


_CUTS = "bucket bigint, key bigint, doc_id bigint, start bigint, left smallint, bytes binary"
_CUT_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.binary())


def _cut_rows(rows: list[tuple]):
    for i in range(0, len(rows), 20_000):
        cols = list(zip(*rows[i : i + 20_000], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _CUT_TYPES, strict=True)], [x.split()[0] for x in _CUTS.split(", ")])


def _cut(batches):
    """The bytes of the windows that are asked for. Those of one bucket that overlap come as one piece; windows without a bucket stay as they are, with the anchor as key."""
    for b in batches:
        rows: list[tuple] = []
        for doc, data, wanted in zip(b.column(0).to_pylist(), _binary(b.column(1)), b.column(2).to_pylist(), strict=True):
            last = None
            for w in sorted(wanted, key=lambda w: (w["bucket"] is None, w["bucket"] or 0, w["start"], w["size"])):
                start, end = w["start"], w["start"] + w["size"]
                if w["bucket"] is None:
                    rows.append((None, w["anchor"], doc, start, w["left"], data[start:end]))
                elif last and last[0] == w["bucket"] and start <= last[2]:
                    last[2] = max(end, last[2])
                else:
                    if last:
                        rows.append((last[0], None, doc, last[1], None, data[last[1] : last[2]]))
                    last = [w["bucket"], start, end]
            if last:
                rows.append((last[0], None, doc, last[1], None, data[last[1] : last[2]]))
        yield from _cut_rows(rows)


def _places(data: bytes, left: int) -> list[int]:
    """All places of an anchor in its window, those passed over in a run too: equal strings then have one at the same distance."""
    gram, out = data[left : left + GRAM], []
    at = data.find(gram)
    while at >= 0:
        out.append(at)
        at = data.find(gram, at + 1)
    return out


def _halves(lo: int, hi: int):
    """The windows of strings that begin ``lo`` to ``hi`` bytes before their anchor, halved; the key is a hash of what a half's strings share."""
    cuts = [(lo, (lo + hi) // 2), ((lo + hi) // 2 + 1, hi)] if lo < hi else [(lo, hi)]

    def run(batches):
        for b in batches:
            rows = []
            for key, doc, start, left, data in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True):
                for at in _places(data, left) if (lo, hi) == (0, _SPAN - 1) else (left,):
                    for a, z in cuts:
                        s, e = max(0, at - z), min(len(data), at - a + LENGTH)
                        if e - s >= LENGTH:
                            shared = hashlib.blake2b(b"%d %d " % (key, a) + data[at - a : at - z + LENGTH], digest_size=8).digest()
                            rows.append((a, int.from_bytes(shared, "big", signed=True), doc, start + s, at - s, data[s:e]))
            yield from _cut_rows(rows)

    return run


def _split(hot: DataFrame, buckets: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(pieces for buckets, removed intervals) of windows whose anchors have too many of them. The column bucket tells the halves apart until they have one."""
    pieces, removed = [], []
    spans = [(0, _SPAN - 1)]
    while True:
        halves = [hot.where(f"bucket <=> {lo}" if len(spans) > 1 else "true").mapInArrow(_halves(lo, hi), _CUTS) for lo, hi in spans]
        level = halves[0]
        for h in halves[1:]:
            level = level.unionByName(h)
        level = stash(level, "halves")
        spans = [c for lo, hi in spans for c in ([(lo, (lo + hi) // 2), ((lo + hi) // 2 + 1, hi)] if lo < hi else [(lo, hi)])]
        first = stash(level.groupBy("bucket", "key", "bytes").agg(F.min(F.struct("doc_id", "start", "left")).alias("f"), F.count("*").alias("n")), "halves")
        again = level.join(first.where("n > 1").select("key", "bytes", F.col("f.doc_id").alias("d"), F.col("f.start").alias("s")), ["key", "bytes"])
        removed.append(again.where("doc_id <> d OR start <> s").select("doc_id", "start", (F.col("start") + F.octet_length("bytes")).alias("end")))
        kinds = first.groupBy("key").agg(F.count("*").alias("variants"))
        single = max(hi - lo for lo, hi in spans) == 0
        kept = first.join(kinds, "key").select("bucket", "key", "f.*", "bytes", "variants")
        pieces.append(kept.where(f"variants <= {VARIANTS}").select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "doc_id", "start", "bytes"))
        hot = stash(kept.where(f"variants > {VARIANTS}").drop("variants"), "hot")
        if single or not hot.take(1):
            return pieces, removed


def with_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with distinct ids that are broadcast if few."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def text_key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def removed_intervals(src: DataFrame) -> DataFrame:
    """(doc_id, start, end): byte intervals, overlapping, whose union is to be removed from different texts (doc_id, text), each with an id of its own."""
    repeated = src.select("text").mapInArrow(_batched_counts, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    repeated = stash(repeated, "repeated")  # read plainly, so that a hot anchor's windows can be split in the join
    windows = stash(src.mapInArrow(_window_rows, _WINDOWS).join(repeated, "anchor", "left_semi"), "windows")
    first = windows.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "start", "left", "size", "self")).alias("first"), F.count("*").alias("n"))
    first = stash(first, "first")
    twice = first.where("n > 1").select("anchor", "content", "n", F.col("first.doc_id").alias("d"), F.col("first.start").alias("s"))
    both = lookup(windows, twice, ["anchor", "content"])
    copies = both.where("doc_id <> d OR start <> s").select("doc_id", "start", (F.col("start") + F.col("size")).alias("end"))
    differing = first.groupBy("anchor").agg(F.count("*").alias("variants"), F.max("first.self").alias("self")).where("variants > 1 OR self").select("anchor", "variants")
    wanted = stash(first.join(differing, "anchor").select("anchor", "variants", "first.*"), "wanted")
    buckets = max(1, -(-wanted.count() // BUCKET))
    bucket = F.when(F.col("variants") <= VARIANTS, F.pmod(F.xxhash64("anchor"), F.lit(buckets))).alias("bucket")
    wanted = stash(wanted.groupBy("doc_id").agg(F.collect_list(F.struct(bucket, "anchor", "start", "left", "size")).alias("wanted")), "wanted")  # anchors of one text
    once = with_ids(src, wanted.select("doc_id"), "left_semi").join(wanted, "doc_id")
    cut = stash(once.select("doc_id", "text", "wanted").mapInArrow(_cut, _CUTS), "cut")
    out, pieces = [copies], [cut.where("bucket IS NOT NULL").select("bucket", "doc_id", "start", "bytes")]
    hot = cut.where("bucket IS NULL")
    if hot.take(1):
        more, gone = _split(hot, buckets)
        pieces, out = pieces + more, out + gone
    whole = pieces[0]
    for p in pieces[1:]:
        whole = whole.unionByName(p)
    out.append((stash(whole, "pieces") if len(pieces) > 1 else whole).groupBy("bucket").applyInArrow(_merge_bucket, _REMOVED))
    removed = out[0]
    for df in out[1:]:
        removed = removed.unionByName(df)
    return stash(removed, "removed")


def united(intervals: DataFrame) -> DataFrame:
    """(doc_id, start, end): the unions of overlapping or touching intervals."""
    by = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = intervals.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("long"))
    return new.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def _remove(batches):
    for b in batches:
        out = []
        for data, spans in zip(_binary(b.column(1)), b.column(2).to_pylist(), strict=True):
            data = data or b""
            kept, at, removed, n = hashlib.sha256(), 0, 0, 0
            text = []
            for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
                if s > at or n == 0:
                    text.append(data[at:s])
                    removed += e - s
                    n += 1
                    at = e
                elif e > at:
                    removed += e - at
                    at = e
            text.append(data[at:])
            for part in text:
                kept.update(part)
            out.append((len(data), removed, n, kept.hexdigest(), b"".join(text)))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary) for every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    long = rows.where("doc_id IS NOT NULL AND octet_length(text) >= %d" % LENGTH)
    texts = stash(long.select("doc_id", text_key().alias("key"), F.octet_length("text").cast("long").alias("n")).groupBy("doc_id").agg(F.min(F.struct("key", "n")).alias("t")).select("doc_id", "t.*"), "texts")
    owners = stash(texts.groupBy("key").agg(F.min("doc_id").alias("owner"), F.max("n").alias("n")), "owners")
    copies = texts.select("doc_id", "key").join(owners, "key").where("doc_id <> owner").select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))
    copies = stash(copies, "copies")
    src = with_ids(long, copies.select("doc_id"), "left_anti")
    clash = stash(long.select("doc_id", text_key().alias("key")).distinct().join(texts, ["doc_id", "key"], "left_anti").select("doc_id").distinct(), "clash")
    if clash.take(1):
        own = texts.select("doc_id", "key")
        src = src.withColumn("key", text_key()).join(own, ["doc_id", "key"], "left_semi").drop("key")
    removed = removed_intervals(src)
    spans = united(removed).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = spans.unionByName(copies.select("doc_id", F.array(F.struct("start", "end")).alias("spans"))).join(texts.select("doc_id", "key"), "doc_id")
    spans = stash(spans, "spans")
    ids = spans.select("doc_id")
    touched = with_ids(rows, ids, "left_semi").join(spans, "doc_id").select("doc_id", "text", F.when(text_key() == F.col("key"), F.col("spans")).alias("spans"))
    changed = touched.mapInArrow(_remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    data = F.col("text").cast("binary")
    zero = F.lit(0).cast("long")
    same = with_ids(rows, ids, "left_anti").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(data, 256).alias("kept_sha256"), data.alias("kept"))
    return changed.unionByName(same)
