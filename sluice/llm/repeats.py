"""Removal of repeated byte strings by a distributed prefix-free parse.

Rolling hashes of 24 bytes pick triggers: in each window of 50 bytes the place of the
smallest hash. Windows with the same trigger form a phrase, so equal windows always lie in
phrases with equal triggers, and triggers that one document alone holds need no more work.
The phrases of the other triggers form a dictionary, in which each distinct phrase of a
block of documents stands once.

Two suffix orders are combined. The dictionary's suffixes are sorted on their bytes, by prefix
doubling, to the depth of 50 that decides (``suffix_order``). The parse's suffixes are sorted by
their first phrase and then by document (``parse_order``): a window never reaches past its
phrase, so no deeper order of the parse can matter. Each run of equal dictionary suffixes then
has its first place in the corpus: the least document over the heads of its phrases' parse
runs. The parse of each document says which of its windows began earlier.

Documents are dealt into blocks by hash, triggers and phrases into buckets by hash, both in
numbers that grow with the bytes. A string that very many documents hold reaches a bucket
once from each block. Places are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .wordhash import mix, powers, prefix_sums

#: Bytes of a repeated string and of a trigger, of texts for each block and each bucket, and of texts hashed at once.
LENGTH, TRIGGER = 50, 24
BLOCK_BYTES, BUCKET_BYTES, PART_BYTES = 6_000_000, 2_000_000, 400_000
#: Blocks of a task, at most about, where the session's number of partitions would give more.
BLOCKS_A_TASK = 8
_PLACES = LENGTH - TRIGGER + 1
#: Windows whose smallest hashes are found at once; with the last window's places at most 2**24.
STEP = 1 << 22
_LAST = np.iinfo(np.int64).max


def parse(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Phrases of some texts: (text, trigger hash, first window, last window, first byte of the text in all bytes, all bytes, their sums).

    Windows and bytes count from the start of the joined texts.
    """
    b = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    n = len(b) - LENGTH + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none, ends - sizes, b, np.zeros(1, np.uint64)
    sums, down = prefix_sums(b), powers(len(b))[1]
    h = mix((sums[TRIGGER:] - sums[:-TRIGGER]) * down[: len(b) - TRIGGER + 1])
    place = np.empty(n, np.int64)
    for at in range(0, n, STEP):  # places within a stretch fit the low bits of the hashes
        stop = min(at + STEP, n)
        own = h[at : stop + _PLACES - 1]
        low = (own & ~np.uint64(0xFFFFFF)) | np.arange(len(own), dtype=np.uint64)  # equal hashes: the first place
        span = 1
        while 2 * span <= _PLACES:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: stop - at], low[_PLACES - span : _PLACES - span + stop - at])
        place[at:stop] = at + (low & np.uint64(0xFFFFFF)).astype(np.int64)
    inside = np.ones(n, bool)
    for end in ends[:-1].tolist():  # windows that run over the end of a text
        inside[max(end - LENGTH + 1, 0) : end] = False
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    over = np.flatnonzero(~inside)
    stop = np.append(first[1:], n)
    if len(over):  # a phrase ends where the next begins or windows are not inside
        k = np.searchsorted(over, first)
        stop = np.minimum(stop, np.where(k < len(over), over[np.minimum(k, len(over) - 1)], n))
    return np.searchsorted(ends, first, side="right"), h[place[first]], first, stop - 1, ends - sizes, b, sums


def parts(rows: pa.Table) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(places, texts) of the rows of a block, in parts of bounded bytes or of one text."""
    places: list[int] = []
    texts: list[bytes] = []
    held = 0
    for i, text in enumerate(rows["text"]):
        raw = (text.as_py() or "").encode("utf-8", "replace")
        if texts and held + len(raw) > PART_BYTES:
            yield np.array(places), texts
            places, texts, held = [], [], 0
        places.append(i)
        texts.append(raw)
        held += len(raw)
    if texts:
        yield np.array(places), texts


def ids_of(rows: pa.Table) -> np.ndarray:
    """doc_ids; a row without one comes after all others."""
    return np.array([_LAST if x is None else x for x in rows["doc_id"].to_pylist()], np.int64)


def short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(16)


def pack(h: np.ndarray) -> bytes:
    """48-bit hashes in six bytes each."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def squeeze(values: np.ndarray) -> bytes:
    """Values for a shuffle: their number of bytes, then the bytes in the zstd format."""
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def expand(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets that occur, each with the places of its values."""
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.append(True, buckets[order][1:] != buckets[order][:-1])) if len(order) else order
    for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(buckets[order[lo]]), order[lo:hi]


def phrase_ids(b: np.ndarray, sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """128 bits for each phrase, as two rows, from the bytes and their ``prefix_sums``."""
    size, down = last - first + LENGTH, powers(len(b))[1]
    each = [(x[first + size] - x[first]) * down[first] for x in (sums, prefix_sums(b, True))]
    return np.stack([mix(h + size.astype(np.uint64)) for h in each])


def parse_order(phrases: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of a parse's entries by phrase (128 bits) and then document, and where each phrase's run begins in it."""
    order = np.lexsort((docs, phrases[1], phrases[0]))
    own = phrases[:, order]
    return order, np.flatnonzero(np.append(True, (own[:, 1:] != own[:, :-1]).any(0))) if len(order) else order


def suffix_order(b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``starts`` by their first LENGTH bytes, and where each run of equal ones begins in it.

    Ranks of 8, 16 and 32 bytes come from sorting pairs of ranks of half the depth; ranks of
    32 bytes at a suffix and 18 bytes on cover all 50. The bytes decide, no hash.
    """
    n = len(b) - 7
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | b[i : n + i]
    for depth in (8, 16, 32):
        order = np.argsort(key)
        rank = np.empty(len(key), np.uint64)
        rank[order] = np.cumsum(np.append(False, key[order][1:] != key[order][:-1]), dtype=np.uint64)
        if depth < 32:
            key = rank[:-depth] << np.uint64(32) | rank[depth:]
    key = rank[starts] << np.uint64(32) | rank[starts + LENGTH - 32]
    order = np.argsort(key)
    return order, np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))


def lookup(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each wanted phrase (128 bits) its place among the known ones, or -1."""
    out = np.full(wanted.shape[1], -1)
    order = np.lexsort((known[1], known[0]))
    own = known[:, order]
    at = np.searchsorted(own[0], wanted[0])
    while len(order):  # once, unless two known phrases agree in their first 64 bits
        place = np.minimum(at, len(order) - 1)
        same = (at < len(order)) & (own[0, place] == wanted[0])
        hit = same & (own[1, place] == wanted[1])
        out[hit] = order[place[hit]]
        if not (same & ~hit & (out < 0)).any():
            break
        at = at + (same & ~hit)
    return out


def gather(b: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    offsets = np.cumsum(sizes) - sizes
    return b[np.repeat(starts - offsets, sizes) + np.arange(sizes.sum())]


def without_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) for every row of ``documents`` (doc_id, text).

    Bytes covered by a LENGTH-byte string that also starts in a document of a smaller doc_id
    are removed. Null and empty texts, and those shorter than LENGTH, lose nothing; rows of
    equal doc_id do not remove each other; rows without doc_id come after all others and do
    not remove each other either. Very long texts are one part of a block; other columns are
    not read; an empty table gives an empty one.
    """
    total = documents.agg(F.sum(F.octet_length("text")).alias("n")).head()["n"] or 0
    n_blocks, n_buckets = 1 + total // BLOCK_BYTES, 1 + total // BUCKET_BYTES
    wide = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).alias("block"))
    if n_blocks // BLOCKS_A_TASK > wide:  # tasks stay as large as they are, whatever the input
        docs = docs.repartition(n_blocks // BLOCKS_A_TASK, "block")
    grouped = docs.groupBy("block")

    def dealt(rows: DataFrame, key: str, groups: int) -> DataFrame:
        return rows.repartition(groups, key) if groups > wide else rows

    def triggers(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ids, hashes, owners = ids_of(rows), [], []
        for places, texts in parts(rows):
            owner, h, *_ = parse(texts)
            hashes.append(short(h))
            owners.append(ids[places[owner]] if len(owner) else np.zeros(0, np.int64))
        h, d = np.concatenate(hashes), np.concatenate(owners)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, int)
        ends = np.append(starts[1:], len(h))
        several = d[starts] != d[ends - 1] if len(h) else np.zeros(0, bool)
        h = h[starts]
        out = [(key[0].as_py(), k, pack(h[own]), np.packbits(several[own]).tobytes()) for k, own in by_bucket((h % np.uint64(n_buckets)).astype(np.int64))]
        return pa.table(dict(zip(("block", "bucket", "hashes", "several"), zip(*out, strict=True) if out else ([],) * 4, strict=True)), schema=pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("several", pa.binary())]))

    def shared(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        blocks, each = rows["block"].to_pylist(), [unpack(x) for x in rows["hashes"].to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool) for x, h in zip(rows["several"].to_pylist(), each, strict=True)]
        h = np.sort(np.concatenate(each))
        again = np.unique(np.concatenate([h[1:][h[1:] == h[:-1]], *[x[s] for x, s in zip(each, several, strict=True)]]))
        found = [x[np.isin(x, again, assume_unique=True)] for x in each]
        kept = [(b, pack(x)) for b, x in zip(blocks, found, strict=True) if len(x)]
        return pa.table({"block": pa.array([b for b, _ in kept], pa.int64()), "hashes": pa.array([x for _, x in kept], pa.binary())})

    def phrases(key: tuple[pa.Scalar, ...], rows: pa.Table, flags: pa.Table) -> pa.Table:
        names = ("block", "bucket", "phrases", "sizes", "lowest", "several")
        schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), *[(x, pa.binary()) for x in names[2:]]])
        flagged = np.sort(np.concatenate([np.zeros(0, np.uint64), *[unpack(x) for x in flags["hashes"].to_pylist()]]))
        ids, out = ids_of(rows), []
        if not len(flagged) or not rows.num_rows:
            return schema.empty_table()
        ids_in, owners, triggers_in, bytes_in, sizes = [], [], [], [], []
        for places, texts in parts(rows):
            owner, h, first, last, _, b, sums = parse(texts)
            at = np.searchsorted(flagged, short(h))
            own = flagged[np.minimum(at, len(flagged) - 1)] == short(h)
            if not own.any():
                continue
            owner, h, first, last = owner[own], h[own], first[own], last[own]
            phrase = phrase_ids(b, sums, first, last)
            docs_of = ids[places[owner]]
            order, starts = parse_order(phrase, docs_of)
            one = order[starts]  # a phrase of this part stands once, with the ends of its parse run
            sizes.append(last[one] - first[one] + LENGTH)
            bytes_in.append(gather(b, first[one], sizes[-1]))
            triggers_in.append(short(h[one]))
            ids_in.append(phrase[:, one])
            owners.append((docs_of[one], docs_of[order[np.append(starts[1:], len(order)) - 1]]))
        if not ids_in:
            return schema.empty_table()
        phrase, low, high = np.concatenate(ids_in, 1), np.concatenate([x for x, _ in owners]), np.concatenate([x for _, x in owners])
        order, starts = parse_order(phrase, low)
        one = order[starts]
        lowest, several = low[one], np.maximum.reduceat(high[order], starts) != low[one]
        size = np.concatenate(sizes)
        b, size = gather(np.concatenate(bytes_in), (np.cumsum(size) - size)[one], size[one]), size[one]
        bucket = (np.concatenate(triggers_in)[one] % np.uint64(n_buckets)).astype(np.int64)
        begin = np.cumsum(size) - size
        for k, own in by_bucket(bucket):
            out.append((key[0].as_py(), k, squeeze(gather(b, begin[own], size[own])), squeeze(size[own].astype(np.uint8)), squeeze(lowest[own]), np.packbits(several[own]).tobytes()))
        return pa.table(dict(zip(names, zip(*out, strict=True), strict=True)), schema=schema)

    def earliest(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        col = {k: [expand(x) for x in rows[k].to_pylist()] for k in ("phrases", "sizes", "lowest")}
        b = np.frombuffer(b"".join(col["phrases"]), np.uint8)
        size = np.frombuffer(b"".join(col["sizes"]), np.uint8).astype(np.int64)
        lowest = np.frombuffer(b"".join(col["lowest"]), np.int64)
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(n)).astype(bool) for x, n in zip(rows["several"].to_pylist(), col["sizes"], strict=True)])
        begin = np.cumsum(size) - size
        phrase = np.empty((2, len(size)), np.uint64)
        for i in range(0, len(size), 20_000):  # the sums take eight times the bytes
            lo, hi = begin[i], begin[i + 20_000] if i + 20_000 < len(size) else len(b)
            own = slice(i, i + 20_000)
            phrase[:, own] = phrase_ids(b[lo:hi], prefix_sums(b[lo:hi]), begin[own] - lo, begin[own] + size[own] - LENGTH - lo)
        by_phrase, heads = parse_order(phrase, lowest)  # a phrase of several blocks stands once, with its least document
        one = by_phrase[heads]
        entry = np.empty(len(size), np.int64)
        entry[by_phrase] = np.repeat(np.arange(len(one)), np.diff(np.append(heads, len(size))))
        b, least_of = gather(b, begin[one], size[one]), lowest[one]
        windows = size[one] - LENGTH + 1
        owner = np.repeat(np.arange(len(one)), windows)
        at, offset = np.cumsum(size[one]) - size[one], np.cumsum(windows) - windows
        order, runs = suffix_order(b, at[owner] + np.arange(len(owner)) - offset[owner])
        least = np.minimum.reduceat(least_of[owner][order], runs)
        first = np.empty(len(owner), np.int64)
        first[order] = np.repeat(least, np.diff(np.append(runs, len(order))))
        useful = several | (np.minimum.reduceat(first, offset)[entry] < lowest)
        out, done = [], 0
        for block, raw in zip(rows["block"].to_pylist(), col["sizes"], strict=True):
            own = np.arange(done, done + len(raw))[useful[done : done + len(raw)]]
            done += len(raw)
            if len(own):
                each = entry[own]
                out.append((block, np.ascontiguousarray(phrase[:, own].T).tobytes(), windows[each].astype(np.uint8).tobytes(), gather(first, offset[each], windows[each]).tobytes()))
        return pa.table({k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate((("block", pa.int64()), ("ids", pa.binary()), ("windows", pa.binary()), ("firsts", pa.binary())))})

    def cut(key: tuple[pa.Scalar, ...], rows: pa.Table, marks: pa.Table) -> pa.Table:
        phrase = np.frombuffer(b"".join(marks["ids"].to_pylist()), np.uint64).reshape(-1, 2).T
        windows = np.frombuffer(b"".join(marks["windows"].to_pylist()), np.uint8).astype(np.int64)
        firsts = np.frombuffer(b"".join(marks["firsts"].to_pylist()), np.int64)
        offset = np.cumsum(windows) - windows
        ids, kept, sizes, removed, spans = ids_of(rows), [], [], [], []
        for places, texts in parts(rows):
            owner, _, first, last, begin, b, sums = parse(texts)
            gone = np.zeros(len(b), bool)
            if phrase.shape[1] and len(first):
                at = lookup(phrase, phrase_ids(b, sums, first, last))
                hit = np.flatnonzero(at >= 0)
                count = windows[at[hit]]
                start = np.repeat(first[hit] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                covered = gather(firsts, offset[at[hit]], count) < np.repeat(ids[places[owner[hit]]], count)
                steps = np.zeros(len(b) + 1, np.int32)
                np.add.at(steps, start[covered], 1)
                np.add.at(steps, start[covered] + LENGTH, -1)
                gone = np.cumsum(steps[:-1]) > 0
            for lo, text in zip(begin.tolist(), texts, strict=True):
                own = gone[lo : lo + len(text)]
                sizes.append(len(text))
                removed.append(int(own.sum()))
                spans.append(int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if len(own) else 0)
                kept.append(b[lo : lo + len(text)][~own].tobytes() if removed[-1] else text)
        return pa.table({"doc_id": rows["doc_id"], "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    found = dealt(grouped.applyInArrow(triggers, "block long, bucket long, hashes binary, several binary"), "bucket", n_buckets // (3 * BLOCKS_A_TASK)).groupBy("bucket").applyInArrow(shared, "block long, hashes binary")
    listed = grouped.cogroup(found.groupBy("block")).applyInArrow(phrases, "block long, bucket long, phrases binary, sizes binary, lowest binary, several binary")
    marks = dealt(listed, "bucket", n_buckets // (3 * BLOCKS_A_TASK)).groupBy("bucket").applyInArrow(earliest, "block long, ids binary, windows binary, firsts binary")
    return grouped.cogroup(marks.groupBy("block")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed bytes of every document; the cases are those of ``without_repeats``."""
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
