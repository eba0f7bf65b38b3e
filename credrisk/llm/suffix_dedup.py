"""Suffix-array dedup: remove every byte that a long enough earlier match covers.

A byte goes if a string of ``length`` bytes covering it also starts in a document
with a smaller id; the first copy stays.  Whole corpora don't fit one suffix array,
so the windows (strings of ``length`` bytes) are first brought together by content:

1. Documents are packed into blocks and written once, bucketed by block, so that
   later joins with the blocks don't move the texts again.
2. The minimum hash of the 24-byte grams in a window is its anchor.  Runs of windows
   with one anchor are a unit.  Anchors are exchanged by hash, one packed row per
   block and hash bucket; an anchor that two documents hold sends a bit back.
3. For those, a hash of the unit's whole text and its smallest document are exchanged.
   Equal units are a class.  The block that holds a class's smallest document sends the
   text, if other documents hold it too or if the anchor stands in other surroundings
   as well; for all other copies of the class the hash stands for the text.
4. The texts meet in their anchor's bucket.  A class that later documents share stands there
   twice, under its smallest document and under the next.  The suffixes of all texts are
   sorted; the previous and next smaller document in suffix order give the longest
   earlier match of each (its longest previous factor, counted up to ``length``); a bit per window
   goes back, for the smallest document of a class and for its later ones.

An anchor that very many units have is hot; its units would all meet in one bucket.  Their
classes are dealt by their text's hash in steps 3 and 4, and their single windows by the
window's hash, once per block with the smallest document.

Equal units of a block are merged before each exchange, so a passage that a third of
the documents share costs a bucket one entry per block and one text in all.  Which copies are of
one class, and which windows of one block are equal, rests on 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .common import materialise

GRAM = 24
SLAB = 1 << 17
NEVER = np.iinfo(np.int64).max
M1, M2, M3, M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
S32, S29 = np.uint64(32), np.uint64(29)
PACKED = "bucket long, block string, payload binary"


def words8(data: bytes, order: str = "<u8") -> np.ndarray:
    """The 8 bytes at every offset as one integer (a view, nothing is copied)."""
    return np.ndarray((max(0, len(data) - 7),), dtype=order, buffer=data, strides=(1,))


class Block:
    """Texts of some documents in one buffer, with their windows grouped into units."""

    def __init__(self, ids: bytes, sizes: bytes, body: bytes, length: int):
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.sizes = np.frombuffer(sizes, dtype=np.int64)
        self.data = zstandard.decompress(body) if body else b""
        self.length = length
        self._units()

    def _units(self) -> None:
        """start, last (window starts of each unit, inclusive), anchor and document of the units."""
        n, width = len(self.data), self.length - GRAM + 1
        doc_of = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)
        grams, found = words8(self.data), []
        for lo in range(0, max(0, n - self.length + 1), SLAB):
            hi = min(lo + SLAB, n - self.length + 1)
            count = hi - lo + width - 1
            h = grams[lo:lo + count] * M1
            h += grams[lo + 8:lo + 8 + count] * M2
            h += grams[lo + 16:lo + 16 + count] * M3
            h ^= h >> S32
            h *= M4
            h ^= h >> S32
            span = 1
            while span * 2 <= width:
                h = np.minimum(h[:-span], h[span:])
                span *= 2
            if span < width:
                h = np.minimum(h[:len(h) - (width - span)], h[width - span:])
            doc = doc_of[lo:hi]
            inside = doc == doc_of[lo + self.length - 1:hi + self.length - 1]
            new = np.ones(hi - lo, dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, hi - lo))
            size, start = size[inside[start]], start[inside[start]]
            if len(size) and size.max() > width:  # periodic text: cut into units of a bounded size
                parts = -(-size // width)
                step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                start, size = np.repeat(start, parts) + step * width, np.repeat(size, parts) - step * width
            found.append((start + lo, start + lo + np.minimum(size, width) - 1, h[start], doc[start]))
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.uint64, np.int32)]
        self.start, self.last, self.anchor = parts[:3]
        self.doc = self.ids[parts[3]] if len(self.ids) else parts[0]

    def anchors(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors ordered by bucket, their buckets, and the place of each unit's anchor."""
        distinct, inverse = np.unique(self.anchor, return_inverse=True)
        bucket = (distinct % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return distinct[order], bucket[order], place[inverse]

    def texts_hash(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """A hash of everything that the windows starting at s to e (inclusive) cover."""
        grams = words8(self.data)
        c = (e - s).astype(np.uint64) * M4
        offsets = sorted({*range(0, self.length - 7, 8), self.length - 8})
        for at, o, m in [(s, o, M1) for o in offsets] + [(e, self.length - 8 - o, M2) for o in range(0, min(self.length - 7, 32), 8)]:
            c = (c ^ grams[at + o]) * m
            c ^= c >> S29
        return c

    def classes(self, buckets: int, repeated: np.ndarray, hot: np.ndarray) -> dict[str, np.ndarray]:
        """Distinct (anchor, text hash) of the units whose anchor is repeated, ordered by bucket (the
        text's if the anchor is hot), with the smallest document and the next one (or NEVER), a unit of it, and the
        class of each such unit."""
        distinct, bucket, place = self.anchors(buckets)
        units = np.flatnonzero(repeated[place]) if len(place) else np.zeros(0, dtype=np.int64)
        text, where, doc = self.texts_hash(self.start[units], self.last[units]), place[units], self.doc[units]
        order = np.lexsort((doc, text, where))
        where, text, doc = where[order], text[order], doc[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (where[1:] != where[:-1]) | (text[1:] != text[:-1])
        group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        of = np.empty(len(order), dtype=np.int64)
        of[order] = group
        later = np.where(doc > doc[starts][group], doc, NEVER)
        later = np.minimum.reduceat(later, starts) if len(starts) else later
        heated = hot[where[new]]
        home = np.where(heated, (text[new] % np.uint64(buckets)).astype(np.int64), bucket[where[new]])
        dealt = np.argsort(home, kind="stable")
        at = np.empty(len(dealt), dtype=np.int64)
        at[dealt] = np.arange(len(dealt))
        return {"bucket": home[dealt], "anchor": distinct[where[new]][dealt], "text": text[new][dealt], "doc": doc[new][dealt], "later": later[dealt],
                "hot": heated[dealt], "unit": units[order[new]][dealt], "units": units, "class_of": at[of]}

    def single_windows(self, buckets: int, classes: dict[str, np.ndarray], chosen: np.ndarray) -> dict[str, np.ndarray]:
        """Distinct windows of the chosen classes, ordered by bucket (buckets and up), with a start and the
        smallest document; and for every window of a class its class, step, document and distinct window."""
        start, size = self.start[classes["unit"][chosen]], (self.last - self.start + 1)[classes["unit"][chosen]]
        of = np.repeat(chosen, size)
        step = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        at, doc = np.repeat(start, size) + step, classes["doc"][of]
        text = self.texts_hash(at, at)
        bucket = (text % np.uint64(buckets)).astype(np.int64) + buckets
        order = np.lexsort((doc, text, bucket))
        new = np.ones(len(order), dtype=bool)
        new[1:] = text[order][1:] != text[order][:-1]
        entry = np.empty(len(order), dtype=np.int64)
        entry[order] = np.cumsum(new) - 1
        first = order[new]
        return {"bucket": bucket[first], "start": at[first], "first": doc[first], "class": of, "step": step, "doc": doc, "entry": entry}


def slices(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    cuts = [*np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        yield int(bucket[lo]), slice(int(lo), int(hi))


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(answers, bucket: np.ndarray, which: int, dtype=bool) -> np.ndarray:
    """Bits (or words) per bucket put back into the order of the entries."""
    out = np.zeros(len(bucket), dtype=dtype)
    got = {a["bucket"]: a["payload"] for a in (answers if answers is not None else [])}
    for b, part in slices(bucket):
        if (payload := got.get(b)) is not None:
            n = part.stop - part.start
            size = -(-n // 8)
            raw = payload[which * size:(which + 1) * size] if dtype is bool else payload
            out[part] = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=n) if dtype is bool else np.frombuffer(raw, dtype=dtype)
    return out


def pack_documents(batches: Iterator[pd.DataFrame], block_bytes: int) -> Iterator[pd.DataFrame]:
    task, serial = TaskContext.get().partitionId(), 0
    ids: list[int] = []
    texts: list[bytes] = []

    def block() -> pd.DataFrame:
        body = b"".join(texts)
        return pd.DataFrame({"block": [f"{task}-{serial}"], "n_bytes": [len(body)], "ids": [np.array(ids, dtype=np.int64).tobytes()],
                             "sizes": [np.array(list(map(len, texts)), dtype=np.int64).tobytes()], "body": [zstandard.compress(body, 3)]})

    size = 0
    for batch in batches:
        for i, text in zip(batch["id"].tolist(), batch["text"], strict=True):
            ids.append(i)
            texts.append((text or "").encode("utf-8"))
            size += len(texts[-1])
            if size >= block_bytes:
                yield block()
                ids.clear()
                texts.clear()
                serial, size = serial + 1, 0
    if ids:
        yield block()


def repeated_anchors(rows: pd.DataFrame, heavy_blocks: int, hot_blocks: int) -> pd.DataFrame:
    """Bits per block, in the block's order: two documents hold the anchor; it is hot."""
    counts, keys, several, heavy, seen = [], [], [], [], 0
    for payload in rows["payload"]:
        n = int.from_bytes(payload[:8], "little")
        counts.append(n)
        keys.append(np.frombuffer(payload[8:8 + 4 * n], dtype=np.uint32))
        end = 8 + 4 * n - (-n // 8)
        several.append(np.unpackbits(np.frombuffer(payload[8 + 4 * n:end], dtype=np.uint8), count=n).astype(bool))
        heavy.append(np.frombuffer(payload[end:], dtype=np.uint32).astype(np.int64) + seen)
        seen += n
    values, inverse, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    shared = times > 1
    shared[inverse[np.concatenate(several)]] = True
    hot = (np.bincount(inverse[np.concatenate(heavy)], minlength=len(values)) >= heavy_blocks) | (times >= hot_blocks)
    cuts = np.cumsum(counts)[:-1]
    return pd.DataFrame({"bucket": rows["bucket"], "block": rows["block"],
                         "payload": [bits(p) + bits(h) for p, h in zip(np.split(shared[inverse], cuts), np.split(hot[inverse], cuts), strict=True)]})


def judged_classes(rows: pd.DataFrame) -> pd.DataFrame:
    """Bits per block: an earlier document is in the class; the anchor has other texts; a later document is in the class."""
    counts, columns = [], []
    for payload in rows["payload"]:
        n = int.from_bytes(payload[:8], "little")
        counts.append(n)
        columns.append((np.frombuffer(payload[8:8 + 4 * n], dtype=np.uint32), np.frombuffer(payload[8 + 4 * n:8 + 12 * n], dtype=np.uint64),
                        np.frombuffer(zstandard.decompress(payload[8 + 12 * n:]), dtype=np.int64)))
    anchor, text, doc = (np.concatenate(c) for c in zip(*columns, strict=True))
    order = np.lexsort((doc, text, anchor))
    a, t, d = anchor[order], text[order], doc[order]
    new_a = np.ones(len(order), dtype=bool)
    new_a[1:] = a[1:] != a[:-1]
    new_t = new_a.copy()
    new_t[1:] |= t[1:] != t[:-1]
    first = d[np.flatnonzero(new_t)][np.cumsum(new_t) - 1]
    texts_of = np.add.reduceat(new_t.astype(np.int64), np.flatnonzero(new_a))[np.cumsum(new_a) - 1]
    last = d[np.append(np.flatnonzero(new_t)[1:], len(d)) - 1][np.cumsum(new_t) - 1]
    found = np.empty((3, len(order)), dtype=bool)
    found[:, order] = first < d, (first == d) & (texts_of > 1), (first == d) & (last > d)
    return pd.DataFrame({"bucket": rows["bucket"], "block": rows["block"],
                         "payload": [b"".join(map(bits, part)) for part in np.split(found, np.cumsum(counts)[:-1], axis=1)]})


def nearest_smaller(rank: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """For each place the common prefix with the nearest earlier place of smaller rank; 0 where it is
    below ``least`` or there is none.  lcp[i] is that of places i - 1 and i."""
    previous, reach = np.arange(len(rank)) - 1, lcp.copy()
    active = np.flatnonzero((previous >= 0) & (reach >= least))
    while len(active):
        active = active[rank[previous[active]] >= rank[active]]
        p = previous[active]
        reach[active] = np.minimum(reach[active], reach[p])
        previous[active] = previous[p]
        active = active[(previous[active] >= 0) & (reach[active] >= least)]
    reach[(previous < 0) | (reach < least)] = 0
    return reach


def longest_previous_factor(rank: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Longest match with a place of smaller rank, from the previous and next smaller in suffix order."""
    before = nearest_smaller(rank, lcp, least)
    back = np.append(lcp[1:], 0)[::-1]
    return np.maximum(before, nearest_smaller(rank[::-1], np.append(0, back[1:]) if len(back) else back, least)[::-1])


def suffix_order(data: bytes, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows starting at ``place`` in the order of their text, and the common prefix of each with the one
    before, in steps of 8 bytes up to ``length``.  Only windows that are still tied are compared further."""
    grams = words8(data, ">u8")
    offsets = sorted({*range(0, length - 7, 8), length - 8})
    key = grams[place].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    tied, lcp = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=np.int64)
    tied[1:] = key[1:] == key[:-1]
    lcp[tied] = 8
    for o in offsets[1:]:
        member = tied.copy()
        member[:-1] |= tied[1:]
        at = np.flatnonzero(member)
        if not len(at):
            break
        inside = tied[at]
        key = grams[place[order[at]] + o].astype(np.uint64)
        again = np.lexsort((key, np.cumsum(~inside)))
        order[at], key = order[at][again], key[again]
        inside[1:] &= key[1:] == key[:-1]
        tied[at] = inside
        lcp[at[inside]] = o + 8
    return order, lcp


def covered_windows(data: bytes, place: np.ndarray, doc: np.ndarray, later: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the windows starting at ``place`` also start in a document smaller than ``doc``, and smaller than
    ``later`` where that is not NEVER: there the window stands twice in the suffix order, as in two documents."""
    order, lcp = suffix_order(data, place, length)
    twice = later[order] < NEVER
    first = np.arange(len(order)) + np.cumsum(twice) - twice
    rank, common = np.empty((2, len(order) + int(twice.sum())), dtype=np.int64)
    rank[first], common[first] = doc[order], lcp
    rank[first[twice] + 1], common[first[twice] + 1] = later[order][twice], length
    found = longest_previous_factor(rank, common, length) >= length
    own, next_ = np.zeros((2, len(order)), dtype=bool)
    own[order] = found[first]
    next_[order[twice]] = found[first[twice] + 1]
    return own, next_


def pack_texts(doc: np.ndarray, key: np.ndarray, later: np.ndarray, size: np.ndarray, texts: bytes, follower: np.ndarray, follower_doc: np.ndarray) -> bytes:
    """Classes with their texts (document, hash, next document, number of windows), and copies known by hash."""
    head = np.array([len(doc), len(follower)], dtype=np.int64).tobytes()
    parts = [doc.astype(np.int64), key.astype(np.uint64), later.astype(np.int64), size.astype(np.uint8), follower.astype(np.uint64), follower_doc.astype(np.int64)]
    return zstandard.compress(head + b"".join(p.tobytes() for p in parts) + texts, 1)


def unpack_texts(payload: bytes) -> tuple[list[np.ndarray], bytes]:
    raw, out, at = zstandard.decompress(payload), [], 16
    n, m = np.frombuffer(raw[:16], dtype=np.int64).tolist()
    for count, dtype in ((n, np.int64), (n, np.uint64), (n, np.int64), (n, np.uint8), (m, np.uint64), (m, np.int64)):
        size = count * np.dtype(dtype).itemsize
        out.append(np.frombuffer(raw[at:at + size], dtype=dtype))
        at += size
    return out, raw[at:]


def judged_windows(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Per block a word for each class with a text (bit j says that its window j is covered), one for its later
    documents, and one for each copy known by hash."""
    columns, bodies = zip(*map(unpack_texts, rows["payload"]), strict=True)
    doc, key, later, size, follower, follower_doc = (np.concatenate(c) for c in zip(*columns, strict=True))
    size, later = size.astype(np.int64), later.copy()
    by_key = np.argsort(key, kind="stable")
    of = by_key[np.searchsorted(key[by_key], follower)] if len(follower) else np.zeros(0, dtype=np.int64)
    np.minimum.at(later, of, follower_doc)
    begin = np.cumsum(size + length - 1) - (size + length - 1)
    unit = np.repeat(np.arange(len(size)), size)
    step = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)
    hits = covered_windows(b"".join(bodies), begin[unit] + step, doc[unit], later[unit], length)
    words = np.zeros((2, len(size)), dtype=np.uint32)
    for k, on in enumerate(hits):
        np.bitwise_or.at(words[k], unit[on], np.uint32(1) << step[on].astype(np.uint32))
    answers = words[1][of]
    payload = [own.tobytes() + next_.tobytes() + copies.tobytes() for own, next_, copies in zip(
        np.split(words[0], np.cumsum([len(c[0]) for c in columns])[:-1]), np.split(words[1], np.cumsum([len(c[0]) for c in columns])[:-1]),
        np.split(answers, np.cumsum([len(c[4]) for c in columns])[:-1]), strict=True)]
    return pd.DataFrame({"bucket": rows["bucket"], "block": rows["block"], "payload": payload})


def words_back(answers, texts: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The answers of :func:`judged_windows` in the order of a block's entries, given their buckets."""
    own, next_, copied = (np.zeros(n, dtype=np.uint32) for n in (len(texts), len(texts), len(copies)))
    for a in answers if answers is not None else []:
        raw = np.frombuffer(a["payload"], dtype=np.uint32)
        (lo, hi), (first, last) = (np.searchsorted(b, [a["bucket"], a["bucket"] + 1]).tolist() for b in (texts, copies))
        n = hi - lo
        if n or last > first:
            own[lo:hi], next_[lo:hi], copied[first:last] = raw[:n], raw[n:2 * n], raw[2 * n:]
    return own, next_, copied


def removed_runs(block: Block, classes: dict[str, np.ndarray], own: np.ndarray, next_: np.ndarray) -> np.ndarray:
    """A flag per byte of the block: covered by a window that an earlier document holds.  ``own`` has the
    covered windows of each class for its smallest document, ``next_`` for the later ones."""
    edge = np.zeros(len(block.data) + 1, dtype=np.int32)
    of, units = classes["class_of"], classes["units"]
    mask = np.where(block.doc[units] > classes["doc"][of], next_[of], own[of])
    size = (block.last - block.start + 1)[units].astype(np.uint32)
    whole = mask == (np.uint32(1) << size) - np.uint32(1)
    np.add.at(edge, block.start[units[whole]], 1)
    np.add.at(edge, block.last[units[whole]] + block.length, -1)
    part = ~whole & (mask > 0)
    at, mask = block.start[units[part]], mask[part]
    for j in range(block.length - GRAM + 1):
        on = at[mask >> np.uint32(j) & np.uint32(1) == 1] + j
        np.add.at(edge, on, 1)
        np.add.at(edge, on + block.length, -1)
    return np.cumsum(edge[:-1]) > 0


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50,
                     block_bytes: int = 2 << 20, bucket_bytes: int = 10 << 20, table_bytes: int = 24 << 20,
                     heavy_units: int = 16, heavy_blocks: int = 16, hot_blocks: int = 1024) -> DataFrame:
    """``id``, ``n_bytes``, ``spans`` (maximal removed byte runs, end exclusive) and ``kept`` (binary)
    per input row; ids are integers, ``length`` is 32 to 55 bytes.  An anchor is hot that ``hot_blocks``
    blocks hold, or ``heavy_blocks`` blocks in ``heavy_units`` units each; results don't depend on it.

    Edge cases: a null text is empty; texts shorter than ``length`` stay whole; rows
    with one id are one document and never remove each other's bytes; a row without id takes
    no part and stays whole; a very long text is one block of its own and judged whole; extra
    columns of any name are ignored; an empty table gives no rows.  Matches never cross documents, and
    strings are judged on the input.
    """
    if not 32 <= length <= 55:
        raise ValueError("length must be 32 to 55 bytes")
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = source.where("id is not null").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(total // bucket_bytes + 1)
    # each exchange has a row per block and bucket: with many buckets larger blocks keep rows of many entries
    block_bytes *= min(16, 1 + buckets // 4096)
    packed = source.where("id is not null").mapInPandas(
        lambda batches: pack_documents(batches, block_bytes), "block string, n_bytes long, ids binary, sizes binary, body binary")
    # with fewer table buckets than shuffle partitions Spark would deal the blocks out anew in every join
    parts = min(max(int(total // table_bytes + 1), int(spark.conf.get("spark.sql.shuffle.partitions"))),
                int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    name = f"llm_blocks_{uuid.uuid4().hex}"
    packed.repartition(parts, "block").write.bucketBy(parts, "block").option(
        "path", f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; files and lay-out stay known to ``blocks``

    def answered(answers: DataFrame, column: str) -> DataFrame:
        return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "payload")).alias(column))

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_dict("records"):
                yield row, Block(row["ids"], row["sizes"], row["body"], length)

    def emit(rows: list[tuple[int, str, bytes]]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["bucket", "block", "payload"])

    def send_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, b in opened(batches):
            distinct, bucket, place = b.anchors(buckets)
            low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
            np.minimum.at(low, place, b.doc)
            np.maximum.at(high, place, b.doc)
            heavy = np.bincount(place, minlength=len(distinct)) >= heavy_units
            keys = (distinct >> S32).astype(np.uint32)
            yield emit([(k, row["block"], (s.stop - s.start).to_bytes(8, "little") + keys[s].tobytes() + bits(low[s] < high[s])
                         + np.flatnonzero(heavy[s]).astype(np.uint32).tobytes()) for k, s in slices(bucket)])

    def known_classes(b: Block, row: dict) -> dict:
        _, bucket, _ = b.anchors(buckets)
        return b.classes(buckets, flags(row["repeated"], bucket, 0), flags(row["repeated"], bucket, 1))

    def send_classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, b in opened(batches):
            c = known_classes(b, row)
            keys = (c["anchor"] >> S32).astype(np.uint32)
            yield emit([(k, row["block"], (s.stop - s.start).to_bytes(8, "little") + keys[s].tobytes() + c["text"][s].tobytes()
                         + zstandard.compress(c["doc"][s].tobytes(), 1)) for k, s in slices(c["bucket"])])

    def open_classes(b: Block, row: dict) -> tuple[dict, np.ndarray, np.ndarray, dict]:
        """Classes, those that send their text, those known by hash, and the windows of those of hot anchors."""
        c = known_classes(b, row)
        earlier, several, shared = (flags(row["judged"], c["bucket"], which) for which in range(3))
        sends = ~earlier & (several & ~c["hot"] | shared | (c["later"] < NEVER))
        return c, np.flatnonzero(sends), np.flatnonzero(earlier), b.single_windows(buckets, c, np.flatnonzero(c["hot"] & ~earlier))

    def send_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, dtype=np.int64)
        for row, b in opened(batches):
            c, chosen, copies, single = open_classes(b, row)
            start, last = b.start[c["unit"][chosen]], b.last[c["unit"][chosen]]
            rows, at = [], {k: [slice(0), slice(0)] for k in np.unique(c["bucket"][np.append(chosen, copies)]).tolist()}
            for which, part in enumerate((chosen, copies)):
                for k, s in slices(c["bucket"][part]):
                    at[k][which] = s
            for k, (s, f) in at.items():
                texts = b"".join(b.data[p:q + length] for p, q in zip(start[s].tolist(), last[s].tolist(), strict=True))
                rows.append((k, row["block"], pack_texts(c["doc"][chosen[s]], c["text"][chosen[s]], c["later"][chosen[s]], last[s] - start[s] + 1, texts,
                                                         c["text"][copies[f]], c["doc"][copies[f]])))
            for k, s in slices(single["bucket"]):
                texts = b"".join(b.data[p:p + length] for p in single["start"][s].tolist())
                n = s.stop - s.start
                rows.append((k, row["block"], pack_texts(single["first"][s], np.zeros(n), np.full(n, NEVER), np.ones(n), texts, none, none)))
            yield emit(rows)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, b in opened(batches):
            c, chosen, copies, single = open_classes(b, row)
            own, next_ = np.zeros((2, len(c["bucket"])), dtype=np.uint32)
            here = [a for a in (row["windows"] if row["windows"] is not None else []) if a["bucket"] < buckets]
            own[chosen], next_[chosen], known = words_back(here, c["bucket"][chosen], c["bucket"][copies])
            own[copies] = next_[copies] = known
            earlier = words_back(row["windows"], single["bucket"], np.zeros(0, dtype=np.int64))[0][single["entry"]] > 0
            earlier |= single["doc"] > single["first"][single["entry"]]
            np.bitwise_or.at(own, single["class"][earlier], np.uint32(1) << single["step"][earlier].astype(np.uint32))
            gone = removed_runs(b, c, own, next_)
            out, at = [], 0
            raw = np.frombuffer(b.data, dtype=np.uint8)
            for i, n in zip(b.ids.tolist(), b.sizes.tolist(), strict=True):
                here = np.concatenate(([False], gone[at:at + n], [False]))
                turn = np.flatnonzero(here[1:] != here[:-1])
                out.append((i, n, [{"start": s, "end": e} for s, e in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)],
                            raw[at:at + n][~here[1:-1]].tobytes() if len(turn) else b.data[at:at + n]))
                at += n
            yield pd.DataFrame(out, columns=["id", "n_bytes", "spans", "kept"])

    def exchange(rows: DataFrame, judge, tag: str) -> DataFrame:
        return materialise(rows.groupBy("bucket").applyInPandas(judge, PACKED), tag)

    repeated = exchange(blocks.mapInPandas(send_anchors, PACKED), lambda rows: repeated_anchors(rows, heavy_blocks, hot_blocks), "anchors")
    known = blocks.join(answered(repeated, "repeated"), "block", "left")
    judged = exchange(known.mapInPandas(send_classes, PACKED), judged_classes, "classes")
    known = known.join(answered(judged, "judged"), "block", "left")
    windows = exchange(known.mapInPandas(send_texts, PACKED), lambda rows: judged_windows(rows, length), "windows")
    known = known.join(answered(windows, "windows"), "block", "left")
    result = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType()),
                           T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
                           T.StructField("kept", T.BinaryType())])
    whole = source.where("id is null").select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                                              F.array().cast(result["spans"].dataType).alias("spans"),
                                              F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("kept"))
    return known.mapInPandas(finish, result).union(whole)
