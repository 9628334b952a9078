"""Evaluation passages in training texts (problem 6).

Method: SimHash fingerprints of sliding windows, found through multi-index Hamming blocks (fingerprints within radius r
agree in one of r + 1 blocks at least, so none is missed); candidates are verified by the exact weighted similarity of
their shingles, and last by the rule on words of TESTDATA.md. Windows of an item's size would miss passages that stand
in a text only in part, so windows have ``WINDOW`` words, the run that must stand unchanged in any stretch that counts.
Windows with a changed word within the radius are candidates like the others; the verification aligns item and text
around each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..skew import salted_join
from . import plaintext

#: Words of an item that must stand in a text; unchanged words between two changes; so many stand unchanged in a row in any stretch.
STRETCH, BETWEEN = 15, 6
WINDOW, RADIUS = 6, 3
#: Words of a shingle of the weighted similarity; a shingle weighs as many as it has letters.
SHINGLE = 5
#: Words of items that are sent to the executors as one index (some 100 MB); more items are joined by the blocks of their windows.
INDEX_WORDS = 2_000_000
#: The radius of that join, whose two blocks of 32 bits stay selective; and the bits of the sieve that texts go through before it.
JOIN_RADIUS, SIEVE_BITS = 1, 1 << 27
#: Candidate windows that are compared at once.
PAIRS_AT_ONCE = 1 << 22
#: Words of texts that are fingerprinted at once.
CHUNK = 1 << 15


class WordCodes:
    """Numbers of words, and each word's 64 signs for SimHash; forgotten when there are too many."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.codes, self.hashes = most, {}, []

    def number(self, words: list[str]) -> np.ndarray:
        if len(self.codes) > self.most:
            self.codes, self.hashes = {}, []
        codes, out = self.codes, np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            if (c := codes.get(w)) is None:
                c = codes[w] = len(self.hashes)
                self.hashes.append(xxhash.xxh64_intdigest(w))
            out[i] = c
        return out

    def hashed(self, words: list[str]) -> np.ndarray:
        numbers = self.number(words)
        return np.array(self.hashes, np.uint64)[numbers]


def simhash_windows(hashes: np.ndarray, window: int) -> np.ndarray:
    """The 64-bit SimHash of each ``window`` consecutive words, given the words' 64-bit hashes."""
    out = []
    for start in range(0, max(len(hashes) - window + 1, 0), CHUNK):
        part = np.ascontiguousarray(hashes[start : start + CHUNK + window - 1])
        ones = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
        total = np.vstack([np.zeros((1, 64), np.int32), np.cumsum(ones, axis=0, dtype=np.int32)])
        bits = (total[window:] - total[:-window]) * 2 > window
        out.append(np.packbits(bits, axis=1).view(np.uint64).ravel())
    return np.concatenate(out) if out else np.empty(0, np.uint64)


class HammingIndex:
    """Fingerprints by each of ``radius + 1`` blocks of their bits."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(edges, edges[1:])]
        self.orders = [np.argsort(self._cut(prints, k), kind="stable") for k in range(len(self.blocks))]
        self.keys = [self._cut(prints, k)[order] for k, order in enumerate(self.orders)]

    def _cut(self, prints: np.ndarray, k: int) -> np.ndarray:
        shift, mask = self.blocks[k]
        return (prints >> shift) & mask

    def near(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in ``queries``, places in the index) of all pairs within the radius, in pieces; a pair may come more than once."""
        for k, (keys, order) in enumerate(zip(self.keys, self.orders)):
            if not len(keys):
                continue
            sought = self._cut(queries, k)
            low = np.searchsorted(keys, sought, "left")
            at = np.nonzero((low < len(keys)) & (keys[np.minimum(low, len(keys) - 1)] == sought))[0]
            counts = np.searchsorted(keys, sought[at], "right") - low[at]
            piece = np.cumsum(counts) // PAIRS_AT_ONCE
            for p in np.unique(piece):
                mine, many = at[piece == p], counts[piece == p]
                query = np.repeat(mine, many)
                offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                item = order[np.repeat(low[mine], many) + offset]
                close = np.bitwise_count(queries[query] ^ self.prints[item]) <= self.radius
                yield query[close], item[close]


def _run(a: list[str], b: list[str], i: int, j: int, step: int) -> int:
    n = 0
    while 0 <= i < len(a) and 0 <= j < len(b) and a[i] == b[j]:
        n, i, j = n + 1, i + step, j + step
    return n


def _beyond(a: list[str], b: list[str], i: int, j: int, step: int) -> int:
    """Most words of ``a`` that follow in ``b`` after one change at (i, j), and further ones behind long enough runs."""
    best: dict[tuple[int, int], int] = {}
    stack = [(i, j)]
    while stack:
        p, q = stack[-1]
        if (p, q) in best:
            stack.pop()
            continue
        most, waits = 0, []
        for di, dj in ((1, 1), (0, 1), (1, 0)):
            x, y = p + di * step, q + dj * step
            n = _run(a, b, x, y, step)
            if n >= BETWEEN:
                after = (x + n * step, y + n * step)
                if after in best:
                    n += best[after]
                else:
                    waits.append(after)
            most = max(most, n)
        if waits:
            stack += waits
        else:
            best[p, q] = most
            stack.pop()
    return best[i, j]


def longest_stretch(item: list[str], text: list[str], seeds: list[tuple[int, int]]) -> int:
    """Most of the item's words that stand unchanged in one stretch of the text, by the rule of ``STRETCH`` and ``BETWEEN``.

    ``seeds``: places (in item, in text) of windows that are alike; each run of equal words in them is aligned.
    """
    best, seen = 0, set()
    for at, place in seeds:
        k = 0
        while k < WINDOW and at + k < len(item) and place + k < len(text):
            i, j = at + k, place + k
            if item[i] != text[j]:
                k += 1
                continue
            back = _run(item, text, i - 1, j - 1, -1)
            start = (i - back, j - back)
            n = _run(item, text, *start, 1)
            k += n - back
            if start in seen:
                continue
            seen.add(start)
            ahead = _beyond(item, text, start[0] + n, start[1] + n, 1)
            behind = _beyond(item, text, start[0] - 1, start[1] - 1, -1)
            best = max(best, n + (ahead + behind if n >= BETWEEN else max(ahead, behind)))
    return best


def shingles(words: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    """The shingles of a text; a shorter text is one."""
    return set(zip(*(words[k:] for k in range(size)))) if len(words) >= size else {tuple(words)} - {()}


def shingle_weights(words: list[str]) -> dict[tuple[str, ...], int]:
    """shingle -> its letters."""
    return {part: sum(map(len, part)) for part in shingles(words)}


def weighted_similarity(weights: dict[tuple[str, ...], int], item: list[str], text: list[str], seeds: list[tuple[int, int]]) -> float:
    """The share, by weight, of the item's shingles that stand in the text near the seeds (as far as the item reaches around each)."""
    near: set[tuple[str, ...]] = set()
    upto = 0
    for begin, end in sorted((max(j - i - len(item), 0), j - i + 2 * len(item)) for i, j in seeds):
        if end > upto:
            near |= shingles(text[max(begin, upto - SHINGLE + 1) : end])
            upto = end
    return sum(weights[part] for part in weights.keys() & near) / max(sum(weights.values()), 1)


def verified(weights: dict[tuple[str, ...], int], item: list[str], text: list[str], seeds: list[tuple[int, int]]) -> tuple[int, float] | None:
    """(longest stretch, weighted similarity) of a candidate that holds, else None. Any stretch that counts shares shingles, so candidates without are dropped first."""
    similarity = weighted_similarity(weights, item, text, seeds)
    if similarity <= 0:
        return None
    length = longest_stretch(item, text, seeds)
    return (length, similarity) if length >= STRETCH else None


class ItemIndex:
    """The windows of a set of items."""

    def __init__(self, items: list[tuple], window: int = WINDOW, radius: int = RADIUS):
        codes = WordCodes()
        self.items, self.window = [(key, plaintext.words(text)) for key, text in items], window
        prints, owner, place = [], [], []
        for n, (_, words) in enumerate(self.items):
            found = simhash_windows(codes.hashed(words), window)
            prints.append(found)
            owner.append(np.full(len(found), n, np.int32))
            place.append(np.arange(len(found), dtype=np.int32))
        together = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        self.owner, self.place = together(owner, np.int32), together(place, np.int32)
        self.index = HammingIndex(together(prints, np.uint64), radius)
        self.weights = [shingle_weights(words) for _, words in self.items]

    def search(self, texts: list[str | None], codes: WordCodes) -> Iterator[tuple[int, object, int, float]]:
        """(place in ``texts``, item, longest stretch, similarity) of every pair with ``STRETCH`` words or more."""
        per_text = [plaintext.words(t) for t in texts]
        flat = [w for words in per_text for w in words]
        ends = np.cumsum([len(words) for words in per_text])
        seeds: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
        for at, hit in self.index.near(simhash_windows(codes.hashed(flat), self.window)):
            owners = np.searchsorted(ends, at, "right")
            inside = at - np.where(owners > 0, ends[owners - 1], 0)
            for n, j, which, i in zip(owners.tolist(), inside.tolist(), self.owner[hit].tolist(), self.place[hit].tolist()):
                if j + self.window <= len(per_text[n]):
                    seeds[n, which].add((i, j))
        for (n, which), places in seeds.items():
            key, words = self.items[which]
            if held := verified(self.weights[which], words, per_text[n], sorted(places)):
                yield n, key, *held


def find_leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", index_words: int = INDEX_WORDS) -> DataFrame:
    """(doc, item, stretch, similarity): each document that holds ``STRETCH`` words or more of an item in a row, by the rule of TESTDATA.md; ``similarity`` is the share of the item's weighted shingles that stand there.

    The items' words are counted first. Up to ``index_words`` of them go to the executors as one index, and every
    document is scanned once, without a shuffle. More items are joined with the documents by the blocks of their windows
    (``_joined_leaks``), so neither the driver nor a task ever holds them all. Null and empty texts, and items with fewer
    than ``STRETCH`` words, give no row; repeated items and repeated documents give their rows each.
    """
    known = items.where(F.col(text).isNotNull()).select(item, text)
    size = known.agg(F.coalesce(F.sum(F.size(F.split(text, r"\s+"))), F.lit(0)), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    if max(size[0], size[1] // 4) > index_words:
        return _joined_leaks(documents, known, doc, item, text)
    index = documents.sparkSession.sparkContext.broadcast(ItemIndex([(r[0], r[1]) for r in known.collect()]))
    kinds = (documents.schema[doc].dataType, items.schema[item].dataType)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            rows = [(start + n, *hit) for start in range(0, len(texts), 256) for n, *hit in index.value.search(texts[start : start + 256], codes)]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], _arrow_type(kinds[1])), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.float64())],
                names=[doc, item, "stretch", "similarity"],
            )

    return documents.select(doc, text).mapInArrow(scan, f"`{doc}` {kinds[0].simpleString()}, `{item}` {kinds[1].simpleString()}, stretch int, similarity double")


def _blocks(prints: np.ndarray, radius: int) -> list[np.ndarray]:
    """For each block the key of every fingerprint: the block's number in the top bits, its bits below."""
    edges = np.linspace(0, 64, radius + 2).astype(int)
    return [((prints >> np.uint64(a)) & np.uint64((1 << int(b - a)) - 1)) | np.uint64(k) << np.uint64(62) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def _windows(df: DataFrame, text: str, sieve=None) -> DataFrame:
    """(row, key, print, place): a row for each window of each text and block; with a sieve only for keys that pass it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        bits = None if sieve is None else np.frombuffer(sieve.value, np.uint8)
        for batch in batches:
            for row, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                prints = simhash_windows(codes.hashed(plaintext.words(content)), WINDOW)
                for keys in _blocks(prints, JOIN_RADIUS):
                    place = np.arange(len(prints))
                    if bits is not None:
                        spot = _spot(keys)
                        place = np.nonzero(bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8) & 1)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), row, np.int64)), pa.array(keys[place].view(np.int64)), pa.array(prints[place].view(np.int64)), pa.array(place.astype(np.int32))], names=["row", "key", "print", "place"])

    return df.select("_row", text).mapInArrow(cut, "row long, key long, print long, place int")


def _spot(keys: np.ndarray) -> np.ndarray:
    """A bit of the sieve for each key."""
    return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(SIEVE_BITS)


def _sieve(windows: DataFrame) -> bytes:
    """The bits of all keys, or-ed in the tasks of each partition and then pairwise on the executors; a fixed size, whatever the number of items."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = [np.unique(_spot(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))) for batch in batches]
        found = np.unique(np.concatenate(spots)) if spots else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array((found >> np.uint64(13)).astype(np.int64)), pa.array((found & np.uint64(8191)).astype(np.int32))], names=["page", "bit"])

    pages = windows.select("key").mapInArrow(mark, "page long, bit int").groupBy("page").agg(F.collect_set("bit").alias("bits"))
    out = np.zeros(SIEVE_BITS, np.uint8)
    for row in pages.toLocalIterator():  # at most one row for each 8192 bits
        out[row["page"] * 8192 + np.array(row["bits"], np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _joined_leaks(documents: DataFrame, items: DataFrame, doc: str, item: str, text: str) -> DataFrame:
    """``find_leaks`` for any number of items: windows of both sides are joined by the keys of their blocks.

    Document windows pass a sieve of the items' keys first (``SIEVE_BITS``, broadcast), so that only windows near some
    item are shuffled. Frequent keys are salted on the side of the documents. A candidate pair is then joined with its
    two texts and verified.
    """
    docs = cut_lineage(documents.where(F.col(text).isNotNull()).select(F.col(doc).alias("_doc"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row")))
    held = cut_lineage(items.select(F.col(item).alias("_item"), F.col(text).alias("_words"), F.monotonically_increasing_id().alias("_row")))
    sought = cut_lineage(_windows(held, "_words"))
    sieve = documents.sparkSession.sparkContext.broadcast(_sieve(sought))
    near = _windows(docs, "_text", sieve)
    right = sought.select("key", F.col("row").alias("_irow"), F.col("print").alias("_iprint"), F.col("place").alias("_iplace"))
    hits = salted_join(near, right, "key", F.struct("row", "place")).where(F.bit_count(F.col("print").bitwiseXOR(F.col("_iprint"))) <= JOIN_RADIUS)
    pairs = hits.groupBy("row", "_irow").agg(F.collect_set(F.struct(F.col("_iplace").alias("i"), F.col("place").alias("j"))).alias("seeds"))
    both = pairs.join(docs.withColumnRenamed("_row", "row"), "row").join(held.withColumnRenamed("_row", "_irow"), "_irow")
    kinds = (documents.schema[doc].dataType, items.schema[item].dataType)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, (words, content, seeds) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))):
                own = plaintext.words(words)
                if held := verified(shingle_weights(own), own, plaintext.words(content), sorted((x["i"], x["j"]) for x in seeds)):
                    rows.append((n, *held))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64())], names=[doc, item, "stretch", "similarity"])

    return both.select("_doc", "_item", "_words", "_text", "seeds").mapInArrow(check, f"`{doc}` {kinds[0].simpleString()}, `{item}` {kinds[1].simpleString()}, stretch int, similarity double")


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item that leaked: its suite and site, the documents that hold it, its longest stretch and its largest weighted similarity."""
    hits = find_leaks(documents, items)
    found = hits.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("stretch").alias("longest"), F.round(F.max("similarity"), 6).alias("similarity"))
    return found.join(items.select("item_id", "suite", "site"), "item_id")


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of p6_found."""
    return find_leaks(documents, items).select("doc_id", "item_id")
