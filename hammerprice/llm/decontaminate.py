"""Benchmark decontamination: test suffixes are searched in suffix arrays of the training text.

Each shard (an Arrow batch of documents) becomes a word-level suffix array; words
that no test item has can't be part of a match, so only runs of known words that are
long enough for the shortest window enter it. Every test suffix is then located by
binary search, all of a shard's searches side by side. Equal neighbours in the array
are the verbatim occurrences; occurrences that continue each other along an item are
joined into longest matches. Before the search a bitmap of the shard's neighbouring words
leaves out the suffixes that can't occur in it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let_go, small, utf8, written

#: Test items are met in blocks of about so many bytes. A block is broadcast for a pass over the
#: documents and dropped after it, so that no more than one is held anywhere.
BLOCK_BYTES = 1 << 24
#: Slots of the bitmap of word pairs of a shard (bytes; a shard has some 400,000 words).
PAIR_BITS = 1 << 23
#: So many suffixes are searched side by side.
SEARCHED = 1 << 16
#: A-Z to a-z; everything else below 0x80 that isn't a digit or letter to a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``s`` sorted by their first ``depth`` values (more are sorted alike), by doubling ranks."""
    rank, k = np.unique(s, return_inverse=True)[1].astype(np.int64), 1
    while k < depth:
        after = np.full(len(rank), -1, np.int64)
        after[: max(0, len(rank) - k)] = rank[k:]
        rank = np.unique(rank * (len(rank) + 1) + after + 1, return_inverse=True)[1]
        k *= 2
    return np.argsort(rank, kind="stable")


class TestBlock:
    """The searched suffixes of some test items: ``width`` consecutive words each, or a whole shorter item.

    Items are one array of word ids, a suffix is its place there: twelve bytes a word
    besides the dictionary of distinct words."""

    __test__ = False

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], width: int):
        self.names: list[str] = []
        self.ids: dict[bytes, int] = {}
        own: list[np.ndarray] = []
        for name, words in items:
            self.names.append(name)
            own.append(np.fromiter((self.ids.setdefault(w, len(self.ids)) for w in words), np.int32, len(words)))
        sizes = np.array([len(x) for x in own], np.int64)
        self.width, self.base = width, np.cumsum(sizes) - sizes
        self.words = np.concatenate([*own, np.full(width, -1, np.int32)])
        many = np.where(sizes > 0, np.maximum(1, sizes - width + 1), 0)
        self.item = np.repeat(np.arange(len(own), dtype=np.int32), many)
        self.start = (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many - self.base, many)).astype(np.int32)
        self.size = np.minimum(sizes, width).astype(np.int32)
        self.least = int(min(self.size[self.size > 0], default=width))

    def matches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``ids``, searched suffix) of every verbatim occurrence; -1 separates."""
        known = ids >= 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], known.astype(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.least
        starts, ends = starts[long], ends[long]
        none = np.empty(0, np.int64)
        if not len(starts) or not len(self.start):
            return none, none
        sizes = ends - starts + self.width  # runs are padded, so that no comparison leaves its run
        base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        place = np.repeat(starts - base, sizes) + np.arange(int(sizes.sum()))
        real = place < np.repeat(ends, sizes)
        s = np.where(real, ids[np.minimum(place, len(ids) - 1)], -1)
        likely = self._likely(s)
        if not len(likely):
            return none, none
        order = suffix_array(s, self.width)
        order = order[s[order] >= 0]
        found = [(none, none)]
        for i in range(0, len(likely), SEARCHED):
            tests = likely[i : i + SEARCHED]
            low, high = self._bound(s, order, tests, False), self._bound(s, order, tests, True)
            count = high - low
            nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            found.append((place[order[np.repeat(low, count) + nth]], np.repeat(tests, count)))
        places, tests = zip(*found)
        return np.concatenate(places), np.concatenate(tests)

    def _likely(self, s: np.ndarray) -> np.ndarray:
        """The suffixes whose first word and whose pairs of neighbouring words all occur in ``s``, by a
        bitmap of hashed pairs. The others can't match, so only these are searched: a shard costs
        a few array passes over the items and a binary search for each suffix that may occur."""
        first, pair = np.zeros(len(self.ids) + 1, bool), np.zeros(PAIR_BITS, bool)
        first[s] = True
        first[-1] = False
        pair[_pairs(s)] = True
        gaps = np.zeros(len(self.words), np.int32)
        gaps[1:] = np.cumsum(~pair[_pairs(self.words)], dtype=np.int32)
        there = gaps[self.start + self.size[self.item] - 1] == gaps[self.start]
        return np.flatnonzero(there & first[self.words[self.start]])

    def _bound(self, s: np.ndarray, order: np.ndarray, tests: np.ndarray, after: bool) -> np.ndarray:
        step = np.arange(self.width)
        start, used = self.start[tests], step < self.size[self.item[tests], None]
        rows = self.words[start[:, None] + step]
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(order), np.int64)
        for _ in range(int(len(order)).bit_length() + 1):
            open_ = low < high
            mid = np.where(open_, (low + high) // 2, 0)
            there = s[np.minimum(order[mid][:, None] + step, len(s) - 1)]
            differ = (there != rows) & used
            first = differ.argmax(axis=1)
            row = np.arange(len(mid))
            less = differ[row, first] & (there[row, first] < rows[row, first])
            if after:
                less |= ~differ.any(axis=1)
            low = np.where(open_ & less, mid + 1, low)
            high = np.where(open_ & ~less, mid, high)
        return low


def _pairs(ids: np.ndarray) -> np.ndarray:
    """The slot of each two neighbours in a bitmap of PAIR_BITS."""
    return (ids[:-1].astype(np.int64) * 0x9E3779B1 + ids[1:]) & (PAIR_BITS - 1)


def _blocks(items: DataFrame, width: int) -> Iterator[tuple[Broadcast, bool]]:
    """The test items block by block, broadcast, and whether it is the last block. A block is
    destroyed when the next one is asked for, so all but the last must have been used by then.
    Items reach the driver one partition at a time and become word ids as they come."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(1, -(-size // BLOCK_BYTES))
    for k in range(many):
        own = rows.where(F.pmod(F.xxhash64("name", "text"), F.lit(many)) == k)
        sent = items.sparkSession.sparkContext.broadcast(TestBlock(((name, words_of(text.encode())) for name, text in own.toLocalIterator()), width))
        yield sent, k == many - 1
        sent.destroy()


def joined(places: np.ndarray, block: TestBlock, tests: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Longest matches (item, first word in the item, first word in the text, words) from window matches."""
    item = block.item[tests]
    at = block.start[tests] - block.base[item]
    order = np.lexsort((places, places - at, item))
    p, a, i, n = places[order], at[order], item[order], block.size[item][order]
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(i) != 0) | (np.diff(p - a) != 0) | (np.diff(p) > n[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(p)])) - 1
    return [(int(i[f]), int(a[f]), int(p[f]), int(p[e] + n[e] - p[f])) for f, e in zip(first, last)] if len(p) else []


def matches(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """Verbatim matches of test items (item_id, text) in documents (doc_id, text).

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A
    match is ``width`` consecutive item words or more (a whole item of fewer words).
    A row per document: ``doc_id``, ``n_words``, ``n_hit`` (words inside matches),
    ``items`` (ids of items met, sorted as strings; a null id is ""), ``found``
    (longest matches: item_id, item_word, word, words). Null and empty texts have no
    words and no matches, as items and as documents; repeated items all count."""
    kinds = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("words", pa.int64())]))
    struct = "array<struct<item_id:string,item_word:bigint,word:bigint,words:bigint>>"

    def searched(rows: DataFrame, sent: Broadcast, last: bool) -> DataFrame:
        """Of ``rows`` (key, text, found so far): the result, or before the last block the key and
        matches of those only that have some."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            let_go()
            block = sent.value
            get = block.ids.get
            for batch in small(batches, 1):
                texts = [words_of(t) for t in utf8(batch.column(1))]
                found: list[list[dict]] = [own or [] for own in batch.column(2).to_pylist()]
                sizes = np.array([len(t) for t in texts], np.int64)
                starts = np.cumsum(sizes + 1) - sizes - 1
                ids = np.full(int((sizes + 1).sum()), -1, np.int64)
                for at, own in zip(starts.tolist(), texts):
                    ids[at : at + len(own)] = [get(w, -1) for w in own]
                places, tests = block.matches(ids)
                doc = np.searchsorted(starts, places, side="right") - 1
                for d in np.unique(doc).tolist():
                    here = doc == d
                    found[d] += [{"item_id": block.names[item], "item_word": item_word, "word": word, "words": words} for item, item_word, word, words in joined(places[here] - starts[d], block, tests[here])]
                if not last:
                    some = pa.array([bool(own) for own in found], pa.bool_())
                    yield pa.RecordBatch.from_arrays([batch.column(0).filter(some), pa.array([own for own in found if own], kinds)], ["key", "found"])
                    continue
                n_hit = []
                for n, own in zip(sizes.tolist(), found):
                    hit = np.zeros(n + 1 if own else 1, np.int64)
                    for f in own:
                        hit[f["word"]] += 1
                        hit[f["word"] + f["words"]] -= 1
                    n_hit.append(int((np.cumsum(hit)[:-1] > 0).sum()))
                named = [sorted({f["item_id"] for f in own}) for own in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(n_hit, pa.int64()), pa.array(named, pa.list_(pa.string())), pa.array(found, kinds)], ["doc_id", "n_words", "n_hit", "items", "found"])

        return rows.mapInArrow(run, f"doc_id bigint, n_words bigint, n_hit bigint, items array<string>, found {struct}" if last else f"key string, found {struct}")

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    none, before = F.array().cast(struct), None
    for sent, last in _blocks(items, width):
        if not last:
            # Equal texts have equal matches, so a text is known by its digest and handed on once.
            found = searched(own.select(F.md5("text").alias("key"), "text", none.alias("found")), sent, False)
            found = written(found.groupBy("key").agg(F.first("found").alias("found")), "searched")
            before = found if before is None else before.union(found)
        elif before is None:
            return searched(own.select("doc_id", "text", none.alias("found")), sent, True)
        else:
            before = written(before.groupBy("key").agg(F.flatten(F.collect_list("found")).alias("found")), "searched")
            rows = own.join(before, F.md5("text") == F.col("key"), "left")
            return searched(rows.select("doc_id", "text", "found"), sent, True)


def decontaminated(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs`` whose text has no match, with all their columns. Decided text
    by text, so repeated rows and null doc_ids need no care."""

    def clean(sent: Broadcast) -> Column:
        def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            let_go()
            for series in texts:
                batch = pa.RecordBatch.from_arrays([pa.array(series, pa.string())], ["text"])
                yield pd.Series(np.concatenate([np.zeros(0, bool), *(kept(part) for part in small(iter([batch]), 0))]))

        def kept(part: pa.RecordBatch) -> np.ndarray:
            block, own = sent.value, [words_of(t) for t in utf8(part.column(0))]
            out = np.ones(len(own), bool)
            ends = np.cumsum([len(t) + 1 for t in own])
            get = block.ids.get
            ids = np.fromiter((x for t in own for x in (*(get(w, -1) for w in t), -1)), np.int64, int(ends[-1]))
            out[np.searchsorted(ends, block.matches(ids)[0], side="right")] = False
            return out

        return F.pandas_udf(run, "boolean")(F.col("text").cast("string"))

    gone = None
    for sent, last in _blocks(items, width):
        if not last:
            # Before the last block only the digests of the texts that go are handed on.
            hit = written(docs.where(~clean(sent)).select(F.md5(F.col("text").cast("string")).alias("key")).distinct(), "hit")
            gone = hit if gone is None else gone.union(hit)
        elif gone is None:
            return docs.where(clean(sent))
        else:
            gone = written(gone.distinct(), "hit")
            return docs.where(clean(sent)).join(gone, F.md5(docs["text"].cast("string")) == gone["key"], "left_anti")
