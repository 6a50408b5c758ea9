"""Substring dedup by relative Lempel-Ziv parsing over an index of the whole corpus.

Every document is parsed against all reference blocks: the blocks are the parts of
one index of anchored runs (see ``anchors``), spread over the cluster by anchor, and
a join looks each run of a document up in the one block that can hold it. The entry
found names the earliest place of the same words. A run with a single context lies
inside a factor; where an anchor has several contexts a factor begins or ends, and
there the windows are looked up one by one. The places found are parsed greedily into
factors (a stretch of a document and the earlier stretch that it repeats).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Rolling, index, met_by, shared_contexts, with_texts
from .shared import fields, utf8, written

#: Words of an anchor.
GRAM = 6


def word_values(text: bytes) -> np.ndarray:
    """A 64-bit value for each word (what stands between bytes 0x20 and 0x09-0x0D)."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _windows(rows: DataFrame, width: int) -> DataFrame:
    """anchor, hash, doc, at of the single windows of the runs found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, t = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "t"))
            for d, (text, found) in enumerate(zip(utf8(batch.column("text")), batch.column("found"))):
                anchor, lo, n = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in fields(found, "anchor", "at", "n"))
                rolling = Rolling(word_values(text or b""))
                start = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                hashes = rolling(start, start + width)
                at = np.int64(t[d]) << np.int64(32) | start
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(anchor, n)), pa.array(hashes.view(np.int64)), pa.array(np.full(len(at), doc[d])), pa.array(at)], ["anchor", "hash", "doc", "at"])

    return rows.where("found is not null").select("doc", "t", "text", "found").mapInArrow(run, "anchor bigint, hash bigint, doc bigint, at bigint")


def repeats(docs: DataFrame, width: int) -> DataFrame:
    """Runs of windows that start earlier too: doc, at, n, source_doc, source_at (the earliest place)."""
    met, contexts = shared_contexts(index(docs, word_values, width, GRAM, "words"), "words")
    contexts = written(contexts, "contexts")
    again = contexts.where("again").select("anchor", "context", "first", "times")
    inside = met_by(met, again, ["anchor", "context"]).where(F.struct("doc", "at") != F.col("first"))
    inside = inside.select("doc", "at", "n", F.col("first.doc").alias("source_doc"), F.col("first.at").alias("source_at"))
    edges = contexts.where("contexts > 1").select("anchor", "first.doc", "first.at", "n")
    single = written(_windows(with_texts(docs, edges, "anchor", "at", "n"), width), "windows")
    place = F.struct("doc", "at")
    window = ["anchor", "hash"]  # the words of the anchor and all words: 128 bits
    firsts = single.groupBy(*window).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("times")).where("first != last")
    firsts = written(firsts.select(*window, "first", "times"), "firsts")
    later = met_by(single, firsts, window).where(place != F.col("first"))
    later = later.select("doc", "at", F.lit(1).alias("n"), F.col("first.doc").alias("source_doc"), F.col("first.at").alias("source_at"))
    return inside.union(later)


def parse(at: np.ndarray, n: np.ndarray, source_doc: np.ndarray, source_at: np.ndarray, width: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (word, words, source doc, source word) from runs of windows with their sources.

    Runs that continue each other in the text and in the source grow into one entry;
    from left to right the entry that reaches furthest is taken."""
    order = np.lexsort((at, source_at - at, source_doc))
    at, n, doc, src = at[order], n[order], source_doc[order], source_at[order]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(src - at) != 0) | (at[1:] > (at + n)[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(at)])) - 1
    entries = sorted(zip(at[first].tolist(), (at[last] + n[last] + width - 1).tolist(), doc[first].tolist(), src[first].tolist()))
    factors: list[tuple[int, int, int, int]] = []
    done, i = 0, 0
    while i < len(entries):
        best = None  # of the entries that begin before the parse's place, the one that reaches furthest
        done = max(done, entries[i][0])
        while i < len(entries) and entries[i][0] <= done:
            if best is None or entries[i][1] > best[1]:
                best = entries[i]
            i += 1
        if best[1] > done:
            factors.append((done, best[1] - done, best[2], best[3] + done - best[0]))
            done = best[1]
    return factors


def deduplicated(docs: DataFrame, width: int = 20) -> DataFrame:
    """Documents (doc_id, text) without the words that earlier text already has.

    A word goes if a window of ``width`` words over it also starts earlier: in a row
    with a smaller doc_id, or earlier in the same one. Returns doc_id, ``n_words``,
    ``n_removed``, ``kept`` (the other words joined by one blank) and ``factors``
    (word, words, source_doc, source_word). Null and empty texts have no words. Rows
    equal in id and text are one document and get the same result; rows of equal id
    and different texts come in the order of a hash of the text; a null id comes last."""
    kinds = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("source_doc", pa.int64()), ("source_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, gone, count, all_factors = [], [], [], []
            for text, found in zip(utf8(batch.column("text")), batch.column("found")):
                words = (text or b"").split()
                factors = []
                if found.is_valid:
                    at, n, doc, source = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in fields(found, "at", "n", "source_doc", "source_at"))
                    factors = parse(at, n, doc, source & 0xFFFFFFFF, width)
                left, at = [], 0
                for start, n, _, _ in factors:
                    left += words[at:start]
                    at = start + n
                left += words[at:]
                count.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left))
                all_factors.append([dict(zip(("word", "words", "source_doc", "source_word"), f)) for f in factors])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(all_factors, kinds)],
                ["doc_id", "n_words", "n_removed", "kept", "factors"],
            )

    rows = with_texts(docs, repeats(docs, width), "at", "n", "source_doc", "source_at").select("doc_id", "text", "found")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept string, factors array<struct<word:bigint,words:bigint,source_doc:bigint,source_word:bigint>>"
    return rows.mapInArrow(run, schema)
