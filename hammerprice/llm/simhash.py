"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints that differ in at most ``bits`` bits share at least ``8 - bits`` of
their eight bytes position by position. The index posts each distinct fingerprint
under positional bytes, as many at once as any two such fingerprints surely share. In
a list the shared bytes of each pair are tallied; pairs that reach the guaranteed
minimum are verified by their real bit distance. A list yields only a spanning forest
of the links found, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import _BASE, mixed
from .shared import components, let_go, small, utf8, written

#: A posting list of more fingerprints is met part by part.
LIST_LIMIT = 20_000
#: Up to so many distinct fingerprints lists of two bytes are short enough (512 each).
PAIRED = 1 << 25
#: The shingles of one document are summed in pieces of so many.
PIECE = 1 << 15


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """64-bit SimHash of a UTF-8 text: a bit is set if it is set in over half the
    XXH64 values (seed 42) of the ``width``-word shingles, repeats included. Fewer
    words than ``width`` are one shingle; no words (or null) give 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths[:-1] + 1)))
    ends = (starts + lengths)[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts[:n].tolist(), ends)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, PIECE):
        piece = np.ascontiguousarray(hashes[i : i + PIECE]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id`` (as given) and ``fp`` (bigint holding the 64 bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, fp bigint")


def shared_bytes(x: np.ndarray, y: np.ndarray | np.uint64) -> np.ndarray:
    """In how many of their eight positions two fingerprints have the same byte."""
    z = x ^ y
    for shift in (4, 2, 1):
        z = z | z >> np.uint64(shift)
    return 8 - np.bitwise_count(z & np.uint64(0x0101010101010101))


def forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join the values of ``fps`` (uint64, distinct) as do all links of at most
    ``bits`` differing bits. Breadth first, against what is not yet reached only: a dense
    list costs a few passes. The shared bytes of each pair are tallied; only pairs that
    reach the minimum are compared bit by bit."""
    links, rest = [], fps
    frontier: list[int] = []
    while rest.size:
        if not frontier:
            frontier.append(int(rest[0]))
            rest = rest[1:]
        at = np.uint64(frontier.pop())
        near = np.flatnonzero(shared_bytes(rest, at) >= 8 - bits)
        near = near[np.bitwise_count(rest[near] ^ at) <= bits]
        if len(near):
            found = rest[near].tolist()
            links += [(int(at), x) for x in found]
            frontier += found
            rest = np.delete(rest, near)
    return links


def positions(distinct: int, bits: int) -> list[tuple[int, ...]]:
    """The byte positions of the index's lists, so that any two fingerprints with ``8 - bits``
    shared bytes have a whole list in common.

    With the positions dealt into one group less than bytes are shared, two shared bytes
    fall in one group: lists of two bytes within a group are enough (seven for four bits).
    For more fingerprints than such lists can tell apart, a list has all the bytes shared."""
    least = 8 - bits
    if least >= 2 and distinct <= PAIRED:
        return [pair for g in range(least - 1) for pair in combinations(range(g, 8, least - 1), 2)]
    return list(combinations(range(8), least))


def _post(fps: DataFrame, lists: list[tuple[int, ...]]) -> DataFrame:
    """(key, fp) for each fingerprint and list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            octets = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).astype(np.int64)
            for nth, places in enumerate(lists):
                key = np.full(len(values), nth, np.int64)
                for i in places:
                    key = key << 8 | octets[:, i]
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0)], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key bigint, fp bigint")


def _linked(postings: DataFrame, bits: int, limit: int | None) -> DataFrame:
    """Spanning links ``a``, ``b`` of each list (kind 0). Members ``a`` of lists over ``limit`` come
    back under their ``key``; kind is the number of parts to deal them into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in _lists(batches):
            fps = fps.view(np.uint64)
            lo, size = _bounds(keys)
            links: list[tuple[int, int]] = []
            for at, n in zip(lo[size > 1].tolist(), size[size > 1].tolist()):
                if limit and n > limit:
                    own = fps[at : at + n].view(np.int64)
                    columns = [np.full(n, max(2, -(-n // max(1, limit // 2))), np.int32), keys[at : at + n], own, own]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "key", "a", "b"])
                else:
                    links += forest(np.unique(fps[at : at + n]), bits)
            x = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            columns = [np.zeros(len(x), np.int32), np.zeros(len(x), np.int64), x[:, 0], x[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["kind", "key", "a", "b"])

    return postings.repartition("key").sortWithinPartitions("key").mapInArrow(run, "kind int, key bigint, a bigint, b bigint")


def links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """Links (``a``, ``b``) between distinct fingerprints (bigint column ``fp``) that
    connect the same groups as all links of at most ``bits`` (0 to 7) differing bits.

    A list of more than LIST_LIMIT fingerprints is dealt into parts, of which each two
    meet by themselves, so that no task holds more."""
    found = written(_linked(_post(fps, positions(fps.count(), bits)), bits, LIST_LIMIT), "links")
    crowded = found.where("kind > 0").select("key", F.col("kind").alias("parts"), F.col("a").alias("fp"))
    dealt = crowded.withColumn("part", F.pmod(F.xxhash64("fp"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1))).where("part != other")
    meetings = dealt.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "fp")
    return found.where("kind = 0").union(_linked(meetings, bits, None)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, bits: int = 4) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row of ``docs`` (doc_id, text).

    Fingerprints of at most ``bits`` differing bits link; a component is the closure
    of the links and is named by its smallest doc_id. Null and empty texts have
    fingerprint 0 and link like any other; equal texts fall together before any
    search. A row with a null doc_id is kept and can't give a component its name
    (null where its whole component has no id). No rows give no rows."""
    fps = written(fingerprints(docs, width), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = components(links(classes, bits))
    named = classes.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    named = written(named.join(least, "group").select("fp", "component_id"), "classes")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


# Near copies of 0.8 similarity differ in about 15 % of their bits, too many for eight
# bytes. Wide fingerprints have five lanes of eight; two bytes that agree within one lane
# are enough to meet, and two other lanes tell whether to look at the texts. What links
# is decided by the shingles themselves.

LANES = 5
#: Positions of the bytes that a list is posted under, lane by lane.
PAIRS = [(8 * g + i, 8 * g + j) for g in range(LANES) for i, j in combinations(range(8), 2)]
#: Differing bits of the two lanes (128 bits) up to which texts are compared: the number
#: expected at 0.8 (19) and four standard deviations.
WIDE_BITS = 36
#: In lists up to this size all pairs are compared at once.
SHORT = 32
#: In a longer list all pairs are looked at unless more than so many a member are near.
DENSE = 16
#: Up to so many ids of texts to compare are sent to all tasks; more meet by a shuffle.
SENT = 1 << 20


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted XXH64 values (seed 42) of the set of ``width``-word shingles of a text; none without words."""
    words = (text or b"").lower().split()
    n = max(1, len(words) - width + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + width]), 42) for i in range(n)), np.uint64, n))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """320-bit SimHash (five uint64) of a set of shingles."""
    ones = np.zeros(64 * LANES, np.int64)
    for i in range(0, len(hashes), PIECE):
        piece = hashes[i : i + PIECE]
        lanes = np.stack([piece, *(mixed(piece + np.uint64(k * _BASE % (1 << 64))) for k in range(1, LANES))], axis=1)
        ones += np.unpackbits(lanes.view(np.uint8).reshape(-1, 8 * LANES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def _node(hashes: np.ndarray) -> int:
    """The number of a set of shingles."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), 42)


_WIDE = [f"f{k}" for k in range(LANES)]


def wide_fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """``doc_id``, ``node`` (the set of shingles) and its fingerprint, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in small(batches, 1):
            sets = [shingles(t, width) for t in utf8(batch.column(1))]
            fps = np.array([wide_fingerprint(x) for x in sets], np.uint64).reshape(-1, LANES).view(np.int64)
            nodes = np.array([_node(x) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes), *(pa.array(fps[:, k]) for k in range(LANES))], ["doc_id", "node", *_WIDE])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, node bigint, " + ", ".join(f"{f} bigint" for f in _WIDE))


#: Bits of a list's key; above them stand the two parts that meet, if the list is crowded.
_LIST = 24


def _wide_post(classes: DataFrame) -> DataFrame:
    """key, node and the two lanes after the key's own, under every pair of byte positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in _WIDE], axis=1)
            octets = fps.view(np.uint8).reshape(-1, 8 * LANES).astype(np.int64)
            for nth, (i, j) in enumerate(PAIRS):
                key = nth << 16 | octets[:, i] << 8 | octets[:, j]
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("node"), *(pa.array(fps[:, (i // 8 + k) % LANES]) for k in (1, 2))], ["key", "node", "f", "g"])

    return classes.select("node", *_WIDE).mapInArrow(run, "key bigint, node bigint, f bigint, g bigint")


def _meetings(crowded: DataFrame) -> DataFrame:
    """Members of crowded lists (key, node, f, g, parts), dealt into parts of which each two
    meet under a key of their own. Every two members meet, those of one part many times."""
    part = F.pmod(F.xxhash64("node"), "parts").cast("bigint")
    dealt = crowded.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1))).where("part != other")
    meeting = F.shiftleft(F.shiftleft(F.least("part", "other"), 20).bitwiseOR(F.greatest("part", "other")), _LIST)
    return dealt.select(meeting.bitwiseOR(F.col("key")).alias("key"), "node", "f", "g")


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of two lanes."""
    return np.bitwise_count(x[..., 0] ^ y[..., 0]) + np.bitwise_count(x[..., 1] ^ y[..., 1])


def wide_forest(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places in ``fps``) that join its rows as all links of at most ``bits`` bits do,
    breadth first as in ``forest``."""
    sources, found, frontier, rest = [], [], [], np.arange(len(fps))
    while rest.size:
        if not frontier:
            frontier.append(int(rest[0]))
            rest = rest[1:]
        at = frontier.pop()
        near = _apart(fps[rest], fps[at]) <= bits
        if near.any():
            sources.append(np.full(int(near.sum()), at))
            found.append(rest[near])
            frontier += found[-1].tolist()
            rest = rest[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *sources]), np.concatenate([none, *found])


def _near_pairs(keys: np.ndarray, fps: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of at most ``bits`` differing bits in sorted lists, at most ``SHORT`` apart."""
    for d in range(1, SHORT):
        i = np.flatnonzero(keys[d:] == keys[:-d])
        if not len(i):
            return
        i = i[_apart(fps[i], fps[i + d]) <= bits]
        if len(i):
            yield i, i + d


def _tiles(fps: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of at most ``bits`` differing bits, tile by tile."""
    step = max(1, (1 << 20) // len(fps))
    for at in range(0, len(fps), step):
        i, j = np.nonzero(_apart(fps[at : at + step, None], fps[None, at:]) <= bits)
        i, j = i[i < j] + at, j[i < j] + at
        yield i, j


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted lists, many whole lists at a time (first column: their key)."""
    held: list[np.ndarray] = []
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = [np.concatenate(x) for x in zip(held, new)] if held else new
        whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last list may go on
        if whole:
            yield [c[:whole] for c in held]
            held = [c[whole:] for c in held]
    if held and len(held[0]):
        yield held


def _bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.diff(keys)) + 1
    return np.concatenate(([0], cut)), np.diff(np.concatenate(([0], cut, [len(keys)])))


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links ``a``, ``b`` and the smallest that it is joined to, itself left out:
    one link less than nodes, whatever the number of links."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    hub = np.arange(len(nodes))
    while len(a) and (hub[x] != hub[y]).any():
        low, u, v = np.minimum(hub[x], hub[y]), hub[x], hub[y]
        np.minimum.at(hub, u, low)
        np.minimum.at(hub, v, low)
        while (hub != hub[hub]).any():
            hub = hub[hub]
    return nodes[hub != np.arange(len(nodes))], nodes[hub[hub != np.arange(len(nodes))]]


def _wide_linked(postings: DataFrame, bits: int, limit: int | None) -> DataFrame:
    """kind 0: stars ``a``, ``b`` that join nodes as do all pairs of at most ``bits`` bits in a task's
    lists. Others: the members ``a`` of lists over ``limit``, under ``key``; kind is the number
    of parts to deal them into."""

    def rows(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        columns = [np.full(len(a), kind, np.int32), key, a, b, *(np.ascontiguousarray(fps[:, k]).view(np.int64) for k in (0, 1))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "key", "a", "b", "f", "g"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((2, 0), np.int64)
        for keys, nodes, f, g in _lists(batches):
            fps = np.stack([f, g], axis=1).view(np.uint64)
            lo, size = _bounds(keys)
            short = np.repeat((size <= SHORT) & (size > 1), size)
            k = nodes[short]
            found = [(k[i], k[j]) for i, j in _near_pairs(keys[short], fps[short], bits)]
            for at, n in zip(lo[size > SHORT].tolist(), size[size > SHORT].tolist()):
                key, node, own = keys[at : at + n], nodes[at : at + n], fps[at : at + n]
                if limit and n > limit:
                    yield rows(max(2, -(-n // max(1, limit // 2))), key, node, node, own)
                    continue
                some, total = [], 0
                for i, j in _tiles(own, bits):
                    some.append((node[i], node[j]))
                    total += len(i)
                    if total > DENSE * n:
                        i, j = wide_forest(own, bits)
                        some = [(node[i], node[j])]
                        break
                found += some
            a, b = _stars(*(np.concatenate(x) for x in zip((a, b), *found)))
        for i in range(0, len(a), 1 << 14):
            own = slice(i, i + (1 << 14))
            yield rows(0, np.zeros(len(a[own]), np.int64), a[own], b[own], np.zeros((len(a[own]), 2), np.uint64))

    return postings.repartition("key").sortWithinPartitions("key").mapInArrow(run, "kind int, key bigint, a bigint, b bigint, f bigint, g bigint")


#: So many links are joined into stars in one task.
SPANNED = 1 << 20


def _spanned(links: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that join the same nodes as ``links`` (a written table). The lists have a node's
    links in many tasks; few tasks leave it few of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((2, 0), np.int64)
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            a, b = _stars(np.concatenate([a, new[0]]), np.concatenate([b, new[1]]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return links.coalesce(max(1, -(-links.count() // SPANNED))).mapInArrow(run, "a bigint, b bigint")


#: A block of more texts, or with more shingles, is met part by part.
BLOCK_TEXTS, BLOCK_SHINGLES = 1 << 12, 1 << 22


def set_forest(fps: np.ndarray, sets: list[np.ndarray], bits: int, similarity: float) -> list[tuple[int, int]]:
    """Links (places) that join sets as do all pairs of a Jaccard similarity of ``similarity`` or more of
    which two lanes side by side have at most ``bits`` differing bits. Breadth first, against what is
    not yet reached only."""
    size = np.array([len(x) for x in sets])
    words, place = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    own = [place[i:j] for i, j in zip((ends - size).tolist(), ends.tolist())]
    mark = np.zeros(len(words), bool)
    links, frontier, rest = [], [], np.arange(len(sets))
    while rest.size:
        if not frontier:
            frontier.append(int(rest[0]))
            rest = rest[1:]
        at = frontier.pop()
        lanes = np.bitwise_count(fps[rest] ^ fps[at])
        near = (lanes + np.roll(lanes, -1, axis=1)).min(axis=1) <= bits
        near &= np.minimum(size[rest], size[at]) >= similarity * np.maximum(size[rest], size[at])
        some = np.flatnonzero(near)
        if not some.size:
            continue
        mark[own[at]] = True
        shared = np.array([np.count_nonzero(mark[own[k]]) for k in rest[some].tolist()])
        mark[own[at]] = False
        some = some[shared >= similarity * (size[rest[some]] + size[at] - shared)]
        found = rest[some].tolist()
        links += [(at, x) for x in found]
        frontier += found
        rest = np.delete(rest, some)
    return links


def _set_linked(blocks: DataFrame, bits: int, similarity: float) -> DataFrame:
    """The links ``a``, ``b`` of ``set_forest`` in each block (key, node, own and the lanes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, nodes, own, *lanes in _lists(batches):
            fps = np.stack(lanes, axis=1).view(np.uint64)
            a, b = [], []
            for at, n in zip(*(x.tolist() for x in _bounds(keys))):
                links = np.array(set_forest(fps[at : at + n], list(own[at : at + n]), bits, similarity), np.int64).reshape(-1, 2) + at
                a.append(nodes[links[:, 0]])
                b.append(nodes[links[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], ["a", "b"])

    return blocks.select("key", "node", "own", *_WIDE).repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def _verified(blocks: DataFrame, docs: DataFrame, classes: DataFrame, width: int, bits: int, similarity: float) -> DataFrame:
    """Links ``a``, ``b`` of nodes whose sets of shingles have a Jaccard similarity of ``similarity`` or
    more, found within blocks (node, component): a text comes to one block only, with its set."""
    none = F.lit((1 << 63) - 1)
    members = written(classes.join(blocks, "node").select("node", F.coalesce("least", none).alias("id"), F.col("component").alias("key"), *_WIDE), "members")
    wanted = written(members.select("id").distinct(), "wanted")
    if wanted.count() <= SENT:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), none).alias("id"), F.col("text").cast("string").alias("text")).join(wanted, "id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 0):
            found = [shingles(t, width) for t in utf8(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_node(x) for x in found], np.uint64).view(np.int64)), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["node", "own"])

    own = written(texts.select("text").mapInArrow(sets, "node bigint, own array<bigint>"), "shingles").dropDuplicates(["node"])
    met = written(members.drop("id").join(own, "node"), "blocks")
    sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.size("own")).alias("shingles"))
    sizes = sizes.where((F.col("texts") > BLOCK_TEXTS) | (F.col("shingles") > BLOCK_SHINGLES) & (F.col("texts") > 2))
    parts = F.ceil(F.greatest(F.col("texts") / max(1, BLOCK_TEXTS // 2), F.least("texts", F.col("shingles") / max(1, BLOCK_SHINGLES // 2))))
    large = written(sizes.select("key", F.greatest(parts, F.lit(2)).cast("bigint").alias("parts")), "large")
    found = written(_set_linked(met.join(large, "key", "left_anti"), bits, similarity), "links")
    if large.isEmpty():
        return found
    dealt = met.join(large, "key").withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).where("part != other")
    dealt = dealt.withColumn("key", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
    return found.union(written(_set_linked(dealt, bits, similarity), "links"))


def similar(docs: DataFrame, width: int = 5, bits: int = WIDE_BITS, similarity: float = 0.8) -> DataFrame:
    """``doc_id`` and ``component_id`` of every row of ``docs`` (doc_id, text): texts whose sets of
    ``width``-word shingles have a Jaccard similarity of ``similarity`` or more link. Texts
    joined by wide fingerprints of at most ``bits`` of 128 differing bits are a block, in which sets (of
    64-bit hashes) decide; pairs are met in tasks and never handed on. Texts without words link with each other; ids as in ``near_duplicates``."""
    fps = written(wide_fingerprints(docs, width), "fingerprints")
    classes = written(fps.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(f).alias(f) for f in _WIDE)), "classes")
    found = written(_wide_linked(_wide_post(classes), bits, LIST_LIMIT), "links")
    crowded = found.where("kind > 0").select("key", F.col("kind").alias("parts"), F.col("a").alias("node"), "f", "g")
    found = found.where("kind = 0").union(written(_wide_linked(_meetings(crowded), bits, None), "links")).select("a", "b")
    # All that may be similar lies in one block; within it sets are compared, and only stars leave it.
    groups = components(_verified(components(_spanned(found)), docs, classes, width, bits, similarity))
    named = classes.select("node", "least").join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    named = written(named.join(written(least, "least"), "group").select("node", "component_id"), "classes")
    return fps.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, width: int = 5, bits: int = WIDE_BITS, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of ``similar`` texts the row with
    the smallest doc_id stays, with all its columns. Rows without a doc_id stay; of
    repeated rows with that smallest doc_id all stay."""
    gone = similar(docs, width, bits, similarity).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(written(gone, "gone"), "doc_id", "left_anti").select(*docs.columns)
