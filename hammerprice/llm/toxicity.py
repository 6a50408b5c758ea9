"""Toxicity by compression distance: two zstandard dictionaries, compared window by window.

The ordinary dictionary is trained by zstandard on ordinary text. Trained in the same way,
a toxic one would be full of ordinary words, which toxic texts mostly consist of, and
tell little (README gives figures). So the toxic one holds that same
text followed by the segments that set toxic text apart, the most frequent nearest;
in the ordinary one a filler of equal length stands in their place, so that offsets
cost the same and a window's two lengths differ only where it repeats a toxic
segment. A document's figure is the most bytes that the toxic dictionary saves on any
of its windows; a monotone calibration on labelled rows turns it into a probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held, small, utf8

#: Words of a window, words from one window to the next (windows overlap, so that no passage
#: falls on an edge), and bytes of the shortest match that counts.
WINDOW, STRIDE, MATCH = 12, 6, 5
#: zstandard starts no match in the last bytes of its input; windows end in so many more.
_TAIL = b"\0" * 12
#: A figure of so many bytes or more is calibrated alike.
TOP = 16


@dataclass
class Model:
    """Both dictionaries, and the calibrated probability for each figure from 0 to TOP."""

    ordinary: bytes
    toxic: bytes
    probability: list[float]


def windows(text: bytes | None) -> list[bytes]:
    words = (text or b"").lower().split()
    last = max(1, len(words) - WINDOW + STRIDE) if words else 0
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " + _TAIL for i in range(0, last, STRIDE)]


class Scorer:
    """``saved(text)``: the most bytes saved on a window, and that window's number."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.compress = [self._with(ordinary), self._with(toxic)]

    @staticmethod
    def _with(content: bytes):
        parameters = zstandard.ZstdCompressionParameters(
            window_log=16, hash_log=14, chain_log=14, search_log=4, min_match=MATCH, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_dict_id=False
        )
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=parameters)
        return zstandard.ZstdCompressor(dict_data=data, compression_params=parameters).compress

    def saved(self, text: bytes | None) -> tuple[int, int]:
        ordinary, toxic = self.compress
        best, at = 0, -1
        for k, window in enumerate(windows(text)):
            n = len(ordinary(window)) - len(toxic(window))
            if n > best:
                best, at = n, k
        return best, at


def _grams(word: bytes) -> list[bytes]:
    word = b" " + word + b" "
    return [word[i : i + MATCH] for i in range(max(1, len(word) - MATCH + 1))]


def _frequency(texts: list[bytes]) -> Counter:
    seen: Counter = Counter()
    for text in texts:
        seen.update({g for w in set(text.lower().split()) for g in _grams(w)})
    return seen


def segments(toxic: list[bytes], ordinary: list[bytes], share: float = 0.01, ratio: float = 60.0, most: int = 400) -> bytes:
    """The toxic dictionary's own part: runs of byte 5-grams that at least ``share`` of the
    toxic texts have, ``ratio`` times as large a share as of the ordinary ones; of those in
    five texts or more the ``most`` frequent ones, so that the dictionary is bounded."""
    t, o = _frequency(toxic), _frequency(ordinary)
    apart = {g for g, n in t.items() if n >= max(5, share * len(toxic)) and n / len(toxic) > ratio * (o[g] + 1) / len(ordinary)}
    runs: Counter = Counter()
    for text in toxic:
        for word in set(text.lower().split()):
            run = b""
            for g in [*_grams(word), b""]:
                if g in apart:
                    run = run + g[-1:] if run else g
                elif run:
                    runs[run] += 1
                    run = b""
    kept = [r for r, n in runs.most_common(most) if n >= 5]
    return b"\0".join([b"", *reversed(kept), b""])


def _calibrated(toxic: list[int], ordinary: list[int], rate: float) -> list[float]:
    """Probability of the label for each figure, never falling (pool adjacent violators)."""
    t, o = (np.bincount(np.minimum(x, TOP), minlength=TOP + 1) for x in (toxic, ordinary))
    up = (t + 0.05) / (len(toxic) + 0.05 * (TOP + 1)) * rate
    down = (o + 0.05) / (len(ordinary) + 0.05 * (TOP + 1)) * (1 - rate)
    pools: list[list[float]] = []  # mass, positive mass, figures
    for a, b in zip(up, down):
        pools.append([a + b, a, 1])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    return [a / m for m, a, n in pools for _ in range(int(n))]


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = 1500, ordinary_rows: int = 3000, windows_used: int = 60_000, most: int = 400) -> Model:
    """Fits a model on labelled rows whose crc32(doc_id as text) mod 4 is not 2.

    ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1; a document with several
    labels counts as toxic if one says so, null labels count for nothing). The fit
    uses at most ``toxic_rows`` and ``ordinary_rows`` rows, those with the smallest
    hashed doc_ids: two thirds for the dictionaries, one third for the calibration.
    The ordinary dictionary is trained on ``windows_used`` of its windows at most, taken
    evenly over all sampled texts; ``most`` bounds the toxic segments. Only the doc_ids of
    that bounded sample are broadcast and only its texts come to the driver. Without rows of both labels the model knows no toxic segments."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    take = [known.where(f"toxic = {k}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, toxic_rows), (0, ordinary_rows))]
    sample = F.broadcast(take[0].union(take[1]))  # toxic_rows + ordinary_rows rows at most
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(sample, "doc_id")
    held: list[list[tuple[int, bytes]]] = [[], []]
    for r in rows.select("toxic", "text", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("third")).distinct().toLocalIterator():
        held[int(r["toxic"])].append((r["third"], r["text"].encode()))
    for texts in held:
        texts.sort()
    fit = [[t for k, t in texts if k] or [t for _, t in texts] for texts in held]
    check = [[t for k, t in texts if not k] or [t for _, t in texts] for texts in held]
    cut = [w[: -len(_TAIL)] for t in fit[0] for w in windows(t)]
    cut = cut[:: max(1, -(-len(cut) // windows_used))]
    try:
        ordinary = zstandard.train_dictionary(4096, cut).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from
        ordinary = b"".join(cut)[:4096]
    own = segments(*reversed(fit), most=most) if fit[0] and fit[1] else b"\0\0"
    filler = np.random.default_rng(7).integers(1, 32, len(own)).astype(np.uint8).tobytes()
    model = Model(ordinary + filler, ordinary + own, [0.0] * (TOP + 1))
    if count:
        scorer, rate = Scorer(model.ordinary, model.toxic), count.get(1, 0) / sum(count.values())
        figures = [[scorer.saved(t)[0] for t in texts] for texts in check]
        model.probability = _calibrated(figures[1], figures[0], rate) if figures[0] and figures[1] else [rate] * (TOP + 1)
    return model


def _scorer(model: Model) -> Scorer:
    return held(("scorer", model.ordinary, model.toxic), lambda: Scorer(model.ordinary, model.toxic))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1), ``saved`` (bytes) and ``window`` (number of the window
    of 12 words that saved them, -1 if none) for every row of ``docs`` (doc_id, text).
    Whole texts are scored; null and empty texts have the score of a text without
    toxic windows. Each row is scored by itself, repeated ones too."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, probability = _scorer(sent.value), sent.value.probability
        for batch in small(batches, 1):
            found = [scorer.saved(t) for t in utf8(batch.column(1))]
            score = [probability[min(n, TOP)] for n, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array([n for n, _ in found], pa.int32()), pa.array([k for _, k in found], pa.int64())], ["doc_id", "score", "saved", "window"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double, saved int, window bigint")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pd.Series) -> pd.Series:
        scorer, probability = _scorer(sent.value), sent.value.probability
        return pd.Series([probability[min(scorer.saved((t or "").encode())[0], TOP)] for t in texts], dtype="float64")

    return docs.where(F.pandas_udf(score, "double")(F.col("text").cast("string")) < threshold)
