"""Pattern packing by non-negative least squares.

Texts are tokenised and cut into pieces of at most ``capacity`` tokens. Only the histogram of piece lengths (``capacity``
numbers at most, counted by Spark over all pieces) reaches the driver. There, patterns of two or three lengths that fill
a sequence exactly are enumerated, their repeat counts are fitted to the histogram by non-negative least squares, rounded,
and the residual histogram is packed by best fit. The plan is a table of (length, first rank, repeats, first sequence,
offset), whose size depends on ``capacity`` alone; each piece finds its place from its rank among the pieces of its length.

Defined results: a null text is an empty one: a single end-of-text token. A null id is kept as null. Repeated rows are
packed each by itself. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import pin

#: Pieces in one numbering window, about.
BLOCK_ROWS = 50_000
_BESIDE = re.compile(r" [^\S ]|[^\S ] ")


@lru_cache
def _vocabulary(path: str):
    """The byte-level BPE of a ``tokenizers`` file as an encoder of single chunks, and its special tokens."""
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    ranks_path = os.path.splitext(path)[0] + ".tiktoken"
    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding, tuple(x["content"] for x in spec.get("added_tokens", []))


@lru_cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Chunks:
    """Chunk (a word with its leading space) -> its ids as little-endian bytes; emptied when it gets large."""

    def __init__(self, path: str):
        self.encoding, self.special = _vocabulary(path)
        self.path, self.known = path, {}
        self.opens = np.array([self.encoding.decode_single_token_bytes(i)[:1] == b" " for i in range(self.encoding.max_token_value + 1)])

    def learn(self, chunks: set[str]) -> None:
        if len(self.known) > 500_000:
            self.known = {}
        new = [c for c in chunks if c not in self.known]
        if not new:
            return
        # One call for all: in such a text, just the first token of each chunk starts with a space.
        ids = np.array(self.encoding.encode_ordinary(" " + " ".join(new)), "<u4")
        data, at = ids.tobytes(), (np.append(np.flatnonzero(self.opens[ids]), len(ids)) * 4).tolist()
        self.known.update(zip(new, map(data.__getitem__, map(slice, at, at[1:]))))

    def encoded(self, texts: list[str | None]) -> list[bytes]:
        split = []
        for text in texts:
            chunks = text.split(" ") if text else []
            plain = len(chunks) > 1 and not any(s in text for s in self.special) and not self.edges(text, chunks)
            split.append(chunks if plain else None)
        self.learn({c for chunks in split if chunks for c in chunks[1:]})
        known, out = self.known.__getitem__, []
        for text, chunks in zip(texts, split):
            if chunks:
                out.append(self.whole(chunks[0]) + b"".join(map(known, chunks[1:])))
            else:
                out.append(self.whole(text or ""))
        return out

    @staticmethod
    def edges(text: str, chunks: list[str]) -> bool:
        """Whether white space stands beside a space or at an end."""
        return text[0].isspace() or text[-1].isspace() or "" in chunks or bool(_BESIDE.search(text))

    def whole(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(_tokenizer(self.path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()


@lru_cache
def _chunks(path: str) -> _Chunks:
    return _Chunks(path)


def ids_of(texts: list[str | None], path: str) -> list[bytes]:
    """The texts' token ids as little-endian 32-bit numbers, as the ``tokenizers`` library gives them.

    A space belongs to the word after it, so text between single spaces is encoded chunk by chunk and chunks are
    remembered. Where white space stands next to a space or at an end, the whole text is encoded at once.
    """
    return _chunks(path).encoded(texts)


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only a text over the capacity is cut, and its first piece may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)] if n > capacity else [(0, n)]


def _cut(path: str, end_id: int, capacity: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            out = defaultdict(list)
            for i, ids in enumerate(ids_of(batch.column("text").to_pylist(), path)):
                ids += end
                for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    out["row"].append(i), out["piece"].append(k), out["start"].append(start), out["length"].append(length)
                    out["crc"].append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(out["row"], pa.int32())),
                    pa.array(out["piece"], pa.int32()),
                    pa.array(out["start"], pa.int64()),
                    pa.array(out["length"], pa.int64()),
                    pa.array(out["crc"], pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def exact_patterns(histogram: np.ndarray, capacity: int) -> np.ndarray:
    """Triples (a >= b >= c, c may be 0) of lengths at hand that fill a sequence exactly."""
    there = np.flatnonzero(histogram[1:]) + 1
    there = there[there < capacity]
    if not len(there):
        return np.empty((0, 3), np.int64)
    a, b = np.meshgrid(there, there, indexing="ij")
    c = capacity - a - b
    ok = (a >= b) & (b >= c) & (c >= 0)
    ok &= (c == 0) | (histogram[np.clip(c, 0, capacity)] > 0)
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def fitted(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise ||A x - histogram||, by accelerated projected gradient steps."""
    size = len(histogram)
    used = patterns > 0

    def total(x):  # A x
        out = np.zeros(size)
        for k in range(patterns.shape[1]):
            out += np.bincount(patterns[:, k], x * used[:, k], size)
        return out

    def back(r):  # A' r
        return (r[patterns] * used).sum(axis=1)

    # The largest eigenvalue of A'A is at most its largest row sum of absolute values.
    step = 1.0 / max(back(total(np.ones(len(patterns)))).max(initial=1.0), 1.0)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(total(y) - histogram))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((new - x) * (y - new)).sum() > 0:  # restart when momentum points uphill
            t_new, y = 1.0, new
        else:
            y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up the histogram of lengths exactly."""
    left = histogram.astype(np.int64).copy()
    chosen: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        chosen.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    patterns = exact_patterns(left, capacity)
    repeats = fitted(patterns, left.astype(float))
    for i in np.argsort(-repeats, kind="stable"):
        if repeats[i] < 0.5:
            break
        lengths, times = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
        n = int(min(round(float(repeats[i])), (left[lengths] // times).min()))
        if n > 0:
            left[lengths] -= n * times
            chosen.append((tuple(int(v) for v in patterns[i] if v), n))
    # Residuals, by best fit: fill from the longest piece down, ending with the two lengths that fill best.
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        left[top] -= 1
        bin_, room = [top], capacity - top
        while room > 0:
            fits = np.flatnonzero(left[: room + 1])
            if not len(fits):
                break
            pick = int(fits[-1])
            if pick < room and len(fits) > 1:
                # Two pieces that fill the room exactly beat the longest single one.
                other = room - fits
                good = fits[(other > 0) & (left[np.clip(other, 0, capacity)] >= 1 + (other == fits))]
                pick = int(good[-1]) if len(good) else pick
            left[pick] -= 1
            room -= pick
            bin_.append(pick)
        counts = np.bincount(bin_, minlength=capacity + 1)
        used = np.flatnonzero(counts)
        n = int((left[used] // counts[used]).min())
        left[used] -= n * counts[used]
        chosen.append((tuple(bin_), 1 + n))
    return chosen


def places(chosen: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset) by first rank."""
    rows, used, first = defaultdict(list), defaultdict(int), 0
    for lengths, repeats in chosen:
        offset = 0
        for length in lengths:
            rows[length].append((used[length], first, offset))
            used[length] += repeats
            offset += length
        first += repeats
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def _placed(table: dict[int, np.ndarray]):
    def run(frames):
        for frame in frames:
            length, rank = frame["length"].to_numpy(), frame.pop("rank").to_numpy()
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for value in np.unique(length):
                at, rows = np.flatnonzero(length == value), table[int(value)]
                k = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
                sequence[at] = rows[k, 1] + rank[at] - rows[k, 0]
                offset[at] = rows[k, 2]
            yield frame.assign(sequence_id=sequence, offset=offset)

    return run


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = pin(docs.mapInArrow(_cut(path, end_id, capacity), schema))
    counted = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counted:
        histogram[length] = n
    if not counted:
        return pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    table = places(plan(histogram, capacity))
    # Ranks among equal lengths: numbered within blocks of a bounded size, plus the rows of the blocks before.
    blocks = max(1, int(histogram.sum()) // BLOCK_ROWS)
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int"))
    before = pieces.groupBy("length", "block").count()
    before = before.selectExpr("length", "block", "sum(count) over (partition by length order by block) - count as before")
    ranked = pieces.join(before, ["length", "block"]).selectExpr(
        "doc_id", "piece", "start", "length", "ids_crc32",
        "before + row_number() over (partition by length, block order by doc_id, piece) - 1 as rank",
    )
    return ranked.mapInPandas(_placed(table), f"{schema}, sequence_id long, offset long")
