"""Benchmark decontamination: word seeds by the pigeonhole principle, then Smith-Waterman alignment of words.

An alignment at the threshold matches at least ``threshold`` of an item's words, so of any
subset of its words it matches all but the rest. An item's seeds are all its words but the
ones most items hold, and few enough of these are left out that a third of the least matches
fall on seeds, whatever the corpus. Seeds are counted in stretches of the longest passage
that such an alignment spans; the item is aligned with every two neighbouring stretches
that hold enough of them, so no alignment at the threshold is lost. The score is the
alignment's share of a perfect one, so copies with edits keep most of it. Items of fewer
than ``least_words`` words match where all their words stand in a row. Benchmark items
reach the tasks in blocks of at most ``block_items`` items and ``block_chars`` characters,
each block against all rows; a larger benchmark takes more blocks, not larger ones, and the
driver holds one block at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm._common import cut, small_enough, stored
from inkfold.llm._text import words

MATCH, MISMATCH, GAP = 2, -1, -1
# Half of a perfect alignment: a copy with up to a third of its words edited; unrelated prose reaches about a third.
THRESHOLD = 0.5


class Items:
    """One block of benchmark items as word numbers, with the seeds of each item by word."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, least_words: int):
        self.vocab: dict[str, int] = {}
        self.ids, self.words = [], []
        for item_id, text in items:
            nums = [self.vocab.setdefault(w, len(self.vocab)) for w in words(text)]
            if nums:
                self.ids.append(item_id)
                self.words.append(np.array(nums, np.int32))
        held_by = np.zeros(len(self.vocab) + 1, np.int64)
        for nums in self.words:
            held_by[np.unique(nums)] += 1
        self.share = np.array([threshold if len(nums) >= least_words else 1.0 for nums in self.words])
        self.need, self.reach = np.ones(len(self.ids), np.int64), np.ones(len(self.ids), np.int64)
        of, seeds = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, nums in enumerate(self.words):
            # A score of threshold * MATCH * length takes this many matches, on a passage of at most so many words.
            least = self.share[k]
            matches = max(1, math.ceil(least * len(nums) - 1e-9))
            self.reach[k] = max(1, math.floor((1 + MATCH - least * MATCH) * len(nums) + 1e-9))
            self.need[k] = (matches + 2) // 3
            mine = np.unique(nums[np.lexsort((nums, -held_by[nums]))[matches - self.need[k] :]])
            of.append(np.full(len(mine), k, np.int64))
            seeds.append(mine)
        every, word = np.concatenate(of), np.concatenate(seeds)
        self.item = every[np.argsort(word, kind="stable")]
        self.degree = np.bincount(word.astype(np.int64), minlength=len(self.vocab) + 1)  # the last, also -1, is that of unknown words
        self.first = np.cumsum(self.degree) - self.degree

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, -1) for w in words(text)], np.int32)

    def candidates(self, texts: list[np.ndarray], most_hits: int = 2_000_000) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, start, end) of all passages with enough seeds of an item, in order of text and item."""
        lengths = np.array([len(t) for t in texts], np.int64)
        if not len(self.ids) or not lengths.sum():
            return
        nums = np.concatenate(texts)
        at = np.flatnonzero(self.degree[nums])
        nums = nums[at]
        starts = np.cumsum(lengths) - lengths
        row = np.searchsorted(starts, at, "right") - 1
        pos = at - starts[row]
        stretches = int(lengths.max() // self.reach.min()) + 3  # bin 0 and the last stay empty
        degree = self.degree[nums]
        edges = np.searchsorted(np.cumsum(degree), np.arange(0, degree.sum() + most_hits, most_hits)).tolist()
        edges[0], edges[-1] = 0, len(nums)
        keys, counts = [], []
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            d = degree[s:e]
            if not len(d):
                continue
            inner = np.arange(d.sum()) - np.repeat(np.cumsum(d) - d, d)
            item = self.item[np.repeat(self.first[nums[s:e]], d) + inner]
            key, n = np.unique((np.repeat(row[s:e], d) * len(self.ids) + item) * stretches + np.repeat(pos[s:e], d) // self.reach[item] + 1, return_counts=True)
            keys.append(key)
            counts.append(n)
        if not keys:
            return
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(back, np.concatenate(counts)).astype(np.int64)
        following = np.zeros_like(count)
        following[:-1] = np.where(key[1:] == key[:-1] + 1, count[1:], 0)
        item = key // stretches % len(self.ids)
        alone = count >= self.need[item]
        some = np.flatnonzero(alone | (count + following >= self.need[item]))
        last: list[int] | None = None
        for k, own in zip(some.tolist(), alone[some].tolist(), strict=True):
            r, i, b = int(key[k] // stretches // len(self.ids)), int(item[k]), int(key[k] % stretches) - 1
            wide = int(self.reach[i])
            s, e = max(0, (b - own) * wide), min(int(lengths[r]), (b + 2) * wide)
            if last and last[:2] == [r, i] and s <= last[3]:
                last[3] = e
                continue
            if last:
                yield tuple(last)
            last = [r, i, s, e]
        if last:
            yield tuple(last)

    def may_reach(self, item: int, passage: np.ndarray, least: float) -> bool:
        """Whether a run of the passage scores enough if each of its words that the item holds were a match."""
        held = np.zeros(len(self.vocab) + 1, bool)
        held[self.words[item]] = True
        sums = np.concatenate(([0], np.cumsum(np.where(held[passage], MATCH, GAP))))
        return bool((sums - np.minimum.accumulate(sums)).max() >= least)


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score and its end in the passage for each pair; pairs are advanced together, row by row."""
    count = len(items)
    rows, cols = max(map(len, items)), max(map(len, passages))
    a = np.full((count, rows), -2, np.int32)
    b = np.full((count, cols), -3, np.int32)
    for k, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[k, : len(x)] = x
        b[k, : len(y)] = y
    ramp = np.arange(cols, dtype=np.int32) * GAP
    above = np.zeros((count, cols + 1), np.int32)
    best, end = np.zeros(count, np.int32), np.zeros(count, np.int32)
    for i in range(rows):
        step = np.where(b == a[:, i : i + 1], MATCH, MISMATCH)
        cell = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] + GAP), 0)
        cell = np.maximum.accumulate(cell - ramp, axis=1) + ramp  # gaps along the passage
        cell[a[:, i] == -2] = 0
        top = cell.argmax(axis=1)
        value = cell[np.arange(count), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
        above[:, 1:] = cell
    return best, end


def _pieces(s: int, e: int, item: int) -> Iterator[tuple[int, int]]:
    """A long passage in overlapping pieces of bounded size; every window of twice the item's length is whole in one."""
    size, lap = max(1024, 8 * item), 2 * item + 8
    while e - s > size:
        yield s, s + size
        s += size - lap
    yield s, e


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_items: int, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Benchmark items in blocks of bounded rows and characters, streamed in order of id."""
    rows = benchmark.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, text_col).orderBy(id_col)
    block, chars = [], 0
    for row in rows.toLocalIterator():
        block.append((row[0], row[1]))
        chars += len(row[1])
        if len(block) >= block_items or chars >= block_chars:
            yield block
            block, chars = [], 0
    if block:
        yield block


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least_words: int = 5,
    threshold: float = THRESHOLD,
    block_items: int = 20_000,
    block_chars: int = 20_000_000,
) -> DataFrame:
    """id, item_id, score, end_word: one row per document row and item whose alignment reaches the threshold.

    score is the best local alignment over a perfect one (2 a word, -1 a mismatch or gap).
    Null and empty texts and items without a word match nothing; items of fewer than
    least_words words need score 1. Repeated documents each give their rows, texts of any
    length are searched whole, other columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = None
    for block in _blocks(benchmark, item_col, item_text_col, block_items, block_chars):
        part = _match_block(slim, Items(block, threshold, least_words))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "id long, item_id long, score double, end_word int")
    return found


def _match_block(docs: DataFrame, items: Items) -> DataFrame:
    """The matches of one block, written out so that its broadcast can go before the next block comes."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value

        def settle(pairs: list[tuple[int, int, int, np.ndarray]], best: dict) -> None:
            pairs.sort(key=lambda p: (len(p[3]), p[1]))
            for s in range(0, len(pairs), 128):
                some = pairs[s : s + 128]
                score, end = align([held.words[k] for _, k, _, _ in some], [w for *_, w in some])
                for (row, k, start, _), x, e in zip(some, score.tolist(), end.tolist(), strict=True):
                    share = x / (MATCH * len(held.words[k]))
                    if share >= held.share[k] - 1e-12 and (-share, start + e) < best.get((row, k), (0.0, 0)):
                        best[(row, k)] = (-share, start + e)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            best: dict[tuple[int, int], tuple[float, int]] = {}
            pairs: list[tuple[int, int, int, np.ndarray]] = []
            texts: list[np.ndarray] = []
            first = tokens = 0
            for row, text in enumerate(batch.column(1).to_pylist()):
                texts.append(held.numbers(text))
                tokens += len(texts[-1])
                if tokens < 100_000 and row + 1 < batch.num_rows:
                    continue
                for r, k, s, e in held.candidates(texts):
                    item, least = len(held.words[k]), held.share[k] * MATCH * len(held.words[k])
                    for x, y in _pieces(s, e, max(item, int(held.reach[k] + 1) // 2)):
                        passage = texts[r][x:y]
                        if held.may_reach(k, passage, least - 1e-9):
                            pairs.append((first + r, k, x, passage))
                    if len(pairs) >= 4096:
                        settle(pairs, best)
                        pairs = []
                texts, first, tokens = [], row + 1, 0
            settle(pairs, best)
            out = sorted((row, held.ids[k], -s, e) for (row, k), (s, e) in best.items())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[r] for r, *_ in out], pa.int64()),
                    pa.array([i for _, i, _, _ in out], pa.int64()),
                    pa.array([s for *_, s, _ in out], pa.float64()),
                    pa.array([e for *_, e in out], pa.int32()),
                ],
                ["id", "item_id", "score", "end_word"],
            )

    out = stored(docs.mapInArrow(search, "id long, item_id long, score double, end_word int"), "matches")
    sent.destroy()
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", most_broadcast: int = 1_000_000, **how) -> DataFrame:
    """Rows whose id matches no benchmark item; all columns are kept, rows with a null id too."""
    dirty = cut(matches(docs, benchmark, id_col, **how).where("id is not null").select(F.col("id").alias("__dirty")).distinct())
    if small_enough(dirty, most_broadcast):
        dirty = F.broadcast(dirty)
    return docs.join(dirty, docs[id_col].cast("long") == dirty["__dirty"], "left_anti")
