"""Exact substring deduplication: bytes covered by a string of ``length`` bytes that starts anywhere else.

Any such string holds one anchor that its content alone chooses (the window's smallest
hash of a gram, see ``gram_bytes``), so equal strings have equal anchors at equal places. Anchors
whose gram is unique drop out. Equal surroundings of an anchor settle it at once; of the
rest one representative of each surrounding meets the others with its gram. There the
suffixes that start at the anchors are put in order by deep-shallow sorting, multikey
quicksort down to a shallow depth and blind tries for what is still equal; in each
interval of the sorted suffixes with a common prefix, the same order on the reversed
left sides gives each member's longest common left side, and what the two reach
together is repeated text. A gram with more than ``hot`` different surroundings is
settled by counting hashes of all its windows instead, which no task has to gather.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm._common import cut, stored

SHALLOW = 24  # bytes that multikey quicksort looks at
_CHUNK = 1 << 19
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = [np.uint64(int(x) | 1) for x in _RNG.integers(1 << 40, 1 << 62, 16, dtype=np.uint64)]
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 20) - 1)


def gram_bytes(length: int) -> int:
    """The largest power of two within half a window: long enough that prose hardly repeats it by chance, short enough for few anchors."""
    return 1 << (length // 2).bit_length() - 1


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram at each position, by doubling the hashed length."""
    h, n = _BYTE[text], 1
    for f in _FACTOR[: gram.bit_length() - 1]:
        h = h[:-n] * f + h[n:]
        n *= 2
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors of all windows; none in texts shorter than a window."""
    if len(text) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    data = np.frombuffer(text, np.uint8)
    gram = gram_bytes(length)
    span = length - gram + 1
    found_at, found = [], []
    for s in range(0, len(text) - length + 1, _CHUNK):
        h = gram_hashes(data[s : s + _CHUNK + length - 1], gram)
        key = (h & ~_LOW) | (np.arange(len(h), dtype=np.uint64) & _LOW)  # ties go to the leftmost
        low, n = key, 1
        while 2 * n <= span:
            low = np.minimum(low[:-n], low[n:])
            n *= 2
        if n < span:
            low = np.minimum(low[: len(key) - span + 1], low[span - n :])
        at = (low & _LOW).astype(np.int64)
        at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        found_at.append(at + s)
        found.append(h[at])
    at, h = np.concatenate(found_at), np.concatenate(found)
    at, first = np.unique(at, return_index=True)
    return at, h[first]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Compact trie whose inner nodes hold a depth and branch on the byte there; strings are looked at again only once per insertion."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root = None  # leaf: list of indices; inner node: (depth, {byte: node}), -1 for the end of a string

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):  # blind: only branching bytes are compared
            d = node[0]
            node = node[1].get(s[d] if d < len(s) else -1) or next(iter(node[1].values()))
        other = self.strings[node[0]]
        same = common_prefix(s, other)
        if same == len(s) == len(other):
            node.append(i)
            return
        parent, byte, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < same:
            parent, byte = node, (s[node[0]] if node[0] < len(s) else -1)
            node = node[1][byte]
        mine = s[same] if same < len(s) else -1
        if isinstance(node, tuple) and node[0] == same:
            node[1][mine] = [i]
            return
        fresh = (same, {mine: [i], (other[same] if same < len(other) else -1): node})
        if parent is None:
            self.root = fresh
        else:
            parent[1][byte] = fresh

    def ordered(self) -> list[int]:
        out, todo = [], [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def deep_shallow_sort(strings: list[bytes], start: int = 0, shallow: int = SHALLOW) -> list[int]:
    """Indices of strings in order; strings agree before ``start`` or are compared from the first byte with start 0."""
    out: list[int] = []
    todo = [(list(range(len(strings))), start)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) == 1:
            out += rows
            continue
        if depth >= start + shallow or len(rows) == 2:
            trie = BlindTrie(strings)
            for i in rows:
                trie.insert(i)
            out += trie.ordered()
            continue
        byte = [strings[i][depth] if depth < len(strings[i]) else -1 for i in rows]
        pivot = sorted(byte)[len(byte) // 2]
        less = [i for i, b in zip(rows, byte, strict=True) if b < pivot]
        same = [i for i, b in zip(rows, byte, strict=True) if b == pivot]
        more = [i for i, b in zip(rows, byte, strict=True) if b > pivot]
        if more:
            todo.append((more, depth))
        if pivot == -1:
            todo.append((same, start + shallow))
        else:
            todo.append((same, depth + 1))
        if less:
            todo.append((less, depth))
    return out


def reaches(left: list[bytes], right: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(row, bytes to the left, bytes to the right) of repeated text around anchors of one gram.

    left: reversed bytes before each anchor; right: bytes from it on. Rows differ in at least one side.
    """
    order = deep_shallow_sort(right)
    lcp = [common_prefix(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    out = []
    most = max(map(len, left))
    stack: list[tuple[int, int]] = []  # (depth, first place) of open intervals of the sorted suffixes
    for k, depth in enumerate([*lcp, -1]):
        first = k
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            if d + most >= length:
                rows = sorted(order[first : k + 1], key=left.__getitem__)
                near = [common_prefix(left[a], left[b]) for a, b in zip(rows, rows[1:], strict=False)]
                for r, x, y in zip(rows, [0, *near], [*near, 0], strict=True):
                    if max(x, y) + d >= length:
                        out.append((r, max(x, y), d))
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))
    return out


def _sides(text: bytes, at: int, length: int) -> tuple[bytes, bytes]:
    return text[max(0, at - length + gram_bytes(length)) : at], text[at : at + length]


def repeated(docs: DataFrame, length: int = 200, hot: int = 20_000) -> DataFrame:
    """row, start, finish: byte ranges whose union is all repeated text. docs: row (unique long), text."""
    slim = docs.select("row", F.col("text").cast("binary").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One line per gram and surrounding of a text; those that it repeats itself are settled here and carry their ranges.
            out: list[tuple[int, int, int, int, int, list[int] | None]] = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or b""
                at, h = anchors(text, length)
                met: dict[tuple[int, int], list[int]] = {}
                for a, g in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                    x, y = _sides(text, a, length)
                    met.setdefault((g, xxhash.xxh64_intdigest(x + y, len(x)) - (1 << 63)), []).append(a)
                for (g, k), places in met.items():
                    ends = None
                    if len(places) > 1:
                        ends = [v for r in merged([(max(0, a - reach), a + length) for a in places], len(text)) for v in r]
                    out.append((g, k, len(places), row, places[0], ends))
                if len(out) > 50_000:
                    yield _found(out)
                    out = []
            yield _found(out)

    reach = length - gram_bytes(length)
    every = slim.mapInArrow(find, "gram long, around long, n long, row long, at long, ends array<long>")
    shared = every.groupBy("gram").agg(F.sum("n").alias("n"), (F.min("around") != F.max("around")).alias("mixed")).where("n > 1").select("gram", "mixed")
    # Written first, so that the join reads two plain shuffles and Spark can split a crowded gram's side.
    known = stored(every.join(stored(shared, "grams"), "gram"), "anchors")
    surroundings = cut(known.where("mixed").groupBy("gram", "around").agg(F.sum("n").alias("n"), F.min(F.struct("row", "at")).alias("one")))
    # Equal surroundings: all of them is repeated.
    own = known.where("ends is not null").select("row", F.explode(F.transform(F.sequence(F.lit(0), F.size("ends") - 2, F.lit(2)), lambda k: F.slice("ends", k + 1, F.lit(2)))).alias("e"))
    alone = known.where("ends is null")
    settled = alone.where("not mixed").select("row", "at").unionByName(
        alone.where("mixed").join(surroundings.where("n > 1").select("gram", "around"), ["gram", "around"], "left_semi").select("row", "at")
    )
    whole = settled.select("row", F.greatest(F.col("at") - reach, F.lit(0)).alias("start"), (F.col("at") + length).alias("finish"))
    whole = whole.unionByName(own.select("row", F.col("e")[0].alias("start"), F.col("e")[1].alias("finish")))
    crowded = surroundings.groupBy("gram").count().where(F.col("count") > hot).select("gram")
    wanted = surroundings.select("gram", "one.row", "one.at").join(crowded.withColumn("crowded", F.lit(True)), "gram", "left")
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("gram", "at", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("wanted"))
    texts = slim.join(lists, "row").select("row", "text", "wanted")

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, text, some in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                for w in some:
                    if not w["crowded"]:
                        x, y = _sides(text, w["at"], length)
                        out.append((w["gram"], row, w["at"], x[::-1], y))
                        if len(out) >= 20_000:
                            yield _columns(out)
                            out = []
            yield _columns(out)

    shown = texts.mapInArrow(show, "gram long, row long, at long, before binary, after binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, held = None, []
        out: list[tuple[int, int, int]] = []

        def settle() -> None:
            if len(held) > 1:
                for r, x, y in reaches([h[2] for h in held], [h[3] for h in held], length):
                    out.append((held[r][0], held[r][1] - x, held[r][1] + y))

        for batch in batches:
            for g, row, at, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != gram:
                    settle()
                    gram, held = g, []
                held.append((row, at, before, after))
            yield _ranges(out)
            out = []
        settle()
        yield _ranges(out)

    met = shown.repartition("gram").sortWithinPartitions("gram").mapInArrow(compare, "row long, start long, finish long")
    found = whole.unionByName(met)
    if crowded.limit(1).count():
        found = found.unionByName(_counted(texts, length))
    return found


def _found(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [()] * 6
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["gram", "around", "n", "row", "at", "ends"])


def _columns(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [()] * 5
    kinds = [pa.int64()] * 3 + [pa.binary()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["gram", "row", "at", "before", "after"])


def _ranges(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = np.array(out, np.int64).reshape(-1, 3)
    return pa.RecordBatch.from_arrays([pa.array(cols[:, k]) for k in range(3)], ["row", "start", "finish"])


def _counted(texts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of crowded grams, by counting 128-bit hashes of every window around their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, some in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                starts = {p for w in some if w["crowded"] for p in range(max(0, w["at"] - length + gram_bytes(length)), min(w["at"], len(text) - length) + 1)}
                starts = sorted(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(text[p : p + length]) for p in starts], pa.binary()), pa.array([row] * len(starts), pa.int64()), pa.array(starts, pa.int64())],
                    ["window", "row", "start"],
                )

    windows = stored(texts.mapInArrow(run, "window binary, row long, start long"), "windows")
    twice = windows.groupBy("window").count().where(F.col("count") > 1).select("window")
    return windows.join(twice, "window").select("row", "start", (F.col("start") + length).alias("finish"))


def merged(ranges: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of byte ranges, cut to the text."""
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        e = min(e, size)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, hot: int = 20_000) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary: the remaining bytes) per input row.

    Null text counts as empty. Unique ids name the rows; where ids repeat or are null, a
    numbered copy of the table is written first, and equal rows count as two texts.
    """
    if length < 4:
        raise ValueError("length must be at least 4")
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    n = slim.agg(F.count("*").alias("all"), F.countDistinct("id").alias("ids")).first()
    if n["all"] == n["ids"] and docs.schema[id_col].dataType.typeName() in ("long", "integer"):
        rows = slim.select(F.col("id").cast("long").alias("row"), "id", "text")
    else:
        rows = stored(slim.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "text"), "numbered")
    ranges = repeated(rows, length, hot).distinct().groupBy("row").agg(F.collect_list(F.struct("start", "finish")).alias("ranges"))
    id_type = rows.schema["id"].dataType.simpleString()
    joined = rows.select("row", "id", F.col("text").cast("binary").alias("text")).join(ranges, "row", "left").select("id", "text", "ranges")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                runs = merged([(r["start"], r["finish"]) for r in ranges or ()], len(text))
                cuts = [0, *(x for run in runs for x in run), len(text)]
                kept = b"".join(text[s:e] for s, e in zip(cuts[::2], cuts[1::2], strict=True)) if runs else text
                out.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(remove, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
