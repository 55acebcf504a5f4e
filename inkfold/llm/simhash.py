"""SimHash near-duplicates: tiled exact Hamming comparison with numpy.

Equal fingerprints collapse first. Rows meet in buckets: at a small radius the bits are cut
into radius + 1 blocks, of which two fingerprints within the radius share one, so nothing
is lost; at the wide radius of a set similarity, long fingerprints meet where they agree on
samples of bits, as many samples as the asked recall takes at the corpus' size, and the
sets of those that meet are compared exactly. Inside a
bucket, rows sorted by population count form tiles; tile pairs whose counts differ by more
than the radius are skipped, the others are compared by exclusive-or and bit counts. Each
bucket emits a spanning forest of its links, not all pairs. A bucket above ``hot`` rows is
dealt out as pairs of its blocks, so that no task holds more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm._common import cut, small_enough, stored
from inkfold.llm._graph import connected_components

SEED = 42
TILE = 1024


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every word shingle of lower-cased text, repeats included."""
    words = text.lower().split()  # ASCII letters, ASCII whitespace only
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - width] + 1)).tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:z], SEED) for a, z in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fold(hashes: np.ndarray) -> int:
    """64 bits, bit i 1 if set in over half of the hashes; zero without hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """id, fp (the 64 bits as a signed long) of each whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fold(shingle_hashes(t or b"", width)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "id long, fp long")


def forest(fps: np.ndarray, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (node, root) of a spanning forest of the links among fps (rows of one or more 64-bit lanes)."""
    fps = fps.reshape(len(fps), -1)
    pops = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    order = np.argsort(pops, kind="stable")
    f, pops = np.ascontiguousarray(fps[order].T), pops[order]
    n = len(pops)
    root = np.arange(n)
    for i in range(0, n, tile):
        x, top = f[:, i : i + tile], pops[min(i + tile, n) - 1]
        for j in range(i, n, tile):
            if pops[j] - top > radius:
                break
            apart = np.bitwise_count(x[0][:, None] ^ f[0][None, j : j + tile]).astype(np.uint16 if len(f) > 1 else np.uint8, copy=False)
            for lane in range(1, len(f)):
                apart += np.bitwise_count(x[lane][:, None] ^ f[lane][None, j : j + tile])
            a, b = np.nonzero(apart <= radius)
            a, b = a + i, b + j
            keep = root[a] != root[b]
            a, b = a[keep], b[keep]
            while len(a):
                ra, rb = root[a], root[b]
                np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
                while (root[root] != root).any():
                    root = root[root]
                keep = root[a] != root[b]
                a, b = a[keep], b[keep]
    child = np.nonzero(root != np.arange(n))[0]
    return order[child], order[root[child]]


def shared_blocks(distinct: DataFrame, radius: int) -> DataFrame:
    """f0, rep, block, value: each fingerprint under every one of its radius + 1 bit blocks. distinct: f0 (unique), rep (long)."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    cuts = [F.shiftrightunsigned("f0", low).bitwiseAND(F.lit((1 << (high - low)) - 1)).cast("long") for low, high in zip(edges, edges[1:], strict=False)]
    keys = F.array(*[F.struct(F.lit(k).cast("long").alias("block"), c.alias("value")) for k, c in enumerate(cuts)])
    return distinct.select("f0", "rep", F.explode(keys).alias("k")).select("f0", "rep", "k.block", "k.value")


def bit_samples(lanes: int, rows: int, agree: float, recall: float, per_bucket: int = 2048, seed: int = SEED) -> np.ndarray:
    """Samples of bit places (one row each): enough that two fingerprints agreeing on a share ``agree`` of all bits share one with the asked probability.

    Samples are as long as keeps about per_bucket unrelated rows of ``rows`` in a bucket: the
    longer they are, the more of them it takes, and comparing costs less than sending.
    """
    size = int(min(48, max(4, math.ceil(math.log2(max(2, rows) / per_bucket)))))
    many = max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**size)))
    rng = np.random.default_rng(seed)
    return np.stack([rng.choice(64 * lanes, size, replace=False) for _ in range(many)])


def shared_samples(distinct: DataFrame, lanes: int, samples: np.ndarray) -> DataFrame:
    """f0, f1, ..., rep, block, value: each fingerprint under its bits at every sample."""
    weight = np.zeros((64 * lanes, len(samples)))
    for k, places in enumerate(samples):
        weight[places, k] = 2.0 ** np.arange(len(places))  # sums stay whole below 2**53
    names = [f"f{k}" for k in range(lanes)] + ["rep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                cols = [c.slice(s, 2048).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
                bits = np.unpackbits(np.stack(cols[:-1], axis=1).view(np.uint8), axis=1, bitorder="little")
                value = (bits.astype(np.float64) @ weight).astype(np.int64)
                n, many = value.shape
                yield pa.RecordBatch.from_arrays([*[pa.array(np.repeat(c, many)) for c in cols], pa.array(np.tile(np.arange(many), n)), pa.array(value.ravel())], [*names, "block", "value"])

    return distinct.select(*names).mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "block", "value"]))


def links(keyed: DataFrame, radius: int, lanes: int = 1, hot: int = 20_000) -> DataFrame:
    """a, b: representatives of fingerprints at radius or fewer differing bits that share a bucket (a spanning set of such links).

    keyed: f0, ..., rep, block, value. A bucket above hot rows is dealt out as all pairs of its blocks of about hot rows.
    """
    crowded = keyed.groupBy("block", "value").count().where(F.col("count") > hot).select("block", "value", F.ceil(F.col("count") / hot).cast("int").alias("blocks"))
    rows = keyed.join(crowded, ["block", "value"], "left")
    mine = F.pmod(F.xxhash64("f0", "rep"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, mine).alias("i"), F.greatest(k, mine).alias("j")))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    names = [f"f{k}" for k in range(lanes)] + ["rep"]
    head = len(names)
    dealt = rows.select(*names, "block", "value", F.explode(F.coalesce(pairs, one)).alias("p")).select(*names, "block", "value", "p.i", "p.j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((rows[1:, head:] != rows[:-1, head:]).any(axis=1)) + 1
            bounds = np.concatenate(([0], cuts, [len(rows)]))
            a, b = [], []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                if e - s > 1:
                    x, y = forest(np.ascontiguousarray(rows[s:e, :lanes]).view(np.uint64), radius)
                    a.append(rows[s:e, lanes][x])
                    b.append(rows[s:e, lanes][y])
            none = np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            same = (rows[:, head:] == rows[-1, head:]).all(axis=1)
            first = int(np.argmax(same))  # start of the bucket that may go on in the next batch
            if first:
                yield flush(np.concatenate([*held, rows[:first]]))
                held = []
            held.append(rows[first:])
        if held:
            yield flush(np.concatenate(held))

    key = ["block", "value", "i", "j"]
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, hot: int = 20_000) -> DataFrame:
    """id, fp, component_id per row.

    component_id is the smallest id reachable over links, itself included. Null text is
    empty; texts without words have fingerprint zero and link like any other. Rows with
    a null id keep their fingerprint and get a null component. Other columns are ignored.
    """
    fps = stored(fingerprints(docs, id_col, text_col, width), "simhash")
    distinct = fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep"))
    parts = connected_components(links(shared_blocks(distinct.withColumnRenamed("fp", "f0"), radius), radius, 1, hot))
    labels = distinct.join(parts, distinct["rep"] == parts["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(labels, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def wide_fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, lanes: int) -> DataFrame:
    """id, same (a digest of the set of shingles), f0, f1, ... of each whole text's set of shingles."""
    odd = np.random.default_rng(SEED).integers(1, 1 << 63, lanes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, fps = [], []
            for t in batch.column(1).to_pylist():
                h = np.unique(shingle_hashes(t or b"", width))
                same.append(xxhash.xxh3_128_digest(h.tobytes()))
                fps.append([fold(_mixed(h, m)) for m in odd])
            lane = np.array(fps, np.uint64).reshape(-1, lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), *[pa.array(lane[:, k]) for k in range(lanes)]], ["id", "same", *[f"f{k}" for k in range(lanes)]])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return slim.mapInArrow(run, "id long, same binary, " + ", ".join(f"f{k} long" for k in range(lanes)))


def _mixed(hashes: np.ndarray, odd: np.uint64) -> np.ndarray:
    """New hashes of hashes."""
    h = hashes * odd
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def differing_share(similarity: float) -> float:
    """Expected share of differing bits between sets of equal size and this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, set: the sorted hashes of the word shingles of the texts whose ids are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                sets = [np.unique(shingle_hashes(t or b"", width)).view(np.int64) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["id", "set"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).join(ids, "id", "left_semi")
    return slim.mapInArrow(run, "id long, set array<long>")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of ids whose sets have this Jaccard similarity or more."""
    one, two = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(two, "b").where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct()


def bridges(fps: np.ndarray, group: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float, tile: int = TILE) -> list[tuple[int, int]]:
    """Index pairs that join groups: within the radius and alike by their sets, a spanning set of them."""
    names, root = np.unique(group, return_inverse=True)
    up = np.arange(len(names))

    def find(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = int(up[k])
        return k

    pops = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    order = np.argsort(pops, kind="stable")
    f, pops, root, n = np.ascontiguousarray(fps[order].T), pops[order], root[order], len(fps)
    out = []
    for i in range(0, n, tile):
        for j in range(i, n, tile):
            if pops[j] - pops[min(i + tile, n) - 1] > radius:
                break
            apart = sum(np.bitwise_count(x[i : i + tile, None] ^ x[None, j : j + tile]).astype(np.uint16) for x in f)
            flat = np.array([find(k) for k in range(len(names))])[root]
            a, b = np.nonzero((apart <= radius) & (flat[i : i + tile, None] != flat[None, j : j + tile]))
            for k in np.argsort(apart[a, b], kind="stable").tolist():  # the closest first: they join most
                p, q = int(a[k] + i), int(b[k] + j)
                u, v = find(root[p]), find(root[q])
                if u == v:
                    continue
                x, y = sets[order[p]], sets[order[q]]
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared >= similarity * (len(x) + len(y) - shared):
                    up[max(u, v)] = min(u, v)
                    out.append((int(order[p]), int(order[q])))
    return out


def bridged(rows: DataFrame, lanes: int, radius: int, similarity: float, block_rows: int = 2000, block_hashes: int = 1_000_000) -> DataFrame:
    """a, b: links between groups of one component. rows: component, rep, part (its group), f0, ..., set.

    A component is dealt out as all pairs of its blocks of about block_rows rows and
    block_hashes hashes, each pair a task of its own that keeps its comparisons to itself.
    """
    sizes = rows.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum(F.size("set")) / block_hashes), F.lit(1)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, mine).alias("i"), F.greatest(k, mine).alias("j")))
    names = [f"f{k}" for k in range(lanes)]
    dealt = rows.join(sizes, "component").select("component", "rep", "part", *names, "set", F.explode(pairs).alias("p")).select("component", "rep", "part", *names, "set", "p.i", "p.j")

    def run(table: pa.Table) -> pa.Table:
        fps = np.column_stack([table.column(c).to_numpy() for c in names]).view(np.uint64)
        column = table.column("set").combine_chunks()
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
        found = bridges(fps, table.column("part").to_numpy(), [flat[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)], radius, similarity)
        rep = table.column("rep").to_numpy()
        return pa.table([pa.array([rep[k] for k, _ in found], pa.int64()), pa.array([rep[k] for _, k in found], pa.int64())], names=["a", "b"])

    return dealt.groupBy("component", "i", "j").applyInArrow(run, "a long, b long").distinct()


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, lanes: int = 4, recall: float = 0.98, hot: int = 20_000) -> DataFrame:
    """id, component_id per row with an id: texts link whose sets of word shingles have this Jaccard similarity or more.

    Fingerprints propose pairs within the differing bits that the similarity leads to expect
    and 2.5 standard deviations more; the sets decide. Two texts that differ in one deviation
    more than the expected bits meet in a bucket with probability ``recall``, closer ones nearly always.
    A spanning set of the proposed pairs is checked first; where a pair of it fails, all pairs
    within that radius between the groups that it would have joined are checked. Equal sets link
    always; null and empty texts are one set, texts shorter than a shingle are one shingle,
    texts of any length are read whole; an empty table gives no rows, other columns are not read.
    """
    fps = stored(wide_fingerprints(docs, id_col, text_col, width, lanes).where("id is not null"), "simhash-wide")
    names = [f"f{k}" for k in range(lanes)]
    distinct = stored(fps.groupBy("same").agg(F.min("id").alias("rep"), *[F.min(c).alias(c) for c in names]), "simhash-sets")
    share = differing_share(similarity)
    spread = math.sqrt(share * (1 - share) / (64 * lanes))
    radius = math.ceil(64 * lanes * (share + 2.5 * spread))
    samples = bit_samples(lanes, distinct.count(), 1 - share - spread, recall)
    keyed = shared_samples(distinct, lanes, samples)
    found = stored(links(keyed, radius, lanes, hot), "simhash-links")
    sets = stored(shingle_sets(docs, found.select(F.explode(F.array("a", "b")).alias("id")).distinct(), id_col, text_col, width), "simhash-shingles")
    good = stored(alike(found, sets, similarity), "simhash-alike")
    parts = stored(connected_components(good), "simhash-parts")
    of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    torn = found.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("a_part", "a") != F.coalesce("b_part", "b"))
    if torn.limit(1).count():
        loose = connected_components(found)
        mixed = loose.join(torn.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("component").distinct()
        rows = loose.join(mixed, "component", "left_semi").join(parts.withColumnRenamed("component", "part"), "node", "left").select("component", F.col("node").alias("rep"), F.coalesce("part", "node").alias("part"))
        full = rows.join(distinct.select("rep", *names), "rep").join(sets.withColumnRenamed("id", "rep"), "rep")
        more = bridged(full, lanes, radius, similarity)
        parts = connected_components(good.unionByName(stored(more, "simhash-bridges")))
    labels = distinct.join(parts, distinct["rep"] == parts["node"], "left").select("same", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(labels, "same").select("id", "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 1_000_000, **how) -> DataFrame:
    """Rows whose id is the smallest of their component of similar texts; all columns are kept, rows with a null id too."""
    copies = cut(similar(docs, id_col, text_col, **how).where("id <> component_id").select(F.col("id").alias("__copy")).distinct())
    if small_enough(copies, most_broadcast):
        copies = F.broadcast(copies)
    return docs.join(copies, docs[id_col].cast("long") == copies["__copy"], "left_anti")
