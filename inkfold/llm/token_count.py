"""Token counts of byte-level BPE vocabularies by rank-synchronous merging of ragged symbol arrays.

Texts are cut into pre-tokens by the vocabulary's pattern. The different pre-tokens of a
batch become one flat array of symbols with a bound per pre-token. In each round every
pre-token finds its lowest-ranked neighbouring pair and merges all places of it at once;
a pre-token without a ranked pair is done, and its surviving symbols are its count. A
merged pair's symbol only takes part in later ranks, so merging all places of the lowest
rank at once is the same as merging them one by one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The byte-level pre-tokenizer's own pattern. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Merges:
    """Ranked pairs as sorted keys (left * size + right) with rank and resulting symbol; symbols are numbered bytes first, then by rank."""

    size: int
    keys: np.ndarray
    rank: np.ndarray
    first: np.ndarray  # symbol of each byte
    result: np.ndarray  # by rank
    specials: tuple[str, ...]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, the number of ranks where it has none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.rank)) if len(self.keys) else np.zeros(len(key), np.int64)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else the next one from U+0100 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def load(path: str) -> Merges:
    """Merges of a tokenizers .json file; anything but plain byte-level BPE is refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    added = spec.get("added_tokens", [])
    if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) or any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    vocab = model["vocab"]
    size = max(vocab.values()) + 1
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
    left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
    keys = left * size + right
    order = np.argsort(keys, kind="stable")
    return Merges(size, keys[order], order.astype(np.int64), np.array([vocab[c] for c in byte_letters()], np.int64), np.array([vocab[a + b] for a, b in pairs], np.int64), tuple(t["content"] for t in added))


def survivors(words: list[bytes], merges: Merges) -> np.ndarray:
    """Symbols left of each word once no ranked pair is left."""
    sizes = np.array([len(w) for w in words], np.int64)
    symbol = merges.first[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), sizes)
    none, counts = len(merges.rank), sizes.copy()
    rank = np.full(len(symbol), none, np.int64)  # of the pair that begins here
    if len(symbol) > 1:
        inside = owner[1:] == owner[:-1]
        rank[:-1][inside] = merges.ranks(symbol[:-1][inside], symbol[1:][inside])
    while len(symbol):
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        least = np.minimum.reduceat(rank, starts)
        lengths = np.diff(np.append(starts, len(symbol)))
        live = np.repeat(least < none, lengths)
        if not live.all():  # words without a ranked pair are done
            done = least == none
            counts[owner[starts[done]]] = lengths[done]
            symbol, owner, rank, least = symbol[live], owner[live], rank[live], least[~done]
            lengths = lengths[~done]
            if not len(symbol):
                break
        hit = rank == np.repeat(least, lengths)
        at = np.flatnonzero(hit)
        if len(at) > 1:  # equal letters in a row: every second place of a run
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
        symbol[at] = merges.result[rank[at]]
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        symbol, owner = symbol[keep], owner[keep]
        at = place[at]
        rank = rank[keep]
        for p in (at, at[at > 0] - 1):  # pairs that a new symbol begins or ends
            more = p + 1 < len(symbol)
            rank[p[~more]] = none
            p = p[more]
            rank[p] = np.where(owner[p] == owner[p + 1], merges.ranks(symbol[p], symbol[p + 1]), none)
    return counts


class Counter:
    """Counts of texts; those of short words are kept, up to a bound, from one batch to the next."""

    def __init__(self, merges: Merges, words_kept: int = 200_000, letters_a_step: int = 1_000_000) -> None:
        self.merges, self.words_kept, self.letters = merges, words_kept, letters_a_step
        self.known: dict[str, int] = {}
        self.find = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(merges.specials, key=len, reverse=True))) if merges.specials else None

    def _learn(self, words: set[str]) -> None:
        new = list(words - self.known.keys())
        if len(self.known) + len(new) > self.words_kept:
            self.known.clear()
            new = list(words)
        at = 0
        while at < len(new):  # a bounded number of letters at a time, one word at least
            stop, letters = at, 0
            while stop < len(new) and (stop == at or letters + len(new[stop]) <= self.letters):
                letters += len(new[stop])
                stop += 1
            counts = survivors([w.encode("utf-8") for w in new[at:stop]], self.merges)
            self.known.update(zip(new[at:stop], counts.tolist(), strict=True))
            at = stop

    def _parts(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, and their number."""
        if self.special is None or self.special.search(text) is None:
            return [text], 0
        parts = self.special.split(text)
        return parts, len(parts) - 1

    def _long(self, text: str) -> int:
        """A text of any length, its words a bounded number at a time."""
        parts, total = self._parts(text)
        for part in parts:
            words = (m.group() for m in self.find.finditer(part))
            while some := list(islice(words, self.letters)):
                self._learn(set(some))
                total += sum(map(self.known.__getitem__, some))
        return total

    def count(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        step: list[tuple[int, list[str]]] = []
        letters = 0

        def settle() -> None:
            nonlocal letters
            self._learn(set().union(*(words for _, words in step)))
            for k, words in step:
                out[k] += sum(map(self.known.__getitem__, words))
            step.clear()
            letters = 0

        for k, text in enumerate(texts):
            if not text:
                continue
            if len(text) > self.letters:
                out[k] = self._long(text)
                continue
            if letters + len(text) > self.letters:
                settle()
            parts, out[k] = self._parts(text)
            step += [(k, self.find.findall(part)) for part in parts]
            letters += len(text)
        settle()
        return out


def count(docs: DataFrame, vocabulary: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (of UTF-8), n_tokens and over_limit (more than limit tokens) of every text, one row per input row.

    vocabulary is the path of a byte-level BPE .json file, by default the public one of
    50,257 symbols; the driver reads it and sends its pairs, whose number the file bounds.
    Special strings of the vocabulary inside a text count as one token each, nothing is
    added, cut or padded. Null and empty texts have 0 bytes and 0 tokens; repeated rows
    are each counted; texts of any length are taken a million words at a time; an empty
    table gives an empty result; null ids pass through and other columns are not read.
    No shuffle: a task holds a million letters' words and 200,000 known words at a time.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    sent = docs.sparkSession.sparkContext.broadcast(load(vocabulary))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in batches:
            for s in range(0, batch.num_rows, 512):  # texts become Python strings a few at a time
                part = batch.slice(s, 512)
                n = np.array(counter.count(part.column(2).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
