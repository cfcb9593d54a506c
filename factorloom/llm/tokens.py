"""Token counts by rank-synchronous array merging.

Distinct pre-tokens of a batch are held as one flat symbol array with sequence
starts (a ragged array).  In each round every sequence finds its lowest-rank
adjacent pair and merges all of its occurrences at once; sequences without a
mergeable pair leave.  The symbols that survive are the token count.  Very long
sequences keep their pairs in buckets by rank instead of looking at all of them
in each round.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.chunks import PROBES, Pieces, byte_mapped, text_slices
from factorloom.llm.common import bound_batches, releasing

NONE = np.int64(2**31 - 1)
#: Pre-tokens of more symbols are merged by rank with the pairs of each rank in a bucket, so that a round touches only what changes.
LONG = 512


class RaggedBpe:
    """Merges of a byte-pair vocabulary over ragged arrays of byte-mapped pre-tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.tokenizer = Tokenizer.from_file(path)
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.width = max(vocab.values()) + 1
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        self.merged_id = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        top = max(ord(t) for t in vocab if len(t) == 1) + 1
        self.inner, self.final = np.full(top, -1, np.int64), np.full(top, -1, np.int64)
        for code in range(top):
            self.inner[code] = vocab.get(chr(code), -1)
            self.final[code] = vocab.get(chr(code) + suffix, -1)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

        # small words reach the merges as their bytes, if the library's own steps say so
        probe = "a the straße étude où naïve".split()
        self.by_bytes = all(self.pieces(w) == ([byte_mapped(w.encode())], 0) for w in probe)
        # texts are cut at spaces if the probes count the same so, else they stay whole
        want = [len(e.ids) for e in self.tokenizer.encode_batch(PROBES, add_special_tokens=False)]
        self.cuts = self.count_texts(pa.array(PROBES), True).tolist() == want
        if not self.cuts and self.count_texts(pa.array(PROBES), False).tolist() != want:
            raise ValueError(f"{path} is not a byte-pair vocabulary whose counts merging by rank can give")

    def count_texts(self, texts: pa.Array, cut: bool) -> np.ndarray:
        """Tokens of each text, by its distinct pieces or whole."""
        if not cut:
            whole = [self.pieces(t or "") for t in texts.to_pylist()]
            tokens = np.r_[0, np.cumsum(self.count([p for ps, _ in whole for p in ps]))]
            ends = np.cumsum([0, *(len(ps) for ps, _ in whole)])
            return np.diff(tokens[ends]) + np.array([s for _, s in whole], np.int64)
        pieces = Pieces(texts)
        counts = self.count_pieces(pieces)
        per_chunk = counts[pieces.head] + np.where(pieces.tail >= 0, counts[pieces.tail], 0)
        return np.diff(np.r_[0, np.cumsum(per_chunk[pieces.which])][pieces.bounds])

    def pieces(self, chunk: str) -> tuple[list[str], int]:
        """Byte-mapped pre-tokens of a text, and how many special tokens stand in it."""
        parts, specials = [chunk], 0
        if self.special is not None and self.special.search(chunk):
            parts = self.special.split(chunk)
            specials = len(parts) - 1
        out: list[str] = []
        for part in parts:
            if part:
                normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                out += [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return out, specials

    def count_pieces(self, pieces: Pieces) -> np.ndarray:
        """Tokens of each distinct piece of some texts."""
        plain = pieces.plain() if self.by_bytes else np.zeros(len(pieces.distinct), bool)
        words = [byte_mapped(w.encode()) for w in pieces.distinct.filter(pa.array(plain)).to_pylist()]
        rest = [self.pieces(c) for c in pieces.distinct.filter(pa.array(~plain)).to_pylist()]
        tokens = self.count(words + [p for ps, _ in rest for p in ps])
        out = np.zeros(len(pieces.distinct), np.int64)
        out[plain] = tokens[: len(words)]
        number = np.array([len(ps) for ps, _ in rest], np.int64)
        ends = np.r_[0, np.cumsum(tokens[len(words) :])][np.r_[0, np.cumsum(number)]]
        out[~plain] = np.diff(ends) + np.array([s for _, s in rest], np.int64)
        return out

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each non-empty pre-token."""
        if not pieces:
            return np.empty(0, np.int64)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).astype(np.int64)
        symbol = self.inner[codes]
        last = np.cumsum(size) - 1
        symbol[last] = self.final[codes[last]]
        known = symbol >= 0  # a symbol outside the vocabulary yields no token
        result = np.add.reduceat(known.astype(np.int64), np.r_[0, last[:-1] + 1])
        which = np.arange(len(pieces))
        ids = np.repeat(which, size)
        if size.max() > LONG:
            long = (size > LONG)[ids]
            np.subtract.at(result, ids[long], self._merged(symbol[long], ids[long]))
            symbol, ids = symbol[~long], ids[~long]
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            rank = np.full(len(symbol), NONE)
            rank[:-1] = self.rank_of(symbol[:-1], symbol[1:])
            rank[starts[1:] - 1] = NONE
            least = np.minimum.reduceat(rank, starts)
            length = np.diff(np.r_[starts, len(symbol)])
            spread = np.repeat(least, length)
            hit = np.flatnonzero((rank == spread) & (spread < NONE))
            # equal neighbours ("aaa") overlap: of each run take the first, third, ... pair
            fresh = np.r_[True, np.diff(hit) != 1][: len(hit)]
            begin = np.maximum.accumulate(np.where(fresh, hit, 0)) if len(hit) else hit
            hit = hit[(hit - begin) % 2 == 0]
            symbol[hit] = self.merged_id[rank[hit]]
            keep = spread < NONE
            np.subtract.at(result, ids[hit], 1)
            keep[hit + 1] = False
            symbol, ids = symbol[keep], ids[keep]
        return result


    def _merged(self, symbol: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """How often each place of some sequences is the left of a merge.

        Pairs wait in a bucket by rank.  The lowest rank is taken out, all of its
        pairs that still stand are merged at once (of a run of equal neighbours
        the first, third, ...), and only the pairs beside them are ranked anew.
        """
        n = len(symbol)
        merges = np.zeros(n, np.int64)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.flatnonzero(np.r_[ids[1:] != ids[:-1], True])
        after[last] = -1
        before[np.r_[0, last[:-1] + 1]] = -1
        rank = np.full(n, NONE)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(place: np.ndarray) -> None:
            """Rank the pairs that begin at ``place`` and put them into their buckets."""
            follows = after[place]
            place, follows = place[follows >= 0], follows[follows >= 0]
            found = self.rank_of(symbol[place], symbol[follows])
            rank[place] = found
            order = np.flatnonzero(found < NONE)
            order = order[np.argsort(found[order], kind="stable")]
            place, found = place[order], found[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for r, some in zip(found[np.r_[0, cuts]].tolist() if len(found) else (), np.split(place, cuts), strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(some)

        enter(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            some = waiting.pop(r)
            at = np.unique(np.concatenate(some)) if len(some) > 1 else some[0]
            at = at[rank[at] == r]
            if not len(at):
                continue
            fresh = np.r_[True, after[at[:-1]] != at[1:]]
            turn = np.arange(len(at))
            at = at[(turn - np.maximum.accumulate(np.where(fresh, turn, 0))) % 2 == 0]
            right = after[at]
            follows = after[right]
            symbol[at] = self.merged_id[r]
            merges[at] += 1
            rank[right] = rank[at] = NONE
            after[at] = follows
            real = follows >= 0
            before[follows[real]] = at[real]
            ahead = before[at]
            ahead = ahead[ahead >= 0]
            rank[ahead] = NONE
            enter(np.union1d(at, ahead))
        return merges


@functools.lru_cache(maxsize=2)
def ragged_bpe(path: str) -> RaggedBpe:
    return RaggedBpe(path)


def _count_batches(path: str):
    def run(batches):
        bpe = ragged_bpe(path)
        for batch in batches:
            for some in text_slices(batch):
                counts = bpe.count_texts(some.column(1).cast(pa.string()), bpe.cuts)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(counts, pa.int64())], ["id", "n_tokens"])

    return releasing(run)


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Map-only: one scan, no shuffle, so a hot source or repeated rows move no
    data.  A null text counts as empty (0 bytes, 0 tokens); repeated ids stay
    separate rows; an empty table gives an empty result; other columns are not
    read.  Where the vocabulary's pre-tokeniser never joins across a space or a
    line feed (probed once), texts are cut there and each distinct piece of a
    slice of about 16 MB of text is merged once; else texts stay whole.
    """
    bound_batches(docs.sparkSession)
    out_id = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    # the length rides along as a second identifier so that one pass gives both
    sized = slim.select(F.struct("id", F.octet_length("text").cast("long").alias("n_bytes")).alias("id"), "text")
    counted = sized.mapInArrow(_count_batches(tokenizer_path), f"id struct<id:{out_id},n_bytes:bigint>, n_tokens long")
    return counted.select(
        F.col("id.id").alias(id_col), F.col("id.n_bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
