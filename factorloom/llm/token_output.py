"""Token ids in Re-Pair compressed shards, and their reader.

Documents are dealt by ranges of their id, encoded, and cut into shards of a
bounded number of ids.  In a shard, adjacent pairs are repeatedly
replaced by nonterminals, the most frequent first, until no pair occurs
``MIN_COUNT`` times; a pair never spans two documents, so each document is
a run of symbols and can be expanded alone.  A shard is one binary payload:

    8 bytes  magic "FLRPAIR1"
    4 x u32  ids of the terminal alphabet, rules, documents, symbols
    u32[rules][2]        right-hand sides, in the order they were made
    u32[rules]           expansion length of each rule
    u32[documents + 1]   first symbol of each document
    u64[documents + 1]   first id of each document, counted within the shard
    u16 or u32[symbols]  the sequence (u16 while alphabet + rules <= 65536)

Shards are rows of a Parquet table in the shared folder, so any file system
that Spark writes to will do and lost tasks are simply run again.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorloom.llm.chunks import Pieces, byte_mapped, cuts_hold, plain, text_slices
from factorloom.llm.common import Scratch, bound_batches, releasing

MAGIC = b"FLRPAIR1"
#: A pair becomes a rule if it occurs so often in its shard: a rule costs 12 bytes and an occurrence saves two.
MIN_COUNT = 24
#: Buckets of the first count of a round.
BUCKET_BITS = 19
BUCKETS = 1 << BUCKET_BITS
#: Words that go to the library as one text.
JOINED = 1000
#: Pieces whose ids a worker keeps between texts, and the bytes of the longest one.
KEPT_PIECES = 500_000
KEPT_BYTES = 64
#: Texts that go to the library at once where the vocabulary does not let them be cut.
WHOLE_TEXTS = 64


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + size]`` back to back."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def starts_of(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


class ChunkEncoder:
    """Ids of many texts at once: each distinct chunk between spaces is encoded by the library once.

    Pieces of small Latin-1 letters are one pre-token each; they go to the same
    model as one text, many at a time.  Ids of up to ``KEPT_PIECES`` pieces stay
    for the next texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        #: Ids that end a pre-token, where the vocabulary marks word ends.
        self.final = np.zeros(max(vocab.values()) + 1, bool)
        self.final[[k for t, k in vocab.items() if t.endswith("</w>")]] = True
        self.words = self._word_encoder(path)
        self._keep(pa.array([], pa.string()), np.empty(0, np.uint32), np.empty(0, np.int64))
        self.cuts = True
        self.cuts = cuts_hold(lambda texts: [ids.tolist() for _, flat, size in self.encode(texts) for ids in np.split(flat, np.cumsum(size)[:-1])], self.library)

    def _word_encoder(self, path: str):
        """The same model without the steps that change nothing on small Latin-1 words; None if a probe differs."""
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        lean = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": None, "post_processor": None}))
        lean.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        probe = "a the straße étude où naïve aaaa zzzzzzzz".split()
        same = lambda w: lean.encode(byte_mapped(w.encode()), add_special_tokens=False).ids == self.library.encode(w, add_special_tokens=False).ids
        return lean if self.final.any() and all(map(same, probe)) else None

    def _keep(self, known: pa.Array, flat: np.ndarray, size: np.ndarray) -> None:
        self.known, self.flat, self.size = known, flat, size

    def _encode_new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces back to back, and the size of each, by the library."""
        is_plain = plain(pieces) if self.words is not None else np.zeros(len(pieces), bool)
        words, rest = pieces.filter(pa.array(is_plain)), pieces.filter(pa.array(~is_plain)).to_pylist()
        ids, sizes = [], []
        for at in range(0, len(words), JOINED):
            # a plain word is one pre-token, so its last id is the first that ends a word
            some = words.slice(at, JOINED)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), " ")[0].as_buffer()
            got = np.array(self.words.encode_batch_fast([byte_mapped(joined.to_pybytes())], add_special_tokens=False)[0].ids, np.uint32)
            ids.append(got)
            sizes.append(np.diff(np.r_[-1, np.flatnonzero(self.final[got])]))
        got = [e.ids for e in self.library.encode_batch_fast(rest, add_special_tokens=False)]
        sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
        ids.append(np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(sizes[-1].sum())))
        size, place = np.concatenate(sizes), np.empty(len(pieces), np.int64)
        place[np.r_[np.flatnonzero(is_plain), np.flatnonzero(~is_plain)]] = np.arange(len(pieces))
        return gather(np.concatenate(ids), starts_of(size)[place], size[place]), size[place]

    def _encode_pieces(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids back to back, and start and size of each distinct piece; only those not known go to the library."""
        found = pc.index_in(distinct, value_set=self.known)
        new = distinct.filter(found.is_null())
        new_flat, new_size = self._encode_new(new)
        at = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.known) + np.arange(len(new))
        flat, size = np.concatenate([self.flat, new_flat]), np.concatenate([self.size, new_size])
        start = starts_of(size)
        short = pc.less_equal(pc.binary_length(new), KEPT_BYTES).to_numpy(zero_copy_only=False)
        kept = new.filter(pa.array(short)).slice(0, KEPT_PIECES)
        pick = np.flatnonzero(short)[: len(kept)]
        kept_flat, kept_size = gather(new_flat, starts_of(new_size)[pick], new_size[pick]), new_size[pick]
        if len(self.known) + len(kept) <= KEPT_PIECES:
            self._keep(pa.concat_arrays([self.known, kept]), np.concatenate([self.flat, kept_flat]), np.concatenate([self.size, kept_size]))
        else:  # begin anew with what came last
            self._keep(pa.concat_arrays([kept]), kept_flat, kept_size)
        return flat, start[at], size[at]

    def encode(self, texts: pa.Array, most: int = 400_000):
        """Yield (first text, ids, ids of each text) for runs of texts of about ``most`` chunks."""
        if not self.cuts:
            for first in range(0, len(texts), WHOLE_TEXTS):
                some = [t or "" for t in texts.slice(first, WHOLE_TEXTS).to_pylist()]
                got = [e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
                size = np.fromiter(map(len, got), np.int64, len(got))
                yield first, np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(size.sum())), size
            return
        pieces = Pieces(texts)
        bounds, which, head, tail = pieces.bounds, pieces.which, pieces.head, pieces.tail
        flat, start, size = self._encode_pieces(pieces.distinct)
        # ids of each distinct chunk: those of its head, then those of its tail
        parts = np.stack([head, np.maximum(tail, 0)], 1)
        part_size = size[parts]
        part_size[tail < 0, 1] = 0
        flat, size = gather(flat, start[parts].ravel(), part_size.ravel()), part_size.sum(1)
        start = starts_of(size)
        first = 0
        while first < len(texts):
            past = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1)
            u = which[bounds[first] : bounds[past]]
            n = size[u]
            yield first, gather(flat, start[u], n), np.diff(np.r_[0, np.cumsum(n)][bounds[first : past + 1] - bounds[first]])
            first = past


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab().values()) + 1


@functools.lru_cache(maxsize=1)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def with_end_id(ids: np.ndarray, size: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    total = size + 1
    out = np.empty(int(total.sum()), np.uint32)
    last = np.zeros(len(out), bool)
    last[np.cumsum(total) - 1] = True
    out[last] = end_id
    out[~last] = ids
    return out, total


def distinct_pairs(pair: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in no order, the place of each pair among them, and how often each occurs.

    One pair of each bucket is told by its bucket; only the others are sorted.
    """
    one = np.zeros(BUCKETS, np.uint64)
    one[bucket] = pair
    told = one[bucket] == pair
    count = np.bincount(bucket[told], minlength=BUCKETS)
    used = np.flatnonzero(count)
    number = np.zeros(BUCKETS, np.int64)
    number[used] = np.arange(len(used))
    which = number[bucket]
    others = np.flatnonzero(~told)
    kinds, which[others], more = np.unique(pair[others], return_inverse=True, return_counts=True)
    which[others] += len(used)
    return np.concatenate([one[used], kinds]), which, np.concatenate([count[used], more])


def re_pair(ids: np.ndarray, doc_size: np.ndarray, alphabet: int, min_count: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Compressed symbols, symbols of each document, and the rules (left, right) by nonterminal.

    Rounds go on until no adjacent pair occurs ``min_count`` times.  A round
    counts pairs exactly and replaces every pair that is more frequent than
    those it overlaps.  Old pairs only get rarer, so after the first round only
    pairs that were frequent or have a new symbol are counted.
    """
    symbol, rules = np.ascontiguousarray(ids, np.uint32).copy(), []
    last = np.zeros(len(symbol), bool)
    last[np.cumsum(doc_size)[doc_size > 0] - 1] = True
    at = np.flatnonzero(~last)
    while len(at):
        pair = np.stack([symbol[at], symbol[at + 1]], 1).astype("<u4", copy=False).view("<u8").ravel()
        # what shares its bucket with few others need not be sorted
        bucket = ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).view(np.int64)
        may = np.bincount(bucket, minlength=BUCKETS)[bucket] >= min_count
        at, pair, bucket = at[may], pair[may], bucket[may]
        kinds, which, count = distinct_pairs(pair, bucket)
        often = (count >= min_count)[which]
        at, which = at[often], which[often]
        if not len(at):
            break
        order = np.lexsort((kinds, -count))
        rank = np.empty(len(kinds), np.int64)
        rank[order] = np.arange(len(kinds))  # 0: the most frequent
        mine = rank[which]
        beside = at[1:] - at[:-1] == 1
        lost = np.zeros(len(at), bool)
        lost[:-1] |= beside & (mine[:-1] > mine[1:])
        lost[1:] |= beside & (mine[1:] > mine[:-1])
        won = np.flatnonzero(~lost)
        # equal neighbours ("aaa") overlap: of each run take the first, third, ... pair
        begins = np.r_[True, np.diff(at[won]) != 1]
        begin = np.maximum.accumulate(np.where(begins, at[won], 0))
        won = won[(at[won] - begin) % 2 == 0]
        # a pair that mostly lost waits for the next round; the most frequent one never does
        used = np.bincount(which[won], minlength=len(kinds))
        good = used >= max(2, min_count // 2)
        good[order[0]] = True
        won = won[good[which[won]]]
        made = order[good[order]]
        new_id = np.zeros(len(kinds), np.uint32)
        new_id[made] = alphabet + len(rules) + np.arange(len(made), dtype=np.uint32)
        rules += [(k & 0xFFFFFFFF, k >> 32) for k in kinds[made].tolist()]
        place = at[won]
        symbol[place] = new_id[which[won]]
        last[place] = last[place + 1]
        asked = np.zeros(len(symbol), bool)
        asked[at] = asked[place] = True
        asked[place[place > 0] - 1] = True
        keep = np.ones(len(symbol), bool)
        keep[place + 1] = False
        symbol, last, asked = symbol[keep], last[keep], asked[keep]
        at = np.flatnonzero(asked & ~last)
    sizes = np.zeros(len(doc_size), np.int64)
    ends = np.flatnonzero(last)
    sizes[doc_size > 0] = np.diff(np.r_[-1, ends])
    return symbol, sizes, rules


def pack_shard(ids: np.ndarray, doc_size: np.ndarray, alphabet: int, min_count: int = MIN_COUNT) -> bytes:
    symbol, sizes, rules = re_pair(ids, doc_size, alphabet, min_count)
    length = np.ones(alphabet + len(rules), np.uint32)
    for k, (a, b) in enumerate(rules):
        length[alphabet + k] = length[a] + length[b]
    kind = "<u2" if alphabet + len(rules) <= 65536 else "<u4"
    return b"".join(
        (
            MAGIC,
            struct.pack("<4I", alphabet, len(rules), len(doc_size), len(symbol)),
            np.array(rules, "<u4").reshape(-1, 2).tobytes(),
            length[alphabet:].astype("<u4").tobytes(),
            np.r_[0, np.cumsum(sizes)].astype("<u4").tobytes(),
            np.r_[0, np.cumsum(doc_size)].astype("<u8").tobytes(),
            symbol.astype(kind).tobytes(),
        )
    )


class Shard:
    """Random-access view of a payload."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC:
            raise ValueError("not a shard")
        self.alphabet, n_rules, self.n_docs, n_symbols = struct.unpack_from("<4I", payload, 8)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.length = np.r_[np.ones(self.alphabet, np.int64), take("<u4", n_rules).astype(np.int64)]
        self.doc_symbol, self.doc_id = take("<u4", self.n_docs + 1), take("<u8", self.n_docs + 1)
        self.symbol = take("<u2" if self.alphabet + n_rules <= 65536 else "<u4", n_symbols)
        # rule expansions back to back; a rule uses only terminals and earlier rules
        self.start = np.r_[np.arange(self.alphabet), self.alphabet + np.cumsum(self.length[self.alphabet :]) - self.length[self.alphabet :]]
        self.flat = np.empty(self.alphabet + int(self.length[self.alphabet :].sum()), np.uint32)
        self.flat[: self.alphabet] = np.arange(self.alphabet)
        for k, (a, b) in enumerate(self.rules.tolist()):
            s, m = self.start[self.alphabet + k], self.length[a]
            self.flat[s : s + m] = self.flat[self.start[a] : self.start[a] + m]
            self.flat[s + m : s + m + self.length[b]] = self.flat[self.start[b] : self.start[b] + self.length[b]]

    def expand(self, first: int, past: int) -> np.ndarray:
        symbol = self.symbol[first:past].astype(np.int64)
        size = self.length[symbol]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[symbol] - (ends - size), size) + np.arange(int(size.sum()))]

    def document(self, k: int) -> np.ndarray:
        """The ids of one document, without expanding the others."""
        return self.expand(int(self.doc_symbol[k]), int(self.doc_symbol[k + 1]))


SHARD_SCHEMA = "part int, block int, first_id long, n_ids long, doc_ids array<{id}>, payload binary"


def _write_batches(path: str, end_id: int, alphabet: int, shard_ids: int):
    def run(batches):
        encoder, part = chunk_encoder(path), TaskContext.get().partitionId()
        ids, sizes, docs, held, block, before = [], [], [], 0, 0, 0

        def flush():
            nonlocal ids, sizes, docs, held, block, before
            payload = pack_shard(np.concatenate(ids), np.concatenate(sizes), alphabet)
            row = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64())]
            keys = pa.concat_arrays(docs)
            row += [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([payload], pa.binary())]
            before, block = before + held, block + 1
            ids, sizes, docs, held = [], [], [], 0
            return pa.RecordBatch.from_arrays(row, ["part", "block", "first_id", "n_ids", "doc_ids", "payload"])

        for batch in batches:
            for piece in text_slices(batch):
                for first, some, number in encoder.encode(piece.column(1).cast(pa.string()), max(1, shard_ids // 4)):
                    out, size = with_end_id(some, number, end_id)
                    ids.append(out)
                    sizes.append(size)
                    docs.append(piece.column(0).slice(first, len(number)))
                    held += len(out)
                    if held >= shard_ids:
                        yield flush()
        if held:
            yield flush()

    return releasing(run)


def write_token_shards(
    spark: SparkSession, docs: DataFrame, tokenizer_path: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 1, alphabet: int | None = None, shard_ids: int = 1_500_000, parts: int | None = None,
) -> DataFrame:
    """Write the shards in ascending id order and return the table read back.

    One range exchange of (id, text).  Equal ids are spread by a hash of their
    text, so a hot id does not fill one partition.  A null text is the end id
    alone.  ``shard_ids`` bounds a grammar's sequence (a longer document still
    is one document of one shard).  Nonterminals are numbered from ``alphabet``,
    the first id beyond the vocabulary unless given.
    """
    bound_batches(spark)
    alphabet = alphabet or max(vocabulary_size(tokenizer_path), end_id + 1)
    slim = docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text").alias("tie")
    dealt = slim.withColumn("tie", tie).repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text")
    schema = SHARD_SCHEMA.format(id=docs.schema[id_col].dataType.simpleString())
    return scratch.keep(dealt.mapInArrow(_write_batches(tokenizer_path, end_id, alphabet, shard_ids), schema), "shards")


def _read_batches(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            first, before = batch.column("first_id")[row].as_py(), batch.column("base")[row].as_py()
            shard = Shard(batch.column("payload")[row].as_py())
            # runs of documents of about a million ids are expanded at a time
            step = max(1, int(shard.n_docs * 1_000_000 // max(1, int(shard.doc_id[-1]))))
            crc: list[int] = []
            for k in range(0, shard.n_docs, step):
                end = min(k + step, shard.n_docs)
                raw = shard.expand(int(shard.doc_symbol[k]), int(shard.doc_symbol[end])).astype("<u4")
                base = int(shard.doc_id[k])
                crc += [zlib.crc32(raw[int(a) - base : int(b) - base]) for a, b in zip(shard.doc_id[k:end], shard.doc_id[k + 1 : end + 1], strict=True)]
            starts = shard.doc_id.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_ids")[row].values, pa.array(starts[:-1] + first + before), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                ["id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_index(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document from the files: id, start, n_tokens, ids_crc32.

    The only global step is a running sum over one row per range partition.
    """
    per_part = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    id_type = shards.schema["doc_ids"].dataType.elementType.simpleString()
    rows = shards.join(base, "part").select("first_id", "base", "doc_ids", "payload")
    return rows.mapInArrow(releasing(_read_batches), f"id {id_type}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def token_output(spark: SparkSession, docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Encode, write shards, read them back.

    Per row: id, start, n_tokens, ids_crc32.  A null or empty text is the end id
    alone; repeated ids and rows keep their rows, in order of a hash of their
    text; an empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(spark, "token-shards")
    return read_token_index(write_token_shards(spark, docs, tokenizer_path, scratch, id_col, text_col, **options), id_col)
