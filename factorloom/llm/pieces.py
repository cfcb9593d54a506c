"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

A text becomes symbols of one character each.  An agenda (a heap) holds the
adjacent pairs whose concatenation is a piece, the highest score first and the
leftmost of equal ones; the top pair is merged and its new neighbours enter.
Entries that a later merge overtook are skipped when they come up.

A symbol is always a piece or one character, so no merge ever spans two
characters that stand side by side in no piece.  Texts are cut there; each
distinct chunk of an Arrow batch goes through the agenda once, and every chunk
that is new is checked against the sentencepiece library before it is used.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.chunks import text_slices
from factorloom.llm.common import bound_batches, releasing

#: What sentencepiece writes for a space.
SPACE = "▁"
#: Kinds of pieces in a model file (fixed values of its format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Merge-type models, in the same format.
MERGE_TYPE = 2
#: Bytes of text that are cut and coded together, characters looked at together, and chunks remembered between batches.
SLICE_BYTES, BLOCK, REMEMBERED = 4 << 20, 1 << 20, 600_000
PLACE_BITS = 40
#: An agenda of so many pairs is a plain list, searched for its best; a longer one is a heap.
SHORT, NEVER = 32, 1 << 40

#: Texts on which cut and whole texts must agree with the library when a model is loaded.
PROBES = [
    "", " ", "  a  b ", "\n\t\r\n x", "The Straße of NAÏVE étude, où?! 3.14 1,000", "▁under▁ score ▁", "don't 'tis <s> </s> <unk> <0x0A>", "中文 text Здравствуй 😀👩‍👩‍👧", "é  nb em　",
    "aaaaaaaaaaaa zzzzzzzz", "\x00\x01\x7f͸", "return x[i] != y; // {}()",
]


class PieceModel:
    """The agenda of one model, its cuts, its decoder and the library that checks it."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as formats

        spec = formats.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        trainer, normal = spec.trainer_spec, spec.normalizer_spec
        if trainer.model_type != MERGE_TYPE or trainer.treat_whitespace_as_suffix or not normal.escape_whitespaces:
            raise ValueError(f"{path} is not a merge-type vocabulary that marks spaces before words")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.plain = normal.name == "identity" and not normal.precompiled_charsmap and not normal.remove_extra_whitespaces
        self.prefix, self.collapses = normal.add_dummy_prefix, normal.remove_extra_whitespaces
        # the same vocabulary for chunks: their spaces are marked already
        normal.add_dummy_prefix = False
        self.checker = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString()) if self.plain else None

        kinds = np.array([p.type for p in spec.pieces], np.int64)
        texts = [p.piece for p in spec.pieces]
        mergeable = [k for k, kind in enumerate(kinds) if kind in (NORMAL, USER_DEFINED, UNUSED)]
        #: Dense rank of each piece's score; equal scores share one, so that the place decides.
        order = {s: r for r, s in enumerate(sorted({spec.pieces[k].score for k in mergeable}, reverse=True))}
        self.rank = {texts[k]: order[spec.pieces[k].score] for k in mergeable}
        self.ids = {texts[k]: k for k in (*np.flatnonzero((kinds == UNKNOWN) | (kinds == CONTROL) | (kinds == BYTE)).tolist(), *mergeable)}
        self.unused = {texts[k] for k in mergeable if kinds[k] == UNUSED}
        fixed = sorted((texts[k] for k in mergeable if kinds[k] == USER_DEFINED), key=len, reverse=True)
        self.fixed = re.compile("|".join(map(re.escape, fixed))) if fixed else None
        self.unknown = int(np.flatnonzero(kinds == UNKNOWN)[0])
        byte_ids = np.flatnonzero(kinds == BYTE)
        self.byte_ids = {int(texts[k][3:5], 16): int(k) for k in byte_ids} if trainer.byte_fallback else {}
        self._learn_cuts(texts[k] for k in mergeable)
        self._learn_surfaces(texts, kinds, trainer.unk_surface)
        self.known: dict[str, tuple[int, ...]] = {}
        if self.encode(pa.array(PROBES)).to_pylist() != self.library.encode(PROBES):
            raise ValueError(f"the agenda does not give the library's ids for {path}")

    # -- encoding --------------------------------------------------------------

    def _learn_cuts(self, pieces) -> None:
        """Which characters stand side by side in some piece: a class for each, and a table of classes."""
        long = [p for p in pieces if len(p) > 1]
        letters = sorted(set("".join(long)))
        self.letter_class = np.zeros(0x110000, np.uint16)
        self.letter_class[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letter_class[0x20] = self.letter_class[ord(SPACE)]
        self.side_by_side = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in long:
            at = self.letter_class[[ord(c) for c in p]]
            self.side_by_side[at[:-1], at[1:]] = True

    def agenda(self, text: str) -> list[str]:
        """Pieces of a text whose spaces are marked, by merging the best adjacent pair until none is left."""
        symbol: list[str] = list(text)
        rank, n = self.rank, len(symbol)
        if n <= SHORT and not self.unused:
            return self._short_agenda(symbol)
        best = [rank.get(symbol[k] + symbol[k + 1], -1) for k in range(n - 1)] + [-1]
        heap = [(r << PLACE_BITS) | k for k, r in enumerate(best) if r >= 0]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        place = (1 << PLACE_BITS) - 1
        halves: dict[str, tuple[str, str]] = {}
        if self.unused:
            halves.update((symbol[k] + symbol[k + 1], (symbol[k], symbol[k + 1])) for k, r in enumerate(best) if r >= 0)
        while heap:
            top = heapq.heappop(heap)
            left = top & place
            if best[left] != top >> PLACE_BITS:
                continue  # one of the two has been merged since
            right = after[left]
            symbol[left] += symbol[right]
            symbol[right] = ""
            best[right] = -1
            following = after[left] = after[right]
            if following < n:
                before[following] = left
            for k, z in ((before[left], left), (left, following)):
                if k >= 0:
                    pair = symbol[k] + symbol[z] if z < n else ""
                    best[k] = r = rank.get(pair, -1)
                    if r >= 0:
                        heapq.heappush(heap, (r << PLACE_BITS) | k)
                        if self.unused:
                            halves[pair] = (symbol[k], symbol[z])
        out = [s for s in symbol if s]
        return [part for s in out for part in self._usable(s, halves)] if self.unused else out

    def _short_agenda(self, symbol: list[str]) -> list[str]:
        """The same order of merges for a few symbols: the first of the best pairs, again and again."""
        get = self.rank.get
        best = [get(a + b, NEVER) for a, b in itertools.pairwise(symbol)]
        while best and (top := min(best)) != NEVER:
            k = best.index(top)
            merged = symbol[k] = symbol[k] + symbol.pop(k + 1)
            del best[k]
            if k < len(best):
                best[k] = get(merged + symbol[k + 1], NEVER)
            if k:
                best[k - 1] = get(symbol[k - 1] + merged, NEVER)
        return symbol

    def _usable(self, piece: str, halves: dict) -> list[str]:
        """A piece, or its parts as far as it may not be used."""
        out, stack = [], [piece]
        while stack:
            p = stack.pop()
            if p in self.unused and p in halves:
                stack += reversed(halves[p])
            else:
                out.append(p)
        return out

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        """Ids of one chunk; characters outside the vocabulary become their bytes, or one unknown id."""
        marked, ids = chunk.replace(" ", SPACE), []
        at = 0
        parts = []
        for m in self.fixed.finditer(marked) if self.fixed else ():
            parts += [*self.agenda(marked[at : m.start()]), m.group()]
            at = m.end()
        lost = False
        for piece in (*parts, *self.agenda(marked[at:])):
            k = self.ids.get(piece, self.unknown)
            if k != self.unknown:
                ids.append(k)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in piece.encode()]
            elif not lost:  # unknown neighbours are one id
                ids.append(k)
            lost = k == self.unknown
        return tuple(ids)

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Chunks of texts of one slice, back to back, and the first chunk of each text."""
        data = texts.buffers()[2]
        if not len(texts):
            return texts, np.zeros(1, np.int64)
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        first, past = int(bounds[0]), int(bounds[-1])
        if self.fixed is not None or not self.plain or self.unknown_run:
            return texts, np.arange(len(texts) + 1)  # whole texts
        raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        begins, last = np.zeros(past - first + 1, bool), 0
        begins[bounds - first] = True
        at = first
        while at < past:
            end = min(past, at + BLOCK)
            while end < past and raw[end] & 0xC0 == 0x80:
                end += 1
            codes = np.frombuffer(bytes(raw[at:end]).decode().encode("utf-32-le"), np.uint32)
            kind = np.r_[np.uint16(last), self.letter_class[codes]]
            width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
            begins[(at - first + np.cumsum(width) - width)[~self.side_by_side[kind[:-1], kind[1:]]]] = True
            last, at = int(kind[-1]), end
        begins[past - first] = False
        begin = first + np.flatnonzero(begins)
        offsets = pa.array(np.r_[begin, past].astype(np.int32))
        chunks = pa.StringArray.from_buffers(len(begin), offsets.buffers()[1], data)
        return chunks, np.searchsorted(begin, bounds)

    @functools.cached_property
    def unknown_run(self) -> bool:
        """Do unknown neighbours share an id, so that cuts between them would show?"""
        return not self.byte_ids

    def normalised(self, texts: pa.Array) -> pa.Array:
        """Texts as the model's merges see them, spaces perhaps unmarked."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.plain:
            return pa.array([self.library.normalize(t) for t in texts.to_pylist()], pa.string())
        if not self.prefix:
            return texts
        return pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text of one slice; null counts as empty."""
        chunks, bounds = self._cut(self.normalised(texts))
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = [c for c in distinct if c not in self.known]
        made = {c: self.chunk_ids(c) for c in fresh}
        self._check(made)
        self.known.update(made)
        rows = [self.known[c] for c in distinct]
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter(itertools.chain.from_iterable(rows), np.int32, int(size.sum()))
        of_chunk = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(flat))
        taken = of_chunk.take(coded.indices)
        ends = taken.offsets.to_numpy() if len(taken) else np.zeros(1, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), taken.values)

    def _check(self, made: dict[str, tuple[int, ...]]) -> None:
        """Hold new chunks against the library, all in one call."""
        if self.checker is None or not made:
            return
        for (chunk, ids), want in zip(made.items(), self.checker.encode(list(made)), strict=True):
            if list(ids) != want:
                raise ValueError(f"the agenda gives {list(ids)} and sentencepiece {want} for {chunk!r}")

    # -- decoding --------------------------------------------------------------

    def _learn_surfaces(self, texts: list[str], kinds: np.ndarray, unknown: str) -> None:
        surface = [t.replace(SPACE, " ").encode() for t in texts]
        for k in np.flatnonzero(kinds == CONTROL):
            surface[k] = b""
        for k in np.flatnonzero(kinds == BYTE):
            surface[k] = bytes([int(texts[k][3:5], 16)])
        surface[self.unknown] = unknown.encode()
        self.surface = pa.array(surface, pa.binary())
        self.spaced = np.array([t.startswith(SPACE) for t in texts]) & (kinds != CONTROL)
        self.control, self.is_byte = kinds == CONTROL, kinds == BYTE

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """Texts of id lists; null for a null list and for one with a null or unheard-of id.

        The space that the model puts before a text goes again.  Bytes that
        spell no character give one U+FFFD each.
        """
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        ids = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = offsets - offsets[0]
        odd = (ids < 0) | (ids >= len(self.surface))
        ids = np.where(odd, 0, ids)
        count = lambda mark: np.diff(np.r_[0, np.cumsum(mark)][bounds]) > 0
        gone = count(odd) | lists.is_null().to_numpy(zero_copy_only=False)
        pieces = self.surface.take(pa.array(ids))
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[: len(ids) + 1].astype(np.int64) if len(ids) else np.zeros(1, np.int64)
        data = pieces.buffers()[2]
        begin, end = ends[bounds[:-1]], ends[bounds[1:]]
        slow = count(self.is_byte[ids]) & (count(self.control[ids]) | gone)
        drops = np.zeros(len(lists), bool)
        if self.prefix or self.collapses:
            # the first id that is no control symbol, if it starts with a space
            real = np.flatnonzero(~self.control[ids])
            at = np.minimum(np.searchsorted(real, bounds[:-1]), max(0, len(real) - 1))
            first = real[at] if len(real) else np.zeros(len(lists), np.int64)
            inside = (first >= bounds[:-1]) & (first < bounds[1:]) if len(real) else drops
            drops = inside & (self.spaced[ids[np.minimum(first, len(ids) - 1)]] if len(ids) else False)
            slow |= drops if self.collapses else False
        raw = memoryview(data) if data is not None else memoryview(b"")
        out: list[str | None] = []
        for k in range(len(lists)):
            if gone[k]:
                out.append(None)
                continue
            try:
                if slow[k]:
                    raise ValueError
                out.append(str(raw[int(begin[k]) + bool(drops[k]) : int(end[k])], "utf-8"))
            except ValueError:
                out.append(self._decode_runs(ids[bounds[k] : bounds[k + 1]].tolist()))
        return pa.array(out, pa.string())

    def _decode_runs(self, ids: list[int]) -> str:
        """One text, byte runs apart: the way for runs that spell no characters."""
        out, seen = "", False
        for is_byte, run in itertools.groupby(ids, lambda k: bool(self.is_byte[k])):
            surfaces = [self.surface[k].as_py() for k in run] if is_byte else None
            if is_byte:
                out += b"".join(surfaces).decode(errors="one-each")
                continue
            for k in run:
                start = not seen and not out and (self.prefix or self.collapses)
                text = self.surface[k].as_py().decode()
                if start and self.spaced[k]:
                    text, seen = text[1:], not self.collapses
                out += text
        return out


def _one_each(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


@functools.lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    import codecs

    codecs.register_error("one-each", _one_each)
    return PieceModel(path)


def _encode_batches(path: str, check_texts: bool):
    def run(batches):
        model = piece_model(path)
        for batch in batches:
            for some in text_slices(batch, most=SLICE_BYTES):
                texts = some.column(1)
                ids = model.encode(texts)
                if check_texts and ids.to_pylist() != model.library.encode([t or "" for t in texts.to_pylist()]):
                    raise ValueError("the agenda and sentencepiece differ on a whole text")
                yield pa.RecordBatch.from_arrays([some.column(0), ids], ["id", "ids"])

    return releasing(run)


def _decode_batches(path: str):
    def run(batches):
        model = piece_model(path)
        for batch in batches:
            lists = batch.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, first = np.cumsum(size), 0
            while first < batch.num_rows:
                past = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK, "right")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, past - first), model.decode(lists.slice(first, past - first))], ["id", "text"])
                first = past

    return releasing(run)


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check_texts: bool = False) -> DataFrame:
    """(id, ids array<int>) of every row, as the library's encode without begin or end ids.

    Map-only.  A null or empty text has no ids; repeated ids stay separate
    rows; an empty table gives an empty result; other columns are not read.
    A text of any length is taken whole: a run of characters that cannot be
    cut costs n log n.  Every new chunk is held against the library and a
    difference stops the job; ``check_texts`` holds whole texts against it too.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_encode_batches(model_path, check_texts), f"id {kind}, ids array<int>").select(F.col("id").alias(id_col), "ids")


def decode_pieces(coded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row, as the library's decode of its ids.

    A null list, or one with a null or an id outside the vocabulary, gives a
    null text; an empty list an empty one.
    """
    bound_batches(coded.sparkSession)
    kind = coded.schema[id_col].dataType.simpleString()
    slim = coded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return slim.mapInArrow(_decode_batches(model_path), f"id {kind}, text string").select(F.col("id").alias(id_col), "text")


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the ids of every text, decoded again, as digests.

    The ids ride along through the decoder, so nothing is shuffled or joined.
    """
    coded = encode_pieces(docs, model_path, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    digests = coded.select(
        F.struct(
            F.col(id_col).alias("id"),
            F.size("ids").cast("long").alias("n_tokens"),
            F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("sha"),
        ).alias("id"),
        "ids",
    )
    back = digests.mapInArrow(_decode_batches(model_path), f"id struct<id:{kind},n_tokens:bigint,sha:string>, text string")
    return back.select(
        F.col("id.id").alias(id_col), F.col("id.n_tokens").alias("n_tokens"), F.col("id.sha").alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )
