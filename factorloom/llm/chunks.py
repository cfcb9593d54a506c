"""Texts cut into distinct chunks and pieces in Arrow, for vocabularies that end pre-tokens at spaces."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII punctuation; small Latin-1 letters; letters and digits that a run of punctuation never joins.
PUNCTUATION = string.punctuation
SMALL_WORD = "^[a-zß-öø-ÿ]+$"
WORD_END = "[0-9A-Za-zÀ-ÖØ-öø-ÿ]$"


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own}
    table.update((b, chr(0x100 + k)) for k, b in enumerate(x for x in range(0x100) if x not in table))
    table[0x20] = " "  # the separator between words
    return table


BYTE_LETTERS = _byte_letters()


def byte_mapped(text: bytes) -> str:
    return text.decode() if text.isascii() else text.decode("latin-1").translate(BYTE_LETTERS)


def case_folded(texts: pa.Array) -> pa.Array:
    """A-Z lower-cased where the vocabulary's own lower-casing does the same.

    Not where a special token's string may stand, nor beside combining marks,
    which compose differently with small letters.
    """
    as_is = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, "[̀-Ϳ]"))
    return pc.if_else(as_is, texts, pc.ascii_lower(texts))


def text_slices(batch: pa.RecordBatch, column: int = 1, most: int = 16_000_000):
    """Slices of a batch of about ``most`` bytes of text, or one text if it is longer."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        past = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(first, past - first)
        first = past


def plain(pieces: pa.Array) -> np.ndarray:
    """Which pieces are small Latin-1 words: one pre-token each, that normalising leaves as it is."""
    return pc.match_substring_regex(pieces, SMALL_WORD).to_numpy(zero_copy_only=False)


class Pieces:
    """The chunks between spaces of some texts, each a head and perhaps a tail of punctuation.

    The pre-tokeniser never joins across a space or a line feed, and always
    cuts between a letter or digit and a following run of punctuation.
    ``bounds`` cuts the chunk numbers ``which`` into texts; ``head`` and
    ``tail`` (-1: none) give each distinct chunk's places in ``distinct``.
    """

    def __init__(self, texts: pa.Array):
        folded = pc.replace_substring(case_folded(pc.fill_null(texts, "")), "\n", " ")
        lists = pc.split_pattern(folded, " ")
        self.bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        self.which, chunks = coded.indices.to_numpy(), coded.dictionary
        heads = pc.ascii_rtrim(chunks, characters=PUNCTUATION)
        cut = pc.and_(pc.match_substring_regex(heads, WORD_END), pc.invert(pc.match_substring(chunks, "<|")))
        heads = pc.if_else(cut, heads, chunks)
        length = pc.binary_length(heads).to_numpy()
        tailed = np.flatnonzero(length < pc.binary_length(chunks).to_numpy())
        tails = [c.encode()[n:].decode() for c, n in zip(chunks.take(pa.array(tailed)).to_pylist(), length[tailed].tolist(), strict=True)]
        pieces = pa.concat_arrays([heads, pa.array(tails, pa.string())]).dictionary_encode()
        self.distinct, piece = pieces.dictionary, pieces.indices.to_numpy()
        self.head, self.tail = piece[: len(chunks)], np.full(len(chunks), -1, np.int64)
        self.tail[tailed] = piece[len(chunks) :]

    def plain(self) -> np.ndarray:
        return plain(self.distinct)


#: Texts on which a vocabulary must give the same whole and cut: case, marks, digits, white space, scripts, special strings.
PROBES = [
    "The Straße of NAÏVE étude, où", "a  b\nc\td \r\n e", "it's DON'T we'll I'M", "x1y22 3.14 1,000", "end. (Begin) [x]... ?!", "--- *** a-b_c/d", "\u4e2d\u6587 text \u0417\u0434\u0440\u0430\u0432",
    "e\u0301 E\u0301 \u00c9", "<|endoftext|> a<|startoftext|>b", " lead and trail ", "\u00a0nb\u2003em", "aaaa zzzzzzzzzzzz", "\U0001f600 smile", "I\u0130\u0131", "a\u200db 'tis ''", "",
]


def cuts_hold(encode_cut, library) -> bool:
    """Does the library give the same ids for whole texts as ``encode_cut`` (an Arrow array to lists of ids)?"""
    whole = [e.ids for e in library.encode_batch(PROBES, add_special_tokens=False)]
    return encode_cut(pa.array(PROBES)) == whole
