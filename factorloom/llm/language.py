"""Language identification by words first, then shorter and shorter character n-grams.

Fitting takes a bounded sample of labelled training rows (by hash of the id up to
``sample_per_lang`` documents of each language, fewer if there are so many
languages that these would be more than ``sample_rows``).  The grouped counts of
all of its words and character n-grams are the model.  It is sparse: what a
language lacks has one rate, so an entry is kept only where it occurs.  A word
of a text is scored by its log frequency in each language.  A word the model
does not know falls back to its 5-grams, then 4-, 3-, 2- and 1-grams, at the
first length of which the model knows any.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.llm.chunks import text_slices
from factorloom.llm.common import bound_batches, releasing

LONGEST_GRAM = 5
#: Bytes of text whose words are scored at once, and languages whose columns stand side by side.
SLICE_BYTES, LANGUAGES = 6_000_000, 64
#: Labels whose shares may be broadcast; with more of them the join is salted.
MAX_BROADCAST_LABELS, SALTS = 10_000, 64
#: Words beyond this many stop adding to the evidence behind ``score``.
EVIDENCE_WORDS = 40


def is_held_out(id_col: str):
    """Rows whose crc32 of the id as text leaves remainder 1 by 3 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams; marks of the word's ends are part of those longer than one."""
    padded = f"\x02{word}\x03" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _letters():
    import regex

    return regex.compile(r"\p{L}+").findall


def _count_batches(batches):
    letters, words = _letters(), {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(letters(text.lower()))
    for lang, count in words.items():
        grams = [Counter() for _ in range(LONGEST_GRAM + 1)]
        grams[0] = count
        for word, c in count.items():
            for n in range(1, LONGEST_GRAM + 1):
                for g in grams_of(word, n):
                    grams[n][g] += c
        for n, found in enumerate(grams):
            keys = list(found)
            for at in range(0, len(keys), 20_000):
                some = keys[at : at + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some)), pa.array([n] * len(some), pa.int32()), pa.array(some), pa.array([found[k] for k in some], pa.int64())],
                    ["lang", "n", "gram", "c"],
                )


class LanguageModel:
    """Log posteriors (uniform prior) of each known word and n-gram, kept where a language has it.

    Row k has the entries ``start[k]`` to ``start[k + 1]`` of ``lang`` and
    ``gain``; every other language has ``base`` of the row's kind, and ``norm``
    is taken from all.
    """

    def __init__(self, langs: list[str], grams: list[str], kind: np.ndarray, base: np.ndarray, norm: np.ndarray, start: np.ndarray, lang: np.ndarray, gain: np.ndarray):
        self.langs, self.kind, self.base, self.norm, self.start, self.lang, self.gain = langs, kind, base, norm, start, lang, gain
        words = int((kind == 0).sum())  # they come first
        self.words = {g: k for k, g in enumerate(grams[:words])}
        self.grams = {g: k for k, g in enumerate(grams[words:], words)}

    @staticmethod
    def none() -> LanguageModel:
        empty = np.zeros(0)
        return LanguageModel([], [], empty.astype(np.int8), np.zeros((LONGEST_GRAM + 1, 0)), empty, np.zeros(1, np.int64), empty.astype(np.int32), empty)

    def fallback(self, word: str) -> list[int]:
        """Rows of the longest n-grams of an unseen word that the model knows."""
        get = self.grams.get
        for n in range(min(LONGEST_GRAM, len(word) + 2), 0, -1):
            known = [k for g in grams_of(word, n) if (k := get(g)) is not None]
            if known:
                return known
        return []

    def rows(self, words: list[str]) -> list[list[int]]:
        """Of each word its own row, or its fallback's, or none."""
        own = self.words.get
        return [[k] if (k := own(w)) is not None else self.fallback(w) for w in words]

    def vectors(self, rows: np.ndarray, first: int = 0, past: int | None = None) -> np.ndarray:
        """Dense rows over some of the languages."""
        past = len(self.langs) if past is None else past
        out = (self.base[self.kind[rows], first:past] - self.norm[rows][:, None]).astype(np.float32)
        size = self.start[rows + 1] - self.start[rows]
        at = np.arange(int(size.sum())) + np.repeat(self.start[rows] - np.cumsum(size) + size, size)
        lang, row = self.lang[at], np.repeat(np.arange(len(rows)), size)
        here = (lang >= first) & (lang < past)
        out[row[here], lang[here] - first] += self.gain[at[here]]
        return out

    def word_vectors(self, words: list[str]) -> np.ndarray:
        """Log posteriors of each word: its own row, or the mean of its fallback's rows, or zeros."""
        flat, size = flattened(self.rows(words))
        return segment_sums(self.vectors(flat), np.arange(len(flat)), size, mean=True)


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(size.sum())), size


def segment_sums(table: np.ndarray, flat: np.ndarray, size: np.ndarray, mean: bool = False) -> np.ndarray:
    """Sum or mean of the table's rows ``flat``, for segments of these sizes."""
    out = np.zeros((len(size), table.shape[1]), np.float32)
    full = np.flatnonzero(size)
    if len(full):
        out[full] = np.add.reduceat(table[flat], (np.cumsum(size) - size)[full], axis=0)
        if mean:
            out[full] /= size[full, None]
    return out


def fit_language_model(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_per_lang: int = 1500, sample_rows: int = 200_000, words_per_lang: int | None = None, grams_per_lang: int | None = None, max_langs: int | None = None,
) -> LanguageModel:
    """Fit on training rows with a language and a text; see the module's docstring for the bounds of the sample.

    All labels are learned and all words and n-grams of the sample kept, unless
    the last three parameters ask for the most frequent alone.  Null ids,
    labels and texts teach nothing; rows that repeat count again; without rows
    to learn from the model knows no language.
    """
    train = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(id_col)).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    per_lang = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    if max_langs is not None:
        per_lang = per_lang.orderBy(F.desc("n"), "lang").limit(max_langs)
    labels = per_lang.count()
    if not labels:
        return LanguageModel.none()
    each = max(1.0, min(sample_per_lang, sample_rows / labels))
    share = per_lang.select("lang", F.least(F.lit(1.0), F.lit(float(each)) / F.col("n")).alias("share"))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    known = train.where(F.col("text").isNotNull()).withColumn("drawn", drawn)
    if labels <= MAX_BROADCAST_LABELS:
        joined = known.join(F.broadcast(share), "lang")
    else:
        salted = share.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = known.withColumn("salt", F.pmod("drawn", F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    picked = joined.where(F.col("drawn") < F.col("share") * (1 << 20))
    counts = (
        picked.select("lang", "text")
        .mapInArrow(releasing(_count_batches), "lang string, n int, gram string, c long")
        .groupBy("n", "gram", "lang").agg(F.sum("c").alias("c"))
    )
    if words_per_lang is not None or grams_per_lang is not None:
        own = Window.partitionBy("lang", F.col("n") > 0).orderBy(F.desc("c"), "n", "gram")
        most = F.when(F.col("n") == 0, F.lit(words_per_lang)).otherwise(F.lit(grams_per_lang))
        ranked = counts.withColumn("top", F.coalesce(F.row_number().over(own) <= most, F.lit(True)))
        counts = counts.join(ranked.where("top").select("n", "gram").distinct(), ["n", "gram"])
    return _model_of(counts.orderBy("n", "gram", "lang").toArrow(), sorted(r["lang"] for r in share.select("lang").collect()))


def _model_of(counts: pa.Table, langs: list[str]) -> LanguageModel:
    """The sparse model of sorted counts (n, gram, lang, c), which are those of a bounded sample."""
    if not counts.num_rows:
        model = LanguageModel.none()
        model.langs, model.base = langs, np.zeros((LONGEST_GRAM + 1, len(langs)))
        return model
    n, c = counts.column("n").to_numpy(), counts.column("c").to_numpy().astype(np.float64)
    lang = pc.index_in(counts.column("lang"), value_set=pa.array(langs)).to_numpy().astype(np.int32)
    grams = counts.column("gram").combine_chunks()
    new = np.r_[True, pc.not_equal(grams[1:], grams[:-1]).to_numpy(zero_copy_only=False) | (n[1:] != n[:-1])]
    start = np.r_[np.flatnonzero(new), len(n)]
    row = np.cumsum(new) - 1
    kind = n[start[:-1]].astype(np.int8)
    base, rate = np.zeros((LONGEST_GRAM + 1, len(langs))), np.zeros(len(n))
    for k in np.unique(kind).tolist():
        here, rows = n == k, int((kind == k).sum())
        seen = np.bincount(lang[here], c[here], len(langs))
        size = np.maximum(seen, 1.0)
        # what a language lacks is as rare in all of them, whatever their sizes
        rare = 0.1 * size / size.mean()
        whole = np.log(seen + rare * rows)
        base[k] = np.log(rare) - whole
        rate[here] = np.log(c[here] + rare[lang[here]]) - whole[lang[here]]
    gain = rate - base[n, lang]
    # a row's sum over all languages: the base of its kind, with what its entries add
    odds = np.exp(base).sum(axis=1)[kind] + np.bincount(row, np.exp(rate) - np.exp(base[n, lang]), len(kind))
    return LanguageModel(langs, grams.take(pa.array(start[:-1])).to_pylist(), kind, base, np.log(odds), start, lang, gain.astype(np.float32))


def _predict_batches(model):
    def run(batches):
        known, letters = model.value, _letters()
        width = len(known.langs)
        for batch in batches:
            for piece in text_slices(batch, column=2, most=SLICE_BYTES):
                texts = pc.fill_null(piece.column(2).cast(pa.string()), "")
                # white space never stands inside a word, so a distinct chunk is scored once
                lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
                bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                coded = lists.flatten().dictionary_encode()
                chunks = coded.dictionary.to_pylist()
                inside = [[c.lower()] if c.isalpha() else letters(c.lower()) for c in chunks]
                seen = dict.fromkeys(itertools.chain.from_iterable(inside))
                place = dict(zip(seen, range(len(seen)), strict=True))
                used, rows = np.unique((flat := flattened(known.rows(list(seen))))[0], return_inverse=True)
                chunk_words = flattened([[place[w] for w in ws] for ws in inside])
                words = chunk_words[1]
                which, size = coded.indices.to_numpy(), np.diff(bounds)
                total, n = np.zeros((len(size), width)), np.zeros(len(size), np.int64)
                full = np.flatnonzero(size)
                if len(full):
                    n[full] = np.add.reduceat(words[which], bounds[:-1][full])
                    for first in range(0, width, LANGUAGES):
                        past = min(width, first + LANGUAGES)
                        sums = segment_sums(segment_sums(known.vectors(used, first, past), rows, flat[1], mean=True), *chunk_words)
                        total[full, first:past] = np.add.reduceat(sums[which].astype(np.float64), bounds[:-1][full], axis=0)
                pred, score = ["und"] * len(size), np.zeros(len(size))
                if width:
                    mean = total / np.maximum(n, 1)[:, None] * np.minimum(n, EVIDENCE_WORDS)[:, None]
                    odds = np.exp(mean - mean.max(axis=1, keepdims=True))
                    odds /= odds.sum(axis=1, keepdims=True)
                    best = odds.argmax(axis=1)
                    pred = [known.langs[b] if k else "und" for b, k in zip(best.tolist(), n.tolist(), strict=True)]
                    score = np.where(n > 0, odds[np.arange(len(best)), best], 0.0)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    return releasing(run)


def predict_language(spark: SparkSession, docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, lang_pred, score.

    Map-only over whole texts; the model (bounded by its fit parameters) is the
    one broadcast.  A null text or one without letters is ``und`` with score 0;
    so is every text if no language was learned.  Ties go to the language that
    sorts first.  ``score`` is the posterior with the evidence of at most
    ``EVIDENCE_WORDS`` average words: a text of which the model knows nothing
    scores one over the number of languages.
    """
    bound_batches(spark)
    out_id = docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).alias("id"), is_held_out(id_col).alias("held_out"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    return slim.mapInArrow(_predict_batches(shared), f"id {out_id}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def language_column(spark: SparkSession, model: LanguageModel, text_col: str = "text"):
    """Column struct<lang_pred, score> of a text column, for filters that keep whole rows in place."""
    bound_batches(spark)
    predict = _predict_batches(spark.sparkContext.broadcast(model))
    return F.arrow_udf(_struct_arrays(predict), "lang_pred string, score double")(F.encode(F.col(text_col), "UTF-8"))


def _struct_arrays(predict):
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizes: list[int] = []

        def batches():
            for array in arrays:
                sizes.append(len(array))
                blank = pa.nulls(len(array), pa.bool_())
                yield pa.RecordBatch.from_arrays([blank, blank, array], ["id", "held_out", "text"])

        held: list[pa.RecordBatch] = []
        for out in predict(batches()):
            held.append(out)
            if sum(b.num_rows for b in held) == sizes[-1]:  # all pieces of one input array
                table = pa.Table.from_batches(held).combine_chunks()
                columns = [table.column(c).chunk(0) for c in ("lang_pred", "score")]
                yield pa.StructArray.from_arrays(columns, ["lang_pred", "score"])
                held = []

    return run
