"""Token counts, token shards, language, mixing, n-gram join, decontamination: brute force and edge cases."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factorloom.llm import decontamination, mixing, token_output
from factorloom.llm.common import Scratch, connected_components
from factorloom.llm.decontamination import contained_items, leaks_into
from factorloom.llm.language import fit_language_model, grams_of, language_column, predict_language
from factorloom.llm.mixing import mix_sources
from factorloom.llm.ngram_join import shingle_components
from factorloom.llm.queries import tokenizer_path
from factorloom.llm.token_output import Shard, pack_shard, re_pair, token_output as run_token_output, write_token_shards
from factorloom.llm.tokens import ragged_bpe, token_counts

DATA = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\n", "Hello <|endoftext|> world's aaaaaaaa", "<|ENDOFTEXT|> '\tll'LL don't\r\n q..., a''", "x<|startoftext|><|endoftext|>",
    "ΟΔΟΣ İstanbul 　x\x1cy é ́z 漢字 😀!!! »,  Ḵx", "b123,456.7 ª º µ, ÷, ß. ...", "ab" * 3000, "word, word. Word; (word)", "Été l'été ÀÉ, naïve",
]
SCHEMA = "doc_id long, text string, lang string, source string, id string, node string, n_tokens string, copy string, a string, part string"


def frame(spark, texts, langs=None, sources=None, ids=None):
    """Documents with columns whose names clash with what operators use inside."""
    rows = []
    for k, t in enumerate(texts):
        rows.append((ids[k] if ids else k, t, langs[k] if langs else None, sources[k] if sources else None, "i", "n", "t", "c", "a", "p"))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def prose(seed: int, n: int, words: int = 40) -> list[str]:
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    return [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(3, words))) for _ in range(n)]


def test_token_counts_equal_the_library(spark, library):
    docs = frame(spark, [*ODD, ODD[4]])
    got = {r["doc_id"]: r for r in token_counts(docs, tokenizer_path(), limit=20).collect()}
    assert len(got) == len(ODD) + 1
    for k, t in enumerate([*ODD, ODD[4]]):
        want = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[k]["n_tokens"], got[k]["n_bytes"], got[k]["over_limit"]) == (want, len((t or "").encode()), want > 20)
    assert token_counts(docs.limit(0), tokenizer_path()).count() == 0
    bpe = ragged_bpe(tokenizer_path())
    assert bpe.count([]).tolist() == []


def test_token_shards_round_trip(spark, library):
    docs = frame(spark, [*ODD, "same", "same"], ids=[*range(len(ODD)), 3, 3])
    scratch = Scratch(spark, "test-shards")
    shards = write_token_shards(spark, docs, tokenizer_path(), scratch, shard_ids=50, parts=3)
    assert shards.count() > 3
    rows = sorted(token_output.read_token_index(shards).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    assert rows[0]["start"] == 0
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:], strict=False))
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert want == collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows)
    assert run_token_output(spark, docs.limit(0), tokenizer_path()).count() == 0


def test_re_pair_grammar_and_random_access():
    draw = np.random.default_rng(3)
    sizes = np.array([0, 5, 1, 4000, 0, 300])
    ids = draw.integers(0, 6, int(sizes.sum())).astype(np.uint32)
    symbol, per_doc, rules = re_pair(ids, sizes, 10, 4)
    assert rules and len(symbol) < len(ids) and per_doc.sum() == len(symbol) and per_doc[0] == 0
    shard = Shard(pack_shard(ids, sizes, 10, min_count=4))
    assert shard.expand(0, len(shard.symbol)).tolist() == ids.tolist()
    ends = np.r_[0, np.cumsum(sizes)]
    for k in range(len(sizes)):
        assert shard.document(k).tolist() == ids[ends[k] : ends[k + 1]].tolist()
    same = np.full(1000, 7, np.uint32)  # overlapping pairs
    shard = Shard(pack_shard(same, np.array([999, 1]), 10, min_count=2))
    assert shard.document(0).tolist() == [7] * 999 and shard.document(1).tolist() == [7]
    wide = Shard(pack_shard(same, np.array([1000]), 70_000, min_count=2))  # 32-bit symbols
    assert wide.document(0).tolist() == [7] * 1000


def most_frequent_pair(symbol, sizes):
    last = np.zeros(len(symbol), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    pairs = collections.Counter(zip(symbol[:-1][~last[:-1]].tolist(), symbol[1:][~last[:-1]].tolist(), strict=True))
    return max(pairs.values(), default=0)


def test_re_pair_leaves_no_frequent_pair(library):
    docs = spark_free_documents()
    got = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in docs]
    ids, sizes = np.array([x for g in got for x in g], np.uint32), np.array(list(map(len, got)))
    symbol, per_doc, rules = re_pair(ids, sizes, 49_408, token_output.MIN_COUNT)
    assert most_frequent_pair(symbol, per_doc) < token_output.MIN_COUNT <= most_frequent_pair(ids, sizes)
    payload = pack_shard(ids, sizes, 49_408)
    assert len(symbol) < 0.85 * len(ids) and len(payload) < 0.6 * 4 * len(ids) and rules
    assert Shard(payload).expand(0, len(symbol)).tolist() == ids.tolist()
    passage = np.arange(5000, dtype=np.uint32)  # long repeats fold to single symbols
    symbol, per_doc, _ = re_pair(np.tile(passage, 30), np.full(30, 5000), 5000, 24)
    assert per_doc.tolist() == [1] * 30


def spark_free_documents():
    import pyarrow.parquet as pq

    return [t or "" for t in pq.read_table(f"{DATA.replace('0.001', '0.01')}/documents.parquet", columns=["text"]).column("text").to_pylist()]


def test_other_vocabularies_keep_texts_whole(spark, tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(tokenizer_path(), encoding="utf-8") as file:
        spec = json.load(file)
    # the same merges without lower-casing: small and capital letters differ, so cutting by case-folded pieces is wrong
    path = str(tmp_path / "cased.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(spec | {"normalizer": None}, file)
    cased = Tokenizer.from_file(path)
    assert not ragged_bpe(path).cuts and ragged_bpe(tokenizer_path()).cuts
    assert not token_output.ChunkEncoder(path).cuts and token_output.chunk_encoder(tokenizer_path()).cuts
    docs = frame(spark, [*ODD, "Hello WORLD hello"])
    want = {k: len(cased.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate([*ODD, "Hello WORLD hello"])}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, path).collect()} == want
    assert {r["doc_id"]: r["n_tokens"] - 1 for r in run_token_output(spark, docs, path).collect()} == want


def brute_language(docs, held, words_per_lang, grams_per_lang):
    """Languages and scores of ``docs`` (id, text, lang) by the definition, one word at a time."""
    import math

    import regex

    letters = lambda t: regex.findall(r"\p{L}+", t.lower())
    counts = collections.defaultdict(collections.Counter)  # lang -> (n, gram)
    for k, text, lang in docs:
        if lang is not None and text is not None and not held(k):
            for w in letters(text):
                counts[lang][0, w] += 1
                for n in range(1, 6):
                    for g in grams_of(w, n):
                        counts[lang][n, g] += 1
    langs, known = sorted(counts), set()
    for c in counts.values():
        for of_words, most in ((True, words_per_lang), (False, grams_per_lang)):
            known.update(sorted((g for g in c if (g[0] == 0) == of_words), key=lambda g: (-c[g], g))[:most])
    seen = {(x, n): max(1, sum(counts[x][g] for g in known if g[0] == n)) for x in langs for n in range(6)}
    least = lambda x, n: 0.1 * seen[x, n] / (sum(seen[y, n] for y in langs) / len(langs))
    totals = {(x, n): sum(counts[x][g] + least(x, n) for g in known if g[0] == n) for x in langs for n in range(6)}
    rows = {}
    for g in known:
        rate = [math.log((counts[x][g] + least(x, g[0])) / totals[x, g[0]]) for x in langs]
        rows[g] = [r - math.log(sum(math.exp(q) for q in rate)) for r in rate]
    out = {}
    for k, text, _ in docs:
        words = letters(text or "")
        total = [0.0] * len(langs)
        for w in words:
            mine = [(0, w)] if (0, w) in rows else next((f for n in range(min(5, len(w) + 2), 0, -1) if (f := [(n, g) for g in grams_of(w, n) if (n, g) in rows])), [])
            total = [t + sum(rows[g][i] for g in mine) / max(1, len(mine)) for i, t in enumerate(total)]
        if not words:
            out[k] = ("und", 0.0)
            continue
        mean = [t / len(words) * min(len(words), 40) for t in total]
        odds = [math.exp(m - max(mean)) for m in mean]
        out[k] = (langs[odds.index(max(odds))], max(odds) / sum(odds))
    return out


def test_language_scores_equal_brute_force(spark):
    texts = [*prose(21, 12, 9), "über straße", "", None, "Ab ab aB", "123 !!", "漢字 x", *ODD[3:]]
    langs = ["x", "y", None, "small"] * 3 + ["y"] * (len(texts) - 12)
    texts = [f"{t} {'ein haus' if lang == 'y' else 'a house'}" if t else t for t, lang in zip(texts, langs, strict=True)]
    docs = frame(spark, texts, langs=langs)
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    for most in (12_000, 7):  # all of a language's words, and its first few
        model = fit_language_model(spark, docs, words_per_lang=most, grams_per_lang=most)
        want = brute_language([(k, t, x) for k, (t, x) in enumerate(zip(texts, langs, strict=True))], held, most, most)
        got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict_language(spark, docs, model).collect()}
        assert got.keys() == want.keys()
        for k, (lang, score) in want.items():
            assert got[k][1] == pytest.approx(score, abs=1e-3) and (got[k][0] == lang or abs(score - 1 / 3) < 1e-3), (k, got[k], want[k])


def test_a_small_language_keeps_its_words(spark):
    big = prose(22, 60, 40)
    docs = frame(spark, [*big, *["kleine sprache eigene worte"] * 8], langs=["big"] * 60 + ["small"] * 8)
    model = fit_language_model(spark, docs, words_per_lang=50, grams_per_lang=50)
    assert {"kleine", "sprache", "eigene", "worte"} <= model.words.keys() and len(model.words) <= 54


def test_language_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = fit_language_model(spark, docs)
    got = predict_language(spark, docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    n, right = got.count(), got.where("lang = lang_pred").count()
    assert n > 20 and right / n > 0.95
    # what is held out is no training row
    assert not any(zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 for r in got.collect())
    odd = frame(spark, [*ODD, "1234 ... !!"])
    rows = {r["doc_id"]: r for r in predict_language(spark, odd, model).collect()}
    assert all(rows[k]["lang_pred"] == "und" and rows[k]["score"] == 0 for k in (0, 1, 2, 3, len(ODD)))
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    flagged = odd.withColumn("g", language_column(spark, model)).select("doc_id", "g.lang_pred", "g.score").collect()
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in flagged} == {k: (r["lang_pred"], r["score"]) for k, r in rows.items()}
    none = fit_language_model(spark, odd)
    assert none.langs == [] and {r["lang_pred"] for r in predict_language(spark, odd, none).collect()} == {"und"}
    assert predict_language(spark, odd.limit(0), model).count() == 0


def test_language_falls_back_to_shorter_grams(spark):
    texts = ["abcde " * 50, "vwxyz " * 50] * 30
    docs = frame(spark, texts, langs=["x", "y"] * 30)
    model = fit_language_model(spark, docs)
    assert grams_of("ab", 3) == ["\x02ab", "ab\x03"]
    vectors = model.word_vectors(["abcde", "bcd", "zz", "漢"])
    assert vectors[0].argmax() == vectors[1].argmax() == model.langs.index("x") and vectors[2].argmax() == model.langs.index("y")
    assert vectors[3].tolist() == [0, 0]  # nothing known: no evidence


def poisson_count(seed: int, doc_id, rate: float) -> int:
    import hashlib
    import math

    u = int(hashlib.md5(f"{seed}:{doc_id}".encode()).hexdigest()[:13], 16) / float(1 << 52)
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u and k < 10_000:
        k += 1
        p *= rate / k
        total += p
    return k


def test_mixing_inverts_poisson_and_keeps_columns(spark):
    sources = ["a"] * 60 + ["b"] * 30 + [None] * 9
    docs = frame(spark, prose(1, 99), sources=sources)
    out = mix_sources(spark, docs, alpha=0.0, epochs=2.0)
    assert set(out.columns) == {*docs.columns, "shuffle_key"}  # the clashing column ``copy`` is the operator's
    got = collections.Counter(r["doc_id"] for r in out.collect())
    sizes = collections.Counter(sources)
    for k, s in enumerate(sources):
        assert got[k] == poisson_count(17, k, (1 / 3) * 99 * 2.0 / sizes[s])
    keys = [r["shuffle_key"] for r in out.collect()]
    assert keys == sorted(keys)
    targeted = mix_sources(spark, docs, targets={"a": 1.0, "absent": 5.0}, epochs=0.5).collect()
    assert targeted and {r["source"] for r in targeted} == {"a"}
    assert mix_sources(spark, docs.limit(0)).count() == 0
    few = frame(spark, ["t"] * 3, sources=["big", "big", "small"])
    many = mix_sources(spark, few, targets={"small": 1.0}, epochs=400.0).where("source = 'small'").count()
    assert 1000 <= many <= 1400  # a rate of 1200: a sum of four draws


def test_mixing_at_a_high_rate_is_poisson(spark):
    docs = spark.range(2400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "s").otherwise("t").alias("source"))
    counts = mix_sources(spark, docs, targets={"s": 1.0}, epochs=500 * 2000 / 2400).groupBy("doc_id").count().select(F.avg("count"), F.var_samp("count"), F.count("count")).first()
    assert counts[2] == 2000 and abs(counts[0] - 500) < 2 and abs(counts[1] - 500) < 50  # four and three standard errors


def test_mixing_salted_join_gives_the_same(spark, monkeypatch):
    docs = frame(spark, prose(2, 50), sources=["a", "b"] * 25)
    plain = sorted((r["doc_id"], r["copy"]) for r in mix_sources(spark, docs).collect())
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert sorted((r["doc_id"], r["copy"]) for r in mix_sources(spark, docs).collect()) == plain


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute_components(ids, texts, percent=80):
    sets = [shingles(t) for t in texts]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    return [min(groups[find(i)]) for i in range(len(ids))], [len(s) for s in sets]


def near_copies(seed: int, base: str, n: int, edits: int) -> list[str]:
    draw, out = random.Random(seed), []
    for k in range(n):
        words = base.split()
        for _ in range(edits):
            words[draw.randrange(len(words))] = f"edit{k}x{draw.randrange(1000)}"
        out.append(" ".join(words))
    return out


def test_hot_shingles_skip_the_counting(spark, monkeypatch):
    from factorloom.llm import ngram_join as nj

    monkeypatch.setattr(nj, "HOT_DOCS", 5)
    monkeypatch.setattr(nj, "PART_BYTES", 1 << 10)  # many parts, of several shares
    monkeypatch.setattr(nj, "SHARE_BYTES", 1 << 8)
    licence = "this text is free under the terms of the licence that all know"
    texts = [f"{licence} {' '.join(f'w{k // 3}x{j}' for j in range(12 + k % 3))}" for k in range(60)] + [licence] * 4 + [licence + " well"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hot = nj.hot_shingles(docs, len(texts), 5, 10_000, 5)
    assert len(hot) == len(shingles(licence))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t.encode() for t in texts])], ["id", "text"])
    counted = [b for out in nj._shingle_batches(nj.Deal(7, 3), 5, hot)(iter([batch])) for b in out.column("block").drop_null().to_pylist() if not np.frombuffer(b, "<u4", 4)[2]]
    assert counted and not np.isin(nj._read_blocks(counted)[2], hot).any()
    component, sizes = brute_components(list(range(len(texts))), texts)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in shingle_components(spark, docs).collect()}
    assert got == {k: (c, n) for k, (c, n) in enumerate(zip(component, sizes, strict=True))}


def test_ngram_join_equals_brute_force(spark):
    base = " ".join(f"b{i}" for i in range(120))
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [None, "", " \t ", "one two", "ONE  two", "one two three four five", *prose(4, 40), *near_copies(5, base, 25, 2), *near_copies(6, base, 10, 4)]
    texts += [f"{p} {passage}" for p in prose(7, 12, 30)]  # a shared passage links nothing by itself
    texts += ["same text of seven words right here"] * 20  # copies
    # a threshold hit exactly: 8 of 10 shingles in the union
    texts += [" ".join(f"t{i}" for i in range(13)), " ".join(f"t{i}" for i in range(12))]
    ids = list(range(1000, 1000 + len(texts)))
    docs = frame(spark, texts, ids=ids)
    got = {r["doc_id"]: r for r in shingle_components(spark, docs).collect()}
    want, sizes = brute_components(ids, texts)
    assert {k: r["component_id"] for k, r in got.items()} == dict(zip(ids, want, strict=True))
    assert {k: r["n_shingles"] for k, r in got.items()} == dict(zip(ids, sizes, strict=True))
    assert shingle_components(spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("rounds", [0, 1])
def test_ngram_join_without_leader_rounds(spark, rounds):
    chain = [" ".join(f"c{i}" for i in range(k, k + 60)) for k in range(0, 40, 2)]  # each links only to its neighbours
    ids = list(range(len(chain)))
    got = {r["doc_id"]: r["component_id"] for r in shingle_components(spark, frame(spark, chain), star_rounds=rounds + 1).collect()}
    assert [got[i] for i in ids] == brute_components(ids, chain)[0]


def test_repeated_ids_keep_their_rows(spark):
    docs = frame(spark, ["a b c d e f", "a b c d e f", "x y z", None], ids=[7, 7, 7, 7])
    rows = shingle_components(spark, docs).collect()
    assert len(rows) == 4 and {r["component_id"] for r in rows} == {7}


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (5, 5)] + [(200, 200 + k) for k in range(1, 40)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(spark, df, Scratch(spark, "test-cc")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and all(got[200 + k] == 200 for k in range(40))
    assert connected_components(spark, df.limit(0), Scratch(spark, "test-cc")).count() == 0


def test_decontamination_equals_brute_force(spark, monkeypatch):
    items = [*prose(11, 30, 40), "too short", None, "", " ".join(f"z{i}" for i in range(300))]
    draw = random.Random(12)
    texts = [None, "", "too short", "Too SHORT", *prose(13, 60, 400)]
    for k in range(40):  # whole items, and items with every tenth word changed, inside long texts
        words = (items[k % 30] or "").split()
        if k % 2:
            words = [w if (i + k) % 11 else "changed" for i, w in enumerate(words)]
        around = prose(100 + k, 1, 600)[0].split()
        at = draw.randrange(len(around))
        texts.append(" ".join([*around[:at], *words, *around[at:]]))
    texts.append(" ".join(f"z{i}" for i in range(280)))
    docs = frame(spark, texts)
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)], "item_id long, text string, doc_id string")
    want = set()
    for d, t in enumerate(texts):
        own = shingles(t)
        for i, item in enumerate(items):
            s = shingles(item)
            if s and 100 * len(s & own) >= 80 * len(s):
                want.add((d, i, len(s), len(s & own)))
    got = {(r["doc_id"], r["item_id"], r["item_shingles"], r["shared"]) for r in contained_items(spark, docs, bench).collect()}
    assert got == want and len(want) > 20
    assert {r["doc_id"] for r in docs.where(leaks_into(spark, bench)).collect()} == {w[0] for w in want}
    monkeypatch.setattr(decontamination, "ITEMS_PER_BLOCK", 7)  # a benchmark of several blocks
    assert {(r["doc_id"], r["item_id"]) for r in contained_items(spark, docs, bench).collect()} == {w[:2] for w in want}
    assert contained_items(spark, docs, bench.limit(0)).count() == 0
    assert contained_items(spark, docs.limit(0), bench).count() == 0


def test_recall_of_containment_by_item_length(spark):
    draw, items, texts = random.Random(31), [], []
    for k in range(600):
        n = (5, 6, 7, 9, 14, 30)[k % 6]
        words = [f"i{k}w{j}" for j in range(n)]
        items.append(" ".join(words))
        if n >= 30:
            words[0] = "changed"
        texts.append(" ".join([*(f"x{draw.randrange(9999)}" for _ in range(50)), *words, *(f"y{draw.randrange(9999)}" for _ in range(50))]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = collections.Counter(len(items[r["item_id"]].split()) for r in contained_items(spark, frame(spark, texts), bench).collect())
    assert found[5] == found[6] == found[7] == 100  # up to four shingles: exact (eight words are four shingles)
    assert sum(found.values()) >= 599


def test_chunks_of_one_batch_are_encoded_in_runs(library):
    encoder = token_output.chunk_encoder(tokenizer_path())
    texts = [*ODD, *prose(20, 30)]
    for most in (1, 40, 10_000):
        at = 0
        for first, ids, sizes in encoder.encode(pa.array(texts, pa.string()), most):
            assert first == at
            k = 0
            for n in sizes.tolist():
                assert ids[k : k + n].tolist() == library.encode(texts[at] or "", add_special_tokens=False).ids
                k, at = k + n, at + 1
        assert at == len(texts)


class Counted:
    """A library that notes what is sent to it."""

    def __init__(self, library, sent):
        self.library, self.sent = library, sent

    def encode_batch_fast(self, texts, **options):
        self.sent += [w for t in texts for w in t.split(" ")]
        return self.library.encode_batch_fast(texts, **options)


def test_pieces_of_earlier_texts_are_not_encoded_again(library, monkeypatch):
    encoder, sent = token_output.ChunkEncoder(tokenizer_path()), []
    encoder.words, encoder.library = Counted(encoder.words, sent), Counted(encoder.library, sent)
    some, more = [*ODD, *prose(20, 30)], [*prose(21, 30), "Été étéé new, w1 new?", "ab" * 3001]
    for texts in (some, more, some):
        for kept in (token_output.KEPT_PIECES, 40, 0, token_output.KEPT_PIECES):  # enough for all, for some, for none
            monkeypatch.setattr(token_output, "KEPT_PIECES", kept)
            [(_, ids, sizes)] = encoder.encode(pa.array(texts, pa.string()))
            want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
            assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]
            assert len(encoder.known) <= max(kept, 0) and len(encoder.known) == len(encoder.size) == len(set(encoder.known.to_pylist()))
        sent.clear()
        list(encoder.encode(pa.array(texts, pa.string())))
        assert all(len(w) > token_output.KEPT_BYTES for w in sent)  # only long pieces once more


def test_distinct_pairs_that_share_buckets():
    draw = np.random.default_rng(5)
    pair = draw.integers(0, 50, 4000).astype(np.uint64)
    for bucket in (np.zeros(4000, np.int64), (pair % np.uint64(7)).astype(np.int64), pair.astype(np.int64)):
        kinds, which, count = token_output.distinct_pairs(pair, bucket)
        assert kinds[which].tolist() == pair.tolist()
        assert dict(zip(kinds.tolist(), count.tolist(), strict=True)) == collections.Counter(pair.tolist())
    kinds, which, count = token_output.distinct_pairs(pair[:0], pair[:0].astype(np.int64))
    assert len(kinds) == len(which) == len(count) == 0


def test_scratch_uses_the_shared_folder(spark):
    kept = Scratch(spark, "where").keep(spark.range(3), "t")
    assert kept.scratch_path.startswith(spark.conf.get("spark.checkpoint.dir")) and kept.select(F.sum("id")).first()[0] == 3


def test_rows_without_an_id_of_their_own_draw_for_themselves(spark, monkeypatch):
    rows = [(None, "same text", "en", "s")] * 2500 + [(7, "same text", "en", "s")] * 2500 + [(None, f"t{k}", "en", "s") for k in range(2500)] + [(k % 900 + 100, f"u{k}", None, "s") for k in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    kinds = {"no id, equal": "doc_id is null and text = 'same text'", "one id, equal": "doc_id = 7", "no id": "doc_id is null and text <> 'same text'", "repeated ids": "doc_id >= 100"}
    for limit in (mixing.MAX_BROADCAST_IDS, 10):
        monkeypatch.setattr(mixing, "MAX_BROADCAST_IDS", limit)
        out = mix_sources(spark, docs, epochs=1.0).cache()
        assert out.distinct().count() == out.count()  # equal rows have keys of their own
        for name, where in kinds.items():
            some = out.where(where)
            assert abs(some.count() - 2500) < 4 * 50, name  # the sum of 2,500 draws of mean one
            sizes = [r["count"] for r in some.groupBy(F.spark_partition_id()).count().collect()]
            assert len(sizes) == 4 and max(sizes) < 0.4 * 2500, name
        first = out.where("copy = 1").count() / 10_000
        assert abs(first - (1 - np.exp(-1))) < 0.03  # each row for itself, not all or none
        again = mix_sources(spark, docs.repartition(3), epochs=1.0)  # wherever the rows lie
        assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, out.collect()), key=repr)
        out.unpersist()


def test_mixing_of_odd_ids_equals_its_sql(spark):
    import duckdb

    from factorloom.llm.queries import MIX_ALPHA, OP5_SQL

    rows = [(k % 40 if k % 3 else None, f"t{k % 25}", None if k % 7 == 0 else "en", f"s{k % 2}", k % 5) for k in range(600)] + [(1000 + k, "t", "en", "s1", 1) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    con = duckdb.connect()
    con.register("given", pa.Table.from_pandas(docs.toPandas().astype({"doc_id": "Int64"}), preserve_index=False))
    con.execute("CREATE TABLE documents AS SELECT * FROM given")
    got = mix_sources(spark, docs, alpha=MIX_ALPHA)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({OP5_SQL})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_very_long_words(library, monkeypatch):
    import time

    from factorloom.llm import tokens

    bpe, draw = ragged_bpe(tokenizer_path()), random.Random(2)
    count = lambda texts: bpe.count_texts(pa.array(texts), bpe.cuts).tolist()
    text = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    began = time.time()
    got = count([text])
    assert time.time() - began < 5 * max(1.0, _slowness())
    assert got == [len(library.encode(text, add_special_tokens=False).ids)]
    monkeypatch.setattr(tokens, "LONG", 3)  # the buckets give what the rounds give
    some = ["".join(draw.choice("abcdeé中 .,0a") for _ in range(draw.randint(0, 80))) for _ in range(800)] + ["a" * n for n in range(20)]
    assert count(some) == [len(library.encode(t, add_special_tokens=False).ids) for t in some]


def _slowness() -> float:
    """Times the usual time that this machine takes just now."""
    import time

    began = time.thread_time()
    sum(range(2_000_000))
    return (time.thread_time() - began) / 0.04


def test_many_labels_make_a_sparse_model(spark, monkeypatch):
    from factorloom.llm import language

    draw = random.Random(13)
    own = {f"l{k:03d}": ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(12)] for k in range(200)}
    texts = [(" ".join(draw.choice(words) for _ in range(15)), x) for x, words in own.items() for _ in range(6)]
    docs = frame(spark, [t for t, _ in texts], langs=[x for _, x in texts])
    model = fit_language_model(spark, docs)
    rows = len(model.kind)
    assert len(model.langs) > 190 and len(model.gain) < 0.03 * rows * len(model.langs)  # a label may be held out as a whole
    got = {r["doc_id"]: r["lang_pred"] for r in predict_language(spark, docs, model).collect()}
    assert sum(got[k] == x for k, (_, x) in enumerate(texts) if x in model.langs) > 0.99 * 6 * len(model.langs)
    scores = {r["doc_id"]: r["score"] for r in predict_language(spark, docs, model).collect()}
    monkeypatch.setattr(language, "LANGUAGES", 7)  # this process scores in blocks of languages what the tasks score at once
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([False] * 5), pa.array([t.encode() for t, _ in texts[:5]])], ["id", "held_out", "text"])
    shared = type("Shared", (), {"value": model})
    blocks = [b for b in language._predict_batches(shared)([batch])][0]
    assert blocks.column(3).to_pylist() == pytest.approx([scores[k] for k in range(5)])
    monkeypatch.setattr(language, "MAX_BROADCAST_LABELS", 10)  # the salted join gives the same sample
    again = fit_language_model(spark, docs)
    assert again.langs == model.langs and (again.start == model.start).all() and np.allclose(again.gain, model.gain)
    few = fit_language_model(spark, docs, sample_rows=200)  # about one document a label
    assert 50 < len({int(x) for x in few.lang}) <= 200
