"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factorloom.llm.common import read_table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorloom.llm.tokens import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path())


#: The rules of the url query: (action, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorloom.llm.url_filter import url_verdicts

    return url_verdicts(spark, read_table(spark, sf_dir, "pages"), URL_RULES)


OP7_SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(action, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
SELECT page_id, host, path,
  (SELECT h || p FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1) AS rule,
  COALESCE((SELECT action FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1), 'allow') AS verdict
FROM s
"""


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorloom.llm.decontamination import contained_items

    return contained_items(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_chat_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in reply order without quotes, linked by quotations of every level."""
    from factorloom.llm.chat import format_threads, link_conversations

    return format_threads(link_conversations(spark, read_table(spark, sf_dir, "conversations")))


def op9_chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of these conversations with their parents."""
    from factorloom.llm.chat import link_conversations

    return link_conversations(spark, read_table(spark, sf_dir, "conversations")).drop("links")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorloom.llm.token_output import token_output

    return token_output(spark, read_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorloom.llm.near_embeddings import near_embeddings

    return near_embeddings(spark, read_table(spark, sf_dir, "embeddings"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorloom.llm.html_text import page_texts

    return page_texts(spark, read_table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorloom.llm.language import fit_language_model, predict_language

    docs = read_table(spark, sf_dir, "documents")
    return predict_language(spark, docs, fit_language_model(spark, docs))


PIECE_MODEL = "piece_bpe_32k.model"


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorloom.llm.pieces import piece_digests

    return piece_digests(read_table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from factorloom.llm.hard_negatives import hard_negatives

    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(spark, read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label_col=moved)


OP12_SQL = """
WITH q AS MATERIALIZED (SELECT row_number() OVER () AS no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS MATERIALIZED (SELECT a.no AS a, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM q a JOIN q b ON a.no <> b.no AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST) AS w FROM s WHERE alike QUALIFY w <= 5),
n AS (SELECT p.a, p.anchor_id, p.id AS positive_id, p.score AS positive_score, n.id AS negative_id, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.a, p.w ORDER BY n.score DESC, n.id NULLS LAST) AS INTEGER) AS rank
  FROM p JOIN s n ON n.a = p.a AND NOT n.alike AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score QUALIFY rank <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorloom.llm.prefix_trie import rebuilt_trie

    return rebuilt_trie(spark, read_table(spark, sf_dir, "conversations"))


#: Its h is the CRC-32 of a decimal number, bit by bit.
OP13_SQL = """
WITH o AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS dec, max(pos) AS n FROM o GROUP BY conv_id),
i AS MATERIALIZED (SELECT conv_id, n, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(dec) + 1), lambda k: CAST(ascii(substr(dec, k, 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda a, k: xor(a >> 1, (a & 1) * 3988292384))), 4294967295) % 6 AS h FROM n),
j AS MATERIALIZED (SELECT i.conv_id, i.n, i.base, i.h, least(i.h, coalesce(b.n, 0)) AS taken FROM i LEFT JOIN i b ON b.conv_id = i.base),
s AS (SELECT o.conv_id, pos - h + taken AS depth, role, text FROM o JOIN j ON j.conv_id = o.conv_id WHERE pos > h
  UNION ALL SELECT j.conv_id, pos, role, text FROM j JOIN o ON o.conv_id = j.base WHERE pos <= taken),
p AS (SELECT conv_id, depth, length(text) AS cp, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM s),
q AS MATERIALIZED (SELECT conv_id, depth, k, cp FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM j),
t AS MATERIALIZED (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(cp) AS cp FROM q GROUP BY k, depth),
u AS MATERIALIZED (SELECT t.k AS low, t.depth AS low_depth, q.k AS top, q.depth FROM t JOIN q ON q.conv_id = t.conv_id AND q.depth <= t.depth),
c AS MATERIALIZED (SELECT top AS k, count(*) AS n_children FROM u WHERE depth = low_depth - 1 GROUP BY top),
a AS (SELECT u.top AS k, CAST(sum(CASE WHEN c.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((t.n_convs - 1) * t.cp) AS BIGINT) AS saved_tokens
  FROM u JOIN t ON t.k = u.low LEFT JOIN c ON c.k = u.low GROUP BY u.top),
l AS (SELECT conv_id, max(depth) AS depth FROM q GROUP BY conv_id),
e AS (SELECT q.k, string_agg(CAST(q.conv_id AS VARCHAR), ',' ORDER BY q.conv_id) AS ids FROM q JOIN l ON l.conv_id = q.conv_id AND l.depth = q.depth GROUP BY q.k)
SELECT t.conv_id, t.depth, w.conv_id AS parent_conv_id, t.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM t JOIN a ON a.k = t.k LEFT JOIN c ON c.k = t.k LEFT JOIN e ON e.k = t.k LEFT JOIN u ON u.low = t.k AND u.depth = t.depth - 1 LEFT JOIN t w ON w.k = u.top
"""


#: Source weights are document counts to this power.
MIX_ALPHA = 0.5


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorloom.llm.mixing import mix_sources

    return mix_sources(spark, read_table(spark, sf_dir, "documents"), alpha=MIX_ALPHA)


OP5_SQL = """
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(n) AS n, sum(pow(n, 5e-1)) AS w FROM s),
r AS (SELECT s.source AS src, pow(s.n, 5e-1) / t.w * t.n / s.n AS rate FROM s, t),
k AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND count(*) OVER (PARTITION BY doc_id) = 1 THEN CAST(doc_id AS VARCHAR)
    ELSE md5(concat_ws(chr(31), coalesce(CAST(doc_id AS VARCHAR), chr(0)), coalesce(text, chr(0)), coalesce(lang, chr(0)), coalesce(source, chr(0)), coalesce(CAST(n_chars AS VARCHAR), chr(0))))
      || '=' || row_number() OVER (PARTITION BY doc_id, text, lang, source, n_chars) END AS key FROM documents),
d AS (SELECT k.*, rate, CAST('0x' || substr(md5('17:' || key), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.src),
c AS (SELECT *, len(list_filter(range(0, 80), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(j * ln(rate) - rate - lgamma(j + 1)))) <= u)) AS times FROM d),
e AS (SELECT *, unnest(range(1, times + 1)) AS copy FROM c)
SELECT doc_id, text, lang, source, n_chars, copy,
  CAST('0x' || substr(md5('17s:' || key || ':' || copy), 1, 15) AS BIGINT) AS shuffle_key FROM e
"""


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorloom.llm.ngram_join import shingle_components

    return shingle_components(spark, read_table(spark, sf_dir, "documents"))


#: Words as the shingle operators take them, and the distinct shingles of a table's texts.
WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


def shingles_sql(table: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s FROM (SELECT {key}, {WORDS_SQL} AS w FROM {table})"""


OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT * FROM v WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 95e-2),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

OP6_SQL = f"""
WITH RECURSIVE s AS MATERIALIZED ({shingles_sql("documents", "doc_id")}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""

OP8_SQL = f"""
WITH d AS ({shingles_sql("documents", "doc_id")}), i AS ({shingles_sql("benchmark", "item_id")}), n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
SELECT doc_id, item_id, n AS item_shingles, count(*) AS shared, count(*) / n AS containment FROM d JOIN i USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n
"""


OP9_PARTS = r"""
WITH RECURSIVE m AS MATERIALIZED (SELECT row_number() OVER () AS mid, conv_id AS conv, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS t,
    regexp_matches(coalesce(text, ''), '(?m)^[ \t]*>') AS hq FROM conversations),
x AS (SELECT mid, string_split(regexp_replace(t, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM m WHERE hq),
l AS (SELECT mid, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM x),
y AS (SELECT mid, k, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS lv, regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '') AS c FROM l),
z AS (SELECT *, coalesce(last_value(CASE WHEN NOT (lv = 0 AND trim(c) = '') THEN lv END IGNORE NULLS) OVER (PARTITION BY mid ORDER BY k), 0) AS el FROM y),
w AS (SELECT *, lag(el) OVER (PARTITION BY mid ORDER BY k) AS pl FROM z),
v AS (SELECT *, sum(CASE WHEN el IS DISTINCT FROM pl THEN 1 ELSE 0 END) OVER (PARTITION BY mid ORDER BY k) AS run FROM w),
p AS MATERIALIZED (SELECT mid, run, min(el) AS lv, string_agg(c, chr(10) ORDER BY k) AS txt FROM v GROUP BY mid, run),
o AS (SELECT mid, trim(string_agg(regexp_replace(txt, '^\s+|\s+$', '', 'g'), chr(10) ORDER BY run)) AS own FROM p WHERE lv = 0 AND regexp_matches(txt, '\S') GROUP BY mid),
q AS (SELECT mid, max(lv) AS levels FROM p GROUP BY mid),
b AS MATERIALIZED (SELECT m.mid, conv, turn, role, CASE WHEN hq THEN coalesce(own, '') ELSE trim(t) END AS reply, CAST(coalesce(levels, 0) AS BIGINT) AS quote_levels
    FROM m LEFT JOIN o USING (mid) LEFT JOIN q USING (mid)),
src AS (SELECT mid, run, lv, txt FROM p WHERE lv > 0 UNION ALL SELECT mid, -1, 0, reply FROM b),
pa AS (SELECT mid, run, lv, unnest(regexp_split_to_array(txt, '\n[ \t>]*\n')) AS s, unnest(range(1, len(regexp_split_to_array(txt, '\n[ \t>]*\n')) + 1)) AS para FROM src),
li AS (SELECT mid, run, lv, para, unnest(string_split(s, chr(10))) AS s FROM pa),
cut AS (SELECT mid, run, lv, 0 AS para, false AS is_line, txt AS s, 1 AS least FROM src UNION ALL SELECT mid, run, lv, para, false, s, 4 FROM pa UNION ALL SELECT mid, run, lv, para, true, s, 4 FROM li),
pc AS (SELECT DISTINCT mid, run, lv, para, is_line, least, lower(trim(regexp_replace(s, '[\s>]+', ' ', 'g'))) AS piece FROM cut),
pt AS MATERIALIZED (SELECT pc.*, conv, turn FROM pc JOIN b USING (mid) WHERE length(piece) >= least AND turn IS NOT NULL),
hit AS (SELECT a.mid, a.conv, a.turn, a.run, a.lv, a.para, a.is_line, length(a.piece) AS size, max(z.turn) AS target FROM pt a JOIN pt z ON a.conv IS NOT DISTINCT FROM z.conv AND a.piece = z.piece AND z.turn < a.turn
    WHERE a.lv > 0 AND z.lv = 0 GROUP BY ALL),
flag AS (SELECT *, bool_or(para = 0) OVER (PARTITION BY mid, run) AS whole, bool_or(NOT is_line) OVER (PARTITION BY mid, run, para) AS paragraph FROM hit),
linked AS MATERIALIZED (SELECT * FROM flag WHERE para = 0 OR (NOT whole AND (NOT is_line OR NOT paragraph))),
ln AS (SELECT mid, count(*) AS links FROM (SELECT DISTINCT mid, lv, target FROM linked) GROUP BY mid),
best AS (SELECT conv, turn, target AS quote_turn FROM linked QUALIFY row_number() OVER (PARTITION BY conv, turn ORDER BY lv, size DESC, target DESC) = 1),
ts AS (SELECT DISTINCT conv, turn FROM b WHERE turn IS NOT NULL),
tr AS MATERIALIZED (SELECT ts.conv, ts.turn, quote_turn, lag(ts.turn) OVER (PARTITION BY ts.conv ORDER BY ts.turn) AS previous
    FROM ts LEFT JOIN best ON best.conv IS NOT DISTINCT FROM ts.conv AND best.turn = ts.turn),
r(conv, turn, thread, depth) AS (SELECT conv, turn, turn, CAST(0 AS BIGINT) FROM tr WHERE coalesce(quote_turn, previous) IS NULL
    UNION ALL SELECT tr.conv, tr.turn, r.thread, r.depth + 1 FROM r JOIN tr ON tr.conv IS NOT DISTINCT FROM r.conv AND coalesce(tr.quote_turn, tr.previous) = r.turn),
f AS (SELECT b.conv AS conv_id, b.turn, b.role, r.thread, coalesce(r.depth, 0) AS depth, coalesce(tr.quote_turn, tr.previous) AS parent_turn,
  CASE WHEN tr.quote_turn IS NOT NULL THEN 'quote' WHEN tr.previous IS NOT NULL THEN 'sequence' ELSE 'root' END AS link, quote_levels, reply, coalesce(ln.links, 0) AS links
FROM b LEFT JOIN tr ON tr.conv IS NOT DISTINCT FROM b.conv AND tr.turn = b.turn LEFT JOIN r ON r.conv IS NOT DISTINCT FROM b.conv AND r.turn = b.turn LEFT JOIN ln ON ln.mid = b.mid)
"""
OP9_MESSAGES_SQL = OP9_PARTS + "SELECT conv_id, turn, role, thread, depth, parent_turn, link, quote_levels, reply FROM f"
#: Segments of 256 turns; a message without a turn stands alone.
OP9_SQL = (
    OP9_PARTS
    + """, x9 AS (SELECT *, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || reply AS line,
  coalesce(CAST(turn AS VARCHAR), '-') || '<' || coalesce(CAST(parent_turn AS VARCHAR), '-') || ':' || link || ':' || depth || ':' || quote_levels || ':' || links AS item FROM f)
SELECT conv_id, thread, CAST(floor(turn / 256) AS BIGINT) AS segment, min(turn) AS first_turn, CAST(0 AS BIGINT) AS part, string_agg(line, chr(10) ORDER BY turn, line, item) AS chat,
  string_agg(item, ' ' ORDER BY turn, line, item) AS reply_tree, count(*) AS n_messages, CAST(sum(links) AS BIGINT) AS n_links FROM x9 WHERE turn IS NOT NULL GROUP BY 1, 2, 3
UNION ALL SELECT conv_id, NULL, NULL, NULL, 0, line, item, 1, links FROM x9 WHERE turn IS NULL"""
)


def queries() -> dict:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_embedding_near_dedup": op2_embedding_near_dedup,
        "op3_html_extraction": op3_html_extraction,
        "op4_language_id": op4_language_id,
        "op5_source_mixing": op5_source_mixing,
        "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
        "op7_url_filter": op7_url_filter,
        "op8_benchmark_decontamination": op8_benchmark_decontamination,
        "op9_chat_quotation_linking": op9_chat_quotation_linking,
        "op9_chat_messages": op9_chat_messages,
        "op9_chat_conversations": op9_chat_quotation_linking,  # its name of the first round
        "op10_token_output": op10_token_output,
        "op11_sentencepiece": op11_sentencepiece,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_near_dedup": OP2_SQL,
        "op5_source_mixing": OP5_SQL,
        "op6_ngram_jaccard_join": OP6_SQL,
        "op7_url_filter": OP7_SQL,
        "op8_benchmark_decontamination": OP8_SQL,
        "op9_chat_quotation_linking": OP9_SQL,
        "op9_chat_messages": OP9_MESSAGES_SQL,
        "op9_chat_conversations": OP9_SQL,
        "op12_hard_negatives": OP12_SQL,
        "op13_prefix_trie": OP13_SQL,
    }
