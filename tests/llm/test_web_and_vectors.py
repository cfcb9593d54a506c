"""Pages, urls, embeddings, chat and the pipeline: brute force and edge cases."""

import collections
import html
import math
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import near_embeddings as ne
from factorloom.llm.chat import format_threads, link_conversations
from factorloom.llm.common import Scratch
from factorloom.llm import html_text as ht
from factorloom.llm.html_text import extract, page_texts, site_style_tree
from factorloom.llm.near_embeddings import near_embeddings, nearest_e8
from factorloom.llm.queries import URL_RULES, oracle_sql, queries
from factorloom.llm.url_filter import BloomCascade, url_verdicts

DATA = "/root/testdata/sf0.001"

# pages

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header class="site-header"><a href=/>Logo</a></header>
<nav><ul><li><a href="/a">a</a></li></ul></nav><div id="cookie-notice">We use cookies</div><main><article><header><h1>Ti &amp; tle</h1></header>
<p>One   two<br>three <b>four</b></p><aside>rel</aside><p>Five &lt;x&gt;&nbsp;six<p>unclosed<ul><li>l1<li>l2</ul><div class="share-buttons">share</div>
<section id="comments"><article class="comment"><p>nice!</p></article></section><form><input>go</form><script>var t="</p>";</script><!-- <p>c</p> --></article></main>
<div class="sidebar">side</div><div class="adBanner">buy</div><footer>&copy; f</footer></body></html>"""


def test_extract_keeps_the_article_only():
    assert extract(ARTICLE) == "Ti & tle\nOne two three four\nFive <x> six\nunclosed\nl1\nl2"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain text <b>only", "plain text only"),
        ("<p>cut <a href='x", "cut"),
        ("<div><a href=1>L1</a> <a href=2>L2</a></div><div><p>Para one.</p></div>", "Para one."),
        ("<article></article><p>outside</p>", "outside"),
        ("<script>only script", ""),
        ("<p title='a > b'>x</p></div></p><p>y", "x\ny"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p><p>yes</p>", "yes"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_extract_is_forgiving(page, want):
    assert extract(page) == want


def test_pages_of_the_data(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: r for r in page_texts(spark, pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?p>|</?h1>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_site_template_is_removed_by_entropy(spark):
    def page(k, extra):
        return f"<body><div><p>{extra}</p><div>Words of the shop in every page</div></div><article><h1>Title {k}</h1>" + f"<p>Body {k} {'x' * k}</p>" * 2 + "<div><p>Get our app today</p></div></article></body>"

    rows = [(k, "http://shop.example.org/p", page(k, "Hello"), "host", "low") for k in range(12)]
    rows += [(100, "http://lone.example.org/", page(1, "Hello"), "h", "l"), (101, None, None, "h", "l"), (102, "x", "", "h", "l")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, low string")
    got = {r["page_id"]: r["text"] for r in page_texts(spark, pages).collect()}
    assert all("Get our app" not in got[k] and got[k].startswith(f"Title {k}\nBody {k}") for k in range(12))
    assert "Get our app" in got[100]  # one page says nothing about a template
    assert got[101] == "" and got[102] == ""
    mirrored = spark.createDataFrame([(k, "http://m.example.org/", "<article><p>same</p></article>") for k in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in page_texts(spark, mirrored).collect()} == {"same"}
    assert page_texts(spark, pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "block",
    ["<article>{}</article>", "<main>{}</main>", "<div class=entry-content>{}</div>"],
)
def test_short_blocks_of_an_article_stay(block):
    parts = ["A lead.", "The long body of the text. " * 20, "The end."]
    page = "<div>outside</div>" + "<hr>".join(block.format(f"<p>{p}</p>") for p in parts)
    assert extract(page) == "\n".join(p.strip() for p in parts)
    beside = "<article class=related-post><p>Read this too</p></article><article class=comment><p>nice</p></article>"
    assert extract(page + beside) == extract(page)


def test_near_copies_of_an_article_are_no_template(spark):
    def page(paragraphs, title="One title"):
        return f"<body><div class=wrap><article><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article></div></body>"

    shared = [f"Paragraph {k} of the copied article " + "abcdefgh"[k] * (20 + 9 * k) for k in range(4)]
    rows, want = [], {}

    def add(host, paragraphs, title="One title"):
        rows.append((len(rows), f"http://{host}/{len(rows)}", page(paragraphs, title)))
        want[len(rows) - 1] = "\n".join([title, *paragraphs])

    for k in range(6):  # six near copies, each time another last paragraph; on other hosts a long one, or another place
        add("a.example.org", [*shared, f"Changed {k}"])
        add("b.example.org", [*shared, f"Changed {k}" + " long words" * 30])
        add("c.example.org", [f"Changed {k}" if j == k % 4 else p for j, p in enumerate(shared)])
    for k in range(95):  # a hot article says nothing about other pages of the host
        add("hot.example.org", [*shared, f"Changed {k}"])
    for k in range(5):
        add("hot.example.org", [f"Quite another text {k} at {j}" for j in range(5)], f"Title {k}")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in page_texts(spark, pages).collect()} == want


def shop_pages(hosts=1):
    """Pages without class names and ``article``: menu, adverts in turn or none, unlike texts, a footer."""
    rows, want = [], {}
    adverts = ["Buy the very best of all shoes today", "Fly to the islands for less than ever", "Your loan is only one call away from here", ""]
    for h in range(hosts):
        for k in range(40):
            body = [f"Title of page {k} of {h}", f"First text {k * 7919 % 1009} about matter {k}", f"Second text {k * 104729 % 2003} with more of {k}"]
            advert = adverts[(k * 5 + h) % 4]
            page = "<body><div><p>All our goods at one place</p><p>Ask us at any time</p></div>" + (f"<div><div>{advert}</div></div>" if advert else "")
            page += "<div>" + f"<h1>{body[0]}</h1>" + "".join(f"<p>{p}</p>" for p in body[1:]) + "</div><div><p>All rights are with the shop</p></div></body>"
            rows.append((len(rows), f"http://shop{h}.example.org/{k}", page))
            want[len(rows) - 1] = "\n".join(body)
    return rows, want


def test_the_tree_decides_where_nothing_is_named(spark):
    rows, want = shop_pages()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in page_texts(spark, pages).collect()} == want
    assert all(extract(html) != want[k] and "goods" in extract(html) for k, _, html in rows)  # not without the tree


def test_marks_by_join_equal_marks_by_broadcast(spark):
    rows, _ = shop_pages(3)
    rows += [(900, None, None), (901, "", ""), (902, None, rows[0][2]), *rows[:2]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = lambda df: sorted(map(tuple, df.collect()))
    assert texts(page_texts(spark, pages, max_marks=0)) == texts(page_texts(spark, pages))


def test_tree_of_the_data_has_low_nodes(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(F.xxhash64(F.split("url", "/")[2]).alias("host"), "html")
    _, nodes = site_style_tree(pages, Scratch(spark, "test-tree"))
    got = nodes.agg(F.min("importance"), F.max("importance"), F.sum((F.col("importance") < ht.LEAST_IMPORTANCE).cast("int"))).first()
    assert got[0] < 0.2 and got[1] == 1 and got[2] > 10


def test_names_are_taken_whole():
    page = (
        '<article><p>A</p><div class="text-body search-results">B</div><p class="social-history">C</p><h2 id="related-work">D</h2><section id="comment-on-method">E</section>'
        '<p class="skip">F</p><div class="ad-slot ad-300">no</div><ol class="commentList"><li>no</ol><div id="share_buttons">no</div><p class="cookie-notice">no</p></article>'
    )
    assert extract(page) == "A\nB\nC\nD\nE\nF"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>Before</p><select><option>a<p>After <b>it</b></p>", "Before\nAfter it"),
        ("<p>x <math><mrow><mi>a</mi><mo>+</mo><mi>b</mi></mrow></math> y <canvas>c</canvas></p>", "x a+b y c"),
        ("<p>one <video src=v>two<p>three", "one two\nthree"),
        ("<p>one<noscript>two<p>three", "one\ntwo\nthree"),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "a\nb\nc\nd"),
    ],
)
def test_open_elements_swallow_nothing(page, want):
    assert extract(page) == want


def test_deep_and_long_pages_take_linear_time():
    import time

    start = time.perf_counter()
    deep = "".join(f"<div>text {k}" for k in range(4000))
    assert len(extract(deep).split("\n")) == 4000
    assert len(ht.page_features(1, deep)) == 8000 + 1
    assert extract("<div>" * 4000 + "<li>x" * 4000 + "</span>" * 4000).count("x") == 4000
    assert len(extract("<article>" + "<p>some words of it</p>" * 50_000 + "</article>").split("\n")) == 50_000
    assert time.perf_counter() - start < 8


# urls


def judged(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c in string.ascii_uppercase else c for c in host)
    fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_url_verdicts_equal_brute_force(spark):
    draw = random.Random(1)
    urls = [None, "", "no scheme", "http://", "http://ORG/", "http://org", "https://Example.org/es/x?y#z", "x://a.example.org/en/12#t", "http://com/fr/", "http://notexample.org/es/", "http://é.com/de/", "a://b://c.org/"]
    urls += [f"http://{draw.choice(['', 'www.', 'A.b.'])}{draw.choice(['example.org', 'x.com', 'org', 'example.net'])}{draw.choice(['/', '/es/', '/en/1', '/fr/q', '/de/', '', '?/es/'])}" for _ in range(200)]
    pages = spark.createDataFrame([(k, u, "h", "p", "r") for k, u in enumerate([*urls, urls[6]])], "page_id long, url string, host string, path string, rule string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_verdicts(spark, pages, URL_RULES).collect()}
    assert got == {k: judged(u, URL_RULES) for k, u in enumerate([*urls, urls[6]])}
    assert url_verdicts(spark, pages.limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in url_verdicts(spark, pages, []).collect()} == {"allow"}
    many = [("block" if k % 3 else "allow", f"h{k}.example.com", "/" + "x" * (k % 4)) for k in range(60)]
    wide = spark.createDataFrame([(k, f"http://w.h{k % 80}.example.com/{'x' * (k % 6)}") for k in range(400)], "page_id long, url string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_verdicts(spark, wide, many).collect()}
    assert got == {r["page_id"]: judged(r["url"], many) for r in wide.collect()}
    got = {r["page_id"]: tuple(r)[1:] for r in url_verdicts(spark, wide, many, max_bits=128).collect()}  # several shards
    assert got == {r["page_id"]: judged(r["url"], many) for r in wide.collect()}


def test_bloom_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("crc32(key) % 37 = 0")
    cascade = BloomCascade(listed, universe, Scratch(spark, "test-cascade"))
    assert len(cascade.levels) > 1
    wrong = universe.where(f"({cascade.contains_sql('key')}) <> (crc32(key) % 37 = 0)")
    assert wrong.count() == 0
    plan = universe.where(cascade.contains_sql("key"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan


def test_native_operators_run_no_python(spark):
    for name in ("op7_url_filter", "op9_chat_quotation_linking"):
        plan = queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# embeddings


def test_nearest_e8_point():
    draw = np.random.default_rng(0)
    steps = ne.minimal_vectors()
    assert steps.shape == (240, 8) and np.allclose((steps**2).sum(axis=1), 2)
    x = draw.normal(size=(500, 8)) * 3
    near = nearest_e8(x)
    doubled = np.rint(2 * near)
    assert np.allclose(doubled, 2 * near) and (doubled.sum(axis=1) % 4 == 0).all() and ((doubled % 2 == 0).all(axis=1) | (doubled % 2 != 0).all(axis=1)).all()
    own = ((x - near) ** 2).sum(axis=1)
    assert (own <= 1 + 1e-9).all()  # the covering radius
    for s in steps:
        assert (own <= ((x - near - s) ** 2).sum(axis=1) + 1e-9).all()


def cosine_links(vectors, threshold=0.95):
    n = len(vectors)
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    links = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                links[i, j] = links[j, i] = a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold
    return links


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_embeddings_equal_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(ne, "CHUNK_ROWS", 8)  # large cells are split into chunks
    draw = np.random.default_rng(5)
    base = draw.normal(size=(12, 24))
    rows = [list(map(float, np.float32(v))) for v in base]
    for k in range(12):
        for _ in range(k):
            rows.append(list(map(float, np.float32(base[k] + draw.normal(size=24) * draw.uniform(0, 0.2)))))
    rows += [rows[0]] * 15 + [[0.0] * 24, None, [], [1.0, None], [float("nan")] * 24, [float("inf")] * 24, [1.0, 2.0], [2.0, 4.0]]
    ids = list(range(50, 50 + len(rows)))
    df = spark.createDataFrame(list(zip(ids, rows, ["n"] * len(rows), ["c"] * len(rows), strict=True)), f"vec_id long, embedding array<{kind}>, node string, cell string")
    got = {r["vec_id"]: r for r in near_embeddings(spark, df, tables=10, probes=4, scale=0.3).collect()}
    links = cosine_links(rows)
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *[label[j] for j in np.flatnonzero(links[i])]]) for i in range(len(rows))]
    assert {k: r["n_links"] for k, r in got.items()} == dict(zip(ids, links.sum(axis=1).tolist(), strict=True))
    assert {k: r["component_id"] for k, r in got.items()} == {i: ids[m] for i, m in zip(ids, label, strict=True)}
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert near_embeddings(spark, df.limit(0)).count() == 0


def test_recall_of_the_query_parameters(spark):
    draw = np.random.default_rng(6)
    a = draw.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = draw.normal(size=(400, 64))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    pairs = np.concatenate([a, 0.951 * a + math.sqrt(1 - 0.951**2) * b])  # barely above the threshold
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(pairs)], "vec_id long, embedding array<double>")
    found = near_embeddings(spark, df).where("n_links > 0").count()
    assert found / 800 >= 0.97


# chat

TALK = [
    (1, 0, "user", "Hello there, how are you?\n\nI need help with Spark."),
    (1, 1, "assistant", "> I need help with Spark.\n\nSure, what exactly?"),
    (1, 2, "user", "> > I need help with Spark.\n> Sure, what exactly?\nJoins.\n> nothing known\nThanks"),
    (1, 3, "user", ">Hello  there,   how are YOU?\nFine."),
    (1, 4, "user", None), (1, 4, "user", "dup"), (1, None, "user", "x"), (None, 0, "a", "q"), (None, 1, "a", "> nomatch\nz"),
]


def test_quotes_link_replies(spark):
    df = spark.createDataFrame([(*r, "u", "t") for r in TALK], "conv_id long, turn long, role string, text string, up string, thread string")
    got = {(r["conv_id"], r["turn"], r["reply"]): (r["thread"], r["depth"], r["parent_turn"], r["link"], r["quote_levels"]) for r in link_conversations(spark, df).collect()}
    assert got == {
        (1, 0, "Hello there, how are you?\n\nI need help with Spark."): (0, 0, None, "root", 0),
        (1, 1, "Sure, what exactly?"): (0, 1, 0, "quote", 1),
        (1, 2, "Joins.\nThanks"): (0, 2, 1, "quote", 2),
        (1, 3, "Fine."): (0, 1, 0, "quote", 1),
        (1, 4, ""): (0, 2, 3, "sequence", 0),
        (1, 4, "dup"): (0, 2, 3, "sequence", 0),
        (1, None, "x"): (None, 0, None, "root", 0),
        (None, 0, "q"): (0, 0, None, "root", 0),
        (None, 1, "z"): (0, 1, 0, "sequence", 1),
    }
    chats = {(r["conv_id"], r["thread"]): r["chat"] for r in format_threads(link_conversations(spark, df)).collect()}
    assert chats[None, 0] == "<|a|>\nq\n<|a|>\nz" and ">" not in chats[1, 0].replace("|>", "")
    assert link_conversations(spark, df.limit(0)).count() == 0


def test_quotes_equal_their_sql(spark):
    import duckdb
    import pandas as pd

    draw, rows = random.Random(5), list(TALK)
    for c in range(20, 40):
        said = []
        for t in range(draw.randint(2, 9)):
            text = "\n".join(draw.choice(["", "", "\n"]) + f"line {draw.randrange(6)} of text" for _ in range(draw.randint(0, 4)))
            if said and draw.random() < 0.7:
                mark = draw.choice(["> ", ">", " > ", "> > "])
                text = "\n".join(mark + x for x in draw.choice(said).split("\n")) + draw.choice(["\n", "\n\n", "\r\n"]) + text
            said.append(text)
            rows.append((c, t, draw.choice("ab"), text))
    linked = link_conversations(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    for name, got in (("op9_chat_messages", linked.drop("links")), ("op9_chat_quotation_linking", format_threads(linked))):
        columns = sorted(got.columns)
        want = con.sql(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall()
        mine = [tuple(r[c] for c in columns) for r in got.collect()]
        assert sorted(mine, key=repr) == sorted(want, key=repr)
    quoted = linked.where("link = 'quote'").count()
    assert quoted > 20 and linked.where("size(links) > 1").count() > 3


def test_long_messages_parse_in_linear_time(spark):
    import time

    from factorloom.llm.chat import parse_quotes

    long = "\n".join(("> " if k % 2 else "") + f"line {k}" for k in range(16_000))
    df = spark.createDataFrame([(long,), ("\n\n> a\n\n>> b\n> c\nd\n\n",)], "text string")
    parse_quotes(df.limit(1)).count()
    start = time.perf_counter()
    rows = {len(r["passages"]): r for r in parse_quotes(df).collect()}
    assert time.perf_counter() - start < 6
    assert len(rows[16_000]["reply"].split("\n")) == 8000
    assert [tuple(p) for p in rows[5]["passages"]] == [(0, "\n"), (1, "a\n"), (2, "b"), (1, "c"), (0, "d\n\n")] and rows[5]["reply"] == "d"


def test_quotes_of_every_level_and_length_link(spark):
    rows = [
        (1, 0, "a", "The first of all messages"), (1, 1, "b", "Yes"), (1, 2, "a", "好的"), (1, 3, "b", "Something else\nno"),
        (1, 4, "a", ">> The first of all messages\nback to it"),
        (1, 5, "b", "> Yes\nshort"), (1, 6, "a", "> 好的\n\nshort too"), (1, 7, "a", "> no\nonly a line there"),
        (1, 8, "b", "> Yes\nand\n> Something else\n> > The first of all messages\ntwo"),
        (1, 8, "b", "> 好的\na copy of the turn"),
        (1, 9, "a", "> back to it\n> and more\nparts"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = link_conversations(spark, df).collect()
    got = {(r["turn"], r["reply"]): (r["parent_turn"], r["link"], [tuple(x) for x in r["links"]]) for r in out}
    assert len(out) == len(rows)
    assert got[4, "back to it"] == (0, "quote", [(2, 0, 25)])
    assert got[5, "short"] == (1, "quote", [(1, 1, 3)])
    assert got[6, "short too"] == (2, "quote", [(1, 2, 2)])
    assert got[7, "only a line there"] == (6, "sequence", [])
    assert got[8, "and\ntwo"] == (3, "quote", [(1, 3, 14), (1, 1, 3), (2, 0, 25)])
    assert got[8, "a copy of the turn"] == (3, "quote", [(1, 2, 2)])
    assert got[9, "parts"] == (4, "quote", [(1, 4, 10)])
    assert link_conversations(spark, df.limit(0)).count() == 0


def test_conversations_hold_every_message_once(spark):
    rows = [(1, t, "u", f"said {t}") for t in range(40)] + [(1, 5, "u", f"copy {k}") for k in range(200)] + [(k % 2, None, "u", f"lost {k}") for k in range(60)]
    linked = link_conversations(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = sorted(format_threads(linked, segment=8).collect(), key=lambda r: (r["segment"] is None, r["segment"] or 0, r["first_turn"] or 0, r["part"]))
    assert collections.Counter(x for r in out for x in r["chat"].split("\n") if x != "<|u|>") == collections.Counter(r[3] for r in rows)
    assert sum(r["n_messages"] for r in out) == len(rows) and max(r["n_messages"] for r in out) < 40  # one hot turn, no turn
    said = [x for r in out for x in r["chat"].split("\n") if x.startswith("said")]
    assert said == [f"said {t}" for t in range(40)]
    whole = queries()["op9_chat_quotation_linking"](spark, DATA)
    assert whole.agg(F.sum("n_messages")).first()[0] == spark.read.parquet(f"{DATA}/conversations.parquet").count()
    assert not re.search("Python|Pandas|Arrow", whole._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(want, key=repr)


def test_long_conversation_across_turn_blocks(spark):
    draw, rows, texts = random.Random(3), [], []
    for t in range(1500):
        quote = draw.randrange(t) if t and t % 3 == 0 else None
        texts.append(f"message number {t} of {draw.random()}")
        rows.append((9, t, "user", texts[t] if quote is None else f"> {texts[quote]}\n{texts[t]}"))
    got = {r["turn"]: r for r in link_conversations(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    depth = {}
    for _, t, _, text in rows:
        parent = None if t == 0 else (texts.index(text.split("\n")[0][2:]) if text.startswith("> ") else t - 1)
        depth[t] = 0 if parent is None else depth[parent] + 1
        assert (got[t]["parent_turn"], got[t]["depth"], got[t]["thread"], got[t]["reply"]) == (parent, depth[t], 0, texts[t])


# pipeline


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as cp
    from factorloom.llm.mixing import mix_sources
    from tests.llm.test_text_operators import brute_components, shingles

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (90_001, "123 456", "en", "s", 7), (90_002, "", None, "s", 0)], docs.schema)
    docs = docs.unionByName(extra)
    names = [n for n, _ in cp.STAGES]
    assert names == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_output"]
    kept = {}
    current = docs
    scratch = Scratch(spark, "test-pipeline")
    for name, stage in cp.STAGES:
        current = scratch.keep(stage(spark, current, DATA), name)
        kept[name] = current
        if name != "token_output":
            assert current.columns == docs.columns
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(kept["language_id"]) == sorted(r["doc_id"] for r in docs.collect() if r["text"] and re.search(r"[^\W\d_]", r["text"]))
    rows = sorted((r["doc_id"], r["text"]) for r in kept["language_id"].collect())
    component, _ = brute_components([r[0] for r in rows], [r[1] for r in rows])
    assert ids(kept["ngram_jaccard_join"]) == sorted(set(component))
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = [r["doc_id"] for r in kept["ngram_jaccard_join"].collect() if not any(100 * len(i & shingles(r["text"])) >= 80 * len(i) for i in items if i)]
    assert ids(kept["benchmark_decontamination"]) == sorted(clean)
    assert ids(kept["source_mixing"]) == ids(mix_sources(spark, kept["benchmark_decontamination"], alpha=cp.MIX_ALPHA))
    assert collections.Counter(ids(kept["token_output"])) == collections.Counter(ids(kept["source_mixing"]))
    assert cp.run(spark, DATA).count() > 0


def test_near_duplicate_stage_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline as cp

    rows = [(1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (2, "a b c d e f g", "en", "s", 1), (3, None, "en", "s", 1), (4, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in cp.near_duplicate_stage(spark, docs, DATA).collect()) == [1, 3, 4]


def test_near_duplicate_stage_keeps_one_row_of_a_group(spark):
    import corpus_pipeline as cp

    words = [f"w{i}" for i in range(60)]
    base, near = " ".join(words), " ".join([*words[:-1], "other"])
    alone = [" ".join(f"{a}{i}" for i in range(30)) for a in "xyz"]
    rows = [
        (7, base, "en", "s", 1), (7, near, "en", "s", 1),  # near copies that share an id
        (None, alone[0], "en", "s", 1), (None, alone[0] + " ", "en", "s", 2), (None, alone[0], "en", "s", 1),  # copies without an id
        (None, base, "en", "s", 1), (3, alone[1], "en", "s", 1), (3, near + " more", "en", "s", 1),  # an id of two groups
        (9, alone[2], None, None, None), (9, alone[2], "de", None, None), (None, None, None, None, None), (5, "", None, "s", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.near_duplicate_stage(spark, docs, DATA)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"] or 0, (r["text"] or "").strip()) for r in out.collect()))
    assert got == sorted([(3, near + " more"), (3, alone[1]), (9, alone[2]), (0, alone[0]), (0, ""), (5, "")])
    assert cp.near_duplicate_stage(spark, docs.limit(0), DATA).count() == 0


def test_a_level_of_a_million_keys_is_planned_quickly(spark):
    import time

    from factorloom.llm.url_filter import _level

    keys = spark.range(1_000_000).select(F.concat(F.lit("key"), F.col("id").cast("string")).alias("key"))
    level = _level(keys, 1_000_000, 0.01, 0)
    assert len(level.contains_sql("key")) < 22 * len(level.words) + 5000  # the bits stand in it once
    asked = spark.range(0, 2_000_000, 1000).select(F.concat(F.lit("key"), F.col("id").cast("string")).alias("key"), (F.col("id") < 1_000_000).alias("listed"))
    began = time.time()
    planned = asked.select("listed", F.expr(level.contains_sql("key")).alias("hit"))
    planned._jdf.queryExecution().executedPlan()
    assert time.time() - began < 10
    rows = planned.collect()
    assert all(r["hit"] for r in rows if r["listed"]) and sum(r["hit"] for r in rows if not r["listed"]) < 40


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><p>Intro</p><div class="widget-content"><p>Body para</p></div><div class="social"><p>On social life.</p></div><p class="search">How to search</p><section class="sharing"><p>Sharing is good.</p></section></article>',
         "Intro\nBody para\nOn social life.\nHow to search\nSharing is good."),
        ('<article><p>Text</p><div class="share"><a href="/a">Post it</a> <button>Like</button></div><div class="ad"><p>Buy</p></div><div class="comment-list"><p>First!</p></div></article>', "Text"),
        ('<form id="aspnetForm"><nav><a href="/">Home</a></nav><article><h1>Head</h1><p>Body</p><input value="x"></article><footer>f</footer></form>', "Head\nBody"),
        ('<form id="aspnetForm"><div><h1>Head</h1><p>Body text here</p><select><option>one</option></select></div></form>', "Head\nBody text here"),
        ("<main><p>Intro</p></main><article>Short</article>", "Intro\nShort"),
        ('<div role="main"><p>A</p><article><p>B</p></article></div>', "B"),
        ('<article><p>Body</p></article><aside><article class="teaser"><p>Other</p></article></aside><form><p>Sign up</p></form>', "Body"),
        ('<p>Plain page</p><form><p>Send us a letter</p></form>', "Plain page"),
    ],
)
def test_names_and_wrappers_around_an_article(page, want):
    assert extract(page) == want


def test_a_name_inside_an_article_goes_where_the_tree_agrees(spark):
    draw = random.Random(6)
    words = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    pages, want = [], {}
    for k in range(30):
        own = [words(12) for _ in range(5)]
        box = "Follow us on all channels and tell your friends" if k % 30 else words(9)
        pages.append((k, f"http://h.example/{k}", "<article>" + "".join(f"<p>{t}</p>" for t in own) + f'<div class="social"><p>{box}</p></div></article>'))
        want[k] = "\n".join(own if k else [*own, box])
    got = {r["page_id"]: r["text"] for r in page_texts(spark, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want
