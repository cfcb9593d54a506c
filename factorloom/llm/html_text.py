"""Main text of web pages with a site style tree.

Pages of one host are merged into one tree: a node is known by its path of tags
and its position among siblings of its tag.  Of each node the tree counts its
styles (the sequences of its child blocks; presentation) and its features (text
lines, link targets, image sources; content) by the pages that show them.  The
entropy of a feature over the host's pages that have the node, to the base of
their number, is log(its pages) / log(the node's pages): 1 for what every page
repeats, 0 for what one page has.  A branch of a page is as important as its
features are rare, mixed with the rarity of its style; it goes if it and all
branches below it are unimportant.

Copies of one article repeat as a template does.  So a feature counts as
repeated only if the texts around it differ, and inside an article (``article``,
``main`` or a block with such a name) only whole sections go, at one place on
nine of ten pages.  Before that elements go that are navigation, forms, adverts,
notices or reader comments by their tag or role, or because their whole name
says so: all words of a class or id are such words or layout words, as in
``ad-slot`` or ``comment-list``, not in ``search-results`` or ``related-work``.
Inside an article a name alone removes adverts, reader comments and notices;
others (``share``, ``widget``) need the tree to find the branch unimportant, or a block
without prose.  A form or another wrapper around the article stays.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import Scratch, bound_batches, releasing
from factorloom.llm.url_filter import url_host_path

# Element names of HTML by their role (all others are inline, as in browsers), and words of class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body address article aside blockquote caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head"
    " header hgroup hr legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd figure figcaption table caption thead tbody tfoot tr td th summary".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote table".split())
RAW_TO_END = "script|style"
RAW_IF_CLOSED = "noscript|template|iframe|textarea|title"
NEVER = frozenset("nav footer aside form button input select datalist dialog menu fieldset head search".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section table ul".split())
SELF_CLOSING = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "optgroup": ("option optgroup", "select")}
SELF_CLOSING = {tag: (frozenset(close.split()), frozenset(scope.split())) for tag, (close, scope) in SELF_CLOSING.items()}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
TEASERS = frozenset("teaser teasers related recommended recommendations promo promos promotion sponsored".split())
BOILERPLATE = TEASERS | frozenset(
    "ad ads advert adverts advertisement advertisements adsense adslot banner banners sponsor nav navbar navigation navmenu menu menus topbar footer sidebar sidebars widget widgets"
    " cookie cookies consent gdpr notice notices popup popups modal overlay newsletter subscribe subscription signup share sharing social"
    " comment comments commentlist disqus respond replies breadcrumb breadcrumbs pagination pager login search masthead".split()
)
#: Names that say inside an article, too, that a block is none of it.
FOREIGN = frozenset(
    "ad ads advert adverts advertisement advertisements adsense adslot sponsor comment comments commentlist disqus respond replies"
    " cookie cookies consent gdpr popup popups modal overlay newsletter subscribe subscription signup".split()
)
WRAPPERS = frozenset("form fieldset aside dialog search".split())
HEADERS = frozenset("header headers".split())
LAYOUT = frozenset(
    "area bar block body bottom box button buttons card cards container content form global group holder icons inner item items left link links list main media off outer page panel"
    " post posts article articles stories primary region right row secondary section site slot slots small thread top unit user reader wrap wrapper".split()
)
CONTENT = frozenset("article articlebody content post entry story main maincontent body text".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({RAW_TO_END})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    rf"|<({RAW_IF_CLOSED})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?</\2\s*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style|href|src)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?![\w-])", re.I)
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: A branch less important than this is unimportant; weight of content against presentation by child block; pages that make a repetition.
LEAST_IMPORTANCE, GAMMA, LEAST_PAGES = 0.5, 0.9, 3
#: Share of a place's pages that must show what goes inside an article.
ARTICLE_SHARE = 0.9
#: Marks of repeated features that are broadcast at most (12 bytes each); with more, each page is joined to its own.
MAX_MARKS = 1_000_000
MASK = (1 << 64) - 1


@functools.lru_cache(maxsize=50_000)
def name_kinds(names: str) -> tuple[bool, ...]:
    """Do a class or id value's names say boilerplate, teaser, header, article content, boilerplate even inside an article?"""
    out = [False] * 5
    for token in names.split():
        words = frozenset(w.lower() for w in NAME_WORDS.findall(token))
        for k, (kind, beside) in enumerate(((BOILERPLATE, LAYOUT), (TEASERS, LAYOUT), (HEADERS, LAYOUT), (CONTENT, LAYOUT), (FOREIGN, LAYOUT | BOILERPLATE))):
            out[k] = out[k] or bool(words & kind) and words <= kind | beside
    return tuple(out)


class Node:
    __slots__ = ("attrs", "children", "kinds", "parent", "tag")

    def __init__(self, tag: str, raw: str, parent: Node | None):
        self.tag, self.parent, self.children, self.attrs, self.kinds = tag, parent, [], {}, (False,) * 5
        if raw and ("=" in raw or "hidden" in raw):
            self.attrs = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(raw)}
            names = " ".join([self.attrs.get(k, "") for k in ("class", "id", "itemprop")])
            if not names.isspace():
                self.kinds = name_kinds(names)

    @property
    def inline(self) -> bool:
        return self.tag not in BLOCK


def parse(page: str) -> Node:
    """A forgiving tree of a page: unclosed and stray tags never fail."""
    root = at = Node("html", "", None)
    last = 0
    opened: Counter[str] = Counter()  # of the branch that ends at ``at``: no search upwards is in vain

    def leave(node: Node) -> Node:
        """Close all up to and with ``node``."""
        nonlocal at
        while at is not node.parent:
            opened[at.tag] -= 1
            at = at.parent
        return at

    for m in TOKEN.finditer(page):
        if m.start() > last:
            at.children.append(page[last : m.start()])
        last = m.end()
        end, tag, raw = (m[3], m[4], m[5]) if m[4] else (m[6], m[7], m[8])
        if not tag:
            continue
        tag = tag.lower()
        if tag in ("html", "body", "head"):
            # attributes of these never remove a page; an end tag closes nothing before the end
            if not end and tag == "body":
                at = root
                opened.clear()
            continue
        if end:
            if not opened[tag]:
                continue
            up = at
            while up.tag != tag:
                # an inline end tag does not reach out of its block
                if tag not in BLOCK and up.tag in BLOCK:
                    up = None
                    break
                up = up.parent
            if up is not None:
                leave(up)
            continue
        if tag in ENDS_P:
            if opened["select"]:  # blocks do not stand in a list of options: it was not closed
                up = at
                while up.tag != "select":
                    up = up.parent
                leave(up)
            if opened["p"]:
                up = at
                while up.inline:
                    up = up.parent
                if up.tag == "p":
                    leave(up)
        elif tag in SELF_CLOSING:
            close, scope = SELF_CLOSING[tag]
            if any(opened[c] for c in close):
                up, hit = at, None
                while up is not root and up.tag not in scope:
                    if up.tag in close:
                        hit = up
                        if tag != "tr" or up.tag == "tr":
                            break
                    up = up.parent
                if hit is not None:
                    leave(hit)
        node = Node(tag, raw, at)
        at.children.append(node)
        if tag not in VOID and not raw.rstrip().endswith("/"):
            at = node
            opened[tag] += 1
    if last < len(page):
        rest = page[last:]
        cut = re.search(r"<[a-zA-Z/!][^>]*\Z", rest)  # a tag that the page's end cut off
        at.children.append(rest[: cut.start()] if cut else rest)
    return root


def is_boilerplate(node: Node, in_article: bool, agreed: frozenset[int] | set[int] = frozenset()) -> bool:
    """``agreed`` are blocks (by ``id``) that the style tree finds unimportant."""
    if node.tag in NEVER:
        return True
    if node.attrs:
        if "hidden" in node.attrs or node.attrs.get("aria-hidden", "").lower() == "true" or "display:none" in node.attrs.get("style", "").replace(" ", "").lower():
            return True
        if node.attrs.get("role", "").lower() in ROLES:
            return True
    named, teaser, header, content, foreign = node.kinds
    if in_article:
        if foreign:
            return node.tag not in ("main", "h1")
        return named and node.tag not in TEXT_BLOCKS and node.tag not in ("article", "main") and (id(node) in agreed or not holds_prose(node))
    if named and node.tag not in ("main", "h1") and not (node.tag == "article" and teaser):
        return True
    return node.tag == "header" or header and not content


def holds_prose(node: Node) -> bool:
    """Does a block hold a paragraph, heading, quotation or table with text outside of links and buttons?"""
    stack = [(node, False)]
    while stack:
        at, prose = stack.pop()
        prose = prose or at.tag in PROSE
        for c in at.children:
            if isinstance(c, str):
                if prose and c.strip():
                    return True
            elif c.tag not in ("a", "button"):
                stack.append((c, prose))
    return False


def is_main(node: Node) -> bool:
    return node.tag == "main" or node.attrs.get("role", "").lower() == "main"


def wrappers(root: Node) -> set[int]:
    """Forms, fieldsets, asides and the like that hold all of the page's articles, by ``id``: they are no boilerplate.

    A page without any article keeps the forms that hold all of its blocks of text.
    """
    nodes = list(preorder(root))
    for fits in (lambda n: (n.tag == "article" and not n.kinds[1]) or is_main(n), lambda n: n.tag in ("p", "h1")):
        around: set[int] = set()
        found = free = False
        for n in nodes:
            if not fits(n):
                continue
            mine, up, lost = [], n.parent, False
            while up is not None:
                if up.tag in WRAPPERS:
                    mine.append(id(up))
                lost |= up.tag in NEVER and up.tag not in WRAPPERS
                up = up.parent
            found = found or not lost
            if not mine and not lost:
                free = True
                break
            if not lost:
                around.update(mine)
        if found:
            return set() if free else around
    return set()


def preorder(root: Node):
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in reversed(node.children) if not isinstance(c, str)]


def prune(root: Node, agreed: frozenset[int] | set[int] = frozenset()) -> None:
    """Remove boilerplate by tag, role or name."""
    kept = wrappers(root)
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag == "article" or is_main(node)
        node.children = [c for c in node.children if isinstance(c, str) or id(c) in kept or not is_boilerplate(c, inside, agreed)]
        stack += [(c, inside) for c in node.children if not isinstance(c, str)]


def remove(root: Node, gone: set[int]) -> None:
    for node in preorder(root):
        if any(id(c) in gone for c in node.children):
            node.children = [c for c in node.children if id(c) not in gone]


def lines_of(root: Node, blocks: list | None = None) -> list[tuple[Node, str]]:
    """Block and text of each line in page order: references decoded, white space single, no empty line.

    ``blocks`` receives (block, parent block's place, child block tags, lines, links and images) of each block.
    """
    out: list[tuple[Node, str]] = []
    line: list[str] = []
    record = blocks is not None
    at = (root, -1, [], [], [])

    def close():
        if line:
            text = " ".join(html.unescape("".join(line)).split())
            if text:
                out.append((at[0], text))
                at[3].append(text)
            line.clear()

    stack: list = [(root, None)]
    while stack:
        x, back = stack.pop()
        if x is None:
            close()
            at = back
        elif isinstance(x, str):
            line.append(x)
        elif x.inline:
            if x.tag == "br":
                line.append(" ")
            elif record and (target := x.attrs.get("href") or x.attrs.get("src")):
                at[4].append(f"{x.tag} {target}")
            stack += [(c, None) for c in reversed(x.children)]
        else:
            close()
            stack.append((None, at))
            if record:
                at[2].append(x.tag)
            at = (x, len(blocks) if record else -1, [], [], [], at)
            if record:
                blocks.append(at)
            stack += [(c, None) for c in reversed(x.children)]
    close()
    return out


def outermost(root: Node, fits) -> list[Node]:
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node is not root and fits(node):
            found.append(node)
        else:
            stack += [c for c in reversed(node.children) if not isinstance(c, str)]
    return found


def containers(root: Node) -> list[Node]:
    """All outermost containers of the article in a pruned tree, without teasers beside them; none if none is named.

    They are articles, and mains that hold none of these; else blocks with such a name.
    """
    holds: set[int] = set()
    for n in preorder(root):
        up = n.parent if n.tag == "article" else None
        while up is not None and id(up) not in holds:
            holds.add(id(up))
            up = up.parent
    teasers: list[Node] = []
    for fits in (lambda n: n.tag == "article" or (is_main(n) and id(n) not in holds), lambda n: not n.inline and n.kinds[3]):
        found = [n for n in outermost(root, fits) if lines_of(n)]
        if own := [n for n in found if not n.kinds[1]]:
            return own
        teasers = teasers or found
    return teasers


def link_lists(root: Node) -> set[int]:
    """Blocks of several links that hold most of their text, by ``id``; sizes are summed upwards once."""
    size: Counter[int] = Counter()
    links: Counter[int] = Counter()
    linked: Counter[int] = Counter()
    order = list(preorder(root))
    for node in reversed(order):
        me = id(node)
        size[me] += sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            links[me], linked[me] = 1, size[me]
        if node.parent is not None:
            up = id(node.parent)
            size[up] += size[me]
            links[up] += links[me]
            linked[up] += linked[me]
    return {id(n) for n in order if not n.inline and n is not root and links[id(n)] > 1 and linked[id(n)] > 0.6 * size[id(n)]}


def main_lines(root: Node) -> list[str]:
    """Lines of the article in a pruned tree."""
    if found := containers(root):
        return [text for n in found for _, text in lines_of(n)]
    # no container is named: all of the page but blocks that are mostly links
    remove(root, link_lists(root))
    return [text for _, text in lines_of(root)]


class PageTree:
    """The marks of a page's nodes in the style tree of its host.

    Of each block: its key, its style's mark, marks of its lines, links and
    images, and its number of child blocks.
    """

    def __init__(self, host: int, root: Node):
        from xxhash import xxh3_64_intdigest as digest

        self.blocks: list = []
        lines_of(root, self.blocks)
        self.keys = np.empty(len(self.blocks), np.uint64)
        self.parents, self.sons = [], []
        self.marks: list[tuple[int, int, bool, str]] = []  # place of the block, mark, is it the style's, the line
        places: dict[tuple[int, str], int] = {}
        keys = [0] * len(self.blocks)
        for k, (node, _, sons, lines, others, up) in enumerate(self.blocks):
            parent = up[1]
            place = places[parent, node.tag] = places.get((parent, node.tag), -1) + 1
            key = keys[k] = digest(f"{node.tag} {place}", seed=keys[parent] if parent >= 0 else host & MASK)
            self.parents.append(parent)
            self.sons.append(len(sons))
            self.marks.append((k, digest(" ".join(sons), seed=key ^ 1), True, ""))
            for text in dict.fromkeys(lines):
                self.marks.append((k, digest(text.encode("utf-8", "replace"), seed=key ^ 2), False, text))
            for target in dict.fromkeys(others):
                self.marks.append((k, digest(target.encode("utf-8", "replace"), seed=key ^ 3), False, ""))
        self.keys[:] = keys

    def unimportant(self, entropy: np.ndarray, fixed: np.ndarray) -> tuple[set[int], set[int]]:
        """Blocks to remove by ``id``: outside of an article, and inside of one.

        ``entropy`` has a value a mark; ``fixed`` says that nearly all pages show it between different articles.
        """
        n = len(self.blocks)
        content, count, style = np.zeros(n), np.zeros(n), np.zeros(n)
        stays, moves = np.zeros(n, bool), np.zeros(n, bool)
        for (k, _, is_style, _), h, f in zip(self.marks, entropy.tolist(), fixed.tolist(), strict=True):
            if is_style:
                style[k] = h
            else:
                content[k] += 1 - h
                count[k] += 1
                moves[k] |= not f
        below, number = np.zeros(n), np.zeros(n)
        for k in range(n - 1, -1, -1):
            value = content[k] / count[k] if count[k] else below[k] / number[k] if number[k] else 0.0
            weight = GAMMA ** self.sons[k]
            value = (1 - weight) * (1 - style[k]) + weight * value
            stays[k] |= value >= LEAST_IMPORTANCE
            p = self.parents[k]
            if p >= 0:
                below[p] += value
                number[p] += 1
                stays[p] |= stays[k]
                moves[p] |= moves[k]
        outside = {id(b[0]) for b, s in zip(self.blocks, stays.tolist(), strict=True) if not s and b[0].tag not in ("html", "body", "main", "article")}
        inside = {id(b[0]) for b, s, f in zip(self.blocks, stays.tolist(), moves.tolist(), strict=True) if not s and not f and b[0].tag not in TEXT_BLOCKS}
        return outside, inside & outside


def page_features(host: int, page: str) -> list[tuple[int, int, bool, int, int, int]]:
    """(node, mark, is style, three context words) of each mark of a page.

    A context word has one bit for one of the longest other lines of the
    article.  Over the pages that show one mark, the number of bits tells
    different articles around it from copies of one.  A page without a named
    container is all article.
    """
    from xxhash import xxh3_64_intdigest as digest

    root = parse(page)
    tree = PageTree(host, root)
    prune(root)
    lines = {text for n in containers(root) or [root] for _, text in lines_of(n)}
    longest = sorted(lines, key=lambda b: (-len(b), b))[:4]
    bits = [1 << digest(b.encode("utf-8", "replace")) % 64 for b in longest]
    keys = tree.keys.tolist()
    around: dict[str, tuple[int, int, int]] = {}
    for skip in (*longest, ""):
        some = [b for b, text in zip(bits, longest, strict=True) if text != skip][:3] or [1]
        around[skip] = (some[0], some[min(1, len(some) - 1)], some[-1])
    return [(keys[k], mark, is_style, *around.get(text, around[""])) for k, mark, is_style, text in tree.marks]


SIGNED = lambda xs: pa.array(np.array(xs, np.uint64).view(np.int64))


def _feature_batches(batches):
    for batch in batches:
        seen: dict[int, list] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for node, mark, is_style, a, b, c in page_features(host, page):
                known = seen.get(mark)
                if known is None:
                    seen[mark] = [node, mark, is_style, 1, a, b, c]
                else:
                    known[3] += 1
                    known[4] |= a
                    known[5] |= b
                    known[6] |= c
        node, mark, style, count, a, b, c = zip(*seen.values(), strict=True) if seen else [()] * 7
        yield pa.RecordBatch.from_arrays(
            [SIGNED(node), SIGNED(mark), pa.array(style, pa.bool_()), pa.array(count, pa.int64()), SIGNED(a), SIGNED(b), SIGNED(c)], ["node", "mark", "style", "c", "bits_a", "bits_b", "bits_c"]
        )


def site_style_tree(pages: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The tree of all hosts from rows (host long, html): repeated marks and nodes.

    Marks: (mark, entropy float, fixed boolean) of what at least ``LEAST_PAGES``
    pages show with different texts around it.  Nodes: (node, pages, style and
    content entropy averaged over its pages, importance).  Counts combine in
    each batch and before their shuffle, so a host with a third of all pages is
    no hot spot.
    """
    names = "node long, mark long, style boolean, c long, bits_a long, bits_b long, bits_c long"
    seen = pages.where("html is not null").select("host", "html").mapInArrow(releasing(_feature_batches), names)
    counts = seen.groupBy("node", "mark", "style").agg(F.sum("c").alias("c"), *[F.bit_or(f"bits_{x}").alias(f"bits_{x}") for x in "abc"])
    counts = scratch.keep(counts, "counts")
    # every page that has a node shows one style of it
    size = counts.groupBy("node").agg(F.sum(F.when(F.col("style"), F.col("c"))).alias("m")).where(F.col("m") >= LEAST_PAGES)
    need = F.greatest(F.lit(2), F.ceil(F.least("c", F.lit(12)) * 2 / 3))
    differ = sum((F.bit_count(f"bits_{x}") >= need).cast("int") for x in "abc")
    repeated = counts.where(F.col("c") >= LEAST_PAGES).withColumn("differ", differ).where("differ >= 2").join(size, "node")
    entropy = F.when(F.col("m") > 1, F.least(F.lit(1.0), F.log("c") / F.log("m")))
    repeated = repeated.select("node", "mark", "style", "c", entropy.cast("float").alias("entropy"), ((F.col("differ") == 3) & (F.col("c") >= ARTICLE_SHARE * F.col("m"))).alias("fixed"))
    marks = scratch.keep(repeated, "marks")
    # a node's average over all its marks: those that are not repeated have entropy 0
    total = counts.groupBy("node").agg(F.sum(F.when(F.col("style"), F.col("c"))).alias("m"), F.sum(F.when(~F.col("style"), F.col("c"))).alias("f")).where(F.col("m") >= LEAST_PAGES)
    part = lambda style: F.sum(F.when(F.col("style") == style, F.col("c") * F.col("entropy")))
    nodes = total.join(marks.groupBy("node").agg(part(True).alias("hs"), part(False).alias("hf")), "node", "left")
    nodes = nodes.select("node", F.col("m").alias("pages"), (F.coalesce("hs", F.lit(0.0)) / F.col("m")).alias("style_entropy"), (F.coalesce("hf", F.lit(0.0)) / F.col("f")).alias("content_entropy"))
    return marks.select("mark", "entropy", "fixed"), nodes.withColumn("importance", 1 - F.coalesce("content_entropy", "style_entropy"))


def extract(page: str, host: int = 0, look=None) -> str:
    """Main text of one page; ``look`` gives entropy and ``fixed`` of an array of marks of its host's tree."""
    root = parse(page)
    if look is None:
        prune(root)
        return "\n".join(main_lines(root))
    tree = PageTree(host, root)
    entropy, fixed = look(np.array([m[1] for m in tree.marks], np.uint64))
    outside, inside = tree.unimportant(entropy, fixed) if entropy.any() else (set(), set())
    prune(root, outside)
    if entropy.any():
        chosen = containers(root)
        held = {id(x) for n in chosen for x in preorder(n)}
        size = sum(len(text) for n in chosen for _, text in lines_of(n))
        gone = {x for x in outside if x not in held} | (inside & held)
        for n in chosen:  # no container goes with what is around it
            while n is not None and id(n) not in held:
                held.add(id(n))
                n = n.parent
            while n is not None:
                gone.discard(id(n))
                n = n.parent
        gone -= {id(n) for n in chosen}
        if gone:
            remove(root, gone)
            lines = main_lines(root)
            if lines and 2 * sum(map(len, lines)) >= size:
                return "\n".join(lines)
            # most of the article repeats on its site: copies, about which repetition says nothing
            return extract(page)
    return "\n".join(main_lines(root))


def lookup(marks: np.ndarray, entropy: np.ndarray, fixed: np.ndarray):
    """``look`` of sorted marks."""

    def look(wanted: np.ndarray):
        if not len(marks):
            return np.zeros(len(wanted), np.float32), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(marks, wanted), len(marks) - 1)
        hit = marks[at] == wanted
        return np.where(hit, entropy[at], np.float32(0)), hit & fixed[at]

    return look


def sorted_marks(mark, entropy, fixed):
    order = np.argsort(mark, kind="stable")
    return mark[order], entropy[order], fixed[order]


def _extract_batches(shared):
    """Text of each page by the broadcast marks, or by those that its row brings."""

    def run(batches):
        look = lookup(*shared.value) if shared is not None else None
        for batch in batches:
            out = []
            for k, (host, page) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                if look is None:
                    low = batch.column("low")[k].as_py() or []
                    mine = np.array([x["mark"] for x in low], np.int64).view(np.uint64), np.array([x["entropy"] for x in low], np.float32), np.array([x["fixed"] for x in low], bool)
                    out.append(extract(page or "", host, lookup(*sorted_marks(*mine))))
                else:
                    out.append(extract(page or "", host, look))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(out, pa.string())], ["id", "url", "text"])

    return releasing(run)


def _mark_batches(batches):
    """(place, mark) of each page."""
    for batch in batches:
        place, marks = [], []
        for at, host, page in zip(batch.column("place").to_pylist(), batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            mine = {m[1] for m in PageTree(host, parse(page)).marks}
            place += [at] * len(mine)
            marks += mine
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.string()), SIGNED(marks)], ["place", "mark"])


def page_texts(
    spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_marks: int = MAX_MARKS
) -> DataFrame:
    """Per page: id, url, text, n_chars (code points of text).

    A null or empty page, or one without an article, gives an empty text.  A
    null url belongs to the host with the empty name.  Repeated pages keep
    their rows; an empty table gives an empty result; other columns are not
    read.  A page of any length or depth is parsed whole, in linear time.
    Up to ``max_marks`` repeated marks of all hosts are broadcast; more are
    joined to the pages that show them, so no task holds a host.
    """
    bound_batches(spark)
    host, _ = url_host_path(url_col)
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.xxhash64(host).alias("host"), F.col(html_col).alias("html"))
    scratch = Scratch(spark, "style-tree")
    marks, _ = site_style_tree(slim, scratch)
    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, url string, text string"
    if marks.count() <= max_marks:
        some = marks.toArrow()  # bounded by ``max_marks``
        mark, entropy, fixed = (some.column(c).to_numpy() for c in ("mark", "entropy", "fixed"))
        shared = spark.sparkContext.broadcast(sorted_marks(mark.astype(np.int64).view(np.uint64), entropy.astype(np.float32), fixed.astype(bool)))
        rows = slim.mapInArrow(_extract_batches(shared), schema)
    else:
        # equal pages of a host share their marks
        placed = slim.withColumn("place", F.concat_ws("-", F.col("host").cast("string"), F.md5("html")))
        shown = placed.where("html is not null").select("place", "host", "html").mapInArrow(releasing(_mark_batches), "place string, mark long").distinct()
        own = shown.join(marks, "mark").groupBy("place").agg(F.collect_list(F.struct("mark", "entropy", "fixed")).alias("low"))
        rows = placed.join(scratch.keep(own, "own"), "place", "left").select("id", "url", "host", "html", "low").mapInArrow(_extract_batches(None), schema)
    return rows.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
