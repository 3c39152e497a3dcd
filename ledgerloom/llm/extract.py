"""Main text of web pages by a linear-chain conditional random field (operator 11).

A page is cut into leaf blocks: stretches of text between the bounds of block elements.
Each block has features of its ancestors (tags, words of their class, id and role) and of
its text (length, share of links, punctuation, place in the page). The field weighs these
and which kind of block follows which; Viterbi's algorithm gives the labels of all blocks
of a page at once.

It is trained on labelled pages: pages of the table that mark their article in their own
markup, as they are and once more with their blocks set in other layouts, whose
markup says little or nothing about what is the article."""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: labelled pages the field is fitted on, at most, and the most characters of one of them
MAX_PAGES, MAX_CHARS = 400, 1 << 16
FEATURES = 1 << 14

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea iframe noframes xmp".split())  # their content holds no elements
IN_HEAD = frozenset("base head link meta noscript script style template title".split())
UNSEEN = frozenset("script style title noscript template iframe noframes head textarea".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select
    summary table tbody td tfoot th thead tr ul""".split())
#: an opening element of the first kind ends an open one of the second
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "body": ("head",)}
BREAKS_P = BLOCK - {"option", "optgroup", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary", "html", "body", "head"}
SCOPE = frozenset("table td th ul ol dl select body html".split())  # an implied end does not reach beyond these

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S | re.X)
_NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_BLANK = re.compile(r"\s+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)


@dataclass
class Leaf:
    """A block of text: its text, the features of its ancestors, and characters in links."""

    text: str
    above: frozenset[str]
    tag: str
    linked: int


def leaves(page: str) -> tuple[list[Leaf], str]:
    """The leaf blocks of a page in order, and its title. Character references are decoded,
    white space becomes one blank; content that is never shown is left out."""
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # open elements with the features they add
    count: dict[str, int] = {}
    unseen = links = linked = 0
    held: list[str] = []
    title = ""
    above: frozenset[str] | None = None

    def flush() -> None:
        nonlocal linked, above
        if held:
            text = _BLANK.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                if above is None:
                    above = frozenset(count)
                tag = next((t for t, _ in reversed(stack) if t in BLOCK), "")
                out.append(Leaf(text, above, tag, min(linked, len(text))))
        linked = 0

    def pop() -> None:
        nonlocal unseen, links, above
        tag, features = stack.pop()
        above = None
        unseen -= tag in UNSEEN
        links -= tag == "a"
        for f in features:
            count[f] -= 1
            if not count[f]:
                del count[f]

    def close(tags: tuple[str, ...] | str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in SCOPE:
                return

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        piece = page[at:found.start()] if found else page[at:]
        if piece and not unseen:
            held.append(piece)
            if links:
                linked += len(piece)
        if not found:
            break
        at = found.end()
        closing, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        elif tag == "br":
            held.append(" ")
            continue
        if closing:
            if any(t == tag for t, _ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if unseen and tag not in IN_HEAD:
            close(("head",))
        if tag in BREAKS_P:
            close(("p",))
        if tag in ENDS:
            close(ENDS[tag])
        if tag in VOID:
            continue
        names = {"c:" + w.lower() for m in _NAMES.finditer(attributes) for w in _PARTS.findall(m.group(1) or m.group(2) or m.group(3) or "")} \
            if "=" in attributes else ()
        features = ("a:" + tag, *sorted(names), *(("a:hidden",) if attributes and _HIDDEN.search(attributes) else ()))
        stack.append((tag, features))
        above = None
        unseen += tag in UNSEEN
        links += tag == "a"
        for f in features:
            count[f] = count.get(f, 0) + 1
        if tag in RAW:
            stop = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            if tag == "title" and not title:
                title = _BLANK.sub(" ", html.unescape(page[at:stop.start() if stop else end])).strip()
            at = stop.start() if stop else end
    flush()
    return out, title


def _bucket(n: int) -> int:
    return n.bit_length()


def text_features(leaf: Leaf, i: int, n: int, title: str) -> list[str]:
    text, size = leaf.text, len(leaf.text)
    words = text.count(" ") + 1
    marks = sum(text.count(c) for c in ".,;:!?。、！？")
    return [f"t:{leaf.tag}", f"n:{_bucket(size)}", f"w:{_bucket(words)}", f"l:{-(-4 * leaf.linked // size)}", f"l:{leaf.tag}:{2 * leaf.linked > size}",
            f"m:{min(_bucket(marks), 4)}", f"e:{text[-1] if text[-1] in '.!?:,;|»›' else 'x'}", f"s:{text[0] if text[0] in '©|»›#@+' else 'x'}",
            f"p:{min(i, 3)}", f"q:{min(n - 1 - i, 3)}", f"d:{4 * sum(map(str.isdigit, text[:256])) // min(size, 256)}",
            f"h:{bool(title) and (title.startswith(text) or text.startswith(title))}", "b"]


def features(leaf: Leaf, i: int, n: int, title: str) -> list[str]:
    return [*leaf.above, *text_features(leaf, i, n, title)]


def numbers(names: list[str]) -> list[int]:
    return [zlib.crc32(x.encode("utf-8", "replace")) % FEATURES for x in names]


# Labelled pages -------------------------------------------------------------------------

_MAIN = ("a:article", "a:main")
# Words that name what is not the article.
_ASIDE_TAGS = frozenset("a:nav a:aside a:footer a:form a:button a:select a:hidden a:dialog".split())
_ASIDE_NAMES = frozenset("""c:ad c:ads c:advert c:advertisement c:sponsor c:sponsored c:promo c:banner c:cookie c:cookies c:consent c:notice c:popup
    c:modal c:newsletter c:subscribe c:signup c:comment c:comments c:reply c:replies c:respond c:disqus c:share c:sharing c:social c:related
    c:recommended c:sidebar c:menu c:nav c:navigation c:breadcrumb c:breadcrumbs c:footer c:toolbar c:widget c:login c:search""".split())


def own_labels(blocks: list[Leaf]) -> list[int] | None:
    """Labels that a page's own markup gives, or None if it marks no article."""
    labels = [int(any(m in b.above for m in _MAIN) and not b.above & _ASIDE_TAGS and not b.above & _ASIDE_NAMES) for b in blocks]
    return labels if any(labels) and not all(labels) else None


# Short texts that sites put around articles.
_NOTICES = ("We use cookies to improve your visit. Accept all", "This site uses cookies.", "Accept", "Reject all", "Privacy policy",
            "Please disable your ad blocker.", "Sign up for updates", "Subscribe to our newsletter", "Your e-mail address", "Send")
_LABELS = ("Home", "News", "About", "Contact", "Login", "Archive", "Next", "Previous", "Share", "Print", "Imprint", "Terms of use", "Tags:",
           "Read more", "Related articles", "Leave a reply", "3 comments", "Advertisement", "All rights reserved.", "© 2024")


def _element(r: random.Random, names: tuple[str, ...], body: str, tags: tuple[str, ...] = ("div", "section")) -> str:
    tag, name = r.choice(tags), r.choice(names)
    how = f' class="{name}"' if r.random() < 0.6 else f' id="{name}"'
    return f"<{tag}{how if name else ''}>{body}</{tag}>"


def relaid(blocks: list[Leaf], labels: list[int], title: str, seed: int) -> str:
    """The blocks of a labelled page in another layout. Elements of the article carry the
    class ``goldmark``, which no feature keeps; notes, menus and comments stand around it
    and some inside."""
    r = random.Random(seed)
    esc = html.escape
    main = [b.text for b, y in zip(blocks, labels, strict=True) if y]
    rest = [b.text for b, y in zip(blocks, labels, strict=True) if not y] or list(_LABELS)
    sentences = [s for t in main for s in t.split(". ")][:200]
    some = lambda k, pool: [r.choice(pool) for _ in range(k)]
    links = lambda k: "".join(f"<li><a href='/{i}'>{esc(x)}</a></li>" for i, x in enumerate(some(k, [*rest, *_LABELS])))
    plain = r.random() < 0.25  # a page without telling names
    name = lambda *names: ("",) if plain else names
    menu = _element(r, name("menu", "nav-bar", "navigation", "topNav"), f"<ul>{links(r.randrange(3, 9))}</ul>", ("div", "nav", "header"))
    crumbs = _element(r, name("breadcrumb", "breadcrumbs"), " &raquo; ".join(f"<a href='#'>{esc(x)}</a>" for x in some(3, _LABELS)))
    notice = _element(r, ("cookie-notice", "consent", "notice", "cookieBanner"), f"<p>{esc(r.choice(_NOTICES))}</p><button>{esc(r.choice(_NOTICES))}</button>",
                      ("div", "aside", "dialog"))
    advert = lambda: _element(r, ("ad", "advert", "sponsored", "promo-box"), f"{esc(r.choice(rest))}", ("div", "aside"))
    side = _element(r, name("sidebar", "widget-area", "side"), f"<h3>{esc(r.choice(_LABELS))}</h3><ul>{links(r.randrange(2, 8))}</ul>", ("div", "aside"))
    form = f"<form action='/s'><p>{esc(r.choice(_NOTICES))}</p><label>{esc(r.choice(_NOTICES))}</label><input name='q'><button>{esc(r.choice(_LABELS))}</button></form>"
    comments = _element(r, ("comments", "comment-list", "disqus", "replies"), f"<h3>{esc(r.choice(_LABELS))}</h3>" + "".join(
        f"<div class='comment'><b>{esc(r.choice(_LABELS))}</b><p>{esc('. '.join(some(r.randrange(1, 4), sentences)))}</p></div>" for _ in range(r.randrange(1, 5))))
    foot = _element(r, name("footer", "site-footer", "copyright"), f"&copy; {esc(r.choice(rest))} &middot; {esc(r.choice(_LABELS))}", ("div", "footer"))
    out = []
    for i, text in enumerate(main):
        tag = r.choice(("h1", "h2")) if i == 0 and title and text.startswith(title[:20]) else r.choice(("p",) * 9 + ("blockquote", "li", "div", "h2"))
        out.append(f"<{tag} class='goldmark'>{esc(text)}</{tag}>")
        if r.random() < 0.06:
            out.append(r.choice((advert(), form, _element(r, ("share", "social"), f"<ul>{links(3)}</ul>"), f"<aside>{esc(r.choice(sentences))}</aside>")))
    inside = "".join(out) + (comments if r.random() < 0.3 else "")
    body = _element(r, name("content", "post", "entry-content", "article-body", "story", "text", "main"), inside, ("div", "section", "main", "article", "td"))
    before = [x for x in (menu, crumbs, notice, advert(), form, side) if r.random() < 0.6]
    after = [x for x in (side, comments, advert(), form, notice) if r.random() < 0.5]
    r.shuffle(before)
    r.shuffle(after)
    return f"<html><head><title>{esc(title)}</title></head><body>{''.join(before)}{body}{''.join(after)}{foot}</body></html>"


def encoded(blocks: list[Leaf], title: str) -> list[list[int]]:
    return [numbers([f for f in features(b, i, len(blocks), title) if f != "c:goldmark"]) for i, b in enumerate(blocks)]


def examples(page: str) -> list[tuple[list[list[int]], list[int]]]:
    """Feature numbers and labels of a page that marks its article, as it is and relaid."""
    blocks, title = leaves(page)
    labels = own_labels(blocks)
    if labels is None:
        return []
    out = [(encoded(blocks, title), labels)]
    again, title = leaves(relaid(blocks, labels, title, zlib.crc32(page.encode("utf-8", "replace"))))
    return [*out, (encoded(again, title), [int("c:goldmark" in b.above) for b in again])]


# The field ------------------------------------------------------------------------------


@dataclass
class Field:
    """Weights of the features for a block to be article, of a first block, and of a block
    of one kind after one of another."""

    weights: np.ndarray
    first: np.ndarray
    follow: np.ndarray

    def labels(self, scores: list[float]) -> list[int]:
        """Viterbi: the best labels of a page from the scores of its blocks."""
        (stay, rise), (fall, keep) = self.follow.tolist()
        off, on = self.first.tolist()
        back = []
        for i, s in enumerate(scores):
            if i:
                from_on, to_on = off + stay < on + fall, on + keep >= off + rise
                back.append((from_on, to_on))
                off, on = (on + fall if from_on else off + stay), (on + keep if to_on else off + rise)
            on += s
        label = int(on > off)
        out = [label] if scores else []
        for from_on, to_on in reversed(back):
            label = int(to_on if label else from_on)
            out.append(label)
        return out[::-1]


def _objective(theta: np.ndarray, ids, block, when, who, active, gold, ridge: float) -> tuple[float, np.ndarray]:
    """Negative log-likelihood with a ridge, and its gradient. Block b is number when[b]
    of page who[b]; the first active[t] pages have a block t."""
    w, first, follow = theta[:FEATURES], theta[FEATURES:FEATURES + 2], theta[FEATURES + 2:].reshape(2, 2)
    score = np.bincount(block, w[ids], len(when))
    top = np.maximum(score, 0)  # keeps the exponentials small
    emit = np.zeros((len(active), active[0], 2))
    emit[when, who, 0], emit[when, who, 1] = np.exp(-top), np.exp(score - top)
    start, step = np.exp(first - first.max()), np.exp(follow - follow.max())
    alpha, beta, scale = np.zeros_like(emit), np.ones_like(emit), np.ones(emit.shape[:2])
    for t, k in enumerate(active):
        now = (alpha[t - 1, :k] @ step if t else start) * emit[t, :k]
        scale[t, :k] = now.sum(1)
        alpha[t, :k] = now / scale[t, :k, None]
    pairs = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        k = active[t]
        ahead = emit[t, :k] * beta[t, :k] / scale[t, :k, None]
        beta[t - 1, :k] = ahead @ step.T
        pairs += step * (alpha[t - 1, :k].T @ ahead)
    chance = alpha[when, who, 1] * beta[when, who, 1]
    y = np.zeros(emit.shape[:2], int)
    y[when, who] = gold
    moves = np.concatenate([np.zeros(0, int), *[2 * y[t - 1, :k] + y[t, :k] for t, k in enumerate(active) if t]])
    gold_pairs = np.bincount(moves, minlength=4).reshape(2, 2)
    gold_first = np.bincount(y[0], minlength=2)
    begin = (alpha[0] * beta[0]).sum(0)
    total = np.log(scale).sum() + top.sum() + active[0] * first.max() + len(moves) * follow.max()
    value = total - (score * gold).sum() - gold_first @ first - (gold_pairs * follow).sum()
    gradient = np.concatenate((np.bincount(ids, (chance - gold)[block], FEATURES), begin - gold_first, (pairs - gold_pairs).ravel()))
    return value + ridge * (theta @ theta) / 2, gradient + ridge * theta


def minimise(f, x: np.ndarray, rounds: int = 80, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton steps with a halving line search."""
    value, slope = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, kept = slope.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            kept.append(a)
            q -= a * y
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.abs(slope).sum(), 1)
        for (s, y), a in zip(past, reversed(kept), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        size = 1.0
        while size > 1e-10:
            new, other = f(x - size * q)
            if new <= value - 1e-4 * size * (slope @ q):
                break
            size /= 2
        else:
            break
        s, y = -size * q, other - slope
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        done = value - new < 1e-6 * max(abs(value), 1)
        x, value, slope = x + s, new, other
        if done:
            break
    return x


def train(pages: list[tuple[list[list[int]], list[int]]], ridge: float = 0.1) -> Field:
    theta = np.zeros(FEATURES + 6)
    pages = sorted((p for p in pages if p[1]), key=lambda p: -len(p[1]))
    if pages:
        lengths = np.asarray([len(y) for _, y in pages])
        who, when = np.repeat(np.arange(len(pages)), lengths), np.concatenate([np.arange(n) for n in lengths])
        active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(lengths[0])]
        rows = [x for p, _ in pages for x in p]
        block, ids = np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.concatenate([np.asarray(x) for x in rows])
        gold = np.concatenate([np.asarray(y, float) for _, y in pages])
        theta = minimise(lambda x: _objective(x, ids, block, when, who, active, gold, ridge), theta)
    return Field(theta[:FEATURES], theta[FEATURES:FEATURES + 2], theta[FEATURES + 2:].reshape(2, 2))


# A page for tables none of whose pages marks its article.
_SAMPLE = "<html><head><title>Title of the page</title></head><body><nav><a href='/'>Home</a></nav><article><h1>Title of the page</h1>" + "".join(
    f"<p>{'A sentence of some words, as articles have them. ' * (n % 5 + 1)}</p>" for n in range(12)) + \
    "</article><aside>A note beside it</aside><footer>&copy; somebody</footer></body></html>"


def fit(pages: DataFrame, limit: int = MAX_PAGES, html_col: str = "html") -> Field:
    """Fitted on at most ``limit`` different pages of at most MAX_CHARS characters that mark
    their article, those of the smallest hashes; the driver gets their feature numbers.
    A fixed page is always among them."""
    page = F.col(html_col).cast("string")
    marked = pages.select(page.alias("page")).where(F.length("page") <= MAX_CHARS).where(F.lower("page").rlike("<(article|main)[\\s>]"))
    chosen = marked.orderBy(F.xxhash64("page"), "page").limit(limit).distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for text in batch.column(0).to_pylist() for x in examples(text)]
            yield pa.RecordBatch.from_pydict({"ids": pa.array([x for x, _ in found], pa.list_(pa.list_(pa.int32()))),
                                              "gold": pa.array([y for _, y in found], pa.list_(pa.int32()))})

    table = chosen.mapInArrow(read, "ids ARRAY<ARRAY<INT>>, gold ARRAY<INT>").toArrow()
    return train([*examples(_SAMPLE), *sorted(zip(table.column("ids").to_pylist(), table.column("gold").to_pylist(), strict=True))])


class Reader:
    """A field with the weights of the feature names met so far."""

    def __init__(self, field: Field):
        self.field, self.known = field, {}

    def weight(self, name: str) -> float:
        value = self.known.get(name)
        if value is None:
            if len(self.known) > 1 << 16:
                self.known.clear()
            value = self.known[name] = float(self.field.weights[numbers([name])[0]])
        return value

    def main_text(self, page: str) -> str:
        blocks, title = leaves(page)
        above: dict[frozenset[str], float] = {}
        scores = []
        for i, b in enumerate(blocks):
            base = above.get(b.above)
            if base is None:
                base = above[b.above] = sum(map(self.weight, sorted(b.above)))
            scores.append(base + sum(map(self.weight, text_features(b, i, len(blocks), title))))
        return "\n".join(b.text for b, y in zip(blocks, self.field.labels(scores), strict=True) if y)


def main_text(pages: DataFrame, field: Field, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row: the blocks labelled as article, one per
    line, whole.

    Null and empty pages, and pages without a block of the article, have an empty text.
    Malformed markup is read as far as it goes: ends without a beginning are ignored, open
    elements and comments reach to the end, tags cut off at the end are dropped. White
    space is all that Unicode calls so. Repeated rows get equal results, other columns are
    ignored, an empty table gives no rows; a page of any length is read whole."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(field)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [reader.main_text(x) if x else "" for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_pydict({"page_id": part.column(0), "url": part.column(1), "text": pa.array(texts, pa.string())})

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(read, "page_id BIGINT, url STRING, text STRING").withColumn("n_chars", F.length("text").cast("long"))
