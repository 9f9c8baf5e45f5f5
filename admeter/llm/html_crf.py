"""Main text of web pages: a linear-chain conditional random field over leaf blocks of the DOM.

A page is cut into leaf blocks, runs of text between two block-level tags. Each block has binary
features: tags and class words of its ancestors, length, links, punctuation, page words, and the same
of its neighbours; an edge knows whether two blocks lie in like elements. Two states, main text or not, are
decoded by Viterbi. The field is fitted by its likelihood (forward-backward, L2) to labelled pages:
pages of the table whose own markup says where the article is, the same pages with that markup
renamed or taken away, and pages laid out around their texts with menus, sidebars, notices, adverts,
forms and reader comments in the wording that sites use. At most ``SAMPLE`` distinct pages of at most
``LONGEST`` characters are fitted to; all pages are decoded in whole.

Defined cases: null or empty html, and pages without main text, give an empty text. Broken markup is
read as browsers do where that matters here: unclosed tags, comments, quotes and character
references; what follows an unclosed script or comment is no text. Repeated rows get a row each.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admeter.llm.common import merge_settings, table
from admeter.sources.shared import keep

#: Pages that the field is fitted to, their greatest length, and laid out pages beside them.
SAMPLE, LONGEST, LAID_OUT = 240, 60_000, 260
#: Steps and penalty of the fit.
STEPS, PENALTY = 250, 0.0003
#: Least number of blocks with a feature.
LEAST = 4
#: Attribute that carries a training label; no feature is made of it.
LABEL = "data-y"

# Fixed values of HTML: elements that break text into blocks, that end an open element of their own
# kind, that have no content, and whose content is no text of the page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup html label legend li listing main menu nav ol optgroup p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "tbody"),
}
SCOPES = frozenset("ul ol menu dl table td th div article section main body blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIPPED = frozenset("script style noscript template iframe textarea select button svg math object video audio canvas title noembed xmp".split())
ENDLESS = frozenset("script style textarea title iframe noembed xmp".split())

# Names that sites give to parts of a page, by the part.
NAMES = {
    "main": "article content main post entry story body text article-body post-content entry-content page-content main-content",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topbar main-menu nav-links pagination pager",
    "header": "header masthead site-header top branding banner page-header logo",
    "footer": "footer site-footer colophon bottom copyright page-footer legal footnote-links",
    "side": "sidebar aside related widget recommended most-read trending side rail related-posts secondary",
    "notice": "notice cookie cookies consent gdpr alert popup modal paywall disclaimer cookie-notice cookie-banner warning announcement",
    "ad": "ad ads advert advertisement sponsor sponsored promo promoted banner-ad adsense ad-container commercial",
    "form": "newsletter subscribe search login signup contact-form search-form subscription register",
    "comments": "comments comment replies discussion responses disqus reader-comments user-comments comment-list thread reactions",
    "share": "share social tags meta byline share-buttons author-bio post-meta social-links",
}
TAGS = {"main": ["article", "main"], "menu": ["nav"], "header": ["header"], "footer": ["footer"], "side": ["aside"],
        "notice": ["aside", "section", "dialog"], "ad": ["aside", "ins"], "form": ["form"], "comments": ["section", "aside"], "share": ["ul", "footer"]}
# Words that such parts use.
CUES = frozenset(
    "cookie cookies privacy subscribe newsletter login register password copyright rights reserved advertisement sponsored "
    "comment comments reply replies share related read next previous search menu terms contact follow tweet email accept "
    "posted commented likes ago © abonnieren datenschutz werbung kommentare anzeige impressum publicité commentaires "
    "répondre partager mentions publicidad comentarios responder compartir privacidad".split()
)
PHRASES = {
    "menu": ["Home", "News", "Contact", "About us", "Sport", "Blog", "Products", "Sitemap", "Login", "Shop", "World", "Accueil", "Kontakt", "Inicio"],
    "notice": ["We use cookies to improve your experience. Accept all cookies", "This site uses cookies and similar techniques; see our privacy policy.",
               "You have read 3 of 5 free articles. Subscribe to continue.", "Wir verwenden Cookies. Mehr zum Datenschutz.", "Ce site utilise des cookies.",
               "Important notice: the site will be down on Sunday for maintenance.", "Este sitio utiliza cookies."],
    "ad": ["Advertisement", "Sponsored: buy two, get one free!", "Buy now and save 50% on shoes", "Anzeige", "Publicité", "Publicidad", "Best deals of the week. Order today."],
    "form": ["Subscribe to our newsletter", "Your email address", "Search", "Password", "Sign up now and never miss a story", "Name", "I accept the terms", "Send"],
    "comments": ["Comments", "3 comments", "Leave a reply", "Kommentare (12)", "Commentaires", "Comentarios", "Reader comments", "Join the discussion"],
    "share": ["Share", "Tweet", "Tags: news, world", "Posted by admin on 3 May 2019", "Follow us", "5 min read", "Print this page"],
    "footer": ["© 2021 Example Media. All rights reserved.", "Privacy policy", "Terms of use", "Imprint", "Contact", "Copyright 2019", "Mentions légales", "Aviso legal"],
    "side": ["Related articles", "Most read", "You may also like", "Trending now", "Latest posts", "Popular"],
    "header": ["The Daily Example", "Example Blog", "Your source of news since 1999", "Skip to content", "Welcome to our site"],
}

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/](?!--)[^>]*(?:>|\Z)|<[A-Za-z][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Za-z]+")
_WORD = re.compile(r"[^\W\d_]+|©")
_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in SKIPPED}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    """Text of a leaf block, the features of its ancestors, its tag, linked characters and label."""

    text: str
    ancestors: frozenset[str]
    tag: str
    linked: int
    label: int


@dataclass
class _Open:
    tag: str
    ancestors: frozenset[str]
    label: int


def _names(tag: str, attributes: str) -> tuple[set[str], int | None]:
    """Ancestor features of one element and its training label."""
    found, label = {f"in:{tag}"}, None
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == LABEL:
                label = int(value)
            elif name in ("class", "id", "role", "itemprop", "aria-label"):
                words = [w.lower() for w in _NAME.findall(value)]
                found.update(f"as:{w}" for w in words[:20])
            elif name == "hidden" or (name == "style" and _HIDDEN.search(value)) or (name == "aria-hidden" and value == "true"):
                found.add("as:hidden")
    return found, label


def blocks(html: str, known: Callable[[str], bool] = lambda f: True) -> list[Block]:
    """Leaf blocks with text, in page order; ancestors' features are those that ``known`` lets through."""
    stack = [_Open("", frozenset(), 0)]
    opened: Counter[str] = Counter()
    out: list[Block] = []
    text: list[str] = []
    linked = in_link = at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                top = stack[-1]
                out.append(Block(whole, top.ancestors, top.tag, linked, top.label))
            text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if "&" in raw:
            raw = entities.unescape(raw)
        text.append(raw)
        if in_link:
            linked += len(raw.strip())

    def close(tags: tuple[str, ...], scope: bool) -> None:
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                for x in stack[k:]:
                    opened[x.tag] -= 1
                del stack[k:]
                if not scope:
                    return
                return close(tags, scope)
            if scope and stack[k].tag in SCOPES and stack[k].tag not in tags:
                return

    find = _TAG.search
    while m := find(html, at):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            elif tag in BLOCKS:
                flush()
                close((tag,), False)
                in_link = 0
            continue
        if tag in SKIPPED:
            end = None if m[3].endswith("/") and tag not in ENDLESS else _END[tag].search(html, at)
            if end:
                at = end.end()
            elif tag in ENDLESS:
                at = len(html)
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "hr":
            flush()
        elif tag == "a":
            in_link = 1
        elif tag in BLOCKS:
            flush()
            in_link = 0
            if opened["p"]:
                close(("p",), True)
            if tag in CLOSED_BY:
                close(CLOSED_BY[tag], True)
            elif tag in HEADINGS and stack[-1].tag in HEADINGS:
                close((stack[-1].tag,), False)
            names, label = _names(tag, m[3])
            up = stack[-1]
            fresh = {n for n in names if n not in up.ancestors and known(n)}
            stack.append(_Open(tag, up.ancestors | fresh if fresh else up.ancestors, up.label if label is None else label))
            opened[tag] += 1
    if at < len(html):
        add(html[at:])
    flush()
    return out


def _step(n: int) -> int:
    return n.bit_length()


def own_features(b: Block) -> list[str]:
    """Features of a block's text and tag."""
    text = b.text
    words = _WORD.findall(text[:400])
    n = text.count(" ") + 1
    link = min(b.linked, len(text)) * 4 // len(text)
    last = text[-1]
    out = [f"tag:{b.tag}", f"words:{min(_step(n), 8)}", f"link:{link}", "stop" if last in ".!?…。" else "stop:no"]
    if n > 3 and last in ".!?…\"”»" and not link:
        out.append("sentence")
    if text[0].islower():
        out.append("lower")
    out += [f"cue:{w}" for w in {w.lower() for w in words[:40]} & CUES]
    if "©" in text or "(c)" in text:
        out.append("cue:©")
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Features of each block, with those of its neighbours and its place."""
    own = [own_features(b) for b in page]
    n, out = len(page), []
    for i, f in enumerate(own):
        here = list(f)
        for name, j in (("before", i - 1), ("after", i + 1)):
            here += [f"{name}:{x}" for x in own[j][1:4]] if 0 <= j < n else [f"{name}:none"]
        here.append(f"place:{4 * i // n}")
        out.append(here)
    return out


def edges(page: list[Block]) -> np.ndarray:
    """For each block, 1 if its ancestors have the features of those of the block before, else 0."""
    return np.array([int(i > 0 and page[i - 1].ancestors == b.ancestors) for i, b in enumerate(page)], np.int64)


@dataclass
class Field:
    """Weights of main text against the rest by feature, start weights, transitions by kind of edge."""

    weights: dict[str, float] = field(default_factory=dict)
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2, 2)))

    def decode(self, page: list[Block], cache: dict[frozenset[str], float]) -> list[int]:
        """The most likely states of a page's blocks (Viterbi)."""
        if not page:
            return []
        get = self.weights.get
        scores = []
        for b, f in zip(page, features(page), strict=True):
            if b.ancestors not in cache:
                cache[b.ancestors] = sum(get(x, 0.0) for x in b.ancestors)
            scores.append(cache[b.ancestors] + sum(get(x, 0.0) for x in f))
        kinds = edges(page).tolist()
        moves = self.moves.tolist()
        no, yes = float(self.start[0]), float(self.start[1]) + scores[0]
        back = []
        for s, k in zip(scores[1:], kinds[1:], strict=True):
            (nn, ny), (yn, yy) = moves[k]
            to_no, to_yes = (no + nn, yes + yn), (no + ny, yes + yy)
            back.append((to_no[1] > to_no[0], to_yes[1] > to_yes[0]))
            no, yes = max(to_no), max(to_yes) + s
        state = int(yes > no)
        states = [state]
        for b in reversed(back):
            state = int(b[state])
            states.append(state)
        return states[::-1]

    def text(self, html: str | None, cache: dict[frozenset[str], float]) -> str:
        page = blocks(html or "", self.weights.__contains__)
        return "\n".join(b.text for b, y in zip(page, self.decode(page, cache), strict=True) if y)


class Sequences:
    """Labelled pages as arrays, longest first, for the likelihood and its gradient."""

    def __init__(self, pages: list[list[Block]]):
        pages = sorted((p for p in pages if p), key=len, reverse=True)
        named = [[sorted(b.ancestors) + f for b, f in zip(p, features(p), strict=True)] for p in pages]
        seen = Counter(x for p in named for f in p for x in set(f))
        self.names = sorted(x for x, n in seen.items() if n >= LEAST)
        number = {x: i for i, x in enumerate(self.names)}
        self.n, self.length = len(pages), len(pages[0])
        lengths = np.array([len(p) for p in pages])
        #: Pages that have a block at each place; they come first.
        self.on = [int((lengths > t).sum()) for t in range(self.length)]
        self.y, self.kind = np.zeros((self.length, self.n), np.int64), np.zeros((self.length, self.n), np.int64)
        rows, feats = [], []
        for i, (p, f) in enumerate(zip(pages, named, strict=True)):
            self.y[: len(p), i] = [b.label for b in p]
            self.kind[: len(p), i] = edges(p)
            for t, x in enumerate(f):
                ids = [number[a] for a in set(x) if a in number]
                rows += [t * self.n + i] * len(ids)
                feats += ids
        self.rows, self.feats = np.array(rows, np.int64), np.array(feats, np.int64)
        self.truth = np.zeros((2, 2, 2))
        for t in range(1, self.length):
            k = self.on[t]
            np.add.at(self.truth, (self.kind[t, :k], self.y[t - 1, :k], self.y[t, :k]), 1.0)

    def gradient(self, w: np.ndarray, start: np.ndarray, moves: np.ndarray) -> list[np.ndarray]:
        """Gradient of the mean log likelihood in the three sets of weights."""
        n, length = self.n, self.length
        emit = np.zeros((length, n, 2))
        emit[:, :, 1] = np.bincount(self.rows, w[self.feats], n * length).reshape(length, n)
        ahead, behind = np.zeros((length, n, 2)), np.zeros((length, n, 2))
        ahead[0] = start + emit[0]
        for t in range(1, length):
            k = self.on[t]
            step = ahead[t - 1, :k, :, None] + moves[self.kind[t, :k]]
            ahead[t, :k] = np.logaddexp(step[:, 0], step[:, 1]) + emit[t, :k]
        total = np.zeros(n)
        expected = np.zeros_like(moves)
        for t in range(length - 1, -1, -1):
            k, longer = self.on[t], self.on[t + 1] if t + 1 < length else 0
            total[longer:k] = np.logaddexp(ahead[t, longer:k, 0], ahead[t, longer:k, 1])
            if not t:
                break
            follow = moves[self.kind[t, :k]] + (emit[t, :k] + behind[t, :k])[:, None, :]
            behind[t - 1, :k] = np.logaddexp(follow[:, :, 0], follow[:, :, 1])
            pair = np.exp(ahead[t - 1, :k, :, None] + follow - total[:k, None, None])
            for kind in (0, 1):
                expected[kind] += pair[self.kind[t, :k] == kind].sum(0)
        likely = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total)
        error = (self.y - likely).ravel()
        first = np.stack([1 - likely[0], likely[0]], 1)
        grads = [np.bincount(self.feats, error[self.rows], len(w)), (np.eye(2)[self.y[0]] - first).sum(0), self.truth - expected]
        return [g / n for g in grads]


def fit(pages: list[list[Block]]) -> Field:
    """The field of greatest penalised likelihood on labelled pages; without any, one that knows nothing."""
    if not any(pages):
        return Field()
    data = Sequences(pages)
    at = [np.zeros(len(data.names)), np.zeros(2), np.zeros((2, 2, 2))]
    mean, square = [np.zeros_like(x) for x in at], [np.zeros_like(x) for x in at]
    for step in range(1, STEPS + 1):
        for k, g in enumerate(data.gradient(*at)):  # Adam
            g = g - PENALTY * at[k]
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            at[k] = at[k] + 0.15 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
    return Field(dict(zip(data.names, at[0].tolist(), strict=True)), at[1], at[2])


def labelled(html: str) -> str | None:
    """The page with labels by its own markup: article or main without their menus, headers and forms."""
    for tag in ("article", "main"):
        if len(re.findall(rf"<{tag}[\s>]", html, re.I)) == 1:
            out = re.sub(rf"<{tag}(?=[\s>])", f'<{tag} {LABEL}="1"', html, flags=re.I)
            return re.sub(r"<(nav|footer|aside|form)(?=[\s>])", rf'<\1 {LABEL}="0"', out, flags=re.I)
    return None


def renamed(html: str, rnd: random.Random, bare: bool) -> str:
    """A labelled page whose telling tags became div, with a class that sites use or none."""
    part = {"article": "main", "main": "main", "nav": "menu", "footer": "footer", "aside": "side", "header": "header"}

    def swap(m: re.Match) -> str:
        if m[1]:
            return "</div"
        names = rnd.choice(NAMES[part[m[2].lower()]].split())
        return "<div" if bare else f'<div class="{names}"'

    return re.sub(r"<(/?)(article|main|nav|footer|aside|header)(?=[\s>])", swap, html, flags=re.I)


def laid_out(rnd: random.Random, articles: list[list[str]]) -> str:
    """A labelled page around one article's paragraphs, with parts that hold other texts."""

    def escape(s: str) -> str:
        return entities.escape(s, quote=False)

    def other() -> str:
        return escape(rnd.choice(rnd.choice(articles)))

    def box(part: str, inner: str, label: int | None = 0) -> str:
        tag, mark = "div", "" if label is None else f' {LABEL}="{label}"'
        style = rnd.random()
        if style < 0.4:
            tag = rnd.choice(TAGS[part])
            if tag in ("section", "ins", "ul", "dialog") or rnd.random() < 0.5:
                mark += f' class="{rnd.choice(NAMES[part].split())}"'
        elif style < 0.92 or part in ("comments", "notice", "ad"):
            key = "id" if rnd.random() < 0.3 else "class"
            mark += f' {key}="{rnd.choice(NAMES[part].split())}"'
        tag = "div" if tag in ("ul", "ins") else tag
        return f"<{tag}{mark}>{inner}</{tag}>"

    def links(words: list[str], n: int) -> str:
        items = [f'<li><a href="/{i}">{escape(rnd.choice(words))}</a></li>' for i in range(n)]
        return f"<ul>{''.join(items)}</ul>" if rnd.random() < 0.7 else " | ".join(x[4:-5] for x in items)

    def some(part: str) -> str:
        return escape(rnd.choice(PHRASES[part]))

    def headlines() -> list[str]:
        return [" ".join(rnd.choice(rnd.choice(articles)).split()[: rnd.randrange(3, 9)]) for _ in range(5)]

    body = rnd.choice(articles)
    title = " ".join(body[0].split()[: rnd.randrange(3, 12)])
    inner = [f"<h1>{escape(title)}</h1>"] if rnd.random() < 0.8 else []
    for p in body:
        kind = rnd.random()
        text = escape(p)
        if kind < 0.72:
            inner.append(f"<p>{text}</p>" if rnd.random() < 0.8 else f"<p><b>{text}<br>")
        elif kind < 0.80:
            inner.append(f"<div>{text}</div>")
        elif kind < 0.86:
            inner.append("<ul>" + "".join(f"<li>{escape(x)}</li>" for x in p.split(". ")[:5]) + "</ul>")
        elif kind < 0.92:
            inner.append(f"<blockquote><p>{text}</p></blockquote>")
        else:
            inner.append(f"<h2>{escape(' '.join(p.split()[:4]))}</h2><p>{text}</p>")
        if rnd.random() < 0.12:
            part = rnd.choice(["ad", "side", "form", "notice", "share"])
            inner.append(box(part, f"<p>{some(part) if rnd.random() < 0.6 else other()}</p>"))
    if rnd.random() < 0.2:
        inner.insert(0, box("share", f"<p>{some('share')}</p>"))

    def comments() -> str:
        each = [f"<p>{other()}</p>" if rnd.random() < 0.5 else f'<div class="{rnd.choice(NAMES["comments"].split())}"><b>user{i}</b> {other()}</div>' for i in range(rnd.randrange(1, 6))]
        return box("comments", (f"<h3>{some('comments')}</h3>" if rnd.random() < 0.7 else "") + "".join(each))

    if rnd.random() < 0.25:
        inner.append(comments())
    parts = [box("main", "".join(inner), 1)]
    if rnd.random() < 0.15:
        parts = [f"<form>{parts[0]}</form>"]
    if rnd.random() < 0.5:
        parts.append(comments())
    extras = {
        "notice": f"<p>{some('notice') if rnd.random() < 0.7 else other()}</p>",
        "ad": f"<p>{some('ad')}</p>" if rnd.random() < 0.4 else other(),
        "form": f"<p>{some('form')}</p><label>{some('form')}</label><input name=q>",
        "side": f"<h3>{some('side')}</h3>{links(headlines(), 4)}" if rnd.random() < 0.6 else f"<p>{other()}</p>",
        "share": f"<p>{some('share')}</p>",
    }
    for part, text in extras.items():
        if rnd.random() < 0.55:
            parts.insert(rnd.randrange(len(parts) + 1), box(part, text))
    top = box("header", f"<p>{some('header')}</p>" + (links(PHRASES["menu"], 5) if rnd.random() < 0.5 else ""))
    menu = box("menu", links(PHRASES["menu"] if rnd.random() < 0.5 else headlines(), rnd.randrange(3, 8)))
    foot = box("footer", f"<p>{some('footer')}</p>" + (other() if rnd.random() < 0.4 else ""))
    page = ([top] if rnd.random() < 0.7 else []) + ([menu] if rnd.random() < 0.8 else []) + parts + ([foot] if rnd.random() < 0.85 else [])
    if rnd.random() < 0.5:
        page = [f'<div class="{rnd.choice(["wrapper", "container", "page", "site", "layout"])}">', *page, "</div>"]
    return f"<html><body>{''.join(page)}</body></html>"


def training_pages(sample: list[str], seed: int = 7) -> list[list[Block]]:
    """Labelled blocks of sampled pages, of their renamed forms and of pages laid out around their texts."""
    rnd = random.Random(seed)
    marked = [m for h in sample if (m := labelled(h))]
    pages = [blocks(m) for m in marked]
    pages += [blocks(renamed(m, rnd, bare=rnd.random() < 0.15)) for m in marked]
    articles = [t for p in pages[: len(marked)] if (t := [b.text for b in p if b.label])]
    if not articles:  # no page says where its article is: long texts serve as paragraphs
        articles = [t for h in sample if (t := [b.text for b in blocks(h) if len(b.text) > 80])]
    if articles:
        pages += [blocks(laid_out(rnd, articles)) for _ in range(LAID_OUT)]
    return pages


def train(pages: DataFrame) -> Field:
    """The field fitted to at most ``SAMPLE`` distinct pages, the smallest hashes of their html."""
    rows = pages.where(F.length("html") <= LONGEST).select(F.xxhash64("html").alias("h"), "html")
    wanted = [r[0] for r in rows.select("h").distinct().orderBy("h").limit(SAMPLE).collect()]
    found = rows.where(F.col("h").isin(wanted)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect()
    return fit(training_pages([r["html"] for r in found]))


def extracted(pages: DataFrame, model: Field) -> DataFrame:
    """``pages`` with the main text of their html in place of it, and its length in code points."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[frozenset[str], float] = {}
        for pdf in frames:
            texts = [model.text(h, cache) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})
            if len(cache) > 100_000:
                cache.clear()

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")  # null ids stay null
    out = rows.mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))


def op11_html_crf(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page; see the module for null, empty and broken html."""
    pages = table(spark, sf, "pages")
    with merge_settings(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "256"}):
        return keep(extracted(pages, train(pages)), "extracted")
