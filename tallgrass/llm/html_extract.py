"""Main text of pages by a tree-structured graphical model over the DOM.

Each element and each run of text is a node with a binary label, content or not. The model has a
weight for each feature of a node (tag, words of class and id, what the elements around it are for, share of link text, length, ...) and label, and a
potential for each pair of labels of a parent and its child, by the kind of the child. Sum-product message
passing, once upward and once downward, gives the exact marginals of all nodes; a run of text is kept if its
content marginal is at least one half.

The model is fitted by the gradient of the log-likelihood (observed less expected features, the expectation from
the same message passing) on labelled pages. As the tables hold no labels, labelled_pages() makes such pages from a seed, in
many layouts; a user with labelled pages passes them to fit(). The fitted weights are a few kilobytes and
are sent to the executors.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches

# Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
#: Elements that never hold text of the page.
HIDDEN = frozenset("script style head title textarea xmp iframe noembed noframes noscript template select option datalist svg math canvas object audio video".split())
BLOCKS = frozenset("html body address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section table tbody thead tfoot tr td th caption ul summary menu center legend button".split())
#: A start tag of the key ends an open element of the value.
ENDS: dict[str, frozenset[str]] = {t: frozenset({"p"}) for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul center".split()}
ENDS |= {"li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
ENDS |= {t: frozenset({"tr", "td", "th", "thead", "tbody", "tfoot"}) for t in ("thead", "tbody", "tfoot")}
#: Elements that an implied end does not reach out of.
WALLS = frozenset("table ul ol dl div article aside section nav header footer main form body html td th blockquote figure details".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACE = re.compile(r"\s+")
PART = re.compile(r"[a-z]+")
#: Where a word of a name like siteHeader begins.
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Attributes that say what an element is for.
TELLING = frozenset({"class", "id", "role", "aria-label", "itemprop"})


class Node:
    __slots__ = ("tag", "words", "parent", "text", "start", "hidden")

    def __init__(self, tag: str, words: tuple[str, ...], parent: int, text: str | None = None):
        self.tag, self.words, self.parent, self.text = tag, words, parent, text


@lru_cache(65536)
def _words(attrs: str) -> tuple[str, ...]:
    found: list[str] = []
    low = attrs.lower()
    for m in ATTR.finditer(attrs):
        if m[1].lower() in TELLING:
            found += PART.findall(HUMP.sub(" ", m[2] or m[3] or m[4] or "").lower())
    if re.search(r"(?:^|\s)hidden(?=[\s=/]|$)", low) or re.search(r"display\s*:\s*none|aria-hidden\s*=\s*.?true", low):
        found.append("hidden")
    return tuple(dict.fromkeys(found))


def parse(page: str) -> list[Node]:
    """The nodes of a page in page order, parents first; runs of text are nodes of tag "#text".

    Any string is a page: unknown, unclosed and misplaced tags are taken as browsers mostly take them.
    """
    nodes = [Node("#root", (), -1)]
    stack = [0]
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        m = None
        begin = lt
        while lt >= 0:
            m = TOKEN.match(page, lt)
            if m:
                break
            lt = page.find("<", lt + 1)
        end = n if m is None else m.start()
        if end > at:
            _text(nodes, stack, page[at:end])
        if m is None:
            break
        del begin
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    del stack[k:]
                    break
            continue
        ends = ENDS.get(tag)
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                open_ = nodes[stack[k]].tag
                if open_ in ends:
                    del stack[k:]
                elif open_ in WALLS:
                    break
        nodes.append(Node(tag, _words(m[3]) if m[3] else (), stack[-1]))
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            stop = n if close is None else close.start()
            gt = -1 if close is None else page.find(">", stop)
            at = n if gt < 0 else gt + 1
            continue
        stack.append(len(nodes) - 1)
    return nodes


def _text(nodes: list[Node], stack: list[int], raw: str) -> None:
    nodes.append(Node("#text", (), stack[-1], _html.unescape(raw) if "&" in raw else raw))


#: Words that layouts use for what is not content, for what is, and for either (fixed values).
BOILER = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav sitenav mainmenu pagination pager tabs toc",
    "header": "header masthead banner topbar logo branding sitehead head",
    "footer": "footer bottom copyright legal sitefoot colophon imprint foot",
    "aside": "sidebar aside related recommended widget rail trending popular more teaser tags secondary archive",
    "notice": "cookie consent notice banner gdpr alert popup modal overlay toast privacy message",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense adslot partner commercial",
    "form": "form newsletter subscribe signup search login contact register",
    "comments": "comments comment respond discussion replies reply disqus thread commentlist feedback responses",
    "share": "share social sharing follow toolbar buttons meta byline author date",
}
CONTENT = "article content main post story entry body text articlebody maincontent postcontent entrycontent richtext prose news blog single hentry"
NEUTRAL = "container wrapper wrap page site row col layout grid inner box block section panel outer center left right column clearfix item list title group area"
#: Features of nodes and kinds of children, by number. Words of class and id are hashed to the rest.
TAGS = {t: i for i, t in enumerate("#root #text html body div p span a ul ol li article main section nav header footer aside form table tr td h1 h2 h3 h4 h5 h6 b i em strong br img pre code blockquote figure figcaption button label input dl dt dd other".split())}
N_TAGS = len(TAGS)
#: So many that words which no labelled page has seldom meet one that has a weight.
HASHED = 1 << 14
#: Positions of single features behind the tags.
BIAS, LINKED, HALF_LINKED, SHORT, MEDIUM, LONG, NO_STOP, HAS_STOP, MOST, SOME, LITTLE = range(N_TAGS, N_TAGS + 11)
#: What an element is for, by its tag or a word of its class, id or role; a node has a feature for each of those it stands in.
PURPOSES = [*BOILER, "content"]
PURPOSE = {w: k for k, name in reversed(list(enumerate(PURPOSES))) for w in [*BOILER.get(name, CONTENT).split(), *(["main"] if name == "content" else [])]}
TAG_PURPOSE = {t: PURPOSES.index(t) for t in ("nav", "header", "footer", "aside", "form")} | {t: PURPOSES.index("content") for t in ("article", "main")}
IN_AT = N_TAGS + 11
HASH_AT = IN_AT + len(PURPOSES)
N_FEATURES = HASH_AT + HASHED
#: Parent-child potentials by kind of child: text, block, other.
N_KINDS = 3


@lru_cache(65536)
def _hash(word: str) -> int:
    h = 2166136261
    for c in word.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return HASH_AT + h % HASHED


@lru_cache(65536)
def _own(tag: str, words: tuple[str, ...]) -> tuple[int, ...]:
    return (BIAS, TAGS.get(tag, N_TAGS - 1), *sorted({_hash(w) for w in words}))


@lru_cache(65536)
def _purposes(tag: str, words: tuple[str, ...]) -> frozenset[int]:
    """Features of what the element is for; of a whole page's classes nothing follows."""
    if tag in ("html", "body"):
        return frozenset()
    return frozenset(IN_AT + k for k in [PURPOSE.get(w) for w in words] + [TAG_PURPOSE.get(tag)] if k is not None)


def features(nodes: list[Node]) -> tuple[list[int], list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """The nodes of the model (the root and all that have text), and their feature numbers, parents (among these) and kinds."""
    n = len(nodes)
    chars, linked = [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        x = nodes[i]
        if x.text is not None:
            chars[i] = len(x.text.strip())
        if x.tag == "a":
            linked[i] = chars[i]
        chars[x.parent] += chars[i]
        linked[x.parent] += linked[i]
    own, out, parent, kind = [], [], [], []
    place: list[int] = [0] * n
    around: list[frozenset[int]] = [frozenset()] * n
    free = max(1, chars[0] - linked[0])
    for i, x in enumerate(nodes):
        c = chars[i]
        if i:
            around[i] = around[x.parent]
            if x.text is None and not around[i].issuperset(mine := _purposes(x.tag, x.words)):
                around[i] = around[i] | mine
        if i and not c:
            continue
        place[i] = len(own)
        own.append(i)
        parent.append(place[x.parent] if i else -1)
        extra = [SHORT if c < 40 else MEDIUM if c < 200 else LONG, *around[i]]
        if linked[i] >= 0.8 * c:
            extra.append(LINKED)
        elif linked[i] >= 0.4 * c:
            extra.append(HALF_LINKED)
        if x.text is not None:
            extra.append(HAS_STOP if x.text.rstrip()[-1] in ".!?…\"”»" else NO_STOP)
            kind.append(0)
        else:
            kind.append(1 if x.tag in BLOCKS else 2)
            # how much of the page's text that is no link stands inside
            part = (c - linked[i]) / free
            extra.append(MOST if part >= 0.5 else SOME if part >= 0.15 else LITTLE)
        out.append(_own(x.tag, x.words) + tuple(extra))
    return own, out, np.array(parent), np.array(kind)


class Model:
    """weight: of each feature for the label content (against not); pair: [kind, parent label, child label]."""

    def __init__(self, weight: np.ndarray, pair: np.ndarray):
        self.weight, self.pair = weight, pair

    def marginals(self, feats: list[tuple[int, ...]], parent: np.ndarray, kind: np.ndarray) -> list[float]:
        """Content marginal of each node."""
        w = self.weight.tolist()
        e = np.exp(self.pair).tolist()
        up_list = parent.tolist()
        k_of = kind.tolist()
        n = len(up_list)
        # odds of content of each subtree, its messages normalised
        on = [0.0] * n
        exp = _exp
        own = [exp(sum([w[f] for f in fs])) for fs in feats]
        acc0, acc1 = [1.0] * n, [1.0] * n
        m0, m1 = [1.0] * n, [1.0] * n
        for i in range(n - 1, -1, -1):
            a, b = acc0[i], own[i] * acc1[i]
            s = a + b
            a, b = a / s, b / s
            acc0[i], acc1[i] = a, b
            p = up_list[i]
            if p >= 0:
                t = e[k_of[i]]
                x, y = t[0][0] * a + t[0][1] * b, t[1][0] * a + t[1][1] * b
                s = x + y
                m0[i], m1[i] = x / s, y / s
                acc0[p] *= m0[i]
                acc1[p] *= m1[i]
                s = acc0[p] + acc1[p]
                acc0[p] /= s
                acc1[p] /= s
        # downward: what the rest of the tree says about the parent, without this child
        for i in range(n):
            p = up_list[i]
            if p < 0:
                on[i] = acc1[i]
                continue
            c0, c1 = (1 - on[p]) / max(m0[i], 1e-300), on[p] / max(m1[i], 1e-300)
            t = e[k_of[i]]
            j = [c0 * t[0][0] * acc0[i], c0 * t[0][1] * acc1[i], c1 * t[1][0] * acc0[i], c1 * t[1][1] * acc1[i]]
            on[i] = (j[1] + j[3]) / (j[0] + j[1] + j[2] + j[3])
        return on


def _exp(x: float) -> float:
    return float(np.exp(min(max(x, -40.0), 40.0))) if not -40 < x < 40 else _E(x)


from math import exp as _E  # noqa: E402


class _Forest:
    """The trees of all pages, by depth, for message passing in whole levels: the same as Model.marginals."""

    def __init__(self, trees: list[tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]]):
        sizes = [len(feats) for feats, _, _ in trees]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.parent = np.concatenate([np.where(p < 0, -1, p + at) for (_, p, _), at in zip(trees, first, strict=True)])
        self.kind = np.concatenate([k for _, _, k in trees])
        every = [f for feats, _, _ in trees for f in feats]
        self.index = np.repeat(np.arange(len(every)), [len(f) for f in every])
        self.number = np.concatenate([np.array(f) for f in every])
        depth = np.zeros(len(every), np.int64)
        front = np.flatnonzero(self.parent >= 0)
        at = self.parent.copy()
        while len(front):
            depth[front] += 1
            at[front] = self.parent[at[front]]
            front = front[at[front] >= 0]
        self.levels = []
        for d in range(1, int(depth.max(initial=0)) + 1):
            nodes = np.flatnonzero(depth == d)
            self.levels.append((nodes, *np.unique(self.parent[nodes], return_inverse=True)))

    def marginals(self, weight: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.parent)
        state = np.zeros((2, n))
        state[1] = np.clip(np.bincount(self.index, weight[self.number], n), -40, 40)
        message = np.zeros((2, n))
        for nodes, above, inverse in reversed(self.levels):
            k = self.kind[nodes]
            for label in (0, 1):
                message[label, nodes] = np.logaddexp(pair[k, label, 0] + state[0, nodes], pair[k, label, 1] + state[1, nodes])
                state[label, above] += np.bincount(inverse, message[label, nodes])
        belief = state - np.logaddexp(state[0], state[1])
        joint = np.zeros((n, 2, 2))
        for nodes, _, _ in self.levels:
            k, p = self.kind[nodes], self.parent[nodes]
            j = (belief[:, p] - message[:, nodes]).T[:, :, None] + pair[k] + state[:, nodes].T[:, None, :]
            j = np.exp(j - j.max((1, 2), keepdims=True))
            joint[nodes] = j / j.sum((1, 2), keepdims=True)
            belief[:, nodes] = np.log(np.maximum(joint[nodes].sum(1).T, 1e-300))
        return np.exp(belief[1]), joint


def fit(pages: list[tuple[list[Node], list[int]]], rounds: int = 150, rate: float = 1.0) -> Model:
    """Gradient ascent (Adagrad) on the log-likelihood of labelled trees: nodes and the label of each."""
    trees, labels = [], []
    for nodes, label in pages:
        own, *rest = features(nodes)
        trees.append(tuple(rest))
        labels.append(np.array(label)[own])
    forest, label = _Forest(trees), np.concatenate(labels)
    child = forest.parent >= 0
    weight, pair = np.zeros(N_FEATURES), np.zeros((N_KINDS, 2, 2))
    seen_w, seen_p = np.full(N_FEATURES, 1e-6), np.full((N_KINDS, 2, 2), 1e-6)
    observed_w, observed_p = np.bincount(forest.number, label[forest.index], N_FEATURES), np.zeros((N_KINDS, 2, 2))
    np.add.at(observed_p, (forest.kind[child], label[forest.parent[child]], label[child]), 1)
    for _ in range(rounds):
        on, joint = forest.marginals(weight, pair)
        expected_p = np.stack([joint[child & (forest.kind == k)].sum(0) for k in range(N_KINDS)])
        gw = (observed_w - np.bincount(forest.number, on[forest.index], N_FEATURES)) / len(label) - 1e-5 * weight
        gp = (observed_p - expected_p) / len(label) - 1e-5 * pair
        seen_w += gw * gw
        seen_p += gp * gp
        weight = weight + rate * gw / np.sqrt(seen_w)
        pair = pair + rate * gp / np.sqrt(seen_p)
    return Model(weight, pair)


# --- labelled pages -------------------------------------------------------------------------------------

SYLLABLES = "an be co da en fi gra ho in ka lo mi nu or pa que ri so ta un ve wi xo ya zu the er tion".split()


def labelled_pages(n: int = 400, seed: int = 5) -> list[tuple[list[Node], list[int]]]:
    """Pages in random layouts, parsed, with the label of each node: whether it holds main text.

    Text that belongs to the article is marked by a character that no page has, which is taken out of
    the nodes again; an element is content if all of its text is, or more than two thirds of its runs are.
    """
    r = random.Random(seed)
    mark = "\ue000"

    def phrase(lo: int, hi: int, stop: bool) -> str:
        words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(lo, hi))]
        return " ".join(words).capitalize() + (r.choice(".!?") if stop else "")

    def named(words: str) -> str:
        """An attribute with one of the words, and maybe neutral ones."""
        some = [r.choice(words.split())]
        if r.random() < 0.4:
            some.insert(r.randint(0, 1), r.choice(NEUTRAL.split()))
        glue = r.choice(["-", "_", " ", "__", "--"])
        value = glue.join(some) if r.random() < 0.85 else some[0] + "".join(x.capitalize() for x in some[1:])
        return f' {r.choice(["class", "class", "class", "id"])}="{value}{r.choice(["", "", "", "-1", " x2"])}"'

    def links(k: int) -> str:
        inner = "".join(f'<li><a href="/x">{phrase(1, 3, False)}</a></li>' for _ in range(k))
        return f"<ul>{inner}</ul>" if r.random() < 0.8 else " | ".join(f'<a href="/x">{phrase(1, 2, False)}</a>' for _ in range(k))

    def boiler(name: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(name, r.choice(["div", "div", "section"]))
        plain = r.random() < 0.5
        tag = r.choice(["div", "div", "section", "ul" if name == "nav" else "div"]) if plain and tag != "form" else tag
        attr = named(BOILER[name]) if plain or tag in ("div", "section") or r.random() < 0.3 else ""
        if name == "nav":
            inner = "".join(f'<li><a href="/x">{phrase(1, 3, False)}</a></li>' for _ in range(r.randint(2, 9))) if tag == "ul" else links(r.randint(1, 9))
        elif name in ("aside", "share"):
            inner = r.choice([f"<h3>{phrase(1, 3, False)}</h3>", ""]) + r.choice([links(r.randint(2, 6)), links(2), phrase(2, 6, False)]) + r.choice(["", f"<p>{phrase(5, 15, True)}</p>"])
        elif name == "form":
            inner = f"<label>{phrase(1, 3, False)}</label><input type=text><button>{phrase(1, 2, False)}</button>" + r.choice(["", f"<p>{phrase(4, 12, True)}</p>"])
        elif name == "comments":
            each = r.choice(["div", "li", "article", "p"])
            inner = r.choice([f"<h3>{phrase(1, 2, False)}</h3>", ""])
            for _ in range(r.randint(1, 6)):
                said = " ".join(phrase(2, 20, True) for _ in range(r.randint(1, 4)))
                said = said if each == "p" else f"<p>{said}</p>" if r.random() < 0.7 else said
                inner += f"<{each}{r.choice(['', named('comment reply cmt response')])}>{r.choice(['', f'<b>{phrase(1, 2, False)}</b>', f'<span class=author>{phrase(1, 2, False)}</span>'])}{said}</{each}>"
        elif name == "header":
            inner = r.choice([f"<h1>{phrase(1, 3, False)}</h1>", f"<a href='/'>{phrase(1, 2, False)}</a>", f"<p>{phrase(2, 6, False)}</p>", phrase(1, 4, False)]) + r.choice(["", links(3)])
        elif name == "footer":
            inner = f"&copy; {phrase(1, 2, False)} {r.choice(['&middot; ', ''])}{phrase(2, 14, r.random() < 0.6)}" if r.random() < 0.6 else f"<p>{phrase(3, 14, True)}</p>" + r.choice(["", links(3)])
        else:
            inner = f"{phrase(2, 25, True)}" if r.random() < 0.5 else f"<p>{phrase(4, 25, True)}</p>" + r.choice(["", f"<button>{phrase(1, 2, False)}</button>", f"<a href='/p'>{phrase(1, 3, False)}</a>"])
        return f"<{tag}{attr}>{inner}</{tag}>"

    def article() -> str:
        title = f"<h1>{mark}{phrase(2, 9, r.random() < 0.4)}</h1>"
        if r.random() < 0.12:
            title = f"<header>{title}{r.choice(['', f'<p{named(BOILER["share"])}>{phrase(2, 6, False)}</p>'])}</header>"
        parts = [title] if r.random() < 0.65 else []
        plain = r.random() < 0.12
        count = r.choice([1, 1, 1, 2, 2, 3, 4, 5, 6, 8, 10])
        for k in range(count):
            x = r.random() if k else r.random() * 0.7
            text = " ".join(phrase(3, 18, True) for _ in range(r.randint(1, 5)))
            if r.random() < 0.15:
                text = phrase(1, 8, True)
            if plain:
                parts.append(r.choice([f"{mark}{text}<br>", f"{mark}{text}<br><br>", f"<div>{mark}{text}</div>"]))
            elif x < 0.62:
                if r.random() < 0.3:
                    tag = r.choice(["b", "i", "em", "strong", "a href=/y", "span"])
                    text = f"{phrase(2, 6, False)} <{tag}>{mark}{phrase(1, 4, False)}</{tag.split()[0]}> {mark}{phrase(3, 18, True)}"
                parts.append(f"<p>{mark}{text}" + r.choice(["</p>", "</p>", "", "<br>"]))
            elif x < 0.7:
                parts.append(f"<h{r.randint(2, 4)}>{mark}{phrase(1, 6, False)}</h2>".replace("</h2>", "</h3>") if r.random() < 0.1 else f"<h2>{mark}{phrase(1, 6, False)}</h2>")
            elif x < 0.77:
                item = lambda: r.choice([f"{mark}{phrase(2, 14, r.random() < 0.6)}", f"<p>{mark}{phrase(4, 14, True)}</p>"])
                parts.append("<ul>" + "".join(f"<li>{item()}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.82:
                parts.append(f"<blockquote>{mark}{text}</blockquote>" if r.random() < 0.5 else f"<blockquote><p>{mark}{text}</p></blockquote>")
            elif x < 0.87:
                cell = r.choice(["td", "td", "th"])
                parts.append("<table>" + "".join("<tr>" + "".join(f"<{cell}>{mark}{phrase(1, 3, False)}</{cell}>" for _ in range(r.randint(1, 4))) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif x < 0.9:
                parts.append(f"<pre>{mark}{phrase(3, 12, False)}</pre>")
            elif x < 0.93:
                parts.append(f"<figure><img src=x><figcaption>{mark}{phrase(2, 9, True)}</figcaption></figure>")
            elif x < 0.95:
                parts.append(f"<p><b>{mark}{text}<br>")
            else:
                parts.append(boiler(r.choice(["ad", "share", "aside", "form", "notice", "nav"])))
        if r.random() < 0.1:
            parts.append(boiler("comments"))
        return "".join(parts)

    def wrapped(body: str) -> str:
        for _ in range(r.choice([0, 0, 0, 1, 1, 2, 3])):
            tag = r.choice(["div", "div", "div", "section", "main"])
            body = f"<{tag}{r.choice(['', named(NEUTRAL), named(NEUTRAL), named(CONTENT)])}>{body}</{tag}>"
        return body

    pages = []
    for _ in range(n):
        x = r.random()
        if x < 0.34:
            body = f"<article{r.choice(['', '', named(CONTENT)])}>{article()}</article>"
        elif x < 0.46:
            body = f"<main{r.choice(['', '', named(CONTENT)])}>{article()}</main>"
        elif x < 0.78:
            body = f"<div{named(CONTENT)}>{article()}</div>"
        elif x < 0.83:
            body = f"<table><tr><td{r.choice(['', named(CONTENT)])}>{article()}</td></tr></table>"
        elif x < 0.92:
            body = f"<div{r.choice(['', named(NEUTRAL)])}>{article()}</div>"
        elif x < 0.96:
            body = f"<section>{article()}</section>"
        else:
            body = article()
        many = r.choice([0.25, 0.5, 0.7])
        if r.random() < 0.15:
            # the article and what is beside it in one box
            body = f"<div{named(NEUTRAL + ' ' + CONTENT)}>{body}{''.join(boiler(k) for k in ('aside', 'comments', 'share') if r.random() < 0.6)}</div>"
        body = wrapped(body)
        before = [boiler(k) for k in ("header", "nav", "notice", "ad") if r.random() < many]
        after = [boiler(k) for k in ("comments", "aside", "share", "form", "ad", "footer") if r.random() < many]
        r.shuffle(before)
        if r.random() < 0.2:
            before, after = before + after[:1], after[1:]
        page = wrapped(f"{''.join(before)}{body}{''.join(after)}")
        if r.random() < 0.75:
            page = f"<!DOCTYPE html><html><head><title>{phrase(2, 6, False)}</title></head><body{r.choice(['', '', named(CONTENT + ' ' + NEUTRAL)])}>{page}</body></html>"
        nodes = parse(page)
        label = [0] * len(nodes)
        good, bad = [0] * len(nodes), [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            node = nodes[i]
            if node.text is not None:
                if node.text.strip():
                    good[i], bad[i] = (1, 0) if mark in node.text else (0, 1)
                node.text = node.text.replace(mark, "")
            label[i] = int(good[i] > 2 * bad[i])
            if i:
                good[node.parent] += good[i]
                bad[node.parent] += bad[i]
        pages.append((nodes, label))
    return pages


# --- extraction -----------------------------------------------------------------------------------------


def main_text(page: str, model: Model) -> str:
    """The blocks of content in page order, joined by a line feed."""
    nodes = parse(page)
    own, feats, parent, kind = features(nodes)
    on = [0.0] * len(nodes)
    for i, p in zip(own, model.marginals(feats, parent, kind), strict=True):
        on[i] = p
    hidden = [False] * len(nodes)
    block = [0] * len(nodes)
    out: list[str] = []
    buffer: list[str] = []
    last = -1

    def flush() -> None:
        text = SPACE.sub(" ", "".join(buffer)).strip()
        if text:
            out.append(text)
        buffer.clear()

    for i, x in enumerate(nodes):
        if i:
            hidden[i] = hidden[x.parent] or x.tag in HIDDEN
            block[i] = i if x.tag in BLOCKS else block[x.parent]
        if hidden[i]:
            continue
        if x.tag == "br":
            buffer.append(" ")
        if block[i] != last:
            flush()
            last = block[i]
        if x.text is not None and (on[i] >= 0.5 or not x.text.strip()):
            buffer.append(x.text)
    flush()
    return "\n".join(out)


@lru_cache(1)
def default_model() -> Model:
    return fit(labelled_pages())


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """id, url, text and n_chars of every row of pages.

    The whole page is read; null and empty pages have the empty text, as has a page without content. Rows
    repeated are rows of their own, and equal pages give equal texts. Other columns are left aside, whatever
    their names; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model or default_model())
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "url")]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x.as_py() or "", shared.value) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["id", "url", "text", "n_chars"])

    return rows.mapInArrow(extract, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
