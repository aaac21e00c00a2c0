"""Main text of web pages by a tree-structured graphical model.

The block elements of a page and its stretches of text are the nodes of a tree. Every node has a label, content or
not; its features give a potential for each label, and each parent and child share a pairwise potential. A text's
features are its length, links, punctuation, the nearest telling tag above it, words that boilerplate is made of, and whether it stands before, among or
after the page's long paragraphs; an element's are its tag, the words of its class, id and role, and how much prose,
links and share of the page's prose it holds, so that layouts without telling tags and names are read, too. Sum-product
messages go from the leaves to the root and back, for many pages at once, level by level (very deep pages node by
node); a stretch of text whose content marginal is over one half is kept. The potentials are learned from labelled
pages. Reading and messages take time in proportion to the page's length, however deep it is.

Defined cases: null or empty html gives an empty text; markup that never ends is read to the end of the page; text
outside of any element counts as a block of the root; repeated rows are treated alike; other columns pass through
and input columns named `text` or `n_chars` are replaced.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from math import exp, log1p

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of HTML elements.
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption header footer nav "
    "aside form fieldset figure figcaption blockquote pre address details summary dialog menu hr center hgroup search label legend".split()
)
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video map head title textarea select option button datalist".split())
RAW = frozenset("script style textarea title iframe noscript template svg math select button object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Elements whose tag tells what they hold.
TELLING = frozenset("article main nav aside footer header form".split())
#: Words of which a short text's presence is a feature.
CUES = frozenset(
    "copyright rights reserved cookie cookies privacy policy terms subscribe newsletter share tweet facebook twitter login log sign signup advertisement "
    "sponsored comments comment reply related menu search home contact about next previous read more follow email posted says tags skip accept powered".split()
)

#: A quoted value ends at its quote, however far that is; where there is none, the tag ends at the first >.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^>"'<]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/><]*)([^>]*+)>|</?[a-zA-Z][^>]*\Z""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_TOLD = re.compile(r"class|id|role|hidden|style|data-content", re.I)
_WORD = re.compile(r"[a-z]+")
LONG, DEEP = 100, 300


class Tree:
    """Nodes of one page: parent and features of each, the text of those that are text, its length and linked length."""

    def __init__(self):
        self.parent, self.features, self.text, self.mark = [-1], [["root"]], [None], [None]
        self.size, self.linked = [0], [0]

    def add(self, parent: int, features: list[str], text: str | None = None, mark: str | None = None, linked: int = 0) -> int:
        self.parent.append(parent)
        self.features.append(features)
        self.text.append(text)
        self.mark.append(mark)
        self.size.append(len(text) if text is not None else 0)
        self.linked.append(linked)
        return len(self.parent) - 1

    def finish(self) -> Tree:
        """Adds the features that need the whole page."""
        n, text = len(self.parent), self.text
        prose = [0] * n  # code points of texts that end like a sentence and are not links
        many = [i for i in range(1, n) if text[i] is not None and 3 * self.linked[i] < self.size[i] and (self.size[i] >= LONG or self.size[i] >= LONG // 2 and text[i][-1] in ".!?…。")]
        first, last = (many[0], many[-1]) if many else (n, n)
        size, linked = list(self.size), list(self.linked)
        for i in range(1, n):
            if text[i] is not None:
                plain, end = self.size[i] - self.linked[i], text[i][-1:] in ".!?…。:"
                prose[i] = plain if end or plain >= LONG else 0
                b, k = _bucket(self.size[i]), _part(self.linked[i], self.size[i])
                place = "before" if i < first else "after" if i > last else "among"
                self.features[i] += [f"len:{b}", f"link:{k}", f"end:{end}", f"len:{b}/end:{end}", f"len:{b}/link:{k}", f"at:{place}", f"{self.features[i][1]}/{place}"]
                if self.size[i] < 200:
                    self.features[i] += [f"cue:{w}" for w in CUES.intersection(_WORD.findall(text[i].lower()))]
                    if "©" in text[i]:
                        self.features[i].append("cue:copyright")
        for i in range(n - 1, 0, -1):  # children come after their parents
            p = self.parent[i]
            size[p] += size[i]
            linked[p] += linked[i]
            prose[p] += prose[i]
        for i in range(1, n):
            if text[i] is None:
                self.features[i] += [f"holds:{_bucket(size[i])}", f"links:{_part(linked[i], size[i])}", f"prose:{_part(prose[i], size[i])}", f"part:{_part(prose[i], prose[0])}"]
        return self


def _bucket(n: int) -> int:
    return min(9, n.bit_length() - 2 if n > 3 else 0)


def _part(a: int, b: int) -> int:
    """0 for none, 5 for all, 1 to 4 for the quarters between."""
    return 0 if not a or not b else 5 if a >= b else 1 + 4 * a // b


def parse(page: str) -> Tree:
    """The tree of a page. Inline markup belongs to the text around it, a block element ends the text before it."""
    tree, open_, under, count, buffer = Tree(), [("root", 0)], ["root"], Counter(), []
    linked = anchors = at = 0
    outer = lambda tag: "body" if tag in ("root", "html") else tag  # noqa: E731 - a fragment reads like a page

    def flush():
        nonlocal linked
        if buffer:
            raw = "".join(buffer)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                tree.add(open_[-1][1], ["text", f"under:{under[-1]}", f"in:{outer(open_[-1][0])}"], text, linked=min(linked, len(text)))
            buffer.clear()
        linked = 0

    def close():
        tag = open_.pop()[0]
        count[tag] -= 1
        if tag in TELLING:
            under.pop()

    while True:
        found = _TOKEN.search(page, at)
        piece = page[at : found.start()] if found else page[at:]
        if piece:
            buffer.append(piece)
            if anchors:
                linked += len(piece)
        if not found:
            break
        at = found.end()
        slash, name, rest = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if name is None:
            continue
        name = name.lower()
        if slash:
            if name == "a":
                anchors = max(0, anchors - 1)
            elif count[name] and name in BLOCKS:
                flush()
                while open_[-1][0] != name:
                    close()
                close()
            continue
        if name in HIDDEN:
            if name in RAW and not rest.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            buffer.append(" ")
            continue
        if name == "a":
            anchors += 1
        elif name in BLOCKS:
            flush()
            anchors = 0
            ends, stops = CLOSES.get(name, ()), STOPS.get(name)
            while len(open_) > 1:
                inner = open_[-1][0]
                if inner != "p" and inner not in ends and (stops is None or inner in stops or not any(count[t] for t in ends)):
                    break
                close()
            features, mark = [f"tag:{name}", f"up:{outer(open_[-1][0])}"], None
            if rest and _TOLD.search(rest):
                for a in _ATTRIBUTE.finditer(rest):
                    key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                    if key == "data-content":
                        mark = value
                    elif key == "hidden" or key == "style" and "display:none" in value.replace(" ", ""):
                        features.append("is:hidden")
                    elif key in ("class", "id", "role"):
                        features += [f"word:{w}" for w in _WORD.findall(value)]
                features = [*dict.fromkeys(features)]
            node = tree.add(open_[-1][1], features, mark=mark)
            if name not in VOID:
                open_.append((name, node))
                count[name] += 1
                if name in TELLING:
                    under.append(name)
        elif name in VOID:
            buffer.append(" ")
    flush()
    return tree.finish()


def true_labels(tree: Tree) -> list[int]:
    """Labels of a marked page: of texts by the nearest mark above them, of elements by what most of their text is."""
    n = len(tree.parent)
    mark, good, size = [0] * n, [0] * n, [0] * n
    for i in range(1, n):
        mark[i] = int(tree.mark[i] == "1") if tree.mark[i] else mark[tree.parent[i]]
    for i in range(n - 1, 0, -1):
        if tree.text[i] is not None:
            size[i], good[i] = tree.size[i], mark[i] * tree.size[i]
        size[tree.parent[i]] += size[i]
        good[tree.parent[i]] += good[i]
    return [int(2 * good[i] >= size[i]) if size[i] else mark[i] for i in range(n)]


class TreeModel:
    """Log potentials: of parent and child counted over labelled pages, for texts and for elements, of the features fitted
    by gradient ascent on the pages' likelihood, whose gradient is the difference between labels and content marginals."""

    def __init__(self, pages: list[str], steps: int = 220, rate: float = 0.3, ridge: float = 2e-4, smooth: float = 5.0):
        trees, labels, pair = [parse(p) for p in pages], [], np.full((2, 2, 2), smooth)
        for tree in trees:
            label = true_labels(tree)
            for i in range(1, len(label)):
                pair[int(tree.text[i] is not None), label[tree.parent[i]], label[i]] += 1
            labels += label
        self.pair, self.weight = np.log(pair / pair.sum(2, keepdims=True)), {}
        names = {f: k for k, f in enumerate(sorted({f for t in trees for fs in t.features for f in fs}))}
        node = np.repeat(np.arange(len(labels)), [len(fs) for t in trees for fs in t.features])
        feature = np.array([names[f] for t in trees for fs in t.features for f in fs], int)
        y, weight, squares = np.array(labels, float), np.zeros(len(names)), np.full(len(names), 1e-6)
        forest = _Forest(trees)
        for _ in range(steps):
            p = forest.marginals(np.bincount(node, weight[feature], minlength=len(y)), self.pair)
            slope = np.bincount(feature, (y - p)[node], minlength=len(names)) - ridge * len(trees) * weight
            squares += slope**2
            weight += rate * slope / np.sqrt(squares)
        self.weight = dict(zip(names, weight.tolist(), strict=True))

    def marginals(self, trees: list[Tree]) -> list[np.ndarray]:
        """Content marginal of every node of every tree."""
        forest, weight = _Forest(trees), self.weight
        p = forest.marginals(np.array([sum(weight.get(f, 0.0) for f in fs) for t in trees for fs in t.features]), self.pair)
        return [p[a:b] for a, b in zip(forest.base, forest.base[1:], strict=False)]

    def extract(self, pages: list[str]) -> list[str]:
        trees = [parse(p) for p in pages]
        return ["\n\n".join(x for x, p in zip(t.text, m, strict=True) if x is not None and p > 0.5) for t, m in zip(trees, self.marginals(trees), strict=True)]


class _Forest:
    """The nodes of many trees: by level, over which messages are passed, and those of very deep trees by themselves."""

    def __init__(self, trees: list[Tree]):
        self.base = np.cumsum([0, *(len(t.parent) for t in trees)])
        depth = np.zeros(self.base[-1], np.int32)
        self.parent = np.zeros(len(depth), np.int64)
        self.kind = np.zeros(len(depth), np.int64)
        self.deep: list[tuple[int, Tree]] = []
        for t, b in zip(trees, self.base, strict=False):
            d = [0] * len(t.parent)
            for i in range(1, len(d)):
                d[i] = d[t.parent[i]] + 1
            if max(d) > DEEP:
                self.deep.append((int(b), t))
                d = [0] * len(d)
            depth[b : b + len(d)] = d
            self.parent[b : b + len(d)] = np.maximum(t.parent, 0) + b
            self.kind[b : b + len(d)] = [x is not None for x in t.text]
        order = np.argsort(depth, kind="stable")
        cut = np.searchsorted(depth[order], np.arange(int(depth.max(initial=0)) + 2))
        self.levels = [order[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def marginals(self, odds: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Sum-product: messages from the leaves to the roots, then back. odds: log potential of content against not;
        pair: [kind of child, parent's label, child's label]."""
        up = np.zeros((len(odds), 2))
        up[:, 1] = odds
        sent, parent = np.zeros_like(up), self.parent
        for nodes in self.levels[:0:-1]:
            x, m = up[nodes], pair[self.kind[nodes]]
            sent[nodes] = np.logaddexp(m[:, :, 0] + x[:, 0, None], m[:, :, 1] + x[:, 1, None])
            for k in (0, 1):
                np.add.at(up[:, k], parent[nodes], sent[nodes, k])
        for nodes in self.levels[1:]:
            above, m = up[parent[nodes]] - sent[nodes], pair[self.kind[nodes]]
            above -= above.max(1, keepdims=True)
            up[nodes] += np.logaddexp(m[:, 0, :] + above[:, 0, None], m[:, 1, :] + above[:, 1, None])
        for b, tree in self.deep:
            up[b : b + len(tree.parent)] = _deep(tree, odds[b : b + len(tree.parent)].tolist(), pair.tolist())
        return 1 / (1 + np.exp(np.clip(up[:, 0] - up[:, 1], -500, 500)))


def _deep(tree: Tree, odds: list[float], pair: list) -> list[tuple[float, float]]:
    """The same messages node by node, in the order of the page. Two labels: a message is kept as the log odds of content."""
    n, parent = len(odds), tree.parent
    kind = [int(x is not None) for x in tree.text]
    soft = lambda x: x + log1p(exp(-x)) if x > 0 else log1p(exp(x))
    # with odds x below, the message's odds are log of (p10 + p11 e^x) / (p00 + p01 e^x)
    def message(k: int, x: float, down: bool) -> float:
        m = pair[k]
        a, b, c, d = (m[0][0], m[1][0], m[0][1], m[1][1]) if down else (m[0][0], m[0][1], m[1][0], m[1][1])
        return (c + soft(x + d - c)) - (a + soft(x + b - a))

    up, sent = list(odds), [0.0] * n
    for i in range(n - 1, 0, -1):
        sent[i] = message(kind[i], up[i], False)
        up[parent[i]] += sent[i]
    for i in range(1, n):
        up[i] += message(kind[i], up[parent[i]] - sent[i], True)
    return [(0.0, x) for x in up]


#: Names that page authors give to boxes beside the article, and to the article's own box.
ASIDE = (
    "ad ads advert advertisement banner promo sponsored sponsor sidebar rail widget related recommended more share social follow newsletter subscribe signup cookie "
    "consent gdpr notice alert popup modal overlay comments comment reply respond disqus discussion breadcrumb breadcrumbs pagination pager menu navbar navigation "
    "topbar masthead footer copyright legal disclaimer search login author tags meta byline toolbar skip trending popular outbrain taboola feedback rating"
).split()
MAIN = "content article post entry story body main text page prose markdown".split()
NEUTRAL = "row col box c1 c2 x inner outer wrap container left right top block item cell panel grid flex b1 css layout module".split()
#: What boilerplate says.
SAYINGS = {
    "notice": ("We use cookies to improve your experience.", "By continuing to browse you accept our use of cookies.", "Accept cookies", "Read our privacy policy and terms.", "This site needs your consent."),
    "share": ("Share this on Facebook", "Share this article", "Tweet", "Share", "Follow us on Twitter", "Email this to a friend", "Share on Facebook Twitter Email"),
    "sign": ("Subscribe to our newsletter", "Sign up for our weekly email.", "Log in", "Get the latest posted to you. Subscribe now!", "Sign up to read more."),
    "foot": ("Copyright {} Example. All rights reserved.", "© {} Example", "All rights reserved.", "Terms of use. Privacy policy.", "Powered by Example", "© {} Example Media. Contact us. About us."),
    "advert": ("Advertisement", "Sponsored", "Sponsored content. Read more.", "Advertisement. Buy now!"),
    "related": ("Related", "Read more", "Related posts", "More from this site", "Next", "Previous", "Tags"),
    "comments": ("Comments", "3 comments", "Reply", "Leave a reply", "Ann says: I liked it.", "Posted by Bob: no, this is wrong!", "Great article, thanks."),
}


def labelled_pages(n: int = 900, seed: int = 11) -> list[str]:
    """Pages of many layouts whose elements carry data-content="1" or "0": what the model learns from. Some layouts have
    telling tags and names, others are plain boxes, tables or bare text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("an", "be", "co", "di", "en", "fo", "ri", "ta", "us", "le")) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a=4, b=18: f"{words(a, b).capitalize()}{rng.choice('....!?')}"
    prose = lambda a=1, b=5: " ".join(sentence() for _ in range(rng.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{rng.choice((words(1, 3), "Home", "About us", "Contact", "News", "Next", "Read more"))}</a>'
    say = lambda kind: rng.choice(SAYINGS[kind]).format(rng.randint(1998, 2026))
    rows = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8))) + "</ul>"
    line = lambda: rng.choice((" | ", " ", " &middot; ", "<br>")).join(link() for _ in range(rng.randint(2, 7)))
    links = lambda: rng.choice((rows, rows, line, lambda: "".join(f"<div>{link()}</div>" for _ in range(rng.randint(2, 6)))))()
    named = lambda names: rng.choice((f'class="{rng.choice(names)}"', f'id="{rng.choice(names)}"', f'class="{rng.choice(names)}-{rng.choice(NEUTRAL)}"', f'class="{rng.choice(NEUTRAL)} {rng.choice(names)}"'))
    plain = lambda: rng.choice(("", "", named(NEUTRAL), f'class="{word()}"'))
    listing = lambda: f"<{(h := rng.choice(('h3', 'h4', 'p', 'b')))}>{rng.choice((words(1, 4), say('related')))}</{h}>{links()}"

    def comments() -> str:
        one = lambda: rng.choice((prose(1, 3), say("comments"), f"{word().capitalize()} says: {prose(1, 2)}"))
        return f"<h3>{rng.choice(('Comments', '2 comments', 'Leave a reply', words(1, 2)))}</h3>" + "".join(f"<div>{rng.choice(('<p>{}</p>', '{}'))}</div>".format(one()) for _ in range(rng.randint(1, 4)))

    def boilerplate() -> str:
        """What stands in a box beside the article, with nothing said of it by tag or name."""
        return rng.choice((
            links, links, listing, lambda: say("notice"), lambda: say("share"), lambda: say("share") + " " + line(), lambda: say("sign"), lambda: say("foot"),
            lambda: f"<p>{say('foot')}</p>{line()}", lambda: say("advert"), lambda: f"{say('advert')} {sentence()}",
        ))()

    def beside(telling: bool) -> str:
        tag = rng.choice(("div", "div", "div", "section", "aside", "p"))
        if not telling:
            tag = "div" if tag == "aside" else tag
            return f'<{tag} {plain()} data-content="0">{boilerplate()}</{tag}>'
        inner = rng.choice((links, boilerplate, boilerplate, lambda: prose(1, 3), lambda: f"<p>{prose(1, 4)}</p>", lambda: f"<p>{sentence()} {link()}</p>"))()
        kind = rng.randrange(13)
        if kind == 12:
            return f'<div {named(("ad", "ads", "advert", "banner", "promo"))} data-content="0">{rng.choice((sentence(6, 30), prose(1, 3), say("advert")))}</div>'
        if kind == 0:
            return f'<nav data-content="0">{links()}</nav>'
        if kind == 1:
            return f'<footer data-content="0">&copy; {word()} &middot; {rng.choice((sentence(), link(), f"<p>{prose(1, 2)}</p>", say("foot")))}</footer>'
        if kind == 2:
            return f'<header data-content="0">{rng.choice((links(), f"<h2>{words(1, 4)}</h2>", f"<p>{sentence()}</p>{link()}", words(1, 5), f"<h1>{words(1, 4)}</h1>", f"<h1>{words(1, 4)}</h1><p>{sentence()}</p>"))}</header>'
        if kind == 3:
            return f'<form data-content="0"><label>{words(1, 3)}</label><input name="q"><p>{rng.choice((sentence(), say("sign")))}</p><button>{word()}</button></form>'
        if kind == 4:
            box = rng.choice(("comments", "comment", "comment-list", "responses", "discussion"))
            item = rng.choice((("li", "ul"), ("div", "div"), ("article", "section")))
            many = "".join(f'<{item[0]} class="comment"><p>{prose(1, 4)}</p></{item[0]}>' for _ in range(rng.randint(1, 5)))
            return f'<{item[1]} {rng.choice(("class", "id"))}="{box}" data-content="0">{rng.choice(("", f"<h3>{words(1, 2)}</h3>"))}{many}</{item[1]}>'
        if kind == 5:
            return f'<aside data-content="0">{inner}</aside>'
        if kind == 6:
            return f'<div {named(("comments", "discussion", "responses"))} data-content="0">{comments()}</div>'
        if kind == 7:
            return f'<div {rng.choice(("hidden", "style=" + chr(34) + "display: none" + chr(34)))} data-content="0">{prose(1, 3)}</div>'
        return f'<{"div" if tag == "p" else tag} {named(ASIDE)} data-content="0">{inner}</{"div" if tag == "p" else tag}>'

    def block() -> str:
        kind = rng.randrange(15)
        if kind == 0:
            return f"<h{rng.randint(2, 4)}>{words(1, 8)}</h2>"
        if kind == 1:
            return "<ul>" + "".join(f"<li>{rng.choice((prose(1, 2), words(1, 6), sentence()))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind == 2:
            return f"<blockquote><p>{prose()}</p></blockquote>"
        if kind == 3:
            return f"<pre>{words(3, 30)}</pre>"
        if kind == 4:
            return f"<table><tr><th>{word()}</th><td>{words(1, 4)}</td></tr><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>"
        if kind == 5:
            return f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>"
        if kind == 6:
            return f"<p>{sentence()} {link()} {prose(1, 3)}</p>"
        if kind == 7:
            return f"<p>{words(1, 3).capitalize()}.</p>"
        if kind == 8:
            return f"<p>{words(4, 40)}</p>"
        if kind == 9:
            return f"<div>{prose()}</div>"
        if kind == 10:
            return f"{prose(2, 6)}<br><br>{prose(1, 4)}"
        return f"<p>{prose(1, 6)}</p>"

    pages = []
    for _ in range(n):
        layout = rng.choice(("telling", "telling", "telling", "boxes", "boxes", "table", "bare"))
        telling = layout == "telling"
        title = f"<h{(k := rng.choice((1, 1, 1, 2)))}>{words(2, 12)}</h{k}>"
        body = [block() for _ in range(rng.choice((rng.randint(0, 2), rng.randint(1, 14), rng.randint(1, 14))))]
        if telling and rng.random() < 0.3:  # an article may end with its licence, or say what boilerplate says
            body.insert(rng.choice((rng.randint(0, len(body)), len(body))), f"<p>{say(rng.choice(('foot', 'foot', *SAYINGS)))}</p>")
        if not telling and rng.random() < 0.9:  # without names the article is known by its prose
            body.insert(0, f"<p>{prose(3, 7)}</p>")
        for _ in range(rng.choice((0, 0, 1, 2))):
            body.insert(rng.randint(0, len(body)), beside(telling or rng.random() < 0.4))
        some = lambda a, b: "".join(beside(telling and rng.random() < 0.8 or rng.random() < 0.15) for _ in range(rng.randint(a, b)))
        inside = "".join(body)
        if layout in ("boxes", "table") and rng.random() < 0.4:  # paragraphs that are boxes, too
            box = f"<div {plain()}>"
            inside = f'{box}{inside.replace("<p>", box).replace("</p>", "</div>")}</div>'
        inside = title + inside
        if telling:
            tag, name = rng.choice((("article", ""), ("article", named(MAIN)), ("main", ""), ("div", named(MAIN)), ("section", named(MAIN)), ("div", 'role="main"')))
            inner = f'<{tag} {name} data-content="1">{inside}</{tag}>'
            if rng.random() < 0.4:
                inner = f'<{rng.choice(("div", "main"))} {rng.choice(("", named(NEUTRAL)))} data-content="0">{some(0, 2)}{inner}{some(0, 2)}</div>'
            page = f'{some(1, 4)}{inner}{some(1, 4)}'
        elif layout == "boxes":
            inner = f'<div {plain()} data-content="1">{inside}</div>'
            for _ in range(rng.choice((0, 1, 1, 2))):
                inner = f'<div {plain()} data-content="0">{some(0, 1)}{inner}{some(0, 2)}</div>'
            page = f'{some(0, 3)}{inner}{some(0, 3)}'
        elif layout == "table":
            side = lambda: "".join(f'<td {rng.choice(("", "width=120"))} data-content="0">{boilerplate()}</td>' for _ in range(rng.choice((0, 1, 1))))
            top = f'<tr><td data-content="0">{rng.choice((links(), words(1, 4)))}</td></tr>' if rng.random() < 0.5 else ""
            foot = f'<tr><td data-content="0">{rng.choice((say("foot"), line()))}</td></tr>' if rng.random() < 0.6 else ""
            page = f'<table data-content="0">{top}<tr>{side()}<td data-content="1">{inside}</td>{side()}</tr>{foot}</table>'
        else:
            inner = inside
            page = f'{some(0, 2)}{inner}{rng.choice(("", "<hr>"))}{some(0, 2)}'
        bare = int(layout == "bare")
        whole = f'<body {rng.choice(("", plain()))} data-content="{bare}">{page}</body>'
        pages.append(page if not bare and rng.random() < 0.2 else rng.choice((whole, f'<html><head><title>{words(1, 5)}</title></head>{whole}</html>')))
    return pages


@functools.cache
def standard_model() -> TreeModel:
    """The model of the labelled pages, fitted once a driver process."""
    return TreeModel(labelled_pages())


def extract_main_text(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """Adds text (main text, empty if none) and n_chars (its code points) and leaves out the html."""
    shipped = pages.sparkSession.sparkContext.broadcast(model or standard_model())
    kept = [f for f in pages.schema if f.name not in ("html", "text", "n_chars")]

    def run(frames):
        for pdf in frames:
            text = shipped.value.extract(pdf["html"].tolist())
            yield pdf[[f.name for f in kept]].assign(text=text, n_chars=[len(x) for x in text])

    slim = pages.select(*(f.name for f in kept), F.coalesce("html", F.lit("")).alias("html"))
    return slim.mapInPandas(run, T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
