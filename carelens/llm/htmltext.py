"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks (runs of text between block-level tags) that carry their ancestor
tags and class / id words. Each block's features (ancestors, own tag, link share, length, shares of
frequent words and of words that notices are made of, punctuation, place, the neighbours' length and
links) give an emission score, neighbouring labels a transition score; Viterbi decodes the page and
the blocks labelled as content are the text.

The field is trained here, on the driver, on ``TRAIN_PAGES`` labelled pages that ``labelled_page``
composes (fixed seed): the supplied tables hold no page labels, so layouts with known labels are
made: menus, headers, footers, sidebars, notices, adverts, forms and reader comments in many
wrappings, around or inside articles that are marked up as such, only by class words, or not at all.

Defined results: null html is the empty page (text ''); a page without content blocks gives '';
the head ends at its end tag or at the first text or element that may not stand in it, other
unseen elements at their end tag or that of an element around them, but script, style, title and
textarea at their own end tag only; null ids and repeated rows give a row each; other columns
take no part.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 700
TRAIN_SEED = 11
TRAIN_STEPS = 240

# ---- fixed values: HTML element kinds (public HTML standard) -----------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr img label".split())
# no markup inside; they run to their own end tag
RAW = ("script", "style", "title", "textarea")
# unseen to their end tag or that of an element around them
UNSEEN = frozenset(
    "noscript template iframe object svg math select canvas audio video".split())
# what may stand in the head; anything else ends it, as </head> may be left out
IN_HEAD = frozenset("base link meta noscript script style template title".split())
# an opening tag of these closes an open element of the same row
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
            "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WRAPPERS = frozenset("article aside body div footer form header main nav section".split())
SIBLING_SCOPE = frozenset(("ul", "ol", "dl", "table", "menu"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)", re.I | re.S)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    """A leaf block: its text, the marks (tags, class words) of all ancestors, those of the
    innermost wrapping ancestor, the nearest block tag and the share of linked text."""
    __slots__ = ("text", "marks", "near", "own", "linked")

    def __init__(self, text, marks, near, own, linked):
        self.text, self.marks, self.near, self.own, self.linked = text, marks, near, own, linked


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of ``page`` in page order, texts decoded and white space made single."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links = [0]
    hidden: list[str] = []      # the open unseen element and the elements open inside it

    def flush():
        text = " ".join("".join(parts).split())
        if text:
            marks = frozenset(m for tag, words in stack if tag not in INLINE
                              for m in (f"<{tag}", *words))
            own = next((t for t, _ in reversed(stack) if t not in INLINE), "")
            near = next(((f"<{t}", *w) for t, w in reversed(stack)
                         if t not in INLINE and (w or t in WRAPPERS)), ())
            out.append(Block(text, marks, near, own, min(1.0, links[0] / len(text))))
        parts.clear()
        links[0] = 0

    def say(raw):
        if raw and not hidden:
            if stack and stack[-1][0] == "head" and raw.strip():
                stack.pop()
            text = htmllib.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if any(t == "a" for t, _ in stack):
                links[0] += len(" ".join(text.split()))

    at = 0
    for m in _TOKEN.finditer(page):
        say(page[at:m.start()])
        at = m.end()
        name = m.group(3) or m.group(6)
        if not name:
            if m.group(1) and m.group(1).lower() == "textarea" and not hidden:
                flush()
            continue
        tag = name.lower()
        attrs = m.group(4) or m.group(7) or ""
        closed = attrs.rstrip().endswith("/")
        if m.group(2) or m.group(5):
            if tag in hidden:
                while hidden.pop() != tag:
                    pass
                continue
            if hidden:
                if all(t != tag for t, _ in stack):
                    continue
                hidden.clear()
            if tag not in INLINE:
                flush()
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag == "body":
            hidden.clear()
        if stack and stack[-1][0] == "head" and not hidden and tag not in IN_HEAD:
            stack.pop()
        if hidden or tag in UNSEEN:
            if tag == "select" and not hidden:
                flush()
            if tag not in VOID and not closed:
                hidden.append(tag)
            continue
        if tag in INLINE:
            if tag not in VOID:
                stack.append((tag, ()))
            continue
        if tag == "br":
            parts.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if any(t == "p" for t, _ in stack):
            while stack.pop()[0] != "p":
                pass
        if tag in SIBLINGS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SIBLING_SCOPE:
                    break
                if stack[k][0] in SIBLINGS[tag]:
                    del stack[k:]
                    break
        words = tuple("." + w.lower() for a in _ATTR.findall(attrs) for w in
                      _WORD.findall(" ".join(a))) if "=" in attrs else ()
        if not closed or tag in ("p", "div"):
            stack.append((tag, words))
    say(page[at:])
    flush()
    return out


# ---- fixed values: frequent words of running text, and words that notices, footers and calls to
# act are made of, in four languages
STOP = frozenset(
    "the of and to in is that for it as was with be by on not he this are or his from at which but "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es an "
    "le la les de et des en un une du est pour que qui dans sur pas au avec ce il "
    "el los las y del se por con para una no su al lo como".split())
STOCK = frozenset(
    "cookie cookies consent accept subscribe newsletter advertisement sponsored copyright privacy "
    "imprint rights reserved login register password share follow related comments reply "
    "datenschutz impressum zustimmen akzeptieren abonnieren anzeige werbung anmelden rechte "
    "confidentialité accepter abonner publicité connexion mentions droits "
    "privacidad aceptar suscribirse publicidad derechos contacto aviso".split())


def _text_features(b: Block) -> tuple[str, str, str, str]:
    """Length, share of linked text, share of frequent words and stock words of a block."""
    words = b.text.lower().split()
    held = sum(w.strip(".,;:!?()\"'") in STOP for w in words[:200]) / min(len(words), 200)
    stock = sum(w.strip(".,;:!?()\"'©") in STOCK for w in words[:60])
    return ("%d" % min(5, len(words).bit_length()), "%d" % int(b.linked * 4),
            "%d" % min(3, int(held * 10)), "%d" % min(2, stock))


def features(blocks: list[Block]) -> list[list[str]]:
    """Feature names of every block: its place in the markup, its text, and its neighbours'. What
    the text says is learned apart for pages with and without an element for their content."""
    n, out = len(blocks), []
    page = "told" if any("<article" in b.marks or "<main" in b.marks for b in blocks) else "mute"
    seen = [_text_features(b) for b in blocks]
    edge = ("none",) * 4
    for i, b in enumerate(blocks):
        f = ["bias", "own:" + b.own, *("in:" + m for m in b.marks),
             *("near:" + m for m in b.near)]
        words, link, held, stock = seen[i]
        prose = int(words) >= 4 and link == "0"
        said = ["words:" + words, "link:" + link, "stop:" + held, "stock:" + stock,
                "words:%s,stock:%s" % (words, stock), "own,link:%s,%s" % (b.own, link),
                "prose:%s:%s" % (prose, b.own)]
        for side, other in (("before", seen[i - 1] if i else edge),
                            ("after", seen[i + 1] if i + 1 < n else edge)):
            said += ["%s-words:%s" % (side, other[0]), "%s-link:%s" % (side, other[1])]
        f += [f"{page}:{x}" for x in said]
        f.append("%s:%s" % (page, "<article" in b.marks or "<main" in b.marks))
        f.append("size:%d" % min(6, len(b.text).bit_length() // 2))
        last = b.text[-1]
        f.append("end:" + ("stop" if last in ".!?…:;\"'»”" else
                           "word" if last.isalnum() else "other"))
        if "©" in b.text or "&copy" in b.text:
            f.append("copyright")
        f.append("place:%s" % ("first" if i == 0 else "last" if i == n - 1 else "inside"))
        out.append(f)
    return out


# ---- training pages ----------------------------------------------------------------------

# class words of wrappings, by what they wrap; menus and the like also come as bare tags
BOILER = {
    "nav": "menu nav navbar navigation breadcrumb breadcrumbs toc links topnav tabs pagination",
    "header": "header masthead top branding site logo tagline",
    "footer": "footer copyright legal bottom colophon credits",
    "aside": "sidebar side widget related recommended trending popular rail more share social "
             "tags author",
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo promotion banner",
    "notice": "notice cookie cookies consent alert popup modal overlay gdpr privacy warning "
              "paywall newsletter subscribe",
    "form": "form search login signup register contact feedback",
    "comments": "comment comments reply replies discussion responses disqus thread reader readers",
}
CONTENT = "article content main post entry story body text page"


# words of layouts that say nothing about what they wrap
LAYOUT = "wrapper container row col grid box inner outer wrap block layout module region panel"
STOP_WORDS, STOCK_WORDS = sorted(STOP), sorted(STOCK)


def _invented(rng: Random) -> str:
    syll = "an ber ci de en fi ga ho il ka lo mi no or pa qu re sa tu ve".split()
    return "".join(rng.choice(syll) for _ in range(rng.randint(1, 4)))


def _words(rng: Random, n: int, running: bool = False) -> str:
    """Invented words; running text has frequent words between them."""
    share = rng.uniform(0.15, 0.6) if running else 0
    return " ".join(rng.choice(STOP_WORDS) if rng.random() < share else _invented(rng)
                    for _ in range(n))


def _sentence(rng: Random, lo=3, hi=40) -> str:
    s = _words(rng, rng.randint(lo, hi), rng.random() < 0.7).capitalize()
    return s + rng.choice([".", ".", ".", "!", "?", "", "&amp;"])


def _stock(rng: Random) -> str:
    """A sentence as notices, footers and calls to act have it."""
    words = _words(rng, rng.randint(2, 14), True).split()
    for _ in range(rng.randint(1, 3)):
        words.insert(rng.randint(0, len(words)), rng.choice(STOCK_WORDS))
    return " ".join(words).capitalize() + rng.choice([".", ".", "", "!"])


def _cls(rng: Random, words: str) -> str:
    pick = rng.sample(words.split(), rng.choice([1, 1, 2]))
    value = rng.choice(["-", "_", " "]).join(pick)
    return f' {rng.choice(["class", "class", "id"])}="{value}"'


def _mute(rng: Random) -> str:
    """An attribute that says nothing: none, a layout word or an invented one."""
    r = rng.random()
    if r < 0.35:
        return ""
    word = rng.choice(LAYOUT.split()) if r < 0.7 else _invented(rng)
    return f' {rng.choice(["class", "id"])}="{word}{rng.choice(["", "-8", "-a", "2"])}"'


def labelled_page(rng: Random) -> tuple[str, list[int]]:
    """A page and the labels of its leaf blocks (1 content). In a part of the pages wrappings carry
    no word that tells what they wrap, so that texts, links and neighbours have to."""
    labels: list[int] = []
    inside = [0]
    mute = rng.random() < 0.5           # neither content nor menus are named
    holder = rng.choice(["article", "article", "main", "div", "section", "body"])
    told = not mute and holder in ("article", "main")

    def lines(n, label):
        labels.extend([label] * n)

    def boiler(kind: str) -> str:
        words = BOILER[kind]
        silent = mute and rng.random() < 0.7
        if silent:
            tag = rng.choice(["div", "div", "section"])
            attr = _mute(rng)
        else:
            tag = kind if kind in ("nav", "header", "footer", "aside", "form") else rng.choice(
                ["div", "section", "aside"])
            if rng.random() < 0.35:
                tag = rng.choice(["div", "section"])
            attr = _cls(rng, words) if tag in ("div", "section") or rng.random() < 0.4 else ""
        if kind == "nav" or kind in ("aside", "header") and (silent or rng.random() < 0.5):
            n = rng.randint(2, 8)
            lines(n, 0)
            item = rng.choice(["li", "li", "p", "div"])
            body = "".join(f'<{item}><a href="/x">{_words(rng, rng.randint(1, 6))}</a></{item}>'
                           for _ in range(n))
            body = f"<ul>{body}</ul>" if item == "li" else body
        elif silent and kind in ("comments", "form"):
            lines(1, 0)
            body = f"<p>{_stock(rng)}</p>"
        elif kind == "comments":
            n = rng.randint(1, 5)
            lines(n + 1, 0)
            item = rng.choice(["div", "p", "li"])
            body = f"<h3>{_words(rng, 2)}</h3>" + "".join(
                f'<{item}{rng.choice(["", _cls(rng, words)])}>{_sentence(rng)}</{item}>'
                for _ in range(n))
        elif kind == "form":
            n = rng.randint(1, 3)
            lines(n, 0)
            body = "".join(rng.choice([f"<p>{_sentence(rng, 2, 9)}</p><input>",
                                       f"<button>{_words(rng, 1)}</button>"]) for _ in range(n))
        elif rng.random() < 0.5:
            lines(1, 0)
            sign = "&copy; " if kind == "footer" and rng.random() < 0.6 else ""
            text = sign + (_stock(rng) if silent or rng.random() < 0.4 else _sentence(rng))
            if (silent or told and inside[0] == 0) and rng.random() < 0.4:
                return f"<p>{text}</p>"
            body = text
        else:
            n = rng.randint(1, 4)
            lines(n, 0)
            body = "".join(f"<p>{_stock(rng) if silent else _sentence(rng)}</p>"
                           for _ in range(n))
        return f"<{tag}{attr}>{body}</{tag}>"

    def article() -> str:
        out = []
        if rng.random() < 0.8:
            lines(1, 1)
            head = f"<h1>{_words(rng, rng.randint(1, 10))}</h1>"
            out.append(f"<header>{head}</header>" if rng.random() < 0.1 else head)
        for _ in range(rng.randint(1, 14)):
            r = rng.random()
            if r < 0.72:
                lines(1, 1)
                s = _sentence(rng, 1, 90)
                if rng.random() < 0.15:
                    s = f"<b>{s}<br>" if rng.random() < 0.5 else f'{s} <a href="/y">see</a>'
                out.append(f"<p>{s}" + ("</p>" if rng.random() < 0.85 else ""))
            elif r < 0.80:
                lines(1, 1)
                out.append(f"<h2>{_words(rng, rng.randint(1, 6))}</h2>")
            elif r < 0.86:
                n = rng.randint(1, 4)
                lines(n, 1)
                out.append("<ul>" + "".join(f"<li>{_sentence(rng, 1, 15)}</li>"
                                            for _ in range(n)) + "</ul>")
            elif r < 0.90:
                lines(1, 1)
                out.append(f"<blockquote>{_sentence(rng)}</blockquote>")
            elif r < 0.93:
                lines(2, 1)
                out.append(f"<table><tr><td>{_words(rng, 2)}<td>{_words(rng, 1)}</table>")
            elif not mute:
                out.append(boiler(rng.choice(["ad", "aside", "notice", "ad", "form", "nav"])))
        if rng.random() < 0.15 and not mute:
            out.append(boiler("comments"))
        body = "".join(out)
        if mute:
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                tag = rng.choice(["div", "div", "section"])
                body = f"<{tag}{_mute(rng)}>{body}</{tag}>"
            return body
        tag = holder
        if tag == "body":
            return body
        attr = _cls(rng, CONTENT) if tag in ("div", "section") or rng.random() < 0.3 else ""
        text = f"<{tag}{attr}>{body}</{tag}>"
        return f"<main>{text}</main>" if tag == "article" and rng.random() < 0.2 else text

    before = [boiler(k) for k in rng.sample(["nav", "header", "ad", "notice", "form", "aside",
                                             "nav"], rng.randint(0, 5))]
    inside[0] = 1
    middle = article()
    inside[0] = 0
    after = [boiler(k) for k in rng.sample(["aside", "comments", "ad", "form", "notice", "nav"],
                                           rng.randint(0, 4))]
    if rng.random() < 0.85:
        after.append(boiler("footer"))
    body = "".join([*before, middle, *after])
    if rng.random() < 0.3:
        body = f"<div{_mute(rng)}>{body}</div>"
    page = f"<html><head><title>x</title></head><body>{body}"
    return page + ("</body></html>" if rng.random() < 0.9 else ""), labels


def training_set(pages: int = TRAIN_PAGES, seed: int = TRAIN_SEED):
    rng, out = Random(seed), []
    while len(out) < pages:
        page, labels = labelled_page(rng)
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels):
            out.append((blocks, labels))
    return out


def train(pages: int = TRAIN_PAGES, seed: int = TRAIN_SEED, steps: int = TRAIN_STEPS,
          l2: float = 3e-4) -> dict[str, float]:
    """Weights of the field by maximum likelihood (forward-backward gradients, Adam). Label 0's
    emission is 0; 'T:ab' are the transition weights."""
    data = [(features(b), y) for b, y in training_set(pages, seed)]
    count = Counter(f for fs, _ in data for one in fs for f in one)
    names = sorted(f for f, c in count.items() if c >= 3)
    index = {f: i for i, f in enumerate(names)}
    n, longest = len(data), max(len(y) for _, y in data)
    x = np.zeros((n, longest, len(names)), np.float32)
    y = np.zeros((n, longest), np.int64)
    live = np.zeros((n, longest), bool)
    for i, (fs, lab) in enumerate(data):
        live[i, :len(lab)] = True
        y[i, :len(lab)] = lab
        for t, one in enumerate(fs):
            for f in one:
                if f in index:
                    x[i, t, index[f]] = 1
    flat = x.reshape(-1, len(names))
    seen = np.zeros((2, 2))
    pair = live[:, 1:]
    np.add.at(seen, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    w, tr = np.zeros(len(names)), np.zeros((2, 2))
    mom = [np.zeros(len(names)), np.zeros((2, 2))]
    var = [np.zeros(len(names)), np.zeros((2, 2))]
    for step in range(1, steps + 1):
        e = np.zeros((n, longest, 2))
        e[..., 1] = (flat @ w.astype(np.float32)).reshape(n, longest)
        fwd = np.zeros((n, longest, 2))
        bwd = np.zeros((n, longest, 2))
        fwd[:, 0] = e[:, 0]
        for t in range(1, longest):
            nxt = np.logaddexp.reduce(fwd[:, t - 1, :, None] + tr, axis=1) + e[:, t]
            fwd[:, t] = np.where(live[:, t, None], nxt, fwd[:, t - 1])
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        for t in range(longest - 2, -1, -1):
            prv = np.logaddexp.reduce(tr + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
            bwd[:, t] = np.where(live[:, t + 1, None], prv, 0)
        post = np.exp(fwd + bwd - z[:, None, None])[..., 1] * live
        joint = np.zeros((2, 2))
        for t in range(longest - 1):
            p = np.exp(fwd[:, t, :, None] + tr + (e[:, t + 1] + bwd[:, t + 1])[:, None, :]
                       - z[:, None, None])
            joint += (p * live[:, t + 1, None, None]).sum(0)
        grads = [((y * live - post).reshape(-1).astype(np.float32) @ flat) / n - l2 * w,
                 (seen - joint) / n - l2 * tr]
        for k, (par, g) in enumerate(zip((w, tr), grads)):
            mom[k] = 0.9 * mom[k] + 0.1 * g
            var[k] = 0.99 * var[k] + 0.01 * g * g
            par += 0.1 * (mom[k] / (1 - 0.9 ** step)) / (
                np.sqrt(var[k] / (1 - 0.99 ** step)) + 1e-8)
    return dict(zip(names, w.tolist())) | {f"T:{a}{b}": float(tr[a, b])
                                           for a in (0, 1) for b in (0, 1)}


def viterbi(fs: list[list[str]], weights: dict[str, float]) -> list[int]:
    """The most likely labels; ties go to 0."""
    if not fs:
        return []
    t00, t01, t10, t11 = (weights[k] for k in ("T:00", "T:01", "T:10", "T:11"))
    get = weights.get
    back, a, b = [], 0.0, 0.0
    for i, one in enumerate(fs):
        e = sum(get(f, 0.0) for f in one)
        if i == 0:
            a, b = 0.0, e
            continue
        fa, fb = (0 if a + t00 >= b + t10 else 1), (0 if a + t01 >= b + t11 else 1)
        back.append((fa, fb))
        a, b = max(a + t00, b + t10), max(a + t01, b + t11) + e
    label = 0 if a >= b else 1
    out = [label]
    for fa, fb in reversed(back):
        label = fb if label else fa
        out.append(label)
    return out[::-1]


def main_text(page: str, weights: dict[str, float]) -> str:
    blocks = leaf_blocks(page)
    labels = viterbi(features(blocks), weights)
    return "\n".join(b.text for b, y in zip(blocks, labels) if y)


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; the model (a few hundred numbers) is trained
    first unless given."""
    model = pages.sparkSession.sparkContext.broadcast(weights or train())

    def run(batches):
        w = model.value
        for batch in batches:
            texts = [main_text(v or "", w) for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                        F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
