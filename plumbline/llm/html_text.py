"""Main-text extraction from web pages by a recurrent block labeller (operator 4).

A page is cut into blocks: stretches of text between block-level tags, with the path of open
elements. Each block becomes a vector of its hashed tag path, the hashed class and id words on
the path, its hashed words and a few measures (length, links, punctuation). A bidirectional
LSTM in numpy reads a page's blocks in order and labels each as main text or not, so that
every label depends on the whole page.

The labeller is trained on the driver by `train` on generated pages of many layouts, whose
labels are known (bounded: ``PAGES`` pages, some 20 seconds); its weights are broadcast and
pages are labelled where they lie, without a shuffle.

White space is what Python's str.split takes as such; a line break tag counts as white space.
Scripts, styles, templates, comments of the markup and the head's contents are no blocks.

Cases: null or empty html, and pages without main text, give an empty text; unclosed tags end
with their parent, an unclosed head at the first element or text that cannot stand in it, an
unclosed drawing or formula at the first element of a page; a tag with a quote left open ends
at its first >; a very long page is read whole; rows with null ids are kept; repeated rows
each return a row; extra columns are ignored; an empty table returns no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache, lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import _text as T

TAGS, NAMES, WORDS, MEASURES = 80, 64, 16, 8
INPUT, HIDDEN = TAGS + NAMES + WORDS + MEASURES, 24
PAGES, EPOCHS, SEED = 1000, 12, 5

BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object head title textarea canvas audio video".split())
#: An opening tag ends open elements of these names.
ENDS = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "body": "head"} | {x: "p" for x in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
ENDS = {k: frozenset(v.split()) for k, v in ENDS.items()}
#: An opening tag looks no further than this for elements to end.
SCOPE = frozenset("article aside body div footer header main nav section table ul ol dl td th blockquote form".split())

PUNCTUATION = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
#: What may stand in a head; anything else ends it.
HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: Drawings and formulas, in which a slash closes a tag, and the elements that cannot stand in them and end them.
FOREIGN = frozenset("svg math".split())
BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()) | BLOCK
#: Elements of a drawing or formula that hold text of the page's own kind.
HOLDS = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
#: Elements whose content is no markup: their end tags.
RAW = {x: re.compile(rf"</{x}\b[^>]*>?", re.I) for x in "script style textarea title noscript template iframe".split()}
#: An attribute's value: its quote, or all of an unquoted one.
VALUE = re.compile(r"""=\s*(?:(["'])|[^\s>"'][^\s>]*)""")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")


@lru_cache(maxsize=1 << 14)
def _slot(kind: str, word: str, n: int) -> int:
    return crc32(f"{kind}:{word}".encode()) % n


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple, text: str, linked: int) -> None:
        self.path, self.text, self.linked = path, text, linked


def tag_end(page: str, at: int, gone: set[str]) -> int:
    """Where the > of the tag lies whose attributes begin at ``at``; -1 if nowhere.

    A > inside a quoted value ends nothing, but only if the quotes are a value's own: where the
    next quote opens another value or text follows it at once, the value was left open, and its
    tag ends at the first >. ``gone`` keeps the quotes that do not come again in the page.
    """
    end = page.find(">", at)
    while end >= 0 and (m := VALUE.search(page, at, end)):
        at, quote = m.end(), m[1]
        if not quote:
            continue
        close = -1 if quote in gone else page.find(quote, at)
        if close < 0:
            gone.add(quote)
            break
        if close > end:
            after = page.find(">", close)
            if after < 0 or not (page[close + 1].isspace() or page[close + 1] in "/>") or page[close - 1] == "=":
                break
            end = after
        at = close + 1
    return end


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, lower-case name ('' if none), whether it closes, and attributes of each tag or comment; one pass."""
    i, n, gone, foreign = page.find("<"), len(page), set(), ""
    while i >= 0:
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            end = n if end < 0 else end + 3
            yield i, end, "", False, ""
        elif (m := NAME.match(page, i + 1)) or page[i + 1 : i + 2] in ("!", "?", "/"):
            end = page.find(">", i)
            if m and end >= 0 and (page.find('"', i, end) >= 0 or page.find("'", i, end) >= 0):
                end = tag_end(page, m.end(), gone)
            end = n if end < 0 else end + 1
            if m and m.end() <= end:
                name = m[1].lower()
                closes, shut = page[i + 1] == "/", page[end - 2] == "/"
                if name in FOREIGN and (not foreign or name == foreign):
                    foreign = "" if closes or shut and not foreign else name
                elif foreign and not closes and name in BREAKS:
                    foreign = ""
                if not closes and name in RAW and not (foreign and shut):
                    stop = RAW[name].search(page, end)
                    end = stop.end() if stop else n
                    yield i, end, "", False, ""
                else:
                    yield i, end, name, closes, page[m.end() : end - 1]
            else:
                yield i, end, "", False, ""
        else:  # a sign in the text
            end = i + 1
        i = page.find("<", end)


def blocks(page: str) -> list[Block]:
    """Text blocks in page order; a path is a tuple of (tag, class and id words)."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    count: dict[str, int] = {}
    piece: list[str] = []
    at = linked = silent = 0

    def flush() -> None:
        nonlocal linked
        if piece:
            text = "".join(piece)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(tuple(stack), text, min(linked, len(text))))
            piece.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal silent
        for name, _ in stack[k:]:
            count[name] -= 1
            silent -= name in SILENT
        del stack[k:]

    for start, end, name, closes, attributes in tags(page):
        if start > at and stack and stack[-1][0] == "head" and not page[at:start].isspace():
            close(len(stack) - 1)
        if start > at and not silent:
            raw = page[at:start]
            piece.append(raw)
            if count.get("a"):
                linked += len(raw)
        at = end
        if not name:
            continue
        if name in BREAKS and not closes and (count.get("svg") or count.get("math")):
            k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in FOREIGN)
            if not any(x in HOLDS for x, _ in stack[k:]):
                close(k)
        if name in BLOCK and not (silent and any(count.get(x) for x in HOLDS)):
            flush()
        elif name == "br":
            piece.append(" ")
        if closes:
            if count.get(name):
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            continue
        if count.get("head") and name not in HEAD:
            close(next(k for k, x in enumerate(stack) if x[0] == "head"))
        ends = ENDS.get(name)
        if ends and any(count.get(x) for x in ends):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    close(k)
                elif stack[k][0] in SCOPE:
                    break
        if name in VOID or attributes.endswith("/") and (name in SILENT or count.get("svg") or count.get("math")):
            continue
        words = tuple(w for a in NAMED.findall(attributes) for w in PART.findall("".join(a).lower())) if attributes else ()
        stack.append((name, words))
        count[name] = count.get(name, 0) + 1
        silent += name in SILENT
    if at < len(page) and stack and stack[-1][0] == "head":
        close(len(stack) - 1)
    if at < len(page) and not silent:
        piece.append(page[at:])
    flush()
    return out


@lru_cache(maxsize=1 << 14)
def _path_vector(path: tuple) -> np.ndarray:
    x = np.zeros(TAGS + NAMES, np.float32)
    for depth, (tag, names) in enumerate(path[::-1]):
        x[_slot("tag", tag, TAGS)] += 1.0 if depth < 6 else 0.5
        for w in names:
            x[TAGS + _slot("name", w, NAMES)] += 1
    if path:
        x[_slot("leaf", path[-1][0], TAGS)] += 1
    return x


def vectors(pages: list[list[Block]]) -> list[np.ndarray]:
    """The input vectors of each page's blocks."""
    found = [b for p in pages for b in p]
    n, per = len(found), np.array([len(p) for p in pages], np.int64)
    if not n:
        return [np.zeros((0, INPUT), np.float32) for _ in pages]
    x = np.zeros((n, INPUT), np.float32)
    x[:, : TAGS + NAMES] = [_path_vector(b.path) for b in found]
    buf, off = T.bytes_of(pa.array([b.text for b in found], pa.large_string()))
    h, w = T.word_hashes(buf, off, lower=True)
    count = np.bincount(T.owners(w) * WORDS + (h % T.U(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    x[:, TAGS + NAMES : TAGS + NAMES + WORDS] = count / np.maximum(np.sqrt((count**2).sum(1, keepdims=True)), 1)
    size = np.diff(off).astype(float)
    marks = np.concatenate(([0], np.cumsum(PUNCTUATION[buf])))[off]
    first = np.cumsum(per) - per
    place = (np.arange(n) - np.repeat(first, per)) / np.maximum(np.repeat(per, per) - 1, 1)
    x[:, -MEASURES:] = np.stack([
        np.log1p(size) / 6, np.array([b.linked for b in found]) / np.maximum(size, 1), np.diff(marks) / np.maximum(size, 1) * 20, size < 40,
        place, 1 - place, np.array([len(b.path) for b in found]) / 10, np.ones(n)], 1)
    np.minimum(x, 3, out=x)
    return [x[a : a + k] for a, k in zip(first.tolist(), per.tolist(), strict=True)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Labeller:
    """A bidirectional LSTM and a logistic output."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("W", draw(INPUT, 4 * HIDDEN)), ("U", draw(HIDDEN, 4 * HIDDEN)), ("b", np.zeros(4 * HIDDEN, np.float32)))}
        for d in "fb":
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.p |= {"V": draw(2 * HIDDEN, 1), "c": np.zeros(1, np.float32)}

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (page, block, HIDDEN) of one direction; masked blocks pass the state on."""
        n, t, _ = x.shape
        pre = (x.reshape(n * t, -1) @ self.p[f"W{d}"] + self.p[f"b{d}"]).reshape(n, t, -1)
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, t, HIDDEN), np.float32)
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = pre[:, s] + h @ self.p[f"U{d}"]
            g = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            u = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, s, None]
            c2 = f * c + i * u
            tc = np.tanh(c2)
            if keep is not None:
                keep.append((s, h, c, i, f, o, u, tc, m))
            c = m * c2 + (1 - m) * c
            h = m * o * tc + (1 - m) * h
            out[:, s] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        h = np.concatenate([self.run(x, mask, "f"), self.run(x, mask, "b")], 2)
        return (h @ self.p["V"])[..., 0] + self.p["c"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over blocks and its gradient, by back-propagation through time."""
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self.run(x, mask, d, kept[d]) for d in "fb"], 2)
        z = (h @ self.p["V"])[..., 0] + self.p["c"]
        q, total = _sigmoid(z), mask.sum()
        loss = -(mask * (y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7))).sum() / total
        dz = (mask * (q - y) / total).astype(np.float32)
        g = {"V": np.einsum("nth,nt->h", h, dz)[:, None], "c": dz.sum(keepdims=True).reshape(1)}
        dh_all = dz[..., None] * self.p["V"][:, 0]
        for k, d in enumerate("fb"):
            gw, gu, gb = (np.zeros_like(self.p[f"{a}{d}"]) for a in "WUb")
            dh, dc = np.zeros_like(h[:, 0, :HIDDEN]), np.zeros_like(h[:, 0, :HIDDEN])
            for s, h0, c0, i, f, o, u, tc, m in reversed(kept[d]):
                dh = dh + dh_all[:, s, k * HIDDEN : (k + 1) * HIDDEN]
                dho = m * dh
                dc2 = m * dc + dho * o * (1 - tc**2)
                dzs = np.concatenate([dc2 * u * i * (1 - i), dc2 * c0 * f * (1 - f), dho * tc * o * (1 - o), dc2 * i * (1 - u**2)], 1)
                gw += x[:, s].T @ dzs
                gu += h0.T @ dzs
                gb += dzs.sum(0)
                dh = (1 - m) * dh + dzs @ self.p[f"U{d}"].T
                dc = (1 - m) * dc + dc2 * f
            g |= {f"W{d}": gw, f"U{d}": gu, f"b{d}": gb}
        return float(loss), g

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page which of its blocks are main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        seen = vectors(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            t = len(pages[order[-1]])
            take = order[-max(1, 8192 // t) :]
            del order[-len(take) :]
            x, mask = batch([seen[i] for i in take])
            z = self.logits(x, mask)
            for k, i in enumerate(take):
                out[i] = z[k, : len(pages[i])] > 0
        return out


def batch(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, seqs))
    x, mask = np.zeros((len(seqs), t, INPUT), np.float32), np.zeros((len(seqs), t), np.float32)
    for i, s in enumerate(seqs):
        x[i, : len(s)], mask[i, : len(s)] = s, 1
    return x, mask


MAIN, OTHER = "\x01", "\x02"


def generated(rng: np.random.Generator) -> str:
    """A page of a random layout whose blocks begin with MAIN or OTHER."""
    any_ = lambda *a: a[rng.integers(len(a))]
    chance = lambda p: rng.random() < p
    word = lambda: "".join(any_("th", "er", "on", "an", "re", "ou", "en", "ti", "sch", "ar", "os", "el", "ch", "é", "ü", "mi", "ka") for _ in range(rng.integers(1, 5)))

    def words(lo: int, hi: int, stop: str = ".") -> str:
        out = [word() for _ in range(rng.integers(lo, hi))]
        for i in range(6, len(out), int(rng.integers(5, 12))):
            out[i] += any_(",", ".", "", "!")
        return " ".join(out).capitalize() + stop

    def named(*names: str) -> str:
        extra = f" {word()}" if chance(0.3) else ""
        return any_(f' class="{any_(*names)}{extra}"', f' id="{any_(*names)}"', f' class="{word()} {any_(*names)}"')

    noise = lambda: f' class="{word()}"' if chance(0.3) else ""
    link = lambda: f'<a href="/{word()}">{words(1, 4, "")}</a>'

    def menu() -> str:
        items = "".join(f"<li>{OTHER}{link()}</li>" for _ in range(rng.integers(2, 9)))
        return any_(f"<nav{noise()}><ul>{items}</ul></nav>", f"<div{named('nav', 'menu', 'navbar', 'breadcrumb', 'topnav')}><ul>{items}</ul></div>", f"<nav>{OTHER}{link()} {link()} {link()}</nav>", f"<ul{named('menu', 'nav', 'links')}>{items}</ul>")

    def header() -> str:
        return any_(f"<header{noise()}><div>{OTHER}{words(1, 4, '')}</div><p>{OTHER}{words(2, 9)}</p></header>", f"<div{named('header', 'masthead', 'banner', 'top')}>{OTHER}{words(1, 8, '')}</div>", f"<header><h1>{OTHER}{words(1, 4, '')}</h1>{menu()}</header>")

    def footer() -> str:
        text = any_(f"&copy; {word()}.example.com &middot; {words(3, 14)}", words(3, 20), f"Copyright {words(2, 6)} All rights reserved.", f"{link()} {link()}")
        return any_(f"<footer{noise()}>{OTHER}{text}</footer>", f"<footer><p>{OTHER}{text}</p><p>{OTHER}{words(2, 12)}</p></footer>", f"<div{named('footer', 'bottom', 'copyright', 'colophon')}><p>{OTHER}{text}</p></div>")

    def advert() -> str:
        return f"<{any_('div', 'div', 'section', 'aside', 'p')}{named('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner', 'adbox')}>{OTHER}{any_('', 'Advertisement ', 'Sponsored ')}{words(2, 16)}</{any_('div', 'section')}>"

    def aside() -> str:
        body = "".join(any_(f"<p>{OTHER}{words(3, 25)}</p>", f"<h3>{OTHER}{words(1, 4, '')}</h3>", f"<ul><li>{OTHER}{link()}</li><li>{OTHER}{link()}</li></ul>") for _ in range(rng.integers(1, 4)))
        return any_(f"<aside{noise()}>{body}</aside>", f"<div{named('sidebar', 'aside', 'related', 'widget', 'rail', 'recommended', 'share', 'social', 'newsletter')}>{body}</div>")

    def notice() -> str:
        text = any_(f"This site uses cookies. {words(2, 12)}", words(3, 18), f"Please accept our cookie policy {word()}.", f"Subscribe to {words(2, 6)}")
        return f"<div{named('notice', 'cookie', 'consent', 'alert', 'cookies', 'gdpr', 'popup', 'modal', 'warning', 'message', 'subscribe')}>{any_('<p>', '')}{OTHER}{text} {any_('', '<button>OK</button>')}</div>"

    def form() -> str:
        rows = "".join(f"<{any_('p', 'div')}><label>{OTHER}{words(1, 4, '')}</label><input name={word()}></p>" for _ in range(rng.integers(1, 4)))
        return f"<form{noise()} action=/x>{rows}<div>{OTHER}<button>{any_('Send', 'Search', 'Sign up', 'Login')}</button></div><select><option>{OTHER}{word()}<option>{OTHER}{word()}</select></form>"

    def comments() -> str:
        one = lambda: f"<{any_('div', 'li', 'article')}{any_('', named('comment', 'reply'))}><{any_('p', 'div')}>{OTHER}{words(3, 50)}</p><span>{any_('', 'Reply')}</span></div>"
        body = "".join(one() for _ in range(rng.integers(1, 5)))
        return f"<{any_('section', 'div', 'ol')}{named('comments', 'comment', 'discussion', 'responses', 'replies', 'commentlist', 'disqus')}>{any_('', f'<h2>{OTHER}Comments</h2>', f'<h3>{OTHER}{words(1, 4, str())}</h3>')}{body}</{any_('section', 'div')}>"

    inline = lambda: any_("", "", f" <a href=/{word()}>{words(1, 3, '')}</a> ", f" <b>{words(1, 5, '')}</b> ", f" <em>{word()}</em> ", "<br>")

    def content() -> str:
        kind = rng.random()
        if kind < 0.2:
            return f"<p{noise()}>{MAIN}{words(1, 14)}</p>"
        if kind < 0.62:
            return f"<p{noise()}>{MAIN}{words(1, 90)}{inline()}{words(1, 40)}</p>"
        if kind < 0.68:
            return f"<p{noise()}>{MAIN}{any_('<b>', '')}{words(1, 8)}{any_('<br>', '')}<p>{MAIN}{words(1, 60)}</p>"
        if kind < 0.75:
            return f"<{(h := any_('h2', 'h3', 'h4'))}>{MAIN}{words(1, 9, '')}</{h}>"
        if kind < 0.82:
            return f"<{(u := any_('ul', 'ol'))}>" + "".join(f"<li>{MAIN}{words(1, 25)}{inline()}</li>" for _ in range(rng.integers(1, 7))) + f"</{u}>"
        if kind < 0.87:
            return f"<blockquote>{any_('', '<p>')}{MAIN}{words(3, 50)}</blockquote>"
        if kind < 0.91:
            return "<table>" + "".join(f"<tr><td>{MAIN}{words(1, 5)}</td><td>{MAIN}{words(1, 5)}</td></tr>" for _ in range(rng.integers(1, 4))) + "</table>"
        if kind < 0.95:
            return f"<pre>{MAIN}{words(2, 30)}</pre>"
        return f"<figure><img src=x><figcaption>{MAIN}{words(2, 14)}</figcaption></figure>"

    inner = [content() for _ in range(rng.integers(0, 16))]
    for make, p in ((advert, 0.25), (aside, 0.12), (notice, 0.1), (comments, 0.12), (form, 0.06)):
        if inner and chance(p):
            inner.insert(int(rng.integers(len(inner) + 1)) if make is not comments else len(inner), make())
    title = f"<h1{noise()}>{MAIN}{words(1, 14, '')}</h1>" if chance(0.85) else ""
    title = any_(title, title, f"<header>{title}</header>") if title else ""
    body = title + "".join(inner)
    body = any_(
        f"<article{noise()}>{body}</article>", f"<article{noise()}>{body}</article>", f"<main{noise()}>{body}</main>", f"<main><article>{body}</article></main>", f'<div class="wrap"><article>{body}</article></div>',
        f"<div{named('content', 'post', 'entry', 'article', 'story', 'main', 'body', 'text')}>{body}</div>", f"<div id=page><section>{body}</section></div>", f"<div><div{noise()}>{body}</div></div>")
    before = "".join(make() for make, p in ((header, 0.4), (menu, 0.75), (notice, 0.25), (advert, 0.5), (form, 0.15)) if chance(p))
    after = "".join(make() for make, p in ((comments, 0.35), (aside, 0.4), (advert, 0.2), (form, 0.2), (notice, 0.1), (footer, 0.85)) if chance(p))
    return f"<!DOCTYPE html><html><head><title>{words(1, 9)}</title><style>p{{}}</style><script>var t='</p>'</script></head><body{noise()}>{before}{body}{after}</body></html>"


def labelled(page: str) -> tuple[list[Block], np.ndarray]:
    """A generated page's blocks and labels, the signs taken out of the text."""
    found = blocks(page)
    y = np.array([MAIN in b.text for b in found], np.float32)
    for b in found:
        b.text = " ".join(b.text.replace(MAIN, "").replace(OTHER, "").split()) or "x"
    return found, y


@cache
def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """Adam on generated pages; the same weights for the same parameters."""
    rng = np.random.default_rng(seed)
    data = [labelled(generated(rng)) for _ in range(pages)]
    data = [(v, y) for v, (_, y) in zip(vectors([b for b, _ in data]), data, strict=True) if len(y)]
    model = Labeller(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        rng.shuffle(data)
        data.sort(key=lambda d: len(d[0]) // 12)  # like lengths together: little padding
        starts = np.arange(0, len(data), 32)
        rng.shuffle(starts)
        for at in starts:
            part = data[at : at + 32]
            x, mask = batch([v for v, _ in part])
            y = np.zeros(mask.shape, np.float32)
            for i, (_, t) in enumerate(part):
                y[i, : len(t)] = t
            _, g = model.gradients(x, mask, y)
            size = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            step += 1
            rate = 0.01 * (0.5 if epoch >= epochs * 2 // 3 else 1.0)
            for k, v in g.items():
                v = v / max(1.0, size)
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.99 * s[k] + 0.01 * v * v
                model.p[k] = (model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text (main blocks joined by an empty line), n_chars, n_blocks, n_main."""
    shared = pages.sparkSession.sparkContext.broadcast((model or train()).p)  # some 100 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller.__new__(Labeller)
        labeller.p = shared.value
        for b in batches:
            _, off = T.bytes_of(b.column("html"))
            for lo, hi in T.slices(off):
                part = b.slice(lo, hi - lo)
                found = [blocks(x or "") for x in part.column("html").to_pylist()]
                main = labeller.label(found)
                text = ["\n\n".join(x.text for x, y in zip(f, keep, strict=True) if y) for f, keep in zip(found, main, strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(text, pa.string()), "n_chars": pa.array(list(map(len, text)), pa.int64()),
                    "n_blocks": pa.array(list(map(len, found)), pa.int64()), "n_main": pa.array([int(x.sum()) for x in main], pa.int64())})

    wanted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return wanted.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")
