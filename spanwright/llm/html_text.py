"""Main text of HTML pages: a bidirectional LSTM labels every block of a page, in numpy.

A page is read as a sequence of leaf blocks, the runs of text between block-level tags. A block's input is the sum of learned
vectors of its tag path (tags, classes and ids of its ancestors, hashed), the mean of learned vectors of its hashed words, and a
few measures (length, share of linked text, stops, depth). Two LSTM layers read all of the page's blocks forwards and
backwards, and a logistic unit decides for each block, knowing the whole page. The network is trained here, on pages that
``made_page`` builds from the usual parts of pages and whose labels are therefore known; no table is learned from. Parts beside
the main text speak with the usual phrases of menus, notices, adverts, forms and comments, and a share of all parts has class
names that say nothing, so that words and the page's order must tell them apart.

Defined cases: null or empty html has an empty text; text outside any block-level tag is a block; a tag, comment, script or
style that the page's end cuts off has no text; what browsers with scripts don't show as text (noscript, template, textarea,
the insides of embedded media and drawings) has none either; repeated rows are read each for itself; an empty table gives an
empty result; further columns are ignored. Blocks of any length and pages of any number of blocks are read whole.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import small_batches, table, utf8, word_hashes
from spanwright.llm.words import COMMON

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
RAW_TAGS = frozenset("script style title textarea noscript template iframe object svg audio video canvas".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_P = BLOCK_TAGS - {"button", "label", "option", "optgroup", "select"}
_TAG = re.compile(r"""<(?:!--(?:.*?)(?:-->|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|[!?/][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z))""", re.S)
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")


def blocks(page: str) -> list[tuple[str, tuple[str, ...], float]]:
    """(text, tag path, linked share) of a page's leaf blocks in page order."""
    out: list[tuple[str, tuple[str, ...], float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        words = " ".join(html.unescape("".join(text)).split()) if text else ""
        if words:
            total = sum(map(len, text)) or 1
            out.append((words, tuple(t for _, own in stack for t in own), min(1.0, linked / total)))
        text.clear()
        linked = 0

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text.append(page[at:lt])
            linked += (lt - at) * (in_link > 0)
        if lt == n:
            break
        m = _TAG.match(page, lt)
        if not m:
            text.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if m[5] and not m[0].endswith(">"):
            break  # cut off by the page's end
        if name == "br":
            text.append(" ")
        elif name == "a":
            in_link = 0 if closing else 1
        elif name in RAW_TAGS and not closing:
            if not attrs.rstrip().endswith("/"):
                end = re.compile(f"</{re.escape(name)}\\b[^>]*(?:>|\\Z)", re.I).search(page, at)
                at = end.end() if end else n
            text.append(" ")
        elif name in BLOCK_TAGS:
            flush()
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            elif name not in VOID_TAGS:
                if name in ENDS_P:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == "p":
                            del stack[k:]
                            break
                        if stack[k][0] in ("td", "th", "button", "li", "div", "article", "section"):
                            break
                if stack and stack[-1][0] == name and name in ("li", "dt", "dd", "option", "tr", "td", "th"):
                    stack.pop()
                own = [name]
                for a in _NAMED.finditer(attrs) if attrs else ():
                    own += [f".{x}" for x in _PARTS.split((a[1] or a[2] or a[3] or "").lower()) if x]
                stack.append((name, tuple(own)))
    flush()
    return out


PATH_BUCKETS, WORD_BUCKETS = 1 << 13, 1 << 13
PATH, WORD, MEASURES, HIDDEN = 16, 8, 6, 12
#: Bytes that end a word here: all of ASCII but letters and digits.
_ENDS = np.array([x < 128 and not chr(x).isalnum() for x in range(256)])


def _hash(s: str, n: int) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) & (n - 1)


class Labeller:
    """The network: embeddings, two LSTM layers side by side, a logistic unit for each block."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        f = lambda *s, scale=0.25: rng.normal(0, scale, s).astype(np.float32)
        d = PATH + WORD + MEASURES
        self.path, self.word = f(PATH_BUCKETS, PATH, scale=0.05), f(WORD_BUCKETS, WORD, scale=0.02)
        self.p = {"W": f(2, d, 4 * HIDDEN), "U": f(2, HIDDEN, 4 * HIDDEN), "b": np.zeros((2, 4 * HIDDEN), np.float32), "w": f(2 * HIDDEN), "x": f(d, scale=0.05), "o": np.zeros(1, np.float32)}
        self.p["b"][:, HIDDEN : 2 * HIDDEN] = 1.0

    def inputs(self, pages: list[list[tuple[str, tuple[str, ...], float]]]) -> tuple[np.ndarray, tuple, tuple]:
        """Input rows of all blocks of all pages, and the buckets behind them: (bucket, block) of path parts and of words."""
        every = [b for page in pages for b in page]
        kinds: dict[tuple[str, ...], int] = {}
        kind = np.array([kinds.setdefault(p, len(kinds)) for _, p, _ in every], np.int64)
        parts = [[_hash(t, PATH_BUCKETS) for t in dict.fromkeys(p)] for p in kinds]
        sums = np.array([self.path[np.array(p, np.int64)].sum(0) for p in parts], np.float32).reshape(-1, PATH)
        data, edges = utf8(pa.array([t.encode("utf-8", "surrogatepass") for t, _, _ in every], pa.binary()))
        starts, _, hashes = word_hashes(data, edges, ends=_ENDS)
        bucket, owner = (hashes & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), np.searchsorted(edges, starts, "right") - 1
        count = np.bincount(owner, minlength=len(every))
        x = np.zeros((len(every), PATH + WORD + MEASURES), np.float32)
        x[:, :PATH] = sums[kind]
        for c in range(WORD):
            x[:, PATH + c] = np.bincount(owner, self.word[bucket, c], len(every)) / np.maximum(count, 1)
        n = np.array([len(t) for t, _, _ in every], np.float32)
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(p)) for p in pages)])
        total = np.repeat([len(p) for p in pages], [len(p) for p in pages])
        stops = np.array([t.count(".") + t.count("!") + t.count("?") for t, _, _ in every], np.float32)
        x[:, PATH + WORD :] = np.stack([np.log1p(n) / 6, [s for _, _, s in every], 10 * stops / np.maximum(n, 1), np.array([len(p) for _, p, _ in every]) / 10, place / np.maximum(total, 1), 1 / (1 + place)], axis=1)
        in_path = np.array([len(parts[k]) for k in kind], np.int64)
        paths = np.concatenate([np.zeros(0, np.int64), *(parts[k] for k in kind)]).astype(np.int64)
        return x, (paths, np.repeat(np.arange(len(every)), in_path), np.ones(len(every))), (bucket, owner, np.maximum(count, 1))

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits (pages x blocks) of padded input sequences."""
        p, h = self.p, HIDDEN
        n, t_max, _ = x.shape
        states = np.zeros((n, t_max, 2 * h), np.float32)
        tape = []
        for side in (0, 1):
            z = x @ p["W"][side] + p["b"][side]
            s, c = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t in range(t_max) if side == 0 else range(t_max - 1, -1, -1):
                g = z[:, t] + s @ p["U"][side]
                i, f, o = (1 / (1 + np.exp(-np.clip(g[:, k * h : k * h + h], -30, 30))) for k in (0, 1, 2))
                u = np.tanh(g[:, 3 * h :])
                m = mask[:, t : t + 1]
                new_c = f * c + i * u
                tc = np.tanh(new_c)
                if keep:
                    tape.append((side, t, s, c, i, f, o, u, tc, m))
                c, s = m * new_c + (1 - m) * c, m * (o * tc) + (1 - m) * s
                states[:, t, side * h : side * h + h] = s
        logit = states @ p["w"] + x @ p["x"] + p["o"][0]
        return (logit, states, tape) if keep else logit

    def backward(self, x: np.ndarray, states: np.ndarray, tape: list, d: np.ndarray):
        p, h = self.p, HIDDEN
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"][0], g["w"], g["x"] = d.sum(), np.einsum("nt,nth->h", d, states), np.einsum("nt,ntd->d", d, x)
        d_states, d_x = d[:, :, None] * p["w"], d[:, :, None] * p["x"]
        ds, dc = [0.0, 0.0], [0.0, 0.0]
        for side, t, s, c, i, f, o, u, tc, m in reversed(tape):
            e = d_states[:, t, side * h : side * h + h] + ds[side]
            dnew = e * m
            d_o = dnew * tc * o * (1 - o)
            d_cell = dnew * o * (1 - tc * tc) + dc[side] * m
            d_gate = np.concatenate([d_cell * u * i * (1 - i), d_cell * c * f * (1 - f), d_o, d_cell * i * (1 - u * u)], axis=1)
            dc[side] = d_cell * f + dc[side] * (1 - m)
            ds[side] = e * (1 - m) + d_gate @ p["U"][side].T
            g["U"][side] += s.T @ d_gate
            g["W"][side] += x[:, t].T @ d_gate
            g["b"][side] += d_gate.sum(0)
            d_x[:, t] += d_gate @ p["W"][side].T
        return g, d_x

    def label(self, pages: list[list]) -> list[np.ndarray]:
        """Whether each block of each page is main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            take = order[at : at + max(1, min(128, 20_000 // len(pages[order[at]])))]
            at += len(take)
            logit = self.forward(*padded(self.inputs([pages[k] for k in take])[0], [len(pages[k]) for k in take]))
            for k, page in enumerate(take):
                out[page] = logit[k, : len(pages[page])] > 0
        return out


def padded(x: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of pages laid end to end as (pages, blocks, columns), and which places hold a block."""
    mask = (np.arange(max(sizes)) < np.array(sizes)[:, None]).astype(np.float32)
    out = np.zeros((*mask.shape, x.shape[1]), np.float32)
    out[mask > 0] = x
    return out, mask


_SYLLABLES = "an en er on th in re ti es or la de que au io sch ver ung ment tion ado ra el ou".split()
#: Start tags of parts that are not main text, by what they hold (fixed values).
MENUS = (
    "<nav>|<nav class=main-menu>|<ul class=menu>|<div class=navbar>|<div id=menu>|<div class=breadcrumbs>|<header>|<header class=site-header>|<div id=header>|<div class=masthead>|<div class=topbar>|"
    "<div role=banner>|<div role=navigation>|<div class=share>|<div class=social>|<ul class=tags>|<div class=pagination>"
).split("|")
FOOTERS = "<footer>|<footer class=site-footer>|<div id=footer>|<div class=copyright>".split("|")
SIDEBARS = "<aside>|<aside class=sidebar>|<div class=sidebar>|<div id=sidebar>|<div class=widget>|<div class=related-posts>|<section class=related>".split("|")
ADVERTS = "<div class=ad>|<div class=ads>|<div class=advert>|<div class=advertisement>|<div class=ad-banner>|<div class=sponsored>|<div class=promo>|<div id=ad-top>|<aside class=ad>|<section class=ad>|<div class=banner>".split("|")
NOTICES = "<div class=cookie-notice>|<div id=cookie-banner>|<div class=notice>|<div class=consent>|<div class=alert>|<div class=popup>|<div class=modal>|<div role=alert>|<div class=paywall>".split("|")
FORMS = "<form>|<form class=search>|<form id=newsletter>|<div class=newsletter>|<div class=subscribe>|<div class=login>".split("|")
COMMENTS = (
    "<div class=comments>|<section id=comments>|<section class=comments>|<div class=comment>|<div id=disqus>|<ol class=commentlist>|<div class=reader-comments>|<ul class=comments>|<div class=replies>|<div class=user-comments>"
).split("|")
#: What such parts usually say (fixed values).
SAYS = {
    "menu": "Home|About us|Contact|News|Products|Services|Blog|Careers|Sitemap|Search|Log in|Sign up|Register|My account|Next page|Previous|Categories|Tags|Share|Tweet|Share on Facebook|Follow us|Skip to content|Startseite|Kontakt|Accueil|Inicio",
    "footer": "All rights reserved|Copyright 2024|Privacy policy|Terms of use|Imprint|Impressum|Datenschutz|Powered by WordPress|Cookie settings|Contact us|Legal notice|Mentions legales|Aviso legal|Site by",
    "sidebar": "Related posts|Popular articles|Most read|Recent posts|You may also like|Read more|Archives|Trending now|Latest news|About the author|Recommended for you|Editor's picks",
    "advert": "Advertisement|Sponsored|Buy now|Sale ends soon|Limited offer|Free shipping|Shop now|Click here|Save 50% today|Order now|Special deal|Try it free|Promoted content|Best price guaranteed",
    "notice": "We use cookies to improve your experience|Accept all cookies|Manage preferences|This site uses cookies|I agree|Got it|Your browser is out of date|Please enable JavaScript|Subscribe to continue reading|You have reached your limit of free articles|By using this site you accept our privacy policy",
    "form": "Subscribe to our newsletter|Enter your email address|Sign up|Your name|Submit|Send|Password|Forgot your password|Remember me|Search this site|Leave a reply|Post a comment",
    "comment": "Great post, thanks for sharing|I totally agree with you|Reply|Report comment|posted 3 hours ago|Thanks for this article|I don't think so, sorry|lol nice one|This is so true|2 likes|Log in to reply|First comment|Does anybody know more|Good read, thank you",
}
SAYS = {k: v.split("|") for k, v in SAYS.items()}
ASIDES = [(k, x) for k, many in zip(SAYS, (MENUS, FOOTERS, SIDEBARS, ADVERTS, NOTICES, FORMS, COMMENTS), strict=True) for x in many]
#: Parts that hold main text.
MAINS = "<article>|<main>|<main><article>|<article class=post>|<div class=content>|<div id=content>|<div class=article-body>|<section class=post>|<div class=entry-content>|<div id=main>|<div class=text>|<main class=page>|<div>|".split("|")


def _closing(start: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", start)))


def made_page(rng: random.Random, nameless: float = 0.25) -> tuple[list, np.ndarray]:
    """A page's blocks and their labels, put together at random from the usual parts; ``nameless`` of them have class names that say nothing."""
    strange = rng.random() < 0.5  # a language of its own
    word = lambda: "".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) if strange or rng.random() < 0.2 else rng.choice(COMMON)
    words = lambda lo, hi: " ".join(word() for _ in range(rng.randrange(lo, hi)))
    odd = lambda: "".join(rng.choices(_SYLLABLES, k=rng.randint(2, 4)))

    def unnamed(start: str) -> str:
        """The same part as a plain block with a class name that says nothing, or none."""
        return ("<ul" if start.startswith("<ul") else "<ol" if start.startswith("<ol") else "<div") + rng.choice(["", f" class={odd()}", f" id={odd()}"]) + ">"

    def aside(inner: bool = False) -> str:
        kind, start = rng.choice(ASIDES)
        plain = rng.random() < nameless and not inner  # a part of the main text's own that nothing marks is main text
        start = unnamed(start) if plain else start

        def own() -> str:
            if rng.random() < (0.9 if plain else 0.5):
                said = rng.choice(SAYS[kind])
                said = f"{said} {words(1, 12)}" if rng.random() < 0.3 else said
            else:
                said = words(5, 50) + "." if kind == "comment" or rng.random() < 0.2 else words(1, 9)
            return "\x01" + said + rng.choice(["", ".", "!"])

        links = kind == "menu" and rng.random() < 0.7 or rng.random() < 0.2
        inner = [f"<a href=x>{own()}</a>" for _ in range(rng.randint(1, 5))] if links else [own() for _ in range(rng.randint(1, 3))]
        if start.startswith(("<ul", "<ol")) or links and rng.random() < 0.7:
            body = "".join(f"<li>{x}</li>" for x in inner)
            body = body if start.startswith(("<ul", "<ol")) else f"<ul>{body}</ul>"
        elif kind == "form" and rng.random() < 0.6:
            body = f"<label>{inner[0]}</label><button>\x01{rng.choice(SAYS[kind])}</button>"
        else:
            body = inner[0] if len(inner) == 1 or rng.random() < 0.3 else "".join(f"<{t}>{x}</{t}>" for x in inner for t in [rng.choice(["p", "div", "p", "h3"])])
        return start + body + _closing(start)

    def main() -> str:
        start = rng.choice(MAINS) if rng.random() < 0.6 else "<article>"
        parts = [f"<h1>\x02{words(1, 9)}</h1>"] if rng.random() < 0.85 else []
        many, short = (rng.randint(20, 70), 0.7) if rng.random() < 0.06 else (rng.randint(1, 13), 0.25)
        for _ in range(many):
            r = rng.random()
            text = f"\x02{words(1, 4) if rng.random() < short else words(6, 60)}{rng.choice(['.', '.', '', '!'])}"
            parts.append(
                f"<p>{text}</p>" if r < 0.62 else f"<p><b>{text}<br>" if r < 0.68 else f"<h2>\x02{words(1, 6)}</h2>" if r < 0.74 else f"<blockquote>{text}</blockquote>" if r < 0.78
                else "<ul>" + "".join(f"<li>\x02{words(1, 12)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>" if r < 0.83 else f"<pre>{text}</pre>" if r < 0.85
                else f"<table><tr><td>\x02{words(1, 5)}</td><td>\x02{words(1, 5)}</td></tr></table>" if r < 0.87 else f"<div>{text}</div>" if r < 0.9 else f"<section><p>{text}</p></section>" if r < 0.93 else aside(True)
            )
        return start + "".join(parts) + _closing(start)

    inner = "".join([*(aside() for _ in range(rng.randint(0, 4))), main(), *(aside() for _ in range(rng.randint(0, 4)))])
    wrap = rng.random()
    found = blocks(f"<html><body>{'<div class=wrapper>' + inner + '</div>' if wrap < 0.25 else '<div id=page><div class=container>' + inner + '</div></div>' if wrap < 0.35 else inner}</body></html>")
    labels = np.array(["\x02" in t for t, _, _ in found], np.float32)
    return [(" ".join(t.replace("\x01", "").replace("\x02", "").split()) or "x", p, s) for t, p, s in found], labels


def _adapted(vectors: np.ndarray, squares: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """A step of the rows' vectors against their gradients, each by its own past size."""
    order = np.argsort(rows, kind="stable")
    hit, first = np.unique(rows[order], return_index=True)
    if len(hit):
        sums = np.add.reduceat(values[order], first, axis=0)
        squares[hit] += (sums**2).mean(1)
        vectors[hit] -= 0.15 * sums / np.sqrt(squares[hit])[:, None]


def train(steps: int = 800, batch: int = 24, pages: int = 2500, seed: int = 3) -> Labeller:
    """Fit the labeller on ``pages`` made pages."""
    rng, model, made_by = np.random.default_rng(seed), Labeller(seed), random.Random(seed)
    made = sorted((made_page(made_by) for _ in range(pages)), key=lambda x: len(x[0]))
    adam = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.p.items()}
    squares = [np.full(PATH_BUCKETS, 1e-2, np.float32), np.full(WORD_BUCKETS, 1e-2, np.float32)]
    for step in range(steps):
        at = int(rng.integers(0, pages - batch + 1))
        own = made[at : at + batch]  # pages of like numbers of blocks
        rows, (paths, path_of, _), (words, word_of, count) = model.inputs([b for b, _ in own])
        heard = rng.random((len(rows), 1)) >= 0.4  # the words of the others are left out, so that path and page must do
        rows[:, PATH : PATH + WORD] *= heard
        x, mask = padded(rows, [len(b) for b, _ in own])
        y = np.zeros(mask.shape, np.float32)
        y[mask > 0] = np.concatenate([labels for _, labels in own])
        logit, states, tape = model.forward(x, mask, keep=True)
        d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * mask / mask.sum()).astype(np.float32)
        grad, d_x = model.backward(x, states, tape, d)
        rate = 0.02 * (1 - 0.9 * step / steps)
        norm = float(np.sqrt(sum(float((v**2).sum()) for v in grad.values())))
        for k, v in grad.items():
            v = v * min(1.0, 1.0 / (norm + 1e-9))
            m1, m2 = adam[k]
            m1 += 0.1 * (v - m1)
            m2 += 0.01 * (v * v - m2)
            model.p[k] -= rate * (m1 / (1 - 0.9 ** (step + 1))) / (np.sqrt(m2 / (1 - 0.99 ** (step + 1))) + 1e-7)
        d_rows = d_x[mask > 0] * mask.sum()
        _adapted(model.path, squares[0], paths, d_rows[path_of, :PATH])
        _adapted(model.word, squares[1], words, (heard * d_rows[:, PATH : PATH + WORD])[word_of] / count[word_of, None])
    return model


@lru_cache(maxsize=1)
def default_model() -> Labeller:
    """The labeller that ``train`` gives; it depends on no data, so a process trains it once."""
    return train()


def main_text(pages: DataFrame, model: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and the main text of every page: its main blocks, two line feeds between."""
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model or default_model())  # fixed size: under one MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [blocks(h) for h in batch.column("html").to_pylist()]
            texts = ["\n\n".join(b[0] for b, ok in zip(page, keep, strict=True) if ok) for page, keep in zip(read, shared.value.label(read), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")


def op5_html_text(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
