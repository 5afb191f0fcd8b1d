"""Main text of web pages, by a recurrent block labeller.

A page is cut into its leaf blocks in order. Each block is a vector of its hashed tag
path (tags and class names), its hashed words and a few measures. A bidirectional LSTM
in numpy reads the sequence, so every block is classified in the context of the whole
page. The model is trained here, on pages that a seeded generator writes in many
layouts with a known label for every block.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiepoint.llm.common import bound_batches

PATH_DIMS, WORD_DIMS, MEASURES = 384, 32, 8
DIMS = PATH_DIMS + WORD_DIMS + MEASURES
HIDDEN = 20
TRAINING_PAGES, EPOCHS, SEED = 1200, 14, 7

_BLOCK = set("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HIDDEN = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "title", "textarea", "audio", "video"}
#: a new one ends an open one of the same kind, if no other element of its list stands between
_ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Piece:
    """A leaf block: its text, how much of it is links, and the tags and names that it lies in."""

    text: str
    linked: int
    path: tuple[str, ...]


def pieces_of(page: str) -> list[Piece]:
    """Leaf blocks of a page in order, with text that is shown, references decoded and white space made single."""
    out: list[Piece] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = 0
    in_link = False
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if text:
            shown = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if shown:
                out.append(Piece(shown, linked, tuple(x for _, names in stack for x in names)))
            text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text.append(raw)
            if in_link:
                linked += len(raw)

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing, attributes = name.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if name == "br":
            add(" ")
        elif name == "a":
            in_link = not closing
        elif name in _HIDDEN and not closing:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else end
        elif name not in _BLOCK and "-" not in name:
            continue
        elif closing:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    in_link = False
                    break
        else:
            flush()
            ends = _ENDS.get(name, {"p"})
            while stack and stack[-1][0] in ends:
                stack.pop()
            if name not in _VOID:
                names = [f"<{name}>"]
                for v in _NAMED.findall(attributes):
                    names += [p.lower() for p in _PART.findall(v[0] or v[1] or v[2])]
                stack.append((name, tuple(names)))
    flush()
    return out


def _slot(kind: str, what: str, size: int) -> int:
    return zlib.crc32(f"{kind}:{what}".encode("utf-8", "replace")) % size


def vectors_of(pieces: list[Piece], known: dict[str, int] | None = None) -> np.ndarray:
    """A vector for each block; ``known`` remembers words' slots from call to call."""
    known = {} if known is None else known
    if len(known) > 200_000:
        known.clear()
    x = np.zeros((len(pieces), DIMS), np.float32)
    paths: dict[tuple[str, ...], list[int]] = {}
    for i, p in enumerate(pieces):
        slots = paths.get(p.path)
        if slots is None:
            tags = [t for t in p.path if t[0] == "<"]
            slots = paths[p.path] = [*(_slot("in", t, PATH_DIMS) for t in p.path), *(_slot("leaf", t, PATH_DIMS) for t in tags[-1:])]
        x[i, slots] = 1
        words = p.text.lower().split()
        n = len(words)
        for w in words:
            if w not in known:
                known[w] = _slot("word", w, WORD_DIMS)
        x[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.bincount([known[w] for w in words], minlength=WORD_DIMS) * (0.5 / max(1, n) ** 0.5)
        size = len(p.text)
        x[i, PATH_DIMS + WORD_DIMS :] = (np.log1p(size) / 5, min(1.0, p.linked / max(1, size)), p.text.count(".") / (n + 1), p.text.count(",") / (n + 1), sum(map(str.isdigit, p.text)) / (size + 1), p.text[-1] in ".!?", i / len(pieces), n == 1)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one output; weights are float32 arrays."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def fresh(rng: np.random.Generator) -> Labeller:
        w = {}
        for way in "fb":
            w["x" + way] = rng.normal(0, DIMS**-0.5, (DIMS, 4 * HIDDEN))
            w["h" + way] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            w["c" + way] = np.zeros(4 * HIDDEN)
            w["c" + way][HIDDEN : 2 * HIDDEN] = 1  # the forget gate starts open
        w["o"] = rng.normal(0, (2 * HIDDEN) ** -0.5, 2 * HIDDEN)
        w["d"] = np.zeros(1)
        return Labeller({k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool):
        """States of one direction; x is (time, page, dims), mask (time, page)."""
        steps, n, _ = x.shape
        given = x @ self.w["x" + way] + self.w["c" + way]
        h = c = np.zeros((n, HIDDEN), np.float32)
        out, tape = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ self.w["h" + way]
            g = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            u = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new_c = f * c + i * u
            th = np.tanh(new_c)
            if keep:
                tape.append((t, h, c, i, f, o, u, th, m))
            h, c = np.where(m, o * th, h), np.where(m, new_c, c)
            out[t] = h
        return out, tape

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f", False)[0], self._run(x, mask, "b", False)[0]], axis=2)
        return both @ self.w["o"] + self.w["d"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        runs = {way: self._run(x, mask, way, True) for way in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        p = _sigmoid(both @ self.w["o"] + self.w["d"])
        n = mask.sum()
        loss = -float((np.where(y, np.log(p + 1e-9), np.log(1 - p + 1e-9)) * mask).sum() / n)
        dz = (p - y) * mask / n
        grads = {"o": np.einsum("tp,tph->h", dz, both), "d": np.array([dz.sum()])}
        dboth = dz[:, :, None] * self.w["o"]
        for way, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            dout, wh = dboth[:, :, part], self.w["h" + way]
            dh = dc = np.zeros(x.shape[1:2] + (HIDDEN,), np.float32)
            dgiven = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dwh = np.zeros_like(wh)
            for t, h, c, i, f, o, u, th, m in reversed(runs[way][1]):
                dh = dh + dout[t]
                own_h, own_c = dh * m, dc * m
                own_c = own_c + own_h * o * (1 - th**2)
                step = np.concatenate([own_c * u * i * (1 - i), own_c * c * f * (1 - f), own_h * th * o * (1 - o), own_c * i * (1 - u**2)], axis=1)
                dgiven[t] = step
                dwh += h.T @ step
                dh, dc = np.where(m, step @ wh.T, dh), np.where(m, own_c * f, dc)
            grads["x" + way] = np.einsum("tpd,tpg->dg", x, dgiven, optimize=True)
            grads["h" + way], grads["c" + way] = dwh, dgiven.sum(axis=(0, 1))
        return loss, grads

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, whether its blocks are main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            group = order[at : at + 1]
            # pages of about the same length, in groups of bounded size
            while at + len(group) < len(order) and len(group) < 128 and len(pages[order[at + len(group)]]) * (len(group) + 1) <= 8000:
                group.append(order[at + len(group)])
            x, mask = stacked([pages[i] for i in group])
            logits = self.logits(x, mask)
            for k, i in enumerate(group):
                out[i] = logits[: len(pages[i]), k] > 0
            at += len(group)
        return out


def stacked(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), DIMS), np.float32), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


class Writer:
    """Writes training pages: marked-up text in random layouts, and the label of every block."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        parts = ["".join(rng.choice(list(a))) for a in ["bcdfghjklmnpqrstvwz" * 2] for _ in range(40)]
        self.syllables = [c + v + e for c in parts[:25] for v in "aeiouéäö" for e in ("", "n", "r", "s")]
        self.vocabulary: list[str] = []

    def pick(self, *of):
        return of[self.rng.integers(len(of))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, n: int) -> str:
        at = np.minimum(self.rng.zipf(1.3, n), len(self.vocabulary)) - 1
        commas, odd = self.rng.random(n) < 0.06, self.rng.random(n) < self.oddness
        return " ".join(self.vocabulary[i] + "," * c + self.odd * o for i, c, o in zip(at.tolist(), commas.tolist(), odd.tolist(), strict=True))

    def sentence(self, n: int) -> str:
        return self.words(n).capitalize() + self.pick(".", ".", ".", "!", "?", "")

    def paragraph(self) -> str:
        if self.chance(0.15):
            return self.sentence(int(self.rng.integers(1, 4)))
        return " ".join(self.sentence(int(self.rng.integers(1, 18))) for _ in range(int(self.rng.geometric(0.3))))

    def tag(self, name: str, inner: str, names: str = "") -> str:
        name = name.upper() if self.shout else name
        extra = f' {self.pick("class", "class", "id")}="{names}"' if names else ""
        return f"<{name}{extra}>{inner}" + ("" if name.lower() in ("p", "li") and self.chance(self.sloppy) else f"</{name}>")

    def links(self, n: int) -> str:
        items = [self.tag("li", f'<a href="/{self.words(1)}">{html.escape(self.words(int(self.rng.integers(1, 4))))}</a>') for _ in range(n)]
        return self.tag("ul", "".join(items)) if self.chance(0.8) else " ".join(f"<a href='#{i}'>{self.words(1)}</a>" for i in range(n))

    def box(self, tags: tuple[str, ...], names: tuple[str, ...], inner: str) -> str:
        """Something that is not main text, known by its tag or by its name."""
        semantic = [t for t in tags if t != "div"]
        if semantic and self.chance(0.5):
            return self.tag(self.pick(*semantic), inner, self.pick("", "", *names))
        return self.tag(self.pick("div", "div", "section", "ul" if "<li" in inner and "<ul" not in inner else "div"), inner, self.pick(*names))

    def junk(self, kind: str) -> str:
        r = lambda a, b: int(self.rng.integers(a, b))
        text = lambda a, b: html.escape(self.sentence(r(a, b)))
        if kind == "menu":
            return self.box(("nav", "menu"), ("nav", "menu", "navbar", "main-menu", "breadcrumb", "breadcrumbs", "topnav", "navigation", "pagination", "toc"), self.links(r(2, 9)))
        if kind == "header":
            return self.box(("header",), ("header", "site-header", "masthead", "page-head", "topbar", "banner", "logo"), self.tag(self.pick("div", "p", "span", "h2"), text(1, 6)) + (self.links(r(2, 5)) if self.chance(0.4) else ""))
        if kind == "footer":
            return self.box(("footer",), ("footer", "site-footer", "bottom", "copyright", "legal", "colophon"), self.pick("&copy; ", "", "Copyright ") + text(2, 12) + (self.links(r(1, 5)) if self.chance(0.4) else ""))
        if kind == "ad":
            return self.box(("div",), ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "adsbox"), self.pick(text(2, 14), self.tag("p", text(2, 14)), f"<a href='#'>{text(2, 8)}</a>"))
        if kind == "sidebar":
            return self.box(("aside",), ("sidebar", "side", "related", "recommended", "widget", "more-stories", "popular", "rail"), self.tag(self.pick("h2", "h3", "h4"), text(1, 4)) + self.pick(self.links(r(2, 7)), self.tag("p", text(4, 30))))
        if kind == "notice":
            return self.box(("dialog", "div"), ("cookie", "cookie-banner", "notice", "consent", "gdpr", "popup", "modal", "newsletter", "subscribe", "alert", "paywall"), self.tag("p", text(4, 25)) + (self.tag("button", text(1, 3)) if self.chance(0.6) else ""))
        if kind == "form":
            fields = "".join(self.tag("label", text(1, 3)) + "<input type=text>" for _ in range(r(1, 4)))
            return self.tag("form", fields + self.tag("button", text(1, 3)) + (self.tag("select", "".join(self.tag("option", text(1, 2)) for _ in range(r(2, 5)))) if self.chance(0.3) else ""), self.pick("", "search", "login", "signup", "contact-form"))
        if kind == "share":
            return self.box(("div",), ("share", "social", "tags", "byline", "meta", "author-bio", "toolbar", "share-buttons"), self.pick(self.links(r(2, 5)), text(1, 8)))
        comments = "".join(self.tag(self.pick("div", "li", "div", "article"), self.tag("p", html.escape(self.paragraph())), self.pick("comment", "comment-body", "reply")) for _ in range(r(1, 6)))
        return self.tag(self.pick("div", "section", "ol", "div"), self.tag("h3", text(1, 3)) + comments, self.pick("comments", "comment-list", "discussion", "responses", "disqus", "replies"))

    def page(self) -> tuple[str, list[str]]:
        """A page, and its main text's blocks."""
        parts = self.rng.integers(len(self.syllables), size=(150, 4)).tolist()
        self.vocabulary = ["".join(self.syllables[i] for i in p[:n]) for p, n in zip(parts, self.rng.integers(1, 5, 150).tolist(), strict=True)]
        self.shout, self.sloppy = self.chance(0.05), self.pick(0.0, 0.0, 0.3, 1.0)
        self.odd, self.oddness = self.pick("%%%", "***", "###", "&", "!!"), self.pick(0.0, 0.0, 0.0, 0.1, 0.9)
        main: list[str] = []
        inside: list[str] = []

        def say(tag: str, text: str) -> None:
            main.append(_SPACE.sub(" ", text).strip())
            marked = html.escape(text)
            inside.append(f"<{tag}><b>{marked}<br>" if tag == "p" and self.chance(0.1) else self.tag(tag, marked))

        if self.chance(0.85):
            say(self.pick("h1", "h1", "h2"), self.sentence(int(self.rng.integers(1, 10))))
        for _ in range(int(self.rng.geometric(0.14))):
            what = self.rng.random()
            if what < 0.78:
                say("p", self.paragraph())
            elif what < 0.84:
                say(self.pick("h2", "h3"), self.sentence(int(self.rng.integers(1, 6))))
            elif what < 0.9:
                say(self.pick("blockquote", "pre", "figcaption"), self.paragraph())
            elif what < 0.94:
                items = [self.sentence(int(self.rng.integers(1, 12))) for _ in range(int(self.rng.integers(2, 6)))]
                main.extend(items)
                inside.append(self.tag(self.pick("ul", "ol"), "".join(self.tag("li", html.escape(i)) for i in items)))
            else:
                inside.append(self.junk(self.pick("ad", "share", "sidebar", "notice", "form")))
        body = "".join(inside)
        style = self.rng.random()
        if style < 0.55:
            body = self.tag("article", body, self.pick("", "", "post", "story"))
        elif style < 0.7:
            body = self.tag("main", body, self.pick("", "", "content"))
        else:
            body = self.tag("div", body, self.pick("content", "article", "post", "entry-content", "story", "post-body", "article-body", "main-content", "text"))
        if self.chance(0.25):
            body = self.tag(self.pick("main", "div", "section"), body, self.pick("", "wrap", "container", "page", "content"))
        cells = self.chance(0.12)
        before = [self.junk(k) for k in ("notice", "header", "menu", "form", "ad", "sidebar") if self.chance(0.4)]
        after = [self.junk(k) for k in ("share", "comments", "sidebar", "ad", "menu", "form", "footer") if self.chance(0.4)]
        self.rng.shuffle(before)
        if cells:  # laid out as a table: a cell of links beside the cell of the text, with or without names
            named = self.chance(0.6)
            side = self.tag("td", self.pick(self.links(int(self.rng.integers(2, 9))), "<br>".join(f"<a href='/{i}'>{self.words(2)}</a>" for i in range(int(self.rng.integers(2, 9))))), self.pick("menu", "nav", "left", "sidebar") if named else "")
            text = self.tag("td", body if self.chance(0.4) else "".join(inside), self.pick("content", "main", "text", "article") if named else "")
            rows = [self.tag("tr", side + text if self.chance(0.7) else text + side)]
            if self.chance(0.3):
                rows.insert(0, self.tag("tr", self.tag("td", html.escape(self.sentence(int(self.rng.integers(1, 5)))), self.pick("header", "banner", "logo"))))
            if self.chance(0.3):
                rows.append(self.tag("tr", self.tag("td", "&copy; " + html.escape(self.sentence(int(self.rng.integers(2, 9)))), self.pick("footer", "copyright", "legal"))))
            body = self.tag("table", "".join(rows), self.pick("", "", "layout", "page"))
        page = f"<!DOCTYPE html><html><head><title>{self.words(3)}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>" + "".join(before) + body + "".join(after)
        return page + ("</body></html>" if self.chance(0.8) else ""), main


def training_set(pages: int = TRAINING_PAGES, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of generated pages; a block is main text if it is the next of the page's main blocks."""
    writer, out = Writer(np.random.default_rng(seed)), []
    for _ in range(pages):
        page, main = writer.page()
        pieces, at = pieces_of(page), 0
        y = np.zeros(len(pieces), bool)
        for i, p in enumerate(pieces):
            if at < len(main) and p.text == main[at]:
                y[i], at = True, at + 1
        if pieces and at == len(main):
            out.append((vectors_of(pieces), y))
    return out


def trained(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The model, fitted with Adam on ``pages`` generated pages; always the same for the same arguments."""
    rng = np.random.default_rng(seed)
    data = sorted(training_set(pages, seed), key=lambda d: len(d[0]))
    model = Labeller.fresh(rng)
    first, second = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
    batches = [data[i : i + 16] for i in range(0, len(data), 16)]
    step = 0
    for epoch in range(epochs):
        for b in rng.permutation(len(batches)):
            x, mask = stacked([d[0] for d in batches[b]])
            x = x * (rng.random(x.shape[1:]) > 0.1)  # a page's names may be missing
            y = np.zeros(mask.shape, bool)
            for k, (_, labels) in enumerate(batches[b]):
                y[: len(labels), k] = labels
            _, grads = model.gradients(x.astype(np.float32), mask, y)
            step += 1
            norm = float(np.sqrt(sum((g**2).sum() for g in grads.values())))
            for k, g in grads.items():
                g = g / max(1.0, norm)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                rate = 0.02 * (1 - 0.9 * epoch / epochs)
                model.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


_WEIGHTS: dict[tuple[int, int, int], dict[str, np.ndarray]] = {}


def trained_on(spark: SparkSession, pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The model fitted in a task, where numpy has one thread; a driver fits it once."""
    key = (pages, epochs, seed)
    if key not in _WEIGHTS:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                w = trained(*key).w
                yield pa.RecordBatch.from_arrays([pa.array(list(w)), pa.array([list(map(int, v.shape)) for v in w.values()], pa.list_(pa.int32())), pa.array([v.tobytes() for v in w.values()])], ["name", "shape", "data"])

        found = spark.range(1, numPartitions=1).mapInArrow(run, "name string, shape array<int>, data binary").collect()  # some 50 000 weights
        _WEIGHTS[key] = {r["name"]: np.frombuffer(bytes(r["data"]), np.float32).reshape(r["shape"]) for r in found}
    return Labeller(_WEIGHTS[key])


def main_text(pages: list[str], model: Labeller, known: dict[str, int] | None = None) -> list[str]:
    cut = [pieces_of(p) for p in pages]
    labels = model.label([vectors_of(c, known) for c in cut])
    return ["\n".join(p.text for p, keep in zip(c, y, strict=True) if keep) for c, y in zip(cut, labels, strict=True)]


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row; ``url`` is null where there is none.

    A null or empty page, and one without main text, gives an empty text. The whole
    page is read, whatever its length; repeated rows are extracted again.
    """
    weights = (model or trained_on(pages.sparkSession)).w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, known = Labeller(weights), {}
        for batch in batches:
            texts = []
            for at in range(0, batch.num_rows, 256):
                texts += main_text([t or "" for t in batch.column(2).slice(at, 256).to_pylist()], labeller, known)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    bound_batches(pages.sparkSession)
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
