"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

Every page becomes its sequence of leaf blocks.  A block's features are the tags and the class, id
and role words of its ancestors (grouped by meaning), and shape and wording of its text.  The field
has two labels, article and rest, and first-order transitions.  It is trained on labelled pages that
``labelled_pages`` writes from a rule (layouts, wrappers and fillers drawn with a fixed seed), by
gradient on the exact likelihood (forward-backward), and pages are decoded by Viterbi.  Training
takes a second or two on the driver and is the same whatever the input; the weights are a few KB.

Defined results: null html and pages without article text give an empty text; very long pages are
read whole; character references are decoded, white space inside a block becomes one space, blocks
are joined in page order by one space; repeated rows give equal results; an empty table gives an
empty table.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, prepare
from .htmlblocks import Block, blocks

REST, ARTICLE = 0, 1

#: What words in class, id and role names say (our own grouping).
NAMES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs pagination pager tabs toolbar toc topbar skip dropdown sitemap",
    "head": "header masthead banner logo brand hero branding sitename contentinfo strapline",
    "foot": "footer foot copyright colophon legal bottom imprint credits",
    "side": "sidebar side aside rail widget widgets related recommended recommend trending popular complementary secondary more tags teaser teasers readmore",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted affiliate dfp adsense commercial",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay dialog newsletter subscribe subscription paywall privacy toast warning disclaimer announcement banner hidden",
    "form": "form search login signup signin register contact input field fieldset subscribeform poll survey",
    "comment": "comment comments commentlist disqus reply replies respond discussion reviews review thread responses feedback reader readers",
    "share": "share sharing social follow twitter facebook tools print email buttons",
    "body": "article content main post entry story text blog copy prose page news single",
}
_GROUP: dict[str, list[str]] = {}
for _kind, _words in NAMES.items():
    for _word in _words.split():
        _GROUP.setdefault(_word, []).append(_kind)
BOILER = frozenset(NAMES) - {"body"}
#: Tags that say the same as a name does.
TAGS = {"nav": "menu", "header": "head", "footer": "foot", "aside": "side", "form": "form", "fieldset": "form",
        "label": "form", "button": "form", "select": "form", "option": "form", "legend": "form", "dialog": "notice",
        "article": "body", "main": "body"}
#: Wording that rest blocks have in some European languages (our own choice).
PHRASES = {
    "legal": ["©", "(c)", "copyright", "all rights", "rechte vorbehalten", "droits réservés", "derechos reservados"],
    "cookie": ["cookie", "privacy", "datenschutz", "confidentialité", "privacidad"],
    "join": ["subscribe", "newsletter", "sign up", "login", "log in", "abonn", "suscr", "anmelden", "s'inscrire"],
    "advert": ["advert", "sponsor", "anzeige", "publicité", "publicidad", "buy now", "special offer"],
    "talk": ["comment", "reply", "antwort", "kommentar", "répondre", "respond", "comentari"],
    "more": ["read more", "related", "share", "follow us", "mehr lesen", "lire la suite", "leer más", "home", "menu", "search"],
}


@functools.lru_cache(maxsize=20_000)
def path_features(path: tuple) -> tuple[tuple[str, ...], bool]:
    """What a block's ancestors say, and whether they say nothing of its kind."""
    out: list[str] = ["bias"]
    kinds: list[str] = []
    for depth, (tag, words) in enumerate(reversed(path)):
        here = {g for w in words for g in _GROUP.get(w, ())}
        if tag in TAGS:
            here.add(TAGS[tag])
        # "comment-content" is a part of the comments, not of the article
        if len(here) > 1 and "body" in here and tag not in ("article", "main"):
            here.discard("body")
        kinds += sorted(here)
        out += [f"in:{tag}", *(f"near:{g}" for g in here if depth < 2)]
    own = path[-1][0] if path else "none"
    inside = set(kinds)
    out += [f"own:{own}", *(f"within:{g}" for g in inside)]
    boiler = inside & BOILER
    out.append(f"frame:{'body' in inside}:{bool(boiler)}")
    if "body" in inside and boiler:
        # which of both is nearer to the text
        nearest = next(k for k in kinds if k == "body" or k in BOILER)
        out.append(f"nearest:{'body' if nearest == 'body' else 'rest'}")
        if nearest != "body":
            out.append(f"inbody:{nearest}")
        if own in ("h1", "h2") and boiler <= {"head"}:
            out.append("title")
    return tuple(sorted(set(out))), not inside


def text_features(text: str, density: float, own: str, bare: bool, place: int, count: int) -> list[str]:
    """What a block's text, its share inside links and its place say."""
    n = len(text)
    out = [f"size:{min(9, n.bit_length())}",
           f"links:{0 if density < 0.05 else 1 if density < 0.3 else 2 if density < 0.8 else 3}"]
    stops = sum(text.count(c) for c in ".!?")
    out.append(f"stops:{min(3, stops)}")
    if text[-1:] in ".!?:":
        out.append("closed")
    if bare:
        out.append(f"bare:{own}:{n >= 60}:{density > 0.5}")
        if place == 0:
            out.append("first")
        if place == count - 1:
            out.append("last")
    if n < 400:
        low = text.lower()
        for name, phrases in PHRASES.items():
            if any(p in low for p in phrases):
                out.append(f"says:{name}" + (":short" if n < 120 else ""))
    return out


def features(block: Block, place: int, count: int) -> list[str]:
    """The names of the features that hold for one block."""
    fixed, bare = path_features(block.path)
    own = block.path[-1][0] if block.path else "none"
    return [*fixed, *text_features(" ".join(block.text.split()), block.linked / max(1, len(block.text)), own, bare, place, count)]


class Field:
    """A trained field: feature weights (m, 2), transitions (2, 2)."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.index, self.weights, self.steps = index, weights, steps
        self.paths: dict[tuple, tuple[float, float, bool]] = {}
        self.each = {f: tuple(weights[i].tolist()) for f, i in index.items()}

    def _sum(self, names) -> tuple[float, float]:
        known = [self.each[f] for f in names if f in self.each]
        return sum(a for a, _ in known), sum(b for _, b in known)

    def _emission(self, block: Block, text: str, place: int, count: int) -> tuple[float, float]:
        """The scores of both labels for one block; what its path adds is worked out once."""
        if block.path not in self.paths:
            if len(self.paths) > 20_000:
                self.paths.clear()
            names, bare = path_features(block.path)
            self.paths[block.path] = (*self._sum(names), bare)
        a, b, bare = self.paths[block.path]
        own = block.path[-1][0] if block.path else "none"
        c, d = self._sum(text_features(text, block.linked / max(1, len(block.text)), own, bare, place, count))
        return a + c, b + d

    def decode(self, page: list[Block]) -> list[int]:
        """The most likely labels of a page's blocks (Viterbi)."""
        return self.labelled(page)[1]

    def labelled(self, page: list[Block]) -> tuple[list[str], list[int]]:
        """The clean text and the most likely label of each block."""
        t = self.steps.tolist()
        score, back = None, []
        texts = [" ".join(b.text.split()) for b in page]
        for i, b in enumerate(page):
            e0, e1 = self._emission(b, texts[i], i, len(page))
            if score is None:
                score = (e0, e1)
                continue
            a, b_ = score
            from0, from1 = (a + t[0][0], b_ + t[1][0]), (a + t[0][1], b_ + t[1][1])
            back.append((int(from0[1] > from0[0]), int(from1[1] > from1[0])))
            score = (max(from0) + e0, max(from1) + e1)
        if score is None:
            return [], []
        label = int(score[1] > score[0])
        path = [label]
        for choice in reversed(back):
            label = choice[label]
            path.append(label)
        return texts, path[::-1]

    def text(self, page: str | None) -> str:
        """The article of a page."""
        return " ".join(t for t, y in zip(*self.labelled(blocks(page or ""))) if y == ARTICLE)


# -- labelled pages --------------------------------------------------------------------------------
class _Writer:
    """Writes one page and notes the label of each block."""

    def __init__(self, rng: random.Random):
        self.rng, self.html, self.labels = rng, [], []

    def words(self, n: int) -> list[str]:
        sounds = "ba re ti on the an er ste lo mi qu es cha ver du il ent so pra ne".split()
        return ["".join(self.rng.choices(sounds, k=self.rng.randint(1, 3))) for _ in range(n)]

    def sentence(self, low: int, high: int) -> str:
        return " ".join(self.words(self.rng.randint(low, high))).capitalize() + "."

    def prose(self) -> str:
        kind = self.rng.random()
        if kind < 0.2:
            return self.sentence(1, 5)
        if kind < 0.3:
            return " | ".join(self.words(self.rng.randint(4, 30)))
        if kind < 0.35:
            return " ".join(self.words(self.rng.randint(3, 20))).upper()
        return " ".join(self.sentence(3, 18) for _ in range(self.rng.randint(1, 6)))

    def open(self, tag: str, name: str = "") -> None:
        how = self.rng.choice(["class", "class", "id"])
        self.html.append(f'<{tag} {how}="{name}">' if name else f"<{tag}>")

    def close(self, tag: str) -> None:
        self.html.append(f"</{tag}>")

    def leaf(self, tag: str, text: str, label: int, name: str = "", link: bool = False) -> None:
        if not text.strip():
            return
        self.open(tag, name)
        self.html.append(f'<a href="#">{text}</a>' if link else text)
        if tag != "p" or self.rng.random() < 0.8:
            self.close(tag)
        self.labels.append(label)


def _box(w: _Writer, kind: str, plain: bool) -> None:
    """One region that is not the article."""
    r = w.rng
    name = r.choice(NAMES[kind].split())
    if kind in ("side", "advert", "share") and r.random() < 0.3:
        name += r.choice(["-box", "_block", " col", "-wrap", " module"])
    tags = {"menu": ["nav", "ul", "div"], "head": ["header", "div"], "foot": ["footer", "div"], "side": ["aside", "div", "section"],
            "form": ["form", "div"], "comment": ["section", "div", "ol"], "notice": ["div", "section", "dialog"]}.get(kind, ["div", "aside", "p"])
    tag = r.choice(tags)
    if plain:
        tag, name = ("div" if kind not in ("menu", "form") else {"menu": "ul", "form": "form"}[kind]), ""
    elif tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.5:
        name = ""
    said = {"foot": "&copy; 2020 ", "notice": r.choice(["We use cookies. ", "Subscribe to our newsletter. ", ""]),
            "advert": r.choice(["Advertisement ", "Sponsored ", "", ""]), "comment": r.choice(["", "Reply: "])}.get(kind, "")
    if tag == "p":
        w.leaf("p", said + w.sentence(3, 12), REST, name)
        return
    w.open(tag, name)
    if kind in ("menu", "share") or kind == "side" and r.random() < 0.5:
        inner = tag if tag in ("ul", "ol") else "ul"
        if inner != tag:
            w.open(inner)
        for _ in range(r.randint(2, 7)):
            w.leaf("li", " ".join(w.words(r.randint(1, 4 if kind != "side" else 9))).capitalize(), REST, link=r.random() < 0.9)
        if inner != tag:
            w.close(inner)
    elif kind == "form":
        w.leaf("label", " ".join(w.words(r.randint(1, 3))), REST)
        w.html.append('<input type="text">')
        w.leaf("button", r.choice(["Search", "Sign up", "Send", "Log in"]), REST)
        if r.random() < 0.4:
            w.leaf("p", w.sentence(4, 14), REST)
    elif kind == "comment":
        w.leaf(r.choice(["h2", "h3"]), r.choice(["Comments", "Reader comments", "Discussion", w.sentence(1, 3)]), REST)
        for _ in range(r.randint(1, 5)):
            w.open(r.choice(["div", "li", "article"]), "" if plain else r.choice(["comment", "comment-body", "reply", "comment-content"]))
            if r.random() < 0.5:
                w.leaf("div", " ".join(w.words(2)), REST, "" if plain else "author")
            for _ in range(r.randint(1, 2)):
                w.leaf("p", w.prose(), REST)
            w.close("div")
        if r.random() < 0.4:
            _box(w, "form", plain)
    else:
        if kind == "head":
            w.leaf(r.choice(["div", "h1", "p", "a"]) if not plain else "div", " ".join(w.words(r.randint(1, 4))), REST, link=r.random() < 0.5) \
                if r.random() < 0.8 else None
            if r.random() < 0.5:
                _box(w, "menu", plain)
        many = r.randint(1, 3)
        for _ in range(many):
            if many == 1 and r.random() < 0.5:
                w.html.append(said + w.sentence(2, 16))
                w.labels.append(REST)
                # the run of text ends with its box
                break
            w.leaf(r.choice(["p", "div", "p", "h3"]), said + w.sentence(2, 16), REST, link=r.random() < 0.2)
    w.close(tag)


def _article(w: _Writer, plain: bool, tiny: bool) -> None:
    """The article; a tiny one is a few words in one paragraph."""
    r = w.rng
    tag, name = r.choice([("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"),
                          ("div", "post entry"), ("section", "story"), ("div", "main-text"), ("div", "page-content")])
    outer = r.choice([None, None, ("main", ""), ("div", "wrapper"), ("div", "container"), ("div", "main")])
    if plain:
        tag, name, outer = "div", r.choice(["", "c1", "x-7"]), None
    if outer:
        w.open(*outer)
    w.open(tag, name)
    header = not plain and r.random() < 0.25
    if header:
        w.open("header")
    if not tiny and r.random() < 0.85:
        w.leaf(r.choice(["h1", "h1", "h2"]), " ".join(w.words(r.randint(2, 12))).capitalize(), ARTICLE)
    if header:
        w.close("header")
    inside = not plain
    if tiny:
        w.leaf("p", " ".join(w.words(r.randint(1, 6))), ARTICLE)
    for _ in range(0 if tiny else r.randint(1, 14) if r.random() < 0.8 else r.randint(1, 2)):
        kind = r.random()
        if kind < 0.74:
            w.leaf("p", w.prose(), ARTICLE, link=r.random() < 0.04)
        elif kind < 0.8:
            w.leaf(r.choice(["h2", "h3", "h4"]), " ".join(w.words(r.randint(1, 6))).capitalize(), ARTICLE)
        elif kind < 0.86:
            w.open(lst := r.choice(["ul", "ol"]))
            for _ in range(r.randint(1, 5)):
                w.leaf("li", w.sentence(1, 12), ARTICLE, link=r.random() < 0.1)
            w.close(lst)
        elif kind < 0.89:
            w.leaf(r.choice(["blockquote", "pre", "figcaption", "div"]), w.prose(), ARTICLE)
        elif kind < 0.91:
            w.html.append("<table>")
            for _ in range(r.randint(1, 3)):
                w.html.append("<tr>")
                for _ in range(2):
                    w.leaf("td", " ".join(w.words(r.randint(1, 4))), ARTICLE)
                w.html.append("</tr>")
            w.html.append("</table>")
        elif inside:
            _box(w, r.choice(["advert", "advert", "share", "form", "notice", "side"]), False)
    if inside and r.random() < (0.6 if tiny else 0.25):
        _box(w, r.choice(["comment", "side", "share", "foot", "advert"]), False)
    w.close(tag)
    if outer:
        w.close(outer[0])


def labelled_pages(count: int = 400, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Pages with the label of each of their blocks."""
    out = []
    for i in range(count):
        r = random.Random(seed * 100_003 + i)
        w = _Writer(r)
        plain, alone = r.random() < 0.12, r.random() < 0.06
        w.html.append("<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>")
        for kind, share in (("notice", 0.25), ("head", 0.6), ("menu", 0.7), ("advert", 0.4), ("side", 0.25), ("form", 0.15)):
            if r.random() < share and not alone:
                _box(w, kind, plain)
        if alone or r.random() < 0.97:
            _article(w, plain, r.random() < 0.12)
        for kind, share in (("share", 0.2), ("advert", 0.3), ("side", 0.3), ("comment", 0.35), ("form", 0.2), ("foot", 0.85), ("notice", 0.2)):
            if r.random() < share and not alone:
                _box(w, kind, plain)
        w.html.append("</body></html>" if r.random() < 0.8 else "")
        page = "".join(w.html)
        if len(blocks(page)) == len(w.labels):
            out.append((page, w.labels))
    return out


def train(pages: list[tuple[str, list[int]]], ridge: float = 0.25, rounds: int = 250) -> Field:
    """Maximum likelihood with a Gaussian prior, by adaptive gradient steps."""
    seqs = [[features(b, i, len(found)) for i, b in enumerate(found)] for found in (blocks(p) for p, _ in pages)]
    index: dict[str, int] = {}
    for seq in seqs:
        for names in seq:
            for f in names:
                index.setdefault(f, len(index))
    n, longest, m = len(seqs), max(map(len, seqs)), len(index)
    x = np.zeros((n, longest, m), np.float32)
    y = np.zeros((n, longest), np.int64)
    live = np.zeros((n, longest), bool)
    for i, (seq, (_, labels)) in enumerate(zip(seqs, pages)):
        live[i, :len(seq)], y[i, :len(seq)] = True, labels
        for j, names in enumerate(seq):
            x[i, j, [index[f] for f in names]] = 1
    flat = x.reshape(-1, m)
    gold = np.eye(2, dtype=np.float32)[y] * live[..., None]
    gold_steps = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    gold_words = flat.T @ gold.reshape(-1, 2)
    w, s = np.zeros((m, 2)), np.zeros((2, 2))
    sums = [np.full_like(w, 1e-6), np.full_like(s, 1e-6)]
    for _ in range(rounds):
        e = (flat @ w.astype(np.float32)).reshape(n, longest, 2).astype(float)
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for t in range(1, longest):
            z = np.logaddexp(fwd[:, t - 1, 0, None] + s[0], fwd[:, t - 1, 1, None] + s[1]) + e[:, t]
            fwd[:, t] = np.where(live[:, t, None], z, fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            z = bwd[:, t + 1] + e[:, t + 1]
            z = np.logaddexp(s[:, 0] + z[:, 0, None], s[:, 1] + z[:, 1, None])
            bwd[:, t] = np.where(live[:, t + 1, None], z, 0)
        total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p = np.exp(fwd + bwd - total[:, None, None]) * live[..., None]
        pair = np.exp(fwd[:, :-1, :, None] + s + (e + bwd)[:, 1:, None, :] - total[:, None, None, None])
        pair_sum = (pair * live[:, 1:, None, None]).sum((0, 1))
        for k, (param, grad) in enumerate((
                (w, gold_words - flat.T @ p.reshape(-1, 2).astype(np.float32) - ridge * w), (s, gold_steps - pair_sum - ridge * s))):
            sums[k] += grad * grad
            param += 0.3 * grad / np.sqrt(sums[k])
    return Field(index, w, s)


@functools.cache
def default_field() -> Field:
    return train(labelled_pages())


def extract(pages: DataFrame, html: str = "html", page: str = "page_id", url: str = "url", field: Field | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    field = field or default_field()
    prepare(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256)
                texts = [field.text(h.as_py()) for h in rows.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("page"), rows.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    rows = pick(pages, page=pages[page].cast("long"), url=pages[url].cast("string"),
                html=F.coalesce(pages[html].cast("string"), F.lit("")))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
