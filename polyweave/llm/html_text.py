"""Main text of web pages: blocks in page order, labelled by a bidirectional LSTM in numpy."""

from __future__ import annotations

import html
import io
import random
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

# ------------------------------------------------------------------------------ blocks

INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img input kbd mark nobr q rp rt ruby s samp "
             "small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose content is no text of the page
RAW = set("script style textarea noscript template svg math iframe object canvas select".split())
#: an opening tag of the left ends open elements of the right, up to the next box
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, **{t: {"p"} for t in "div ul ol h1 h2 h3 h4 h5 h6 article section main nav aside footer header form table "
                                 "blockquote pre figure dl hr address fieldset".split()}}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+(?:>|\Z)|</?[a-zA-Z][^>]*+(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    if not attributes or "=" not in attributes:
        return (tag,)
    words = [w for m in _NAMED.finditer(attributes) for w in _PART.findall((m[1] or m[2] or m[3] or "").lower())]
    return (tag, *("." + w for w in words))


def blocks_of_page(page: str) -> list[tuple[tuple, str, float]]:
    """``(path, text, share of link text)`` of every block that has text, in page order.

    Inline elements and comments do not end a block, a line break counts as white space.
    Character references are decoded, white space becomes one space, ends are trimmed.
    """
    out, stack, paths, parts = [], [], [()], []
    link = linked = total = 0

    def close():
        nonlocal linked, total
        if parts:
            text = "".join(parts)
            parts.clear()
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append((paths[-1], text, linked / max(1, total)))
        linked = total = 0

    def add(text):
        nonlocal linked, total
        parts.append(text)
        total += len(text)
        linked += len(text) * (link > 0)

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in RAW:
            if not m[1] and not (m[3] or "").endswith("/"):
                end = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
            if tag in ("select", "textarea", "iframe", "object"):
                add(" ")
        elif tag == "br":
            add(" ")
        elif tag in INLINE:
            if tag == "a":
                link = max(0, link - 1) if m[1] else link + 1
        elif m[1]:
            if tag in stack:
                close()
                while stack.pop() != tag:
                    paths.pop()
                paths.pop()
                link = 0
            elif tag == "p":
                close()
        else:
            close()
            link = 0
            ended = ENDS.get(tag, ())
            while stack and stack[-1] in ended:
                stack.pop()
                paths.pop()
            if tag not in VOID:
                stack.append(tag)
                paths.append((*paths[-1], _marks(tag, m[3] or "")))
    close()
    return out


# ---------------------------------------------------------------------------- features

MARKS, WORDS, MARK_DIM, WORD_DIM, HIDDEN, PLAIN = 1024, 1024, 16, 6, 20, 6
SIZE = MARK_DIM + WORD_DIM + PLAIN


class Hashed(dict):
    def __init__(self, size: int, limit: int = 200_000):
        super().__init__()
        self.size, self.limit = size, limit

    def __missing__(self, word: str) -> int:
        bucket = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.size
        if len(self) < self.limit:
            self[word] = bucket
        return bucket


class Features:
    """Hashed marks of the tag path, hashed words, and a few plain numbers of each block."""

    def __init__(self):
        self.marks, self.words = Hashed(MARKS), Hashed(WORDS)

    def __call__(self, blocks):
        n = len(blocks)
        marks = [[self.marks[m] for step in path for m in step] or [0] for path, _, _ in blocks]
        words = [list(map(self.words.__getitem__, text.split(" "))) for _, text, _ in blocks]
        plain = np.empty((n, PLAIN), np.float32)
        for i, (path, text, linked) in enumerate(blocks):
            count = len(words[i])
            plain[i] = (np.log1p(count) / 5, linked, i / n, text[-1] in ".!?…", len(path) / 10, np.log1p(len(text) / count) / 3)
        return marks, words, plain


def _bag(lists, table):
    """Mean table row of each list; and what the gradient needs."""
    flat = np.array(list(chain.from_iterable(lists)), np.int64)
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    starts = np.cumsum(sizes) - sizes
    return np.add.reduceat(table[flat], starts, axis=0) / sizes[:, None], (flat, sizes)


# -------------------------------------------------------------------------------- model

def initial(seed: int = 7) -> dict[str, np.ndarray]:
    rnd = np.random.default_rng(seed)
    model = {"marks": rnd.normal(0, 0.3, (MARKS, MARK_DIM)), "words": rnd.normal(0, 0.1, (WORDS, WORD_DIM)),
             "out": rnd.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(1)}
    for way in ("f", "b"):
        model[f"w{way}"] = rnd.normal(0, 1 / np.sqrt(SIZE + HIDDEN), (SIZE + HIDDEN, 4 * HIDDEN))
        model[f"c{way}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    return {k: v.astype(np.float32) for k, v in model.items()}


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x, real, weights, bias, trace=None):
    """One direction over ``x[time, page, feature]``; ``real`` is 0 where a page has ended."""
    steps, pages, _ = x.shape
    h = c = np.zeros((pages, HIDDEN), np.float32)
    out = np.empty((steps, pages, HIDDEN), np.float32)
    for t in range(steps):
        joined = np.concatenate([x[t], h], axis=1)
        gates = joined @ weights + bias
        i, f, o = (_sigmoid(gates[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(gates[:, 3 * HIDDEN:])
        keep = real[t][:, None]
        new_c = keep * (f * c + i * g) + (1 - keep) * c
        tanh_c = np.tanh(new_c)
        if trace is not None:
            trace.append((joined, i, f, o, g, c, tanh_c, keep))
        c = new_c
        h = keep * (o * tanh_c) + (1 - keep) * h
        out[t] = h
    return out


def _back(grad_out, trace, weights):
    steps, pages, _ = grad_out.shape
    dh = dc = np.zeros((pages, HIDDEN), np.float32)
    dx, dw, db = np.empty((steps, pages, SIZE), np.float32), np.zeros_like(weights), np.zeros(4 * HIDDEN, np.float32)
    for t in range(steps - 1, -1, -1):
        joined, i, f, o, g, c, tanh_c, keep = trace[t]
        dh = dh + grad_out[t]
        now, stay = dh * keep, dh * (1 - keep)
        dc = dc + now * o * (1 - tanh_c ** 2)
        live = dc * keep
        gates = np.concatenate([live * g * i * (1 - i), live * c * f * (1 - f), now * tanh_c * o * (1 - o), live * i * (1 - g ** 2)], axis=1)
        dw += joined.T @ gates
        db += gates.sum(0)
        dj = gates @ weights.T
        dx[t], dh = dj[:, :SIZE], dj[:, SIZE:] + stay
        dc = live * f + dc * (1 - keep)
    return dx, dw, db


def _padded(pages, model):
    """Features of several pages as ``[time, page, feature]``, the mask, and what gradients need."""
    marks, words, plain = ([x for p in pages for x in p[k]] for k in range(3))
    by_mark, mark_trace = _bag(marks, model["marks"])
    by_word, word_trace = _bag(words, model["words"])
    rows = np.concatenate([by_mark, by_word, np.array(plain, np.float32)], axis=1).astype(np.float32)
    sizes = [len(p[0]) for p in pages]
    where = (np.concatenate([np.arange(n) for n in sizes]), np.repeat(np.arange(len(pages)), sizes))
    x = np.zeros((max(sizes), len(pages), SIZE), np.float32)
    real = np.zeros(x.shape[:2], np.float32)
    x[where], real[where] = rows, 1
    return x, real, where, (mark_trace, word_trace)


def _both(x, real, model, traces=(None, None)):
    ahead = _run(x, real, model["wf"], model["cf"], traces[0])
    back = _run(x[::-1], real[::-1], model["wb"], model["cb"], traces[1])[::-1]
    return np.concatenate([ahead, back], axis=2)


def predict(pages, model) -> list[np.ndarray]:
    """Probability of main text for every block of every page (features as by ``Features``)."""
    x, real, (t, p), _ = _padded(pages, model)
    chance = _sigmoid(_both(x, real, model) @ model["out"] + model["bias"])
    return [chance[:len(page[0]), k] for k, page in enumerate(pages)]


def train(pages, labels, rounds: int = 14, batch: int = 24, rate: float = 0.01, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the mean log loss of all blocks of a batch of pages."""
    model, rnd = initial(seed), random.Random(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    order, step = list(range(len(pages))), 0
    for _ in range(rounds):
        rnd.shuffle(order)
        order.sort(key=lambda i: len(pages[i][0]) // 16)
        batches = [order[a:a + batch] for a in range(0, len(order), batch)]
        rnd.shuffle(batches)
        for chosen in batches:
            part = [pages[i] for i in chosen]
            x, real, where, bags = _padded(part, model)
            traces = ([], [])
            hidden = _both(x, real, model, traces)
            aim = np.zeros(real.shape, np.float32)
            aim[where] = np.concatenate([labels[i] for i in chosen])
            error = (_sigmoid(hidden @ model["out"] + model["bias"]) - aim) * real / real.sum()
            dh = error[..., None] * model["out"]
            dxf, dwf, dbf = _back(dh[..., :HIDDEN], traces[0], model["wf"])
            dxb, dwb, dbb = _back(dh[::-1, :, HIDDEN:], traces[1], model["wb"])
            rows = (dxf + dxb[::-1])[where]
            grads = {"out": (hidden * error[..., None]).sum((0, 1)), "bias": np.array([error.sum()]),
                     "wf": dwf, "cf": dbf, "wb": dwb, "cb": dbb}
            for name, (flat, sizes), part_rows in (("marks", bags[0], rows[:, :MARK_DIM]), ("words", bags[1], rows[:, MARK_DIM:MARK_DIM + WORD_DIM])):
                grads[name] = np.zeros_like(model[name])
                np.add.at(grads[name], flat, np.repeat(part_rows / sizes[:, None], sizes, axis=0))
            step += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                model[k] = (model[k] - rate * first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return model


# ------------------------------------------------------------------------ training pages

# Boxes as page authors name them, tag and class.
CONTENT = ("article main div.content div.post-body section.article div.entry-content article.post main.main-content div.story "
           "div.article-body section.text div#content").split()
AROUND = "div.wrapper div.page div.container div#root section.layout div.row div.column".split()
JUNK = {"menu": "nav ul.menu div.navbar header header.site-header div.breadcrumbs nav.pagination div.topbar div.header div.menu ul.nav".split(),
        "footer": "footer div.footer div.copyright footer.site-footer div#footer".split(),
        "side": "aside div.sidebar aside.related div.widget div.related-posts aside.toc div.recommended section.sidebar div.side".split(),
        "ad": "div.ad div.ads div.advert div.sponsored ins.adsbygoogle div.banner div.promo aside.ad section.advertisement".split(),
        "notice": "div.cookie div.cookie-banner div.notice div.consent div.alert div.newsletter div.popup section.notice p.notice aside.notice".split(),
        "comment": "section.comments div.comment ol.comment-list div.replies div.user-comments section.comment div.discussion ul.comments".split(),
        "form": "form form.search form.login form.subscribe form.contact div.form".split(),
        "share": "div.share div.social ul.share-links".split()}
CONTENT_TAGS = {"article", "main"}
JUNK_TAGS = {"nav", "footer", "aside", "header", "form", "head", "title", "button"}
JUNK_MARKS = {"." + w for group in JUNK.values() for box in group for w in _PART.findall(box.partition(".")[2])}


def weak_labels(blocks) -> list[int] | None:
    """Labels of a page that marks its article and other boxes by name; None if it does not."""
    if not any(step[0] in CONTENT_TAGS for path, _, _ in blocks for step in path):
        return None
    return [int(any(s[0] in CONTENT_TAGS for s in path) and not any(s[0] in JUNK_TAGS or JUNK_MARKS & set(s[1:]) for s in path))
            for path, _, _ in blocks]


def made_page(rnd: random.Random, pool: list[str]) -> tuple[str, list[int]]:
    """A page of random layout from the texts of ``pool``, and the label of each of its blocks."""
    labels, out = [], []

    def opened(box):
        tag, _, name = box.replace("#", ".#").partition(".")
        kind = "id" if name.startswith("#") else "class"
        extra = f' {kind}="{name.strip("#")}{rnd.choice(["", "", " x", " clearfix"])}"' if name else ""
        return f"<{tag}{extra}>", f"</{tag}>"

    def text(label, tag, words=None):
        said = rnd.choice(pool)
        if words:
            said = " ".join(said.split()[:words])
        said = html.escape(said or "x", quote=False)
        if tag == "li" or rnd.random() < 0.05:
            said = f'<a href="/{rnd.random()}">{said}</a>'
        out.append(f"<{tag}>{said}</{tag}>" if tag else said)
        labels.append(label)

    def junk(kind=None):
        kind = kind or rnd.choice(list(JUNK))
        start, end = opened(rnd.choice(JUNK[kind]))
        out.append(start)
        if start[1:].split()[0].rstrip(">") == "p" or kind in ("ad", "notice", "footer") and rnd.random() < 0.5:
            text(0, "")
        else:
            if rnd.random() < 0.3:
                text(0, rnd.choice(["h2", "h3", "h4"]), rnd.choice([1, 2, 4]))
            for _ in range(rnd.choice([1, 2, 3, 6])):
                if kind in ("menu", "share") or kind in ("side", "footer") and rnd.random() < 0.5:
                    text(0, "li", rnd.choice([1, 1, 2, 6]))
                elif kind == "form":
                    text(0, rnd.choice(["label", "button", "p", "legend"]), rnd.choice([1, 2, 5]))
                else:
                    text(0, rnd.choice(["p", "p", "p", "div", "li"]), rnd.choice([None, None, 5, 20]))
        out.append(end)

    out.append("<html><head>")
    if rnd.random() < 0.9:
        text(0, "title", 8)
    out.append("</head><body>")
    wraps = [opened(rnd.choice(AROUND)) for _ in range(rnd.choice([0, 0, 1, 2]))]
    out.extend(w[0] for w in wraps)
    for _ in range(rnd.choice([0, 1, 2, 3])):
        junk(rnd.choice(["menu", "menu", "ad", "notice", "form", "side"]))
    start, end = opened(rnd.choice(CONTENT))
    out.append(start)
    inner = opened(rnd.choice(CONTENT[2:])) if rnd.random() < 0.2 else ("", "")
    out.append(inner[0])
    if rnd.random() < 0.8:
        text(1, rnd.choice(["h1", "h1", "h2"]), rnd.choice([3, 8, 15]))
    for _ in range(rnd.choice([1, 2, 4, 8, 12])):
        if rnd.random() < 0.1:
            junk(rnd.choice(["ad", "share", "notice", "side", "form", "comment"]))
        text(1, rnd.choice(["p", "p", "p", "p", "p", "h2", "h3", "li", "blockquote", "pre", "td", "figcaption", "div"]), rnd.choice([None, None, None, 1, 3, 10]))
    if rnd.random() < 0.15:
        junk("comment")
    out += [inner[1], end]
    for _ in range(rnd.choice([0, 1, 2, 3])):
        junk(rnd.choice(["comment", "footer", "side", "ad", "share", "form"]))
    out += [w[1] for w in reversed(wraps)] + ["</body></html>"]
    return "".join(out), labels


#: pages that the model is fitted on, and their longest; as many pages again of random layout, times MADE
SAMPLE_PAGES, SAMPLE_CHARS, MADE = 240, 60_000, 3


def fit_pages(pages: list[str], seed: int = 11) -> dict[str, np.ndarray]:
    """The model from a sample of pages: those with named boxes, and pages of random layout whose
    blocks take their texts from the sample, so that words alone tell little."""
    rnd, features, x, y, pool = random.Random(seed), Features(), [], [], []
    for page in sorted(pages):
        blocks = blocks_of_page(page)[:400]
        pool += [text for _, text, _ in blocks][:40]
        labels = weak_labels(blocks) if blocks else None
        if labels is not None:
            x.append(features(blocks))
            y.append(np.array(labels, np.float32))
    pool = pool or ["Some words of a text.", "More", "Words again, and others."]
    for _ in range(MADE * max(len(x), SAMPLE_PAGES // 2)):
        page, labels = made_page(rnd, pool)
        blocks = blocks_of_page(page)
        if len(blocks) == len(labels):
            x.append(features(blocks))
            y.append(np.array(labels, np.float32))
    return train(x, y)


def packed(model) -> bytes:
    out = io.BytesIO()
    np.savez(out, **model)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as stored:
        return {k: stored[k] for k in stored.files}


def fit(pages: DataFrame) -> bytes:
    """The model (about 150 KB), fitted by one task on ``SAMPLE_PAGES`` pages of least hash."""
    row = F.xxhash64("page_id", F.length("html"))
    short = pages.where(F.length("html") <= SAMPLE_CHARS)  # also leaves out null pages
    ids = short.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES)
    sample = short.join(F.broadcast(ids), "page_id").select("html").orderBy(row).limit(2 * SAMPLE_PAGES)

    def run(batches):
        texts = [t for b in batches for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([packed(fit_pages(texts))], pa.binary())], ["model"])

    row = sample.repartition(1).mapInArrow(run, "model binary").first()
    return bytes(row["model"]) if row else packed(fit_pages([]))


# ---------------------------------------------------------------------------- extraction

#: blocks that go through the network at once
AT_ONCE = 20_000


def main_texts(pages: list[str], model, features: Features) -> list[str]:
    found = [blocks_of_page(p) for p in pages]
    order = sorted((i for i, b in enumerate(found) if b), key=lambda i: len(found[i]))
    out, at = [""] * len(pages), 0
    while at < len(order):
        take = 1
        while at + take < len(order) and (take + 1) * len(found[order[at + take]]) <= AT_ONCE:
            take += 1
        chosen = order[at:at + take]
        for i, chances in zip(chosen, predict([features(found[i]) for i in chosen], model)):
            out[i] = " ".join(text for (_, text, _), c in zip(found[i], chances) if c > 0.5)
        at += take
    return out


def extract(pages: DataFrame, model: bytes | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``, repeated or not.

    The text is that of the blocks labelled main text, in page order, joined by a space; null,
    empty and textless pages have the empty text.  Other columns are ignored.  Every block is
    labelled with the whole page as context, whatever its length.
    """
    model = model or fit(pages)

    def run(batches):
        network, features = unpacked(model), Features()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = main_texts(part.column(2).to_pylist(), network, features)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select("page_id", "url", text_bytes("html").cast("string").alias("html"))
    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
