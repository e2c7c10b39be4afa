"""Main text of web pages by a recurrent block labeller.

A page is a sequence of text blocks.  Of each the labeller reads a vector of its tag path (hashed names of all
elements around it and of its own), of its words (hashed), and of plain facts such as length and link share; two
LSTMs, one from the top and one from the bottom, carry what they have seen to every block, so each block is judged in
the context of the whole page.  Blocks judged main text are joined in page order.

The labeller learns from at most TRAIN_PAGES pages of the table itself.  Where a page names its parts (``article``,
``main``, ``nav``, ``footer`` ...), these are labels; in addition its paragraphs are set anew in made-up layouts, with
other element names and with menus, notices, forms, sidebars, adverts and reader comments, so that the labeller
cannot lean on one layout's names.  Every page is then read whole.
"""

from __future__ import annotations

import io
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytetext import column_bytes, fold_case, span_hashes, word_spans
from .htmlblocks import OWN_BUCKETS, PATH_BUCKETS, Block, blocks

#: Bounds of the pages that are learnt from: how many, and how long one may be.
TRAIN_PAGES, TRAIN_CHARS = 300, 100_000
#: Made-up layouts, the least number of pages with told labels (they are repeated), and how they are learnt.
LAYOUTS, TOLD, EPOCHS, BATCH_PAGES, RATE, SEED = 700, 200, 8, 32, 0.008, 7
WORD_BUCKETS, FACTS, HIDDEN = 64, 12, 24
#: Blocks whose vectors are held at once.
WINDOW = 20_000
INPUTS = PATH_BUCKETS + OWN_BUCKETS + WORD_BUCKETS + FACTS

#: Words of element names that tell a part of a page, and elements that hold main text.
ASIDE = frozenset(
    "nav aside footer form ad ads advert advertisement banner sidebar comments comment cookie menu newsletter "
    "promo related share social sponsored breadcrumb".split())
MAIN = frozenset(["article", "main"])

#: Names and phrases of the made-up layouts, by part of a page.
WRAPPERS = ["page", "wrap", "container", "row", "col", "inner", "layout", "site", "grid", ""]
BODIES = [("article", ""), ("main", ""), ("div", "content"), ("div", "post-body"), ("div", "entry-content"),
          ("section", "story"), ("div", "main-text"), ("div", "article-body"), ("td", ""), ("div", ""), ("section", "")]
PARTS = {
    "header": ([("header", ""), ("div", "header"), ("div", "masthead"), ("div", "top"), ("div", "site-title")],
               ["Home", "Welcome", "News and views every day", "Log in", "Search"]),
    "menu": ([("nav", ""), ("div", "menu"), ("ul", "menu"), ("div", "navigation"), ("div", "navbar"), ("ul", "")],
             ["Home", "About", "Contact", "Sports", "Politics", "Archive", "Shop", "Blog"]),
    "trail": ([("div", "breadcrumb"), ("ol", "breadcrumbs"), ("nav", "crumbs")], ["Home", "Archive", "News"]),
    "advert": ([("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "sponsored"), ("div", "promo"),
                ("aside", "banner")], ["Advertisement", "Buy now and save", "Sponsored", "Special offer for you"]),
    "notice": ([("div", "cookie"), ("div", "notice"), ("div", "consent"), ("div", "gdpr-banner"), ("div", "alert"),
                ("section", "cookies")],
               ["We use cookies to give you the best experience.", "Accept all", "Read our privacy policy.", "OK"]),
    "sidebar": ([("aside", ""), ("div", "sidebar"), ("div", "side"), ("div", "widget"), ("div", "rail")],
                ["Popular", "Latest posts", "Tags", "Most read", "Categories"]),
    "form": ([("form", ""), ("div", "newsletter"), ("div", "subscribe"), ("form", "signup"), ("form", "search")],
             ["Subscribe to our newsletter", "Your email", "Sign up", "Send", "Name", "Password"]),
    "related": ([("section", "related"), ("div", "more"), ("div", "recommended"), ("div", "related-posts")],
                ["Related articles", "Read more", "You may also like", "More from this author"]),
    "share": ([("div", "share"), ("ul", "social"), ("div", "sharing")], ["Share", "Tweet", "Print", "Email this"]),
    "comments": ([("section", "comments"), ("div", "comments"), ("div", "discussion"), ("div", "replies"),
                  ("ol", "commentlist"), ("div", "responses")],
                 ["3 comments", "Reply", "Leave a comment", "Report", "2 hours ago", "says:"]),
    "footer": ([("footer", ""), ("div", "footer"), ("div", "bottom"), ("div", "copyright"), ("div", "legal")],
               ["&copy; All rights reserved.", "Privacy policy", "Terms of use", "Imprint", "Contact us"]),
}
#: Text for layouts where a table has no main text at all.
PROSE = ["The river rose in the night, and by morning the lower fields stood under water.",
         "Nobody in the village had seen anything like it, although older people spoke of a flood long ago.",
         "A short remark.", "By noon the rain had stopped; the road, however, remained closed until the next day."]


def vectors(some: list[Block], place: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One row per block; ``place`` and ``count`` are its number on its page and the page's blocks."""
    n = len(some)
    x = np.zeros((n, INPUTS), np.float32)
    for low, buckets in ((0, [b.path for b in some]), (PATH_BUCKETS, [b.own for b in some])):
        sizes = [len(b) for b in buckets]
        cols = np.fromiter((c for b in buckets for c in b), np.int64, sum(sizes))
        x[np.repeat(np.arange(n), sizes), low + cols] = 1
    data, at = column_bytes(pa.array([b.text for b in some], pa.large_string()))
    starts, ends, rows = word_spans(data, at)
    low = PATH_BUCKETS + OWN_BUCKETS
    if len(starts):
        cols = (span_hashes(fold_case(data), starts, ends) % np.uint64(WORD_BUCKETS)).astype(np.int64)
        bags = np.bincount(rows * WORD_BUCKETS + cols, minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS)
        words = np.maximum(np.bincount(rows, minlength=n), 1)
        x[:, low:low + WORD_BUCKETS] = np.sqrt(bags / words[:, None])
    else:
        words = np.ones(n)
    chars = np.array([len(b.text) for b in some], np.float32)
    marks = np.add.reduceat(np.r_[(data == 44) | (data == 46), False].astype(np.int64), at[:-1]) if n else 0
    digits = np.add.reduceat(np.r_[(data >= 48) & (data <= 57), False].astype(np.int64), at[:-1]) if n else 0
    facts = [np.log1p(chars) / 6, np.log1p(words) / 4, [b.linked / len(b.text) for b in some],
             [b.stressed / len(b.text) for b in some], [b.heading for b in some],
             [b.text[-1] in ".!?:;\"'" for b in some], marks / words, digits / np.maximum(chars, 1),
             chars / words / 10, place / count, np.log1p(count) / 5, np.ones(n)]
    x[:, low + WORD_BUCKETS:] = np.array([np.asarray(f, np.float32) for f in facts]).T
    return x


class Labeller:
    """A bidirectional LSTM over blocks, as plain arrays."""

    NAMES = ("wx", "u0", "u1", "v", "b")

    def __init__(self, **arrays: np.ndarray):
        self.p = arrays

    @classmethod
    def fresh(cls, seed: int) -> Labeller:
        rnd = np.random.default_rng(seed)
        wx = rnd.normal(0, 0.1, (INPUTS, 8 * HIDDEN))
        wx[-1, HIDDEN:2 * HIDDEN] = wx[-1, 5 * HIDDEN:6 * HIDDEN] = 1  # remember at first
        u = [rnd.normal(0, HIDDEN ** -0.5, (HIDDEN, 4 * HIDDEN)) for _ in range(2)]
        arrays = {"wx": wx, "u0": u[0], "u1": u[1], "v": rnd.normal(0, 0.1, 2 * HIDDEN), "b": np.zeros(1)}
        return cls(**{k: a.astype(np.float32) for k, a in arrays.items()})

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Labeller:
        with np.load(io.BytesIO(raw)) as arrays:
            return cls(**{k: arrays[k] for k in cls.NAMES})

    def _pass(self, way: int, xw: np.ndarray, at: list[np.ndarray], h: np.ndarray, c: np.ndarray,
              notes: list | None = None) -> np.ndarray:
        """Hidden vectors in one direction; step t handles the rows ``at[t]``, ever fewer.  ``h`` and ``c`` go on
        from where they are; ``notes`` gets what learning needs."""
        u, k = self.p[f"u{way}"], HIDDEN
        out = np.zeros((len(xw), k), np.float32)
        for rows in at:
            n = len(rows)
            before_h, before_c = h[:n].copy(), c[:n].copy()
            a = xw[rows] + before_h @ u
            gates = 1 / (1 + np.exp(-np.clip(a[:, :3 * k], -30, 30)))
            i, f, o, g = gates[:, :k], gates[:, k:2 * k], gates[:, 2 * k:], np.tanh(a[:, 3 * k:])
            c[:n] = f * before_c + i * g
            flat = np.tanh(c[:n])
            h[:n] = o * flat
            out[rows] = h[:n]
            if notes is not None:
                notes.append((rows, i, f, o, g, before_c, flat, before_h))
        return out

    @staticmethod
    def _steps(lengths: np.ndarray, way: int) -> list[np.ndarray]:
        """Rows of each step over pages that lie one after the other, the longest first."""
        starts = np.cumsum(lengths) - lengths
        alive = [int(np.searchsorted(-lengths, -t, "left")) for t in range(int(lengths[0]) if len(lengths) else 0)]
        if way == 0:
            return [starts[:n] + t for t, n in enumerate(alive)]
        return [starts[:n] + lengths[:n] - 1 - t for t, n in enumerate(alive)]

    def logits(self, x: np.ndarray, lengths: np.ndarray, notes: list | None = None) -> np.ndarray:
        """Score of each block of pages that lie one after the other, the longest first."""
        k, total = HIDDEN, np.full(len(x), self.p["b"][0], np.float32)
        for way in (0, 1):
            xw = x @ self.p["wx"][:, way * 4 * k:(way + 1) * 4 * k]
            zeros = np.zeros((len(lengths), k), np.float32)
            more = None if notes is None else []
            out = self._pass(way, xw, self._steps(lengths, way), zeros, zeros.copy(), more)
            total += out @ self.p["v"][way * k:(way + 1) * k]
            if notes is not None:
                notes.append((out, more))
        return total

    def long_logits(self, page: list[Block]) -> np.ndarray:
        """Scores of one page's blocks, vectors of WINDOW blocks at a time."""
        k, n = HIDDEN, len(page)
        total = np.full(n, self.p["b"][0], np.float32)
        for way in (0, 1):
            h, c = np.zeros((1, k), np.float32), np.zeros((1, k), np.float32)
            lows = range(0, n, WINDOW)
            for low in lows if way == 0 else reversed(lows):
                some = page[low:low + WINDOW]
                x = vectors(some, np.arange(low, low + len(some)), np.full(len(some), n))
                xw = x @ self.p["wx"][:, way * 4 * k:(way + 1) * 4 * k]
                out = self._pass(way, xw, self._steps(np.array([len(some)]), way), h, c)
                total[low:low + len(some)] += out @ self.p["v"][way * k:(way + 1) * k]
        return total

    def gradients(self, x: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[dict, float]:
        """Gradient of the mean logistic loss, and the loss."""
        notes: list = []
        z = self.logits(x, lengths, notes)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = float(-np.log(np.where(labels, p, 1 - p) + 1e-7).mean())
        dz, k = ((p - labels) / len(x)).astype(np.float32), HIDDEN
        grads = {"wx": np.zeros_like(self.p["wx"]), "v": np.zeros_like(self.p["v"]), "b": np.array([dz.sum()])}
        for way, (out, steps) in enumerate(notes):
            grads["v"][way * k:(way + 1) * k] = out.T @ dz
            d_out = dz[:, None] * self.p["v"][way * k:(way + 1) * k]
            u, du = self.p[f"u{way}"], np.zeros_like(self.p[f"u{way}"])
            d_xw = np.zeros((len(x), 4 * k), np.float32)
            dh, dc = (np.zeros((len(lengths), k), np.float32) for _ in range(2))
            for rows, i, f, o, g, before_c, flat, before_h in reversed(steps):
                n = len(rows)
                here = d_out[rows] + dh[:n]
                cell = here * o * (1 - flat * flat) + dc[:n]
                da = np.concatenate([cell * g * i * (1 - i), cell * before_c * f * (1 - f), here * flat * o * (1 - o),
                                     cell * i * (1 - g * g)], axis=1)
                dc[:n], dh[:n] = cell * f, da @ u.T
                du += before_h.T @ da
                d_xw[rows] = da
            grads["wx"][:, way * 4 * k:(way + 1) * 4 * k] = x.T @ d_xw
            grads[f"u{way}"] = du
        return grads, loss

    def learn(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, seed: int) -> None:
        """Adam over pages of (vectors, labels), in batches of similar length."""
        rnd = random.Random(seed)
        mean, square = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = sorted(range(len(pages)), key=lambda k: len(pages[k][0]) * rnd.uniform(0.8, 1.25))
            batches = [order[k:k + BATCH_PAGES] for k in range(0, len(order), BATCH_PAGES)]
            rnd.shuffle(batches)
            for batch in batches:
                some = sorted((pages[k] for k in batch), key=lambda p: -len(p[0]))
                grads, _ = self.gradients(np.concatenate([x for x, _ in some]), np.array([len(x) for x, _ in some]),
                                          np.concatenate([y for _, y in some]))
                step += 1
                rate = RATE * (1 - epoch / epochs) ** 0.5
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.001 * (g * g - square[k])
                    self.p[k] -= (rate * (mean[k] / (1 - 0.9 ** step))
                                  / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def layout(rnd: random.Random, story: list[str], others: list[str]) -> str:
    """A made-up page around the paragraphs of ``story``, whose elements are marked ``data-main``."""

    def sentence() -> str:
        return _escaped(rnd.choice(others))

    def few_words() -> str:
        return _escaped(" ".join(rnd.choice(others).split()[:rnd.randint(1, 5)]))

    def opened(tag: str, name: str, main: bool = False) -> str:
        name = name if rnd.random() < 0.8 else f"x{rnd.randrange(1000)}"
        key = rnd.choice(["class", "class", "id"])
        return f"<{tag}" + (f' {key}="{name}"' if name else "") + (' data-main="1">' if main else ">")

    def part(kind: str) -> str:
        (tag, name), phrases = rnd.choice(PARTS[kind][0]), PARTS[kind][1]
        rows = []
        for _ in range(rnd.randint(1, 6)):
            phrase = rnd.choice(phrases) if rnd.random() < 0.5 else few_words()
            if kind in ("menu", "trail", "share", "header"):
                rows.append(f'<li><a href="/{rnd.randrange(99)}">{phrase}</a></li>')
            elif kind == "comments":
                said = "".join(f"<p>{sentence()}</p>" for _ in range(rnd.randint(1, 2)))
                rows.append(f'{opened("div", "comment")}<span>{few_words()}</span>{said}<a href="#">Reply</a></div>')
            elif kind == "form":
                rows.append(rnd.choice([f"<label>{phrase}</label><input>", f"<p>{phrase}</p>", f"<button>{phrase}</button>"]))
            elif kind in ("related", "sidebar"):
                rows.append(rnd.choice([f'<li><a href="/x">{phrase}</a></li>', f"<p>{sentence()}</p>", f"<h3>{phrase}</h3>",
                                        f'<p><a href="/y">{sentence()}</a></p>']))
            else:
                rows.append(rnd.choice([phrase, f"<p>{phrase}</p>", f"<p>{sentence()}</p>", f'<a href="/p">{phrase}</a>']))
                if kind in ("advert", "footer", "notice"):
                    if rnd.random() < 0.3:
                        rows.append(f"<p>{sentence()}</p>")
                    break
        head = f"<h3>{rnd.choice(phrases)}</h3>" if kind in ("comments", "related", "sidebar") else ""
        return opened(tag, name) + head + "".join(rows) + f"</{tag}>"

    def maybe(chances: dict[str, float]) -> str:
        return "".join(part(kind) for kind, chance in chances.items() if rnd.random() < chance)

    paragraph = rnd.choice(["p", "p", "p", "div", "open"])
    body = []
    if rnd.random() < 0.7:
        body.append(f"<h1>{few_words()}</h1>")
    for text in story:
        words = _escaped(text)
        if rnd.random() < 0.15:
            body.append(f"<h2>{few_words()}</h2>")
        if rnd.random() < 0.1:
            words = f'<a href="/z">{few_words()}</a> ' + words
        tag = rnd.choice(["blockquote", "li", "pre"]) if rnd.random() < 0.08 else paragraph
        body.append(f"<p>{words}" if tag == "open" else f"<{tag}>{words}</{tag}>")
    tag, name = rnd.choice(BODIES)
    inside = [opened("div", "", True) + x + "</div>" for x in body] if rnd.random() < 0.1 else body
    main = opened(tag, name, True) + "".join(inside) + f"</{tag}>"
    if rnd.random() < 0.3 and len(story) > 2:  # something else between two halves
        half = len(inside) // 2
        main = (opened(tag, name) + opened("div", "", True) + "".join(inside[:half]) + "</div>"
                + maybe({"advert": 0.6, "related": 0.3, "form": 0.3}) + opened("div", "", True) + "".join(inside[half:])
                + "</div>" + maybe({"share": 0.3, "comments": 0.4}) + f"</{tag}>")
    wraps = [rnd.choice(WRAPPERS) for _ in range(rnd.randint(0, 3))]
    before = maybe({"notice": 0.3, "header": 0.5, "menu": 0.7, "advert": 0.4, "trail": 0.2, "sidebar": 0.25, "form": 0.2})
    after = maybe({"share": 0.25, "form": 0.2, "related": 0.3, "comments": 0.4, "sidebar": 0.25, "advert": 0.3, "notice": 0.15,
                   "menu": 0.15, "footer": 0.7})
    return ("<body>" + "".join(opened("div", w) for w in wraps) + before + main + after + "</div>" * len(wraps))


def _told(block: Block) -> bool:
    """Main text by the names of the elements around it."""
    names = {t.lstrip(".") for t in block.tags}
    return not names.isdisjoint(MAIN) and names.isdisjoint(ASIDE)


def learnt(pages: list[str], seed: int = SEED) -> Labeller:
    """A labeller learnt from raw pages."""
    rnd, stories, examples = random.Random(seed), [], []
    for page in pages:
        found = blocks(page)
        told = [_told(b) for b in found]
        if any(told):
            examples.append((found, told))
            stories.append([b.text for b, t in zip(found, told) if t])
        elif long := [b.text for b in found if b.text.count(" ") >= 15 and b.linked < len(b.text) / 3]:
            stories.append(long)
    stories = stories or [PROSE]
    others = sorted({t for s in stories for t in s if t.count(" ") < 120}) or PROSE
    made = [blocks(layout(rnd, stories[k % len(stories)][:rnd.randint(1, 30)], others)) for k in range(LAYOUTS)]
    examples *= -(-TOLD // len(examples)) if examples else 1
    examples += [(found, [b.main for b in found]) for found in made if found]
    data = [(vectors(f, np.arange(len(f)), np.full(len(f), len(f))), np.array(t, np.float32)) for f, t in examples]
    model = Labeller.fresh(seed)
    model.learn(data, EPOCHS, seed)
    return model


def main_texts(model: Labeller, pages: list[str]) -> list[str]:
    """Main text of each page."""
    texts: list[str] = [""] * len(pages)
    waiting: list[tuple[int, list[Block]]] = []
    held = 0

    def judged(some: list[tuple[int, list[Block]]]) -> None:
        some.sort(key=lambda e: -len(e[1]))
        lengths = np.array([len(f) for _, f in some])
        place = np.concatenate([np.arange(n) for n in lengths])
        x = vectors([b for _, f in some for b in f], place, np.repeat(lengths, lengths))
        main, low = model.logits(x, lengths) > 0, 0
        for k, found in some:
            texts[k] = "\n".join(b.text for b, m in zip(found, main[low:low + len(found)]) if m)
            low += len(found)

    for k, page in enumerate(pages):
        found = blocks(page)
        if len(found) > WINDOW:
            texts[k] = "\n".join(b.text for b, z in zip(found, model.long_logits(found)) if z > 0)
        elif found:
            if held + len(found) > WINDOW:
                judged(waiting)
                waiting, held = [], 0
            waiting.append((k, found))
            held += len(found)
    if waiting:
        judged(waiting)
    return texts


def fit(pages: DataFrame) -> bytes:
    """The labeller's arrays, learnt by one task from the TRAIN_PAGES pages with the least hash of id and address."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = sorted(t for b in batches for t in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([learnt(some).to_bytes()], pa.binary())], ["arrays"])

    some = (pages.where(F.length("html").between(1, TRAIN_CHARS)).select("page_id", "url", "html")
            .orderBy(F.xxhash64("page_id", "url", "html"), "page_id").limit(TRAIN_PAGES).select("html"))
    row = some.repartition(1).mapInArrow(learn, "arrays binary").first()
    return row.arrays if row else learnt([]).to_bytes()


def extracted(pages: DataFrame, arrays: bytes) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page by a labeller's arrays."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller.from_bytes(arrays)
        for batch in batches:
            texts = main_texts(model, [p or "" for p in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
            .mapInArrow(read, "page_id long, url string, text string, n_chars long"))


def pages_table(pages: DataFrame) -> DataFrame:
    """Main text of every row of ``page_id, url, html``, learnt from some of the rows themselves.

    Null and empty html, and pages without main text, give an empty text; null ids and addresses stay null; repeated
    rows are read each for itself; a page of any length is read whole; other columns, whatever their names, are not
    read; an empty table gives no rows.
    """
    return extracted(pages, fit(pages))
