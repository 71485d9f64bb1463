"""Main text of web pages by a recurrent labeller of blocks.

A page is cut into its leaf blocks. A bidirectional LSTM in numpy reads, for each block, its path of tags, classes and ids and
its words, both as sums of hashed vectors, and a few measures; it labels every block with the whole page in view. It learns
from pages with telling tags (<article>, <nav>, class names), whose paths are also renamed and thinned at random and which get
foreign blocks, so that pages without such tags can be read too.
"""

from __future__ import annotations

import html
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.llm.tasks import released

SAMPLE_PAGES = 250  # pages with telling names that the labeller is fitted on, chosen by their hash
PATH_BUCKETS, WORD_BUCKETS, PATH_SIZE, WORD_SIZE, MEASURES, HIDDEN = 2048, 1024, 12, 6, 4, 12
STEPS, BATCH = 400, 20
PAGES_AT_ONCE = 256

_INSIDE = r"""(?>[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+"""  # of a tag: a quoted value is one unit, whatever it holds
_TOKEN = re.compile(
    # A raw name ends at a blank, / or >: <svg-icon> is an element of its own. Only a self-closed svg has no content.
    rf"<!--.*?(?:-->|\Z)|<svg(?=[\s/]){_INSIDE}(?<=/)>"
    rf"|<(?P<raw>script|style|title|textarea|template|noscript|iframe|svg|select)(?=[\s/>]){_INSIDE}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<more>{_INSIDE})>|<[!?/][^>]*>|[^<]+|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAMING = frozenset(("class", "id", "role", "itemprop"))
# Elements that part blocks, and the open elements that a new one ends.
BLOCKS = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul button label").split())
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
CONTENT = ("article", "main", "content", "post", "entry", "story", "articlebody", "body-text", "article-body", "post-body", "entry-content", "post-content", "main-content", "page-content", "text")
BOILER = (
    "nav", "footer", "aside", "form", "button", "label", "ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "menu", "navigation", "navbar", "breadcrumb", "breadcrumbs",
    "sidebar", "widget", "related", "recommended", "share", "social", "comment", "comments", "comment-list", "reply", "disqus", "cookie", "cookies", "cookie-notice", "notice", "consent",
    "newsletter", "subscribe", "signup", "login", "search", "pagination", "copyright", "legal", "site-header", "site-footer", "header", "masthead", "topbar", "popup", "modal", "hidden", "skip-link", "tags", "author-box")


def blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(path, text, share of link characters) of every leaf block with text; a path holds tags, classes, ids and roles."""
    out, stack, buffer = [], [], []
    linked = total = 0
    in_link = False

    def flush():
        nonlocal linked, total
        if total:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                out.append((tuple(n for _, names in stack for n in names), text, linked / total))
        buffer.clear()
        linked = total = 0

    for m in _TOKEN.finditer(page):
        tag = m["tag"]
        if tag is None:
            if m["raw"] is None:
                piece = m[0]
                if piece[0] != "<" or piece == "<":
                    buffer.append(piece)
                    total += len(piece)
                    linked += len(piece) if in_link else 0
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not m["end"]
        elif tag == "br":
            buffer.append(" ")
        elif tag in BLOCKS:
            flush()
            if m["end"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            elif tag not in VOID:
                closed = ENDS.get(tag, ())
                while stack and stack[-1][0] in closed:
                    stack.pop()
                names = [tag]
                if m["more"]:
                    for n in _ATTRIBUTE.finditer(m["more"]):
                        kind, value = n[1].lower(), (n[2] or n[3] or n[4] or "").lower()
                        names += ["hidden"] if kind == "hidden" or kind == "aria-hidden" and value == "true" else value.split() if kind in _NAMING else []
                stack.append((tag, names))
    flush()
    return out


def telling(path: tuple[str, ...]) -> int | None:
    """1 for a path under content and not under anything else, 0 under a menu and the like, None where the names do not tell.

    A header inside the content is the article's own. Parts of a name (share-price) tell only where no whole name does.
    """
    content = False
    for n in path:
        if n in CONTENT:
            content = True
        elif n in BOILER and not (content and n == "header"):
            return 0
    parted = any(p in BOILER for n in path if n not in CONTENT and n not in BOILER for p in re.split(r"[-_]", n))
    return (None if parted else 1) if content else 0 if parted else None


def _bucket(name: str, size: int) -> int:
    return zlib.crc32(name.encode()) % size


def features(page: list[tuple[tuple[str, ...], str, float]]) -> list[tuple[list[int], list[int], list[float]]]:
    """Buckets of the path (names and their parts) and of the words, and four measures, of each block."""
    out = []
    for k, (path, text, linked) in enumerate(page):
        names = {p for n in path for p in (n, *(f"~{x}" for x in re.split(r"[-_]", n) if x != n))}
        words = text.split()
        out.append(([_bucket(n, PATH_BUCKETS) for n in names], [_bucket(w.lower(), WORD_BUCKETS) for w in words],
                    [min(len(words), 100) / 50, linked, k / max(len(page) - 1, 1), float(text[-1] in ".!?…")]))
    return out


class BlockNetwork:
    """Bidirectional LSTM over the blocks of a page, with one logistic output for each block."""

    def __init__(self, seed: int = 5):
        import numpy as np

        r = np.random.default_rng(seed)
        size, h = PATH_SIZE + WORD_SIZE + MEASURES, HIDDEN
        w = {"path": r.normal(0, 0.3, (PATH_BUCKETS, PATH_SIZE)), "word": r.normal(0, 0.3, (WORD_BUCKETS, WORD_SIZE)), "bias": np.zeros(1)}
        for d in "fb":
            w |= {f"x{d}": r.normal(0, 1 / np.sqrt(size), (size, 4 * h)), f"u{d}": r.normal(0, 1 / np.sqrt(h), (h, 4 * h)), f"c{d}": np.zeros(4 * h), f"o{d}": r.normal(0, 1 / np.sqrt(h), (h, 1))}
            w[f"c{d}"][h:2 * h] = 1  # forget gates start open
        w["direct"] = np.zeros((size, 1))
        self.weights = {n: v.astype(np.float32) for n, v in w.items()}

    def _inputs(self, pages):
        """(blocks, inputs, and the buckets with their rows) of pages of features, one page after another."""
        import numpy as np

        w = self.weights
        flat = [b for p in pages for b in p]
        x = np.zeros((len(flat), PATH_SIZE + WORD_SIZE + MEASURES), np.float32)
        where = []
        for place, (at, size, name) in enumerate(((0, PATH_SIZE, "path"), (PATH_SIZE, WORD_SIZE, "word"))):
            counts = np.array([len(b[place]) for b in flat], np.int64)
            ids = np.fromiter((i for b in flat for i in b[place]), np.int64, int(counts.sum()))
            rows = np.repeat(np.arange(len(flat)), counts)
            # Paths are short and add up; words are averaged, so that a block of one word many times is no outlier.
            scale = (1 / np.maximum(counts, 1) ** (0.5 if name == "path" else 1.0)).astype(np.float32)[rows]
            starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
            some = counts > 0
            if some.any():
                x[some, at:at + size] = np.add.reduceat(w[name][ids] * scale[:, None], starts[some], axis=0)
            where.append((ids, rows, scale))
        x[:, PATH_SIZE + WORD_SIZE:] = np.array([b[2] for b in flat], np.float32).reshape(-1, MEASURES)
        return x, where

    def _run(self, x, lengths, keep: bool = False):
        """Scores of all blocks; with `keep` also what the gradient needs. Lanes are pages, padded at their ends."""
        import numpy as np

        w, h, lanes, time = self.weights, HIDDEN, len(lengths), max(lengths)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        scores = x @ w["direct"][:, 0] + w["bias"][0]
        memory = {}
        for d in "fb":
            pre = x @ w[f"x{d}"] + w[f"c{d}"]
            state, cell = np.zeros((lanes, h), np.float32), np.zeros((lanes, h), np.float32)
            for t in range(time):
                live = np.flatnonzero(lengths > t)
                at = starts[live] + (t if d == "f" else lengths[live] - 1 - t)
                old_state, old_cell = state[live], cell[live]
                g = pre[at] + old_state @ w[f"u{d}"]
                gates = 1 / (1 + np.exp(-g[:, :3 * h]))
                cand = np.tanh(g[:, 3 * h:])
                new_cell = gates[:, h:2 * h] * old_cell + gates[:, :h] * cand
                squashed = np.tanh(new_cell)
                new_state = gates[:, 2 * h:] * squashed
                state[live], cell[live] = new_state, new_cell
                scores[at] += (new_state @ w[f"o{d}"])[:, 0]
                if keep:
                    memory[d, t] = (live, at, old_state, old_cell, gates, cand, squashed, new_state)
        return scores, memory

    def scores(self, pages) -> list:
        """Scores of the blocks of each page; above 0 is main text."""
        import numpy as np

        lengths = np.array([len(p) for p in pages], np.int64)
        if not lengths.sum():
            return [np.empty(0, np.float32) for _ in pages]
        return np.split(self._run(self._inputs(pages)[0], lengths)[0], np.cumsum(lengths)[:-1])

    def gradients(self, pages, labels, known):
        import numpy as np

        w, h = self.weights, HIDDEN
        lengths = np.array([len(p) for p in pages], np.int64)
        x, where = self._inputs(pages)
        scores, memory = self._run(x, lengths, keep=True)
        p = 1 / (1 + np.exp(-scores))
        scale = 1 / max(1.0, float(known.sum()))
        loss = -float((known * (labels * np.log(p + 1e-9) + (1 - labels) * np.log(1 - p + 1e-9))).sum()) * scale
        out = ((p - labels) * known * scale).astype(np.float32)
        grads = {n: np.zeros_like(v) for n, v in w.items()}
        grads["bias"][0] = out.sum()
        grads["direct"] = x.T @ out[:, None]
        dx = out[:, None] * w["direct"][:, 0][None, :]
        for d in "fb":
            down_state, down_cell = np.zeros((len(lengths), h), np.float32), np.zeros((len(lengths), h), np.float32)
            for t in range(max(lengths) - 1, -1, -1):
                live, at, old_state, old_cell, gates, cand, squashed, new_state = memory[d, t]
                i, f, o = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
                grads[f"o{d}"] += new_state.T @ out[at][:, None]
                g = down_state[live] + out[at][:, None] * w[f"o{d}"][:, 0][None, :]
                c = down_cell[live] + g * o * (1 - squashed**2)
                pre = np.concatenate([c * cand * i * (1 - i), c * old_cell * f * (1 - f), g * squashed * o * (1 - o), c * i * (1 - cand**2)], axis=1)
                grads[f"u{d}"] += old_state.T @ pre
                grads[f"x{d}"] += x[at].T @ pre
                grads[f"c{d}"] += pre.sum(axis=0)
                dx[at] += pre @ w[f"x{d}"].T
                down_state[live], down_cell[live] = pre @ w[f"u{d}"].T, c * f
        for (ids, rows, part), (first, size, name) in zip(where, ((0, PATH_SIZE, "path"), (PATH_SIZE, WORD_SIZE, "word"))):
            np.add.at(grads[name], ids, dx[rows, first:first + size] * part[:, None])
        return loss, grads

    def fit(self, pages: list, steps: int = STEPS, seed: int = 13) -> BlockNetwork:
        """Adam on renamed pages; `pages` are lists of blocks."""
        import numpy as np

        r = np.random.default_rng(seed)
        told = [[telling(path) for path, _, _ in p] for p in pages]
        prose = [b[1] for p, v in zip(pages, told) for b, y in zip(p, v) if y == 1] or ["text"]
        first = {n: np.zeros_like(v) for n, v in self.weights.items()}
        second = {n: np.zeros_like(v) for n, v in self.weights.items()}
        for step in range(1, steps + 1):
            batch, labels = [], []
            for k in r.integers(0, len(pages), BATCH):
                page, want = renamed(pages[k], told[k], prose, r)
                batch.append(features(page))
                labels += want
            y = np.array([v or 0 for v in labels], np.float32)
            _, grads = self.gradients(batch, y, np.array([v is not None for v in labels], np.float32))
            rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
            for n, g in grads.items():
                np.clip(g, -0.1, 0.1, out=g)
                first[n] += 0.1 * (g - first[n])
                second[n] += 0.01 * (g * g - second[n])
                self.weights[n] -= rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)
        return self


# How titles and the blocks of an article can be set.
TITLES = (("h1",), ("h2",), ("h3",), ("header", "h1"), ("header", "entry-header", "h1"), ("div", "h1"))
SHAPES = (("div",), *[("ul", "li"), ("ol", "li")] * 2, ("blockquote",), ("blockquote", "p"), ("table", "tr", "td"), ("table", "tbody", "tr", "td"), ("dl", "dd"), ("pre",), ("figure", "figcaption"),
          ("h2",), ("h3",), ("h4",), ("section", "p"), ("header", "p"))


def renamed(page: list, told: list, prose: list[str], r) -> tuple[list, list]:
    """A page under other names: telling names are replaced or left out at random, and blocks of other kinds come in."""
    base = ("html", "body")
    names = [("article",), ("main",), ("div", str(r.choice(CONTENT))), ("section", str(r.choice(CONTENT))), ("main", "article"), ("div",), ("div", "div"), ("div", f"x{r.integers(0, 40)}"), ()]
    content = names[r.integers(0, len(names))]
    plain = r.random() < 0.4
    shape, run = ("p",), 0
    out, want = [], []

    def foreign(count: int, inside: tuple[str, ...] = ()) -> None:
        name = str(r.choice(BOILER))
        if r.random() < 0.25:
            name = f"{name}-{misleading()}"
        path = (*base, *inside, *((name,) if r.random() < 0.3 else ("div", name)), *(("p",) if r.random() < 0.6 else ("ul", "li")))
        linked = 0.4
        if r.random() < 0.15:  # a layout without names, of short links
            path, linked = (*base, *((), ("table", "tr"), ("table", "tbody", "tr"), ("center",))[r.integers(0, 4)], str(r.choice(("td", "div", "p")))), 1.0
        for _ in range(count):
            words = prose[r.integers(0, len(prose))].split()
            size = len(words) if linked < 1 and r.random() < 0.5 else int(r.integers(1, 8 if linked < 1 else 4))
            out.append((path, " ".join(words[:size]), float(r.random() < linked)))
            want.append(0)

    def misleading() -> str:
        return f"x{r.integers(0, 40)}"

    if r.random() < 0.5:
        foreign(int(r.integers(1, 5)))
    swap = {n: str(r.choice(BOILER)) for n in {n for path, _, _ in page for n in path if n in BOILER}}
    for block, label in zip(page, told):
        path, text, linked = block
        if not plain and label == 1:
            last = (path[-1],)
            if path[-1] == "h1":
                last = TITLES[r.integers(0, len(TITLES))]
            elif path[-1] == "p":
                if run:  # lists and tables are runs of short blocks
                    run -= 1
                elif r.random() < 0.2:
                    shape, run = SHAPES[r.integers(0, len(SHAPES))], int(r.integers(0, 5))
                else:
                    shape = ("p",)
                last = shape
                if shape != ("p",) and r.random() < 0.5:
                    text = " ".join(text.split()[:int(r.integers(2, 12))])
            if r.random() < 0.06:
                last = (*last, f"{r.choice(BOILER)}-{misleading()}")
            path = (*base, *content, *last)
        elif not plain and label == 0 and r.random() < 0.5:
            path = tuple(swap.get(n, n) for n in path)
        out.append((path, text, linked))
        want.append(label)
        if label == 1 and r.random() < 0.02:
            foreign(int(r.integers(1, 3)), content)
    if r.random() < 0.5:
        foreign(int(r.integers(1, 6)), content if r.random() < 0.3 else ())
    if r.random() < 0.4:  # words never seen before
        out = [(path, " ".join(w[0] + w[-2:0:-1] + w[1:][-1:] for w in text.split()), linked) for path, text, linked in out]
    return out, want


def _tells() -> str:
    """A pattern of pages with an element that holds content by its name."""
    names = "|".join(CONTENT)
    return rf"""(?i)<(article|main)[\s>]|\b(class|id|role|itemprop)\s*=\s*["']?([^"'<>]*\s)?({names})["'\s>]"""


def sample_pages(pages: DataFrame, size: int) -> list[str]:
    """Up to `size` different pages, the lowest hashes of those with telling names, or of all if none has any.

    A share of the pages is looked at, and more if it holds too few; no more than some `size` pages ever leave Spark's tasks.
    """
    n = pages.count()
    place = F.pmod(F.xxhash64("page_id", "html"), F.lit(2**62))
    for told in (F.col("html").rlike(_tells()), F.length("html") > 0):
        share = 8 * size / max(n, 1)
        while True:
            some = pages.filter((place < int(min(share, 1) * 2**62)) & told).select(place.alias("place"), "html").distinct()
            rows = some.orderBy("place", "html").limit(size).collect()
            if len(rows) == size or share >= 1:
                break
            share *= 8
        if rows:
            return [r["html"] for r in rows]
    return []


def fit_blocks(pages: DataFrame, sample: int = SAMPLE_PAGES) -> BlockNetwork | None:
    """Fits on up to `sample` pages whose names tell; None if there is no page at all."""
    cut = [c for c in map(blocks, sample_pages(pages, sample)) if c]
    return BlockNetwork().fit(cut) if cut else None


def main_text(page: list, scores) -> str:
    return "\n".join(text for (_, text, _), s in zip(page, scores) if s > 0)


def _extract_task(network: BlockNetwork | None):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(k, PAGES_AT_ONCE)
                cut = [blocks(h) if h else [] for h in part.column("html").to_pylist()]
                order = sorted(range(len(cut)), key=lambda i: len(cut[i]))
                texts = [""] * len(cut)
                if network is not None:
                    for i, s in zip(order, network.scores([features(cut[i]) for i in order])):
                        texts[i] = main_text(cut[i], s)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return run


def extract_text(pages: DataFrame, network: BlockNetwork | None) -> DataFrame:
    """page_id, url, text, n_chars of every page. Null, empty and blank pages give an empty text; repeated rows get the same.

    Other columns are left out, whatever their names. An empty table gives an empty result.
    """
    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(released(_extract_task(network)), f"page_id {kind}, url string, text string, n_chars long")
