"""Main text of article pages: a recurrent network labels every block of a page."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pagelex as lex
from .common import arrow_schema, small_batches, utf8

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<(/?)([a-zA-Z][\w:-]*)([^>]*)>""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ROWS = frozenset(("li", "dt", "dd", "tr", "td", "th"))
_PATH, _WORDS, _SHAPE = 64, 32, 8
_INPUT = _PATH + _WORDS + _SHAPE
_RAW, _QUIET, _INLINE, _VOID = frozenset(lex.RAW), frozenset(lex.QUIET), frozenset(lex.INLINE), frozenset(lex.VOID)
_ENDS, _OTHER, _ARTICLE = frozenset(lex.ENDS_PARAGRAPH), frozenset(lex.OTHER_PARTS), frozenset(lex.ARTICLE_PARTS)


@dataclass
class Block:
    """A leaf of the page: the words of its path (tags, and classes, ids and roles with a dot) and its text."""

    path: tuple[str, ...]
    text: str
    linked: int  # characters inside links


@dataclass
class _Quiet:
    """An open element whose content is not shown, and the page as it was before it."""

    name: str
    stack: list
    parts: list[str]
    out: int
    linked: int
    broken: bool = False  # a block has begun inside


def blocks(page: str) -> list[Block]:
    """Leaves with text in page order; references are decoded and white space is one space.

    Tags left open are closed where their parent ends, a paragraph also where the next one begins.
    What stands in an element that is not shown is left out up to its end tag; if that is missing,
    up to the next block or the end of its parent.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    quiet: list[_Quiet] = []
    anchor, linked, at = 0, 0, 0

    def end() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(Block(tuple(w for _, words in stack for w in words), text, linked))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and (not quiet or quiet[-1].broken):
            parts.append(text)
            linked += len(text) if anchor else 0

    def close(name: str, lowest: int = 0) -> None:
        for i in range(len(stack) - 1, lowest - 1, -1):
            if stack[i][0] == name:
                del stack[i:]
                while quiet and len(quiet[-1].stack) > i:  # its parent has ended: it has no end tag
                    quiet.pop()
                return

    def leave(name: str) -> None:
        """The end tag of a quiet element: the page goes on as before it."""
        nonlocal linked
        for k in range(len(quiet) - 1, -1, -1):
            if quiet[k].name == name:
                before = quiet[k]
                del quiet[k:], out[before.out :]
                stack[:], parts[:], linked = before.stack, before.parts, before.linked
                parts.append(" ")
                return

    while m := _MARKUP.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, rest = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if name in _RAW or name == "head":
            if not closing and not rest.endswith("/"):
                end_of = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end_of.end() if end_of else (at if name == "head" else len(page))
                add(" ")
        elif name in _QUIET:
            if closing:
                leave(name)
            elif not rest.endswith("/"):
                quiet.append(_Quiet(name, stack[:], parts[:], len(out), linked))
        elif name in _INLINE:
            if name == "a":
                anchor = 0 if closing else 1
            elif name == "br":
                add(" ")
        else:
            end()
            anchor = 0
            inside = len(quiet[-1].stack) if quiet and quiet[-1].name != "svg" else 0
            if closing:
                close(name)
            elif name not in _VOID:
                if name in _ENDS and any(t == "p" for t, _ in stack[inside:]):
                    close("p", inside)
                if name in ("li", "dt", "dd", "tr", "td", "th", "option") and len(stack) > inside and stack[-1][0] == name:
                    close(name, inside)
                if name not in ("html", "body"):
                    words = [x.lower() for g in _NAMED.findall(rest) for x in re.split(r"[^A-Za-z]+", "".join(g)) if x]
                    stack.append((name, (name, *("." + w for w in words))))
            if quiet and (name in _ENDS or name in _ROWS):
                quiet[-1].broken = True
    add(page[at:])
    end()
    return out


@lru_cache(maxsize=1 << 16)
def _slot(word: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode())
    return h % size, 1.0 if h >> 31 else -1.0


def vectors(page: list[Block]) -> np.ndarray:
    """Hashed tag path, all hashed words, and shape of each block; the words of a long block weigh less each."""
    x = np.zeros((len(page), _INPUT), np.float32)
    for i, b in enumerate(page):
        for w in b.path:
            at, sign = _slot(w, _PATH)
            x[i, at] += sign
        words = b.text.split()
        sums = [0.0] * _WORDS
        for w in words:
            at, sign = _slot(w.lower(), _WORDS)
            sums[at] += sign
        x[i, _PATH : _PATH + _WORDS] = np.array(sums) * (8 / max(64, len(words)))
        n = len(b.text)
        x[i, _PATH + _WORDS :] = (
            np.log1p(n) / 5, np.log1p(len(words)) / 4, b.linked / max(1, n), b.text[-1] in ".!?", n < 30, i / max(1, len(page) - 1), len(b.path) / 8, b.path[-1:] == ("p",),
        )
    return x


def teach(block: Block) -> float:
    """Label by the names on the path: 1 for the article, 0 for other parts."""
    names = [w.lstrip(".") for w in block.path]
    inside = next((i for i, w in enumerate(names) if w in _ARTICLE), None)
    other = [w for i, w in enumerate(names) if w in _OTHER and not (w == "header" and inside is not None and inside < i)]
    if other:
        return 0.0
    if inside is not None:
        return 1.0
    return float(names[-1:] and names[-1] in ("p", "h1", "h2", "h3", "pre", "blockquote") and block.linked < len(block.text) / 2 or False)


def disguised(page: list[Block], labels: np.ndarray, rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The same page in another layout: parts renamed, and further parts made of its own words put in.

    So the network also meets layouts that the sample does not have, and has to use the neighbours
    of a block as well as its names.
    """
    names = list(lex.OTHER_PARTS)
    holders = [("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".post"), ("section", ".entry"), ("div", ".main", "div", ".article", ".body"), ("div",)]
    holder = holders[rng.integers(len(holders))]
    renamed: dict[tuple[str, ...], tuple[str, ...]] = {}
    out, marks = [], []

    def part(n: int) -> None:
        tag = ("div", "section", "aside", "form", "ul")[rng.integers(5)]
        head = (tag, "." + names[rng.integers(len(names))]) if tag != "aside" or rng.random() < 0.5 else ("aside",)
        leaf = ("p", "li", "h3", "div", "span")[rng.integers(5)]
        inside = rng.random() < 0.3
        for _ in range(n):
            source = page[rng.integers(len(page))].text.split()
            at, size = rng.integers(max(1, len(source))), int(rng.integers(1, 40))
            text = " ".join(source[at : at + size]) or "x"
            out.append(Block((*(holder if inside else ()), *head, leaf), text, len(text) if rng.random() < 0.3 else 0))
            marks.append(0.0)

    for i, (b, y) in enumerate(zip(page, labels, strict=True)):
        if i and labels[i] != labels[i - 1] and rng.random() < 0.5:
            part(int(rng.integers(1, 5)))
        if y:
            kept = tuple(w for w in b.path if w.lstrip(".") not in _ARTICLE)
            out.append(Block((*holder, *kept), b.text, b.linked))
        else:
            key = b.path[:1]
            if key not in renamed:
                renamed[key] = ("div", "." + names[rng.integers(len(names))]) if rng.random() < 0.6 else key
            out.append(Block((*renamed[key], *b.path[1:]), b.text, b.linked))
        marks.append(y)
    if rng.random() < 0.5:
        part(int(rng.integers(1, 6)))
    return out, np.array(marks, np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output for every block."""

    def __init__(self, hidden: int = 24, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"] = (rng.normal(0, 1, (_INPUT + hidden, 4 * hidden)) / np.sqrt(_INPUT + hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1  # remember at first
            self.p[f"b{d}"] = bias
        self.p["out"] = (rng.normal(0, 1, 2 * hidden) / np.sqrt(2 * hidden)).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, tape: list | None) -> np.ndarray:
        n, steps, h = x.shape[0], x.shape[1], self.hidden
        w, b = self.p[f"w{d}"], self.p[f"b{d}"]
        own = x @ w[:_INPUT] + b
        state, cell, out = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, steps, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = own[:, t] + state @ w[_INPUT:]
            gates, fresh = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            m = mask[:, t : t + 1]
            new = f * cell + i * fresh
            lit = np.tanh(new)
            if tape is not None:
                tape.append((t, i, f, o, fresh, cell, lit, state, m))
            cell = m * new + (1 - m) * cell
            state = m * (o * lit) + (1 - m) * state
            out[:, t] = state
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, tapes: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([self._run(x, mask, d, tapes.setdefault(d, []) if tapes is not None else None) for d in "fb"], axis=2)
        return both @ self.p["out"] + self.p["bias"], both

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        tapes: dict[str, list] = {}
        z, both = self.logits(x, mask, tapes)
        dz = (_sigmoid(z) - y) * mask / mask.sum()
        g = {"out": np.einsum("ntk,nt->k", both, dz), "bias": np.array([dz.sum()], np.float32)}
        h = self.hidden
        for k, d in enumerate("fb"):
            w = self.p[f"w{d}"]
            above = dz[:, :, None] * self.p["out"][k * h : (k + 1) * h]
            dw, db = np.zeros_like(w), np.zeros(4 * h, np.float32)
            ds, dc = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
            for t, i, f, o, fresh, cell, lit, state, m in reversed(tapes[d]):
                ds = ds + above[:, t]
                inner, dc_new = m * ds, m * dc
                dc_new = dc_new + inner * o * (1 - lit * lit)
                dgate = np.concatenate([dc_new * fresh * i * (1 - i), dc_new * cell * f * (1 - f), inner * lit * o * (1 - o), dc_new * i * (1 - fresh * fresh)], axis=1)
                dw[:_INPUT] += x[:, t].T @ dgate
                dw[_INPUT:] += state.T @ dgate
                db += dgate.sum(axis=0)
                ds = dgate @ w[_INPUT:].T + (1 - m) * ds
                dc = dc_new * f + (1 - m) * dc
            g[f"w{d}"], g[f"b{d}"] = dw, db
        return g

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, seed: int = 5, batch: int = 32, rate: float = 0.01) -> None:
        """Adam steps over batches of pages of similar length."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for _ in range(epochs):
            for k in rng.permutation(len(groups)):
                x, mask = padded([pages[i][0] for i in groups[k]])
                y = np.zeros(mask.shape, np.float32)
                for row, i in enumerate(groups[k]):
                    y[row, : len(pages[i][1])] = pages[i][1]
                step += 1
                for name, g in self.gradient(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    m[name] += 0.1 * (g - m[name])
                    v[name] += 0.01 * (g * g - v[name])
                    self.p[name] = (self.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def label(self, pages: list[np.ndarray], cells: int = 1 << 13) -> list[np.ndarray]:
        """Probability of each block; pages of similar length run together, at most ``cells`` blocks or one page at a time."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((i for i, x in enumerate(pages) if len(x)), key=lambda i: len(pages[i]))
        while order:
            longest = len(pages[order[-1]])
            group = order[-max(1, cells // longest) :]
            del order[-len(group) :]
            x, mask = padded([pages[i] for i in group])
            z = _sigmoid(self.logits(x, mask)[0])
            for row, i in enumerate(group):
                out[i] = z[row, : len(pages[i])]
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((len(pages), steps, _INPUT), np.float32), np.zeros((len(pages), steps), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)] = p
        mask[i, : len(p)] = 1
    return x, mask


def fit_labeller(pages: DataFrame, *, html: str = "html", sample_pages: int = 512, layouts: int = 3, epochs: int = 16, window: int = 200) -> Labeller:
    """Network trained on about ``sample_pages`` different pages drawn by a hash of their markup.

    No page comes with labels, so blocks are taught by the names on their paths, on the page itself
    and in ``layouts`` other layouts of it. Training runs in one task over the bounded sample; of a
    page with more than ``window`` blocks one window is used. A page counts once, however often it
    is repeated. An empty table gives the untrained network.
    """
    rows = pages.select(F.col(html).cast("string").alias("html")).where(F.length("html") > 0)
    digest = F.xxhash64("html")
    n = rows.select(digest.alias("digest")).distinct().count()
    share = min(1.0, sample_pages / max(1, n))
    # copies are merged in every task, and in the shuffle of the drawn pages
    drawn = rows.where(F.pmod(digest, F.lit(1 << 20)) < int(share * (1 << 20))).distinct()

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(3)
        examples = []
        for batch in batches:
            for text in utf8(batch.column("html")):
                page = blocks(text.decode(errors="replace"))
                labels = np.array([teach(b) for b in page], np.float32)
                at = int(rng.integers(0, max(1, len(page) - window + 1)))
                page, labels = page[at : at + window], labels[at : at + window]
                if page:
                    examples.append((vectors(page), labels))
                    for _ in range(layouts):
                        other, marks = disguised(page, labels, rng)
                        examples.append((vectors(other[: 2 * window]), marks[: 2 * window]))
        network = Labeller()
        if examples:
            network.train(examples, epochs)
        names = list(network.p)
        yield pa.RecordBatch.from_pydict({"name": names, "value": [network.p[k].ravel().astype(float).tolist() for k in names]})

    network = Labeller()
    for r in drawn.orderBy("html").coalesce(1).mapInArrow(train, "name string, value array<double>").collect():  # one set of weights
        network.p[r["name"]] = np.array(r["value"], np.float32).reshape(network.p[r["name"]].shape)
    return network


def extract_content(pages: DataFrame, network: Labeller, *, keys: tuple[str, ...] = ("url",), html: str = "html", threshold: float = 0.5) -> DataFrame:
    """``keys``, content, n_chars: the blocks labelled as article, whole, in page order, joined by an empty line.

    Every block of a page is labelled in the context of the whole page. One row per input row, no
    shuffle; repeated rows are labelled alike, very long pages whole, and columns beyond ``keys``
    are left behind. Null and empty pages, and pages without an article block, have empty content;
    an empty table gives no rows.
    """
    rows = pages.select(*keys, F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    network = pages.sparkSession.sparkContext.broadcast(network)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            parsed = [blocks(t.decode(errors="replace")) for t in utf8(batch.column("html"))]
            labels = network.value.label([vectors(p) for p in parsed])
            texts = ["\n\n".join(b.text for b, y in zip(p, ys, strict=False) if y >= threshold) for p, ys in zip(parsed, labels, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keys, "content", "n_chars"]
            )

    return rows.mapInArrow(extract, arrow_schema(rows, keys, ("content", T.StringType()), ("n_chars", T.LongType())))
