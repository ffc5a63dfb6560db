"""Main text of HTML pages by a recurrent block labeller.

A page is read into its leaf blocks in order. Each block is a vector of its tag path (hashed names,
classes and ids of the open elements), its hashed words and a few counts. A bidirectional LSTM reads the
whole sequence, so every block is judged with all of the page in view, and marks main text.

The network is trained where the query starts, in NumPy, on generated layouts with known labels (a few
hundred pages, seeded): it depends on no corpus and reruns give the same weights.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_DIM, WORD_DIM, HIDDEN = 192, 24, 16
N_NUMBERS = 5
TRAIN_PAGES, EPOCHS, BATCH = 640, 7, 32
LONG_PAGE = 4096  # blocks; a page with more is read in parts
CELLS = 16_384  # blocks, padding included, in one pass of the network

# Element groups of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("head title noscript template select option datalist textarea button svg math object iframe canvas audio video map".split())
ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table tbody thead tfoot menu".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style)\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-z].*\Z""",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
PIECE = re.compile(r"[a-z0-9]+")
BLANK = re.compile(r"[ \t\n\x0b\x0c\r]+")


@lru_cache(maxsize=100_000)
def _slot(name: str) -> int:
    return 1 << zlib.crc32(name.encode()) % PATH_DIM


class Path(NamedTuple):
    """A tag path as what the network reads of it: each element adds to that of its parent, so a path costs
    no more than its last element, however deep it is."""

    slots: int = 0  # bits: names, neighbouring names and marks on the path
    depth: int = 0
    last: str = ""

    def down(self, marks: list[str]) -> "Path":
        slots, before = self.slots, self.last
        for n in marks:
            slots |= _slot(n)
            if before:
                slots |= _slot(f"{before}>{n}")
            if "." in n:  # class, id and role marks count wherever they stand
                slots |= _slot(n.split(".", 1)[1])
            before = n
        return Path(slots, self.depth + len(marks), before)


def leaf_blocks(html: str | None) -> list[tuple[Path, str, int]]:
    """(tag path, text, characters inside links) of every leaf block with text, in page order.

    Markup that never ends, as in a page cut off, is dropped up to the end; end tags without a start are
    ignored. References are decoded, then white space is one space.
    """
    out: list[tuple[Path, str, int]] = []
    stack: list[tuple[str, Path]] = []  # open block elements and their paths
    opened: Counter[str] = Counter()  # how many of each name are open
    parts: list[str] = []
    linked = unseen = in_link = 0

    def close():
        nonlocal parts, linked
        if parts:
            text = BLANK.sub(" ", entities.unescape("".join(parts))).strip(" ")
            if text:
                out.append((stack[-1][1] if stack else Path(), text, min(linked, len(text))))
        parts, linked = [], 0

    def pop():
        nonlocal unseen
        n, _ = stack.pop()
        opened[n] -= 1
        unseen -= n in UNSEEN
        return n

    def add(text):
        nonlocal linked
        if text and not unseen:
            parts.append(text)
            linked += len(text) if in_link else 0

    if not html:
        return out
    at = 0
    for m in TOKEN.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        ends = m[2] == "/"
        if name in INLINE:
            if name == "a":
                in_link = 0 if ends else 1
            elif name == "br":
                add(" ")
            continue
        if name in VOID:
            if name == "hr":
                close()
            continue
        close()
        in_link = 0
        if ends:
            if opened[name]:
                while pop() != name:
                    pass
            continue
        if opened["p"]:  # a block ends an open paragraph
            while pop() != "p":
                pass
        shut = ENDS_ITSELF.get(name)
        if shut and any(opened[n] for n in shut):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in LISTS:
                    break
                if stack[i][0] in shut:
                    while len(stack) > i:
                        pop()
                    break
        if m[4].rstrip().endswith("/") and name in ("path", "circle", "rect", "line"):
            continue
        marks = [name]
        if m[4]:
            for key, *value in ATTRIBUTE.findall(m[4]):
                marks += [f"{key.lower()[0]}.{p}" for p in PIECE.findall("".join(value).lower())]
        stack.append((name, (stack[-1][1] if stack else Path()).down(marks)))
        opened[name] += 1
        unseen += name in UNSEEN
    add(html[at:])
    close()
    return out


@lru_cache(maxsize=50_000)
def _path_slots(path: Path) -> np.ndarray:
    slots = path.slots | (_slot(f"last:{path.last}") if path.last else 0)
    return np.array([i for i in range(PATH_DIM) if slots >> i & 1], np.int64)


_word_slot: dict[str, int] = {}


def features(blocks: list[tuple[Path, str, int]], first: int = 0, end: int | None = None) -> np.ndarray:
    """What the network reads of the blocks of a page from ``first`` to ``end``."""
    part = blocks[first:end]
    x = np.zeros((len(part), PATH_DIM + WORD_DIM + N_NUMBERS), np.float32)
    for i, (path, text, linked) in enumerate(part):
        x[i, _path_slots(path)] = 1.0
        words = text.split(" ")
        if len(_word_slot) > 200_000:
            _word_slot.clear()
        at = [_word_slot[w] if w in _word_slot else _word_slot.setdefault(w, zlib.crc32(w.lower().encode()) % WORD_DIM) for w in words]
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(at, minlength=WORD_DIM) / (2.0 * len(words) ** 0.5)
        x[i, -N_NUMBERS:] = (np.log1p(len(words)) / 4, linked / len(text), min(path.depth, 12) / 12, (first + i) / len(blocks), text[-1:] in ".!?")
    return x


# ---- the network -------------------------------------------------------------------------------


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _lstm(x, w, u, b, mask, keep=False):
    """x (T, B, D) to hidden states (T, B, H); masked steps pass the state on."""
    return _scan(x @ w + b, u, mask, keep)


def _scan(z_in, u, mask, keep=False):
    t, n, _ = z_in.shape
    h_dim = u.shape[0]
    h, c = np.zeros((n, h_dim), np.float32), np.zeros((n, h_dim), np.float32)
    hs, saved = np.zeros((t, n, h_dim), np.float32), []
    for i in range(t):
        z = z_in[i] + h @ u
        ifo, g = _sigmoid(z[:, : 3 * h_dim]), np.tanh(z[:, 3 * h_dim :])
        gi, gf, go = ifo[:, :h_dim], ifo[:, h_dim : 2 * h_dim], ifo[:, 2 * h_dim :]
        m = mask[i][:, None]
        c_new = gf * c + gi * g
        tc = np.tanh(c_new)
        if keep:
            saved.append((h, c, gi, gf, go, g, tc, m))
        h, c = m * (go * tc) + (1 - m) * h, m * c_new + (1 - m) * c
        hs[i] = h
    return hs, saved


def _lstm_back(dhs, x, w, u, saved):
    t, n, _ = x.shape
    h_dim = u.shape[0]
    dz_all = np.zeros((t, n, 4 * h_dim), np.float32)
    du = np.zeros_like(u)
    dh, dc = np.zeros((n, h_dim), np.float32), np.zeros((n, h_dim), np.float32)
    for i in range(t - 1, -1, -1):
        h0, c0, gi, gf, go, g, tc, m = saved[i]
        d = dh + dhs[i]
        dn = d * m
        dcn = dc * m + dn * go * (1 - tc * tc)
        dz = np.concatenate([dcn * g * gi * (1 - gi), dcn * c0 * gf * (1 - gf), dn * tc * go * (1 - go), dcn * gi * (1 - g * g)], axis=1)
        dz_all[i] = dz
        du += h0.T @ dz
        dh = dz @ u.T + d * (1 - m)
        dc = dcn * gf + dc * (1 - m)
    flat = dz_all.reshape(-1, 4 * h_dim)
    return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)


def _new_weights(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d = PATH_DIM + WORD_DIM + N_NUMBERS
    p = {}
    for side in "fb":
        p[f"w{side}"] = rng.normal(0, d**-0.5, (d, 4 * HIDDEN)).astype(np.float32)
        p[f"u{side}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        p[f"b{side}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
    p["v"] = rng.normal(0, 0.1, (2 * HIDDEN, 1)).astype(np.float32)
    p["k"] = np.zeros(1, np.float32)
    return p


def _padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(x) for x in xs)
    out, mask = np.zeros((t, len(xs), xs[0].shape[1]), np.float32), np.zeros((t, len(xs)), np.float32)
    for j, x in enumerate(xs):
        out[: len(x), j] = x
        mask[: len(x), j] = 1
    return out, mask


def _scores(p, x, mask, keep=False):
    hf, sf = _lstm(x, p["wf"], p["uf"], p["bf"], mask, keep)
    hb, sb = _lstm(x[::-1], p["wb"], p["ub"], p["bb"], mask[::-1], keep)
    both = np.concatenate([hf, hb[::-1]], axis=2)
    return (both @ p["v"])[:, :, 0] + p["k"], both, sf, sb


def train(pages: list[tuple[str, list[int]]], seed: int = 5, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Weights fitted to (html, labels by leaf block) with Adam on the cross-entropy."""
    data = [(features(leaf_blocks(h)), np.array(y, np.float32)) for h, y in pages]
    data = [(x, y) for x, y in data if len(x)]
    p = _new_weights(seed)
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    rng, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(data)), key=lambda i: len(data[i][0]))
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        rng.shuffle(batches)
        for ids in batches:
            x, mask = _padded([data[i][0] for i in ids])
            y = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(ids):
                y[: len(data[i][1]), j] = data[i][1]
            s, both, sf, sb = _scores(p, x, mask, keep=True)
            ds = (_sigmoid(s) - y) * mask / mask.sum()
            d_both = ds[:, :, None] * p["v"][:, 0]
            g = {"v": both.reshape(-1, 2 * HIDDEN).T @ ds.reshape(-1, 1), "k": np.array([ds.sum()], np.float32)}
            g["wf"], g["uf"], g["bf"] = _lstm_back(d_both[:, :, :HIDDEN], x, p["wf"], p["uf"], sf)
            g["wb"], g["ub"], g["bb"] = _lstm_back(d_both[::-1, :, HIDDEN:], x[::-1], p["wb"], p["ub"], sb)
            step += 1
            rate = 0.02 * 0.75**epoch
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
                p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return p


def _long_scores(p, blocks: list) -> np.ndarray:
    """Scores of one long page: the wide features exist for a part of it at a time."""
    z = {side: np.empty((len(blocks), 1, 4 * HIDDEN), np.float32) for side in "fb"}
    for at in range(0, len(blocks), LONG_PAGE):
        x = features(blocks, at, at + LONG_PAGE)
        for side in "fb":
            z[side][at : at + len(x), 0] = x @ p[f"w{side}"] + p[f"b{side}"]
    mask = np.ones((len(blocks), 1), np.float32)
    hf, _ = _scan(z["f"], p["uf"], mask)
    hb, _ = _scan(z["b"][::-1], p["ub"], mask)
    return (np.concatenate([hf, hb[::-1]], axis=2) @ p["v"])[:, 0, 0] + p["k"]


def label(p: dict[str, np.ndarray], pages: list[list]) -> list[np.ndarray]:
    """Main-text marks for the blocks of every page."""
    out = [_long_scores(p, b) > 0 if len(b) > LONG_PAGE else np.zeros(len(b), bool) for b in pages]
    xs = [features(b) if len(b) <= LONG_PAGE else () for b in pages]
    order = sorted((i for i in range(len(xs)) if len(xs[i])), key=lambda i: len(xs[i]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and len(xs[order[stop]]) * (stop + 1 - at) <= CELLS:
            stop += 1
        ids = order[at:stop]
        s = _scores(p, *_padded([xs[i] for i in ids]))[0]
        for j, i in enumerate(ids):
            out[i] = s[: len(xs[i]), j] > 0
        at = stop
    return out


# ---- generated layouts -------------------------------------------------------------------------

# Plain word lists for class names and typical words of page parts.
MAIN_MARKS = "article post entry story content main body text".split()
SIDE_MARKS = {
    "nav": "nav menu navbar breadcrumb toc".split(), "header": "header masthead top banner".split(), "footer": "footer bottom copyright legal".split(),
    "aside": "sidebar aside related widget rail".split(), "ad": "ad ads advert sponsor promo".split(), "notice": "cookie notice consent alert banner".split(),
    "form": "form newsletter subscribe login search signup".split(), "comments": "comments comment reply discussion responses".split(), "share": "share social tags meta pagination".split(),
}
SIDE_TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}
SYLLABLES = "an ber ch de el en er es ge he in ion la le ment na on or qu re sh st ta th ti un ve wi".split()


def generated_pages(n: int, seed: int = 11) -> list[tuple[str, list[int]]]:
    """(html, labels of its leaf blocks) of ``n`` invented pages in many layouts."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]

    known = ["".join(pick(SYLLABLES) for _ in range(int(rng.integers(1, 5)))) for _ in range(2000)]

    def words(lo, hi):
        return " ".join(known[i] for i in rng.integers(0, len(known), int(rng.integers(lo, hi))))

    def sentence(lo, hi):
        t = words(lo, hi)
        return t[:1].upper() + t[1:] + pick([".", ".", "!", "?", ""])

    def marked(tag, marks):
        kind = rng.random()
        name = pick(marks) + pick(["", "", "-box", "-main", "-1"])
        return f"<{tag}>" if kind < 0.25 and tag not in ("div", "section") else f'<{tag} {pick(["class", "id"])}="{name}">'

    def side(kind):
        tag = SIDE_TAGS.get(kind, "div") if rng.random() < 0.7 else pick(["div", "section", "ul"] if kind == "nav" else ["div", "section"])
        y = []
        body = ""
        if kind in ("nav", "share") or kind == "footer" and rng.random() < 0.4:
            k = int(rng.integers(1, 8))
            inner = "".join(f'<li><a href="/{words(1, 2)}">{words(1, 4)}</a></li>' for _ in range(k))
            body, y = (inner if tag == "ul" else f"<ul>{inner}</ul>"), [0] * k
        elif kind == "comments":
            for _ in range(int(rng.integers(1, 6))):
                body += pick(["<p>{}</p>", "<div>{}</div>", "<li>{}</li>", '<div class="comment"><p>{}</p></div>']).format(sentence(3, 60))
                y.append(0)
        elif kind == "form":
            for _ in range(int(rng.integers(1, 4))):
                body += pick(["<label>{}</label><input name=q>", "<p>{}</p>", "<div>{}</div>"]).format(sentence(1, 9))
                y.append(0)
        else:
            shape = int(rng.integers(1, 4))
            for i in range(shape):
                t = sentence(2, 40)
                if shape == 1 and rng.random() < 0.6:
                    body += t
                else:
                    body += pick(["<p>{}</p>", "<h3>{}</h3>", "<div>{}</div>"]).format(t)
                y.append(0)
            if kind == "footer":
                body = body.replace(">", ">&copy; ", 1) if rng.random() < 0.5 and "<" in body else "&copy; " * (body[:1] != "<") + body
        return f"{marked(tag, SIDE_MARKS[kind])}{body}</{tag}>", y

    def main():
        tag = pick(["article", "article", "main", "div", "section"])
        marks = MAIN_MARKS
        out, y = marked(tag, marks), []
        depth = int(rng.integers(0, 3))
        out += "".join(f"<div{pick(['', ' class=' + pick(marks)])}>" for _ in range(depth))
        if rng.random() < 0.8:
            out += f"<h1>{sentence(1, 14)}</h1>"
            y.append(1)
        again = sentence(1, 12) if rng.random() < 0.1 else None  # some texts repeat one line over and over
        for _ in range(int(rng.integers(1, 16) if rng.random() < 0.85 else rng.integers(16, 90))):
            r = rng.random()
            if r < 0.72:
                t = again or sentence(1, 120)
                out += pick(["<p>{}</p>", "<p>{}</p>", "<p><b>{}<br>", "<p>{}", '<p class="text">{}</p>', "<div>{}</div>"]).format(t)
                y.append(1)
            elif r < 0.78:
                out += f"<h2>{sentence(1, 8)}</h2>"
                y.append(1)
            elif r < 0.84:
                k = int(rng.integers(1, 5))
                out += "<ul>" + "".join(f"<li>{sentence(1, 20)}</li>" for _ in range(k)) + "</ul>"
                y += [1] * k
            elif r < 0.88:
                out += f"<blockquote>{sentence(3, 30)}</blockquote>"
                y.append(1)
            elif r < 0.93:
                h, z = side(pick(["ad", "share", "form", "notice", "aside"]))
                out, y = out + h, y + z
        if rng.random() < 0.15:
            h, z = side("comments")
            out, y = out + h, y + z
        return out + "</div>" * depth + f"</{tag}>", y

    pages = []
    while len(pages) < n:
        parts = [side(k) for k in ("notice", "header", "nav", "ad") if rng.random() < 0.6]
        before = [side("aside")] if rng.random() < 0.25 else []
        after = [side(k) for k in ("ad", "share", "comments", "aside", "form") if rng.random() < 0.3] + ([side("footer")] if rng.random() < 0.85 else [])
        parts += before + [main()] + after
        wrap = rng.random() < 0.2
        body = "".join(h for h, _ in parts)
        page = "<!DOCTYPE html><html><head><title>" + words(1, 8) + "</title><style>p{}</style></head><body>" + ("<div id=page>" + body + "</div>" if wrap else body)
        y = [v for _, ys in parts for v in ys]
        if len(leaf_blocks(page)) == len(y):  # labels are by block; a layout that reads otherwise is left out
            pages.append((page, y))
    return pages


@lru_cache(maxsize=1)
def trained() -> dict[str, np.ndarray]:
    return train(generated_pages(TRAIN_PAGES))


def main_texts(p: dict[str, np.ndarray], pages: list[str | None]) -> list[str]:
    blocks = [leaf_blocks(h) for h in pages]
    return ["\n".join(t for (_, t, _), good in zip(b, marks) if good) for b, marks in zip(blocks, label(p, blocks))]


def _extract(p):
    def run(batches):
        for pdf in batches:
            html = [h if isinstance(h, str) else None for h in pdf["html"]]
            text = [t for i in range(0, len(html), 256) for t in main_texts(p, html[i : i + 256])]
            yield pdf.drop(columns=["html"]).assign(text=text)

    return run


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages`` (page_id, url, html).

    NULL and empty pages, and pages without main text, give an empty text. Rows are judged one by one, so
    repeated rows repeat; other columns are ignored; an empty table gives an empty result. The weights
    (about 120 KB, a fixed size) travel with the job.
    """
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    texts = rows.mapInPandas(_extract(trained()), "page_id string, url string, text string")
    return texts.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))
