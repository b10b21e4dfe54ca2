"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each with
the path of elements above it.  A block is given to the network as the sum of
vectors of its hashed path parts (tags, classes, ids), of its hashed words, and
a few numbers; two long short-term memories read the whole sequence of blocks,
one from each end, and a block's two states say whether it belongs to the main
text.  So a block is judged with the whole page around it.

The network is trained here, in numpy, by backpropagation through time: on pages
made up by ``made_up_page`` (whose blocks' labels are known by construction, with
common names of menus, side bars, notices, adverts, forms and comments) and on a
bounded sample of the table's own pages, labelled by ``teacher`` from the
elements that HTML itself gives a meaning.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import word_hashes

# Element names of the HTML standard by their role here.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source svg path use input object param math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd mlabeledtr maction semantics annotation annotation-xml".split())
FOREIGN = frozenset("svg path math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd mlabeledtr maction semantics annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg option".split())
#: Without an end tag these reach to the end of the page.
TO_THE_END = frozenset("script style textarea title iframe".split())
P_ENDS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

# A quote begins a value only after an equals sign; anywhere else it is a character like others.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)?)*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[a-z]+")


@dataclass
class Block:
    path: list[str]
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order, empty ones left out."""
    stack: list[tuple[str, list[str]]] = []
    out: list[Block] = []
    now: Block | None = None
    raw_until, at = "", 0
    foreign = False
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal now
        if now is not None:
            now.text = " ".join("".join(now.pieces).split())
            if now.text:
                out.append(now)
        now = None

    def text(s: str) -> None:
        nonlocal now
        if not s:
            return
        if now is None:
            if not s.strip():
                return
            now = Block([part for _, parts in stack for part in parts])
        s = entities.unescape(s)
        now.pieces.append(s)
        if any(t == "a" for t, _ in stack):
            now.linked += len(s)

    def close(names: tuple[str, ...], stop: frozenset[str] = frozenset()) -> bool:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return True
            if stack[k][0] in stop:
                return False
        return False

    for m in TAG.finditer(page):
        if raw_until:
            name = (m[2] or "").lower()
            if m[1] and name == raw_until:
                raw_until, at = "", m.end()
                continue
            if name == "foreignobject":
                foreign = not m[1] and "svg" not in unclosed
            # An option ends at the next one or its parent's end; HTML's own blocks end a drawing.
            if not (raw_until == "option" and name and name not in INLINE or raw_until == "svg" and not foreign and (name in P_ENDS or name in SIBLINGS)):
                continue
            raw_until, at = "", m.start()
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        alone = name in VOID or name in FOREIGN and m[3].endswith("/")  # a slash ends nothing else
        if m[1]:
            if name not in INLINE:
                flush()
            if name in RAW:
                continue
            close((name,))
            continue
        if name in RAW:
            if not alone:
                if name not in unclosed and re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at) is None:
                    unclosed.add(name)
                if name in unclosed and name in TO_THE_END:
                    at = len(page)
                    break
                if name not in unclosed or name in ("option", "svg"):
                    raw_until, foreign = name, False
            if name not in INLINE:
                flush()
            continue
        if name not in INLINE:
            flush()
            if name in P_ENDS:
                close(("p",), frozenset(("td", "th", "button", "table")))
            if name in SIBLINGS:
                close(SIBLINGS[name], frozenset(("ul", "ol", "dl", "table", "select")))
        if not alone:
            parts = [name]
            for attr in NAMES.finditer(m[3]):
                value = (attr[2] or attr[3] or attr[4] or "").lower()
                parts += ["." + w for w in PARTS.findall(value)]
            stack.append((name, parts))
    if not raw_until:
        rest = page[at:]
        cut = rest.find("<")
        text(rest if cut < 0 or not re.match(r"<[/!?a-zA-Z]", rest[cut:]) else rest[:cut])
    flush()
    return out


BUCKETS_PATH, BUCKETS_WORD, NUMBERS, WORDS_READ = 1024, 256, 8, 40


def bucket(part: str) -> int:
    return zlib.crc32(part.encode("utf-8", "surrogatepass")) % BUCKETS_PATH


_BUCKETS: dict[str, int] = {}


def features(blocks: list[Block]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashed path parts, hashed words (every word of the block counts), numbers."""
    paths, words, numbers = [], [], np.zeros((len(blocks), NUMBERS), np.float32)
    if len(_BUCKETS) > 200_000:
        _BUCKETS.clear()
    for k, b in enumerate(blocks):
        own = [_BUCKETS.setdefault(p, bucket(p)) if p in _BUCKETS or _BUCKETS.update({p: bucket(p)}) is None else 0 for p in dict.fromkeys(b.path + ["/" + (b.path[-1] if b.path else "")])]
        paths.append(np.array(own, np.int64))
        split = b.text.lower().encode("utf-8", "surrogatepass").split()
        words.append((word_hashes(split) % np.uint64(BUCKETS_WORD)).astype(np.int64))
        n = len(b.text)
        numbers[k] = (np.log1p(n) / 5, min(1.0, b.linked / n), min(1.0, 10 * (b.text.count(".") + b.text.count(",")) / n), b.text[-1] in ".!?:;", np.log1p(len(split)) / 4, k / len(blocks), 1.0 / (1 + k), np.log1p(len(blocks)) / 4)
    return paths, words, numbers


@dataclass
class Labeller:
    p: dict[str, np.ndarray]
    size: int

    @classmethod
    def new(cls, size: int, seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        p = {"path": rng.normal(0, 0.1, (BUCKETS_PATH, size)), "word": rng.normal(0, 0.02, (BUCKETS_WORD, size)), "number": rng.normal(0, 0.1, (NUMBERS, size)), "bias": np.zeros(size)}
        for d in "fb":
            p |= {f"in_{d}": rng.normal(0, 1 / np.sqrt(size), (size, 4 * size)), f"keep_{d}": rng.normal(0, 1 / np.sqrt(size), (size, 4 * size)), f"gate_{d}": np.concatenate([np.zeros(size), np.ones(size), np.zeros(2 * size)]), f"out_{d}": rng.normal(0, 1 / np.sqrt(size), size)}
        return cls({k: np.asarray(v, np.float32) for k, v in (p | {"skip": np.zeros(size), "last": np.zeros(1)}).items()}, size)

    def vectors(self, f: tuple) -> np.ndarray:
        paths, words, numbers = f
        v = numbers @ self.p["number"] + self.p["bias"]
        flat = np.concatenate(paths)
        first = np.concatenate([[0], np.cumsum([len(x) for x in paths])])[:-1]
        v += np.add.reduceat(self.p["path"][flat], first, axis=0)
        sizes = np.array([len(x) for x in words])
        full = np.flatnonzero(sizes)
        if len(full):
            flat = np.concatenate([words[i] for i in full])
            first = np.concatenate([[0], np.cumsum(sizes[full])])[:-1]
            v[full] += np.add.reduceat(self.p["word"][flat], first, axis=0) / sizes[full, None]
        return np.tanh(v)

    def direction(self, x: np.ndarray, d: str, tape: list | None = None) -> np.ndarray:
        """x: steps x lanes x H."""
        n = self.size
        pre = x @ self.p[f"in_{d}"] + self.p[f"gate_{d}"]
        h = c = np.zeros((x.shape[1], n), np.float32)
        out = np.empty((x.shape[0], x.shape[1], n), np.float32)
        for t in range(x.shape[0]):
            a = pre[t] + h @ self.p[f"keep_{d}"]
            g = 0.5 * np.tanh(0.5 * a[:, : 3 * n]) + 0.5
            i, f, o, u = g[:, :n], g[:, n : 2 * n], g[:, 2 * n :], np.tanh(a[:, 3 * n :])
            new = f * c + i * u
            tc = np.tanh(new)
            if tape is not None:
                tape.append((h, c, i, f, o, u, tc))
            h, c = o * tc, new
            out[t] = h
        return out

    def back(self, x: np.ndarray, d: str, tape: list, dh_all: np.ndarray, grad: dict) -> np.ndarray:
        n = self.size
        dh = np.zeros_like(dh_all[0])
        dc = np.zeros_like(dh)
        da_all = np.empty((x.shape[0], x.shape[1], 4 * n), np.float32)
        for t in range(x.shape[0] - 1, -1, -1):
            h, c, i, f, o, u, tc = tape[t]
            dh = dh + dh_all[t]
            dc = dc + dh * o * (1 - tc * tc)
            da = da_all[t]
            da[:, :n] = dc * u * i * (1 - i)
            da[:, n : 2 * n] = dc * c * f * (1 - f)
            da[:, 2 * n : 3 * n] = dh * tc * o * (1 - o)
            da[:, 3 * n :] = dc * i * (1 - u * u)
            grad[f"keep_{d}"] += h.T @ da
            dh = da @ self.p[f"keep_{d}"].T
            dc = dc * f
        grad[f"gate_{d}"] += da_all.sum((0, 1))
        grad[f"in_{d}"] += np.tensordot(x, da_all, ([0, 1], [0, 1]))
        return da_all @ self.p[f"in_{d}"].T

    @staticmethod
    def laid(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Steps x lanes, real places, and each place's mirror in its own page."""
        sizes = np.array([len(v) for v in vectors])
        steps = int(sizes.max())
        x = np.zeros((steps, len(vectors), vectors[0].shape[1]), np.float32)
        for k, v in enumerate(vectors):
            x[: len(v), k] = v
        at = np.arange(steps)[:, None]
        real = at < sizes
        return x, real, np.where(real, sizes - 1 - at, at)

    def forward(self, vectors: list[np.ndarray], tapes: tuple | None = None):
        x, real, mirror = self.laid(vectors)
        turned = np.take_along_axis(x, mirror[:, :, None], axis=0)
        hf = self.direction(x, "f", tapes and tapes[0])
        hb = np.take_along_axis(self.direction(turned, "b", tapes and tapes[1]), mirror[:, :, None], axis=0)
        logit = hf @ self.p["out_f"] + hb @ self.p["out_b"] + x @ self.p["skip"] + self.p["last"]
        return logit, x, turned, hf, hb, real, mirror

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which of its blocks are main text."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k, b in enumerate(pages) if b), key=lambda k: len(pages[k]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and b - a < 512 and len(pages[order[b]]) * (b - a) < 40_000:
                b += 1
            some = order[a:b]
            every = [x for k in some for x in pages[k]]
            sizes = np.cumsum([len(pages[k]) for k in some])[:-1]
            logit = self.forward(np.split(self.vectors(self.placed(pages, some, every)), sizes))[0]
            for lane, k in enumerate(some):
                out[k] = logit[: len(pages[k]), lane] > 0
            a = b
        return out

    @staticmethod
    def placed(pages: list[list[Block]], some: list[int], every: list[Block]) -> tuple:
        each = [features(pages[k]) for k in some]
        return [x for f in each for x in f[0]], [x for f in each for x in f[1]], np.concatenate([f[2] for f in each])

    def train(self, pages: list[list[Block]], labels: list[np.ndarray], steps: int, lanes: int, rate: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        each = [features(b) for b in pages]
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            some = rng.choice(len(pages), min(lanes, len(pages)), replace=False)
            # Some pages lose their classes and words for a step, so that no single clue is leant on.
            f = [x for k in some for x in each[k][0]], [x if rng.random() < 0.6 else x[:0] for k in some for x in each[k][1]], np.concatenate([each[k][2] for k in some])
            v = self.vectors(f)
            sizes = [len(pages[k]) for k in some]
            tapes: tuple = ([], [])
            logit, x, turned, hf, hb, real, mirror = self.forward(np.split(v, np.cumsum(sizes)[:-1]), tapes)
            y = np.zeros_like(logit)
            for lane, k in enumerate(some):
                y[: sizes[lane], lane] = labels[k]
            d = ((0.5 * np.tanh(0.5 * logit) + 0.5 - y) * real / real.sum()).astype(np.float32)
            grad = {k: np.zeros_like(w) for k, w in self.p.items()}
            grad["out_f"], grad["out_b"] = np.tensordot(d, hf, ([0, 1], [0, 1])), np.tensordot(d, hb, ([0, 1], [0, 1]))
            grad["skip"], grad["last"] = np.tensordot(d, x, ([0, 1], [0, 1])), np.array([d.sum()], np.float32)
            dx = self.back(x, "f", tapes[0], d[:, :, None] * self.p["out_f"], grad) + d[:, :, None] * self.p["skip"]
            db = np.take_along_axis(d, mirror, axis=0)[:, :, None] * self.p["out_b"]
            dx += np.take_along_axis(self.back(turned, "b", tapes[1], db, grad), mirror[:, :, None], axis=0)
            dv = np.concatenate([dx[: sizes[lane], lane] for lane in range(len(some))]) * (1 - v * v)
            grad["number"], grad["bias"] = f[2].T @ dv, dv.sum(0)
            np.add.at(grad["path"], np.concatenate(f[0]), np.repeat(dv, [len(p) for p in f[0]], axis=0))
            counts = np.array([len(w) for w in f[1]])
            if counts.sum():
                np.add.at(grad["word"], np.concatenate(f[1]), np.repeat(dv / np.maximum(1, counts)[:, None], counts, axis=0))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            pace = rate * min(1.0, step / 15) * (1 - 0.9 * step / steps)
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m1, m2 = moments[k]
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                self.p[k] -= (pace * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


OTHER_PARTS = frozenset("nav header footer aside form head title button .ad .ads .advert .sidebar .nav .menu .footer .header .comment .comments .cookie .notice .banner .promo .related .share .newsletter".split())


def teacher(block: Block) -> bool:
    """A label for training only: inside what HTML calls the article, and nothing that HTML calls something else."""
    tags = set(block.path)
    return bool(tags & {"article", "main"}) and not tags & OTHER_PARTS


SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo an er in on es ti".split()


def made_up_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page and its blocks' labels; every block's text starts with its number, so order is plain."""
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    labels: list[bool] = []

    def some(n: int) -> str:
        return " ".join(word() for _ in range(n))

    def leaf(tag: str, n: int, main: bool, stop: str = ".", attr: str = "") -> str:
        labels.append(main)
        return f"<{tag}{attr}>{some(n).capitalize()}{stop}</{tag}>"

    def named(names: str, tags: str = "div div div section") -> tuple[str, str]:
        tag, name = rng.choice(tags.split()), rng.choice(names.split())
        kind = rng.choice(["class", "class", "id"])
        if rng.random() < 0.3:
            name += rng.choice([f"-{rng.randint(1, 9)}", " wrapper", "-box", " clearfix", "-inner"])
        return f'<{tag} {kind}="{name}">', f"</{tag}>"

    def links(n: int) -> str:
        out = []
        for _ in range(n):
            labels.append(False)
            out.append(f'<li><a href="/{word()}">{some(rng.randint(1, 3))}</a></li>')
        return "<ul>" + "".join(out) + "</ul>"

    def boiler(kind: str) -> str:
        if kind == "menu":
            a, z = rng.choice([("<nav>", "</nav>"), named("nav menu navbar navigation topnav main-menu breadcrumbs", "div div nav ul"), ("<header><nav>", "</nav></header>")])
            return a + links(rng.randint(2, 9)) + z
        if kind == "header":
            a, z = rng.choice([("<header>", "</header>"), named("header masthead site-header top branding", "div header")])
            return a + leaf(rng.choice(["div", "h1", "p", "span"]), rng.randint(1, 5), False, "") + z
        if kind == "footer":
            a, z = rng.choice([("<footer>", "</footer>"), ("<footer>", "</footer>"), named("footer site-footer copyright bottom colophon", "div footer")])
            labels.append(False)
            return a + f"&copy; {word()}.example.com &middot; {some(rng.randint(2, 14))}." + z
        if kind == "advert":
            a, z = named("ad ads advert advertisement adsense banner promo sponsored sponsor ad-slot", "div div aside section ins")
            if a.startswith("<ins"):
                a, z = a.replace("<ins", "<div"), "</div>"
            labels.append(False)
            return f"<!-- ad {rng.randint(0, 999)} -->" + a + some(rng.randint(4, 30)) + "." + z
        if kind == "side":
            a, z = rng.choice([("<aside>", "</aside>"), named("sidebar side rail widget related recommended popular trending tags share social author-box", "div aside section")])
            return a + leaf(rng.choice(["h2", "h3", "p"]), 2, False, "") + (links(rng.randint(2, 6)) if rng.random() < 0.6 else leaf("p", rng.randint(4, 40), False)) + z
        if kind == "notice":
            a, z = named("cookie cookies consent notice gdpr alert newsletter subscribe signup popup modal overlay paywall", "div div section aside")
            return a + leaf("p", rng.randint(5, 30), False) + (leaf("button", 1, False, "") if rng.random() < 0.5 else "") + z
        if kind == "form":
            a, z = rng.choice([("<form>", "</form>"), ('<form class="search">', "</form>"), ('<form id="contact">', "</form>")])
            return a + leaf("p", rng.randint(1, 9), False, "") + leaf("button", 1, False, "") + z
        a, z = named("comments comment comment-list commentlist responses replies discussion disqus reader-comments", "div section section ol")
        out = leaf("h3", 2, False, "") if rng.random() < 0.6 else ""
        for _ in range(rng.randint(1, 6)):
            a2, z2 = named("comment reply comment-body response", "div li div article")
            out += a2 + leaf("p", rng.randint(3, 60), False) + z2
        return a + out + z

    def main_part() -> str:
        a, z = rng.choice([("<article>", "</article>")] * 5 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), named("content article post entry-content post-body story article-body main-content text main body"), named("content article post entry-content post-body story article-body main-content")])
        out = leaf(rng.choice(["h1", "h1", "h2"]), rng.randint(2, 12), True, rng.choice(["", "."])) if rng.random() < 0.85 else ""
        if out and rng.random() < 0.12:
            out = "<header>" + out + "</header>"  # an article's own head line
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 5, 6, 8, 12, 20]) if out else rng.randint(1, 9)):
            x = rng.random()
            if x < 0.72:
                out += leaf("p", rng.choice([1, 2, 3, 5, 9, 20, 40, 90, 200]), True)
            elif x < 0.84:
                labels.append(True)
                out += f"<p><b>{some(rng.choice([1, 4, 20, 60]))}.<br>"
            elif x < 0.89:
                out += leaf(rng.choice(["h2", "h3", "h4"]), rng.randint(1, 6), True, "")
            elif x < 0.93:
                out += "<ul>" + "".join(leaf("li", rng.randint(1, 20), True, rng.choice(["", "."])) for _ in range(rng.randint(1, 5))) + "</ul>"
            elif x < 0.95:
                out += "<blockquote>" + leaf("p", rng.randint(3, 30), True) + "</blockquote>"
            elif x < 0.97:
                out += "<table>" + "".join("<tr>" + "".join(leaf("td", 1, True, "") for _ in range(2)) + "</tr>" for _ in range(rng.randint(1, 3))) + "</table>"
            elif x < 0.985:
                out += boiler("advert")
            else:
                out += boiler(rng.choice(["side", "notice", "form"]))
        if rng.random() < 0.12:
            out += boiler(rng.choice(["comments", "comments", "side", "form", "footer"]))
        return a + out + z

    before = [k for k in ("menu", "header", "notice", "advert", "side", "form") if rng.random() < {"menu": 0.8, "header": 0.4, "advert": 0.5}.get(k, 0.2)]
    after = [k for k in ("side", "form", "comments", "notice", "advert", "footer") if rng.random() < {"footer": 0.85, "comments": 0.35}.get(k, 0.2)]
    page = "<html><head><style>p{margin:0}</style><script>var t='</p>';</script></head><body>"
    if wrap := rng.random() < 0.3:
        page += '<div class="page container">'
    for kind in before:
        page += boiler(kind)
    page += main_part()
    for kind in after:
        page += boiler(kind)
    page += "</div>" * wrap + "</body></html>"
    if rng.random() < 0.05:
        page = page[: rng.randint(len(page) // 2, len(page))]
    return page, labels


def fit(pages: DataFrame | None, sample: int = 200, made_up: int = 900, size: int = 16, steps: int = 240, seed: int = 0, sample_chars: int = 200_000) -> Labeller:
    """pages: html.  The first ``sample`` different pages of up to ``sample_chars`` characters, by a hash of the text, come to the driver, whole."""
    rng = random.Random(seed)
    docs, labels = [], []
    while len(docs) < made_up:
        page, known = made_up_page(rng)
        blocks = blocks_of(page)
        if blocks and len(blocks) <= len(known):
            docs.append(blocks)
            labels.append(np.array(known[: len(blocks)], float))
    if pages is not None:
        short = pages.select("html", F.xxhash64("html").alias("h")).where(F.length("html") <= sample_chars)
        share = min(1.0, 8 * sample / max(1, pages.count()))  # few need to be sorted; at least ``sample`` are left unless most pages are long
        own = short.where(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < share * (1 << 20)).distinct().orderBy("h", "html").limit(sample).collect()
        for r in own:
            blocks = blocks_of(r["html"])
            known = [teacher(b) for b in blocks]
            if any(known) and len(blocks) <= 200:
                docs.append(blocks)
                labels.append(np.array(known, float))
    model = Labeller.new(size, seed)
    model.train(docs, labels, steps, 48, 0.02, seed)
    return model


def extract(pages: DataFrame, model: Labeller, html: str = "html") -> DataFrame:
    """pages with text and n_chars in place of the html.

    Main blocks in page order, joined by one line feed; white space inside a
    block is one space.  A null, empty or textless page gives an empty text;
    pages of any length are read whole; repeated rows are extracted alike.
    Further columns stay; ones named like the results are replaced.
    """
    rest = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    shared = pages.sparkSession.sparkContext.broadcast(model)  # some 150 KB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                blocks = [blocks_of(t) if t else [] for t in part.column(part.schema.get_field_index(html)).to_pylist()]
                texts = ["\n".join(b.text for b, m in zip(own, main, strict=True) if m) for own, main in zip(blocks, shared.value.label(blocks), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest, "text", "n_chars"])

    return pages.select(*rest, html).mapInArrow(run, pages.select(*rest).schema.add("text", "string").add("n_chars", "long"))
