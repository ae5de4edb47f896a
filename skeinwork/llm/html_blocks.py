"""HTML extraction by a recurrent block labeller.

A page becomes its sequence of leaf blocks. Each block has a tag-path vector (hashed tags, ids,
classes and roles on the way down to it), a hashed-word vector and a few sizes; a bidirectional LSTM
in numpy reads the whole sequence and says of each block whether it belongs to the main text. The
labeller is trained here, with a fixed seed, on pages that a generator writes, labelled by what it knows
of each text that it writes (page furniture of many kinds around and inside articles; a good third of
the pages withhold names and telling elements, so that words, links and neighbours must tell), and on a
bounded sample of the pages at hand, labelled by where their blocks stand. Training reads whole pages, in windows of blocks; labelling carries its states
through pages of any length.

A page is read once from left to right, in time that grows with its length: a tag ends at the first >
outside a quoted value; if none follows, tags of the rest of the page end at the first >; a tag that
never ends is dropped with what follows it, as browsers do.

Defined cases: null or empty html, and pages without main text, give the empty string; unclosed and
stray tags are mended as browsers do, and as in browsers elements nest no deeper than 512 (what is
deeper counts as standing there); comments, scripts, styles and the head never give text; white space
is what str.split() splits on; repeated rows get the same result, rows of one page_id each their own;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import cut, read

#: Pages of the table that join the generated ones in training, at most; windows of their blocks, at most; and generated pages.
SAMPLE, SAMPLE_WINDOWS, GENERATED = 200, 1000, 1200
HIDDEN, EPOCHS, SEED = 20, 10, 4
PATH_DIM, WORD_DIM, SIZES = 512, 32, 6
#: Blocks of a training window; pages, characters and blocks that are labelled at once (one page's blocks in turns).
WINDOW, PAGES, CHARS, STEPS = 64, 256, 1 << 22, 4096
DEPTH = 512

#: Elements that stand inside a line, that hold no content, whose content is no markup, whose content is no text, that a head holds, and that end an open p.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript title iframe textarea noembed noframes xmp".split())
MUTE = frozenset("head template object svg math canvas".split())
IN_HEAD = frozenset("title meta link script style base noscript template noframes basefont bgsound".split())
CLOSED_BY_SAME = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_UNSEEN = frozenset("script style noscript title".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
_REST = re.compile(r"""(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+>""")
_CLOSER = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_NAMED = re.compile(r"""\b(class|id|role|hidden|style|aria-label)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


def marks(tag: str, attributes: str) -> str:
    """An element as features: its tag, and the words of its id, class and role, with their first four letters."""
    out = [tag]
    if attributes:
        for name, *values in _NAMED.findall(attributes):
            value = next((v for v in values if v), "")
            name = name.lower()
            if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out.append(".hidden")
            elif name != "style":
                for part in _PART.findall(value):
                    part = part.lower()
                    out += ["." + part, "." + part[:4] + "~"] if len(part) > 4 else ["." + part]
    return " ".join(out)


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int  # characters inside links


class _Reader:
    """One pass over a page."""

    def __init__(self, page: str):
        self.page = page
        self.out: list[Block] = []
        self.stack: list[tuple[str, str]] = []
        self.open: Counter = Counter()
        self.deeper: Counter = Counter()  # open elements beyond DEPTH
        self.held: list[str] = []
        self.link = self.linked = self.mute = 0
        self.quotes = True
        self.path: tuple[str, ...] | None = ()

    def say(self, text: str) -> None:
        if self.mute or not text:
            return
        self.held.append(entities.unescape(text) if "&" in text else text)
        if self.link:
            self.linked += len(self.held[-1])

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                if self.path is None:
                    self.path = tuple(m for _, m in self.stack)
                self.out.append(Block(self.path, text, self.linked))
            self.held.clear()
        self.linked = 0

    def push(self, tag: str, attributes: str) -> None:
        if len(self.stack) >= DEPTH:
            self.deeper[tag] += 1
            return
        self.stack.append((tag, marks(tag, attributes)))
        self.open[tag] += 1
        self.mute += tag in MUTE
        self.path = None

    def pop(self) -> str:
        tag, _ = self.stack.pop()
        self.open[tag] -= 1
        self.mute -= tag in MUTE
        self.path = None
        return tag

    def pop_to(self, tag: str) -> None:
        while self.pop() != tag:
            pass

    def end_of_tag(self, at: int) -> int:
        """The place of the > that ends a tag, or -1."""
        if self.quotes:
            if found := _REST.match(self.page, at):
                return found.end() - 1
            self.quotes = False  # no such > is left: values in quotes aren't read as such from here
        return self.page.find(">", at)

    def begins(self, tag: str, attributes: str) -> None:
        if self.open["head"] and tag not in IN_HEAD:
            self.pop_to("head")
        if tag == "br":
            self.held.append(" ")
        elif tag in INLINE:
            if tag == "a":
                self.link = 1
        else:
            self.flush()
            self.link = 0
            ends = CLOSED_BY_SAME.get(tag, {"p"})
            while self.stack and self.stack[-1][0] in ends:
                self.pop()
            if tag not in VOID and not (tag in ("svg", "math") and attributes.endswith("/")):
                self.push(tag, attributes)

    def ends(self, tag: str) -> None:
        if tag == "br":
            self.held.append(" ")
        elif tag in INLINE:
            if tag == "a":
                self.link = 0
        elif self.deeper[tag]:
            self.flush()
            self.deeper[tag] -= 1
        elif self.open[tag]:
            self.flush()
            self.pop_to(tag)

    def read(self) -> list[Block]:
        page, at = self.page, 0
        while (lt := page.find("<", at)) >= 0:
            self.say(page[at:lt])
            tag = _TAG.match(page, lt)
            if tag is None:
                if page.startswith("<!--", lt):
                    end = page.find("-->", lt + 2)
                    at = end + 3 if end >= 0 else len(page)
                elif page.startswith(("<!", "<?", "</"), lt):
                    end = page.find(">", lt)
                    at = end + 1 if end >= 0 else len(page)
                else:
                    self.say("<")
                    at = lt + 1
                continue
            end = self.end_of_tag(tag.end())
            if end < 0:
                at = len(page)
                break
            name, at = tag[2].lower(), end + 1
            if tag[1]:
                self.ends(name)
            elif name in RAW:
                if name not in _UNSEEN:
                    self.flush()
                closer = _CLOSER[name].search(page, at)
                end = self.page.find(">", closer.end()) if closer else -1
                at = end + 1 if end >= 0 else len(page)
            else:
                self.begins(name, page[tag.end() : end])
        self.say(page[at:])
        self.flush()
        return self.out


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page that have text, in page order."""
    return _Reader(page or "").read()


def _hash(s: str, dim: int) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % dim


@dataclass
class Vectors:
    """Block vectors. The places of path vectors' ones are kept, as pages share few paths."""

    paths: dict[tuple[str, ...], np.ndarray] = field(default_factory=dict)

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        """Where a path's vector has its ones."""
        if path not in self.paths:
            if len(self.paths) > 100_000:  # a memo, not a limit
                self.paths.clear()
            ones = {_hash(mark, PATH_DIM) for element in path for mark in element.split(" ")}
            if path:
                ones.add(_hash("leaf:" + path[-1].split(" ", 1)[0], PATH_DIM))
            self.paths[path] = np.array(sorted(ones), dtype=np.uint16)
        return self.paths[path]

    def rest(self, b: Block, i: int, of: int) -> np.ndarray:
        """What isn't the path: shares of hashed words, and sizes. i, of: the block's place on its page."""
        words = b.text.lower().split(" ")
        counts = np.bincount([_hash(w, WORD_DIM) for w in words], minlength=WORD_DIM) / len(words)
        sizes = (1, min(len(b.text), 1000) / 1000, np.log1p(len(words)) / 5, b.linked / len(b.text), i / of, b.text[-1] in ".!?")
        return np.concatenate([counts, sizes]).astype(np.float32)

    def some(self, found: list[Block], lo: int, hi: int) -> np.ndarray:
        """The vectors of a page's blocks from lo to hi."""
        hi = min(hi, len(found))
        return whole([self.path(b.path) for b in found[lo:hi]], [self.rest(found[i], i, len(found)) for i in range(lo, hi)])


def whole(paths: list[np.ndarray], rests) -> np.ndarray:
    """Block vectors from the ones of their paths and from the rest."""
    x = np.zeros((len(paths), PATH_DIM + WORD_DIM + SIZES), np.float32)
    for i, ones in enumerate(paths):
        x[i, ones] = 1
    x[:, PATH_DIM:] = np.reshape(rests, (len(paths), -1))
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """A bidirectional LSTM over block vectors and a logistic output of both directions' states."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(rng: np.random.Generator) -> Labeller:
        d, h = PATH_DIM + WORD_DIM + SIZES, HIDDEN
        p = {}
        for way in "fb":
            p[way + "x"] = rng.normal(0, 0.1, (d, 4 * h)).astype(np.float32)
            p[way + "h"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)).astype(np.float32)
            p[way + "0"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)
        p["out"] = rng.normal(0, 0.3, (2 * h, 1)).astype(np.float32)
        p["skip"] = np.zeros((d, 1), np.float32)
        p["bias"] = np.zeros(1, np.float32)
        return Labeller(p)

    def _scan(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None, state: tuple | None = None) -> tuple[np.ndarray, tuple]:
        """(states, the last state) of one direction, from a state on; x: step, page, feature. Past a page's end the state rests."""
        steps, pages, _ = x.shape
        h, c = state or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        wx = (x.reshape(-1, x.shape[2]) @ self.p[way + "x"] + self.p[way + "0"]).reshape(steps, pages, -1)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = wx[t] + h @ self.p[way + "h"]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc))
            c = m * new + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            out[t] = h
        return out, (h, c)

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._scan("f", x, mask)[0], self._scan("b", x, mask)[0]], axis=2)
        return (both @ self.p["out"] + x @ self.p["skip"])[:, :, 0] + self.p["bias"]

    def long_logits(self, found: list[Block], vectors: Vectors, steps: int = STEPS) -> np.ndarray:
        """logits() of one page, some blocks at a time: each direction carries its state from turn to turn."""
        out = np.full(len(found), self.p["bias"][0], np.float32)
        turns = range(0, len(found), steps)
        for k, way in enumerate("fb"):
            state = None
            for lo in turns if way == "f" else reversed(turns):
                x = vectors.some(found, lo, lo + steps)[:, None]
                h, state = self._scan(way, x, np.ones((len(x), 1), np.float32), state=state)
                out[lo : lo + steps] += (h[:, 0] @ self.p["out"][k * HIDDEN : (k + 1) * HIDDEN])[:, 0]
                if way == "f":
                    out[lo : lo + steps] += (x[:, 0] @ self.p["skip"])[:, 0]
        return out

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        states = {way: self._scan(way, x, mask, kept[way])[0] for way in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=2)
        z = (both @ self.p["out"] + x @ self.p["skip"])[:, :, 0] + self.p["bias"]
        dz = ((_sigmoid(z) - y) * mask / mask.sum())[:, :, None]
        grad = {"out": np.einsum("tpk,tpo->ko", both, dz), "skip": np.einsum("tpk,tpo->ko", x, dz), "bias": dz.sum((0, 1))}
        for k, way in enumerate("fb"):
            dout = dz @ self.p["out"][k * HIDDEN : (k + 1) * HIDDEN].T
            dwx = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            gh = np.zeros_like(self.p[way + "h"])
            for t, h, c, i, f, o, g, tc in reversed(kept[way]):
                m = mask[t][:, None]
                dh = dh + dout[t]
                dnew = m * (dh * o * (1 - tc * tc) + dc)
                d = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), m * dh * tc * o * (1 - o), dnew * i * (1 - g * g)], axis=1)
                dwx[t] = d
                gh += h.T @ d
                dh = (1 - m) * dh + d @ self.p[way + "h"].T
                dc = (1 - m) * dc + dnew * f
            grad[way + "h"] = gh
            grad[way + "x"] = x.reshape(-1, x.shape[2]).T @ dwx.reshape(-1, 4 * HIDDEN)
            grad[way + "0"] = dwx.sum((0, 1))
        return grad


def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        mask[: len(p), k] = 1
    return x, mask


#: Words by which furniture and main text are named in pages at large.
FURNITURE = "ad ads advert advertisement adslot sponsor sponsored promo promotion banner sidebar side widget related recommended popular share sharing social cookie cookies consent gdpr notice alert newsletter subscribe signup popup modal overlay comment comments disqus reply replies respond discussion menu nav navbar navigation breadcrumb breadcrumbs footer foot copyright legal header masthead topbar toolbar pagination pager tags meta byline login search skip hidden".split()
BODY = "article content post entry story main body text page primary single container wrapper inner layout row section".split()
_FURNITURE_TAGS = frozenset("nav header footer aside form button select option dialog menu figcaption".split())


def stands(path: tuple[str, ...]) -> bool:
    """Whether a block in this place is main text: in an article, main or a container named so, and in no furniture. A header in there is the article's own."""
    inside = False
    for element in path:
        tag, *names = element.split(" ")
        names = [n[1:] for n in names if not n.endswith("~")]
        if (tag in _FURNITURE_TAGS and not (tag == "header" and inside)) or any(n in FURNITURE for n in names):
            return False
        inside = inside or tag in ("article", "main") or any(n in ("article", "content", "post", "entry", "story") for n in names)
    return inside


#: What main texts of a generated page begin with: the generator knows what it writes, and no label is read off a path.
MARK = "\ue000"
#: Words that furniture says of itself where no name does, and how comments are announced.
SAYS = {"menu": "menu home about contact search topics sections archive more".split(), "foot": "copyright rights reserved terms privacy imprint contact".split(), "side": "related popular latest trending newsletter subscribe sponsored advertisement share follow".split()}
ANNOUNCED = "responses comments replies answers reactions".split()


def generate(rng: np.random.Generator, layout: str | None = None) -> str:
    """A page with furniture around, and now and then inside, its article. Every text of the article begins with MARK.

    layout: "named" (furniture and articles have names or tags of their own), "bare" (no names and plain elements: what a block is shows in its
    words, links and neighbours), "table" (bare, in cells); by default two, one and a half in three and a half."""
    letters = "abcdefghijklmnopqrstuvwxyzéèüñóöä"

    def pick(xs):
        return xs[int(rng.integers(len(xs)))]

    layout = layout or pick(["named"] * 5 + ["bare"] * 2 + ["table"])

    def words(n: int) -> str:
        return " ".join("".join(pick(letters) for _ in range(int(rng.integers(2, 9)))) for _ in range(n))

    def sentence(n: int) -> str:
        return words(n).capitalize() + "."

    def paragraph() -> str:
        text = " ".join(sentence(int(rng.integers(1, 15))) for _ in range(int(rng.integers(1, 5))))
        odd = rng.random()
        if odd < 0.08:
            # a word or two, or the same over and over
            text = words(int(rng.integers(1, 3))).capitalize() if odd < 0.05 else f"{words(1)} " + f"{words(1)} " * int(rng.integers(5, 60))
        if rng.random() < 0.15:
            text = f'<a href="/{words(1)}">{words(2)}</a> {text}'
        if rng.random() < 0.15:
            text = f"<b>{words(2)}</b> {text}"
        tag = "p" if rng.random() < 0.85 else pick(["h2", "h3", "li", "blockquote", "td", "pre", "div"])
        body = f"<{tag}>{MARK}{text}" + ("" if tag == "p" and rng.random() < 0.3 else f"</{tag}>")
        return f"<ul>{body}</ul>" if tag == "li" else f"<table><tr>{body}</tr></table>" if tag == "td" else body

    def links(n: int, says: list[str]) -> list[str]:
        return [f'<a href="/{words(1)}">{pick(says).capitalize() if rng.random() < 0.4 else words(int(rng.integers(1, 3)))}</a>' for _ in range(n)]

    def comments() -> str:
        """Readers' comments that no name gives away: announced, then short texts under names."""
        n = int(rng.integers(1, 6))
        items = [f"<p>{words(1).capitalize()} {pick(['says', 'wrote', '·', 'on'])} {words(1)} {int(rng.integers(1, 29))}</p><p>{sentence(int(rng.integers(2, 14)))}</p>" for _ in range(n)]
        head = pick(["h2", "h3", "h4", "p"])
        return f"<{head}>{n} {pick(ANNOUNCED)}</{head}>" + "".join(items if rng.random() < 0.5 else [f"<div>{x}</div>" for x in items])

    def plain(kind: str) -> str:
        """Furniture without a name."""
        if kind == "menu":
            inner = links(int(rng.integers(3, 8)), SAYS["menu"])
            inner = (["Menu"] if rng.random() < 0.3 else []) + inner
            return "<ul>" + "".join(f"<li>{x}</li>" for x in inner) + "</ul>" if rng.random() < 0.5 else "<div>" + "".join(f"<p>{x}</p>" for x in inner) + "</div>" if rng.random() < 0.5 else pick(["", "Menu<br>"]) + "<br>".join(inner)
        if kind == "foot":
            return f"<p>{pick(['©', 'Copyright', ''])} {int(rng.integers(1998, 2030))} {words(2)} {pick(SAYS['foot'])} {pick(SAYS['foot'])}</p>"
        head = f"<h3>{pick(SAYS['side']).capitalize()} {words(int(rng.integers(0, 2)))}</h3>"
        return "<div>" + head + "".join(f"<p>{x}</p>" for x in links(int(rng.integers(1, 5)), SAYS["side"])) + "</div>"

    def furniture() -> str:
        kind = rng.random()
        name = pick(FURNITURE)
        if rng.random() < 0.4:
            name = f"{name}-{pick(['box', 'area', 'list', 'block', 'wrap', 'item', str(int(rng.integers(9)))])}" if rng.random() < 0.7 else f"{pick(['site', 'page', 'top', 'user'])}-{name}"
        named = f'{pick(["class", "class", "id"])}="{name}"'
        if kind < 0.25:
            inner = "".join(f'<li><a href="/{words(1)}">{words(int(rng.integers(1, 3)))}</a></li>' for _ in range(int(rng.integers(2, 7))))
            tag = pick(["nav", "nav", "div", "aside"])
            return f"<{tag} {named if tag == 'div' or rng.random() < 0.3 else ''}><ul>{inner}</ul></{tag}>"
        if kind < 0.45:
            tag = pick(["header", "footer", "aside", "form"])
            inner = f"<p>{sentence(int(rng.integers(2, 20)))}</p>" if rng.random() < 0.5 else sentence(int(rng.integers(2, 20)))
            return f"<{tag}>{inner}{'<label>' + words(1) + '</label><button>' + words(1) + '</button>' if tag == 'form' else ''}</{tag}>"
        inner = "".join(f"<p>{sentence(int(rng.integers(3, 25)))}</p>" for _ in range(int(rng.integers(1, 4)))) if rng.random() < 0.6 else sentence(int(rng.integers(2, 20)))
        tag = pick(["div", "div", "section", "aside", "ul"])
        return f"<{tag} {named}>{inner}</{tag}>"

    parts = [paragraph() for _ in range(int(rng.integers(1, 16)))]
    if rng.random() < 0.8:
        title = f"<h1>{MARK}{words(int(rng.integers(2, 10)))}</h1>"
        # an article's own header is no furniture, but a page's is
        parts.insert(0, f"<header>{title}</header>" if layout == "named" and rng.random() < 0.25 else title)
    page = lambda inner: f"<html><head><title>{words(3)}</title></head><body>{inner}</body></html>"
    if layout != "named":
        body = "".join(parts) + (comments() if rng.random() < 0.5 else "")
        before = [plain(pick(["menu", "menu", "side"])) for _ in range(int(rng.integers(0, 3)))]
        after = [plain(pick(["side", "foot", "menu"])) for _ in range(int(rng.integers(0, 3)))]
        if layout == "table":
            cell = lambda x: f"<td>{x}</td>"
            return page("<table><tr>" + "".join(map(cell, [*(before or [plain("menu")]), body, *after])) + "</tr></table>")
        body = f"<div>{body}</div>" if rng.random() < 0.5 else body
        return page("".join(before) + body + "".join(after))
    for _ in range(int(rng.choice([0, 0, 1, 2]))):
        # behind a header of the article, which comes first
        parts.insert(int(rng.integers(len(parts) + 1)), furniture())
    tag = pick(["article", "article", "main", "div"])
    if tag == "div":
        opened = f'<div {pick(["class", "id"])}="{pick(["content", "post", "entry", "story", "article"])}{pick(["", "", "-body", "-text", "-main"])}">'
    else:
        opened = f"<{tag}>" if rng.random() < 0.6 else f'<{tag} class="{pick(BODY)}">'
    article = opened + "".join(parts) + f"</{tag}>" + (comments() if rng.random() < 0.15 else "")
    if rng.random() < 0.4:
        article = f'<div class="{pick(["container", "wrapper", "inner", "layout", "row", "page"])}">{furniture() if rng.random() < 0.5 else ""}{article}{furniture() if rng.random() < 0.5 else ""}</div>'
    around = [furniture() for _ in range(int(rng.integers(0, 4)))], [furniture() for _ in range(int(rng.integers(0, 4)))]
    return page(f"{''.join(around[0])}{article}{''.join(around[1])}")


def marked(page: str) -> tuple[list[Block], list[bool]]:
    """A generated page's blocks without their marks, and which of them had one."""
    found = blocks(page)
    return [replace(b, text=b.text.replace(MARK, "")) for b in found], [MARK in b.text for b in found]


#: A training window: vectors of blocks that follow each other, and which are main text.
Window = tuple[np.ndarray, np.ndarray]


def windows(found: list[Block], labels: list[bool], vectors: Vectors, width: int = WINDOW):
    """(number, ones of the paths, rest of the vectors, labels) of each window of a page's blocks; windows follow each other to the end."""
    for k, lo in enumerate(range(0, len(found), width)):
        hi = min(lo + width, len(found))
        yield k, [vectors.path(b.path) for b in found[lo:hi]], [vectors.rest(found[i], i, len(found)) for i in range(lo, hi)], labels[lo:hi]


def train(sample: list[Window], generated: int = GENERATED, epochs: int = EPOCHS, seed: int = SEED, write: Callable[[np.random.Generator], str] = generate) -> Labeller:
    """The labeller, by Adam on the given windows and on pages that `write` writes."""
    rng = np.random.default_rng(seed)
    vectors, xs, ys = Vectors(), [x for x, _ in sample], [y for _, y in sample]
    for page in (write(rng) for _ in range(generated)):
        for _, paths, rests, labels in windows(*marked(page), vectors):
            xs.append(whole(paths, rests))
            ys.append(np.array(labels, np.float32))
    model = Labeller.fresh(rng)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for _ in range(epochs):
        order = np.argsort([len(x) + rng.random() * 8 for x in xs], kind="stable")
        batches = [order[i : i + 32] for i in range(0, len(order), 32)]
        for b in rng.permutation(len(batches)):
            x, mask = _pad([xs[i] for i in batches[b]])
            y = np.zeros_like(mask)
            for k, i in enumerate(batches[b]):
                y[: len(ys[i]), k] = ys[i]
            step += 1
            for k, g in model.gradient(x, mask, y).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                model.p[k] -= (0.015 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def label(model: Labeller, pages: list[list[Block]], vectors: Vectors) -> list[np.ndarray]:
    """For each page which of its blocks are main text. Pages of like length are read together, long ones alone."""
    out = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    while order and len(pages[order[-1]]) > STEPS:
        i = order.pop()
        out[i] = model.long_logits(pages[i], vectors) > 0
    at = 0
    while at < len(order):
        # fewer at once when they are long
        take = order[at : at + max(1, min(PAGES, 20_000 // len(pages[order[min(at + PAGES, len(order)) - 1]])))]
        at += len(take)
        x, mask = _pad([vectors.some(pages[i], 0, len(pages[i])) for i in take])
        z = model.logits(x, mask)
        for k, i in enumerate(take):
            out[i] = z[: len(pages[i]), k] > 0
    return out


def _slices(html: pa.Array):
    """(from, to) of rows that are read at once: PAGES or so, fewer if they are long."""
    lo = chars = 0
    for i, x in enumerate(html):
        if i > lo and (i - lo >= 4 * PAGES or chars + len(x.as_py() or "") > CHARS):
            yield lo, i
            lo, chars = i, 0
        chars += len(x.as_py() or "")
    if lo < len(html):
        yield lo, len(html)


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url and the main text of each page."""

    def run(batches):
        vectors = Vectors()
        for batch in batches:
            for lo, hi in _slices(batch.column(2)):
                rows = batch.slice(lo, hi - lo)
                found = [blocks(h) for h in rows.column(2).to_pylist()]
                texts = [" ".join(b.text for b, ok in zip(bs, keep) if ok) for bs, keep in zip(found, label(model, found, vectors))]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(pages["page_id"].cast("long"), pages["url"].cast("string"), pages["html"].cast("string")).mapInArrow(run, "page_id long, url string, text string")


def sample_windows(pages: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_WINDOWS) -> list[Window]:
    """Training windows of at most `sample` pages, those whose ids hash lowest, one row of an id: all windows, or the `most` that hash lowest."""
    ids = pages.where("page_id is not null").select("page_id").distinct().orderBy(F.xxhash64(F.lit(4), "page_id"), "page_id").limit(sample)
    ids = [r["page_id"] for r in ids.collect()]
    if not ids:
        return []
    # of equal ids one row, chosen where the rows are
    one = pages.where(F.col("page_id").isin(ids)).groupBy("page_id").agg(F.min_by(F.coalesce("html", F.lit("")), F.xxhash64("html")).alias("html"))

    def run(batches):
        vectors = Vectors()
        for batch in batches:
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = blocks(html)
                for k, paths, rests, labels in windows(found, [stands(b.path) for b in found], vectors):
                    row = [page], [k], [[p.tolist() for p in paths]], [np.concatenate(rests).tolist()], [labels]
                    kinds = pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.float32()), pa.list_(pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds)], names=["page", "k", "paths", "rests", "labels"])

    found = cut(one.mapInArrow(run, "page long, k long, paths array<array<int>>, rests array<float>, labels array<boolean>"), "html-windows")
    rows = found.orderBy(F.xxhash64(F.lit(5), "page", "k"), "page", "k").limit(most).collect()
    return [(whole([np.array(p, dtype=int) for p in r["paths"]], np.array(r["rests"], np.float32)), np.array(r["labels"], np.float32)) for r in rows]


def fit(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """The labeller for a table."""
    return train(sample_windows(pages, sample))


def op4_html(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return extract(pages, fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
