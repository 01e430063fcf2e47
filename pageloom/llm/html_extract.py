"""HTML extraction by a recurrent block labeller.

A page is cut to its leaf blocks in order. Each block is a vector of its hashed
tag path, its hashed words and a few measures; a bidirectional LSTM in numpy reads
the blocks of the whole page and says which are main text. The network is trained
here, on pages that generated_page() makes with known labels.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import shared_dir, slices, tidy, to_batch

#: What follows a tag's name up to its end: a quoted value counts as one piece, a quote that isn't closed as a character.
REST = re.compile(r"""[^>"'=]*+(?:(?:=\s*+(?:"[^"]*+"|'[^']*+')|["'=])[^>"'=]*+)*+>""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: Elements whose content is no text of the page.
RAW = {t: re.compile(rf"</{t}[^>]*>", re.I) for t in "script style noscript template title textarea select svg iframe object".split()}
ATTRS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
BREAKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A tag that such an opening tag ends.
ENDS = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PATH, WORDS, MEASURES, HIDDEN = 512, 16, 7, 16
SIZE = PATH + WORDS + MEASURES


def _slot(word: str, n: int) -> int:
    return zlib.crc32(word.encode()) % n


def _names(tag: str, attrs: str) -> tuple[str, ...]:
    if not attrs:
        return (tag,)
    found = " ".join(a or b or c for a, b, c in ATTRS.findall(attrs)).lower()
    return (tag, *(f".{x}" for x in re.split(r"[^a-z]+", found) if x))


def tags(page: str):
    """(start, end, name, closes, attributes) of each piece of mark-up in page order; name is '' for what gives no tag.

    One pass: nothing that was read is read again, however malformed the page. A tag that the page's end cuts off is
    mark-up up to the end, and so is a comment or a raw element without its end.
    """
    at, n = 0, len(page)
    while True:
        i = page.find("<", at)
        if i < 0:
            return
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            at = n if j < 0 else j + 3
            yield i, at, "", False, ""
            continue
        if page.startswith(("<!", "<?"), i):
            j = page.find(">", i)
            at = n if j < 0 else j + 1
            yield i, at, "", False, ""
            continue
        closes = page.startswith("</", i)
        m = NAME.match(page, i + 1 + closes)
        if m is None:
            at = i + 1  # a "<" of the text
            continue
        end = REST.match(page, m.end())
        if end is None:
            yield i, n, "", False, ""
            return
        name, at = m.group().lower(), end.end()
        if name in RAW and not closes:
            stop = RAW[name].search(page, at)
            at = n if stop is None else stop.end()
            yield i, at, "", False, ""
            continue
        yield i, at, name, closes, end.group()


def _mask(names: tuple[str, ...]) -> int:
    out = 0
    for x in names:
        out |= 1 << _slot(x, PATH)
    return out


def blocks(page: str) -> list[tuple[str, int, str, int]]:
    """(text, hashed names on its path as bits, innermost tag, characters in links) of each block with text, in page order.

    A block is the text between two block-level tags, character references decoded, white space one space. Scripts,
    styles, titles, comments and tags give no text; a tag cut off by the end of the page is dropped.
    """
    out, stack, buf, linked, in_link, at = [], [("", 0)], [], 0, 0, 0
    opened: dict[str, int] = {}

    def close():
        nonlocal buf, linked
        if buf:
            text = " ".join(entities.unescape("".join(buf)).split())
            if text:
                out.append((text, stack[-1][1], stack[-1][0], min(linked, len(text))))
            buf, linked = [], 0

    def pop():
        tag, _ = stack.pop()
        opened[tag] -= 1

    for start, end, tag, closes, attrs in tags(page):
        if start > at:
            piece = page[at:start]
            buf.append(piece)
            if in_link:
                linked += len(piece)
        at = end
        if not tag:
            continue
        if closes:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag not in BREAKS:
                continue
            close()
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
                in_link = 0
            continue
        if tag == "a":
            in_link = 1
        elif tag == "br":
            buf.append(" ")
        if tag not in BREAKS:
            continue
        close()
        if tag in VOID:
            continue
        while stack[-1][0] in ENDS.get(tag, {"p"}):
            pop()
        stack.append((tag, stack[-1][1] | _mask(_names(tag, attrs))))
        opened[tag] = opened.get(tag, 0) + 1
    if at < len(page):
        buf.append(page[at:])
    close()
    return out


@functools.lru_cache(100_000)
def _path(mask: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(mask.to_bytes(PATH // 8, "little"), np.uint8), bitorder="little").astype(np.float32)


@functools.lru_cache(200_000)
def _word(word: str) -> int:
    return _slot(word, WORDS)


def vectors(page_blocks: list[tuple[str, int, str, int]]) -> np.ndarray:
    """A row a block: its hashed path, the shares of its words by hash (all words), and a few measures."""
    x = np.zeros((len(page_blocks), SIZE), np.float32)
    for i, (text, mask, tag, linked) in enumerate(page_blocks):
        x[i, :PATH] = _path(mask)
        toks = text.lower().split()
        x[i, PATH : PATH + WORDS] = np.bincount(list(map(_word, toks)), minlength=WORDS) / len(toks)
        n = len(text)
        x[i, PATH + WORDS :] = (np.log1p(n) / 8, linked / n, text[-1] in ".!?…", tag[:1] == "h" and tag[1:].isdigit(), len(toks) > 12, "©" in text, i / len(page_blocks))
    return x


class Labeller:
    """Bidirectional LSTM and a logistic output; weights in one dict of arrays."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = r.normal(0, 0.15, (SIZE, 4 * HIDDEN)).astype(np.float32)
            self.w[f"h{d}"] = r.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.w[f"o{d}"] = np.zeros(4 * HIDDEN, np.float32)
            self.w[f"o{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.w["out"] = r.normal(0, 0.15, (2 * HIDDEN + SIZE,)).astype(np.float32)
        self.w["bias"] = np.zeros(1, np.float32)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """States of one direction over x (time, page, feature); where mask is 0 the state stays as it was."""
        t, n, _ = x.shape
        z_in = x.reshape(-1, SIZE) @ self.w[f"x{d}"] + self.w[f"o{d}"]
        z_in = z_in.reshape(t, n, -1)
        h = c = np.zeros((n, HIDDEN), np.float32)
        states, tape = np.zeros((t, n, HIDDEN), np.float32), []
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = z_in[s] + h @ self.w[f"h{d}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            c2 = f * c + i * g
            tc = np.tanh(c2)
            m = mask[s][:, None]
            h2 = m * (o * tc) + (1 - m) * h
            if keep:
                tape.append((s, h, c, i, f, o, g, tc, m))
            c, h = m * c2 + (1 - m) * c, h2
            states[s] = h
        return states, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, tf = self._run("f", x, mask, keep)
        b, tb = self._run("b", x, mask, keep)
        joined = np.concatenate([f, b, x], axis=2)
        return 1 / (1 + np.exp(-(joined @ self.w["out"] + self.w["bias"][0]))), joined, (tf, tb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, joined, tapes = self.forward(x, mask, True)
        dz = (p - y) * mask / mask.sum()
        grad = {"out": np.einsum("tn,tnk->k", dz, joined), "bias": np.array([dz.sum()], np.float32)}
        for d, tape, at in (("f", tapes[0], 0), ("b", tapes[1], HIDDEN)):
            dh_out = dz[:, :, None] * self.w["out"][at : at + HIDDEN]
            dzs = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            gh = np.zeros_like(self.w[f"h{d}"])
            dh = dc = np.zeros((mask.shape[1], HIDDEN), np.float32)
            for s, h, c, i, f, o, g, tc, m in reversed(tape):
                dh = dh + dh_out[s]
                dcell = m * (dc + dh * o * (1 - tc * tc))
                part = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), m * dh * tc * o * (1 - o), dcell * i * (1 - g * g)], axis=1)
                dzs[s] = part
                gh += h.T @ part
                dh = part @ self.w[f"h{d}"].T + (1 - m) * dh
                dc = dcell * f + (1 - m) * dc
            flat = dzs.reshape(-1, 4 * HIDDEN)
            grad |= {f"x{d}": x.reshape(-1, SIZE).T @ flat, f"h{d}": gh, f"o{d}": flat.sum(axis=0)}
        return grad

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """True for the main blocks of each page; pages of like length run together."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        for s in range(0, len(order), 128):
            group = order[s : s + 128]
            while group:
                part = group[: max(1, 200_000 // len(pages[group[-1]]))]
                group = group[len(part) :]
                p, _, _ = self.forward(*padded([pages[k] for k in part]))
                for j, k in enumerate(part):
                    out[k] = p[: len(pages[k]), j] >= 0.5
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((t, len(pages), SIZE), np.float32), np.zeros((t, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, 1
    return x, mask


_PIECES = "an er on the re ti ou st en th ing ar el um qua zo ve ri mel dor fi ba ché ñu öl ka".split()
_FURNITURE = {
    "nav": ("nav", "div.menu", "ul.nav", "div.navbar", "div.breadcrumbs", "div.topbar", "div.navigation", "div.toolbar", "div.tabs", "div.pagination", "div.links", "ul.list"),
    "header": ("header", "div.header", "div.masthead", "div.banner", "div.logo", "div.top", "div.brand", "div.hero"),
    "footer": ("footer", "div.footer", "div#footer", "div.copyright", "div.bottom", "div.colophon", "div.legal", "div.imprint", "div.credits", "div.site.info", "p.small"),
    "side": ("aside", "div.sidebar", "div#sidebar", "div.widget", "div.related", "section.related", "div.promo", "div.share", "div.social", "div.tags", "div.rail", "div.right", "div.column", "section.recommended", "div.more", "div.trending", "div.author"),
    "ad": ("div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "section.ad", "div.banner.ad"),
    "notice": ("div.cookie", "div.cookie.notice", "div.notice", "div.consent", "div.newsletter", "div.popup", "div.modal", "div.alert"),
    "form": ("form", "form.search", "form.login", "div.form", "div.subscribe"),
    "comments": ("section.comments", "div.comments", "div#comments", "ol.comments", "div.comment", "section#comments", "div.replies", "div.responses"),
}
_MAINS = ("article", "main", "div.content", "div#content", "div.post", "section.post", "div.article", "main>article", "div.main>div.entry", "div.story", "div.text", "div.body", "article.post>div.entry.content", "div.page>div.copy", "div.wrapper>section.reading", "td.main", "div.hentry")
_STOCK = {"form": "Search Submit Email Login Password Sign up", "notice": "We use cookies Accept Close Subscribe to our newsletter", "comments": "Reply Comments says ago like", "footer": "© All rights reserved Privacy Terms Contact", "nav": "Home About News Contact", "ad": "Advertisement Buy now Sponsored", "side": "Related Popular Share Tags Recent posts", "header": "Welcome Menu"}


def generated_page(r: np.random.Generator) -> tuple[str, list[tuple[str, bool]]]:
    """A made-up page and its blocks with labels (main text or not), for training and tests."""
    truth: list[tuple[str, bool]] = []
    pick = lambda xs: xs[int(r.integers(len(xs)))]

    def words(n: int) -> str:
        noise, loud = r.random() < 0.15, r.random() < 0.1
        out = ["".join(pick(_PIECES) for _ in range(int(r.integers(1, 4)))) + ("".join(pick("#$%*&@~^+=|<>{}") for _ in range(int(r.integers(1, 5)))) if noise else "") for _ in range(max(1, n))]
        if loud:
            return pick((" | ".join(out), "!! ".join(out).upper() + "!!", " ".join(out[:1] * len(out))))
        return " ".join(out).capitalize() + pick((".", ".", ".", "", "!", "?"))

    def put(text: str, main: bool) -> str:
        truth.append((" ".join(text.split()), main))
        return entities.escape(text, quote=False)

    def wrap(spec: str, inner: str) -> str:
        for part in reversed(spec.split(">")):
            tag, *names = re.split(r"(?=[.#])", part)
            cls = " ".join(n[1:] for n in names if n[0] == ".")
            ids = "".join(f' id="{n[1:]}"' for n in names if n[0] == "#")
            inner = f"<{tag}" + (f' class="{cls}"' if cls else "") + f"{ids}>{inner}</{tag}>"
        return inner

    def furniture(kind: str) -> str:
        stock = _STOCK[kind].split()
        line = lambda: pick(stock) if r.random() < 0.4 else words(int(r.integers(1, 25 if kind in ("ad", "comments", "notice", "footer", "side") else 4)))
        spec, style = pick(_FURNITURE[kind]), r.random()
        if kind in ("nav", "side") and style < 0.6:
            head = pick(("h2", "h3", "h4"))
            inner = f"<{head}>{put(words(int(r.integers(1, 4))), False)}</{head}>" if r.random() < 0.4 else ""
            inner += "<ul>" + "".join(f'<li><a href="/{i}">{put(line(), False)}</a></li>' for i in range(int(r.integers(2, 8)))) + "</ul>"
            spec = spec if r.random() < 0.8 else "div." + "".join(pick(_PIECES) for _ in range(3))  # a name that says nothing
        elif style < 0.5:
            inner = put(line(), False)
        else:
            inner = "".join(f"<{t}>{put(line(), False)}</{t}>" for t in (pick(("p", "div", "h3", "li")) for _ in range(int(r.integers(1, 5)))))
        return wrap(spec, inner)

    def main() -> str:
        out = []
        if r.random() < 0.8:
            out.append(f"<h1>{put(words(int(r.integers(1, 12))), True)}</h1>")
        for _ in range(int(r.integers(1, 14) if r.random() < 0.8 else r.integers(14, 70))):
            style = r.random()
            n = int(r.choice([1, 2, 5, 15, 40, 90]))
            if style < 0.6:
                out.append(f"<p>{put(words(n), True)}</p>")
            elif style < 0.7:
                out.append(f"<p><b>{put(words(n), True)}<br>")
            elif style < 0.8:
                out.append(f"<h{int(r.integers(2, 5))}>{put(words(int(r.integers(1, 7))), True)}</h2>")
            elif style < 0.87:
                if r.random() < 0.5:
                    out.append(f"<h{int(r.integers(2, 5))}>{put(words(int(r.integers(1, 7))), True)}</h2>")
                out.append("<ul>" + "".join(f"<li>{put(words(int(r.integers(1, 12))), True)}</li>" for _ in range(int(r.integers(1, 5)))) + "</ul>")
            elif style < 0.92:
                out.append(f"<blockquote>{put(words(n), True)}</blockquote>")
            elif style < 0.96:
                out.append(f'<p>{put(words(3).rstrip("."), True)}</p><div>{put(words(n), True)}</div>')
            else:
                out.append(furniture(pick(("ad", "form", "side", "notice", "comments"))))
        spec = pick(_MAINS) if len(out) < 4 or r.random() < 0.6 else pick(("div.", "section.")) + "".join(pick(_PIECES) for _ in range(3)) + pick(("", ".body", ".page", ".text"))
        return wrap(spec, "".join(out))

    top = [k for k in ("notice", "header", "nav", "form", "ad", "side") if r.random() < 0.5]
    tail = [k for k in ("side", "comments", "ad", "form", "notice", "nav") if r.random() < 0.4]
    r.shuffle(top)
    body = "".join(furniture(k) for k in top) + main() + "".join(furniture(k) for k in tail)
    if r.random() < 0.7:
        body += furniture("footer")
    page = f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{margin:0}}</style></head><body>{body}"
    return page + ("</body></html>" if r.random() < 0.8 else ""), truth


def labelled_pages(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of generated pages; a page whose cut doesn't give the blocks it was made of is left out."""
    r, out = np.random.default_rng(seed), []
    for _ in range(n):
        page, truth = generated_page(r)
        cut = blocks(page)
        if [b[0] for b in cut] == [t for t, _ in truth]:
            out.append((vectors(cut), np.array([m for _, m in truth], np.float32)))
    return out


@functools.lru_cache(1)
def trained(n_pages: int = 1800, epochs: int = 9, seed: int = 11) -> Labeller:
    """The labeller fitted by Adam on generated pages. The same on every machine that rounds alike; made once a process."""
    data, net, r = labelled_pages(n_pages, seed), Labeller(), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(w) for k, w in net.w.items()}
    step = 0
    for epoch in range(epochs):
        rate = 0.02 if epoch < epochs * 0.6 else 0.005
        order = r.permutation(len(data))
        # pages of like length in a batch, batches in any order
        order = np.concatenate([sorted(order[s : s + 256], key=lambda k: len(data[k][1])) for s in range(0, len(order), 256)])
        for s in r.permutation(range(0, len(order), 32)):
            part = [data[k] for k in order[s : s + 32]]
            x, mask = padded([p[0] for p in part])
            y = np.zeros_like(mask)
            for j, (_, lab) in enumerate(part):
                y[: len(lab), j] = lab
            step += 1
            for k, g in net.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                net.w[k] = (net.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def stored_labeller(spark: SparkSession) -> Labeller:
    """The trained labeller from the shared folder; trained and put there if no run before did. The name holds all that the weights depend on."""
    with open(__file__, "rb") as f:
        version = hashlib.sha256(f.read() + np.__version__.encode()).hexdigest()[:16]
    path = f"{shared_dir(spark)}/html-labeller-{version}"
    try:
        rows = spark.read.schema("name string, shape array<int>, weights binary").parquet(path).collect()  # ten rows
    except AnalysisException:
        rows = []
    net = Labeller()
    if {r.name for r in rows} == net.w.keys():
        net.w = {r.name: np.frombuffer(bytes(r.weights), "<f4").reshape(r.shape).copy() for r in rows}
        return net
    net = trained()
    rows = [(k, list(w.shape), bytearray(w.astype("<f4").tobytes())) for k, w in net.w.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, weights binary").coalesce(1).write.mode("overwrite").parquet(path)
    return net


def main_text(pages: list[str], net: Labeller) -> list[str]:
    cut = [blocks(p) for p in pages]
    keep = net.label([vectors(c) for c in cut])
    return ["\n\n".join(b[0] for b, k in zip(c, ks, strict=True) if k) for c, ks in zip(cut, keep, strict=True)]


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """page_id, url, text of every row: its main blocks, in order, joined by two line feeds.

    Null and empty pages, and pages without a main block, give an empty text. Pages of any length, however malformed, are
    read whole in time that grows with their length. Repeated rows are rows of their own; other columns don't matter.
    """
    shared = pages.sparkSession.sparkContext.broadcast(stored_labeller(pages.sparkSession))  # about 40,000 weights
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches):
        net = shared.value
        for b in batches:
            for s, e in slices(b.column(2), 1 << 21):
                texts = main_text([p or "" for p in b.column(2).slice(s, e - s).to_pylist()], net)
                yield to_batch(schema, [b.column(0).slice(s, e - s), b.column(1).slice(s, e - s), pa.array(texts, pa.string())])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(column).alias("html"))
    return rows.mapInArrow(tidy(run), "page_id long, url string, text string")
