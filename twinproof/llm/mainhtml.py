"""Main text of web pages by a linear-chain conditional random field over leaf blocks (operator 3).

A page is read into leaf blocks, runs of text between block-level tags, each with the tags and class names around it. A chain with two labels
scores blocks by features of ancestors and text, and neighbouring labels by transitions; it is trained by gradient ascent on the
likelihood over labelled pages and decoded by Viterbi. Labelled pages are a bounded sample of the pages that mark their article
up themselves, of which every second one is shown without that mark, and small pages written here whose blocks are labelled one by one.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.base import slices

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo br cite code data del dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
UNSEEN = set("head script style template noscript svg math iframe object textarea select title".split())
RAW = ("script", "style", "textarea", "title")
CLOSES_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ARTICLE = ("article", "main")
#: What may stand in a head; anything else ends one whose end tag is left out.
HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())

#: Pages that the chain is trained on, at most, and passes over them.
SAMPLE, STEPS = 300, 120

#: Comments, marked sections, declarations and end tags without a name; heads of tags; text. A page's text behind its last ``>`` has no tags.
_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)|[^<]+|<""", re.S)
_TAIL = re.compile(r"<!--.*|<!\[CDATA\[.*|<[!?].*|[^<]+|<", re.S)
#: An attribute's value, with its quote if it has one, or the end of a tag.
_STOP = re.compile(r"""=\s*(?:(["'])|[^\s>"'][^\s>]*)|>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_END = {t: re.compile(rf"</{t}\b", re.I) for t in RAW}


def tag_ends(page: str):
    """A function that gives the place behind the tag whose name ends at a place; some ``>`` must lie behind it.

    Only quotes that open an attribute's value hide a ``>``. A quote that is never closed hides nothing. Once quotes leave a tag without
    an end, this one and all later tags of the page end at their next ``>``, so a page is read in linear time however broken.
    """
    unclosed: set[str] = set()
    plain = False

    def end(at: int) -> int:
        nonlocal plain
        k = at
        while not plain:
            m = _STOP.search(page, k)
            if m is None:
                plain = True
            elif m[0] == ">":
                return m.end()
            elif m[1] is None:
                k = m.end()
            elif m[1] not in unclosed and (close := page.find(m[1], m.end())) >= 0:
                k = close + 1
            else:
                unclosed.add(m[1])
                if stop := page.find(">", m.end()) + 1:
                    return stop
                plain = True
        return page.find(">", at) + 1

    return end


def leaf_blocks(page: str | None) -> list[tuple[str, tuple[str, ...], int]]:
    """Leaf blocks of a page: (text, features of the ancestors, characters that lie in links).

    Broken markup loses no text: sections that are not closed run to the end of the page, and ``<`` is text where no tag begins or ends.
    Comments, declarations and end tags without a name that are not closed hide the rest, as in a browser.
    """
    page = page or ""
    out: list[tuple[str, tuple[str, ...], int]] = []
    # Open elements, each with the features of itself and its ancestors; and how many of each name are open.
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, in_link, unseen, context = 0, 0, 0, None
    tag_end, endless = tag_ends(page), set()

    def around():
        return stack[-1][1] if stack else ()

    def flush():
        nonlocal linked
        text = "".join(parts)
        if text and not text.isspace():
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            if text:
                out.append((text, around() if context is None else context, linked))
        parts.clear()
        linked = 0

    def close(k):
        nonlocal unseen
        for t, _ in stack[k:]:
            unseen -= t in UNSEEN
            opened[t] -= 1
        del stack[k:]

    def innermost(name):
        return next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)

    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        m = (_TOKEN if at < last else _TAIL).match(page, at)
        at = m.end()
        if not m.lastindex:
            text = m[0]
            if stack and stack[-1][0] == "head" and (text[0] != "<" or len(text) == 1) and not text.isspace():
                close(len(stack) - 1)
            if not unseen:
                if text[0] != "<" or len(text) == 1:
                    if context is None and not text.isspace():
                        context = around()
                    parts.append(text)
                    if in_link:
                        linked += len(text)
                elif text.startswith("<![CDATA["):
                    parts.append(text[9:].removesuffix("]]>"))
            continue
        name, at = m[2].lower(), tag_end(at)
        marked = page[m.end() : at - 1]
        if not m[1] and name not in HEAD and unseen:
            if stack[-1][0] == "head":
                close(len(stack) - 1)
            elif name == "body" and opened["head"]:
                close(next(k for k, (t, _) in enumerate(stack) if t == "head"))
        if name in INLINE:
            if name == "a":
                in_link = 0 if m[1] else 1
            elif name == "br":
                parts.append(" ")
            continue
        flush()
        context = None
        if m[1]:
            if opened[name]:
                close(innermost(name))
            continue
        in_link = 0
        if name in VOID:
            continue
        if name in CLOSES_P and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        elif name in ("li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1][0] == name:
            close(len(stack) - 1)
        if marked.endswith("/") and name not in CLOSES_P:
            continue
        marks = [f"<{name}>"]
        for v in _NAMES.findall(marked):
            marks += [f".{w}" for w in re.split(r"[^a-z]+", "".join(v).lower()) if w]
        above = around()
        stack.append((name, above if all(f in above for f in marks) else tuple(dict.fromkeys([*above, *marks]))))
        opened[name] += 1
        if name in UNSEEN:
            unseen += 1
            if name in RAW and name not in endless:
                if end := _END[name].search(page, at):
                    at = end.start()
                else:
                    endless.add(name)
    flush()
    return out


def features(blocks: list[tuple[str, tuple[str, ...], int]]) -> list[list[str]]:
    """Names of the features of each block: ancestors, own element, length, links, punctuation, place in the page."""
    out = []
    for k, (text, around, linked) in enumerate(blocks):
        n = len(text)
        own = next((f for f in reversed(around) if f[0] == "<"), "<>")
        f = ["bias", *around, f"own{own}", f"long{min(5, n.bit_length() // 2)}", f"links{min(4, 4 * linked // n)}"]
        f.append(f"stops{min(3, text.count('.') + text.count('!') + text.count('?'))}")
        if "©" in text:
            f.append("copyright")
        if text[-1] not in ".!?:;\"')":
            f.append("open")
        if k == 0:
            f.append("first")
        if k == len(blocks) - 1:
            f.append("last")
        out.append(f)
    return out


# Pages written for training: text "+" before a block of the article, "-" before any other; {} is filled with sentences of the sample.
WRITTEN = [
    "<header><h2>-{}</h2></header><nav><ul><li><a>-Home</a><li><a>-About us</a></ul></nav><main><h1>+{}</h1><p>+{}<p>+{}<p>+{}</main><aside class=sidebar><h3>-Related</h3><ul><li><a>-{}</a><li><a>-{}</a></ul></aside><footer>-&copy; {}</footer>",
    "<div class=menu><a>-Start</a></div><div class='cookie-notice'>-{}<button>-Accept</button></div><div class=content><h1>+{}</h1><p>+{}</p><p>+{}</p><blockquote>+{}</blockquote></div><div id=comments><h3>-Comments</h3><div class=comment><p>-{}</p></div><div class=comment><p>-{}</p></div></div><div class=footer>-{}</div>",
    "<nav>-{}</nav><article><h1>+{}</h1><p>+{}</p><div class='ad banner'>-{}</div><p>+{}</p><ul><li>+{}<li>+{}</ul><form><p>-{}</p><label>-Name</label></form><p>+{}</p><section class=comments><article class=comment><p>-{}</p></article><article class=comment><p>-{}</p></article></section></article><footer>-{}</footer>",
    "<div class=header>-{}</div><div class='notice banner'><p>-{}</p></div><section class=post><h2>+{}</h2><p>+{}</p><table><tr><td>+{}<td>+{}</table><pre>+{}</pre><p>+{}</p></section><div class='sidebar widget'><p>-{}</p></div><div class='newsletter subscribe'><form>-{}</form></div><footer><p>-{}</p></footer>",
    "<article><header><h1>+{}</h1></header><p>+{}</p><aside class=related>-{}</aside><h2>+{}</h2><p>+{}</p><figure><figcaption>+{}</figcaption></figure><footer>-{}</footer></article><div class='share social'><a>-Share</a></div><div class='reviews comments' id=disqus><p>-{}</p></div>",
    "<article><p>+{}</article>", "<main><h1>+{}</h1><p>+{}</main>", "<article>+{}</article>", "<nav>-{}</nav><article><p>+{}</p></article>",
    "<div class='advert sponsored promo'><p>-{}</p></div><div id=main><h1>+{}</h1><p>+{}<p>+{}</div><div class=breadcrumbs><a>-{}</a></div><div role=complementary class=aside><p>-{}</p></div><div class='legal disclaimer cookie consent popup'>-{}</div>",
]


def written_pages(sentences: list[str]) -> list[tuple[list[list[str]], list[int]]]:
    """The written pages, filled: features and labels of their blocks."""
    out, at = [], 0
    pool = sentences or ["Lorem ipsum dolor sit amet, consectetur adipiscing elit."]
    for page in WRITTEN * 8:
        filled = ""
        for part in re.split(r"(\{\})", page):
            if part == "{}":
                part, at = entities.escape(pool[at % len(pool)]), at + 1
            filled += part
        blocks = leaf_blocks(f"<html><body>{filled}</body></html>")
        labels = [int(t[0] == "+") for t, _, _ in blocks]
        out.append((features([(t[1:] or " ", a, n) for t, a, n in blocks]), labels))
    return out


class Chain:
    """A linear chain with labels 0 and 1: weights of features per label difference, and transitions."""

    def __init__(self, weights: dict[str, float], moves: list[list[float]]):
        self.weights, self.moves = weights, moves

    def decode(self, names: list[list[str]]) -> list[int]:
        """Viterbi: the most probable labels."""
        if not names:
            return []
        get, ((aa, ab), (ba, bb)) = self.weights.get, self.moves
        a, b, back = 0.0, 0.0, []
        for k, f in enumerate(names):
            s = sum(get(x, 0.0) for x in f)
            if k == 0:
                a, b = 0.0, s
                continue
            to_a, to_b = a + aa >= b + ba, a + ab >= b + bb
            back.append((0 if to_a else 1, 0 if to_b else 1))
            a, b = (a + aa if to_a else b + ba), (a + ab if to_b else b + bb) + s
        y = [int(b > a)]
        for pair in reversed(back):
            y.append(pair[y[-1]])
        return y[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = STEPS, rate: float = 0.1, ridge: float = 1e-5) -> Chain:
    """Maximum likelihood by Adam, gradients by forward and backward sums over all pages at once."""
    pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[1]))
    names = {f: i for i, f in enumerate(sorted({f for fs, _ in pages for b in fs for f in b}))}
    t, n = max(len(y) for _, y in pages), len(pages)
    owner = np.array([(i, k) for i, (fs, _) in enumerate(pages) for k in range(len(fs))])
    x = np.zeros((len(owner), len(names)))
    for r, b in enumerate(b for fs, _ in pages for b in fs):
        x[r, [names[f] for f in b]] = 1
    y = np.concatenate([np.array(labels) for _, labels in pages])
    here = np.zeros((n, t), bool)
    here[owner[:, 0], owner[:, 1]] = True
    gold = np.zeros((n, t), int)
    gold[owner[:, 0], owner[:, 1]] = y
    ends = here.sum(1) - 1
    going = here.sum(0)  # pages that have a block at this place; they are the first ones
    w, moves = np.zeros(len(names)), np.zeros((2, 2))
    pair = here[:, 1:]
    seen = np.array([[(pair & (gold[:, :-1] == i) & (gold[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    total = len(owner)
    mean, var = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    add = lambda a: np.logaddexp(a[..., 0], a[..., 1])
    for step in range(1, steps + 1):
        unary = np.zeros((n, t, 2))
        unary[owner[:, 0], owner[:, 1], 1] = x @ w
        fore, back = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        fore[:, 0] = unary[:, 0]
        for k in range(1, t):
            m = going[k]
            fore[:m, k] = add(np.swapaxes(fore[:m, k - 1, :, None] + moves, 1, 2)) + unary[:m, k]
        for k in range(t - 2, -1, -1):
            m = going[k + 1]
            back[:m, k] = add(moves + (unary[:m, k + 1] + back[:m, k + 1])[:, None, :])
        z = add(fore[np.arange(n), ends])
        p = np.exp((fore + back)[owner[:, 0], owner[:, 1], 1] - z[owner[:, 0]])
        both = np.exp(fore[:, :-1, :, None] + moves + (unary + back)[:, 1:, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
        grad = np.concatenate(((x.T @ (y - p)) / total - ridge * w, ((seen - both.sum((0, 1))) / total - ridge * moves).ravel()))
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
        w += move[: len(w)]
        moves += move[len(w):].reshape(2, 2)
    return Chain({f: float(w[i]) for f, i in names.items()}, moves.tolist())


_MINED = pa.schema([("features", pa.list_(pa.list_(pa.string()))), ("labels", pa.list_(pa.int8())), ("sentence", pa.string())])


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled blocks of pages that mark their article up: at most 100 blocks of a page, from its start and end."""
    for batch in batches:
        out = []
        for page, hide in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            blocks = leaf_blocks(page)
            tags = [set(a) for _, a, _ in blocks]
            labels = [int(any(f"<{t}>" in s for t in ARTICLE) and not s & {"<nav>", "<aside>", "<form>", ".comment", ".comments", ".ad"}) for s in tags]
            if not any(labels) or all(labels):
                continue
            if hide:
                blocks = [(t, tuple(f for f in a if f not in ("<article>", "<main>")), n) for t, a, n in blocks]
            names = features(blocks)
            if len(names) > 100:
                names, labels = names[:50] + names[-50:], labels[:50] + labels[-50:]
            text = next(t for (t, _, _), y in zip(blocks, labels) if y)
            out.append({"features": names, "labels": labels, "sentence": text[:300]})
        yield pa.RecordBatch.from_pylist(out, schema=_MINED)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Chain:
    """Train a chain on at most ``sample`` pages, those with the smallest hashes; what comes to the driver is features, 100 blocks a page."""
    few = pages.filter(F.col(html_col).rlike("(?i)<(article|main)\\b")).select(F.col(html_col).alias("html"), F.xxhash64(F.col(id_col)).alias("h")).orderBy("h", "html").limit(sample)
    mined = few.select("html", (F.pmod("h", F.lit(2)) == 0).alias("hide")).mapInArrow(
        _mine, "features array<array<string>>, labels array<byte>, sentence string").collect()
    rows = [(r["features"], list(r["labels"])) for r in mined]
    return train(rows + written_pages([r["sentence"] for r in mined]))


def extract(pages: DataFrame, chain: Chain | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page, its blocks joined by line feeds.

    NULL or empty html, and pages without a block of the article, give an empty text. Repeated pages are read each; very long ones whole. An empty
    table gives an empty result (the chain is then trained on the written pages alone).
    """
    chain = chain or fit(pages, id_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for page in batch.column(2).to_pylist():
                blocks = leaf_blocks(page)
                texts.append("\n".join(b[0] for b, y in zip(blocks, chain.decode(features(blocks))) if y))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
