"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks, runs of text without a block element's border inside. Each block has
features of its ancestors (tags, words of class and id) and of its text. The field has a weight per feature
and one per pair of neighbouring labels, is trained on labelled pages by gradient ascent on the conditional
likelihood, and decoded by Viterbi. Labelled pages are composed from layouts below, in which it is known which blocks
are the article, around words of a bounded sample of the pages at hand.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxloom.llm.common import query, table, texts

#: Pages whose words fill the labelled pages, and the largest page taken for that; the bound of the sample.
SAMPLE_PAGES = 40
SAMPLE_CHARS = 50_000
LABELLED_PAGES = 2000
EPOCHS = 8
RATE = 0.4

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript iframe object textarea title head select datalist canvas audio video".split())
TO_THE_END = frozenset("script style textarea title".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark math meter output q rp rt ruby s samp small "
                    "span strike strong sub sup svg time tt u var wbr").split())
CLOSES_PARAGRAPH = frozenset(("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                              "header hgroup hr main menu nav ol p pre search section summary table ul").split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table tr tbody thead tfoot div article section main body select".split())
NEUTRAL = frozenset(["html", "body", "div", "p", "span"])

# A quote delimits a value only directly after the equals sign.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|</?[a-zA-Z](?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PLAIN_WORD = re.compile(r"[a-z]+")


class Path:
    """A block element and those around it. Sets are shared with the parent where nothing is new, so deep nesting costs little."""

    __slots__ = ("inside", "last", "marks", "nearest", "parent", "tag")

    def __init__(self, tag: str, parent: Path | None = None, words: frozenset[str] = frozenset(), kept: frozenset[str] = frozenset()):
        self.tag, self.parent = tag, parent
        inside, marks = (parent.inside, parent.marks) if parent else (frozenset(), frozenset())
        self.inside = inside if not parent or tag in inside else inside | {tag}
        self.marks = marks if kept <= marks else marks | kept
        self.nearest = words or (parent.nearest if parent else words)
        self.last = parent.last if parent and tag in NEUTRAL else tag


class Block:
    """A leaf block: its text and what its features need."""

    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, linked: int, path: Path):
        self.text, self.linked, self.path = text, linked, path

    @property
    def tags(self) -> tuple[str, ...]:
        """Block tags from the outermost down to this block."""
        out, at = [], self.path
        while at.parent:
            out.append(at.tag)
            at = at.parent
        return tuple(out[::-1])

    @property
    def marks(self) -> frozenset[str]:
        return self.path.marks

    @property
    def nearest(self) -> frozenset[str]:
        return self.path.nearest


def blocks_of(page: str, known: Callable[[str], bool] | None = None) -> list[Block]:
    """Leaf blocks in page order, character references decoded and white space folded.

    Words of class and id are gathered from all ancestors; with `known`, only those it accepts. An element that is
    hidden by its kind but never closed hides nothing, except script, style, textarea and title.
    """
    out: list[Block] = []
    # Open elements: name, and the block element that holds their text.
    stack: list[tuple[str, Path]] = [("", Path(""))]
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()
    pieces: list[str] = []
    linked = 0
    in_link = 0

    def close_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                # Inline elements are no part of a block's path: what counts is the block that holds the text.
                out.append(Block(text, min(linked, len(text)), stack[-1][1]))
            pieces.clear()
        linked = 0

    def pop_to(at: int) -> None:
        nonlocal in_link
        for name, _ in stack[at:]:
            in_link -= name == "a"
            opened[name] -= 1
        del stack[at:]

    def find(names: set[str] | frozenset[str], stop: frozenset[str] = frozenset()) -> int:
        if not any(opened[name] for name in names):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in stop:
                break
        return 0

    at = 0
    while found := TOKEN.match(page, at):
        token = found.group()
        at = found.end()
        if token[0] != "<" or token == "<":
            text = html.unescape(token)
            pieces.append(text)
            if in_link:
                linked += len(text.strip())
            continue
        named = NAME.match(token)
        if not named:
            continue
        name = named.group(1).lower()
        if token[1] == "/":
            if name == "p" and not find({"p"}, frozenset(["div", "article", "section", "td"])):
                close_block()
            elif i := find({name}):
                if stack[-1][1] is not stack[i - 1][1]:
                    close_block()
                pop_to(i)
            continue
        if name in HIDDEN:
            if name == "head":
                ends = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                at = ends.start() if ends else at
                if ends is None:
                    continue
                if page[at + 1] == "/":
                    at = ends.end()
            elif not token.endswith("/>") and name not in unclosed:
                ends = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                if ends:
                    at = ends.end()
                elif name in TO_THE_END:
                    at = len(page)
                else:
                    unclosed.add(name)  # nor is any later one closed
            continue
        if name == "br":
            pieces.append(" ")
            continue
        # Formulas and drawings in a sentence don't split it, whatever their elements are called.
        inline = name in INLINE or bool(opened["math"] or opened["svg"]) and name not in CLOSES_PARAGRAPH and name not in SIBLINGS
        if not inline:
            close_block()
            if name in CLOSES_PARAGRAPH and (i := find({"p"}, frozenset(["div", "article", "section", "td", "li", "button"]))):
                pop_to(i)
            if name in SIBLINGS and (i := find(SIBLINGS[name], SCOPES - {"tr"} if name in ("td", "th", "tr") else SCOPES)):
                pop_to(i)
        if name in VOID or token.endswith("/>") and name not in ("p", "div", "a", "span"):
            continue
        in_link += name == "a"
        opened[name] += 1
        path = stack[-1][1]
        if not inline:
            words = frozenset(w for m in MARKS.finditer(token) for w in PLAIN_WORD.findall((m.group(1) or m.group(2) or m.group(3) or "").lower()))
            path = Path(name, path, words, words if known is None else frozenset(filter(known, words)))
        stack.append((name, path))
    close_block()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out = []
    n = len(blocks)
    longest = max((len(b.text) for b in blocks), default=0)
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        size = min(words.bit_length(), 8)
        link = min(4, 4 * b.linked // len(b.text))
        outer = b.path.inside - NEUTRAL
        f = ["bias", f"size{size}", f"link{link}", f"tag:{b.path.tag}", f"end:{b.text[-1] in '.!?…。'}", f"size{size}link{link}"]
        f += [f"in:{t}" for t in outer]
        f.append(f"last:{b.path.last}")
        inside = "article" if "article" in outer else "main" if "main" in outer else "none"
        f += [f"{inside}&{t}" for t in outer if t in ("header", "footer", "aside", "nav", "form", "h1", "h2", "h3", "li", "section")]
        f += [f"mark:{m}" for m in b.marks]
        f += [f"near:{m}" for m in b.nearest]
        f += [f"part:{m[:4]}" for m in b.marks if len(m) > 4]
        f.append(f"place{0 if i == 0 else 1 if i < n / 4 else 3 if i >= 3 * n / 4 else 2}")
        f.append(f"share{min(3, 4 * len(b.text) // (longest + 1))}")
        if "©" in b.text:
            f.append("copyright")
        out.append(f)
    return out


class Field:
    """Two labels, 1 for the main text: a weight per feature for label 1, and four for neighbouring labels."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.pairs = [[0.0, 0.0], [0.0, 0.0]]
        self.seen: dict[str, float] = {}

    def scores(self, sequence: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in block) for block in sequence]

    def viterbi(self, sequence: list[list[str]]) -> list[int]:
        """The best labels of the whole page."""
        s = self.scores(sequence)
        if not s:
            return []
        t = self.pairs
        best = (0.0, s[0])
        back: list[tuple[int, int]] = []
        for x in s[1:]:
            from_0 = 0 if best[0] + t[0][0] >= best[1] + t[1][0] else 1
            from_1 = 0 if best[0] + t[0][1] >= best[1] + t[1][1] else 1
            best = (best[from_0] + t[from_0][0], best[from_1] + t[from_1][1] + x)
            back.append((from_0, from_1))
        labels = [0 if best[0] >= best[1] else 1]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def learn(self, sequence: list[list[str]], labels: list[int], rate: float, decay: float = 1e-4) -> float:
        """One step uphill on the conditional likelihood of a page; its log likelihood before."""
        s, t, n = self.scores(sequence), self.pairs, len(sequence)

        def add(a: float, b: float) -> float:
            return max(a, b) + math.log1p(math.exp(-abs(a - b)))

        ahead = [(0.0, s[0])]
        for x in s[1:]:
            a = ahead[-1]
            ahead.append((add(a[0] + t[0][0], a[1] + t[1][0]), add(a[0] + t[0][1], a[1] + t[1][1]) + x))
        behind = [(0.0, 0.0)] * n
        for i in range(n - 2, -1, -1):
            b, x = behind[i + 1], s[i + 1]
            behind[i] = (add(t[0][0] + b[0], t[0][1] + x + b[1]), add(t[1][0] + b[0], t[1][1] + x + b[1]))
        total = add(*ahead[-1])
        reached = sum(s[i] for i in range(n) if labels[i]) + sum(t[labels[i]][labels[i + 1]] for i in range(n - 1))
        for i, block in enumerate(sequence):
            gradient = labels[i] - math.exp(ahead[i][1] + behind[i][1] - total)
            for f in block:
                w = self.weights.get(f, 0.0)
                g = gradient - decay * w
                self.seen[f] = self.seen.get(f, 1e-6) + g * g
                self.weights[f] = w + rate * g / math.sqrt(self.seen[f])
        change = [[0.0, 0.0], [0.0, 0.0]]
        for i in range(n - 1):
            for a in (0, 1):
                for b in (0, 1):
                    p = math.exp(ahead[i][a] + t[a][b] + (s[i + 1] if b else 0.0) + behind[i + 1][b] - total)
                    change[a][b] += (labels[i] == a and labels[i + 1] == b) - p
        for a in (0, 1):
            for b in (0, 1):
                t[a][b] += 0.1 * rate * change[a][b] / max(1, n - 1)
        return reached - total


#: Names that page authors give to what is not the article, and to what holds it.
ASIDE_NAMES = """ad ads advert advertisement adsense banner sponsor sponsored promo promotion sidebar side widget menu nav navbar navigation breadcrumb
breadcrumbs toc cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup related recommended
more share social follow comment comments reader discussion responses replies disqus feedback review footer colophon copyright legal disclaimer
header masthead topbar brand logo login search form pagination pager tags toolbar skip trending popular""".split()
ARTICLE_NAMES = "content article post entry main story body text page maincontent articlebody postcontent entrycontent hentry prose".split()
ASIDE_TAGS = ["nav", "header", "footer", "aside", "form", "div", "div", "div", "div", "section", "ul", "dialog"]
#: Stands before the text of article blocks while a labelled page is composed.
CONTENT = ""


def labelled_page(rng: random.Random, words: list[str]) -> str:
    """A page of some layout, the article's blocks marked by CONTENT."""

    def say(low: int, high: int, stop: bool = True) -> str:
        ws = [html.escape(rng.choice(words)) for _ in range(rng.randint(low, high))]
        if rng.random() < 0.1:
            ws.insert(rng.randrange(len(ws)), f"<b>{ws[0]}</b>")
        return " ".join(ws) + ("." if stop else "")

    def links() -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{say(1, 3, False)}</a></li>' for i in range(rng.randint(2, 7))) + "</ul>"

    def named(name: str) -> str:
        if rng.random() < 0.3:
            name = f"{rng.choice(['site', 'page', 'js', 'block', 'l', 'c', 'top'])}-{name}"
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def aside(kind: str | None = None) -> str:
        tag = kind or rng.choice(ASIDE_TAGS)
        mark = named(rng.choice(ASIDE_NAMES)) if tag in ("div", "section", "ul", "dialog") or rng.random() < 0.3 else ""
        inner = rng.choice([
            links, lambda: say(2, 12), lambda: f"<p>{say(3, 60)}</p>", lambda: f"<p>{say(1, 5)}</p><p>{say(5, 40)}</p>",
            lambda: f"<h{(k := rng.randint(1, 4))}>{say(1, 3, False)}</h{k}>" + "".join(f"<div><p>{say(4, 70)}</p></div>" for _ in range(rng.randint(1, 4))),
            lambda: f"<h1>{say(1, 3, False)}</h1>" + links(), lambda: f"<p>{say(1, 6)}</p>",
            lambda: f"<label>{say(1, 2, False)}</label><input><button>{say(1, 2, False)}</button>", lambda: f"&copy; {say(1, 4, False)} &middot; {say(2, 8)}"])()
        return f"<{tag}{mark}>{inner}</{tag}>"

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.75:
            text = f"<p>{CONTENT}{say(1, 3) if (size := rng.random()) < 0.15 else say(1, 12) if size < 0.35 else say(12, 120)}</p>"
        elif kind < 0.8:
            text = f"<h2>{CONTENT}{say(2, 8, False)}</h2>"
        elif kind < 0.85:
            text = "<ul>" + "".join(f"<li>{CONTENT}{say(2, 20)}</li>" for _ in range(rng.randint(2, 4))) + "</ul>"
        elif kind < 0.9:
            text = f"<blockquote><p>{CONTENT}{say(8, 40)}</p></blockquote>"
        else:
            text = f"<p><b>{CONTENT}{say(1, 30)}<br>"
        return text + (aside() if rng.random() < 0.1 else "")

    body = "".join(paragraph() for _ in range(rng.randint(1, 14)))
    title = f"<h1>{CONTENT}{say(2, 12, False)}</h1>"
    if rng.random() < 0.15:
        title = f"<header>{title}</header>"
    tag = rng.choice(["article", "article", "article", "main", "div", "div", "section"])
    mark = named(rng.choice(ARTICLE_NAMES)) if tag != "article" or rng.random() < 0.3 else ""
    main = f"<{tag}{mark}>{title}{body}</{tag}>"
    if rng.random() < 0.3:
        main = f"<main>{main}{aside('aside') if rng.random() < 0.5 else ''}</main>"
    before = "".join(aside(rng.choice(["nav", "header", None])) for _ in range(rng.randint(0, 3)))
    after = "".join(aside(rng.choice(["footer", None, None])) for _ in range(rng.randint(0, 3)))
    page = before + main + after
    if rng.random() < 0.3:
        page = f"<div{named(rng.choice(['wrapper', 'container', 'page', 'root', 'layout']))}>{page}</div>"
    return f"<!DOCTYPE html><html><head><title>{say(2, 6)}</title></head><body>{page}" + ("</body></html>" if rng.random() < 0.9 else "")


def train(words: list[str], pages: int = LABELLED_PAGES, epochs: int = EPOCHS, seed: int = 11) -> Field:
    """A field trained on composed labelled pages."""
    rng, field = random.Random(seed), Field()
    labelled = []
    for _ in range(pages):
        blocks = blocks_of(labelled_page(rng, words))
        labels = [int(b.text.startswith(CONTENT)) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(CONTENT, "") or "-"
            b.linked = min(b.linked, len(b.text))
        labelled.append((features(blocks), labels))
    for epoch in range(epochs):
        rng.shuffle(labelled)
        for sequence, labels in labelled:
            field.learn(sequence, labels, RATE / (1 + epoch))
    field.seen = {}
    return field


def sample_words(df: DataFrame, page: str, pages: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> list[str]:
    """Words of the pages with the smallest content hashes among those of at most `chars` characters."""
    hashed = df.select(F.col(page).alias("page")).where(F.length("page").between(1, chars)).select("page", F.xxhash64("page").alias("h"))
    # The hashes are chosen first, so that a task sends numbers and not pages; copies of a page count once.
    chosen = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(pages).collect()]
    found: set[str] = set()
    for r in hashed.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("page").alias("page")).collect():
        for b in blocks_of(r["page"]):
            found.update(w for w in b.text.split() if CONTENT not in w)
    return sorted(found)


def main_text(page: str, field: Field) -> str:
    def known(word: str) -> bool:
        return f"mark:{word}" in field.weights or len(word) > 4 and f"part:{word[:4]}" in field.weights

    blocks = blocks_of(page, known)
    return "\n".join(b.text for b, keep in zip(blocks, field.viterbi(features(blocks)), strict=True) if keep)


def extract(df: DataFrame, page: str, field: Field) -> DataFrame:
    """All rows of `df`, the page replaced by `main_text`.

    Null and empty pages, and pages without blocks, give an empty text; repeated rows are ordinary rows. A name that clashes is an
    error.
    """
    others = [c for c in df.columns if c != page]
    if "main_text" in {c.lower() for c in others}:
        raise ValueError("column already present: main_text")
    rows = df.select(*others, F.col(page).cast("binary").alias("main_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("main_text", T.StringType())])
    sent = df.sparkSession.sparkContext.broadcast((field.weights, field.pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field()
        model.weights, model.pairs = sent.value
        for b in batches:
            found = [main_text(t.decode("utf-8", "replace"), model) for t in texts(b.column(len(others)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.string())], b.schema.names)

    return rows.mapInArrow(run, schema)


@query("op6_crf_text")
def op6_crf_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    words = sample_words(pages, "html")
    found = extract(pages.select("page_id", "url", "html"), "html", train(words or ["word"]))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
