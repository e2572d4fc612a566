import random
import re
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from rxloom.llm import html_text as h
from rxloom.llm.common import QUERIES

SF = "/root/testdata/sf0.01"
WORDS = "alpha beta gamma delta of the and in on ein und der para los du le".split()


@pytest.fixture(scope="module")
def field():
    return h.train(WORDS)


def test_blocks_of_awkward_markup():
    def texts(page):
        return [b.text for b in h.blocks_of(page)]

    assert texts("<p>a<b>b</b>c <i> d</i>\n e<p>f<br>g<div>h</div>i") == ["abc d e", "f g", "h", "i"]
    assert texts("x &amp;lt; &eacute;&#233;&nbsp;y < z <3") == ["x &lt; éé y < z <3"]
    assert texts("<script>var a='</p><p>no</p>';</script><style>p{}</style><!-- <p>no --><p>yes") == ["yes"]
    assert texts("<head><title>t</title></head><body><p>b") == ["b"]
    assert texts("<title>t</title><p title='a>b' x=\"<p>\">c</p><p class=\"un") == ["c"]
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>") == ["a", "b", "c", "d", "e"]
    assert texts("") == texts("<p> \n </p><!--") == []
    assert texts("<script>never closed <p>x") == []


def test_stray_quotes_and_unclosed_elements_lose_no_text():
    def texts(page):
        return [b.text for b in h.blocks_of(page)]

    assert texts("<p title=it's>first paragraph</p><p>second</p><p>don't stop</p><p>end</p>") == ["first paragraph", "second", "don't stop", "end"]
    assert texts("<p>x<img alt='Bob's house'>y</p><p>it's</p>") == ["xy", "it's"]
    assert texts("<p a = 'x>y' b=\"it's\">in</p>") == ["in"]
    for name in ("svg", "noscript", "select", "video", "object", "iframe", "template"):
        assert texts(f"<p>a</p><{name}><p>b</p><{name}><p>c</p>") == ["a", "b", "c"]
    assert texts("<p>a</p><noscript><p>hidden</p></noscript><p>b <math><mi>x</mi>+1</math> c</p>") == ["a", "b x+1 c"]
    assert texts("<svg><title>no</title><style>p{}</style><text>label</text></svg>") == ["label"]


def test_deep_nesting_is_linear(field):
    depth = 60_000
    page = "".join(f'<div class="c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}x">' for i in range(depth)) + "text" + "</b>" * depth
    started = time.process_time()
    tracemalloc.start()
    assert h.main_text(page, field) in ("", "text")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and time.process_time() - started < 20
    # What the field has no weight for makes no difference.
    page = h.labelled_page(random.Random(5), WORDS)
    blocks = h.blocks_of(page)
    labels = field.viterbi(h.features(blocks))
    assert h.main_text(page, field) == "\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def test_tags_and_marks_of_a_block():
    b = h.blocks_of('<div id="page" class="Wide-x"><aside class=side><p><span class="no">t <a href=x>l</a>')[0]
    assert b.tags == ("div", "aside", "p") and b.marks == {"page", "wide", "x", "side"} and b.nearest == {"side"} and b.linked == 1


def test_viterbi_is_the_best_of_all_labellings(field):
    rng = random.Random(3)
    for _ in range(20):
        blocks = h.blocks_of(h.labelled_page(rng, WORDS))[:9]
        sequence = h.features(blocks)
        scores = field.scores(sequence)

        def value(labels, scores=scores):
            return sum(s for s, y in zip(scores, labels, strict=True) if y) + sum(field.pairs[a][b] for a, b in zip(labels, labels[1:], strict=False))

        every = [[m >> i & 1 for i in range(len(blocks))] for m in range(1 << len(blocks))]
        assert value(field.viterbi(sequence)) == pytest.approx(max(map(value, every)))


def test_learning_raises_the_likelihood():
    rng = random.Random(4)
    blocks = h.blocks_of(h.labelled_page(rng, WORDS))
    labels = [int(b.text.startswith(h.CONTENT)) for b in blocks]
    field, sequence = h.Field(), h.features(blocks)
    values = [field.learn(sequence, labels, 0.1) for _ in range(20)]
    assert values[-1] > values[0] and values[0] == pytest.approx(-len(blocks) * 0.6931, rel=1e-3)


def test_held_out_layouts(field):
    rng, right, total = random.Random(99), 0, 0
    for _ in range(200):
        blocks = h.blocks_of(h.labelled_page(rng, WORDS))
        labels = [int(b.text.startswith(h.CONTENT)) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(h.CONTENT, "") or "-"
        found = field.viterbi(h.features(blocks))
        right += sum(a == b for a, b in zip(found, labels, strict=True))
        total += len(labels)
    assert right >= 0.99 * total


def test_page_with_everything_around_the_article(field):
    page = ("<body><header class='site'><h1>alpha beta</h1><nav><a href=/>gamma</a></nav></header><div class='cookie-notice'><p>the delta of.</p></div>"
            "<main><article><h1>Of the alpha</h1><p>Alpha beta &amp; gamma in the delta, on and on.</p><aside class=sidebar><p>para los.</p></aside>"
            "<p>Und der.</p></article><section class='reader-comments'><h2>alpha</h2><p>Beta gamma of the delta and on in the para, du le und.</p></section></main>"
            "<form><label>beta</label><button>gamma</button></form><div class=advert>alpha</div><footer><p>&copy; the</p></footer>")
    assert h.main_text(page, field) == "Of the alpha\nAlpha beta & gamma in the delta, on and on.\nUnd der."


def test_whole_table_against_its_article_elements(spark):
    got = {r["page_id"]: r for r in QUERIES["op6_crf_text"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert set(got) == {r["page_id"] for r in pages}
    right = 0
    for r in pages:
        body = r["html"][r["html"].index("<article>"):].split("</article>")[0]
        body = re.sub(r"<footer>.*", "", body, flags=re.S)
        want = [" ".join(h.html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?[bi]>", "", x))).split()) for x in re.split(r"</?(?:p|h1|article)[^>]*>", body)]
        right += got[r["page_id"]]["text"] == "\n".join(x for x in want if x)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
    assert right >= 0.99 * len(pages)


def test_odd_rows(spark, field):
    rows = [(1, None, "x"), (2, "", "x"), (3, "<p>alpha beta the of.", "x"), (3, "<p>alpha beta the of.", "x"), (None, "<b>", "x"), (4, "<p>" + "the " * 50000, "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = h.extract(df, "html", field).collect()
    assert len(out) == len(rows) and all(r["text"] == "x" for r in out)
    assert [r["main_text"] for r in out if r["page_id"] in (1, 2, None)] == [""] * 3
    assert h.extract(df.limit(0), "html", field).count() == 0
    assert h.sample_words(df.limit(0), "html") == []
    with pytest.raises(ValueError, match="main_text"):
        h.extract(df.withColumn("Main_Text", F.lit(1)), "html", field)
