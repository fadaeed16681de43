import random
import time

import pytest

from pulsegrid.llm import content as C

WEIGHTS = C.Weights(0.5, {"p": 3.0, "h1": 3.0, "nav": -4.0, "footer": -4.0, ".ad": -4.0, "a": -1.0}, -0.25)
PAGE = """<!DOCTYPE html><html><head><title>T x</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home page</a></li></ul></nav><div class="ad top">Buy things now</div>
<article><h1>Big &amp; <b>bo</b>ld</h1><p>First  para\n graph.<br>Second &eacute;t&eacute;.</p><aside>Related words here</aside>
<p>Third one<p>Fourth.</p><div class="comments"><p>I agree</p></div><form><p>Name</p></form></article><footer>&copy; site</footer></body></html>"""


def test_main_text_of_a_page():
    assert C.main_text(PAGE, WEIGHTS) == "Big & bold First para graph. Second été. Third one Fourth."


def test_marks_of_labels_are_not_features():
    pieces = [p for p in C.pieces(PAGE) if p.text and "graph" in p.text]
    assert pieces[0].main and "article" not in pieces[0].features and "p" in pieces[0].features


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<script>x", "<!-- a", "<p class='", "</p></div>", "<nav>only menu</nav>"])
def test_odd_pages_do_not_fail(page):
    assert C.main_text(page, WEIGHTS) in ("", "<", "<p", "<p class='")


def test_the_run_is_the_best_one():
    """Against all runs of a page's pieces."""
    found = list(C.pieces(PAGE))
    weight = WEIGHTS.of(found)
    best = max(((sum(weight[i:j]), i, j) for i in range(len(weight)) for j in range(i + 1, len(weight) + 1)), key=lambda x: x[0])
    plain = "".join(" " if p.text is None and p.block else "" if p.text is None or p.noise else p.text for p in found[best[1] : best[2]])
    assert C.main_text(PAGE, WEIGHTS) == " ".join(C.html.unescape(plain).split())


def test_learns_from_labelled_pages_and_reads_others(spark):
    plain = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    rows = [(i, "u", PAGE.replace("Third", f"Third{i}"), "x") for i in range(30)] + [(100, None, plain, "x"), (101, "u", None, "x"), (102, "u", "", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {r.page_id: r.text for r in C.extract(df).collect()}
    assert got[3] == "Big & bold First para graph. Second été. Third3 one Fourth."
    assert got[100] == "Big & bold First para graph. Second été. Third one Fourth."
    assert got[101] == got[102] == ""


def test_without_labelled_pages(spark):
    plain = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    df = spark.createDataFrame([(1, "u", plain)], "page_id bigint, url string, html string")
    assert C.extract(df).first().text == "Big & bold First para graph. Second été. Third one Fourth."
    assert C.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("wrap", ['<body class="single has-sidebar comments-open">|</body>', '<div id="search-layout">|</div>', '<div class="related-layout"><div>|</div></div>', '<form id="aspnet">|</form>'])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_wrappers_with_such_words_hold_main_text(spark, wrap, inner):
    before, after = wrap.split("|")
    text = "Main words of the story " * 12
    page = f'{before}<nav>Home page</nav><{inner}><h1>Title</h1><p>{text}</p><div class="comments"><p>I agree</p></div></{inner}>{after}'
    weights = C.learn(spark.createDataFrame([(1, "u", PAGE)], "page_id bigint, url string, html string"))
    assert C.main_text(page, weights) == f"Title {text}".strip()


@pytest.mark.parametrize(
    "part",
    ["<a ", "<a", "<", "<!", "<!--", "</b ", "<a '\">", "<a \">\"", "<a \"'>'", "<a href='x\">", "<i>", "<div class=ad>", "<p class=\"", "<i></b>", "<script>", "</p><p>", "<div><form>"],
)
@pytest.mark.parametrize("tail", ["", ">", "\">", "'>", "</b>" * 20_000])
def test_time_grows_with_the_length_of_malformed_pages(part, tail):
    began = time.process_time()
    C.main_text(part * (150_000 // len(part)) + tail, WEIGHTS)
    assert time.process_time() - began < 4


def test_a_megabyte_of_open_tags():
    began = time.process_time()
    assert C.main_text("word " + "<a " * 350_000, WEIGHTS).startswith("word <a <a")
    assert time.process_time() - began < 1


def learned(spark):
    return C.learn(spark.createDataFrame([(i, "u", PAGE) for i in range(5)], "page_id bigint, url string, html string"))


STORY = "Main words of the story " * 12


@pytest.mark.parametrize(
    "inside, kept",
    [
        ('<pre><code>x = 1 <span class="hljs-comment">// add one</span></code></pre>', "x = 1 // add one"),
        ('<pre><div class="comment">// a line</div></pre>', "// a line"),
        ('<section class="related-work"><h2>Related work</h2><p>Others did this.</p></section>', "Related work Others did this."),
        ('<section class="social-impact"><p>People gained.</p></section>', "People gained."),
        ("<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p>", "So x=1 holds."),
        ("<p>Press <button>Start</button> now.</p>", "Press Start now."),
        ('<svg class="figure"><text>Height</text></svg>', "Height"),
        ('<h2 class="comment">Heading</h2>', "Heading"),
        ('<p>An <em class="ad">inline</em> mark</p>', "An inline mark"),
        ('<section class="comments"><p>I agree</p></section>', ""),
        ('<section class="comments-area"><p>I agree</p></section>', ""),
        ('<div class="post-comment"><p>I agree</p></div>', ""),
        ('<span class="ad">Buy now</span>', ""),
        ("<form><button>Send</button></form>", ""),
        ('<div role="navigation">Home page</div>', ""),
    ],
)
@pytest.mark.parametrize("outer", ["article", "div"])
def test_only_the_listed_parts_of_an_article_are_dropped(spark, inside, kept, outer):
    page = f"<nav>Home page</nav><{outer}><h1>Title</h1><p>{STORY}</p>{inside}<p>{STORY}</p></{outer}><footer>Us</footer>"
    assert C.main_text(page, learned(spark)) == " ".join(f"Title {STORY} {kept} {STORY}".split())


def test_elements_beyond_the_depth_belong_to_the_last_one():
    page = "<p>" + "<i>" * (C.DEPTH * 3) + "deep" + "</i>" * (C.DEPTH * 3) + " and <nav>menu</nav>flat</p>"
    texts = [(p.text.strip(), p.noise) for p in C.pieces(page) if p.text and p.text.strip()]
    assert texts == [("deep", False), ("and", False), ("menu", True), ("flat", False)]


def generated(rng):
    """A page as (html, texts in order with whether they are main text): parts that are never main text stand in and around an article."""
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta omega".split()) + str(rng.randint(0, 99)) for _ in range(n))
    noise = ["<nav>{}</nav>", '<div class="ad">{}</div>', "<aside>{}</aside>", "<form>{}</form>", '<ul class="main-menu"><li>{}</li></ul>', '<div id="comments"><p>{}</p></div>']
    plain = ["<p>{}</p>", "<h2>{}</h2>", "<p>{}", "<blockquote>{}</blockquote>", "<pre>{}</pre>", "<ul><li>{}</li></ul>", '<section class="related-work"><p>{}</p></section>']
    body, main = [], []
    for _ in range(rng.randint(3, 9)):
        t = words(rng.randint(15, 60))
        body.append(rng.choice(plain).format(t))
        main.append(t)
        if rng.random() < 0.4:
            body.append(rng.choice(noise).format(words(rng.randint(1, 6))))
    before, after = rng.choice(noise).format(words(5)), rng.choice(noise).format(words(5))
    return f"<html><head><title>{words(3)}</title></head><body>{before}<article>{''.join(body)}</article>{after}<footer>{words(4)}</footer></body></html>", " ".join(main)


def test_generated_pages_as_they_were_made(spark):
    """``extract`` against the parts each page was put together from, with and without the label."""
    rng = random.Random(11)
    made = [generated(rng) for _ in range(60)]
    rows = [(i, "u", page) for i, (page, _) in enumerate(made)]
    rows += [(i + 1000, "u", page.replace("<article>", "").replace("</article>", "")) for i, (page, _) in enumerate(made)]
    got = {r.page_id: r.text for r in C.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == text for i, (_, text) in enumerate(made))
    assert all(got[i + 1000] == text for i, (_, text) in enumerate(made))
