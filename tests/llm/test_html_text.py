"""Main texts of pages with known articles."""

from html.parser import HTMLParser

from framelake.llm import html_text

WORDS = "the quick brown fox jumps over the lazy dog and then it sleeps for a while in the warm sun "


def test_marked_article_without_its_surroundings():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="</p><article>no";</script></head>
    <body class="has-sidebar"><header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy now</div>
    <article><h1>Head &amp; tail</h1><p><b>One&nbsp;two<br>three<p>Fo<i>ur</i> &lt;b&gt; <!-- x > y --><aside>side</aside>
    <form><input name=q> find</form><p>Ti.</article><section id="comments"><article class="comment">Nice!</article></section>
    <footer>&copy; us</footer>"""
    assert html_text.main_text(page) == "Head & tail One two three Four <b> Ti."


def test_unmarked_article_is_found_by_surge_and_dive():
    links = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(12))
    body = "".join(f"<p>{WORDS * 2}{i}</p>" for i in range(4))
    page = f"<html><body><div><ul>{links}</ul></div><div>{body}<p>Short end.</p></div><div><ul>{links}</ul></div><div>Tail</div></body></html>"
    text = html_text.main_text(page)
    assert text == " ".join([*(f"{WORDS * 2}{i}" for i in range(4)), "Short end."])


def test_surges_below_the_share_are_left_out():
    assert html_text.kept_lines([0, 300, 20, 0, 0, 0, 90, 0, 0, 0, 250]) == [
        False, True, True, False, False, False, True, False, False, False, True]
    assert html_text.kept_lines([500, 0, 0, 0, 90]) == [True, False, False, False, False]
    assert html_text.kept_lines([]) == [] and html_text.kept_lines([0, 0]) == [False, False]
    assert html_text.kept_lines([5, 0]) == [True, False]


def test_broken_markup():
    assert html_text.main_text("plain text only") == "plain text only"
    assert html_text.main_text("<p>a < b and 3 <4</p>") == "a < b and 3 <4"
    assert html_text.main_text("<article><p>open <script>never closed <p>x") == "open"
    assert html_text.main_text('<article><p title="a>b">quoted</p><p class="x>text') == "quoted text"
    assert html_text.main_text("<!-- open comment <p>x</p>") == ""
    html_text.main_text("<" * 20_000 + '<a href="' * 20_000)


def test_links_in_a_marked_article_stay():
    page = '<nav><a href="/">Home</a></nav><article><p>One</p><p><a href="/x">A linked paragraph</a></p><ul><li><a href="/y">Item</a></ul></article>'
    assert html_text.main_text(page) == "One A linked paragraph Item"


def test_only_attributes_of_their_own_name_mark_boilerplate():
    page = """<article><p>a <a href="/the-hidden-valley">b</a></p><div class="overflow-hidden">c</div><p data-id="search">d</p>
    <p><a href="/s?id=search">e</a></p><p title='class="ad"'>f</p><p title="display:none">g</p><p hidden>no</p><p style="display: none">no</p>
    <p aria-hidden=true>no</p><p class="hidden x">no</p><div ID='search'>no</div><div class=ad>no</div></article>"""
    assert html_text.main_text(page) == "a b c d e f g"


def test_names_in_an_article_drop_no_text_of_its_own():
    page = """<article><h2 id="related-work">a</h2><p id="search">b</p><section id="social-history">c</section>
    <div class="share-price">d</div><h3 class="notice">e</h3><p class="form-factor">f</p><div class="ad-slot-2">no</div>
    <div class="related-posts">no</div><div id="comments">no</div><p class="advert">no</p><div class="top share-buttons">no</div></article>"""
    assert html_text.main_text(page) == "a b c d e f"


def test_a_script_does_not_end_a_line():
    assert html_text.main_text("<article><p>a<script>x</script>b<style>y</style>c</p><script>z</script><p>d</article>") == "abc d"


def test_an_article_that_is_a_teaser_only_is_passed_over():
    body = "".join(f"<p>{WORDS * 2}{i}</p>" for i in range(8))
    whole = " ".join(f"{WORDS * 2}{i}" for i in range(8))
    beside = f"<body><aside><article><p>Read this as well.</p></article></aside><div>{body}</div></body>"
    assert html_text.main_text(beside) == whole
    links = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(6))
    apart = f"<body><div><article><p>Read this as well.</p></article></div><ul>{links}</ul><div>{body}</div></body>"
    assert html_text.main_text(apart) == whole
    assert html_text.main_text(f"<body><div>Some line.</div><article><p>Short.</p></article></body>") == "Short."


class _Article(HTMLParser):
    """Blocks of the article of a plain page, read independently of the operator."""

    INLINE = {"b", "i", "a", "em", "strong", "span", "code"}

    def __init__(self):
        super().__init__()
        self.blocks, self.inside, self.beside, self.raw = [[]], 0, 0, 0

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.beside += tag in ("aside", "form") or tag == "div"
        self.raw += tag in ("script", "style")
        if tag not in self.INLINE:
            self.blocks.append([])

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.beside -= tag in ("aside", "form") or tag == "div"
        self.raw -= tag in ("script", "style")
        if tag not in self.INLINE:
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside and not self.beside and not self.raw:
            self.blocks[-1].append(data)


def article(page):
    parser = _Article()
    parser.feed(page or "")
    parser.close()
    return " ".join(filter(None, (" ".join("".join(block).split()) for block in parser.blocks)))


def test_the_table_against_another_parser(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    expected = {r.page_id: article(r.html) for r in pages.collect()}
    found = html_text.extract(pages).collect()
    assert {r.page_id: r.text for r in found} == expected and len(found) == len(expected)
    assert all(r.n_chars == len(r.text) for r in found)


def test_a_very_long_page():
    words = [f"<p>word {i} {WORDS}</p>" for i in range(20_000)]
    page = f"<nav>menu</nav><article>{''.join(words)}</article><footer>end</footer>"
    assert html_text.main_text(page) == " ".join(f"word {i} {WORDS.strip()}" for i in range(20_000))


def test_short_end_in_the_container_of_the_main_run():
    adverts = '<div class="ad">Buy</div>' * 3
    for low, high in (("<div>", "</div>"), ("", "")):
        page = f"<body>{low}<p>{WORDS * 6}</p>{adverts}<p>Short end.</p>{high}{adverts}<div>Tail</div></body>"
        assert html_text.main_text(page) == f"{WORDS * 6}Short end."


def test_rows(spark):
    rows = [(1, "u", None, 0), (2, None, "", 1), (None, "v", "<article>a b</article>", 2), (4, "w", "<article>a b</article>", 3),
            (4, "w", "<article>a b</article>", 3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = sorted((tuple(r) for r in html_text.extract(frame).collect()), key=repr)
    assert found == sorted(
        [(1, "u", "", 0), (2, None, "", 0), (None, "v", "a b", 3), (4, "w", "a b", 3), (4, "w", "a b", 3)], key=repr)
    assert html_text.extract(frame.limit(0)).count() == 0
