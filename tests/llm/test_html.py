from gridframe.llm import html_extract as he

SCHEMA = "page_id long, url string, html string"


def text_of(page):
    return " ".join(he.chosen_blocks(he.parse(page)[0], frozenset()))


def test_main_text_of_one_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a>Menu</a></ul></nav><!-- note --><div class="ad banner">Buy</div><div id="cookie-notice">Cookies</div>
    <article class="post"><h1>A &amp;amp; B</h1><p><b>One</b>two<br>three &eacute;&nbsp;x<p>Four <i>fi</i>ve<div>Six</div>
    <aside>Side</aside><form><p>Mail</p><input></form><section class="comments"><p>First!</p></section>
    <ul><li>seven<li>eight</ul></article><footer>&copy; us</footer>"""
    assert text_of(page) == "A &amp; B Onetwo three é x Four five Six seven eight"
    assert text_of("") == "" and text_of("plain &lt;text") == "plain <text" and text_of("<p>unclosed <b") == "unclosed <b"
    assert text_of("<body><p>a</p></article><p>b") == "a b"
    assert text_of('<p title="a>b">x</p>') == "x"


def test_templates_of_a_site_go(spark):
    rows = []
    for i in range(12):
        box = "<div><p>Follow our site for more</p></div>"
        rows.append((i, f"https://site.example/{i}", f"<body>{box}<div class=x><p>Page {i} has this text.</p><p>Shared line.</p></div></body>"))
    rows += [(20 + i, "https://copies.example/x", "<body><div><p>The same article</p></div></body>") for i in range(9)]
    rows += [(40, "https://few.example/", rows[0][2]), (41, None, None), (42, "no url", ""), (None, "https://site.example/z", rows[3][2])]
    pages = spark.createDataFrame(rows, SCHEMA)
    want = {i: f"Page {i} has this text. Shared line." for i in range(12)}
    want |= {20 + i: "The same article" for i in range(9)}
    want |= {40: "Follow our site for more Page 0 has this text. Shared line.", 41: "", 42: "", None: want[3]}
    got = he.extract_main_text(pages).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    limit, he.BROADCAST_TEMPLATES = he.BROADCAST_TEMPLATES, 0
    try:
        assert sorted(map(repr, he.extract_main_text(pages).collect())) == sorted(map(repr, got))
    finally:
        he.BROADCAST_TEMPLATES = limit
    assert he.extract_main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_and_deep_pages():
    assert len(text_of("<p>" + "word " * 300_000)) == 5 * 300_000 - 1
    assert text_of("<div>" * 500 + "x") == "x"


def test_any_nesting_and_unclosed_tags_take_linear_time():
    import time

    from gridframe.llm.html_extract import chosen_blocks, parse

    def seconds(page):
        t = time.process_time()
        texts = chosen_blocks(parse(page)[0], frozenset())
        return time.process_time() - t, texts

    deep = "<div>" * 100_000 + "deep text"
    assert seconds(deep)[1] == ["deep text"]
    assert seconds("<p>" + "<u1>" * 50_000 + "<div>x" + "</u1>" * 50_000)[1] == ["x"]
    for unclosed in ("<a ", "<!", '<a "', "<p <", "</b", "<?x", "<a '\" "):
        spent, texts = seconds("<p>first</p>" + unclosed * (2_000_000 // len(unclosed)))
        assert spent < 20 and texts[0] == "first", unclosed
    assert seconds('<p>one</p><a href="x>two</a><p>three</p>')[1] == ["one", "two", "three"]


def test_a_form_around_the_page_is_not_cut():
    from gridframe.llm.html_extract import chosen_blocks, parse

    page = "<body><form id=f><div><p>all of the article text is in here</p></div></form><form>search box</form></body>"
    assert chosen_blocks(parse(page)[0], frozenset()) == ["all of the article text is in here"]


def test_subtrees_equal_a_count_by_hand(spark):
    """Templates by brute force: texts of container elements found with the standard parser."""
    from collections import defaultdict
    from html.parser import HTMLParser

    menu = "<ul><li>Home</li><li>About</li></ul>"
    pages = [(i, f"http://h{i % 2}.org/{i}", f"<body><div>{menu}</div><article><p>own text {i}</p></article>"
              f"<div><p>{'every page of one' if i % 2 else f'page {i}'}</p></div></body>") for i in range(12)]

    class Containers(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.found = [], []

        def handle_starttag(self, tag, attrs):
            self.open.append((tag, []))

        def handle_data(self, data):
            for _, held in self.open:
                held.append(data)

        def handle_endtag(self, tag):
            name, held = self.open.pop()
            if name in ("ul", "div"):
                self.found.append((name, "|".join(held)))

    seen = defaultdict(set)
    for i, url, page in pages:
        c = Containers()
        c.feed(page)
        for f in c.found:
            seen[url[:9], f].add(i)
    from gridframe.llm.html_extract import subtrees

    got = subtrees(spark.createDataFrame(pages, "page_id long, url string, html string")).distinct().groupBy("host", "code").count()
    assert sorted(r["count"] for r in got.collect()) == sorted(len(v) for v in seen.values())
