import html
import re

from lumenspan.llm import html_text, q_html


def second_form(page):
    """The article of a generated page by regular expressions."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[a-zA-Z/!][^>]*>", "", re.sub(r"<br>|</?p>|</?h1>", " ", body))).split())


def test_generated_pages(spark):
    d = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    for r in q_html.query(spark, d).collect():
        assert r["text"] == second_form(pages[r["page_id"]])
        assert r["n_chars"] == len(r["text"])


LONG = "This is a sentence of the article that is long enough to count as text. " * 4


def test_marked_parts_are_left_out():
    page = f"""<html><head><title>t</title><style>p{{}}</style></head><body><header>Site</header><div class="cookie-notice">We use cookies</div>
    <main><article><header><h1>Head</h1></header><p>{LONG}</p><div class="ad">Buy</div><p>Sh.</p><aside>more</aside><form><p>Name <input></p></form><ul><li>a</li><li>b</li></ul>
    <p>A &amp; B&nbsp;&lt;c&gt; &#x41;</p><script>var x = "<p>no</p>";</script></article><section id="comments"><article class="comment">nice</article></section></main><footer>&copy;</footer></body></html>"""
    assert html_text.main_text(page) == " ".join(f"Head {LONG}Sh. a b A & B <c> A".split())


def test_unmarked_page_keeps_the_surge():
    page = f"<body><div><a href=x>Home</a> <a href=y>News</a></div><div id=menu><p>Menu</p></div><div><p>{LONG}</p><p>{LONG}</p><p>Short end.</p></div><div class=footer>Imprint</div></body>"
    assert html_text.main_text(page) == " ".join(f"{LONG} {LONG} Short end.".split())


def test_inline_tags_and_breaks():
    assert html_text.main_text("<article>f<b>o</b>o<br>bar<p>x<i>y</i></p>z</article>") == "foo bar xy z"


def test_nulls_broken_markup_and_long_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<<<>>> <p"), (4, "u", "plain words only"), (5, "u", "<article>" + "<p>word</p>" * 50_000), (6, "u", "<div>" * 3000 + "deep" + "</div>" * 10), (7, "u", "<article><p>a &am</p>")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, n_chars int")
    found = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert found[1] == found[2] == "" and found[4] == "plain words only"
    assert found[5] == " ".join(["word"] * 50_000) and found[6] == "deep" and found[7] == "a &am"
    assert html_text.extract(df.limit(0)).count() == 0


def test_wrappers_named_after_asides_keep_their_article():
    for attributes in ('class="content no-sidebar"', 'class="layout with-sidebar"', 'class="post tag-news"', 'id="page" class="has-header"', 'class="sidebar"'):
        body = f"<p>{LONG}</p><section id='side-effects'><p>{LONG}</p></section>"
        for page in (f"<div {attributes}><article>{body}</article></div>", f"<div {attributes}>{body}</div><div class='site-footer'>Imprint</div>"):
            assert html_text.main_text(f"<body>{page}</body>") == f"{LONG}{LONG}".strip(), attributes
    page = f"<body><div class='no-sidebar'><article><p>{LONG}</p></article></div><div class='related-posts'><article>{LONG}</article></div><div class='post-tags'>News</div></body>"
    assert html_text.main_text(page) == LONG.strip()


def test_inline_asides_and_lines_of_links_do_not_cut_an_article():
    long, end, link = f"<p>{LONG * 4}</p>", "<p>" + "The end of it. " * 20 + "</p>", "<p><a href=x>A source</a></p>"
    body = f"{long}{link}{long}{long}<div class=ad>Buy</div>{end}<form>Name</form>{link * 5}<p>Last words.</p>"
    whole = " ".join(f"{LONG * 4} A source {LONG * 8} {'The end of it. ' * 20} {'A source ' * 5} Last words.".split())
    for page in (f"<div>{body}</div>", f"<nav>Menu</nav><p>Site of sites</p><nav>Menu</nav><div class=text>{body}</div><footer>F</footer><div><p>Imprint</p></div>", f"<article>{body}</article>"):
        found = html_text.main_text(f"<body>{page}</body>")
        assert found == whole
    halves = f"<div class=post><div>{long}{long}</div><div class=ad>Buy</div><div>{end}</div></div><nav>Menu</nav><div>Imprint</div>"
    assert html_text.main_text(f"<body>{halves}</body>") == " ".join(f"{LONG * 8} {'The end of it. ' * 20}".split())


def test_an_article_elsewhere_does_not_take_the_place_of_the_text():
    body = f"<div class=body><p>{LONG * 3}</p><p>{LONG * 3}</p><p>Short end.</p></div>"
    teaser = '<div class="more-posts"><article><h2>Read on</h2><p>A teaser.</p></article></div>'
    for page in (body + teaser, teaser + body):
        assert html_text.main_text(f"<body>{page}</body>") == " ".join(f"{LONG * 6} Short end.".split())
    # Where articles hold most of the text, the sums choose among them; replies beside a kept one stay.
    replies = f"<div class=thread><article><p>{LONG * 6}</p></article><article><p>Thanks!</p></article></div>"
    assert html_text.main_text(f"<body><p>Site</p>{replies}<nav>Menu</nav>{teaser}</body>") == " ".join(f"{LONG * 6} Thanks!".split())


def test_distribution_alone_on_pages_without_marks(spark):
    """Tags, classes and roles that tell the parts of a page are taken away; the sums must still find the article."""
    import re
    from collections import Counter

    def unmarked(html):
        html = re.sub(r"<(/?)(?:nav|header|footer|aside|article|main|section|form)\b", r"<\1div", html)
        return re.sub(r'\s(?:class|id|role|hidden|aria-[a-z]+)(?:="[^"]*")?', "", html)

    both = right = found = 0
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        a, b = (Counter(html_text.main_text(x).split()) for x in (row["html"], unmarked(row["html"])))
        both, right, found = both + sum((a & b).values()), right + sum(a.values()), found + sum(b.values())
    assert both > 0.99 * right and both > 0.94 * found


def test_broken_pages_are_read_in_linear_time():
    import time

    broken = {"starts": "<a " * 330_000, "quotes": '<p a="' * 160_000, "comments": "<!--" * 250_000, "closed at last": '<p a="' * 160_000 + ">", "crossed": "<b></i>" * 140_000, "ends": "<div></p>" * 110_000, "items": "<b><li>" * 140_000, "declarations": "<!x" * 300_000, "script": "<script>" + "</a" * 300_000}
    for name, tail in broken.items():
        began = time.time()
        found = html_text.main_text("<article><p>a text of its own</p></article>" + tail)
        assert found.startswith("a text of its own"), name
        assert time.time() - began < 20, name


def test_comment_marks_in_scripts_take_nothing():
    page = "<body><script>var a = '<!--', b = \"<p \", c = 1 <d;</script><p>" + "The text goes on here. " * 9 + "</p><!-- no end <p>gone</p>"
    assert html_text.main_text(page) == ("The text goes on here. " * 9).strip()


def surges(sizes, window=3):
    """Blocks of lines between surge and dive, by looking at every window."""
    sums = [sum(sizes[i : i + window]) for i in range(len(sizes) - window + 1)]
    out, start = [], None
    for i, s in enumerate(sums + [0]):
        if s and start is None:
            start = i
        if not s and start is not None:
            held = [k for k in range(start, i) if sizes[k]]
            out.append((held[0], held[-1], max(sums[start:i])))
            start = None
    return out


def test_sums_choose_the_blocks():
    """Boxes of lines with no telling tags: those whose highest sum reaches the share stay, as do those between them."""
    import random

    r = random.Random(3)
    changed = 0
    for _ in range(60):
        blocks = [[r.choice([0, 1, 20, 90]) for _ in range(r.randint(1, 5))] for _ in range(r.randint(1, 5))]
        html, lines = "", []
        for k, block in enumerate(blocks):
            html += f"<nav>m</nav><section><div>{''.join(f'<p>{chr(97 + k) * n}</p>' for n in block)}</div></section>"
            lines += [0] * 6 + [n for n in block if n]
        lines += [0] * 3
        found = surges(lines)
        top = max((s for *_, s in found), default=0)
        high = [i for i, (*_, s) in enumerate(found) if s >= 0.25 * top]
        kept = found[high[0] : high[-1] + 1] if high else []
        order = [(chr(97 + k) * n) for k, block in enumerate(blocks) for n in block if n]
        places = [i for i, n in enumerate(lines) if n]
        text = " ".join(t for t, at in zip(order, places, strict=True) if any(a <= at <= b for a, b, _ in kept))
        assert html_text.main_text("<body>" + html + "</body>") == text
        changed += text != " ".join(order)
    assert changed > 5
