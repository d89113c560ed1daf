import html
import random
import re

from flowdetect.llm import html_extract
from flowdetect.llm.html_extract import common_lines, extract_main_text, page_lines, url_key
from tests.llm.cases import SF


def pages(spark, rows, extra=False):
    schema = "page_id long, url string, html string" + (", host string, body string, kinds string, `to` string" if extra else "")
    return spark.createDataFrame([(*r, *(("x",) * 4 if extra else ())) for r in rows], schema).repartition(3)


def text_of(spark, rows):
    return {r["page_id"]: r["text"] for r in extract_main_text(pages(spark, rows)).collect()}


def test_lines_and_kinds():
    page = (
        "<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<nav><ul><li><a href='/'>Home</a></li></ul></nav><div class=\"side ad\">buy</div><!-- <p>no</p> -->"
        "<article class='post'><header>by me</header><h1>Head&nbsp;line</h1><p>One <b>bold</b>word<br>next\n\n line &lt;b&gt; &copy"
        "<p>Two<script>x</script> end</p><div id='comments'><p>nice</p></div><form>mail</form><aside>more</aside></article>"
        "<footer>&copy; us &am"
    )
    lines, kinds = page_lines(page)
    assert [x for x, k in zip(lines, kinds) if k == "m"] == ["Head line", "One boldword next line <b> ©", "Two end"]
    assert all(k == "f" for x, k in zip(lines, kinds) if x in ("Home", "buy", "by me", "nice", "mail", "more"))
    assert len(lines) == len(kinds) == 10


def test_odd_markup():
    assert page_lines("") == ([], "")
    assert page_lines("plain < text & more")[0] == ["plain < text & more"]
    assert page_lines("<p>cut <a href='x")[0] == ["cut"]
    assert page_lines("<article><svg><p>x<article>")[0] == []
    assert page_lines("<article>a<svg><p>no</article>b") == (["a", "b"], "mu")
    assert page_lines("<article>" + "<div>" * 3_000 + "deep")[0] == ["deep"]


def test_longest_common_subsequence():
    def plain(a, b):
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                n[i + 1][j + 1] = n[i][j] + 1 if a[i] == b[j] else max(n[i][j + 1], n[i + 1][j])
        return n[-1][-1]

    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        flags = common_lines(a, b)
        assert sum(flags) == plain(a, b)
        rest = iter(b)
        assert all(x in rest for x, f in zip(a, flags) if f)


def test_url_keys():
    assert url_key("https://User@WWW.Example.org:80/a/b/?q=1#top") == ("www.example.org", "/a/b")
    assert url_key(None) == ("", "") and url_key("odd") == ("", "odd")


def plain_page(k):
    return f"<div>Site menu</div><div>Login here</div><p>Story {k} first</p><p>Story {k} second</p><div>All rights kept</div>"


def test_shared_lines_go_where_markup_says_nothing(spark):
    rows = [(k, f"http://site.org/news/{k:03d}", plain_page(k)) for k in range(25)]
    rows.append((90, "http://other.org/one", plain_page(90)))
    rows += [(91, "http://twin.org/a/1", plain_page(91)), (92, "http://twin.org/a/2", plain_page(91))]
    out = text_of(spark, rows)
    assert all(out[k] == f"Story {k} first\nStory {k} second" for k in range(25))
    assert out[90].startswith("Site menu\n") and out[90].endswith("All rights kept")
    assert out[91] == out[92] == "Site menu\nLogin here\nStory 91 first\nStory 91 second\nAll rights kept"


def test_runs_of_pages_meet_at_their_borders(spark, monkeypatch):
    rows = [(k, f"http://site.org/news/{k:03d}", plain_page(k)) for k in range(40)]
    whole = text_of(spark, rows)
    monkeypatch.setattr(html_extract, "RUN_ROWS", 1)
    assert text_of(spark, rows) == whole


def test_article_lines_stay_though_shared(spark):
    page = "<nav>menu</nav><article><h1>Same</h1><p>Quote</p><p>Own {}</p></article><div>foot</div>"
    out = text_of(spark, [(1, "http://a.b/1", page.format(1)), (2, "http://a.b/2", page.format(2))])
    assert out == {1: "Same\nQuote\nOwn 1", 2: "Same\nQuote\nOwn 2"}


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://a.b/x", "<p>one"), (3, "http://a.b/x", "<p>one"), (None, "http://a.b/y", "<p>two"), (4, "::", "<script>x")]
    out = extract_main_text(pages(spark, rows, extra=True))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((str(r["page_id"]), r["url"], r["text"], r["n_chars"]) for r in out.collect() if r["url"])
    assert got == [("3", "http://a.b/x", "one", 3), ("3", "http://a.b/x", "one", 3), ("4", "::", "", 0), ("None", "http://a.b/y", "two", 3)]
    assert out.count() == 6 and extract_main_text(pages(spark, rows).limit(0)).count() == 0


def test_comments_as_articles_are_no_main_text(spark):
    story = "<h1>Title</h1><p>Story text</p>"
    rows = [
        (1, "http://a.b/1", f"<article>{story}</article><article class='comment'><p>nice</p></article>"),
        (2, "http://c.d/2", f"<div class='post'>{story}</div><article id='comment-7'><p>nice</p></article>"),
        (3, "http://e.f/3", f"<article class='post with-sidebar'>{story}</article>"),
        (4, "http://g.h/4", f"<article>{story}<article class='x comment'>nice</article>end</article>"),
    ]
    assert text_of(spark, rows) == {k: "Title\nStory text" + ("\nend" if k == 4 else "") for k in range(1, 5)}


def test_article_after_an_advert_that_is_never_closed(spark):
    story = "<article><h1>Title</h1><nav>menu</nav><p>Story</p><div class='comments'><article>nice</article></div></article>"
    rows = [
        (1, "http://a.b/1", f"<div class='ad'>buy{story}"),
        (2, "http://c.d/2", f"<html><body><div class='ad'>buy{story}</body></html>"),
        (3, "http://e.f/3", f"<div class='promo'><article>buy</article></div>{story}"),
        (4, "http://g.h/4", f"{story}<div class='promo'><article>buy</article>"),
    ]
    assert set(text_of(spark, rows).values()) == {"Title\nStory"}
    assert page_lines("<div class='promo'><article>buy</article></div>")[1] == "f"
    assert page_lines("<div class='comments'><article>nice</article>")[1] == "f"
    assert page_lines("<ul><li class='promo'><article>buy</article></ul>")[1] == "f"


def test_alignment_in_halves_is_as_long(monkeypatch):
    rng = random.Random(9)
    cases = [tuple([rng.randrange(kinds) for _ in range(rng.randrange(60))] for _ in range(2)) for kinds in (2, 5, 40) for _ in range(60)]
    whole = [sum(common_lines(a, b)) for a, b in cases]
    monkeypatch.setattr(html_extract, "ROW_BITS", 20)
    monkeypatch.setattr(html_extract, "MASKS", 3)
    for (a, b), n in zip(cases, whole):
        flags = common_lines(a, b)
        rest = iter(b)
        assert len(flags) == len(a) and sum(flags) == n and all(x in rest for x, f in zip(a, flags) if f)


def test_long_pages(spark):
    body = "".join(f"<p>line {k}</p>" for k in range(20_000))
    rows = [(k, f"http://a.b/{k}", f"<div>menu</div><p>own {k}</p>{body}<p>end {k}</p>") for k in (1, 2)]
    assert text_of(spark, rows) == {1: "own 1\nend 1", 2: "own 2\nend 2"}


def test_main_text_is_the_article_of_the_given_pages(spark):
    """By pattern, apart from the operator: the paragraphs and headings of each page's one article, without elements of its frame."""
    rows = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet")
    frame = re.compile(r"<(nav|header|footer|aside|form|script|style|ul|div)\b[^>]*>.*?</\1>", re.S)
    checked = 0
    for r in extract_main_text(rows).join(rows.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article\b[^>]*>(.*?)</article>", r["html"], re.S)
        if not article:
            continue
        blocks = re.findall(r"<(?:p|h1|h2|h3)\b[^>]*>(.*?)(?=</?(?:p|h1|h2|h3)\b|$)", frame.sub("", article[1]), re.S)
        plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert r["text"] == "\n".join(x for x in plain if x)
        checked += 1
    assert checked > 200
