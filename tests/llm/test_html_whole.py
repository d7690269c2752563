"""Cases of HTML extraction beyond the plain page."""

import random
import time

import pytest

from paperloom.llm import html_text

STORY = "".join(f"<p>Paragraph {k} of the story tells at some length what happened on that day.</p>" for k in range(6))
GAP = "".join('<div class="ad">Buy</div>' for _ in range(4))


def test_windows_decide_on_marked_pages():
    page = f"<article>{STORY}{GAP}<p>Print</p>{GAP}<p>The editors thank all who helped.</p></article>"
    text = html_text.extract(page)
    assert text.count("Paragraph") == 6 and "editors" in text and "Print" not in text
    assert "Print" in html_text.extract(page, window=6)
    assert "editors" not in html_text.extract(page, surge=400)


def test_a_marked_tease_does_not_hide_the_story():
    tease = "<article><p>Read this too.</p></article>"
    for tag in ("div", "main"):
        assert html_text.extract(f"<body>{tease}<{tag}>{STORY}</{tag}></body>").count("Paragraph") == 6


def test_long_text_beside_a_marked_article_stays():
    beside = "<p>" + "A second part of the story that the mark leaves out. " * 8 + "</p>"
    text = html_text.extract(f"<body><p>Next: a tease.</p><article>{STORY * 3}</article>{beside}</body>")
    assert text.count("Paragraph") == 18 and "second part" in text
    assert "tease" not in html_text.extract(f"<body><p>Next: a tease.</p><article>{STORY}</article></body>")


def test_a_wrapper_class_silences_nothing_that_is_the_text():
    comments = '<div id="comments"><p>First! This reader comment says nothing of interest to anyone at all, at length.</p></div>'
    foot = "<div><p>A line of the site.</p></div>"
    for wrapper in ('class="content has-sidebar"', 'class="container ad-free"', 'id="page" class="with-comments"', 'class="sidebar"'):
        for inner in ("<article>{}</article>", "<main>{}</main>", "{}"):
            text = html_text.extract(f"<body><div {wrapper}>{inner.format(STORY)}{comments}</div></body>")
            assert text.count("Paragraph") == 6, (wrapper, inner)
            if wrapper != 'class="sidebar"' or inner != "{}":
                assert "First!" not in text
                assert html_text.extract(f"<body><div {wrapper}>{inner.format(STORY)}{comments}</div>{foot}</body>").count("Paragraph") == 6


def test_long_comments_stay_out():
    comment = "<p>" + "A reader comment that goes on and on. " * 30 + "</p>"
    for inner in ("<article>{}</article>", "<div>{}</div>"):
        for own in ('id="comments"', 'class="comments-area"'):
            text = html_text.extract(f"<body>{inner.format(STORY)}<div {own}><article>{comment}</article><article>{comment}</article></div></body>")
            assert text.count("Paragraph") == 6, (inner, own)
            if "article" in inner:
                assert "reader" not in text
    assert html_text.extract("<body><nav>menu</nav><footer>foot</footer></body>") == ""


def windows_by_hand(weights, window, surge, inside):
    """Line blocks spelled out: the lines that have weight in stretches of live windows that surge, each part by itself."""
    kept, best = set(), (-1, [])
    for part in (True, False):
        own = [w if i == part else 0 for w, i in zip(weights, inside, strict=True)]
        sums = [sum(own[j] for j in range(len(own)) if k - window < j <= k) for k in range(len(own))]
        k = 0
        while k < len(own):
            end = k
            while end < len(own) and sums[end] > 0:
                end += 1
            if end > k:
                lines = [j for j in range(k, end) if own[j] > 0]
                if any(sums[j] >= surge for j in range(k, end)):
                    kept.update(lines)
                if sum(own[k:end]) > best[0]:
                    best = (sum(own[k:end]), lines)
            k = end + 1
    return kept or set(best[1])


def test_windows_equal_brute_force():
    rng = random.Random(8)
    for _ in range(400):
        n = rng.randrange(25)
        weights = [rng.choice((0, 0, 0, 3, 20, 90)) for _ in range(n)]
        inside = [rng.random() < 0.5 for _ in range(n)]
        window, surge = rng.randrange(1, 5), rng.choice((1, 30, 100, 500))
        got = html_text.kept_lines(weights, window, surge, inside)
        assert {k for k in range(n) if got[k]} == windows_by_hand(weights, window, surge, inside)
        one = html_text.kept_lines(weights, window, surge)
        assert {k for k in range(n) if one[k]} == windows_by_hand(weights, window, surge, [True] * n)


def test_a_tie_keeps_the_first_stretch():
    gap = "<p><a>x</a></p>" * 5
    assert html_text.extract(f"<p>one</p>{gap}<p>two</p>") == "one"


def test_without_classes_the_windows_find_the_article():
    page = f"<div><a href=/>Home</a></div><div>Buy this.</div><article><h1>Title</h1>{STORY}<p>Of.</p></article><div>c Someone, a line.</div>"
    text = html_text.extract(page)
    assert text.startswith("Title\nParagraph 0") and text.endswith("\nOf.") and "Buy" not in text and "Someone" not in text


@pytest.mark.parametrize(
    "page",
    ["<i>" * 50_000 + "</b>" * 50_000, "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000, "<div>" + "<i>" * 50_000 + "<hr>" * 50_000, "<div class='ad'>x" * 50_000,
     "<!" * 200_000, "<a '" * 100_000, "<i>" * 30_000 + "<h1>a</h1>" * 30_000, "<p>word " * 50_000, "<table>" + "<tr><td>" * 50_000],
    ids=lambda p: p[:12],
)
def test_hostile_pages_take_one_pass(page):
    start = time.process_time()
    html_text.extract(page)
    assert time.process_time() - start < 8


def test_end_tags_close_what_they_should():
    assert html_text.extract("<article><b>one</b></i> two<p>three</b> four</p></article>") == "one two\nthree four"
    assert html_text.extract("<article><ul><li>a<ul><li>b</ul><li>c</ul><p>d</article><footer>e</footer>") == "a\nb\nc\nd"
    assert html_text.extract("<article><table><tr><td>a<td>b<tr><td><nav>m</nav>c</table>d</article>") == "a\nb\nc\nd"
