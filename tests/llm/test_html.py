"""Main text of pages: what decides, awkward markup, and time."""

import random
import time

import pytest

from quire.llm import html_text as H

WORDS = "word " * 60


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>Copyright law in the nineteenth century was odd.</p><p>It was slow.</p>", "Copyright law in the nineteenth century was odd. It was slow."),
        ("<div class='share-price'>" + WORDS + "</div>", WORDS.strip()),
        ("<article><p>x y z.</p><div class='related-work'>Prior art.</div></article>", "x y z. Prior art."),
        ("<h1>Title</h1><p>Short.</p>" + "<p>long words here.</p>" * 9, "Title Short. " + " ".join(["long words here."] * 9)),
        ("<main><p>Story goes on.</p><section><h2>Comments</h2><p>Nice one!</p></section></main>", "Story goes on."),
        ('<p>see <a href="x"">link</a> now.</p>', "see link now."),
        ("<article>Short.</article><div class=ad>" + WORDS + "</div>", "Short."),
        ("<div class=teaser>Ten words of a teaser.</div><article>" + WORDS + "</article>", WORDS.strip()),
        ("<article>A teaser.</article><div>" + WORDS + "</div>", "A teaser. " + WORDS.strip()),
        ("<p>" + WORDS + "</p><div>&copy; 2020 somebody</div>", WORDS.strip()),
        ("<form action=/><p>" + WORDS + "</p></form>", WORDS.strip()),
        ("<div><h1><a href=/p>The title as link</a></h1><p>" + WORDS + "</p></div>", "The title as link " + WORDS.strip()),
        ("<div><p>" + WORDS + "</p><p><a href=x>Read the source paper</a></p></div>", WORDS + "Read the source paper"),
        ("<p>" + WORDS + "</p><p><a href=x>Home</a></p><p><a href=y>About</a></p>", WORDS.strip()),
        ("<p>" + WORDS + "</p><div class='ad-slot'>Buy now.</div><p>" + WORDS + "</p>", WORDS + WORDS.strip()),
        ("<p>" + WORDS + "</p><label for=s>Choose</label><select id=s><option>a</select><p>" + WORDS + "</p>", WORDS + WORDS.strip()),
        ("<article><ul><li><a href=1>One reference</a></ul></article>", "One reference"),
    ],
)
def test_main_text(html, text):
    assert H.main_text(html) == text


MENU = "<div><a href=/>Home</a> | <a href=/a>About</a></div><h3>Topics</h3><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul>"
BODY = "<p>Text of the page, long enough.</p><p><a>Only a link</a></p><p>More of the text of it.</p>"


def test_sums_decide():
    page = MENU + BODY
    assert H.main_text(page) == "Text of the page, long enough. Only a link More of the text of it."
    # With windows of one line a label of links is text and a link in the text is none.
    assert H.main_text(page, window=1) == "Topics Text of the page, long enough. More of the text of it."


def test_tags_and_names_are_not_needed():
    nav, article = "<nav><ul><li><a href=1>alpha</a></li><li><a href=2>beta</a></li></ul></nav>", "<article><h1>A title</h1><p>" + WORDS + "</p><p>Tail.</p></article>"
    page = "<html><head><title>t</title></head><body>" + nav + article + "<footer>f</footer></body></html>"
    expected = "A title " + WORDS + "Tail."
    plain = page.replace("<nav>", "<div>").replace("</nav>", "</div>").replace("<article>", "<div>").replace("</article>", "</div>")
    assert H.main_text(page) == H.main_text(plain) == expected


def generated(seed: int) -> tuple[str, str]:
    """A page whose parts all stand in neutral elements, and its article."""
    r = random.Random(seed)
    sentence = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(n)).capitalize() + "."
    links = lambda n: "<ul>" + "".join(f"<li><a href=/{i}>{sentence(r.randint(1, 3))[:-1]}</a></li>" for i in range(n)) + "</ul>"
    blocks = [sentence(4)[:-1], *[sentence(r.randint(12, 60)) for _ in range(r.randint(4, 12))]]
    body = [f"<h1>{blocks[0]}</h1>", *[f"<p>{b}</p>" for b in blocks[1:]]]
    parts = [links(r.randint(4, 9)), *body, links(r.randint(4, 9)), "".join(f"<h4><a href=/t{i}>{sentence(6)[:-1]}</a></h4>" for i in range(5))]
    advert = f"<div class='ad-slot'>{sentence(8)}</div>"
    parts.insert(r.randint(2, len(body)), advert)
    return "<html><body>" + "".join(f"<div class=c{i}>{p}</div>" for i, p in enumerate(parts)) + "</body></html>", " ".join(blocks)


@pytest.mark.parametrize("seed", range(20))
def test_generated_pages(seed, monkeypatch):
    html, article = generated(seed)
    assert H.main_text(html) == article
    monkeypatch.setattr(H, "_kept", lambda run, window: run)
    assert H.main_text(html) != article


@pytest.mark.parametrize("html", ["<a " * 350_000, "<b>" * 150_000 + "</i>" * 150_000, '<a x="' * 200_000, "<p " * 200_000 + ">", "<" * 1_000_000, '<div class="a">' * 60_000 + "x", "<!--" * 200_000, "<h2>Comments</h2>" * 50_000, "<div class=ad>x. " * 60_000, "<div class='ad box'>x. " * 45_000])
def test_linear_in_bad_markup(html):
    began = time.process_time()
    H.main_text(html)
    assert time.process_time() - began < 5
