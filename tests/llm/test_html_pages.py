"""HTML extraction: pages whose article a mark, a form or an open tag seems to hide, other scripts, hostile pages, tables."""

import random
import time

import pytest

from strataform.llm import html_extract
from strataform.llm.html_extract import extract

ONE = "This is a long paragraph of the article that has many words in it, and it goes on for a while so that it is not short at all."
TEXTS = [ONE, ONE.replace("article", "story"), ONE.replace("long", "wide")]
BODY = "".join(f"<p>{t}</p>" for t in TEXTS)
WANT = "\n\n".join(TEXTS)
JAPANESE = ["これは日本語の長い段落です。記事の本文として十分な長さがあり、読みやすい文章になっています。" * 2] * 3
RUSSIAN = ["Это длинный абзац статьи, в котором достаточно слов, чтобы он не был коротким, и он продолжается дальше."] * 3


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><meta charset=utf-8><body>{BODY}</body></html>",
        f"<html><head><title>T<body>{BODY}",
        f"<head><title>T</title><div>{BODY}</div>",
        f'<body><form id="aspnetForm"><div class="nav"><a href=x>Home</a></div><div>{BODY}</div><input type=submit></form></body>',
        f'<div id="search-results">{BODY}</div><div class="footer">All rights</div>',
        f'<div class="post share-count">{BODY}</div>',
        f'<div class="layout-sidebar-right">{BODY}<div class="sidebar">Beside it</div></div>',
        f'<div class=sidebar><ul><li><a href=x>Link</a></ul><div class=content>{BODY}</div>',
        f'<article><div class="content share">{BODY}</div></article><nav>Menu</nav>',
        f'<article>{BODY}</article><div class="comments"><article class="comment">{BODY * 5}</article></div>',
        f'<main>{BODY}<section class="comments"><p>{ONE * 20}</p></section></main>',
        f'<div>{BODY}</div><div class="sidebar">{BODY}</div>',
    ],
)
def test_article_is_found(page):
    assert extract(page) == WANT


@pytest.mark.parametrize("texts", [JAPANESE, RUSSIAN])
def test_scripts_without_known_stop_words(texts):
    page = "<ul><li><a href=x>メニュー Меню</a></ul><div>" + "".join(f"<p>{t}</p>" for t in texts) + "</div>"
    assert extract(page) == "\n\n".join(texts)


@pytest.mark.parametrize("unit", ["<!", "<?", "<!--", "<script", "</p", "<a '", '<a "'])
def test_hostile_pages_take_linear_time(unit):
    page = unit * (2_000_000 // len(unit))
    began = time.process_time()
    extract(page)
    assert time.process_time() - began < 4


def test_deep_marks_take_linear_time():
    began = time.process_time()
    extract("<div class=ad><b>" * 30_000 + "x")
    assert time.process_time() - began < 10


def test_made_pages_give_their_articles():
    """Pages put together from an article and other parts, in every order: the article comes back, and nothing else."""
    noise = random.Random(5)
    others = ["<nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>", '<div class="cookie-notice">We use cookies here.</div>', '<div class="sidebar"><p>Also read this.</p></div>', "<footer>All rights reserved by us.</footer>", "<form><label>Mail</label><input></form>", "<script>var x = '<p>no</p>';</script>", '<div id="comments"><p>What a great post that was for all of us.</p></div>', "<header><h2>The site of ours</h2></header>"]
    for _ in range(60):
        texts = [ONE.replace("words", f"w{noise.randrange(99)} &amp; é") for _ in range(noise.randrange(3, 9))]
        before, after = (noise.sample(others, noise.randrange(5)) for _ in range(2))
        tag = noise.choice(["article", "main", "div"])
        page = "".join(["<body>", *before, f"<{tag}>", *(f"<p>{t}" + noise.choice(["</p>", ""]) for t in texts), f"</{tag}>", *after])
        assert extract(page) == "\n\n".join(t.replace("&amp;", "&") for t in texts)


def test_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars long"
    rows = [(1, "u", f"<p>{ONE}</p>", "x", 7), (1, "u", f"<p>{ONE}</p>", "y", 8), (None, None, None, None, None), (2, "v", "", "z", 0), (3, "w", f"<article>{'<p>' + ONE + '</p>' * 1}{'<p>ab cd</p>' * 50_000}</article>", "", 0)]
    got = html_extract.extract_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got) == [(0, "", 0), (1, "u", len(ONE)), (1, "u", len(ONE)), (2, "v", 0), (3, "w", len(ONE) + 7 * 50_000)]
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract_text(spark.createDataFrame([], schema)).count() == 0
