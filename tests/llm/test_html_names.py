"""HTML extraction: what names say of elements, the scan against all runs, and precision and recall on held-out layouts."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from quernstone.llm import html_text as H

TEXT = "The mill on the river grinds corn again after nine years of patient work, and the stones were cut by hand."
MORE = "Visitors may see it on the first Sunday of the month, when the wheel is let run for an hour or so."
APART = [
    '<div class="related-posts"><a href="/1">Another story</a> <a href="/2">A third story</a></div>', '<div class="ad-300x250">Buy two, get one free</div>', '<div class="adsbygoogle">Cheap flights today</div>',
    '<div class="comment-body">I was there and it was lovely</div>', '<div id="disqus_thread">Great read, thank you all</div>', '<div class="share-buttons"><a>Tweet</a><a>Mail</a></div>', '<div class="cookie-message">We use cookies on this site</div>',
    '<ul class="breadcrumb-trail"><li><a href="/">Home</a></li><li>News</li></ul>', '<div class="navLinks"><a href="/a">Sport</a> <a href="/b">Weather</a></div>', '<div class="siteFooter">All rights reserved</div>', '<section class="commentList"><p>First!</p></section>', '<div class="AdUnit">Now cheaper</div>',
]
STAYS = [
    '<div class="layout has-sidebar">%s</div>', '<section class="social-history">%s</section>', '<div id="form-content">%s</div>', '<div class="ad-free">%s</div>', '<div class="page no-comments">%s</div>', '<div class="postBody">%s</div>', '<div class="col-300x250 box">%s</div>',
    '<div class="footer-less shareholder">%s</div>',
]


@pytest.mark.parametrize("wrap", ["<article>%s</article>", '<div class="content">%s</div>'])
@pytest.mark.parametrize("extra", APART)
def test_elements_apart_within_an_article(wrap, extra):
    for body in (f"<h1>A mill is restored</h1><p>{TEXT}</p>{extra}<p>{MORE}</p>", f"<h1>A mill is restored</h1><p>{TEXT}</p><p>{MORE}</p>{extra}"):
        assert H.extract(f"<html><body>{wrap % body}</body></html>") == f"A mill is restored\n\n{TEXT}\n\n{MORE}"


@pytest.mark.parametrize("wrap", STAYS)
def test_names_that_say_nothing_of_their_element(wrap):
    assert H.extract(f"<body>{wrap % f'<p>{TEXT}</p><p>{MORE}</p>'}</body>") == f"{TEXT}\n\n{MORE}"
    assert H.extract(f"<body><article><p>{TEXT}</p>{wrap % f'<p>{MORE}</p>'}</article></body>") == f"{TEXT}\n\n{MORE}"


def test_scan_finds_the_best_of_all_runs():
    r = random.Random(4)
    for _ in range(400):
        values = [r.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(r.randrange(14))]
        runs = {(i, j): sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1)}
        best = max([0.0, *runs.values()])
        got = H.best_run(values)
        assert (runs[got] if got != (0, 0) else 0.0) == best
        if best > 0:  # of equals the one that ends first
            assert got[1] == min(j for (_, j), s in runs.items() if s == best)


def prose(r: random.Random, n: int) -> str:
    words = "river mill stone corn wheel water hand year month work light field road house bread salt winter garden letter market".split()
    return " ".join(r.choice(words) for _ in range(n)).capitalize() + "."


def page(seed: int) -> tuple[str, str]:
    """A page of a layout that the labelled ones don't have, and its main text."""
    r = random.Random(seed)
    paras = [prose(r, r.randrange(12, 60)) for _ in range(r.randrange(2, 8))]
    title = prose(r, 5)
    links = lambda n: "".join(f'<li><a href="/{i}">{prose(r, 3)}</a></li>' for i in range(n))
    body = [f"<h1>{title}</h1>", *(f"<p>{p}</p>" for p in paras)]
    for extra in r.sample(APART, r.randrange(3)):
        body.insert(r.randrange(1, len(body) + 1), extra)
    inner = "\n".join(body)
    menu, foot = f"<ul>{links(r.randrange(3, 9))}</ul>", f'<div class="bottom"><a href="/i">{prose(r, 2)}</a> <a href="/j">{prose(r, 2)}</a></div>'
    layout = r.choice([
        '<table><tr><td>{menu}</td><td>{inner}</td></tr></table>{foot}', '<div id="page"><div class="menu">{menu}</div><div class="body">{inner}</div><div id="sidebar">{menu}</div></div>{foot}',
        "<header>{menu}</header><main>{inner}</main><footer>{foot}</footer>", '{menu}<section class="entry">{inner}</section>{foot}', '<form action="/x"><div>{menu}</div><article>{inner}</article></form>{foot}',
    ])
    html = f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{layout.format(menu=menu, inner=inner, foot=foot)}</body></html>"
    return html, "\n\n".join([title, *paras])


def test_words_of_held_out_pages():
    """Precision and recall of words over forty pages whose layouts the weights were not learned from."""
    hit = got_all = want_all = 0
    for seed in range(40):
        html, want = page(seed)
        got, wanted = Counter(H.extract(html).split()), Counter(want.split())
        hit, got_all, want_all = hit + (got & wanted).total(), got_all + got.total(), want_all + wanted.total()
    assert hit >= 0.99 * got_all and hit >= 0.99 * want_all
