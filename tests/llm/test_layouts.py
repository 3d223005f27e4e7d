"""Main text of pages of different layouts, broken markup, and what the cut decides."""

from __future__ import annotations

import time

import pytest

from gradelake.llm import html

PROSE = [
    "The committee met on Tuesday, and after a long discussion it agreed on a new plan.",
    "Nobody had expected this; the old plan, it was said, would do for another ten years.",
    "Work begins in spring, weather permitting, and is to end within two years.",
]
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li><li><a href=/b>News</a></li></ul>"
BODY = "".join(f"<p>{p}</p>" for p in PROSE)
WANTED = "\n".join(PROSE)

LAYOUTS = {
    "semantic": f"<header>Site</header><nav>{MENU}</nav><main><article>{BODY}</article></main>"
                "<aside>Related: more</aside><footer>About</footer>",
    "divs by class": f"<div class='top-menu'>{MENU}</div><div class='post-body'>{BODY}</div>"
                     "<div class='post-comments'><p>I do not agree with any of this, at all.</p></div>"
                     "<div class='entry-footer'>Filed under: plans</div>"
                     "<div class='share-post'>Tell your friends about it.</div>",
    "page-wide form": f"<form action=/x><div class=menu>{MENU}</div><article>{BODY}</article>"
                      "<input name=q><button>Go</button></form>",
    "state classes": "<body class='has-sidebar no-comments'><div class='header-menu-open'>"
                     f"<div id=nav>{MENU}</div><article>{BODY}</article></div></body>",
    "tables": f"<table><tr><td class=sidebar>{MENU}</td><td id=content>{BODY}</td></tr></table>",
    "div soup": f"<div><div>{MENU}</div><div>{BODY}</div></div>",
    "cards beside": f"<main><article>{BODY}</article></main><div class='related-posts'>"
                    "<article><p>Another story, told elsewhere, at some length.</p></article></div>",
    "hidden": f"<article>{BODY}<div hidden>Not shown.</div><p style='display: none'>Nor this.</p>"
              "</article>",
    "entry header": f"<div class=entry><div class='entry-header'><h1>{PROSE[0]}</h1></div>"
                    f"<p>{PROSE[1]}</p><p>{PROSE[2]}</p></div><div class=header>Site</div>",
    "camel case": f"<div id=mainContent>{BODY}</div><div id=cookieNotice>We use cookies, a lot.</div>",
}


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_layouts(name):
    assert html.main_text(f"<html><head><title>T</title></head>{LAYOUTS[name]}</html>") == WANTED


def test_small_pages():
    assert html.main_text("<body><p>Hi</p></body>") == "Hi"
    assert html.main_text("Hi") == "Hi"
    assert html.main_text("<article>x</article>") == "x"
    assert html.main_text("<article></article><p>One line.</p>") == "One line."
    assert html.main_text("<form><label>Name</label></form>") == ""
    assert html.main_text("<nav>Menu</nav>") == ""


def test_hidden_as_a_value_is_no_attribute():
    page = "<article><p title='is hidden here'>Shown.</p><p data-x=hidden>Also.</p></article>"
    assert html.main_text(page) == "Shown.\nAlso."


def test_the_cut_decides_where_costs_are_mixed():
    """Blocks whose own cost says boilerplate stay with the prose around them, and others go."""
    pages = [
        f"<div class=x>{MENU}</div><div><p>{PROSE[0]}</p><p><a href=/>See here</a></p>"
        f"<p>{PROSE[1]}</p></div>",
        f"<div><p>{PROSE[0]}</p><p><a href=/1>One</a></p><p><a href=/2>Two</a></p>"
        f"<p>{PROSE[2]}</p></div><div>{MENU}{MENU}</div>",
        f"<div>{MENU}<p>{PROSE[1]}</p><p>{PROSE[2]}</p></div>",
    ]
    found = [block for page in pages for block in html.labelled(page)]
    changed = [text for text, gain, keep in found if (gain > 0) != keep]
    assert "See here" in changed
    assert 0 < len(changed) < len(found) / 2
    for page in pages:
        kept = html.main_text(page)
        assert "Home" not in kept and PROSE[2 if PROSE[2] in page else 1] in kept


@pytest.mark.parametrize(
    "part",
    [
        ("<b>", "x</i>"), ("<b>", "x"), ("<div>", "x</p>"), ("<p>", "</div>x"), ("<b>", "<hr>x"),
        ("<b>", "<p>x"), ("<span>", "<li>x"), ("<div class=main>", "x<br>"), ("<ul><li>", "</a>x"),
    ],
)
def test_time_grows_with_the_page(part):
    def seconds(n):
        page = part[0] * n + part[1] * n
        start = time.perf_counter()
        html.blocks(page)
        return time.perf_counter() - start

    seconds(100)
    small, large = min(seconds(2000) for _ in range(3)), min(seconds(16_000) for _ in range(3))
    assert large < 24 * small + 0.05
