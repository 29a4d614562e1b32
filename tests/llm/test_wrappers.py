"""Pages whose wrappers bear names of something else."""

import pytest

from callgauge.llm import pages

LONG = "A sentence of an article that has quite a number of words and reads like prose. "
ARTICLE = f"<h1>Title</h1><p>{LONG * 2}</p><p>Short.</p><p>{LONG}</p>"
WANT = f"Title\n\n{(LONG * 2).strip()}\n\nShort.\n\n{LONG.strip()}"


@pytest.fixture(scope="module")
def tree():
    return pages.trained_tree()


@pytest.mark.parametrize("before,after", [
    ("<div class='layout with-sidebar'><main><article>", "</article></main></div>"),
    ("<div class='sidebar-right'><article>", "</article></div>"),
    ("<article class='post comments-open'>", "</article>"),
    ("<article class='post share'>", "</article>"),
    ("<form id='aspnetForm'><nav><a href='/'>Home</a></nav><article>", "</article><footer>Imprint of the site</footer></form>"),
    ("<form><div id='content'>", "</div></form>"),
    ("<body class='menu-open header'><main>", "</main></body>"),
    ("<div id='header-menu'><div>", "</div></div>"),
])
def test_wrapped_article_is_whole(tree, before, after):
    assert pages.main_text(before + ARTICLE + after, tree) == WANT


def test_other_parts_stay_out(tree):
    page = f"""<div class="with-sidebar"><nav><a href="/">Home</a></nav><main>{ARTICLE}<aside><article><p>{LONG}</p></article></aside>
    <section class="comments"><article class="comment"><p>{LONG}</p></article><article><p>{LONG}</p></article></section></main><div class="sidebar"><p>{LONG}</p></div></div>"""
    assert pages.main_text(page, tree) == WANT


@pytest.mark.parametrize("piece", [
    "<svg class='i'/>", "<svg/>", "<button>", "<object data='x'>", "<select>", "<noscript>", "<template>", "<button-group></button-group>", "<template-x>", "<title-bar></title-bar>",
    "<svg><svg></svg><text>drawn</text></svg>", "<button>Press <b>me</b></button>", "<object><object>a</object>b</object>", "<noscript><p>No script</p></noscript>",
])
def test_hidden_elements_hide_no_more_than_themselves(tree, piece):
    page = f"<article><h1>Title</h1><p>{LONG}{piece}{LONG}</p><p>Short.</p><p>{LONG}</p></article><footer><button>Up</button><svg></svg></footer>"
    assert pages.main_text(page, tree) == f"Title\n\n{LONG}{LONG.strip()}\n\nShort.\n\n{LONG.strip()}"
