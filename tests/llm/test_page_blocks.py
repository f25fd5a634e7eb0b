"""Article text of few characters or of links is kept."""

import pytest

from remitlens.llm.html_text import main_text

LONG = "A sentence of the article that says something. " * 22
LINKED = [f"<li><a href='/{i}'>Reference number {i}</a></li>" for i in range(5)]


@pytest.mark.parametrize("html,text", [
    (f"<article><p>Body.</p><ul>{''.join(LINKED)}</ul></article>", "\n".join(["Body.", *(f"Reference number {i}" for i in range(5))])),
    ("<article><h1><a>Headline</a></h1><p><a>By line</a></p><p><a>Date</a></p><p><a>Place</a></p><p>Body text.</p></article>", "Headline\nBy line\nDate\nPlace\nBody text."),
    ("<main><p><a>One</a></p><p><a>Two</a></p></main>", "One\nTwo"),
    (f"<body><div id='story'>{f'<p>{LONG}</p>' * 3}<div class='ad'>Buy this</div><p>{'The end. ' * 16}</p></div>", "\n".join([LONG.strip()] * 3 + [("The end. " * 16).strip()])),
    (f"<body><div id='story'>{f'<p>{LONG}</p>' * 3}</div><div class='ad'>Buy this</div><div><p>Imprint of the site.</p></div>", "\n".join([LONG.strip()] * 3)),
])
def test_article_text_is_kept(html, text):
    assert main_text(html) == text


FRAMED = [
    "<form id='aspnetForm' action='/x'><input type=hidden><nav>Menu</nav><article><h1>Head</h1><p>Body text.</p></article></form>",
    "<form><h1>Head</h1><p>Body text.</p></form>",
    "<body><div class='content-area no-sidebar'><h1>Head</h1><p>Body text.</p></div>",
    "<article><div class='entry has-sidebar'><h1>Head</h1><p>Body text.</p></div></article>",
    "<div class='post comments-open'><h1>Head</h1><p>Body text.</p></div>",
]


def test_names_of_side_matter_are_whole_names():
    for html in FRAMED:
        assert main_text(html) == "Head\nBody text."
    for name in ("market-share", "related-work", "notice-period", "share_price", "advisor", "navy"):
        assert main_text(f"<article><p>One.</p><div class='{name}'>Two.</div></article>") == "One.\nTwo."
    for name in ("ad", "ad-slot", "site_footer", "cookie-notice big", "comments-area", "sidebar-left", "related-posts", "share-buttons", "ad-300x250"):
        assert main_text(f"<article><p>One.</p><div class='{name}'>Two.</div></article>") == "One."
    assert main_text("<article><p>One.</p><form><p><label>Name</label></p><p>Send</p></form></article>") == "One."
    assert len(main_text("<form>" * 20_000 + "<h1>deep</h1>")) == 4
