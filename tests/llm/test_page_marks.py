"""Classes and ids that sound like something else on the elements that hold the article."""

import pytest
from flowlake.llm import page_text as pt

STORY = "<h1>Title</h1><p>The story itself, longer than all else.</p>"
TOLD = ["Title", "The story itself, longer than all else."]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<div class='layout has-sidebar'><article>{STORY}</article><div class='sidebar'>s</div></div>", TOLD),
        (f"<div id='page' class='no-sidebar'>{STORY}</div>", TOLD),
        (f"<div class='widget Blog'><article>{STORY}</article></div><div class='widget Feed'>f</div>", TOLD),
        (f"<div class='widget Blog'>{STORY}</div><div class='widget Feed'>f</div>", TOLD),
        (f"<article class='post tags-x'>{STORY}<div class='post-tags'>t</div></article>", TOLD),
        (f"<article class='post tags'>{STORY}</article><ul class='tags'><li>t</ul>", TOLD),
        (f"<main>Blog<div class='widget Blog'><article>{STORY}</article></div></main>", ["Blog", *TOLD]),
        (f"<main class='alert'>{STORY}</main>", TOLD),
        (f"<div class='related'><div class='header'><article>{STORY}</article>x</div></div>", TOLD),
        (f"<article>{STORY}</article><ol class='comment-list'><li><article>{'long reply ' * 50}</article></ol>", TOLD),
        (f"<p>{TOLD[1]}</p><div class='comments'><article>{'long reply ' * 50}</article></div>", TOLD[1:]),
        (f"<article>{STORY}</article><div class='widget'><p>{'link text ' * 50}</p></div>", TOLD),
        (f"<article>{STORY}<div class='site-footer'>f</div><div class='newsletter-box'>n</div></article>", TOLD),
    ],
)
def test_marks_do_not_drop_the_article(html, text):
    assert [block[0] for block in pt.blocks_of(html) if block[1]] == text
