"""Lines that a site repeats in its articles."""

import pytest
from flowlake.llm import page_text as pt


@pytest.mark.parametrize("rows", [256, 1])
def test_lines_that_recur_over_the_host_go_from_articles(spark, monkeypatch, rows):
    monkeypatch.setattr(pt, "ROWS", rows)
    pages, expected = [], {}
    for k in range(24):
        own = [f"Paragraph {k} of a story, long enough to be most of its page.", f"A second paragraph {k} with words of its own."]
        if k in (6, 7, 8):
            own.append("A passage that a few articles quote.")
        extra = ["Subscribe to our letter"] if k % 2 else ["Thanks for reading this"]
        body = "".join(f"<p>{x}</p>" for x in [own[0], *extra, *own[1:]])
        pages.append((k, f"http://s.com/{k:02d}", f"<nav>n</nav><article>{body}</article>"))
        expected[k] = "\n\n".join(own)
    for k in range(30, 33):  # too few pages to tell
        pages.append((k, f"http://t.com/{k}", f"<main><p>Text {k} of a small site.</p><p>Twice</p></main>"))
        expected[k] = f"Text {k} of a small site.\n\nTwice"
    for k in range(40, 48):  # copies of one article keep it
        pages.append((k, f"http://u.com/{k}", "<article><p>The same story.</p><p>Again.</p></article>"))
        expected[k] = "The same story.\n\nAgain."
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in pt.extract(frame).collect()} == expected
