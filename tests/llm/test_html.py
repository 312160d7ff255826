"""Main text of pages: nothing of an article is cut, nothing beside it is taken, broken pages stay cheap."""

from __future__ import annotations

import time

import pytest

from tidecast.llm import html_extract

SAYS = [f"Passage number {i} of the article goes on for a while and then ends." for i in range(5)]
BODY = "".join(f"<p>{x}</p>" for x in SAYS)
LINKS = "<a href=a>One more page of this site</a> <a href=b>Another page of this site</a>"


def text_of(html: str, path: str | None = None) -> list[str]:
    page = html_extract.skeleton(html)
    return html_extract.extract(page, page["path"] if path is None else path).split("\n")


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<div class=post><h1>Short title</h1><div class=body>{BODY}</div><p>By A. Writer</p></div>", ["Short title", *SAYS, "By A. Writer"]),
        (f"<div class=main><p>Yes.</p><p>No.</p><div class=q>{BODY}</div></div>", ["Yes.", "No.", *SAYS]),
        (f"<body><header>Site</header><article><header><h1>Title</h1></header>{BODY}<footer>Foot</footer></article></body>", ["Title", *SAYS]),
        (f"<body><div class=box>{BODY}</div><div class=box>{LINKS}</div></body>", SAYS),
        (f"<div class=post><div class=body>{BODY}</div><ul><li>{LINKS}</ul><p>End.</p></div>", [*SAYS, "End."]),
        (f"<body><h1>Title</h1><div class=body>{BODY}</div><div class=x>All rights</div></body>", ["Title", *SAYS]),
        (f"<main><h1>Title</h1><div class=x>Short</div><article>{BODY}</article></main>", ["Title", *SAYS]),
        (f"<div class='w-1/2 p4'>{BODY}</div>", SAYS),
        (f"<div title='class=ad' data-class=sidebar>{BODY}</div>", SAYS),
    ],
)
def test_nothing_is_cut_and_links_beside_the_article_stay_out(html, want):
    assert text_of(html) == want


def test_the_rest_of_the_own_container_stays_beside_the_consensus_path():
    lead = "A lead of one sentence that the host's usual path does not hold."
    html = f"<body><div class=post><div class=lead><p>{lead}</p></div><div class=body>{BODY * 3}</div></div></body>"
    assert text_of(html, "/body/div.post/div.body") == [lead, *SAYS * 3]


def test_elements_on_the_path_are_taken_unless_mostly_links():
    html = f"<body><div class=a>{BODY}</div><div class=b><p>Told apart.</p></div><div class=b>{LINKS}</div></body>"
    assert text_of(html, "/body/div.b") == [*SAYS, "Told apart."]
    assert text_of(html, "/body/div.none") == SAYS


def test_quotes_count_after_an_equals_sign_only():
    assert text_of("<p title='a > b'>one <b \">two</b> <i x=\"three>four</i>") == ["one two four"]
    assert text_of("kept <div class=") == ["kept <div class="]


def test_character_references_of_any_length():
    assert text_of("&#" + "0" * 5000 + "65;&#x42;&#" + "9" * 5000 + ";&amp;") == ["AB�&"]


@pytest.mark.parametrize("unit", ["<div ", "<div>", '<a ">', '<a x="', "<b>", "<p><button><div>", "<li><div>", "<b><p>x", "<div><li></li>", "</div>", "<td>", "<!", "<a x=\"<a x='>"])
def test_time_grows_with_the_page_and_not_with_its_square(unit):
    def seconds(size: int) -> float:
        at = time.process_time()
        html_extract.extract(html_extract.skeleton(unit * (size // len(unit))), "/div")
        return time.process_time() - at

    assert seconds(800_000) < 16 * max(seconds(200_000), 0.2)


def test_repeated_rows_and_broken_pages_in_one_table(spark):
    html = f"<div class=post><h1>Short title</h1><div class=body>{BODY}</div></div>"
    rows = [(1, "http://h.org/a", html), (1, "http://h.org/a", html), (2, None, html), (3, "http://h.org/b", "<div " * 20_000), (4, "http://h.org/c", None)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    full = "\n".join(["Short title", *SAYS])
    assert sorted((r.page_id, r.text if r.page_id != 3 else "", r.n_chars) for r in got) == [
        (1, full, len(full)), (1, full, len(full)), (2, full, len(full)), (3, "", 99_999), (4, "", 0),
    ]
