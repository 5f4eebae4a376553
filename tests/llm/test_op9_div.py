"""Main text that stands in plain divs and sections, and headings beside it."""

import pytest

from wirelens.llm.op9_html import main_text

LONG = "Plain text without end " * 20


@pytest.mark.parametrize("html, want", [
    (f"<body><div id=content><div>{LONG}</div><div>{LONG}</div><ul><li>x</li><li>y</li></ul></div></body>", [LONG.strip()] * 2 + ["x", "y"]),
    (f"<body><h1>Title</h1><div><p>{LONG}</p></div></body>", ["Title", LONG.strip()]),
    (f"<body><section><p>Short</p></section><section><p>{LONG}</p><p>{LONG}</p></section><div><a href=a>Link</a> <a href=b>Link</a></div></body>", ["Short"] + [LONG.strip()] * 2),
])
def test_text_in_divs(html, want):
    assert main_text(html) == "\n".join(want)
