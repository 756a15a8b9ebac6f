"""Marks of page wrappers, forms and furniture."""

import pytest

from framelake.llm.html_text import main_text

TEXT = ["The river rose again in the night and by the morning the lower fields stood under water, so the farmers moved the cattle up to the hill behind the church and waited for the rain to stop.", "Nobody could say when the road would open.", "By the evening the water had gone down by a hand, and the first of them went back to look at what was left of the barns, the hay and the fences along the old road to the mill."]
BODY = "<h1>The flood</h1>" + "".join(f"<p>{x}</p>" for x in TEXT)
WANT = "\n".join(["The flood", *TEXT])
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>"
SIDE = "<div class='sidebar'><h3>More</h3><p>Read what our other reporters wrote about the weather this week and the last.</p></div>"
REMARKS = "<div class='comments'><h2>Comments</h2><p>Great report, I really liked to read it and hope for more of this kind, thanks!</p><p>Me too, what a week it was.</p></div>"


@pytest.mark.parametrize("wrapper", ["<div class='layout has-sidebar'>", "<div class='widget'>", "<div class='post comments-open'>", "<div id='social'>", "<form id='aspnetForm' method=post>"])
def test_wrapper_of_the_page_loses_no_article(wrapper):
    end = "</form>" if wrapper.startswith("<form") else "</div>"
    for body in (BODY, f"<article>{BODY}</article>"):
        assert main_text(f"<body>{NAV}{wrapper}{body}{end}<footer>Imprint</footer>") == WANT
        assert main_text(f"<body>{NAV}{wrapper}{body}{SIDE}{REMARKS}{end}<footer>Imprint</footer>") == WANT


def test_furniture_inside_an_article_of_a_marked_wrapper():
    form = "<form><p>Please write to us with your own story of the flood and we may print it here.</p></form>"
    page = f"<body>{NAV}<div class='layout widget'><article>{BODY}{REMARKS}{form}</article></div><footer>Imprint</footer>"
    assert main_text(page) == WANT


def test_long_comments_are_no_wrapper():
    many = REMARKS.replace("</div>", "<p>The same happened to us some years ago, and nobody came to help for three days.</p>" * 4 + "</div>")
    assert main_text(f"<body>{NAV}<div>{BODY}</div>{many}") == WANT
