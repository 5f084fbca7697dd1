"""Names alone do not take an article, nor does markup of formulas."""

import pytest

from tarn.llm import html as H


@pytest.mark.parametrize(
    ("body", "wanted"),
    [
        ("<div class='no-comments'><article><p>a</p></article></div>", "a"),
        ("<div id='page' class='with-ads'><article><p>a</p></article></div>", "a"),
        ("<article class='post category-advertising tag-promotion'><p>a</p></article>", "a"),
        ("<div class='promo'><div><article><p>a</p><div class='ads'>no</div></article></div></div>", "a"),
        ("<div class='related'><main><article><p>a</p></article></main></div>", "a"),
        ("<div class='promo'><article><p>no</p></article></div><article><p>a</p></article>", "a"),
        ("<article><p>a</p><article class='comment'><p>no</p></article></article>", "a"),
        ("<article><p>a</p></article><div class='comments'><article><p>no</p></article></div>", "a"),
        ("<div hidden><article><p>no</p></article></div><p>free</p>", "free"),
        ("<article><p>sum <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>", "sum x=2 holds"),
    ],
)
def test_main_text(body, wanted):
    page = H.parse(f"<html><body>{body}</body></html>")
    assert H.main_text(page, page.furniture()) == wanted
