"""Tags, quotes, forms and layout parts of pages: no text is lost to them."""

import time

import pytest

from lucidframe.llm.html_extract import blocks, candidates


def text(page):
    return " ".join(w for words in candidates(blocks(page))[1] for w in words)


@pytest.mark.parametrize(
    "page,want",
    [
        ('<div class="a"">One text "quoted" here</div>', 'One text "quoted" here'),
        ("<p a'>Hello it's me</p>", "Hello it's me"),
        ('<p title="a > b">in</p><p title = \'a > b\' x>out</p>', "in out"),
        ("<p class=a'b>one</p> two's", "one two's"),
        ("<form id=f><div><main><p>Main text</p></main></div></form>", "Main text"),
        ("<form><article>Story</article><p>Your mail <input></p></form>", "Story"),
        ("<body><form><p>All of it in a form</p></form></body>", "All of it in a form"),
        ("<form role=search>Search</form><p>text</p>", "text"),
        ('<div class="right-sidebar"><article>Story here</article><p>side</p></div>', "Story here"),
        ('<div class="widget"><main>Main</main></div>', "Main"),
        ('<div class="sidebar"><nav><article>teaser</article></nav></div><p>text</p>', "text"),
        ("<aside><article>teaser</article></aside><p>text</p>", "text"),
        ("<header><main>Main</main> top</header>", "Main"),
        ("<p>if a <b then stop", "if a <b then stop"),
        ("<p>1 < 2 and 3 > 2 <3 you", "1 < 2 and 3 > 2 <3 you"),
        ('text <a href="http://x', "text"),
        ("text <", "text <"),
        ("text <!-->kept<!-- gone --> more<!--->end<!-- x --!>.", "text kept moreend."),
        ('<article>Body <section class="user-comments">c1</section><div class="share-this">s</div> end</article>', "Body end"),
        ('<article><div class="article-comments">c</div><div class="article-header">Head</div> end</article>', "Head end"),
        ("", ""),
    ],
)
def test_text_of(page, want):
    assert text(page) == want


def test_time_is_in_proportion():
    began = time.perf_counter()
    for part in ("<a ", '<a ="\'', "<p x='", "<!--", "<a\n=", "<form>", "='\">"):
        text(part * 100_000)
    assert time.perf_counter() - began < 20
