"""Pages without the tags that the standard lets one leave out read like the pages that have them."""

from itertools import combinations

import pytest

from tidemark.llm.html_text import rendered

PARTS = ["<html>", "<head>", "<meta charset=utf-8><title>t</title><style>p{}</style><script>x</script>\n", "</head>", "<body>", "", "</body>", "</html>"]
OPTIONAL = [0, 1, 3, 4, 6, 7]


@pytest.mark.parametrize("body", ["<p>Hello world", "Just text", "<div>Body <b>text</b></div>", "<table><tr><td>a<td>b</table>", "<br>x", "</br>x", "<section><title>s</title>y</section>"])
def test_optional_tags(body):
    want = rendered("<!DOCTYPE html>" + "".join(x or body for x in PARTS))
    assert want
    for n in range(1, len(OPTIONAL) + 1):
        for gone in combinations(OPTIONAL, n):
            page = "<!DOCTYPE html>" + "".join(x or body for i, x in enumerate(PARTS) if i not in gone)
            assert rendered(page) == want, (gone, page)


def test_ruby_and_preformatted():
    assert rendered("<ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>") == "漢kan"
    assert rendered("<pre>\na\n b</pre>") == "a\n b" and rendered("<pre>\n\na</pre>").endswith("a")
    assert rendered("<head><noscript><p>no</p></noscript><template><p>t</p></template><p>yes") == "yes"
