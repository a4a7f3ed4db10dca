"""Elements without text that aren't closed, or close themselves, take no main text with them."""

import pytest

from tessera.llm import html_crf

PAGE = "<article><p>Plain simple text stands here.</p>%s<p>Second part of the text follows.</p></article>%s"
WANT = ["Plain simple text stands here.", "Second part of the text follows."]


def texts(tag, after=""):
    return [b.text for b in html_crf.blocks(PAGE % (tag, after))]


@pytest.mark.parametrize("tag", ["<svg width='1'/>", "<math/>", '<iframe src="a" />', "<script src='a'/>", "<svg>", "<iframe src=a>", "<object data='x'>", "<template>", "<noscript>", "<select>", "<svg><svg>"])
def test_nothing_is_lost(tag):
    assert texts(tag) == WANT


def test_a_later_end_tag_does_not_end_an_empty_element():
    assert texts('<svg class="i"/>', "<svg><text>no</text></svg>") == WANT


@pytest.mark.parametrize("tag", ["<svg><text>no</text></svg>", "<iframe src=http://a/>no</iframe>", "<object>no</object>", "<script>no</script>"])
def test_closed_elements_go_with_what_they_hold(tag):
    assert texts(tag) == WANT


def test_an_unclosed_script_holds_the_rest():
    assert texts("<script>var a = 1") == WANT[:1]
