"""Raw elements of pages end at their own end tag."""

from __future__ import annotations

import pytest

from tidemark.llm import tag_paths


@pytest.mark.parametrize("raw", [
    "<script>for(i=0;i<n;i++){}</script>", "<script>if(a<b)c='x</p>'</SCRIPT >", "<style>a<b{}</style\n>",
    "<textarea>1 <b and 'more</textarea>", "<script>'</scripted>' <!-- a<b </script>",
])
def test_less_than_inside_a_raw_element_hides_nothing(raw):
    assert tag_paths.main_text(f"<body>{raw}<article><p>First text.</p>{raw}<p>Second text.</p></article></body>") == "First text. Second text."


def test_a_raw_element_without_an_end_reaches_to_the_end():
    assert tag_paths.main_text("<p>Before, text.</p><script>a<b <p>after</p>") == "Before, text."
