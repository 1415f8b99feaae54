"""Properties that hold for any text."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import html_text, media, near_dups, pretokens, toxicity

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
text = st.text(st.characters(exclude_categories=["Cs"]), max_size=200)


@settings(max_examples=300, deadline=None)
@given(text)
def test_pretokens_join_to_the_text(t):
    import regex

    got = pretokens.splitter(PATTERN)(t)
    assert "".join(got) == t and got == regex.findall(PATTERN, t)


@settings(max_examples=200, deadline=None)
@given(text)
def test_media_round_trip(t):
    payload = media.payload_of(t)
    assert len(payload) % 64 == 0 and payload and payload.startswith(t.encode()) and media.from_png(media.to_png(payload)) == payload


@settings(max_examples=200, deadline=None)
@given(text, st.integers(1, 5))
def test_shingle_counts(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    want = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    (got,) = near_dups.shingle_sets([t], k, near_dups.WordHashes())
    assert len(got) == len(want) and (got[1:] > got[:-1]).all()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<table>", "<tr>", "<td>", "</table>", "<ul>", "<li>", "</ul>", "<ol start=x>", "<b>", "</i>", "<br>", "<script>", "</script>", "<!--", "-->", "<pre>", "</body>", "<h1>", "</h2>", "a < b", "x", " ", "\n", "&amp;", "<a href='", "<td colspan=3>", "<textarea>", "<head>", "<style>p{display:none}</style>"]), max_size=25))
def test_any_markup_gives_tidy_text(parts):
    got = html_text.page_text("".join(parts))
    assert got == got.strip("\n") and not re.search(r"[ \t]\n", got) or "<textarea>" in parts or "<pre>" in parts


@settings(max_examples=200, deadline=None)
@given(text)
def test_descriptions_are_finite(t):
    d = toxicity.describe(t, toxicity.Strengths({"bad": 3.0, "bad*": 2.0}))
    assert d.shape == (7,) and abs(d).max() < 100
