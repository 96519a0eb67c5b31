"""Pure functions against values derived by hand and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.functions import codec, html, linguistics, urls
from quillon.functions.analyzer import DEFAULT, expand_synonyms
from quillon.functions.sentiment import Lexicon, class_shares, score_document
from quillon.operators.snippet import focus
from quillon.operators.suggest import allowed_distance, suggest_word
from quillon.plans.query import Match, QueryError, SearchOptions, parse, parse_order


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 2**32 - 1)))
def test_variable_bytes_round_trip(xs):
    assert codec.vb_decode(codec.vb_encode(xs)) == xs
    up = sorted(set(x for x in xs if x))
    assert codec.vb_delta_decode(codec.delta_vb_encode(up)) == up
    assert codec.vb_delta_max(codec.delta_vb_encode(up)) == (up[-1] if up else 0)
    assert 0x80 not in [d for d in codec.delta_vb_encode(up)[:1]] or not up


@settings(deadline=None, max_examples=40)
@given(st.dictionaries(st.integers(1, 10**6), st.lists(st.integers(1, 5000), min_size=1, max_size=5, unique=True), max_size=6))
def test_posting_round_trip(docs):
    ids = sorted(docs)
    pos = [sorted(docs[i]) for i in ids]
    senti = [(-1) ** k * (k % 128) for k in range(len(ids))]
    assert [(d, p) for d, _, p in codec.decode_posting(codec.encode_posting(ids, pos))] == list(zip(ids, pos))
    assert codec.decode_posting(codec.encode_posting(ids, pos, senti), True) == list(zip(ids, senti, pos))


def test_codec_edges():
    assert codec.vb_encode([-1]) is None
    assert codec.vb_encode([1, 127, 128]) == bytes([0x81, 0xFF, 0x00, 0x81])
    assert [codec.required_bits(n) for n in (1, 2, 3, 4, 5)] == [1, 1, 2, 2, 3]
    assert codec.delta_encode([3, 5, 9]) == [3, 2, 4]


@pytest.mark.parametrize("word, stem", [("cars", "car"), ("running", "run"), ("relational", "relat"), ("ponies", "poni"), ("hopping", "hop")])
def test_english_stems(word, stem):
    assert linguistics.stem_english(word) == stem


def test_finnish_syllables_and_stem():
    assert linguistics.syllables("talossa") == ["ta", "los", "sa"]
    assert linguistics.stem_finnish("talossa").startswith("tal")
    assert "talossa".startswith(linguistics.stem_finnish("talossa"))


@pytest.mark.parametrize("word, code", [("smith", "SM0"), ("knight", "NT"), ("phone", "FN"), ("xavier", "SF")])
def test_metaphone(word, code):
    assert linguistics.double_metaphone(word)[0].startswith(code[:2])
    assert linguistics.metaphone_int("123") == 0
    assert linguistics.metaphone_int("äiti") == linguistics.metaphone_int("aiti") != 0


def test_synonyms_first_list_counts():
    t = expand_synonyms(("color, colour", "colour, hue"))
    assert t["color"] == ["colour"] and t["colour"] == ["color"] and t["hue"] == ["colour"]


def test_urls():
    assert urls.domain_info("http://www.shop.example.co.uk/x") == ("example.co.uk", "shop")
    assert urls.domain_info("http://localhost/x") == ("localhost", "")
    assert urls.domain_info("/relative") is None
    assert urls.domain_allowed("http://a.example.com", ["*.example.com"])
    assert not urls.domain_allowed("http://a.example.com", ["example.com"])
    assert urls.absolute("http://a.com/b/c", "../d") == "http://a.com/d"
    assert urls.parse_keywords("news europe -economy") == (["news", "europe"], ["economy"])


def test_page_fields():
    p = html.parse_page('<html lang="en"><title>T &amp; x</title><meta name="description" content="m"><body>a<script>no</script> b<a href="/x#y">l</a><a rel="nofollow" href="/n">n</a><a href="mailto:x">m</a></body></html>')
    assert (p["title"], p["meta"], p["lang"], p["links"]) == ("T & x", "m", "en", ["/x"])
    assert "no" not in p["content"].split() and html.parse_page("")["links"] == []
    assert html.text_of("<p>a</p><b>c<i>d</i></b>", ("b",)).split() == ["a"]


def test_sentiment():
    lex = Lexicon.of({1: ["good", "well done"], -1: ["bad", ":("], 0: ["okay"]})
    total, words = score_document("This is good good work. That was bad indeed :( my friend. A plain sentence here.", lex)
    assert total == 0 and words["good"] == 2 and words["bad"] == -2 and "plain" not in words
    assert class_shares("good", lex)[1] > class_shares("good", lex)[-1]
    assert score_document("", lex) == (0, {})


def test_query_parse():
    q = parse('"of the" -and there*', DEFAULT, SearchOptions())
    assert [(t.token, t.group > 0, t.negative, t.exact) for t in q.terms] == [("of", True, False, True), ("the", True, False, True), ("and", False, True, False), ("there", False, False, True)]
    assert q.pairs == 1 and len(q.wanted) == 3
    assert all(not t.group for t in parse('broken " quote', DEFAULT, SearchOptions()).terms)
    assert parse("", DEFAULT, SearchOptions()).terms == ()


def test_option_checks():
    assert parse_order("@rank asc") == ("@score", True)
    for bad in (SearchOptions(filters={"x": (1,)}), SearchOptions(match=9), SearchOptions(group_by="x"), SearchOptions(ranges={"a": (2, 1)}), SearchOptions(sort_by="@count desc"), SearchOptions(expansion_limit=999)):
        with pytest.raises(QueryError):
            bad.check({"a"})
    assert SearchOptions(match=1).check({"a"}).match is Match.ANY


def test_suggestions():
    assert [allowed_distance(w) for w in ("abcd", "abcdef", "abcdefgh")] == [1, 2, 3]
    assert suggest_word("hellsinki", 0, 0, 100, [("helsinki", 50, 1, False)]) == "helsinki"
    assert suggest_word("common", 900, 0, 1000, [("comon", 3, 1, False)]) is None


def test_snippet():
    text = "Nothing here. " * 30 + "The quick brown fox jumps over it. " + "More words follow. " * 30
    s = focus(text, "brown fox")
    assert "<b>brown</b>" in s.lower() and len(s) < 300
    assert focus("", "x") == "" and "<b>" not in focus("abc", "zzz")
