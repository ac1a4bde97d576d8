"""Spellings of lexicon words that the folding has to see through."""

import pytest

from wardwise.llm import toxicity

SPELLINGS = [
    "gruмple",  # as test_search.py's fixture writes it before it turns the letter back
    "ВLАRGОN",  # Cyrillic capitals
    "ΒLΑRGΟΝ",  # Greek capitals, of which the small forms look otherwise
    "ТRАSНУ КLМ",
    "ΖIΤ ΜYΧ ΗΥΚ",
    "ｇｒｕｍｐｌｅ",  # full width
    "grümplé",
    "grúmple",
    "worthle55",
    "worthle$$!",
    "w0rthle55, he said",
]


@pytest.mark.parametrize("text", SPELLINGS)
def test_spelling_matches(text):
    lexicon = toxicity.Lexicon({"grumple": 2.0, "blargon ": 2.0, "worthles": 2.0, "trashy ": 2.0, "zit ": 2.0}, [], [-1.0, 1.0, 1.0])
    assert len(lexicon.matches(toxicity.fold(text))) == 1 and lexicon.score(text) > lexicon.score("")


def test_whole_words_of_other_spellings():
    lexicon = toxicity.Lexicon({"klm ": 1.0, "myx ": 1.0, "hyk ": 1.0, "clown ": 1.0}, [], [-1.0, 1.0, 1.0])
    found = lambda t: [m[2] for m in lexicon.matches(toxicity.fold(t))]
    assert found("КLМ ΜYΧ ΗΥΚ") == ["klm ", "myx ", "hyk "]
    assert found("clown1 clown! cl0wn, clown 55") == ["clown "] * 4  # a number or a mark after a word ends it
    assert found("clown55x") == []


def test_learning_reads_the_spellings():
    rows = [(f"plain words number {i}", 0) for i in range(200)] + [(f"you worthle55 thing {i}", 1) for i in range(40)] + [(f"ＷＯＲＴＨＬＥＳＳ one {i}", 1) for i in range(40)]
    lexicon = toxicity.learn(rows)
    assert lexicon.score("a wörthless text") >= 0.5 > lexicon.score("a plain text")
