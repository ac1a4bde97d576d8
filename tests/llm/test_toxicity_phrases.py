"""Exceptions of several words around a term."""

from wardwise.llm import toxicity


def test_benign_phrases_are_spared():
    clean = [(f"plain words number {i}", 0) for i in range(200)]
    clean += [(f"{w} trash can", 0) for w in ("green", "empty", "open", "full", "wide", "iron")] + [(f"{w} old trash bag", 0) for w in ("an", "my")]
    toxic = [(f"you trash {w} {i}", 1) for i in range(20) for w in ("person", "thing")] + [("such old trash bag of mine", 1)]
    lexicon = toxicity.learn(clean + toxic)
    assert "trash " in lexicon.terms and "trash can" in lexicon.exceptions
    assert "old trash bag" not in lexicon.exceptions  # toxic texts have it too
    assert lexicon.score("a blue trash can here") < 0.5 <= lexicon.score("you trash")


def test_phrases_are_whole_words_one_space_apart():
    around = toxicity.phrases_around("a b trash, can trash can\ncan", {"trash ": 1.0}, set())
    assert around == {"a b trash", "b trash", "can trash", "can trash can", "trash can"}
    assert toxicity.phrases_around("trash can", {"trash": 1.0}, {"trash"}) == set()
