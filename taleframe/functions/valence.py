"""How a sentence feels, by the published rules of a valence lexicon: boosters, negation, capitals, contrast, punctuation."""

from __future__ import annotations

from itertools import pairwise
from math import sqrt
from string import punctuation

# Fixed values of the published rules.
LIFT, LOWER = 0.293, -0.293
CAPITALS, NEGATED = 0.733, -0.74
FADE = (1.0, 0.95, 0.9)
NORM = 15
RAISING = tuple(
    "absolutely amazingly awfully completely considerably decidedly deeply effing enormously entirely especially exceptionally extremely fabulously flipping flippin"
    " fricking frickin frigging friggin fully fucking greatly hella highly hugely incredibly intensely majorly more most particularly purely quite really remarkably"
    " so substantially thoroughly totally tremendously uber unbelievably unusually utterly very".split()
)
LOWERING = tuple("almost barely hardly kinda kindof kind-of less little marginally occasionally partly scarcely slightly somewhat sorta sortof sort-of".split())
NEGATIONS = tuple("cannot neither never none nope nor not nothing nowhere uhuh uh-uh without rarely seldom despite".split())
LOWERING_PAIRS = ("kind of", "sort of", "just enough")
SHORTENED = tuple("ai are ca could dare did does do had has have is might must need ought sha should was were wo would".split())

_BOOST = dict.fromkeys(RAISING, LIFT) | dict.fromkeys(LOWERING, LOWER)
_NOT = set(NEGATIONS) | {f"{s}nt" for s in SHORTENED} | {f"{s}n't" for s in SHORTENED}

#: A token lower-cased, whether it is in capitals, how much it boosts, whether it negates, its own valence, whether others near it ask for it.
Word = tuple[str, bool, float, bool, float, bool]
#: Words that take part in rules besides boosters and negations.
_ASKED = {"of", "enough", "least", "but"}


class Words(dict):
    """Token to Word under one lexicon, found out once while at most ``HELD`` tokens are kept."""

    HELD = 1 << 17

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> Word:
        """Punctuation around a token goes, but what would shrink to two characters or fewer stays as it is."""
        bare = token.strip(punctuation)
        word = token if len(bare) <= 2 else bare
        low = word.lower()
        boosts, negates = _BOOST.get(low, 0.0), low in _NOT or "n't" in low
        valence = 0.0 if boosts else self.lexicon.get(low, 0.0)
        if len(self) >= self.HELD:
            self.clear()
        found = self[token] = (low, word.isupper(), boosts, negates, valence, bool(boosts or negates or low in _ASKED))
        return found


def _boost(word: Word, valence: float, mixed: bool) -> float:
    by = word[2]
    if by and valence < 0:
        by = -by
    if by and word[1] and mixed:
        by += CAPITALS if valence > 0 else -CAPITALS
    return by


def _negation(words: list[Word], i: int, back: int, valence: float) -> float:
    """``valence`` of word ``i`` after the word ``back`` places before it had its say."""
    at, negates = words[i - back][0], words[i - back][3]
    if back > 1:
        between = [w[0] for w in words[i - back + 1 : i]]
        if at == "never" and ("so" in between or "this" in between):
            return valence * (1.5 if back == 2 else 1.25)
        if at == "without" and between[0] == "doubt":
            return valence
    return valence * NEGATED if negates else valence


def _one(words: list[Word], i: int, lexicon: dict[str, float], mixed: bool) -> float:
    low, loud, _, _, valence, _ = words[i]
    if not valence or (low == "kind" and i + 1 < len(words) and words[i + 1][0] == "of"):
        return 0.0
    if loud and mixed:
        valence += CAPITALS if valence > 0 else -CAPITALS
    if not any(w[5] for w in words[max(0, i - 3) : i]):
        return valence
    for back in range(1, min(i, 3) + 1):
        if words[i - back][0] not in lexicon:
            valence += _boost(words[i - back], valence, mixed) * FADE[back - 1]
            valence = _negation(words, i, back, valence)
    if i >= 3 and words[i - 3][0] not in lexicon:
        valence += LOWER * sum(f"{a[0]} {b[0]}" in LOWERING_PAIRS for a, b in pairwise(words[i - 3 : i]))
    if i and words[i - 1][0] == "least" and "least" not in lexicon and (i == 1 or words[i - 2][0] not in ("at", "very")):
        valence *= NEGATED
    return valence


def compound(text: str, lexicon: dict[str, float] | Words) -> float:
    """Between -1 and 1, four digits; 0 for a text without words of the lexicon (word to valence, about -4 to 4).

    Who judges many texts gives the lexicon as ``Words``, which are kept from text to text.
    """
    known = lexicon if isinstance(lexicon, Words) else Words(lexicon)
    lexicon = known.lexicon
    words = [known[t] for t in text.split()]
    if not words:
        return 0.0
    low, loud, _, _, each, asked = zip(*words, strict=True)
    mixed = 0 < sum(loud) < len(words)
    if any(asked):
        each = [_one(words, i, lexicon, mixed) if v else 0.0 for i, v in enumerate(each)]
        if "but" in low:
            turn = low.index("but")
            each = [v * 0.5 if i < turn else v * 1.5 if i > turn else v for i, v in enumerate(each)]
    elif mixed:
        each = [v + (CAPITALS if v > 0 else -CAPITALS) if v and up else v for v, up in zip(each, loud, strict=True)]
    total = sum(each)
    asks = text.count("?")
    stress = min(text.count("!"), 4) * 0.292 + (0.0 if asks < 2 else asks * 0.18 if asks < 4 else 0.96)
    total += stress if total > 0 else -stress if total < 0 else 0.0
    return max(-1.0, min(1.0, round(total / sqrt(total * total + NORM), 4)))
