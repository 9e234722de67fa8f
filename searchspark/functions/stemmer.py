"""Word stems for English and Russian: the rules of the published Snowball algorithms in short.

Endings are data; a few steps take the longest that fits. Callers may pass their own function.
"""

from __future__ import annotations

import re

# Endings of the Russian algorithm, by class.
_GERUND = (("вшись", "вши", "в"), ("ившись", "ывшись", "ивши", "ывши", "ив", "ыв"))
_ADJECTIVE = (
    "ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "его", "ого", "ему", "ому",
    "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею",
)
_PARTICIPLE = (("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ"))
_VERB = (
    ("ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно"),
    (
        "ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло",
        "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю",
    ),
)
_NOUN = (
    "а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям",
    "ием", "ем", "ам", "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я",
)
_RUSSIAN_VOWELS = "аеиоуыэюя"


def _cut(word: str, start: int, free: tuple[str, ...], after: tuple[str, ...] = ()) -> str | None:
    """word without the longest ending that lies at or after start; endings in after must follow а or я."""
    for e in sorted({*free, *after}, key=len, reverse=True):
        at = len(word) - len(e)
        if word.endswith(e) and at >= start and (e in free or (at - 1 >= start and word[at - 1] in "ая")):
            return word[:at]
    return None


def russian(word: str) -> str:
    """Stem of a Russian word in lower case."""
    word = word.replace("ё", "е")
    vowel = next((i for i, c in enumerate(word) if c in _RUSSIAN_VOWELS), None)
    if vowel is None:
        return word
    rv = vowel + 1
    regions = [m.end() for m in re.finditer(f"[{_RUSSIAN_VOWELS}][^{_RUSSIAN_VOWELS}]", word)]
    r2 = next((e for e in regions[1:] if e > regions[0] + 1), len(word)) if regions else len(word)
    cut = _cut(word, rv, _GERUND[1], _GERUND[0])
    if cut is None:
        word = next((w for e in ("ся", "сь") if (w := _cut(word, rv, (e,))) is not None), word)
        adjective = _cut(word, rv, _ADJECTIVE)
        if adjective is not None:
            participle = _cut(adjective, rv, _PARTICIPLE[1], _PARTICIPLE[0])
            cut = adjective if participle is None else participle
        else:
            cut = _cut(word, rv, _VERB[1], _VERB[0])
            if cut is None:
                cut = _cut(word, rv, _NOUN)
    word = word if cut is None else cut
    word = word[:-1] if word.endswith("и") and len(word) > rv else word
    derived = _cut(word, r2, ("ост", "ость"))
    word = word if derived is None else derived
    superlative = _cut(word, rv, ("ейш", "ейше"))
    if superlative is not None:
        word = superlative
    if word.endswith("нн") and len(word) - 1 >= rv:
        return word[:-1]
    return word[:-1] if word.endswith("ь") and len(word) > rv else word


# Suffixes of the English algorithm and what they become.
_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful",
    "lessli": "less",
}
_STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize",
)
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
}
_INVARIANT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
_AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_V = "aeiouy"


def _after_pair(word: str, start: int) -> int:
    m = re.compile(f"[{_V}][^{_V}]").search(word, start)
    return m.end() if m else len(word)


def _short_end(word: str) -> bool:
    return bool(re.search(f"(^[{_V}][^{_V}]$)|([^{_V}][{_V}][^{_V}wxY]$)", word))


def english(word: str) -> str:
    """Stem of an English word in lower case."""
    if len(word) <= 2 or word in _INVARIANT:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = re.sub(f"(^y|(?<=[{_V}])y)", "Y", word.lstrip("'"))
    head = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = head if head is not None else _after_pair(w, 0)
    r2 = _after_pair(w, r1)
    vowel_in = lambda s: any(c in _V for c in s)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and vowel_in(w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    ending = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(e)), "")
    base = w[: len(w) - len(ending)]
    if ending in ("eedly", "eed"):
        w = base + "ee" if len(base) >= r1 else w
    elif ending and vowel_in(base):
        if base.endswith(("at", "bl", "iz")):
            w = base + "e"
        elif base.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = base[:-1]
        else:
            w = base + "e" if r1 >= len(base) and _short_end(base) else base
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for e in sorted(_STEP_2, key=len, reverse=True):
        if w.endswith(e):
            w = w[: -len(e)] + _STEP_2[e] if len(w) - len(e) >= r1 else w
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w.endswith("logi"):
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for e in sorted((*_STEP_3, "ative"), key=len, reverse=True):
        if w.endswith(e):
            if e == "ative":
                w = w[:-5] if len(w) - 5 >= r2 else w
            elif len(w) - len(e) >= r1:
                w = w[: -len(e)] + _STEP_3[e]
            break
    for e in sorted((*_STEP_4, "ion"), key=len, reverse=True):
        if w.endswith(e):
            if len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(e)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stem(word: str) -> str:
    """English or, with a Cyrillic letter, Russian stem; a word whose stem would be empty stays."""
    return (russian if any("Ѐ" <= c <= "ԯ" for c in word) else english)(word) or word
