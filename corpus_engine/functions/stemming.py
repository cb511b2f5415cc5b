"""The Snowball English stemmer (Porter2), applied to vocabularies, not to every token."""

from __future__ import annotations

import re

_V = "aeiouy"
_ODD = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}  # fixed values
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}  # fixed values
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}  # fixed values
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}  # fixed values
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")  # fixed values


def porter2(word: str) -> str:
    """The Snowball English stemmer, for lower-case ASCII words."""
    if word in _ODD:
        return _ODD[word]
    if len(word) < 3:
        return word
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    low = lambda s: bool(re.search(f"[{_V}]", s))
    region = re.compile(f"[{_V}][^{_V}]")

    def after(s: str, start: int) -> int:
        m = region.search(s, start)
        return m.end() if m else len(s)

    pre = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(pre) if pre else after(w, 0)
    r2 = after(w, r1)
    short_end = lambda s: bool(re.search(f"[^{_V}][{_V}][^{_V}wxY]$", s) or re.fullmatch(f"[{_V}][^{_V}]", s))
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and low(w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    if m := re.search(r"(eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search(r"(ingly|edly|ing|ed)$", w)) and low(w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif short_end(w) and r1 >= len(w):
            w += "e"
    if re.search(f".[^{_V}][yY]$", w):
        w = w[:-1] + "i"
    for end in sorted(_STEP2, key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + _STEP2[end]
            break
    else:
        if w.endswith("ogi"):
            w = w[:-1] if len(w) - 3 >= r1 and w.endswith("logi") else w
        elif w.endswith("li") and len(w) - 2 >= r1 and re.search(r"[cdeghkmnrt]li$", w):
            w = w[:-2]
    for end in sorted([*_STEP3, "ative"], key=len, reverse=True):
        if w.endswith(end):
            if end == "ative":
                w = w[:-5] if len(w) - 5 >= r2 else w
            elif len(w) - len(end) >= r1:
                w = w[: len(w) - len(end)] + _STEP3[end]
            break
    for end in _STEP4:
        if w.endswith(end):
            w = w[: -len(end)] if len(w) - len(end) >= r2 else w
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w.endswith("ll"):
        w = w[:-1]
    return w.replace("Y", "y")
