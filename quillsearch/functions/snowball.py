"""Stemmers of further languages, by the published descriptions of the Snowball project."""

from __future__ import annotations

from collections.abc import Callable

_ENGLISH_VOWELS = set("aeiouy")
_ENGLISH_WORDS = {"skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
                  "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_ENGLISH_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_ENGLISH_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al",
              "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful",
              "lessli": "less", "li": ""}
_ENGLISH_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_ENGLISH_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def _region(w: str, vowels: set[str], at: int = 0) -> int:
    """Where what follows the first non-vowel behind a vowel begins."""
    for i in range(at + 1, len(w)):
        if w[i] not in vowels and w[i - 1] in vowels:
            return i + 1
    return len(w)


def _longest(w: str, suffixes) -> str:
    return max((s for s in suffixes if w.endswith(s)), key=len, default="")


def _english_short_end(w: str) -> bool:
    v = _ENGLISH_VOWELS
    if len(w) == 2:
        return w[0] in v and w[1] not in v
    return len(w) >= 3 and w[-3] not in v and w[-2] in v and w[-1] not in v and w[-1] not in "wxY"


def english(w: str) -> str:
    if len(w) <= 2:
        return w
    w = w.replace("’", "'").replace("‘", "'").replace("‛", "'").removeprefix("'")
    if w in _ENGLISH_WORDS:
        return _ENGLISH_WORDS[w]
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _ENGLISH_VOWELS) else c for i, c in enumerate(w))
    v = _ENGLISH_VOWELS
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), _region(w, v))
    r2 = _region(w, v, r1) if r1 < len(w) else len(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in v for c in w[:-2]):
        w = w[:-1]
    if w in _ENGLISH_KEPT:
        return w.lower()
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and any(c in v for c in w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif r1 >= len(w) and _english_short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in v:
        w = w[:-1] + "i"
    s = _longest(w, _ENGLISH_2)
    if s and len(w) - len(s) >= r1:
        stem = w[: -len(s)]
        if s == "ogi":
            w = stem + "og" if stem.endswith("l") else w
        elif s == "li":
            w = stem if stem[-1:] and stem[-1] in "cdeghkmnrt" else w
        else:
            w = stem + _ENGLISH_2[s]
    s = _longest(w, _ENGLISH_3)
    if s and len(w) - len(s) >= r1 and (s != "ative" or len(w) - len(s) >= r2):
        w = w[: -len(s)] + _ENGLISH_3[s]
    s = _longest(w, _ENGLISH_4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _english_short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def german(w: str) -> str:
    v = set("aeiouyäöü")
    w = w.replace("ß", "ss")
    w = "".join(c.upper() if c in "uy" and 0 < i < len(w) - 1 and w[i - 1] in v and w[i + 1] in v else c for i, c in enumerate(w))
    first = _region(w, v)
    r2 = _region(w, v, first) if first < len(w) else len(w)
    r1 = max(3, first)
    s = _longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if s and len(w) - len(s) >= r1:
        if s != "s" or w[: -len(s)].endswith(tuple("bdfghklmnrt")):
            w = w[: -len(s)]
            if s in ("e", "en", "es") and w.endswith("niss"):
                w = w[:-1]
    s = _longest(w, ("en", "er", "est", "st"))
    if s and len(w) - len(s) >= r1 and (s != "st" or len(w) >= 6 and w[: -len(s)].endswith(tuple("bdfghklmnt"))):
        w = w[: -len(s)]
    s = _longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if s and len(w) - len(s) >= r2:
        stem = w[: -len(s)]
        if s in ("end", "ung"):
            w = stem
            if w.endswith("ig") and not w.endswith("eig") and len(w) - 2 >= r2:
                w = w[:-2]
        elif s in ("ig", "ik", "isch"):
            w = stem if not stem.endswith("e") else w
        elif s in ("lich", "heit"):
            w = stem
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = stem
            t = _longest(w, ("lich", "ig"))
            if t and len(w) - len(t) >= r2:
                w = w[: -len(t)]
    return w.lower().translate(str.maketrans("äöü", "aou"))


_RUSSIAN_VOWELS = set("аеиоуыэюя")
_RUSSIAN_GERUND = ("в", "вши", "вшись"), ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись")
_RUSSIAN_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
_RUSSIAN_PARTICIPLE = "ем нн вш ющ щ".split(), "ивш ывш ующ".split()
_RUSSIAN_VERB = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(), "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
_RUSSIAN_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def _after_a(w: str, rv: int, plain, free) -> str:
    """The longest ending in RV, of which the first kind needs а or я before it."""
    found = [s for s in free if w.endswith(s) and len(w) - len(s) >= rv] + [s for s in plain if w.endswith(s) and len(w) - len(s) > rv and w[-len(s) - 1] in "ая"]
    return max(found, key=len, default="")


def russian(w: str) -> str:
    w = w.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(w) if c in _RUSSIAN_VOWELS), len(w))
    r1 = _region(w, _RUSSIAN_VOWELS)
    r2 = _region(w, _RUSSIAN_VOWELS, r1) if r1 < len(w) else len(w)

    def ends(endings) -> str:
        return max((s for s in endings if w.endswith(s) and len(w) - len(s) >= rv), key=len, default="")

    def cut(s: str) -> bool:
        nonlocal w
        w = w[: -len(s)] if s else w
        return bool(s)

    if not cut(_after_a(w, rv, *_RUSSIAN_GERUND)):
        cut(ends(("ся", "сь")))
        if cut(ends(_RUSSIAN_ADJECTIVE)):
            cut(_after_a(w, rv, *_RUSSIAN_PARTICIPLE))
        elif not cut(_after_a(w, rv, *_RUSSIAN_VERB)):
            cut(ends(_RUSSIAN_NOUN))
    cut(ends(("и",)))
    for s in ("ость", "ост"):
        if w.endswith(s) and len(w) - len(s) >= max(rv, r2):
            w = w[: -len(s)]
            break
    if w.endswith("нн") and len(w) - 1 > rv:
        return w[:-1]
    if cut(ends(("ейше", "ейш"))):
        return w[:-1] if w.endswith("нн") else w
    cut(ends(("ь",)))
    return w


_SPANISH_VOWELS = set("aeiouáéíóúü")
_PLAIN = str.maketrans("áéíóú", "aeiou")


def spanish(w: str) -> str:
    v = _SPANISH_VOWELS
    r1 = _region(w, v)
    r2 = _region(w, v, r1) if r1 < len(w) else len(w)
    rv = len(w)
    if len(w) > 2:
        if w[1] not in v:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] in v), len(w))
        elif w[0] in v:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] not in v), len(w))
        else:
            rv = 3

    def ends(endings, at: int) -> str:
        s = _longest(w, endings)
        return s if s and len(w) - len(s) >= at else ""

    s = ends("me se sela selo selas selos la le lo las les los nos".split(), rv)
    if s:
        stem = w[: -len(s)]
        t = _longest(stem, "iéndo ándo ár ér ír ando iendo ar er ir yendo".split())
        if t and len(stem) - len(t) >= rv and (t != "yendo" or stem.endswith("uyendo")):
            w = stem[: -len(t)] + t.translate(_PLAIN)
    before = w
    s = _longest(w, "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos adora ador ación adoras adores aciones ante antes ancia ancias logía logías ución uciones encia encias amente mente idad idades iva ivo ivas ivos".split())
    at = len(w) - len(s)
    if s in ("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias"):
        if at >= r2:
            w = w[:at]
            w = w[:-2] if w.endswith("ic") and len(w) - 2 >= r2 else w
    elif s in ("logía", "logías"):
        w = w[:at] + "log" if at >= r2 else w
    elif s in ("ución", "uciones"):
        w = w[:at] + "u" if at >= r2 else w
    elif s in ("encia", "encias"):
        w = w[:at] + "ente" if at >= r2 else w
    elif s == "amente":
        if at >= r1:
            w = w[:at]
            if w.endswith("iv") and len(w) - 2 >= r2:
                w = w[:-2]
                w = w[:-2] if w.endswith("at") and len(w) - 2 >= r2 else w
            elif w.endswith(("os", "ic", "ad")) and len(w) - 2 >= r2:
                w = w[:-2]
    elif s == "mente":
        if at >= r2:
            w = w[:at]
            t = _longest(w, ("ante", "able", "ible"))
            w = w[: -len(t)] if t and len(w) - len(t) >= r2 else w
    elif s in ("idad", "idades"):
        if at >= r2:
            w = w[:at]
            t = _longest(w, ("abil", "ic", "iv"))
            w = w[: -len(t)] if t and len(w) - len(t) >= r2 else w
    elif s in ("iva", "ivo", "ivas", "ivos"):
        if at >= r2:
            w = w[:at]
            w = w[:-2] if w.endswith("at") and len(w) - 2 >= r2 else w
    elif s and at >= r2:
        w = w[:at]
    if w == before:
        s = ends("ya ye yan yen yeron yendo yo yó yas yes yais yamos".split(), rv)
        if s and w[: -len(s)].endswith("u"):
            w = w[: -len(s)]
        else:
            strong = "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos".split()
            weak = "en es éis emos".split()
            s = max((x for x in strong + weak if w.endswith(x) and len(w) - len(x) >= rv), key=len, default="")
            if s:
                w = w[: -len(s)]
                if s in weak and w.endswith("gu") and len(w) - 1 >= rv:
                    w = w[:-1]
    s = ends("os a o á í ó".split(), rv)
    if s:
        w = w[: -len(s)]
    elif ends(("e", "é"), rv):
        w = w[:-1]
        if w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_PLAIN)


STEMMERS: dict[str, Callable[[str], str]] = {"english": english, "german": german, "russian": russian, "spanish": spanish}


def _suffix(w: str, r1: int, endings) -> str:
    return max((s for s in endings if w.endswith(s) and len(w) - len(s) >= r1), key=len, default="")


def _north(w: str, vowels: set[str]) -> int:
    return max(3, _region(w, vowels))


def swedish(w: str) -> str:
    r1 = _north(w, set("aeiouyäåö"))
    s = _suffix(w, r1, "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast s".split())
    if s == "s":
        w = w[:-1] if w[:-1].endswith(tuple("bcdfghjklmnoprtvy")) else w
    elif s:
        w = w[: -len(s)]
    if _suffix(w, r1, ("dd", "gd", "nn", "dt", "gt", "kt", "tt")):
        w = w[:-1]
    s = _suffix(w, r1, ("lig", "ig", "els", "löst", "fullt"))
    return w[:-1] if s in ("löst", "fullt") else w[: -len(s)] if s else w


def norwegian(w: str) -> str:
    v = set("aeiouyæåø")
    r1 = _north(w, v)
    s = _suffix(w, r1, "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast s erte ert".split())
    if s == "s":
        before = w[:-1]
        w = before if before.endswith(tuple("bcdfghjlmnoprtvyz")) or before.endswith("k") and before[-2:-1] not in v else w
    elif s in ("erte", "ert"):
        w = w[: -len(s)] + "er"
    elif s:
        w = w[: -len(s)]
    if _suffix(w, r1, ("dt", "vt")):
        w = w[:-1]
    s = _suffix(w, r1, "leg eleg ig eig lig elig els lov elov slov hetslov".split())
    return w[: -len(s)] if s else w


def danish(w: str) -> str:
    r1 = _north(w, set("aeiouyæåø"))
    s = _suffix(w, r1, "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret s".split())
    if s == "s":
        w = w[:-1] if w[:-1].endswith(tuple("abcdfghjklmnoprtvyzå")) else w
    elif s:
        w = w[: -len(s)]

    def ends_twice(w: str) -> str:
        return w[:-1] if _suffix(w, r1, ("gd", "dt", "gt", "kt")) else w

    w = ends_twice(w)
    if w.endswith("igst"):
        w = w[:-2]
    s = _suffix(w, r1, ("ig", "lig", "elig", "els", "løst"))
    if s == "løst":
        w = w[:-1]
    elif s:
        w = ends_twice(w[: -len(s)])
    if len(w) > r1 and w[-1:] == w[-2:-1] and w[-1] not in "aeiouyæåø":
        w = w[:-1]
    return w


STEMMERS |= {"swedish": swedish, "norwegian": norwegian, "danish": danish}


_FRENCH_VOWELS = set("aeiouyâàëéêèïîôûù")
_FRENCH_1 = (
    "ance iqUe isme able iste eux ances iqUes ismes ables istes atrice ateur ation atrices ateurs ations logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux "
    "euse euses issement issements amment emment ment ments"
).split()
_FRENCH_2A = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
_FRENCH_2B = "ions é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FRENCH_2C = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def _french_marked(w: str) -> str:
    out = list(w)
    v = _FRENCH_VOWELS
    for i, c in enumerate(w):
        before, after = w[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else ""
        if c in "ui" and before in v and after in v and before and after or c == "u" and before == "q":
            out[i] = c.upper()
        elif c == "y" and (before and before in v or after and after in v):
            out[i] = "Y"
    return "".join(out)


def french(word: str) -> str:
    v = _FRENCH_VOWELS
    w = _french_marked(word)
    if len(w) > 1 and w[0] in v and w[1] in v or w.startswith(("par", "col", "tap")):
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in v), len(w))
    r1 = _region(w, v)
    r2 = _region(w, v, r1) if r1 < len(w) else len(w)

    def drop(endings: dict[str, str]) -> None:
        """Takes an ending off if it is in R2; if not, puts what is given in its place."""
        nonlocal w
        s = _longest(w, endings)
        if s:
            w = w[: -len(s)] if len(w) - len(s) >= r2 else w[: -len(s)] + endings[s]

    begun, again = w, False
    s = _longest(w, _FRENCH_1)
    at = len(w) - len(s)
    if s in ("atrice", "ateur", "ation", "atrices", "ateurs", "ations"):
        if at >= r2:
            w = w[:at]
            drop({"ic": "iqU"})
    elif s in ("logie", "logies"):
        w = w[:at] + "log" if at >= r2 else w
    elif s in ("usion", "ution", "usions", "utions"):
        w = w[:at] + "u" if at >= r2 else w
    elif s in ("ence", "ences"):
        w = w[:at] + "ent" if at >= r2 else w
    elif s in ("ement", "ements"):
        if at >= rv:
            w = w[:at]
            if w.endswith("iv"):
                if len(w) - 2 >= r2:
                    w = w[:-2]
                    drop({"at": "at"})
            elif w.endswith("eus"):
                w = w[:-3] if len(w) - 3 >= r2 else w[:-1] + "x" if len(w) - 3 >= r1 else w
            elif w.endswith(("abl", "iqU")):
                w = w[:-3] if len(w) - 3 >= r2 else w
            elif w.endswith(("ièr", "Ièr")) and len(w) - 3 >= rv:
                w = w[:-3] + "i"
    elif s in ("ité", "ités"):
        if at >= r2:
            w = w[:at]
            drop({"abil": "abl", "ic": "iqU", "iv": "iv"})
    elif s in ("if", "ive", "ifs", "ives"):
        if at >= r2:
            w = w[:at]
            if w.endswith("at") and len(w) - 2 >= r2:
                w = w[:-2]
                drop({"ic": "iqU"})
    elif s == "eaux":
        w = w[:-1]
    elif s == "aux":
        w = w[:at] + "al" if at >= r1 else w
    elif s in ("euse", "euses"):
        w = w[:at] if at >= r2 else w[:at] + "eux" if at >= r1 else w
    elif s in ("issement", "issements"):
        w = w[:at] if at >= r1 and at and w[at - 1] not in v else w
    elif s in ("amment", "emment"):
        if at >= rv:
            w, again = w[:at] + ("ant" if s == "amment" else "ent"), True
    elif s in ("ment", "ments"):
        if at - 1 >= rv and w[at - 1] in v:
            w, again = w[:at], True
    elif s and at >= r2:
        w = w[:at]
    changed = w != begun
    if not changed or again:
        before = w
        s = _suffix(w, rv, _FRENCH_2A)
        if s and len(w) - len(s) - 1 >= rv and w[len(w) - len(s) - 1] not in v:
            w = w[: -len(s)]
        if w == before:
            s = _suffix(w, rv, _FRENCH_2B + _FRENCH_2C)
            if s == "ions":
                w = w[:-4] if len(w) - 4 >= r2 else w
            elif s:
                w = w[: -len(s)]
                if s in _FRENCH_2C and w.endswith("e") and len(w) - 1 >= rv:
                    w = w[:-1]
        changed = changed or w != before
    if changed:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        if len(w) > 1 and w.endswith("s") and w[-2] not in "aiouès":
            w = w[:-1]
        s = _suffix(w, rv, ("ion", "ier", "ière", "Ier", "Ière", "e"))
        if s == "ion":
            w = w[:-3] if len(w) - 3 >= r2 and w[-4] in "st" and len(w) - 4 >= rv else w
        elif s == "e":
            w = w[:-1]
        elif s:
            w = w[: -len(s)] + "i"
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    i = len(w)
    while i and w[i - 1] not in v:
        i -= 1
    if 0 < i < len(w) and w[i - 1] in "éè":
        w = w[: i - 1] + "e" + w[i:]
    return w.lower()


STEMMERS |= {"french": french}
