"""Stemmers of Italian, Portuguese, Romanian and (the older one of) Dutch, by the published descriptions of the Snowball project."""

from __future__ import annotations

from collections.abc import Callable

from .snowball import _longest, _region


def _regions(w: str, v: set[str]) -> tuple[int, int, int]:
    """Where RV, R1 and R2 begin."""
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
    return rv, r1, r2


def _within(w: str, endings, at: int) -> str:
    """The longest of the endings that lies behind `at`."""
    return max((s for s in endings if w.endswith(s) and len(w) - len(s) >= at), key=len, default="")


def _cut(w: str, endings, at: int) -> str:
    """Without the longest ending, if it lies behind `at`."""
    s = _longest(w, endings)
    return w[: -len(s)] if s and len(w) - len(s) >= at else w


_ITALIAN_VOWELS = set("aeiouàèìòù")
_ITALIAN_PRONOUNS = "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene".split()
_ITALIAN_R2 = "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti".split()
_ITALIAN_VERBS = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò "
    "erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti "
    "ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
).split()


def _between(w: str, letters: str, v: set[str]) -> str:
    """Letters between vowels in upper case, from left to right."""
    c = list(w)
    for i in range(1, len(c) - 1):
        if c[i] in letters and c[i - 1] in v and c[i + 1] in v:
            c[i] = c[i].upper()
    return "".join(c)


def italian(w: str) -> str:
    v = _ITALIAN_VOWELS
    w = w.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    w = _between(w, "ui", v)
    rv, r1, r2 = _regions(w, v)
    s = _longest(w, _ITALIAN_PRONOUNS)
    if s:
        stem = w[: -len(s)]
        t = _longest(stem, ("ando", "endo", "ar", "er", "ir"))
        if t and len(stem) - len(t) >= rv:
            w = stem if len(t) == 4 else stem + "e"
    before = w
    s = _longest(w, _ITALIAN_R2 + "azione azioni atore atori logia logie uzione uzioni usione usioni enza enze amento amenti imento imenti amente ità ivo ivi iva ive".split())
    at = len(w) - len(s)
    if s in ("amento", "amenti", "imento", "imenti"):
        w = w[:at] if at >= rv else w
    elif s == "amente":
        if at >= r1:
            w = w[:at]
            if w.endswith("iv"):
                w = _cut(_cut(w, ("iv",), r2), ("at",), r2) if len(w) - 2 >= r2 else w
            else:
                w = _cut(w, ("os", "ic", "abil"), r2)
    elif s and at >= r2:
        w = w[:at]
        if s in ("azione", "azioni", "atore", "atori"):
            w = _cut(w, ("ic",), r2)
        elif s in ("logia", "logie"):
            w += "log"
        elif s in ("uzione", "uzioni", "usione", "usioni"):
            w += "u"
        elif s in ("enza", "enze"):
            w += "ente"
        elif s == "ità":
            w = _cut(w, ("abil", "ic", "iv"), r2)
        elif s in ("ivo", "ivi", "iva", "ive"):
            shorter = _cut(w, ("at",), r2)
            w = _cut(shorter, ("ic",), r2) if shorter != w else w
    if w == before:
        s = _within(w, _ITALIAN_VERBS, rv)
        w = w[: len(w) - len(s)]
    if len(w) > rv and w[-1] in "aeioàèìò":
        w = w[:-1]
        if len(w) > rv and w.endswith("i"):
            w = w[:-1]
    if w.endswith(("ch", "gh")) and len(w) - 1 >= rv:
        w = w[:-1]
    return w.lower()


_PORTUGUESE_VOWELS = set("aeiouáéíóúâêô")
_PORTUGUESE_R2 = "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância".split()
_PORTUGUESE_VERBS = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo "
    "ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis "
    "áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos "
    "ermos irmos eu iu ou ira iras"
).split()


def portuguese(w: str) -> str:
    w = w.replace("ã", "a~").replace("õ", "o~")
    rv, r1, r2 = _regions(w, _PORTUGUESE_VOWELS)
    before = w
    s = _longest(w, _PORTUGUESE_R2 + "logia logias uça~o uço~es ência ências amente mente idade idades iva ivo ivas ivos ira iras".split())
    at = len(w) - len(s)
    if s == "amente":
        if at >= r1:
            w = w[:at]
            if w.endswith("iv"):
                w = _cut(_cut(w, ("iv",), r2), ("at",), r2) if len(w) - 2 >= r2 else w
            else:
                w = _cut(w, ("os", "ic", "ad"), r2)
    elif s in ("ira", "iras"):
        w = w[:at] + "ir" if at >= rv and w[:at].endswith("e") else w
    elif s and at >= r2:
        w = w[:at]
        if s in ("logia", "logias"):
            w += "log"
        elif s in ("uça~o", "uço~es"):
            w += "u"
        elif s in ("ência", "ências"):
            w += "ente"
        elif s == "mente":
            w = _cut(w, ("ante", "avel", "ível"), r2)
        elif s in ("idade", "idades"):
            w = _cut(w, ("abil", "ic", "iv"), r2)
        elif s in ("iva", "ivo", "ivas", "ivos"):
            w = _cut(w, ("at",), r2)
    if w == before:
        s = _within(w, _PORTUGUESE_VERBS, rv)
        w = w[: len(w) - len(s)]
    if w != before:
        if w.endswith("ci") and len(w) - 1 >= rv:
            w = w[:-1]
    else:
        w = _cut(w, "os a i o á í ó".split(), rv)
    if w.endswith(("e", "é", "ê")):
        if len(w) - 1 >= rv:
            w = w[:-1]
            if w.endswith(("gu", "ci")) and len(w) - 1 >= rv:
                w = w[:-1]
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


_ROMANIAN_VOWELS = set("aeiouâîă")
_ROMANIAN_0 = {"ul": "", "ului": "", "aua": "a", "ea": "e", "ele": "e", "elor": "e", "ii": "i", "iua": "i", "iei": "i", "iile": "i", "iilor": "i", "ilor": "i", "ile": "i", "atei": "at",
               "ație": "ați", "ația": "ați"}
_ROMANIAN_1 = {
    s: t
    for t, found in {
        "abil": "abilitate abilitati abilităi abilități",
        "ibil": "ibilitate",
        "iv": "ivitate ivitati ivităi ivități",
        "ic": "icitate icitati icităi icități icator icatori iciv iciva icive icivi icivă ical icala icale icali icală",
        "at": "ativ ativa ative ativi ativă ațiune atoare ator atori ătoare ător ători",
        "it": "itiv itiva itive itivi itivă ițiune itoare itor itori",
    }.items()
    for s in found.split()
}
_ROMANIAN_2 = (
    "at ata ată ati ate ut uta ută uti ute it ita ită iti ite ic ica ice ici ică abil abila abile abili abilă ibil ibila ibile ibili ibilă oasa oasă oase os osi oși ant anta ante anti antă ator atori itate "
    "itati ităi ități iv iva ive ivi ivă"
).split()
_ROMANIAN_IST = "ism isme ist ista iste isti istă iști".split()
_ROMANIAN_GUARDED = (
    "are ere ire âre ind ând indu ându eze ească ez ezi ează esc ești ește ăsc ăști ăște am ai au eam eai ea eați eau iam iai ia iați iau ui ași arăm arăți ară uși urăm urăți ură iși irăm irăți iră âi âși ârăm "
    "ârăți âră asem aseși ase aserăm aserăți aseră isem iseși ise iserăm iserăți iseră âsem âseși âse âserăm âserăți âseră usem useși use userăm userăți useră"
).split()
_ROMANIAN_FREE = "ăm ați em eți im iți âm âți seși serăm serăți seră sei se sesem seseși sese seserăm seserăți seseră".split()


def romanian(w: str) -> str:
    v = _ROMANIAN_VOWELS
    w = _between(w.translate(str.maketrans("şţ", "șț")), "ui", v)
    rv, r1, r2 = _regions(w, v)
    s = _longest(w, _ROMANIAN_0)
    at = len(w) - len(s)
    if s and at >= r1 and not (s == "ile" and w[:at].endswith("ab")):
        w = w[:at] + _ROMANIAN_0[s]
    changed = False
    while (s := _longest(w, _ROMANIAN_1)) and len(w) - len(s) >= r1:
        w, changed = w[: -len(s)] + _ROMANIAN_1[s], True
    s = _longest(w, [*_ROMANIAN_2, *_ROMANIAN_IST, "iune", "iuni"])
    at = len(w) - len(s)
    if s and at >= r2:
        if s in _ROMANIAN_IST:
            w, changed = w[:at] + "ist", True
        elif s not in ("iune", "iuni"):
            w, changed = w[:at], True
        elif w[:at].endswith("ț"):
            w, changed = w[: at - 1] + "t", True
    if not changed:
        s = _within(w, _ROMANIAN_GUARDED + _ROMANIAN_FREE, rv)
        at = len(w) - len(s)
        if s in _ROMANIAN_FREE or s and at > rv and (w[at - 1] not in v or w[at - 1] == "u"):
            w = w[:at]
    return _cut(w, ("a", "e", "i", "ie", "ă"), rv).lower()


_DUTCH_VOWELS = set("aeiouyè")


def dutch_porter(w: str) -> str:
    v = _DUTCH_VOWELS
    w = w.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    c = list(w)
    if c[:1] == ["y"]:
        c[0] = "Y"
    for i in range(1, len(c)):
        if c[i - 1] in v and (c[i] == "y" or c[i] == "i" and i + 1 < len(c) and c[i + 1] in v):
            c[i] = c[i].upper()
    w = "".join(c)
    first = _region(w, v)
    r1 = max(first, min(3, len(w)))
    r2 = _region(w, v, first) if first < len(w) else len(w)

    def undoubled(w: str) -> str:
        return w[:-1] if w.endswith(("kk", "dd", "tt")) else w

    def without_en(w: str, n: int) -> str:
        stem = w[:-n]
        return undoubled(stem) if len(stem) >= r1 and stem and stem[-1] not in v and not stem.endswith("gem") else w

    def without_e(w: str) -> str:
        return undoubled(w[:-1]) if w.endswith("e") and len(w) - 1 >= r1 and len(w) > 1 and w[-2] not in v else w

    s = _longest(w, ("heden", "en", "ene", "s", "se"))
    at = len(w) - len(s)
    if s == "heden":
        w = w[:at] + "heid" if at >= r1 else w
    elif s in ("en", "ene"):
        w = without_en(w, len(s))
    elif s and at >= r1 and at and w[at - 1] not in v and w[at - 1] != "j":
        w = w[:at]
    shorter = without_e(w)
    e_found, w = shorter != w, shorter
    if w.endswith("heid") and len(w) - 4 >= r2 and not w[:-4].endswith("c"):
        w = w[:-4]
        w = without_en(w, 2) if w.endswith("en") else w
    s = _longest(w, ("end", "ing", "ig", "lijk", "baar", "bar"))
    at = len(w) - len(s)
    if s and at >= r2:
        stem = w[:at]
        if s in ("end", "ing"):
            w = stem[:-2] if stem.endswith("ig") and at - 2 >= r2 and not stem[:-2].endswith("e") else undoubled(stem)
        elif s == "ig":
            w = w if stem.endswith("e") else stem
        elif s == "lijk":
            w = without_e(stem)
        elif s == "baar" or e_found:
            w = stem
    if len(w) > 3 and w[-1] not in v and w[-1] != "I" and w[-3:-1] in ("aa", "ee", "oo", "uu") and w[-4] not in v:
        w = w[:-2] + w[-1]
    return w.lower()


STEMMERS: dict[str, Callable[[str], str]] = {"italian": italian, "portuguese": portuguese, "romanian": romanian, "dutch_porter": dutch_porter}
