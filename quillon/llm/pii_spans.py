"""Labels of the sampled texts on which the tagger is trained besides the made-up sentences.

The patterns hold general formats only: any mailbox, international and national phones, identity numbers
by label or shape, street and post-box addresses, and a given name or initials beside a capitalised word.
Where the patterns cannot tell (a capitalised pair of unknown words), ``unsure`` marks the place, and windows
over it are left out of the training.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable

from quillon.llm.pii_made import DOMAINS, GIVEN, family, given, town

#: White space as it occurs in typeset text: blanks, ties, thin spaces, line ends with comment signs.
GAP = r"(?:(?:[ \t~]|\\[,; ]|\r?\n[ \t]*%*)+)"
_DOT = rf"(?:\.|{GAP}?[\[(]dot[\])]{GAP}?|{GAP}dot{GAP})"
_AT = rf"(?:@|\\string@|\\@|{GAP}?[\[({{]at[\])}}]{GAP}?|{GAP}at{GAP})"
_LOCAL = r"(?:\\\{[\w.,\\ -]+\\\}|[A-Za-z](?:[\w.+\-]|\\_)*)"
EMAIL = rf"(?i:(?<![\w.\\-]){_LOCAL}{_AT}(?:[\w-]+{_DOT})+[a-z]{{2,10}}(?![\w@]))"

_G = r"(?:[ ~.\-/]|\\,|\\ |\r?\n[ \t]*%*[ \t]*)"
_EXT = rf"(?:{_G}*(?:x|ext\.?){_G}*\d+)?"
PHONE = "|".join(
    (
        rf"\+1{_G}*\(?\d{{3}}\)?{_G}*\d{{3}}{_G}*\d{{4}}{_EXT}",
        rf"\+\d{{1,3}}(?:{_G}*\(0\))?(?:{_G}*\d){{7,11}}(?!\d)",
        rf"(?<![\d.])00{_G}\d{{2}}(?:{_G}*\d){{7,11}}(?!\d)",
        rf"(?<![\d\w])\(\d{{3}}\){_G}*\d{{3}}{_G}\d{{4}}{_EXT}",
        r"(?<![\d\w/.-])\d{3}(?:/\d{3}[.-]|-\d{3}-|\.\d{3}\.)\d{4}(?![\d/.-]\d)",
        rf"(?<![\d\w/.-])\d{{3}}-\d{{4}}{_EXT}(?![\d-])",
        rf"(?<![\d\w/.-])0\d{{3,4}}{_G}\d{{3}}{_G}?\d{{3}}(?![\d-])",
        rf"(?<![\d\w/.-])0\d{{2}}{_G}\d{{4}}{_G}\d{{4}}(?![\d-])",
    )
)
_ID_AFTER = rf"(?<![A-Za-z])(?:SSN|social{GAP}security(?:{GAP}n(?:o\.|umber))?|national{GAP}id|identity{GAP}card(?:{GAP}no\.)?|passport(?:{GAP}no\.)?|tax{GAP}id|patient{GAP}record)(?:\\ |{GAP}|:{GAP}?)"
ID_LABELLED = rf"(?i:{_ID_AFTER})(?P<id>[A-Z]{{0,3}}-?\d[\d./ ~-]*(?:\r?\n[ \t]*%*[ \t]*\d+)?\d)"
ID_BARE = "|".join(
    (
        rf"(?<![\w-])[A-Z]{{2}}{_G}\d\d{_G}\d\d{_G}\d\d{_G}[A-D]\b",
        r"(?<![\w.-])\d{6}[-+A]\d{3}[A-Z]\b",
        r"(?<![\w./-])\d{3}-\d\d-\d{4}(?![\w-])",
        rf"(?<![\w.-])\d{{9}}(?={GAP}\(social)",
        r"\bMRN-?\d{8}\b",
    )
)

_CAP = r"(?:[A-ZÀ-Þ](?:[a-zß-ÿ]|\\[\"'`^~]\{?[a-z]\}?)+)"
_TOWN = rf"{_CAP}(?:-{_CAP})?"
_ROAD = rf"{_CAP}{GAP}(?:Street|Road|Lane|Close|Avenue|Crescent|Boulevard|St\.|Ave\.|Rd\.|Ln\.|Blvd\.?|Drive|Way|Court|Place|Square|Terrace)"
_DE = rf"(?:(?:Am|An{GAP}der|Im|Alte|Alter|Zum){GAP})?{_CAP}(?:\.|-{_CAP})?"
_FR = rf"(?:rue|avenue|bd\.|boulevard|chemin|place|quai|all[ée]e){GAP}(?:(?:de|du|des|la|le|l'){GAP}?)*{_CAP}"
ADDRESS = "|".join(
    (
        rf"P\.?{GAP}?O\.?{GAP}Box{GAP}\d+,{GAP}\d{{4,5}}{GAP}{_TOWN}",
        rf"(?:(?:Apt\.|Flat|Suite|Unit){GAP}\d+,{GAP})?\d+{GAP}{_ROAD},?(?:{GAP}(?:Apt\.|Flat|Suite|Unit){GAP}\d+,)?{GAP}?(?:\\\\{GAP}?\d{{5}}{GAP})?{_TOWN}(?:{GAP}\d{{5}})?",
        rf"\d+,?{GAP}{_FR},{GAP}\d{{5}}{GAP}{_TOWN}",
        rf"(?<![\w\\]){_DE}{GAP}\d+,{GAP}(?:D-)?\d{{5}}{GAP}{_TOWN}",
    )
)

_ACC = r"(?:[a-zß-ÿ]|\\[\"'`^~]\{?[a-z]\}?)"
_SUR1 = rf"[A-ZÀ-Þ]{_ACC}{{2,14}}"
_SUR = rf"{_SUR1}(?:-{_SUR1})?"
_SUR_UP1 = r"(?:[A-ZÀ-Þ]|\\[\"'`^~]\{?[A-Za-z]\}?){3,14}"
_SUR_UP = rf"{_SUR_UP1}(?:-{_SUR_UP1})?"
_GIV = rf"(?<![\w\\])(?:{'|'.join(sorted(GIVEN, key=len, reverse=True))})(?!\w)"
_GIV_UP = rf"(?<![\w\\])(?:{'|'.join(sorted((g.upper() for g in GIVEN), key=len, reverse=True))})(?!\w)"
_INI = r"(?<![\w.])[A-Z]\."
_SP = rf"(?:{GAP}|\\ )"
NAME = "|".join(
    (
        rf"(?:{_GIV}|{_INI})(?:{_SP}?[A-Z]\.)*{_SP}?{_SUR}",
        rf"{_GIV_UP}(?:{_SP}?[A-Z]\.)*{_SP}{_SUR_UP}",
        rf"(?<![\w\\-]){_SUR},{GAP}(?:{_GIV}|[A-Z]\.)(?:{_SP}?[A-Z]\.)*(?![\w])",
        rf"(?<![\w\\-]){_SUR_UP},{GAP}{_GIV_UP}",
    )
)
_PAIR = re.compile(rf"(?<![\w\\]){_CAP}(?:{_SP}[A-Z]\.)?(?:,?{_SP}){_CAP}|(?<![\w\\])[A-ZÀ-Þ]{{3,}},?{_SP}[A-ZÀ-Þ]{{3,}}")

_RULES = (("email", re.compile(EMAIL)), ("address", re.compile(ADDRESS)), ("id_number", re.compile(ID_LABELLED)), ("id_number", re.compile(ID_BARE)), ("phone", re.compile(PHONE)), ("name", re.compile(NAME)))
_TOP = {d.rpartition(".")[2] for d in DOMAINS}
_BIB = re.compile(r"\\begin\{thebibliography\}.*?(?:\\end\{thebibliography\}|\Z)", re.S)
_WORD = re.compile(r"[^\W\d_]+")
_PROSE = re.compile(r"(?<=[ \n])[^\W\d_]+(?=[ \n,]|[.;:]\s)")
#: Words in front of a number that make it none of a person.
_OTHER_NUMBER = re.compile(r"(?:ISBN|ISSN|ORCID|doi:?|DOI:?|grant|run|arXiv:?|no\.|runs?)[\s~%\\]*$")


def common_words(texts: Iterable[str], least: int = 5) -> set[str]:
    """Words that a sample of texts writes in small letters: their capitalised form is no name by itself."""
    seen: dict[str, int] = {}
    for text in texts:
        for w in set(_PROSE.findall(text)):
            if w.islower():
                seen[w] = seen.get(w, 0) + 1
    return {w for w, n in seen.items() if n >= least}


def label(text: str, common: set[str]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Spans (start, end, kind) without overlaps, earlier rules first, and the places that are unsure."""
    bib = [m.span() for m in _BIB.finditer(text)]
    listed = lambda a: any(x <= a < y for x, y in bib) and not text[text.rfind("\n", 0, a) + 1 : a].lstrip().startswith("%")
    taken: list[tuple[int, int, str]] = []
    for kind, rule in _RULES:
        for m in rule.finditer(text):
            a, b = m.span("id") if "id" in rule.groupindex else m.span()
            if kind == "name" and (listed(a) or all(w.lower() in common for w in _WORD.findall(m.group()) if len(w) > 2)):
                continue
            if kind == "email" and "@" not in m.group() and _WORD.findall(m.group())[-1].lower() not in _TOP:
                continue
            if kind == "phone" and _OTHER_NUMBER.search(text, max(0, a - 12), a):
                continue
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, kind))
    taken.sort()
    unsure = []
    for m in _PAIR.finditer(text):
        a, b = m.span()
        words = [w for w in _WORD.findall(m.group()) if len(w) > 1]
        if any(w.lower() in common or w in _KNOWN_OTHER for w in words) or listed(a):
            continue
        if all(b <= x or a >= y for x, y, _ in taken):
            unsure.append((a, b))
    return taken, unsure


#: Capitalised words of institutes and the like; a pair with one of them is no person.
_KNOWN_OTHER = frozenset("University Laboratory Institute Department School Academy Faculty Monte Carlo Street Road Lane Avenue Close Crescent Fig Sec Eq Table Section Local Variables Top Lower Left Right Das Die Der Wir Für Nach Nous Pour Selon Para Las Los La El Le Les The ISSN ISBN ORCID TODO SSN MRN Ref Unlike Following Applied Earth".split())


def varied(text: str, spans: list[tuple[int, int, str]], unsure: list[tuple[int, int]], rng: random.Random, share: float = 0.5) -> tuple[str, list[tuple[int, int, str]], list[tuple[int, int]]]:
    """The text with a share of the words in names and towns replaced by other ones, and the moved spans."""
    marks = sorted([(a, b, k) for a, b, k in spans] + [(a, b, "") for a, b in unsure])
    out, moved, gone, at, size = [], [], [], 0, 0
    for a, b, kind in marks:
        piece = text[a:b]
        if kind == "name" and rng.random() < share:
            piece = re.sub(r"[A-Z][a-z]{2,}", lambda m: (given(rng) if m.group() in GIVEN else family(rng)) if rng.random() < 0.8 else m.group(), piece)
        elif kind == "address" and rng.random() < share:
            piece = re.sub(r"[A-Z][a-z]{3,}$", lambda m: town(rng), piece)
        out += [text[at:a], piece]
        size += a - at
        (moved.append((size, size + len(piece), kind)) if kind else gone.append((size, size + len(piece))))
        size += len(piece)
        at = b
    out.append(text[at:])
    return "".join(out), moved, gone

