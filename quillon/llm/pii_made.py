"""Made-up labelled sentences to train the tagger of personal information.

Every piece is generated: names from common given names, common family names and syllables, mailboxes over
public top-level domains, phones by national plans, identity numbers by the formats of several countries,
streets in several orders. Items stand in sentences of five languages beside look-alikes that are no cases.
In a template ``{name}`` and the like mark items, ``{-grant}`` and the like look-alikes.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable

#: Common given names of several languages.
GIVEN = """James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen
Daniel Nancy Matthew Lisa Mark Paul Steven Emily Andrew Laura George Helen Edward Ruth Brian Sharon Kevin Alice Simon Grace Henry Rose Peter Clara Victor June Dana Julia Eva
Hans Klaus Jürgen Stefan Wolfgang Ingrid Greta Helga Otto Emil Lars Nils Sven Johan Anders Tove Mikko Pekka Aino Marta Anna Zofia Piotr Pavel Jana Tomasz Olga Ivan Dmitri Viktor Natalia Elena
Jean Pierre Marie Claire Luc Hugo Camille Antoine Sophie Martin Mateo Carlos Carmen Maria José Luis Ana Ines Rosa Javier Diego Pablo Lucia Bruno Luca Marco Giulia Paolo Sofia Francesca Giovanni
Wei Li Ming Yan Hui Jun Yuki Aiko Kenji Hiroshi Haruka Min Ji Soo Thanh Linh Priya Ravi Anya Arjun Deepa Sanjay Sunita Anil Mira
Ahmed Fatima Omar Leila Karim Samir Nadia Yusuf Hassan Elif Mehmet Ayşe Amina Kofi Ama Olu Chidi Ngozi Thabo Maeve Sean Niamh Siobhan Rhys Gwen""".split()

#: Common family names of several languages.
FAMILY = """Smith Johnson Brown Jones Miller Davis Wilson Moore Taylor Anderson Jackson White Harris Clark Lewis Walker Hall Young Wright Scott Green Baker Adams Nelson Hill Campbell Mitchell Roberts Carter Phillips Evans Turner
Müller Schmidt Schneider Fischer Weber Wagner Becker Schulz Hoffmann Koch Richter Klein Wolf Schröder Neumann Krüger Braun Zimmermann Hartmann Lange Werner Krause Lehmann
Dubois Durand Leroy Moreau Laurent Lefebvre Michel Roux Fournier Girard Bonnet Lambert Fontaine Rousseau Rossi Russo Ferrari Esposito Bianchi Romano Colombo Ricci Greco Conti
Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Díaz Ruiz Silva Santos Oliveira Souza Pereira Novak Kowalski Nowak Wiśniewski Ivanov Petrov Sokolov Popov Horvat
Chen Liu Yang Huang Zhao Wu Zhou Xu Sun Ma Zhu Hu Guo Lin Luo Tanaka Suzuki Takahashi Watanabe Yamamoto Kobayashi Kim Park Choi Jung Tran Pham Hoang Singh Kumar Sharma Gupta Reddy
Khan Ali Hussein Haddad Demir Yılmaz Okafor Mensah Ndlovu Larsen Hansen Nilsson Lindqvist Virtanen Korhonen Murphy Kelly Walsh""".split()

#: Top-level domains, and those reserved for examples.
DOMAINS = "com org net edu gov info io ai eu uk de fr it es nl be ch at se no dk fi pl cz hu ro pt gr ie ru ua tr in cn jp kr tw hk sg au nz br mx ar cl za ng ke eg il ac.uk co.uk ac.jp co.jp edu.cn edu.au com.br ac.in gov.uk example example.com example.org example.net invalid test".split()

_ONSET = "b br bl c ch cl cr d dr f fl fr g gl gr h j k kl kr l m n p pl pr qu r s sch sh sk sl sn st str sw t th tr v vl w wh y z".split()
_CORE = "a e i o u y ai au ea ee ei ie io oa ou ö ü ä á é í ó å ø".split()
_CODA = ["", "", "", "b", "ck", "d", "f", "g", "k", "l", "ll", "m", "n", "nd", "ng", "nk", "nn", "nt", "p", "r", "rd", "rk", "rn", "rs", "rt", "s", "ss", "st", "t", "tt", "th", "x", "z"]
_ENDING = ["", "", "", "er", "son", "sen", "ski", "sky", "sk", "ska", "ov", "ova", "ev", "ic", "ich", "escu", "ez", "es", "ini", "elli", "etti", "ani", "ado", "aya", "ander", "ley", "ton", "man", "mann", "berg", "stein", "feld", "dal", "dahl", "holm", "holt", "strom", "ström", "wick", "wood", "well", "field", "moor", "oglu", "yan", "ian", "idis", "poulos", "enko", "uk", "ak", "ek", "ik", "ek", "ier", "eau", "ot", "is", "us", "nen", "la", "sson", "van", "vic", "mund", "nik", "ric"]
_TOWN_END = "ton ford burg berg stadt dorf heim haven mouth field wick by stein hausen ville court bridge pool well mere minster cester ham gate mont val brück feld halden kirchen bach au ingen port land worth leigh wood".split()
_PLACE_WORD = "Street Road Lane Avenue Crescent Boulevard Drive Way Court Place Square Terrace Close Gardens Row Hill Park Parade Alley Walk Grove St. Rd. Ln. Ave. Ave Blvd. Blvd Dr. Ct. St Rd".split()
_TREE = "Oak Maple Elm Cedar Pine Birch Willow Mill Station Church School King Queen Victoria High Bridge River Lake Garden Market Park North South West East Harbour Foundry Quarry Orchard Copper Larkspur Saffron Alder Castle Abbey Windmill Meadow Spring Forest Chapel Hill Main Second Fifth Pennsylvania Lincoln Washington".split()
_FIELD = "Physics Chemistry Optics Biology Mathematics Geology Medicine Statistics Astronomy Linguistics Informatics Economics Engineering Ecology Neuroscience History Philosophy".split()
_NOUN = "relation equation theorem lemma conjecture effect method transform kernel model test algorithm constant boundary operator spectrum bound inequality process".split()
_MONTHS = "January February March April May June July August September October November December".split()
_THING = "survey protocol ledger archive sample interview benchmark approach dataset committee meeting grant proposal manuscript laboratory workshop chapter translation measurement experiment".split()
_ADJ = "dense sparse global slow rapid quiet annual final second early careful magnetic thermal smooth random local complete brief open public".split()

_TEX = {"á": "\\'a", "é": "\\'e", "í": "\\'i", "ó": "\\'o", "ú": "\\'u", "ä": '\\"a', "ö": '\\"o', "ü": '\\"u', "å": "\\aa{}", "ø": "\\o{}", "ñ": "\\~n", "ç": "\\c{c}", "š": "\\v{s}", "ž": "\\v{z}", "č": "\\v{c}", "ł": "\\l{}", "ń": "\\'n", "ś": "\\'s"}
_PARTICLE = ["de", "van", "von", "de la", "van der", "del", "di", "da", "bin", "al", "dos", "ter", "zu"]


def syllable_word(r: random.Random, parts: tuple[int, int] = (1, 3), endings: list[str] | None = None) -> str:
    """A made-up capitalised word."""
    word = "".join(r.choice(_ONSET) + r.choice(_CORE) + r.choice(_CODA) for _ in range(r.randint(*parts)))
    if r.random() < 0.25:
        word = r.choice("aeiou") + r.choice(["", "l", "n", "r", "s"]) + word
    word = re.sub(r"[^\w]", "", word)[: r.randint(4, 9)] + r.choice(endings or [""])
    return word.capitalize()


def _tex(r: random.Random, word: str, share: float = 0.5) -> str:
    if r.random() > share:
        return word
    out = "".join(_TEX.get(c, c) for c in word)
    if out != word and r.random() < 0.4:
        out = re.sub(r"(\\[\"'`^~])([a-z])", r"\1{\2}", out)
    return out


def given(r: random.Random) -> str:
    if r.random() < 0.7:
        name = r.choice(GIVEN)
    else:
        name = syllable_word(r, (1, 2), ["", "a", "o", "e", "i", "ine", "ette", "us", "an", "ine", "as", "el", "ing"])[:8]
    if r.random() < 0.05:
        name += "-" + r.choice(GIVEN)
    return name


def family(r: random.Random) -> str:
    x = r.random()
    if x < 0.25:
        name = r.choice(FAMILY)
    else:
        name = syllable_word(r, (1, 2), _ENDING)
    if x > 0.96:
        name = r.choice(["O'", "Mc", "Mac", "D'", "Fitz", "De", "Van"]) + name
    if r.random() < 0.1:
        name += r.choice(["-", "-", "--"]) + (r.choice(FAMILY) if r.random() < 0.3 else syllable_word(r, (1, 2), _ENDING))
    if r.random() < 0.05:
        name = r.choice(_PARTICLE) + " " + name
    return name


def gap(r: random.Random) -> str:
    """White space as it occurs in typeset text."""
    x = r.random()
    return " " if x < 0.8 else "~" if x < 0.91 else "\n" if x < 0.95 else "\n% " if x < 0.965 else "\\ " if x < 0.975 else "\\," if x < 0.985 else "\r\n" if x < 0.99 else "  "


def initials(r: random.Random, most: int = 2) -> str:
    letters = [r.choice("ABCDEFGHIJKLMNOPRSTUVWXYZ") + "." for _ in range(r.randint(1, most))]
    return r.choice(["", " ", "~", "~"]).join(letters)


def name(r: random.Random) -> str:
    g, f = given(r), family(r)
    if r.random() < 0.25:
        g, f = _tex(r, g, 1), _tex(r, f, 1)
    x = r.random()
    between = gap(r)
    if x < 0.46:
        out = g + between + f
    elif x < 0.56:
        out = f"{g}{gap(r)}{initials(r, 1)}{between}{f}"
    elif x < 0.62:
        out = f"{g}{gap(r)}{given(r)}{between}{f}"
    elif x < 0.8:
        out = initials(r) + (between if r.random() < 0.9 else "") + f
    elif x < 0.9:
        out = f"{f},{between}{g}" + (f" {initials(r, 1)}" if r.random() < 0.15 else "")
    elif x < 0.95:
        out = f"{f},{between}{initials(r)}"
    elif x < 0.98:
        out = f"{f}{between}{g}"
    else:
        out = f"{f}{between}{initials(r, 1)}"
    if r.random() < 0.07 and "\\" not in out:
        out = out.upper()
    return out


_CITIES = "London Paris Berlin Madrid Rome Vienna Zurich Boston Chicago Houston Denver Seattle Atlanta Washington Toronto Sydney Mumbai Tokyo Dublin Oslo Lisbon Prague Warsaw Geneva Hamburg Lyon Leeds Bristol".split()


def town(r: random.Random) -> str:
    x = r.random()
    if x < 0.2:
        return r.choice(_CITIES)
    word = syllable_word(r, (1, 1), _TOWN_END)
    if x > 0.95:
        return r.choice(["New", "San", "Bad", "Saint", "Port", "Santa", "Great"]) + " " + word
    return word + (r.choice(["-sur-", "-am-", "-upon-", "-"]) + syllable_word(r, (1, 1)) if x > 0.92 else "")


def _domain(r: random.Random) -> str:
    host = r.choice([lambda: town(r).lower().replace(" ", ""), lambda: syllable_word(r, (1, 2)).lower(), lambda: r.choice(["gmail", "mail", "outlook", "proton", "company", "web"]), lambda: f"{town(r).lower().replace(' ', '')}-{r.choice(['uni', 'lab', 'inst'])}"])()
    host = host.translate(str.maketrans("öüäáéíóåø", "ouaaeioao")).replace("'", "")
    sub = r.choice(["", "", "", "cs.", "phys.", "mail.", "math.", "inst-opt.", "students.", "dept.", "ee.", "x."])
    return f"{sub}{host}.{r.choice(DOMAINS)}"


def _local(r: random.Random) -> str:
    f = re.sub(r"\W", "", family(r).split(" ")[-1]).lower()
    g = re.sub(r"\W", "", given(r)).lower()
    out = r.choice([f"{g}.{f}", f"{g}.{f}", f"{g[0]}{f}", f"{g}{r.randint(1, 99)}", f"{g}_{f}", f"{f}", f"{g}-{f}", f"{f}.{g[0]}", f"{g[0]}.{f}", "info", "contact", "office", f"{f}-lab", f"{f}{r.randint(1, 2020)}", f"{g}+{r.choice(['lists', 'x', 'news'])}"])
    out = out.translate(str.maketrans("öüäáéíóåøñçšžčłńśşı", "ouaaeioaoncszclnssi"))
    return out.upper() if r.random() < 0.04 else out.title() if r.random() < 0.04 else out


def email(r: random.Random) -> str:
    local, domain = _local(r), _domain(r)
    x = r.random()
    if x < 0.55:
        return f"{local}@{domain}"
    if x < 0.65:
        at = r.choice([" at ", " at ", "\nat "])
        return local + at + re.sub(r"\.", r.choice([" dot ", " dot ", "."]), domain)
    if x < 0.78:
        at = r.choice([" (at) ", "(at)", " [at] ", "[at]", " [at]\n", "[AT]", " AT ", "{at}"])
        return local + at + re.sub(r"\.", r.choice([" dot ", " (dot) ", "[dot]", " [dot] ", ".", "(dot)"]), domain)
    if x < 0.84:
        return local.replace("_", r"\_") + r.choice([r"\string@", r"\@"]) + domain
    if x < 0.88:
        return local.replace("_", r"\_") + "@" + domain
    people = ("," + r.choice(["", " "])).join(_local(r) for _ in range(r.randint(2, 4)))
    if x < 0.95:
        return r"\{" + people + r"\}@" + domain
    return "{" + people + "}@" + domain


def _fill(r: random.Random, shape: str) -> str:
    """# any digit, 9 a digit from 2, A a capital, _ a separator (one for the whole number)."""
    sep = r.choice([" ", " ", "-", ".", "~", "\\,"])
    put = {"#": lambda: r.choice("0123456789"), "9": lambda: r.choice("23456789"), "A": lambda: r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ"), "_": lambda: sep}
    return "".join(put[c]() if c in put else c for c in shape)


#: Shapes of phone numbers by national plan.
PHONES = """(9##) ###-####|(9##) ###-####|(9##)###-####|9##-###-####|9##.###.####|9##/###-####|9## ### ####|+1 9## ### ####|+1-9##-###-####|+1 (9##) ###-####|1-800-###-####|###-####|###-#### ext. ##|(9##) ###-#### ext. ###|9##-###-#### x###
+44_20_####_####|+44_####_######|+44 (0)20 #### ####|020_####_####|0####_######|0####_###_###|+49_##_########|+49 (0)## ##### ###|+49 (0)###/######|0##/########|0###_#######|+33_9_##_##_##_##|0#_##_##_##_##|01_##_##_##_##|+34_9##_###_###|9##_##_##_##|+39_0#_########|0#_####_####
+46_8_###_###_##|+46~#\\,###\\,###\\,##|+47_##_##_##_##|+45_##_##_##_##|+358_9_########|+41_##_###_##_##|+43_1_#######|+31_##_#######|+32_2_###_##_##|+48_##_###_##_##|+420_###_###_###|+7 (###) ###-##-##|+90_###_###_##_##|+91_#####_#####|+91-##-########|+86_1##_####_####|+86-10-########|+81_3_####_####|+81-##-####-####|+82-2-####-####|+55_##_#####-####|+61_2_####_####|+27_##_###_####|+234_###_###_####|+##############|00 ##_###_###_####|00_##_8_###_###_##|+############|+###########""".replace("\n", "|").split("|")

#: Labels of identity numbers, and shapes that go with any of them; "=" ties a shape to its own label.
LABELS = ["SSN", "SSN:", "SSN #", "social security number", "social security no.", "Social Security Number:", "national id", "national ID number", "National ID:", "identity card", "identity card no.", "ID card number", "passport", "passport no.", "passport number", "Passport No:", "passport:", "tax id", "tax ID number", "Tax ID:", "tax file number", "patient record", "patient record no.", "patient ID", "medical record number", "personal number", "Personalausweis Nr.", "Reisepass Nr.", "Steuer-ID", "Sozialversicherungsnummer", "Ausweisnummer", "numéro de sécurité sociale", "passeport n°", "carte d'identité n°", "DNI", "NIE", "número de pasaporte", "codice fiscale", "carta d'identità", "PESEL", "CPR", "BSN", "CPF", "PAN", "Aadhaar", "NHS number", "National Insurance number", "NI number", "driving licence no."]
IDS = """AAAAA######AA#AA|AA#######AA|A#########|##A######|###-##-####|###-##-####|### ## ####|### ## ####|#########|9##-##-####|9## ## ####|A########|AA#######|A#######|AA######|#########|A##A##A##|AAA######|AA ## ## ## A|AA## ## ## A|AA######A|AA_##_##_##_A|######-###A|######-####|########-####|######A###A|###.###.###-##|###.###.###-##|########A|########-A|A#######A|##_###_###_###|###########|###_###_###|###/###/#####|###/####/####|AAA-#######|AA-######|MRN-########|MRN########|MRN ########|P-######|#### #### ####|AAAAA####A|AAAAAA##A##A###A|# ## ## ## ### ### ##|#_##_##_##_###_###|##################|######|########|AAA#######|#####-####-#""".replace("\n", "|").split("|")
#: Shapes that are told without a label.
BARE = ["AA ## ## ## A", "QQ ## ## ## A", "######-###A", "######-###A", "######-###A", "9##-##-####", "###-##-####", "AA## ## ## A", "MRN-########", "######A###A", "AAAAAA##A##A###A", "AAAAA####A"]


def phone(r: random.Random) -> str:
    text = _fill(r, r.choice(PHONES))
    if " " in text and r.random() < 0.06:
        text = text.replace(" ", r.choice(["\n", "\n% ", "~"]), 1)
    if r.random() < 0.02:
        text += r.choice([" ext. ", " x", " ext "]) + str(r.randint(10, 999))
    return text


def _broken(r: random.Random, text: str) -> str:
    return text.replace(" ", r.choice(["\n", "\n% ", "~", "\n%% "]), 1) if " " in text and r.random() < 0.08 else text


def bare_id(r: random.Random) -> str:
    return _broken(r, _fill(r, r.choice(BARE)))


def some_id(r: random.Random) -> str:
    return _broken(r, _fill(r, r.choice(IDS)))


def address(r: random.Random) -> str:
    number = str(r.randint(1, 300) if r.random() < 0.85 else r.randint(300, 12000)) + (r.choice("abc") if r.random() < 0.04 else "")
    code, place = _fill(r, r.choice(["#####", "#####", "####"])), town(r)
    road = f"{r.choice(_TREE) if r.random() < 0.5 else syllable_word(r, (1, 2))}{gap(r)}{r.choice(_PLACE_WORD)}"
    end = r.choice([f", {place}", f", {place} {code}", f", {place}, {r.choice(['NY', 'CA', 'MA', 'TX', 'IL', 'WA'])} {_fill(r, '#####')}", rf" \\ {_fill(r, '#####')} {place}", f", {code} {place}", f", {place} {_fill(r, 'AA# #AA')}", f",\n{place}", f", {place} {_fill(r, '#####')}", rf" \\ {_fill(r, '#####')}{gap(r)}{place}"])
    x = r.random()
    if x < 0.4:
        flat = f"{r.choice(['Apt.', 'Flat', 'Suite', 'Unit'])} {r.randint(1, 40)}"
        y = r.random()
        if y < 0.12:
            return f"{flat}, {number}{gap(r)}{road}{end}"
        return f"{number}{gap(r)}{road}" + (f", {flat}" if y > 0.9 else "") + end
    if x < 0.52:
        return f"P.{r.choice(['', ' '])}O. Box{gap(r)}{r.randint(1, 9999)}, " + r.choice([f"{code} {place}", f"{place} {code}", f"{place}"])
    if x < 0.76:
        z = r.random()
        way = syllable_word(r, (1, 2)) if r.random() < 0.6 else r.choice(["Linden", "Bahnhof", "Haupt", "Schiller", "Garten", "Kirch", "Berg", "Mozart", "Stein", "Wald"])
        if z < 0.7:
            way += r.choice(["straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ring", "damm", "-Straße"])
        elif z < 0.85:
            way = r.choice(["Am", "An der", "Im", "Zum", "Alte", "Alter", "Unter den"]) + " " + r.choice([way + "grund", way + "berg", "Gasse", "Markt", "Linden", "Mühle"])
        else:
            way = r.choice(["Via", "Calle", "Rua", "Piazza", "Avenida", "Paseo", "Plaza de"]) + " " + syllable_word(r, (1, 2))
        return f"{way}{gap(r)}{number},{r.choice([' ', ' ', chr(10)])}{r.choice(['', '', 'D-', 'CH-'])}{code} {place}"
    way = r.choice(["rue", "avenue", "boulevard", "chemin", "place", "quai", "allée", "impasse", "bd."])
    of = r.choice(["de la ", "du ", "des ", "de ", "de l'", ""])
    return f"{number}{r.choice([', ', ' ', ',' + chr(10), ' bis, '])}{way} {of}{r.choice(['Moulin', 'Source', 'Tilleuls', 'Paix', 'Gare', 'République', 'Église']) if r.random() < 0.5 else syllable_word(r, (1, 2))}, {_fill(r, '#####')}{gap(r)}{place}"


def _alike(kind: str, r: random.Random) -> str:
    """A look-alike that is no case."""
    f = (r.choice(FAMILY) if r.random() < 0.3 else syllable_word(r, (1, 2), _ENDING)).strip()
    g = syllable_word(r, (1, 2), _ENDING)
    digits = lambda shape: _fill(r, shape)
    return {
        "surname": lambda: r.choice([f"{f} et al.", f"the {f} {r.choice(_NOUN)}", f"The {f} {r.choice(_NOUN)}", f"the {f}--{g} {r.choice(_NOUN)}", f"{f} and {g} (19{r.randint(10, 99)})", f"{f}'s {r.choice(_NOUN)}", f"The {f}-{g} {r.choice(_NOUN)}", f"Unlike {f}", f"Following {f}, we", f"For {f} it was", f"{f} [{r.randint(1, 40)}]", f"Mr. {f}", f"Dr {f}", f"Professor {f}"]),
        "institute": lambda: r.choice([f"University of {town(r)}", f"{town(r)} University", f"Department of {r.choice(_FIELD)}", f"Institute for {r.choice(_FIELD)}", f"{f} Laboratory", f"{f} Institute of {r.choice(_FIELD)}", f"{town(r)} Academy of Sciences", f"Ministry of {r.choice(_FIELD)}", f"School of {r.choice(_FIELD)}", f"The {f} Foundation", f"{r.choice(['Royal', 'National', 'Central'])} {r.choice(['Library', 'Museum', 'Society', 'Bank'])}", f"Faculty of {r.choice(_FIELD)} and {r.choice(_FIELD)}"]),
        "place": lambda: r.choice([f"{town(r)}", f"New {town(r)}", f"Lake {f}", f"Mount {f}", f"{f} River", "United States", "South Africa", "New Zealand", f"{town(r)} Airport", f"{f} Bridge", f"North {town(r)}", "San Francisco", "New York", "Great Britain", f"Port {town(r)}"]),
        "title": lambda: r.choice([f"Journal of {r.choice(_FIELD)}", "Monte Carlo", "Data Processing", "Machine Learning", f"Annual Review of {r.choice(_FIELD)}", "Fourier Transform", "Gaussian Process", f"{r.choice(_MONTHS)} {r.randint(1950, 2024)}", f"Section {r.randint(1, 9)}", "World Health Organization", "Python Package Index", "Black Friday", "Top: The", "Lower: At", "Poisson Process", f"{r.choice(_ADJ).capitalize()} {r.choice(_THING).capitalize()}", "Last Update", "Table Of Contents", "First Quarter", f"Phys. Rev. {r.choice('ABCDE')}", "Local Variables: mode", f"{r.choice(_ADJ).capitalize()} {r.choice(_NOUN)}"]),
        "grant": lambda: r.choice(["grant ", "grant no. ", "contract ", "award ", "catalogue no. ", "part no. ", "Project "]) + digits(r.choice(["###/###/####", "AA-######", "##-####-##", "#######", "AAA-#######", "######", "AA##AA####"])),
        "book": lambda: digits(r.choice(["ISBN 978-#-###-#####-#", "ISBN 978-#-####-####-#", "ISSN ####-####", "ISSN ####-###A", "doi:10.#####/AA.######", "DOI 10.####/######", "ORCID 0000-000#-####-####", "ORCID 0000-0000-####-###A", "arXiv:####.#####", "PMID ########", "RFC ####"])),
        "count": lambda: digits(r.choice(["run ########-###", "at ###\\,### steps", "##\\,###\\,### samples", "#,###,### rows", "$ ###,###.##", "pages ####--####", "at ###--### runs", "at ####--#### runs", "####--#### (199#)", "version #.##.#", "build ########", "0.########", "##.####, -##.####", "20#9-0#-1# 1#:##:##", "#######", "########", "1#.##.20##", "invoice ########", "order AA-########", "ticket #######", "serial AA########", "events ###\\,###\\,###", "Monte Carlo run ########-###", "seed ########", "job #########", "commit ########", "row ######", "#.######e-#"])),
        "net": lambda: r.choice([digits("port ####"), digits("192.168.#.##"), digits("10.#.#.#:####"), f"https://www.{_domain(r)}/{_local(r)}", f"http://{_domain(r)}", f"{_local(r)}@{digits('#.#.#')}", f"revision {digits('#####')}@trunk", "@article", r"\verb|A@B.T|", "$M@N.T$", f"@{_local(r)} on the forum", f"{r.choice(_NOUN)}@{digits('#.##.#')}", "look at the dot product", "stay at home", f"met at {town(r)} at noon", "at 3.5 GHz @ 40 W"]),
        "thing": lambda: f"{r.choice(_ADJ)} {r.choice(_THING)}",
        "thing2": lambda: r.choice(_THING),
        "town": lambda: town(r),
        "year": lambda: str(r.randint(1950, 2024)),
    }[kind]()


ITEMS: dict[str, Callable[[random.Random], str]] = {"email": email, "phone": phone, "address": address, "name": name, "id": some_id, "bare": bare_id}
KIND = {"id": "id_number", "bare": "id_number"}

#: Sentences. {label} is a label of an identity number, {title} may be a title before a name.
TEMPLATES = {
    "name": [
        "We thank {title}{name} for help with the {-thing}.", "{title}{name} and {name} checked the {-thing}.", "The {-thing} was first noticed by {name}.", "Discussions with {name} on the {-thing} are acknowledged.", "I am grateful to {name}, {name} and {name}.",
        "\\author{{name}}", "\\author{{name}, {name}, {name} and {name}}", "\\author{{name}\\and\n{name}\\and\n{name}}", "\\author{{name} \\and {name}}", "\\hypersetup{pdfauthor={{name}}}", "% TODO ask {name} about this", "%% {name}: please check",
        "Samples were prepared by {title}{name} at {-town}.", "Participant {name} left the {-thing} early.", "Contact: {name}, {-institute}", "{name} ({-institute})", "{name} is with the {-institute}.", "Signed, {name}", "Dear {title}{name},", "Sincerely,\n{name}", "From: {name}", "To: {name} <{email}>",
        "Wir danken {title}{name} für die Hilfe.", "Die Proben kamen von {name}.", "Nous remercions {name} pour son aide.", "{name} a fourni les données.", "Agradecemos a {name} su ayuda.", "Ringraziamo {name} per i dati.", "Herr {name} und Frau {name} haben zugestimmt.",
        "According to {name}, the {-thing} is {-thing}.", "The book by {name} appeared in {-year}.", "{name} joined in {-year} and {name} left.", "Interview with {name} on 3 May.", "The chair, {name}, opened the meeting.", "her supervisor {name} agreed", "his colleague {name} at {-town}", "Maintainer: {name}", "Reviewed by {name}; approved by {name}.", "It was {name} who wrote it.", "The field notes of {name} describe the {-thing}.", "The {-thing} goes back to {title}{name}.", "Edited by {name} and {name}", "{name} wrote the {-thing}.", "Yesterday {name} called.", "a letter from {name} to {name}", "For {name} the {-thing} was new.", "Both {name} and {name} agree.", "In {-year} {name} found it.", "Unlike {name}, we checked the {-thing}.", "patient {name}, aged 54, was seen", "{name}'s {-thing} is known.",
        "The {-thing} ({name}, personal communication) is new.", "Thanks to {name}, and to the {-institute}.", "by {name}", "{name}", "{name}, {name}", "Prepared for {title}{name}.", "{name} provided the {-thing}.", "Here {name} plays the main part.", "When {name} arrived, {name} had gone.", "Mrs. {name} lives in {-town}.", "The witness {name} said so.", "Supervisors: {name}; {name}", "Employee: {name}", "Name: {name}",
    ],
    "email": [
        "Write to {email} today.", "Contact {email} for the {-thing}.", "\\email{{email}}", "\\email{\\texttt{{email}}}", "\\thanks{{email}}", "\\href{mailto:{email}}{{email}}", "Correspondence: {email}", "e-mail: {email}", "E-mail {email}.", "Email: {email}", "The data can be had from {email} on request.", "Questions may be sent to {email} or {email}.", "% contact {email}",
        "({email})", "<{email}>", "{name} <{email}>", "Schreiben Sie an {email} bitte.", "Écrire à {email} pour les données.", "Escriba a {email} por favor.", "mailto:{email}", "Send it to {email}, please.", "Reach us at {email}!", "{email}", "my address is {email} now", "Reply-To: {email}", "{name} can be reached under {email}.", "\\texttt{{email}}", "cc {email}; {email}", "Ask {email} about the {-thing}.", "see {email} for details",
    ],
    "phone": [
        "Phone {phone}", "Tel. {phone}", "Tel: {phone}", "tel: {phone}.", "Tel.\\ {phone}", "\\thanks{Phone {phone}}", "\\thanks{Fax {phone}}", "Fax: {phone}", "Fax {phone}", "Call {phone} on weekdays.", "For access, call {phone}.", "The operator can be reached at {phone}.", "Night shifts answer on {phone} during the {-thing}.", "mobile: {phone}", "My number is {phone}.", "Telefon {phone}", "Tél. {phone}", "Telefono {phone}", "La salle répond au {phone}.", "Die Warte ist unter {phone} erreichbar.", "Teléfono: {phone}", "Llame al {phone} por favor.", "ring {phone} after six", "({phone})", "Fax the form to {phone}.", "The alarm dials {phone} (phone).", "Hotline {phone} or {phone}", "WhatsApp {phone}", "text me at {phone}", "% phone {phone}", "Office: {phone}, home: {phone}", "Please phone {name} on {phone}.", "Voice: {phone}", "Tel {phone}", "Phone number: {phone}", "dial {phone} to reach the {-thing}",
    ],
    "id": [
        "{label} {id}", "{label} {id}.", "The consent form lists {label} {id} for the volunteer.", "The form shows {label} {id}.", "Row 3 of the sheet still shows {label} {id}.", "subject 12 ({label} {id}) was dropped", "The {-thing} of subject {-year} ({label} {id}) was dropped.", "{name}, {label} {id}", "({label} {id})", "Her {label} is {id}.", "his {label}: {id}", "with {label} {id} in {-town}", "% {label} {id}", "Im Bogen steht noch {label} {id}.", "del sujeto 9 ({label} {id}) se retiró", "{label}~{id}", "{label}\\ {id}", "Die Phase von Person 4 ({label} {id}) entfiel.", "holder of {label} {id}, {name}", "under {label} {id} since {-year}", "{label} {id} and {label} {id}", "please quote {label} {id} when you write",
    ],
    "bare": ["The form lists {bare} for the volunteer.", "Row 3 of the sheet still shows {bare}.", "subject 12 ({bare}) was dropped", "Die Phase von Person 4 ({bare}) entfiel.", "Im Bogen steht noch {bare}.", "The consent form lists {bare} for the second volunteer.", "del sujeto 9 ({bare}) se retiró", "% {bare} belongs to the second volunteer", "patient {bare} was seen", "The consent form lists {number9} (social security)."],
    "address": ["Samples were shipped to {address} within two days.", "Mail goes to {address}.", "\\address{{address}}", "{name}, {address}", "The station stands at {address}.", "Die Station steht in {address}.", "La station se trouve {address}.", "She lives at {address}.", "Address: {address}", "Proben gingen an {address}.", "Please send it to {address}!", "our office at {address}", "Visit us: {address}", "% {address}", "{address}", "He moved to {address} in {-year}.", "\\thanks{{address}}", "Anschrift: {address}", "registered at {address} since {-year}", "La estación está en {address}.", "Postal address: {address}. Phone {phone}", "deliver to {address} before noon", "born at {address}"],
    "none": [
        "{-surname} holds for the {-thing}.", "We follow {-surname} here.", "At the {-institute} the {-thing} was slow.", "It is known ({-surname}) that the {-thing} is open.", "The {-institute} in {-place} paid for it.", "We checked the {-thing} against {-grant} and found a {-thing}.", "See {-book}.", "The {-thing} took {-count} and gave a {-thing}.", "It ran at {-net} all day.", "In {-place} the {-thing} ended.", "{-title} was used for the {-thing}.", "As shown in {-title}, the {-thing} is {-thing}.", "The {-thing} was seen at {-count}.", "funded by {-grant}", "available from {-net}", "{-book}", "{-count}", "\\cite{{-net}}", "We met in {-place} in {-year}.", "The {-thing} of the {-thing} was {-count} long.", "Here the {-thing} is slow, whereas the {-thing} is open.", "If it is so, then the {-thing} follows the {-thing} of {-year}.", "\\section{Global {-thing}}\\label{sec:2}", "\\affiliation{{-institute}, {-institute}}", "{-title} and {-title} are listed in the {-thing}.", "The Council of {-place} met the {-institute}.", "On Monday the {-thing} of {-place} opened in {-title}.", "Both {-surname} and {-surname} are old.", "Der {-thing} ist in {-place}.", "Die Störung der Messung hängt von der Welle ab, siehe \\ref{fig:2}.", "Für $x_{i} = 3$ begrenzt die Lösung der Grenze.", "La medida de la onda es lenta, según {-surname}.", "Nous montrons que la mesure est lente ({-surname}).", "We checked the {-thing} against {-book} and found a {-thing}.", "{-surname} was used with {-title}.", "Department heads from {-place}, {-place} and {-place} came.", "The total was {-count} in {-title}.", "{-grant}, {-book}, {-count}", "code at {-net} and {-net}",
    ],
}
_TITLES = ["", "", "", "", "Dr. ", "Dr ", "Prof. ", "Professor ", "Mr. ", "Mrs. ", "Ms. ", "Mr ", "Herr ", "Frau ", "Dr.~", "Prof. Dr. ", "M. ", "Mme ", "Sr. "]
_MARK = re.compile(r"\{(-?)(\w+)\}")


def sentence(r: random.Random, template: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The filled template and the spans of its items."""
    out, spans, at, size = [], [], 0, 0

    def put(piece: str) -> None:
        nonlocal size
        out.append(piece)
        size += len(piece)

    for m in _MARK.finditer(template):
        put(template[at : m.start()])
        at = m.end()
        alike, what = m.groups()
        if alike:
            put(_alike(what, r))
        elif what == "label":
            put(r.choice(LABELS))
        elif what == "title":
            put(r.choice(_TITLES))
        elif what in ITEMS or what == "number9":
            piece = _fill(r, "#########") if what == "number9" else ITEMS[what](r)
            spans.append((size, size + len(piece), "id_number" if what == "number9" else KIND.get(what, what)))
            put(piece)
        else:
            put(m.group())
    put(template[at:])
    return "".join(out), spans


#: Words that open sentences, and other common words, in several languages.
OPENERS = """The In At For If Here No Let Both Why Unlike Following We It This These Yesterday Today Since When While After Before During According Because Although However Then Last Next Her His Their Our My Your Its By From With Without Under Over Between Near Until Once Even Only Also And But Or So As To Of On Ask Tell Please Dear Hello Thanks Thank Signed Regarding Contact Enter Note See Only Most Some Many Each Every
Nach Wie Laut Für Mit Von Bei Herrn Seit Wir Die Der Das Ein Eine Und Aber Im Am Zum Bitte Gestern Heute Selon Pour Avec Chez Nous Le La Les Un Une Et Mais D'après Après Depuis Hier Según Para Con Los Las El Por Desde Secondo Per Il Lo Gli Ieri Como Quando""".split()
COMMON = """the a of to and in that it was for on with as at by from this have were not had are but be they which been their has will would there when who more said if no out up into than them then some could time these two may other only new its our over such my also well first work year years people day house letter report door table paper number second morning night week room office street water school page form note list file answer call wrote came left found took gave made went saw kept told asked read signed sent moved lives works agreed confirmed
und der die das nicht mit von ist war hat ein eine auf dem den im zu bei nach aus wie noch wurde bitte gestern seit le la les de des un une et est pour par dans sur avec pas plus était ont hier el los las que en por con una fue del muy desde il di che per non sono era ieri""".split()


def _words(r: random.Random, most: int) -> str:
    return " ".join(r.choice(COMMON) if r.random() < 0.85 else syllable_word(r, (1, 3)).lower() for _ in range(r.randint(0, most)))


_CLEAR = [shape for shape in PHONES if shape[0] in "+(" or shape in ("9##-###-####", "9##.###.####", "1-800-###-####", "0##/########", "0#_##_##_##_##", "020_####_####", "0####_###_###")]
_CALLED = "phone Phone tel Tel. Tel: tel. telephone Telephone: fax Fax Fax: mobile Mobile: cell hotline number ring dial call Telefon Telefon: Tel téléphone Tél. teléfono telefono Handy reception extension desk contact".split()


def frame(r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """An item among random words: its surroundings tell nothing, its shape and its label do."""
    kind = r.choice(["name", "name", "name", "email", "phone", "id", "bare", "address", "address"])
    before = _words(r, 6)
    if r.random() < 0.6:
        before = f"{r.choice(OPENERS)} {before}".strip()
    before += r.choice(["", "", "", "", ",", ":", " (", ";"]) if before else ""
    lead = ""
    if kind == "phone":
        item = _fill(r, r.choice(_CLEAR)) if r.random() < 0.6 else ""
        if not item:
            lead, item = r.choice(_CALLED) + " ", phone(r)
    elif kind == "id":
        label = r.choice(LABELS) if r.random() < 0.8 else syllable_word(r, (1, 3)).lower() + r.choice(["nummer", "-ID", " no.", " number", "tunnus", " card", " id:"])
        lead, item = label + r.choice([" ", " ", " ", "~", ": ", " = "]), some_id(r)
    else:
        item = ITEMS[kind](r)
    if kind == "name" and r.random() < 0.15:
        lead = r.choice(_TITLES)
    start = before if not before or before.endswith("(") else before + " "
    after = r.choice(["", ".", ",", ",", ":", ";", ")", "'s", "?", "!"]) if not before.endswith("(") else ")"
    tail = _words(r, 6)
    text = start + lead + item + after + (" " + tail if tail else "") + r.choice([".", ".", "", "\n"])
    at = len(start) + len(lead)
    return text, [(at, at + len(item), KIND.get(kind, kind))]


def passage(r: random.Random, sentences: int = 6) -> tuple[str, list[tuple[int, int, str]]]:
    """Some sentences in a row, with the spans of all items."""
    kinds = ["name"] * 34 + ["email"] * 11 + ["phone"] * 13 + ["id"] * 11 + ["bare"] * 4 + ["address"] * 13 + ["none"] * 34
    text, spans = "", []
    for _ in range(sentences):
        part, found = frame(r) if r.random() < 0.4 else sentence(r, r.choice(TEMPLATES[r.choice(kinds)]))
        spans += [(a + len(text), b + len(text), k) for a, b, k in found]
        text += part + r.choice([" ", " ", " ", "\n", "\n", "\n\n", "\r\n"])
    return text, spans
