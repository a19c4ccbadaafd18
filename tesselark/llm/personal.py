"""Personal information in free text: found by kind and replaced by typed placeholders.

Anchor expansion: one Aho-Corasick pass over the lower-cased text finds at-signs and their spelt-out forms, schemes, pairs of
digits around a separator, cues of numbers, words of streets and post boxes, known given names, and what shows a name with any
given name: titles, words of birth and of speech, years of life, and ends of family names. A local parser for each kind expands
its anchor to both sides, to the ends of the words that its grammar takes in, and validates what it finds; nothing else of the
text is looked at.

Given names are learned from the whole corpus first (:func:`learned_names`): those that stand with ``LEAST_FAMILIES`` family names in
``LEAST_DOCUMENTS`` documents beside a cue that shows a name with any given name, and seldom enough without one. They are then anchors wherever they stand, beside a short list of
names that are common in many countries.

Kinds: ``email``, ``phone``, ``id_number`` (only beside a cue that names a personal number: bare numbers name objects),
``address`` (a street with a house number, or a post box), ``name`` (a given name with a family name in either order; a given name
that is neither listed nor learned needs a title before it, words of birth, speech or years of life behind it, or a family name with a known end).

Defined results: null and empty texts have nothing; texts are searched whole; where finds overlap, the earlier and then
the longer one stands; the text around a find is kept as it is; repeated rows and finds give one row per document and
kind; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.runtime import bounded_collect

EMAIL, PHONE, ID_NUMBER, ADDRESS, NAME = "email", "phone", "id_number", "address", "name"
KINDS = (EMAIL, PHONE, ID_NUMBER, ADDRESS, NAME)

#: Given names that are common in many countries. More are learned, and a table of others can be passed in.
GIVEN_NAMES = """
adam ahmed aisha ali alice amelia amina amy ana andrea andrew angela anita anna anne antonio arjun ava barbara beatriz benjamin
carlos carmen carol caroline catherine charles charlotte chen christine christopher clara claire claudia daniel david deborah
diana diego dorothy edward elena elizabeth ella emily emma eric esther eva fatima fernando francesca francisco frank gabriel
george giovanni giulia giuseppe grace hannah hans hassan helen henry hiroshi hugo ibrahim ines irene isabella ivan jack jacob
james jane jean jennifer jessica joan john jonathan jorge jose joseph juan julia karen kate kenji kevin khadija laura leo liam
linda lisa lucas lucia lucy luis maria margaret marie mark marta martin mary matteo matthew mei michael michelle miguel
mohamed mohammed nancy natalia natasha nicholas nicole noah nora oliver olivia omar pablo patricia patrick paul pedro peter
philip pierre priya rachel rahul raj rebecca richard robert rosa ruth ryan samuel sandra sara sarah sofia sophia sophie
stephen susan teresa thomas tomas victoria vincent walter wei william xin yuki yusuf zainab
александр алексей андрей анна дмитрий елена иван ирина мария михаил наталья николай ольга павел сергей татьяна
""".split()
#: Words that make a landmark of a given name before them.
LANDMARKS = frozenset(
    "bridge harbour harbor valley falls hill hills lake mount mountain park house tower square bay point castle island river street road "
    "avenue lane close crescent terrace prize award medal school college museum academy society institute trust council station field "
    "gardens garden hall church cathedral abbey library theatre county city town village family line effect dialect theorem".split()
)
#: Ends of family names; a family name before a comma and a given name must have one.
FAMILY_ENDS = (
    "ander anova ova ovic aro beck dottir eiro field gate holt inski ski ley ling mann more ridge stad ström strom sworth worth wick son sen "
    "berg stein man ez ini elli ić ов ев ин ова ева ина ский ская ой ий ая ко"
).split()
#: Titles before a name of any given name.
TITLES = "dr. |mr. |mrs. |ms. |prof. |dr |mr |mrs |ms |herr |frau |señor |señora |signor |signora |monsieur |madame |mme |mlle ".split("|")
#: What follows a name of any given name: words of birth, years of life, words of speech.
SPEECH = "said says wrote writes told asked replied explained argued recalled agreed joked whispered shouted smiled laughed emailed phoned apologised resigned".split()
LIVES = [" (born ", ", born ", " was born ", " (b. ", " née ", *(f" ({c}" for c in "12"), *(f" {w} " for w in SPEECH)]
#: Cues of telephone numbers.
DIALS = ["tel:", "tel.", "tel ", "phone:", "phone ", "telephone:", "telephone ", "mobile:", "mobile ", "fax:", "fax ", "telefon:", "telefon ", "tél.", "tél ", "móvil:", "тел."]
#: A learned given name stands with so many family names, in so many documents, beside a cue, and has a cue in so great a part of the
#: documents in which it stands before another capitalised word: words such as 'village' before its name do not.
LEAST_FAMILIES, LEAST_DOCUMENTS, LEAST_SHARE = 2, 3, 0.15
#: Learned names are held by every worker. Beyond this, raise the two numbers above.
MAX_NAMES = 1_000_000
#: Capitalised words before a family name that are no given name: openers of sentences, parts of place names, offices, months and days.
NOT_GIVEN = LANDMARKS | frozenset(
    "a an the this that these those his her its their our my your he she it they we i you who whose which what when where while why how if as at by in on of to for from with without near "
    "after before during since until between among over under above below through across around about against along behind beside beyond despite inside outside toward towards upon within and or but nor so yet "
    "not no all any both each every few many more most much other some such several another first second third last one two three four five six seven eight nine ten then there here now today only even also "
    "however although though because unless whether once later earlier soon still again never always both either neither today yesterday according north south east west northern southern eastern western upper lower "
    "central new old great greater little big saint st st. san santa port fort cape mount lake isle loch glen dr mr mrs ms prof professor sir dame lord lady king queen prince princess duke duchess count countess baron "
    "bishop archbishop pope father mother brother sister captain colonel general major sergeant president minister mayor judge senator doctor herr frau monsieur madame señor señora signor signora mme mlle "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "der die das den dem des ein eine im am und von bei le la les un une et du de el los las una del il lo gli e o os as da do see call write ask contact tel phone email dear hello "
    "gemeinde stadt dorf kreis bezirk garten ville commune jardin ciudad pueblo comune население город деревня село район улица "
    "и в на по из от до за при он она они это этот эта его её их как что когда где но или не был была было были для под над".split()
)
#: Cues of numbers that identify a person.
ID_CUES = (
    "ssn|social security|national id|national identity|identity number|identity card|id-nr|id nr|tax identification|tax id|tax number|taxpayer|passport|"
    "driver's licence|driver's license|driving licence|personalausweis|steuer-id|steueridentifikationsnummer|reisepass|passeport|pasaporte|passaporte|паспорт|снилс|инн|nif|cpf|dni"
).split("|")
#: English words of streets, and their short forms.
STREETS = "street st road rd avenue ave lane ln close crescent terrace drive court way place square boulevard blvd row walk grove mews".split()

_SEP = r"[ .\-‐‑–]"
_DIGIT_SEPARATORS = " .-‐‑–)("
_EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+'-]+$")
_SPELT_AT = re.compile(r"\s?(?:\(at\)|\[at\]|\{at\}|＠|@)\s?|\sat\s", re.I)
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\sdot\s))+[A-Za-z]{2,24}(?![A-Za-z0-9])", re.I)
_PHONES = [
    re.compile(p)
    for p in (
        # country code and groups, bare or parted
        r"\+\d{1,3}(?:" + _SEP + r"?\(?\d{1,5}\)?){1,5}",
        # North America: three, three and four digits
        r"(?:1" + _SEP + r")?(?:\([2-9]\d{2}\)\s?|[2-9]\d{2}([ .\-‑]))[2-9]\d{2}(?(1)\1|[ .\-‑]?)\d{4}",
        # trunk prefix 0
        r"\(?0\d{2}\)?[ -]\d{4}[ -]\d{4}|\(?01\d{3}\)?[ -]\d{3}[ -]?\d{3}|\(?0\d{3}\)?[ -]\d{3}[ -]\d{4}|07\d{3}[ -]\d{3}[ -]?\d{3}",
        # France: five pairs
        r"0[1-9](?:[ .-]\d{2}){4}",
    )
]
#: Characters of the longest number that the patterns above can match.
_LONGEST_PHONE = 48
_DIALLED = re.compile(r"\s?(?:no\.?|number|nr\.?)?\s?[:.]?\s?(\+?\(?\d{1,5}\)?(?:" + _SEP[:-1] + r"/]?\(?\d{1,7}\)?){0,5})", re.I)
_EXTENSION = re.compile(r"\s?(?:ext\.?|x|extension)\s?\d{1,5}", re.I)
_ID_VALUE = re.compile(r"(?:[A-Z]{1,3}\s?(?:\d{6,9}|\d{2}\s\d{2}\s\d{2})(?:\s?[A-Z])?|[A-Z]\d{3}[A-Z]\d{5}|\d{3}[ -]\d{2}[ -]\d{4}|\d[\d]*(?:[ .\-/]\d+){0,4}[A-Z]?|(?=[A-Z0-9]*\d)[A-Z0-9]{6,20})(?![A-Za-z0-9])")
_STREET_LEFT = re.compile(
    r"(?:(?:flat|apt\.?|apartment|unit|suite)\s\d{1,4}[A-Za-z]?,\s)?(?<![\d.,/-])\b\d{1,4}[A-Za-z]?(?:-\d{1,4})?,?\s(?:[A-ZÀ-Þ][\w'’.-]*\s){1,3}$", re.I
)
_CAPITALS = re.compile(r"\d[A-Za-z]?(?:-\d{1,4})?,?\s(?:[A-ZÀ-Þ][\w'’.-]*\s){1,3}$")
_GERMAN = re.compile(r"([A-ZÄÖÜ][\w-]*(?:weg|allee|straße|strasse|gasse|platz|ufer|damm|ring|chaussee))\s\d{1,4}\s?[a-z]?(?![\w.])")
_FRENCH = re.compile(r"\d{1,4}(?:\s?(?:bis|ter))?,?\s(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai)\s(?:de\sla\s|de\sl['’]|des\s|du\s|de\s|d['’])?[A-ZÀ-Þ][\w'’-]*", re.I)
_BOX = re.compile(r"(?:p\.?\s?o\.?\s?box|post\soffice\sbox|postfach|apartado(?:\sde\scorreos)?|caixa\spostal|boîte\spostale|\bbp|а/я)\s(?:no\.?\s)?\d{1,6}(?!\d)", re.I)
_SPANISH = re.compile(r"\b(?:calle|avenida|plaza|rua|via|viale|ул\.|улица)\s(?:(?:de|del|la|las|los|da|do|das|dos)\s)*[A-ZÀ-ÞА-Я][\w'’-]*(?:\s[A-ZÀ-ÞА-Я][\w'’-]*)*,?\s(?:n[º°.]\s?|д\.\s?)?\d{1,4}(?!\d)", re.I)
_PLACE = re.compile(r"(?:,\s|,?\n)(?:\d{4,6}\s)?[A-ZÀ-Þ][\w'’-]+(?:\s\d{4,6}(?!\d))?")
_PARTICLE = r"(?:(?:von der|von|van der|van den|van|de la|de los|del|della|di|da|dos|de|du|le|la|ter|ten|zu|bin|ibn)\s|al-|el-|O['’]|Mc|Mac)"
_WORD = r"[A-ZÀ-ÞА-ЯЁ][\w’']+(?:-[A-ZÀ-ÞА-ЯЁ][\w’']+)*"
_INITIALS = r"(?:[A-ZА-Я]\.[  ]?){0,2}"
_FORWARD = re.compile(r"[   \n]" + _INITIALS + "(" + _PARTICLE + r"?" + _WORD + ")", 0)
_TITLED = re.compile("(" + _WORD + ")[   ]" + _INITIALS + "(" + _PARTICLE + r"?" + _WORD + r")(?![\w’'-])")
_BEFORE_LIFE = re.compile(r"(?<![\w’'.-])(" + _WORD + ")[   ]" + _INITIALS + "(" + _PARTICLE + r"?" + _WORD + ")$")
_BEFORE_FAMILY = re.compile(r"(?<![\w’'.@-])(" + _WORD + ")[   ]" + _INITIALS + _PARTICLE + r"?(?:" + _WORD + r"-)?$")
_COMMA_GIVEN = re.compile(r",[  \n](" + _WORD + r")(?![\w’'@-])(?:[  ][A-ZА-Я]\.)?")
_BORN = re.compile(r"(?: (?:" + "|".join(SPEECH) + r") | \(born |, born | was born | \(b\. | née | \((?:c\. ?)?\d{3,4} ?[–-] ?(?:\d{3,4})?\))")
_CAPITAL_PAIR = re.compile(r"(?<![\w’'.@-])(" + _WORD + r")(?=[   ](?:[A-ZА-Я]\.[  ]){0,2}" + _PARTICLE + r"?[A-ZÀ-ÞА-ЯЁ])")
_BACKWARD = re.compile(r"((?:" + _PARTICLE + r")?" + _WORD + r"),[  \n]$")


def _automaton(given: frozenset[str], names_only: bool = False) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    anchors: dict[str, set[str]] = {}
    if names_only:  # what shows a name with any given name
        for words, kind in ((TITLES, "title"), (LIVES, "life"), (FAMILY_ENDS, "family")):
            for word in words:
                a.add_word(word, (len(word), tuple({kind, *(a.get(word, (0, ()))[1])})))
        a.make_automaton()
        return a
    for word, kind in [("@", EMAIL), ("＠", EMAIL), ("(at)", EMAIL), ("[at]", EMAIL), ("{at}", EMAIL), (" dot ", EMAIL)]:
        anchors.setdefault(word, set()).add(kind)
    for x in "0123456789":
        anchors.setdefault(f"+{x}", set()).add(PHONE)
        for y in "0123456789":
            for s in _DIGIT_SEPARATORS:
                anchors.setdefault(f"{x}{s}{y}", set()).add(PHONE)
        anchors.setdefault(f"){x}", set()).add(PHONE)
        anchors.setdefault(f") {x}", set()).add(PHONE)
    for cue in ID_CUES:
        anchors.setdefault(cue, set()).add(ID_NUMBER)
    for street in STREETS:
        anchors.setdefault(f" {street}", set()).add("street")
    for word in ("weg ", "allee ", "straße ", "strasse ", "gasse ", "platz ", "ufer ", "damm ", "ring ", "chaussee "):
        anchors.setdefault(word, set()).add("german")
    for word in ("rue ", "avenue ", "boulevard ", "place ", "chemin ", "allée ", "impasse ", "quai "):
        anchors.setdefault(f" {word}", set()).add("french")
    for word in ("box ", "postfach ", "apartado ", "caixa postal ", "postale ", "bp ", "а/я "):
        anchors.setdefault(word, set()).add("box")
    for word in ("calle ", "avenida ", "plaza ", "rua ", "viale ", "via ", "ул.", "улица "):
        anchors.setdefault(word, set()).add("spanish")
    for word in TITLES:
        if word:
            anchors.setdefault(word, set()).add("title")
    for word in DIALS:
        anchors.setdefault(word, set()).add("dial")
    for word in LIVES:
        anchors.setdefault(word, set()).add("life")
    for word in FAMILY_ENDS:
        anchors.setdefault(word, set()).add("family")
    for name in given:
        anchors.setdefault(name, set()).add(NAME)
    for word, kinds in anchors.items():
        a.add_word(word, (len(word), tuple(sorted(kinds))))
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    """Lower case with as many characters as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+'-")


def _back(text: str, at: int, chars: frozenset[str]) -> int:
    """Where the run of these characters that ends at ``at`` begins."""
    while at and text[at - 1] in chars:
        at -= 1
    return at


def _tokens_back(text: str, at: int, tokens: int) -> int:
    """Where the last so many words before ``at`` begin, whatever their length."""
    for _ in range(tokens):
        while at and text[at - 1].isspace():
            at -= 1
        while at and not text[at - 1].isspace():
            at -= 1
        if not at:
            break
    return at


def _labels_back(text: str, at: int) -> int:
    """Where the at-sign of the domain whose labels end at ``at`` can begin: behind the words that make up the labels."""
    while True:
        at = _tokens_back(text, at, 1)
        word = text[max(0, _tokens_back(text, at, 1)) : at].strip().lower()
        if word != "dot" or not at:
            return max(0, _tokens_back(text, at, 1) - 1)
        at = _tokens_back(text, at, 1)


class Finder:
    """Finds personal information in a text."""

    def __init__(self, given: frozenset[str] = frozenset(GIVEN_NAMES), names_only: bool = False):
        self.given, self.anchors = given, _automaton(given, names_only)
        self.parsers = {EMAIL: self.email, PHONE: self.phone, ID_NUMBER: self.id_number, "street": self.street, "german": self.german, "french": self.french, "box": self.box, "spanish": self.spanish, NAME: self.name, "title": self.title, "dial": self.dial, "life": self.life, "family": self.family}

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Start, end and kind of each find, in order, without overlaps."""
        found: list[tuple[int, int, str]] = []
        done: dict[str, int] = {}
        for last, (size, kinds) in self.anchors.iter(_lower(text)):
            start, end = last - size + 1, last + 1
            for kind in kinds:
                if done.get(kind, -1) > start:
                    continue  # inside a find of the same parser
                hit = self.parsers[kind](text, start, end)
                if hit:
                    found.append(hit)
                    done[kind] = hit[1]
        found.sort(key=lambda x: (x[0], -x[1]))
        rank = {ID_NUMBER: 0, EMAIL: 1, ADDRESS: 2, PHONE: 3, NAME: 4}
        kept: list[tuple[int, int, str]] = []
        for hit in found:
            if kept and hit[0] < kept[-1][1]:
                if rank[hit[2]] < rank[kept[-1][2]]:
                    kept[-1] = hit
                continue
            kept.append(hit)
        return kept

    def email(self, text: str, start: int, end: int) -> tuple[int, int, str] | None:
        if text[start:end].lower() == " dot ":  # 'a at b dot c': the at-sign is a word further left
            border = _labels_back(text, start)
            at = list(_SPELT_AT.finditer(text, border, start))
            if not at:
                return None
            sign = at[-1]
        else:
            sign = _SPELT_AT.match(text, start - 1) if start and text[start - 1].isspace() else None
            sign = sign or _SPELT_AT.match(text, start)
            if not sign:
                return None
        local = _EMAIL_LOCAL.search(text, _back(text, sign.start(), _LOCAL), sign.start())
        domain = _DOMAIN.match(text, sign.end())
        if not local or not domain:
            return None
        begin = local.start() + len(local[0]) - len(local[0].lstrip(".'-%"))
        if begin >= sign.start() or not re.search(r"[A-Za-z0-9]", text[begin : sign.start()]):
            return None
        word = sign[0].strip().lower() == "at"
        if word and sign[0].strip() != "AT" and text[begin : sign.start()].isalpha():
            return None  # 'met at noon dot com' is prose
        spaced = sign[0][:1].isspace() or sign[0][-1:].isspace()
        if spaced and text[begin : sign.start()][-1] in ".,;:":
            return None
        scheme = text[max(0, begin - 7) : begin].lower() == "mailto:"
        return (begin - 7 if scheme else begin), domain.end(), EMAIL

    def phone(self, text: str, start: int, end: int) -> tuple[int, int, str] | None:
        begin = start
        while begin > 0 and begin > start - _LONGEST_PHONE and (text[begin - 1].isdigit() or text[begin - 1] in "+()" or (text[begin - 1] in _DIGIT_SEPARATORS and begin > 1 and (text[begin - 2].isdigit() or text[begin - 2] in "()"))):
            begin -= 1
        for at in range(begin, start + 1):
            if text[at] not in "+(0123456789":
                continue
            before = text[at - 1] if at else " "
            if before.isalnum() or before in "+.,/_$£€#-‑" and text[max(0, at - 4) : at].lower() != "tel:":
                continue
            if before in "- " and at > 1 and text[at - 2].isdigit() and text[at] != "+":
                continue
            for pattern in _PHONES:
                m = pattern.match(text, at)
                if not m or m.end() <= start:
                    continue
                behind = text[m.end() : m.end() + 2]
                if behind[:1].isalnum() or (behind[:1] in "-‑./" and behind[1:2].isdigit()) or (behind[:1] == " " and behind[1:2].isdigit()):
                    continue
                digits = sum(c.isdigit() for c in m[0])
                if not 7 <= digits <= 15 or (m[0][0] == "+" and digits < 8):
                    continue
                extension = _EXTENSION.match(text, m.end())
                scheme = 4 if text[max(0, at - 4) : at].lower() == "tel:" else 0
                return at - scheme, extension.end() if extension else m.end(), PHONE
        return None

    def dial(self, text: str, start: int, end: int) -> tuple[int, int, str] | None:
        """A number behind a word that announces it, in any grouping."""
        if start and text[start - 1].isalnum():
            return None
        m = _DIALLED.match(text, end)
        if not m or not 6 <= sum(c.isdigit() for c in m[1]) <= 15 or text[m.end() : m.end() + 1].isalnum():
            return None
        extension = _EXTENSION.match(text, m.end())
        return m.start(1), extension.end() if extension else m.end(), PHONE

    def id_number(self, text: str, start: int, end: int) -> tuple[int, int, str] | None:
        if start and text[start - 1].isalnum() or (end < len(text) and text[end].isalpha() and text[end : end + 1] not in "s"):
            return None
        gap = re.compile(r"(?:\s(?:number|no|nr|card|id|code)\b)?[\s.:#№ºn°-]{0,4}(?:is\s)?", re.I).match(text, end)
        at = gap.end() if gap else end
        m = _ID_VALUE.match(text, at)
        if m and sum(c.isdigit() for c in m[0]) >= 6:
            return at, m.end(), ID_NUMBER
        left = re.compile(r"((?:\d{3}[ -]\d{2}[ -]\d{4}|\d{9}|[A-Z]{1,3}\s?\d{6,9}(?:\s?[A-Z])?))\s?\($").search(text, max(0, start - 24), start)  # none of these is longer
        if left and not text[max(0, left.start() - 1) : left.start()].isalnum():
            return left.start(1), left.end(1), ID_NUMBER
        return None

    @staticmethod
    def _with_place(text: str, start: int, end: int) -> tuple[int, int, str]:
        place = _PLACE.match(text, end)
        return start, place.end() if place else end, ADDRESS

    def street(self, text: str, start: int, end: int) -> tuple[int, int, str] | None:
        if end < len(text) and (text[end].isalnum() or text[end] in "-'’"):
            return None
        if not text[start + 1].isupper():
            return None
        left = _STREET_LEFT.search(text, _tokens_back(text, start, 6), start + 1)
        if not left or not _CAPITALS.search(left[0]):
            return None
        if end < len(text) and text[end] == "." and text[start + 1 : end].lower() in ("st", "rd", "ave", "ln", "blvd"):
            end += 1
        return self._with_place(text, left.start(), end)

    def german(self, text: str, start: int, end: int) -> tuple[int, int, str] | None:
        begin = start
        while begin and (text[begin - 1].isalpha() or text[begin - 1] == "-"):
            begin -= 1
        m = _GERMAN.match(text, begin)
        return self._with_place(text, begin, m.end()) if m else None

    def french(self, text: str, start: int, end: int) -> tuple[int, int, str] | None:
        for at in range(max(0, start - 10), start):  # a house number has no more characters
            m = _FRENCH.match(text, at)
            if m and m.start() < start <= m.end() and not text[max(0, m.start() - 1) : m.start()].isalnum():
                return self._with_place(text, m.start(), m.end())
        return None

    def box(self, text: str, start: int, end: int) -> tuple[int, int, str] | None:
        for at in range(max(0, start - 14), start + 1):  # nor has what stands before 'box'
            m = _BOX.match(text, at)
            if m and m.start() <= start < m.end() and not text[max(0, m.start() - 1) : m.start()].isalnum():
                return self._with_place(text, m.start(), m.end())
        return None

    def spanish(self, text: str, start: int, end: int) -> tuple[int, int, str] | None:
        if start and text[start - 1].isalnum():
            return None
        m = _SPANISH.match(text, start)
        return self._with_place(text, start, m.end()) if m and m[0].split()[-1][-1].isdigit() else None

    def name(self, text: str, start: int, end: int) -> tuple[int, int, str] | None:
        if start and (text[start - 1].isalnum() or text[start - 1] in "-_@.'’") or not text[start].isupper():
            return None
        if end < len(text) and (text[end].isalnum() or text[end] in "-_@'’"):
            return None
        given = text[start:end]
        if not (given[1:].islower() or given.isupper()):
            return None
        m = _FORWARD.match(text, end)
        if m:
            family = m[1]
            last = re.split(r"[\s-]", family)[-1]
            ended = last.lower().endswith(tuple(FAMILY_ENDS))
            if text[end] == "\n" and not ended:
                m = None
            elif last.lower() in LANDMARKS or last.lower() in self.given and not ended:
                m = None
            else:
                behind = re.compile(r"[  ](\w+)").match(text, m.end())
                if behind and behind[1][:1].isupper() and behind[1].lower() in LANDMARKS:
                    return None
                return start, m.end(), NAME
        b = _BACKWARD.search(text, _tokens_back(text, start, 4), start) if start > 1 and text[start - 1].isspace() else None
        if b and re.split(r"[\s-]", b[1])[-1].lower().endswith(tuple(FAMILY_ENDS)) and not re.split(r"[\s-]", b[1])[-1].lower() in LANDMARKS:
            initial = re.compile(r"(?:[  ][A-ZА-Я]\.)?").match(text, end)
            return b.start(1), initial.end(), NAME
        return None

    def _person(self, text: str, given: str, family: str, end: int) -> bool:
        """Whether two capitalised words can name a person by what they are."""
        last = re.split(r"[\s-]", family)[-1].lower()
        behind = re.compile(r"[  ](\w+)").match(text, end)
        return given.lower() not in NOT_GIVEN and last not in NOT_GIVEN and not (behind and behind[1].lower() in LANDMARKS)

    def title(self, text: str, start: int, end: int) -> tuple[int, int, str] | None:
        if start and (text[start - 1].isalnum() or text[start - 1] in "-_'’") or not text[start].isupper():
            return None
        m = _TITLED.match(text, end)
        return (end, m.end(), NAME) if m and self._person(text, m[1], m[2], m.end()) else None

    def life(self, text: str, start: int, end: int) -> tuple[int, int, str] | None:
        if not start or not text[start - 1].isalnum() or not _BORN.match(text, start):
            return None
        m = _BEFORE_LIFE.search(text, _tokens_back(text, start, 7), start)
        return (m.start(), start, NAME) if m and self._person(text, m[1], m[2], start) else None

    def family(self, text: str, start: int, end: int) -> tuple[int, int, str] | None:
        if end < len(text) and (text[end].isalnum() or text[end] in "-_@"):
            return None
        begin = start
        while begin and (text[begin - 1].isalpha()):
            begin -= 1
        word = text[begin:end]
        if end - begin < 5 or not word[0].isupper() or not (word[1:].islower() or word.isupper()):
            return None
        m = _BEFORE_FAMILY.search(text, _tokens_back(text, begin, 7), begin) if begin else None
        if m and self._person(text, m[1], word, end):
            return m.start(), end, NAME
        # 'Family, Given': places stand so too, so that it takes an initial, a line of its own, or a bracket, semicolon or colon around it
        m = _COMMA_GIVEN.match(text, end)
        if not m or not self._person(text, m[1], word, m.end()):
            return None
        edge = (begin == 0 or text[begin - 1] in "\n(;" or text[max(0, begin - 2) : begin] in ("; ", ": ", "* ", "- ")) and (m.end() == len(text) or text[m.end()] in "\n);:")
        return (begin, m.end(), NAME) if edge or m[0].endswith(".") else None

    def cued(self, text: str) -> set[tuple[str, str]]:
        """Given and family names of a text that stand beside a cue, in lower case."""
        out = set()
        for start, end, _ in self.spans(text):
            found = text[start:end]
            family, comma, given = found.partition(", ")
            words = (given if comma else found).split()
            if words and re.fullmatch(_WORD, words[0]):
                out.add((words[0].lower(), family.lower() if comma else words[-1].lower()))
        return out

    def redact(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with placeholders such as ``[EMAIL]``, and how many finds there are of each kind."""
        out, at, count = [], 0, dict.fromkeys(KINDS, 0)
        for start, end, kind in self.spans(text):
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
            count[kind] += 1
        return "".join([*out, text[at:]]), count


_finders: dict[str, Finder] = {}


def _worker(name: str, given) -> Finder:
    """The finder of this Python worker, made once and kept for its later tasks."""
    if name not in _finders:
        _finders.clear()
        _finders[name] = Finder(given.value if given is not None else frozenset(), names_only=given is None)
    return _finders[name]


def learned_names(documents: DataFrame, text: str = "text", families: int = LEAST_FAMILIES, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``given, families, documents``: given names, in lower case, that stand with enough family names in enough documents beside
    a cue, and beside a cue often enough. All documents are read; what is shuffled are pairs of names and capitalised words,
    counted within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _worker("cues", None)
        for batch in batches:
            pairs: dict[tuple[str, str | None], int] = {}
            for t in batch.column(0).to_pylist():
                for pair in [*finder.cued(t), *((w, None) for w in {m[1].lower() for m in _CAPITAL_PAIR.finditer(t)})]:
                    pairs[pair] = pairs.get(pair, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in pairs], pa.string()), pa.array([f for _, f in pairs], pa.string()), pa.array(list(pairs.values()), pa.int64())], names=["given", "family", "documents"]
            )

    rows = documents.where(F.length(text) > 0).select(text).mapInArrow(run, "given string, family string, documents long")
    pairs = rows.groupBy("given", "family").agg(F.sum("documents").alias("documents"))
    names = pairs.groupBy("given").agg(
        F.count("family").alias("families"), F.sum(F.when(F.col("family").isNotNull(), F.col("documents"))).alias("documents"), F.sum(F.when(F.col("family").isNull(), F.col("documents"))).alias("paired")
    )
    enough = (F.col("families") >= families) & (F.col("documents") >= least) & (F.col("documents") >= LEAST_SHARE * F.coalesce("paired", F.lit(0)))
    return names.where(enough).select("given", "families", "documents")


def _known_names(documents: DataFrame, text: str, given_names: DataFrame | list[str] | None, learn: bool):
    """The given names that are anchors, broadcast: those of the list or table, and the learned ones."""
    if isinstance(given_names, DataFrame):
        given_names = [r[0] for r in bounded_collect(given_names.select(given_names.columns[0]), MAX_NAMES, "the table of given names") if r[0]]
    names = {x.lower() for x in (GIVEN_NAMES if given_names is None else given_names)}
    if learn:
        names |= {r[0] for r in bounded_collect(learned_names(documents, text).select("given"), MAX_NAMES, "the learned given names")}
    return documents.sparkSession.sparkContext.broadcast(frozenset(names)), uuid.uuid4().hex


def redacted(documents: DataFrame, key: str = "doc_id", text: str = "text", given_names: DataFrame | list[str] | None = None, learn: bool = True) -> DataFrame:
    """``key, text, kinds``: the texts with placeholders, and the kinds found. One narrow pass after that of the names; null
    texts stay null."""
    given, name = _known_names(documents, text, given_names, learn)
    kind = {f.name: f.dataType.simpleString() for f in documents.schema}[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            finder = _worker(name, given)
            texts, kinds = [], []
            for t in batch.column(1).to_pylist():
                new, count = finder.redact(t) if t else (t, {})
                texts.append(new)
                kinds.append([k for k in KINDS if count.get(k)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=[key, "text", "kinds"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, text string, kinds array<string>")


def found_kinds(documents: DataFrame, key: str = "doc_id", text: str = "text", given_names: DataFrame | list[str] | None = None, learn: bool = True) -> DataFrame:
    """``key, kind``: the kinds found in each document. Only kinds leave the worker."""
    given, name = _known_names(documents, text, given_names, learn)
    type_of_key = {f.name: f.dataType.simpleString() for f in documents.schema}[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            finder = _worker(name, given)
            rows, kinds = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for k in sorted({s[2] for s in finder.spans(t)}) if t else ():
                    rows.append(i)
                    kinds.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string())], names=[key, "kind"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {type_of_key}, kind string").distinct()
