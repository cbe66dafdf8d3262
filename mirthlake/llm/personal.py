"""Personal information inside free text: email addresses, phone and identity numbers, street addresses and names.

Information-theoretic sanitisation: forms only propose candidates, and what a candidate's terms disclose about a person
decides. Disclosure is measured in bits, log2(P(protected | term) / P(protected)), from co-occurrence in the whole
collection, and a candidate counts if its frame's and its terms' bits add up to DISCLOSURE.

- Words of names. Protected is what stands after a title, beside an initial or in the local part of an email address.
  Words seen too seldom are judged by the bits of their beginnings and endings (a naive Bayes model over all words of
  the collection). Pairs of neighbouring capitalised words then carry the evidence on: words before family names are
  given names, words beside given names are family names, twice. A few common given names are seeds.
- Numbers. Protected are numbers of an unmistakable form; the term is the word that leads in a number. Words whose
  numbers are hardly ever of such a form ("ticket", "order") take bits away from forms that may be anything.
- Street addresses. Protected are streets with a postal code or town; the terms are the names of streets and towns.

Mentions are replaced by a placeholder of their kind (the terms are generalised, not cut out), the rest of the text
stays as it is. Statistics are count-min sketches of two times 2^18 cells a table, a fixed size whatever the
vocabulary; texts are read twice, once to count and once to find.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .text import fold

CELLS = 1 << 18
#: Bits by which a candidate must raise the chance that a person is meant.
DISCLOSURE = 4.0
#: Bits of a frame: a given name or a title's second word beside; an initial or a comma; a title; an unmistakable form; a form that may be anything.
BESIDE, FIRM, TITLED, SURE, LOOSE_FORM = 4.0, 1.1, 10.0, 12.0, 6.0
KINDS = ("person_name", "email", "phone", "id_number", "street_address")

#: Uses from which a word is judged by itself, not by its ends.
OFTEN = 8

# Seeds, given names common in the languages of the collection. The rest are learned.
GIVEN = set("""
aisha alan alice amelia amélie amir amy andrea andrew ana anna anne annika anton antonio ben beatriz begoña bastien birgit bridget
camille carla carlos carmen charlotte chloe claire clara colin daniel david diego duncan edith elena elif elise emil emily
emma enzo erik esteban eva fatima felix fiona florian frank frauke gabriel george giulia gonzalo grace greta gwenaël hannah
hans harvey hassan hazel heike helen hugo ibrahim iker ines ingrid inès isabel ivan jack jacques james jan javier jean jonas
jorge joão jörg josé juan julia julie jürgen kai karin katrin kofi kwame lara laura lea leila leon leroy lucas lucie lucía
luis lukas lutz léa mara marco marcus maria marie mario marta martin mateo mathilde max maximilian maría mehmet mia michael
miguel milan mohammed monika moritz nadia natalie nicolas nina noah nora nuria océane olga oliver olivia omar oscar owen pablo
paul paula pedro peter petra pierre pilar priya quentin rafael raúl rebecca robert rosa rubén ruth samuel sandra sarah sergio
simon sofia solène sophie stefan susanne sven sören tariq tessa theo thomas tobias tomás torben ulrike ursula uwe valentina
victor vincent wei wolfgang yasmin yuki yusuf zoe zoé álvaro élodie émilie étienne aurélie manon maëlle gaël loïc benoît
""".split())  # fmt: skip
FOLDED = {fold(w) for w in GIVEN}
TITLES = set("mr mrs ms miss mx dr prof professor sir madam dame herr frau fraulein mme mlle madame monsieur mademoiselle sr sra srta senor senora senorita don dona dra".split())
PARTICLES = set("von van de del della di da dos du der den la le las los ten ter zu zum vom af av el al bin ibn y d".split())
#: Particles that are also prepositions.
PREPOSITIONS = {"von", "de", "del", "du", "da", "di", "d", "y", "vom", "zu", "zum", "af", "av"}
#: Words that hold no person although they begin with a capital letter beside a name.
MONTHS = set("january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split())

GAP = r"(?:[    ]{1,3}|[.\-‐-–/])"
DASH = r"[-‐-–]"
EMAIL = re.compile(r"""(?ix)
    (?<![\w.+-])[a-z0-9][\w.+%-]*
    (?: [ ]?(?:@|＠|&\#64;|&commat;)[ ]?  (?:[^\W_](?:[\w-]*[^\W_])?\.)+ [^\W\d_]{2,24}
      | \s*(?:\(at\)|\[at\]|\{at\}|<at>|\(a\)|\[a\]|\(arroba\)|\[arroba\]|\(@\)|\[@\])\s* [^\W_][\w-]*(?:(?:\s*(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\(punkt\)|\[punkt\]|\(punto\)|\(point\)|\[\.\]|\(\.\))\s*|\.)[^\W_][\w-]*)+
      | [ ]+at[ ]+ [^\W_][\w-]*(?:[ ]+dot[ ]+[^\W_][\w-]*)+
      | _at_[^\W_][\w-]*(?:(?:_dot_|\.)[a-z0-9][a-z0-9-]*)+
      | \s*\((?:at)\)\s*[^\W_][\w.-]*\.[a-z]{2,24} )
    (?![\w@])""")  # fmt: skip
AT_WORD = re.compile(r"(?i)(?<![\w.+-])(?=[\w.+-]*[\d._+-])[a-z0-9][\w.+-]*[a-z0-9][ ]+(?:at|arroba)[ ]+(?:[^\W_][\w-]*\.)+(?:com|org|net|test|example|invalid|de|es|fr|uk|io|eu)(?!\w)")
FILES = re.compile(r"(?i)\.(?:png|jpe?g|gif|svg|webp|bmp|tiff?|mp4|webm|js|css|html?|pdf|txt|json|csv|zip)$")

ID_CUE = re.compile(r"(?i)(?:\b(?:id|i\.d\.|ssn|itin|ni|nino|nin|dni|nie|nif|nir|tin|passport|reisepass|pasaporte|passeport|ausweis|personalausweis|steuer|tax|insurance|security|identity|sécu|identidad|identité|sozialversicherung\w*|seguridad social)\b|id_no|ausweisnr|steuer-?id)[\w\s.:=#°º/()'-]{0,24}\Z|\bdoc(?:umento)?[\s.:=#°º]{0,6}\Z")
PHONE_CUE = re.compile(r"(?i)(?:tel|tél|phone|fax|call|text me|whatsapp|mobile|móvil|movil|handy|ruf|llama|línea|line|rappelez|appelez|anruf|contact|ring|reach|left)[\w\s.:=#/()'-]{0,16}\Z")
PHONES = [re.compile(x) for x in (
    rf"\+\(?\d{{1,3}}\)?(?:{GAP}?\(0\))?(?:{GAP}?\d{{1,6}}){{2,7}}",
    rf"\b00[1-9]\d{{0,2}}(?:{GAP}\(0\))?(?:{GAP}\d{{1,9}}){{1,6}}|\b00[1-9]\d{{9,12}}",
    rf"\(\d{{3}}\){GAP}?\d{{3}}{GAP}?\d{{4}}|\b(?:1{GAP})?[2-9]\d\d{GAP}\d{{3}}{GAP}\d{{4}}|\b(?:1{GAP})?[2-9]\d\d{GAP}[2-9]\d{{6}}|\b1?[2-9]\d\d[2-9]\d{{6}}",
    rf"\(0\d{{1,4}}\){GAP}?\d{{2,6}}(?:{GAP}\d{{2,6}}){{0,3}}",
    rf"\b0[1-9](?:{GAP}\d\d){{4}}|\b0[1-9]\d\d(?:{GAP}\d\d){{3}}|\b0[1-9]\d{{8,9}}",
    rf"\b0[1-9]\d{{0,3}}{GAP}\d{{2,8}}(?:{GAP}\d{{2,6}}){{0,3}}",
    rf"\b0\d{{1,4}}/\d{{2,6}}[  ]{DASH}[  ]\d{{2,4}}|\b0\d{{2,4}}[  ]{DASH}[  ]\d{{3}}[  ]{DASH}[  ]\d{{3,4}}|(?:\+1[  ]{DASH}[  ])?\b[2-9]\d\d[  ]{DASH}[  ]\d{{3}}[  ]{DASH}[  ]\d{{4}}|\b(?:0034[  ]{DASH}[  ])?[5-9]\d\d[  ]{DASH}[  ]\d{{3}}[  ]{DASH}[  ]\d{{3}}",
    rf"\b[5-9]\d\d(?:{GAP}\d{{3}}){{2}}|\b[5-9]\d\d(?:{GAP}\d\d){{3}}|\b[5-9]\d{{8}}",
)]
IDS = [re.compile(x) for x in (
    rf"\b[A-Za-z]{{2}}(?:[  ]|{DASH})?\d\d(?:[  ]|{DASH})?\d\d(?:[  ]|{DASH})?\d\d(?:[  ]|{DASH})?[A-Da-d]\b",
    rf"\b[A-Za-z]{{2}}[  ]?\d{{7}}\b",
    rf"\b[XYZxyz]{DASH}?\d{{7}}{DASH}?[A-Za-z]\b|\b\d{{8}}{DASH}?[A-Za-z]\b|\b\d{{2}}\.\d{{3}}\.\d{{3}}{DASH}?[A-Za-z]\b|\b[A-Za-z]\d{{8}}[A-Za-z]\b|\b[A-Za-z]\d{{2}}[A-Za-z]\d{{5,6}}\b|\b\d{{2}}[A-Za-z]{{2}}\d{{5}}\b|\b[CFGHJKcfghjk][0-9CFGHJKLMNPRTVWXYZ]{{8}}\d?\b",
    rf"\b\d{{3}}(?:[  ]{{1,3}}|{DASH})\d\d(?:[  ]{{1,3}}|{DASH})\d{{4}}\b|\b9\d{{8}}\b",
    rf"\b\d\d[  ]{{1,3}}\d{{3}}[  ]{{1,3}}\d{{3}}[  ]{{1,3}}\d{{3}}\b|\b(?!1[2-9]\d\d[2-9])\d{{11}}\b",
    rf"\b[12](?:[  ]{{1,3}}\d\d){{3}}[  ]{{1,3}}\d{{3}}[  ]{{1,3}}\d{{3}}(?:[  ]{{1,3}}\d\d)?\b|\b[12]\d{{12}}(?:\d\d)?\b",
)]
#: 2 letters and 7 digits, and bare digits, are identity numbers of this shape only with a cue or without a thing before.
LOOSE = re.compile(r"^(?:[A-Za-z]{2}\s?\d{7}|\d{8,15})$")

UP = r"[A-ZÀ-ÖØ-Þ]"
WORDUP = rf"{UP}[\w'’]*(?:-(?:(?:sur|sous|en|le|la|les|lès|de|du|des|an|am|der|upon|on|del|d'|l')-)?{UP}[\w'’]*)*"
TOWN = rf"(?:Bad|Sankt|Saint|San|Santa|Port|Lower|Upper|Great|Little|North|South|East|West|New|Old|Alt|Neu|Ober|Unter|Villa|La|Le|Los|Las|El)[  ]{WORDUP}|{WORDUP}"
BREAK = r"(?:,?[  ]*\n[  ]*|,[  ]{1,3}|[  ]{1,3})"
TYPE_EN = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Row|Crescent|Cres|Boulevard|Blvd|Drive|Court|Ct|Place|Pl|Square|Sq|Terrace|Way|Close|Gardens|Walk|Mews|Highway|Hwy|Parkway|Grove|Hill|Rise|Wharf|Yard|Quay|Alley)"
STREETS = {
    "en": re.compile(rf"""(?x)(?<![\w.])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Floor)[ ]\w{{1,4}},[ ])?(?P<no>\d{{1,4}}[A-Za-z]?)[  ]{{1,3}}(?:[NSEW]\.?[ ]{{1,3}})?(?P<name>(?:{UP}[\w'’-]*[  ]{{1,3}}){{1,3}}{TYPE_EN})\b\.?
        (?:,[ ]{{1,3}}(?:Unit|Apt\.?|Apartment|Flat|Suite|Floor)[ ]{{1,3}}\w{{1,4}}\b)?"""),
    "de": re.compile(rf"""(?x)\b(?P<name>{UP}[\wäöüß-]*(?:stra(?:ß|ss)e|str\.|gasse|platz|weg|allee|ufer|ring|damm|markt|hof|steig|chaussee)|(?:{UP}[\wäöüß]+[ ]{{1,3}}){{1,2}}(?:Gasse|Stra(?:ß|ss)e|Str\.|Platz|Weg|Allee|Ufer|Ring|Damm|Markt|Hof|Steig)|(?:Am|An|Auf|Im|In|Zum|Zur)[ ](?:der[ ]|dem[ ])?{UP}[\wäöüß]+)[  ]{{1,3}}(?P<no>\d{{1,4}}(?:[ ]?[a-zA-Z])?)\b(?![.:]\d)"""),
    "es": re.compile(rf"""(?x)(?<!\w)(?P<name>(?:Calle|C/|C\.|Avda\.?|Avenida|Av\.|Camino|Paseo|P\.º|Plaza|Pza\.?|Ronda|Traves[ií]a|Carretera|Carrera|Glorieta)[  ]{{0,3}}(?:(?:de[ ](?:la|los|las)|del|de)[ ]{{1,3}})?{UP}[\w'’-]+(?:[  ]{{1,3}}{UP}[\w'’-]+){{0,3}}),?[  ]{{1,3}}(?:n\.?[ ]?[º°o]\.?[ ]{{0,3}}|núm\.?[ ])?(?P<no>\d{{1,4}}[a-z]?)\b
        (?:,[ ]{{0,3}}\d{{1,2}}\.?[ ]?[ºª°](?:[ ]{{0,3}}(?:{UP}\b|izq\w*|dcha|der\w*))?)?"""),
    "fr": re.compile(rf"""(?x)(?<![\w.])(?P<no>\d{{1,4}}(?:[ ]{{1,3}}(?:bis|ter|quater)\b)?),?[  ]{{1,3}}(?P<name>(?:rue|avenue|av\.|bd|boulevard|place|pl\.|chemin|quai|impasse|all[ée]e|cours|route|passage|square|ruelle|faubourg|sentier|villa)[ ]{{1,3}}(?:(?:du|des|de[ ]la|de[ ]l['’]|de|d['’])[ ]{{0,3}})?{UP}[\w'’-]+(?:(?:[  ]{{1,3}}|-){UP}[\w'’-]+){{0,3}})"""),
}
TAIL = re.compile(rf"{BREAK}(?:(?:[A-Z]{{1,2}}-)?(?P<zip>\d{{4,5}})[  ]{{1,3}})?(?P<town>{TOWN})(?:[  ]{{1,3}}(?P<zip2>\d{{5}}|[A-Z]{{1,2}}\d{{1,2}}[A-Z]?[ ]\d[A-Z]{{2}}))?\b")
#: Words with accents set apart as well.
LETTERS = r"[^\W\d_][^\W\d_\u0300-\u036f]*(?:[\u0300-\u036f]+[^\W\d_]*)*"
TOKEN = re.compile(rf"{LETTERS}(?:['’\-‐‑]{LETTERS})*")


def cells(word: str) -> list[int]:
    """A word's two cells, one in each half of a table; its count is the lesser of theirs (a count-min sketch)."""
    h = xxhash.xxh3_64_intdigest(word)
    return [h & (CELLS - 1), CELLS + (h >> 32 & (CELLS - 1))]


def counted(table: np.ndarray, word: str) -> np.ndarray:
    a, b = cells(word)
    return np.minimum(table[..., a], table[..., b])


def shape(word: str) -> str:
    word = re.sub("[\u0300-\u036f]", "", word)
    return "u" if len(word) > 1 and word.isupper() else "l" if word.islower() else "c" if word[0].isupper() else "m"


def low(word: str) -> str:
    w = fold(word)
    for end in ("'s", "’s"):
        if w.endswith(end):
            return w[:-2]
    return w


def ends(word: str) -> list[str]:
    """The beginnings and endings by which a word is judged."""
    w = word.rsplit("-", 1)[-1].split("'")[-1].split("’")[-1]
    return ["p3|" + w[:3], "p4|" + w[:4], "s3|" + w[-3:], "s4|" + w[-4:], "s5|" + w[-5:]] if len(w) >= 4 else []


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Empty ones: six counts of words, two of word ends (of names, of other words), three of places and lead words."""
    return np.zeros((6, 2 * CELLS), np.int64), np.zeros((2, 2 * CELLS), np.int64), np.zeros((3, 2 * CELLS), np.int64)


def is_given(w: str) -> bool:
    """A given name of the seeds; of a double name the first part counts."""
    return w in FOLDED or "-" in w and w.split("-")[0] in FOLDED


DIGIT = re.compile(r"\d")
AT = re.compile(r"(?i)＠|&#64;|&commat;|\bat\b|arroba|_at_|\(a\)|\[a\]")


def near_digits(text: str, before: int = 6, after: int = 12) -> Iterator[tuple[int, int]]:
    """Stretches of the text around its digits, joined where they touch.

    The forms of numbers lie within them whole: none has more than 6 characters before its first digit, 12 after its
    last, or 18 between two.
    """
    a = b = -1
    for m in re.finditer(r"\d+", text):
        if m.start() - before > b:
            if b >= 0:
                yield a, b
            a = max(0, m.start() - before)
        b = m.end() + after
    if b >= 0:
        yield a, min(b, len(text))


def lines_with_digits(text: str) -> Iterator[tuple[int, int]]:
    """Whole lines that hold a digit; no street with its number goes over a line's end."""
    at = 0
    while m := DIGIT.search(text, at):
        a = text.rfind("\n", 0, m.start()) + 1
        b = text.find("\n", m.end())
        b = len(text) if b < 0 else b
        yield a, b
        at = b


def lead_of(text: str, at: int) -> str:
    """The word that leads in what begins at a place, in folded letters: blanks, signs and "no." may stand between, no end of a sentence."""
    word = ""
    while not word or word in ("no", "nr"):
        while at and text[at - 1] in " \u00a0:#-=(\"'":
            at -= 1
        if not word and text[max(0, at - 3) : at].lower() in ("no.", "nr."):
            at -= 1
        end = at
        while at and text[at - 1].isalpha():
            at -= 1
        if at == end:
            break
        word = fold(text[at:end])
    return word


class Lexicon:
    """What the collection says of words: tables of counts by cell."""

    def __init__(self, words: np.ndarray, parts: np.ndarray, places: np.ndarray) -> None:
        # words: all uses, in small letters, after a title or initial, in an address's local part, beside a given name, before a family name
        # places: streets and towns; sure numbers after a lead word, all numbers after it
        self.words, self.parts, self.places = words, parts, places
        n = max(1, int(words[0].sum()))
        # in a small collection of little but names their share would hide what they disclose
        self.base, self.before = [min(2**-7, max(1e-9, x / n)) for x in (words[2:5].sum(), words[5].sum())]
        self.noise = words[1].sum() / CELLS
        self.sure = (places[1].sum() + 1) / (places[2].sum() + 2)
        p, q = parts.astype(float).sum(axis=1) + 1
        self.rate = float(np.log(q / p))
        self.seen: dict[str, tuple[bool, float]] = {}
        self.names: dict[str, bool] = {}

    def facts(self, w: str) -> tuple[bool, float]:
        """Whether the word is an ordinary one; the bits it discloses about a person, by itself or by its ends."""
        f = self.seen.get(w)
        if f is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            n, small, title, local, beside, _ = counted(self.words, w)
            named = title + local + beside
            ordinary = small >= max(2, self.noise) and small * 4 >= n and named * 3 < n
            bits = 0.0
            for e in ends(w):
                yes, no = counted(self.parts, e)
                bits += float(np.log((yes + 0.3) / (no + 0.3)) + self.rate) / np.log(2)
            own = float(np.log2(max(named, 0.5) / max(n + local, 1) / self.base))
            if n >= OFTEN:
                bits = own if named >= 2 else min(own, 0.0)
            elif named >= 2:
                bits = max(bits, own)
            f = self.seen[w] = (ordinary, bits)
        return f

    def given(self, w: str) -> bool:
        """A seed, or a word that stands before family names far more often than words do."""
        g = self.names.get(w)
        if g is None:
            if len(self.names) > 100_000:
                self.names.clear()
            n, small, _, local, _, before = counted(self.words, w)
            learned = before >= 2 and small * 2 < n and np.log2(before / max(n, 1) / self.before) >= DISCLOSURE and (before + local) * 4 >= n
            g = self.names[w] = is_given(w) or bool(learned)
        return g

    def family(self, word: str, frame: float) -> bool:
        """Whether word and frame together disclose enough for a family name; of a double name each part, or the whole."""
        w = low(word)
        if len(w) < 3 or w in TITLES or w in MONTHS or is_given(w):
            return False
        for i, part in enumerate(re.split(r"[-‐‑]", w)):
            ordinary, bits = self.facts(part)
            if ordinary or bits + (frame if i == 0 else BESIDE) < DISCLOSURE:
                ordinary, bits = self.facts(w)
                return not ordinary and bits + frame >= DISCLOSURE
        return True

    def place(self, name: str) -> bool:
        return counted(self.places, " ".join(name.lower().split()))[0] >= 2

    def lead(self, word: str) -> float:
        """Bits that a lead word adds to a number after it; 0 for words that mostly lead in other things."""
        _, sure, numbers = counted(self.places, "~" + word)
        if numbers * 16 < counted(self.words, word)[0]:
            return 0.0
        return float(np.log2((sure + 4 * self.sure) / (numbers + 4) / self.sure))


def french(text: str) -> bool:
    words = re.findall(r"\b(?:le|la|les|des|une|est|pas|du|sur|et|de|trop|the|is|and|was|of|der|die|und|el|los|una)\b", text.lower())
    return sum(w in ("le", "les", "des", "une", "est", "pas", "du", "sur", "et", "trop", "la", "de") for w in words) * 2 > len(words)


def trimmed(text: str, a: int, b: int, lead: str = "") -> tuple[int, int]:
    while a < b and not text[a].isalnum() and text[a] not in lead:
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return a, b


def in_path(text: str, at: int) -> bool:
    """Whether a place lies in an address of the web: // in the run of characters before it."""
    at -= 1
    while at > 0 and not text[at].isspace():
        if text[at] == "/" and text[at - 1] == "/":
            return True
        at -= 1
    return False


class Finder:
    """All mentions of a text as (start, end, kind)."""

    def __init__(self, lexicon: Lexicon | None) -> None:
        self.lexicon = lexicon

    def mentions(self, text: str) -> list[tuple[int, int, str]]:
        found: list[tuple[int, int, str]] = []
        taken = bytearray(len(text))

        def add(a: int, b: int, kind: str, lead: str = "") -> bool:
            a, b = trimmed(text, a, b, lead)
            if a >= b or any(taken[a:b]):
                return False
            taken[a:b] = b"\1" * (b - a)
            found.append((a, b, kind))
            return True

        if "@" in text or AT.search(text):
            self.emails(text, add)
        if DIGIT.search(text):
            self.addresses(text, add)
            self.numbers(text, add)
        self.names(text, taken, add)
        return sorted(found)

    @staticmethod
    def emails(text: str, add) -> None:
        for pattern in (EMAIL, AT_WORD) if SURE >= DISCLOSURE else ():  # an address names its owner
            for m in pattern.finditer(text):
                if not FILES.search(m[0]):
                    a = m.start() + (7 if m[0].lower().startswith("mailto:") else 0)
                    add(a, m.end(), "email")

    def numbers(self, text: str, add) -> None:
        hits, parts, lexicon = [], list(near_digits(text)), self.lexicon
        for kind, patterns in (("phone", PHONES), ("id_number", IDS)):
            for i, p in enumerate(patterns):
                for m in (m for x, y in parts for m in p.finditer(text, x, y)):
                    a, b = m.span()
                    # a number doesn't begin or end within a longer one, a word or a path
                    before, after = text[max(0, a - 40) : a], text[b : b + 2]
                    if re.search(r"(?:[\w@#&$+]|\d[.:,/\-‐-–]|[A-Za-z][-_])\Z", before) or in_path(text, a) or re.match(r"[\w@%]|[:/\-‐-–,.]\d", after):
                        continue
                    digits = sum(c.isdigit() for c in m[0])
                    if kind == "phone" and not 8 <= digits <= 15:
                        continue
                    cue = bool(ID_CUE.search(before))
                    call = bool(PHONE_CUE.search(before))
                    sure = m[0][0] in "+("
                    told = 0.0 if sure or lexicon is None else lexicon.lead(lead_of(text, a))
                    # a word that labels other numbers takes precedence over what stands before it
                    if (SURE if sure or (cue or call) and told > -2 else LOOSE_FORM) + told < DISCLOSURE:
                        continue
                    if kind == "id_number" and LOOSE.match(m[0]) and call and not cue and m[0][0].isdigit():
                        continue
                    weight = (cue and kind == "id_number") * 4 + (call and not cue and kind == "phone") * 3 + (kind == "phone" and (m[0][0] in "+(" or i in (0, 3))) * 2 + (kind == "id_number" and i in (0, 2, 3, 4, 5)) * 1
                    hits.append((-weight, -(b - a), a, b, kind))
        for _, _, a, b, kind in sorted(hits):
            add(a, b, kind, "+(")

    def addresses(self, text: str, add) -> None:
        lex = self.lexicon
        parts = list(lines_with_digits(text))
        for p in STREETS.values() if SURE >= DISCLOSURE else ():
            for a, b in parts:
                for m in p.finditer(text, a, b):
                    add(m.start(), self.address_end(text, m.end()), "street_address")
        if lex is None or LOOSE_FORM < DISCLOSURE:
            return
        # other spellings of letters: the same forms, if the collection knows the street
        for p in ANY_CASE.values():
            for a, b in parts:
                for m in p.finditer(text, a, b):
                    if lex.place(m["name"]):
                        add(m.start(), self.address_end(text, m.end()), "street_address")

    def address_end(self, text: str, at: int) -> int:
        lex, best = self.lexicon, at
        for p in (TAIL, ANY_TAIL):
            m = p.match(text, at)
            if not m:
                continue
            town, end = m["town"], m.end()
            words = list(re.finditer(r"[^\s]+", town))
            if lex is not None:
                # the longest start of the town that the collection knows
                for k in range(len(words), 0, -1):
                    if lex.place("@" + town[: words[k - 1].end()].rstrip(".,;:!?)")):
                        if k == len(words):
                            return end
                        return m.start("town") + words[k - 1].end()
            if p is TAIL and (m["zip"] or m["zip2"] or re.match(r"[ ,]", text[at : at + 1]) and "," in text[at : m.start("town")]):
                if lex is None or m["zip"] or m["zip2"] or not lex.facts(town.split()[0].lower())[0]:
                    best = max(best, end)
                    if m["zip"] or m["zip2"]:
                        return end
        return best

    def names(self, text: str, taken: bytearray, add) -> None:
        lex = self.lexicon
        tokens = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text) if not taken[m.start()]]
        fr = None
        i, n = 0, len(tokens)

        def gap(k: int) -> str:
            return text[tokens[k][1] : tokens[k + 1][0]] if k + 1 < n else "\0"

        def blank(g: str) -> bool:
            return g != "" and g.strip("  \t") == "" and len(g) <= 3

        def surname(k: int, firm: bool) -> int | None:
            """Index of the last token of particles and family name from token k on."""
            j = k
            while j < n and low(tokens[j][2]) in PARTICLES and blank(gap(j)) and j - k < 3:
                j += 1
            if j >= n:
                return None
            w = tokens[j][2]
            if lex.family(w, FIRM if firm or shape(w) not in "cu" else BESIDE):
                return j
            return None

        def bare_end(k: int) -> int:
            w = tokens[k][2]
            return tokens[k][1] - (2 if w[-2:] in ("'s", "’s", "'S", "’S") else 0)

        lows = [low(w) for _, _, w in tokens]
        begins = bytearray(n + 4)
        for k, l in enumerate(lows):
            if l in TITLES or l == "m":
                begins[k] = 1
            elif len(l) == 1:
                begins[k] |= tokens[k][2].isupper()
                if tokens[k][2].isupper() and text[tokens[k][1] : tokens[k][1] + 1] == ".":
                    for j in range(max(0, k - 4), k):  # a family name with particles before an initial
                        begins[j] = 1
            elif lex.given(l):
                begins[k] = 1
                for j in range(max(0, k - 4), k):  # a family name with particles before a given name
                    begins[j] = 1
        while True:
            i = begins.find(1, i)
            if not 0 <= i < n:
                break
            a, b, w = tokens[i]
            l = lows[i]
            g = gap(i)
            # titles, one or several
            if l in TITLES and re.fullmatch(r"\.?[  ]{1,3}", g) or w == "M" and re.fullmatch(r"\.[  ]{1,3}", g):
                if w == "M" and fr is None:
                    fr = french(text)
                if w != "M" or fr:
                    j = i + 1
                    while j < n and low(tokens[j][2]) in TITLES and re.fullmatch(r"\.?[  ]{1,3}", gap(j)):
                        j += 1
                    if j < n:
                        k = self.person(tokens, text, j, gap, blank, surname)
                        if k is None:
                            k = surname(j, False)
                            if k is None and shape(tokens[j][2]) == "c" and not (f := lex.facts(low(tokens[j][2])))[0] and f[1] + TITLED >= DISCLOSURE and l != "don":
                                k = j if len(tokens[j][2]) > 3 else None
                        if k is not None:
                            add(tokens[j][0], bare_end(k), "person_name")
                            i = k + 1
                            continue
            k = self.person(tokens, text, i, gap, blank, surname)
            if k is not None:
                add(a, bare_end(k), "person_name")
                i = k + 1
                continue
            i += 1

    def person(self, tokens, text, i, gap, blank, surname) -> int | None:
        """Index of the last token of a name that begins at token i, or None."""
        lex, n = self.lexicon, len(tokens)
        w = tokens[i][2]
        l, g = low(w), gap(i)
        # J. Family, and J.Family
        if len(w) == 1 and w.isupper() and re.fullmatch(r"\.[  ]{0,3}", g) and i + 1 < n:
            j = i + 1
            while j + 1 < n and len(tokens[j][2]) == 1 and tokens[j][2].isupper() and re.fullmatch(r"\.[  ]{0,3}", gap(j)):
                j += 1
            return surname(j, True)
        if lex.given(l) and i + 1 < n:
            if blank(g):
                j = i + 1
                # a second given name or initials
                while j + 1 < n and len(tokens[j][2]) == 1 and tokens[j][2].isalpha() and re.fullmatch(r"\.?[  ]{0,3}", gap(j)):
                    j += 1
                if j + 1 < n and lex.given(low(tokens[j][2])) and blank(gap(j)):
                    k = surname(j + 1, True)
                    if k is not None:
                        return k
                k = surname(j, False)
                if k is not None:
                    return k
        # Family, Given and FAMILY Given, with particles before the family name
        j = i
        while j < n and low(tokens[j][2]) in PARTICLES and blank(gap(j)) and j - i < 3:
            j += 1
        if j == i + 1 and l in PREPOSITIONS and i and blank(gap(i - 1)) and shape(tokens[i - 1][2]) == "l" and not lex.given(low(tokens[i - 1][2])):
            return None  # "the picture comes from FAMILY Given": a preposition, no part of the name
        if j + 1 < n:
            f, g = tokens[j][2], gap(j)
            if (re.fullmatch(r",[  ]{0,3}", g) or blank(g)) and lex.given(low(tokens[j + 1][2])) and not lex.given(low(f)):
                firm = not (shape(f) == "u" and shape(tokens[j + 1][2]) == "c" and blank(g))
                if lex.family(f, FIRM if firm else BESIDE) and not (blank(g) and j + 2 < n and blank(gap(j + 1)) and lex.family(tokens[j + 2][2], FIRM) and shape(f) == "c"):
                    return j + 1
            # Family, J. and Family J., but not before J. Family
            if (re.fullmatch(r",[  ]{0,3}", g) or blank(g)) and shape(f) in "cu" and not lex.given(low(f)):
                k = j
                while k + 1 < n and len(tokens[k + 1][2]) == 1 and tokens[k + 1][2].isupper() and text[tokens[k + 1][1] : tokens[k + 1][1] + 1] == "." and (k == j or re.fullmatch(r"\.[  ]{0,3}", gap(k))):
                    k += 1
                if k > j and lex.family(f, FIRM) and not (k + 1 < n and re.fullmatch(r"\.[  ]{0,3}", gap(k)) and surname(k + 1, True) is not None):
                    return k
        return None


def _any_case(pattern: re.Pattern) -> re.Pattern:
    return re.compile(pattern.pattern, re.I)


ANY_CASE = {k: _any_case(p) for k, p in STREETS.items()}
ANY_TAIL = re.compile(rf"{BREAK}(?:(?P<zip>\d{{5}})[  ]{{1,3}})?(?P<town>[^\W\d_][\w'’-]*(?:[  ][^\W\d_][\w'’-]*)?)(?:[  ]{{1,3}}(?P<zip2>\d{{5}}))?(?!\w)")


USES, SMALL, TITLE, LOCAL, PLACE, SURE_NUMBER, NUMBER, PAIR = range(8)
#: Anything with seven digits or more that may be a number of a person.
NUMBERISH = re.compile(r"(?<![\w.,/+-])(?:\+|00|\(|[A-Za-z]{1,2}[  -]?)?\d(?:[  .\-‐-–/()]{0,3}\d){5,}")


def evidence(text: str) -> Iterator[tuple[str, int]]:
    """(term, kind) for the statistics: words, streets and towns, ~lead words, and pairs of names as given TAB family."""
    loud = text.isupper()
    # passages without any capital say nothing of a word's usual letters
    small = bytearray(len(text))
    for m in re.finditer(r"[^.!?\n]+", text):
        if m[0].islower():
            small[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    mailed = bytearray(len(text))
    if "@" in text or AT.search(text):
        mails: list[tuple[int, int]] = []
        Finder.emails(text, lambda a, b, kind: mails.append((a, b)))
        for a, b in mails:
            mailed[a:b] = b"\1" * (b - a)
            local = re.match(r"[\w.%-]*", fold(text[a:b]))[0].partition("_at_")[0]
            for w in re.findall(r"[^\W\d_]{3,}", local):
                yield w, LOCAL
    tokens = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text) if not mailed[m.start()]]
    lows = [low(w) for _, _, w in tokens]
    for k, (a, b, w) in enumerate(tokens):
        l = lows[k]
        s = shape(w) if w[0].isupper() else "l"
        title = False
        if s in "cu" and not loud and len(l) > 2 and l not in TITLES and k:
            g = text[tokens[k - 1][1] : a]
            title = lows[k - 1] in TITLES and re.fullmatch(r"\.?[ \u00a0]{1,3}", g) or len(lows[k - 1]) == 1 and tokens[k - 1][2].isupper() and re.fullmatch(r"\.[ \u00a0]{0,3}", g)
            p = lows[k - 1]
            if len(p) > 2 and p not in TITLES and tokens[k - 1][2][0].isupper():
                if g in (" ", "\u00a0", "  "):
                    yield f"{p}\t{l}", PAIR
                    if shape(tokens[k - 1][2]) == "u" and s == "c":
                        yield f"{l}\t{p}", PAIR
                elif g in (", ", ","):
                    yield f"{l}\t{p}", PAIR
        for p in (l, *l.split("-")) if "-" in l else (l,):
            yield p, USES
            if s == "l" and not small[a]:
                yield p, SMALL
            if title:
                yield p, TITLE
    if DIGIT.search(text):
        for m in NUMBERISH.finditer(text):
            if lead := lead_of(text, m.start()):
                yield "~" + lead, NUMBER
                before = text[max(0, m.start() - 40) : m.start()]
                if m[0][0] in "+(" or ID_CUE.search(before) or PHONE_CUE.search(before):
                    yield "~" + lead, SURE_NUMBER
        for p in STREETS.values():
            for x, y in lines_with_digits(text):
                for m in p.finditer(text, x, y):
                    yield " ".join(m["name"].lower().split()), PLACE
                    t = TAIL.match(text, m.end())
                    if t and (t["zip"] or t["zip2"] or "," in text[m.end() : t.start("town")]):
                        yield "@" + " ".join(t["town"].lower().split()), PLACE


def packed(group: tuple) -> list[tuple]:
    """Tables as they travel: the cells that count anything."""
    return [(t.shape, at.astype(np.int32), t.ravel()[at]) for t in group for at in [np.flatnonzero(t)]]


def unpacked(parts: list[tuple]) -> tuple:
    out = []
    for shape, at, n in parts:
        t = np.zeros(shape, np.int64)
        t.ravel()[at] = n
        out.append(t)
    return tuple(out)


def word_cells(word: str, n: np.ndarray, words: np.ndarray, places: np.ndarray) -> None:
    """Adds a term's counts by kind to the tables."""
    if "\t" in word:
        return
    own = cells(word)
    places[:, own] += n[PLACE : NUMBER + 1][[0, 1, 2], None]
    words[:4, own] += n[: LOCAL + 1, None]


def end_cells(word: str, lexicon: Lexicon, parts: np.ndarray) -> None:
    """Counts the ends of a word as those of a name, of another word, or not at all."""
    n, small, title, local, beside, _ = counted(lexicon.words, word)
    named = title + local + beside
    if n:
        side = 0 if named * 2 >= n and small * 4 < n else 1 if small * 4 >= n or not named and n >= 5 else None
        if side is not None:
            parts[side, [c for e in ends(word) for c in cells(e)]] += 1


def pair_cells(pair: str, n: int, lexicon: Lexicon, words: np.ndarray, column: int) -> None:
    """Carries evidence over a pair: to the word before a family name (column 5), or to the one beside a given name (4)."""
    given, family = pair.split("\t")
    if column == 5:
        if given not in MONTHS and lexicon.facts(family)[1] + FIRM >= DISCLOSURE and lexicon.family(family, FIRM) and not lexicon.facts(given)[0]:
            words[5, cells(given)] += n
    elif lexicon.given(given) and not lexicon.given(family):
        for p in (family, *family.split("-")) if "-" in family else (family,):
            words[4, cells(p)] += n


def _counted(documents: DataFrame, text: str, words, columns: int) -> DataFrame:
    """Sums per word of what words(texts) yields, as (word, n0, n1, ...); gathered in each task before the shuffle."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        of = words()

        def flush() -> pa.RecordBatch:
            c = np.array(list(counts.values()), np.int64).reshape(-1, columns)
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *[pa.array(c[:, j]) for j in range(columns)]], names=["word", *[f"n{j}" for j in range(columns)]])

        for b in batches:
            for t in b.column(0).to_pylist():
                for w, kind in of(t):
                    counts.setdefault(w, [0] * columns)[kind] += 1
            if len(counts) > 200_000:
                yield flush()
                counts.clear()
        yield flush()

    spec = "word string, " + ", ".join(f"n{j} bigint" for j in range(columns))
    return documents.where(F.col(text).isNotNull()).select(text).mapInArrow(gather, spec).groupBy("word").agg(*[F.sum(f"n{j}").alias(f"n{j}") for j in range(columns)])


def learned(documents: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lexicon's tables, counted over all documents; the rounds after the first read terms and pairs only."""
    per = _counted(documents, text, lambda: evidence, PAIR + 1).persist(StorageLevel.DISK_ONLY)
    spec, shapes = "t int, cell int, n bigint", [len(t) for t in tables()]

    def collected(fill, frame: DataFrame) -> list[np.ndarray]:
        """Tables filled by fill(rows, words, parts, places) in every task and added up: 11 of 2 CELLS cells at most."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = tables()
            for b in batches:
                fill(b.column("word").to_pylist(), np.array([b.column(f"n{j}").to_numpy() for j in range(PAIR + 1)]), own)
            for t, table in enumerate(row for group in own for row in group):
                at = np.nonzero(table)[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(at.astype(np.int32)), pa.array(table[at])], names=["t", "cell", "n"])

        got = frame.mapInArrow(run, spec).groupBy("t", "cell").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros((sum(shapes), 2 * CELLS), np.int64)
        out[got.column("t").to_numpy(), got.column("cell").to_numpy()] = got.column("n").to_numpy()
        return np.split(out, np.cumsum(shapes)[:-1])

    def count(terms, n, own):
        for k, w in enumerate(terms):
            word_cells(w, n[:, k], own[0], own[2])

    def with_lexicon(now: tuple, frame: DataFrame, each) -> list[np.ndarray]:
        """collected, where each(terms, n, own, lexicon) is told what is known by now."""
        shared = documents.sparkSession.sparkContext.broadcast(packed(now))
        seen: list[Lexicon] = []

        def fill(terms, n, own):
            if not seen:
                seen.append(Lexicon(*unpacked(shared.value)))
            each(terms, n, own, seen[0])

        out = collected(fill, frame)
        shared.destroy()
        return out

    def carry(column: int):
        def each(terms, n, own, lexicon):
            for k, pair in enumerate(terms):
                pair_cells(pair, int(n[PAIR, k]), lexicon, own[0], column)

        return each

    def word_ends(terms, n, own, lexicon):
        for w in terms:
            end_cells(w, lexicon, own[1])

    pairs, single = per.where(F.col(f"n{PAIR}") > 0), per.where(F.col(f"n{USES}") > 0)
    words, parts, places = collected(count, per)
    for last in (False, True):
        parts = with_lexicon((words, parts, places), single, word_ends)[1]
        words[5] = with_lexicon((words, parts, places), pairs, carry(5))[0][5]
        if not last:
            words[4] = with_lexicon((words, parts, places), pairs, carry(4))[0][4]
    per.unpersist()
    return words, parts, places


def _finder(tables: list[tuple]) -> Finder:
    return Finder(Lexicon(*unpacked(tables)))


def personal_mentions(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, found_text): the distinct mentions of each document, as written.

    Null texts and keys have none; empty tables give no rows; texts are read whole, whatever their length.
    """
    shared = documents.sparkSession.sparkContext.broadcast(packed(learned(documents, text)))
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(shared.value)
        for b in batches:
            rows = []
            for i, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist()):
                rows += [(i, k, t[a:z]) for a, z, k in find.mentions(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], x) for j, x in enumerate((b.schema.field("k").type, pa.string(), pa.string()))], names=["doc_id", "kind", "found_text"])

    src = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return src.mapInArrow(run, f"doc_id {kind}, kind string, found_text string").distinct()


def sanitised(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_replaced): every text with [KIND] in the place of each mention, otherwise unchanged; null texts stay null."""
    shared = documents.sparkSession.sparkContext.broadcast(packed(learned(documents, text)))
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(shared.value)
        for b in batches:
            out, counts = [], []
            for t in b.column("t").to_pylist():
                if t is None:
                    out.append(None)
                    counts.append(0)
                    continue
                pieces, at = [], 0
                found = find.mentions(t)
                for a, z, k in found:
                    pieces += [t[at:a], f"[{k.upper()}]"]
                    at = z
                out.append("".join(pieces) + t[at:])
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(out, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "text", "n_replaced"])

    return documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"doc_id {kind}, text string, n_replaced int")
