"""Problem 5: personal information in free text, found and replaced by typed placeholders.

Weak supervision.  Generous patterns propose candidate spans of five types.  Labelers vote on
each: patterns, the gazetteer of given names, context words before and behind, signs of what
is not personal.  Expectation-maximisation over the counts of vote patterns, taken over all
candidates of all rows, estimates every labeler's reliability without labels.  Its posteriors train a
logistic span classifier on hashed features (votes, neighbouring words, shape, word endings), on a
bounded sample of ``TRAIN_SPANS`` candidates a type; the classifier decides on every candidate.

Null and empty texts have no candidates.  Line breaks inside node spans count as spaces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, span_text

TYPES = ("name", "email", "phone", "id_number", "address")
PLACEHOLDER = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]"}
#: Candidates a type that train the final classifier, at most.
TRAIN_SPANS = 15_000
FEATURES = 1 << 13

# Letters of the languages in use.
U = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪĶŁĻŃŅŇŐŒŘŚŞŠŢŤŪŮŰŹŻŽА-ЯЁ"
L = "a-zß-öø-ÿāăąćčďđēęěğģīķłļńņňőœřśşšţťūůűźżžа-яё'’"
_CAP = f"(?:[{U}][{L}]+(?:-[{U}][{L}]+)*)"

# Words of streets, before a name, at its end, and prepositions that places take.
_STREET_BEFORE = r"calle|c/|avda\.?|avenida|plaza|paseo|camino|carrera|via|viale|piazza|corso|largo|vicolo|strada|ul\.|ulica|al\.|aleja|pl\.|plac|os\.|ул\.|улица|пер\.|переулок|пр\.|просп\.|проспект|пл\.|б-р|шоссе|наб\."
_PLACE_BEFORE = r"an\sder|am|auf\sder|im|in\sder|aan\sde|aan\shet|op\sde"
_STREET_ENDS = r"straat|weg|laan|plein|gracht|kade|dijk|singel|str\.|straße|strasse|gasse|platz|allee|ufer|ring|damm"
_NUMBER_FIRST = (
    r"\b\d{1,5}(?:\s?(?:bis|ter)|[a-z](?![a-z]))?,?\s+(?:(?:rue|av\.|avenue|boulevard|bd\.?|place|chemin|impasse|quai|allée|cours|route)\s[^\d,;:()]{2,40}"
    r"|(?:[\w'’.\-]+\s){1,3}(?:street|str?\.?|road|rd\.?|lane|ln\.?|avenue|ave\.?|drive|dr\.?|close|court|ct\.?|way|square|terrace|crescent|place|boulevard|blvd\.?)\b)"
)
# What each way to write an address must hold, in lower case; cheaper than the whole pattern.
_ADDRESS_SIGNS = [
    re.compile(x) for x in (_NUMBER_FIRST, rf"\b(?:{_STREET_BEFORE})\s", rf"(?:{_STREET_ENDS})\s\d", rf"\b(?:{_PLACE_BEFORE})\s[^\d;:()@]{{2,40}}\d", r"\d\s?[a-z]?,\s(?:\d\d|\w)")
]
# Titles that a single name may follow.
_TITLES = "Mr|Mrs|Ms|Dr|Prof|Herrn?|Frau|M|Mme|Mlle|Monsieur|Madame|Sra?|Don|Doña|Sig|Signora?|Dhr|Mevr|Pani?|[Гг]осподин|[Гг]оспожа|[Гг]-н|[Гг]-жа"
_CANDIDATES = {
    "email": re.compile(r"(?<![\w.+%\-])[\w.+%\-]+\s?(?:@|[(\[{]\s?at?\s?[)\]}]|\sat\s|＠)\s?[\w\-]+(?:(?:\.|\s?(?:[(\[{]\s?(?:dot|punkt)\s?[)\]}])\s?|\sdot\s)[\w\-]+)+", re.I),
    "phone": re.compile(r"(?<![\w/.,:@=²³\-])(?:\(?\+\d|\(?0|[1-9(])[\d() ./\-‐-–]{4,22}\d(?![\w/]|-[A-Za-z])"),
    "id_number": re.compile(r"(?<![\w/@=\-])(?=[A-Z0-9 .\-]{0,24}\d)[A-Z0-9](?:[A-Z0-9]|[ .\-](?=[A-Z0-9])){6,24}(?![\w/@])"),
    "address": re.compile(
        rf"""(?xi)
        (?: \b(?:flat|apt\.?|unit|suite)\s\d+\w?,?\s )? {_NUMBER_FIRST}
        | \b(?:{_STREET_BEFORE}|{_PLACE_BEFORE})\s(?:(?!\.\s)[^\d;:()@]){{2,40}}?,?\s(?:n\.\s?|nr\.?\s?|no\.?\s?|д\.\s?|дом\s)?\d{{1,4}}[a-zа-я]?\b
        | \b[\w\-]{{0,40}}(?:{_STREET_ENDS})\s\d{{1,4}}[a-z]?\b
        | (?-i:\b[{U}][{L}.\-]+(?:\s[{U}{L}][{L}.\-]*){{1,3}},?\s\d{{1,4}}\s?[a-z]?(?=,\s(?:\d{{2}}-?\d{{2,4}}\b|[A-Z]{{1,2}}-?\d|[{U}][{L}])))
        """  # the last: any street, beside a place or a telling word
    ),
    "name": re.compile(rf"(?<![\w.@’'\-]){_CAP}(?:,?\s(?:[{U}]\.|(?:von|van|de|der|den|di|del|della|da|le|la|ter)(?=\s[{U}])|{_CAP}))+(?![\w@])|(?<![\w.@\-])[{U}]{{3,}}(?:-[{U}]+)?,?\s[{U}]{{3,}}(?:-[{U}]{{3,}})?(?![\w@])|(?<=\s){_CAP}(?=[,:!]?$)|\b(?:{_TITLES})\.?\s{_CAP}(?![\w@])"),
}

# Words around personal data in eight languages.
_PHONE_CUE = re.compile(r"(?i)(?:\b(?:tel|tél|fax|phone|telephone|telefon|telefono|teléfono|téléphone|telefoon|tfno|tlf|mobile?|handy|cell|portable|komórka|call|ring|bel|rufen sie|appelez(?: le)?|appeler(?: le)?|llame al|llamar al|chiamare(?: il)?|chiami(?: il)?|dzwonić|zadzwonić|zadzwoń|тел|факс|телефон|звоните|позвоните|моб)\b[^\w+(]{0,4}(?:\w{1,8}\W{1,2}){0,2})$")
_NOT_NUMBER = re.compile(
    r"(?i)(?:\b(?:isbn|issn|iban|bic|typ|type|model|file(?: number)?|item|ref|réf|rif|dossier|aktenzeichen|vorgang|posten|expediente|partida|numer(?: akt)?|sygn|pozycja|pratica|voce|kenmerk|номер(?: дела)?|шифр|позиция|article|order|invoice|bestell\w*|rechnung\w*|n°|nr|no|art|id=|v|version|rev|build|serial|seriennummer|eur|usd|gbp|kg|page|seite|see|§|sku|ean|lot|batch|charge)\b\.?[\s:№#=]*)$"
)
_NOT_AFTER = re.compile(r"(?i)^\s*(?:eur|usd|gbp|pln|rub|€|\$|£|kg|kw|ml|mm|cm|km|m²|°|%|n\b|s\b|e\b|w\b|pieces|stück|,\s?\d|:\d)")
_ID_CUE = re.compile(
    r"(?i)(?:\b(?:ssn|social security(?: number| no\.?)?|national insurance(?: number| no\.?)?|nino|passport(?: number| no\.?)?|id card(?: number)?|identity card(?: number)?|tax (?:id|number|no\.?)|tin|driving licence(?: number)?|steuer-?id(?:nr)?\.?|steueridentifikationsnummer|steuernummer|ausweisnummer|ausweis(?:-?nr\.?)?|personalausweis(?:nummer)?|reisepass(?:nummer)?|pass(?:-?nr\.?)?|sozialversicherungsnummer|sv-nummer"
    r"|n° de sécurité sociale|numéro de sécurité sociale|nir|carte d['’]identité|passeport|numéro fiscal|n° fiscal|dni|nie|nif|pasaporte|seguridad social|codice fiscale|carta d['’]identità|passaporto|bsn|burgerservicenummer|paspoort|identiteitskaart|rijbewijs|pesel|nip|dowód osobisty|dowodu|paszport|паспорт|снилс|инн|удостоверение)(?:\s(?:no|nr|nummer|number|n°|№|numer|номер)\.?)?\s*[:№#]?\s*(?:n°\s?|№\s?)?)$"
)
_ID_HEAD = re.compile(r"(?:[A-Z]{3,5} )(?=[A-Z0-9 -]*\d)")
_ID_SHAPE = re.compile(r"^(?:\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]|\d{3}-\d{3}-\d{3} \d{2}|[A-Z]{3} ?\d{6}|[A-Z]{2}\d{6,7}[A-Z]?|\d{2} \d{2} \d{6}|\d{2} \d{3} \d{3} \d{3}|\d{11}|\d{9}|\d \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|[A-Z0-9]{8,9}|\d{2}[A-Z]{2}\d{5})$")
_ADDRESS_CUE = re.compile(
    r"(?i)(?:\b(?:lives at|living at|deliver(?:y)? to|address|send to|residing at|wohnhaft|wohnt|lieferung an|anschrift|adresse|demeurant|livrer (?:au|à)|domicilié|domicilio|entregar en|dirección|residente in|consegnare in|indirizzo|zamieszkał[ya]|dostarczyć na|adres|woont op|bezorgen op|адрес|доставить (?:на|по адресу)|проживает)\b\s*:?\s*(?:\w{1,8}\s)?)$"
)
_POSTCODE = re.compile(r"^(?:[^.;]|\.(?=\S|\s?[ºª])){0,30}?\b(?:\d{5,6}|\d{2}-\d{3}|\d{4}\s?[A-Z]{2}|[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}|[A-Z]-\d{5})\b")
_CUE_WORD = re.compile(r"(?i)(?:lives|living|deliver\w*|address|residing|wohnhaft|wohnt|lieferung|anschrift|adresse|demeurant|livrer|domicili\w+|entregar|dirección|residente|consegnare|indirizzo|zamieszkał\w|dostarczyć|adres|woont|bezorgen|адрес|доставить|проживает|call|phone|fax|rufen|appelez|llame|chiamare|dzwonić|bel|звоните)\b")
_GREETING = re.compile(
    r"(?i)(?:\b(?:dear|hello|hi|mr|mrs|ms|dr|prof|sehr geehrter?(?:/r)?(?: frau| herr)?|liebe[r]?(?:/r)?|frau|herrn?|hallo|cher|chère|cher/chère|bonjour|m\.|mme|mlle|monsieur|madame|estimad[oa](?:/a)?|querid[oa]|hola|sra?|don|doña|gentile|egregio|cara?o?|ciao|signora?|sig|beste|geachte(?: heer| mevrouw)?|dhr|mevr|szanown[ya](?: pani?e?)?|drogi|droga|pani?|уважаем(?:ый|ая)(?:\(ая\)|/ая)?|дорог(?:ой|ая)|здравствуйте|господин|госпожа|г-н|г-жа)[.,:]?\s)$"
)
_SIGNED = re.compile(
    r"(?i)(?:\b(?:signed(?: by)?|sincerely|regards|please ask|ask for|contact|attn|unterzeichnet(?: von)?|gezeichnet|gez|unterschrieben von|bitte(?: bei)?|fragen sie(?: bitte)?|wenden sie sich an|ansprechpartner(?:in)?|signé(?: par)?|demandez|demander|firmado(?: por)?|pregunte (?:a|por)|firmato(?: da)?|chiedere a|chieda a|ondertekend(?: door)?|vraag(?: het)?|podpisano|podpisała?|proszę zapytać|proszę pytać|prosimy|подписано|подписала?|подпись|спросите(?: у)?|обратитесь к)\s?[:,]?\s)$"
)
_FIRM = re.compile(r"(?i)\b(?:gmbh|ag|kg|ltd|llc|inc|plc|co|corp|group|company|sons|söhne|s\.?a\.?r?\.?l?|s\.?p\.?a|b\.?v|n\.?v|oy|ab|sp|industries|holding|partners|verlag|bank|museum|institut\w*|university|school|office|club|ооо|зао|оао)\b")
_PRODUCT_AFTER = re.compile(r"(?i)^\s*(?:\d+\s?(?:ml|g|kg|l|cm|mm|stk|pcs)\b|[®™©]|&|–\s|-\s\d|\d)")
_NOT_NAME_BEFORE = re.compile(r"[©®™&«“„@/#]\s?(?:\d+\s)?$")

def _email(before: str, span: str, after: str, given: frozenset[str]) -> list[int]:
    domain = re.search(r"(?i)(?:\.|dot[\])}]?\s?)[a-z]{2,12}$", span)
    return [1 if re.search(r"@|[([{]\s?at?\s?[\])}]", span, re.I) else 0, 1 if domain else -1, 1 if re.match(r"[\w.+%\-]+@[\w\-]+(?:\.[\w\-]+)+$", span) else 0, -1 if re.match(r"\d+\s?@", span) else 0,
            1 if re.search(r"(?i)\b(?:e-?mail|mail|correo|courriel|posta|poczta|почта|write to|schreiben|écrire à|escriba a|scrivere a|naar|fragen|pytania|вопросы)\b.{0,25}$", before) else 0, -1 if re.search(r"(?i)(?:https?:|www\.)\S*$", before) or not re.search(r"(?i)@|dot|[([{]\s?at", span) else 0]


def _phone(before: str, span: str, after: str, given: frozenset[str]) -> list[int]:
    digits = re.sub(r"\D", "", span)
    international = bool(re.match(r"\(?\+\d|00\d", span))
    shape = re.match(r"^(?:\(?\+\d{1,3}\)?[ \-.]?(?:\(\d\))?[\d ()\-./]{6,}|00\d{2}[ \-]?\d[\d \-]{6,}|\(?0\d{1,4}\)?[ /\-.]{1,3}\d[\d \-.]{4,}|8 \(\d{3}\) [\d\-]{7,9}|\(\d{3}\) \d{3}-\d{4}|\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|0\d(?:[ .]\d{2}){4})$", span)
    if not (shape or international or _PHONE_CUE.search(before)):
        return [-1]  # nothing speaks for it
    date = re.match(r"^(?:\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}|\d{4}-\d{2}-\d{2}|(?:\d{1,3}\.){3}\d{1,3})(?![.\d])", span)
    return [1 if _PHONE_CUE.search(before) else 0, 1 if international else 0, 1 if shape else -1, -1 if _NOT_NUMBER.search(before) else 0, -1 if _NOT_AFTER.match(after) else 0, -1 if date or len(digits) < 7 or len(digits) > 15 else 0, -1 if _ID_CUE.search(before) else 0, -1 if _POSTCODE.match(span + after[:6]) and "," in before[-3:] else 0, 1 if "\x01" in before and shape else 0]


def _id(before: str, span: str, after: str, given: frozenset[str]) -> list[int]:
    return [1 if _ID_CUE.search(before) else -1, 1 if _ID_SHAPE.match(span) else 0, -1 if _NOT_NUMBER.search(before) else 0, -1 if _PHONE_CUE.search(before) else 0, -1 if _NOT_AFTER.match(after) else 0, 1 if re.search(r"(?i)\b(?:holder|inhaber|titulaire|titular|titolare|houder|posiadacz|владелец)", before) else 0, -1 if re.match(r"\d{1,2}\.\d{1,2}\.\d{4}|(?:\d{1,3}\.){3}", span) else 0]


def _address(before: str, span: str, after: str, given: frozenset[str]) -> list[int]:
    return [1 if _ADDRESS_CUE.search(before) else 0, 1 if _POSTCODE.match(after) else 0, 1 if re.search(rf"[{U}]", span) else -1, -1 if re.search(r"(?i)^(?:im|am|in der|op de)\s", span) and not _ADDRESS_CUE.search(before) else 0,
            1 if re.search(r"(?i)\b(?:street|road|rd|lane|rue|av\.|avda|calle|via|piazza|ul\.|al\.|ул\.|пер\.)|straat|straße|str\.|weg\b|platz\b|gasse\b|laan\b|plein\b|gracht\b", span) else 0, -1 if _NOT_AFTER.match(after) or re.match(r"/\d|\d", after) else 0, 1 if re.search(r"\|\s*$|•\s*$|^$|,\s*$", before) else 0]


def _name(before: str, span: str, after: str, given: frozenset[str]) -> list[int]:
    words = [w for w in re.split(r"[\s,]+", span) if w]
    known = [w.strip(",.").title() in given or any(p in given for p in w.split("-")) for w in words]
    surname = re.match(rf"^{_CAP}(?:,?\s(?:[{U}]\.\s)?{_CAP})$", span)
    return [1 if any(known) else 0, 1 if _GREETING.search(before) else 0, 1 if _SIGNED.search(before) else 0, -1 if _FIRM.search(span) or re.match(r"\s?[&–]", after) or _FIRM.match(after.lstrip()) else 0, -1 if _PRODUCT_AFTER.match(after) or re.match(r".{0,4}\d+\s?ml\b", after) else 0,
            -1 if _NOT_NAME_BEFORE.search(before) else 0, 1 if surname else 0, -1 if len(words) > 4 or len(words) == 1 and not (_GREETING.search(before) or _SIGNED.search(before)) else 0, 1 if before.endswith("\x01") else 0, -1 if words[0].lower() in _STARTS else 0, -1 if span.isupper() and not any(known) else 0]


# Articles, prepositions and other small words of the eight languages, which open sentences and are no given names.
_STARTS = set(
    "the a an on at in of to for from by with this that these those today every each during before after and or der die das den dem des ein eine am im vor nach heute jede gegen während mit von für und oder le la les l un une au aux avant après pendant avec chaque et ou"
    " el los las una unos en cada hoy antes después durante con por y il lo gli i uno ogni di alla prima dopo oggi con per e o de het een op voor na tijdens elke vandaag met en w po przed dzisiaj dziś każdej pod z i na do v во на по перед сегодня каждую каждой после с и под к tel fax mail signed dear please".split()
)
_LABELERS = {"email": _email, "phone": _phone, "id_number": _id, "address": _address, "name": _name}
_DIGIT = re.compile(r"\d")
_AT = re.compile(r"(?i)[@＠]|[(\[{]\s?at?\s?[)\]}]|\sat\s")
_STREET = re.compile(rf"(?i){_NUMBER_FIRST}|\b(?:{_STREET_BEFORE})\s|(?:{_STREET_ENDS})\s\d")
_HEAD = re.compile(r"(?i)^(?:dear|hello|hi|bonjour|hola|hallo|beste|geachte|gentile|egregio|estimad[oa]|liebe[r]?|cher|chère|caro|cara|ciao|drogi|droga|szanown[ya]|pani?|mr|mrs|ms|dr|prof|herrn?|frau|monsieur|madame|signora?|don|doña|signed by|unterzeichnet von|gezeichnet von|signé par|firmado por|firmato da|ondertekend door|signed|ask|bitte|vraag|уважаемый|уважаемая|дорогой|дорогая|mme|mlle|sra?|sig|dhr|mevr|г-н|г-жа|господин|госпожа)\.?\s+")
_PHONE_NEAR = re.compile(r"(?i)[+()]|\b(?:tel|tél|fax|call|tfno|bel|sie|le|al|тел|звоните|chiamare|dzwonić)\b")
_UNIT = re.compile(r"\s*(?:\w+\s)?\d+\s?(?:ml|g|kg|l|cl|cm|mm|stk|pcs)\b")


_SPACES = re.compile("[\u00a0\u2000-\u200a\u202f\u205f\u3000]")


def _triggered(text: str) -> list[str]:
    """The types whose patterns can match: one needs a sign for "at", three a digit, addresses one of their signs too."""
    if not _DIGIT.search(text):
        return ["email", "name"] if _AT.search(text) else ["name"]
    low = text.lower()
    return (["email"] if _AT.search(text) else []) + (["address"] if any(x.search(low) for x in _ADDRESS_SIGNS) else []) + ["id_number", "phone", "name"]


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "replace")) % FEATURES


def _features(kind: str, before: str, span: str, after: str, votes: list[int]) -> list[int]:
    last = re.findall(r"\w+|[^\w\s]", before[-40:].lower())[-2:]
    nxt = re.findall(r"\w+|[^\w\s]", after[:24].lower())[:2]
    shape = re.sub(r"(.)\1{2,}", r"\1\1", re.sub(rf"[{L}]", "x", re.sub(rf"[{U}]", "X", re.sub(r"\d", "9", span))))[:16]
    f = [f"{kind}|bias", f"{kind}|<{' '.join(last)}", f"{kind}|<{last[-1] if last else '^'}", f"{kind}|>{nxt[0] if nxt else '$'}", f"{kind}|s{shape}"]
    f += [f"{kind}|v{i}={v}" for i, v in enumerate(votes) if v]
    if kind == "name":
        f += [f"n|{k}{w[-k:].lower()}" for w in re.split(r"[\s,\-]+", span)[:3] for k in (3, 4) if len(w) > k]
        f += [f"n|w{w.lower()}" for w in re.split(r"[\s,]+", span)[:2]]
    return [_hash(x) for x in f]


def candidates_of(text: str, given: frozenset[str], field: str = "text") -> list[tuple[str, int, int, str, list[int]]]:
    """(type, start, end, votes, features) of each candidate span in a text."""
    plain = text.replace("\n", " " if field in ("text", "spans") else "|")
    plain = plain if plain.isascii() else _SPACES.sub(" ", plain)
    out = []
    taken: list[tuple[int, int]] = []
    for kind in _triggered(plain):
        for m in _CANDIDATES[kind].finditer(plain):
            a, b = m.span()
            if kind == "id_number" and (head := _ID_HEAD.match(plain, a, b)):
                a = head.end()
            if kind == "name":
                while head := _HEAD.match(plain[a:b]):
                    a += head.end()
                while (tail := plain.rfind(" ", a, b)) > 0 and (plain[tail + 1 : b].lower() in _STARTS or _CUE_WORD.match(plain, tail + 1)):
                    b = tail - (plain[tail - 1] == ",")
                if plain[a:b].split(" ", 1)[0].lower() in _STARTS or _UNIT.match(plain, b):
                    continue  # an opening word or a product
            if kind == "id_number" and _PHONE_NEAR.search(plain, max(0, a - 14), a) and not _ID_CUE.search(plain[max(0, a - 60) : a]):
                continue  # the end of a phone number
            if kind in ("phone", "id_number", "name") and any(a < y and x < b for x, y in taken):
                continue
            span = plain[a:b]
            before, after = plain[max(0, a - 60) : a], plain[b : b + 40]
            if (kind, field) in (("name", "name_spans"), ("phone", "contact_spans")):
                before += "\x01"
            votes = _LABELERS[kind](before, span, after, given)
            if not any(v > 0 for v in votes):
                continue  # no labeler speaks for it
            if kind == "address" and not _STREET.search(span) and not (votes[0] > 0 or votes[1] > 0):
                continue  # neither a street's word nor a place beside it
            if kind in ("email", "address") or kind == "id_number" and votes[0] > 0:
                taken.append((a, b))
            out.append((kind, a, b, "".join("-0+"[v + 1] for v in votes), _features(kind, before, span, after, votes)))
    return out


def texts_of(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tbl, doc_id, page_no, item_no, field, text) of every text that may hold personal data."""
    e = elements.select(F.lit("elements").alias("tbl"), "doc_id", "page_no", F.col("element_no").alias("item_no"), F.lit("text").alias("field"), "text")
    listed = {c: F.array_join(F.transform(c, lambda x: F.coalesce(x["text"], F.lit(""))), "\n") for c in ("name_spans", "contact_spans")}  # one item a span
    fields = F.array(*[F.struct(F.lit(c).alias("field"), t.alias("text")) for c, t in {"spans": span_text("spans"), **listed}.items()])
    n = nodes.select(F.lit("nodes").alias("tbl"), "doc_id", "page_no", F.col("node_no").alias("item_no"), F.inline(fields))
    return e.unionByName(n).where(F.length("text") > 0)


def candidates(texts: DataFrame, given: frozenset[str]) -> DataFrame:
    keys = ["tbl", "doc_id", "page_no", "item_no", "field"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, rows, words = [], [], []
            for i, (field, text) in enumerate(zip(b.column("field").to_pylist(), b.column("text").to_pylist(), strict=True)):
                for c in candidates_of(text, given, field):
                    where.append(i)
                    words.append([w for w in re.split(r"[\s,]+", text[c[1] : c[2]]) if len(w) > 2] if c[0] == "name" else None)
                    rows.append(c)
            kinds, starts, ends, votes, feats = zip(*rows, strict=True) if rows else ((),) * 5
            at = pa.array(where, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k).take(at) for k in keys), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(votes, pa.string()), pa.array(feats, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.string()))],
                names=[*keys, "pii_type", "start", "end", "votes", "features", "words"],
            )

    schema = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys) + ", pii_type string, start int, end int, votes string, features array<int>, words array<string>"
    return texts.select(*keys, "text").mapInArrow(run, schema)


#: Occurrences of a word among name candidates from which its company counts.
TRUST_FROM = 4
#: Words of names whose company is joined by broadcast, at most.
BROADCAST_WORDS = 100_000


def trusted(found: DataFrame) -> DataFrame:
    """Name candidates with one vote more, by the company their words keep.

    A word that mostly stands beside given names, greetings or signatures is a name's part
    wherever it stands; one that never does is part of titles and firms.  Words are counted over all rows.
    """
    names = found.where("pii_type = 'name'").withColumn("id", F.xxhash64("tbl", "doc_id", "page_no", "item_no", "field", "start", "end"))
    sure = F.col("votes").rlike(r"^(?:\+|.\+|..\+|.{8}\+)").cast("int")
    each = names.select("id", F.explode(F.array_distinct("words")).alias("word"), sure.alias("sure"))
    trust = each.groupBy("word").agg(F.count("*").alias("n"), F.avg("sure").alias("share")).where(F.col("n") >= TRUST_FROM)
    trust = cut(trust)
    if trust.count() <= BROADCAST_WORDS:
        trust = F.broadcast(trust)
    by_id = each.select("id", "word").join(trust, "word").groupBy("id").agg(F.max("share").alias("most"), F.min("share").alias("least"))
    vote = F.when(F.col("least") >= 0.5, "+").when(F.col("most") < 0.15, "-").otherwise("0")
    bit = F.when(vote == "+", _hash("name|trust+")).when(vote == "-", _hash("name|trust-")).otherwise(_hash("name|trust0"))
    voted = names.join(by_id, "id", "left").withColumn("votes", F.concat("votes", F.coalesce(vote, F.lit("0")))).withColumn("features", F.concat("features", F.array(F.coalesce(bit, F.lit(_hash("name|trust0"))))))
    return found.where("pii_type <> 'name'").drop("words").unionByName(voted.select(*[c for c in found.columns if c != "words"]))


def reliabilities(patterns: list[tuple[str, int]], steps: int = 60) -> dict[str, float]:
    """Expectation-maximisation over vote patterns: the posterior of each pattern.

    Each labeler has, for either class, its own chances of the three votes; a labeler that
    votes for a class starts as four times as likely under it.
    """
    votes = np.array([["-0+".index(c) for c in p] for p, _ in patterns])
    n = np.array([k for _, k in patterns], float)
    score = (votes - 1).sum(axis=1)
    post = 1 / (1 + np.exp(-1.5 * (score - 0.5)))
    for _ in range(steps):
        prior = np.clip((n * post).sum() / n.sum(), 0.02, 0.98)
        log = np.full(len(n), np.log(prior / (1 - prior)))
        for j in range(votes.shape[1]):
            chance = np.array([[(n * y * (votes[:, j] == v)).sum() + a for v, a in zip((0, 1, 2), init, strict=True)] for y, init in ((post, (5, 25, 20)), (1 - post, (20, 25, 5)))])
            chance /= chance.sum(axis=1, keepdims=True)
            log += np.log(chance[0] / chance[1])[votes[:, j]]
        post = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return {p: float(q) for (p, _), q in zip(patterns, post, strict=True)}


def _logistic(rows: list[tuple[list[int], float]], steps: int = 150) -> np.ndarray:
    """Weights of hashed features, by full-batch adaptive gradient steps with a small penalty."""
    width = max((len(f) for f, _ in rows), default=1)
    x = np.full((len(rows), width), FEATURES, np.int64)  # the last weight pads and stays 0
    for i, (f, _) in enumerate(rows):
        x[i, : len(f)] = f
    y = np.array([q for _, q in rows])
    w, g2 = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30)))
        g = np.bincount(x.ravel(), np.repeat(p - y, width), FEATURES + 1) + 0.05 * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
        w[FEATURES] = 0
    return w


def detected(texts: DataFrame, given_names: DataFrame) -> DataFrame:
    """Accepted spans: (tbl, doc_id, page_no, item_no, field, pii_type, start, end)."""
    given = frozenset(r.name for r in given_names.where("name IS NOT NULL").select("name").distinct().collect())  # a small fixed table
    found = cut(trusted(cut(candidates(texts, given))))
    # Vote patterns are bounded by the labelers: at most 3 ** 12 a type, far fewer in practice.
    counts = found.groupBy("pii_type", "votes").agg(F.count("*").alias("n")).collect()
    posterior: dict[tuple[str, str], float] = {}
    for kind in TYPES:
        own = sorted((r.votes, r.n) for r in counts if r.pii_type == kind)
        if own:
            posterior |= {(kind, p): q for p, q in reliabilities(own).items()}
    weights: dict[str, np.ndarray] = {}
    order = F.xxhash64("doc_id", "page_no", "item_no", "start")
    # One pass takes each type's share by hash, a little more than is wanted; the least hashes of it are used.
    total = {kind: sum(r.n for r in counts if r.pii_type == kind) for kind in TYPES}
    part = F.lit(0.0)
    for kind, n in total.items():
        part = F.when(F.col("pii_type") == kind, min(1.0, 1.1 * TRAIN_SPANS / n) if n else 0.0).otherwise(part)
    order = F.pmod(F.xxhash64("doc_id", "page_no", "item_no", "start", "tbl", "field"), F.lit(1 << 30))
    rows = found.withColumn("order", order).where(F.col("order") < part * (1 << 30)).select("pii_type", "order", "features", "votes").collect()
    for kind in TYPES:
        own = sorted((r.order, r.features, r.votes) for r in rows if r.pii_type == kind)[:TRAIN_SPANS]
        if own:
            weights[kind] = _logistic([(f, posterior[kind, v]) for _, f, v in own])
    shared = found.sparkSession.sparkContext.broadcast((weights, posterior))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, post = shared.value
            keep = []
            for kind, votes, feats in zip(b.column("pii_type").to_pylist(), b.column("votes").to_pylist(), b.column("features").to_pylist(), strict=True):
                keep.append(kind in w and w[kind][feats].sum() > 0)
            yield b.filter(pa.array(keep, pa.bool_())).select(["tbl", "doc_id", "page_no", "item_no", "field", "pii_type", "start", "end"])

    schema = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in ("tbl", "doc_id", "page_no", "item_no", "field", "pii_type", "start", "end"))
    return found.mapInArrow(run, schema)


def found(elements: DataFrame, nodes: DataFrame, given_names: DataFrame) -> DataFrame:
    """(tbl, doc_id, page_no, item_no, pii_type): one row a record and type."""
    return detected(texts_of(elements, nodes), given_names).select("tbl", "doc_id", "page_no", "item_no", "pii_type").distinct()


def redacted(elements: DataFrame, nodes: DataFrame, given_names: DataFrame) -> DataFrame:
    """(tbl, doc_id, page_no, item_no, field, text) of the records with findings, each span replaced by its type's placeholder."""
    keys = ["tbl", "doc_id", "page_no", "item_no", "field"]
    texts = texts_of(elements, nodes).distinct()
    spans = detected(texts, given_names).groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("start", "end", "pii_type"))).alias("found"))  # bounded by a record's text
    rows = texts.join(spans, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, places in zip(b.column("text").to_pylist(), b.column("found").to_pylist(), strict=True):
                parts, at = [], 0
                for p in places:
                    if p["start"] >= at and p["end"] <= len(text):
                        parts += (text[at : p["start"]], PLACEHOLDER[p["pii_type"]])
                        at = p["end"]
                out.append("".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(out, pa.string())], names=[*keys, "text"])

    return rows.select(*keys, "text", "found").mapInArrow(run, ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", text string")
