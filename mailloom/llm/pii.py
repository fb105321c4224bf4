"""Personal information in free text: mailboxes, phones, identity numbers, addresses and person names.

Regular expressions propose spans with a base score. A form of number that has a checksum (Luhn, mod 97,
mod 11, mod 23, ISO 7064, or the ranges that were never given out) is confirmed by it: without a caption, a
number that passes is an item and one that fails is refused; a caption outweighs a failing checksum,
as a mistyped number is still somebody's. Context words nearby adjust the score; what reaches the threshold is
an item. Items don't overlap. Numbers of accounts and payment cards that pass mod 97 or Luhn are spans of
their own kind: no phone or identity number is read out of them. In HTML the visible text is searched, and
every span is led back to the mark-up it was read from.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.plans.storage import spread

THRESHOLD = 0.5
UPPER = "".join(c for c in map(chr, range(0x41, 0x530)) if c.isupper())
SP = r"[ \t ]{1,3}"


class Item(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


# ---- mailboxes
EMAIL = re.compile(r"(?<![\w.+%=/-])[\w+%][\w.+%'-]{0,63}@(?:[\w-]{1,63}\.){1,8}[^\W\d_]{2,24}(?![\w@])")
AT, DOT = r"(?:\(at\)|\[at\]|\{at\}|<at>|\(a\)|\(@\)|\[@\]|\{@\}|\(ät\)|\[ät\])", r"(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\(punkt\)|\[punkt\]|\(\.\)|\[\.\])"
VEILED = re.compile(rf"(?<![\w.+%-])[\w+%][\w.+%-]{{0,63}}\s?{AT}\s?[\w-]{{1,63}}(?:\s?(?:{DOT}\s?|\.)[\w-]{{1,63}}){{1,8}}", re.I)
SPELT = re.compile(rf"(?<![\w.+%-])[\w+%][\w.+%-]{{0,63}}{SP}(?:at|ät|arroba|chez|apenstaartje|małpa|собака){SP}[\w-]{{1,63}}(?:{SP}(?:dot|punkt|point|punto|ponto|punt|kropka|точка){SP}[\w-]{{1,63}}){{1,8}}", re.I)
SPACED = re.compile(r"(?<![\w.+%-])[\w+%][\w.+%-]{1,63} @ (?:[\w-]{1,63}\.){1,8}[^\W\d_]{2,24}(?!\w)")

# ---- street addresses. Kinds of street in several languages.
TOWN = rf"[{UPPER}][\w’'-]+(?:{SP}(?:(?:am|an{SP}der|an{SP}dem|im|in{SP}der|auf{SP}dem|bei|ob{SP}der|sur|sous|les|lès|de|de{SP}la|del|do|da|aan{SP}de|aan{SP}den|upon|on|nad|на){SP})?[{UPPER}][\w’'-]+)?"
POST = r"(?:[A-Z]{1,2}-)?(?:\d{5}|\d{4}(?:\s?[A-Z]{2})?|\d{2}-\d{3}|\d{4}-\d{3}|\d{6})"
STREET_END = r"(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ufer|ring|damm|hof|steig|straat|laan|plein|gracht|kade)"
HOUSE = r"\d{1,4}(?:[ ]?[a-zA-Z](?!\w))?(?:[/-]\d{1,4}[a-zA-Z]?)?"
GAP = r"\s{0,3},?\s{1,3}"
ADDRESSES = [
    re.compile(rf"(?<!\w)(?:[{UPPER}][\w’'-]*{SP}){{0,2}}[{UPPER}][\w’'-]*(?:(?<=\w){STREET_END}|{SP}{STREET_END}){SP}{HOUSE}{GAP}{POST}{SP}{TOWN}"),
    re.compile(rf"(?<![\w/-])\d{{1,4}}(?:{SP}?(?:bis|ter)|[a-zA-Z](?!\w))?,?{SP}(?:rue|avenue|av\.|boulevard|bd|chemin|place|allée|impasse|quai|route){SP}(?:(?:de|du|des|la|le|les|de{SP}la)\s|d[’'])*[{UPPER}][\w’'-]+(?:{SP}[{UPPER}][\w’'-]+){{0,3}}{GAP}{POST}{SP}{TOWN}"),
    re.compile(rf"(?<![\w/-])\d{{1,5}}[a-zA-Z]?{SP}(?:[{UPPER}][\w’'-]+{SP}){{1,3}}(?:Ave|Avenue|St|Street|Rd|Road|Blvd|Boulevard|Dr|Drive|Ln|Lane|Way|Court|Ct|Place|Pl|Square|Terrace)\.?(?:,{SP}(?:Apt|Unit|Suite|Ste|Floor|Flat|#)\.?{SP}?[\w-]{{1,6}})?,?\s{{1,3}}{TOWN},?{SP}(?:[A-Z]{{2}}{SP}\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[A-Z\d]?{SP}\d[A-Z]{{2}})(?!\w)"),
    re.compile(rf"(?<!\w)(?:ul\.|al\.|aleja|plac|calle|c/|avenida|avda\.|paseo|plaza|rua|travessa|praça|via|viale|piazza|улица|ул\.|проспект|пр\.){SP}(?:(?:de|del|da|do|dos|la|las|los){SP})*[{UPPER}][\w’'-]+(?:{SP}[{UPPER}][\w’'-]+){{0,3}},?{SP}(?:nº{SP}?|д\.{SP}?)?{HOUSE}{GAP}{POST}{SP}{TOWN}"),
]

# ---- phones
PHONES = [
    (re.compile(r"(?<![\w+/.-])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ ./-]?\d{2,6}){1,4}(?![\w/-]|[.,]\d)"), 0.7),
    (re.compile(r"(?<![\w+/.-])00[1-9]\d{0,2}(?:[ ./-]\d{2,6}){2,5}(?![\w/-]|[.,]\d)"), 0.6),
    (re.compile(r"(?<![\w+/.(-])\(\d{2,5}\)[ -]?\d{2,4}(?:[ .-]\d{2,5}){1,3}(?![\w/-]|[.,]\d)"), 0.6),
    (re.compile(r"(?<![\w+/.-])0\d{1,4}[/ -]\d{3,8}(?:[ -]\d{1,6}){0,3}(?![\w/-]|[.,]\d)"), 0.5),
    (re.compile(r"(?<![\w+/.-])0[1-9]\d{8,11}(?![\w/-]|[.,]\d)"), 0.5),
    (re.compile(r"(?<![\w+/.-])\d{3}([.-])\d{3,4}\1\d{4}(?![\w/-]|[.,]\d)"), 0.55),
    (re.compile(r"(?<![\w+/.-])[1-9]\d{1,3}(?:[ .-]\d{2,4}){2,4}(?![\w/-]|[.,]\d)"), 0.2),
]
PHONE_WORDS = re.compile(r"\b(?:tel|tél|telefon\w*|telephone|phone|fon|mobil\w*|mobile|cell|handy|gsm|fax|call|ring|ruf\w*|erreich\w*|appel\w*|llam\w*|ligar|ligue|bell?en|dzwoni\w*|звон\w*|номеру|тел|whatsapp|t)\b[^\n]{0,24}$", re.I)

# ---- identity numbers
def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _bare(s: str) -> str:
    return re.sub(r"[\s./-]", "", s)


def luhn(value: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(_digits(value))):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(value: str) -> bool:
    """An account number: country, check digits and 11 to 30 characters."""
    s = _bare(value)
    return bool(re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def mod23(value: str) -> bool:
    """Eight digits, or X, Y, Z and seven, and the letter of their remainder."""
    s = _bare(value)
    n = s[:-1].translate(str.maketrans("XYZ", "012"))
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(n) % 23] == s[-1]


def given_out(value: str) -> bool:
    """Area, group and serial number of a kind without check digit that avoids some ranges."""
    area, group, serial = value.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def iso7064(value: str) -> bool:
    """Eleven digits by mod 11, 10; the first is not 0."""
    d, p = _digits(value), 10
    for c in d[:10]:
        x = (int(c) + p) % 10 or 10
        p = 2 * x % 11
    return d[0] != "0" and (11 - p) % 10 == int(d[10])


def _weighted(d: str) -> bool:
    return sum(int(c) * w for c, w in zip(d, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1))) % 10 == 0


def two_mod11(value: str) -> bool:
    """Eleven digits of which the last two are remainders by 11."""
    d = _digits(value)
    return len(set(d)) > 1 and all(sum(int(c) * w for c, w in zip(d[:k], range(k + 1, 1, -1))) * 10 % 11 % 10 == int(d[k]) for k in (9, 10))


def valid_run(value: str) -> bool:
    """A run of 9 to 13 digits that passes the checksum of a number of its length."""
    d = _digits(value)
    if len(d) == 9:
        return sum(int(c) * w for c, w in zip(d, (9, 8, 7, 6, 5, 4, 3, 2, -1))) % 11 == 0
    if len(d) == 11:
        born = 1 <= (int(d[2:4]) % 20) <= 12 and 1 <= int(d[4:6]) <= 31  # the form that begins with a date
        return born and _weighted(d) or iso7064(d) or two_mod11(d)
    return len(d) == 13 and luhn(d)


def mod97_tail(value: str) -> bool:
    """Nine digits and their complement to 97, for either century."""
    d = _digits(value)
    return any((97 - int(p + d[:9]) % 97) == int(d[9:]) for p in ("", "2"))


#: (form, base score, checksum or None). With a checksum: base + 0.3 if it holds, base - 0.1 if not.
IDS = [
    (re.compile(r"(?<![\w/.-])\d{3}-\d{2}-\d{4}(?![\w/-]|[.,]\d)"), 0.35, given_out),
    (re.compile(r"(?<![\w/.-])\d{2} \d{3} \d{3} \d{3}(?![\w/-]|[.,]\d)"), 0.25, iso7064),
    (re.compile(r"(?<![\w/.-])[A-Z]{2} ?\d{2,3} ?\d{2,3} ?(?:\d{2} ?)?[A-Z](?![\w/-])"), 0.5, None),
    (re.compile(r"(?<![\w/.-])\d{8}-?[A-Z](?![\w/-])"), 0.25, mod23),
    (re.compile(r"(?<![\w/.-])[XYZ]-?\d{7}-?[A-Z](?![\w/-])"), 0.25, mod23),
    (re.compile(r"(?<![\w/.-])[A-Z]{1,3} ?\d{6,8}(?![\w/-])"), 0.3, None),
    (re.compile(r"(?<![\w/.-])(?=[A-Z0-9]{8,11}(?![\w/-]))(?=[A-Z0-9]*\d)(?=[A-Z0-9]*[A-Z])[A-Z0-9]{8,11}"), 0.2, None),
    (re.compile(r"(?<![\w/.-])(?:\d{9}|\d{11}|\d{13})(?![\w/-]|[.,]\d)"), 0.2, valid_run),
    (re.compile(r"(?<![\w/.-])(?:\d{10}|\d{12})(?![\w/-]|[.,]\d)"), 0.2, None),
    (re.compile(r"(?<![\w/.-])\d{3}\.\d{3}\.\d{3}-\d{2}(?![\w/-])"), 0.25, two_mod11),
    (re.compile(r"(?<![\w/.-])\d{2}[ .]\d{2}[ .]\d{2}[ .-]\d{3}[ .-]\d{2}(?![\w/-])"), 0.25, mod97_tail),
    (re.compile(r"(?<![\w/.-])\d{3}-\d{3}-\d{3} \d{2}(?![\w/-])"), 0.5, None),
    (re.compile(r"(?<![\w/.-])\d{4} \d{6}(?![\w/-]|[.,]\d)"), 0.25, None),
]
CONFIRMED, REFUSED = 0.3, -0.1
ACCOUNT = re.compile(r"(?<![\w/.-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w/-])")
CARD = re.compile(r"(?<![\w/.-])[2-6]\d{3}(?:[ -]?\d){9,15}(?![\w/-]|[.,]\d)")


def accounts(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, confirmed) of numbers in the form of an account or, if they pass, of a payment card."""
    for m in ACCOUNT.finditer(text):
        s = _bare(m.group())
        if len(s) >= 15:
            yield *m.span(), mod97(s)
    for m in CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and len(set(d)) > 1 and luhn(d):
            yield *m.span(), True


ID_WORDS = re.compile(r"ausweis|\bpass\b|passport|passeport|paspoort|pasaporte|passaporte|paszport|паспорт|identi|identid|personalausweis|steuer|\btax\b|impuesto|fiscal|imp[oô]t|belasting|podatk|налог|\bssn\b|social|sozial|sécurité sociale|sécu|bsn|burgerservice|\bdni\b|\bnie\b|\bnif\b|\bcpf\b|pesel|\bnip\b|dowod|dowód|\binn\b|инн|снилс|удостовер|national insurance|\bnino\b|svnr|versicherungsnummer", re.I)
NOT_IDS = re.compile(r"order|invoice|parcel|rechnung|sendung|paket|bestell|colis|facture|commande|paquete|factura|pedido|encomenda|fatura|pakket|rekening|bestelling|paczk|faktur|zamówien|посылк|счёт|заказ|vorgang|kennung|referen|filed|abgelegt|case|code|vermerk|mark\b", re.I)

# ---- names. Words that stand before, in or after names of persons.
PARTICLES = "von van de der den del della di da dos du zu zum ten ter la le af al el"
GREETINGS = "dear hi hello hey morning afternoon evening greetings hola bonjour bonsoir salut cher chère hallo moin tag liebe lieber geehrte geehrter olá oi caro cara prezado prezada estimado estimada querido querida beste geachte goedemorgen goedemiddag dag witam witaj cześć drogi droga szanowny szanowna dobry здравствуйте привет уважаемый уважаемая дорогой дорогая день días tardes dia"
TITLES = "mr mrs ms miss mx sir madam dr prof frau herr herrn fräulein madame monsieur mme mlle señora señor señorita sra sr srta don doña senhora senhor dona mevrouw meneer mevr dhr heer pani panią pana pan panu господин госпожа госпоже господину госпожу"
CLOSERS = "regards wishes sincerely yours thanks thank cheers grüßen grüße gruß danke cordialement salutations amicalement merci saludo saludos atentamente gracias cumprimentos atenciosamente obrigado obrigada groet groeten bedankt dank poważaniem pozdrawiam dziękuję pozdrowieniami уважением спасибо привет"
NO_NAMES = "all customer customers client clients kunde kunden kundin kundinnen damen herren zusammen team teams colleague colleagues kollegen kolleginnen user users nutzer member members mitglied friend friends everybody everyone sir madam madame messieurs mesdames clientes cliente klient klanten klant państwo panie panowie desk office service list lists mailing front support helpdesk help admin administrator info group committee board council department abteilung stelle center centre centro equipo equipe équipe dzień dobry guten good tag"
CONTACTS = "tel fon mobil mobile phone fax telefon t m tél cell"
PART = {p for p in PARTICLES.split()}
GREET, TITLE, CLOSE, NO, CONTACT = (set(x.split()) for x in (GREETINGS, TITLES, CLOSERS, NO_NAMES, CONTACTS))
LEAD = GREET | TITLE | CLOSE | {"sehr", "guten", "good", "buenos", "buenas", "bom", "boa", "best", "kind", "warm", "many", "viele", "liebe", "mit", "freundlichen", "un", "met", "vriendelijke", "z", "с", "os", "melhores"}
WORD = rf"(?:[{UPPER}]\.(?![\w])|[{UPPER}][\w’'-]*[\w])"
RUN = re.compile(rf"(?<![\w@.+/&#-])(?:(?:{PARTICLES.replace(' ', '|')}){SP})?{WORD}(?:{SP}(?:(?:{PARTICLES.replace(' ', '|')}){SP}){{0,2}}{WORD})*(?![\w@])")
PIECES = re.compile(r"\S+")
# Captions of a contact, and verbs whose object is often a person; a given and a family name must follow.
CAPTION = re.compile(r"(?:^|[\s(])(?:contact(?: person)?|name|attn|attention|signed|author|sender|assigned to|ansprechpartner(?:in)?|kontakt|bearbeiter(?:in)?|z\. ?hd|contacto|nombre|nom|nome|contato|contactpersoon|naam|kontaktowa|imię i nazwisko|имя|контакт)\s?[:.]\s{0,3}$", re.I)
VERBS = set("call phone contact ask email meet met saw tell told thank asked called appeler contacter demander llamar contactar preguntar ligar contatar perguntar bel bellen vraag vragen".split())
# Phrases around names without a title.
BEFORE_NAME = re.compile(r"(?:as agreed with|as discussed with|wie mit|wie von|comme convenu avec|como acordado con|como se acordó con|como combinado com|zoals besproken met|zoals afgesproken met|zgodnie z ustaleniami z|jak ustalono z|как договорились с|по договорённости с|hand the key to|held by|signed by|on behalf of|im auftrag von)\s{1,3}$", re.I)
CLOSING_LINE = re.compile(r"(?:^|[.!?;]\s)(?:mit freundlichen|viele gr|liebe gr|beste gr|met vriend|best reg|kind reg|z powa|com os mel|un sal|с уваж)\S*(?:\s\S+)?$", re.I)
CAPITAL_TITLES = set("mr mrs ms miss mx sir dr prof frau herr herrn fräulein madame monsieur mme mlle sr sra don".split())
COMMA_GREETINGS = set("witam witaj cześć здравствуйте привет день dobry".split())
GARBLED_LEAD = re.compile(r"(?:^|\s)(?:se\S{1,6}or(?:a|ita)?|pani\S|ol[^\s,]{2,6})$", re.I)
LINKS = set("with mit von avec con com met z с to by of auftrag по".split())
NUMBER_NEXT = re.compile(r"[+(\d]|tel\b|fon\b|mobil", re.I)
LETTERS = re.compile(r"[^\W\d_]+")
AFTER_NAME = re.compile(r"\s{1,3}(?:asked me to|has asked|hat mich gebeten|bat mich|m[’']a demandé|me pidió|me ha pedido|pediu-me|me pediu|heeft mij gevraagd|vroeg mij|poprosił|попросил|besprochen,|told me|will join us|sends (?:his|her|their) regards)", re.I)


def initial(word: str) -> bool:
    return len(word) == 2 and word[1] == "."


def _lead_before(head: str) -> tuple[str, bool]:
    """The word that stands before a run of capitalised words, in lower case, and whether a comma parts them."""
    stem = head.rstrip(" \t\u00a0")
    if not stem:
        return "", False
    comma = stem[-1] == ","
    word = stem.rsplit(None, 1)[-1].strip(",.:;!>*\"'")
    low = word.lower()
    if low in LEAD:
        return ("" if low in CAPITAL_TITLES and not word[0].isupper() else low), comma
    if not word.isascii() and GARBLED_LEAD.search(word):
        return ("hola" if low[:2] == "ol" else "señora"), comma
    return low, comma


def _closing_before(text: str, line: int) -> bool:
    """Whether the line before the one that begins at ``line`` ends with a closing phrase."""
    prev = text[max(0, line - 64):max(0, line - 1)].rstrip(" \t\r")
    if prev.endswith("\n"):
        return False
    closing = prev[prev.rfind("\n") + 1:]
    closing = closing.rstrip(" \t>,.")
    words = LETTERS.findall(re.split(r"[.!?;]\s", closing)[-1])
    return bool(words) and len(words) <= 4 and words[-1].lower() in CLOSE and closing[-1:] not in "!?" or bool(CLOSING_LINE.search(closing))


def _names(text: str) -> Iterator[tuple[int, int, float]]:
    for m in RUN.finditer(text):
        start, end = m.span()
        run = m.group()
        line = text.rfind("\n", 0, start) + 1
        head = text[max(line, start - 28):start]
        words = run.split()
        low = [w.rstrip(".").lower() for w in words]
        k = 0
        while k < len(low) and low[k] in LEAD and not initial(words[k]):
            k += 1
        lead, comma = (low[k - 1], False) if k else _lead_before(head)
        opens = not k and (not head.strip(" \t\u00a0>*") or head.rstrip()[-1:] in ".!?:")
        if not (k or opens or lead in LEAD or lead in LINKS or lead in VERBS):
            continue
        pieces = [(p.start() + start, p.end() + start) for p in PIECES.finditer(run)]
        # contact words and what follows them are no part of a name, which is complete with its second full word
        stop, full, contact = len(low), 0, False
        for i in range(k, len(low)):
            first = initial(words[i])
            if (low[i] in CONTACT or low[i] in LEAD and i > k) and not first:
                stop, contact = i, low[i] in CONTACT
                break
            full += low[i] not in PART and (not first or i == k)
            if full > 1 and not first:
                stop = i + 1
                break
        if stop == k:
            continue
        a, z = pieces[k][0], pieces[stop - 1][1]
        name = low[k:stop]
        if all(w in PART for w in name) or any(w in NO for w in name):
            continue
        if text[z - 1] == "." and not initial(words[stop - 1]):
            z -= 1
        after = text[z:z + 40]
        bare = after.lstrip(" \t\u00a0")
        score = 0.0
        if lead in TITLE and not comma:
            score = 0.8
        elif lead in GREET and (k or not comma or lead in COMMA_GREETINGS) and (not bare or bare[0] in ",!:;\r\n–-"):
            score = 0.7
        elif not k and lead in LINKS and BEFORE_NAME.search(text[max(0, start - 36):a]):
            score = 0.6 if bare[:1] in {",", "."} or AFTER_NAME.match(after) else 0.3
        elif opens and AFTER_NAME.match(after):
            score = 0.6
        elif not k and full > 1 and not comma and (lead in VERBS and head[-1:].isspace() or opens and CAPTION.search(head)):
            score = 0.55
        elif contact or not bare or bare[0] in "\r\n" or NUMBER_NEXT.match(bare):
            if k and lead in CLOSE or opens and not head.strip(" \t\u00a0>*") and _closing_before(text, line):
                score = 0.6
        if score >= THRESHOLD:
            yield a, z, score


def _refers(near: str, better: re.Pattern) -> bool:
    """Whether a word for orders and the like stands before a number, and none that speaks for it comes after that."""
    last = None
    for last in NOT_IDS.finditer(near[-32:]):
        pass
    if last is None:
        return False
    good = [m.start() for m in better.finditer(near[-32:])]
    return not (good and good[-1] > last.start())


def find_items(text: str) -> list[Item]:
    """All items of a text, in order, without overlaps; of overlapping proposals the better or longer one stays."""
    found: list[Item] = []
    if "@" in text:
        found += [Item(*m.span(), "email", 0.95) for m in EMAIL.finditer(text)]
        if " @ " in text:
            found += [Item(*m.span(), "email", 0.7) for m in SPACED.finditer(text)]
    if re.search(r"[(\[{<](?:at|a|@|ät)[)\]}>]", text, re.I):
        found += [Item(*m.span(), "email", 0.9) for m in VEILED.finditer(text)]
    if re.search(r"\b(?:dot|punkt|point|punto|ponto|punt|kropka|точка)\b", text, re.I):
        found += [Item(*m.span(), "email", 0.8) for m in SPELT.finditer(text)]
    if re.search(r"\d{2}", text):
        for p in ADDRESSES:
            found += [Item(*m.span(), "address", 0.9) for m in p.finditer(text)]
        banked = list(accounts(text))
        found += [Item(a, z, "account", 0.9) for a, z, sure in banked if sure]
        for p, base, check in IDS:
            for m in p.finditer(text):
                near = text[max(0, text.rfind("\n", 0, m.start()) + 1, m.start() - 48):m.start()]
                after = text[m.end():m.end() + 24].split("\n")[0]
                score = base + (0.4 if ID_WORDS.search(near) else 0.2 if ID_WORDS.search(after) else 0) - (0.5 if _refers(near, ID_WORDS) else 0)
                if check is not None:
                    score += CONFIRMED if check(m.group()) else REFUSED if base > 0.2 else 0
                if score >= THRESHOLD - 1e-9:
                    found.append(Item(*m.span(), "id_number", min(1.0, score + 0.05)))
        for p, base in PHONES:
            for m in p.finditer(text):
                n = sum(c.isdigit() for c in m.group())
                if not 7 <= n <= 16 or any(a <= m.start() and m.end() <= z for a, z, _ in banked):
                    continue
                near = text[max(0, text.rfind("\n", 0, m.start()) + 1, m.start() - 40):m.start()]
                score = base + (0.4 if PHONE_WORDS.search(near) else 0) - (0.5 if _refers(near, PHONE_WORDS) else 0) - (0.3 if ID_WORDS.search(near) else 0)
                if score >= THRESHOLD:
                    found.append(Item(*m.span(), "phone", min(1.0, score)))
    found += [Item(a, z, "name", s) for a, z, s in _names(text)]
    found.sort(key=lambda x: (-(x.kind == "address"), -(x.kind == "email"), -x.score, -(x.end - x.start), x.start))
    return _apart(found)


def _apart(ranked: list[Item]) -> list[Item]:
    """Those of the ranked items that overlap none before them, in order of their place."""
    starts: list[int] = []
    taken: list[Item] = []
    for x in ranked:
        k = bisect_right(starts, x.start)
        if (not k or taken[k - 1].end <= x.start) and (k == len(taken) or x.end <= taken[k].start):
            starts.insert(k, x.start)
            taken.insert(k, x)
    return taken


# ---- HTML
SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<![^>]*>|&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});", re.S | re.I)
INLINE = set("a abbr b bdi bdo big cite code em font i ins del kbd mark q s samp small span strike strong sub sup tt u var wbr".split())


class Visible:
    """The visible text of a page with the way back to the page."""

    def __init__(self, page: str):
        self.page = page
        out, self.at, self.raw = [], [], []  # pieces; their offsets in the text and spans in the page
        n = pos = 0

        def add(s: str, a: int, z: int) -> None:
            nonlocal n
            if s:
                out.append(s)
                self.at.append(n)
                self.raw.append((a, z, len(s) == z - a and s == page[a:z]))
                n += len(s)

        for m in SKIP.finditer(page):
            add(page[pos:m.start()], pos, m.start())
            g = m.group()
            if g[0] == "&":
                add(html.unescape(g), *m.span())
            elif not (m.group(3) and m.group(3).lower() in INLINE):
                add("\n", *m.span())
            pos = m.end()
        add(page[pos:], pos, len(page))
        self.text = "".join(out)

    def span(self, a: int, z: int) -> tuple[int, int]:
        def place(i: int, end: bool) -> int:
            k = bisect_right(self.at, i) - 1
            s, e, same = self.raw[k]
            return s + (i - self.at[k]) + end if same else (e if end else s)

        return place(a, False), place(z - 1, True)


def find_in_html(page: str) -> list[Item]:
    """Items of a page as spans of its mark-up; mailboxes in attributes count too."""
    v = Visible(page)
    found = [Item(*v.span(x.start, x.end), x.kind, x.score) for x in find_items(v.text)]
    if "@" in page:
        found += [Item(*m.span(), "email", 0.95) for m in EMAIL.finditer(page.replace("mailto:", "       ") if "mailto:" in page else page)]
    return _apart(found)


# ---- To headers
PARTS = re.compile(r"\s*((?:\"(?:[^\"\\]|\\.)*\"|\([^()]*\)|<[^<>]*>|[^,;\"<(])+|[\"<(])")
DISPLAY = re.compile(rf"(?:(?:{PARTICLES.replace(' ', '|')}){SP})*{WORD}(?:,?{SP}(?:(?:{PARTICLES.replace(' ', '|')}){SP})*{WORD}){{0,4}}")


def find_in_to(header: str) -> list[Item]:
    """Mailboxes of a To header and the display names that name persons."""
    found = [Item(*m.span(), "email", 0.95) for m in EMAIL.finditer(header)]
    found = _apart(found + [x for x in find_items(header) if x.kind == "email"])
    for m in PARTS.finditer(header):
        a, z = m.span(1)
        part = header[a:z]
        cut = part.find("<")
        label = part[:cut] if cut >= 0 else "" if "@" in part else part
        inner = label.strip(" \t\r\n\"'")
        if not inner or "@" in inner or ":" in inner:
            continue
        words = [w for w in re.split(r"[\s,]+", inner) if w]
        low = [w.rstrip(".").lower() for w in words]
        while low and low[0] in TITLE:
            inner = inner[len(words[0]):].lstrip(" .")
            words, low = words[1:], low[1:]
        if inner and DISPLAY.fullmatch(inner) and not any(w in NO or w in CONTACT and len(w) > 1 for w in low):
            s = a + part.find(inner)
            found.append(Item(s, s + len(inner), "name", 0.8))
    return sorted(found)


FINDERS = {"To": find_in_to, "text_payloads": find_items, "html_payloads": find_in_html}
KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {"account": "[ACCOUNT]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


def redact(text: str, items: list[Item]) -> str:
    out, at = [], 0
    for x in items:
        out += [text[at:x.start], PLACEHOLDERS[x.kind]]
        at = x.end
    return "".join(out) + text[at:]


def personal_items(fields: DataFrame, kinds: tuple[str, ...] = KINDS, once: bool = True) -> DataFrame:
    """(key, field_name, redacted, items(kind, text, start, stop, score)) for fields (key, field_name, text).

    ``kinds`` are the kinds of item that count; numbers of accounts and cards (``account``) do so only if asked for.

    field_name chooses the reading: To, html_payloads, or plain text for any other. Null texts give
    no row, empty ones an empty text without items. Repeated identical rows count once, unless ``once`` is
    off, which saves the shuffle of all texts where the caller counts items once anyway. Whole texts
    are searched. Offsets count characters.
    """
    rows = fields.select(F.col("key").cast("string").alias("key"), "field_name", "text").filter(F.col("text").isNotNull())
    rows = rows.dropDuplicates() if once else spread(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, f, t in zip(b.key, b.field_name, b.text):
                items = [x for x in FINDERS.get(f, find_items)(t) if x.kind in kinds]
                out.append((k, f, redact(t, items), [{"kind": x.kind, "text": t[x.start:x.end], "start": x.start, "stop": x.end, "score": float(x.score)} for x in items]))
            yield pd.DataFrame(out, columns=["key", "field_name", "redacted", "items"])

    return rows.mapInPandas(run, "key string, field_name string, redacted string, items array<struct<kind:string,text:string,start:int,stop:int,score:double>>")
