"""Personal information in free text: email, phone, identity number, address and name.

A semi-Markov conditional random field scores whole spans. Patterns propose candidate spans
with a type; a span's features are its shape, its words, and the words before and after it.
Where candidates overlap, dynamic programming over their ends sums over (in training) or
maximises over (in use) all ways to choose spans that do not overlap, boundaries and types
together. Text outside candidates is never touched, so the cost follows the candidates.

There are no labelled mentions. The field is fitted on a bounded sample of documents
(`SAMPLE_DOCUMENTS`, by hash; the words of names come from all documents) labelled by cue phrases ("call", "Batch", "resident of", ...);
candidates that no cue decides are left out of the likelihood, and the fitted shapes, name
words and contexts decide them in use.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarkash.sources.tables import spread

SAMPLE_DOCUMENTS = 6000
KINDS = ("email", "phone", "id_number", "address", "name")

# Titles, cue words, first words of addresses. Patterns start with a set of characters where they
# can, as the engine skips all others; what has to stand before is then looked up behind that first character.
TITLES = r"(?:Mr|Mrs|Ms|Miss|Smt|Shri|Sri|Sh|Dr|Er|Prof|Km|Kum|Kumari|Adv|Late)\.?"
EMAIL = re.compile(r"[A-Za-z0-9][\w.+%-]*(?:\s?@\s?|\s?[(\[]\s?at\s?[)\]]\s?)[A-Za-z0-9-]+(?:(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?)[A-Za-z0-9-]+)*")
AT = re.compile(r"[@(\[](?:(?<=@)|(?<!@)\s?at\s?[)\]])")
NUMBER = re.compile(r"(?<![\w.,/+\-०-९])(?:\+\d{1,3}[ -]?)?(?:\(\d{2,5}\)[ -]?)?[\d०-९](?:[\d०-९]|[ .-](?=[\d०-९])){5,20}(?![\w/]|[.,]\d)")
CODE = re.compile(r"(?<![\w/-])(?:[A-Z]{2,3}[ -]?\d{1,2}[ -]\d{7,13}|[A-Za-z]{1,5}-?\d[\dA-Za-z]{3,}(?:[ -]\d{6,13})?)(?![\w/]|-\w)")
# Where numbers (of eight digits), codes and addresses can be.
DIGITS = re.compile(r"[\d+(][\d +().-]{7,}")
CODE_DIGIT = re.compile(r"\d(?:(?<=[A-Za-z]\d)|(?<=[A-Za-z]-\d)|(?<=[A-Z] \d))")
PIN = re.compile(r"\d(?:(?<![\d/.,+-][\s\S])\d{2} ?\d{3}(?!\d|[/]|[.,]\d)|(?<=-\d)\d{5}(?!\d|[/]))")
HOUSE = re.compile(r"(?:H\.? ?No|House|Flat|Plot|Qtr|Quarter|Door|Vill|C/o|c/o|मकान|ग्राम|गाँव|फ्लैट|प्लॉट|द्वारा)")
HOUSE_NUMBER = re.compile(r"\d[A-Z]?, (?=[A-Z])")
ADDRESS = re.compile(r"(?<![\w/])(?:(?:H\.? ?No\.?|House(?: No\.?)?|Flat(?: No\.?)?|Plot(?: No\.?)?|Qtr\.?(?: No\.?)?|Quarter(?: No\.?)?|Door(?: No\.?)?|Village|Vill\.?|C/o|c/o) ?#? ?(?=[\w#])|(?:मकान|ग्राम|गाँव|फ्लैट|प्लॉट|द्वारा)\s|#?[A-Z]?-?\d+(?:/\d+)?[A-Z]?, (?=[A-Z]))")
# An address goes on to here at most: the end of a sentence, or of the second line after its first.
SENTENCE_STOP, LINES_STOP = re.compile(r"[a-z]{3,}[.।] (?=[A-Z])"), re.compile(r"(?:[^\n]*\n){3}")
DATE = re.compile(r"\d{1,2}([.-])\d{1,2}\1\d{2,4}$|\d{4}-\d{2}(?:-\d{2})?$")
TOKEN = r"(?:(?:[A-Z]\.)+|[A-Z][a-z]+|[A-Z]{2,})"
RUN = re.compile(rf"[A-Z](?<![\w.][\s\S])(?:\.(?:[A-Z]\.)*|[a-z]+|[A-Z]+)(?: ?(?<=\.){TOKEN}| {TOKEN}){{0,4}}(?![\w@])")
HINDI_NAME = re.compile("(?:श्रीमती|श्री|कुमारी|डॉ\\.?|प्रार्थी|आवेदक|सुश्री)\\s+(?!(?:का|के|की|ने|को) )([ऀ-ॣ]+(?: (?!(?:का|के|की|ने|को|से|हेतु)[ ,।])[ऀ-ॣ]+)?)")
HINDI_OWNER = re.compile("(?:^|[।.?!\\n]\\s*)(?:(?:श्रीमती|श्री|कुमारी|सुश्री)\\s+)?([ऀ-ॣ]+ [ऀ-ॣ]+)(?= (?:का|की) पहचान)")
NAME_CUE = re.compile(rf"(?<!\w)(?:{TITLES}|nominee is|told by|Submitted by|Copy to:|engineer,|officer:|officer,|workman|workwoman|Account of|S/o|D/o|W/o|and|Name:|faithfully,|sincerely,|truly,|Regards,|Sd/-|signed by|applicant|representative|Contact:|\()\s*\(?(?=[A-Z])")
# Beginnings of the cues of names, in upper and in lower case.
CUE_CAPITAL = re.compile(r"(?:M[rsi]|S[mhrud/]|D[r/]|W/|Er|Pr|K[mu]|A[dc]|La|Co|Na|Re|\()")
CUE_WORDS = ("nominee is", "told by", "engineer,", "officer", "workman", "workwoman", "and", "faithfully", "sincerely", "truly", "signed by", "applicant", "representative")
CAPITALISED = re.compile(r"[A-Z][A-Za-z]+").findall
LOWER_CASE = re.compile(r"[a-z](?<![\w.][\s\S])[a-z]{2,}(?!\w)").findall
TOKENS = re.compile(TOKEN).finditer
NOT_NAMES = frozenset("Stage Upper Lower Road Street Colony Lane Marg Chowk Gali Path Nagar Committee Council Officer Engineer Secretary Director Manager Minister Member Government Company Station Project Department Ministry Office Room Ward Sector Tehsil District Block January February March April May June July August September October November December Annexure Schedule Chief Deputy Under Joint The".split())
TITLE_WORDS = frozenset("Mr Mrs Ms Miss Smt Shri Sri Sh Dr Er Prof Km Kum Kumari Adv Late Sir Madam".split())
PHONE_CUE = re.compile(r"(?:mobile|call|tel|telephone|phone|ph|whatsapp|contacts? (?:are|is|on)|number is|contacted on|fax|reach\w* (?:at|on)|दूरभाष|मोबाइल|फोन|फ़ोन)[\s.:,-]*(?:[+\d()\s.-]{8,20}\s+(?:and|or|,|/)\s*)?$", re.I)
ID_CUE = re.compile(r"(?:card no\.?|identity (?:number|no\.?|card)|holding ID|\bID ?:|\bID (?:number|no\.?)|Document|because|verified against|nominee is [^()]{3,40}\(|passport(?: no\.?)?|licen[cs]e(?: no\.?)?|aadhaar(?: no\.?)?|PAN|पहचान (?:क्रमांक|संख्या|पत्र))\s*$", re.I)
OTHER_CUE = re.compile(r"(?:batch|material code|code|voucher|reading|head|chainage|tender|rs\.?|invoice|serial|drawing no\.?|clause|coordinates are|file no\.?|f\.? ?no\.?|letter number|order no\.?|bill no\.?|model|receipt|₹|challan|account head|item|consignment|docket|reference|ref\.?|memo(?: no\.?)?|gauge|section|contract package|सं\.?|क्रमांक)\s*$", re.I)
UNIT_AFTER = re.compile(r"\s*(?:kWh|MW|MWh|cumecs?|hectares?|metres?|m\b|km|kg|tonnes?|units|crore|lakh|rupees|days|N\b|E\b|°)")
ADDRESS_CUE = re.compile(r"(?:resident of|sent to|live at|lives at|residing at|r/o|address is|Copy to: [^,]{3,40},|का पता|पता)\s*$", re.I)
PLACE_BEFORE = frozenset("at near of from in to around below beside above for on along between the".split())


class Span(NamedTuple):
    start: int
    end: int
    kind: str


def _shape(text: str) -> str:
    return re.sub("A+", "A", re.sub(r"[A-Za-z]", "A", re.sub(r"[\d०-९]", "9", text)))


def _before(text: str, at: int) -> list[str]:
    return re.findall(r"[\w'/]+[.:,]?|\n|[^\w\s]", text[max(0, at - 40) : at])[-2:]


def _after(text: str, at: int) -> str:
    m = re.compile(r"[ \t]*(\n|[\w/]+|[^\w\s])").match(text, at)
    return m[1].lower() if m else ""


class Lexicon(NamedTuple):
    given: frozenset  # first words of names
    family: frozenset  # last words of names
    common: frozenset  # words that also occur in lower case


NO_WORDS = Lexicon(frozenset(), frozenset(), frozenset())


def _tried(pattern: re.Pattern, text: str, places: list[int]) -> Iterator[re.Match]:
    """What `pattern.finditer` finds if it can match at these places only, which is far cheaper than at each character."""
    last = 0
    for at in sorted(places):
        m = pattern.match(text, at) if at >= last else None
        if m:
            last = m.end()
            yield m


def _cue_places(text: str) -> list[int]:
    """Where `NAME_CUE` and `FRAMES` can match."""
    places = [m.start() for m in CUE_CAPITAL.finditer(text)]
    for w in CUE_WORDS:
        at = text.find(w)
        while at >= 0:
            places.append(at)
            at = text.find(w, at + 1)
    return places


@lru_cache(maxsize=4)
def _known(words: Lexicon) -> frozenset:
    return words.given | words.family if words.given else frozenset()


def _name_spans(text: str, words: Lexicon) -> Iterator[Span]:
    """Capitalised words after a cue or known from names; `and` is a cue only beside others."""
    cues = list(_tried(NAME_CUE, text, _cue_places(text)))
    starts = {m.end() for m in cues}
    alone = {m.end() for m in cues if not m.group().startswith(("and", "("))}  # where one word can be a name
    known = _known(words)
    if all(m.group().startswith("and") for m in cues) and known.isdisjoint(map(str.capitalize, set(CAPITALISED(text)))):
        return
    places = sorted(starts)
    for run in RUN.finditer(text):
        whole, at = run.group(), run.start()
        parts = whole.split(" ")
        if known.isdisjoint(map(str.capitalize, parts)) and parts[0] not in TITLE_WORDS and "." not in whole:
            k = bisect_right(places, at - 1)
            if k == len(places) or places[k] >= run.end():
                continue
        tokens = [(m.start() + at, m.end() + at, m.group()) for m in TOKENS(whole)]
        while tokens and tokens[0][2] in TITLE_WORDS:
            tokens.pop(0)
            if tokens:
                starts.add(tokens[0][0])
                alone.add(tokens[0][0])
        if not tokens or not (any(t[0] in starts for t in tokens) or any(t[2].capitalize() in known for t in tokens)):
            continue
        for i in range(len(tokens)):
            for j in range(i, min(i + 4, len(tokens))):
                part = tokens[i : j + 1]
                if any(t[2] in NOT_NAMES for t in part) or part[-1][2].endswith("."):
                    continue
                if i == j and part[0][0] not in alone:
                    continue
                yield Span(part[0][0], part[-1][1], "name")


def _addresses(text: str) -> Iterator[re.Match]:
    """What `ADDRESS.finditer` finds, tried only at words and numbers that can open an address."""
    places = [m.start() for m in HOUSE.finditer(text)]
    for m in HOUSE_NUMBER.finditer(text):
        at = m.start()
        while at > 0 and (text[at - 1] in "#-/" or "A" <= text[at - 1] <= "Z" or text[at - 1].isdecimal()):
            at -= 1
        places += range(at, m.start() + 1)
    return _tried(ADDRESS, text, places)


def _address_spans(text: str) -> Iterator[Span]:
    """From a first word to the next postal code; where none follows, after a cue, to the end of the line or sentence."""
    pins = None
    for m in _addresses(text):
        if pins is None:
            pins = [(x.start(), x.end()) for x in PIN.finditer(text)]
        k = bisect_right(pins, (m.start() + 5, 0))
        stop = min(x.end() if x else len(text) for x in (SENTENCE_STOP.search(text, m.start()), LINES_STOP.match(text, m.start())))
        if k < len(pins) and pins[k][0] <= stop:
            if "," in text[m.start() : pins[k][0]]:
                yield Span(m.start(), pins[k][1], "address")
        elif ADDRESS_CUE.search(text[max(0, m.start() - 60) : m.start()]):
            body = re.match(r"[^\n;]*?(?=[.;।]?\s*\n|[.;।]\s+[A-Zऀ-ॿ]|[.;।]?\s*$|\s(?:and|who|has|is|was|said|spoke|sought|stands)\s)", text[m.start() : stop])
            if body and body[0].count(",") >= 2:
                yield Span(m.start(), m.start() + len(body[0].rstrip(" ,.")), "address")


def _numbers(text: str) -> Iterator[re.Match]:
    """Of what `NUMBER.finditer` finds, all of eight digits or more: each stands within one chain of digits and the marks between them."""
    for chain in DIGITS.finditer(text):
        for m in NUMBER.finditer(text, chain.start(), chain.end() + 2):
            if m.start() >= chain.end():
                break
            yield m


def _codes(text: str) -> Iterator[re.Match]:
    """What `CODE.finditer` finds, tried only at letters before a digit."""
    places = []
    for digit in CODE_DIGIT.finditer(text):
        end = digit.start() - (text[digit.start() - 1] in " -")
        at = end
        while at > 0 and end - at < 6 and text[at - 1].isascii() and text[at - 1].isalpha():
            at -= 1
        places.append(at)
    return _tried(CODE, text, places)


def without_emails(text: str) -> str:
    """`EMAIL.sub(" ", text)`, tried only before signs."""
    if "@" not in text and "at" not in text:
        return text
    out, last = [], 0
    for sign in AT.finditer(text):
        end = sign.start() - (sign.start() > last and text[sign.start() - 1].isspace())
        at = end
        while at > last and (text[at - 1].isalnum() or text[at - 1] in "_.+%-"):
            at -= 1
        while at < end and not (text[at].isascii() and text[at].isalnum()):
            at += 1
        m = EMAIL.match(text, at) if at < end else None
        if m:
            out += [text[last:at], " "]
            last = m.end()
    return "".join([*out, text[last:]])


def candidates(text: str, words: Lexicon = NO_WORDS) -> list[Span]:
    """Spans that could be mentions, by start."""
    out: set[Span] = set()
    if "@" in text or "at)" in text or "at]" in text:
        for at in AT.finditer(text):  # the pattern is tried from the word around the sign on
            m = EMAIL.search(text, max(0, text.rfind(" ", 0, max(0, at.start() - 1)) + 1, text.rfind("\n", 0, at.start()) + 1))
            if m and m.start() < at.start() < m.end():
                out.add(Span(m.start(), m.end(), "email"))
    for m in _numbers(text):
        n = sum(map(str.isdigit, m.group()))
        if 8 <= n <= 15 and not DATE.match(m.group()):
            start = m.start()
            if text[start - 1 : start] == "(" and ")" in m.group()[:7]:
                start -= 1
            out.add(Span(start, m.end(), "phone"))
            if n >= 9:
                out.add(Span(start, m.end(), "id_number"))
    for m in _codes(text):
        if sum(map(str.isdigit, m.group())) >= 4 and len(m.group()) >= 7:
            out.add(Span(m.start(), m.end(), "id_number"))
    out |= set(_address_spans(text))
    out |= set(_name_spans(text, words))
    if not text.isascii():
        for pattern in (HINDI_NAME, HINDI_OWNER):
            out |= {Span(m.start(1), m.end(1), "name") for m in pattern.finditer(text)}
    return sorted(out)


@lru_cache(maxsize=64)
def _number_cues(before: str) -> list[str]:
    """The cues that end before a number; asked for each kind that it can be."""
    identity = bool(ID_CUE.search(before))
    return ["cue phone"] * bool(PHONE_CUE.search(before)) + ["cue id"] * identity + ["cue other"] * bool(not identity and OTHER_CUE.search(before[-30:]))


def features(text: str, span: Span, words: Lexicon) -> list[str]:
    """Features of a whole span."""
    start, end, kind = span
    body = text[start:end]
    before, after = _before(text, start), _after(text, end)
    last = before[-1].lower() if before else "^"
    out = [kind]
    if kind in ("phone", "id_number"):
        out += [f"shape {_shape(body)}", f"digits {sum(c.isdigit() for c in body)}", f"before {last}", f"before2 {' '.join(before).lower()}", f"after {after}"]
        out += _number_cues(text[max(0, start - 60) : start])
        out += ["unit after"] * bool(UNIT_AFTER.match(text, end))
    elif kind == "email":
        out += [f"dot {'.' in body or 'dot' in body}", f"digit {body[0].isdigit()}", f"before {last}"]
    elif kind == "address":
        first = re.match(r"[^\W\d]*", body)[0].lower()
        out += [f"first {first}", f"before {last}", f"commas {min(4, body.count(','))}", f"long {len(body) > 110}"] + ["cue"] * bool(ADDRESS_CUE.search(text[max(0, start - 60) : start]))
    else:
        tokens = re.findall(TOKEN, body) or body.split()
        plain = [t for t in tokens if not t.endswith(".")]
        title = bool(re.search(rf"(?<!\w){TITLES}\s*$", text[max(0, start - 10) : start])) or "ऀ" <= body[:1] <= "ॿ"
        out += [f"tokens {len(tokens)}", f"plain {len(plain)}", f"title {title}", f"before {last}", f"after {after}", f"caps {body.isupper()}"]
        known = [t.capitalize() in words.given or t.capitalize() in words.family for t in plain]
        out += [f"known {sum(known)}/{len(plain)}", f"common {any(t.lower() in words.common for t in plain)}"]
        out += [f"family {plain[-1].capitalize() in words.family}" if plain else "bare", f"given {plain[0].capitalize() in words.given}" if plain else "bare"]
        out += ["place before"] * (last in PLACE_BEFORE and not title)
    return [f"{kind}:{f}" for f in out]


def clusters(spans: list[Span]) -> Iterator[list[Span]]:
    """Groups of spans that overlap in a chain."""
    group: list[Span] = []
    reach = -1
    for s in spans:
        if group and s.start >= reach:
            yield group
            group = []
        group.append(s)
        reach = max(reach, s.end) if len(group) > 1 else s.end
    if group:
        yield group


def _chain(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Order of the spans by end, and for each how many of them end before it starts."""
    order = sorted(range(len(spans)), key=lambda i: (spans[i].end, spans[i].start))
    ends = [spans[i].end for i in order]
    return order, [bisect_right(ends, spans[i].start) for i in order]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a))


def marginals(spans: list[Span], scores: list[float]) -> tuple[float, list[float]]:
    """Log of the sum over all choices of spans that do not overlap, and each span's probability."""
    order, free = _chain(spans)
    n = len(spans)
    forward = [0.0] * (n + 1)
    for k in range(1, n + 1):
        forward[k] = _log_add(forward[k - 1], scores[order[k - 1]] + forward[free[k - 1]])
    backward = [-math.inf] * (n + 1)
    backward[n] = 0.0
    prob = [0.0] * n
    for k in range(n, 0, -1):
        i = order[k - 1]
        if backward[k] == -math.inf:
            continue
        backward[k - 1] = _log_add(backward[k - 1], backward[k]) if backward[k - 1] > -math.inf else backward[k]
        f, x = free[k - 1], backward[k] + scores[i]
        backward[f] = _log_add(backward[f], x) if backward[f] > -math.inf else x
        prob[i] = math.exp(forward[f] + x - forward[n])
    return forward[n], prob


def best_choice(spans: list[Span], scores: list[float]) -> list[Span]:
    """The choice of spans that do not overlap with the greatest total score (ties: fewer spans)."""
    order, free = _chain(spans)
    total = [0.0]
    for k in range(1, len(spans) + 1):
        total.append(max(total[k - 1], scores[order[k - 1]] + total[free[k - 1]]))
    out, k = [], len(spans)
    while k:
        if total[k] == total[k - 1]:
            k -= 1
        else:
            out.append(spans[order[k - 1]])
            k = free[k - 1]
    return sorted(out)


class Field(NamedTuple):
    weights: dict
    words: Lexicon

    def score(self, text: str, span: Span) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(text, span, self.words))

    def find(self, text: str | None) -> list[Span]:
        """The mentions of a text, by start."""
        if not text:
            return []
        out = []
        for group in clusters(candidates(text, self.words)):
            out += best_choice(group, [self.score(text, s) for s in group])
        return out


FRAMES = re.compile(rf"(?<!\w)(?:{TITLES} ?|told by |nominee is |Submitted by |Copy to: |engineer, |officer: |workman |Account of |S/o |D/o |W/o |(?:faithfully|sincerely|truly|Regards),?\s*\n\(?|Sd/-\s*\n\()(?:{TITLES} ?)?({TOKEN}(?: ?(?<=\.){TOKEN}| {TOKEN}){{0,3}})(?= and | ?[,(;:\n).-]| spoke| sought| was | S/o| D/o| W/o|$| stands| may| has| holding|$)")
AND_FRAME = re.compile(rf"told by {TOKEN}(?: ?(?<=\.){TOKEN}| {TOKEN}){{0,3}} and ({TOKEN}(?: ?(?<=\.){TOKEN}| {TOKEN}){{0,3}})(?=,| )")


def cue_labels(text: str, spans: list[Span]) -> tuple[set[Span], set[Span]]:
    """Spans that cues say are mentions, and spans that they leave open."""
    sure: set[Span] = set()
    open_: set[Span] = set()
    names = {(m.start(1), m.end(1)) for f in (FRAMES, AND_FRAME) for m in f.finditer(text)}
    names = {(a, b) for a, b in names if text[a:b].split(" ")[0] not in NOT_NAMES | TITLE_WORDS}
    for s in spans:
        before = text[max(0, s.start - 60) : s.start]
        if s.kind == "email":
            sure.add(s) if "." in text[s.start : s.end] or "dot" in text[s.start : s.end] else None
        elif s.kind in ("phone", "id_number"):
            phone, identity, other = PHONE_CUE.search(before), ID_CUE.search(before), OTHER_CUE.search(before) or UNIT_AFTER.match(text, s.end)
            if other and not identity:
                continue
            if s.kind == "phone" and (phone or text[s.start] == "+") or s.kind == "id_number" and identity and not phone:
                sure.add(s)
            elif not phone and not identity:
                open_.add(s)
        elif s.kind == "address":
            if ADDRESS_CUE.search(before) or before.endswith("\n"):
                sure.add(s)
        elif (s.start, s.end) in names or "ऀ" <= text[s.start] <= "ॿ":
            sure.add(s)
        elif not any(s.start < b and a < s.end for a, b in names):
            open_.add(s)
    # of overlapping sure spans of one kind the one that starts first (the longest of these) holds
    kept: list[Span] = []
    for s in sorted(sure, key=lambda s: (s.start, -s.end)):
        if all(s.start >= k.end or s.end <= k.start for k in kept):
            kept.append(s)
    return set(kept), open_


def lower_words(text: str) -> set[str]:
    """Each lower-case word of a text once; mailboxes are named for persons."""
    return set(LOWER_CASE(without_emails(text)))


def framed_words(text: str) -> Iterator[tuple[str, str]]:
    """(role, word) of the first and last words of framed names."""
    for found in (_tried(FRAMES, text, _cue_places(text)), AND_FRAME.finditer(text)):
        for m in found:
            tokens = [t.capitalize() for t in re.findall(TOKEN, m[1]) if not t.endswith(".")]
            if len(tokens) > 1:
                yield "given", tokens[0]
            if tokens:
                yield "family", tokens[-1]


def word_counts(text: str) -> Iterator[tuple[str, str]]:
    """(role, word) of a text: each lower-case word once, and the first and last words of framed names."""
    for w in lower_words(text):
        yield "lower", w
    yield from framed_words(text)


def lexicon_of(counts: dict[tuple[str, str], int]) -> Lexicon:
    """Framed name words that are not common.

    A word is common if it is lower case in at least two texts, and in at least as many as it
    is framed as a name: however many texts there are, a stray spelling makes no name common.
    """
    framed: Counter = Counter()
    for (role, w), n in counts.items():
        framed[w] = max(framed[w], n) if role != "lower" else framed[w]
    common = frozenset(w for (role, w), n in counts.items() if role == "lower" and n >= max(2, framed[w.capitalize()]))
    bad = {w.capitalize() for w in common} | NOT_NAMES | TITLE_WORDS
    given, family = (frozenset(w for role, w in counts if role == kind and w not in bad) for kind in ("given", "family"))
    return Lexicon(given, family, common)


def lexicon(df: DataFrame, text: str = "text") -> Lexicon:
    """The lexicon of all documents, of any length. Words come to the driver that are framed as names, or that are lower case in two documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, framed = Counter(), Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                lower.update(lower_words(t))
                framed.update(framed_words(t))
            if len(lower) + len(framed) > 400_000:
                yield out(lower, framed)
                lower, framed = Counter(), Counter()
        yield out(lower, framed)

    def out(lower: Counter, framed: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*["lower"] * len(lower), *(r for r, _ in framed)], pa.string()), pa.array([*lower, *(w for _, w in framed)], pa.string()), pa.array([*lower.values(), *framed.values()], pa.int64())], names=["role", "word", "n"])

    rows = df.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "role string, word string, n bigint")
    kept = rows.groupBy("role", "word").agg(F.sum("n").alias("n")).where("role <> 'lower' OR n >= 2").collect()
    return lexicon_of({(r.role, r.word): r.n for r in kept})


def learn(texts: list[str], epochs: int = 4, rate: float = 0.3, decay: float = 1e-3, seed: int = 3, words: Lexicon | None = None) -> Field:
    """A field fitted to cue-labelled texts by stochastic gradient of the conditional likelihood; without `words` their own lexicon is taken."""
    words = words or lexicon_of(Counter(x for text in texts for x in word_counts(text)))
    examples = []
    for text in texts:
        spans = candidates(text, words)
        sure, open_ = cue_labels(text, spans)
        for group in clusters(spans):
            gold = [s in sure for s in group]
            if not any(gold) and any(s in open_ for s in group):
                continue
            # of the group only spans that the cues decide
            keep = [i for i, s in enumerate(group) if s not in open_ or any(gold)]
            examples.append(([group[i] for i in keep], [features(text, group[i], words) for i in keep], [gold[i] for i in keep]))
    weights: dict[str, float] = defaultdict(float)
    rng = random.Random(seed)
    for epoch in range(epochs):
        rng.shuffle(examples)
        step = rate / (1 + epoch)
        for spans, feats, gold in examples:
            scores = [sum(weights[f] for f in fs) for fs in feats]
            _, prob = marginals(spans, scores)
            for fs, g, p in zip(feats, gold, prob, strict=True):
                if abs(g - p) > 1e-3:
                    for f in fs:
                        weights[f] += step * (g - p) - step * decay * weights[f]
    return Field({f: round(w, 5) for f, w in weights.items() if abs(w) > 1e-4}, words)


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCUMENTS) -> Field:
    """The field: its lexicon from all documents, its weights from about `sample` of them, chosen by hash."""
    rows = df.where(F.col(text).isNotNull())
    n = max(1, rows.count())
    picked = rows.where(F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / n))).orderBy(key).select(text).collect()  # about `sample` rows
    return learn([r[0] for r in picked], words=lexicon(spread(df.select(key, text), key), text))


def mentions(df: DataFrame, field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `kind`, `start_pos` (characters from 0), `end_pos` of each mention; rows without a key are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = field.value.find
        for batch in batches:
            rows = [(i, s.kind, s.start, s.end) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in find(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((batch.schema.field(0).type, pa.string(), pa.int32(), pa.int32()))], names=[key, "kind", "start_pos", "end_pos"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.where(F.col(key).isNotNull()).select(key, text), key).mapInArrow(run, f"`{key}` {kind}, kind string, start_pos int, end_pos int")


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in brackets; all else as it was."""
    if not spans:
        return text
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `text` with placeholders, `mentions` (how many); NULL and empty texts stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = field.value.find
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [find(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([redact(t, s) for t, s in zip(texts, found, strict=True)], pa.string()), pa.array(list(map(len, found)), pa.int32())], names=[key, "text", "mentions"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key), F.col(text).alias("text")), key).mapInArrow(run, f"`{key}` {kind}, text string, mentions int")
