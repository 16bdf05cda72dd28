"""Personal information inside free text, by a skip-chain conditional random field.

A text's nodes are lexical units found in one pass: strings shaped like an
e-mail address, a long number or a street address, and the tokens of a possible
person's name. Node potentials are log-linear in the unit's shape and its
neighbouring words. Chain edges join the tokens of one name; skip edges join
equal or similar units however far apart (a surname in another case or as part
of a double one, an initial and the given name it stands for, a number with and
without its prefix), so that what is recognised by its context in one place
carries its label to the others. Loopy belief propagation, run until no belief
moves, gives each node's label.

Name nodes are the words that a cue introduces in any document, every repetition
of such a word in its document, and the words whose stem names people often
enough, by counts over all documents.

The field is fitted on a bounded sample of distinct texts. Titles, verbs of speech
and the usual labels of numbers and addresses ("tel", "passport", "Anschrift")
label some of its nodes; the others are hidden. Unary weights and the potentials
of chain and skip edges together maximise the pseudo-likelihood of the labels,
hidden nodes standing in with their current marginals, which is repeated as the
marginals change.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents of the training sample: those of least text hash, of at most so many characters each.
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 4000, 50_000
#: Fits of the pseudo-likelihood, each with new marginals of the hidden nodes, and the gradient steps of each.
FITS, STEPS, RATE, DECAY = 3, 80, 0.5, 1e-4
#: Log odds that a cue gives to the label it stands for.
CUE = 4.0
#: Beliefs that move less than this are settled; a graph that is not settled by the last round keeps its beliefs.
SETTLED, MOST_ROUNDS = 1e-3, 1000
#: Characters of texts that form one graph.
GRAPH_CHARS = 1 << 21
LABELS = ("none", "email", "phone", "id_number", "address", "name")
_OF = {name: i for i, name in enumerate(LABELS)}
_ALLOWED = {"E": ("email",), "N": ("phone", "id_number"), "A": ("address",), "P": ("name",), "G": ("name",), "H": ("name",)}

# Vocabulary of titles, street words, company words and cues.
TITLES = "Mr Mrs Ms Miss Dr Prof Professor Doctor Doktor Sir Herr Frau Sr Sra Srta Don Doña Mme Mlle Monsieur Madame".split()
_STREETS = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Close|Row|Terrace|Way|Boulevard|Blvd|Drive|Dr|Court|Ct|Place|Pl|Square|Sq|Crescent|Gardens|Parade"
_VOIES = "rue|avenue|boulevard|impasse|place|chemin|allée|quai|ruelle|sentier"
_VIAS = r"Calle|Avda\.?|Avenida|Plaza|Pza\.?|Paseo|Camino|Ronda|Carretera|Travesía|Cuesta|C/"
_VIA_HINTS = tuple(word.removesuffix(r"\.?") for word in _VIAS.split("|"))
_PHONE_CUE = re.compile(
    r"(?:\btel|\btél|telefon|erreichbar|phone|\bfax|mobile|\bcall|rufnummer|portable|appeler|llame|llamar|móvil|电话|電話|手机|携帯)"
    r"[^\d\n]{0,24}$",
    re.IGNORECASE,
)
_ID_CUE = re.compile(
    r"(?:\bssn|social security|soc\. sec|national insurance|\bni\b|passport|licen[cs]e|steuer-?id|ausweis|\bnif\b|\bdni\b|\bnie\b"
    r"|\bnir\b|sécu|pasaporte|マイナンバー|個人番号|身份证|护照)[^\d\n]{0,26}$",
    re.IGNORECASE,
)
_OTHER_CUE = re.compile(
    r"(?:order|ticket|part no\.?|record|range|index|\blot|version|invoice|serial|ref\.?)[^\d\n]{0,14}$", re.IGNORECASE
)
_PLACE_CUE = re.compile(
    r"(?:address(?: is)?:?|mail:|lives? at|located at|anschrift:?|adresse ?:?|wohnhaft in|domicile ?:?|domicilio:?|dirección:?|住所は?|地址[:：]?)\s*$",
    re.IGNORECASE,
)
_CAP = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:[’'-][^\W\d_]+)*"
_INITIAL = r"[^\W\d_a-zß-öø-ÿ]\."
_TITLE = rf"(?:(?:{'|'.join(TITLES)})\.?|M\.)"
_RUN = rf"((?:{_INITIAL} ?|{_CAP} ){{0,3}}{_CAP})(?![^\W\d_])"
_CUES = (
    "said", "says", "told", "Reporting by", "reporting by", "Written by", "written by", "asked by", "Asked by", "named", "According to", "according to",
    "sagte", "sagt", "estime", "dirigé par", "dijo", "dice", "nombró a",
)
_NAME_CUE = re.compile(rf"\b(?:{'|'.join(_CUES)})\s+(?:{_TITLE} )?{_RUN}")
_TITLE_CUE = re.compile(rf"(?<!\w){_TITLE}\s+{_RUN}")
_CAPITAL = re.compile(rf"(?<![\w@.'’+-]){_CAP}")
_NAME_BEFORE = re.compile(
    rf"(?:\b(?:{'|'.join(_CUES)})|{_TITLE})\s+(?:{_TITLE}\s+)?$"
)
_NAME_AFTER = re.compile(r"(?:, (?:who|head of|chief)\b| (?:said|says|told|sagte|sagt|dijo|dice|estime)\b)")
_NO_NAME_AFTER = re.compile(rf"(?: (?:Tooling|Inc|Ltd|GmbH|Co|Corp|Group)\b| & Sons| (?:{_STREETS})\b)")
_COMPANY_WORD = re.compile(r"(?:Tooling|Inc|Ltd|GmbH|Co|Corp|Group)$")
_COMPANY_AFTER = re.compile(r" (?:and|&) [A-Z][\w-]+ &")

_AT = re.compile(r"@|＠| ?\(at\) ?| ?\[at\] ?")
_AT_SIGNS = ("@", "＠", "(at)", "[at]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._+%-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?)[A-Za-z0-9-]+)*(?:\.| ?\(dot\) ?| ?\[dot\] ?)[A-Za-z]{2,}")
#: Words of a street's name.
STREET_WORDS = 12
_GAP = "().\\-‐–－/ \u00a0"
_NUMBER = re.compile(rf"\d(?=[\d{_GAP}]{{4}})\d*(?:[{_GAP}]{{1,2}}\d+)*(?:\s?(?:ext\.?|x|Durchwahl)\s?\d{{1,5}}\b)?")
_BRACKET = re.compile(r"\([+＋]?\d{1,5}\)")
_ID_HEAD = re.compile(r"(?<![A-Za-z0-9-])(?:[A-Z]{1,2}|(?!ID|NO|NR|NI)[A-Z]{2} )$")
_ID_TAIL = re.compile(r"-?[A-Z](?![A-Za-z0-9])")
_ID_TAIL_SPACED = re.compile(r" ?-?[A-Z](?![A-Za-z0-9])")
_TOWN = r"(?:,? (?:Suite|Flat|Apt\.?|Unit) \d+[A-Z]?)?(?:, [A-Z][\w’'-]+(?:,? \d{5})?)?"
_STREET_FIRST_NUMBER = re.compile(
    rf"(?<![\w.,/£€$+-])(?:(?:Flat|Apt\.?|Apartment|Unit) \d+[A-Z]?, )?\d{{1,4}}"
    rf"(?:[A-Z]? [A-Z][\w’'-]*(?: [^\W\d][\w’'-]*){{0,{STREET_WORDS}}}? (?:{_STREETS})\b\.?{_TOWN}|(?: ?(?:bis|ter|quater))?,? (?:{_VOIES})\b(?: [\w’'-]+){{1,{STREET_WORDS}}}(?:, (?:\d{{5}} )?[A-Z][\w’'-]+)?)",
)
_STRASSE = re.compile(
    r"(?:\b[A-ZÄÖÜ][\wäöüß-]*?(?:straße|strasse|str\.|weg|platz|gasse|allee|damm|ufer|STRASSE)"
    r"|\b(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Auf der|Unter den|Hinter der) [A-ZÄÖÜ][\wäöüß-]+)"
    r" \d{1,4} ?[a-z]?\b(?:, (?:\d{5} )?[A-ZÄÖÜ][\wäöüß-]+)?"
)
_STRASSE_HINTS = (
    "traße ", "trasse ", "STRASSE ", "tr. ", "weg ", "platz ", "gasse ", "allee ", "damm ", "ufer ", "Am ", "An de", "Im ", "In der ",
    "Zum ", "Zur ", "Auf de", "Unter den ", "Hinter der ",
)
_VIA = re.compile(
    rf"(?<!\w)(?:{_VIAS})(?: (?:de|del|la|las|los|el))* [A-ZÁÉÍÓÚÑ]?[\wáéíóúñ]+(?: [A-ZÁÉÍÓÚÑ][\wáéíóúñ]+)?,? (?:n\.?º ?)?\d{{1,4}}\b"
    r"(?:, \d{1,2}\.º(?: [A-Z])?)?(?:, (?:\d{5} )?[A-ZÁÉÍÓÚÑ][\wáéíóúñ]+)?"
)
_HAN = "一-鿿々"
_KEN = re.compile(rf"[{_HAN}]{{2,3}}[都道府県](?=[{_HAN}])[{_HAN}ァ-ヶー]*?[市区町村郡][{_HAN}ァ-ヶー]*(?:\d+(?:丁目|番地?|号|[-－−])?)+")
_SHENG = re.compile(rf"(?:黑龙江|内蒙古|[{_HAN}]{{2}})(?:省|自治区)(?=[{_HAN}]{{2,6}}市)[{_HAN}]*\d+[号弄](?:\d+[栋幢座])?(?:\d+室)?")
_HAN_NAMES = re.compile(
    rf"(?<![{_HAN}])[{_HAN}]{{1,4}}[ 　]?[{_HAN}]{{1,3}}?(?=氏|さん|様)|(?<=由)[{_HAN}]{{2,4}}(?=出任|担任)|(?<![{_HAN}A-Za-z])[{_HAN}]{{2,4}}(?=表示[“\"「])"
)
_HAN_SIGNS = ("氏", "さん", "様", "由", "表示")
_WORDS_BEFORE = re.compile(r"[^\W\d_]+\.?|[^\w\s]")


@dataclass
class Unit:
    """One node: its kind of unit, span, normal form, and the features of its potential."""

    kind: str
    start: int
    end: int
    form: str
    features: list[str] = field(default_factory=list)
    weak: int = -1


#: Features of a unit that come from the words around it; they stand first.
CONTEXT = 7


def _context(text: str, unit: Unit) -> list[str]:
    before = text[max(0, unit.start - 28) : unit.start]
    words = [w.lower() for w in _WORDS_BEFORE.findall(before)][-3:]
    after = _WORDS_BEFORE.findall(text[unit.end : unit.end + 16])[:2]
    k = unit.kind
    out = [f"{k}<{' '.join(words[-1:])}", f"{k}<<{' '.join(words[-2:])}", f"{k}<<<{' '.join(words)}"]
    return [*out, f"{k}>{' '.join(after[:1])}", f"{k}>>{' '.join(after)}", f"{k}c{before[-2:]}", f"{k}d{before[-4:]}", k]


def _shape(value: str) -> str:
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", value))


def _emails(text: str) -> Iterator[Unit]:
    if not any(sign in text for sign in _AT_SIGNS):
        return
    for at in _AT.finditer(text):
        start = at.start()
        while start and text[start - 1] in _LOCAL:
            start -= 1
        while start < at.start() and text[start] in "._+%-":
            start += 1
        host = _HOST.match(text, at.end())
        if start < at.start() and host:
            unit = Unit("E", start, host.end(), text[start : host.end()].lower())
            unit.features = [*_context(text, unit), f"Ea{at[0].strip()}", f"Et{host[0][-5:].lower()}"]
            unit.weak = _OF["email"]
            yield unit


def _numbers(text: str) -> Iterator[Unit]:
    for found in _NUMBER.finditer(text):
        start, end = found.span()
        last = text[start - 1] if start else " "
        if last in "£€$.,/%_@" or (last == "-" and start > 1 and text[start - 2].isalnum()):
            continue
        letters = False
        if last in "+＋":
            start -= 1
        elif last.isascii() and (last.isalpha() or (last == " " and start > 2 and text[start - 2].isupper())):
            head = _ID_HEAD.search(text[max(0, start - 5) : start])
            if head:
                start -= len(head[0])
                letters = True
            elif last.isalpha():
                continue
        if start and text[start - 1] == "(" and _BRACKET.match(text, start - 1):
            start -= 1
        tail = (_ID_TAIL_SPACED if letters else _ID_TAIL).match(text, end)
        if tail:
            end = tail.end()
            letters = True
        value = text[start:end]
        digits = sum(map(str.isdigit, value))
        if not (6 if letters else 7) <= digits <= 20:
            continue
        unit = Unit("N", start, end, re.sub(r"\W", "", value))
        shape = _shape(value)
        unit.features = [*_context(text, unit), f"Ns{shape}", f"Nn{digits}", f"Nh{shape[:5]}", f"Nr{re.sub('9+', '9', shape)}"]
        before = text[max(0, start - 48) : start]
        cue = (_PHONE_CUE.search(before), _ID_CUE.search(before), _OTHER_CUE.search(before))
        if any(cue):
            # The nearest cue decides.
            near = max(range(3), key=lambda i: cue[i].start() if cue[i] else -1)
            unit.weak = (_OF["phone"], _OF["id_number"], _OF["none"])[near]
        yield unit


def _addresses(text: str) -> Iterator[Unit]:
    patterns = [_STREET_FIRST_NUMBER]
    if any(word in text for word in _STRASSE_HINTS):
        patterns.append(_STRASSE)
    if any(word in text for word in _VIA_HINTS):
        patterns.append(_VIA)
    if "県" in text or "都" in text or "府" in text or "道" in text:
        patterns.append(_KEN)
    if "省" in text or "自治区" in text:
        patterns.append(_SHENG)
    for number, pattern in enumerate(patterns):
        for found in pattern.finditer(text):
            unit = Unit("A", found.start(), found.end(), found[0].lower())
            unit.features = [*_context(text, unit), f"Ap{pattern.pattern[:12]}"]
            if _PLACE_CUE.search(text[max(0, found.start() - 32) : found.start()]):
                unit.weak = _OF["address"]
            yield unit


_GIVEN = re.compile(rf"(?:{_CAP}|{_INITIAL}|{_TITLE})")
_OPENING = "“„«\"'(>。"


def _token_before(text: str, left: int, floor: int) -> tuple[int, int] | None:
    """Span of a given name, initial or title right before ``left``, one white space between, not before ``floor``."""
    end = left - 1
    if end <= floor or not text[end].isspace() or text[end] == "\n":
        return None
    begin = end
    while begin > floor and not text[begin - 1].isspace() and text[begin - 1] not in _OPENING:
        begin -= 1
    return (begin, end) if _GIVEN.fullmatch(text, begin, end) else None


class _Spans:
    """Disjoint spans of a text, to ask whether another one overlaps them."""

    def __init__(self) -> None:
        self._spans: list[tuple[int, int]] = []

    def add(self, start: int, end: int) -> None:
        insort(self._spans, (start, end))

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self._spans, (start, start))
        return (at > 0 and self._spans[at - 1][1] > start) or (at < len(self._spans) and self._spans[at][0] < end)


def _surname(found: re.Match[str]) -> tuple[int, int]:
    """Span of the last word of a run that a cue introduces, without a possessive s."""
    word = re.sub(r"['’]s$", "", re.split(r"[ .]", found[1])[-1])
    start = found.end(1) - len(re.split(r"[ .]", found[1])[-1])
    return start, start + len(word)


def _introduced(text: str) -> Iterator[re.Match[str]]:
    """Word runs that a name cue or a title introduces."""
    if any(cue in text for cue in _CUES):
        yield from _NAME_CUE.finditer(text)
    if "M." in text or any(title in text for title in TITLES):
        yield from _TITLE_CUE.finditer(text)


def _surnames(text: str, anchors: re.Pattern[str] | None) -> list[tuple[int, int]]:
    """Spans of possible surnames: words with a name stem, words after a cue, and every repetition of the latter."""
    spans = [found.span() for found in anchors.finditer(text)] if anchors is not None else []
    held = _Spans()
    for span in spans:
        held.add(*span)
    more: set[tuple[int, int]] = set()
    forms = set()
    for found in _introduced(text):
        start, end = found.span(1)
        word = slice(*_surname(found))
        company = _COMPANY_WORD.match(text[word]) or _NO_NAME_AFTER.match(text, word.stop)
        if not company and not held.meets(start, end):
            more.add((word.start, word.stop))
            forms.add(text[word].lower())
    for span in more:
        if not held.meets(*span):
            held.add(*span)
            spans.append(span)
    if forms:
        for found in _CAPITAL.finditer(text):
            form = re.sub(r"['’]s$", "", found[0])
            if form.lower() in forms and not held.meets(*found.span()):
                spans.append((found.start(), found.start() + len(form)))
    return sorted(set(spans))


def _names(text: str, anchors: re.Pattern[str] | None, taken: _Spans) -> Iterator[list[Unit]]:
    """Each possible name as its nodes, the surname last; the words before a surname belong to it up to the surname before."""
    floor = 0
    for start, end in _surnames(text, anchors):
        if taken.meets(start, end):
            continue
        surname = Unit("P", start, end, text[start:end].lower())
        given: list[Unit] = []
        left = start
        while token := _token_before(text, left, floor):
            given.append(Unit("G", *token, text[slice(*token)].lower()))
            left = token[0]
        floor = end
        yield _named(text, given[::-1], surname)
    # Each alternative of the pattern needs one of these.
    for found in _HAN_NAMES.finditer(text) if not text.isascii() and any(sign in text for sign in _HAN_SIGNS) else ():
        unit = Unit("H", found.start(), found.end(), found[0])
        unit.features = _context(text, unit)
        unit.weak = _OF["name"]
        yield [unit]


def _named(text: str, given: list[Unit], surname: Unit) -> list[Unit]:
    token, after = surname.form, text[surname.end : surname.end + 28]
    first = given[0].start if given else surname.start
    before = text[max(0, first - 32) : first]
    company = bool(_NO_NAME_AFTER.match(after) or _COMPANY_AFTER.match(after))
    street = bool(re.search(r"\d[A-Z]?\s+$", before)) and bool(re.match(rf" (?:{_STREETS})\b", after))
    surname.features = [
        *_context(text, surname), f"Pp{token[:4]}", f"Pq{token[:5]}", f"Ps{token[-4:]}", f"Pl{bool(given)}",
        f"Pk{company}",
    ]
    if company or street:
        surname.weak = _OF["none"]
    elif _NAME_BEFORE.search(before) or _NAME_AFTER.match(after):
        surname.weak = _OF["name"]
    french = bool(re.search(r"(?:estime|par|selon|Selon)\s+$", before))
    for i, unit in enumerate(given):
        word = text[unit.start : unit.end]
        title = word.rstrip(".") in TITLES or word.rstrip(".").capitalize() in TITLES or (word == "M." and i == 0 and french)
        unit.features = [*[f"G<{i}"] * CONTEXT, "G", f"Gt{title}", f"Gw{unit.form}", f"Gi{len(word) == 2}", f"Gk{company}", f"Gp{i}"]
        if title or surname.weak == _OF["none"]:
            unit.weak = _OF["none"]
        elif surname.weak == _OF["name"]:
            unit.weak = _OF["name"]
    return [*given, surname]


class Graph:
    """Nodes and edges of many documents, collected one after another."""

    def __init__(self) -> None:
        self.units: list[Unit] = []
        self.names: list[tuple[int, int, int]] = []  # document, first node, node after the last
        self.alone: list[tuple[int, int]] = []  # document, node
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, document: int, text: str, anchors: re.Pattern[str] | None) -> None:
        taken = _Spans()
        alike: dict[tuple[str, str], int] = {}
        for unit in (*_emails(text), *_addresses(text)):
            if not taken.meets(unit.start, unit.end):
                taken.add(unit.start, unit.end)
                self._alone(document, unit, alike)
        for unit in _numbers(text):
            if not taken.meets(unit.start, unit.end):
                self._alone(document, unit, alike)
        for group in _names(text, anchors, taken):
            first = len(self.units)
            self.units.extend(group)
            self.names.append((document, first, len(self.units)))
            self.chain.extend((i, i + 1) for i in range(first, len(self.units) - 1))
            last = group[-1]
            self._join(len(self.units) - 1, alike, [("name", part) for part in {last.form, *last.form.split("-")}])
            for i, unit in enumerate(group[:-1], first):
                # A given name and its initial, next to the same surname.
                self._join(i, alike, [(last.form, unit.form[0]), (last.form, unit.form)])

    def _alone(self, document: int, unit: Unit, alike: dict[tuple[str, str], int]) -> None:
        self.alone.append((document, len(self.units)))
        self.units.append(unit)
        digits = re.sub(r"\D", "", unit.form)
        keys = [(unit.kind, unit.form)] if unit.kind != "N" or len(digits) < 7 else [(unit.kind, unit.form), (unit.kind, digits[-7:])]
        self._join(len(self.units) - 1, alike, keys)

    def _join(self, node: int, alike: dict[tuple[str, str], int], keys: list[tuple[str, str]]) -> None:
        """Skip edges to the last node of each key, which link all nodes of one key one to the next."""
        for other in {alike[key] for key in keys if key in alike}:
            self.skip.append((other, node))
        alike.update((key, node) for key in keys)


@dataclass
class Field:
    """A fitted field: feature index, weights by label, and log potentials of chain and skip edges."""

    index: dict[str, int]
    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    anchors: str

    def unary(self, units: list[Unit]) -> np.ndarray:
        get = self.index.get
        rows, cols = [], []
        for i, unit in enumerate(units):
            for name in unit.features:
                j = get(name)
                if j is not None:
                    rows.append(i)
                    cols.append(j)
        score = np.zeros((len(units), len(LABELS)))
        if rows:
            starts = np.flatnonzero(np.diff(rows, prepend=-1))
            score[np.asarray(rows)[starts]] = np.add.reduceat(self.weights[cols], starts, axis=0)
        # A cue around a unit is evidence of its own; learned weights are of shapes and contexts only.
        weak = np.array([u.weak for u in units])
        score[np.flatnonzero(weak >= 0), weak[weak >= 0]] += CUE
        return score + _mask(units)

    def beliefs(self, graph: Graph) -> np.ndarray:
        """Log belief of every node, by loopy belief propagation."""
        score = self.unary(graph.units)
        edges = [*graph.chain, *graph.skip]
        if edges:
            potential = np.concatenate((np.repeat(self.chain[None], len(graph.chain), 0), np.repeat(self.skip[None], len(graph.skip), 0)))
            score = propagate(score, np.asarray(edges), potential)
        return score

    def labels(self, graph: Graph) -> np.ndarray:
        return self.beliefs(graph).argmax(1)


def propagate(unary: np.ndarray, edges: np.ndarray, potential: np.ndarray, rounds: int = MOST_ROUNDS) -> np.ndarray:
    """Log beliefs of nodes after sum-product rounds; every edge carries a message each way.

    Only messages from nodes whose belief moved in the last round are sent
    again, until none moves.
    """
    source = np.concatenate((edges[:, 0], edges[:, 1]))
    target = np.concatenate((edges[:, 1], edges[:, 0]))
    both = np.concatenate((potential, potential.transpose(0, 2, 1)))
    back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
    message = np.zeros((len(source), unary.shape[1]))
    belief = unary.copy()
    active = np.arange(len(source))
    for _ in range(rounds):
        out = (belief[source[active]] - message[back[active]])[:, :, None] + both[active]
        top = out.max(1, keepdims=True)
        fresh = np.log(np.exp(out - top).sum(1)) + top[:, 0]
        fresh -= fresh.max(1, keepdims=True)
        step = 0.7 * (fresh - message[active])
        message[active] += step
        np.add.at(belief, target[active], step)
        moved = np.zeros(len(unary), bool)
        moved[target[active][np.abs(step).max(1) > SETTLED]] = True
        # A message that has not reached its value yet is sent again too.
        again = np.zeros(len(source), bool)
        again[active[np.abs(step).max(1) > SETTLED]] = True
        active = np.flatnonzero(moved[source] | again)
        if not len(active):
            break
    return belief


def _mask(units: list[Unit]) -> np.ndarray:
    rows = {k: np.array([0.0 if n == "none" or n in _ALLOWED[k] else -1e4 for n in LABELS]) for k in _ALLOWED}
    return np.stack([rows[u.kind] for u in units]) if units else np.zeros((0, len(LABELS)))


def _stems(word: str) -> set[str]:
    """The first three and four letters of a word, or all of a shorter one."""
    return {word[:3].lower(), word[:4].lower()}


def stem_counts(texts: Iterable[str | None]) -> dict[str, list[int]]:
    """Stem: how often a word with it stands after a name cue, and how often at all."""
    named: Counter[str] = Counter()
    every: Counter[str] = Counter()
    for text in texts:
        if text:
            every.update(_CAPITAL.findall(text))
            named.update(text[slice(*_surname(found))] for found in (_NAME_CUE.finditer(text) if any(cue in text for cue in _CUES) else ()))
    counts: dict[str, list[int]] = {}
    for i, words in enumerate((named, every)):
        for word, n in words.items():
            for stem in _stems(word):
                counts.setdefault(stem, [0, 0])[i] += n
    return counts


def name_stems(counts: dict[str, list[int]]) -> str:
    """Pattern of possible surnames: words whose first three or four letters stand in name contexts often enough."""
    # A shorter stem stands for more words, so more of them must be names.
    short = {s for s, (n, every) in counts.items() if 1 < len(s) < 4 and n and n >= 0.3 * every}
    stems = short | {s for s, (n, every) in counts.items() if len(s) == 4 and n and n >= 0.12 * every and s[:3] not in short}
    # A longer stem that names hardly anyone is left out of its shorter one; the shorter one's rate counts as one word.
    rate = {s: counts[s][0] / max(1, counts[s][1]) for s in short}
    barred: dict[str, set[str]] = {}
    for s, (n, every) in counts.items():
        if len(s) == 4 and s[:3] in short and n + rate[s[:3]] < 0.12 * (every + 1):
            barred.setdefault(s[:3], set()).update((s[3], s[3].upper()))
    after = {s: f"(?![{re.escape(''.join(sorted(barred[s])))}])" if s in barred else "(?!\\w)" if len(s) == 2 else "" for s in stems}
    cases = sorted({re.escape(c) + after[s] for s in stems for c in (s.capitalize(), s.title(), s.upper())})
    return rf"(?<![\w@.'’+-])(?:{'|'.join(cases)})[^\W\d_]*(?:-[^\W\d_]+)?(?![\w@])" if cases else ""


class _Sums:
    """Sums, by slot, of a table's rows that ``source`` names; sorted once for all tables."""

    def __init__(self, slot: np.ndarray, source: np.ndarray, slots: int) -> None:
        order = np.argsort(slot, kind="stable")
        kept = slot[order]
        self._source = source[order]
        self._starts = np.flatnonzero(np.diff(kept, prepend=-1))
        self._at, self._slots = kept[self._starts], slots

    def __call__(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros((self._slots, table.shape[1]))
        if len(self._at):
            out[self._at] = np.add.reduceat(table[self._source], self._starts, axis=0)
        return out


def _marginals(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(texts: list[str], anchors: str | None = None) -> Field:
    """The field fitted on some texts; without any it labels nothing but by shape. Name stems come from the texts unless given.

    Each fit climbs the pseudo-likelihood: every node's label given the labels
    of its neighbours, weak labels where there are some and marginals of the
    last propagation elsewhere. Hidden nodes count with the confidence of their
    marginals, so that contexts are learned from mentions a skip edge reaches.
    """
    if anchors is None:
        anchors = name_stems(stem_counts(texts))
    pattern = re.compile(anchors) if anchors else None
    graph = Graph()
    for i, text in enumerate(texts):
        graph.add(i, text, pattern)
    units, width = graph.units, len(LABELS)
    counts = Counter(f for u in units for f in u.features)
    index = {f: i for i, f in enumerate(sorted({f for f, n in counts.items() if n >= 2} | set(_ALLOWED)))}
    weights = np.zeros((len(index), width))
    # Without evidence a unit takes its own kind's first label.
    for kind, allowed in _ALLOWED.items():
        weights[index[kind], _OF[allowed[0]]] = 0.5
    # Equal and joined units start out inclined to agree.
    agree = (np.eye(width), 3.0 * np.eye(width))
    model = Field(index, weights, agree[0].copy(), agree[1].copy(), anchors)
    if not units:
        return model
    weak = np.array([u.weak for u in units])
    known = weak >= 0
    truth = np.where(known[:, None], np.eye(width)[np.maximum(weak, 0)], 0.0)
    pairs = [(r, index[f]) for r, u in enumerate(units) for f in u.features if f in index]
    # Labelled nodes are seen once more without the words around them, which a cue would otherwise explain alone.
    shown = np.flatnonzero(known)
    pairs += [(len(units) + j, index[f]) for j, r in enumerate(shown) for f in units[r].features[CONTEXT:] if f in index]
    rows, cols = np.array(pairs, np.int64).T
    by_row, by_col = _Sums(rows, cols, len(units) + len(shown)), _Sums(cols, rows, len(index))
    edges = [np.array(e, np.int64).reshape(-1, 2) for e in (graph.chain, graph.skip)]
    into = [(_Sums(e[:, 0], e[:, 1], len(units)), _Sums(e[:, 1], e[:, 0], len(units))) for e in edges]
    mask = np.concatenate((_mask(units), _mask([units[r] for r in shown])))
    squares = [np.full(x.shape, 1e-8) for x in (weights, model.chain, model.skip)]
    label = truth
    for turn in range(FITS):
        # The first fit knows the weak labels only; later ones know the marginals of the hidden nodes too.
        weight = known.astype(float) if turn == 0 else np.where(known, 1.0, np.maximum(0.0, 2.0 * label.max(1) - 1.0))
        if not weight.any():
            break
        for _ in range(STEPS):
            score = by_row(model.weights) + mask
            for e, (left, right), potential in zip(edges, into, (model.chain, model.skip), strict=True):
                if len(e):
                    score[: len(units)] += left(label @ potential.T) + right(label @ potential)
            gap = (np.concatenate((label, truth[shown])) - _marginals(score)) * np.concatenate((weight, np.ones(len(shown))))[:, None]
            grads = [by_col(gap)]
            for e in edges:
                grads.append(gap[e[:, 0]].T @ label[e[:, 1]] + label[e[:, 0]].T @ gap[e[:, 1]])
            # A skip edge has no direction.
            grads[2] = (grads[2] + grads[2].T) / 2
            # Weights are drawn to zero, potentials to the agreement they start from.
            for x, prior, grad, square in zip((model.weights, model.chain, model.skip), (0.0, *agree), grads, squares, strict=True):
                step = grad / (weight.sum() + len(shown)) - DECAY * (x - prior)
                square += step * step
                x += RATE * step / np.sqrt(square)
        label = np.where(known[:, None], truth, _marginals(model.beliefs(graph)))
    return model


def _graphs(texts: list[str | None], anchors: re.Pattern[str] | None) -> Iterator[Graph]:
    graph, size = Graph(), 0
    for i, text in enumerate(texts):
        if text:
            graph.add(i, text, anchors)
            size += len(text)
            if size >= GRAPH_CHARS:
                yield graph
                graph, size = Graph(), 0
    if size:
        yield graph


def find(model: Field, texts: list[str | None], anchors: re.Pattern[str] | None) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the pieces of personal data in each text, in order."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for graph in _graphs(texts, anchors):
        if not graph.units:
            continue
        label = model.labels(graph)
        for document, i in graph.alone:
            if label[i]:
                out[document].append((graph.units[i].start, graph.units[i].end, LABELS[label[i]]))
        for document, first, stop in graph.names:
            if label[stop - 1] == _OF["name"]:
                begin = stop - 1
                while begin > first and label[begin - 1] == _OF["name"]:
                    begin -= 1
                out[document].append((graph.units[begin].start, graph.units[stop - 1].end, "name"))
    for spans in out:
        spans.sort()
    return out


def count_stems(documents: DataFrame, text_col: str = "text") -> dict[str, list[int]]:
    """``stem_counts`` over all documents; what reaches the driver is bounded by the stems that begin like one after a name cue."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = stem_counts(text for batch in batches for text in batch.column(0).to_pylist())
        columns = (list(counts), [n for n, _ in counts.values()], [n for _, n in counts.values()])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["stem", "named", "every"])

    parts = documents.select(text_col).mapInArrow(count, "stem string, named long, every long")
    sums = parts.groupBy("stem").agg(F.sum("named").alias("named"), F.sum("every").alias("every"))
    alike = sums.withColumn("_n", F.sum("named").over(Window.partitionBy(F.substring("stem", 1, 3)))).filter("_n > 0")
    return {r["stem"]: [r["named"], r["every"]] for r in alike.collect()}


def fit_on(documents: DataFrame, text_col: str = "text", sample: int = SAMPLE_DOCUMENTS) -> Field:
    """The field fitted on the ``sample`` distinct texts of least hash, with name stems counted over all documents.

    A bound on the hash lets about one and a half times the sample through, so
    that what partitions send to the driver does not grow with their number.
    """
    text = F.col(text_col)
    rows = documents.filter(text.isNotNull() & (text != "") & (F.length(text) <= SAMPLE_CHARS)).select(text.alias("t"), F.xxhash64(text).alias("h"))
    count = rows.select("h").distinct().count()
    bound = min(1.0, 1.5 * sample / max(1, count))
    near = rows.filter(F.col("h") <= int(-(2**63) + bound * (2**64 - 1))) if bound < 1 else rows
    texts = [r["t"] for r in near.distinct().orderBy("h", "t").limit(sample).collect()]
    return fit(texts, name_stems(count_stems(documents, text_col)))


def find_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Field | None = None) -> DataFrame:
    """(``id_col``, kind, start_at): every piece of personal data, start_at counted in code points from 0.

    Null, empty and blank texts hold none; repeated documents give repeated rows.
    """
    fitted = model or fit_on(documents, text_col)
    schema = T.StructType([
        documents.schema[id_col], T.StructField("kind", T.StringType()), T.StructField("start_at", T.LongType()),
    ])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = re.compile(fitted.anchors) if fitted.anchors else None
        for batch in batches:
            found = find(fitted, batch.column(1).to_pylist(), anchors)
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            flat = [s for spans in found for s in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array([s[2] for s in flat], pa.string()), pa.array([s[0] for s in flat], pa.int64())],
                names=[id_col, "kind", "start_at"],
            )

    return documents.select(id_col, text_col).mapInArrow(search, schema)


def redact(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Field | None = None) -> DataFrame:
    """(``id_col``, ``text_col``, pieces): the text with each piece replaced by a placeholder such as ``[EMAIL]``.

    Null texts stay null and empty texts empty.
    """
    fitted = model or fit_on(documents, text_col)
    schema = T.StructType([documents.schema[id_col], T.StructField(text_col, T.StringType()), T.StructField("pieces", T.LongType())])

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = re.compile(fitted.anchors) if fitted.anchors else None
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch[text_col]]
            found = find(fitted, texts, anchors)
            out = []
            for text, spans in zip(texts, found, strict=True):
                parts, at = [], 0
                for start, end, kind in spans:
                    if start >= at:
                        parts += [text[at:start], f"[{kind.upper()}]"]
                        at = end
                out.append("".join([*parts, text[at:]]) if text is not None else None)
            yield pd.DataFrame({id_col: batch[id_col], text_col: out, "pieces": [len(s) for s in found]})

    return documents.select(id_col, text_col).mapInPandas(clean, schema)
