"""Sentence boundaries across languages and scripts by semi-Markov dynamic programming.

A text is cut at empty lines into paragraphs; a paragraph is a heading line, a list (one unit per
item) or running text. In running text every terminator (and in Thai every blank) may end a sentence.
The programme chooses whole spans; the score of a span from place i to place j is the sum of

* closing: the class of what stands before j (word, abbreviation, initial, ordinal, number, ...),
* opening: the class of what stands at i (capital, digit, caseless script, dash, ...),
* length: the span's length class, apart for strong and weak ends and for dense scripts,
* balance: whether both ends lie outside all quotations and brackets, or the span leaves one open,
  begins in one or lies within one; and whether inverted marks (Spanish) find their partner.

Length and balance belong to both ends at once, so no threshold on a single boundary can stand in for
the programme. The weights are fitted by a margin perceptron over labelled paragraphs
(:mod:`orrery.llm.sentence_samples`). From ``LONG`` code points on the length class is the same for all
spans, so beyond that distance the best beginning is kept as a running maximum for each state of balance:
spans have no greatest length, and the work is linear in the number of places.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from orrery.llm.sentence_samples import paragraphs

# Abbreviations that never end a sentence (lower case, without the last dot).
NEVER = set("""dr mr mrs ms prof capt maj sgt lt col gen st mt messrs fig figs sec vol vols no nos nr pp p tab app rev cf e.g i.e vs
approx ca incl excl min max bzw z d ref núm aprox sr sra srta env n m mme ee art chap abb bd hrsg sog vgl evtl ggf inkl zzgl
рис т тыс млн млрд см стр напр им проф др ул пл е ex eg ie viz al д р डॉ श्री कि ग्रा मी सं د أ م ص""".split())
# Abbreviations that may end a sentence, by what they stand for.
MAYBE = {word: kind for kind, words in {
    "place": "u.s u.k u.n ee.uu uu d.c", "company": "s.a inc ltd co corp llc bros ag n.v s.p.a l.p e.v jr sr.a dept univ est",
    "and so on": "etc usw u.a o.ä u.v.m ed eds", "clock": "a.m p.m am pm h std ч", "money": "mio mrd руб коп шт",
    "measure": "г гг кг км мин с м kg km cm mm kw كغ كم mm."}.items() for word in words.split()}
#: Names that follow the abbreviation of a country.
_AFTER_COUNTRY = {"navy", "army", "air", "coast", "marine", "marines", "government", "department", "congress", "senate", "state", "states",
                  "federal", "forces", "military", "patent", "dollar", "dollars", "customs", "court", "president", "embassy", "geological"}
_COUNTRY = {"u.s", "u.k", "u.n", "ee.uu", "uu"}
_THAI_UNITS = ("กิโล", "เมตร", "ชั่วโมง", "วัตต์", "นาที", "วินาที", "กรัม", "ลิตร", "ตัน", "ปี", "วัน", "เดือน", "หน่วย", "เครื่อง", "ชุด", "องศา",
               "เปอร์เซ็นต์", "บาท", "ล้าน", "พัน", "ครั้ง", "คน", "เดซิเบล", "โวลต์", "เฮิรตซ์", "เมกะ", "มิลลิ", "เซนติ", "ไมล์", "ฟุต", "นิ้ว")

_PARAGRAPH = re.compile(r"[^\S\n]*\S[^\n]*(?:\n(?=[^\n]*\S)[^\n]*)*")
_MARKER = re.compile(r"[^\S\n]*(?:([-*•‣◦▪●·–])[^\S\n]+|(\d{1,3})[.)][^\S\n]+)(?=\S)")
_END = re.compile(r"(?:\.(?!\d)|[!?…。！？｡؟।॥])[.!?…。！？｡؟।॥]*+[\"'”’»)\]」』）》“]*+\s*+(?=\S)")
_FILLED = re.compile(r"\S")
_ORDINAL = re.compile(r"(?:^|[\s(])\d{1,2}$")
_WORD = re.compile(r"\w+")
_PAIRS = re.compile(r"[“”„«»‘’\"()（）「」『』《》]")
_CLOSES = {"”": "“„”", "»": "«", ")": "(", "）": "（", "」": "「", "』": "『", "》": "《"}
_LEAD_COMPOUND = re.compile(r"[a-zа-я](?:-[^\W\d_]{2,}|[A-ZА-Я]{2,})")
_GERMAN = re.compile(r"\b(?:der|die|das|und|wurde|wiegt|ist|nach|wird|den|dem)\b")
_MULTI = re.compile(r"(?:^|\s)(?:d\.\s*h|z\.\s*B|т\.\s*е|т\.\s*д|т\.\s*п|p\.\s*ex|i\.\s*e|e\.\s*g|u\.\s*a|o\.\s*ä)$")
_THAI = re.compile(r"[ก-๛]")
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
_OPENERS = "“„«‘\"¿¡→•([「『《（—–-"

#: Upper ends of the length classes in code points; the last class has no end.
LENGTHS = (4, 10, 20, 40, 80, 160, 320)
LONG = LENGTHS[-1]
#: Labelled paragraphs that the weights are fitted on, and passes over them (the documented bound of the sample).
SAMPLE_PARAGRAPHS, EPOCHS = 2000, 8


def _enclosed(text: str) -> list[tuple[int, int]]:
    """Outermost matched pairs of quotation marks and brackets; those never closed don't count."""
    stack: list[tuple[str, int]] = []
    held: dict[str, int] = {}  # how many of each opening mark are on the stack
    pairs: list[tuple[int, int]] = []

    def close(opens: str, at: int) -> bool:
        if not any(held.get(c) for c in opens):
            return False
        while True:
            mark, begin = stack.pop()
            held[mark] -= 1
            if mark in opens:
                pairs.append((begin, at))
                return True

    for m in _PAIRS.finditer(text):
        ch, at = m.group(0), m.start()
        if ch == "’":
            if stack and stack[-1][0] == "‘" and not text[at + 1:at + 2].isalpha():
                close("‘", at)
        elif ch == '"' and close('"', at) or ch == "“" and close("„", at):
            pass
        elif ch in _CLOSES:
            close(_CLOSES[ch], at)
        else:
            stack.append((ch, at))
            held[ch] = held.get(ch, 0) + 1
    pairs.sort()
    outer: list[tuple[int, int]] = []
    for a, b in pairs:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def _closing(text: str, s: int, e: int, spaced: bool, german: list[bool]) -> str:
    """Class of what stands before a single full stop at ``s``: a word, abbreviation, initial, unit or number."""
    last = text[s - 1] if s else ""
    if last.isdigit():
        if e < len(text) and text[e].isalpha() and _ORDINAL.search(text, max(0, s - 4), s):
            if not german:
                german.append(_GERMAN.search(text) is not None)
            return "ordinal" if german[0] else "number"
        return "number"
    if "\u0900" <= last <= "\u097f":  # Devanagari ends sentences with a danda
        return "devanagari"
    if not last.isalpha():
        return "mark"
    at = s - 1
    low_end = max(0, s - 20)
    while at > low_end and (text[at - 1].isalpha() or text[at - 1] == "."):
        at -= 1
    word = text[at:s].lstrip(".")
    low = word.lower()
    if "." in low and low not in MAYBE and low not in NEVER:
        word = word.rsplit(".", 1)[1]
        low = word.lower()
    if len(word) == 1:
        if at and text[at - 1] in "'’":
            return "word"
        if at > 1 and text[at - 1] in " \n" and text[at - 2].isdigit() or at and text[at - 1].isdigit():
            return "unit" if low not in ("р",) else "initial"
    if low in _COUNTRY and spaced:
        follower = _WORD.match(text, e)
        if follower and follower.group(0).lower() in _AFTER_COUNTRY:
            return "country"
    if len(word) <= 2 and _MULTI.search(text, low_end, s):
        return "never"
    if low in MAYBE:
        return MAYBE[low]
    if low in NEVER:
        return "never"
    if len(word) == 1:
        return "initial"
    return "word"


def _classes(text: str, m: re.Match, german: list[bool]) -> tuple[str, str]:
    """(closing, opening) class of the place after a terminator."""
    s, e = m.span()
    first, nxt = text[s], text[e]
    spaced = text[e - 1].isspace()
    if nxt.islower():
        opening = "lead" if _LEAD_COMPOUND.match(text, e) else "lower"
    elif nxt.isdigit():
        opening = "digit"
    elif nxt.isalpha():
        opening = "letter"
    elif nxt in "—–-":
        opening = "dash"
    elif nxt == "(":
        opening = "bracket"
    elif nxt in _OPENERS:
        opening = "opener"
    elif nxt in ",;:、，；：)]）」』”’»":
        opening = "inner"
    else:
        opening = "other"
    if first == ".":
        closing = "dots" if text[s + 1] == "." else _closing(text, s, e, spaced, german)
        if opening == "lower":
            return closing, "lower after dot"
        if not spaced:
            lost = e == s + 1 and (nxt.isupper() or opening == "lead")
            caseless = nxt.isalpha() and not nxt.isupper() and not nxt.islower()
            return (closing, "glued " + opening) if lost or caseless or e > s + 1 else ("tight", opening)
    elif first == "…":
        closing = "ellipsis" if spaced else "tight"
        if opening == "lower":
            opening = "lower after dot"
    elif first in "!?":
        closing = "exclaim"
    else:
        closing = "reported" if text[e - 1] in "」』”》" and nxt in "とっという、，," else "stop"
    return closing, opening


def _thai_classes(text: str, s: int, e: int) -> tuple[str, str]:
    """Classes of a blank in Thai, which ends a sentence or sets off a number or a foreign word."""
    before, nxt = text[s - 1], text[e]
    thai_next = "ก" <= nxt <= "๛"
    if before.isdigit():
        if not thai_next or text.startswith(_THAI_UNITS, e):
            return "thai number", "thai unit"
        token = re.search(r"(\S+)\s+\S+$", text[max(0, s - 40):s])
        return "thai number", "thai unit" if token and token.group(1)[-1].isascii() and token.group(1)[-1].isalpha() else "thai"
    if "ก" <= before <= "๛":
        return "thai word", "thai" if thai_next else "foreign"
    return "foreign", "foreign"


_STRONG = {"word", "exclaim", "stop", "thai word", "thai number", "end"}
_INVERTED = {"¿": "?", "¡": "!"}


@dataclass
class Running:
    """The places of a paragraph: 0, every possible end, its length; with their classes."""

    places: list[int]
    closing: list[str]
    opening: list[str]
    pair: list[int]  # number of the outermost quotation or bracket around a place, 0 outside
    dense: bool
    inverted: list[str]  # inverted mark that opens at the place
    ends: list[str]  # mark that closes before the place


def places_of(text: str) -> Running | None:
    """All places of a paragraph where a sentence may end; None if there is none inside."""
    german: list[bool] = []
    cuts = [(m.end(), *_classes(text, m, german), text[m.start()]) for m in _END.finditer(text)]
    if _THAI.search(text):
        known = {c[0] for c in cuts}
        cuts += [(m.end(), *_thai_classes(text, m.start(), m.end()), "") for m in re.finditer(r"(?<=\S)\s+(?=\S)", text) if m.end() not in known]
        cuts.sort()
    if not cuts:
        return None
    pairs = _enclosed(text) if _PAIRS.search(text) else []
    pair, k = [0], 0
    for at, *_ in cuts:
        while k < len(pairs) and pairs[k][1] < at:
            k += 1
        pair.append(k + 1 if k < len(pairs) and pairs[k][0] < at else 0)
    return Running([0, *(c[0] for c in cuts), len(text)], ["", *(c[1] for c in cuts), "end"], ["begin", *(c[2] for c in cuts), ""], [*pair, 0],
                   _DENSE.search(text) is not None, [text[c] if text[c:c + 1] in _INVERTED else "" for c in (0, *(c[0] for c in cuts))],
                   ["", *(c[3] for c in cuts), text[-1]])


def _balance(a: int, b: int) -> str:
    if not a and not b:
        return "balanced"
    return "within" if a == b else "left open" if not a else "closes only" if not b else "between"


@dataclass
class Weights:
    """Weights by feature; ``joint`` false leaves out length, balance and inverted marks (for ablation)."""

    of: dict[str, float] = field(default_factory=dict)
    joint: bool = True

    def cut(self, r: Running, j: int) -> float:
        get = self.of.get
        return get("closing " + r.closing[j], 0.0) + get("opening " + r.opening[j], 0.0)

    def tables(self, dense: bool) -> tuple[list[list[float]], dict[str, float]]:
        if not self.joint:
            return [[0.0] * (len(LENGTHS) + 1)] * 2, dict.fromkeys(("balanced", "within", "left open", "closes only", "between", "partner", "no partner"), 0.0)
        get = self.of.get
        kind = "dense" if dense else "spaced"
        lengths = [[get(f"length {kind} {strong} {k}", 0.0) for k in range(len(LENGTHS) + 1)] for strong in (0, 1)]
        return lengths, {b: get("balance " + b, 0.0) for b in ("balanced", "within", "left open", "closes only", "between", "partner", "no partner")}


def features(r: Running, i: int, j: int) -> list[str]:
    """Features of the span from place i to place j."""
    out = [f"length {'dense' if r.dense else 'spaced'} {int(r.closing[j] in _STRONG)} {bisect.bisect_right(LENGTHS, r.places[j] - r.places[i])}",
           "balance " + _balance(r.pair[i], r.pair[j])]
    if r.inverted[i]:
        out.append("balance partner" if r.ends[j] == _INVERTED[r.inverted[i]] else "balance no partner")
    if j < len(r.places) - 1:
        out += ["closing " + r.closing[j], "opening " + r.opening[j]]
    return out


def best_spans(r: Running, weights: Weights, penalty: list[float] | None = None) -> list[int]:
    """Semi-Markov programme: indices of the places where the spans of the best segmentation begin."""
    places, n = r.places, len(r.places)
    lengths, balance = weights.tables(r.dense)
    best, back = [0.0] * n, [0] * n
    near = 0  # first place closer than LONG to the present end
    outside: tuple[float, int] | None = None  # best far beginnings: outside all pairs, in the present pair, in others
    present: tuple[float, int] | None = None
    others: tuple[float, int] | None = None
    number = 0
    for j in range(1, n):
        end, here = places[j], r.pair[j]
        table = lengths[r.closing[j] in _STRONG]
        ends = r.ends[j]
        while near < j and end - places[near] >= LONG:
            entry = (best[near], near)
            if not r.pair[near]:
                if outside is None or entry[0] > outside[0]:
                    outside = entry
            elif r.pair[near] == number:
                if present is None or entry[0] > present[0]:
                    present = entry
            else:
                if present is not None and (others is None or present[0] > others[0]):
                    others = present
                present, number = entry, r.pair[near]
            near += 1
        top, arg = -1e18, 0
        for i in range(j - 1, near - 1, -1):
            a = r.pair[i]
            v = best[i] + table[bisect.bisect_right(LENGTHS, end - places[i])] + (balance["balanced"] if not a and not here else balance[_balance(a, here)])
            if r.inverted[i]:
                v += balance["partner" if ends == _INVERTED[r.inverted[i]] else "no partner"]
            if v > top:
                top, arg = v, i
        for kept, a in ((outside, 0), (present, number), (others, -1)):
            if kept is not None:
                v = kept[0] + table[-1] + balance[_balance(a, here)]
                if v > top:
                    top, arg = v, kept[1]
        best[j] = top + (weights.cut(r, j) if j < n - 1 else 0.0) + (penalty[j] if penalty else 0.0)
        back[j] = arg
    chain, j = [], n - 1
    while j:
        j = back[j]
        chain.append(j)
    return chain[::-1]


@lru_cache(maxsize=4)
def fit(count: int = SAMPLE_PARAGRAPHS, epochs: int = EPOCHS, seed: int = 3, joint: bool = True) -> Weights:
    """Averaged perceptron with a margin: each missing or surplus boundary must lose by one."""
    data = []
    for text, gold in paragraphs(count, seed):
        r = places_of(text)
        if r is not None:
            at = {p: k for k, p in enumerate(r.places)}
            data.append((r, [at[g] for g in gold if g in at]))
    now: dict[str, float] = {}
    total: dict[str, float] = {}
    rng = random.Random(seed)
    step = 0
    for _ in range(epochs):
        rng.shuffle(data)
        for r, gold in data:
            step += 1
            right = set(gold)
            chosen = best_spans(r, Weights(now, joint), [-1.0 if k in right else 1.0 for k in range(len(r.places))])
            if chosen == gold:
                continue
            for spans, sign in ((gold, 1.0), (chosen, -1.0)):
                for i, j in zip(spans, [*spans[1:], len(r.places) - 1]):
                    for f in features(r, i, j):
                        if joint or not f.startswith(("length", "balance")):
                            now[f] = now.get(f, 0.0) + sign
                            total[f] = total.get(f, 0.0) + sign * step
    return Weights({f: round(w - total[f] / (step + 1), 6) for f, w in now.items()}, joint)


def _split_running(text: str, offset: int, out: list[int], weights: Weights) -> None:
    """Appends the starts of the sentences of a paragraph that begins at ``offset``."""
    r = places_of(text)
    if r is None:
        out.append(offset)
    else:
        out.extend(offset + r.places[k] for k in best_spans(r, weights))


def starts(text: str | None, weights: Weights | None = None) -> list[int]:
    """Code-point positions of all units of a text, ascending; null, empty and blank texts have none."""
    if not text:
        return []
    weights = weights or fit()
    out: list[int] = []
    for para in _PARAGRAPH.finditer(text):
        body = para.group(0)
        lead = len(body) - len(body.lstrip())
        base = para.start()
        first = _MARKER.match(body)
        if first is None and "\n" not in body:
            _split_running(body[lead:].rstrip(), base + lead, out, weights)
            continue
        lines = [0, *(m.end() for m in re.finditer("\n", body))]
        items: list[int] = []
        number = None
        for at in lines:
            m = _MARKER.match(body, at)
            if not m:
                continue
            if m.group(2):
                n = int(m.group(2))
                if (at == 0 and first) or (number is not None and n == number + 1):
                    number = n
                    items.append(at)
            elif m.group(1) not in "·–" or at == 0 or items:
                items.append(at)
        begin = items[0] if items else len(body)
        running = body[lead:begin].rstrip()
        if running:
            _split_running(running, base + lead, out, weights)
        out.extend(base + _FILLED.search(body, at).start() for at in items)
    return out


def sentences(documents: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per unit: doc_id, unit_no (from 0), start_pos, sentence.

    Every text is processed whole where it is read; there is no shuffle. Documents with a null or
    blank text give no row; repeated documents give their units each time. Line breaks inside a unit
    are kept in ``sentence``.
    """
    kind = dict(documents.dtypes)[key]
    weights = fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            index: list[int] = []
            numbers: list[int] = []
            positions: list[int] = []
            units: list[str] = []
            for i, text in enumerate(texts):
                at = starts(text, weights)
                index += [i] * len(at)
                numbers += range(len(at))
                positions += at
                units += [text[a:b].rstrip() for a, b in zip(at, [*at[1:], len(text or "")])]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(index, pa.int64())), pa.array(numbers, pa.int32()), pa.array(positions, pa.int32()), pa.array(units, pa.string())],
                names=[key, "unit_no", "start_pos", "sentence"])

    return documents.select(key, column).where(f"{column} is not null").mapInArrow(
        run, f"{key} {kind}, unit_no int, start_pos int, sentence string")
