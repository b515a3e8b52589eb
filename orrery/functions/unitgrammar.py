"""Numbers, unit expressions and dimensions.

A unit expression such as ``lbf/in2`` or ``thousand ft`` is parsed by a small grammar into a
:class:`Quantity`: an exponent vector over base dimensions with a scale and an offset. Two
expressions denote the same unit exactly if vectors, scales and offsets agree, so a spelling never
has to be listed together with its reading; only atoms are listed.

    expression := scale* product
    product    := power (('*' | '/' | ' ' | 'per') power)*
    power      := atom exponent?
    atom       := listed symbol | listed word | prefix + prefixable atom
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

# Base dimensions of the exponent vectors.
DIMENSIONS = ("length", "mass", "time", "temperature", "angle", "information", "money")

# Atoms as (dimension exponents, factor to base, offset). Base: m, kg, s, K, deg, bit, USD.
ATOMS: dict[str, tuple[dict[str, int], float, float]] = {
    "m": ({"length": 1}, 1.0, 0.0),
    "in": ({"length": 1}, 0.0254, 0.0),
    "ft": ({"length": 1}, 0.3048, 0.0),
    "yd": ({"length": 1}, 0.9144, 0.0),
    "mi": ({"length": 1}, 1609.344, 0.0),
    "nmi": ({"length": 1}, 1852.0, 0.0),
    "g": ({"mass": 1}, 0.001, 0.0),
    "t": ({"mass": 1}, 1000.0, 0.0),
    "lb": ({"mass": 1}, 0.45359237, 0.0),
    "lbf": ({"mass": 1, "length": 1, "time": -2}, 4.4482216152605, 0.0),
    "s": ({"time": 1}, 1.0, 0.0),
    "min": ({"time": 1}, 60.0, 0.0),
    "h": ({"time": 1}, 3600.0, 0.0),
    "d": ({"time": 1}, 86400.0, 0.0),
    "kn": ({"length": 1, "time": -1}, 1852.0 / 3600.0, 0.0),
    "W": ({"mass": 1, "length": 2, "time": -3}, 1.0, 0.0),
    "hp": ({"mass": 1, "length": 2, "time": -3}, 745.6998715822702, 0.0),
    "Hz": ({"time": -1}, 1.0, 0.0),
    "Pa": ({"mass": 1, "length": -1, "time": -2}, 1.0, 0.0),
    "bar": ({"mass": 1, "length": -1, "time": -2}, 100000.0, 0.0),
    "psi": ({"mass": 1, "length": -1, "time": -2}, 6894.757293168, 0.0),
    "L": ({"length": 3}, 0.001, 0.0),
    "gal": ({"length": 3}, 0.003785411784, 0.0),
    "deg": ({"angle": 1}, 1.0, 0.0),
    "rad": ({"angle": 1}, 57.29577951308232, 0.0),
    "bit": ({"information": 1}, 1.0, 0.0),
    "USD": ({"money": 1}, 1.0, 0.0),
    "K": ({"temperature": 1}, 1.0, 0.0),
    "degC": ({"temperature": 1}, 1.0, 273.15),
    "degF": ({"temperature": 1}, 5.0 / 9.0, 255.3722222222222),
    "kg": ({"mass": 1}, 1.0, 0.0),
}

# Words and foreign spellings of atoms, in lower case without dots.
WORDS: dict[str, str] = {
    "metre": "m", "meter": "m", "м": "m", "米": "m", "метр": "m", "mètre": "m", "metro": "m",
    "inch": "in", "inches": "in", "zoll": "in", "英寸": "in", "дюйм": "in",
    "foot": "ft", "feet": "ft", "фут": "ft", "英尺": "ft", "pied": "ft", "fuß": "ft",
    "yard": "yd", "yds": "yd", "ярд": "yd", "码": "yd",
    "mile": "mi", "statute mile": "mi", "миля": "mi", "英里": "mi", "meile": "mi",
    "nautical mile": "nmi", "naut mile": "nmi", "nm": "nmi", "n mi": "nmi", "n mile": "nmi",
    "seemeile": "nmi", "seemeilen": "nmi", "海里": "nmi", "морская миля": "nmi", "mille marin": "nmi",
    "gram": "g", "gramme": "g", "gr": "g", "г": "g", "克": "g", "gramm": "g",
    "kilo": "kg", "千克": "kg", "公斤": "kg", "кг": "kg", "kgs": "kg",
    "tonne": "t", "metric ton": "t", "т": "t", "吨": "t",
    "pound": "lb", "lbs": "lb", "фунт": "lb", "磅": "lb",
    "second": "s", "sec": "s", "secs": "s", "с": "s", "秒": "s", "sekunde": "s", "sekunden": "s", "seconde": "s",
    "minute": "min", "mins": "min", "minuten": "min", "мин": "min", "分钟": "min", "分": "min",
    "hour": "h", "hr": "h", "hrs": "h", "std": "h", "stunde": "h", "stunden": "h", "heure": "h",
    "ч": "h", "час": "h", "小时": "h", "時間": "h", "hora": "h",
    "day": "d", "tag": "d", "сутки": "d",
    "knot": "kn", "kt": "kn", "kts": "kn", "узел": "kn", "节": "kn", "knoten": "kn", "nœud": "kn",
    "watt": "W", "вт": "W", "瓦": "W", "千瓦": "kW",
    "horsepower": "hp", "bhp": "hp", "h p": "hp", "л с": "hp", "马力": "hp",
    "hertz": "Hz", "гц": "Hz", "赫兹": "Hz", "兆赫": "MHz",
    "pascal": "Pa", "па": "Pa", "bars": "bar", "бар": "bar",
    "litre": "L", "liter": "L", "ltr": "L", "l": "L", "л": "L", "升": "L", "litro": "L",
    "us gal": "gal", "us gallon": "gal", "u s gallon": "gal", "gallon": "gal",
    "degree": "deg", "degr": "deg", "°": "deg", "grad": "deg", "度": "deg", "градус": "deg", "degré": "deg",
    "radian": "rad", "bits": "bit", "бит": "bit",
    "$": "USD", "us$": "USD", "dollar": "USD", "u s dollar": "USD", "us dollar": "USD", "долл": "USD", "美元": "USD",
    "kelvin": "K", "celsius": "degC", "c": "degC", "deg c": "degC", "°c": "degC", "degree celsius": "degC", "℃": "degC",
    "fahrenheit": "degF", "f": "degF", "deg f": "degF", "°f": "degF", "degree fahrenheit": "degF", "℉": "degF",
    "kms": "km", "км": "km", "公里": "km", "千米": "km", "厘米": "cm", "毫米": "mm", "см": "cm", "мм": "mm", "квт": "kW", "мвт": "MW",
    "мгц": "MHz", "ггц": "GHz", "кгц": "kHz", "кпа": "kPa",
}

# Whole expressions that the grammar can't derive from atoms.
IDIOMS: dict[str, str] = {
    "kph": "km/h", "kmh": "km/h", "km/hr": "km/h", "mph": "mi/h", "mps": "m/s", "m s-1": "m/s",
    "kbps": "kbit/s", "mbps": "Mbit/s", "gbps": "Gbit/s", "bps": "bit/s",
    "cubic metre": "m3", "cubic meter": "m3", "cu m": "m3", "cbm": "m3", "m³": "m3", "立方米": "m3",
}

# Scale words and their factors.
SCALES: dict[str, float] = {
    "hundred": 1e2, "thousand": 1e3, "million": 1e6, "billion": 1e9, "k": 1e3, "m": 1e6, "mn": 1e6, "mio": 1e6,
    "bn": 1e9, "тыс": 1e3, "млн": 1e6, "млрд": 1e9, "万": 1e4, "亿": 1e8,
}

# Decimal prefixes as symbols and as words.
PREFIX_SYMBOLS = {"G": 1e9, "M": 1e6, "k": 1e3, "c": 1e-2, "m": 1e-3}
PREFIX_WORDS = {"giga": 1e9, "mega": 1e6, "kilo": 1e3, "centi": 1e-2, "milli": 1e-3}
PREFIXABLE = {"m", "g", "s", "W", "Hz", "Pa", "rad", "bit", "L", "ft", "USD"}


@dataclass(frozen=True)
class Quantity:
    """A unit: exponents in the order of DIMENSIONS, scale and offset to base units."""

    exponents: tuple[int, ...]
    factor: float
    offset: float = 0.0

    def same_dimension(self, other: Quantity) -> bool:
        return self.exponents == other.exponents

    def same_unit(self, other: Quantity) -> bool:
        return (self.same_dimension(other) and abs(self.factor / other.factor - 1) < 1e-6
                and abs(self.offset - other.offset) < 1e-6)


def _atom(name: str) -> Quantity:
    powers, factor, offset = ATOMS[name]
    return Quantity(tuple(powers.get(d, 0) for d in DIMENSIONS), factor, offset)


def _clean(text: str) -> str:
    text = unicodedata.normalize("NFC", text).replace(" ", " ").replace(" ", " ").replace("−", "-")
    text = text.strip().strip("()[]").strip()
    return re.sub(r"\s+", " ", text)


def _word(text: str) -> str:
    return re.sub(r"\s+", " ", text.lower().replace(".", " ")).strip()


def _parse_atom(text: str) -> Quantity | None:
    bare = text.strip().rstrip(".")
    if bare in ATOMS:
        return _atom(bare)
    if bare[:1] in PREFIX_SYMBOLS and bare[1:] in PREFIXABLE:
        return _scaled(_atom(bare[1:]), PREFIX_SYMBOLS[bare[0]])
    if bare == "NM":
        return _atom("nmi")
    low = _word(bare)
    forms = (low, low[:-1] if low.endswith("s") and len(low) > 2 else low)
    for form in forms:
        if form in WORDS:
            target = WORDS[form]
            return _atom(target) if target in ATOMS else _parse_atom(target)
    for form in forms:
        for word, scale in PREFIX_WORDS.items():
            rest = form[len(word):]
            if form.startswith(word) and len(rest) > 1 and (inner := WORDS.get(rest, rest if rest in PREFIXABLE else None)):
                return _scaled(_atom(inner), scale) if inner in ATOMS else None
    folded = {k.lower(): k for k in ATOMS}
    if low in folded:
        return _atom(folded[low])
    for symbol, scale in PREFIX_SYMBOLS.items():
        if low.startswith(symbol.lower()) and low[1:] in folded and folded[low[1:]] in PREFIXABLE:
            # letter case is lost, so a capital M of a power or frequency means mega and of a length milli
            inner = folded[low[1:]]
            if symbol in "Mm":
                scale = 1e-3 if inner in ("m", "g", "s", "L", "rad") else 1e6
            return _scaled(_atom(inner), scale)
    return None


def _scaled(q: Quantity, scale: float) -> Quantity:
    return Quantity(q.exponents, q.factor * scale, q.offset)


def _power(text: str) -> Quantity | None:
    whole = _parse_atom(text)
    if whole is not None:
        return whole
    m = re.fullmatch(r"(.*?[^\d\s^-])\s*\^?([-+]?\d|[²³])", text.strip())
    if not m:
        return None
    base = _parse_atom(m.group(1))
    if base is None or base.offset:
        return None
    n = {"²": 2, "³": 3}.get(m.group(2)) or int(m.group(2))
    return Quantity(tuple(e * n for e in base.exponents), base.factor ** n)


@lru_cache(maxsize=65536)
def parse_unit(text: str | None) -> Quantity | None:
    """The unit that an expression denotes, or None for blanks, unknown words and non-units."""
    if text is None:
        return None
    text = _clean(text)
    if not text or len(text) > 60:
        return None
    low = _word(text)
    single = low[:-1] if low.endswith("s") else low
    for form in (text, low, single):
        if form in IDIOMS:
            return parse_unit(IDIOMS[form])
    q = _power(text)
    if q is not None:
        return q
    words = text.split(" ")
    money = {"k": 1e3, "m": 1e6, "bn": 1e9, "mn": 1e6}
    for k in range(1, len(words)):
        head, tail = " ".join(words[:k]), " ".join(words[k:])
        for scale_text, rest in ((head, tail), (tail, head)):
            scale = SCALES.get(_word(scale_text))
            if scale is None:
                continue
            inner = parse_unit(rest)
            if inner is None:
                continue
            # single letters scale money and feet only; elsewhere they would be units of their own
            if _word(scale_text) in ("k", "m") and not (
                    inner.same_dimension(_atom("USD")) or (scale_text == head and inner.same_unit(_atom("ft")))):
                continue
            return _scaled(inner, scale)
    glued = re.fullmatch(r"(?i)(k|m|bn|mn)?(US\$|USD|\$)(k|m|bn|mn)?", text.replace(" ", ""))
    if glued:
        scale = money.get((glued.group(1) or "").lower(), 1.0) * money.get((glued.group(3) or "").lower(), 1.0)
        return _scaled(_atom("USD"), scale)
    parts = re.split(r"\s*(/|\*|·|\bper\b)\s*|\s+", text)
    parts = [p for p in parts if p]
    if len(parts) < 2:
        return None
    exponents, factor, sign = [0] * len(DIMENSIONS), 1.0, 1
    for part in parts:
        if part in ("/", "per"):
            sign = -1
        elif part in ("*", "·"):
            sign = 1
        else:
            q = _power(part)
            if q is None or q.offset:
                return None
            exponents = [a + sign * b for a, b in zip(exponents, q.exponents)]
            factor *= q.factor ** sign
            sign = 1
    return Quantity(tuple(exponents), factor)


_DIGITS = r"\d{1,3}(?:[ '’,.  ]\d{3})+(?!\d)(?:[.,]\d+)?|\d+(?:[.,]\d+)?"
NUMBER = re.compile(rf"(?<![\w.,])[-+−]?(?:{_DIGITS})(?:[eE][-+]?\d+)?")


def parse_number(text: str) -> float | None:
    """A number with thousands blanks, commas or dots and a decimal point or comma.

    One separator followed by exactly three digits groups thousands, except after a leading zero
    ('0,961'); repeated separators group, and of two kinds the last one is the decimal sign.
    """
    s = re.sub(r"[ '’  ]", "", text.strip()).replace("−", "-")
    try:
        commas, dots = s.count(","), s.count(".")
        if commas and dots:
            if s.rfind(",") > s.rfind("."):
                s = s.replace(".", "").replace(",", ".")
            else:
                s = s.replace(",", "")
        elif commas > 1 or dots > 1:
            s = s.replace(",", "").replace(".", "")
        elif commas:
            head, tail = s.split(",")
            s = head + tail if len(tail) == 3 and head.lstrip("+-") not in ("", "0") else f"{head}.{tail}"
        return float(s)
    except ValueError:
        return None
