"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for other spellings.

The field learns from a small labelled table, by default one written from templates: e-mail addresses, network
addresses, card numbers, telephone numbers and personal numbers in the spellings people use, among dates,
prices, versions and prose. A tagged span counts if its digits or parts pass the check of its kind and it
touches no pattern match; pattern matches always stay.

Defined cases: a null text is empty and has no spans; equal texts give equal spans, so repeated rows do;
texts of any length are scanned whole; an empty table gives an empty result; base_spans and tagged_spans
replace input columns of these names.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame

from clausespark.llm.crf import Crf
from clausespark.llm.spans import Span, add_spans

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = ["tagged_email", "tagged_ip", "tagged_card", "tagged_phone", "tagged_id"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A run of digits is entered at its first one only and never given back, which keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CUES = "phone tel telephone call mobile cell fax email mail contact write reach ip host address server login card visa mastercard payment pay ssn passport iban id number no at dot account born date page isbn order version price total".split()
LABELLED_ROWS = 700


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _octet(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: each @ takes the local characters before it, back to the end of the match before."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            found.append((begin, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[Span]:
    found = [("email", a, b) for a, b in emails(text)]
    if re.search("[0-9]", text):
        found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
        found += [("card", m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


def accept(kind: str, value: str) -> bool:
    """Whether the digits or parts of a tagged span fit its kind."""
    digits = _digits(value)
    if kind == "tagged_email":
        return bool(re.fullmatch(r"[\w.%+-]+ ?(@|[(\[] ?at ?[)\]]) ?[\w-]+( ?(\.|[(\[] ?dot ?[)\]]) ?[\w-]+)+", value, re.IGNORECASE))
    if kind == "tagged_ip":
        return bool(re.fullmatch(r"[0-9a-fA-F]{0,4}(::?[0-9a-fA-F]{1,4}){3,7}", value))
    if kind == "tagged_card":
        return 12 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits)
    if kind == "tagged_phone":
        return 9 <= len(digits) <= 15 and bool(re.fullmatch(r"(00|\()?[0-9]+\)?([ ./-]?[ (]?[0-9]+\)?){1,5}", value)) and digits != value
    iban = re.sub(" ", "", value)
    if re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", iban):
        return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    return bool(re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", value))


def labelled_table(rows: int = LABELLED_ROWS, seed: int = 0) -> list[tuple[str, list[Span]]]:
    """(text, spans) written from templates; ``{}`` is where the personal data go."""
    rng = random.Random(seed)
    lower = "abcdefghijklmnopqrstuvwxyz"
    draw = lambda letters, a, b: "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
    num = lambda n, m=None: draw("0123456789", n, m or n)
    word = lambda: "".join(rng.choice(["th", "er", "on", "ing", "la", "que", "sch", "ó", "é", "st", "a", "en"]) for _ in range(rng.randint(1, 4)))
    prose = lambda a, b: " ".join(word().title() if rng.random() < 0.15 else word() for _ in range(rng.randint(a, b))) + rng.choice(["", ".", ",", "\n"])
    name = lambda: rng.choice(["", draw(lower, 2, 7) + rng.choice([".", "-", ""])]) + draw(lower + "üé", 3, 8)
    data = {
        "tagged_email": [lambda: f"{name()}@{draw(lower, 3, 9)}.{draw(lower, 2, 3)}", lambda: f"{name()}{num(1, 3)}@mail{num(1)}.example.com", lambda: f"{name()} (at) {draw(lower, 4, 8)} (dot) com", lambda: f"{name()} [at] {draw(lower, 4, 8)}.{draw(lower, 2, 3)}"],
        "tagged_ip": [lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: ":".join(draw("0123456789abcdef", 1, 4) for _ in range(8)), lambda: f"2001:db8::{draw('0123456789abcdef', 1, 4)}:{draw('0123456789abcdef', 1, 4)}:{draw('0123456789abcdef', 1, 4)}"],
        "tagged_card": [lambda: num(16), lambda: " ".join(num(4) for _ in range(4)), lambda: "-".join(num(4) for _ in range(4)), lambda: ".".join(num(4) for _ in range(4))],
        "tagged_phone": [lambda: f"+{num(1, 2)} ({num(3)}) {num(3)}-{num(4)}", lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"00{num(2)} {num(2, 3)} {num(6, 8)}", lambda: f"0{num(2, 3)}/{num(6, 8)}"],
        "tagged_id": [lambda: f"{num(3)}-{num(2)}-{num(4)}", lambda: f"DE{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}", lambda: f"GB{num(2)}{draw('ABCDEFGHJKL', 4, 4)}{num(14)}"],
    }
    lead = {"tagged_email": ["mail ", "email: ", "write to ", ""], "tagged_ip": ["from ", "host ", "ip ", ""], "tagged_card": ["card ", "visa ", "pay with ", ""], "tagged_phone": ["tel ", "call ", "phone: ", ""], "tagged_id": ["ssn ", "iban ", "passport no ", ""]}
    plain = [
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2030)}", lambda: f"{rng.randint(1, 999)}.{num(2)} $", lambda: f"version {num(1)}.{num(1, 2)}.{num(1, 2)}",
        lambda: f"order {num(4, 9)}", lambda: f"page {num(1, 3)}-{num(1, 3)}", lambda: f"{num(1, 2)}:{num(2)}:{num(2)}", lambda: f"{rng.randint(1950, 2000)}-{rng.randint(2001, 2030)}", lambda: f'token = "{draw("0123456789abcdef", 40, 40)}"', lambda: f"{prose(1, 3)} | {prose(1, 2)} | {num(1, 4)}",
        lambda: " ".join(w.upper() + "!!" for w in prose(3, 6).split()), lambda: " ".join(w + rng.choice(["$$$", "%%%", "###", "***"]) for w in prose(3, 6).split()), lambda: f"isbn 978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", lambda: f"{num(1, 3)} {num(1, 3)} {num(1, 3)}", lambda: f"https://www.{draw(lower, 4, 12)}.com/{draw(lower, 3, 9)}",
    ]
    out = []
    for i in range(rows):
        text, spans = prose(0, 6), []
        for _ in range(rng.randint(1, 3)):
            text += " "
            if i % 2 and rng.random() < 0.7:
                kind = rng.choice(KINDS)
                text += rng.choice(lead[kind])
                value = rng.choice(data[kind])()
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
            else:
                text += rng.choice(plain)() if rng.random() < 0.6 else prose(3, 9)
        out.append((text + " " + prose(0, 6), spans))
    return out


def train(rows: list[tuple[str, list[Span]]] | None = None) -> Crf:
    rows = labelled_table() if rows is None else rows
    return Crf(KINDS, CUES).fit(rows, np.zeros(len(rows), dtype=np.int64))


def scan(docs: DataFrame, crf: Crf) -> DataFrame:
    """``docs`` with base_spans and tagged_spans."""
    return add_spans(docs, base_spans, crf, lambda text: 0, accept)
