"""Secret scans: fixed patterns, and a linear-chain conditional random field for secrets without a fixed form.

The field tags tokens as beginning, inside or outside a secret from their shape, their neighbours, cue words
and how much of the file is code punctuation. It learns from a small labelled table, by default one written from
templates of connection strings, headers, vendor keys and prose. A tagged span counts if it is long and mixed
enough and touches no pattern match; pattern matches always stay.

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

BASE_KINDS = ["assign", "access", "hex"]
KIND = "tagged_secret"
#: The value's quotes and the key's case are part of the fixed pattern.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CUES = ("password passwd pwd passphrase secret token key apikey bearer authorization auth credential credentials private access client aws github slack stripe "
        "jwt https http ftp postgres mysql mongodb redis ssh rsa begin end commit sha md5 checksum uuid version hash digest id order ref").split()
CODE_MARKS = "=:{};/<>_"
LABELLED_ROWS = 600


def base_spans(text: str) -> list[Span]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


def file_class(text: str) -> int:
    """0 to 2 by the share of code punctuation in the file."""
    marks = sum(text.count(c) for c in CODE_MARKS)
    return 2 if marks * 33 > len(text) else 1 if marks * 200 > len(text) else 0


def accept(kind: str, value: str) -> bool:
    """Long, of letters and digits, and not of a few characters only."""
    return len(value) >= 12 and bool(re.search("[0-9]", value)) and bool(re.search("[A-Za-z]", value)) and len(set(value)) >= 8


def labelled_table(rows: int = LABELLED_ROWS, seed: int = 0) -> list[tuple[str, list[Span]]]:
    """(text, spans) written from templates; ``{}`` is where the secret goes."""
    rng = random.Random(seed)
    alnum, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz"
    draw = lambda letters, a, b: "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
    word = lambda: "".join(rng.choice(["th", "er", "on", "ing", "la", "que", "sch", "ó", "é", "st", "a", "en"]) for _ in range(rng.randint(1, 4)))
    prose = lambda a, b: " ".join(word().title() if rng.random() < 0.15 else word() for _ in range(rng.randint(a, b))) + rng.choice(["", ".", ",", "\n"])
    secret = {
        "Authorization: Bearer {}": lambda: draw(alnum, 24, 60), "bearer {}": lambda: draw(alnum, 24, 60),
        "postgres://app:{}@db:5432/main": lambda: draw(alnum, 12, 20), "https://bot:{}@host/repo": lambda: draw(alnum, 20, 40), "redis://:{}@cache": lambda: draw(alnum, 14, 24),
        "{}": lambda: rng.choice(["ghp_", "sk_live_", "pk_test_", "glpat-", "npm_"]) + draw(alnum, 24, 36), "key {}": lambda: draw(alnum + "+/", 32, 44) + "==",
        "eyJ {}": lambda: "eyJ" + draw(alnum, 20, 30) + "." + draw(alnum, 20, 40) + "." + draw(alnum, 20, 40),
        "the password is {}": lambda: draw(alnum, 12, 16), "passphrase {}": lambda: draw(alnum, 14, 20), "client credential '{}'": lambda: draw(alnum, 20, 32),
        "pwd={}": lambda: draw(alnum, 12, 18), "xoxb: {}": lambda: f"xoxb-{draw('0123456789', 11, 12)}-{draw(alnum, 24, 24)}",
    }
    plain = [
        lambda: f"commit {draw('0123456789abcdef', 7, 20)}", lambda: f"version {rng.randint(0, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 99)}", lambda: f"order {draw('0123456789', 4, 16)}",
        lambda: f"https://www.{draw(lower, 4, 12)}.com/{draw(lower, 3, 9)}/{draw(lower, 3, 30)}.html", lambda: draw(lower, 20, 60), lambda: f"{prose(1, 3)} | {prose(1, 2)} | {prose(1, 2)}",
        lambda: f"the {rng.choice(['token', 'secret', 'key', 'password'])} of {prose(2, 4)}", lambda: f"uuid {draw('0123456789abcdef', 8, 8)}-{draw('0123456789abcdef', 4, 4)}-{draw('0123456789abcdef', 4, 4)}",
        lambda: f"{draw(lower, 3, 9)}_{draw(lower, 3, 9)}({draw(lower, 1, 5)}={rng.randint(0, 999)});", lambda: f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}",
        lambda: f"{draw(lower, 3, 8)}{rng.randint(1, 999)}@{draw(lower, 3, 8)}.com", lambda: " ".join(w.upper() + "!!" for w in prose(3, 6).split()), lambda: " ".join(w + rng.choice(["$$$", "%%%", "###", "***"]) for w in prose(3, 6).split()),
        lambda: f"{rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(1, 255)}", lambda: "".join(draw(lower, 2, 6).title() for _ in range(4)) + str(rng.randint(1, 99)),
    ]
    out = []
    for i in range(rows):
        text, spans = prose(0, 6), []
        for _ in range(rng.randint(1, 3)):
            text += " "
            if i % 2 and rng.random() < 0.6:
                form = rng.choice(sorted(secret))
                value = secret[form]()
                at = len(text) + form.index("{}")
                text += form.replace("{}", value)
                spans.append((KIND, at, at + len(value)))
            else:
                text += rng.choice(plain)() if rng.random() < 0.6 else prose(3, 9)
        out.append((text + " " + prose(0, 6), spans))
    return out


def train(rows: list[tuple[str, list[Span]]] | None = None) -> Crf:
    rows = labelled_table() if rows is None else rows
    return Crf([KIND], CUES, classes=3).fit(rows, np.array([file_class(text) for text, _ in rows]))


def scan(docs: DataFrame, crf: Crf) -> DataFrame:
    """``docs`` with base_spans and tagged_spans."""
    return add_spans(docs, base_spans, crf, file_class, accept)
