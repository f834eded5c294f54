"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, address
schemes and identifier cues ("iban", "account", "passport", ...).  A local
parser for each anchor expands left or right over the characters its kind
allows, validates what it found and returns the exact span; runs of digits
(card numbers, IP addresses) are expanded from their first digit.  Every parser
looks at each character a bounded number of times, so texts of any length and
shape take linear time.

Base kinds, leftmost and non-overlapping within a kind: email, ip, card, phone.
Added kinds: url, iban, account (an identifier that follows a cue).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketflow.session import ship_package

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9][0-9.]*")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"[ ().0-9-]+")
URL_END = re.compile(r"[^\x21-\x7E]|[<>\"'`{}|\\^]")
HOST = re.compile(r"(?:[A-Za-z0-9._~%!$&*+,;=:-]*@)?(?:localhost|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)(?::[0-9]{1,5})?(?=[/?#]|$)")
IBAN_RUN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
ACCOUNT_RUN = re.compile(r"[ \t]*(?:number|num|no\.?|nr\.?|#)?[ \t]*[:=#]?[ \t]*([A-Za-z]{0,2}[0-9](?:[ -]?[0-9A-Za-z]){4,33})(?![0-9A-Za-z])", re.I)

# Fixed cue words.
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "konto", "kontonummer", "compte", "cuenta",
        "customer id", "member id")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def email_at(t: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign; its local part starts at ``floor`` or later."""
    start = at
    while start > floor and t[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    m = DOMAIN.match(t, at + 1)
    return (start, m.end()) if m else None


def ips(t: str) -> list[tuple[int, int]]:
    """Four dotted numbers up to 255; numbers are taken four at a time along a dotted run."""
    out = []
    for run in DOTTED.finditer(t):
        if run.group().count(".") < 3:
            continue
        parts, at = [], run.start()
        for piece in run.group().split("."):
            if piece:
                parts.append((at, at + len(piece)))
            else:
                parts = []
            at += len(piece) + 1
            if len(parts) == 4:
                values = [t[s:e].lstrip("0") for s, e in parts]
                if all(len(v) <= 3 and int(v or 0) <= 255 for v in values):
                    out.append((parts[0][0], parts[3][1]))
                parts = []
    return out


def cards(t: str) -> list[tuple[int, int]]:
    out = []
    for m in DIGITS.finditer(t):
        if m.end() - m.start() <= 38:
            d = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(m.span())
    return out


def phone_at(t: str, plus: int) -> tuple[tuple[int, int] | None, int]:
    """(span or none, where the search goes on) of a plus sign."""
    if not t[plus + 1:plus + 2] or t[plus + 1] not in "0123456789":
        return None, plus + 1
    m = PHONE.match(t, plus + 2)
    if not m:
        return None, plus + 1
    body = m.group().rstrip(" ().-")
    if len(body) < 2:
        return None, plus + 1
    end = plus + 2 + len(body)
    n = 1 + sum(c in "0123456789" for c in body)
    return ((plus, end) if 8 <= n <= 15 else None), end


def url_at(t: str, start: int, scheme: int) -> tuple[int, int] | None:
    """Expand a scheme to the next character no address holds; closing punctuation stays out."""
    m = URL_END.search(t, start + scheme)
    body = t[start + scheme:m.start() if m else len(t)].rstrip(".,;:!?")
    while body.endswith(")") and body.count("(") < body.count(")"):
        body = body[:-1].rstrip(".,;:!?")
    return (start, start + scheme + len(body)) if HOST.match(body) else None


def iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def account_after(t: str, end: int) -> tuple[str, int, int] | None:
    """The identifier after a cue: an IBAN if its check digits hold, else 5 to 20 digits."""
    m = ACCOUNT_RUN.match(t, end)
    if not m:
        return None
    if (n := IBAN_RUN.match(t, m.start(1))) and iban_valid(n.group()):
        return "iban", n.start(), n.end()
    digits = sum(c.isdigit() for c in m.group(1))
    return ("account", m.start(1), m.end(1)) if 5 <= digits <= 20 and digits * 2 > len(m.group(1)) else None


def _anchors():
    import ahocorasick
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    for w in SCHEMES:
        a.add_word(w, ("url", len(w)))
    for w in CUES:
        a.add_word(w, ("cue", len(w)))
    a.make_automaton()
    return a


def _same_length_lower(t: str) -> str:
    """Lower case that keeps offsets (some characters grow when lowered)."""
    low = t.lower()
    return low if len(low) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)


def find_spans(text: str | None, anchors=None) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in a text, sorted; code points, end exclusive."""
    t = text or ""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    phone_from = 0
    for last, (kind, n) in (anchors or _anchors()).iter(_same_length_lower(t)):
        start = last - n + 1
        if kind == "email":
            floor = out["email"][-1][1] if out["email"] else 0
            if start >= floor and (s := email_at(t, start, floor)):
                out["email"].append(s)
        elif kind == "phone":
            if start >= phone_from:
                s, phone_from = phone_at(t, start)
                if s:
                    out["phone"].append(s)
        elif kind == "url":
            if not (out["url"] and start < out["url"][-1][1]) and (s := url_at(t, start, n)):
                out["url"].append(s)
        elif not (start and t[start - 1].isalnum()) and not t[last + 1:last + 2].isalpha():
            if s := account_after(t, last + 1):
                if not out[s[0]] or out[s[0]][-1][1] <= s[1]:
                    out[s[0]].append(s[1:])
    if DOTTED.search(t):
        out["ip"], out["card"] = ips(t), cards(t)
    return out


def joined(spans: dict[str, list[tuple[int, int]]], kinds=KINDS) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in spans[k])


def span_columns(text: Column) -> Column:
    """struct of counts per kind, ``base`` and ``spans`` (kind:start:end, comma-joined)."""
    made = []

    @F.pandas_udf("struct<" + ",".join(f"n_{k}:bigint" for k in KINDS) + ",base:string,spans:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(_anchors())
        found = [find_spans(t, made[0]) for t in texts]
        got = {f"n_{k}": [len(f[k]) for f in found] for k in KINDS}
        return pd.DataFrame(got | {"base": [joined(f, BASE) for f in found], "spans": [joined(f) for f in found]})
    return run(text)


def personal_data(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Every row with ``__row`` (``carry`` columns, all by default) and struct ``pii``.

    Null and empty texts have no span; equal texts get equal spans; repeated
    rows stay; an empty table gives no row.
    """
    ship_package(docs.sparkSession)
    kept = F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)])
    return docs.select(kept.alias("__row"), span_columns(F.col("text")).alias("pii"))
