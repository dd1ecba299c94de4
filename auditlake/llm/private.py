"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds its anchors: at-signs, schemes, plus signs, the first digits of numbers and
the words that announce an identifier. Around each anchor a parser of its own walks outwards to the borders of the
email, address, number, account or secret and says whether it is one. Nothing else of the text is looked at.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import DataFrame

from auditlake.llm.common import by_rows, documents_of

# The kinds in their order; the first four are the base.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account", "key", "secret")

# Words that announce an account number or a secret, and how known access keys begin.
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "passport", "ssn")
SECRET_CUES = ("token", "password", "passwd", "pwd", "secret", "api_key", "api-key", "apikey", "access_key", "access-key")
KEY_BEGINNINGS = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "sk_live_")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DIALLED = re.compile(r"[ ().0-9-]*")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_LOGIN_AND_HOST = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=:-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?")
_ACCOUNT = re.compile(r"(?: ?(?i:number|nummer|no|nr)\.?)?[ :=#]{1,3}([A-Za-z0-9]+(?:[ -][0-9][A-Za-z0-9]*)*)")
_KEY = re.compile(r"[A-Za-z0-9_-]{12,}")
_SECRET = re.compile("[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?([A-Za-z0-9_./+=~-]{8,})")


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) << (place & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def iban(code: str) -> bool:
    """Whether the two digits after the country make the whole 1 modulo 97."""
    if not re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", code):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _has_digit(text: str) -> bool:
    return any("0" <= c <= "9" for c in text)


def _left(text: str, at: int, least: int, allowed: frozenset) -> int:
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


# Each parser gets the text, the anchor's first and last position, and the end of the kind's last match; it gives the
# spans it accepts and the place before which the kind needs no other look.


def _email(text, first, last, done):
    start, domain = _left(text, first, done, _LOCAL), _DOMAIN.match(text, first + 1)
    if start == first or not domain:
        return (), done
    return ((start, domain.end()),), domain.end()


def _ip(text, first, last, done):
    start = _left(text, first, done, frozenset("0123456789"))
    spans, end = [], start
    parts = _DOTTED.match(text, start).group().split(".")
    for i in range(0, len(parts), 4):
        four = parts[i : i + 4]
        begin, end = end, end + sum(map(len, four)) + len(four)
        short = [part.lstrip("0") for part in four]
        if len(four) == 4 and all(len(part) < 4 and int(part or "0") <= 255 for part in short):
            spans.append((begin, end - 1))
    return spans, end


def _card(text, first, last, done):
    end = _DIGITS.match(text, first).end()
    digits = text[first:end].replace(" ", "").replace("-", "")
    return (((first, end),) if 14 <= len(digits) <= 19 and luhn(digits) else ()), end


def _phone(text, first, last, done):
    rest = _DIALLED.match(text, first + 2).group().rstrip(" ().-")
    if len(rest) < 2:
        return (), done
    end = first + 2 + len(rest)
    digits = 1 + sum("0" <= c <= "9" for c in rest)
    return (((first, end),) if 10 <= digits <= 15 else ()), end


def _address(text, first, last, done):
    start = _left(text, first, done, _SCHEME)
    while start < first and not text[start].isalpha():
        start += 1
    rest = _LOGIN_AND_HOST.match(text, last + 1)
    if start == first or not rest:
        return (), done
    return ((start, rest.end()),), rest.end()


def _account(text, first, last, done):
    found = _ACCOUNT.match(text, last + 1)
    if not found:
        return (), done
    code = found.group(1).replace(" ", "").replace("-", "")
    announced = text[first : last + 1].lower() == "iban"
    good = iban(code) if announced else 6 <= len(code) <= 34 and sum("0" <= c <= "9" for c in code) >= 5
    return ((found.span(1),) if good else ()), found.end()


def _key(text, first, last, done):
    before = text[first - 1] if first else " "
    if text[first : last + 1] not in KEY_BEGINNINGS or before.isascii() and (before.isalnum() or before == "_"):
        return (), done
    rest = _KEY.match(text, last + 1)
    if not rest:
        return (), done
    return (((first, rest.end()),) if _has_digit(rest.group()) else ()), rest.end()


def _secret(text, first, last, done):
    found = _SECRET.match(text, last + 1)
    if not found:
        return (), done
    return ((found.span(1),) if _has_digit(found.group(1)) else ()), found.end()


_PARSERS = dict(zip(KINDS, (_email, _ip, _card, _phone, _address, _account, _key, _secret)))


def anchors() -> dict[str, str]:
    """Kind by anchor. Letters of anchors are small, as in the folded text."""
    digits = "0123456789"
    found = {"@": "email", "://": "address"}
    found |= {"+" + d: "phone" for d in digits}
    found |= {f"{a}.{b}": "ip" for a, b in product(digits, digits)}
    found |= {a + between + b: "card" for a, between, b in product(digits, ("", " ", "-"), digits)}
    found |= dict.fromkeys(ACCOUNT_CUES, "account") | dict.fromkeys(SECRET_CUES, "secret")
    return found | {beginning.lower(): "key" for beginning in KEY_BEGINNINGS}


class Finder:
    """Spans of whole texts as (start, end, kind), by start and then by the order of kinds; code points, end exclusive."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for anchor, kind in anchors().items():
            self.automaton.add_word(anchor, (len(anchor), kind, _PARSERS[kind]))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str]]:
        # Only A-Z are folded, so that every character keeps its place.
        folded = text.encode("utf-8").lower().decode("utf-8")
        done, found = dict.fromkeys(KINDS, 0), []
        for last, (length, kind, parse) in self.automaton.iter(folded):
            first = last - length + 1
            if first >= done[kind]:
                spans, done[kind] = parse(text, first, last, done[kind])
                found += [(start, end, kind) for start, end in spans]
        return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or run of spans that overlap, replaced by the first one's kind in brackets."""
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def find_private(docs: DataFrame, masked: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end, value) and, where asked for, the masked text.

    Spans of one kind do not overlap; spans of different kinds may. Null texts count as empty and have no spans; null
    ids and repeated rows stay, each a document of its own; an empty table gives no rows. Whole texts of any length
    are searched, each in time that grows with its length alone.
    """
    ddl = "doc_id long, spans array<struct<kind:string,start:long,end:long,value:string>>" + (", masked string" if masked else "")

    def make():
        finder = Finder()

        def step(rows):
            out = {"doc_id": rows["doc_id"], "spans": [], "masked": []}
            for text in rows["text"]:
                spans = finder.find(text)
                out["spans"].append([{"kind": k, "start": s, "end": e, "value": text[s:e]} for s, e, k in spans])
                if masked:
                    out["masked"].append(mask(text, spans))
            return out

        return step

    return by_rows(documents_of(docs, id_col, text_col), ddl, make)
