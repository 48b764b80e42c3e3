"""Personal data by anchor expansion: one Aho-Corasick pass finds at-signs, digit and plus cues,
schemes and identifier cues; parsers at the anchors expand to both sides and validate.

Each base kind takes the leftmost matches that do not overlap, as its pattern would:
email, ip (four numbers, at most 255 each), card (13 to 19 digits that pass Luhn), phone (9 to 15
digits). Beside them: account (a cue that stands as a word of its own, then an identifier with
digits), iban (country code, check digits, modulus 97) at a cue, mailbox (what a mailto scheme
names, letters of any script), number (7 to 15 digits after a tel or sms scheme), userinfo (user, or
user and password, of a URL's authority). No span has a greatest length but those named here.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposcope.llm.common import parts

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("account", "iban", "mailbox", "number", "userinfo")
#: Cues that an account or identity number follows, schemes whose authority can name a
#: user, schemes that name a mailbox or a telephone number.
CUES = ("account number", "account no", "acct", "passport", "ssn", "social security", "tax id", "iban")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
MAIL_SCHEMES, NUMBER_SCHEMES = ("mailto:",), ("tel:", "sms:")
_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | {"-"}
_PHONE = _DIGITS | frozenset(" ().-")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    made.add_word("@", ("@", 1))
    for d in "0123456789":
        made.add_word(d, ("d", 1))
        made.add_word("+" + d, ("+", 2))
        for e in "0123456789":
            made.add_word(f"{d}.{e}", (".", 3))
    words = {"cue": CUES, "scheme": SCHEMES, "mail": MAIL_SCHEMES, "tel": NUMBER_SCHEMES}
    for kind, own in words.items():
        for word in own:
            for form in {word, word.upper(), word.capitalize(), word.title()}:
                made.add_word(form, (kind, len(form)))
    made.make_automaton()
    return made


def _run(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _back(text: str, at: int, allowed: frozenset, floor: int) -> int:
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def emails(text: str, signs: list[int]) -> list[tuple[int, int]]:
    out, floor = [], 0
    for at in signs:
        if at < floor:
            continue
        start = _back(text, at, _LOCAL, floor)
        end = _run(text, at + 1, _LABEL)
        if start == at or end == at + 1:
            continue
        stop = end
        while text[stop : stop + 1] == "." and (after := _run(text, stop + 1, _LABEL)) > stop + 1:
            stop = after
        if stop > end:
            out.append((start, stop))
            floor = stop
    return out


def ips(text: str, dots: list[int]) -> list[tuple[int, int]]:
    out, floor = [], 0
    for dot in dots:
        if dot <= floor:
            continue
        start, stop, parts = _back(text, dot, _DIGITS, floor), dot, 1
        if start == dot:
            continue
        while parts < 4 and text[stop : stop + 1] == "." and (after := _run(text, stop + 1, _DIGITS)) > stop + 1:
            stop, parts = after, parts + 1
        if parts == 4:
            floor = stop
            if all(len(x := p.lstrip("0")) < 3 or len(x) == 3 and x <= "255" for p in text[start:stop].split(".")):
                out.append((start, stop))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += (x * 2 - 9 if x > 4 else x * 2) if i % 2 else x
    return total % 10 == 0


def cards(text: str, digits: list[int]) -> list[tuple[int, int]]:
    """``digits``: where all digits stand. A run goes on over one space or hyphen."""
    out, i, n = [], 0, len(digits)
    while i < n:
        j = i
        while j + 1 < n and ((step := digits[j + 1] - digits[j]) == 1 or step == 2 and text[digits[j] + 1] in " -"):
            j += 1
        if 13 <= j - i + 1 <= 19 and luhn("".join([text[k] for k in digits[i : j + 1]])):
            out.append((digits[i], digits[j] + 1))
        i = j + 1
    return out


def phones(text: str, signs: list[int]) -> list[tuple[int, int]]:
    out = []
    for at in signs:
        stop = _run(text, at + 2, _PHONE)
        while stop > at + 3 and text[stop - 1] not in _DIGITS:
            stop -= 1
        if stop > at + 3 and 9 <= sum(c in _DIGITS for c in text[at:stop]) <= 15:
            out.append((at, stop))
    return out


def iban(text: str, at: int) -> tuple[int, int] | None:
    while at < len(text) and text[at] in " :#=":
        at += 1
    body, i = "", at
    while i < len(text) and len(body) < 34 and (text[i] in _ALNUM or text[i] == " " and text[i + 1 : i + 2] in _ALNUM):
        if text[i] != " ":
            body += text[i].upper()
        i += 1
        if len(body) >= 15 and body[:2].isalpha() and body[2:4].isdigit() and text[i : i + 1] not in _ALNUM:
            if int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1:
                return at, i
    return None


def account(text: str, at: int) -> tuple[int, int] | None:
    while at < len(text) and text[at] in " .:#=":
        at += 1
    stop = _run(text, at, _LABEL)
    body = text[at:stop]
    return (at, stop) if 6 <= len(body) <= 24 and sum(c in _DIGITS for c in body) >= 4 else None


def userinfo(text: str, at: int) -> tuple[int, int] | None:
    """user or user:password before the at-sign of a URL's authority. A slash ends the authority, so
    no character is looked at for two schemes."""
    stop = at
    while stop < len(text) and text[stop] not in "/?#@ \t\r\n\"'<>":
        stop += 1
    return (at, stop) if stop > at and text[stop : stop + 1] == "@" else None


def mailbox(text: str, at: int) -> tuple[int, int] | None:
    """A local part, one at-sign and a host with a dot."""
    stop = at
    while stop < len(text) and not text[stop].isspace() and text[stop] not in "?&,;:/\"'<>()[]":
        stop += 1
    while stop > at and text[stop - 1] in ".!":
        stop -= 1
    local, sign, host = text[at:stop].partition("@")
    return (at, stop) if local and sign and "." in host.strip(".") and "@" not in host else None


def number(text: str, at: int) -> tuple[int, int] | None:
    start = at + (text[at : at + 1] == "+")
    stop = _run(text, start, _PHONE)
    while stop > start and text[stop - 1] not in _DIGITS:
        stop -= 1
    return (at, stop) if 7 <= sum(c in _DIGITS for c in text[start:stop]) <= 15 else None


def _alone(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit touches the span."""
    return not (start and text[start - 1].isalnum()) and not text[end : end + 1].isalnum()


def spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind, code points, end exclusive, in order. Null and empty texts: none."""
    found: dict[str, list[int]] = {"@": [], "d": [], "+": [], ".": [], "cue": [], "scheme": [], "mail": [], "tel": []}
    for end, (kind, size) in automaton().iter(text) if text else ():
        after = end + 1
        if kind in "+.":
            found[kind].append(end - 1)
        elif kind in "@d":
            found[kind].append(end)
        elif kind == "scheme" or (_alone(text, after - size, after) if kind == "cue" else not text[after - size - 1 : after - size].isalnum()):
            found[kind].append(after)
    if not text:
        return {k: [] for k in (*KINDS, *MORE_KINDS)}
    out = {
        "email": emails(text, found["@"]), "ip": ips(text, found["."]), "card": cards(text, found["d"]), "phone": phones(text, found["+"]), "account": [], "iban": [],
        "mailbox": [x for at in found["mail"] if (x := mailbox(text, at))], "number": [x for at in found["tel"] if (x := number(text, at))],
        "userinfo": [x for at in found["scheme"] if (x := userinfo(text, at))],
    }
    floor = 0
    for at in found["cue"]:
        if at >= floor:
            known = iban(text, at)
            made = known or account(text, at)
            if made:
                out["iban" if known else "account"].append(made)
                floor = made[1]
    return out


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def redact(text: str | None, found: dict[str, list[tuple[int, int]]]) -> str | None:
    """Each span, or what overlapping spans cover together, gives way to its kind in brackets."""
    every = sorted((a, -b, k) for k, own in found.items() for a, b in own)
    if not every:
        return text
    out, at = [], 0
    for a, b, kind in every:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row: null texts count as
    empty; equal texts, ties and repeated rows are handled row by row; rows are never grouped, texts are
    read whole, other columns are not read; an empty table gives no rows."""
    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches):
        for batch in parts(batches):
            every = [spans(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([len(f[k]) for f in every], pa.int64()) for k in KINDS]
            columns.append(pa.array([hashlib.sha256(joined(f, KINDS).encode()).hexdigest() for f in every], pa.string()))
            columns.append(pa.array([joined(f, KINDS + MORE_KINDS) for f in every], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {counts}, base_sha256 string, spans string")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, the text with its personal data replaced; null and empty texts stay as they
    are. n_chars, if there is such a column, is set anew for texts that are not null. Columns of any
    other name or kind go through unread; repeated rows stay repeated; an empty table stays empty."""
    names = docs.columns
    at = names.index(text_col)
    size = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in parts(batches):
            columns = list(batch.columns)
            texts = [redact(t, spans(t)) for t in columns[at].to_pylist()]
            columns[at] = pa.array(texts, columns[at].type)
            if size is not None:
                old = columns[size].to_pylist()
                columns[size] = pa.array([o if t is None else len(t) for o, t in zip(old, texts, strict=True)], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
