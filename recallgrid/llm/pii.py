"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, schemes, identifier cues) in one pass over the text; a
small deterministic parser per kind expands each anchor to its boundaries and validates what it found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from recallgrid.llm.common import arrow_pass

#: Base kinds first: they come in this order where spans start together.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]

SCHEMES = ("http://", "https://", "ftp://", "mailto:")
#: Cues in lower case; what follows one (after blanks, ``:``, ``#``, ``=``, ``is``, ``no``, ``number``) is an account if it is long enough.
CUES = ("iban", "account", "acct", "passport", "ssn", "routing", "swift", "tax id")
KEY_STARTS = ("AKIA", "ASIA", "ghp_", "sk_live_", "xoxb-")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL_REST = re.compile(r"[^\s<>\"'|]*[^\s<>\"'|.,;:!?)\]}]")
FILLER = re.compile(r"(?:[\s:#=.-]|\b(?:is|no|nr|number|id)\b)*", re.IGNORECASE)
IDENTIFIER = re.compile(r"[A-Za-z]{0,4}[0-9][A-Za-z0-9]*(?:[ -]?[A-Za-z0-9]*[0-9][A-Za-z0-9]*)*")
#: Printed IBAN: country, check digits, groups of four, the last one of one to four; groups may be letters only.
IBAN_GROUP = re.compile(r"[ -]?([A-Za-z0-9]{1,4})(?![A-Za-z0-9])|[ -]?([A-Za-z0-9]{4})")
IBAN_START = re.compile(r"[A-Za-z]{2}[0-9]{2}")
IBAN_LEAST, IBAN_MOST = 15, 34
KEY = re.compile(r"[A-Za-z0-9_-]{16,}")
DIGITS = re.compile(r"[0-9]+")


def _automaton():
    trie = ahocorasick.Automaton()
    for anchor, kind in [("@", "@"), ("+", "+"), *((d, "0") for d in "0123456789"), *((s, "url") for s in SCHEMES),
                         *((k, "key") for k in KEY_STARTS)]:
        trie.add_word(anchor, (kind, len(anchor)))
    trie.make_automaton()
    cues = ahocorasick.Automaton()
    for cue in CUES:
        cues.add_word(cue, len(cue))
    cues.make_automaton()
    return trie, cues


TRIE, CUE_TRIE = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _is_ip(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))


def _is_card(match: str) -> bool:
    digits = match.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and luhn(digits)


def _is_phone(match: str) -> bool:
    return 10 <= sum(map(len, DIGITS.findall(match))) <= 15


def _iban_end(text: str, at: int, named: bool) -> int:
    """End of the IBAN that starts at ``at``, 0 if there is none.

    That with the right check digits; else, after the cue ``iban``, the groups in capitals up to the last one that holds a digit.
    """
    if not (m := IBAN_START.match(text, at)):
        return 0
    body, end, likely, capitals = m[0], m.end(), 0, m[0].isupper()
    while m := IBAN_GROUP.match(text, end):
        group = m[1] or m[2]
        body, end, capitals = body + group, m.end(), capitals and not any("a" <= c <= "z" for c in group)
        if len(body) > IBAN_MOST:
            break
        if len(body) >= IBAN_LEAST and not text[end: end + 1].isalnum():
            if int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1:
                return end
            if named and capitals and any(c.isdigit() for c in group):
                likely = end
        if len(group) < 4:
            break
    return likely


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then in the order of ``KINDS``.

    email, ip, card and phone: leftmost matches that do not overlap within their kind, failing ones dropped without retries.
    url: a scheme and what follows up to a blank, quote or bracket, without closing punctuation. account: an identifier of at
    least 6 characters with 4 digits or more after a cue (of an IBAN all groups, also those of letters), or a key with a known start.
    """
    if not text:
        return []
    found = []
    done = dict.fromkeys(KINDS, 0)

    def take(kind, start, end, good):
        if good:
            found.append((start, end, kind))
        done[kind] = end

    last_digit = -2
    for at, (anchor, length) in TRIE.iter(text):
        if anchor == "0":
            starts, last_digit = last_digit != at - 1, at
            if not starts:
                continue
            if at >= done["ip"] and (m := IP.match(text, at)):
                take("ip", at, m.end(), _is_ip(m[0]))
            if at >= done["card"] and (m := CARD.match(text, at)):
                take("card", at, m.end(), _is_card(m[0]))
        elif anchor == "@":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                take("email", start, m.end(), True)
        elif anchor == "+":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                take("phone", at, m.end(), _is_phone(m[0]))
        elif anchor == "url":
            start = at - length + 1
            if start >= done["url"] and (m := URL_REST.match(text, at + 1)):
                take("url", start, m.end(), True)
        elif (start := at - length + 1) >= done["account"] and (start == 0 or not text[start - 1].isalnum()):
            if m := KEY.match(text, start):
                take("account", start, m.end(), True)
    # The dotted capital I is the only letter that grows in lower case; cues are ASCII, so any other letter may stand for it.
    lower = text.replace("\u0130", "\u0131").lower()
    for at, length in CUE_TRIE.iter(lower):
        start = at - length + 1
        if (start and text[start - 1].isalnum()) or text[at + 1: at + 2].isalnum():
            continue
        place = FILLER.match(text, at + 1).end()
        if place >= done["account"]:
            m = IDENTIFIER.match(text, place)
            end = max(m.end() if m else 0, _iban_end(text, place, lower.startswith("iban", start)))
            body = text[place:end]
            if len(body) >= 6 and sum(c.isdigit() for c in body) >= 4:
                take("account", place, end, True)
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(found), key=lambda s: (s[0], rank[s[2]], s[1]))


def _rows(*columns) -> Iterator[tuple]:
    *keep, texts = columns
    for *own, text in zip(*keep, texts):
        spans = find_spans(text)
        yield (*own, *(sum(s[2] == k for s in spans) for k in BASE),
               ",".join(f"{k}:{a}:{b}" for a, b, k in spans if k in BASE), ",".join(f"{k}:{a}:{b}" for a, b, k in spans))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans (``kind:start:end``, comma-joined, code points, end exclusive).

    Null and empty texts have no spans; null doc_ids and repeated rows are rows like any other; no rows give no rows.
    """
    return arrow_pass(
        docs, ["doc_id", "text"],
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string", _rows)


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced as one, named by the first."""
    if not text:
        return text
    out, at, open_kind, end = [], 0, None, 0
    for start, stop, kind in find_spans(text):
        if open_kind is not None and start < end:
            end = max(end, stop)
            continue
        if open_kind is not None:
            out.append(f"[{open_kind.upper()}]")
            at = end
        out.append(text[at:start])
        open_kind, end = kind, stop
    if open_kind is not None:
        out.append(f"[{open_kind.upper()}]")
        at = end
    out.append(text[at:])
    return "".join(out)


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked (null stays null) and ``n_chars``, if there, counted anew."""
    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index("text")
            texts = [masked(t) for t in batch.column(i).to_pylist()]
            batch = batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))
            j = batch.schema.get_field_index("n_chars")
            if j >= 0:
                counts = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(j).type)
                batch = batch.set_column(j, batch.schema.field(j), counts)
            yield batch

    return docs.mapInArrow(run, docs.schema)
