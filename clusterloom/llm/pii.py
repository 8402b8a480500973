"""Personal data by weak supervision.

Candidate spans come from the base patterns (which always stay) and from looser ones: valid numbers inside a
run that fails as a whole, numbers in national form, addresses written around, assigned and bare
keys, names.  Labelers vote on each candidate: its written form, a validity rule (checksum, ranges,
spread of characters; digests, UUIDs, paths and parts of URLs are no keys unless a name or a word before them says so, nor
places names of people), a gazetteer (domain endings, card issuers, calling codes, key prefixes, first names), words
that speak for it, words that speak against it, and its boundaries.  A labeler says yes, no or nothing,
and none knows whether the candidate is a base span.  Votes of the whole corpus are counted by vote pattern (at
most 3^6 for each kind), expectation-maximisation estimates for each kind how reliable each labeler is, starting
from the prior ``RELIABLE``, and a logistic span
classifier is trained on the resulting beliefs over votes and span shape, also from counts.  A looser
candidate becomes a span if the classifier believes it.

Texts are read once: candidates of each document are written to shared storage as small integers,
and counts, training and the final decision read those.  What reaches the driver is a table of
cells (kind, votes, shape) whose number is bounded by construction.

Defined cases: a null text is empty; spans of different kinds may overlap; an added span that
overlaps a base span of its own kind is not added, nor a secret or name that overlaps any; of overlapping added spans of a kind
the first stays; repeated rows are scanned each; an empty table gives
an empty result.  Extra columns are never read.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.llm.common import slices, strings, text_frame
from clusterloom.sources.storage import stored

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "secret", "name")
LABELERS = 6  # form, validity, gazetteer, words for, words against, boundaries
THRESHOLD = 0.8
TRUST = 0.5
NO, YES, SILENT = 0, 1, 2

#: Assumed counts of (no, yes, nothing) of each labeler for false and for real candidates, before any data.
RELIABLE = np.array(
    [
        [[4, 4, 2], [1, 8, 1]],  # form
        [[17, 1.5, 1.5], [0.2, 16, 3.8]],  # validity: a failed checksum decides
        [[5, 3, 2], [2, 6, 2]],  # gazetteer
        [[2, 1, 17], [2, 6, 12]],  # words for: the many candidates without any say little
        [[8, 1, 11], [1, 1, 18]],  # words against
        [[4, 5, 1], [1, 8, 1]],  # boundaries
    ],
    float,
)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Looser candidates.
_ADDRESS = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}(?: ?[\[(]at[\])] ?[\w-]{1,63}(?:(?:\.| ?[\[(]dot[\])] ?| dot )[\w-]{2,63}){1,4}| at [\w-]{1,63}(?: dot [\w-]{2,63}){1,4}|@[\w-]{1,63}(?:\.[\w-]{1,63}){1,8})")
_AT, _DOT = re.compile(r"@| ?[\[(]at[\])] ?| at "), re.compile(r"\.| ?[\[(]dot[\])] ?| dot ")
_DIGITS = re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])|(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_ABROAD = re.compile(r"(?:\+|(?<![0-9])00)[1-9][0-9]{0,2}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?:\+|(?<![0-9])00)[1-9][0-9]{0,2}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ASSIGNED = re.compile(r"(?<![A-Za-z])(?:[A-Za-z]{1,20}[_-])?(?:password|passwd|pwd|passphrase|secret|token|credential|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|auth)[\"']?[ \t]{0,4}(?::=|=>|[:=])[ \t]{0,4}[\"']?([^\s\"'<>]{6,})", re.IGNORECASE)
_LONG = re.compile(r"(?<!\S)\S{16,}")
_BARE = re.compile(r"[A-Za-z0-9_+/-]{16,}={0,2}")
_TITLED = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Sra?|Señora?|Don|Doña)\.? [^\W\d_][\w'-]+(?: [^\W\d_][\w'-]+)?")
_TWO_WORDS = re.compile(r"(?<!\w)([A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)(?:-[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)?(?=( [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'-]+)(?!\w))")

#: Generic domain endings (two-letter ones are countries), key prefixes, first names.
ENDINGS = frozenset("com org net edu gov mil int info biz name pro app dev online site shop blog cloud tech store email xyz club agency media news museum aero coop jobs mobi travel test example local".split())
KEY_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "sk_test_", "pk_live_", "rk_live_", "xoxb-", "xoxp-", "xoxa-", "xoxs-", "eyJ", "ya29.", "npm_", "hf_", "SG.", "dop_v1_")
NAMES = frozenset(
    """aaron adam adrien agnes albert alejandro alexander alice amelie ana andrea andreas angela anke anna anne anthony antoine antonio
    arnaud barbara beatriz benjamin bernd birgit brigitte bruno camille carla carlos carmen carol caroline catherine cecile charles
    charlotte christian christine christopher claire claudia clara cristina daniel david deborah denis diego dieter donald dorothy edward
    elena elisabeth elizabeth emily emma enrique eric erika eva fabian felix fernando florian francesca francisco francois frank franz
    frederic gabriel georg george gerard gerhard guillaume gustavo hannah hans harold heike heinrich heinz helen helga helmut henri henry ines
    ingrid irene isabel jack jacob jacques james jan javier jean jeffrey jennifer jens jessica joachim joan johann john jonathan jorge jose
    joseph juan julia julie julien jutta karen karin karl katharina kevin klaus kurt laura laurent lena leon linda lisa louis lucas lucia luis
    luisa lukas manuel marc margaret maria marie mark markus marta martin mary matthew matthias michael michel miguel monika nancy nathalie nicole
    olivier oscar pablo patricia patrick paul paula pedro peter petra philippe pierre rafael ralf raul renate richard robert roberto sabine samuel sandra
    sarah sebastian sofia sophie stefan stephan stephen steven susan susana sylvie teresa thomas tim ursula valerie veronique victor vincent
    walter werner william wolfgang""".split()
)
_NEAR = {
    "email": ("mail", "email", "contact", "write", "reach", "correo", "kontakt", "courriel", "address", "adresse"),
    "ip": ("ip", "server", "host", "address", "ping", "gateway", "login", "from", "client", "addr"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "kreditkarte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "call", "tel", "telephone", "fax", "mobile", "cell", "telefon", "handy", "telefono", "teléfono", "appelez", "whatsapp"),
    "ssn": ("ssn", "social", "security", "insurance", "taxpayer"),
    "secret": ("key", "password", "passwd", "pwd", "secret", "token", "login", "credential", "auth", "bearer", "apikey", "passphrase"),
    "name": ("dear", "from", "signed", "attn", "contact", "name", "author", "liebe", "lieber", "cher", "querido", "regards", "sincerely"),
}
_AGAINST = {
    "email": (),
    "ip": ("version", "release", "v", "build", "section", "chapter", "kapitel"),
    "card": ("invoice", "order", "isbn", "tracking", "serial", "id", "ean", "sku"),
    "phone": ("invoice", "order", "isbn", "tracking", "serial", "price", "version"),
    "ssn": ("invoice", "order", "isbn", "tracking", "serial", "part"),
    "secret": ("sha", "checksum", "commit", "md", "hash", "digest", "revision", "uuid", "etag"),
    "name": ("street", "avenue", "city", "the", "university", "road"),
}
#: Words that make a place or a thing of the name before them.
_PLACES = frozenset("airport avenue boulevard street road lane drive square plaza park bridge station terminal university college school institute hospital church cathedral museum library stadium city county river lake island beach hotel award prize foundation straße strasse allee platz flughafen bahnhof schule universität krankenhaus aéroport rue place gare université hôpital aeropuerto calle avenida plaza universidad".split())
_WORD = re.compile(r"[^\W\d_]+")
#: What looks like a key and is none unless something says so: digests in hexadecimal, UUIDs, words joined as in paths and names of modules.
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_JOINED = re.compile(r"[/_-]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their "@" in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            yield start, domain.end()
            done = domain.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """Without the punctuation that closes a sentence or a mark-up around it."""
    while b > a and text[b - 1] in ".,;:!?)]}#*&$%|":
        b -= 1
    return a, b


def _keys(text: str) -> Iterator[tuple[int, int]]:
    """Values assigned to a secret's name, and bare runs with letters and digits."""
    low = text.lower()
    if any(w in low for w in ("passw", "pwd", "passph", "secret", "token", "credential", "key", "auth")):
        for m in _ASSIGNED.finditer(text):
            a, b = _trimmed(text, *m.span(1))
            if b - a >= 6:
                yield a, b
    for long in _LONG.finditer(text):
        for m in _BARE.finditer(text, *long.span()):
            run = m.group()
            if run.startswith(KEY_PREFIXES) or len(run) >= 20 and any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
                yield m.span()


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and further candidates, as (kind number, start, end)."""
    base: list[tuple[int, int, int]] = []
    more: list[tuple[int, int, int]] = []
    if "@" in text:
        base += [(0, a, b) for a, b in emails(text)]
    if "@" in text or " at " in text or "at)" in text or "at]" in text:
        more += [(0, *_trimmed(text, *m.span())) for m in _ADDRESS.finditer(text)]
    for m in _IP.finditer(text):
        (base if _octets(m.group()) else more).append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                base.append((2, *m.span()))
            else:  # a number may stand beside another one
                more += [(2, *x.span()) for x in _DIGITS.finditer(text, *m.span())]
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                base.append((3, *m.span()))
            else:
                more += [(3, *x.span()) for x in _ABROAD.finditer(text, *m.span())]
    if "00" in text:
        more += [(3, *m.span()) for m in _ABROAD.finditer(text) if text[m.start()] == "0"]
    if "-" in text or "." in text or "(" in text:
        more += [(3, *m.span()) for m in _NATIONAL.finditer(text)]
    if "-" in text:
        more += [(4, *m.span()) for m in _SSN.finditer(text)]
    more += [(5, a, b) for a, b in _keys(text)]
    more += [(6, *m.span()) for m in _TITLED.finditer(text)]
    more += [(6, m.start(), m.end(2)) for m in _TWO_WORDS.finditer(text) if m[1].lower() in NAMES]
    taken = {k: [(a, b) for j, a, b in base if j == k or k > 3] for k in {k for k, _, _ in more}}
    clear = {}
    for k, spans in taken.items():
        spans.sort()
        clear[k] = np.array([a for a, _ in spans], np.int64), np.maximum.accumulate(np.array([b for _, b in spans], np.int64)) if spans else np.zeros(0, np.int64)

    def free(k: int, a: int, b: int) -> bool:
        starts, reach = clear[k]
        i = int(np.searchsorted(starts, b))
        return i == 0 or reach[i - 1] <= a

    kept, last = [], {}
    for k, a, b in sorted(set(more)):
        if b > a >= last.get(k, 0) and free(k, a, b):
            kept.append((k, a, b))
            last[k] = b
    return sorted(base), kept


def entropy(text: str) -> float:
    """Bits for each character, by the characters' own counts."""
    n = len(text)
    return -sum(c / n * log2(c / n) for c in Counter(text).values())


def _issuer(digits: str) -> bool:
    """Ranges of the large card schemes, with their lengths."""
    n, two, four = len(digits), int(digits[:2]), int(digits[:4])
    return digits[0] == "4" and n in (13, 16, 19) or (51 <= two <= 55 or 2221 <= four <= 2720) and n == 16 or two in (34, 37) and n == 15 or two in (30, 36, 38, 39) and n == 14 or (four == 6011 or two in (62, 64, 65)) and 16 <= n <= 19 or 3528 <= four <= 3589 and n == 16


def _calling_code(digits: str) -> bool:
    """World zones: 1 and 7, two digits as listed, the zones whose codes have three digits."""
    return digits[0] in "17" or digits[:2] in ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49") or digits[0] == "5" and digits[1] in "12345678" or digits[:2] in ("60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98") or digits[:2] in ("21", "22", "23", "24", "25", "26", "29", "35", "37", "38", "42", "50", "59", "67", "68", "69", "85", "88", "96", "97", "99")


def _no_key(text: str, a: int, b: int) -> bool:
    """Whether a bare run is shaped like a digest, a UUID, a path or a part of a URL."""
    span = text[a:b]
    if _HEX.fullmatch(span) or _UUID.fullmatch(span):
        return True
    ahead = text[max(0, a - 256) : a]
    run = ahead.split()[-1] if ahead and not ahead[-1].isspace() else ""
    if "://" in run or run.startswith("www.") or re.match(r"https?:/?", span):
        return True
    pieces = _JOINED.split(span)
    wordy = sum(len(p) for p in pieces if p.isalpha() and (p.islower() or p.isupper() or p.istitle()) and len(p) <= 20)
    return len(pieces) >= 3 and wordy + len(pieces) - 1 >= 0.6 * len(span)


def _said(good: bool) -> int:
    return YES if good else NO


def votes(text: str, kind: int, a: int, b: int) -> tuple[int, int]:
    """Vote pattern (base 3) and shape (length class, neighbours) of a candidate."""
    name, span = KINDS[kind], text[a:b]
    before = [w.lower() for w in _WORD.findall(text[max(0, a - 32) : a])]
    digits = "".join(c for c in span if "0" <= c <= "9")
    if name == "email":
        user, domain = _AT.split(span, maxsplit=1)
        ending = _DOT.split(domain)[-1].lower()
        form = YES
        valid = _said(not user.startswith(".") and not user.endswith(".") and ".." not in span and ending.isalpha() and len(ending) >= 2)
        known = _said(ending in ENDINGS or len(ending) == 2 and ending.isalpha())
    elif name == "ip":
        parts = span.split(".")
        form = _said(not any(len(x) > 1 and x[0] == "0" for x in parts))
        valid = _said(_octets(span))
        known = NO if parts[0] in ("0", "127", "255") or all(len(x) == 1 for x in parts) else YES if len(digits) >= 8 else SILENT
    elif name == "card":
        form = _said(re.fullmatch(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}", span) is not None)
        valid = _said(luhn(digits) and len(set(digits)) > 2)
        known = YES if _issuer(digits) else SILENT
    elif name == "phone":
        abroad = span.startswith(("+", "00"))
        form = _said(re.fullmatch(r"(?:\+|00)?[0-9]{0,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){1,4}", span) is not None)
        valid = _said(9 <= len(digits) - 2 * span.startswith("00") <= 15 and len(set(digits)) > 2)
        known = _said(_calling_code(digits[2:] if span.startswith("00") else digits)) if abroad else YES if span[0] == "(" else SILENT
    elif name == "ssn":
        form = YES
        valid = _said(not (span.startswith(("000", "666", "9")) or span[4:6] == "00" or span.endswith("0000")))
        known = SILENT
    elif name == "secret":
        assigned = _ASSIGNED.search(text, max(0, a - 40), b) is not None
        kinds = any(c.islower() for c in span) + any(c.isupper() for c in span) + bool(digits)
        form = _said(assigned or re.fullmatch(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[A-Za-z0-9_+/-]{32,}={0,2}", span) is not None)
        named = assigned or span.startswith(KEY_PREFIXES)
        denied = any(w in _AGAINST[name] for w in before[-2:]) or not any(w in _NEAR[name] for w in before) and _no_key(text, a, b)
        valid = _said((named or not denied) and kinds >= 2 and bool(digits) and entropy(span) >= min(3.0, 0.75 * log2(len(span))))
        known = YES if assigned or span.startswith(KEY_PREFIXES) else SILENT
    else:
        words = span.split(" ")
        form = _said(all(w[:1].isupper() and not w.isupper() for w in words if w))
        place = words[-1].lower() in _PLACES or any(w.lower() in _PLACES for w in _WORD.findall(text[b : b + 32])[:2])
        valid = _said(len(words) >= 2 and all(len(w.strip(".")) >= 2 for w in words) and (not place or _TITLED.match(span) is not None))
        known = _said(any(w.split("-")[0].lower() in NAMES for w in words))
    if name == "name":
        before += ["name"] if _TITLED.match(span) else []
    speaks = YES if any(w in _NEAR[name] for w in before) else SILENT
    against = NO if any(w in _AGAINST[name] for w in before[-2:]) else SILENT
    left, right = text[a - 1 : a], text[b : b + 1]
    edge = _said(not (left.isalnum() or right.isalnum() or left in ("_", "/", "-", "\\") and left))
    pattern = 0
    for v in (form, valid, known, speaks, against, edge):
        pattern = pattern * 3 + v
    side = lambda c: 0 if not c else 1 if c.isspace() else 2 if not c.isalnum() else 3
    return pattern, (min((b - a) // 6, 4) * 4 + side(left)) * 4 + side(right)


SHAPES = 5 * 4 * 4
CELLS = len(KINDS) * 3**LABELERS * SHAPES


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        spans, cells = [], []
        for text in strings(batch.column(1)):
            flat, own = [], []
            base, more = candidates(text)
            for group, is_base in ((base, True), (more, False)):
                for k, a, b in group:
                    pattern, shape = votes(text, k, a, b)
                    flat += (k if is_base else k + 16, a, b)
                    own.append((k * 3**LABELERS + pattern) * SHAPES + shape)
            spans.append(flat)
            cells.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.int64())), pa.array(cells, pa.list_(pa.int32()))], names=["id", "spans", "cells"])


def _spoken(pattern: np.ndarray) -> np.ndarray:
    return np.stack([(pattern // 3 ** (LABELERS - 1 - j)) % 3 for j in range(LABELERS)], 1)


def reliabilities(kind: np.ndarray, pattern: np.ndarray, count: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Belief that a candidate with this vote pattern is real, by expectation-maximisation.

    For each kind every labeler has a chance of each answer on real and on false candidates, and the kind
    has a share of real ones.  ``RELIABLE`` stands for counts seen before, at least a share ``TRUST`` of the
    data: labelers that always agree must not outvote a checksum, and few candidates stay near it.
    """
    vote = _spoken(pattern)
    belief = np.zeros(len(kind))
    for k in np.unique(kind):
        own = np.flatnonzero(kind == k)
        v, n = vote[own], count[own]
        before = RELIABLE * max(1.0, TRUST * n.sum() / RELIABLE.sum(2).max())
        seen, share, last = before, 0.5, None
        for _ in range(rounds):
            chance = np.log(seen / seen.sum(2, keepdims=True))
            odds = np.log(share) - np.log(1 - share) + sum(chance[j, 1, v[:, j]] - chance[j, 0, v[:, j]] for j in range(LABELERS))
            real = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
            if last is not None and abs(real - last).max() < 1e-7:
                break
            last = real
            sure = max(2.0, 4 * TRUST * n.sum())
            share = (real @ n + sure) / (n.sum() + 2 * sure)
            seen = before.copy()
            for j in range(LABELERS):
                seen[j, 1] += np.bincount(v[:, j], weights=real * n, minlength=3)
                seen[j, 0] += np.bincount(v[:, j], weights=(1 - real) * n, minlength=3)
        belief[own] = real
    return belief


def span_classifier(cells: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Probability of each cell: logistic model over kind, votes and shape, fitted to the beliefs."""
    pattern, shape = cells // SHAPES % 3**LABELERS, cells % SHAPES
    kind = cells // SHAPES // 3**LABELERS
    # Beliefs depend on votes alone, so cells of one pattern count together.
    both, place = np.unique(kind * 3**LABELERS + pattern, return_inverse=True)
    of = np.bincount(place, weights=count, minlength=len(both))
    belief = reliabilities(both // 3**LABELERS, both % 3**LABELERS, of)[place]
    own = np.eye(len(KINDS))[kind]
    hot = [np.ones((len(cells), 1)), own]
    for j in range(LABELERS):
        answer = np.eye(3)[_spoken(pattern)[:, j]]
        hot += [answer, (own[:, :, None] * answer[:, None, :]).reshape(len(cells), -1)]
    hot += [np.eye(5)[shape // 16], np.eye(4)[shape // 4 % 4], np.eye(4)[shape % 4]]
    x = np.concatenate(hot, 1)
    w = np.zeros(x.shape[1])
    weight = count / max(count.sum(), 1) * min(count.sum(), 100_000)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - belief)) + 0.1 * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, gradient)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def _decided(batches: Iterator[pa.RecordBatch], believed) -> Iterator[pa.RecordBatch]:
    chosen = believed.value
    for batch in batches:
        counts, shas, alls = [], [], []
        for flat, cells in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            triples = list(zip(flat[::3], flat[1::3], flat[2::3], strict=True))
            base = [t for t in triples if t[0] < 16]
            added = [(k - 16, a, b) for (k, a, b), c in zip(triples, cells, strict=True) if k >= 16 and c in chosen]
            counts.append([sum(t[0] == k for t in base) for k in range(len(BASE))] + [sum(t[0] == k for t in added) for k in range(len(KINDS))])
            shas.append(hashlib.sha256(digest(base).encode()).hexdigest())
            alls.append(digest(base + added))
        n = np.array(counts, np.int64).reshape(-1, len(BASE) + len(KINDS))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(n[:, k]) for k in range(len(BASE))), pa.array(shas, pa.string()), pa.array(alls, pa.string()), *(pa.array(n[:, len(BASE) + k]) for k in range(len(KINDS))), pa.array(n.sum(1))],
            names=["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", *(f"added_{k}" for k in KINDS), "n_spans"],
        )


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, added spans of each kind, n_spans) of every document."""
    found = stored(text_frame(docs, id_col, text_col).mapInArrow(_found, "id long, spans array<long>, cells array<int>"))
    tally = found.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()  # at most CELLS rows
    cells, count = np.array([r["cell"] for r in tally], np.int64), np.array([r["count"] for r in tally], np.float64)
    order = np.argsort(cells)
    cells, count = cells[order], count[order]
    believed = frozenset(cells[span_classifier(cells, count) >= threshold].tolist()) if len(cells) else frozenset()
    shipped = docs.sparkSession.sparkContext.broadcast(believed)
    schema = "id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, " + ", ".join(f"added_{k} long" for k in KINDS) + ", n_spans long"
    return found.mapInArrow(partial(_decided, believed=shipped), schema)


def op1_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
