"""What identifies a person, a company or a deal in a text: candidates by simple runs, each then judged by its parts.

A text is cut into words that know what punctuation follows them. Names, companies, codenames and addresses are short
runs of such words whose neighbours decide; mail addresses grow outwards from an at-sign; telephone numbers are runs of
digit groups whose shape decides. All detectors are linear in the text. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

# What counts as identifying.
TOP_LEVEL = frozenset("com net org io ai co de fr ch sg hk jp cn in au ca nl se no dk es it biz info us eu gov edu bank finance capital group fund partners uk".split())
SCHEMES = ("http", "https", "ftp", "sftp", "s3", "file")
HOMES = ("/Users/", "/home/", "/Volumes/", "/mnt/", "/media/", "/srv/", "~/")
EXCHANGES = frozenset("NYSE NASDAQ LSE LON AMEX TSX ASX HKEX SGX SEHK EPA ETR FRA BIT BME OTC XETRA".split())
STREETS = frozenset("Street St Avenue Ave Road Rd Lane Ln Boulevard Blvd Drive Dr Square Sq Place Pl Court Ct Terrace Way Wharf Quay Plaza Tower House".split())
TITLES = frozenset("Mr Mrs Ms Miss Mx Dr Prof Professor Sir Dame Lord Lady Hon".split())
PARTICLES = frozenset("de del della di da do dos du des la le les van von der den ter bin binti ibn al el st af av mac mc".split())
CUES = frozenset("project operation deal transaction initiative target codename".split())
COMPANY_FORMS = frozenset("llp llc lp ltd limited inc incorporated corp corporation company plc gmbh ag sa spa srl bv nv ab oyj kg kgaa sarl sas pty group holdings holding partners capital technologies ventures".split())
ROLES = frozenset("CEO CFO COO CTO CIO CMO Chairman Chairwoman Chairperson Chair President Director Partner Principal Founder Treasurer Secretary Counsel Analyst Manager Associate Executive Officer".split())
RANKS = frozenset("Managing Chief Senior Vice Executive Deputy Non-Executive General Head Finance Operating Financial Co-Founder".split())
SAYING = frozenset("said says told commented noted added explained remarked".split())
SMALL_WORDS = frozenset("a an the this that these those in on at by of for from to and or but with our its their his her we it as if when while source note see".split())

OPENING, CLOSING, POSSESSIVE = "([{<\"'“‘«", ".,;:!?)]}>'\"”’»", ("'s", "’s")
PATH_END = frozenset("<>\"'|?*")
MAIL_MARKS = frozenset("._%+-'")
DIGIT_RUN = re.compile(r"[+(]?[0-9][0-9() .\u00a0-]*")
GROUP = re.compile(r"[0-9]+")
LETTER, DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")
OUTWARD, INWARD = re.compile(r"[A-Z]{1,2}[0-9][A-Z0-9]?"), re.compile(r"[0-9][A-Z]{2}")
SEPARATORS = (" ", "\u00a0", "-", ".", ")", ") ", " (")

Found = Iterator[tuple[int, int]]


@dataclass(slots=True)
class Word:
    text: str
    start: int
    end: int
    after: str = ""  # punctuation and line ends before the next word

    @property
    def bare(self) -> str:
        return self.text.lower()


def words_of(text: str) -> list[Word]:
    out: list[Word] = []
    reached = 0
    for m in re.finditer(r"\S+", text):
        raw = m.group()
        core = raw.lstrip(OPENING)
        start = m.start() + len(raw) - len(core)
        kept = core.rstrip(CLOSING)
        if kept.endswith(POSSESSIVE):
            kept = kept[:-2]
        if out:
            out[-1].after += raw[: len(raw) - len(core)] + ("\n" if "\n" in text[reached : m.start()] else "")
            if not kept:
                out[-1].after += core
        if kept:
            out.append(Word(kept, start, start + len(kept), core[len(kept) :]))
        reached = m.end()
    return out


def _ascii_word(s: str, marks: str = "") -> bool:
    return bool(s) and s.isascii() and all(c.isalnum() or c in marks for c in s)


def emails(text: str, _: list[Word]) -> Found:
    """Mail characters before an at-sign, and after it labels between dots up to the last that begins with two letters."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and (_ascii_word(text[start - 1]) or text[start - 1] in MAIL_MARKS):
            start -= 1
        stop = at + 1
        while stop < len(text) and (_ascii_word(text[stop]) or text[stop] in ".-"):
            stop += 1
        domain = text[at + 1 : stop]
        for dot in (k for k in range(len(domain) - 1, 0, -1) if domain[k] == "."):
            tail = re.match(r"[A-Za-z]{2,}", domain[dot + 1 :])
            if tail and start < at:
                done = at + 1 + dot + 1 + tail.end()
                yield start, done
                break
        at = text.find("@", max(at + 1, done))


def handles(text: str, _: list[Word]) -> Found:
    for m in re.finditer(r"@[A-Za-z0-9_]+", text):
        before = text[m.start() - 1 : m.start()]
        free = not before or not (_ascii_word(before) or before in MAIL_MARKS)
        if free and len(m.group()) >= 4 and LETTER.match(m.group()[1]):
            yield m.start(), m.end()


def _host(s: str) -> bool:
    labels = s.split(".")
    return len(labels) > 1 and all(_ascii_word(x, "-") for x in labels) and labels[-1].lower() in TOP_LEVEL and any(LETTER.search(x) for x in labels[:-1])


def urls(text: str, words: list[Word]) -> Found:
    """A scheme with something behind it, a name that begins with www, or a host under a known top-level name."""
    for w in words:
        cut = next((k for k, c in enumerate(w.text) if c in "<>\"')]"), len(w.text))
        s = w.text[:cut]
        scheme, mark, rest = s.partition("://")
        head = scheme.lower().rpartition("(")[2] if mark else ""
        named = s.partition("/")[0]
        if mark and head in SCHEMES and rest or named.lower().startswith("www.") and len(named) > 6 or not mark and "@" not in named and _host(named):
            yield w.start, w.start + len(s.rstrip(CLOSING))


def paths(text: str, words: list[Word]) -> Found:
    for w in words:
        drive = len(w.text) > 3 and LETTER.match(w.text[0]) and w.text[1:3] == ":\\"
        if drive or w.text.startswith("\\\\") and len(w.text) > 2 or w.text.startswith(HOMES):
            cut = next((k for k, c in enumerate(w.text) if c in PATH_END), len(w.text))
            yield w.start, w.start + cut


def _dialled(text: str, groups: list[tuple[int, int]], i: int) -> int:
    """How many digit groups from the i-th make one telephone number; 0 for none.

    International: a plus sign and a country code. Bracketed: an area code in brackets. National: a trunk zero, or groups
    of 3, 3 and 4 digits. Plain grouped figures fit none of these.
    """
    near = [i]
    while near[-1] + 1 < len(groups) and len(near) < 6 and text[groups[near[-1]][1] : groups[near[-1] + 1][0]] in SEPARATORS:
        near.append(near[-1] + 1)
    sizes = [groups[k][1] - groups[k][0] for k in near]
    start, lead = groups[i][0], text[groups[i][0] - 1 : groups[i][0]]
    if lead == "+" and sizes[0] <= 3:
        n = 1
        while n < len(sizes) and sizes[n] <= 5 and text[groups[near[n]][0] - 1] != "+":
            n += 1
        return n if n > 1 and 7 <= sum(sizes[:n]) <= 15 else 0
    if lead == "(" and text[groups[i][1] : groups[i][1] + 1] == ")" and 2 <= sizes[0] <= 5:
        for n in (3, 2):
            if len(sizes) >= n and 6 <= sum(sizes[1:n]) <= 8 and all(3 <= x <= 4 or n == 2 for x in sizes[1:n]):
                return n
        return 0
    if len(sizes) >= 3 and (text[start] == "0" and 2 <= sizes[0] <= 5 and 3 <= sizes[1] <= 4 and 3 <= sizes[2] <= 4 or sizes[:3] == [3, 3, 4]):
        return 3
    return 0


def phones(text: str, _: list[Word]) -> Found:
    for run in DIGIT_RUN.finditer(text):
        groups = [(run.start() + g.start(), run.start() + g.end()) for g in GROUP.finditer(run.group())]
        i = 0
        while i < len(groups):
            n = _dialled(text, groups, i)
            first, last = groups[i][0], groups[i + max(n, 1) - 1][1]
            opened = text[first - 1 : first] in ("+", "(") and first > 0
            before = text[first - 1 - opened : first - opened] if first > opened else ""
            after = text[last : last + 2]
            if n and before not in (".", ",") and not (before.isdigit() or before.isalpha()) and not (after[:1] in (".", ",") and after[1:].isdigit()) and not after[:1].isalpha():
                yield first - opened, last
                i += n
            else:
                i += 1


def _symbol(s: str) -> bool:
    name, _, venue = s.partition(".")
    return 1 <= len(name) <= 6 and name.isascii() and name.isalpha() and name.isupper() and (not venue or len(venue) <= 2 and venue.isupper())


def tickers(text: str, words: list[Word]) -> Found:
    for i, w in enumerate(words):
        exchange, mark, symbol = w.text.partition(":")
        if exchange in EXCHANGES and mark and _symbol(symbol):
            yield w.end - len(symbol), w.end
        elif w.text in EXCHANGES and w.after == ":" and i + 1 < len(words) and _symbol(words[i + 1].text):
            yield words[i + 1].start, words[i + 1].end


def _capital(w: Word) -> bool:
    return w.text[0].isupper() or w.text[0].isdigit() and any(c.isupper() for c in w.text)


def codenames(text: str, words: list[Word]) -> Found:
    fits = lambda w: w.text[0].isupper() and len(w.text) >= 3 and all(c.isalnum() or c in "'’-" for c in w.text)
    for i, w in enumerate(words[:-1]):
        if w.bare in CUES and not w.after and fits(words[i + 1]):
            second = i + 2 < len(words) and not words[i + 1].after and fits(words[i + 2])
            yield words[i + 1].start, words[i + 1 + second].end


def _name(w: Word) -> bool:
    plain = len(w.text) > 1 and w.text[0].isupper() and any(c.islower() for c in w.text) and all(c.isalpha() or c in "'’-" for c in w.text)
    return plain and w.text not in ROLES and w.text not in RANKS and w.text not in TITLES and w.bare not in CUES and w.bare not in SMALL_WORDS and w.bare not in COMPANY_FORMS


def _name_length(words: list[Word], i: int) -> int:
    """Words of a name that begins at i: up to four capitalised ones, particles and initials between them."""
    if not _name(words[i]):
        return 0
    j, parts = i + 1, 1
    while parts < 4 and not words[j - 1].after:
        k = j
        while k < len(words) and k - j < 3 and (words[k].text in PARTICLES and not words[k].after or len(words[k].text) == 1 and words[k].text.isupper() and words[k].after in ("", ".")):
            k += 1
        if k == len(words) or not _name(words[k]):
            break
        j, parts = k + 1, parts + 1
    return j - i


def people(text: str, words: list[Word]) -> Found:
    """A name behind a title; a name of two words or more beside a role, or before a verb of saying."""
    i = 0
    while i < len(words):
        n = _name_length(words, i)
        if n:
            before, last = words[i - 1] if i else None, words[i + n - 1]
            then = words[i + n] if i + n < len(words) else None
            titled = before is not None and before.text in TITLES and before.after in ("", ".")
            behind_role = before is not None and before.text in ROLES and before.after in ("", ",", ":")
            before_role = then is not None and last.after == "," and (then.text in ROLES or then.text in RANKS)
            speaks = then is not None and not last.after and then.text in SAYING
            if titled or n > 1 and (behind_role or before_role or speaks):
                yield words[i].start, last.end
        i += max(n, 1)


def companies(text: str, words: list[Word]) -> Found:
    """Capitalised words, joined by & or of, up to a legal form or a word for one. A stop ends a name, but in a short form."""
    form = lambda w: w.text[0].isupper() and w.bare.replace(".", "") in COMPANY_FORMS
    joins = lambda w: w.text in ("&", "of", "the", "de", "di")
    for i, w in enumerate(words):
        if not form(w) or not w.after and i + 1 < len(words) and form(words[i + 1]):
            continue
        j = i
        while j > 0 and not words[j - 1].after and (_capital(words[j - 1]) and words[j - 1].text not in ROLES and words[j - 1].text not in TITLES or joins(words[j - 1])):
            j -= 1
        while j < i and (words[j].bare in SMALL_WORDS or joins(words[j]) or words[j].text in RANKS):
            j += 1
        if j < i:
            yield words[j].start, w.end


def addresses(text: str, words: list[Word]) -> Found:
    for i, w in enumerate(words):
        digits = w.text[:-1] if w.text[-1].isalpha() else w.text
        if w.after or not (1 <= len(digits) <= 5 and digits.isascii() and digits.isdigit()):
            continue
        for n in range(1, 6):
            if i + n >= len(words) or not words[i + n].text[0].isupper() or n > 1 and words[i + n - 1].after:
                break
            if n > 1 and words[i + n].text in STREETS:
                yield w.start, words[i + n].end
                break


def postcodes(text: str, words: list[Word]) -> Found:
    for i, w in enumerate(words):
        area, dash, plus = w.text.partition("-")
        if dash and len(area) == 5 and len(plus) == 4 and GROUP.fullmatch(area + plus):
            yield w.start, w.end
        elif len(w.text) >= 5 and OUTWARD.fullmatch(w.text[:-3]) and INWARD.fullmatch(w.text[-3:]):
            yield w.start, w.end
        elif i + 1 < len(words) and not w.after and OUTWARD.fullmatch(w.text) and INWARD.fullmatch(words[i + 1].text):
            yield w.start, words[i + 1].end


DETECTORS = {"email": emails, "url": urls, "path": paths, "phone": phones, "ticker": tickers, "handle": handles, "company": companies, "codename": codenames, "person": people, "address": addresses, "postcode": postcodes}
WORDLESS = frozenset(("email", "handle", "phone"))


def spans_of(text: str, kinds: tuple[str, ...]) -> list[dict]:
    words = [] if WORDLESS.issuperset(kinds) else words_of(text)
    return [{"kind": k, "start": a, "end": b, "text": text[a:b]} for k in kinds for a, b in DETECTORS[k](text, words)]
