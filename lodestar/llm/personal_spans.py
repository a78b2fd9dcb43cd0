"""Spans of personal data that patterns find for certain, and candidates around them.

A text is only looked at near digits, at-signs and written-out at-signs. ``base_spans``
gives the leftmost non-overlapping matches of each kind; all scans are linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, end, index of the kind


def digits_of(text: str) -> str:
    """The ASCII digits of a text."""
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) * (1 + place % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def byte_part(part: str) -> bool:
    """Whether digits make a number up to 255."""
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """All base matches, by start and then kind."""
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append((start, free, 0))
        at = text.find("@", max(free, at + 1))
    for match in _DOTTED.finditer(text):
        runs = match[0].split(".")
        start = match.start()
        for k in range(0, len(runs) - 3, 4):
            four = runs[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(map(byte_part, four)):
                found.append((start, end, 1))
            start = end + 1
    for match in _GROUPED.finditer(text):
        if match.end() - match.start() >= 14:
            digits = digits_of(match[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*match.span(), 2))
    for match in _PLUS.finditer(text):
        if 10 <= len(digits_of(match[0])) <= 15:
            found.append((*match.span(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def written(spans: list[Span]) -> str:
    """Spans as kind:start:end, joined by commas."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


# Candidate segments: runs of number tokens, and addresses with a written-out at-sign.
_NUMBERS = re.compile(r"[+(]?[0-9][0-9 ().+/\-]*[0-9]")
_TOKEN = re.compile(r"[0-9]+|[^0-9]")
_ADDRESS = re.compile(
    r"[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63} ?(?:@|\(at\)|\[at\]| at ) ?"
    r"[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63}){1,5}",
    re.IGNORECASE,
)
MOST_TOKENS = 24
# Where an address can begin or end inside its widest form.
_LOCAL_BREAK = re.compile(r"[._%+-](?=[A-Za-z0-9_%+-])")
_DOT = re.compile(r" ?(?:\.|\(dot\)|\[dot\]| dot ) ?", re.IGNORECASE)
_AT = re.compile(r" ?(?:@|\(at\)|\[at\]| at ) ?", re.IGNORECASE)
# What every address holds from its at-sign on, for finding the texts that may have one.
ADDRESS_MARK = re.compile(
    rb"(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63} ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]", re.IGNORECASE
)


@dataclass
class Region:
    """A stretch of text with the edges of its tokens, and where its candidates come from.

    Numbers and addresses that overlap share a region, so one cut decides between them.
    """

    text: str
    edges: list[int]
    numbers: list[tuple[int, int]]
    addresses: list[tuple[list[int], list[int]]]  # the places where one may start, and end

    def segments(self) -> Iterator[tuple[int, int, tuple[int, ...], list[str]]]:
        """Candidates as (first edge, last edge, kinds, features), by first edge.

        They are made one by one, so a stretch may be of any length.
        """
        text, edges = self.text, self.edges
        place = {e: i for i, e in enumerate(edges)} if self.addresses else {}
        ends_by_start: dict[int, list[int]] = {}
        for starts, ends in self.addresses:
            for a in starts:
                ends_by_start.setdefault(a, []).extend(ends)
        spans, at = [*self.numbers, (len(text) + 1, len(text) + 1)], 0
        for i, a in enumerate(edges[:-1]):
            while a >= spans[at][1]:
                at += 1
            if a >= spans[at][0] and (text[a].isdigit() or text[a] in "+("):
                for j in range(i + 1, min(i + MOST_TOKENS, len(edges) - 1) + 1):
                    b = edges[j]
                    if b > spans[at][1]:
                        break
                    if text[b - 1].isdigit() and b - a >= 7:
                        if sum(c.isdigit() for c in text[a:b]) > 19:
                            break
                        yield i, j, (1, 2, 3), number_features(text, a, b)
            for b in ends_by_start.get(a, ()):
                yield i, place[b], (0,), address_features(text, a, b)


def _side(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "none"
    c = text[at]
    return "space" if c.isspace() else "letter" if c.isalpha() else "digit" if c.isdigit() else c


def number_features(text: str, start: int, end: int) -> list[str]:
    """Features of a whole candidate number."""
    span = text[start:end]
    groups = re.findall("[0-9]+", span)
    digits = "".join(groups)
    marks = "".join(sorted(set(re.sub("[0-9]", "", span))))
    shape = "-".join(str(min(len(g), 9)) for g in groups[:6])
    out = [
        f"n{min(len(digits), 20)}", f"groups{min(len(groups), 6)}", f"marks{marks}", f"shape{shape}",
        f"left{_side(text, start - 1)}", f"right{_side(text, end)}",
        f"plus{span[0] == '+'}n{10 <= len(digits) <= 15}",
    ]
    if 13 <= len(digits) <= 19:
        out.append(f"luhn{luhn(digits)}")
    if len(groups) == 4:
        out.append(f"bytes{all(map(byte_part, groups))}marks{marks}")
    return out


def address_features(text: str, start: int, end: int) -> list[str]:
    """Features of a whole candidate address."""
    span = text[start:end].lower()
    mark = next(m for m in ("@", "(at)", "[at]", " at ") if m in span)
    local, _, domain = span.partition(mark)
    dotted = re.split(r" ?(?:\(dot\)|\[dot\]| dot |\.) ?", domain.strip())
    last = dotted[-1]
    return [
        f"at{mark}", f"dot{next((m for m in ('(dot)', '[dot]', ' dot ') if m in domain), '.')}",
        f"top{min(len(last), 6)}{last.isalpha()}", f"labels{min(len(dotted), 4)}",
        f"local{min(len(local.strip()), 3)}", f"gap{' ' in domain.strip()}",
        f"left{_side(text, start - 1)}", f"right{_side(text, end)}",
    ]


def _address(text: str, start: int, end: int) -> tuple[list[int], list[int]]:
    """Where addresses inside the widest one may start and end."""
    mark = _AT.search(text, start, end)
    starts = [start, *[m.end() for m in _LOCAL_BREAK.finditer(text, start, mark.start())]]
    dots = [m.start() for m in _DOT.finditer(text, mark.end(), end)]
    return starts, [*dots[1:], end]


def regions(text: str) -> list[Region]:
    """Stretches with candidates, in order and apart from each other."""
    found = [(*m.span(), True) for m in _NUMBERS.finditer(text) if m.end() - m.start() >= 7]
    found += [(*m.span(), False) for m in _ADDRESS.finditer(text)]
    out: list[Region] = []
    stop = -1
    groups: list[list[tuple[int, int, bool]]] = []
    for span in sorted(found):
        if span[0] >= stop:
            groups.append([])
        groups[-1].append(span)
        stop = max(stop, span[1])
    for group in groups:
        begin, end = group[0][0], max(b for _, b, _ in group)
        edges = [t.start() + begin for t in _TOKEN.finditer(text[begin:end])] + [end]
        numbers = [(a, b) for a, b, number in group if number]
        addresses = [_address(text, a, b) for a, b, number in group if not number]
        if addresses:
            # an address may begin or end inside a run of digits
            edges = sorted({*edges, *(p for starts, ends in addresses for p in (*starts, *ends)), *(p for n in numbers for p in n)})
        out.append(Region(text, edges, numbers, addresses))
    return out
