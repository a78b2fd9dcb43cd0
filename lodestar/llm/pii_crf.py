"""Personal data by a semi-Markov conditional random field over candidate segments.

A region is cut into segments: single tokens that are nothing, numbers of up to 24 tokens
or addresses of any of their shorter forms, each with a kind. Numbers and addresses that
overlap are in one region, so one cut decides between them. Features of a whole span (its digits, groups and marks, check digit,
what stands beside it) score each kind; dynamic programming over the ends of segments, each
at most the bound long, picks the boundaries and kinds of the best cut together.

The weights are fitted to the conditional likelihood of cuts by the base spans, on regions
of a bounded sample of documents and on rewritten copies of the base spans found there (other
separators, written-out signs), which is how the field learns forms that no base pattern
has. Base spans always stay; the field adds spans that overlap none of them. A sample without
base spans adds nothing. A null or empty text has no spans; repeated rows are treated alike.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.personal_spans import ADDRESS_MARK, KINDS, Region, Span, base_spans, digits_of, regions, written
from lodestar.llm.text import per_document, slices, text_bytes

# Regions that the weights are fitted on, documents looked at for each, characters kept
# around a region and of the region itself.
SAMPLE = 400
_LOOKED_AT = 40
_AROUND = 60
_LEARNED = 400

_TRIGGER = np.zeros(256, bool)
_TRIGGER[list(b"0123456789@")] = True


@dataclass
class SpanField:
    """Weights of (kind, feature) pairs."""

    weights: dict[tuple[int, str], float] = field(default_factory=dict)
    bias: float = -4.0

    def score(self, kinds: tuple[int, ...], names: list[str]) -> list[float]:
        """The score of each kind of a candidate."""
        get = self.weights.get
        return [self.bias + sum(get((k, f), 0.0) for f in names) for k in kinds]

    def best(self, region: Region) -> list[Span]:
        """The segments of the best cut, as spans of the text."""
        n = len(region.edges) - 1
        value, back = [-1.0] * (n + 1), [None] * (n + 1)
        value[0], done = 0.0, 0

        def settle(until: int) -> None:
            # a token that is nothing, unless a candidate that ends there does better
            for at in range(done + 1, until + 1):
                if value[at - 1] >= value[at]:
                    value[at], back[at] = value[at - 1], None

        for i, j, kinds, names in region.segments():
            settle(i)
            done = max(done, i)
            scores = self.score(kinds, names)
            top = max(range(len(kinds)), key=scores.__getitem__)
            if scores[top] > 0 and value[i] + scores[top] > value[j]:
                value[j], back[j] = value[i] + scores[top], (i, kinds[top])
        settle(n)
        spans, j = [], n
        while j:
            if back[j]:
                i, kind = back[j]
                spans.append((region.edges[i], region.edges[j], kind))
                j = i
            else:
                j -= 1
        return spans[::-1]

    def expected(self, n: int, segments: list[tuple]) -> list[list[float]]:
        """The probability of each candidate and kind over n tokens, by forward and backward sums."""
        scores = [self.score(kinds, names) for _, _, kinds, names in segments]
        ending: list[list] = [[] for _ in range(n + 1)]
        starting: list[list] = [[] for _ in range(n + 1)]
        for c, (i, j, _, _) in enumerate(segments):
            total = float(np.logaddexp.reduce(scores[c]))
            ending[j].append((i, total))
            starting[i].append((j, total))
        forward, backward = np.zeros(n + 1), np.zeros(n + 1)
        for j in range(1, n + 1):
            forward[j] = np.logaddexp.reduce([forward[j - 1], *[forward[i] + s for i, s in ending[j]]])
        for i in range(n - 1, -1, -1):
            backward[i] = np.logaddexp.reduce([backward[i + 1], *[backward[j] + s for j, s in starting[i]]])
        return [
            [float(np.exp(min(0.0, forward[i] + s + backward[j] - forward[n]))) for s in scores[c]]
            for c, (i, j, _, _) in enumerate(segments)
        ]


def fit(examples: list[tuple[Region, set[Span]]], rounds: int = 25, rate: float = 0.4, shrink: float = 1e-3) -> SpanField:
    """Climb the conditional likelihood of the wanted spans, one region at a time."""
    model = SpanField()
    squares: dict[tuple[int, str], float] = {}
    listed = [(region.edges, list(region.segments()), wanted) for region, wanted in examples]
    for _ in range(rounds):
        for edges, segments, wanted in listed:
            chances = model.expected(len(edges) - 1, segments)
            for (i, j, kinds, names), chance in zip(segments, chances, strict=True):
                for k, p in zip(kinds, chance, strict=True):
                    gap = ((edges[i], edges[j], k) in wanted) - p
                    if abs(gap) < 1e-3:
                        continue
                    for name in names:
                        key = (k, name)
                        step = gap - shrink * model.weights.get(key, 0.0)
                        squares[key] = squares.get(key, 1.0) + step * step
                        model.weights[key] = model.weights.get(key, 0.0) + rate * step / squares[key] ** 0.5
    return model


def _variants(text: str, span: Span) -> list[tuple[str, Span]]:
    """The surroundings of a base span with the span written in other ways."""
    start, end, kind = span
    value = text[start:end]
    digits = digits_of(value)
    if kind == 0:
        local, _, domain = value.partition("@")
        forms = [f"{local}{at}{domain.replace('.', dot)}" for at, dot in (("(at)", "."), ("[at]", "[dot]"), (" at ", " dot "), ("@", " dot "))]
    elif kind == 2:
        forms = ["/".join(digits[i : i + 4] for i in range(0, len(digits), 4)), ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))]
    elif kind == 3 and len(digits) >= 10:
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        forms = [f"({a}) {b}-{c}", f"({a}){b}-{c}", f"({a}) {b}.{c}", f"+{digits[:-10] or 1}/{a}/{b}{c}"]
    else:
        forms = []
    before, after = text[max(0, start - _AROUND) : start], text[end : end + _AROUND]
    return [(before + f + after, (len(before), len(before) + len(f), kind)) for f in forms]


def examples_from(texts: list[str]) -> list[tuple[Region, set[Span]]]:
    """Regions of the texts and of rewritten base spans, with the spans wanted in them."""
    out = []
    for text in texts:
        spans = base_spans(text)
        out += [(r, set(spans)) for r in regions(text)]
        for span in spans:
            for changed, wanted in _variants(text, span):
                out += [(r, {wanted, *base_spans(changed)}) for r in regions(changed)]
    return out


def fit_pii_field(docs: DataFrame, sample: int = SAMPLE) -> SpanField:
    """Fit on the surroundings of at most ``sample`` regions with digits or at-signs.

    They come from about 40 times as many documents, chosen by a hash of ``doc_id``; of a
    region longer than 400 characters the first 400 are learned from. Regions with a base
    span of each kind, and those without one, get an equal share of the sample.
    """
    share = min(1.0, _LOOKED_AT * sample / max(docs.count(), 1))
    chosen = docs.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            places, cuts, kinds = [], [], []
            for row, text in _suspects(part.column(1)):
                base = base_spans(text)
                starts = [s for s, _, _ in base]
                for match in regions(text):
                    low, high = match.edges[0], min(match.edges[-1], match.edges[0] + _LEARNED)
                    cuts.append(text[max(0, low - _AROUND) : high + _AROUND])
                    inside = base[bisect_left(starts, low) : bisect_left(starts, high)]
                    kinds.append(inside[0][2] if inside else len(KINDS))
                    places.append(row)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(places, pa.int64())), pa.array(cuts, pa.string()), pa.array(kinds, pa.int32())],
                names=["doc_id", "cut", "kind"],
            )

    cuts = chosen.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, cut string, kind int")
    # the least hashes of each kind: a bounded sample, the same on any cluster
    order = Window.partitionBy("kind").orderBy(F.xxhash64("doc_id", "cut"), "cut")
    rows = cuts.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample // (len(KINDS) + 1)).collect()
    return fit(examples_from(sorted(r["cut"] for r in rows)))


def _suspects(column: pa.Array) -> list[tuple[int, str]]:
    """The texts with a digit or with what every address holds, and their rows."""
    data, offsets = text_bytes(column)
    marked = per_document(_TRIGGER[data], offsets) > 0
    raw = data.tobytes()
    for match in ADDRESS_MARK.finditer(raw):
        marked[int(np.searchsorted(offsets, match.start(), "right")) - 1] = True
    return [(int(r), raw[offsets[r] : offsets[r + 1]].decode()) for r in np.flatnonzero(marked)]


def all_spans(text: str, model: SpanField) -> tuple[list[Span], list[Span]]:
    """The base spans, and those with the spans that the field adds."""
    base = base_spans(text)
    added = [
        s for region in regions(text) for s in model.best(region)
        if not any(s[0] < b[1] and b[0] < s[1] for b in base)
    ]
    kept: list[Span] = []
    for span in sorted(set(added)):
        if not kept or span[0] >= kept[-1][1]:
            kept.append(span)
    return base, sorted([*base, *kept], key=lambda s: (s[0], s[2]))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


RESULT = ", ".join([*[f"n_{k} long" for k in KINDS], "base_sha256 string", "spans string"])


def find_personal_data(docs: DataFrame, model: SpanField, text: str = "text") -> DataFrame:
    """Add ``pii``, a struct of counts of base spans, their digest, all spans and the masked text."""
    kept = [c for c in docs.columns if c != "pii"]
    names = [f"c{i}" for i in range(len(kept))]
    source = names[kept.index(text)]
    flat = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)])
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, source):
            n, column = part.num_rows, part.column(names.index(source))
            counts = np.zeros((len(KINDS), n), np.int64)
            digest, spans = [nothing] * n, [""] * n
            clean: list[str | None] = [None] * n
            for row, value in _suspects(column):
                base, every = all_spans(value, model)
                for _, _, kind in base:
                    counts[kind, row] += 1
                if every:
                    digest[row] = hashlib.sha256(written(base).encode()).hexdigest()
                    spans[row], clean[row] = written(every), masked(value, every)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *[pa.array(c) for c in counts], pa.array(digest), pa.array(spans), pa.array(clean, pa.string())],
                names=[*names, *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "masked"],
            )

    schema = ", ".join(f"{n} {t}" for n, t in flat.dtypes) + f", {RESULT}, masked string"
    fields = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans"]
    found = F.struct(*fields, F.coalesce("masked", source).alias("masked"))
    return flat.mapInArrow(run, schema).select(
        *[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], found.alias("pii")
    )
