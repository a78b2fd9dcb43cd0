"""Word finding, suffix repetition, encoders, packing and wavelet matrices on small inputs."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lodestar.llm.boosting import BoostedTrees, isotonic
from lodestar.llm.packing import pieces, schedule
from lodestar.llm.quality_rules import RepetitionLimits, measure
from lodestar.llm.sentence_pieces import PieceTable, SentencePieces, viterbi_rows
from lodestar.llm.text import column_words, running, slices
from lodestar.llm.wavelet import WaveletMatrix
from lodestar.llm.word_ids import WordEncoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(parts, n, most, seed):
    rng = random.Random(seed)
    return [None, "", " ", "\n", *["".join(rng.choice(parts) for _ in range(rng.randint(0, most))) for _ in range(n)]]


def test_words_match_the_pattern():
    rows = texts(["a", "é", "日本", " ", "\n", "\t", "\x0b", "\x1c", "b "], 200, 30, 1)
    words = column_words(pa.array(rows))
    raw = words.data.tobytes()
    for i, text in enumerate(rows):
        found = [raw[words.start[w] : words.end[w]].decode() for w in range(words.first[i], words.first[i + 1])]
        assert found == WORD.findall(text or "")


def test_equal_words_have_equal_hashes_and_others_not():
    words = column_words(pa.array(["ab ba ab b", "ab\nabc a"]))
    raw, hashes = words.data.tobytes(), words.hashes()
    seen = {}
    for s, e, h in zip(words.start, words.end, hashes, strict=True):
        assert seen.setdefault(raw[s:e], h) == h
    assert len(set(seen.values())) == len(seen)


def test_slices_cover_sliced_batches_once():
    batch = pa.record_batch([pa.array(["x" * n for n in range(50)])], names=["text"]).slice(7, 30)
    got = [t for part in slices(iter([batch]), "text", 60) for t in part.column(0).to_pylist()]
    assert got == ["x" * n for n in range(7, 37)]


def brute_repetition(text, least):
    words = WORD.findall(text or "")
    n = len(words)

    def in_repeats(k):
        runs = Counter(tuple(words[i : i + k]) for i in range(n - k + 1))
        return len({j for i in range(n - k + 1) if runs[tuple(words[i : i + k])] > 1 for j in range(i, i + k)})

    longest = 0
    for k in range(1, n + 1):
        if max(Counter(tuple(words[i : i + k]) for i in range(n - k + 1)).values()) < 2:
            break
        longest = k
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": in_repeats(3),
        "n_covered_words": in_repeats(least), "longest_repeat": longest,
    }


def test_repetition_matches_brute_force():
    rows = texts(["a ", "b ", "é ", "c\n", "\n", "a\t", "#"], 250, 90, 2) + ["a " * 40, "x y z " * 20 + "q"]
    limits = RepetitionLimits(least_words=5, most_covered=0.4, longest=30)
    found = measure(pa.array(rows), limits)
    for i, text in enumerate(rows):
        want = brute_repetition(text, 5)
        assert {k: int(found[k][i]) for k in want} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        over = want["n_covered_words"] > 0.4 * want["n_words"] or want["longest_repeat"] > 30
        assert found["base_failed"][i] == failed and found["kept"][i] == (not failed and not over)


@pytest.fixture(scope="module")
def word_encoder():
    return WordEncoder(public_tokenizers.path("word_bpe_49k.json"))


def test_word_ids_match_the_tokenizer(word_encoder):
    parts = ["a", "É", "é", "ü", "Ä", "ñ", "é", " ", "\n", "1", "'s", "'LL", "#", "$$", "ß", "　", "ﬁ", "日", "İ"]
    rows = [*texts(parts, 600, 40, 3), "<|endoftext|>x a<|startoftext|>", "́a é x\x1cy 👍🏽", "a" * 3000]
    ids, counts = word_encoder.encode(pa.array(rows))
    at = running(counts)
    for i, text in enumerate(rows):
        want = word_encoder._whole.encode(text or "", add_special_tokens=False).ids
        assert ids[at[i] : at[i + 1]].tolist() == want


@pytest.fixture(scope="module")
def piece_encoder():
    return SentencePieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_sentence_pieces_match_the_library_and_come_back(piece_encoder):
    parts = ["a", "the", "é", " ", "  ", "\n", "\t", "ing", "#", "ß", "日", "👍", "1", "24"]
    rows = [*texts(parts, 800, 30, 4), "a" * 500 + " b", " " * 70 + "x", "<s> </s> <0x41> x"]
    ids, counts = piece_encoder.encode(pa.array(rows))
    at = running(counts)
    back = piece_encoder.decode(ids.astype(np.int64), counts)
    for i, text in enumerate(rows):
        assert ids[at[i] : at[i + 1]].tolist() == piece_encoder._library.encode(text or "")
        assert back[i].decode() == (text or "")


def test_viterbi_finds_the_best_sum_of_scores():
    rng = np.random.default_rng(5)
    pieces_ = sorted({"".join(rng.choice(list("abc"), rng.integers(1, 5))) for _ in range(40)} | {"a", "b"})
    scores = -rng.random(len(pieces_)) * 10
    table = PieceTable(pieces_, np.arange(len(pieces_)), scores)
    known = dict(zip(pieces_, scores, strict=True))
    words = ["".join(rng.choice(list("abc"), 9)) for _ in range(60)]
    matrix = np.array([[ord(c) for c in w] for w in words], np.uint32)
    edges, count = viterbi_rows(matrix, table, -50.0)

    def best(word):
        sums = [0.0]
        for j in range(1, len(word) + 1):
            sums.append(max(
                sums[i] + known.get(word[i:j], -50.0 if j - i == 1 else -np.inf) for i in range(j)
            ))
        return sums[-1]

    for word, row, n in zip(words, edges, count, strict=True):
        cuts = [*row[:n].tolist(), len(word)]
        got = sum(known.get(word[a:b], -50.0) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        assert got == pytest.approx(best(word))


@pytest.mark.parametrize("trial", range(60))
def test_packing_places_every_token_once(trial):
    rng = np.random.default_rng(trial)
    window = int(rng.choice([64, 256, 4096]))
    totals = rng.integers(0, 4000, rng.integers(1, 8))
    weights = rng.random(len(totals)).tolist() if trial % 2 else None
    if weights is None:
        totals = np.maximum(totals, int(totals.sum()) // (window // 4) + 1)
    if not totals.sum():
        return
    queue, place, length = [], [], []
    for q, total in enumerate(totals.tolist()):
        at = 0
        while at < total:
            size = min(int(rng.integers(1, 300)), total - at)
            queue.append(q), place.append(at), length.append(size)
            at += size
    plan = schedule(totals.tolist(), weights, window)
    found = pieces(plan, np.array(queue), np.array(place), np.array(length))
    assert np.bincount(found["row"], found["length"], len(length)).astype(int).tolist() == length
    order = np.lexsort((found["offset"], found["sequence_id"]))
    sequence, offset, size = (found[k][order] for k in ("sequence_id", "offset", "length"))
    opens = np.r_[True, sequence[1:] != sequence[:-1]]
    assert (offset == np.where(opens, 0, np.r_[0, (offset + size)[:-1]])).all()
    sums = np.bincount(sequence, size).astype(int)
    full = int(totals.sum()) // window
    assert (sums[:full] == window).all() and all(s & (s - 1) == 0 and s for s in sums[full:].tolist())


def test_packing_keeps_wanted_shares_until_a_queue_is_dry():
    plan = schedule([40_960, 409_600], [1.0, 1.0])
    assert [plan.queue_given(np.array([20]), np.array([q]))[0] for q in (0, 1)] == [40_960, 40_960]
    half = plan.queue_given(np.array([7]), np.array([0]))[0]
    assert abs(half - 7 * 2048) <= 1


@pytest.mark.parametrize("n", [0, 1, 7, 8, 511, 512, 513, 3000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 50_000, n).astype(np.uint32)
    ids[::3] = 7
    matrix = WaveletMatrix.from_bytes(WaveletMatrix.build(ids).to_bytes())
    assert (matrix.tokens() == ids).all()
    if n:
        at = rng.integers(0, n, 40)
        assert (matrix.access(at) == ids[at]).all()
    for value in {7, 49_999, 1 << 20, *ids[:2].tolist()}:
        places = np.flatnonzero(ids == value).tolist()
        assert matrix.count(value) == len(places)
        assert [matrix.select(value, k) for k in range(min(5, len(places)))] == places[:5]
        assert matrix.select(value, len(places)) == -1
        assert [matrix.rank(value, e) for e in (0, n // 2, n)] == [int((ids[:e] == value).sum()) for e in (0, n // 2, n)]


def test_isotonic_and_trees():
    rng = np.random.default_rng(6)
    x = rng.random((600, 4))
    y = ((x[:, 0] > 0.6) ^ (rng.random(600) < 0.02)).astype(float)
    margins = BoostedTrees().fit(x, y).margins(x)
    assert ((margins > 0) == (x[:, 0] > 0.6)).mean() > 0.97
    points, values = isotonic(margins, y)
    assert (np.diff(points) >= 0).all() and (np.diff(values) >= 0).all()
    assert values.min() >= 0 and values.max() <= 1
    # pooled means keep the sum
    fitted = np.interp(margins, points, values)
    assert fitted.sum() == pytest.approx(y.sum(), rel=0.05)


