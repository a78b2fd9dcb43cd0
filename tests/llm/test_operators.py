"""Operators on odd rows against brute force; every case has a defined result."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from odd_rows import SCHEMA, frame, prose, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from lodestar.llm.components import connected_components
from lodestar.llm.line_dedup import dedup_lines, line_digests
from lodestar.llm.near_duplicates import near_duplicate_classes
from lodestar.llm.neighbours import CentroidGraph, ListSettings, balanced_centroids, nearest_by_lists, query_ratio
from lodestar.llm.packing import pack
from lodestar.llm.personal_spans import KINDS, base_spans, luhn, regions, written
from lodestar.llm.pii_crf import SpanField, all_spans, find_personal_data, fit_pii_field
from lodestar.llm.quality_rules import score_quality
from lodestar.llm.sentence_pieces import encode_and_decode, sentence_pieces
from lodestar.llm.substrings import remove_repeats
from lodestar.llm.toxicity import fit_toxicity, score_toxicity
from lodestar.llm.wavelet import id_counts, read_token_shards, write_token_shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text):
    from lodestar.llm.word_ids import encoder

    return [*encoder(TOKENIZER)._whole.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# quality rules


def test_quality_keeps_all_columns(docs, none):
    out = score_quality(docs)
    assert out.columns == [*SCHEMA.names, "quality"]
    found = [(r["doc_id"], r["quality"]) for r in out.collect()]
    assert len(found) == len(rows())
    by_id = dict(found)
    assert by_id[17]["n_words"] == by_id[18]["n_words"] == 0 and not by_id[17]["kept"]
    assert by_id[24]["base_failed"] and by_id[23]["n_words"] == 1
    assert score_quality(none).count() == 0


# substrings


def brute_substrings(data, length):
    first = {}
    for i, text, *_ in data:
        words = WORD.findall(text or "")
        if i is not None:
            for k in range(len(words) - length + 1):
                key = tuple(words[k : k + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text, *_ in data:
        words = WORD.findall(text or "")
        gone = set()
        if i is not None:
            for k in range(len(words) - length + 1):
                if first[tuple(words[k : k + length])] < i:
                    gone.update(range(k, k + length))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_substrings_match_brute_force(docs, none):
    found = Counter(map(tuple, remove_repeats(docs).collect()))
    assert found == brute_substrings(rows(), 50)
    assert sum(n for (_, _, gone, _), n in found.items() if gone) >= 4
    assert remove_repeats(none).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_of_few_words(spark, seed):
    rng = random.Random(seed)
    stock = [" ".join(rng.choice("ab") for _ in range(80)) for _ in range(4)]
    data = []
    for i in range(30):
        cut = rng.choice(stock).split()
        at = rng.randint(0, 20)
        body = cut[at : at + rng.randint(30, 60)] + [rng.choice("xyz") for _ in range(rng.randint(0, 9))]
        data.append((i, " ".join(body), *[None] * 7))
    found = Counter(map(tuple, remove_repeats(frame(spark, data), length=40).collect()))
    assert found == brute_substrings(data, 40)


# lines


def brute_lines(data, min_chars=20, min_words=8):
    order = sorted({(i is not None, i, t) for i, t, *_ in data if t is not None}, key=lambda r: (r[0], r[1] or 0, hash(r[2])))
    whole, cut, place = {}, defaultdict(list), {}
    at = 0
    for _, i, text in order:
        for k, line in enumerate(text.split("\n")):
            words = tuple(WORD.findall(line))
            at += 1
            place[i, text, k] = at
            if len(line) < min_chars or not words:
                continue
            whole.setdefault(words, at)
    firsts = {w: p for w, p in whole.items() if len(w) >= min_words}

    def apart(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    del cut
    out = []
    for i, text, *_ in data:
        lines = [] if text is None else text.split("\n")
        kept = []
        for k, line in enumerate(lines):
            words = tuple(WORD.findall(line))
            goes = False
            if len(line) >= min_chars and words:
                goes = whole[words] < place[i, text, k]
                if not goes and len(words) >= min_words:
                    goes = any(p < whole[words] and apart(words, w) for w, p in firsts.items())
            if not goes:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return Counter(out)


def test_lines_match_brute_force(docs, none):
    out = dedup_lines(docs)
    assert out.columns == [*SCHEMA.names, "n_lines", "n_removed", "kept_text"]
    found = Counter(map(tuple, out.select("doc_id", "n_lines", "n_removed", "kept_text").collect()))
    assert found == brute_lines(rows())
    digests = {
        (r[0], r[1], r[2], hashlib.sha256((r[3] or "").encode()).hexdigest()): n for r, n in found.items()
    }
    assert Counter(map(tuple, line_digests(docs).collect())) == Counter(digests)
    assert dedup_lines(none).count() == line_digests(none).count() == 0


def test_near_lines_of_few_words(spark):
    rng = random.Random(3)
    data = []
    for i in range(60):
        data.append((i, "\n".join(" ".join(rng.choice(["aaa", "bbb"]) for _ in range(rng.randint(7, 9))) for _ in range(2)), *[None] * 7))
    found = dedup_lines(frame(spark, data)).select("doc_id", "n_lines", "n_removed", "kept_text")
    assert Counter(map(tuple, found.collect())) == brute_lines(data)


def brute_every_line(data):
    """Kept texts by id when every line with a word counts, of texts without nulls or copies."""

    def form(line):
        words = tuple(WORD.findall(line))
        joined = " ".join(words)
        units = words if len(words) >= 8 else joined if len(joined.encode()) >= 20 else None
        return words, units

    def apart(a, b):
        if type(a) is not type(b) or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    seen, out = {}, {}
    for i, text, *_ in sorted(data):
        kept = []
        for line in text.split("\n"):
            words, units = form(line)
            again = words in seen or units is not None and any(apart(units, u) for u in seen.values() if u is not None)
            if not words or not again:
                kept.append(line)
            if words:
                seen.setdefault(words, units)
        out[i] = "\n".join(kept)
    return out


def test_pipeline_compares_every_line(spark):
    rng = random.Random(5)
    short = ["Home | About | Contact", "Read  more", "By Jane", "}", "--- \t", "次の記事", "w1 w2 w3 w4 w5 w6 w7 w8 w9"]
    chinese = "".join(chr(0x4E00 + rng.randrange(500)) for _ in range(60))
    spaced = "a b c d e f g h i j k l m n o p q r s t"
    near = [
        chinese, chinese[:20] + "变" + chinese[21:], chinese[:41] + chinese[42:], chinese[:7], chinese[:6] + "变",
        chinese[:6], "字" + chinese[:5], "an unspaced 𝒳 heading", "an unspaced 𝒴 heading", "an unspaced  heading!",
        "Subscribe to our letter", "Subscribe to our letters", "Subscribed to our letters", "Chapter 1", "Chapter 2",
        spaced, spaced.replace(" ", ""), spaced.replace(" ", "")[:-1], "one two three four five six seven",
        "one two three four five six seven eight", "one two three four five six sevene ight",
    ]
    data = []
    for i in range(25):
        lines = rng.sample(short, 4) + rng.sample(near, 5) + ["", f"only here {i * 1234567}"]
        rng.shuffle(lines)
        data.append((i, "\n".join(lines), *[None] * 7))
    found = corpus_pipeline.line_dedup(spark, frame(spark, data), "unused")
    kept = {r["doc_id"]: r["text"] for r in found.collect()}
    assert kept == brute_every_line(data)
    assert "\n".join(kept.values()).count("Home | About | Contact") == 1


def test_lines_use_no_python(docs):
    plan = line_digests(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


# near duplicates


def bag(text):
    words = WORD.findall(text or "")
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def brute_classes(data):
    texts = {i: bag(t) for i, t, *_ in data if i is not None}
    top = {i: i for i in texts}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = sum((texts[i] & texts[j]).values())
            if both and 5 * both >= 4 * (sum(texts[i].values()) + sum(texts[j].values()) - both):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return {i: root(i) for i in ids}


def near_copies(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    data = []
    for base in range(6):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        for _ in range(12):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            data.append((len(data) * 7 % 101, " ".join(copy * (1 + base % 2)), *[None] * 7))
    return data


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_match_brute_force(spark, seed):
    data = near_copies(seed)
    found = {r["doc_id"]: r["class_id"] for r in near_duplicate_classes(frame(spark, data)).collect()}
    assert found == brute_classes(data)
    assert len(set(found.values())) < len(found)


def test_classes_of_odd_rows(docs, none):
    out = near_duplicate_classes(docs).collect()
    assert len(out) == len(rows())
    found = {r["doc_id"]: r["class_id"] for r in out if r["doc_id"] is not None}
    assert found == brute_classes(rows())
    assert [r["class_id"] for r in out if r["doc_id"] is None] == [2]
    assert found[22] == 21 and found[18] == 18 and found[17] == 17 and found[3] == 1
    assert near_duplicate_classes(none).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100 + k, 100) for k in range(30)]
    edges += [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {x: x for e in edges for x in e}
    for _ in top:
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: top[x] for x in linked}
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


# personal data


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((m.start(), m.end(), n))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_match_the_patterns():
    rng = random.Random(5)
    parts = ["a", ".", "@", "-", "1", "25", "4", "+", " ", "(", ")", "%", "é", "٣", "\n", "1.2.3.4", "411111", "_"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert base_spans(text) == brute_spans(text)
    assert base_spans("9" * 200_000 + "@" * 1000 + "1." * 50_000) is not None


def test_personal_data_of_odd_rows(docs, none):
    model = fit_pii_field(docs)
    out = find_personal_data(docs, model)
    assert out.columns == [*SCHEMA.names, "pii"]
    found = out.collect()
    assert len(found) == len(rows())
    for r in found:
        base = brute_spans(r["text"] or "")
        assert r["pii"]["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest()
        assert [r["pii"][f"n_{k}"] for k in KINDS] == [sum(s[2] == k for s in base) for k in range(4)]
        assert set(filter(None, written(base).split(","))) <= set(r["pii"]["spans"].split(","))
    (one,) = [r for r in found if r["doc_id"] == 25]
    assert one["pii"]["masked"] == "Write to <EMAIL> or <PHONE>, host <IP>, card <CARD>."
    assert [r["pii"]["masked"] for r in found if r["doc_id"] == 17] == [None]
    assert find_personal_data(none, fit_pii_field(none)).count() == 0


def test_the_field_learns_other_forms(spark):
    rng = random.Random(6)
    data = []
    for i in range(120):
        text = rng.choice([
            f"mail user{i}@host{i % 9}.example.com now", f"call +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} now",
            f"order {rng.randint(1000, 9999999)} of 2024-01-{i % 28 + 1:02d} now", f"at 10.{i}.0.7 now", f"version 2.{i}.1 build 20{i:05d} now",
        ])
        data.append((i, text, *[None] * 7))
    model = fit_pii_field(frame(spark, data))
    asked = [
        (1, "reach me on (415) 555-2671 today", *[None] * 7), (2, "write to bob(at)host.example.com today", *[None] * 7),
        (3, "order 1234567 of 2024-01-05 in version 2.3.1 build 2000123 today", *[None] * 7),
    ]
    found = {r["doc_id"]: r["pii"]["spans"] for r in find_personal_data(frame(spark, asked), model).collect()}
    assert found[1].startswith("phone:") and found[2].startswith("email:") and found[3] == ""


def test_the_field_sees_whole_stretches_and_every_mark(spark):
    model = SpanField({(3, "shape3-3-4"): 9.0, (0, "at at "): 9.0})
    numbers = " ".join(["1234"] * 150)
    text = f"{numbers} (415) 555-2671 {numbers}"
    at = len(numbers) + 1
    assert (at, at + 14, 3) in all_spans(text, model)[1]
    plain = "write to john at example (dot) com"
    got = find_personal_data(frame(spark, [(1, plain, *[None] * 7), (2, "no mark", *[None] * 7)]), model)
    assert {r["doc_id"]: r["pii"]["spans"] for r in got.collect()} == {1: f"email:9:{len(plain)}", 2: ""}
    assert len(list(regions("1 " * 100_000)[0].edges)) == 200_000


def test_one_cut_decides_between_numbers_and_addresses():
    text = "a1.4155552671@host.example.com"
    found = list(regions(text))
    assert len(found) == 1
    spans = {(found[0].edges[i], found[0].edges[j], kinds) for i, j, kinds, _ in found[0].segments()}
    ends = (len(text), text.index(".com"))
    assert {(a, b, (0,)) for a in (0, 3) for b in ends} <= spans and (3, 13, (1, 2, 3)) in spans
    as_phone = SpanField({(3, "shape9"): 20.0, (0, "at@"): 5.0})
    assert as_phone.best(found[0]) == [(3, 13, 3)]
    as_address = SpanField({(3, "shape9"): 5.0, (0, "at@"): 30.0, (0, "labels3"): 1.0, (0, "local3"): 1.0})
    assert as_address.best(found[0])[0][2] == 0


# toxicity


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    data, labels = [], []
    for i in range(900):
        body = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(3):
                body.insert(rng.randrange(len(body)), rng.choice(["moron", "zorgen", "zorgix", "zorgal"]))
        data.append((i, " ".join(body), *[None] * 7))
        labels.append((i, toxic))
    docs = frame(spark, data)
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (7, 0)], "doc_id long, toxic int")
    model = fit_toxicity(docs, marks.filter("doc_id is null or doc_id % 3 <> 1"))
    score = {r["doc_id"]: r["score"] for r in score_toxicity(docs, model).collect()}
    held = [(score[i], t) for i, t in labels if i % 3 == 1]
    assert all(0 <= s <= 1 for s, _ in held)
    right = sum((s >= 0.7) == bool(t) for s, t in held)
    assert right / len(held) > 0.97


def test_toxicity_of_odd_rows(spark, docs, none):
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit_toxicity(docs, no_labels)
    scores = [r["score"] for r in score_toxicity(docs, model).collect()]
    assert len(scores) == len(rows()) and set(scores) == {0.0}
    some = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    model = fit_toxicity(docs, some)
    assert all(0 <= r["score"] <= 1 for r in score_toxicity(docs, model).collect())
    assert score_toxicity(none, model).count() == 0


# tokens


def test_token_shards_hold_documents_in_order(spark, docs, none):
    path = write_token_shards(docs, TOKENIZER, 2, shard_tokens=300)
    found = sorted(map(tuple, read_token_shards(spark, path).drop("ids").collect()), key=lambda r: r[1])
    data = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in found] == [r[0] for r in data]
    at = 0
    for got, row in zip(found, data, strict=True):
        ids = ids_of(row[1])
        assert got[1:] == (at, len(ids), crc(ids))
        at += len(ids)
    every = [i for row in data for i in ids_of(row[1])]
    wanted = [2, every[0], every[100], 49_000]
    counts = {r["id"]: (r["n"], r["first_place"]) for r in id_counts(spark, path, wanted).collect()}
    assert counts == {i: (every.count(i), every.index(i) if i in every else None) for i in wanted}
    assert read_token_shards(spark, write_token_shards(none, TOKENIZER, 2)).count() == 0


@pytest.mark.parametrize("weights", [None, {"s0": 0.7, "s1": 0.2, "s2": 0.1}])
def test_packing_of_odd_rows(docs, none, weights):
    window = 256
    found = pack(docs, TOKENIZER, 2, weights, window, with_ids=True).collect()
    want = Counter()
    for row in rows():
        ids = ids_of(row[1])
        want[row[0], len(ids), crc(ids)] += 1
    by_doc, lengths = defaultdict(list), Counter()
    for r in found:
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], bytes(r["ids"])))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        lengths[r["sequence_id"]] += r["length"]
    for (doc, n, _), times in want.items():
        places = Counter(k for s, m, _ in by_doc[doc, n] for k in range(s, s + m))
        assert places == Counter({k: times for k in range(n)}), doc
    for (doc, n), cuts in by_doc.items():
        if want[doc, n, zlib.crc32(b"".join(i for _, _, i in sorted(cuts)))] != 1:
            assert doc in (6, None)
    total = sum(n * times for (_, n, _), times in want.items())
    full = total // window
    assert all(lengths[s] == window for s in range(full))
    assert sum(lengths.values()) == total and all(v & (v - 1) == 0 for s, v in lengths.items() if s >= full)
    assert pack(none, TOKENIZER, 2).count() == 0


def packed_by_source(spark, texts, weights, window):
    """Tokens by sequence and source, after testing that every token is packed once, without gaps."""
    data = [(i, text, None, source, *[None] * 5) for i, (source, text) in enumerate(texts)]
    found = pack(frame(spark, data), TOKENIZER, 2, weights, window, with_ids=True).collect()
    by_doc, by_sequence, given = defaultdict(list), defaultdict(list), Counter()
    for r in found:
        by_doc[r["doc_id"]].append((r["start"], bytes(r["ids"])))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        given[r["sequence_id"], texts[r["doc_id"]][0]] += r["length"]
    known = {text: np.array(ids_of(text), "<u4").tobytes() for text in {t for _, t in texts}}
    for i, (_, text) in enumerate(texts):
        assert b"".join(ids for _, ids in sorted(by_doc[i])) == known[text]
    for sequence in by_sequence.values():
        at = 0
        for offset, length in sorted(sequence):
            assert offset == at
            at += length
    total = sum(len(k) for k in (known[t] for _, t in texts)) // 4
    return given, total


@pytest.mark.parametrize("window", [512, 4096])
def test_packing_deals_many_small_sources(spark, window):
    rng = random.Random(2)
    text = prose(rng, [f"w{i}" for i in range(50)], 12)
    texts = [(f"s{i}", text) for i in range(3000)] + [("big", text)] * 1500
    rng.shuffle(texts)
    given, total = packed_by_source(spark, texts, None, window)
    each = len(ids_of(text))
    turn = max(1, window // 1024)
    had = Counter()
    for sequence in range(total // window):
        assert abs(given[sequence, "big"] - window / 3) <= 1
        for i in range(3000):
            had[i] += given[sequence, f"s{i}"]
            assert abs(had[i] - (sequence + 1) * window * each / total) <= 4 * turn


def test_packing_gives_small_sources_their_weights(spark):
    rng = random.Random(4)
    text = prose(rng, [f"w{i}" for i in range(50)], 12)
    texts = [("big", text)] * 1500 + [("small", text)] * 10 + [(f"s{i}", text) for i in range(200)]
    rng.shuffle(texts)
    weights = {"big": 0.4, "small": 0.2, **{f"s{i}": 0.4 / 200 for i in range(200)}}
    given, _ = packed_by_source(spark, texts, weights, 512)
    lasts = min(10 * len(ids_of(text)) // 103, 200 * len(ids_of(text)) // 205)
    for sequence in range(lasts):
        assert abs(given[sequence, "small"] - 0.2 * 512) <= 1
        assert abs(sum(given[sequence, f"s{i}"] for i in range(200)) - 0.4 * 512) <= 1
        assert max(given[sequence, f"s{i}"] for i in range(200)) <= 5


def test_sentence_pieces_of_odd_rows(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentence_pieces(path)._library
    found = Counter(map(tuple, encode_and_decode(docs, path).collect()))
    want = Counter()
    for row in rows():
        ids, raw = library.encode(row[1] or ""), (row[1] or "").encode()
        want[row[0], len(ids), crc(ids), len(raw), zlib.crc32(raw)] += 1
    assert found == want
    assert encode_and_decode(none, path).count() == 0


# neighbours

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("list", T.StringType()),
])


def brute_nearest(data, k):
    good = {}
    for i, v, _ in data:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8:
            good[i] = np.array(v, float)
    ids = np.array(sorted(good))
    all_ = np.stack([good[i] for i in ids])
    out = {}
    for i in ids[ids % 5 == 0]:
        scores = all_ @ good[i]
        at = np.lexsort((ids, -scores))
        at = at[ids[at] != i][:k]
        out[int(i)] = [(int(ids[j]), float(scores[j])) for j in at]
    return out


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(8)
    data = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * (1 + i % 3)], None) for i in range(700)]
    same = data[10][1]
    data += [(1000 + i, same, None) for i in range(300)]
    data += [(2000, None, None), (2005, [0.0] * 8, None), (2010, [None] + [1.0] * 7, None), (None, same, None)]
    data += [(2015, [float("nan")] + [1.0] * 7, None), (2020, [float("inf")] * 8, None), (2025, [1.0], None), (2030, [], None), data[3]]
    frame_ = spark.createDataFrame(data, VECTORS).repartition(4)
    small = ListSettings(probes=400, least_probes=40, piece=64, block=16)
    found = defaultdict(list)
    for r in nearest_by_lists(frame_, F.col("vec_id") % 5 == 0, 6, small).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(found[r["query_id"]]) + 1
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute_nearest(data, 6)
    assert found.keys() == want.keys()
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    # copies tie: the least ids come first, and a query is never its own neighbour
    assert [i for i, _ in found[1005]] == [i for i, _ in want[1005]]
    for q, near in found.items():
        assert all(i != q for i, _ in near)
        assert [s for _, s in near] == sorted((s for _, s in near), reverse=True)


def test_ratio_of_queries_follows_the_vectors():
    rng = np.random.default_rng(5)
    lone = rng.normal(size=(4000, 16))
    groups = np.repeat(rng.normal(size=(80, 16)) * 8, 50, axis=0) + rng.normal(size=(4000, 16)) * 0.05

    def share(vectors):
        points = np.concatenate([vectors, np.zeros((len(vectors), 1))], 1)
        points[:, :-1] /= np.linalg.norm(vectors, axis=1)[:, None]
        graph = CentroidGraph(balanced_centroids(points, 128), 24)
        ratio = query_ratio(points, graph, 20, ListSettings())
        far = np.sort(graph.distances(points[::40]), axis=1)
        return ratio, (far <= ratio**2 * far[:, 7:8]).mean()

    (wide, many), (narrow, few) = share(lone), share(groups)
    assert narrow < wide and few < 0.05 and few < many
    one = np.ones((1, 3))
    assert query_ratio(one, CentroidGraph(one, 24), 5, ListSettings()) == ListSettings().ratio


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], None), (1, [0.5, 0.5], None), (5, [0.0, 1.0], None)], VECTORS)
    out = {(r["query_id"], r["rank"]): r["vec_id"] for r in nearest_by_lists(few, F.col("vec_id") % 5 == 0, 20).collect()}
    assert out == {(0, 1): 1, (0, 2): 5, (5, 1): 1, (5, 2): 0}
    nothing = nearest_by_lists(spark.createDataFrame([], VECTORS), F.lit(True), 3)
    assert nothing.columns == ["query_id", "rank", "vec_id", "score"] and nothing.count() == 0


# pipeline


def test_pipeline_stages(spark, docs, none):
    folder = "unused"
    kept = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, kept, folder)
        assert after.columns == SCHEMA.names, name
        before, left = kept.count(), after.count()
        assert left < before if name in ("quality rules", "near dedup") else left == before, name
        assert step(spark, none, folder).count() == 0
        kept = after.cache()
    assert kept.filter("text like '%@%'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, folder)
    n = {r["doc_id"]: len(ids_of(r["text"])) for r in kept.collect()}
    got = Counter()
    for r in packed.collect():
        got[r["doc_id"]] += r["length"]
    assert got == Counter(n)
    assert corpus_pipeline.STAGES[-1][1](spark, none, folder).count() == 0


def test_pipeline_keeps_one_of_each_class(spark):
    data = near_copies(9)
    data += [data[0], data[0]]
    out = corpus_pipeline.near_dedup(spark, frame(spark, data), "unused").collect()
    classes = brute_classes(data)
    assert sorted(r["doc_id"] for r in out) == sorted(set(classes.values()))


def test_pipeline_runs_its_stages_over_a_folder(spark, tmp_path):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(300)]
    data = [
        (i, "\n".join(prose(rng, words, 30) for _ in range(4)) + f"\nmail a{i}@host.example.com or 10.0.0.{i}", "en", f"s{i % 3}", 1)
        for i in range(30)
    ]
    data.append((30, data[3][1] + " end", "en", "s0", 1))  # a near copy
    data.append((31, "too short", "en", "s0", 1))
    data.append((32, prose(rng, words, 80) + "\n" + data[5][1].split("\n")[0], "en", "s1", 1))  # a line of document 5
    schema = T.StructType(SCHEMA.fields[:5])
    spark.createDataFrame(data, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.createDataFrame(data, schema)
    for _, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, docs, str(tmp_path))
        assert after.columns == schema.names
        docs = spark.createDataFrame(after.collect(), schema)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 31 not in texts and set(range(30)) - {3} <= set(texts)
    assert "@" not in "".join(texts.values()) and data[5][1].split("\n")[0] not in texts[32]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found = defaultdict(list)
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == len(found[r["doc_id"]])
        found[r["doc_id"]] += np.frombuffer(bytes(r["ids"]), "<u4").tolist() if isinstance(r["ids"], (bytes, bytearray)) else list(r["ids"])
    assert found == {d: ids_of(t) for d, t in texts.items()}
