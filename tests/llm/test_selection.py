"""Resampling, URL templates and the filter audit against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from odd_rows import frame, prose, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm import remembered
from lodestar.llm.filter_audit import audit_filters, first_in_document, measure, measured
from lodestar.llm.near_duplicates import near_duplicate_classes
from lodestar.llm.packing import pack
from lodestar.llm.quality_rules import score_quality
from lodestar.llm.resampling import ResamplingSettings, crc32_of_ranges, feature_words, range_of, resample
from lodestar.llm.sentence_pieces import SentencePieces, encode_and_decode, sentence_pieces
from lodestar.llm.substrings import remove_repeats
from lodestar.llm.text import mix, powers, range_hashes, running, span_hashes
from lodestar.llm.url_templates import Rule, TemplateSettings, host_of, judge_urls, path_of, rule_of
from lodestar.llm.wavelet import read_token_shards, write_token_shards
from lodestar.llm.word_ids import WordEncoder


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def thue_morse(n):
    """A string over a and b and its complement, of 2^n letters."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


# resampling


def features(text, longest):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute_resample(data, target, s):
    def buckets(text):
        return [zlib.crc32(f.encode()) % s.buckets for f in features(text, s.longest)[1]]

    corpus, wanted = Counter(), Counter()
    for r in data:
        corpus.update(buckets(r[1]))
    for t in target:
        wanted.update(buckets(t))
    n, m = sum(corpus.values()), sum(wanted.values())
    gain = {
        b: math.floor(1000 * math.log((wanted[b] + 1) * (n + s.buckets) / ((corpus[b] + 1) * (m + s.buckets))))
        for b in corpus
    }
    out = []
    for r in data:
        mine = [gain[b] for b in buckets(r[1])]
        weight = sum(mine) // len(mine) if mine else 0
        h = int(hashlib.sha256(f"{s.seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([r[0], len(mine), weight, score, len(features(r[1], 1)[0]) >= s.least_words, None])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for rank, r in enumerate(order[: s.percent * len(order) // 100], 1):
        r[5] = rank
    return Counter((r[0], r[1], r[2], r[3], r[5]) for r in out)


TARGET = ["w1 w2 W3 é w4", None, "", "w5 w5 w6", "日本 w7"]


@pytest.mark.parametrize("longest", [1, 3])
@pytest.mark.parametrize("percent", [10, 60, 100])
def test_resampling_matches_brute_force(spark, longest, percent):
    settings = ResamplingSettings(longest=longest, buckets=97, percent=percent, sample=9)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    got = resample(frame(spark), target, settings)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == brute_resample(rows(), TARGET, settings)


def test_resampling_of_ties_and_copies(spark):
    data = [(i % 7, "same words here " * 10, *[None] * 7) for i in range(300)]
    settings = ResamplingSettings(percent=50, sample=16)
    target = spark.createDataFrame([], "item_id long, text string")
    got = resample(frame(spark, data, 7), target, settings).collect()
    assert Counter(tuple(r) for r in got) == brute_resample(data, [], settings)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 151))


@pytest.mark.parametrize("size", [1, 7, 40])
def test_resampling_of_ranges_longer_than_a_batch(spark, size):
    data = [(i, f"w{i % 13} same words here " * 6, *[None] * 7) for i in range(300)]
    settings = ResamplingSettings(percent=60, sample=16)
    target = spark.createDataFrame([(1, "w3 w5 w5")], "item_id long, text string")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, size)
    try:
        got = resample(frame(spark, data, 7), target, settings).collect()
    finally:
        spark.conf.unset(batch)
    assert Counter(tuple(r) for r in got) == brute_resample(data, ["w3 w5 w5"], settings)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 181))


def test_resampling_of_nothing(spark):
    target = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert resample(frame(spark, []), target).collect() == []
    few = frame(spark, [(1, "one two", *[None] * 7), (2, None, *[None] * 7)])
    assert sorted((r["doc_id"], r["n_features"], r["rank"]) for r in resample(few, target).collect()) == [
        (1, 2, None), (2, 0, None)
    ]


def test_crc_of_ranges():
    rng = random.Random(3)
    pieces = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 7, 30, 48, 49, 300]))) for _ in range(200)]
    edges = running(np.array([len(p) for p in pieces]))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    assert crc32_of_ranges(data, edges[:-1], edges[1:]).tolist() == [zlib.crc32(p) for p in pieces]


def test_feature_words():
    texts = ["A-b c1_d É é`x{y\x7fz@Q", "", None, "日本 語"]
    words = feature_words(pa.array(texts))
    found = [words.data[s:e].tobytes().decode() for s, e in zip(words.start, words.end, strict=True)]
    assert found == [w for t in texts for w in features(t, 1)[0]]


def test_ranges_follow_the_splitters():
    keys = [np.array([3, 1, 2, 2, 0]), np.array([0, 0, 5, 1, 0])]
    assert range_of(keys, [np.array([1, 2]), np.array([0, 2])]).tolist() == [2, 1, 2, 1, 0]
    assert range_of(keys, [np.zeros(0, int), np.zeros(0, int)]).tolist() == [0] * 5


# URL templates

RULES = [
    Rule("com", "/", True), Rule("example.com", "/en/", False), Rule("www.example.com", "/en/", True),
    Rule("net", "/es/", False), Rule("net", "/fr/", False),
]


def test_hosts_paths_and_rules(spark):
    urls = {
        "https://WWW.Example.com/en/1?x=/y#z": ("www.example.com", "/en/1", "www.example.com/en/"),
        "http://a.example.com/en/x": ("a.example.com", "/en/x", "example.com/en/"),
        "http://badexample.com/en/x": ("badexample.com", "/en/x", "com/"),
        "http://example.com": ("example.com", "", None),
        "http://example.com?a=/en/": ("example.com", "", None),
        "http://x.net/es": ("x.net", "/es", None),
        "http://x.net/es/a#b?c": ("x.net", "/es/a", "net/es/"),
        "a://b://c/d": ("b:", "//c/d", None),
        "://h\n/p\nq": ("h\n", "/p\nq", None),
        "http://ÄB.COM/": ("Äb.com", "/", "com/"),
        "example.com/en/": ("", "", None),
        "": ("", "", None),
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    got = {r[0]: tuple(r)[1:] for r in df.select("url", host, path, rule_of(host, path, RULES)["text"]).collect()}
    assert got == urls


def brute_templates(urls, s):
    """Template and rejection of (host, path, label) rows, by recursion over each host's tree."""

    def shape(path):
        return [
            "#" if re.fullmatch("[0-9A-Fa-f-]{16,}", p) else re.sub("[0-9]+", "#", p) for p in path.split("/") if p
        ]

    def cell(segments, level, label):
        nxt = segments[level + 1] if len(segments) > level + 1 else None
        kind = 0 if nxt is None else 1 if nxt == "#" else 2 if "#" in nxt else 3 if "." in nxt else 4
        return kind, label

    rows_ = [(i, h, shape(p), label) for i, (h, p, label) in enumerate(urls)]
    node = {i: "" for i, *_ in rows_}
    for level in range(s.levels):
        groups = {}
        for i, h, seg, label in rows_:
            if len(seg) > level:
                groups.setdefault((h, node[i]), []).append((i, seg, label))
        for members in groups.values():
            branch = {}
            for i, seg, label in members:
                branch.setdefault(seg[level], Counter())[cell(seg, level, label)] += 1
            whole = sum(branch.values(), Counter())
            own = set()
            for name, cells in branch.items():
                n, rest = cells.total(), whole.total() - cells.total()
                if len(branch) == 1:
                    own.add(name)
                elif len(branch) <= s.most_branches:
                    overlap = sum(math.sqrt(cells[c] / n * ((whole[c] - cells[c]) / rest)) for c in whole)
                    chance = (len(whole) - 1) / 8
                    if 1 - overlap - chance / n - chance / rest > s.most_distance + 1e-12:
                        own.add(name)
            for i, seg, _ in members:
                node[i] += "/" + (seg[level] if seg[level] in own else "?")
    template = {i: (h, node[i] + ("/??" if len(seg) > s.levels else "")) for i, h, seg, _ in rows_}
    good, bad = Counter(), Counter()
    for i, _, _, label in rows_:
        (good if label == 0 else bad if label == 1 else Counter())[template[i]] += 1
    return [(template[i][1], (bad[t] + 1) / (bad[t] + good[t] + 2) >= s.least_purity) for i, t in template.items()]


@pytest.mark.parametrize("seed", range(3))
def test_templates_match_brute_force(spark, seed):
    rng = random.Random(seed)
    urls = []
    for _ in range(600):
        host = rng.choice(["a.org", "a.org", "b.org", ""])
        section = rng.choice(["shop", "news", "blog", "spam"])
        label = rng.choice([1, 1, None]) if section == "spam" else rng.choice([0, None, None])
        tail = rng.choice([["item", str(rng.randrange(99))], [f"p{rng.randrange(9)}.html"], ["u" + "xyz"[rng.randrange(3)] * rng.randrange(1, 9), "photo"]])
        urls.append((host, "/" + "/".join([section, *tail, *["deep"] * rng.choice([0, 0, 5])]), label))
    settings = TemplateSettings(levels=4, most_branches=5)
    data = [(i, f"http://{h}{p}", bool(label) if label is not None else None) for i, (h, p, label) in enumerate(urls)]
    df = spark.createDataFrame(data, "page_id long, url string, label boolean").repartition(5)
    got = {r["page_id"]: (r["template"], r["verdict"] == "block") for r in judge_urls(df, [], F.col("label"), settings).collect()}
    assert got == dict(enumerate(brute_templates(urls, settings)))


def test_templates_learn_what_the_rules_leave_open(spark):
    urls = [f"http://x.org/ads/{i}" for i in range(20)] + [f"http://x.org/about/{w}" for w in "abcdefgh"]
    data = [(i, u, True if "ads" in u and i < 15 else None) for i, u in enumerate(urls)]
    df = spark.createDataFrame(data, "page_id long, url string, label boolean")
    got = judge_urls(df, [Rule("x.org", "/ads/1", True)], F.col("label")).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == {i for i in range(20) if not str(i).startswith("1")}


def test_urls_of_odd_rows(spark):
    long_path = "/".join(["http://long.org"] + [f"s{i}" for i in range(3000)])
    data = [(1, None, "h", "n"), (1, None, "h", "n"), (None, "http://x.com/a", None, "n"), (3, long_path, None, "n"), (4, "", None, "n")]
    df = spark.createDataFrame(data, "page_id long, url string, host string, node string")
    got = judge_urls(df, RULES).collect()
    assert Counter((r["page_id"], r["host"], r["rule"], r["verdict"]) for r in got) == Counter({
        (1, "", None, "allow"): 2, (None, "x.com", "com/", "allow"): 1, (3, "long.org", None, "allow"): 1, (4, "", None, "allow"): 1
    })
    assert judge_urls(df.limit(0), RULES).collect() == []


# filter audit


def test_transducer_and_word_table():
    rng = random.Random(5)
    a, b = thue_morse(11)
    words = ["a", "B", "é", "日本", "x" * 9, "x" * 17, "y" + "x" * 17, "#1", a, b, "same-head-1-same-tail", "same-head-2-same-tail"]
    texts = ["".join(rng.choice([*words, " ", "\n", "\x0b"]) for _ in range(rng.randrange(60))) for _ in range(80)]
    texts += [None, "", f"{a} {b} {a}", " ".join(words * 3)]
    got = measure(pa.array(texts))
    for i, text in enumerate(t or "" for t in texts):
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert (got["n_words"][i], got["n_distinct"][i]) == (len(found), len(set(found)))
        assert got["n_points"][i] == len(text)
        assert got["n_capitals"][i] == len(re.findall("[A-Z]", text))
        assert got["n_symbols"][i] == len(re.findall("[#$%&*|]", text))
        assert got["digest"][i] == hashlib.sha256(text.encode()).digest()


def test_equal_hashes_do_not_merge_words():
    a, b = thue_morse(10)
    data = np.frombuffer((a + b + a).encode(), np.uint8)
    edges = np.arange(4) * 1024
    owns = first_in_document(data, edges[:-1], edges[1:], np.zeros(3, np.int64))
    assert owns[1] and owns[0] != owns[2]


def brute_audit(data, labels, fails):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in data]
    least = {}
    for r in data:
        if r[0] is not None:
            least[r[1] or ""] = min(r[0], least.get(r[1] or "", r[0]))
    flags = []
    for r, w in zip(data, words, strict=True):
        copy = r[0] is not None and r[0] > least[r[1] or ""]
        flags.append("".join(name for name, f in fails.items() if f(r[1] or "", w, copy)))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    out, total = {}, Counter()
    for part in {r[3] or "" for r in data}:
        mine = [(r, f) for r, f in zip(data, flags, strict=True) if (r[3] or "") == part]
        for order in permutations(fails):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(r, f) for r, f in left if x in f]
                left = [(r, f) for r, f in left if x not in f]
                total[part, x] += len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == x for _, f in mine),
                    sum(r[0] in good for r, _ in gone), sum(r[0] in toxic for r, _ in gone),
                )
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_matches_brute_force(spark):
    data = rows() + rows()[:3] + [(100 + i, "copy of one text", "en", "s1", 1, "t", 1, "r", "d") for i in range(30)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(35)] + [(4, 1, None), (7, None, 1), (None, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit_filters(frame(spark, data), known, [
        ("A", F.col("n_words") < 50), ("B", 100 * F.col("n_distinct") < 50 * F.col("n_words")), ("E", F.col("copy")),
    ])
    expected = brute_audit(data, [x for x in labels if x[0] is not None], {
        "A": lambda t, w, c: len(w) < 50, "B": lambda t, w, c: 100 * len(set(w)) < 50 * len(w), "E": lambda t, w, c: c,
    })
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == expected


def test_audit_of_nothing_and_of_very_long_texts(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    fails = [("A", F.col("n_words") < 50), ("E", F.col("copy"))]
    assert audit_filters(frame(spark, []), none, fails).collect() == []
    text = prose(random.Random(1), ["x", "y" * 20, "z"], 300_000)
    got = measured(frame(spark, [(1, text, *[None] * 7)])).first()
    assert (got["n_words"], got["n_distinct"], got["part"]) == (300_000, 3, "")
    assert T.BinaryType() == measured(frame(spark)).schema["digest"].dataType


# texts whose polynomial hashes modulo 2^64 are equal


def periodic(spark):
    """Texts that differ only by two strings of letters, or of words, that such hashes confuse."""
    a, b = thue_morse(11)
    words = "shared words " * 30
    texts = [f"{words}{a}", f"{words}{b}", f"{a}\n{b}", " ".join(a), " ".join(b)]
    return texts, frame(spark, [(i, t, "en", "s", len(t), "t", 1, "r", "d") for i, t in enumerate(texts)], 1)


def test_token_ids_of_periodic_texts(spark):
    texts, docs = periodic(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = WordEncoder(path)._whole
    want = [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    read = read_token_shards(spark, write_token_shards(docs, path, 2)).collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in read} == {i: crc(w) for i, w in enumerate(want)}
    pieces = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in pack(docs, path, 2).collect())
    assert all(c == crc(want[d][s : s + n]) for d, s, n, c in pieces) and sum(p[2] for p in pieces) == sum(map(len, want))


def test_pieces_of_periodic_texts(spark):
    texts, docs = periodic(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = {r["doc_id"]: r["ids_crc32"] for r in encode_and_decode(docs, path).collect()}
    assert found == {i: crc(sentence_pieces(path)._library.encode(t)) for i, t in enumerate(texts)}


def test_periodic_texts_are_not_copies(spark):
    texts, docs = periodic(spark)
    classes = {r["doc_id"]: r["class_id"] for r in near_duplicate_classes(docs).collect()}
    assert classes[0] == classes[1] == 0 and classes[2] == 2  # most five-word runs are shared
    short = thue_morse(9)
    rare = frame(spark, [(i, " ".join(f"{c}{k % 7}" for k, c in enumerate(t)), *[None] * 7) for i, t in enumerate(short)])
    assert {r["doc_id"]: r["class_id"] for r in near_duplicate_classes(rare).collect()} == {0: 0, 1: 1}
    assert {r["doc_id"]: r["quality"]["n_dup_lines"] for r in score_quality(docs).collect()} == dict.fromkeys(range(5), 0)
    assert {r["doc_id"]: r["n_removed"] for r in remove_repeats(docs).collect()}[1] == 60


def test_colliding_keys_are_told_apart(monkeypatch):
    monkeypatch.setattr(remembered, "span_hashes", lambda data, start, end, seed=0: (
        span_hashes(data, start, end, seed) & np.uint64(3) if seed < 3 else span_hashes(data, start, end, seed)
    ))
    encoder = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["one two three four five six", "seven eight one nine ten", "two " * 9]
    ids, counts = encoder.encode(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in encoder._whole.encode(t, add_special_tokens=False).ids]


def test_rabin_karp_is_modulo_the_prime():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 64, 300, np.uint64)
    prime, base = (1 << 61) - 1, int(powers(2)[0][1])
    start, end = rng.integers(0, 150, 40), rng.integers(150, 300, 40)
    got = range_hashes(np.concatenate([values, values]), start + 300, end + 300)
    want = [sum(int(values[i]) % prime * pow(base, int(i - s), prime) for i in range(s, e)) % prime for s, e in zip(start, end, strict=True)]
    spread = (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (got == mix(np.array(want, np.uint64) + spread)).all()


def test_spans_of_any_length_have_their_own_hash():
    a, b = thue_morse(11)
    pieces = [b"x" * n for n in range(600)] + [bytes([i, j]) for i in range(40) for j in range(40)] + [a.encode(), b.encode()]
    edges = running(np.array([len(p) for p in pieces]))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    assert len(set(span_hashes(data, edges[:-1], edges[1:]).tolist())) == len(pieces)
    again = span_hashes(np.concatenate([data[:3], data]), edges[:-1] + 3, edges[1:] + 3)
    assert (again == span_hashes(data, edges[:-1], edges[1:])).all()


def test_long_parts_without_spaces():
    rng = random.Random(8)
    model = SentencePieces(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [
        "".join(rng.choice("日本語的一是在人有我他这中大来上国说为子和你地出道也时年得就那要下以生会自着去之过家") for _ in range(700)),
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOP0123456789+/") for _ in range(3000)),
        "a" * 5000, "=" * 4097 + "x", "\n" * 5000, "tail " + "na" * 3000, "ไม่มีช่องว่างในภาษาไทย" * 20, "👍" * 60,
    ]
    ids, counts = model.encode(pa.array(texts))
    at = running(counts)
    back = model.decode(ids.astype(np.int64), counts)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == model._library.encode(text)
        assert back[i].decode() == text
