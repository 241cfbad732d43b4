"""The operators against plain versions of what they work out, on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from conftest import SMALL

from conflux.llm import digest, golay, mixing, simhash, substrings, token_count
from conflux.llm.components import components
from conflux.llm.decontaminate import contamination, words_of
from conflux.llm.line_dedup import without_boilerplate
from conflux.llm.substrings import without_repeats


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(small):
    return {r["doc_id"]: r["text"] for r in small.select("doc_id", "text").collect()}


def joined(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


# ---- SimHash ---------------------------------------------------------------------------------


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(texts):
    extra = [None, "", " ", "One", "ONE two", "a b c", "a b c d", "É a\u00a0b c d e", "x " * 5000]
    for text in [*list(texts.values())[:60], *extra]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_components_of_near_copies(small, texts):
    got = {r["doc_id"]: r for r in simhash.near_copies(small).collect()}
    ids = sorted(texts)
    fps = {i: plain_fingerprint(texts[i]) for i in ids}
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3]
    wanted = joined(links, ids)
    assert {i: r["fp"] % 2**64 for i, r in got.items()} == fps
    assert {i: r["component"] for i, r in got.items()} == wanted


def reworded(draw, words, n):
    """``words`` with ``n`` of them replaced."""
    out = list(words)
    for at in draw.sample(range(len(out)), n):
        out[at] = f"new{draw.randrange(10**6)}"
    return out


def test_one_of_each_component_stays(spark, small):
    draw = random.Random(6)
    base = [[f"w{draw.randrange(500)}" for _ in range(n)] for n in (4000, 1500, 900)]
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    rows += [(2000 + 100 * k + i, " ".join(reworded(draw, b, i % 4))) for k, b in enumerate(base) for i in range(20)]
    rows += [(3000, "A b c"), (3001, "a  B c"), (3002, "a b"), (3003, None), (3004, ""), (3005, "\n"), (3001, "a  B c")]
    rows += [(3006, rows[5][1]), (None, rows[5][1]), (None, "only here " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.one_of_each(docs).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    alike = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if (fps[a] ^ fps[b]).bit_count() <= 3]
    group = joined(alike, range(len(rows)))
    first = {}
    for k, (i, _) in enumerate(rows):
        first.setdefault(group[k], []).append((i is None, i or 0))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted(min(g) for g in first.values())
    assert len(got) < len(rows) - 60


def test_words_two_bits_apart_share_a_codeword():
    table = golay.keys_of_short_words(16)
    sets = [set(k[k >= 0].tolist()) for k in table[::97]]
    for word, keys in zip(range(0, 1 << 16, 97), sets, strict=True):
        for i in range(16):
            for j in range(i):
                assert keys & set(table[word ^ 1 << i ^ 1 << j].tolist())


def test_every_pair_of_three_bits_shares_a_key():
    draw = random.Random(3)
    for _ in range(400):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), draw.randint(0, 3)):
            b ^= 1 << bit
        keys = [set(simhash.golay_keys(np.array([x], np.uint64).view(np.int64))[0].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def test_golay_codewords_are_seven_bits_apart():
    words = np.arange(1 << 23)
    code = words[golay.syndromes(words) == 0]
    assert len(code) == 4096
    assert np.bitwise_count(code[1:]).min() == 7


@pytest.mark.parametrize("group", [4096, 40])
def test_links_connect_what_pairs_connect(spark, group):
    """One dense cluster, whose keys are too large for a group of 40."""
    draw = random.Random(5)
    centre = draw.getrandbits(63)
    fps = {centre}
    while len(fps) < 300:
        near = draw.choice(sorted(fps))
        fps.add(near ^ (1 << draw.randrange(63)) ^ (1 << draw.randrange(63)))
    fps |= {draw.getrandbits(63) for _ in range(200)}
    ids = sorted(fps)
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in ids], "fp long"), group=group)
    got = joined([(r["u"], r["v"]) for r in links.collect()], ids)
    wanted = joined([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (a ^ b).bit_count() <= 3], ids)
    assert got == wanted


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    edges += [(300 + (i * 7) % 31, 300 + (i * 11) % 31) for i in range(31)] + [(None, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    known = [e for e in edges if None not in e and e[0] != e[1]]
    wanted = joined(known, {n for e in known for n in e})
    assert got == wanted


# ---- repeated substrings ---------------------------------------------------------------------


def plain_cut(all_bytes, length=400):
    seen = {}
    for data in all_bytes:
        for p in range(len(data) - length + 1):
            seen[data[p : p + length]] = seen.get(data[p : p + length], 0) + 1
    out = []
    for data in all_bytes:
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if seen[data[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("bounds", [{}, {"batch_rows": 4, "most": 6}])
def test_repeated_substrings(spark, small, bounds):
    draw = random.Random(1)
    noise = ["".join(draw.choice("abcdefghij é") for _ in range(n)) for n in (700, 900, 399, 401)]
    rows = [(r["doc_id"], (r["text"] or "")[:3000]) for r in small.collect()[:60]]
    rows += [
        (1001, "a" * 1500),
        (1002, "ab" * 400),
        (1003, noise[0]),
        (1004, noise[1][:200] + noise[0][100:650] + noise[1][200:]),
        (1005, noise[2]),
        (1006, noise[2] + "!"),
        (1007, "?" + noise[3]),
        (1008, noise[3] + "?"),
        (1009, None),
        (1010, ""),
        (1011, noise[1] + noise[1]),
        (1012, "c" * 400),
        (1012, "c" * 400),
    ]
    rows += [(1100 + i, noise[1][i : i + 500] + str(i)) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in without_repeats(docs, **bounds).collect())
    wanted = plain_cut([(t or "").encode() for _, t in rows])
    assert got == sorted((i, *w) for (i, _), w in zip(rows, wanted, strict=True))


def test_large_buckets_are_not_dealt_by_gram(spark, monkeypatch):
    dealt, repeats = [], substrings._repeats
    monkeypatch.setattr(substrings, "_repeats", lambda around, *rest: dealt.append(around) or repeats(around, *rest))
    draw = random.Random(2)
    shared = ["".join(draw.choice("abcdefghij ") for _ in range(600)) for _ in range(3)]
    rows = [(100 * k + i, f"{i} {shared[k]} {i}") for k, n in enumerate((6, 7, 40)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in without_repeats(docs, batch_rows=4, most=6).collect())
    assert got == sorted((i, *w) for (i, _), w in zip(rows, plain_cut([t.encode() for _, t in rows]), strict=True))
    sizes = {r["count"] for r in dealt[0].groupBy("gram").count().collect()}
    assert 6 in sizes and max(sizes) == 6


# ---- lines -----------------------------------------------------------------------------------


def test_lines_at_the_threshold(spark):
    rows = [(100 * k + s, f"own {k} {s}\nshared {k}\n\nshared {k}", f"site{s}") for k in range(8, 13) for s in range(k)]
    rows += [(5000 + i, "one site", "site0") for i in range(30)] + [(990, None, "site1"), (991, "shared 12", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["row"]["doc_id"]: (r["n_lines"], r["n_removed"], r["kept"]) for r in without_boilerplate(docs, sites=10).collect()}
    sites = {}
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            sites.setdefault(line, set()).update({site} - {None})
    seen = set()
    for i, text, _ in sorted(rows):
        if text is None:
            assert got[i] == (0, 0, None)
            continue
        kept = []
        for line in text.split("\n"):
            if line.strip() and len(sites[line]) >= 10 and line in seen:
                continue
            seen.add(line)
            kept.append(line)
        assert got[i] == (len(text.split("\n")), len(text.split("\n")) - len(kept), "\n".join(kept))


# ---- digests ---------------------------------------------------------------------------------


def test_digests_and_edits_follow_the_order_of_ids(small, texts):
    got = {r["doc_id"]: r for r in digest.with_next(small).collect()}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        text, following = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
    likeness = [r["near_edited"] for r in got.values() if r["n_chars"] > 1000]
    assert 0.35 < sorted(likeness)[len(likeness) // 2] < 0.65
    assert all(r["near_edited"] > r["near_next"] for r in got.values() if r["n_chars"] > 200 and r["near_next"] < 0.5)


def test_digests_do_not_depend_on_what_is_beside_them(texts):
    some = [(t or "").encode() for t in list(texts.values())[:40]] + [b"", b"a", b"ab" * 40, b"x" * 5000]
    together = digest.digests(some)
    for text, found in zip(some, together, strict=True):
        alone = digest.digests([text])[0]
        assert np.array_equal(alone, found)
        assert digest.likeness(alone, found) == 1.0
    assert digest.likeness(digest.digests([b""])[0], together[0]) == 0.0


def test_a_passage_is_as_like_its_document_at_every_length(texts):
    plain = [d for t in texts.values() if len(d := (t or "").encode()) > 6000][:20]
    assert len(plain) > 3
    draw = random.Random(11)
    for size in (100, 120, 170, 175, 176, 190, 400):
        found = []
        for data in plain:
            for _ in range(5):
                at = draw.randrange(len(data) - size)
                a, b = digest.digests([data[at : at + size], data])
                found.append(digest.likeness(a, b))
        assert sum(found) / len(found) > 0.9, size


def test_rarity_is_the_windows_entropy():
    data = np.random.default_rng(0).integers(97, 105, 300).astype(np.uint8)
    rank = digest._rarity(data)
    for p in range(len(rank)):
        _, n = np.unique(data[p : p + digest.WINDOW], return_counts=True)
        share = n / digest.WINDOW
        entropy = -(share * np.log2(share)).sum()
        if entropy > digest.LEAST_ENTROPY + 0.01:
            assert abs((digest._FAR - rank[p]) / 65536 - abs(entropy - digest.TYPICAL)) < 1e-3


# ---- tokens ----------------------------------------------------------------------------------


def plain_count(model, word):
    scores = dict(zip(model.pieces, model.scores.tolist(), strict=True))
    word = token_count.SPACE + word
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[end - 1][0] + model.unknown, best[end - 1][1] - len(word[end - 1].encode()))]
        options += [(best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in scores]
        best.append(max(options))
    return -best[-1][1]


def test_token_counts(spark, small, texts):
    model = token_count.Unigram.read()
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_count.token_counts(small, model).collect()}
    known = {}
    for i in list(texts)[:40]:
        words = token_count.words_of(texts[i])
        for w in set(words) - known.keys():
            known[w] = plain_count(model, w)
        assert got[i] == (len(words), sum(known[w] for w in words))
    odd = ["", "日本語", "😀", "a" * token_count.LONGEST, "naïveté", "xqzxqz"]
    assert model.counts(odd).tolist() == [plain_count(model, w) for w in odd]


def test_long_words_are_counted_whole(spark):
    model = token_count.Unigram.read()
    draw = random.Random(12)
    scores = dict(zip(model.pieces, model.scores.tolist(), strict=True))
    longest = max(map(len, scores))

    def plain_long(word):
        word, best = token_count.SPACE + word, [(0, 0)]
        for end in range(1, len(word) + 1):
            options = [(best[-1][0] + model.unknown, best[-1][1] - len(word[end - 1].encode()))]
            for s in range(max(0, end - longest), end):
                if word[s:end] in scores:
                    options.append((best[s][0] + scores[word[s:end]], best[s][1] - 1))
            best.append(max(options))
        return -best[-1][1]

    pieces = [p.strip(token_count.SPACE) or "x" for p in model.pieces[:3000]]
    whole = [
        "".join(draw.choice(pieces) for _ in range(400))[:300],
        "the" * 100,
        "日本語の文章" * 60,
        "".join(draw.choice("ab日😀/=é") for _ in range(100_000)),
    ]
    assert model.counts([*whole, "a"]).tolist() == [plain_long(w) for w in [*whole, "a"]]
    docs = spark.createDataFrame([(1, f"a {whole[0]}\n{whole[3]} b"), (2, whole[1])], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_count.token_counts(docs, model).collect()}
    words = ["a", whole[0], whole[3], "b"]
    assert got == {1: (4, sum(plain_long(w) for w in words)), 2: (1, plain_long(whole[1]))}


# ---- mixing ----------------------------------------------------------------------------------


def plain_schedule(blocks, weights):
    left, out = list(blocks), []
    while any(left):
        share = {s: weights[s] for s in range(len(left)) if left[s] and weights[s]}
        share = share or {s: 1 for s in range(len(left)) if left[s]}
        total, ran, t = sum(share.values()), dict.fromkeys(share, 0), 0
        while True:
            ready = [(-(-(ran[s] + 1) * total // w), s) for s, w in share.items() if ran[s] * total // w <= t]
            _, s = min(ready)
            if not left[s]:
                break
            out.append(s)
            left[s] -= 1
            ran[s] += 1
            t += 1
            assert all(abs(ran[x] * total - t * w) < total for x, w in share.items())
    return out


def test_schedules():
    draw = random.Random(2)
    for _ in range(150):
        n = draw.randint(1, 6)
        blocks = [draw.randint(0, 50) for _ in range(n)]
        weights = [draw.choice([0, 1, 1, 2, 3, 7, 12]) for _ in range(n)]
        plan, slots = list(mixing.phases(blocks, weights)), {}
        for s, count in enumerate(blocks):
            mine = [p for p in plan if s in p.slots]
            for b in range(count):
                p = [p for p in mine if p.first[s] <= b][-1]
                k = b - p.first[s]
                slots[p.start + k // len(p.slots[s]) * p.period + int(p.slots[s][k % len(p.slots[s])])] = s
        assert [slots[t] for t in range(sum(blocks))] == plain_schedule(blocks, weights)


def test_a_mix_follows_its_schedule(spark):
    sizes = {"a": 500, "b": 130, None: 70, "c": 3}
    rows = [(1000 * k + i, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mixed(docs, {"a": 2, "b": 3, None: 1}, block=10).collect()
    assert sorted(r["row"]["doc_id"] for r in got) == sorted(i for i, _ in rows)
    assert len({r["position"] for r in got}) == len(got)
    names = ["a", "b", "c", None]
    order = plain_schedule([50, 13, 1, 7], [2, 3, 0, 1])
    assert {r["slot"]: r["row"]["source"] for r in got} == dict(enumerate(names[s] for s in order))


@pytest.mark.parametrize("n", [999, 1001, 4000])
def test_any_number_of_sources(spark, n):
    """One large source and many small ones: every row once, and the large one within a block of its share while all last."""
    small = [(1_000_000 + i, f"s{i % n}") for i in range(2 * n)]
    rows = [(i, "large") for i in range(3000)] + small
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = sorted((r["position"], r["slot"], r["row"]["doc_id"]) for r in mixing.mixed(docs, block=4).collect())
    assert sorted(i for _, _, i in got) == sorted(i for i, _ in rows)
    assert len({p for p, _, _ in got}) == len(rows)
    slots = sorted({s for _, s, _ in got})
    assert slots == list(range(3000 // 4 + n))
    share = 3000**0.5 / (3000**0.5 + n * 2**0.5)
    ran, large = 0, {s for _, s, i in got if i < 3000}
    for t in range(n // 2):
        ran += t in large
        assert abs(ran - share * (t + 1)) < 1 + 0.05 * (t + 1)


def test_given_weights_of_many_sources_and_those_without(spark):
    rows = [(i, f"s{i % 2500}") for i in range(5000)] + [(9000 + i, "big") for i in range(400)] + [(9900, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    targets = {"big": 1250, None: 0} | {f"s{k}": 1 for k in range(1250)}
    got = [(r["slot"], r["row"]["source"]) for r in mixing.mixed(docs, targets, block=2).collect()]
    assert len(got) == len(rows) and sorted({s for s, _ in got}) == list(range(2500 + 200 + 1))
    weighted = {s for s, source in got if source in targets and source}
    assert weighted == set(range(1250 + 200))
    big, ran = {s for s, source in got if source == "big"}, 0
    for t in range(400):
        ran += t in big
        assert abs(ran - (t + 1) / 2) < 1


# ---- benchmark -------------------------------------------------------------------------------


def test_benchmark_passages_are_found_and_other_documents_are_not(spark, small, texts):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = {r["item_id"]: words_of(r["text"]) for r in benchmark.collect()}
    draw = random.Random(4)
    plain = [t for t in texts.values() if t and len(t) > 600]
    planted = []
    for k, (item, words) in enumerate(items.items()):
        host = words_of(plain[k % len(plain)])
        kept = [w for w in words if draw.random() > 0.15] if k % 2 else words
        planted.append((5000 + item, " ".join([*host[:40], *kept, *host[40:]])))
    docs = small.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in contamination(docs, benchmark).collect()}
    found = [i for i, _ in planted if got[i]["contaminated"]]
    assert len(found) >= 0.9 * len(planted)
    assert all(got[5000 + i]["contaminated"] for k, i in enumerate(items) if k % 2 == 0)
    spelled = {i: f" {' '.join(words_of(t))} " for i, t in texts.items()}
    holds = {i for i, t in spelled.items() if any(f" {' '.join(w)} " in t for w in items.values())}
    assert {i for i in texts if got[i]["contaminated"]} == holds
