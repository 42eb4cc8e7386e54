"""Results against brute force over a small fixture of the given tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionsift.llm import licenses, linededup, lm, minhash, mixing, packing, pii, quality, queries, simhash, vptree
from sessionsift.llm.common import staged
from sessionsift.llm.cuckoo import CuckooFilter
from sessionsift.llm.tokens import cached_tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").repartition(4, "doc_id").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def ascii_lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))


# --- personal data ------------------------------------------------------------------------------------

WORDS = [f"{a}{b}" for a in ("ba", "co", "du", "fe", "gi", "ho", "ju", "ka", "le", "mo") for b in ("lan", "rit", "sem", "tov", "wen", "xor", "yap", "zin")]


def page(rng, n=30):
    return " ".join(rng.choices(WORDS, k=n))


def test_a_code_name_in_different_texts(spark):
    rng = random.Random(1)
    rows = [(k, f"{page(rng)} Codename1 {page(rng, 5)} chief{k % 2}@mail.org {page(rng)}") for k in range(20)]
    rows += [(k, page(rng, 60)) for k in range(20, 300)] + [(k, f"{page(rng)} codename1, without any address: \U0001f600 CODENAME1") for k in (400, 401)]
    rows += [(402, None), (401, rows[-1][1])]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    text = {i: t or "" for i, t in rows}
    got = pii.digest(found).collect()
    assert len(got) == len(rows)
    for r in got:
        want = [f"term:{m.start()}:{m.end()}" for m in re.finditer("codename1", text[r["doc_id"]].lower())]
        want += [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"chief[01]@mail\.org", text[r["doc_id"]])]
        assert r["spans"].split(",") == (sorted(want, key=lambda x: int(x.split(":")[1])) or [""])
        assert r["n_generalised"] + r["n_removed"] == len([w for w in want if w.startswith("term")])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string"), found).collect()}
    assert "odename1" not in clean[0].lower() and "[EMAIL]" in clean[0] and clean[30] == text[30] and clean[402] == ""
    assert "codename1" not in clean[400].lower() and clean[400].count("\U0001f600") == 1


def brute_shares(rows, groups):
    """The estimate by hand: term -> largest share over entities (e-mails only), with the copies given."""
    n = len(rows)
    split = lambda t: {w.lower() for w in re.split(r"[^\w]+|_", t) if w}
    holders = collections.defaultdict(set)
    for i, t in rows:
        for m in re.finditer(r"[\w.]+@[\w.]+[a-z]", t):
            holders[m[0].lower()].add(i)
    out = {}
    for e, docs in holders.items():
        if len({dict(rows)[i] for i in docs}) < 2:
            continue
        n_e = len({groups[i] for i in docs})
        for t in set().union(*(split(dict(rows)[i]) for i in docs)):
            mine = [i for i in docs if t in split(dict(rows)[i])]
            k, n_t = len({groups[i] for i in mine}), sum(t in split(x) for _, x in rows)
            n_t = n_t - len(mine) + k
            if k < 2 or n_e >= n:
                continue
            p, z = k / n_t, 1.96
            low = (p + z * z / (2 * n_t) - z * math.sqrt((p * (1 - p) + z * z / (4 * n_t)) / n_t)) / (1 + z * z / n_t)
            share = math.log2(low * n / n_e) / math.log2(n / n_e)
            both = n_t * n_e / n
            cells = [(k, both), (n_t - k, n_t - both), (n_e - k, n_e - both), (n - n_t - n_e + k, n - n_t - n_e + both)]
            g2 = 2 * sum(o * math.log(o / x) for o, x in cells if o > 0)
            if share >= 0.6 and k > both and g2 >= 3 * math.log(n):
                out[t] = max(share, out.get(t, 0))
    return out


def test_shares_by_hand(spark):
    rng = random.Random(7)
    rows = [(k, f"{page(rng, 20)} secret{k % 5} {'only' + str(k % 3) if k % 2 else ''} {page(rng, 8)} who{k % 5}@x.org {page(rng, 10)}") for k in range(60)]
    rows += [(k, f"{page(rng, 40)} {'secret1' if k % 7 == 0 else ''}") for k in range(60, 400)]
    near = rows[3][1].split()
    for k in range(20):  # near copies of one document count once
        rows.append((500 + k, " ".join([*near[:-1], f"tail{k}"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = staged(pii.base_spans(df), "test-pii")
    got = {r["term"]: r["share"] for r in pii.disclosures(df, found).collect()}
    groups = {i: (3 if i >= 500 else i) for i, _ in rows}
    want = brute_shares(rows, groups)
    assert {t: round(x, 9) for t, x in got.items()} == {t: round(x, 9) for t, x in want.items()} and {"secret0", "secret2"} <= set(got)
    assert not any(t.startswith("tail") for t in got)


def test_copies_flag_no_ordinary_word(spark):
    rng = random.Random(2)
    base = "Please send the papers that came from Miller in Zurich to anna.b@mail.org before the zebra is back, and contact nobody else about it".split()
    rows = [(k, page(rng, 40)) for k in range(200)]
    rows += [(300, " ".join(base)), (301, " ".join(base).replace("papers", "letters")), (302, " ".join(base)), (303, "Zurich and a zebra and Miller")]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert all("term" not in s for s in got.values()) and got[300].startswith("email:")


def test_words_whose_lower_case_is_longer(spark):
    rng = random.Random(3)
    rows = [(k, f"{page(rng)} \u0130stanbul7 {page(rng)} eva@mail.org {page(rng)}") for k in range(12)] + [(k, page(rng, 50)) for k in range(20, 200)]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for k in range(12):
        at = rows[k][1].index("\u0130")
        assert f"term:{at}:{at + 9}" in got[k].split(",")


def test_directory_pages_give_their_terms_once(spark):
    rng = random.Random(4)
    names = [f"Person{i}" for i in range(400)]
    pages = [" ".join(f"{n} {page(rng, 3)} {n.lower()}@dir.org" for n in rng.sample(names, len(names))) for _ in range(2)]
    rows = [(k, page(rng, 30)) for k in range(300)] + [(900 + k, t) for k, t in enumerate(pages)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    flagged = pii.disclosures(df, staged(pii.base_spans(df), "test-pii"))
    assert flagged.count() <= len(names) + 20


def brute_base(text):
    """The base patterns by plain regexes."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans_by_plain_regexes(spark, docs, texts):
    rng = random.Random(5)
    bits = ["a.b", "@", "x-y", ".", "12", "4111 1111 1111 1111", "5500-0000-0000-0004", "+49 (30) 123-4567 89", "255.1.2.3", "256.1.1.1", "001.002.3.4", " ", "-", "\u00e9", "7", "+1", "\U0001f600", "user@host.org", "1.2.3.4.5"]
    odd = {50_000 + k: "".join(rng.choices(bits, k=rng.randrange(14))) for k in range(1500)}
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(odd.items()), "doc_id long, text string"))
    every = {**texts, **odd}
    for r in pii.digest(pii.find(df)).collect():
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute_base(every[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), every[r["doc_id"]]


# --- packing ------------------------------------------------------------------------------------------

def test_token_ids(texts):
    tokenizer = cached_tokenizer(*packing.vocabulary())
    more = ["a  b", "\n\nx y", " lead <|endoftext|>foo bar", "it's we'll 'S", "12 345,6 a_b (x) ... ½ 中文", "a b  c", "tab\tb\r\nc ", "!? ab'cd don't"]
    every = [*texts.values(), *more]
    plain = tokenizer.tokenizer.encode_batch(every, add_special_tokens=False)
    assert [x.tolist() for x in tokenizer.encode(every)] == [e.ids for e in plain]


def test_packing_round_trip(docs, texts):
    rows = packing.pack(docs, with_ids=True).cache()
    tokenizer = cached_tokenizer(*packing.vocabulary())
    want = {i: [*tokenizer.encode([t])[0].tolist(), 2] for i, t in texts.items()}
    got = collections.defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == len(got[r["doc_id"]]) and r["length"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["piece"] == 0 or r["length"] == 1024
        got[r["doc_id"]] += r["ids"]
    assert dict(got) == want
    sequences = packing.sequences(rows).collect()
    assert sum(len(s["ids"]) for s in sequences) == sum(map(len, want.values()))
    assert all(0 < len(s["ids"]) <= 1024 for s in sequences)
    least = math.ceil(sum(map(len, want.values())) / 1024)
    assert len(sequences) <= 1.03 * least + 1


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_plan_holds_every_piece(n):
    rng = np.random.default_rng(n)
    hist = np.bincount(rng.integers(1, 1025, size=n), minlength=1025)
    runs = packing.plan(hist)
    held = np.zeros(1025, dtype=int)
    for r in runs:
        assert sum(r.lengths) <= 1024 and r.count > 0
        np.add.at(held, r.lengths, r.count)
    assert (held == hist).all()


def test_knapsack_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes, values = rng.integers(3, 12, size=4), rng.random(4)
        best = {0: 0.0}
        for room in range(1, 31):
            best[room] = max([best[room - 1], *(best[room - s] + v for s, v in zip(sizes, values) if s <= room)])
        value, counts = packing.best_configuration(sizes, values, 30)
        assert value == pytest.approx(best[30]) and counts @ sizes <= 30 and counts @ values == pytest.approx(value)


# --- licences -----------------------------------------------------------------------------------------

def test_licences(spark, docs, texts):
    notice = licenses.TEMPLATES[14][1]
    planted = {10_001: "intro words " + notice.upper() + " outro", 10_002: notice.replace("any person", "any single person").replace("copy of", "copy"),
               10_003: "permission is hereby granted but nothing else follows here", 10_004: "licensed under cc by 4 0 and all rights reserved, ALL rights\nreserved"}
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(planted.items()), "doc_id long, text string"))
    every = {**texts, **planted}
    for r in licenses.scan(df).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(every[r["doc_id"]]))
        hits = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (r["first_word"], r["last_word"]) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        if r["doc_id"] in (10_001, 10_002):
            assert r["labels"] == "mit" and r["score"] > 0.9
        if r["doc_id"] == 10_001:
            assert (r["licences"][0]["begin"], r["licences"][0]["end"]) == (2, 2 + len(licenses.words_of(notice)))
        if r["doc_id"] == 10_003:
            assert r["labels"] == "" and r["score"] == 0
        if r["doc_id"] == 10_004:
            assert r["labels"] == "cc-by,cc-by-4.0,reserved" and r["n_base"] == 3


def test_licence_with_a_stray_diagonal_between(spark):
    notice = licenses.TEMPLATES[1][1].replace("under the Apache", "under Apache").replace("may not", "may not really")
    df = spark.createDataFrame([(1, notice), (2, f"some words before it: {notice} {notice}")], "doc_id long, text string")
    assert [r["labels"] for r in licenses.scan(df).collect()] == ["apache-2.0"] * 2


# --- language model: large counts -------------------------------------------------------------------------

def test_counts_beyond_32_bits(tmp_path):
    key, n = np.array([5, 9, 2**63], np.uint64), np.array([2**32 + 7, 3, 2**40], np.uint64)
    block = lm.to_block(key, n)
    again = lm.added(*(np.concatenate(x) for x in zip(*[lm.from_block(block, 1)] * 2)))
    lm._save_keyed(str(tmp_path), "word", 0, again[0], again[1:])
    model = lm.Model(str(tmp_path), 1, 0, 0, np.zeros(3), np.zeros(3), 0, (0, 0, 0))
    assert model.values("word", np.array([5, 6, 9, 2**63], np.uint64))[0].tolist() == [2.0**33 + 14, 0.0, 6.0, 2.0**41]


# --- quality ------------------------------------------------------------------------------------------

def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


def slow_features(text):
    """Features of one text by plain loops."""
    raw = text.encode()
    found = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not found:
        return [0.0] * quality.N_FEATURES
    n, chars = len(found), max(len(text), 1)
    count = collections.Counter(found)
    upper, lower = (len(re.findall(p, raw)) for p in (rb"[A-Z]", rb"[a-z]"))
    rates = [math.log1p(20 * raw.count(bytes([b])) / n) for b in range(33, 127) if not chr(b).isalnum()]
    return rates + [
        upper / max(upper + lower, 1), len(re.findall(rb"[0-9]", raw)) / chars, sum(b >= 128 for b in raw) / chars, 10 * raw.count(b"\n") / n,
        len(re.findall(rb"[ \t]", raw)) / chars, sum(map(len, found)) / n / 10, math.log1p(max(map(len, found))) / 5, len(count) / n,
        sum(a == b for a, b in zip(found, found[1:])) / n, max(count.values()) / n, sum(len(w) <= 1 for w in found) / n, sum(w[-1:] in (b"!", b",", b".", b":", b";", b"?") for w in found) / n]


def test_quality_by_plain_loops(spark, docs, texts):
    some = [*list(texts.values())[:60], "", " \n ", "a", "A b  b é\U0001f600!", "x" * 5000]
    assert quality.features_of(pa.array(some, pa.large_string())) == pytest.approx(np.array([slow_features(t) for t in some]))
    # weights: the gradient of the loss over the same pairs vanishes, and no direction does better
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0.3, 1, (80, 6)), rng.normal(0, 1, (60, 6))
    w = quality.bradley_terry(good, bad, pairs=4000)
    again = np.random.default_rng(42)
    diff = good[again.integers(80, size=4000)] - bad[again.integers(60, size=4000)]
    scale = np.concatenate([good, bad]).std(axis=0)
    loss = lambda v: np.logaddexp(0, -(diff @ v)).mean() + 5e-4 * ((v * scale) ** 2).sum()
    assert all(loss(w) < loss(w + step) for step in rng.normal(0, 0.01, (200, 6)))
    # scores from slow features and the model's weights; the threshold's quantile
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels.where(~quality.held_out()))
    for r in quality.scored(docs, labels).collect():
        raw = float(np.dot(slow_features(texts[r["doc_id"]]), model.weights) + model.shift)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-min(max(raw, -500), 500))), abs=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7)
    taught = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["doc_id"] in texts}
    below = sum(1 / (1 + math.exp(-(np.dot(slow_features(texts[i]), model.weights) + model.shift))) < 0.7 for i in taught)
    assert below == sum(q == 0 for q in taught.values())


def test_held_out_rows_do_not_teach(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in quality.scored(docs, x).collect()} for x in (labels, flipped))
    assert a == b


# --- SimHash ------------------------------------------------------------------------------------------

def brute_components(fps, ids):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= 2) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(x, least.get(root(i), x))
    return {x: least[root(i)] for i, x in enumerate(ids)}


def slow_fingerprint(text):
    import xxhash
    w = words(text)
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, texts):
    rows = simhash.simhash_components(docs).collect()
    assert all(r["fp"] % 2**64 == slow_fingerprint(texts[r["doc_id"]]) for r in rows)
    ids = [r["doc_id"] for r in rows]
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_components(np.array([r["fp"] % 2**64 for r in rows], dtype=np.uint64), ids)
    spark_hash = docs.select(F.xxhash64(F.lit("a b c")).alias("h")).first()["h"]  # the same XXH64, seed 42
    import xxhash
    assert spark_hash % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("split_at", [8192, 4])
def test_links_of_crowded_buckets(spark, split_at):
    """Chains and clusters of fingerprints; a low split_at sends every bucket through the finer deal."""
    rng = np.random.default_rng(3)
    fps = []
    for _ in range(30):
        x = int(rng.integers(0, 2**63))
        for _ in range(25):
            for _ in range(int(rng.integers(0, 4))):
                x ^= 1 << int(rng.integers(0, 64))
            fps.append(x)
    fps = np.array(fps, dtype=np.uint64)
    ids = rng.permutation(len(fps)).tolist()
    sig = spark.createDataFrame(list(zip(ids, fps.view(np.int64).tolist())), "doc_id long, fp long")
    got = sig.join(simhash.link_components(sig, split_at=split_at), "fp").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(fps, ids)


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_bit_sliced_pairs(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 2**64 - 1, size=300, dtype=np.uint64)
    fps[100:200] = fps[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64))
    got = {(int(a), int(b)) for i, j in simhash.near_pairs(fps, radius, queries=32, words=2) for a, b in zip(i, j)}
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if int(fps[i] ^ fps[j]).bit_count() <= radius}


# --- language model -----------------------------------------------------------------------------------

def test_kneser_ney(docs, texts):
    rows = lm.score_documents(docs).collect()
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    split = {i: [*words(t), None] for i, t in texts.items()}
    c, pairs = collections.Counter(), collections.Counter()
    for i, w in split.items():
        if not held[i]:
            c.update(w)
            pairs.update(zip(["<begin>", *w], w))
    n, v = sum(c.values()), len(c)
    before = collections.Counter(b for _, b in pairs)
    d = [0.0, *lm._discounts([sum(x == k for x in pairs.values()) for k in (1, 2, 3, 4)])]
    e = [0.0, *lm._discounts([sum(x == k for x in before.values()) for k in (1, 2, 3, 4)])]
    followed, left = collections.Counter(), collections.Counter()
    for (u, _), x in pairs.items():
        followed[u] += x
        left[u] += d[min(x, 3)]
    free = sum(e[min(x, 3)] for x in before.values()) / len(pairs)

    def p(u, w):
        lower = (before[w] - e[min(before[w], 3)]) / len(pairs) + free / (v + 1)
        return (pairs[u, w] - d[min(pairs[u, w], 3)] + left[u] * lower) / followed[u] if followed[u] else lower

    assert sum(p("the", w) for w in c) + p("the", "<unseen>") == pytest.approx(1)  # it is a distribution
    for r in rows:
        w = split[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r["score"] == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["<begin>", *w], w)))


def test_more_shards_same_scores(docs):
    one = {r["doc_id"]: r["score"] for r in lm.scored(docs, lm.train(docs.select("text"))).collect()}
    model = lm.train(docs.select("text"), tokens_per_shard=5000)
    assert model.shards > 5
    many = {r["doc_id"]: r["score"] for r in lm.scored(docs, model).collect()}
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k]) for k in one)


# --- MinHash ------------------------------------------------------------------------------------------

def test_minhash_neighbours(docs, texts):
    rows = {r["doc_id"]: r for r in minhash.with_neighbours(docs, bytes_per_range=40_000).collect()}
    ids = sorted(texts)
    assert sorted(rows) == ids

    def shingles(text):
        w = words(text)
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}

    errors = []
    for i, following in zip(ids, [*ids[1:], ids[0]]):
        t, nxt, r = texts[i], texts[following], rows[i]
        k = len(t) // 4
        edited = t[:len(t) - k] + nxt[:k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(t), shingles(edited), shingles(nxt)
        errors += [r["near_edited"] - len(a & b) / len(a | b), r["near_next"] - len(a & c) / len(a | c)]
        same = [int(r["fingerprint"][x:x + 4], 16) == int(r["edited_fingerprint"][x:x + 4], 16) for x in range(0, len(r["fingerprint"]), 4)]
        assert r["near_edited"] == np.mean(same)
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.25
    by_text = collections.defaultdict(set)
    for i in ids:
        by_text[texts[i]].add(rows[i]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_minhash_query_gives_classes(spark, tmp_path):
    base = " ".join(f"word{k}" for k in range(200))
    rows = [(1, base), (2, "something else altogether, five words and more"), (3, base + " end"), (4, None), (5, base), (6, "w " + base), (7, ""), (None, base)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_minhash(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 1, 6: 1, 7: 4, None: None}


# --- line dedup ---------------------------------------------------------------------------------------

def brute_lines(texts):
    def key(line):
        k = ascii_lower(line.strip(" \t\n\x0b\x0c\r"))
        return k if len(k) >= 20 else None

    holders = collections.defaultdict(set)
    for i, t in texts.items():
        for line in t.split("\n"):
            holders[key(line)].add(i)
    holders.pop(None, None)
    hot = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    return {i: "\n".join(x for x in t.split("\n") if hot.get(key(x), i) == i) for i, t in texts.items()}


def kept_texts(index, docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", index.kept(F.col("text"), F.col("doc_id"))["text"].alias("text")).collect()}


def test_line_dedup_is_reversible(docs, texts):
    old, new = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    first = linededup.LineIndex.build(old, keys_per_shard=2)
    assert first.shards > 1
    start = kept_texts(first, old)
    assert start == brute_lines({i: t for i, t in texts.items() if i % 3})
    both = first.insert(new)
    assert kept_texts(both, docs) == brute_lines(texts)
    assert kept_texts(both.delete(new.select("doc_id")), old) == start


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, size=4000, dtype=np.uint64))
    sieve = CuckooFilter.sized(len(keys))
    assert sieve.insert(keys) and sieve.contains(keys).all()
    assert sieve.contains(rng.integers(0, 2**63, size=20_000, dtype=np.uint64)).mean() < 0.002
    sieve.delete(keys[:2000])
    assert sieve.contains(keys[2000:]).all() and sieve.contains(keys[:2000]).mean() < 0.01


# --- vectors ------------------------------------------------------------------------------------------

@pytest.mark.parametrize(("factor", "least"), [(1.0, 1.0), (1.3, 0.9)])
def test_nearest(spark, factor, least):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = vptree.search(e, e.where("vec_id % 20 = 0"), k=20, factor=factor, shard_rows=150, query_block=10).collect()
    vec = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in e.collect()}
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r["vec_id"])
        assert r["score"] == pytest.approx(float(vec[r["query_id"]] @ vec[r["vec_id"]]), abs=1e-12)
    recall = []
    for q in (i for i in vec if i % 20 == 0):
        best = sorted((i for i in vec if i != q), key=lambda i: (-float(vec[q] @ vec[i]), i))[:20]
        recall.append(len(set(best) & set(got[q])) / 20)
    assert np.mean(recall) >= least


def test_tree_prunes():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c * 50, 1, size=(400, 3)) for c in range(8)])
    tree = vptree.VPTree(x, leaf=32)
    found = tree.search(x[:5], 3, 1.0)
    for q, hits in zip(x[:5], found):
        best = np.argsort(np.linalg.norm(x - q, axis=1))[:3]
        assert set(best) <= set(hits.tolist()) and len(hits) < 400


# --- mixing -------------------------------------------------------------------------------------------

def test_mixing(docs, texts):
    rows = mixing.sampled(docs, rows_per_prefix=20).collect()
    again = mixing.sampled(docs).collect()
    assert sorted((r["row"]["doc_id"], r["copies"]) for r in rows) == sorted((r["row"]["doc_id"], r["copies"]) for r in again)
    sources = collections.defaultdict(list)
    for r in rows:
        sources[r["row"]["source"]].append(r)
    total = sum(r["size"] for r in rows)
    targets, weight = {}, {s: k % 3 + 1 for k, s in enumerate(sorted(sources))}
    rest, stopped = float(total), set()
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in sources if x not in stopped) for s in sources if s not in stopped}
        over = {s for s, x in share.items() if x > 3 * sources[s][0]["source_size"]}
        if not over:
            break
        stopped |= over
        rest = total - sum(3 * sources[s][0]["source_size"] for s in stopped)
    for s, own in sources.items():
        targets[s] = share.get(s, 3.0 * own[0]["source_size"])
        assert own[0]["target"] == pytest.approx(targets[s])
        taken, largest = sum(r["copies"] * r["size"] for r in own), max(r["size"] for r in own)
        assert abs(taken - targets[s]) <= largest
        assert all(r["size"] == len(words(texts[r["row"]["doc_id"]])) for r in own)


# --- near-duplicate classes ---------------------------------------------------------------------------

@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicate_classes(spark, docs, texts, block):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(300)]
    extra, chain = {}, rng.choice(vocabulary, 80).tolist()
    for k in range(12):  # a chain: neighbours are alike, its ends aren't
        extra[20_000 + k] = " ".join(chain)
        chain[(7 * k) % 80] = f"edit{k}"
    extra |= {20_100: "", 20_101: "same short text", 20_102: "same short text"}
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(extra.items()), "doc_id long, text string"))
    every = {**texts, **extra}
    sets = {}
    for i, t in every.items():
        w = words(t)
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    ids = sorted(every)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            a, b = sets[i], sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df, block=block).collect()}
    assert got == {i: root(i) for i in ids}
