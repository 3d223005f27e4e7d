"""Each operator against its plain re-statement, on the smallest test tables."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from gradelake.llm import (
    attention, embeddings, html, language, licenses, lm, mixing, packing, quality, simhash, tokens,
)
from gradelake.llm.registry import QUERIES
from gradelake.llm.vocab import default_path, load_tokenizer
from tests.llm import brute
from tests.oracle_check import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def run(spark, number):
    name = next(n for n in QUERIES if n.startswith(f"op{number}_"))
    return QUERIES[name](spark, FOLDER).collect()


def test_quality(spark, texts):
    rows = run(spark, 1)
    assert len(rows) == len(texts)
    for r in rows:
        found = (
            r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
            r["base_failed"],
        )
        assert found == brute.base_signals(texts[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)
    labels = {
        r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    }
    clean = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert all(clean)


def test_quality_ratio(spark):
    """The score is the mean log ratio of hashed n-grams, all of it recomputed here."""

    def bucket(*parts):  # XXH64, each word seeded by the hash of the one before
        found = 42
        for part in parts:
            found = xxhash.xxh64_intdigest(part.encode(), seed=found)
        return (found - (found >> 63 << 64)) % 64

    rows = [(i, f"a b c{i % 3}" * (i % 4 + 1)) for i in range(20)] + [(50, "zz ## zz ##")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    weights = quality.bucket_weights(docs, quality.trusted_ids(labels), 64)
    grams = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0d]+", text)
        grams[i] = [bucket(w) for w in words] + [bucket(*p) for p in itertools.pairwise(words)]
    raw, target = Counter(), Counter()
    for i, found in grams.items():
        raw.update(found)
        if i < 10:
            target.update(found)
    expected = [
        math.log((target[b] + 1) / (sum(target.values()) + 64))
        - math.log((raw[b] + 1) / (sum(raw.values()) + 64))
        for b in range(64)
    ]
    assert weights == pytest.approx(expected)
    scored = docs.select("doc_id", quality.signals(docs["text"], weights)["score"]).collect()
    for i, score in scored:
        assert score == pytest.approx(np.mean([expected[b] for b in grams[i]]))


@pytest.mark.parametrize("seed", range(3))
def test_repeated_words(spark, seed):
    draw = np.random.default_rng(seed)
    rows = [
        (i, " ".join(draw.choice(list("abc"), draw.integers(0, 30)))) for i in range(60)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = docs.select("text", quality.let(
        quality.words(docs["text"]), quality.repeated_words
    )).collect()
    assert [n for _, n in found] == [brute.base_signals(t)[4] for t, _ in found]


def test_licenses(spark):
    problems = compare(
        spark, duck(FOLDER), QUERIES["op2_license_scans"], licenses.oracle(), FOLDER
    )
    assert problems == []


def test_license_notices_with_losses(spark):
    gpl = licenses.NOTICES["GPL-3.0"][1].split()
    rows = []
    for at in range(0, len(gpl), 3):
        for lead in range(4):
            changed = [*gpl[:at], "other", *gpl[at + 1 :]]
            rows.append((len(rows), " ".join(["x"] * lead + changed + ["y"] * 7)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    shingles = {tuple(gpl[i : i + 5]) for i in range(len(gpl) - 4)}
    for i, text in rows:
        words = [w.strip(".,:/").lower() for w in text.split()]
        plain = [re.sub(r"[^a-z0-9]", "", w) for w in words]
        held = {tuple(plain[k : k + 5]) for k in range(len(plain) - 4)}
        wanted = {tuple(re.sub(r"[^a-z0-9]", "", w.lower()) for w in s) for s in shingles}
        if "andor" in plain and len(held & wanted) / len(wanted) >= 0.85:
            assert i in found


def test_html(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    import html as entities

    for r in run(spark, 3):
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        parts = re.split(r"<p>|</p>|</h1>", article.replace("<br>", " "))
        plain = [" ".join(entities.unescape(re.sub("<[^>]*>", "", p)).split()) for p in parts]
        assert r["text"] == "\n".join(p for p in plain if p)
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("seed", range(5))
def test_minimum_cut(seed):
    draw = np.random.default_rng(seed)
    for _ in range(60):
        n = int(draw.integers(1, 9))
        gains = draw.normal(0, 1.5, n).round(2).tolist()
        edges = [
            (int(a), int(b), float(w))
            for a, b, w in zip(
                draw.integers(0, n, 2 * n), draw.integers(0, n, 2 * n),
                draw.uniform(0, 2, 2 * n).round(2), strict=True,
            )
        ]

        def cost(label, gains=gains, edges=edges):
            lost = sum(max(g, 0) if not s else max(-g, 0) for g, s in zip(gains, label, strict=True))
            return lost + sum(w for a, b, w in edges if a != b and label[a] != label[b])

        best = min(
            cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n)
        )
        assert cost(html.minimum_cut(gains, edges)) == pytest.approx(best)


def test_language(spark, docs, texts):
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = run(spark, 4)
    assert len(rows) == len(texts)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (brute.crc(r["doc_id"]) % 3 == 1) for r in rows)
    right = sum(r["lang_pred"] == lang[r["doc_id"]] for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_cross_parsing_counts():
    draw = np.random.default_rng(3)
    sample = bytes(draw.choice(list(b"ab c"), 300).tolist())
    automaton = language.Automaton(sample)
    for _ in range(40):
        text = bytes(draw.choice(list(b"ab cd"), draw.integers(1, 60)).tolist())
        block = np.frombuffer(text, np.uint8)[None, :]
        found = automaton.phrases(block, np.ones(len(text), np.int64))
        assert found[0] == brute.phrases(sample, text)


def test_simhash(spark, texts):
    expected = brute.simhash_components(texts)
    rows = run(spark, 5)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == expected


@pytest.mark.parametrize("distance", [1, 2])
@pytest.mark.parametrize("crowd", [1, 64])
def test_simhash_links(spark, monkeypatch, distance, crowd):
    monkeypatch.setattr(simhash, "PAIRED_BUCKET", crowd)
    draw = np.random.default_rng(distance)
    seeds = draw.integers(-(2**63), 2**63 - 1, 12)
    fps = set(seeds.tolist())
    for seed in seeds[:6].tolist():
        for _ in range(40):
            flips = 0
            for b in draw.integers(0, 62, draw.integers(1, 4)).tolist():
                flips ^= 1 << b
            fps.add(seed ^ flips)
    fps = sorted(fps)
    pairs = [
        (a, b) for k, a in enumerate(fps) for b in fps[k + 1 :]
        if bin((a ^ b) & (2**64 - 1)).count("1") <= distance
    ]
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.links(frame, distance).collect()
    assert {tuple(sorted(x)) for x in map(tuple, links)} <= set(pairs)
    assert brute.find_roots(fps, [tuple(x) for x in links]) == brute.find_roots(fps, pairs)


def test_thresholds_cover_every_pair():
    draw = np.random.default_rng(0)
    for parts in (2, 3, 4):
        costs = [[0.0, *np.sort(draw.uniform(1, 9, 3)).tolist()] for _ in range(parts)]
        cost, chosen = simhash.allocate(costs, 2)
        assert sum(chosen) == 2 - parts + 1
        assert cost == pytest.approx(sum(c[t + 1] for c, t in zip(costs, chosen, strict=True)))


def test_mixing(spark, docs, texts):
    rows = run(spark, 6)
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in rows:
        size = len(brute.WORD.findall(texts[r["doc_id"]]))
        assert r["size"] == size and r["taken"] in (0, size, 2 * size, 3 * size)
        name = source[r["doc_id"]]
        sizes[name] += size
        taken[name] += r["taken"]
        longest[name] = max(longest[name], size)
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    expected = brute.targets(sizes, weights)
    for r in rows:
        assert r["target"] == pytest.approx(expected[source[r["doc_id"]]])
        assert r["source_size"] == sizes[source[r["doc_id"]]]
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= longest[s]
    assert sum(taken.values()) == pytest.approx(sum(sizes.values()), rel=0.05)
    assert sorted(map(tuple, run(spark, 6))) == sorted(map(tuple, rows))


def test_embeddings(spark):
    draw = np.random.default_rng(5)
    base = draw.standard_normal((60, 16))
    rows = [b + 0.1 * draw.standard_normal(16) for b in base for _ in range(draw.integers(1, 9))]
    rows += [rows[0].copy() for _ in range(50)]
    frame = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>"
    )
    units = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    linked = units @ units.T >= 0.95
    np.fill_diagonal(linked, False)
    pairs = [(int(a), int(b)) for a, b in zip(*np.nonzero(linked), strict=True)]
    roots = brute.find_roots(range(len(rows)), pairs)
    found = embeddings.near_duplicates(frame).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["component_id"] == roots[r["vec_id"]]
        assert r["n_links"] == linked[r["vec_id"]].sum()
        assert r["kept"] == (r["vec_id"] == r["component_id"])


def test_links_over_tiles(spark):
    draw = np.random.default_rng(6)
    units = draw.standard_normal((90, 4))
    units /= np.linalg.norm(units, axis=1)[:, None]
    copies = draw.integers(1, 4, 90)
    members = spark.createDataFrame(
        [(7, i, int(c), bytearray(u.tobytes()))
         for i, (u, c) in enumerate(zip(units, copies, strict=True))],
        "root long, node long, copies long, unit binary",
    )
    linked = units @ units.T >= 0.3
    np.fill_diagonal(linked, False)
    for tile in (8, 64, 1000):
        found = embeddings.member_links(members, 0.3, tile).collect()
        assert {r["node"]: r["n_links"] for r in found} == dict(enumerate((linked @ copies).tolist()))


def test_token_counts(spark, texts):
    tokenizer = load_tokenizer(default_path(tokens.TOKENIZER))
    for r in run(spark, 8):
        text = texts[r["doc_id"]]
        n = len(tokenizer.encode(text, add_special_tokens=False))
        assert (r["n_tokens"], r["n_bytes"]) == (n, len(text.encode()))
        assert r["over_limit"] == (n > 1024)


def test_resynchronised_counts():
    counter = tokens.Counter(default_path(tokens.TOKENIZER))
    draw = np.random.default_rng(8)
    alphabet = [
        "a", "bc", " ", "\n", "  ", "é", "12", ".", "'s", "<|endoftext|>", "<|endo", "\t", "日本",
        "x" * 40, " ",
    ]
    for _ in range(400):
        text = "".join(draw.choice(alphabet, draw.integers(0, 90)))
        n = len(counter.tokenizer.encode(text, add_special_tokens=False))
        assert counter.count([text]) == [n]
        chunk, overlap = int(draw.integers(1, 30)), int(draw.integers(1, 40))
        assert counter.resynchronised(text, chunk, overlap) == n


def test_scores(spark, texts):
    lowered = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t) for i, t in texts.items()}
    words = {i: [*brute.WORD.findall(t), "\x00end"] for i, t in lowered.items()}
    counts = Counter()
    for i, found in words.items():
        if brute.crc(i) % 7 != 2:
            counts.update(found)
    total, distinct = sum(counts.values()), len(counts)
    rows = run(spark, 9)
    assert len(rows) == len(texts)
    for r in rows:
        found = words[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in found)
        assert r["held_out"] == (brute.crc(r["doc_id"]) % 7 == 2)
        assert (r["n_tokens"], r["train_tokens"]) == (len(found), total)
        assert r["n_known"] == sum(counts[w] > 0 for w in found)
        assert r["base_score"] == pytest.approx(base)
        assert r["score"] < 0


def test_open_head_and_math():
    prose = "One long sentence, of many words, that is surely content of this page. " * 3
    body = f"<article><p>{prose}</p><p>Here <math><mi>x</mi><mo>=</mo></math> holds.</p></article>"
    for page in (f"<html><head><title>T</title><body>{body}", f"<head><meta a=b>{body}"):
        found = html.main_text(page)
        assert prose.strip() in found and "x=" in found and "T" not in found.split()
    assert "x=" in html.main_text(f"<head><title>T</title></head><body>{body}</body>")


def test_scores_learn_from_whole_texts(spark):
    """What lies behind the first 4,000 characters of a long text is learned from as well."""
    head = "alpha beta gamma delta " * 200
    tails = ["river stone " * 300, "river " * 300 + "stone " * 300]
    asked = next(i for i in range(100, 200) if brute.crc(i) % 7 == 2)
    found = []
    for tail in tails:  # the same words equally often, in another order
        rows = [(i, head + tail) for i in range(8)] + [(asked, "river stone " * 20)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        scored = {r["doc_id"]: r for r in lm.score(docs).collect()}
        found.append(scored[asked])
    assert found[0]["base_score"] == pytest.approx(found[1]["base_score"])
    assert found[0]["score"] > found[1]["score"] + 1


def test_every_window_is_learned_from(spark, docs, texts):
    rows = lm.blocked(docs)
    found = lm.windows(rows, lm.block_words(rows, default_path(lm.TOKENIZER)), 1, 1).collect()
    learned = Counter()
    for r in found:
        weight = lm.unpacked(r["ids"])[3]
        assert len(weight) == r["n"]
        learned[r["doc_id"]] += int(weight.sum())
    coder = load_tokenizer(default_path(lm.TOKENIZER))
    trained = {i: t for i, t in texts.items() if brute.crc(i) % 7 != 2}
    assert set(learned) == set(trained)
    for i, text in list(trained.items())[:40]:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
        ids = [len(coder.encode(w, add_special_tokens=False)) for w in words]
        assert learned[i] == sum(ids) + 1


def test_attention_model():
    """Batched windows give every token the probability that one token at a time gives it."""
    draw = np.random.default_rng(2)
    texts = [draw.integers(0, 200, n) for n in (0, 1, 15, 16, 17, 70)]
    counts = np.bincount(np.concatenate(texts), minlength=300)
    weights = [np.ones(len(t) + 1, np.float32) for t in texts]
    model = attention.train(texts, weights, counts, 298, 299, steps=30)
    inputs, targets, owner = attention.layout(texts, 298, 299)
    scores = model.score(inputs, targets)
    assert [int((owner == k).sum()) for k in range(len(texts))] == [len(t) + 1 for t in texts]
    share = 10.0 ** model.within
    size = attention.BLOCK
    for k, text in enumerate(texts):
        seen = np.concatenate([np.full(size + 1, 298), text])
        expected = []
        for i in range(len(text) + 1):
            at = size + i
            first = at - at % size - size
            q = model.query[seen[at]]
            keys = np.arange(first, at + 1)
            w = np.exp(model.key[seen[keys]] @ q + model.distance[at - keys])
            hidden = w @ model.value[seen[keys]] / w.sum() + model.own[seen[at]]
            logits = np.maximum(hidden, 0) @ model.out + model.bias
            p = np.exp(logits - logits.max())
            p = (p / p.sum())[model.of] * share
            assert p.sum() == pytest.approx(1, abs=1e-3)
            expected.append(np.log10(p[text[i] if i < len(text) else 299]))
        assert scores[owner == k] == pytest.approx(expected, abs=1e-3)


def test_scores_are_the_model_s_own(spark, monkeypatch):
    """Every score is the sum of one-token-at-a-time probabilities of the fitted model."""
    models = []
    fitted = lm.fitted
    monkeypatch.setattr(lm, "fitted", lambda *a: models.append(fitted(*a)) or models[-1])
    draw = np.random.default_rng(3)
    vocabulary = ["alpha", "beta", "gamma", "unheard-of", "zzqx"]
    texts = {i: " ".join(draw.choice(vocabulary, i % 40)) for i in range(30)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in lm.score(frame).collect()}
    (model,) = models
    coder = load_tokenizer(default_path(lm.TOKENIZER))
    share, size = 10.0**model.within, attention.BLOCK
    for i, text in texts.items():
        ids = [k for w in text.split() for k in coder.encode(w, add_special_tokens=False).ids]
        seen = np.array([lm.START] * (size + 1) + ids)
        total = 0.0
        for k, target in enumerate([*ids, lm.END]):
            at = size + k
            keys = np.arange(at - at % size - size, at + 1)
            q = model.query[seen[at]]
            w = np.exp(model.key[seen[keys]] @ q + model.distance[at - keys])
            hidden = w @ model.value[seen[keys]] / w.sum() + model.own[seen[at]]
            logits = np.maximum(hidden, 0) @ model.out + model.bias
            p = np.exp(logits - logits.max())
            total += math.log10(p[model.of[target]] / p.sum() * share[target])
        assert found[i] == pytest.approx(total, abs=1e-2, rel=1e-3)


def check_packing(rows, expected, capacity=packing.CAPACITY):
    """Pieces restore every document's ids, and sequences are filled without gaps."""
    pieces = brute.by(rows, "doc_id")
    assert set(pieces) == set(expected)
    for i, ids in expected.items():
        found = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in found] == list(range(-(-len(ids) // capacity)))
        for r in found:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == capacity * r["piece"] and len(part) == r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for members in brute.by(rows, "sequence_id").values():
        members.sort(key=lambda r: r["offset"])
        at = 0
        for r in members:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity


def test_packing(spark, texts):
    tokenizer = load_tokenizer(default_path(packing.TOKENIZER))
    expected = {
        i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()
    }
    rows = run(spark, 10)
    check_packing(rows, expected)
    least = -(-sum(map(len, expected.values())) // packing.CAPACITY)
    assert len({r["sequence_id"] for r in rows}) <= 1.05 * least + 1


def test_sum_of_squares():
    """Each item goes where the sum of squares becomes smallest, by trying all places."""
    draw = np.random.default_rng(4)
    lengths = draw.integers(1, 21, 200)
    bins, offsets = packing.sum_of_squares(lengths, 20)
    level = defaultdict(int)

    def squares():
        gaps = Counter(20 - v for v in level.values() if v < 20)
        return sum(n * n for n in gaps.values())

    for size, at, offset in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        offers = []
        for b in [*level, max(level, default=-1) + 1]:
            if level.get(b, 0) + size <= 20:
                before = level.get(b)
                level[b] = level.get(b, 0) + size
                offers.append(squares())
                if before is None:
                    del level[b]
                else:
                    level[b] = before
        assert offset == level.get(at, 0)
        level[at] = level.get(at, 0) + size
        assert level[at] <= 20 and squares() == min(offers)


def test_pipeline_stages(spark, docs, texts):
    """Every stage against its plain version on its own input."""
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    identified = stages["language_id"](spark, docs, FOLDER).cache()
    letters = {i for i, t in texts.items() if re.search(r"[^\W\d_]", t)}
    assert {r["doc_id"] for r in identified.collect()} == letters
    good = stages["quality_rules"](spark, identified, FOLDER).cache()
    judged = quality.judge(identified, labels).where("kept").collect()
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in judged}
    distinct = stages["simhash_near_dedup"](spark, good, FOLDER).cache()
    groups = brute.simhash_components({r["doc_id"]: r["text"] for r in good.collect()})
    assert sorted(r["doc_id"] for r in distinct.collect()) == sorted({c for _, c in groups.values()})
    mixed = stages["mixing_sources"](spark, distinct, FOLDER).cache()
    copies = Counter(r["doc_id"] for r in mixed.collect())
    for r in mixing.mix_report(distinct).collect():
        assert r["size"] * copies[r["doc_id"]] == r["taken"]
    for stage in (identified, good, distinct, mixed):
        assert stage.columns == docs.columns
    packed = stages["best_fit_packing"](spark, mixed, FOLDER).collect()
    firsts = Counter(r["doc_id"] for r in packed if r["piece"] == 0)
    assert firsts == copies
    assert len(corpus_pipeline.run(spark, FOLDER).collect()) == len(packed)
