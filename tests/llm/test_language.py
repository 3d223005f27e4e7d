"""Language samples and whole predictions against a plain cross-parse."""

from __future__ import annotations

import zlib

import pytest

from gradelake.llm import language

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark long, cuts long"


def training(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 != 1


def plain_phrases(data, sample):
    """Greedy longest matches in the sample, piece by piece."""
    count = 0
    for at in range(0, len(data), language.PIECE):
        piece, k = data[at : at + language.PIECE], 0
        while k < len(piece):
            size = 1
            while k + size < len(piece) and piece[k : k + size + 1] in sample:
                size += 1
            count += 1
            k += size
    return count


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, 2, 3) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    english = "the river runs past the old mill and then on to the sea where boats lie "
    spanish = "el río pasa junto al viejo molino y luego sigue hasta el mar donde hay barcos "
    german = "der Fluß fließt an der alten Mühle vorbei und dann weiter zum Meer hin "
    rows = []
    for i in range(60):
        lang, text = [("en", english), ("es", spanish), ("de", german)][i % 3]
        words = text.split()
        rows.append((i, " ".join(words[(i + k) % len(words)] for k in range(8 + i % 40)), lang))
    rows += [(100, english * 200, "en"), (101, "123 456", "en"), (102, None, "es"),
             (103, "", "de"), (104, "¡mar! río-barcos, молоко", None), (105, "X", None),
             (None, spanish, "es"), (3, german, "de"), (3, german, "de")]
    return rows


def test_whole_predictions(spark, docs):
    frame = rows_of(spark, docs)
    samples = language.learn(frame)
    assert set(samples) == {"en", "es", "de"}
    found = language.identify(frame).collect()
    assert len(found) == len(docs)
    expected = []
    for doc_id, text, _ in docs:
        held_out = doc_id is not None and not training(doc_id)
        if not text or not any(c.isalpha() for c in text):
            expected.append((doc_id, held_out, "und", 0.0))
            continue
        data = language.normalise(text)
        counts = sorted((plain_phrases(data, s), name) for name, s in samples.items())
        score = max(0.0, 1 - counts[0][0] / counts[1][0])
        expected.append((doc_id, held_out, counts[0][1], pytest.approx(score)))
    mine = sorted([(r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in found],
                  key=lambda r: (repr(r[0]), r[2]))
    theirs = sorted(expected, key=lambda r: (repr(r[0]), r[2]))
    assert [r[:3] for r in mine] == [r[:3] for r in theirs]
    assert all(a[3] == b[3] for a, b in zip(mine, theirs, strict=True))


def code(n):
    """A number in letters, as digits are no part of a sample."""
    return "".join(chr(97 + n // 26**k % 26) for k in range(3))


def test_sample_comes_from_all_rows_and_places(spark):
    """One long text in a language of many rows fills no more than its share."""
    rows = [(i, " ".join(f"q{code(i)}q{code(k)}" for k in range(400)), "en") for i in range(40)]
    long = next(i for i in range(500, 600) if training(i))
    rows.append((long, " ".join(f"é{code(k)}" for k in range(60_000)), "en"))
    used = [i for i, _, _ in rows if training(i)]
    sample = language.learn(rows_of(spark, rows), 128, 24_000)["en"]
    assert 0.8 * 24_000 < len(sample) < 1.3 * 24_000
    assert min(sample.count(f"q{code(i)}q".encode()) for i in used[:-1]) > 0
    assert 0 < sample.count("é".encode()) < len(sample.split()) / 8
    # Not only beginnings: late words are in it too.
    assert any(f"q{code(k)}".encode() in sample for k in range(300, 400))


def test_sample_of_short_and_equal_rows(spark):
    a, b, c = [i for i in range(50) if training(i)][:3]
    rows = [(a, "uno dos", "es")] * 5 + [(a, "tres cuatro", "es"), (b, "cinco", "es"), (c, "12", "es")]
    sample = language.learn(rows_of(spark, rows))["es"]
    for text in ("uno dos", "tres cuatro", "cinco"):
        assert sample.count(text.encode()) == 1
    assert language.learn(rows_of(spark, [(a, "12", "es"), (b, None, "fr")])) == {}


def test_sample_repeats(spark, docs):
    """The same rows in another order give the same sample."""
    frame = rows_of(spark, docs)
    assert language.learn(frame) == language.learn(frame.orderBy("text").repartition(5))
