import math
import random

import pytest
from llm_cases import words_of

from wordmend.llm import licenses


def brute(text, threshold=licenses.THRESHOLD, templates=licenses.TEMPLATES):
    words = words_of(text)
    places = sorted(
        (label, at)
        for label, phrase in licenses.PHRASES.items()
        for at in range(len(words))
        if words[at : at + len(phrase.split())] == phrase.split()
    )
    blocks, at = [], 0
    for line in (text or "").split("\n"):
        own = words_of(line)
        for label, notices in templates.items():
            for notice in notices:
                needed = set(words_of(notice))
                shared = len(needed & set(own))
                if needed and shared >= math.ceil(threshold * len(needed) - 1e-9):
                    blocks.append((label, at, len(own), shared / len(needed)))
        at += len(own)
    return len(words), places, sorted(blocks)


def rows_of(found):
    return [
        (r.n_words, sorted((p.label, p.word) for p in r.places), sorted((b.label, b.word, b.words, b.containment) for b in r.blocks))
        for r in found
    ]


def test_real_tables(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in licenses.scan(frame).collect()}
    texts = {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}
    assert rows_of(got[k] for k in texts) == [brute(t) for t in texts.values()]
    assert any(r.blocks for r in got.values())


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_filters_lose_nothing(make, threshold):
    templates = {"t": ["a b c d e f g h", "c d"], "u": ["a a a", ""], "v": ["q r s t u"]}
    lines = ["a b c d e f g", "h g f e d c b a a", "x y z", "", "c", "d d c", "q r s", "s t u r q q", "a"]
    texts = ["\n".join(lines[i:] + lines[:i]) for i in range(len(lines))] + [" ".join(lines)]
    got = {r.doc_id: r for r in licenses.scan(make(*texts), templates=templates, threshold=threshold).collect()}
    assert rows_of(got[i] for i in range(len(texts))) == [brute(t, threshold, templates) for t in texts]


def test_phrases(make):
    texts = ["The MIT license. MIT License", "mit", "license\nmit license", "apache\nlicense, cc-by", "cc", "by mit"]
    got = {r.doc_id: r for r in licenses.scan(make(*texts)).collect()}
    assert rows_of(got[i] for i in range(6)) == [brute(t) for t in texts]
    assert [(p.label, p.word) for p in got[0].places] == [("mit", 1), ("mit", 3)]


def notices_of(make, *texts):
    rows = {r.doc_id: r for r in licenses.scan(make(*texts)).collect()}
    return [sorted(n.label for n in rows[i].notices) for i in range(len(texts))]


def test_wrapped_notices(make):
    labels = sorted(licenses.TEMPLATES)
    notices = [licenses.TEMPLATES[label][0].split() for label in labels]
    around = [f"other{i}" for i in range(40)]
    texts = ["\n * ".join(" ".join((around + w + around)[i : i + 6]) for i in range(0, 80 + len(w), 6)) for w in notices]
    assert notices_of(make, *texts) == [[label] for label in labels]


def test_windows_by_brute_force(make):
    random.seed(1)
    templates = {"t": ["a b c d e f g h"], "u": ["c d a"], "v": ["a a b"]}
    texts = [" ".join(random.choices("abcdefghxyz", k=random.randint(1, 60))) for _ in range(200)]
    rows = licenses.scan(make(*texts), templates=templates).collect()
    for r in rows:
        words, want = words_of(texts[r.doc_id]), {}
        for label, (notice,) in templates.items():
            needed, n = set(notice.split()), math.ceil(len(notice.split()) / licenses.THRESHOLD - 1e-9)
            best = max(len(needed & set(words[i : i + n])) for i in range(len(words)))
            if best >= math.ceil(licenses.THRESHOLD * len(needed) - 1e-9):
                want[label] = best / len(needed)
        got = {}
        for n in r.notices:
            got[n.label] = max(got.get(n.label, 0), n.containment)
        assert got == want


def test_scattered_words_are_no_notice(make):
    filler = " ".join(f"word{i}" for i in range(7000))
    assert notices_of(make, f"all {filler} rights {filler} reserved") == [[]]


def test_similar_notices(make):
    assert notices_of(
        make,
        "Licensed under CC BY 4.0",
        "Released under the license",
        "Released under the BSD license",
        "Licensed under CC BY-NC-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 license",
        "This work is licensed under a Creative Commons Attribution 3.0 license",
        "This work is licensed under the GNU General Public License version 2",
        "This work is licensed under the GNU Lesser General Public License version 3",
    ) == [[]] * 8
    own = {label: texts[0] for label, texts in licenses.TEMPLATES.items()}
    assert notices_of(make, *own.values()) == [[label] for label in own]
    assert notices_of(make, "\n".join(own.values())) == [sorted(own)]


def test_odd_rows(clashing, empty):
    rows = licenses.scan(clashing).collect()
    assert sorted(map(str, rows_of(rows))) == sorted(str(brute(r.text)) for r in clashing.collect())
    assert licenses.scan(empty).count() == 0
