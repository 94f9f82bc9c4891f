import random
import re

import pyarrow as pa

from newslake.llm import licenses as L


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_planted_notices(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(200)]
    docs, want = [], {}
    for d in range(200):
        w = [rng.choice(vocab) for _ in range(rng.randrange(5, 300))]
        name, text = rng.choice(L.TEMPLATES)
        at = rng.randrange(len(w))
        if d % 3:
            words = text.split()
            if d % 3 == 2 and len(words) > 12:  # small changes
                words[len(words) // 2] = "changed"
                words.insert(len(words) // 3, "more")
            head = " ".join(w[:at] + [""])
            body = " ".join(words)
            t = head + body.upper() + "\n" + " ".join(w[at:])
            want[d] = (name, len(head), len(head) + len(re.sub(r"\W+$", "", body)))
        else:
            t = " ".join(w)
        docs.append((d, "é " + t))
    df = spark.createDataFrame([(*x, 0) for x in docs] + [(900, None, 0), (901, "", 0), (902, "All rights " * 20_000, 0), (903, "ALL RIGHTS RESERVED all rights reserved", 0)], "doc_id long, text string, matched int").repartition(4)
    rows = L.scan(df).collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] >= 900) == [903, 903]
    for d, (name, a, b) in want.items():
        own = [r for r in rows if r["doc_id"] == d]
        assert any(r["template"] == name and r["start"] == a + 2 and r["end"] == b + 2 for r in own), (d, name, own)
    assert {r["doc_id"] for r in rows if r["doc_id"] < 900} == set(want)
    assert L.scan(df.limit(0)).count() == 0


def test_alignment_finds_the_longest_common_words():
    rng = random.Random(1)
    for _ in range(50):
        t = " ".join(rng.choice("abcdefghijklmnop") for _ in range(40))
        words = t.split()
        for _ in range(3):
            i = rng.randrange(5, 35)
            if rng.random() < 0.5:
                words[i] = "z"
            else:
                del words[i]
        found = L.find(pa.array([" ".join(["y"] * 9 + words + ["y"] * 9)]), L.Index([("t", t)]), 50)
        assert found and found[0][2] >= lcs(t.split(), words) - 2 and found[0][2] <= lcs(t.split(), words)


def test_whole_and_partial_texts():
    assert {"Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"} == set(L.TEXTS)
    index = L.Index(L.TEMPLATES)
    for name, text in L.TEXTS.items():
        parts = [n for n, _ in L.parts_of(name, text)]
        lines = text.split("\n")
        half = "\n".join(lines[len(lines) // 2:])
        found = L.find(pa.array(["before " + text + " after", "before " + half]), index, 80)
        of = lambda row: {index.names[t] for r, t, *_ in found if r == row}
        # A part of LGPL 3 lies in a match of GPL 3 with more words.
        assert set(parts) - of(0) <= {"LGPL-3.0-text-13/14"}, (name, set(parts) - of(0))
        assert len(set(parts) & of(1)) >= len(parts) // 2 - 1, name
    assert L.find(pa.array([" ".join(t for t in L.TEXTS["GPL-3.0"].split()[::2]), "the terms of the license and of this software " * 50]), index, 80) == []


def test_notices_of_other_licences():
    index = L.Index(L.TEMPLATES)
    names = ["AGPL-3.0-header", "AGPL-3.0-network", "EPL-2.0-header"]
    found = L.find(pa.array([dict(L.TEMPLATES)[n] for n in names]), index, 80)
    assert [(r, index.names[t]) for r, t, *_ in found] == list(enumerate(names))
