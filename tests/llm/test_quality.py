import random
import re

import pyarrow as pa

from newslake.llm import quality as Q


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {i + j for i, g in enumerate(windows) if windows.count(g) > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def texts():
    rng = random.Random(6)
    out = [None, "", " \n\t ", "\n\n", "a", "É é\né", "x\nx\n x\nx ", "#*$%&|<>!", "a b c a b c", "z" * 100_000]
    for _ in range(300):
        out.append("".join(rng.choice(["ab ", "cd ", "Ef\n", "é ", "# ", "...\n", "long words stand here "]) for _ in range(rng.randrange(90))))
    return out


def test_base_against_brute_force(spark):
    t = texts()
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(t)], "doc_id long, text string, k int").repartition(4)
    rows = {r["doc_id"]: r for r in Q.assess(df).collect()}
    for i, x in enumerate(t):
        r, want = rows[i], brute(x)
        assert tuple(r[c] for c in Q.BASE) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert Q.assess(df.limit(0)).count() == 0


def test_verdict_does_not_depend_on_the_order(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    names = [r.__name__ for r in Q.RULES]
    results = [{r["doc_id"]: r["kept"] for r in Q.assess(df, order=o).collect()} for o in (names, names[::-1], names[3:] + names[:3])]
    assert results[0] == results[1] == results[2]
    t = Q.measure(*Q.text_buffers(pa.array(texts())))
    whole = ~Q.base_failed(t.base)
    for rule in Q.RULES:
        whole &= ~rule(t)
    assert [results[0][i] for i in range(len(whole))] == whole.tolist()


def test_prose_is_kept_and_junk_is_not(spark):
    prose = " ".join(f"Word{i} follows another{i} and ends." for i in range(60))
    junk = [prose.replace(" ", "%%% "), prose.upper(), " | ".join("1234" for _ in range(5)) + " 12 | 34 | 56 | 7" * 40, "\n".join(["same line here again"] * 3 + [f"line {i}" for i in range(30)])]
    df = spark.createDataFrame(list(enumerate([prose, *junk[:3]])), "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in Q.assess(df).collect()} == {0: True, 1: False, 2: False, 3: False}


def test_plan_orders_by_rejections_per_cost():
    found = Q.plan(pa.array([t for t in texts() if t]))
    worth = [share / cost for _, cost, share in found]
    assert worth == sorted(worth, reverse=True) and len(found) == len(Q.RULES)
    assert len(Q.plan(pa.array([], pa.string()))) == len(Q.RULES)
