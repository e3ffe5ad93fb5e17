"""Filter audit against brute force over orders, odd rows included."""

from fractions import Fraction
from itertools import permutations

import pytest

from wardline.llm.filter_audit import audit, kernel_weight, shapley_rows

DOC = "doc_id long, text string, source string, mask string, n long, shares string"
WORDS = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, WORDS, "s"), (2, WORDS, "s"), (3, WORDS, None), (4, None, "s"), (5, "", "t"), (6, "A B C", "t"), (6, "A B C", "t"),
    (None, "A B C", "t"), (None, None, None), (7, "same " * 80, "s"), (8, "same " * 80 + "$", "t"), (9, WORDS.upper() + " |", "s"),
    (9, WORDS.upper() + " |", "t"), (10, WORDS.upper() + " |", "s"), (11, WORDS + " %", "s"), (12, "long " * 200_000, "s"),
    (13, "\n\t " + WORDS + "\x0b", "s"), (14, "é ü " * 60, "t"),
]
LABELS = [(2, 1, 0), (2, 0, 1), (5, 1, None), (9, None, 1), (10, 1, 1), (99, 1, 1), (None, 1, 1)]


def simple(rows, labels):
    fails = []
    for i, text, _ in rows:
        t = text or ""
        w = t.translate({c: " " for c in range(9, 14)}).split(" ")
        w = [x for x in w if x]
        found = {"A"} if len(w) < 50 else set()
        found |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        found |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        found |= {"D"} if set(t) & set("#$%&*|") else set()
        found |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows) else set()
        fails.append(found)
    good, toxic = ({i for i, *m in labels if m[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    for part in {p or "" for *_, p in rows}:
        own = [(i, f) for (i, _, p), f in zip(rows, fails, strict=True) if (p or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                total[name] += len(gone)
                failing = [x for x in own if name in x[1]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(f == {name} for _, f in own),
                                          sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


@pytest.mark.parametrize("n", [0, 3, len(ROWS)])
def test_equal_to_brute_force(spark, n):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in ROWS[:n]], DOC)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
           for r in audit(docs, labels).collect()}
    assert got == simple(ROWS[:n], LABELS) and (len(got) == 1800 if n == len(ROWS) else True)


def test_the_least_squares_solution_is_shapley():
    """Against the mean over orders, for random tables of two to five players; weights are those of the kernel."""
    import random
    rng = random.Random(3)
    assert kernel_weight(5, 1) == Fraction(1, 5) and kernel_weight(5, 2) == Fraction(1, 15)
    for players in (2, 3, 5):
        table = [rng.randrange(1000) for _ in range(1 << players)]
        for i, row in enumerate(shapley_rows(players)):
            orders = list(permutations(range(players)))
            gains = [table[(before := sum(1 << j for j in o[:o.index(i)])) | 1 << i] - table[before] for o in orders]
            assert sum(x * v for x, v in zip(row, table, strict=True)) == Fraction(sum(gains), len(orders))
