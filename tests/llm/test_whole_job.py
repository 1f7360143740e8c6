import random
from itertools import combinations

from roadloom.llm import decontamination, licenses


def agreeing(words, item):
    """Whether the item overlaps by the rule on some diagonal, whatever the seeds."""
    long = min(13, len(item))
    need = long if len(item) < 8 else 0.8 * long - 1e-9
    for d in range(-len(item), len(words)):
        same = [0 <= d + k < len(words) and words[d + k] == w for k, w in enumerate(item)]
        if any(d + p >= 0 and d + p + long <= len(words) and sum(same[p : p + long]) >= need for p in range(len(item) - long + 1)):
            return True
    return False


def test_leaks_by_the_rule_alone():
    item = lambda n, c: [f"{c}{k}" for k in range(n)]
    for n in (1, 2, 5, 7, 8, 9, 10, 11, 12, 13, 14, 15, 18):
        index = decontamination.Index([(n, item(n, "w")), (99, item(9, "v")), (100, item(40, "u"))])
        for gone in (0, 1, 2, 3, 4):
            for places in combinations(range(n), gone) if gone < 4 or n == 15 else ():
                words = ["x", *("x" if k in places else w for k, w in enumerate(item(n, "w"))), "x"]
                assert (0 in [k for k, *_ in index.overlaps(" ".join(words))]) == agreeing(words, item(n, "w")), (n, places)
    rng = random.Random(6)
    for _ in range(1500):
        items = [[rng.choice("abc") for _ in range(rng.randint(1, 16))] for _ in range(3)]
        words = [rng.choice("abcx") for _ in range(rng.randint(0, 30))]
        index = decontamination.Index(list(enumerate(items)))
        assert [k for k, *_ in index.overlaps(" ".join(words))] == [k for k, t in enumerate(items) if agreeing(words, t)]


def test_notices_over_lines_and_scattered_words(spark):
    rows, want = [], {}
    for k, (label, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        words = text.split()
        for j, before in enumerate((0, 7, 23, 200)):
            wrapped = "\n".join(" ".join(words[i : i + 4]) for i in range(0, len(words), 4))
            rows.append((10 * k + j, "lorem " * before + wrapped + " ipsum" * 60))
            want[10 * k + j] = label
        rows.append((10 * k + 9, " ".join(w + " lorem" * 9 for w in words)))
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (want[r.doc_id] in r.labels.split(",") and r.score == 1) if r.doc_id in want else not any(x in licenses.TEMPLATES for x in r.labels.split(",")), r
