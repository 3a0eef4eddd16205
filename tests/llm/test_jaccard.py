import random
import re

import pytest

from gridlake.llm import jaccard
from gridlake.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(k)] = min(doc_id, least.get(root(k), doc_id))
    return sorted((d, len(s), least.get(root(k)) if s else d) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True)) if d is not None)


def families(seed, count, copies, words=60):
    """Texts in families of near copies, with passages shared between families, exact copies and odd texts."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    shared = [" ".join(rnd.choices(vocabulary, k=12)) for _ in range(3)]
    texts = []
    for _ in range(count):
        base = rnd.choices(vocabulary, k=rnd.randint(8, words))
        for _ in range(rnd.randint(1, copies)):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            text = " ".join(own).upper() if rnd.random() < 0.1 else "\n".join(own)
            texts.append(text + (" " + rnd.choice(shared) if rnd.random() < 0.3 else ""))
    texts += ["", None, "  \n", "one", "ONE", "a b c", "a b c d e f", shared[0], shared[0] + " x"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.groups(df).collect() if r.doc_id is not None)


def test_groups_match_brute_force(spark):
    rows = families(1, 40, 8)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", [2, 3])
def test_every_path_at_small_bounds(spark, monkeypatch, seed):
    """Common shingles, many tiles, leaders and blocks of stragglers."""
    for name, value in {"TILE_SETS": 4, "COMMON": 5, "COMMON_HERE": 4, "BLOCK_SETS": 2, "ENTRIES_A_TASK": 200}.items():
        monkeypatch.setattr(jaccard, name, value)
    # Long chains: each text is near the one before it only.
    rnd = random.Random(seed)
    own = [f"c{k}" for k in range(80)]
    chain = []
    for k in range(40):
        own = list(own)
        own[(7 * k) % 80] = f"n{k}"
        if k % 2:
            own[(7 * k + 3) % 80] = f"m{k}"
        chain.append(" ".join(own))
    rows = families(seed, 12, 25)
    rows += [(1000 + k, t) for k, t in enumerate(rnd.sample(chain, len(chain)))]
    assert run(spark, rows, 2) == brute(rows)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(5, text), (5, text), (5, "other words entirely here now"), (None, text), (3, text + " more")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, set string, n int, component_id int")
    got = sorted((r.doc_id, r.component_id) for r in jaccard.groups(df).collect() if r.doc_id is not None)
    assert got == [(3, 3), (5, 3), (5, 3), (5, 5)]
    assert jaccard.groups(df).count() == 5
    assert jaccard.groups(df.limit(0)).collect() == []
    assert [r.component_id for r in jaccard.groups(df.filter("doc_id = 3")).collect()] == [3]


def test_texts_without_an_id_still_connect_others(spark):
    own = [f"w{k}" for k in range(60)]
    near = lambda *gone: " ".join(f"x{k}" if k in gone else w for k, w in enumerate(own))
    rows = [(7, near(30)), (None, near()), (None, near()), (9, near(55))]  # 7 and 9 are linked with the nameless text only
    got = {(r.doc_id, r.component_id) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(7, 7), (9, 7), (None, 7)}
    rows = [(None, near()), (None, near()), (None, near(30)), (None, "quite another text")]
    assert {r.component_id for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {None}
    assert jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == 2


def test_one_row_of_each_group_is_kept(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text), (1, text), (1, "unrelated words that share the id only"), (2, text + " more"), (None, text), (None, ""), (None, ""), (3, None), (3, "z")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, _set string, _key int")
    out = jaccard.keep_one(df)
    assert out.columns == df.columns and out.schema == df.schema
    want = [(1, text), (1, "unrelated words that share the id only"), (None, ""), (None, ""), (3, None), (3, "z")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, want))
    assert jaccard.keep_one(df.limit(0)).collect() == []


def test_threshold_is_exact(spark):
    words = [f"w{k}" for k in range(200)]
    base = " ".join(words[:104])  # 100 shingles
    cut = lambda n: " ".join(words[: 104 - n])
    rows = [(0, base), (1, cut(25)), (2, "z " * 3), (3, " ".join(words[100:180]))]
    assert run(spark, rows) == brute(rows) and run(spark, rows)[1][2] == 0
    rows[1] = (1, cut(26))
    assert run(spark, rows) == brute(rows) and run(spark, rows)[1][2] == 1


def test_components(spark):
    rnd = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    rnd.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
