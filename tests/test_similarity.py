import random

from lectern.operators.similarity import components, minhash_groups


def test_components_against_brute_force(spark):
    dice = random.Random(8)
    links = [(f"n{dice.randrange(60):02d}", f"n{dice.randrange(60):02d}") for _ in range(40)] + [(f"p{k:02d}", f"p{k + 1:02d}") for k in range(30)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for e in links if e[0] != e[1] for x in e}
    assert {r.node: r.group for r in components(spark.createDataFrame(links, "a string, b string")).collect()} == want


def test_only_verified_strings_meet(spark):
    rows = ["i must decline to answer", "i must decline to answers", "the map of the northern coast", "the map of the northern coasts", "something else entirely", None, ""]
    got = {r.t: r.group for r in minhash_groups(spark.createDataFrame([(t,) for t in rows], "t string"), "t").collect()}
    assert got[rows[0]] == got[rows[1]] == rows[0] and got[rows[2]] == got[rows[3]] and got[rows[4]] == rows[4] and got[""] == ""
    assert minhash_groups(spark.createDataFrame([], "t string"), "t").count() == 0


def test_every_similar_pair_is_linked(spark):
    # one-letter changes of a few phrases, many of which share buckets with strings unlike them
    from lectern.operators.similarity import similar_groups

    dice = random.Random(5)
    rows = {"", "a", "ab", "yes", "不能回答"}
    for phrase in ("i am afraid that this cannot", "the keeper of the northern lamp", "je ne peux pas répondre ici", "abababababababababab"):
        for _ in range(60):
            at, text = dice.randrange(len(phrase)), phrase
            for _ in range(dice.randrange(5)):
                text, at = text[:at] + dice.choice("abc ") + text[at + 1 :], dice.randrange(len(text))
            rows.add(text)
    rows = sorted(rows)
    grams = {t: {f"  {t}  "[k : k + 3] for k in range(len(t) + 2)} for t in rows}
    group = {t: t for t in rows}
    for a in rows:
        for b in rows:
            if a < b and 10 * len(grams[a] & grams[b]) >= 8 * len(grams[a] | grams[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {t: low if g == high else g for t, g in group.items()}
    got = {r.t: r.group for r in similar_groups(spark.createDataFrame([(t,) for t in rows], "t string"), "t").collect()}
    assert got == group and len(set(group.values())) < len(rows)
    # MinHash, measured against the exact groups: of all pairs that share a group it keeps nine in ten at least
    near = {r.t: r.group for r in minhash_groups(spark.createDataFrame([(t,) for t in rows], "t string"), "t").collect()}
    same = [(a, b) for a in rows for b in rows if a < b and group[a] == group[b]]
    kept = sum(near[a] == near[b] for a, b in same)
    assert kept >= 0.9 * len(same) and all(group[a] == group[g] for a, g in near.items()), kept / len(same)
