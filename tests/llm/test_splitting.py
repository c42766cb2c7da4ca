import random

from lectern.llm import splitting as s
from lectern.operators.passages import tokens_of


def sound(text, limit, overlap):
    cuts = s.pieces(text, limit, overlap)
    assert "".join(text[a:b] for _, a, b in cuts) == text
    assert all(tokens_of(text[o:b]) <= limit for o, _, b in cuts)
    for (_, a0, b0), (o, a, b) in zip(cuts, cuts[1:]):
        assert b0 == a and o <= a and tokens_of(text[o:a] or "x") <= max(1, overlap)
    return cuts


def test_round_trip_of_random_texts():
    dice = random.Random(2)
    for _ in range(60):
        text = "".join(dice.choice(["word ", "字", "。", ". ", "\n\n", "\r\n", "# H\n", "é", "x" * 30, "，"]) for _ in range(dice.randrange(400)))
        limit = dice.randrange(2, 60)
        sound(text, limit, dice.randrange(0, limit))


def test_cuts_prefer_strong_boundaries():
    text = "Alpha beta gamma. " * 10 + "\n\n## Next\n\n" + "Delta epsilon. " * 12
    cuts = sound(text, 60, 0)
    assert any(text[a:].startswith("## Next") for _, a, _ in cuts)
    assert all(text[:a].endswith((". ", "\n")) for _, a, _ in cuts[1:])


def test_no_boundary_no_loss_and_overlap():
    assert len(sound("x" * 4001, 100, 10)) > 10
    cuts = sound("甲" * 500, 50, 5)
    assert all(a - o == 5 for o, a, _ in cuts[1:])
    assert s.pieces("short", 10, 2) == [(0, 0, 5)] and s.pieces("", 10, 2) == [(0, 0, 0)]
    words = "one two three four five six seven " * 40
    assert all(words[o - 1] == " " for o, a, _ in sound(words, 40, 8)[1:])


def test_table(spark):
    columns = "record string, item_id string, text string, max_tokens int, overlap_tokens int, piece int, start int"
    long = "word " * 500
    rows = [("r", "a", long, 50, 5), ("r", "a", long, 50, 5), ("r", "b", "short", 50, 5), ("r", "c", None, 50, 5), ("r", None, long, 50, 5), ("r", "d", "", 50, 5), ("r", "e", long, None, None), ("r", "f", "word " * 200000, 500, 5)]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], columns)
    out = s.split_oversized(df)
    firsts = sorted(str(r.item_id) for r in out.where("piece = 1").collect())
    assert firsts == ["None", "a", "f"]
    got = out.where("item_id = 'a'").orderBy("piece").collect()
    assert "".join(r.text[r.start - r.overlap_start :] for r in got) == long and got[-1].piece == got[-1].pieces
    assert s.split_oversized(df.limit(0)).count() == 0
