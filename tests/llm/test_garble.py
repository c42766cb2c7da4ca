import random

import pytest

from lectern.llm import garble as g

SENTENCES = [
    "Le témoin prudent préfère la forme de la côte à l’été, où l’on répète le résumé.",
    "Der gläserne Obstgarten schützt die Größe der Küste für den Übersetzer.",
    "El cuaderno del niño señala la canción de la mañana según la tradición.",
    "Хранительница семян собирает цену соли после большого пожара.",
    "残破的索引揭示了读者的耐心，守种人翻译了脚注的用法。",
    "“The naïve translator,” writes Zoë — the café’s keeper — “orders a résumé.”",
    "The margin note describes the ledger of debts by a slow detour.",
]


def corpus(n=400):
    dice = random.Random(1)
    return [" ".join(dice.choice(SENTENCES) for _ in range(3)) for _ in range(n)]


@pytest.fixture(scope="module")
def docs():
    clean = corpus()
    pairs = {1: (0, "utf-8", "cp1252"), 2: (1, "utf-8", "latin-1"), 3: (3, "utf-8", "cp1251"), 4: (2, "utf-8", "mac_roman"), 5: (3, "cp1251", "latin-1"), 6: (3, "koi8-r", "cp1251"), 7: (4, "gb18030", "cp1252"), 8: (4, "utf-8", "gb18030"), 9: (0, "cp1252", "mac_roman"), 10: (5, "cp1252", "utf-8"), 11: (1, "cp1252", "cp437")}
    bad = {k: (SENTENCES[s], SENTENCES[s].encode(w, "ignore").decode(r, "replace")) for k, (s, w, r) in pairs.items()}
    return clean, bad


def test_found_and_restored(spark, docs):
    clean, bad = docs
    rows = [(100 + k, t, 1.0) for k, t in enumerate(clean)] + [(k, t, 1.0) for k, (_, t) in bad.items()]
    rows += [(50, "", 1.0), (51, None, 1.0), (None, bad[1][1], 1.0), (52, "Řehov, Łukosz — 12 °C ± 3, £ 4 ¼ © Ἡ μνήμη ┌──┐ ★ NAÇÃO", 1.0), (53, "LE TÉMOIN PRÉFÈRE LA CÔTE", 1.0), (1, bad[1][1], 1.0)]
    out = g.garbled(spark.createDataFrame(rows, "doc_id bigint, text string, evidence double"), bits=16).collect()
    assert {r.doc_id for r in out} == set(bad) | {None}
    text = {r.doc_id: r.text for r in out}
    for k in (1, 2, 3, 4, 5, 6, 7, 11):
        assert text[k].replace("’", "'") == bad[k][0].replace("’", "'"), k
    assert "守种人翻译了脚注" in text[8] and "naïve" in text[10] and "café" in text[10]


def test_lattice_fills_lost_bytes(docs):
    clean, _ = docs
    import numpy as np

    sketch = np.zeros((3, 1 << 16), np.int64)
    g._count_text(["\n".join(clean)], 16, sketch)
    model = g.Model(sketch)
    data = list("索引揭示了".encode())
    data[8] = -1
    assert g.viterbi(data, {}, "的", model)[0] == "索引揭示了"
    assert g.viterbi([0xE7], {}, "", model) == []
    # two lost bytes in one character, and all three of another
    data[6] = data[7] = -1
    assert g.viterbi(data, {}, "的", model)[0] == "索引揭示了"
    assert g.viterbi(data, {}, "的", model, beam=0)[0] == "索引揭示了"
    lost = list("守种人翻译了脚注".encode("gb18030"))
    lost[4] = lost[5] = lost[9] = -1
    assert g.viterbi(lost, {}, "", model, "gb18030")[0] == "守种人翻译了脚注"


def test_lattice_reads_characters_of_four_bytes():
    import numpy as np

    sketch = np.zeros((3, 1 << 16), np.int64)
    g._count_text(["\n".join(["the seal 🦭 sleeps"] * 30)], 16, sketch)
    data = list("🦭".encode())
    data[2] = -1
    assert g.viterbi(data, {}, "l ", g.Model(sketch)) == ["🦭"]


def test_text_read_as_utf8_by_mistake(spark):
    clean = corpus()
    model = model_of(clean)
    for k, encoding in ((0, "cp1252"), (3, "cp1251"), (4, "gb18030")):
        bad = SENTENCES[k].encode(encoding, "ignore").decode("utf-8", "replace")
        channel, evidence, changes = g.diagnose(bad, model, {})
        assert channel and evidence >= g.EVIDENCE
        new = g.restore(bad, channel, changes, model, {})
        right = sum(a == b for a, b in zip(new, SENTENCES[k])) / len(SENTENCES[k])
        # of a text in Cyrillic letters no letter is left
        assert g._LOST not in new and (encoding == "cp1251" or (len(new) == len(SENTENCES[k]) and right > 0.8)), (encoding, new)


def model_of(texts):
    import numpy as np

    sketch = np.zeros((3, 1 << 16), np.int64)
    g._count_text(["\n".join(texts)], 16, sketch)
    return g.Model(sketch)


def test_unusual_signs_are_sound():
    texts = ["Řehov, Łukosz — 12 °C ± 3, £ 4 ¼ © Ἡ μνήμη ┌──┐ ★ NAÇÃO", "LE TÉMOIN PRÉFÈRE LA CÔTE", "naïve Zoë"]
    model = model_of(corpus() + texts)
    for sound in texts:
        assert g.diagnose(sound, model, {})[0] is None, sound


def test_evidence_is_alike_in_a_corpus_of_any_size():
    bad = SENTENCES[0].encode("cp1252").decode("mac_roman", "replace")
    small, large = (g.diagnose(bad, model_of(corpus() * times), {})[1] for times in (1, 50))
    assert abs(small - large) < 0.1 * small


def test_sketch_counts_all_rows(spark):
    sketch = g.corpus_sketch(spark.createDataFrame([("ab ab",), (None,), ("",), ("ab",)], "text string"), bits=12)
    model = g.Model(sketch)
    assert model.words == 4 and model.counts(np_code("ab"))[0] == 3
    assert g.corpus_sketch(spark.createDataFrame([], "text string"), bits=12).sum() == 0


def np_code(word):
    import numpy as np

    return np.array([g._word_code(word)], np.uint64)


def test_empty_table_and_long_text(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert g.garbled(df, bits=12).count() == 0
    long = spark.createDataFrame([(1, "café résumé " * 30000)], "doc_id bigint, text string")
    assert g.garbled(long, bits=12).count() == 0


def test_lattice_prefers_words_to_likely_signs():
    import numpy as np

    sketch = np.zeros((3, 1 << 16), np.int64)
    g._count_text(["\n".join(["le béret du port"] * 20 + ["la bête du port"] * 8)], 16, sketch)
    # after " b" the corpus has é more often than ê, but "béte" is no word of it
    model, text = g.Model(sketch), "la bÃ�te du port"
    start, end, new, gain = next(g._bad_stretches(text, "cp1252", model))
    assert text[:start] + new + text[end:] == "la bête du port" and gain > g.EVIDENCE
