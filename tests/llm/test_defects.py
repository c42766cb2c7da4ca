import numpy as np

from lectern.llm import defects as d
from lectern.llm import language

TURNS = "id string, question string, answer string, status string, ingested_at int, refused string, tail string"


def test_language():
    assert d.language("The keeper of the seeds is in the house") == "en"
    assert d.language("La gardienne des graines est dans la maison") == "fr"
    assert d.language("Die Hüterin der Samen ist nicht in dem Haus") == "de"
    assert d.language("La guardiana de las semillas no está en el huerto") == "es"
    assert d.language("Хранительница семян собирает соль") == "ru" and d.language("守种人翻译了脚注") == "zh"
    assert d.language("") is None and d.language("Tolova 1871") is None


def test_copies():
    q = "Why does the map matter?"
    for said in (q, q.upper(), f"“{q}”", f"{q}\n\n{q}", "Why does the map matter. [1]", f"Answer: {q}"):
        assert d.is_copy(q, said), said
    for said in ("", "Yes", f"{q} Because the coast has changed since then.", f"You ask: {q} The answer is that it does not."):
        assert not d.is_copy(q, said), said
    assert d.is_copy("书中最早在哪里提到盐？", "书中最早在哪里提到盐。[1]") and not d.is_copy("书中最早在哪里提到盐？", "书中最早在哪里提到盐？主要因为海岸。")


SPOKEN = {
    "en": "the keeper of the seeds is in the house and the map that shows the coast was drawn by her hand because the harbour has changed",
    "fr": "la gardienne des graines est dans la maison et la carte qui montre la côte fut dessinée par sa main parce que le port a changé",
    "de": "die hüterin der samen ist in dem haus und die karte die die küste zeigt wurde von ihrer hand gezeichnet weil der hafen sich geändert hat",
    "es": "la guardiana de las semillas está en la casa y el mapa que muestra la costa fue dibujado por su mano porque el puerto ha cambiado",
    "ru": "хранительница семян живёт в доме и карта которая показывает берег была нарисована её рукой потому что гавань изменилась",
    "zh": "守种人翻译了脚注的用法，残破的索引揭示了读者的耐心，地图比海岸更古老。",
}


def learnt():
    counts = np.zeros((len(language.LANGUAGES), language.CELLS))
    for k, code in enumerate(language.LANGUAGES):
        cells, _ = language._triples([SPOKEN[code] + " Tolova Marvesti"] * 20)
        counts[k] = np.bincount(cells, minlength=language.CELLS)
    return language.learnt(counts)


def test_other_languages():
    q = "Which passage shows that the map is in the house of the keeper?"
    table = learnt()
    cases = [
        (q, "地图比海岸更古老，守种人翻译了索引。", True),
        (q, "In short: Die Karte, die die Küste zeigt, ist in dem Haus der Hüterin.", True),
        (q, "La gardienne de la maison a dessiné la carte.", True),
        (q, "사서는 씨앗을 지키는 사람이다", True),
        (q, "The map that shows the coast.\n\n> Die Karte, die die Küste zeigt, ist in dem Haus der Hüterin.", False),
        ("Please reply in German: " + q, "Die Karte, die die Küste zeigt, ist in dem Haus.", False),
        (q, "Tolova Marvesti", False),
        ("지도는 어디에 있습니까", "사서는 씨앗을 지키는 사람이다", False),
        (q, "1871", False),
    ]
    assert d.speak_otherwise(table, [c[0] for c in cases], [c[1] for c in cases]) == [c[2] for c in cases]


def test_profiles_are_learnt_from_the_pairs(spark):
    pairs = [(SPOKEN[c], SPOKEN[c]) for c in SPOKEN for _ in range(3)] + [(None, "x"), ("…", None), ("", "")]
    table = language.profiles(spark.createDataFrame(pairs, "question string, answer string"))
    found, _ = language.scores(table, list(SPOKEN.values()))
    assert [language.LANGUAGES[k] for k in found.argmax(axis=1)] == list(SPOKEN)
    assert language.profiles(spark.createDataFrame([], "question string, answer string")).shape == table.shape


def test_endings():
    for said in ("It is.", "它是。", "He said “no”.", "„Nein“, schreibt sie.", "Yes [3]", "## Notes", "It is. [2]", "Really?!", "“It is,” she writes (see section 3)"):
        assert d.ending(said) in ("closed", "short"), said
    for said in ("It is so. The map shows the", "It is so. See [see", "Er schrieb: „Das ist", "1. It is.\n2. The map", "1. It is.\n2.", "It is so,", "他说：“这是"):
        assert d.ending(said) == "open", said
    assert d.ending("1. The map\n2. The coast") == "list" and d.ending("Chapter 7") == "short"


def rows():
    out = []
    for k in range(40):
        out.append((f"s{k}", f"What about topic {k}?", f"The map number {k} shows the coast of the northern sea, and the clerk agrees.", "succeeded", 1))
    for k in range(8):
        out.append((f"r{k}", f"Who wrote page {k}?", f"I must decline to answer questions about topic {k}.", "refused" if k % 2 else "succeeded", 1))
    out += [
        ("e1", "What?", None, "succeeded", 1), ("e2", "What?", " -　", "refused", 1), ("e3", None, None, "succeeded", 1),
        ("c1", "Why is the map old?", "why is the map old", "succeeded", 1), ("b1", "…", "The map is old.", "succeeded", 1),
        ("o1", "Why is the map old and torn?", "旧地图在海岸。", "succeeded", 1),
        ("t1", "Why is the map old?", "The map is old because the coast is old. The clerk of the", "succeeded", 1),
        ("f1", "Why?", None, "failed", 1), ("n1", "Why?", None, None, 1), (None, "Why?", None, "succeeded", 1),
        ("v1", "Why?", None, "succeeded", 1), ("v1", "Why?", "The map is old.", "succeeded", 2),
        ("v2", "Why?", "", "succeeded", 2), ("v2", "Why?", "", "succeeded", 2),
    ]
    return [(*r, "x", "y") for r in out]


def test_defects_of_a_small_corpus(spark):
    got = {r.turn_id: r.defect for r in d.defective_pairs(spark.createDataFrame(rows(), TURNS)).collect()}
    want = {f"r{k}": "refusal" for k in range(8)} | {"e1": "empty", "e2": "empty", "e3": "empty", "v2": "empty", "c1": "copy", "o1": "other_language", "t1": "truncated"}
    assert got == want


def test_empty_table_and_long_text(spark):
    assert d.defective_pairs(spark.createDataFrame([], TURNS)).count() == 0
    long = "The map shows the coast. " * 20000
    assert d.defective_pairs(spark.createDataFrame([("a", "Why is the map so long?", long, "succeeded", 1, "", "")], TURNS)).count() == 0


def test_unmarked_ends_by_share_at_any_size(spark):
    def found(times):
        said = []
        for k in range(20 * times):
            said.append(f"The map number {k} shows the coast of the northern sea, and the clerk agrees.")
        for k in range(2 * times):
            said.append(f"Abschnitt {k + 3}, zweiter Absatz")
        # cut-off answers, equal ones among them, do not vouch for themselves
        said += ["The map number 7 shows the coast of the"] * 4 + ["The chart of old shows the coast of the"]
        rows = [(f"t{k:04d}", f"What about topic {k}?", x, "succeeded", 1, "", "") for k, x in enumerate(said)]
        got = {r.turn_id: r.defect for r in d.defective_pairs(spark.createDataFrame(rows, TURNS)).collect()}
        return [(x, got[t]) for t, _, x, *_ in rows if t in got]

    cut = [("The map number 7 shows the coast of the", "truncated")] * 4
    small, large = found(1), found(20)
    assert not any(x.startswith("Abschnitt") for x, _ in small + large)
    assert large[:4] == cut and ("The chart of old shows the coast of the", "truncated") in large
