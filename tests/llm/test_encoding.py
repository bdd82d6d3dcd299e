import numpy as np
import pytest

from fieldglass.llm.encoding import PairModel, Repairer, max_scoring_segments, pair_counts, repair_documents
from tests.llm.sentences import MISREADINGS, garbled, sentences

CLEAN = [
    "Das Café liegt an der Straße, die Größe ändert sich über die Jahre – schön!",
    "We can’t separate the two runs; don’t edit below this line — it’s 5 °C, ±2 µs… cost €80.",
    "Результаты почти не меняются, если убрать столбец. Сравним два способа сглаживания и выберем более простой.",
    "Zauważ, że średnia rośnie już po 330 próbkach – to dość dziwne. Żółta linia łącznie.",
    "この結果は先週の実験とほぼ同じです。課題の平均が回目以降で変わる理由を説明してください。",
    "┌──────┬──────┐\n│ tide │ kiln │\n└──────┴──────┘ 83%|█████▌ |",
    "L’été à l’œil : la médiane a été réglée d’où les répétitions. Á ã ç õ ESTAÇÃO NÃO avaliação.",
]


def sloppy(b, enc="cp1252"):
    return "".join(bytes([x]).decode(enc, "ignore") or chr(x) for x in b)


BROKEN = {
    100: (sloppy(CLEAN[0].encode()), CLEAN[0]),
    101: (CLEAN[1].encode().decode("latin-1"), CLEAN[1]),
    102: (CLEAN[1].encode().decode("mac_roman"), CLEAN[1]),
    103: (CLEAN[0].encode().decode("cp437"), CLEAN[0]),
    104: (sloppy(sloppy(CLEAN[0].encode()).encode()), CLEAN[0]),
    105: (CLEAN[2].encode("cp1251").decode("koi8-r"), CLEAN[2]),
    106: (CLEAN[2].encode("koi8-r").decode("cp1251"), CLEAN[2]),
    107: (sloppy(CLEAN[2].encode("cp1251")), CLEAN[2]),
    108: (sloppy(CLEAN[3].encode("cp1250")), CLEAN[3]),
    109: (sloppy(CLEAN[4].encode("cp932")), CLEAN[4]),
    110: (CLEAN[5] + "\n" + sloppy("We can’t wait — 5 °C".encode()) + "\n" + CLEAN[6], CLEAN[5] + "\nWe can’t wait — 5 °C\n" + CLEAN[6]),
    111: ("Result: can�t say.", "Result: can�t say."),
}
LESSON = 'Lesson on codecs: the string `CrÃ¨me brÃ»lÃ©e` is meant.\nbad = "CrÃ¨me brÃ»lÃ©e"\nbad.encode("cp1252").decode("utf-8")\n\'Crème brûlée\''


@pytest.fixture(scope="module")
def found(spark):
    rows = [(1000 + i, f"{t} ({i})") for i, t in enumerate(CLEAN * 30)]  # equal texts would count once
    rows += [(i, b) for i, (b, _) in BROKEN.items()] + [(1, None), (2, ""), (3, "plain ascii"), (4, LESSON), (5, "word " * 200_000 + "don’t stop"), (111, BROKEN[111][0])]
    df = spark.createDataFrame([(i, t, True, "c") for i, t in rows], "doc_id bigint, text string, damaged boolean, restored_text string")
    return [tuple(r) for r in repair_documents(df).collect()]


def test_finds_and_restores(found):
    got = {i: (text, restorable) for i, _, text, _, restorable in found}
    assert set(got) == set(BROKEN)
    for i, (_, clean) in BROKEN.items():
        assert got[i] == (clean, i != 111), i
    assert sum(1 for r in found if r[0] == 111) == 2  # repeated ids give a row each


def test_empty(spark):
    assert repair_documents(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    assert repair_documents(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")).collect() == []


def brute_segments(s):
    """Recursive definition: the best segment (shortest on ties), then the same left and right of it."""
    best = None
    for b in range(len(s)):
        for e in range(b + 1, len(s) + 1):
            v = s[b:e].sum()
            if v > 1e-9 and (best is None or v > best[0] + 1e-9 or (abs(v - best[0]) <= 1e-9 and e - b < best[2] - best[1])):
                best = (v, b, e)
    if best is None:
        return []
    _, b, e = best
    return brute_segments(s[:b]) + [(b, e)] + [(x + e, y + e) for x, y in brute_segments(s[e:])]


def test_max_scoring_segments():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = rng.normal(-0.2, 1, rng.integers(0, 16))
        assert max_scoring_segments(s) == brute_segments(s)


@pytest.fixture(scope="module")
def repairer(spark):
    """Under a model of 1,000 documents, which hold none of the made-up sentences."""
    counts = pair_counts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    return Repairer(PairModel(counts.kind.to_numpy(), counts.slot.to_numpy(), counts.n.to_numpy()))


def test_quotes_need_inline_code_and_the_right_form(repairer):
    spans = lambda t: [t[a:b] for a, b in repairer.quoted_spans(t)]
    assert spans("just `CrÃ¨me` here") == [] and spans('to decode "CrÃ¨me" as Crème') == [] and spans("`Crème` and Crème") == []
    assert spans('decode `CrÃ¨me`: x = "CrÃ¨me" gives Crème') == ["CrÃ¨me", "CrÃ¨me"]
    assert spans("`Cr\ufffdme` was Crème") == ["Cr\ufffdme"] and spans("`Cr\ufffdme` was it") == []


def test_clean_sentences_are_left_alone(repairer):
    assert [s for _, s in sentences() if repairer.repair(s)[0]] == []


def test_sentences_are_restored_character_for_character(repairer):
    """576 sentences in nine languages, misread in twelve ways, once to three times."""
    tried = right = found = wrong = 0
    for i, (_, clean) in enumerate(sentences()):
        for j, encoding in enumerate(MISREADINGS):
            damaged, text, _, restorable = repairer.repair(garbled(clean, encoding, 1 + (i + j) % 3))
            tried, found, right = tried + 1, found + damaged, right + (text == clean)
            wrong += restorable and text != clean
    print(tried, found, right, wrong)
    assert found == tried and right >= 0.97 * tried and wrong <= 0.02 * tried


def test_restored_in_places_with_several_depths_and_cut_sequences(repairer):
    clean = "Das Café liegt an der Straße, die Größe ändert sich über die Jahre."
    text = "\n".join([clean, garbled("Die Tür öffnet früh, die Gäste hören Vögel.", "cp1252"), "x = 1", garbled("L’été déjà passé à l’école, répète le garçon.", "cp1252", 2)])
    damaged, got, _, restorable = repairer.repair(text)
    assert damaged and restorable and got == "\n".join([clean, "Die Tür öffnet früh, die Gäste hören Vögel.", "x = 1", "L’été déjà passé à l’école, répète le garçon."])
    cut = garbled("Die Tür öffnet früh, „hört“ man.", "cp1252").replace("â€œ", "â€")
    damaged, got, _, restorable = repairer.repair(cut)
    assert damaged and not restorable and "Tür öffnet früh" in got


def test_very_long_texts_outside_ascii_take_linear_time(spark):
    import time

    russian, japanese = CLEAN[2].replace(" ", "") * 3000, CLEAN[4] * 5000
    rows = [(1, russian + japanese), (2, (CLEAN[2] * 500).encode().decode("latin-1")), (3, CLEAN[2] * 3000)] + [(10 + i, f"{t} ({i})") for i, t in enumerate(CLEAN * 30)]
    began = time.time()
    got = {r.doc_id: r.restored_text for r in repair_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert time.time() - began < 120
    assert set(got) == {2} and got[2] == CLEAN[2] * 500


def test_a_damaged_text_with_many_copies_is_still_found(spark):
    bad = (CLEAN[1].encode().decode("latin-1"), sloppy(CLEAN[2].encode("cp1251")))
    rows = [(i, f"{t} ({i})") for i, t in enumerate(CLEAN * 20)] + [(1000 + i, b) for i, b in enumerate(bad * 150)]
    got = [r.doc_id for r in repair_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got) == list(range(1000, 1300))
