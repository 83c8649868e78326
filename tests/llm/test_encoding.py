import pytest

from catalens.llm import encoding

SCHEMA = "file_id string, content string, encoding string, line string, word string"
CLEAN = "Die Küche ist größer als früher.\nLe théâtre est célèbre.\nМост закрыт на ремонт.\nŁódź stoi przy nabrzeżu.\nThe “old mill” – it isn’t new.\nà la gare – â \u00a0 à"


def frame(spark, texts):
    rows = [(f"c{i}", CLEAN, "utf-8", None, "x") for i in range(4)] + [(f"q{i}", t, None, "l", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def wrong(text, write, read):
    return text.encode(write).decode(read, "replace")


GARBLED = [
    wrong("Die Küche", "utf-8", "cp1252"), wrong("Le théâtre est célèbre", "utf-8", "mac_roman"), wrong("die Küche ist größer", "utf-8", "cp437"), wrong("Küche früher", "cp1252", "cp850"), wrong("Мост закрыт", "cp1251", "cp1252"), wrong("Мост закрыт", "utf-8", "latin-1"), wrong("stoi przy nabrzeżu", "cp1250", "cp1252"), wrong("größer", "cp1252", "utf-8"),
    wrong(wrong("Die Küche", "utf-8", "cp1252"), "utf-8", "cp1252"), "clean line\n" + wrong("it isn’t new", "utf-8", "cp1252") + "\nclean", "the “old".encode().decode("cp1252"),
]
FINE = ["NÃO DOBRAR", "ÂGE DU CHÂTEAU", "Ünïcödé nämes – ‰ † ‡ •", "± 5 µm, 45 £", "", None, "plain", "año à la ò", "├── cache", CLEAN]


def test_found(spark):
    got = {r["file_id"] for r in encoding.garbled_files(frame(spark, GARBLED + FINE)).collect()}
    assert got == {f"q{i}" for i in range(len(GARBLED))}


def test_restored(spark):
    got = {r["file_id"]: r for r in encoding.restored_files(frame(spark, GARBLED)).collect()}
    assert got["q0"]["content"] == "Die Küche" and got["q4"]["content"] == "Мост закрыт" and got["q7"]["content"] == "größer" and got["q7"]["lossy"] and got["q8"]["content"] == "Die Küche" and got["q9"]["content"] == "clean line\nit isn’t new\nclean" and not got["q0"]["lossy"]


def test_repeats_empty_long(spark):
    assert encoding.garbled_files(spark.createDataFrame([], SCHEMA)).count() == 0
    long = ("Küche " * 20_000) + "\n" + "KÃ¼che " * 20_000
    df = spark.createDataFrame([("a", long, None, None, None), ("a", long, None, None, None), (None, long, None, None, None), ("b", None, None, None, None)], SCHEMA)
    assert [r[0] for r in encoding.garbled_files(df).collect()] == ["a"]


@pytest.mark.parametrize("word", ["Küche", "“", "nabrzeżu", "Мост", "x"])
def test_forms_lead_back(word):
    for form, (chain, _) in encoding.garbled_forms(word).items():
        assert form != word and chain
    assert not encoding.garbled_forms("B�schung")
