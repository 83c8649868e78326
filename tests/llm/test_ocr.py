import numpy as np
import pytest

from catalens.llm import ocr

SCHEMA = "file_id string, page int, text string, line string, word string"
SENTENCES = ["The porter carries the camera tripod around the harbour.", "A long-disused staircase connects with the garden gate.", "There are many views of the fishing net near the river.", "The clerk records the printing press in late autumn."]


def page(head, foot, *lines):
    return "\n".join([head, "", *lines, foot] if head else [*lines, foot])


@pytest.fixture(scope="module")
def rows():
    out = []
    for i in range(60):  # a corpus that makes the words known
        out.append((f"base{i}", 1, "\n".join(SENTENCES), None, None))
    out += [
        ("doc", 1, page("Annual Report", "Page 1 of 3", "The porter carries the cam-", "era tripod."), None, None), ("doc", 2, page("ANNUAL  RCPORT", "Page 2 of 3", "A long-", "disused staircase. The garderi gate."), None, None), ("doc", 3, page("Garden gate", "Page 3 of 3", "The clerk records."), None, None), ("doc", 3, page("Garden gate", "Page 3 of 3", "The clerk records."), None, None),
        ("plain", 1, "ledger 43\n581", None, None), ("plain", 2, "ledger 17\n220", None, None), ("soft", 1, "The print­\ning press near the ri¬\nver.", None, None), ("null", 1, None, None, None), ("empty", 1, "", None, None), ("long", 1, "\n".join(SENTENCES * 2000), None, None),
    ]
    return out


@pytest.fixture(scope="module")
def noise(spark, rows):
    return {tuple(r) for r in ocr.page_noise(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_noise(noise):
    assert noise == {
        ("doc", 1, "hyphen"), ("doc", 1, "header"), ("doc", 1, "page_number"), ("doc", 2, "header"), ("doc", 2, "page_number"), ("doc", 2, "misread"), ("doc", 3, "page_number"), ("soft", 1, "hyphen"),
    }


def test_repaired(spark, rows):
    got = {(r["file_id"], r["page"]): r["text"] for r in ocr.repaired_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["doc", 1] == "The porter carries the camera tripod." and got["doc", 2] == "A long-disused staircase. The garden gate." and got["soft", 1] == "The printing press near the river." and got["doc", 3] == "Garden gate\n\nThe clerk records."


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ocr.page_noise(empty).count() == 0 and ocr.repaired_pages(empty).count() == 0


@pytest.mark.parametrize("line, number", [("- 3 -", 3), ("[115]", 115), ("Page 3 of 9", 3), ("iv", 4), ("xiv", 14), ("Report  |  7/9", 7), ("s. 12\tReport", 12), ("Report 1976", None), ("5/14    Orchard", 5), ("plain words", None)])
def test_numbers(line, number):
    found, _ = ocr.numbers_of(line)
    assert ([n for _, n, _ in found] or [None])[0] == number


def test_glyphs_and_skeleton():
    assert {"garderi", "gai~den", "gorden", "9arden"} <= ocr.misreadings("garden") and "biicherei" in ocr.misreadings("bücherei")
    assert ocr.skeleton("Annual Inspection Report") == ocr.skeleton("ANNUAL  INSPECTION  Rcport") != ocr.skeleton("Letters")


def test_vectors_learn_neighbours(spark):
    rng = np.random.default_rng(0)
    a, b = ["alpha", "beta", "gamma"], ["one", "two", "three"]
    text = " ".join(" ".join(rng.permutation(a if rng.random() < 0.5 else b)) for _ in range(3000))
    vin, vout = ocr.skip_gram(spark.createDataFrame([("f", 1, text, None, None)], SCHEMA))
    fit = lambda x, y: float(vin[ocr.bucket(x)] @ vout[ocr.bucket(y)])
    assert fit("alpha", "beta") > fit("alpha", "two") and fit("one", "two") > fit("one", "gamma")
