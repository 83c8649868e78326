import pytest

from catalens.llm import spam

PROSE = "The porter carries the old camera across the yard. There is a second copy of it, and the index was updated afterwards. While the baker opens the door, the clerk records the number of the box."
FLOOR = {"en": 0.1, "de": 0.14, "fr": 0.13, "es": 0.14}
SPAM = [
    "memory card cheap memory card sale memory card best price memory card " * 4, "https://a.example/1\n[card sale](http://b.test/)\n<a href=\"https://c.example/2\">buy card</a>", "#cardSale #cardDeal #tripod #tripodSale #webcam #webcamDeal #drone", "SKU-4989 tripod 210.10 / SKU-8221 camera bag 105.74 / SKU-94918 lens filter 62.97",
    "Sac photo? Sac photo avis! Sac photo, sac photo & sac photo. Sac photo pas cher sac photo promo sac photo.", "bolsa de cámara, trípode, MARCO, oferta bolsa de cámaras, filtro, MARCO, oferta trípodes, álbum de fotos, filtro", "rain barrel photo sale Munsiwick\nrain barrel photo sale Vasgan\nrain barrel photo sale Kelliria",
    PROSE[:60] + "\n" + "lens filter, tripod, lens filter sale, tripod sale, webcam, " * 6,
]
FINE = [PROSE, "Weitere Aufnahmen fehlen.", "Wer hier kaufen will, sollte Blitzgerät und Fotoalbum vergleichen. Im Test blieb Blitzgerät trocken, Fotoalbum dagegen nicht.", PROSE + "\nObjects: box, barge, lamp post.\nTags: box, barge.", PROSE + " https://a.example/x", "[00:00:01] The index was updated.\n[00:00:09] A copy is kept elsewhere.", "Une copie est conservée à part. " + PROSE, "12 34", "x"]


@pytest.mark.parametrize("text", SPAM)
def test_spam(text):
    assert spam.stuffed_share(text, FLOOR) > 0.5


@pytest.mark.parametrize("text", FINE)
def test_fine(text):
    assert spam.stuffed_share(text, FLOOR) <= 0.5


def test_documents(spark):
    rows = [(i, t, None, "x", None) for i, t in enumerate(SPAM + FINE)] + [(0, SPAM[0], None, None, None), (100, None, None, None, None), (101, " ", None, None, None), (102, PROSE * 200, None, None, None), (103, SPAM[0] * 300, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, doc string, stuffed double")
    got = [r["doc_id"] for r in spam.stuffed_documents(df).collect()]
    assert sorted(got) == [*range(len(SPAM)), 103]
    assert spam.stuffed_documents(df.limit(0)).count() == 0
