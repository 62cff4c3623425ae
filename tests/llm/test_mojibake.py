import hashlib

import pytest

from pathweave.llm.mojibake import garbled, restore

CLEAN = [
    "Âge et sexe n’ont aucun effet sur cette étape.", "At 369 °C the half-life of β-x is 9.1 h, i.e. ≈ 63 min.", "Реакция идёт при 422 °C и требует 10.4 мкМ субстрата.", "Η αντίδραση γίνεται στους 279 °C με 11.3 µM υποστρώματος.",
    "遺伝子MQ3は膜に存在する酵素をコードする。", "Möglicherweise übernimmt x diese Rolle während der Zellteilung.", "LIGAÇÃO E TRANSLOCAÇÃO: HTI11 atua antes de STNBL1.", "│   ├── export of x\n└── repair of y", "The authors call this “repair of x” and treat it as one module.",
]
DECOYS = ["The sign Ã stands for the mean.", "Ñandú, čas units", "NÃO REVISTO.", "Ð and Þ are legal letters.", "┌─┐ box", "‰ and † mark outliers.", "¬(A ∧ B) → √2·k", "l’été – déjà", "Œdema ①② Ⅷ ٣٤ ﬁbre 🧬", "", "plain"]


def read_as(text, page):
    return "".join(bytes([b]).decode(page, "replace").replace("�", chr(b)) for b in text.encode())


@pytest.mark.parametrize("text", CLEAN)
@pytest.mark.parametrize("page", ["latin-1", "cp1252", "cp1251", "cp437", "mac_roman"])
def test_utf8_read_with_a_page(text, page):
    bad = read_as(text, page)
    assert restore(bad) == text
    assert restore(f"{text} {bad}") == f"{text} {text}"


@pytest.mark.parametrize("text", CLEAN)
def test_twice(text):
    assert restore(read_as(read_as(text, "cp1252"), "cp1252")) == text


def test_single_byte_pages():
    ru = CLEAN[2]
    assert restore(ru.encode("cp1251").decode("cp1252")) == ru
    assert restore(ru.encode("koi8_r").decode("cp1251")) == ru
    de = CLEAN[5]
    assert restore(de.encode("cp1252").decode("mac_roman")) == de
    assert restore("dÃ©j&agrave;") == "déjà" and restore("caf&eacute; is open") == "café is open" and restore("a &lt; b &amp; c") == "a &lt; b &amp; c"


def one_by_one(text, written, read):
    return "".join(bytes([b]).decode(read, "replace").replace("�", chr(b)) for b in text.encode(written))


OTHERS = [
    ("Καλημέρα σε όλους τους φίλους", ("iso8859_7", "cp1253"), "cp1252"), ("Zażółć gęślą jaźń, proszę pana", ("cp1250",), "latin-1"),
    ("テストサーバです", ("euc_jp", "cp932"), "latin-1"), ("次の段階を遅らせる", ("cp932",), "cp1252"), ("Größe für naïve Mädchen", ("utf-8",), "cp1250"), ("Größe für naïve Mädchen", ("utf-8",), "koi8_r"),
    ("Мыши без этого белка", ("utf-8",), "koi8_r"), ("Мыши без этого белка", ("koi8_r", "iso8859_5"), "cp1252"), ("La reacción ocurrió a 85 °C", ("cp1252",), "mac_roman"),
]


@pytest.mark.parametrize(("text", "written", "read"), OTHERS)
def test_other_pages(text, written, read):
    for w in written:
        assert restore(one_by_one(text, w, read)) == text
    assert restore(text) == text


@pytest.mark.parametrize("text", ["Ο βαθμός ƒ και Ƥ", "Zażółć gęślą jaźń", "Příliš žluťoučký kůň", "こんにちは、naïve", "F殲 x"])
def test_other_scripts_stay(text):
    assert restore(text) == text


@pytest.mark.parametrize("text", CLEAN + DECOYS)
def test_clean_texts_stay(text):
    assert restore(text) == text


def test_corpus(spark):
    bad = read_as(CLEAN[0], "cp1252")
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, CLEAN[0], 1), (4, bad, 1), (4, bad, 1), (5, "donn�es", 1), (6, (bad + " ") * 3000, 1)], "doc_id bigint, text string, restored int")
    got = sorted((r.doc_id, r.restored_md5) for r in garbled(df).collect())
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got == sorted([(4, md5(CLEAN[0])), (4, md5(CLEAN[0])), (5, ""), (6, md5((CLEAN[0] + " ") * 3000))])
    assert garbled(df.limit(0)).count() == 0
