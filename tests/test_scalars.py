"""Scalar functions: Python strings and native columns agree."""

import pytest
from pyspark.sql import functions as F

from citaforge.functions import columns as c
from citaforge.functions import strings as s
from citaforge.operators import keys

NUMBERS = {
    "REsp 1.234.567/SP": "1234567", "R.Esp. n° 2.34g.567-MA": "2349567", "RR-4B37-o6.20iO.5.13.0074": "48370620105130074", "HC 98.765 (RJ)": "98765", "REsp 1.234.567 de 2020": "1234567",
    "sem número": "", "": "", "MS 12 e 34": "12", "Rcl 4B.71B/RS": "48718", "APn 70O.38O-G0": "700380", "l. 470.537": "1470537",
}


@pytest.mark.parametrize("text,digits", NUMBERS.items())
def test_identifier_digits(text, digits):
    assert s.identifier_digits(text) == digits


def test_columns_agree_with_strings(spark):
    texts = [*NUMBERS, "AgInt no REsp 1", "Embargos de Declaração no Recurso Especial", "É ÀÇÃO  Única\n", "g.B7G.S43", "12345l7", "TST-E-ED-RR-1O.2-S5", "S.O.S", "4736-oS.Z013", "H.C. 3", "rhc do are"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    out = rows.select("t", c.identifier_digits(t).alias("d"), c.repair_digits(t).alias("r"), c.text_key(t).alias("k"), c.class_marks(t).alias("m"), c.split_unit(t).alias("u"), c.integer_of(t).alias("i")).collect()
    for r in out:
        assert (r["d"], r["r"], r["k"], r["m"]) == (s.identifier_digits(r["t"]), s.repair_digits(r["t"]), s.text_key(r["t"]), s.class_marks(r["t"])), r["t"]
        assert (tuple(r["u"]), r["i"]) == (s.split_unit(r["t"]), keys.integer_of(r["t"])), r["t"]


@pytest.mark.parametrize("text", ["REsp 1.2O0.S67", "abc", "l. 470.537 1", "4736-oS.Z013.s.04", "", "Os 123l5"])
def test_repair_keeps_length_and_digits(text):
    out = s.repair_digits(text)
    assert len(out) == len(text) and all(a == b for a, b in zip(text, out) if a.isdigit())


@pytest.mark.parametrize("word", ["Súmula", "artigo", "Constituição", "Tema", "relatoria"])
def test_noisy_words_match_their_noise(word):
    import re

    pattern = re.compile(s.noisy(word))
    assert pattern.fullmatch(word) and pattern.fullmatch(s.strip_accents(word))
    for right, wrong in s.CONFUSED_AS.items():
        at = word.find(right)
        if at >= 0:
            assert pattern.fullmatch(word[:at] + wrong + word[at + 1 :])
    assert not pattern.fullmatch(word + "x")


@pytest.mark.parametrize("text,marks", [("EDcl no AgRg no REsp 1.234", ["agrg", "edcl", "resp"]), ("nosREsp", ["resp"]), ("Agravo em Recurso Especial", ["aresp"]), ("Habeas Corpus", ["hc"]), ("presp", []), ("Questão de Ordem na APl", ["apl", "qo"])])
def test_class_marks(text, marks):
    assert s.class_marks(text) == marks


def test_affinity_and_iou():
    assert s.affinity({"resp"}, {"resp", "agint"}) == 0 and s.affinity({"resp", "agint"}, {"resp", "agint"}) == 2 and s.affinity({"resp"}, {"resp", "hc"}) == 1
    assert s.iou((10, 20), (30, 40)) == 0 and s.iou((0, 10), (5, 15)) == pytest.approx(1 / 3) and s.iou((1, 4), (1, 4)) == 1


@pytest.mark.parametrize("text,year", [("73", 1973), ("15", 2015), ("30", 2030), ("31", 1931), ("1988", 1988), ("988", None)])
def test_years(text, year):
    assert keys.year_of(text) == year


@pytest.mark.parametrize("text,key", [("5º", "5"), ("5o", "5"), ("5O", "50"), ("896-A", "896-A"), ("1.134", "1134"), ("3l3", "313"), ("103-b", "103-B"), ("", None), (None, None)])
def test_cited_articles(text, key):
    assert keys.cited_article(text) == key


@pytest.mark.parametrize("text,court", [("5TJ", "STJ"), ("STF", "STF"), ("TRF da 4ª Região", "TRF4"), ("Tribunal Regional Federal da Quarta Região", "TRF4"), ("TJ/SP", "TJSP"), ("TJ-MG", "TJMG"), ("Tribunal de Justiça do Estado de São Paulo", "TJSP"), ("TRT-5", "TRT5"), ("TNU", "TNU"), ("TJMSP", "TJMSP"), ("Tribunal de Justiça de Mato Grosso do Sul", "TJMS"), ("TRT da Vigésima Terceira Região", "TRT23")])
def test_courts(text, court):
    assert keys.court_acronym(text) == court


@pytest.mark.parametrize(
    "text,code",
    [
        ("CPC", "CPC"), ("CPC/73", None), ("CPC/2015", "CPC"), ("Código de Processo Civil", "CPC"), ("Código Civil", "CC"), ("Código Penal Militar", "CPM"), ("Código de Processo Penal Militar", "CPPM"), ("Código Civil português", None),
        ("Constituição Federal", "CF"), ("Constituição Estadual", None), ("Constituição de 1969", None), ("CF/88", "CF"), ("Lei Maior", "CF"), ("Lei nº 13.105/2015", "CPC"), ("Lei nº 13.105/2014", None), ("Lei Complementar 64/90", "LC64"),
        ("Lei Estadual nº 10.406", None), ("Decreto-Lei nº 3.689", "CPP"), ("Lei de Execução Penal", "LEI_7210"), ("Lei de Execução Penal de 1999", "LEI_1999"), ("Lei Maria da Penha de 2006", "LEI_2006"), ("Estatuto do Idoso de 2004", None), ("Estatuto do Idoso de 2003", "LEI_10741"), ("LINDB", "DL_4657"), ("ECA", "ECA"), ("Código de Proccsso Civil", "CPC"), ("Estatuto do Torcedor", None), ("Código Penal Mi1itar", "CPM"),
    ],
)
def test_diploma_codes(text, code):
    assert keys.diploma_code(text)[0] == code


def test_declared_years_are_left_to_the_base():
    assert keys.diploma_code("Lei nº 9.504/1997") == ("LEI_9504", 1997, True) and keys.diploma_code("Lei nº 9.504") == ("LEI_9504", None, False)


def test_edit_distance():
    assert [keys.edit_distance(*p) for p in (("", ""), ("abc", ""), ("federal", "fcderal"), ("kitten", "sitting"))] == [0, 3, 1, 3]


def test_located(spark):
    text = "é 12 😀 345 x6"
    out = spark.createDataFrame([(text,), ("",), ("none",)], "t string").select(c.located(F.col("t"), "[0-9]+").alias("m")).collect()
    assert [tuple(m) for m in out[0]["m"]] == [(2, 4, "12"), (7, 10, "345"), (12, 13, "6")] and out[1]["m"] == [] and out[2]["m"] == []
