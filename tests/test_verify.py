"""Base, resolution, output and evaluation on small hand-made tables."""

import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from citaforge import cli
from citaforge.operators import evaluate, index, noise, submission
from citaforge.operators.guard import guarded
from citaforge.plans.verify import as_predictions, coverage, robustness, verify
from citaforge.sources import opinions as op
from citaforge.sources import sqlite, tables
from citaforge.streaming import opinions as stream


def ruling(name, number):
    return f"{name} Nº {number} - RS (2021/0123456-7)\nRELATOR : MINISTRO FULANO DE TAL\nRECORRENTE : EMPRESA SINTÉTICA\nEMENTA\nPROCESSUAL CIVIL.\nRELATÓRIO\nx\nVOTO\n{name}"


ROWS = [
    ("doc_a", 101, "STJ", "acordao", ruling("RECURSO ESPECIAL", "7.654.321"), None),
    ("doc_b", 102, " stj ", " Acórdão ", ruling("AGRAVO INTERNO NO RECURSO ESPECIAL", "7.654.321"), 900),
    ("doc_c", 103, "STJ", "acordao", ruling("HABEAS CORPUS", "555.444"), None),
    ("doc_d", 104, "STJ", "acordao", ruling("RECURSO ESPECIAL", "1.000.001"), None),
    ("doc_e", 105, "STJ", "acordao", ruling("RECURSO ESPECIAL", "1.000.001"), None),
    ("doc_f", 106, "STJ", "acordao", ruling("RECURSO ESPECIAL", "1.000.001"), None),
    ("doc_g", 107, "STJ", "acordao", ruling("RECLAMACAO", "2.222.333"), 10),
    ("doc_h", 108, "STJ", "acordao", ruling("RECLAMACAO", "2.222.333"), 20),
    ("sum_1", 201, "STJ", "sumula", "Súmula n. 83 do STJ\nx", None),
    ("sum_2", 202, "STJ", "súmula", "Súmula n. 83 do STJ\ny", None),
    ("sum_3", 203, None, "sumula", "Súmula Vinculante 11\n", None),
    ("sum_4", 204, "TST", "sumula", "Súmula nº 331 do TST", None),
    ("sum_x", 205, None, "sumula", "sem número", None),
    ("dis_1", 301, None, "dispositivo", "Artigo 5º da Constituição Federal de 1988", None),
    ("dis_2", 302, None, "dispositivo", "Artigo 3 da Lei nº 9.504, de 30 de setembro de 1997", None),
    ("dis_3", 303, None, "dispositivo", "Artigo 373 da Lei nº 13.105, de 16 de março de 2015", None),
    ("bad_1", None, None, "acordao", "sem id", None),
    ("bad_2", 999, None, "acordao", "  \n ", None),
    (None, 400, None, "outra", "sem documento", None),
]
SCHEMA = "documento_id string, id bigint, tribunal string, natureza string, texto string, texto_len bigint"

CASES = [
    ("REsp 7.654.321/RS", "real", 101, "real_desempate_classe"),
    ("AgInt no REsp 7.654.321/RS", "real", 102, "real_desempate_classe"),
    ("HC 555.444/RS", "real", 103, "real_unico"),
    ("REsp 1.000.001/RS", "inventada", None, "inventada_processo"),  # three owners
    ("Rcl 2.222.333", "real", 108, "real_desempate"),
    ("Súmula 83 do STJ", "real", 201, "real_tabela"),
    ("Súmula 83 do TST", "inventada", None, "inventada_tabela"),
    ("Súmula 83", "inventada", None, "inventada_tabela"),
    ("Súmula Vinculante 11", "real", 203, "real_tabela"),
    ("Súmula Vinculante 11 do STF", "real", 203, "real_tabela"),
    ("Súmula Vinculante 11 do STJ", "inventada", None, "inventada_tabela"),
    ("Enunciado 331 do TST", "real", 204, "real_tabela"),
    ("Enunciado 83 do STJ", "inventada", None, "inventada_tabela"),
    ("Tema 1.234", "inventada", None, "inventada_tema"),
    ("art. 5º da CF", "real", 301, "real_tabela"),
    ("art. 5º da Constituição Estadual", "inventada", None, "inventada_tabela"),
    ("art. 3º da Lei nº 9.504/1997", "real", 302, "real_tabela"),
    ("art. 3º da Lei nº 9.504/1998", "inventada", None, "inventada_tabela"),
    ("art. 373 do CPC", "real", 303, "real_tabela"),
    ("art. 373 do CPC/73", "inventada", None, "inventada_tabela"),
    ("julgado do STF proferido em 2024 pela relatoria de Fulano de Tal", "incompleta", None, "incompleta_vaga"),
]


@pytest.fixture(scope="module")
def base(spark):
    return index.build(index.clean_rows(spark.createDataFrame(ROWS, SCHEMA).repartition(3)))


@pytest.fixture(scope="module")
def cited(spark):
    return spark.createDataFrame([(f"d{i:02d}", f"Conforme o {t}, no caso.") for i, (t, *_) in enumerate(CASES)], "documento_id string, texto string")


def test_labels(spark, base, cited):
    found = {r["documento_id"]: r for r in verify(cited, base).collect()}
    for i, (text, label, key, path) in enumerate(CASES):
        r = found[f"d{i:02d}"]
        assert (r["classificacao"], r["id_canonico"], r["caminho"]) == (label, key, path), text


def test_labels_follow_the_base(spark, cited):
    other = index.build(index.clean_rows(spark.createDataFrame([r for r in ROWS if r[0] not in ("doc_a", "sum_1", "dis_1")], SCHEMA)))
    found = {r["documento_id"]: (r["classificacao"], r["id_canonico"]) for r in verify(cited, other).collect()}
    assert found["d00"] == ("real", 102) and found["d05"] == ("real", 202) and found["d14"] == ("inventada", None)


def test_index(base):
    assert sorted((r["numero"], r["documento_id"]) for r in base.numeros.collect()) == [("2222333", "doc_g"), ("2222333", "doc_h"), ("555444", "doc_c"), ("7654321", "doc_a"), ("7654321", "doc_b")]
    assert {(r["tribunal"], r["vinculante"], r["numero"]): r["id_canonico"] for r in base.sumulas.collect()} == {("STJ", False, 83): 201, ("STF", True, 11): 203, ("TST", False, 331): 204}
    assert {(r["codigo"], r["artigo"]): r["id_canonico"] for r in base.dispositivos.collect()} == {("CF", "5"): 301, ("LEI_9504", "3"): 302, ("CPC", "373"): 303}
    assert [r[0] for r in base.ilegiveis.collect()] == ["sum_x"]


def test_saved_tables_give_the_same_base(spark, base, tmp_path, cited):
    index.save(base, str(tmp_path))
    key = lambda b: sorted((r["documento_id"], r["caminho"], r["id_canonico"]) for r in verify(cited, b).collect())
    assert key(index.load(spark, str(tmp_path))) == key(base)


def test_loose_columns(spark):
    kinds = spark.createDataFrame([("a", "12 ", "x", None, "t", 1), ("b", "1.5", None, "n", "t", 1), (None, "7", "", "n", "t", None)], "documento_id string, id string, tribunal string, natureza string, texto string, texto_len bigint")
    assert sorted(tuple(r)[:3] for r in index.clean_rows(kinds).collect()) == [("7", 7, None), ("a", 12, "X")]
    floats = spark.createDataFrame([("a", 12.0, None, "n", "t", 1), ("b", 1.5, None, "n", "t", 1)], "documento_id string, id double, tribunal string, natureza string, texto string, texto_len bigint")
    assert [r["id"] for r in index.clean_rows(floats).collect()] == [12]
    truths = spark.createDataFrame([("a", True, None, "n", "t", 1)], "documento_id string, id boolean, tribunal string, natureza string, texto string, texto_len bigint")
    assert index.clean_rows(truths).count() == 0


def test_an_empty_base_makes_all_invented(spark, cited):
    found = verify(cited, index.build(index.clean_rows(spark.createDataFrame([], SCHEMA))))
    assert {r["classificacao"] for r in found.collect()} == {"inventada", "incompleta"}


def test_cells_and_json(spark, base, cited, tmp_path):
    documents = cited.unionByName(spark.createDataFrame([("vazio", "nada")], "documento_id string, texto string"))
    found = verify(documents, base)
    cells = {r[0]: r[1] for r in submission.cells(documents, found).collect()}
    assert cells["d02"] == "11,24,real,103,1.0000" and cells["vazio"] == "-" and cells["d03"].endswith(",inventada,-,1.0000") and len(cells) == len(CASES) + 1
    assert submission.write_json(submission.contract_json(documents, found, "fonte"), str(tmp_path)) == len(CASES) + 1
    data = json.loads((tmp_path / "d02.json").read_text())
    assert data["schema_version"] == "1.2" and data["citacoes"][0]["resolucao"] == {"fonte": "fonte", "id_canonico": "103"} and data["citacoes"][0]["id"] == "c1"
    assert json.loads((tmp_path / "vazio.json").read_text())["citacoes"] == []
    assert submission.contract_problems(found, documents).count() == 0


def test_csv_is_exact_and_ordered(spark, tmp_path):
    path = tmp_path / "out" / "t.csv"
    submission.write_csv(spark.createDataFrame([("b", "-"), ("a", "10,20,real,123,0.9100"), ("a-b", "-")], "documento_id string, citacoes string"), str(path))
    assert path.read_bytes() == b'documento_id,citacoes\r\na-b,-\r\na,"10,20,real,123,0.9100"\r\nb,-\r\n'
    assert [p.name for p in path.parent.iterdir()] == ["t.csv"]
    with pytest.raises(Exception):
        submission.write_csv(spark.createDataFrame([("a",)], "documento_id string").withColumn("citacoes", F.raise_error(F.lit("x"))), str(path))
    assert b"0.9100" in path.read_bytes() and len(list(path.parent.iterdir())) == 1


def test_submission_problems(spark):
    bad = {"ok": "1,9,real,5,0.5|20,30,inventada,-,-", "f": "1,2,real,3", "s": "9,1,real,3,1", "c": "1,9,outra,-,-", "i": "1,9,real,,1", "k": "1,9,incompleta,-,2|20,30,incompleta,-,x", "o": "10,30,real,1,1|11,30,real,2,1|40,50,real,1,1", "m": None, "n": "-", "ns": "a,b,real,1,1"}
    table = spark.createDataFrame(list(bad.items()), "documento_id string, citacoes string")
    expected = spark.createDataFrame([("ok",), ("lost",)], "documento_id string")
    found = sorted(tuple(r) for r in submission.submission_problems(table, expected).collect())
    assert found == [("c", 1, "classe"), ("f", 1, "campos"), ("i", 1, "id"), ("k", 1, "confianca"), ("k", 2, "confianca"), ("lost", 0, "sem linha"), ("ns", 1, "span"), ("o", 1, "iou"), ("s", 1, "span")]


def test_contract_problems(spark):
    kind = "documento_id string, id string, inicio int, fim int, trecho string, tipo string, classificacao string, id_canonico bigint, confianca double"
    rows = [("a", "c1", 0, 3, "abc", "lei", "real", 1, 1.0), ("a", "c1", 4, 4, "", "x", "y", None, 2.0), ("b", "c1", 0, 1, "z", "lei", "real", None, None), ("b", "c2", 0, 1, "a", "lei", "inventada", 5, 0.5)]
    texts = spark.createDataFrame([("a", "abc d"), ("b", "a")], "documento_id string, texto string")
    found = sorted((r[0], r[2]) for r in submission.contract_problems(spark.createDataFrame(rows, kind), texts).collect())
    assert found == sorted([("a", "id repetido"), ("a", "id repetido"), ("a", "tipo inválido"), ("a", "classificacao inválida"), ("a", "span inválido"), ("a", "confianca fora de [0, 1]"), ("b", "real exige id_canonico"), ("b", "trecho não corresponde"), ("b", "resolucao deve ser null")])


def test_perfect_predictions_score_best(spark, base, cited):
    found = verify(cited, base)
    gold = found.select("documento_id", F.lit(1).alias("nivel"), "inicio", "fim", F.col("classificacao").alias("classe"), F.col("id_canonico").alias("id"))
    gold = gold.unionByName(gold.withColumn("nivel", F.lit(2)).withColumn("documento_id", F.concat("documento_id", F.lit("x"))))
    preds = as_predictions(found).withColumn("confianca", F.lit(1.0))
    preds = preds.unionByName(preds.withColumn("documento_id", F.concat("documento_id", F.lit("x"))))
    levels = evaluate.level_scores(gold, preds)
    assert {(r["nivel"], round(r["macro_f1"], 9), r["tau"], round(r["score"], 9)) for r in levels.collect()} == {(1, 1.0, 0.0, 1.1), (2, 1.0, 0.0, 1.1)}
    assert round(evaluate.final_score(levels).first()[0], 9) == 1.1


def test_edits_and_offsets(spark):
    kind = "texto string, e array<struct<inicio:int,ordem:int,fim:int,novo:string>>"
    rows = [("abcdefgh", [(0, 0, 4, "XX"), (2, 1, 6, "YY")]), ("abcdefgh", [(0, 0, 4, "ab")]), ("abcdefgh", [(4, 0, 4, "\n"), (6, 0, 7, "😀é")]), ("abc", [])]
    df = spark.createDataFrame(rows, kind).withColumn("o", noise.disjoint_edits(F.col("e")))
    out = df.select(noise.apply_edits(F.col("texto"), F.col("o")).alias("t"), F.transform(F.sequence(F.lit(0), F.length("texto")), lambda i: noise.translate(i, F.col("o"))).alias("m")).collect()
    assert [r["t"] for r in out] == ["XXefgh", "abefgh", "abcd\nef😀éh", "abc"]
    assert out[0]["m"] == [0, 0, 0, 0, 2, 3, 4, 5, 6] and out[2]["m"] == [0, 1, 2, 3, 5, 6, 7, 9, 10] and out[3]["m"] == [0, 1, 2, 3]


def test_every_noise_class_keeps_digits_and_places(spark, base):
    text = "Conforme o AgInt no REsp nº 7.654.321/RS, a Súmula 83 do STJ e o julgado do STF proferido em 2024 pela relatoria de Fulano de Tal. Nada mais."
    spans = [("AgInt no REsp nº 7.654.321/RS", "real", 102), ("Súmula 83 do STJ", "real", 201), ("julgado do STF proferido em 2024 pela relatoria de Fulano de Tal", "incompleta", None)]
    docs = spark.createDataFrame([(f"d{i}", text) for i in range(6)], "documento_id string, texto string")
    gold = spark.createDataFrame([(f"d{i}", 1, text.index(t), text.index(t) + len(t), t, c, k) for i in range(6) for t, c, k in spans], "documento_id string, nivel int, inicio int, fim int, trecho string, classificacao string, id bigint")
    for name in noise.CLASSES:
        noisy, moved = noise.perturb(docs, gold, (name,), 1.0, 3)
        texts = {r[0]: r[1] for r in noisy.collect()}
        assert any(t != text for t in texts.values()), name
        for r in moved.collect():
            assert texts[r["documento_id"]][r["inicio"] : r["fim"]] == r["trecho"]
        if name == "ocr_numero":
            for t in texts.values():
                assert len(t) == len(text) and all(a == b for a, b in zip(text, t) if b.isdigit())
    same, _ = noise.perturb(docs, gold, noise.CLASSES, 0.0, 1)
    assert {r[1] for r in same.collect()} == {text}
    with pytest.raises(ValueError):
        noise.edits(docs, gold, "other", 1.0, 1)
    table = {(r["ruido"], r["semente"]): r["delta"] for r in robustness(docs, gold, base, ("marca_numero",)).collect()}
    assert table[("-", 0)] == 0 and ("marca_numero", 1) in table


def test_number_styles(spark):
    df = spark.createDataFrame([("12345678920257000000",), ("1234567",)], "d string")
    found = [[r[0] for r in df.select(noise.format_number(F.col("d"), F.lit(s))).collect()] for s in ("canonico", "corrido", "espacos", "ponto_espaco", "digitos")]
    assert found == [["1234567-89.2025.7.00.0000", "1.234.567"], ["1234567-892025" + "7000000", "1234567"], ["1234567-89 2025 7 00 0000", "1 234 567"], ["1234567-89.2025.7.00.0000", "1. 234.567"], ["12345678920257000000", "1234567"]]


def test_coverage_and_catalogue(spark, base):
    found = {(r["repetido"], r["desfecho"]): r["n"] for r in coverage(base, base.registros).collect()}
    assert found[(False, "certo")] == 1 and sum(found.values()) == 5
    alone = noise.catalogue(base)
    assert [(r["documento_id"], r["numero"]) for r in alone.collect()] == [("doc_c", "555444")]
    made = noise.invent_numbers(alone, base.numeros).first()
    assert len(made["numero"]) == 6 and made["numero"] != "555444"


def test_snapshot_diff_and_gold(spark):
    old = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 0, None), (4, 0, "d")], "k int, inicio int, c string")
    new = spark.createDataFrame([(1, 0, "a"), (2, 5, "b"), (3, 0, "c"), (5, 0, "e")], "k int, inicio int, c string")
    assert {r[0]: r[1] for r in evaluate.snapshot_diff(old, new, ["k"], ["inicio"]).collect()} == {1: "igual", 2: "deslocada", 3: "alterada", 4: "removida", 5: "nova"}


def make_database(path, rows=ROWS):
    link = sqlite3.connect(path)
    link.execute("create table documentos (documento_id, id, tribunal, natureza, texto, texto_len, ano, relator)")
    link.executemany("insert into documentos values (?,?,?,?,?,?,2020,'x')", rows)
    link.execute("insert into documentos values ('bytes', 500, 'STJ', 'acordao', cast(x'41FF42' as text), 3, 1, 'x')")
    link.commit()
    link.close()


def test_sqlite_source(spark, tmp_path):
    path = tmp_path / "base #1.db"
    make_database(path)
    found = sqlite.read_base(spark, str(path), 4).orderBy("posicao").collect()
    assert len(found) == len(ROWS) + 1 and [r["documento_id"] for r in found][:2] == ["doc_a", "doc_b"] and found[-1]["texto"] == "A�B" and found[16]["id"] is None


def test_folder_source(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "z.txt").write_bytes(b"z")
    read = lambda: {r["documento_id"]: r["texto"] for r in op.read_opinions(spark, str(tmp_path / "in")).collect()}
    with pytest.warns(UserWarning):
        assert read() == {"z": "z"}
    for name, data in (("a b.TXT", b"x\r\ny"), ("c.v1.txt", b"e\xcc\x81"), ("d.txt", b"caf\xe9"), ("_e.txt", b"under"), ("f+g%20.txt", b"plus"), ("n.md", b"no")):
        (tmp_path / "in" / name).write_bytes(data)
    assert read() == {"a b": "x\r\ny", "c.v1": "é", "d": "caf�", "_e": "under", "f+g%20": "plus"}


def test_stream(spark, base, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Veja o HC 555.444/RS, no caso.")
    run = lambda: stream.watch(spark, str(tmp_path / "in"), base, stream.to_parquet(str(tmp_path / "out")), str(tmp_path / "check"), once=True).awaitTermination()
    run()
    (tmp_path / "in" / "b.TXT").write_text("Veja o HC 999.444/RS, no caso.")
    run()
    found = spark.read.parquet(str(tmp_path / "out")).orderBy("documento_id").collect()
    assert [(r["documento_id"], r["classificacao"]) for r in found] == [("a", "real"), ("b", "inventada")]


def test_spreadsheets_and_archives(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
    sheet += "<row>" + "".join(f'<c r="{"ABCDEFGHI"[i]}1" t="inlineStr"><is><t>{n}</t></is></c>' for i, n in enumerate(tables.GOLD)) + "</row>"
    sheet += '<row><c r="A2"><v>1.0</v></c><c r="B2" t="s"><v>0</v></c><c r="D2"><v>3</v></c><c r="E2"><v>9</v></c><c r="I2"><v>990000101</v></c></row></sheetData></worksheet>'
    path = tmp_path / "g.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>do</t><t>c</t></si></sst>')
    r = tables.read_sheet(spark, str(path)).first()
    assert (r["nivel"], r["documento_id"], r["inicio"], r["fim"], r["id_canonico"]) == (1, "doc", 3, 9, 990000101)
    archive = tmp_path / "a.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for name in ("root/x/a.txt", "__MACOSX/b", "root/.DS_Store", "../evil.txt", "root/"):
            z.writestr(name, "data")
    done = tables.extract(archive, tmp_path / "to", "root")
    assert sorted(p.relative_to(tmp_path / "to").as_posix() for p in done) == ["evil.txt", "x/a.txt"]
    assert len(tables.sha256(archive)) == 64


def test_csv_with_a_mark(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes('﻿documento_id,citacoes\r\na,"1,2,real,1,1"\r\nb,"x\ny"\r\n'.encode())
    assert [tuple(r)[:2] for r in tables.read_csv(spark, str(path), ["documento_id", "citacoes"]).collect()] == [("a", "1,2,real,1,1"), ("b", "x\ny")]
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(path), ["other"])


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "build_session", lambda name: spark)
    make_database(tmp_path / "b.db")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Veja o HC 555.444/RS e a Súmula 83 do STJ.")
    (tmp_path / "in" / "b.txt").write_text("Nada.")
    args = [str(tmp_path / "in"), "--database", str(tmp_path / "b.db"), "--csv", str(tmp_path / "o.csv"), "--output", str(tmp_path / "json"), "--save-tables", str(tmp_path / "tables")]
    assert cli.main(args) == 0
    first = (tmp_path / "o.csv").read_bytes()
    assert first.startswith(b'documento_id,citacoes\r\na,"7,20,real,103,1.0000|') and first.endswith(b"b,-\r\n") and len(list((tmp_path / "json").iterdir())) == 2
    assert cli.main([args[0], "--tables", str(tmp_path / "tables"), "--csv", str(tmp_path / "o.csv")]) == 0 and (tmp_path / "o.csv").read_bytes() == first
    (tmp_path / "e.csv").write_text("documento_id\na\nlost\n")
    assert cli.main([*args[:5], "--expected", str(tmp_path / "e.csv")]) == 1 and (tmp_path / "o.csv").read_bytes() == first
    assert cli.main([str(tmp_path / "none"), *args[1:5]]) == 1 and cli.main([args[0]]) == 2
    capsys.readouterr()


def test_guard():
    assert guarded(lambda: 3, 5.0) == 3
    with pytest.warns(UserWarning):
        assert guarded(lambda: 1 / 0, 5.0) is None
    with pytest.warns(UserWarning):
        assert guarded(lambda: [i for i in range(10**9)], 0.05) is None


def test_index_as_json(spark, base, cited, tmp_path):
    path = tmp_path / "index.json"
    index.to_json(base, str(path))
    data = json.loads(path.read_text())
    assert data["numeros"]["7654321"] == ["doc_a", "doc_b"] and data["registros"]["doc_a"]["id"] == 101 and ["STF", True, 11, 203] in data["sumulas"] and data["leis"]["CPC"] == ["13105", 2015]
    key = lambda b: sorted((r["documento_id"], r["caminho"], r["id_canonico"]) for r in verify(cited, b).collect())
    assert key(index.from_json(spark, str(path))) == key(base)


def test_functions_for_sql(spark):
    from citaforge.functions import sql

    sql.register(spark)
    spark.createDataFrame([(1, "Veja o HC 555.444/RS e a Súmula 83 do STJ."), (2, None)], "k int, t string").createOrReplaceTempView("textos")
    found = spark.sql("select k, c.* from textos, lateral detect_citations(t) c").orderBy("inicio").collect()
    assert [(r["k"], r["trecho"], r["familia"]) for r in found] == [(1, "HC 555.444/RS", "processo"), (1, "Súmula 83 do STJ", "sumula")]
    r = spark.sql("select identifier_digits('REsp 1.234.567/SP') d, diploma_code('Código Civil') c, court_acronym('5TJ') t, article_key('5o') a, class_marks('EDcl no RE') m, diploma_code(null) n").first()
    assert tuple(r) == ("1234567", "CC", "STJ", "5", ["edcl", "re"], None)


def test_simulation_is_deterministic(spark, base):
    from citaforge.operators.simulate import simulate

    text = "Conforme o HC 1.111/SP, a Súmula 1 do STJ, o art. 1 do CPC e o Tema 9, no julgado X."
    spans = [("HC 1.111/SP", "processo", "real"), ("Súmula 1 do STJ", "sumula", "inventada"), ("art. 1 do CPC", "dispositivo", "real"), ("Tema 9", "tema", "inventada"), ("julgado X", "vaga", "incompleta")]
    docs = spark.createDataFrame([(f"d{i}", text) for i in range(20)], "documento_id string, texto string")
    gold = spark.createDataFrame([(f"d{i}", text.index(t), text.index(t) + len(t), f, c) for i in range(20) for t, f, c in spans], "documento_id string, inicio int, fim int, familia string, classificacao string")
    new, moved = simulate(docs, gold, base, 7)
    again, _ = simulate(docs.repartition(3), gold.repartition(2), base, 7)
    texts = {r[0]: r[1] for r in new.collect()}
    assert texts == {r[0]: r[1] for r in again.collect()} and len(set(texts.values())) > 10 and all(k.endswith("_s7") for k in texts)
    rows = moved.collect()
    assert len(rows) == 100 and all(texts[r["documento_id"]][r["inicio"] : r["fim"]] == r["trecho"] for r in rows)
    assert {(r["familia"], r["id_canonico"]) for r in rows if r["classificacao"] == "real"} >= {("processo", 103)}
