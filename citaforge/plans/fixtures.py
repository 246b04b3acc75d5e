"""Opinions, a base, gold and predictions derived from the `orders` table by SQL that both engines run.

Where each citation stands, and what it should resolve to, follows from the
construction, so the expected results need no detector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_HEAD = "concat('EXCELENTÍSSIMO SENHOR MINISTRO RELATOR', chr(10), 'SUPERIOR TRIBUNAL DE JUSTIÇA', chr(10), chr(10), 'Autos nº ', cast(k as string), '-25.2016.3.05.9083', chr(10), chr(10), 'PARECER', chr(10), chr(10))"
_DOTTED = "concat(cast(cast(floor(n / 1000000) as bigint) as string), '.', lpad(cast(cast(floor(n / 1000) as bigint) % 1000 as string), 3, '0'), '.', lpad(cast(n % 1000 as string), 3, '0'))"

#: One row per order with the pieces of its opinion.
PIECES = f"""
select k, concat('d', cast(k as string)) as documento_id, n, s, a, alvo, {_HEAD} as head,
       concat('REsp ', case when k % 5 = 0 then replace({_DOTTED}, '0', 'O') else {_DOTTED} end, '/SP') as c1,
       concat('Súmula ', cast(s as string), ' do STJ') as c2,
       concat('art. ', cast(a as string), ' do CPC') as c3,
       case when k % 7 = 0 then 'julgado do STF proferido em 2024 pela relatoria de Fulano de Tal' end as c4
from (select k, alvo, 1234567 + alvo * 7 as n, 1 + c % 40 as s, 1 + k % 50 as a
      from (select cast(o_orderkey as bigint) as k, cast(o_custkey as bigint) as c,
                   cast(o_orderkey as bigint) - case when o_orderkey % 3 = 2 then 2 else 0 end as alvo from {{orders}}) x) y
"""
_TEXT = "concat(head, 'Conforme o ', c1, ', no ponto. Aplica-se a ', c2, ' ao caso. Nos termos do ', c3, ', o pedido procede.', case when c4 is null then '' else concat(' Cita-se o ', c4, '.') end)"
OPINIONS = f"select documento_id, {_TEXT} as texto, cast(length(head) as bigint) as corpo from ({PIECES}) p"

_S1 = "length(head) + length('Conforme o ')"
_S2 = f"{_S1} + length(c1) + length(', no ponto. Aplica-se a ')"
_S3 = f"{_S2} + length(c2) + length(' ao caso. Nos termos do ')"
_S4 = f"{_S3} + length(c3) + length(', o pedido procede. Cita-se o ')"


def _gold(start: str, column: str, family: str, label: str, key: str, path: str) -> str:
    return (
        f"select documento_id, k, cast({start} as bigint) as inicio, cast({start} + length({column}) as bigint) as fim, {column} as trecho, '{family}' as familia, "
        f"{label} as classificacao, cast({key} as bigint) as id_canonico, {path} as caminho from ({PIECES}) p"
    )


#: Every citation with its place, label, id and path of decision.
GOLD = " union all ".join(
    [
        _gold(_S1, "c1", "processo", "case when alvo % 3 = 0 then 'real' else 'inventada' end", "case when alvo % 3 = 0 then 900000000 + alvo end", "case when alvo % 3 <> 0 then 'inventada_processo' when alvo % 30 = 0 then 'real_desempate_classe' else 'real_unico' end"),
        _gold(_S2, "c2", "sumula", "case when s % 2 = 0 then 'real' else 'inventada' end", "case when s % 2 = 0 then 800000000 + s end", "case when s % 2 = 0 then 'real_tabela' else 'inventada_tabela' end"),
        _gold(_S3, "c3", "dispositivo", "case when a % 3 = 0 then 'real' else 'inventada' end", "case when a % 3 = 0 then 700000000 + a end", "case when a % 3 = 0 then 'real_tabela' else 'inventada_tabela' end"),
        _gold(_S4, "c4", "vaga", "'incompleta'", "null", "'incompleta_vaga'") + " where c4 is not null",
    ]
)


def _ruling(prefix: str, name: str, ids: str, condition: str) -> str:
    text = f"concat('{name} Nº ', {_DOTTED}, ' - RS (2021/0123456-7)', chr(10), 'RELATOR : MINISTRO FULANO DE TAL', chr(10), 'RECORRENTE : EMPRESA SINTÉTICA', chr(10), 'EMENTA', chr(10), 'PROCESSUAL CIVIL. Recurso ', cast(k as string), '.', chr(10), 'RELATÓRIO', chr(10), 'Trata-se de recurso.', chr(10), 'VOTO', chr(10), 'Nego provimento.')"
    return f"select concat('{prefix}', cast(k as string)) as documento_id, {ids} + k as id, 'STJ' as tribunal, 'Acórdão' as natureza, {text} as texto from ({PIECES}) p where {condition}"


#: The base: rulings for every third order, some twice under another class, precedents with even and articles with threefold numbers, and records that can't be read.
BASE = " union all ".join(
    [
        _ruling("a", "RECURSO ESPECIAL", "900000000", "k % 3 = 0"),
        _ruling("b", "AGRAVO INTERNO NO RECURSO ESPECIAL", "910000000", "k % 30 = 0"),
        f"select concat('s', cast(s as string), '_', cast(k as string)), 800000000 + s, 'stj ', 'súmula', concat('Súmula n. ', cast(s as string), ' do STJ', chr(10), 'TEMA SINTÉTICO') from ({PIECES}) p where s % 2 = 0",
        f"select concat('t', cast(a as string), '_', cast(k as string)), 700000000 + a, cast(null as string), 'dispositivo', concat('Artigo ', cast(a as string), ' da Lei nº 13.105, de 16 de março de 2015', chr(10), 'Texto.') from ({PIECES}) p where a % 3 = 0",
        f"select concat('x', cast(k as string)), 600000000 + k, cast(null as string), 'sumula', 'Enunciado sem número' from ({PIECES}) p where k % 100 = 0",
    ]
)

#: Predictions: gold moved by up to three characters, every eleventh dropped, one in thirteen labelled anew, one spurious for every ninth document.
PREDICTIONS = f"""
select documento_id, inicio + k % 4 as inicio, fim + k % 4 as fim, case when k % 13 = 0 then 'inventada' else classificacao end as classe,
       case when k % 13 = 0 then null when k % 17 = 0 then id_canonico + 1 else id_canonico end as id,
       case when k % 13 = 0 then 0.5 else 1.0 end as confianca, caminho
from ({GOLD}) g where k % 11 <> 0
union all select documento_id, 1, 9, 'real', 1, 0.5, 'real_unico' from ({PIECES}) p where k % 9 = 0
"""
GOLD_ROWS = f"select documento_id, inicio, fim, classificacao as classe, id_canonico as id, 1 + k % 2 as nivel from ({GOLD}) g"


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a statement over orders. The keys are few bytes from which long texts are made, so they are dealt out first."""
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return spark.sql(sql, orders=keys.repartition(spark.sparkContext.defaultParallelism))


def oracle(sql: str) -> str:
    return sql.replace("{orders}", "orders")


def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, OPINIONS)


def base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return derive(spark, sf_dir, BASE).withColumn("texto_len", F.length("texto").cast("bigint"))
