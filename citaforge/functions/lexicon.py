"""Closed vocabularies of the citation domain.

Every table here is a fixed value: results depend on it word for word.
"""

from __future__ import annotations

# Federal units.
UNITS = "AC AL AP AM BA CE DF ES GO MA MT MS MG PA PB PR PE PI RJ RN RS RO RR SC SP SE TO".split()

# Letters that optical recognition puts in place of digits.
DIGIT_OF = {"O": "0", "o": "0", "l": "1", "I": "1", "i": "1", "S": "5", "s": "5", "g": "9", "q": "9", "G": "6", "b": "6", "B": "8", "Z": "2", "z": "2"}

# Letters that it puts in place of letters.
CONFUSED_AS = {"a": "ã", "e": "c", "c": "e", "i": "l", "o": "0", "m": "rn", "u": "ii", "n": "ri"}

# Superior courts, families of citations, labels.
COURTS = {
    "STF": "Supremo Tribunal Federal",
    "STJ": "Superior Tribunal de Justiça",
    "TST": "Tribunal Superior do Trabalho",
    "TSE": "Tribunal Superior Eleitoral",
    "STM": "Superior Tribunal Militar",
}
PRECEDENCE = ("dispositivo", "sumula", "tema", "vaga", "processo")
KINDS = ("jurisprudencia", "lei")
LABELS = ("real", "inventada", "incompleta")

# States by name.
STATES = {
    "Acre": "AC", "Alagoas": "AL", "Amapá": "AP", "Amazonas": "AM", "Bahia": "BA", "Ceará": "CE", "Distrito Federal e dos Territórios": "DFT",
    "Distrito Federal": "DF", "Espírito Santo": "ES", "Goiás": "GO", "Maranhão": "MA", "Mato Grosso do Sul": "MS", "Mato Grosso": "MT",
    "Minas Gerais": "MG", "Pará": "PA", "Paraíba": "PB", "Paraná": "PR", "Pernambuco": "PE", "Piauí": "PI", "Rio de Janeiro": "RJ",
    "Rio Grande do Norte": "RN", "Rio Grande do Sul": "RS", "Rondônia": "RO", "Roraima": "RR", "Santa Catarina": "SC", "São Paulo": "SP",
    "Sergipe": "SE", "Tocantins": "TO",
}
ORDINALS = "Primeira Segunda Terceira Quarta Quinta Sexta Sétima Oitava Nona".split()

# Words of prose that look like links of a citation.
PROSE = frozenset(
    "tambem também ademais igualmente outrossim ainda assim ja já entao então porem porém contudo todavia entretanto alias aliás "
    "inclusive ali aqui confira confiram veja vejam vejase veja-se vide cita cita-se citese citamos conforme segundo consoante nesse "
    "neste nessa nesta naquele naquela destarte portanto logo pois tal tais este esta esse essa aquele aquela".split()
)
# Courts, bodies and offices; they end a citation's prefix.
INSTITUTIONS = frozenset(
    "tribunal tribunais supremo superior justica ministro ministra min relator relatora rel desembargador desembargadora juiz juiza "
    "turma corte plenario pleno secao camara orgao egregio colendo stf stj tse tst stm".split()
)
# Nouns that head the name of a class of proceedings.
CLASS_NOUNS = frozenset(
    "recurso agravo embargos reclamacao habeas mandado acao apelacao peticao inquerito conflito suspensao extradicao revisao "
    "representacao consulta".split()
)
# Contractions, and words that join a number to prose.
CONTRACTIONS = frozenset("da do das dos na no nas nos".split())
JOINERS = PROSE | frozenset(
    "a o as os ao aos um uma uns umas de da do das dos em na nas nos num numa e ou que com por pela pelo pelas pelos para sem sob sobre "
    "entre ate apos desde contra como cerca mais menos quase cada seu sua seus suas todos todas mas nem so foi foram sao era eram sera "
    "serao seria ha houve havia tem teve tinha".split()
)

# Statutes cited by name, with what may follow the name.
STATUTES = (
    ("Estatuto da Criança e do Adolescente", ()),
    ("Estatuto do Idoso", ()),
    ("Estatuto da Pessoa Idosa", ()),
    ("Estatuto da Advocacia", ("e da Ordem dos Advogados do Brasil", "e da OAB")),
    ("Estatuto da Ordem dos Advogados do Brasil", ()),
    ("Estatuto da OAB", ()),
    ("Estatuto do Desarmamento", ()),
    ("Estatuto da Pessoa com Deficiência", ()),
    ("Lei de Execução Penal", ()),
    ("Lei de Introdução às Normas do Direito Brasileiro", ()),
    ("Lei de Introdução ao Direito Brasileiro", ()),
    ("Lei de Introdução ao Código Civil", ()),
    ("Lei Maria da Penha", ()),
    ("Lei de Drogas", ()),
    ("Lei Antidrogas", ()),
    ("Lei das Eleições", ()),
    ("Lei de Improbidade", ("Administrativa",)),
    ("Lei dos Juizados Especiais", ("Cíveis e Criminais", "da Fazenda Pública", "Federais", "Criminais", "Cíveis")),
    ("Lei da Ação Civil Pública", ()),
    ("Lei do Mandado de Segurança", ()),
    ("Lei de Execução Fiscal", ()),
    ("Lei de Execuções Fiscais", ()),
    ("Lei dos Crimes Hediondos", ()),
    ("Nova Lei de Licitações", ("e Contratos Administrativos", "e Contratos")),
    ("Lei de Licitações", ("e Contratos Administrativos", "e Contratos")),
    ("Lei das Inelegibilidades", ()),
    ("Lei de Inelegibilidade", ()),
    ("Lei da Ficha Limpa", ()),
    ("Lei Orgânica da Magistratura Nacional", ()),
    ("Lei de Responsabilidade Fiscal", ()),
)
STATUTE_ACRONYMS = "CPPM CPC CPP CPM CLT CDC CRFB NCPC CTN CTB ECA LINDB LIDB LICC LOMAN LEP LRF LEF CF CC CP".split()

# Codes of laws with a name of their own, by kind and number.
NAMED_LAWS = {
    ("lei", "13105"): "CPC", ("decreto-lei", "3689"): "CPP", ("decreto-lei", "1001"): "CPM", ("decreto-lei", "1002"): "CPPM",
    ("decreto-lei", "2848"): "CP", ("decreto-lei", "5452"): "CLT", ("lei", "8078"): "CDC", ("lei", "10406"): "CC", ("lei", "4737"): "ELEITORAL",
    ("lei complementar", "64"): "LC64", ("lei", "5172"): "CTN", ("lei", "8069"): "ECA", ("lei", "9503"): "CTB",
}
LAW_PREFIX = {"lei": "LEI", "decreto-lei": "DL", "lei complementar": "LC"}

# Laws by name (the first that the key contains), then by acronym: kind, number, year.
LAWS_BY_NAME = (
    ("estatuto da crianca e do adolescente", "lei", "8069", 1990),
    ("estatuto da pessoa idosa", "lei", "10741", 2003),
    ("estatuto do idoso", "lei", "10741", 2003),
    ("estatuto da pessoa com deficiencia", "lei", "13146", 2015),
    ("estatuto do desarmamento", "lei", "10826", 2003),
    ("estatuto da advocacia", "lei", "8906", 1994),
    ("estatuto da ordem dos advogados", "lei", "8906", 1994),
    ("estatuto da oab", "lei", "8906", 1994),
    ("lei de execucao penal", "lei", "7210", 1984),
    ("lei de introducao as normas do direito brasileiro", "decreto-lei", "4657", 1942),
    ("lei de introducao ao direito brasileiro", "decreto-lei", "4657", 1942),
    ("lei de introducao ao codigo civil", "decreto-lei", "4657", 1942),
    ("lei maria da penha", "lei", "11340", 2006),
    ("lei de drogas", "lei", "11343", 2006),
    ("lei antidrogas", "lei", "11343", 2006),
    ("lei das eleicoes", "lei", "9504", 1997),
    ("lei de improbidade", "lei", "8429", 1992),
    ("lei dos juizados especiais federais", "lei", "10259", 2001),
    ("lei dos juizados especiais da fazenda publica", "lei", "12153", 2009),
    ("lei dos juizados especiais", "lei", "9099", 1995),
    ("lei da acao civil publica", "lei", "7347", 1985),
    ("lei do mandado de seguranca", "lei", "12016", 2009),
    ("lei de execucao fiscal", "lei", "6830", 1980),
    ("lei de execucoes fiscais", "lei", "6830", 1980),
    ("lei dos crimes hediondos", "lei", "8072", 1990),
    ("nova lei de licitacoes", "lei", "14133", 2021),
    ("lei de licitacoes", "lei", "8666", 1993),
    ("lei das inelegibilidades", "lei complementar", "64", 1990),
    ("lei de inelegibilidade", "lei complementar", "64", 1990),
    ("lei da ficha limpa", "lei complementar", "135", 2010),
    ("lei organica da magistratura nacional", "lei complementar", "35", 1979),
    ("lei de responsabilidade fiscal", "lei complementar", "101", 2000),
)
LAWS_BY_ACRONYM = {
    "lep": ("lei", "7210", 1984), "lindb": ("decreto-lei", "4657", 1942), "lidb": ("decreto-lei", "4657", 1942), "licc": ("decreto-lei", "4657", 1942),
    "loman": ("lei complementar", "35", 1979), "lrf": ("lei complementar", "101", 2000), "lef": ("lei", "6830", 1980),
}
LAW_YEARS = {"CF": 1988, "CPC": 2015, "CPP": 1941, "CPM": 1969, "CPPM": 1969, "CP": 1940, "CDC": 1990, "CLT": 1943, "LC64": 1990, "ELEITORAL": 1965, "CC": 2002, "CTN": 1966, "ECA": 1990, "CTB": 1997}

# Fixed values, in order: markers that tell a diploma, words that rule it out, its code. The first hit decides.
DIPLOMAS = (
    (("processo penal militar", "cppm"), (), "CPPM"),
    (("processo civil", "13.105", "13105", "cpc", "ncpc"), (), "CPC"),
    (("processo penal", "3.689", "3689", "cpp"), ("militar",), "CPP"),
    (("penal militar", "1.001", "1001", "cpm"), (), "CPM"),
    (("defesa do consumidor", "codigo do consumidor", "8.078", "8078", "cdc"), (), "CDC"),
    (("consolidacao das leis", "clt", "5.452", "5452"), (), "CLT"),
    (("constituic", "carta magna", "lei maior", "carta politica", "carta da republica", "cf", "crfb"), (), "CF"),
    (("lei complementar", "lc", "64/1990"), (), "LC64"),
    (("eleitoral", "4.737", "4737"), (), "ELEITORAL"),
    (("civil", "cc", "10.406", "10406"), (), "CC"),
    (("codigo penal", "cp", "2.848", "2848"), ("militar", "processo"), "CP"),
    (("tributario nacional", "ctn", "5.172", "5172"), (), "CTN"),
    (("crianca e do adolescente", "eca", "8.069", "8069"), (), "ECA"),
    (("transito brasileiro", "ctb", "9.503", "9503"), (), "CTB"),
)
CONSTITUTION_WORDS = ("federal", "republica", "federativa", "brasileira", "brasil", "cidada")
DIPLOMA_WORDS = frozenset(
    "codigo processo civil penal militar defesa consumidor consolidacao leis trabalho constituicao federal republica federativa brasil "
    "brasileira estadual estado eleitoral lei complementar decreto carta magna de do da das dos".split()
)

# Fixed values, in order: patterns of class marks over accent-free lower-case text; the first alternative wins.
CLASS_MARKS = (
    (r"ag(?:ravo)?\s*int(?:erno)?|agint", "agint"),
    (r"ag(?:ravo)?\s*\.?\s*reg(?:imental)?|agrg|agr", "agrg"),
    (r"emb(?:argos)?\s*\.?\s*(?:de\s+)?decl(?:aracao)?|edcl|eds?", "edcl"),
    (r"emb(?:argos)?\s*\.?\s*(?:de\s+)?div(?:ergencia)?|edv|eresp", "edv"),
    (r"pedido\s+de\s+extensao|pext", "pext"),
    (r"embargos\s+infringentes(?:\s+e\s+de\s+nulidade)?|einf", "einf"),
    (r"quest[aã]o\s+de\s+ordem|qo", "qo"),
    (r"recurso\s+em\s+habeas\s+corpus|rhc", "rhc"),
    (r"recurso\s+em\s+mandado\s+de\s+seguranca|rms", "rms"),
    (r"agravo\s+em\s+recurso\s+especial(?:\s+eleitoral)?|aresp|arespe(?:l)?", "aresp"),
    (r"recurso\s+especial\s+eleitoral|respe", "respe"),
    (r"recurso\s+especial|r\.?\s*esp|resp", "resp"),
    (r"recurso\s+extraordinario\s+com\s+agravo|are", "are"),
    (r"recurso\s+extraordinario|re", "re"),
    (r"recurso\s+ordinario|ro", "ro"),
    (r"recurso\s+em\s+sentido\s+estrito|rse", "rse"),
    (r"recurso\s+de\s+revista|rr", "rr"),
    (r"habeas\s+corpus|h\.?\s*c|hc", "hc"),
    (r"mandado\s+de\s+seguranca|ms", "ms"),
    (r"reclamacao|rcl", "rcl"),
    (r"apelacao(?:\s+criminal)?|apl", "apl"),
    (r"acao\s+rescisoria|ar", "ar"),
)
INCIDENTS = frozenset("agint agrg edcl edv pext einf qo".split())

# Confidence by the path of the decision.
CONFIDENCE = {
    "real_unico": 1.0,
    "real_desempate_classe": 1.0,
    "real_desempate": 0.50,
    "real_tabela": 1.0,
    "inventada_processo": 1.0,
    "inventada_tabela": 1.0,
    "inventada_tema": 1.0,
    "incompleta_vaga": 1.0,
    "incompleta_sem_numero": 0.70,
}

# Labels of header lines, and what reverses noise in a title.
HEADER_LABELS = ("autos", "processo", "protocolo", "recurso", "origem", "refer", "ref.", "classe", "valor da causa", "oab", "fls")
TITLE_LETTERS = {"0": "O", "1": "I", "5": "S", "8": "B", "6": "G", "2": "Z"}

SCHEMA_VERSION = "1.2"
