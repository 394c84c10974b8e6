"""Directory, log, page and layout tables derived from the given tables, so that work grows with them.

Each is one SQL text for both engines, with {name} for a table; `words` has a text for each, since the engines' lists differ, and so has `shapes`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations"]

SQL = {
    "fac": """
SELECT CAST(c_custkey AS INT) AS id,
  split_part('AC,AL,AP,AM,BA,CE,DF,ES,GO,MA,MT,MS,MG,PA,PB,PR,PE,PI,RJ,RN,RS,RO,RR,SC,SP', ',', CAST(c_nationkey + 1 AS INT)) AS uf,
  split_part('São Paulo|Jundiaí|Ribeirão Preto|Macapá|Florianópolis|Bauru|Campinas|Botucatu|Goiânia|Bom Jesus|Teófilo Otoni', '|', CAST(1 + (c_custkey * 31) % 11 AS INT)) AS municipio,
  concat(split_part('Santa Casa|Hospital Geral|UPA Central|Unidade Mista', '|', CAST(1 + c_custkey % 4 AS INT)), ' ', c_name) AS unidade,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE concat(split_part('Rua|Avenida|Praça', '|', CAST(1 + c_custkey % 3 AS INT)), ' ', c_mktsegment, ', ', CAST(c_custkey % 900 + 1 AS VARCHAR(10)),
    CASE WHEN c_custkey % 5 = 0 THEN ' - Centro (11) 4411-0062' WHEN c_custkey % 5 = 1 THEN ', s/n' ELSE '' END) END AS endereco,
  CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE lpad(CAST((c_custkey * 7919) % 10000000 AS VARCHAR(10)), 7, '0') END AS cnes,
  concat_ws(', ', CASE WHEN c_custkey % 2 = 0 THEN 'BOTRÓPICO' END, CASE WHEN c_custkey % 3 = 0 THEN 'Crotálico' END,
    CASE WHEN c_custkey % 5 = 0 THEN 'Elapidico' END, CASE WHEN c_custkey % 7 = 0 THEN 'Laquético' END,
    CASE WHEN c_custkey % 4 = 1 THEN 'escorpiônico' END, CASE WHEN c_custkey % 6 = 1 THEN 'Loxoscélico' END,
    CASE WHEN c_custkey % 9 = 2 THEN 'Fonêutrico' END, CASE WHEN c_custkey % 11 = 3 THEN 'Lonômico' END) AS atendimentos_raw,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST((c_custkey * 7919) % 38000 - 33000 AS DOUBLE) / 1000 END AS lat,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST((c_custkey * 104729) % 38000 - 73000 AS DOUBLE) / 1000 END AS lng,
  CASE WHEN c_custkey % 8 = 0 THEN 'pdf_ocr' ELSE 'pdf_texto' END AS fonte_extracao
FROM {customer}""",
    "addr": """
SELECT id, base, concat(CASE WHEN noise_at = 0 THEN concat(noise, ' ') ELSE '' END, base, CASE WHEN noise_at > 0 THEN concat(split_part(' | - |, ', '|', noise_at), noise) ELSE '' END, CASE WHEN noise_at = 3 THEN ' , ' ELSE '' END) AS dirty
FROM (SELECT id, CAST(id % 4 AS INT) AS noise_at,
  concat(split_part('Rua|Avenida|Praça|Km 21,|Qd. 07,', '|', CAST(1 + id % 5 AS INT)), ' ', CAST(id AS VARCHAR(10)), split_part('| - Centro| 123-4567| 12-34 fundos|, sala 1234-567', '|', CAST(1 + (id * 7) % 5 AS INT))) AS base,
  CASE WHEN id % 11 < 5 THEN concat('(', substr('11987', 1, CAST(2 + id % 2 AS INT)), ')', substr('  ', 1, CAST(id % 3 AS INT)), substr('98765', 1, CAST(3 + (id * 3) % 3 AS INT)),
      split_part('-| |', '|', CAST(1 + (id * 5) % 3 AS INT)), substr('43210', 1, CAST(3 + (id * 11) % 3 AS INT)))
    WHEN id % 11 < 8 THEN concat(substr('38569', 1, CAST(4 + id % 2 AS INT)), CASE WHEN id % 3 = 0 THEN ' ' ELSE '-' END, '9600')
    WHEN id % 11 = 8 THEN split_part('s/n|S/N|s/nº|S/No', '|', CAST(1 + id % 4 AS INT))
    WHEN id % 11 = 9 THEN concat('(ao lado do ', CAST(id AS VARCHAR(10)), ')') ELSE '' END AS noise
 FROM (SELECT CAST(c_custkey AS BIGINT) AS id FROM {customer}) c) d""",
    "ori": """
SELECT s_suppkey AS origin_id, CAST((s_suppkey * 6007 + 11) % 38000 - 33000 AS DOUBLE) / 1000 AS lat, CAST((s_suppkey * 3571 + 7) % 38000 - 73000 AS DOUBLE) / 1000 AS lng FROM {supplier}""",
    "req": """
SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS criado_em,
  split_part('/v1/hospitais|/v1/hospitais/proximos|/v1/estados|/v1/hospitais/:id|/v1/estados/:uf', '|',
     CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 4 ELSE 5 END) AS rota,
  CASE WHEN k < 70 THEN 200 WHEN k < 80 THEN 404 WHEN k < 88 THEN 429 WHEN k < 95 THEN 400 ELSE 500 END AS status,
  CAST(floor(value * 10) AS INT) AS duracao_ms, concat('10.0.0.', CAST(user_id AS VARCHAR(10))) AS ip,
  CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN TRUE ELSE FALSE END AS cache_hit, (k >= 80 AND k < 88) AS rate_limited
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e""",
    "cur": """
SELECT *, CASE WHEN lat IS NOT NULL THEN 'ok' WHEN id % 2 = 0 THEN 'falhou' ELSE 'pendente' END AS geocode_status, concat('(11) 4411-', CAST(1000 + id % 9000 AS VARCHAR(8))) AS telefones, id % 100 AS confianca_ocr
FROM {fac} WHERE id % 10 <> 0""",
    "inc": """
SELECT id AS seq, uf, municipio, unidade, CASE WHEN id % 7 = 0 THEN concat(coalesce(endereco, ''), ' novo') ELSE endereco END AS endereco, cnes, atendimentos_raw,
  concat('(11) 4411-', CAST(1000 + id % 8999 AS VARCHAR(8))) AS telefones, 'pdf_texto' AS fonte_extracao
FROM {fac} WHERE id % 10 <> 1""",
    "pg": """
SELECT page_id, url, concat(html,
  CASE page_id % 4 WHEN 0 THEN '<a href="/docs/lista.PDF">a</a><a href="b.pdf">b</a>' WHEN 1 THEN '<a href="uf/@@download/file">a</a>' WHEN 2 THEN '<a href="https://h.example/x.xlsx">a</a>' ELSE '' END,
  CASE WHEN page_id % 3 = 0 THEN '' ELSE concat('<p>Atualizado', CASE WHEN page_id % 5 = 1 THEN ' <b>em</b> ' WHEN page_id % 5 = 2 THEN '<br>EM  ' ELSE ' em ' END, lpad(CAST(1 + page_id % 28 AS VARCHAR(4)), 2, '0'), '/02/2026 ', CAST(page_id % 24 AS VARCHAR(4)), 'h04</p>') END) AS html
FROM {pages}""",
    "shapes": """
SELECT DISTINCT doc_id, page, top - 2 + j AS top, CAST(0 AS DOUBLE) AS x0, CAST(720 AS DOUBLE) AS width, CAST(0.5 AS DOUBLE) AS height
FROM {words} CROSS JOIN (SELECT CAST(0 AS DOUBLE) AS j UNION ALL SELECT CAST(1.5 AS DOUBLE)) jitter
UNION ALL SELECT doc_id, page, max(top) + 12, CAST(0 AS DOUBLE), CAST(720 AS DOUBLE), CAST(0 AS DOUBLE) FROM {words} GROUP BY doc_id, page
UNION ALL SELECT DISTINCT doc_id, page, CAST(0 AS DOUBLE), CAST(floor(x0 / 120) * 120 - 5 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(400 AS DOUBLE) FROM {words}
UNION ALL SELECT doc_id, page, CAST(0 AS DOUBLE), CAST(715 AS DOUBLE), CAST(0 AS DOUBLE), CAST(400 AS DOUBLE) FROM {words} GROUP BY doc_id, page""",
    "uneven": """
SELECT doc_id, page, pos, text, x0, x1, CAST(l * 9 + l % 3 * 4 AS DOUBLE) AS top, CAST(l * 9 + l % 3 * 4 + 10 AS DOUBLE) AS bottom, confidence FROM (SELECT *, CAST(floor(pos / 12) AS INT) AS l FROM {words}) w""",
    "gz": """
SELECT query_key, CASE WHEN n % 3 = 0 THEN NULL ELSE lat END AS lat, CASE WHEN n % 3 = 0 THEN NULL ELSE lng END AS lng, 'gazetteer' AS fonte
FROM (SELECT concat(municipio, ', ', uf, ', Brasil') AS query_key, min(lat) AS lat, min(lng) AS lng, count(*) AS n FROM {fac} WHERE uf <> 'SP' GROUP BY municipio, uf
  UNION ALL SELECT concat(endereco, ', ', municipio, ', ', uf, ', Brasil'), lat, lng, 1 FROM {fac} WHERE endereco IS NOT NULL AND id % 6 = 0 AND lat IS NOT NULL) g""",
    "cep": """
SELECT lpad(CAST(id AS VARCHAR(8)), 8, '0') AS cep, municipio AS cidade, uf, CASE WHEN id % 4 = 0 THEN NULL ELSE lat END AS lat, CASE WHEN id % 4 = 0 THEN NULL ELSE lng END AS lng FROM {fac}""",
}

#: Boxes are laid out twelve to a line; whole texts take part.
WORDS_SPARK = r"""
SELECT doc_id, CAST(0 AS INT) AS page, CAST(pos AS INT) AS pos, text, CAST((pos % 12) * 60 AS DOUBLE) AS x0, CAST((pos % 12) * 60 + 50 AS DOUBLE) AS x1,
 CAST(floor(pos / 12) * 14 AS DOUBLE) AS top, CAST(floor(pos / 12) * 14 + 10 AS DOUBLE) AS bottom, CAST((doc_id * 31 + pos * 17) % 101 AS INT) AS confidence
 FROM (SELECT doc_id, posexplode(split(text, '[ \n]+')) AS (pos, text) FROM {documents}) w"""
WORDS_DUCK = r"""
SELECT doc_id, CAST(0 AS INT) AS page, CAST(pos AS INT) AS pos, text, CAST((pos % 12) * 60 AS DOUBLE) AS x0, CAST((pos % 12) * 60 + 50 AS DOUBLE) AS x1,
 CAST((pos // 12) * 14 AS DOUBLE) AS top, CAST((pos // 12) * 14 + 10 AS DOUBLE) AS bottom, CAST((doc_id * 31 + pos * 17) % 101 AS INT) AS confidence
 FROM (SELECT doc_id, unnest(w) AS text, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '[ \n]+') AS w FROM documents) a) b"""

#: The same shapes from the number of words alone, so that words needn't be made and sorted out again.
SHAPES_SPARK = r"""
SELECT doc_id, page, s.top AS top, s.x0 AS x0, s.width AS width, s.height AS height FROM (
 SELECT doc_id, CAST(0 AS INT) AS page, explode(concat(
  transform(sequence(0, CAST((n - 1) DIV 12 AS INT)), i -> named_struct('top', i * 14D - 2D, 'x0', 0D, 'width', 720D, 'height', 0.5D)),
  transform(sequence(0, CAST((n - 1) DIV 12 AS INT)), i -> named_struct('top', i * 14D - 0.5D, 'x0', 0D, 'width', 720D, 'height', 0.5D)),
  array(named_struct('top', CAST((n - 1) DIV 12 AS DOUBLE) * 14D + 12D, 'x0', 0D, 'width', 720D, 'height', 0D)),
  transform(sequence(0, CAST((least(n, 12) - 1) DIV 2 AS INT)), k -> named_struct('top', 0D, 'x0', k * 120D - 5D, 'width', 0.5D, 'height', 400D)),
  array(named_struct('top', 0D, 'x0', 715D, 'width', 0D, 'height', 400D)))) AS s
 FROM (SELECT doc_id, size(split(text, '[ \n]+')) AS n FROM {documents} WHERE text IS NOT NULL) counted) drawn"""

NEEDS = {"cur": ["fac"], "inc": ["fac"], "shapes": ["words"], "uneven": ["words"], "gz": ["fac"], "cep": ["fac"]}


def _names(sql: str) -> list[str]:
    return [n for n in [*BASE, *SQL, "words"] if "{" + n + "}" in sql]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = {"words": WORDS_SPARK, "shapes": SHAPES_SPARK}.get(name) or SQL[name]
    return spark.sql(sql, **{n: load(spark, sf_dir, n) for n in _names(sql)})


def duck(name: str) -> str:
    sql = WORDS_DUCK if name == "words" else SQL[name]
    for n in _names(sql):
        sql = sql.replace("{" + n + "}", n)
    return sql


def with_tables(*names: str, more: str = "") -> str:
    """The WITH clause that defines derived tables for DuckDB."""
    order: list[str] = []
    for name in names:
        for n in [*NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    parts = [f"{n} AS ({duck(n)})" for n in order]
    return "WITH " + ", ".join([*parts, *([more] if more else [])]) + " "
