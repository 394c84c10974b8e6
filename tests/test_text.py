from pyspark.sql import functions as F

from waymark.functions import geo, logs, text


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_services(spark):
    every = text.SERVICES
    cases = {
        "Botrópico, Crotálico, Loxoscélico, Fonêutrico e Escorpiônico.": ["Botrópico", "Crotálico", "Escorpiônico", "Loxoscélico", "Foneutrico"],
        "Botrópico, Crotálico, Elapídico, Laquético, Escorpiônico, Loxoscélico, Fonêutrico e Lonômico": every,
        "Escorpiônico": ["Escorpiônico"],
        "BOTRÓPICO, CROTÁLICO, Loxoscélico, Fonêutrico E ESCORPIÔNICO": ["Botrópico", "Crotálico", "Escorpiônico", "Loxoscélico", "Foneutrico"],
        "Botrópico, Escorpiônico, Loxoscélico e Fonêutrico": ["Botrópico", "Escorpiônico", "Loxoscélico", "Foneutrico"],
        "Botrópico, Crotálico, Botrópico-Crotálico, Elapídico, Escorpiônico, Loxoscélico, Fonêutrico e Lonômico": [s for s in every if s != "Laquético"],
        "Botrópico": ["Botrópico"],
        "": [],
        None: [],
        "Hospital aberto 24h": [],
        ",,,": [],
    }
    assert column(spark, list(cases), text.services) == list(cases.values())


def test_addresses(spark):
    # the first four pairs, and the streets below, are given cases
    dirty = ["Rua X, 10 - Centro (11) 4411-0062", "Av. Y, 500, s/n", "Rua Z, Qd. 07, s/nº", "Rua W - 3856-9600", None]
    assert column(spark, dirty, text.clean_address) == ["Rua X, 10 - Centro", "Av. Y, 500", "Rua Z, Qd. 07", "Rua W", None]
    whole = ["Rua Joaquim Luiz Viana, 209 - Vila Cicma", "Avenida Vital Brasil, 1500 - Instituto Butantan", "Praça D. Pedro II, 1826 - Centro", "12 de Outubro"]
    assert column(spark, whole, text.street) == ["Rua Joaquim Luiz Viana", "Avenida Vital Brasil", "Praça D. Pedro II", "12 de Outubro"]


def test_numbers_in_addresses(spark):
    gone = ["(11) 4411-0062", "(011)441-006", "(11)  44110 00620", "(11)44110062", "4411-0062", "44110 0062", "S/Nº", "s/no", "(casa (2)", "()"]
    kept = ["441-0062", "4411-006", "441100-0062", "4411-00621", "x4411-0062", "as/n", "s/nx", "4411_0062", "(11 44"]
    assert column(spark, [f"Rua A {x}, 7" for x in gone], text.clean_address) == ["Rua A , 7"] * len(gone)
    assert column(spark, [f"Rua A {x}, 7" for x in kept], text.clean_address) == [f"Rua A {x}, 7" for x in kept]
    assert column(spark, ["(1) 2345", "4411-0062/123", "441/00620/1234", "x(11)441006", "12345678", "123456", "441-00/12", "12-3456", "4411-0062/12"], text.token_class) == ["telefone"] * 4 + [None] * 5


def test_codes_and_tokens(spark):
    assert column(spark, ["", "abc", "1234", "123-456", None, "13280-000"], text.postal_code) == [None] * 5 + ["13280000"]
    words = ["(11)", "4411-0062", "(11) 4411-0062", "1234567|", "Fonêutrico,", "Centro", " .|", None]
    assert column(spark, words, text.token_class) == ["telefone", "telefone", "telefone", "cnes", "atendimento", None, None, None]
    assert column(spark, ["  JARARACA ", "aranha marrom", "Escorpião", "gato", None], text.canonical_service) == ["Botrópico", "Loxoscélico", "Escorpiônico", None, None]


def test_folding_and_space(spark):
    assert column(spark, ["Ñandú Ç á", None], text.fold) == ["Nandu C a", None]
    assert column(spark, ["ÑANDÚ Ção"], text.fold_stored) == ["Ñandu cao".lower()]
    assert column(spark, [" a \n b ", None], text.squeeze) == ["a b", ""]


def test_labels_and_clamps(spark):
    assert column(spark, [0.25, 0.9999, 1.0, 12.34, None], text.distance_label, "double") == ["250 m", "1000 m", "1.0 km", "12.3 km", None]
    assert column(spark, ["abc", None, "-4", "7", "900"], lambda c: text.clamp(c, 100, 500)) == [100, 100, 0, 7, 500]


def test_log_fields(spark):
    assert column(spark, ["/v1/hospitais/12", "/v1/estados/sp?x=1", "/v1/estados", "/v1/hospitais?q=1"], logs.route) == ["/v1/hospitais/:id", "/v1/estados/:uf", "/v1/estados", "/v1/hospitais"]
    assert column(spark, ["unknown", None, ""], lambda c: logs.ip_hash(c, "s")) == [None, None, None]
    assert len(column(spark, ["10.0.0.1"], lambda c: logs.ip_hash(c, "s"))[0]) == 16
    assert column(spark, [" 1.1.1.1 , 2.2.2.2", "", None], lambda c: logs.client_ip(c, F.lit(""), F.lit(None).cast("string"))) == ["1.1.1.1", "unknown", "unknown"]


def test_distance(spark):
    one = spark.range(1).select(geo.distance(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)), geo.distance(F.lit(10.0), F.lit(20.0), F.lit(10.0), F.lit(20.0)), geo.km(F.lit(650.0))).first()
    assert abs(one[0] - 3.141592653589793 * geo.RADIUS) < 1
    assert one[1] == 0
    assert one[2] == 0.7
