import random

from pyspark.sql import functions as F

from fiscalis.operators import quality as qa
from fiscalis.operators import selection as se
from fiscalis.operators import sinks as sk
from fiscalis.operators.catalog import region_of, relevance

DIST = "distribution_id string, dataset_uri string, formato string, local_path string, ccaa_slug string"
UUID = "6026409b-1111-2222-3333-444455556666"
FILES = [
    ("1", "ds/a", "XLSX", "x/id__h__gasto-2020-enero.xlsx", "aragon"), ("2", "ds/a", "CSV", "x/id__h__gasto-2020-enero.csv", "aragon"),
    ("3", "ds/a", "CSV", "x/id__h__gasto-2020-diciembre.csv", "aragon"), ("4", "ds/b", "CSV", "x/id__h__ingresos.csv", "aragon"),
    ("5", "ds/plan-estrategico", "CSV", "x/id__h__g.csv", "galicia"), ("6", "ds/c", "CSV", f"x/id__h__{UUID}.csv", "aragon"),
    ("7", "ds/c", "CSV", "x/id__h__ejecucion_gastos.csv", "aragon"), ("8", "ds/d", "CSV", f"x/id__h__{UUID}.csv", "aragon"),
    ("9", "ds/e", "CSV", "x/id__h__ejecucion_2020_03_x.csv", "aragon"), ("10", "ds/e", "CSV", "x/id__h__ejecucion_2020_11_x.csv", "aragon"),
]


def test_selection_does_not_depend_on_order(spark):
    found = []
    for seed in (1, 2):
        rows = FILES[:]
        random.Random(seed).shuffle(rows)
        chosen = se.select_distributions(spark.createDataFrame(rows, DIST))
        found.append(sorted(r.distribution_id for r in chosen.collect()))
    assert found[0] == found[1] == ["10", "3", "7", "8"]


def test_period_spellings(spark):
    names = ["serie-a-2020-marzo", "ejecucion_2021_07_g", "elim_x_12_2022", "sin-fecha", "a-2020-xyz"]
    rows = spark.createDataFrame([(n,) for n in names], "resource string")
    got = {r.resource: (r.serie, r.anio, r.mes) for r in se.with_period(rows).collect()}
    assert got == {"serie-a-2020-marzo": ("serie-a", 2020, 3), "ejecucion_2021_07_g": ("ejecucion|ym|_g", 2021, 7),
                   "elim_x_12_2022": ("elim_x|my|", 2022, 12), "sin-fecha": (None, None, None), "a-2020-xyz": (None, None, None)}


def test_year_override_only_without_time_column(spark):
    years = spark.createDataFrame([("1", 2015)], "distribution_id string, year int")
    rows = spark.createDataFrame([("1", "x"), ("2", "y")], "distribution_id string, importe string")
    assert {r.distribution_id: r.anio for r in se.with_year_override(rows, years, rows.columns).collect()} == {"1": 2015, "2": None}
    assert "anio" not in se.with_year_override(rows, years, ["Año", "importe"]).columns


def test_region_classifier(spark):
    rows = [("E05250001", None), ("L01280066", None), ("L01200006", None), ("L02000020", None), (None, None),
            (None, ["http://x/Provincia/9", "http://x/Autonomia/Pais-Vasco"]), ("L0199", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, s array<string>")
    got = [r[0] for r in df.orderBy("i").select(region_of(F.col("p"), F.col("s"))).collect()]
    assert got == ["nacional", "madrid", "pais-vasco", "pais-vasco", "nacional", "pais-vasco", "nacional"]


def test_relevance(column):
    assert column(lambda c: relevance(c, F.lit(None).cast("string")), ["Liquidacion y ejecucion del presupuesto de gastos", None]) == [20, 0]


FACT = ("ccaa_slug string, entidad_id string, anio int, trimestre int, capitulo_id int, grupo_funcional_id string, "
        "fase string, importe_eur double, dataset_uri string, distribution_id string")


def fact(spark, rows):
    return spark.createDataFrame([("r", None, y, q, 1, None, p, a, d, d) for y, q, p, a, d in rows], FACT)


def test_one_bad_row_rejects_its_file(spark):
    rows = fact(spark, [(2020, None, "PRE", 1.0, "a"), (1900, 5, "PRE", 1.0, "a"), (2020, 1, "OBR", -2e12, "b"), (2020, 1, "PAG", 1.0, "c")])
    assert {r.rule: r.n for r in qa.violations(rows).collect()} == {"anio_range": 1, "trimestre_known": 1, "importe_floor": 1}
    assert [r.distribution_id for r in qa.accept_whole_files(rows).collect()] == ["c"]


def test_duplicate_blocks(spark):
    rows = fact(spark, [(2020, 1, "PRE", 1.0, "a"), (2020, 2, "PRE", 1.0, "a"), (2020, 4, "PRE", 1.0, "b"), (2020, None, "PRE", 1.0, "b"),
                        (2020, 1, "PRE", 1.0, "c"), (2021, 1, "PRE", 1.0, "b"), (2020, 1, "PRE", 1.5, "d"), (2020, 1, "PRE", 0.5, "d")])
    once = qa.drop_duplicate_blocks(rows)
    kept = sorted((r.anio, r.dataset_uri, r.importe_eur) for r in once.collect())
    assert kept == [(2020, "a", 1.0), (2020, "a", 1.0), (2020, "c", 1.0), (2020, "d", 0.5), (2020, "d", 1.5), (2021, "b", 1.0)]
    assert qa.drop_duplicate_blocks(once).count() == once.count()


def test_plausibility_edges(spark):
    rows = fact(spark, [(2020, 1, "PRE", a, "a") for a in (1e11, -1e11, 1e11 + 1)])
    assert qa.plausible_facts(rows).count() == 2
    wide = spark.createDataFrame([(1e11, None), (1e11 + 1, None), (None, None)], "PRE double, OBR double").withColumns(
        {"CRE": F.lit(None).cast("double"), "PAG": F.lit(None).cast("double")})
    assert qa.plausible_features(wide).count() == 2
    assert qa.strictly_below(wide).count() == 0


def test_regions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    sk.replace_regions(spark.createDataFrame([("a", 1), ("b", 1)], "ccaa_slug string, v int"), path)
    sk.replace_regions(spark.createDataFrame([("b", 2), ("b", 3)], "ccaa_slug string, v int"), path)
    assert sorted((r.ccaa_slug, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2), ("b", 3)]


def test_load_only_when_empty(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "v int")
    assert sk.load_if_empty(spark, df, str(tmp_path / "o")) and not sk.load_if_empty(spark, df, str(tmp_path / "o"))
    assert not sk.write_table(df.where("v > 1"), str(tmp_path / "e"))


def test_insert_or_ignore_keeps_null_keys(spark):
    old = spark.createDataFrame([(1, 0, "old")], "k int, o int, v string")
    new = spark.createDataFrame([(1, 1, "x"), (2, 2, "first"), (2, 3, "later"), (None, 4, "n"), (None, 5, "n")], "k int, o int, v string")
    assert sorted(r.v for r in sk.insert_or_ignore(old, new, ["k"], ["o"]).collect()) == ["first", "n", "n", "old"]


def test_destination_gaps(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    row = sk.destination_gaps(spark, {"t": (df, ["a", "c"])}).first()
    assert (row.faltan, row.sobran, row.ok) == ("c", "b", False)
