from pyspark.sql import functions as F

from fiscalis.operators import normalize as nz


def raw(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumns({"ccaa_slug": F.lit("test"), "dataset_uri": F.lit("ds")})


def result(df):
    return sorted((r.anio, r.capitulo_id, r.fase, r.importe_eur) for r in df.collect())


def test_wide_frame(spark):
    df = raw(spark, [(2023, 1, 1000.0, 900.0), (2023, 2, 500.0, 480.0)],
             "anio int, capitulo int, importe_pre double, importe_obr double")
    assert result(nz.normalize(df)) == [(2023, 1, "OBR", 900.0), (2023, 1, "PRE", 1000.0), (2023, 2, "OBR", 480.0),
                                        (2023, 2, "PRE", 500.0)]


def test_longest_alias_wins():
    assert nz.canonical_name("Pago de ejercicio corriente") == "importe_pag"
    assert nz.canonical_name("Ejercicio") == "anio"
    assert nz.canonical_name("Capítol codi") == "capitulo_id"
    assert nz.canonical_name("distribution_id") == "distribution_id"


def test_programme_file_gives_no_rows(spark):
    df = raw(spark, [("2020", "1", "PRESUPUESTO_INICIAL", "G_1", "P")],
             "TIME_PERIOD string, OBS_VALUE string, PRESUPUESTO_ESTADO string, PRESUPUESTO_PARTIDA string, PRESUPUESTO_PROGRAMA string")
    assert nz.normalize(df).count() == 0


def test_unmapped_labels_become_budget_per_file(spark):
    rows = [("a", "2020", "Presupuesto inicial", "1,5"), ("a", "2020", "OBR", "2"), ("b", "2020", "OBR", "3")]
    df = raw(spark, rows, "distribution_id string, any string, concepto string, valor string")
    assert result(nz.normalize(df)) == [(2020, None, "PRE", 1.5), (2020, None, "PRE", 3.0)]
    alone = raw(spark, rows[2:], "distribution_id string, any string, concepto string, valor string")
    assert result(nz.normalize(alone, file_key=None)) == [(2020, None, "PRE", 3.0)]


def test_unknown_amount_column_is_a_bogus_phase(spark):
    from fiscalis.operators.quality import accept_whole_files
    df = raw(spark, [("f", "2020", "1", "2")], "distribution_id string, anio string, importe_pre string, importe_total string")
    facts = nz.normalize(df)
    assert {r.fase for r in facts.collect()} == {"PRE", "TOTAL"}
    assert accept_whole_files(facts).count() == 0


def test_year_from_sheet(spark):
    df = raw(spark, [("Presup 2019-20", "5")], "`__sheet__` string, importe string")
    assert result(nz.normalize(df)) == [(2019, None, "PRE", 5.0)]


def test_columns_are_parsed_once_a_row(spark):
    df = raw(spark, [("Hoja 2019", "G_1", "1.234,50 €"), ("2020", "G_2", " 5,5 Eur "), ("x", "G_3", "1"), ("2021", "G_4", "E UR 1")],
             "`__sheet__` string, capitulo string, importe string")
    facts = nz.normalize(df)
    assert sorted((r.anio, r.importe_eur) for r in facts.collect()) == [(2019, 1234.5), (2020, 5.5)]
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[eE][uU][rR]") <= 1 and plan.count("regexp_extract(__sheet__") + plan.count("(?:19|20)") <= 2, plan
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert not any("regexp" in line or "RLIKE" in line for line in filters), filters


def test_rows_are_not_dealt_by_file(spark):
    df = raw(spark, [("a", "2020", "Obligaciones reconocidas", "1"), ("a", "2020", "nada", "2"), ("b", "2020", "nada", "3"), (None, "2020", "nada", "4")],
             "distribution_id string, any string, concepto string, valor string")
    facts = nz.normalize(df)
    assert result(facts) == [(2020, None, "OBR", 1.0), (2020, None, "PRE", 3.0), (2020, None, "PRE", 4.0)]
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan, plan
