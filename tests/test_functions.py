import math

import pytest

from fiscalis.functions import amounts as am
from fiscalis.functions import tails
from fiscalis.functions import text as tx


def test_amounts(column):
    texts = ["1.234.567,89", "1,234,567.89", "€ 123,45", None, "", "N/A", "-", "s/d", "nd", "1.234", "1.234 miles",
             "12,5 EUR", "-1.000,50", "1,234,567", "12d", "nan", "1e3", " 7 "]
    assert column(am.parse_amount, texts) == [
        1234567.89, 1234567.89, 123.45, None, None, None, None, None, None, 1.234, None, 12.5, -1000.5, None, None, None,
        1000.0, 7.0]


def test_years(column):
    assert column(tx.parse_year, ["2023-01", "23", "2023.0", "1979", "2101", "1980", None, "x"]) == [
        2023, None, 2023, None, None, 1980, None, None]


def test_chapters(column):
    assert column(tx.parse_chapter, ["10000", "1 GASTOS", "0", "-3", "G_1", "4.0", None, "012", "08 A", "9"]) == [
        1, 1, None, None, None, 4, None, None, 8, 9]
    assert column(tx.chapter_in_label, ["Cap. 1 Gastos", "Capítulo 12", "3", None]) == [1, None, 3, None]
    assert column(tx.chapter_digit, ["G3", "0", None, "x"]) == [3, None, None, None]
    assert column(tx.as_smallint, ["3", "3.0", "x", None]) == [3, 3, None, None]


def test_phases(column):
    labels = ["Obligaciones reconocidas netas", "OBR", "fase a", "Pagos líquidos", "PRESUPUESTO_EJECUTADO",
              "ingresos_gastos_liquidos", "ingresos_gastos_liquidos_corriente", "Crédito definitivo", None]
    assert column(tx.phase_from_text, labels) == ["OBR", None, "ARN", "PAG", "OBR", "PAG", None, None, None]
    assert column(tx.phase_from_title, ["Crédito", "PAGOS de credito definitivo", "La obligacion"]) == ["PRE", "CRE", "OBR"]
    assert column(tx.phase_from_indicator, ["Créditos iniciales", "otro", " Crédito definitivo "]) == ["PRE", None, "CRE"]


def test_slugs_and_folding(column):
    assert column(tx.slugify, ["País Vasco", "  C.-La Mancha ", "año–2"]) == ["pais-vasco", "c-la-mancha", "ano2"]
    assert column(tx.fold_accents, ["Ñandú", "café"]) == ["Nandu", "cafe"]
    assert tx.clean_header(" Capí­tulo   Económico\n") == "capitulo economico"


def test_alerts(column):
    values = [0.05, 0.15, None, 0.0, -0.2]
    assert column(am.alert_by_limit, values, "double") == ["amarillo", "rojo", "gris", "verde", "rojo"]
    assert column(am.alert_by_band, values, "double") == ["verde", "amarillo", None, "verde", "rojo"]


def test_labels(column):
    assert column(am.euro_label, [None, 2.5, 1500.0, 2.4e6, 1.25e9], "double") == ["—", "2 €", "2 k€", "2 M€", "1.2 B€"]
    assert column(am.percent_label, [None, 0.1234, 12.0], "double") == ["—", "12.3%", "1200.0%"]
    assert column(am.p_label, [None, 1.234e-5, 0.05], "double") == ["—", "1.23e-05", "0.0500"]
    assert column(am.million_label, [999.0, 1500.0], "double") == ["999M€", "2MM€"]
    assert column(lambda c: am.clip(c, 0, 2), [None, -1.0, 3.0], "double") == [None, 0.0, 2.0]


def test_season(column):
    from pyspark.sql import functions as F
    assert [round(v, 9) + 0.0 for v in column(lambda c: am.season(c, F.sin), [None, 1, 2], "int")] == [0, 1, 0]
    assert [round(v, 9) + 0.0 for v in column(lambda c: am.season(c, F.cos), [None, 1, 2], "int")] == [1, 0, -1]


@pytest.mark.parametrize("found, known", [
    (lambda: tails.normal_tail(1.959963984540054), 0.025),
    (lambda: tails.chi2_tail(3.841458820694124, 1), 0.05),
    (lambda: tails.chi2_tail(18.307038053275146, 10), 0.05),
    (lambda: tails.t_two_sided(2.2281388519649385, 10), 0.05),
    (lambda: tails.f_tail(4.10282101543998, 2, 10), 0.05),
    (lambda: tails.chi2_tail(2.0, 2), math.exp(-1)),
    (lambda: tails.f_tail(1.0, 5, 5), 0.5),
])
def test_tails(found, known):
    assert found() == pytest.approx(known, rel=1e-9)
