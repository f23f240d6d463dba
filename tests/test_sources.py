import json

from pyspark.sql import functions as F

from fiscalis.operators.normalize import normalize
from fiscalis.sources import cube, delimited, files, lake, nested


def test_folder_of_dialects(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Año;Capítulo;Crédito Inicial\n2020;1;1.234,50\n2021;2;nd\n2022;3;7,5;x\n2023;4\n".encode())
    (tmp_path / "b.csv").write_bytes("Ejercicio,Capitulo,Inicial\n2020,1,1234.50\n2021,2,10.25\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes("Año;Capítulo;Crédito Inicial\n2019;5;1.000,25\n".encode("latin-1"))
    parts = delimited.read_folder(spark, [str(tmp_path / f"{n}.csv") for n in "abc"])
    assert len(parts) == 3
    facts = None
    for part in parts:
        one = normalize(part.withColumns({"ccaa_slug": F.lit("r"), "dataset_uri": F.col("_file")}).drop("_file"))
        facts = one if facts is None else facts.unionByName(one)
    got = sorted((r.anio, r.capitulo_id, r.fase, r.importe_eur) for r in facts.collect())
    assert got == [(2019, 5, "PRE", 1000.25), (2020, 1, "PRE", 1234.5), (2020, 1, "PRE", 1234.5), (2021, 2, "PRE", 10.25)]


def test_records_of_other_lengths(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a;b\n1;2\n3;4;5\n6;7;;9\n8;9;\n10\n11;"x;y"\n12;"p;q";z\n13;14;15;16;17\n')
    rows = delimited.read_delimited(spark, str(tmp_path / "a.csv"), ["a", "b"], ";")
    assert sorted((r.a, r.b) for r in rows.collect()) == [("1", "2"), ("10", None), ("11", "x;y")]


def test_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Ejercicio;Texto;Inicial\n2020;"uno\ndos ""tres""";1,50\n2021;cuatro;2,25\n')
    (tmp_path / "b.csv").write_text('Ejercicio;Texto;Inicial\n2022;cinco;3,75\n')
    parts = delimited.read_folder(spark, [str(tmp_path / f"{n}.csv") for n in "ab"])
    got = sorted((r.Ejercicio, r.Texto, r.Inicial) for p in parts for r in p.collect())
    assert got == [("2020", 'uno\ndos "tres"', "1.50"), ("2021", "cuatro", "2.25"), ("2022", "cinco", "3.75")]


def test_cube_header_beyond_a_prefix(spark, tmp_path):
    head = '\n' * 200 + 'AXIS-VERSION="2000";\n' + 'NOTE="' + "x" * 3000 + '";\n'
    for page, raw in (("utf-8", "é€".encode()), ("windows-1252", "é€".encode("cp1252")), ("iso-8859-15", "é€".encode("iso-8859-15"))):
        (tmp_path / f"{page}.px").write_bytes(head.encode() + f'CODEPAGE="{page}";\nTITLE="'.encode() + raw + b'";\nDATA=\n1;\n')
    got = cube.read_cubes(spark, str(tmp_path / "*.px")).collect()
    assert len(got) == 3 and all('TITLE="é€"' in r.text for r in got)


def test_number_votes(spark):
    tokens = spark.createDataFrame([("f", t) for t in ("1.234,56", "89932302.14", "1,234", "12,5")], "file string, token string")
    r = delimited.number_formats(tokens).first()
    assert (r.eu, r.anglo, r.decimal, r.thousands) == (2, 1, ",", ".")
    flat = delimited.with_fallback_format(spark.createDataFrame(
        [("a", "UTF-8", None, None), ("b", "ISO-8859-1", None, None)], "file string, encoding string, decimal string, thousands string"))
    assert {x.file: (x.decimal, x.thousands) for x in flat.collect()} == {"a": (".", None), "b": (",", ".")}


def test_json_layouts(spark, tmp_path):
    layouts = {"list": [{"a": 1, "b": {"c": 2}}, {"a": 3, "b": {"c": 4}}], "items": {"result": {"items": [{"a": 1, "b": {"c": 2}}]}},
               "own": {"meta": "x", "zeilen": [{"a": 1, "b": {"c": 2}}]}, "object": {"a": 1, "b": {"c": 2}}}
    for name, payload in layouts.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(payload))
        rows = nested.read_records(spark, str(path))
        assert sorted(rows.columns) == ["a", "b.c"], name
        assert rows.count() == (2 if name == "list" else 1)


def test_json_in_latin_1(spark, tmp_path):
    (tmp_path / "a.json").write_bytes('[{"a": "año", "b": 1}]'.encode("latin-1"))
    (tmp_path / "b.json").write_bytes('[{"a": "señal", "b": 2}]'.encode())
    got = nested.read_records(spark, str(tmp_path / "*.json")).collect()
    assert sorted((r.a, r.b) for r in got) == [("año", 1), ("señal", 2)]


def test_api_items(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"result": {"items": [{"identifier": "a"}, {"identifier": "b"}]}}))
    assert [r.pos for r in files.api_items(spark, str(tmp_path)).orderBy("pos").collect()] == [0, 1]


PX = '''CHARSET="ANSI";
AXIS-VERSION="2000";
CODEPAGE="iso-8859-15";
TITLE="Liquidación. Obligaciones reconocidas";
STUB="Capítulo","Isla";
HEADING="Período";
VALUES("Capítulo")="Cap. 1 Personal","Cap. 2 Bienes";
VALUES("Isla")="X","Y";
VALUES("Período")="2019","2020";
DATA=
1 2 3 4
5 ".." 7 8;
'''


def test_cube(spark, tmp_path):
    (tmp_path / "c.px").write_bytes(PX.encode("latin-1"))
    (tmp_path / "x.px").write_bytes(b"PK\x03\x04")
    cells = cube.long_cells(cube.read_cubes(spark, str(tmp_path / "*.px")))
    by = {(r.coords["capítulo"], r.coords["isla"], r.coords["período"]): r.data for r in cells.collect()}
    assert by["Cap. 1 Personal", "Y", "2019"] == "3" and by["Cap. 2 Bienes", "Y", "2020"] == "8"
    rows = sorted((r.anio, r.capitulo_id, r.fase, r.importe_eur) for r in cube.shape_cells(cells).collect())
    assert rows == [(2019, 1, "OBR", 1.0), (2019, 1, "OBR", 3.0), (2019, 2, "OBR", 5.0), (2019, 2, "OBR", 7.0),
                    (2020, 1, "OBR", 2.0), (2020, 1, "OBR", 4.0), (2020, 2, "OBR", 8.0)]


def test_xml_rows(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<raiz><fila id="1"><a>x</a></fila><fila id="2"><a>y</a></fila><otro/></raiz>')
    texts = spark.createDataFrame([(1, (tmp_path / "f.xml").read_text())], "id int, text string")
    tag = nested.row_tags(nested.tag_counts(texts)).first().tag
    assert tag == "fila"
    assert sorted((str(r["@id"]), r.a) for r in nested.read_xml(spark, str(tmp_path / "f.xml"), tag).collect()) == [("1", "x"), ("2", "y")]


def test_header_row_of_a_sheet(spark):
    def cells(*values):
        return [(None if v is None else str(v), isinstance(v, str)) for v in values]
    rows = [("f", "s", 0, cells("Informe", None, None, None)), ("f", "s", 1, cells("Año", "Cap", "Importe", None)),
            ("f", "s", 2, cells(2020, 1, 5.0, None)), ("g", "s", 0, cells(1, 2, 3, 4))]
    df = spark.createDataFrame(rows, "file string, sheet string, fila int, celdas array<struct<valor: string, es_texto: boolean>>")
    assert {r.file: r.header for r in files.header_rows(df).collect()} == {"f": 1, "g": 0}
    assert [r.valores[:3] for r in files.sheet_rows(df).collect()] == [["2020", "1", "5.0"]]


def test_last_month_only(spark):
    rows = [("2020", "01 - gen", "1", "E", "5"), ("2020", "02 - feb", "1", "E", "7"), ("2020", "02 - feb", "1", "E", "1"),
            ("2020", "02 - feb", "10", "E", "9"), ("2020", "03 - mar", "1", "Otra", "9")]
    df = spark.createDataFrame(rows, "exercici string, mes string, cap_tol_codi string, entitat string, ini string")
    assert [tuple(r) for r in lake.cumulative_by_year(df, {"ini": "x"}, "E").collect()] == [(2020, 1, 8.0)]


def test_numeric_coercion_is_lossless(spark):
    df = spark.createDataFrame([("1", "a", None), ("2.5", "3", None)], "x string, y string, z string")
    assert dict(lake.coerce_numeric(df).dtypes) == {"x": "double", "y": "string", "z": "double"}


def test_manifest_streams_files_of_any_size(spark, tmp_path, monkeypatch):
    import hashlib

    from fiscalis.sources import files as fi
    monkeypatch.setattr(fi, "PIECE_BYTES", 64)
    bodies = {"a.csv": b"x;y\n1;2\n" * 900, "b.bin": bytes(range(256)) * 40, "no_end.txt": b"one\ntwo", "crlf.txt": b"a\r\nb\r\n\r\n", "empty.txt": b"", "end.txt": b"\n",
              "sub/long.txt": b"z" * 50_000 + b"\n\n\n"}
    (tmp_path / "sub").mkdir()
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = {r.path.split(f"{tmp_path.name}/")[1]: (r.bytes, r.md5) for r in fi.manifest(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {name: (len(body), hashlib.md5(body).hexdigest()) for name, body in bodies.items() if body}
    plan = fi.manifest(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan


def test_summary_comes_from_footers(spark, tmp_path):
    from fiscalis.sources import lake as lk
    path = f"{tmp_path}/facts"
    rows = spark.createDataFrame([("a", 2020, 1.0), ("a", 2022, 2.0), ("a", 2022, 3.0), ("b", 2021, None)], "ccaa_slug string, anio int, importe double")
    rows.write.partitionBy("ccaa_slug", "anio").parquet(path)
    found = lk.summary_from_footers(spark, path, rows.schema)
    assert sorted(map(tuple, found.collect())) == [("a", 3, 2020, 2022), ("b", 1, 2021, 2021)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan and "importe" not in plan.split("PushedAggregation")[0]
    assert spark.conf.get("spark.sql.sources.useV1SourceList").count("parquet") == 1


def test_one_encoding_for_the_parts_of_a_file(spark, tmp_path):
    for name, body in {"k=1/a.txt": "ascii", "k=1/b.txt": "señal", "k=2/a.txt": "plain"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body + "\n")
    found = {r.file[-3:]: r.encoding for r in delimited.encodings(files.folder_lines(spark, str(tmp_path))).collect()}
    assert found == {"k=1": "UTF-8", "k=2": "ISO-8859-1"}


def test_rows_are_not_dealt_by_language_or_file(spark, tmp_path):
    from fiscalis.plans import all_queries
    rows = [(i, f"texto {i}", "es", "s", 7) for i in range(50)] + [(90, "señal", "es", "s", 5), (91, "x", None, "s", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    df = all_queries()["src02_encoding"].build(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [("ISO-8859-1", 1, True), ("UTF-8", 51, True)]
    assert "hashpartitioning(file" not in df._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "a.csv").write_text("a;b\n1,5;x\n2,5;y\n")
    part, = delimited.read_folder(spark, str(tmp_path / "a.csv"))
    assert sorted((r.a, r.b) for r in part.collect()) == [("1.5", "x"), ("2.5", "y")]
    assert "hashpartitioning(_file" not in part._jdf.queryExecution().executedPlan().toString()


def test_few_lines_reach_the_sort_for_the_first(spark, tmp_path):
    for name, body in {"a.txt": b"\n  \n\xf1and\xfa\nx\n", "b.txt": b"uno\n" * 30_000}.items():
        (tmp_path / name).write_bytes(body)
    lines = files.file_lines(spark, str(tmp_path))
    assert sorted((r.file[-5:], bytes(r.l)) for r in files.first_lines(lines).select("file", F.col("first").cast("binary").alias("l")).collect()) == [
        ("a.txt", b"\xf1and\xfa"), ("b.txt", b"uno")]
    assert files.leading_lines(lines).count() == 2
