import random
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks import spark_queries
from ledgerlink.functions.names import sanitize_name, unique_names
from ledgerlink.functions.scalars import number_or_null
from ledgerlink.sources.catalog import (
    column_catalog,
    copy_monetary,
    map_columns,
    mapped_pairs,
    monetary_columns,
    set_monetary,
)
from ledgerlink.sources.delimited import TextSpec, read_delimited
from ledgerlink.sources.load import load_base
from ledgerlink.sources.rowid import duplicate_row_ids, parquet_with_row_id, with_row_id
from ledgerlink.plans import workbooks
from ledgerlink.plans.workbooks import write_workbooks
from ledgerlink.sources import workbook
from ledgerlink.sources.workbook import MOST_PARTS, SheetSpec, _spans, cell_text, read_workbooks

HEADER = ["Empresa", "Nota Fiscal", "Valor Contábil"]
ROWS = [("TBRA", "1001", "1000,50"), ("TBRA", "1002", "250.00"), ("ACME", "1003", "999,99")]
NAMES = ["empresa", "nota_fiscal", "valor_cont_bil"]


@pytest.mark.parametrize(
    "cell, name",
    [
        ("  Número da Nota  ", "n_mero_da_nota"),
        ("CNPJ/CPF", "cnpj_cpf"),
        ("Valor (R$)", "valor__r__"),
        ("A B  C", "a_b__c"),
        ("", "col_4"),
        ("   ", "col_4"),
        (None, "col_4"),
        (0, "col_4"),
        (float("nan"), "col_4"),
        ("0", "0"),
        (123, "123"),
        (True, "true"),
    ],
)
def test_sanitize_name(cell, name):
    assert sanitize_name(cell, 4) == name


def test_unique_names_bump_until_free():
    assert unique_names(["a", "A", "a_2", "", "a"], 1) == ["a", "a_2", "a_2_2", "col_4", "a_3"]


def write_csv(path, skip=0, pad=0, sep=","):
    quote = (lambda v: f'"{v}"') if sep == "," else (lambda v: v)
    lines = ["Relatório;x"] * skip
    lines += [sep.join([""] * pad + [quote(v) for v in r]) for r in [HEADER, *ROWS]]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def check_sample(df):
    assert [c for c in df.columns if c != "row_id"] == NAMES
    ordered = df.orderBy("row_id") if "row_id" in df.columns else df
    got = ordered.collect()
    assert [tuple(r[c] for c in NAMES) for r in got] == ROWS
    if "row_id" in df.columns:
        assert [r["row_id"] for r in got] == [0, 1, 2]
    assert column_catalog(df.select(*NAMES)).collect()[2]["source_name"] == HEADER[2]


@pytest.mark.parametrize("skip, pad, sep", [(0, 0, ","), (3, 0, ","), (2, 1, ";"), (0, 0, "\t")])
def test_text_file_with_offset_header(spark, tmp_path, skip, pad, sep):
    path = write_csv(tmp_path / "sample.csv", skip, pad, sep)
    df = load_base(spark, path, header_row=skip + 1, start_col=pad + 1)
    check_sample(df)
    total = df.select(F.round(F.sum(number_or_null("valor_cont_bil")), 2)).first()[0]
    assert total == 2250.49


def test_text_file_without_row_id(spark, tmp_path):
    check_sample(read_delimited(spark, write_csv(tmp_path / "s.txt"), row_id=None))


def test_offset_row_ids_keep_the_order(spark, tmp_path):
    path = write_csv(tmp_path / "s.csv", 2)
    df = read_delimited(spark, path, TextSpec(3)).orderBy("row_id")
    assert [r["nota_fiscal"] for r in df.collect()] == ["1001", "1002", "1003"]


@pytest.mark.parametrize("row_id", ["row_id", None])
def test_short_rows_are_filled_and_long_rows_refused(spark, tmp_path, row_id):
    path = tmp_path / "short.csv"
    path.write_text("a,b,c\n1,2\n3,4,5\n")
    got = read_delimited(spark, str(path), row_id=row_id).select("a", "b", "c").collect()
    assert sorted(tuple(r) for r in got) == [("1", "2", None), ("3", "4", "5")]
    path = tmp_path / "long.csv"
    path.write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="more fields"):
        read_delimited(spark, str(path), TextSpec(delimiter=","), row_id=row_id).collect()


def test_broken_quotes_and_missing_headers_are_refused(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('a,b\n1,"x\ny\n')
    with pytest.raises(Exception, match="inside quotes"):
        read_delimited(spark, str(path)).collect()
    with pytest.raises(ValueError):
        read_delimited(spark, str(path), TextSpec(header_row=9))
    with pytest.raises(ValueError):
        read_delimited(spark, str(path), TextSpec(start_col=5))


def test_folders_of_text_are_checked_on_every_path(spark, tmp_path):
    def folder(name, *texts, encoding="utf-8"):
        (tmp_path / name).mkdir()
        for n, text in enumerate(texts):
            (tmp_path / name / f"f{n}.csv").write_text(text, encoding=encoding)
        return str(tmp_path / name)

    two = folder("two", "x\na;b\n1;2\n", "y\na;b\n3;4\n5;6\n")
    got = read_delimited(spark, two, TextSpec(2)).orderBy("row_id").collect()
    assert [(r["a"], r["b"]) for r in got] == [("1", "2"), ("3", "4"), ("5", "6")]
    assert [r["row_id"] for r in read_delimited(spark, two, TextSpec(2)).orderBy("row_id").collect()] == [0, 1, 2]
    for row_id in ("row_id", None):
        with pytest.raises(Exception, match="inside quotes"):
            read_delimited(spark, folder(f"q{row_id}", 'a,b\n1,"x\ny\n'), row_id=row_id).collect()
        with pytest.raises(Exception, match="(?i)header"):
            read_delimited(spark, folder(f"h{row_id}", "a,b\n1,2\n", "b,a\n4,3\n"), row_id=row_id).collect()
    latin = folder("latin", "ação;b\né;1\n", encoding="latin-1")
    got = read_delimited(spark, latin, TextSpec(encoding="ISO-8859-1"), row_id=None)
    assert [f.metadata["source_name"] for f in got.schema.fields] == ["ação", "b"]
    assert [tuple(r) for r in got.collect()] == [("é", "1")]


def awkward_text(rng, rows):
    """A text file with quoted breaks, doubled quotes, blank lines and quotes inside plain fields."""
    cells = ["1", "", 'x"y', '5" pipe', "two\nlines", "a,b", 'say ""hi""', "\n\n", '"', ",", 'end"\n,"', "plain"]
    out, want = [], []
    for _ in range(rows):
        row = [rng.choice(cells) for _ in range(3)]
        if not any(row):
            continue
        text = []
        for cell in row:
            quoted = any(c in cell for c in ",\n") or cell.startswith('"') or rng.random() < 0.2
            text.append('"' + cell.replace('"', '""') + '"' if quoted else cell)
        want.append(tuple(c or None for c in row))
        out.append(",".join(text))
        out += [""] * (rng.random() < 0.1)
    return "a,b,c\n" + "\n".join(out) + "\n", want


@pytest.mark.parametrize("split, blank", [("40b", True), ("150b", True), ("1m", True), ("60b", False)])
def test_quoted_breaks_are_read_in_splits(spark, tmp_path, request, split, blank):
    """Files cut into splits of a few lines: the same rows, in the same order, as from whole files."""
    rng = random.Random(split)
    (tmp_path / "t").mkdir()
    want = []
    for n in range(3):
        text, rows = awkward_text(rng, 60)
        if not blank:
            text, rows = "a,b,c\n" + "".join(f'{i},"{i}\n{i}",z\n' if i == 30 else f"{i},p,\n" for i in range(60)), [
                (str(i), f"{i}\n{i}" if i == 30 else "p", "z" if i == 30 else None) for i in range(60)
            ]
        (tmp_path / "t" / f"f{n}.csv").write_text(text, newline="")
        want += rows
    for name, value in {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "1"}.items():
        spark.conf.set(name, value)
        request.addfinalizer(lambda name=name: spark.conf.unset(name))
    df = read_delimited(spark, str(tmp_path / "t"), TextSpec(delimiter=","))
    got = df.orderBy("row_id").collect()
    assert [(r["a"], r["b"], r["c"]) for r in got] == want
    assert [r["row_id"] for r in got] == list(range(len(want)))
    whole = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "t")).collect()
    assert sorted(map(str, map(tuple, whole))) == sorted(map(str, want))


def test_rows_of_plain_text_are_not_moved(spark, tmp_path, request):
    (tmp_path / "t").mkdir()
    for n in range(4):
        (tmp_path / "t" / f"f{n}.csv").write_text("a,b\n" + f"{n},x\n" * 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    for df in (read_delimited(spark, str(tmp_path / "t")), parquet_with_row_id(spark, "/root/testdata/sf0.001/orders.parquet")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and "Python" not in plan
    rows = read_delimited(spark, str(tmp_path / "t")).orderBy("row_id").collect()
    assert [(r["row_id"], r["a"]) for r in rows] == [(i, str(i // 50)) for i in range(200)]


def test_load_base_passes_the_delimiter(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("a;b,c\n1;2,3\n4;5,6\n")
    assert load_base(spark, str(path), delimiter=";").columns == ["row_id", "a", "b_c"]


def test_unknown_format_is_refused(spark):
    with pytest.raises(ValueError, match="unsupported"):
        load_base(spark, "/tmp/x.pdf")


def write_xlsx(path, rows, first_row=1, first_col=1, sheets=("Plan1",)):
    """Smallest workbook that holds ``rows``; texts are shared or inline in turn."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared, body = [], []
    for i, row in enumerate(rows):
        if row is None:
            continue
        cells = []
        for j, v in enumerate(row):
            ref = f"{chr(64 + first_col + j)}{first_row + i}"
            if v is None:
                continue
            if isinstance(v, bool):
                cells.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, (int, float)):
                cells.append(f'<c r="{ref}"><v>{v!r}</v></c>')
            elif len(shared) % 2:
                shared.append("")
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>')
            else:
                shared.append(v)
                cells.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
        body.append(f'<row r="{first_row + i}">{"".join(cells)}</row>')
    names = "".join(
        f'<sheet name="{s}" sheetId="{n + 1}" r:id="rId{n + 1}"/>' for n, s in enumerate(sheets)
    )
    links = "".join(
        f'<Relationship Id="rId{n + 1}" Target="worksheets/sheet{n + 1}.xml"/>'
        for n in range(len(sheets))
    )
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            f"{links}</Relationships>",
        )
        texts = "".join(f"<si><t>{t}</t></si>" for t in shared)
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>{texts}</sst>")
        for n in range(len(sheets)):
            data = "".join(body) if n == len(sheets) - 1 else ""
            z.writestr(
                f"xl/worksheets/sheet{n + 1}.xml",
                f"<worksheet {main}><sheetData>{data}</sheetData></worksheet>",
            )
    return str(path)


def test_workbook_equals_its_text_twin(spark, tmp_path):
    path = write_xlsx(tmp_path / "sample.xlsx", [HEADER, *ROWS], first_row=3)
    check_sample(load_base(spark, path, header_row=3))
    path = write_xlsx(tmp_path / "b.xlsx", [HEADER, *ROWS], 3, 2, ("Capa", "Dados"))
    check_sample(load_base(spark, path, header_row=3, start_col=2, sheet="Dados"))


def test_workbook_cells_and_end_of_table(spark, tmp_path):
    rows = [["a", "b", None], [1, True], [2.5, "x"], [None, "only b"], None, ["after", "gap"]]
    df = read_workbooks(spark, write_xlsx(tmp_path / "c.xlsx", rows)).orderBy("row_id")
    assert [tuple(r) for r in df.collect()] == [
        (0, "1", "TRUE"), (1, "2.5", "x"), (2, None, "only b"),
    ]
    assert [cell_text(v) for v in (None, 3.0, 0.1, False, "t")] == [None, "3", "0.1", "FALSE", "t"]


def test_wide_workbooks_keep_all_columns(spark, tmp_path):
    # Cells beyond column Z get no readable reference here, so each follows the one before it.
    rows = [[f"c{k}" for k in range(700)], [f"v{k}" for k in range(700)]]
    df = load_base(spark, write_xlsx(tmp_path / "wide.xlsx", rows))
    assert df.columns == ["row_id", *rows[0]]
    assert list(df.first())[1:] == rows[1]


def test_folder_of_workbooks(spark, tmp_path):
    for n in range(3):
        write_xlsx(tmp_path / f"f{n}.xlsx", [["a"], [f"{n}x"], [f"{n}y"]])
    df = read_workbooks(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 3
    got = [r["a"] for r in df.orderBy("row_id").collect()]
    assert got == ["0x", "0y", "1x", "1y", "2x", "2y"]
    with pytest.raises(ValueError):
        read_workbooks(spark, str(tmp_path), SheetSpec(sheet="none"))


def test_one_sheet_over_many_tasks(spark, tmp_path):
    rows = [["a", "b"], *[[f"k{n}", n / 4] for n in range(900)], None, ["after", "gap"]]
    path = write_xlsx(tmp_path / "huge.xlsx", rows, first_row=2)
    whole = read_workbooks(spark, path, SheetSpec(2)).orderBy("row_id").collect()
    assert len(whole) == 900
    for split in (8000, 30000):
        cut = read_workbooks(spark, path, SheetSpec(2), split_bytes=split)
        assert cut.orderBy("row_id").collect() == whole
    paths = _spans(path, SheetSpec(2), 5000)
    assert len(paths) > 5


def test_parts_of_a_sheet_do_not_grow_with_it(spark, tmp_path):
    """Each part unpacks the sheet up to its own, so more and more parts would take the square of the sheet."""
    rows = [["a"], *[[f"k{n}"] for n in range(3000)]]
    path = write_xlsx(tmp_path / "long.xlsx", rows)
    spans = _spans(path, SheetSpec(), 1000)
    assert 8 < len(spans) <= MOST_PARTS
    cut = read_workbooks(spark, path, SheetSpec(), split_bytes=1000).orderBy("row_id").collect()
    assert [r["a"] for r in cut] == [f"k{n}" for n in range(3000)]


def test_more_rows_make_more_workbooks(spark, tmp_path, monkeypatch):
    """A workbook is written by one task, so the query gives each a bounded number of rows."""
    orders = spark.createDataFrame([(n, n % 7, "F", n / 4, "1-URGENT") for n in range(1000)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    written = []

    def write(df, folder, *args, **options):
        written.append(write_workbooks(df, folder, *args, **options))

    monkeypatch.setattr(spark_queries, "write_workbooks", write)
    monkeypatch.setattr(spark_queries, "SHEET_ROWS", 100)
    assert spark_queries.workbook_ledger(spark, str(tmp_path)).count() == 1000
    assert written[0].count() == 10


@pytest.mark.parametrize("gap", [1, 2, 40, 41, 79])
@pytest.mark.parametrize("numbered", [True, False])
def test_parts_of_a_sheet_end_at_its_first_empty_row(tmp_path, gap, numbered):
    """Runs of all parts, put together, against the sheet read whole; rows with a prefix of their own."""
    name = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    body = ""
    for n in range(1, 81):
        number = f' r="{n}"' if numbered else ""
        value = "" if n - 1 == gap else f'<x:c t="str"><x:v>v{n} &lt;row></x:v></x:c>'
        body += f'<x:row{number} y:h="1">{value}</x:row>\n'
    sheet = f'<x:worksheet xmlns:x="{name}" xmlns:y="urn:y"><x:sheetData>{body}</x:sheetData><x:rowBreaks/></x:worksheet>'
    path = write_xlsx(tmp_path / "p.xlsx", [["a"]])
    with zipfile.ZipFile(path) as z:
        others = {m: z.read(m) for m in z.namelist() if "sheet1" not in m}
    with zipfile.ZipFile(path, "w") as z:
        for member, data in others.items():
            z.writestr(member, data)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    whole = list(workbook._data_rows(path, SheetSpec(), 1))
    assert len(whole) == gap - 1 if gap > 0 else 79
    for split in (1, 37, 500, len(sheet)):
        parts = [(lo, lo + split) for lo in range(0, len(sheet), split)]
        nodes = [r for span in parts for r in workbook._rows(path, SheetSpec(), span)]
        assert nodes == list(workbook._rows(path, SheetSpec()))
        if split > 1:
            kept, open_ = [], True
            for span in parts:
                run = list(workbook._data_rows(path, SheetSpec(), 1, span))
                open_ = open_ and (not run or run[0][0] == len(kept))
                kept += run if open_ else []
            assert kept == whole


def test_written_workbooks_read_back(spark, tmp_path):
    rows = [(n, f"t{n} <&>\r\n\"'  ", n / 2, n % 2 == 0, Decimal(n) / 4 if n % 3 else None) for n in range(23)]
    df = spark.createDataFrame(rows, "n long, t string, f double, b boolean, d decimal(10, 2)").coalesce(1)
    made = write_workbooks(df, str(tmp_path / "w"), ["N", "T", "F", "", "D"], first_row=2, first_col=27, last_row=6)
    assert [r["rows"] for r in made.orderBy("path").collect()] == [4, 4, 4, 4, 4, 3]
    got = load_base(spark, str(tmp_path / "w"), header_row=2, start_col=27).orderBy("row_id")
    assert got.columns == ["row_id", "n", "t", "f", "col_29", "d"]
    wanted = [tuple(cell_text(float(v) if isinstance(v, Decimal) else v) for v in r) for r in rows]
    assert [tuple(r)[1:] for r in got.collect()] == wanted
    with pytest.raises(ValueError, match="exists"):
        write_workbooks(df, str(tmp_path / "w"))
    assert write_workbooks(df.limit(0), str(tmp_path / "none")).count() == 0
    assert [workbooks.column_letters(n) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_folder_of_workbooks_by_load_base(spark, tmp_path):
    for n in range(2):
        write_xlsx(tmp_path / f"f{n}.xlsx", [["a"], [f"{n}x"]])
    assert [r["a"] for r in load_base(spark, str(tmp_path)).orderBy("row_id").collect()] == ["0x", "1x"]
    (tmp_path / "b.csv").write_text("a\n1\n")
    with pytest.raises(ValueError, match="one kind"):
        load_base(spark, str(tmp_path))


def test_parquet_rows_are_numbered_across_files(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(0, 100, 1, 5).selectExpr("id", "id * 2 AS v").write.parquet(path)
    got = parquet_with_row_id(spark, path).orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == list(range(100))
    assert [r["id"] for r in got] == list(range(100))
    assert load_base(spark, path).dtypes == [("row_id", "bigint"), ("id", "string"), ("v", "string")]
    assert with_row_id(spark.read.parquet(path), "id").columns == ["row_id", "id", "v"]


def test_row_ids_must_be_distinct(spark):
    ids = [*range(-70, 300, 3), 2**40, -(2**63), 2**63 - 1, 2**62]
    fine = spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)
    assert with_row_id(fine, "id").count() == len(ids)
    assert duplicate_row_ids(fine, "id").count() == 0
    twice = [*ids, -70, 2**40, -(2**63), -(2**63)]
    double = spark.createDataFrame([(i,) for i in twice], "id long").repartition(5)
    got = {tuple(r) for r in duplicate_row_ids(double, "id").collect()}
    assert got == {(-70, 2), (2**40, 2), (-(2**63), 3)}
    with pytest.raises(ValueError, match="is no row id: -9223372036854775808 .3 rows., -70 .2 rows."):
        with_row_id(double, "id")
    assert with_row_id(double, "id", check=False).count() == len(twice)
    with pytest.raises(ValueError, match="None .1 rows."):
        with_row_id(spark.createDataFrame([(None,), (1,)], "id long"), "id")
    assert with_row_id(fine.limit(0), "id").count() == 0


def test_ids_are_shuffled_by_cell_first(spark, tmp_path):
    """Ids themselves move only after the cells without duplicates are left out."""
    path = str(tmp_path / "ids")
    spark.range(0, 64000, 1, 4).write.parquet(path)
    text = duplicate_row_ids(spark.read.parquet(path), "id")._jdf.queryExecution().sparkPlan().toString()
    assert text.index("HashAggregate") < text.index("BroadcastHashJoin") < text.index("FileScan")
    assert text.count("HashAggregate") == 2 and "LeftSemi" in text


def test_monetary_flags(spark, tmp_path):
    src = load_base(spark, write_csv(tmp_path / "s.csv"))
    src = set_monetary(src, ["valor_cont_bil"])
    assert monetary_columns(src) == ["valor_cont_bil"]
    dst = load_base(spark, write_csv(tmp_path / "d.csv"))
    flagged, touched = copy_monetary(src, dst)
    assert (monetary_columns(flagged), touched) == (["valor_cont_bil"], 1)
    assert copy_monetary(src, flagged)[1] == 0
    assert copy_monetary(src, flagged, "source_name", override=True)[1] == 1
    assert [r["is_monetary"] for r in column_catalog(flagged).collect()] == [False, False, False, True]
    with pytest.raises(ValueError):
        set_monetary(src, ["nope"])


def test_column_mapping():
    mapping = map_columns(["nota", "valor", "conta"], ["nota", "total"], [("valor", "total")])
    assert mapping == {"nota": "nota", "valor": "total", "conta": None}
    assert mapped_pairs(mapping) == [("nota", "nota"), ("valor", "total")]
