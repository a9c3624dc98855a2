"""Evidence lists, workbooks, ERP days, product plans and report text on small rows."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tradelens.functions import display
from tradelens.operators import evidence as ev
from tradelens.operators import materialize as mat
from tradelens.sources import erp, workbook


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_canonical_json_orders_all_keys(spark):
    a, b = '{"b": [{"z": 1, "a": null}], "a": "é"}', ' {"a":"é","b":[{"a":null,"z":1}]}'
    assert one(spark, ev.canonical_json(F.lit(a))) == one(spark, ev.canonical_json(F.lit(b))) is not None
    assert one(spark, ev.canonical_json(F.lit("{broken"))) is None
    assert one(spark, ev.canonical_json(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize("text", [None, "", "{}", "7", "[]", "[1, null, [2]]", "broken"])
def test_no_entries_without_objects(spark, text):
    assert one(spark, ev.sanitized(F.lit(text).cast("string"), {"metric": ["visits"]})) == []


def test_unknown_text_and_flags_become_null(spark):
    got = one(spark, ev.sanitized(F.lit('[{"metric": "<b>", "value": true, "percentage_difference": "1e2"}]'), {"metric": ["visits"]}))
    assert (got[0].metric, got[0].value, float(got[0].percentage_difference)) == (None, None, 100.0)


KEYS = "k string, day int, evidence array<struct<component: string, source: string, status: string, value: string>>"


def test_margin_sums_components_and_backfill_settles(spark):
    a, b = ("MARGIN_AMOUNT", "F", "AVAILABLE", "50"), ("MARGIN_BASE_AMOUNT", "F", "AVAILABLE", "100.0")
    rows = spark.createDataFrame([("x", 1, [a, b]), ("x", 2, [("MARGIN_AMOUNT", "F", "AVAILABLE", "9"), ("MARGIN_BASE_AMOUNT", "F", "AVAILABLE", "900")]), ("y", 1, [a]), ("z", 1, None), ("n", 1, [a, ("MARGIN_BASE_AMOUNT", "F", "AVAILABLE", "0")])], KEYS)
    out = {r.k: (r.margin_status, r.margin_rate) for r in ev.margin(rows, ["k"], "F").collect()}
    assert out == {"x": ("AVAILABLE", 5.9), "y": ("UNAVAILABLE_COMPONENTS", None), "z": ("UNAVAILABLE_COMPONENTS", None), "n": ("UNAVAILABLE_ZERO_BASE", None)}
    new = spark.createDataFrame([("x", 1, 50, 100), ("y", 1, 1, 2), ("z", 1, 1, 2), ("q", 1, 1, 2)], "k string, day int, amount long, base long")
    first = ev.margin_backfill(rows, new, ["k", "day"], "F")
    assert {r.k: r.outcome for r in first.collect()} == {"x": "UNCHANGED", "y": "ENRICHED", "z": "ENRICHED", "q": "MISSING_SNAPSHOT"}
    again = ev.margin_backfill(first.drop("outcome").where("evidence is not null"), new, ["k", "day"], "F")
    assert {r.k: r.outcome for r in again.collect()} == {"x": "UNCHANGED", "y": "UNCHANGED", "z": "UNCHANGED", "q": "MISSING_SNAPSHOT"}


TWO = {"a": "First", "b": "Second"}


def parsed(spark, *contents, days=()):
    files = spark.createDataFrame([(f"f{i}", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")
    return sorted(tuple(r) for r in workbook.read_workbooks(files, TWO, days).collect())


def test_workbook_round_trip_skips_blank_rows(spark):
    one_, two = workbook.build([("1", "<&>"), (None, None), ("", None), ("2", None)], TWO), workbook.build([(None, "x")], TWO)
    assert parsed(spark, one_, two) == [("f0", 2, "1", "<&>"), ("f0", 5, "2", None), ("f1", 2, None, "x")]


def test_serial_numbers_are_days_of_the_workbooks_system(spark):
    rows = [(1, "-"), (59, "-"), (60, "-"), (61.75, "-"), (45000, "-"), ("02/01/2026", "-"), ("soon", "-")]
    day = datetime.date
    got = parsed(spark, workbook.build(rows, TWO), workbook.build([(0, "-"), (45000, "-")], TWO, from_1904=True), days=("a",))
    assert [r[4] for r in got[:7]] == [day(1900, 1, 1), day(1900, 2, 28), None, day(1900, 3, 1), day(2023, 3, 15), day(2026, 1, 2), None]
    assert [r[4] for r in got[7:]] == [day(1904, 1, 1), day(2027, 3, 16)]


def test_the_first_whole_sheet_is_taken(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(workbook.build([("1", "2")], TWO))) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            body = old.read(name).decode()
            if name == "xl/workbook.xml":
                body = body.replace("<sheets>", '<sheets><sheet name="notes" sheetId="2" r:id="r2"/>')
            if name.endswith("rels"):
                body = body.replace("</Relationships>", '<Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
            new.writestr(name, body)
        new.writestr("xl/worksheets/sheet2.xml", old.read("xl/worksheets/sheet1.xml").decode().replace("Second", "Other"))
    assert parsed(spark, out.getvalue()) == [("f0", 2, "1", "2")]


def changed(**files):
    """A small workbook with some files replaced."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(workbook.build([("1", "2")], TWO))) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            body = old.read(name).decode()
            new.writestr(name, files["edit"](body) if name.endswith("sheet1.xml") else body)
    return out.getvalue()


@pytest.mark.parametrize(
    "content,code",
    [
        (b"no archive", "INVALID_XLSX"),
        (b"x" * (workbook.MAX_BYTES + 1), "FILE_TOO_LARGE"),
        (workbook.build([], TWO), "EMPTY_REPORT"),
        (workbook.build([("1",)], {"a": "First"}), "MISSING_HEADERS: Second"),
        (changed(edit=lambda s: s.replace("Second", "First")), "DUPLICATE_HEADERS"),
        (changed(edit=lambda s: s.replace('r="A2" t="inlineStr">', 'r="A2" t="inlineStr"><f>1+1</f>')), "FORMULA_NOT_ALLOWED"),
        (changed(edit=lambda s: "<!DOCTYPE x>" + s), "UNSAFE_ARCHIVE"),
    ],
)
def test_bad_workbooks_are_named(spark, content, code):
    with pytest.raises(Exception, match=code):
        parsed(spark, workbook.build([("1", "2")], TWO), content)


@pytest.mark.parametrize(
    "text,inside",
    [("2026-01-02", True), ("2026-01-02 23:59:59", True), ("2026-01-03T02:59:59Z", True), ("2026-01-02T02:00:00Z", False), ("2026-01-02T23:00:00-0300", True), ("2026-01-03", False), (None, False)],
)
def test_local_day_of_text(spark, text, inside):
    assert one(spark, erp.on_local_day(F.lit(text).cast("string"), F.lit(datetime.date(2026, 1, 2)), "America/Sao_Paulo")) is inside


def test_bad_creation_date_is_an_error(spark):
    with pytest.raises(Exception, match="no time can be read"):
        one(spark, erp.on_local_day(F.lit("soon"), F.lit(datetime.date(2026, 1, 2))))


def test_a_candidate_with_a_conflict_writes_nothing(spark):
    candidates = spark.createDataFrame([(1, "A", "a", None), (2, "B", "b", None), (3, "C", "c", 30)], "candidate_id long, sku string, name string, reuse_id long")
    products = spark.createDataFrame([(20, "B", "b"), (31, "C", "c"), (30, "D", "d")], "product_id long, sku string, name string")
    links = spark.createDataFrame([(1, 1, "x"), (2, 2, "y"), (2, 3, "z"), (3, 4, None)], "candidate_id long, item_id long, seller_sku string")
    items = spark.createDataFrame([(1, "x", None), (2, "y", None), (3, "other", None), (4, None, 31)], "item_id long, seller_sku string, product_id long")
    found = mat.targets(candidates, products)
    assert {r.candidate_id: (r.target_id, r.outcome) for r in found.collect()} == {1: (None, "CREATE"), 2: (20, "REUSE"), 3: (None, "CONFLICT")}
    out = mat.link_outcomes(found, links, items)
    assert {r.item_id: r.outcome for r in out.collect()} == {1: "CREATE", 2: "CREATE", 3: "CONFLICT", 4: "CONFLICT"}
    made = products.union(spark.createDataFrame([(10, "A", "a")], products.schema))
    assert {r.item_id: r.product_id for r in mat.applied_items(items, out, made, candidates).collect()} == {1: 10, 2: None, 3: None, 4: 31}


def test_report_text(spark):
    assert one(spark, display.currency_ptbr(F.lit(-1234.5))) == "-R$ 1.234,50"
    assert one(spark, display.signed_percent_ptbr(F.lit(12.3))) == "+12,30%"
    assert one(spark, display.cell(F.lit("a|b\nc"))) == "a\\|b c"
    assert one(spark, display.cell(F.lit(None).cast("string"))) == "-"
