import pytest
from pyspark.sql import functions as F

from kinfold.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "raw, clean, core, forms",
    [
        ("Eye Associates LLC LLC", "eye associates llc llc", "eye", "associates,llc"),
        ("L.L.C. Foo", "l l c foo", "foo", "l l c"),
        ("LLC", "llc", "llc", "llc"),
        ("Foo | www.foo.com", "foo", "foo", ""),
        ("| Foo", "", "", ""),
        ("msbrothers.com", "msbrothers com", "msbrothers com", ""),
        ("foo.co.in bar", "in bar", "in bar", ""),
        ("#tag A & B", "tag a and b", "tag a and b", ""),
        ("O'Neil & Sons' Co", "o'neil and sons' co", "o'neil and sons", "co"),
        ("Thénard SARL", "thénard sarl", "thénard", "sarl"),
        ("éco inc", "éco inc", "éco", "inc"),
        ("सूर्या", "सूर्या", "सूर्या", ""),
        ("ＡＢＣ ltd", "abc ltd", "abc", "ltd"),
        ("see https://a.b/c?d=1 now", "see now", "see now", ""),
        ("", "", "", ""),
        (None, "", "", ""),
    ],
)
def test_names(spark, raw, clean, core, forms):
    name = T.clean_name(F.col("x"))
    assert one(spark, name, x=raw) == clean
    assert one(spark, T.core_name(F.col("x")), x=clean) == core
    assert one(spark, T.legal_forms(F.col("x")), x=clean) == forms


def test_addresses(spark):
    clean = one(spark, T.clean_address(F.col("x")), x="12 MG Rd., Opp. SBI, Pune")
    assert clean == "12 mg road opposite sbi pune"
    assert one(spark, T.landmark(F.col("x")), x=clean) == "opposite sbi pune"
    assert one(spark, T.landmark(F.col("x")), x="12 mg road") == ""
    assert one(spark, T.address_words(F.col("x")), x=clean) == ["mg", "opposite", "pune", "road", "sbi"]
    assert one(spark, T.numbers(F.col("x")), x="12/3, 12 PIN ४५") == ["12", "3", "४५"]
    assert one(spark, T.clean_address(F.col("x")), x=None) == ""


def test_ngrams_folding_and_lists(spark):
    assert one(spark, T.char_ngrams(F.col("x")), x="") == ["    "]
    assert one(spark, T.char_ngrams(F.col("x")), x="ab") == sorted({"  ab", " ab ", "ab  "})
    assert one(spark, T.ascii_fold(F.col("x")), x="Thénard") == "Thenard"
    assert one(spark, T.ascii_fold(F.col("x")), x="क्") == "क"
    assert one(spark, T.id_list(F.col("x")), x="a,,b") == ["a", "b"]
    assert one(spark, T.prefix(F.col("x")), x="ab") is None and one(spark, T.prefix(F.col("x")), x="abcde") == "abcd"


def test_scripts(spark):
    flags = lambda x: one(spark, T.script_flags(F.col("x")), x=x).asDict()
    hindi = flags("सूर्या 1")
    assert hindi["devanagari"] and hindi["any_indic"] and not hindi["non_latin_other"]
    assert flags("é") == {k: k == "non_latin_other" for k in hindi}
    assert not any(flags("plain –").values())
    assert one(spark, T.has_indic(F.col("x")), x="தமிழ்") and not one(spark, T.has_indic(F.col("x")), x="é")
