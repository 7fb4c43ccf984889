import pytest
from pyspark.sql import functions as F

from plurivox.functions import lang, text


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(("raw", "masked"), [
    ("write to a.b+c@mail.example.org now", "write to [email] now"),
    ("see https://example.org/a?b=c and www.example.org/x", "see [url] and [url]"),
    ("thanks @some_one!", "thanks [mention]!"),
    ("call 06 12 34 56 78 or +33 6 12 34 56 78", "call [tel] or [tel]"),
    ("in 2024 there were 12 of them", "in 2024 there were 12 of them"),
])
def test_mask_pii(spark, raw, masked):
    assert one(spark, text.mask_pii, raw) == masked


def test_clean_text(spark):
    assert one(spark, text.clean_text, "  Une phrase !!!!  “vraie”\u0007 — l’idée\n\n fin... ") == "Une phrase ! \"vraie\" - l'idée fin."
    assert one(spark, text.clean_text, None) == ""
    assert one(spark, text.clean_text, "été") == "été"


def test_empty_like(spark):
    assert one(spark, text.empty_like, "ok") is True
    assert one(spark, text.empty_like, "1 2 3") is True
    assert one(spark, text.empty_like, "oui") is False


def test_label_cuts_at_a_word(spark):
    assert one(spark, lambda c: text.label(c, 12), "short") == "short"
    assert one(spark, lambda c: text.label(c, 12), "some words, more") == "some words…"
    assert one(spark, lambda c: text.label(c, 4), "unbroken") == "unbr…"


def test_slug_and_fallback(spark):
    assert one(spark, text.slug, "  Été -- 2024!") == "t-2024"
    assert one(spark, text.slug, "!!!") == "item"


def test_author_hash_needs_a_salt():
    with pytest.raises(ValueError):
        text.author_hash(F.lit("a"), F.lit("b"), "short")


def test_fold(spark):
    assert one(spark, text.fold, "ÉCOLE Straße Łódź") == "ecole strasse łodz"


@pytest.mark.parametrize(("raw", "code"), [("le chat est dans la rue", "fr"), ("the cat is in the street", "en"), ("der Hund und die Katze", "de"), ("zzz qqq", "und"), ("a", "und"), ("", "und")])
def test_language(spark, raw, code):
    assert one(spark, lang.guess, raw) == code


def test_readability(spark):
    values = [spark.range(1).select(text.readability(F.lit(n))).first()[0] for n in (0, 100, 400, 2400)]
    assert values == [0.0, 0.5, 1.0, 0.5]


def test_fold_sign_by_sign(spark):
    """What folds in the JVM is what Unicode's tables give, for every sign and for signs in a row; only texts with other signs go to Python."""
    import re
    import unicodedata

    signs = [s for s in text._SIGNS if s != "\x00"]
    rows = [*signs, "".join(signs[:700]), "".join(s for s in signs if s not in text._HARD), "Élève STRASSE Straße ﬁ ΐ 한국 ẞ", "", None]
    want = [t if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").casefold() for t in rows]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string").select("i", text.fold("text").alias("f"))
    assert [r["f"] for r in sorted(df.collect())] == want
    assert not re.search(text._OTHER, "Élève Straße, œuvre – ça ¿qué?") and re.search(text._OTHER, "한")


def test_bigrams_tokenise_once(spark):
    """The tokens stand once in the plan of 1- and 2-grams, and short words stay out of both."""
    from plurivox.operators import naming

    rows = naming.with_bigrams(spark.createDataFrame([("s", "L'Été à la mer, the ab SEA"), ("s", "one"), ("s", "a"), ("s", None)], "source string, text string"), "source", "text")
    assert rows._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
    assert sorted(r["term"] for r in rows.collect()) == ["mer", "mer the", "one", "sea", "the", "the sea", "été", "été mer"]
