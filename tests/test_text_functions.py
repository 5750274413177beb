from pyspark.sql import functions as F

from folioflow.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


def test_tokens_are_unicode(spark):
    assert one(spark, T.token_count("t"), t="Grüße, Welt! a-b") == 7


def test_cleaned_chunk(spark):
    assert one(spark, T.cleaned_chunk("t"), t="[Page 3]\n a  b \n\n [page 12] c\td") == "a b\nc d"


def test_page_range(spark):
    first, last = T.page_range("t")
    assert one(spark, F.array(first, last), t="[Page 7] x [PAGE 3] y") == [3, 7]
    assert one(spark, first, t="none") is None


def test_search_terms_use_aliases_and_drop_stop_words(spark):
    assert one(spark, T.search_terms("t"), t="The Bhagawat GEETHA and 'a' of it") == ["bhagavad", "gita"]


def test_phrase_is_a_part_of_the_text(spark):
    assert one(spark, T.phrase_in("p", "t"), p="Cat", t="a catalog") is True
    assert one(spark, T.phrase_in("p", "t"), p="...", t="anything") is False


def test_snippet_centres_on_a_term(spark):
    text = "a " * 300 + "needle " + "b " * 300
    out = one(spark, T.snippet("t", "q", 100), t=text, q="is needle")
    assert "needle" in out and out.startswith("...") and out.endswith("...") and len(out) <= 106
    assert one(spark, T.snippet("t", "q", 100), t="short  text", q="x") == "short text"
    assert one(spark, T.snippet("t", "q", 20), t="x" * 50, q="zzz") == "x" * 17 + "..."


def test_trigrams(spark):
    assert sorted(one(spark, T.trigrams("t"), t="cat")) == ["  c", " ca", "at ", "cat"]
    assert one(spark, T.trigram_similarity(T.trigrams("a"), T.trigrams("b")), a="cat", b="cat") == 1.0
    assert one(spark, T.trigram_similarity(T.trigrams("a"), T.trigrams("b")), a="", b="") == 0.0


def test_numeric_table_and_ratios(spark):
    assert one(spark, T.numeric_table("t"), t="A12 | 34 | 56 | B78 | 90") is True
    assert one(spark, T.numeric_table("t"), t="no numbers, here; at: all") is False
    assert one(spark, T.alpha_ratio("t"), t="ab12") == 0.5
    assert one(spark, T.alpha_ratio("t"), t="  ") is None


def test_names_and_types(spark):
    assert one(spark, T.name_key("t"), t=" Sri  Ramana-Maharshi! ") == "sri ramana maharshi"
    assert one(spark, T.type_key("t", "UNKNOWN"), t=" lives in ") == "LIVES_IN"
    assert one(spark, T.type_key("t", "UNKNOWN"), t="--") == "UNKNOWN"


def test_json_in_an_answer(spark):
    assert one(spark, T.json_in("t"), t='Sure:\n```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.json_in("t"), t='so [1, 2] it is') == "[1, 2]"


def test_trace_parent(spark):
    good = "00-" + "a" * 32 + "-" + "b" * 16 + "-01"
    assert one(spark, T.trace_parent("t"), t=good).span_id == "b" * 16
    assert one(spark, T.trace_parent("t"), t="00-" + "0" * 32 + "-" + "b" * 16 + "-01") is None


def test_measures_of_odd_texts_by_plain_regexes(spark):
    """Counts without a match for each character, on texts of every white space, line break and digit."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    atoms = [*T.WHITE, *"\x1c\x1d\x1e _'-,;:|aXiv09", "\r\n", "  ", " ", "[Page 3]", "[page x]", "[PAGe\t1]", "é", "漢", "𝒜", "𝟘", "😀", "٣", "don't", "i-v", "ab''", "a--b"]
    df = spark.createDataFrame([("".join(rng.choice(atoms) for _ in range(rng.randrange(25))),) for _ in range(3000)] + [(None,)], "t string")
    space = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    visible = F.nullif(F.length(F.regexp_replace("t", r"(?U)\s+", "")), F.lit(0))
    lines = F.transform(F.split(F.regexp_replace("t", T.PAGE_MARKER, " "), T.LINE_BREAK), space)
    plain = {
        "tokens": (T.token_count("t"), F.regexp_count("t", F.lit(T.TOKEN))),
        "stripped": (T.stripped("t"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "")),
        "one_space": (T.one_space("t"), space(F.col("t"))),
        "cleaned": (T.cleaned_chunk("t"), F.array_join(F.filter(lines, lambda x: x != ""), "\n")),
        "meaningful": (T.meaningful("t"), F.filter(T.found("t", T.LATIN_WORD), lambda w: ~w.rlike("^[ivxlcdmIVXLCDM]+$") & (F.length(F.btrim(w, F.lit("'-"))) >= 3))),
        "alpha": (T.alpha_ratio("t"), F.regexp_count("t", F.lit(r"\p{L}")) / visible),
        "digits": (T.digit_ratio("t"), F.regexp_count("t", F.lit(r"\p{Nd}")) / visible),
    }
    wrong = df.select(*(F.count_if(~a.eqNullSafe(b)).alias(n) for n, (a, b) in plain.items())).first().asDict()
    assert wrong == dict.fromkeys(plain, 0)
