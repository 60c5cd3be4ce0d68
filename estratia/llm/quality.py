"""Quality rules: base counts and the divergence of a text from its language.

A document's histograms of character classes and of common words are compared with those of its
language, which are sums over all documents of that language, by the Jensen-Shannon distance.

Defined results: a null text counts as empty; an empty or short text fails the base rules; a text
with too few letters or words for a histogram is not judged by it; a language that is null is a
language of its own; a language without counts judges nothing; repeated rows are judged one by one;
columns beyond those named are passed on, and a column of a result's name is replaced by the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estratia.llm.common import NOT_SPACE, cut, n_of, whole, words

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Distances above these reject a document.
MAX_CHAR_DISTANCE = 0.30
#: A text without any common word is 0.214 (de), 0.215 (en), 0.218 (fr) or 0.242 (es) from its language's
#: reference, whatever the size of the corpus; the limit is three quarters of the least of these.
MAX_WORD_DISTANCE = 0.16
#: Documents with fewer characters or words are not judged by the histogram.
MIN_CHARS_JUDGED = 200
MIN_WORDS_JUDGED = 50

# Frequent function words of the languages, and character classes.
COMMON_WORDS = ("the", "of", "and", "de", "la", "et", "der", "die", "und", "el", "que", "y")
SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[0-9.,;:!?'\"()\-]"
UPPER = r"\p{Lu}"
N_CLASSES = 5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside three-word windows that the text holds twice or more.

    A window is known by the 64-bit digest of its words. Where digests repeat, one sort of (digest,
    place) brings equal windows together, and neighbours are compared.
    """
    none = F.array().cast("array<bigint>")
    digest = F.transform("w_", lambda x, i: F.xxhash64(x, F.get("w_", i + 1), F.get("w_", i + 2)))
    df = df.withColumn("d_", F.when(F.size("w_") >= 3, F.slice(digest, 1, F.size("w_") - 2)).otherwise(none))
    df = df.withColumn("some_", F.size(F.array_distinct("d_")) < F.size("d_"))
    packed = F.expr("transform(d_, (d, i) -> struct(d, i))")
    df = df.withColumn("o_", F.when(F.col("some_"), F.sort_array(packed)))
    twin = "o.d = get(o_, j - 1).d or o.d = get(o_, j + 1).d"
    df = df.withColumn("o_", F.expr(f"filter(o_, (o, j) -> {twin})"))
    covered = "flatten(transform(o_, o -> array(o.i, o.i + 1, o.i + 2)))"
    count = F.when(F.col("some_"), F.expr(f"size(array_distinct({covered}))")).otherwise(0).cast("long")
    return df.withColumn("n_repeat_words", count).drop("d_", "o_", "some_")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts, base_failed, char_hist and word_hist.

    char_hist counts capitals, marks and digits, spaces, symbols and the rest; word_hist the common
    words as they stand between spaces, then all other words.
    """
    df = docs.withColumn("t_", whole(text))
    df = df.withColumn("w_", words(F.col("t_")))
    df = df.withColumn("l_", F.filter(F.split("t_", "\n"), lambda x: x.rlike(NOT_SPACE)))
    df = df.withColumn("n_words", F.size("w_").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("w_", "")).cast("long"))
    df = df.withColumn("n_symbols", n_of(F.col("t_"), SYMBOLS))
    df = df.withColumn("n_dup_lines", (F.size("l_") - F.size(F.array_distinct("l_"))).cast("long"))
    df = df.withColumn("n_upper_", n_of(F.col("t_"), UPPER)).withColumn("n_marks_", n_of(F.col("t_"), MARKS))
    df = _repeat_words(df)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > MAX_REPEATED_PERCENT * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    space = F.length("t_") - F.col("word_chars")
    rest = F.col("word_chars") - F.col("n_upper_") - F.col("n_marks_") - F.col("n_symbols")
    df = df.withColumn("char_hist", F.array("n_upper_", "n_marks_", space, "n_symbols", rest))
    df = df.withColumn("c_", F.filter("w_", lambda w: w.isin(*COMMON_WORDS)))
    each = [(F.size("c_") - F.size(F.array_remove("c_", w))).cast("long") for w in COMMON_WORDS]
    df = df.withColumn("word_hist", F.array(*each, (F.size("w_") - F.size("c_")).cast("long")))
    return df.drop("t_", "w_", "l_", "c_", "n_upper_", "n_marks_")


def references(counted: DataFrame, lang: str = "lang") -> DataFrame:
    """ref_lang, ref_chars, ref_words: the histograms of each language, summed over all its documents."""
    chars, common = range(N_CLASSES), range(len(COMMON_WORDS) + 1)
    sums = [F.sum(F.get("char_hist", F.lit(i))).alias(f"c{i}") for i in chars]
    sums += [F.sum(F.get("word_hist", F.lit(i))).alias(f"w{i}") for i in common]
    total = counted.groupBy(F.col(lang).alias("ref_lang")).agg(*sums)
    arrays = F.array(*(f"c{i}" for i in chars)).alias("ref_chars"), F.array(*(f"w{i}" for i in common)).alias("ref_words")
    return total.select("ref_lang", *arrays)


def _sum(counts: str) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def distance(a: str, n: str, b: str, m: str) -> Column:
    """Jensen-Shannon distance (base 2) of the count arrays a and b, which sum to n and m; null if one is empty."""

    def part(x: Column, y: Column) -> Column:
        p, q = x / F.col(n), y / F.col(m)
        own = F.when(x > 0, p * F.log2(p * 2 / (p + q))).otherwise(0.0)
        return own + F.when(y > 0, q * F.log2(q * 2 / (p + q))).otherwise(0.0)

    total = F.aggregate(F.zip_with(a, b, part), F.lit(0.0), lambda s, v: s + v) / 2
    return F.when((F.col(n) > 0) & (F.col(m) > 0), F.sqrt(F.greatest(total, F.lit(0.0))))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", leave_out: tuple[str, ...] = ()) -> DataFrame:
    """``docs``, without the columns to leave out, with the base counts, char_distance, word_distance and kept.

    These replace columns of the same names; all other columns stay, whatever their names.

    The counted rows are written once: the references are sums of them, and the few rows of the
    references then meet them again. These are written too, so that Spark knows their size before the
    join and the texts stay where they are.
    """
    names = [c for c in docs.columns if c not in leave_out]
    packed = F.struct(F.lit(True).alias("any"), *(F.col(c).alias(f"u{i}") for i, c in enumerate(names))).alias("row_")
    docs = docs.select(packed, F.col(text).alias("text_"), F.col(lang).alias("lang_"))
    df, lang = cut(features(docs, "text_").drop("text_")), "lang_"
    refs = cut(references(df, lang))
    df = df.join(refs, df[lang].eqNullSafe(refs["ref_lang"]), "left")
    for sum_, counts in (("a_", "char_hist"), ("b_", "word_hist"), ("ra_", "ref_chars"), ("rb_", "ref_words")):
        df = df.withColumn(sum_, _sum(counts))
    chars = F.when(F.col("a_") >= MIN_CHARS_JUDGED, distance("char_hist", "a_", "ref_chars", "ra_"))
    common = F.when(F.col("b_") >= MIN_WORDS_JUDGED, distance("word_hist", "b_", "ref_words", "rb_"))
    df = df.withColumn("char_distance", F.round(chars, 6)).withColumn("word_distance", F.round(common, 6))
    near = F.coalesce(F.col("char_distance"), F.lit(0.0)) <= MAX_CHAR_DISTANCE
    alike = F.coalesce(F.col("word_distance"), F.lit(0.0)) <= MAX_WORD_DISTANCE
    df = df.withColumn("kept", ~F.col("base_failed") & near & alike)
    made = [*BASE, "char_distance", "word_distance", "kept"]
    return df.select(*(F.col(f"row_.u{i}").alias(c) for i, c in enumerate(names) if c not in made), *made)
