"""Text statistics of documents and their tails (problem 10).

Every document is measured by Spark's own expressions, whole: words, mean word length, symbol ratio, share of lines that end in
punctuation, share of common words, and with them share of cue timings, of table rows, of adverts and of vowels. The cue
scaffolding (numbers, timings, markup) is set aside first, as are lines that describe sounds only.

For each language and each statistic a mergeable quantile sketch (KLL) holds the distribution; documents without a usable
language are held against the sketch of all. A value becomes a robust z-score: its distance from the median in quartile widths
of the other side, so that many documents in one tail don't hide each other. Where they are half of a language they still do.
A document whose lines hardly ever end a sentence, or are nearly all adverts, lies in a tail that spoken dialogue never reaches;
which other statistics lie in their tails tells tables, junk and lists apart.

Only sketches are shuffled, a few by language; they join back by broadcast, bounded by the number of languages kept (those of
LANGUAGES and one for all).

Defined cases: null, empty and blank texts, and texts of nothing but cue scaffolding, have null statistics and no kind; a row
delivered twice is measured twice and found once; an unknown or missing language counts as `all`; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

# Languages with their other codes, and frequent words of each.
LANGUAGES = {
    "en": ("en", "eng"), "es": ("es", "spa"), "de": ("de", "ger", "deu"), "fr": ("fr", "fre", "fra"),
    "pl": ("pl", "pol"), "ru": ("ru", "rus"), "ja": ("ja", "jpn"),
}
COMMON = {
    "en": "the a of to and in is it you that for with was but not we he she my your his her this on at have what all",
    "es": "el la los las de que y a en un una no es se por con lo mi su para antes sin pero yo tu nuestro",
    "de": "der die das und ist ein eine nicht ich du er sie wir mit den dem am im zu für uns auf mein dein es ja",
    "fr": "le la les de et un une est pas je tu il elle nous vous que dans pour sans ce au mon ton notre avant",
    "pl": "i w nie się na z do to że ja ty mój moja bez przed po jest nasze nikt co tak no",
    "ru": "и в не на я ты он она мы что это с до по но моя мой у за без наши никто да нет",
    "ja": "は が を の に で た",
}

#: Quartile widths from the median beyond which a value lies in the tail, and in the far one.
TAIL, FAR_TAIL = 4.0, 6.0
#: Bounds that define a kind: the share of lines that are adverts in a text of nothing but adverts, and of lines that end in spoken text.
NEARLY_ALL, MOST_LINES_END = 0.85, 0.6

#: Patterns that could begin anywhere look ahead for their first characters, which spares trying each alternative everywhere.
#: What ends a spoken line: a mark and whatever closes it. The last group are full-width marks read in a wrong encoding.
SPOKEN_END = (
    r"""(?dm)(?=[.!?…。！？؟ãïÃ])(?:[.!?…。！？؟]|ã\x80\x82|ã€‚|ï¼\x81|ï¼\x9f|ï¼Ÿ|ï¼|Ã£Â\x80Â\x82|Ã¯Â¼Â\x81|Ã¯Â¼Â\x9f)"""
    r"""(?:["'»“”’)\]*_#~ \t-]|\p{So}|\p{Cf}|\x{fe0f}|â\x99ª|â™ª|ð\x9f[^\n]{2})*$"""
)
ADVERT = r"(?i)(?=[hw.vs])(?:https?://|www\.|(?<=[\w-])\.(?:com|net|org|info|test|invalid|example)\b|\bVIP\b|synced? (?:&|and) correct|subtitles by)[^\n]*"
VOWELS = "aeiouyäöüàáâãåèéêëìíîïòóôõøùúûýąęóœæаеёиоуыэюяєі"


def alternatives(words: list[str]) -> str:
    """A pattern for any of the words that shares their beginnings, so that a word is tried once and not once a word of the list."""
    tree: dict = {}
    for w in words:
        at = tree
        for ch in w:
            at = at.setdefault(ch, {})
        at[""] = {}

    def write(at: dict) -> str:
        parts = [ch + write(below) for ch, below in sorted(at.items()) if ch]
        return "" if not parts else "(?:" + "|".join(parts) + ")" + ("?" if "" in at else "")

    return write(tree)


def language(lang: Column) -> Column:
    """The language's own code, or `all` where it is missing or unknown."""
    code = F.lower(F.trim(F.coalesce(lang.cast("string"), F.lit(""))))
    out = F.lit("all")
    for key, codes in LANGUAGES.items():
        out = F.when(code.isin(*codes), key).otherwise(out)
    return out


def body(text: Column) -> Column:
    """What is said: without byte-order marks, numbers and timings of cues, markup, and lines that describe sounds."""
    s = F.regexp_replace(text, r"\r\n?", "\n")
    s = F.when(s.rlike(r"^\x{feff}?\s*\{\d+\}\{\d+\}"), F.regexp_replace(F.regexp_replace(s, r"(?dm)^\x{feff}?\{\d+\}\{\d+\}", ""), r"\|", "\n")).otherwise(s)
    sounds = r"-?[ \t]*[\[(][^\n\])]*[\])]|[♪♫🎵#][^.!?…。！？\n]*[♪♫🎵#]"
    return F.regexp_replace(s, rf"(?dm)^[\x{{feff}} \t]*(?:WEBVTT.*|NOTE\b.*|\d+|.*-->.*|{sounds})[ \t]*$|</?[a-zA-Z][^>\n]*>|\{{\\[^}}\n]*\}}", "")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, language and the statistics of each document, whole texts always. What is counted by character is counted in two steps:
    ASCII letters and digits, most of a text, by the length they leave behind, and the rest in what is left."""
    held = docs.select("doc_id", language(F.col("lang")).alias("language"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("body", body(F.col("text")))
    b, t = F.col("body"), F.col("text")
    count = lambda s, p: F.regexp_count(s, F.lit(p)).cast("double")
    without = lambda s, p: F.regexp_replace(s, p, "")
    frequent = alternatives(sorted({w for k, v in COMMON.items() if k != "ja" for w in v.split()}))
    common = rf"(?:^|[^\p{{L}}\p{{N}}]){frequent}(?![\p{{L}}\p{{N}}])|[{COMMON['ja'].replace(' ', '')}](?=[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}])"
    left = without(without(b, "[a-zA-Z0-9]+"), "[ \t\n]+")
    plain = (F.length(b) - F.length(without(b, "[a-zA-Z0-9]+"))).cast("double")
    counted = held.withColumns(
        {
            "n_lines": count(b, r"\S[^\n]*"),
            "n_words": count(b, r"[\p{L}\p{N}][\p{L}\p{N}\p{M}'’]*"),
            "n_word_chars": plain + F.length(without(left, r"[^\p{L}\p{N}]+")),
            "n_visible": plain + F.length(left),
            "n_symbols": count(left, r"[^\p{L}\p{N}\p{M}\s.,:;!?'’\"“”«»()…。、！？♪♫•·-]"),
            "n_vowels": (F.length(b) - F.length(without(b, "[aeiouyAEIOUY]+"))) + count(left, rf"[{VOWELS}\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}]"),
            "n_ends": count(b, SPOKEN_END),
            "n_common": count(F.lower(b), common),
            "n_adverts": count(b, ADVERT),
            "n_rows": count(b, r"(?dm)^(?:[+|][^\n]*[+|][ \t]*|[^\n|;\t]*[|;\t][^\n]*|[^\n,]*,[^\n,]*(?:,[^\n]*)?|[^\n]*\S {2,}\S[^\n]*)$"),
            "n_cues": count(t, r"-->|(?dm)^\x{feff}?\{\d+\}\{\d+\}"),
        }
    )
    return counted.select(
        "doc_id",
        "language",
        F.col("n_words").cast("bigint").alias("word_count"),
        _share(F.col("n_word_chars"), F.col("n_words")).alias("mean_word_length"),
        _share(F.col("n_symbols"), F.col("n_visible")).alias("symbol_ratio"),
        _share(F.col("n_ends"), F.col("n_lines")).alias("end_share"),
        _share(F.col("n_common"), F.col("n_words")).alias("common_share"),
        _share(F.col("n_adverts"), F.col("n_lines")).alias("advert_share"),
        _share(F.col("n_cues"), F.col("n_lines") + 1).alias("cue_share"),
        _share(F.col("n_rows"), F.col("n_lines")).alias("row_share"),
        _share(F.col("n_vowels"), F.col("n_word_chars")).alias("vowel_share"),
    )


#: Each statistic and the least width of its distribution, on the scale of its values; word counts are measured by their logarithm.
MEASURES = {"word_count": 0.1, "mean_word_length": 0.5, "symbol_ratio": 0.05, "end_share": 0.05, "common_share": 0.05, "advert_share": 0.05, "cue_share": 0.05, "row_share": 0.05, "vowel_share": 0.05}


ANYWHERE = ("vowel_share", "common_share")


def measure(m: str) -> Column:
    return F.log1p(F.col(m)) if m == "word_count" else F.col(m).cast("double")


def sketches(stats: DataFrame) -> DataFrame:
    """By language, and for all, a KLL sketch of each statistic. Sketches of parts of the corpus merge with kll_merge_agg_double."""
    both = stats.withColumn("language", F.explode(F.array_distinct(F.array(F.col("language"), F.lit("all")))))
    return both.groupBy("language").agg(*[F.kll_sketch_agg_double(measure(m)).alias(m) for m in MEASURES], F.count(F.lit(1)).alias("n"))


def scores(stats: DataFrame) -> DataFrame:
    """The statistics with, for each, a robust z-score `z_...` (of some also one within all languages, `za_...`, since labels of languages
    can be wrong) and the share of documents below it, `p_...` in hundredths, within the document's language."""
    quantile = lambda m, r: F.kll_sketch_get_quantile_double(F.col(m), F.lit(r))
    held = sketches(stats).where("n > 0").select("language", *[F.struct(quantile(m, 0.25).alias("q1"), quantile(m, 0.5).alias("q2"), quantile(m, 0.75).alias("q3"), F.kll_sketch_get_quantile_double(F.col(m), F.array(*[F.lit(i / 100) for i in range(1, 101)])).alias("hundredths")).alias(f"q_{m}") for m in MEASURES])
    every = Window.partitionBy(F.lit(0))  # a row a language, eight at most
    held = held.withColumns({f"a_{m}": F.max(F.when(F.col("language") == "all", F.struct(*[F.col(f"q_{m}.q{i}") for i in (1, 2, 3)]))).over(every) for m in ANYWHERE})
    joined = stats.join(F.broadcast(held), "language")

    def z(m: str, against: str = "q") -> Column:
        """The width is that of the other side of the median, so that a heavy tail can't widen its own fence."""
        v, (q1, q2, q3) = measure(m), (F.col(f"{against}_{m}.q{i}") for i in (1, 2, 3))
        width = F.when(v < q2, q3 - q2).otherwise(q2 - q1)
        return (v - q2) / F.greatest(width, F.lit(MEASURES[m]))

    scored = joined.withColumns({f"z_{m}": z(m) for m in MEASURES} | {f"za_{m}": z(m, "a") for m in ANYWHERE}).withColumns({f"p_{m}": F.when(measure(m).isNotNull(), F.size(F.filter(f"q_{m}.hundredths", lambda q, v=measure(m): q < v)) / 100) for m in MEASURES})
    return scored.drop(*[f"q_{m}" for m in MEASURES], *[f"a_{m}" for m in ANYWHERE])


def kinds(scored: DataFrame) -> DataFrame:
    """The scored documents with doc_kind: list, table, junk, or null for spoken dialogue and for texts without words or signs.

    What decides are the tails, TAIL widths from the median of the language, FAR_TAIL for signs. Two bounds are added where a kind is defined by one: junk
    is text of which nearly every line is an advert, and lists, tables and garbled text are such of which most lines end nothing."""
    low, high = lambda m: F.coalesce(F.col(f"z_{m}"), F.lit(-TAIL - 1)) < -TAIL, lambda m: F.col(f"z_{m}") > TAIL
    silent = (F.col("z_end_share") < -TAIL) & (F.col("end_share") < MOST_LINES_END)
    adverts = high("advert_share") & (F.col("advert_share") > NEARLY_ALL)
    rows = low("cue_share") & high("row_share")
    noise = low("vowel_share") & low("common_share") & (F.coalesce("za_vowel_share", F.lit(-TAIL - 1)) < -TAIL)
    garbled = (F.col("z_symbol_ratio") > FAR_TAIL) | noise
    kind = F.when(adverts, "junk").when(silent & rows, "table").when(silent & garbled, "junk").when(silent, "list")
    return scored.withColumn("doc_kind", kind)


def measured(docs: DataFrame) -> DataFrame:
    """Statistics, scores and kind of every document. The statistics are kept in a table, so that texts are read once."""
    return kinds(scores(materialise(statistics(docs))))


def found(docs: DataFrame) -> DataFrame:
    return measured(docs).where("doc_kind is not null").select("doc_id", "doc_kind").distinct()
