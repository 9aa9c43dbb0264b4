"""Personal information in free text (problem 5): found, typed and replaced, the rest of the text left as it is.

Mentions are found by patterns with the words around them, all evaluated by Spark itself. Numbers get format-preserving pseudonyms by a
keyed Feistel network: equal numbers have equal pseudonyms in all documents, and whoever holds the key can turn one back. What is
permuted are the parts that a number's format leaves free. Telephone numbers keep their country or trunk prefix. Identity numbers are
validated first: in those with a birth date the date is permuted among the dates that exist, together with the serial number, and a
number whose check digit or letter holds (personnummer, PESEL, NIE) gets a pseudonym whose own one holds; social security numbers stay
within the ranges of theirs. A number of an identity's form that fails its check is still a mention; it is permuted by its form.
Names, e-mail addresses and street addresses get a keyed tag. A placeholder gives the type and the pseudonym, such as
`[PHONE +71 83 3309 4410]` or `[NAME 5e01c2a9]`.

Names are found by the words before them (titles and cues), and without any where both parts are known: parts of cued names are
counted over all entries as given names and surnames, and a pair of capitalised words is a name if the first was a given name in
KNOWN entries at least and the second a surname in one. The counts are summed on the map side and joined to distinct pairs.

Texts are cut at the mentions by the very pattern that finds them, so nothing is replaced that is no mention.

Defined cases: null content stays null and has no mentions; empty text stays empty; text of any length is read whole; a mention
is found once an entry and replaced at each of its places; rows delivered twice give the same mentions once; extra columns stay; no
key, or an empty one, is an error.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

ROUNDS = 8
#: Entries in which a word must have been a given name for a name without cues.
KNOWN = 3

# Fixed words: what street names end or begin with, titles, and the words before and after a person's name.
STREET_ENDS = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Row|Close|Drive|Dr\.?|Court|Ct\.?|Square|Sq\.?|Place|Pl\.?|Terrace|Way|Crescent|Gardens|Grove|Hill|Mews|Parade|Park|Quay|Walk|Yard)"
FRENCH_STREETS = r"(?:rue|avenue|av\.|chemin|boulevard|bd|place|quai|allée|impasse|route|cours|square|passage)"
GERMAN_ENDS = r"(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|steig|hof|markt|graben|wall|chaussee)"
GERMAN_STARTS = r"(?:Am|An der|An den|Auf dem|Auf der|Im|In der|Zum|Zur|Unter den|Unter der)"
TITLES = ("Mr ", "Mr. ", "Mrs ", "Mrs. ", "Ms ", "Ms. ", "Miss ", "Dr ", "Dr. ", "Frau ", "Herr ", "Herrn ", "Mme ", "Monsieur ", "Madame ", "Señor ", "Señora ")
BEFORE_NAME = (
    "name is ", "full name ", "customer ", "applicant ", "signed by ", "opened by ", "accepted by ", "invited by ", "data subject ", "hi, ", "dear ", "Dear ",
    "ask for ", "contact: ", "contact ", "patient ", "caller ", "passenger ", "employee ", "guest ", "on behalf of ", "spoke to ", "spoke with ", "approved by ", "written by ", "name: ",
)
_U, _L = r"\p{Lu}", r"[\p{L}]"
_PART = rf"{_U}(?:['’]{_U})?{_L}+"
_T = rf"(?:{_PART}(?:-{_PART})*)"
_I = rf"(?:{_U}\.)"
NAME = rf"(?:(?:{_T}|{_I})(?: (?:{_T}|{_I})){{0,2}} {_T}|{_T}, {_T}(?: {_I}| {_T})?)(?![\p{{L}}@])"


def alternatives(words: tuple[str, ...]) -> str:
    """A pattern for any of the words that shares their beginnings, so that a word is tried once and not once a word of the list."""
    tree: dict = {}
    for w in words:
        at = tree
        for ch in w:
            at = at.setdefault(ch, {})
        at[""] = {}

    def write(at: dict) -> str:
        parts = [re.escape(ch) + write(below) for ch, below in sorted(at.items()) if ch]
        return "" if not parts else "(?:" + "|".join(parts) + ")" + ("?" if "" in at else "")

    return write(tree)


def _after(cues: tuple[str, ...]) -> str:
    """What one of the cues stands before. Looking back costs a try for every length, so cues are grouped by theirs."""
    by_length: dict[int, list[str]] = {}
    for c in cues:
        by_length.setdefault(len(c), []).append(c)
    return "(?:" + "|".join(rf"(?<=(?<![\p{{L}}]){alternatives(tuple(cs))})" for _, cs in sorted(by_length.items())) + ")"


#: Every cue ends with a blank, which is looked at first.
NAMES = "(?<= )" + _after(TITLES + BEFORE_NAME) + NAME
CUED = rf"(?<![\p{{L}}]){alternatives(TITLES + BEFORE_NAME)}(?=\p{{Lu}})"
#: Two capitalised words, or a surname, a comma and a given name, that nothing introduces; looked for at every word.
_AROUND = (r"(?<![\p{L}\p{N}_.@/'’-])", r"(?![\p{L}\p{N}_@/'’-])")
PAIRED = rf"{_AROUND[0]}(?=\p{{Lu}})(?=({_T},? (?:{_I} )?{_T}){_AROUND[1]})"
_DOT = r"(?:\.|\(dot\)| ?\[dot\] ?| \(dot\) )"
EMAILS = rf"(?<![\w.+%-])[A-Za-z0-9][\p{{L}}\p{{N}}_.+-]*(?:@|%40|&#64;|\(at\)| \[at\] |\[at\]| \(at\) )[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9][A-Za-z0-9-]*)*{_DOT}[A-Za-z]{{2,}}(?![\w@-])"
_MMDD = r"(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])"
#: By what they begin with: a digit, a plus sign or bracket, or a capital letter.
PHONES_DIGIT = (
    r"(?<![\w-])00\d{2}[ -]\d{2,4}[ -]\d{5,8}(?!\w)",
    r"(?<![\w.-])0\d{2,4}/\d{4,6}(?:-\d{1,4})?(?!\w)",
    r"(?<![\w.-])0\d{2,4} \d{3,4} \d{3,4}(?!\w)",
    r"(?<![\w.-])\d{3}-\d{3}-\d{4}(?![\w-])",
)
PHONES_SIGN = (
    r"(?<![\w+])\+(?=(?:[ .()-]*\d){9})\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,5}){2,6}(?![\w])",
    r"(?<![\w(])\(\d{2,5}\) ?\d{3,4}[ -]\d{3,4}(?!\w)",
)
IDENTITIES_DIGIT = (
    r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    r"(?<![\w-])(?<!\d )\d{3} \d{2} \d{4}(?![\w-])(?! \d)",
    rf"(?<![\w-])\d{{2}}{_MMDD}-\d{{4}}(?![\w-])",
    r"(?<![\w.-])\d{2}(?:[02468][1-9]|[13579][0-2])(?:0[1-9]|[12]\d|3[01])\d{5}(?![\w.-])",
)
IDENTITIES_CAPITAL = (
    r"(?<!\w)[A-CEGHJ-PQR-TW-Z][A-CEGHJ-NPQ-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)",
    r"(?<!\w)[XYZ]\d{7}[A-Z](?!\w)",
)
ADDRESSES_DIGIT = (
    rf"(?<![\w.])\d{{1,4}}[a-z]?,? {FRENCH_STREETS}(?: (?:de la|de l['’]|de|du|des|d['’]))? ?{_U}[\p{{L}}'’-]*(?:[ -]{_U}[\p{{L}}'’-]*)*",
    rf"(?<![\w.])\d{{1,4}}[a-z]?,? (?:{_U}[\p{{L}}'’-]*\.? ){{1,3}}{STREET_ENDS}(?![\p{{L}}])",
)
ADDRESSES_CAPITAL = (
    rf"(?<![\p{{L}}]){_U}[\p{{L}}-]*{GERMAN_ENDS} \d{{1,4}}[a-z]?(?!\w)",
    rf"(?<![\p{{L}}]){_U}[\p{{L}}-]* (?:Straße|Str\.|Weg|Gasse|Allee|Platz|Ring) \d{{1,4}}[a-z]?(?!\w)",
    rf"(?<![\p{{L}}]){GERMAN_STARTS} {_U}[\p{{L}}-]* \d{{1,4}}[a-z]?(?!\w)",
)
IDENTITIES = "|".join((*IDENTITIES_DIGIT, *IDENTITIES_CAPITAL))


def _any(*patterns: str) -> str:
    return "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


#: What a mention begins with is looked at first, so that only the patterns that begin so are tried, and none within a word.
WITHOUT_EMAILS = "|".join((
    r"(?<!\w)(?=\d)" + _any(*ADDRESSES_DIGIT, *IDENTITIES_DIGIT, *PHONES_DIGIT),
    r"(?<!\w)(?=[+(])" + _any(*PHONES_SIGN),
    r"(?<!\p{L})(?=\p{Lu})" + _any(*ADDRESSES_CAPITAL, *IDENTITIES_CAPITAL, NAMES),
))
MENTIONS = f"(?:{EMAILS})|{WITHOUT_EMAILS}"
AT = r"@|%40|&#64;|[(\[]at[)\]]"


class Pseudonyms:
    """Keyed permutations of numbers within their format; see above. Each turns into its inverse with `back`."""

    def __init__(self, key: str) -> None:
        if not key:
            raise ValueError("pseudonyms need a key")
        self.key = hashlib.sha256(key.encode()).digest()

    def _hash(self, *parts: object) -> int:
        return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), key=self.key, digest_size=8).digest(), "big")

    def tag(self, text: str) -> str:
        return f"{self._hash('tag', text.lower()) & 0xFFFFFFFF:08x}"

    def feistel(self, a: int, b: int, m: int, n: int, tag: str, back: bool = False) -> tuple[int, int]:
        """A permutation of the pairs (a, b) with a < m and b < n."""
        sign = -1 if back else 1
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if k % 2:
                b = (b + sign * self._hash(tag, n, k, a)) % n
            else:
                a = (a + sign * self._hash(tag, m, k, b)) % m
        return a, b

    def digits(self, s: str, back: bool = False) -> str:
        """A permutation of the digit strings of a length, in pieces of eighteen where they are longer."""
        out = []
        for i in range(0, len(s), 18):
            d = s[i : i + 18]
            left = len(d) // 2
            a, b = self.feistel(int(d[:left] or 0), int(d[left:]), 10**left, 10 ** (len(d) - left), f"digits {i} {len(d)}", back)
            out.append((f"{a:0{left}d}" if left else "") + f"{b:0{len(d) - left}d}")
        return "".join(out)

    def in_format(self, text: str, back: bool = False) -> str:
        """The text with its digits permuted and all else in place."""
        return filled(text, self.digits(only_digits(text), back))

    def phone(self, text: str, back: bool = False) -> str:
        if (m := PREFIX.match(text)) is not None:
            return text[: m.end()] + self.in_format(text[m.end() :], back)
        # Without a country code the zeros before an area stay, and the first digit after them stays another than zero.
        d = only_digits(text)
        rest = d.lstrip("0")
        if not rest:
            return text
        left, right = max(1, len(rest) // 2), len(rest) - max(1, len(rest) // 2)
        least = 10 ** (left - 1)
        a, b = self.feistel(int(rest[:left]) - least, int(rest[left:] or 0), 9 * least, 10**right, f"phone {len(rest)}", back)
        return filled(text, d[: len(d) - len(rest)] + str(a + least) + (f"{b:0{right}d}" if right else ""))

    def identity(self, text: str, back: bool = False) -> str:
        """Each kind of number is permuted among its own kind: those with an existing date, those whose check holds, and others."""
        d = only_digits(text)
        if re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}", text):
            # Areas 001 to 899 but 666, groups from 01, serials from 0001; numbers of the nine hundreds and impossible ones stay such.
            area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
            if area >= 900:
                a, b = self.feistel((area - 900) * 100 + group, serial, 10_000, 10_000, "900", back)
                return filled(text, f"9{a:04d}{b:04d}")
            if area in (0, 666):
                a, b = self.feistel(group, serial, 100, 10_000, f"area {area}", back)
                return filled(text, f"{area:03d}{a:02d}{b:04d}")
            at = area - 1 - (area > 666)
            if not group:
                at, b = self.feistel(at, serial, 898, 10_000, "no group", back)
            elif not serial:
                at, b = self.feistel(at, group - 1, 898, 99, "no serial", back)
                group, b = b + 1, 0
            else:
                a, b = self.feistel(at * 99 + group - 1, serial - 1, 898 * 99, 9999, "social", back)
                at, group, b = a // 99, a % 99 + 1, b + 1
            return filled(text, f"{at + 1 + (at >= 665):03d}{group:02d}{b:04d}")
        for form, serials, check in ((PERSONNUMMER, 3, luhn), (PESEL, 4, pesel)):
            if form.fullmatch(text):
                if (dated := date_of(d, form)) is None:  # a date that doesn't exist stays as it is
                    return filled(text, d[:6] + self.digits(d[6:], back))
                first, days, span = dated
                body, number = d[: 6 + serials], int(d[6 : 6 + serials])
                off = (int(d[-1]) - check(body)) % 10  # how far the check digit is from the right one
                if off == 0:
                    a, b = self.feistel(days, number, span, 10**serials, f"dated {first}", back)
                else:
                    a, b = self.feistel(days, number * 9 + off - 1, span, 9 * 10**serials, f"dated {first} off", back)
                    b, off = b // 9, b % 9 + 1
                day = first + dt.timedelta(days=a)
                month = day.month + (int(d[2:4]) // 20 * 20 if form is PESEL else 0)
                body = f"{day.year % 100:02d}{month:02d}{day.day:02d}{b:0{serials}d}"
                return filled(text, f"{body}{(check(body) + off) % 10}")
        if NIE.fullmatch(text):
            if text[-1] not in NIE_LETTERS:
                return text[0] + self.digits(d, back) + text[-1]
            off = (NIE_LETTERS.index(text[-1]) - NIE_LETTERS.index(nie(text[:-1]))) % 23
            many = max(off and 22, 1)
            a, b = self.feistel(int(d[:4]), int(d[4:]) * many + max(off - 1, 0), 10**4, 10**3 * many, f"nie {many}", back)
            new = f"{text[0]}{a:04d}{b // many:03d}"
            return new + NIE_LETTERS[(NIE_LETTERS.index(nie(new)) + (b % many + 1 if off else 0)) % 23]
        return self.in_format(text, back)

    def of(self, kind: str, text: str, back: bool = False) -> str | None:
        """The pseudonym of a mention, or the number of a pseudonym. Tags of names, addresses and e-mails can't be turned back."""
        if kind == "phone":
            return self.phone(text, back)
        if kind == "identity":
            return self.identity(text, back)
        return None if back else self.tag(text)


def only_digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def filled(text: str, digits: str) -> str:
    """The text with other digits in the places of its own."""
    rest = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(rest), text)


#: The country code of a telephone number.
PREFIX = re.compile(r"\+\d{1,3}(?=[ .(-])|\+\d{2}|00\d{2}")
PERSONNUMMER, PESEL, NIE = re.compile(r"\d{6}-\d{4}"), re.compile(r"\d{11}"), re.compile(r"[XYZ]\d{7}[A-Z]")

# The weights and letters by which identity numbers are checked.
LUHN_WEIGHTS, PESEL_WEIGHTS = (2, 1, 2, 1, 2, 1, 2, 1, 2), (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)
NIE_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
PESEL_CENTURIES = (1900, 2000, 2100, 2200, 1800)


def luhn(body: str) -> int:
    terms = [int(c) * w for c, w in zip(body, LUHN_WEIGHTS, strict=True)]
    return -sum(t // 10 + t % 10 for t in terms) % 10


def pesel(body: str) -> int:
    return -sum(int(c) * w for c, w in zip(body, PESEL_WEIGHTS, strict=True)) % 10


def nie(body: str) -> str:
    return NIE_LETTERS[int(str("XYZ".index(body[0])) + body[1:]) % 23]


def date_of(d: str, form: re.Pattern) -> tuple[dt.date, int, int] | None:
    """The first day of a birth date's century, the days since and the days in it; None if there is no such date."""
    month = int(d[2:4])
    first = dt.date(PESEL_CENTURIES[month // 20] if form is PESEL else 2000, 1, 1)
    try:
        day = dt.date(first.year + int(d[:2]), month % 20 if form is PESEL else month, int(d[4:6]))
    except ValueError:
        return None
    return first, (day - first).days, (dt.date(first.year + 100, 1, 1) - first).days


def is_valid(text: str) -> bool | None:
    """Whether an identity number's date and check digit or letter hold; None where its form has neither."""
    d = only_digits(text)
    for form, check in ((PERSONNUMMER, luhn), (PESEL, pesel)):
        if form.fullmatch(text):
            return date_of(d, form) is not None and check(d[:-1]) == int(d[-1])
    return nie(text[:-1]) == text[-1] if NIE.fullmatch(text) else None


def pseudonym_of(key: str):
    """A column function of (type, text): the pseudonym, what it turns back to, and whether the number is valid."""
    Pseudonyms(key)

    @F.pandas_udf(T.StructType([T.StructField("pseudonym", T.StringType()), T.StructField("back", T.StringType()), T.StructField("valid", T.BooleanType())]))
    def run(kinds, texts):
        import pandas as pd

        p = Pseudonyms(key)
        made = [p.of(k, t) for k, t in zip(kinds, texts, strict=True)]
        return pd.DataFrame({
            "pseudonym": made, "back": [p.of(k, m, True) for k, m in zip(kinds, made, strict=True)], "valid": pd.Series([is_valid(t) if k == "identity" else None for k, t in zip(kinds, texts, strict=True)], dtype=object),
        })

    return run


def placeholders_of(key: str):
    """A column function of arrays of types and texts: the placeholders."""
    Pseudonyms(key)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(kinds, texts):
        p = Pseudonyms(key)
        return kinds.combine(texts, lambda ks, ts: [f"[{k.upper()} {p.of(k, t)}]" for k, t in zip(ks, ts, strict=True)])

    return run


def kind_of(text: Column) -> Column:
    """The type of a mention, from its own form: the patterns don't share forms."""
    return (
        F.when(text.rlike(AT), "email")
        .when(~text.rlike(r"\d"), "name")
        .when(text.rlike(rf"^(?:{IDENTITIES})$"), "identity")
        .when(text.rlike(r"\p{L}{2,}"), "address")
        .otherwise("phone")
    )


def _each(content: Column, make) -> Column:
    """`make` of the pattern for the line. That of e-mails starts at every word, so it is left out of lines that can't have one."""
    return F.when(content.rlike(AT), make(MENTIONS)).otherwise(make(WITHOUT_EMAILS))


def texts_of(content: Column) -> Column:
    """The mentions in order, found in one pass from the left; none overlaps another."""
    return _each(content, lambda p: F.regexp_extract_all(content, F.lit(p), F.lit(0)))


def mentions(content: Column) -> Column:
    """Distinct mentions as an array of (pii_type, pii_text), without names that nothing introduces."""
    return F.transform(F.array_distinct(texts_of(content)), lambda t: F.struct(kind_of(t).alias("pii_type"), t.alias("pii_text")))


def pairs_of(content: Column) -> Column:
    """Distinct pairs of capitalised words that may be names, those that share a word included."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(PAIRED), F.lit(1)))


def name_parts(name: Column) -> Column:
    """(given, surname) of a name; initials are no given names."""
    turned = name.contains(",")
    first, last = F.substring_index(F.substring_index(name, ",", -1).substr(F.lit(2), F.length(name)), " ", 1), F.substring_index(name, ",", 1)
    given = F.when(turned, first).otherwise(F.substring_index(name, " ", 1))
    return F.struct(F.when(~given.contains("."), given).alias("given"), F.when(turned, last).otherwise(F.substring_index(name, " ", -1)).alias("surname"))


def uncued(found: DataFrame) -> DataFrame:
    """Of entries with mentions and pairs: entry_id and pii_text of the pairs that are names by the parts of cued ones."""
    cued = found.select("entry_id", F.explode("mentions").alias("m")).where("m.pii_type = 'name'").select("entry_id", name_parts(F.col("m.pii_text")).alias("p"))
    parts = cued.select("entry_id", F.explode(F.array(F.struct(F.lit("given").alias("role"), F.col("p.given").alias("part")), F.struct(F.lit("surname").alias("role"), F.col("p.surname").alias("part")))).alias("x"))
    # Sums by part; entries delivered twice count twice, here and only here.
    known = parts.groupBy("x.role", "x.part").agg(F.count(F.lit(1)).alias("n")).where(f"part is not null and (role = 'surname' or n >= {KNOWN})")
    pairs = found.select("entry_id", F.explode("pairs").alias("pii_text"))
    split = pairs.select("pii_text").distinct().withColumn("p", name_parts(F.col("pii_text"))).select("pii_text", "p.*")
    named = split.join(known.where("role = 'given'").select(F.col("part").alias("given")), "given", "left_semi").join(known.where("role = 'surname'").select(F.col("part").alias("surname")), "surname", "left_semi")
    return pairs.join(named.select("pii_text"), "pii_text", "left_semi").select("entry_id", "pii_text").distinct()


def find(entries: DataFrame, content: str = "content") -> DataFrame:
    """entry_id, mentions and pairs of the entries that have any, kept in a table, so that texts are read once. Pairs that share words
    with a mention are none."""
    c = F.col(content)
    held = materialise(entries.select("entry_id", mentions(c).alias("mentions"), pairs_of(c).alias("pairs")).where((F.size("mentions") > 0) | (F.size("pairs") > 0)))
    words = lambda s: F.split(F.regexp_replace(s, ",", ""), " ")
    free = F.filter("pairs", lambda p: ~F.exists("mentions", lambda m: F.arrays_overlap(words(p), words(m["pii_text"]))))
    return held.withColumn("pairs", free)


def redact(entries: DataFrame, key: str, content: str = "content") -> DataFrame:
    """The entries with a placeholder in the place of every mention, and all else as it was."""
    c = F.col(content)
    held = find(entries, content)
    cued = held.select("entry_id", F.explode("mentions").alias("m")).where("m.pii_type = 'name'").select("entry_id", "m.pii_text")
    names = uncued(held).unionByName(cued).groupBy("entry_id").agg(F.array_sort(F.collect_set("pii_text")).alias("_names"))  # the names of one entry
    cut = entries.join(names, "entry_id", "left").withColumns({"_texts": texts_of(c), "_pieces": _each(c, lambda p: F.split(c, p))})
    make, none = placeholders_of(key), F.array().cast("array<string>")
    shown = cut.withColumns({"_texts": F.coalesce("_texts", none), "_names": F.coalesce("_names", none)}).withColumns({"_put": make(F.transform("_texts", kind_of), F.col("_texts")), "_named": make(F.transform("_names", lambda n: F.lit("name")), F.col("_names"))})

    def rebuilt(pieces: Column, between: Column) -> Column:
        """Pieces and what stands between them, turn by turn."""
        return F.array_join(F.zip_with(pieces, F.concat(between, F.array(F.lit(""))), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")

    def within(piece: Column) -> Column:
        """The piece without the entry's names, wherever they stand as whole words."""
        start = F.struct(piece.alias("s"), F.lit(1).alias("i"))
        put = lambda x, n: F.struct(F.regexp_replace(x["s"], F.concat(F.lit(_AROUND[0] + "\\Q"), n, F.lit("\\E" + _AROUND[1])), F.element_at("_named", x["i"])).alias("s"), (x["i"] + 1).alias("i"))
        return F.aggregate("_names", start, put, lambda x: x["s"])

    text = F.when((F.size("_texts") > 0) | (F.size("_names") > 0), rebuilt(F.transform("_pieces", within), F.col("_put"))).otherwise(c)
    return shown.withColumn(content, text).select(*entries.columns)


def found_rows(entries: DataFrame, key: str) -> DataFrame:
    """entry_id, pii_type, pii_text, pseudonym, valid: the distinct mentions. A number is given by its pseudonym, which is turned back
    and must be the text that was found."""
    held = find(entries.select("entry_id", "content"))
    cued = held.select("entry_id", F.explode("mentions").alias("m")).select("entry_id", "m.*").distinct()
    rows = cued.unionByName(uncued(held).select("entry_id", F.lit("name").alias("pii_type"), "pii_text")).distinct()
    made = rows.withColumn("made", pseudonym_of(key)("pii_type", "pii_text"))
    return made.where(F.col("made.back").isNull() | (F.col("made.back") == F.col("pii_text"))).select("entry_id", "pii_type", "pii_text", "made.pseudonym", "made.valid")
