"""Log records out of physical lines of any layout (problem 3), by mining templates with longest common subsequences.

1. Every line is written as its *shape*: stamps, levels, priorities, numbers, words, dotted names, quoted text and the keys of
   JSON or key=value pairs become typed tokens, all else stays. Shapes repeat, so they are counted first (on the map side).
2. Each partition clusters its shapes: a shape joins the template of its leading tokens with which it shares the longest common
   subsequence, half of the shorter one at least. The common subsequence is the template's constant part, and what lies between
   its tokens are variable slots. The templates of all partitions, a few dozen a partition, are merged the same way.
3. The head of a template are its constants, those of the common subsequence, and the slots between them, as far as nearly all lines
   agree; lines that begin otherwise have heads of their own, so a rare line can't shorten that of the others. Slots of the head are classified by type: the stamp,
   the level (word, letter or syslog priority), and as component the last name before the message. A template whose head has a
   level or stamp and a component begins a record; all others are continuations.
4. Heads become patterns, applied by Spark to every line. Records of a file are delimited by the next head, found within blocks
   of lines and across them from one row a block, so that a file with a third of all lines is never in one task.

Defined cases: a line delivered twice is one line; null content is an empty line and so a continuation; lines before a file's
first record belong to none; fields that the layout lacks are empty strings; trailing blanks are dropped; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entries import source_key
from ..session import materialise

BLOCK = 8192

# Month names, level words with the level they stand for, level letters, syslog severities.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
LEVELS = {
    "TRACE": "TRACE", "DEBUG": "DEBUG", "INFO": "INFO", "NOTICE": "INFO", "WARN": "WARN", "WARNING": "WARN", "ERR": "ERROR", "ERROR": "ERROR", "SEVERE": "ERROR",
    "FATAL": "FATAL", "CRIT": "FATAL", "CRITICAL": "FATAL", "ALERT": "FATAL", "EMERG": "FATAL",
    "T": "TRACE", "D": "DEBUG", "I": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL", "C": "FATAL",
}
SEVERITIES = {0: "FATAL", 1: "FATAL", 2: "FATAL", 3: "ERROR", 4: "WARN", 5: "INFO", 6: "INFO", 7: "DEBUG"}

STAMPS = (
    r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?: ?(?:Z|[+-]\d{2}:?\d{2})\b)?",
    r"\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}(?:[.,]\d+)?",
    r"\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}(?: [+-]\d{4})?",
    r"[A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2}",
    r"(?<!\d)\d{10}\.\d{3,6}(?!\d)",
)
COMPACT = r"\d{4} \d{2}:\d{2}:\d{2}\.\d+"  # month and day in four digits, after a level letter
STAMP = "|".join((*STAMPS, rf"(?<=[TDIWEFC]){COMPACT}"))
WORDS = "|".join(sorted((w for w in LEVELS if len(w) > 1), key=len, reverse=True))
NAME = r"[A-Za-z_]\w*(?:(?:\.|::)[A-Za-z_]\w*)*"

# Typed tokens of a shape.
STAMP_T, LEVEL_T, LETTER_T, PRIORITY_T, NUMBER_T, WORD_T, NAME_T, QUOTED_T = "ⓉⓁⓖⓟⓝⓦⓘⓠ"
SLOTS = frozenset((STAMP_T, LEVEL_T, LETTER_T, PRIORITY_T, NUMBER_T, WORD_T, NAME_T, QUOTED_T, " "))


def shape(content: Column) -> Column:
    """The line with its variable parts as typed tokens."""
    s = F.regexp_replace(F.coalesce(content.cast("string"), F.lit("")), r"\s+$", "")
    steps = (
        (rf"^[TDIWEFC](?={COMPACT} )", LETTER_T),
        (rf"^{LETTER_T}{COMPACT}", LETTER_T + STAMP_T),
        (r"^<\d{1,3}>", PRIORITY_T),
        ("|".join(STAMPS), STAMP_T),
        (r"(?<=<)[TDIWEFC](?=>)", LETTER_T),
        (rf"(?i)(?<![A-Za-z_.:/-])(?:{WORDS})(?![A-Za-z_./=-]|\s*\()", LEVEL_T),
        (r'"(\w+)":\s*', "$1="),
        (rf'(?<==)"({STAMP_T}|{LEVEL_T})"', "$1"),
        (r'(?<==)"[\w.:-]*"', WORD_T),
        (r'(?<==)"[^"]*"', QUOTED_T),
        (r"\[\d+\](?=:)", ""),  # a number of a process belongs to the name before it
        (r"(?<!\w)[A-Za-z_]\w*(?:(?:\.|::)[A-Za-z_]\w*)+", NAME_T),
        (r"(?<!\w)[A-Za-z_]\w*+(?!=)", WORD_T),
        (r"\d\w*", NUMBER_T),
        (r"\s+", " "),
    )
    for pattern, token in steps:
        s = F.regexp_replace(s, pattern, token)
    return s


def tokens(s: str) -> tuple[str, ...]:
    return tuple(re.findall(r"\w+=|\S| ", s))


#: Bits of a table of common subsequences that are held at once; longer lines are halved first.
TABLE_BITS = 1 << 27


def _rows(a: tuple[str, ...], b: tuple[str, ...], keep: bool) -> list[int]:
    """By token of `a` the bits of `b` at which the longest common subsequence doesn't grow (bit-parallel); the last row alone unless kept."""
    full = (1 << len(b)) - 1
    places: dict[str, int] = {}
    for j, t in enumerate(b):
        places[t] = places.get(t, 0) | 1 << j
    v, rows = full, []
    for t in a:
        u = v & places.get(t, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            rows.append(v)
    return rows if keep else [v]


def common_length(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    return len(b) - _rows(a, b, False)[0].bit_count() if a and b else 0


def common(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    """A longest common subsequence, in space that is bounded for lines of any length."""
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    head, a, b = a[:k], a[k:], b[k:]
    if not a or not b:
        return head
    if len(a) > 1 and len(a) * len(b) > TABLE_BITS:
        # The half of `a` goes with that part of `b` with which both sides have most in common.
        half = len(a) // 2
        left, right = _rows(a[:half], b, False)[0], _rows(a[half:][::-1], b[::-1], False)[0]
        best, at, n = -1, 0, len(b)
        behind = [0] * (n + 1)
        for j in range(n):
            behind[j + 1] = behind[j] + (not right >> j & 1)
        before = 0
        for j in range(n + 1):
            if before + behind[n - j] > best:
                best, at = before + behind[n - j], j
            if j < n:
                before += not left >> j & 1
        return head + common(a[:half], b[:at]) + common(a[half:], b[at:])
    rows, out, i, j = _rows(a, b, True), [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return head + tuple(reversed(out))


#: The beginning of a template: the share of its lines that have it, and the share that may have something else in its place.
#: Lines that end there, such as ones cut off, count for neither.
SUPPORT, OTHERS = 0.9, 0.01
END = "\n"  # after the last token of a line


def beginnings(begins: list[tuple[tuple, int]]) -> list[tuple[tuple, int]]:
    """What lines begin with, and how many: the longest prefix that nearly all of them have, then that of the rest, and so on, so
    that a rare line neither shortens the beginning of the others nor gets lost. Most lines first."""
    out = []
    while begins:
        here, rest, at, others, n = begins, [], 0, 0, sum(k for _, k in begins)
        while True:
            ahead: dict[str, int] = {}
            for b, k in here:
                if len(b) > at and b[at] != END:
                    ahead[b[at]] = ahead.get(b[at], 0) + k
            token = max(ahead, key=lambda t: (ahead[t], t), default=END)
            leave = [(b, k) for b, k in here if b[at : at + 1] != (token,)]
            others += sum(k for b, k in leave if END not in b[at : at + 2])
            if ahead.get(token, 0) < SUPPORT * n or others > OTHERS * n:
                break
            here, rest, at = [(b, k) for b, k in here if b[at : at + 1] == (token,)], rest + leave, at + 1
        out.append((here[0][0][:at], sum(k for _, k in here)))
        begins = rest
    return out


def pruned(begins: list[tuple[tuple, int]]) -> list[tuple[tuple, int]]:
    """The same counts in a bounded number of beginnings: what less than OTHERS of the lines have is cut where it parts from the rest,
    and still says whether the line ended there."""
    least = OTHERS * sum(k for _, k in begins)
    out: dict[tuple, int] = {}
    groups = [(begins, 0)]
    while groups:
        group, at = groups.pop()
        by_token: dict[tuple, list] = {}
        for b, k in group:
            by_token.setdefault(b[at : at + 1], []).append((b, k))
        for token, part in by_token.items():
            if token and sum(k for _, k in part) >= least:
                groups.append((part, at + 1))
                continue
            for b, k in part:
                kept = b[:at] + (END,) * (END in b[at : at + 2])
                out[kept] = out.get(kept, 0) + k
    return list(out.items())


LEAD = 6  # tokens that index the templates


def lead(t: tuple[str, ...]) -> tuple[str, ...]:
    """The first tokens without blanks: templates are looked up by them."""
    return tuple(x for x in t if x != " ")[: LEAD - 2]


def merge(found: list[tuple[tuple, list, int]], new: tuple[tuple, list, int], begin: tuple, by_lead: dict) -> None:
    """Add a template (constant part, counted beginnings, count) to the list, into the closest one if half of the shorter agrees. The
    constant part becomes what both have in common, unless the new lines are so few that they may as well be cut off or odd."""
    body, begins, n = new
    here = by_lead.setdefault(lead(begin), [])
    scored = [(common_length(found[i][0], body), i) for i in here]
    scored = [x for x in scored if 2 * x[0] >= min(len(body), len(found[x[1]][0]))]
    if scored:
        _, i = max(scored, key=lambda x: (x[0], -x[1]))
        known = found[i]
        known[1].extend(begins)
        found[i] = (known[0] if n < OTHERS * known[2] else common(known[0], body), known[1], known[2] + n)
    else:
        here.append(len(found))
        found.append(new)


def anchored(begin: tuple[str, ...], body: tuple[str, ...]) -> tuple[str, ...]:
    """A beginning up to its last constant of the template: its constants must be those of the common subsequence, in order; what lies
    between them are slots. A constant that isn't among them is no part of the template, so the head ends before it."""
    constants = [t for t in body if t not in SLOTS]
    at, end = 0, 0
    for i, t in enumerate(begin):
        if t in SLOTS:
            continue
        if at == len(constants) or constants[at] != t:
            break
        at, end = at + 1, i + 1 + (len(t) > 1 and t.endswith("="))  # a key goes with its slot
    return begin[: max(end, 1)] if end or begin[:1] and begin[0] in SLOTS else ()


def mine(lines: DataFrame) -> DataFrame:
    """Templates of the lines: body, the longest common subsequence of their shapes; begin, the constants and slots up to the last
    constant that the subsequence and nearly all lines share; and n. Lines of a template that begin otherwise than nearly all of it have
    rows of their own, marked as its rest."""
    shapes = lines.select(shape(F.col("content")).alias("shape")).groupBy("shape").agg(F.count(F.lit(1)).alias("n"))

    def cluster(rows):
        found: list = []
        by_lead: dict = {}
        for body, begin, begins, n in sorted(rows, key=lambda r: (-r[3], r[0])):
            merge(found, (body, begins, n), begin, by_lead)
        leads = {i: key for key, here in by_lead.items() for i in here}
        return [(leads[i], *template) for i, template in enumerate(found)]

    def partition(batches):
        import pandas as pd

        rows = [(t, t, [((*t, END), int(n))], int(n)) for pdf in batches for s, n in zip(pdf["shape"], pdf["n"], strict=True) if (t := tokens(s))]
        out = [(list(body), list(first), [list(b) for b, _ in kept], [k for _, k in kept], n) for first, body, begins, n in cluster(rows) if (kept := pruned(begins))]
        yield pd.DataFrame(out, columns=["body", "begin", "begins", "counts", "n"])

    def final(pdf):
        import pandas as pd

        columns = (pdf[c] for c in ("body", "begin", "begins", "counts", "n"))
        rows = [(tuple(body), tuple(begin), [(tuple(b), int(k)) for b, k in zip(begins, counts, strict=True)], int(n)) for body, begin, begins, counts, n in zip(*columns, strict=True)]
        out = []
        for _, body, begins, _ in cluster(rows):
            for i, (begin, k) in enumerate(beginnings(begins)):
                # The rest has constants of its own, so it isn't held against those of the others.
                out.append((list(body), list(anchored(begin, body) if i == 0 else begin), k, i > 0))
        return pd.DataFrame(out, columns=["body", "begin", "n", "rest"])

    # Shapes stay in the partitions they were counted in, by their hash, so that no beginning makes a task larger than others. What is
    # shuffled afterwards are the templates of each partition, by their first tokens.
    local = shapes.mapInPandas(partition, "body array<string>, begin array<string>, begins array<array<string>>, counts array<bigint>, n bigint")
    return local.groupBy(F.array_join("begin", "").alias("lead")).applyInPandas(final, "body array<string>, begin array<string>, n bigint, rest boolean")


@dataclass(frozen=True)
class Head:
    """A template that begins records: how to find its fields."""

    kind: str  # `text`, `json` or `pairs`
    pattern: str
    stamp: str  # a group number, a key, or nothing
    level: str
    component: str
    message: str
    level_kind: str  # `word` or `priority`


def classify(begin: tuple[str, ...]) -> Head | None:
    """The head of a template from the beginning common to its lines, or None if it doesn't begin records."""
    keyed = [(t[:-1], begin[i + 1]) for i, t in enumerate(begin[:-1]) if len(t) > 1 and t.endswith("=")]
    if keyed and (begin[0] == "{" or begin[0].endswith("=")):
        of = lambda *types: next((k for k, v in keyed if v in types), "")
        stamp, level, component, message = of(STAMP_T), of(LEVEL_T), of(WORD_T, NAME_T), of(QUOTED_T)
        if not (stamp or level):
            return None
        kind = "json" if begin[0] == "{" else "pairs"
        return Head(kind, r"^\{.*\}\s*$" if kind == "json" else rf"^{keyed[0][0]}=", stamp, level, component, message or "message", "word")
    if begin[0].endswith("=") or begin[0] in "{ ":
        return None
    cut = max((i for i, t in enumerate(begin) if t not in SLOTS), default=-1)
    head = begin[: cut + 1]
    groups: list[str] = []
    pattern, stamp, level, component, level_kind = "^", "", "", "", "word"
    for i, t in enumerate(head):
        group = None
        if t == STAMP_T:
            group = COMPACT if i and head[i - 1] == LETTER_T and not pattern.endswith(">") and "<" not in head else "|".join(STAMPS)
        elif t == LEVEL_T:
            group = f"(?i:{WORDS})"
        elif t == LETTER_T:
            group = "[TDIWEFC]"
        elif t == PRIORITY_T:
            group = r"\d{1,3}"
        elif t in (WORD_T, NAME_T):
            group = NAME
        if group is None:
            pattern += r"\d\w*" if t == NUMBER_T else r"\s+" if t == " " else re.escape(t)
            continue
        groups.append(t)
        pattern += rf"<({group})>" if t == PRIORITY_T else rf"({group})" + (r"(?:\[\d+\])?" if t in (WORD_T, NAME_T) else "")
        g = str(len(groups))
        if t == STAMP_T and not stamp:
            stamp = g
        elif t in (LEVEL_T, LETTER_T, PRIORITY_T) and not level:
            level, level_kind = g, "priority" if t == PRIORITY_T else "word"
        elif t in (WORD_T, NAME_T):
            component = g
    if not component or not (stamp or level) or head[0] not in (STAMP_T, LEVEL_T, LETTER_T, PRIORITY_T, "[", "<", "("):
        return None
    return Head("text", pattern + r"\s*(.*)$", stamp, level, component, str(len(groups) + 1), level_kind)


def heads_of(templates: DataFrame) -> list[Head]:
    """The record heads, longest pattern first, and after them those of the templates' rests. Templates are a model of a few dozen
    rows, whatever the number of lines."""
    found: dict[Head, bool] = {}
    for r in templates.select("begin", "rest").collect():
        if r["begin"] and (h := classify(tuple(r["begin"]))) is not None:
            found[h] = found.get(h, True) and r["rest"]
    return sorted(found, key=lambda h: (found[h], h.kind != "json", -len(h.pattern), h.pattern))


def _level(raw: Column, kind: str) -> Column:
    if kind == "priority":
        table = F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])
        return F.try_element_at(table, F.pmod(raw.try_cast("int"), F.lit(8)))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.upper(raw))


def _fields(c: Column, h: Head) -> Column:
    if h.kind == "text":
        get = lambda g: F.regexp_extract(c, h.pattern, int(g)) if g else F.lit("")
    elif h.kind == "json":
        get = lambda k: F.get_json_object(c, f"$.{k}") if k else F.lit("")
    else:
        get = lambda k: F.regexp_replace(F.regexp_extract(c, rf'(?:^|\s){k}=("(?:[^"\\]|\\.)*"|\S*)', 1), r'^"|"$', "") if k else F.lit("")
    return F.struct(get(h.stamp).alias("stamp"), F.coalesce(_level(get(h.level), h.level_kind), F.lit("")).alias("level"), get(h.component).alias("component"), get(h.message).alias("message"))


def parse(content: Column, heads: list[Head]) -> Column:
    """The fields of the first head that fits, else null."""
    c = F.regexp_replace(content, r"\s+$", "")
    out = F.lit(None).cast("struct<stamp:string,level:string,component:string,message:string>")
    for h in reversed(heads):
        fits = c.rlike(h.pattern)
        if h.kind == "json":
            fits = fits & F.coalesce(F.get_json_object(c, f"$.{h.stamp or h.level}"), F.lit("")).rlike("^(?:" + "|".join(STAMPS) + f")$|^(?i:{WORDS})$")
        elif h.kind == "pairs":
            fits = fits & c.rlike(rf"(?:^|\s){h.stamp or h.level}=") & c.rlike(rf"(?:^|\s){h.message}=")
        out = F.when(fits, _fields(c, h)).otherwise(out)
    return out


def plain_stamp(stamp: Column, received: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss` as written; epoch seconds in UTC; a missing year from the time of receipt."""
    month = lambda m: F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), m).cast("string"), 2, "0")
    iso = F.concat(F.regexp_replace(F.substring(stamp, 1, 10), "/", "-"), F.lit(" "), F.substring(stamp, 12, 8))
    access = F.concat(F.substring(stamp, 8, 4), F.lit("-"), month(F.substring(stamp, 4, 3)), F.lit("-"), F.substring(stamp, 1, 2), F.lit(" "), F.substring(stamp, 13, 8))
    epoch = F.date_format(F.timestamp_seconds(F.regexp_extract(stamp, r"^(\d{10})", 1).try_cast("bigint")), "yyyy-MM-dd HH:mm:ss")
    syslog = F.concat(month(F.substring(stamp, 1, 3)), F.lit("-"), F.lpad(F.regexp_extract(stamp, r"^\w{3} +(\d+)", 1), 2, "0"), F.lit(" "), F.regexp_extract(stamp, r"(\d{2}:\d{2}:\d{2})$", 1))
    compact = F.concat(F.substring(stamp, 1, 2), F.lit("-"), F.substring(stamp, 3, 2), F.lit(" "), F.substring(stamp, 6, 8))
    def dated(short: Column) -> Column:
        year = F.year(received) + F.when((F.month(received) == 1) & short.startswith("12"), -1).when((F.month(received) == 12) & short.startswith("01"), 1).otherwise(0)
        return F.concat(year.cast("string"), F.lit("-"), short)

    return F.coalesce(
        F.when(stamp.rlike(r"^\d{4}[-/]"), iso).when(stamp.rlike(r"^\d{2}/[A-Z]"), access).when(stamp.rlike(r"^\d{10}"), epoch).when(stamp.rlike(r"^[A-Z][a-z]{2} "), dated(syslog)).when(stamp.rlike(r"^\d{4} "), dated(compact)),
        F.lit(""),
    )


def last_before(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """`out`: the latest non-null `value` at or before each row of a key, within blocks and carried over from earlier ones."""
    blocked = df.withColumn("_block", F.floor(F.col(order) / BLOCK))
    per = blocked.groupBy(key, "_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    carried = per.select(key, "_block", F.last("_last", ignorenulls=True).over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    here = F.last(value, ignorenulls=True).over(Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return blocked.join(carried, [key, "_block"]).withColumn(out, F.coalesce(here, "_carry")).drop("_block", "_carry")


def next_after(df: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """`out`: the next greater `order` of the key, within blocks and from later ones."""
    blocked = df.withColumn("_block", F.floor(F.col(order) / BLOCK))
    per = blocked.groupBy(key, "_block").agg(F.min(order).alias("_first"))
    later = per.select(key, "_block", F.lead("_first").over(Window.partitionBy(key).orderBy("_block")).alias("_later"))
    here = F.lead(order).over(Window.partitionBy(key, "_block").orderBy(order))
    return blocked.join(later, [key, "_block"]).withColumn(out, F.coalesce(here, "_later")).drop("_block", "_later")


def records(lines: DataFrame) -> DataFrame:
    """Of file_lines: one row a record with line_id, n_lines, stamp, log_level, component, message."""
    flat = lines.select(source_key("source").alias("file"), F.col("line_no").cast("bigint").alias("line_no"), "line_id", "received_at", F.coalesce("content", F.lit("")).alias("content")).dropDuplicates(["file", "line_no"])
    heads = heads_of(mine(lines))
    parsed = materialise(flat.withColumn("f", parse(F.col("content"), heads)))

    # Objects printed over several lines: a lone brace whose next line gives the stamp. Their lines are put together again.
    stamped = parsed.where(F.col("content").rlike(r'^\s+"\w+":\s*"(?:' + "|".join(STAMPS) + r')",?\s*$')).select("file", (F.col("line_no") - 1).alias("line_no"))
    opened = parsed.where(F.col("content").rlike(r"^\{\s*$")).join(stamped, ["file", "line_no"], "left_semi").select("file", "line_no", F.col("line_no").alias("begins"))
    pieces = parsed.where(F.col("content").rlike(r"^(?:\s|\{\s*$|\}\s*$)")).select("file", "line_no", "content").join(opened, ["file", "line_no"], "left")
    owned = last_before(pieces.withColumn("ends", F.when(F.col("content").rlike(r"^\}\s*$"), F.col("line_no"))), "file", "line_no", "begins", "of").where("of is not null")
    ends = owned.groupBy("file", "of").agg(F.min("ends").alias("end"))
    whole = owned.join(ends, ["file", "of"]).where("line_no <= end").groupBy("file", "of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "content"))), lambda x: x["content"]), " ").alias("object"))
    objects = whole.select("file", F.col("of").alias("line_no"), parse(F.col("object"), [h for h in heads if h.kind == "json"]).alias("g")).where("g is not null")

    begun = parsed.join(objects, ["file", "line_no"], "left").withColumn("f", F.coalesce("f", "g")).where("f is not null").drop("g", "content")
    sized = next_after(begun, "file", "line_no", "next").join(parsed.groupBy("file").agg(F.max("line_no").alias("last")), "file")
    return sized.select(
        "line_id", (F.coalesce("next", F.col("last") + 1) - F.col("line_no")).cast("bigint").alias("n_lines"), plain_stamp(F.col("f.stamp"), F.col("received_at")).alias("stamp"),
        F.col("f.level").alias("log_level"), F.coalesce("f.component", F.lit("")).alias("component"), F.regexp_replace(F.coalesce("f.message", F.lit("")), r"\s+$", "").alias("message"),
    )
