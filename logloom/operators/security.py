"""Attack and sensitive-data flags of a line. Each list of literals is one alternation, evaluated inside Spark's own codegen."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import NamedPattern, Security
from ..functions.patterns import translate

# The literals of each attack, matched anywhere without regard to ASCII case, and the patterns of failed
# authentication and built-in sensitive data.
SQL_INJECTION = (
    "union select", "union all select", "' --", "' #", "'; --", "' or '1'='1", "' or 1=1", "' or ''='", "or 1=1--", "' or 'a'='a", "1=1", "1' or '1'='1",
    "; drop table", "; delete from", "; insert into", "; update ", "information_schema", "table_name", "column_name", "load_file(", "into outfile",
    "into dumpfile", "char(", "concat(", "benchmark(", "sleep(", "waitfor delay", "/**/", "%27", "%22",
)
XSS = (
    "<script", "</script>", "javascript:", "vbscript:", "onerror=", "onload=", "onclick=", "onmouseover=", "onfocus=", "onblur=", "onchange=", "onsubmit=", "onkeyup=", "onkeydown=",
    "data:text/html", "data:application/javascript", "expression(", "eval(", "<iframe", "<object", "<embed", "<img src=", "<svg", "document.cookie", "document.location",
    "document.write", "window.location", ".innerHTML", "&#x3c;script", "&#60;script", "%3cscript", "\\x3cscript",
)
PATH_TRAVERSAL = (
    "../", "..\\", "..\\/", "..%2f", "..%5c", "%2e%2e/", "%2e%2e\\", "..%c0%af", "..%c1%9c", "/etc/passwd", "/etc/shadow", "/etc/hosts", "/proc/self", "/var/log",
    "\\windows\\system32", "\\boot.ini", "\\win.ini", "web.config", ".htaccess", ".htpasswd", "%00", "\0",
)
AUTH_FAILURE = r"(?i)(authentication\s+fail|auth\s+fail|login\s+fail|invalid\s+(password|credential|token|api.?key)|unauthorized|access\s+denied|permission\s+denied|forbidden|401\s+unauthorized|403\s+forbidden|invalid\s+user|unknown\s+user|bad\s+password|wrong\s+password|incorrect\s+password|password\s+incorrect|failed\s+login|login\s+attempt|brute\s*force|too\s+many\s+attempts|account\s+locked|session\s+expired|token\s+expired|jwt\s+expired)"
CARD = r"\b(?:\d{4}[-\s]?){3}\d{1,4}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
SECRET = r"(?i)(api[_-]?key|api[_-]?secret|access[_-]?token|auth[_-]?token|bearer|private[_-]?key|secret[_-]?key)\s*[=:]\s*['\"]?([a-zA-Z0-9_-]{20,})['\"]?"
PASSWORD = r"(?i)(password|passwd|pwd)\s*[=:]\s*['\"]?([^\s'\"]+)['\"]?"

#: Flag names and how they read in text output and metric labels.
NAMES = {"sql_injection": "SqlInjection", "xss": "Xss", "path_traversal": "PathTraversal", "auth_failure": "AuthFailure", "sensitive_data": "SensitiveData"}


def quoted(literal: str) -> str:
    """A literal as a pattern that Java and RE2 read alike."""
    return re.sub(r"([\\.+*?()\[\]{}|^$/#&-])", r"\\\1", literal).replace("\\/", "/").replace("\\#", "#").replace("\\&", "&").replace("\\-", "-").replace("\0", r"\x00")


def any_of(literals: Iterable[str]) -> str:
    return "(?i)(?:" + "|".join(map(quoted, literals)) + ")"


SQL_INJECTION_RE, XSS_RE, PATH_RE = any_of(SQL_INJECTION), any_of(XSS), any_of(PATH_TRAVERSAL)


def has_pii(content: Column) -> Column:
    return content.rlike(SSN) | content.rlike(CARD) | content.rlike(PASSWORD) | content.rlike(SECRET)


def sensitive_names(content: Column, patterns: Iterable[NamedPattern] = ()) -> Column:
    """`pii` and then the names of the custom patterns that match, in their order."""
    known = [(p.name, t.text) for p in patterns if (t := translate(p.pattern)) is not None]
    return F.array_compact(F.array(F.when(has_pii(content), "pii"), *[F.when(content.rlike(t), n) for n, t in known]))


def flags_of(content: Column, config: Security | None = None) -> Column:
    """The flags in fixed order: SQL injection, script injection, path traversal, failed authentication, sensitive data."""
    c = config or Security(enabled=True)
    plain = [
        (c.detect_sql_injection, SQL_INJECTION_RE, "sql_injection"), (c.detect_xss, XSS_RE, "xss"),
        (c.detect_path_traversal, PATH_RE, "path_traversal"), (c.detect_auth_failures, AUTH_FAILURE, "auth_failure"),
    ]
    flag = lambda name, pattern: F.struct(F.lit(name).alias("flag"), pattern.alias("pattern_name"))
    none = F.lit(None).cast("string")
    found = [F.when(content.rlike(r), flag(n, none)) for on, r, n in plain if on]
    kind = "array<struct<flag:string,pattern_name:string>>"
    first = F.array_compact(F.array(*found)).cast(kind) if found else F.array().cast(kind)
    return F.coalesce(F.concat(first, F.transform(sensitive_names(content, c.sensitive_patterns), lambda n: flag("sensitive_data", n)).cast(kind)), F.array().cast(kind))


def debug_name(flag: Column) -> Column:
    """The flag as text output and metric labels write it."""
    table = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    plain = F.try_element_at(table, flag["flag"])
    return F.when(flag["flag"] == "sensitive_data", F.concat(F.lit('SensitiveData { pattern_name: "'), flag["pattern_name"], F.lit('" }'))).otherwise(plain)


def with_security_flags(df: DataFrame, config: Security | None = None, content: str = "content") -> DataFrame:
    return df.withColumn("security_flags", flags_of(F.col(content), config))
