"""Redaction of secrets and personal data: ordered rules as native expressions; only URLs are rewritten in Python.

Rules apply in order, each to what the earlier ones left.  `with_redactions` carries the
text and each rule's count from rule to rule in the JVM, every rule behind a literal that its
matches can't do without; rows that may hold a URL with a query, and only these, then pass an
Arrow UDF.  `detections` finds places from the pieces between matches and running sums, without
Python.  `redact_text` and `detect_text` are the same rules for single texts on the driver.
"""

from __future__ import annotations

import ipaddress
import re
from functools import lru_cache, reduce
from operator import or_
from urllib.parse import parse_qsl, quote_plus, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywood.functions.textrules import WORD, expand

# Codes, patterns and replacements, in the order they apply.  "i" ignores case.
RULES = (
    ("PRIVATE_KEY", r"-----BEGIN(?: [A-Z0-9]+)? PRIVATE KEY-----[\s\S]*?-----END(?: [A-Z0-9]+)? PRIVATE KEY-----", "", "[REDACTED_PRIVATE_KEY]"),
    ("CLI_TOKEN", r"<edge>cky_[A-Za-z0-9_-]{50}<edge>", "", "[REDACTED_CLI_TOKEN]"),
    ("BEARER_TOKEN", r"<edge>Bearer<space>+[A-Za-z0-9._~+/=-]{12,}<edge>", "i", "Bearer [REDACTED_TOKEN]"),
    ("BASIC_AUTH", r"<edge>Basic<space>+[A-Za-z0-9+/]{8,}={0,2}", "i", "Basic [REDACTED_TOKEN]"),
    ("JWT", r"<edge>eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}<edge>", "", "[REDACTED_JWT]"),
    ("CLOUD_CREDENTIAL", r"<edge>(?:AKIA|ASIA)[A-Z0-9]{16}<edge>", "", "[REDACTED_CLOUD_CREDENTIAL]"),
    ("API_KEY", r"<edge>(?:sk-(?:(?:proj|ant)-)?[A-Za-z0-9_-]{16,}|AIza[0-9A-Za-z_-]{30,}|github_pat_[A-Za-z0-9_]{20,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{12,}|npm_[A-Za-z0-9]{20,}|sk_live_[A-Za-z0-9]{16,})<edge>", "", "[REDACTED_API_KEY]"),
    ("COOKIE", r"<edge>(?:cookie|set-cookie)<space>*:<space>*[^\r\n]+", "i", "Cookie: [REDACTED]"),
    ("SECRET_ASSIGNMENT", r"""(["'])(password|passwd|api[_-]?key|secret|access[_-]?token)\1<space>*:<space>*(["'])(?!\[REDACTED\])[^\r\n]*?\3""", "i", "$1$2$1:$3[REDACTED]$3"),
    ("SECRET_ASSIGNMENT", r"""<edge>([A-Z][A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD|COOKIE)|password|passwd|api[_-]?key|secret|access[_-]?token)<space>*[:=]<space>*(["'])(?!\[REDACTED\])[^\r\n]*?\2""", "i", "$1=[REDACTED]"),
    ("SECRET_ASSIGNMENT", r"""<edge>([A-Z][A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD|COOKIE)|password|passwd|api[_-]?key|secret|access[_-]?token)<space>*[:=]<space>*(["']?)(?!\[REDACTED\])[^<s>,"'`;]+\2""", "i", "$1=[REDACTED]"),
    ("CREDENTIAL_URI", r"<edge>(?:https?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^<s>/@:]+:[^<s>/@]+@[^<s>)\]}>]+", "i", "[REDACTED_CREDENTIAL_URI]"),
    ("EMAIL", r"<edge>[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}<edge>", "i", "[REDACTED_EMAIL]"),
    ("IPV4", r"<edge>(?:25[0-5]|2[0-4]<digit>|1?<digit>?<digit>)(?:\.(?:25[0-5]|2[0-4]<digit>|1?<digit>?<digit>)){3}<edge>", "", "[REDACTED_IP]"),
    ("HOME_PATH", r"""(?:/[Uu]sers|/home)/[^/<s>`"']+(?=/|<edge>)""", "", "[HOME]"),
    ("WINDOWS_HOME_PATH", r"""<edge>[A-Za-z]:\\Users\\[^\r\n`"'<>|]+""", "i", "[HOME]"),
    ("ABSOLUTE_LOCAL_PATH", r"""(?<![A-Za-z0-9])(?:/(?:private|tmp|var|opt|workspace|mnt|Volumes|srv|root|etc|usr)/[^<s>`"']+|[A-Za-z]:\\(?!Users\\)[^\r\n`"'<>|]+)""", "", "[LOCAL_PATH]"),
    ("SESSION_ID", r"<edge>((?:session(?:_?id)?|conversation(?:_?id)?)<space>*[:=]<space>*)[A-Za-z0-9_-]{8,}", "i", "$1[REDACTED_SESSION_ID]"),
    ("RAW_UUID", r"<edge>[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}<edge>", "i", "[REDACTED_ID]"),
)
#: A rule can match only where one of these stands in the lower-cased text; this spares most texts most rules.
NEEDS = {
    "PRIVATE_KEY": ("-----begin",), "CLI_TOKEN": ("cky_",), "BEARER_TOKEN": ("bearer",), "BASIC_AUTH": ("basic",), "JWT": ("eyj",), "CLOUD_CREDENTIAL": ("akia", "asia"),
    "API_KEY": ("sk-", "aiza", "github_pat_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "npm_", "sk_live_"), "COOKIE": ("cookie",),
    "SECRET_ASSIGNMENT": ("key", "token", "secret", "password", "passwd", "cookie"), "CREDENTIAL_URI": ("://",), "EMAIL": ("@",), "IPV4": (".",),
    "HOME_PATH": ("/users/", "/home/"), "WINDOWS_HOME_PATH": (":\\users\\",), "ABSOLUTE_LOCAL_PATH": ("/private/", "/tmp/", "/var/", "/opt/", "/workspace/", "/mnt/", "/volumes/", "/srv/", "/root/", "/etc/", "/usr/", ":\\"),
    "SESSION_ID": ("session", "conversation"), "RAW_UUID": ("-",),
}
SENSITIVE_KEY = r"(?:access_?token|api_?key|auth|authorization|code|credential|key|password|secret|signature|sig|token)"
IPV6 = r"(?<![A-Za-z0-9:])(?:[A-Fa-f0-9]{0,4}:){2,7}[A-Fa-f0-9]{0,4}(?![A-Za-z0-9:])"
_H = "[A-Fa-f0-9]{1,4}"
#: IPV6 with its check, PHONE with at least ten digits, as patterns; a candidate is always a whole run, so what doesn't fit matches nowhere inside.
STRICT_IPV6 = "(?<![A-Za-z0-9:])(?:" + "|".join([f"(?:{_H}:){{7}}{_H}", f"(?:{_H}:){{1,6}}:", *[f"(?:{_H}:){{1,{k}}}(?::{_H}){{1,{7 - k}}}" for k in range(1, 7)], f":(?::{_H}){{1,6}}", "::"]) + ")(?![A-Za-z0-9:])"
STRICT_PHONE = r"(?<![A-Za-z0-9_])\+?[0-9](?:[ ().-]*+[0-9]){9}(?:[0-9 ().-]*[0-9])?(?![A-Za-z0-9_])"
PHONE = r"(?<![A-Za-z0-9_])(?:\+?[0-9][0-9 ().-]{6,}[0-9])(?![A-Za-z0-9_])"
URL = r"""(?:https?|ftp|s3)://[^<s><>"')\]]+"""


#: What a match that starts at a border starts with, always a word character: so the border is one to the left, and most places fall at once.  EMAIL may start otherwise.
_STARTS = {
    "CLI_TOKEN": "c", "BEARER_TOKEN": "[Bb]", "BASIC_AUTH": "[Bb]", "JWT": "e", "CLOUD_CREDENTIAL": "A", "API_KEY": "[sAgxn]", "COOKIE": "[CcSs]", "SECRET_ASSIGNMENT": "[A-Za-z]", "CREDENTIAL_URI": "[HhPpMmRrAa]",
    "IPV4": "[0-9]", "WINDOWS_HOME_PATH": "[A-Za-z]", "SESSION_ID": "[SsCc]", "RAW_UUID": "[0-9A-Fa-f]",
}


def _java(pattern: str, flags: str, code: str = "") -> str:
    if code in _STARTS and pattern.startswith("<edge>"):
        pattern = f"(?={_STARTS[code]})(?<![{WORD}])" + pattern.removeprefix("<edge>")
    return ("(?i)" if flags else "") + expand(pattern)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: steps that need the step before more than once don't multiply."""
    return F.transform(F.array(value), body)[0]


#: Where a literal says too little, a pattern that every match holds, fast as it starts with a digit or dash or needs no border.
_SHAPES = {"IPV4": r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]", "RAW_UUID": "-[1-8][0-9A-Fa-f]{3}-", "SECRET_ASSIGNMENT": expand("(?i)(?:key|token|secret|password|passwd|cookie)[\"']?<space>*[:=]")}


def _has(low: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words stands in a lower-cased text; words with a rare mark are looked for only where that is."""
    marks = {m: [w for w in words if m in w] for m in "/_"}
    plain = [w for w in words if not any(w in held for held in marks.values())]
    said = [F.contains(low, F.lit(w)) for w in plain]
    for mark, held in marks.items():
        if held:
            here = reduce(or_, [F.contains(low, F.lit(w)) for w in held])
            said.append(F.contains(low, F.lit(mark)) & here if len(held) > 1 else here)
    return reduce(or_, said)


def _may(text: Column, code: str, low: Column | None = None) -> Column:
    low = F.lower(text) if low is None else low
    if code == "SECRET_ASSIGNMENT":  # the pattern is dear
        return _has(low, NEEDS[code]) & text.rlike(_SHAPES[code])
    return text.rlike(_SHAPES[code]) if code in _SHAPES else _has(low, NEEDS[code])


def count_rule(text: Column, code: str) -> Column:
    """How often a rule matches, natively."""
    hits = sum((F.regexp_count(text, F.lit(_java(p, f, c))) for c, p, f, _ in RULES if c == code), F.lit(0))
    return F.when(_may(text, code), hits).otherwise(F.when(text.isNotNull(), 0))


def replace_rules(text: Column, codes: tuple[str, ...] | None = None) -> Column:
    """The text after the pattern rules, natively."""
    for code, pattern, flags, by in RULES:
        if codes is None or code in codes:
            text = let(text, _when(code, _java(pattern, flags, code), by))
    return text


def _when(code: str, pattern: str, by: str):
    return lambda t: F.when(_may(t, code), F.regexp_replace(t, F.lit(pattern), F.lit(by))).otherwise(t)


_DIGITS = re.compile("[0-9][0-9 ().-]{6}")


@lru_cache(maxsize=1)
def _compiled():
    rules = [(c, re.compile(expand(p), re.A | (re.I if f else 0)), re.sub(r"\$([0-9])", r"\\\1", by)) for c, p, f, by in RULES]
    return rules, re.compile(IPV6), re.compile(PHONE), re.compile(expand(URL), re.I | re.A), re.compile(SENSITIVE_KEY, re.I | re.A)


def is_ipv6(value: str) -> bool:
    try:
        return ipaddress.ip_address(value).version == 6
    except ValueError:
        return False


def is_phone(value: str) -> bool:
    return sum(c.isdigit() for c in value) >= 10 and not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", value)


def clean_url(value: str) -> str:
    """The URL with sensitive query values replaced; unchanged without any."""
    key = _compiled()[4]
    try:
        parts = urlsplit(value)
        pairs = parse_qsl(parts.query, keep_blank_values=True)
    except ValueError:
        return value
    if not parts.netloc or not any(key.fullmatch(k) for k, _ in pairs):
        return value
    out, seen = [], set()
    for k, v in pairs:
        if key.fullmatch(k):
            if k not in seen:
                out.append((k, "[REDACTED]"))
            seen.add(k)
        else:
            out.append((k, v))
    query = "&".join(f"{quote_plus(k, safe='*-._')}={quote_plus(v, safe='*-._')}" for k, v in out)
    scheme = parts.scheme.lower()
    if scheme not in DEFAULT_PORT:  # other schemes keep host and path as they are
        return urlunsplit((scheme, parts.netloc, parts.path, query, parts.fragment))
    user, at, host = parts.netloc.rpartition("@")
    host = host.lower().removesuffix(f":{DEFAULT_PORT[scheme]}")
    return urlunsplit((scheme, user + at + host, without_dots(parts.path), query, parts.fragment))


#: Schemes whose urls have a canonical form, with the port that goes without saying.
DEFAULT_PORT = {"http": 80, "https": 443, "ftp": 21}


def without_dots(path: str) -> str:
    """The path with `.` and `..` segments resolved."""
    out, parts = [], path.split("/")[1:] or [""]
    for k, part in enumerate(parts):
        low = part.lower().replace("%2e", ".")
        if low == "..":
            out = out[:-1]
        if low not in (".", ".."):
            out.append(part)
        elif k == len(parts) - 1:
            out.append("")
    return "/" + "/".join(out)


def redact_text(text: str) -> tuple[str, dict[str, int]]:
    """The redacted text and how often each code applied."""
    rules, ipv6, phone, url, _ = _compiled()
    counts: dict[str, int] = {}
    low = text.lower()
    for code, pattern, by in rules:
        if not any(w in low for w in NEEDS[code]):
            continue
        text, n = pattern.subn(by, text)
        if n:
            counts[code] = n  # the last rule of a code that applied
    if ":" not in low and not _DIGITS.search(low):
        return text, counts
    for code, pattern, fits, by in (("IPV6", ipv6, is_ipv6, "[REDACTED_IP]"), ("PHONE", phone, is_phone, "[REDACTED_PHONE]")):
        hits = 0

        def put(m, fits=fits, by=by):
            nonlocal hits
            if not fits(m[0]):
                return m[0]
            hits += 1
            return by

        text = pattern.sub(put, text)
        if hits:
            counts[code] = hits
    after = url.sub(lambda m: clean_url(m[0]), text)
    if after != text:
        counts["SENSITIVE_URL_QUERY"] = 1
    return after, counts


def detect_text(text: str) -> list[tuple[int, int, str]]:
    """(line, column, code) of everything sensitive, in this order; columns count UTF-16 units from 1."""
    rules, ipv6, phone, url, key = _compiled()
    low = text.lower()
    at: list[tuple[int, str]] = [(m.start(), code) for code, pattern, _ in rules if any(w in low for w in NEEDS[code]) for m in pattern.finditer(text)]
    at += [(m.start(), "IPV6") for m in ipv6.finditer(text) if is_ipv6(m[0])]
    at += [(m.start(), "PHONE") for m in phone.finditer(text) if is_phone(m[0])]
    for m in url.finditer(text):
        try:
            pairs = parse_qsl(urlsplit(m[0]).query, keep_blank_values=True)
        except ValueError:
            continue
        if any(key.fullmatch(k) and v != "[REDACTED]" for k, v in pairs):
            at.append((m.start(), "SENSITIVE_URL_QUERY"))
    out = []
    for i, code in at:
        line = text.count("\n", 0, i) + 1
        head = text[text.rfind("\n", 0, i) + 1 : i]
        out.append((line, len(head.encode("utf-16-le", "surrogatepass")) // 2 + 1, code))
    return sorted(out)


@F.pandas_udf(T.StringType())
def clean_urls(text: pd.Series) -> pd.Series:
    """Texts with the sensitive query values of their URLs replaced."""
    url = _compiled()[3]
    return pd.Series([None if t is None else url.sub(lambda m: clean_url(m[0]), t) for t in text], dtype=object)


#: All patterns in order: code, Java pattern, replacement.
_ALL = [(c, _java(p, f, c), by) for c, p, f, by in RULES] + [("IPV6", STRICT_IPV6, "[REDACTED_IP]"), ("PHONE", STRICT_PHONE, "[REDACTED_PHONE]")]
_URL = _java(URL, "i")
#: No rule puts in "://" or "?", and each leaves a mark that ends a URL, so only texts with such a run can ever hold a URL with a query.
_QUERY = expand("://[^<s><>]*[?]")


#: All codes in order; several patterns of a code share a hint.
_CODES = list(dict.fromkeys(c for c, _, _ in _ALL))


def _hints(text: Column) -> Column:
    """An array that says for each of _CODES whether it can match at all, from literals of the text as it came in, lower-cased once."""
    own = {"IPV6": text.rlike(":[0-9A-Fa-f]{0,4}:"), "PHONE": text.rlike("[0-9][0-9 ().-]{6}")}
    return let(F.lower(text), lambda low: F.array(*[own[c] if c in own else _may(text, c, low) for c in _CODES]))


def _any(hints: Column) -> Column:
    return F.exists(hints, lambda h: h)


def pattern_rules(text: Column) -> Column:
    """A struct of the text after all pattern rules and counts (an array, one for each of _ALL), natively.

    A fold over the rules, which carries both; a rule is counted only where it has changed something.
    Texts that no rule can match, most of them, don't enter it.
    """
    return let(F.struct(text.alias("text"), _hints(text).alias("hints")), lambda s: F.when(_any(s["hints"]), _folded(s["text"], s["hints"])).otherwise(F.struct(s["text"].alias("text"), F.array_repeat(F.lit(0), len(_ALL)).alias("counts"))))


def _folded(text: Column, hints: Column) -> Column:
    now = F.struct(text.alias("before"), text.alias("text"), hints.alias("hints"), F.array().cast("array<int>").alias("counts"))
    counted = None
    for k, (_, pattern, by) in enumerate(_ALL):
        now, counted = let(now, _step(k, pattern, by, counted)), pattern
    return let(now, lambda s: F.struct(s["text"].alias("text"), F.concat(s["counts"], _changes(s, counted)).alias("counts")))


def _changes(s: Column, pattern: str) -> Column:
    """How often the rule before applied, which made `text` of `before`."""
    return F.array(F.when(s["text"] != s["before"], F.regexp_count(s["before"], F.lit(pattern))).otherwise(0))


def _step(k: int, pattern: str, by: str, last: str | None):
    def step(s: Column) -> Column:
        after = F.when(s["hints"][_CODES.index(_ALL[k][0])], F.regexp_replace(s["text"], F.lit(pattern), F.lit(by))).otherwise(s["text"])
        counts = F.concat(s["counts"], _changes(s, last)) if last else s["counts"]
        return F.struct(s["text"].alias("before"), after.alias("text"), s["hints"].alias("hints"), counts.alias("counts"))

    return step


def _redactions(counts: Column, urls: Column) -> Column:
    """code -> how often it applied; of a code with several rules the last that applied counts."""
    last: dict[str, Column] = {}
    for k, (code, _, _) in enumerate(_ALL):
        last[code] = F.when(counts[k] > 0, counts[k]).otherwise(last[code]) if code in last else counts[k]
    last["SENSITIVE_URL_QUERY"] = urls.cast("int")
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), n.alias("n")) for c, n in last.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["n"] > 0))


def with_redactions(df: DataFrame, text: str | Column = "text", into: str = "redacted", odd: Column | None = None) -> DataFrame:
    """df with a struct `into` of the redacted text and how often each code applied (a map without zeros); null for a null text.

    `odd` is true wherever the text may hold a URL with a query; a text that costs much to make should bring one that doesn't.
    """
    made = F.col(text) if isinstance(text, str) else text
    odd = F.coalesce(made.rlike(_QUERY) if odd is None else odd, F.lit(False))
    ruled = df.withColumn(into, F.struct(let(made, pattern_rules).alias("by"), odd.alias("odd")))  # analysed once for both branches
    field = lambda name: F.col(f"{into}.{name}")
    clear = ruled.filter(~field("odd")).withColumn(into, let(field("by"), lambda s: F.struct(s["text"].alias("text"), _redactions(s["counts"], F.lit(False)).alias("redactions"))))
    urls = ruled.filter(field("odd")).withColumn(into, F.struct(field("by.text").alias("text"), field("by.counts").alias("counts"))).withColumn(into, F.struct(field("text"), field("counts"), clean_urls(field("text")).alias("after")))
    urls = urls.withColumn(into, F.struct(field("after").alias("text"), _redactions(field("counts"), field("after") != field("text")).alias("redactions")))
    return clear.unionByName(urls).withColumn(into, F.when(field("text").isNotNull(), F.col(into)))


def _sensitive(url: Column) -> Column:
    """Whether a URL's query has a sensitive key with a value not yet replaced."""
    bare = F.substring_index(url, "#", 1)
    plain = lambda c: F.coalesce(F.try_url_decode(c), c)
    key = lambda kv: plain(F.substring_index(kv, "=", 1))
    value = lambda kv: plain(F.regexp_replace(kv, "^[^=]*=?", ""))
    hit = F.exists(F.split(F.regexp_extract(bare, r"[?]([\s\S]*)", 1), "&", -1), lambda kv: key(kv).rlike(f"(?i)^{SENSITIVE_KEY}\\z") & (value(kv) != "[REDACTED]"))
    return hit & ~url.rlike(r"^[^/]*//[^/?#]*\[")


def holds_any(text: Column) -> Column:
    """Whether anything sensitive stands in a text."""
    out = F.coalesce(text.rlike(_QUERY) & F.exists(F.regexp_extract_all(text, F.lit(_URL), F.lit(0)), _sensitive), F.lit(False))

    def ruled(hints: Column) -> Column:
        return _any(hints) & reduce(or_, [hints[_CODES.index(c)] & text.rlike(pattern) for c, pattern, _ in _ALL])

    return out | F.coalesce(let(_hints(text), ruled), F.lit(False))


def _units(text: Column) -> Column:
    """UTF-16 units of a text."""
    return F.length(text) + F.when(F.octet_length(text) > F.length(text), F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))).otherwise(0)


def detections(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, code, line and column (from 1, in UTF-16 units) of everything sensitive in the text of each row of df.

    A rule cuts a text into pieces between its matches.  Each piece and match is measured (units,
    line ends, units behind the last line end); running sums over a row's pieces of one rule
    give the place of every match, however many there are.
    """
    rules = [(c, p) for c, p, _ in _ALL] + [("SENSITIVE_URL_QUERY", _URL)]

    def cut(k: int, code_pattern: tuple[str, str], hint: Column) -> Column:
        p = code_pattern[1]
        parts = lambda m: F.arrays_zip(F.slice(F.split(text, p, -1), F.lit(1), F.size(m)).alias("piece"), m.alias("match"))
        return let(F.when(hint, F.regexp_extract_all(text, F.lit(p), F.lit(0))), lambda m: F.when(F.size(m) > 0, F.struct(F.lit(k).alias("rule"), parts(m).alias("parts"))))

    places = [_CODES.index(c) if c in _CODES else len(_CODES) for c, _ in rules]
    hints = F.concat(_hints(F.col(text)), F.array(F.col(text).rlike(_QUERY)))
    found = let(hints, lambda h: F.when(_any(h), F.array_compact(F.array(*[cut(k, rule, h[at]) for k, (rule, at) in enumerate(zip(rules, places))]))))
    each = df.select(*keys, F.monotonically_increasing_id().alias("_row"), F.explode_outer(found).alias("c")).filter("c is not null").select(*keys, "_row", "c.rule", F.posexplode("c.parts").alias("at", "p"))
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    tail = lambda c: _units(F.substring_index(c, "\n", -1))
    told = F.col("rule") != len(rules) - 1
    sized = each.select(*keys, "_row", "rule", "at", (told | _sensitive(F.col("p.match"))).alias("told"), *[f(F.col(f"p.{s}")).cast("long").alias(f"{s}_{n}") for s in ("piece", "match") for n, f in (("units", _units), ("lines", lines), ("tail", tail))])
    w = Window.partitionBy(*keys, "_row", "rule").orderBy("at")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    c = F.col
    placed = sized.withColumn("end", F.sum(c("piece_units") + c("match_units")).over(upto))
    placed = placed.withColumns({
        "start": c("end") - c("match_units"),
        "line": 1 + c("piece_lines") + F.coalesce(F.sum(c("piece_lines") + c("match_lines")).over(before), F.lit(0)),
        "in_piece": F.when(c("piece_lines") > 0, c("end") - c("match_units") - c("piece_tail")),
        "in_match": F.when(c("match_lines") > 0, c("end") - c("match_tail")),
    })
    last = F.coalesce(c("in_piece"), F.max(F.greatest("in_piece", "in_match")).over(before), F.lit(0))
    codes = F.array(*[F.lit(code) for code, _ in rules])
    return placed.withColumn("column", c("start") - last + 1).filter("told").select(*keys, codes[c("rule")].alias("code"), c("line").cast("int").alias("line"), c("column").cast("int").alias("column"))
