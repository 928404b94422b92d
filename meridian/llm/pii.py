"""Personal data by anchor expansion: one Aho-Corasick pass finds at-signs, schemes, signs before
digits, joined digits, and the cues of accounts and secrets; small deterministic parsers then expand
each anchor to the bounds of an address, number, account or secret and validate it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

from .common import load

#: Kinds in the order in which spans of one start are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "account", "secret")
DIGIT = frozenset("0123456789")
ALNUM = DIGIT | frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL, LABEL = ALNUM | frozenset("._%+-"), ALNUM | frozenset("-")
PHONE = DIGIT | frozenset(" ().-")
SCHEME = ALNUM | frozenset("+.-")
CUES = ("account number", "account no", "acct", "Account number", "Account no", "Account Number", "ACCOUNT NUMBER", "SSN", "social security number", "Social Security number", "Social Security Number")

#: A value that is assigned to a name whose last word is one of these (in lower, upper or title case) is a secret
#: if it has SECRET_CHARS or more characters, a digit among them, and a part of as many letters and digits, mixed; what
#: is assigned to one of PLAIN_CUES may also be plain digits or words and digits, unless they look like a date.
SECRET_CUES = ("token", "secret", "password", "passwd", "passphrase", "pwd", "key", "credential", "credentials")
PLAIN_CUES = ("password", "passwd", "passphrase", "pwd")
SECRET, SECRET_CHARS = ALNUM | frozenset("+/_=~.-"), 8
PART, DATE = re.compile(r"[A-Za-z0-9]+"), re.compile(r"[0-9]{2,4}(?:[./-][0-9]{1,4}){1,2}")
#: Secrets with a beginning of their own: bearer tokens, signed tokens of three parts, chat tokens, private keys.
MARKED = {
    "Bearer ": re.compile(r"[A-Za-z0-9+/_=~.-]{16,}"),
    "eyJ": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "xox": re.compile(r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    "-----BEGIN ": re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----[^-]*-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
}
#: Beginnings of issued keys, and how many letters or digits follow.
ISSUED = {"AKIA": 16, "ASIA": 16, "ghp_": 36, "gho_": 36, "ghs_": 36, "ghu_": 36}

Span = tuple[str, int, int]


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for a in "0123456789":
        found.add_word("+" + a, ("phone", 2))
        for b in "0123456789":
            found.add_word(f"{a}.{b}", ("ip", 3))
            for joint in ("", " ", "-"):
                found.add_word(a + joint + b, ("card", 2 + len(joint)))
    found.add_word("@", ("email", 1))
    found.add_word("://", ("url", 3))
    for cue in ("IBAN", "iban", "Iban"):
        found.add_word(cue, ("iban", len(cue)))
    for cue in CUES:
        found.add_word(cue, ("account", len(cue)))
    for cue in SECRET_CUES:
        for form in {cue, cue.upper(), cue.title()}:
            found.add_word(form, ("secret", len(form)))
    for head in MARKED:
        found.add_word(head, ("marked", len(head)))
    for head in ISSUED:
        found.add_word(head, ("issued", len(head)))
    found.make_automaton()
    return found


def _run(text: str, at: int, of: frozenset) -> int:
    """The end of the run of such characters that begins at a place."""
    while at < len(text) and text[at] in of:
        at += 1
    return at


def _back(text: str, at: int, of: frozenset, least: int) -> int:
    while at > least and text[at - 1] in of:
        at -= 1
    return at


def _email(text: str, at: int, free: int) -> tuple[Span | None, int]:
    start, end = _back(text, at, LOCAL, free), _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None, free
    labels = 0
    while end < len(text) and text[end] == "." and (more := _run(text, end + 1, LABEL)) > end + 1:
        end, labels = more, labels + 1
    return (("email", start, end), end) if labels else (None, free)


def _ip(text: str, at: int, free: int) -> tuple[list[Span], int]:
    """All of a chain of numbers joined by dots: four at a time, from its left end."""
    start, out = _back(text, at, DIGIT, free), []
    number, end = [], start
    while True:
        stop = _run(text, end, DIGIT)
        number.append((end, stop))
        if stop + 1 < len(text) and text[stop] == "." and text[stop + 1] in DIGIT:
            end = stop + 1
        else:
            break
    for k in range(0, len(number) - 3, 4):
        four = number[k : k + 4]
        if all(len(p := text[i:j].lstrip("0")) <= 3 and int(p or "0") <= 255 for i, j in four):
            out.append(("ip", four[0][0], four[3][1]))
    return out, number[-1][1]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _card(text: str, at: int, free: int) -> tuple[Span | None, int]:
    start = at
    while start > free:  # the anchor may lie within a chain that an earlier anchor did not reach
        if text[start - 1] in DIGIT:
            start -= 1
        elif start - 1 > free and text[start - 1] in " -" and text[start - 2] in DIGIT:
            start -= 2
        else:
            break
    end = start + 1
    while end < len(text):
        if text[end] in DIGIT:
            end += 1
        elif text[end] in " -" and end + 1 < len(text) and text[end + 1] in DIGIT:
            end += 2
        else:
            break
    digits = text[start:end].replace(" ", "").replace("-", "")
    return (("card", start, end) if 12 <= len(digits) <= 19 and luhn(digits) else None), end


def _phone(text: str, at: int, free: int) -> tuple[Span | None, int]:
    end = _back(text, _run(text, at + 2, PHONE), PHONE - DIGIT, at + 2)
    if end < at + 4:
        return None, free
    digits = sum(c in DIGIT for c in text[at:end])
    return (("phone", at, end) if 9 <= digits <= 15 else None), end


def _url(text: str, at: int, free: int) -> tuple[Span | None, int]:
    """Addresses that carry a user's name or password: scheme://user[:password]@host."""
    start, end = _back(text, at, SCHEME, free), at + 3
    while end < len(text) and not text[end].isspace() and text[end] not in "/@\"'<>?#":
        end += 1
    if start == at or end == at + 3 or end >= len(text) or text[end] != "@":
        return None, free
    stop = _run(text, end + 1, LABEL | {"."})
    stop = _back(text, stop, frozenset("."), end + 1)
    return (("url", start, stop), stop) if stop > end + 1 else (None, free)


def _iban(text: str, at: int, free: int) -> tuple[Span | None, int]:
    start = _run(text, at, frozenset(" :#.=\t"))
    if start < free or start - at > 12 or len(text) - start < 15 or not (text[start : start + 2].isascii() and text[start : start + 2].isalpha() and text[start + 2] in DIGIT and text[start + 3] in DIGIT):
        return None, free
    end, kept, best = start, "", None
    while end < len(text) and len(kept) < 34 and (text[end] in ALNUM or (text[end] == " " and end + 1 < len(text) and text[end + 1] in ALNUM)):
        kept += text[end] if text[end] != " " else ""
        end += 1
        if len(kept) >= 15 and text[end - 1] != " " and int("".join(str(int(c, 36)) for c in kept[4:] + kept[:4])) % 97 == 1:
            best = end
    return (("iban", start, best), best) if best else (None, free)


def _account(text: str, at: int, free: int) -> tuple[Span | None, int]:
    start = _run(text, at, frozenset(" :#.=\t"))
    end = _back(text, _run(text, start, DIGIT | {"-"}), frozenset("-"), start)
    digits = sum(c in DIGIT for c in text[start:end])
    return (("account", start, end), end) if start - at <= 12 and 6 <= digits <= 17 else (None, free)


def _named(text: str, at: int) -> bool:
    """Whether a word begins at a place: after no letter or digit, or as a capital after a small letter or digit."""
    before = text[at - 1] if at else " "
    return not before.isalnum() or (text[at].isupper() and not text[at + 1].isupper() and (before.islower() or before in DIGIT))


def _shaped(value: str, plain: bool) -> bool:
    """Whether a value with a digit looks like a secret: see SECRET_CUES."""
    mixed = any(len(p) >= SECRET_CHARS and not p.isdigit() and not p.isalpha() for p in PART.findall(value))
    return mixed or (plain and not DATE.fullmatch(value))


def _secret(text: str, cue: int, at: int, free: int, dead: int) -> tuple[Span | None, int, int]:
    """The value of an assignment: name, perhaps a quote, = or : among at most four blanks, perhaps a quote.

    Also where the next secret may begin, and up to where the run of a rejected value reaches: what is
    assigned within it is not looked at again."""
    here = at + 1 if text[at : at + 1] in ("'", '"') else at
    sign = _run(text, here, frozenset(" \t"))
    start = _run(text, sign + 1, frozenset(" \t"))
    if sign - here > 4 or start - sign > 5 or text[sign : sign + 1] not in ("=", ":") or not _named(text, cue):
        return None, free, dead
    start += text[start : start + 1] in ("'", '"')
    if start < max(free, dead):
        return None, free, dead
    stop = _run(text, start, SECRET)
    end = _back(text, stop, frozenset("."), start)
    value = text[start:end]
    if len(value) < SECRET_CHARS or DIGIT.isdisjoint(value) or not _shaped(value, text[cue:at].lower() in PLAIN_CUES):
        return None, free, stop
    return ("secret", start, end), end, dead


def _marked(text: str, at: int, head: str, free: int) -> tuple[Span | None, int]:
    start = at + len(head) if head == "Bearer " else at
    if start < free or (head != "-----BEGIN " and at and (text[at - 1].isalnum() or text[at - 1] in "-_.")):
        return None, free
    found = MARKED[head].match(text, start)
    if not found or (head == "Bearer " and DIGIT.isdisjoint(found[0])):
        return None, free
    end = _back(text, found.end(), frozenset("."), start)
    return ("secret", start, end), end


def _issued(text: str, at: int, free: int) -> tuple[Span | None, int]:
    end = _run(text, at + 4, ALNUM)
    if at < free or (at and text[at - 1] in ALNUM) or end - at - 4 != ISSUED[text[at : at + 4]]:
        return None, free
    return ("secret", at, end), end


def find_spans(text: str | None) -> list[Span]:
    """Spans (kind, start, end) in code points, end exclusive, by start and then kind as in KINDS.

    Spans of one kind do not overlap, and are those a scan from the left finds. Null: none.
    """
    if not text:
        return []
    free, dead = dict.fromkeys(KINDS, 0), 0  # where the next span of a kind may begin
    out: list[Span] = []
    for last, (kind, size) in _anchors().iter(text):
        at = last + 1 - size
        if kind in ("secret", "issued", "marked"):
            if kind == "secret":
                span, free[kind], dead = _secret(text, at, last + 1, free[kind], dead)
            elif kind == "marked":
                span, free["secret"] = _marked(text, at, text[at : last + 1], free["secret"])
            else:
                span, free["secret"] = _issued(text, at, free["secret"])
            out += [span] if span else []
            continue
        if at < free[kind] and kind not in ("iban", "account"):
            continue
        if kind == "ip":
            if at >= free[kind]:
                spans, free[kind] = _ip(text, at, free[kind])
                out += spans
            continue
        if kind == "email":
            span, free[kind] = _email(text, at, free[kind])
        elif kind == "card":
            span, free[kind] = _card(text, at, free[kind])
        elif kind == "phone":
            span, free[kind] = _phone(text, at, free[kind])
        elif kind == "url":
            span, free[kind] = _url(text, at, free[kind])
        elif kind == "iban":
            span, free[kind] = _iban(text, last + 1, free[kind])
        else:
            span, free[kind] = _account(text, last + 1, free[kind])
        if span:
            out.append(span)
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[1], order[s[0]]))


def redact(text: str | None, tag: Callable[[str], str] = lambda kind: f"<{kind.upper()}>") -> str | None:
    """text with each span replaced by its kind's tag; overlapping spans become the first one's tag."""
    spans = find_spans(text)
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], tag(kind)]
        at = max(at, end)
    return "".join([*out, text[at:]])


@pandas_udf(StringType())
def _spans_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([",".join(f"{k}:{i}:{j}" for k, i, j in find_spans(t)) for t in part], dtype=object)


@pandas_udf(StringType())
def _redact_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([redact(t) for t in part], dtype=object)


def with_spans(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """docs with an array of structs (kind, start, end); empty for null and empty texts.

    Repeated rows get the same spans. A column of the name into is replaced.
    """
    fields = lambda s: F.split(s, ":")
    found = F.transform(
        F.array_remove(F.split(_spans_udf(F.col(text)), ","), ""),
        lambda s: F.struct(fields(s)[0].alias("kind"), fields(s)[1].cast("long").alias("start"), fields(s)[2].cast("long").alias("end")),
    )
    return docs.withColumn(into, found)


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by tags, and n_chars (if there) the new length."""
    out = docs.withColumn("text", _redact_udf(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["kind"].isin("email", "ip", "card", "phone"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
