"""The string function library: Column in, Column out, missing stays missing.

Positions count from 0 and may be negative.  Patterns are Java regular
expressions; group references in replacements may be written ``\\1``.  Members
without a JVM equivalent (Unicode case folding, normalisation, wrapping ...) are
Arrow-batched pandas functions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _python(f, returns: str = "string"):
    """A pandas string method as a Column function."""

    def make(c, *args, **kwargs) -> Column:
        def run(s: pd.Series) -> pd.Series:
            return f(s.str, *args, **kwargs)

        return F.pandas_udf(run, returns)(_c(c))

    return make


def quoted(text: str) -> str:
    """``text`` as a literal Java pattern."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _pattern(pat: str, regex: bool = True, case: bool = True) -> str:
    return ("" if case else "(?iu)") + (pat if regex else quoted(pat))


def lower(c) -> Column:
    return F.lower(_c(c))


def upper(c) -> Column:
    return F.upper(_c(c))


def len_(c) -> Column:
    return F.char_length(_c(c))


def capitalize(c) -> Column:
    return F.concat(F.upper(F.substr(_c(c), F.lit(1), F.lit(1))), F.lower(F.substr(_c(c), F.lit(2))))


casefold = _python(lambda s: s.casefold())
title = _python(lambda s: s.title())
swapcase = _python(lambda s: s.swapcase())
wrap = _python(lambda s, width, **kw: s.wrap(width, **kw))
normalize = _python(lambda s, form: s.normalize(form))
istitle = _python(lambda s: s.istitle(), "boolean")


def strip(c, chars: str | None = None) -> Column:
    return F.regexp_replace(_c(c), "^\\s+|\\s+$", "") if chars is None else F.btrim(_c(c), F.lit(chars))


def lstrip(c, chars: str | None = None) -> Column:
    return F.regexp_replace(_c(c), "^\\s+", "") if chars is None else F.ltrim(_c(c), F.lit(chars))


def rstrip(c, chars: str | None = None) -> Column:
    return F.regexp_replace(_c(c), "\\s+$", "") if chars is None else F.rtrim(_c(c), F.lit(chars))


def contains(c, pat: str, case: bool = True, regex: bool = True, na=None) -> Column:
    found = F.contains(_c(c), F.lit(pat)) if case and not regex else F.rlike(_c(c), F.lit(_pattern(pat, regex, case)))
    return found if na is None else F.coalesce(found, F.lit(na))


def match(c, pat: str, case: bool = True, na=None) -> Column:
    return contains(c, f"^(?:{pat})", case, True, na)


def fullmatch(c, pat: str, case: bool = True, na=None) -> Column:
    return contains(c, f"^(?:{pat})\\z", case, True, na)


def _any_of(f, c, what) -> Column:
    tests = [f(_c(c), F.lit(w)) for w in ((what,) if isinstance(what, str) else what)]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def startswith(c, prefix) -> Column:
    return _any_of(F.startswith, c, prefix)


def endswith(c, suffix) -> Column:
    return _any_of(F.endswith, c, suffix)


def count(c, pat: str) -> Column:
    return F.regexp_count(_c(c), F.lit(pat))


def find(c, sub: str, start: int = 0) -> Column:
    return F.locate(sub, _c(c), start + 1) - 1 if sub else F.when(_c(c).isNotNull(), F.lit(start))


def rfind(c, sub: str) -> Column:
    at = F.instr(F.reverse(_c(c)), F.lit(sub[::-1]))
    return F.when(_c(c).isNull(), None).when(at == 0, -1).otherwise(F.char_length(_c(c)) - at - len(sub) + 1)


def index(c, sub: str) -> Column:
    return F.when(_c(c).isNull(), None).when(find(c, sub) >= 0, find(c, sub)).otherwise(F.raise_error(F.lit("substring not found")).cast("int"))


def rindex(c, sub: str) -> Column:
    return F.when(_c(c).isNull(), None).when(rfind(c, sub) >= 0, rfind(c, sub)).otherwise(F.raise_error(F.lit("substring not found")).cast("int"))


def replace(c, pat: str, repl, n: int = -1, regex: bool = False, case: bool = True) -> Column:
    """All occurrences, or the first ``n``; ``repl`` may be a function of the match."""
    if callable(repl) or n >= 0:
        return _python(lambda s: s.replace(pat, repl, n=n, regex=regex or callable(repl), case=case if regex else None))(c)
    if not regex and case:
        return F.replace(_c(c), F.lit(pat), F.lit(repl))
    java = re.sub(r"\\(\d)", r"$\1", repl) if regex else re.sub(r"([\\$])", r"\\\1", repl)
    return F.regexp_replace(_c(c), _pattern(pat, regex, case), java)


def removeprefix(c, prefix: str) -> Column:
    return F.when(F.startswith(_c(c), F.lit(prefix)), F.substr(_c(c), F.lit(len(prefix) + 1))).otherwise(_c(c))


def removesuffix(c, suffix: str) -> Column:
    keep = F.char_length(_c(c)) - len(suffix)
    return F.when(F.endswith(_c(c), F.lit(suffix)), F.substr(_c(c), F.lit(1), keep)).otherwise(_c(c)) if suffix else _c(c)


def _place(c, i: int) -> Column:
    n = F.char_length(_c(c))
    return F.greatest(n + i, F.lit(0)) if i < 0 else F.least(F.lit(i), n)


def slice(c, start: int | None = None, stop: int | None = None, step: int | None = None) -> Column:
    if step not in (None, 1):
        return _python(lambda s: s.slice(start, stop, step))(c)
    n = F.char_length(_c(c))
    a = _place(c, start) if start is not None else F.lit(0)
    b = _place(c, stop) if stop is not None else n
    return F.substr(_c(c), a + 1, F.greatest(b - a, F.lit(0)))


def slice_replace(c, start: int | None = None, stop: int | None = None, repl: str = "") -> Column:
    n = F.char_length(_c(c))
    a = _place(c, start) if start is not None else F.lit(0)
    b = F.greatest(_place(c, stop) if stop is not None else n, a)
    return F.concat(F.substr(_c(c), F.lit(1), a), F.lit(repl), F.substr(_c(c), b + 1))


def get(c, i: int) -> Column:
    n = F.char_length(_c(c))
    at = n + i if i < 0 else F.lit(i)
    return F.when((at >= 0) & (at < n), F.substr(_c(c), at + 1, F.lit(1)))


def split(c, pat: str | None = None, n: int = -1, regex: bool = False) -> Column:
    """Array of parts; without a pattern at runs of white space, none at the ends."""
    if pat is None:
        return F.when(strip(c) == "", F.array().cast("array<string>")).otherwise(F.split(strip(c), "\\s+", n + 1 if n > 0 else -1))
    return F.split(_c(c), pat if regex else quoted(pat), n + 1 if n > 0 else -1)


def rsplit(c, pat: str | None = None, n: int = -1) -> Column:
    if n <= 0:
        return split(c, pat)
    if pat is None:
        return _python(lambda s: s.rsplit(n=n), "array<string>")(c)
    back = F.split(F.reverse(_c(c)), quoted(pat[::-1]), n + 1)
    return F.reverse(F.transform(back, lambda x: F.reverse(x)))


def expand(df: DataFrame, parts: Column, width: int, prefix: str = "c") -> DataFrame:
    """An array's first ``width`` elements as columns; missing ones are NULL."""
    held = df.withColumn("__parts", parts)
    return held.select(*df.columns, *[F.get("__parts", F.lit(i)).alias(f"{prefix}{i}") for i in range(width)])


def partition(c, sep: str = " ") -> Column:
    """Struct ``before, sep, after`` around the first separator."""
    at = F.instr(_c(c), F.lit(sep))
    return F.when(
        _c(c).isNotNull(),
        F.struct(
            F.when(at > 0, F.substr(_c(c), F.lit(1), at - 1)).otherwise(_c(c)).alias("before"),
            F.when(at > 0, F.lit(sep)).otherwise("").alias("sep"),
            F.when(at > 0, F.substr(_c(c), at + len(sep))).otherwise("").alias("after"),
        ),
    )


def rpartition(c, sep: str = " ") -> Column:
    at = rfind(c, sep) + 1
    return F.when(
        _c(c).isNotNull(),
        F.struct(
            F.when(at > 0, F.substr(_c(c), F.lit(1), at - 1)).otherwise("").alias("before"),
            F.when(at > 0, F.lit(sep)).otherwise("").alias("sep"),
            F.when(at > 0, F.substr(_c(c), at + len(sep))).otherwise(_c(c)).alias("after"),
        ),
    )


def extract(c, pat: str, group: int = 1) -> Column:
    """A group of the first match; NULL without one."""
    return F.when(F.rlike(_c(c), F.lit(pat)), F.regexp_extract(_c(c), pat, group))


def extractall(df: DataFrame, c: str, pat: str, groups: int = 1) -> DataFrame:
    """One row per match: ``match`` from 0 and ``g1`` ... for its groups."""
    each = F.arrays_zip(*[F.regexp_extract_all(F.col(c), F.lit(pat), F.lit(g + 1)).alias(f"g{g + 1}") for g in range(groups)])
    return df.select("*", F.posexplode(each).alias("match", "__m")).select(*df.columns, "match", "__m.*")


def findall(c, pat: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(pat), F.lit(group))


def cat(*columns, sep: str = "", na_rep: str | None = None) -> Column:
    """Elementwise concatenation; NULL with a missing part unless ``na_rep`` stands for it."""
    parts = [_c(c) if na_rep is None else F.coalesce(_c(c), F.lit(na_rep)) for c in columns]
    out = [parts[0]]
    for p in parts[1:]:
        out += [F.lit(sep), p]
    return F.concat(*out)


def join(c, sep: str) -> Column:
    """Elements of an array column, or letters of a string, with ``sep`` between them."""
    return F.array_join(_c(c), sep)


def join_letters(c, sep: str) -> Column:
    """``sep`` between all letters of a string."""
    return F.regexp_replace(_c(c), "(?s)(?<=.)(?=.)", re.sub(r"([\\$])", r"\\\1", sep))


def get_dummies(df: DataFrame, c: str, sep: str = "|", tokens: list[str] | None = None) -> DataFrame:
    """A 0/1 column per token; the tokens are those given or all that occur."""
    parts = F.split(F.coalesce(F.col(c), F.lit("")), quoted(sep))
    if tokens is None:
        tokens = [r[0] for r in df.select(F.explode(parts).alias("t")).filter("t <> ''").distinct().orderBy("t").collect()]
    return df.withColumns({t: F.array_contains(parts, t).cast("int") for t in tokens})


def pad(c, width: int, side: str = "left", fillchar: str = " ") -> Column:
    n = F.char_length(_c(c))
    if side == "both":
        return center(c, width, fillchar)
    f = F.lpad if side == "left" else F.rpad
    return F.when(n < width, f(_c(c), width, fillchar)).otherwise(_c(c))


def ljust(c, width: int, fillchar: str = " ") -> Column:
    return pad(c, width, "right", fillchar)


def rjust(c, width: int, fillchar: str = " ") -> Column:
    return pad(c, width, "left", fillchar)


def center(c, width: int, fillchar: str = " ") -> Column:
    """The odd fill character goes left if the width is odd, else right."""
    gap = F.greatest(F.lit(width) - F.char_length(_c(c)), F.lit(0))
    left = F.floor(gap / 2) + (gap.bitwiseAND(F.lit(width)).bitwiseAND(1))
    return F.concat(F.repeat(F.lit(fillchar), left.cast("int")), _c(c), F.repeat(F.lit(fillchar), (gap - left).cast("int")))


def zfill(c, width: int) -> Column:
    c, n = _c(c), F.char_length(_c(c))
    signed = F.concat(F.substr(c, F.lit(1), F.lit(1)), F.lpad(F.substr(c, F.lit(2)), max(width - 1, 0), "0"))
    return F.when(n >= width, c).when(F.rlike(c, F.lit("^[+-]")), signed).otherwise(F.lpad(c, width, "0"))


def repeat(c, n: int) -> Column:
    return F.repeat(_c(c), F.lit(max(0, n)))


def translate(c, table: dict) -> Column:
    """``table``: character (or code) to character, code, string or None, as ``str.maketrans`` gives it."""
    text = lambda k: chr(k) if isinstance(k, int) else k
    pairs = {text(k): "" if v is None else text(v) for k, v in table.items()}
    if all(len(v) <= 1 for v in pairs.values()):
        one = {k: v for k, v in pairs.items() if v}
        gone = [k for k, v in pairs.items() if not v]
        return F.translate(_c(c), "".join([*one, *gone]), "".join(one.values()))
    return _python(lambda s: s.translate(str.maketrans(pairs)))(c)


def encode(c, charset: str = "UTF-8") -> Column:
    return F.encode(_c(c), charset)


def decode(c, charset: str = "UTF-8") -> Column:
    return F.decode(_c(c), charset)


def _all(pattern: str):
    return lambda c: F.rlike(_c(c), F.lit(f"^{pattern}\\z"))


isalpha = _all("\\p{L}+")
isdecimal = _all("\\p{Nd}+")
isdigit = _all("[\\p{Nd}\\x{B2}\\x{B3}\\x{B9}\\x{2070}\\x{2074}-\\x{2079}\\x{2080}-\\x{2089}]+")
isnumeric = _all("\\p{N}+")
isalnum = _all("[\\p{L}\\p{N}]+")
isspace = _all("[\\s\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+")


def isupper(c) -> Column:
    return F.rlike(_c(c), F.lit("\\p{Lu}")) & ~F.rlike(_c(c), F.lit("[\\p{Ll}\\p{Lt}]"))


def islower(c) -> Column:
    return F.rlike(_c(c), F.lit("\\p{Ll}")) & ~F.rlike(_c(c), F.lit("[\\p{Lu}\\p{Lt}]"))
