"""Column expressions over text: cleaning, counting, term extraction, quality."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Character ranges and patterns of the indexing rules.
CJK = r"\x{4e00}-\x{9fff}"
IDENTIFIER = r"[a-z][a-z0-9]*(?:[_.-][a-z0-9]+)*"
SPLIT_LETTER = r"(?U)\b([A-Z])[ \t]*\r?\n[ \t]*([A-Z0-9]+(?:_[A-Z0-9]+)+)\b"
NUMBER = (r"(?<![A-Za-z0-9_.+-])[+-]?[0-9]+(?:[.,][0-9]+)?(?:[eE][+-]?[0-9]+)?"
          r"(?![A-Za-z0-9_.+-])")
STREAM_FUNCTION = (r"(?U)(?<![A-Za-z0-9_.-])S[ \t]*(?:\r?\n[ \t]*)?([0-9]{1,3})[ \t]*(?:\r?\n[ \t]*)?,"
                   r"[ \t]*(?:\r?\n[ \t]*)?F[ \t]*(?:\r?\n[ \t]*)?([0-9]{1,3})(?![A-Za-z0-9_.-]|\s*[0-9])")
TIMER_ALIAS = "tp#timer"
VERSION_SUFFIX = r"(?:^|_)(v[0-9]+(?:\.[0-9]+)+)(?=_|$)"
UNREADABLE = r"[\x{fffd}\p{Co}]|[\p{Cc}&&[^\n\t\r]]"


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def strip(value) -> Column:
    """Trim every Unicode white space, not only blanks."""
    return F.regexp_replace(as_column(value), r"(?U)^\s+|\s+$", "")


def squeeze(value) -> Column:
    """White space runs become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(as_column(value), r"(?U)\s+", " "))


def without_space(value) -> Column:
    return F.regexp_replace(as_column(value), r"(?U)\s+", "")


def extract_all(value, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(as_column(value), F.lit(pattern), F.lit(group))


def ascii_lower(value) -> Column:
    """Lower case for A-Z only, as byte-oriented engines do."""
    return F.translate(as_column(value), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_name(value) -> Column:
    return F.trim(F.regexp_extract(F.regexp_replace(as_column(value), r"\\", "/"), r"([^/]*)/*$", 1))


def suffix(value) -> Column:
    """Lower-case extension with its dot, empty when there is none."""
    return F.lower(F.regexp_extract(as_column(value), r"[^./\\](\.[^./\\]+)$", 1))


def stem(value) -> Column:
    return F.regexp_replace(as_column(value), r"(?<=[^./\\])\.[^./\\]+$", "")


def clean_text(value) -> Column:
    """Normalise line ends and blanks; runs of blank lines collapse to one."""
    text = F.regexp_replace(as_column(value), r"\r\n|[\r\f]", "\n")
    text = F.regexp_replace(text, r"\x{3000}", " ")
    text = F.regexp_replace(text, r"(?U)[\s&&[^\n]]+(?=\n|$)", "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(text, r"[ \t]+", " "))


def token_count(value) -> Column:
    """Half a token per CJK character and a quarter per other character, rounded up."""
    text = as_column(value)
    cjk = F.length(F.regexp_replace(text, f"[^{CJK}]", ""))
    other = F.length(text) - cjk
    tokens = F.floor((cjk + 1) / 2) + F.floor((other + 3) / 4)
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), tokens)).cast("long")


def technical_terms(value) -> Column:
    """Distinct lower-case ASCII identifiers in first-seen order, plus rejoined split letters."""
    text = as_column(value)
    terms = extract_all(F.lower(text), IDENTIFIER)
    joined = F.zip_with(extract_all(text, SPLIT_LETTER, 1), extract_all(text, SPLIT_LETTER, 2),
                        lambda head, tail: F.lower(F.concat(head, tail)))
    # The two extra passes run only over texts that can hold a split identifier.
    aliases = F.when(text.rlike(SPLIT_LETTER), joined).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(terms, aliases))


def _hex(value: Column) -> Column:
    return F.lower(F.hex(F.encode(value, "UTF-8")))


def lexical_terms(value, query: bool = False) -> Column:
    """CJK bigrams, single characters and whole number literals, each in its own name space."""
    text = as_column(value)

    def run_terms(run: Column) -> Column:
        size = F.length(run)
        empty = F.array().cast("array<string>")
        pairs = F.when(size > 1, F.transform(
            F.sequence(F.lit(1), size - 1), lambda i: F.concat(F.lit("z2"), _hex(F.substring(run, i, F.lit(2)))))
        ).otherwise(empty)
        singles = F.transform(F.sequence(F.lit(1), size),
                              lambda i: F.concat(F.lit("z1"), _hex(F.substring(run, i, F.lit(1)))))
        if query:
            singles = F.when(size == 1, singles).otherwise(empty)
        return F.concat(pairs, singles)

    runs = F.flatten(F.transform(extract_all(text, f"[{CJK}]+"), run_terms))
    numbers = F.transform(extract_all(text, NUMBER), lambda n: F.concat(F.lit("n"), _hex(F.lower(n))))
    return F.array_distinct(F.concat(runs, numbers))


def bigrams(value) -> Column:
    """Distinct CJK bigrams as text."""
    def pairs(run: Column) -> Column:
        return F.when(F.length(run) > 1, F.transform(
            F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        ).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(extract_all(value, f"[{CJK}]+"), pairs)))


def expand_terms(terms, content) -> Column:
    """Body-only additions: stream/function codes, the timer family and hyphen word parts."""
    terms, content = as_column(terms), as_column(content)
    codes = F.zip_with(extract_all(content, STREAM_FUNCTION, 1), extract_all(content, STREAM_FUNCTION, 2),
                       lambda s, f: F.concat(F.lit("s"), s, F.lit("f"), f))
    empty = F.array().cast("array<string>")
    codes = F.when(content.rlike(STREAM_FUNCTION), codes).otherwise(empty)
    timer = F.when(F.exists(terms, lambda t: t.startswith("tp") & t.rlike(r"^tp\d*$")), F.array(F.lit(TIMER_ALIAS))).otherwise(empty)
    parts = F.flatten(F.transform(F.filter(terms, lambda t: t.contains("-") & t.rlike(r"^[a-z]+(?:-[a-z]+)+$")),
                                  lambda t: F.split(t, "-")))
    return F.array_distinct(F.concat(terms, codes, timer, parts))


def body_terms(content) -> Column:
    """Technical postings of a chunk body."""
    return expand_terms(technical_terms(content), content)


def filename_terms(filename) -> Column:
    name = stem(filename)
    return F.array_distinct(F.concat(technical_terms(name), extract_all(F.lower(name), VERSION_SUFFIX, 1)))


def normal_filename(filename) -> Column:
    return F.lower(squeeze(filename))


def lines_of(value) -> Column:
    return F.split(as_column(value), "\n")


def text_quality(value, min_chars: int = 40, max_garble: float = 0.02) -> Column:
    """Struct of non-space characters, unreadable ratio and class."""
    text = F.coalesce(as_column(value), F.lit(""))
    chars = F.length(without_space(text))
    size = F.length(text)
    ratio = F.when(size > 0, F.regexp_count(text, F.lit(UNREADABLE)) / size).otherwise(F.lit(1.0))
    label = (F.when(chars == 0, "insufficient").when(ratio > max_garble, "suspect")
             .when(chars < min_chars, "insufficient").otherwise("usable"))
    return F.struct(chars.cast("long").alias("chars"), ratio.alias("garble_ratio"), label.alias("quality"))
