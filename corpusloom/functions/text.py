"""Text signals as native column expressions, inside whole-stage code generation.

Every function takes a column of text and returns a column; nulls give null.
Classes of characters are spelled out so that they mean the same in Java, in
Python and in the SQL that tests compare with.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Unicode has it, for classes in regular expressions.
SPACES = r"\t\n\x0B\f\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
#: The breaks besides line feeds, those of Latin-1 named one by one: Java looks these up in a table and tests ranges by turns.
_RARE_BREAKS = r"\r\x0B\f\x1C\x1D\x1E\x85"
LONE_BREAK = rf"[\n{_RARE_BREAKS}\u2028\u2029]"
#: Punctuation that marks code.
CODE_MARKS = "%&()*+,-/:;<=>[]{|}"
#: Symbols that make tokens short.
TOKEN_MARKS = "#$%()*+,-./:;<=>@[\\]^`{|}~"
STOP_WORDS = tuple("a about all an and as at be but by do for from get go have he her his i if in it me my not of on one or out say she so that the their there they this to up we what when which who will with would you".split())
BULLET = rf"^[{SPACES}]*(?:[*+·•∙◦-]|\d{{1,3}}[).])[{SPACES}]+"
#: The letters, numbers and white space of Latin-1, one by one.
_LATIN_PLAIN = "".join(rf"\x{i:02X}" for i in range(256) if unicodedata.category(chr(i))[0] in "LNZ" or chr(i).isspace())
CONTROLS = r"[\p{C}\u200B\u200C\u200D\u2060\uFEFF&&[^\n\t]]"


def _over(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.when(b.isNotNull(), 0.0))


def n_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def n_of(text: Column, characters: str) -> Column:
    """How many of these characters a text has; faster than a pattern."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def newline_norm(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, "")


def n_lines(text: Column) -> Column:
    """Line feeds plus one; 0 for the empty text."""
    return F.when(text == "", F.lit(0)).otherwise(F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long")


def _split(text: Column) -> Column:
    """The text at its line breaks.  Line feeds alone need no pattern; one class is several times faster than an alternative with \\r\\n."""
    rare = text.rlike(f"[{_RARE_BREAKS}]") | text.contains("\u2028") | text.contains("\u2029")
    return F.when(rare, F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), LONE_BREAK, -1)).otherwise(F.split(text, "\n", -1))


def lines(text: Column, whole: Column | None = None) -> Column:
    """Lines without their ends; a text's last break opens no line.  whole: the split text, where the row has it."""
    whole = _split(text) if whole is None else whole
    return F.when(F.element_at(whole, -1) == "", F.slice(whole, 1, F.size(whole) - 1)).otherwise(whole)


def ascii_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\x00-\x7F]+", "")).cast("long")


def ascii_ratio(text: Column) -> Column:
    return F.when(text == "", 1.0).otherwise(ascii_count(text) / F.length(text))


def code_mark_count(text: Column) -> Column:
    return n_of(text, CODE_MARKS)


def short_line_count(text: Column, most: int = 60, ls: Column | None = None) -> Column:
    bare = rf"^[{SPACES}]+|[{SPACES}]+$"
    # only lines longer than ``most`` with white space at an end need to be stripped
    padded = lambda x: F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1)).rlike(f"[{SPACES}]")
    return F.size(F.filter(lines(text) if ls is None else ls, lambda x: (F.length(x) <= most) | padded(x) & (F.length(F.regexp_replace(x, bare, "")) <= most))).cast("long")


def code_complexity(text: Column, short: int = 60, marks: float = 0.5, lines_weight: float = 0.5, ls: Column | None = None, n_short: Column | None = None, n_marks: Column | None = None) -> Column:
    """ls, n_short, n_marks: the lines, short lines and marks, where the row has them already."""
    ls = lines(text) if ls is None else ls
    share = (short_line_count(text, short, ls) if n_short is None else n_short) / F.greatest(F.size(ls), F.lit(1))
    return F.when(text == "", 0.0).otherwise(F.least(F.lit(1.0), marks * (code_mark_count(text) if n_marks is None else n_marks) / F.length(text) + lines_weight * share))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def word_count(text: Column) -> Column:
    return n_matches(F.lower(text), "[a-z]+")


def stop_word_count(text: Column) -> Column:
    return n_matches(F.lower(text), rf"(?<![a-z])(?:{'|'.join(STOP_WORDS)})(?![a-z])")


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(F.lower(text), "[^a-z]+", "")).cast("long")


def symbol_count(text: Column) -> Column:
    """Characters that are no letter, number or white space.  Runs go at once; the inner classes make the table of Latin-1 the first test."""
    return F.length(F.regexp_replace(text, rf"[[{_LATIN_PLAIN}][\p{{L}}\p{{N}}{SPACES}]]+", "")).cast("long")


def filled(ls: Column) -> Column:
    """The lines that aren't blank; most show it by their first character."""
    return F.filter(ls, lambda x: F.ascii(x).between(33, 126) | x.rlike(rf"[^{SPACES}]"))


def bullet_ratio(text: Column, full: Column | None = None) -> Column:
    full = filled(lines(text)) if full is None else full
    # no bullet begins with the characters from the colon on, as most lines do
    marked = lambda x: ~F.ascii(x).between(58, 126) & x.rlike(BULLET)
    return _over(F.size(F.filter(full, marked)).cast("double"), F.size(full))


def ellipsis_ratio(text: Column, full: Column | None = None) -> Column:
    full = filled(lines(text)) if full is None else full
    # the cheap test first: most lines hold no dots at their end
    dots = lambda x: (x.contains("...") | x.contains("…")) & x.rlike(rf"(?:\.\.\.|…)[{SPACES}]*$")
    return _over(F.size(F.filter(full, dots)).cast("double"), F.size(full))


#: Columns that several signals read, computed once by ``bound``.
BOUND = ("__split", "__lines", "__filled", "__words", "__letters")


def bound(df: DataFrame, text: str = "text") -> DataFrame:
    """df with BOUND: its lines, those that aren't blank, its number of words with that of stop words, and its letters.

    Each is a step of its own, since an expression that is named several times in one step is computed several times.
    """
    t = F.col(text)
    out = df.withColumn("__split", _split(t)).withColumn("__lines", lines(t, F.col("__split"))).withColumn("__filled", filled(F.col("__lines")))
    return out.withColumn("__words", words(t)).withColumn("__letters", F.aggregate("__words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)))


def gopher_flags(text: Column, have_bound: bool = False) -> dict[str, Column]:
    """have_bound: the row has the columns that ``bound`` adds."""
    if have_bound:
        n, stop, letters, full = F.size("__words").cast("long"), F.size(F.filter("__words", lambda w: w.isin(*STOP_WORDS))), F.col("__letters"), F.col("__filled")
    else:
        n, stop, letters, full = word_count(text), stop_word_count(text), letter_count(text), None
    size = F.length(text)
    mean = _over(letters.cast("double"), n)
    return {
        "min_words": n >= 50,
        "mean_word_len": (mean >= 3.0) & (mean <= 8.0),
        "symbol_ratio": _over(symbol_count(text).cast("double"), size) <= 0.15,
        "stopword_ratio": _over(stop.cast("double"), n) >= 0.20,
        "bullet_ratio": bullet_ratio(text, full) <= 0.50,
        "ellipsis_ratio": ellipsis_ratio(text, full) <= 0.30,
    }


def mean_of_flags(flags: list[Column]) -> Column:
    return sum((f.cast("int") for f in flags[1:]), flags[0].cast("int")) / len(flags)


def gopher_score(text: Column, have_bound: bool = False) -> Column:
    return mean_of_flags(list(gopher_flags(text, have_bound).values()))


def qc_tokens(text: Column) -> Column:
    """Tokens as the quality scorer estimates them: characters over four, at least one."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("long")


def token_ratio(text: Column, kind: str = "doc") -> Column:
    """Estimated characters a token, 2.8 to 4.6."""
    n = F.length(text)
    dense = (n_of(text, TOKEN_MARKS) + n_matches(text, r"\p{Nd}")) / n
    ratio = F.lit(3.2 if kind == "code" else 4.0) - 0.8 * dense + 0.2 * (n_of(text, " \n\t") / n)
    return F.when(text == "", 4.0).otherwise(F.least(F.lit(4.6), F.greatest(F.lit(2.8), ratio)))


def count_tokens(text: Column, kind: str = "doc") -> Column:
    return F.ceil(F.length(text) / token_ratio(text, kind)).cast("long")


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def repeats(text: Column, k: int = 16, most: int | None = None) -> Column:
    """Positions whose k characters occurred before, among the first ``most`` (None: all); higher-order form.  signals.py has the Arrow form, which is faster."""
    n = F.length(text) - k + 1
    n = n if most is None else F.least(n, F.lit(most))
    grams = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(k)))
    return F.when(F.length(text) < 2 * k, F.lit(0)).when(text.isNotNull(), F.size(grams) - F.size(F.array_distinct(grams))).cast("long")


def human_language(text: Column) -> Column:
    """'en' if the letters of the first 2048 characters are all ASCII and there is one, else null."""
    head = F.substring(text, 1, 2048)
    return F.when(head.rlike("[A-Za-z]") & ~head.rlike(r"[\p{L}&&[^A-Za-z]]"), "en")
