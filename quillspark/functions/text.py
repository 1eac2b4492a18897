"""Lines, words and n-grams of text columns.

An n-gram is a string of its words with single spaces between them: no tokeniser leaves a space in a word, so this is as good a
key as an array of the words and cheaper to hash, compare and shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOS, EOS, UNK = "<s>", "</s>", "<unk>"
SPECIAL = (UNK, BOS, EOS)


def lines(text: Column) -> Column:
    """Lines of a text, each ended by a line feed; the last may lack it. Null for null; an empty text is one blank line."""
    return F.split(F.regexp_replace(text, "\n\\z", ""), "\n", -1)


def _words(line: Column, gap: str) -> Column:
    return F.filter(F.split(line, gap, -1), lambda x: x != "")


def train_words(line: Column, skip_symbols: bool = True) -> Column:
    """Words as estimation sees them: between NUL, TAB, CR and space. VT and FF belong to words.

    The special words are not allowed in training text: they are dropped like spaces, or raise if ``skip_symbols`` is off.
    """
    w = _words(line, "[\\x00\\t\\r ]+")
    if skip_symbols:
        return F.filter(w, lambda x: ~x.isin(*SPECIAL))
    return F.transform(w, lambda x: F.when(x.isin(*SPECIAL), F.raise_error(F.concat(F.lit("special word in the text: "), x)).cast("string")).otherwise(x))


def query_words(line: Column) -> Column:
    """Words as scoring sees them: between space, TAB, LF, VT, FF and CR."""
    return _words(line, "[ \\t\\n\\x0B\\f\\r]+")


def space_words(line: Column) -> Column:
    """Words as filters see them: between single spaces, empty ones skipped."""
    return _words(line, " ")


def padded(words: Column, order: int) -> Column:
    """order - 1 begin markers, the words, one end marker; a blank line is a sentence too."""
    return F.concat(F.array_repeat(F.lit(BOS), max(0, order - 1)), words, F.array(F.lit(EOS)))


def ngrams(words: Column, order: int) -> Column:
    """All runs of ``order`` words."""
    if order == 1:
        return words
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - order), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(order)]))
    return F.when(F.size(words) >= order, grams).otherwise(F.array().cast("array<string>"))


def context(g: Column, order: int) -> Column:
    """All words but the last."""
    return F.substring_index(g, " ", order - 1) if order > 1 else F.lit("")


def suffix(g: Column) -> Column:
    """All words but the first."""
    return F.when(F.instr(g, " ") > 0, F.substring(g, F.instr(g, " ") + 1, F.length(g))).otherwise("")


def first(g: Column) -> Column:
    return F.substring_index(g, " ", 1)


def last(g: Column) -> Column:
    return F.substring_index(g, " ", -1)


def length(g: Column) -> Column:
    """Number of words."""
    return F.when(g == "", 0).otherwise(F.length(g) - F.length(F.replace(g, F.lit(" "), F.lit(""))) + 1)


def is_tag(word: Column) -> Column:
    """A word in angle brackets, which filters let pass."""
    return word.startswith("<") & word.endswith(">")


def suffix_order(g: Column) -> Column:
    """A sort key that compares from the last word to the first; the shorter of equal ends first."""
    return F.reverse(F.split(g, " "))


def context_order(g: Column) -> Column:
    """A sort key that compares from the last but one word to the first, then the last word."""
    w = F.split(g, " ")
    return F.concat(F.reverse(F.slice(w, F.lit(1), F.size(w) - 1)), F.slice(w, -1, 1))


def prefix_order(g: Column) -> Column:
    """A sort key that compares from the first word to the last."""
    return F.split(g, " ")


def combined_key(g: Column) -> Column:
    """A 64-bit key of an n-gram."""
    return F.xxhash64(g)


def trimmed(x: Column) -> Column:
    return F.trim(x)


def byte_size(text: str, total: int | None = None, unit: str = "K") -> int:
    """Bytes of a size like 1G, 512M, 80% (of ``total``) or, without a unit, of ``unit``."""
    t = text.strip()
    if not t:
        raise ValueError("an empty size")
    if t.endswith("%"):
        if total is None:
            raise ValueError("a share of an unknown total")
        return int(total * float(t[:-1]) / 100)
    scale = {"b": 1, "K": 1 << 10, "k": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40, "P": 1 << 50}
    if t[-1] in scale:
        return int(float(t[:-1]) * scale[t[-1]])
    if t[-1].isdigit():
        return int(float(t) * scale[unit])
    raise ValueError(f"unknown unit in {text!r}")
