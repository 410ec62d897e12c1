"""Column functions over texts: tokens, sentences, counts and small rewrites (T-01 to T-27).

All are built-in expressions. Word and space classes follow Unicode, as in Python's ``re``: patterns start with
``(?U)``. A null text gives null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode's white space, what ``(?U)\\s`` matches.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def plainly(text: Column, of: Callable[[str], Column]) -> Column:
    """``of(flags)`` for a pattern's flags: Unicode's classes cost several times the plain ones, which are the same in ASCII."""
    return F.when(is_ascii(text), of("")).otherwise(of("U"))


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with the value computed once however often ``of`` uses it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def strip(text: Column | str) -> Column:
    return F.btrim(col(text), F.lit(SPACES))


def either(patterns: Iterable[str]) -> str:
    """A pattern for any of ``patterns``, without regard to case, that tries their common beginnings once.

    Of two that begin alike the longer one is tried first. A pattern with more than plain characters, escapes and quotes
    stays whole.
    """

    def signs(p: str) -> list[str]:
        if p.startswith("\\Q") and p.endswith("\\E"):
            p = re.escape(p[2:-2])
        whole = re.search(r"(?<!\\)[][(){}*+?|^$.]", p)
        return [f"(?:{p})"] if whole else [x if x[0] == "\\" else x.lower() for x in re.findall(r"\\.|[^\\]", p)]

    def tree(rest: list[list[str]]) -> str:
        by: dict[str, list[list[str]]] = {}
        for r in filter(None, rest):
            by.setdefault(r[0], []).append(r[1:])
        parts = [first + tree(then) for first, then in by.items()]
        if all(rest):
            return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
        return f"(?:{'|'.join(parts)})?" if parts else ""

    return tree([signs(p) for p in patterns])


#: What of a lower-cased text may stand for an ASCII letter in patterns that fold Unicode's cases.
FOLDED = ("\u017f", "\u0131", "\u0307")


def holds(low: Column | str, pieces: Iterable[str]) -> Column:
    """Whether a text holds any of the pieces."""
    found = F.lit(False)
    for p in pieces:
        found = found | F.contains(col(low), F.lit(p))
    return found


def sentences(text: Column | str, openers: str = "A-Z\"'(") -> Column:
    """T-01, T-02: cut at white space behind a full stop, exclamation or question mark and before an opener."""
    # the look behind is only at white space
    cut = rf"\s(?<=[.!?]\s)\s*(?=[{openers}])"
    parts = let(strip(text), lambda t: plainly(t, lambda flags: F.split(t, f"(?{flags}){cut}")))
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(r"(?U)\S+"), F.lit(0))


def word_count(text: Column | str) -> Column:
    """T-03."""
    return F.regexp_count(col(text), F.lit(r"(?U)\S+"))


#: A run of white space other than one space.
NOT_ONE_SPACE = r"(?U)\s(?:(?<! )\s*|\s+)"
_NOT_ONE_SPACE_ASCII = r"[\t-\r]\s*| \s+"


def spaces(text: Column | str) -> Column:
    return F.octet_length(col(text)) - F.octet_length(F.replace(col(text), F.lit(" "), F.lit("")))


def words_by_spaces(text: Column | str) -> Column:
    """T-03 of long texts: the same number by the white space between words, without a string for each word."""
    single = let(strip(text), lambda t: plainly(t, lambda flags: F.regexp_replace(t, NOT_ONE_SPACE if flags else _NOT_ONE_SPACE_ASCII, " ")))
    return let(single, lambda t: F.when(t == "", 0).otherwise(spaces(t) + 1))


def tokens(text: Column | str) -> Column:
    """T-04: lower-cased runs of ASCII letters with inner apostrophes and hyphens."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z][a-z'-]*"), F.lit(0))


def first_words(text: Column | str, most: int = 512) -> Column:
    """D-02: the text up to the end of its first ``most`` words, what a model with that window sees of it."""
    return F.regexp_extract(col(text), rf"(?sU)\A\s*(?:\S+\s+){{0,{most - 1}}}\S*", 0)


def ngrams(items: Column | str, n: int = 4, of=lambda piece: F.concat_ws(" ", piece), kind: str = "string") -> Column:
    """T-05: the runs of n items, joined by spaces or as what ``of`` makes of them."""
    items = col(items)
    last = F.size(items) - (n - 1)
    none = F.array().cast(f"array<{kind}>")
    return F.when(last < 1, none).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: of(F.slice(items, i, n))))


def count_of(text: Column | str, piece: str) -> Column:
    """T-06: occurrences that don't overlap."""
    text = col(text)
    shorter = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(piece), F.lit("")))
    # most texts have none, and a look for one costs a tenth of the replacement
    return F.when(F.contains(text, F.lit(piece)), (shorter / F.lit(len(piece.encode()))).cast("int")).when(text.isNotNull(), 0)


def count_all(text: Column | str, pieces) -> Column:
    total = F.lit(0)
    for p in pieces:
        total = total + count_of(text, p)
    return total


def is_ascii(text: Column | str) -> Column:
    return F.octet_length(col(text)) == F.length(col(text))


def matches(text: Column | str, pattern: str, any_case: bool = False, low: Column | None = None, hints: Iterable[str] = ()) -> Column:
    """T-07. With ``hints``, pieces of which every match in any case has one, texts without any, by their lower-cased form ``low``, are not searched."""
    if any_case and pattern.startswith(r"\b"):
        # no word begins behind one of these; the look is cheaper than at Unicode's word bounds
        pattern = "(?-iuU:(?<![a-zA-Z0-9_]))" + pattern
    # Unicode's classes and cases cost several times the plain ones, and are the same in ASCII
    found = F.when(is_ascii(text), F.regexp_count(col(text), F.lit(("(?i)" if any_case else "") + pattern)))
    found = found.otherwise(F.regexp_count(col(text), F.lit(("(?iuU)" if any_case else "(?U)") + pattern)))
    return F.when(holds(low, (*hints, *FOLDED)), found).when(low.isNotNull(), 0) if hints else found


def logistic(x: Column, middle: float, steep: float = 8.0) -> Column:
    """T-08."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-steep) * (x - middle)))


def capitalised(text: Column | str) -> Column:
    """The first character in upper case."""
    text = col(text)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2**30))


def length_ratio(rewrite: Column | str, original: Column | str) -> Column:
    """T-13: words of the rewrite for each word of the original."""
    return F.greatest(words_by_spaces(rewrite), F.lit(1)) / F.greatest(words_by_spaces(original), F.lit(1))


def unmarked_wiki(text: Column | str, join_space: bool = True) -> Column:
    """T-14: wiki markup removed: header lines, citations, tags and the escapes of hyphen, comma and full stop.

    With ``join_space``, white space before a tag goes with it.
    """
    out = F.regexp_replace(col(text), r"(?m)^\s*=+.*=+\s*$", "")
    out = F.regexp_replace(out, r"\[ ?\d+ ?\]", "")
    out = F.regexp_replace(out, r"\s*<[^>]+>" if join_space else "<[^>]+>", "")
    for mark in "-,.":
        out = F.replace(out, F.lit(f" @{mark}@ "), F.lit(mark))
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def plain_number(text: Column | str) -> Column:
    """T-15."""
    return F.replace(F.lower(F.regexp_replace(strip(text), r"(?U)\s+", " ")), F.lit(","), F.lit(""))


def joined_digits(text: Column | str) -> Column:
    """T-16: commas between digits go, in one pass."""
    return F.regexp_replace(col(text), r"(\d),(\d)", "$1$2")


def fenced(instruction: str, text: Column | str) -> Column:
    """T-17: a prompt with the text between fences."""
    return F.concat(F.lit(instruction + "\n\n---\n"), col(text), F.lit("\n---"))


def chat(system: str, user: Column | str, assistant: Column | str) -> Column:
    """T-18: the three turns of a training example."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", col(user)), turn("assistant", col(assistant)))


def rendered(turns: Column, open_answer: bool = False) -> Column:
    """T-18: turns as one string; with ``open_answer`` only up to where the assistant's answer begins."""
    begin, end = "<|im_start|>", "<|im_end|>\n"
    whole = F.transform(turns, lambda t: F.concat(F.lit(begin), t["role"], F.lit("\n"), t["content"], F.lit(end)))
    if not open_answer:
        return F.array_join(whole, "")
    return F.concat(F.array_join(F.slice(whole, 1, 2), ""), F.lit(begin + "assistant\n"))


def masked_lengths(whole: Column, prompt: Column, most: int) -> Column:
    """T-18: struct of input (tokens after truncation from the end), masked (those of the prompt) and learned ones.

    ``whole`` and ``prompt`` are the numbers of tokens of the rendered example and of its part before the answer.
    """
    n = F.least(whole, F.lit(most))
    masked = F.least(prompt, n)
    return F.struct(n.alias("input"), masked.alias("masked"), (n - masked).alias("learned"))


#: A word, and the beginning of the next one where it is the same.
SAME_STEM = r"\b(\w{4})\w*+\s++\1"


def collapsed_stems(text: Column | str) -> Column:
    """T-20: of two adjacent words with a common beginning of four letters or more the first stays."""
    # four letters tell, and words are whole, so nothing is tried twice
    return plainly(col(text), lambda flags: F.regexp_replace(col(text), rf"(?i{flags})\b((\w{{4}})\w*+)\s++\2\w*+", "$1"))


def preview(text: Column | str, n: int = 80) -> Column:
    """T-23."""
    text = col(text)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def bar(value: Column | str, width: int = 20) -> Column:
    """T-24."""
    return F.repeat(F.lit("█"), F.floor(col(value) * width).cast("int"))


def sparkline(value: Column | str) -> Column:
    """T-24: one of eight levels for a value from 0 to 1."""
    return F.element_at(F.array(*map(F.lit, "▁▂▃▄▅▆▇█")), F.least(F.greatest(F.floor(col(value) * 8), F.lit(0)), F.lit(7)).cast("int") + 1)


#: T-25: seconds of the units of a rate.
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def rate(spec: Column | str) -> Column:
    """T-25: struct of count and seconds of ``N/unit``; an unknown unit or shape is an error."""
    spec = strip(spec)
    n, unit = F.regexp_extract(spec, r"^(\d+)\s*/\s*(\w+)$", 1), F.lower(F.regexp_extract(spec, r"^(\d+)\s*/\s*(\w+)$", 2))
    seconds = F.lit(None).cast("int")
    for name, s in UNITS.items():
        seconds = F.when(unit == name, F.lit(s)).otherwise(seconds)
    fail = F.raise_error(F.concat(F.lit("not a rate: "), spec)).cast("int")
    return F.struct(F.when(n == "", fail).otherwise(n.try_cast("int")).alias("n"), F.coalesce(seconds, fail).alias("seconds"))


def duration(seconds: Column | str) -> Column:
    """T-26: 42s, 3m 7s or 2h 5m."""
    s = F.floor(col(seconds)).cast("long")
    part = lambda a, b, x, y: F.concat(a.cast("string"), F.lit(x + " "), b.cast("string"), F.lit(y))
    h, m = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, part(m, s % 60, "m", "s")).otherwise(part(h, m, "h", "m"))


def completion_text(raw: Column | str) -> Column:
    """T-27: the content of a chat completion given as JSON, or the string itself."""
    raw = col(raw)
    found = F.coalesce(F.get_json_object(raw, "$[0].content"), F.get_json_object(raw, "$[0][0].content"))
    return F.when(raw.startswith("["), F.coalesce(found, raw)).otherwise(raw)
