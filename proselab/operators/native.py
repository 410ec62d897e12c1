"""The rewrites of ``rewrite`` as built-in expressions: every stage, the whole scrub program and the post-processor.

A stage takes a text and gives a struct of the new text and the number of edits. Matches are rewritten one by one by
cutting a text at them and joining the pieces again with what each match becomes. Tables of rules are folds over
their numbers: a rule looks for its needle, a plain string that each of its matches holds, before it runs its pattern,
and patterns are literals, which Spark compiles once a task. Every intermediate text has a name of its own (a column
or a lambda's variable), so that no text is computed twice.

Most texts hold little for most stages to do, so a stage looks first, by a search that costs a small part of the
rewrite, whether there is any match; the sentences of a text and their numbers of words are found once for the three
stages that work on them, and again only behind a stage that changed the text.

Word and space classes follow Unicode. A null text counts as empty. The whole program as one Arrow function
(``rewrite.scrubbed``) gives the same rows and is the faster one, as Spark interprets folds row by row; single stages
here run inside any other expression, without a Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselab.functions import lexicon as lx
from proselab.functions import text as tx
from proselab.operators.rewrite import STAGES, ScrubConfig, _needle

#: Stands for a quoted span while a program runs; no rule matches it, adds it or takes it away.
SIGN = "\ue000"
MASKED = f"{lx.QUOTED}|[\ue000-\uf8ff]"
START = r"(?U)(?:\s(?<=[.!?]\s)\s*|^)[a-z]"
#: What every list of three has behind its first item.
_LISTED = r",\s+[\w-]+(?:\s[\w-]+){0,3},\s+(?:and|or)\s+[\w-]"
#: Every wrong article matches, and some right ones do.
_MISSAID = r"(?iU)a(?<!\wa)(?:\s+(?=[aeiou]|hour|hono)|n\s+(?=uni|use|europ|one|[a-z](?-i:(?<![aeiouAEIOU]))))"


let = tx.let


def result(text: Column, edits: Column) -> Column:
    return F.struct(text.alias("text"), edits.cast("int").alias("edits"))


def joined(gaps: Column, new: Column) -> Column:
    """The pieces of a text around its matches, with what the matches became between them."""
    return F.array_join(F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda gap, piece: F.concat(gap, piece)), "")


def rewritten(text: Column, pattern: str, of: Callable[[Column], Column]) -> Column:
    """T-11, T-12: every match of ``pattern`` becomes ``of(match)``. ``text`` is a column or a variable."""
    whole = lambda found: F.when(F.size(found) == 0, text).otherwise(joined(F.split(text, pattern, -1), F.transform(found, of)))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: result(whole(found), F.size(found)))


def replaced(text: Column, pattern: str, new: str) -> Column:
    """Every match of ``pattern`` becomes the string ``new``."""
    return result(F.regexp_replace(text, pattern, new.replace("\\", "\\\\").replace("$", "\\$")), F.regexp_count(text, F.lit(pattern)))


def is_upper(s: Column) -> Column:
    return (s == F.upper(s)) & (s != F.lower(s))


def in_case_of(found: Column, new: Column, capital: Column, upper: Column) -> Column:
    """T-09: the one of three forms that has the case of ``found``."""
    return F.when(is_upper(found), upper).when(is_upper(F.substring(found, 1, 1)), capital).otherwise(new)


#: How often signs come in a thousand of lower-cased prose; others are seldom.
OFTEN = dict(zip(" etaoinsrhldcumfpgwybv,k.", (170, 100, 75, 65, 62, 57, 57, 52, 50, 50, 33, 33, 25, 24, 20, 18, 17, 16, 18, 16, 12, 9, 10, 6, 10)))


def any_of(needles: Sequence[str]) -> str:
    """A pattern for any of the needles, tried only at signs that prose has seldom, of which each needle holds one."""
    rest, by = sorted(set(needles)), {}
    while rest:
        # the sign that stands for most needles for each time that it comes
        sign = max(sorted(set("".join(rest))), key=lambda c: sum(c in n for n in rest) / (OFTEN.get(c, 1) + 1))
        by[sign] = [n for n in rest if sign in n]
        rest = [n for n in rest if sign not in n]
    behind = lambda n, c: (f"\\Q{n.partition(c)[2]}\\E" if n.partition(c)[2] else "") + f"(?<=\\Q{n}\\E)"
    each = (f"{re.escape(c)}(?:{'|'.join(behind(n, c) for n in of)})" for c, of in by.items())
    return f"(?=[{''.join(map(re.escape, by))}])(?:{'|'.join(each)})"


def groups(needles: Sequence[str], size: int = 5) -> dict[str, list[str]]:
    """The needles by a piece that they hold, which begins, if it can, with a sign that prose has seldom."""
    rest, found = sorted(set(needles)), {}
    while rest:
        by: dict[str, list[str]] = {}
        for n in rest:
            for piece in {n[k : k + size] for k in range(len(n) - size + 1) if OFTEN.get(n[k].lower(), 1) < 30} or {n}:
                by.setdefault(piece, []).append(n)
        best = max(by, key=lambda piece: (len(by[piece]), piece))
        found[best] = by[best]
        rest = [n for n in rest if n not in by[best]]
    return found


def has_word(text: Column, needles: Sequence[str]) -> Column:
    """Whether a text holds any of the needles; for words and pairs of them, as ``has_phrase`` for longer ones."""
    found = F.lit(False)
    for piece, of in groups([n for n in needles if not any(m != n and m in n for m in needles)]).items():
        one = F.contains(text, F.lit(piece))
        found = found | (one if of == [piece] else one & tx.holds(text, of))
    return found


def has_phrase(text: Column, needles: Sequence[str]) -> Column:
    return text.rlike(any_of(needles))


def quick(pattern: str) -> str:
    """The same pattern, which most places of a text fail by their first sign and not by what stands before it."""
    pattern = pattern.replace(r"(?:^|(?<=[.!?])\s+)", r"(?:\s(?<=[.!?]\s)\s*|^)")
    return re.sub(r"^\\b([A-Za-z])", r"\1(?<!\\w\1)", pattern)


def fold(text: Column, rules: Sequence[tuple[str, Callable[[Column], Column]]], of: Callable[[Column, Column], Column] = lambda found, _: found, any_case: bool = True, some: Callable = has_word) -> Column:
    """Rules one after another on what the ones before left: (needle, what the rule finds in a text).

    ``of(found, number of the rule)`` is the rule's result, a struct of text and edits. Needles are looked for in the
    text in lower case, or as it is without ``any_case``; ``some`` tells whether there is any. ``text`` is a column or
    a variable.
    """
    key = F.lower if any_case else (lambda t: t)
    needles = F.array(*(F.lit(n) for n, _ in rules))

    def apply(state: Column, k: Column) -> Column:
        found = F
        for n, (_, rule) in enumerate(rules):
            found = found.when(k == n, rule(state["text"]))
        found = F.when(F.contains(state["low"], F.get(needles, k)), found)
        after = lambda s: F.struct(s["text"].alias("text"), key(s["text"]).alias("low"), (state["edits"] + s["edits"]).alias("edits"))
        return let(found, lambda x: F.when(x.isNull(), state).otherwise(let(of(x, k), after)))

    def applied(low: Column) -> Column:
        start = F.struct(text.alias("text"), low.alias("low"), F.lit(0).alias("edits"))
        whole = F.aggregate(F.sequence(F.lit(0), F.lit(len(rules) - 1)), start, apply, lambda s: result(s["text"], s["edits"]))
        # a text without any needle is left alone: no rule can make the first one
        return F.when(some(low, [n for n, _ in rules]), whole).otherwise(result(text, F.lit(0)))

    return let(key(text), applied)


def sentence_case(text: Column) -> Column:
    """T-10: the first letter of each sentence in upper case. ``text`` is a column or a variable."""
    some = F.substring(text, 1, 1).between("a", "z") | text.rlike(r"(?U)[.!?]\s+[a-z]")
    return F.when(some, rewritten(text, START, F.upper)["text"]).otherwise(text)


def single_spaced(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")).otherwise(text)


def tidy(text: Column) -> Column:
    """One space between words, none around, sentences capitalised."""
    return let(tx.strip(single_spaced(text)), sentence_case)


def pick(variants: Sequence[str], seed: int, rule: str, nth: Column) -> Column:
    """R-02, L-13: a variant by hash of seed, rule and occurrence."""
    if len(variants) == 1:
        return F.lit(variants[0])
    digest = F.md5(F.concat(F.lit(f"{seed}:{rule}:"), nth.cast("string")).cast("binary"))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*map(F.lit, variants)), (number % len(variants) + 1).cast("int"))


def varied(text: Column, table: Sequence[tuple[str, Sequence[str]]], seed: int) -> Column:
    """R-02, B-01: each occurrence of a string becomes one of its variants."""

    def said(parts: Column, k: Column) -> Column:
        new = lambda n: F.coalesce(*(F.when(k == at, pick(v, seed, w, n)) for at, (w, v) in enumerate(table)))
        return result(F.array_join(F.transform(parts, lambda s, n: F.when(n == 0, s).otherwise(F.concat(new(n - 1), s))), ""), F.size(parts) - 1)

    return fold(text, [(w, lambda t, w=w: F.split(t, rf"\Q{w}\E", -1)) for w, _ in table], said, any_case=False)


def drop_transitions(text: Column) -> Column:
    """R-01: connectors are dropped at the start of sentences, four of them anywhere."""
    at_start = r"(?:^|(?<=[.!?])\s+){}\s+"
    rules = [(w, p) for w in lx.DROPPED_CONNECTORS for p in (at_start.format(w), rf"\b{w}\s+")] + [(w, at_start.format(w)) for w in lx.DROPPED_CONCLUDERS]
    found = [(w, lambda t, p=p: replaced(t, "(?U)" + quick(p), " ")) for w, p in rules]
    return let(tidy(text), lambda t: fold(t, found, lambda s, _: result(tidy(s["text"]), s["edits"]), any_case=False))


def soften_transitions(text: Column, seed: int = 0) -> Column:
    """R-02."""
    return varied(text, lx.SOFTENED, seed)


def drop_hedges(text: Column) -> Column:
    """R-03."""
    dropped = fold(text, [(h.lower(), lambda t, h=h: replaced(t, rf"(?iU)\Q{h}\E", "")) for h in lx.HEDGES_DROPPED], some=has_phrase)
    return let(dropped, lambda s: result(let(single_spaced(s["text"]), sentence_case), s["edits"]))


def swap_phrases(text: Column) -> Column:
    """R-04."""
    return fold(text, [(a.lower(), lambda t, a=a, b=b: replaced(t, rf"(?iU)\Q{a}\E", b)) for a, b in lx.PHRASES], some=has_phrase)


def _in_case(text: Column, table: Sequence[tuple[str, str]], keep_case: bool) -> Column:
    if not keep_case:
        return fold(text, [(_needle(p), lambda t, p=p, r=r: replaced(t, "(?iU)" + quick(p), r)) for p, r in table])
    forms = [F.array(*(F.lit(form(r)) for _, r in table)) for form in (str, lambda r: r[:1].upper() + r[1:], str.upper)]

    def found(pattern: str) -> Callable[[Column], Column]:
        return lambda t: F.struct(F.split(t, pattern, -1).alias("gaps"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("found"))

    def said(x: Column, k: Column) -> Column:
        return result(joined(x["gaps"], F.transform(x["found"], lambda m: in_case_of(m, *(F.get(f, k) for f in forms)))), F.size(x["found"]))

    return fold(text, [(_needle(p), found("(?iU)" + quick(p))) for p, _ in table], said)


def swap_favourites(text: Column, keep_case: bool = True) -> Column:
    """R-05, T-09."""
    return _in_case(text, lx.FAVOURITE_SWAPS, keep_case)


def contract(text: Column, keep_case: bool = True) -> Column:
    """R-06, T-09."""
    return _in_case(text, lx.CONTRACTIONS, keep_case)


def thin_dashes(text: Column) -> Column:
    """R-07: dashes become commas, or full stops before a capital and four words or more."""

    def thinned(parts: Column) -> Column:
        rest = F.filter(F.transform(F.slice(parts, 2, 2**30), tx.strip), lambda r: r != "")
        starts = lambda r: is_upper(F.substring(r, 1, 1)) & (tx.word_count(r) >= 4)
        whole = lambda rest: F.concat(
            F.regexp_replace(parts[0], r"(?U)\s+$", ""), F.array_join(F.transform(rest, lambda r: F.concat(F.when(starts(r), ". ").otherwise(", "), r)), "")
        )
        out = let(rest, lambda rest: result(let(F.regexp_replace(whole(rest), r"(?U),\s*,", ","), sentence_case), F.size(rest)))
        return F.when(F.size(parts) < 2, result(text, F.lit(0))).otherwise(out)

    whole = let(F.split(F.replace(text, F.lit("--"), F.lit("—")), "—", -1), thinned)
    return F.when(tx.holds(text, ("--", "—")), whole).otherwise(result(text, F.lit(0)))


def break_lists(text: Column) -> Column:
    """R-08: the third of three items becomes a sentence of its own."""
    pattern = "(?U)" + lx.LIST_OF_THREE
    group = lambda m, k: F.regexp_extract(m, pattern, k)
    whole = rewritten(text, pattern, lambda m: F.concat(group(m, 1), F.lit(" "), group(m, 3), F.lit(" "), group(m, 2), F.lit(". "), tx.capitalised(group(m, 4))))
    return F.when(tx.plainly(text, lambda flags: text.rlike(f"(?{flags})" + _LISTED)), whole).otherwise(result(text, F.lit(0)))


def ended(s: Column) -> Column:
    return F.when(s.rlike(r"[.!?]$"), s).otherwise(F.concat(s, F.lit(".")))


def _pair(left: Column, right: Column) -> Column:
    return F.array(ended(tx.strip(left)), ended(tx.capitalised(tx.strip(right))))


def cut(sentence: Column, pattern: str = lx.COORDINATOR) -> Column:
    """T-21: the sentences left and right of the first match, or the one where there is none or a side is empty."""

    def pieces(sides: Column) -> Column:
        whole = (F.size(sides) == 2) & (tx.strip(sides[0]) != "") & (tx.strip(F.get(sides, F.lit(1))) != "")
        return F.when(whole, _pair(sides[0], F.get(sides, F.lit(1)))).otherwise(F.array(sentence))

    return let(F.split(sentence, "(?U)" + pattern, 2), pieces)


def lines(text: Column) -> Column:
    """T-01, T-03: struct of text, the sentences of a text joined by spaces, and lines, each with its words (s, n)."""

    def counted(sents: Column, whole: Column) -> Column:
        # sentences have words and no space around them
        by_space = lambda of: F.transform(sents, lambda s: F.struct(s.alias("s"), (tx.spaces(of(s)) + 1).alias("n")))
        odd = F.contains(whole, F.lit("  ")) | tx.plainly(whole, lambda flags: whole.rlike(rf"(?{flags})[^\S ]"))
        return F.struct(whole.alias("text"), F.when(odd, by_space(lambda s: F.regexp_replace(s, tx.NOT_ONE_SPACE, " "))).otherwise(by_space(lambda s: s)).alias("lines"))

    return let(tx.sentences(text), lambda sents: let(F.array_join(sents, " "), lambda whole: counted(sents, whole)))


def _spoken(lines: Column) -> Column:
    return F.transform(lines, lambda x: x["s"])


def _cut_long(lines: Column, most: int) -> Column:
    return F.flatten(F.transform(lines, lambda x: F.when(x["n"] > most, cut(x["s"])).otherwise(F.array(x["s"]))))


def _split_long(text: Column, found: Column, most: int) -> Column:
    lines = found["lines"]
    parts = let(_cut_long(lines, most), lambda parts: result(F.array_join(parts, " "), F.size(parts) - F.size(lines)))
    return F.when(F.exists(lines, lambda x: x["n"] > most), parts).otherwise(result(found["text"], F.lit(0)))


def split_long(text: Column, most: int = 28) -> Column:
    """R-09, B-02: sentences of more words are cut at their first coordinating conjunction."""
    return let(lines(text), lambda found: _split_long(text, found, most))


def _merge_short(text: Column, found: Column, least: int) -> Column:
    lines = found["lines"]

    def zipped(short: Column) -> Column:
        behind = F.concat(F.array(F.lit(False)), F.slice(short, 1, F.greatest(F.size(short) - 1, F.lit(0))))
        ahead = F.concat(F.slice(short, 2, 2**30), F.array(F.lit(False)))
        return F.arrays_zip(_spoken(lines).alias("s"), short.alias("short"), behind.alias("behind"), ahead.alias("ahead"))

    def said(x: Column, n: Column) -> Column:
        joins, goes_on = x["short"] & x["behind"], x["short"] & x["ahead"]
        lead = F.when(n == 0, "").when(joins, ", ").otherwise(" ")
        bare = F.regexp_replace(x["s"], r"[.!?]+$", "")
        return F.concat(lead, F.when(goes_on, bare).when(joins, F.concat(bare, F.lit("."))).otherwise(x["s"]))

    def merged(short: Column) -> Column:
        return let(zipped(short), lambda z: result(F.array_join(F.transform(z, said), ""), F.size(F.filter(z, lambda x: x["short"] & x["behind"]))))

    # two short ones side by side, as a string of marks
    marks = F.array_join(F.transform(lines, lambda x: F.when(x["n"] < least, "s").otherwise("l")), "")
    some = F.when(F.contains(marks, F.lit("ss")), let(F.transform(lines, lambda x: x["n"] < least), merged))
    return F.when(F.size(lines) < 3, result(text, F.lit(0))).otherwise(F.coalesce(some, result(found["text"], F.lit(0))))


def merge_short(text: Column, least: int = 5) -> Column:
    """R-10, L-03: runs of sentences of fewer words become one, with commas; a text of two sentences stays."""
    return let(lines(text), lambda found: _merge_short(text, found, least))


def spread(counts: Column) -> Column:
    """Standard deviation over mean of whole numbers, 0 for a mean of 0."""
    mean = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) / F.size(counts)
    squares = lambda m: F.aggregate(counts, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
    return let(mean, lambda m: F.when(m == 0, F.lit(0.0)).otherwise(F.sqrt(squares(m) / F.size(counts)) / m))


def _cut_somewhere(sentence: Column, words: int) -> Column:
    """The two sentences at the first of CUTS that leaves enough words on either side, or null."""
    found = []
    for p in lx.CUTS:
        fits = lambda sides: F.when((F.size(sides) == 2) & (tx.word_count(sides[0]) >= words) & (tx.word_count(F.get(sides, F.lit(1))) >= words), _pair(sides[0], F.get(sides, F.lit(1))))
        found.append(let(F.split(sentence, "(?U)" + p, 2), fits))
    return F.coalesce(*found)


def _vary_lengths(text: Column, found: Column, least: float, tries: int, words: int) -> Column:
    lines = found["lines"]
    count = lambda sents: F.transform(sents, tx.word_count)

    def attempt(state: Column, _: Column) -> Column:
        def longest(counts: Column) -> Column:
            at = F.array_position(counts, F.array_max(counts)).cast("int")
            pair = let(F.element_at(state["sents"], at), lambda s: _cut_somewhere(s, words))
            around = lambda pair: F.concat(F.slice(state["sents"], F.lit(1), at - 1), pair, F.slice(state["sents"], at + 1, F.lit(2**30)))
            put = lambda pair: F.struct(around(pair).alias("sents"), (state["edits"] + 1).alias("edits"))
            return F.when(spread(counts) < least, let(pair, lambda p: F.when(p.isNull(), state).otherwise(put(p)))).otherwise(state)

        return let(count(state["sents"]), longest)

    def evened(sents: Column) -> Column:
        start = F.struct(sents.alias("sents"), F.lit(0).alias("edits"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(tries)), start, attempt, lambda s: result(F.array_join(s["sents"], " "), s["edits"]))

    even = F.when(F.size(lines) >= 4, let(F.transform(lines, lambda x: x["n"]), spread) < least).otherwise(False)
    return F.when(even, let(_spoken(lines), evened)).otherwise(result(text, F.lit(0)))


def vary_lengths(text: Column, least: float = 0.35, tries: int = 4, words: int = 4) -> Column:
    """R-11: where sentences are of even length, up to ``tries`` times the longest is cut at its most natural place."""
    return let(lines(text), lambda found: _vary_lengths(text, found, least, tries, words))


def collapse_stems(text: Column) -> Column:
    """R-12, T-20."""
    # each edit takes one word away
    whole = let(tx.collapsed_stems(text), lambda t: result(t, tx.words_by_spaces(text) - tx.words_by_spaces(t)))
    return F.when(tx.plainly(text, lambda flags: text.rlike(f"(?i{flags})" + tx.SAME_STEM)), whole).otherwise(result(text, F.lit(0)))


def right_articles(text: Column) -> Column:
    """R-13: a or an, by the next word. The edits count right articles too, where any may be wrong; nothing reads them."""
    pattern = "(?iU)(?=a)" + lx.ARTICLE

    def fixed(m: Column) -> Column:
        group = lambda k: F.regexp_extract(m, pattern, k)
        word = F.lower(group(3))
        vowel = F.when(word.rlike("^(uni|use|europ|one)"), False).when(word.rlike("^(hour|honest$|honou?r$|honesty$)"), True).otherwise(word.rlike("^[aeiou]"))
        right = F.when(vowel, F.when(is_upper(F.substring(m, 1, 1)), "An").otherwise("an")).otherwise(F.when(is_upper(F.substring(m, 1, 1)), "A").otherwise("a"))
        return F.when(F.lower(right) == F.lower(group(1)), m).otherwise(F.concat(right, group(2), group(3)))

    return F.when(text.rlike(_MISSAID), rewritten(text, pattern, fixed)).otherwise(result(text, F.lit(0)))


def closed(text: Column) -> Column:
    """T-22: what every program ends with: spacing, capitals, articles, and no comma after a full stop."""
    return let(tidy(text), lambda t: F.regexp_replace(right_articles(t)["text"], r"(?U)\.\s*,\s*", ". "))


def masked(text: Column) -> Column:
    """R-15: every double-quoted span, and every private-use sign, as one sign."""
    return F.when(_quoted(text), F.regexp_replace(text, MASKED, SIGN)).otherwise(text)


def _quoted(text: Column) -> Column:
    return tx.holds(text, ('"', "“")) | text.rlike("[\ue000-\uf8ff]")


def spans(text: Column) -> Column:
    return F.when(_quoted(text), F.regexp_extract_all(text, F.lit(MASKED), F.lit(0))).when(text.isNotNull(), F.array().cast("array<string>"))


def unmasked(text: Column, held: Column) -> Column:
    """The text with its signs turned back to the spans, in order."""
    whole = F.array_join(F.zip_with(F.split(text, SIGN, -1), F.concat(held, F.array(F.lit(""))), lambda gap, span: F.concat(gap, span)), "")
    return F.when(F.size(held) == 0, text).otherwise(whole)


def stages(how: ScrubConfig = ScrubConfig()) -> dict[str, Callable[[Column], Column]]:
    """The program's stages in order, without those that are off."""
    found = (
        drop_transitions, lambda t: soften_transitions(t, how.seed), drop_hedges, swap_phrases, lambda t: swap_favourites(t, how.keep_case), lambda t: contract(t, how.keep_case), thin_dashes, break_lists,
        lambda t: split_long(t, how.long_words), lambda t: merge_short(t, how.short_words), lambda t: vary_lengths(t, how.least_spread), collapse_stems,
    )
    off = how.off | ({"variance_inject"} if "sentence_split" in how.off else set())
    return {name: f for name, f in zip(STAGES, found) if name not in off}


def _each(df: DataFrame, text: str, steps: dict[str, Callable[[Column], Column]], on_lines: dict[str, Callable[[Column, Column], Column]] = {}) -> DataFrame:
    """``df`` with ``_t``, the text after all steps, and ``_n_<step>``, its edits; every step is a column of its own.

    Steps that ``on_lines`` has by name, one behind another, get the text's lines beside it.
    """
    out = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    for name, stage in steps.items():
        if name in on_lines:
            # a step without edits leaves the lines as they are
            again = F.when(F.col("_n") == 0, F.col("_lines")).otherwise(lines(F.col("_t"))) if "_lines" in out.columns else lines(F.col("_t"))
            out = out.withColumn("_lines", again)
            s = on_lines[name](F.col("_t"), F.col("_lines"))
        else:
            s = stage(F.col("_t"))
        out = out.withColumn("_s", s).withColumns({"_t": F.col("_s.text"), f"_n_{name}": F.col("_s.edits"), "_n": F.col("_s.edits")}).drop("_s")
    return out.drop("_lines", "_n")


def scrubbed(df: DataFrame, text: str = "text", how: ScrubConfig = ScrubConfig()) -> DataFrame:
    """``df`` with rewrite, edits and edits_by_kind, as ``rewrite.scrubbed`` gives them."""
    steps, own = stages(how), F.coalesce(F.col(text), F.lit(""))
    on_lines = {
        "sentence_split": lambda t, found: _split_long(t, found, how.long_words), "sentence_merge": lambda t, found: _merge_short(t, found, how.short_words),
        "variance_inject": lambda t, found: _vary_lengths(t, found, how.least_spread, 4, 4),
    }
    out = _each(df.withColumn("_spans", spans(own)).withColumn("_m", masked(own)), "_m", steps, on_lines)
    counts = {name: F.col(f"_n_{name}") for name in steps}
    made = F.map_filter(F.create_map(*(x for name, n in counts.items() for x in (F.lit(name), n))) if counts else F.create_map().cast("map<string,int>"), lambda _, n: n > 0)
    total = sum(counts.values(), F.lit(0))
    out = out.withColumn("_c", closed(F.col("_t"))).withColumns({"rewrite": unmasked(F.col("_c"), F.col("_spans")), "edits": total, "edits_by_kind": made})
    return out.select(*df.columns, "rewrite", "edits", "edits_by_kind")


def vary_transitions(text: Column, seed: int = 0) -> Column:
    """B-01."""
    return varied(text, lx.TRANSITION_VARIANTS, seed)


def gather_short(text: Column, most: int = 28, least: int = 6) -> Column:
    """B-02, B-03: long sentences cut, then runs of short ones joined, up to twice ``least`` words each."""

    none = F.array().cast("array<string>")
    now = lambda out, held, words: F.struct(out.alias("out"), held.alias("held"), words.alias("words"))

    def add(state: Column, s: Column) -> Column:
        n = tx.word_count(s)
        short, full = n < least, state["words"] + n >= 2 * least
        held = F.concat(state["held"], F.array(F.regexp_replace(s, r"\.+$", "")))
        flushed = F.when(F.size(state["held"]) > 0, F.concat(state["out"], F.array(F.concat(F.array_join(state["held"], " "), F.lit("."))))).otherwise(state["out"])
        done = F.concat(state["out"], F.array(F.concat(F.array_join(held, " "), F.lit("."))))
        return (
            F.when(~short, now(F.concat(flushed, F.array(s)), none, F.lit(0)))
            .when(full, now(done, none, F.lit(0)))
            .otherwise(now(state["out"], held, state["words"] + n))
        )

    start = now(none, none, F.lit(0))
    last = lambda s: F.when(F.size(s["held"]) > 0, F.concat(s["out"], F.array(F.concat(F.array_join(s["held"], " "), F.lit("."))))).otherwise(s["out"])
    whole = lambda parts: F.aggregate(parts, start, add, lambda s: F.array_join(last(s), " "))
    return let(lines(text)["lines"], lambda found: let(_cut_long(found, most), lambda parts: result(whole(parts), F.size(parts) - F.size(found))))


def plain_contractions(text: Column) -> Column:
    """B-04."""
    return fold(text, [(_needle(p), lambda t, p=p, r=r: replaced(t, "(?iU)" + quick(p), r)) for p, r in lx.PLAIN_CONTRACTIONS])


def postprocessed(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with bursty: the text after B-01 to B-04, as ``rewrite.postprocessed`` gives it."""
    out = _each(df, text, {"vary": vary_transitions, "gather": gather_short, "contract": plain_contractions})
    return out.select(*df.columns, F.col("_t").alias("bursty"))
