"""clean_text: the ordered clean-up and rejection pipeline for recognised lines.

Rejection steps read the text more than once. Each binds it with let(), so that
the expression grows by a constant with every step and stays small when the
optimizer copies it into a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import lexicon
from pageloom.functions.text import SOUND_RUN, digits, fix_digit_misreads, let, letters, words

SPACES = r"(?U)\s+"


def _if_any(t: Column, parts, change) -> Column:
    """change(t) where t holds one of the parts, else t: a search for fixed parts is far cheaper than a pattern."""
    return let(t, lambda v: F.when(_any(v, parts), change(v)).otherwise(v))


def _any(t: Column, parts) -> Column:
    found = t.contains(parts[0])
    for part in parts[1:]:
        found = found | t.contains(part)
    return found


def _if_upper(t: Column, parts, change) -> Column:
    """change(t) where t holds one of the parts in any case, else t. t is ASCII."""
    return let(t, lambda v: F.when(let(F.upper(v), lambda u: _any(u, parts)), change(v)).otherwise(v))


def _chain(rules):
    def change(t: Column) -> Column:
        for pattern, new in rules:
            t = F.regexp_replace(t, pattern, new)
        return t

    return change


def _rewrites(t: Column) -> Column:
    """C07-C17: lookalikes, ASCII only, apostrophes, stray tokens, letter runs. White space is single spaces from here on."""
    t = F.translate(t, *lexicon.LOOKALIKES)
    t = let(t, lambda v: F.when(v.rlike(r"[^\x00-\x7F]"), F.trim(F.regexp_replace(F.regexp_replace(v, r"[^\x00-\x7F]+", ""), SPACES, " "))).otherwise(v))
    t = _if_any(t, (" ' ",), _chain(lexicon.LOOSE_APOSTROPHES))
    t = _if_any(t, ("' ",), _chain(lexicon.LOOSE_CAUSE))
    t = _if_upper(t, tuple(lexicon.CONTRACTIONS), _chain((rf"(?i)\b{bare}\b", full) for bare, full in lexicon.CONTRACTIONS.items()))
    t = _if_upper(t, ("IVE ",), _chain([(rf"(?i)\bIVE\b(?=\s+(?:{'|'.join(lexicon.AFTER_IVE)}))", "I'VE")]))
    t = let(t, lambda v: F.when(v.rlike(lexicon.STRAY_MARKS[0].strip(r"\s+")), F.regexp_replace(v, *lexicon.STRAY_MARKS)).otherwise(v))
    t = _if_any(t, (" .", " ,", " ;", " :"), _chain([lexicon.STRAY_POINTS]))
    t = _chain([lexicon.STRAY_LETTERS])(t)
    t = let(t, lambda v: F.when(F.left(v, F.lit(3)).rlike("[,;']"), _chain(lexicon.STRAY_STARTS)(v)).otherwise(v))
    return _chain([lexicon.LETTER_RUNS])(t)


def _joins(t: Column) -> Column:
    """C20-C25: leading marks and digits, hyphens, glued contractions."""
    t = let(t, lambda v: F.when(v.rlike(r"^[-.\s\d,]"), F.trim(F.regexp_replace(F.trim(F.regexp_replace(v, r"^[-.\s]+", "")), r"^[\d\s,.]+(?=[A-Z]{2})", ""))).otherwise(v))
    t = _if_any(t, ("-",), _chain(lexicon.HYPHENS))
    return _if_any(t, ("'",), _chain([lexicon.GLUED_CONTRACTIONS]))


def _most_common(toks: Column) -> Column:
    """struct n, word of the most frequent word; the first seen of those that tie."""
    each = F.transform(F.array_distinct(toks), lambda w, i: F.struct(F.size(F.filter(toks, lambda x: x == w)).alias("n"), (-i).alias("i"), w.alias("word")))
    return F.array_max(each)


def cleaned(
    text: Column,
    interjections=tuple(lexicon.INTERJECTIONS),
    sound_words=tuple(lexicon.SOUND_WORDS),
    short_words=tuple(lexicon.SHORT_WORDS),
) -> Column:
    """The cleaned line; null, empty and rejected lines give ''. Row-local."""

    def reject(t: Column, bad) -> Column:
        return let(t, lambda v: F.when(v == "", v).when(F.coalesce(bad(v), F.lit(False)), "").otherwise(v))

    def foreign(t: Column) -> Column:
        return t.rlike(lexicon.CJK) | (t.startswith("#") & t.contains(".")) | let(F.lower(t), lambda low: _any(low, lexicon.WATERMARKS))

    def key(t: Column) -> Column:
        return F.regexp_replace(F.upper(t), r"[!?.…\s]+$", "")

    def noise(t: Column) -> Column:
        words_only = let(key(t), lambda k: k.isin(*sound_words, *interjections))
        return t.rlike(r"^[.\s…]+$") | ~t.rlike("[a-zA-Z0-9]") | t.rlike(SOUND_RUN) | ((F.length(t) < 40) & words_only)

    def repeats(t: Column) -> Column:
        def judge(bare: Column) -> Column:
            def counted(n: Column) -> Column:
                same = (n == 1) & F.get(bare, F.lit(0)).isin(*interjections)
                # a word in 0.6 of the places leaves room for no more kinds of words than this
                often = F.when((F.size(bare) >= 3) & (n <= F.size(bare) * 0.4 + 1), let(_most_common(bare), lambda top: (top["n"] >= F.size(bare) * 0.6) & (F.length(top["word"]) <= 4))).otherwise(False)
                return (F.size(bare) >= 2) & (same | often)

            return let(F.size(F.array_distinct(bare)), counted)

        # the marks at the edges of all words at once; a word of marks alone stays as an empty one
        bare = F.regexp_replace(F.upper(t), lexicon.WORD_EDGE_MARKS, "")
        return let(F.split(bare, " "), judge)

    def too_short(t: Column) -> Column:
        def judge(n_alpha: Column, n_digit: Column) -> Column:
            n_words = F.size(words(t))
            marks = F.length(F.regexp_replace(t, "[^!?.…]+", ""))
            return (
                ((n_alpha < 2) & (n_digit == 0))
                | ((n_alpha == 0) & (n_digit > 4) & ~t.rlike("[,.]"))
                | ((n_alpha <= 5) & (((n_words == 1) & (n_alpha <= 3) & (n_digit == 0) & ~key(t).isin(*short_words)) | ((n_words <= 2) & (n_digit == 0) & (marks >= n_alpha))))
            )

        return let(F.length(letters(t)), lambda a: (a <= 5) & let(F.length(digits(t)), lambda d: judge(a, d)))

    def misread(t: Column) -> Column:
        t = _if_upper(t, tuple(lexicon.MISREADS), _chain((rf"(?i)\b{wrong}\b", right) for wrong, right in lexicon.MISREADS.items()))
        return _if_any(t, ("- ",), _chain([lexicon.BROKEN_QUESTION]))

    def fragments(t: Column) -> Column:
        long_words = F.regexp_count(F.regexp_replace(t, r"[^a-zA-Z\s]+", ""), F.lit("[a-zA-Z]{3,}"))
        return let(F.size(words(t)), lambda n: (n >= 3) & ((n - long_words) / n >= 0.6))

    t = _if_any(F.coalesce(text, F.lit("")), ("<",), _chain([(lexicon.MODEL_TOKENS, "")]))
    t = reject(F.trim(F.regexp_replace(t, SPACES, " ")), foreign)
    for bad in (noise, repeats, too_short):
        t = reject(_joins(_rewrites(t)) if bad is noise else t, bad)
    t = misread(let(t, lambda v: F.when(v.rlike("[0-9]"), fix_digit_misreads(v)).otherwise(v)))
    return F.trim(F.regexp_replace(reject(t, fragments), SPACES, " "))


def clean_text(df: DataFrame, column: str = "text", out: str = "clean", **lists) -> DataFrame:
    """Add the cleaned line of a text column, made once: the generator keeps the optimizer from copying it into filters."""
    return df.select("*", F.explode(F.array(cleaned(F.col(column), **lists))).alias(out)) if out not in df.columns else clean_text(df.drop(out), column, out, **lists)
