"""Gaps: tokens with lost letters, whole texts made ready for a language model, supplements and masked cases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import BOS, EOS, GAP, UNK, Compat
from .editorial import editorial, once, words
from .normalize import normalize_greek, remove_punctuation

#: A supplement: square brackets and what is in them, over line ends too.
SUPPLEMENT = r"\[[^\]]+\]"


def contains_lacunae(token: Column) -> Column:
    """Whether a token has a gap sign, a literal NONE, or a dot that does not just end its letters."""
    folded = F.upper(token)
    return (
        F.when(folded.contains("NONE"), True)
        .when(token.rlike(r"^\p{L}*\.$"), False)
        .otherwise(folded.contains("<GAP/>") | (token.contains(".") & (F.length(token) > 1)))
    )


def is_part_of_lacuna(piece: Column) -> Column:
    return (
        F.when(piece == ".", True)
        .when(piece.rlike(r"(?U)^\.[\p{L}\s]*$") & ~F.upper(piece).contains("NONE"), False)
        .otherwise(piece.rlike(r"^\p{L}*$") | contains_lacunae(piece) | (piece == UNK))
    )


def clean_lacunae(token: Column) -> Column:
    """Tokens that a token with a gap becomes: unknown words for lost letters, what stands clear of them kept."""
    pieces = words(F.replace(token, F.lit(GAP), F.lit(f" {UNK} ")))
    last = F.size(pieces) - 1
    indexed = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    none = F.array().cast("array<string>")

    def step(out: Column, x: Column) -> Column:
        p = x["p"]
        after = F.coalesce(F.get(out, F.size(out) - 1) == UNK, F.lit(False))
        unknown = F.when(after, out).otherwise(F.array_append(out, F.lit(UNK)))
        stop = p.rlike(r"(?U)^[\p{L}\s]*\.$") & ~F.upper(p).contains("NONE")
        return (
            F.when(stop & after, out)
            .when(is_part_of_lacuna(p), unknown)
            .when((x["i"] == last) | stop, F.array_append(out, p))
            .otherwise(F.array_append(out, F.lit(UNK)))
        )

    return F.when(token.contains(GAP), F.aggregate(indexed, none, step)).otherwise(F.array(F.lit(UNK)))


def clean_tokens(text: Column, case_folding: bool = True, normalize: bool = True) -> Column:
    """Tokens of a text without editorial marks; tokens with gaps become unknown words."""
    plain = (lambda t: normalize_greek(t, case_folding)) if normalize else (lambda t: t)
    mended = lambda tokens: F.flatten(F.transform(tokens, lambda t: F.when(contains_lacunae(t), clean_lacunae(t)).otherwise(F.array(t))))
    # only texts with a sign of a gap are looked at token by token
    out = once(text, lambda x: F.when(x.rlike("(?i)\\.|<gap/>|none"), mended(words(x))).otherwise(words(x)))
    return F.transform(out, lambda t: F.when(t == UNK, t).otherwise(plain(t))) if normalize else out


def transpile(text: Column, case_folding: bool = True, normalize: bool = True, compat: Compat | None = None) -> Column:
    """A marked text as plain tokens with single spaces: marks resolved, gaps unknown words, letters normalised unless that is off.

    Punctuation stays. Null stays null, an empty text stays empty.
    """
    upper = case_folding or (compat is not None and compat.upper_tokens)
    if not normalize:
        return F.array_join(clean_tokens(editorial(text), normalize=False), " ")
    joined = F.array_join(clean_tokens(editorial(text), normalize=False), " ")
    # one pass over the joined text does what a pass over each token would
    return normalize_greek(joined, upper)


def sentences(text: Column) -> Column:
    """Sentences of a plain text: cut at the white space after a full stop, a semicolon or a raised dot; without empty ones."""
    return F.filter(F.split(text, r"(?U)(?<=[.;·])\s+"), lambda s: F.trim(s) != "")


def sentence_tokens(text: Column, remove_punct: bool = True, case_folding: bool = True, normalize: bool = True) -> Column:
    """Token lists of the sentences of a marked text. A sentence of nothing but punctuation gives an empty list."""
    clean = remove_punctuation if remove_punct else (lambda s: s)
    return F.transform(sentences(transpile(text, case_folding, normalize)), lambda s: words(clean(s)))


def single_supplement(case: Column) -> Column:
    """The supplement of a text that has exactly one, else null."""
    found = F.regexp_extract_all(case, F.lit(SUPPLEMENT), 0)
    return F.when(F.size(found) == 1, F.get(found, 0))


def _clear(part: Column) -> Column:
    return once(part, lambda p: F.when(contains_lacunae(p), F.lit(None)).otherwise(remove_punctuation(transpile(p))))


def head(case: Column) -> Column:
    """Letters of the first supplement's word before it: empty if it begins the word, null without a supplement or with another gap."""
    return F.when(case.rlike(SUPPLEMENT), _clear(F.regexp_extract(case, rf"([^ \n\[]*){SUPPLEMENT}", 1)))


def tail(case: Column, compat: Compat | None = None) -> Column:
    """Letters of the first supplement's word after it, as head."""
    next_word = compat is not None and compat.next_word_tail
    return F.when(case.rlike(SUPPLEMENT), _clear(F.trim(F.regexp_extract(case, rf"{SUPPLEMENT}( ?[^ \n]*)" if next_word else rf"{SUPPLEMENT}([^ \n]*)", 1))))


def gap_length(case: Column) -> Column:
    """Dots in the first supplement."""
    return F.length(F.regexp_replace(F.regexp_extract(case, SUPPLEMENT, 0), r"[^.]", ""))


def padded(tokens: Column, n: int) -> Column:
    """tokens with n - 1 marks of begin and end."""
    pad = lambda sign: F.array_repeat(F.lit(sign), n - 1)
    return F.concat(pad(BOS), tokens, pad(EOS))


def context(case: Column, n: int) -> Column:
    """The last n - 1 tokens before the word of the only supplement, sentences padded; null where the case has not exactly one."""
    left = F.regexp_extract(case, r"(?s)^(.*?)[^\s\[]*\[", 1)
    tokens = F.flatten(F.transform(sentence_tokens(left), lambda s: padded(s, n)))
    before = F.slice(tokens, 1, F.greatest(F.size(tokens) - (n - 1), F.lit(0)))
    begin = F.array_repeat(F.lit(BOS), n - 1)
    full = F.when(F.size(tokens) > 0, before).otherwise(begin)
    return F.when(single_supplement(case).isNotNull(), F.slice(full, F.greatest(F.size(full) - (n - 2), F.lit(1)), n - 1))


def supplements(text: Column, case_folding: bool = True) -> Column:
    """Each supplement of a text in order: tokens of its word or words, and the number of its letters, 0 where it has several tokens.

    A supplement that begins or ends with a space is not widened on that side.
    """
    found = F.regexp_extract_all(text, F.lit(SUPPLEMENT), 0)
    rest = F.split(text, SUPPLEMENT)
    size = F.size(found)

    def one(s: Column, i: Column) -> Column:
        # what stands before and after the i-th supplement, as written
        left = F.array_join(F.flatten(F.zip_with(F.slice(rest, 1, i + 1), F.slice(found, 1, i), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
        right = F.concat(F.get(rest, i + 1), F.array_join(F.flatten(F.zip_with(F.slice(found, i + 2, size), F.slice(rest, i + 3, size), lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), ""))
        before, after = F.regexp_extract(left, r"[^ \n]*\z", 0), F.regexp_extract(right, r"^[^ \n]*", 0)
        opens, closes = F.substring(s, 2, 1).rlike(r"\s"), F.substring(s, -2, 1).rlike(r"\s")
        n = F.length(s)
        wide = (
            F.when(opens & closes, F.substr(s, F.lit(2), n - 3))
            .when(closes, F.concat(before, F.substr(s, F.lit(1), n - 1)))
            .when(opens, F.concat(s, after))
            .otherwise(F.concat(before, s, after))
        )
        tokens = words(remove_punctuation(transpile(wide, case_folding)))
        letters = F.length(F.regexp_replace(s, r"\P{L}", ""))
        return F.struct(tokens.alias("tokens"), F.when(F.size(tokens) > 1, 0).otherwise(letters).alias("gap_len"))

    return F.transform(found, one)


def mask_cases(text: Column) -> Column:
    """One masked text per supplement: that one as dots of its length, all other brackets gone."""
    found = F.regexp_extract_all(text, F.lit(SUPPLEMENT), 0)
    rest = F.split(text, SUPPLEMENT)
    bare = lambda c: F.translate(c, "[]", "")

    def one(s: Column, i: Column) -> Column:
        left = F.array_join(F.flatten(F.zip_with(F.slice(rest, 1, i + 1), F.slice(found, 1, i), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
        n = F.length(left) + F.length(s)
        return F.struct((i + 1).alias("case_index"), F.concat(bare(left), F.lit("["), F.repeat(F.lit("."), F.length(s) - 2), F.lit("]"), bare(F.substr(text, n + 1, F.length(text)))).alias("test_case"))

    return F.transform(found, one)


def splice(sentence: Column, suggestion: Column, whole_word: bool = True) -> Column:
    """sentence with its first gap replaced by the suggestion, together with the letters around it if whole_word."""
    pattern = r"\S*\[.*?\]\S*" if whole_word else r"\[.*?\]"
    found = F.regexp_substr(sentence, F.lit(pattern))
    at = F.instr(sentence, found)
    return F.when(found.isNull(), sentence).otherwise(F.concat(F.substr(sentence, F.lit(1), at - 1), suggestion, F.substr(sentence, at + F.length(found), F.length(sentence))))
