"""The same results in SQL, written for DuckDB: chains of common table expressions over a relation (k, x) of keys and texts."""

from __future__ import annotations

import unicodedata

#: Punctuation that does not count, as SURVEY L7 lists it.
MARKS = ".·,;:!?'⁑"

#: White space in RE2, as in functions.editorial.
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
SUPPLEMENT = r"\[[^\]]+\]"
#: Words of a beam for the first ten predictions: four times as many.
BEAM = 40


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replaced(x: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(new)}, 'g')"


def trimmed(x: str) -> str:
    return replaced(x, f"^{WS}+|{WS}+$")


#: The editorial rules but the last, as SQL over x, by the names of functions.editorial.
RULES = {
    "integrations": "replace(replace(x, '||', ' '), '‖', ' ')",
    "line_breaks": "replace(x, '|', ' ')",
    "unclear_signs": "translate(x, '+*', '')",
    "brackets": trimmed("translate(" + replaced(replaced("x", rf"\.{WS}*<gap/>{WS}*\.", "."), r"\n\p{Nd}*", " ") + ", '[]', '')"),
    "metre": replaced("x", "⏑⏑‒|‒⏑⏑‒|‒⏑⏑|⏑|‒", "<gap/>"),
    "vacats": replaced("x", r"vac\.|vacat"),
    "notes": replaced("x", r"‡\p{Nd}+"),
    "doubts": "replace(x, '?', '')",
    "missing_lines": replaced("x", "⟦-+⟧"),
    "parentheses": "translate(x, '()', '')",
    "markers": replaced(replaced(replaced("x", "&lt;(.*?)&gt;", r"\1"), "<gap/>lt;(.*?)&gt;", r"<gap/>\1"), 'break="no"/&gt;|&gt;|&lt;'),
    "expunctions": replaced("x", r"\{\{.*?\}\}|\{.*?\}"),
    "parallels": "translate(" + replaced("x", "†.*?†") + ", '†_', '')",
}


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {quoted(WS + '+')}), lambda w: w <> '')"


def add(a: str, w: str) -> str:
    """A word put to words in one string."""
    return f"(CASE WHEN {a} = '' THEN {w} ELSE {a} || ' ' || {w} END)"


def dashes(x: str = "x") -> str:
    """A fold over words; what follows chr(1) waits for the next word."""
    bare, out, glue = "replace(w, '-', '')", "split_part(a, chr(1), 1)", "split_part(a, chr(1), 2)"
    step = (
        f"CASE WHEN contains(a, chr(1)) AND contains(w, '-') THEN {out} WHEN contains(a, chr(1)) THEN {add(out, f'{glue} || w')} "
        f"WHEN NOT contains(w, '-') THEN {add('a', 'w')} WHEN w = '-' THEN a WHEN suffix(w, '-') THEN a || chr(1) || {bare} "
        f"WHEN prefix(w, '-') THEN a || {bare} WHEN {bare} = '' THEN a ELSE {add('a', bare)} END"
    )
    fold = f"list_reduce({words(x)}, lambda a, w: {step}, '')"
    end = f"CASE WHEN contains(f, chr(1)) THEN {add('split_part(f, chr(1), 1)', 'split_part(f, chr(1), 2)')} ELSE f END"
    return f"CASE WHEN contains({x}, '-') THEN (SELECT {end} FROM (SELECT {fold} AS f)) ELSE {x} END"


def has_gap(t: str) -> str:
    return f"(CASE WHEN contains(upper({t}), 'NONE') THEN true WHEN regexp_full_match({t}, '\\p{{L}}*\\.') THEN false ELSE contains(upper({t}), '<GAP/>') OR (contains({t}, '.') AND length({t}) > 1) END)"


def mended(t: str) -> str:
    """Words, in one string, that a token with a gap becomes; pieces are marked 1 or 0 for the last one or another."""
    p, none = "substr(m, 2)", "contains(upper(substr(m, 2)), 'NONE')"
    after = "(a = '<UNK>' OR suffix(a, ' <UNK>'))"
    stop = f"(regexp_full_match({p}, '[\\p{{L}}\\s]*\\.') AND NOT {none})"
    part = f"(CASE WHEN {p} = '.' THEN true WHEN regexp_full_match({p}, '\\.[\\p{{L}}\\s]*') AND NOT {none} THEN false ELSE regexp_full_match({p}, '\\p{{L}}*') OR {has_gap(p)} OR {p} = '<UNK>' END)"
    step = f"CASE WHEN {stop} AND {after} THEN a WHEN {part} THEN (CASE WHEN {after} THEN a ELSE {add('a', quoted('<UNK>'))} END) WHEN m[1] = '1' OR {stop} THEN {add('a', p)} ELSE {add('a', quoted('<UNK>'))} END"
    pieces = words(f"replace({t}, '<gap/>', ' <UNK> ')")
    marked = f"list_transform({pieces}, lambda p, i: (CASE WHEN i = len({pieces}) THEN '1' ELSE '0' END) || p)"
    return f"CASE WHEN contains({t}, '<gap/>') THEN list_reduce({marked}, lambda a, m: {step}, '') ELSE '<UNK>' END"


def stripped(x: str) -> str:
    """x without combining marks; letters that decompose become their base. Written for itself, so that a wrong table elsewhere shows."""
    plain, bare_marks = {}, ""
    for ch in map(chr, (*range(0xC0, 0xAC00), *range(0xE000, 0x10000))):
        left = [c for c in unicodedata.normalize("NFD", ch) if unicodedata.combining(c) == 0]
        if not left:
            bare_marks += ch
        elif left != [ch] and len(left) == 1:
            plain[ch] = left[0]
    return f"translate({x}, {quoted(''.join(plain) + bare_marks)}, {quoted(''.join(plain.values()))})"


def upper(x: str) -> str:
    """x in capitals; DuckDB has one for the sharp s, other engines write it as two."""
    return f"upper(replace({x}, 'ß', 'SS'))"


def bare(x: str) -> str:
    """x without punctuation."""
    return f"translate({x}, {quoted(MARKS)}, '')"


def plain(name: str, source: str, letters: bool = True) -> str:
    """Common table expressions up to {name}(k, x): the texts of a relation (k, x) transpiled, in upper case without accents if letters."""
    out, last = [], source
    for i, rule in enumerate([*RULES.values(), dashes()]):
        out.append(f"{name}_{i} AS (SELECT k, {rule} AS x FROM {last})")
        last = f"{name}_{i}"
    out.append(f"{name}_t AS (SELECT k, {words('x')} AS w FROM {last})")
    out.append(f"{name}_e AS (SELECT k, u.t AS t, u.i AS i FROM {name}_t, LATERAL (SELECT unnest(w) AS t, generate_subscripts(w, 1) AS i) u)")
    out.append(f"{name}_m AS (SELECT k, i, CASE WHEN {has_gap('t')} THEN {mended('t')} ELSE t END AS t FROM {name}_e)")
    joined = f"SELECT k, string_agg(t, ' ' ORDER BY i) AS x FROM {name}_m GROUP BY k"
    text = upper(stripped("coalesce(j.x, '')")) if letters else "coalesce(j.x, '')"
    out.append(f"{name} AS (SELECT s.k, CASE WHEN s.x IS NULL THEN NULL ELSE {text} END AS x FROM {source} s LEFT JOIN ({joined}) j USING (k))")
    return ", ".join(out)


def sentences(name: str, source: str) -> str:
    """{name}(k, i, tokens): tokens without punctuation of each sentence of a relation (k, x) of plain texts."""
    cut = replaced("x", rf"([.;·]){WS}+", "\\1\x02")
    return (
        f"{name}_s AS (SELECT k, unnest(string_split({cut}, chr(2))) AS s, generate_subscripts(string_split({cut}, chr(2)), 1) AS i FROM {source} WHERE x IS NOT NULL), "
        f"{name} AS (SELECT k, i, {words(bare('s'))} AS tokens FROM {name}_s WHERE trim(s) <> '')"
    )


def grams(name: str, source: str, n: int, orders: list[int]) -> str:
    """{name}(k, i, o, ctx, word): n-grams of the padded token lists of a relation (k, i, tokens); words of ctx are joined by spaces."""
    pad = lambda sign: "[" + ", ".join([quoted(sign)] * (n - 1)) + "]"
    parts = [f"SELECT k, i, {o} AS o, unnest(list_transform(range(1, len(p) - {o} + 2), lambda j: {{'c': array_to_string(p[j:j + {o} - 2], ' '), 'w': p[j + {o} - 1]}})) AS g FROM {name}_p" for o in orders]
    return f"{name}_p AS (SELECT k, i, {pad('<s>')} || tokens || {pad('</s>')} AS p FROM {source}), {name} AS (SELECT k, i, o, g.c AS ctx, g.w AS word FROM ({' UNION ALL '.join(parts)}))"


#: Single bytes that stand for the letters of two strings.
BYTES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789!#$%&()*+,-./:;<=>?@[]^_{|}~"


def distance(a: str, b: str) -> str:
    """Edit distance in characters: DuckDB counts bytes, so the letters of both are brought to one byte each."""
    one = lambda x: f"translate({x}, {a} || {b}, '{BYTES}')"
    return f"(CASE WHEN {b} = '' THEN 0 ELSE levenshtein({one(a)}, {one(b)}) END)"


def lowered(x: str) -> str:
    """x in lower case, with the sigma that ends a word."""
    return f"regexp_replace(lower({x}), '(\\p{{L}})σ([^\\p{{L}}]|$)', '\\1ς\\2', 'g')"


def _widened(texts: str) -> str:
    """sup(k, i, raw, tokens, gap_len) of a relation each_(k, t): each supplement with the rest of its word, made plain."""
    s = quoted(SUPPLEMENT)
    return (
        f"sp AS (SELECT k, t, regexp_extract_all(t, {s}) AS f, string_split_regex(t, {s}) AS r FROM {texts}), si AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM sp), "
        "sb AS (SELECT k, i, f[i] AS raw, array_to_string(list_transform(range(1, i + 1), lambda j: r[j] || CASE WHEN j < i THEN f[j] ELSE '' END), '') AS before, "
        "array_to_string(list_transform(range(i + 1, len(r) + 1), lambda j: r[j] || CASE WHEN j <= len(f) THEN f[j] ELSE '' END), '') AS after FROM si), "
        f"sw AS (SELECT k, i, raw, regexp_extract(before, '[^ \n]*$') AS p, regexp_extract(after, '^[^ \n]*') AS q, regexp_matches(raw[2], '\\s') AS o, regexp_matches(raw[-2], '\\s') AS c FROM sb), "
        "s0 AS (SELECT {'k': k, 'i': i} AS k, CASE WHEN o AND c THEN substr(raw, 2, length(raw) - 3) WHEN c THEN p || left(raw, length(raw) - 1) WHEN o THEN raw || q ELSE p || raw || q END AS x FROM sw), "
        f"{plain('s1', 's0')}, sup AS (SELECT sw.k, sw.i, raw, {words(bare('x'))} AS tokens, length(regexp_replace(raw, '\\P{{L}}', '', 'g')) AS letters FROM sw JOIN s1 ON s1.k.k = sw.k AND s1.k.i = sw.i)"
    )


SUPPLEMENTS = f"each_ AS (SELECT id, id AS k, min(training_text) AS t, arg_min(test_cases, training_text) AS c FROM ab WHERE language = 'grc' AND training_text IS NOT NULL GROUP BY id), {_widened('each_')}"
#: A case per supplement of one word: the others stay as they are, this one becomes dots in the plain text.
DEV_CASES = (
    "each_ AS (SELECT row_number() OVER () AS k, corpus_id, file_id, training_text AS t FROM ab WHERE language = 'grc' AND training_text IS NOT NULL), "
    f"{_widened('each_')}, one AS (SELECT * FROM sup WHERE len(tokens) = 1 AND letters >= 1), "
    "d0 AS (SELECT {'k': one.k, 'i': one.i} AS k, before || 'QXZGAPZXQ' || after AS x FROM one JOIN sb ON sb.k = one.k AND sb.i = one.i), "
    f"{plain('d1', 'd0', letters=False)}, dc AS (SELECT replace(x, 'QXZGAPZXQ', '[' || repeat('.', letters) || ']') AS x, translate(raw, '[]', '') AS y, letters AS gap_length, corpus_id, file_id FROM one JOIN d1 ON d1.k.k = one.k AND d1.k.i = one.i JOIN each_ ON each_.k = one.k)"
)
