"""The clean-up of recognised lines as DuckDB SQL, written from its rules: what the Columns of operators.clean are held against.

That engine has no look-around and no back references, so those rules are put as arrays of words, second passes or one
alternative for each character.
"""

from __future__ import annotations

import string

from pageloom.functions import lexicon

WHITE = "[\\t\\n\\x0B\\f\\r \\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def swap(t: str, pattern: str, new: str) -> str:
    return f"regexp_replace({t}, {text(pattern)}, {text(new)}, 'g')"


def among(t: str, values) -> str:
    return f"({t} IN ({', '.join(text(v) for v in values)}))"


def contains_any(t: str, parts) -> str:
    return "(" + " OR ".join(f"contains({t}, {text(p)})" for p in parts) + ")"


def sound_run(t: str) -> str:
    """Up to three letters, one character three times or more in any case, up to three letters, end marks."""
    chars = string.ascii_lowercase + string.digits + string.punctuation + " "
    one = "|".join(("\\" + ch if not ch.isalnum() else ch) + "{3,}" for ch in chars)
    return f"regexp_matches(lower({t}), {text(f'^[a-z]{{0,3}}(?:{one})[a-z]{{0,3}}[!?.…]*$')})"


def _letters(t: str) -> str:
    return f"length({swap(t, '[^a-zA-Z]', '')})"


def _digits(t: str) -> str:
    return f"length({swap(t, '[^0-9]', '')})"


def _key(t: str) -> str:
    return f"regexp_replace(upper({t}), '[!?.…\\s]+$', '')"


def clean_ctes(source: str, column: str = "line") -> str:
    """CTEs up to clean(t, clean): the cleaned form of each distinct text in a column of source."""
    c = {}
    c["k0"] = f"SELECT DISTINCT {column} AS t FROM {source}"
    c["k1"] = f"SELECT t, trim({swap(swap('coalesce(t, chr(32))', lexicon.MODEL_TOKENS, ''), WHITE + '+', ' ')}) AS u FROM k0"
    cjk = "[\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}]"
    foreign = f"regexp_matches(u, '{cjk}') OR (u LIKE '#%' AND contains(u, '.')) OR {contains_any('lower(u)', lexicon.WATERMARKS)}"
    c["k2"] = f"SELECT t, translate(CASE WHEN {foreign} THEN '' ELSE u END, {text(lexicon.LOOKALIKES[0])}, {text(lexicon.LOOKALIKES[1])}) AS u FROM k1"
    c["k3"] = f"SELECT t, trim({swap(swap('u', '[^\\x00-\\x7F]', ''), '\\s+', ' ')}) AS u FROM k2"
    u = "u"
    for pattern, new in (("(?i)(\\w) ' (M|S|T|D|RE|VE|LL)\\b", "\\1'\\2"), ("(?i)\\bY ' KNOW\\b", "Y'KNOW"), ("(?i)\\b' CAUSE\\b", "'CAUSE"), *((f"(?i)\\b{a}\\b", b) for a, b in lexicon.CONTRACTIONS.items()),
                         (f"(?i)\\bIVE\\b(\\s+(?:{'|'.join(lexicon.AFTER_IVE)}))", "I'VE\\1"), ("\\s+[=|/\\\\<>@#$%^&*~`]+\\s+", " ")):
        u = swap(u, pattern, new)
    c["k4"] = f"SELECT t, {u} AS u FROM k3"
    twice = swap(swap("u", "(\\w)\\s+[.,;:]\\s+(\\w)", "\\1 \\2"), "(\\w)\\s+[.,;:]\\s+(\\w)", "\\1 \\2")
    c["k5"] = f"SELECT t, string_split({twice}, ' ') AS w FROM k4"
    # a lone letter between letters goes, but not one right after a letter that went
    c["k6"] = "SELECT t, w, list_transform(range(1, len(w) + 1), lambda i: i > 1 AND i < len(w) AND regexp_matches(w[i], '^[B-HJ-Zb-hj-z]$') AND regexp_matches(w[i - 1], '[a-zA-Z]$') AND regexp_matches(w[i + 1], '^[a-zA-Z]')) AS e FROM k5"
    c["k7"] = "SELECT t, array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT (e[i] AND (i - coalesce(list_max(list_filter(range(1, i), lambda j: NOT e[j])), 0)) % 2 = 1)), lambda i: w[i]), ' ') AS u FROM k6"
    u = "u"
    for pattern in ("^[A-Z],\\s+", "^'[a-z]{1,3}\\s+", "^[A-Za-z]{1,2}[,;]\\s+"):
        u = swap(u, pattern, "")
    for ch in string.ascii_letters:
        u = swap(u, ch + "{3,}", 2 * ch)
    c["k8"] = f"SELECT t, {u} AS u FROM k7"
    u = f"trim({swap('u', '^[-.\\s]+', '')})"
    u = f"trim({swap(u, '^[\\d\\s,.]+([A-Z]{2})', '\\1')})"
    for pattern, new in (("([A-Z]+)-\\s+([A-Z])", "\\1-\\2"), ("(\\w)-\\s+([a-z])", "\\1\\2"), ("\\b([A-Z]{2,6})-([A-Z]{2,6})\\b", "\\1\\2"), ("(\\w'(?:M|S|T|RE|VE|LL|D))([A-Z])", "\\1 \\2")):
        u = swap(u, pattern, new)
    c["k9"] = f"SELECT t, {u} AS u FROM k8"
    noise = f"regexp_matches(u, '^[.\\s…]+$') OR NOT regexp_matches(u, '[a-zA-Z0-9]') OR {sound_run('u')} OR {among(_key('u'), [*lexicon.SOUND_WORDS, *lexicon.INTERJECTIONS])}"
    c["k10"] = f"SELECT t, CASE WHEN {noise} THEN '' ELSE u END AS u FROM k9"
    c["k11"] = f"SELECT t, u, list_transform(list_filter(string_split(upper(u), ' '), lambda w: w <> ''), lambda w: {swap('w', '^[!?.,…~]+|[!?.,…~]+$', '')}) AS b FROM k10"
    c["k12"] = "SELECT *, list_sort(list_transform(range(1, len(b) + 1), lambda i: {'n': len(list_filter(b, lambda x: x = b[i])), 'i': -list_position(b, b[i]), 'w': b[i]}))[-1] AS top FROM k11"
    same = f"(len(list_distinct(b)) = 1 AND {among('b[1]', lexicon.INTERJECTIONS)})"
    c["k13"] = f"SELECT t, CASE WHEN len(b) >= 2 AND ({same} OR (len(b) >= 3 AND top.n >= len(b) * 0.6 AND length(top.w) <= 4)) THEN '' ELSE u END AS u FROM k12"
    c["k14"] = f"SELECT t, u, len(list_filter(string_split(u, ' '), lambda w: w <> '')) AS nw, {_letters('u')} AS na, {_digits('u')} AS nd, length({swap('u', '[^!?.…]', '')}) AS nm FROM k13"
    short = f"(na < 2 AND nd = 0) OR (na = 0 AND nd > 4 AND NOT regexp_matches(u, '[,.]')) OR (nw = 1 AND na <= 3 AND nd = 0 AND NOT {among(_key('u'), lexicon.SHORT_WORDS)}) OR (na <= 5 AND nw <= 2 AND nd = 0 AND nm >= na)"
    c["k15"] = f"SELECT t, CASE WHEN {short} THEN '' ELSE u END AS u FROM k14"
    c["k16"] = f"SELECT t, {digits_read('u')} AS u FROM k15"
    u = "u"
    for a, b in lexicon.MISREADS.items():
        u = swap(u, f"(?i)\\b{a}\\b", b)
    u = swap(u, "(\\w+)-\\s+(\\w+)\\?", "\\1\\2?")
    c["k17"] = f"SELECT t, u, list_filter(string_split(u, ' '), lambda w: w <> '') AS w FROM (SELECT t, {u} AS u FROM k16)"
    bits = f"len(w) >= 3 AND len(list_filter(w, lambda x: {_letters('x')} <= 2)) / len(w) >= 0.6"
    c["clean"] = f"SELECT t, trim({swap(f'CASE WHEN {bits} THEN chr(32) ELSE u END', '\\s+', ' ')}) AS clean FROM k17"
    return ", ".join(f"{name} AS MATERIALIZED ({body})" for name, body in c.items())


def digits_read(t: str) -> str:
    """10, 1 and 0 as TO, I and O in a line of capitals whose only number has at most two digits and stands beside no unit."""
    out, found = t, f"regexp_extract_all({t}, '\\d+')"
    strip = lambda x: f"upper(regexp_replace({x}, '^[.,!?;:]+|[.,!?;:]+$', '', 'g'))"
    able = f"regexp_matches({t}, '\\p{{L}}') AND NOT regexp_matches({swap(t, '\\p{Lu}', '')}, '\\p{{L}}') AND len({found}) = 1"
    for number, letter in (("10", "TO"), ("1", "I"), ("0", "O")):
        after, before = strip(f"regexp_extract({t}, '\\b{number}\\b\\s+(\\S+)', 1)"), strip(f"regexp_extract({t}, '(\\S+)\\s+\\b{number}\\b', 1)")
        beside = f"({among(after, lexicon.UNIT_WORDS)} OR {among(before, lexicon.UNIT_WORDS)})"
        out = f"CASE WHEN {able} AND {found}[1] = '{number}' AND NOT {beside} THEN {swap(t, f'\\b{number}\\b', letter)} ELSE {out} END"
    return out


def each_match(t: str, pattern: str, change) -> str:
    """t with change(match) for every match."""
    return f"array_to_string(list_transform(list_zip(regexp_split_to_array({t}, {text(pattern)}), regexp_extract_all({t}, {text(pattern)})), lambda z: z[1] || CASE WHEN z[2] IS NULL THEN '' ELSE {change('z[2]')} END), '')"


def spoken_ctes(source: str, small: str, column: str = "line") -> str:
    """CTEs up to spoken(t, spoken): the speech form of each distinct text of source. small: a list of the words of 0 to 999."""

    def number(v: str) -> str:
        return f"""CASE WHEN {v} = 0 THEN 'zero' ELSE trim(CASE WHEN {v} >= 1000000 THEN small[{v} // 1000000 + 1] || ' million ' ELSE '' END ||
 CASE WHEN {v} // 1000 % 1000 > 0 THEN small[{v} // 1000 % 1000 + 1] || ' thousand ' ELSE '' END || CASE WHEN {v} % 1000 > 0 THEN small[{v} % 1000 + 1] ELSE '' END) END"""

    def plain(m: str) -> str:
        return f"CASE WHEN length(ltrim({m}, '0')) <= 9 THEN {number(f'CAST({m} AS BIGINT)')} ELSE {m} END"

    def ordinal(m: str) -> str:
        w = number(f"CAST(regexp_extract({m}, '^\\d+') AS BIGINT)")
        return f"""CASE lower({m}) WHEN '1st' THEN 'first' WHEN '2nd' THEN 'second' WHEN '3rd' THEN 'third' ELSE CASE WHEN {w} LIKE '%y' THEN left({w}, -1) || 'ieth' WHEN {w} LIKE '%ve' THEN left({w}, -2) || 'fth'
 WHEN {w} LIKE '%t' AND {w} NOT LIKE '%ht' THEN {w} || 'h' WHEN {w} LIKE '%e' AND {w} NOT LIKE '%le' THEN left({w}, -1) || 'th' ELSE {w} || 'th' END END"""

    c = {"p0": f"SELECT DISTINCT {column} AS t, {small} AS small FROM {source} WHERE {column} IS NOT NULL"}
    read = each_match("t", "[0-9O][0-9O,.:]+[0-9O]", lambda m: f"CASE WHEN regexp_matches({m}, '[0-9]') THEN replace({m}, 'O', '0') ELSE {m} END")
    c["p1"] = f"SELECT t, small, {read} AS u FROM p0"
    c["p2"] = f"SELECT t, small, {each_match('u', '\\bOOO+\\b', lambda m: f"replace({m}, 'O', '0')")} AS u FROM p1"
    c["p3"] = f"SELECT t, small, {swap(swap('u', '(\\d)\\.(\\d{3,})', '\\1\\2'), '\\b([A-Za-z]{2,6})-([A-Za-z]{2,6})\\b', '\\1\\2')} AS u FROM p2"
    upper = f"length({swap('u', '[^\\p{L}]', '')}) > 0 AND length({swap('u', '[^\\p{Lu}]', '')}) / length({swap('u', '[^\\p{L}]', '')}) > 0.5"
    c["p4"] = f"SELECT t, small, u, {upper} AS loud, {swap('upper(left(u, 1)) || lower(substr(u, 2))', '\\bi\\b', 'I')} AS low FROM p3"
    c["p5"] = f"SELECT t, small, CASE WHEN loud THEN {each_match('low', '[.!?]\\s+[a-z]', lambda m: f'upper({m})')} ELSE u END AS u FROM p4"
    c["p6"] = f"SELECT t, small, {swap(each_match('u', '(?i)\\b\\d+(?:st|nd|rd|th)\\b', ordinal), '(\\d),(\\d)', '\\1\\2')} AS u FROM p5"
    u = each_match("u", "\\b\\d+\\b", plain)
    for pattern, new in (("!{2,}", "!"), ("\\?{2,}", "?"), ("\\.{2,}", "."), ("([!?])[!?]+", "\\1")):
        u = swap(u, pattern, new)
    c["spoken"] = f"SELECT t, {u} AS spoken FROM p6"
    return ", ".join(f"{name} AS MATERIALIZED ({body})" for name, body in c.items())
