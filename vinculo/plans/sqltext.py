"""Pieces of the check queries in standard SQL."""

SPACES = r"[ \t\n\x0B\f\r\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def fold(x: str, repair: bool = False) -> str:
    x = f"regexp_replace({x}, '[\\x{{FEFF}}\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{2060}}\\x{{00AD}}\\x{{2028}}\\x{{2029}}]', '', 'g')"
    x = f"upper(strip_accents(replace({x}, 'ß', 'ss')))"
    x = f"regexp_replace({x}, '[-‐‑–—''`´]|{SPACES}', ' ', 'g')"
    if repair:
        x = repaired(x)
    x = f"regexp_replace({x}, '[^A-Z ]', '', 'g')"
    return f"trim(regexp_replace({x}, ' +', ' ', 'g'))"


def repaired(x: str) -> str:
    for d, c in (("0", "O"), ("1", "I"), ("5", "S")):
        x = f"regexp_replace({x}, '([A-Z]){d}([A-Z])', '\\1{c}\\2', 'g')"
    return x


def page_fold(x: str) -> str:
    x = f"upper(strip_accents(replace({x}, 'ß', 'ss')))"
    x = f"regexp_replace({x}, '[-‐‑–—'']|{SPACES}', ' ', 'g')"
    return f"regexp_replace({repaired(x)}, ' +', ' ', 'g')"


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def words(x: str, least: int) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: length(w) >= {least})"


def text_name(x: str = "text") -> str:
    """The name of a text, as in tables.text_name."""
    w = words(fold(x), 3)
    return (
        f"(SELECT CASE WHEN len(w) > 0 THEN w[1] || ' ' || w[CAST(floor(len(w) / 2.0) AS BIGINT) + 1] || ' ' || w[len(w)] "
        f"ELSE '' END FROM (SELECT {w} AS w))"
    )


def altered(name: str, n: str) -> str:
    return f"""(SELECT CASE {n} % 5
        WHEN 0 THEN {name}
        WHEN 1 THEN trim(left({name}, greatest(length({name}) - 2, 1)))
        WHEN 2 THEN concat_ws(' ', s[1], s[3])
        WHEN 3 THEN concat_ws(' ', left(s[1], length(s[1]) - 1) || 'E', s[2], s[3])
        ELSE concat_ws(' ', s[3], s[2], s[1]) END FROM (SELECT string_split({name}, ' ') AS s))"""


NAMED = f"""named AS (SELECT doc_id, source, CAST(substr(source, 4) AS INTEGER) AS file_ord, n_chars, {text_name()} AS name
    FROM documents)"""
PAIRS = f"{NAMED}, pairs AS (SELECT doc_id, name AS target, {altered('name', 'n_chars')} AS candidate FROM named)"


def initcap(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({x}, ' '), "
        "lambda q: upper(left(q, 1)) || lower(substr(q, 2))), ' ')"
    )


def file_part(x: str) -> str:
    x = f"strip_accents(regexp_replace({x}, '{SPACES}+', '_', 'g'))"
    x = f"regexp_replace(regexp_replace({x}, '[^a-zA-Z0-9_\\-./]', '_', 'g'), '_+', '_', 'g')"
    return f"regexp_replace({x}, '^_|_$', '', 'g')"
